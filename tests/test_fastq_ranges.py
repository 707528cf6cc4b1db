"""FASTQ in ranges of bytes, and by sample through the data source's writer."""

import gzip
import random
import zlib

import pytest

from tagloom.sources import fastq, fastq_sink
from tagloom.sources.fastq import Range, read_fastq, records


def text(seed, n=300, end=b"\n", last=True):
    draw, out = random.Random(seed), []
    for i in range(n):
        m = draw.choice((0, 1, 3, 20, 90))
        seq = "".join(draw.choices("ACGTN", k=m))
        qual = "".join(draw.choice("@+I!5") for _ in range(m))  # lines of qualities that look like others
        out.append(f"@r{i} BX:Z:{draw.randint(0, 9)}".encode() + end + seq.encode() + end + draw.choice((b"+", b"+@r")) + end + qual.encode() + end)
    whole = b"".join(out)
    return whole if last else whole[: -len(end)]


def blocked(data, seed, size=700):
    """As BGZF, in blocks of varied length, with the empty one at the end."""
    draw, out, at = random.Random(seed), [], 0
    while at < len(data) or not out:
        part = data[at : at + draw.randint(1, size)]
        at += len(part)
        squeezed = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = squeezed.compress(part) + squeezed.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little")
        out.append(head + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    return b"".join(out) + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def in_ranges(path, size, step, blocks):
    begins = list(range(0, size, step))
    return [list(records(fastq.range_lines(Range(str(path), a, b, blocks, 0)), "x")) for a, b in zip(begins, [*begins[1:], -1])]


@pytest.mark.parametrize(("end", "last"), [(b"\n", True), (b"\r\n", True), (b"\n", False)])
def test_any_ranges_give_the_same_records(tmp_path, end, last):
    data = text(1, 60, end, last)
    path = tmp_path / "a.fq"
    path.write_bytes(data)
    whole = list(records(iter(data.splitlines(True)), "x"))
    for step in [*range(1, 60), *range(60, len(data) + 50, 37)]:
        assert [r for part in in_ranges(path, len(data), step, False) for r in part] == whole, step


def test_any_ranges_of_blocks_give_the_same_records(tmp_path):
    data = text(2, 120)
    whole = list(records(iter(data.splitlines(True)), "x"))
    for seed, size in ((1, 60), (2, 700), (3, 20_000)):
        packed = blocked(data, seed, size)
        assert gzip.decompress(packed) == data
        path = tmp_path / f"{seed}.fq.gz"
        path.write_bytes(packed)
        for step in (1 << 20, len(packed) - 5, 3000, 911, 300):
            assert [r for part in in_ranges(path, len(packed), step, True) for r in part] == whole, (seed, step)


def test_block_boundaries_at_records(tmp_path):
    """Blocks that end with a record: the next record belongs to one range only."""
    one = b"@a\nACGT\n+\nIIII\n"
    packed = b"".join(blocked(one, 1, 1000)[:-28] for _ in range(50)) + blocked(b"", 1)[-28:]
    path = tmp_path / "b.fq.gz"
    path.write_bytes(packed)
    for step in (len(packed) // 50, 97, 200):
        assert sum(len(p) for p in in_ranges(path, len(packed), step, True)) == 50
    (tmp_path / "c.fq").write_bytes(one * 50)
    for step in (len(one), 2 * len(one), 7):
        assert sum(len(p) for p in in_ranges(tmp_path / "c.fq", 50 * len(one), step, False)) == 50


def test_reads_and_their_numbers(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(text(3, 200))
    (tmp_path / "b.fq.gz").write_bytes(blocked(text(4, 150), 1))
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(text(5, 50)))
    (tmp_path / "d.fq").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("a.fq", "b.fq.gz", "c.fq.gz", "d.fq")]
    whole = sorted(map(tuple, read_fastq(spark, *paths).collect()))
    assert len(whole) == 400 and [r[0] for r in whole[:200]] == list(range(200)) and whole[200][0] == fastq.FILE_STEP
    for split in (700, 2500):
        got = read_fastq(spark, *paths, split=split)
        assert sorted(map(tuple, got.collect())) == whole
        assert got.rdd.getNumPartitions() > 6
    assert [p.begin for p in fastq.ranges([paths[2]], 100)] == [0]  # plain gzip stays whole


def test_broken_files_in_ranges(tmp_path):
    (tmp_path / "a.fq").write_bytes(text(6, 30) + b"@cut\nACGT\n+\n")
    with pytest.raises(fastq.FastqError):
        in_ranges(tmp_path / "a.fq", (tmp_path / "a.fq").stat().st_size, 400, False)
    packed = blocked(text(6, 30), 1)
    (tmp_path / "b.fq.gz").write_bytes(packed[:-40])
    with pytest.raises((fastq.FastqError, zlib.error, EOFError)):
        in_ranges(tmp_path / "b.fq.gz", len(packed) - 40, 1 << 20, True)
        in_ranges(tmp_path / "b.fq.gz", len(packed) - 40, 300, True)


ASSIGNED = "src_index long, status string, sample string, name string, comment string, seq string, qual string"


def rows(n=500):
    return [(i, "assigned" if i % 7 else "unmatched", ("S1" if i % 5 else "S 2") if i % 7 else None, f"r{i}", "RX:Z:A" if i % 3 else "", "ACGT"[: i % 5], "IIII"[: i % 5]) for i in range(n)]


@pytest.mark.parametrize("compress", [True, False])
def test_samples_round_trip(spark, tmp_path, compress):
    df = spark.createDataFrame(rows(), ASSIGNED).repartition(5)
    counts = fastq_sink.write_fastq_samples(df, str(tmp_path / "out"), ["S1", "S 2", "S3"], compress)
    for sample in ("S1", "S 2", "S3"):
        want = [r[3:] for r in rows() if r[2] == sample]
        got = fastq_sink.read_fastq_sample(spark, str(tmp_path / "out"), sample).orderBy("src_index").collect()
        assert [(r.name, r.comment, r.seq, r.qual) for r in got] == want and counts[sample] == len(want)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["S 2", "S1", "S3", "_samples.json"]
    none = fastq_sink.write_fastq_samples(df.limit(0), str(tmp_path / "none"), ["S1"], compress)
    assert none == {"S1": 0} and fastq_sink.read_fastq_sample(spark, str(tmp_path / "none"), "S1").count() == 0
    with pytest.raises(ValueError):
        fastq_sink.write_fastq_samples(df, str(tmp_path / "bad"), ["../S1"])


def test_failed_and_repeated_attempts_leave_nothing(tmp_path, monkeypatch):
    import pyarrow as pa

    class Task:
        @staticmethod
        def get():
            return Task

        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(fastq_sink, "TaskContext", Task)
    batch = pa.RecordBatch.from_pylist([{"sample": "S", "name": f"r{i}", "comment": "", "seq": "AC", "qual": "II"} for i in range(4)])
    writer = fastq_sink.SampleWriter(str(tmp_path / "o"), ["S", "T"], False)

    def breaks():
        yield batch
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    writer.write(iter([batch]))  # a second run of the same task, whose message is not used
    good = writer.write(iter([batch]))
    writer.commit([good, None])
    assert sorted(str(p.relative_to(tmp_path / "o")) for p in (tmp_path / "o").rglob("*") if p.is_file()) == ["S/part-00003-000.fastq", "T/part-00000-000.fastq", "_samples.json"]
    assert (tmp_path / "o/S/part-00003-000.fastq").read_text().count("@r") == 4 and not (tmp_path / "o/_pending").exists()
    again = fastq_sink.SampleWriter(str(tmp_path / "o"), [], False)
    again.write(iter([batch]))
    again.abort([None])
    assert not (tmp_path / "o/_pending").exists() and (tmp_path / "o/S/part-00003-000.fastq").exists()
