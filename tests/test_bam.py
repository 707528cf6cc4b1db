"""BAM against the SAM text of the same records."""

import random
import struct

import pytest

from tagloom.sources import bam
from tagloom.sources.fastq import FastqError, read_sam
from test_fastq_ranges import blocked

CODES = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}


def records(seed, n=200):
    draw, out = random.Random(seed), []
    for i in range(n):
        m = draw.choice((0, 1, 7, 40, 150))
        tags = [("RX", "Z", "".join(draw.choices("ACGT", k=6))), ("NM", draw.choice("cCsSiI"), draw.randint(0, 100)), ("XA", "A", draw.choice("xyz")), ("XF", "f", 0.5), ("XB", "B", ("s", [1, -2, 300]))]
        out.append((f"r{i}", draw.choice((0, 4, 16, 256, 2048)), "".join(draw.choices("ACGTN", k=m)), draw.choice((None, [draw.randint(0, 41) for _ in range(m)])), tags[: draw.randint(1, 5)]))
    return out


def sam_line(name, flag, seq, qual, tags):
    text = "".join(f"\t{k}:{'i' if t in 'cCsSiI' else t}:{','.join([v[0], *map(str, v[1])]) if t == 'B' else v}" for k, t, v in tags)
    return f"{name}\t{flag}\t*\t0\t0\t*\t*\t0\t0\t{seq or '*'}\t{''.join(chr(33 + q) for q in qual) if qual else '*'}{text}\n"


def packed(name, flag, seq, qual, tags):
    aux = b""
    for k, t, v in tags:
        aux += k.encode() + t.encode()
        aux += v.encode() + b"\0" if t == "Z" else v.encode() if t == "A" else v[0].encode() + struct.pack(f"<i{len(v[1])}h", len(v[1]), *v[1]) if t == "B" else struct.pack(f"<{bam.NUMBERS[t]}", v)
    padded = seq + "=" * (len(seq) % 2)
    bases = bytes(CODES[a] << 4 | CODES[b] for a, b in zip(padded[::2], padded[1::2]))
    body = struct.pack(bam.FIXED, -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + bases + (bytes(qual) if qual else b"\xff" * len(seq)) + aux
    return struct.pack("<i", len(body)) + body


def file_of(rows, seed=1, size=600):
    head = b"@HD\tVN:1.6\n"
    return blocked(b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + b"".join(packed(*r) for r in rows), seed, size)


def test_reads_equal_the_text_of_the_same_records(spark, tmp_path):
    rows = records(1)
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n" + "".join(sam_line(*r) for r in rows))
    want = sorted((r.name, r.flag, r.seq, r.qual, sorted(r.tags.items())) for r in read_sam(spark, str(tmp_path / "x.sam")).collect())
    assert 50 < len(want) < 200
    (tmp_path / "x.bam").write_bytes(file_of(rows))
    for split in (1 << 20, 3000, 900):
        got = bam.read_bam(spark, str(tmp_path / "x.bam"), split)
        assert sorted((r.name, r.flag, r.seq, r.qual, sorted(r.tags.items())) for r in got.collect()) == want, split
    assert len(bam.stretches(spark, str(tmp_path / "x.bam"), 900)) > 5


def test_stretches_meet_wherever_the_file_is_cut(tmp_path):
    rows = records(2, 60)
    data = file_of(rows, 3, 200)
    path = tmp_path / "y.bam"
    path.write_bytes(data)
    with open(path, "rb") as raw:
        first, references = bam.header(bam.Text(bam.inflated(raw, str(path), 0)))
    for cut in range(1, len(data), 41):
        a, b = bam._stretch(str(path), 0, cut, references, first), bam._stretch(str(path), cut, -1, references, first)
        assert a[1] == b[0] or a[0] is None or b[0] is None, cut
        parts = [bam.Stretch(str(path), *s) for s in (a, b) if s[0] is not None]
        assert [r[0] for p in parts for r in bam.stretch_records(p)] == [r[0] for r in rows]


def test_broken_and_empty_files(spark, tmp_path):
    (tmp_path / "e.bam").write_bytes(file_of([]))
    assert bam.stretches(spark, str(tmp_path / "e.bam"), 1 << 20) == [] and bam.read_bam(spark, str(tmp_path / "e.bam")).count() == 0
    (tmp_path / "n.bam").write_bytes(blocked(b"no header at all", 1))
    with pytest.raises(FastqError, match="header"):
        bam.read_bam(spark, str(tmp_path / "n.bam"))
    cut = b"BAM\1" + struct.pack("<ii", 0, 0) + packed(*records(3, 1)[0])[:-3]
    (tmp_path / "c.bam").write_bytes(blocked(cut, 1))
    with pytest.raises(Exception, match="cut off"):
        bam.read_bam(spark, str(tmp_path / "c.bam")).count()
    mixed = [("a", 77, "AC", None, [("RX", "Z", "A")]), ("b", 4, "AC", None, [("RX", "Z", "A")])]
    (tmp_path / "m.bam").write_bytes(file_of(mixed))
    with pytest.raises(ValueError, match="mixed"):
        bam.read_bam(spark, str(tmp_path / "m.bam"))
