import gzip

import pytest

from tagloom.sources.fastq import FastqError, read_fastq, read_pairs, read_sam, read_sheet, read_whitelist, records, write_fastq
from tagloom.streaming.live import counts_so_far, live_counts, live_matches

TEXT = b"@a 1:N:0:AC+GT\nACGT\n+\nIIII\n@b\r\nAC\r\n+\r\nII\r\n@c\tRX:Z:AA\nG\n+\nI"


def test_fastq_in_and_out(spark, tmp_path):
    plain, packed = tmp_path / "a.fq", tmp_path / "b.fq.gz"
    plain.write_bytes(TEXT)
    packed.write_bytes(gzip.compress(TEXT))
    got = read_fastq(spark, str(plain), str(packed)).orderBy("src_index").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in got] == 2 * [("a", "1:N:0:AC+GT", "ACGT", "IIII"), ("b", "", "AC", "II"), ("c", "RX:Z:AA", "G", "I")]
    out = str(tmp_path / "out")
    write_fastq(read_fastq(spark, str(plain)), out)
    parts = sorted(str(p) for p in (tmp_path / "out").glob("part-*.gz"))
    assert [(r.name, r.seq) for r in read_fastq(spark, *parts).orderBy("src_index").collect()] == [("a", "ACGT"), ("b", "AC"), ("c", "G")]


@pytest.mark.parametrize("text", [b"@a\nAC\n+\n", b"a\nAC\n+\nII\n", b"@a\nAC\nII\n+\n", b"@a\nAC\n+\nI\n"])
def test_broken_fastq(text):
    with pytest.raises(FastqError):
        list(records(iter(text.splitlines(True)), "x"))


def test_pairs(spark, tmp_path):
    (tmp_path / "1.fq").write_bytes(TEXT)
    (tmp_path / "2.fq").write_bytes(TEXT)
    (tmp_path / "3.fq").write_bytes(TEXT[:20] + b"+\nIIII\n")
    assert read_pairs(spark, [str(tmp_path / "1.fq")], [str(tmp_path / "2.fq")]).filter("seq = seq2").count() == 3
    with pytest.raises(Exception, match="without a mate"):
        read_pairs(spark, [str(tmp_path / "1.fq")], [str(tmp_path / "3.fq")]).select("seq2").collect()
    with pytest.raises(Exception, match="without a mate"):
        read_pairs(spark, [str(tmp_path / "1.fq")], [str(tmp_path / "3.fq")]).count()


def test_sam_reads_are_as_sequenced(spark, tmp_path):
    def sam(*lines):
        (tmp_path / "y.sam").write_text("".join(f"{name}\t{flag}\t*\t0\t0\t*\t*\t0\t0\t{seq}\t{qual}{tags}\n" for name, flag, seq, qual, tags in lines))
        return read_sam(spark, str(tmp_path / "y.sam"))

    rx = "\tRX:Z:GG"
    got = {r.name: (r.seq, r.qual) for r in sam(("a", 0, "AACG", "!#5I", rx), ("b", 16, "AACG", "!#5I", rx), ("c", 256, "TT", "II", rx), ("d", 2064, "TT", "II", rx)).collect()}
    assert got == {"a": ("AACG", "!#5I"), "b": ("CGTT", "I5#!")}
    many = "".join(f"\t{chr(65 + i // 10)}{i % 10}:Z:{'v' * 10}" for i in range(100)) + rx
    assert len(sam(("a", 4, "AC", "II", many)).first().tags) >= 100
    with pytest.raises(ValueError, match="mixed"):
        sam(("a", 77, "AC", "II", rx), ("b", 4, "AC", "II", rx))
    with pytest.raises(Exception, match="without RX"):
        sam(("a", 4, "AC", "II", "\tNM:i:0"), ("b", 4, "AC", "II", rx)).count()


def test_sam_whitelist_and_sheet(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nr\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tRX:Z:GG\tCB:Z:A:B\n")
    r = read_sam(spark, str(tmp_path / "x.sam")).first()
    assert (r.name, r.flag, r.seq, r.tags) == ("r", 4, "AC", {"RX": "GG", "CB": "A:B"})
    (tmp_path / "w.txt").write_text("# list\nAAAA-1\n\nCCCC\nAAAA-2\n")
    assert sorted(x.cell for x in read_whitelist(spark, str(tmp_path / "w.txt")).collect()) == ["AAAA", "CCCC"]
    (tmp_path / "v.txt").write_text("AAAA\nCCC\n")
    with pytest.raises(ValueError):
        read_whitelist(spark, str(tmp_path / "v.txt"))
    assert read_sheet(["# c", "S1\tNNNNACGT\t.\t\tx", "S2 NNA"])[0] == {"sample": "S1", "pattern": "NNNNACGT", "slave": None, "r1": None, "r2": "x"}
    with pytest.raises(ValueError, match="line 1"):
        read_sheet(["S/1 NNA"])


def test_streams(spark, tmp_path):
    rows = [(i, "S", "AAAA" if i % 2 else "CCCC", "AAAATACGTGG", "I" * 11) for i in range(10)]
    df = spark.createDataFrame(rows, "src_index long, sample_id string, umi string, seq string, qual string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    live_counts(stream, str(tmp_path / "live"), str(tmp_path / "cp")).processAllAvailable()
    assert {(r.key, r.cnt) for r in counts_so_far(spark, str(tmp_path / "live")).collect()} == {("AAAA", 5), ("CCCC", 5)}
    df.limit(3).write.mode("append").parquet(str(tmp_path / "in"))
    spark.streams.active[0].processAllAvailable()
    assert sum(r.cnt for r in counts_so_far(spark, str(tmp_path / "live")).collect()) == 13
    q = live_matches(stream, "NNNNTACGT").select("match.umi").writeStream.format("memory").queryName("matched").start()
    q.processAllAvailable()
    assert spark.table("matched").count() == 13
    for x in spark.streams.active:
        x.stop()
