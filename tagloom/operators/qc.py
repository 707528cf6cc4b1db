"""Run quality: index hopping, tile yield, per-cycle profile, k-mer enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import BASES, PHRED_MAX, PHRED_OFFSET, index_pair, lane_tile
from ..storage import written
from .consensus import CODE
from .match import Letters

DECLARED_SHARE = 0.05
KMER = 8
TOP_KMERS = 64


def index_pairs(reads: DataFrame) -> DataFrame:
    """(i7, i5, reads, share_of_i7, share_of_i5, declared) over every read with a pair in its comment."""
    pairs = reads.select(index_pair("comment").alias("p")).filter("p IS NOT NULL").groupBy("p.i7", "p.i5").agg(F.count("*").alias("reads"))
    one = F.col("reads") / F.sum("reads").over(Window.partitionBy("i7"))
    other = F.col("reads") / F.sum("reads").over(Window.partitionBy("i5"))
    out = pairs.select("i7", F.when(F.col("i5") == "", ".").otherwise(F.col("i5")).alias("i5"), "reads", one.alias("share_of_i7"), other.alias("share_of_i5"))
    return out.withColumn("declared", (F.col("share_of_i7") >= DECLARED_SHARE) & (F.col("share_of_i5") >= DECLARED_SHARE))


def hopping(pairs: DataFrame) -> DataFrame:
    """(declared_pairs, reads, hopped, rate, estimable): the share of reads on undeclared pairs, if both indices vary."""
    out = pairs.agg(F.count_if("declared").alias("declared_pairs"), F.sum("reads").alias("reads"), F.coalesce(F.sum(F.when(~F.col("declared"), F.col("reads"))), F.lit(0)).alias("hopped"), F.count_distinct("i7").alias("_a"), F.count_distinct(F.when(F.col("i5") != ".", F.col("i5"))).alias("_b"))
    return out.select("declared_pairs", "reads", "hopped", (F.col("hopped") / F.col("reads")).alias("rate"), ((F.col("_a") >= 2) & (F.col("_b") >= 2)).alias("estimable"))


def tile_yield(reads: DataFrame) -> DataFrame:
    """(lane, tile, reads, share_of_lane)."""
    tiles = reads.select(lane_tile("name").alias("t")).filter("t.lane IS NOT NULL AND t.tile IS NOT NULL").groupBy("t.lane", "t.tile").agg(F.count("*").alias("reads"))
    return tiles.withColumn("share_of_lane", F.col("reads") / F.sum("reads").over(Window.partitionBy("lane")))


def _cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cycle, A, C, G, T, other, sum of Phred values, how many): a row a cycle of each batch."""
    for batch in batches:
        reads = Letters(batch.column(0), batch.column(1))
        cycles = int(reads.length.max(initial=0))
        at = np.arange(len(reads.seq)) - np.repeat(reads.at, reads.length)
        counts = np.bincount(at * 5 + CODE[reads.seq], minlength=5 * cycles).reshape(-1, 5)
        q_at = np.arange(len(reads.qual)) - np.repeat(reads.q_at, reads.q_length)
        q = np.clip(reads.qual.astype(np.int64) - PHRED_OFFSET, 0, PHRED_MAX)
        inside = q_at < np.repeat(reads.length, reads.q_length)
        phred = np.bincount(q_at[inside], q[inside], cycles)
        marked = np.bincount(q_at[inside], minlength=cycles)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, cycles + 1, dtype=np.int32)), *(pa.array(c) for c in counts.T.astype(np.int64)), pa.array(phred), pa.array(marked.astype(np.int64))], ["cycle", *BASES, "other", "phred", "marked"])


def cycle_profile(reads: DataFrame) -> DataFrame:
    """(cycle, A, C, G, T, other, mean_phred, entropy_bits, collision, consensus, deviation), cycles from 1. Counted in tasks: a row a cycle moves."""
    parts = reads.select("seq", "qual").mapInArrow(_cycles, "cycle int, A long, C long, G long, T long, other long, phred double, marked long")
    n = parts.groupBy("cycle").agg(*[F.sum(b).alias(b) for b in (*BASES, "other")], (F.sum("phred") / F.nullif(F.sum("marked"), F.lit(0))).alias("mean_phred"))
    called = sum((F.col(b) for b in BASES), F.lit(0))
    share = [F.when(called > 0, F.col(b) / called).otherwise(0.0) for b in BASES]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))
    most = F.greatest(*share)
    consensus = F.when(called == 0, "N")
    for b, p in zip(BASES, share):
        consensus = consensus.when(p == most, b)
    deviation = sum((F.abs(p - 0.25) for p in share), F.lit(0.0)) / 2
    return n.select("cycle", *BASES, "other", "mean_phred", entropy.alias("entropy_bits"), sum((p * p for p in share), F.lit(0.0)).alias("collision"), consensus.alias("consensus"), deviation.alias("deviation"))


_TALLY = [("kmer", pa.string()), ("letter", pa.string()), ("count", pa.int64()), ("at", pa.int64()), ("in_reads", pa.int64())]
DENSE = 1 << 20  # k-mers that are counted in arrays of a place each
AT_ONCE = 1 << 22  # bytes of reads looked at together


def _tallied(k: int):
    """Rows of ``_TALLY``: each k-mer's occurrences, sum of their places from 1 and reads; each letter's occurrences; the reads, without k-mer and letter.

    K-mers are numbers of two bits a letter. Where there are few, their sums are held for a whole
    task, else they go out batch by batch; k-mers too long for a number stay letters.
    """
    schema = pa.schema(_TALLY)
    dense = 4**k <= DENSE

    def named(codes: np.ndarray) -> pa.Array:
        if codes.dtype.kind == "S":
            return pa.array(codes.astype(str), pa.string())
        letters = np.frombuffer(BASES.encode(), np.uint8)[codes[:, None] >> np.arange(2 * k - 2, -1, -2) & 3]
        return pa.array(np.ascontiguousarray(letters).view(f"S{k}").ravel().astype(str), pa.string())

    def rows(codes: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([named(codes), pa.nulls(len(codes), pa.string()), *(pa.array(x.astype(np.int64)) for x in sums)], schema=schema)

    def parts(seqs: pa.Array) -> Iterator[pa.Array]:
        step = max(1, len(seqs) * AT_ONCE // max(1, seqs.nbytes))
        return (seqs.slice(i, step) for i in range(0, len(seqs), step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanned, letters = 0, np.zeros(4, np.int64)
        held = np.zeros((3, 4**k), np.int64) if dense else None
        for seqs in (p for batch in batches for p in parts(batch.column(0))):
            reads = Letters(seqs, seqs)
            scanned += len(seqs)
            code = CODE[reads.seq]
            letters += np.bincount(code, minlength=5)[:4]
            n = len(code) - k + 1
            if n < 1:
                continue
            read = np.repeat(np.arange(len(seqs), dtype=np.int32), reads.length)
            other = np.r_[0, np.cumsum(code == 4)]
            whole = np.flatnonzero((read[:n] == read[k - 1 :]) & (other[k:] == other[:n]))
            if not len(whole):
                continue
            if k <= 31:
                number = np.zeros(n, np.int64)
                for i in range(k):
                    number <<= 2
                    number |= code[i : i + n]
                number = number[whole]
            else:
                number = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(reads.seq, k)[whole]).view(f"S{k}").ravel()
            read = read[whole]
            at = whole - reads.at[read] + 1
            if not dense:
                found, number = np.unique(number, return_inverse=True)
            # A read's repeats of a k-mer stand together once sorted by k-mer, as reads already ascend.
            order = np.argsort(number.astype(np.uint16 if 4**k <= 1 << 16 else np.int64), kind="stable")
            number, read, at = number[order], read[order], at[order]
            head = np.r_[True, number[1:] != number[:-1]]
            new = head | np.r_[True, read[1:] != read[:-1]]
            begin = np.flatnonzero(head)
            sums = np.diff(np.r_[begin, len(number)]), np.add.reduceat(at, begin), np.add.reduceat(new.astype(np.int64), begin)
            if dense:
                held[:, number[begin]] += np.stack(sums)
            else:
                yield rows(found, *sums)
        if dense:
            found = np.flatnonzero(held[0])
            yield rows(found, *held[:, found])
        none = pa.nulls(5, pa.string())
        yield pa.RecordBatch.from_arrays([none, pa.array([*BASES, None], pa.string()), pa.array([*letters.tolist(), scanned]), pa.array([0] * 5), pa.array([0] * 5)], schema=schema)

    return run


def kmer_enrichment(reads: DataFrame, k: int = KMER, top: int = TOP_KMERS) -> DataFrame:
    """(kmer, count, expected, ratio, mean_position, read_fraction): the most enriched k-mers over the reads' own composition.

    The limit is the report's; every k-mer is counted. K-mers, letters and reads are counted in
    one pass over the reads, in tasks: a row a k-mer of a task moves.
    """
    tallied = reads.select("seq").mapInArrow(_tallied(k), "kmer string, letter string, count long, at long, in_reads long")
    tallied = written(tallied.groupBy("kmer", "letter").agg(*[F.sum(c).alias(c) for c in ("count", "at", "in_reads")]), "kmers")
    counted = tallied.filter("kmer IS NOT NULL").select("kmer", "count", (F.col("at") / F.col("count") - 1).alias("mean_position"), "in_reads")
    sums = {r.letter: r["count"] for r in tallied.filter("kmer IS NULL").select("letter", "count").collect()}  # five rows
    scanned, total, bases = sums.get(None, 0), counted.agg(F.sum("count")).first()[0], sum(sums.get(b, 0) for b in BASES)
    if not total:
        return counted.select("kmer", "count", F.lit(0.0).alias("expected"), F.lit(0.0).alias("ratio"), "mean_position", F.lit(0.0).alias("read_fraction"))
    expected = F.lit(float(total))
    for b in BASES:
        expected = expected * F.pow(F.lit(sums[b] / bases), k - F.length(F.replace(F.col("kmer"), F.lit(b), F.lit(""))))
    least = max(20, scanned // 100_000)
    out = counted.filter(F.col("count") >= least).select("kmer", "count", expected.alias("expected"), (F.col("count") / expected).alias("ratio"), "mean_position", (F.col("in_reads") / F.lit(scanned)).alias("read_fraction"))
    return out.orderBy(F.desc(F.round("ratio", 9)), "kmer").limit(top)


STRONG_RATIO, STRONG_SHARE, STRONG_KMERS = 5.0, 0.01, 10
STITCH_SHARE, STITCH_STEPS = 0.5, 120


def strong_kmers(enriched: DataFrame, top: int = STRONG_KMERS) -> DataFrame:
    """The k-mers of a synthetic sequence: five times what chance gives and in a hundredth of the reads."""
    return enriched.filter((F.col("ratio") >= STRONG_RATIO) & (F.col("read_fraction") >= STRONG_SHARE)).orderBy(F.desc(F.round("ratio", 9)), "kmer").limit(top)


def stitched(kmers: list[tuple[str, int]]) -> str:
    """The sequence that overlapping k-mers (with counts, strongest first) come from, followed both ways from the strongest; empty if nothing joins.

    A walk ends where counts fall below half of the first one's. The list has ``TOP_KMERS`` entries at most.
    """
    if not kmers:
        return ""
    counts, seed = dict(kmers), kmers[0][0]
    k, least = len(seed), STITCH_SHARE * kmers[0][1]

    def walk(forward: bool) -> str:
        at, met, out = seed, {seed}, ""
        for _ in range(STITCH_STEPS):
            inner = at[1:] if forward else at[:-1]
            next_ = [m for m, n in counts.items() if n >= least and m not in met and (m[:-1] if forward else m[1:]) == inner]
            if not next_:
                break
            at = max(next_, key=lambda m: counts[m])
            met.add(at)
            out += at[-1] if forward else at[0]
        return out

    whole = walk(False)[::-1] + seed + walk(True)
    return whole if len(whole) > k else ""
