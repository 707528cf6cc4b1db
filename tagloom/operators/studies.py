"""Questions asked of finished tables: accuracy against truth, quality floors, spike-ins, artifacts, titrations, callers, nulls."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import genome_equivalents, hamming, poisson_interval, poisson_tail, reverse_complement
from ..storage import written
from .neighbours import Side, census, pair_counts

KEEP_RATIO = 0.5


def truth_by_name(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(name, t, f): true and found group of each read that both tables name."""
    return truth.select("name", F.col("molecule").alias("t")).join(predicted.select("name", F.col("molecule").alias("f")), "name")


def correction_accuracy(reads: DataFrame, merged: DataFrame, key: str = "umi", true: str = "umi_true") -> DataFrame:
    """(sample_id, children, merged, recall, reachable, recall_of_reachable, precision, molecules_kept).

    A barcode is a child if no read that carries it has it as its true barcode. A child
    is reachable if one of its true barcodes was seen. A merge is right if a child went
    to one of its true barcodes.
    """
    pairs = reads.filter(F.length(key) > 0).select("sample_id", F.col(key).alias("k"), F.col(true).alias("t")).distinct()
    seen = pairs.select("sample_id", F.col("k").alias("t")).distinct().withColumn("_seen", F.lit(1))
    per = pairs.join(seen, ["sample_id", "t"], "left").groupBy("sample_id", "k").agg(F.max((F.col("k") == F.col("t")).cast("int")).alias("real"), F.max(F.coalesce("_seen", F.lit(0))).alias("reach"))
    moved = merged.select("sample_id", F.col("child").alias("k"), "root")
    right = moved.join(pairs, ["sample_id", "k"]).groupBy("sample_id", "k").agg(F.max((F.col("root") == F.col("t")).cast("int")).alias("right"))
    both = per.join(right, ["sample_id", "k"], "left")
    child, gone = F.col("real") == 0, F.col("right").isNotNull()
    n = both.groupBy("sample_id").agg(
        F.count_if(child).alias("children"), F.count_if(gone).alias("merged"), F.count_if(child & (F.col("right") == 1)).alias("_right"),
        F.count_if(child & (F.col("reach") == 1)).alias("_reach"), F.count_if(~child).alias("_real"), F.count_if(~child & ~gone).alias("_kept"),
    )

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return n.select("sample_id", "children", "merged", share("_right", "children").alias("recall"), share("_reach", "children").alias("reachable"), share("_right", "_reach").alias("recall_of_reachable"), share("_right", "merged").alias("precision"), share("_kept", "_real").alias("molecules_kept"))


def majority(reads: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, reads, position, base): the commonest base of each position up to the shortest read, N where two are as common."""
    seen = reads.groupBy(*keys, "seq").agg(F.count("*").alias("n"))  # most reads of a molecule are alike
    molecules = seen.groupBy(*keys).agg(F.collect_list(F.struct("seq", "n")).alias("_v"), F.sum("n").alias("reads"), F.min(F.length("seq")).alias("_w")).filter("_w > 0")
    places = molecules.select(*keys, "reads", "_v", F.explode(F.sequence(F.lit(1), F.col("_w"))).alias("position"))

    def letter(x: Column) -> Column:
        return F.substring(x["seq"], F.col("position"), F.lit(1))

    letters = F.array_distinct(F.transform("_v", letter))
    votes = F.transform("_l", lambda b: F.aggregate("_v", F.lit(0).cast("long"), lambda s, x: s + F.when(letter(x).eqNullSafe(b), x["n"]).otherwise(0)))
    top = F.array_max("_n")
    called = F.when(F.size(F.filter("_n", lambda n: n == top)) > 1, "N").otherwise(F.element_at("_l", F.array_position("_n", top).cast("int")))
    alone = F.when(F.size("_v") == 1, letter(F.get("_v", F.lit(0))))  # whose other columns are not worked out
    base = F.coalesce(alone, F.transform(F.array(letters), lambda ls: F.when(F.size(ls) == 1, F.get(ls, F.lit(0))))[0])
    return places.withColumn("_one", base).withColumn("_l", F.when(F.col("_one").isNull(), letters)).withColumn("_n", F.when(F.col("_one").isNull(), votes)).select(*keys, "reads", "position", F.coalesce("_one", called).alias("base"))


def minor_spectrum(called: DataFrame, group: str) -> DataFrame:
    """(group, position, major, molecules, minor): per position the share of molecules without the commonest base; unresolved ones do not vote."""
    n = called.filter(F.col("base") != "N").groupBy(group, "position", "base").agg(F.count("*").alias("n"))
    return n.groupBy(group, "position").agg(F.max_by("base", F.struct("n", -F.ascii("base"))).alias("major"), F.sum("n").alias("molecules"), (1 - F.max("n") / F.sum("n")).alias("minor"))


def quality_floor(called: DataFrame, group: str, min_size: int, polymorphic: float = 0.01) -> DataFrame:
    """(group, mismatches, bases, rate, ci_lo, ci_hi): what is left of errors in molecules of ``min_size`` reads or more, at positions that do not vary."""
    steady = minor_spectrum(called, group).filter(F.col("minor") < polymorphic).select(group, "position", "major")
    sums = called.filter((F.col("base") != "N") & (F.col("reads") >= min_size)).join(steady, [group, "position"]).groupBy(group).agg(F.count_if(F.col("base") != F.col("major")).alias("mismatches"), F.count("*").alias("bases"))
    low, high = poisson_interval(F.col("mismatches"))
    return sums.select(group, "mismatches", "bases", (F.col("mismatches") / F.col("bases")).alias("rate"), (low / F.col("bases")).alias("ci_lo"), (high / F.col("bases")).alias("ci_hi"))


def junctions(reads: DataFrame, parent: str, flank: int = 12) -> DataFrame:
    """(junction, n): stretches as long as the parent that end in its last bases, or begin with them on the other strand; a read counts once, forward first."""
    size, right = len(parent), parent[-flank:]
    turned = parent[:flank][::-1].translate(str.maketrans("ACGTNacgtn", "TGCANtgcan"))

    def ending(anchor: str) -> Column:
        end = F.locate(anchor, F.col("seq")) + flank - 1  # the anchor's last base
        return F.when((F.locate(anchor, F.col("seq")) > 0) & (end >= size), F.substring(F.col("seq"), end - size + 1, F.lit(size)))

    found = F.coalesce(ending(right), reverse_complement(ending(turned)))
    return reads.select(found.alias("junction")).filter("junction IS NOT NULL").groupBy("junction").agg(F.count("*").alias("n"))


def spike_ratios(counts: DataFrame, parent: str, one: str, two: str) -> DataFrame:
    """(parent, v1, v2, err1, err1_seq, err2, err2_seq, distinct_junctions, n_at_1sub, n_at_2sub, n_at_3sub, parent_err1, v1_err1, v2_err2).

    The strongest error at one and at two substitutions from the parent, variants apart; a ratio to none is null.
    """
    j = F.col("junction")
    d = counts.withColumn("d", F.when(F.length("junction") == len(parent), hamming("junction", F.lit(parent))))
    error = ~j.isin(parent, one, two)

    def top(k: int) -> Column:
        return F.max(F.when(error & (F.col("d") == k), F.struct("n", F.col("junction").alias("s"))))

    def seen(seq: str) -> Column:
        return F.coalesce(F.sum(F.when(j == seq, F.col("n"))), F.lit(0))

    at = [F.coalesce(F.sum(F.when(F.col("d") == k, F.col("n"))), F.lit(0)).alias(f"n_at_{k}sub") for k in (1, 2, 3)]
    row = d.agg(seen(parent).alias("parent"), seen(one).alias("v1"), seen(two).alias("v2"), top(1).alias("_1"), top(2).alias("_2"), F.count("*").alias("distinct_junctions"), *at)
    row = row.select("*", F.coalesce("_1.n", F.lit(0)).alias("err1"), F.coalesce("_1.s", F.lit("")).alias("err1_seq"), F.coalesce("_2.n", F.lit(0)).alias("err2"), F.coalesce("_2.s", F.lit("")).alias("err2_seq"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    return row.select("parent", "v1", "v2", "err1", "err1_seq", "err2", "err2_seq", "distinct_junctions", "n_at_1sub", "n_at_2sub", "n_at_3sub", ratio("parent", "err1").alias("parent_err1"), ratio("v1", "err1").alias("v1_err1"), ratio("v2", "err2").alias("v2_err2"))


def allele_frequency(info: Column | str) -> Column:
    """AF of a variant record's INFO; null without one."""
    found = F.regexp_extract(F.col(info) if isinstance(info, str) else info, r"(?:^|;)AF=([0-9.eE+-]+)", 1)
    return F.when(found != "", found.try_cast("double"))


def classify_artifacts(calls: DataFrame, thresholds: list[int], keep: float = KEEP_RATIO, min_seen: int = 2) -> DataFrame:
    """(chrom, pos, ref, alt, verdict, ratio) of calls (chrom, pos, ref, alt, min_reads, vaf): real if the frequency holds as more reads are asked of a molecule.

    A variant that the lowest threshold does not show is inconclusive; one that few
    thresholds or not the highest show is an artifact with ratio 0.
    """
    order = sorted(thresholds)
    low, high = f"{order[0]}", f"{order[-1]}"
    wide = calls.filter(F.col("min_reads").isin(order)).groupBy("chrom", "pos", "ref", "alt").pivot("min_reads", order).agg(F.max("vaf"))
    seen = sum((F.col(f"`{t}`").isNotNull().cast("int") for t in order), F.lit(0))
    ratio = F.when(F.col(f"`{low}`").isNull(), None).when((seen < min_seen) | F.col(f"`{high}`").isNull(), 0.0).when(F.col(f"`{low}`") == 0, float("inf")).otherwise(F.col(f"`{high}`") / F.col(f"`{low}`"))
    verdict = F.when(F.col(f"`{low}`").isNull(), "inconclusive").when(ratio >= keep, "real").otherwise("artifact")
    return wide.select("chrom", "pos", "ref", "alt", verdict.alias("verdict"), ratio.cast("double").alias("ratio"))


def amplicons(consensus: DataFrame, group: str, prefix: int = 20, least: float = 0.05) -> DataFrame:
    """(group, molecules, amplicons, share): prefixes that a twentieth of the molecules or more begin with, and the share of molecules these make."""
    n = consensus.groupBy(group, F.substring("seq", 1, prefix).alias("p")).agg(F.count("*").alias("n"))
    n = n.withColumn("_all", F.sum("n").over(Window.partitionBy(group)))
    kept = F.col("n") / F.col("_all") >= least
    return n.groupBy(group).agg(F.max("_all").alias("molecules"), F.count_if(kept).alias("amplicons"), (F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)) / F.max("_all")).alias("share"))


def titration(runs: DataFrame, needed: int = 3) -> DataFrame:
    """``runs`` (molecules, vaf, input_ng) with genome_equivalents, variant_molecules and p_enough, the chance of ``needed`` variant molecules or more."""
    mean = F.col("molecules") * F.col("vaf")
    return runs.withColumns({"genome_equivalents": genome_equivalents("input_ng"), "variant_molecules": mean, "p_enough": F.when(F.col("vaf").isNotNull(), poisson_tail(F.lit(needed), mean))})


def per_run_targets(design: DataFrame, molecules: DataFrame, variants: DataFrame) -> DataFrame:
    """(run, arm, targets, total, mean, weakest, strongest, weakest_over_mean, calls): a run's molecules over its targets, and its calls."""
    per = molecules.groupBy("run").agg(F.count("*").alias("targets"), F.sum("molecules").alias("total"), F.avg("molecules").alias("mean"), F.min("molecules").alias("weakest"), F.max("molecules").alias("strongest"))
    calls = variants.groupBy("run").agg(F.count("*").alias("calls"))
    return design.select("run", "arm").join(per, "run").join(calls, "run", "left").select("run", "arm", "targets", "total", "mean", "weakest", "strongest", (F.col("weakest") / F.col("mean")).alias("weakest_over_mean"), F.coalesce("calls", F.lit(0)).alias("calls"))


def call_burden(per_run: DataFrame) -> DataFrame:
    """(arm, runs, calls_per_run, least, most)."""
    return per_run.groupBy("arm").agg(F.count("*").alias("runs"), F.avg("calls").alias("calls_per_run"), F.min("calls").alias("least"), F.max("calls").alias("most"))


def hotspot(design: DataFrame, variants: DataFrame, chrom: str, pos: int) -> DataFrame:
    """(arm, runs, detected, mean_vaf): one locus in every run of an arm, 0 where it is not called."""
    at = variants.filter((F.col("chrom") == chrom) & (F.col("pos") == pos)).groupBy("run").agg(F.max("vaf").alias("vaf"))
    return design.join(at, "run", "left").groupBy("arm").agg(F.count("*").alias("runs"), F.count_if(F.col("vaf") > 0).alias("detected"), F.avg(F.coalesce("vaf", F.lit(0.0))).alias("mean_vaf"))


def substitution_spectrum(design: DataFrame, variants: DataFrame, arm: str) -> DataFrame:
    """(ref, alt, calls, share) among the calls of one arm."""
    some = variants.join(design.filter(F.col("arm") == arm).select("run"), "run", "left_semi")
    n = some.groupBy("ref", "alt").agg(F.count("*").alias("calls"))
    return n.withColumn("share", F.col("calls") / F.sum("calls").over(Window.partitionBy(F.lit(1))))  # a row per pair of bases


def recurring(design: DataFrame, variants: DataFrame, arm: str) -> DataFrame:
    """(chrom, pos, ref, alt, runs): calls of half of an arm's runs, and of two at least."""
    runs = design.filter(F.col("arm") == arm).select("run")
    some = variants.join(runs, "run", "left_semi").groupBy("chrom", "pos", "ref", "alt").agg(F.count_distinct("run").alias("runs"))
    n = runs.agg(F.greatest(F.lit(2), F.floor(F.count("*") / 2)).alias("_least"))
    return some.join(n, F.col("runs") >= F.col("_least")).drop("_least")  # beside one row


def caller_table(calls: DataFrame, chrom: str, pos: int) -> DataFrame:
    """(pipeline, caller, mapq, min_reads, arm, runs, calls_per_run, substitutions_per_run, hotspot_detected, hotspot_vaf_mean, median_depth) of calls (..., run, chrom, pos, ref, alt, vaf, depth).

    The depth is the upper median over calls; the hotspot's frequency is the mean over the runs that show it.
    """
    key = ["pipeline", "caller", "mapq", "min_reads", "arm"]
    here = (F.col("chrom") == chrom) & (F.col("pos") == pos)
    per_run = calls.groupBy(*key, "run").agg(F.count("*").alias("n"), F.count_if((F.length("ref") == 1) & (F.length("alt") == 1)).alias("s"), F.max(F.when(here, F.col("vaf"))).alias("h"))
    out = per_run.groupBy(*key).agg(F.count("*").alias("runs"), F.avg("n").alias("calls_per_run"), F.avg("s").alias("substitutions_per_run"), F.count_if(F.col("h") > 0).alias("hotspot_detected"), F.coalesce(F.avg(F.when(F.col("h") > 0, F.col("h"))), F.lit(0.0)).alias("hotspot_vaf_mean"))
    depth = calls.groupBy(*key, "depth").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = depth.select("*", F.sum("n").over(up).alias("to"), F.sum("n").over(Window.partitionBy(*key)).alias("all"))
    middle = depth.groupBy(*key).agg(F.min(F.when(F.col("to") > F.floor(F.col("all") / 2), F.col("depth"))).alias("median_depth"))
    return out.join(middle, key).select(*key, "runs", "calls_per_run", "substitutions_per_run", "hotspot_detected", "hotspot_vaf_mean", "median_depth")


def kmer_coverage(contigs: DataFrame, molecules: DataFrame, k: int = 21) -> DataFrame:
    """(cell, contig, kmers, covered, share): distinct k-mers of a contig that some molecule of its cell has.

    Sequences that are alike in a cell are cut into k-mers once. A contig of one sequence has that
    sequence's sums; only contigs of several meet k-mer by k-mer.
    """

    def mers(df: DataFrame, *keep: str) -> DataFrame:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length("seq") - (k - 1), F.lit(0))), lambda i: i > 0)
        return df.select("cell", *keep, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("seq"), i, F.lit(k))))).alias("kmer"))

    def sums(of: DataFrame, *keys: str) -> DataFrame:
        return mers(of, *keys).distinct().join(have, ["cell", "kmer"], "left").groupBy("cell", *keys).agg(F.count("*").alias("kmers"), F.count("_in").alias("covered"))

    have = written(mers(molecules.select("cell", "seq").distinct()).distinct().withColumn("_in", F.lit(1)), "kmers")
    count = F.count("*").over(Window.partitionBy("cell", "contig"))
    parts = written(contigs.select("cell", "contig", "seq").distinct().withColumn("_alone", (count == 1) & F.col("cell").isNotNull()), "contigs")
    alone = parts.filter("_alone")
    one = alone.join(sums(alone.select("cell", "seq").distinct(), "seq"), ["cell", "seq"]).select("cell", "contig", "kmers", "covered")
    n = one.unionByName(sums(parts.filter("NOT _alone"), "contig"))
    return n.withColumn("share", F.col("covered") / F.col("kmers"))


def run_label(label: Column | str) -> Column:
    """struct(input_ng, depth, replicate) of a label such as ``WT_20ng_30x_rep2``; null where a part is not there."""
    c = F.col(label) if isinstance(label, str) else label

    def number(pattern: str, kind: str) -> Column:
        found = F.regexp_extract(c, pattern, 1)
        return F.when(found != "", found.try_cast(kind))

    return F.struct(number(r"(?i)(\d+(?:\.\d+)?)\s*ng", "double").alias("input_ng"), number(r"(?i)(\d+(?:\.\d+)?)x(?:_|$)", "double").alias("depth"), number(r"(?i)rep(?:licate)?[_-]?(\d+)", "int").alias("replicate"))


TOGETHER = 1024  # reads placed at a time


def best_places(seqs: list[str], reference: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strand, offset, mismatches) of each sequence, None where it is empty or longer than the reference."""
    ref, turn = np.frombuffer(reference.encode(), np.uint8), str.maketrans("ACGTN", "TGCAN")
    out = np.full((3, len(seqs)), None, object)
    for strand, texts in (("+", [s.encode() for s in seqs]), ("-", [s[::-1].translate(turn).encode() for s in seqs])):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for size in np.unique(sizes[(sizes > 0) & (sizes <= len(ref))]).tolist():
            windows, rows = np.lib.stride_tricks.sliding_window_view(ref, size), np.flatnonzero(sizes == size)
            for some in np.split(rows, range(TOGETHER, len(rows), TOGETHER)):
                letters = np.frombuffer(b"".join([texts[i] for i in some]), np.uint8).reshape(len(some), 1, size)
                off = (letters != windows).sum(axis=2)
                at = off.argmin(axis=1)
                least = off[np.arange(len(some)), at]
                better = np.array([out[2, i] is None or n < out[2, i] for i, n in zip(some, least.tolist())], bool)
                out[:, some[better]] = np.array([[strand] * int(better.sum()), at[better].tolist(), least[better].tolist()], object)
    return out[0], out[1], out[2]


def placed(reads: DataFrame, reference: str) -> DataFrame:
    """``reads`` with strand, offset and mismatches of their best ungapped place on a short reference; ties to the forward strand, then the smaller offset."""
    @F.pandas_udf("struct<strand:string,offset:int,mismatches:int>")
    def best(seqs: pd.Series) -> pd.DataFrame:
        which, known = pd.factorize(seqs)  # equal reads are placed once; -1: null
        strand, offset, mismatches = best_places([*known, ""], reference)
        return pd.DataFrame({"strand": strand[which], "offset": pd.array(offset[which], "Int32"), "mismatches": pd.array(mismatches[which], "Int32")})

    return reads.withColumn("_p", best("seq")).select("*", "_p.strand", "_p.offset", "_p.mismatches").drop("_p")


PIECE = 256  # ranks that are put together at a time


def column_shuffled(barcodes: DataFrame, seed: int, columns: int | None = None) -> DataFrame:
    """(sample_id, key): barcodes whose columns are shuffled against each other: what independent positions would give.

    Each column's letters are put in an order of hashes, of which ranges are sorted apart; from there on they go as
    strings, cut at every ``PIECE`` ranks, where columns meet. ``columns``: so many of the first.
    """
    rows = barcodes.select("sample_id", "key")
    last = F.length("key") if columns is None else F.least(F.length("key"), F.lit(columns))
    letters = rows.filter(F.length("key") > 0).select("sample_id", "key", F.explode(F.sequence(F.lit(0), last - 1)).alias("at"))
    letters = letters.select("sample_id", "at", F.substring(F.col("key"), F.col("at") + 1, F.lit(1)).alias("base"), F.xxhash64(F.lit(seed), "at", "key").alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("h", "base")))
    ranges = letters.groupBy("sample_id", "at", F.shiftrightunsigned("h", 52).alias("_r")).agg(F.array_join(F.transform(ordered, lambda x: x["base"]), "").alias("s"))
    ranges = written(ranges, "ranges")
    before = F.sum("n").over(Window.partitionBy("sample_id", "at").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))  # 4,096 rows a column at most
    sizes = ranges.select("sample_id", "at", "_r", F.length("s").alias("n")).select("sample_id", "at", "_r", F.coalesce(before, F.lit(0)).alias("_b"))
    placed_ = ranges.join(sizes, ["sample_id", "at", "_r"]).withColumn("p", F.explode(F.sequence(F.floor(F.col("_b") / PIECE), F.floor((F.col("_b") + F.length("s") - 1) / PIECE))))
    first = F.greatest(F.col("p") * PIECE, F.col("_b"))
    cut = F.substring(F.col("s"), (first - F.col("_b") + 1).cast("int"), ((F.col("p") + 1) * PIECE - first).cast("int"))
    pieces = placed_.select("sample_id", "p", "at", first.alias("first"), cut.alias("s")).groupBy("sample_id", "p", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda x: x["s"]), "").alias("s"))
    whole = pieces.groupBy("sample_id", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("m"))
    whole = whole.select("sample_id", "m", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("m", F.length)))).alias("i"))
    return whole.select("sample_id", F.array_join(F.transform("m", lambda s: F.substring(s, F.col("i"), F.lit(1))), "").alias("key"))


def _divergence(keys: DataFrame) -> DataFrame:
    """(sample_id, js): Jensen-Shannon divergence, in bits, of first k-mers from the product of their columns; k = 4."""
    head = keys.select("sample_id", F.substring("key", 1, 4).alias("k"))
    n = written(head.groupBy("sample_id", "k").agg(F.count("*").alias("n")), "words")
    whole = Window.partitionBy("sample_id")
    columns = n.select("sample_id", "n", F.posexplode(F.split("k", "")).alias("at", "b")).groupBy("sample_id", "at", "b").agg(F.sum("n").alias("c"))
    columns = columns.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("sample_id", "at")))
    side = columns.groupBy("sample_id", "at").agg(F.map_from_entries(F.collect_list(F.struct("b", "share"))).alias("m")).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("m"))
    every = F.explode(F.expr("transform(sequence(0, 255), i -> concat(substring('ACGT', i % 4 + 1, 1), substring('ACGT', i div 4 % 4 + 1, 1), substring('ACGT', i div 16 % 4 + 1, 1), substring('ACGT', i div 64 + 1, 1)))"))
    cells = side.select("sample_id", "m", every.alias("k"))
    q = F.lit(1.0)
    for i in range(4):
        q = q * F.coalesce(F.col("m")[F.lit(i)][F.substring(F.col("k"), F.lit(i + 1), F.lit(1))], F.lit(0.0))
    cells = cells.join(n.withColumn("p", F.col("n") / F.sum("n").over(whole)), ["sample_id", "k"], "left").select("sample_id", F.coalesce("p", F.lit(0.0)).alias("p"), q.alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    part = F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / mid)).otherwise(0.0) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / mid)).otherwise(0.0)
    return cells.groupBy("sample_id").agg((F.sum(part) / 2).alias("js"))


def divergence_null(barcodes: DataFrame, shuffles: int = 5) -> DataFrame:
    """(sample_id, js, null_mean, null_sd, z): the barcodes' divergence from independent columns against that of shuffled columns."""
    from functools import reduce

    null = reduce(DataFrame.unionByName, [_divergence(column_shuffled(barcodes, s, 4)) for s in range(shuffles)])
    stats = null.groupBy("sample_id").agg(F.avg("js").alias("null_mean"), F.stddev_samp("js").alias("null_sd"))
    return _divergence(barcodes).join(stats, "sample_id").select("sample_id", "js", "null_mean", "null_sd", F.when(F.col("null_sd") > 0, (F.col("js") - F.col("null_mean")) / F.col("null_sd")).alias("z"))


def counts_dealt_anew(barcodes: DataFrame, seed: int) -> DataFrame:
    """(sample_id, key, cnt): every barcode with another's count, as in ``dealt_beside``."""
    return dealt_beside(barcodes.select("sample_id", "key", "cnt"), seed).select("sample_id", "key", F.col(f"dealt_{seed}").alias("cnt"))


def dealt_beside(barcodes: DataFrame, *seeds: int) -> DataFrame:
    """``barcodes`` with a column ``dealt_<seed>`` a seed: the count of the next barcode of the sample in an order of hashes, for the last the first's.

    An exact permutation of the counts. Ranges of hashes are gone through apart; the first count of each is handed to the range before it.
    """
    out = barcodes
    order = Window.partitionBy("sample_id").orderBy("_r")  # 4,096 rows a sample at most
    after = F.coalesce(F.lead("first", 1).over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    for seed in seeds:
        h = F.xxhash64(F.lit(seed), "key")
        r = F.shiftrightunsigned("_h", 52)
        within = F.lead("cnt", 1).over(Window.partitionBy("sample_id", "_r").orderBy("_h", "key"))
        ranges = barcodes.select("sample_id", "key", "cnt", h.alias("_h")).groupBy("sample_id", r.alias("_r")).agg(F.min_by("cnt", F.struct("_h", "key")).alias("first"))
        out = out.withColumn("_h", h).withColumn("_r", r).withColumn("_n", within).join(ranges.select("sample_id", "_r", after.alias("_after")), ["sample_id", "_r"])
        out = out.withColumn(f"dealt_{seed}", F.coalesce("_n", "_after")).drop("_h", "_r", "_n", "_after")
    return out


def _apart(name: str, times: int) -> Callable[[Side, Side], np.ndarray]:
    """Pairs whose counts in a column are so many times apart or more."""
    return lambda a, b: np.maximum(a[name], b[name]) >= times * np.minimum(a[name], b[name])


def neighbour_null(barcodes: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_id, pairs, chance_pairs, ratio_pairs, permuted_ratio_pairs): distance-one pairs seen and in shuffled columns; pairs with counts twice apart or more, seen and with the counts dealt anew."""
    dealt = dealt_beside(barcodes.select("sample_id", "key", "cnt"), seed)
    seen = pair_counts(dealt, "cnt", f"dealt_{seed}", ratio_pairs=_apart("cnt", 2), permuted_ratio_pairs=_apart(f"dealt_{seed}", 2))
    chance = census(column_shuffled(barcodes, seed).distinct()).withColumnRenamed("pairs", "chance_pairs")
    rows = barcodes.select("sample_id").distinct().join(seen, "sample_id", "left").join(chance, "sample_id", "left")
    return rows.select("sample_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("pairs", "chance_pairs", "ratio_pairs", "permuted_ratio_pairs")))


RATIOS = (2, 3, 5, 10, 20)


def count_ratios(barcodes: DataFrame, ratios: tuple[int, ...] = RATIOS, shuffles: int = 5) -> DataFrame:
    """(sample_id, ratio, pairs, observed, null_mean, null_sd, excess, z): distance-one pairs whose counts are so many times apart or more, against the same pairs with the counts dealt anew.

    The graph stays; only the link between a barcode and its count goes. Excess pairs are parents and their errors.
    All dealings go with a barcode to where its pairs are counted, so no pair is kept.
    """
    names = ("cnt", *(f"dealt_{seed}" for seed in range(shuffles)))
    dealt = dealt_beside(barcodes.select("sample_id", "key", "cnt"), *range(shuffles))
    counts = written(pair_counts(dealt, *names, **{f"{c}_{r}": _apart(c, r) for c in names for r in ratios}), "tallies")
    listed = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(f"cnt_{r}").alias("n"), F.array(*(F.col(f"{c}_{r}") for c in names[1:])).alias("null")) for r in ratios)))
    rows = counts.select("sample_id", "pairs", listed.alias("t")).select("sample_id", "pairs", "t.*")
    null = rows.select("sample_id", "ratio", F.explode("null").alias("n")).groupBy("sample_id", "ratio").agg(F.avg("n").alias("null_mean"), F.stddev_samp("n").alias("null_sd"))
    excess = F.col("n") - F.col("null_mean")
    return rows.join(null, ["sample_id", "ratio"]).select("sample_id", "ratio", "pairs", F.col("n").alias("observed"), "null_mean", "null_sd", excess.alias("excess"), F.when(F.col("null_sd") > 0, excess / F.col("null_sd")).alias("z"))


MAX_WIDTH = 8


def independence_by_width(barcodes: DataFrame) -> DataFrame:
    """(sample_id, k, windows, log10_excess, slope): the collision of k adjacent positions of distinct barcodes against the product of each position's, by unbiased estimates, averaged over windows.

    Widths go as far as a sample has a hundred barcodes for each word of one more. ``slope`` is the mean excess
    an added position brings. Words are counted in tasks before they move.
    """
    n = barcodes.groupBy("sample_id").agg(F.count("*").alias("n"), F.min(F.length("key")).alias("l"))
    most = F.least(F.greatest(F.floor(F.log(F.col("n") / 100 + 1e-9) / math.log(4)), F.lit(1)), F.col("l"), F.lit(MAX_WIDTH)).cast("int")
    rows = barcodes.select("sample_id", "key").join(F.broadcast(n.select("sample_id", "l", most.alias("most"))), "sample_id")  # a row per sample
    windows = F.flatten(F.transform(F.sequence(F.lit(1), "most"), lambda k: F.transform(F.sequence(F.lit(1), F.col("l") - k + 1), lambda j: F.struct(k.alias("k"), j.alias("j")))))
    words = rows.select("sample_id", "key", F.explode(windows).alias("w")).groupBy("sample_id", "w.k", "w.j", F.substring(F.col("key"), F.col("w.j"), F.col("w.k")).alias("word")).agg(F.count("*").alias("c"))
    c = F.col("c").cast("double")
    seen = words.groupBy("sample_id", "k", "j").agg((F.sum(c * (c - 1)) / (F.sum(c) * (F.sum(c) - 1))).alias("p"))
    single = seen.filter("k = 1").select("sample_id", F.col("j").alias("at"), F.col("p").alias("q"))
    product = seen.join(single, "sample_id").filter((F.col("at") >= F.col("j")) & (F.col("at") < F.col("j") + F.col("k"))).groupBy("sample_id", "k", "j", "p").agg(F.sum(F.log10(F.when(F.col("q") > 0, F.col("q")))).alias("log"), F.min("q").alias("least"))
    usable = product.filter((F.col("p") > 0) & (F.col("least") > 0))
    rates = usable.groupBy("sample_id", "k").agg(F.count("*").alias("windows"), F.avg(F.log10("p") - F.col("log")).alias("log10_excess"))
    whole = Window.partitionBy("sample_id")
    slope = F.coalesce(F.avg(F.when(F.col("k") > 1, F.col("log10_excess") / (F.col("k") - 1))).over(whole), F.lit(0.0))
    return rates.select("sample_id", "k", "windows", "log10_excess", slope.alias("slope"))


def template_clusters(reads: DataFrame, keys: tuple[str, ...] = ("sample_id", "umi"), divergence: float = 0.05, min_share: float = 0.2, min_reads: int = 4) -> DataFrame:
    """(keys, reads, templates, first): molecules of ``min_reads`` reads or more, and how many templates hold ``min_share`` of their reads.

    Reads join the first leader, in order of src_index, from which at most ``divergence`` of the
    positions both have differ, or lead themselves. ``first`` is the first read. Equal reads are
    counted before they move: one row and their number comes to a molecule's task, where the first of them stands.
    """
    from .consensus import by_molecule

    seq = F.coalesce("seq", F.lit(""))
    alike = reads.groupBy(*keys, seq.alias("seq")).agg(F.count("*").cast("string").alias("qual"), F.min("src_index").alias("src_index"))

    def run(seqs, counts, starts):
        which, out = [], []
        for g, (start, end) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(seqs)])):
            n = np.array(counts[start:end]).astype(np.int64)  # what stands for the qualities
            reads = int(n.sum())
            if reads >= min_reads:
                sizes = leaders(seqs[start:end], divergence, n)
                which.append(g)
                out.append((reads, sum(n >= min_share * reads for n in sizes), seqs[start].decode()))
        return which, [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int32(), pa.string()))]

    return by_molecule(alike, keys, run, "reads long, templates int, first string")


def leaders(seqs: list[bytes], divergence: float, counts: np.ndarray | None = None) -> list[int]:
    """Reads of each greedy cluster, by its leader in order. Equal reads are compared once, where the first of them stands; ``counts``: how many each one is."""
    numbers: dict[bytes, int] = {}  # in order of first reads
    for s, c in zip(seqs, counts.tolist() if counts is not None else [1] * len(seqs)):
        numbers[s] = numbers.get(s, 0) + c
    seqs, n = list(numbers), np.fromiter(numbers.values(), np.int64, len(numbers))
    lengths = np.array([len(s) for s in seqs])
    width = int(lengths.max(initial=0))
    letters = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in seqs), np.uint8).reshape(len(seqs), width)
    left, out = np.arange(len(seqs)), []
    while len(left):
        lead = letters[left[0]]
        differ = ((letters[left] != lead) & (letters[left] != 0) & (lead != 0)).sum(axis=1)
        apart = differ > divergence * np.minimum(lengths[left], lengths[left[0]])
        out.append(int(n[left[~apart]].sum()))
        left = left[apart]
    return out


TRIALS = 20_000


def template_collisions(clusters: DataFrame, space: DataFrame, divergence: float = 0.05, trials: int = TRIALS) -> DataFrame:
    """(sample_id, groups, split, observed, trials, detectable, corrected, expected, ratio) of ``template_clusters``.

    Only molecules of different templates are seen to collide: ``detectable`` is the share of random pairs of
    groups that differ (neighbours in an order of hashes, ``trials`` of them at most), and ``corrected``
    is what is observed over that. ``expected`` is the birthday's share of barcodes with two molecules.
    """
    clusters = written(clusters.select("sample_id", "umi", "templates", "first"), "clusters")  # a row a molecule, read twice
    n = clusters.groupBy("sample_id").agg(F.count("*").alias("groups"), F.count_if(F.col("templates") > 1).alias("split"))
    share = F.least(F.lit(1.0), 1.5 * (trials + 1) / F.col("groups"))
    h = F.xxhash64("umi")
    drawn = clusters.select("sample_id", "umi", "first", h.alias("h")).join(F.broadcast(n.select("sample_id", "groups")), "sample_id").filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))  # a row per sample
    order = Window.partitionBy("sample_id").orderBy("h", "umi")  # of 1.5 times the trials at most, about
    pairs = drawn.select("sample_id", "first", F.lead("first", 1).over(order).alias("other"), F.row_number().over(order).alias("i")).filter((F.col("i") <= trials) & F.col("other").isNotNull())
    both = F.least(F.length("first"), F.length("other"))
    unlike = F.size(F.filter(F.sequence(F.lit(0), both), lambda i: (i > 0) & (F.substring(F.col("first"), i, F.lit(1)) != F.substring(F.col("other"), i, F.lit(1)))))
    tried = pairs.groupBy("sample_id").agg(F.count("*").alias("trials"), F.avg((unlike > divergence * both).cast("double")).alias("detectable"))
    rate = F.col("lambda")
    chance = F.when(rate > 0, (1 - F.exp(-rate) - rate * F.exp(-rate)) / (1 - F.exp(-rate))).otherwise(0.0)
    observed = F.col("split") / F.col("groups")
    corrected = F.when(F.col("detectable") > 0, observed / F.col("detectable"))
    out = n.join(tried, "sample_id", "left").join(space.select("sample_id", "lambda"), "sample_id")
    return out.select("sample_id", "groups", "split", observed.alias("observed"), F.coalesce("trials", F.lit(0)).alias("trials"), F.coalesce("detectable", F.lit(0.0)).alias("detectable"), corrected.alias("corrected"), chance.alias("expected"), F.when(chance > 0, corrected / chance).alias("ratio"))


def collisions(molecules: DataFrame, space: DataFrame) -> DataFrame:
    """(sample_id, groups, mixed, observed, expected) of (sample_id, umi, template, reads): barcodes under which a second template has a fifth of the reads or more, against the birthday's share."""
    share = F.col("reads") / F.sum("reads").over(Window.partitionBy("sample_id", "umi"))
    per = molecules.withColumn("_s", share).groupBy("sample_id", "umi").agg(F.count_if(F.col("_s") >= 0.2).alias("t"))
    n = per.groupBy("sample_id").agg(F.count("*").alias("groups"), F.count_if(F.col("t") > 1).alias("mixed"))
    rate = F.col("lambda")
    chance = F.when(rate > 0, 1 - rate * F.exp(-rate) / (1 - F.exp(-rate))).otherwise(0.0)
    return n.join(space.select("sample_id", "lambda"), "sample_id").select("sample_id", "groups", "mixed", (F.col("mixed") / F.col("groups")).alias("observed"), chance.alias("expected"))


def split_power(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(depth_bin, mixed, split, power): of groups that hold two true molecules, how many were split, by power of two of their reads; (sample_id, umi) are the keys."""
    from ..functions.bases import size_bin

    found = records.groupBy("sample_id", "umi").agg(F.sum("reads").alias("reads"), F.max("molecule").alias("parts"))
    mixed = truth.groupBy("sample_id", "umi").agg(F.count_distinct("molecule").alias("true_parts")).filter("true_parts > 1")
    n = found.join(mixed, ["sample_id", "umi"]).groupBy(size_bin("reads").alias("depth_bin")).agg(F.count("*").alias("mixed"), F.count_if(F.col("parts") > 1).alias("split"))
    return n.withColumn("power", F.col("split") / F.col("mixed"))


def limits_of_detection(targets: DataFrame, needed: int = 2, floor: float = 1e-4, power: float = 0.95) -> DataFrame:
    """``targets`` (molecules) with background, the molecules a floor error of one base in three turns, and lod, the allele fraction at which ``needed`` variant molecules are seen with the given power; null without molecules.

    The mean number of variant molecules that it takes is the same for all, found by halving.
    """
    import math

    low, high = 0.0, 100.0 * needed
    for _ in range(100):
        mean = (low + high) / 2
        seen = 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(needed))
        low, high = (mean, high) if seen < power else (low, mean)
    share = F.lit(high) / F.col("molecules")
    return targets.withColumns({"background": F.col("molecules") * F.lit(floor / 3), "lod": F.when(F.col("molecules") > 0, F.least(share, F.lit(1.0)))})


def pooled_limits(targets: DataFrame, by: str, needed: int = 2, floor: float = 1e-4, power: float = 0.95) -> DataFrame:
    """(by, sites, molecules, lod, background, pooled_molecules, lod_pooled, background_pooled): limits at the mean site, and over all sites together, where evidence adds up."""
    sums = targets.groupBy(by).agg(F.count("*").alias("sites"), F.avg("molecules").alias("molecules"), F.sum("molecules").alias("pooled"))
    one = limits_of_detection(sums, needed, floor, power)
    pooled = limits_of_detection(one.select(by, "sites", F.col("molecules").alias("_m"), F.col("lod").alias("_l"), F.col("background").alias("_b"), F.col("pooled").alias("molecules")), needed, floor, power)
    return pooled.select(by, "sites", F.col("_m").alias("molecules"), F.col("_l").alias("lod"), F.col("_b").alias("background"), F.col("molecules").alias("pooled_molecules"), F.col("lod").alias("lod_pooled"), F.col("background").alias("background_pooled"))


def read_starts(blocks: DataFrame) -> DataFrame:
    """(grp, reads, starts, range, coterminal): distinct starts of a group's reads, how far apart, and whether all end or begin at one place."""
    n = blocks.groupBy("grp").agg(F.count("*").alias("reads"), F.count_distinct("start").alias("starts"), (F.max("start") - F.min("start")).alias("range"), F.count_distinct("end").alias("_ends"))
    return n.select("grp", "reads", "starts", "range", ((F.col("starts") == 1) | (F.col("_ends") == 1)).alias("coterminal"))
