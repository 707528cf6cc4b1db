"""Folding miscopied barcodes into the barcodes they came from.

A barcode may be the child of a neighbour at distance one. Its posterior weighs
an error (a Poisson number of miscopied reads, or a polymerase error with the
heavy tail of a branching process) against another molecule that happens to sit
there with that many reads. Where both carry payloads, their agreement multiplies
the error's likelihood. Each child takes its best parent, if good enough. A parent
has more reads than its child, or as many and the smaller key, so the choices form
a forest: roots come from pointer doubling over merged barcodes only.

Everything is keyed by sample; statistics of a sample (number, collision, sizes,
clonality) are small tables joined by sample or by count.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import comparable, error_of, folded, hamming, phred, plain, planes, planes_comparable, planes_compared, planes_hamming, tags
from ..storage import written
from .barcodes import composition, information
from .neighbours import Side, neighbour_pairs

PAYLOAD_WIDTH = 32
MIN_COMPARED = 8
SAMPLE_KEPT = 8192
TRIES = 20_000
SAME_SHARE = 0.05
#: The walk's multiplier, its stride's divisor and the period of its steps.
WALK = (7919, 977, 97)


@dataclass(frozen=True)
class Correction:
    error: float | None = None  # the barcodes' own rate per base; None: as estimated for the sample
    polymerase: float = 1e-5
    cycles: int = 25
    max_child_share: float = 0.5
    min_posterior: float = 0.95
    payload_error: float = 2e-3
    floor_error: float = 1e-4


def evidence(reads: DataFrame, key: str = "umi", quality: str = "umi_qual", payload: str = "seq") -> DataFrame:
    """(sample_id, key, cnt, pos_err, payload): mean error of each position, first read's payload draft."""
    rows = reads.filter(F.length(key) > 0).select("sample_id", "src_index", folded(key).alias("key"), F.col(quality).alias("q"), F.substring(payload, 1, PAYLOAD_WIDTH).alias("draft"))
    length = rows.select(F.max(F.length("key"))).first()[0] or 0

    def error(i: int) -> Column:
        return F.when(F.length("key") >= i, F.when(F.length("q") >= i, error_of(phred("q", F.lit(i)))).otherwise(0.0))

    means = F.array(*[F.avg(error(i)) for i in range(1, length + 1)]) if length else F.array().cast("array<double>")
    draft = F.min_by("draft", F.when(F.length("draft") > 0, F.col("src_index")))
    return rows.groupBy("sample_id", "key").agg(F.count("*").alias("cnt"), means.alias("pos_err"), F.coalesce(draft, F.lit("")).alias("payload"))


def clonality(barcodes: DataFrame) -> DataFrame:
    """(sample_id, clonality): how often unrelated barcodes carry the same payload.

    A fixed walk over every 2^k-th barcode in key order, at most ``SAMPLE_KEPT`` of
    them; k depends on the number of barcodes alone. Ranks are taken within key
    prefixes and offset, so no task orders all barcodes.
    """
    numbered = _ranked(barcodes.select("sample_id", "key", "payload"))
    n = barcodes.groupBy("sample_id").agg(F.count("*").alias("_n"))
    # The smallest power of two that keeps fewer than SAMPLE_KEPT.
    stride = F.expr(f"element_at(filter(transform(sequence(0, 40), i -> shiftleft(1L, i)), s -> ceil(_n / s) < {SAMPLE_KEPT}), 1)")
    kept = numbered.join(n.withColumn("_s", stride), "sample_id").filter(F.col("rank") % F.col("_s") == 0)
    kept = written(kept.select("sample_id", (F.col("rank") / F.col("_s")).cast("long").alias("i"), "payload"), "drafts")
    sizes = kept.groupBy("sample_id").agg(F.count("*").alias("m"))
    tries = sizes.select("sample_id", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(TRIES).cast("long"), F.col("m") * 4) - 1)).alias("t"))
    step = F.floor(F.col("m") / WALK[1]) + 1
    a = (F.col("t") * WALK[0]) % F.col("m")
    tries = tries.select("sample_id", "m", a.alias("a"), ((a + step * (1 + F.col("t") % WALK[2])) % F.col("m")).alias("b")).filter("a <> b AND m >= 3")
    left = kept.select("sample_id", F.col("i").alias("a"), F.col("payload").alias("x"))
    right = kept.select("sample_id", F.col("i").alias("b"), F.col("payload").alias("y"))
    both = tries.join(left, ["sample_id", "a"]).join(right, ["sample_id", "b"]).withColumn("cmp", comparable("x", "y")).filter(F.col("cmp") >= MIN_COMPARED)
    same = (hamming("x", "y") <= SAME_SHARE * F.col("cmp")).cast("long")
    share = both.groupBy("sample_id").agg((F.sum(same) / F.count("*")).alias("s"), F.count("*").alias("tried"))
    return sizes.join(share, "sample_id", "left").select("sample_id", F.coalesce(F.greatest("s", 1 / (F.col("tried") + 1)), F.lit(1.0)).alias("clonality"))


def _ranked(barcodes: DataFrame) -> DataFrame:
    """With ``rank``, from 0 in key order within the sample, by way of four-letter prefixes."""
    rows = barcodes.withColumn("_p", F.substring("key", 1, 4))
    before = F.sum("n").over(Window.partitionBy("sample_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("sample_id", "_p").agg(F.count("*").alias("n")).select("sample_id", "_p", F.coalesce(before, F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("sample_id", "_p").orderBy("key")) - 1
    return rows.withColumn("_in", inside).join(offsets, ["sample_id", "_p"]).withColumn("rank", F.col("_in") + F.col("_b")).drop("_p", "_in", "_b")


_LOG_FACTORIALS = [math.lgamma(k + 1) for k in range(PAYLOAD_WIDTH + 1)]


def _log_binomial(d: Column, n: Column, p: float) -> Column:
    table = F.array(*map(F.lit, _LOG_FACTORIALS))
    return F.get(table, n) - F.get(table, d) - F.get(table, n - d) + d * math.log(p) + (n - d) * math.log1p(-p)


_SMALL = [math.log(math.factorial(k)) for k in range(256)]


def log_factorial(n: Column) -> Column:
    """log(n!): from a table, and by Stirling's series beyond it, where that is exact to double precision."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < len(_SMALL), F.get(F.array(*map(F.lit, _SMALL)), F.least(n, F.lit(len(_SMALL) - 1)).cast("int"))).otherwise(series)


def payload_ratio(error: float) -> Callable[[int, int, float], float]:
    """How much likelier so many mismatches of so many letters are from one molecule than from two, as ``clonality`` has it; remembered, as there are few."""

    @lru_cache(1 << 16)
    def ratio(mism: int, cmp: int, clonality: float) -> float:
        if cmp < MIN_COMPARED:
            return 1.0
        ways = _LOG_FACTORIALS[cmp] - _LOG_FACTORIALS[mism] - _LOG_FACTORIALS[cmp - mism]
        same, other = (ways + mism * math.log(p) + (cmp - mism) * math.log1p(-p) for p in (error, 0.75))
        return math.exp(max(min(same - math.log(clonality * math.exp(same) + (1 - clonality) * math.exp(other) + 1e-300), 60.0), -60.0))

    return ratio


def likelihoods(error: float) -> Callable[..., Column]:
    """struct(ratio, miscopied) of mism, cmp, clonality, mean, number and log(number!).

    Parents with none and with one mismatch often differ in the last bit of their posteriors, which decides
    between them. Spark's exp and log are not those of the C library, which SQL and Python's math have.
    """

    @F.pandas_udf("struct<ratio:double,miscopied:double>")
    def both(mism: pd.Series, cmp: pd.Series, clonality: pd.Series, mean: pd.Series, c: pd.Series, log_factorial: pd.Series) -> pd.DataFrame:
        ratio = payload_ratio(error)
        ratios = [ratio(*x) for x in zip(mism.tolist(), cmp.tolist(), clonality.tolist())]
        miscopied = [math.exp(-m + n * math.log(m) - f) for m, n, f in zip(mean.tolist(), c.tolist(), log_factorial.tolist())]
        return pd.DataFrame({"ratio": ratios, "miscopied": miscopied}, dtype="float64")

    return both


def _space(collisions: str) -> Column:
    """The effective space from each position's collision: summed exactly, as positions come in any order."""

    @F.pandas_udf("double")
    def space(collisions: pd.Series) -> pd.Series:
        return pd.Series([math.exp(math.fsum(-math.log(m) for m in some)) for some in collisions], dtype="float64")

    return space(collisions)


def may_agree(error: float) -> Callable[[Side, Side], np.ndarray]:
    """Pairs whose payloads, as ``planes``, are not told apart: the gate of ``posteriors`` a little wider, so that the columns there decide."""

    def keep(a: Side, b: Side) -> np.ndarray:
        cmp, mism = planes_compared(a, b)
        table = np.array(_LOG_FACTORIALS)
        ways = table[cmp] - table[mism] - table[cmp - mism]
        same, other = (ways + mism * math.log(p) + (cmp - mism) * math.log1p(-p) for p in (error, 0.75))
        unrelated = np.log(a["clonality"] * np.exp(same) + (1 - a["clonality"]) * np.exp(other) + 1e-300)
        return (b["cnt"] >= a["cnt"]) & ((cmp < MIN_COMPARED) | (same - unrelated >= math.log(0.1) - 1e-6))

    return keep


def posteriors(barcodes: DataFrame, options: Correction = Correction(), rates: DataFrame | None = None, agreement: DataFrame | None = None) -> DataFrame:
    """(sample_id, child, parent, c_child, c_parent, pos, posterior) of all pairs that pass the gates.

    ``barcodes`` has sample_id, key, cnt, and pos_err and payload if these are to be
    used; ``rates`` (sample_id, umi_error_rate) and ``agreement`` (sample_id,
    clonality) go with it.
    """
    barcodes = written(barcodes, "barcodes")  # read six times below
    carry = [c for c in ("pos_err", "payload") if c in barcodes.columns]
    paid = "payload" in carry and agreement is not None
    n = barcodes.groupBy("sample_id").agg(F.count("*").alias("n"))
    space = composition(barcodes).groupBy("sample_id").agg(F.collect_list("collision").alias("_m")).select("sample_id", _space("_m").alias("effective_space"))
    per_sample = n.join(space, "sample_id")
    if options.error is None and rates is not None:
        per_sample = per_sample.join(rates.select("sample_id", "umi_error_rate"), "sample_id")
        rate = F.when(F.col("umi_error_rate") > 0, F.col("umi_error_rate")).otherwise(options.floor_error)
    else:
        rate = F.lit(float(options.error if options.error else options.floor_error))
    per_sample = per_sample.withColumn("eps", rate)
    if agreement is not None:
        per_sample = per_sample.join(agreement, "sample_id")
    # One row per distinct count: its share of barcodes, and log(count!).
    sizes = barcodes.groupBy("sample_id", F.col("cnt").alias("c_child")).agg(F.count("*").alias("_m")).join(n, "sample_id")
    sizes = sizes.select("sample_id", "c_child", F.greatest(F.col("_m") / F.col("n"), 1 / (F.col("n") + 1)).alias("p_size"), log_factorial(F.col("c_child")).alias("log_factorial"))

    # What the gates ask of a pair is asked where its barcodes meet; what else a child carries is joined to the pairs that pass.
    # Payloads meet as bits, where these can stand for them.
    bits = paid and barcodes.filter(~plain("payload")).isEmpty()
    if bits:
        drafts = barcodes.join(F.broadcast(agreement), "sample_id").select("sample_id", "key", "cnt", "clonality", planes("payload").alias("_p"))  # a row per sample
        pairs = neighbour_pairs(drafts.select("sample_id", "key", "cnt", "clonality", "_p.*"), "cnt", "clonality", "high", "low", "none", keep=may_agree(options.payload_error))
    else:
        most = options.max_child_share
        pairs = neighbour_pairs(barcodes, "cnt", keep=lambda a, b: (b["cnt"] >= a["cnt"]) if paid else (b["cnt"] > a["cnt"]) & (a["cnt"] <= most * b["cnt"]))
    pairs = pairs.select("sample_id", "pos", F.col("a").alias("x"), F.col("b").alias("y"), F.col("a.cnt").alias("c_child"), F.col("b.cnt").alias("c_parent"))
    big, c = F.col("c_parent"), F.col("c_child")
    pairs = pairs.filter((big > c) | ((big == c) & (F.col("y.key") < F.col("x.key"))))
    if paid and not bits:
        for side in ("x", "y"):
            more = barcodes.select("sample_id", F.col("key").alias("_k"), F.col("payload").alias(f"{side}_payload"))
            pairs = pairs.withColumn("_k", F.col(f"{side}.key")).join(more, ["sample_id", "_k"]).drop("_k")
    pairs = pairs.join(F.broadcast(per_sample), "sample_id").join(F.broadcast(sizes), ["sample_id", "c_child"])  # rows per sample, and per distinct count
    ratio, decisive = F.lit(1.0), F.lit(False)
    if paid:
        compared, mismatched = (planes_comparable("x", "y"), planes_hamming("x", "y")) if bits else (comparable("x_payload", "y_payload"), hamming("x_payload", "y_payload"))
        pairs = pairs.withColumn("cmp", compared).withColumn("mism", mismatched)
        same, other = _log_binomial(F.col("mism"), F.col("cmp"), options.payload_error), _log_binomial(F.col("mism"), F.col("cmp"), 0.75)
        unrelated = F.log(F.col("clonality") * F.exp(same) + (1 - F.col("clonality")) * F.exp(other) + 1e-300)
        ratio = F.when(F.col("cmp") >= MIN_COMPARED, F.exp(F.greatest(F.least(same - unrelated, F.lit(60.0)), F.lit(-60.0)))).otherwise(1.0)
        pairs = pairs.withColumn("ratio", ratio).filter("ratio >= 0.1")
        ratio, decisive = F.col("ratio"), F.col("ratio") > 10
    gate = F.when(decisive, (big > c) | (F.col("y.key") < F.col("x.key"))).otherwise((big > c) & (c <= options.max_child_share * big))
    pairs = pairs.filter(gate)
    if "pos_err" in carry:
        more = barcodes.select("sample_id", F.col("key").alias("_k"), "pos_err")
        pairs = pairs.withColumn("_k", F.col("x.key")).join(more, ["sample_id", "_k"]).drop("_k")
    at = F.greatest(F.least(F.get("pos_err", F.col("pos") - 1), F.lit(0.75)), F.lit(1e-6)) if "pos_err" in carry else F.col("eps")
    mean = big * at / 3
    miscopied = F.exp(-mean + c * F.log(mean) - F.col("log_factorial"))
    if paid:
        pairs = pairs.withColumn("_l", likelihoods(options.payload_error)("mism", "cmp", "clonality", mean, c, "log_factorial"))
        ratio, miscopied = F.col("_l.ratio"), F.col("_l.miscopied")
    share, most = c / (c + big), options.max_child_share
    norm = big + 1 - 1 / most
    branched = F.when((share <= most) & (norm > 0), 1 / (share * share) / norm * big / ((c + big) * (c + big))).otherwise(0.0)
    length = F.length("x.key")
    rho = F.least(F.lit(0.9), options.polymerase * options.cycles * length)
    error = ((1 - rho) * miscopied + rho * branched) * ratio
    chance = F.greatest(F.col("n") / F.col("effective_space") * F.col("p_size"), F.lit(1e-300))
    return pairs.select("sample_id", F.col("x.key").alias("child"), F.col("y.key").alias("parent"), "c_child", "c_parent", "pos", (error / (error + chance)).alias("posterior"))


def parents(scored: DataFrame, options: Correction = Correction()) -> DataFrame:
    """(sample_id, child, parent, posterior): each child's best parent if good enough; ties to the first position, then the first base."""
    order = F.struct("posterior", -F.col("pos"), -F.ascii(F.substring(F.col("parent"), F.col("pos"), F.lit(1))))
    best = scored.groupBy("sample_id", "child").agg(F.max_by("parent", order).alias("parent"), F.max("posterior").alias("posterior"))
    return best.filter(F.col("posterior") >= options.min_posterior)


def roots(chosen: DataFrame) -> DataFrame:
    """(sample_id, child, root): the end of each chain of parents, by pointer doubling."""
    now = written(chosen.select("sample_id", "child", F.col("parent").alias("root")), "roots")
    while True:
        further = now.select("sample_id", F.col("child").alias("root"), F.col("root").alias("_next"))
        after = now.join(further, ["sample_id", "root"], "left").select("sample_id", "child", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        after = written(after, "roots")
        now = after.drop("_moved")
        if not after.filter("_moved").take(1):
            return now


def merges(barcodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sample_id, child, parent, posterior, c_child, c_parent, by_payload): each merge; by payload where counts alone would not have allowed it."""
    counts = barcodes.select("sample_id", "key", "cnt")
    out = chosen.join(counts.withColumnRenamed("key", "child").withColumnRenamed("cnt", "c_child"), ["sample_id", "child"])
    out = out.join(counts.withColumnRenamed("key", "parent").withColumnRenamed("cnt", "c_parent"), ["sample_id", "parent"])
    return out.select("sample_id", "child", "parent", "posterior", "c_child", "c_parent", (F.col("c_parent") <= F.col("c_child")).alias("by_payload"))


def barcode_table(barcodes: DataFrame, merged: DataFrame) -> DataFrame:
    """(sample_id, key, cnt, corrected, root): corrected sums the reads of a root's tree and is 0 elsewhere."""
    rooted = barcodes.select("sample_id", "key", "cnt").join(merged.select("sample_id", F.col("child").alias("key"), "root"), ["sample_id", "key"], "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "key"))
    totals = rooted.groupBy("sample_id", F.col("root").alias("key")).agg(F.sum("cnt").alias("_total"))
    return rooted.join(totals, ["sample_id", "key"], "left").select("sample_id", "key", "cnt", F.coalesce("_total", F.lit(0)).alias("corrected"), "root")


def corrected_reads(reads: DataFrame, merged: DataFrame, key: str = "umi") -> DataFrame:
    """``reads`` with corrected_umi and whether it changed."""
    moved = merged.select("sample_id", F.col("child").alias("_k"), "root")
    out = reads.withColumn("_k", folded(key)).join(moved, ["sample_id", "_k"], "left")
    return out.withColumn("corrected_umi", F.coalesce("root", "_k")).withColumn("umi_corrected", F.col("root").isNotNull()).drop("_k", "root")


def audited(corrected: DataFrame, key: str = "umi", cell: str | None = None, original_cell: str | None = None) -> DataFrame:
    """``corrected`` with cell_corrected and a comment: RX and CB as corrected, OX and OC as read where they changed."""
    cells = F.col(cell) if cell else F.lit(None).cast("string")
    moved = F.coalesce(F.col(cell) != F.col(original_cell), F.lit(False)) if cell and original_cell else F.lit(False)
    old = F.col(original_cell) if original_cell else F.lit(None).cast("string")
    comment = tags(RX=F.col("corrected_umi"), CB=cells, OX=F.when(F.col("umi_corrected"), F.col(key)), OC=F.when(moved, old))
    return corrected.withColumn("cell_corrected", moved).withColumn("comment", comment)


def molecule_estimates(barcodes: DataFrame, merged: DataFrame) -> DataFrame:
    """(sample_id, umis, merged, merged_reads, molecules_observed, molecules_corrected, saturated)."""
    n = barcodes.groupBy("sample_id").agg(F.count("*").alias("umis"))
    space = information(composition(barcodes)).select("sample_id", "effective_space")
    moved = barcodes.join(merged.select("sample_id", F.col("child").alias("key")), ["sample_id", "key"], "left_semi").groupBy("sample_id").agg(F.count("*").alias("merged"), F.sum("cnt").alias("merged_reads"))
    out = n.join(space, "sample_id").join(moved, "sample_id", "left").select("sample_id", "umis", "effective_space", F.coalesce("merged", F.lit(0)).alias("merged"), F.coalesce("merged_reads", F.lit(0)).alias("merged_reads"))
    m, s = F.col("umis") - F.col("merged"), F.col("effective_space")
    full = m >= 0.9 * s
    hidden = F.when(full, m.cast("double")).otherwise(-s * F.log(1 - F.least(m / s, F.lit(0.9))))
    return out.select("sample_id", "umis", "merged", "merged_reads", m.alias("molecules_observed"), hidden.alias("molecules_corrected"), (full | (F.col("umis") > 0.05 * s)).alias("saturated"))
