"""Comparisons over stage outputs: groupings, spike-ins, targets, overlaps, variants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def grouping_agreement(reads: DataFrame, truth: str, found: str) -> DataFrame:
    """(reads, adjusted_rand, split_share, merged_share): two groupings of the same reads.

    A read is in a split cluster if its true group has reads in several found ones,
    in a merged one if its found group has reads of several true ones.
    """
    cells = reads.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").alias("n"))
    rows = cells.groupBy("t").agg(F.sum("n").alias("a"), F.count("*").alias("parts"))
    cols = cells.groupBy("f").agg(F.sum("n").alias("b"), F.count("*").alias("parts"))

    def choose2(n: Column) -> Column:
        return n.cast("double") * (n.cast("double") - 1) / 2

    c = cells.agg(F.sum("n").alias("n"), F.sum(choose2(F.col("n"))).alias("both")).first()
    r = rows.agg(F.sum(choose2(F.col("a"))).alias("pairs"), F.sum(F.when(F.col("parts") > 1, F.col("a")).otherwise(0)).alias("split")).first()
    k = cols.agg(F.sum(choose2(F.col("b"))).alias("pairs"), F.sum(F.when(F.col("parts") > 1, F.col("b")).otherwise(0)).alias("merged")).first()
    n = c.n or 0
    expected = r.pairs * k.pairs / (n * (n - 1) / 2) if n > 1 else 0.0
    most = (r.pairs + k.pairs) / 2 if n else 0.0
    ari = 1.0 if n < 2 or most == expected else (c.both - expected) / (most - expected)
    out = [(n, float(ari), r.split / n if n else 0.0, k.merged / n if n else 0.0)]
    return reads.sparkSession.createDataFrame(out, "reads long, adjusted_rand double, split_share double, merged_share double")


BIN = 10_000


def _overlaps(molecules: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, molecule) that overlap, each once: intervals meet by the bins they touch, an overlap at its first common one."""

    def bins(start: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / BIN)))

    m = molecules.select("chrom", "start", "end", "molecule", bins("start", "end").alias("bin"))
    t = targets.select("chrom", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "target", bins("start", "end").alias("bin"))
    hit = m.join(t, ["chrom", "bin"]).filter((F.col("start") < F.col("t_end")) & (F.col("end") > F.col("t_start")))
    return hit.filter(F.col("bin") == F.floor(F.greatest("start", "t_start") / BIN)).select("target", "molecule").distinct()


def _below(points: DataFrame, asked: DataFrame, equal: bool) -> DataFrame:
    """(chrom, pos, n): for the positions ``asked`` (chrom, pos) how many of ``points`` lie below, or at them too if ``equal``. Summed within bins, then over bins."""
    have = points.groupBy("chrom", "pos").agg(F.count("*").alias("k")).withColumn("ask", F.lit(False))
    both = have.unionByName(asked.distinct().withColumns({"k": F.lit(0).cast("long"), "ask": F.lit(True)})).withColumn("bin", F.floor(F.col("pos") / BIN))
    earlier = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = both.groupBy("chrom", "bin").agg(F.sum("k").alias("k")).select("chrom", "bin", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("_b"))
    upto = Window.partitionBy("chrom", "bin").orderBy("pos", F.col("ask") if equal else ~F.col("ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_in", F.sum("k").over(upto)).filter("ask").join(offsets, ["chrom", "bin"]).select("chrom", "pos", (F.col("_in") + F.col("_b")).alias("n"))


def per_target(molecules: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, molecules): distinct molecules whose half-open interval overlaps a target's.

    Of molecules and targets with one interval each, those that start before a target's end
    less those that end by its start are counted, without a pair being made. Molecules and targets
    with several intervals, or with none of a length above 0, meet in pairs.
    """
    regular = F.coalesce((F.col("start") < F.col("end")) & F.col("chrom").isNotNull(), F.lit(False))

    def split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        odd = df.groupBy(key).agg(F.count("*").alias("_n"), F.max(~regular).alias("_odd")).filter("_n > 1 OR _odd").select(F.col(key).alias("_k"))
        odd = written(odd, "several")
        same = F.col(key).eqNullSafe(F.col("_k"))
        return df.join(odd, same, "left_anti"), df.join(odd, same, "left_semi")

    (m, m_odd), (t, t_odd) = split(molecules, "molecule"), split(targets, "target")
    begun = _below(m.select("chrom", F.col("start").alias("pos")), t.select("chrom", F.col("end").alias("pos")), False)
    over = _below(m.select("chrom", F.col("end").alias("pos")), t.select("chrom", F.col("start").alias("pos")), True)
    one = t.join(begun.withColumnsRenamed({"pos": "end", "n": "_s"}), ["chrom", "end"]).join(over.withColumnsRenamed({"pos": "start", "n": "_e"}), ["chrom", "start"])
    pairs = _overlaps(m_odd, targets).unionByName(_overlaps(m, t_odd)).groupBy("target").agg(F.count("*").alias("n"))
    counted = one.select("target", (F.col("_s") - F.col("_e")).alias("n")).unionByName(pairs).groupBy("target").agg(F.sum("n").alias("n"))
    return targets.select("target").distinct().join(counted, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("molecules"))


def overlap_components(blocks: DataFrame, width: int = 10_000) -> DataFrame:
    """(grp, components): islands of overlapping half-open blocks in each group.

    A group is dealt to bins of its starts, one row per start, so a task's bin has at most
    ``width`` rows at whole coordinates; one row per bin hands the reach of the bins before on.
    Blocks that repeat count once; those without a start or a length overlap only what reaches over them.
    """
    longer = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    starts = blocks.select("grp", "start", "end").distinct().groupBy("grp", "start").agg(
        (F.count_if(~longer) + F.max(longer.cast("long"))).alias("_n"), F.max(F.when(F.col("start").isNotNull(), F.col("end"))).alias("_end")
    )
    starts = starts.withColumn("_bin", F.floor(F.col("start") / width))
    bins = starts.groupBy(F.col("grp").alias("_g"), F.col("_bin").alias("_b")).agg(F.max("_end").alias("_most"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_carried", F.max("_most").over(before.partitionBy("_g").orderBy("_b")))
    placed = starts.join(bins, F.col("grp").eqNullSafe(F.col("_g")) & F.col("_bin").eqNullSafe(F.col("_b")))
    reach = F.greatest("_carried", F.max("_end").over(before.partitionBy("grp", "_bin").orderBy("start")))
    placed = placed.withColumn("_new", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), F.col("_n")).otherwise(0))
    return placed.groupBy("grp").agg(F.sum("_new").alias("components"))


def optical_duplicates(clusters: DataFrame, radius: int = 100) -> DataFrame:
    """(lane, tile, pairs): clusters with one barcode on a tile within a radius in pixels.

    Clusters are dealt to squares of the radius; a pair meets in its own or a neighbouring square.
    """
    base = clusters.select("lane", "tile", "umi", "id", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    around = F.explode(F.expr("transform(sequence(0, 8), i -> struct(cast(i div 3 - 1 as bigint) as dx, cast(i % 3 - 1 as bigint) as dy))"))
    spread = base.select("lane", "tile", "umi", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", around.alias("d"))
    spread = spread.select("lane", "tile", "umi", "id2", "x2", "y2", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    near = base.join(spread, ["lane", "tile", "umi", "cx", "cy"]).filter((F.col("id") < F.col("id2")) & ((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius * radius))
    return near.groupBy("lane", "tile").agg(F.count("*").alias("pairs"))


def variant_score(called: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn) over (chrom, pos, alt)."""
    keys = ["chrom", "pos", "alt"]
    c, t = called.select(*keys).distinct().withColumn("c", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = c.join(t, keys, "full")
    return both.agg(F.count_if(F.col("c").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("c").isNull()).alias("fn"))


def set_overlap(left: DataFrame, right: DataFrame, key: str = "cell") -> DataFrame:
    """(shared, only_left, only_right): two sets of cells."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def detection_limit(molecules: int, needed: int = 2, power: float = 0.95) -> float:
    """The allele fraction at which ``needed`` variant molecules are seen with the given power."""

    def seen(fraction: float) -> float:
        mean, below, term = molecules * fraction, 0.0, math.exp(-molecules * fraction)
        for k in range(needed):
            below += term
            term *= mean / (k + 1)
        return 1 - below

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if seen(middle) < power else (low, middle)
    return high


def independence(counts: DataFrame) -> DataFrame:
    """(sample_id, barcodes, collision_observed, collision_expected, ratio).

    The unbiased chance that two reads carry one barcode, against the product over positions of the chance that they share a base.
    """
    c = F.col("cnt").cast("double")
    observed = counts.groupBy("sample_id").agg(F.count("*").alias("barcodes"), (F.sum(c * (c - 1)) / (F.sum(c) * (F.sum(c) - 1))).alias("collision_observed"))
    from .barcodes import composition

    expected = composition(counts, by_reads=True).groupBy("sample_id").agg(F.exp(F.sum(F.log("collision"))).alias("collision_expected"))
    return observed.join(expected, "sample_id").select("sample_id", "barcodes", "collision_observed", "collision_expected", (F.col("collision_observed") / F.col("collision_expected")).alias("ratio"))


def exactness(consensus: DataFrame, truth: DataFrame) -> DataFrame:
    """(sample_id, consensuses, exact, precision, recall): consensuses (sample_id, seq) that are a template of the truth to the letter, and templates that one of them is.

    One base off is as wrong as any other sequence. Case does not count.
    """
    seqs = consensus.select("sample_id", F.upper("seq").alias("seq")).groupBy("sample_id", "seq").agg(F.count("*").alias("n"))
    templates = truth.select("sample_id", F.upper("seq").alias("seq")).distinct().withColumn("template", F.lit(True))
    both = seqs.join(templates, ["sample_id", "seq"], "full")
    hit = F.col("n").isNotNull() & F.col("template")
    sums = both.groupBy("sample_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("consensuses"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("exact"), F.count_if(hit).alias("_found"), F.count("template").alias("_all"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("sample_id", "consensuses", "exact", share("exact", "consensuses").alias("precision"), share("_found", "_all").alias("recall"))


def modal_chains(molecules: DataFrame, min_molecules: int = 1) -> DataFrame:
    """(cell, locus, junction, votes, molecules): the junction most molecules (cell, locus, junction) of a cell's locus carry, ties to the last in order.

    Molecules without a cell, locus or junction do not vote; a locus with fewer than ``min_molecules`` has no call.
    """
    named = molecules.filter((F.length("cell") > 0) & (F.length("locus") > 0) & (F.length(F.trim("junction")) > 0))
    votes = named.groupBy("cell", "locus", F.trim("junction").alias("junction")).agg(F.count("*").alias("n"))
    called = votes.groupBy("cell", "locus").agg(F.max(F.struct("n", "junction")).alias("best"), F.sum("n").alias("molecules"))
    return called.filter(F.col("molecules") >= min_molecules).select("cell", "locus", "best.junction", F.col("best.n").alias("votes"), "molecules")
