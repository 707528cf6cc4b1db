"""Cells: molecules per cell, calling by OrdMag and by the knee, and snapping cells to a whitelist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import BASES, error_of, phred
from ..storage import written
from .tables import spaced_ranks

EXPECTED_CELLS = 3000
ORDMAG_SHARE = 0.01
SNAP_POSTERIOR = 0.975
DEFAULT_ERROR = 1e-3
PIECE = 100_000


def cell_molecules(reads: DataFrame, umi: str = "umi") -> DataFrame:
    """(sample_id, cell, molecules): distinct barcodes of each cell."""
    return reads.select("sample_id", "cell", umi).distinct().groupBy("sample_id", "cell").agg(F.count("*").alias("molecules"))


def call_cells(cells: DataFrame, expected: int = EXPECTED_CELLS) -> DataFrame:
    """(sample_id, cell, molecules, called): at least a tenth of the size at the first per cent of the expected cells.

    Sizes are few: the threshold comes from the spectrum of sizes, not from a sort of cells.
    """
    spectrum = cells.groupBy("sample_id", "molecules").agg(F.count("*").alias("n"))
    down = Window.partitionBy("sample_id").orderBy(F.desc("molecules")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.floor(ORDMAG_SHARE * F.least(F.lit(expected), F.sum("n").over(Window.partitionBy("sample_id"))))
    at = spectrum.withColumn("_to", F.sum("n").over(down)).withColumn("_index", index).filter(F.col("_to") > F.col("_index"))
    threshold = at.groupBy("sample_id").agg(F.greatest(F.lit(1), F.floor(F.max("molecules") / 10)).alias("_least"))
    return cells.join(threshold, "sample_id").select("sample_id", "cell", "molecules", (F.col("molecules") >= F.col("_least")).alias("called"))


def cell_spectrum(called: DataFrame) -> DataFrame:
    """(sample_id, umis, called, cells): how many cells have a size. Cells are called by size, so a size is called or not."""
    return called.groupBy("sample_id", F.col("molecules").alias("umis"), "called").agg(F.count("*").alias("cells"))


def called_totals(called: DataFrame) -> DataFrame:
    """(sample_id, cells, called_cells, molecules, molecules_in_called)."""
    return called.groupBy("sample_id").agg(F.count("*").alias("cells"), F.count_if("called").alias("called_cells"), F.sum("molecules").alias("molecules"), F.coalesce(F.sum(F.when(F.col("called"), F.col("molecules"))), F.lit(0)).alias("molecules_in_called"))


def cell_rank(called: DataFrame) -> DataFrame:
    """(sample_id, rank, umis, called, cumulative_umis, cumulative_fraction): every cell's rank, largest first.

    From the spectrum of sizes: cells of one size take the ranks after the larger ones,
    in pieces that are dealt out, so cells are never sorted in one task.
    """
    down = Window.partitionBy("sample_id").orderBy(F.desc("umis")).rowsBetween(Window.unboundedPreceding, -1)
    each = F.col("umis") * F.col("cells")
    sizes = cell_spectrum(called).select("sample_id", "umis", "called", "cells", F.coalesce(F.sum("cells").over(down), F.lit(0)).alias("_rank"), F.coalesce(F.sum(each).over(down), F.lit(0)).alias("_upto"), F.sum(each).over(Window.partitionBy("sample_id")).alias("_all"))
    pieces = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cells") - 1) / PIECE))).alias("_p")).repartition("sample_id", "umis", "_p")
    ranks = pieces.select("*", F.explode(F.sequence(F.col("_p") * PIECE + 1, F.least("cells", (F.col("_p") + 1) * PIECE))).alias("_i"))
    upto = F.col("_upto") + F.col("_i") * F.col("umis")
    return ranks.select("sample_id", (F.col("_rank") + F.col("_i")).alias("rank"), "umis", "called", upto.alias("cumulative_umis"), (upto / F.col("_all")).alias("cumulative_fraction"))


def cell_rank_spaced(called: DataFrame) -> DataFrame:
    """(sample_id, rank, umis, called, cumulative_umis, cumulative_fraction) at spaced ranks, largest cells first: a few hundred rows however many cells there are."""
    down = Window.partitionBy("sample_id").orderBy(F.desc("umis")).rowsBetween(Window.unboundedPreceding, -1)
    each, whole = F.col("umis") * F.col("cells"), Window.partitionBy("sample_id")
    sizes = cell_spectrum(called).select("sample_id", "umis", "called", "cells", F.coalesce(F.sum("cells").over(down), F.lit(0)).alias("_rank"), F.coalesce(F.sum(each).over(down), F.lit(0)).alias("_upto"), F.sum(each).over(whole).alias("_all"), F.sum("cells").over(whole).alias("_n"))
    grid = sizes.select("sample_id", "_n").distinct().select("sample_id", F.explode(spaced_ranks(F.col("_n"))).alias("rank"))
    hit = sizes.join(grid, "sample_id").filter((F.col("rank") > F.col("_rank")) & (F.col("rank") <= F.col("_rank") + F.col("cells")))
    upto = F.col("_upto") + (F.col("rank") - F.col("_rank")) * F.col("umis")
    return hit.select("sample_id", "rank", "umis", "called", upto.alias("cumulative_umis"), (upto / F.col("_all")).alias("cumulative_fraction"))


def knee(called: DataFrame) -> DataFrame:
    """(sample_id, knee_rank, knee_umis): farthest above the chord of the log-log curve; 0 unless ten times the mean.

    Of cells of one size the last is the farthest, so the spectrum of sizes tells.
    """
    down = Window.partitionBy("sample_id").orderBy(F.desc("umis")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("sample_id")
    sizes = cell_spectrum(called).select("sample_id", "umis", F.sum("cells").over(down).alias("rank"), F.sum("cells").over(whole).alias("_n"), F.max("umis").over(whole).alias("_top"), F.min("umis").over(whole).alias("_low"), (F.sum(F.col("umis") * F.col("cells")).over(whole) / F.sum("cells").over(whole)).alias("_mean"))
    x, y, top = F.log(F.col("rank").cast("double")), F.log(F.col("umis").cast("double")), F.log(F.col("_top").cast("double"))
    slope = F.when(F.col("_n") > 1, (F.log(F.col("_low").cast("double")) - top) / F.log(F.col("_n").cast("double"))).otherwise(0.0)
    far = sizes.withColumn("_d", F.round((y - top - slope * x) / F.sqrt(1 + slope * slope), 9))
    best = far.groupBy("sample_id").agg(F.max_by(F.struct("rank", "umis"), F.struct("_d", -F.col("rank"))).alias("k"), F.max("_mean").alias("_mean"))
    clear = F.col("k.umis") >= 10 * F.col("_mean")
    return best.select("sample_id", F.when(clear, F.col("k.rank")).otherwise(0).alias("knee_rank"), F.when(clear, F.col("k.umis")).otherwise(0).alias("knee_umis"))


def observed_cells(reads: DataFrame, quality: str | None = None) -> DataFrame:
    """(cell, reads, first_quality): with the quality of the cell's first read."""
    first = F.min_by(quality, "src_index") if quality else F.lit(None).cast("string")
    return reads.filter(F.length("cell") > 0).groupBy("cell").agg(F.count("*").alias("reads"), first.alias("first_quality"))


def snap(observed: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(cell, reads, status, snapped, posterior): exact, corrected, off_list or far.

    Candidates are the listed cells at distance one, by equality on the 3L
    substitutions of an unlisted cell. The background, cells on no list, has the
    reads on cells with no listed neighbour as its share, spread over the unlisted
    cells.
    """
    observed = written(observed, "observed")  # read seven times below
    listed = written(whitelist.select("cell").distinct(), "listed")
    exact = observed.join(listed, "cell", "left_semi")
    off = observed.join(listed, "cell", "left_anti")
    counts = listed.join(exact.select("cell", "reads"), "cell", "left").select(F.col("cell").alias("candidate"), F.coalesce("reads", F.lit(0)).alias("listed_reads"))

    places = F.sequence(F.lit(1), F.length("cell"))
    tried = off.select("cell", "reads", "first_quality", F.explode(places).alias("pos")).select("*", F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    tried = tried.filter(F.col("base") != F.substring(F.col("cell"), F.col("pos"), F.lit(1)))
    tried = tried.withColumn("candidate", F.concat(F.substring("cell", F.lit(1), F.col("pos") - 1), F.col("base"), F.substring(F.col("cell"), F.col("pos") + 1, F.length("cell"))))
    near = written(tried.join(counts, "candidate"), "near")

    have = near.select("cell").distinct()
    far = off.join(have, "cell", "left_anti")
    # One row of sums for all cells.
    sums = observed.join(listed.withColumn("_l", F.lit(True)), "cell", "left").join(have.withColumn("_h", F.lit(True)), "cell", "left").agg(
        F.coalesce(F.sum(F.when(F.col("_l"), F.col("reads"))), F.lit(0)).alias("total"), F.count_if(F.col("_l").isNull()).alias("all_off"),
        F.coalesce(F.sum(F.when(F.col("_l").isNull() & F.col("_h").isNull(), F.col("reads"))), F.lit(0)).alias("far_reads"), F.sum("reads").alias("reads"),
    ).first()
    total, n_listed = sums.total, listed.count()
    background = sums.far_reads / sums.reads / sums.all_off if sums.all_off and sums.reads else 0.0

    def error(i):
        known = F.col("first_quality").isNotNull() & (F.length("first_quality") >= i)
        return F.when(known, F.greatest(F.least(error_of(phred("first_quality", i)), F.lit(0.75)), F.lit(1e-7))).otherwise(DEFAULT_ERROR)

    right = F.exp(F.aggregate(places, F.lit(0.0), lambda s, i: s + F.log(1 - error(i))))
    e = error(F.col("pos"))
    weight = (F.col("listed_reads") + 1) / F.lit(total + n_listed) * e / 3 * right / (1 - e) * (1 - background)
    scored = near.withColumn("w", weight).withColumn("b", background * right)
    best = scored.groupBy("cell", "reads").agg(F.max_by("candidate", F.struct("w", F.col("candidate"))).alias("candidate"), F.max("w").alias("w"), F.sum("w").alias("all"), F.max("b").alias("b"))
    share = F.col("w") / (F.col("all") + F.col("b"))
    won = (F.col("w") >= F.col("b")) & (share >= SNAP_POSTERIOR)
    judged = best.select("cell", "reads", F.when(won, "corrected").otherwise("off_list").alias("status"), F.when(won, F.col("candidate")).alias("snapped"), share.alias("posterior"))
    one = F.lit(None).cast("double")
    rest = exact.select("cell", "reads", F.lit("exact").alias("status"), F.col("cell").alias("snapped"), one.alias("posterior"))
    return judged.unionByName(rest).unionByName(far.select("cell", "reads", F.lit("far").alias("status"), F.lit(None).cast("string").alias("snapped"), one.alias("posterior")))


def snap_summary(snapped: DataFrame) -> DataFrame:
    """(status, barcodes, reads)."""
    return snapped.groupBy("status").agg(F.count("*").alias("barcodes"), F.sum("reads").alias("reads"))
