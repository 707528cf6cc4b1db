"""Counting barcodes and describing the space they come from.

``reads`` has sample_id, umi and umi_qual; barcodes with other letters than ACGT
are folded before counting. Every statistic is a grouped aggregate with partial
sums, per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import BASES, error_of, folded, phred, size_bin

MAX_BIN = 16
DEEP_READS = 5
POLYMERASE_ERROR = 1e-5
PCR_CYCLES = 25
SATURATED = 0.9
CROWDED = 0.05
WORD = 6


def barcode_counts(reads: DataFrame, key: str = "umi") -> DataFrame:
    """(sample_id, key, cnt)."""
    return reads.filter(F.length(key) > 0).groupBy("sample_id", folded(key).alias("key")).agg(F.count("*").alias("cnt"))


def coverage_histogram(counts: DataFrame) -> DataFrame:
    """(sample_id, mig_size, reads, units): by the power of two at or below the count, 2^16 at most."""
    return counts.groupBy("sample_id", F.call_function("shiftleft", F.lit(1).cast("long"), size_bin("cnt", MAX_BIN)).alias("mig_size")).agg(F.sum("cnt").alias("reads"), F.count("*").alias("units"))


def library_summary(counts: DataFrame) -> DataFrame:
    """(sample_id, reads, umis, mean_reads_per_umi, reads_in_migs_ge5, over_sequenced).

    The deep reads are those of bins that start at five or more, so of counts of eight or more.
    """
    bins = coverage_histogram(counts)
    out = bins.groupBy("sample_id").agg(F.sum("reads").alias("reads"), F.sum("units").alias("umis"), F.coalesce(F.sum(F.when(F.col("mig_size") >= DEEP_READS, F.col("reads"))), F.lit(0)).alias("reads_in_migs_ge5"))
    mean = F.col("reads") / F.col("umis")
    return out.select("sample_id", "reads", "umis", F.round(mean, 6).alias("mean_reads_per_umi"), "reads_in_migs_ge5", (mean >= DEEP_READS).alias("over_sequenced"))


def composition(counts: DataFrame, by_reads: bool = False) -> DataFrame:
    """(sample_id, position, A, C, G, T, entropy_bits, information_bits, collision), positions from 1."""
    weight = F.col("cnt") if by_reads else F.lit(1)
    # Words of six are counted first: there are few of them, and letters are taken from these.
    words = F.explode(F.transform(F.sequence(F.lit(0), F.length("key") - 1, F.lit(WORD)), lambda i: F.struct(i.alias("i"), F.substring(F.col("key"), i + 1, F.lit(WORD)).alias("word"))))
    counted = counts.filter(F.length("key") > 0).select("sample_id", weight.alias("w"), words.alias("x")).groupBy("sample_id", "x").agg(F.sum("w").alias("w"))
    places = counted.select("sample_id", "w", "x.i", F.posexplode(F.split("x.word", "")).alias("p", "base")).withColumn("p", F.col("p") + F.col("i"))
    bases = places.groupBy("sample_id", (F.col("p") + 1).alias("position")).agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("w"))), F.lit(0)).cast("long").alias(b) for b in BASES])
    total = sum((F.col(b) for b in BASES), F.lit(0))
    share = [F.col(b) / total for b in BASES]
    entropy = sum((F.when(F.col(b) > 0, -p * F.log2(p)).otherwise(0.0) for b, p in zip(BASES, share)), F.lit(0.0))
    collision = sum((p * p for p in share), F.lit(0.0))
    return bases.select("sample_id", "position", *BASES, entropy.alias("entropy_bits"), (2 - entropy).alias("information_bits"), collision.alias("collision"))


def information(composed: DataFrame) -> DataFrame:
    """(sample_id, barcode_length, total_entropy, total_information, effective_length, effective_space, mismatch_ratio).

    mismatch_ratio, the sum of (1-m)/m over positions with collision m, times the chance
    that two barcodes agree everywhere is the chance that they differ in one place.
    """
    m = F.col("collision")
    out = composed.groupBy("sample_id").agg(
        F.count("*").alias("barcode_length"), F.sum("entropy_bits").alias("total_entropy"), F.sum("information_bits").alias("total_information"),
        F.sum(-F.log(m)).alias("_ln"), F.sum((1 - m) / m).alias("mismatch_ratio"),
    )
    return out.select("sample_id", "barcode_length", "total_entropy", "total_information", (F.col("_ln") / F.log(F.lit(4.0))).alias("effective_length"), F.exp("_ln").alias("effective_space"), "mismatch_ratio")


def occupancy_columns(n: Column, space: Column) -> dict[str, Column]:
    """Estimates from n distinct barcodes seen in a space of the given size."""
    occupancy = n / space
    saturated = occupancy >= SATURATED
    rate = F.when(saturated, F.lit(0.0)).otherwise(-F.log(1 - F.least(occupancy, F.lit(SATURATED))))
    molecules = F.when(saturated, n.cast("double")).otherwise(space * rate)
    filled = 1 - F.exp(-rate)
    multi = F.when(rate > 0, (filled - rate * F.exp(-rate)) / filled).otherwise(0.0)
    return {"occupancy": occupancy, "saturated": saturated, "lambda": rate, "molecules": molecules, "hidden": molecules - n, "p_multi": multi, "bias_loss": F.when(molecules > 0, (molecules - n) / molecules).otherwise(0.0)}


def barcode_space(counts: DataFrame) -> DataFrame:
    """(sample_id, umis, nominal_space, effective_space, occupancy, saturated, lambda, molecules, hidden, p_multi, bias_loss)."""
    n = counts.groupBy("sample_id").agg(F.count("*").alias("umis"))
    known = information(composition(counts)).join(n, "sample_id")
    columns = occupancy_columns(F.col("umis"), F.col("effective_space"))
    return known.select("sample_id", "umis", F.pow(F.lit(4.0), F.col("barcode_length")).alias("nominal_space"), "effective_space", *[c.alias(k) for k, c in columns.items()])


def phred_histogram(reads: DataFrame, quality: str = "umi_qual") -> DataFrame:
    """(sample_id, phred, bases, error_probability) over the barcodes' bases."""
    n = F.length(quality)
    q = reads.filter(n > 0).select("sample_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: phred(quality, i))).alias("phred"))
    return q.groupBy("sample_id", "phred").agg(F.count("*").alias("bases")).withColumn("error_probability", error_of(F.col("phred")))


def payload_lengths(reads: DataFrame, bins: int = 512) -> DataFrame:
    """(sample_id, payload_length, reads, at_least): at_least counts reads of that length or more."""
    from pyspark.sql import Window

    lengths = reads.groupBy("sample_id", F.least(F.length("seq"), F.lit(bins - 1)).alias("payload_length")).agg(F.count("*").alias("reads"))
    longer = Window.partitionBy("sample_id").orderBy(F.desc("payload_length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lengths.withColumn("at_least", F.sum("reads").over(longer))


def trimmed_bases(matched: DataFrame) -> DataFrame:
    """(reads, trimmed_reads, trimmed_bases): what the layouts take off the reads that have one."""
    begin = F.when(F.col("match.found"), F.col("match.payload_begin")).otherwise(0)
    return matched.agg(F.count("*").alias("reads"), F.count_if(begin > 0).alias("trimmed_reads"), F.coalesce(F.sum(begin), F.lit(0)).cast("long").alias("trimmed_bases"))


def without_barcode(reads: DataFrame, key: str = "umi") -> DataFrame:
    """(sample_id, reads, without): reads in all, and those without a barcode, which no table counts."""
    return reads.groupBy("sample_id").agg(F.count("*").alias("reads"), F.count_if(F.length(F.coalesce(F.col(key), F.lit(""))) == 0).alias("without"))


def budget_ratio(budget: DataFrame, rates: DataFrame) -> DataFrame:
    """(sample_id, predicted, estimated, ratio, agrees): the barcodes' estimated error against the budget; they agree within a factor of about three."""
    both = budget.join(rates.select("sample_id", F.col("umi_error_rate").alias("estimated")), "sample_id")
    ratio = F.when(F.col("predicted") > 0, F.col("estimated") / F.col("predicted"))
    return both.select("sample_id", "predicted", "estimated", ratio.alias("ratio"), ((ratio > 0.3) & (ratio < 3)).alias("agrees"))


def error_budget(reads: DataFrame) -> DataFrame:
    """(sample_id, mean_error, polymerase_error, predicted, barcode_error, neighbour_occupancy, unreliable).

    The mean is of error probabilities, not of Phred values.
    """
    counts = barcode_counts(reads)
    space = barcode_space(counts).select("sample_id", "umis", "effective_space")
    length = counts.groupBy("sample_id").agg(F.max(F.length("key")).alias("len"))
    q = phred_histogram(reads).groupBy("sample_id").agg((F.sum(F.col("bases") * F.col("error_probability")) / F.sum("bases")).alias("mean_error"))
    polymerase = F.lit(POLYMERASE_ERROR * PCR_CYCLES)
    predicted = F.col("mean_error") + polymerase
    crowd = F.least(F.lit(1.0), F.col("umis") / F.col("effective_space"))
    return q.join(space, "sample_id").join(length, "sample_id").select(
        "sample_id", "mean_error", polymerase.alias("polymerase_error"), predicted.alias("predicted"), (1 - F.pow(1 - predicted, F.col("len"))).alias("barcode_error"), crowd.alias("neighbour_occupancy"), (crowd > CROWDED).alias("unreliable")
    )
