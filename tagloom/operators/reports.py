"""What the tables say about a library, as named warnings; and a layout suggested from a cycle profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .barcodes import barcode_space, composition, information, library_summary

CONSTANT_SHARE = 0.9
UMI_DEVIATION = 0.18
MIN_UMI_RUN = 3


def library_warnings(counts: DataFrame) -> DataFrame:
    """(sample_id, warnings): names joined by commas, in a fixed order; empty if nothing is wrong."""
    summary = library_summary(counts)
    known = information(composition(counts)).select("sample_id", "barcode_length", "effective_length")
    space = barcode_space(counts).select("sample_id", "saturated", "p_multi", "bias_loss")
    singles = counts.groupBy("sample_id").agg(F.avg((F.col("cnt") == 1).cast("double")).alias("singletons"))
    rows = summary.join(known, "sample_id").join(space, "sample_id").join(singles, "sample_id")
    rules = {
        "shallow": ~F.col("over_sequenced"), "uneven_barcodes": F.col("effective_length") < 0.8 * F.col("barcode_length"), "saturated": F.col("saturated"),
        "collisions": F.col("p_multi") > 0.05, "bias_loss": F.col("bias_loss") > 0.25, "few_reads_per_barcode": F.col("mean_reads_per_umi") < 3, "singletons": F.col("singletons") > 0.5,
    }
    return rows.select("sample_id", F.concat_ws(",", *[F.when(c, k) for k, c in rules.items()]).alias("warnings"))


def _named(rules: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()])


def matching_warnings(status: DataFrame, hopping: DataFrame, fit: DataFrame) -> DataFrame:
    """(warnings) of a run, from (status, reads), ``qc.hopping`` and ``match.fit_calibration``, one row each but the first.

    A run in which nothing was assigned says only that.
    """
    n = status.agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum(F.when(F.col("status") == "assigned", F.col("reads"))), F.lit(0)).alias("assigned"))
    one = F.lit(1).alias("_one")
    row = n.select("*", one).join(hopping.select("rate", "estimable", one), "_one", "left").join(fit.select("slope", "intercept", one), "_one", "left")
    reads, assigned = F.col("reads"), F.col("assigned")
    rules = {
        "hopping": F.col("estimable") & (F.col("rate") > 0.01), "calibration_slope": F.col("slope") > 2, "calibration_intercept": F.col("intercept") > 1e-3,
        "few_assigned": 2 * assigned < reads,
    }
    return row.select(F.when(reads == 0, "no_reads").when(assigned == 0, "nothing_assigned").otherwise(_named(rules)).alias("warnings"))


def estimate_warnings(budget: DataFrame, ratio: DataFrame) -> DataFrame:
    """(sample_id, warnings): an error estimate that cannot be relied on, or that is far from its budget."""
    both = budget.select("sample_id", "unreliable").join(ratio.select("sample_id", "agrees"), "sample_id")
    return both.select("sample_id", _named({"estimate_unreliable": F.col("unreliable"), "estimate_off_budget": ~F.col("unreliable") & ~F.col("agrees")}).alias("warnings"))


def correction_warnings(estimates: DataFrame, table: DataFrame, clonality: DataFrame, cells: DataFrame | None = None, knees: DataFrame | None = None, limited: bool = False) -> DataFrame:
    """(sample_id, warnings, payload_worth): after correction, from molecule estimates, barcode table, clonality, and called totals and knees where there are cells.

    A matching payload is worth nothing where unrelated barcodes match anyway, else one over the clonality.
    """
    kept = table.groupBy("sample_id").agg((F.sum("cnt") / F.count("*")).alias("depth"), F.count_if(F.col("corrected") > 0).alias("molecules"), F.count_if(F.col("corrected") == 1).alias("single"))
    row = estimates.select("sample_id", "saturated").join(kept, "sample_id").join(clonality, "sample_id", "left")
    rules = {"limited": F.lit(limited), "few_reads_per_barcode": F.col("depth") < 3, "saturated": F.col("saturated"), "singletons": 2 * F.col("single") > F.col("molecules")}
    if cells is not None and knees is not None:
        row = row.join(cells.select("sample_id", "called_cells"), "sample_id", "left").join(knees.select("sample_id", "knee_rank"), "sample_id", "left")
        c, k = F.col("called_cells"), F.col("knee_rank")
        rules["cells_off_knee"] = (c > 0) & (k > 0) & (F.greatest(c, k) > 3 * F.least(c, k))
    c = F.col("clonality")
    return row.select("sample_id", _named(rules).alias("warnings"), F.when((c > 0) & (c <= 0.5), 1 / c).otherwise(0.0).alias("payload_worth"))


def consensus_warnings(records: DataFrame, usage: DataFrame, limited: bool = False, contig_mode: bool = False) -> DataFrame:
    """(sample_id, warnings): after the consensus, from records (perhaps with molecule) and ``consensus.base_usage``."""
    second = F.col("molecule") > 1 if "molecule" in records.columns else F.lit(False)
    n = records.groupBy("sample_id").agg(F.count_if(~second).alias("seen"), F.count_if(F.col("reads") == 1).alias("single"), F.count_if(second).alias("split"))
    row = n.join(usage, "sample_id")
    rate = -F.log(1 - F.col("occupancy"))
    multi = 1 - rate * F.exp(-rate) / (1 - F.exp(-rate))
    rules = {
        "limited": F.lit(limited), "singletons": 2 * F.col("single") > F.col("seen"), "many_split": F.col("split") > 0.05 * F.col("seen"),
        "mixed_groups": F.col("expected_molecules") > 1.1, "unsafe_contigs": F.lit(contig_mode) & (multi > 0.05),
    }
    return row.select("sample_id", _named(rules).alias("warnings"))


def subsample_warnings(counted: DataFrame) -> DataFrame:
    """(sample_id, warnings): reads without a barcode, from ``barcodes.without_barcode``."""
    return counted.select("sample_id", _named({"reads_without_barcode": F.col("without") > 0}).alias("warnings"))


def suggest_layout(profile: DataFrame) -> dict:
    """Segments of constant, barcode-like and variable cycles, the layout up to the last constant one, and a note.

    The profile has a row per cycle, so the walk over it is the driver's. Barcode-like runs
    of less than three cycles are variable, and join their neighbours.
    """
    cycles = profile.orderBy("cycle").collect()
    kinds = []
    for r in cycles:
        called = max(1, r.A + r.C + r.G + r["T"])
        top = max(r.A, r.C, r.G, r["T"]) / called
        kinds.append("constant" if top >= CONSTANT_SHARE else "umi" if r.deviation <= UMI_DEVIATION else "variable")

    def runs() -> list[dict]:
        out: list[dict] = []
        for r, kind in zip(cycles, kinds):
            if out and out[-1]["kind"] == kind:
                out[-1]["end"] = r.cycle
                out[-1]["bases"] += r.consensus
            else:
                out.append({"kind": kind, "start": r.cycle, "end": r.cycle, "bases": r.consensus})
        return out

    at = 0
    for s in runs():
        n = len(s["bases"])
        if s["kind"] == "umi" and n < MIN_UMI_RUN:
            kinds[at : at + n] = ["variable"] * n
        at += n
    segments = runs()
    last = max((i for i, s in enumerate(segments) if s["kind"] == "constant"), default=-1)
    letters = {"constant": lambda s: s["bases"].lower(), "umi": lambda s: "N" * len(s["bases"]), "variable": lambda s: "." * len(s["bases"])}
    inside = segments[: last + 1]
    umi, anchor = (sum(len(s["bases"]) for s in inside if s["kind"] == k) for k in ("umi", "constant"))
    trailing = sum(len(s["bases"]) for s in segments[last + 1 :] if s["kind"] == "umi")
    return {"segments": segments, "layout": "".join(letters[s["kind"]](s) for s in inside), "umi": umi, "anchor": anchor, "note": layout_note(umi, anchor, trailing)}


LONG_ANCHOR, LONGEST_UMI = 30, 32


def layout_note(umi: int, anchor: int, trailing: int) -> str:
    """What to mind about a suggested layout: lengths of its barcode and constant parts, and of barcode-like cycles after it."""
    if not umi and trailing:
        return "unanchored"  # like diverse payload: profile more cycles if the barcode is at the other end
    if not umi:
        return "no_barcode"  # perhaps on the other mate
    if trailing >= MIN_UMI_RUN:
        return "more_after_anchor"  # payload, or a second barcode
    if not anchor:
        return "no_anchor"
    if umi > LONGEST_UMI:
        return "barcode_too_long"  # rather two barcodes
    return "long_anchor" if anchor > LONG_ANCHOR else ""  # perhaps a conserved locus: mind what trimming takes
