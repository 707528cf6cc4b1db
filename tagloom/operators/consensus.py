"""One consensus per molecule.

Reads are dealt by molecule and sorted by it and by src_index; a task goes through its
molecules in batches and calls all columns of a batch at once, by summed log likelihoods
of the four bases. All reads vote. Letters of a molecule of more than ``MANY`` reads are
counted by place, base and quality where the reads lie, and called from these counts, so
no task holds all reads of a deep one. Only where a ``cap`` is given do later reads of a
molecule, in order of src_index, not vote, though they are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bases import PHRED_MAX, PHRED_OFFSET, phred, size_bin
from ..storage import written

MANY = 10_000
SHARES = 64
FLOOR = 1e-4
LEAST_ERROR, MOST_ERROR = 1e-7, 0.75
MIN_PHRED = 2
LETTERS = np.frombuffer(b"ACGTN", np.uint8)
CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    CODE[_c] = _i
_ERROR = np.clip(10.0 ** (-np.clip(np.arange(256) - PHRED_OFFSET, 0, PHRED_MAX) / 10), LEAST_ERROR, MOST_ERROR)


def capped(reads: DataFrame, keys: tuple[str, ...], cap: int) -> DataFrame:
    """``reads`` without those that come after the first ``cap`` of their molecule."""
    order = Window.partitionBy(*keys).orderBy("src_index")
    return reads.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank")


def voting(reads: DataFrame, keys: tuple[str, ...], cap: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The reads that vote, and (keys, reads) of the molecules of which some do not, if any; all vote without a ``cap``."""
    if cap is None:
        return reads, None
    deep = written(reads.groupBy(*keys).agg(F.count("*").alias("reads")).filter(F.col("reads") > cap), "deep")
    if deep.isEmpty():
        return reads, None
    known = deep.select(*keys, F.lit(True).alias("_deep"))  # a row per ``cap`` reads at most
    marked = reads.join(F.broadcast(known), list(keys), "left")
    share = F.pmod(F.xxhash64("src_index"), F.lit(SHARES)).alias("_share")
    some = capped(marked.filter("_deep").select("*", share), (*keys, "_share"), cap)
    return marked.filter("_deep IS NULL").select(*reads.columns).unionByName(capped(some, keys, cap).select(*reads.columns)), deep


def by_depth(reads: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """The reads of molecules of ``MANY`` reads or fewer, and those of others, if any: (keys, reads, width, seq, qual), width being the shortest read's."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("seq", "qual")]
    counted = reads.groupBy(*keys).agg(F.count("*").alias("reads"), F.min(F.length(text[0])).alias("width"))
    deep = written(counted.filter(F.col("reads") > MANY), "deep")
    if deep.isEmpty():
        return reads, None
    few = reads.join(F.broadcast(deep.select(*keys)), list(keys), "left_anti")  # a row per ``MANY`` reads at most
    return few, reads.select(*keys, *text).join(F.broadcast(deep), list(keys))


def call_sums(sums: np.ndarray, votes: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bases, p_error, phred) from the four bases' summed log likelihoods at each position."""
    best = sums.max(axis=0)
    rest = np.maximum(np.exp(sums - best).sum(axis=0) - 1, 0)
    p = np.where(votes == 0, 1.0, rest / (1 + rest))
    most = min(60, math.floor(-10 * math.log10(floor)))
    q = np.where(votes == 0, 0, np.clip(np.floor(-10 * np.log10(p + floor) + 0.5), MIN_PHRED, most)).astype(np.int32)
    # Sums that differ by rounding only are ties.
    return np.where(votes == 0, 4, (sums >= best - 1e-9).argmax(axis=0)), p, q


def call_columns(seqs: list[bytes], quals: list[bytes], starts: np.ndarray, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(widths, bases, p_error, phred, votes) of molecules whose reads begin at ``starts``, position after position.

    A molecule is as wide as its shortest read. A base's likelihood is 1-e where a read
    shows it and e/3 where it shows another; other letters do not vote. Ties go to the
    first of A, C, G, T.
    """
    lengths = np.array([len(s) for s in seqs], np.int64)
    n_reads = np.diff(np.r_[starts, len(seqs)])
    widths = np.minimum.reduceat(lengths, starts) if len(starts) else np.empty(0, np.int64)
    each = np.repeat(widths, n_reads)
    letters = np.frombuffer(b"".join(seqs), np.uint8)
    marks = np.frombuffer(b"".join(q[:n].ljust(n, b"!") for q, n in zip(quals, lengths.tolist())), np.uint8)
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)  # position in the molecule
    cell = np.repeat(np.cumsum(lengths) - lengths, each) + at
    slot = np.repeat(np.repeat(np.cumsum(widths) - widths, n_reads), each) + at
    code, e = CODE[letters[cell]], _ERROR[marks[cell]]
    size, known = int(widths.sum()), code < 4
    votes = np.bincount(slot[known], minlength=size)
    miss, gain = np.log(e / 3), np.log(1 - e) - np.log(e / 3)
    sums = np.tile(np.bincount(slot[known], miss[known], size), (4, 1))
    for b in range(4):
        sums[b] += np.bincount(slot[code == b], gain[code == b], size)
    return widths, *call_sums(sums, votes, floor), votes


COLUMN = "position int, base string, p_error double, n long, phred int"


def deep_columns(many: DataFrame, keys: tuple[str, ...], floor: float) -> DataFrame:
    """(keys, reads, position, base, p_error, n, phred) of deep molecules' reads, from counts of letters by quality."""
    places = many.filter("width > 0").select(*keys, "reads", "seq", "qual", F.explode(F.sequence(F.lit(1), "width")).alias("position"))
    letters = places.select(*keys, "reads", "position", F.substring(F.col("seq"), F.col("position"), F.lit(1)).alias("base"), phred("qual", F.col("position")).alias("q"))
    tally = letters.groupBy(*keys, "reads", "position", "base", "q").agg(F.count("*").alias("n"))
    e = _ERROR[PHRED_OFFSET : PHRED_OFFSET + PHRED_MAX + 1]
    miss, hit = (F.get(F.array(*map(F.lit, np.log(x).tolist())), F.col("q")) for x in (e / 3, 1 - e))
    bases, known = "ACGT", F.col("base").isin("A", "C", "G", "T")
    sums = [F.coalesce(F.sum(F.when(known, F.col("n") * F.when(F.col("base") == b, hit).otherwise(miss))), F.lit(0.0)).alias(b) for b in bases]
    found = tally.groupBy(*keys, "reads", "position").agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"), *sums)
    n_keys = len(keys) + 2
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*keys).schema.fields)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = batch.column(n_keys).to_numpy()
            which, p, q = call_sums(np.stack([batch.column(n_keys + 1 + i).to_numpy() for i in range(4)]), votes, floor)
            columns = [pa.array(list(LETTERS[which].tobytes().decode()), pa.string()), pa.array(p), batch.column(n_keys), pa.array(q)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *columns], [*keys, "reads", "position", "base", "p_error", "n", "phred"])

    return found.mapInArrow(call, f"{types}, reads long, {COLUMN}")


def deep_records(many: DataFrame, keys: tuple[str, ...], floor: float) -> DataFrame:
    """``records`` of deep molecules."""
    rows = deep_columns(many, keys, floor).groupBy(*keys, "reads").agg(F.array_sort(F.collect_list(F.struct("position", "base", "phred"))).alias("_p"), F.avg("p_error").alias("mean_error"), F.avg("phred").alias("mean_quality"))
    seq, qual = F.array_join(F.transform("_p", lambda x: x["base"]), ""), F.array_join(F.transform("_p", lambda x: F.char(x["phred"] + PHRED_OFFSET)), "")
    return rows.select(*keys, "reads", seq.alias("seq"), qual.alias("qual"), "mean_error", "mean_quality")


def _molecules(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[tuple], list[bytes], list[bytes], np.ndarray]]:
    """(keys, seqs, quals, starts) of whole molecules, from rows sorted by their keys."""
    keys: list[tuple] = []
    seqs: list[bytes] = []
    quals: list[bytes] = []
    for batch in batches:
        keys += zip(*(c.to_pylist() for c in batch.columns[:n_keys]))
        seqs += [(s or "").encode("latin-1", "replace") for s in batch.column(n_keys).to_pylist()]
        quals += [(q or "").encode("latin-1", "replace") for q in batch.column(n_keys + 1).to_pylist()]
        cut = len(keys)
        while cut and keys[cut - 1] == keys[-1]:  # the last molecule may go on in the next batch
            cut -= 1
        if cut:
            starts = [0, *(i for i in range(1, cut) if keys[i] != keys[i - 1])]
            yield [keys[i] for i in starts], seqs[:cut], quals[:cut], np.array(starts, np.int64)
            keys, seqs, quals = keys[cut:], seqs[cut:], quals[cut:]
    if keys:
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
        yield [keys[i] for i in starts], seqs, quals, np.array(starts, np.int64)


def by_molecule(reads: DataFrame, keys: tuple[str, ...], run, schema: str) -> DataFrame:
    """``run(keys, seqs, quals, starts)`` over batches of whole molecules, their reads in order of src_index; it yields lists of columns after the keys, and which molecule each row is of."""
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.select(*keys).schema.fields)
    full = f"{key_types}, {schema}"
    names = StructType.fromDDL(full).fieldNames()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [c.type for c in batch.columns[: len(keys)]]
                yield batch

        for found, seqs, quals, starts in _molecules(seen(), len(keys)):
            which, columns = run(seqs, quals, starts)
            listed = [pa.array([found[i][k] for i in which], kinds[k]) for k in range(len(keys))]
            if len(which):
                yield pa.RecordBatch.from_arrays([*listed, *columns], names)

    order = ["src_index"] if "src_index" in reads.columns else []
    rows = reads.select(*keys, "seq", "qual", *order).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.drop(*order).mapInArrow(go, full)


def columns(reads: DataFrame, keys: tuple[str, ...] = ("sample_id", "umi"), floor: float = FLOOR, cap: int | None = None) -> DataFrame:
    """(keys, position, base, p_error, n, phred): the call of each position up to the shortest read's length."""

    def run(seqs, quals, starts):
        widths, bases, p, q, votes = call_columns(seqs, quals, starts, floor)
        which = np.repeat(np.arange(len(widths)), widths)
        position = (np.arange(len(which)) - np.repeat(np.cumsum(widths) - widths, widths) + 1).astype(np.int32)
        letters = pa.array(list(LETTERS[bases].tobytes().decode()), pa.string())
        return which.tolist(), [pa.array(position), letters, pa.array(p), pa.array(votes), pa.array(q)]

    votes, many = by_depth(reads, keys) if cap is None else (voting(reads, keys, cap)[0], None)
    found = by_molecule(votes, keys, run, COLUMN)
    return found if many is None else found.unionByName(deep_columns(many, keys, floor).drop("reads"))


RECORD = "reads long, seq string, qual string, mean_error double, mean_quality double"


def called_records(floor: float):
    def run(seqs, quals, starts):
        widths, bases, p, q, _ = call_columns(seqs, quals, starts, floor)
        text, marks = LETTERS[bases].tobytes().decode(), (q + PHRED_OFFSET).astype(np.uint8).tobytes().decode()
        ends = np.cumsum(widths)
        some = np.flatnonzero(widths > 0)
        spans = [(int(e - w), int(e)) for e, w in zip(ends[some], widths[some])]
        means = [np.add.reduceat(x, (ends - widths)[some]) / widths[some] if len(some) else np.empty(0) for x in (p, q.astype(float))]
        depth = np.diff(np.r_[starts, len(seqs)])[some]
        return some.tolist(), [pa.array(depth), pa.array([text[a:b] for a, b in spans], pa.string()), pa.array([marks[a:b] for a, b in spans], pa.string()), *map(pa.array, means)]

    return run


def _true_depth(found: DataFrame, deep: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """``found`` with all reads counted, also those that did not vote."""
    if deep is None:
        return found
    whole = deep.withColumnRenamed("reads", "_all")
    return found.join(whole, list(keys), "left").withColumn("reads", F.coalesce("_all", "reads")).drop("_all")


def records(reads: DataFrame, keys: tuple[str, ...] = ("sample_id", "umi"), floor: float = FLOOR, min_reads: int = 1, cap: int | None = None) -> DataFrame:
    """(keys, reads, seq, qual, mean_error, mean_quality): one row per molecule of ``min_reads`` reads or more."""
    if cap is None:
        few, many = by_depth(reads, keys)
        found = by_molecule(few, keys, called_records(floor), RECORD)
        found = found if many is None else found.unionByName(deep_records(many, keys, floor))
    else:
        votes, deep = voting(reads, keys, cap)
        found = _true_depth(by_molecule(votes, keys, called_records(floor), RECORD), deep, keys)
    return found if min_reads <= 1 else found.filter(F.col("reads") >= min_reads)


def fast(reads: DataFrame, keys: tuple[str, ...] = ("sample_id", "umi"), floor: float = FLOOR, cap: int | None = None) -> DataFrame:
    """(keys, reads, support, seq, qual): the commonest whole sequence, ties to the smaller; support is its reads.

    A base's quality is the best of the reads that show the sequence, with the floor added to its error.
    """
    most = min(60, math.floor(-10 * math.log10(floor)))
    lift = np.zeros(256, np.uint8)
    for q in range(PHRED_MAX + 1):
        lift[q + PHRED_OFFSET] = min(most, max(MIN_PHRED, math.floor(-10 * math.log10(10 ** (-q / 10) + floor) + 0.5))) + PHRED_OFFSET

    def run(seqs, quals, starts):
        out = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(seqs)]):
            counts: dict[bytes, list[bytes]] = {}
            for s, q in zip(seqs[start:end], quals[start:end]):
                counts.setdefault(s, []).append(q[: len(s)].ljust(len(s), b"!"))
            seq, votes = min(counts.items(), key=lambda x: (-len(x[1]), x[0]))
            best = np.frombuffer(b"".join(votes), np.uint8).reshape(len(votes), -1).max(axis=0) if seq else np.empty(0, np.uint8)
            best = np.clip(best, PHRED_OFFSET, PHRED_OFFSET + PHRED_MAX)
            out.append((end - start, len(votes), seq.decode(), lift[best].tobytes().decode()))
        return list(range(len(out))), [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]

    schema = "reads long, support long, seq string, qual string"
    if cap is None:
        few, many = by_depth(reads, keys)
        found = by_molecule(few, keys, run, schema)
        return found if many is None else found.unionByName(_deep_fast(many, keys, [chr(c) for c in lift[PHRED_OFFSET : PHRED_OFFSET + PHRED_MAX + 1]]))
    votes, deep = voting(reads, keys, cap)
    return _true_depth(by_molecule(votes, keys, run, schema), deep, keys)


def _deep_fast(many: DataFrame, keys: tuple[str, ...], marks: list[str]) -> DataFrame:
    """``fast`` of deep molecules: equal sequences are counted where the reads lie; ``marks``: what each best quality becomes."""
    tally = many.groupBy(*keys, "reads", "seq").agg(F.count("*").alias("support"))
    best = tally.groupBy(*keys, "reads").agg(F.min(F.struct((-F.col("support")).alias("less"), "seq")).alias("_b")).select(*keys, "reads", (-F.col("_b.less")).alias("support"), F.col("_b.seq").alias("seq"))
    best = written(best, "commonest")
    shown = many.join(F.broadcast(best.select(*keys, "seq")), [*keys, "seq"]).filter(F.length("seq") > 0)  # a row per ``MANY`` reads at most
    places = shown.select(*keys, "qual", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("position"))
    top = places.groupBy(*keys, "position").agg(F.max(phred("qual", F.col("position"))).alias("q"))
    mark = F.get(F.array(*map(F.lit, marks)), F.col("q"))
    quals = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", mark.alias("mark")))), lambda x: x["mark"]), "").alias("qual"))
    return best.join(quals, list(keys), "left").select(*keys, "reads", "support", "seq", F.coalesce("qual", F.lit("")).alias("qual"))


def quality_grid(consensus: DataFrame) -> DataFrame:
    """(sample_id, depth_bin, q, molecules): by power of two of the depth and rounded mean quality."""
    return consensus.groupBy("sample_id", size_bin("reads").alias("depth_bin"), F.floor(F.col("mean_quality") + 0.5).cast("int").alias("q")).agg(F.count("*").alias("molecules"))


def quality_by_depth(grid: DataFrame) -> DataFrame:
    """(sample_id, min_reads, max_reads, molecules, q_min, q_p25, q_median, q_p75, q_max, q_mean) by nearest rank."""
    upto = Window.partitionBy("sample_id", "depth_bin").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("sample_id", "depth_bin")
    g = grid.withColumn("_to", F.sum("molecules").over(upto)).withColumn("_n", F.sum("molecules").over(whole))

    def quantile(f: float):
        return F.min(F.when(F.col("_to") >= F.greatest(F.lit(1), F.ceil(f * F.col("_n"))), F.col("q")))

    out = g.groupBy("sample_id", "depth_bin").agg(F.sum("molecules").alias("molecules"), F.min("q").alias("q_min"), quantile(0.25).alias("q_p25"), quantile(0.5).alias("q_median"), quantile(0.75).alias("q_p75"), F.max("q").alias("q_max"), (F.sum(F.col("q") * F.col("molecules")) / F.sum("molecules")).alias("q_mean"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth_bin"))
    return out.select("sample_id", low.alias("min_reads"), (low * 2 - 1).alias("max_reads"), "molecules", "q_min", "q_p25", "q_median", "q_p75", "q_max", "q_mean")


def run_totals(consensus: DataFrame) -> DataFrame:
    """(sample_id, molecules, reads, bases, mean_quality, mean_consensus_error): quality weighs by base, error by molecule."""
    n = F.length("seq")
    return consensus.groupBy("sample_id").agg(
        F.count("*").alias("molecules"), F.sum("reads").alias("reads"), F.sum(n).cast("long").alias("bases"),
        (F.sum(F.col("mean_quality") * n) / F.sum(n)).alias("mean_quality"), F.avg("mean_error").alias("mean_consensus_error"),
    )


def named(consensus: DataFrame) -> DataFrame:
    """``consensus`` (sample_id, umi, reads, perhaps cell, contig, contigs, molecule, molecules) with name and comment.

    The name is sample[.cell].barcode, then .c<k> where there are several contigs and
    .<m> where there are more molecules than contigs. The comment has the tags RX, BC, CB, MI, cD.
    """
    has = set(consensus.columns)
    part = {c: F.col(c) if c in has else F.lit(1) for c in ("contig", "contigs", "molecule", "molecules")}
    cell = F.when(F.length("cell") > 0, F.col("cell")) if "cell" in has else F.lit(None).cast("string")
    suffix = [F.when(part["contigs"] > 1, F.concat(F.lit("c"), part["contig"].cast("string"))), F.when(part["molecules"] > part["contigs"], part["molecule"].cast("string"))]
    name = F.concat_ws(".", "sample_id", cell, "umi", *suffix)
    depth = F.col("reads").cast("string")
    comment = F.concat_ws("\t", F.concat(F.lit("RX:Z:"), "umi"), F.concat(F.lit("BC:Z:"), "sample_id"), F.concat(F.lit("CB:Z:"), cell), F.concat(F.lit("MI:Z:"), name), F.concat(F.lit("cD:i:"), depth))
    return consensus.withColumns({"name": name, "comment": comment})


def base_usage(reads: DataFrame) -> DataFrame:
    """(sample_id, groups, barcode_space, occupancy, expected_molecules): over distinct (cell, barcode) groups, barcode positions only.

    The expected number of molecules in a group that has one at least; occupancy is taken as 0.99 where the space is full.
    """
    from .barcodes import composition, information

    groups = reads.filter(F.length("umi") > 0).select("sample_id", "cell", "umi").distinct()
    space = information(composition(groups.select("sample_id", F.col("umi").alias("key"), F.lit(1).alias("cnt")))).select("sample_id", F.col("effective_space").alias("barcode_space"))
    n = groups.groupBy("sample_id").agg(F.count("*").alias("groups"))
    occupancy = F.least(F.lit(0.99), F.col("groups") / F.col("barcode_space"))
    rate = -F.log(1 - F.col("occupancy"))
    return n.join(space, "sample_id").withColumn("occupancy", occupancy).withColumn("expected_molecules", F.when(rate > 0, rate / (1 - F.exp(-rate))).otherwise(1.0))


PRE_AMP = {"rt": 1e-4, "medium": 1e-5, "high": 1e-6}


def parse_pre_amp(text: str) -> float | None:
    """An error rate before amplification by name or number; None for ``auto``."""
    if text == "auto":
        return None
    rate = PRE_AMP.get(text)
    try:
        rate = float(text) if rate is None else rate
    except ValueError:
        raise ValueError(f"pre-amplification error {text!r}: auto, {', '.join(PRE_AMP)} or a number") from None
    if not 0 < rate < 1:
        raise ValueError(f"pre-amplification error {text!r}: a number between 0 and 1 is needed")
    return rate


DEEP, LEAST_MOLECULES, LEAST_BASES = 20, 100, 100_000
MINOR_SHARE, DIVERGENT, RATES = 0.01, 0.05, (1e-7, 1e-2)


def pre_amp_floor(consensus: DataFrame, fallback: float = FLOOR) -> DataFrame:
    """(sample_id, used, rate, ci_lo, ci_hi, mismatches, bases, molecules_scored, molecules_deep, length, positions_scored, positions_polymorphic, fallback, reason).

    Deep molecules of the commonest length are compared with the commonest base of each
    position. Positions where another base has a hundredth or more are polymorphic and
    left out; molecules that differ in a twentieth of the rest are strangers. The rate is
    the upper limit where nothing differs. Without enough evidence the fallback is used, and why.
    """
    from ..functions.bases import poisson_interval

    # One pass over the molecules: deep ones that are alike are one row and their number, all others one row a sample.
    counted = consensus.groupBy("sample_id", F.when(F.col("reads") >= DEEP, F.col("seq")).alias("seq"), (F.col("reads") >= DEEP).alias("deep")).agg(F.count("*").alias("molecules"))
    counted = written(counted, "deep")
    deep = counted.filter("deep").select("sample_id", "seq", F.length("seq").alias("length"), "molecules")
    lengths = deep.groupBy("sample_id", "length").agg(F.sum("molecules").alias("n")).groupBy("sample_id").agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("length"), F.sum("n").alias("molecules_deep"))
    of_length = deep.join(lengths, ["sample_id", "length"])
    places = of_length.select("sample_id", "seq", "molecules", F.posexplode(F.split("seq", "")).alias("position", "base")).filter(F.col("base").isin("A", "C", "G", "T"))
    tally = places.groupBy("sample_id", "position", "base").agg(F.sum("molecules").alias("n"))
    whole = Window.partitionBy("sample_id", "position")
    major = tally.withColumn("_all", F.sum("n").over(whole)).groupBy("sample_id", "position").agg(F.max_by("base", F.struct("n", -F.ascii("base"))).alias("major"), (1 - F.max("n") / F.max("_all")).alias("minor"))
    scored = major.filter(F.col("minor") < MINOR_SHARE)
    kinds = major.groupBy("sample_id").agg(F.count_if(F.col("minor") < MINOR_SHARE).alias("positions_scored"), F.count_if(F.col("minor") >= MINOR_SHARE).alias("positions_polymorphic"))
    per = places.join(scored, ["sample_id", "position"]).groupBy("sample_id", "seq", "molecules").agg(F.count("*").alias("b"), F.count_if(F.col("base") != F.col("major")).alias("x")).filter(F.col("x") <= DIVERGENT * F.col("b"))
    sums = per.groupBy("sample_id").agg(F.sum("molecules").alias("molecules_scored"), F.sum(F.col("molecules") * F.col("b")).alias("bases"), F.sum(F.col("molecules") * F.col("x")).alias("mismatches"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("molecules_deep", "molecules_scored", "bases", "mismatches", "positions_scored", "positions_polymorphic")}
    out = counted.select("sample_id").distinct().join(lengths, "sample_id", "left").join(kinds, "sample_id", "left").join(sums, "sample_id", "left").withColumns(zero)
    low, high = (x / F.col("bases") for x in poisson_interval(F.col("mismatches")))
    out = out.withColumns({"ci_lo": F.when(F.col("bases") > 0, low), "ci_hi": F.when(F.col("bases") > 0, high)})
    rate = F.when(F.col("mismatches") > 0, F.col("mismatches") / F.col("bases")).otherwise(F.col("ci_hi"))
    reason = (
        F.when(F.col("molecules_deep") < LEAST_MOLECULES, "too few deep molecules").when(2 * F.col("positions_scored") < F.col("length"), "too many polymorphic positions")
        .when(F.col("molecules_scored") < LEAST_MOLECULES, "too few molecules alike").when(F.col("bases") < LEAST_BASES, "too few bases").when(~rate.between(*RATES), "rate out of range")
    )
    out = out.withColumn("reason", reason).withColumn("rate", F.when(F.col("reason").isNull(), rate))
    return out.select("sample_id", F.coalesce("rate", F.lit(fallback)).alias("used"), "rate", "ci_lo", "ci_hi", "mismatches", "bases", "molecules_scored", "molecules_deep", "length", "positions_scored", "positions_polymorphic", F.col("reason").isNotNull().alias("fallback"), "reason")


def check_options(fast_mode: bool = False, contig: bool = False, merge: bool = False, mate2: bool = False, limit: int | None = None, from_counts: bool = False) -> None:
    """Options of a consensus that exclude each other raise."""
    if fast_mode and (contig or merge):
        raise ValueError("the fast consensus knows neither contigs nor merged mates")
    if mate2 and not merge:
        raise ValueError("second mates are given but are not to be merged")
    if limit is not None and from_counts:
        raise ValueError("a limit holds for reads, not for corrected tables")
