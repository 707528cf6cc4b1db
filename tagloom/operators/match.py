"""Finding layouts in reads and assigning reads to samples.

A position's score is the log2 odds of its base at its quality against chance, in single
precision and summed in double, so that sums are exact and ties are ties. The sheet of
layouts is data, not part of the plan: a map over Arrow batches looks up every kind of
position once for all reads of a batch, and a layout's scores at all offsets are sums of
shifted columns of these. One plan serves one sample or a thousand; nothing is shuffled.

Defined cases: a read without a quality counts as ``UNQUALIFIED`` throughout; where a quality is
shorter than its read, the rest counts as Phred 0; a null read is an empty one and matches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bases import PHRED_MAX, PHRED_OFFSET, phreds
from ..plans.layout import MAX_CAPTURE, Layout, compile_layout

ALPHA = 0.01
SAMPLE_MARGIN = 5.0
UNQUALIFIED = 30
CELLS = 1 << 20  # letters of reads scored at once

_LEVELS = PHRED_MAX + 1
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
_TURNED = np.full(256, ord("N"), np.uint8)
for _a, _b in zip(b"ACGTacgtNn", b"TGCAtgcaNn"):
    _TURNED[_a] = _b

MATCH = "found boolean, offset int, score double, margin double, umi string, umi_qual string, cell string, cell_qual string, payload_begin int"
_FIELDS = [pa.field(n, t) for n, t in zip(("found", "offset", "score", "margin", "umi", "umi_qual", "cell", "cell_qual", "payload_begin"), (pa.bool_(), pa.int32(), pa.float64(), pa.float64(), *[pa.string()] * 4, pa.int32()))]


def _error(q: int) -> float:
    return 10.0 ** (-q / 10)


def position_bits(bases: str, weight: float) -> np.ndarray:
    """Scores of a position by base (A, C, G, T, other) and Phred value."""
    n = len(bases)
    hit = [(1 - _error(q)) / n + (n - 1) * _error(q) / (3 * n) for q in range(_LEVELS)]
    hit = np.array([math.log2(4 * p) if p > 0 else -math.inf for p in hit], np.float32)
    miss = np.array([math.log2(4 * max(_error(q), 1e-6) / 3) for q in range(_LEVELS)], np.float32)
    return np.stack([hit.astype(float) if b in bases else weight * miss.astype(float) for b in "ACGT-"])


class Sheet:
    """Layouts, and the kinds of scored positions that they have among them."""

    def __init__(self, layouts: list[Layout | str], max_offset: int = -1):
        self.layouts = [compile_layout(x) if isinstance(x, str) else x for x in layouts]
        self.max_offset = max_offset
        kinds: dict[tuple[str, float], int] = {}
        self.scored = [[(i, kinds.setdefault((p.bases, p.weight), len(kinds))) for i, p in enumerate(x.positions) if p.kind == "scored"] for x in self.layouts]
        self.bits = [position_bits(*kind).ravel() for kind in kinds]
        self.widest = max(len(x.positions) for x in self.layouts)
        for x in self.layouts:
            if x.positional and max_offset != 0:
                raise ValueError(f"layout {x.text!r} has no scored position, so a scan cannot place it")


class Letters:
    """Reads as rows of letters and of quality marks, padded; ``qualified`` where a read has a quality."""

    def __init__(self, seqs: pa.Array, quals: pa.Array):
        self.seq, self.length = _bytes(seqs)
        self.qual, n = _bytes(quals)
        self.qualified = n > 0
        self.at, self.q_at, self.q_length = np.cumsum(self.length) - self.length, np.cumsum(n) - n, n

    def rows(self, some: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(letters, marks) of ``some`` reads, ``width`` columns; 0 beyond a read, ``!`` beyond its quality."""
        return _padded(self.seq, self.at[some], self.length[some], width, 0), np.where(self.qualified[some][:, None], _padded(self.qual, self.q_at[some], self.q_length[some], width, PHRED_OFFSET), UNQUALIFIED + PHRED_OFFSET).astype(np.uint8)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all letters in a row, each text's length); letters outside ASCII are question marks."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if not pc.all(pc.equal(pc.binary_length(column), pc.utf8_length(column))).as_py() and len(column):
        column = pa.array([s.encode("ascii", "replace").decode() for s in column.to_pylist()], pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)), np.diff(offsets)


def _padded(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, width: int, fill: int) -> np.ndarray:
    columns = np.arange(width)
    inside = columns < lengths[:, None]
    if not len(data):
        return np.full(inside.shape, fill, np.uint8)
    return np.where(inside, data[np.minimum(begin[:, None] + columns, len(data) - 1)], fill).astype(np.uint8)


class Found:
    """Of each read: the layout found (-1: none), whether two came too close, and where it is."""

    def __init__(self, n: int):
        self.layout, self.close = np.full(n, -1), np.zeros(n, bool)
        self.offset, self.score, self.margin = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.text = {k: np.full(n, None, object) for k in ("umi", "umi_qual", "cell", "cell_qual")}
        self.end = np.zeros(n, np.int64)

    def put(self, rows: np.ndarray, other: Found, its: np.ndarray) -> None:
        for mine, theirs in zip(self._arrays(), other._arrays()):
            mine[rows] = theirs[its]

    def _arrays(self) -> list[np.ndarray]:
        return [self.layout, self.close, self.offset, self.score, self.margin, self.end, *self.text.values()]

    def structs(self, null: bool = False) -> pa.StructArray:
        """As the struct ``MATCH``; without a match all but ``found`` is null, or the struct itself."""
        none = self.layout < 0
        numbers = [pa.array(v, t, mask=none) for v, t in ((self.offset, pa.int32()), (self.score, pa.float64()), (self.margin, pa.float64()))]
        texts = [pa.array(v.tolist(), pa.string(), mask=none) for v in self.text.values()]
        return pa.StructArray.from_arrays([pa.array(~none), *numbers, *texts, pa.array(self.end, pa.int32(), mask=none)], fields=_FIELDS, mask=pa.array(none) if null else None)


def find(sheet: Sheet, reads: Letters, min_margin: float = 0.0, sample_margin: float = 0.0, n_layouts: int | None = None) -> Found:
    """The best layout of the sheet in each read.

    A layout's best offset (of equal ones the first) must reach the bar at which a chance match is
    expected in one per cent of reads, over all offsets and layouts, and beat its runner-up by ``min_margin``.
    Of equal layouts the first is best; it must beat the next by ``sample_margin``.
    """
    n = len(reads.length)
    out = Found(n)
    n_layouts = n_layouts or len(sheet.layouts)
    most = sheet.widest + sheet.max_offset if sheet.max_offset >= 0 else int(reads.length.max(initial=0))
    order = np.argsort(reads.length, kind="stable")  # long reads among themselves
    at = 0
    while at < n:
        step = max(1, CELLS // max(1, min(int(reads.length[order[min(n - 1, at + CELLS // max(1, sheet.widest))]]), most)))
        some = order[at : at + step]
        at += step
        _find(sheet, reads, some, max(1, min(most, int(reads.length[some].max()))), out, min_margin, sample_margin, n_layouts)
    return out


def _find(sheet: Sheet, reads: Letters, some: np.ndarray, width: int, out: Found, min_margin: float, sample_margin: float, n_layouts: int) -> None:
    letters, marks = reads.rows(some, width)
    cell = _CODE[letters].astype(np.int64) * _LEVELS + np.clip(marks.astype(np.int64) - PHRED_OFFSET, 0, PHRED_MAX)
    bits: dict[int, np.ndarray] = {}
    best, second = np.full(len(some), -np.inf), np.full(len(some), -np.inf)
    layout, offset, margin = np.full(len(some), -1), np.zeros(len(some), np.int64), np.zeros(len(some))
    rows = np.arange(len(some))
    for number, (one, scored) in enumerate(zip(sheet.layouts, sheet.scored)):
        last = reads.length[some] - len(one.positions)
        if sheet.max_offset >= 0:
            last = np.minimum(last, sheet.max_offset)
        offsets = min(int(last.max()), width - len(one.positions)) + 1
        if offsets < 1:
            continue
        scores = np.zeros((len(some), offsets))
        for i, kind in scored:
            if kind not in bits:
                bits[kind] = sheet.bits[kind][cell]
            scores += bits[kind][:, i : i + offsets]
        scores[np.arange(offsets) > last[:, None]] = -np.inf
        first = scores.argmax(axis=1)
        top = scores[rows, first]
        scores[rows, first] = -np.inf
        next_ = scores.max(axis=1)
        ahead = np.where(np.isfinite(next_), top - np.where(np.isfinite(next_), next_, 0), top)
        ok = last >= 0
        if scored:
            ok &= (top >= np.log2((np.maximum(last, 0) + 1.0) * n_layouts / ALPHA)) & (ahead >= min_margin)
        better = ok & (top > best)
        second = np.where(better, best, np.where(ok & (top > second), top, second))
        best, layout, offset, margin = np.where(better, top, best), np.where(better, number, layout), np.where(better, first, offset), np.where(better, ahead, margin)
    close = (layout >= 0) & np.isfinite(second) & (best - np.where(np.isfinite(second), second, 0) < sample_margin)
    layout = np.where(close, -1, layout)
    out.layout[some], out.close[some], out.offset[some], out.score[some], out.margin[some] = layout, close, offset, best, margin
    for number in np.unique(layout[layout >= 0]):
        one, mine = sheet.layouts[number], np.flatnonzero(layout == number)
        out.end[some[mine]] = offset[mine] + len(one.positions)
        for kind in ("umi", "cell"):
            places = offset[mine][:, None] + np.array(one.places(kind), np.int64)
            for name, text in ((kind, letters), (f"{kind}_qual", marks)):
                picked = np.ascontiguousarray(text[mine[:, None], places])
                out.text[name][some[mine]] = picked.view(f"S{picked.shape[1]}").ravel().astype(str) if picked.size else ""


def _mapped(reads: DataFrame, added: str, run, *columns: str) -> DataFrame:
    """``reads`` with the columns ``added``, that ``run(*columns of a batch)`` gives; any that had these names are replaced."""
    extra = StructType.fromDDL(added)
    kept = [c for c in reads.columns if c not in extra.fieldNames()]
    inner = reads.select(*kept)
    schema = StructType([*inner.schema.fields, *extra.fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = run(*(batch.column(batch.schema.get_field_index(c)) for c in columns))
            old = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_arrays([changed.get(n, old.get(n)) for n in schema.fieldNames()], schema.fieldNames())

    return inner.mapInArrow(go, schema)


def match(reads: DataFrame, layout: Layout | str, max_offset: int = -1, min_margin: float = 0.0, name: str = "match", seq: str = "seq", qual: str = "qual", n_layouts: int = 1) -> DataFrame:
    """``reads`` with ``name``: struct(found, offset, score, margin, umi, umi_qual, cell, cell_qual, payload_begin).

    The best offset must reach the bar and beat the runner-up by ``min_margin``; of
    equal offsets the first wins. A layout without scored positions is only placed
    at the start, and then always found.
    """
    sheet = Sheet([layout], max_offset)
    return _mapped(reads, f"`{name}` struct<{_struct_ddl()}>", lambda s, q: {name: find(sheet, Letters(s, q), min_margin, n_layouts=n_layouts).structs()}, seq, qual)


def _struct_ddl() -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.split() for x in MATCH.split(", ")))


def _status(found: Found) -> np.ndarray:
    return np.where(found.layout >= 0, "assigned", np.where(found.close, "ambiguous", "unmatched"))


def assign(reads: DataFrame, sheet: dict[str, str], max_offset: int = -1) -> DataFrame:
    """``reads`` with status (assigned, ambiguous or unmatched), sample and its match.

    The best sample must beat the next accepted one by ``SAMPLE_MARGIN`` bits.
    """
    names, compiled = np.array([*sheet, None], object), Sheet(list(sheet.values()), max_offset)

    def run(s, q):
        found = find(compiled, Letters(s, q), sample_margin=SAMPLE_MARGIN)
        return {"status": pa.array(_status(found).tolist(), pa.string()), "sample": pa.array(names[found.layout].tolist(), pa.string()), "match": found.structs(null=True)}

    return _mapped(reads, f"status string, sample string, match struct<{_struct_ddl()}>", run, "seq", "qual")


def _turn(seqs: pa.Array, quals: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Reverse complements; letters that are no bases become N."""
    turned = [None if s is None else _TURNED[np.frombuffer(s.encode("ascii", "replace"), np.uint8)[::-1]].tobytes().decode() for s in seqs.to_pylist()]
    return pa.array(turned, pa.string()), pa.array([None if q is None else q[::-1] for q in quals.to_pylist()], pa.string())


def _turned_where(rows: np.ndarray, seqs: pa.Array, quals: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Both columns with ``rows`` turned round."""
    at = pa.array(rows)
    mask = np.zeros(len(seqs), bool)
    mask[rows] = True
    turned = _turn(seqs.take(at), quals.take(at))
    return tuple(pc.replace_with_mask(c.cast(pa.string()), pa.array(mask), t) for c, t in zip((seqs, quals), turned))


def either_strand(reads: DataFrame, layout: Layout | str, max_offset: int = -1) -> DataFrame:
    """``reads`` with the match on the read or, if there is none, on its reverse complement (strand + or -)."""
    sheet = Sheet([layout], max_offset)

    def run(s, q):
        found = find(sheet, Letters(s, q))
        strand = np.where(found.layout >= 0, "+", None)
        rest = np.flatnonzero(found.layout < 0)
        other = find(sheet, Letters(*_turn(s.take(pa.array(rest)), q.take(pa.array(rest)))))
        found.put(rest, other, np.arange(len(rest)))
        strand[rest[other.layout >= 0]] = "-"
        return {"strand": pa.array(strand.tolist(), pa.string()), "match": found.structs()}

    return _mapped(reads, f"strand string, match struct<{_struct_ddl()}>", run, "seq", "qual")


def demultiplex(reads: DataFrame, sheet: list[dict], max_offset: int = -1) -> DataFrame:
    """``reads`` (seq, qual, with seq2 and qual2 if paired) assigned to the samples of ``sheet``, in one orientation.

    A sheet's rows have a sample, a pattern and perhaps a slave, a layout on the other mate; several
    rows may name one sample. Where the first mate shows no sample, and not two that are too
    close either, the second mate is tried and then the two are swapped; a read without mates is
    tried as its reverse complement and then turned round. A sample's slave must be found on the other mate, ahead of its
    runner-up; its barcode is appended. Adds status, sample, normalised and match.
    """
    paired = "seq2" in reads.columns
    masters = Sheet([r["pattern"] for r in sheet], max_offset)
    names = np.array([*(r["sample"] for r in sheet), None], object)
    slaves = {i: Sheet([r["slave"]], max_offset) for i, r in enumerate(sheet) if r.get("slave")}
    if slaves and not paired:
        raise ValueError(f"sample {sheet[min(slaves)]['sample']!r} has a slave barcode, which needs a second mate")
    for i, slave in slaves.items():
        _check_captured(masters.layouts[i], slave.layouts[0])

    def run(s, q, *mates):
        found = find(masters, Letters(s, q), sample_margin=SAMPLE_MARGIN)
        rest = np.flatnonzero((found.layout < 0) & ~found.close)
        at = pa.array(rest)
        other = find(masters, Letters(*(c.take(at) for c in mates) if paired else _turn(s.take(at), q.take(at))), sample_margin=SAMPLE_MARGIN)
        got = np.flatnonzero(other.layout >= 0)
        found.put(rest[got], other, got)
        normalised = np.zeros(len(s), bool)
        normalised[rest[got]] = True
        if paired:
            swapped = pa.array(normalised)
            columns = [pc.if_else(swapped, a, b) for a, b in zip((mates[0], mates[1], s, q), (s, q, *mates))]
        else:
            columns = list(_turned_where(rest[got], s, q))
        for i, slave in slaves.items():
            mine = np.flatnonzero(found.layout == i)
            second = find(slave, Letters(*(c.take(pa.array(mine)) for c in columns[2:])), min_margin=SAMPLE_MARGIN)
            for k in ("umi", "umi_qual"):
                found.text[k][mine] = [a + b if b is not None else a for a, b in zip(found.text[k][mine], second.text[k])]
            found.layout[mine[second.layout < 0]] = -1
        new = {"status": pa.array(_status(found).tolist(), pa.string()), "sample": pa.array(names[found.layout].tolist(), pa.string()), "normalised": pa.array(normalised & (found.layout >= 0)), "match": found.structs(null=True)}
        return new | dict(zip(("seq", "qual", "seq2", "qual2"), columns))

    return _mapped(reads, f"status string, sample string, normalised boolean, match struct<{_struct_ddl()}>", run, "seq", "qual", *["seq2", "qual2"] * paired)


def _check_captured(master: Layout, slave: Layout) -> None:
    captured = len(master.places("umi")) + len(master.places("cell")) + len(slave.places("umi"))
    if captured > MAX_CAPTURE:
        raise ValueError(f"the layouts capture {captured} bases together; at most {MAX_CAPTURE} fit")


def dual(pairs: DataFrame, master: Layout | str, slave: Layout | str, max_offset: int = -1, min_margin: float = 0.0) -> DataFrame:
    """``pairs`` (seq, qual, seq2, qual2) with the match of two layouts, one on each mate.

    Both must be found. The barcode is the master's, then the slave's; the cell is
    the master's. Together they capture 32 bases at most.
    """
    one, two = Sheet([master], max_offset), Sheet([slave], max_offset)
    _check_captured(one.layouts[0], two.layouts[0])

    def run(s, q, s2, q2):
        found, second = find(one, Letters(s, q)), find(two, Letters(s2, q2), min_margin)
        found.layout[second.layout < 0] = -1
        for k in ("umi", "umi_qual"):
            found.text[k] = np.array([None if a is None or b is None else a + b for a, b in zip(found.text[k], second.text[k])], object)
        return {"match": found.structs()}

    return _mapped(pairs, f"match struct<{_struct_ddl()}>", run, "seq", "qual", "seq2", "qual2")


def calibration(reads: DataFrame, layout: Layout | str, max_offset: int = -1) -> DataFrame:
    """(position, phred, bases, mismatches) over the unambiguous scored positions of found layouts; tallied in tasks, a few rows a batch."""
    sheet = Sheet([layout], max_offset)
    sites = [(i, "ACGT".index(p.bases)) for i, p in enumerate(sheet.layouts[0].positions) if p.kind == "scored" and len(p.bases) == 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column(0), batch.column(1))
            found = find(sheet, letters)
            some, rows = np.flatnonzero(found.layout >= 0), []
            for i, want in sites:
                at = found.offset[some] + i
                codes = _CODE[letters.seq[letters.at[some] + at]]
                own = letters.qualified[some] & (at < letters.q_length[some])
                marks = np.where(own, letters.qual[np.minimum(letters.q_at[some] + at, max(len(letters.qual) - 1, 0))].astype(np.int64) if len(letters.qual) else 0, PHRED_OFFSET)
                marks = np.where(letters.qualified[some], marks, UNQUALIFIED + PHRED_OFFSET)
                q, known = np.clip(marks - PHRED_OFFSET, 0, PHRED_MAX), codes < 4
                bases, bad = np.bincount(q[known], minlength=_LEVELS), np.bincount(q[known & (codes != want)], minlength=_LEVELS)
                rows += [(i, int(x), int(bases[x]), int(bad[x])) for x in np.flatnonzero(bases)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["position", "phred", "bases", "mismatches"])

    counted = reads.select("seq", "qual").mapInArrow(run, "position int, phred int, bases long, mismatches long")
    return counted.groupBy("position", "phred").agg(F.sum("bases").alias("bases"), F.sum("mismatches").alias("mismatches"))


MIN_BASES = 1000
ODD_POSITION = 5.0


def fit_calibration(tallied: DataFrame) -> DataFrame:
    """(slope, intercept, qualities): observed error as a line in the nominal one, weighted by bases.

    Positions with many times the median error are primer defects and are left out;
    two well-filled qualities are needed, and neither number is negative.
    """
    per_position = tallied.groupBy("position").agg(F.sum("bases").alias("n"), F.sum("mismatches").alias("bad"))
    rates = per_position.filter(F.col("n") >= MIN_BASES).withColumn("rate", F.col("bad") / F.col("n"))
    ordered = rates.agg(F.array_sort(F.collect_list("rate")).alias("r"))
    middle = ordered.select(F.get("r", F.floor(F.size("r") / 2).cast("int")).alias("median"))
    odd = rates.join(middle, F.col("rate") > ODD_POSITION * F.col("median")).select("position")  # a row per layout position, and one
    kept = tallied.join(odd, "position", "left_anti").groupBy("phred").agg(F.sum("bases").alias("w"), F.sum("mismatches").alias("bad")).filter(F.col("w") >= MIN_BASES)
    x, y, w = F.pow(F.lit(10.0), -F.col("phred") / 10), F.col("bad") / F.col("w"), F.col("w")
    s = kept.agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.count("*").alias("qualities"))
    d = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("qualities") >= 2) & (d > 0), (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / d)
    slope = F.when(slope.isNotNull(), F.greatest(slope, F.lit(0.0)))  # greatest passes over nulls: no fit stays no fit
    return s.select(slope.alias("slope"), F.when(slope.isNotNull(), F.greatest((F.col("sy") - slope * F.col("sx")) / F.col("sw"), F.lit(0.0))).alias("intercept"), "qualities")


def calibrated(tallied: DataFrame, fitted: DataFrame) -> DataFrame:
    """(phred, bases, mismatches, observed, nominal, calibrated): each quality with the error that the fit gives it, the nominal one without a fit.

    The fit's intercept is the primer's own defects, so only its slope applies to reads.
    """
    per = tallied.groupBy("phred").agg(F.sum("bases").alias("bases"), F.sum("mismatches").alias("mismatches"))
    nominal = F.pow(F.lit(10.0), -F.col("phred") / 10)
    line = F.least(F.greatest(F.col("slope") * nominal, F.lit(1e-7)), F.lit(0.75))
    one = per.withColumn("_one", F.lit(1)).join(fitted.withColumn("_one", F.lit(1)), "_one")
    return one.select("phred", "bases", "mismatches", (F.col("mismatches") / F.col("bases")).alias("observed"), nominal.alias("nominal"), F.coalesce(line, nominal).alias("calibrated"))


def verdicts(matched: DataFrame, min_umi_quality: int = 0, min_payload: int = 0, reject_n: bool = False) -> DataFrame:
    """``matched`` with a verdict: unmatched, bad_umi, short_payload or kept.

    A barcode is judged by its worst base. The payload is what the read has after
    the layout, with the whole of the mate where there is one.
    """
    m = F.col("match")
    bad = (F.array_min(phreds("match.umi_qual")) < min_umi_quality) | (F.lit(reject_n) & F.contains(m["umi"], F.lit("N")))
    payload = F.length("seq") - m["payload_begin"]
    if "seq2" in matched.columns:
        payload = payload + F.length(F.coalesce("seq2", F.lit("")))
    verdict = F.when(~m["found"], "unmatched").when(F.coalesce(bad, F.lit(False)), "bad_umi").when(payload < min_payload, "short_payload").otherwise("kept")
    return matched.withColumn("verdict", verdict)


def trimmed(matched: DataFrame) -> DataFrame:
    """``matched`` with seq and qual cut to the payload."""
    begin = F.col("match.payload_begin") + 1
    return matched.withColumns({c: F.when(F.col("match.found"), F.substring(F.col(c), begin, F.length(c))).otherwise(F.col(c)) for c in ("seq", "qual")})
