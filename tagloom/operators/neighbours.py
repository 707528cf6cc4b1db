"""Barcodes that differ in one place.

Every barcode is listed once under each of its blocks of six places, with the letters
outside the block. Barcodes at distance one share exactly one such group, and a group has
at most as many of them as a block has words, so the work is a sixth of L times the rows
and no key can be hot. Within a group numpy finds the pairs, and what a query asks of a
pair is asked there: pairs that it has no use for never leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_BOUNDS = (1e-8, 0.2)
STEPS = 60
BLOCK = 6
GROUP = ("rest", "at", "size", "sample_id")

#: Columns of the barcodes on one side of some pairs, as numpy arrays.
Side = dict[str, np.ndarray]


def _begins(rows: pa.RecordBatch) -> np.ndarray:
    """Whether a group begins at each row."""
    out = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        differs = np.zeros(rows.num_rows - 1, bool)
        for name in GROUP:
            c = rows.column(name)
            one, other = c.slice(0, len(c) - 1), c.slice(1)
            differs |= pc.fill_null(pc.not_equal(one, other), True).to_numpy(zero_copy_only=False) & ~(pc.is_null(one).to_numpy(zero_copy_only=False) & pc.is_null(other).to_numpy(zero_copy_only=False))
        out[1:] = differs
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in pieces that end where a group ends, with the group's number at each row."""
    held = None
    for batch in batches:
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        if not rows.num_rows:
            continue
        begins = _begins(rows)
        cut = int(np.flatnonzero(begins)[-1])
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut), np.cumsum(begins[:cut]) - 1
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)


def _letters(words: pa.Array) -> np.ndarray:
    """Rows x ``BLOCK`` bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(words), BLOCK)


def _pairs(letters: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, place): rows of one group that differ in one place only, each pair once."""
    used = np.bincount(letters.ravel(), minlength=256) > 0
    bits = max(int(used.sum() - 1).bit_length(), 1)
    code = (np.cumsum(used) - 1)[letters].astype(np.int64)
    word = (code << (bits * np.arange(BLOCK))).sum(axis=1)
    if int(group[-1]).bit_length() + bits * BLOCK > 62:  # of more than a few letters: halves of the groups are gone through apart
        middle = int(np.searchsorted(group, group[-1] // 2 + 1))
        one, other = _pairs(letters[:middle], group[:middle]), _pairs(letters[middle:], group[middle:] - group[middle])
        return tuple(np.concatenate([x, y + middle * (k < 2)]) for k, (x, y) in enumerate(zip(one, other)))
    word |= group << (bits * BLOCK)
    found = []
    for place in range(BLOCK):
        masked = word & ~(((1 << bits) - 1) << (bits * place))
        order = np.argsort(masked)
        masked = masked[order]
        for apart in range(1, len(order)):
            same = np.flatnonzero(masked[apart:] == masked[:-apart])
            if not len(same):
                break
            i, j = order[same], order[same + apart]
            differ = word[i] != word[j]
            found.append((i[differ], j[differ], np.full(int(differ.sum()), place, np.int64)))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*found)) or [()] * 3))


def in_groups(barcodes: DataFrame, carry: tuple[str, ...], run: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """``run(rows, i, j, pos)`` over pieces of whole groups: rows with sample_id, key and ``carry``, numbers of the rows of each pair, and the place, from 1, in which these differ."""
    blocks = F.sequence(F.lit(0), F.length("key") - 1, F.lit(BLOCK))
    listed = barcodes.filter(F.length("key") > 0).select("sample_id", "key", *carry, F.explode(blocks).alias("at"))
    rest = F.concat(F.substring("key", F.lit(1), F.col("at")), F.substring(F.col("key"), F.col("at") + BLOCK + 1, F.length("key")))
    listed = listed.select("sample_id", "at", F.length("key").alias("size"), rest.alias("rest"), F.substring(F.col("key"), F.col("at") + 1, F.lit(BLOCK)).alias("part"), *carry)
    rows = listed.repartition(*GROUP).sortWithinPartitions(*GROUP)
    key = F.concat(F.substring("rest", F.lit(1), F.col("at")), "part", F.substring(F.col("rest"), F.col("at") + 1, F.col("size")))
    rows = rows.select(*GROUP, F.rpad("part", BLOCK, " ").alias("part"), key.alias("key"), *carry)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, group in _whole_groups(batches):
            i, j, place = _pairs(_letters(piece.column("part")), group)
            if len(i):
                out = run(piece, i, j, (piece.column("at").to_numpy()[i] + place + 1).astype(np.int32))
                if out is not None and out.num_rows:
                    yield out

    return rows.mapInArrow(go, schema)


def _side(rows: pa.RecordBatch, carry: tuple[str, ...], at: np.ndarray) -> Side:
    return {c: rows.column(c).to_numpy(zero_copy_only=False)[at] for c in carry}


def neighbour_pairs(barcodes: DataFrame, *carry: str, keep: Callable[[Side, Side], np.ndarray] | None = None, once: bool = False) -> DataFrame:
    """(sample_id, pos, a, b): ordered pairs, each of both ways; a and b are struct(key, carry...).

    ``keep`` says of carried numbers of a and b which pairs are wanted; ``once`` gives each pair one way only.
    """
    names = ("key", *carry)
    types = dict(barcodes.dtypes)
    side = f"struct<{', '.join(f'`{c}`: {types[c]}' for c in names)}>"

    def run(rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray, pos: np.ndarray) -> pa.RecordBatch | None:
        if not once:
            i, j, pos = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([pos, pos])
        if keep is not None:
            wanted = keep(_side(rows, carry, i), _side(rows, carry, j))
            i, j, pos = i[wanted], j[wanted], pos[wanted]
        a, b = (pa.StructArray.from_arrays([rows.column(c).take(pa.array(at)) for c in names], names) for at in (i, j))
        return pa.RecordBatch.from_arrays([rows.column("sample_id").take(pa.array(i)), pa.array(pos), a, b], ["sample_id", "pos", "a", "b"])

    return in_groups(barcodes, carry, run, f"sample_id {types['sample_id']}, pos int, a {side}, b {side}")


def pair_counts(barcodes: DataFrame, *carry: str, **tests: Callable[[Side, Side], np.ndarray]) -> DataFrame:
    """(sample_id, pairs, tests...): unordered pairs at distance one, and how many of them pass each test of their carried numbers. Counted in tasks: no pair moves."""
    names = ("pairs", *tests)

    def run(rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        samples = rows.column("sample_id").dictionary_encode(null_encoding="encode")
        which, n = samples.indices.to_numpy()[i], len(samples.dictionary)
        a, b = _side(rows, carry, i), _side(rows, carry, j)
        counts = [np.bincount(which, minlength=n), *(np.bincount(which[test(a, b)], minlength=n) for test in tests.values())]
        return pa.RecordBatch.from_arrays([samples.dictionary, *(pa.array(c.astype(np.int64)) for c in counts)], ["sample_id", *names])

    parts = in_groups(barcodes, carry, run, f"sample_id {dict(barcodes.dtypes)['sample_id']}, {', '.join(f'`{c}` long' for c in names)}")
    return parts.groupBy("sample_id").agg(*(F.sum(c).alias(c) for c in names)).filter("pairs > 0")


def census(barcodes: DataFrame) -> DataFrame:
    """(sample_id, pairs): unordered pairs at distance one."""
    return pair_counts(barcodes)


def solve_error_rate(sizes: list[tuple[int, int]], length: int, excess: float) -> float:
    """The per-base error rate at which barcodes of the given (reads, number) leave ``excess`` pairs at distance one.

    A read miscopies a given place into a given base at a third of the rate; with t
    the chance that some read of a barcode did, 3L(t + t^2) pairs are expected from it.
    """
    if excess <= 0:
        return 0.0

    def expected(rate: float) -> float:
        total = 0.0
        for reads, number in sizes:
            t = -math.expm1(-reads * rate / 3)
            total += number * (t + t * t)
        return 3 * length * total

    low, high = map(math.log, ERROR_BOUNDS)
    if expected(ERROR_BOUNDS[0]) >= excess:
        return ERROR_BOUNDS[0]
    if expected(ERROR_BOUNDS[1]) <= excess:
        return ERROR_BOUNDS[1]
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(math.exp(middle)) < excess else (low, middle)
    return math.exp((low + high) / 2)


def error_rate(counts: DataFrame) -> DataFrame:
    """(sample_id, pairs, chance_pairs, excess, umi_error_rate).

    Pairs and the spectrum of counts are aggregated in Spark; only the spectrum, one
    row per distinct count, is solved on the driver.
    """
    from .barcodes import composition, information

    n = counts.groupBy("sample_id").agg(F.count("*").alias("n"))
    known = information(composition(counts)).join(n, "sample_id").join(census(counts), "sample_id", "left")
    chance = F.col("n") * (F.col("n") - 1) / 2 * F.col("mismatch_ratio") / F.col("effective_space")
    rows = known.select("sample_id", F.col("barcode_length").alias("len"), F.coalesce("pairs", F.lit(0)).alias("pairs"), chance.alias("chance")).collect()
    spectrum: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("sample_id", "cnt").count().collect():
        spectrum.setdefault(r.sample_id, []).append((r.cnt, r["count"]))
    out = [(r.sample_id, r.pairs, r.chance, r.pairs - r.chance, solve_error_rate(sorted(spectrum[r.sample_id]), r.len, r.pairs - r.chance)) for r in rows]
    return counts.sparkSession.createDataFrame(out, "sample_id string, pairs long, chance_pairs double, excess double, umi_error_rate double")
