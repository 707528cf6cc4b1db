"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order fixed by hashes of their rows, are cut into
blocks. Source j, of weight w_j and m_j blocks, is due min(m_j, w_j v) blocks at
stage v of the mixture, where all sources together are due t(v), the number of slots
so far: as a source ends, the others go on in their proportions. Block k of it is
released in slot floor(t((k-1) / w_j)) and due before slot ceil(t(k / w_j)). Every
slot goes to the released block with the earliest deadline (ties to the source that
sorts first). As the due blocks add up to the slots at every time, all deadlines are
met, and no source is ever a whole block from what it is due.

Slots are scheduled in frames, each for itself. Two runs of earliest deadline first
that meet all deadlines agree after the longest window, whatever they began with. A
frame therefore begins as many slots earlier, with the due blocks rounded up for the
earliest deadlines, from which all deadlines can be met. Its state is kept every
``STEP`` slots, and the slots between are scheduled from there. Weights are used as
they are, never rounded; windows within 1e-6 of a whole slot are taken as whole.

Only DataFrame functions are used. Ranks come from hash buckets, whose number grows
with the square root of a source's rows, so a hot source is dealt out like the rest.
Rows that repeat one row more than ``HOT_ROWS`` times are counted and made anew.
Broadcast are the sources, if at most ``MAX_BROADCAST_SOURCES``, and the schedule, if
of at most ``MAX_BROADCAST_SLOTS`` slots; beyond that they are joined by shuffle.

Defined cases: null sources are one source of their own; a source without a given
weight gets the mean of the given ones; weights must be positive; rows that repeat
an id are documents each, and rows that repeat another wholly stand next to each
other; an empty table gives an empty result; ``mix`` replaces columns that clash with
the result's names, ``mixed_order`` keeps all columns as they are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 16
FRAME = 1024
STEP = 256
HOT_ROWS = 100_000
MAX_BROADCAST_SOURCES = 100_000
MAX_BROADCAST_SLOTS = 1_000_000
SALTS = 64
ADDED = ("weight", "block", "release", "deadline", "slot", "slot_row")
NEVER = 1 << 62


def _sources(rows: DataFrame, weights: Mapping[str, float] | None, block_rows: int) -> DataFrame:
    """(_source, _g, rows, weight, blocks): one row per source; _g numbers them as they sort, from 0."""
    counted = rows.groupBy("_source").agg(F.count("*").alias("rows"))
    if weights is None:  # halfway, on a log scale, between even and proportional
        counted = counted.withColumn("w", F.sqrt("rows"))
    else:
        if any(not 0 < w < math.inf for w in weights.values()):
            raise ValueError("weights must be positive")
        mean = sum(weights.values()) / len(weights)
        given = rows.sparkSession.createDataFrame([(n, float(w)) for n, w in weights.items()], "_name string, _w double")
        counted = counted.join(given, F.col("_source") == F.col("_name"), "left").withColumn("w", F.coalesce("_w", F.lit(mean)))
    everything = Window.partitionBy(F.lit(1))
    counted = counted.withColumn("weight", F.col("w") / F.sum("w").over(everything))
    number = F.row_number().over(everything.orderBy(F.asc_nulls_first("_source"))) - 1
    return counted.select("_source", number.alias("_g"), "rows", "weight", F.ceil(F.col("rows") / block_rows).cast("long").alias("blocks"))


def _curves(sources: DataFrame) -> DataFrame:
    """One row (s, phases): the sources, and t(v) = base + rate * v up to each stage at which a source ends."""
    ends = sources.withColumn("end", F.col("blocks") / F.col("weight"))
    by_end = Window.partitionBy(F.lit(1)).orderBy("end")
    later = F.sum("weight").over(by_end.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.sum("blocks").over(by_end.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("blocks").over(Window.partitionBy(F.lit(1), "end"))
    phases = F.struct("end", before.cast("double").alias("base"), later.alias("rate"))
    listed = ends.select(F.struct("_g", "weight", "blocks").alias("s"), phases.alias("p"))
    return listed.agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_set("p")).alias("phases"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: an expression that a lambda names twice is computed twice."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: the optimizer does not copy a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _snapped(x: Column) -> Column:
    return _let(x, lambda y: F.when(F.abs(y - F.round(y)) < 1e-6, F.round(y)).otherwise(y))


def _time(v: Column) -> Column:
    """t(v)."""
    return _let(F.get(F.filter("phases", lambda p: p["end"] >= v), F.lit(0)), lambda p: _snapped(p["base"] + p["rate"] * v))


def _next(source: Column, done: Column) -> Column:
    """The state of a source that has ``done`` blocks: struct(due, i, release, done) of its next block."""
    left = done < source["blocks"]
    release = F.when(~left, NEVER).when(done == 0, 0).otherwise(F.floor(_time(done / source["weight"])))
    due = F.when(left, F.ceil(_time((done + 1) / source["weight"]))).otherwise(NEVER)
    return F.struct(due.cast("long").alias("due"), source["_g"].alias("i"), release.cast("long").alias("release"), done.alias("done"))


def _picked(state: Column, t: Column) -> Column:
    """Number of the source that gets slot ``t``: the earliest deadline among the released blocks."""
    return F.array_min(F.transform(state, lambda e: F.struct((e["release"] > t).alias("late"), e["due"].alias("due"), e["i"].alias("i"))))["i"]


def _after(state: Column, i: Column) -> Column:
    return F.transform(state, lambda e: F.when(e["i"] == i, _let(F.get("s", i), lambda source: _next(source, e["done"] + 1))).otherwise(e))


def _started(frames: DataFrame) -> DataFrame:
    """``frames`` with their state at the slot ``start``: what is due, rounded up for the earliest deadlines."""
    t = F.col("start")
    frames = _held(frames, "_p", F.get(F.filter("phases", lambda p: p["base"] + p["rate"] * p["end"] > t), F.lit(0)))
    due = F.transform("s", lambda e: F.struct(e.alias("e"), _snapped(F.least(e["blocks"].cast("double"), e["weight"] * (t - F.col("_p.base")) / F.col("_p.rate"))).alias("c")))
    frames = _held(frames, "_due", due)
    frames = _held(frames, "_whole", F.transform("_due", lambda x: F.struct(_next(x["e"], F.floor(x["c"])).alias("n"), (x["c"] > F.floor(x["c"])).alias("part"))))
    spare = (t - F.aggregate("_whole", F.lit(0).cast("long"), lambda a, x: a + x["n"]["done"])).cast("int")
    partly = F.array_sort(F.transform(F.filter("_whole", lambda x: x["part"]), lambda x: x["n"]))
    frames = _held(frames, "_up", F.transform(F.slice(partly, F.lit(1), spare), lambda n: n["i"]))
    state = F.transform("_whole", lambda x: F.when(F.array_contains("_up", x["n"]["i"]), _let(F.get("s", x["n"]["i"]), lambda source: _next(source, x["n"]["done"] + 1))).otherwise(x["n"]))
    return _held(frames, "state", state).drop("_p", "_due", "_whole", "_up")


STATE = "array<struct<due:bigint,i:int,release:bigint,done:bigint>>"
PICKS = "array<struct<i:int,block:bigint,release:bigint,due:bigint>>"


def _timetable(sources: DataFrame, n_slots: int, least_weight: float, frame: int, step: int) -> DataFrame:
    """(_g, block, release, deadline, slot): one row per block."""
    longest = min(n_slots, math.ceil(1 / least_weight) + 2)
    frame = max(frame, longest)
    frames = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1), F.lit(frame)))
    frames = _curves(sources).select("s", "phases", frames.alias("begin")).repartition("begin")
    end = F.least(F.col("begin") + frame, F.lit(n_slots))
    start = F.greatest(F.col("begin") - longest, F.lit(0).cast("long"))
    frames = _started(frames.select("*", start.alias("start"), end.alias("end")))

    def on(a, t):
        kept = F.when((t >= F.col("begin")) & ((t - F.col("begin")) % step == 0), F.concat(a["kept"], F.array(F.struct(t.alias("t"), a["state"].alias("state"))))).otherwise(a["kept"])
        return F.struct(_let(_picked(a["state"], t), lambda i: _after(a["state"], i)).alias("state"), kept.alias("kept"))

    none = F.expr(f"cast(array() as array<struct<t:bigint,state:{STATE}>>)")
    run = F.aggregate(F.sequence("start", F.col("end") - 1), F.struct(F.col("state").cast(STATE).alias("state"), none.alias("kept")), on, lambda a: a["kept"])
    kept = frames.select("s", "phases", "end", F.explode(run).alias("k"))
    kept = kept.select("s", "phases", F.col("k.t").alias("begin"), F.col("k.state").alias("state"), F.least("end", F.col("k.t") + step).alias("end"))

    def pick(a, t):
        def taken(i):
            one = _let(F.get(a["state"], i), lambda e: F.struct(i.alias("i"), e["done"].alias("block"), e["release"].alias("release"), e["due"].alias("due")))
            return F.struct(_after(a["state"], i).alias("state"), F.concat(a["picks"], F.array(one)).alias("picks"))

        return _let(_picked(a["state"], t), taken)

    picks = F.aggregate(F.sequence("begin", F.col("end") - 1), F.struct("state", F.expr(f"cast(array() as {PICKS})").alias("picks")), pick, lambda a: a["picks"])
    at = kept.select("begin", F.posexplode(picks).alias("at", "p"))
    return at.select(F.col("p.i").alias("_g"), F.col("p.block").alias("block"), F.col("p.release").alias("release"), F.col("p.due").alias("deadline"), (F.col("begin") + F.col("at")).alias("slot"))


def _ranked(rows: DataFrame, sources: DataFrame, n_sources: int, columns: list[str]) -> DataFrame:
    """``rows`` with _g, weight and _rank, from 0 in their source."""
    known = sources.select("_source", "_g", "rows", "weight")
    same = F.col("_source").eqNullSafe(F.col("_s"))
    rows = rows.withColumn("_h", F.xxhash64(*columns))
    if n_sources <= MAX_BROADCAST_SOURCES:
        dealt = rows.join(F.broadcast(known.withColumnRenamed("_source", "_s")), same)
    else:  # a hot source goes to many tasks
        salted = known.withColumnRenamed("_source", "_s").withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("_u", F.pmod("_h", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_u") == F.col("_t"))).drop("_t", "_u")
    dealt = dealt.drop("_s").withColumn("_bucket", F.pmod(F.xxhash64("_h"), F.ceil(4 * F.sqrt("rows")).cast("long"))).drop("rows")
    sizes = written(dealt.groupBy("_g", "_bucket").agg(F.count("*").alias("n")), "sizes")
    before = F.sum("n").over(Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_g", "_bucket", "n", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_g", "_bucket").orderBy("_h")) - 1
    carried = ["_g", "weight", *columns]
    hot = sizes.filter(F.col("n") > HOT_ROWS).select("_g", "_bucket")  # a row per HOT_ROWS documents at most
    if hot.isEmpty():
        return dealt.withColumn("_in", inside).join(offsets, ["_g", "_bucket"]).select(*carried, (F.col("_before") + F.col("_in")).alias("_rank"))
    many = dealt.join(F.broadcast(hot), ["_g", "_bucket"]).groupBy("_g", "_bucket", "_h", "weight", *columns).agg(F.count("*").alias("m")).filter(F.col("m") > HOT_ROWS // 2)
    many = written(many, "repeated")
    later = F.sum("m").over(Window.partitionBy("_g", "_bucket").orderBy("_h").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # Repeated rows stand at the end of their bucket.
    first = many.withColumn("_later", later).join(offsets, ["_g", "_bucket"]).withColumn("_first", F.col("_before") + F.col("n") - F.col("_later"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / HOT_ROWS)))
    pieces = first.select(*carried, "_first", "m", piece.alias("_piece")).repartition("_g", "_first", "_piece")
    number = F.explode(F.sequence(F.col("_piece") * HOT_ROWS, F.least("m", (F.col("_piece") + 1) * HOT_ROWS) - 1))
    again = pieces.select(*carried, "_first", number.alias("_i")).select(*carried, (F.col("_first") + F.col("_i")).alias("_rank"))
    rest = dealt.join(F.broadcast(many.select("_g", "_bucket", "_h")), ["_g", "_bucket", "_h"], "left_anti")
    rest = rest.withColumn("_in", inside).join(offsets, ["_g", "_bucket"]).select(*carried, (F.col("_before") + F.col("_in")).alias("_rank"))
    return rest.unionByName(again)


def _placed(docs: DataFrame, weights: Mapping[str, float] | None, source_col: str, block_rows: int, frame: int, step: int) -> tuple[DataFrame, int]:
    """The columns of ``docs`` as _c0, _c1 ... with those of ``ADDED``, and the number of slots."""
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col(source_col).alias("_source"), *(F.col(c).alias(n) for c, n in zip(docs.columns, columns)))
    sources = written(_sources(rows.select("_source"), weights, block_rows), "sources")
    n_sources, n_slots, least = sources.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.min("weight"), F.lit(1.0))).first()
    if n_slots:
        timetable = written(_timetable(sources, n_slots, least, frame, step), "timetable")
    else:
        timetable = sources.select("_g", "blocks", F.lit(0).cast("long").alias("release"), F.lit(0).cast("long").alias("deadline"), F.lit(0).cast("long").alias("slot")).withColumnRenamed("blocks", "block")
    if n_slots <= MAX_BROADCAST_SLOTS:
        timetable = F.broadcast(timetable)
    ranked = _ranked(rows, sources, n_sources, columns)
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block_rows).cast("long")).withColumn("slot_row", (F.col("_rank") % block_rows).cast("int"))
    return ranked.join(timetable, ["_g", "block"]).select(*columns, *ADDED), n_slots


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", block_rows: int = BLOCK_ROWS, frame: int = FRAME, step: int = STEP) -> DataFrame:
    """``docs`` with weight (the source's target share), block (in its source, from 0), release, deadline and slot (counted in blocks of the whole mixture), slot_row (place in the block).

    Sorted by (slot, slot_row), any prefix of whole blocks holds the target shares of the sources not yet ended.
    """
    placed, _ = _placed(docs, weights, source_col, block_rows, frame, step)
    return placed.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED), *ADDED)


def mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs``, its own columns only, laid out in the mixture's order: by partition, and sorted in each."""
    placed, _ = _placed(docs, weights, source_col, block_rows, FRAME, STEP)
    placed = written(placed, "placed")  # ranges are found by a pass of their own, and the ranks' shuffle goes first
    return placed.repartitionByRange("slot", "slot_row").sortWithinPartitions("slot", "slot_row").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
