import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing
from tagloom.llm.mixing import mix, mixed_order


def due(blocks, weights):
    """What each source is due after t slots, exactly, and the inverse."""
    ends = {s: Fraction(blocks[s]) / weights[s] for s in blocks}
    slots = lambda v: sum(min(Fraction(blocks[s]), weights[s] * v) for s in blocks)

    def stage(t):
        for end in sorted(ends.values()):
            if slots(end) >= t:
                active = sum(weights[s] for s in blocks if ends[s] >= end)
                return (t - sum(blocks[s] for s in blocks if ends[s] < end)) / active
        return max(ends.values())

    return slots, lambda s, t: min(Fraction(blocks[s]), weights[s] * stage(t))


def by_hand(blocks, weights):
    """(source, block) of each slot, by earliest deadline first from the start, in fractions."""
    slots, _ = due(blocks, weights)
    names, done, order = sorted(blocks), Counter(), []
    for t in range(sum(blocks.values())):
        ready = [(math.ceil(slots((done[s] + 1) / weights[s])), i, s) for i, s in enumerate(names) if done[s] < blocks[s] and math.floor(slots(done[s] / weights[s])) <= t]
        s = min(ready)[2]
        order.append((s, done[s]))
        done[s] += 1
    return order


def schedule(spark, blocks, weights, **options):
    """(source, block) of each slot of ``mix`` over one document a block, with release and deadline checked."""
    made = [(i, s) for i, s in enumerate(x for x, n in blocks.items() for _ in range(n))]
    found = mix(spark.createDataFrame(made, "doc_id long, source string"), weights, block_rows=1, **options).collect()
    assert sorted(r.slot for r in found) == list(range(len(made)))
    assert all(r.release <= r.slot < r.deadline for r in found)
    return [(r.source, r.block) for r in sorted(found, key=lambda r: r.slot)]


def shares(weights):
    total = sum(map(Fraction, weights.values()))
    return {s: Fraction(w) / total for s, w in weights.items()}


def farthest(order, blocks, weights):
    _, at = due(blocks, weights)
    seen, most = Counter(), Fraction(0)
    for t, (s, _) in enumerate(order, 1):
        seen[s] += 1
        most = max(most, *(abs(seen[x] - at(x, t)) for x in blocks))
    return most


@pytest.mark.parametrize("seed", range(3))
def test_any_weights_stay_within_a_block_in_every_slot(spark, seed):
    """Random real weights and sizes, in frames that are much shorter than the mixture."""
    draw = random.Random(seed)
    weights = {f"s{i}": draw.random() ** 2 + 0.01 for i in range(7)}
    blocks = {s: draw.randint(1, 120) for s in weights}
    order = schedule(spark, blocks, weights, frame=16, step=8)
    assert order == by_hand(blocks, shares(weights))
    assert farthest(order, blocks, shares(weights)) < 1


def test_weights_are_not_rounded(spark):
    weights = {"a": 0.4983, "b": 0.4980, "c": 0.0033}
    blocks = {"a": 700, "b": 700, "c": 5}
    order = schedule(spark, blocks, weights, frame=64, step=32)
    assert farthest(order, blocks, shares(weights)) < 1
    assert order == by_hand(blocks, shares(weights))


def test_many_sources(spark):
    weights = {f"s{i:04}": 1.0 + i % 7 for i in range(1030)}
    blocks = dict.fromkeys(weights, 1)
    order = schedule(spark, blocks, weights)
    assert sorted(order) == [(s, 0) for s in weights]
    share, seen = {s: w / sum(weights.values()) for s, w in weights.items()}, Counter()
    first_end = math.floor(sum(weights.values()) / 7)  # until a source ends, all are due their share
    for t, (s, _) in enumerate(order[:first_end], 1):
        seen[s] += 1
        assert all(abs(seen[x] - share[x] * t) < 1 for x in share)


def test_blocks_hold_the_rows_of_one_source(spark):
    made = [(i, "abc"[0 if i % 6 < 3 else 1 if i % 6 < 5 else 2]) for i in range(600)]
    mixed = mix(spark.createDataFrame(made, "doc_id long, source string"), {"a": 5.0, "b": 3.0, "c": 2.0}, block_rows=4).collect()
    slots = defaultdict(set)
    for r in mixed:
        slots[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in slots.values()) and len(slots) == 150
    assert len({(r.slot, r.slot_row) for r in mixed}) == len({r.doc_id for r in mixed}) == 600
    weights = {"a": Fraction(1, 2), "b": Fraction(3, 10), "c": Fraction(1, 5)}
    assert [next(iter(slots[t])) for t in range(150)] == by_hand({"a": 75, "b": 50, "c": 25}, weights)


@pytest.mark.parametrize("broadcast", [True, False])
def test_much_repeated_rows(spark, monkeypatch, broadcast):
    """Rows without an id, all alike, are more than a task may hold."""
    monkeypatch.setattr(mixing, "HOT_ROWS", 20)
    if not broadcast:
        monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
        monkeypatch.setattr(mixing, "MAX_BROADCAST_SLOTS", 0)
    made = [(None, "a")] * 130 + [(i, "a") for i in range(70)] + [(7, None)] * 55 + [(i, "b") for i in range(9)]
    found = mix(spark.createDataFrame(made, "doc_id long, source string").repartition(5), block_rows=4).collect()
    assert Counter((r.doc_id, r.source) for r in found) == Counter(made)
    assert len({(r.slot, r.slot_row) for r in found}) == len(made)
    assert Counter(r.source for r in found if r.slot_row == 0) == {"a": 50, None: 14, "b": 3}


def test_hot_source_is_dealt_out_and_order_is_stable(spark, docs):
    a = {r.doc_id: r.slot for r in mix(docs.select("doc_id", "source")).collect()}
    b = {r.doc_id: r.slot for r in mix(docs.repartition(7).select("doc_id", "source")).collect()}
    assert a == b and len(a) == docs.count()


def test_layout_keeps_columns_and_order(docs):
    docs = docs.select("*", *[(F.col("doc_id") * i).alias(c) for i, c in enumerate(("slot", "weight", "block", "release", "deadline", "slot_row", "_g", "_rank"), 2)])
    laid = mixed_order(docs)
    assert laid.columns == docs.columns
    assert sorted(laid.collect(), key=lambda r: r.doc_id) == sorted(docs.collect(), key=lambda r: r.doc_id)
    want = [r.doc_id for r in sorted(mix(docs).collect(), key=lambda r: (r.slot, r.slot_row))]
    assert [r.doc_id for r in laid.collect()] == want


def test_odd_rows(odd, none):
    found = mix(odd).collect()
    assert len(found) == 9 and "clash" not in {r.slot for r in found}
    groups = defaultdict(set)
    for r in found:
        groups[r.slot].add(r.source)
    assert all(len(g) == 1 for g in groups.values())
    assert mix(none).count() == 0


def test_no_python_in_the_plan(docs, capsys):
    mix(docs).explain()
    assert "Python" not in capsys.readouterr().out


def test_weights_must_be_positive(docs):
    with pytest.raises(ValueError):
        mix(docs, {"src0": 0.0})
