import zlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm.decontam import tokens
from tagloom.llm.langid import fit, identify

from test_decontam import slow
from test_mixing import by_hand, shares


def near_copies(rows):
    """Smallest doc_id of each row's component of texts with 0.8 of their shingles alike, by all pairs."""
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = {r.doc_id: r.text.lower().encode().split() for r in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    sized = sorted(sets, key=lambda d: len(sets[d]))
    for i, d in enumerate(sized):
        for other in sized[i + 1 :]:
            if len(sets[d]) < 0.8 * len(sets[other]):
                break
            both = len(sets[d] & sets[other])
            if both >= 0.8 * (len(sets[d]) + len(sets[other]) - both):
                a, b = sorted((find(d), find(other)))
                root[b] = a
    return {d: find(d) for d in root}


def test_stages_against_plain_python(spark, small, docs):
    """Each stage's decisions apart from its operator, but for the languages, whose machines have tests of their own."""
    assert [n for n, _ in cp.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID output"] and cp.ORACLE_SQL is None
    found = {r.doc_id: r for r in identify(docs, fit(docs, F.lit(True))).collect()}
    left = [r for r in docs.collect() if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= 0.3]
    smallest = near_copies(left)
    left = [r for r in left if smallest[r.doc_id] == r.doc_id]
    items = [np.array([hash(x) for x in tokens(r.text)]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    vocabulary = {w for u in items for w in u.tolist()}
    left = [r for r in left if sum(hash(w) in vocabulary for w in tokens(r.text)) < 4 or not slow(r.text, items)]

    got = cp.run(spark, small).orderBy("start").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in left)
    text, t, start = {r.doc_id: r.text for r in left}, Tokenizer.from_file(cp.vocabulary()), 0
    for r in got:
        ids = [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    # The order is the mixture's: sources by earliest deadline, by blocks of 16 and what is left of a source.
    sizes = Counter(r.source for r in left)
    order = by_hand({s: -(-n // 16) for s, n in sizes.items()}, shares({s: n**0.5 for s, n in sizes.items()}))
    want, rest = [], dict(sizes)
    for s, _ in order:
        want += [s] * min(16, rest[s])
        rest[s] -= min(16, rest[s])
    source = {r.doc_id: r.source for r in left}
    assert [source[r.doc_id] for r in got] == want and 0.8 * docs.count() < len(got) < docs.count()


def test_each_stage_on_odd_rows(spark, small, odd):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars", "slot", "fp", "key")
    for name, stage in cp.STAGES:
        out = stage(spark, plain, small)
        assert out.columns == plain.columns or name == cp.STAGES[-1][0]
        assert out.count() <= 9
        assert stage(spark, plain.filter("false"), small).count() == 0


@pytest.mark.parametrize("column", ["k0", "_row", "_salt", "slot"])
def test_stages_hand_columns_through_whatever_their_names(spark, small, docs, column):
    few = docs.limit(30).withColumn(column, F.col("doc_id") * 3)
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, few, small)
        assert out.columns == few.columns and all(r[column] == 3 * r.doc_id for r in out.collect()), name
