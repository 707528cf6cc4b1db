import random
import re
import zlib
from collections import Counter

import pytest

from tagloom.llm import variants
from tagloom.llm.oracles import oracle_sql
from tagloom.llm.queries import op12_spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    """All pairs, in plain Python."""
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= 10 * counts[w]}
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=repr)


def counted(docs):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall(lowered(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def result(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def misspelled(draw, word, letters):
    at, c = draw.randrange(len(word)), draw.choice(letters)
    return draw.choice((word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :], word[:at] + c + word[at:]))


def texts(seed, letters="abÿé", words=60):
    draw = random.Random(seed)
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(7, 12))) for _ in range(words)] + ["commonbeginning" + "".join(draw.choice("abc") for _ in range(4)) for _ in range(60)]
    docs = []
    for i in range(300):
        words = [w if draw.random() < 0.8 else misspelled(draw, w, letters) for w in (base[min(int(draw.expovariate(0.08)), len(base) - 1)] for _ in range(40))]
        docs.append((i, " ".join(words) + "-ABCDEFG×ÿ d'Éclairs"))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (None, docs[2][1]), (900, None), (901, ""), (902, "x" * 50_000), (903, "x" * 50_000), (904, "Ω漢 ααααααααα")]


@pytest.mark.parametrize("hot", [2, 100])
def test_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(variants, "HOT", hot)
    monkeypatch.setattr(variants, "CHUNK", 150)
    monkeypatch.setattr(variants, "LONG", 4 if hot == 2 else 40)
    docs = texts(hot)
    want = grouped(counted(docs))
    assert any(r[1] != r[2] and r[1] for r in want) or hot == 100  # chains of forms
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string")
    assert result(variants.spelling_variants(df.repartition(6))) == want


def test_chains_are_followed_to_their_end(spark):
    counts = {"aaaaaaaa": 20_000, "aaaaaaab": 2_000, "aaaaaabb": 200, "aaaaabbb": 20, "aaaabbbb": 2, "aaaabbbc": 2}
    forms = spark.createDataFrame([(w, f) for w, f, *_ in grouped(counts) if f], "word string, form string")
    assert {tuple(r) for r in variants._roots(forms).collect()} == {(w, r) for w, f, r, *_ in grouped(counts) if f}


def test_one_edit():
    draw = random.Random(1)
    for _ in range(20_000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(1, 6))) for _ in range(2))
        if a != b and len(b) - len(a) in (0, 1):
            assert variants.one_edit(a, b) == one_apart(a, b), (a, b)


def test_query_against_sql(spark, small, duck):
    got = op12_spelling_variants(spark, small)
    want = duck.execute(oracle_sql()["op12_spelling_variants"])
    assert [d[0] for d in want.description] == got.columns
    assert result(got) == sorted(want.fetchall(), key=repr)


def test_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(8, "letters letters")]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-1:], "doc_id long, text string"))
    assert result(variants.spelling_variants(frame)) == grouped(counted(rows))
    assert result(variants.spelling_variants(none)) == []
