"""Posteriors that differ in their last bits only, as SQL has them."""

import math
import random
from collections import Counter

from tagloom.operators import correction

CLONALITY = 0.008445258445258445


def barcodes(draw):
    """(cnt, error, payload) by key: children and, at one place, two parents of as many reads, with none and with one mismatch."""
    rows = {}
    for _ in range(400):
        key, text = "".join(draw.choices("ACGT", (6, 2, 1, 1), k=12)), "".join(draw.choices("ACGT", k=32))
        at, c, e = draw.randrange(12), draw.choice((1, 1, 2, 3)), 10 ** (-draw.choice((8, *range(20, 38))) / 10.0)
        big = draw.randrange(2 * c, 60)
        rows[key] = (c, e, text)
        for k, base in enumerate(draw.sample([b for b in "ACGT" if b != key[at]], 2)):
            rows.setdefault(key[:at] + base + key[at + 1 :], (big, e, ("C" if text[0] == "A" else "A") + text[1:] if k else text))
    return rows


def expected(rows):
    sizes, n = Counter(c for c, _, _ in rows.values()), len(rows)
    shares = [[sum(k[i] == b for k in rows) / n for b in "ACGT"] for i in range(12)]
    space = math.exp(math.fsum(-math.log(sum(p * p for p in s)) for s in shares))
    out = {}
    for child, (c, e, mine) in rows.items():
        for at in range(12):
            for base in "ACGT":
                parent = child[:at] + base + child[at + 1 :]
                if base == child[at] or parent not in rows or rows[parent][0] < 2 * c:
                    continue
                p, _, theirs = rows[parent]
                d = sum(x != y for x, y in zip(mine, theirs))
                ways = math.lgamma(33) - math.lgamma(d + 1) - math.lgamma(33 - d)
                same, other = ways + d * math.log(0.002) + (32 - d) * math.log(0.998), ways + d * math.log(0.75) + (32 - d) * math.log(0.25)
                ratio = math.exp(max(-60, min(60, same - math.log(CLONALITY * math.exp(same) + (1 - CLONALITY) * math.exp(other) + 1e-300))))
                if d > 1:
                    continue
                mean, f, rho = p * e / 3, c / (c + p), 1e-5 * 25 * 12
                err = ratio * ((1 - rho) * math.exp(-mean + c * math.log(mean) - math.log(math.factorial(c))) + rho * (1 / (f * f) / (p + 1 - 2) * p / float((c + p) * (c + p)) if f <= 0.5 else 0))
                out[child, parent] = err / (err + n / space * max(sizes[c] / n, 1 / (n + 1.0)))
    return out


def test_posteriors_to_the_last_bit(spark):
    rows = barcodes(random.Random(4))
    df = spark.createDataFrame([("S", k, c, [e] * 12, t) for k, (c, e, t) in rows.items()], "sample_id string, key string, cnt long, pos_err array<double>, payload string")
    agreement = spark.createDataFrame([("S", CLONALITY)], "sample_id string, clonality double")
    scored = correction.posteriors(df, agreement=agreement)
    got, want = {(r.child, r.parent): r.posterior for r in scored.collect()}, expected(rows)
    assert len(want) > 700 and {k: got[k] for k in want} == want
    best = {}
    for (child, parent), p in want.items():
        at = next(i for i in range(12) if child[i] != parent[i])
        best[child] = min(best.get(child, (0,)), (-p, at, parent))
    chosen = {r.child: r.parent for r in correction.parents(scored).collect()}
    assert {c: chosen.get(c) for c in best} == {c: b[2] if -b[0] >= 0.95 else None for c, b in best.items()}
