import math
from collections import Counter, defaultdict

import pyarrow as pa

from tamis.llm import toxicity as tox

ROWS = [(f"calm words here {i}", 0) for i in range(20)] + [(f"calm grubful words {i}", 1) for i in range(20)]


def test_ratios_against_plain_formulas(spark):
    rows = [*ROWS, ("Calm, zyxvut words", 1), ("calm qomfed; words", 0), (None, 0), ("", 1), ("12 é!", 0)]
    n, d = tox.ORDER, tox.DISCOUNT
    counts = [Counter(), Counter()]
    for text, kind in rows:
        s = " " * (n - 1)
        for c in (text or "").lower().encode():
            c = chr(c) if 97 <= c <= 122 or c >= 128 else " "
            s += c if c != " " or s[-1] != " " else ""
        for i in range(n - 1, len(s)):
            counts[kind][s[i - n + 1 : i + 1]] += 1
    level, kinds = set(counts[0]) | set(counts[1]), {}
    for k in range(n - 1, 0, -1):
        before = defaultdict(set)
        for g in level:
            before[g[1:]].add(g[0])
        kinds[k] = {g: len(v) for g, v in before.items()}
        level = set(before)

    def low(g):
        if not g:
            return tox.UNSEEN
        same = [v for k, v in kinds[len(g)].items() if k[:-1] == g[:-1]]
        return (max(kinds[len(g)][g] - d, 0) + d * len(same) * low(g[1:])) / sum(same)

    def share(kind, g):
        of = {k: v for k, v in counts[kind].items() if k[:-1] == g[:-1]}
        p = low(g[1:])
        return (max(of.get(g, 0) - d, 0) + d * len(of) * p) / sum(of.values()) if of else p

    labelled = spark.createDataFrame(rows, "text string, toxic int")
    top = tox.gram_counts(labelled)
    seen, after = tox.ratios(top, tox.shared_backoff(top))
    name = lambda v: v.to_bytes(8, "big")[8 - n :].decode("latin-1")
    got = {name(r.gram): r.ratio for r in seen.collect()}
    want = {g: math.log(share(1, g) / share(0, g)) for g in set(counts[0]) | set(counts[1])}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-5 for g in want)
    assert {r.gram: (r.toxic, r.ordinary) for r in top.collect() if name(r.gram) == "grubf"}.popitem()[1] == (20, 0)
    assert after.count() == len({g[:-1] for g in want})


def test_scores(spark):
    labelled = spark.createDataFrame([*ROWS, (None, 0), ("", 1)], "text string, toxic int")
    rows = [(1, "grubful grubby calm", "x"), (2, "calm words", None), (3, None, "x"), (4, "", "x"), (5, "12 !", "x"), (None, "calm words", "x"), (2, "calm words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = tox.train(labelled)
    out = tox.toxicity(docs, model)
    got = {r.doc_id: r.score for r in out.collect()}
    assert got[1] > got[2] == got[None] and got[3] == got[4] == got[5] and all(0 <= v <= 1 for v in got.values()) and out.count() == 7
    assert (model.weights[1:3] >= 0).all() and tox.toxicity(docs.limit(0), model).count() == 0
    empty = tox.train(labelled.limit(0))
    assert empty.features(pa.array(["anything", None]))[:, 1:3].tolist() == [[0, 0], [0, 0]]


def test_an_insult_in_a_long_text_is_found(spark):
    labelled = spark.createDataFrame(ROWS * 3, "text string, toxic int")
    model = tox.train(labelled)
    long = "calm words here " * 2000
    x = model.features(pa.array([long, long + "grubful " + long]))
    assert x[1, 2] > x[0, 2] + 0.1 and abs(x[1, 1] - x[0, 1]) < 0.01


def test_a_word_labelled_once_tells(spark):
    labelled = spark.createDataFrame([*ROWS, ("calm zyxvut words", 1), ("calm qomfed words", 0)], "text string, toxic int")
    top = tox.gram_counts(labelled)
    model = tox.Model.collected(tox.ratios(top, tox.shared_backoff(top)))
    x = model.features(pa.array(["zyxvut", "qomfed"]))
    assert x[0, 1] > 0.05 and x[1, 1] < -0.05
