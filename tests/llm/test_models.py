import random
import re
import zlib

import pytest

from tamis.llm import language_id, ngram_join, packing, quality
from tamis.llm.ngram_join import near_duplicates
from tamis.llm.pii import KINDS, listed, sanitise, sanitised_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def test_entities_against_plain_patterns(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "_x", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+49 (30) 123-456", "+1", " ", "é𝄞", "-", "0007", "z%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "1 " * 9000, "a" * 50_000, "a.b" * 9000 + "@x" + ".y" * 9000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r.s for r in sanitised_spans(docs).select("doc_id", listed(spark_filter()).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PLAIN[k], t or "") if holds(k, m.group())]
        assert got[i] == ",".join(want), t
    assert sanitised_spans(docs.limit(0)).count() == 0


def spark_filter():
    from pyspark.sql import functions as F

    return F.filter("spans", lambda s: s["kind"].isin(*KINDS))


def test_disclosing_terms_go_or_are_generalised(spark):
    rows = [(i, f"prose goes on. The mailbox of a{i}@b.c it is. so prose goes on") for i in range(40)]
    rows += [(60 + i, f"some seal{i % 9} x with sigil near +49 (30) 123-4{i}00. prose of sigil it goes") for i in range(30)]
    rows += [(90, "where the Mailbox stands"), (91, None), (None, "a sigil"), (92, "the on prose of it is so goes with near some x on. " * 900), (93, "k 0a1b2c3d4e5f6a7b8c9d0 z"), (93, "mailbox")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, spans int, __key int")
    out = sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[90] == ["where the [removed] stands"] and got[91] == [None] and got[None] == ["a [phone-related]"]
    assert "The [removed] of [email] it is" in got[3][0] and got[92][0].startswith("the on prose")
    assert sorted(got[93]) == ["[removed]", "k [secret] z"]
    assert sanitise(docs.limit(0)).count() == 0


def test_spans_of_many_matches_are_linear(spark):
    docs = spark.createDataFrame([(1, "é1.2.3.4 " * 20_000)], "doc_id long, text string")
    spans = sanitised_spans(docs).first().spans
    assert len(spans) == 20_000 and (spans[-1].start, spans[-1].end) == (19_999 * 9 + 1, 19_999 * 9 + 8)


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t", "One two", "one TWO", "w1 w2 w3 w4", "w1 w2 w3 w4"]
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 900))]
        for _ in range(40 if g == 0 else 6):
            t = list(base)
            for _ in range(rng.randrange(0, 3 + len(t) // 60)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{passage} " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 20))) for _ in range(90)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_links string")
    for size, percent, small, block, frequent in ((4, 85, 64, 256, 64), (5, 80, 2, 16, 8)):
        # small bounds take every pair through the blocks, and most tokens through combinations
        monkeypatch.setattr(ngram_join, "SMALL", small)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        sets = []
        for t in texts:
            w = (t or "").lower().split()
            n = min(size, len(w))
            sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
        root = list(range(len(texts)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        links = [0] * len(sets)
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in near_duplicates(docs, size=size, percent=percent).collect()}
        assert got == {i: (len(s), links[i], find(i)) for i, s in enumerate(sets)}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_packing_is_gapless_and_whole(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, "", "a b c", "hi <|endoftext|> yo<|endoftext|>", "<|end <| x", "Ünï 𝄞 code  \n\n x", "word " * 5000] + [f"doc {i} " * (i % 90) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = packing.pack_documents(docs, limit=512).collect()
    for i, t in enumerate(texts):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == n and all(r.length == 512 for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[r.start : r.start + r.length])) for r in mine)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 512 and len(by) <= -(-sum(by.values()) // 512) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_islands_beat_best_fit(spark):
    import numpy as np

    lengths = np.random.default_rng(3).integers(400, 900, 1200)
    plain = len(packing.best_fit(lengths, list(range(1200)), 2048, []))
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces).collect()
    assert sorted(r.doc_id for r in got) == list(range(1200)) and len({r.sequence_id for r in got}) < plain
    one = packing.evolve(lengths, 2048, 1, [packing.best_fit(lengths, list(range(1200)), 2048, [])])
    moved = packing.evolve(lengths, 2048, 2, [one], generations=0)  # a migrant is among an island's people
    assert len(moved) <= len(one)


def test_crossover_keeps_every_item():
    import numpy as np

    lengths = np.random.default_rng(2).integers(1, 700, 500)
    a = packing.best_fit(lengths, list(range(500)), 1000, [])
    b = packing.best_fit(lengths, list(range(250)), 1000, packing.best_fit(lengths, list(range(250, 500)), 1000, []))
    child = packing.crossover(lengths, b, a, 1000, np.random.default_rng(1))
    assert sorted(i for x in child for i in x) == list(range(500))
    assert all(lengths[x].sum() <= 1000 for x in child)


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    emit, trans = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    post, pairs = language_id.forward_backward(emit, np.array([4, 1, 2]), trans, True)
    want, want_pairs, at = np.zeros((7, 3)), np.zeros((3, 3)), 0
    for n in (4, 1, 2):
        paths = list(itertools.product(range(3), repeat=n))
        w = np.exp([sum(emit[at + i, p[i]] for i in range(n)) + sum(trans[p[i], p[i + 1]] for i in range(n - 1)) for p in paths])
        for p, v in zip(paths, w / w.sum(), strict=True):
            for i in range(n):
                want[at + i, p[i]] += v
            for i in range(n - 1):
                want_pairs[p[i], p[i + 1]] += v
        at += n
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs)


def test_languages_and_quality_edges(spark):
    rows = [(i, "the house and the garden", "en", 1) for i in range(30)] + [(100 + i, "das haus und der garten", "de", 0) for i in range(30)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    docs = spark.createDataFrame([(1, "the house", "x"), (2, "der garten", "x"), (3, None, "x"), (4, "12 !", "x"), (5, "", None), (6, "²", "x"), (7, "m²", "x"), (7, "CO₂", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r.lang_pred for r in language_id.languages(docs, language_id.train(labelled)).collect()}
    assert {k: v for k, v in got.items() if k < 7} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "und"} and got[7] != "und"
    scores = {r.doc_id: r.score for r in quality.quality(docs, quality.train(labelled)).collect()}
    assert scores[1] > scores[2] and scores[3] == scores[5] and all(0 <= v <= 1 for v in scores.values())
    nothing = language_id.train(labelled.limit(0))
    assert {r.lang_pred for r in language_id.languages(docs, nothing).collect()} == {"und"}
