import random

import corpus_pipeline
from tamis.llm import ngram_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def folder(spark, path, docs, labels=(), items=()):
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def run(spark, name, sf):
    out = STAGES[name](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert out.columns == COLUMNS
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "garden", "window", "bridge", "summer", "letter", "market"]) + rng.choice(["", "s", "ly"]) for _ in range(n))


def test_stages_in_order():
    assert list(STAGES) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_toxic_documents_go_and_others_stay(spark, tmp_path):
    rng = random.Random(2)
    clean = [(i, prose(rng, rng.randrange(5, 200))) for i in range(300)]
    toxic = [(1000 + i, f"{prose(rng, 30)} you worthless idiot {prose(rng, 30)}") for i in range(120)]
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    extra = [(None, toxic[0][1]), (5, None), (None, ""), (7, toxic[1][1]), (None, clean[0][1])]
    left = run(spark, "toxicity", folder(spark, tmp_path, clean + toxic + extra, labels))
    ids = [i for i, _ in left]
    assert sum(1 for i, t in left if t and "idiot" in t) == 0
    assert sum(1 for i, _ in clean if i in ids) >= 295 and (5, None) in left and (None, "") in left


def test_exact_and_near_copies_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
            docs.append((len(docs), rng.choice([str.upper, str])(" ".join(t))))
    docs += [(900, None), (901, ""), (None, docs[0][1]), (3, docs[5][1]), (3, docs[5][1])]
    sf = folder(spark, tmp_path, docs)
    best = {}
    for i, t in docs:
        key = (t or "").lower()
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    left = run(spark, "exact_dedup", sf)
    assert sorted((-1 if i is None else i, (t or "").lower()) for i, t in left) == sorted((i, k) for k, i in best.items())
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k) if sets[k] else ("empty", k), []).append(k)
    kept = [i for i, _ in run(spark, "near_dedup", sf)]
    assert len(kept) == len(groups)
    least = sorted(min(-1 if docs[k][0] is None and len(m) == 1 else docs[k][0] if docs[k][0] is not None else 10**9 for k in m) for m in groups.values())
    assert sorted(-1 if i is None else i for i in kept) == least
    assert ngram_join.BLOCK


def test_contaminated_documents_go(spark, tmp_path):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 9, 10, 25, 60])] + [(9, None), (8, "")]
    docs = [(i, prose(rng, 80)) for i in range(40)]
    docs += [(100 + k, f"{prose(rng, 12)}, {t.upper()}! {prose(rng, 9)}") for k, (_, t) in enumerate(items[:5])] + [(None, items[2][1]), (7, items[2][1]), (8, None)]
    words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()
    wins = set()
    for _, t in items:
        w = words(t)
        wins |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    hit = lambda t: any(tuple(words(t)[s : s + len(w)]) == w for w in wins for s in range(len(words(t)) - len(w) + 1))
    assert run(spark, "decontamination", folder(spark, tmp_path, docs, items=items)) == sorted(((i, t) for i, t in docs if not hit(t)), key=str)


def test_whole_run_and_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf).collect()
    held = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert held.get(r.sequence_id, 0) == r.offset
        held[r.sequence_id] = r.offset + r.length
    assert packed and max(held.values()) <= 2048
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0
