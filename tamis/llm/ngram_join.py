"""Jaccard join of word-shingle sets by token-combination prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, discard, joined, lean, one_of_each, release, restrict, settle, small_batches
from .words import Shingler, mix

#: Sets that a task knows again (equal ones count once there, which saves work only).
MEMORY = 500_000
#: Tokens that a task holds before it hands their counts on.
HELD = 800_000
#: Tokens of one bin of the counts (expected): what a task that sums a bin holds.
BIN = 1 << 22
#: A token is frequent if so many sets have it, or more where else too many would be.  Far below SMALL, so that keys of
#: rare tokens have small buckets.
FREQUENT = 8
#: Frequent tokens, at most: 5 bytes each to every task.
FREQUENT_MOST = 8_000_000
#: Levels of a frequent token's number of sets to a doubling of it.
LEVELS = 4
#: Sets up to this size are indexed by pairs of frequent tokens; larger ones by frequent tokens alone.
PAIRED = 100
#: Buckets of more members are compared by blocks instead of row by row.
SMALL = 64
#: Members of a block, and their tokens, about: what a task that compares two blocks holds, long texts or not.
BLOCK = 256
BLOCK_TOKENS = 200_000
#: Rare tokens shared by two sets that the bound on places of frequent tokens allows for; with more, rare tokens decide.
SLACK = 1


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def columns(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def signatures(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """(id, n, s1, s2) of each row: size of its set and two independent sums over it; (bin, toks, cnts): all tokens, counted.

    A token's first `bits` bits are its bin, the next 32 are kept: tokens that
    share them are counted as one, which can only make a rare token frequent.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        shingler, seen, kept, held = Shingler(size), set(), [], 0
        schema = None

        def counted():
            tok, cnt = np.unique(np.concatenate(kept) >> np.uint64(32 - bits), return_counts=True)
            at = np.searchsorted(tok >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
            spans = [(k, a, b) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
            low, cnt = (tok & np.uint64(0xFFFFFFFF)).astype("<u4"), cnt.astype("<u4")
            return columns([(None, None, None, None, k, low[a:b].tobytes(), cnt[a:b].tobytes()) for k, a, b in spans], schema)

        for b in batches:
            ints = [(c, pa.int64()) for c in ("n", "s1", "s2", "bin")]
            schema = pa.schema([("id", b.schema[0].type), *ints, ("toks", pa.binary()), ("cnts", pa.binary())])
            rows = []
            for doc, s in zip(b.column(0).to_pylist(), shingler.sets(b.column(1)), strict=True):
                sig = (len(s), int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum().view(np.int64)))
                rows.append((doc, *sig, None, None, None))
                if sig not in seen and len(s):
                    if len(seen) < MEMORY:
                        seen.add(sig)
                    kept.append(s)
                    held += len(s)
                if held >= HELD:
                    yield counted()
                    kept, held = [], 0
            yield columns(rows, schema)
        if kept:
            yield counted()

    return docs.mapInArrow(lean(run), f"id {kind}, n long, s1 long, s2 long, bin long, toks binary, cnts binary")


def frequent_tokens(counts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, levels): the first 32 bits of frequent tokens, sorted, and how frequent they are, from exact sums over all tasks.

    Tokens that share 32 bits are frequent if one of them is, at the highest level of theirs.
    """

    def total(key, table):
        toks = np.concatenate([np.frombuffer(t, "<u4") for t in table["toks"].to_pylist()])
        cnts = np.concatenate([np.frombuffer(c, "<u4") for c in table["cnts"].to_pylist()])
        by = np.argsort(toks, kind="stable")
        toks, cnts = toks[by], cnts[by]
        first = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1]]))
        sets = np.add.reduceat(cnts, first, dtype=np.int64)
        many = sets >= FREQUENT
        found = (int(key[0].as_py()) << 32) | toks[first][many].astype(np.int64)
        level = np.floor(LEVELS * np.log2(sets[many])).astype(np.int32)
        del toks, cnts, by, first, sets, many
        release()
        return pa.table({"tok": pa.array(found, pa.int64()), "level": pa.array(level, pa.int32())})

    found = settle(counts.groupBy("bin").applyInArrow(total, "tok long, level int"), "ngram-frequent")
    levels = sorted(found.groupBy("level").count().collect(), reverse=True)
    ends = np.cumsum([n for _, n in levels])
    least = min((level for (level, _), end in zip(levels, ends.tolist(), strict=True) if end <= FREQUENT_MOST), default=1 << 30)
    found = found.where(F.col("level") >= least).toArrow()  # at most FREQUENT_MOST rows of 12 bytes
    tok, level = (found["tok"].to_numpy() >> bits).astype(np.uint32), found["level"].to_numpy().astype(np.uint8)
    by = np.lexsort((level, tok))
    tok, level = tok[by], level[by]
    last = np.ones(len(tok), bool)
    last[:-1] = tok[1:] != tok[:-1]
    return tok[last], level[last]


def index(reps: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """(key, id, n, often, place, f): the signatures of each set.

    often: made of frequent tokens; place: how many tokens before the key's
    last one are not in it (-1 for rare keys); f: frequent tokens of the
    prefix.

    Tokens are ordered rare class first, by hash, then frequent ones by level
    and hash: of a family of near copies, its own tokens come before those that
    all the corpus has.  Two sets
    that link share two tokens among the first n - overlap + 2 of each (sets of
    one token apart).  If one of them is rare, it is a key of both; else two
    frequent ones are, and pairs of frequent tokens are keys - for sets up to
    PAIRED.  Larger sets take frequent tokens singly, and so do, besides, the
    paired sets which may link with a larger one.
    """
    held = reps.sparkSession.sparkContext.broadcast(frequent)
    kind = reps.schema["id"].dataType.simpleString()

    def run(batches):
        shingler, (often, levels) = Shingler(size), held.value
        for b in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
            keys, ids, ns, often_made, places, fs = [], [], [], [], [], []
            for doc, s in zip(b.column(0).to_pylist(), shingler.sets(b.column(1)), strict=True):
                n = len(s)
                if not n:
                    continue
                if len(often):
                    short = (s >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(often, short), len(often) - 1)
                    is_often = often[at] == short
                    level = levels[at[is_often]]
                else:
                    is_often, level = np.zeros(n, bool), np.zeros(0, np.uint8)
                prefix = min(n, n - least_overlap(n, percent) + 2)
                rare, freq = s[~is_often][:prefix], s[is_often][np.argsort(level, kind="stable")]
                freq = freq[: prefix - len(rare)]
                found, place = [rare], [np.full(len(rare), -1)]
                if n <= PAIRED and len(freq) > 1:
                    i, j = np.triu_indices(len(freq), 1)
                    found.append(mix(mix(freq[i]) + freq[j]))
                    place.append(len(rare) + j - 1)
                if n > PAIRED * percent // 100 or n * percent < 100 * 2:  # may link with a larger set; may share one token alone
                    found.append(freq)
                    place.append(len(rare) + np.arange(len(freq)))
                k = np.concatenate(found)
                keys.append(k)
                often_made.append(np.arange(len(k)) >= len(rare))
                places.append(np.concatenate(place))
                fs.append(np.full(len(k), len(freq), np.int64))
                ids += [doc] * len(k)
                ns.append(np.full(len(k), n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(ids, b.schema[0].type),
                        pa.array(np.concatenate(ns)),
                        pa.array(np.concatenate(often_made)),
                        pa.array(np.concatenate(places).astype(np.int64)),
                        pa.array(np.concatenate(fs)),
                    ],
                    names=["key", "id", "n", "often", "place", "f"],
                )

    return reps.mapInArrow(lean(run), f"key long, id {kind}, n long, often boolean, place long, f long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sets link, by exact intersection.

    The texts travel, as they take less room than their sets; rows come
    sorted by a, so a's set is mostly made once.
    """
    wanted = settle(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"), "ngram-wanted")
    some = restrict(texts, wanted, "id", wanted.count())
    both = pairs.join(some.toDF("b", "tb"), "b").join(some.toDF("a", "ta"), "a")

    def run(batches):
        shingler, last, mine = Shingler(size), None, None
        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                keep, a = [], b.column("a")
                ids = a.to_pylist()
                fresh = [k for k, i in enumerate(ids) if (ids[k - 1] if k else last) != i]
                sets = shingler.sets(b.column("ta").take(pa.array(fresh, pa.int64())))
                begins = set(fresh)
                for k, y in enumerate(shingler.sets(b.column("tb"))):
                    if k in begins:
                        mine = next(sets)
                    common = len(np.intersect1d(mine, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(mine) + len(y) - common))
                last = ids[-1]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return settle(both.mapInArrow(lean(run), f"a {kind}, b {kind}"), "ngram-links")


def overlap_needed(n: str, m: str, percent: int) -> Column:
    """Tokens that linked sets of n and m tokens share at least."""
    return F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")


def rare_needed(n: str, m: str, percent: int) -> Column:
    """Rare tokens that linked sets of n and m tokens share among their prefixes, at least, if no key of frequent tokens is theirs.

    The overlap they need is o; beyond the prefix a set has overlap - 2 tokens
    left, so the prefixes share the rest of o; one of those may be frequent.
    """
    o = overlap_needed(n, m, percent)
    most = F.expr(f"({percent} * greatest({n}, {m}) + 99) div 100")
    return o - F.greatest(most - 2, F.lit(0)) - 1


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable.  Alternating large-star and small-star until nothing changes."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "ngram-cc")

    def mark(df: DataFrame):
        return df.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while before[0]:
        # large-star: larger neighbours of each node go to the least of its neighbours and itself
        ways = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: smaller neighbours and the node itself go to the least of them
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u")
        edges = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        edges = settle(edges.where("u <> v").distinct(), "ngram-cc")
        if (now := mark(edges)) == before:
            break
        before = now
    return joined(nodes.select("id"), edges.select(F.col("u").alias("id"), F.col("v").alias("__c")), ["id"]).select(
        "id", F.coalesce("__c", "id").alias("component")
    )


def linked(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Whether sets link, for each of x and each of y (None: x itself, pairs above the diagonal).

    Tokens that only one of the sets has can't be shared and are left out; the
    others' incidence is multiplied in bounded slices of tokens.
    """
    every = x if y is None else x + y
    size = np.array([len(s) for s in every], float)
    owner = np.repeat(np.arange(len(every)), size.astype(int))
    toks = np.concatenate(every) if every else np.zeros(0, np.uint64)
    by = np.argsort(toks, kind="stable")
    toks, owner = toks[by], owner[by]
    fresh = np.concatenate([[True], toks[1:] != toks[:-1]]) if len(toks) else np.zeros(0, bool)
    col = np.cumsum(fresh) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else fresh
    col, owner = np.unique(col[shared], return_inverse=True)[1], owner[shared]
    a, b = (len(x), len(x)) if y is None else (len(x), len(y))
    both = np.zeros((a, b), np.float32)
    width = 8192
    ends = np.searchsorted(col, np.arange(0, (int(col[-1]) if len(col) else -1) + width + 1, width))
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        m = np.zeros((len(every), width), np.float32)  # counts below 2^24: exact
        m[owner[lo:hi], col[lo:hi] - k * width] = 1
        both += m[:a] @ (m if y is None else m[a:]).T
    sizes = size[:a, None] + (size if y is None else size[a:])[None, :]
    hit = 100 * both >= percent * (sizes - both)
    return np.triu(hit, 1) if y is None else hit


def block_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside pairs of blocks, summed up: (id, root, links).

    members (x, y, side, id, text, larges, copies): a group (x, y) has block x
    as side 0 and, where y differs, block y as side 1; pairs of the two are
    judged, or those of x alone.  root: the least id that a member reaches
    inside its group; links: documents it links with there.  Only pairs that
    share one of `larges` count.
    """
    kind = members.schema["id"].dataType.simpleString()
    rows = members.repartition("x", "y").sortWithinPartitions("x", "y", "side")

    def solve(table: pa.Table):
        ids, side = table["id"].to_pylist(), np.array(table["side"].to_pylist())
        sets = list(Shingler(size).sets(table["text"].combine_chunks()))
        larges = [np.unique(np.array(v, np.int64)) for v in table["larges"].to_pylist()]
        copies = np.array(table["copies"].to_pylist(), np.int64)
        cut = int((side == 0).sum())
        mine, other = slice(0, cut), slice(cut, None)
        alone = cut == len(ids)
        at = np.argwhere(linked(sets[mine], None if alone else sets[other], percent))
        at += [0, 0 if alone else cut]
        at = [(i, j) for i, j in at.tolist() if len(np.intersect1d(larges[i], larges[j], assume_unique=True))]
        root, links = list(range(len(ids))), np.zeros(len(ids), np.int64)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in at:
            links[i] += copies[j]
            links[j] += copies[i]
            i, j = find(i), find(j)
            if i != j:
                i, j = (i, j) if ids[i] < ids[j] else (j, i)
                root[j] = i
        return [(ids[i], ids[find(i)], int(links[i])) for i in np.flatnonzero(links).tolist()]

    def run(batches):
        last, held = None, []
        schema = None
        for b in batches:
            schema = pa.schema([("id", b.schema.field("id").type), ("root", b.schema.field("id").type), ("links", pa.int64())])
            keys = list(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True))
            begin = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(begin[:-1], begin[1:], strict=True):
                if held and keys[lo] != last:
                    yield columns(solve(pa.Table.from_batches(held)), schema)
                    held = []
                last = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield columns(solve(pa.Table.from_batches(held)), schema)

    return rows.mapInArrow(lean(run), f"id {kind}, root {kind}, links long")


def joined_on(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Inner join with settled keys, which are broadcast up to BROADCAST_KEYS of them."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """Classes, links and components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    1. Documents with equal sets are one class, represented by its least id.
       All tokens of the corpus are counted, exactly and over all tasks.
    2. Representatives are indexed (see ``index``); keys of one set alone go.
    3. Pairs in small buckets are listed where sizes, the places of frequent
       keys and the number of shared rare keys allow a link, and verified.
    4. Members of large buckets go into blocks by their least large key.  Two
       blocks that share a large key are compared set by set in one task, which
       hands on a spanning forest and numbers of links, never the pairs: what
       it returns is linear in what it gets, and so is what a task holds.

    A pair that shares a large key is judged in step 4, every other one in step
    3, so each link between different sets is counted once, and none is lost.

    The filter of step 3 loses no link.  Let linked sets of n and m tokens
    share o tokens, r of them rare.  If r <= SLACK, the first frequent tokens
    they share have at least o - r - 2 shared ones behind them, so their key's
    place is n - o + r at most, in either set: places beyond n - o + SLACK
    need no look.  If r > SLACK, either the prefixes share at most one
    frequent token, and rare_needed holds, or all r rare ones lie before the
    frequent ones in both prefixes, and r + f reaches what prefixes share.

    Returns one row per input row: id, n_shingles, class_id (the least id with
    the same set), n_links (other documents it links with, copies included)
    and component_id.

    Defined results: null, empty and wordless texts have empty sets, no links,
    and are components of their own; texts of fewer words than a shingle have
    one shingle; rows that repeat an id are one document if their texts are
    equal (an output row for each); a null id is never linked; an empty table
    gives an empty result; other columns are ignored.  Shingles are equal if
    their 64-bit hashes are, which rest on 62-bit hashes of words.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, max(0, (volume // 5 // BIN)).bit_length())
    first = settle(signatures(texts, size, bits), "ngram-counts")
    sigs = settle(first.where("n is not null").select("id", "n", "s1", "s2"), "ngram-signatures")
    frequent = frequent_tokens(first.where("bin is not null").select("bin", "toks", "cnts"), bits)
    discard(first)  # some 4 bytes for each token of the corpus, and again in their shuffle
    classes = sigs.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    reps = settle(classes, "ngram-classes")
    rep_texts = restrict(texts, reps.select(F.col("rep").alias("id")), "id", reps.count())
    keys = settle(index(rep_texts, frequent, size, percent), "ngram-keys")
    buckets = settle(keys.groupBy("key").agg(F.count_distinct("id").alias("m")).where("m > 1"), "ngram-buckets")
    rows = joined_on(keys, buckets.where(F.col("m") <= SMALL), "key").distinct()
    large = settle(buckets.where(F.col("m") > SMALL).select("key", F.lit(True).alias("large")), "ngram-large-keys")
    # key rows are marked, not joined away and listed again: no step makes more rows than there are keys
    marked = keys.select("key", "id").join(F.broadcast(large) if large.count() <= BROADCAST_KEYS else large, "key", "left")
    held = marked.where("large").groupBy("id").agg(F.min("key").alias("least"), F.collect_set("key").alias("larges"))
    held = settle(held, "ngram-large")
    copies = reps.select(F.col("rep").alias("id"), "copies")

    # step 3
    one, two = rows.drop("m"), rows.drop("m").toDF(*[f"{c}2" for c in rows.drop("m").columns])
    last = SLACK - overlap_needed("n", "n2", percent)
    on = (F.col("key") == F.col("key2")) & (F.col("id") < F.col("id2"))
    on &= 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    on &= (F.col("place") <= F.col("n") + last) & (F.col("place2") <= F.col("n2") + last)
    shared = one.join(two, on).groupBy(F.col("id").alias("a"), F.col("id2").alias("b"))
    shared = shared.agg(
        F.count_if(~F.col("often")).alias("rare"),
        F.max("often").alias("often"),
        F.first("n").alias("n"),
        F.first("n2").alias("n2"),
        F.first(F.least("f", "f2")).alias("f"),
    )
    need = rare_needed("n", "n2", percent)
    enough = F.col("often") | (F.col("rare") >= need) | ((F.col("rare") > SLACK) & (F.col("rare") + F.col("f") > need))
    pairs = shared.where(enough).select("a", "b")
    if not held.isEmpty():
        for c in ("a", "b"):
            pairs = pairs.join(held.select(F.col("id").alias(c), F.col("larges").alias(f"l{c}")), c, "left")
        pairs = pairs.where("not coalesce(arrays_overlap(la, lb), false)").select("a", "b")
    links = verified(settle(pairs, "ngram-pairs"), texts, size, percent)
    ways = links.union(links.select("b", "a")).join(copies.withColumnRenamed("id", "b"), "b")
    partial = ways.groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("links"))
    edges = links

    # step 4
    if not held.isEmpty():
        sizes = held.join(reps.select(F.col("rep").alias("id"), "n"), "id")
        sizes = sizes.groupBy("least").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens"))
        parts = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS))
        placed = held.join(sizes, "least").withColumn("block", F.xxhash64("least", F.pmod(F.xxhash64("id"), parts.cast("long"))))
        placed = settle(placed.select("id", "block", "larges"), "ngram-blocks")
        where = placed.select("id", "block")
        where = F.broadcast(where) if placed.count() <= BROADCAST_KEYS else where
        at = marked.join(where, "id", "left").where("large and block is not null").select("key", "block").distinct()
        meet = at.withColumnRenamed("block", "x").join(at.withColumnRenamed("block", "y"), "key").where("x <= y")
        meet = settle(meet.select("x", "y").distinct(), "ngram-meetings")
        wide = placed.join(copies, "id")
        wide = wide.join(restrict(texts, placed, "id", placed.count()).dropDuplicates(["id"]), "id")
        wide = settle(wide, "ngram-members")
        sent = wide.join(meet, wide["block"] == meet["x"]).withColumn("side", F.lit(0))
        sent = sent.unionByName(wide.join(meet.where("x < y"), wide["block"] == meet["y"]).withColumn("side", F.lit(1)))
        found = settle(block_links(sent.select("x", "y", "side", "id", "text", "larges", "copies"), size, percent), "ngram-block-links")
        edges = edges.union(found.select("id", "root"))
        partial = partial.union(found.groupBy("id").agg(F.sum("links").alias("links")))

    nodes = settle(copies, "ngram-nodes")
    found = settle(components(nodes, edges), "ngram-components")
    total = partial.groupBy("id").agg(F.sum("links").alias("links"))
    summed = joined(joined(nodes, found, ["id"]), total, ["id"]).select(
        F.col("id").alias("rep"), "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    of_class = reps.join(summed, "rep").select("n", "s1", "s2", "rep", "component", "links")
    # equal texts may be a third of all rows: their class row is broadcast while classes are few, else AQE splits the key
    alone = F.col("id").isNull() | (F.col("n") == 0)
    out = sigs.join(of_class, ["n", "s1", "s2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.coalesce("rep", "id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.coalesce("component", "id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: a row with the least id (null ids come last).

    Rows are told by the hash of their texts, so null and repeated ids go the
    same way; rows with empty sets all stay.
    """
    every, text = F.struct(*[docs[c] for c in docs.columns]).alias("__all"), docs[text_col].alias("text")
    keyed = docs.select(every, docs[id_col].alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__key"))
    found = near_duplicates(docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("__key"), text), "__key", "text", size, percent)
    found = found.where("n_shingles > 0")
    found = settle(found.select("__key", "component_id").distinct(), "ngram-found")
    same = keyed.groupBy("__key", "id").agg(F.count(F.lit(1)).alias("copies"))
    least = F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "__key", "copies")).alias("w")
    best = same.join(found, "__key").groupBy("component_id").agg(least, F.sum("copies").alias("n")).where("n > 1")
    judged = found.join(best, "component_id").select("__key", F.col("w.__key").alias("win"), F.col("w.id").alias("id"), F.col("w.copies").alias("copies"))
    return one_of_each(keyed, settle(judged, "ngram-judged"), "__key", "id").select("__all.*")
