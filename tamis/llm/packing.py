"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, release, settle, small_batches

#: Pieces of one sub-problem (expected): the bound on what a task packs at once.
GROUP = 16_384
ISLANDS = 3
#: Rounds on the islands; between two of them each island's elite goes to its neighbour.
ROUNDS = 3
#: Generations of a round at most; a round ends when one brings nothing.
GENERATIONS = 4
POPULATION = 4
#: Strings that the vocabulary lists as tokens of their own, found before words are split: fixed values.
SPECIAL = {"<|endoftext|>": 50256}

PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: str | None = None):
    """Byte-level BPE of the public 50k vocabulary: text -> array of ids.

    The ranks file holds the same vocabulary as byte_bpe_50k.json and gives
    the same ids (tested) at four times the speed.  Strings of special tokens
    inside a text are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: own.encode(text, allowed_special="all") if "<|" in text else own.encode_ordinary(text)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than limit."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))] if n > limit else [(0, n)]


def tokenised(
    docs: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Pieces of every whole text: ids, then one id 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(vocabulary)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(ids), limit)):
                    rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (b.schema[0].type, pa.int32(), *[pa.int64()] * 3), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            ) if rows else pa.RecordBatch.from_pylist([], out)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = PIECES.format(kind=kind)
    out = to_arrow_schema(_parse_datatype_string(schema))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def best_fit(lengths: np.ndarray, items: list[int], limit: int, bins: list[list[int]]) -> list[list[int]]:
    """Puts items, longest first, each into the fullest bin that has room; bins is added to."""
    of = lengths.tolist()
    room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: some bin has r tokens left
    for k, held in enumerate(bins):
        r = limit - sum(map(of.__getitem__, held))
        room.setdefault(r, []).append(k)
        open_rooms |= 1 << r
    for i in sorted(items, key=lambda i: -of[i]):
        n = of[i]
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
            bins[k].append(i)
        else:
            r, k = limit, len(bins)
            bins.append([i])
        room.setdefault(r - n, []).append(k)
        open_rooms |= 1 << (r - n)
    return bins


def fill_well(lengths: np.ndarray, items: list[int], limit: int, rng) -> list[list[int]]:
    """Bins that are closed one by one: the longest item left, then the one or two that leave the least room, until none fits.

    Now and then (by rng) a length is passed over, so that each seed gives other bins.
    """
    left: dict[int, list[int]] = {}
    of = lengths.tolist()
    for i in items:
        left.setdefault(of[i], []).append(i)
    have = sum(1 << n for n in left)  # bit n: an item of n tokens is left
    bins = []

    def take(n: int) -> int:
        nonlocal have
        i = left[n].pop()
        if not left[n]:
            del left[n]
            have ^= 1 << n
        return i

    while have:
        n = have.bit_length() - 1
        held, room = [take(n)], limit - n
        while fits := have & ((1 << room + 1) - 1):
            one = fits.bit_length() - 1
            best = (room - one, (one,))
            pool, tried = fits, 0
            while pool and best[0] and tried < 64:  # the first of two, from the longest down
                first = pool.bit_length() - 1
                pool ^= 1 << first
                tried += 1
                if rng.random() < 0.1:
                    continue
                rest = fits & ((1 << room - first + 1) - 1)
                if len(left[first]) < 2 and rest >> first & 1:
                    rest ^= 1 << first
                if rest:
                    second = rest.bit_length() - 1
                    best = min(best, (room - first - second, (first, second)))
            for m in best[1]:
                held.append(take(m))
                room -= m
        bins.append(held)
    return bins


def crossover(lengths: np.ndarray, donor: list[list[int]], receiver: list[list[int]], limit: int, rng) -> list[list[int]]:
    """Whole well-filled bins of the donor go in; bins that hold their items go, and what they held besides is best-fitted."""
    of = lengths.tolist().__getitem__  # plain numbers: a bin holds few, for which arrays cost more than they save
    fill = np.array([sum(map(of, b)) for b in donor])
    good = np.flatnonzero(fill >= np.quantile(fill, 0.25))
    taken = [donor[k] for k in good[rng.random(len(good)) < 0.5]]
    inside = {i for b in taken for i in b}
    kept, displaced = [], []
    for b in receiver:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    least = [k for k, b in enumerate(kept) if sum(map(of, b)) < 0.9 * limit]  # poorly filled ones are dealt anew
    gone = set(least)
    displaced += [i for k in least for i in kept[k]]
    return best_fit(lengths, displaced, limit, [list(b) for b in taken] + [b for k, b in enumerate(kept) if k not in gone])


def fitness(lengths: np.ndarray, bins: list[list[int]]) -> tuple[int, float]:
    """Smaller is better: bins, then how unevenly they are filled."""
    of = lengths.tolist().__getitem__
    return len(bins), -float(sum(float(sum(map(of, b))) ** 2 for b in bins))


def evolve(lengths: np.ndarray, limit: int, seed: int, migrants: list[list[list[int]]] = (), generations: int = GENERATIONS):
    """The best grouping that an island finds in a round, from shuffled best fits and closely filled bins of its own seed, and migrants."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // limit)
    people = [[list(b) for b in m] for m in migrants]
    while len(people) < POPULATION:
        if len(people) % 2:
            people.append(fill_well(lengths, list(range(len(lengths))), limit, rng))
        else:  # a part is packed first, so what goes together differs
            some = rng.permutation(len(lengths))
            part = int(len(some) * rng.uniform(0.3, 0.7))
            half = best_fit(lengths, some[:part].tolist(), limit, [])
            people.append(best_fit(lengths, some[part:].tolist(), limit, half))
    best = None
    for _ in range(generations):
        people.sort(key=lambda p: fitness(lengths, p))
        now = fitness(lengths, people[0])
        if now[0] <= least or now == best:
            break
        best = now
        mate = people[int(rng.integers(1, len(people)))]
        children = [crossover(lengths, mate, people[0], limit, rng), crossover(lengths, people[0], mate, limit, rng)]
        people = people[: POPULATION - 2] + children
    return min(people, key=lambda p: fitness(lengths, p))


def pack(pieces: DataFrame, limit: int = 2048, group: int = GROUP, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most limit tokens.

    Pieces are dealt by hash into sub-problems of some `group` rows, so a task
    holds a bounded number of lengths at any input size, and a hot document
    or source is spread.  Each sub-problem is first packed by best-fit
    decreasing; one whose sequences reach the lower bound leaves at once, as
    nothing can be better.  The others go to `islands` islands for `rounds`
    rounds.  In the first, an island evolves that packing and shuffled ones of
    its own seed; then each starts from its own elite and its neighbour's.  The
    best elite of all is the result.  Loss from splitting: less than one
    sequence a sub-problem.

    Repeated rows are packed as often as they occur; an empty table gives an
    empty result.
    """
    subs = max(1, -(-pieces.count() // group))
    keyed = pieces.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(subs)).cast("int"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    out = f"{PIECES.format(kind=kind)}, sub int, island int, sequence_id long, offset long, done boolean"
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def bins_of(pdf: pd.DataFrame) -> list[list[int]]:
        by: dict[int, list[int]] = {}
        for i, s in enumerate(pdf["sequence_id"]):
            by.setdefault(int(s), []).append(i)
        return list(by.values())

    def placed(pdf: pd.DataFrame, bins: list[list[int]]) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(bins):
            seq[b] = (int(pdf["sub"].iloc[0]) << 32) + k
            off[b] = np.cumsum(lengths[b]) - lengths[b]
        done = len(bins) <= -(-int(lengths.sum()) // limit)
        release()
        return pdf.assign(sequence_id=seq, offset=off, done=done)[[*order, "sub", "island", "sequence_id", "offset", "done"]]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True, kind="stable").assign(island=0)
        return placed(pdf, best_fit(pdf["length"].to_numpy(), list(range(len(pdf))), limit, []))

    def islanders(step: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            """One sub-problem on one island; rows come once for each elite, told by `origin`."""
            elites = [p.sort_values(order, ignore_index=True, kind="stable") for _, p in pdf.groupby("origin", sort=True)]
            mine = elites[0]
            seed = 1_000_003 * int(mine["sub"].iloc[0]) + 101 * int(mine["island"].iloc[0]) + step
            return placed(mine, evolve(mine["length"].to_numpy(), limit, seed, [bins_of(p) for p in elites]))

        return run

    found = settle(keyed.groupBy("sub").applyInPandas(first, out), "packing-0")
    done, open_ = found.where("done"), found.where("not done").drop("done", "offset")
    if open_.isEmpty():
        return done.select(*order, "sequence_id", "offset")
    # the first round's rows: best-fit decreasing, on every island
    sent = open_.withColumn("origin", F.lit(0)).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    for step in range(1, rounds + 1):
        elite = settle(sent.groupBy("sub", "island").applyInPandas(islanders(step), out), f"packing-{step}")
        own = elite.drop("done", "offset").withColumn("origin", F.lit(0))
        moved = own.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(islands)), "origin": F.lit(1)})
        sent = own.unionByName(moved) if islands > 1 else own
    bins = elite.groupBy("sub", "island").agg(F.countDistinct("sequence_id").alias("n"))
    best = bins.groupBy("sub").agg(F.min(F.struct("n", "island"))["island"].alias("island"))
    chosen = elite.join(best, ["sub", "island"], "left_semi")
    return done.unionByName(chosen.select(*done.columns)).select(*order, "sequence_id", "offset")


def pack_documents(docs: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack every row.

    Null text: empty, one piece with the closing id alone; rows that repeat an
    id, or have none, are packed like others; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    packed = pack(settle(tokenised(docs, limit, id_col, text_col), "packing-pieces"), limit)
    return packed.withColumnRenamed("doc_id", id_col)
