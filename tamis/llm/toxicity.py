"""Toxicity by class-conditional Kneser-Ney models over the symbols of a text, words and gaps alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, settle, small_batches
from .words import mix

#: Symbols of a gram.  A gram is its symbols side by side in a long, so eight would be the most.
ORDER = 5
DISCOUNT = 0.75
#: Share of a symbol that no gram has.
UNSEEN = 1 / 256
#: Symbols of a window (a word or two).
WINDOW = 10
#: Labelled rows that the calibration (four weights) is fitted on, at most; the counts take all.
CALIBRATION_ROWS = 8000
#: Grams that a task holds before it hands their counts on.
HELD = 400_000
COUNTS = ["toxic", "ordinary", "toxic_half", "ordinary_half"]
GAP = 32


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, bounds) of lower-cased texts: the bytes of letters, and one GAP for each run of anything else.

    Every text begins with ORDER - 1 gaps, so no gram reaches into the text before.
    """
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
    at = at - at[0]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    out = np.where(letter, data, GAP).astype(np.uint8)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of others
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = letter[first]  # not at the start of a text, which has gaps of its own
    places = np.concatenate([[0], np.cumsum(keep)])[at]
    pad = ORDER - 1
    every = np.insert(out[keep], np.repeat(places[:-1], pad), GAP)
    return every, places + pad * np.arange(len(places))


def grams(every: np.ndarray) -> np.ndarray:
    """The gram that ends at each symbol."""
    out = np.zeros(len(every), np.uint64)
    for k in range(min(ORDER, len(every))):
        out[k:] |= every[: len(every) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which symbols aren't the gaps at a text's start."""
    out = np.ones(n, bool)
    for k in range(ORDER - 1):
        out[bounds[:-1] + k] = False
    return out


def slices(batch: pa.RecordBatch, rows: int = 64):
    """A step holds some 80 bytes for each byte of its rows' texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fitted(text: Column) -> Column:
    """Whether a labelled row is counted for the calibration's model; the calibration takes the others.  Equal texts go together."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)) == 0


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary, toxic_half, ordinary_half) over all symbols of labelled (text, toxic); halves count `fitted` rows."""

    def run(batches):
        # keys: gram and kind, sorted; a task's memory stays bounded
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def summed():
            gram = keys >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            cols = [np.add.reduceat(np.where(keys & np.uint64(3) == k, counts, 0), first) for k in range(4)]
            rows = [gram[first].view(np.int64), cols[1] + cols[3], cols[0] + cols[2], cols[3], cols[2]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["gram", *COUNTS])

        for batch in batches:
            for b in slices(batch):
                every, bounds = symbols(b.column("text"))
                kind = np.asarray(b.column("toxic")) + 2 * np.asarray(b.column("half"))
                use = inside(bounds, len(every))
                found = (grams(every)[use] << np.uint64(2)) | np.repeat(kind, np.diff(bounds))[use].astype(np.uint64)
                found, times = np.unique(found, return_counts=True)
                found, times = np.concatenate([keys, found]), np.concatenate([counts, times])
                by = np.argsort(found, kind="stable")
                found = found[by]
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else by
                keys, counts = found[first], np.add.reduceat(times[by], first) if len(found) else counts
                if len(keys) > HELD:
                    yield summed()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield summed()

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), fitted(F.col("text")).cast("int").alias("half"))
    parts = rows.mapInArrow(lean(run), "gram long, " + ", ".join(f"{c} long" for c in COUNTS))
    return settle(parts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS]), "toxicity-grams")


def shared_backoff(top: DataFrame) -> DataFrame:
    """(gram, p) of all grams of ORDER - 1 symbols: their last symbol's share after the others, from both classes' kinds."""
    level = top.select("gram")
    sizes = {}
    for k in range(ORDER - 1, 0, -1):
        # a gram's kinds: how many different symbols stand before it
        level = level.select(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"))
        level = sizes[k] = settle(level, f"toxicity-kinds-{k}")
    below = None
    for k in range(1, ORDER):
        here = sizes[k].withColumn("before", F.shiftright("gram", 8))
        sums = here.groupBy("before").agg(F.sum("kinds").alias("n"), F.count(F.lit(1)).alias("many"))
        here = here.join(sums, "before")
        if below is None:
            p = F.lit(UNSEEN)
        else:
            here = here.withColumn("rest", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(below.toDF("rest", "p"), "rest")
            p = F.col("p")
        share = (F.greatest(F.col("kinds") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("many") * p) / F.col("n")
        below = settle(here.select("gram", share.alias("p")), f"toxicity-below-{k}")
    return below


def ratios(top: DataFrame, below: DataFrame, end: str = "") -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) and (before, ratio): log P(symbol | toxic) - log P(symbol | ordinary) of seen grams, and of unseen ones after a seen history.

    Each class discounts its own grams and leaves the rest to the backoff that
    both share, so an unseen gram's ratio is that of the two classes' leavings.
    """
    before, rest = F.shiftright("gram", 8), F.col("gram").bitwiseAND((1 << 8 * (ORDER - 1)) - 1)
    sums = [f(c).alias(f"{a}_{c}") for c in ("toxic", "ordinary") for a, f in (("n", F.sum), ("many", lambda c: F.count_if(F.col(c) > 0)))]
    seen = top.select("gram", F.col(f"toxic{end}").alias("toxic"), F.col(f"ordinary{end}").alias("ordinary"), before.alias("before"), rest.alias("rest"))
    seen = seen.where("toxic + ordinary > 0")
    hist = settle(seen.groupBy("before").agg(*sums), "toxicity-histories")
    both = seen.join(hist, "before").join(below.toDF("rest", "p"), "rest")

    def leaving(c):
        return F.when(F.col(f"n_{c}") > 0, DISCOUNT * F.col(f"many_{c}") / F.col(f"n_{c}")).otherwise(F.lit(1.0))

    def share(c):
        kept = F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(F.lit(0.0))
        return kept + leaving(c) * F.col("p")

    return (
        both.select("gram", (F.log(share("toxic")) - F.log(share("ordinary"))).cast("float").alias("ratio")),
        hist.select("before", (F.log(leaving("toxic")) - F.log(leaving("ordinary"))).cast("float").alias("ratio")),
    )


class Ratios:
    """Numbers by 64-bit key in an open hash table: a look-up is one or two gathers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(self.size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(self.size, np.float32)
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = keys[left[free]]  # of several, the last one gets the place
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & (self.size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(8)).astype(np.int64) & (self.size - 1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); absent keys have 0."""
        out, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            here = self.keys[at]
            hit = here == keys[left]
            out[left[hit]], found[left[hit]] = self.values[at[hit]], True
            go = ~hit & (here != np.uint64(0xFFFFFFFFFFFFFFFF))
            left, at = left[go], (at[go] + 1) & (self.size - 1)
        return out, found


class Model:
    def __init__(self, seen: Ratios, after: Ratios, weights=(-3.0, 1.0, 1.0, 0.0)) -> None:
        self.seen, self.after, self.weights = seen, after, np.array(weights, float)

    @classmethod
    def collected(cls, tables: tuple[DataFrame, DataFrame]) -> Model:
        # 12 bytes a gram; tasks get them as two tables of 12 bytes a slot
        got = [t.toArrow() for t in tables]
        return cls(*[Ratios(t.column(0).to_numpy().astype(np.int64).view(np.uint64), t.column(1).to_numpy()) for t in got])

    def per_symbol(self, every: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        key = grams(every)
        out, found = self.seen.get(key)
        miss = np.flatnonzero(~found)
        out[miss] = self.after.get(key[miss] >> np.uint64(8))[0]
        out[~inside(bounds, len(every))] = 0
        return out

    def features(self, column: pa.Array) -> np.ndarray:
        """(1, mean ratio a symbol of the whole text, mean ratio of its most toxic window, log of its length) of each text."""
        every, bounds = symbols(column)
        out = np.zeros((len(column), 4))
        out[:, 0] = 1
        sizes = np.diff(bounds) - (ORDER - 1)
        if not len(every):
            return out
        sums = np.concatenate([[0.0], np.cumsum(self.per_symbol(every, bounds), dtype=np.float64)])
        at = np.arange(len(every))
        from_ = np.maximum(at - WINDOW + 1, np.repeat(bounds[:-1], np.diff(bounds)))
        best = np.maximum.reduceat((sums[at + 1] - sums[from_]) / WINDOW, bounds[:-1])
        out[:, 1] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(sizes, 1)
        out[:, 2] = best
        out[:, 3] = np.log1p(sizes)
        out[sizes == 0, 1:] = 0
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fits the weights to features x and labels y; a higher ratio never lowers the score."""
        if not len(y):
            return
        use = np.ones(4, bool)
        for _ in range(3):
            w = np.zeros(4)
            for _ in range(60):  # Newton steps of a ridge-penalised logistic regression
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
                g = x.T @ (y - p) - 1e-2 * w
                w[use] += np.linalg.solve(h[np.ix_(use, use)], g[use])
            if not (bad := use & (w < 0) & [False, True, True, False]).any():
                break
            use &= ~bad
        self.weights = np.where(use, w, 0)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.weights, -30, 30)))


def train(labelled: DataFrame) -> Model:
    """Counts of all labelled rows (text, toxic 0/1); every gram is kept, seen once or not.

    The calibration is fitted on at most CALIBRATION_ROWS rows, by hash
    order, with a model that has not counted them.  Null texts count as empty;
    without rows the model has no evidence for any text.
    """
    small_batches(labelled.sparkSession)
    top = gram_counts(labelled)
    below = shared_backoff(top)
    apart = Model.collected(ratios(top, below, "_half"))
    rows = labelled.where(~fitted(F.col("text"))).select(F.xxhash64("text").alias("h"), "text", F.col("toxic").cast("int").alias("toxic"))
    held = labelled.sparkSession.sparkContext.broadcast(apart)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                x = held.value.features(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("h"), *[pa.array(x[:, k]) for k in (1, 2, 3)], b.column("toxic")], names=["h", "mean", "best", "size", "toxic"]
                )

    # features, not texts, go to the driver
    some = rows.mapInArrow(lean(run), "h long, mean double, best double, size double, toxic int")
    some = some.orderBy("h", "mean", "best", "size", "toxic").limit(CALIBRATION_ROWS).toPandas()
    x = np.column_stack([np.ones(len(some)), some["mean"], some["best"], some["size"]]) if len(some) else np.zeros((0, 4))
    apart.calibrate(x, some["toxic"].to_numpy(float))
    model = Model.collected(ratios(top, below))
    model.weights = apart.weights
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), mean and best of every whole text.

    The score is a logistic function of two log-likelihood ratios of the toxic
    and the ordinary model, both normalised by length: over the whole text, and
    over its most toxic window, as an insult drowns in a long text.  The log of
    the length goes in too, since more windows have a higher best one by chance.

    Null and letterless texts get the score of no evidence; repeated rows come
    out again; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                x = held.value.features(b.column("text"))
                z = np.clip(x @ held.value.weights, -30, 30)
                out = [b.column("id"), *[pa.array(c) for c in (1 / (1 + np.exp(-z)), x[:, 1], x[:, 2])]]
                yield pa.RecordBatch.from_arrays(out, names=["id", "score", "mean", "best"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(lean(run), f"id {kind}, score double, mean double, best double")
    return found.select(F.col("id").alias(id_col), "score", "mean", "best")
