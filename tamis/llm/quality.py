"""Quality by averaged subword vectors and softmax, trained by stochastic gradient descent."""

from __future__ import annotations

import zlib
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

BUCKETS = 1 << 16
DIM = 12
#: Labelled rows that the vectors are fitted on, at most.
TRAIN_ROWS = 6000
#: Words whose contribution a task remembers; others are computed anew.
MEMORY = 400_000


def grams(s: str | bytes) -> set:
    """s itself and its n-grams of 3 and 4, each once."""
    return {s, *[s[i : i + 3] for i in range(len(s) - 2)], *[s[i : i + 4] for i in range(len(s) - 3)]}


def features(word: str) -> list[int]:
    """Hashed word and its character n-grams of 3 and 4, borders marked."""
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in sorted(grams(f"<{word}>"))]


class Contribution(dict):
    """word -> its part of the logit: mean of its features' vectors times the class weights.

    Most of a corpus' distinct words are rare, so a word that isn't remembered
    has to be cheap: plain numbers, and ASCII words are cut as bytes, which
    gives the same grams.  The sum is exact, so the order of a set is nothing.
    """

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table.tolist()

    def __missing__(self, word: str) -> float:
        table = self.table
        if word.isascii():
            crc, own = zlib.crc32, grams(b"<%b>" % word.encode())
            v = fsum([table[crc(g) % BUCKETS] for g in own]) / len(own)
        else:
            own = features(word)
            v = fsum([table[k] for k in own]) / len(own)
        if len(self) < MEMORY:
            self[word] = v
        return v


def fit(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 20.0, seed: int = 1, batch: int = 32):
    """(vectors, output weights, output bias) of a two-class softmax over averaged vectors."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    of_word: list[np.ndarray] = []
    docs = []
    for t in texts:
        words = t.split()
        for w in set(words):
            if w not in index:
                index[w] = len(of_word)
                of_word.append(np.array(features(w)))
        ids, n = np.unique([index[w] for w in words], return_counts=True)
        f = np.concatenate([of_word[i] for i in ids]) if len(ids) else np.zeros(0, int)
        w = np.concatenate([np.full(len(of_word[i]), c / len(of_word[i])) for i, c in zip(ids, n, strict=True)]) if len(ids) else np.zeros(0)
        u, back = np.unique(f, return_inverse=True)
        docs.append((u, np.bincount(back, w, len(u)) / max(1, len(words))))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias, y = np.zeros((DIM, 2)), np.zeros(2), np.array(labels)
    steps = max(1, epochs * -(-len(docs) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            lr = rate * (1 - step / steps)
            step += 1
            some = order[at : at + batch]
            hidden = np.array([docs[i][1] @ vectors[docs[i][0]] for i in some])
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ out.T
            out -= 0.1 * lr * hidden.T @ p
            bias -= 0.1 * lr * p.sum(0)
            for i, g in zip(some, back, strict=True):
                vectors[docs[i][0]] -= lr * docs[i][1][:, None] * g
    return vectors, out, bias


def train(labelled: DataFrame, id_col: str = "doc_id", rows: int = TRAIN_ROWS):
    """Fits on at most `rows` labelled rows (columns id, text, quality), chosen by a hash of the id.

    Returns (logit part of each bucket, bias): all that scoring needs.
    """
    some = sampled(labelled.where("quality is not null"), id_col, rows).select("text", "quality").collect()
    if not some:
        return np.zeros(BUCKETS, np.float32), 0.0
    vectors, out, bias = fit([r["text"] or "" for r in some], [int(r["quality"]) for r in some])
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: better) of every whole text.

    Null and wordless texts get the score of the bias alone; repeated rows
    come out again; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: 256 KB

    def run(batches):
        table, bias = held.value
        part = Contribution(table)
        for b in batches:
            z = []
            for t in b["text"]:
                words = (t or "").split()
                z.append(bias + (sum(map(part.__getitem__, words)) / len(words) if words else 0.0))
            yield pd.DataFrame({"id": b["id"], "score": 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")
