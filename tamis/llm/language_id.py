"""Language of documents by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
#: Documents that the field is fitted on, at most; each with its whole text.
TRAIN_ROWS = 700
#: Words of each language's lexicon.
LEXICON = 200
#: Training sequences: this many words of a document, then as many of another, so that switches are seen.
RUN = 12
MEMORY = 400_000
#: Words that a task decodes at once.
CHUNK = 600_000


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; other numerals (as in m²) are left out of their run."""
    found = WORD.findall((text or "").lower())
    if not found or "".join(found).isalpha():
        return found
    return [k for w in found if (k := w if w.isalpha() else "".join(filter(str.isalpha, w)))]


class Hashed(dict):
    """gram -> its bucket under a kind of feature; grams come again and again, so each is hashed once."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def __missing__(self, gram: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        k = self[gram] = zlib.crc32(f"{self.kind}{gram}".encode("utf-8", "replace")) % BUCKETS
        return k


PREFIX, SUFFIX, INNER, LISTED = Hashed("p"), Hashed("s"), Hashed("n"), Hashed("l")


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Affixes, inner n-grams, the whole word, and the lexicons that list it (a bit each)."""
    s = f"<{word}>"
    keys = [zlib.crc32(f"w{word}".encode("utf-8", "replace")) % BUCKETS]
    keys += [PREFIX[word[:n]] for n in (1, 2, 3)]
    keys += [SUFFIX[word[-n:]] for n in (1, 2, 3)]
    keys += [INNER[s[i : i + n]] for n in (2, 3) for i in range(len(s) - n + 1)]
    seen, bit = lexicon.get(word, 0), 0
    while seen >> bit:
        if seen >> bit & 1:
            keys.append(LISTED[str(bit)])
        bit += 1
    return keys


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, want_pairs: bool = False):
    """Posteriors of each word's label in sequences laid end to end (emit: words x labels, scores).

    Every step runs over all sequences that are still open.  With want_pairs,
    also the expected count of each transition.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    e = np.exp(emit - emit.max(1, keepdims=True))
    t = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(e), np.empty_like(e)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # sequences with more than `step` words
    for step in range(longest):
        at = starts[: live[step]] + step
        a = e[at] * (alpha[at - 1] @ t) if step else e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    beta[starts + sizes - 1] = 1.0
    for step in range(longest - 2, -1, -1):
        at = starts[: live[step + 1]] + step
        b = (beta[at + 1] * e[at + 1]) @ t.T
        beta[at] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    if not want_pairs:
        return post
    inner = np.ones(len(e), bool)
    inner[starts + sizes - 1] = False
    at = np.flatnonzero(inner)
    pair = alpha[at][:, :, None] * t[None] * (beta[at + 1] * e[at + 1])[:, None, :]
    return post, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


def fit(texts: list[str], labels: list[int], kinds: int, epochs: int = 15, rate: float = 0.5):
    """(feature weights, transitions, lexicon) by gradient ascent (scaled by past gradients) on the field's likelihood."""
    parts = [words(t) for t in texts]
    counts = [Counter() for _ in range(kinds)]
    for w, c in zip(parts, labels, strict=True):
        counts[c].update(w)
    lexicon: dict[str, int] = {}
    for c, n in enumerate(counts):
        for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << c
    runs = [(w[s : s + RUN], c) for w, c in zip(parts, labels, strict=True) for s in range(0, len(w), RUN)]
    rng = np.random.default_rng(1)
    rng.shuffle(order := np.arange(len(runs)))
    tokens = [w for i in order for w in runs[i][0]]
    truth = np.array([runs[i][1] for i in order for _ in runs[i][0]], int)
    sizes = np.array([len(runs[i][0]) for i in order], int)
    joined = np.add.reduceat(sizes, np.arange(0, len(sizes), 2)) if len(sizes) else sizes
    weights, trans = np.zeros((BUCKETS, kinds)), np.zeros((kinds, kinds))
    if not tokens:
        return weights.astype(np.float32), trans, lexicon
    index = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    feats = [features(w, lexicon) for w in index]
    flat, width = np.concatenate(feats), np.array([len(f) for f in feats])
    begin = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(feats)), width)
    ids = np.array([index[w] for w in tokens])
    hit = np.zeros((len(tokens), kinds))
    hit[np.arange(len(tokens)), truth] = 1
    last = np.cumsum(joined) - 1
    inner = np.setdiff1d(np.arange(len(tokens)), last)
    seen = np.zeros((kinds, kinds))
    np.add.at(seen, (truth[inner], truth[inner + 1]), 1)
    past_w, past_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(epochs):
        by_word = np.add.reduceat(weights[flat], begin)
        post, pairs = forward_backward(by_word[ids], joined, trans, True)
        gap = hit - post
        per_word = np.stack([np.bincount(ids, gap[:, k], len(index)) for k in range(kinds)], 1)
        grad = np.stack([np.bincount(flat, per_word[owner, k], BUCKETS) for k in range(kinds)], 1) - 1e-2 * weights
        past_w += grad**2
        weights += rate * grad / np.sqrt(past_w)
        g = seen - pairs - 1e-2 * trans
        past_t += g**2
        trans += rate * g / np.sqrt(past_t)
    return weights.astype(np.float32), trans, lexicon


def train(labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS):
    """Fits on at most `rows` documents with a language, chosen by a hash of the id; returns the model."""
    some = sampled(labelled.where(F.col(lang_col).isNotNull()), id_col, rows).select(text_col, lang_col).collect()
    langs = sorted({r[lang_col] for r in some})
    return (langs, *fit([r[text_col] for r in some], [langs.index(r[lang_col]) for r in some], len(langs)))


class Scores(dict):
    """word -> row of a table of label scores, made for all new words at once."""

    def __init__(self, weights: np.ndarray, lexicon: dict[str, int]) -> None:
        super().__init__()
        self.weights, self.lexicon, self.fresh = weights, lexicon, []
        self.table = np.zeros((0, weights.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.fresh.append(features(word, self.lexicon))
        return k

    def rows(self, ids: np.ndarray) -> np.ndarray:
        if self.fresh:
            width = np.array([len(f) for f in self.fresh])
            flat = np.fromiter((k for f in self.fresh for k in f), int, int(width.sum()))
            self.table = np.concatenate([self.table, np.add.reduceat(self.weights[flat], np.cumsum(width) - width)])
            self.fresh = []
        return self.table[ids].astype(float)

    def forget(self) -> None:
        """Beyond MEMORY words a task starts anew, so its memory stays bounded."""
        if len(self) > MEMORY:
            self.clear()
            self.table = self.table[:0]


def languages(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (mean posterior of that language over the words) and word_langs of every whole text.

    word_langs counts the words by their most likely label, so code-switched
    texts show.  Null texts and texts without a letter get `und` and score 0;
    without any learned language all do.  Repeated rows come out again; an
    empty table gives an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats and the lexicons

    def run(batches):
        langs, weights, trans, lexicon = held.value
        scores = Scores(weights, lexicon)
        for b in batches:
            out = [("und", 0.0, {})] * len(b)

            def decode(part, out=out):
                sizes = np.array([len(w) for _, w in part])
                ids = np.fromiter((scores[w] for _, ws in part for w in ws), int, int(sizes.sum()))
                post = forward_backward(scores.rows(ids), sizes, trans)
                begin = np.cumsum(sizes) - sizes
                mean = np.add.reduceat(post, begin) / sizes[:, None]
                top = post.argmax(1)
                for (k, _), m, s, n in zip(part, mean, begin, sizes, strict=True):
                    c = np.bincount(top[s : s + n], minlength=len(langs))
                    out[k] = (langs[int(m.argmax())], float(min(1.0, m.max())), {lang: int(v) for lang, v in zip(langs, c, strict=True) if v})
                scores.forget()

            part, held_words = [], 0
            for k, text in enumerate(b["text"]):
                if langs and (w := words(text)):
                    part.append((k, w))
                    held_words += len(w)
                    if held_words >= CHUNK:
                        decode(part)
                        part, held_words = [], 0
            if part:
                decode(part)
            yield pd.DataFrame({"id": b["id"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "word_langs": [x[2] for x in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double, word_langs map<string,bigint>").withColumnRenamed("id", id_col)
