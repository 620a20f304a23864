"""What the findings of a round were about, on small inputs."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from tamis.llm import ngram_join, toxicity


def test_keys_of_rare_tokens_have_small_buckets(spark, monkeypatch):
    """However many tokens a corpus has: a phrase that more than SMALL sets share makes no large key where sets have rarer tokens."""
    monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 10, raising=False)  # what a corpus of 6 GB came to
    names = []

    def settle(df, name, put=ngram_join.settle):
        names.append(name)
        return put(df, name)

    monkeypatch.setattr(ngram_join, "settle", settle)
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(40)), *(f"phrase{k}" for k in range(4 + 20))])) for i in range(200)]
    rows.append((900, rows[7][1]))
    out = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()}
    assert "ngram-members" not in names
    assert out[900].component_id == 7 and out[900].n_links == 1 and out[8].n_links == 0


def test_counting_grams_holds_little(spark):
    """A Python task stays far below what an executor of 3,000 MB has left for its workers."""

    class Rows:
        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            raise StopIteration

    rows, rng = Rows(), random.Random(4)
    with pytest.raises(StopIteration):
        toxicity.gram_counts(rows)
    texts = ["".join(rng.choices("abcdefgh ", k=4000)) for _ in range(1000)]
    table = pa.table({"text": texts, "toxic": pa.array([0, 1] * 500, pa.int32()), "half": pa.array([0, 0, 1, 1] * 250, pa.int32())})
    tracemalloc.start()
    found = list(rows.run(iter(table.to_batches())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    symbols = sum(len(toxicity.symbols(pa.array([t]))[0]) - toxicity.ORDER + 1 for t in texts)
    assert peak < 60e6 and sum(sum(b.column(k).to_pylist()) for b in found for k in (1, 2)) == symbols


def test_batches_of_long_texts_are_small(spark):
    from tamis.llm.common import ARROW_BYTES, small_batches

    small_batches(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = spark.range(0, 300, 1, 1).selectExpr("repeat('word ', 20000) AS text")
    found = texts.mapInArrow(run, "n long, size long").collect()
    assert sum(x["n"] for x in found) == 300 and max(x["size"] for x in found) < 2 * ARROW_BYTES
