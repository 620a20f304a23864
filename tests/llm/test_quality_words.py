import numpy as np

from tamis.llm import quality as Q


def test_words_parts_are_means_of_their_features():
    table = np.random.default_rng(1).normal(size=Q.BUCKETS).astype(np.float32)
    part = Q.Contribution(table)
    assert isinstance(part.table, list)  # indexing an array costs more than the hashes of a rare word
    for w in ["a", "ab", "abc", "aaaaaaa", "token%b", "<<>>", "größe", "ß", "日本語の本", "x\ud800y"]:
        assert abs(part[w] - float(table[Q.features(w)].astype(float).mean())) < 1e-12
        assert part[w] == part[w]
