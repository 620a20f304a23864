import numpy as np

from tamis.llm import packing as P


class Counted(np.ndarray):
    taken = 0

    def __getitem__(self, key):
        Counted.taken += 1
        return super().__getitem__(key)


def test_bins_are_summed_as_plain_numbers():
    lengths = np.random.default_rng(4).integers(400, 900, 600)
    Counted.taken = 0
    bins = P.evolve(lengths.view(Counted), 2048, 7)
    assert Counted.taken < 50  # once a bin, of hundreds, costs more than the packing
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(lengths[b].sum() <= 2048 for b in bins)
    assert bins == P.evolve(lengths, 2048, 7)
