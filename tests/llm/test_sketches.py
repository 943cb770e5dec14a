"""The sketches of the near-duplicate stage against pairs whose similarity is known."""

import numpy as np

from vellumine.llm.simhash import SIMILARITY, SKETCH_LEAST, _stacked, sketch, sketch_likeness


def least_likeness(pairs, seed):
    """The least share of agreeing bins of pairs at the similarity or just above it, and the pairs that fall below the bound."""
    r = np.random.default_rng(seed)
    a, b = [], []
    for _ in range(pairs):
        n = int(r.integers(1, 1200))  # shingles of both
        common = int(np.ceil(SIMILARITY * n - 1e-9))
        hashes = r.integers(0, 2**64, n, dtype=np.uint64)
        cut = common + int(r.integers(0, n - common + 1))
        a.append(sketch(np.unique(hashes[:cut])))
        b.append(sketch(np.unique(np.concatenate([hashes[:common], hashes[cut:]]))))
    alike = sketch_likeness(_stacked(a), _stacked(b))
    return alike.min(), int((alike < SKETCH_LEAST).sum())


def test_no_pair_of_the_similarity_is_lost():
    least, lost = least_likeness(10_000, 1)
    assert lost == 0, least
