"""All numbers of an Elias-Fano sequence at once are those of ``select``."""

import numpy as np
from workload_lens.llm.token_files import EliasFano


def test_all_numbers_at_once():
    make = np.random.default_rng(3)
    for n in (0, 1, 2, 257, 3000):
        for top in (0, 1, 10**6, 2**63, 2**64 - 1):
            numbers = np.sort(make.integers(0, top, n, dtype=np.uint64, endpoint=True))
            packed = EliasFano(n, *EliasFano.of(numbers).parts())
            assert packed.numbers().tolist() == numbers.tolist() == [packed.select(i) for i in range(n)]
