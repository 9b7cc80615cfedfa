"""What a worker keeps between tasks is small."""

import random

import numpy as np
import pyarrow as pa

from workload_lens.llm import bpe, common
from workload_lens.llm import repeated_strings as rs


def test_tables_of_powers_are_small_and_a_long_text_has_the_same_anchors(monkeypatch):
    assert rs._UP.nbytes + rs._DOWN.nbytes < 8 << 20
    raw = random.Random(2).randbytes(3000)
    keys, firsts, lasts = rs.anchors(raw)
    monkeypatch.setattr(rs, "STRETCH", 700)  # a border ends an anchor's starts, and the next stretch goes on with them
    cut = rs.anchors(raw)
    of = [{int(k) for k in np.repeat(k, b - a + 1)} for k, a, b in ((keys, firsts, lasts), cut)]
    assert of[0] == of[1]
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(*cut[1:], strict=True)]).tolist() == list(range(len(raw) - rs.LENGTH + 1))


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"n": list(range(5))})
    assert [b.num_rows for b in common.slices(iter([batch, batch.slice(0, 0)]), 2)] == [2, 2, 1]


def test_fragments_are_kept_packed():
    own = bpe.Codec(bpe.vocabulary_path())
    assert own.decode(own.encode("some words, é 中文")) == "some words, é 中文"
    assert own.fragments and all(isinstance(v, bytes) for v in own.fragments.values())
