"""The words of many texts are found together, and each different one is hashed once."""

import random
import re

import numpy as np
import xxhash

from workload_lens.llm import near_duplicates as nd

ODD = [None, "", "...", "a", "a b c d", "a b c d e", "ΑΣ", "ΑΣ. ΣΑ", "İ_1 ² ٠ é́ 中文 😀 𝒜b‍c", "x" * 300 + " y\x00z " * 40]


def _by_word(text):
    words = re.findall(r"\w+", (text or "").lower())
    codes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(nd.SHINGLE, len(words))
    return nd._rolled(codes, size) if words else codes


def test_shingles_are_those_of_each_text_alone(monkeypatch):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abÉß9_ \n.-Σ中") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    want = [_by_word(t) for t in texts]
    for stretch in (nd.STRETCH, 40):
        monkeypatch.setattr(nd, "STRETCH", stretch)
        assert all(map(np.array_equal, nd.all_shingles(texts), want))


def test_a_word_of_several_texts_is_hashed_once(monkeypatch):
    seen, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda word: seen.append(word) or digest(word))
    list(nd.all_shingles(["One two three", "two Three four", "one"]))
    assert sorted(seen) == [b"four", b"one", b"three", b"two"]
