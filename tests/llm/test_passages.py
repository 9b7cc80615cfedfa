"""Passages of over 50 words that several texts have, against all windows of 51 words."""

import re
from collections import defaultdict

import numpy as np
import pytest

from workload_lens.llm import repeated_strings as rs


def brute_force(texts):
    """The byte spans of each text whose 51 words another distinct text has."""
    words = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^ \t\n\v\f\r]+", (t or "").encode())] for t in texts]
    seen = defaultdict(set)
    for text, found in zip(texts, words, strict=True):
        for i in range(len(found) - 50):
            seen[tuple(w for *_, w in found[i : i + 51])].add(text)
    out = []
    for found in words:
        hit = [i for i in range(len(found) - 50) if len(seen[tuple(w for *_, w in found[i : i + 51])]) > 1]
        spans = rs.merged([{"first": i, "end": i + 51} for i in hit])
        out.append([(found[a][0], found[b - 1][1]) for a, b in spans])
    return out


@pytest.fixture
def rows():
    make = np.random.default_rng(5)

    def some(n, letters="abcdefghij"):
        return " ".join("".join(make.choice(list(letters), 3)) for _ in range(n))

    short, long, fifty, own = some(51), some(140), some(50), some(60)
    texts = [
        f"{some(30)}\n{short}\t {some(20)}", f"{short}  {some(9)}",  # 203 bytes
        f"{some(40)} {long} {some(3)}", f"{some(1)} {long}", f"{some(12)} {' '.join(long.split()[20:80])} {some(8)}",
        f"{fifty} {some(30)}", f"{some(30)} {fifty}",  # a word too few
        f"{own} {some(5)} {own}",  # within one text
        some(70), "", None, "é " * 60 + some(4), some(4) + " é" * 55,
    ]
    texts += [texts[8], some(3000, "xy")]
    return list(enumerate(texts))


def test_passages_are_those_of_all_windows(spark, rows, monkeypatch):
    expected = brute_force([t for _, t in rows])
    assert sum(map(bool, expected)) >= 6 and not any(expected[i] for i in (5, 6, 7, 8, 13))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for together in (rs.TOGETHER, 1):  # each text of an anchor in a task of its own
        monkeypatch.setattr(rs, "TOGETHER", together)
        got = {r["doc_id"]: (r["n_passages"], r["n_passage_bytes"]) for r in rs.removal(docs).collect()}
        assert [got[i] for i, _ in rows] == [(len(e), sum(b - a for a, b in e)) for e in expected]


def test_short_passages_go_from_the_texts(spark, rows):
    """The first two share 51 words in 203 bytes, which no string of 400 bytes covers."""
    expected = brute_force([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in rs.without_repeats(docs).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        if i in (0, 1):
            assert cut[i] == rs.kept_bytes(raw, [list(e) for e in expected[i]]).decode() != text
        elif i in (5, 6, 7, 9, 10):
            assert cut[i] == text


def test_codes_of_words_do_not_depend_on_stretches(monkeypatch):
    raw = ("ab é ab  " + "x" * 90 + " tail\nab " * 40 + "x" * 90).encode()
    words = raw.split()
    whole = np.frombuffer(rs.word_codes(raw), np.uint32)
    assert len({(w, int(c)) for w, c in zip(words, whole, strict=True)}) == len(set(words)) == len(set(whole.tolist()))
    monkeypatch.setattr(rs, "STRETCH", 50)  # shorter than a word
    parts = np.frombuffer(rs.word_codes(raw), np.uint32)
    short = np.array([len(w) <= 50 for w in words])
    assert (parts == whole)[short].all() and len(set(parts[~short].tolist())) == len({w for w in words if len(w) > 50})
    assert rs.word_codes(b" \n") == rs.word_codes(b"") == b""
