"""Texts with white space in a row are split together with others, and groups share their lookups."""

import pyarrow as pa

from workload_lens.llm import token_files as tf

TEXTS = ["", "a  b", " \n", "\n", "x \t's", "'s's it's  we'll", "", "é  1²", "  'd", "'r", "e'"]


def test_pre_tokens_of_many_texts_are_those_of_each():
    own = tf.LibraryEncoder(tf.vocabulary_path(tf.VOCABULARY))
    words, begins = own.pre_tokens(TEXTS)
    found = words.to_pylist()
    assert [found[a:b] for a, b in zip(begins, begins[1:], strict=False)] == [own(t) for t in TEXTS]


def test_groups_share_their_lookups(monkeypatch):
    own, seen = tf.LibraryEncoder(tf.vocabulary_path(tf.VOCABULARY)), []
    find = own.memo.__class__.__missing__
    monkeypatch.setattr(own.memo.__class__, "__missing__", lambda memo, token: seen.append(token) or find(memo, token))
    monkeypatch.setattr(own.memo, "age", own.memo.clear)
    monkeypatch.setattr(tf, "AT_ONCE", 8)
    assert own.encode_array(pa.array(["ab  cd", "ab  cd", "ab"])) == own.encode_all(["ab  cd", "ab  cd", "ab"])
    assert seen[:3] == ["ab", " ", " cd"] and len(seen) == 6


def test_every_row_is_written_with_its_end(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else "ab  cd " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    own = tf._encoder(tf.VOCABULARY)
    rows = tf.token_table(docs, str(tmp_path / "files")).collect()
    want = {i: len(own.encode_all([None if i % 5 == 0 else "ab  cd " * i])[0]) // own.width + 1 for i in range(40)}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
