"""Ids of texts that are split together are those of the tokenizers library; each different pre-token is looked up once."""

import random

import numpy as np
import pyarrow as pa
import tokenizers

from workload_lens.llm import token_files as tf

ODD = [
    None, "", " ", "a ", "a  b", "\n", "a\nb", "a\n\nb", "a \nb", "it's we'll I'd 'tis x'", "\x1f", "a\x1fb", "中文 字", "é è 12³ ½ ªº", "x\x00y\\0",
    "<|endoftext|>a", "a<|endoftext|> b", "́á b", "ʰ ̈́ ԯ԰", "9" * 50 + "a" * 300, "\U0001f600!", "ab " * 2000,
]


def test_texts_are_encoded_as_by_the_library():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab'sdtlver 1²é½\n\t_-*́ \xa0ԯ") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    own = tf._encoder(tf.VOCABULARY)
    library = tokenizers.Tokenizer.from_file(tf.vocabulary_path(tf.VOCABULARY))
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, f"<u{own.width}").tobytes() for t in texts]
    assert own.encode_array(pa.array(texts)) == want
    assert own.encode_all(texts) == want and own.encode_array(pa.array([], pa.string())) == []


def test_a_pretoken_that_comes_back_is_looked_up_once(monkeypatch):
    own, seen = tf.LibraryEncoder(tf.vocabulary_path(tf.VOCABULARY)), []
    get = own.memo.packed
    monkeypatch.setattr(own.memo, "packed", lambda token: seen.append(token) or get(token))
    monkeypatch.setattr(tf, "MEMO", 8)
    for _ in range(4):  # a full memo keeps what is still in use
        assert len(own.encode_array(pa.array(["some words here", "here some words", None]))) == 3
    assert sorted(seen) == sorted({"some", " words", " here", "here", " some"})


def test_equal_doc_ids_are_in_the_order_of_their_ids(spark, tmp_path):
    docs = spark.createDataFrame([(7, "b" * n) for n in (1, 40, 300, 5, 2000)] + [(1, None)], "doc_id long, text string")
    tf.write_tokens(docs, str(tmp_path / "files"))
    rows = sorted(tf.read_tokens(spark, str(tmp_path / "files")).collect(), key=lambda r: r["start"])
    ids = [np.frombuffer(r["ids"], "<u4").astype("<u2").tobytes() for r in rows]
    assert rows[0]["doc_id"] == 1 and ids[1:] == sorted(ids[1:])
