"""Words that are split off first and lower-cased one by one are those of the pattern."""

from pyspark.sql import functions as F

from workload_lens.llm.common import cased_words, lowered, plain_words
from workload_lens.llm.decontaminate import contamination


def _texts() -> list[str | None]:
    every = "".join(chr(c) + "x " + chr(c) for c in range(256))
    return [None, "", " \t\n", "A-Z Éaéİ x_y 12\x7f\x80q Ü", every, "日本 語　K b ΑΣ ⅣⒶ \U0001f600z", "a" * 70_000 + " B"]


def test_split_words_are_those_of_the_pattern(spark):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    words = F.transform(cased_words(F.col("text")), lowered)
    rows = docs.select("doc_id", words.alias("words"), plain_words(F.col("text")).alias("by_pattern")).collect()
    assert len(rows) == len(_texts()) and all(r["words"] == r["by_pattern"] for r in rows)
    assert {r["doc_id"]: r["words"] for r in rows}[3] == ["a", "z", "Éaéİ", "x", "y", "12", "\x80q", "Ü"]


def test_a_text_is_split_once_for_each_read_and_no_pattern_runs_on_it(spark):
    docs = spark.createDataFrame([(1, "One TWO É three. one two É THREE"), (2, None), (3, "!")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two é"), (8, "Two É three")], "item_id long, text string")
    got = contamination(docs, items)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("split(") == 1
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()}
    assert rows == {1: (8, 6, 1), 2: (0, 0, 0), 3: (0, 0, 0)}
