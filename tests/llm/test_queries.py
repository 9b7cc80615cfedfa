"""Registered queries over the given tables: against SQL where it can express them, else against brute force."""

import hashlib
import os

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from verification.compare import difference, duckdb_tables
from workload_lens.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert difference(rows, duckdb_tables(SF).sql(ORACLES[name]).df()) is None


def test_native_queries_run_no_python(spark):
    for name in ("op1_url_reputation", "op9_decontamination"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_near_duplicates_hold_equal_texts_together(spark):
    rows = QUERIES["op3_near_duplicates"](spark, SF).toPandas().set_index("doc_id")["class_id"]
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    for _, ids in docs.groupby("text")["doc_id"]:
        assert rows[ids].nunique() == 1 and rows[ids].iloc[0] <= ids.min()


def test_languages_of_held_out_documents(spark):
    rows = QUERIES["op5_langid"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id")
    held = rows[rows["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.95


def test_neighbours_of_the_table(spark):
    rows = QUERIES["op2_neighbours"](spark, SF).toPandas()
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    hit = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hit += len(set(ids[np.lexsort((ids, far))[:10]]) & set(rows.loc[rows["query_id"] == ids[q], "vec_id"]))
    assert hit / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_pages_have_their_article(spark):
    rows = QUERIES["op7_html_text"](spark, SF).toPandas()
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert len(rows) == len(pages) and (rows["n_chars"] == rows["text"].str.len()).all()
    assert not rows["text"].str.contains("©|track\\(|margin:0").any()


def test_the_pipeline_loses_only_what_its_stages_decide(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert out["doc_id"].is_unique and set(out["doc_id"]) <= set(docs["doc_id"])
    empty = hashlib.sha256(b"").hexdigest()
    assert ((out["n_tokens"] == 0) == (out["ids_sha256"] == empty)).all()
    assert len(out) >= 0.7 * docs["text"].nunique()
