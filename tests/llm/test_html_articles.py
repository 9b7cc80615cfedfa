"""Pages with an article go through the suffix array of their host too."""

import pytest

from workload_lens.llm import html_text

CHROME = "All rights reserved by the printing house of our little town since 1901"
PASSAGE = "A paragraph that very many of the articles on this host quote word by word from a press release"
TEASER = "The one story that every page of this host shows beside its own article in a box without a mark"


def _pages():
    own = [f"Article number {i} is about subject {i * 7919} and about nothing else than that" for i in range(12)]
    closed = [(i, f"http://a.example/{i}", f"<article><p>{own[i]}</p><p>{PASSAGE}</p></article><div>{CHROME}</div><div>{TEASER}</div>") for i in range(8)]
    open_ = [(i, f"http://A.example/{i}", f"<article><p>{own[i]}</p><p>{PASSAGE}</p><div>{CHROME}</div>") for i in range(8, 12)]
    story = [(20 + k, f"http://a.example/story{k}", f"<article><p>{TEASER}</p></article>") for k in range(3)]
    other = [(30 + k, f"http://b.example/{k}", f"<main><p>{CHROME}</p><p>{k}</p></main>") for k in range(3)]
    want = {i: f"{own[i]}\n{PASSAGE}" for i in range(12)} | {20 + k: TEASER for k in range(3)} | {30 + k: f"{CHROME}\n{k}" for k in range(3)}
    return closed + open_ + story + other + [(None, None, None)], want | {None: ""}


@pytest.fixture
def texts(spark):
    return lambda rows: {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_boilerplate_in_an_article_goes_and_what_articles_share_stays(texts):
    rows, want = _pages()
    assert texts(rows) == want


def test_the_array_decides(texts, monkeypatch):
    rows, want = _pages()
    spans = html_text.repeated_spans
    monkeypatch.setattr(html_text, "repeated_spans", lambda *a, **k: spans(*a, **k).where("false"))
    got = texts(rows)
    assert {i for i in got if got[i] != want[i]} == {8, 9, 10, 11}
