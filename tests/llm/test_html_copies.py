"""Pages without an article: copies and shared passages of a host keep their text."""

from workload_lens.llm import html_text


def test_copies_and_quotes_keep_their_text(spark):
    chrome = "<div>Welcome to the portal of our little town, open every day</div>"
    quote = "It was the best of times, it was the worst of times, said the old book"
    story = "A long story about the river and the people who have lived on its banks for ages"
    bodies = {i: f"<p>Text number {i} is about subject {i * 7919} only</p>" for i in range(8)}
    bodies[0] += f"<p>{story}</p>"
    bodies[1] += f"<p>{quote}</p>"
    bodies[2] += f"<p>{quote}</p>"
    bodies[3] += f"<p>He wrote: {quote}.</p>"
    rows = [(i, f"http://a.example/{i}", chrome + b) for i, b in bodies.items()]
    rows += [(100 + k, f"http://a.example/copy{k}", chrome + bodies[0]) for k in range(20)]
    rows += [(200 + k, f"http://b.example/{k}", f"<p>{story}</p>") for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert len(got) == len(rows) and not any("Welcome" in t for t in got.values())
    own = {i: f"Text number {i} is about subject {i * 7919} only" for i in bodies}
    assert all(got[i] == f"{own[0]}\n{story}" for i in (0, *range(100, 120)))
    assert got[1] == f"{own[1]}\n{quote}" and got[2] == f"{own[2]}\n{quote}" and got[3] == f"{own[3]}\nHe wrote: {quote}."
    assert all(got[i] == own[i] for i in range(4, 8)) and got[200] == got[201] == story
