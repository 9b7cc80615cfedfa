"""Each operator and stage over one small table that has every odd case, and over an empty one."""

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest

from workload_lens.llm import (
    bpe,
    decontaminate,
    html_text,
    langid,
    near_duplicates,
    neighbours,
    repeated_strings,
    token_files,
    toxicity,
    url_reputation,
)

PASSAGE = " ".join(f"shared{i % 37}x{i}" for i in range(90))
LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
TEXTS = [
    (1, PASSAGE + " alpha ending one"),
    (2, "different start " + PASSAGE),
    (3, None),
    (4, ""),
    (5, "123 456 !!!"),
    (6, LONG),
    (7, "bench item one two three four five six seven eight nine ten"),
    (8, "bench item one two three four five six seven eight nine ten"),
    (8, "bench item one two three four five six seven eight nine ten"),
    (None, "a row without an id, with a few words"),
    (None, None),
    (9, "short"),
    (10, "ab" * 600),
    (11, "Ünï <|endoftext|> 中文 \u0558 tail"),
    (12, LONG + " and a little more"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # key_a, node and bucket clash with names that operators use inside
    rows = [(i, t, "en" if i else None, "s", len(t or ""), 1, "n", 2) for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key_a int, node string, bucket int"
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "One two three four five six seven eight nine ten", 0), (2, "eight nine ten", 0), (3, None, 0), (4, "", 0), (None, "short", 0), (5, "nowhere to be found", 0)]
    return spark.createDataFrame(rows, "item_id long, text string, key_a int")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (7, 0, 1), (7, 1, 0), (None, 1, 1), (12, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_decontamination_equals_brute_force(docs, benchmark):
    items = [(r["item_id"], words(r["text"])) for r in benchmark.collect()]
    expected = []
    for doc_id, text in TEXTS:
        own, hit, found = words(text), set(), set()
        for item, w in items:
            for i in range(max(1, len(w) - 9) if w else 0):
                window = w[i : i + 10]
                for at in range(len(own) - len(window) + 1):
                    if own[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(item)
        names = ",".join(sorted(str(x) for x in found if x is not None))
        expected.append((doc_id, len(own), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(docs, benchmark)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(got, *columns) == sorted(expected, key=repr)
    in_blocks = decontaminate.contamination(docs, benchmark, block=1)
    assert by_row(in_blocks, *columns) == sorted(expected, key=repr)
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert by_row(kept, "doc_id", "text") == sorted(((i, t) for (i, t), e in zip(TEXTS, expected, strict=True) if not e[-1]), key=repr)


def test_repeated_strings_equal_brute_force(docs):
    raw = [(t or "").encode() for _, t in TEXTS]
    count = {}
    for b in raw:
        for i in range(len(b) - 399):
            count[b[i : i + 400]] = count.get(b[i : i + 400], 0) + 1
    expected, texts = [], []
    for (doc_id, text), b in zip(TEXTS, raw, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        texts.append((doc_id, None if text is None else kept.decode("utf-8", "ignore")))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(repeated_strings.removal(docs), *columns) == sorted(expected, key=repr)
    cut = repeated_strings.without_repeats(docs)
    assert cut.columns == docs.columns
    assert by_row(cut, "doc_id", "text") == sorted(texts, key=repr)


def test_groups_split_over_tasks_lose_nothing(docs, monkeypatch):
    whole = by_row(repeated_strings.removal(docs), "doc_id", "n_removed", "kept_sha256")
    monkeypatch.setattr(repeated_strings, "TOGETHER", 1)
    assert by_row(repeated_strings.removal(docs), "doc_id", "n_removed", "kept_sha256") == whole


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh"])
def test_two_stage_sorting_orders_suffixes(alphabet):
    make = np.random.default_rng(4)
    raw = bytes(make.choice(list(alphabet), 1500).astype(np.uint8)) + b"c" * 700
    raw += raw[100:900] + b"ab" * 400
    chosen = np.zeros(len(raw), bool)
    chosen[: len(raw) - 399] = make.random(len(raw) - 399) < 0.7
    order = repeated_strings.ordered_suffixes(raw, chosen)
    windows = [raw[i : i + 400] for i in order]
    assert windows == sorted(windows) and sorted(order) == list(np.flatnonzero(chosen))


def test_near_duplicates(docs):
    got = {(r["doc_id"], r["class_id"]) for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert {(6, 6), (12, 6), (7, 7), (8, 7), (1, 1), (2, 1), (3, 3), (4, 3), (None, 3)} <= got
    kept = near_duplicates.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 5, 6, 7, 9, 10, 11, None} == set(ids)


def test_weighted_similarity_of_links(spark):
    make = np.random.default_rng(1)
    base = [f"w{x}" for x in make.integers(0, 500, 400)]
    rows = []
    for i in range(40):  # copies of one text with an edit each, and other texts
        own = list(base)
        own[int(make.integers(0, 400))] = f"edit{i}"
        rows.append((i, " ".join(own)))
        rows.append((100 + i, " ".join(f"v{x}" for x in make.integers(0, 5000, 200))))
    got = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 100} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] >= 100)


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    expected, crc, start = [], [], 0
    for doc_id, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        expected.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        crc.append((doc_id, len(ids) + 1, zlib.crc32(raw + bytes(4))))
    assert by_row(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert by_row(bpe.decoded(bpe.encoded(docs)), "doc_id", "text") == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    got = sorted(token_files.token_table(docs).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(crc, key=repr)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


@pytest.mark.parametrize("text", ["a" * 3000, "'s 're 'x", " \t\n  x", "\x1c\x85\u3000", "zq" * 50, "x<|endoftext|><|endoftext|>", "\u088f\u0c5c b"])
def test_bpe_of_odd_texts(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert np.frombuffer(bpe.codec(bpe.VOCABULARY).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_elias_fano_selects_every_number():
    make = np.random.default_rng(2)
    for top in (1, 3, 1000, 2**40, 2**63):
        numbers = np.sort(make.integers(0, top, 1300, dtype=np.uint64))
        packed = token_files.EliasFano(1300, *token_files.EliasFano.of(numbers).parts())
        assert [packed.select(i) for i in range(1300)] == numbers.tolist()


def test_language_profiles(docs, spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.learn_and_identify(docs).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "und"), (9, "en")} <= got
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 4
    de, en = "der die das und nicht ein wir haben schön für über", "the and of that with this from have their which"
    rows = [(i, f"{de} {i}" if i % 2 else f"{en} {i}", "de" if i % 2 else "en") for i in range(40)]
    both = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.learn_and_identify(both).collect()
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") and 0 <= r["score"] <= 1 for r in out)


def test_toxicity(docs, labels, spark):
    out = toxicity.learn_and_score(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    make = np.random.default_rng(3)
    plain = [f"plain{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(160):
        own = [plain[k] for k in make.integers(0, 60, 90)]
        if i % 4 == 0:
            own[int(make.integers(0, 90))] = "nastyword"
        rows.append((i, " ".join(own)))
        marks.append((i, 1, int(i % 4 == 0)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    scored = toxicity.learn_and_score(made, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in scored if r["held_out"]]
    wrong = sum(r["predicted"] != (r["doc_id"] % 4 == 0) for r in held)
    assert held and wrong <= 0.15 * len(held)


def test_gradients_of_the_network():
    windows = toxicity._Index([["a", "b", "c"], ["b", "dd"]])
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        given = net.projected(net.inputs(windows.hashed))
        p = toxicity._sigmoid(net.forward(given, windows.index, windows.mask)[0].astype(np.float64))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum()

    found = net.gradients(*windows.batch(np.arange(2)), target, weight)
    for k in ("gate_f", "new_b", "in_f", "att", "out", "bias_b"):
        at = (0,) * net.p[k].ndim
        net.p[k][at] += 1e-2
        high = loss()
        net.p[k][at] -= 2e-2
        low = loss()
        net.p[k][at] += 1e-2
        assert found[k][at] == pytest.approx((high - low) / 2e-2, rel=0.1, abs=2e-5)


def test_neighbours_equal_brute_force_where_one_part_holds_all(spark):
    make = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(make.normal(size=(300, 8)))]
    rows += [(300, rows[7][1], 0), (400, rows[7][1], 0), (400, rows[7][1], 0)]  # ties and a repeated row
    odd = [(500, None, 0), (600, [0.0] * 8, 0), (700, [None] + [1.0] * 7, 0), (800, [float("nan")] * 8, 0), (900, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (1000, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, part int")
    kept = {i: np.array(np.float32(v), float) for i, v, _ in rows}
    expected = []
    for q in (i for i in kept if i % 100 == 0):
        far = sorted((np.sqrt(((kept[q] - v) ** 2).sum()), i) for i, v in kept.items() if i != q)[:10]
        expected += [(q, k, i, pytest.approx(d)) for k, (d, i) in enumerate(far, 1)]
    got = sorted(tuple(r) for r in neighbours.nearest(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(expected, key=lambda r: r[:2])
    few = neighbours.nearest(df.where("vec_id in (100, 3, 5)"))
    assert [r["vec_id"] for r in few.orderBy("rank").collect()].__len__() == 2


def test_recall_of_learned_parts(spark):
    make = np.random.default_rng(6)
    centres = make.normal(size=(40, 16)) * 3
    x = (centres[make.integers(0, 40, 4000)] + make.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df).collect()
    hit = 0
    for q in range(0, 4000, 100):
        far = ((x[q].astype(float) - x) ** 2).sum(axis=1)
        far[q] = np.inf
        hit += len(set(np.argsort(far)[:10]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / 400 >= 0.9


def test_main_text(spark):
    article = "<html><body><nav>Menu</nav><article><h1>Title &amp; more</h1><p>First <b>bold<br>line<p>Second&nbsp;one</article><footer>F</footer>"
    chrome = "<div>Welcome to the portal of our little town, open every day</div>"
    rows = [
        (1, "http://a.example/x", article),
        (2, "http://b.example/1", chrome + "<p>The first text of this site</p>"),
        (3, "http://b.example/2", chrome + "<p>Something else entirely</p><div class='cookie-notice'>We use cookies</div>"),
        (4, "http://c.example/1", chrome + "<p>Another host</p>"),
        (5, None, None),
        (5, "no url", ""),
        (6, "http://b.example/3", "<script>if (a < b) {}</script><!-- x --><p>a < b<div class=sidebar>s</div>"),
        (None, "http://d.example", "<main>ok</main>"),
    ]
    got = {(r["page_id"], r["url"]): r["text"] for r in html_text.main_text(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, node int")).collect()}
    assert got[1, "http://a.example/x"] == "Title & more\nFirst bold line\nSecond one"
    assert got[2, "http://b.example/1"] == "The first text of this site" and got[3, "http://b.example/2"] == "Something else entirely"
    assert got[4, "http://c.example/1"].startswith("Welcome") and got[5, None] == "" and got[5, "no url"] == ""
    assert got[6, "http://b.example/3"] == "a < b" and got[None, "http://d.example"] == "ok"


@pytest.mark.parametrize("page", ["<a '" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<!--" * 50_000, "<p>" * 50_000, "<" * 100_000])
def test_hostile_pages_take_linear_time(page):
    html_text.page_blocks(page)


def test_urls(spark, labels):
    rows = [
        (1, "https://WWW.Example.com/en/x?q"), (2, "http://example.com/en/x"), (3, "http://a.net/es/#t"), (4, None), (5, "nothing"),
        (6, "x://"), (7, "http://shop.co.uk"), (None, "http://a.com/b"), (7, "http://shop.co.uk"), (8, "http://xexample.com/en/"),
    ]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, host int, n int")
    got = by_row(url_reputation.judge_urls(pages, labels), "page_id", "host", "path", "rule")
    assert got == sorted(
        [
            (1, "www.example.com", "/en/x", "www.example.com/en/"), (2, "example.com", "/en/x", "example.com/en/"), (3, "a.net", "/es/", "net/es/"),
            (4, "", "", None), (5, "", "", None), (6, "", "", None), (7, "shop.co.uk", "", None), (7, "shop.co.uk", "", None),
            (None, "a.com", "/b", "com/"), (8, "xexample.com", "/en/", "com/"),
        ],
        key=repr,
    )


def test_reputation_decides_by_the_lower_bound(spark):
    pages = [(i, f"http://{'good' if i < 50 else 'bad'}.example.org/{i}") for i in range(100)]
    labels = [(i, int(i < 50), 0) for i in range(100)]
    got = url_reputation.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    assert {(r["host"], r["verdict"]) for r in got.collect()} == {("good.example.org", "allow"), ("bad.example.org", "block")}


def test_empty_tables(docs, benchmark, labels, spark):
    none, no_labels = docs.limit(0), labels.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        decontaminate.contamination(none, benchmark), repeated_strings.removal(none), near_duplicates.near_duplicate_classes(none),
        bpe.digests(none), token_files.token_table(none), langid.learn_and_identify(none), toxicity.learn_and_score(none, no_labels),
        html_text.main_text(pages), url_reputation.judge_urls(pages, no_labels), neighbours.nearest(vectors), langid.with_language(none),
    ):
        assert df.count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_pipeline_stages_keep_the_columns(docs, benchmark, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 6, 10, 11, None} - {2}
