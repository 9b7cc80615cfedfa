import random
import re
import time

from workload_lens.config import CONTEXT_PATTERNS, JobConfig
from workload_lens.functions.context import extract_context


def test_labels(spark):
    texts = [
        "/*controller:a,action:b,job_tag:c*/ select 1",
        "/*controller_with_namespace:n::a,job:j*/ select 1",
        "/*application:x,action:only*/ select 1",
        "select 1",
        None,
        "/* app\ncontroller:a,action:b*/ select 1",
        "/*controller:a,controller:z,action:b*/ select 1",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, query string")
    rows = extract_context(df).orderBy("i").collect()
    assert [(r.controller, r.action, r.job_tag) for r in rows] == [
        ("a", "b", "c"),
        ("n::a", None, "j"),
        (None, "only", None),
        (None, None, None),
        (None, None, None),
        (None, None, None),
        ("z", "b", None),
    ]


def test_patterns_without_group_or_with_empty_group(spark):
    df = spark.createDataFrame([("x:",), ("y",)], "q string")
    patterns = {"none": "", "no_group": "x", "empty": "(?P<key>x):(.*)", "other": "(y)"}
    rows = extract_context(df, "q", patterns).drop("q").collect()
    assert [tuple(r) for r in rows] == [(None, None, "", None), (None, None, None, "y")]


def test_a_label_ends_before_the_last_end_of_comment(spark):
    text = "/*action:a*/ select 1 /* b */ from t where x in (1,2)"
    df = spark.createDataFrame([(text,)], "query string")
    assert extract_context(df).first().action == "a*/ select 1 /* b "


def test_settings_from_json():
    config = JobConfig.from_json(
        '{"ObservationInterval": 600, "Project": "p", "Role": "secondary",'
        ' "SanityCheck": "select true", "ContextAction": "a:(.*)"}'
    )
    assert config.observation_interval == 600 and config.flush_interval == 1200
    assert config.source["role"] == "secondary" and config.sanity_check == "select true"
    assert config.context_patterns == {"controller": "", "action": "a:(.*)", "job_tag": ""}


def test_a_megabyte_of_comments_without_a_label(spark):
    texts = ["/* action controller */" * 45_000, "/* job " * 150_000 + "*/", "/*action\n" * 100_000 + "*/ x"]
    df = spark.createDataFrame([(t,) for t in texts], "query string").cache()
    df.count()
    start = time.time()
    rows = extract_context(df).drop("query").collect()
    assert [tuple(r) for r in rows] == [(None,) * 3] * 3 and time.time() - start < 15


def test_labels_equal_those_of_the_pattern(spark):
    rng = random.Random(4)
    pieces = ["/*", "*/", "action:", "controller:", "job_tag:", "a", ",", "\n", " ", "/", "*", "controller_with_namespace:", "\r"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    rows = extract_context(spark.createDataFrame(list(enumerate(texts)), "i int, query string")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        for label, pattern in CONTEXT_PATTERNS.items():
            found = re.search(pattern, text)
            assert row[label] == (found and found[found.re.groups]), (text, label)
