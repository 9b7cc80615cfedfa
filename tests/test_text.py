import time

import pytest
from pyspark.sql import functions as F

from workload_lens.functions.text import (
    add_canonical_text,
    add_fingerprint,
    normalized_text,
    statement_preview,
)


@pytest.fixture()
def keys(spark):
    def run(*texts, **options):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, query string")
        rows = add_fingerprint(df, **options).orderBy("i").collect()
        return [r.fingerprint for r in rows]

    return run


def canonical(spark, text, collapse=False):
    df = spark.createDataFrame([(text,)], "query string")
    return add_canonical_text(df, collapse_lists=collapse).first().canonical


SAME = [
    ("select * from a.t", "select * from b.t"),
    ('select * from "A".t', "select * from b.t"),
    ("select * from s1.a x, s2.b y", "select * from q.a x , r.b y"),
    ("select * from x_temp_table_abcdef1", "select * from x_temp_table_zzzzzz9"),
    ("FETCH 10 FROM p_cursor_1a", "FETCH 500 FROM p-cursor_9"),
    ("fetch all in p_cursor_3", "FETCH FORWARD 5 FROM p_cursor_77"),
    ("drop index index_123", "drop index index_9"),
    ("select * from table_123", "select * from table_9"),
    ("SET ROLE a", "SET ROLE b"),
    ("grant select on t to amy", "grant select on t to bob, joe"),
    ("alter table t owner to amy", "alter table t owner to bob"),
    ("/*c*/ SELECT  1", "select 2"),
    ("select 1 -- it's\n, 2", "select 7,8;"),
    ("select /* a /* nested */ b */ 1", "select 'x'"),
    ("select '/* not a comment */'", "select '--x'"),
    ("select 'it''s', E'it\\'s', $$a'b$$", "select 1, 2, 3"),
    ("select x where a = -1", "select x where a=$3"),
    ('select "users"."id" from users', "select users.id from users"),
    ("select f( a , b )", "SELECT F(a,b)"),
    ("truncate a.t, only a.u", "truncate b.t, only c.u"),
    ("lock table a.t, a.u in share mode", "LOCK TABLE b.t, c.u IN SHARE MODE"),
    ("alter sequence a.s restart with 5", "alter sequence b.s restart with 7"),
    ("vacuum a.table_1, a.t", "vacuum b.table_22, b.t"),
    ("insert into s.table_1 values (1)", "insert into r.table_2 values (3)"),
    ("create index index_1 on table_4 (a)", "create index index_2 on table_5 (a)"),
    ("set session authorization amy", "set session authorization bob"),
]
DIFFERENT = [
    ("select * from a.t", "select * from t"),
    ("select u.id from t u", "select v.id from t v"),
    ("select * from x_temp_table_abc", "select * from x_temp_table_abd"),
    ("select * from x_temp_table_abcdef_s", "select * from x_temp_table_abcdef_r"),
    ("drop index index_12x", "drop index index_13x"),
    ('select * from "Users"', 'select * from "users"'),
    ("select * from t where a in (1,2)", "select * from t where a in (1)"),
    ("insert into t values (1),(2)", "insert into t values (1)"),
    ("fetch backward 3 from c", "fetch 3 from c"),
    ("select a is distinct from b.x from t", "select a is distinct from c.x from t"),
    ("select * from s.f(1)", "select * from r.f(1)"),
    ("select * from t where x = 1 order by a.x, b.y", "select * from t where x = 1 order by a.x, c.y"),
    ("select table_1 from t", "select table_2 from t"),
    ("select * from t where index_1 = 1", "select * from t where index_2 = 1"),
    ("truncate a, table_1x", "truncate a, table_2x"),
]


def test_same_and_different(keys):
    texts = [t for pair in SAME + DIFFERENT for t in pair]
    found = keys(*texts)
    pairs = list(zip(found[::2], found[1::2], strict=True))
    for (left, right), texts in zip(pairs, SAME + DIFFERENT, strict=True):
        assert left is not None
        assert (left == right) == (texts in SAME), texts


def test_collapsed_lists(keys, spark):
    a, b, c, d = keys(
        "select * from t where a in (1, 2)",
        "select * from t where a in ($1)",
        "insert into t values (1, 2), (3, 4)",
        "insert into t values (1, 2)",
        collapse_lists=True,
    )
    assert a == b and c == d and a != c


def test_rejects(spark):
    texts = [
        None,
        "",
        " ; ",
        "/* only */",
        "select 'cut",
        "select 'cut from x_temp_table_abcdef",
        "fetch 1 from a_cursor_1 where 'cut",
        "select /* open",
        "select 1",
        "select $a$ open $b$",
        "select $a$ b_cursor_1",
        "select $1, a$b, $q$x$q$, $$y$$",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, query string")
    rows = add_fingerprint(df).orderBy("i").collect()
    assert [r.reject_reason for r in rows] == [
        "empty",
        "empty",
        "empty",
        "empty",
        None,
        "unfingerprintable",
        "unfingerprintable",
        None,
        None,
        None,
        "unfingerprintable",
        None,
    ]
    for r in rows:
        assert (r.fingerprint is None) == (r.reject_reason is not None)
    for i in (4, 9):
        raw = spark.range(1).select(F.md5(F.lit(texts[i]))).first()[0]
        assert rows[i].fingerprint == raw
    assert rows[11].fingerprint != spark.range(1).select(F.md5(F.lit(texts[11]))).first()[0]


def test_normalized_keeps_text_and_comments(spark):
    cases = {
        "/* run 7 */ SELECT  a1, 'x' FROM s.t WHERE b = $1 -- it's 9": (
            "/* run 7 */ SELECT  a1, ? FROM s.t WHERE b = ? -- it's 9"
        ),
        'select "a 1", 1.5e3 from x_temp_table_abcdef': 'select "a 1", ? from x_temp_table_abcdef',
    }
    df = spark.createDataFrame([(t,) for t in cases], "query string")
    rows = df.select("query", normalized_text("query").alias("n")).collect()
    assert {r.query: r.n for r in rows} == cases


def test_preview(spark):
    df = spark.createDataFrame([("a\nb" + "c" * 300,)], "q string")
    row = df.select(statement_preview("q", 5).alias("p"), statement_preview("q").alias("d")).first()
    assert row.p == "a bcc" and len(row.d) == 250


def test_names_of_a_grant(spark):
    assert canonical(spark, "GRANT all ON s.t TO joe") == "grant all on s.t to some_role"


def test_very_long_text(spark):
    """Neither deep recursion nor quadratic time on texts of several megabytes."""
    text = (
        "select '" + "a''b\\'' " * 100_000 + "' , \"" + 'x""y' * 50_000 + '" /*' + "* / " * 100_000
        + "*/ from " + "t" * 100_000 + " " * 100_000 + "in (" + ",".join("1" * 50_000)
        + ") and E'" + "\\n'' a" * 50_000 + "' $$" + "a" * 100_000 + "$$"
    )
    df = spark.createDataFrame([(text,)], "query string")
    start = time.time()
    row = add_fingerprint(df).withColumn("n", normalized_text("query")).first()
    assert row.reject_reason is None and time.time() - start < 60


def test_no_regex_twice_and_none_below_the_aggregation(spark, make_snapshots):
    from workload_lens.operators.merge import accepted, statement_texts

    snapshots = make_snapshots([{"query": "select 1"}])
    plan = accepted(statement_texts(snapshots))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") < 30
    below = plan[plan.rindex("HashAggregate") :]
    assert "regexp_replace" not in below and "RLIKE" not in below


def test_many_open_tags_take_linear_time(spark):
    text = "select " + " ".join(f"$t{i}$ x" for i in range(40_000))
    df = spark.createDataFrame([(text,)], "query string")
    start = time.time()
    row = add_fingerprint(df).withColumn("n", normalized_text("query")).first()
    assert row.fingerprint is not None and row.n == "select ?" and time.time() - start < 20
