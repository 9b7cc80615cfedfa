"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontaminate,
    html_text,
    langid,
    near_duplicates,
    neighbours,
    periodic_runs,
    repeated_strings,
    secret_scan,
    spelling,
    token_files,
    toxicity,
    url_reputation,
)
from .common import PLAIN_WORD, read_table


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(read_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings.removal(read_table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(secret_scan.find_secrets(read_table(spark, sf_dir, "documents")))


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of documents, which are in order."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = secret_scan.KINDS[:3]
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(of_kind(*base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(read_table(spark, sf_dir, "documents"), change=spelling.without_a_letter)
    return spelling.spelling_groups(counts)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the crc32 of its doc_id, repeats some of its words up to its end."""

    def plant(doc_id: object, text: str | None) -> str | None:
        h = zlib.crc32(str(doc_id).encode())
        words = (text or "").encode().split()
        if doc_id is None or h % 10 or not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, periodic_runs.AT_ONCE):
                part = batch.slice(i, periodic_runs.AT_ONCE)
                texts = [plant(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs.periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents"))))


def run_digests(found: DataFrame) -> DataFrame:
    """The number of runs, the one with the most periods, and digests of all runs and of the collapsed text."""
    more = "l.length * r.period - r.length * l.period"
    first = F.expr(f"""get(array_sort(runs, (l, r) -> case when {more} > 0 then -1 when {more} < 0 then 1
        when l.start < r.start or (l.start = r.start and l.period < r.period) then -1 else 1 end), 0)""")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_neighbours": op2_neighbours,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_files": op4_token_files,
    "op5_langid": op5_langid,
    "op6_toxicity": op6_toxicity,
    "op7_html_text": op7_html_text,
    "op8_bpe": op8_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_repeated_strings": op10_repeated_strings,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWERED.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

_OP1 = f"""
with parsed as (select page_id, {_HOST} as host, {_PATH} as path from pages),
outcome as (
  select host, count(quality) as n, coalesce(sum(case when quality = 1 then 1 else 0 end), 0) as k
  from parsed left join labels on doc_id = page_id group by host),
named as (
  select *, string_split(host, '.') as parts from outcome),
placed as (
  select host, n, k, array_to_string(parts[-2:], '.') as domain, parts[-1] as suffix from named),
by_domain as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(k) as k from placed group by domain),
by_suffix as (select suffix, sum(n) as n, sum(k) as k from by_domain group by suffix),
levels as (
  select 'host' as level, n, k from placed union all select 'domain', n, k from by_domain
  union all select 'suffix', n, k from by_suffix),
means as (select level, sum(n) as total, count(*) as g, sum(k) / sum(n) as m from levels where n > 0 group by level),
moments as (
  select level, any_value(m) as m, any_value(m) * (1 - any_value(m)) as spread,
    sum(n * (k / n - m) * (k / n - m)) / any_value(total)
      - any_value(m) * (1 - any_value(m)) * any_value(g) / any_value(total) as between_groups
  from levels join means using (level) where n > 0 group by level),
strength as (
  select level, m, case when between_groups <= 0 or spread <= 0 then 500.0
    else least(greatest(spread / between_groups - 1, 2.0), 500.0) end as s from moments),
s as (
  select max(s) filter (level = 'suffix') as s1, max(s) filter (level = 'domain') as s2,
    max(s) filter (level = 'host') as s3, max(m) filter (level = 'suffix') as m0 from strength),
shrunk as (
  select d.domain, (d.k + (x.k + m0 * s1) / (x.n + s1) * s2) / (d.n + s2) as prior
  from by_domain d join by_suffix x using (suffix), s),
posterior as (
  select host, k + prior * s3 as a, n - k + (1 - prior) * s3 as b from placed join shrunk using (domain), s),
judged as (
  select host, case when a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) >= 0.5
    then 'allow' else 'block' end as own from posterior),
rules as (
  select * from (values ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'),
    ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'),
    ('block', 'net', '/fr/', 'net/fr/')) r(kind, place, start, rule)),
hosts_paths as (select distinct host, path from parsed),
fitting as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(kind, length(rule)) as kind
  from hosts_paths join rules on (host = place or ends_with(host, '.' || place)) and starts_with(path, start)
  group by host, path)
select page_id, host, path, rule, coalesce(kind, own) as verdict
from parsed join judged using (host) left join fitting using (host, path)
"""

_WORDS = f"regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{PLAIN_WORD}')"

_OP9 = f"""
with d as (select doc_id, text, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
grams as (
  select distinct item_id, array_to_string(w[i + 1:i + 10], ' ') as gram, least(len(w), 10) as n
  from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct n from grams),
places as (
  select distinct doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') as gram
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d, lengths where len(w) >= n)),
hits as (select p.doc_id, p.i, p.n, g.item_id from places p join grams g on p.gram = g.gram and p.n = g.n),
covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

# The table of crc32, and the unsigned crc32 of a list of bytes.
_CRC_TABLE = """crc_table as (
  select list(list_reduce(range(8), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, i) order by i) as t
  from range(256) r(i))"""


def _crc32(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda v, b: xor(v // 256, t[xor(v % 256, b) + 1]), 4294967295), 4294967295)"


_ASCII = "list_transform(string_split({}, ''), lambda c: ord(c)::bigint)"
# Letters of Latin-1 beyond ASCII are two bytes in UTF-8, 195 and the code point less 64.
_LATIN = "flatten(list_transform(string_split({}, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, ord(c)::bigint - 64] end))"

_OP12 = f"""
with recursive {_CRC_TABLE},
runs as (
  select doc_id, {_LOWERED.format("run")} as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents)
  where length(run) >= 6 group by all),
hashed as (select run, n, {_crc32(_LATIN.format("doc_id || ':' || run"))} as h from runs, crc_table),
changed as (
  select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from changed where length(word) >= 6 group by word having sum(n) >= 5),
skips as (
  select word, n, i, left(word, i) || substr(word, i + 2) as rest
  from (select word, n, unnest(range(length(word))) as i from words)),
near as (
  select distinct a.word, b.word as other, b.n as other_n from skips a join skips b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select distinct s.word, w.word, w.n from skips s join words w on s.rest = w.word
  union select distinct w.word, s.word, s.n from skips s join words w on s.rest = w.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
formed as (
  select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * n then other end as form,
    case when other_n >= 5 * n then other_n end as form_n from words left join best using (word)),
path(word, root) as (
  select word, word from formed where form is null
  union all select f.word, p.root from formed f join path p on f.form = p.word)
select word, form, root, n, n_near, form_n from formed join path using (word)
"""

_OP13 = f"""
with {_CRC_TABLE},
texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, {_crc32(_ASCII.format("doc_id::varchar"))} as h
  from documents, crc_table),
placed as (select doc_id, ws, len(ws) as n, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a, h // 10 as g from texts),
planted as (
  select doc_id, n, case when a is null then ws else list_transform(range(n), lambda i:
    ws[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) end as ws from placed),
words as (select doc_id, n, unnest(ws) as w, unnest(range(n)) as i from planted),
pairs as (
  select x.doc_id, x.i, y.i - x.i as q from words x join words y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 3 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretches as (
  select doc_id, q, min(i) as start, count(*) + q as length from islands
  group by doc_id, q, island having count(*) + q >= greatest(24, 3 * q)),
runs as (select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length),
best as (select * from runs qualify row_number() over (partition by doc_id order by length / period desc, start, period) = 1),
listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by doc_id),
dropped as (
  select distinct w.doc_id, w.i from words w join runs r on w.doc_id = r.doc_id and w.i >= r.start + r.period and w.i < r.start + r.length),
kept as (
  select doc_id, string_agg(w, ' ' order by i) as text
  from (select * from words anti join dropped using (doc_id, i)) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from documents d left join best using (doc_id) left join listed using (doc_id) left join kept using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_url_reputation": _OP1,
    "op9_decontamination": _OP9,
    "op12_spelling": _OP12,
    "op13_periodic_runs": _OP13,
}
