"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cased_words, lowered, plain_words, row_key, stored

#: Words of a window.
WINDOW = 10
#: Most windows (and most words) that one broadcast holds; a larger benchmark is joined in blocks of this many.
BLOCK = 200_000


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, gram, len): the windows of every item; an item with fewer words is one window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return (
        words.where(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("at"))
        .select(
            "item",
            F.array_join(F.slice("words", F.col("at") + 1, window), " ").alias("gram"),
            F.least(F.size("words"), F.lit(window)).alias("len"),
        )
        .distinct()
    )


def _blocks(df: DataFrame, key: Column, size: int) -> list[DataFrame]:
    """The rows in blocks of about ``size`` rows by a hash of their key; one block if they are few."""
    n = -(-df.count() // size)
    return [df] if n <= 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _exploded(docs: DataFrame) -> DataFrame:
    """(key_a, key_b, words, pos, word): a row for each word, in lower case; words are all of the text in its own case.

    A text without words gives a row with a null word: were it left out here, Spark would split every text twice.
    """
    words = docs.select(*row_key("doc_id", "text"), cased_words(F.col("text")).alias("words"))
    placed = words.select("key_a", "key_b", "words", F.posexplode_outer("words").alias("pos", "word"))
    return placed.withColumn("word", lowered(F.col("word")))


def rarest_words(docs: DataFrame, grams: DataFrame, block: int = BLOCK) -> DataFrame:
    """(gram, len, word, offset): of each window the word with the fewest occurrences in the documents.

    A window occurs whole or not at all, so one word is the necessary prefix; ties go to the smaller word.
    """
    places = grams.select("gram", "len", F.posexplode(F.split("gram", " ")).alias("offset", "word"))
    vocabulary = stored(places.select("word").distinct())
    counted = None
    for part in _blocks(vocabulary, F.col("word"), block):
        tokens = docs.select(F.explode_outer(cased_words(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("word"))
        count = tokens.join(F.broadcast(part), "word").groupBy("word").agg(F.count("*").alias("df"))
        counted = count if counted is None else counted.unionByName(count)
    ranked = places.join(stored(counted), "word")  # a word without an occurrence ends its windows
    complete = ranked.groupBy("gram", "len").agg(
        F.min(F.struct("df", "word", "offset")).alias("rare"), F.count("*").alias("found")
    )
    return complete.where(F.col("found") == F.col("len")).select("gram", "len", "rare.word", "rare.offset")


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Every occurrence of an item window in a document, and the windows of the items.

    The prefix word gives the places where a window may start, the bounds of the text drop some,
    and the words there are compared whole. Nothing but the benchmark is broadcast, in checked blocks.
    """
    windows = stored(item_windows(benchmark, window))
    grams = windows.select("gram", "len").distinct()
    prefix = stored(rarest_words(docs, grams, block))
    hits = None
    for part in _blocks(prefix, F.col("gram"), block):
        starts = part.select("word", "offset", "len").distinct()
        start = F.col("pos") - F.col("offset")
        # Spark may build the words before it applies the bounds, and a slice from before the text is an error.
        gram = lowered(F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ")).alias("gram")
        candidates = (
            _exploded(docs)
            .join(F.broadcast(starts), "word")
            .where((start >= 0) & (start + F.col("len") <= F.size("words")))
            .select("key_a", "key_b", start.alias("start"), gram)
        )
        found = candidates.join(F.broadcast(part.select("gram", "len")), "gram").select("key_a", "key_b", "start", "len", "gram")
        hits = found if hits is None else hits.unionByName(found)
    return stored(hits.distinct()), windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hit. Items without words have no window; items with a null id
    hit but are not counted or listed. Repeated documents each get their row; equal items count once.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    hits, windows = window_hits(docs, benchmark, window, block)
    covered = (
        hits.select("key_a", "key_b", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos"))
        .distinct()
        .groupBy("key_a", "key_b")
        .agg(F.count("*").alias("n_hit"))
    )
    items = (
        hits.select("key_a", "key_b", "gram")
        .distinct()
        .join(windows.where(F.col("item").isNotNull()).select("gram", "item"), "gram")
        .groupBy("key_a", "key_b")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = covered.join(items, ["key_a", "key_b"], "left")
    n_words = F.size(cased_words(F.col("text"))).cast("long").alias("n_words")
    none = F.array().cast("array<string>")
    return (
        docs.select("doc_id", n_words, *row_key("doc_id", "text"))
        .join(found, ["key_a", "key_b"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents in which no window of an item occurs, whole and with their columns."""
    hits, _ = window_hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window, block)
    bad = hits.select("key_a", "key_b").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key("doc_id", "text"))
    return keyed.join(bad, ["key_a", "key_b"], "left_anti").select("row.*")
