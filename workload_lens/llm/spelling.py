"""Spelling variants of words by permuterm rotations.

A word ends in a mark, and its rotations begin at each of its code points and at the mark. Turned so that an edited
code point comes last, two words that differ by a replacement there agree in all that stands before it, and a word with
one code point more agrees there with a whole rotation of the other. So the rotations of all words are sorted by what
they have without the edited code point, and a scan of the sorted groups meets every two words that are one edit apart.
A group has one rotation for each letter that can stand in one place, and one whole word, so no group is large.

The rotations of a long word would take the square of its length; their place in the order is then a digest of the two
parts beside the edited code point, which are computed from sums over the word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Least code points and occurrences of a word, and how much more often than a word its form occurs.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: Code points of a rotation that is sorted by itself; a longer one by a digest.
LITERAL = 48
#: Words that a task counts before it hands its counts on, and texts that are read at a time.
HELD, AT_ONCE = 200_000, 64

_MARK = "\x00"
_MODULUS = (1 << 127) - 1
_BASES = (0x2545F4914F6CDD1D9E3779B97F4A7C15, 0x5851F42D4C957F2D14057B7EF767814F)

Change = Callable[[object, str], str]


def _words_of(length: int) -> Callable[[str], list[str]]:
    # A maximal run of fewer letters can be no word, as changes do not make it longer.
    return re.compile(f"[a-zÀ-ÿ]{{{length},}}").findall


def without_a_letter(doc_id: object, run: str) -> str:
    """The run, less one code point if 199 divides the crc32 of ``<doc_id>:<run>``: a rule that makes known variants."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()))
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, change: Change | None = None) -> DataFrame:
    """(word, n) of the words that occur often enough in all texts; tasks hand on counts, not occurrences.

    A word is a maximal run of letters of Latin-1, with A-Z in lower case; ``change`` may replace it by document. Null
    texts have none.
    """
    find = _words_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                ids, texts = (batch.column(c).slice(i, AT_ONCE).to_pylist() for c in (0, 1))
                for doc_id, text in zip(ids, texts, strict=True):
                    found = find((text or "").encode().lower().decode())
                    if change is None:
                        counts.update(found)
                        continue
                    for word, n in Counter(found).items():
                        word = change(doc_id, word)
                        if len(word) >= length:
                            counts[word] += n
                if len(counts) >= HELD:
                    yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def rotations(word: str) -> Iterator[tuple[bytes, bool, bool]]:
    """(place in the order, whole, first) of all rotations of a word.

    One that is not ``whole`` leaves the code point out that it was turned to have last; ``first`` if the code point
    before it in the word is another one. A whole one has its place by all of it.
    """
    n = len(word)
    if n <= LITERAL:
        for i in range(n + 1):
            yield (word[i:] + _MARK + word[:i]).encode(), True, True
    if n - 1 <= LITERAL:
        for i in range(n):
            yield (word[i + 1 :] + _MARK + word[:i]).encode(), False, i == 0 or word[i] != word[i - 1]
    if n > LITERAL:
        points = list(map(ord, word))
        sums = []  # of the first i code points, and of those from the i-th on
        for base in _BASES:
            ahead, behind, power = [0], [0], 1
            for p in points:
                ahead.append((ahead[-1] * base + p) % _MODULUS)
            for p in reversed(points):
                behind.append((behind[-1] + p * power) % _MODULUS)
                power = power * base % _MODULUS
            sums.append((ahead, behind[::-1]))

        def digest(i: int, j: int) -> bytes:
            parts = [s.to_bytes(16, "little") for ahead, behind in sums for s in (ahead[i], behind[j])]
            return b"\xff" + hashlib.blake2b(b"".join([i.to_bytes(8, "little"), (n - j).to_bytes(8, "little"), *parts]), digest_size=16).digest()

        for i in range(n + 1):
            yield digest(i, i), True, True
        if n - 1 > LITERAL:
            for i in range(n):
                yield digest(i, i + 1), False, i == 0 or word[i] != word[i - 1]


def _neighbours(group: list[tuple[bytes, bool, bool]]) -> Iterator[tuple[bytes, bytes]]:
    """Both directions of each two words of a group (word, whole, first) that are one edit apart there.

    Two words of equal length meet in the group of the one place where they differ. A word and one with a code point
    less meet wherever it stands in a row of equal ones; the first of the row counts.
    """
    whole = [w for w, is_whole, _ in group if is_whole]
    turned = [(w, first) for w, is_whole, first in group if not is_whole]
    for a, first in turned:
        for b, _ in turned:
            if a != b:
                yield a, b
        for b in whole:
            if first:
                yield a, b
                yield b, a


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) for every two words of a table of distinct words that differ by one edit, in both directions.

    An edit inserts, deletes or replaces one code point. Null words have none.
    """
    known = words.where(F.col("word").isNotNull()).select("word", F.unhex(F.md5("word")).alias("id"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for word, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in rotations(word):
                    for column, value in zip(cols, (key, *row), strict=True):
                        column.append(value)
                    if len(cols[0]) >= 50_000:
                        yield out(cols)
                        for column in cols:
                            column.clear()
            yield out(cols)

    def out(cols: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "place", "whole", "first"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group, found = None, [], []

        def pairs() -> pa.RecordBatch:
            one = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["id", "near_id"])
            found.clear()
            return one

        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != place:
                    if len(group) > 1:
                        found += _neighbours(group)
                    place, group = at, []
                group.append(tuple(row))
            if len(found) >= 10_000:
                yield pairs()
        found += _neighbours(group)
        yield pairs()

    turned = known.mapInArrow(turn, "id binary, place binary, whole boolean, first boolean")
    pairs = (
        turned.select("place", "id", "whole", "first")
        .repartition("place")
        .sortWithinPartitions("place")
        .mapInArrow(scan, "id binary, near_id binary")
    )
    other = known.select(F.col("id").alias("near_id"), F.col("word").alias("near"))
    return pairs.join(known, "id").join(other, "near_id").select("word", "near")


def spelling_groups(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of a table (word, n): word, form, root, n, n_near, form_n.

    The form is the near word with the largest n, the smallest of equal ones in code-point order, if that n is at least
    ``ratio`` times the word's; ``root`` is where following forms ends, the word itself if it has none.
    """
    counts = stored(counts.select("word", "n"))
    near = near_words(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # Of equal n the least word: UTF-8 has the order of code points.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    of_word = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= ratio * F.col("n")
    words = stored(
        counts.join(of_word, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    # A form occurs ratio times as often, so paths are short; each round doubles how far a word has followed them.
    path = words.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = path.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(path.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        path = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return words.join(path, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
