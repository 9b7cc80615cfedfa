"""Secrets in texts: three fixed patterns, and values of credentials that are hard to guess.

What stands where a credential is expected (``password is ...``, ``Authorization: Bearer ...``, ``://user:...@``) is a
secret if nobody would guess it. The cost of a guess is the decimal logarithm of the number of tries, the least over all
segmentations of the value into words, dates, repeats, walks over the keyboard and brute-force spans, found by dynamic
programming from left to right. A word costs its rank among the words of all documents, so placeholders and plain words
are cheap. Only words with a stated share of all occurrences have a rank, which bounds their number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spelling import word_counts

#: Cost from which a value is a secret, and the least share of all words that a word needs for a rank: with it at most
#: 100,000 words have one.
COST, SHARE = 10.0, 1e-5
#: Texts that are read at a time.
AT_ONCE = 64
#: Letters of the shortest word, characters of the longest unit of a repeat, and of the shortest walk.
WORD, UNIT, WALK = 3, 8, 3

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run from the first AKIA on has no longer one from a later one on
_HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these is in every text that has a match of the patterns of words below.
_HINTS = ("pass", "pwd", "secret", "token", "api", "key", "cred", "auth", "bearer", "login")
_NAMED = re.compile(
    r"""(?<![a-z])(?:[a-z0-9]+[_-])*(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|signing|encryption|auth)[_-]?key"""
    r"""|credentials?|auth(?:orization)?|login)["'`\])]{0,2}[ \t]*(?:=>|:=|[:=]|(?<=[ \t])(?:is|was)(?=[ \t]))[ \t]*(?:(?:bearer|basic)[ \t]+)?["'`]?"""
    r"""([^\s"'`<>,;]{6,})""",
    re.I | re.A,
)
_BEARER = re.compile(r"(?<![a-z])bearer[ \t]+([A-Za-z0-9._~+/=-]{6,})", re.I | re.A)
_IN_URL = re.compile(r"://[^\s/:@]+:([^\s/@]{6,})@")
_CLOSING = ".,;:!?)]}"

# Rows of the keyboard, and letters that digits and signs stand for.
_KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_STANDS_FOR = str.maketrans("4@013$57", "aaoiesst")

_KEY = {c: (x + y / 2, y) for y, row in enumerate(_KEYBOARD) for x, c in enumerate(row)}
_DAY = r"(?:0[1-9]|[12]\d|3[01])"
_MONTH = r"(?:0[1-9]|1[0-2])"
_YEAR = r"(?:19|20)\d\d"
_DATES = [
    (re.compile(rf"{_YEAR}(?P<s>[-/._]?){_MONTH}(?P=s){_DAY}"), 73_000),
    (re.compile(rf"{_DAY}(?P<s>[-/._]?){_MONTH}(?P=s){_YEAR}"), 73_000),
    (re.compile(rf"{_MONTH}(?P<s>[-/._]?){_DAY}(?P=s){_YEAR}"), 73_000),
    (re.compile(rf"{_DAY}{_MONTH}\d\d"), 36_500),
    (re.compile(_YEAR), 200),
]


def _brute(value: str) -> list[float]:
    """The cost of each character by brute force: by the size of its class, a letter after such a letter by what follows."""
    out = []
    for i, c in enumerate(value):
        if c.isdigit():
            out.append(1.0)
        elif c.isalpha():
            after = i and value[i - 1].isalpha() and (value[i - 1].isupper() == c.isupper() or i == 1)
            out.append(0.7 if after else math.log10(26))
        else:
            out.append(math.log10(33))
    return out


def _walks(low: str) -> list[int]:
    """For each place, how many characters from there on walk from key to key, or along the alphabet."""
    n = len(low)
    out = [1] * n
    for i in range(n - 2, -1, -1):
        a, b = low[i], low[i + 1]
        keys = a in _KEY and b in _KEY and a != b and abs(_KEY[a][0] - _KEY[b][0]) <= 1 and abs(_KEY[a][1] - _KEY[b][1]) <= 1
        if keys or (a.isalpha() and b.isalpha() and abs(ord(a) - ord(b)) == 1):
            out[i] = out[i + 1] + 1
    return out


def _turns(low: str) -> list[int]:
    """For each place, how many times the direction of a walk has changed up to there."""
    out, before = [0, 0], None
    for i in range(1, len(low)):
        (x, y), (u, v) = (_KEY.get(c, (ord(c), -9)) for c in (low[i - 1], low[i]))
        step = (u - x, v - y)
        if i > 1:
            out.append(out[-1] + (step != before))
        before = step
    return out[: max(len(low), 1)]


def guess_cost(value: str, rank: dict[str, int], longest: int) -> float:
    """The least cost of a segmentation of a value; ``longest`` is the length of the longest ranked word.

    Each segment after the first costs a factor of two, as a guesser has to try other segments there.
    """
    n, brute = len(value), _brute(value)
    low = value.lower()
    if len(low) != n:  # a character whose lower case is two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, walks, turns = low.translate(_STANDS_FOR), _walks(low), _turns(low)
    upper, swapped = [0], [0]
    for c, a, b in zip(value, low, plain, strict=True):
        upper.append(upper[-1] + (c != a))
        swapped.append(swapped[-1] + (a != b))
    joint = math.log10(2)
    cost = [0.0] + [math.inf] * n  # of the first i characters
    spread = [math.inf] * (n + 1)  # of those that end in a brute-force span
    for i in range(n):
        spread[i + 1] = min(spread[i], cost[i] + (joint if i else 0)) + brute[i]
        cost[i + 1] = min(cost[i + 1], spread[i + 1])
        base = cost[i] + (joint if i else 0)

        def offer(end: int, price: float, base: float = base) -> None:
            cost[end] = min(cost[end], base + price)

        for end in range(i + WORD, min(n, i + longest) + 1):
            r = rank.get(low[i:end]) or rank.get(plain[i:end])
            if r is not None:
                capitals = upper[end] - upper[i]
                case = 0.0 if not capitals else joint if capitals == end - i or (capitals == 1 and upper[i + 1] > upper[i]) else capitals * joint
                leet = 0.0 if low[i:end] in rank else (swapped[end] - swapped[i]) * joint
                offer(end, math.log10(r + 1) + case + leet)
        if value[i].isdigit():
            for pattern, many in _DATES:
                if found := pattern.match(value, i):
                    offer(found.end(), math.log10(many) + (joint if found.groupdict().get("s") else 0))
        if walks[i] >= WALK:
            for end in range(i + WALK, i + walks[i] + 1):
                offer(end, math.log10(47 * (end - i)) + 0.9 * (turns[end - 1] - turns[i + 1]))
        for unit in range(1, min(UNIT, (n - i) // 2) + 1):
            times = 1
            while value[i + times * unit : i + (times + 1) * unit] == value[i : i + unit]:
                times += 1
                if times * unit >= 3:
                    offer(i + times * unit, sum(brute[i : i + unit]) + math.log10(times))
    return cost[n]


def base_spans(text: str) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, value) of the fixed patterns: the matches of each, leftmost and apart; value is what is assigned."""
    low = text.lower()
    out: list[tuple[str, int, int, str | None]] = []
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), None) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span(), None) for m in _HEX.finditer(text)]


def credential_values(text: str) -> set[tuple[int, int]]:
    """(start, end) of what stands where a credential is expected, without closing punctuation; six characters or more."""
    low, found = text.lower(), set()
    patterns = [_NAMED, _BEARER] if any(h in low for h in _HINTS) else []
    if "://" in text:
        patterns.append(_IN_URL)
    for pattern in patterns:
        for m in pattern.finditer(text):
            start, value = m.start(1), m[1]
            if pattern is not _IN_URL:
                value = value.rstrip(_CLOSING)
            if len(value) >= 6:
                found.add((start, start + len(value)))
    return found


def spans_of(text: str, rank: dict[str, int], longest: int, least: float = COST) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) of all secrets of a text, by start and then kind. Base spans are never dropped.

    A value is added if its cost reaches ``least`` and no base span holds it whole.
    """
    base = base_spans(text)
    out = [(kind, a, b, None if value is None else guess_cost(value, rank, longest)) for kind, a, b, value in base]
    for a, b in credential_values(text):
        if not any(x <= a and b <= y for _, x, y, _ in base):
            cost = guess_cost(text[a:b], rank, longest)
            if cost >= least:
                out.append(("guess", a, b, cost))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def word_ranks(docs: DataFrame, share: float = SHARE) -> dict[str, int]:
    """The rank, from 1, of each word with at least that share of all words of all documents; at most 1 / share words."""
    counts = stored(word_counts(docs, length=WORD, occurrences=1))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= F.lit(max(share * total, 1))).select("word", "n").collect()
    return {row["word"]: i + 1 for i, row in enumerate(sorted(rows, key=lambda r: (-r["n"], r["word"])))}


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def find_secrets(docs: DataFrame, least: float = COST, share: float = SHARE) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, cost) of every document, in its own row.

    Kinds are assign, access and hex by pattern and guess by cost; cost is null where a span is no credential's value. A
    null text is as an empty one and has no spans. Words get their rank from all documents; scanning shuffles nothing.
    """
    rank = word_ranks(docs, share)
    longest = max(map(len, rank), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                rows = [
                    [dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in spans_of(t or "", rank, longest, least)]
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, cost: double>>")
