"""Periodic runs of words, found in a grammar of the text.

A run is a stretch of words with a smallest period q that no neighbouring word extends, of at least 24 words and three
periods. The word ids are compressed by Re-Pair: pairs of neighbours that come back are replaced by nonterminals, the
more frequent of two touching pairs first, until no pair comes twice; the start rule is halved until it is one symbol.
Every run crosses the boundary between the two halves of exactly one smallest node of the derivation, so the runs that
cross the boundary of a nonterminal are computed once, translated to every place the nonterminal derives, and of the
intervals of one period only the maximal ones are kept.

In a run every window of 8 words comes back within the text. What is not in such a window is in no run and is left out
of the grammar. Texts of a task are compressed together, a bounded number of words at a time; a text is never cut.
A text that has repeated windows takes about 200 bytes of memory for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words and periods that a run has at least.
LEAST, PERIODS = 24, 3
#: Words of which every window in a run comes back, one period before or after it, as a run is longer than this and two
#: periods less two; a power of two.
WINDOW = 8
#: Words that are compressed together, unless one text has more, and texts that are read at a time.
TOGETHER, AT_ONCE = 150_000, 64
#: Pairs of a nonterminal and a period that are tried at a time.
TRIES = 1 << 21

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _prints(words: np.ndarray, longest: int, salt: int) -> list[np.ndarray]:
    """Fingerprints of the 1, 2, 4, ... words from each place on; equal words have equal ones."""
    out = [_mixed((words.astype(np.uint64) + np.uint64(salt * 0x51ED27 + 1)) * _MIX)]
    while 2 << (len(out) - 1) <= longest:
        half, last = 1 << (len(out) - 1), out[-1]
        whole = np.zeros(len(last), np.uint64)
        if len(last) > half:
            whole[:-half] = _mixed(last[:-half] * _MIX + (last[half:] ^ (last[half:] >> np.uint64(29))))
        out.append(whole)
    return out


def _common(prints: list[np.ndarray], one: np.ndarray, two: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal from two places on, or before them, up to ``room``."""
    got = np.zeros(len(one), np.int64)
    for k in range(len(prints) - 1, -1, -1):
        step = 1 << k
        fits = np.flatnonzero(got + step <= room)
        at = -(got[fits] + step) if back else got[fits]
        same = prints[k][one[fits] + at] == prints[k][two[fits] + at]
        got[fits[same]] += step
    return got


def _stretches(words: np.ndarray, sizes: np.ndarray, salt: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of at least LEAST words whose windows all come back in their text."""
    if len(words) < LEAST:
        return []
    n = len(words) - WINDOW + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = _prints(words, WINDOW, salt)[-1][:n] ^ _mixed((text[:n] + 1).astype(np.uint64) * _MIX)
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n + 2, bool)
    again[order[1:][same] + 1] = again[order[:-1][same] + 1] = True
    # A text of fewer words than a window lies between the windows of two texts, so these never touch.
    edge = np.flatnonzero(again[1:] != again[:-1])
    first, end = edge[::2], edge[1::2] + WINDOW - 1
    return [(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True) if b - a >= LEAST]


class Grammar:
    """Rules ``left`` and ``right`` of nonterminals, which follow the words in number; ``size`` is what each derives."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        """Compress the sequences that have one ``owner`` each; their places count from the first word of all."""
        _, symbols = np.unique(words, return_inverse=True)
        self.words = int(symbols.max()) + 1
        self.left, self.right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size, self.first = np.ones(self.words, np.int64), np.zeros(self.words, np.int64)
        self.symbols, self.places, self.owner = symbols.astype(np.int64), np.arange(len(words)), owner
        while self._replace(*self._frequent()):
            pass
        while self._replace(*self._halves()):
            pass

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        return at, self.symbols[at] * len(self.size) + self.symbols[at + 1]

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs that come back and touch no more frequent one, and the pairs."""
        at, pairs = self._pairs()
        values, which, times = np.unique(pairs, return_inverse=True, return_counts=True)
        order = np.lexsort((_mixed(values.astype(np.uint64) * _MIX), times))
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        rank[times < 2] = -1
        level = np.full(len(self.symbols) + 1, -1, np.int64)  # of the pair that begins before each symbol
        level[at + 1] = rank[which]
        # Equal pairs in a row are pairs of one symbol, of which every other one can be replaced.
        head = np.flatnonzero(np.diff(level, prepend=-2))
        top = np.concatenate([[-1], level[head][:-1]]) < level[head]
        top &= np.append(level[head][1:], -1) < level[head]
        row = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(level))))
        chosen = np.flatnonzero(top[row] & ((np.arange(len(level)) - head[row]) % 2 == 0)) - 1
        return chosen, self.symbols[chosen] * len(self.size) + self.symbols[np.minimum(chosen + 1, len(self.symbols) - 1)]

    def _halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Every other pair of each sequence."""
        at, pairs = self._pairs()
        head = np.flatnonzero(np.diff(self.owner, prepend=-1))
        number = np.arange(len(self.owner)) - np.repeat(head, np.diff(np.append(head, len(self.owner))))
        even = number[at] % 2 == 0
        return at[even], pairs[even]

    def _replace(self, at: np.ndarray, pairs: np.ndarray) -> bool:
        if not len(at):
            return False
        values, one, which = np.unique(pairs, return_index=True, return_inverse=True)
        left, right = values // len(self.size), values % len(self.size)
        base = len(self.size)
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.size = np.append(self.size, self.size[left] + self.size[right])
        self.first = np.append(self.first, self.places[at[one]])
        keep = np.ones(len(self.symbols), bool)
        keep[at + 1] = False
        self.symbols[at] = base + which
        self.symbols, self.places, self.owner = self.symbols[keep], self.places[keep], self.owner[keep]
        return True

    def derivations(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(nonterminal, place) of all nodes of the derivation that derive at least so many words."""
        symbols, places, out = self.symbols, self.places, []
        while True:
            large = (symbols >= self.words) & (self.size[symbols] >= least)
            symbols, places = symbols[large], places[large]
            if not len(symbols):
                break
            out.append((symbols, places))
            left, right = self.left[symbols - self.words], self.right[symbols - self.words]
            symbols, places = np.concatenate([left, right]), np.concatenate([places, places + self.size[left]])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _crossing(grammar: Grammar, words: np.ndarray, prints: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(nonterminal, first, end, period) of the runs across the boundary of each nonterminal, from where it begins on."""
    nodes = np.flatnonzero(grammar.size >= LEAST)
    nodes = nodes[nodes >= grammar.words]
    periods = grammar.size[nodes] // PERIODS
    found = []
    lot = np.cumsum(periods) // TRIES
    for k in np.unique(lot):
        part = np.flatnonzero(lot == k)
        node = np.repeat(nodes[part], periods[part])
        q = np.arange(len(node)) - np.repeat(np.cumsum(periods[part]) - periods[part], periods[part]) + 1
        start = grammar.first[node]
        end = start + grammar.size[node]
        middle = start + grammar.size[grammar.left[node - grammar.words]]
        # Where words are equal to those q on, in a run, is longer than q and meets the q places before the boundary,
        # so it has the first or the last of them.
        for t in (middle - 1, middle - q):
            here = np.flatnonzero((t >= start) & (t + q < end))
            here = here[words[t[here]] == words[t[here] + q[here]]]
            at, p, a, b = t[here], q[here], start[here], end[here]
            e = at + p + _common(prints, at, at + p, b - at - p, back=False)
            s = at - _common(prints, at, at + p, at - a, back=True)
            long = e - s >= np.maximum(LEAST, PERIODS * p)
            found.append((node[here][long], (s - a)[long], (e - a)[long], p[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    node, first, end, q = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((q, end, first, node))  # multiples of the smallest period have the same ends
    node, first, end, q = node[order], first[order], end[order], q[order]
    new = np.append(True, (np.diff(node) != 0) | (np.diff(first) != 0) | (np.diff(end) != 0))[: len(node)]
    return node[new], first[new], end[new], q[new]


def _maximal(first: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the intervals of one period those that no other one holds."""
    order = np.lexsort((-end, first, q))
    first, end, q = first[order], end[order], q[order]
    far = q * (int(end.max(initial=0)) + 1) + end
    keep = np.append(True, far[1:] > np.maximum.accumulate(far)[:-1])[: len(far)]
    return first[keep], end[keep], q[keep]


def runs_of(words: np.ndarray, sizes: np.ndarray, salt: int = 0) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of some texts, given as word ids one after another, and their sizes."""
    cut = _stretches(words, sizes, salt)
    if not cut:
        return (np.zeros(0, np.int64),) * 4
    part = np.concatenate([words[a:b] for a, b in cut])
    length = np.array([b - a for a, b in cut])
    begin = np.cumsum(length) - length
    grammar = Grammar(part, np.repeat(np.arange(len(cut)), length))
    prints = _prints(part, int(length.max()), salt)
    node, first, end, q = _crossing(grammar, part, prints)
    symbols, places = grammar.derivations(LEAST)
    # Every run of a nonterminal at every place of it.
    low, high = np.searchsorted(node, symbols), np.searchsorted(node, symbols, side="right")
    place = np.repeat(places, high - low)
    run = np.arange(len(place)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    first, end, q = _maximal(first[run] + place, end[run] + place, q[run])
    # Fingerprints can only find too much; where one did, others are used.
    span = end - first - q
    at = np.repeat(first, span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    if (part[at] != part[at + np.repeat(q, span)]).any():
        return runs_of(words, sizes, salt + 1)
    owner = np.searchsorted(begin, first, side="right") - 1
    start = first - begin[owner] + np.array([a for a, _ in cut])[owner]
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    order = np.lexsort((q, start))
    return text[order], (start - (np.cumsum(sizes) - sizes)[text])[order], (end - first)[order], q[order]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run (start, length, period) holds after its first period, joined by a space."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
    return b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length and period in words; by start, then period) and collapsed.

    Words are what ASCII white space parts. ``collapsed`` is the text without the words that a run holds after its first
    period, joined by one space. A null text is as an empty one: no words, no runs, an empty text. Each row stands for
    itself, whatever other rows hold; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[list[bytes]] = []

        def flush() -> pa.RecordBatch:
            number = _Ids()
            sizes = np.array([len(w) for w in texts], np.int64)
            ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in texts)])
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for text, *one in zip(*(c.tolist() for c in runs_of(ids, sizes)), strict=True):
                found[text].append(tuple(one))
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found]
            left = [collapsed(w, own).decode() for w, own in zip(texts, found, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.array(sizes), pa.array(rows, _RUNS), pa.array(left, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )
            keys.clear()
            texts.clear()
            return out

        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                keys.append(batch.column(0).slice(i, AT_ONCE))
                fresh = [(t or "").encode().split() for t in batch.column(1).slice(i, AT_ONCE).to_pylist()]
                texts += fresh
                held += sum(map(len, fresh))
                if held >= TOGETHER:
                    yield flush()
                    held = 0
        if texts:
            yield flush()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
