"""Removal of repeated strings: every byte that a string of 400 bytes covers which also starts anywhere else goes.

Equal texts are one text from the start. In each text every window of 400 bytes has an anchor, the 64-byte piece in it
with the least hash: equal windows have the same anchor at the same place, wherever they are, so only windows whose
anchor comes back anywhere need to be compared. They are dealt by anchor. Within a task their suffixes are put in
order in two stages: only the suffixes smaller than their successors are sorted, all others are induced by a scan of
the buckets of first bytes; neighbours in this order with a common prefix of 400 bytes are repeated.

An anchor that comes back very often is dealt to several tasks. Each settles what repeats within it, and hands on the
digests of its different windows, packed by bucket; a digest from two tasks is a repeated window. A bucket has about as
many windows as a task, so no group has to fit one task.

Passages are found in the same way: there a text is a row of codes of its words, and a window has 51 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .near_duplicates import text_node

#: Bytes of a string that counts, and of the pieces that anchors are chosen from.
LENGTH, PIECE = 400, 64
#: Segments of an anchor that are dealt together, and windows that are put in order at a time.
TOGETHER, AT_ONCE = 256, 100_000
#: Starts that anchors are found for at a time; windows reach over the border. Every worker has two tables of 8 bytes for each.
STRETCH = 1 << 18



class Rule(NamedTuple):
    """What counts as repeated: a string of ``length`` symbols, bytes or words, whose anchors are pieces of ``piece`` symbols.

    A symbol is coded in ``width`` bytes: 1 for a byte, which is its own code, 4 for a word. With ``across`` a string
    counts if two texts have it; else if it starts anywhere else, in the same text or in a copy too.
    """

    length: int
    piece: int
    width: int = 1
    across: bool = False


#: Passages of over 50 words that several texts have. Words are what white space of ASCII parts.
PASSAGES = Rule(51, 16, 4, True)

_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_BASE = 0xD6E8FEB86659FD93
_PLACE = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, STRETCH + LENGTH + 1)
_DOWN = _powers(pow(_BASE, -1, 2**64), STRETCH + LENGTH + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    edges = np.flatnonzero(np.diff(~_SPACE[np.frombuffer(raw, np.uint8)], prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_codes(raw: bytes) -> bytes:
    """A text as codes of 4 bytes, digests of its words; words of a stretch are hashed together."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_places(raw)
    codes = np.empty(len(starts), np.uint32)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + STRETCH, side="right"))
        if to == at:  # a word longer than a stretch
            codes[at] = int.from_bytes(hashlib.blake2b(raw[base : ends[at]], digest_size=4).digest(), "little")
            at += 1
            continue
        part = data[base : ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        first, end = starts[at:to] - base, ends[at:to] - base
        codes[at:to] = _mixed((sums[end] - sums[first]) * _DOWN[first]) >> np.uint64(32)
        at = to
    return codes.tobytes()


def coded(raw: bytes, rule: Rule) -> bytes:
    return raw if rule.width == 1 else word_codes(raw)


def anchors(raw: bytes, length: int = LENGTH, piece: int = PIECE, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the anchors of a text, and the first and last start of the windows that each belongs to.

    Every start of a window belongs to exactly one anchor: the leftmost piece in the window with the least hash. All
    are counted in symbols of ``width`` bytes.
    """
    keys, firsts, lasts = [], [], []
    data = np.frombuffer(raw, np.uint8 if width == 1 else np.uint32)
    places = length - piece + 1  # of a piece in a window
    for at in range(0, len(data) - length + 1, STRETCH):
        part = data[at : at + STRETCH + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        values = _BYTES[part] if width == 1 else _mixed(part.astype(np.uint64) * np.uint64(_BASE))
        np.cumsum(values * _UP[: len(part)], out=sums[1:])
        n = len(part) - piece + 1
        hashes = _mixed((sums[piece:] - sums[:n]) * _DOWN[:n])
        least = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
        reach = 1
        while reach * 2 <= places:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        rest = places - reach
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        change = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        keys.append(hashes[(least[change] & _PLACE).astype(np.int64)])
        firsts.append(change + at)
        lasts.append(np.append(change[1:], len(least)) - 1 + at)
    if not keys:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(lasts)


def ordered_suffixes(raw: bytes, chosen: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The starts where ``chosen`` is true, in the order of their next ``length`` bytes, by two-stage sorting.

    A chosen start must have that many bytes. A suffix is small if it is smaller than its successor. The small ones are
    sorted; any other one follows, within its first byte, the order of its successor, and stands before the small ones.
    Successors that are needed for this but not chosen take part and are left out of what is returned.
    """
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    differ = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    turn = differ[np.searchsorted(differ, np.arange(n))]  # where the run of equal bytes ends
    after = data[np.minimum(turn + 1, n - 1)]
    small = (after > data) | (turn - np.arange(n) >= length - 1) | (turn == n - 1)
    next_small = np.flatnonzero(small)
    used = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(chosen)
    reach = next_small[np.searchsorted(next_small, starts)]
    np.add.at(used, starts, 1)
    np.add.at(used, reach + 1, -1)
    used = np.cumsum(used[:n]) > 0
    first_stage = sorted(np.flatnonzero(used & small).tolist(), key=lambda i: raw[i : i + length])
    first_stage = np.array(first_stage, np.int64)
    edge = np.searchsorted(data[first_stage], np.arange(257))
    large = used & ~small
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for byte in range(256):
        fresh = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        bucket = [fresh]
        while len(fresh):  # within a run of this byte one suffix induces the next
            before = fresh[fresh > 0] - 1
            fresh = before[large[before] & (data[before] == byte)]
            bucket.append(fresh)
        bucket.append(first_stage[edge[byte] : edge[byte + 1]])
        whole = np.concatenate(bucket)
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[large[before] & (data[before] > byte)]
        if len(before):
            before = before[np.argsort(data[before], kind="stable")]
            cut = np.flatnonzero(np.diff(data[before])) + 1
            for part in np.split(before, cut):
                induced[data[part[0]]].append(part)
    order = np.concatenate(order)
    return order[chosen[order]]


def repeated_starts(raw: bytes, chosen: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Chosen starts in suffix order, and for each the number of its class of equal windows."""
    order = ordered_suffixes(raw, chosen, length)
    pairs = zip(order[:-1].tolist(), order[1:].tolist(), strict=True)
    same = np.fromiter((raw[a : a + length] == raw[b : b + length] for a, b in pairs), bool, max(len(order) - 1, 0))
    return order, np.concatenate([[0], np.cumsum(~same)])[: len(order)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers, from sorted ones."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]


_SPAN = "array<struct<first: long, end: long>>"
_FOUND = f"node binary, spans {_SPAN}, key long, bucket long, digests binary, places binary, nodes array<binary>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema(
    [("node", pa.binary()), ("spans", _SPANS), ("key", pa.int64()), ("bucket", pa.int64())]
    + [("digests", pa.binary()), ("places", pa.binary()), ("nodes", pa.list_(pa.binary()))]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _spans(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    return [{"first": a, "end": b + length} for a, b in zip(*(x.tolist() for x in _runs(starts)), strict=True)]


def _settle(rows: list[dict], rule: Rule) -> pa.RecordBatch:
    """What is repeated among some segments, as spans; and digests of windows that other tasks may have too.

    Only windows with one anchor, and so of one scope, are compared. Those of an anchor that is dealt to several tasks
    are handed on in a row for each anchor and bucket of digests: the digest of each different window, and for one that
    is not settled here its start and node. With ``across`` a window counts as repeated only if two nodes have it.
    """
    width, length = rule.width, rule.length * rule.width
    raw = b"".join(r["bytes"] for r in rows)
    sizes = np.array([len(r["bytes"]) for r in rows])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    chosen = np.zeros(len(raw), bool)
    for at, size in zip(begin.tolist(), sizes.tolist(), strict=False):
        chosen[at : at + size - length + 1 : width] = True
    order, classes = repeated_starts(raw, chosen, length)
    owner = np.searchsorted(begin, order, side="right") - 1
    keys, anchor = np.unique(np.array([r["key"] for r in rows], np.int64), return_inverse=True)
    classes = classes * len(keys) + anchor[owner]
    apart = np.argsort(classes, kind="stable")
    order, owner, classes = order[apart], owner[apart], classes[apart]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(classes) > 0]))
    classes = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    decided = np.array([r["decided"] for r in rows])
    shared = np.array([r["parts"] > 1 for r in rows])
    number: dict[bytes, int] = {}
    node_of = np.array([number.setdefault(r["node"], len(number)) for r in rows])
    if rule.across:
        nodes = node_of[owner]
        settled = np.minimum.reduceat(nodes, heads) != np.maximum.reduceat(nodes, heads)
    else:
        settled = (np.bincount(classes) > 1) | np.maximum.reduceat(decided[owner], heads)
    out: list[tuple] = []
    again = np.sort(order[settled[classes]])
    for k, at in zip(*np.unique(np.searchsorted(begin, again, side="right") - 1, return_index=True), strict=True):
        own = again[at : np.searchsorted(again, begin[k + 1])]
        if not decided[k]:
            out.append((rows[k]["node"], _spans((own - begin[k]) // width + rows[k]["first"], rule.length), None, None, None, None, None))
    packs: dict[tuple[int, int], tuple[list, list]] = {}
    for head, end in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist(), strict=True):
        row = rows[owner[head]]
        if not shared[owner[head]]:
            continue
        at = int(order[head])
        digest = hashlib.blake2b(raw[at : at + length], digest_size=16).digest()
        digests, places = packs.setdefault((row["key"], int.from_bytes(digest[:8], "little") % row["parts"]), ([], []))
        if settled[classes[head]]:
            digests.append(digest)
            places.append((-1, 0, 1))
            continue
        for i in range(head, end):
            k = int(owner[i])
            digests.append(digest)
            places.append((node_of[k], rows[k]["first"] + (int(order[i]) - int(begin[k])) // width, int(i == head)))
    named = list(number)
    for (key, bucket), (digests, places) in packs.items():
        table = np.array(places, np.int64)
        used, table[:, 0] = np.unique(table[:, 0], return_inverse=True)
        some = [None if i < 0 else named[i] for i in used.tolist()]
        out.append((None, None, key, bucket, b"".join(digests), table.tobytes(), some))
    return _batch(out, _SCHEMA)


_MET = pa.schema([("node", pa.binary()), ("spans", _SPANS)])


def _meet(rows: list[tuple], length: int) -> list[tuple]:
    """(node, spans) of the windows that tasks have found apart in one bucket of an anchor and that two of them have."""
    digests = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]).reshape(-1, 2)
    places = [np.frombuffer(r[1], np.int64).reshape(-1, 3) for r in rows]
    number: dict[bytes | None, int] = {None: 0}
    node = np.concatenate([np.array([number.setdefault(n, len(number)) for n in r[2]])[p[:, 0]] for r, p in zip(rows, places, strict=True)])
    places = np.concatenate(places)
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.append(True, (digests[order[1:]] != digests[order[:-1]]).any(axis=1))
    classes = np.cumsum(new) - 1
    votes = np.bincount(classes, places[order, 2])
    found = order[(votes[classes] > 1) & (node[order] > 0)]
    out, named = [], list(number)
    found = found[np.lexsort((places[found, 1], node[found]))]
    for k, at in zip(*np.unique(node[found], return_index=True), strict=True):
        own = found[at : at + np.searchsorted(node[found[at:]], k, side="right")]
        out.append((named[k], _spans(places[own, 1], length)))
    return out


def repeated_spans(texts: DataFrame, length: int = LENGTH, piece: int = PIECE, across: bool = False) -> DataFrame:
    """(node, spans) of the texts with repeated bytes; spans are sorted (first byte, byte after the last), overlap and may repeat.

    texts: id, node, scope, text. Rows with one node are copies of one text. Only texts of one scope (a 64-bit number)
    are compared. With ``across`` a string counts if two nodes have it; else if it starts anywhere else, in the same text
    or in a copy too.
    """
    (spans,) = spans_by_rule(texts, [Rule(length, piece, across=across)])
    return stored(spans)


def spans_by_rule(texts: DataFrame, rules: list[Rule]) -> list[DataFrame]:
    """As ``repeated_spans`` for each rule, in its symbols; texts are read and dealt together for all of them."""
    docs = texts.select("id", "node", "scope", "text")

    def keys_of(raw: bytes, scope: int, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, first, last = anchors(raw, *rule[:3])
        return (keys ^ np.uint64(scope % 2**64)).view(np.int64), first, last

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.int64())
        for batch in slices(batches):
            sizes: list[int] = []
            cols: list[list] = [[] for _ in columns]
            for scope, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.encode()
                sizes.append(len(raw))
                found = [x for rule in rules for x in np.unique(keys_of(coded(raw, rule), scope, rule)[0], return_counts=True)]
                for column, value in zip(cols, found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(c, many) for c in cols)],
                ["id", "node", "size", *columns],
            )

    kind = dict(docs.dtypes)["id"]
    columns = [f"{c}{i}" for i in range(len(rules)) for c in ("own", "times")]
    marked = docs.mapInArrow(find, f"id {kind}, node binary, size long, " + ", ".join(f"{c} array<long>" for c in columns))
    distinct = stored(
        marked.groupBy("node").agg(
            F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in columns]
        )
    )
    keys = None
    for i, rule in enumerate(rules):
        # A row for each text and key, so that a text made of one phrase has one, however often the phrase comes.
        places = distinct.select("node", F.explode(F.arrays_zip(F.col(f"own{i}").alias("key"), F.col(f"times{i}").alias("times"))).alias("p")).select("node", "p.*")
        often = places.groupBy("key").agg(F.sum("times").alias("n"), F.count("*").alias("texts")).where("texts > 1" if rule.across else "n > 1")
        parts = F.ceil(F.greatest("texts", F.col("n") / 8) / TOGETHER)
        of_rule = places.join(often, "key").select("node", F.struct(F.lit(i).alias("rule"), "key", parts.alias("parts")).alias("k"))
        keys = of_rule if keys is None else keys.unionByName(of_rule)
    wanted = distinct.select("node", "first_id", "copies").join(keys.groupBy("node").agg(F.collect_list("k").alias("wanted")), "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = pa.list_(pa.list_(pa.int64()))
        schema = pa.schema(
            [("rule", pa.int32()), ("key", pa.int64()), ("parts", pa.int64()), ("content", pa.binary()), ("weight", pa.int64()), ("node", pa.binary()), ("spots", spots), ("bytes", pa.binary())]
        )

        for batch in slices(batches):
            rows: list[tuple] = []
            for node, copies, scope, text, chosen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, rule in enumerate(rules):
                    parts_of = {w["key"]: w["parts"] for w in chosen if w["rule"] == i}
                    if not parts_of:
                        continue
                    raw, seen = coded(text.encode(), rule), {}
                    for key, first, last in zip(*(c.tolist() for c in keys_of(raw, scope, rule)), strict=True):
                        if key in parts_of:
                            # Equal segments of a text are one; only where texts are told apart each stands for itself.
                            segment = raw[first * rule.width : (last + rule.length) * rule.width]
                            seen.setdefault((key, segment, first if rule.across else None), []).append((first, last))
                    for (key, segment, _), spots in seen.items():
                        content = hashlib.blake2b(segment, digest_size=16).digest()
                        rows.append((i, key, parts_of[key], content, len(spots) * copies, node, spots, segment))
                if len(rows) >= 2000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    chosen = docs.alias("d").join(wanted.alias("w"), F.expr("d.node = w.node and d.id <=> w.first_id"))
    segments = stored(
        chosen.select("d.node", "w.copies", "d.scope", "d.text", "w.wanted").mapInArrow(
            cut, "rule int, key long, parts long, content binary, weight long, node binary, spots array<array<long>>, bytes binary"
        )
    )
    return [_spans_of(segments.where(F.col("rule") == i).drop("rule"), distinct, rule) for i, rule in enumerate(rules)]


def _spans_of(segments: DataFrame, distinct: DataFrame, rule: Rule) -> DataFrame:
    """(node, spans) by one rule, from the segments of the texts that share an anchor with others."""
    length, across = rule.length, rule.across

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        windows, group = 0, None
        for batch in slices(batches):
            for row in batch.to_pylist():
                if windows >= AT_ONCE and (row["key"], row["part"]) != group:
                    yield _settle(rows, rule)
                    rows, windows = [], 0
                rows.append(row)
                group, windows = (row["key"], row["part"]), windows + len(row["bytes"]) // rule.width - length + 1
        if rows:
            yield _settle(rows, rule)

    # Equal segments are compared once. What two texts, or two places, have whole is repeated as it is.
    one = F.struct("node", "spots")
    if across:
        segment = segments.select("key", "content", "weight", "parts", one.alias("one"), "bytes")
    else:
        segment = segments.groupBy("key", "content").agg(F.sum("weight").alias("weight"), F.first("parts").alias("parts"), F.min(one).alias("one"), F.first("bytes").alias("bytes"))
    dealt = F.xxhash64(F.col("one.node") if across else F.col("content"))
    found = stored(
        segment.select(
            "key", F.pmod(dealt, F.col("parts")).alias("part"), "parts", ((F.col("weight") > 1) & (not across)).alias("decided"),
            "one.node", F.col("one.spots")[0][0].alias("first"), "bytes",
        )
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "node", "first")
        .mapInArrow(compare, _FOUND)
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group = None
        for batch in slices(batches):
            for key, bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (key, bucket) != group:
                    yield _batch(_meet(rows, length), _MET)
                    rows = []
                group = (key, bucket)
                rows.append(tuple(row))
        if rows:
            yield _batch(_meet(rows, length), _MET)

    met = (
        found.where(F.col("key").isNotNull()).select("key", "bucket", "digests", "places", "nodes")
        .repartition("key", "bucket")
        .sortWithinPartitions("key", "bucket")
        .mapInArrow(meet, f"node binary, spans {_SPAN}")
    )
    spans = found.where(F.col("key").isNull()).select("node", "spans").unionByName(met)
    if not across:
        several = segments.groupBy("key", "content").agg(F.sum("weight").alias("n")).where("n > 1").select("key", "content")
        covered = F.transform("spots", lambda s: F.struct(s[0].alias("first"), (s[1] + length).alias("end")))
        whole = segments.join(several, ["key", "content"]).select("node", covered.alias("spans"))
        copied = distinct.where((F.col("copies") > 1) & (F.col("size") >= length))
        all_of = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("end")))
        spans = spans.unionByName(whole).unionByName(copied.select("node", all_of.alias("spans")))
    return spans.groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def _document_spans(docs: DataFrame) -> DataFrame:
    """(node, spans, passages) of the texts of documents: bytes of repeated strings, and words of passages that others have."""
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = docs.select(F.col("doc_id").alias("id"), text_node(F.col("text")).alias("node"), F.lit(0).cast("long").alias("scope"), text)
    strings, words = spans_by_rule(texts, [Rule(LENGTH, PIECE), PASSAGES])
    none = F.lit(None).cast(_SPAN)
    both = strings.select("node", "spans", none.alias("passages")).unionByName(words.select("node", none.alias("spans"), F.col("spans").alias("passages")))
    return stored(both.groupBy("node").agg(F.max("spans").alias("spans"), F.max("passages").alias("passages")))


def passage_bytes(raw: bytes, passages: list[dict] | None) -> list[list[int]]:
    """The bytes of passages, from the first byte of the first word of each to the last of the last."""
    if not passages:
        return []
    starts, ends = word_places(raw)
    return [[int(starts[a]), int(ends[b - 1])] for a, b in merged(passages)]


def merged(spans: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["first"], s["end"]])
    return out


def kept_bytes(raw: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _joined(docs: DataFrame, spans: DataFrame, *columns: Column) -> DataFrame:
    keyed = docs.select(*columns, text_node(F.col("text")).alias("node"))
    return keyed.join(spans, "node", "left").drop("node")


def removal(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes.

    A null text is as an empty one; texts of fewer than 400 bytes lose nothing. Equal texts of 400 bytes or more are
    removed whole, each copy of them. Matches never cross documents, and are judged on the input. Passages are runs of
    words in passages of over 50 words that other texts have too, of any number of bytes; they are told and not removed.
    """
    spans = _document_spans(docs)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text, spans, passages in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw, gone = (text or "").encode(), merged(spans)
                kept, shared = kept_bytes(raw, gone), passage_bytes(raw, passages)
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(shared), sum(b - a for a, b in shared)))
            cols = [pa.array([r[i] for r in rows], pa.string() if name == "kept_sha256" else pa.int64()) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return _joined(docs, spans, F.col("doc_id"), F.col("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns; repeated bytes are gone from text, and n_chars, if there, counts what is left.

    Passages of over 50 words that other texts have too are gone as well, where they have fewer bytes than a string needs.
    Bytes of a character that is cut go too. Null texts stay null, and a text that is removed whole is empty.
    """
    spans = _document_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts: list[str | None] = []
            for text, spans, passages in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if text is not None and (spans or passages):
                    raw = text.encode()
                    more = [{"first": a, "end": b} for a, b in passage_bytes(raw, passages)]
                    text = kept_bytes(raw, merged(sorted((spans or []) + more, key=lambda s: s["first"]))).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    joined = _joined(docs, spans, row, F.col("text"))
    schema = joined.select("row", "text").schema
    out = joined.mapInArrow(run, schema)
    columns = {c: F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        columns["n_chars"] = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(kind).alias("n_chars")
    return out.select(*[columns[c] for c in docs.columns])
