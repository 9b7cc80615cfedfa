"""Near-duplicate documents by improved consistent weighted sampling.

A text is the bag of its five-word shingles. A shingle's weight is its count in the text times an inverse document
frequency. Consistent weighted sampling draws shingles so that two texts draw the same one with a probability equal to
their weighted Jaccard similarity; the draws are banded, texts that agree in a band are candidates, and a candidate
pair is a link if its weighted Jaccard similarity, computed from all shingles, reaches the threshold.

Equal texts are one node from the start. In a band's bucket every member is compared with one representative, in a
crowded bucket the one that agrees best with its most frequent draws, so a group of edited copies meets its original.
That joins most of what is similar for as many pairs as a bucket has members. What a bucket still holds apart is then
compared whole: its members are dealt in blocks, and each two blocks that are not of one component meet in some task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .graph import components

#: Words of a shingle and the least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and draws in a band: a pair at the threshold shares no band with a probability of 0.0002.
BANDS, ROWS = 12, 3
#: Draws of all that a candidate pair must share before it is compared; a pair at the threshold fails once in 100,000.
AGREE = 18
#: Bins that count document frequencies, and how far the rarest shingle outweighs one that all documents have. The
#: range is small because the shingles of a large group of near copies are frequent: were they worth much less than the
#: few that an edit makes, its members would no longer be similar.
BINS, IDF_RANGE = 1 << 16, 0.25
#: Rounds of new representatives in crowded buckets, after the first. They only save comparisons of the last step.
ROUNDS = 2
#: Members of a crowded bucket, and about how many of them tell its most frequent draws.
CROWD, SAMPLE = 32, 64
#: Members of a block, and shingles of two blocks that are compared at a time.
BLOCK, COLUMNS = 128, 4096
#: Shingles that are sampled at a time, texts that are read at a time, and characters whose words are found at a time.
AT_ONCE, TEXTS, STRETCH = 8192, 64, 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_node(text: Column) -> Column:
    """What equal texts share; a null text is as an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


_gap = re.compile(r"\W").search


@lru_cache(maxsize=1)
def _word_letters() -> np.ndarray:
    """True for each code point that a word may have, those of ``\\w``."""
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins, and its hash; each different word is hashed once."""
    import xxhash

    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = _word_letters()[codes]
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    codes = codes[letter]
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)  # bytes in UTF-8
    places = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(ends - starts)])].astype(np.int32)
    raw = codes.tobytes().decode("utf-32-le").encode()
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
    different = words.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
    return starts, hashes[words.indices.to_numpy()]


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` words in a row."""
    n = len(codes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out * _MIX + codes[i : i + n])
    return out


def _together(texts: list[str]) -> Iterator[np.ndarray]:
    """The shingles of each of some texts in lower case, whose words are found together."""
    joined = "\n".join(texts)
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(joined):
        cut = _gap(joined, at + STRETCH)
        end = cut.start() if cut else len(joined)
        found = _word_hashes(joined[at:end])
        starts.append(found[0] + at)
        hashes.append(found[1])
        at = end
    starts, hashes = np.concatenate(starts), np.concatenate(hashes)
    edges = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    rolled = _rolled(hashes, SHINGLE) if len(hashes) >= SHINGLE else None
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a >= SHINGLE:
            yield rolled[a : b - SHINGLE + 1]
        else:
            yield _rolled(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def all_shingles(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashes of all five-word shingles of each text in order, repeated ones too.

    A shorter text with words has one of all its words.
    """
    some: list[str] = []
    size = 0
    for text in texts:
        some.append((text or "").lower())
        size += len(some[-1])
        if size >= STRETCH:
            yield from _together(some)
            some, size = [], 0
    if some:
        yield from _together(some)


def shingles(text: str | None) -> np.ndarray:
    """Those of one text."""
    return next(all_shingles([text]))


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & BINS - 1


def idf_weights(docs: DataFrame) -> np.ndarray:
    """Weights from 1 to 1 + IDF_RANGE by bin, from the document frequencies in all documents.

    The bins are a fixed number, so what comes back does not grow. The middle bin's count is what rare shingles
    have gathered in each, and is taken off.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                texts = batch.column(0).slice(i, TEXTS).to_pylist()
                total += np.bincount(np.concatenate([_bin(np.unique(s)) for s in all_shingles(texts)]), minlength=BINS)
                n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["bin", "n"])

    table = docs.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    n = max(2, int(table.loc[table["bin"] < 0, "n"].sum()))
    counts = np.zeros(BINS)
    counts[table.loc[table["bin"] >= 0, "bin"]] = table.loc[table["bin"] >= 0, "n"]
    frequency = np.clip(counts - np.median(counts), 1, n)
    level = np.round(15 * (1 - np.log(frequency) / np.log(n)))  # a few levels, so that the order of sums cannot show
    return (1 + IDF_RANGE * level / 15).astype(np.float32)


def _draw(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, draws) of 64-bit draws. Shingles are distinct and sorted within a document; starts is where each begins."""
    sizes = np.diff(np.append(starts, len(hashes)))
    log_weight, scale = np.log(weights), np.float32(2.0**-32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        one = _mixed(hashes + np.uint64(int(_MIX) * (3 * k + 1) % 2**64))
        two = _mixed(one + _MIX)
        # Gamma(2, 1) variables are minus the logarithm of a product of two uniform ones, here the halves of a number.
        r, c = (-np.log(np.multiply(*((x.view(np.uint32).reshape(-1, 2).T.astype(np.float32) + 1) * scale))) for x in (one, two))
        beta = (two * _MIX).view(np.uint32)[1::2].astype(np.float32) * scale
        r += np.float32(1e-9)
        t = np.floor(log_weight / r + beta)
        rank = np.log(c + np.float32(1e-30)) - r * (t - beta + 1)
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        at = np.flatnonzero(rank == least)
        first = at[np.searchsorted(at, starts)]
        out[:, k] = _mixed(hashes[first] ^ _mixed(t[first].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return out


def _sampled(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, node, draws, bands) of every document; no draws and bands for a text without a word."""

    def drawn(texts: list[str | None]) -> list[np.ndarray | None]:
        draws: list[np.ndarray | None] = [None] * len(texts)
        group: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if group:
                starts = np.cumsum([0] + [len(h) for _, h, _ in group[:-1]])
                got = _draw(np.concatenate([h for _, h, _ in group]), np.concatenate([w for *_, w in group]), starts)
                for (i, *_), row in zip(group, got, strict=True):
                    draws[i] = row
                group.clear()

        size = 0
        for i, found in enumerate(all_shingles(texts)):
            hashes, counts = np.unique(found, return_counts=True)
            if len(hashes):
                group.append((i, hashes, idf[_bin(hashes)] * counts.astype(np.float32)))
                size += len(hashes)
            if size >= AT_ONCE:
                flush()
                size = 0
        flush()
        return draws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                bands, small = [], []
                for row in drawn(part.column(2).to_pylist()):
                    if row is None:
                        bands.append([])
                        small.append([])
                        continue
                    parts = row.reshape(BANDS, ROWS)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for j in range(ROWS):
                        key = _mixed(key * _MIX + parts[:, j])
                    bands.append(key.view(np.int64))
                    small.append(row.astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(small, pa.list_(pa.int32())), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "node", "draws", "bands"],
                )

    return docs.select("doc_id", text_node(F.col("text")).alias("node"), "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, draws array<int>, bands array<long>"
    )


def _similar(a: bytes, b: bytes, idf: np.ndarray) -> float:
    (x, n), (y, m) = (np.unique(np.frombuffer(v, np.uint64), return_counts=True) for v in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = (idf[_bin(x[i])].astype(np.float64) * np.minimum(n[i], m[j])).sum()
    total = (idf[_bin(x)].astype(np.float64) * n).sum() + (idf[_bin(y)].astype(np.float64) * m).sum()
    return shared / (total - shared)


def _verified(pairs: DataFrame, bags: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [_similar(left[i].as_py(), right[i].as_py(), idf) >= similarity for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    two = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a binary, b binary")


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """All shingles of the wanted nodes (node, first_id), each from the one document that stands for its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                bags = [np.sort(s).tobytes() for s in all_shingles(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bags, pa.binary())], ["node", "bag"])

    texts = docs.select("doc_id", text_node(F.col("text")).alias("node"), "text").alias("d")
    chosen = texts.join(wanted.alias("w"), F.expr("d.node = w.node and d.doc_id <=> w.first_id")).select("d.node", "d.text")
    return chosen.mapInArrow(run, "node binary, bag binary").dropDuplicates(["node"])


def _parts(bag: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a sorted bag, repeated ones told apart by their number, and their weights."""
    v = np.frombuffer(bag, np.uint64)
    number = (np.arange(len(v)) - np.searchsorted(v, v)).astype(np.uint64)
    return _mixed(v + number * _MIX), idf[_bin(v)].astype(np.float64)


def _shared(left: list[np.ndarray], right: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """(left, right) weights of what two sets of elements share; weights are those of the left ones."""
    (x, i), (y, j) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(e) for e in s])) for s in (left, right))
    both, first = np.unique(x, return_index=True)
    here = np.isin(both, y)
    both, weight = both[here], np.concatenate(weights)[first[here]]
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(both), COLUMNS):
        part = both[at : at + COLUMNS]
        one, two = np.zeros((len(left), len(part))), np.zeros((len(right), len(part)))
        for table, row, element in ((one, i, x), (two, j, y)):
            place = np.minimum(np.searchsorted(part, element), len(part) - 1)
            hit = part[place] == element
            table[row[hit], place[hit]] = 1
        out += one * weight[at : at + COLUMNS] @ two.T
    return out


def _block_links(rows: list[tuple], idf: np.ndarray, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that join what is similar in two blocks, of all pairs. rows: side, node, comp, bag; one block alone has side 0."""
    left = [r for r in rows if r[0] == 0]
    right = [r for r in rows if r[0] == 1] or left
    sides = [[_parts(r[3], idf) for r in left]]
    sides.append(sides[0] if right is left else [_parts(r[3], idf) for r in right])
    shared = _shared([e for e, _ in sides[0]], [e for e, _ in sides[1]], [w for _, w in sides[0]])
    one, two = (np.array([w.sum() for _, w in s]) for s in sides)
    near = shared >= (similarity - 1e-6) * (one[:, None] + two[None, :] - shared)
    root: dict[bytes, bytes] = {}

    def find(c: bytes) -> bytes:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(np.triu(near, 1) if right is left else near)), strict=True):
        a, b = find(left[i][2]), find(right[j][2])
        if a != b and _similar(left[i][3], right[j][3], idf) >= similarity:
            root[a] = b
            out.append((max(left[i][1], right[j][1]), min(left[i][1], right[j][1])))
    return out


def _rest(place: DataFrame, bags: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links between components (bucket, node, comp) that share a bucket, from all pairs of its members that they tell apart."""
    several = place.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
    place = stored(place.join(several, "bucket"))
    # A large component fills blocks of its own, which need not meet each other; small ones share blocks.
    sizes = place.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    rest = sizes.where(F.col("c") < BLOCK).groupBy("bucket").agg(F.sum("c").alias("rest"))
    large, deal = F.col("c") >= BLOCK, F.xxhash64("node")
    own = F.when(large, F.col("comp"))
    block = F.xxhash64(own, F.pmod(deal, F.ceil(F.when(large, F.col("c")).otherwise(F.col("rest")) / BLOCK)))
    dealt = place.join(sizes, ["bucket", "comp"]).join(rest, "bucket", "left").select("bucket", "node", "comp", block.alias("block"), own.alias("own"))
    # Members meet their bags once, and blocks are packed in a row before each goes to every other that it meets.
    member = F.struct("node", "comp", "bag")
    packed = stored(dealt.join(bags, "node").groupBy("bucket", "block", "own").agg(F.collect_list(member).alias("members")))
    blocks = packed.select("bucket", "block", "own")
    one, two = blocks.alias("x"), blocks.alias("y")
    meet = one.join(two, F.expr("x.bucket = y.bucket and x.block <= y.block and (x.own is null or y.own is null or x.own != y.own)"))
    seats = F.expr("if(x.block = y.block, array(struct(0 as side, x.block as block)), array(struct(0 as side, x.block as block), struct(1 as side, y.block as block)))")
    meet = meet.select("x.bucket", F.col("x.block").alias("one"), F.col("y.block").alias("two"), F.explode(seats).alias("s"))
    rows = meet.select("bucket", "one", "two", "s.side", "s.block").join(packed.drop("own"), ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            links = _block_links(rows, idf, similarity)
            return pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.binary()) for k in (0, 1)], ["a", "b"])

        rows: list[tuple] = []
        group = None
        for batch in slices(batches, 1):
            for bucket, x, y, side, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (bucket, x, y) != group:
                    yield out(rows)
                    rows = []
                group = (bucket, x, y)
                rows.extend((side, m["node"], m["comp"], m["bag"]) for m in members)
        if rows:
            yield out(rows)

    key = ("bucket", "one", "two")
    return rows.select(*key, "side", "members").repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, "a binary, b binary")


def _frequent_draws(sample: DataFrame) -> DataFrame:
    """(bucket, mode): the most frequent value of each draw in a sample of a bucket's members (bucket, draws)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            modes = []
            for draws in batch.column(1).to_pylist():
                found = [np.unique(column, return_counts=True) for column in np.array(draws).T]
                modes.append([int(values[np.argmax(counts)]) for values, counts in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(modes, pa.list_(pa.int32()))], ["bucket", "mode"])

    return sample.groupBy("bucket").agg(F.collect_list("draws").alias("draws")).mapInArrow(run, "bucket long, mode array<int>")


def _agreement(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e))


def _heads(place: DataFrame, draws: DataFrame, turn: int) -> DataFrame:
    """(bucket, head, head_comp): of a crowded bucket the member that agrees best with its frequent draws, else any one."""
    order = F.xxhash64("node", "bucket", F.lit(turn))
    crowd = stored(place.where(F.col("n") >= CROWD).join(draws, "node"))
    sample = crowd.where(F.pmod(order, F.ceil(F.col("n") / SAMPLE)) == 0).select("bucket", "draws")
    agree = F.coalesce(_agreement("draws", "mode"), F.lit(0))
    scored = crowd.join(_frequent_draws(sample), "bucket", "left").select("bucket", "node", "comp", agree.alias("agree"))
    if turn == 0:
        scored = scored.unionByName(place.where(F.col("n") < CROWD).select("bucket", "node", "comp", F.lit(0).alias("agree")))
    best = scored.groupBy("bucket").agg(F.max(F.struct("agree", order.alias("order"), "node", "comp")).alias("h"))
    return best.select("bucket", F.col("h.node").alias("head"), F.col("h.comp").alias("head_comp"))


def near_duplicate_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(a, b) links between different texts that join what is similar, and (doc_id, node) of every document."""
    docs = docs.select("doc_id", "text")
    idf = idf_weights(docs)
    sampled = stored(_sampled(docs, idf))
    nodes = stored(
        sampled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("draws").alias("draws"), F.first("bands").alias("bands"))
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(shared, "bucket"))
    wanted = members.select("node").distinct()
    bags = stored(_bags(docs, nodes.select("node", "first_id").join(wanted, "node")))
    draws = nodes.join(wanted, "node").select("node", "draws")
    one, two = draws.select(F.col("node").alias("a"), F.col("draws").alias("x")), draws.select(F.col("node").alias("b"), F.col("draws").alias("y"))
    place, links, tried, led = members.withColumn("comp", F.col("node")), None, None, None
    for turn in range(1 + ROUNDS):
        free = place
        if turn:  # who stands apart from every representative that its bucket has had
            free = place.where(F.col("n") >= CROWD)
            held = free.join(led.select("bucket", F.col("head").alias("node")), ["bucket", "node"], "left_semi").select("bucket", "comp").distinct()
            free = free.join(held, ["bucket", "comp"], "left_anti")
        heads = stored(_heads(free, draws, turn))
        pairs = (
            place.join(heads, "bucket")
            .where(F.col("comp") != F.col("head_comp"))
            .select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
            .distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        close = pairs.join(one, "a").join(two, "b").where(_agreement("x", "y") >= AGREE).select("a", "b")
        found = stored(_verified(close, bags, idf, similarity))
        if turn and found.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        led = heads if led is None else led.unionByName(heads)
        label = components(found if links is None else links.unionByName(found))
        links = label.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        # A bucket of two is settled: its members have been compared.
        place = stored(members.where("n > 2").join(label, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("comp")))
        if place.where(F.col("n") >= CROWD).isEmpty():
            break
    return links.unionByName(stored(_rest(place.drop("n"), bags, idf, similarity))), sampled.select("doc_id", "node")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every document: the smallest doc_id of the texts that links connect.

    Equal texts share a class whatever they hold; null texts count as empty. A text without a word has no other link.
    Null doc_ids are passed over in class_id, which is null if a class has no other. Repeated rows each get a row.
    """
    links, documents = near_duplicate_links(docs, similarity)
    found = components(links)
    own = documents.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    placed = own.join(found, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    classes = placed.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_node = placed.join(classes, "component").select("node", "class_id")
    return documents.join(by_node, "node").select("doc_id", "class_id")


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, whole and with its columns: the one with the smallest doc_id.

    Of rows with that id only one stays; classes without an id keep one row.
    """
    links, documents = near_duplicate_links(docs, similarity)
    found = components(links)
    placed = documents.join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k")
    keep = stored(placed.groupBy("component").agg(least).select("k.doc_id", "k.node"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_node(F.col("text")).alias("node"))
    kept = rows.alias("r").join(keep.alias("k"), F.expr("r.node = k.node and r.id <=> k.doc_id")).select("r.row", "r.node")
    repeated = placed.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.join(keep, ["node"], "left_semi").isEmpty():
        kept = kept.dropDuplicates(["node"])
    return kept.select("row.*")
