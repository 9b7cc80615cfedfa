"""Token ids in binary blocks with Elias-Fano document boundaries.

Format (version 1). A folder has two Parquet tables. ``blocks`` has a row for each block of consecutive documents in
ascending order of doc_id: bucket, block (its place in the bucket), n_docs, n_null (documents without a doc_id, which
come first), n_ids, ids (all ids one after another, little-endian unsigned integers of ``width`` bytes), and two
Elias-Fano sequences: ``bounds_*`` has the n_docs + 1 boundaries of the documents within ids, ``docs_*`` the doc_ids
less ``first_doc``. ``buckets`` has for each bucket the number of ids before it. Spark's writer commits whole tasks, so
a lost executor leaves no half block, and any store that Spark reaches will do.

An Elias-Fano sequence of m numbers up to u keeps the low bits of each number packed, and the high bits as a bit per
number and a bit per step: 2 + log2(u / m) bits a number. The place of every 256th number among the high bits is kept
too, so that the i-th boundary is found by counting the bits of a few bytes.
"""

from __future__ import annotations

import codecs
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BEYOND, VOCABULARY, Splitter, byte_alphabet, vocabulary_path
from .common import shared_folder

#: Id after the last token of each document.
END = 0
#: Documents and ids after which a block ends, documents of a bucket, and most buckets (beyond, they get larger).
BLOCK_DOCS, BLOCK_IDS, BUCKET_DOCS, MAX_BUCKETS = 1024, 1_000_000, 2048, 10_000
#: Numbers of a sequence from one kept place to the next.
SAMPLE = 256
#: Entries of a worker's memo of pre-tokens, and bytes of texts split at a time; longer texts are encoded on their own.
MEMO, AT_ONCE = 400_000, 1 << 20
#: Groups of so many bytes whose pre-tokens are looked up together, and that the encoder hands on at a time.
GROUPS = 4
#: Kinds of characters, as far as pre-tokens tell them apart.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pre-tokens of fewer ids than this are packed by a format that is compiled once.
PACKERS = 32

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of non-negative numbers; ``select(i)`` is the i-th."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, np.uint64)
        n = len(numbers)
        top = int(numbers[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((numbers[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (numbers >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        samples = places[::SAMPLE].astype("<u4")
        return cls(n, low_bits, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), samples.tobytes())

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def select(self, i: int) -> int:
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(place, 8)
        if left:  # the sampled bit itself counts as the first
            window = np.frombuffer(self.high[byte : byte + SAMPLE].tobytes(), np.uint8).copy()
            window[0] &= 0xFF << bit & 0xFF
            found = np.cumsum(_ONES[window], dtype=np.int64)
            while found[-1] <= left:
                left -= int(found[-1])
                byte += len(window)
                window = self.high[byte : byte + SAMPLE]
                found = np.cumsum(_ONES[window], dtype=np.int64)
            k = int(np.searchsorted(found, left, side="right"))
            left -= int(found[k - 1]) if k else 0
            place = (byte + k) * 8 + int(np.flatnonzero(np.unpackbits(window[k : k + 1], bitorder="little"))[left])
        start = i * self.low_bits
        first, last = start // 8, (start + self.low_bits + 7) // 8
        low = int.from_bytes(self.low[first:last].tobytes(), "little") >> start % 8 & (1 << self.low_bits) - 1
        return (place - i << self.low_bits) | low

    def numbers(self) -> np.ndarray:
        """All of them at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low


class _Memo(dict):
    """Packed ids of pre-tokens; one that is new goes to the model of the tokenizers library.

    The model takes a pre-token with a character for each byte, as the library hands it on. When half of the entries are
    in, they become the older ones; an older one that comes back is among the newer ones again, the rest is forgotten.
    """

    def __init__(self, tokenizer: object, code: str, special: dict[str, int]):
        self.tokenize, self.code, self.special = tokenizer.model.tokenize, code, special
        letters = {b: c for c, b in byte_alphabet().items()}
        self.letters = "".join(letters[b] for b in range(256))
        self.packers = [struct.Struct(f"<{n}{code}").pack for n in range(PACKERS)]
        self.older: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        out = self.older.get(token)
        if out is None:
            out = self.packed(token)
        self[token] = out
        return out

    def packed(self, token: str) -> bytes:
        if token in self.special:
            ids = [self.special[token]]
        else:
            ids = [t.id for t in self.tokenize(codecs.charmap_decode(token.encode(), "strict", self.letters)[0])]
        return self.packers[len(ids)](*ids) if len(ids) < PACKERS else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def age(self) -> None:
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()


class LibraryEncoder(Splitter):
    """Ids by the tokenizers library, which encodes each pre-token once and on its own."""

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.width = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.memo = _Memo(tokenizer, "H" if self.width == 2 else "I", self.special)
        # Most texts are of European scripts and without special tokens. They are split many at a time.
        near = "".join(map(chr, range(BEYOND)))
        self.kinds = np.full(BEYOND, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            self.kinds[[ord(c) for c in regex.findall(pattern, near)]] = kind
        special = "".join("|" + "".join(f"\\x{{{ord(c):X}}}" for c in s) for s in self.special)
        self.apart = rf"[^\x{{0}}-\x{{{BEYOND - 1:X}}}]{special}"

    def pre_tokens(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of European texts without special tokens, one text after another, and where those of each begin."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds, n = self.kinds[codes], len(codes)
        borders = np.cumsum([0, *map(len, texts)])
        fresh = np.zeros(n + 3, bool)  # a text begins, or all of them have ended
        fresh[borders] = fresh[n:] = True
        first = fresh.copy()
        first[1:n] |= kinds[1:] != kinds[:-1]
        # Of white space before anything else, the last character stands alone, or with what follows if it is a space.
        after = np.flatnonzero(first[1:n] & ~fresh[1:n] & (kinds[:-1] == SPACE)) + 1
        first[after - 1] = True
        first[after[codes[after - 1] == ord(" ")]] = False
        # Contractions where a pre-token begins with an apostrophe; what follows them begins anew.
        codes = np.append(codes, np.zeros(3, np.uint32))
        quote = np.flatnonzero((codes[:n] == ord("'")) & first[:n])
        quote = quote[~fresh[quote + 1]]
        one, two = codes[quote + 1], np.where(fresh[quote + 2], 0, codes[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        first[quote[short | long] + 1] = False
        first[quote[short] + 2] = True
        first[quote[long] + 3] = True
        edges = np.flatnonzero(first[:n])
        places = np.arange(n + 1, dtype=np.int32)
        places[1:] += np.cumsum(codes[:n] >= 0x80, dtype=np.int32)  # in UTF-8, where characters up to BEYOND take two bytes at most
        places = np.append(places[edges], places[n])
        found = pa.Array.from_buffers(pa.string(), len(edges), [None, pa.py_buffer(places), pa.py_buffer(joined.encode())])
        return found, np.searchsorted(edges, borders)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        self.memo.age()
        get = self.memo.__getitem__
        return [b"".join(map(get, self(t or ""))) for t in texts]

    def _together(self, groups: list[pa.Array]) -> list[bytes]:
        """Ids of texts that are split at a time; each of their different pre-tokens is looked up once."""
        self.memo.age()
        split = [self.pre_tokens(texts.to_pylist()) for texts in groups]
        before = np.cumsum([0] + [len(words) for words, _ in split]).tolist()
        begins = np.concatenate([*(own[:-1] + n for (_, own), n in zip(split, before, strict=False)), before[-1:]])
        found = pa.concat_arrays([words for words, _ in split]).dictionary_encode()
        packed = pa.array([self.memo[w] for w in found.dictionary.to_numpy(zero_copy_only=False)], pa.binary())
        # Taken in order, the ids of pre-tokens stand one after another in one buffer.
        taken = packed.take(found.indices)
        at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset) if len(taken) else np.zeros(1, np.int32)
        edges = at[begins].tolist()
        raw = taken.buffers()[2]
        return [raw[a:b].to_pybytes() if b > a else b"" for a, b in zip(edges, edges[1:], strict=False)]

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """As ``encode_all``; a null text is as an empty one."""
        texts = texts.cast(pa.string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        apart = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False) | (sizes > AT_ONCE)
        group = np.where(apart, -1, np.cumsum(np.where(apart, 0, sizes)) // AT_ONCE)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(apart).tolist():
            out[i] = self.encode_all([texts[i].as_py()])[0]
        for k in np.unique(group[~apart] // GROUPS).tolist():
            own = [np.flatnonzero(group == g) for g in range(k * GROUPS, (k + 1) * GROUPS)]
            for i, ids in zip(np.concatenate(own).tolist(), self._together([texts.take(pa.array(at)) for at in own]), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=2)
def _encoder(name: str) -> LibraryEncoder:
    return LibraryEncoder(vocabulary_path(name))


_BLOCK = (
    "bucket int, block int, inside long, n_docs int, n_null int, first_doc long, n_ids long, width int, ids binary, "
    "bounds_bits int, bounds_low binary, bounds_high binary, bounds_samples binary, "
    "docs_bits int, docs_low binary, docs_high binary, docs_samples binary"
)


class _Packer:
    """Collects documents of one bucket in order and gives blocks."""

    def __init__(self) -> None:
        self.bucket, self.block, self.inside = None, 0, 0
        self.ids: list[bytes] = []
        self.docs: list[int | None] = []
        self.size = 0

    def full(self, bucket: int, width: int) -> bool:
        return bool(self.docs) and (bucket != self.bucket or len(self.docs) >= BLOCK_DOCS or self.size >= BLOCK_IDS * width)

    def add(self, bucket: int, doc: int | None, ids: bytes) -> None:
        if bucket != self.bucket:
            self.bucket, self.block, self.inside = bucket, 0, 0
        self.docs.append(doc)
        self.ids.append(ids)
        self.size += len(ids)

    def row(self, width: int) -> tuple:
        lengths = np.array([len(x) // width for x in self.ids], np.int64)
        known = np.array([d for d in self.docs if d is not None], np.int64)
        first = int(known[0]) if len(known) else 0
        gaps = known.astype(np.uint64) - np.int64(first).astype(np.uint64)  # exact modulo 2**64
        bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
        row = (
            self.bucket, self.block, self.inside, len(self.docs), len(self.docs) - len(known), first, int(lengths.sum()), width,
            b"".join(self.ids), *bounds.parts(), *EliasFano.of(gaps).parts(),
        )
        self.ids, self.docs, self.size = [], [], 0
        self.block += 1
        self.inside += int(lengths.sum())
        return row


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Encode the texts of all documents and write them in the format above, ascending by doc_id.

    A null text is as an empty one: only its end id is written. Null doc_ids come first; equal ones stay next to each
    other, in the order of the bytes of their ids, which is the same in every run. Texts are encoded where they are read, and
    only ids are shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_DOCS)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else None
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(vocabulary)
        end = np.array([END], f"<u{own.width}").tobytes()
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(size // (GROUPS * AT_ONCE))) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(i, j - i)
                keys = part.column(0).to_pylist()
                place = [0 if k is None else int(np.searchsorted(bounds, k, side="left")) for k in keys]
                ids = pa.array([x + end for x in own.encode_array(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), part.column(0), ids], ["bucket", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, packer = _encoder(vocabulary).width, _Packer()
        schema = pa.schema(
            [(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in _BLOCK.split(", "))]
        )

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(packer.row(width), schema, strict=True)], schema=schema)

        for batch in batches:
            for bucket, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packer.full(bucket, width):
                    yield out()
                packer.add(bucket, doc, ids)
        if packer.docs:
            yield out()

    ordered = (
        docs.mapInArrow(encode, "bucket int, doc_id long, ids binary")
        .repartition(max(buckets, 1), "bucket")
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    )
    ordered.mapInArrow(pack, _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("bucket").agg(F.sum("n_ids").alias("n_ids")).orderBy("bucket").collect()
    before, rows = 0, []
    for row in sizes:
        rows.append((row["bucket"], before))
        before += row["n_ids"]
    spark.createDataFrame(rows, "bucket int, before long").coalesce(1).write.parquet(f"{path}/buckets")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    # At most MAX_BUCKETS rows.
    starts = F.broadcast(spark.read.parquet(f"{path}/buckets"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bounds = EliasFano(row["n_docs"] + 1, *(row[f"bounds_{x}"] for x in ("bits", "low", "high", "samples")))
                known = row["n_docs"] - row["n_null"]
                docs = EliasFano(known, *(row[f"docs_{x}"] for x in ("bits", "low", "high", "samples")))
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                base = row["before"] + row["inside"]
                at = bounds.numbers().tolist()
                doc_ids = [None] * row["n_null"] + [i + row["first_doc"] for i in docs.numbers().tolist()]
                for i in range(0, row["n_docs"], 64):
                    part = range(i, min(i + 64, row["n_docs"]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_ids[k] for k in part], pa.int64()),
                            pa.array([base + at[k] for k in part], pa.int64()),
                            pa.array([at[k + 1] - at[k] for k in part], pa.int64()),
                            pa.array([ids[at[k] : at[k + 1]].astype("<u4").tobytes() for k in part], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return blocks.join(starts, "bucket").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the files, read them back, and give doc_id, start, n_tokens and ids_crc32 of every document."""
    path = path or shared_folder(docs.sparkSession)
    write_tokens(docs, path, vocabulary)

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(docs.sparkSession, path).mapInArrow(checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")
