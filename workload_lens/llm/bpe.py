"""Byte-pair encoding with forced boundaries, and decoding.

A text is cut at the special tokens and into pre-tokens as the vocabulary file says. Inside a pre-token, two
neighbouring bytes that occur together in no token of the vocabulary can never be merged into one, so every such pair
is a certain cut: the fragments between are encoded on their own and their ids put one after another. Fragments come
back far more often than texts, so each worker keeps those it has met.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Default vocabulary; any path of a byte-level BPE file in the format of the tokenizers library may be given.
VOCABULARY = "byte_bpe_50k.json"
#: Entries that a worker keeps of each memo before it starts a new one.
MEMO = 150_000

#: The pre-token pattern of byte-level BPE, with white space by its Unicode property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts of ASCII characters alone, where the faster standard module does.
ASCII_PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


#: The first code point behind the European scripts.
BEYOND = 0x530


def _ranges(characters: list[str]) -> str:
    """The inside of a character class that has exactly some characters, which are in order."""
    out, first, last = [], None, None
    for code in [*map(ord, characters), None]:
        if last is not None and code == last + 1:
            last = code
            continue
        if first is not None:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(last))}")
        first = last = code
    return "".join(out)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a vocabulary file on this machine: a path as it is, else one of the installed public files."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Cuts a text at special tokens and into pre-tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._find_ascii = re.compile(ASCII_PRE_TOKEN).findall
        # For European scripts the classes are written out, which the faster standard module knows.
        near = "".join(map(chr, range(BEYOND)))
        letter, number, space = (_ranges(regex.findall(c, near)) for c in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self._find = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        ).findall
        # The regex module knows letters and numbers of a later Unicode version than the tokenizers library, for which
        # they are symbols. They all lie beyond European scripts, so most texts need no closer look.
        self._beyond = re.compile(f"[{chr(BEYOND)}-\U0010ffff]").search
        unassigned = "".join(c for c in map(chr, range(BEYOND, 0x110000)) if unicodedata.category(c) == "Cn")
        later = "".join(regex.findall(r"[\p{L}\p{N}]", unassigned)) or "\uffff"
        exact = PRE_TOKEN.replace("LETTER", r"[\p{L}--[NEW]]").replace("NUMBER", r"[\p{N}--[NEW]]")
        exact = exact.replace(r"[^\p{White_Space}\p{L}\p{N}]", r"[[^\p{White_Space}\p{L}\p{N}]||[NEW]]")
        self._find_exact = regex.compile(exact.replace("NEW", later), regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        """Pre-tokens and special tokens; put together they are the text."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str] = []
        for part in self._cut(text):
            if part in self.special:
                out.append(part)
            else:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self._find_ascii(text)
        return self._find_exact(text) if self._beyond(text) else self._find(text)


class Codec(Splitter):
    """Encodes and decodes texts. Ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(path)
        letters, vocabulary = byte_alphabet(), self.spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        inside = np.zeros((256, 256), bool)
        for token, i in vocabulary.items():
            raw = bytes(letters[c] for c in token)
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a, b] = True
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.inside = [row.tobytes() for row in inside]
        self.single = [0] * 256
        for c, b in letters.items():
            self.single[b] = vocabulary[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(self.spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
        self.fragments: dict[bytes, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        del self.spec

    def cuts(self, raw: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(raw)):
            if not inside[raw[i - 1]][raw[i]]:
                out.append(raw[start:i])
                start = i
        out.append(raw[start:])
        return out

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one fragment: the pair of lowest rank, the leftmost first, is merged until none is left."""
        ids, merges = [self.single[b] for b in raw], self.merges
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _new(self, token: str) -> bytes:
        if token in self.special:
            parts = [struct.pack("<I", self.special[token])]
        else:
            parts = []
            for fragment in self.cuts(token.encode()):
                got = self.fragments.get(fragment)
                if got is None:
                    if len(self.fragments) >= MEMO:
                        self.fragments.clear()
                    ids = self.merged(fragment)
                    got = self.fragments[fragment] = struct.pack(f"<{len(ids)}I", *ids)
                parts.append(got)
        out = b"".join(parts)
        if len(token) <= 64:
            if len(self.tokens) >= MEMO:
                self.tokens.clear()
            self.tokens[token] = out
        return out

    def encode(self, text: str | None) -> bytes:
        get, new = self.tokens.get, self._new
        return b"".join([get(t) or new(t) for t in self(text or "")])

    def decode(self, ids: bytes) -> str:
        known = self.bytes_of
        return b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(vocabulary_path(name))


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of every document, each in its own row.

    A null text is as an empty one and has no ids. Nothing is shuffled or cut; a text's length has no limit but memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(ids.dtypes)["doc_id"]
    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, of ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            rows: tuple[list, list, list] = ([], [], [])
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest())
                rows[2].append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
