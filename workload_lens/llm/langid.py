"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone. An n-gram is bound from its letters'
vectors, each permuted by its place (rolled) and multiplied together; a document bundles (adds up) its n-grams, and a
language the unit vectors of its documents. Prototypes are taken relative to their common mean, and a document gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the vectors, letters of an n-gram, and the prediction for texts without a letter.
DIM, GRAM, UNKNOWN = 1024, 3, "und"
#: Documents and n-grams that are multiplied at a time; every n-gram of every text is used.
DOCS_AT_ONCE, GRAMS_AT_ONCE = 64, 8192
#: Texts whose vectors a task holds at a time.
TEXTS = 1024
_SPACE = ord(" ")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The random vectors of some code points, (n, dim) of +1 and -1; the same on every machine."""
    words = np.arange(dim // 64, dtype=np.uint64)
    bits = _mixed(_mixed(codes.astype(np.uint64))[:, None] + words).view(np.uint8)
    return (np.unpackbits(bits, axis=1).astype(np.int8) * 2 - 1)[:, :dim]


def text_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as numbers of 21 bits a letter, and their counts; none if it has no letter.

    Letters are in lower case; whatever stands between letters is one space.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[_SPACE], np.where(letter, codes, _SPACE), [_SPACE]])
    codes = codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]
    n = len(codes) - GRAM + 1
    grams = np.zeros(n, np.int64)
    for i in range(GRAM):
        grams = grams << 21 | codes[i : i + n]
    return np.unique(grams, return_counts=True)


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of n-grams."""
    out = None
    for i in range(GRAM):
        codes, place = np.unique(grams >> 21 * (GRAM - 1 - i) & (1 << 21) - 1, return_inverse=True)
        turned = np.roll(letter_vectors(codes, dim), GRAM - 1 - i, axis=1)[place]
        out = turned if out is None else np.multiply(out, turned, out=out)
    return out


def text_vectors(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """Unit vectors of some texts, zero for a text without a letter."""
    out = np.zeros((len(texts), dim), np.float32)
    for first in range(0, len(texts), DOCS_AT_ONCE):
        found = [text_grams(t) for t in texts[first : first + DOCS_AT_ONCE]]
        grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        row = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
        count = np.concatenate([c for _, c in found])
        for at in range(0, len(grams), GRAMS_AT_ONCE):
            here = (place >= at) & (place < at + GRAMS_AT_ONCE)
            part = grams[at : at + GRAMS_AT_ONCE]
            counts = np.zeros((len(found), len(part)), np.float32)
            counts[row[here], place[here] - at] = count[here]
            out[first : first + len(found)] += counts @ gram_vectors(part, dim).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learned from: crc32 of the id as text is 0 modulo 5, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def prototypes(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes from all given documents with a text and a lang.

    Each task adds up the vectors of its documents, so that what is shuffled and what comes back are
    ``dim`` numbers a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                langs = np.array(part.column(1).to_pylist(), object)
                vectors = text_vectors(part.column(0).to_pylist(), dim)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dim, pa.string()), pa.array(range(dim), pa.int32()), pa.array(total)], ["lang", "dim", "value"]
            )

    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    rows = known.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    table = rows.toPandas()
    langs = sorted(table["lang"].unique())
    bundles = np.zeros((len(langs), dim))
    bundles[[langs.index(x) for x in table["lang"]], table["dim"]] = table["value"]
    length = np.linalg.norm(bundles, axis=1)
    langs, bundles = [x for x, n in zip(langs, length, strict=True) if n > 0], bundles[length > 0] / length[length > 0, None]
    if len(langs) > 1:
        bundles = bundles - bundles.mean(axis=0)
        bundles /= np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)
    return langs, bundles.astype(np.float32)


def judged(texts: list[str | None], model: tuple[list[str], np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The nearest language of each text and (1 + cosine) / 2; the first by name of languages equally near."""
    langs, vectors = model
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    own = text_vectors(texts, vectors.shape[1])
    empty, near = ~own.any(axis=1), own @ vectors.T
    names = [UNKNOWN if e else langs[i] for i, e in zip(near.argmax(axis=1), empty, strict=True)]
    return names, np.where(empty, 0.0, np.clip((1 + near.max(axis=1).astype(np.float64)) / 2, 0, 1))


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every document.

    A null text, and one without a letter, is ``und`` with score 0, as is every text if no language was learned.
    Rows are independent; repeated ones get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                names, score = judged(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and give doc_id, held_out, lang_pred and score of all."""
    model = prototypes(docs.where(~held_out(F.col("doc_id"))))
    return identified(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """The documents for which a language is found, whole and with their columns; ``und`` goes."""
    model = prototypes(docs.where(~held_out(F.col("doc_id"))))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                names, _ = judged(part.column(place).to_pylist(), model)
                yield part.filter(pa.array([x != UNKNOWN for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
