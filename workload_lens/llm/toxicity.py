"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

The input of a word is the sum of a hashed word vector and the mean of its hashed character 3-gram vectors, so that new
forms of a word still have a meaning. Two gated recurrent units read a window of words from both ends, attention pools
their states, and a logistic unit scores the window. Windows of 16 words start at every fourth word and at the last
place, so any 13 words in a row lie whole in one of them, wherever they stand. All are scored; the text has the score of
its highest window.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window and from one window to the next.
WINDOW, STEP = 16, 4
#: Bound of the training sample: labelled documents of each class, and windows taken from a document, evenly spaced.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2000, 40
#: Hashed rows of the word and the character table; sizes of an input, of a state in each direction, and of attention.
WORD_ROWS, CHAR_ROWS, INPUT, HIDDEN, ATTEND = 1 << 14, 1 << 12, 16, 8, 8
#: Passes with every window labelled as its document, then with the highest windows of each document only.
PASSES, LAST_PASSES, BATCH, RATE = 2, 8, 256, 0.01
#: Steps of each kind at least; few documents are passed more often.
STEPS = 100
#: Scores from here on are predicted as toxic.
THRESHOLD = 0.3
#: Windows scored at a time in training and in scoring, where they are to fit a core's cache, and words of a worker's memo.
AT_ONCE, CACHED, MEMO = 2048, 512, 300_000

_WORD = re.compile(r"[^\W_]+").findall


def text_words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD((text or "").lower())


def window_starts(n: int) -> list[int]:
    """Starts of all windows of a text of n words; the last one ends with the text, and a short text has one."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are never used: crc32 of the id as text is 2 modulo 4, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the word table, rows of the character table of all words one after another, and where each word starts."""
    rows, grams, starts = [], [], []
    for word in words:
        rows.append(zlib.crc32(word.encode()) % WORD_ROWS)
        starts.append(len(grams))
        edged = f"<{word}>"
        grams += [zlib.crc32(edged[i : i + 3].encode()) % CHAR_ROWS for i in range(max(1, len(edged) - 2))]
    return np.array(rows, np.int64), np.array(grams, np.int64), np.array(starts, np.int64)


def _summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by number, (n, features)."""
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    out = np.zeros((n, values.shape[1]), np.float32)
    out[found] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _halved(x: np.ndarray) -> None:
    """1 / (1 + exp(x)) in place; beyond the range of exp it is 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Network:
    """Parameters, scores and gradients. Shapes are (windows, words, features)."""

    def __init__(self, seed: int = 7):
        make, self.name = np.random.default_rng(seed), uuid.uuid4().hex

        def start(*shape: int, scale: float | None = None) -> np.ndarray:
            return make.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {"word": start(WORD_ROWS, INPUT, scale=0.1), "char": start(CHAR_ROWS, INPUT, scale=0.1)}
        for d in "fb":
            self.p |= {
                f"in_{d}": start(INPUT, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32),
                f"gate_{d}": start(HIDDEN, 2 * HIDDEN), f"new_{d}": start(HIDDEN, HIDDEN),
            }
        self.p |= {
            "att": start(2 * HIDDEN, ATTEND), "att_bias": np.zeros(ATTEND, np.float32), "att_out": start(ATTEND),
            "out": start(2 * HIDDEN), "out_bias": np.zeros(1, np.float32),
        }

    def inputs(self, hashed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        rows, grams, starts = hashed
        sizes = np.diff(np.append(starts, len(grams)))[:, None]
        return self.p["word"][rows] + np.add.reduceat(self.p["char"][grams], starts, axis=0) / sizes

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """What words give to the gates in both directions, (2, words, 3 x HIDDEN)."""
        return np.stack([inputs @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"])

    def forward(self, given: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple:
        """Logits of windows. given: projected words; index: (windows, words) into them; mask: 1 where there is a word."""
        n, words = index.shape
        states = np.empty((n, words, 2 * HIDDEN), np.float32)
        steps: dict[str, list] = {"f": [], "b": []}
        for k, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), np.float32)
            gate, new = self.p[f"gate_{d}"], self.p[f"new_{d}"]
            table = given[k]
            for t in range(words) if d == "f" else range(words - 1, -1, -1):
                x = table.take(index[:, t], axis=0)
                zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ gate)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                rh = r * h
                c = np.tanh(x[:, 2 * HIDDEN :] + rh @ new)
                after = h + z * (c - h)
                if mask is not None:
                    after = np.where(mask[:, t, None] > 0, after, h)
                if keep:
                    steps[d].append((t, h, z, r, c))
                h = after
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
        look = np.tanh(states @ self.p["att"] + self.p["att_bias"])
        weight = look @ self.p["att_out"]
        if mask is not None:
            weight = np.where(mask > 0, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        return pooled @ self.p["out"] + self.p["out_bias"][0], (states, steps, look, weight, pooled)

    def gradients(self, hashed: tuple, index: np.ndarray, mask: np.ndarray, target: np.ndarray, importance: np.ndarray) -> dict:
        inputs = self.inputs(hashed)
        given = self.projected(inputs)
        logit, (states, steps, look, weight, pooled) = self.forward(given, index, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        d_logit = ((_sigmoid(logit) - target) * importance / importance.sum()).astype(np.float32)
        g["out"], g["out_bias"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled[:, None]
        d_weight = (states * d_pooled[:, None]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["att_out"] = np.einsum("nta,nt->a", look, d_score)
        d_look = d_score[:, :, None] * self.p["att_out"] * (1 - look * look)
        g["att"], g["att_bias"] = np.einsum("nth,nta->ha", states, d_look), d_look.sum(axis=(0, 1))
        d_states += d_look @ self.p["att"].T
        d_given = np.zeros_like(given)
        for k, d in enumerate("fb"):
            gate, new = self.p[f"gate_{d}"], self.p[f"new_{d}"]
            back = np.zeros((len(index), HIDDEN), np.float32)
            d_steps = np.empty((*index.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, c in reversed(steps[d]):
                dh = (back + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]) * mask[:, t, None]
                passed = (back + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]) * (1 - mask[:, t, None])
                d_c = dh * z * (1 - c * c)
                d_rh = d_c @ new.T
                d_zr = np.concatenate([dh * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
                g[f"gate_{d}"] += h.T @ d_zr
                g[f"new_{d}"] += (r * h).T @ d_c
                d_steps[:, t] = np.concatenate([d_zr, d_c], axis=1)
                back = passed + dh * (1 - z) + d_rh * r + d_zr @ gate.T
            d_given[k] = _summed(d_steps.reshape(-1, 3 * HIDDEN), index.ravel(), len(given[k]))
        d_inputs = np.zeros_like(inputs)
        for k, d in enumerate("fb"):
            g[f"in_{d}"], g[f"bias_{d}"] = inputs.T @ d_given[k], d_given[k].sum(axis=0)
            d_inputs += d_given[k] @ self.p[f"in_{d}"].T
        rows, grams, starts = hashed
        sizes = np.diff(np.append(starts, len(grams)))
        g["word"] = _summed(d_inputs, rows, WORD_ROWS)
        g["char"] = _summed(np.repeat(d_inputs / sizes[:, None], sizes, axis=0), grams, CHAR_ROWS)
        return g


def windows_of(words: list[str]) -> list[list[str]]:
    return [words[s : s + WINDOW] for s in window_starts(len(words))]


class _Index:
    """Numbers for the words of some windows; 0 is for the places after a short text."""

    def __init__(self, windows: list[list[str]]):
        known: dict[str, int] = {"": 0}
        self.index = np.zeros((len(windows), WINDOW), np.int64)
        self.mask = np.zeros((len(windows), WINDOW), np.float32)
        for i, window in enumerate(windows):
            self.index[i, : len(window)] = [known.setdefault(w, len(known)) for w in window]
            self.mask[i, : max(len(window), 1)] = 1
        self.hashed = _hashed(list(known))

    def batch(self, at: np.ndarray) -> tuple:
        used, index = np.unique(self.index[at], return_inverse=True)
        rows, grams, starts = self.hashed
        sizes = np.diff(np.append(starts, len(grams)))[used]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        own = grams[np.arange(sizes.sum()) + np.repeat(starts[used] - begin, sizes)]
        return (rows[used], own, begin), index.reshape(len(at), WINDOW), self.mask[at]


def train(docs: list[tuple[list[list[str]], int, float]], seed: int = 7) -> Network:
    """A network from documents, each a list of windows, a label 0 or 1, and a weight.

    The first passes give every window its document's label. The last ones take from each document only its highest
    windows, one of a toxic and three of a clean one, so that a toxic document may have clean windows.
    """
    net, make = Network(seed), np.random.default_rng(seed)
    if not docs:
        net.p["out"][:] = 0
        return net
    windows = _Index([w for ws, *_ in docs for w in ws])
    owner = np.repeat(np.arange(len(docs)), [len(ws) for ws, *_ in docs])
    label, importance = np.array([d[1:] for d in docs], np.float32).T
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    passes = max(PASSES, -(-STEPS * BATCH // max(len(owner), BATCH)))
    last = max(LAST_PASSES, -(-STEPS * BATCH // max(2 * len(docs), BATCH)))
    for turn in range(passes + last):
        at = np.arange(len(owner))
        if turn >= passes:
            given = net.projected(net.inputs(windows.hashed))
            logit = np.concatenate([net.forward(given, windows.index[i : i + AT_ONCE], windows.mask[i : i + AT_ONCE])[0] for i in range(0, len(owner), AT_ONCE)])
            order = np.lexsort((-logit, owner))
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner[order])
            at = order[rank < np.where(label[owner[order]] > 0, 1, 3)]
        at = make.permutation(at)
        for i in range(0, len(at), BATCH):
            part = at[i : i + BATCH]
            step += 1
            for k, v in net.gradients(*windows.batch(part), label[owner[part]], importance[owner[part]]).items():
                if k in ("word", "char"):
                    v += 1e-5 * net.p[k]
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
    return net


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> list[tuple[list[list[str]], int, float]]:
    """Windows, label and weight of at most ``size`` documents of each class that are not held out, the first by a hash of the id.

    The weight is the class's share of all labelled documents over its share of the sample.

    Windows are cut where the documents are read, so that a long text costs the driver no more than a short one.
    A document with both labels counts as toxic; null labels and texts are left out. Of several texts under one id the
    smallest is taken.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    population = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        chosen = part if chosen is None else chosen.unionByName(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = []
            for text in batch.column(2).to_pylist():
                found = windows_of(text_words(text))
                take = sorted({round(i) for i in np.linspace(0, len(found) - 1, min(windows, len(found)))})
                out.append([" ".join(found[i]) for i in take])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.string()))], ["doc_id", "toxic", "windows"])

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    joined = joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = joined.mapInArrow(cut, f"doc_id {kind}, toxic int, windows array<string>").collect()
    drawn = Counter(r["toxic"] for r in rows)
    weight = {y: population[y] / n * len(rows) / sum(population.values()) for y, n in drawn.items()}
    return [
        ([w.split(" ") if w else [] for w in r["windows"]], r["toxic"], weight[r["toxic"]])
        for r in sorted(rows, key=lambda r: r["doc_id"])
    ]


class Scorer:
    """Scores texts, and keeps what the words met so far give to the gates.

    Features come before windows here, so that all work on gates is on long rows. Words are laid out by their place
    modulo STEP: what the windows of a stretch read in one step is then a slice.
    """

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.table = np.zeros((0, 2, 3 * HIDDEN), np.float32)
        # With these factors in the weights a sigmoid is 1 / (1 + exp(x)), and a hyperbolic tangent twice that less 1.
        self.factor = np.array([-1] * (2 * HIDDEN) + [-2] * HIDDEN, np.float32)
        self.gate = np.stack([-net.p[f"gate_{d}"].T for d in "fb"])
        self.new = np.stack([-2 * net.p[f"new_{d}"].T for d in "fb"])
        self.look = np.concatenate([-2 * net.p["att"].T, net.p["out"][None]])

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > MEMO:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        new = sorted(set().union([""], *texts).difference(known))  # "" comes first, and so stands at 0
        for w in new:
            known[w] = len(known)
        if new:
            given = self.net.projected(self.net.inputs(_hashed(new))) * self.factor
            first = len(known) - len(new)
            if len(known) > len(self.table):  # room for more, so that the table is not copied for every few words
                self.table = np.concatenate([self.table[:first], np.zeros((len(new) + first // 2, 2, 3 * HIDDEN), np.float32)])
            self.table[first : len(known)] = given.transpose(1, 0, 2)
        return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]

    def _logits(self, ids: np.ndarray) -> np.ndarray:
        """Logits of the whole windows that start at every STEP-th place."""
        n = (len(ids) - WINDOW) // STEP + 1
        words = self.table.take(ids, axis=0).reshape(-1, STEP, 2, 3 * HIDDEN).transpose(1, 2, 3, 0).copy()
        states = np.empty((WINDOW, 2, HIDDEN, n), np.float32)
        h = np.zeros((2, HIDDEN, n), np.float32)
        for t in range(WINDOW):
            given = [words[at % STEP, k, :, at // STEP : at // STEP + n] for k, at in enumerate((t, WINDOW - 1 - t))]
            gates = self.gate @ h
            for k in (0, 1):
                gates[k] += given[k][: 2 * HIDDEN]
            _halved(gates)
            c = self.new @ (gates[:, HIDDEN:] * h)
            for k in (0, 1):
                c[k] += given[k][2 * HIDDEN :]
            _halved(c)
            c *= 2
            c -= 1
            c -= h
            c *= gates[:, :HIDDEN]
            h = h + c
            states[t, 0], states[WINDOW - 1 - t, 1] = h
        looked = self.look @ states.reshape(WINDOW, 2 * HIDDEN, n)
        look = looked[:, :ATTEND] - 2 * self.net.p["att_bias"][:, None]
        _halved(look)
        weight = 2 * self.net.p["att_out"] @ look  # less a constant, which the shares below do not see
        weight = np.exp(weight - weight.max(axis=0))
        return (weight * looked[:, ATTEND]).sum(axis=0) / weight.sum(axis=0) + self.net.p["out_bias"][0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        numbers = self._numbers([text_words(t) for t in texts])
        out = np.full(len(texts), -np.inf, np.float32)
        long = [i for i, x in enumerate(numbers) if len(x) >= WINDOW]
        parts, starts, owner, at = [], [], [], 0
        for i in long:  # each text from a multiple of STEP on, and its last window once more where that is none of its own
            x = numbers[i]
            own = [x, np.zeros(-len(x) % STEP, np.int64)] + ([x[-WINDOW:]] if (len(x) - WINDOW) % STEP else [])
            found = np.arange((len(x) - WINDOW) // STEP + 1) + at // STEP
            parts += own
            at += sum(map(len, own))
            starts.append(np.append(found, (at - WINDOW) // STEP) if len(own) == 3 else found)
            owner.append(np.full(len(starts[-1]), i))
        if long:
            ids = np.concatenate(parts)
            windows = range(0, (len(ids) - WINDOW) // STEP + 1, CACHED)
            logits = np.concatenate([self._logits(ids[w * STEP : (w + CACHED - 1) * STEP + WINDOW]) for w in windows])
            np.maximum.at(out, np.concatenate(owner), logits[np.concatenate(starts)])
        short = np.array([i for i, x in enumerate(numbers) if len(x) < WINDOW], np.int64)
        for at in range(0, len(short), AT_ONCE):
            own = short[at : at + AT_ONCE]
            # Only the rows of their own words: work on the whole table would grow with all that the worker has met.
            used, index = np.unique(np.stack([np.pad(numbers[i], (0, WINDOW - len(numbers[i]))) for i in own]), return_inverse=True)
            plain = np.ascontiguousarray((self.table[used] / self.factor).transpose(1, 0, 2))
            mask = (np.arange(WINDOW) < np.array([max(1, len(numbers[i])) for i in own])[:, None]).astype(np.float32)
            out[own] = self.net.forward(plain, index.reshape(len(own), WINDOW), mask)[0]
        return _sigmoid(out.astype(np.float64))


_SCORERS: dict[str, Scorer] = {}


def _scorer(net: Network) -> Scorer:
    """The scorer of a network in this worker; tasks that follow each other share what it has met."""
    if net.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[net.name] = Scorer(net)
    return _SCORERS[net.name]


def scored(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document; a null text is scored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(net)
        for batch in batches:
            texts = batch.column(1)
            score = np.concatenate([scorer.scores(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def learn_and_score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labels that are not held out, and give doc_id, held_out, score and predicted of all documents.

    Without any label every score is one half.
    """
    net = train(sample(docs, labels.select("doc_id", "toxic")))
    return scored(docs, net, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
