"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features in cycles: a shallow tree
(at most four leaves) on one feature's bins is fitted to the gradient of the logistic loss and added,
damped, to that feature's lookup table. Then the pairs that explain most of the rest get tables of
their own by the same cycles. A score is an intercept plus a table entry for each feature and pair.

Features come from the text alone, in numpy over whole Arrow batches. Labels are learned from rows
whose crc32(doc_id) mod 4 is not 2, at most ``TRAIN_ROWS`` of them in order of a hash of doc_id (a
documented bound: only these texts are met in training; all texts are scored).

Defined cases: null and empty texts have all features 0 and get the score of that bin; without labels
(or labels of one value) every score is the smoothed share of label 1, 0.5 if there are none; a
doc_id with several labels counts as its smallest; rows that repeat are scored alike; trees that tie split at the first bin; words
of a very long text are handled as a whole, in memory; an empty table gives an empty result; other columns are not read by ``score``
and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._joins import map_batches
from ._words import gram_hashes, slices, text_bytes, word_hashes

HELD_OUT = 2
THRESHOLD = 0.7
TRAIN_ROWS = 12_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
FEATURES = (
    "log_words", "chars_per_word", "upper", "digits", "symbols", "bangs", "bars", "dots", "commas",
    "words_per_line", "distinct_words", "top_word", "distinct_trigrams", "distinct_lines", "braces", "quotes",
)

_CLASS = np.zeros(256, np.int64)
for _i, _group in enumerate((bytes(range(65, 91)), b"0123456789", b"#*$%&<>~^@", b"!?", b"|", b".", b",", b"{}[]()=;_/\\", b"\"'`", b"\n", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_group)] = _i
_N = 12


def features(texts: pa.Array) -> np.ndarray:
    """A float32 row of FEATURES for each text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    counts = np.bincount(doc * _N + _CLASS[data], minlength=n * _N).reshape(n, _N).astype(float) if n else np.zeros((0, _N))
    h, first = word_hashes(data, offsets)
    words = np.diff(first)
    inked = np.maximum(size - counts[:, 10] - counts[:, 11] * 1.0, 0)
    distinct, top, trigrams, lines = np.ones(n), np.zeros(n), np.ones(n), np.ones(n)
    grams = gram_hashes(h, 3)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            s = np.sort(h[a:b])
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            distinct[i] = (len(starts) - 1) / (b - a)
            top[i] = np.diff(starts).max() / (b - a)
        if b - a > 3:
            s = np.sort(grams[a : b - 2])
            trigrams[i] = (1 + np.count_nonzero(s[1:] != s[:-1])) / len(s)
        if counts[i, 10]:
            parts = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            lines[i] = len(set(parts)) / len(parts)
    per = lambda x: x / np.maximum(inked, 1)
    out = np.stack(
        [
            np.log1p(words), inked / np.maximum(words, 1), per(counts[:, 1]), per(counts[:, 2]), per(counts[:, 3]), per(counts[:, 4]), per(counts[:, 5]), per(counts[:, 6]), per(counts[:, 7]),
            np.log1p(words / (1 + counts[:, 10])), distinct, top, trigrams, lines, per(counts[:, 8]), per(counts[:, 9]),
        ], 1,
    )
    out[words == 0] = 0
    return out.astype(np.float32)


# ---------------------------------------------------------------- the model

def _gain(g, h, penalty):
    return g * g / (h + penalty)


def _best_cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """(gain, first bin on the right) of the best cut of ordered bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl, penalty) + _gain(g.sum() - gl, h.sum() - hl, penalty) - _gain(g.sum(), h.sum(), penalty)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    cuts = {0, len(g)}
    gain, at = _best_cut(g, h, penalty)
    if gain > 0:
        cuts.add(at)
        for a, b in ((0, at), (at, len(g))):
            gain, cut = _best_cut(g[a:b], h[a:b], penalty)
            if gain > 0:
                cuts.add(a + cut)
    cuts = sorted(cuts)
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(gain, values) of a tree on two features: the better first feature is cut once, each side is cut along the other."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            total, out = 0.0, np.zeros_like(a)
            for rows in (slice(0, cut), slice(cut, len(a))):
                gs, hs = a[rows].sum(0), b[rows].sum(0)
                gain, at = _best_cut(gs, hs, penalty)
                total += _gain(gs.sum(), hs.sum(), penalty) + gain
                for cols in (slice(0, at), slice(at, len(gs))):
                    out[rows, cols] = -gs[cols].sum() / (hs[cols].sum() + penalty)
            total -= _gain(g.sum(), h.sum(), penalty)
            if total > best[0]:
                best = (total, out.T if turn else out)
    return best


class Model:
    """Bin edges, a table for each feature, tables for pairs, an intercept."""

    def __init__(self, edges, tables, coarse, pairs, intercept):
        self.edges, self.tables, self.coarse, self.pairs, self.intercept = edges, tables, coarse, pairs, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.intercept)
        for i, (edges, of) in enumerate(zip(self.edges, self.tables)):
            total += of[np.searchsorted(edges, x[:, i], "right")]
        if self.pairs:
            used = {k for i, j, _ in self.pairs for k in (i, j)}
            bins = {k: np.searchsorted(self.coarse[k], x[:, k], "right") for k in used}
            for i, j, of in self.pairs:
                total += of[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, n) / n, method="lower")).astype(np.float32) if len(x) else np.zeros(0, np.float32)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Model:
    n, m = x.shape
    mean = (y.sum() + 1) / (n + 2)
    start = float(np.log(mean / (1 - mean)))
    edges = [_edges(x[:, i], BINS) for i in range(m)]
    coarse = [_edges(x[:, i], PAIR_BINS) for i in range(m)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(edges, tables, coarse, [], start)
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    total = np.full(n, start)

    def gradient():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(m):
            g, h = gradient()
            k = len(tables[i])
            step = RATE * _tree(np.bincount(bins[i], g, k), np.bincount(bins[i], h, k), penalty)
            tables[i] += step
            total += step[bins[i]]
    small = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]

    def grid(i, j, g, h):
        at, k = small[i] * sizes[j] + small[j], sizes[i] * sizes[j]
        return np.bincount(at, g, k).reshape(sizes[i], -1), np.bincount(at, h, k).reshape(sizes[i], -1)

    g, h = gradient()
    ranked = sorted(((_pair_tree(*grid(i, j, g, h), penalty)[0], i, j) for i in range(m) for j in range(i) if sizes[i] > 1 and sizes[j] > 1), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, of in model.pairs:
            g, h = gradient()
            step = RATE * _pair_tree(*grid(i, j, g, h), penalty)[1]
            of += step
            total += step[small[i], small[j]]
    return model


# ---------------------------------------------------------------- operator

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _feature_batches(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            x = features(batch.column(1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values, batch.column(2)], names=["doc_id", "x", "quality"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on the labelled documents outside the held-out rows; at most ``rows`` labels, broadcast to the texts."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "quality")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    # one text for each sampled label, so that what reaches the driver is bounded by ``rows``
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = got.mapInArrow(_feature_batches, f"doc_id {kind}, x array<float>, quality int").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, got["quality"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def batches(rows):
        for whole in rows:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are."""
    where = docs.columns.index("text")

    def batches(rows):
        for whole in rows:
            for batch in slices(whole, f"c{where}"):
                yield batch.filter(pa.array(model.score(features(batch.column(where))) >= threshold))

    return map_batches(docs, batches)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
