"""Interpolated modified Kneser-Ney model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

1. Tasks count word hashes; the counts meet in shards of the hash range. Each shard is a sorted array
   of hashes with counts, and a word's id is its place among all of them.
2. Tasks count pairs of ids the same way (``BOS`` stands before a text's first word). A pair's shard comes
   from a hash of the pair, so no context, however common, meets in one task. Each shard is a sorted
   array of pairs with counts; the shards' sums by context and by word meet in shards of the id range.
3. For order 3 a pair's id is its place among all pairs, and tasks count triples as (id of the first pair,
   word) the same way, in the shard of the first pair. Each shard is a sorted array of triples with counts; how
   many triples of each count follow a pair lies beside the pairs, and in how many contexts a pair stands meets in
   that pair's shard.
4. Workers map the arrays into memory and score texts batch by batch.

Shards hold about ``SHARD`` entries at any size of corpus, and the driver gets a few numbers of each. The
arrays lie in the folder of ``spark.checkpoint.dir``; where that isn't a local path, workers copy a shard to
an unlinked temporary file and map that. Files are renamed into place, so a repeated task changes nothing.

The model has order 2 or 3. Below the highest order, counts are of distinct contexts; pairs from the beginning, which
nothing stands before, keep their number of times, and a text's first word is scored by its pair. The lowest
order interpolates with 1 / (V + 1), which is also what an unknown word gets. Words are lower-cased runs without white
space; an end follows the last word.

Discounts come from how many entries have count 1 to 4. Where such a number is 0 the formula has no value, and 0.5, 1.0, 1.5 stand
for it; a discount for count k is kept between 0.05 k and 0.95 k, as small corpora can give values outside that would make
probabilities negative or let lower orders vanish.

Defined cases: a null or empty text is one end; without training rows the model is uniform (V = 0,
probability 1); a null doc_id is a training row; repeated rows count as often as they occur; words whose hashes tie are one word
(a chance of 2^-64 a pair); a very long text is hashed in pieces and scored as a whole, in memory; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import U, mix, slices, text_bytes, word_hashes

HELD_OUT, PARTS = 2, 7
SHARD = 2_000_000
#: Entries that a task gathers before it sorts and sends them.
RUN = 4_000_000
END = U(0x5EEDC0DE5EEDC0DE)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % PARTS == HELD_OUT, F.lit(False))


# ---------------------------------------------------------------- arrays on the shared folder

def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def save(folder: str, name: str, array: np.ndarray) -> None:
    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    buffer = io.BytesIO()
    np.save(buffer, array)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        f.write(buffer.getvalue())
    where.move(part, f"{path}/{name}.npy")


@cache
def mapped(folder: str, name: str) -> np.ndarray:
    where, path = _place(folder)
    path = f"{path}/{name}.npy"
    if isinstance(where, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r") if os.path.getsize(path) > 200 else np.load(path)
    with tempfile.NamedTemporaryFile() as copy:
        with where.open_input_stream(path) as f:
            while block := f.read(1 << 22):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


def pack(values: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted distinct integers as differences, and counts beside them; equal bytes stand together for the compressor."""
    delta = np.diff(values.astype(U), prepend=U(0))
    parts = [np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T) for x in (delta, *counts)]
    return zstandard.ZstdCompressor(1).compress(b"".join(x.tobytes() for x in parts))


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = len(raw) // (n + 1)
    out = [np.ascontiguousarray(x.reshape(8, -1).T).view(U)[:, 0] for x in np.split(raw, n + 1)] if size else [np.zeros(0, U)] * (n + 1)
    return [np.cumsum(out[0], dtype=U), *out[1:]]


def merge(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of the counts of equal values over sorted runs."""
    values = np.concatenate([r[0] for r in runs])
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    return [values[first], *(np.add.reduceat(np.concatenate([r[i] for r in runs])[order], first) if len(first) else np.zeros(0, U) for i in range(1, len(runs[0])))]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, int)
    return s[first], np.diff(np.append(first, len(s))).astype(U)


def dealt(shard: np.ndarray, *columns: np.ndarray):
    """(shard, the columns' rows of it) in order of shard; rows keep their order."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
    for a, b in zip(first, [*first[1:], len(shard)]):
        yield int(shard[a]), *(c[order[a:b]] for c in columns)


PACKED = "shard int, blob binary"


def _sent(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


# ---------------------------------------------------------------- texts

def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an END after each text, index of each text's first, of len + 1)."""
    h, first = word_hashes(*text_bytes(texts))
    out = np.insert(h, first[1:], END)
    return out, first + np.arange(len(first))


class Vocabulary:
    """The sorted hashes of all words in shards of the hash range; a word's id is its place."""

    def __init__(self, folder: str, bits: int, sizes: list[int]):
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def __len__(self):
        return int(self.start[-1])

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash. Queries are sorted first, so that each array is read in order."""
        query, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(query), -1, np.int64), np.zeros(len(query), np.int64)
        cuts = np.searchsorted(self.shard(query), np.arange((1 << self.bits) + 1))
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a and self.sizes[s]:
                known = mapped(self.folder, f"words-{s}")
                at = np.minimum(np.searchsorted(known, query[a:b]), len(known) - 1)
                hit = known[at] == query[a:b]
                ids[a:b] = np.where(hit, at + self.start[s], -1)
                counts[a:b] = np.where(hit, mapped(self.folder, f"counts-{s}")[at], 0)
        return ids[back], counts[back]


def count_words(texts: DataFrame, folder: str, shards: int) -> tuple[Vocabulary, int]:
    """Counts all words; returns the vocabulary and the number of tokens."""
    bits = (shards - 1).bit_length()

    def local(batches):
        held, n = [], 0

        def flush():
            values, counts = counted(np.concatenate(held))
            shard = (values >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
            return _sent([(s, pack(v, c)) for s, v, c in dealt(shard, values, counts)])

        for whole in batches:
            for batch in slices(whole, "text"):
                h, _ = tokens(batch.column(0))
                held.append(h)
                n += len(h)
                if n > RUN:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        values, counts = merge([unpack(b.as_py(), 1) for b in table["blob"]])
        save(folder, f"words-{s}", values)
        save(folder, f"counts-{s}", counts.astype(np.int64))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(values)], "total": [int(counts.sum())]})

    rows = texts.mapInArrow(local, PACKED).groupBy("shard").applyInArrow(meet, "shard int, n long, total long").collect()
    sizes = [0] * (1 << bits)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    return Vocabulary(folder, bits, sizes), sum(r["total"] for r in rows)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many entries have count 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw))


def count_pairs(texts: DataFrame, folder: str, vocabulary: Vocabulary, total: int, scratch: Scratch, order: int) -> "Model":
    words = len(vocabulary)
    width = words + 1  # ids 0 .. V - 1, and V for the beginning
    if width * width >= 1 << 64:
        raise ValueError(f"{words} distinct words: a pair of word numbers takes more than 64 bits")
    shards = max(1, -(-total // SHARD))
    spans = max(1, -(-width // SHARD))
    size = -(-width // spans)

    def local(batches):
        held, n = [], 0

        def flush():
            values, counts = counted(np.concatenate(held))
            return _sent([(s, pack(v, c)) for s, v, c in dealt((mix(values) % U(shards)).astype(np.int64), values, counts)])

        for whole in batches:
            for batch in slices(whole, "text"):
                h, first = tokens(batch.column(0))
                ids, _ = vocabulary.lookup(h)
                before = np.roll(ids, 1)
                before[first[:-1]] = words
                held.append(before.astype(U) * U(width) + ids.astype(U))
                n += len(h)
                if n > RUN:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        keys, counts = merge([unpack(b.as_py(), 1) for b in table["blob"]])
        save(folder, f"pairs-{s}", keys)
        save(folder, f"times-{s}", narrow(counts))
        rows = by_context(keys // U(width), counts, size) if order == 2 else []
        # by word: contexts
        word = keys % U(width)
        by_word = merge([[word, np.ones(len(word), U)]])
        for span, *columns in dealt((by_word[0] // U(size)).astype(np.int64), *by_word):
            rows.append((2 * span + 1, pack(*columns)))
        return _rows([*rows, _tally(s, counts)])

    met = scratch.put("met", texts.mapInArrow(local, PACKED).groupBy("shard").applyInArrow(meet, PACKED))
    upper, sizes = tallied(met, shards)
    pairs = Pairs(folder, sizes)
    lower = closed(met, folder, width, size)
    scratch.drop("met")
    levels = [discounts(upper)]
    if order == 3:
        levels = count_triples(texts, vocabulary, pairs, size, scratch)
    return Model(folder, vocabulary, total, pairs, size, levels, discounts(lower[:4]), [lower[0], lower[1], lower[4]])


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _rows(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_sent(rows)])


def _tally(s: int, counts: np.ndarray) -> tuple[int, bytes]:
    return -1, np.array([s, len(counts), *(int((counts == k).sum()) for k in (1, 2, 3, 4))], np.int64).tobytes()


def tallied(met: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """How many entries have count 1 to 4, and the entries of each shard."""
    sizes, n = [0] * shards, np.zeros(4, np.int64)
    for r in met.filter("shard = -1").select("blob").toLocalIterator():
        s, sizes_s, *of = np.frombuffer(r["blob"], np.int64)
        sizes[s] = int(sizes_s)
        n += of
    return n.tolist(), sizes


def by_context(context: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, bytes]]:
    """By context: the sum of counts, and words with a count of one, two, more."""
    one = lambda mask: mask.astype(U)
    sums = merge([[context, counts, one(counts == 1), one(counts == 2), one(counts > 2)]])
    return [(2 * span, pack(*columns)) for span, *columns in dealt((sums[0] // U(size)).astype(np.int64), *sums)]


def closed(met: DataFrame, folder: str, width: int, size: int) -> list[int]:
    """Saves sums by context (even numbers) and contexts by word (odd); returns how many words have 1, 2, 3, 4 and over 2 contexts."""

    def close(table: pa.Table) -> pa.Table:
        k = table["shard"][0].as_py()
        span, kind = divmod(k, 2)
        n = min(size, width - span * size)
        got = merge([unpack(b.as_py(), 1 if kind else 4) for b in table["blob"]])
        at = (got[0] - U(span * size)).astype(np.int64)
        tally = [0] * 5
        if kind:
            contexts = np.zeros(n, np.int64)
            contexts[at] = got[1]
            save(folder, f"contexts-{span}", contexts)
            tally = [int((contexts == j).sum()) for j in (1, 2, 3, 4)] + [int((contexts > 2).sum())]
        else:
            sums = np.zeros((n, 4), np.int64)
            sums[at] = np.stack(got[1:], 1)
            save(folder, f"sums-{span}", sums)
        return pa.table({"shard": pa.array([k], pa.int32()), **{f"n{i}": [x] for i, x in enumerate(tally, 1)}})

    rows = met.filter("shard >= 0").groupBy("shard").applyInArrow(close, "shard int, n1 long, n2 long, n3 long, n4 long, n5 long").collect()
    return [sum(r[f"n{i}"] for r in rows if r["shard"] % 2) for i in range(1, 6)]


class Pairs:
    """The distinct pairs in shards of their hash; a pair's id is its place, shard after shard."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes
        self.start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def __len__(self):
        return int(self.start[-1])

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) % U(len(self.sizes))).astype(np.int64)

    def find(self, keys: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
        """(id or -1, and of each array named its value or 0) of sorted distinct pairs."""
        ids, *out = np.full(len(keys), -1, np.int64), *(np.zeros((len(keys), 3) if name == "after" else len(keys), np.int64) for name in names)
        for s, at in dealt(self.shard(keys), np.arange(len(keys))):
            if self.sizes[s]:
                known = mapped(self.folder, f"pairs-{s}")
                where = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                hit = known[where] == keys[at]
                at, where = at[hit], where[hit]
                ids[at] = where + self.start[s]
                for x, name in zip(out, names):
                    x[at] = mapped(self.folder, f"{name}-{s}")[where]
        return ids, *out

    def triples(self, keys: np.ndarray, width: int) -> np.ndarray:
        """How often triples (pair id * width + word), sorted and distinct, occur."""
        out = np.zeros(len(keys), np.int64)
        for s, at in dealt(np.searchsorted(self.start, (keys // U(width)).astype(np.int64), "right") - 1, np.arange(len(keys))):
            known = mapped(self.folder, f"triples-{s}")
            if len(known):
                where = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                out[at] = np.where(known[where] == keys[at], mapped(self.folder, f"often-{s}")[where], 0)
        return out


def count_triples(texts: DataFrame, vocabulary: Vocabulary, pairs: Pairs, size: int, scratch: Scratch) -> list[tuple[float, float, float]]:
    """Counts triples, and the contexts of pairs; returns the discounts of triples and of pairs."""
    words, folder, shards = len(vocabulary), pairs.folder, len(pairs.sizes)
    width = words + 1
    if len(pairs) * width >= 1 << 64:
        raise ValueError("too many pairs for 64-bit triples")

    def local(batches):
        held, n = [], 0

        def flush():
            values, counts = counted(np.concatenate(held))
            cuts = np.searchsorted(values, pairs.start[1:-1].astype(U) * U(width))
            return _sent([(s, pack(v, c)) for s, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts))) if len(v)])

        for whole in batches:
            for batch in slices(whole, "text"):
                h, first = tokens(batch.column(0))
                ids, _ = vocabulary.lookup(h)
                before = np.roll(ids, 1)
                before[first[:-1]] = words
                query, back = np.unique(before.astype(U) * U(width) + ids.astype(U), return_inverse=True)
                place = np.roll(pairs.find(query)[0][back], 1)
                later = np.ones(len(ids), bool)
                later[first[:-1]] = False
                held.append(place[later].astype(U) * U(width) + ids[later].astype(U))
                n += len(h)
                if n > RUN:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        keys, counts = merge([unpack(b.as_py(), 1) for b in table["blob"]])
        save(folder, f"triples-{s}", keys)
        save(folder, f"often-{s}", narrow(counts))
        left = (keys // U(width)).astype(np.int64) - pairs.start[s]
        after = [np.bincount(left[mask], minlength=pairs.sizes[s]) for mask in (counts == 1, counts == 2, counts > 2)]
        save(folder, f"after-{s}", narrow(np.stack(after, 1)))
        rows = []
        if len(keys):
            right, contexts = counted((mapped(folder, f"pairs-{s}")[left] % U(width)) * U(width) + keys % U(width))
            for k, right, contexts in dealt(pairs.shard(right), right, contexts):
                rows.append((k, pack(np.searchsorted(mapped(folder, f"pairs-{k}"), right), contexts)))
        return _rows([*rows, _tally(s, counts)])

    def adjust(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        if not pairs.sizes[s]:
            return _rows([])
        known, times = (mapped(folder, f"{name}-{s}") for name in ("pairs", "times"))
        at, contexts = merge([unpack(b.as_py(), 1) for b in table["blob"]])
        context = known // U(width)
        adjusted = np.where(context == U(words), times, 0).astype(U)
        adjusted[at.astype(np.int64)] = contexts
        save(folder, f"adjusted-{s}", narrow(adjusted))
        return _rows([*by_context(context, adjusted, size), _tally(s, adjusted)])

    # every shard has a row, so that each is written
    empty = texts.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(bytearray(pack(np.zeros(0, U), np.zeros(0, U)))).alias("blob"))
    met = scratch.put("triples", texts.mapInArrow(local, PACKED).union(empty).groupBy("shard").applyInArrow(meet, PACKED))
    highest, _ = tallied(met, shards)
    sums = scratch.put("sums", met.filter("shard >= 0").union(empty).groupBy("shard").applyInArrow(adjust, PACKED))
    scratch.drop("triples")
    middle, _ = tallied(sums, shards)
    closed(sums, folder, width, size)
    scratch.drop("sums")
    return [discounts(highest), discounts(middle)]


class Model:
    """What a worker needs to score: names of arrays, and a few numbers. ``levels``: discounts from the highest order to pairs."""

    def __init__(self, folder, vocabulary, total, pairs, size, levels, lower, n_lower):
        self.folder, self.vocabulary, self.total, self.pairs, self.size = folder, vocabulary, total, pairs, size
        self.levels, self.lower, self.n_lower = [np.array([0.0, *d]) for d in levels], np.array([0.0, *lower]), n_lower

    def by_id(self, name: str, ids: np.ndarray, width: int | None = None) -> np.ndarray:
        """Rows of a dense array in spans, for ids >= 0; 0 for others."""
        out = np.zeros(len(ids) if width is None else (len(ids), width), np.int64)
        for span, at in dealt(np.where(ids < 0, -1, ids // self.size), np.arange(len(ids))):
            if span >= 0:
                out[at] = mapped(self.folder, f"{name}-{span}")[ids[at] - span * self.size]
        return out

    def probabilities(self, ids: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(word | words before) for ids, -1 for unknown words; V as the word before stands for the beginning, at the places ``first``."""
        v = len(self.vocabulary)
        n_pairs = len(self.pairs)
        if not n_pairs:
            return np.full(len(ids), 1.0 / (v + 1))
        word, back = np.unique(ids, return_inverse=True)
        contexts = self.by_id("contexts", word)
        free = sum(d * n for d, n in zip(self.lower[1:], self.n_lower)) / n_pairs
        low = ((contexts - self.lower[np.minimum(contexts, 3)]) / n_pairs + free / (v + 1))[back]
        context, back = np.unique(before, return_inverse=True)
        sums = self.by_id("sums", context, 4)
        upper = self.levels[-1]
        gamma = (sums[:, 1:] @ upper[1:]) / np.maximum(sums[:, 0], 1)
        seen = (sums[:, 0] > 0)[back]
        both = np.flatnonzero((ids >= 0) & seen)
        query, pair = np.unique(before[both].astype(U) * U(v + 1) + ids[both].astype(U), return_inverse=True)
        place, times, *rest = self.pairs.find(query, *(["times"] if len(self.levels) == 1 else ["adjusted", "times", "after"]))
        counts = np.zeros(len(ids), np.int64)
        counts[both] = times[pair]
        high = (counts - upper[np.minimum(counts, 3)]) / np.maximum(sums[:, 0], 1)[back]
        p = np.where(seen, high + gamma[back] * low, low)
        if len(self.levels) == 1:
            return p
        # the pair before each word that has two before it, where it is known: its place among the query
        upper, (raw, after) = self.levels[0], rest
        left = np.full(len(ids), -1, np.int64)
        left[both] = np.where(place >= 0, np.arange(len(query)), -1)[pair]
        left = np.roll(left, 1)
        left[first] = -1
        at = np.flatnonzero(left >= 0)
        left, gamma = left[at], (after @ upper[1:]) / np.maximum(raw, 1)
        counts = np.zeros(len(at), np.int64)
        known = ids[at] >= 0
        query, back = np.unique(place[left[known]].astype(U) * U(v + 1) + ids[at[known]].astype(U), return_inverse=True)
        counts[known] = self.pairs.triples(query, v + 1)[back]
        p[at] = (counts - upper[np.minimum(counts, 3)]) / raw[left] + gamma[left] * p[at]
        return p

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base_score, score) of each text."""
        h, first = tokens(texts)
        ids, counts = self.vocabulary.lookup(h)
        before = np.roll(ids, 1)
        before[first[:-1]] = len(self.vocabulary)
        by_text = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0, x.dtype)
        base = np.log10((counts + 1) / (self.total + len(self.vocabulary) + 1))
        return np.diff(first), by_text((counts > 0).astype(np.int64)), by_text(base), by_text(np.log10(self.probabilities(ids, before, first[:-1])))


@contextmanager
def shuffles_end(spark: SparkSession):
    """Each query's shuffle files are removed when it ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def train(texts: DataFrame, shards: int, order: int = 2) -> "Model":
    """Counts the column ``text`` of all rows. ``shards``: of the word counts, about one for each SHARD tokens."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    scratch = Scratch(texts.sparkSession, "lm")
    folder = f"{scratch.path}/model"
    with shuffles_end(texts.sparkSession):
        texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
        vocabulary, total = count_words(texts, folder, shards)
        if total:
            return count_pairs(texts, folder, vocabulary, total, scratch, order)
    return Model(folder, vocabulary, 0, Pairs(folder, []), 1, [(0.5, 1.0, 1.5)] * (order - 1), (0.5, 1.0, 1.5), [0, 0, 0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""

    def batches(rows):
        for whole in rows:
            for batch in slices(whole, "text"):
                n, known, base, full = model.score(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.total, np.int64)), pa.array(base), pa.array(full)],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(batches, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str, order: int = 2) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    learned = docs.filter(~held_out(F.col("doc_id")))
    bytes_ = learned.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    scored = score(docs, train(learned, max(1, bytes_ // (6 * SHARD)), order))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
