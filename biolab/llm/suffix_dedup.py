"""Suffix-array dedup: remove every byte in a 50-byte string that also starts in an earlier document.

Texts are cut into fragments so that equal 50-byte strings always meet: a string's key is the least hash
among its 20-byte grams, which depends on the string alone, and neighbouring strings with one key
form a fragment. Documents are dealt to buckets by a hash of doc_id.

1. The keys alone are counted; only fragments whose key at least two documents hold go on.
2. A bucket keeps each of its distinct fragments once, and a list of the places. Of the fragments only (key, hash, least
   doc_id) meet others. A place in a document after a fragment's least one is covered as a whole.
3. What is left are strings that different fragments of one key share. Each distinct fragment of a key that has several is
   sent once, from the bucket of its least document, to a shard, which streams it to disk. There the suffix sorter
   (``external_suffix``: external induced sorting with disk-backed queues, recursion and common-prefix values) puts equal
   strings side by side, and the smallest least document of each run decides which strings of the others are covered.

So a passage, however many documents have it, reaches a shard once. Bucket and shard numbers follow the size of the
input. A shard that is larger all the same, as for a very common key, is sorted in the same memory: about ``BUDGET`` entries
of text, queues and result are in memory, the rest lies in a temporary folder of the worker, which is removed at the end.

Documents that equal an earlier one as a whole are settled first and not cut up: all their bytes are covered if they
have 50.

Defined cases: a null text is empty; texts under 50 bytes lose nothing and take nothing; matches don't cross documents;
very long texts are hashed as a whole, some 60 bytes of memory for each of their bytes; rows that repeat a doc_id with different
texts are rows of one document: each is cut by what earlier documents have, not by one another; rows equal in both lose the same; rows
with a null doc_id lose nothing and take nothing; ties are settled by the smallest doc_id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import BYTE, U, inverse_powers, mix, powers, slices, text_bytes
from .external_suffix import Column, Queue, sort_text, starts_of

KEY = ["doc_id", "tid"]
WIDTH = 50
GRAM = 20
KEY_BITS = 56
#: Bytes of text that a bucket of documents holds, about, and bytes of fragments that a shard holds.
BUCKET = 8 << 20
SHARD = 8 << 20
#: Entries of each array that a sorter holds in memory; a shard has about 16 times as many characters, or far more.
BUDGET = 1 << 19
#: Bytes of text that are hashed at once; each takes some 60 bytes of memory.
SLICE = 1 << 20
RUN = 1_000_000
#: Up to so many rows of ids or hashes (at most 120 bytes each, 30 MB) are broadcast; beyond it those joins shuffle.
BROADCAST_ROWS = 250_000
#: Parts that the rows of one text are dealt to where they meet their first document.
SALTS = 8
#: Fragments between two entries of a shard's index in memory.
STRIDE = 4096
PACKED = "at int, blob binary"


def window_keys(data: np.ndarray) -> np.ndarray:
    """The key of each WIDTH-byte string of the bytes: the least hash of its grams."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum(BYTE[data] * powers(n)[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * inverse_powers(n)[: n - GRAM + 1])
    span = WIDTH - GRAM + 1
    step = 1
    while 2 * step <= span:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < span:
        h = np.minimum(h[: -(span - step)], h[span - step :])
    return mix(h) >> U(64 - KEY_BITS)


def fragments(data: np.ndarray, offsets: np.ndarray):
    """(key, text number, first string, end of strings) of each run of strings with one key within a text."""
    keys = window_keys(data)
    n = len(keys)
    if not n:
        return (np.zeros(0, U), *(np.zeros(0, np.int64),) * 3)
    size = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = keys[1:] != keys[:-1]
    edge[np.minimum(offsets, n)] = True
    edge[np.minimum(offsets[:-1] + size, n)] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], n)
    text = np.searchsorted(offsets, starts, "right") - 1
    ok = starts < offsets[text] + size[text]
    return keys[starts[ok]], text[ok], starts[ok], ends[ok]


def planes(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as compressed byte planes."""
    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(c.astype(np.int64)).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns))


def unplaned(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return [np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64)[:, 0] if len(x) else np.zeros(0, np.int64) for x in np.split(raw, n)]


def dealt(where: np.ndarray, *columns: np.ndarray):
    order = np.argsort(where, kind="stable")
    where = where[order]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else np.zeros(0, int)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(where)]):
        yield int(where[a]), *(c[order[a:b]] for c in columns)


def packed(rows) -> pa.Table:
    rows = list(rows)
    return pa.table({"at": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def joined(table: pa.Table, n: int) -> list[np.ndarray]:
    parts = [unplaned(b.as_py(), n) for b in table["blob"]]
    return [np.concatenate([p[i] for p in parts]) for i in range(n)] if parts else [np.zeros(0, np.int64)] * n


def _bucket(ids: np.ndarray, texts: np.ndarray, buckets: int) -> np.ndarray:
    """By doc_id and text, so that texts of one doc_id spread too."""
    return (mix(mix(ids.view(U)) ^ texts.view(U)) % U(buckets)).astype(np.int64)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(data) + 1, U)
    np.cumsum(mix(np.arange(256, dtype=U) + U(salt))[data] * powers(len(data) or 1)[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse_powers(len(data) + 1)[starts] + (ends - starts).astype(U))


class Shard:
    """The distinct fragments of a shard, on disk: their text, each behind a separator, and what is known of each."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget, self.step = folder, budget, max(budget // 4, 1)
        self.text = Column(folder, "<u2")
        self.begin, self.end, self.least, self.home, self.number = (Column(folder, "<i8") for _ in range(5))
        self.sparse: list[np.ndarray] = []  # the first place of every STRIDE-th fragment

    def add(self, least: np.ndarray, size: np.ndarray, home: np.ndarray, number: np.ndarray, data: np.ndarray) -> None:
        length = size + 1
        begin = np.cumsum(length) - length
        text = np.zeros(int(length.sum()), np.uint16)
        inside = np.ones(len(text), bool)
        inside[begin] = False
        text[inside] = data
        text[inside] += np.uint16(1)
        begin += self.text.n
        first = -self.begin.n % STRIDE
        self.sparse.append(begin[first::STRIDE])
        self.begin.append(begin)
        self.end.append(begin + length)
        for column, values in ((self.least, least), (self.home, home), (self.number, number)):
            column.append(values)
        self.text.append(text)

    def find(self, pos: np.ndarray) -> np.ndarray:
        """The number of the fragment that each position lies in."""
        sparse = self.sparse[0] if len(self.sparse) == 1 else np.concatenate(self.sparse)
        self.sparse = [sparse]
        order = np.argsort(pos)
        pos = pos[order]
        block = np.searchsorted(sparse, pos, "right") - 1
        out = np.empty(len(pos), np.int64)
        head = starts_of(block)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(pos)]):
            k = int(block[a]) * STRIDE
            out[order[a:b]] = np.searchsorted(self.begin.read(k, k + STRIDE), pos[a:b], "right") - 1 + k
        return out

    def covered(self):
        """(home, number, start, end) of the maximal runs of each fragment that are covered by WIDTH-byte strings which another
        fragment of a document smaller than its own least one has."""
        hits = Queue(self.folder, self.step)
        place = np.dtype("<i8")
        spill, state = None, None  # members of a run of equal strings that goes on past a batch, and its least document

        def hit(pos: np.ndarray) -> None:
            where = pos // self.step
            order = np.argsort(where, kind="stable")
            head = starts_of(where[order])
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(pos)]):
                hits.push(int(where[order[a]]), pos[order[a:b]])

        def close() -> None:
            nonlocal spill, state
            for a in range(0, spill[0].n, self.step):
                pos, least = (c.read(a, a + self.step) for c in spill)
                hit(pos[least > state])
            for c in spill:
                c.drop()
            spill = state = None

        def take(pos: np.ndarray, lcp: np.ndarray) -> None:
            """A batch of the suffix array: runs of a common prefix of WIDTH bytes are equal strings."""
            nonlocal spill, state
            for a in range(0, len(pos), self.step):
                take_some(pos[a : a + self.step], lcp[a : a + self.step])

        def take_some(pos, lcp):
            nonlocal spill, state
            joins = lcp >= WIDTH  # a string cut off by its fragment's end has a separator in it, and so does what equals it
            if spill is not None and not joins[0]:
                close()
            alone = ~joins
            alone[:-1] &= ~joins[1:]
            alone[-1] = False  # it may go on in the next batch
            some = np.flatnonzero(~alone)
            pos, joins = pos[some].astype(np.int64), joins[some]
            frag = self.find(pos)
            least = self.least.take(frag)
            full = (self.end.take(frag) - pos >= WIDTH) & (pos > self.begin.take(frag))  # a whole string, not from the separator on
            head = np.flatnonzero(~joins)
            if len(pos) and (not len(head) or head[0]):
                head = np.concatenate(([0], head))
            small = np.minimum.reduceat(least, head)
            bounds = np.append(head[1:], len(pos))
            if spill is not None:
                state = min(state, int(small[0]))
                spill[0].append(pos[: bounds[0]][full[: bounds[0]]])
                spill[1].append(least[: bounds[0]][full[: bounds[0]]])
                if len(head) > 1:
                    close()
                done = 1
            else:
                done = 0
            if len(head) > done:
                a, b = bounds[done - 1] if done else 0, head[-1]
                inside = slice(a, b)
                first = np.repeat(small[done:-1], np.diff(head[done:]))
                hit(pos[inside][(first < least[inside]) & full[inside]])
                spill = (Column(self.folder, place), Column(self.folder, place))
                spill[0].append(pos[b:][full[b:]])
                spill[1].append(least[b:][full[b:]])
                state = int(small[-1])

        sort_text(self.text, 257, WIDTH, self.folder, self.budget, take)
        if spill is not None:
            close()
        held = None  # the last run, which may go on
        for k in range(self.text.n // self.step + 1):
            parts = []
            while (part := hits.pop(k, self.step, place)) is not None:
                parts.append(part)
            if not parts:
                continue
            pos = np.sort(np.concatenate(parts))
            frag = self.find(pos)
            new = np.concatenate(([True], (frag[1:] != frag[:-1]) | (pos[1:] > pos[:-1] + WIDTH)))
            head = np.flatnonzero(new)
            run = [frag[head], pos[head], pos[np.append(head[1:], len(pos)) - 1] + WIDTH]
            if held is not None:
                if held[0] == run[0][0] and run[1][0] <= held[2]:
                    run[1][0] = held[1]
                else:
                    run = [np.concatenate(([x], y)) for x, y in zip(held, run)]
            held = [int(x[-1]) for x in run]
            yield self.placed(*(x[:-1] for x in run))
        if held is not None:
            yield self.placed(*(np.array([x]) for x in held))

    def placed(self, frag, start, end):
        begin = self.begin.take(frag) + 1  # behind the separator
        return self.home.take(frag), self.number.take(frag), start - begin, end - begin


def row_numbers(doc: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """A number for each distinct (doc, tid), from 0."""
    order = np.lexsort((tid, doc))
    doc, tid = doc[order], tid[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]))))
    return out


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Maximal runs of the intervals of each doc."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = int(end.max()) + 1 if len(end) else 1
    number = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    far = np.maximum.accumulate(number * wide + end) - number * wide  # furthest end so far within the doc
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])))
    head = np.flatnonzero(new)
    return doc[head], start[head], far[np.append(head[1:], len(doc)) - 1]


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tid) of every row; what is removed from a row goes by doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))


def picked(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``texts`` whose doc_id and text are (left_semi) or aren't (left_anti) among ``ids``."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, KEY, how).select(*texts.columns)


def copies_marked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``copy``: whether a smaller doc_id has the same text. Only texts that occur twice are joined back.

    Beyond the broadcast bound the join is salted: each text's row stands once for each of SALTS parts of its copies.
    """
    first = rows.filter("doc_id is not null").groupBy("sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = scratch.put("first", first.filter("n > 1").drop("n"))
    if first.count() <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(first), "sha256", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha256", "salt"], "left")
    return both.select(*rows.columns, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables. (doc_id, tid, n_bytes, sha256, copy) of all rows, ``copy`` telling whether an earlier document has the same
    text, and (doc_id, tid, starts, ends) of the covered runs of rows that are not copies. ``tid``: a hash of the text."""
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = identified(docs)
    rows = scratch.put("rows", docs.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")))
    rows = scratch.put("all", copies_marked(rows, scratch))
    scratch.drop("rows", "first")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = shards = int(total // BUCKET) + 1
    copies = scratch.put("copies", rows.filter("copy").select(*KEY).distinct())
    texts = picked(docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WIDTH)), copies, "left_anti")

    def keys(batches):
        """Each run's keys once for each bucket, with the least and the largest document there, to the shards of the keys."""
        held, n = [], 0

        def flush():
            key, doc, home = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, home, key))
            key, doc, home = key[order], doc[order], home[order]
            head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (home[1:] != home[:-1]))))
            tail = np.append(head[1:], len(key)) - 1
            key, least, most, home = key[head], doc[head], doc[tail], home[head]
            return packed((s, planes(np.diff(k, prepend=0), a, b - a, h)) for s, k, a, b, h in dealt(key % shards, key, least, most, home)).to_batches()

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                key, text, _, _ = fragments(*text_bytes(batch.column(1)))
                ids = batch.column(0).to_numpy()
                held.append((key.astype(np.int64), ids[text], _bucket(ids, batch.column(2).to_numpy(), buckets)[text]))
                n += len(key)
                if n > RUN:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def shared(table: pa.Table) -> pa.Table:
        """Keys that two documents hold, to the buckets of the documents."""
        parts = [unplaned(b.as_py(), 4) for b in table["blob"]]
        key, least, more, home = np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order = np.argsort(key, kind="stable")
        key, least, most, home = key[order], least[order], (least + more)[order], home[order]
        head = starts_of(key)
        twice = np.repeat(np.minimum.reduceat(least, head) != np.maximum.reduceat(most, head), np.diff(np.append(head, len(key))))
        return packed((g, planes(k)) for g, k in dealt(home[twice], key[twice]))

    def cut(found: pa.Table, text: pa.Table) -> pa.Table:
        """A bucket's fragments with a shared key: each distinct one once, and where they occur."""
        wanted = np.unique(joined(found, 1)[0])
        got, bodies, at_byte = [], [], 0
        if len(wanted):
            seen: set[tuple[int, int]] = set()
            for whole in text.select(["doc_id", "text", "tid"]).to_batches():
                for batch in slices(whole, "text", SLICE):
                    ids, tids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                    again = np.array([i in seen or seen.add(i) for i in zip(ids.tolist(), tids.tolist())], bool)
                    data, offsets = text_bytes(batch.column(1))
                    key, number, a, b = fragments(data, offsets)
                    key = key.astype(np.int64)
                    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    keep = (wanted[at] == key) & ~again[number]
                    key, number, a, b = key[keep], number[keep], a[keep], b[keep] + WIDTH - 1
                    h = _hash(data, a, b, 11).view(np.int64)
                    by = np.lexsort((h, key))
                    one = np.sort(by[np.union1d(starts_of(key[by]), starts_of(h[by]))])
                    where = np.full(len(key), -1, np.int64)
                    size = (b - a)[one]
                    where[one] = at_byte + np.cumsum(size) - size
                    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    bodies.append(data[np.repeat(a[one], size) + inner])
                    at_byte += int(size.sum())
                    got.append((key, h, ids[number], tids[number], a - offsets[number], b - a, where))
        if not at_byte:
            return pa.table({"at": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("head", "places", "body")}})
        key, h, doc, tid, off, size, where = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((where < 0, h, key))
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])))
        head = order[new]
        kind = np.empty(len(key), np.int64)
        kind[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        data, size_of, start = np.concatenate(bodies), size[head], where[head]
        body = b"".join(data[x : x + n].tobytes() for x, n in zip(start.tolist(), size_of.tolist()))
        blobs = planes(key[head], h[head], least, size_of), planes(doc, tid, off, kind), zstandard.ZstdCompressor(1).compress(body)
        return pa.table({"at": pa.array([text["at"][0].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("head", "places", "body"), blobs)}})

    def heads(batches):
        """The buckets' distinct fragments, without their text, to the shards of their keys."""
        for batch in batches:
            rows = []
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, h, least, size = unplaned(blob.as_py(), 4)
                rows += [(s, planes(*x, np.full(len(x[0]), at))) for s, *x in dealt(key % shards, key, h, least, size, np.arange(len(key)))]
            yield from packed(rows).to_batches()

    def meet(table: pa.Table) -> pa.Table:
        """Which document is the least one of a fragment, to the buckets that have it; which bucket is to send its text: the
        least one's, if its key has another fragment. ``n``: bytes that will be sent."""
        key, h, least, size, number, home = joined(table, 6)
        order = np.lexsort((least, h, key))
        key, h, least, size, number, home = (x[order] for x in (key, h, least, size, number, home))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
        first = least[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        head = starts_of(key)
        several = np.repeat(np.add.reduceat(new.astype(np.int64), head) > 1, np.diff(np.append(head, len(key))))
        sends = new & several
        keep = np.flatnonzero(sends | (first != least))
        rows = [(g, planes(*x[:3]), int(x[3].sum())) for g, *x in dealt(home[keep], number[keep], first[keep], sends[keep], np.where(sends, size, 0)[keep])]
        return pa.table({"at": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})

    def bucket_of(batches):
        for batch in batches:
            home = _bucket(batch.column(0).to_numpy(), batch.column(2).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], names=["doc_id", "text", "tid", "at"])

    hot = scratch.put("keys", texts.mapInArrow(keys, PACKED).groupBy("at").applyInArrow(shared, PACKED))
    placed = texts.mapInArrow(bucket_of, "doc_id long, text string, tid long, at int")
    pieces = scratch.put("pieces", hot.groupBy("at").cogroup(placed.groupBy("at")).applyInArrow(cut, "at int, head binary, places binary, body binary"))
    scratch.drop("keys")
    met = pieces.select("at", "head").mapInArrow(heads, PACKED)
    answers = scratch.put("answers", met.groupBy("at").applyInArrow(meet, PACKED + ", n long"))
    sorters = int((answers.agg(F.sum("n")).first()[0] or 0) // SHARD) + 1

    def send(found: pa.Table, own: pa.Table) -> pa.Table:
        """The text of a bucket's fragments that are to be sorted, to the shards of their keys."""
        number, _, sends = joined(found, 3)
        if not own.num_rows or not sends.any():
            return packed([])
        at, number = own["at"][0].as_py(), np.sort(number[sends > 0])
        key, _, least, size = unplaned(own["head"][0].as_py(), 4)
        ends = np.cumsum(size)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(own["body"][0].as_py()), np.uint8)
        rows = []
        for s, n in dealt(key[number] % sorters, number):
            head = planes(least[n], size[n], n, np.full(len(n), at))
            body = b"".join(data[b - k : b].tobytes() for b, k in zip(ends[n].tolist(), size[n].tolist()))
            rows.append((s, len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(1).compress(body)))
        return packed(rows)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Covered runs of a shard's fragments, to their buckets. The shard goes to disk as it comes."""
        with tempfile.TemporaryDirectory() as folder:
            shard = Shard(folder, BUDGET)
            for batch in batches:
                for blob in batch.column(batch.schema.get_field_index("blob")):
                    raw = blob.as_py()
                    n = int.from_bytes(raw[:8], "little")
                    least, size, number, home = unplaned(raw[8 : 8 + n], 4)
                    shard.add(least, size, home, number, np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 + n :]), np.uint8))
            for home, *columns in shard.covered():
                yield from packed((g, planes(*x)) for g, *x in dealt(home, *columns)).to_batches()

    def unite(own: pa.Table, found: pa.Table) -> pa.Table:
        """A bucket's covered runs: whole fragments in documents after their least one, and what the sorters found in that one."""
        schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
        if not own.num_rows:
            return schema.empty_table()
        _, _, first, size = unplaned(own["head"][0].as_py(), 4)
        first = first.copy()
        doc, tid, off, kind = unplaned(own["places"][0].as_py(), 4)
        row = row_numbers(doc, tid)
        at_row = np.unique(row, return_index=True)[1]
        sorted_ = pc.equal(found["tag"], 1)
        number, least, _ = joined(found.filter(pc.invert(sorted_)), 3)
        first[number] = least
        whole = doc > first[kind]
        spans = [(row[whole], off[whole], off[whole] + size[kind[whole]])]
        number, start, end = joined(found.filter(sorted_), 3)
        if len(number):
            order = np.argsort(number, kind="stable")
            number, start, end = number[order], start[order], end[order]
            of, off, kind = row[~whole], off[~whole], kind[~whole]
            a, b = np.searchsorted(number, kind, "left"), np.searchsorted(number, kind, "right")
            n = b - a
            at = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            spans.append((np.repeat(of, n), np.repeat(off, n) + start[at], np.repeat(off, n) + end[at]))
        row, start, end = (np.concatenate(x) for x in zip(*spans))
        if not len(row):
            return schema.empty_table()
        row, start, end = united(row, start, end)
        head = starts_of(row)
        ends = pa.array(np.append(head, len(row)), pa.int32())
        at = at_row[row[head]]
        return pa.table({"doc_id": doc[at], "tid": tid[at], "starts": pa.ListArray.from_arrays(ends, pa.array(start)), "ends": pa.ListArray.from_arrays(ends, pa.array(end))})

    sent = answers.groupBy("at").cogroup(pieces.select("at", "head", "body").groupBy("at")).applyInArrow(send, PACKED)
    spans = scratch.put("sorted", sent.groupBy("at").applyInArrow(sort, PACKED))
    found = answers.select("at", "blob", F.lit(0).alias("tag")).unionByName(spans.withColumn("tag", F.lit(1)))
    own = pieces.select("at", "head", "places")
    spans = scratch.put("spans", own.groupBy("at").cogroup(found.groupBy("at")).applyInArrow(unite, "doc_id long, tid long, starts array<long>, ends array<long>"))
    scratch.drop("pieces", "answers", "sorted")
    return rows, spans


def dedup(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: all rows as of ``repeated_spans``, and (doc_id, tid, n_removed, n_spans, kept) of rows that lose a part, repeated rows once."""
    rows, spans = repeated_spans(docs)
    texts = picked(identified(docs), spans.select(*KEY), "left_semi").dropDuplicates(KEY)

    def remove(batches):
        for batch in batches:
            removed, kept = [], []
            for text, a, b in zip(*(batch.column(i) for i in (2, 3, 4))):
                raw, at, parts = text.as_buffer().to_pybytes(), 0, []
                for x, y in zip(a.as_py(), b.as_py()):
                    parts.append(raw[at:x])
                    at = y
                kept.append(b"".join(parts) + raw[at:])
                removed.append(len(raw) - len(kept[-1]))
            n = [len(a) for a in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "tid", "n_removed", "n_spans", "kept"])

    return rows, texts.select(*KEY, "text").join(spans, KEY).mapInArrow(remove, "doc_id long, tid long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    rows, cut = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cut = cut.select(*KEY, "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    whole = F.col("copy") & (F.col("n_bytes") >= WIDTH)
    return rows.join(cut, KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )
