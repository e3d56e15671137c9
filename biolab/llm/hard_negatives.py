"""Hard negatives by a vector-approximation file: bounds of a score decide which vectors are scored exactly.

Rows are dealt by hash to tiles of at most TILE. Of each tile the file has, for each dimension, CELLS cells between the quantiles
of the tile's own values, each with the least and the largest value in it, and a one-byte cell number for each component. A look-up turns cell numbers
into middles m and half-widths h, and for an anchor q the score lies between q*m - |q|*h and q*m + |q|*h. Anchors, a stated query set, are
cut into parts of ANCHORS and meet every tile.

Two passes over the file: the best rows of the anchor's label (its positives), then for each positive the best rows of other
labels within a window of its score. In a tile the k-th largest lower bound among rows that surely qualify is a limit; only rows whose
upper bound reaches it, and whose bounds meet the window, are scored exactly. A tile gives at most k rows for each list, and
the k best of all tiles are merged.

Defined cases: rows without vec_id, label or vector, or with a component that is null, NaN or infinite, take no part; rows
equal in vec_id, label and vector are one row; rows of one vec_id that differ otherwise are rows of their own, but not
"other" rows of an anchor of that vec_id; shorter vectors count as followed by zeros; ties go to the smaller vec_id;
components of any size are scored exactly, and scores outside a long are given as its nearest end; an empty table, or one
without anchors, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Cells of a dimension: at most 256, as a cell number is a byte.
CELLS = 64
#: Most rows of a tile, and the fewest that are worth one.
TILE, SMALL_TILE = 65_536, 2_048
#: Tiles that a small table is dealt to, so that all cores have work.
SPREAD = 64
#: Most anchors of a part.
ANCHORS = 8_192
#: Numbers of a matrix of bounds, and exact scores computed at once.
MATRIX, PAIRS = 1 << 21, 1 << 15
LONG = 1 << 63

FILE = "tile int, n int, ids binary, labels binary, codes binary, low binary, high binary, kind string, vectors binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, rid) of the distinct rows that take part."""
    inf = float("inf")
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < inf, F.lit(False)))
    df = embeddings.filter("vec_id is not null and label is not null and embedding is not null").filter(whole)
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding").distinct()
    return df.withColumn("rid", F.xxhash64("vec_id", "label", "embedding"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of whole numbers as doubles, padded with zeros to the longest."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell number of each component, least and largest value of each dimension's cells)."""
    n, d = v.shape
    codes, low, high = np.zeros((n, d), np.uint8), np.zeros((d, CELLS)), np.zeros((d, CELLS))
    for j in range(d):
        order = np.argsort(v[:, j], kind="stable")
        x = v[order, j]
        edges = x[np.arange(1, CELLS) * n // CELLS]
        code = np.searchsorted(edges, x, "right")
        codes[order, j] = code
        ends = np.searchsorted(code, np.arange(CELLS + 1))
        held = ends[1:] > ends[:-1]
        low[j, held], high[j, held] = x[ends[:-1][held]], x[ends[1:][held] - 1]
    return codes, low, high


def _build(table: pa.Table) -> pa.Table:
    v = _matrix(table["embedding"])
    codes, low, high = cells(v)
    most = np.abs(v).max(initial=0)
    kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "float64"
    raw = lambda x: x.tobytes()
    ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
    row = [table["tile"][0].as_py(), len(v), raw(ids), raw(labels), raw(codes), raw(low), raw(high), kind, raw(v.astype(kind))]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.string(), pa.binary()]
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=[f.split()[0] for f in FILE.split(", ")])


class _Tile:
    """A tile of the file against the anchors of a part."""

    def __init__(self, file: pa.Table, anchors: pa.Table):
        r = file.to_pylist()[0]
        n = r["n"]
        take = lambda c, kind: np.frombuffer(r[c], kind)
        self.ids, self.labels = take("ids", np.int64), take("labels", np.int64)
        self.v = take("vectors", r["kind"]).reshape(n, -1)
        d = self.v.shape[1]
        codes, low, high = take("codes", np.uint8).reshape(n, d), take("low", np.float64).reshape(d, CELLS), take("high", np.float64).reshape(d, CELLS)
        q = _matrix(anchors["embedding"])[:, :d]
        self.q = np.pad(q, ((0, 0), (0, d - q.shape[1])))
        largest = np.abs(self.q).max(initial=0) * np.abs(self.v.astype(np.float64)).max(initial=0) * max(d, 1)
        self.exact = largest < 1 << 52  # sums of products, and of their halves, are then exact in doubles
        at = np.arange(d)
        self.middle, self.half = ((low + high) / 2)[at, codes], ((high - low) / 2)[at, codes]

    def bounds(self, some: np.ndarray, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of ``some`` anchors with ``rows``."""
        middle = self.middle[rows]
        if not self.exact:
            return np.full((len(some), len(middle)), -np.inf), np.full((len(some), len(middle)), np.inf)
        mid, off = self.q[some] @ middle.T, np.abs(self.q[some]) @ self.half[rows].T
        return mid - off, mid + off

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), PAIRS):
            p, r = self.q[i[a : a + PAIRS]], self.v[j[a : a + PAIRS]]
            if self.exact:
                out[a : a + PAIRS] = np.einsum("ij,ij->i", p, r.astype(np.float64))
            else:
                out[a : a + PAIRS] = [min(max(sum(int(x) * int(y) for x, y in zip(s, t)), -LONG), LONG - 1) for s, t in zip(p, r)]
        return out


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or -inf."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k of each i, by falling score, then id."""
    order = np.lexsort((ids, -score.astype(np.float64), i)) if np.abs(score).max(initial=0) < 1 << 53 else np.array(sorted(range(len(i)), key=lambda x: (i[x], -int(score[x]), ids[x])), np.int64)
    s = i[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return order[rank < k]


def _chunks(some: np.ndarray, rows: int):
    step = max(1, MATRIX // max(rows, 1))
    for a in range(0, len(some), step):
        yield some[a : a + step]


def _table(schema: list[tuple[str, pa.DataType]], parts: list[list[np.ndarray]]) -> pa.Table:
    joined = [np.concatenate([p[k] for p in parts]) if parts else [] for k in range(len(schema))]
    return pa.table([pa.array(x, t) for x, (_, t) in zip(joined, schema)], names=[c for c, _ in schema])


_POSITIVE = [("anchor_id", pa.int64()), ("rid", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]
_NEGATIVE = [("anchor_id", pa.int64()), ("rid", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]


def _positives(file: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of each anchor's label in a tile."""
    out = []
    if file.num_rows and anchors.num_rows:
        t = _Tile(file, anchors)
        ids, rids, labels = (anchors[c].to_numpy() for c in ("anchor_id", "rid", "label"))
        for label in np.unique(labels):
            rows = np.flatnonzero(t.labels == label)
            for some in _chunks(np.flatnonzero(labels == label), len(rows)):
                low, high = t.bounds(some, rows)
                own = ids[some][:, None] == t.ids[rows][None, :]
                low[own] = -np.inf
                i, j = np.nonzero((high >= _kth(low, POSITIVES)[:, None]) & ~own)
                score = t.scores(some[i], rows[j])
                top = _best(i, t.ids[rows[j]], score, POSITIVES)
                out.append([ids[some[i[top]]], rids[some[i[top]]], t.ids[rows[j[top]]], score[top]])
    return _table(_POSITIVE, out)


def _negatives(file: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of other labels in a tile, in the window of each of an anchor's positives."""
    out = []
    if file.num_rows and anchors.num_rows:
        t = _Tile(file, anchors)
        ids, rids, labels = (anchors[c].to_numpy() for c in ("anchor_id", "rid", "label"))
        found = anchors["positives"].to_pylist()
        for some in _chunks(np.arange(len(ids)), len(t.ids)):
            low, high = t.bounds(some, slice(None))
            same = labels[some][:, None] == t.labels[None, :]
            low[same], high[same] = -np.inf, -np.inf
            windows, wanted = [], np.zeros(low.shape, bool)
            for place in range(POSITIVES):
                p = [found[a][place] if place < len(found[a]) else None for a in some]
                # whole numbers between 30 and 90 hundredths; an empty window where there is no such positive
                least = np.array([-(-LEAST * x // 100) if x is not None else 1 for x in p], object)
                most = np.array([MOST * x // 100 if x is not None else 0 for x in p], object)
                a, b = least.astype(np.float64)[:, None], most.astype(np.float64)[:, None]
                sure = np.where((low >= a) & (high <= b), low, -np.inf)
                wanted |= (high >= np.maximum(a, _kth(sure, NEGATIVES)[:, None])) & (low <= b) & ~same
                windows.append((least, most))
            i, j = np.nonzero(wanted)
            score = t.scores(some[i], j)
            for place, (least, most) in enumerate(windows):
                inside = np.flatnonzero((score >= least[i]) & (score <= most[i]))
                top = inside[_best(i[inside], t.ids[j[inside]], score[inside], NEGATIVES)]
                out.append([ids[some[i[top]]], rids[some[i[top]]], np.full(len(top), place, np.int32), t.ids[j[top]], score[top]])
    return _table(_NEGATIVE, out)


def _ddl(schema) -> str:
    return ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in schema)


def _met(file: DataFrame, anchors: DataFrame, tiles: int, parts: int, found, schema) -> DataFrame:
    """Every part of the anchors against every tile, by ``found``."""
    left = file.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = anchors.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(found, _ddl(schema))


def mine(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    scratch = Scratch(embeddings.sparkSession, "negatives")
    rows = scratch.put("rows", usable(embeddings))
    n, n_anchors = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % 100 == 0)).first()
    tiles = max(-(-n // TILE), min(SPREAD, -(-n // SMALL_TILE)), 1)
    parts = max(-(-n_anchors // ANCHORS), 1)
    tiled = rows.withColumn("tile", F.pmod("rid", F.lit(tiles)).cast("int"))
    file = scratch.put("file", tiled.groupBy("tile").applyInArrow(_build, FILE))
    anchors = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor_id"), "rid", "label", "embedding", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int").alias("part"))
    each = Window.partitionBy("anchor_id", "rid")
    good = _met(file, anchors, tiles, parts, _positives, _POSITIVE)
    good = good.withColumn("place", F.row_number().over(each.orderBy(F.desc("positive_score"), "positive_id")) - 1).filter(F.col("place") < POSITIVES)
    good = scratch.put("positives", good)
    lists = good.groupBy("anchor_id", "rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    bad = _met(file, anchors.join(lists, ["anchor_id", "rid"]), tiles, parts, _negatives, _NEGATIVE)
    by_place = Window.partitionBy("anchor_id", "rid", "place").orderBy(F.desc("negative_score"), "negative_id")
    bad = bad.withColumn("rank", F.row_number().over(by_place)).filter(F.col("rank") <= NEGATIVES)
    return bad.join(good, ["anchor_id", "rid", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All scores by brute force.
ORACLE = """
WITH v0 AS (SELECT DISTINCT vec_id::bigint AS id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label::bigint END AS label, embedding FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, label, hash(embedding) AS h, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS c FROM v0),
a AS (SELECT * FROM v WHERE id % 100 = 0),
s AS (SELECT a.id AS anchor_id, a.h AS ah, a.label AS al, v.id, v.label, coalesce(list_sum(list_transform(list_zip(a.c, v.c), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::bigint AS score FROM a, v),
pos AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, ah, al ORDER BY score DESC, id) AS place FROM s WHERE label = al AND id <> anchor_id QUALIFY place <= 5),
neg AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.ah, p.al, p.place ORDER BY n.score DESC, n.id) AS rank
 FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND n.ah = p.ah AND n.al = p.al AND n.label <> n.al AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM neg"""
