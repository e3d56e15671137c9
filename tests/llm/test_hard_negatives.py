"""Hard negatives of the vector-approximation file against scores by brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from biolab.llm import hard_negatives as hn


def brute(rows):
    seen = {}
    for vec, label, v in rows:
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen[vec, (label + 1) % 10 if vec % 7 == 0 else label, tuple(v)] = [math.floor(256 * x) for x in v]
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    out = []
    for (a, la, va), qa in seen.items():
        if a % 100:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(qa, q))), i, label) for (i, label, _), q in seen.items())
        for score, i, _ in [x for x in scored if x[2] == la and x[1] != a][:5]:
            p = -score
            window = [(-s, j) for s, j, label in scored if label != la and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(a, i, k + 1, j, p, s) for k, (s, j) in enumerate(window)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, tile string, rid int, part int")
    return sorted(tuple(r) for r in hn.mine(df).collect())


def table(rows):
    return [(i, v, label, "x", 1, 2) for i, label, v in rows]


def unit(rng, d):
    v = np.array([rng.gauss(0, 1) for _ in range(d)])
    return [float(np.float32(x)) for x in v / np.linalg.norm(v)]


@pytest.mark.parametrize("tile", [70, 65_536])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "SMALL_TILE", tile)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "MATRIX", 200)
    rng = random.Random(tile)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 12]), unit(rng, 6)) for i in range(600)]
    rows += [(i, 1, rows[5][2]) for i in range(600, 640)]  # ties: many equal vectors of ids of their own
    rows += [rows[0], rows[0], (0, 2, rows[1][2]), (100, 3, [0.5, 0.5]), (300, 1, []), (7, 9, [1.0] * 9)]
    rows += [(None, 1, [1.0]), (900, None, [1.0]), (1000, 1, None), (1100, 1, [1.0, None]), (1200, 2, [float("nan")] * 6), (1300, 2, [float("inf")] * 6), (1400, 2, [0.0] * 6)]
    assert mined(spark, table(rows)) == brute(rows) != []


def test_components_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.choice([1e30, -3.5e20, 7.0, 2.0**40]) * rng.random() for _ in range(4)]) for i in range(60)]
    rows = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert mined(spark, table(rows)) == brute(rows)


def test_empty_tables(spark):
    assert mined(spark, table([(0, 1, [1.0])])[:0]) == []
    assert mined(spark, table([(1, 1, [1.0]), (2, 2, [1.0])])) == []
    assert mined(spark, table([(100, 1, [1.0])])) == []


def test_bounds_hold_and_few_rows_are_scored():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(5000, 32)) / math.sqrt(32)
    rows = pa.table({"vec_id": pa.array(range(1, 5001), pa.int64()), "label": pa.array(rng.integers(0, 5, 5000)), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "tile": pa.array([0] * 5000, pa.int32())})
    file = hn._build(rows)
    anchors = pa.table({"anchor_id": pa.array([1, 2, 3], pa.int64()), "rid": pa.array([0, 1, 2], pa.int64()), "label": rows["label"][:3], "embedding": rows["embedding"][:3], "positives": pa.array([[40_000, 30_000]] * 3)})
    t = hn._Tile(file, anchors)
    low, high = t.bounds(np.arange(3), slice(None))
    whole = t.q @ t.v.astype(float).T
    assert (low <= whole).all() and (whole <= high).all()
    asked = []
    plain = hn._Tile.scores
    try:
        hn._Tile.scores = lambda self, i, j: asked.append(len(i)) or plain(self, i, j)
        assert hn._negatives(file, anchors).num_rows and hn._positives(file, anchors).num_rows == 15
    finally:
        hn._Tile.scores = plain
    assert sum(asked) < 0.2 * 3 * 5000
