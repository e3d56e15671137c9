"""Virtual slots: near-equal shards, places without gaps, edits of the map, and what moves by them."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from biolab.llm import sharding
from biolab.llm.sharding import SlotMap

from .helpers import CLASHES, EDGE, collected, documents


def held(spark, docs, n):
    """The laws of a placement of ``n`` rows; gives the rows."""
    rows = sharding.shards(docs).collect()
    assert len(rows) == n
    at = defaultdict(list)
    for r in rows:
        at[r.shard].append(r)
    assert all(sorted(r.slot for r in of) == list(range(len(of))) for of in at.values()) and set(at) <= set(range(24))
    return rows, {s: sum(r["size"] for r in of) for s, of in at.items()}


def test_sizes_are_near_equal_and_rows_are_whole(spark):
    texts = EDGE + [f"text {i % 900} " * (1 + i * i % 50) for i in range(3000)]
    ids = list(range(len(texts)))
    rows, sums = held(spark, documents(spark, texts, ids=ids), len(texts))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    most = sorted(sums.values())[:-1]  # the last is one long text, more than a shard's share
    assert len(sums) == 24 and most[-1] - most[0] <= 64
    again = sharding.shards(documents(spark, texts[::-1], ids=ids[::-1]).repartition(7)).collect()
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_a_record_with_most_rows_is_spread(spark):
    texts, ids = ["hot " * 50] * 30_000 + [f"t{i}" * 20 for i in range(3000)] + [None] * 3, [7] * 30_000 + list(range(100, 3100)) + [None] * 3
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    rows, sums = held(spark, docs, len(texts))
    assert max(sums.values()) < 1.05 * min(sums.values())
    assert Counter((r.doc_id, r["size"]) for r in rows)[(None, 8)] == 3


def test_many_cells_number_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 3)
    docs = spark.createDataFrame([(i // 2, f"x{i % 40}") for i in range(2000)], "doc_id long, text string")
    rows = sharding.shards(docs, 5, 16)
    got = collected(rows, "shard", "slot")
    assert len(got) == 2000 and all(g.slot.tolist() == list(range(len(g))) for _, g in got.groupby("shard"))


def test_empty_table_and_clashing_names(spark):
    docs = documents(spark, EDGE)
    assert sharding.shards(docs.limit(0)).count() == 0
    named = docs.withColumn("shard", docs.n).withColumn("virtual_slot", docs.n)
    got = sharding.assign(named, SlotMap.first())
    assert got.columns == [*named.columns, "virtual_slot_", "shard_"] and got.count() == len(EDGE)
    assert [got.first()[c] for c in CLASHES] == CLASHES
    assert {r.shard_ for r in got.collect()} == {r.virtual_slot_ % 24 for r in got.collect()}


def test_rebalancing_moves_little_and_growing_only_to_the_new_shard():
    rng = np.random.default_rng(1)
    weight = rng.pareto(2, 4096).round(3) * 1000 // 1
    first = SlotMap.first(4096, 24)
    level = first.rebalanced(weight)
    total = level.totals(weight)
    assert level.version == 1 and total.max() - total.min() <= 0.001 * weight.sum() / 24
    assert first.moved(level) < 600 and level.moved(level.rebalanced(weight)) <= 4
    weight[level.shard == 3] *= 1.5  # one shard has grown: what moves is about its excess
    after = level.rebalanced(weight)
    gone = (level.shard == 3) & (after.shard != 3)
    assert level.moved(after) <= 100 and gone.any() and after.totals(weight).max() <= 1.001 * weight.sum() / 24
    more = after.grown(weight)
    assert more.shards == 25 and set(more.shard[more.shard != after.shard]) == {24}
    assert abs(more.totals(weight)[24] - weight.sum() / 25) <= 0.01 * weight.sum() / 25
    assert (SlotMap.first(16, 4).rebalanced(np.zeros(16)).shard == SlotMap.first(16, 4).shard).all()


def test_versions_are_stored_and_shards_written(spark, tmp_path):
    docs = documents(spark, [f"document {i} " * (i % 30) for i in range(400)] + ["same"] * 3000, ids=list(range(400)) + [5000] * 3000)
    recs = sharding.records(docs, 256).cache()
    size, _, _ = sharding.slot_sums(recs, 256)
    first = SlotMap.first(256, 4)
    second = first.rebalanced(size)
    for m in (first, second):
        m.save(spark, f"{tmp_path}/map")
    assert SlotMap.load(spark, f"{tmp_path}/map").version == 1
    old = SlotMap.load(spark, f"{tmp_path}/map", 0)
    assert (old.shard == first.shard).all() and old.shards == 4
    sharding.write(docs, second, f"{tmp_path}/out", recs)
    back = spark.read.parquet(f"{tmp_path}/out/shards")
    assert back.count() == 3400 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    slots = {(r.virtual_slot, r.shard) for r in back.select("virtual_slot", "shard").distinct().collect()}
    assert all(second.shard[a] == b for a, b in slots) and len({r.virtual_slot for r in back.filter("doc_id = 5000").select("virtual_slot").distinct().collect()}) > 40
