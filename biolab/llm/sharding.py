"""Sharding by fixed virtual slots: records hash into thousands of slots, and a versioned map says which shard holds a slot.

The slot of a record never changes. Bytes are summed by slot, and rebalancing edits the map alone: the fewest slots that level
the shards change their shard, all others stay where they are. A map is a table of one row a slot, stored once for each version;
a reader of an older version is undisturbed. SLOTS bounds what reaches the driver (a row a slot) and what is broadcast.

A record is (doc_id, text). Rows that are equal in both are copies of one record; each COPIES of them hash on their own, so one
record with a third of all rows fills many slots. Places within a shard are numbered from sums: the rows of a slot are cut by hash
into cells of about CELL records, and a row's place is the sum of the slots, cells and rows before it. No task holds more than a cell.

Defined cases: a null text counts as an empty one (0 bytes and the overhead); a null doc_id is a key like any other; copies
get places of their own, in any order among each other; ties in size are settled by slot number; very long texts count
as they are; an empty table gives an empty result and leaves the map as it was; extra columns stay in ``assign`` and ``write``, whatever
their names, and if one is called ``shard`` or ``virtual_slot`` the new one gets underscores behind its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._joins import attach, columns, fresh
from ._scratch import Scratch

SLOTS = 8192
SHARDS = 24
#: Shards are level once they differ by no more than this share of their mean, so that few slots move.
SLACK = 0.001
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: Copies of one record that share a slot.
COPIES = 64
#: Records of a cell, about.
CELL = 10_000
#: Records with more than COPIES copies: up to so many (some 50 bytes each) are broadcast.
BROADCAST_HOT = 100_000
#: Files that ``write`` cuts a shard into.
FILES = 16


@dataclass(frozen=True)
class SlotMap:
    """The shard of each slot; ``version`` counts the edits."""

    shard: np.ndarray
    shards: int
    version: int = 0

    @classmethod
    def first(cls, slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        """Slots dealt in turn, before anything is known of their sizes."""
        return cls(np.arange(slots) % shards, shards)

    def totals(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.shard, weight, self.shards)

    def rebalanced(self, weight: np.ndarray) -> SlotMap:
        """The next version, with shards levelled by ``weight`` (of each slot).

        Shards above the mean give up their largest slots that fit into the excess, the lightest shards take those, largest
        first; then a heavy shard and the lightest swap or move one slot at a time while that narrows their gap and it isn't slack yet.
        """
        shard, mean = self.shard.copy(), weight.sum() / self.shards
        total, pool = self.totals(weight), []
        by_weight = np.lexsort((np.arange(len(weight)), -weight))
        for slot in by_weight:
            at = shard[slot]
            if 0 < weight[slot] <= total[at] - mean:
                total[at] -= weight[slot]
                pool.append(slot)
        for slot in pool:
            shard[slot] = at = int(total.argmin())
            total[at] += weight[slot]
        for _ in range(20 * self.shards):
            b = int(total.argmin())
            if total.max() - total[b] <= SLACK * mean:
                break
            theirs = np.flatnonzero(shard == b)
            for a in np.argsort(-total, kind="stable"):  # the heaviest that has something to give
                mine, gap = np.flatnonzero(shard == a), total[a] - total[b]
                change = weight[mine][:, None] - np.append(weight[theirs], 0)[None, :]
                off = np.where((change > 0) & (change < gap), np.abs(change - gap / 2), np.inf)
                if off.size and np.isfinite(off.min()):
                    break
            else:
                break
            i, j = np.unravel_index(off.argmin(), off.shape)
            shard[mine[i]] = b
            if j < len(theirs):
                shard[theirs[j]] = a
            total[a], total[b] = total[a] - change[i, j], total[b] + change[i, j]
        return SlotMap(shard, self.shards, self.version + 1)

    def grown(self, weight: np.ndarray) -> SlotMap:
        """The next version with one more shard, which takes slots up to the new mean from the heaviest ones; nothing else moves."""
        shard, new = self.shard.copy(), self.shards
        total = np.append(self.totals(weight), 0)
        room = weight.sum() / (new + 1)
        for _ in range(len(weight)):
            a = int(total.argmax())
            mine = np.flatnonzero((shard == a) & (weight > 0) & (weight <= room - total[new]))
            if a == new or not len(mine):
                break
            slot = mine[weight[mine].argmax()]
            shard[slot] = new
            total[a], total[new] = total[a] - weight[slot], total[new] + weight[slot]
        return SlotMap(shard, new + 1, self.version + 1)

    def moved(self, other: SlotMap) -> int:
        """Slots that are elsewhere in ``other``."""
        return int((self.shard != other.shard).sum())

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the folder; one that is there is never written again."""
        rows = [(i, int(s), self.shards) for i, s in enumerate(self.shard)]
        spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1).write.parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version, the last one if none is named."""
        df = spark.read.parquet(path)
        if version is None:
            version = df.agg(F.max("version")).first()[0]
        rows = sorted(df.filter(F.col("version") == version).select("slot", "shard", "shards").collect())
        if not rows:
            raise ValueError(f"no version {version} of the slot map in {path}")
        return cls(np.array([r[1] for r in rows]), rows[0][2], int(version))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _record() -> Column:
    return F.xxhash64("doc_id", F.xxhash64(_text()))


def _slot(record: Column, part: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(record, part.cast("long")), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, record, n, part, copies, virtual_slot): a row for each COPIES copies of a record, without its text.

    Copies are counted before the shuffle, so a common record is a row of each task.
    """
    each = docs.select("doc_id", (F.octet_length(_text()) + OVERHEAD).cast("long").alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), _record().alias("record"))
    each = each.groupBy(*each.columns).agg(F.count("*").alias("n"))
    parts = each.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {COPIES} as int)"))).alias("part"))
    left = F.col("n") - F.col("part") * COPIES
    return parts.select("*", F.least(left, F.lit(COPIES)).alias("copies"), _slot(F.col("record"), F.col("part"), slots).alias("virtual_slot"))


def slot_sums(recs: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, int]:
    """(bytes of each slot, rows of each slot, number of records): a row a slot reaches the driver, whatever the input."""
    size, rows, n = np.zeros(slots, np.int64), np.zeros(slots, np.int64), 0
    for slot, b, r, k in recs.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")), F.sum("copies"), F.count("*")).collect():
        size[slot], rows[slot], n = b, r, n + k
    return size, rows, n


def _mapped(spark: SparkSession, slot_map: SlotMap, rows: np.ndarray) -> DataFrame:
    """(virtual_slot, shard, start): ``start`` is the number of rows in the shard's slots before this one."""
    order = np.lexsort((np.arange(len(rows)), slot_map.shard))
    before = np.cumsum(rows[order]) - rows[order]
    first = np.append(True, np.diff(slot_map.shard[order]) != 0)
    start = np.empty_like(rows)
    start[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    out = [(i, int(s), int(b)) for i, (s, b) in enumerate(zip(slot_map.shard, start))]
    return F.broadcast(spark.createDataFrame(out, "virtual_slot int, shard int, start long"))


def placed(recs: DataFrame, slot_map: SlotMap, rows: np.ndarray, n: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, virtual_slot, slot) of every row, ``slot`` being its place in the shard, from 0 without gaps."""
    slots = len(slot_map.shard)
    cells = max(1, -(-n // (slots * CELL)))
    recs = recs.withColumn("cell", F.pmod(F.xxhash64("part", "record"), F.lit(cells)).cast("int"))
    key = ["virtual_slot", "cell"]
    sums = recs.groupBy(*key).agg(F.sum("copies").alias("held"))
    up_to = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*key, up_to("held", Window.partitionBy("virtual_slot").orderBy("cell")).alias("base"))
    within = up_to("copies", Window.partitionBy(*key).orderBy("doc_id", "record", "part"))
    df = recs.withColumn("within", within).join(sums, key).join(_mapped(recs.sparkSession, slot_map, rows), "virtual_slot")
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return df.select("doc_id", "size", "text_crc32", "shard", "virtual_slot", (F.col("start") + F.col("base") + F.col("within") + F.col("copy")).alias("slot"))


def assign(docs: DataFrame, slot_map: SlotMap, recs: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard``; texts aren't shuffled.

    ``recs`` (as of ``records``) tells which records have more than COPIES copies; their rows are dealt to the record's slots by
    their place in the input. Without it all copies of a record share its first slot.
    """
    part, both = F.lit(0), docs
    if recs is not None:
        hot = recs.filter(f"part = 0 and n > {COPIES}").select("record", F.expr(f"(n - 1) div {COPIES} + 1").alias("parts"))
        both, row = attach(docs, _record(), hot, "record", BROADCAST_HOT, "left")
        part = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(row)["parts"]), F.lit(0))
    slot, shard = fresh(docs, "virtual_slot"), fresh(docs, "shard")
    both = both.select(*columns(docs), _slot(_record(), part, len(slot_map.shard)).alias(slot))
    of = docs.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(slot_map.shard)], "_slot int, _shard int")
    return both.join(F.broadcast(of), F.col(slot) == F.col("_slot")).select(*columns(both), F.col("_shard").alias(shard))


def write(docs: DataFrame, slot_map: SlotMap, path: str, recs: DataFrame | None = None) -> None:
    """Writes the rows as Parquet, a folder for each shard, and the map's version beside them. Slots are kept together, shards are cut into FILES files."""
    df = assign(docs, slot_map, recs)
    slot, shard = df.columns[-2:]
    df.repartition(slot_map.shards * FILES, F.col(shard), F.col(slot) % FILES).write.partitionBy(shard).parquet(f"{path}/shards")
    slot_map.save(docs.sparkSession, f"{path}/map")


def shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Rows placed by a map that was rebalanced once for their bytes; both versions of the map are stored in the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    recs = scratch.put("records", records(docs, slots))
    size, rows, n = slot_sums(recs, slots)
    first = SlotMap.first(slots, shards)
    first.save(spark, f"{scratch.path}/map")
    first.rebalanced(size).save(spark, f"{scratch.path}/map")
    now = SlotMap.load(spark, f"{scratch.path}/map")
    return placed(recs, now, rows, n).withColumn("map_version", F.lit(now.version))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
