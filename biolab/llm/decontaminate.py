"""Benchmark decontamination: which documents contain which test items, in DataFrame functions only.

Size-partitioned MinHash containment search. Test items are partitioned by the size of their shingle
set (powers of two). A document contains an item if it holds at least ``THRESHOLD`` of the item's
shingles, so it misses at most ``n - ceil(THRESHOLD * n)`` of them; an item's bottom-k sketch with one
more value than its partition's largest item may miss has a value in every document that contains it.
The sketch length follows from the partition, and the search loses nothing.

1. Documents' shingles are hashed where they are read and met with the items' sketches only. A sketch value that is hit makes
   (document, item) a candidate.
2. Candidates are verified: only their documents are shingled again and met with whole item sets, and the distinct shared
   shingles are counted.

Each table of the items is broadcast only if a count proves it small.

Words are lower-cased runs without white space; a shingle is five words, or the whole sequence where there are fewer.
An item of fewer than five words is one shingle, looked for as a run of words anywhere: documents are also cut into runs
of the lengths that such items have.

Defined cases: each row is judged by its own text, rows with one doc_id and text as one, with a null doc_id too; texts that are
null or without words contain nothing and items without words are in nothing; an empty table on either side gives an empty
result; repeated items each get rows under their own item_id (rows of one item_id are one item); equal hashes in a sketch can't tie,
shingles are distinct; a very long text makes one array of its shingles in its task, nothing else grows with it; extra columns
are not read by ``find`` and kept by ``remove``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._joins import columns, fresh, quoted
from ._scratch import Scratch
from .quality_rules import held, split_words

SHINGLE = 5
THRESHOLD = 0.75
#: Up to so many (shingle, item) rows, 40 bytes each, an items' table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def words_of(docs: DataFrame, *keys: str) -> DataFrame:
    words = docs.select(*keys, held(F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("t")))
    return words.select(*keys, held(split_words(F.col("t")).alias("w")))


def runs(size: int) -> Column:
    """Hashes of all runs of ``size`` words of ``w``."""
    n = F.size("w")
    at = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(F.col("w"), i, size)))


def shingles(docs: DataFrame, *keys: str, short: tuple[int, ...] = ()) -> DataFrame:
    """(keys, shingle hash), not yet distinct. ``short``: lengths under five of which runs are hashed too."""
    n = F.size("w")
    whole = F.when((n > 0) & (n < SHINGLE), F.array(F.xxhash64("w"))).otherwise(F.array().cast("array<bigint>"))
    parts = [runs(SHINGLE), whole, *(runs(k) for k in short)]
    return words_of(docs, *keys).select(*keys, F.explode(F.concat(*parts)).alias("h"))


def item_table(benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(h, item_id, n_item, in_sketch) for the distinct shingles of every item."""
    percent = round(100 * threshold)
    need = lambda n: F.floor((percent * n + 99) / 100)
    sets = shingles(benchmark, "item_id").groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    n = F.size("hs")
    largest = F.pow(F.lit(2.0), F.length(F.bin(n))).cast("long") - 1  # of the item's partition
    k = F.least(n, (largest - need(largest) + 1).cast("int"))
    rows = sets.select("item_id", n.alias("n_item"), k.alias("k"), F.posexplode("hs").alias("at", "h"))
    return rows.select("h", "item_id", "n_item", (F.col("at") < F.col("k")).alias("in_sketch"))


def short_lengths(benchmark: DataFrame) -> tuple[int, ...]:
    """Numbers of words under five that items have: four numbers at most."""
    n = words_of(benchmark, "item_id").select(F.size("w").alias("n")).filter(f"n between 1 and {SHINGLE - 1}").distinct()
    return tuple(sorted(r["n"] for r in n.collect()))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): ``page`` is a hash of the text, so that each row is judged by its own text."""
    return docs.select("doc_id", F.xxhash64("text").alias("page"), "text")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(docs: DataFrame, items: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """(doc_id, page, item_id): the document holds a value of the item's sketch. ``docs`` as of ``units``."""
    sketches = small(items.filter("in_sketch").select("h", "item_id"))
    return shingles(docs, "doc_id", "page", short=short).join(sketches, "h").select("doc_id", "page", "item_id").distinct()


def find_rows(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, page, item_id, n_shared, n_item) of pairs with containment >= threshold."""
    scratch = Scratch(docs.sparkSession, "items")
    items, short, docs = scratch.put("items", item_table(benchmark, threshold)), short_lengths(benchmark), units(docs)
    pairs = scratch.put("pairs", candidates(docs, items, short))
    of = pairs.select(F.col("doc_id").alias("of"), F.col("page").alias("of_page")).distinct()
    mine = docs.join(of, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("page") == F.col("of_page")), "left_semi")
    shared = shingles(mine, "doc_id", "page", short=short).join(small(items.select("h", "item_id", "n_item")), "h")
    shared = shared.groupBy("doc_id", "page", "item_id", "h").agg(F.first("n_item").alias("n_item"))
    counted = shared.groupBy("doc_id", "page", "item_id").agg(F.count("*").alias("n_shared"), F.first("n_item").cast("long").alias("n_item"))
    over = counted.filter(100 * F.col("n_shared") >= round(100 * threshold) * F.col("n_item"))
    # a document is verified against the items that it is a candidate of
    pairs = pairs.select(F.col("doc_id").alias("of"), F.col("page").alias("of_page"), F.col("item_id").alias("of_item"))
    return over.join(pairs, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("page") == F.col("of_page")) & (F.col("item_id") == F.col("of_item")), "left_semi")


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document and item with containment >= threshold."""
    found = find_rows(docs, benchmark, threshold)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text contains a test item.

    What to remove is written first: the planner broadcasts it only if that table is small.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    page, gone = fresh(docs, "_page"), fresh(docs, "_gone")
    ids = scratch.put("ids", find_rows(docs, benchmark, threshold).select(F.struct("doc_id", "page").alias(gone)).distinct())
    equal = quoted("doc_id").eqNullSafe(F.col(gone)["doc_id"]) & (F.col(page) == F.col(gone)["page"])
    return docs.withColumn(page, F.xxhash64("text")).join(ids, equal, "left_anti").select(*columns(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT rid, array_to_string(w[i:i + 4], chr(1)) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0
       UNION SELECT rid, array_to_string(w[i:i + k - 1], chr(1)) AS g FROM d, (SELECT DISTINCT len(w) AS k FROM b WHERE len(w) BETWEEN 1 AND 4), unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], chr(1)) AS g FROM b, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
p AS (SELECT rid, item_id, count(*) AS n_shared FROM ds JOIN bs USING (g) GROUP BY rid, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN n USING (item_id) JOIN d USING (rid) WHERE 100 * n_shared >= 75 * n_item"""
