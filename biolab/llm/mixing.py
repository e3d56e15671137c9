"""Mix sources to target weights by whole-document repetition.

Per source the tokens are summed, a target is set from the source's weight, and the rate is
``target / tokens``. Every document is emitted ``floor(rate)`` times plus once more by a
hash-seeded Bernoulli draw whose probability is the fraction of the rate.

The draw of a document depends on (seed, doc_id) only, so reruns and retried tasks agree, and texts meet the source
table alone. How near a source's total comes to its target is up to the law of large numbers: its deviation is that of a sum
of independent draws.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source
without words has target 0 and its documents are taken floor(0) = 0 times; a null doc_id draws as
the string ``null``; repeated rows draw alike; sources that tie in size per weight share one side of the water level; a very
long text counts as it is, no list of its words is made; an empty table gives an empty result; extra columns stay, whatever
their names, and if one is called ``mix_copy`` the copy number gets underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._joins import attach, columns, fresh, quoted
from ._scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 0
#: Up to so many sources the per-source table (some 100 bytes a row) is broadcast; beyond it the join is a salted shuffle.
BROADCAST_SOURCES = 100_000
#: Range partitions of the source table where it is put in order.
ORDERED = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) for a document: 32 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"mix{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def ordered(table: DataFrame, by: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``table`` written in range partitions of the order, with the partition's number as ``part``."""
    return scratch.put(name, table.repartitionByRange(ORDERED, *by).withColumn("part", F.spark_partition_id()))


def before_part(parts: DataFrame, what: Column) -> Column:
    """The sum of ``what`` over the partitions before a row's: only a sum of each partition reaches the driver."""
    base, out = 0, F.lit(0)
    for part, n in sorted(parts.groupBy("part").agg(what).collect()):
        out = F.when(F.col("part") == part, F.lit(base)).otherwise(out)
        base += n
    return out


def ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, rank) in order of code point, null last. No task or driver holds all of them."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = [F.col("source").isNull(), F.col("source")]
    parts = ordered(totals, by, scratch, "totals")
    start = before_part(parts, F.count("*"))
    return parts.select("source", "source_size", (F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1 + start).alias("rank"))


def targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes, dealt by weight, at most ``cap`` times a source's own size.

    Water filling, solved exactly: in order of cap per weight, the sources before the first one that the level left by them
    fits under are capped, and that level holds for the rest. Sums over range partitions and within them give each source's level.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    parts = ordered(s, [F.col("fill"), F.col("rank")], scratch, "filled")
    total, free = parts.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return parts.select(*sources.columns, F.lit(0.0).alias("target"))
    earlier = Window.partitionBy("part").orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c: before_part(parts, F.sum(c)) + F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    at = parts.select("fill", "rank", ((share * total - sum_of("most")) / (free - sum_of("weight"))).alias("level"))
    level = at.filter("level <= fill").agg(F.max("level")).first()[0]  # from the first one on, levels only fall
    dealt = F.col("most") if level is None else F.least(F.col("most"), F.col("weight") * F.lit(level))
    return parts.select(*sources.columns, dealt.alias("target"))


def rates(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) of all rows, and (of, source_size, target, rate) of all sources, as ``of``.

    The text is read once, for its size; what follows reads the table of sizes.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.put("sizes", docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = scratch.put("sources", targets(ranked_sources(sizes, scratch), scratch, weights, share, cap))
    scratch.drop("totals", "filled")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sizes, sources.select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate"))


def copies_of(rate: Column) -> Column:
    """How often a row with a doc_id and its source's rate is taken."""
    return (F.floor(rate) + F.when(uniform(F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each row of ``docs``."""
    sizes, sources = rates(docs, weights, share, cap)
    both, row = attach(sizes, F.col("source"), sources, "of", BROADCAST_SOURCES, by=F.col("doc_id"))
    of = F.col(row)
    return both.select("doc_id", "source", "size", of["source_size"].alias("source_size"), of["target"].alias("target"), copies_of(of["rate"]).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the plan says, with its copy number ``mix_copy``.

    Only the source table is joined to the texts, so they aren't shuffled if it is broadcast.
    """
    sources = rates(docs, weights, share, cap)[1]
    both, row = attach(docs, F.col("source"), sources, "of", BROADCAST_SOURCES, by=F.col("doc_id"))
    times, number = fresh(both, "_copies"), fresh(docs, "mix_copy")
    taken = both.withColumn(times, copies_of(F.col(row)["rate"])).filter(F.col(times) > 0)
    return taken.select(*columns(docs), F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(number))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def oracle() -> str:
    """DuckDB SQL for ``query``. The level of the water filling is found among the prefixes of sources in order of cap per weight."""
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS size FROM documents),
src AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM sized GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0::double WHEN 1 THEN 1.0::double ELSE 2.0::double END AS weight, 2.0::double * source_size AS most FROM src),
pre AS (SELECT *, sum(most) OVER o - most AS held, sum(weight) OVER () - (sum(weight) OVER o - weight) AS free, sum(source_size) OVER () AS total
        FROM w WINDOW o AS (ORDER BY most / weight, rk ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT max((1.5::double * total - held) / free) FILTER (WHERE (1.5::double * total - held) / free * weight <= most) AS level FROM pre),
tgt AS (SELECT source, source_size, least(most, weight * coalesce(level, 1e300)) AS target FROM w, lev),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM tgt),
b AS (SELECT s.doc_id, s.size, r.source_size, r.target, r.rate, ('0x' || substr(md5('mix{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::ubigint / 4294967296.0 AS u
      FROM sized s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::bigint AS taken FROM b"""
