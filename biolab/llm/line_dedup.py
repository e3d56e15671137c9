"""Site-relative line frequency: drop the lines that are boilerplate of their host.

For each host, the pages containing a line are divided by the host's pages; lines over ``RATIO`` and
on at least ``MIN_PAGES`` pages go from all of the host's pages. Pages with one and the same text
count as one page, so a text that is copied often isn't taken for boilerplate. Lines on two pages
or more that are over the share ``MOST`` of a host's pages go too, so hosts of fewer than ``MIN_PAGES`` pages aren't exempt.

``RATIO`` stands in the gap of the measured line frequencies: on sf0.1 (20 hosts of about 496 distinct pages) the footer is
on 8.6 to 13.2 % of each host's pages, and no other line is on more than 4.7 %.

A host's dropped lines are few by proof: their shares of pages add up to the mean number of distinct
lines of a page, so there are at most (mean lines a page) / ratio of them, whatever the host's size.
Lines are compared without white space at their ends, by 64-bit hash.

Defined cases: null texts stay null and count as pages without lines; blank lines are never dropped;
a null host is a host of its own; a page all of whose lines are boilerplate keeps an empty text;
repeated rows count as one page; a line exactly at a limit stays; a very long text makes arrays of its lines in its task, nothing
else grows with it; an empty table gives an empty result; extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._joins import attach, quoted
from ._scratch import Scratch
from .quality_rules import SPACE, held

RATIO = 0.06
MIN_PAGES = 5
MOST = 0.5
#: Up to so many hosts and so many dropped lines (16 bytes each) over all hosts, the table of dropped lines is broadcast;
#: beyond it the join is a salted shuffle.
BROADCAST_HOSTS, BROADCAST_LINES = 100_000, 1_000_000
#: A host's dropped lines lie in so many parts by hash, of which a line is looked up in one.
PARTS = 64


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, most: float | None = MOST) -> DataFrame:
    """(host, line hash, n_pages, host_pages) of the lines to drop."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), bare), lambda x: x != "")
    page = F.xxhash64(F.coalesce("text", F.lit("")))
    pages = scratch.put(
        "pages",
        docs.select(quoted(host).alias("host"), page.alias("page"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("hs"))
        .groupBy("host", "page")
        .agg(F.first("hs").alias("hs")),
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counted = pages.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_pages"))
    counted = counted.filter(F.col("n_pages") >= (min_pages if most is None else min(2, min_pages)))
    both = counted.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    over = (F.col("n_pages") >= min_pages) & (F.col("n_pages") > ratio * F.col("host_pages"))
    if most is not None:
        over |= (F.col("n_pages") >= 2) & (F.col("n_pages") > most * F.col("host_pages"))
    found = scratch.put("found", both.filter(over))
    scratch.drop("pages")
    return found


def dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, most: float | None = MOST) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; all rows and columns stay."""
    found = boilerplate(docs, host, ratio, min_pages, most)
    part = lambda h: F.pmod(h, F.lit(PARTS)).cast("int")
    of_part = found.groupBy("host", part(F.col("h")).alias("part")).agg(F.collect_set("h").alias("hs"))
    drop = of_part.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("part", "hs"))).alias("hs"))
    drop = drop.select("host", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.try_element_at("hs", i), F.array().cast("array<bigint>"))).alias("parts"))
    small = found.count() <= BROADCAST_LINES
    both, row = attach(docs, quoted(host), drop, "host", BROADCAST_HOSTS if small else 0, "left")
    parts = F.col(row)["parts"]
    gone = lambda h: F.array_contains(F.get(parts, part(h)), h)
    kept = F.filter(F.split("text", "\n"), lambda x: ~gone(F.xxhash64(bare(x))))
    text = F.when(parts.isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.select(*[text.alias("text") if c == "text" else quoted(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_md5) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    before = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"))
    out = dedup(before.withColumn("n_chars", F.length("text")))
    out = out.select("doc_id", "n_lines", F.coalesce("text", F.lit("")).alias("text"), (F.col("n_chars") - F.length("text")).alias("gone"))
    left = F.when(F.col("text") == "", F.when(F.coalesce("gone", F.lit(0)) == 0, F.col("n_lines")).otherwise(0)).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - left).cast("long").alias("n_dropped"), F.md5("text").alias("kept_md5"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, source, text, i, lines[i] AS line, trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
      FROM (SELECT *, string_split(text, chr(10)) AS lines FROM t), unnest(range(1, len(lines) + 1)) AS r(i)),
pages AS (SELECT source, count(DISTINCT text) AS host_pages FROM t GROUP BY source),
c AS (SELECT source, bare, count(DISTINCT text) AS n FROM l WHERE bare <> '' GROUP BY source, bare),
f AS (SELECT c.source, bare, true AS hit FROM c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > 0.06::double * host_pages OR n >= 2 AND n > 0.5 * host_pages),
k AS (SELECT rid, count(*) AS n_lines, count(hit) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hit IS NULL), '') AS kept
      FROM l LEFT JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.bare = f.bare GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, md5(kept) AS kept_md5 FROM k JOIN t USING (rid)"""
