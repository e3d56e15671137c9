"""Document quality rules and host verdicts, in DataFrame functions only.

Documents get their counts and fail rules by them: the base rules, many symbols for their words, many repeated lines. The failures
of each rule are summed by host; a host's failure rate is shrunk by an empirical beta prior (moments of the hosts' raw rates
of that rule), so a host of a few pages is judged mostly by what hosts are like. Hosts with a shrunk rate over ``HOST_LIMIT``
fail, and the verdict is joined back to their documents. A document's own symbols and lines count for its host alone.

Defined cases: a null text has no words and fails; a null host is a host of its own; rates exactly at a limit pass; an empty
table gives an empty result; repeated rows count as often as they occur; a very long text makes arrays of its words and windows in
its task, nothing else grows with it; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._joins import attach, quoted
from ._scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Symbols for each 100 words, and repeated lines of 100 lines with a word, that are too many.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents: hosts that are all alike would make it infinite.
PRIOR_LEAST, PRIOR_MOST = 2.0, 1000.0
#: Up to so many hosts the verdicts (some 100 bytes a row) are broadcast; beyond it the join is a salted shuffle.
BROADCAST_HOSTS = 100_000


def held(*columns: Column) -> Column:
    """The columns as one generated row: the optimiser doesn't move what they compute into the expressions that use them."""
    return F.inline(F.array(F.struct(*columns)))


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def counts(docs: DataFrame, host: str = "source", window: int = WINDOW) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    base = docs.select("doc_id", quoted(host).alias("host"), held(text.alias("t")))
    words = base.select("doc_id", "host", "t", held(split_words(F.col("t")).alias("words"), lines.alias("lines")))
    n = F.size("words")
    hashes = F.when(
        n >= window,
        F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, window))),
    ).otherwise(F.array().cast("array<bigint>"))
    first = words.select(
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        held(hashes.alias("h")),
    )
    # Only texts that have a window twice are sorted: equal windows then stand side by side.
    again = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    second = first.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", held(F.when(again, pairs).alias("s")))
    at = lambda j: F.get(F.col("s"), j)
    hit = lambda x, j: (x["h"] == at(j + 1)["h"]) | ((j > 0) & (x["h"] == at(j - 1)["h"]))
    starts = F.array_sort(F.transform(F.filter("s", hit), lambda x: x["i"]))
    third = second.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", held(starts.alias("p")))
    covered = F.aggregate(
        F.transform("p", lambda x, j: F.least(F.lit(window), F.coalesce(F.get(F.col("p"), j + 1) - x, F.lit(window)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return third.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(least: int = MIN_WORDS, percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))


def failures() -> dict[str, Column]:
    """The rules whose failures are summed by host."""
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_pages, failed_<rule>, rate_<rule>, host_kept) from rows with host, base_failed and the counts. The prior is two numbers a rule."""
    rules = failures()
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_pages"), *(F.count_if(c).alias(f"failed_{r}") for r, c in rules.items()))
    raw = {r: F.col(f"failed_{r}") / F.col("n_pages") for r in rules}
    moments = hosts.agg(*(f(x).alias(f"{name}_{r}") for r, x in raw.items() for name, f in (("m", F.avg), ("v", F.var_pop)))).first()
    for r in rules:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0  # null: an empty table
        weight = max(PRIOR_LEAST, min(PRIOR_MOST, m * (1 - m) / v - 1)) if v > 0 else PRIOR_MOST
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + m * weight) / (F.col("n_pages") + weight))
    return hosts.withColumn("host_kept", F.greatest(*(F.col(f"rate_{r}") for r in rules)) <= limit)


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The counts with base_failed, host_kept and kept. The text is read once; the host sums read the written counts."""
    scratch = Scratch(docs.sparkSession, "rules")
    judged = scratch.put("counts", counts(docs, host).withColumn("base_failed", base_failed()))
    hosts = scratch.put("hosts", host_verdicts(judged, limit))
    out, row = attach(judged, F.col("host"), hosts.select("host", "host_kept"), "host", BROADCAST_HOSTS, by=F.col("doc_id"))
    return out.select(*judged.columns, F.col(row)["host_kept"].alias("host_kept")).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i + 7], chr(1)) AS g FROM w, unnest(range(1, len(words) - 6)) AS r(i) WHERE len(words) >= 8),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
p AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS part FROM h WHERE n > 1),
r AS (SELECT rid, sum(part)::bigint AS n_repeat_words FROM p GROUP BY rid),
c AS (SELECT doc_id, source, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
s AS (SELECT source, k AS rule, count(*) AS n, count(*) FILTER (WHERE CASE k WHEN 0 THEN base_failed WHEN 1 THEN 100 * n_symbols > 10 * n_words ELSE 100 * n_dup_lines > 30 * n_lines END) AS f
      FROM b, range(3) AS r(k) GROUP BY source, k),
q AS (SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v FROM s GROUP BY rule),
k AS (SELECT rule, m, CASE WHEN v > 0 THEN greatest(2.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS w FROM q),
hv AS (SELECT source, bool_and((f + m * w) / (n + w) <= 0.5) AS ok FROM s JOIN k USING (rule) GROUP BY source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM b JOIN hv ON b.source IS NOT DISTINCT FROM hv.source"""
