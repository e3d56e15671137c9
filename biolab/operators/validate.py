"""Checks across a document's markers, and its review status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biolab.functions import columns
from biolab.functions.fixed_values import PLAUSIBILITY
from biolab.operators.conflicts import KEY, TOLERANCE

RANK = {"success": 0, "needs_review": 1, "partial_failure": 2}
PERCENTAGES = ["neutrophils_pct", "lymphocytes_pct", "monocytes_pct", "eosinophils_pct", "basophils_pct"]


def with_bands(df: DataFrame, name: Column, unit: Column) -> DataFrame:
    """Adds hard_lo, hard_hi, soft_lo and soft_hi, the possible and the usual band of a marker in a unit; null without a band."""
    bands = df.sparkSession.createDataFrame(PLAUSIBILITY, "_name string, _unit string, hard_lo double, hard_hi double, soft_lo double, soft_hi double")
    return df.join(F.broadcast(bands), (name == F.col("_name")) & (unit == F.col("_unit")), "left").drop("_name", "_unit")


def band_state(v: Column) -> Column:
    """ok, unusual (outside the usual band), impossible (outside the possible one), or null without a band."""
    return F.when((v < F.col("hard_lo")) | (v > F.col("hard_hi")), "impossible").when((v < F.col("soft_lo")) | (v > F.col("soft_hi")), "unusual").when(F.col("hard_lo").isNotNull(), "ok")


def plausibility(kept: DataFrame) -> DataFrame:
    """Adds ``plausible``: where a value lies in the bands of its marker and unit."""
    df = with_bands(kept, F.col("standardized_name"), F.col("unit"))
    return df.select(*kept.columns, band_state(F.col("value")).alias("plausible"))


def reference_check(df: DataFrame, reference: str = "reference_range", flagged: str = "flagged") -> DataFrame:
    """Adds lo, hi and ``newly_flagged``: outside its range though not flagged before."""
    r = columns.parse_reference_range(F.col(reference))
    df = df.withColumn("_r", r)
    outside = (F.col("value") < F.col("_r.lo")) | (F.col("value") > F.col("_r.hi"))
    return df.select("*", F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"), F.coalesce(outside & ~F.col(flagged), F.lit(False)).alias("newly_flagged")).drop("_r")


def _of(name: str, what: str, unit: Column | None = None, ok: Column | None = None) -> Column:
    """The first reading of a marker in a document."""
    ok = (F.lit(True) if ok is None else ok) & (F.col("standardized_name") == name) & (F.lit(True) if unit is None else F.col("unit") == unit)
    return F.min_by(F.when(ok, F.col(what)), F.when(ok, F.col("ord")))


def _off(computed: Column, reported: Column, percent: float) -> Column:
    """Whether two numbers differ by more than a share of the second; any difference from zero does."""
    return F.when(reported == 0, computed != 0).otherwise(F.abs(computed - reported) / F.abs(F.nullif(reported, F.lit(0.0))) * 100 * F.signum(reported) > percent)


LIPIDS = (("tc", "total_cholesterol"), ("ldl", "ldl_cholesterol"), ("hdl", "hdl_cholesterol"), ("tg", "triglycerides"), ("ratio", "tc_hdl_ratio"))


def _named(unit: str) -> Column:
    return F.lit(unit)


def _keyed(unit: str) -> Column:
    return F.xxhash64(F.lit(unit))


def _cross_inputs(ok: Column | None = None, unit: Callable[[str], Column] = _named) -> list[Column]:
    """What the cross checks need of a document, as aggregates over its rows that are ``ok``; ``unit``: how the column unit writes one."""
    parts = [_of(p, "value", unit("%"), ok).alias(f"_{p}") for p in PERCENTAGES]
    return [*parts, *[_of(n, w, None, ok).alias(f"{k}_{w}") for k, n in LIPIDS for w in ("value", "unit")]]


def _cross_results(unit: Callable[[str], Column] = _named) -> list[Column]:
    c = F.col
    found = F.array_compact(F.array(*[f"_{p}" for p in PERCENTAGES]))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    k = F.when(c("tc_unit") == unit("mg/dL"), 5.0).when(c("tc_unit") == unit("mmol/L"), 2.2)
    one_unit = (c("tc_unit") == c("ldl_unit")) & (c("tc_unit") == c("hdl_unit")) & (c("tc_unit") == c("tg_unit"))
    friedewald = c("ldl_value") + c("hdl_value") + c("tg_value") / k
    ratio = c("tc_value") / F.when(c("hdl_value") > 0, c("hdl_value"))
    return [
        total.alias("pct_sum"), F.size(found).alias("pct_count"), ((F.size(found) >= 3) & (F.abs(total - 100) > 5)).alias("pct_warns"),
        F.when(one_unit, friedewald).alias("friedewald"), F.coalesce(one_unit & _off(friedewald, c("tc_value"), 15.0), F.lit(False)).alias("friedewald_warns"),
        F.when(c("tc_unit") == c("hdl_unit"), F.when(c("ratio_value").isNotNull(), ratio)).alias("tc_hdl"),
        F.coalesce((c("tc_unit") == c("hdl_unit")) & _off(ratio, c("ratio_value"), 10.0), F.lit(False)).alias("tc_hdl_warns"),
    ]


def cross_checks(kept: DataFrame) -> DataFrame:
    """(doc_id, and for each check its results and whether it warns): one aggregate for all of them."""
    return kept.groupBy("doc_id").agg(*_cross_inputs()).select("doc_id", *_cross_results())


def assess(a: dict[str, Column]) -> Column:
    """Rank of a document's status from its eight counters."""
    bad = (a["conflicts"] > 0) | (a["ambiguous"] > 0) | (a["unit_gaps"] > 0) | (a["partial_pages"] > 0) | (a["rejections"] > 0)
    return F.when(a["failed_pages"] > 0, 2).when((a["resolved"] == 0) | (a["unresolved"] > a["resolved"]) | bad, 1).otherwise(0)


#: Counts of a document's pages.
PAGED = ["failed_pages", "partial_pages", "rejections"]
COUNTERS = ["resolved", "unresolved", "conflicts", "ambiguous", "unit_gaps", "impossible", "unusual"]


def signs() -> list[Column]:
    """Whether a reading is ambiguous, has no unit of its own, is impossible, is unusual."""
    return [F.col("confidence") == "ambiguous", F.col("unit_status") != "Observed", F.col("plausible") == "impossible", F.col("plausible") == "unusual"]


def counters(ok: Column, bad: Column, of_kept: list[Column]) -> list[Column]:
    """COUNTERS, named n_..., as aggregates over a document's rows by marker: ``ok`` are kept, ``bad`` are conflicts, ``of_kept`` the signs of the first reading."""
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    unresolved = F.coalesce(F.sum(F.when(F.col("standardized_name").isNull(), F.col("n_readings"))), F.lit(0))
    return [c.alias(f"n_{k}") for k, c in zip(COUNTERS, [count(ok), unresolved, count(bad), *(count(ok & c) for c in of_kept)])]


def with_status(df: DataFrame, page_counts: DataFrame | None, *more: str) -> DataFrame:
    """(doc_id, counters, cross_warnings, page counts if given, status, found_nothing, patterns_suffice, and ``more``) from a document's ``counters`` and cross results.

    A document of ``page_counts`` (doc_id, failed_pages, partial_pages, rejections) that has no row in ``df`` has a status too; ``df`` may have these counts itself.
    """
    paged = [c for c in PAGED if c in df.columns]
    df = df.select("doc_id", *[F.col(f"n_{k}").alias(k) for k in COUNTERS], (F.col("pct_warns").cast("int") + F.col("friedewald_warns").cast("int") + F.col("tc_hdl_warns").cast("int")).alias("cross_warnings"), *[F.col(c).alias(f"_{c}") for c in more], *paged)
    if page_counts is not None:
        df = df.join(page_counts.select("doc_id", *PAGED), "doc_id", "full")
    if page_counts is None and not paged:
        of_pages, shown = dict.fromkeys(PAGED, F.lit(0)), []
    else:
        of_pages = {k: F.coalesce(k, F.lit(0)) for k in PAGED}
        shown = [c.alias(k) for k, c in of_pages.items()]
    n = {k: F.coalesce(k, F.lit(0)) for k in (*COUNTERS, "cross_warnings")}
    rank = assess({k: n[k] for k in COUNTERS[:5]} | of_pages)
    rank = F.greatest(rank, F.when(n["impossible"] > 0, 2).when((n["unusual"] > 0) | (n["cross_warnings"] > 0), 1).otherwise(0))
    return df.select(
        "doc_id", *[c.alias(k) for k, c in n.items()], *shown, F.element_at(F.array(*[F.lit(s) for s in RANK]), rank + 1).alias("status"),
        ((n["resolved"] == 0) & (n["unresolved"] == 0)).alias("found_nothing"),
        ((n["resolved"] >= 3) & (n["unresolved"] < 5 * n["resolved"])).alias("patterns_suffice"), *[F.col(f"_{c}").alias(c) for c in more],
    )


def document_status(resolved: DataFrame, page_counts: DataFrame | None = None, with_comparator: bool = True) -> DataFrame:
    """A row for each document: counters, warnings and its status, the worst of all checks.

    ``page_counts`` of paged documents, as of ``pages.page_counts``; others have none of these. Rows may have these
    counts themselves, as of ``pages.page_readings_and_counts``: they are added up. ``with_comparator`` as of ``conflicts.every_group``.

    Two hash aggregates over one pass of the rows: by (document, marker), then by document. What they hold of a reading is of
    fixed width: its value, the signs of it as bits, and units and comparators as hashes, which are only compared. Documents with
    neither a kept nor an unresolved row are ``found_nothing``, even if they have conflicts.
    """
    read = F.col("value").isNotNull()
    if_read = lambda c: F.when(read, c)
    df = with_bands(resolved, F.col("standardized_name"), F.col("unit")).withColumn("plausible", band_state(F.col("value")))
    bits = sum((F.coalesce(s, F.lit(False)).cast("int") * (1 << i) for i, s in enumerate(signs())), F.lit(0))
    paged = [c for c in PAGED if page_counts is None and c in df.columns]
    add = [F.sum(c).alias(c) for c in paged]
    df = df.select(*KEY, *paged, "value", if_read(F.col("ord")).alias("at"), if_read(F.xxhash64("unit")).alias("unit"), if_read(F.xxhash64("comparator")).alias("mark"), bits.alias("bits"))
    first = lambda c: F.min_by(c, "at").alias(f"first_{c}")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("value", "unit", "mark") for f in (F.min, F.max)]
    g = df.groupBy(*KEY).agg(F.count("at").alias("n_readings"), F.min("at").alias("ord"), first("value"), first("unit"), first("bits"), *ends, *add)
    c = F.col
    agree = (c("max_value") - c("first_value") < TOLERANCE) & (c("first_value") - c("min_value") < TOLERANCE) & (c("min_unit") == c("max_unit"))
    if with_comparator:
        agree = agree & (c("min_mark") == c("max_mark"))
    named = c("standardized_name").isNotNull() & (c("n_readings") > 0)
    ok, bad = named & c("agree"), named & ~c("agree")
    g = g.select(*KEY, *paged, "ord", "n_readings", c("first_value").alias("value"), c("first_unit").alias("unit"), c("first_bits").alias("bits"), agree.alias("agree"))
    df = g.groupBy("doc_id").agg(*counters(ok, bad, [c("bits").bitwiseAND(1 << i) > 0 for i in range(4)]), *_cross_inputs(ok, _keyed), *add)
    return with_status(df.select("*", *_cross_results(_keyed)), page_counts)
