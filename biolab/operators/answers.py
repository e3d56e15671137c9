"""Answers of an outside extractor: JSON in many wrappings, values of several types, and the check against the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biolab.functions import columns
from biolab.functions.fixed_values import ANSWER_KEYS

ITEM = "array<struct<name: string, value: variant, unit: string, reference_range: string, flagged: boolean, comparator: string, source_text: string>>"
NEAR = 200


def bare(answer: Column) -> Column:
    """Without a code fence."""
    t = columns.trim(answer)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    return columns.trim(F.when(t.startswith("```"), inner).otherwise(t))


def items(answer: Column) -> Column:
    """The list of markers in an answer: the answer, a known key of it, or what its outer brackets hold; null where there is none."""
    t = bare(answer)
    of = lambda c: F.when(c.startswith("["), F.from_json(c, ITEM))
    keys = [of(F.get_json_object(F.when(t.startswith("{"), t), f"$.{k}")) for k in ANSWER_KEYS]
    return F.coalesce(of(t), *keys, of(F.regexp_extract(t, r"(?s)(\[.*\])", 1)))


def coerced(value: Column, comparator: Column) -> Column:
    """struct<value double, comparator string, written string>: numbers as they are, texts with their comparator; else null.

    Texts must be plain floats: a decimal comma is no number here.
    """
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    split = columns.split_comparator(text)
    mark = columns.comparator(F.coalesce(comparator, F.lit("")))
    written = F.when(number == F.floor(number), F.format_string("%.0f", number)).when(number.isNotNull(), number.cast("string")).otherwise(split["rest"])
    return F.struct(
        F.coalesce(number, columns.to_double(split["rest"])).alias("value"),
        F.when(mark != "=", mark).otherwise(F.coalesce(split["comparator"], F.lit("="))).alias("comparator"),
        written.alias("written"),
    )


def near(page: Column, written: Column, name: Column, reach: int = NEAR) -> Column:
    """Whether some writing of the value stands within ``reach`` bytes of the name's longest word.

    A value may be part of a longer number, as 5 of 15. Texts are looked at as UTF-8 bytes, a character each.
    """
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")

    def held(x):
        page, low, token = x["page"], x["low"], x["token"]

        def at(variant):
            # places of the variant: lengths of what stands before it, summed over the parts between
            parts = F.split(page, F.concat(F.lit(r"\Q"), variant, F.lit(r"\E")), -1)
            ends = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + F.length(variant), F.lit(0)) + F.length(p))))
            window = lambda p: F.substring(low, F.greatest(p - reach, F.lit(0)) + 1, p - F.greatest(p - reach, F.lit(0)) + F.length(variant) + reach)
            return F.exists(ends, lambda p: F.contains(window(p), token))

        return F.exists(F.transform(F.filter(columns.value_variants(written), lambda v: v != ""), as_bytes), at)

    texts = F.struct(as_bytes(page).alias("page"), as_bytes(F.lower(page)).alias("low"), as_bytes(columns.name_token(name)).alias("token"))
    return F.coalesce(columns.let(texts, held), F.lit(False))


def page_rollup(pages: DataFrame) -> DataFrame:
    """A document's pages (doc_id, page, error, was_split): counts and rank of status. A split page is partial, a page with an error failed."""
    p = pages.select("doc_id", F.when(F.col("was_split"), "partial").when(F.col("error").isNotNull(), "failed").otherwise("ok").alias("s"))
    out = p.groupBy("doc_id").agg(*[F.count_if(F.col("s") == s).alias(f"n_{s}") for s in ("ok", "partial", "failed")])
    return out.withColumn("rank", F.when(F.col("n_failed") > 0, 2).when(F.col("n_partial") > 0, 1).otherwise(0))


def unresolved_once(rows: DataFrame) -> DataFrame:
    """The unresolved rows of a document whose name, in lower case, is new to it: neither an earlier one's nor the id of an earlier resolved row.

    ``rows`` are all readings, with standardized_name; ids and unresolved names are one set in order of ``ord``.
    """
    key = F.coalesce("standardized_name", F.lower("raw_name"))
    first = Window.partitionBy("doc_id", key).orderBy("ord")
    return rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1 and standardized_name is null").drop("_nth")
