"""From a text of any layout to readings: delimited and running texts are told apart and read each by its own reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biolab.operators import text
from biolab.operators.resolve import parsed, resolve
from biolab.sources import tabular

READING = ["doc_id", "parser", "ord", "raw_name", "raw_value", "raw_unit", "value", "comparator", "unit", "unit_status", "standardized_name", "display_name", "category", "confidence", "method", "resolved"]


def auto_parse(reports: DataFrame) -> DataFrame:
    """READING columns of (doc_id, content), delimited rows without a number included.

    Blank texts have no rows. Each text goes to one reader, so the two branches share no document.
    """
    docs = reports.select("doc_id", "content", F.coalesce(tabular.looks_delimited(F.col("content")), F.lit(False)).alias("delimited"))
    table = resolve(parsed(tabular.rows(docs.filter("delimited")))).withColumn("parser", F.lit("csv"))
    running = text.readings(docs.filter("not delimited")).withColumn("parser", F.lit("text"))
    return table.select(*READING).unionByName(running.select(*READING))
