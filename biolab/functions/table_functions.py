"""Table functions for SQL: rows that a text holds, from a TABLE argument."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from biolab.operators.text import found


class ReportTokens:
    """``report_tokens(TABLE(t))``: the matches of each layout in the texts of a table with doc_id and content, as of ``text.candidates``."""

    @staticmethod
    def analyze(reports: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(reports.dataType, StructType) or not {"doc_id", "content"} <= set(reports.dataType.names):
            raise ValueError("report_tokens takes a table with doc_id and content")
        out = StructType().add("doc_id", reports.dataType["doc_id"].dataType).add("layout", IntegerType()).add("start", LongType()).add("end", LongType())
        for c in ("raw_name", "mark", "raw_value", "raw_unit"):
            out = out.add(c, StringType())
        return AnalyzeResult(out)

    def eval(self, row):
        for match in found(row["content"]):
            yield (row["doc_id"], *match)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("report_tokens", udtf(ReportTokens))
