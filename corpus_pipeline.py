"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it back, so a lost
executor costs one stage's tasks at most.

Defined cases, for all stages: an empty table stays empty, extra columns stay, whatever their names, and other columns than doc_id, text
and source may be null in any row. What each stage makes of null, empty and very long texts, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biolab.llm import decontaminate, line_dedup, mixing, near_dedup, quality_gam
from biolab.llm._scratch import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject.

    A null text is scored as an empty one; repeated rows share one score and stay or go together; a score at the limit stays. Whole texts
    are read, however long. Without labelled documents none is rejected.
    """
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their hosts' boilerplate lines; n_chars follows the text.

    A null text stays null, an empty one empty, and a text of boilerplate only becomes empty. Rows with one text count as one page, so
    repeated rows make nothing boilerplate. A null source is a host of its own; a line exactly at the limit stays.
    """
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Null texts and texts without a word are near nothing and stay. Repeated rows (one doc_id, one text) are one document and all
    stay; texts of one doc_id that differ are one document too, and go or stay together. A similarity of exactly 0.75 is a link.
    """
    return near_dedup.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay, as do all documents if the benchmark is empty; repeated rows go or stay together; whole texts are
    searched, however long, and a containment exactly at the limit is a leak.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights ask for, numbered in mix_copy.

    A null or empty text has size 0 and is taken at its source's rate; a null source is a source; repeated rows are taken alike, each
    with copy numbers of its own. Sources that tie in size per weight share one level.
    """
    return mixing.mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("leaks", leaks), ("mixed", mixed)]

#: A trained classifier decides the first stage, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
