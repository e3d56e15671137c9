"""Lab-shaped projections of the order tables: one measurement for each line, and reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biolab.session import read_at_most

#: raw name, plain unit, another way to write the unit
NAMES = [
    ("Glucose, Fasting", "mg/dL", "mg/dl."), ("Haemoglobin", "g/dL", "gm/dl"), ("HbA1c (HPLC)", "%", "percent"), ("Serum Creatinine", "mg/dL", "MG/DL"),
    ("LDL", "mg/dL", "mg / dl"), ("HDL Cholesterol", "mg/dL", "mg/dl"), ("Colesterolo Totale", "mg/dL", "mg/dl"), ("Triglycerides Level", "mg/dL", "mmol/L"),
    ("Alanine Aminotransferase (ALT)", "U/L", "IU/L"), ("AST Test", "U/L", "iu/l"), ("CRP", "mg/L", "mg/dL"), ("Protein", "g/L", "mg/L"),
    ("TSH", "mIU/L", "µIU/L"), ("WBC", "x10^9/L", "K/uL"), ("Platelet Count", "×10^9 /L", "thou/ul"), ("Neutrophils", "%", "percent"),
    ("Lymphocytes", "%", "%"), ("Monocytes", "%", "%"), ("Eosinophils, Blood", "%", "%"), ("Basophils", "%", "%"),
    ("TC/HDL Ratio", "ratio", ""), ("Vitamin D", "ng/mL", "ug/l"), ("C-Reactive Protein", "mg/L", "mg/l"), ("Total Bilirubin (Direct)", "mg/dL", "umol/l"),
    ("Unknown Factor X", "AU", "AU"), ("Glucose", "mg/dL", "mmol/L"), ("Free T4 Assay", "ng/dL", "pmol/l"), ("Albumin Plasma", "g/dL", "g/l"),
]
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
#: Lines that one task takes, with all that is made of their documents behind it.
SHARE = 150_000
#: Parts that Spark sends rows to without holding them (spark.shuffle.sort.bypassMergeThreshold); beyond, a task holds what it reads, and spills what it can't hold.
UNHELD = 200
#: MB of a file that a task then reads.
READ_MB = 32


def shares(table: DataFrame) -> int:
    """Parts to deal a table's rows to, so that a part doesn't grow with the table; one for each core at least. Counts rows, in footers where there are some."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // SHARE))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, patient_id, date, raw_name, raw_value, raw_unit), a document for each order.

    Rows are dealt by document once; windows and aggregates by document behind it need no further exchange.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = shares(lines)
    if n > UNHELD:
        read_at_most(spark, READ_MB)
    lines = lines.select("l_orderkey", *ORDER, "l_quantity", "l_discount").repartition(n, "l_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate").repartition(n, "o_orderkey").hint("shuffle_hash")
    q, d = F.col("l_quantity").cast("int"), F.abs(F.round(F.col("l_discount") * 100)).cast("int")
    three = F.lpad(q.cast("string"), 3, "0")
    value = F.element_at(
        F.array(
            q.cast("string"), F.concat(q, F.lit("."), F.lpad(d.cast("string"), 2, "0")), F.concat(q, F.lit(","), d), F.concat(F.lit("<"), q), F.concat(F.lit(">= "), q, F.lit(".5")),
            F.concat(F.lit("1,"), three), F.concat(F.lit(" 1."), three, F.lit(","), d), F.concat(q, F.lit("."), F.lpad(d.cast("string"), 3, "0")), F.concat(F.lit("n/a "), q), F.concat(F.lit("≤"), q),
        ),
        (F.col("l_suppkey") % 10 + 1).cast("int"),
    )
    pick = lambda i: F.element_at(F.array(*[F.lit(n[i]) for n in NAMES]), (F.col("l_partkey") % len(NAMES) + 1).cast("int"))
    unit = F.when(F.col("l_linenumber") % 4 == 3, F.lit("")).when(F.col("l_linenumber") % 4 == 2, pick(2)).otherwise(pick(1))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("doc_id"), rank.alias("ord"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").cast("date").alias("date"),
        pick(0).alias("raw_name"), value.alias("raw_value"), unit.alias("raw_unit"),
    )


HEADS = {"comma": ("Test Name,Result,Units\n", ","), "semicolon": ("Test Name;Result;Units\n", ";"), "tab": ("Test Name\tResult\tUnits\n", "\t")}


def in_order(m: DataFrame, line: Column, sep: str, head: Column | None = None) -> DataFrame:
    """(doc_id, content): the lines of a document joined in order of ``ord``, behind ``head``, an expression of doc_id."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    text = m.select("doc_id", "ord", line.alias("line")).groupBy("doc_id").agg(F.array_join(rows, sep).alias("content"))
    return text if head is None else text.select("doc_id", F.concat(head, "content").alias("content"))


def reports(m: DataFrame, layout: str | list[str] = "text") -> DataFrame:
    """(doc_id, content): a document's measurements as running text, in two lines each third one (``hub``), or as a delimited table. At most 17 rows make one.

    Of a list of delimited layouts a document has the one that its doc_id, modulo their number, names, the last if that is negative.
    """
    if layout in ("text", "hub"):
        line = F.concat_ws(" ", F.concat("raw_name", F.lit(":")), "raw_value", "raw_unit")
        if layout == "hub":
            line = F.when(F.col("ord") % 3 == 0, F.concat("raw_name", F.lit("\nResults: "), "raw_value", F.lit(" ("), "raw_unit", F.lit(")"))).otherwise(line)
        return in_order(m, line, "\n")
    layouts = [layout] if isinstance(layout, str) else layout
    of = lambda i: F.coalesce(F.get(F.array(*[F.lit(HEADS[k][i]) for k in layouts]), (F.col("doc_id") % len(layouts)).cast("int")), F.lit(HEADS[layouts[-1]][i]))
    head, sep = (F.lit(HEADS[layouts[0]][i]) if len(layouts) == 1 else of(i) for i in (0, 1))
    quoted = F.concat(F.lit('"'), F.col("raw_name"), F.lit('"'))
    name = F.when(F.contains("raw_name", sep), quoted).otherwise(F.col("raw_name"))
    line = F.call_function("concat_ws", sep, name, F.concat(F.lit('"'), "raw_value", F.lit('"')), F.col("raw_unit"))
    return in_order(m, line, "\n", head)
