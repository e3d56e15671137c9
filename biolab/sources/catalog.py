"""The marker catalog: a small seed of our own, and catalogs in TOML from a configured path.

``$BIOLAB_CATALOG`` names a TOML file that is laid over the seed (``none`` turns overlays off). A later entry
wins for its id, component, display name and aliases; spellings of its id with blanks or dashes are
added only where no name is taken, and old aliases of an overridden id stay.
"""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biolab.functions import columns

#: id, component, display name, category, LOINC code, aliases, allowed units
SEED = [
    ("fasting_glucose", "Glucose", "Fasting Glucose", "metabolic", "1558-6", ["glucose", "blood sugar", "glucose, fasting"], ["mg/dL", "mmol/L"]),
    ("hba1c", "Hemoglobin A1c", "HbA1c", "metabolic", "4548-4", ["a1c", "glycated hemoglobin"], ["%", "mmol/mol"]),
    ("insulin", "Insulin", "Fasting Insulin", "metabolic", "2484-4", ["fasting insulin"], ["mIU/L", "pmol/L", "mIU/mL"]),
    ("uric_acid", "Urate", "Uric Acid", "metabolic", "3084-1", ["urate"], ["mg/dL", "µmol/L"]),
    ("total_cholesterol", "Cholesterol", "Total Cholesterol", "lipids", "2093-3", ["cholesterol, total", "tc"], ["mg/dL", "mmol/L"]),
    ("ldl_cholesterol", "Cholesterol in LDL", "LDL Cholesterol", "lipids", "13457-7", ["ldl", "ldl-c"], ["mg/dL", "mmol/L"]),
    ("hdl_cholesterol", "Cholesterol in HDL", "HDL Cholesterol", "lipids", "2085-9", ["hdl", "hdl-c"], ["mg/dL", "mmol/L"]),
    ("triglycerides", "Triglyceride", "Triglycerides", "lipids", "2571-8", ["tg", "trigs"], ["mg/dL", "mmol/L"]),
    ("apolipoprotein_b", "Apolipoprotein B", "ApoB", "lipids", "1884-6", ["apo b"], ["mg/dL", "g/L"]),
    ("tc_hdl_ratio", "Cholesterol.total/HDL", "TC/HDL Ratio", "lipids", "9830-1", ["cholesterol/hdl ratio"], ["ratio", ""]),
    ("alt", "Alanine aminotransferase", "ALT", "liver", "1742-6", ["sgpt"], ["U/L"]),
    ("ast", "Aspartate aminotransferase", "AST", "liver", "1920-8", ["sgot"], ["U/L"]),
    ("alp", "Alkaline phosphatase", "ALP", "liver", "6768-6", ["alk phos"], ["U/L"]),
    ("albumin", "Albumin", "Albumin", "liver", "1751-7", [], ["g/dL", "g/L"]),
    ("total_bilirubin", "Bilirubin", "Total Bilirubin", "liver", "1975-2", ["bilirubin"], ["mg/dL", "µmol/L"]),
    ("hemoglobin", "Hemoglobin", "Hemoglobin", "hematology", "718-7", ["hgb", "hb"], ["g/dL", "g/L"]),
    ("hematocrit", "Hematocrit", "Hematocrit", "hematology", "4544-3", ["hct", "pcv"], ["%", "L/L"]),
    ("wbc_count", "Leukocytes", "WBC Count", "hematology", "6690-2", ["wbc", "white blood cells"], ["x10^9/L"]),
    ("platelets", "Platelets", "Platelets", "hematology", "777-3", ["plt", "platelet count"], ["x10^9/L"]),
    ("neutrophils_pct", "Neutrophils/100 leukocytes", "Neutrophils %", "hematology", "770-8", ["neutrophils"], ["%"]),
    ("lymphocytes_pct", "Lymphocytes/100 leukocytes", "Lymphocytes %", "hematology", "736-9", ["lymphocytes"], ["%"]),
    ("monocytes_pct", "Monocytes/100 leukocytes", "Monocytes %", "hematology", "5905-5", ["monocytes"], ["%"]),
    ("eosinophils_pct", "Eosinophils/100 leukocytes", "Eosinophils %", "hematology", "713-8", ["eosinophils"], ["%"]),
    ("basophils_pct", "Basophils/100 leukocytes", "Basophils %", "hematology", "706-2", ["basophils"], ["%"]),
    ("creatinine", "Creatinine", "Creatinine", "kidney", "2160-0", ["creat"], ["mg/dL", "µmol/L"]),
    ("egfr", "Glomerular filtration rate", "eGFR", "kidney", "33914-3", ["gfr"], ["mL/min/1.73m²"]),
    ("tsh", "Thyrotropin", "TSH", "thyroid", "3016-3", ["thyroid stimulating hormone"], ["mIU/L"]),
    ("free_t4", "Thyroxine free", "Free T4", "thyroid", "3024-7", ["ft4"], ["ng/dL", "pmol/L"]),
    ("vitamin_d", "25-hydroxyvitamin D", "Vitamin D", "vitamins", "1989-3", ["25-oh vitamin d"], ["ng/mL", "nmol/L"]),
    ("hscrp", "C-Reactive Protein", "hsCRP", "inflammation", "30522-7", ["hs-crp", "c reactive protein"], ["mg/L", "mg/dL"]),
    ("standard_crp", "C-Reactive Protein", "CRP (Standard)", "inflammation", "1988-5", [], ["mg/L", "mg/dL"]),
    ("total_protein", "Protein", "Total Protein", "liver", "2885-2", [], ["g/dL", "g/L"]),
    ("urine_protein", "Protein in urine", "Urine Protein", "kidney", "2888-6", [], ["mg/dL", "mg/L"]),
]

#: The names of C-reactive protein, their ids, bounds and default decide results.
#: ambiguous name, default id, ordered candidates (id, units, value below, value above)
SEED_AMBIGUOUS = [
    ("crp", "hscrp", [("hscrp", ["mg/L", "mg/dL"], 10.0, None), ("standard_crp", ["mg/L", "mg/dL"], None, 10.0)]),
    ("protein", "total_protein", [("total_protein", ["g/dL", "g/L"], None, None), ("urine_protein", ["mg/dL", "mg/L"], None, None)]),
    ("c-reactive protein", "hscrp", [("hscrp", ["mg/L", "mg/dL"], 10.0, None), ("standard_crp", ["mg/L", "mg/dL"], None, 10.0)]),
    ("c reactive protein", "hscrp", [("hscrp", ["mg/L", "mg/dL"], 10.0, None), ("standard_crp", ["mg/L", "mg/dL"], None, 10.0)]),
    ("glucose", "fasting_glucose", [("fasting_glucose", ["mg/dL"], None, 20.0), ("fasting_glucose", ["mmol/L"], 40.0, None)]),
]

#: specimens of seed markers that aren't measured in serum
SPECIMENS = {"hba1c": "blood", "hemoglobin": "blood", "hematocrit": "blood", "wbc_count": "blood", "platelets": "blood", "urine_protein": "urine"}

MARKER = "seq int, id string, component string, display_name string, category string, loinc string, aliases array<string>, allowed_units array<string>, specimen string, qualifier string"
AMBIGUOUS = "ambiguous_name string, default_id string, candidates array<struct<id: string, units: array<string>, below: double, above: double>>"


def overlay_entries(path: str | None = None) -> tuple[list, list]:
    """(markers, ambiguous names) of a TOML catalog; empty where there is none."""
    path = path or os.environ.get("BIOLAB_CATALOG", "none")
    if path == "none":
        return [], []
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    markers = [(m["id"], m.get("component", ""), m.get("display_name", ""), m.get("category", ""), m.get("loinc", ""), m.get("aliases", []), m.get("allowed_units", []), m.get("specimen", "serum"), m.get("qualifier", "")) for m in raw.get("marker", [])]
    ambiguous = [
        (d["ambiguous_name"], d["default_id"], [(c["id"], c.get("when_unit_in", []), c.get("when_value_below"), c.get("when_value_above")) for c in d.get("candidates", [])])
        for d in raw.get("disambiguation", [])
    ]
    return markers, ambiguous


def entries(path: str | None = None) -> tuple[list, list]:
    more, ambiguous = overlay_entries(path)
    return [*SEED, *more], [*SEED_AMBIGUOUS, *ambiguous]


def table(spark: SparkSession, rows: list) -> DataFrame:
    """All entries; seed entries have the specimen of SPECIMENS or serum, and no qualifier."""
    full = [(i, *r[:7], *(r[7:] or (SPECIMENS.get(r[0], "serum"), ""))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, MARKER)


def markers(spark: SparkSession, rows: list) -> DataFrame:
    """Entries in order; the last of each id counts."""
    df = table(spark, rows)
    last = df.groupBy("id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "id"]), "seq").alias("m")).select("id", "m.*")
    units = F.array_union(F.transform("allowed_units", F.lower), F.transform("allowed_units", lambda u: F.lower(columns.normalize_unit(u))))
    return last.withColumn("unit_forms", units)


def aliases(spark: SparkSession, rows: list) -> DataFrame:
    """(alias, id): every name a marker goes by; the later entry wins, spellings of ids only fill gaps."""
    df = table(spark, rows)
    own = F.array_union(F.array(F.lower("id")), F.filter(F.array(F.lower("component"), F.lower("display_name")), lambda x: x != ""))
    own = df.select("seq", "id", F.posexplode(F.concat(own, F.transform("aliases", F.lower))).alias("k", "alias"), F.lit(1).alias("strong"))
    spelled = F.array(F.replace(F.lower("id"), F.lit("_"), F.lit(" ")), F.replace(F.lower("id"), F.lit("_"), F.lit("-")))
    spelled = df.select((-F.col("seq")).alias("seq"), "id", F.posexplode(spelled).alias("k", "alias"), F.lit(0).alias("strong"))
    every = own.unionByName(spelled)
    return every.groupBy("alias").agg(F.max_by("id", F.struct("strong", "seq", "k")).alias("id"))


def ambiguous(spark: SparkSession, rows: list) -> DataFrame:
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, " + AMBIGUOUS)
    last = df.groupBy(F.lower("ambiguous_name").alias("ambiguous_name")).agg(F.max_by(F.struct("default_id", "candidates"), "seq").alias("d"))
    return last.select("ambiguous_name", "d.*")


def categories(marker_rows: DataFrame) -> DataFrame:
    return marker_rows.filter("category <> ''").groupBy("category").agg(F.count("*").alias("n_markers")).orderBy("category")


def listing(marker_rows: DataFrame, category: str | None = None) -> DataFrame:
    """The catalog, or one category of it, in order of id."""
    df = marker_rows if category is None else marker_rows.filter(F.col("category") == category)
    return df.select("id", "display_name", "category", "loinc", F.coalesce(F.nullif(F.array_join("allowed_units", ", "), F.lit("")), F.lit("-")).alias("units"), F.size("aliases").alias("alias_count")).orderBy("id")


def listing_json(marker_rows: DataFrame, category: str | None = None) -> DataFrame:
    """(id, item): a JSON text of eight keys for each marker, in order of id."""
    df = marker_rows if category is None else marker_rows.filter(F.col("category") == category)
    item = F.struct("id", "display_name", "component", "specimen", "allowed_units", "category", "loinc", F.size("aliases").alias("alias_count"))
    return df.select("id", F.to_json(item).alias("item")).orderBy("id")


def descriptor(spark: SparkSession, rows: list) -> DataFrame:
    """One row: what the engine reads, writes and knows."""
    known = markers(spark, rows).agg(
        F.count("*").alias("biomarker_count"), F.sort_array(F.collect_set(F.when(F.col("category") != "", F.col("category")))).alias("categories")
    )
    names = aliases(spark, rows).agg(F.count("*").alias("alias_count"))
    fixed = {"name": "biolab", "version": "0.2", "input_formats": ["pdf", "csv", "text", "stdin"], "output_formats": ["json", "table"]}
    cols = [(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in fixed.items()]
    return known.join(F.broadcast(names)).select(*cols, "biomarker_count", "alias_count", "categories")
