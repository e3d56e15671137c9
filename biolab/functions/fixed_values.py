"""Lists, tables and patterns that results depend on. They are stated as they are, in natural order."""

# Spellings, replaced in this order anywhere in a name.
SPELLINGS = [
    ("haemoglobin", "hemoglobin"), ("haematocrit", "hematocrit"), ("haematology", "hematology"),
    ("oestradiol", "estradiol"), ("oestrogen", "estrogen"), ("oestriol", "estriol"),
    ("foetal", "fetal"), ("faecal", "fecal"), ("tumour", "tumor"), ("colour", "color"),
    ("behaviour", "behavior"), ("fibre", "fiber"), ("centre", "center"), ("litre", "liter"),
    ("metre", "meter"), ("sulphate", "sulfate"), ("aluminium", "aluminum"), ("anaemia", "anemia"),
    ("leukaemia", "leukemia"), ("leucocyte", "leukocyte"), ("leucocytes", "leukocytes"),
    ("diarrhoea", "diarrhea"), ("coeliac", "celiac"), ("paediatric", "pediatric"),
    ("programme", "program"), ("glycosylated", "glycated"),
]

# Specimens before a name, behind a comma, behind a space.
SPECIMEN_PREFIXES = ["serum ", "plasma ", "whole blood ", "blood ", "urine ", "csf ", "cerebrospinal fluid ", "saliva ", "capillary ", "venous ", "arterial "]
COMMA_SUFFIXES = [", serum", ", plasma", ", whole blood", ", blood", ", urine", ", random"]
SPACE_SUFFIXES = [" serum", " plasma", " whole blood"]

# Methods in brackets behind a name.
METHODS = [
    "enzymatic", "jaffe", "ckd-epi", "ckd-epi 2021", "mdrd", "calculated", "direct", "indirect", "immunoassay",
    "hplc", "chemiluminescence", "elisa", "turbidimetric", "nephelometric", "colorimetric", "electrochemiluminescence",
    "ecl", "eia", "ria", "clia", "ifcc", "ngsp", "friedewald", "martin-hopkins",
]

# Words that a name of several words loses.
NOISE_WORDS = [
    "level", "levels", "test", "assay", "measurement", "determination", "analysis", "panel", "profile",
    "screen", "screening", "quantitative", "qualitative", "automated", "manual",
]

# Whole Italian names.
ITALIAN = [
    ("colesterolo totale", "total cholesterol"), ("colesterolo hdl", "hdl cholesterol"), ("colesterolo ldl", "ldl cholesterol"),
    ("trigliceridi", "triglycerides"), ("emoglobina", "hemoglobin"), ("emoglobina glicata", "hba1c"), ("ematocrito", "hematocrit"),
    ("eritrociti", "rbc count"), ("leucociti", "wbc count"), ("piastrine", "platelets"), ("glucosio", "fasting glucose"),
    ("glicemia", "fasting glucose"), ("creatinina", "creatinine"), ("acido urico", "uric acid"), ("bilirubina totale", "total bilirubin"),
    ("bilirubina diretta", "direct bilirubin"), ("transaminasi got", "ast"), ("transaminasi gpt", "alt"), ("fosfatasi alcalina", "alp"),
    ("gamma gt", "ggt"), ("azotemia", "urea"), ("sideremia", "iron"), ("ferritina", "ferritin"), ("vitamina d", "vitamin d"),
    ("vitamina b12", "vitamin b12"), ("acido folico", "folic acid"), ("proteina c reattiva", "hscrp"),
    ("velocita di eritrosedimentazione", "esr"), ("ves", "esr"), ("tireotropina", "tsh"), ("tiroxina libera", "free t4"),
    ("triiodotironina libera", "free t3"), ("testosterone totale", "testosterone"), ("antigene prostatico specifico", "total psa"),
    ("sodio", "sodium"), ("potassio", "potassium"), ("calcio", "calcium"), ("magnesio", "magnesium"), ("fosforo", "phosphate"),
    ("cloro", "chloride"), ("albumina", "albumin"), ("proteine totali", "total protein"), ("fibrinogeno", "fibrinogen"),
    ("omocisteina", "homocysteine"),
]

# Canonical units and the cleaned forms that mean them (lower case; no white space, no ^; x for a multiplication sign).
UNITS = [
    ("mg/dL", ["mg/dl", "mg/dl."]), ("ng/mL", ["ng/ml", "ng/ml.", "ug/l", "µg/l", "mcg/l"]), ("pg/mL", ["pg/ml", "pg/ml.", "ng/l"]),
    ("µg/dL", ["ug/dl", "µg/dl", "mcg/dl"]), ("mg/L", ["mg/l"]), ("g/L", ["g/l", "gm/l"]), ("g/dL", ["g/dl", "gm/dl"]),
    ("mmol/L", ["mmol/l", "mmol/l."]), ("µmol/L", ["umol/l", "µmol/l", "mcmol/l"]), ("nmol/L", ["nmol/l", "nmol/l."]),
    ("pmol/L", ["pmol/l", "pmol/l."]), ("mmol/mol", ["mmol/mol"]), ("U/L", ["iu/l", "u/l", "iu/l."]), ("U/mL", ["iu/ml", "u/ml"]),
    ("kU/L", ["ku/l", "kiu/l"]), ("mIU/L", ["miu/l", "uiu/l", "µiu/l"]), ("mIU/mL", ["miu/ml", "uiu/ml", "µiu/ml"]),
    ("x10^9/L", ["x109/l", "109/l", "x10e9/l", "thou/ul", "k/ul", "x109/l."]), ("/µL", ["/ul", "/µl"]),
    ("x10^12/L", ["x1012/l", "1012/l", "x10e12/l", "m/ul", "mil/ul"]), ("mL/min/1.73m²", ["ml/min/1.73m2", "ml/min/1.73m²", "ml/min/1.73m2."]),
    ("mL/min", ["ml/min"]), ("fL", ["fl", "fl."]), ("pg", ["pg", "pg."]), ("L/L", ["l/l"]), ("mm/hr", ["mm/hr", "mm/h", "mm/hr."]),
    ("mEq/L", ["meq/l"]), ("s", ["seconds", "sec", "secs"]), ("%", ["%", "percent"]), ("ratio", ["ratio"]), ("µg", ["mcg", "ug", "µg"]),
    ("mg", ["mg"]), ("titer", ["titer"]), ("/HPF", ["/hpf"]), ("cells/µL", ["cells/ul", "cells/µl"]), ("pH", ["ph"]),
]

# Fixed values: (marker, unit, hard low, hard high, soft low, soft high).
PLAUSIBILITY = [
    ("fasting_glucose", "mg/dL", 20.0, 800.0, 50.0, 250.0), ("fasting_glucose", "mmol/L", 1.1, 44.4, 2.8, 13.9),
    ("glucose", "mg/dL", 20.0, 800.0, 50.0, 300.0), ("glucose", "mmol/L", 1.1, 44.4, 2.8, 16.7),
    ("hba1c", "%", 2.0, 20.0, 3.5, 14.0), ("hba1c", "mmol/mol", 4.0, 195.0, 15.0, 130.0),
    ("total_cholesterol", "mg/dL", 30.0, 700.0, 80.0, 400.0), ("total_cholesterol", "mmol/L", 0.78, 18.1, 2.0, 10.3),
    ("ldl_cholesterol", "mg/dL", 10.0, 600.0, 30.0, 350.0), ("ldl_cholesterol", "mmol/L", 0.26, 15.5, 0.78, 9.0),
    ("hdl_cholesterol", "mg/dL", 5.0, 200.0, 15.0, 120.0), ("hdl_cholesterol", "mmol/L", 0.13, 5.2, 0.39, 3.1),
    ("triglycerides", "mg/dL", 10.0, 5000.0, 30.0, 1000.0), ("triglycerides", "mmol/L", 0.11, 56.5, 0.34, 11.3),
    ("alt", "U/L", 1.0, 5000.0, 5.0, 500.0), ("ast", "U/L", 1.0, 5000.0, 5.0, 500.0), ("alp", "U/L", 10.0, 2000.0, 30.0, 500.0),
    ("albumin", "g/dL", 1.0, 7.0, 2.5, 5.5), ("albumin", "g/L", 10.0, 70.0, 25.0, 55.0),
    ("total_bilirubin", "mg/dL", 0.05, 50.0, 0.1, 5.0), ("total_bilirubin", "umol/L", 0.85, 855.0, 1.7, 85.0),
    ("hemoglobin", "g/dL", 3.0, 25.0, 8.0, 20.0), ("hemoglobin", "g/L", 30.0, 250.0, 80.0, 200.0), ("hematocrit", "%", 10.0, 75.0, 25.0, 60.0),
    ("wbc_count", "x10^9/L", 0.1, 200.0, 1.0, 50.0), ("platelet_count", "x10^9/L", 5.0, 2000.0, 30.0, 800.0),
    ("creatinine", "mg/dL", 0.1, 30.0, 0.3, 10.0), ("creatinine", "µmol/L", 9.0, 2650.0, 27.0, 884.0), ("tsh", "mIU/L", 0.001, 500.0, 0.1, 100.0),
    ("neutrophils_pct", "%", 0.0, 100.0, 5.0, 95.0), ("lymphocytes_pct", "%", 0.0, 100.0, 5.0, 80.0), ("monocytes_pct", "%", 0.0, 100.0, 0.0, 30.0),
    ("eosinophils_pct", "%", 0.0, 100.0, 0.0, 30.0), ("basophils_pct", "%", 0.0, 100.0, 0.0, 10.0),
]

# Column headings of delimited reports.
NAME_HEADERS = ["test name", "test", "analyte", "component", "biomarker", "marker", "name", "assay", "description", "test description", "lab test", "observation"]
VALUE_HEADERS = ["result", "value", "result value", "observed value", "test result", "numeric result", "reported value", "level"]
UNIT_HEADERS = ["unit", "units", "uom", "unit of measure", "reference unit", "result unit"]

# Words that are no marker's name.
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "was", "are"]

# A number in running text, and the three layouts of name and value (white space in them is part of the layout only).
NUMBER = r"(?P<value>\d{1,3}(?:[,.]\d{3})*(?:[,.]\d+)?|\d+(?:[.,]\d+)?)"
HUB = r"^[ \t]*(?P<name>[A-Za-z][A-Za-z0-9\-()/,.% \t]*[A-Za-z0-9)%])[ \t]*\n[ \t]*Results:\s*(?P<cmp><=|>=|[<>]|\*)?\s*" + NUMBER + r"\s*(?:\((?P<unit>[^)]+)\))?"
COLON = r"(?P<name>[A-Za-z0-9\-()/\s]{2,40})\s*:\s*(?P<cmp><=|>=|[<>])?" + NUMBER + r"\s*(?P<unit>ml/min/1\.73m[2²]|[a-zµ°/%²³]+(?:/[a-zµ°²³\d.]+)*)?"
GENERAL = (
    r"(?P<name>[A-Za-zα-ωΑ-Ω0-9\-()/]+(?:\s+[A-Za-zα-ωΑ-Ω\-()/]+){0,4})[\s:=]+(?P<cmp><=|>=|[<>])?" + NUMBER
    + r"\s*(?P<unit>%|ratio|score|mmol/mol|ml/min/1\.73m[2²]|x?10[\^e]?\d+/[a-z]+|[a-zµ°²³]+(?:/[a-zµ°²³\d.]+)*)?"
)

# Personal data to redact, in order, with what stands in its place.
REDACTIONS = [
    (r"(?i)\b[STFG]\d{7}[A-Z]\b", "<ID>"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "<SSN>"),
    (r"\b(?:DOB|D\.O\.B|Date of Birth)[:\s]*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "<DOB>"),
    (r"(?i)\b(?:MRN|patient\s+id|lab\s+no|ref\s+no)[:\s#]*[A-Z0-9-]+\b", "<MRN>"),
    (r"\b(?:\+?\d{1,3}[\s-]?)?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{4}\b", "<PHONE>"),
]
PATIENT_IDS = [r"(?i)\b([STFG]\d{7}[A-Z])\b", r"(?i)(?:MRN|I/C|IC|patient\s+id)[:\s#]*([A-Z0-9-]{6,})"]

# Report lines that are dropped, the heading that drops two more, and headings of sections that are dropped to the next blank line.
BOILERPLATE = [
    r"Page\s+\d+\s+of\s+\d+\s*$", r"Generated\s+On:", r"This is a computer generated document", r"Lab\s+Test\s+Result\s*$", r"(?:Ordering|Performing)\s+Facility:",
    r"Serum\s+Indices\b", r"(?:Not\s+)?(?:Haemolysed|Lipaemic|Icteric)", r"Date:\s+\d{1,2}\s+\w{3}\s+\d{4}", r"Ref\.?\s*Range\s*:",
]
REPORT_HEADING = r"Lab\s+Test\s+Result\s*$"
REMARKS_HEADING = r"(?:Remarks|Interpretation|Comments|Clinical Notes)\s*:\s*$"
SECTIONS = [
    "Remarks", "Interpretation", "Comments", "Clinical Notes", "Results", "Haematology", "Biochemistry", "Immunology", "Endocrinology", "Urinalysis",
    "Coagulation", "Serology", "Lipid", "Liver", "Kidney", "Thyroid", "Full Blood", "Complete Blood", "Metabolic",
]

# Keys that may hold the list in an extractor's answer.
ANSWER_KEYS = ["markers", "biomarkers", "results", "data"]
