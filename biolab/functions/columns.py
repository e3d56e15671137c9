"""Column functions: numbers, comparators, units, names, ranges, redaction. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V

#: What a plain float may look like; casts alone accept more (``5d``, hexadecimal, blanks).
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Unicode's white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
COMPARATORS = "^(<=)*(>=)*<*>*≤*≥*"


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(BLANKS))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def once(*cols) -> Column:
    """The columns as one generated row: what uses them later doesn't compute them again, as it may where projections are merged."""
    return F.inline(F.array(F.struct(*cols)))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it: in nested expressions copies of copies are too much to compile."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def to_double(c: Column) -> Column:
    return F.when(c.rlike(FLOAT), c.try_cast("double"))


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def parse_number(raw: Column) -> Column:
    """struct<value double, ambiguous boolean, strategy string>; all null where there is no number.

    With both separators the last one is decimal. One comma with three digits behind it groups thousands,
    ambiguously, as one dot with three digits is a decimal point, ambiguously.
    """
    p = trim(F.regexp_replace(trim(raw), COMPARATORS, ""))
    commas, dots = _count(p, ","), _count(p, ".")
    behind, behind_dot = F.substring_index(p, ",", -1), F.substring_index(p, ".", -1)
    no_commas, no_dots = F.replace(p, F.lit(","), F.lit("")), F.replace(p, F.lit("."), F.lit(""))
    swapped = F.replace(p, F.lit(","), F.lit("."))
    three, three_dot = behind.rlike("^[0-9]{3}$"), behind_dot.rlike("^[0-9]{3}$")
    both, comma_last = (commas > 0) & (dots > 0), F.length(behind) < F.length(behind_dot)
    text = (
        F.when(both & comma_last, F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(both, no_commas)
        .when((commas > 1) | ((commas == 1) & three), no_commas)
        .when(commas == 1, swapped)
        .when(dots > 1, no_dots)
        .otherwise(p)
    )
    strategy = (
        F.when(both, F.when(comma_last, "decimal_comma").otherwise("decimal_dot"))
        .when((commas > 1) | ((commas == 1) & three), "thousands_comma")
        .when(commas == 1, "decimal_comma")
        .when(dots > 1, "thousands_dot")
        .when(dots == 1, "decimal_dot")
        .otherwise("plain")
    )
    ambiguous = ~both & (((commas == 1) & ~F.octet_length(behind).between(1, 2)) | ((commas == 0) & (dots == 1) & three_dot))
    value = to_double(text)
    got = value.isNotNull()
    return F.struct(value.alias("value"), F.when(got, ambiguous).alias("ambiguous"), F.when(got, strategy).alias("strategy"))


def with_number(df: DataFrame, raw: str, **more: Column) -> DataFrame:
    """Adds value, number_ambiguous and strategy of the column ``raw``, as of ``parse_number``, and ``more``, all computed once."""
    kept, n = [quoted(c) for c in df.columns], parse_number(quoted(raw))
    added = {"value": n["value"], "number_ambiguous": n["ambiguous"], "strategy": n["strategy"], **more}
    return df.select(*kept, *(c.alias(k) for k, c in added.items())).select(*kept, once(*added))


def parse_number_with_hint(raw: Column, typical_max: Column) -> Column:
    """As ``parse_number``; an ambiguous reading far from a typical maximum is read the other way if that fits it."""
    n = parse_number(raw)
    p = trim(F.regexp_replace(trim(raw), COMPARATORS, ""))
    other_decimal = to_double(F.replace(p, F.lit(","), F.lit(".")))
    other_thousands = to_double(F.replace(p, F.lit("."), F.lit("")))
    lower = n["ambiguous"] & (n["strategy"] == "thousands_comma") & (n["value"] > 10 * typical_max) & (other_decimal <= 2 * typical_max)
    higher = n["ambiguous"] & (n["strategy"] == "decimal_dot") & (n["value"] < typical_max / 100) & other_thousands.between(typical_max / 10, 2 * typical_max)
    return F.struct(
        F.when(lower, other_decimal).when(higher, other_thousands).otherwise(n["value"]).alias("value"),
        n["ambiguous"].alias("ambiguous"),
        F.when(lower, "decimal_comma").when(higher, "thousands_dot").otherwise(n["strategy"]).alias("strategy"),
    )


def comparator(mark: Column) -> Column:
    return F.when(mark.isin("<", ">", "<=", ">="), mark).when(mark == "≤", "<=").when(mark == "≥", ">=").otherwise("=")


def split_comparator(raw: Column) -> Column:
    """struct<comparator, rest>: the comparator before a value, ``=`` where there is none."""
    mark = F.regexp_extract(trim(raw), "^(<=|>=|≤|≥|<|>)?", 1)
    return F.struct(comparator(mark).alias("comparator"), trim(F.regexp_replace(trim(raw), "^(<=|>=|≤|≥|<|>)", "")).alias("rest"))


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


UNIT_FORMS = [(form, unit) for unit, forms in V.UNITS for form in forms]


def normalize_unit(raw: Column) -> Column:
    """The canonical unit; unknown ones as they are, trimmed."""
    t = trim(raw)
    clean = F.regexp_replace(F.translate(F.lower(t), "×*^", "xx"), r"(?U)\s", "")
    return F.coalesce(_lookup(UNIT_FORMS, clean), t)


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace("(", r"\(").replace(")", r"\)") for w in words) + ")"


def _without_noise(s: Column) -> Column:
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")

    def kept(words: Column) -> Column:
        rest = F.filter(words, lambda w: ~w.isin(V.NOISE_WORDS))
        return let(rest, lambda k: F.when((F.size(k) > 0) & (F.size(k) < F.size(words)), F.array_join(k, " ")).otherwise(s))

    return let(words, kept)


def normalize_name(raw: Column) -> Column:
    """A marker's name for lookup: translation, specimen, method, abbreviation, spelling, noise words, dashes.

    A name is trimmed once; each step that takes a part away takes the blanks beside it too. Cheap tests keep most names from most patterns.
    """
    where = lambda has, f: lambda s: F.when(has(s), f(s)).otherwise(s)
    cut = lambda pattern: lambda s: F.regexp_replace(s, pattern, "")
    in_brackets = lambda s: s.endswith(")")
    abbreviation = r"\(([^( ]*)\)$"
    steps = (
        lambda s: F.coalesce(_lookup(V.ITALIAN, s), s),
        cut(r"(?U)^" + _any(V.SPECIMEN_PREFIXES) + r"\s*"),
        where(lambda s: F.contains(s, F.lit(",")), cut(r"(?U)\s*" + _any(V.COMMA_SUFFIXES) + "$")),
        where(lambda s: F.contains(s, F.lit(" ")), cut(r"(?U)\s*" + _any(V.SPACE_SUFFIXES) + "$")),
        where(in_brackets, cut(r"(?U)\s*" + _any([f"({m})" for m in V.METHODS]) + "$")),
        where(lambda s: in_brackets(s) & (F.octet_length(F.regexp_extract(s, abbreviation, 1)) <= 10), cut(r"(?U)\s*" + abbreviation)),
        lambda s: reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), V.SPELLINGS, s),
        where(lambda s: s.rlike(r"(?U)\s"), _without_noise),
        lambda s: F.translate(s, "–—", "--"),
    )
    return reduce(let, steps, F.lower(trim(raw)))


def parse_reference_range(raw: Column) -> Column:
    """struct<lo double, hi double>, infinite where open; null where it is no range."""
    s = trim(F.regexp_replace(F.regexp_replace(trim(raw), r"^\(+", ""), r"\)+$", ""))
    inf = F.lit(float("inf"))
    bound = to_double(trim(F.regexp_replace(s, "^[<>]=?", "")))
    spaced = F.instr(s, " - ")
    dash = F.when(spaced > 0, spaced + 1).otherwise(F.instr(s, "-"))
    lo = to_double(trim(F.substring(s, F.lit(1), dash - 1)))
    hi = to_double(trim(F.substring(s, dash + 1, F.length(s))))
    lo, hi = (
        F.when(s.startswith("<"), F.when(bound.isNotNull(), -inf)).when(s.startswith(">"), bound).when(dash > 1, F.when(hi.isNotNull(), lo)),
        F.when(s.startswith("<"), bound).when(s.startswith(">"), F.when(bound.isNotNull(), inf)).when(dash > 1, F.when(lo.isNotNull(), hi)),
    )
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def display_value(v: Column) -> Column:
    """No decimals for whole numbers under a million, else two."""
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e6), F.format_string("%.0f", v)).otherwise(F.format_string("%.2f", v))


def redact(text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), V.REDACTIONS, text)


def patient_id(text: Column) -> Column:
    """The first identity number of a page, in upper case."""
    return F.coalesce(*[F.nullif(F.upper(F.regexp_extract(text, p, 1)), F.lit("")) for p in V.PATIENT_IDS])


def name_token(name: Column) -> Column:
    """The longest run of four letters or more (bytes count; the last of equals), else the whole name; lower case."""
    low = F.lower(name)
    words = F.filter(F.split(low, r"[^\p{L}]+"), lambda w: F.octet_length(w) >= 4)
    best = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.octet_length(w) >= F.octet_length(a), w).otherwise(a))
    return F.when(best == "", low).otherwise(best)


def value_variants(value: Column) -> Column:
    """Texts that a value may be written as: 4.10 also as 4.1, 5 also as 5.0."""
    cut = F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.+$", "")
    more = F.when(F.instr(value, ".") > 0, F.when((cut != value) & (cut != ""), cut)).when(value != "", F.concat(value, F.lit(".0")))
    return F.array_compact(F.array(value, more))
