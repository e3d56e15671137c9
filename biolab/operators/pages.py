"""Pages of report text: splitting, cleaning, dense pages, identity numbers. In DataFrame functions but for dense pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biolab.functions import columns
from biolab.functions import fixed_values as V


def split_pages(text: Column) -> Column:
    """Pages between form feeds, trimmed, without empty ones; the whole text if none is left."""
    parts = F.filter(F.transform(F.split(text, "\f"), columns.trim), lambda p: p != "")
    return columns.let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text), pages from 1."""
    return docs.select("doc_id", F.posexplode(split_pages(F.col("content"))).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("page"), "text")


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines to keep.

    Blank lines stay and end what is being skipped: the two lines after a report heading, and sections of
    remarks. So each run between blank lines is judged on its own, by running counts over its lines.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    t = columns.trim(F.col("line"))
    rule = lambda p: t.rlike(f"(?i)^(?:{p})")
    lines = lines.select("*", (t == "").alias("blank"), rule("|".join(V.BOILERPLATE)).alias("dropped"), rule(V.REPORT_HEADING).alias("heading"), rule(V.REMARKS_HEADING).alias("remarks"))
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("run", F.sum(F.col("blank").cast("int")).over(run))
    inside = Window.partitionBy("doc_id", "run").orderBy("line_no")
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("part", F.sum(F.col("heading").cast("int")).over(so_far))
    other = ~F.col("dropped") & ~F.col("blank")
    # the first two lines after a heading that aren't dropped for themselves
    nth = F.sum(other.cast("int")).over(Window.partitionBy("doc_id", "run", "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("skipped", (F.col("part") > 0) & other & (nth <= 2))
    opens = F.col("remarks") & ~F.col("skipped") & ~F.col("dropped")
    lines = lines.withColumn("in_remarks", opens | (F.coalesce(F.max(opens.cast("int")).over(before), F.lit(0)) == 1))
    return lines.filter(F.col("blank") | ~(F.col("dropped") | F.col("skipped") | F.col("in_remarks"))).select("doc_id", "line_no", "line")


_SECTION = re.compile(r"^\s*(?:" + "|".join(V.SECTIONS) + r")\s*[:\-]?\s*$", re.IGNORECASE | re.MULTILINE)


def dense_blocks(text: str, limit: int) -> list[str]:
    """Blocks of at most ``limit`` bytes: at section headings, else at blank lines, else lines packed greedily."""
    size = lambda s: len(s.encode())
    if size(text) <= limit:
        return [text]
    for places in ([m.start() for m in _SECTION.finditer(text)], [m.start() for m in re.finditer("\n\n", text)]):
        cuts = [0, *places, len(text)]
        blocks = [b for b in (text[a:b].strip() for a, b in zip(cuts, cuts[1:])) if b]
        if places and all(size(b) <= limit for b in blocks):
            return blocks
    blocks, held = [], ""
    for line in text.splitlines():
        if size(line) > limit:
            if held.strip():
                blocks.append(held)
            held = ""
            while line:
                # the longest start that fits, back to its last white space if more follows
                piece = line.encode()[:limit].decode(errors="ignore") or line[:1]
                if len(piece) < len(line):
                    white = max((i for i, c in enumerate(piece) if c.isspace()), default=-1)
                    piece = piece[: white if white > 0 else max(1, len(piece) if white < 0 else 1)]
                blocks.append(piece)
                line = line[len(piece) :]
        elif held and size(held) + size(line) + 1 > limit:
            if held.strip():
                blocks.append(held)
            held = line
        else:
            held = f"{held}\n{line}" if held else line
    return [b for b in (x.strip() for x in [*blocks, held]) if b]


#: Line ends as Python splits at them.
_LINE = "\r\n|[\n\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def blocks_of_lines(text: Column, limit: int) -> Column:
    """As ``dense_blocks`` for a page over the limit none of whose lines is over it. Places are cut before what matches there, so nothing is lost."""
    bare = lambda parts: F.filter(F.transform(parts, columns.trim), lambda b: b != "")
    heading = r"^\s*(?:" + "|".join(V.SECTIONS) + r")\s*[:\-]?\s*$"
    none = F.array().cast("array<string>")

    def pack(state: Column, line: Column) -> Column:
        full = (state["held"] != "") & (F.octet_length(state["held"]) + F.octet_length(line) + 1 > limit)
        more = F.when(state["held"] == "", line).otherwise(F.concat(state["held"], F.lit("\n"), line))
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"]).alias("done"), F.when(full, line).otherwise(more).alias("held"))

    packed = F.aggregate(F.split(text, _LINE), F.struct(none.alias("done"), F.lit("").alias("held")), pack, lambda s: F.concat(s["done"], F.array(s["held"])))
    fits = lambda parts: F.forall(parts, lambda b: F.octet_length(b) <= limit)
    or_else = lambda there, parts, other: F.when(there, columns.let(bare(parts), lambda p: F.when(fits(p), p).otherwise(other))).otherwise(other)
    by_blank = or_else(F.contains(text, F.lit("\n\n")), F.split(text, "(?=\n\n)"), bare(packed))
    return or_else(text.rlike("(?imdU)" + heading), F.split(text, f"(?imdU)(?={heading})"), by_blank)


def _cut(text: Column, limit: int) -> Column:
    """The blocks of a page, null where a line of it is over the limit: such pages are for ``dense_blocks``."""
    long_line = F.exists(F.split(text, _LINE), lambda x: F.octet_length(x) > limit)
    return F.when(F.octet_length(text) <= limit, F.array(text)).when(~long_line, columns.let(text, lambda t: blocks_of_lines(t, limit)))


def split_dense(page_rows: DataFrame, limit: int = 30_000) -> DataFrame:
    """(doc_id, page, block, text) in one pass; only the texts of pages with a line over the limit pass through Python."""

    @F.pandas_udf("array<string>")
    def blocks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else dense_blocks(t, limit))

    cut = page_rows.select("doc_id", "page", "text", columns.once(_cut(F.col("text"), limit).alias("cut")))
    blocks = blocks.asNondeterministic()  # else Spark calls it once more, for a filter on what explode gets
    each = cut.select("doc_id", "page", F.coalesce("cut", blocks(F.when(F.col("cut").isNull(), F.col("text")))).alias("blocks"))
    return each.select("doc_id", "page", F.posexplode("blocks").alias("k", "text")).select("doc_id", "page", (F.col("k") + 1).alias("block"), "text")


def patients(page_rows: DataFrame) -> DataFrame:
    """(doc_id, n_ids, first_id, single): a document with two identity numbers is refused."""
    ids = page_rows.select("doc_id", "page", columns.patient_id(F.col("text")).alias("id"))
    return ids.groupBy("doc_id").agg(F.countDistinct("id").alias("n_ids"), F.min_by("id", F.when(F.col("id").isNotNull(), F.col("page"))).alias("first_id")).withColumn("single", F.col("n_ids") <= 1)


def page_results(docs: DataFrame, start, limit: int = 30_000) -> DataFrame:
    """(doc_id, page, was_split, error, answers, text) of every page of (doc_id, content): an outside extractor's answers to its blocks.

    Dense pages are cut into blocks, which makes the page ``was_split``; the errors of a page's blocks are joined. ``start`` as of
    ``files.extract``. A page is one row throughout and keeps its text, so nothing is shuffled here or behind it.
    """
    from biolab.sources import files

    cut = pages(docs).filter("text is not null").select("doc_id", "page", "text", columns.once(_cut(F.col("text"), limit).alias("cut")))
    ask = files.extractor(start, lambda t: dense_blocks(t, limit))
    got = cut.select("doc_id", "page", "text", ask("cut", F.when(F.col("cut").isNull(), F.col("text"))).alias("got")).filter(F.size("got.errors") > 0)
    error = F.nullif(F.array_join(F.array_compact("got.errors"), "; "), F.lit(""))
    return got.select("doc_id", "page", (F.size("got.errors") > 1).alias("was_split"), error.alias("error"), F.array_compact("got.answers").alias("answers"), "text")


def _usable() -> Column:
    """Markers of a page that failed without being split are left out."""
    return F.col("error").isNull() | F.col("was_split")


def _status() -> Column:
    """A split page is partial, one with an error failed."""
    return F.when(F.col("was_split"), "partial").when(F.col("error").isNotNull(), "failed").otherwise("ok")


def _marked(results: DataFrame) -> DataFrame:
    """A row for each marker of a page, ``found``, or one that isn't for an answer without markers and for a page without answers; one row of a page is its ``opening``."""
    from biolab.operators import answers

    each = results.select("doc_id", "page", "text", _status().alias("status"), F.posexplode_outer(F.when(_usable(), F.col("answers"))).alias("block", "answer"))
    items = each.select("doc_id", "page", "text", "status", "block", F.posexplode_outer(answers.items(F.col("answer"))).alias("k", "x")).select("doc_id", "page", "text", "status", "block", "k", "x.*")
    read = items.select("*", columns.once(answers.coerced(F.col("value"), F.col("comparator")).alias("c")))
    near = answers.near(F.coalesce("text", F.lit("")), F.col("c.written"), F.col("name"))
    return read.select(
        "doc_id", "page", "status", "block", "k", F.col("k").isNotNull().alias("found"), ((F.coalesce("block", F.lit(0)) == 0) & (F.coalesce("k", F.lit(0)) == 0)).alias("opening"), "name",
        F.col("c.value").alias("value"), F.col("c.comparator").alias("comparator"), columns.normalize_unit(F.coalesce("unit", F.lit(""))).alias("unit"), "reference_range",
        F.coalesce("flagged", F.lit(False)).alias("flagged"), "source_text", columns.once((near & F.col("c.value").isNotNull()).alias("verified")),
    )


def _place() -> Column:
    """A marker's place in its document, from 1."""
    return F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block", "k"))


def page_markers(results: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, ord, name, value, comparator, unit, reference_range, flagged, source_text, verified) of the pages' answers.

    Markers of a page that failed without being split are left out. Each is held against the text of its page, which is looked up in
    ``docs`` by number where ``results`` don't have it; one whose value isn't near its name there isn't ``verified``.
    """
    if "text" not in results.columns:
        results = results.join(pages(docs), ["doc_id", "page"], "left")
    found = _marked(results).filter("found")
    return found.select("doc_id", "page", _place().alias("ord"), "name", "value", "comparator", "unit", "reference_range", "flagged", "source_text", "verified")


def page_readings_and_counts(results: DataFrame) -> DataFrame:
    """Rows to resolve as of ``page_readings``, with failed_pages, partial_pages and rejections that add up to those of ``page_counts``: one pass of the answers.

    What isn't verified, and a page without markers, is a row without a value, which is no reading.
    """
    count = lambda cond: cond.cast("long")
    value = F.when(F.col("verified"), F.col("value"))
    return _marked(results).select(
        "doc_id", "page", _place().alias("ord"), F.col("name").alias("raw_name"), value.alias("value"), "comparator", "unit", "reference_range", "flagged", "source_text",
        count(F.col("opening") & (F.col("status") == "failed")).alias("failed_pages"), count(F.col("opening") & (F.col("status") == "partial")).alias("partial_pages"),
        count(F.col("found") & ~F.col("verified")).alias("rejections"),
    )


def page_conflicts(read: DataFrame) -> DataFrame:
    """(doc_id, standardized_name, candidates) of markers that pages give different values of.

    ``read`` has doc_id, page, ord, raw_name, value, standardized_name, and raw_unit_norm, the unit as given, before any is inferred.
    The first reading counts: later ones with its value and unit are repeats and no candidates. Comparators aren't looked at.
    """
    rows = read.filter("standardized_name is not null and value is not null")
    each = F.sort_array(F.collect_list(F.struct("ord", "raw_name", "value", F.col("raw_unit_norm").alias("unit"), "page")))
    # readings of one marker in a document are few: they are gathered once and looked at in order
    g = rows.groupBy("doc_id", "standardized_name").agg(each.alias("all")).filter(F.size("all") > 1)
    first = F.get("all", 0)
    other = lambda x: (F.abs(x["value"] - first["value"]) >= 0.0001) | (x["unit"] != first["unit"])
    kept = F.filter("all", lambda x: (x["ord"] == first["ord"]) | other(x))
    return g.select("doc_id", "standardized_name", columns.once(kept.alias("candidates"))).filter(F.size("candidates") > 1)


def page_counts(statuses: DataFrame, markers: DataFrame) -> DataFrame:
    """(doc_id, failed_pages, partial_pages, rejections) of every document with a page; a marker that isn't verified is a rejection."""
    of = statuses.groupBy("doc_id").agg(F.count_if(F.col("status") == "failed").alias("failed_pages"), F.count_if(F.col("status") == "partial").alias("partial_pages"))
    rejected = markers.filter("not verified").groupBy("doc_id").agg(F.count("*").alias("rejections"))
    return of.join(rejected, "doc_id", "left").select("doc_id", "failed_pages", "partial_pages", F.coalesce("rejections", F.lit(0)).alias("rejections"))


def page_readings(markers: DataFrame) -> DataFrame:
    """Verified markers as rows to resolve: (doc_id, page, ord, raw_name, value, comparator, unit, reference_range, flagged, source_text)."""
    return markers.filter("verified").select("doc_id", "page", "ord", F.col("name").alias("raw_name"), "value", "comparator", "unit", "reference_range", "flagged", "source_text")


def page_statuses(results: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, status, error, marker_count): a split page is partial, one with an error failed. Without ``markers`` they are counted in the answers, in one pass."""
    from biolab.operators import answers

    if markers is not None:
        n = markers.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
        return results.join(n, ["doc_id", "page"], "left").select("doc_id", "page", _status().alias("status"), "error", F.coalesce("n", F.lit(0)).alias("marker_count"))
    each = results.select("doc_id", "page", "error", _status().alias("status"), F.when(_usable(), F.transform("answers", lambda a: F.coalesce(F.size(answers.items(a)), F.lit(0)))).alias("n"))
    n = F.aggregate(F.coalesce("n", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)))
    return each.select("doc_id", "page", "status", "error", n.alias("marker_count"))
