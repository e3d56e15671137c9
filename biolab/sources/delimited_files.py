"""Delimited report files by path: a large file is read by many tasks, and quoted fields may hold line ends.

Spark's text reader cuts a file into blocks at line ends, so a block may begin inside a quoted field. A first pass counts the quotes of
each block and finds the columns in each file's first record; the sum of the blocks before a block says whether it begins inside quotes. The
second pass joins a block's lines to records, a batch of lines at once, and reads their fields. A record that goes on in the next block is
put together from its parts, one for each block it is in; blocks without such parts aren't read for them.
Nothing but a few numbers for each block is brought together, and no text passes through the driver.
"""

from __future__ import annotations

import csv
import io
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biolab.functions import fixed_values as V
from biolab.sources.tabular import role

#: Up to so many blocks (some 100 bytes each) their table is broadcast; beyond it the lines are dealt by block and sorted.
BROADCAST_BLOCKS = 100_000
BLOCK = ["path", "block"]


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, line) in the order of the file within a partition; ``block`` is the byte that a block begins at."""
    df = spark.read.option("lineSep", "\n").text(paths)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _runs(batch: pa.RecordBatch):
    """(path, block, first, end) of each run of rows of one block."""
    path, block, n = batch.column(0), batch.column(1), batch.num_rows
    if n:
        other = lambda c: pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other(path) | other(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield path[a].as_py(), block[a].as_py(), a, b


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)


def _fields(record: str, d: str) -> list[str]:
    """The fields of a record; of one that has line ends outside quotes, those before the first."""
    try:
        row = next(csv.reader([record], delimiter=d), [])
    except csv.Error:
        row = next(csv.reader(io.StringIO(record, newline=""), delimiter=d), [])
    return [x.strip() for x in row]


def _head(text: str) -> tuple[str, int | None, int | None, int | None]:
    """(delimiter, places of name, value and unit) of a file's first record; the delimiter as of ``tabular.delimiter``."""
    text = text.removeprefix("\ufeff")
    tabs, semis, commas = (re.split("\r?\n", text)[0].count(d) for d in "\t;,")
    d = "\t" if tabs >= 2 and tabs >= commas and tabs >= semis else ";" if semis >= 2 and semis >= commas else ","
    names = _fields(text, d)
    return (d, *(role(names, k) for k in (V.NAME_HEADERS, V.VALUE_HEADERS, V.UNIT_HEADERS)))


ROLES = ["d", "name", "value", "unit"]


def blocks(df: DataFrame) -> DataFrame:
    """(path, block, inside, open, d, name, value, unit): whether a block begins inside quotes, whether it ends inside, and the places of its file's columns."""

    def batches(source):
        at, n, held, found = None, 0, None, None

        def flush():
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 3]
            row = (*at, n, *(found or (_head("\n".join(held)) if held else (None,) * 4)))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[*BLOCK, "n", *ROLES])

        for batch in source:
            quotes = _quotes(batch.column(2))
            for path, block, a, b in _runs(batch):
                if (path, block) != at:
                    if at:
                        yield flush()
                    at, n, held, found = (path, block), 0, [], None
                if block == 0 and not found:
                    whole = np.flatnonzero((n + np.cumsum(quotes[a:b])) % 2 == 0)
                    held += batch.column(2).slice(a, whole[0] + 1 if len(whole) else b - a).to_pylist()
                    found = _head("\n".join(held)) if len(whole) else None
                n += int(quotes[a:b].sum())
        if at:
            yield flush()

    each = df.mapInArrow(batches, "path string, block long, n long, d string, name int, value int, unit int")
    of, before = Window.partitionBy("path"), Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.sum("n").over(before), F.lit(0))
    return each.select(*BLOCK, (known % 2 == 1).alias("inside"), ((known + F.col("n")) % 2 == 1).alias("open"), *[F.max(c).over(of).alias(c) for c in ROLES])


FOUND = "path string, ord long, raw_name string, raw_value string, raw_unit string, error string"


class _Found:
    """Rows of FOUND being gathered, and what ``more`` there is to a row."""

    KINDS = [pa.string(), pa.int64(), *[pa.string()] * 4]

    def __init__(self, more: dict[str, pa.DataType] | None = None):
        self.kinds = self.KINDS + list((more or {}).values())
        self.names = [x.split(" ")[0] for x in FOUND.split(", ")] + list(more or {})
        self.out = [[] for _ in self.kinds]

    def put(self, *row):
        for c, x in zip(self.out, row):
            c.append(x)

    def read(self, path: str, at: int, record: str, closed: bool, roles: tuple, *more):
        """Puts a record's row, or its error, if it has any."""
        d, name, value, unit = roles
        if name is None or value is None:
            if at == 0:
                self.put(path, at, "", "", "", "no test name column" if name is None else "no result column", *more)
        elif not closed:
            self.put(path, at, "", "", "", "a quoted field has no end", *more)
        elif at:
            row = _fields(record, d)
            got = [row[i] if i is not None and i < len(row) else "" for i in (name, value, unit)]
            if got[0] and got[1]:
                self.put(path, at, *got, None, *more)

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.out, self.kinds)], names=self.names)
        self.out = [[] for _ in self.kinds]
        return batch


def _records(df: DataFrame) -> DataFrame:
    """Rows of FOUND, with part, record and roles, of (path, block, line, inside, roles): read records, whose part is null, and the parts of cut ones.

    Part 0 begins before its block and part 1 goes on behind it; 0 may do both.
    """
    kinds = dict(zip(["part", "record", *ROLES], [pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 3]))

    def batches(source):
        at, n, held, inside, first, roles = None, 0, [], False, False, ()
        found = _Found(kinds)
        cut = lambda part: found.put(at[0], at[1] + n - len(held), *[None] * 4, part, "\n".join(held), *roles)
        for batch in source:
            quotes = _quotes(batch.column(2))
            for path, block, a, b in _runs(batch):
                if (path, block) != at:
                    if held:
                        cut(0 if first else 1)
                    at, n, held, inside = (path, block), 0, [], batch.column(3)[a].as_py()
                    first, roles = inside, tuple(batch.column(i)[a].as_py() for i in range(4, 8))
                lines = batch.column(2).slice(a, b - a)
                after = (np.cumsum(quotes[a:b]) + inside) % 2
                ends = np.flatnonzero(after == 0) + 1
                inside = bool(after[-1])
                if len(ends):
                    starts = [0, *ends[:-1].tolist()]
                    texts = lines if len(ends) == len(lines) else pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), lines.slice(0, ends[-1])), "\n")
                    for i, (start, text) in enumerate(zip(starts, texts.to_pylist())):
                        if i == 0 and (held or first):
                            held.append(text)
                            if first:  # its lines before these are counted, not these
                                found.put(path, block + n + 1 - len(held), *[None] * 4, 0, "\n".join(held), *roles)
                            else:
                                found.read(path, block + n + 1 - len(held), "\n".join(held), True, roles, *[None] * 6)
                            held, first = [], False
                        else:
                            found.read(path, block + n + start, text, True, roles, *[None] * 6)
                rest = lines.slice(ends[-1] if len(ends) else 0).to_pylist()
                held += rest
                n += b - a
            if len(found.out[0]) >= 1000:
                yield found.flush()
        if held:
            cut(0 if first else 1)
        yield found.flush()

    return df.select(*BLOCK, "line", "inside", *ROLES).mapInArrow(batches, FOUND + ", part int, record string, d string, name int, value int, unit int")


def _joined(found: DataFrame) -> DataFrame:
    """Rows of FOUND of the records that blocks cut."""
    # a part 1 opens a record that the parts 0 behind it go on with, one a block, until the next part 1
    order = Window.partitionBy("path").orderBy("ord", "part")
    cut = found.filter("part is not null").withColumn("of", F.max(F.when(F.col("part") == 1, F.col("ord"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "record"))), lambda x: x["record"]), "\n")
    joined = cut.groupBy("path", F.col("of").alias("ord")).agg(text.alias("record"), *[F.max(c).alias(c) for c in ROLES])

    def batches(source):
        for batch in source:
            found = _Found()
            for path, at, record, *roles in zip(*(batch.column(i).to_pylist() for i in range(7))):
                found.read(path, at, record, record.count('"') % 2 == 0, tuple(roles))
            yield found.flush()

    return joined.select("path", "ord", "record", *ROLES).mapInArrow(batches, FOUND)


def rows(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """((path, ord, raw_name, raw_value, raw_unit) of all readable records, (path, ord, error) of what can't be read); ``ord`` rises with the place in the file.

    A file without a name or a value column has no rows and one error; so has a record whose quotes aren't closed, which only a file's last
    record may be. Records without a name or value are left out, as they are in texts.
    """
    df = lines(spark, paths)
    of = blocks(df)
    few = of.limit(BROADCAST_BLOCKS + 1).collect()
    cut = F.col("inside") | F.col("open")
    if len(few) <= BROADCAST_BLOCKS:
        of = spark.createDataFrame(few, of.schema)
        given = lambda of: df.join(F.broadcast(of), BLOCK)
    else:
        given = lambda of: df.withColumn("seq", F.monotonically_increasing_id()).join(of, BLOCK).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "seq")
    names = [x.split(" ")[0] for x in FOUND.split(", ")]
    found = _records(given(of)).filter("part is null").select(names)
    if len(few) > BROADCAST_BLOCKS or any(r.inside or r.open for r in few):
        found = found.unionByName(_joined(_records(given(of.filter(cut)))))
    return found.filter("error is null").drop("error"), found.filter("error is not null").select("path", "ord", "error")
