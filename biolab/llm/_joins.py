"""Joins that hold at any size: names that don't clash, checked broadcasts, and salted shuffles for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Parts that the rows of one key are dealt to where its table is too large to broadcast.
SALTS = 32
#: Keys that are held more often than 1 / HOT of all rows are fewer than HOT: few enough to broadcast at any size of input.
HOT = 50_000


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(docs: DataFrame, key: Column, table: DataFrame, of: str, most: int, how: str = "inner", by: Column | None = None) -> tuple[DataFrame, str]:
    """(``docs`` with the row of ``table`` whose ``of`` equals ``key``, nulls too, as one struct column; that column's name).

    A table of at most ``most`` rows is broadcast. Beyond it rows are dealt by (key, salt), the salt being a hash of ``by``
    (of the whole row if none is given), and each row of the table stands once for each salt: a key with a third of all rows is split.
    """
    name = fresh(docs, "_row")
    row = table.select(F.struct(*columns(table)).alias(name))
    equal = key.eqNullSafe(F.col(name)[of])
    if table.count() <= most:
        return docs.join(F.broadcast(row), equal, how), name
    salt, other = fresh(docs, "_salt"), fresh(docs, "_salt_of")
    dealt = docs.withColumn(salt, F.pmod(F.xxhash64(*(columns(docs) if by is None else [by])), F.lit(SALTS)).cast("int"))
    row = row.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(row, equal & (F.col(salt) == F.col(other)), how).select(*columns(docs), F.col(name)), name


def with_counts(rows: DataFrame, counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``counts`` on ``key``; ``n`` says how many of the ``total`` rows hold a key.

    The keys held most often, fewer than HOT by proof, are broadcast, so that no task gets all rows of a hot key.
    """
    limit = max(total // HOT, 1000)
    hot = F.broadcast(counts.filter(F.col(n) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(counts.filter(F.col(n) <= limit), key)
    return cold.unionByName(rows.join(hot, key))


def map_batches(docs: DataFrame, batches) -> DataFrame:
    """``docs.mapInArrow`` with a function that keeps all columns; it sees them as c0, c1, ..., so any names go."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(c, f.dataType) for c, f in zip(plain, docs.schema)])
    return docs.toDF(*plain).mapInArrow(batches, schema).toDF(*docs.columns)
