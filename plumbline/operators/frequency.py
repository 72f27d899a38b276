"""Distinct values of all columns, and frequency tables of texts, each in one shuffle.

Columns are unpivoted; what is shuffled is a key of each distinct value of a task,
so a value that most rows share is one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.kinds import col, kinds, without_nan

#: Longer texts are keyed by their digest, and looked at before that.
KEY_CHARS = 256
#: Columns that one unpivot takes; wider tables are done in turns of one job.
WIDE = 64


def _long(df: DataFrame, parts: list) -> DataFrame:
    """One row per cell: parts are structs of one type."""
    frames = [df.select(F.inline(F.array(*parts[a : a + WIDE]))) for a in range(0, len(parts), WIDE)]
    return reduce(DataFrame.union, frames)


def value_key(f: T.StructField) -> tuple[Column, Column]:
    """Two longs that name a value: itself, or a one-to-one hash of its 8 bytes, or else 128 bits of hashes."""
    x, none = col(f.name), F.lit(0).cast("long")
    if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return x.cast("long"), none
    if isinstance(f.dataType, T.DateType):
        return F.unix_date(x).cast("long"), none
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp")), none
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return F.xxhash64(x.cast("double") + F.lit(0.0)), none  # -0.0 and 0.0 are one value
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        x = F.to_json(F.struct(x.alias("x")))
    return F.xxhash64(x), F.xxhash64(F.lit(1), x)


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column_name, rows, missing, present, unique_count) of every column; decimals count by their whole value."""
    df = without_nan(df)
    parts = []
    for i, f in enumerate(df.schema.fields):
        a, b = value_key(f)
        some = col(f.name).isNotNull()
        parts.append(F.struct(F.lit(i).alias("i"), F.when(some, a).alias("a"), F.when(some, b).alias("b")))
    values = _long(df, parts).groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    # A table without rows has its columns all the same.
    none = F.lit(None).cast("long")
    values = values.union(df.sparkSession.range(0, len(parts), 1, 1).select(F.col("id").cast("int"), none, none, F.lit(0).cast("long")))
    some = F.col("b").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    got = values.groupBy("i").agg(F.sum("n").alias("rows"), total(~some).alias("missing"), total(some).alias("present"), F.count(F.when(some, 1)).alias("unique_count"))
    names = F.array(*[F.lit(c) for c in df.columns])
    return got.select(F.get(names, F.col("i")).alias("column_name"), "rows", "missing", "present", "unique_count")


def text_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, v string, chars, seen, n) of categorical columns; null v is missing.

    A text of more than KEY_CHARS characters is "sha256:" and its digest; chars stays
    its own length, and seen holds what it is (``text.reading``), which its digest can't tell.
    """
    found = kinds(df)
    names = [n for n in df.columns if found[n] == "categorical" and (columns is None or n in columns)]
    if not names:
        return df.sparkSession.createDataFrame([], f"column_name string, v string, chars int, seen {text.READING}, n long")
    cells = _long(df, [F.struct(F.lit(n).alias("column_name"), col(n).cast("string").alias("x")) for n in names])
    long = F.length("x") > KEY_CHARS
    keyed = cells.select("column_name", F.when(long, digest(F.col("x"))).otherwise(F.col("x")).alias("v"), F.length("x").alias("chars"), F.when(long, text.reading(F.col("x"))).alias("seen"))
    return keyed.groupBy("column_name", "v", "chars", "seen").agg(F.count(F.lit(1)).alias("n"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def texts_of_digests(df: DataFrame, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """{(column, digest): text} of some long texts; wanted has at most a few rows per column."""
    if not wanted:
        return {}
    parts = [F.struct(F.lit(n).alias("column_name"), F.when(F.length(col(n)) > KEY_CHARS, col(n).cast("string")).alias("x")) for n in sorted({n for n, _ in wanted})]
    side = df.sparkSession.createDataFrame(wanted, "column_name string, v string")
    cells = _long(df, parts).where("x IS NOT NULL").withColumn("v", digest(F.col("x"))).join(F.broadcast(side), ["column_name", "v"])
    return {(r["column_name"], r["v"]): r["x"] for r in cells.groupBy("column_name", "v").agg(F.first("x").alias("x")).collect()}
