"""Statistics of whole tables: rows, missing cells, repeated rows, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import col, kinds, without_nan
from ..functions.rounding import pct


def row_key(df: DataFrame) -> Column:
    """128 bits of a row's values and of which are null; equal rows have equal keys."""
    parts = []
    for f in df.schema.fields:
        x = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = x + F.lit(0.0)
        elif isinstance(f.dataType, (T.MapType, T.VariantType)):
            x = F.to_json(F.struct(x.alias("x")))
        parts += [x, x.isNull()]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Statistics that were worked out and rounded on the driver, a row or one per column."""
    return df.sparkSession.createDataFrame(rows, schema)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, duplicate_rows, duplicate_rows_pct): rows equal to an earlier one. Only keys are shuffled."""
    df = without_nan(df)
    groups = df.select(row_key(df).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    n, distinct = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return _table(df, [(n, n - distinct, pct(n - distinct, n))], "n_rows long, duplicate_rows long, duplicate_rows_pct double")


def _missing(df: DataFrame) -> tuple[int, list[int]]:
    """Rows, and missing values by column, in one scan without a shuffle of rows."""
    df = without_nan(df)
    row = df.agg(F.count(F.lit(1)), *[F.count_if(col(c).isNull()) for c in df.columns]).first()
    return row[0], list(row[1:])


def overview(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, n_cells, missing_cells, missing_cells_pct)."""
    n, missing = _missing(df)
    cells = n * len(df.columns)
    return _table(df, [(n, len(df.columns), cells, sum(missing), pct(sum(missing), cells))], "n_rows long, n_columns long, n_cells long, missing_cells long, missing_cells_pct double")


def column_types(df: DataFrame) -> DataFrame:
    """(semantic_type, n_columns) of the schema; no job."""
    counts: dict[str, int] = {}
    for k in kinds(df).values():
        counts[k] = counts.get(k, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "semantic_type string, n_columns long")


def column_missing(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_pct) of every column."""
    n, missing = _missing(df)
    return _table(df, [(c, m, pct(m, n)) for c, m in zip(df.columns, missing)], "column_name string, missing_count long, missing_pct double")


def estimated_bytes(df: DataFrame) -> DataFrame:
    """(column_name, estimated_bytes): fixed widths, and what texts and structures take as bytes."""
    width = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    sums = []
    for f in df.schema.fields:
        x = col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.sum(F.octet_length(x).cast("long")), F.lit(0))
        elif kinds(df)[f.name] == "complex":
            size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(x.alias("x")))).cast("long")), F.lit(0))
        else:
            size = F.count(F.lit(1)) * width.get(type(f.dataType), 8)
        sums.append(F.struct(F.lit(f.name).alias("column_name"), size.alias("estimated_bytes")))
    return df.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def monotonic(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column_name, is_monotonic_increasing) in the order of another column.

    Rows are range-partitioned by the order; each partition is checked by itself
    and only its first and last values are compared across partitions.
    """
    rows = df.where(col(column).isNotNull()).select(col(order).alias("o"), col(column).alias("x")).repartitionByRange("o").withColumn("part", F.spark_partition_id())
    steps = rows.withColumn("before", F.lag("x").over(Window.partitionBy("part").orderBy("o", "x")))
    ends = steps.groupBy("part").agg(F.count_if(F.col("x") < F.col("before")).alias("falls"), F.min_by("x", F.struct("o", "x")).alias("first"), F.max_by("x", F.struct("o", "x")).alias("last"))
    # A row per partition.
    met = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    good = (F.coalesce(F.sum("falls"), F.lit(0)) == 0) & (F.count_if(F.col("first") < F.col("before")) == 0)
    return met.agg(good.alias("is_monotonic_increasing")).select(F.lit(column).alias("column_name"), "is_monotonic_increasing")


def datetime_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, datetime_min, datetime_max, span_days) of datetime columns that have values."""
    times = [F.struct(F.lit(n).alias("column_name"), F.unix_micros(F.min(col(n)).cast("timestamp")).alias("a"), F.unix_micros(F.max(col(n)).cast("timestamp")).alias("b")) for n in names]
    got = df.agg(F.array(*times).alias("x")).select(F.inline("x")).where("a IS NOT NULL")
    return got.select("column_name", F.timestamp_micros("a").alias("datetime_min"), F.timestamp_micros("b").alias("datetime_max"), F.bround((F.col("b") - F.col("a")) / F.lit(86400e6), 2).alias("span_days"))


def boolean_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, true_count, false_count, true_pct) of boolean columns."""
    row = df.agg(*[F.count_if(col(n) == v) for n in names for v in (True, False)]).first()
    rows = [(n, row[2 * i], row[2 * i + 1], pct(row[2 * i], row[2 * i] + row[2 * i + 1])) for i, n in enumerate(names)]
    return _table(df, rows, "column_name string, true_count long, false_count long, true_pct double")


def sample_exact(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly min(k, rows) rows, uniform by a seeded MD5 of a key; the same rows every time, in any engine."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(col(key).cast("string"), F.lit("null"))))
    return df.orderBy(drawn, col(key)).limit(k)
