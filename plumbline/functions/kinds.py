"""Semantic types of columns, and frames in which NaN is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind_of(data_type: T.DataType) -> str:
    """boolean, datetime, numeric, categorical or complex."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, (T.NumericType,)):
        return "numeric"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        return "complex"
    return "categorical"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so it becomes null first."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select(*[F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n) for n in df.columns])
