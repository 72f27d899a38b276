"""One table of statistics with a row per column, of every semantic type."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.kinds import col, kinds
from ..functions.rounding import pct, rounded
from . import dataset
from .frequency import distinct_counts
from .numeric import NumericStats
from .textual import TextStats

#: (name, Spark type, digits) of what the table holds beyond the common columns.
NUMERIC = [
    ("infinite_count", "long", None), ("sentinel_values", "map<string,long>", None), ("sentinel_pct", "double", 2), ("n_values", "long", None), ("distinct_real_values", "long", None),
    ("mean", "double", 4), ("std", "double", 4), ("min", "double", 4), ("max", "double", 4), ("range", "double", 4), ("p01", "double", 4), ("q1", "double", 4), ("median", "double", 4), ("q3", "double", 4), ("p99", "double", 4), ("iqr", "double", 4),
    ("coefficient_of_variation", "double", 4), ("skewness", "double", 4), ("kurtosis", "double", 4), ("zero_count", "long", None), ("negative_count", "long", None), ("is_integer_like", "boolean", None),
    ("iqr_outlier_count", "long", None), ("iqr_outlier_pct", "double", 2), ("iqr_lower_bound", "double", 4), ("iqr_upper_bound", "double", 4), ("zscore_outlier_count", "long", None), ("zscore_outlier_pct", "double", 2), ("normality_p", "double", 6),
]
TEXT = [
    ("mode", "string", None), ("mode_freq", "long", None), ("mode_pct", "double", 2), ("top_values", "array<struct<value:string,n:long>>", None), ("mean_length", "double", 2), ("max_length", "int", None), ("empty_string_count", "long", None),
    ("missing_placeholder_count", "long", None), ("numeric_fraction", "double", 3), ("looks_numeric", "boolean", None), ("numeric_needs_cleaning", "boolean", None), ("looks_datetime", "boolean", None),
    ("datetime_span_days", "double", 1), ("distinct_years", "long", None), ("distinct_months", "long", None),
]
TIMES = [("datetime_min", "timestamp", None), ("datetime_max", "timestamp", None), ("span_days", "double", 2), ("is_monotonic_increasing", "boolean", None)]
FLAGS = [("true_count", "long", None), ("false_count", "long", None), ("true_pct", "double", 2)]
#: A variant column may hold values of several types.
MIXED = [("mixed_python_types", "boolean", None)]
COMMON = [
    ("column_name", "string", None), ("ordinal", "int", None), ("dtype", "string", None), ("semantic_type", "string", None), ("rows", "long", None), ("missing_count", "long", None), ("missing_pct", "double", 2),
    ("unique_count", "long", None), ("unique_pct", "double", 2), ("is_constant", "boolean", None), ("is_unique_key", "boolean", None), ("all_missing", "boolean", None),
]
BLOCKS = {"numeric": NUMERIC, "categorical": TEXT, "datetime": TIMES, "boolean": FLAGS, "complex": MIXED}
EVERY = COMMON + NUMERIC + TEXT + TIMES + FLAGS + MIXED


class Profile:
    """Statistics of a table. Nothing runs until a part is asked for; each part runs once.

    What reaches the driver has a row per column; there it is rounded and put together.
    """

    def __init__(self, df: DataFrame, order_col: str | None = None):
        if not isinstance(df, DataFrame):
            raise TypeError("a Spark DataFrame is needed")
        if not df.columns:
            raise ValueError("a table without columns can't be profiled")
        self.df, self.order_col, self.kinds = df, order_col, kinds(df)

    @cached_property
    def numeric(self) -> NumericStats:
        return NumericStats(self.df)

    @cached_property
    def text(self) -> TextStats:
        return TextStats(self.df)

    @cached_property
    def repeats(self) -> dict:
        """n_rows, duplicate_rows, duplicate_rows_pct."""
        return dataset.duplicate_rows(self.df).first().asDict()

    @cached_property
    def counts(self) -> dict[str, dict]:
        """rows, missing, present and unique_count of every column."""
        found = {r["column_name"]: r.asDict() for r in distinct_counts(self.df).collect()}
        nothing = {"rows": 0, "missing": 0, "present": 0, "unique_count": 0}
        return {c: found.get(c, nothing) for c in self.df.columns}

    @cached_property
    def common_rows(self) -> list[dict]:
        """COMMON of every column, in order of the schema."""
        n_rows, distinct = self.repeats["n_rows"], self.repeats["n_rows"] - self.repeats["duplicate_rows"]
        out = []
        for i, f in enumerate(self.df.schema.fields):
            c = self.counts[f.name]
            unique, present = c["unique_count"], c["present"]
            key = c["missing"] == 0 and unique > 1 and unique == distinct and unique >= fixed.KEY_UNIQUE_SHARE * n_rows
            out.append({
                "column_name": f.name, "ordinal": i, "dtype": f.dataType.simpleString(), "semantic_type": self.kinds[f.name], "rows": n_rows, "missing_count": c["missing"], "missing_pct": pct(c["missing"], n_rows),
                "unique_count": unique, "unique_pct": pct(unique, present), "is_constant": unique == 1, "is_unique_key": key, "all_missing": present == 0,
            })
        return out

    @cached_property
    def times(self) -> dict[str, dict]:
        names = [c for c, k in self.kinds.items() if k == "datetime"]
        out = {r["column_name"]: r.asDict() for r in dataset.datetime_stats(self.df, names).collect()} if names else {}
        for n in names if self.order_col else ():
            out[n]["is_monotonic_increasing"] = dataset.monotonic(self.df, n, self.order_col).first()[1]
        return out

    @cached_property
    def variants(self) -> dict[str, dict]:
        names = [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.VariantType)]
        if not names:
            return {}
        row = self.df.agg(*[F.count_distinct(F.schema_of_variant(col(n))) for n in names]).first()
        return {n: {"mixed_python_types": k > 1} for n, k in zip(names, row)}

    @cached_property
    def rows(self) -> list[dict]:
        """Everything, a dict per column, rounded; absent statistics are left out."""
        flags = [c for c, k in self.kinds.items() if k == "boolean"]
        parts = {
            "numeric": self.numeric.table({c: x["unique_count"] for c, x in self.counts.items()}) if "numeric" in self.kinds.values() else {},
            "categorical": self.text.table() if "categorical" in self.kinds.values() else {}, "datetime": self.times,
            "boolean": {r["column_name"]: r.asDict() for r in dataset.boolean_stats(self.df, flags).collect()} if flags else {},
            "complex": self.variants,
        }
        out = []
        for row in self.common_rows:
            own = parts[row["semantic_type"]].get(row["column_name"], {})
            out.append(row | {n: rounded(own[n], d) for n, _, d in BLOCKS[row["semantic_type"]] if own.get(n) is not None})
        return out

    def frame(self, rows: list[dict], fields: list[tuple]) -> DataFrame:
        return self.df.sparkSession.createDataFrame([tuple(r.get(n) for n, *_ in fields) for r in rows], ", ".join(f"{n} {t}" for n, t, _ in fields))

    @cached_property
    def common(self) -> DataFrame:
        return self.frame(self.common_rows, COMMON)

    @cached_property
    def table(self) -> DataFrame:
        """``rows`` as a table; absent statistics are null."""
        return self.frame(self.rows, EVERY)

    @cached_property
    def overall(self) -> dict:
        """Rows, columns, cells, missing cells, repeated rows."""
        missing = sum(c["missing"] for c in self.counts.values())
        cells = self.repeats["n_rows"] * len(self.df.columns)
        return {"n_rows": self.repeats["n_rows"], "n_columns": len(self.df.columns), "n_cells": cells, "missing_cells": missing, "missing_cells_pct": pct(missing, cells), "duplicate_rows": self.repeats["duplicate_rows"], "duplicate_rows_pct": self.repeats["duplicate_rows_pct"]}

    @cached_property
    def dataset(self) -> DataFrame:
        """``overall`` as a table of one row."""
        return self.df.sparkSession.createDataFrame([tuple(self.overall.values())], "n_rows long, n_columns long, n_cells long, missing_cells long, missing_cells_pct double, duplicate_rows long, duplicate_rows_pct double")
