"""Cleaning actions as DataFrame transformations, and a provider that suggests them without a model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.kinds import col
from ..functions.storage import materialize
from ..functions.text import stripped, to_number, to_timestamp, undecorated
from ..operators.numeric import cells, exact_quantiles
from .suggest import CodeSuggestion


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def deduplicate(df: DataFrame, keys: list[str] | None = None, latest: str | None = None) -> DataFrame:
    """One of each set of equal rows, or of rows with equal keys that with the largest ``latest``."""
    if not keys:
        return df.dropDuplicates()
    row = F.struct(*[col(c) for c in df.columns])
    pick = F.max_by(row, col(latest)) if latest else F.min(row)
    return df.groupBy(*[col(k) for k in keys]).agg(pick.alias("_pl_row")).select("_pl_row.*")


def codes_to_null(df: DataFrame, name: str, codes: list[float]) -> DataFrame:
    """Infinite values and the codes, if there are any, become null."""
    bad = F.abs(col(name)) == F.lit(float("inf"))
    return df.withColumn(name, F.when(~(bad | col(name).isin(*codes) if codes else bad), col(name)))


def text_to_number(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, to_number(undecorated(col(name))))


def text_to_date(df: DataFrame, name: str) -> DataFrame:
    """The parsed time and its year, month and weekday."""
    at = to_timestamp(col(name))
    return df.withColumns({name: at, f"{name}_year": F.year(at), f"{name}_month": F.month(at), f"{name}_weekday": F.dayofweek(at)})


def normalise_text(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lower(stripped(col(name))))


def quantiles(df: DataFrame, name: str, points: tuple[float, ...]) -> list[float]:
    """Exact quantiles of one column's finite values."""
    values = cells(df, [name]).where("v IS NOT NULL AND abs(v) != double('Infinity')")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    return exact_quantiles(values, {0: (n, low, high)}, points)[0] if n else [None] * len(points)


def impute_median(df: DataFrame, name: str) -> DataFrame:
    (median,) = quantiles(df, name, (0.5,))
    return df if median is None else df.withColumn(name, F.coalesce(col(name).cast("double"), F.lit(median)))


def impute_label(df: DataFrame, name: str, label: str = "Missing") -> DataFrame:
    return df.withColumn(name, F.coalesce(col(name), F.lit(label)))


def winsorize(df: DataFrame, name: str) -> DataFrame:
    q1, q3 = quantiles(df, name, (0.25, 0.75))
    if q1 is None or q1 == q3:
        return df
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return df.withColumn(name, F.when(col(name).isNotNull(), F.greatest(F.least(col(name).cast("double"), F.lit(high)), F.lit(low))))


def unskew(df: DataFrame, name: str) -> DataFrame:
    """log1p of values from 0 on; with negative ones Yeo-Johnson, its lambda by likelihood on a grid in one pass."""
    low = df.agg(F.min(col(name))).first()[0]
    if low is None:
        return df
    if low >= 0:
        return df.withColumn(name, F.log1p(col(name).cast("double")))
    grid = [round(-2 + 0.1 * i, 1) for i in range(41)]
    x = col(name).cast("double")
    slope = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    facts = df.where(x.isNotNull()).agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    score = {g: -facts["n"] / 2 * math.log(facts[f"v{i}"]) + (g - 1) * facts["slope"] for i, g in enumerate(grid) if facts[f"v{i}"]}
    return df.withColumn(name, yeo_johnson(x, max(score, key=score.get))) if score else df


def yeo_johnson(x, power: float):
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, power) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, 2 - power) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def levels(df: DataFrame, name: str) -> list[str]:
    """The distinct values of a column of few, in order. More than ``MANY_LEVELS`` are an error."""
    found = [r[0] for r in df.where(col(name).isNotNull()).select(col(name)).distinct().limit(fixed.MANY_LEVELS + 1).collect()]
    if len(found) > fixed.MANY_LEVELS:
        raise ValueError(f"{name!r} has over {fixed.MANY_LEVELS} levels")
    return sorted(found)


def one_hot(df: DataFrame, name: str, levels: list[str]) -> DataFrame:
    return df.withColumns({f"{name}_{v}": (col(name) == v).cast("int") for v in levels}).drop(name)


def ordinal(df: DataFrame, name: str, levels: list[str]) -> DataFrame:
    return df.withColumn(name, F.array_position(F.array(*[F.lit(v) for v in levels]), col(name)) - 1)


def frequency_encode(df: DataFrame, name: str) -> DataFrame:
    """Each value's share of rows. The shares are written, so that adaptive execution can broadcast them or split a hot value."""
    counts = materialize(df.groupBy(col(name).alias("_pl_v")).agg(F.count(F.lit(1)).alias("_pl_n")), "level-counts")
    total = df.count()
    return df.join(counts, col(name).eqNullSafe(F.col("_pl_v"))).withColumn(name, F.col("_pl_n") / F.lit(total)).drop("_pl_v", "_pl_n")


def target_encode(df: DataFrame, name: str, target: str, smoothing: float = 20.0) -> DataFrame:
    """The target's mean by level, smoothed towards its mean overall. Fit on training rows only."""
    mean = df.agg(F.avg(col(target))).first()[0]
    sums = materialize(df.groupBy(col(name).alias("_pl_v")).agg(F.count(col(target)).alias("_pl_n"), F.coalesce(F.sum(col(target)), F.lit(0.0)).alias("_pl_s")), "level-sums")
    value = (F.col("_pl_s") + F.lit(smoothing * (mean or 0.0))) / (F.col("_pl_n") + F.lit(smoothing))
    return df.join(sums, col(name).eqNullSafe(F.col("_pl_v"))).withColumn(name, value).drop("_pl_v", "_pl_s", "_pl_n")


def top_levels(df: DataFrame, name: str, k: int, other: str = "Other") -> DataFrame:
    """The k most frequent values (ties by value); the rest become ``other``."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    keep = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(k).collect()]
    return df.withColumn(name, F.when(col(name).isNull() | col(name).isin(*keep), col(name)).otherwise(F.lit(other)))


def scale(df: DataFrame, name: str, how: str = "standard") -> DataFrame:
    """standard, minmax or robust; a column without spread becomes 0."""
    x = col(name).cast("double")
    if how == "robust":
        q1, centre, q3 = quantiles(df, name, (0.25, 0.5, 0.75))
        width = q3 - q1
    else:
        f = df.agg(F.avg(x).alias("a"), F.stddev_samp(x).alias("s"), F.min(x).alias("l"), F.max(x).alias("h")).first()
        centre, width = (f["a"], f["s"]) if how == "standard" else (f["l"], f["h"] - f["l"])
    return df.withColumn(name, (x - F.lit(centre)) / F.lit(width) if width else F.when(x.isNotNull(), F.lit(0.0)))


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(col(order).desc()))
    return df.withColumn("_pl_place", place).where("_pl_place = 1").drop("_pl_place")


#: Issue type -> (step of 1 to 8, code); {c} is the column as a Python text. Steps of one column and number are in this order.
TEMPLATES = {
    "empty_column": (1, "df = df.drop({c})"),
    "constant_column": (1, "df = df.drop({c})"),
    "identifier_like": (1, "df = df.drop({c})  # keep it aside to join results back"),
    "duplicate_rows": (2, "df = df.dropDuplicates()"),
    "numeric_stored_as_text": (3, "from plumbline.plans import cleaning\ndf = cleaning.text_to_number(df, {c})"),
    "datetime_stored_as_text": (3, "from plumbline.plans import cleaning\ndf = cleaning.text_to_date(df, {c})"),
    "mixed_types": (3, "from plumbline.plans import cleaning\ndf = cleaning.normalise_text(df, {c})"),
    "sentinel_values": (3, "from plumbline.plans import cleaning\ndf = cleaning.codes_to_null(df, {c}, {codes})"),
    "infinite_values": (3, "from plumbline.plans import cleaning\ndf = cleaning.codes_to_null(df, {c}, {codes})"),
    "high_missing": (4, "df = df.withColumn({c} + '_missing', df[{c}].isNull())"),
    "moderate_missing": (4, "from plumbline.plans import cleaning\ndf = cleaning.{impute}(df, {c})  # fit on training rows only"),
    "low_missing": (4, "df = df.dropna(subset=[{c}])"),
    "outliers": (5, "from plumbline.plans import cleaning\ndf = cleaning.winsorize(df, {c})  # fit on training rows only"),
    "high_skew": (6, "from plumbline.plans import cleaning\ndf = cleaning.unskew(df, {c})  # fit on training rows only"),
    "imbalanced_category": (7, "from plumbline.plans import cleaning\ndf = cleaning.top_levels(df, {c}, 1)"),
    "high_cardinality": (7, "from plumbline.plans import cleaning\ndf = cleaning.frequency_encode(df, {c})  # fit on training rows only"),
    "needs_encoding": (7, "from plumbline.plans import cleaning\ndf = cleaning.one_hot(df, {c}, cleaning.levels(df, {c}))  # levels of training rows only"),
    "mixed_feature_scales": (8, "from plumbline.plans import cleaning\nfor name in {scaled}:\n    df = cleaning.scale(df, name) if name in df.columns else df  # fit on training rows only"),
}


class Templates:
    """A provider that needs no model: a fixed step for each issue of a request."""

    name = "templates"

    def suggest(self, system: str, user: str, request: dict) -> CodeSuggestion:
        issues, column = request["issues"], request["column"]
        place = list(TEMPLATES)
        steps = sorted(((TEMPLATES[i["issue_type"]], i["issue_type"]) for i in issues), key=lambda x: (x[0][0], place.index(x[1])))
        stats = request["stats"]["columns"].get(column, {})
        known = {"c": repr(column), "codes": repr([float(c) for c in stats.get("sentinel_values", {})]), "impute": "impute_median" if stats.get("semantic_type") == "numeric" else "impute_label",
                 "scaled": repr([c for c, s in request["stats"]["columns"].items() if s["semantic_type"] == "numeric" and c != request["stats"]["dataset"].get("target")])}
        if steps[0][0][0] == 1 and column is not None:
            steps = steps[:1]  # a dropped column needs no more
        lines: list[str] = []
        for (_, code), _ in steps:
            lines += [x for x in code.format(**known).split("\n") if not (x.startswith("from ") and x in lines)]
        section = request["context"][0]["text"].split("\n\n")[-1] if request["context"] else "; ".join(i["detail"] for i in issues)
        return CodeSuggestion("; ".join(i["issue_type"] for i in issues) + (f" in {column}" if column else ""), section, "\n".join(lines), [column] if column else [], steps[0][0][0])
