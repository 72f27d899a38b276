"""Issue rules over statistics of columns; rows of the data are never read.

There is one rule table. A rule has a condition and a score, both functions of one
column's statistics (absent ones are null), and reads only rounded values. What it
works on has an entry per column, so it is evaluated on the driver; ``issues`` gives
the result as a table, and the transforms of that are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.rounding import rounded

SCHEMA = "rank int, column_name string, issue_type string, severity_score double, severity string, rag_query string"
COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


class Stats(dict):
    """One column's statistics and what the rules derive from them."""

    def number(self, name: str) -> float:
        return self.get(name) or 0

    def yes(self, name: str) -> bool:
        return bool(self.get(name))

    @property
    def is_number(self) -> bool:
        return self["semantic_type"] == "numeric"

    @property
    def is_feature(self) -> bool:
        """Flags of two values and constants have neither a shape nor a scale."""
        return self.is_number and self.number("distinct_real_values") > 2

    @property
    def is_text(self) -> bool:
        return self["semantic_type"] == "categorical" and not self.yes("all_missing")

    @property
    def is_label(self) -> bool:
        """Text that isn't to be converted."""
        return self.is_text and not self.yes("looks_numeric") and not self.yes("looks_datetime")

    @property
    def is_number_key(self) -> bool:
        return self.yes("is_unique_key") and self.yes("is_integer_like")

    @property
    def skew(self) -> float:
        return abs(self.number("skewness"))

    @property
    def scale(self) -> float:
        return max(abs(self.number("p01")), abs(self.number("p99")))

    def missing(self, low: float, high: float) -> bool:
        return low <= self["missing_pct"] < high


@dataclass(frozen=True)
class Rule:
    issue_type: str
    holds: Callable[[Stats], bool]
    score: Callable[[Stats], float]


def _always(score: float) -> Callable[[Stats], float]:
    return lambda s: score


#: The rules on one column. Issues of a column with one score are ranked in this order.
RULES = (
    Rule("constant_column", lambda s: s.yes("is_constant"), _always(55)),
    Rule("empty_column", lambda s: s["missing_pct"] >= 100, _always(95)),
    Rule("high_missing", lambda s: s.missing(fixed.HIGH_MISSING_PCT, 100), lambda s: 60 + s["missing_pct"] * 0.35),
    Rule("moderate_missing", lambda s: s.missing(fixed.MODERATE_MISSING_PCT, fixed.HIGH_MISSING_PCT), lambda s: 35 + s["missing_pct"]),
    Rule("low_missing", lambda s: s["missing_pct"] > 0 and s.missing(0, fixed.MODERATE_MISSING_PCT), lambda s: 15 + s["missing_pct"]),
    Rule("infinite_values", lambda s: s.is_number and s.number("infinite_count") > 0, _always(75)),
    Rule("sentinel_values", lambda s: s.is_number and s.yes("sentinel_values"), _always(72)),
    Rule("high_skew", lambda s: s.is_feature and s.skew >= fixed.HIGH_SKEW, lambda s: 45 + min(s.skew, 5) * 8),
    Rule("outliers", lambda s: s.is_feature and s.number("iqr_outlier_pct") >= fixed.OUTLIER_PCT, lambda s: 40 + min(s.number("iqr_outlier_pct"), 20) * 1.5),
    Rule("numeric_stored_as_text", lambda s: s.is_text and s.yes("looks_numeric"), _always(70)),
    Rule("datetime_stored_as_text", lambda s: s.is_text and s.yes("looks_datetime") and not s.yes("looks_numeric"), _always(65)),
    Rule("mixed_types", lambda s: s.yes("mixed_python_types") or s.is_text and fixed.MIXED_LOW < s.number("numeric_fraction") <= fixed.MIXED_HIGH, _always(60)),
    Rule("identifier_like", lambda s: s.is_feature and s.is_number_key or s.is_label and s.yes("is_unique_key"), _always(50)),
    Rule("high_cardinality", lambda s: s.is_label and not s.yes("is_unique_key") and s["unique_count"] >= fixed.MANY_LEVELS, _always(55)),
    Rule("needs_encoding", lambda s: s.is_label and not s.yes("is_unique_key") and 1 < s["unique_count"] < fixed.MANY_LEVELS, _always(25)),
    Rule("imbalanced_category", lambda s: s.is_text and s.number("mode_pct") >= fixed.DOMINANT_PCT and s["unique_count"] > 1, _always(45)),
)

#: From which score on an issue has which label.
LABELS = ((70, "critical"), (45, "high"), (25, "medium"), (0, "low"))


def scales(columns: Iterable[Stats]) -> dict | None:
    """The features of largest and smallest scale and their ratio, if two have a scale; the first in order on ties."""
    usable = [s for s in columns if s.is_feature and not s.is_number_key and s.scale > 0]
    if len(usable) < 2:
        return None
    large, small = max(usable, key=lambda s: s.scale), min(usable, key=lambda s: s.scale)
    return {"largest_scale_column": large["column_name"], "smallest_scale_column": small["column_name"], "scale_ratio": large.scale / small.scale}


def find(columns: Iterable[dict], overall: dict, target: str | None = None) -> list[dict]:
    """Issues by rank. columns: statistics by column, in order of the schema; the target takes part in no rule.

    Ranks go by rounded score, then by column (a table's own issues as "None"), then
    by the order of the rules.
    """
    own = [Stats(c) for c in columns if c["column_name"] != target]
    found: list[tuple[str | None, str, float, str]] = []
    if overall["duplicate_rows"] > 0 and overall["n_columns"] >= fixed.DUPLICATES_MIN_COLUMNS:
        found.append((None, "duplicate_rows", 40 + overall["duplicate_rows_pct"], ""))
    apart = scales(own)
    if apart and apart["scale_ratio"] > fixed.SCALE_RATIO:
        found.append((None, "mixed_feature_scales", 45, ""))
    found += [(s["column_name"], r.issue_type, r.score(s), s["semantic_type"]) for s in own for r in RULES if r.holds(s)]
    scored = [(name, kind, rounded(float(min(score, 100)), 1), next(x for least, x in LABELS if score >= least), fixed.QUESTIONS[kind].replace("{type}", semantic)) for name, kind, score, semantic in found]
    scored.sort(key=lambda x: (-x[2], str(x[0])))
    return [dict(zip(COLUMNS, (rank, *x))) for rank, x in enumerate(scored, 1)]


def issues(profile, target: str | None = None) -> DataFrame:
    """SCHEMA, a row per issue of a ``columns.Profile``."""
    rows = find(profile.rows, profile.overall, target)
    return profile.df.sparkSession.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)


def top_issues(found: DataFrame, k: int) -> DataFrame:
    return found.where(F.col("rank") <= k)


def select_issues(found: DataFrame, n: int) -> DataFrame:
    """The first n issues and every other issue on their columns."""
    columns = found.where((F.col("rank") <= n) & F.col("column_name").isNotNull()).select("column_name").distinct()
    return found.where(F.col("rank") <= n).union(found.where(F.col("rank") > n).join(F.broadcast(columns), "column_name", "left_semi").select(*found.columns))


def plan_requests(found: DataFrame) -> DataFrame:
    """(request, column_name, issue_types): issues of one column together, each dataset issue alone, by first rank."""
    alone = F.when(F.col("column_name").isNull(), F.col("rank")).otherwise(0)
    groups = found.groupBy("column_name", alone.alias("alone")).agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", "issue_type"))).alias("x"))
    return groups.select(F.row_number().over(Window.orderBy("first")).alias("request"), "column_name", F.array_join(F.transform("x", lambda i: i["issue_type"]), ",").alias("issue_types"))
