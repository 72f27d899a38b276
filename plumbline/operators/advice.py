"""The bundled corpus of cleaning advice and a reader for others."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The section that answers each issue type; {type} is the semantic type.
SECTIONS = {
    "duplicate_rows": "Duplicate rows", "mixed_feature_scales": "Scaling features", "constant_column": "Constant columns without variance", "empty_column": "Completely empty columns",
    "high_missing": "High percentage of missing {type} values", "moderate_missing": "Imputing missing {type} values", "low_missing": "A very small percentage of missing values", "infinite_values": "Infinite values",
    "sentinel_values": "Placeholder codes", "high_skew": "Skewed features", "outliers": "Outliers", "identifier_like": "Identifier columns", "numeric_stored_as_text": "Numbers stored as text", "datetime_stored_as_text": "Dates stored as text",
    "mixed_types": "Mixed data types", "high_cardinality": "Encoding many levels", "needs_encoding": "Encoding few levels", "imbalanced_category": "Imbalanced categories",
}
OFF_TOPIC = ("sourdough starter feeding schedule", "train timetable to the coast", "history of medieval castles", "how to tune a guitar")


def corpus() -> str:
    with open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "advice.md"), encoding="utf-8") as f:
        return f.read()


def read_corpus(spark: SparkSession, path: str) -> str:
    """A UTF-8 text of one's own, from any store Spark reads."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    return "\n".join(r[0] for r in rows)
