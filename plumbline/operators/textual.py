"""Text statistics from a frequency table (column_name, v, chars, seen, n)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.storage import gather, materialize
from .frequency import KEY_CHARS, text_frequencies, texts_of_digests

TOP = 10


class TextStats:
    """Statistics of all text columns of a table; each distinct value is looked at once."""

    def __init__(self, df: DataFrame):
        self.df = df

    @cached_property
    def freq(self) -> DataFrame:
        return materialize(text_frequencies(self.df), "text-frequencies")

    @cached_property
    def values(self) -> DataFrame:
        """Present values with what they are: placeholder, number as is, number once cleaned, time."""
        seen = self.freq.where("v IS NOT NULL").withColumn("seen", F.coalesce("seen", text.reading(F.col("v"))))
        return materialize(seen.select("column_name", "chars", "n", "seen.*"), "text-values")

    @cached_property
    def ranked(self) -> DataFrame:
        """(column_name, place, v, n): the ten most frequent values, ties by value (of long texts by digest)."""
        order = Window.partitionBy("column_name").orderBy(F.desc("n"), "v")
        first = self.freq.where("v IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP).select("column_name", "place", "v", "n", "chars")
        rows = [tuple(r) for r in first.collect()]  # ten rows per column
        whole = texts_of_digests(self.df, [(c, v) for c, _, v, _, chars in rows if chars > KEY_CHARS])
        return self.df.sparkSession.createDataFrame([(c, p, whole.get((c, v), v), n) for c, p, v, n, _ in rows], "column_name string, place int, v string, n long")

    @cached_property
    def shares(self) -> DataFrame:
        """Lengths, blanks, placeholders, and the shares that parse as numbers or times."""
        n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        real = ~F.col("placeholder")
        counts = self.values.groupBy("column_name").agg(
            F.sum("n").alias("present"), (F.sum(F.col("chars") * F.col("n")) / F.sum("n")).alias("mean_length"), F.max("chars").alias("max_length"), n(F.col("blank")).alias("empty_string_count"), n(F.col("placeholder")).alias("missing_placeholder_count"),
            n(real).alias("real"), n(real & F.col("raw")).alias("raw"), n(real & F.col("clean")).alias("clean"), n(real & F.col("at").isNotNull()).alias("dated"),
        )
        share = lambda c: F.when(F.col("real") > 0, F.col(c) / F.col("real")).otherwise(0.0)
        got = counts.withColumn("raw_fraction", share("raw")).withColumn("clean_fraction", share("clean")).withColumn("datetime_fraction", share("dated"))
        got = got.withColumn("numeric_fraction", F.col("clean_fraction")).withColumn("looks_numeric", F.col("clean_fraction") > 0.9).withColumn("looks_datetime", F.col("datetime_fraction") > 0.9)
        return gather(got.withColumn("numeric_needs_cleaning", F.col("looks_numeric") & (F.col("raw_fraction") < F.col("clean_fraction"))))

    @cached_property
    def spans(self) -> DataFrame:
        """Of columns that hold dates as text: first, last, days between, distinct years and months."""
        dates = F.broadcast(self.shares.where("looks_datetime AND NOT looks_numeric").select("column_name"))
        at = self.values.where("NOT placeholder AND at IS NOT NULL").join(dates, "column_name", "left_semi")
        months = at.groupBy("column_name", F.date_trunc("month", "at").alias("month")).agg(F.min("at").alias("a"), F.max("at").alias("b"))
        got = months.groupBy("column_name").agg(F.min("a").alias("datetime_min"), F.max("b").alias("datetime_max"), F.countDistinct(F.year("month")).alias("distinct_years"), F.count(F.lit(1)).alias("distinct_months"))
        return got.withColumn("datetime_span_days", (F.unix_micros("datetime_max") - F.unix_micros("datetime_min")) / F.lit(86400e6))

    def table(self) -> dict[str, dict]:
        """All of it by column, unrounded."""
        out = {r["column_name"]: r.asDict() for r in self.shares.collect()}  # a row per column
        if any(r["looks_datetime"] and not r["looks_numeric"] for r in out.values()):
            for r in self.spans.collect():
                out[r["column_name"]] |= r.asDict()
        top: dict[str, list] = {}
        for r in sorted(self.ranked.collect(), key=lambda r: r["place"]):
            top.setdefault(r["column_name"], []).append({"value": r["v"], "n": r["n"]})
        for name, values in top.items():
            out[name] |= {"mode": values[0]["value"], "mode_freq": values[0]["n"], "mode_pct": 100 * values[0]["n"] / out[name]["present"], "top_values": values}
        return out
