"""Numeric statistics of all columns at once, after infinities and placeholder codes are set aside.

Columns are unpivoted to (place of the column, value) and aggregated by place, with
a first step before the shuffle, so a scan shuffles a row per task and column and no
cell ever moves:

1. one scan counts, finds the placeholder codes among nine known values, and takes
   the moments of all other values; codes that turn out to be real values are merged
   back in by the rules for joining moments, which add and never cancel;
2. exact quantiles narrow down by counting values in intervals (``exact_quantiles``);
3. one scan counts outliers within the bounds that 1 and 2 gave;
4. distinct values alone need the values themselves: their keys are shuffled once.

What reaches the driver has a row per column (and code, or quantile), so it grows
with neither rows nor values; the formulas are worked out there.
"""

from __future__ import annotations

import math
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.kinds import col, kind_of, without_nan

INFINITY = float("inf")
CODES = tuple(float(c) for c in fixed.SENTINEL_CODES)
#: Whole numbers up to here are doubles of their own.
EXACT = 1 << 53
#: Columns that one unpivot takes; wider tables are done in turns of one job.
WIDE = 64
#: Intervals an interval is cut into by one scan, and values that may be ordered in one task.
BINS, ORDERED = 4096, 1_000_000


def cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(i, v double): a row per cell, i the place of its column in ``names``; NaN is null."""
    df = without_nan(df.select(*[col(n) for n in names]))
    # -0.0 and 0.0 are one value.
    parts = [F.struct(F.lit(i).alias("i"), (col(n).cast("double") + F.lit(0.0)).alias("v")) for i, n in enumerate(names)]
    frames = [df.select(F.inline(F.array(*parts[a : a + WIDE]))) for a in range(0, len(parts), WIDE)]
    return reduce(DataFrame.union, frames)


def exact_quantiles(values: DataFrame, facts: dict, points: tuple[float, ...]) -> dict:
    """{i: quantiles, linearly interpolated} of (i, v), exact. facts: {i: (number of values, least, largest)}.

    Every wanted rank lies in an interval of values, at first its column's. A scan
    cuts the intervals into ``BINS`` parts and counts them, with each part's least
    and largest value; a rank's part is its next interval, and a part of one value
    gives the rank away. Once few values are left they are counted one by one. The
    shuffle has a row per task and part.
    """
    spark = values.sparkSession
    ranks = {i: sorted({min(max(math.floor((n - 1) * p) + up, 0), n - 1) for p in points for up in (0, 1)}) for i, (n, _, _) in facts.items() if n}
    known = {}
    # (i, rank) -> (values of the column below the interval, values in it, least, largest)
    open_ = {(i, r): (0, *facts[i]) for i, own in ranks.items() for r in own}

    def settle():
        for key in [k for k, (_, _, low, high) in open_.items() if low == high]:
            known[key] = open_.pop(key)[2]

    def within(ivals: dict):
        rows = [(i, j, low, high) for (i, low, high), j in ivals.items()]
        side = spark.createDataFrame(rows, "i int, j int, low double, high double")
        return values.join(F.broadcast(side), "i").where("v >= low AND v <= high")

    settle()
    while open_:
        intervals = {(i, low, high): j for j, (i, low, high) in enumerate(sorted({(i, low, high) for (i, _), (_, _, low, high) in open_.items()}))}
        number = {(i, low, high): n for (i, _), (_, n, low, high) in open_.items()}
        few = sum(number.values()) <= ORDERED
        share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
        # Far apart ends overflow; halving both keeps the order.
        share = F.when(F.col("high") - F.col("low") < INFINITY, share).otherwise((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
        part = F.col("v") if few else F.least(F.floor(share * BINS), F.lit(BINS - 1))
        found = within(intervals).groupBy("j", part.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy("j").orderBy("b")
        placed = found.withColumn("below", F.sum("n").over(upto) - F.col("n"))
        wanted = [(intervals[i, low, high], i, r, base, r - base) for (i, r), (base, _, low, high) in open_.items()]
        side = spark.createDataFrame(wanted, "j int, i int, r long, base long, at long")
        met = placed.join(F.broadcast(side), "j").where("at >= below AND at < below + n")
        for row in met.select("i", "r", (F.col("base") + F.col("below")).alias("base"), "n", "low", "high").collect():  # a row per column and rank
            open_[row["i"], row["r"]] = (row["base"], row["n"], row["low"], row["high"])
        settle()

    def at(i, n, p):
        h = (n - 1) * p
        low = math.floor(h)
        a, b = known[i, low], known[i, min(low + 1, n - 1)]
        return a + (b - a) * (h - low)

    return {i: [at(i, n, p) for p in points] for i, (n, _, _) in facts.items() if n}


def joined(a: tuple, n: int, value: float) -> tuple:
    """Moments (count, mean, and central sums of powers 2 to 4) of some values and n more of one value."""
    m, mean, s2, s3, s4 = a
    if not m:
        return n, value, 0.0, 0.0, 0.0
    d, t = value - mean, m + n
    return (
        t, mean + d * n / t, s2 + d * d * m * n / t, s3 + d * d * d * m * n * (m - n) / t**2 - 3 * d * n * s2 / t,
        s4 + d * d * d * d * m * n * (m * m - m * n + n * n) / t**3 + 6 * d * d * n * n * s2 / t**2 - 4 * d * n * s3 / t,
    )


def corrected_skewness(n: int, m2: float, m3: float) -> float | None:
    """G1 from central sums; 0 for constants, none below three values."""
    if n <= 2:
        return None
    return math.sqrt(n) * (m3 / m2 / math.sqrt(m2)) * math.sqrt(n * (n - 1)) / (n - 2) if m2 > 0 else 0.0


def corrected_kurtosis(n: int, m2: float, m4: float) -> float | None:
    """Excess G2 from central sums; 0 for constants, none below four values."""
    if n <= 3:
        return None
    return ((n + 1) * (n * (m4 / m2 / m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) if m2 > 0 else 0.0


def normality_p(n: int, m2: float, m3: float, m4: float) -> float | None:
    """D'Agostino-Pearson omnibus test from the biased skewness and kurtosis; none below 20 values or for constants."""
    if n < 20 or m2 <= 0:
        return None
    try:
        g1, b2 = math.sqrt(n) * (m3 / m2 / math.sqrt(m2)), n * (m4 / m2 / m2)
        y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
        beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = math.sqrt(2 * (beta - 1)) - 1
        z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
        x = (b2 - 3 * (n - 1) / (n + 1)) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
        sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6 + 8 / sb * (2 / sb + math.sqrt(1 + 4 / (sb * sb)))
        d = 1 + x * math.sqrt(2 / (a - 4))
        root = math.copysign(abs((1 - 2 / a) / abs(d)) ** (1 / 3), d)
        z2 = (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))
        p = math.exp(-(z1 * z1 + z2 * z2) / 2)
    except (ArithmeticError, ValueError):
        return None
    return p if math.isfinite(p) else None


#: Parts of the statistics: (name, Spark type).
TOTALS = [("rows", "long"), ("missing", "long"), ("present", "long"), ("infinite_count", "long")]
MOMENTS = [
    ("n_values", "long"), ("mean", "double"), ("std", "double"), ("min", "double"), ("max", "double"), ("range", "double"), ("coefficient_of_variation", "double"),
    ("zero_count", "long"), ("negative_count", "long"), ("is_integer_like", "boolean"), ("skewness", "double"), ("kurtosis", "double"), ("normality_p", "double"),
]
QUANTILES = [("p01", 0.01), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p99", 0.99)]
OUTLIERS = [("iqr", "double"), ("iqr_outlier_count", "long"), ("iqr_outlier_pct", "double"), ("iqr_lower_bound", "double"), ("iqr_upper_bound", "double"), ("zscore_outlier_count", "long"), ("zscore_outlier_pct", "double")]


class NumericStats:
    """Statistics of a table's numeric columns. Each part is worked out once, when asked for."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.names = [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric"]
        self.cells = cells(df, self.names) if self.names else None

    @cached_property
    def counted(self) -> dict[str, dict]:
        """Step 1, by column: totals, codes, moments of what is left."""
        if not self.names:
            return {}
        v, inf = F.col("v"), F.abs("v") == INFINITY
        x = F.when(~inf & ~v.isin(*CODES), v)
        near = F.rint(x)
        got = self.cells.groupBy("i").agg(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("present"), F.count_if(v == INFINITY).alias("above"), F.count_if(v == -INFINITY).alias("under"),
            *[F.count_if(v == c).alias(f"code{k}") for k, c in enumerate(CODES)],
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), F.min(x).alias("low"), F.max(x).alias("high"),
            F.count_if(x == 0).alias("zero"), F.count_if(x < 0).alias("negative"), F.bool_and(F.abs(x - near) <= 1e-8 + 1e-5 * F.abs(near)).alias("whole"),
        )
        found = {r["i"]: r.asDict() for r in got.collect()}  # a row per column
        nothing = {**{k: 0 for k in ("rows", "present", "above", "under", "n", "zero", "negative")}, **{f"code{k}": 0 for k in range(len(CODES))}, **{k: None for k in ("mean", "var", "skew", "kurt", "low", "high", "whole")}}
        own = {name: found.get(i, nothing) for i, name in enumerate(self.names)}
        doubtful = {}
        for i, name in enumerate(self.names):
            f = own[name]
            codes = {c: f[f"code{k}"] for k, c in enumerate(CODES) if f[f"code{k}"]}
            finite = f["n"] + sum(codes.values())
            frequent = {c: n for c, n in codes.items() if 100 * n / finite >= fixed.SENTINEL_MIN_PCT}
            rest = [c for c in codes if c not in frequent]
            ends = [x for x in (f["low"], f["high"], *rest) if x is not None]
            outside = {c: n for c, n in frequent.items() if ends and not min(ends) <= c <= max(ends)}
            f |= {"codes": codes, "outside": outside, "several": len(set(ends)) >= 3}
            if len(set(ends)) == 2 and not rest and any(abs(c) < 99 for c in outside):
                doubtful[i] = (f["low"], f["high"])
        # Whether a third value lies between the only two that are known decides on small codes.
        if doubtful:
            side = self.df.sparkSession.createDataFrame([(i, *x) for i, x in doubtful.items()], "i int, low double, high double")
            between = self.cells.join(F.broadcast(side), "i").where("v > low AND v < high").where(~v.isin(*CODES)).select("i").distinct().collect()
            for r in between:  # a row per column
                own[self.names[r["i"]]]["several"] = True
        return {name: self._described(f) for name, f in own.items()}

    @staticmethod
    def _described(f: dict) -> dict:
        sentinels = {c: n for c, n in f["outside"].items() if abs(c) >= 99 or f["several"]}
        m2 = (f["var"] or 0.0) * f["n"]
        moments = (f["n"], f["mean"] or 0.0, m2, (f["skew"] or 0.0) * m2 * math.sqrt(m2) / math.sqrt(f["n"] or 1), ((f["kurt"] or 0.0) + 3) * m2 * m2 / (f["n"] or 1))
        kept = {c: n for c, n in f["codes"].items() if c not in sentinels}
        for c, n in kept.items():
            moments = joined(moments, n, c)
        n, mean, m2, m3, m4 = moments
        ends = [x for x in (f["low"], f["high"], *kept) if x is not None]
        out = {"rows": f["rows"], "missing": f["rows"] - f["present"], "present": f["present"], "infinite_count": f["above"] + f["under"], "infinities": (f["above"] > 0) + (f["under"] > 0), "sentinels": sentinels, "n_values": n}
        if not n:
            return out
        std = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
        return out | {
            "mean": mean, "std": std, "min": min(ends), "max": max(ends), "range": max(ends) - min(ends), "coefficient_of_variation": std / abs(mean) if mean else None,
            "zero_count": f["zero"], "negative_count": f["negative"] + sum(k for c, k in kept.items() if c < 0), "is_integer_like": f["whole"] is not False,
            "skewness": corrected_skewness(n, m2, m3), "kurtosis": corrected_kurtosis(n, m2, m4), "normality_p": normality_p(n, m2, m3, m4),
        }

    @cached_property
    def real(self) -> DataFrame | None:
        """(i, v): finite values without placeholder codes."""
        got = self.cells.where(F.col("v").isNotNull() & (F.abs("v") != INFINITY))
        bad = [(self.names.index(name), c) for name, f in self.counted.items() for c in f["sentinels"]]
        if bad:
            got = got.join(F.broadcast(self.df.sparkSession.createDataFrame(bad, "i int, v double")), ["i", "v"], "left_anti")
        return got

    @cached_property
    def ranked(self) -> dict[str, dict]:
        """Step 2, by column that has values."""
        facts = {self.names.index(name): (f["n_values"], f["min"], f["max"]) for name, f in self.counted.items() if f["n_values"]}
        if not facts:
            return {}
        found = exact_quantiles(self.real, facts, tuple(p for _, p in QUANTILES))
        return {self.names[i]: {n: x for (n, _), x in zip(QUANTILES, q)} for i, q in found.items()}

    @cached_property
    def outlying(self) -> dict[str, dict]:
        """Step 3, by column that has values."""
        bounds = {}
        for name, q in self.ranked.items():
            iqr, f = q["q3"] - q["q1"], self.counted[name]
            low, high = (q["q1"] - 1.5 * iqr, q["q3"] + 1.5 * iqr) if iqr > 0 else (None, None)
            bounds[name] = iqr, low, high, f["mean"], f["std"]
        if not bounds:
            return {}
        side = self.df.sparkSession.createDataFrame([(self.names.index(n), *b[1:]) for n, b in bounds.items()], "i int, low double, high double, mean double, std double")
        far = (F.col("std") > 0) & (F.abs(F.col("v") - F.col("mean")) / F.col("std") > 3)
        got = self.real.join(F.broadcast(side), "i").groupBy("i").agg(F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("out"), F.count_if(far).alias("far"))
        counts = {self.names[r["i"]]: r for r in got.collect()}  # a row per column
        out = {}
        for name, (iqr, low, high, *_) in bounds.items():
            c, n = counts[name], self.counted[name]["n_values"]
            out[name] = {"iqr": iqr, "iqr_outlier_count": c["out"], "iqr_outlier_pct": 100 * c["out"] / n, "iqr_lower_bound": low, "iqr_upper_bound": high, "zscore_outlier_count": c["far"], "zscore_outlier_pct": 100 * c["far"] / n}
        return out

    def distinct_real(self, unique: dict[str, int] | None = None) -> dict[str, int]:
        """Step 4: distinct real values as doubles, by column.

        Where a value is its own double, a known number of distinct values is enough.
        """
        out, ask = {}, []
        for f in self.df.schema.fields:
            if f.name not in self.counted:
                continue
            c = self.counted[f.name]
            injective = isinstance(f.dataType, (T.DoubleType, T.FloatType, T.ByteType, T.ShortType, T.IntegerType)) or isinstance(f.dataType, T.LongType) and max(abs(c.get("min", 0)), abs(c.get("max", 0))) < EXACT
            if not c["n_values"]:
                out[f.name] = 0
            elif unique is not None and injective:
                out[f.name] = unique[f.name] - c["infinities"] - len(c["sentinels"])
            else:
                ask.append(f.name)
        if ask:
            places = [self.names.index(n) for n in ask]
            got = self.real.where(F.col("i").isin(places)).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()
            out |= {self.names[r["i"]]: r["n"] for r in got}
        return out

    def _frame(self, rows: dict[str, dict], fields: list[tuple[str, str]]) -> DataFrame:
        return self.df.sparkSession.createDataFrame([(name, *(r.get(n) for n, _ in fields)) for name, r in rows.items()], ", ".join(["column_name string", *(f"{n} {t}" for n, t in fields)]))

    @cached_property
    def totals(self) -> DataFrame:
        """(column_name, rows, missing, present, infinite_count)."""
        return self._frame(self.counted, TOTALS)

    @cached_property
    def sentinels(self) -> DataFrame:
        """(column_name, code, n): placeholder codes in use."""
        rows = [(name, c, n) for name, f in self.counted.items() for c, n in f["sentinels"].items()]
        return self.df.sparkSession.createDataFrame(rows, "column_name string, code double, n long")

    @cached_property
    def moments(self) -> DataFrame:
        """(column_name, MOMENTS) of columns that have values."""
        return self._frame({n: f for n, f in self.counted.items() if f["n_values"]}, MOMENTS)

    @cached_property
    def quantiles(self) -> DataFrame:
        """(column_name, p01, q1, median, q3, p99)."""
        return self._frame(self.ranked, [(n, "double") for n, _ in QUANTILES])

    @cached_property
    def outliers(self) -> DataFrame:
        """(column_name, OUTLIERS)."""
        return self._frame(self.outlying, OUTLIERS)

    @cached_property
    def distincts(self) -> DataFrame:
        """(column_name, distinct_real_values)."""
        return self._frame({n: {"distinct_real_values": k} for n, k in self.distinct_real().items()}, [("distinct_real_values", "long")])

    def table(self, unique: dict[str, int] | None = None) -> dict[str, dict]:
        """All of it by column, unrounded."""
        distinct = self.distinct_real(unique)
        out = {}
        for name, f in self.counted.items():
            codes = {str(int(c)): n for c, n in sorted(f["sentinels"].items())}
            found = {"sentinel_values": codes, "sentinel_pct": 100 * sum(codes.values()) / f["present"]} if codes else {}
            out[name] = {**f, **found, **self.ranked.get(name, {}), **self.outlying.get(name, {}), "distinct_real_values": distinct[name]}
        return out
