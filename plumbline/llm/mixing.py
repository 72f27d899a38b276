"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with n rows and target weight w (its share of the target size) has the
mean rate w * target / n. Each row draws a count by inverting that Poisson
distribution at a number in [0, 1) hashed from the seed and the row's id, so a
draw needs no state, is the same in every attempt, and rows of a source differ
in their counts only by the hash. Rows are exploded by their counts and dealt to
partitions, and sorted in them, by a second hash: a global shuffle.

The distribution functions are computed once per source, by running sums. Their
table is written, its size is checked, and it is broadcast where it is small; beyond
that it is joined by source, where adaptive execution splits a hot one.

Default weights are proportional to rows ** ``TEMPERATURE`` (0: all sources the
same, 1: as they are).

Defined cases: a null source is a source of its own; null ids share one draw, as
repeated rows do; null, empty and very long texts are rows like others; a source without a
given weight, or of weight 0, gets none; an empty table gives no rows. Columns of
any name pass through; where the input has a name that this adds, the added
column's name ends in underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TEMPERATURE = 0.5
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the parts' MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distributions(by_source: DataFrame) -> DataFrame:
    """(source, cdf) from (source, rate): P(X <= k) for k = 0, 1, ... as far as it differs from 1; written.

    A row for each source and k, and running sums over them, so that the work grows
    with the rate and no faster.
    """
    rate, k = F.col("rate"), F.col("k")
    top = F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 20)).otherwise(0).cast("long")
    rows = by_source.select("source", "rate", F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k")
    log_p = -rate + F.sum(F.when(k > 0, F.log(rate) - F.log(k.cast("double"))).otherwise(0.0)).over(upto)
    cdf = F.when(rate > 0, F.sum("p").over(upto)).otherwise(1.0)
    found = rows.withColumn("p", F.exp(log_p)).withColumn("c", cdf).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("a"))
    return common.materialize(found.select("source", F.transform("a", lambda x: x["c"]).alias("cdf")), "distributions")


def rates(docs: DataFrame, source_col: str, weights: dict | None, target_rows: float | None, temperature: float) -> DataFrame:
    """(source, rate), a row per source."""
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        weighed = counts.join(given, F.col("source").cast("string").eqNullSafe(F.col("k")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighed = common.materialize(weighed, "weights")
    total = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    target, all_weight = float(target_rows if target_rows is not None else total["n"] or 0), float(total["w"] or 0) or 1.0
    return weighed.select("source", (F.lit(target) * F.col("w") / F.lit(all_weight) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None, target_rows: float | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """docs replicated to the weights and shuffled, with copy_no (from 1) and shuffle_key."""
    own, cdf, drawn, many, at = (common.free_name(docs, x) for x in ("_pl_source", "_pl_cdf", "_pl_u", "_pl_n", "_pl_place"))
    by_source = distributions(rates(docs, source_col, weights, target_rows, temperature)).toDF(own, cdf)
    side = F.broadcast(by_source) if common.is_small(by_source) else by_source
    joined = docs.join(side, F.col(f"`{source_col}`").eqNullSafe(F.col(own)))
    u = uniform(F.lit(seed), F.col(f"`{id_col}`"))
    counted = joined.withColumn(drawn, u).withColumn(many, F.size(F.filter(cdf, lambda x: x <= F.col(drawn))))
    names = [F.col(f"`{c}`") for c in docs.columns]
    number, place = common.free_name(docs, "copy_no"), common.free_name(docs, "shuffle_key")
    copies = counted.where(F.col(many) > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col(many))).alias(number))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.col(number).cast("string")))
    keyed = copies.withColumn(place, F.substring(key, 1, 16))
    # The place in the input spreads rows that are equal in all else.
    dealt = keyed.withColumn(at, F.monotonically_increasing_id()).repartition(F.xxhash64(place, at))
    return dealt.sortWithinPartitions(place).drop(at)


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents, at its own size, with weights by the square root of a source's rows."""
    return mix(common.table(spark, sf_dir, "documents"))


SQL = """
WITH c AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c) * w / (SELECT sum(w) FROM c) / n AS rate FROM c),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r),
p AS (SELECT source, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT *, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (WHERE f.cdf <= u.u) AS n
      FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy_no,
       substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(c AS VARCHAR)), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS c FROM n)
"""
