"""Queries over the star-schema tables, one for each operator, with SQL for their results.

The tables are clean, so most queries read a view that makes one kind of dirt in
a fixed way. A view is stated once, as SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .operators import chunks, dataset, frequency
from .operators import issues as rules
from .operators.columns import Profile
from .operators.retrieval import Index, cosine_topk, retrieval_accuracy

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: View name -> (base table, SQL that both engines read).
VIEWS = {
    "orders_missing": ("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 < 2 THEN NULL ELSE o_totalprice END AS few, CASE WHEN o_orderkey % 100 < 15 THEN NULL ELSE o_totalprice END AS part_left, CASE WHEN o_orderkey % 100 < 40 THEN NULL ELSE o_totalprice END AS many, CASE WHEN o_orderkey % 100 < 100 THEN NULL ELSE o_totalprice END AS none_left, CASE WHEN o_orderkey % 100 < 40 THEN NULL ELSE o_orderpriority END AS words FROM orders"),
    "orders_dup": ("orders", "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0"),
    "customer_sentinel": ("customer", "SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN -9999.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 40 = 0 THEN 999999 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer"),
    "events_inf": ("events", "SELECT event_id, CASE WHEN event_id % 25 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS value, user_id FROM events"),
    "part_text_price": ("part", "SELECT p_partkey, CASE WHEN p_partkey % 25 = 0 THEN 'unknown' WHEN p_partkey % 25 = 1 THEN '-' ELSE concat('$', CAST(CAST(floor(p_retailprice) AS INT) AS STRING)) END AS price, CAST(p_size AS STRING) AS size_text, p_brand, p_name FROM part"),
    "orders_text_date": ("orders", "SELECT o_orderkey, concat(CAST(year(o_orderdate) AS STRING), '-', right(concat('0', CAST(month(o_orderdate) AS STRING)), 2), '-', right(concat('0', CAST(day(o_orderdate) AS STRING)), 2)) AS iso, concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', right(CAST(year(o_orderdate) AS STRING), 2)) AS short, concat(CAST(day(o_orderdate) AS STRING), ' ', substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) * 3 - 2 AS INT), 3), ' ', CAST(year(o_orderdate) AS STRING)) AS spelled, o_orderpriority FROM orders"),
    "events_mixed": ("events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE event_type END AS mixed, event_type FROM events"),
    "orders_const": ("orders", "SELECT o_orderkey, o_totalprice, 'X' AS flag, CASE WHEN o_orderkey % 50 = 0 THEN 'rare' ELSE 'common' END AS skewed FROM orders"),
    "orders_flags": ("orders", "SELECT o_orderkey, o_totalprice > 150000.0 AS big, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS done FROM orders"),
    "orders_decimal": ("orders", "SELECT CAST(o_orderkey AS DECIMAL(20,0)) + CAST('70000000000000000000' AS DECIMAL(20,0)) AS wide_key, CAST(o_orderkey % 1000 AS DECIMAL(20,0)) + CAST('70000000000000000000' AS DECIMAL(20,0)) AS wide_part, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders"),
    "events_text_time": ("events", "SELECT event_id, concat(CAST(year(ts) AS STRING), '-', right(concat('0', CAST(month(ts) AS STRING)), 2), '-', right(concat('0', CAST(day(ts) AS STRING)), 2), ' ', right(concat('0', CAST(hour(ts) AS STRING)), 2), ':', right(concat('0', CAST(minute(ts) AS STRING)), 2)) AS plain, concat(CAST(year(ts) AS STRING), '.', right(concat('0', CAST(month(ts) AS STRING)), 2), '.', right(concat('0', CAST(day(ts) AS STRING)), 2), 'T', right(concat('0', CAST(hour(ts) AS STRING)), 2), ':', right(concat('0', CAST(minute(ts) AS STRING)), 2), ':07Z') AS zulu, concat(CAST(month(ts) AS STRING), '/', CAST(day(ts) AS STRING), '/', CAST(year(ts) AS STRING), ' ', CAST((hour(ts) + 11) % 12 + 1 AS STRING), ':', right(concat('0', CAST(minute(ts) AS STRING)), 2), CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END) AS noon, concat(CAST(month(ts) AS STRING), '-', CAST(hour(ts) AS STRING), ':', CAST(minute(ts) AS STRING)) AS neither FROM events"),
    "part_padded": ("part", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN repeat(' ', 300) WHEN p_partkey % 3 = 1 THEN concat(repeat(' ', 300), 'N/A ') ELSE concat(repeat(' ', 280), CAST(p_size AS STRING), repeat(' ', 20)) END AS padded, CASE WHEN p_partkey % 2 = 0 THEN repeat(concat(p_brand, ' '), 40) ELSE p_brand END AS long_brand FROM part"),
    "orders_eighths": ("orders", "SELECT o_orderkey, CASE WHEN o_orderkey <= 1 THEN NULL ELSE o_totalprice END AS one_gone, CASE WHEN o_orderkey <= 3 THEN NULL ELSE o_totalprice END AS three_gone FROM orders WHERE o_orderkey <= 800"),
    "document_notes": ("documents", "SELECT doc_id, concat('preamble\\n## First\\n', text, '\\n### More\\n## Second\\n', text) AS text FROM documents"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view."""
    base, sql = VIEWS.get(name, (name, None))
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return spark.sql(sql.replace(f"FROM {base}", "FROM {t}").replace("\\n", "\\n"), t=df) if sql else df


def duck(name: str) -> str:
    """A view as a subquery for DuckDB, or the table's name."""
    return f"({VIEWS[name][1].replace('AS STRING', 'AS VARCHAR').replace(chr(92) + 'n', chr(10))})" if name in VIEWS else name


#: Tables whose numeric columns the numeric queries describe, with these columns.
NUMERIC = {
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "customer_sentinel": ("c_custkey", "c_acctbal", "c_nationkey"),
    "events_inf": ("event_id", "value", "user_id"),
    "events": ("event_id", "user_id", "value"),
}
TEXTS = {
    "part_text_price": ("price", "size_text", "p_brand", "p_name"),
    "orders_text_date": ("iso", "short", "spelled", "o_orderpriority"),
    "events_mixed": ("mixed", "event_type"),
    "events_text_time": ("plain", "zulu", "noon", "neither"),
    "part_padded": ("padded", "long_brand"),
}
#: Columns of the views whose issues are derived, by kind, in order of the schema.
ISSUES = {
    "events": {"event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": "categorical", "value": "numeric", "props": "categorical"},
    "orders_missing": {"o_orderkey": "numeric", "few": "numeric", "part_left": "numeric", "many": "numeric", "none_left": "numeric", "words": "categorical"},
    "orders_dup": {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical"},
    "customer_sentinel": {"c_custkey": "numeric", "c_acctbal": "numeric", "c_nationkey": "numeric", "c_mktsegment": "categorical"},
    "events_inf": {"event_id": "numeric", "value": "numeric", "user_id": "numeric"},
    "part_text_price": {"p_partkey": "numeric", "price": "categorical", "size_text": "categorical", "p_brand": "categorical", "p_name": "categorical"},
    "orders_text_date": {"o_orderkey": "numeric", "iso": "categorical", "short": "categorical", "spelled": "categorical", "o_orderpriority": "categorical"},
    "events_mixed": {"event_id": "numeric", "mixed": "categorical", "event_type": "categorical"},
    "orders_const": {"o_orderkey": "numeric", "o_totalprice": "numeric", "flag": "categorical", "skewed": "categorical"},
}


def _long(name: str, columns, kind: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS {kind}) AS v FROM {duck(name)}" for c in columns)


def _real(name: str, columns=None) -> str:
    """CTEs: r has the finite values of numeric columns without placeholder codes."""
    codes = ", ".join(f"({c})" for c in fixed.SENTINEL_CODES)
    return f"""u AS ({_long(name, columns or NUMERIC[name], 'DOUBLE')}),
f AS (SELECT * FROM u WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)),
fc AS (SELECT column_name, count(*) AS n FROM f GROUP BY 1),
q AS (SELECT column_name, v AS code, count(*) AS c FROM f WHERE v IN (SELECT * FROM (VALUES {codes})) GROUP BY 1, 2),
qf AS (SELECT q.* FROM q JOIN fc USING (column_name) WHERE 100 * c / n >= {fixed.SENTINEL_MIN_PCT}),
ot AS (SELECT column_name, min(v) AS low, max(v) AS high, count(DISTINCT v) AS kinds FROM f WHERE NOT EXISTS (SELECT 1 FROM qf WHERE qf.column_name = f.column_name AND code = v) GROUP BY 1),
sc AS (SELECT qf.* FROM qf JOIN ot USING (column_name) WHERE (code < low OR code > high) AND (abs(code) >= 99 OR kinds >= 3)),
r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.column_name = f.column_name AND code = v)),
m AS (SELECT column_name, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS lo, max(v) AS hi FROM r GROUP BY 1)"""


def _profile(name: str) -> Callable:
    return lambda part: lambda spark, sf_dir: part(Profile(read(spark, sf_dir, name)))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _share(part: str, whole: str):
    """part of whole in percent to two digits, rounded as SQL rounds: of 100 times the double, halves away from zero; NaN of nothing."""
    return F.when(F.col(whole) > 0, F.round(100 * F.col(part) / F.nullif(F.col(whole), F.lit(0)) * 100) / 100).otherwise(F.lit(float("nan")))


def _numeric(part: Callable, sql: str, name: str = "lineitem"):
    """A numeric query over one table and its SQL, which follows the CTEs of _real."""
    return (lambda spark, sf_dir: _rounded(part(Profile(read(spark, sf_dir, name).select(*NUMERIC[name])).numeric)), f"WITH {_real(name)} {sql}")


def _shape_sql() -> str:
    return "SELECT column_name, round(CASE WHEN lo = hi THEN 0 ELSE s END, 4) AS skewness, round(CASE WHEN lo = hi THEN 0 ELSE k END, 4) AS kurtosis FROM m JOIN (SELECT column_name, skewness(v) AS s, kurtosis(v) AS k FROM r GROUP BY 1) USING (column_name)"


def _normality_sql() -> str:
    return """, a AS (SELECT column_name, CAST(n AS DOUBLE) AS n, CASE WHEN lo < hi THEN s3 / n / pow(s2 / n, 1.5) END AS g1, CASE WHEN lo < hi THEN s4 / n / pow(s2 / n, 2) END AS b2 FROM m JOIN (SELECT column_name, sum(pow(v - mean, 2)) AS s2, sum(pow(v - mean, 3)) AS s3, sum(pow(v - mean, 4)) AS s4 FROM r JOIN m USING (column_name) GROUP BY 1) USING (column_name)),
b AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM a),
c AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM b),
d AS (SELECT *, 1 + x * sqrt(2 / (aa - 4)) AS dd FROM c)
SELECT column_name, round(CASE WHEN n >= 20 THEN exp(-(z1 * z1 + pow((1 - 2 / (9 * aa) - sign(dd) * cbrt((1 - 2 / aa) / abs(dd))) / sqrt(2 / (9 * aa)), 2)) / 2) END, 6) AS normality_p FROM d"""


def _text(name: str, columns=None) -> str:
    """CTEs: t has texts with what they are."""
    blank = "regexp_replace(v, '^\\s+|\\s+$', '', 'g')"
    plain = f"regexp_replace(regexp_replace(regexp_replace({blank}, '^\\((.+)\\)$', '-\\1'), '(\\d),(\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g'), '[\\s$€£¥₹%]', '', 'g')"
    number = f"'{fixed.NUMBER}'"
    shape = fixed.DATE_SHAPE
    formats = "['%Y-%m-%d', '%m/%d/%y', '%d/%m/%y', '%m/%d/%Y', '%d/%m/%Y', '%d %b %Y', '%Y-%m-%d %H:%M', '%Y.%m.%dT%H:%M:%SZ', '%m/%d/%Y %I:%M %p']"
    places = ", ".join(f"'{p}'" for p in fixed.PLACEHOLDERS)
    return f"""w AS ({_long(name, columns or TEXTS[name], 'VARCHAR')}),
t AS (SELECT column_name, v, lower({blank}) IN ({places}) AS ph, {blank} = '' AS blank, regexp_full_match({blank}, {number}) AS raw, regexp_full_match({plain}, {number}) AS clean,
  CASE WHEN regexp_matches(v, '{shape}') THEN try_strptime(v, {formats}) END AS dt FROM w WHERE v IS NOT NULL),
s AS (SELECT column_name, count(*) AS present, count(*) FILTER (NOT ph) AS real, count(*) FILTER (NOT ph AND raw) AS raw, count(*) FILTER (NOT ph AND clean) AS clean, count(*) FILTER (NOT ph AND dt IS NOT NULL) AS dated FROM t GROUP BY 1)"""


def _issues_sql(name: str, target: str | None = None) -> str:
    """The issues of a view: statistics of each column, rounded, then the rules on them."""
    kinds = {c: k for c, k in ISSUES[name].items() if c != target}
    numeric, words = ([c for c, k in kinds.items() if k == kind] for kind in ("numeric", "categorical"))
    table = duck(name)
    common = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS ordinal, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS missing, count({c}) AS present, count(DISTINCT {c}) AS uniq FROM {table}" for i, (c, k) in enumerate(kinds.items()))
    parts, joins = [f"common AS ({common})", f"d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM {table}))"], "common CROSS JOIN d"
    numbers = ("dreal", "skew", "outside", "p01", "p99", "whole", "infinite", "codes")
    if numeric:
        out = "q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))"
        parts += [
            _real(name, numeric),
            f"""num AS (SELECT column_name, count(DISTINCT v) AS dreal, CASE WHEN any_value(lo) = any_value(hi) THEN 0 ELSE round_even(skewness(v), 4) END AS skew, round_even(100.0 * count(*) FILTER ({out}) / count(*), 2) AS outside,
  round_even(quantile_cont(v, 0.01), 4) AS p01, round_even(quantile_cont(v, 0.99), 4) AS p99, bool_and(abs(v - round_even(v, 0)) <= 1e-8 + 1e-5 * abs(round_even(v, 0))) AS whole FROM r JOIN m USING (column_name) GROUP BY 1)""",
            "odd AS (SELECT column_name, count(*) FILTER (isinf(v)) AS infinite FROM u GROUP BY 1)",
            "coded AS (SELECT column_name, count(*) AS codes FROM sc GROUP BY 1)",
        ]
        joins += " LEFT JOIN num USING (column_name) LEFT JOIN odd USING (column_name) LEFT JOIN coded USING (column_name)"
    texts = ("share", "number", "dated", "top")
    if words:
        parts += [
            _text(name, words),
            "txt AS (SELECT column_name, round_even(clean / greatest(real, 1), 3) AS share, clean > 0.9 * real AS number, dated > 0.9 * real AS dated FROM s)",
            "tops AS (SELECT column_name, max(c) AS top FROM (SELECT column_name, v, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1)",
        ]
        joins += " LEFT JOIN txt USING (column_name) LEFT JOIN tops USING (column_name)"
    absent = [f"NULL AS {x}" for x in numbers if not numeric] + [f"NULL AS {x}" for x in texts if not words]
    key = f"missing = 0 AND uniq > 1 AND uniq = d AND uniq >= {fixed.KEY_UNIQUE_SHARE} * n"
    parts.append(f"st AS (SELECT *, round_even(100.0 * missing / n, 2) AS miss, {key} AS is_key{''.join(', ' + x for x in absent)} FROM {joins})")
    feature, text_ = "kind = 'numeric' AND coalesce(dreal, 0) > 2", "kind = 'categorical' AND present > 0"
    label = f"{text_} AND NOT number AND NOT dated"
    rules = (
        ("constant_column", "uniq = 1", "55"), ("empty_column", "miss >= 100", "95"), ("high_missing", f"miss >= {fixed.HIGH_MISSING_PCT} AND miss < 100", "60 + miss * 0.35"),
        ("moderate_missing", f"miss >= {fixed.MODERATE_MISSING_PCT} AND miss < {fixed.HIGH_MISSING_PCT}", "35 + miss"), ("low_missing", f"miss > 0 AND miss < {fixed.MODERATE_MISSING_PCT}", "15 + miss"),
        ("infinite_values", "coalesce(infinite, 0) > 0", "75"), ("sentinel_values", "coalesce(codes, 0) > 0", "72"), ("high_skew", f"{feature} AND abs(skew) >= {fixed.HIGH_SKEW}", "45 + least(abs(skew), 5) * 8"),
        ("outliers", f"{feature} AND outside >= {fixed.OUTLIER_PCT}", "40 + least(outside, 20) * 1.5"), ("numeric_stored_as_text", f"{text_} AND number", "70"), ("datetime_stored_as_text", f"{text_} AND dated AND NOT number", "65"),
        ("mixed_types", f"{text_} AND share > {fixed.MIXED_LOW} AND share <= {fixed.MIXED_HIGH}", "60"), ("identifier_like", f"is_key AND (({feature} AND whole) OR ({label}))", "50"),
        ("high_cardinality", f"{label} AND NOT is_key AND uniq >= {fixed.MANY_LEVELS}", "55"), ("needs_encoding", f"{label} AND NOT is_key AND uniq > 1 AND uniq < {fixed.MANY_LEVELS}", "25"),
        ("imbalanced_category", f"{text_} AND uniq > 1 AND round_even(100.0 * top / present, 2) >= {fixed.DOMINANT_PCT}", "45"),
    )
    found = [f"SELECT column_name, '{kind}' AS issue_type, {k} AS rule, CAST({score} AS DOUBLE) AS score, replace('{fixed.QUESTIONS[kind]}', '{{type}}', kind) AS rag_query FROM st WHERE {when}" for k, (kind, when, score) in enumerate(rules)]
    found.append(f"SELECT NULL, 'duplicate_rows', -2, 40 + round_even(100.0 * (max(n) - max(d)) / max(n), 2), '{fixed.QUESTIONS['duplicate_rows']}' FROM st HAVING max(n) > max(d) AND {len(ISSUES[name])} >= {fixed.DUPLICATES_MIN_COLUMNS}")
    scale = "greatest(abs(p01), abs(p99))"
    found.append(f"SELECT NULL, 'mixed_feature_scales', -1, 45.0, '{fixed.QUESTIONS['mixed_feature_scales']}' FROM st WHERE {feature} AND NOT (is_key AND whole) AND {scale} > 0 HAVING count(*) >= 2 AND max({scale}) / min({scale}) > {fixed.SCALE_RATIO}")
    parts.append(f"i AS ({' UNION ALL '.join(found)})")
    return f"""WITH {', '.join(parts)}
SELECT CAST(row_number() OVER (ORDER BY round_even(least(score, 100), 1) DESC, coalesce(column_name, 'None'), rule) AS INT) AS rank, column_name, issue_type, round_even(least(score, 100), 1) AS severity_score,
  CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS severity, rag_query FROM i"""


def _issue_queries() -> dict[str, tuple]:
    """The issues of each view, of one kind each, and the transforms of their ranking, with SQL."""
    def over(name: str, then: Callable = lambda x: x, target: str | None = None):
        return lambda spark, sf_dir: then(rules.issues(Profile(read(spark, sf_dir, name)), target))

    found: dict[str, tuple] = {f"issues_{name}": (over(name), _issues_sql(name)) for name in ISSUES}
    every = f"({_issues_sql('orders_missing')})"
    found["top_issues"] = over("orders_missing", lambda x: rules.top_issues(x, 3)), f"SELECT * FROM {every} WHERE rank <= 3"
    found["issues_with_target"] = over("orders_missing", target="many"), _issues_sql("orders_missing", "many")
    found["select_issues"] = over("orders_missing", lambda x: rules.select_issues(x, 2)), f"WITH e AS {every} SELECT * FROM e WHERE rank <= 2 OR column_name IN (SELECT column_name FROM e WHERE rank <= 2)"
    alone = "CASE WHEN column_name IS NULL THEN rank ELSE 0 END"
    found["plan_requests"] = over("orders_missing", rules.plan_requests), f"SELECT CAST(row_number() OVER (ORDER BY f) AS INT) AS request, column_name, issue_types FROM (SELECT column_name, min(rank) AS f, string_agg(issue_type, ',' ORDER BY rank) AS issue_types FROM {every} GROUP BY column_name, {alone})"
    return found


#: A text's sentences as a list: a mark is put where one ends, as DuckDB's patterns can't look around.
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(replace(replace({0}, chr(10) || chr(10), ' '), chr(10), ' ')), '([.!?])[\s\x0B]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def _sentences_sql() -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INT) AS sentence_index, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS l FROM documents))"


def _sections_sql() -> str:
    space = "' ' || chr(10) || chr(9) || chr(13)"
    return f"SELECT doc_id, CAST(i AS INT) AS section_index, title, content FROM (SELECT doc_id, 0 AS i, 'First' AS title, trim(text || chr(10) || 'More.', {space}) AS content FROM documents UNION ALL SELECT doc_id, 1, 'Second', trim(text, {space}) FROM documents) WHERE content <> ''"


def _pack_sql() -> str:
    """Sentences folded one by one: f holds what is open after sentence i and what it closed (a before it, b with it)."""
    return f"""WITH RECURSIVE sections AS ({_sections_sql()}),
q AS (SELECT doc_id, section_index, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, section_index, {_SENTENCES.format('content')} AS l FROM sections)),
f AS (SELECT doc_id, section_index, CAST(0 AS BIGINT) AS i, '' AS open, CAST(0 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM sections
  UNION ALL SELECT doc_id, section_index, i, CASE WHEN z >= {fixed.CHUNK_TARGET} THEN '' ELSE o END, CASE WHEN z >= {fixed.CHUNK_TARGET} THEN 0 ELSE z END, CASE WHEN fresh THEN open END, CASE WHEN z >= {fixed.CHUNK_TARGET} THEN o END
  FROM (SELECT *, CASE WHEN fresh OR open = '' THEN s ELSE open || ' ' || s END AS o, CASE WHEN fresh THEN 0 ELSE size END + length(s) + 1 AS z
    FROM (SELECT f.doc_id, f.section_index, q.i, f.open, f.size, q.s, f.size + length(q.s) > {fixed.CHUNK_MAX} AND f.open <> '' AS fresh FROM f JOIN q ON q.doc_id = f.doc_id AND q.section_index = f.section_index AND q.i = f.i + 1))),
closed AS (SELECT doc_id, section_index, row_number() OVER (PARTITION BY doc_id, section_index ORDER BY i, k) AS c, chunk FROM (SELECT doc_id, section_index, i, 1 AS k, a AS chunk FROM f UNION ALL SELECT doc_id, section_index, i, 2, b FROM f) WHERE chunk IS NOT NULL),
many AS (SELECT doc_id, section_index, max(c) AS c FROM closed GROUP BY ALL),
rest AS (SELECT doc_id, section_index, arg_max(open, i) AS open FROM f GROUP BY ALL),
tail AS (SELECT rest.*, coalesce(many.c, 0) AS c FROM rest LEFT JOIN many USING (doc_id, section_index) WHERE open <> ''),
chunks AS (SELECT closed.doc_id, closed.section_index, closed.c, closed.chunk || CASE WHEN tail.open IS NOT NULL AND closed.c = tail.c AND length(tail.open) < {fixed.CHUNK_TAIL} THEN ' ' || tail.open ELSE '' END AS chunk FROM closed LEFT JOIN tail USING (doc_id, section_index)
  UNION ALL SELECT doc_id, section_index, c + 1, open FROM tail WHERE c = 0 OR length(open) >= {fixed.CHUNK_TAIL})
SELECT doc_id, section_index, title AS section, CAST(c - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id, section_index) AS INT) AS n_chunks_in_section, title || chr(10) || chr(10) || chunk AS text FROM chunks JOIN sections USING (doc_id, section_index)"""


def _catalogue() -> dict[str, tuple]:
    """name -> (callable, SQL or None)."""
    q: dict[str, tuple] = {}

    def simple(part):
        return lambda name: lambda spark, sf_dir: part(read(spark, sf_dir, name))

    q["dataset_overview"] = (simple(dataset.overview)("orders_missing"), f"SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, count(*) * 6 AS n_cells, CAST(sum(m) AS BIGINT) AS missing_cells, round(100.0 * sum(m) / (count(*) * 6), 2) AS missing_cells_pct FROM (SELECT {' + '.join(f'({c} IS NULL)::INT' for c in ('o_orderkey', 'few', 'part_left', 'many', 'none_left', 'words'))} AS m FROM {duck('orders_missing')})")
    q["duplicate_rows"] = (simple(dataset.duplicate_rows)("orders_dup"), f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(100.0 * sum(n - 1) / sum(n), 2) AS duplicate_rows_pct FROM (SELECT count(*) AS n FROM {duck('orders_dup')} GROUP BY ALL HAVING true) x" .replace("SELECT count(*) AS n FROM", "SELECT count(*) AS n, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM"))
    q["column_types"] = (simple(dataset.column_types)("lineitem"), "SELECT semantic_type, count(*) AS n_columns FROM (SELECT CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'categorical' END AS semantic_type FROM information_schema.columns WHERE table_name = 'lineitem') GROUP BY 1")
    q["column_missing"] = (simple(dataset.column_missing)("orders_missing"), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS missing_pct FROM {duck('orders_missing')}" for c in ("o_orderkey", "few", "part_left", "many", "none_left", "words")))
    q["estimated_bytes"] = (simple(dataset.estimated_bytes)("nation"), "SELECT 'n_nationkey' AS column_name, CAST(4 * count(*) AS BIGINT) AS estimated_bytes FROM nation UNION ALL SELECT 'n_name', CAST(sum(octet_length(encode(n_name))) AS BIGINT) FROM nation UNION ALL SELECT 'n_regionkey', CAST(4 * count(*) AS BIGINT) FROM nation")
    for name, widths in (("lineitem", (8, 8, 8, 4, 8, 8, 8, 8, 0, 0, 8)), ("documents", (8, 0, 0, 0, 8)), ("customer", (8, 0, 4, 8, 0))):
        of = {"lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), "documents": ("doc_id", "text", "lang", "source", "n_chars"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}[name]
        q[f"estimated_bytes_{name}"] = (simple(dataset.estimated_bytes)(name), " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({f'{w} * count(*)' if w else f'coalesce(sum(octet_length(encode({c}))), 0)'} AS BIGINT) AS estimated_bytes FROM {name}" for c, w in zip(of, widths)))
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    q["column_cardinality"] = (lambda spark, sf_dir: frequency.distinct_counts(read(spark, sf_dir, "lineitem")).select("column_name", "unique_count", _share("unique_count", "present").alias("unique_pct"), (F.col("unique_count") == 1).alias("is_constant")), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, round(100.0 * count(DISTINCT {c}) / count({c}), 2) AS unique_pct, count(DISTINCT {c}) = 1 AS is_constant FROM lineitem" for c in columns))
    keys = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    q["unique_keys"] = (lambda spark, sf_dir: Profile(read(spark, sf_dir, "orders_dup")).common.select("column_name", "is_unique_key"), f"WITH o AS {duck('orders_dup')}, d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM o)) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) = count(*) AND count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) = (SELECT n FROM d) AND count(DISTINCT {c}) >= 0.9 * count(*) AS is_unique_key FROM o" for c in keys))

    q["infinite_values"] = _numeric(lambda s: s.totals.select("column_name", "infinite_count"), "SELECT column_name, count(*) FILTER (isinf(v)) AS infinite_count FROM u GROUP BY 1", "events_inf")
    q["sentinel_codes"] = _numeric(lambda s: s.sentinels.select("column_name", "code", "n"), "SELECT column_name, code, c AS n FROM sc", "customer_sentinel")
    q["numeric_moments"] = _numeric(lambda s: s.moments.select("column_name", "n_values", "mean", "std", "min", "max", "range", "coefficient_of_variation", "zero_count", "negative_count"), "SELECT column_name, n AS n_values, round(mean, 4) AS mean, round(sd, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(hi - lo, 4) AS range, round(CASE WHEN mean <> 0 THEN sd / abs(mean) END, 4) AS coefficient_of_variation, z AS zero_count, g AS negative_count FROM m JOIN (SELECT column_name, count(*) FILTER (v = 0) AS z, count(*) FILTER (v < 0) AS g FROM r GROUP BY 1) USING (column_name)")
    q["distinct_real_values"] = _numeric(lambda s: s.distincts, "SELECT column_name, count(DISTINCT v) AS distinct_real_values FROM r GROUP BY 1")
    q["sentinel_moments"] = _numeric(lambda s: s.moments.select("column_name", "n_values", "mean", "std", "min", "max", "skewness", "kurtosis"), "SELECT column_name, n AS n_values, round(mean, 4) AS mean, round(sd, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(s, 4) AS skewness, round(k, 4) AS kurtosis FROM m JOIN (SELECT column_name, skewness(v) AS s, kurtosis(v) AS k FROM r GROUP BY 1) USING (column_name)", "customer_sentinel")
    q["numeric_quantiles"] = _numeric(lambda s: s.quantiles, "SELECT column_name, " + ", ".join(f"round(quantile_cont(v, {p}), 4) AS {n}" for n, p in (("p01", 0.01), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p99", 0.99))) + " FROM r GROUP BY 1")
    q["numeric_shape"] = _numeric(lambda s: s.moments.select("column_name", "skewness", "kurtosis"), _shape_sql())
    q["normality"] = (lambda spark, sf_dir: Profile(read(spark, sf_dir, "events").select(*NUMERIC["events"])).numeric.moments.select("column_name", F.round("normality_p", 6).alias("normality_p")), f"WITH {_real('events')} {_normality_sql()}")
    q["integer_like"] = _numeric(lambda s: s.moments.select("column_name", "is_integer_like"), "SELECT column_name, bool_and(abs(v - round_even(v, 0)) <= 1e-8 + 1e-5 * abs(round_even(v, 0))) AS is_integer_like FROM r GROUP BY 1")
    outside = "q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))"
    q["iqr_outliers"] = _numeric(lambda s: s.outliers.select("column_name", "iqr_outlier_count", "iqr_outlier_pct", "iqr_lower_bound", "iqr_upper_bound"), f"SELECT column_name, count(*) FILTER ({outside}) AS iqr_outlier_count, round(100.0 * count(*) FILTER ({outside}) / count(*), 4) AS iqr_outlier_pct, round(CASE WHEN any_value(q3) > any_value(q1) THEN any_value(q1) - 1.5 * (any_value(q3) - any_value(q1)) END, 4) AS iqr_lower_bound, round(CASE WHEN any_value(q3) > any_value(q1) THEN any_value(q3) + 1.5 * (any_value(q3) - any_value(q1)) END, 4) AS iqr_upper_bound FROM r JOIN m USING (column_name) GROUP BY 1", "events")
    q["zscore_outliers"] = _numeric(lambda s: s.outliers.select("column_name", "zscore_outlier_count", "zscore_outlier_pct"), "SELECT column_name, count(*) FILTER (sd > 0 AND abs(v - mean) / sd > 3) AS zscore_outlier_count, round(100.0 * count(*) FILTER (sd > 0 AND abs(v - mean) / sd > 3) / count(*), 4) AS zscore_outlier_pct FROM r JOIN m USING (column_name) GROUP BY 1", "events")

    def texts(part: Callable, sql: str, name: str = "part_text_price"):
        return (lambda spark, sf_dir: part(Profile(read(spark, sf_dir, name).select(*TEXTS[name])).text), f"WITH {_text(name)} {sql}")

    q["category_mode"] = texts(lambda s: s.ranked.where("place = 1").select("column_name", F.col("v").alias("mode"), F.col("n").alias("mode_freq")), "SELECT column_name, v AS mode, n AS mode_freq FROM (SELECT column_name, v, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, v) AS p FROM t GROUP BY 1, 2) WHERE p = 1")
    q["top_values"] = texts(lambda s: s.ranked, "SELECT column_name, CAST(p AS INT) AS place, v, n FROM (SELECT column_name, v, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, v) AS p FROM t GROUP BY 1, 2) WHERE p <= 10")
    q["text_lengths"] = texts(lambda s: s.shares.select("column_name", F.round("mean_length", 2).alias("mean_length"), "max_length", "empty_string_count"), "SELECT column_name, round(avg(length(v)), 2) AS mean_length, CAST(max(length(v)) AS INT) AS max_length, count(*) FILTER (blank) AS empty_string_count FROM t GROUP BY 1")
    q["missing_placeholders"] = texts(lambda s: s.shares.select("column_name", "missing_placeholder_count"), "SELECT column_name, count(*) FILTER (ph) AS missing_placeholder_count FROM t GROUP BY 1")
    q["numeric_text"] = texts(lambda s: s.shares.select("column_name", F.round("raw_fraction", 3).alias("raw_fraction")), "SELECT column_name, round(raw / real, 3) AS raw_fraction FROM s", "events_mixed")
    q["numeric_text_clean"] = texts(lambda s: s.shares.select("column_name", F.round("numeric_fraction", 3).alias("numeric_fraction"), "looks_numeric", "numeric_needs_cleaning"), "SELECT column_name, round(clean / real, 3) AS numeric_fraction, clean / real > 0.9 AS looks_numeric, clean / real > 0.9 AND raw < clean AS numeric_needs_cleaning FROM s")
    q["datetime_text"] = texts(lambda s: s.shares.select("column_name", F.round("datetime_fraction", 3).alias("datetime_fraction"), "looks_datetime"), "SELECT column_name, round(dated / real, 3) AS datetime_fraction, dated / real > 0.9 AS looks_datetime FROM s", "orders_text_date")
    q["datetime_text_span"] = texts(lambda s: s.spans.select("column_name", F.round("datetime_span_days", 1).alias("datetime_span_days"), "distinct_years", "distinct_months"), "SELECT column_name, round(date_diff('second', min(dt), max(dt)) / 86400.0, 1) AS datetime_span_days, count(DISTINCT year(dt)) AS distinct_years, count(DISTINCT date_trunc('month', dt)) AS distinct_months FROM t JOIN s USING (column_name) WHERE dated / s.real > 0.9 AND dt IS NOT NULL GROUP BY 1", "orders_text_date")

    q["datetime_text_times"] = texts(lambda s: s.shares.select("column_name", F.round("datetime_fraction", 3).alias("datetime_fraction"), "looks_datetime"), "SELECT column_name, round(dated / real, 3) AS datetime_fraction, dated / real > 0.9 AS looks_datetime FROM s", "events_text_time")
    q["datetime_text_times_span"] = texts(lambda s: s.spans.select("column_name", F.round("datetime_span_days", 1).alias("datetime_span_days"), "distinct_years", "distinct_months"), "SELECT column_name, round(date_diff('second', min(dt), max(dt)) / 86400.0, 1) AS datetime_span_days, count(DISTINCT year(dt)) AS distinct_years, count(DISTINCT date_trunc('month', dt)) AS distinct_months FROM t JOIN s USING (column_name) WHERE dated / s.real > 0.9 AND dt IS NOT NULL GROUP BY 1", "events_text_time")
    q["padded_texts"] = texts(lambda s: s.shares.select("column_name", F.round("mean_length", 2).alias("mean_length"), "max_length", "empty_string_count", "missing_placeholder_count", F.round("numeric_fraction", 3).alias("numeric_fraction")), "SELECT column_name, round(avg(length(v)), 2) AS mean_length, CAST(max(length(v)) AS INT) AS max_length, count(*) FILTER (blank) AS empty_string_count, count(*) FILTER (ph) AS missing_placeholder_count, round(any_value(s.clean) / any_value(s.real), 3) AS numeric_fraction FROM t JOIN s USING (column_name) GROUP BY 1", "part_padded")
    q["long_text_mode"] = texts(lambda s: s.ranked.where("place = 1 AND column_name = 'padded'").select("column_name", "v", "n"), "SELECT column_name, v, count(*) AS n FROM t WHERE column_name = 'padded' GROUP BY 1, 2 ORDER BY n DESC LIMIT 1", "part_padded")
    wide = ("wide_key", "wide_part", "price")
    q["decimal_keys"] = (lambda spark, sf_dir: Profile(read(spark, sf_dir, "orders_decimal")).common.select("column_name", "unique_count", "is_unique_key"), f"WITH o AS {duck('orders_decimal')}, d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM o)) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, count({c}) = count(*) AND count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) = (SELECT n FROM d) AND count(DISTINCT {c}) >= 0.9 * count(*) AS is_unique_key FROM o" for c in wide))
    q["missing_half_even"] = (simple(dataset.column_missing)("orders_eighths"), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, round_even(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS missing_pct FROM {duck('orders_eighths')}" for c in ("o_orderkey", "one_gone", "three_gone")))
    q["datetime_stats"] = (lambda spark, sf_dir: dataset.datetime_stats(read(spark, sf_dir, "events"), ["ts"]).select("column_name", F.col("datetime_min").cast("timestamp_ntz").alias("datetime_min"), F.col("datetime_max").cast("timestamp_ntz").alias("datetime_max"), "span_days"), "SELECT 'ts' AS column_name, CAST(min(ts) AS TIMESTAMP) AS datetime_min, CAST(max(ts) AS TIMESTAMP) AS datetime_max, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 2) AS span_days FROM events")
    for name, at in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        q[f"datetime_stats_{name}"] = (lambda spark, sf_dir, name=name, at=at: dataset.datetime_stats(read(spark, sf_dir, name), [at]).select("column_name", F.col("datetime_min").cast("timestamp_ntz").alias("datetime_min"), F.col("datetime_max").cast("timestamp_ntz").alias("datetime_max"), "span_days"), f"SELECT '{at}' AS column_name, CAST(min({at}) AS TIMESTAMP) AS datetime_min, CAST(max({at}) AS TIMESTAMP) AS datetime_max, round((epoch_us(max({at})) - epoch_us(min({at}))) / 86400e6, 2) AS span_days FROM {name}")
    q["monotonic_ts"] = (lambda spark, sf_dir: dataset.monotonic(read(spark, sf_dir, "events"), "ts", "event_id"), "SELECT 'ts' AS column_name, coalesce(bool_and(ts >= b OR b IS NULL), true) AS is_monotonic_increasing FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM events)")
    q["boolean_stats"] = (lambda spark, sf_dir: dataset.boolean_stats(read(spark, sf_dir, "orders_flags"), ["big", "done"]), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c}) AS true_count, count(*) FILTER (NOT {c}) AS false_count, round(100.0 * count(*) FILTER ({c}) / count({c}), 2) AS true_pct FROM {duck('orders_flags')}" for c in ("big", "done")))
    q["sample_exact"] = (lambda spark, sf_dir: dataset.sample_exact(read(spark, sf_dir, "orders"), 1000, "o_orderkey"), "SELECT * FROM orders ORDER BY md5('0:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000")
    q |= _issue_queries()

    q["doc_sections"] = (lambda spark, sf_dir: chunks.doc_sections(read(spark, sf_dir, "document_notes"), "doc_id", "text"), _sections_sql())
    q["sentences"] = (lambda spark, sf_dir: chunks.sentences(read(spark, sf_dir, "documents"), "doc_id", "text"), _sentences_sql())
    q["pack_chunks"] = (lambda spark, sf_dir: chunks.pack_chunks(read(spark, sf_dir, "document_notes"), "doc_id", "text"), _pack_sql())

    def asked(df):
        return df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")

    def top(cutoff=None):
        return lambda spark, sf_dir: cosine_topk(read(spark, sf_dir, "embeddings"), asked(read(spark, sf_dir, "embeddings")), 10, cutoff=cutoff)

    pairs = "SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"
    ranked = f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank, vec_id, round(s, 4) AS similarity FROM ({pairs}) QUALIFY rank <= 10"
    q["cosine_topk"] = (top(), ranked)
    q["cosine_topk_cutoff"] = (top(fixed.SIMILARITY_CUTOFF), f"SELECT * FROM ({ranked}) WHERE similarity >= {fixed.SIMILARITY_CUTOFF}")

    def accuracy(spark, sf_dir):
        e = read(spark, sf_dir, "embeddings")
        hits = cosine_topk(e, asked(e), 2).where("query_id != vec_id").withColumn("rank", F.lit(1))
        one = hits.groupBy("query_id").agg(F.max_by("vec_id", "similarity").alias("vec_id"), F.max("rank").alias("rank"))
        return retrieval_accuracy(one, e.select("vec_id", "label"), e.select(F.col("vec_id").alias("query_id"), "label"), "vec_id", "query_id")

    q["retrieval_accuracy"] = (accuracy, f"SELECT count(*) AS queries, count(*) FILTER (a.label = b.label) AS correct, round(count(*) FILTER (a.label = b.label) / count(*), 4) AS accuracy FROM (SELECT query_id, vec_id FROM ({pairs}) WHERE query_id <> vec_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) = 1) h JOIN embeddings a ON a.vec_id = h.query_id JOIN embeddings b ON b.vec_id = h.vec_id")
    q["retrieve_for_issues"] = (_retrieve, None)
    return q


def _retrieve(spark, sf_dir):
    from .functions.storage import shared_path
    from .operators.advice import corpus

    index = Index(spark, shared_path(spark, "index"))
    index.build(corpus())
    found = index.retrieve_for_issues(rules.issues(Profile(read(spark, sf_dir, "orders_missing"))), cutoff=index.embedder.cutoff)
    return found.select("rank", "column_name", "issue_type", F.transform("retrieved_context", lambda h: h["section"]).alias("sections"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}
