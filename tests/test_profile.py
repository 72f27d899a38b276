"""Statistics, rules, redaction and plans on inline tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import text
from plumbline.functions.rounding import pct, rounded
from plumbline.operators import chunks, dataset, evaluation, issues, numeric
from plumbline.operators.advice import corpus
from plumbline.operators.columns import Profile
from plumbline.operators.frequency import distinct_counts
from plumbline.operators.retrieval import HashedTfIdf, Index, compare_backends, cosine_topk, fingerprint
from plumbline.plans import cleaning
from plumbline.plans.code_checks import scan_code, unknown_columns
from plumbline.plans.report import LABELS, SHARED, Report, display_name, payload, profile_csv, profile_table, redacted_view, to_json, with_target
from plumbline.plans.suggest import CodeSuggestion, Planner, SuggestionError, build_prompt, build_script, plan_requests, select_issues
from plumbline.sources.csv import detect_delimiter, detect_encoding, estimated_rows, header_names, read_csv

#: A column for each rule, as an expression of a row number from 0 to 799.
RULED = {
    "ticket": "id", "steep": "exp(id / 60.0)", "half_gone": "CASE WHEN id % 2 = 0 THEN CAST(id % 37 AS DOUBLE) END", "tenth_gone": "CASE WHEN id % 10 > 0 THEN id % 41 / 4.0 END",
    "few_gone": "CASE WHEN id % 50 > 0 THEN (id % 43) / 1000.0 END", "coded": "CASE WHEN id % 25 = 3 THEN -999 ELSE id % 30 END", "endless": "CASE WHEN id % 40 = 1 THEN double('Infinity') ELSE id % 31 + 0.5 END", "void": "CAST(NULL AS DOUBLE)",
    "same": "'one'", "tariff": "CASE WHEN id % 20 = 4 THEN 'n/a' ELSE concat('£', id % 90, ',50') END", "booked": "concat(1 + id % 12, '/', 1 + id % 28, '/2', 1 + id % 3)", "blend": "CASE WHEN id % 4 = 0 THEN 'none yet' WHEN id % 2 = 0 THEN 'x' ELSE CAST(id % 9 AS STRING) END",
    "article": "concat('art ', chr(97 + id % 26), id % 4)", "shade": "element_at(array('teal', 'plum', 'sand'), CAST(id % 3 + 1 AS INT))", "nearly": "CASE WHEN id % 30 = 7 THEN 'b' ELSE 'a' END", "word_gone": "CASE WHEN id % 5 > 1 THEN concat('w', id % 3) END",
}


@pytest.fixture(scope="module")
def ruled(spark):
    """800 rows, five of them twice; every rule fires."""
    df = spark.range(800).selectExpr(*[f"{x} AS {n}" for n, x in RULED.items()])
    return df.union(df.where("ticket < 5"))


@pytest.fixture(scope="module")
def report(ruled):
    return profile_table(ruled, "secret-file.csv")


def kinds_of(report):
    return {(i["column"], i["issue_type"]) for i in report["issues"]}


def test_every_rule_fires(report):
    assert {k for _, k in kinds_of(report)} == set(fixed.QUESTIONS)
    assert {
        (None, "duplicate_rows"), (None, "mixed_feature_scales"), ("ticket", "identifier_like"), ("steep", "high_skew"), ("steep", "outliers"), ("half_gone", "high_missing"), ("tenth_gone", "moderate_missing"), ("few_gone", "low_missing"),
        ("coded", "sentinel_values"), ("endless", "infinite_values"), ("void", "empty_column"), ("same", "constant_column"), ("tariff", "numeric_stored_as_text"), ("booked", "datetime_stored_as_text"), ("blend", "mixed_types"),
        ("article", "high_cardinality"), ("shade", "needs_encoding"), ("nearly", "imbalanced_category"), ("word_gone", "high_missing"),
    } <= kinds_of(report)
    assert [i["rank"] for i in report["issues"]] == list(range(1, len(report["issues"]) + 1)) and report["issues"][0]["issue_type"] == "empty_column"
    assert report["dataset"]["duplicate_rows"] == 5 and report["columns"]["ticket"]["is_unique_key"] and report["columns"]["coded"]["sentinel_values"] == {"-999": 33}
    json.loads(to_json(report))


NUMBER = {"semantic_type": "numeric", "missing_pct": 0.0, "distinct_real_values": 9, "unique_count": 9}
WORD = {"semantic_type": "categorical", "missing_pct": 0.0, "unique_count": 9, "looks_numeric": True}


@pytest.mark.parametrize("kind, stats, score, label", [
    ("constant_column", {**NUMBER, "is_constant": True}, 55.0, "high"), ("empty_column", {**NUMBER, "missing_pct": 100.0}, 95.0, "critical"), ("high_missing", {**NUMBER, "missing_pct": 30.0}, 70.5, "critical"), ("high_missing", {**WORD, "missing_pct": 99.99}, 95.0, "critical"),
    ("moderate_missing", {**NUMBER, "missing_pct": 5.0}, 40.0, "medium"), ("moderate_missing", {**NUMBER, "missing_pct": 29.99}, 65.0, "high"), ("low_missing", {**NUMBER, "missing_pct": 0.01}, 15.0, "low"), ("low_missing", {**NUMBER, "missing_pct": 4.99}, 20.0, "low"),
    ("infinite_values", {**NUMBER, "infinite_count": 1}, 75.0, "critical"), ("sentinel_values", {**NUMBER, "sentinel_values": {"-1": 4}}, 72.0, "critical"), ("high_skew", {**NUMBER, "skewness": -1.0}, 53.0, "high"), ("high_skew", {**NUMBER, "skewness": 40.0}, 85.0, "critical"),
    ("outliers", {**NUMBER, "iqr_outlier_pct": 1.0}, 41.5, "medium"), ("outliers", {**NUMBER, "iqr_outlier_pct": 33.0}, 70.0, "critical"), ("identifier_like", {**NUMBER, "is_unique_key": True, "is_integer_like": True}, 50.0, "high"), ("identifier_like", {**WORD, "looks_numeric": False, "is_unique_key": True}, 50.0, "high"),
    ("numeric_stored_as_text", {**WORD, "looks_datetime": True}, 70.0, "critical"), ("datetime_stored_as_text", {**WORD, "looks_numeric": False, "looks_datetime": True}, 65.0, "high"), ("mixed_types", {**WORD, "numeric_fraction": 0.101}, 60.0, "high"), ("mixed_types", {**WORD, "semantic_type": "complex", "mixed_python_types": True}, 60.0, "high"),
    ("high_cardinality", {**WORD, "looks_numeric": False, "unique_count": 50}, 55.0, "high"), ("needs_encoding", {**WORD, "looks_numeric": False, "unique_count": 49}, 25.0, "medium"), ("imbalanced_category", {**WORD, "mode_pct": 95.0}, 45.0, "high"),
])
def test_scores_and_labels(kind, stats, score, label):
    found = issues.find([{"column_name": "c", **stats}], {"duplicate_rows": 0, "duplicate_rows_pct": 0.0, "n_columns": 1})
    assert [(i["severity_score"], i["severity"]) for i in found if i["issue_type"] == kind] == [(score, label)]


def test_limits_of_rules():
    none = {"duplicate_rows": 0, "duplicate_rows_pct": 0.0, "n_columns": 9}
    quiet = [
        {**NUMBER, "skewness": 0.99, "iqr_outlier_pct": 0.99}, {**NUMBER, "distinct_real_values": 2, "skewness": 9.0, "iqr_outlier_pct": 9.0, "is_unique_key": True, "is_integer_like": True},
        {**WORD, "looks_numeric": False, "unique_count": 1, "mode_pct": 100.0, "numeric_fraction": 0.1}, {**WORD, "semantic_type": "datetime", "is_unique_key": True},
    ]
    assert [issues.find([{"column_name": "c", **s}], none) for s in quiet] == [[]] * 4
    whole = issues.find([], {"duplicate_rows": 3, "duplicate_rows_pct": 2.25, "n_columns": 3})
    assert [(i["issue_type"], i["severity_score"], i["severity"]) for i in whole] == [("duplicate_rows", 42.2, "medium")]
    assert issues.find([], {"duplicate_rows": 3, "duplicate_rows_pct": 2.25, "n_columns": 2}) == []
    far = [{"column_name": "a", **NUMBER, "p01": -3.0, "p99": 2.0}, {"column_name": "b", **NUMBER, "p01": 0.0, "p99": 301.0}, {"column_name": "k", **NUMBER, "p99": 9e9, "is_unique_key": True, "is_integer_like": True}]
    found = [i for i in issues.find(far, none) if i["issue_type"] == "mixed_feature_scales"]
    assert [(i["severity_score"], i["severity"], i["column_name"]) for i in found] == [(45.0, "high", None)] and issues.find([far[0], {**far[1], "p99": 300.0}], none) == []
    assert issues.scales(map(issues.Stats, far)) == {"largest_scale_column": "b", "smallest_scale_column": "a", "scale_ratio": 301 / 3}


def test_ties_go_by_column_and_then_by_rule():
    word = {**WORD, "looks_numeric": False, "missing_pct": 10.0, "mode_pct": 98.89}
    found = issues.find([{"column_name": n, **word} for n in ("b", "a")], {"duplicate_rows": 9, "duplicate_rows_pct": 5.0, "n_columns": 3})
    assert [(i["column_name"], i["issue_type"]) for i in found if i["severity_score"] == 45] == [(None, "duplicate_rows"), ("a", "moderate_missing"), ("a", "imbalanced_category"), ("b", "moderate_missing"), ("b", "imbalanced_category")]


def test_rounding_is_half_even_on_the_double():
    assert pct(1, 800) == 0.12 and pct(3, 800) == 0.38 and pct(1, 0) == 0.0 and rounded(2.675, 2) == 2.67 and rounded(7, 2) == 7 and rounded(None, 2) is None


def test_target_takes_part_in_no_rule(report):
    got = with_target(report, "half_gone")
    assert not any(i["column"] == "half_gone" for i in got["issues"]) and any(i["column"] == "half_gone" for i in report["issues"]) and got["dataset"]["target"] == "half_gone"
    assert with_target(got, None)["issues"] == report["issues"]
    with pytest.raises(ValueError):
        with_target(report, "nothing")


def test_redaction(report):
    text = json.dumps(payload(report))
    assert not any(v in text for v in ("teal", "secret-file", "art a", "none yet")) and "normality_p" not in text and "distinct_real_values" not in text
    assert "teal" in json.dumps(redacted_view(report, ["shade"], labels=True))
    known = {**report["columns"]["coded"], "a_new_statistic": 5}
    wide = {**report, "columns": {f"c{i}": known for i in range(300)}, "dataset": {**report["dataset"], "column_names": [f"c{i}" for i in range(300)], "path": "/x"}}
    view = redacted_view(wide)
    assert len(view["columns"]) == fixed.VIEW_COLUMNS and len(view["dataset"]["column_names"]) == fixed.VIEW_NAMES and "40 of 300" in view["note"] and "200 of 300" in view["note"]
    assert all("a_new_statistic" not in c for c in view["columns"].values()) and "path" not in view["dataset"] and redacted_view(report, ["nothing"])["columns"] == {}
    assert not {*LABELS} & {n for names in SHARED.values() for n in names} and len(payload(report)["issues"]) == fixed.VIEW_ISSUES and "metrics" not in payload(report)["issues"][0]
    assert display_name("a\n'b'  c" + "x" * 99).startswith("a b cxx") and len(display_name("y" * 99)) == 60


def test_degenerate_tables(spark):
    with pytest.raises(TypeError):
        Profile([1])
    with pytest.raises(ValueError):
        Profile(spark.createDataFrame([], "a int").drop("a"))
    empty = profile_table(spark.createDataFrame([], "a double, b string, c timestamp, d boolean"))
    assert empty["dataset"]["n_rows"] == 0 and empty["issues"] == [] and empty["columns"]["c"]["unique_count"] == 0
    one = Report(spark.createDataFrame([(1, "x")], "a long, b string"))
    assert one.profile()["columns"]["a"]["std"] == 0.0 and not one.profile()["columns"]["a"]["is_unique_key"] and one.profile() is one.profile() and one.profile(force=True) is not None and one.top_issues() == one.profile()["issues"][:2]
    odd = spark.createDataFrame([(1.0, float("nan"), [1.0], True), (2.0, 2.0, None, None)], "`a.b` double, `x``y` double, v array<double>, f boolean").selectExpr("*", "parse_json(CASE WHEN f THEN '1' ELSE '{}' END) AS w", "map('k', 1) AS m")
    got = profile_table(odd)
    assert got["columns"]["x`y"]["missing_count"] == 1 and got["columns"]["v"]["semantic_type"] == "complex" and got["columns"]["f"]["true_count"] == 1
    assert got["columns"]["w"]["mixed_python_types"] and ("w", "mixed_types") in kinds_of(got) and got["columns"]["m"]["is_constant"]


def test_quantiles_and_moments_against_plain_sums(spark):
    values = {"even": [float(i) for i in range(50)], "steep": [1.5**i for i in range(90)], "far": [-1.7e308, 1.7e308, 1.0, 2.0, 3.0], "one": [4.0], "same": [2.0] * 30, "codes": [-1.0, -9.0, -20.0, 6.0, 7.0] * 9, "none": [], "ends": [0.0] * 60 + [1e-300, 5e-324, 9.0]}
    rows = [(values["even"][i % 50] if i < 50 else None, *[(v[i] if i < len(v) else None) for n, v in values.items() if n != "even"]) for i in range(90)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in ["even", *[n for n in values if n != "even"]]))
    for ordered in (numeric.ORDERED, 20):
        numeric_ordered, numeric.ORDERED = numeric.ORDERED, ordered
        stats = numeric.NumericStats(df)
        for name, v in values.items():
            if v:
                f, s = stats.counted[name], sorted(v)
                mean = math.fsum(v) / len(v)
                assert f["n_values"] == len(v) and f["sentinels"] == {} and math.isclose(f["mean"], mean, rel_tol=1e-9, abs_tol=1e-9)
                want = [s[math.floor((len(v) - 1) * p)] + (s[min(math.floor((len(v) - 1) * p) + 1, len(v) - 1)] - s[math.floor((len(v) - 1) * p)]) * ((len(v) - 1) * p % 1) for _, p in numeric.QUANTILES]
                assert all(math.isclose(a, b, rel_tol=1e-12) or a == b for a, b in zip(stats.ranked[name].values(), want)), name
                if name in ("even", "steep", "codes"):
                    m2, m3, m4 = (math.fsum((x - mean) ** k for x in v) for k in (2, 3, 4))
                    assert math.isclose(f["std"], math.sqrt(m2 / (len(v) - 1)), rel_tol=1e-9) and math.isclose(f["skewness"], numeric.corrected_skewness(len(v), m2, m3), rel_tol=1e-9, abs_tol=1e-9) and math.isclose(f["kurtosis"], numeric.corrected_kurtosis(len(v), m2, m4), rel_tol=1e-9)
        numeric.ORDERED = numeric_ordered
    assert "none" not in stats.ranked and stats.distinct_real() == {n: len(set(v)) for n, v in values.items()}


@pytest.mark.parametrize("values, codes", [
    ([1.0, 2.0, 3.0] * 40 + [-999.0] * 2, {-999.0: 2}), ([1.0, 2.0, 3.0] * 400 + [-999.0], {}), ([1.0, 2.0] * 40 + [-1.0] * 9, {}), ([1.0, 2.0, 3.0] * 40 + [-1.0] * 9, {-1.0: 9}), ([1.0, 1.5, 2.0] * 40 + [-1.0] * 9 + [-9.0] * 9, {-1.0: 9, -9.0: 9}),
    ([-5.0, 4.0] * 40 + [-1.0] * 9, {}), ([0.0, 1.0] * 40 + [-999.0] * 9, {-999.0: 9}), ([-1.0] * 9, {}), ([7.0, -999.0, 999.0] * 9, {-999.0: 9, 999.0: 9}),
])
def test_placeholder_codes(spark, values, codes):
    assert numeric.NumericStats(spark.createDataFrame([(v,) for v in values], "x double")).counted["x"]["sentinels"] == codes


def test_distinct_values_of_every_type(spark):
    df = spark.range(2000).selectExpr("CAST(id AS DECIMAL(20, 0)) + 70000000000000000000BD AS d", "id + 9007199254740992 AS l", "CAST(id % 7 AS FLOAT) AS f", "CASE WHEN id % 2 = 0 THEN 0.0D ELSE -0.0D END AS z", "date_add(DATE'2020-01-01', CAST(id % 9 AS INT)) AS t", "array(id % 3) AS a", "CAST(CAST(id % 4 AS STRING) AS BINARY) AS b", "map(id % 5, 1) AS m", "repeat(CAST(id % 6 AS STRING), 400) AS s", "double('NaN') AS n")
    assert {r["column_name"]: r["unique_count"] for r in distinct_counts(df).collect()} == {"d": 2000, "l": 2000, "f": 7, "z": 1, "t": 9, "a": 3, "b": 4, "m": 5, "s": 6, "n": 0}
    p = Profile(df.select("d", "l", "z"))
    assert {r["column_name"] for r in p.rows if r["is_unique_key"]} == {"d", "l"} and p.numeric.distinct_real()["l"] < 2000


def test_text_rules(spark):
    rows = [("$9,100", "RX-77", "noon", "9/30/21"), ("(41)", "Q7b", "late", "10/2/21"), ("8.5 %", "4,4,4", "7/8", "11/12/22"), ("Missing", "12,5,9", "soon", "12/1/22"), ("--", "v2", "6:45", "1/9/23"), ("£ 2,000.25", "8,8", "1/2", "2/8/23"), ("3", "B-2", "fall", "3/7/23")] * 10
    t = profile_table(spark.createDataFrame(rows, "price string, code string, t string, d string"))["columns"]
    assert t["price"]["looks_numeric"] and t["price"]["numeric_needs_cleaning"] and t["price"]["missing_placeholder_count"] == 20
    assert not t["code"]["looks_numeric"] and not t["t"]["looks_datetime"] and t["d"]["looks_datetime"] and t["d"]["distinct_years"] == 3


@pytest.mark.parametrize("written, want", [
    ("2024-03-01 10:20", "2024-03-01 10:20:00"), ("2024-03-01 10:20:30.123", "2024-03-01 10:20:30.123"), ("2024-03-01T10:20:30Z", "2024-03-01 10:20:30"), ("2024-03-01T10:20:30+02:00", "2024-03-01 08:20:30"), ("2024-03-01 10:20-0530", "2024-03-01 15:50:00"),
    ("03/01/2024 10:20", "2024-03-01 10:20:00"), ("03/01/2024 10:20:30", "2024-03-01 10:20:30"), ("1/5/2023 3:04 PM", "2023-01-05 15:04:00"), ("1/5/2023 12:04 am", "2023-01-05 00:04:00"), ("2024.03.01", "2024-03-01 00:00:00"), ("13/2/2024", "2024-02-13 00:00:00"), ("1-2-2024", "2024-01-02 00:00:00"),
    ("5 Jan 2023", "2023-01-05 00:00:00"), ("January 5, 2023", "2023-01-05 00:00:00"), ("Thu, 5 Jan 2023 07:08:09 GMT", "2023-01-05 07:08:09"), ("05-Sep-2023", "2023-09-05 00:00:00"), ("20240229", "2024-02-29 00:00:00"), ("2024-02", "2024-02-01 00:00:00"), ("March 2024", "2024-03-01 00:00:00"), (" 7/4/24 ", "2024-07-04 00:00:00"), ("7/4/99", "1999-07-04 00:00:00"),
    ("2023-02-29", None), ("2024-13-01", None), ("13/13/2024", None), ("10:20", None), ("May", None), ("3/4", None), ("2024-01-01 25:00", None), ("1/5/2023 13:00 PM", None), ("12345", None), ("SKU-2024", None), ("", None), ("5 Foo 2023", None),
])
def test_dates(spark, written, want):
    got = spark.createDataFrame([(written,)], "v string").select(text.to_timestamp(F.col("v")).cast("string")).first()[0]
    assert got == (want.removesuffix(".000") if want else None)


def test_long_texts_are_read_before_they_are_keyed(spark):
    rows = [(" " * 300, "x" * 299 + str(i % 2)) for i in range(6)] + [(" " * 300 + "n/a", "y")] * 3 + [(" " * 300 + "12", "z" * 300)] * 4
    t = profile_table(spark.createDataFrame(rows, "a string, b string"))["columns"]
    assert (t["a"]["empty_string_count"], t["a"]["missing_placeholder_count"], t["a"]["numeric_fraction"]) == (6, 9, 1.0) and t["b"]["mode"] == "z" * 300
    assert {(v["value"], v["n"]) for v in t["b"]["top_values"]} == {("z" * 300, 4), ("x" * 299 + "0", 3), ("x" * 299 + "1", 3), ("y", 3)}


def test_nulls_in_different_columns_are_different_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("b", "c")], "x string, y string")
    assert dataset.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_monotonic_across_partitions(spark):
    df = spark.range(1000).selectExpr("id AS o", "id DIV 3 AS x", "CASE WHEN id = 777 THEN 0 ELSE id END AS z")
    assert dataset.monotonic(df, "x", "o").first()[1] and not dataset.monotonic(df, "z", "o").first()[1]


def test_sample_is_exact(spark):
    df = spark.range(500).toDF("k")
    a, b = dataset.sample_exact(df, 70, "k", 3), dataset.sample_exact(df.repartition(7), 70, "k", 3)
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()} and a.count() == 70 and dataset.sample_exact(df, 9999, "k").count() == 500


def test_csv(spark, tmp_path):
    assert [detect_delimiter(x) for x in (b"a;b;c\n1,5;2,5;3", b"a\tb\n", b"a|b\n", b"abc\n", b"a,b;c\n")] == [";", "\t", "|", ",", ","]
    assert detect_encoding("é".encode()) == "utf-8-sig" and detect_encoding("é".encode("cp1252")) == "cp1252" and detect_encoding(b"\x81\x8d") == "latin-1"
    assert header_names("﻿a,A,,\"x,y\"\n", ",") == ["a", "A.1", "unnamed_2", "x,y"] and estimated_rows(b"h\n1\n2") == 2
    for name, data in (("u.csv", "﻿id,name,flag,when,gap,inf\n1,é,True,2024-01-01,NA,1.5\n2,b,false,2024-01-02,3,-inf\n".encode()), ("w.csv", "id;name\n1;caf\xe9 €\n".encode("cp1252"))):
        (tmp_path / name).write_bytes(data)
    df, info = read_csv(spark, str(tmp_path / "u.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "flag": "boolean", "when": "string", "gap": "double", "inf": "double"} and df.collect()[0]["name"] == "é" and info["encoding"] == "utf-8-sig"
    df, info = read_csv(spark, str(tmp_path / "w.csv"))
    assert df.collect()[0]["name"] == "café €" and (info["sep"], info["encoding"]) == (";", "cp1252")
    (tmp_path / "l.csv").write_text("n\n" + "\n".join(map(str, range(300))))
    assert read_csv(spark, str(tmp_path / "l.csv"), max_rows=40)[0].count() == 40


def test_csv_whose_only_quoted_line_end_comes_late(spark, tmp_path):
    rows = [f'{i},"a ""b"", c"' for i in range(20_000)] + ['20000,"two\nlines"']
    (tmp_path / "q.csv").write_text("id,words\n" + "\n".join(rows) + "\n")
    df, _ = read_csv(spark, str(tmp_path / "q.csv"))
    assert df.count() == 20_001 and dict(df.dtypes)["id"] == "bigint" and df.where("id = 20000").first()["words"] == "two\nlines" and df.first()["words"] == 'a "b", c'
    (tmp_path / "x.csv").write_bytes(b"a;b\n1;caf\xe9\n2;\x81\n")
    report = profile_csv(spark, str(tmp_path / "x.csv"), target="b")
    assert report["source"]["encoding"] == "latin-1" and report["source"]["sep"] == ";" and report["dataset"]["target"] == "b" and "encoding='latin-1'" in report["source"]["read_call"]


def test_chunks(spark):
    text = "title\n## One\nA first sentence here. Version 2.5 is out! Next one\n### Sub part\n# kept\n\n## Two\n" + "Long words here now. " * 90 + "Tail.\n## \nlost\n## Empty\n"
    docs = spark.createDataFrame([("d", text), ("n", None), ("e", "no sections")], "id string, text string")
    got = chunks.doc_sections(docs, "id", "text").collect()
    assert [(r["title"]) for r in got] == ["One", "Two"] and "Sub part." in got[0]["content"] and "# kept" in got[0]["content"]
    packed = chunks.pack_chunks(docs, "id", "text").orderBy("section_index", "chunk_index").collect()
    assert all(r["text"].startswith(r["section"] + "\n\n") for r in packed) and all(r["text"].rstrip().endswith((".", "kept")) for r in packed)
    assert all(len(r["text"]) < fixed.CHUNK_MAX + 100 for r in packed) and packed[-1]["text"].endswith("Tail.")


def test_retrieval_of_the_bundled_corpus(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    first = index.build(corpus())
    assert first.select("section").distinct().count() >= 18 and index.build(corpus()).count() == first.count()
    found = evaluation.evaluate(spark)
    assert found["passed"], evaluation.told(found)
    assert found["correct"] == len(evaluation.questions()) == 21 and "PASSED" in evaluation.told(found)
    blank = spark.createDataFrame([("b", " "), ("n", None)], "query_id string, rag_query string")
    assert index.search(blank, 1, 0.0).count() == 0
    with pytest.raises(ValueError):
        Index(spark, f"file://{tmp_path}/none").build("no headings")
    same = compare_backends(first, first, "chunk_id").first()
    assert same["max_difference"] == 0 and abs(same["min_cosine"] - 1) < 1e-9 and len(fingerprint("a", "b", "c")) == 16
    cut = evaluation.evaluate(spark, text="## One\nAn unfinished\n## Two\nWhole.\n")
    assert cut["chunks"] == {"chunks": 2, "sections": 2, "missing_heading": 0, "mid_sentence_cuts": 1} and not cut["passed"] and "FAILED" in evaluation.told(cut)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_topk_against_all_pairs(spark, kind, monkeypatch):
    import random

    from plumbline.operators import retrieval

    monkeypatch.setattr(retrieval, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 200)
    r = random.Random(4)
    pool = [[r.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = [(i, r.choice(pool)) for i in range(90)] + [(90, [0.0] * 5), (91, None), (92, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec_id", F.col("vec_id").cast(kind))
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(pool)] + [("z", [0.0] * 5), ("n", None)], "query_id string, embedding array<double>")
    got: dict = {}
    for x in cosine_topk(vectors, asked, 4).orderBy("rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["similarity"]))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    key = int if kind == "long" else str
    for i, q in enumerate(pool):
        want = sorted(((-round(cosine(q, v), 10), key(n)) for n, v in rows[:90]))[:4]
        assert [n for n, _ in got[f"q{i}"]] == [n for _, n in want] and all(abs(s + w) < 1e-4 for (_, s), (w, _) in zip(got[f"q{i}"], want))
    assert set(got) == {f"q{i}" for i in range(12)}


def test_code_checks():
    assert scan_code("import os\nimport os.path\nfrom pickle import x") == ["import of os", "import of os.path", "import of pickle"]
    assert len(scan_code("eval('1'); df.to_csv('x'); df.write; spark.read; ().__class__; __builtins__")) >= 6 and scan_code("df = df.drop('a')") == [] and scan_code("x = (") == ["the code does not parse"]


@pytest.mark.parametrize("code, unknown", [
    ("df = df.withColumn('n', F.col('a') + F.col('zz'))", ["zz"]), ("df = df.withColumn('n', col('a')).drop('n', 'q')", ["q"]), ("df = df.drop('n').withColumn('n', F.lit(1))", ["n"]), ("df = df.dropna(subset=['a', 'x'])", ["x"]), ("df = df.na.fill({'b': 0, 'y': 1})", ["y"]),
    ("df = df.withColumnRenamed('a', 'c').orderBy('c', F.desc('a'))", []), ("df = df.withColumnsRenamed({'gone': 'g'}).select('g')", ["gone"]), ("df = df.withColumns({'p': df['a'], 'r': df['u']}).groupBy('p', 'b').agg({'r': 'max', 't': 'min'})", ["t", "u"]),
    ("df = df.select('*', F.expr('w + 1').alias('v')).where(df.k > 1)", ["k"]), ("df = cleaning.winsorize(df, 'm')", ["m"]), ("df = df.filter(df.count() > 0)", []), ("x = {'nothing': 1}['nothing']", []), ("df = (", []), ("df = df[['a', 'o']]", ["o"]),
])
def test_invented_columns(code, unknown):
    assert unknown_columns(code, ["a", "b"]) == unknown


class Echo:
    name, calls = "echo", 0

    def suggest(self, system, user, request):
        self.calls += 1
        return CodeSuggestion("x", "line\nbreak", "import os" if request["column"] == "steep" else "df = df.drop('ticket')", [], 99)


def test_plans(ruled, report):
    chosen = select_issues(report["issues"], 3)
    assert {i["column"] for i in chosen} >= {i["column"] for i in report["issues"][:3]}
    issues = [{**i, "retrieved_context": [{"section": "s", "text": "same"}, {"section": "s", "text": "same"}]} for i in report["issues"]]
    requests = plan_requests(report, issues)
    assert len(requests) == len({i["column"] for i in issues if i["column"]}) + sum(i["column"] is None for i in issues) and all(len(r["context"]) == 1 for r in requests)
    echo = Echo()
    planner = Planner(echo)
    steps = planner.plan(report, issues)
    planner.plan(report, issues)
    assert echo.calls == len(requests) and all(s.execution_order == 8 for s in steps)
    script = build_script(steps, "a\nb", ruled.columns)
    compile(script, "x", "exec")
    assert "\nimport os" not in script and "# import os" in script and "NOT LIVE: import of os" in script
    broken = build_script([CodeSuggestion("a\nb", "t", "df = (", [], 3), CodeSuggestion("c", "t", "df = df.drop('made up')", [], 4)], "n", ruled.columns, "spark.read\n.csv('x')")
    compile(broken, "x", "exec")
    assert "NOT LIVE: line 1" in broken and "no such columns: made up" in broken and "# It was read by: spark.read .csv('x')" in broken
    offline = Planner(cleaning.Templates()).plan(report, issues)
    assert all(s.is_safe_and_valid for s in offline) and [s.execution_order for s in offline] == sorted(s.execution_order for s in offline)
    text = "".join(build_prompt(requests[0]["stats"], requests[0]["context"], requests[0]["task"]))
    assert "teal" not in text and len(text) < 50_000
    for bad in (ruled, {"a": [ruled.limit(1)]}, {"r": ruled.first()}):
        with pytest.raises(SuggestionError):
            build_prompt(bad, [])


def test_cleaning(spark):
    df = spark.createDataFrame([(1.0, "$1,000", "a", 0.0), (2.0, "(5)", "b", 1.0), (3.0, None, "a", 1.0), (None, "x", None, 0.0), (1000.0, "2", "c", 1.0)], "v double, t string, c string, y double")
    vals = lambda d, c: [r[0] for r in d.select(c).collect()]
    assert vals(cleaning.impute_median(df, "v"), "v") == [1.0, 2.0, 3.0, 2.5, 1000.0]
    assert vals(cleaning.text_to_number(df, "t"), "t") == [1000.0, -5.0, None, None, 2.0]
    assert max(x for x in vals(cleaning.winsorize(df, "v"), "v") if x) < 1000
    assert vals(cleaning.top_levels(df, "c", 1), "c") == ["a", "Other", "a", None, "Other"]
    assert vals(cleaning.ordinal(df, "c", ["a", "b", "c"]), "c") == [0, 1, 0, None, 2]
    assert sorted(vals(cleaning.frequency_encode(df, "c"), "c")) == [0.2, 0.2, 0.2, 0.4, 0.4]
    assert abs(sum(x for x in vals(cleaning.scale(df, "v"), "v") if x is not None)) < 1e-9 and vals(cleaning.scale(df.withColumn("v", df.y * 0), "v"), "v") == [0.0] * 5
    assert vals(cleaning.impute_label(df, "c"), "c")[3] == "Missing" and cleaning.deduplicate(df.union(df)).count() == 5 and cleaning.deduplicate(df, ["y"], "v").count() == 2
    assert cleaning.unskew(df, "v").count() == 5 and cleaning.unskew(df.withColumn("v", df.v - 2), "v").count() == 5
    assert cleaning.target_encode(df, "c", "y").count() == 5 and "c_a" in cleaning.one_hot(df, "c", ["a"]).columns


def test_templates_run(spark, ruled, report):
    """Every suggested step is run, in order, on the table it was made for."""
    steps = Planner(cleaning.Templates()).plan(report, [{**i, "retrieved_context": []} for i in report["issues"]])
    space = {"df": ruled, "F": F}
    for s in steps:
        exec(s.python_code, space)  # noqa: S102
    df = space["df"]
    assert "void" not in df.columns and "shade_teal" in df.columns and df.where("endless = double('Infinity') OR coded = -999").count() == 0 and df.count() > 0
    assert cleaning.codes_to_null(spark.createDataFrame([(9007199254740992.0,), (float("inf"),)], "x double"), "x", []).where("x IS NULL").count() == 1
    with pytest.raises(ValueError):
        cleaning.levels(spark.range(100).selectExpr("CAST(id AS STRING) AS s"), "s")


def test_issue_table_has_no_rows_of_data(ruled):
    assert issues.issues(Profile(ruled.select("ticket", "half_gone"))).columns == ["rank", "column_name", "issue_type", "severity_score", "severity", "rag_query"]


def test_commands(spark, ruled, tmp_path, capsys):
    from plumbline.__main__ import main

    ruled.write.parquet(f"{tmp_path}/t.parquet")
    (tmp_path / "t.csv").write_text("a,b\n1,\n2,x\n3,x\n4,x\n")
    assert main(["profile", f"{tmp_path}/t.csv"]) == 0 and json.loads(capsys.readouterr().out)["columns"]["a"]["max"] == 4
    assert main(["plan", f"{tmp_path}/t.parquet", "--target", "shade", "--top", "2"]) == 0 and "df.drop('void')" in capsys.readouterr().out
    assert main(["prompts", f"{tmp_path}/t.csv"]) == 0 and "STATISTICS" in capsys.readouterr().out
    assert main(["search", "how to detect and remove duplicate rows", "--top", "1"]) == 0 and "Duplicate rows" in capsys.readouterr().out
    assert main(["evaluate", "--json"]) == 0 and json.loads(capsys.readouterr().out)["passed"]


def test_stream(spark, tmp_path):
    from plumbline.streaming.profile import windowed_stats

    spark.sql("SELECT timestamp_seconds(id * 60) AS at, CAST(id AS DOUBLE) AS v FROM range(120)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, v double").parquet(f"{tmp_path}/in")
    q = windowed_stats(stream, "at").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n_rows"], r["mean"]) for r in spark.sql("SELECT * FROM w").collect()) == [(60, 29.5), (60, 89.5)]
