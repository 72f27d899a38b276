"""The pipeline against a brute-force version, and the queries' registration."""

import random

import pytest

pytest.importorskip("plumbline.llm.common")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import common, mixing, queries, token_records  # noqa: E402
from tests.llm.test_operators import brute_components, brute_hits, words  # noqa: E402


def test_registration():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    bench = [(i, words(rng, 15, 3000)) for i in range(5)]
    rows = [(i, words(rng, 40, 3000), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "s0", 0) for i in range(8)]
    rows += [(200 + i, words(rng, 9) + " " + bench[i][1], "en", "s1", 0) for i in range(5)] + [(300, "", "en", "s2", 0), (301, None, None, None, None), (302, "?!", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
        counts.append(docs.columns)
    assert counts[:4] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    named = {r[0]: r[1] for r in rows if r[0] < 300}
    assert {r["doc_id"] for r in kept["language_id"]} == set(named)
    single = {i for i, (_, c) in brute_components(list(named.items())).items() if c == i}
    assert {r["doc_id"] for r in kept["near_duplicates"]} == single
    clean = {i for i in single if not brute_hits(named[i], bench)[1]}
    assert {r["doc_id"] for r in kept["benchmark_decontamination"]} == clean
    assert {r["doc_id"] for r in kept["source_mixing"]} <= clean and all(r["text"] == named[r["doc_id"]] for r in kept["source_mixing"])
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in sorted(kept["token_output"], key=lambda r: r["start"]):
        n = len(t.encode(named[r["doc_id"]], add_special_tokens=False).ids) + 1
        assert (r["start"], r["n_tokens"]) == (at, n)
        at += n
    assert len(kept["token_output"]) == len(kept["source_mixing"])


ODD = "doc_id long, text string, lang string, source string, n_chars long, _pl_id long, _found string, _PL_source string, quality int, id string, letters int, tie int"


def odd_rows(rng):
    """Null and repeated ids, nulls in every column, equal rows, empty and long texts, and clashing column names."""
    texts = [words(rng, 30, 3000), None, "", "?!", "a", words(rng, 4000, 3000), words(rng, 30, 3000)]
    keys = [(1, 0), (1, 0), (1, 6), (None, 0), (None, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (7, 6), (8, 0), (None, 6)]
    return [(i, texts[t], None if n % 5 == 0 else "en", None if n % 4 == 0 else "s", None, n, None, "x", 1, None, n, 2) for n, (i, t) in enumerate(keys)]


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(25)
    rows = odd_rows(rng)
    bench = [(1, words(rng, 12, 3000)), (None, rows[10][1][:60]), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, ODD)
    kept, key = {}, lambda r: tuple(map(str, r))
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        kept[name] = sorted(found.collect(), key=key)
        if name == "source_mixing":
            assert set(kept[name]) <= {*map(tuple, rows)}
        else:
            assert set(kept[name]) <= {*map(tuple, rows)} and len(kept[name]) == len(set(kept[name])), name
    assert {r["tie"] for r in kept["language_id"]} == {2} and {r["letters"] for r in kept["language_id"]} == {n for n, r in enumerate(rows) if any(c.isalpha() for c in r[1] or "")}
    # One row of each id that stays; those without ids and without words are nobody's copies.
    assert sorted(str(r["doc_id"]) for r in kept["near_duplicates"]) == ["1", "2", "3", "4", "5", "6", "None", "None", "None"]
    assert {r["letters"] for r in kept["benchmark_decontamination"]} == {n for n, r in enumerate(rows) if not brute_hits(r[1], bench)[1]}
    out = corpus_pipeline.token_output(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows) and min(r["n_tokens"] for r in out) == 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_token_output_keeps_the_shuffled_order(spark):
    rng = random.Random(15)
    docs = spark.createDataFrame([(i, words(rng, 5), "en", "s", 0) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = common.materialize(mixing.mix(docs, target_rows=1000).select(*docs.columns), "mixed")
    got = [r["doc_id"] for r in corpus_pipeline.token_output(spark, mixed, "").orderBy("start").collect()]
    assert sorted(got) == sorted(r["doc_id"] for r in mixed.collect())
    assert sum(a == b for a, b in zip(got, got[1:])) < len(got) / 10 and sum(a < b for a, b in zip(got, got[1:])) < len(got) * 0.6
    by_text = token_records.encode_and_read_back(docs, order=["text"]).orderBy("start").collect()
    assert [r["doc_id"] for r in by_text] == [r["doc_id"] for r in docs.orderBy("text").collect()]


def test_token_output_has_a_worker_for_a_task(spark):
    """No task of the stage needs two Python workers, each of which keeps what it has loaded; the records read back are the same."""
    import public_tokenizers

    from plumbline.llm import common, token_records

    docs = spark.createDataFrame([(k, "one two\nthree " * (k % 5)) for k in range(40)], "doc_id long, text string")
    path = common.shared_path(spark, "token-records")
    index = token_records.write_records(docs, path, public_tokenizers.path(token_records.TOKENIZER))
    found = token_records.read_digests(index, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, token_records.digests(token_records.read_records(index, path)).collect()))
