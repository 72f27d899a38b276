"""A corpus pipeline of five stages over documents, each one an operator of plumbline.llm.

Every stage takes what its predecessor kept (as Parquet, read back) and works on
all of it. All but the last return the columns of documents, further columns of any
name included; an empty table stays empty. Rows are never cut: texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common, decontaminate, jaccard, language, mixing, token_records


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.

    Null, empty and letterless texts go; rows with null ids are judged like others and
    rows that are equal in id, text, language and source share one fate; of languages
    that tie the first by name counts. A table that names no language keeps every row
    with a letter.
    """
    return language.keep_accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8, that with the smallest id.

    Rows without an id all stay, as do rows without words; of rows that share the id
    that stays, the first by text does (a null text counts as empty).
    """
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark.

    Null and wordless texts have none and stay; repeated rows and null ids are judged
    row by row; an empty benchmark keeps all.
    """
    return decontaminate.drop_documents(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, shuffled.

    A null source is a source of its own; rows that share an id, null ones too, draw
    the same count; null and empty texts are rows like others.
    """
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all that is left, in the order the mixing left, as read back.

    A row per input row (doc_id, start, n_tokens, ids_crc32): null and empty texts give
    the end id alone; null and repeated ids keep all their rows.
    """
    return token_records.encode_and_read_back(docs, order=[])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Token ids and likelihoods can't be expressed in SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and read back."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.release(before)  # the stage that read it is written
        before = docs
    return docs
