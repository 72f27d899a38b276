"""Embeddings and exact cosine top-k: blocks of queries against all rows."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.workers import find_package

#: What the queries of one pass may take, once on the driver and in each worker.
QUERY_BYTES = 64 << 20
#: Queries and rows that are multiplied at once: 16 MB of similarities.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 2048, 1024


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", cutoff: float | None = None) -> DataFrame:
    """(query, rank, id, similarity): the k most similar rows of each query; below the cutoff dropped after that.

    Each task multiplies its rows with a block of queries and keeps the k best of
    each over all of its rows, so what is shuffled is k rows per query and task.
    Vectors are read once per ``QUERY_BYTES`` of queries. Zero vectors match nothing;
    equal similarities (to 12 digits) are ranked by id.
    """
    spark = vectors.sparkSession
    find_package(spark)
    shape = queries.where(F.col(vector_col).isNotNull()).agg(F.count(F.lit(1)), F.max(F.size(vector_col))).first()
    blocks = max(1, math.ceil(shape[0] * (shape[1] or 1) * 8 / QUERY_BYTES))
    kind, own = queries.schema[query_col].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == b).select(F.col(query_col).cast("string").alias("q"), F.col(vector_col).alias("v")).toArrow()
        at, matrix = _normalised(part["v"].combine_chunks(), shape[1] or 0)
        if not len(at):
            continue
        shared = spark.sparkContext.broadcast((part["q"].take(pa.array(at)).to_pylist(), matrix))
        local = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(_best(shared, k), f"q string, id {own}, similarity double")
        out = local if out is None else out.union(local)
    if out is None:
        return spark.createDataFrame([], f"{query_col} {kind}, rank int, {id_col} {own}, similarity double")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
    got = ranked.select(F.col("q").cast(kind).alias(query_col), "rank", F.col("id").alias(id_col), F.bround("similarity", 4).alias("similarity"))
    return got if cutoff is None else got.where(F.col("similarity") >= cutoff)


def _normalised(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of those of the wanted width that aren't null or zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    v = flat.reshape(len(at), width)
    norm = np.linalg.norm(v, axis=1)
    return at[norm > 0], v[norm > 0] / norm[norm > 0, None]


def _best(shared, k: int):
    """Rows of a task -> its k best of each query, by similarity and then id."""
    def run(batches):
        names, matrix = shared.value
        # The best so far: query, similarity, id; and the least similarity that still counts.
        q, similarity, ids = np.zeros(0, np.int64), np.zeros(0), None
        floor, id_type = np.full(len(names), -np.inf), None
        for batch in batches:
            id_type = batch.column(0).type
            at, v = _normalised(batch.column(1), matrix.shape[1])
            own = batch.column(0).take(pa.array(at)).to_pylist()
            for a in range(0, len(at), ROWS_AT_ONCE):
                some = v[a : a + ROWS_AT_ONCE]
                here = np.array(own[a : a + ROWS_AT_ONCE])
                for c in range(0, len(names), QUERIES_AT_ONCE):
                    found = np.round(matrix[c : c + QUERIES_AT_ONCE] @ some.T, 12)
                    least = floor[c : c + QUERIES_AT_ONCE]
                    if found.shape[1] > k:
                        least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
                    x, y = np.nonzero(found >= least[:, None])
                    q, similarity = np.r_[q, x + c], np.r_[similarity, found[x, y]]
                    ids = here[y] if ids is None else np.concatenate([ids, here[y]])
                order = np.lexsort((ids, -similarity, q))
                q, similarity, ids = q[order], similarity[order], ids[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, similarity, ids, place = q[place < k], similarity[place < k], ids[place < k], place[place < k]
                floor[q[place == k - 1]] = similarity[place == k - 1]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], pa.string()), pa.array(ids.tolist(), id_type), pa.array(similarity)], names=["q", "id", "similarity"])

    return run


class HashedTfIdf:
    """The default embedder: hashed stems weighted by inverse document frequency, normalised.

    Any object with ``fit(df, text_col)``, ``embed(df, text_col, out_col)`` and
    ``name`` can stand in, such as a wrapper of a sentence encoder.
    """

    #: The similarity below which a passage doesn't answer a question.
    cutoff = 0.24

    def __init__(self, dims: int = 2048):
        self.dims, self.idf, self.name = dims, None, f"hashed-tfidf-{dims}"

    def buckets(self, text: str | None) -> list[int]:
        words = [w for w in re.findall(r"[a-z]+", (text or "").lower()) if len(w) > 2]
        stems = [re.sub(r"(ations?|ation|ings?|ing|ers?|ed|es|s|ly|ment|ness)$", "", w) if len(w) > 5 else w.rstrip("s") for w in words]
        return [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=4).digest(), "big") % self.dims for s in stems]

    def fit(self, df: DataFrame, text_col: str = "text") -> HashedTfIdf:
        find_package(df.sparkSession)
        take = F.pandas_udf(lambda s: s.map(lambda t: sorted(set(self.buckets(t)))), "array<int>")
        seen = df.select(F.explode(take(F.col(text_col))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()  # at most dims rows
        rows = df.count()
        self.idf = np.full(self.dims, math.log((rows + 1) / 1) + 1)
        for r in seen:
            self.idf[r["b"]] = math.log((rows + 1) / (r["n"] + 1)) + 1
        return self

    def vector(self, text: str | None) -> list[float]:
        v = np.bincount(self.buckets(text), minlength=self.dims).astype(float)
        v = np.sqrt(v) * (self.idf if self.idf is not None else 1.0)
        norm = np.linalg.norm(v)
        return (v / norm if norm else v).tolist()

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        find_package(df.sparkSession)
        make = F.pandas_udf(lambda s: pd.Series([self.vector(t) for t in s]), "array<double>")
        return df.withColumn(out_col, make(F.col(text_col)))


def fingerprint(embedder_name: str, collection: str, text: str) -> str:
    """16 hex digits that change with the backend, the collection or the text."""
    return hashlib.sha256("\0".join((embedder_name, collection, text)).encode()).hexdigest()[:16]


class Index:
    """Chunks and their vectors as a Parquet table that is rebuilt when its fingerprint changes."""

    def __init__(self, spark, path: str, embedder: HashedTfIdf | None = None, collection: str = "advice"):
        self.spark, self.path, self.embedder, self.collection = spark, path, embedder or HashedTfIdf(), collection

    def build(self, text: str, source: str = "advice.md") -> DataFrame:
        from .chunks import pack_chunks

        mark = fingerprint(self.embedder.name, self.collection, text)
        docs = self.spark.createDataFrame([(source, text)], "source string, text string")
        chunks = pack_chunks(docs, "source", "text").withColumn("chunk_id", F.concat_ws("/", "section_index", "chunk_index"))
        if chunks.isEmpty():
            raise ValueError("the text has no '## ' sections")
        self.embedder.fit(chunks)
        try:
            stored = self.spark.read.parquet(self.path)
            if stored.select("fingerprint").distinct().collect() == [(mark,)]:
                return stored
        except Exception as missing:  # Spark has no way to ask whether a path exists
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        self.embedder.embed(chunks).withColumn("fingerprint", F.lit(mark)).write.mode("overwrite").parquet(self.path)
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, k: int = 3, cutoff: float | None = fixed.SIMILARITY_CUTOFF, query_col: str = "query_id", text_col: str = "rag_query") -> DataFrame:
        """(query, rank, section, text, source, similarity); blank queries find nothing."""
        chunks = self.spark.read.parquet(self.path)
        asked = self.embedder.embed(queries.where(F.trim(text_col) != "").select(query_col, text_col), text_col)
        hits = cosine_topk(chunks, asked, k, "chunk_id", "embedding", query_col, cutoff)
        # Hits are k per question; which side is broadcast is left to the sizes of the files.
        return hits.join(chunks.select("chunk_id", "section", "text", "source"), "chunk_id").select(query_col, "rank", "section", "text", "source", "similarity", (1 - F.col("similarity")).alias("distance"))

    def retrieve_for_issues(self, issues: DataFrame, k: int = 3, cutoff: float | None = fixed.SIMILARITY_CUTOFF) -> DataFrame:
        """issues with retrieved_context, an array of hits in order of rank."""
        asked = issues.select(F.coalesce("rag_query", "issue_type").alias("rag_query")).distinct().withColumn("query_id", F.col("rag_query"))
        hits = self.search(asked, k, cutoff).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "section", "text", "source", "similarity"))).alias("retrieved_context"))
        empty = F.array().cast("array<struct<rank:int,section:string,text:string,source:string,similarity:double>>")
        joined = issues.join(hits, F.coalesce("rag_query", "issue_type") == F.col("query_id"), "left").drop("query_id")
        return joined.withColumn("retrieved_context", F.coalesce("retrieved_context", empty))


def retrieval_accuracy(hits: DataFrame, labels: DataFrame, query_labels: DataFrame, id_col: str, query_col: str) -> DataFrame:
    """(queries, correct, accuracy): how often the first hit has the query's label."""
    first = hits.where("rank = 1").join(labels.withColumnRenamed("label", "found"), id_col).join(query_labels, query_col)
    got = first.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("found") == F.col("label")).alias("correct"))
    return got.withColumn("accuracy", F.round(F.when(F.col("queries") > 0, F.col("correct") / F.col("queries")).otherwise(0.0), 4))


def compare_backends(a: DataFrame, b: DataFrame, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """(max_difference, min_cosine) of two sets of vectors of the same rows."""
    both = a.select(id_col, F.col(vector_col).alias("x")).join(b.select(id_col, F.col(vector_col).alias("y")), id_col)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, q: s + q)
    dot = total(F.zip_with("x", "y", lambda p, q: (p * q).cast("double")))
    size = lambda c: F.sqrt(total(F.transform(c, lambda p: (p * p).cast("double"))))
    return both.agg(F.max(F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))).alias("max_difference"), F.min(dot / (size("x") * size("y"))).alias("min_cosine"))
