"""Benchmark decontamination: a broadcast hash set of test n-grams.

Words are runs of ASCII letters and digits and of any byte over 0x7F, with A-Z
folded. A window is ``n`` consecutive words of an item; an item with fewer words
(but not none) is one window. Each training text is scanned once: rolling window
hashes are probed in a bitmap, then in the sorted set, and every hit is verified
by comparing the words themselves, so a hash collision changes nothing.

The windows are built on the driver from at most about ``part_bytes`` of benchmark
text at a time, as arrays of 20 bytes a window (there is at most one for each two
bytes of text) beside the text. A larger benchmark is split by hash of the item
into parts. Each is broadcast by itself and scans the texts alone; what it finds,
hit runs and items by a 128-bit hash of the text, is written, and joined to the
documents once all parts are done. So any benchmark size gives the same result
with the same memory, and documents are never rewritten. An item is never split.

Defined cases: null or wordless text has no words and no hits; an item without
words has no windows; an item whose id is null marks hits but is not listed;
repeated items and repeated documents count on their own; a very long text is
scanned whole, by itself; an empty benchmark or document table gives no hits or no
rows. Further columns pass through untouched; ``out_col`` must be a new name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textscan

WINDOW = 10
PART_BYTES = 8 << 20
BITMAP = 1 << 22

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
#: What a part finds in a text: runs of hit words, by word and by byte, and the items.
HITS = "text string, items array<string>, runs array<struct<first: long, last: long, start: long, end: long>>"
ARROW_FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


class Windows:
    """The windows of some benchmark items as arrays, by length and sorted by hash.

    Words are kept once, in ``blob`` with a space after each; a window is its hash,
    its item and its first word. Windows of one hash stand together and mostly are
    one text, which then is compared once for all of them (``alike``).
    """

    def __init__(self, ids: list[str | None], texts: list[str | None], n: int = WINDOW):
        self.ids = ids
        data, offsets = textscan.buffers(pa.array(texts, pa.string()))
        start, end, doc, folded = textscan.words(data, offsets, textscan.ALNUM)
        word = textscan.word_hashes(folded, start, end)
        many = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        first = np.cumsum(many) - many
        self.blob, self.word = _joined(folded, start, end)
        self.bitmap, self.by_size = np.zeros(BITMAP, dtype=bool), {}
        for size in np.unique(np.minimum(many, n)).tolist():
            own = many >= n if size == n else many == size
            if not size or not own.any():
                continue
            h = textscan.window_hashes(word, size)
            at = np.flatnonzero((own[doc] & (np.arange(len(doc)) + size <= (first + many)[doc]))[: len(h)])
            at = at[np.argsort(h[at], kind="stable")]
            keys, lo = np.unique(h[at], return_index=True)
            hi = np.r_[lo[1:], len(at)]
            alike = np.ones(len(keys), bool)
            for k in np.flatnonzero(hi - lo > 1).tolist():
                same = {self.text(int(w), size) for w in at[lo[k] : hi[k]]}
                alike[k] = len(same) == 1
            self.bitmap[(keys & np.uint64(BITMAP - 1)).astype(np.int64)] = True
            self.by_size[size] = keys, lo, hi, alike, doc[at].astype(np.int32), at

    def text(self, i: int, size: int) -> bytes:
        """The words of a window, joined by spaces."""
        return self.blob[self.word[i] : self.word[i + size] - 1]

    def scan(self, column: pa.Array):
        """Per text: (number of words, hit word numbers, item numbers, byte span of each word)."""
        data, offsets = textscan.buffers(column)
        for a, b in textscan.slices(offsets):
            base = offsets[a]
            start, end, doc, folded = textscan.words(data[base : offsets[b]], offsets[a : b + 1] - base, textscan.ALNUM)
            word = textscan.word_hashes(folded, start, end)
            hit, items = np.zeros(len(word), bool), {}
            for size, (keys, lo, hi, alike, item, where) in self.by_size.items():
                h = textscan.window_hashes(word, size)
                at = np.flatnonzero(self.bitmap[(h & np.uint64(BITMAP - 1)).astype(np.int64)])
                at = at[doc[at] == doc[at + size - 1]]
                place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                met = keys[place] == h[at]
                for i, k in zip(at[met].tolist(), place[met].tolist()):
                    text = window_text(folded, start, end, i, size)
                    if alike[k]:
                        good = slice(lo[k], hi[k] if text == self.text(int(where[lo[k]]), size) else lo[k])
                    else:
                        good = [e for e in range(lo[k], hi[k]) if text == self.text(int(where[e]), size)]
                    if len(found := item[good]):
                        hit[i : i + size] = True
                        items.setdefault(int(doc[i]), {})[size, text] = found
            first = np.searchsorted(doc, np.arange(b - a + 1))
            for k in range(b - a):
                x, y = int(first[k]), int(first[k + 1])
                near = np.flatnonzero(hit[x:y]) if k in items else ()
                shift = int(offsets[a + k] - base)
                who = np.unique(np.concatenate(list(items[k].values()))).tolist() if k in items else ()
                yield y - x, near, who, start[x:y] - shift, end[x:y] - shift


def _joined(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(all words with a space after each, place of each word and of the end)."""
    size = end - start
    at = np.r_[0, np.cumsum(size + 1)]
    out = np.full(int(at[-1]), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = folded[folded != 0]
    return out.tobytes(), at


def window_text(folded, start, end, i: int, size: int) -> bytes:
    return b" ".join(folded[start[j] : end[j]].tobytes() for j in range(i, i + size))


def parts(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int, n: int):
    """Windows objects of about ``part_bytes`` of item text each."""
    keyed = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("words"))
    total = keyed.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    count = -(-total // part_bytes) or 1
    for p in range(count):
        rows = keyed.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == p).collect()
        yield p == count - 1, Windows([r["item"] for r in rows], [r["words"] for r in rows], n)


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "_found", n: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with a struct column ``out_col``: n_words, n_hit, items (sorted), spans (bytes of hit runs)."""
    spark = docs.sparkSession
    if common.free_name(docs, out_col) != out_col:
        raise ValueError(f"there is a column {out_col!r} already")
    common.small_batches(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, FOUND)])
    found = None
    for last, windows in parts(benchmark, item_col, item_text_col, part_bytes, n):
        shared = spark.sparkContext.broadcast(windows)
        if last and found is None:
            return docs.mapInArrow(_annotator(shared, text_col, out_col), schema)
        own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_finder(shared), HITS)
        # Copies of a text find the same, so a part leaves a row per text.
        own = own.select(F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(1), "text").alias("tb"), "items", "runs")
        own = common.materialize(own.groupBy("ta", "tb").agg(F.first("items").alias("items"), F.first("runs").alias("runs")), "benchmark-hits")
        shared.unpersist()
        found = own if found is None else found.union(own)
    return _joined_hits(docs, found, text_col, out_col)


def _joined_hits(docs: DataFrame, found: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """docs with the hits that several parts found in their texts; runs that overlap or follow on are one."""
    spark = docs.sparkSession
    merged = found.groupBy("ta", "tb").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    grow = lambda a, x: F.struct(a["first"].alias("first"), F.greatest(a["last"], x["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["end"], x["end"]).alias("end"))
    fold = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["last"] >= x["first"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(grow(F.element_at(a, -1), x)))).otherwise(F.concat(a, F.array(x)))
    one = F.aggregate("runs", F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"), fold)
    a, b, hits = (common.free_name(docs, x) for x in ("_pl_ta", "_pl_tb", "_pl_hits"))
    merged = common.materialize(merged.select(F.col("ta").alias(a), F.col("tb").alias(b), F.struct("items", one.alias("runs")).alias(hits)), "all-benchmark-hits")
    scanned = docs.mapInArrow(_annotator(spark.sparkContext.broadcast(Windows([], [])), text_col, out_col), T.StructType([*docs.schema.fields, T.StructField(out_col, FOUND)]))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = scanned.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)})
    joined = common.join_by_keys(keyed, merged, [a, b], "left")
    own, other = F.col(f"`{out_col}`"), F.col(hits)
    count = F.aggregate(other["runs"], F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])
    spans = F.transform(other["runs"], lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    full = F.when(other.isNotNull(), F.struct(own["n_words"].alias("n_words"), count.alias("n_hit"), other["items"].alias("items"), spans.alias("spans"))).otherwise(own)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], full.alias(out_col))


def _annotator(shared, text_col: str, out_col: str):
    def run(batches):
        windows = shared.value
        for batch in batches:
            rows = []
            for n_words, hits, items, start, end in windows.scan(batch.column(batch.schema.names.index(text_col))):
                names = sorted({windows.ids[i] for i in items} - {None})
                rows.append({"n_words": n_words, "n_hit": len(hits), "items": names, "spans": [{"start": s, "end": e} for _, _, s, e in _runs(hits, start, end)]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, ARROW_FOUND)], names=[*batch.schema.names, out_col])

    return run


def _finder(shared):
    """text -> HITS of texts that have some."""
    def run(batches):
        windows = shared.value
        for batch in batches:
            rows, at = [], []
            for k, (_, hits, items, start, end) in enumerate(windows.scan(batch.column(0))):
                if len(hits):
                    runs = [dict(zip(("first", "last", "start", "end"), r)) for r in _runs(hits, start, end)]
                    rows.append((sorted({windows.ids[i] for i in items} - {None}), runs))
                    at.append(k)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], _RUNS)], names=["text", "items", "runs"])

    return run


_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))


def _runs(hits, start, end) -> list[tuple[int, int, int, int]]:
    """Hit words as runs: first word, last word + 1, first byte, last byte + 1."""
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) > 1)
    return [(int(hits[a]), int(hits[b]) + 1, int(start[hits[a]]), int(end[hits[b]])) for a, b in zip(np.r_[0, cut + 1].tolist(), np.r_[cut, len(hits) - 1].tolist())]


def drop_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark window occurs, columns as given."""
    out = common.free_name(docs, "_found")
    found = annotate(docs, benchmark, text_col, out_col=out, **options)
    return found.where(F.col(out)["n_hit"] == 0).select(*[f"`{c}`" for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with the hit runs cut out of their texts; null stays null."""
    out = common.free_name(docs, "_found")
    found = annotate(docs, benchmark, text_col, out_col=out, **options)

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, runs in zip(texts, spans):
            if text is not None and runs is not None and len(runs):
                data, kept, at = text.encode(), [], 0
                for r in runs:
                    kept.append(data[at : r["start"]])
                    at = r["end"]
                text = b"".join([*kept, data[at:]]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    cleaned = found.withColumn(text_col, cut(F.col(f"`{text_col}`"), F.col(out)["spans"]))
    return cleaned.select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, common.table(spark, sf_dir, "benchmark"))
    ids = F.array_join("_found.items", ",")
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        F.col("_found.n_hit").alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("_found.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT d.*, s.size, unnest(range(1, len(w) - s.size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(w) >= s.size)),
h AS (SELECT dw.r, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
