"""Section-aware chunks of documents, folded within each row: no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def _sections(text: Column) -> Column:
    """array<struct<title, content>>: what follows each '## ' heading; what stands before the first is skipped."""
    piece = "array<struct<title:string,content:string>>"
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast(piece).alias("done"), F.lit(None).cast("string").alias("title"), empty.alias("lines"))

    def closed(a: Column) -> Column:
        whole = F.struct(a["title"].alias("title"), F.array_join(a["lines"], "\n").alias("content"))
        return F.when((F.coalesce(a["title"], F.lit("")) != "") & (F.size(a["lines"]) > 0), F.concat(a["done"], F.array(whole).cast(piece))).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        heading = F.trim(F.regexp_replace(line, "^#+", ""))
        sentence = F.when(heading.rlike(r"[.!?:]$"), heading).otherwise(F.concat(heading, F.lit(".")))
        more = F.concat(a["lines"], F.array(F.when(line.startswith("###"), sentence).otherwise(line)))
        fresh = F.struct(closed(a).alias("done"), F.trim(F.substring(line, 4, 1 << 30)).alias("title"), empty.alias("lines"))
        kept = F.struct(a["done"].alias("done"), a["title"].alias("title"), more.alias("lines"))
        return F.when(line.startswith("## "), fresh).when(a["title"].isNull(), a).otherwise(kept)

    found = F.aggregate(F.split(text, r"\r\n|\n|\r"), start, step, closed)
    found = F.transform(found, lambda s: F.struct(s["title"].alias("title"), F.regexp_replace(s["content"], r"^\s+|\s+$", "").alias("content")))
    return F.filter(found, lambda s: s["content"] != "")


def _sentences(content: Column) -> Column:
    flat = F.replace(F.replace(content, F.lit("\n\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    parts = F.split(F.trim(flat), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def _pack(sentences: Column) -> Column:
    """array<string>: sentences put together greedily, none broken."""
    text = "array<string>"
    start = F.struct(F.array().cast(text).alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def step(a: Column, s: Column) -> Column:
        full = (a["size"] + F.length(s) > fixed.CHUNK_MAX) & (a["open"] != "")
        done = F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        open_ = F.when(full | (a["open"] == ""), s).otherwise(F.concat(a["open"], F.lit(" "), s))
        size = F.when(full, 0).otherwise(a["size"]) + F.length(s) + 1
        closed = F.struct(F.concat(done, F.array(open_)).alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))
        return F.when(size >= fixed.CHUNK_TARGET, closed).otherwise(F.struct(done.alias("done"), open_.alias("open"), size.alias("size")))

    def finish(a: Column) -> Column:
        many = F.size(a["done"])
        joined = F.concat(F.slice(a["done"], 1, F.greatest(many - 1, F.lit(0))), F.array(F.concat(F.element_at(a["done"], -1), F.lit(" "), a["open"])))
        own = F.concat(a["done"], F.array(a["open"]))
        return F.when(a["open"] == "", a["done"]).when((many > 0) & (F.length(a["open"]) < fixed.CHUNK_TAIL), joined).otherwise(own)

    return F.aggregate(sentences, start, step, finish)


def doc_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_index, title, content)."""
    return docs.select(id_col, F.posexplode(_sections(F.col(text_col))).alias("section_index", "s")).select(id_col, "section_index", "s.title", "s.content")


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentence_index, sentence)."""
    return docs.select(id_col, F.posexplode(_sentences(F.col(text_col))).alias("sentence_index", "sentence"))


def pack_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, chunk_index, n_chunks_in_section, text): chunks that carry their section's title."""
    packed = doc_sections(docs, id_col, text_col).withColumn("c", _pack(_sentences(F.col("content"))))
    rows = packed.select(id_col, "section_index", F.col("title").alias("section"), F.size("c").alias("n_chunks_in_section"), F.posexplode("c").alias("chunk_index", "chunk"))
    return rows.select(id_col, "section_index", "section", "chunk_index", "n_chunks_in_section", F.concat("section", F.lit("\n\n"), "chunk").alias("text"))
