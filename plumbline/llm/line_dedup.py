"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A text's lines are hashed (two 64-bit hashes each). From every line a window of
lines reaches to where it holds ``WORDS`` words (runs of anything but ASCII white
space), however many lines without words lie between; the least hash of its lines
with words, the last on ties, is its fingerprint. Equal windows have
equal fingerprints, so a run of ``WORDS`` words that repeats is found for sure
among the fingerprints that occur more than once; the others go no further. The
windows of the rest are joined by position to the window's first occurrence in
order of (doc_id, text hash, line), a row per later occurrence and never pairs of
them. Later ones that follow each other on a diagonal form a run, the run is
extended both ways line by line against the first occurrence (onwards by fewer than
``WORDS`` lines with words, as windows cover what is beyond), and its lines are
deleted. Each deleted line equals an earlier line, so nothing is lost altogether.

A common window's group is only counted and its least position taken, which is
done before and after the shuffle. Both results are written, and joined back by
their size: broadcast, or by hash, where adaptive execution then splits a hot one.

Defined cases: a null text stays null with 0 lines; an empty text has one empty
line; texts of fewer than ``WORDS`` words have no window and are kept; rows equal
in id and text are one document and get the same result; null ids sort first; an
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 50


def line_structs(text: Column) -> Column:
    """Per line: two hashes and the number of words."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("g"), F.regexp_count(x, F.lit(r"\S+")).alias("w")))


def windows(one: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, s, n, rest, fh, fresh, k, l): every window with its fingerprint and content hashes.

    Lines without words weigh nothing: a window that starts with some holds the same
    lines with words as the one after them. Each run of them is one hash, so a window
    has at most ``words`` elements. ``rest`` counts the lines with words from its last.
    """
    lines = one.select("doc_id", "th", F.posexplode("lines").alias("pos", "x")).select("doc_id", "th", "pos", "x.h", "x.g", F.col("x.w").cast("long").alias("w"))
    by_doc = Window.partitionBy("doc_id", "th")
    full_line = F.col("w") > 0
    upwards = by_doc.orderBy(F.desc("pos"))
    below, from_here = upwards.rowsBetween(Window.unboundedPreceding, -1), upwards.rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumns({"after": F.sum("w").over(from_here), "rest": F.count(F.when(full_line, 1)).over(from_here), "next": F.last(F.when(full_line, F.col("pos")), True).over(below)})
    placed = placed.withColumn("x", F.coalesce(F.bit_xor(F.when(~full_line, F.xxhash64("h", "g", F.col("next") - F.col("pos")))).over(from_here), F.lit(0)))
    # Of the lines without words from here, or from the line after one with words, up to the next with words.
    placed = placed.withColumn("gap", F.col("x").bitwiseXOR(F.coalesce(F.last(F.when(full_line, F.col("x")), True).over(below), F.lit(0))))
    reach = by_doc.orderBy(F.desc("after")).rangeBetween(0, words - 1)
    seen = placed.select(
        "doc_id", "th", "pos",
        F.when(~full_line, F.col("gap")).alias("lead"),
        F.sum("w").over(reach).alias("words"),
        (F.max("pos").over(reach) - F.col("pos") + 1).alias("n"),
        F.min("rest").over(reach).alias("rest"),
        F.min(F.when(full_line, F.struct("h", (-F.col("pos")).alias("p")))).over(reach).alias("f"),
        F.collect_list(F.when(full_line, F.struct("h", "g", "gap"))).over(reach).alias("content"),
    )
    full = seen.where(F.col("words") >= words)
    fresh = F.coalesce(F.lag("f.p").over(by_doc.orderBy("pos")) != F.col("f.p"), F.lit(True))
    last = F.element_at("content", -1)
    same = [F.col("lead"), F.slice("content", 1, F.size("content") - 1), last["h"], last["g"]]
    return full.select("doc_id", "th", F.col("pos").alias("s"), "n", "rest", F.col("f.h").alias("fh"), fresh.alias("fresh"), F.xxhash64(*same).alias("k"), F.xxhash64(*same, F.lit(1)).alias("l"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements agree from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same))


def repeated_runs(one: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, a, b): runs of lines to delete, from a up to b."""
    spans = common.materialize(windows(one, words), "windows")
    twice = common.materialize(spans.where("fresh").groupBy("fh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fh"), "fingerprints")
    likely = common.materialize(common.join_by_keys(spans, twice, "fh", "left_semi").select("doc_id", "th", "s", "n", "rest", "k", "l"), "likely")
    common.release(spans, twice)
    first = likely.groupBy("k", "l").agg(F.min(F.struct("doc_id", "th", "s")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("k", "l", "first")
    first = common.materialize(first, "first-windows")
    later = common.join_by_keys(likely, first, ["k", "l"], "inner").where(~F.struct("doc_id", "th", "s").eqNullSafe(F.col("first")))
    diagonal = Window.partitionBy("doc_id", "th", "fd", "ft", "delta").orderBy("s")
    later = later.select("doc_id", "th", "s", "n", "rest", F.col("first.doc_id").alias("fd"), F.col("first.th").alias("ft"), (F.col("s") - F.col("first.s")).alias("delta"))
    islands = later.withColumn("island", F.col("s") - F.row_number().over(diagonal)).groupBy("doc_id", "th", "fd", "ft", "delta", "island")
    runs = common.materialize(islands.agg(F.min("s").alias("a"), F.max(F.col("s") + F.col("n") - 1).cast("int").alias("b"), F.min("rest").alias("rest")), "runs")
    common.release(likely, first)

    full_lines = F.array_compact(F.transform("lines", lambda x, i: F.when(x["w"] > 0, i)))
    hashes = one.select("doc_id", "th", F.transform("lines", lambda x: F.struct(x["h"], x["g"])).alias("own"), full_lines.alias("full_lines"))
    firsts = hashes.select(F.col("doc_id").alias("fd"), F.col("th").alias("ft"), F.col("own").alias("theirs"))
    both = runs.join(hashes, runs["doc_id"].eqNullSafe(hashes["doc_id"]) & (runs["th"] == hashes["th"])).drop(hashes["doc_id"]).drop(hashes["th"])
    # Only what the extension can reach is carried to the first occurrence: fewer than `words` lines with words
    # (any number without) onwards, and nothing backwards that isn't in a window of its own.
    end = F.coalesce(F.get("full_lines", (F.size("full_lines") - F.col("rest") + words).cast("int")), F.size("own") - 1)
    at = F.greatest(F.col("a") - words, F.lit(0))
    near = both.select(
        "doc_id", "th", "fd", "ft", "a", "b", "delta",
        F.reverse(F.slice("own", at + 1, F.col("a") - at)).alias("left"),
        F.slice("own", F.col("b") + 2, end - F.col("b")).alias("right"),
    )
    met = near.join(firsts, near["fd"].eqNullSafe(firsts["fd"]) & (near["ft"] == firsts["ft"]))
    fa, fb = F.col("a") - F.col("delta"), F.col("b") - F.col("delta")
    start = F.greatest(fa - words, F.lit(0))
    back = common_prefix(F.col("left"), F.reverse(F.slice("theirs", start + 1, fa - start)))
    on = common_prefix(F.col("right"), F.slice("theirs", fb + 2, F.size("right")))
    return met.select("doc_id", "th", (F.col("a") - back).cast("int").alias("a"), (F.col("b") + on).cast("int").alias("b"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row, later repeated runs deleted."""
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    one = keyed.where("text IS NOT NULL").select("doc_id", "th", line_structs(F.col("text")).alias("lines")).groupBy("doc_id", "th").agg(F.first("lines").alias("lines"))
    one = common.materialize(one, "lines")
    gone = repeated_runs(one, words).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    gone = common.materialize(gone.select(F.col("doc_id").alias("_pl_id"), F.col("th").alias("_pl_th"), "gone"), "gone")
    side = F.broadcast(gone) if common.is_small(gone) else gone
    marked = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("_pl_id")) & (F.col("th") == F.col("_pl_th")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("gone", lambda r: (i >= r["a"]) & (i <= r["b"])))
    found = marked.select("doc_id", "text", "gone", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(F.col("gone").isNotNull(), kept).alias("kept"))
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept"))
    return found.select("doc_id", F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"), "n_lines", removed.cast("long").alias("n_removed"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every line of every document; runs of 50 words or more."""
    return dedup(common.table(spark, sf_dir, "documents"))
