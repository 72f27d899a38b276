"""Language identification by Bayesian evidence fusion.

Evidence about a record's language l:

* its text: byte 4-gram likelihoods log P(text | l) from a naive Bayes model,
  tempered because neighbouring 4-grams overlap;
* the language its markup declares: P(declared | l);
* its address: a prior P(l | host), smoothed towards the host's address suffix,
  which is smoothed towards all records, each step worth ``KAPPA`` records.

The tables behind the last two are grouped sums of the text posteriors over all
records (a step before the shuffle, so a host with a third of all rows is one row
per task); a record's own share is taken out of its host's sums. The text model is
trained on rows of at most ``SAMPLE`` ids per language, taken by hash of the id.
Every name in the training rows is a language, however many there are: the model
takes 128 KB of the driver for each, and texts are scored ``BLOCK`` languages at a
time, so no worker holds more than a block's table.

A record is accepted when it has a letter and its best language reaches
``CONFIDENCE``; the pipeline drops the others.

Defined cases: null and empty texts have no letters and aren't accepted; their
language is what declaration and address say; null hosts and suffixes are groups of
their own; a declared language that isn't among the model's counts as "other";
null ids pass through; repeated rows are counted on their own, and rows that share
an id but not a language each train their own; languages that tie go to the first by
name; very long texts are read whole, by themselves; an empty table gives no rows; a
training table that names no language leaves one, ``und``, at confidence 1, so that
records with a letter are accepted. Further columns of documents pass through
``keep_accepted`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textscan

SAMPLE = 1500
BUCKETS = 1 << 15
GRAM = 4
TEMPER = 0.3
KAPPA = 20.0
CONFIDENCE = 0.5
ALPHA = 0.2
#: Languages scored at once.
BLOCK = 256
#: Languages summed as columns; arrays of more are exploded.
WIDE = 64
#: Values of P(declared | language) that may be broadcast.
BROADCAST_VALUES = 1_000_000
#: The only language where no row names one.
UNKNOWN = "und"

#: Letters are folded, everything else is one kind of gap.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray):
    """(bucket, text) of every 4-gram that starts at or before a letter, texts framed by gaps; letters by text."""
    folded = FOLD[data]
    size = np.diff(offsets)
    framed = np.full(len(data) + 2 * len(size), 32, dtype=np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    framed[np.arange(len(data)) + 2 * doc + 1] = folded
    owner = np.repeat(np.arange(len(size)), size + 2)
    n = len(framed) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    key = framed[:n] << np.uint64(24) | framed[1 : n + 1] << np.uint64(16) | framed[2 : n + 2] << np.uint64(8) | framed[3 : n + 3]
    good = (owner[:n] == owner[GRAM - 1 :]) & (framed[1 : n + 1] != 32)
    bucket = (textscan.mix(key[good]) % np.uint64(BUCKETS)).astype(np.int64)
    letters = np.bincount(doc, weights=folded != 32, minlength=len(size)).astype(np.int64)
    return bucket, owner[:n][good], letters


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from at most ``sample`` rows of each language."""
    from pyspark.sql import Window

    common.small_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.trim(F.col(f"`{lang_col}`"))).alias("lang")).where("id IS NOT NULL AND lang != ''")
    counts = common.materialize(named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if counts.isEmpty():
        return [UNKNOWN], np.zeros((BUCKETS, 1), dtype=np.float32)
    # A hash threshold by language leaves a little more than the sample, whatever the language's size.
    share = F.least(F.lit(1.0), F.lit(1.5 * sample) / F.col("n") + F.lit(50.0) / F.col("n"))
    place = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = common.join_by_keys(named, counts, "lang", "inner").where(place < share).select("id", "lang").distinct()
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))).where(F.col("place") <= sample)
    drawn = common.materialize(drawn.select("id", "lang").distinct(), "language-sample")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.trim(F.col(f"`{lang_col}`"))).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = common.join_by_keys(rows, drawn, ["id", "lang"], "left_semi").select("lang", "text")

    def flush(sums):
        at = [np.flatnonzero(v) for v in sums.values()]
        found = [v[i].astype(np.int64).tobytes() for v, i in zip(sums.values(), at)]
        return pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array([i.astype(np.int64).tobytes() for i in at], pa.binary()), pa.array(found, pa.binary())], names=["lang", "buckets", "counts"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = textscan.buffers(batch.column(1))
            langs = np.array(batch.column(0).to_pylist())
            bucket, owner, _ = grams(data, offsets)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[(langs == lang)[owner]], minlength=BUCKETS)
                if len(sums) >= BLOCK:
                    yield flush(sums)
                    sums = {}
        if sums:
            yield flush(sums)

    totals: dict[str, np.ndarray] = {}
    for row in texts.mapInArrow(run, "lang string, buckets binary, counts binary").toLocalIterator():
        # Counts of a sample: 32 bits are enough in the table of all languages.
        own = totals.setdefault(row["lang"], np.zeros(BUCKETS, np.uint32))
        own[np.frombuffer(row["buckets"], np.int64)] += np.frombuffer(row["counts"], np.int64).astype(np.uint32)
    langs = sorted(totals)
    table = np.empty((BUCKETS, len(langs)), np.float32, order="F")
    for k, lang in enumerate(langs):
        own = totals.pop(lang) + ALPHA
        table[:, k] = np.log(own / own.sum())
    return langs, table


def text_evidence(records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """records (..., text) with letters and ll (tempered log likelihoods by language), without text."""
    table = model[1]
    found = score_block(records, table[:, :BLOCK], table.shape[1] > BLOCK)
    for a in range(BLOCK, table.shape[1], BLOCK):
        # Blocks are written apart, so that a worker has one table at a time.
        before = common.materialize(found.withColumnRenamed("ll", "_pl_ll").drop("letters"), "evidence-block")
        found = score_block(before, table[:, a : a + BLOCK], a + BLOCK < table.shape[1])
        found = found.withColumn("ll", F.concat("_pl_ll", "ll")).drop("_pl_ll")
    return found


def score_block(records: DataFrame, table: np.ndarray, keep_text: bool) -> DataFrame:
    """records (..., text) with letters and ll by the table's languages, with or without text."""
    shared = records.sparkSession.sparkContext.broadcast(table)
    common.small_batches(records.sparkSession)
    names = [c for c in records.columns if keep_text or c != "text"]
    at = records.columns.index("text")

    def run(batches):
        known = shared.value
        for batch in batches:
            data, offsets = textscan.buffers(batch.column(at))
            ll, letters = [], []
            for a, b in textscan.slices(offsets, 1 << 20):
                bucket, owner, found = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sums = np.stack([np.bincount(owner, weights=known[:, k][bucket], minlength=b - a) for k in range(known.shape[1])], axis=1)
                ll.append(sums * TEMPER)
                letters.append(found)
            ll = np.concatenate([np.zeros((0, known.shape[1])), *ll])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * known.shape[1], pa.int32()), pa.array(ll.ravel()))
            rest = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate([np.zeros(0, np.int64), *letters])), lists], names=[*names, "letters", "ll"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields if f.name in names)
    return records.mapInArrow(run, f"{fields}, letters long, ll array<double>")


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, not for each element of what f gives."""
    return F.transform(F.array(x), f)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(x: Column) -> Column:
    shares = lambda powers: let(total(powers), lambda t: F.transform(powers, lambda v: v / t))
    return let(x, lambda y: let(F.array_max(y), lambda top: let(F.transform(y, lambda v: F.exp(v - top)), shares)))


def smooth(own: Column, up: Column) -> Column:
    return let(own, lambda o: let(total(o), lambda t: F.zip_with(o, up, lambda x, q: (x + F.lit(KAPPA) * q) / (t + F.lit(KAPPA)))))


def numbers(values) -> Column:
    """An array as one literal."""
    return F.split(F.lit(" ".join(repr(float(v)) for v in values)), " ").cast("array<double>")


def sums(rows: DataFrame, keys: list[str], values: str, n: int) -> DataFrame:
    """(keys..., own): arrays of n values summed by place; nulls count as zeros."""
    if n <= WIDE:
        each = [F.coalesce(F.sum(F.col(values)[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
        return rows.groupBy(*keys).agg(*each).select(*keys, F.array(*[f"s{i}" for i in range(n)]).alias("own"))
    placed = rows.select(*keys, F.posexplode_outer(values).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    whole = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_v")))).alias("_all"))
    own = F.when(F.size("_all") == 0, F.array_repeat(F.lit(0.0), n)).otherwise(F.transform("_all", lambda x: x["_v"]))
    return whole.select(*keys, own.alias("own"))


def fuse(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """evidence (..., declared, suffix, host, letters, ll) with lang, confidence and accepted.

    evidence must be written, as it is read three times.
    """
    n = len(langs)
    p = F.when(F.col("letters") > 0, softmax(F.col("ll")))
    said = F.when(F.col("declared").isNull(), F.lit("")).when(F.col("declared").isin(langs), F.col("declared")).otherwise(F.lit("other"))
    rows = evidence.withColumn("p", p).withColumn("said", said).withColumn("_h", F.coalesce("host", F.lit(""))).withColumn("_s", F.coalesce("suffix", F.lit("")))
    hosts = common.materialize(sums(rows, ["_h", "_s"], "p", n), "hosts")
    root = np.array(sums(hosts, [], "own", n).first()["own"]) + 1.0
    base = numbers(root / root.sum())
    suffixes = sums(hosts, ["_s"], "own", n).select("_s", smooth(F.col("own"), base).alias("up"))
    priors = common.materialize(hosts.join(suffixes, "_s").select("_h", "_s", "own", "up"), "priors")
    # At most a row for each language and two more: a table of P(declared | language).
    told = common.materialize(sums(rows, ["said"], "p", n), "told")
    kinds = told.count()
    by_lang = numbers(np.array(sums(told, [], "own", n).first()["own"]) + 0.5 * kinds)
    heard = told.select("said", F.zip_with("own", by_lang, lambda x, t: F.log((x + 0.5) / t)).alias("_heard"))
    joined = rows.join(priors, ["_h", "_s"]).join(F.broadcast(heard) if kinds * n <= BROADCAST_VALUES else heard, "said")
    own = F.when(F.col("p").isNull(), F.col("own")).otherwise(F.zip_with("own", "p", lambda x, q: F.greatest(x - q, F.lit(0.0))))
    joined = joined.withColumn("_own", own).withColumn("_prior", smooth(F.col("_own"), F.col("up")))
    weight = F.zip_with(F.zip_with("ll", "_prior", lambda x, q: x + F.log(q)), "_heard", lambda x, q: x + q)
    scored = joined.withColumn("_post", softmax(weight)).withColumn("confidence", F.array_max("_post"))
    named = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("_post", F.col("confidence")).cast("int"))
    accepted = (F.col("letters") > 0) & (F.col("confidence") >= CONFIDENCE)
    return scored.withColumn("lang", named).withColumn("accepted", accepted).drop("p", "said", "_h", "_s", "own", "up", "_own", "_prior", "_post", "_heard", "ll")


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, declared, suffix, host, text) of pages: page_id, url, html."""
    html = F.col("html").cast("string")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    text = F.regexp_replace(text, r"&(?:[a-zA-Z]+|#[0-9]+);", " ")
    return pages.select("page_id", F.nullif(declared, F.lit("")).alias("declared"), F.nullif(F.element_at(F.split(host, "\\."), -1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"), text.alias("text"))


def document_records(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, declared, suffix, host, text) of documents, whose source stands for the host."""
    return docs.select(F.col(id_col).alias("doc_id"), F.lower(F.trim("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))


def identify(records: DataFrame, model, name: str = "evidence") -> DataFrame:
    """records (keys..., declared, suffix, host, text) -> keys..., lang, confidence, accepted and the evidence used."""
    return fuse(common.materialize(text_evidence(records, model), name), model[0])


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, columns as given.

    A row's decision depends on its id, text, declared language and source, so two
    hashes of these name it; only the rejected rows' hashes are joined back.
    """
    k, l = common.free_name(docs, "_pl_k"), common.free_name(docs, "_pl_l")
    keys = {k: F.xxhash64("doc_id", "text", "lang", "source"), l: F.xxhash64(F.lit(1), "doc_id", "text", "lang", "source")}
    plain = docs.select("doc_id", "text", "lang", "source")
    records = document_records(plain.withColumns(keys).withColumn("_pl_key", F.struct(*keys)), "_pl_key")
    found = identify(records, train(plain))
    gone = common.materialize(found.where("NOT accepted").select("doc_id.*").distinct(), "rejected")
    return common.join_by_keys(docs.withColumns(keys), gone, list(keys), "left_anti").drop(*keys)


def query(spark, sf_dir: str) -> DataFrame:
    """All of pages and all of documents."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs)
    pages = identify(page_records(common.table(spark, sf_dir, "pages")), model).withColumn("doc_id", F.lit(None).cast("long"))
    texts = identify(document_records(docs), model).withColumn("page_id", F.lit(None).cast("long"))
    names = ["page_id", "doc_id", "lang", "confidence", "accepted", "declared", "host", "letters"]
    return texts.select(*names).union(pages.select(*names))
