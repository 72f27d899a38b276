"""A quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words (spaces and line ends part words).
Each passage is a vector of style measures, a histogram of word shapes and one of
hashed words; an encoder maps it to h, a gate (tanh times sigmoid) gives it an
attention weight within its text, and the weighted sum of the h gives the score.
Encoder, gate and classifier are learned together from document labels alone.

The model is trained on the driver from at most ``SAMPLE`` labelled rows, taken by
hash of the id among rows whose crc32(id) mod 4 isn't 2, as far as their passages
come to ``PASSAGES`` (a row with more than an eighth of these isn't taken). Both
bound the driver's memory, and both are parameters. A row that is taken is learned
from whole, and scoring reads every passage of every text. Nothing but the text is
an input of a score.

Defined cases: null and empty texts are one passage without words; a table without
labels of both kinds gives every text the labels' mean (0.5 without any); null
labels and ids without a row are passed over; of an id's labels the larger counts; a
null id is scored and isn't held out; repeated rows score alike; very long texts are
scored whole, by themselves; an empty table gives no rows; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textscan

PASSAGE = 64
SAMPLE = 6000
#: Passages in training, of WIDTH 4-byte numbers each.
PASSAGES = 150_000
THRESHOLD = 0.7
EPOCHS = 8
HIDDEN, GATE = 24, 12
HASHED, SHAPES, STYLE = 96, 48, 14
WIDTH = STYLE + SHAPES + HASHED


def _flags():
    upper = np.zeros(256, np.int64)
    upper[65:91] = 1
    letter = upper.copy()
    letter[97:123] = 1
    letter[128:] = 1
    digit = np.zeros(256, np.int64)
    digit[48:58] = 1
    sign = np.zeros(256, np.int64)
    sign[33:127] = 1 - (letter + digit)[33:127]
    return upper, letter, digit, sign


UPPER, LETTER, DIGIT, SIGN = _flags()
#: The class of a word's last byte: letter or digit, ends of clauses, of calls, other signs.
LAST = np.where(SIGN == 0, 0, 3)
LAST[[44, 46, 58, 59]] = 1
LAST[[33, 63]] = 2


def bags(column: pa.Array):
    """Per slice of texts: (first text, passages' vectors, number of passages of each text)."""
    data, offsets = textscan.buffers(column)
    for a, b in textscan.slices(offsets, 1 << 20):
        raw = data[offsets[a] : offsets[b]]
        start, end, doc, folded = textscan.words(raw, offsets[a : b + 1] - offsets[a], textscan.SPACED)
        count = np.bincount(doc, minlength=b - a)
        per = np.maximum(1, -(-count // PASSAGE))
        base = np.cumsum(per) - per
        if not len(start):
            x = np.zeros((int(per.sum()), WIDTH), np.float32)
            x[:, STYLE - 2] = 1 / PASSAGE  # the fill of a passage counts one word at least
            yield a, x, per
            continue
        word = textscan.word_hashes(folded, start, end)
        within = np.arange(len(start)) - (np.cumsum(count) - count)[doc]
        passage = base[doc] + within // PASSAGE
        n = int(per.sum())
        total = lambda x: np.bincount(passage, weights=x, minlength=n)
        sums = {}
        for name, flag in (("upper", UPPER), ("letter", LETTER), ("digit", DIGIT), ("sign", SIGN)):
            c = np.r_[0, np.cumsum(flag[raw])]
            sums[name] = c[end] - c[start]
        size = end - start
        words = np.maximum(total(np.ones(len(start))), 1)
        chars = np.maximum(total(size), 1)
        same = np.zeros(len(start))
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((word, passage))
        p, w = passage[order], word[order]
        fresh = np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])]
        distinct = np.bincount(p[fresh], minlength=n)
        capital = (sums["upper"] >= 2) & (sums["upper"] * 10 >= sums["letter"] * 6)
        x = np.zeros((n, WIDTH), np.float32)
        style = (
            total(size) / words / 8, np.sqrt(np.maximum(total(size * size) / words - (total(size) / words) ** 2, 0)) / 4,
            total(sums["upper"]) / chars, total(capital) / words, total(sums["sign"]) / chars * 4, total(sums["digit"]) / chars,
            total(same) / words, distinct / words, total((sums["sign"] == size).astype(float)) / words,
            total((sums["sign"] >= 2).astype(float)) / words, total((sums["sign"] >= 3).astype(float)) / words, total((raw[start] >= 65) & (raw[start] <= 90)) / words,
            np.minimum(words, PASSAGE) / PASSAGE, total((LAST[raw[end - 1]] == 1).astype(float)) / words,
        )
        x[:, :STYLE] = np.stack(style, axis=1)
        case = np.where(capital, 2, (sums["upper"] > 0).astype(np.int64))
        length = np.digitize(size, (3, 6, 10))
        shape = (case * 4 + LAST[raw[end - 1]]) * 4 + length
        x[:, STYLE : STYLE + SHAPES] = np.bincount(passage * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / words[:, None] * 2
        bucket = (word % np.uint64(HASHED)).astype(np.int64)
        x[:, STYLE + SHAPES :] = np.bincount(passage * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED) / words[:, None] * 4
        yield a, x, per


class Model:
    """Encoder, gated attention and classifier, with their gradients."""

    def __init__(self, seed: int = 7, prior: float = 0.5):
        r = np.random.default_rng(seed)
        self.p = {
            "E": r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": r.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "b": np.array(np.log(prior / (1 - prior))),
        }
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)

    def forward(self, x: np.ndarray, per: np.ndarray):
        p, first = self.p, np.cumsum(per) - per
        h = np.tanh((x - self.mean) * self.scale @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), per))
        a /= np.repeat(np.add.reduceat(a, first), per)
        z = np.add.reduceat(h * a[:, None], first)
        return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def gradients(self, x, per, y):
        p, first = self.p, np.cumsum(per) - per
        h, t, s, a, z, score = self.forward(x, per)
        d = (score - y) / len(y)
        dz = np.repeat(d, per)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, first), per))
        dt, ds = da[:, None] * p["w"] * s * (1 - t * t), da[:, None] * p["w"] * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        scaled = (x - self.mean) * self.scale
        return {"E": scaled.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (da[:, None] * t * s).sum(axis=0), "c": z.T @ d, "b": d.sum()}

    def train(self, x: np.ndarray, per: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7):
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.05)
        first, r, step = np.cumsum(per) - per, np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        steps = max(1, epochs * -(-len(per) // batch))
        for _ in range(epochs):
            order = r.permutation(len(per))
            for k in range(0, len(order), batch):
                docs = order[k : k + batch]
                rows = np.concatenate([np.arange(first[d], first[d] + per[d]) for d in docs])
                step += 1
                for name, g in self.gradients(x[rows], per[docs], y[docs]).items():
                    g = g + decay * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - rate * (1 - step / steps) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self


def remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """A model of ``quality`` from labelled rows outside the held-out quarter. docs: doc_id, text."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(remainder("doc_id") != 2)
    picked = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = common.materialize(picked, "sample")  # at most `sample` rows
    common.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # Of rows that share an id the one with the least hash of its text is learned from.
    texts = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sized = texts.withColumn("size", F.greatest(F.ceil(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / PASSAGE), F.lit(1)).cast("long"))
    sized = common.materialize(sized, "sample-texts")  # at most `sample` rows
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept = sized.where(F.col("size") * 8 <= passages).select("doc_id", "size").withColumn("upto", upto).where(F.col("upto") <= passages)
    texts = sized.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text", "quality")

    def run(batches):
        for batch in batches:
            for a, x, per in bags(batch.column(1)):
                cut = np.cumsum(per)
                rows = [x[i:j].tobytes() for i, j in zip((cut - per).tolist(), cut.tolist())]
                part = batch.slice(a, len(per))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])

    got = texts.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    y = np.array(got["quality"].to_pylist(), dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(prior=float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5)
    found = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"].to_pylist()]
    return Model(prior=float(y.mean())).train(np.concatenate(found), np.array([len(f) for f in found]), y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, attention = the largest weight and its passage) of every row. docs: doc_id, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    common.small_batches(docs.sparkSession)

    def run(batches):
        known = shared.value
        for batch in batches:
            for a, x, per in bags(batch.column(1)):
                *_, weight, _, found = known.forward(x, per)
                first = np.cumsum(per) - per
                top = np.maximum.reduceat(weight, first)
                at = np.flatnonzero(weight == np.repeat(top, per))
                at = at[np.searchsorted(at, first)] - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(per)), pa.array(found), pa.array(top), pa.array(at)], names=["doc_id", "score", "top_weight", "top_passage"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, top_weight double, top_passage long")


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by a model of labels outside the held-out quarter."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder("doc_id") == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "top_weight", "top_passage")
