"""The ten operators on small fixtures: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm.common")

from plumbline.llm import audio, decontaminate, jaccard, language, line_dedup, mixing, quality, textscan, token_counts, token_records, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_ string, h long"


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def messy(spark, texts):
    """Documents with nulls, and extra columns whose names clash with those used inside."""
    rows = [(i, t, "en" if i % 3 else None, "s0" if i % 2 else None, None, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", " ", "\n\n", "a", "A b", "the same text twice here now", "the same text twice here now", "é ü ß 日本", "x" * 20_000, "word " * 5_000, "  two  spaces ", "<|endoftext|> <s>", "\x00nul"]


@pytest.fixture(scope="module")
def edge(spark):
    return messy(spark, EDGE)


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("doc_id < 0")


# 1 ---------------------------------------------------------------------------
def test_archive_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3, "<p>a</p>", "x" * 50_000]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i}\r\nX: y", t, 7) for i, t in enumerate(html)] + [(None, "u", "<p>a</p>", 7)], "page_id long, url string, html string, key long")
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path)
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    import base64

    for i, t in enumerate(html):
        data = (t or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        last = max(k for k, x in enumerate(html) if (x or "") == (t or ""))
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if last == i else ("revisit", last))
    assert got[None]["refers_to"] == 5
    assert spark.read.parquet(f"{path}/payloads").count() == len({x or "" for x in html})
    records = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, path).collect()}
    assert records[4].endswith(b"\r\n\r\n" + "ééé".encode() + b"\r\n\r\n") and b"\r\nX: y" not in records[3]
    assert int(re.search(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", records[6])[1]) == len(records[6].split(b"\r\n\r\n", 1)[1]) - 4


def test_archive_notices_damage(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    warc.write_archive(spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"), path)
    rows = spark.read.parquet(f"{path}/payloads").collect()
    spark.createDataFrame([(r["key"], b"bad!") for r in rows], "key binary, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, path).collect()
    for number, (old, new) in enumerate([("Content-Length: 4\r\n\r\n", "Content-Length: 5\r\n\r\n"), ("sha1:", "sha1:A")]):
        other = f"file://{tmp_path}/b{number}"
        warc.write_archive(spark.createDataFrame([(1, "u", "good"), (2, "u", "good")], "page_id long, url string, html string"), other)
        rows = spark.read.parquet(f"{other}/headers").collect()
        changed = [(bytes(r["key"]), r["has_payload"], bytes(r["header"]).replace(old.encode(), new.encode())) for r in rows]
        spark.createDataFrame(changed, "key binary, has_payload boolean, header binary").write.mode("overwrite").parquet(f"{other}/headers")
        with pytest.raises(Exception, match="differs from its header"):
            warc.read_archive(spark, other).collect()


def test_a_hot_key_is_split_when_keys_are_written(spark):
    """Beyond what is broadcast, adaptive execution splits the tasks of a hot key on the side that has it."""
    from plumbline.llm import common

    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in low}
    rows = spark.range(0, 40_000, 1, 8).selectExpr("CASE WHEN id % 3 > 0 THEN 7 ELSE id END AS k", "id AS x")
    keys = common.materialize(rows.groupBy("k").agg(F.max("x").alias("top")), "keys")
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        for how in ("inner", "left_semi"):
            joined = common.join_by_keys(rows, keys, "k", how, limit=0)
            assert joined.count() == 40_000
            joined.write.format("noop").mode("overwrite").save()
            done = joined.agg(F.sum("x"))
            done.collect()
            assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
        assert common.join_by_keys(rows, keys, "k", "inner")._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archive_min_bytes_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/c", min_bytes=4)
    assert {r["page_id"]: r["record_type"] for r in warc.read_archive(spark, f"file://{tmp_path}/c").collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    warc.write_archive(pages.where("page_id < 0"), f"file://{tmp_path}/d")
    assert warc.read_archive(spark, f"file://{tmp_path}/d").count() == 0


# 2 ---------------------------------------------------------------------------
def test_token_records(spark, edge, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_records.TOKENIZER))
    rng = random.Random(3)
    extra = messy(spark, [words(rng, 50) + rng.choice(["\n \n", "  x", ", y's"]) for _ in range(60)]).selectExpr("doc_id + 100 AS doc_id", "text")
    docs = edge.select("doc_id", "text").union(extra)
    got = {r["doc_id"]: r for r in token_records.encode_and_read_back(docs).collect()}
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"]) == (at, len(ids))
        assert got[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_records.encode_and_read_back(none).count() == 0


@pytest.mark.parametrize("cache", [100, 100_000])
def test_token_ids_match_the_library(cache):
    import public_tokenizers
    from tokenizers import Tokenizer

    f = public_tokenizers.path(token_records.TOKENIZER)
    t, rng = Tokenizer.from_file(f), random.Random(21)
    signs = ["a", "Bc", "the", "é", "日", "9", "42", ".", ",", "'s", "!?", "$$", " ", " ", " ", "\n", "\n", "\t", "\r", "\u00a0", "\u3000", "\u2028", "\x1c", "\x00", "🙂", "<|endoftext|>", "—"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(4000)] + [t or "" for t in EDGE] + [" ".join(f"w{i}x" for i in range(3000))]
    enc = token_records.Encoder(f, cache)
    got = [ids for a in range(0, len(texts), 300) for ids in enc.encode(pa.array(texts[a : a + 300]))]
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, enc.kind).tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert list(enc.encode(pa.array([None, ""]))) == [b"", b""] and list(enc.encode(pa.array([], pa.string()))) == []


def test_token_records_extra_columns_and_shuffled_index(spark, edge, tmp_path):
    import public_tokenizers

    path = f"file://{tmp_path}/r"
    docs = edge.withColumnsRenamed({"lang": "tie", "source": "place", "text_": "by0", "h": "shard"})
    index = token_records.write_records(docs, path, public_tokenizers.path(token_records.TOKENIZER), shard_bytes=2000)
    assert index.select("shard").distinct().count() > 1
    whole = {r["doc_id"]: (r["before"], bytes(r["ids"])) for r in token_records.read_records(index, path).collect()}
    mixed = token_records.read_records(index.orderBy(F.rand(3)), path).collect()
    assert len(mixed) == len(EDGE) and {r["doc_id"]: (r["before"], bytes(r["ids"])) for r in mixed} == whole


def test_token_records_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "x"), (5, "y z"), (5, "x")], "doc_id long, text string")
    got = token_records.encode_and_read_back(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 5, 5, 5] and [r["start"] for r in got] == list(np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]))


def test_frames():
    data = token_records.frame(b"abc") + token_records.frame(b"")
    payload, at = token_records.unframe(data)
    assert bytes(payload) == b"abc" and bytes(token_records.unframe(data, at)[0]) == b""
    assert token_records.unmasked(token_records.masked_crc(b"abc")) == zlib.crc32(b"abc")
    assert struct.unpack("<Q", data[:8])[0] == 3
    for i in range(len(data)):
        with pytest.raises(ValueError):
            broken = bytearray(data)
            broken[i] ^= 1
            token_records.unframe(broken, token_records.unframe(broken)[1])


# 3 ---------------------------------------------------------------------------
def test_token_counts_match_the_library(spark, edge, none):
    import public_tokenizers
    import sentencepiece

    f = public_tokenizers.path(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=f)
    rng = random.Random(1)
    letters = "abte ▁\n\tñ梦🙂\x00<s> 　é0."
    texts = [t or "" for t in EDGE] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [" " * 3000, "the" * 300]
    assert token_counts.counter(f).count(texts) == [len(x) for x in sp.encode(texts, num_threads=1)]
    long = ["".join(rng.choice(x) for _ in range(n)) for x in ("ab", "aab", "the", "aeiourstn", letters.replace(" ", "").replace("▁", ""), "0123456789abcdef", "梦日本語a") for n in (193, 700, 5000)]
    assert token_counts.counter(f).count(long) == [len(x) for x in sp.encode(long, num_threads=1)]
    whole = token_counts.Merger(f)
    short = ["".join(rng.choice(x) for _ in range(rng.randrange(1, 40))) for x in ("ab", "the ", letters) for _ in range(200)]
    assert whole.count_long(short).tolist() == whole.count_short(short).tolist()
    small = token_counts.Counter(token_counts.Prefixed(f), cache=50)
    assert [n for i in range(0, 600, 20) for n in small.count(texts[i : i + 20])] == [len(x) for x in sp.encode(texts[:600], num_threads=1)]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(edge, f).collect()}
    assert [got[i]["n_tokens"] for i in range(len(EDGE))] == [len(x) for x in sp.encode([t or "" for t in EDGE], num_threads=1)]
    assert [got[i]["n_bytes"] for i in range(len(EDGE))] == [len((t or "").encode()) for t in EDGE]
    assert token_counts.count_tokens(none, f).count() == 0


# 4 ---------------------------------------------------------------------------
def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, per, y = rng.normal(size=(9, quality.WIDTH)).astype(np.float64), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    m = quality.Model(seed=1)
    m.p["c"] = rng.normal(size=quality.HIDDEN)

    def loss():
        s = m.forward(x, per)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in m.gradients(x, per, y).items():
        p = m.p[name].reshape(-1) if m.p[name].ndim else m.p[name].reshape(1)
        old = p[0]
        p[0] = old + 1e-6
        up = loss()
        p[0] = old - 1e-6
        down = loss()
        p[0] = old
        assert abs((up - down) / 2e-6 - np.asarray(g).reshape(-1)[0]) < 1e-6


def test_quality_learns(spark, edge, none):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        t = words(rng, rng.randrange(20, 200))
        texts.append(t if good else " ".join(w + "***" for w in t.split()))
        labels.append((i, int(good), 0))
    docs, marks = messy(spark, texts).select("doc_id", "text"), spark.createDataFrame(labels + [(9999, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in held]) > 0.95
    scores = {r["doc_id"]: r["score"] for r in quality.score(edge.select("doc_id", "text"), model).collect()}
    assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores.values()) and scores[6] == scores[7] and scores[0] == scores[1]
    assert quality.score(none.select("doc_id", "text"), model).count() == 0
    assert quality.fit(docs, marks.where("quality = 1")).forward(np.zeros((1, quality.WIDTH)), np.array([1]))[-1][0] > 0.9


def brute_score(text, model):
    """The score of a text, passage by passage and number by number."""
    raw = (text or "").encode()
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    bags = [found[a : a + quality.PASSAGE] for a in range(0, len(found), quality.PASSAGE)] or [[]]
    upper = lambda w: sum(65 <= c < 91 for c in w)
    letter = lambda w: sum(65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in w)
    digit = lambda w: sum(48 <= c < 58 for c in w)
    sign = lambda w: sum(33 <= c < 127 for c in w) - sum(33 <= c < 127 and (chr(c).isalnum()) for c in w)
    ending = lambda w: 1 if w[-1] in b",.:;" else 2 if w[-1] in b"!?" else 3 if sign(w[-1:]) else 0
    hashed = textscan.word_hashes(*(lambda s, e, d, f: (f, s, e))(*textscan.words(*textscan.buffers(pa.array([text], pa.string())), textscan.SPACED)))
    rows, at = [], 0
    for bag in bags:
        w = [m[0] for m in bag]
        n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
        h = hashed[at : at + len(w)].tolist()
        before = hashed[at - 1 : at].tolist() if at else []
        x = np.zeros(quality.WIDTH)
        shout = [upper(v) >= 2 and upper(v) * 10 >= letter(v) * 6 for v in w]
        mean = sum(map(len, w)) / n
        low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), v) for v in w]
        x[:14] = [
            mean / 8, max(sum(len(v) ** 2 for v in w) / n - mean**2, 0) ** 0.5 / 4, sum(map(upper, w)) / chars, sum(shout) / n, sum(map(sign, w)) / chars * 4, sum(map(digit, w)) / chars,
            sum(a == b for a, b in zip(before + h, h[1 - len(before) :] if not before else h)) / n, len(set(low)) / n, sum(sign(v) == len(v) for v in w) / n, sum(sign(v) >= 2 for v in w) / n, sum(sign(v) >= 3 for v in w) / n,
            sum(65 <= v[0] < 91 for v in w) / n, min(n, quality.PASSAGE) / quality.PASSAGE, sum(ending(v) == 1 for v in w) / n,
        ]
        for v, s, k in zip(w, shout, h):
            case = 2 if s else 1 if upper(v) else 0
            x[14 + (case * 4 + ending(v)) * 4 + sum(len(v) >= b for b in (3, 6, 10))] += 2 / n
            x[14 + 48 + k % 96] += 4 / n
        rows.append(x)
        at += len(w)
    p = model.p
    h = [np.tanh([sum((x[i] - model.mean[i]) * model.scale[i] * p["E"][i][j] for i in range(quality.WIDTH)) + p["e"][j] for j in range(quality.HIDDEN)]) for x in rows]
    gate = [sum(p["w"][g] * np.tanh(v @ p["V"][:, g]) / (1 + np.exp(-(v @ p["U"][:, g]))) for g in range(quality.GATE)) for v in h]
    weight = np.exp(np.array(gate)) / np.exp(gate).sum()
    z = sum(a * v for a, v in zip(weight, h))
    return 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))


def test_quality_scores_against_brute_force(spark):
    rng = random.Random(22)
    kinds = ["Word", "w,", "SHOUT", "***", "a1b2", "é", "end.", "why?", "w", "...", "lönger-words", "same same"]
    texts = [None, "", " \n"] + [" ".join(rng.choice(kinds) for _ in range(n)) for n in (1, 5, 63, 64, 65, 300)]
    model = quality.Model(seed=3)
    model.p["c"] = np.random.default_rng(3).normal(size=quality.HIDDEN)
    model.mean, model.scale = np.full(quality.WIDTH, 0.1, np.float32), np.full(quality.WIDTH, 2.0, np.float32)
    got = {r["doc_id"]: r["score"] for r in quality.score(messy(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - brute_score(t, model)) < 1e-4, t


def test_quality_of_clashing_and_repeated_rows(spark):
    rng = random.Random(23)
    rows = [(i, words(rng, 30) if i % 2 else "*** " * 30, 5, "x") for i in range(80)] + [(7, words(rng, 30 + k), 5, "y") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, size string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    assert quality.score(docs, model).count() == 130
    few = quality.fit(docs, marks, passages=20)
    assert few.forward(np.zeros((1, quality.WIDTH)), np.array([1]))[-1].shape == (1,)


# 5 ---------------------------------------------------------------------------
def test_audio_round_trip(spark, edge, none, tmp_path):
    media = audio.write_media(edge, f"file://{tmp_path}/m")
    found = audio.features(media, f"file://{tmp_path}/t")
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(EDGE):
        data = (t or "").encode()
        full = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert got[i]["tail_crc32"] == zlib.crc32(full[-64:])
        assert all(len(x["mel"]) == audio.FRAMES * audio.MELS and x["end_ms"] > x["start_ms"] for x in got[i]["tensors"])
    assert got[6]["tensors"] == got[7]["tensors"] and got[0]["tensors"] == got[1]["tensors"]
    import pyarrow.parquet as pq

    stored = pa.concat_tables([pq.read_table(f) for f in (tmp_path / "t" / "tensors").iterdir()])
    assert stored["mel"].type == pa.fixed_shape_tensor(pa.uint8(), (audio.FRAMES, audio.MELS)) and len(stored) == sum(len(r["tensors"]) for r in got.values())
    for i, t in enumerate(EDGE):
        data = (t or "").encode()
        *_, tensors = audio.describe(audio.to_wav(audio.padded(data)))
        assert [(x["start_ms"], x["end_ms"], bytes(x["mel"])) for x in got[i]["tensors"]] == [(a, b, m.tobytes()) for a, b, m in tensors]
    assert audio.features(audio.write_media(none, f"file://{tmp_path}/n")).count() == 0


def test_resample_and_hysteresis():
    rng = np.random.default_rng(0)
    for n in (64, 640, 70_000):
        x = rng.integers(0, 256, n) - 128.0
        padded = np.concatenate((np.zeros(audio.TAPS // 2), x, np.zeros(audio.TAPS)))
        direct = [padded[k * 8 // 5 : k * 8 // 5 + audio.TAPS] @ audio.FILTERS[k * 8 % 5] for k in range(-(-n * 5 // 8))]
        assert np.array_equal(audio.resample(x), np.array(direct) / 4096)
    tone = audio.resample(np.sin(2 * np.pi * 440 * np.arange(16000) / 16000) * 100)
    assert np.argmax(np.abs(np.fft.rfft(tone))) * audio.NEW_RATE / len(tone) == 440
    assert audio.hysteresis(np.array([0, 5, 3, 3, 0, 3, 5, 1.0]), 4, 2) == [(1, 4), (6, 7)]


# 6 ---------------------------------------------------------------------------
def test_mixing(spark, edge, none):
    n = 4000
    docs = spark.createDataFrame([(i, "t", "big" if i % 4 else "small", 1) for i in range(n)], "doc_id long, text string, source string, copy long")
    got = mixing.mix(docs, weights={"big": 0.5, "small": 0.5}, target_rows=n).groupBy("source").count().collect()
    assert all(abs(r["count"] - n / 2) < 5 * (n / 2) ** 0.5 for r in got) and len(got) == 2
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))
    high = mixing.mix(docs.limit(50), weights={"big": 1, "small": 1}, target_rows=50 * 800).count()
    assert abs(high - 40_000) < 1500
    assert {r["source"] for r in mixing.mix(docs, weights={"big": 1.0, "small": 0.0}).select("source").distinct().collect()} == {"big"}
    assert mixing.mix(none).count() == 0
    clash = docs.limit(50).selectExpr("doc_id", "source", "'a' AS copy_no", "'b' AS Shuffle_Key")
    mixed = mixing.mix(clash)
    assert mixed.columns == [*clash.columns, "copy_no_", "shuffle_key_"] and {(r["copy_no"], r["Shuffle_Key"]) for r in mixed.select(*clash.columns).collect()} == {("a", "b")}
    assert {r["source"] for r in mixing.mix(edge, target_rows=500).collect()} == {None, "s0"}
    clash = docs.limit(50).selectExpr("doc_id", "source", "'a' AS _pl_source", "'b' AS _PL_cdf", "1 AS _pl_u", "2 AS _pl_n", "3 AS _pl_place", "0 AS rate", "0 AS n")
    assert {tuple(r)[2:9] for r in mixing.mix(clash, target_rows=500).collect()} == {("a", "b", 1, 2, 3, 0, 0)}
    rows = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 900.0), (None, 2.0)], "source string, rate double")
    for r in mixing.distributions(rows).collect():
        rate = {"a": 0.0, "b": 0.3, "c": 900.0, None: 2.0}[r["source"]]
        want = np.cumsum([math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(len(r["cdf"]))]) if rate else [1.0]
        assert np.abs(np.array(r["cdf"]) - want).max() < 1e-9 and abs(r["cdf"][-1] - 1) < 1e-9


# 7 ---------------------------------------------------------------------------
def test_language(spark, edge, none):
    rng = random.Random(2)
    alphabets = {"aa": "abcde ", "bb": "defgh "}
    rows = [(i, "".join(rng.choice(alphabets["aa" if i % 2 else "bb"]) for _ in range(80)), "aa" if i % 2 else "bb", "h") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(language.document_records(docs), model).collect()}
    assert all(got[i]["lang"] == ("aa" if i % 2 else "bb") and got[i]["accepted"] for i in range(200))
    told = spark.createDataFrame([(1, "bb", "x", "new", None), (2, None, None, None, "abcab"), (3, "zz", "x", "h", "1234")], "page_id long, declared string, suffix string, host string, text string")
    found = {r["page_id"]: r for r in language.identify(told, model).collect()}
    assert not found[1]["accepted"] and not found[3]["accepted"] and found[2]["lang"] == "aa" and found[2]["accepted"]
    strange = language.identify(language.document_records(edge), model).collect()
    assert len(strange) == len(EDGE)
    kept = language.keep_accepted(docs.union(spark.createDataFrame([(500, "", "aa", "h"), (501, None, "bb", None), (502, "!!!", "aa", "h")], docs.schema)))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(200))
    assert language.identify(language.document_records(none), model).count() == 0
    assert language.keep_accepted(none).count() == 0
    unnamed = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language.keep_accepted(unnamed).collect()} == {i for i, t in enumerate(EDGE) if any(c.isalpha() for c in t or "")}


def test_language_posterior_against_brute_force(spark):
    rng = random.Random(24)
    rows = [(i, rng.choice([None, "", "12", "abcde abc", "degh fgd", "abdh"]), rng.choice(["aa", "bb", "zz", None]), rng.choice(["h1", "h2", None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    langs, table = language.train(docs.where("lang IN ('aa', 'bb')").union(spark.createDataFrame([(900, "abcde", "cc", "h1")], docs.schema)))
    records = language.document_records(docs).withColumn("suffix", F.expr("CASE WHEN host = 'h1' THEN 's' END"))
    n, post, said, own, names = len(langs), {}, {}, {}, {}
    for i, t, lang, host in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        bucket, _, letters = language.grams(data, np.array([0, len(data)]))
        ll = table[bucket].sum(axis=0).astype(float) * language.TEMPER
        p = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum() if letters[0] else np.zeros(n)
        names[i] = (lang if lang in langs else "other") if lang else ""
        post[i] = ll, p, int(letters[0]), (host or "", "s" if host == "h1" else "")
        said[names[i]] = said.get(names[i], np.zeros(n)) + p
        own[post[i][3]] = own.get(post[i][3], np.zeros(n)) + p
    base = sum(own.values()) + 1
    base /= base.sum()
    smooth = lambda o, up: (o + language.KAPPA * up) / (o.sum() + language.KAPPA)
    by_suffix = {s: smooth(sum(v for (_, x), v in own.items() if x == s), base) for _, s in own}
    by_lang = sum(said.values()) + 0.5 * len(said)
    got = {r["doc_id"]: r for r in language.identify(records, (langs, table)).collect()}
    for i, (ll, p, letters, key) in post.items():
        w = ll + np.log(smooth(np.maximum(own[key] - p, 0), by_suffix[key[1]])) + np.log((said[names[i]] + 0.5) / by_lang)
        q = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        assert abs(got[i]["confidence"] - q.max()) < 1e-6 and q[langs.index(got[i]["lang"])] > q.max() - 1e-9
        assert got[i]["accepted"] == (letters > 0 and got[i]["confidence"] >= language.CONFIDENCE)


def test_language_of_clashing_and_repeated_rows(spark):
    rows = [(1, "abcab cab", "aa", "h", 1)] * 30 + [(1, "ghihg ihg", "bb", "h", 1)] * 30 + [(None, "abc", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _pl_k long").selectExpr("*", "'x' AS _PL_l", "'y' AS id", "'z' AS letters")
    langs, table = language.train(docs)
    of = lambda t: table[language.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]].sum(axis=0)
    assert langs == ["aa", "bb"] and np.argmax(of(b"abcab cab")) == 0 and np.argmax(of(b"ghihg ihg")) == 1
    kept = language.keep_accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 61 and {(r["_PL_l"], r["id"], r["letters"]) for r in kept.collect()} == {("x", "y", "z")}


def test_language_of_pages(spark):
    pages = spark.createDataFrame([(1, "https://u@m.Example.FR:80/x?y", "<HTML dir=ltr LANG='fr-CA'><script>en</script><p>un&amp;deux</p><!-- en -->"), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language.page_records(pages).collect()}
    assert (got[1]["declared"], got[1]["suffix"], got[1]["host"], got[1]["text"].split()) == ("fr", "fr", "m.example.fr", ["un", "deux"])
    assert got[2]["declared"] is None and got[2]["host"] is None


# 8 ---------------------------------------------------------------------------
def test_components_join_in_few_jobs(spark):
    """Long chains, hubs and loops: one task joins what the tasks kept, whatever the chain's length; stars give the same."""
    rng = np.random.default_rng(5)
    chain = rng.permutation(3000).tolist()
    edges = [*zip(chain, chain[1:]), *((5000, 5001 + k) for k in range(500)), (9, 9), (-7, 6000), (6000, 6001), (6001, -7), (6000, 6001)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    want = {x: 0 for x in range(3000)} | {x: 5000 for x in range(5000, 5501)} | {x: -7 for x in (-7, 6000, 6001)}
    tracker, group = spark.sparkContext.statusTracker(), "components"
    spark.sparkContext.setJobGroup(group, group)
    found = jaccard.components(frame).collect()
    spark.sparkContext.setJobGroup("others", "others")
    assert len(found) == len(want) and {r["node"]: r["component"] for r in found} == want
    assert len(tracker.getJobIdsForGroup(group)) <= 8
    assert {r["node"]: r["component"] for r in jaccard.components(frame, together=100).collect()} == want
    assert jaccard.components(frame.where("u = v")).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [512, 8])
def test_jaccard_against_brute_force(spark, edge, none, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(11)
    common = [words(rng, 60) for _ in range(3)]
    texts = list(EDGE)
    for g in range(12):
        base = words(rng, rng.choice([6, 30, 150]), 5000).split()
        for _ in range(rng.choice([1, 2, 9, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(w))
    texts += [words(rng, 80, 9000) + "\n" + rng.choice(common) for _ in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.self_join(messy(spark, texts), hot=4).collect()}
    assert got == brute_components(list(enumerate(texts)))
    if block == 512:
        assert jaccard.self_join(none).count() == 0
        lone = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "q w e r t y"), (9, "q w e r t y")], "doc_id long, text string")
        found = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard.self_join(lone).collect())
        assert found == [("3", 3), ("3", 3), ("9", 3), ("None", None)]
        assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(lone).collect()) == ["3", "None"]


def test_words_do_not_collide_by_structure(spark):
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    assert len(one) == 1024
    found = {r["doc_id"]: r["component_id"] for r in jaccard.self_join(spark.createDataFrame([(1, one), (2, two), (3, "x " + one), (4, "x " + two), (5, one)], "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    a, b = (textscan.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([1024])) for x in (one, two))
    assert a != b and textscan.word_hashes(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])) != textscan.word_hashes(np.frombuffer(b"ba", np.uint8), np.array([0]), np.array([2]))


def test_keep_one_keeps_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "q", 9)], "doc_id long, text string, _pl_id int")
    assert sorted(tuple(r) for r in jaccard.keep_one(docs).collect()) == [(1, "a b c d e f", 7), (3, "q", 9)]


def test_t_occurrence_search():
    rng = random.Random(4)
    base = [rng.sample(range(10_000), 60) for _ in range(6)]
    sets = [np.array(sorted(set(b[: rng.randrange(45, 61)]) | {10_000 + rng.randrange(5) for _ in range(3)})) for b in base for _ in range(15)]
    sets.sort(key=len)
    lists = jaccard.Lists(sets)
    for q in range(len(sets)):
        want = [s for s in range(len(sets)) if s != q and 100 * len(set(sets[q]) & set(sets[s])) >= 80 * len(set(sets[q]) | set(sets[s]))]
        wanted = np.ones(len(sets), bool)
        wanted[q] = False
        assert sorted(lists.search(q, wanted).tolist()) == want


# 9 ---------------------------------------------------------------------------
def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    hit, who = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit |= set(range(i, i + n))
                    who.add(item)
    return len(w), len(hit), sorted(str(x) for x in who if x is not None)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_decontamination_against_brute_force(spark, edge, none, part_bytes):
    rng = random.Random(6)
    items = [(i, words(rng, rng.choice([3, 9, 10, 14, 25]), 2000)) for i in range(12)] + [(20, ""), (21, None), (None, "only null id words here"), (7, "another Text of item seven")]
    texts = list(EDGE) + [words(rng, 30, 2000) + " " + (rng.choice(items)[1] or "").upper() + ".- " + words(rng, 5) for _ in range(40)] + ["only NULL id words here", items[0][1] + " " + items[1][1] + " " + items[0][1]]
    docs, bench = messy(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["_found"] for r in decontaminate.annotate(docs, bench, part_bytes=part_bytes).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute_hits(t, items), t
    clean = {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    kept = decontaminate.drop_documents(docs, bench, part_bytes=part_bytes)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    clash = decontaminate.drop_documents(docs.withColumnRenamed("text_", "_found"), bench, part_bytes=part_bytes)
    assert {(r["doc_id"], r["_found"]) for r in clash.collect()} == {(i, "x") for i in clean}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert all(cut[i] == texts[i] for i in clean) and cut[0] is None and len(cut[len(texts) - 1].split()) == 0
    assert decontaminate.annotate(docs, bench.where("item_id < 0")).where("_found.n_hit > 0").count() == 0
    assert decontaminate.annotate(none, bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.annotate(docs.withColumnRenamed("text_", "_Found"), bench)


def test_decontamination_in_parts(spark):
    rng = random.Random(16)
    pool = [words(rng, 12, 300) for _ in range(30)]
    items = [(f"i{i}", rng.choice(pool) + " " + rng.choice(pool)) for i in range(60)]
    texts = [" ".join(rng.choice(pool) + rng.choice(["", " x"]) for _ in range(rng.randrange(5))) for _ in range(60)] * 2
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "_pl_ta long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(decontaminate.annotate(docs, bench).collect())
    assert whole == sorted(decontaminate.annotate(docs, bench, part_bytes=900).collect())
    assert {r["_pl_ta"]: (r["_found"]["n_words"], r["_found"]["n_hit"], r["_found"]["items"]) for r in whole} == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_windows_of_a_large_part_are_small():
    import pickle

    rng = random.Random(17)
    text = words(rng, 200_000, 50_000)
    windows = decontaminate.Windows([str(i) for i in range(100)], [text[i * len(text) // 100 : (i + 1) * len(text) // 100] for i in range(100)])
    assert len(pickle.dumps(windows)) < decontaminate.BITMAP + 8 * len(text)


# 10 --------------------------------------------------------------------------
def brute_lines(rows, least):
    """{(id, text): removed line numbers}, by direct comparison; order by id is enough where ids are distinct."""
    lines = {i: t.split("\n") for i, t in rows if t is not None}
    first, out = {}, {i: set() for i in lines}

    def window(own, s):
        total = 0
        for e in range(s, len(own)):
            total += own[e].count(" ") + 1
            if total >= least:
                return e + 1
        return None

    for i in sorted(lines):
        own = lines[i]
        for s in range(len(own)):
            e = window(own, s)
            if e is None:
                continue
            key = tuple(own[s:e])
            if key not in first:
                first[key] = (i, s)
                continue
            d, q = first[key]
            a, b, x, y = s, e, q, q + e - s
            while a and x and own[a - 1] == lines[d][x - 1]:
                a, x = a - 1, x - 1
            while b < len(own) and y < len(lines[d]) and own[b] == lines[d][y]:
                b, y = b + 1, y + 1
            out[i] |= set(range(a, b))
    return out


def test_line_dedup_against_brute_force(spark, edge, none):
    rng = random.Random(8)
    pool = [words(rng, rng.choice([1, 2, 4, 9]), 60) for _ in range(12)] + [words(rng, 14), words(rng, 3) + " x"]
    texts = [t if t is not None and len(t) < 1000 else t for t in EDGE] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    want = brute_lines(list(enumerate(texts)), 10)
    got = {r["doc_id"]: r for r in line_dedup.dedup(messy(spark, texts), words=10).collect()}
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        assert got[i]["n_lines"] == len(lines)
        assert got[i]["n_removed"] == len(want.get(i, ())), i
        assert got[i]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in want[i]))
    assert line_dedup.dedup(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in line_dedup.dedup(twice, words=3).collect()) == [("1", ""), ("1", ""), ("None", "None"), ("None", "a b c")]


def test_line_passages_of_over_fifty_words(spark):
    rng = random.Random(9)
    passage = words(rng, 51)
    docs = spark.createDataFrame([(i, f"{words(rng, 20)}\n{passage}\n{words(rng, 30)}") for i in range(6)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(docs).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 6)}}


def brute_runs(rows, least):
    """As brute_lines, with lines weighed by their runs of anything but white space."""
    lines = {i: t.split("\n") for i, t in rows}
    first, out = {}, {i: set() for i in lines}
    for i in sorted(lines):
        own = lines[i]
        for s in range(len(own)):
            ends = [e for e in range(s + 1, len(own) + 1) if sum(len(x.split()) for x in own[s:e]) >= least]
            if not ends:
                continue
            d, q = first.setdefault(tuple(own[s : ends[0]]), (i, s))
            if (d, q) == (i, s):
                continue
            b = ends[0]
            while b < len(own) and q + b - s < len(lines[d]) and own[b] == lines[d][q + b - s]:
                b += 1
            out[i] |= set(range(s, b))
    return out


def test_line_windows_hold_words_not_spaces(spark):
    rng = random.Random(10)
    tabbed = words(rng, 60).replace(" ", "\t")
    spaced = "\n\n \n".join(words(rng, 1) for _ in range(50))
    texts = [words(rng, 20) + "\n" + "\n".join(x) + "\n" + words(rng, 20) for x in ([" " * 24 + "}"] * 2, [" " * 49], [""] * 50) for _ in range(2)]
    texts += [f"{words(rng, 9)}\n{tabbed}\n{words(rng, 9)}" for _ in range(2)] + [f"{words(rng, 9)}\n{spaced}\n{words(rng, 9)}" for _ in range(2)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(messy(spark, texts)).collect()}
    assert all(got[i]["text"] == texts[i] for i in (0, 1, 2, 3, 4, 5, 6, 8))
    assert got[7]["n_removed"] == 1 and got[9]["n_removed"] == 148
    pool = ["", "", " ", "\t", "    }", "\r"] + [words(rng, rng.choice([1, 2, 4, 9]), 60).replace(" ", rng.choice([" ", "\t", "   "])) for _ in range(7)] + [words(rng, 14)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    block = "\n".join(rng.choice(pool) for _ in range(40))
    texts += [words(rng, 2) + "\n" * rng.randrange(30) + block + "\n" + words(rng, 2) for _ in range(8)]
    want = brute_runs(list(enumerate(texts)), 10)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(messy(spark, texts), words=10).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in enumerate(texts)}


def test_language_model_has_every_language(spark, monkeypatch):
    rng = random.Random(13)
    kinds = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(230)}
    rows = [(2 * k + i, " ".join(rng.choice(v) for _ in range(30)), lang, "h") for k, (lang, v) in enumerate(kinds.items()) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    assert model[0] == sorted(kinds)
    records = language.document_records(docs).withColumn("declared", F.when(F.col("doc_id") % 2 == 0, F.col("declared")))
    whole = {r["doc_id"]: r for r in language.identify(records, model).collect()}
    assert all(whole[r[0]]["lang"] == r[2] and whole[r[0]]["accepted"] for r in rows)
    monkeypatch.setattr(language, "BLOCK", 100)
    again = {r["doc_id"]: r for r in language.identify(records, model).collect()}
    assert all(again[i]["lang"] == r["lang"] and abs(again[i]["confidence"] - r["confidence"]) < 1e-9 for i, r in whole.items())


def test_audio_frames_cover_the_end():
    rng = random.Random(14)
    for n in range(64, 3000, 64):
        data = rng.randbytes(n)
        other = data[:-48] + rng.randbytes(48)
        one, two = audio.describe(audio.to_wav(data)), audio.describe(audio.to_wav(other))
        samples = -(-n * 5 // 8)
        one, two = ([*x[:6], [(a, b, m.tobytes()) for a, b, m in x[7]]] for x in (one, two))
        assert one[5] == two[5] and (one[5] - 1) * audio.HOP + audio.FRAME >= samples > (one[5] - 2) * audio.HOP + audio.FRAME * (one[5] > 1)
        assert one[6] != two[6] and one[6][-1][1] >= round(samples * 1000 / audio.NEW_RATE, 3)


def test_log_mel_and_segments_against_direct_sums():
    """Filterbanks, energies and segments by the definitions, without FFTs or strides."""
    rng = random.Random(18)
    data = b"".join(bytes(rng.randrange(120, 136) for _ in range(256)) if k % 5 else rng.randbytes(256) for k in range(12))
    x = audio.resample(np.frombuffer(data, np.uint8) - 128.0).tolist()
    n, hop, rate = audio.FRAME, audio.HOP, audio.NEW_RATE
    many = 1 + max(0, -(-(len(x) - n) // hop))
    x += [0.0] * ((many - 1) * hop + n - len(x))
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    low, high = to_mel(60), to_mel(rate / 2)
    edge = [700 * (10 ** ((low + (high - low) * i / (audio.MELS + 1)) / 2595) - 1) for i in range(audio.MELS + 2)]
    angles = -2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n
    mels, energy = [], []
    for k in range(many):
        frame = np.array([x[k * hop + i] * (0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1))) for i in range(n)])
        power = np.abs(np.exp(angles) @ frame) ** 2
        row = []
        for b in range(audio.MELS):
            total = 0.0
            for i, p in enumerate(power):
                f = i * rate / n
                total += p * max(0.0, min((f - edge[b]) / (edge[b + 1] - edge[b]), (edge[b + 2] - f) / (edge[b + 2] - edge[b + 1])))
            row.append(20 * np.log10(total + 1))
        mels.append(row)
        energy.append(round(10 * np.log10(power.sum() + 1), 2))
    got, segments = audio.analyse(data)
    assert got.shape == (many, audio.MELS) and np.abs(got - np.clip(mels, 0, 255)).max() <= 0.501
    rest, on, spans = float(np.median(energy)), None, []
    for k, e in enumerate([*energy, -1.0]):
        if on is None and e > rest + audio.ON_DB:
            on = k
        elif on is not None and e < rest:
            spans.append((on, k))
            on = None
    assert segments == spans and len(spans) > 1
