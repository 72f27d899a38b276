"""Audio features of texts kept as 8-bit samples.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the samples of
a mono 8-bit PCM WAV file at 16 kHz, which is stored losslessly. Features come
from the stored bytes alone:

* resampling to 10 kHz by 5/8 with a polyphase filter: one short filter per
  phase, with integer taps, so sums are exact in any order;
* log-mel filterbanks of overlapped Hann frames (256 samples, hop 128), in half
  decibels as 0 to 255;
* speech-like segments by hysteresis: a segment starts where a frame's energy
  exceeds its file's median by ``ON_DB`` and lasts until it falls below the median.

The filterbanks are cut into tensors of ``FRAMES`` x ``MELS`` bytes (the last one
zero-padded) with the time span each covers. A task stores those of its files as an
Arrow fixed-shape tensor column, a row per tensor, in Parquet shards of about
``SHARD_BYTES``; what it returns names a file's shard, row group and rows, and only
shards of committed attempts are named. ``features`` reads the tensors back.
Spectra are worked out in blocks; a file's samples are held as 8-byte floats, before
and after resampling, so a task takes some 30 bytes for each byte of its longest text.

Defined cases: null and empty texts are 64 zero bytes; the last frame is filled up
with zeros, so every sample lies in one and the last span may end after the file; equal texts give equal values; repeated rows are kept; null
ids stay null; very long texts are read whole; an empty table gives no rows; further
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan

UNIT = 64
RATE, UP, DOWN = 16_000, 5, 8
TAPS = 16  # per phase
FRAME, HOP, MELS, FRAMES = 256, 128, 32, 64
ON_DB = 1.0
BLOCK = 1 << 17
NEW_RATE = RATE * UP // DOWN
SHARD_BYTES = 64 << 20
#: Files whose tensors make up a row group.
GROUP = 200
TENSOR = pa.fixed_shape_tensor(pa.uint8(), (FRAMES, MELS))

MEDIA = "doc_id {kind}, n_bytes long, media binary"
DESCRIBED = "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long"
SEGMENTS = "segments array<struct<start_ms: double, end_ms: double>>"
PLACE = "shard string, row_group int, first int, n_tensors int"
TENSORS = "tensors array<struct<start_ms: double, end_ms: double, mel: binary>>"
_SEGMENTS = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))


def padded(data: bytes) -> bytes:
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def to_wav(samples: bytes) -> bytes:
    form = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def _filters() -> np.ndarray:
    """Integer taps by phase: a windowed sinc at the lower rate's limit, split into UP phases."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / DOWN) * np.hamming(n)
    phases = taps.reshape(TAPS, UP).T
    return np.rint(phases / phases.sum(axis=1, keepdims=True) * 4096).astype(np.float64)[:, ::-1]


def _mel_bank() -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(60), to_mel(NEW_RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / NEW_RATE)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


FILTERS, BANK, WINDOW = _filters(), _mel_bank(), np.hanning(FRAME)


def resample(x: np.ndarray) -> np.ndarray:
    """x at RATE -> at NEW_RATE; block by block, with the same values as in one go."""
    n_out = -(-len(x) * UP // DOWN)
    out = np.empty(n_out)
    x = np.concatenate((np.zeros(TAPS // 2), x, np.zeros(TAPS)))
    view = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    for phase in range(UP):
        # Output k reads input k * DOWN / UP; outputs of one phase are DOWN inputs apart.
        first = next(k for k in range(UP) if k * DOWN % UP == phase)
        count = len(range(first, n_out, UP))
        for a in range(0, count, BLOCK // DOWN):
            b = min(count, a + BLOCK // DOWN)
            start = first * DOWN // UP
            out[first + a * UP : first + b * UP : UP][: b - a] = view[start + a * DOWN : start + b * DOWN : DOWN][: b - a] @ FILTERS[phase]
    return out / 4096


def analyse(samples: bytes):
    """(log-mel rows as bytes, segments as (first frame, last frame + 1))."""
    x = resample(np.frombuffer(samples, np.uint8) - 128.0)
    x = np.pad(x, (0, FRAME + max(0, -(-(len(x) - FRAME) // HOP)) * HOP - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = np.empty((len(frames), MELS), np.uint8), np.empty(len(frames))
    for a in range(0, len(frames), 512):
        power = np.abs(np.fft.rfft(frames[a : a + 512] * WINDOW)) ** 2
        mel[a : a + 512] = np.clip(np.rint(20 * np.log10(power @ BANK + 1.0)), 0, 255)
        energy[a : a + 512] = 10 * np.log10(power.sum(axis=1) + 1.0)
    energy = np.rint(energy * 100) / 100
    rest = float(np.median(energy))
    return mel, hysteresis(energy, rest + ON_DB, rest)


def hysteresis(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs that start above ``high`` and last until below ``low``."""
    event = np.where(energy > high, 1, np.where(energy < low, -1, 0))
    at = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (at >= 0) & (event[np.maximum(at, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def milliseconds(frame: int) -> float:
    return round(frame * HOP * 1000 / NEW_RATE, 3)


def describe(media: bytes) -> tuple:
    """What a stored file gives: sizes, digests, number of frames, segments, tensors as (start_ms, end_ms, array)."""
    samples = from_wav(media)
    mel, segments = analyse(samples)
    tensors = []
    for a in range(0, len(mel), FRAMES):
        part = mel[a : a + FRAMES]
        end = milliseconds(a + len(part) - 1) + FRAME * 1000 / NEW_RATE
        tensors.append((milliseconds(a), round(end, 3), np.pad(part, ((0, FRAMES - len(part)), (0, 0)))))
    spans = [{"start_ms": milliseconds(a), "end_ms": round(milliseconds(b - 1) + FRAME * 1000 / NEW_RATE, 3)} for a, b in segments]
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), spans, tensors


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a WAV file in a column below path; returns what is stored."""
    spark = docs.sparkSession
    common.small_batches(spark)
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = textscan.buffers(batch.column(1))
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    schema = MEDIA.format(kind=picked.schema["doc_id"].dataType.simpleString())
    picked.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


class Shards:
    """Parquet files of tensors, written by one task."""

    def __init__(self, path: str, id_type: pa.DataType):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(path)
        self.schema = pa.schema([("doc_id", id_type), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("mel", TENSOR)])
        self.out, self.name, self.groups, self.size = None, "", 0, 0

    def write(self, ids: pa.Array, found: list[list[tuple]]) -> list[tuple[str, int, int, int]]:
        """One row group; the place of each file's tensors: shard, row group, first row, rows."""
        import pyarrow.parquet as pq

        if self.out is None or self.size > SHARD_BYTES:
            self.close()
            self.store.create_dir(self.root, recursive=True)
            self.name, self.groups, self.size = f"tensors-{uuid.uuid4().hex}.parquet", 0, 0
            self.stream = self.store.open_output_stream(f"{self.root}/{self.name}")
            self.out = pq.ParquetWriter(self.stream, self.schema, compression="zstd")
        many = np.array([len(x) for x in found])
        flat = [t for x in found for t in x]
        mel = pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack([t[2] for t in flat]))
        owner = pa.array(np.repeat(np.arange(len(many)), many))
        rows = pa.table([ids.take(owner), pa.array([t[0] for t in flat]), pa.array([t[1] for t in flat]), mel], schema=self.schema)
        self.out.write_table(rows, row_group_size=len(flat))
        self.size += len(flat) * FRAMES * MELS
        self.groups += 1
        return [(self.name, self.groups - 1, int(a), int(n)) for a, n in zip(np.cumsum(many) - many, many)]

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.stream.close()
            self.out = None


def write_tensors(media: DataFrame, path: str) -> DataFrame:
    """Store the tensors of every file below path; per file sizes, digests, segments and where its tensors are, written."""
    common.small_batches(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "segments", "shard", "row_group", "first", "n_tensors"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _SEGMENTS)

    def run(batches):
        shards = None
        try:
            for batch in batches:
                shards = shards or Shards(f"{path}/tensors", batch.schema.field(0).type)
                for a in range(0, batch.num_rows, GROUP):
                    part = batch.slice(a, GROUP)
                    *found, tensors = zip(*(describe(m.as_buffer().to_pybytes()) for m in part.column(2)))
                    place = zip(*shards.write(part.column(0), tensors))
                    columns = [pa.array(c, k) for c, k in zip(found, kinds)] + [pa.array(c, k) for c, k in zip(place, (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)
        finally:
            if shards:
                shards.close()

    kind = media.schema["doc_id"].dataType.simpleString()
    return common.materialize(media.mapInArrow(run, f"{DESCRIBED.format(kind=kind)}, {SEGMENTS}, {PLACE}"), "audio-index")


def read_tensors(index: DataFrame, path: str) -> DataFrame:
    """index with the tensors of each file, read from the shards it names."""
    common.small_batches(index.sparkSession)
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(f"{path}/tensors")
        for batch in batches:
            shard, group, first, many = (batch.column(i).to_pylist() for i in range(9, 13))
            i = 0
            while i < batch.num_rows:
                j = i + 1  # the files of one row group, which mostly stand together
                while j < batch.num_rows and (shard[j], group[j]) == (shard[i], group[i]):
                    j += 1
                with store.open_input_file(f"{root}/{shard[i]}") as f:
                    rows = pq.ParquetFile(f).read_row_group(group[i], columns=["start_ms", "end_ms", "mel"]).combine_chunks()
                mel = rows["mel"].chunk(0)
                if mel.type != TENSOR:
                    raise ValueError("a shard without a tensor column")
                take = np.concatenate([np.arange(a, a + n) for a, n in zip(first[i:j], many[i:j])])
                data = mel.to_numpy_ndarray().reshape(len(rows), -1)[take]
                bytes_ = pa.Array.from_buffers(pa.binary(FRAMES * MELS), len(take), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())
                at = pa.array(take)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many[i:j])], pa.int32()), pa.StructArray.from_arrays([rows["start_ms"].chunk(0).take(at), rows["end_ms"].chunk(0).take(at), bytes_], names=["start_ms", "end_ms", "mel"]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(9)), lists], names=[*part.schema.names[:9], "tensors"])
                i = j

    return index.mapInArrow(run, f"{DESCRIBED.format(kind=kind)}, {SEGMENTS}, {TENSORS}")


def features(media: DataFrame, path: str | None = None) -> DataFrame:
    """Per stored file: sizes, digests, segments, and its tensors with time spans as read back from below path."""
    path = path or common.shared_path(media.sparkSession, "audio")
    return read_tensors(write_tensors(media, path), path)


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, stored and read back."""
    path = common.shared_path(spark, "audio")
    found = features(write_media(common.table(spark, sf_dir, "documents"), f"{path}/media"), path)
    mels = F.md5(F.array_join(F.transform("tensors", lambda t: F.md5(t["mel"])), ""))
    feature = F.concat_ws(":", F.col("n_frames").cast("string"), F.size("segments").cast("string"), mels)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.size("segments").alias("n_segments"))
