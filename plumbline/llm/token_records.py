"""Token ids as length-delimited binary records with a separate offset index.

Documents are range-partitioned and sorted by id, or by other columns, or left in
the order they come in (the pipeline's, which is shuffled); each task encodes its texts and
appends one frame per document to shard files of about ``SHARD_BYTES``::

    u64 length | u32 masked crc32(length) | payload | u32 masked crc32(payload)
    payload: i64 doc id | u8 has id | u8 bytes per id | u32 partition
             | u64 ids before it in the partition | ids

all little-endian; a checksum c is stored as rotate_right(c, 15) + 0xA282EAD8, so
that a checksum of stored checksums stays sound. Ids take 2 bytes where the
vocabulary allows it, else 4. The index (Parquet: doc_id, shard, at, size) is
written apart, by the same tasks, and names only the files of committed attempts;
a lost task writes new files, and leftovers are never read. A shuffled reader
sorts or samples the index and fetches frames by (shard, at, size).

Encoding: a byte-level BPE cuts a text before every space that follows and
precedes no other white space, so the library's ids of the pieces between spaces
are the ids of the text; so it does around a line end between two ASCII signs, and
before a mark between an ASCII letter and a space. The library encodes each piece once, new ones together; its
ids are kept in a bounded table by a hash of 128 bits, and a batch of texts is cut,
hashed, looked up and put together as numpy arrays. A text with runs of white space, or with a
special token's string, is encoded whole by the library.

Defined cases: null and empty texts give only the end id; null ids sort first and
stay null; repeated ids keep all their rows, in order of text hash; a very long
text is one record, and its task holds a few times its bytes; an empty table gives
no shards and no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textscan

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SHARD_BYTES = 64 << 20
CACHE = 1_000_000
#: Pieces that are hashed and looked up at once.
WORDS_AT_ONCE = 200_000
MASK = 0xA282EAD8
_HEAD = struct.Struct("<qBBIQ")
#: Pieces are runs of anything but a space; a NUL is part of one, and 255 occurs nowhere in UTF-8.
PIECE = np.arange(256, dtype=np.uint8)
PIECE[[0, 32]] = 255, 0
#: Marks that end words.
MARKS = b".,;:!?"
IS_MARK, IS_LETTER, IS_SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
IS_SIGN[33:127] = True
IS_MARK[list(MARKS)] = True
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def masked_crc(data) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def unmasked(stored: int) -> int:
    c = stored - MASK & 0xFFFFFFFF
    return (c >> 17 | c << 15) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data, at: int = 0) -> tuple[memoryview, int]:
    """(payload, place after the frame); a wrong length or checksum raises."""
    view = memoryview(data)
    length = view[at : at + 8]
    if len(length) < 8 or masked_crc(length) != struct.unpack_from("<I", view, at + 8)[0]:
        raise ValueError("a frame's length is damaged")
    end = at + 12 + struct.unpack("<Q", length)[0]
    payload = view[at + 12 : end]
    if len(view) < end + 4 or masked_crc(payload) != struct.unpack_from("<I", view, end)[0]:
        raise ValueError("a frame's payload is damaged")
    return payload, end + 4


def head(doc: int | None, width: int, partition: int, before: int) -> bytes:
    return _HEAD.pack(doc or 0, doc is not None, width, partition, before)


def unpack(payload) -> tuple:
    """(doc id, partition, ids before, bytes per id, ids) of a payload."""
    doc, known, width, part, before = _HEAD.unpack_from(payload)
    return doc if known else None, part, before, width, bytes(payload[_HEAD.size :])


class Pieces:
    """Ids of pieces by a hash of 128 bits, in numpy arrays; emptied when ``limit`` pieces are in it."""

    def __init__(self, limit: int, kind: str):
        self.limit, self.kind = limit, kind
        self.empty()

    def empty(self) -> None:
        self.filled, self.used = 0, 0
        self.slots = np.full(1 << (4 * self.limit - 1).bit_length(), -1, np.int32)
        self.mask = np.uint64(len(self.slots) - 1)
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for those that aren't in."""
        if not self.filled:
            return np.full(len(h1), -1, np.int64)
        slot = (h1 & self.mask).astype(np.int64)
        found = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero((found >= 0) & ((self.h1[found] != h1) | (self.h2[found] != h2)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            e = self.slots[slot[open_]]
            found[open_] = e
            open_ = open_[(e >= 0) & ((self.h1[e] != h1[open_]) | (self.h2[e] != h2[open_]))]
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Put in pieces that aren't in; n is -1 for one whose text must be encoded whole."""
        size = np.maximum(n, 0)
        have, total = self.filled + len(n), self.used + len(ids)
        self.h1, self.h2, self.at, self.n = (_grown(x, have) for x in (self.h1, self.h2, self.at, self.n))
        self.ids = _grown(self.ids, total)
        new = np.arange(self.filled, have)
        self.h1[new], self.h2[new], self.n[new], self.at[new] = h1, h2, n, self.used + np.cumsum(size) - size
        self.ids[self.used : total] = ids
        self.filled, self.used = have, total
        if 2 * have > len(self.slots):  # a batch of more new pieces than the limit
            self.slots = np.full(1 << (4 * have).bit_length(), -1, np.int32)
            self.mask, new, h1 = np.uint64(len(self.slots) - 1), np.arange(have), self.h1[:have]
        slot = (h1 & self.mask).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]  # of several with one slot, one is kept
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & int(self.mask)

    def gather(self, entries: np.ndarray, marked: np.ndarray, marks: np.ndarray, lined: np.ndarray, line: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of entries one after another, with those of line ends before and of marks after them; number of each, -1 where there are none)."""
        n = self.n[entries]
        good = n >= 0
        own, lined, marked = np.maximum(n, 0), lined & good, marked & good
        size = own + lined + marked
        to = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), self.kind)
        out[to[lined]] = line
        to = to + lined
        within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(to, own) + within] = self.ids[np.repeat(self.at[entries], own) + within]
        out[(to + own)[marked]] = marks[marked]
        return out, np.where(good, size, -1)


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x), 1024), x.dtype)
    out[: len(x)] = x
    return out


class Encoder:
    """Ids of whole texts as little-endian arrays, from the library."""

    def __init__(self, file: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Pieces(cache, self.kind)
        # A byte-level model spells a space as one character, with which a token starts only if its piece does.
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        # It spells each byte as one character, which the library's pre-tokenizer tells.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {c: "".join(x for x, _ in spell(chr(c)))[-1] for c in range(128)}
        self.spelling |= {0x80 + k: "".join(x for x, _ in spell(chr(0x80 + k)))[-1] for k in range(64)}
        for lead in range(0xC2, 0xF5):  # a lead byte is the first of the characters that start with it
            tail = {0xE0: b"\xa0\x80", 0xF0: b"\x90\x80\x80"}.get(lead, b"\x80" * (1 if lead < 0xE0 else 2 if lead < 0xF0 else 3))
            self.spelling[lead] = "".join(x for x, _ in spell((bytes([lead]) + tail).decode()))[0]
        self.space, self.model = space, self.tokenizer.model
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.mark = np.zeros(256, self.kind)
        for c in MARKS:
            self.mark[c] = self.tokenizer.encode(chr(c), add_special_tokens=False).ids[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def encode(self, column: pa.Array):
        """The ids of each text, as bytes."""
        data, offsets = textscan.buffers(column)
        for a, b in textscan.slices(offsets, 1 << 20):
            yield from self.encode_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        count = len(offsets) - 1
        # A line end between two signs is a token of its own, and so parts pieces as a space does.
        line = np.flatnonzero(raw[1:-1] == 10) + 1
        line = line[IS_SIGN[raw[line - 1]] & IS_SIGN[raw[line + 1]]]
        at = np.searchsorted(offsets, line, "right") - 1
        line = line[(line > offsets[at]) & (line + 1 < offsets[at + 1])]
        parted = raw.copy()
        parted[line] = 32
        start, end, doc, folded = textscan.words(parted, offsets, PIECE)
        # A space that follows another, or ends a text, belongs to a run of white space.
        space = np.flatnonzero(raw == 32)
        owner = np.searchsorted(offsets, space, "right") - 1
        ends = space + 1 == offsets[owner + 1]
        whole = np.zeros(count, bool)
        whole[owner[ends]] = True
        whole[owner[1:][(np.diff(space) == 1) & (owner[1:] == owner[:-1])]] = True
        for s in self.special:
            if " " in s:
                whole |= [s.encode() in raw[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        # A mark after an ASCII letter and before a space is cut off by the library, too.
        marked = (end - start > 1) & IS_MARK[raw[end - 1]] & IS_LETTER[raw[end - 2]]
        ends_in = np.where(marked, self.mark[raw[end - 1]], 0)
        folded[end[marked] - 1] = 0
        end = end - marked
        parts, sizes = [], []
        for i in range(0, len(start), WORDS_AT_ONCE):
            j = min(i + WORDS_AT_ONCE, len(start))
            base = int(start[i])
            lined = parted[start[i:j] - 1] != raw[start[i:j] - 1]
            lined[start[i:j] == 0] = False
            first = lined | (start[i:j] == offsets[doc[i:j]])
            entries = self.pieces(raw[base : end[j - 1]], folded[base : end[j - 1]], start[i:j] - base, end[i:j] - base, first)
            ids, n = self.known.gather(entries, marked[i:j], ends_in[i:j], lined, self.line)
            parts.append(ids)
            sizes.append(n)
        n = np.concatenate([np.zeros(0, np.int64), *sizes])
        whole[doc[n < 0]] = True
        ids = np.concatenate([np.zeros(0, self.kind), *parts])
        upto = np.r_[0, np.cumsum(np.bincount(doc, weights=np.maximum(n, 0), minlength=count)).astype(np.int64)].tolist()
        out = [ids[x:y].tobytes() for x, y in zip(upto, upto[1:])]
        odd = np.flatnonzero(whole).tolist()
        if odd:
            for k, found in zip(odd, self.whole([raw[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd])):
                out[k] = found
        return out

    def pieces(self, raw, folded, start, end, first) -> np.ndarray:
        """Entries of pieces in the table, into which new ones are put."""
        h1, h2 = textscan.word_digests(folded, start, end)
        h1 = np.where(first, h1 ^ textscan.MULTIPLIER, h1)
        entries = self.known.find(h1, h2)
        if (entries < 0).any():
            if self.known.filled + int((entries < 0).sum()) > self.known.limit:
                self.known.empty()
                entries = self.known.find(h1, h2)
            while len(miss := np.flatnonzero(entries < 0)):  # twice if pieces are equal in one hash only
                miss = miss[np.unique(h1[miss], return_index=True)[1]]
                miss = miss[np.argsort(first[miss], kind="stable")]
                self.known.add(h1[miss], h2[miss], *self.learn(raw, start[miss], end[miss], int((~first[miss]).sum())))
                entries = self.known.find(h1, h2)
        return entries

    def learn(self, raw, start, end, inner: int) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pieces; the first ``inner`` have a space before them, the others begin texts or lines."""
        data = raw.tobytes()
        texts = [data[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        special = [s for s in self.special if s.encode() in data]
        found: list = [None] * len(texts)
        space, spelling, model, other = self.space, self.spelling, self.model.tokenize, []
        for k, t in enumerate(texts):
            if t.isalpha():  # one pre-token, which the model is given in its own spelling
                t = t if t.isascii() else t.encode().decode("latin-1").translate(spelling)
                found[k] = [x.id for x in model(space + t if k < inner else t)]
            elif not (t[0].isspace() or special and any(s in t for s in special)):
                other.append(k)
        # Pieces one after another are a text that the library cuts before each of them.
        many = [k for k in other if k < inner]
        (whole,) = self.tokenizer.encode_batch_fast(["".join(" " + texts[k] for k in many)], add_special_tokens=False)
        ids = np.array(whole.ids, np.int64)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(many) or len(at) and at[0]:
            raise ValueError("the vocabulary has pieces that aren't cut before a space")
        for k, x in zip(many, np.split(ids, at[1:])):
            found[k] = x.tolist()
        alone = [k for k in other if k >= inner]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)):
            found[k] = e.ids
        n = np.array([-1 if x is None else len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(x for x in found if x), self.kind, int(n[n > 0].sum())), n


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """Write shards below path/data and the index to path/index; returns the index.

    order names the columns to sort by, the id if None; an empty list keeps docs' partitions and their order.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    by = [F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(order or [])]
    sorted_docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *by)
    if order is None or by:
        # Ties are dealt by text and place, so that one id's rows aren't one task.
        keyed = sorted_docs.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
        keys = [*(["doc_id"] if order is None else [f"by{i}" for i in range(len(by))]), "tie", "place"]
        sorted_docs = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        store, root = _store(f"{path}/data")
        enc, before, out, name, at = encoder(tokenizer_file), 0, None, "", 0
        end = np.array([end_id], dtype=enc.kind).tobytes()
        try:
            for batch in batches:
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                    data = frame(head(doc, enc.width, partition, before) + ids + end)
                    if out is None or at + len(data) > shard_bytes and at:
                        if out is not None:
                            out.close()
                        else:
                            store.create_dir(root, recursive=True)
                        name, at = f"shard-{partition:06d}-{uuid.uuid4().hex}.rec", 0
                        out = store.open_output_stream(f"{root}/{name}")
                    out.write(data)
                    rows.append((doc, name, at, len(data)))
                    at += len(data)
                    before += len(ids) // enc.width + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "shard", "at", "size"])
        finally:
            if out is not None:
                out.close()

    sorted_docs.mapInArrow(run, "doc_id long, shard string, at long, size long").write.parquet(f"{path}/index")
    return spark.read.schema("doc_id long, shard string, at long, size long").parquet(f"{path}/index")


def _fetch(path: str):
    """Rows of an index -> what they name in the shards below path, checksums verified."""
    def run(batches):
        store, root = _store(f"{path}/data")
        for batch in batches:
            shard, at, size = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows, i = [], 0
            while i < len(shard):
                j = i + 1  # records that follow one another are fetched at once
                while j < len(shard) and shard[j] == shard[i] and at[j] == at[j - 1] + size[j - 1] and at[j] - at[i] < 8 << 20:
                    j += 1
                with store.open_input_file(f"{root}/{shard[i]}") as f:
                    data = f.read_at(at[j - 1] + size[j - 1] - at[i], at[i])
                for k in range(i, j):
                    payload, _ = unframe(data, at[k] - at[i])
                    rows.append(unpack(payload))
                i = j
                if sum(len(r[4]) for r in rows) > 16 << 20:
                    yield _read_batch(rows)
                    rows = []
            if rows:
                yield _read_batch(rows)

    return run


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(doc_id, part, before, ids binary, width) of every record the index names, from the shards; checksums are verified."""
    common.small_batches(index.sparkSession)
    return index.mapInArrow(_fetch(path), "doc_id long, part int, before long, width int, ids binary")


def _read_batch(rows):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "part", "before", "width", "ids"])


def _digest(batches):
    for batch in batches:
        n, crc = [], []
        for width, ids in zip(batch.column(3).to_pylist(), batch.column(4)):
            values = np.frombuffer(ids.as_buffer(), dtype=f"<u{width}")
            n.append(len(values))
            crc.append(zlib.crc32(values.astype("<u4")))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])


DIGEST = "doc_id long, part int, before long, n_tokens long, ids_crc32 long"


def digests(records: DataFrame) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids_crc32) of records."""
    return records.mapInArrow(_digest, DIGEST)


def read_digests(index: DataFrame, path: str) -> DataFrame:
    """``digests`` of ``read_records``; the worker that reads a record describes it, as a second one takes as much memory again."""
    fetch = _fetch(path)
    common.small_batches(index.sparkSession)
    return index.mapInArrow(lambda batches: _digest(fetch(batches)), DIGEST)


def with_starts(found: DataFrame) -> DataFrame:
    """Adds each record's start: the ids of the partitions before its own, and those before it there."""
    totals = found.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))  # a row per partition
    base = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = common.materialize(totals.select("part", base.alias("base")), "token-bases")
    joined = found.join(F.broadcast(bases) if common.is_small(bases) else bases, "part")
    return joined.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, tokenizer_file: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Write docs as records in the shared folder and describe what is read back."""
    import public_tokenizers

    path = common.shared_path(docs.sparkSession, "token-records")
    index = write_records(docs, path, tokenizer_file or public_tokenizers.path(TOKENIZER), order=order)
    return with_starts(common.materialize(read_digests(index, path), "token-digests"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, in ascending order of doc_id."""
    return encode_and_read_back(common.table(spark, sf_dir, "documents"))
