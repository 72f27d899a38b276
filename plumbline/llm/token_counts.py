"""Token counts of whole texts by rank-synchronous array merging.

The vocabulary is a byte-fallback BPE of sentencepiece with an identity
normaliser, a dummy prefix and spaces written as U+2581. No piece has U+2581
after another character (checked when the model is loaded), so no merge crosses
the start of a run of U+2581: a text is cut there into pre-tokens, each counted
on its own. Counts of pre-tokens are kept in a bounded cache per worker; those
not in it are held as one ragged array of symbols, and in every round each
sequence's lowest-rank pair (its leftmost, on ties) is applied in all sequences
at once, until no sequence has a pair. What survives is counted: one per piece,
and one per UTF-8 byte for a character outside the vocabulary.

Pre-tokens of more than ``LONG`` symbols are held as linked arrays with the places of
each rank, as a round that scans a long sequence to merge one pair of it would make
the work quadratic; there a round merges all places of the lowest rank.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a space run is a
pre-token like any other; strings of special tokens are ordinary text; repeated
rows are counted on their own; very long texts are counted whole; null ids stay null;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
LONG = 192
CACHE = 400_000
NONE = np.int64(1 << 40)
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")


class Merger:
    """Symbols and merges of a sentencepiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                pieces[sp.id_to_piece(i)] = sp.get_score(i)
            if sp.is_unused(i):
                raise ValueError("models with unused pieces aren't supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces that cross a word's start aren't supported")
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.known = len(self.ids)
        for p in pieces:
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        self.other = len(self.ids)
        self.width = self.other + 1
        merges = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    merges[left * self.width + right] = (order[score], self.ids[p])
        self.keys = np.array(sorted(merges), dtype=np.int64)
        self.rank = np.array([merges[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.made = np.array([merges[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.of_code = np.full(0x110000, self.other, dtype=np.int64)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i

    def count(self, words: list[str]) -> list[int]:
        out = np.zeros(len(words), dtype=np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            out[short] = self.count_short([words[i] for i in short])
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            out[long] = self.count_long([words[i] for i in long])
        return out.tolist()

    def count_short(self, words: list[str]) -> np.ndarray:
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(w) for w in words], dtype=np.int64)
        symbol = self.of_code[code]
        extra = np.where(symbol >= self.known, (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF), 0)
        extra = np.add.reduceat(extra, np.cumsum(size) - size)
        left = size.copy()  # symbols that survive, by sequence
        live = np.arange(len(words))  # the sequences in the ragged arrays
        last = np.cumsum(size) - 1
        rank, made = self.look_up(symbol, np.roll(symbol, -1))
        rank[last] = NONE
        while True:
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            merged = best < NONE
            if not merged.all():  # sequences without a pair are done
                left[live] = size
                keep = np.repeat(merged, size)
                symbol, rank, made = symbol[keep], rank[keep], made[keep]
                live, size, best = live[merged], size[merged], best[merged]
                if not len(live):
                    return left + extra
                first = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(best, size))
            if len(at) > len(live):  # each sequence's leftmost pair of that rank
                at = at[np.searchsorted(at, first)]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            final = at + 1 == first + size - 1  # the new symbol is its sequence's last
            at -= np.arange(len(at))
            symbol, rank, made, size = symbol[keep], rank[keep], made[keep], size - 1
            first -= np.arange(len(at))
            again = np.concatenate((at[~final], at[at > first] - 1))
            rank[at[final]] = NONE
            rank[again], made[again] = self.look_up(symbol[again], symbol[again + 1])

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of merging a with b; NONE where they don't merge."""
        pair = a * self.width + b
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[place] == pair, self.rank[place], NONE), self.made[place]

    def count_long(self, words: list[str]) -> np.ndarray:
        """The same in linked arrays, in which a round costs what it merges.

        The lowest rank of all sequences is each one's lowest where it occurs, so a
        round takes the places of one rank. From left to right each is merged, those
        that overlap one before excepted, up to the first that makes a pair of the
        same or a lower rank, as that pair's turn is then next.
        """
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(w) for w in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        # A last element that merges with nothing stands for what is beyond the ends.
        symbol = np.r_[self.of_code[code], self.other]
        known = symbol[:-1] < self.known
        extra = np.where(known, 0, (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF))
        left = size + np.bincount(owner, weights=extra, minlength=len(words)).astype(np.int64)
        n = len(owner)
        after, before = np.r_[np.arange(1, n), n, n], np.r_[n, np.arange(n - 1), n]
        last = np.cumsum(size) - 1
        after[last], before[last - size + 1] = n, n
        rank, made = self.look_up(symbol, symbol[after])
        rank[n] = NONE
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            values, first = np.unique(rank[at], return_index=True)
            for v, places in zip(values.tolist(), np.split(at, first[1:])):
                if v not in waiting:
                    waiting[v] = []
                    heapq.heappush(heap, v)
                waiting[v].append(places)

        offer(np.arange(n))
        while heap:
            now = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(now)))
            at = at[rank[at] == now]
            if not len(at):
                continue
            number = np.arange(len(at))
            chained = np.r_[False, after[at[:-1]] == at[1:]]
            at = at[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
            new, right = made[at], after[at]
            beyond = after[right]
            front = symbol[before[at]]
            touching = np.r_[False, right[:-1] == before[at[1:]]]
            front[touching] = new[:-1][touching[1:]]
            early = np.minimum(np.where(beyond < n, self.look_up(new, symbol[beyond])[0], NONE), np.where(before[at] < n, self.look_up(front, new)[0], NONE)) <= now
            if early.any():  # what follows the first such place in its sequence waits
                own = owner[at]
                seen = np.cumsum(early) - early
                wait = seen > seen[np.searchsorted(own, own)]
                offer_again = at[wait]
                at, new, right, beyond = at[~wait], new[~wait], right[~wait], beyond[~wait]
            else:
                offer_again = at[:0]
            symbol[at], after[at], before[beyond], rank[right] = new, beyond, at, NONE
            before[n], after[n] = n, n
            left -= np.bincount(owner[at], minlength=len(words))
            changed = np.unique(np.r_[at, before[at]])
            changed = changed[changed < n]
            found, new = self.look_up(symbol[changed], symbol[after[changed]])
            rank[changed], made[changed] = np.where(after[changed] < n, found, NONE), new
            offer(np.r_[changed, offer_again])
        return left


class Counter:
    """Counts of texts, with two generations of cached pre-tokens."""

    def __init__(self, merger: Merger, cache: int = CACHE):
        self.merger, self.limit = merger, cache
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        missing = set().union(*split).difference(self.new)
        if len(self.new) + len(missing) > self.limit:
            self.old, self.new = self.new, {}
            missing = set().union(*split)
        found = {w: self.old[w] for w in missing if w in self.old}
        self.new.update(found)
        rest = list(missing.difference(found))
        for a in range(0, len(rest), 50_000):
            self.new.update(zip(rest[a : a + 50_000], self.merger.count(rest[a : a + 50_000])))
        get = self.new.__getitem__
        return [sum(map(get, words)) for words in split]


def pre_tokens(text: str | None) -> list[str]:
    """The text's pre-tokens, without the U+2581 each starts with unless it starts with more."""
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return words
    return [w[1:] for w in _RUNS.findall(SPACE + text.replace(" ", SPACE))]


class Prefixed(Merger):
    """Counts pre-tokens that are given without their first U+2581."""

    def count(self, words):
        return super().count([SPACE + w for w in words])


_counters: dict[str, Counter] = {}


def counter(model_file: str) -> Counter:
    if model_file not in _counters:
        _counters[model_file] = Counter(Prefixed(model_file))
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    common.small_batches(docs.sparkSession)
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        known = counter(model_file)
        for batch in batches:
            text = batch.column(1)
            sizes = pc.binary_length(text.fill_null("")).cast(pa.int64())
            counts = []
            for a in range(0, len(text), 100):
                counts += known.count(text[a : a + 100].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, with the production vocabulary and limit."""
    import public_tokenizers

    counted = count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
