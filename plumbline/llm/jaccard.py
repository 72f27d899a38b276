"""N-gram Jaccard self-join: linked documents and their components.

A document is the set of its distinct 5-word shingles (with fewer words, the whole
sequence is one). Two link when 100 * |A & B| >= 80 * |A | B|. No link is lost;
shingles are compared by hashes of 64 bits, so a false link needs as many chance
collisions as the texts lack common shingles (for two texts of one shingle each,
one: about n * n / 2 ** 65 among n such texts).

1. Documents with equal sets (128-bit digest) become one node, the smallest id.
2. Prefix filter. Under any common order of shingles, linked sets share one of
   their first p = n - ceil(0.8 n) + 1. The order is: hashes below ``TAU`` of the
   hash space first, rarest first by exact counts over all nodes, then the others
   by hash; so a node emits max(p, its low hashes), about a third of its set.
   Shingles that one node has are never shipped further. An inverted list is cut
   by size: its part b has the nodes of size classes b and b + 1, classes a factor
   of 1.25 apart, as sets that link differ by no more.
3. Nodes of long lists (``HOT``) are taken anew with exact counts of all their
   shingles, which takes common passages out of their prefixes.
4. T-occurrence search within an inverted list (DivideSkip): a query's longest
   lists are set aside, its short ones are heap-merged (more than ``MERGE`` elements
   by numpy's stable sort, which merges the sorted runs into the same sequence),
   candidates are probed for in the long ones by binary search, and a pair is linked
   if its whole overlap suffices. Before that, one member of the largest component in
   reach is compared directly, as copies mostly link with it. Pairs that are already connected aren't counted again, so a group of
   copies costs a row per member, not per pair. Lists that share nodes make up a
   family. A family of at most ``BLOCK`` nodes is one block. A larger one counts as
   one list where that is less work than its lists, which may overlap; there each
   node is first searched in its longest list alone, in blocks of ``BLOCK`` that
   share pivots; then lists that still hold several components are searched in
   full, every member outside the largest component against all blocks. Nothing
   is capped: a list of any length is worked off in blocks of bounded size.
5. Components: every task keeps a forest of its edges, at most an edge per node, and
   one task joins up to ``TOGETHER`` of them (measured: 76,000 edges a GB). More are
   joined by alternating large and small stars, on tables in the shared folder; a
   star's least neighbour is written before it is joined back, so a hub's edges stay
   where they are or, beyond what is broadcast, are split by adaptive execution.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; a null id gets a null component; rows that share an id are one document
for links; very long texts are read whole, a text at a time; an empty table gives
no rows; further columns are ignored, and keep_one passes them on whatever their
names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textscan

SHINGLE = 5
PERCENT = 80
TAU = 0.3
HOT = 16
BLOCK = 512
#: DivideSkip's weight of a probe against a merge step.
MU = 0.0085
#: Elements up to which short lists are merged by a heap; more by merging runs in numpy, in the same order.
MERGE = 400
#: Edges (16 bytes each) that one task joins into components, and those it gathers before it drops what it doesn't need.
TOGETHER = 2_000_000
JOIN_AT = 500_000
_SIGN = np.uint64(1 << 63)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """Per text, its sorted distinct shingle hashes (as signed, in unsigned order)."""
    data, offsets = textscan.buffers(column)
    for a, b in textscan.slices(offsets):
        start, end, doc, folded = textscan.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], textscan.SPACED)
        word = textscan.word_hashes(folded, start, end)
        first = np.searchsorted(doc, np.arange(b - a + 1))
        hashes = textscan.window_hashes(word, k)
        for i in range(b - a):
            x, y = int(first[i]), int(first[i + 1])
            found = hashes[x : y - k + 1] if y - x >= k else textscan.window_hashes(word[x:y], y - x) if y > x else hashes[:0]
            found = np.sort((found ^ _SIGN).view(np.int64))
            yield found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def _emit(tau: float, percent: int, k: int):
    """doc_id, text -> doc_id, n, digest, r = prefix size - emitted, low = emitted hashes."""
    bound = -(1 << 63) + int(tau * 2**64)

    def run(batches):
        for batch in batches:
            n, digest, r, low = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                p = prefix_size(len(s), percent) if len(s) else 0
                e = max(p, int(np.searchsorted(s, bound)))
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                r.append(p - e)
                low.append(s[:e])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, low)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *low])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(r, pa.int32()), lists], names=["doc_id", "n", "digest", "r", "low"])

    return run


def _whole(k: int):
    """doc_id, text -> node, shingles (bytes of the sorted set)."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), k)], pa.binary())], names=["node", "shingles"])

    return run


def _explode_bytes(batches):
    """node, shingles -> node, n, r, h: every shingle of the set."""
    for batch in batches:
        for node, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.frombuffer(data.as_buffer(), dtype=np.int64)
            if len(s):
                r = prefix_size(len(s)) - len(s)
                n = np.full(len(s), len(s), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(n), pa.array(np.full(len(s), r, dtype=np.int32)), pa.array(s)], names=["node", "n", "r", "h"])


def inverted_lists(postings: DataFrame, tau: float, name: str) -> DataFrame:
    """Prefix postings (node, h, size of h's list) of lists of two nodes or more, equal lists once.

    postings: (node, n, r, h), where r is the prefix size less the number emitted.
    A list here is one of a shingle's parts by size, so h is a hash of both.
    """
    bound = -(1 << 63) + int(tau * 2**64)
    counts = common.materialize(postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), f"{name}-counts")
    # The counts grow with the postings, so they are never broadcast.
    shared = postings.join(counts.hint("merge"), "h")
    last = F.lit(False) if tau >= 1 else F.col("h") >= F.lit(bound)
    by_node = Window.partitionBy("node")
    ranked = shared.withColumn("shared", F.count(F.lit(1)).over(by_node)).withColumn("place", F.row_number().over(by_node.orderBy(last, F.when(last, F.lit(0)).otherwise(F.col("df")), "h")))
    size_class = F.floor(F.log("n") / F.lit(math.log(1.25001)))
    parts = F.explode(F.array(F.xxhash64("h", size_class), F.xxhash64("h", size_class - 1)))
    prefix = common.materialize(ranked.where("place <= r + shared").select("node", parts.alias("h")), f"{name}-prefix")
    common.release(counts)
    signed = prefix.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")).where("size > 1")
    chosen = common.materialize(signed.groupBy("size", "a", "b").agg(F.min("h").alias("h")).select("h", "size"), f"{name}-chosen")
    lists = common.materialize(prefix.join(chosen, "h").select("node", "h", "size"), f"{name}-lists")
    common.release(prefix, chosen)
    return lists


class Lists:
    """Inverted lists over a block of sets, and the T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]  # in each list, sets in ascending order
        fresh = np.r_[True, values[1:] != values[:-1]]
        self.first = np.r_[np.flatnonzero(fresh), len(values)]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(fresh) - 1
        self.of_set = np.split(number, np.cumsum(self.sizes)[:-1])
        self.length = np.diff(self.first)

    def enough(self, q: int, other, overlap):
        return 100 * overlap >= self.percent * (self.sizes[q] + self.sizes[other] - overlap)

    def overlap(self, q: int, other: int) -> int:
        return len(np.intersect1d(self.of_set[q], self.of_set[other], assume_unique=True))

    def search(self, q: int, wanted: np.ndarray) -> np.ndarray:
        """The sets among ``wanted`` (a mask) that link with q."""
        own = self.of_set[q]
        own = own[np.argsort(-self.length[own], kind="stable")]
        longest = int(self.length[own[0]])
        floor = -(-self.percent * int(self.sizes[q]) // 100)  # any linked set shares at least so many, being in q's size range
        aside = min(int(floor / (MU * math.log2(max(longest, 2)) + 1)), floor - 1)
        least = floor - aside
        short = [x for i in own[aside:] if self.length[i] > 1 and len(x := self._kept(i, wanted))]
        found: list[int] = []
        counts: list[int] = []
        if sum(map(len, short)) > MERGE:  # numpy's stable sort merges sorted runs
            found, counts = (x.tolist() for x in np.unique(np.sort(np.concatenate(short), kind="stable"), return_counts=True))
        else:
            run, last = 0, -1
            for x in heapq.merge(*map(np.ndarray.tolist, short)):
                if x != last and run:
                    found.append(last)
                    counts.append(run)
                    run = 0
                run, last = run + 1, x
            if run:
                found.append(last)
                counts.append(run)
        who, seen = np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)
        who, seen = who[seen >= least], seen[seen >= least]
        for k, i in enumerate(own[:aside]):
            if not len(who):
                return who
            here = self.owner[self.first[i] : self.first[i + 1]]
            at = np.searchsorted(here, who)
            seen += (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == who)
            alive = seen + (aside - k - 1) >= floor
            who, seen = who[alive], seen[alive]
        return who[self.enough(q, who, seen)]

    def _kept(self, i: int, wanted: np.ndarray) -> np.ndarray:
        here = self.owner[self.first[i] : self.first[i + 1]]
        return here[wanted[here]]


def linked(nodes: np.ndarray, labels: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the components (labels) of a block, from every set that asks."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, labels, asks, sets = nodes[order], labels[order].copy(), asks[order], [sets[i] for i in order]
    edges = []
    if (labels == labels[0]).all():
        return edges
    lists = Lists(sets, percent)

    def unite(q, other):
        edges.append((int(nodes[q]), int(nodes[other])))
        labels[labels == labels[q]] = labels[other]

    for q in np.flatnonzero(asks):
        low, high = percent * lists.sizes[q], 100 * lists.sizes[q]
        wanted = (labels != labels[q]) & (100 * lists.sizes >= low) & (percent * lists.sizes <= high)
        if not wanted.any():
            continue
        near = np.flatnonzero(wanted)  # one of the largest component first: copies mostly link with it
        names, where, many = np.unique(labels[near], return_index=True, return_counts=True)
        if len(near) > 2 and (many := int(where[np.argmax(many)])) >= 0 and lists.enough(q, near[many], lists.overlap(q, near[many])):
            unite(q, near[many])
            wanted &= labels != labels[q]
        if wanted.any():
            for other in lists.search(q, wanted):
                if labels[other] != labels[q]:
                    unite(q, other)
    return edges


def _search_blocks(percent: int):
    """Rows of blocks in order (block columns h, c, g; node, label, asks, shingles) -> u, v."""
    def run(batches):
        key, rows = None, {}

        def done():
            if len(rows) > 1:
                items = [(n, *x) for n, x in rows.items()]
                found = linked(np.array([x[0][0] for x in items]), np.array([x[1] for x in items]), np.array([x[2] for x in items]), [x[3] for x in items], percent)
                return found
            return []

        for batch in batches:
            edges = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for k, node, label, asks, data in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6)):
                if k != key:
                    edges += done()
                    key, rows = k, {}
                s = np.frombuffer(data.as_buffer(), dtype=np.int64)
                which = node, s.tobytes()
                rows[which] = (label, asks or rows.get(which, (0, False))[1], s.copy())
            yield _edge_batch(edges)
        yield _edge_batch(done())

    return run


def _edge_batch(edges):
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])


def search(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) found within blocks (h, c, g, node, label, asks); written."""
    blocks = common.materialize(blocks, "blocks")
    rows = common.join_by_keys(sets, blocks, "node", "inner").select("h", "c", "g", "node", "label", "asks", "shingles")
    dealt = rows.repartition("h", "c", "g").sortWithinPartitions("h", "c", "g")
    links = common.materialize(dealt.mapInArrow(_search_blocks(percent), "u long, v long"), "links")
    common.release(blocks)
    return links


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of edges: roots hook on to smaller ones until no edge joins two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


def _joined(every: bool):
    """Edges u, v of a task -> a node and its root for each node, or for each that isn't a root."""
    def run(batches):
        u, v, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def joined(every):
            nodes, root = roots(np.concatenate(u), np.concatenate(v))
            keep = (nodes != root) | every
            return nodes[keep], root[keep]

        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            more += batch.num_rows
            if more > max(len(u[0]), JOIN_AT):  # what isn't needed to join the nodes goes
                x, y = joined(False)
                u, v, more = [x], [y], 0
        if len(u[0]) or more:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(every)], names=["node", "component"])

    return run


def components(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(node, component = smallest id of its component) of all nodes that have edges.

    Each task keeps of its edges a forest. Up to ``together`` edges are then joined by one task, more by stars.
    """
    def ordered(e):
        return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def is_forest(e):
        """Whether e is stars around roots: no node has two parents, or a parent and children."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()

    kept = common.materialize(edges.where("u != v").select("u", "v").mapInArrow(_joined(False), "u long, v long"), "forests")
    if kept.count() <= together:
        return kept.coalesce(1).mapInArrow(_joined(True), "node long, component long")
    # What is joined below is written, so a side of small files is broadcast and a hot key can be split, without a job to ask.
    e = common.materialize(ordered(kept), "edges")
    common.release(kept)
    while not is_forest(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # As e has u > v, the pairs with v > u are e turned round.
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = common.materialize(ordered(turned.join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))), "large-star")
        least = common.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, e = e, common.materialize(ordered(small), "small-star")
        common.release(old, low, large, least)
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(tops)


def families(lists: DataFrame) -> DataFrame:
    """(node, family, members): nodes that lists connect."""
    first = common.materialize(lists.groupBy("h").agg(F.min("node").alias("v")), "first-nodes")
    of = components(lists.join(first, "h").select(F.col("node").alias("u"), "v"))
    of = common.materialize(of.withColumnRenamed("component", "family"), "families")
    sizes = common.materialize(of.groupBy("family").agg(F.count(F.lit(1)).alias("members")), "family-sizes")
    return of.join(sizes, "family").select("node", "family", "members")


def blocks_of_families(of: DataFrame) -> DataFrame:
    """Each family as one block."""
    zero = F.lit(0).cast("long")
    return of.select(F.col("family").alias("h"), zero.alias("c"), zero.alias("g"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"))


def lists_of_large(lists: DataFrame, large: DataFrame) -> DataFrame:
    """The lists of large families; where they repeat the same nodes so much that the family as one list is less to search, that."""
    own = common.materialize(common.join_by_keys(lists, large, "node", "inner"), "family-lists")
    work = own.groupBy("family", "h").agg(F.count(F.lit(1)).alias("c"), F.max("members").alias("members")).groupBy("family").agg(F.sum(F.col("c") * F.col("c")).alias("work"), F.max("members").alias("members"))
    whole = common.materialize(work.where(F.col("members") * F.col("members") <= F.col("work")).select("family"), "whole-families")
    together = common.join_by_keys(large, whole, "family", "left_semi").select("node", F.col("family").alias("h"), F.col("members").alias("size"))
    return common.join_by_keys(own, whole, "family", "left_anti").select("node", "h", "size").union(together)


def blocks_of_longest(lists: DataFrame) -> DataFrame:
    """Each node in its longest list alone, in blocks that share three pivots."""
    own = common.materialize(lists.groupBy("node").agg(F.max(F.struct("size", "h")).alias("x")).select("node", "x.h"), "longest")
    sizes = own.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("p0"), F.max("node").alias("p1"), F.min_by("node", F.xxhash64("node")).alias("p2"))
    sizes = common.materialize(sizes.where("n > 1").withColumn("k", F.ceil(F.col("n") / BLOCK).cast("long")), "list-sizes")
    members = common.join_by_keys(own, sizes.select("h", "k"), "h", "inner").select("h", F.pmod(F.xxhash64("node", "h"), F.col("k")).alias("c"), "node")
    pivots = sizes.where("k > 1").select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("c"), F.array("p0", "p1", "p2").alias("p")).select("h", "c", F.explode("p").alias("node"))
    return members.union(pivots).select("h", "c", F.lit(0).cast("long").alias("g"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"))


def blocks_of_rest(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Lists that hold several components: members outside the largest ask all blocks."""
    labelled = lists.join(found, "node", "left").select("node", "h", F.coalesce("component", "node").alias("label"))
    labelled = common.materialize(labelled, "labelled")
    split = common.materialize(labelled.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("h"), "split-lists")
    rows = common.materialize(common.join_by_keys(labelled, split, "h", "left_semi").select("node", "h", "label"), "unresolved")
    share = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"))
    facts = share.groupBy("h").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("n"))
    facts = facts.select("h", F.col("x.label").alias("major"), F.ceil(F.col("n") / BLOCK).cast("long").alias("k"), F.ceil((F.col("n") - F.col("x.n")) / BLOCK).cast("long").alias("m"))
    rows = common.join_by_keys(rows, common.materialize(facts, "list-facts"), "h", "inner")
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    index = rows.select("h", F.pmod(F.xxhash64("node", "h"), F.col("k")).alias("c"), up_to("m").alias("g"), "node", "label", F.lit(False).alias("asks"))
    asking = rows.where("label != major").select("h", up_to("k").alias("c"), F.pmod(F.xxhash64("h", "node"), F.col("m")).alias("g"), "node", "label", F.lit(True).alias("asks"))
    return index.union(asking)


def self_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, tau: float = TAU, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = common.materialize(texts.mapInArrow(_emit(tau, percent, k), "doc_id long, n long, digest binary, r int, low array<long>"), "shingles")
    named = rows.where("doc_id IS NOT NULL AND n > 0")

    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "rep")
    classes = common.materialize(classes, "classes")
    copies = common.materialize(common.join_by_keys(named.select("doc_id", "digest"), classes, "digest", "inner").where("doc_id != rep").select("doc_id", "digest", "rep"), "copies")
    postings = common.join_by_keys(named, copies.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    postings = postings.select(F.col("doc_id").alias("node"), F.col("n").cast("int").alias("n"), "r", F.explode("low").alias("h"))
    lists = inverted_lists(postings, tau, "low")

    wanted = common.materialize(lists.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    sets = common.materialize(common.join_by_keys(texts, wanted, "doc_id", "left_semi").mapInArrow(_whole(k), "node long, shingles binary"), "sets")
    hot_nodes = common.materialize(lists.where(F.col("size") > hot).select("node").distinct(), "hot-nodes")
    again = common.join_by_keys(sets, hot_nodes, "node", "left_semi").mapInArrow(_explode_bytes, "node long, n int, r int, h long")
    low, high = lists, inverted_lists(again, 1.0, "hot")
    lists = common.materialize(low.where(F.col("size") <= hot).union(high), "lists")
    common.release(low, high, wanted, hot_nodes)

    # Copies of a document that has rows with other texts too: an id is one document.
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    same = copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    of = common.materialize(families(lists), "families")
    edges = [search(blocks_of_families(of.where(F.col("members") <= BLOCK)), sets, percent), same]
    large = common.materialize(of.where(F.col("members") > BLOCK), "large-families")
    if not large.isEmpty():
        lists = common.materialize(lists_of_large(lists, large), "large-lists")
        edges.append(search(blocks_of_longest(lists), sets, percent))
        found = common.materialize(components(edges[-1]), "components")
        edges.append(search(blocks_of_rest(lists, found), sets, percent))
    found = common.materialize(components(reduce(DataFrame.union, edges)), "components")
    common.release(sets, lists, of, large)

    joined = rows.select("doc_id", "n", "digest").join(classes, "digest", "left")
    joined = joined.withColumn("node", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))).join(found, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each linked group, that with the smallest id; all columns.

    Of rows that share that id the first in order of text is kept. Rows without
    an id are all kept, as nothing names them.
    """
    found = self_join(docs, id_col, text_col)
    own, name = F.col(f"`{id_col}`").cast("long"), common.free_name(docs, "_pl_id")
    gone = common.materialize(found.where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    left = common.join_by_keys(docs.withColumn(name, own), gone, name, "left_anti")
    again = common.materialize(docs.groupBy(own.alias(name)).agg(F.count(F.lit(1)).alias("c")).where(F.col(name).isNotNull() & (F.col("c") > 1)).select(name), "repeated-ids")
    if again.isEmpty():
        return left.drop(name)
    repeated = common.join_by_keys(left, again, name, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = repeated.groupBy(name).agg(F.min_by(row, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_pl_row")).select("_pl_row.*")
    return common.join_by_keys(left, again, name, "left_anti").drop(name).union(one)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, whole texts, five words, 80 percent."""
    return self_join(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 80 * (a.n + b.n - o)),
r AS (SELECT doc_id AS u, doc_id AS c FROM d UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) m ON m.u = d.doc_id
"""
