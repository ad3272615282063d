"""SimHash fingerprints, linked through BK-trees.

Two fingerprints within `radius` bits agree on at least one of `radius + 1` blocks of bits, so
every fingerprint is filed once per block under that block's value. All that share a value form a
shard with a BK-tree of its own: the root is the first fingerprint, a child hangs on an edge that
says its distance to the parent, and a search follows only the edges whose number is within the
radius of its distance to the node. A shard's tree is needed only by the fingerprints filed under
the same value, so it is sent to just those, through a shuffle: a broadcast from the driver of
all trees would pass the fingerprints of all documents through it.

A value shared by more than SHARD fingerprints is cut into pieces; the tree of each piece goes to
every block of queries of that value once. Nothing is left out, and no task holds more than two
pieces. A task reports its links as a spanning forest, never as pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, free_name, materialize, text_bytes
from .components import components

SHINGLE = 3
RADIUS = 3
SHARD = 16384
BATCH = 65536
PAIRS = 4_000_000
_SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, in lists of about `size` bytes of text."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield data[at:end].translate(_LOWER).split()
        at = end


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles."""
    ones, total, tail, seen = np.zeros(64, np.int64), 0, [], False
    for words in word_blocks(data):
        words = tail + words
        if len(words) < width:
            tail = words
            continue
        seen = True
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        stops = (ends[width - 1:] - 1).tolist()
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[a:b], _SEED) for a, b in zip(starts, stops)),
            np.uint64, len(stops))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(stops)
        tail = words[-(width - 1):] if width > 1 else []
    if not seen and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), _SEED)
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > total)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; a null or empty text has zero."""
    return _marked(docs, key, text, width).drop("mark")


def _mark(text: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def _marked(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc_id, mark, fp); ids keep their type."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)),
                                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                names=["doc_id", "mark", "fp"])

    narrow = docs.select(F.col(key).alias("doc_id"), _mark(text).alias("mark"),
                         text_bytes(F.col(text)).alias("data"))
    return for_python(narrow).mapInArrow(run, f"doc_id {kind}, mark long, fp long")


class Forest:
    """BK-trees of many shards at once: node i holds fp[i], roots are the first of their shard."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp
        _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[inverse]
        edges, children = [], []
        left = np.flatnonzero(self.root != np.arange(len(fp)))
        at = self.root[left]
        while len(left):
            edge = at * 65 + np.bitwise_count(fp[left] ^ fp[at])
            found, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(found)
            children.append(left[first])
            at = left[first][inverse]
            rest = at != left
            left, at = left[rest], at[rest]
        order = np.concatenate(edges) if edges else np.empty(0, np.int64)
        by = np.argsort(order)
        self.edge = order[by]
        self.child = (np.concatenate(children) if children else np.empty(0, np.int64))[by]

    def search(self, fp: np.ndarray, root: np.ndarray, radius: int
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, level by level."""
        query, node = np.arange(len(fp)), root
        while len(query):
            far = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            near = far <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(far + radius, 64), "right")
            n = high - low
            query = np.repeat(query, n)
            node = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of the pairs; a label is the smallest index of its set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _links(shard: np.ndarray, role: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the rows of each shard; role 1 is in the tree, 2 asks, 3 both."""
    members, asking = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    forest = Forest(shard[members], fp[members])
    ids, first, size = np.unique(shard[members], return_index=True, return_counts=True)
    asking = asking[np.isin(shard[asking], ids)]
    where = np.searchsorted(ids, shard[asking])
    label = np.arange(len(fp))
    load = np.cumsum(size[where])
    cut, done = 0, 0
    while cut < len(asking):
        end = max(cut + 1, int(np.searchsorted(load, done + PAIRS, "right")))
        mine = asking[cut:end]
        for q, node in forest.search(fp[mine], first[where[cut:end]], radius):
            _join(label, mine[q], members[node])
        done, cut = load[end - 1], end
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return rep[moved], rep[label[moved]]


def _blocks(fp: Column, radius: int) -> Column:
    """The value of each of radius + 1 blocks of the bits, together with the block's number."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, low).bitwiseAND(
            F.lit((1 << (high - low)) - 1 if high - low < 64 else -1).cast("long")).alias("value"))
        for i, (low, high) in enumerate(zip(cuts, cuts[1:]))])


def link(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between the ids of fingerprints within the radius, enough to connect them.

    `distinct` has (fp, rep), each fingerprint once."""
    filed = distinct.select("fp", "rep", F.inline(_blocks(F.col("fp"), radius)))
    large = filed.groupBy("block", "value").count().where(F.col("count") > shard).select(
        "block", "value", F.ceil(F.col("count") / shard).cast("int").alias("pieces"))
    piece, k = F.col("piece"), F.col("other")
    dealt = (
        filed.join(large, ["block", "value"], "left")
        .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("block", "value", F.least(piece, k).alias("tree"),
                F.greatest(piece, k).alias("asks"),
                F.when(k == piece, 3).when(k > piece, 1).otherwise(2).alias("role"), "fp", "rep"))
    keys = ["block", "value", "tree", "asks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(part: np.ndarray) -> pa.RecordBatch:
            new = np.any(part[1:, :4] != part[:-1, :4], axis=1)
            shard_no = np.concatenate(([0], np.cumsum(new)))
            a, b = _links(shard_no, part[:, 4], np.ascontiguousarray(part[:, 5]).view(np.uint64),
                          part[:, 6], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            if sum(map(len, held)) < BATCH:
                continue
            rows = np.concatenate(held)
            new = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1))
            end = int(new[-1]) + 1 if len(new) else 0
            held = [rows[end:]]
            if end:
                yield links(rows[:end])
        rows = np.concatenate(held) if held else np.empty((0, 7), np.int64)
        if len(rows):
            yield links(rows)

    return (dealt.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a long, b long"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   width: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id): near-duplicate groups of documents.

    Equal fingerprints are folded to their smallest id before any search, so thousands of copies
    cost no more than one. component_id is the smallest id that links reach. A null text counts
    as empty and has fingerprint zero; a row without an id is never linked and has no component;
    repeated rows give repeated rows; other columns are ignored."""
    prints, named = _linked(docs, key, text, width, radius, shard)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(named.join(least, "root").drop("rep"), "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
        .alias("component_id"))


def _linked(docs: DataFrame, key: str, text: str, width: int, radius: int, shard: int
            ) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, fp) of all rows, and (fp, rep, root): the smallest id with a fingerprint, and
    the smallest fingerprint that links reach. An id may have several fingerprints, so the
    fingerprints are linked, not the ids."""
    prints = materialize(_marked(docs, key, text, width), "prints")
    distinct = materialize(prints.where(F.col("doc_id").isNotNull()).groupBy("fp")
                           .agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(link(distinct.withColumn("rep", F.col("fp")), radius, shard))
    named = distinct.join(roots, distinct.fp == roots.id, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    return prints, named


def simhash_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = simhash_groups(docs, key, text)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the one with the smallest id, all its columns kept.

    Rows without an id stay. An id may have several texts: rows of different groups stay, and of
    one group the smallest (id, fingerprint, hash of the text)."""
    prints, named = _linked(docs, key, text, width, radius, SHARD)
    keep = prints.where(F.col("doc_id").isNotNull()).join(named, "fp").groupBy("root").agg(
        F.min(F.struct("doc_id", "fp", "mark")).alias("kept")).select(
            F.col("kept.doc_id").alias(key),
            F.col("kept.mark").alias("mark"))
    mark = free_name(docs, "mark")
    named_rows = docs.where(F.col(key).isNotNull()).withColumn(mark, _mark(text)).join(
        keep.withColumnRenamed("mark", mark), [key, mark], "left_semi").dropDuplicates([key, mark])
    return named_rows.select(docs.columns).union(docs.where(F.col(key).isNull()))
