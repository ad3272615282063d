"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

A SuperMinHash signature gives every element of a set a permutation of its places: element e puts
the value j + r(e, j) on the j-th place of its own permutation, and a place keeps its least value.
As one element's values are spread over different places, signatures vary less than those of
independent hashes. Levels j are taken for all elements at once, and a set leaves when every place
holds a value below the next level, which large sets reach after one or two.

Equal sets are one node. Sets that agree on all values of a band share a bucket. In the first round
every node of a bucket is held against the bucket's centre, the node with most company over all its
buckets. What lies in one component then needs no more comparison; the second round compares, in
pieces of bounded size, nodes of different components of a bucket, a pair in its first common
bucket only, and leaves out pairs that links found before have joined. Pairs whose signatures agree on
too few places are dropped before sets are read: a link has such a pair with a probability below
10^-9. All others are confirmed on full sets. No step puts out rows by pairs of a bucket: the
first round has one per node and bucket, the second names nodes, and links that join components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, materialize, text_bytes
from .components import components
from .simhash import word_blocks

SHINGLE = 3
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 85
PLACES, ROWS = 128, 4
#: Elements whose permutations are held at a time, nodes of a bucket that meet in one task.
ELEMENTS = 1 << 16
PIECE, ELEMENTS_EACH = 2048, 512
_STEP = 0x9E3779B97F4A7C15


def shingle_set(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle."""
    found, tail, seen = [], [], False
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
        hashes = (xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, stops))
        found.append(np.unique(np.fromiter(hashes, np.uint64, len(stops))))
        tail = words[-(width - 1):] if width > 1 else []
    if not seen:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail))] if tail else [], np.uint64)
    return np.unique(np.concatenate(found))


def set_name(elements: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(elements.astype("<u8").tobytes(), digest_size=16).digest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _take_in(signature: np.ndarray, owner: np.ndarray, element: np.ndarray) -> None:
    """Let elements into the signatures of their owners; level j uses bits 56 up, r the rest."""
    places = signature.shape[1]
    flat = signature.reshape(-1)
    order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32),
                    (len(element), 1))
    for j in range(places):
        draw, pick = (_mixed(element + np.uint64((2 * j + i) * _STEP % 2**64)) for i in (1, 2))
        k = j + (pick % np.uint64(places - j)).astype(np.int64)
        row = np.arange(len(element))
        place = order[row, k].astype(np.int64)
        order[row, k] = order[row, j]
        np.minimum.at(flat, owner * places + place,
                      np.uint64(j << 56) | (draw >> np.uint64(8)))
        # A place may still change while it holds a value of a later level.
        open_sets = signature.max(axis=1) >= np.uint64((j + 1) << 56)
        stay = open_sets[owner]
        if not stay.all():
            owner, element, order = owner[stay], element[stay], order[stay]
        if not len(element):
            return


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """One row of values for each set; an empty set has the largest value everywhere."""
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    held: list[int] = []

    def flush() -> None:
        if held:
            part = np.full((len(held), places), np.iinfo(np.uint64).max, np.uint64)
            sizes = [len(sets[i]) for i in held]
            _take_in(part, np.repeat(np.arange(len(held)), sizes),
                     np.concatenate([sets[i] for i in held]))
            out[held] = part
            held.clear()

    count = 0
    for i, own in enumerate(sets):
        if len(own) > ELEMENTS:
            for at in range(0, len(own), ELEMENTS):
                piece = own[at:at + ELEMENTS]
                _take_in(out[i:i + 1], np.zeros(len(piece), np.int64), piece)
            continue
        if count + len(own) > ELEMENTS:
            flush()
            count = 0
        held.append(i)
        count += len(own)
    flush()
    return out


def _buckets(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value per band; the band's number is part of it."""
    banded = signature.reshape(len(signature), -1, rows)
    out = np.broadcast_to(np.arange(banded.shape[1], dtype=np.uint64) * np.uint64(_STEP),
                          banded.shape[:2]).copy()
    for k in range(rows):
        out = _mixed(out ^ banded[:, :, k])
    return out


def least_agreement(percent: int = PERCENT, places: int = PLACES) -> int:
    """Places that the signatures of a link agree on, but for a probability below 10^-9."""
    share = percent / 100
    return int(places * share - 6.2 * (places * share * (1 - share)) ** 0.5)


def prints(docs: DataFrame, key: str, text: str, width: int = SHINGLE, places: int = PLACES,
           rows: int = ROWS) -> DataFrame:
    """(doc_id, node, n, buckets, sketch); a row without shingles has no buckets.

    node names the set, the sketch holds the lowest eight bits of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            found = signatures(sets, places)
            buckets = _buckets(found, rows).view(np.int64)
            some = np.array([len(s) > 0 for s in sets], bool)
            bands = buckets.shape[1]
            offsets = np.concatenate(([0], np.cumsum(some * bands)))
            sketch = (found & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_name(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                          pa.array(buckets[some].ravel())),
                 pa.array([row.tobytes() for row in sketch], pa.binary())],
                names=["doc_id", "node", "n", "buckets", "sketch"])

    narrow = docs.select(F.col(key).alias("doc_id"), text_bytes(F.col(text)).alias("data"))
    kind = docs.schema[key].dataType.simpleString()
    return for_python(narrow).mapInArrow(
        run, f"doc_id {kind}, node binary, n long, buckets array<long>, sketch binary")


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, places: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches leave a link possible."""
    least = least_agreement(percent, places)
    own = nodes.select("node", "n", "sketch")
    both = (pairs.join(own.toDF("a", "n", "sketch_a"), "a").join(own.toDF("b", "m", "sketch_b"), "b")
            .where(_sizes_allow(F.col("n"), F.col("m"), percent))
            .select("a", "b", "sketch_a", "sketch_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_bytes_of(batch.column(2)) == _bytes_of(batch.column(3))).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(same >= least))

    return both.mapInArrow(run, "a binary, b binary")


def _sets(wanted: DataFrame, docs: DataFrame, named: DataFrame, key: str, text: str, width: int
          ) -> DataFrame:
    """(node, elements) of the wanted nodes, cut again from one text of each."""
    one_each = named.join(wanted, "node", "left_semi").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_name(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                          pa.array(every.view(np.int64)))],
                names=["node", "elements"])

    texts = docs.select(F.col(key).alias("doc_id"), text_bytes(F.col(text)).alias("data")).join(
        one_each.select("doc_id").distinct(), "doc_id", "left_semi").select("data")
    # An id may have several texts, and a text of another node may come along: sets name themselves.
    return for_python(texts).mapInArrow(run, "node binary, elements array<long>").join(
        wanted, "node", "left_semi").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their full sets make links."""
    common = F.size(F.array_intersect("x", "y"))
    return (pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
            .withColumn("common", common)
            .where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common")))
            .select("a", "b"))


def _centres(filed: DataFrame) -> DataFrame:
    """Each node of a bucket against the node of the bucket that has most company."""
    company = filed.groupBy("node").agg(F.sum("size").alias("company"))
    known = filed.select("bucket", "node").join(company, "node")
    centre = known.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("top")).select(
        "bucket", F.col("top.node").alias("centre"))
    met = filed.select("bucket", "node").join(centre, "bucket").where(F.col("node") != F.col("centre"))
    return met.select(F.least("node", "centre").alias("a"),
                      F.greatest("node", "centre").alias("b")).distinct()


def _dealt_across(filed: DataFrame, nodes: DataFrame, roots: DataFrame, piece: int) -> DataFrame:
    """(bucket, shard, ask, role, node, root, main, n, sketch, buckets) of the buckets that hold nodes of
    several components. Nodes outside a bucket's largest component ask (role 2) all its nodes
    (role 1). Both are dealt to pieces, by number and by size of sets, and a task holds one of each."""
    own = filed.select("bucket", "node").join(
        roots.select(F.col("id").alias("node"), "root"), "node", "left").withColumn(
            "root", F.coalesce("root", "node")).join(nodes, "node")
    parts = own.groupBy("bucket", "root").agg(
        F.count(F.lit(1)).alias("count"), F.sum("n").alias("elements"))
    mixed = parts.groupBy("bucket").agg(
        F.sum("count").alias("count"), F.sum("elements").alias("elements"),
        F.count(F.lit(1)).alias("parts"),
        F.max(F.struct("count", "root", "elements")).alias("most")).where(F.col("parts") > 1)

    def pieces(count: Column, elements: Column) -> Column:
        return F.greatest(F.ceil(count / piece), F.ceil(elements / (piece * ELEMENTS_EACH))).cast("int")

    several = mixed.select(
        "bucket", F.col("most.root").alias("main"),
        pieces(F.col("count"), F.col("elements")).alias("pieces"),
        pieces(F.col("count") - F.col("most.count"), F.col("elements") - F.col("most.elements"))
        .alias("ask_pieces"))
    here = own.join(several, "bucket")
    shard, ask = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("pieces", "ask_pieces"))
    columns = ["bucket", "shard", "ask", "role", "node", "root", "main", "n", "sketch", "buckets"]
    targets = here.withColumns({"shard": shard, "role": F.lit(1)}).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.col("ask_pieces") - 1))).select(columns)
    askers = here.where(F.col("root") != F.col("main")).withColumns(
        {"ask": ask, "role": F.lit(2)}).withColumn(
            "shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(columns)
    return targets.union(askers)


def _open_pairs(asker: pa.Table, target: pa.Table, percent: int, least: int
                ) -> Iterator[tuple[int, np.ndarray]]:
    """For each asker the targets it must be held against, those with most in common first: of
    another component, with a size and a sketch that allow a link, and in no earlier common bucket.
    Of two askers only the larger asks."""
    names, root, main = (np.array(target[c].to_pylist(), "S16") for c in ("node", "root", "main"))
    n, sketch, bands = target["n"].to_numpy(), _bytes_of(target["sketch"]), _bands_of(target)
    mine, own_bands = _bytes_of(asker["sketch"]), _bands_of(asker)
    bucket, sizes = asker["bucket"][0].as_py(), asker["n"].to_numpy()
    for i in range(len(asker)):
        me, m = np.bytes_(asker["node"][i].as_py()), sizes[i]
        open_ = np.flatnonzero(
            (root != np.bytes_(asker["root"][i].as_py())) & ((root == main) | (names < me))
            & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
        agree = (sketch[open_] == mine[i]).sum(axis=1)
        open_, agree = open_[agree >= least], agree[agree >= least]
        if len(open_):
            first = own_bands[i][(bands[open_] == own_bands[i]).argmax(axis=1)]
            open_, agree = open_[first == bucket], agree[first == bucket]
        if len(open_):
            yield i, open_[np.argsort(-agree, kind="stable")]


def _bands_of(table: pa.Table) -> np.ndarray:
    return np.array(table["buckets"].to_pylist(), np.int64)


_DEALT = "bucket long, shard int, ask int, role int, node binary"


def _across(filed: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, places: int,
            piece: int, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between components, enough to join all that links of shared buckets join.

    A first pass names the nodes of each task that have an open pair there, so that only their
    sets travel; the second compares sets and leaves out what its own links have joined already."""
    least, keys = least_agreement(percent, places), ["bucket", "shard", "ask"]
    dealt = materialize(_dealt_across(filed, nodes, roots, piece), "across")

    def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        table = table.combine_chunks()
        role = table["role"].to_numpy()
        return tuple(table.filter(pa.array(role == r)) for r in (2, 1))

    def concerned(table: pa.Table) -> pa.Table:
        asker, target = sides(table)
        ask, hit = np.zeros(len(asker), bool), np.zeros(len(target), bool)
        if len(asker) and len(target):
            for i, open_ in _open_pairs(asker, target, percent, least):
                ask[i] = True
                hit[open_] = True
        return pa.concat_tables([asker.filter(pa.array(ask)), target.filter(pa.array(hit))]).select(
            [*keys, "role", "node"])

    def linked(table: pa.Table) -> pa.Table:
        asker, target = sides(table)
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while x in up:
                x = up[x]
            return x

        a, b = [], []
        if len(asker) and len(target):
            held = [target["elements"][j].values.to_numpy() for j in range(len(target))]
            roots_, names = target["root"].to_pylist(), target["node"].to_pylist()
            for i, open_ in _open_pairs(asker, target, percent, least):
                own, me = asker["elements"][i].values.to_numpy(), asker["node"][i].as_py()
                mine = asker["root"][i].as_py()
                for j in open_.tolist():
                    x, y = top(mine), top(roots_[j])
                    if x == y:
                        continue
                    common = len(np.intersect1d(own, held[j], assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(held[j]) - common):
                        up[max(x, y)] = min(x, y)
                        a.append(min(me, names[j]))
                        b.append(max(me, names[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    named = materialize(dealt.groupBy(*keys).applyInArrow(concerned, _DEALT), "concerned")
    sets = materialize(sets_of(named.select("node").distinct()), "sets")
    whole = dealt.join(named, [*keys, "role", "node"]).join(sets, "node")
    return whole.groupBy(*keys).applyInArrow(linked, "a binary, b binary")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                percent: int = PERCENT, places: int = PLACES, rows: int = ROWS,
                piece: int = PIECE) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by nearly equal sets of shingles.

    component_id is the smallest id that links reach. A null or empty text has no shingles and is
    linked with nothing; a row without an id is never linked and has no component; rows of one id
    with different texts are linked by their texts; repeated rows give repeated rows; other columns
    are ignored, and the id keeps its type. Two sets of similarity `percent` share a band but for a
    probability of (1 - 0.85^4)^32 < 10^-10 with the defaults."""
    found = materialize(prints(docs, key, text, width, places, rows), "prints")
    real = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = materialize(real.select("node", "n", "buckets", "sketch").dropDuplicates(["node"]),
                        "nodes")
    filed = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    filed = materialize(filed.join(shared, "bucket"), "filed")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets(wanted, docs, real, key, text, width)

    likely = materialize(_likely(_centres(filed), nodes, percent, places), "stars")
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = materialize(sets_of(ends), "sets")
    roots = components(materialize(_confirmed(likely, sets, percent), "links"))
    more = materialize(_across(filed, nodes, roots, percent, places, piece, sets_of), "links")
    # The second round joins components, so its links are held between their roots.
    lifted = more
    for end in ("a", "b"):
        lifted = lifted.join(roots.toDF(end, "up"), end, "left").withColumn(
            end, F.coalesce("up", end)).drop("up")
    upper = components(lifted)
    named = roots.join(upper.toDF("root", "top"), "root", "left").select(
        F.col("id").alias("node"), F.coalesce("top", "root").alias("root"))
    # No root has a row in `roots`, so the nodes of both tables differ.
    tops = named.unionByName(upper.select(F.col("id").alias("node"), "root"))
    placed = real.select("doc_id", "node").distinct().join(tops, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # One row per set: the component of each node, not of each document.
    of_node = placed.select("node", "root").distinct().join(least, "root").drop("root")
    return found.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("component_id")).alias("component_id"))


def near_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = near_groups(docs, key, text)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
