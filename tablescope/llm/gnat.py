"""Hard negatives by exact search in GNAT-style multiway hyperplane trees.

Rows are dealt to cells, each to the nearest of a few split points, and a table of distance ranges
says between which distances from every split point the rows of every cell lie. A query is a
window of scores round an anchor. The inner product and the Euclidean distance of two vectors fix
each other up to their lengths, so a window of scores is an annulus round the anchor; by the
triangle inequality a cell whose range from some split point can't meet the annulus is left out.
Inside a cell (or a piece of one, where a cell is large) a task builds the tree further: every node
has split points with ranges to all sibling subtrees, and leaves are compared exactly.

Queries look into the nearest cells first. What they find there narrows their windows for the
second round, which visits all cells that the ranges don't rule out, so results are exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import for_python, materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Shares of the positive's score, in hundredths, between which a negative's score must lie.
LOW, HIGH = 50, 95
#: Split points at the top (chosen from a sample of SAMPLE rows at most), cells first looked into.
CELLS, CELL_ROWS, SAMPLE, PROBES = 128, 2048, 4096, 2
#: Rows and queries that meet in one task; split points of an inner node and rows of a leaf.
PIECE, QUERIES = 32768, 4096
FANOUT, LEAF = 8, 256
_FAR = 1 << 62


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows of both; squares are whole numbers below 2^53."""
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def _spread_points(x: np.ndarray, count: int) -> np.ndarray:
    """Split points far from each other: each the row farthest from those before it."""
    chosen = [int(np.argmax(np.abs(x - x.mean(axis=0)).sum(axis=1)))]
    near = _distances(x, x[chosen])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


@dataclass
class Ranges:
    """Split points, per child the least and largest distance from every split point [child, point],
    and per child the least and largest squared length."""
    points: np.ndarray
    near: np.ndarray
    far: np.ndarray
    short: np.ndarray
    long: np.ndarray

    def alive(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[query, child]: whether the child may hold a score within the query's window.

        |q|^2 + |x|^2 - 2 s is the squared distance, so scores from low to high are an annulus. A
        margin keeps rounding from ruling out what lies on its border."""
        own = (x * x).sum(axis=1)[:, None]
        inner = np.sqrt(np.maximum(own + self.short - 2 * high[:, None], 0)) * (1 - 1e-9) - 1e-3
        outer = np.sqrt(np.maximum(own + self.long - 2 * low[:, None], 0)) * (1 + 1e-9) + 1e-3
        to_points = _distances(x, self.points)
        alive = own + self.long - 2 * low[:, None] >= 0
        for k in range(len(self.points)):
            at = to_points[:, k:k + 1]
            least = np.maximum(at - self.far[:, k], self.near[:, k] - at)
            alive &= (least <= outer) & (at + self.far[:, k] >= inner)
        return alive


class Tree:
    """A GNAT over the rows of one cell."""

    def __init__(self, x: np.ndarray, rows: np.ndarray | None = None):
        self.rows = np.arange(len(x)) if rows is None else rows
        self.children: list[Tree] = []
        own = x[self.rows]
        if len(own) <= LEAF:
            return
        points = _spread_points(own, FANOUT)
        if len(points) < 2:
            return                      # equal vectors: a leaf of any size
        distance = _distances(own, points)
        child = distance.argmin(axis=1)
        square = (own * own).sum(axis=1)
        parts = [np.flatnonzero(child == c) for c in range(len(points))]
        parts = [p for p in parts if len(p)]
        self.children = [Tree(x, self.rows[p]) for p in parts]
        self.ranges = Ranges(points, np.array([distance[p].min(axis=0) for p in parts]),
                             np.array([distance[p].max(axis=0) for p in parts]),
                             np.array([square[p].min() for p in parts]),
                             np.array([square[p].max() for p in parts]))

    def search(self, x: np.ndarray, low: np.ndarray, high: np.ndarray,
               visit: Callable[[np.ndarray, np.ndarray], None], who: np.ndarray) -> None:
        """Call visit(queries, rows) for every leaf that may hold scores in their windows. `low`
        rises while better rows are found, so children are ruled out against its latest values."""
        if not self.children:
            visit(who, self.rows)
            return
        order = np.argsort(_distances(x[who], self.ranges.points).mean(axis=0)[:len(self.children)])
        for c in order.tolist():
            alive = self.ranges.alive(x[who], low[who], high[who])[:, c]
            if alive.any():
                self.children[c].search(x, low, high, visit, who[alive])


class Best:
    """The first `count` rows of every query by score, then id."""

    def __init__(self, queries: int, count: int):
        self.score = np.full((queries, count), -_FAR, np.int64)
        self.id = np.full((queries, count), _FAR, np.int64)

    def offer(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score[query, row], with -_FAR where a row doesn't count."""
        if score.shape[1] > self.score.shape[1]:
            count = self.score.shape[1]
            # All that reach the count-th best score, ties included, by a bound per query.
            floor = -np.partition(-score, count - 1, axis=1)[:, count - 1]
            some = (score > -_FAR) & (score >= np.maximum(floor, self.score[who, -1])[:, None])
        else:
            some = score > -_FAR
        q, r = np.nonzero(some)
        if not len(q):
            return
        touched, at = np.unique(q, return_inverse=True)
        old = who[touched]
        count = self.score.shape[1]
        group = np.concatenate((np.repeat(np.arange(len(touched)), count), at))
        scores = np.concatenate((self.score[old].ravel(), score[q, r]))
        names = np.concatenate((self.id[old].ravel(), ids[r]))
        order = np.lexsort((names, -scores, group))
        first = np.searchsorted(group[order], np.arange(len(touched)))
        kept = order[first[:, None] + np.arange(count)]
        self.score[old], self.id[old] = scores[kept], names[kept]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows of float64, whose whole numbers are exact; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def clean_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding",
                  label: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part, with components as whole numbers."""
    x = F.col(vector)
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(good).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


@dataclass
class Index:
    """The top of the tree, held by the driver and by tasks: at most CELLS squared ranges."""
    dims: int
    ranges: Ranges
    number: np.ndarray                  # of each child of the ranges
    pieces: dict[int, int]


def _cell_rows(dealt: DataFrame, points: np.ndarray, dims: int) -> DataFrame:
    """(cell, point, near, far, short, long, n): distance ranges, one row per cell and point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            cell, distance = batch.column(0).to_numpy(), _distances(x, points)
            square = (x * x).sum(axis=1)
            for c in np.unique(cell).tolist():
                own = cell == c
                n = len(points)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, c)), pa.array(np.arange(n)),
                     pa.array(distance[own].min(axis=0)), pa.array(distance[own].max(axis=0)),
                     pa.array(np.full(n, square[own].min())), pa.array(np.full(n, square[own].max())),
                     pa.array(np.full(n, own.sum()))],
                    names=["cell", "point", "near", "far", "short", "long", "n"])

    parts = dealt.select("cell", "v").mapInArrow(
        run, "cell long, point long, near double, far double, short double, long double, n long")
    return parts.groupBy("cell", "point").agg(
        F.min("near").alias("near"), F.max("far").alias("far"), F.min("short").alias("short"),
        F.max("long").alias("long"), F.sum("n").alias("n"))


def build_index(rows: DataFrame, cells: int = CELLS, cell_rows: int = CELL_ROWS,
                piece: int = PIECE) -> tuple[DataFrame, Index] | None:
    """(id, label, v, cell, piece) of all rows, and the top of the tree; None without rows.

    Split points come from a sample of SAMPLE rows at most, taken by a hash of the id; all rows are
    filed, and ranges are measured over all rows."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"),
                     F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if not facts["n"] or not facts["dims"]:
        return None
    if (facts["most"] or 0) ** 2 * facts["dims"] >= 1 << 51:
        raise ValueError("Components are too large for exact scores in double precision.")
    dims, wanted = facts["dims"], max(1, min(cells, -(-facts["n"] // cell_rows)))
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toArrow()
    points = _spread_points(_matrix(sample["v"], dims), wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _distances(_matrix(batch.column(2), dims), points).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())],
                                             names=[*batch.schema.names, "cell"])

    dealt = materialize(for_python(rows.select("id", "label", "v")).mapInArrow(
        deal, "id long, label long, v array<bigint>, cell long"), "cells")
    found = _cell_rows(dealt, points, dims).orderBy("cell", "point").toArrow()
    shape = (-1, len(points))
    near, far, short, long, n = (found[c].to_numpy().reshape(shape) for c in (
        "near", "far", "short", "long", "n"))
    number = found["cell"].to_numpy().reshape(shape)[:, 0]
    pieces = {int(c): -(-int(k) // piece) for c, k in zip(number, n[:, 0])}
    index = Index(dims, Ranges(points, near, far, short[:, 0], long[:, 0]), number, pieces)
    per_cell = F.element_at(F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv]),
                            F.col("cell").cast("int"))
    return dealt.withColumn("piece", F.pmod(F.xxhash64("id", "v"), per_cell).cast("int")), index


_ROUTED = "qid long, other long, label long, low long, high long, v array<bigint>, cell long, piece int"


def _routed(queries: DataFrame, index: Index, probes: int | None, skip: int = 0) -> DataFrame:
    """Queries once for each piece of a cell they must look into: the `probes` nearest cells, or
    all but the `skip` nearest that the ranges leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(5), index.dims)
            low, high = (batch.column(i).to_numpy().astype(np.float64) for i in (3, 4))
            wanted = index.ranges.alive(x, low, high)
            nearness = _distances(x, index.ranges.points[index.number])
            place = nearness.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            wanted &= place < probes if probes is not None else place >= skip
            q, c = np.nonzero(wanted)
            cell = index.number[c]
            times = np.array([index.pieces[int(k)] for k in cell], np.int64)
            q, cell = np.repeat(q, times), np.repeat(cell, times)
            piece = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(q)).columns, pa.array(cell, pa.int64()),
                 pa.array(piece, pa.int32())], names=[*batch.schema.names, "cell", "piece"])

    return for_python(queries.select("qid", "other", "label", "low", "high", "v")).mapInArrow(
        run, _ROUTED)


def _found(routed: DataFrame, dealt: DataFrame, dims: int, count: int, same: bool,
           blocks: int) -> DataFrame:
    """(qid, other, id, score): each task's first `count` rows of its queries."""
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    asked = routed.withColumn("block", block)
    held = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["cell", "piece", "block"]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = Best(len(queries), count)
        if len(queries) and len(rows):
            x, data = _matrix(queries["v"], dims), _matrix(rows["v"], dims)
            low, high = (queries[c].to_numpy().astype(np.float64) for c in ("low", "high"))
            ask, names = queries["label"].to_numpy(), rows["id"].to_numpy()
            label, own = rows["label"].to_numpy(), queries["qid"].to_numpy()

            def visit(who: np.ndarray, at: np.ndarray) -> None:
                for cut in range(0, len(at), 4096):
                    part = at[cut:cut + 4096]
                    score = x[who] @ data[part].T
                    good = (score >= low[who, None]) & (score <= high[who, None])
                    good &= (label[part] == ask[who, None]) == same
                    if same:
                        good &= names[part] != own[who, None]
                    out.offer(who, np.where(good, score, -_FAR).astype(np.int64), names[part])
                low[who] = np.maximum(low[who], out.score[who, -1])

            Tree(data).search(x, low, high, visit, np.arange(len(x)))
        q, r = np.nonzero(out.score > -_FAR)
        return pa.table({"qid": queries["qid"].to_numpy()[q], "other": queries["other"].to_numpy()[q],
                         "id": out.id[q, r], "score": out.score[q, r]})

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        run, "qid long, other long, id long, score long")


def _first(found: DataFrame, count: int) -> DataFrame:
    order = W.partitionBy("qid", "other").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def search(queries: DataFrame, dealt: DataFrame, index: Index, count: int, same: bool,
           most: int, probes: int = PROBES) -> DataFrame:
    """(qid, other, id, score, rank): the first `count` rows of each query's window, among rows of
    the query's label (`same`) or of other labels.

    `queries` has (qid, other, label, low, high, v), at most `most` rows. The first round looks into
    the nearest cells; its worst kept score raises the window's lower end for the second."""
    blocks = max(1, -(-most // QUERIES))
    near = materialize(_found(_routed(queries, index, probes), dealt, index.dims, count, same, blocks),
                       "near")
    floor = _first(near, count).where(F.col("rank") == count).select(
        "qid", "other", F.col("score").alias("floor"))
    raised = queries.join(floor, ["qid", "other"], "left").withColumn(
        "low", F.greatest("low", F.coalesce("floor", "low")))
    rest = _found(_routed(raised, index, None, probes), dealt, index.dims, count, same, blocks)
    return _first(near.union(rest), count)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   cell_rows: int = CELL_ROWS, piece: int = PIECE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` and `anchors` have (id, label, v) as `clean_vectors` makes them; an anchor is one of the
    rows. Positives are the first rows of the anchor's label by inner product, then id, without the
    anchor itself; negatives the first rows of other labels whose score is from `low` to `high`
    hundredths of the positive's. Ids are taken as unique: rows that repeat an id are rows of their
    own, but none of them is a positive of an anchor with that id. Vectors of different lengths
    end in zeros. Empty tables give no rows."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    built = build_index(rows, cell_rows=cell_rows, piece=piece)
    asked = anchors.count()
    if built is None or not asked:
        return rows.sparkSession.createDataFrame([], schema)
    dealt, index = built
    far = F.lit(1 << 52)
    queries = anchors.select(F.col("id").alias("qid"), F.lit(0).cast("long").alias("other"), "label",
                             (-far).alias("low"), far.alias("high"), "v").dropDuplicates(["qid"])
    best = materialize(search(queries, dealt, index, positives, True, asked), "positives")
    score = F.col("score")
    # low * p <= 100 * s <= high * p in whole numbers; no score does for a negative p.
    windows = best.select("qid", F.col("id").alias("other"), "score").dropDuplicates(
        ["qid", "other"]).join(queries.select("qid", "label", "v"), "qid").select(
            "qid", "other", "score", "label", F.ceil(score * low / F.lit(100)).alias("low"),
            F.floor(score * high / F.lit(100)).alias("high"), "v").where(F.col("low") <= F.col("high"))
    found = search(windows, dealt, index, negatives, False, asked * positives)
    return found.withColumnRenamed("score", "negative_score").join(
        windows.select("qid", "other", F.col("score").alias("positive_score")), ["qid", "other"]
    ).select(F.col("qid").alias("anchor_id"), F.col("other").alias("positive_id"),
             F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
             "positive_score", "negative_score")


def negatives_report(embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hard negatives of the rows whose id 50 divides; where 7 divides it, the label is the next of
    ten. Rows without id, label or vector, or with a component that is null or not finite, take no
    part; other columns are ignored."""
    rows = clean_vectors(embeddings, key)
    moved = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10)
                            .otherwise(F.col("label")))
    kept = materialize(moved, "vectors")
    return hard_negatives(kept, kept.where(F.col("id") % 50 == 0))
