"""Exact substring dedup over suffix arrays.

A byte is removed if it lies in a string of LENGTH bytes that also starts anywhere else. Strings
that are equal must meet in one shard, whatever documents they stand in, so they are dealt by
content: each string of LENGTH bytes is filed under the least hash of the 16-byte pieces in it,
and neighbouring strings with the same least piece form a segment. Such a string reaches far on
at least one side of its piece, so a segment is dropped if neither the bytes before nor those
after its piece occur with it elsewhere: no string in it can occur twice. Equal segments are
folded. What is left is suffix-sorted shard by shard (see `induced`): strings whose suffixes share
LENGTH bytes are repeats.

Pieces that many of a sample of documents hold, such as those of a common line, are passed over
unless a string has no other, so that no shard gathers all that stands around that line. The
sample only moves work between shards; it never changes the result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import for_python, materialize, text_bytes
from .induced import common_prefix, suffix_order
from .minima import least_places

LENGTH = 400
PIECE = 16
SHARD_BYTES = 2 << 20
#: Unpacked text of what a task hands on at once; packed rows may hold many times their size.
UNPACKED_BYTES = 4 << 20
QUEUE_BYTES = 128 << 20
SAMPLE_DOCS = 2000
COMMON_DOCS = 10
_STRETCH = 1 << 22
_BITS = 18
#: Stands for bytes beyond the stretch of a long text, which may or may not occur elsewhere.
UNKNOWN = 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the PIECE bytes from each place on."""
    n = len(data) - PIECE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray((len(data) - 7, ), "<u8", np.ascontiguousarray(data), strides=(1, ))
    with np.errstate(over="ignore"):
        h = words[:n] * _A ^ (words[8:8 + n] + _B) * _B
        h ^= h >> np.uint64(29)
        h *= _A
        h ^= h >> np.uint64(32)
    return h


def beginnings(common: np.ndarray) -> np.ndarray:
    """For each value of the first _BITS bits whether a common piece begins with it."""
    begins = np.zeros(1 << _BITS, bool)
    begins[common >> np.uint64(64 - _BITS)] = True
    return begins


def segments(data: bytes, common: np.ndarray, length: int = LENGTH,
             begins: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(piece, first, last, before, after): runs of strings, by where they start, under the same
    least piece; and hashes of the piece with the bytes before and after it, 0 where the text
    ends too soon.

    Every string of the run contains what was hashed on one side or the other: it has at least
    half of its other bytes there. Long texts are cut into stretches, which may cut a run in
    two, and a hash of 0 may stand for a text that goes on in the stretch beside: such a side
    counts as repeated. `begins` is what `beginnings` gives for the common pieces."""
    if len(common) and begins is None:
        begins = beginnings(common)
    width = length - PIECE + 1
    steps = (length - PIECE) // 2 // PIECE
    for at in range(0, max(0, len(data) - length + 1), _STRETCH):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, _STRETCH + length - 1), at)
        h = pieces(part)
        rank = h >> np.uint64(25)
        if len(common):
            # A common piece is among the few that begin like one.
            near = np.flatnonzero(begins[h >> np.uint64(64 - _BITS)])
            found = np.minimum(np.searchsorted(common, h[near]), len(common) - 1)
            rank >>= np.uint64(1)
            held = near[common[found] == h[near]]
            rank[held] = h[held] >> np.uint64(25) | np.uint64(1 << 39)
        place = least_places(rank, width)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.append(first[1:] - 1, len(place) - 1)
        at_piece = place[first]
        # Both ways at once; what lies beyond the text is not used.
        reach, m = PIECE * steps, len(first)
        wide = np.zeros(len(h) + 2 * reach, np.uint64)
        wide[reach:reach + len(h)] = h
        way = np.repeat((-PIECE, PIECE), m)
        spot = np.concatenate((at_piece, at_piece)) + reach
        mixed = np.zeros(2 * m, np.uint64)
        with np.errstate(over="ignore"):
            for _ in range(steps + 1):
                mixed ^= wide[spot]
                mixed *= _A
                mixed ^= mixed >> np.uint64(32)
                spot += way
        # One mark for the way keeps the two sides of a piece apart.
        mixed = (mixed | np.uint64(2)) ^ (way > 0).astype(np.uint64)
        spot -= way + reach
        mixed[(spot < 0) | (spot >= len(h))] = 0
        around = [mixed[:m].view(np.int64), mixed[m:].view(np.int64)]
        cut_off = at > 0, at + len(part) < len(data)
        for side, cut in enumerate(cut_off):
            if cut:
                around[side] = np.where(around[side] == 0, UNKNOWN, around[side])
        yield (h[at_piece].view(np.int64), first + at, last + at, *around)


def _common_pieces(spark: SparkSession, base: DataFrame) -> np.ndarray:
    """Pieces that COMMON_DOCS or more of about SAMPLE_DOCS documents hold, sorted.

    Bounded by the sample: at most its pieces divided by COMMON_DOCS."""
    rows = base.count()
    some = base if rows <= SAMPLE_DOCS else base.sample(fraction=SAMPLE_DOCS / rows, seed=42)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                data = np.frombuffer(zstandard.decompress(packed.as_py()), np.uint8)
                for at in range(0, len(data), _STRETCH):
                    h = np.unique(pieces(data[at:at + _STRETCH + PIECE - 1]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

    found = some.select("packed").mapInArrow(run, "h long").groupBy("h").count().where(
        F.col("count") >= COMMON_DOCS).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def _repeats(parts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(part, first, last) of runs of places where a repeated string starts."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    text = np.append(data.astype(np.int16) + 1, 0).astype(np.int16)
    order = suffix_order(text, length, QUEUE_BYTES)[1:]
    group = np.cumsum(common_prefix(data, order, length) < length)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    whole = (np.arange(len(data)) - begin[part] + length <= sizes[part])[order]
    twice = np.bincount(group[whole], minlength=int(group[-1]) + 1) > 1
    starts = np.sort(order[whole & twice[group]])
    if not len(starts):
        return []
    new = np.flatnonzero((np.diff(starts) != 1) | (np.diff(part[starts]) != 0)) + 1
    first, last = starts[np.append(0, new)], starts[np.append(new - 1, len(starts) - 1)]
    owner = part[first]
    return list(zip(owner.tolist(), (first - begin[owner]).tolist(),
                    (last - begin[owner]).tolist()))


class _Shard:
    """Distinct segments of some pieces, and where each stands."""

    def __init__(self) -> None:
        self.texts: dict[bytes, bytes] = {}
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        self.marks: dict[int, set[bytes]] = {}
        self.size = 0

    def solve(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(row, from, to) of the bytes to remove."""
        for mark, places in self.places.items():
            if len(places) > 1:
                n = len(self.texts[mark])
                for row, at in places:
                    yield row, at, at + n
        # Strings of one text under one piece differ, and so do those under different pieces.
        open_ = [m for m in self.marks.values()
                 if len(m) > 1 and any(len(self.places[x]) == 1 for x in m)]
        marks = sorted(x for m in open_ for x in m)
        if marks:
            for k, first, last in _repeats([self.texts[m] for m in marks], length):
                if len(self.places[marks[k]]) == 1:
                    row, at = self.places[marks[k]][0]
                    yield row, at + first, at + last + length


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   length: int = LENGTH, shard_bytes: int = SHARD_BYTES
                   ) -> tuple[DataFrame, DataFrame]:
    """The texts as (row, key, packed), packed by zstd, and per row with repeats its sorted
    disjoint spans [start, end) of bytes to remove.

    Rows are numbered, so null and repeated keys are told apart. A null or short text has no
    spans."""
    spark = docs.sparkSession
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                         text_bytes(F.col(text)).alias("data"))
    kind = docs.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([packer.compress(x.as_py()) for x in batch.column(2)], pa.binary())],
                names=["row", "key", "packed"])

    base = materialize(for_python(narrow).mapInArrow(pack, f"row long, `key` {kind}, packed binary"), "texts")
    common = spark.sparkContext.broadcast(_common_pieces(spark, base))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filed_of(out: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64())
                 for c in out], names=["row", "piece", "first", "last", "before", "after"])

        begins = beginnings(common.value)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            size = 0
            for row, packed in zip(batch.column(0), batch.column(1)):
                data = zstandard.decompress(packed.as_py())
                for found in segments(data, common.value, length, begins):
                    values = (np.full(len(found[0]), row.as_py()), *found)
                    for column, value in zip(out, values):
                        column.append(value)
                size += len(data)
                if size >= UNPACKED_BYTES:
                    yield filed_of(out)
                    out, size = [[], [], [], [], [], []], 0
            yield filed_of(out)

    filed = materialize(base.select("row", "packed").mapInArrow(
        file, "row long, piece long, first long, last long, before long, after long"), "segments")
    sides = filed.select("row", "piece", "first", "last", F.explode(F.array("before", "after"))
                         .alias("side")).where("side != 0")
    # A table of its own, so that a side that many texts share can be split in the join.
    again = materialize(sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") > 1) | (F.col("side") == UNKNOWN)).select("side"), "again")
    wanted = materialize(sides.join(again, "side", "left_semi").groupBy("row").agg(
        F.collect_set(F.struct("piece", "first", "last")).alias("runs")), "wanted")
    volume = wanted.select(F.explode("runs").alias("r")).agg(
        F.sum(F.col("r.last") - F.col("r.first") + length)).first()[0] or 0
    shards = max(1, -(-volume // shard_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def cut_of(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(),
                                                      pa.int64(), pa.binary()))],
                names=["piece", "mark", "row", "first", "segment"])

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for row, packed, runs in zip(*batch.columns):
                row, packed, runs = row.as_py(), packed.as_py(), runs.as_py()
                data = zstandard.decompress(packed)
                for r in runs:
                    segment = data[r["first"]:r["last"] + length]
                    mark = hashlib.blake2b(segment, digest_size=16).digest()
                    values = (r["piece"], mark, row, r["first"],
                              None if mark in seen else segment)
                    # A task sends each distinct segment once; the memory for that is bounded.
                    if len(seen) < 1_000_000:
                        seen.add(mark)
                    size += 0 if values[4] is None else len(segment)
                    for column, value in zip(out, values):
                        column.append(value)
                    if size >= UNPACKED_BYTES:
                        yield cut_of(out)
                        out, size = [[], [], [], [], []], 0
            yield cut_of(out)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(shard: _Shard) -> pa.RecordBatch:
            found = list(shard.solve(length))
            columns = list(zip(*found)) if found else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              names=["row", "start", "end"])

        shard, now = _Shard(), None
        for batch in batches:
            for piece, mark, row, first, segment in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != now and shard.size >= shard_bytes:
                    yield solved(shard)
                    shard = _Shard()
                now = piece
                shard.places.setdefault(mark, []).append((row, first))
                shard.marks.setdefault(piece, set()).add(mark)
                if segment is not None and mark not in shard.texts:
                    shard.texts[mark] = segment
                    shard.size += len(segment)
        yield solved(shard)

    dealt = base.select("row", "packed").join(wanted, "row").select("row", "packed", "runs").mapInArrow(
        cut, "piece long, mark binary, row long, first long, segment binary")
    spans = (dealt.repartition(shards, "piece").sortWithinPartitions("piece")
             .mapInArrow(sort, "row long, start long, end long"))
    merged = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return base, materialize(merged, "spans")


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, spans, kept): what is removed of each text, and the bytes that stay.

    Null counts as empty, repeated rows repeat each other's text, other columns are ignored."""
    base, spans = repeated_spans(docs, key, text, length, shard_bytes)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept_of(batch: pa.RecordBatch, sizes: list, cuts: list, kept: list, at: int
                    ) -> pa.RecordBatch:
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([
                batch.column(0).slice(at - len(sizes), len(sizes)), pa.array(sizes, pa.int64()),
                pa.array(cuts, spans), pa.array(kept, pa.binary())],
                names=["key", "n_bytes", "spans", "kept"])

        for batch in batches:
            sizes, cuts, kept = [], [], []
            for at, (packed, found) in enumerate(zip(batch.column(1), batch.column(2))):
                data = zstandard.decompress(packed.as_py())
                runs = _merge(found.as_py())
                edges = [0, *(x for run in runs for x in run), len(data)]
                sizes.append(len(data))
                cuts.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                if sum(sizes) >= UNPACKED_BYTES:
                    yield kept_of(batch, sizes, cuts, kept, at + 1)
                    sizes, cuts, kept = [], [], []
            yield kept_of(batch, sizes, cuts, kept, batch.num_rows)

    return base.join(spans, "row", "left").select("key", "packed", "spans").mapInArrow(
        run, f"`key` {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    ).withColumnRenamed("key", key)


def repeats_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = remove_repeats(docs, key, text)
    return found.select(key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long")
                        .alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
