"""Benchmark decontamination with an Aho-Corasick automaton.

Every window of WINDOW consecutive words of a benchmark item becomes a pattern of one automaton
(a shorter item is one window), and each document is normalised and scanned once. Normalising
replaces single bytes by single bytes, so a word of the normalised text stands at the same place
in the original and every match can be given in characters of the original."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import for_python, free_name, materialize, text_bytes

WINDOW = 13
#: Benchmark text in one automaton, and so the bound of what one broadcast holds.
AUTOMATON_BYTES = 16 << 20
_WORD = {*range(48, 58), *range(97, 123), *range(128, 256)}
_PLAIN = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal_words(data: bytes) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and all non-ASCII characters."""
    return data.translate(_PLAIN).split()


@dataclass
class Found:
    """Hit words as runs [first, last] of word numbers, and the numbers of the items found."""

    words: int
    runs: list[tuple[int, int]]
    items: set[int]

    @property
    def hit(self) -> int:
        return sum(b - a + 1 for a, b in self.runs)

    @property
    def contaminated(self) -> bool:
        return self.hit > 0 and 20 * self.hit >= self.words


class Scanner:
    """The automaton over the windows of some items; text is handled as bytes in Latin-1."""

    def __init__(self, items: Iterable[bytes], window: int = WINDOW):
        owners: dict[bytes, tuple[int, set[int]]] = {}
        for number, data in enumerate(items):
            words = normal_words(data)
            width = min(window, len(words))
            for i in range(len(words) - width + 1 if width else 0):
                pattern = b" %s " % b" ".join(words[i:i + width])
                owners.setdefault(pattern, (width, set()))[1].add(number)
        self.automaton = ahocorasick.Automaton()
        for pattern, owner in owners.items():
            self.automaton.add_word(pattern.decode("latin-1"), owner)
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, data: bytes) -> Found:
        words = normal_words(data)
        found = Found(len(words), [], set())
        if self.empty or not words:
            return found
        text = (b" %s " % b" ".join(words)).decode("latin-1")
        ends = None
        for at, (width, items) in self.automaton.iter(text):
            if ends is None:
                # The blank after word i stands at ends[i].
                ends = np.cumsum([len(w) + 1 for w in words])
            last = int(np.searchsorted(ends, at))
            first = last - width + 1
            # Matches come by their end, but a longer one may begin before the last run does.
            while found.runs and found.runs[-1][1] >= first - 1:
                first = min(first, found.runs.pop()[0])
            found.runs.append((first, last))
            found.items |= items
        return found


def original_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans [start, end) in characters of the original text."""
    if not runs:
        return []
    word = np.frombuffer(data.translate(_PLAIN), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    before = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)))
    return [(int(before[edge[2 * a]]), int(before[edge[2 * b + 1]])) for a, b in runs]


class Parts:
    """The benchmark in parts of about `limit` bytes, of which one at a time is collected,
    broadcast and built into an automaton."""

    def __init__(self, benchmark: DataFrame, item: str, text: str, limit: int):
        self.rows = benchmark.select(F.col(item).cast("string").alias("id"),
                                     text_bytes(F.col(text)).alias("data"))
        size = self.rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        self.count = max(1, -(-size // limit))

    def shared(self, k: int):
        """Broadcast (ids, texts) of a part."""
        part = F.pmod(F.xxhash64("id", "data"), F.lit(self.count))
        some = self.rows.where(part == k).orderBy("id", "data").collect()
        return self.rows.sparkSession.sparkContext.broadcast(
            {"ids": [r["id"] for r in some], "texts": [bytes(r["data"]) for r in some]})

    def scanned(self, df: DataFrame, text: str, last: Callable, schema: T.StructType) -> DataFrame:
        """`last(batch, found)` over batches, with what each text holds of all parts: its number of
        words, runs and item ids. Every part but the last is a pass of its own, whose findings are
        written beside the rows, and its broadcast ends with it."""
        runs, ids = free_name(df, "_runs"), free_name(df, "_ids")
        place, width = df.columns.index(text), len(df.columns)
        kinds = T.StructType([
            *df.schema.fields, T.StructField(runs, T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField(ids, T.ArrayType(T.StringType()))])

        def texts(batch: pa.RecordBatch, one) -> list[tuple[Found, list[str | None]]]:
            scanner, names = _scanner(one)
            found = [scanner.scan(t.as_py() or b"") for t in batch.column(place).cast(pa.binary())]
            out = [(f, [names[i] for i in f.items]) for f in found]
            if batch.num_columns == width:
                return out
            earlier = zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())
            return [(Found(f.words, _merged([*f.runs, *map(tuple, old)]), set()), [*mine, *named])
                    for (f, mine), (old, named) in zip(out, earlier)]

        def passing(one):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = texts(batch, one)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:width],
                         pa.array([f.runs for f, _ in found], pa.list_(pa.list_(pa.int64()))),
                         pa.array([sorted(set(named), key=str) for _, named in found],
                                  pa.list_(pa.string()))],
                        names=[*batch.schema.names[:width], runs, ids])
            return run

        for k in range(self.count - 1):
            one = self.shared(k)
            df = materialize(for_python(df).mapInArrow(passing(one), kinds), "scanned")
            one.destroy()
        one = self.shared(self.count - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield last(batch.select(range(width)), texts(batch, one))

        return for_python(df).mapInArrow(run, schema)


def _scanner(shared) -> tuple[Scanner, list]:
    """The automaton of a broadcast, built once in each Python worker."""
    value = shared.value
    if "scanner" not in value:
        value["scanner"] = Scanner(value["texts"])
    return value["scanner"], value["ids"]


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if runs and a <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


_SCHEMA = ("n_words long, n_hit long, items array<string>, contaminated boolean, "
           "spans array<struct<start: long, end: long>>")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                  text: str = "text", item: str = "item_id", item_text: str = "text",
                  limit: int = AUTOMATON_BYTES) -> DataFrame:
    """Per document: key, n_words, n_hit, items (sorted as strings), contaminated, and the spans
    of the hit words in characters of the text.

    Benchmark text beyond `limit` bytes is dealt to several automata, one of which is held at a
    time: the documents pass them one after the other. A null text has no words; an item without
    words or with a null text has no windows; an item without id counts its hits but is not listed;
    repeated items are listed once; an empty benchmark finds nothing. Other columns are ignored."""
    schema = T.StructType.fromDDL(f"`key` {docs.schema[key].dataType.simpleString()}, {_SCHEMA}")

    def last(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in
                                ("n_words", "n_hit", "items", "contaminated", "spans")}
        for value, (whole, ids) in zip(batch.column(1), found):
            out["n_words"].append(whole.words)
            out["n_hit"].append(whole.hit)
            out["items"].append(sorted({i for i in ids if i is not None}))
            out["contaminated"].append(whole.contaminated)
            out["spans"].append([{"start": a, "end": b}
                                 for a, b in original_spans(value.as_py(), whole.runs)])
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(out["n_words"], pa.int64()),
            pa.array(out["n_hit"], pa.int64()),
            pa.array(out["items"], pa.list_(pa.string())),
            pa.array(out["contaminated"], pa.bool_()),
            pa.array(out["spans"], pa.list_(pa.struct(
                [("start", pa.int64()), ("end", pa.int64())])))],
            names=["key", *out])

    narrow = docs.select(F.col(key).alias("key"), text_bytes(F.col(text)).alias("data"))
    parts = Parts(benchmark, item, item_text, limit)
    return parts.scanned(narrow, "data", last, schema).withColumnRenamed("key", key)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit",
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      item: str = "item_id", item_text: str = "text",
                      limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns kept; nothing is shuffled."""

    def last(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        return batch.filter(pa.array([not f.contaminated for f, _ in found], pa.bool_()))

    return Parts(benchmark, item, item_text, limit).scanned(docs, text, last, docs.schema)
