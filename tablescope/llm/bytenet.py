"""A byte-level convolutional classifier in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Bytes are embedded,
learned filters slide over each chunk, every filter keeps its largest response in the chunk, and a
small dense layer turns those into the chunk's log-odds; the mean over all chunks is the
document's. Training takes place on the driver, on chunks of at most `per_class` labelled
documents of either class and CHUNKS_PER_DOC chunks of each, spread over the whole document;
scoring reads every byte of every document, in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, text_bytes

CHUNK, STEP = 512, 448
WIDTH, STRIDE, BYTE_DIMS, FILTERS, HIDDEN = 6, 3, 8, 48, 16
PER_CLASS = 1000
CHUNKS_PER_DOC = 6
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 600, 32, 4e-3
THRESHOLD = 0.7
_BLOCK = 256


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of n bytes start; the last one ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - CHUNK, STEP), n - CHUNK)


def chunks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The chunks as rows of bytes; a text shorter than a chunk is filled up with zeros."""
    text = np.frombuffer(data, np.uint8)
    if len(text) < CHUNK:
        text = np.concatenate((text, np.zeros(CHUNK - len(text), np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(text, CHUNK)[starts]


@dataclass
class Net:
    """The weights; without training it holds only the log-odds of the labels."""

    weights: dict[str, np.ndarray] | None
    prior: float

    @staticmethod
    def fresh(rng: np.random.Generator, prior: float) -> Net:
        def normal(scale: float, *shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        taps = WIDTH * BYTE_DIMS
        return Net({"byte": normal(1.0, 256, BYTE_DIMS), "filter": normal(taps ** -0.5, taps, FILTERS),
                    "bias": np.zeros(FILTERS, np.float32),
                    "dense": normal(FILTERS ** -0.5, FILTERS, HIDDEN),
                    "dense_bias": np.zeros(HIDDEN, np.float32),
                    "out": normal(HIDDEN ** -0.5, HIDDEN), "out_bias": np.zeros(1, np.float32)},
                   prior)

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Embedded windows (chunk, place, WIDTH · BYTE_DIMS)."""
        embedded = self.weights["byte"][rows].reshape(len(rows), CHUNK * BYTE_DIMS)
        seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * BYTE_DIMS, axis=1)
        return np.ascontiguousarray(seen[:, ::STRIDE * BYTE_DIMS])

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """One value for each chunk."""
        if self.weights is None:
            return np.zeros(len(rows))
        w, out = self.weights, []
        for at in range(0, len(rows), _BLOCK):
            seen = self.windows(rows[at:at + _BLOCK])
            peak = np.maximum((seen @ w["filter"]).max(axis=1) + w["bias"], 0)
            hidden = np.maximum(peak @ w["dense"] + w["dense_bias"], 0)
            out.append(hidden @ w["out"] + w["out_bias"])
        return np.concatenate(out).astype(np.float64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text, from all of its chunks."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        rows, owners = [], []

        def flush() -> None:
            if rows:
                owner = np.concatenate(owners)
                total[:] += np.bincount(owner, self.log_odds(np.concatenate(rows)), len(texts))
                rows.clear()
                owners.clear()

        held = 0
        for i, data in enumerate(texts):
            starts = chunk_starts(len(data))
            count[i] = len(starts)
            for at in range(0, len(starts), _BLOCK):
                part = starts[at:at + _BLOCK]
                rows.append(chunks(data, part))
                owners.append(np.full(len(part), i))
                held += len(part)
                if held >= _BLOCK:
                    flush()
                    held = 0
        flush()
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.prior, -50, 50)))


def _gradient(net: Net, rows: np.ndarray, owner: np.ndarray, label: np.ndarray
              ) -> dict[str, np.ndarray]:
    """Gradient of the mean logistic loss of documents, given as chunks with their owner."""
    w, docs = net.weights, len(label)
    seen = net.windows(rows)
    reply = seen @ w["filter"]
    where = reply.argmax(axis=1)
    peak = np.maximum(np.take_along_axis(reply, where[:, None], 1)[:, 0] + w["bias"], 0)
    hidden = np.maximum(peak @ w["dense"] + w["dense_bias"], 0)
    odds = hidden @ w["out"] + w["out_bias"]
    count = np.bincount(owner, minlength=docs)
    mean = np.bincount(owner, odds, docs) / count
    off = ((1 / (1 + np.exp(-mean)) - label) / docs / count)[owner].astype(np.float32)
    d_hidden = off[:, None] * w["out"] * (hidden > 0)
    d_peak = d_hidden @ w["dense"].T * (peak > 0)
    best = seen[np.arange(len(rows))[:, None], where]
    d_best = d_peak[:, :, None] * w["filter"].T
    d_byte = np.zeros_like(w["byte"])
    taps = where[:, :, None] * STRIDE + np.arange(WIDTH)
    symbols = rows[np.arange(len(rows))[:, None, None], taps]
    np.add.at(d_byte, symbols.ravel(), d_best.reshape(-1, BYTE_DIMS))
    return {"byte": d_byte, "filter": np.einsum("nf,nft->tf", d_peak, best),
            "bias": d_peak.sum(axis=0), "dense": peak.T @ d_hidden,
            "dense_bias": d_hidden.sum(axis=0), "out": hidden.T @ off, "out_bias": off.sum(keepdims=True)}


def fit(samples: list[np.ndarray], labels: list[int], prior: float, seed: int = 42) -> Net:
    """Train on the chunks of documents by Adam; `prior` is the log-odds of label 1 in the
    corpus against those among the samples. With one class only, the prior is all there is."""
    if len(set(labels)) < 2:
        return Net(None, prior)
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng, 0.0)
    truth = np.array(labels, np.float64)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    each = -(-len(samples) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            mine = order[at:at + BATCH]
            rows = np.concatenate([samples[i] for i in mine])
            owner = np.repeat(np.arange(len(mine)), [len(samples[i]) for i in mine])
            steps += 1
            rate = RATE * (1 - 0.9 * steps / total)
            for k, g in _gradient(net, rows, owner, truth[mine]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] -= (rate * (first[k] / (1 - 0.9 ** steps)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32)
    return Net(net.weights, prior)


def held_out(key: Column) -> Column:
    """True for a quarter of all ids, whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", per_class: int = PER_CLASS, seed: int = 42) -> Net:
    """Fit a net on at most `per_class` documents of either label, taken by a hash of their id.

    Rows that are held out, have no id or no label 0 or 1 are not learned from, and of repeated
    labels each counts. Documents without a label don't matter here."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(
        F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    some = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(
            F.xxhash64(F.lit(seed), "key"), "key").limit(per_class)
        some = part if some is None else some.union(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for number, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                starts = chunk_starts(len(data))
                if len(starts) > CHUNKS_PER_DOC:
                    rng = np.random.default_rng([seed, number & 0xFFFFFFFF])
                    starts = rng.choice(starts, CHUNKS_PER_DOC, replace=False)
                parts.append(chunks(data, starts).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.binary())],
                names=["mark", "label", "chunks"])

    # At most 2 · per_class ids: small enough to be sent to every reader of the documents.
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(some), "key").select(
            F.xxhash64("key").alias("mark"), "label", text_bytes(F.col("text")).alias("data"))
    rows = for_python(chosen).mapInArrow(cut, "mark long, label int, chunks binary").orderBy(
        "mark", "label", "chunks").limit(2 * per_class).collect()
    samples = [np.frombuffer(bytes(r["chunks"]), np.uint8).reshape(-1, CHUNK) for r in rows]
    values = [r["label"] for r in rows]
    used = [values.count(0) + 1, values.count(1) + 1]
    whole = [counts.get(0, 0) + 1, counts.get(1, 0) + 1]
    prior = np.log(whole[1] / whole[0])
    return fit(samples, values, float(prior - np.log(used[1] / used[0]) if len(set(values)) > 1
                                      else prior), seed)


def classify(docs: DataFrame, net: Net, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for all documents. A null or empty text is one chunk of zeros."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = net.score([x.as_py() for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)],
                                             names=["key", "score"])

    narrow = docs.select(F.col(key).alias("key"), text_bytes(F.col(text)).alias("data"))
    return for_python(narrow).mapInArrow(run, f"`key` {kind}, score double").withColumnRenamed("key", key)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    scored = classify(docs, train(docs, labels, key), key)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
