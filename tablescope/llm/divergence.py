"""How the sources of a language differ in their words: an audit of all pairs of sources.

Identical texts of a language are collapsed first: a text travels and is tokenized once, however
many copies of it there are, and its counts are added once per source with the number of copies
there as weight. What is left per (lang, source, term) is a sparse table of counts and document
counts; all later steps work on it.

A pair of sources is compared over all kept terms, also those that one or both lack. Terms that
both lack add one constant, terms that one lacks depend on the other's count only, so they are
summed from the histogram of counts of a source; only terms that both have are met, dealt by
blocks of terms and of sources. A task adds its pairs up and emits one row per pair of sources."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import for_python, materialize, text_bytes

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Sources and terms of a block, and (source, term) sums a task holds before it hands them on.
SOURCE_BLOCK = 256
TERM_BLOCK = 4096
HELD = 400_000
#: Letters A-Z in lower case; bytes that belong to no term become blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and of any characters beyond ASCII."""
    return data.translate(_TERMS).split()


def _collapsed(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, digest, source, copies, data): a text of a language once per source that has it.

    Only the digest, not the text, is grouped by source; rows come in order of (lang, digest)."""
    named = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        text_bytes(F.col(text)).alias("data"))
    told = named.withColumn("digest", F.unhex(F.sha2("data", 256)))
    texts = told.groupBy("lang", "digest").agg(F.first("data").alias("data"))
    copies = told.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("copies"))
    # A merge join hands the copies of a text on one after the other.
    return texts.join(copies.hint("merge"), ["lang", "digest"]).select(
        "lang", "digest", "source", "copies", "data")


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (lang, source, term, n, docs) of the collapsed texts of a partition."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    last, words, once, times = None, [], set(), Counter()

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sums.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()),
                 pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(list(n.values()), pa.int64()),
                 pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        sums.clear()

    for batch in batches:
        lang, digest, source, copies, data = batch.columns
        for i in range(batch.num_rows):
            key = (lang[i].as_py(), digest[i].as_py())
            if key != last:
                last, words = key, terms_of(data[i].as_py())
                once, times = set(words), Counter()
            n, docs = sums[key[0], source[i].as_py()]
            weight = copies[i].as_py()
            if weight == 1:
                n.update(words)
                docs.update(once)
                continue
            times = times or Counter(words)
            for term, k in times.items():
                n[term] += weight * k
                docs[term] += weight
        if sum(len(n) for n, _ in sums.values()) > HELD:
            yield from handed()
    yield from handed()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source",
                text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term, and documents that have it."""
    collapsed = for_python(_collapsed(docs, lang, source, text))
    return collapsed.mapInArrow(
        _weighted, "lang string, source string, term string, n long, docs long").groupBy(
            "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exact by long division in steps of a thousand,
    so that no product leaves the range of a long while total is below 9 * 10^15."""
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _dealt_to_pairs(rows: DataFrame) -> DataFrame:
    """Rows of a block of sources once for each block that it is paired with."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("other", other).withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other")})


def _pairs(names: np.ndarray, block: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each pair of places whether its sum belongs to this pair of blocks: a before b."""
    before = names[:, None] < names[None, :]
    if low == high:
        return before
    return before & (block[:, None] != block[None, :])


def _emit(lang: str, names: np.ndarray, total: np.ndarray, wanted: np.ndarray) -> pd.DataFrame:
    a, b = np.nonzero(wanted)
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[b], "value": total[a, b]})


def _one_sided(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of pairs of sources as if no term were common to both; rows are counts of sources
    (p, k terms with it), a row with k null per source."""
    lang, low, high = rows["lang"].iat[0], rows["low"].iat[0], rows["high"].iat[0]
    heads = rows[rows["k"].isna()].sort_values("source")
    names = heads["source"].to_numpy(object)
    empty, kept = heads["p"].to_numpy(np.int64), heads["kept"].to_numpy(np.int64)
    place = {s: i for i, s in enumerate(names)}
    total = kept[:, None] * _gaps(empty[:, None], empty[None, :])
    for source, own in rows[rows["k"].notna()].groupby("source"):
        a = place[source]
        p, k = own["p"].to_numpy(np.int64), own["k"].to_numpy(np.int64)
        more = np.zeros(len(names), np.int64)
        for at in range(0, len(p), 4096):
            part = slice(at, at + 4096)
            more += (k[part, None] * (_gaps(p[part, None], empty[None, :])
                                      - _gaps(empty[a], empty)[None, :])).sum(axis=0)
        total[a] += more
        total[:, a] += more
    return _emit(lang, names, total, _pairs(names, heads["block"].to_numpy(), low, high))


def _both_sided(rows: pd.DataFrame) -> pd.DataFrame:
    """What common terms of pairs of sources add to the one-sided sums, for a block of terms."""
    lang, low, high = rows["lang"].iat[0], rows["low"].iat[0], rows["high"].iat[0]
    names, who = np.unique(rows["source"].to_numpy(object), return_inverse=True)
    first = np.unique(who, return_index=True)[1]
    block, empty = rows["block"].to_numpy()[first], rows["empty"].to_numpy(np.int64)[first]
    term = np.unique(rows["term"].to_numpy(object), return_inverse=True)[1]
    p = rows["p"].to_numpy(np.int64)
    by_term = np.argsort(term, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(term))))
    total = np.zeros((len(names), len(names)), np.int64)
    by_source = np.argsort(who, kind="stable")
    for mine in np.split(by_source, np.cumsum(np.bincount(who))[:-1]):
        a, at = who[mine[0]], start[term[mine]]
        n = start[term[mine] + 1] - at
        met = by_term[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]
        own, b = np.repeat(p[mine], n), who[met]
        none = np.full(len(met), empty[a])
        np.add.at(total[a], b, _gaps(own, p[met]) - _gaps(own, empty[b])
                  - _gaps(none, p[met]) + _gaps(none, empty[b]))
    return _emit(lang, names, total, _pairs(names, block, low, high))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Part `pair` ranks the other sources of the language by how far their shares of the language's
    kept terms lie from the source's, part `term` the `top` terms that the source has more of than
    the language. Kept are terms in at least `min_docs` documents of the language. Null text, lang
    and source count as ''; equal rows are documents of their own; a language without kept terms
    has pairs of value 0 and no terms; an empty table gives no rows; other columns are ignored.
    Ties go to the item that is smaller in UTF-8. Counts of a source must sum up to less than
    9 * 10^15."""
    counts = materialize(term_counts(docs, lang, source, text), "terms")
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("in"))
    vocabulary = materialize(whole.where(F.col("in") >= min_docs).drop("in"), "vocabulary")
    languages = vocabulary.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_total"))
    used = counts.join(vocabulary, ["lang", "term"]).drop("docs")

    groups = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    blocks = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).cast("int").alias("blocks"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = materialize(
        groups.join(languages, "lang", "left").join(totals, ["lang", "source"], "left")
        .join(blocks, "lang").select(
            "lang", "source", F.coalesce("kept", none).alias("kept"), "blocks",
            F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
            (F.coalesce("total", none) + 2 * F.coalesce("kept", none)).alias("over"),
            (F.col("lang_total") + 2 * F.col("kept")).alias("lang_over")), "groups")
    share = F.when(F.col("over") > 0, _share(none, F.col("over"))).otherwise(F.lit(1))
    shares = materialize(used.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "kept", "blocks", "block",
        _share(F.col("n"), F.col("over")).alias("p"), share.alias("empty"),
        _share(F.col("all_n"), F.col("lang_over")).alias("q")), "shares")

    return _ranked_pairs(groups, shares, share).unionByName(_ranked_terms(shares, top))


def _ranked_pairs(groups: DataFrame, shares: DataFrame, share: Column) -> DataFrame:
    base = ["lang", "source", "kept", "blocks", "block", "p"]
    histogram = shares.groupBy(*base).agg(F.count(F.lit(1)).alias("k"))
    heads = groups.withColumn("p", share).select(*base, F.lit(None).cast("long").alias("k"))
    schema = "lang string, a string, b string, value long"
    alone = _dealt_to_pairs(histogram.unionByName(heads)).groupBy("lang", "low", "high").applyInPandas(
        _one_sided, schema)
    piece = F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / TERM_BLOCK).cast("int"))
    shared = _dealt_to_pairs(shares.withColumn("piece", piece)).select(
        "lang", "low", "high", "piece", "source", "block", "term", "p", "empty").groupBy(
            "lang", "low", "high", "piece").applyInPandas(_both_sided, schema)
    sums = alone.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(sums.select("lang", sides.alias("side"), "value").select(
        "lang", "side.source", F.lit("pair").alias("part"), "side.item", "value"))


def _ranked_terms(shares: DataFrame, top: int) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    more = shares.where(p > q).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _gap(p, q).alias("value"))
    return _ranked(more).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
