"""Source divergence, SuperMinHash groups and hard negatives against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import divergence, gnat, superminhash
from tablescope.llm.queries import QUERIES

from ..conftest import SMALL
from . import plain
from .conftest import LONG, ROWS, sentence


def plain_terms(text):
    out, word = [], ""
    for c in plain.lower(text) + " ":
        if "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_divergence(rows, min_docs, top):
    """All pairs and terms by loops over every kept term; rows are (lang, source, text)."""
    out = set()
    said = defaultdict(Counter)
    docs, sources, whole = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", plain_terms(text)
        sources[lang].add(source)
        said[lang, source].update(words)
        whole[lang].update(words)
        docs[lang].update(set(words))
    for lang in sources:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p = {s: shares(said[lang, s]) for s in sources[lang]}
        q = shares(whole[lang])
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources[lang]:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources[lang] - {s}]
            terms = [(t, gap(p[s][t], q[t])) for t in kept
                     if said[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1)
                        for i, (item, value) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("block, terms, held", [(256, 4096, 400_000), (2, 3, 5)])
def test_divergence(spark, monkeypatch, block, terms, held):
    """Several blocks of sources and terms, copies within and across sources, a source without
    terms, a language without kept terms, nulls."""
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    monkeypatch.setattr(divergence, "TERM_BLOCK", terms)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(block)
    words = [f"Wort{chr(97 + i)}" for i in range(12)] + ["été", "x9y", "don't"]
    rows = [(rng.choice(["en", "de", None]), rng.choice([f"s{i}" for i in range(6)] + [None]),
             " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for _ in range(150)]
    rows += [("en", "s1", "same text words")] * 30 + [("de", "s2", "same text words")] * 12
    rows += [("xx", "a", "rare"), ("xx", "b", None), ("xx", "c", ""), ("en", "mute", "1 2 3")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    found = divergence.divergence(df, min_docs=5, top=3).collect()
    got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found}
    assert len(got) == len(found) and got == plain_divergence(rows, 5, 3)


def test_divergence_odd_rows(odd, nothing):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    found = divergence.divergence(odd, min_docs=1).collect()
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank"))
            for r in found} == plain_divergence(rows, 1, 10)
    assert divergence.divergence(nothing).collect() == []


def test_shares_are_exact_beyond_a_long(spark):
    cases = [(0, 2), (5, 7), (10**12, 3 * 10**13 + 1), (10**15, 10**15 + 7), (8 * 10**15, 8 * 10**15 + 9)]
    df = spark.createDataFrame(cases, "n long, total long")
    got = df.select("n", "total", divergence._share(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 2) // r["total"] for r in got)


def plain_set(text):
    words = plain.WORD.findall(plain.lower(text))
    return {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_groups(texts):
    """Smallest reachable id by id, from texts by id."""
    sets = {d: plain_set(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_superminhash_query(spark, texts):
    rows = QUERIES["op12_superminhash_near_dedup"](spark, SMALL).collect()
    want = plain_groups(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("piece", [3, 2048])
def test_families_about_the_threshold(spark, piece):
    """Texts of one origin whose similarities lie on both sides of the threshold, chains of them
    and copies: the second round must find what centres miss, in several pieces."""
    rng = random.Random(piece)
    texts = {}
    for family in range(3):
        base = sentence(100 + family, 120).split()
        for _ in range(25):
            words = list(base)
            for at in rng.sample(range(120), rng.randrange(0, 7)):
                words[at] = f"new{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
    walk = sentence(200, 150).split()
    for step in range(12):
        walk = walk[3:] + [f"walk{step}x{i}" for i in range(3)]
        texts[len(texts)] = " ".join(walk)
    texts |= {900: texts[4], 901: None, 902: "", 903: "two words", 904: "Two  Words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = superminhash.near_groups(df, piece=piece).collect()
    want = plain_groups(texts)
    assert len({root for _, root in want.values()}) > 8
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_signatures():
    """The rate of equal places is the similarity, with less variance than independent places; a
    set in several parts gives the signature of the whole."""
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = np.sort(x[:120]), np.sort(x[30:])
        one, two = superminhash.signatures([a, b])
        errors.append((one == two).mean() - 90 / 150)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.6 * 0.4 / 128) ** 0.5
    x = np.unique(rng.integers(0, 2**63, 70_000).astype(np.uint64))
    whole = superminhash.signatures([x])[0]
    part = np.full((1, 128), np.iinfo(np.uint64).max, np.uint64)
    for piece in np.array_split(rng.permutation(x), 7):
        superminhash._take_in(part, np.zeros(len(piece), np.int64), piece)
    assert (whole == part[0]).all()
    assert (superminhash.signatures([x[:0]])[0] == np.iinfo(np.uint64).max).all()


def test_superminhash_odd_rows(spark, odd, nothing):
    rows = superminhash.near_groups(odd).collect()
    by_id = {d: t for d, t, _ in ROWS if d is not None}
    want = plain_groups(by_id)
    assert len(rows) == len(ROWS)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
               for r in rows if r["doc_id"] is not None)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert superminhash.near_report(nothing).collect() == []
    named = spark.createDataFrame([("d0", LONG), ("d1", LONG + " end"), ("d2", "x")],
                                  "doc_id string, text string")
    assert {tuple(r)[0]: r["component_id"] for r in superminhash.near_groups(named).collect()} == {
        "d0": "d0", "d1": "d0", "d2": "d2"}


def plain_negatives(rows):
    """Rows are (vec_id, vector, label) as the table holds them."""
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(v, float)))
            for i, v, lab in rows if i is not None and lab is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in good), default=0)
    good = [(i, lab, np.pad(v, (0, width - len(v))).astype(int)) for i, lab, v in good]
    out = set()
    for i, lab, v in good:
        if i % 50:
            continue
        score = sorted((-int(v @ w), j, other == lab) for j, other, w in good if j != i)
        for p, j, same in [s for s in score if s[2]][:5]:
            p = -p
            fit = [(-s, k) for s, k, same in score
                   if not same and 50 * p <= -100 * s <= 95 * p][:3]
            out |= {(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(fit)}
    return out


NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("cell_rows, piece, leaf, queries", [
    (2048, 32768, 256, 4096), (60, 40, 8, 3)])
def test_hard_negatives(spark, monkeypatch, cell_rows, piece, leaf, queries):
    """Clusters, equal vectors, ties, small labels; one cell, and many cells in pieces."""
    monkeypatch.setattr(gnat, "LEAF", leaf)
    monkeypatch.setattr(gnat, "QUERIES", queries)
    rng = np.random.default_rng(cell_rows)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(700):
        v = centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.0, 0.1, 1.0])
        rows.append((i, [float(x) for x in np.round(v, 2)], int(rng.integers(4)) if i % 9 else 8))
    rows += [(1000, None, 1), (1050, [1.0] * 8, None), (1100, [float("nan")] * 8, 2),
             (1150, [None] + [1.0] * 7, 2), (1200, [0.0] * 8, 3), (1250, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    clean = gnat.clean_vectors(df).withColumn(
        "label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = gnat.hard_negatives(clean, clean.where("id % 50 = 0"), cell_rows=cell_rows, piece=piece)
    got = [tuple(r[c] for c in NEGATIVE) for r in found.collect()]
    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab)
              for i, v, lab in rows]
    assert len(set(got)) == len(got) and set(got) == plain_negatives(stored)


def test_ranges_rule_cells_out():
    """A window of high scores in tight clusters leaves few children, and never one that holds a row."""
    rng = np.random.default_rng(4)
    x = np.floor(np.repeat(rng.normal(size=(8, 16)), 100, axis=0) * 256 + rng.normal(size=(800, 16)))
    tree = gnat.Tree(x)
    query = x[::50]
    score = query @ x.T
    low, high = np.sort(score, axis=1)[:, -20], np.full(len(query), 2.0**52)
    alive = tree.ranges.alive(query, low, high)
    assert alive.sum(axis=1).max() <= 3
    for c, child in enumerate(tree.children):
        inside = (score[:, child.rows] >= low[:, None]).any(axis=1)
        assert (alive[:, c] | ~inside).all()


def test_negatives_odd_rows(spark, odd):
    schema = "vec_id long, embedding array<float>, label int, id string, v int, cell int, low int"
    empty = spark.createDataFrame([], schema)
    assert gnat.negatives_report(empty).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "x", 1, 1, 1)], schema)
    assert gnat.negatives_report(one).collect() == []
    rows = [(50 * i, [1.0, 0.5 * i] + [0.25] * (i % 2), i % 2) for i in range(8)]
    mixed = spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], schema)
    got = {tuple(r[c] for c in NEGATIVE) for r in gnat.negatives_report(mixed).collect()}
    assert got == plain_negatives(rows)
