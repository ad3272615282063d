"""Near and substring dedup, mixing, sharding, WARC records and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tablescope.llm import chaining, components, cube, induced, jump, simhash, suffixes, warc
from tablescope.llm.minima import least_places
from tablescope.llm.queries import QUERIES

from ..conftest import SMALL
from . import plain
from .conftest import LONG, ROWS, sentence


def test_fingerprints(texts):
    for text in [*list(texts.values())[:30], "", " ", "One", "one TWO", "Été É \U0001f600 x", LONG]:
        assert simhash.fingerprint(text.encode()) == plain.fingerprint(text)
    blocks = list(simhash.word_blocks(LONG.encode(), 100))
    assert len(blocks) > 1000 and sum(blocks, []) == LONG.encode().split()


def test_simhash_query(spark, texts):
    rows = QUERIES["op10_simhash_near_dedup"](spark, SMALL).collect()
    prints = {d: plain.fingerprint(t) for d, t in texts.items()}
    root = plain.groups(prints)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (d, f"{prints[d]:016x}", root[d]) for d in prints}


@pytest.mark.parametrize("shard", [2, 5, 100])
def test_links_of_close_prints(spark, shard):
    """Chains of prints a few bits apart, in shards that must be cut into pieces."""
    rng = random.Random(shard)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(10):
            prints.append(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    by_id = {i: x for i, x in enumerate(dict.fromkeys(prints))}
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x, i) for i, x in by_id.items()],
                               "fp long, rep long")
    found = components.components(simhash.link(df, shard=shard)).collect()
    want = plain.groups(by_id)
    assert {i: want[i] for i in want} == {i: i for i in want} | {r["id"]: r["root"] for r in found}


def test_bk_tree_follows_only_near_edges():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 300).astype(np.uint64)
    fp = np.unique(np.concatenate((fp, fp[:100] ^ np.uint64(5))))
    forest = simhash.Forest(np.zeros(len(fp), np.int64), fp)
    parent = forest.edge // 65
    assert (np.bitwise_count(fp[parent] ^ fp[forest.child]) == forest.edge % 65).all()
    got = {(int(q), int(n)) for qs, ns in forest.search(fp, np.zeros(len(fp), np.int64), 3)
           for q, n in zip(qs, ns)}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["root"] for r in found} == {i: 0 for i in range(1, 51)} | {
        100 + k: 100 for k in range(1, 60)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_simhash_odd_rows(odd, nothing):
    rows = simhash.simhash_groups(odd).collect()
    prints = {d: plain.fingerprint(t) for d, t, _ in ROWS if d is not None}
    root = plain.groups(prints)
    assert len(rows) == len(ROWS)
    assert all(r["component_id"] == (None if r["doc_id"] is None else root[r["doc_id"]]) for r in rows)
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(set(root.values())) + Counter(
        {None: 2})
    assert simhash.simhash_groups(nothing).collect() == []
    assert simhash.drop_near_copies(nothing).collect() == []


def test_different_texts_of_one_id_stay(spark):
    """Rows are near copies by their texts only, whatever ids they repeat."""
    a, b, c = (sentence(k, 80) for k in (61, 62, 63))
    rows = [(1, a), (1, b), (2, a), (3, b), (3, c), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = sorted(map(tuple, simhash.drop_near_copies(df).collect()))
    assert left == sorted([(1, a), (1, b), (3, c)])


def test_suffix_order():
    rng = np.random.default_rng(1)
    for trial in range(200):
        text = np.append(rng.integers(1, [2, 3, 5, 250][trial % 4] + 1, rng.integers(1, 150)), 0)
        order = induced.suffix_order(text, 10**6, [10**9, 64][trial % 2])
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert order.tolist() == want
        data = text.astype(np.uint8)
        shared = induced.common_prefix(data, order, 40)
        for k in range(1, len(order)):
            a, b = (data[i:].tobytes() + b"\0" * 40 for i in (order[k - 1], order[k]))
            same = next((m for m in range(40) if a[m:m + 1] != b[m:m + 1]), 40)
            assert min(same, 40) == shared[k]


def test_common_prefix_looks_far_ahead_once_a_run(monkeypatch):
    """Places in a row whose suffixes follow places in a row share bytes up to the same end."""
    rng = np.random.default_rng(4)
    data = np.tile(rng.integers(0, 250, 5_000).astype(np.uint8), 2)
    data[7_500] = 251
    order = induced.suffix_order(np.append(data.astype(np.int16) + 1, 0).astype(np.int16), 400,
                                 10**9)[1:]
    looked, far = [], induced._shared

    def counted(*args):
        looked.append(far(*args))
        return looked[-1]

    monkeypatch.setattr(induced, "_shared", counted)
    shared = induced.common_prefix(data, order, 400)
    assert (np.concatenate(looked) >= 8).sum() < 50 < 4_000 < (shared >= 8).sum()
    for k in range(1, len(order), 7):
        a, b = (data[i:i + 400].tobytes().ljust(400, b"\0") for i in (order[k - 1], order[k]))
        assert shared[k] == next((m for m in range(400) if a[m] != b[m]), 400)


def test_least_places():
    rng = np.random.default_rng(2)
    for n, width in ((1, 1), (5, 7), (20, 3), (300, 16), (40, 40)):
        rank = rng.integers(0, 6, n).astype(np.uint64)
        want = [i + int(rank[i:i + width].argmin()) for i in range(n - width + 1)]
        assert least_places(rank, width).tolist() == want


def test_suffix_query(spark, texts):
    rows = QUERIES["op8_suffix_array_dedup"](spark, SMALL).collect()
    want = plain.removed(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
            for r in rows} == want


@pytest.mark.parametrize("shard_bytes, stretch", [(200, 1 << 22), (1 << 22, 1 << 22), (500, 64)])
def test_repeats_of_short_strings(spark, monkeypatch, shard_bytes, stretch):
    """Small alphabets, overlaps, repeats inside one text, common pieces; several small shards."""
    monkeypatch.setattr(suffixes, "QUEUE_BYTES", 64)
    monkeypatch.setattr(suffixes, "UNPACKED_BYTES", 64 if stretch > 64 else 4 << 20)
    monkeypatch.setattr(suffixes, "COMMON_DOCS", 4)
    monkeypatch.setattr(suffixes, "_STRETCH", stretch)
    rng = random.Random(shard_bytes)
    line = "the very common line of many documents, "
    texts = {i: "".join(rng.choices(["ab", "abc", "x", "é", line], [4, 4, 1, 1, 3], k=25))
             for i in range(30)}
    texts |= {40: "a" * 300, 41: texts[3], 42: None, 43: "", 44: texts[5] * 3, 45: "short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    length = 40 if stretch > 64 else 60
    rows = suffixes.remove_repeats(df, length=length, shard_bytes=shard_bytes).collect()
    want = plain.removed(texts, length)
    for r in rows:
        gone = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], gone, len(r["spans"])) == want[r["doc_id"]][:3], r["doc_id"]


def test_suffix_odd_rows(odd, nothing):
    rows = suffixes.repeats_report(odd).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[4]["n_bytes"] == by[3]["n_bytes"] == 0
    assert by[5]["n_removed"] == len(LONG) and by[6]["n_removed"] == len(LONG)
    assert suffixes.repeats_report(nothing).collect() == []


def test_chains():
    for _ in range(30):
        rng = random.Random(_)
        anchors = np.array([[rng.randrange(60), rng.randrange(60), rng.randrange(5, 9)]
                            for _ in range(12)])

        def best(i):
            """Score of the best chain that ends in anchor i, by trying all predecessors."""
            a, b, n = anchors[i]
            return n + max([0.0] + [best(j) - chaining.GAP_COST * (a - p - m + b - q - m)
                                    for j, (p, q, m) in enumerate(anchors)
                                    if p + m <= a and q + m <= b])

        first = chaining.chains(anchors)[0]
        score = sum(int(anchors[i][2]) for i in first) - sum(
            chaining.GAP_COST * int(anchors[j][0] - anchors[i][0] + anchors[j][1] - anchors[i][1]
                                    - 2 * anchors[i][2]) for i, j in zip(first, first[1:]))
        assert score == max(best(i) for i in range(len(anchors)))
        assert sorted(i for c in chaining.chains(anchors) for i in c) == list(range(12))


@pytest.mark.parametrize("strip", [1 << 15, 3])
def test_common_words_of_long_texts(monkeypatch, strip):
    """Words put into one side of a long text, and strips much shorter than the texts."""
    a = [b"%d" % i for i in range(40_000)]
    new = [b"n%d" % i for i in range(8_000)]
    if strip > 3:
        assert chaining.common_words(a[:4_000] + new + a[4_000:], a) == 40_000
        assert chaining.common_words([b"x", *a[:4_000], *new, *a[4_000:], b"y"],
                                     [b"z", *a, b"q"]) == 40_000
    rng = random.Random(6)
    texts = [[[b"%d" % rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2)]
             for _ in range(100)]
    whole = [chaining.common_words(*t) for t in texts]
    monkeypatch.setattr(chaining, "_ALIGNED", strip)
    assert [chaining.common_words(*t) for t in texts] == whole


def test_common_words():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([b"%d" % rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1],
                                                                         table[i + 1][j])
        assert chaining.common_words(a, b) == table[-1][-1]


def test_passages(spark):
    """Planted passages, exact and with words changed, left out or put in; nothing else."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    fuzzy = [w if rng.random() > 0.06 else "zz" for w in passage]
    del fuzzy[20]
    fuzzy.insert(40, "new")
    half, short = passage[:30], passage[:40]
    rows, holders = [], {}
    for k, inside in enumerate([half, passage, fuzzy, passage, short, [], half]):
        text = f"{sentence(10 + k, 30)} {' '.join(inside).upper()}\n{sentence(50 + k, 200)}"
        rows.append((k, text))
        holders[k] = inside
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = chaining.passages(df).collect()
    assert {r["doc_id"] for r in found} | {r["other_id"] for r in found} == {1, 2, 3}
    for r in found:
        if r["doc_id"] == 3 and r["other_id"] == 1:
            assert (r["start"], r["end"], r["similarity"]) == (30, 90, 1.0)


def test_common_passage_is_linear(spark):
    rows = [(k, f"{sentence(10 + k, 40)} {sentence(3, 60)}") for k in range(60)]
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} | {r["other_id"] for r in found} == set(range(60))
    assert len(found) <= 2 * 60


def test_passages_in_rounds(spark, monkeypatch):
    """What is sent beyond a number of bytes goes in rounds, which find what one round finds, of seeds
    of one part and of several."""
    rng = random.Random(3)
    passage = sentence(1, 70).split()
    rows = [(k, f"{sentence(10 + k, 15)} "
                f"{' '.join(w if rng.random() > 0.06 else f'new{k}x{i}' for i, w in enumerate(passage))} "
                f"{sentence(50 + k, 15)}") for k in range(9)]
    rows += [(20, rows[0][1]), (21, None)]
    monkeypatch.setattr(chaining, "PART_HOLDERS", 4)
    written, write = [], chaining.Tables.write

    def counted(tables, df, label):
        out = write(tables, df, label)
        written.append(label)
        return out

    monkeypatch.setattr(chaining.Tables, "write", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, chaining.passages(docs).collect()))
    assert [written.count(label) for label in ("met", "chains", "checked")] == [1, 1, 1]
    written.clear()
    assert [chaining._rounds(size, 10) for size in (0, 9, 25)] == [1, 1, 3]
    monkeypatch.setattr(chaining, "_rounds", lambda size, most: 3 if size > 2000 and most >= 1 << 28 else 1)
    assert sorted(map(tuple, chaining.passages(docs).collect())) == whole
    assert all(written.count(label) == 3 for label in ("met", "chains", "slices", "checked"))
    assert len({(a[0], a[3]) for a in whole}) > 30


@pytest.mark.parametrize("order", [[0, 1, 2, 2, 0, 1], [0, 1, 2, 0, 1, 2, 0, 1]])
def test_holders_of_parts_hide_no_passage(spark, order):
    """Two documents share 52 words; those before, between and after hold 49 of them."""
    passage = sentence(3, 52).split()
    held = [passage[:49], passage[3:], passage]
    rows = [(k, f"{sentence(10 + k, 40)} {' '.join(held[h])} {sentence(50 + k, 40)}")
            for k, h in enumerate(order)]
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    b, c = (k for k, h in enumerate(order) if h == 2)
    assert (b, c) in {(r["other_id"], r["doc_id"]) for r in found if r["similarity"] == 1.0}


def test_neighbours(spark):
    """Holders across many ranges, against all rows sorted at once."""
    rng = random.Random(8)
    rows = sorted({(rng.randrange(4) and 1, rng.randrange(300), rng.randrange(50))
                   for _ in range(1500)})
    want = set()
    for seed in {s for s, _, _ in rows}:
        places = {}
        for s, r, p in rows:
            if s == seed:
                places.setdefault(r, []).append(p)
        holders = sorted(places)
        for a, b in zip(holders, holders[1:]):
            want |= {(a, b, places[a][-1], p) for p in places[b]}
            want |= {(a, b, p, places[b][0]) for p in places[a]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "seed long, row long, place long")
        found = {tuple(r) for r in chaining._neighbours(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == want


def test_every_five_words_in_a_row_are_a_seed(spark):
    """Passages with 15 % of their words changed evenly, and one with a single run of five."""
    rows = []
    for k in range(20):
        passage = sentence(100 + k, 60).split()
        changed = {round(20 * i / 3) for i in range(9)}
        if not k:
            changed = {*range(4, 25, 5), *range(30, 60, 5)}
        other = [f"new{k}x{i}" if i in changed else w for i, w in enumerate(passage)]
        rows += [(2 * k, f"{sentence(200 + k, 90)} {' '.join(passage)} {sentence(300 + k, 90)}"),
                 (2 * k + 1, f"{sentence(400 + k, 70)} {' '.join(other)} {sentence(500 + k, 70)}")]
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["other_id"], r["doc_id"]) for r in found} == {(2 * k, 2 * k + 1) for k in range(20)}


@pytest.mark.parametrize("length, cutting, step", [(60, 25, 9), (50, 25, 9), (60, 40, 9), (60, 25, 7)])
def test_cuttings_hide_no_fuzzy_passage(spark, length, cutting, step):
    """Recall of pairs that share a passage with every step-th word changed, while cuttings of it
    stand before, between and after them, so that each seed has other first, last and next holders."""
    count, rows, pairs = 20, [], {k: [] for k in range(20)}

    def add(inside):
        rows.append((len(rows), f"{sentence(10_000 + 2 * len(rows), 60)} {' '.join(inside)} "
                                f"{sentence(10_001 + 2 * len(rows), 60)}"))
        return len(rows) - 1

    for part in range(5):
        for k in range(count):
            passage = sentence(100 + k, length).split()
            if part % 2 == 0:
                for at in range(0, length - cutting + 1, 5):
                    add(passage[at:at + cutting])
            else:
                pairs[k].append(add(passage if part == 1 else [
                    f"new{k}x{i}" if i % step == step - 1 else w for i, w in enumerate(passage)]))
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["other_id"], r["doc_id"]) for r in found}
    assert sum(tuple(p) in got for p in pairs.values()) >= 0.9 * count


@pytest.mark.parametrize("part_holders", [2048, 7])
def test_any_two_holders_of_a_seed_meet(spark, monkeypatch, part_holders):
    """Fuzzy pairs among cuttings that share nearly all their words, whatever order they stand in:
    every pair is found, in one part of the grid and in many."""
    monkeypatch.setattr(chaining, "PART_HOLDERS", part_holders)
    count, texts, pairs = 8, [], set()
    for k in range(count):
        passage = sentence(100 + k, 60).split()
        cuttings = [passage[at:at + n] for n in (45, 48) for at in range(0, 60 - n + 1, 3)]
        fuzzy = [f"new{k}x{i}" if i % 9 == 8 else w for i, w in enumerate(passage)]
        for inside in (*cuttings, passage, *cuttings, fuzzy, *cuttings):
            n = len(texts)
            texts.append(f"{sentence(10_000 + 2 * n, 60)} {' '.join(inside)} {sentence(10_001 + 2 * n, 60)}")
            if inside is passage:
                held = n
        pairs.add((held, held + len(cuttings) + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["other_id"], r["doc_id"]) for r in chaining.passages(df).collect()}
    assert pairs <= got


def test_common_line_without_passage(spark):
    """A line of 20 words that all texts hold gives no anchor: nothing beside it matches."""
    rows = [(k, f"{sentence(10 + k, 60)} {sentence(3, 20)} {sentence(90 + k, 60)}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert chaining.passages(df).collect() == []
    far = np.arange(1, 65, dtype=np.uint8)[None, :]
    equal, other, none = far, far + 100, np.zeros((1, 64), np.uint8)
    for left, right, want in (((equal, equal), (equal, equal), True), ((none, none), (equal, equal), True),
                              ((far, other), (far, other), False), ((none, none), (none, none), False)):
        assert chaining.likely(left, right).tolist() == [want]


@pytest.mark.parametrize("width", [chaining.MARGIN, 130])
def test_extensions_of_many(width):
    """All rows at once, against one table of scores for each."""
    rng = np.random.default_rng(5)
    n = 100
    a, b = rng.integers(0, 6, (2, n, width))
    copied = rng.random((n, width)) < rng.random((n, 1))
    b[copied] = a[copied]
    for side, beyond in ((a, -1), (b, -2)):
        side[np.arange(width) >= rng.integers(0, width + 1, n)[:, None]] = beyond
    want = []
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = [w for w in x if w >= 0], [w for w in y if w >= 0]
        best, at, last = 0.0, (0, 0), [-chaining.MISS * j for j in range(len(y) + 1)]
        for i, w in enumerate(x):
            row = [last[0] - chaining.MISS]
            for j, v in enumerate(y):
                row.append(max(last[j] + (1.0 if w == v else -chaining.MISS),
                               last[j + 1] - chaining.MISS, row[j] - chaining.MISS))
                if row[-1] > best:
                    best, at = row[-1], (i + 1, j + 1)
            last = row
        want.append(at)
    assert [*zip(*(x.tolist() for x in chaining.extensions(a, b)))] == want
    shared = [sum((Counter(w for w in x if w >= 0) & Counter(y)).values())
              for x, y in zip(a.tolist(), b.tolist())]
    assert chaining._in_both(a, b).tolist() == shared


def test_pairs_aligned_together():
    """Passages of many pairs aligned at once are those of each pair by itself."""
    rng, pairs = random.Random(6), []
    for k in range(30):
        passage = [b"p%d" % rng.randrange(500) for _ in range(rng.randrange(40, 200))]
        other = [w if rng.random() > 0.02 * (k % 8) else b"z%d" % i for i, w in enumerate(passage)]
        a, b = ([b"%s%d" % (x, i) for i in range(rng.randrange(50))] for x in (b"a", b"b"))
        a, b = a + passage + a[::-1], b + other[:60] + [b"new"] * rng.randrange(3) + other[60:] + b
        where = {tuple(a[i:i + 5]): i for i in range(len(a) - 4)}
        rows = np.array([(0, 1, where[w], i, 5) for i in range(len(b) - 4)
                         if (w := tuple(b[i:i + 5])) in where])
        if len(rows):
            _, _, a0, _, b0, _, sizes, inner = chaining._candidates(rows)[0]
            anchors = np.frombuffer(inner, "<i4").reshape(-1, 3).astype(np.int64) + [a0, b0, 0]
            pairs.append((a, b, anchors, np.frombuffer(sizes, "<i4")))
    found = chaining.passages_of(pairs)
    assert found == [chaining.passages_of([pair])[0] for pair in pairs]
    assert sum(map(bool, found)) >= 15
    for (a, b, *_), passages in zip(pairs, found):
        for p, q, r, s, matched in passages:
            assert min(q - p, s - r) >= 50 and matched == chaining.common_words(a[p:q], b[r:s])


@pytest.mark.parametrize("many", [1, 64, 1000])
def test_meeting_loses_no_likely_pair(monkeypatch, many):
    """Cells of few and of many holders, against `likely` of every two."""
    monkeypatch.setattr(chaining, "MANY", many)
    monkeypatch.setattr(chaining, "MET_ROWS", 50)
    rng = np.random.default_rng(9)
    rows, size = [], {}
    for cell, n in enumerate((150, 3, 40, 2, 90)):
        kinds = rng.integers(1, 60, (6, 2, 64))
        for k in range(n):
            sides = kinds[rng.integers(6)].copy()
            changed = rng.random(sides.shape) < rng.random() / 2
            sides[changed] = rng.integers(1, 60, int(changed.sum()))
            sides[0, rng.integers(10, 65):] = sides[1, rng.integers(10, 65):] = 0
            number = len(rows)
            rows.append((cell, 0, 0, 0, number, int(rng.permutation(1000)[0]) * 1000 + number, 7, number,
                         number + 1, *(x.astype(np.uint8).tobytes() for x in sides)))
    names = ["seed", "low", "high", "own", "around", "row", "place", "prev", "run", "left", "right"]
    table = pa.table(dict(zip(names, zip(*rows))))
    found = [t for batch in chaining._met(iter(table.to_batches(max_chunksize=17)), 50, 0.8)
             for t in zip(*(batch.column(c).to_pylist() for c in ("a", "b")))]
    want = set()
    for cell in range(5):
        held = sorted(r for r in rows if r[0] == cell)
        pairs = [(x, y) for x in held for y in held if x[5] < y[5]]
        left, right = ([np.stack([np.frombuffer(pair[k][side], np.uint8) for pair in pairs])
                        for k in (0, 1)] for side in (9, 10))
        good = chaining.likely(tuple(left), tuple(right))
        assert (chaining.likely(tuple(left), tuple(right), matching=chaining._held) | ~good).all()
        want |= {(x[5], y[5]) for (x, y), g in zip(pairs, good) if g}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_packed_hashes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5_000):
        hashes = np.unique(rng.integers(0, 1 << chaining.SEED_BITS, n))
        counts = rng.integers(1, 4, len(hashes))
        back = chaining.unpack_hashes(chaining.pack_hashes(hashes, counts))
        assert (back[0] == hashes).all() and (back[1] == counts).all()


@pytest.mark.parametrize("size", [16 << 20, 200])
def test_shared_seeds(spark, monkeypatch, size):
    """All chunks and buckets, against one list of all seeds; a seed twice in one text is not
    shared."""
    monkeypatch.setattr(chaining, "BUCKET_BYTES", size)
    texts = [sentence(k % 7, 40) if k % 3 else f"{sentence(9, 12)} {sentence(k + 20, 30)}"
             for k in range(40)] + [f"{sentence(99, 9)} x {sentence(99, 9)}", "", "a b"]
    packed = [(k // 6, k, len(t), bytearray(zstandard.compress(t.encode())))
              for k, t in enumerate(texts)]
    base = spark.createDataFrame(packed, "chunk long, row long, size long, packed binary")
    found = sorted(tuple(r) for r in chaining.shared_seeds(base).select(
        "row", "place", "many").collect())
    words = [t.split() for t in texts]
    holders = {}
    for k, w in enumerate(words):
        for i in range(len(w) - 4):
            holders.setdefault(tuple(w[i:i + 5]), set()).add(k)
    assert found == sorted((k, i, int(len(holders[tuple(w[i:i + 5])]) > 2))
                           for k, w in enumerate(words) for i in range(len(w) - 4)
                           if len(holders[tuple(w[i:i + 5])]) > 1)


def test_two_passages_of_one_pair(spark):
    """Equal headers and footers round bodies that differ."""
    rows = [(k, f"{sentence(3, 60)} {sentence(10 + k, 100)} {sentence(4, 60)}") for k in range(4)]
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for start in (0, 160):
        met = {d for r in found if (r["start"], r["end"], r["similarity"]) == (start, start + 60, 1.0)
               for d in (r["doc_id"], r["other_id"])}
        assert met == {0, 1, 2, 3}


def test_passages_query_finds_verbatim_runs(spark, texts):
    found = QUERIES["op2_collinear_chaining"](spark, SMALL).collect()
    words = {d: plain.lower(t).split() for d, t in texts.items()}
    holders = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            holders.setdefault(tuple(w[i:i + 50]), set()).add(d)
    wanted = {d for s in holders.values() if len(s) > 1 for d in s}
    assert wanted <= {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    for r in found:
        a = words[r["doc_id"]][r["start"]:r["end"]]
        b = words[r["other_id"]][r["other_start"]:r["other_end"]]
        same = chaining.common_words([x.encode() for x in a], [x.encode() for x in b])
        assert r["matched"] <= same and r["similarity"] >= 0.8 and min(len(a), len(b)) >= 50


def test_passages_odd_rows(odd, nothing):
    pairs = {(r["doc_id"], r["other_id"]) for r in chaining.passages(odd).collect()}
    met = {d for p in pairs for d in p}
    assert met == {1, 2, 5, 6, 9, 10}
    assert chaining.passages(nothing).collect() == []


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "é": 7, "z": 0, None: 400}, {"x": 3}, {"y": 0}, {}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = plain.mix_targets(sizes)
        got = {r["source"]: r["target"] for r in cube.targets(df).collect()}
        assert set(got) == set(sizes)
        assert all(abs(got[s] - want.get(s, 0)) < 1e-6 for s in sizes)


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    size = [rng.randrange(1, 50) for _ in range(300)]
    chance = [rng.choice([0.0, 0.3, 0.5, 0.9, 1.0]) for _ in size]
    end = cube.flight(chance, size, 5)
    assert sum(0 < p < 1 for p in end) <= 2
    assert abs(sum(end) - sum(chance)) < 1e-6
    assert abs(sum(p * s for p, s in zip(end, size)) - sum(p * s for p, s in zip(chance, size))) < 1e-5
    mean = np.mean([cube.flight(chance[:20], size[:20], k) for k in range(3000)], axis=0)
    assert np.abs(mean - chance[:20]).max() < 0.05


def test_mix_query(spark, texts, documents):
    rows = QUERIES["op5_balanced_mix"](spark, SMALL).collect()
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    sizes = {d: len(plain.WORD.findall(t)) for d, t in texts.items()}
    totals = Counter()
    for d, n in sizes.items():
        totals[source[d]] += n
    targets, taken = plain.mix_targets(dict(totals)), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    longest = max(sizes.values())
    assert all(abs(taken[s] - targets[s]) <= longest for s in totals)


def test_mix_in_many_blocks(documents):
    one = documents.withColumn("source", F.lit("s"))
    plan = cube.mix_plan(one, block=1, weights=(1,))
    again = cube.mix_plan(one.repartition(5), block=1, weights=(1,))
    assert sorted(plan.collect()) == sorted(again.collect())
    two = documents.withColumn("source", F.when(F.col("doc_id") % 8 == 0, "a").otherwise("b"))
    rows = cube.mix_plan(two, block=1).collect()
    for s in "ab":
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) < 100


def test_mix_odd_rows(odd, nothing):
    rows = cube.mix_report(odd).collect()
    assert len(rows) == len(ROWS)
    plan = {(r["unit"], r["source"], r["size"]): r["copies"] for r in cube.mix_plan(odd).collect()}
    mixed = cube.mix(odd)
    assert mixed.columns == odd.columns
    got = Counter((r["doc_id"], r["source"], len(plain.WORD.findall(r["text"] or "")))
                  for r in mixed.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert cube.mix_report(nothing).collect() == [] and cube.mix(nothing).collect() == []


def test_jump():
    keys = [0, 1, 42, 2**63, 2**64 - 1, *range(1000, 1200)]
    for shards in (1, 2, 40, 41, 5000):
        got = jump.jump(np.array(keys, np.uint64), shards).tolist()
        assert got == [plain.jump(k, shards) for k in keys]


def test_sharding_query(spark, texts):
    import zlib
    rows = QUERIES["op9_jump_sharding"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["shard"] == plain.shard(r["doc_id"], 40)
        assert r["grown_shard"] == plain.shard(r["doc_id"], 41) and r["grown_shard"] in (r["shard"], 40)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_odd_rows(odd, nothing):
    for size in (1, 5, 1000):
        rows = jump.with_slots(odd.drop("shard", "slot").withColumn(
            "shard", jump.shard_of(F.col("doc_id"), 2)), "doc_id", group_rows=size).collect()
        for s in {r["shard"] for r in rows}:
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
    dealt = jump.deal(odd)
    assert dealt.count() == len(ROWS) and set(odd.columns) == set(dealt.columns)
    assert jump.deal(nothing).collect() == [] and jump.shard_report(odd).count() == len(ROWS)
    with pytest.raises(ValueError):
        jump.shard_of(F.col("doc_id"), 0)


def test_warc_query(spark):
    rows = QUERIES["op7_warc_derivatives"](spark, SMALL).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert Counter((r["page_id"], r["warc_type"]) for r in rows) == Counter(
        (p, t) for p in pages for t in ("metadata", "conversion"))
    assert len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        page = pages[r["page_id"]]
        assert r["target_uri"] == page["url"]
        assert r["source_payload_digest"] == warc.digest(page["html"].encode())
        assert r["block_digest"] == warc.digest(r["block"].encode())
        if r["warc_type"] == "conversion":
            assert "<p>" not in r["block"] and "track(" not in r["block"]
        else:
            assert f"source-record-id: {r['refers_to']}\r\n" in r["block"]


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><p>text", "text"),
    ("<title>t</title><head><meta name=a><link href=b> \n bare text<p>more", "bare text\nmore"),
    ("<head><noscript><p>no</p></noscript><style>s</style></head><body>text", "text"),
    ("<head><script>var a;</script><div>text</div></head>more", "text\nmore"),
    ("<body><div>a<noscript>b</div><p>c</p><p>d", "ab\nc\nd"),
    ("<body><p>a</p><object data=x><p>b</p><p>c</p></body>", "a\nb\nc"),
    ("<body>a<svg><path d=1><p>b</p>", "a\nb"),
    ("<body>a<svg><text>no</text></svg>b<noscript><p>no</p></noscript>c", "ab\nc"),
    ("<body>a<template><object>no</template>b<script>var a;", "ab"),
])
def test_unclosed_elements_hide_no_text(page, text):
    assert warc.read_page(page)[0] == text


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files(spark, tmp_path, compression):
    """A payload that looks like the end of a record and the start of the next survives."""
    nasty = "<p>a\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nb</p>\r\n\r\n"
    pages = spark.createDataFrame(
        [(1, "http://a/", nasty), (2, None, None), (3, "http://c/é", ""), (3, "http://c/é", "")],
        "page_id long, url string, html string")
    records = warc.responses(pages)
    warc.write_warc(records.coalesce(1), f"{tmp_path}/w", compression=compression)
    back = warc.read_warc(spark, f"{tmp_path}/w")
    assert sorted(bytes(r[0]) for r in back.collect()) == sorted(
        bytes(r["record"]) for r in records.collect())
    made = warc.derive(back).collect()
    assert len(made) == 8
    for r in made:
        headers, block = warc.parse(bytes(r["record"]))
        assert headers["warc-refers-to"] == r["refers_to"] and block == bytes(r["block"])
        assert headers["warc-source-payload-digest"] == r["source_payload_digest"]


def test_warc_coded_and_broken_records(spark):
    import gzip
    page = "<html><head><title>T é</title></head><body>A &amp; é<br>B</body></html>".encode("latin-1")
    packed = gzip.compress(page)
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed)
    block = (b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-A: 1\r\n 2\r\n"
             b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked)
    full = warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block)
    other = warc.build([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:y>")], b"GET /")
    df = spark.createDataFrame([(1, full), (2, other), (3, None), (4, b""), (5, b"rubbish")],
                               "n long, record binary")
    made = {r["warc_type"]: r for r in warc.derive(df, key="n").collect()}
    assert len(made) == 2 and bytes(made["conversion"]["block"]).decode() == "A & é\nB"
    said = bytes(made["metadata"]["block"]).decode()
    assert "http-status: 404\r\n" in said and "title: T é\r\n" in said and "http-header-x-a: 1 2\r\n" in said
    assert warc.derive(df.where("false")).collect() == []


def test_pipeline_stages(spark, documents, odd):
    """Every stage against its plain version, on what the stage before it kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    bench = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = documents
    kept = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        rows = [r.asDict() for r in out.collect()]
        if k < 4:
            assert out.columns == documents.columns
        if k == 0:
            kept = {d: r for d, r in kept.items() if plain.kept(r["text"])}
        elif k == 1:
            root = plain.groups({d: plain.fingerprint(r["text"]) for d, r in kept.items()})
            kept = {d: r for d, r in kept.items() if root[d] == d}
        elif k == 2:
            found = {d: plain.contaminated(r["text"], bench) for d, r in kept.items()}
            kept = {d: r for d, r in kept.items()
                    if not (found[d][1] and 20 * len(found[d][1]) >= found[d][0])}
        if k < 3:
            assert sorted(rows, key=lambda r: r["doc_id"]) == [kept[d] for d in sorted(kept)]
        if k == 3:
            totals, taken = Counter(), Counter()
            for r in kept.values():
                totals[r["source"]] += len(plain.WORD.findall(r["text"]))
            for r in rows:
                assert r == kept[r["doc_id"]]
                taken[r["source"]] += len(plain.WORD.findall(r["text"]))
            goal = plain.mix_targets(dict(totals))
            longest = max(len(plain.WORD.findall(r["text"])) for r in kept.values())
            assert all(abs(taken[s] - goal[s]) <= longest for s in totals)
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
            mixed = Counter(r["doc_id"] for r in rows)
        if k == 4:
            assert Counter(r["doc_id"] for r in rows) == mixed
            assert all(r["shard"] == plain.shard(r["doc_id"], 40) for r in rows)
        docs = spark.createDataFrame(out.collect(), out.schema) if k < 4 else out
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SMALL).collect()
        assert stage(spark, odd.where("false"), SMALL).collect() == []


def test_fingerprints_keep_the_type_of_ids(spark):
    text = sentence(71, 90)
    rows = [("d0", text), ("d1", text), ("d2", sentence(72, 90)), (None, text)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.simhash_report(df).collect()}
    assert found == {"d0": "d0", "d1": "d0", "d2": "d2", None: None}
    assert sorted(str(r["doc_id"]) for r in simhash.drop_near_copies(df).collect()) == [
        "None", "d0", "d2"]


def test_any_page_is_read():
    """Broken declarations, sections and tags in any mixture: nothing raises, plain text stays."""
    assert warc.read_page("<p>a<![>b")[0] == "ab"
    assert warc.read_page("one<![foo[x]]>two")[0] == "onetwo"
    assert warc.read_page("a<!x>b<!-- c -->d")[0] == "abd"
    rng = random.Random(7)
    parts = ["<![", "<!", "<!--", "-->", "<![CDATA[", "]]>", "<!DOCTYPE", "<!ELEMENT", "<?x", "</", "<",
             ">", "<p", "<p>", "<a href='", "'", '"', "&", "&#x", ";", "<script>", "</script>",
             "<title>", "<head>", "<svg>", "[", "]", " word ", "\n", "\0", "é"]
    for _ in range(3000):
        page = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        text, title, lang, links = warc.read_page(page)
        assert isinstance(text, str) and isinstance(title, str)
