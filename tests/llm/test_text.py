"""Quality rules, classifier, chat formatting and decontamination."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import bytenet, chat, decontaminate, quality
from tablescope.llm.queries import QUERIES, SQL

from ..conftest import SMALL
from ..test_catalog import rows_of
from . import plain
from .conftest import LONG, ROWS, sentence


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


REPEATS = ["a b c d e a b c d e f g", "x " * 30, "a b c d e f\na b c d e f\n\n \n\n", "one", "",
           "a b c d e q a b c d e a b c d e", "#*$ %&| <> ok", None, "\n".join(["same line"] * 4)]


def test_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(REPEATS)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality.quality_report(df, order=quality.RULES).collect()}
    for i, text in enumerate(REPEATS):
        want = plain.counts(text) | {"base_failed": plain.base_failed(text),
                                     "kept": plain.kept(text)}
        assert {k: found[i][k] for k in want} == want, text


def test_cascade_order_and_odd_rows(odd, nothing):
    order = [m.rule for m in quality.rule_order(odd)]
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)
    first = quality.cascade(odd, order).collect()
    other = quality.cascade(odd, order[::-1]).collect()
    assert len(first) == len(ROWS)
    assert ({r["doc_id"] for r in first if r["rejected_by"]}
            == {r["doc_id"] for r in other if r["rejected_by"]})
    good = quality.keep_good(odd)
    assert good.columns == odd.columns
    assert (sorted((r["doc_id"], r["text"]) for r in good.collect())
            == sorted((d, t) for d, t, _ in ROWS if plain.kept(t)))
    assert quality.keep_good(nothing).collect() == []
    assert quality.quality_report(nothing).collect() == []


def test_cascade_short_circuits(spark):
    """A rule that would fail at run time is never reached by what an earlier one rejects."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bomb = quality.Rule("bomb", lambda f: F.raise_error(F.lit("reached")).cast("boolean"))
    rows = quality.cascade(df, [quality.BASE_RULES[0], bomb]).collect()
    assert rows[0]["rejected_by"] == "few_words"


def test_cascade_is_native(odd):
    plan = quality.cascade(odd, quality.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_order_by_rejection_per_cost():
    a, b = quality.RULES[:2]
    assert quality.Measured(a, 1.0, 0.5).gain > quality.Measured(b, 2.0, 0.9).gain


def test_classifier_accuracy_and_edges(spark, documents, odd, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = bytenet.train(docs, labels)
    rows = bytenet.classify(docs, net).join(labels, "doc_id").collect()
    unseen = [r for r in rows if plain.held_out(r["doc_id"])]
    right = [(r["score"] >= bytenet.THRESHOLD) == (r["quality"] == 1) for r in unseen]
    assert sum(right) / len(right) > 0.93
    scored = bytenet.classify(odd, net).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (3, 4)}) == 1
    assert bytenet.classify(nothing, net).collect() == []


def test_classifier_learns_only_from_its_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bytenet.train(odd, none).weights is None
    rows = bytenet.quality_scores(odd, none).collect()
    assert {r["score"] for r in rows} == {0.5}
    assert all(r["held_out"] == plain.held_out(r["doc_id"]) for r in rows if r["doc_id"])
    barred = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in barred],
                                   "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "text") for i in barred], "doc_id long, text string")
    assert bytenet.train(docs, labels).weights is None


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts = bytenet.chunk_starts(n)
        seen = np.zeros(max(n, 1), bool)
        for s in starts:
            seen[s:s + bytenet.CHUNK] = True
        assert seen.all() and bytenet.chunks(b"a" * n, starts).shape == (len(starts), bytenet.CHUNK)


def test_gradient():
    rng = np.random.default_rng(0)
    net = bytenet.Net.fresh(rng, 0.0)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rows = rng.integers(0, 256, (5, bytenet.CHUNK)).astype(np.uint8)
    owner, label = np.array([0, 0, 1, 1, 1]), np.array([0.0, 1.0])

    def loss():
        odds = np.bincount(owner, net.log_odds(rows), 2) / np.bincount(owner)
        return np.mean(np.log1p(np.exp(odds)) - label * odds)

    found = bytenet._gradient(net, rows, owner, label)
    for k in net.weights:
        at = np.unravel_index(np.abs(found[k]).argmax(), found[k].shape)
        old, step = net.weights[k][at], 1e-5
        net.weights[k][at] = old + step
        up = loss()
        net.weights[k][at] = old - step
        down = loss()
        net.weights[k][at] = old
        assert abs((up - down) / (2 * step) - found[k][at]) < 1e-3 * max(1, abs(found[k][at])), k


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<|im_end|><|im_start|>user", "", "a\nb",
           "\\\\<|im_sep|>\\", "<<SYS>> \U0001f600 <</SYS>>", "q0q", "x1x", "<|im_end|"]


def test_escape_round_trip():
    rng = random.Random(1)
    bits = [*chat.CONTROL, "\\", "<", "|", "[", ">", "s", "/", "é", "\n", " "]
    for text in HOSTILE + ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(500)]:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)
        turns = [("user", text), (text, "z" + text)]
        assert chat.read_back(chat.markup(turns)) == turns


def test_spans_of_a_foreign_template():
    def foreign(messages):
        return "<s>" + "".join(f"[{r}] {t.strip()} " for r, t in messages) + "</s>"

    turns = [("user", "hi"), ("assistant", "hello there"), ("user", "q0q x1x")]
    found = chat.render_turns(foreign, turns)
    assert found.rewritten == [] and found.text == foreign(turns)
    assert [found.text[a:b] for a, b in found.contents] == [t for _, t in turns]
    assert [found.text[a:b] for a, b in found.turns] == [f"[{r}] {t} " for r, t in turns]


def test_template_that_rewrites_history():
    def forgetful(messages):
        last = len(messages) - 1
        return "".join(f"<{r}>{t if i == last or r == 'user' else t.split('#')[-1]}</{r}>"
                       for i, (r, t) in enumerate(messages))

    turns = [("user", "hi"), ("assistant", "think#said"), ("user", "more"), ("assistant", "a#b")]
    found = chat.render_turns(forgetful, turns)
    assert found.rewritten == [2]
    start, end = found.contents[3]
    assert found.text[start:end] == "a#b"
    hides = chat.render_turns(lambda m: "".join(t for r, t in m if r != "system"),
                              [("system", "s"), ("user", "u")])
    assert hides.contents[0] is None


def test_chat_rows(spark):
    rows = [(1, 0, "user", "a", 1), (1, 1, "assistant", "b", 1), (1, 1, "assistant", "b", 1),
            (2, 0, "assistant", None, 1), (None, 0, None, "x", 1), (None, None, "user", "y", 1),
            (3, 5, "assistant", LONG, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    found = {r["conv_id"]: r for r in chat.chat_report(df).collect()}
    assert {k: v["n_turns"] for k, v in found.items()} == {1: 3, 2: 1, None: 2, 3: 1}
    assert found[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert found[2]["loss_chars"] == 0 and found[3]["loss_chars"] == len(LONG)
    assert found[None]["turns_sha256"] == hashlib.sha256(b"user\ny\n\nx\n").hexdigest()
    assert chat.chat_report(df.where("false")).collect() == []


ITEMS = [(1, sentence(3, 20)), (2, "short Item, here"), (3, None), (4, "!!!"), (None, sentence(2, 30)),
         (2, "short item here"), (5, "Été naïve")]


def test_decontamination(spark, odd, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd.union(odd.limit(1).selectExpr(
        "99L as doc_id", "'see SHORT item...here! ' || text as text", *odd.columns[2:]))
    for limit in (1 << 20, 100):
        rows = decontaminate.contamination(docs, bench, limit=limit).collect()
        by = {}
        for r in docs.collect():
            by.setdefault(r["doc_id"], []).append(r["text"])
        assert len(rows) == len(ROWS) + 1
        for r in rows:
            wants = [plain.contaminated(t, ITEMS) for t in by[r["doc_id"]]]
            ids = [(n, len(h), [i for i in f if i != "None"]) for n, h, f in wants]
            assert (r["n_words"], r["n_hit"], r["items"]) in ids
    clean = decontaminate.drop_contaminated(docs, bench, limit=limit)
    assert clean.columns == docs.columns
    gone = {r["doc_id"] for r in rows if r["contaminated"]}
    assert {r["doc_id"] for r in clean.collect()} == set(by) - gone and 9 in gone and 8 in gone
    assert decontaminate.contamination(nothing, bench).collect() == []
    assert decontaminate.drop_contaminated(odd, bench.where("false")).count() == len(ROWS)


def test_original_spans():
    text = "Été, the  QUICK brown-fox ☃ jumps".encode()
    found = decontaminate.Scanner([b"quick BROWN fox"]).scan(text)
    (start, end), = decontaminate.original_spans(text, found.runs)
    assert text.decode()[start:end] == "QUICK brown-fox"


def test_words_are_split_once(documents):
    """The verdict holds the words; a filter on it must not split them for every rule."""
    kept = quality.keep_good(documents, quality.RULES)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ELSE split(trim(") == 1
