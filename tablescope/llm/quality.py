"""Quality rules as a short-circuit cascade of native expressions.

A rule is a boolean column over the features of a text; a document is rejected by the first rule
that holds. The set of rejected documents does not depend on the order of the rules, their cost
does: `rule_order` measures on a sample how long each rule takes and how much it rejects, and
`cascade` evaluates the rules by rejection per cost inside one CASE, where a later rule, with all
the features it needs, is not computed for a document that an earlier one has rejected."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blanks_removed, free_name, let, materialize, words_of

WINDOW = 5
SAMPLE_ROWS = 2000


def _letters_removed(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, ""))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    said = F.filter(lines, lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")
    return let(said, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside a window of `width` words that the text holds twice or more.

    Windows are compared by 64-bit hashes of the word hashes: two of n windows of one text are
    mistaken for each other with a probability of n²/2^65."""

    def windows(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.size(h) - (width - 1))
        return F.transform(starts, lambda x, i: F.xxhash64(
            x, *[F.get(h, i + k) for k in range(1, width)]))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(
            g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            again = F.filter(p, lambda e, k: (e["h"] == F.get(p, k - 1)["h"])
                             | (e["h"] == F.get(p, k + 1)["h"]))
            return F.sort_array(F.transform(again, lambda e: e["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(
            let(placed, twice), start,
            lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(width))).alias("n"),
                                  i.alias("last")),
            lambda a: a["n"])

    def of_hashes(h: Column) -> Column:
        return let(windows(h), lambda g: F.when(
            F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    # A window needs `width` words, a repeated one a word more.
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(
        let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes)).cast("long")


def features(text: Column, words: Column) -> dict[str, Column]:
    """What the rules look at, from a text and its words. A null text is empty."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(blanks_removed(text)).cast("long"),
        "n_symbols": (F.length(F.coalesce(text, F.lit("")))
                      - _letters_removed(text, "[#*$%&|<>]+")).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
        "n_upper": _letters_removed(text, "[^A-Z]+").cast("long"),
        "n_letters": _letters_removed(text, "[^A-Za-z]+").cast("long"),
        "n_marks": _letters_removed(text, "[^!?]+").cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """`rejects` maps the features of a text to a boolean column that is never null."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda f: f["n_words"] < 10),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("shouting", lambda f: 2 * f["n_upper"] > f["n_letters"]),
    Rule("marks", lambda f: 10 * f["n_marks"] > 3 * f["n_words"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"])
         | (f["word_chars"] > 15 * f["n_words"])),
)


@dataclass(frozen=True)
class Measured:
    """A rule's cost in seconds and its share of rejected rows, both on the sample."""

    rule: Rule
    cost: float
    rejection: float

    @property
    def gain(self) -> float:
        return self.rejection / max(self.cost, 1e-6)


def rule_order(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
               sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> list[Measured]:
    """Rules by rejection per cost, measured on about `sample_rows` documents.

    The sample only chooses an order; it never changes a verdict. The cost of a rule is the
    time of a pass that computes it less that of an empty pass. Equal gains go by name."""
    rules = list(rules)
    rows = docs.count()
    part = docs.select(F.col(text).alias("text"))
    if rows > sample_rows:
        part = part.sample(fraction=min(1.0, sample_rows / rows), seed=seed)
    sample = materialize(part.withColumn("words", words_of(F.col("text"))), "rules")
    found = features(F.col("text"), F.col("words"))

    def passes(column: Column) -> tuple[float, float]:
        start = time.perf_counter()
        share = sample.agg(F.avg(column.cast("int"))).first()[0]
        return time.perf_counter() - start, float(share or 0.0)

    idle = F.col("text").isNull()
    passes(idle)
    empty = passes(idle)[0]
    measured = []
    for rule in rules:
        seconds, share = passes(rule.rejects(found))
        measured.append(Measured(rule, max(seconds - empty, 1e-3), share))
    return sorted(measured, key=lambda m: (-m.gain, m.rule.name))


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text",
            known: Mapping[str, Column] | None = None, into: str = "rejected_by") -> DataFrame:
    """Add the name of the first rule that rejects a document, null for a document that is kept.

    `rules` in the order to try them (default: `rule_order` of RULES, which measures and may change
    from run to run: it never changes whether a document is kept, but may change which of several
    rules is named). The words are split once, inside the verdict, so that a filter on it holds no
    second split; everything else is computed when a rule is reached. `known` names the features
    instead, if the frame already holds some. A null text is an empty one, an empty table stays empty,
    repeated rows are judged alike, and all columns are kept (`into` replaces one of its name)."""
    if rules is None:
        rules = [m.rule for m in rule_order(docs, text=text)]
    tried = list(rules)

    def verdict(found: Mapping[str, Column]) -> Column:
        named = F.lit(None).cast("string")
        for rule in reversed(tried):
            named = F.when(rule.rejects(found), F.lit(rule.name)).otherwise(named)
        return named

    if known is not None:
        return docs.withColumn(into, verdict(known))
    return docs.withColumn(into, let(
        words_of(F.col(text)), lambda words: verdict(features(F.col(text), words))))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None,
              text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    name = free_name(docs, "rejected_by")
    return cascade(docs, rules, text, into=name).where(F.col(name).isNull()).drop(name)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   order: Sequence[Rule] | None = None) -> DataFrame:
    """Per document its counts, whether a base rule fails and whether the cascade keeps it.

    The counts are wanted for every document, so the cascade reads them instead of computing
    its features again; only what no count covers is still evaluated lazily."""
    if order is None:
        order = [m.rule for m in rule_order(docs, text=text)]
    words = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                        words_of(F.col(text)).alias("words"))
    counted = features(F.col("text"), F.col("words"))
    table = words.select("key", "text", *[counted[c].alias(c) for c in COUNTS])
    own = counted | {c: F.col(c) for c in COUNTS}
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.rejects(own)
    return cascade(table, order, "text", own, "rejected_by").select(
        F.col("key").alias(key), *COUNTS, failed.alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"))
