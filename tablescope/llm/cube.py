"""Mixing sources to target weights by balanced sampling (the cube method).

A source that is to give r times its words gives every document the whole part of r times, and
the fraction is an inclusion probability. The flight phase moves the probabilities of three
documents at a time along the null space of the two balancing constraints, the number of
documents and the number of words, until one of them is 0 or 1; both totals stay what they were.
A block of documents ends with a handful of open probabilities. The open ones of all blocks fly on
together, in as few rounds as the blocks need, and the landing decides the last few of a source
by what comes nearest to its words and number of documents.

Only ids and sizes are moved. Equal rows are folded into one unit first, and a source's units are
dealt to blocks of bounded size, so neither a hot source nor a hot id fills a task. Each block
also keeps a few short documents open for the landing (`ballast`)."""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialize, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 20_000
BALLAST = 14
_NEAR = 1e-9


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and share the total of all sizes;
    none gets more than `most` times its size, and what it can't take is shared by the others."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    weighted = sizes.withColumn("weight", F.get(
        pattern, F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))).cast("long"))
    cap = (F.col("source_size") * most).cast("decimal(38,0)")
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("weight"),
                              F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = weighted.withColumn("cap", cap).select(
        "*", F.coalesce(F.sum("cap").over(upto), F.lit(0)).alias("before"),
        F.sum("weight").over(onward).alias("open"),
        F.sum("source_size").over(whole).alias("total"))
    left = F.col("total") - F.col("before")
    full = left * F.col("weight") >= F.col("cap") * F.col("open")
    level = filled.withColumn("full", full).select(
        "*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole).alias("taken"),
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole).alias("shared"))
    share = ((F.col("total") - F.col("taken")).cast("double") * F.col("weight")
             / F.nullif(F.col("shared").cast("double"), F.lit(0.0)))
    return level.select("source", "source_size", F.when(
        F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def flight(chance: list[float], size: list[int], seed: int) -> list[float]:
    """Move the probabilities until at most two lie between 0 and 1.

    The sums of chance and of chance · size stay as they are, and the expected value of each
    entry is what it was."""
    draw = random.Random(seed).random
    chance = list(chance)
    waiting = [i for i, p in enumerate(chance) if 0.0 < p < 1.0]
    waiting.reverse()
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            move = (c - b, a - c, b - a)
            if not any(move):
                move = (1, -1, 0)
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            move = (1, -1)
        else:
            return chance
        up = down = float("inf")
        for i, m in zip(held, move):
            if m > 0:
                up, down = min(up, (1.0 - chance[i]) / m), min(down, chance[i] / m)
            elif m < 0:
                up, down = min(up, chance[i] / -m), min(down, (1.0 - chance[i]) / -m)
        step = up if draw() * (up + down) < down else -down
        for i, m in zip(held, move):
            p = chance[i] + step * m
            chance[i] = 0.0 if p < _NEAR else 1.0 if p > 1.0 - _NEAR else p
        held = [i for i in held if 0.0 < chance[i] < 1.0]


def ballast(chance: list[float], size: list[int]) -> set[int]:
    """Up to BALLAST open units spread over all but the largest sizes, which stay out of the flight.

    The flight tends to leave the longest documents open; with some shorter ones beside them the
    landing can come close to both totals."""
    open_ = sorted((i for i, p in enumerate(chance) if 0.0 < p < 1.0 and size[i] > 0),
                   key=lambda i: (size[i], i))
    if len(open_) <= BALLAST:
        return set(open_)
    step = 0.8 * len(open_) / BALLAST
    return {open_[int(k * step)] for k in range(BALLAST)}


def landing(chance: list[float], size: list[int]) -> list[float]:
    """Round the few open probabilities to what comes nearest to both totals."""
    open_ = [i for i, p in enumerate(chance) if 0.0 < p < 1.0]
    if not open_:
        return chance
    taken = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    p, s = np.array([chance[i] for i in open_]), np.array([size[i] for i in open_], float)
    off = taken - p
    miss = np.abs(off @ s) / max(float(np.median(s)), 1.0) + np.abs(off.sum(axis=1)) / 4
    chance = list(chance)
    for i, t in zip(open_, taken[int(miss.argmin())]):
        chance[i] = float(t)
    return chance


def _fly(level: int, seed: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["mark", "size", "unit"], kind="stable")
        first = part.iloc[0]
        own = zlib.crc32(f"{seed}/{level}/{first['source']}/{first['block']}".encode())
        sizes = [int(s) for s in part["size"]]
        chance = [float(p) for p in part["chance"]]
        kept = ballast(chance, sizes)
        flying = [i for i in range(len(sizes)) if i not in kept]
        moved = flight([chance[i] for i in flying], [sizes[i] for i in flying], own)
        for i, p in zip(flying, moved):
            chance[i] = p
        if int(first["blocks"]) == 1:
            chance = landing(chance, sizes)
        return part.assign(chance=np.array(chance))
    return run


def _units(docs: DataFrame, key: str, source: str, size: Column) -> DataFrame:
    return docs.select(F.col(key).alias("unit"), F.col(source).cast("string").alias("source"),
                       size.alias("size")).groupBy("unit", "source", "size").agg(
        F.count(F.lit(1)).alias("rows"))


def mix_plan(docs: DataFrame, key: str = "doc_id", source: str = "source",
             text: str = "text", weights: Sequence[int] = WEIGHTS, most: int = MOST,
             block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(unit, source, size, rows, source_size, target, copies): how often to take each document.

    A unit stands for `rows` equal rows of one id, source and size, and `copies` is for all of
    them together. A null source is a source, a null text has size 0, and an empty table gives
    an empty plan. The same table and seed give the same plan, however its rows are laid out."""
    block = max(block, 10 * BALLAST)  # every round must leave far fewer units than it got
    units = materialize(_units(docs, key, source, word_count(F.col(text))), "units")
    sources = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"),
        F.count(F.lit(1)).alias("units"))
    goal = targets(sources.select("source", "source_size"), weights, most).withColumnRenamed(
        "source", "named").join(
            sources.select(F.col("source").alias("own"), "units"),
            F.col("named").eqNullSafe(F.col("own"))).drop("own")
    goal = materialize(goal, "targets")
    wanted = (F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))
              * F.col("rows"))
    wanted = F.coalesce(wanted, F.lit(0.0))
    sure = F.floor(wanted + _NEAR)
    chance = F.greatest(wanted - sure, F.lit(0.0))
    state = units.join(goal, units.source.eqNullSafe(goal.named)).drop("named").select(
        "unit", "source", "size", "rows", "source_size", "target", "units",
        sure.alias("sure"), F.when(chance > _NEAR, chance).otherwise(0.0).alias("chance"),
        F.xxhash64(F.lit(seed), F.col("unit"), "size").alias("mark"))
    done, level = [], 0
    names = ["unit", "source", "size", "rows", "source_size", "target", "sure", "chance", "mark"]
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", blocks long, block long"
    while True:
        blocks = F.ceil(F.col("units") / block).cast("long")
        dealt = state.select(*names, blocks.alias("blocks")).withColumn(
            "block", F.pmod(F.xxhash64(F.lit(level), "mark"), F.col("blocks")))
        flown = materialize(
            dealt.groupBy("source", "block").applyInPandas(_fly(level, seed), schema), "flight")
        settled = (F.col("chance") == 0.0) | (F.col("chance") == 1.0)
        done.append(flown.where(settled))
        rest = flown.where(~settled)
        left = rest.groupBy("source").agg(F.count(F.lit(1)).alias("units"))
        if rest.isEmpty():
            break
        state = rest.drop("blocks", "block").join(
            left.withColumnRenamed("source", "named"),
            F.col("source").eqNullSafe(F.col("named"))).drop("named")
        level += 1
    plan = done[0]
    for more in done[1:]:
        plan = plan.union(more)
    return plan.select("unit", "source", "size", "rows", "source_size", "target",
                       (F.col("sure") + F.col("chance")).cast("long").alias("copies"))


def _per_row(place: Column) -> Column:
    """Copies of one of a unit's equal rows: the unit's copies dealt out evenly."""
    return (F.floor(F.col("copies") / F.col("rows"))
            + (place < F.col("copies") % F.col("rows")).cast("long")).cast("long")


def mix_report(docs: DataFrame, key: str = "doc_id", source: str = "source",
               text: str = "text") -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    plan = mix_plan(docs, key, source, text)
    rows = plan.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"),
                                                         F.col("rows") - 1)))
    return rows.select(F.col("unit").alias("doc_id"), "source", "size", "source_size", "target",
                       (_per_row(F.col("place")) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        **options) -> DataFrame:
    """The rows of the mix with their columns, each as often as the plan takes it."""
    plan = mix_plan(docs, key, source, text, **options)
    unit, place, wish, share = (
        free_name(docs, name) for name in ("_unit", "_place", "_wanted", "_plan"))
    # A struct compares its nulls as equal, so one key serves for rows without id or source.
    rows = docs.withColumn(unit, F.struct(
        F.col(key), F.col(source).cast("string"), word_count(F.col(text))))
    wanted = plan.where("copies > 0").select(
        F.struct(F.col("unit"), F.col("source"), F.col("size")).alias(wish),
        F.struct("copies", "rows").alias(share))
    joined = rows.join(wanted, F.col(unit) == F.col(wish))
    repeated = Window.partitionBy(unit).orderBy(F.col(text))
    taken, equal = F.col(f"{share}.copies"), F.col(f"{share}.rows")
    copies = F.floor(taken / equal) + (F.col(place) <= taken % equal).cast("long")
    return (joined.withColumn(place, F.row_number().over(repeated))
            .withColumn(place, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
