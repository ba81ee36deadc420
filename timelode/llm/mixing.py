"""Mixing sources to target weights by the cube method.

Each source gets a share of all words by its weight, at most ``CAP`` times its
own; the excess goes to the others by weight (water filling). A document's rate
target / source_size splits into whole repeats and an inclusion probability.
The flight phase of the cube method moves these probabilities through the null
space of two constraints, the source's words and its documents, until at most
two documents of a block are undecided. Blocks hold at most ``BLOCK`` documents
of one source; what they leave undecided is dealt to new blocks, round by
round, until the source's rest is one block. Each source lands in the round in
which that is so, whatever the size of the others: its ``LANDING`` largest
documents, which stayed on the ground till then, and the last two open ones
settle together, and of their at most 2 ** 16 outcomes the landing phase takes
the one nearest to the totals. So a source misses its target by little, unless
one document outweighs the others.

Documents fly by falling size. Draws and blocks come from hashes of source, id, text
and ``SEED``: reruns agree. Rows that repeat as a whole have their row hashed
too, so that their blocks are no larger than others and they don't draw alike.

The totals of sources, a row each, are ranked in one task: meant for up to some
millions of sources (a million rows of some 60 bytes are sorted in seconds). All
else is dealt by blocks.

Defined results: a null or empty text has size 0 and is drawn like others, at
rate 0 if the whole source is empty; null sources are one source, the last;
sources and documents that tie go by name and draw; repeated rows are documents of
their own, drawn one by one; texts of any length count whole; an empty table gives
an empty result; other columns are not read, and ``mixed_rows`` returns them as they
were.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, own_name, stored

WEIGHTS, CAP, SEED, BLOCK, LANDING = (5, 2, 1), 3, 17, 4096, 14
EPS = 1e-9


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sized (source, size) -> source, source_size, n_docs, target. Works on one
    row a source: by rising cap over weight, the sources that hit their cap come
    first, and the others split what these leave by weight."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("level", F.col("source_size") * cap / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("share", (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the water level at the first source that it doesn't fill; those before are full
    first = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "share"))).over(everything)
    ranked = ranked.withColumn("water", first["share"])
    water = F.col("water")
    target = F.when(water.isNull() | (F.col("level") <= water), F.col("source_size") * float(cap)).otherwise(F.col("weight") * water)
    return ranked.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def fly(chance: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves chances, in the order given, until at most two are undecided. Each move
    keeps the sum of the chances and of chance times size, and decides one document
    at least. draw: a uniform number a document."""
    chance = chance.copy()
    open_ = []
    for k in np.flatnonzero((chance > EPS) & (chance < 1 - EPS)).tolist():
        open_.append(k)
        if len(open_) == 3:
            a, b, c = open_
            way = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if way == (0, 0, 0):
                way = (1.0, -1.0, 0.0)
            open_ = _move(chance, open_, way, draw[k])
    return np.where(chance > 1 - EPS, 1.0, np.where(chance < EPS, 0.0, chance))


def land(chance: np.ndarray, size: np.ndarray, draw: np.ndarray, most: int = LANDING) -> np.ndarray:
    """Settles a block ordered by falling size. All but its ``most`` largest open
    documents fly first; of the ways to settle those and the two left, the one is
    taken that comes nearest to both totals (words before documents)."""
    open_ = np.flatnonzero((chance > EPS) & (chance < 1 - EPS))
    rest = open_[most:]
    chance = chance.copy()
    chance[rest] = fly(chance[rest], size[rest], draw[rest])
    open_ = np.flatnonzero((chance > EPS) & (chance < 1 - EPS))
    if len(open_):
        ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        off = ways - chance[open_]
        words = (off @ size[open_]) / max(1.0, chance[open_] @ size[open_])
        docs = off.sum(1) / max(1.0, chance[open_].sum())
        chance[open_] = ways[np.argmin(words**2 + 0.01 * docs**2)]
    return np.where(chance > 0.5, 1.0, 0.0)


def _move(chance: np.ndarray, some: list[int], way: Sequence[float], u: float) -> list[int]:
    """One step of the flight along ``way`` or against it, as far as both allow."""
    ahead = behind = np.inf
    for k, w in zip(some, way, strict=True):
        if w > 0:
            ahead, behind = min(ahead, (1 - chance[k]) / w), min(behind, chance[k] / w)
        elif w < 0:
            ahead, behind = min(ahead, chance[k] / -w), min(behind, (1 - chance[k]) / -w)
    step = ahead if u * (ahead + behind) < behind else -behind
    for k, w in zip(some, way, strict=True):
        chance[k] = min(1.0, max(0.0, chance[k] + step * w))
    return [k for k in some if EPS < chance[k] < 1 - EPS]


def _round(rows: DataFrame, most: int) -> DataFrame:
    """One flight in every block, without the held documents; a source of at most
    ``most`` others lands, all together. Rows keep their columns."""
    columns = rows.schema

    def run(_key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "draw", "row_"], ascending=[False, True, True], kind="stable")
        chance, size, draw = block["chance"].to_numpy(np.float64, copy=True), block["size"].to_numpy(np.float64), block["draw"].to_numpy()
        if block["left"].iloc[0] <= most:
            chance = land(chance, size, draw)
        else:
            flies = ~block["held"].to_numpy(bool)
            chance[flies] = fly(chance[flies], size[flies], draw[flies])
        block["chance"] = chance
        return block

    return rows.groupBy("source", "block").applyInPandas(run, columns)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED, block: int = BLOCK, size=None) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target,
    repeats, taken, a row for each row of docs."""
    size = n_words(F.col("text")) if size is None else size
    text = F.col("text") if "text" in docs.columns else F.lit(None)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "source", text, size).alias("key"), F.monotonically_increasing_id().alias("row_")
    )
    return mixed(sized, weights, cap, seed, block).drop("row_")


def mixed(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """sized (doc_id, source, size, key: a hash of all of the document, row_) -> mix, with row_."""
    sized = stored(sized, "mix-sized")  # the row numbers stay the same
    by_source = stored(targets(sized, weights, cap), "mix-targets")
    again = stored(sized.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("again")), "mix-again")
    own = F.when(F.coalesce("again", F.lit(False)), F.xxhash64("row_")).otherwise(F.lit(0).cast("long"))
    rows = sized.join(again, "key", "left").withColumn("own", F.xxhash64("key", own)).drop("again", "key")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    draw = F.pmod(F.xxhash64("own", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    facts = by_source.select(F.col("source").alias("source_"), "source_size", "n_docs", "target")
    rows = rows.join(facts, rows["source"].eqNullSafe(facts["source_"])).drop("source_")
    rows = rows.withColumn("whole", F.floor(rate).cast("long")).withColumn("chance", rate - F.floor(rate)).withColumn("draw", draw)
    # ids pass through pandas as text: a null beside them would make floats of numbers
    flown = rows.select("row_", F.col("doc_id").cast("string").alias("doc_id"), "own", "source", "size", "source_size", "target", "whole", "chance", "draw", F.col("n_docs").alias("left"))
    undecided = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
    # a source that doesn't land at once keeps its largest documents on the ground till it does
    falling = Window.partitionBy("source").orderBy(F.col("size").desc(), "draw", "row_")
    ground = flown.where((F.col("left") > block) & undecided).withColumn("turn", F.row_number().over(falling)).where(F.col("turn") <= LANDING)
    ground = stored(ground.select("row_", F.lit(True).alias("held")), "mix-ground")
    flown = flown.join(ground, "row_", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    settled: list[DataFrame] = []
    number = 0
    while True:
        number += 1
        blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("left") / block))
        dealt = flown.withColumn("block", F.pmod(F.xxhash64("own", F.lit(seed + number)), blocks))
        done = stored(_round(dealt, block).drop("block"), "mix-round")
        settled.append(done.where(~undecided))
        open_ = done.where(undecided).drop("left")
        # the held ones don't count: a source lands when the others fit into a block
        counts = stored(open_.groupBy("source").agg(F.count_if(~F.col("held")).alias("left")), "mix-open")
        if counts.isEmpty():
            break
        counts = counts.withColumnRenamed("source", "source_")
        flown = open_.join(counts, open_["source"].eqNullSafe(counts["source_"])).drop("source_")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    repeats = (F.col("whole") + F.round("chance").cast("long")).alias("repeats")
    found = found.select("row_", F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", repeats)
    return found.withColumn("taken", F.col("size") * F.col("repeats"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows are told apart by where
    they stand, whatever their ids. Texts move once, to meet their counts: these have
    a row for each document, so they are merged and not broadcast, whatever their size."""
    row, times, turn = (own_name(docs, n) for n in ("row_", "times_", "turn_"))
    rows = numbered(docs, "mix-rows", row)
    rows = rows.withColumn(row, F.concat_ws(":", *[F.col(row)[f].cast("string") for f in ("content", "file", "at")]))
    size = n_words(F.col("text"))
    sized = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "source", "text", size).alias("key"), F.col(row).alias("row_"))
    found = mixed(sized).where("repeats > 0").select(F.col("row_").alias(row), F.col("repeats").cast("int").alias(times))
    rows = rows.join(found.hint("merge"), row).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*[rows[c] for c in docs.columns])
