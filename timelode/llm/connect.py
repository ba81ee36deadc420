"""Which members of groups hold together, where pairs must be tested.

Groups are buckets of a hash or families of texts, a member may be in many. Only
connectivity is wanted, so a pair is tested only while its ends are in different
trees:

1. A group is dealt by a hash to blocks of about ``BLOCK`` members. Each block meets
   the group's ``PIVOTS`` (members with the least hashes) as well, so blocks whose members
   hold together are joined through them. That is linear in a group's size: one
   copy of a member, and an edge at most to the least of its tree.
2. In a group of several blocks with more than one component left, the members of its
   largest one meet all others, and these one another, pair of blocks by pair of blocks;
   only pairs from different components are tested. A group that holds together never comes
   this far, and of one with few others each member of the large component is in one unit.

No pair of a group is left out: those in a block are tested in 1, all others in 2,
unless their ends are together already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelode.operators.memory import give_back

from .common import stored
from .graph import components

BLOCK, SPREAD, HELD, TILE, PIVOTS = 96, 16, 2_000_000, 512, 4


def unit_pairs(first: np.ndarray, side: np.ndarray, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row places within units of work, in runs of bounded size. first:
    starts of the units (with the end); side 0/1: the two blocks of a unit, which
    pair with each other only; side 2: a unit of one block, all pairs."""
    size = np.diff(first)
    small = size <= 64
    starts, sizes = first[:-1][small], size[small]
    for gap in range(1, 64):
        fits = sizes > gap
        if not fits.any():
            break
        s, n = starts[fits], sizes[fits] - gap
        left = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        right = left + gap
        ok = (side[left] == 2) | (side[left] != side[right])
        yield left[ok], right[ok]
    for a, b in zip(first[:-1][~small].tolist(), first[1:][~small].tolist(), strict=True):
        rows = np.arange(a, b)
        one, two = (rows, rows) if side[a] == 2 else (rows[side[rows] == 0], rows[side[rows] == 1])
        for i in range(0, len(one), tile):
            for j in range(0, len(two), tile):
                x, y = one[i : i + tile], two[j : j + tile]
                left, right = np.repeat(x, len(y)), np.tile(y, len(x))
                ok = left < right if side[a] == 2 else slice(None)
                yield left[ok], right[ok]


class Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = np.arange(n), []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the ends of each pair are in different trees."""
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up[left] != self.up[right]

    def add(self, left: np.ndarray, right: np.ndarray, run: int = 2000) -> None:
        while len(left):
            for a, b in zip(left[:run].tolist(), right[:run].tolist(), strict=True):
                x, y = self.find(a), self.find(b)
                if x != y:
                    self.up[y] = x
                    self.edges.append((a, b))
            left, right = left[run:], right[run:]
            if len(left):
                still = self.apart(left, right)
                left, right = left[still], right[still]


def whole_units(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches -> frames of whole units of work and where these start. A
    unit has at most two blocks, so what is held back is bounded."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        new = np.flatnonzero((batch[keys].values[1:] != batch[keys].values[:-1]).any(1)) + 1
        cut = new[-1] if len(new) else 0
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True), np.concatenate([[0], new[:-1], [cut]])
        rest = batch.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        new = np.flatnonzero((rest[keys].values[1:] != rest[keys].values[:-1]).any(1)) + 1
        yield rest, np.concatenate([[0], new, [len(rest)]])


def in_units(rows: DataFrame, key: list[str], size: str, held: Column, spread: str, block: int, parts: int = 1) -> DataFrame:
    """dealt_units, those of a unit together and in order. parts: least number of partitions."""
    return sorted_units(dealt_units(rows, size, held, spread, block), key, spread, parts)


def dealt_units(rows: DataFrame, size: str, held: Column, spread: str, block: int) -> DataFrame:
    """Deals the rows of a group to units of work: the group itself, or each pair of
    its blocks (a row goes to every pair with its block). size: the group's members;
    held: what they hold together, in the unit of ``HELD``."""
    n = F.greatest(F.ceil(held / HELD), F.least(F.ceil(F.col(size) / block), F.lit(SPREAD))).cast("int")
    rows = rows.withColumn("n_", n).withColumn("b_", F.pmod(F.xxhash64(spread), F.col("n_")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("o_")
    rows = rows.select("*", other)
    rows = rows.withColumn("lo", F.least("b_", "o_")).withColumn("hi", F.greatest("b_", "o_"))
    side = F.when(F.col("lo") == F.col("hi"), 2).when(F.col("b_") == F.col("lo"), 0).otherwise(1)
    return rows.withColumn("side", side.cast("int")).drop("n_", "b_", "o_")


def sorted_units(rows: DataFrame, key: list[str], spread: str, parts: int) -> DataFrame:
    parts = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi", spread)


def _edges(test: Callable[[pd.DataFrame], Callable]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Units of members (key, lo, hi, side, fp, tree) -> each tree that a unit found, as edges
    to its least ``tree``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, first in whole_units(batches, ["key", "lo", "hi"]):
            unit = np.repeat(np.arange(len(first) - 1), np.diff(first))
            fp = frame["fp"].to_numpy()
            twice = np.append(False, (unit[1:] == unit[:-1]) & (fp[1:] == fp[:-1]))  # a pivot in its own block
            if twice.any():
                frame, unit = frame[~twice].reset_index(drop=True), unit[~twice]
                first = np.searchsorted(unit, np.arange(len(first)))
            tree, forest, near = frame["tree"].to_numpy(), Forest(len(frame)), test(frame)
            order = np.lexsort((pd.factorize(tree)[0], unit))
            same = (unit[order][1:] == unit[order][:-1]) & (tree[order][1:] == tree[order][:-1])
            forest.add(order[:-1][same], order[1:][same])
            for left, right in unit_pairs(first, frame["side"].to_numpy()):
                new = forest.apart(left, right)  # others can't change what holds together
                left, right = left[new], right[new]
                ok = near(left, right)
                forest.add(left[ok], right[ok])
            root = np.array([forest.find(i) for i in range(len(frame))], int)
            least = pd.Series(tree).groupby(root).transform("min").to_numpy()
            yield pd.DataFrame({"a": tree, "b": least})[tree != least].drop_duplicates()
        give_back()

    return run


def connected(rows: DataFrame, attach: Callable[[DataFrame], DataFrame], test: Callable[[pd.DataFrame], Callable], block: int = BLOCK) -> DataFrame:
    """rows (key, fp binary, held) -> (node, root) for every fp that a test joins with another.

    attach: adds to rows with fp what the test reads. test: a frame of units -> a
    function of places (left, right) that gives the places of the pairs that pass.
    held: what a member costs a task, in the unit of ``HELD``."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("held").alias("total")).where("m > 1")
    n = F.greatest(F.ceil(F.col("total") / HELD), F.ceil(F.col("m") / block)).cast("int")
    dealt = rows.join(sizes.withColumn("n", n), "key")
    # most groups have one member, so this is narrow and short; it is read several times
    dealt = stored(dealt.select("key", "m", "total", "n", "fp", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("lo")), "connect-members")
    parts = _parts(rows)
    wide = dealt.where("n > 1")
    pivots = wide.groupBy("key", "n").agg(*[F.min(F.struct(F.xxhash64("fp", F.lit(k)), "fp"))["fp"].alias(f"p{k}") for k in range(PIVOTS)])
    pivots = pivots.select("key", "n", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("fp"))
    pivots = pivots.select("key", "fp", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("lo"))
    blocks = dealt.select("key", "fp", "lo").unionByName(pivots).select("key", "fp", "lo", F.col("lo").alias("hi"), F.lit(2).alias("side"), F.col("fp").alias("tree"))
    found = sorted_units(attach(blocks), ["key"], "fp", parts).mapInPandas(_edges(test), "a binary, b binary")
    together = components(found)
    # groups of several blocks that are still in several pieces
    named = wide.join(together.withColumnRenamed("node", "fp"), "fp", "left").select("key", "m", "total", "fp", F.coalesce("root", "fp").alias("tree"))
    split = stored(named.groupBy("key").agg(F.min("tree").alias("one"), F.max("tree").alias("other")).where("one <> other").select("key"), "connect-split")
    if split.isEmpty():
        return together
    units = sorted_units(attach(_across(named.join(split, "key"), block)), ["key"], "fp", parts)
    more = components(units.mapInPandas(_edges(test), "a binary, b binary")).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # a component's root stands for it, a node without one for itself
    whole = together.join(more, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = more.join(together.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return stored(whole.unionByName(alone), "connect-roots")


def _across(named: DataFrame, block: int) -> DataFrame:
    """named (key, m, total, fp, tree) of groups in several pieces -> units in which every
    pair of members of different pieces meets."""
    pieces = named.groupBy("key", "tree").agg(F.count(F.lit(1)).alias("n"))
    main = pieces.groupBy("key").agg(F.max_by("tree", F.struct("n", "tree")).alias("main"), F.max("n").alias("most"))
    rows = named.join(main, "key").withColumn("others", F.col("m") - F.col("most"))
    count = lambda n: F.greatest(F.ceil(F.col("total") / HELD), F.least(F.ceil(F.col(n) / block), F.lit(SPREAD))).cast("int")
    rows = rows.withColumn("n0", count("most")).withColumn("n1", count("others"))
    place = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    other = rows.where("tree <> main")
    columns = ["key", "fp", "tree", "lo", "hi", "side"]
    first = rows.where("tree = main").withColumn("lo", place("n0")).withColumn("hi", all_of("n1")).withColumn("side", F.lit(0))
    second = other.withColumn("hi", place("n1")).withColumn("lo", all_of("n0")).withColumn("side", F.lit(1))
    third = dealt_units(other, "others", F.col("total"), "fp", block).withColumn("lo", -1 - F.col("lo"))
    return first.select(*columns).unionByName(second.select(*columns)).unionByName(third.select(*columns))


def _parts(rows: DataFrame) -> int:
    """Partitions that hold about four units of work of full size each."""
    total = rows.agg(F.sum("held")).first()[0] or 0
    return int(total // (4 * HELD))
