"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: So many edges at most are finished by one task, in place of some rounds of shuffles.
ONE_TASK = 1_000_000


def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Edges -> (node, root), root the smallest node of what these edges connect, for
    every node but roots."""
    nodes = pc.unique(pa.chunked_array([a, b]))
    nodes = nodes.take(pc.sort_indices(nodes))
    left, right = (pc.index_in(x, nodes).to_numpy(zero_copy_only=False) for x in (a, b))
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        for side in (left, right):  # a root hears of the least root that an edge joins it to
            np.minimum.at(root, before[side], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes.take(pa.array(far)), nodes.take(pa.array(root[far]))


def _contracted(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> as many or fewer that connect the same, from each batch its stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(list(stars(batch.column("u"), batch.column("v"))), names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _finished(edges: DataFrame) -> DataFrame:
    """edges (u, v), a bounded number, in one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        u, v = (table[c].chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("u", "v"))
        return pa.table(list(stars(u, v)), names=["u", "v"]) if table.num_rows else table

    return edges.select("u", "v").groupBy().applyInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, root), root the component's
    smallest node. Edges are contracted batch by batch, then large-star and small-star rounds
    go on until ``one_task`` edges or fewer are left, or nothing changes; each round ends in a table
    of the shared folder. Every key's neighbours are only reduced to a minimum
    and joined back, never gathered, so a hub is no list in one task; the minima are
    dealt anew before the join, which lets Spark split a hub's edges."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = stored(_contracted(e).distinct(), "cc-edges")
    while True:
        if e.limit(one_task + 1).count() <= one_task:
            e = stored(_finished(e), "cc-last")
            break
        # large star: every neighbour above u points at the least of u's closed neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = stored(large, "cc-large")
        # small star: u and every smaller neighbour point at the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("rebalance"), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = stored(small, "cc-small")
        # done when every node has one root, and no root has another
        size = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("nodes")).first()
        if size["n"] == size["nodes"] and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stored(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "cc-roots")
