"""Prefix trie of conversations by Patricia construction.

A conversation becomes one binary path: for each turn a digest of role and text
(16 bytes) and its words (8 bytes), so a prefix of turns is a prefix of the path and
texts never move. Equal paths are one row with a count. Then:

1. Paths are sorted into ranges, and each task streams its range through a stack:
   what two neighbours share closes the points above it. Only branch, end and leaf
   points are made; a point carries its compressed edge as suffix sums of words.
   Members, leaves and savings are summed on these points as they close.
2. A node that several ranges share is a prefix of a range's first or last path. The
   prefixes of these two are made without compression and with partial sums; they
   are merged by key and summed bottom-up in one task, which gets two paths a range.
3. Points meet their parents' smallest member, and unary nodes are expanded from the
   suffix sums of their edge.

Digests of member lists: ends are dealt by ranges of (node, conv_id); each task writes
a node's ids out in runs of ``RUN`` bytes, and a second step feeds the runs of a node
to one hash in order, as SHA-256 must. A conversation that a third of all repeat is
thus a few rows to the task that hashes it, and no list is held.

A conversation is a record here: its digests (24 bytes a turn) are one row. The stack
is as deep as the longest path has points.

Defined results: rows without conv_id belong to no conversation and are left out; a null
turn comes first; turns that share a number come in order of their digest; null role
or text is empty; repeated rows are turns of their own; texts of any length are
read whole; a conversation without turns after rebuilding ends at the root; an empty
table has no node; only conv_id, turn, role and text are read, so other columns never
clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, stored

UNIT, RUN = 24, 1 << 16


def turn_units(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the units of its turns in order, as hexadecimal text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    unit = F.concat(F.substring(digest, 1, 32), F.lower(F.lpad(F.hex(n_words(text)), 16, "0")))
    each = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", unit.alias("unit")).alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["unit"].alias("turns"))


def paths(units: DataFrame) -> DataFrame:
    """conv_id, turns -> conv_id, path."""
    return units.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path"))


def rebuilt(units: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first h turns, h = crc32 of its number modulo ``most``,
    taken from the first conversation of its group of ``group`` numbers."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    heads = units.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = units.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    none = F.array().cast("array<string>")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return own.join(heads, "base", "left").select("conv_id", turns.alias("turns"))


@dataclass
class Node:
    """A point: members and sums below it, but those below shared points."""

    depth: int
    id: bytes
    shared: bool
    n: int = 0
    low: int | None = None
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: bytes | None = None

    def add(self, n: int, low: int | None) -> None:
        self.n += n
        if low is not None:
            self.low = low if self.low is None else min(low, self.low)


POINTS = "shared boolean, id binary, alias binary, parent binary, depth long, n long, low long, kids long, leaves long, saved long, suffix array<long>, ends binary"


def key_of(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: depth * UNIT]).digest()


def keys_of(path: bytes) -> list[bytes]:
    """key_of every prefix."""
    running, out = hashlib.md5(), [hashlib.md5().digest()]
    for at in range(0, len(path), UNIT):
        running.update(path[at : at + UNIT])
        out.append(running.copy().digest())
    return out


def shared_turns(x: bytes, y: bytes) -> int:
    n = 0
    while n < min(len(x), len(y)) and x[n : n + UNIT] == y[n : n + UNIT]:
        n += UNIT
    return n // UNIT


def words_on(path: bytes, low: int, high: int) -> np.ndarray:
    """Words of the turns low + 1 to high."""
    units = np.frombuffer(path, np.uint8, (high - low) * UNIT, low * UNIT).reshape(-1, UNIT)
    return np.ascontiguousarray(units[:, 16:]).view(">i8").ravel().astype(np.int64)


def points(sorted_paths: Iterator[tuple[bytes, int, int]], task: int) -> Iterator[tuple]:
    """Sorted distinct (path, members that end there, smallest of them) -> rows of POINTS."""
    stack: list[Node] = []
    last, made = b"", 0

    def fresh(depth: int) -> Node:
        nonlocal made
        made += 1
        return Node(depth, struct.pack(">qq", task, made), False)

    def row(node: Node, parent: bytes | None, suffix: list[int], alias: bytes | None = None) -> tuple:
        return (node.shared, node.id, alias, parent, node.depth, node.n, node.low, node.kids, node.leaves, node.saved, suffix, node.ends)

    def close(keep: int) -> Iterator[tuple]:
        """Closes what is deeper than ``keep`` turns on the last path."""
        while stack[-1].depth > keep:
            node = stack.pop()
            if stack[-1].depth < keep:
                stack.append(fresh(keep))
            parent = stack[-1]
            words = words_on(last, parent.depth, node.depth)
            if node.shared:  # so is its parent, and their sums are joined later
                yield row(node, parent.id, words.tolist())
                continue
            node.leaves += node.kids == 0
            suffix = np.cumsum(words[::-1])[::-1].tolist()
            yield row(node, parent.id, suffix)
            parent.add(node.n, node.low)
            parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + node.leaves, parent.saved + node.saved + (node.n - 1) * suffix[0]

    for path, n, low in sorted_paths:
        depth = len(path) // UNIT
        if not stack:
            stack = [Node(d, key, True) for d, key in enumerate(keys_of(path))]
        else:
            yield from close(shared_turns(last, path))
            stack.append(fresh(depth))
        stack[-1].add(n, low)
        stack[-1].ends, last = key_of(path, depth), path
    if stack:
        # every prefix of the last path is shared, whether it is a point or not
        found, keys = {node.depth: node for node in stack}, keys_of(last)
        for depth, key in enumerate(keys):
            node = found.get(depth) or Node(depth, key, True)
            alias = None if node.shared else node.id
            node.id, node.shared = key, True
            yield row(node, keys[depth - 1] if depth else None, words_on(last, max(0, depth - 1), depth).tolist() or [0], alias)


def _tables(rows: Iterator[tuple], names: list[str], size: int = 5000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.bool_(), *[pa.binary()] * 3, *[pa.int64()] * 6, pa.list_(pa.int64()), pa.binary()]
    full = True
    while full:
        run = list(islice(rows, size))
        full = len(run) == size
        if run:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*run, strict=True), kinds, strict=True)], names=names)


def compressed(members: DataFrame) -> DataFrame:
    """conv_id, path -> POINTS of all ranges."""
    names = [part.split()[0] for part in POINTS.split(", ")]
    distinct = members.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    ranges = distinct.repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("path", "n", "low")), strict=True))
        yield from _tables(points(rows, TaskContext.get().partitionId()), names)

    return ranges.select("path", "n", "low").mapInArrow(run, POINTS)


def merged(found: DataFrame) -> DataFrame:
    """The shared points: partial sums of ranges into whole ones, children into parents.
    Two paths a range at most, so one task takes them all."""
    parts = found.where("shared").groupBy("id").agg(
        F.first("parent", True).alias("parent"), F.first("depth").alias("depth"), F.first("suffix").alias("suffix"), F.max("ends").alias("ends"), F.min("low").alias("low"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    )

    def up(rows: pa.Table) -> pa.Table:
        nodes = {r["id"]: r for r in rows.to_pylist()}
        for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
            node["leaves"] += node["kids"] == 0
            parent = nodes.get(node["parent"])
            if parent is not None:
                parent["n"] += node["n"]
                parent["low"] = min(x for x in (parent["low"], node["low"]) if x is not None)
                parent["kids"] += 1
                parent["leaves"] += node["leaves"]
                parent["saved"] += node["saved"] + (node["n"] - 1) * node["suffix"][0]
        return pa.Table.from_pylist(list(nodes.values()), schema=rows.schema)

    return parts.groupBy().applyInArrow(up, parts.schema)


def _members_of(rows: Iterator[tuple[bytes, int, str]], most: int) -> Iterator[tuple[bytes, int, str]]:
    """Sorted (key, place, text) -> the same with neighbours of a key joined up to
    ``most`` characters."""
    key, place, held, size = None, 0, [], 0
    for k, p, text in rows:
        if held and (k != key or size >= most):
            yield key, place, ",".join(held)
            held, size = [], 0
        if not held:
            key, place = k, p
        held.append(text)
        size += len(text) + 1
    if held:
        yield key, place, ",".join(held)


def ends_digests(members: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id, path -> key of each path, ends_sha256 of the members that end there."""
    each = members.select(F.unhex(F.md5("path")).alias("key"), F.col("conv_id").alias("place"), F.col("conv_id").cast("string").alias("text"))
    order = ["key", "place"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, full = _members_of(rows(batches), run), True
        while full:
            some, size = [], 0
            for r in found:
                some.append(r)
                size += len(r[2]) + 32
                if size > 1 << 22:
                    break
            full = size > 1 << 22
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "place", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for b in batches:
            keys, out = [], []
            for k, _, text in rows([b]):
                if k == key:
                    running.update(b",")
                else:
                    if running:
                        keys.append(key)
                        out.append(running.hexdigest())
                    key, running = k, hashlib.sha256()
                running.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    runs = each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "key binary, place long, text string")
    return runs.repartition("key").sortWithinPartitions(*order).mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(units: DataFrame) -> DataFrame:
    """conv_id, turns -> a row for each node."""
    members = stored(paths(units), "trie-paths")
    found = stored(compressed(members), "trie-points")
    columns = ["id", "parent", "depth", "n", "low", "kids", "leaves", "saved", "suffix", "ends"]
    spine = stored(merged(found).select(*columns), "trie-shared")
    every = found.where("NOT shared").select(*columns).unionByName(spine)
    # smallest members by id; a point that turned out to be shared goes by two
    known = every.select(F.col("id").alias("parent"), F.col("low").alias("parent_low"))
    again = found.where("alias IS NOT NULL").select("alias", "id").join(spine.select("id", "low"), "id").select(F.col("alias").alias("parent"), F.col("low").alias("parent_low"))
    nodes = every.join(known.unionByName(again), "parent", "left").join(ends_digests(members).withColumnRenamed("key", "ends"), "ends", "left")
    return expanded(nodes)


def expanded(nodes: DataFrame) -> DataFrame:
    """Points with the suffix sums of their edges -> all nodes."""
    top, bottom = F.col("at") == 0, F.col("at") == F.size("suffix") - 1
    wide = nodes.select("*", F.posexplode("suffix").alias("at", "words"))
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return wide.select(
        F.col("low").alias("conv_id"),
        (F.col("depth") - F.size("suffix") + 1 + F.col("at")).cast("long").alias("depth"),
        F.when(top, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
        F.when(bottom & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(none).alias("ends_sha256"),
    )
