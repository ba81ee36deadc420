"""op11 against a trie of nested dictionaries."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from timelode.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], n, role, text))
    return {c: [(t[3], t[4]) for t in sorted(turns)] for c, turns in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def expected(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaf = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        kids = sum(len(k) == len(key) + 1 for k in below)
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), kids, len(leaf), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 7 == 3:
            turns = [("user", "hot hot"), ("bot", "same same same")]
        else:
            turns = [(rng.choice(["user", "bot", None]), rng.choice(["a", "b c", None, "hot hot", " d\te\n"])) for _ in range(rng.randint(1, 6))]
        rows += [(c, t if rng.random() < 0.9 else None, r, x, "p", 1) for t, (r, x) in enumerate(turns)]
    return [*rows, (None, 0, "user", "lost", "p", 1), (5, 1, "user", "again", None, None), (5, 1, "user", "again", None, None), (10**12, 0, "", "one", "", 0)] + [(777, t, "user", "long " * (t % 5), "", 0) for t in range(120)]


@pytest.mark.parametrize("seed,ranges", [(1, "1"), (2, "8"), (3, "50")])
def test_every_node(spark, seed, ranges):
    """Over few and many ranges, so that prefixes are shared between tasks or not."""
    rows = sample(90, seed)
    found = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_units(found))).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r[n] for n in NAMES) for r in got if r.depth) == sorted(e for e in expected(rebuilt(conversations(rows))) if e[1])
    assert [tuple(r[n] for n in NAMES) for r in got if not r.depth] == [e for e in expected(rebuilt(conversations(rows))) if not e[1]]


def test_only_points_are_made(spark):
    """A long chain is one point, and what ranges share two paths at most."""
    rows = [(c, t, "user", f"{c} {t}" if t > 2 else str(t), "", 0) for c in range(6) for t in range(200)]
    members = prefix_trie.paths(prefix_trie.turn_units(spark.createDataFrame(rows, SCHEMA)))
    found = prefix_trie.compressed(members.coalesce(1)).collect()
    assert sum(not r.shared for r in found) <= 2 * 6 and sum(len(r.suffix) for r in found if not r.shared) <= 6 * 200


def test_runs_of_members(spark):
    """A node's members pass in runs, whatever their number."""
    members = spark.range(5000).select((F.col("id") * 3).alias("conv_id"), F.unhex(F.lit("00" * 24)).alias("path"))
    got = prefix_trie.ends_digests(members, run=100).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(str(3 * i) for i in range(5000)).encode()).hexdigest()]


def test_no_turns_and_no_rows(spark):
    """crc32 takes all own turns of 3 (h = 3 or more of none) and its base is absent: it ends at the root."""
    only = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_units(spark.createDataFrame([(only, 0, "user", "x", "", 0)], SCHEMA)))).collect()
    assert [tuple(r[n] for n in NAMES) for r in got] == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_units(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_no_row_is_lost_between_batches(spark):
    """A range makes more points than a batch of rows holds."""
    names = [part.split()[0] for part in prefix_trie.POINTS.split(", ")]
    made = ((False, b"", None, None, i, 1, i, 0, 1, 0, [0], b"") for i in range(25))
    assert [b.num_rows for b in prefix_trie._tables(made, names, 10)] == [10, 10, 5]
    turns = [(c, 0, "user", str(c), "", 0) for c in range(12_000)]
    units = prefix_trie.turn_units(spark.createDataFrame(turns, SCHEMA))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        got = prefix_trie.trie(units).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    none = hashlib.sha256(b"").hexdigest()
    leaves = [(c, 1, 0, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()) for c in range(12_000)]
    assert sorted(tuple(r[n] for n in NAMES) for r in got if r.depth) == leaves
    assert [tuple(r[n] for n in NAMES) for r in got if not r.depth] == [(0, 0, None, 12_000, 12_000, 12_000, 0, none)]
