"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of 5-word shingles (64-bit hashes). Equal sets are one class,
so copies never meet pair by pair. Classes get ``HASHES`` MinHash values:

1. Bands of ``ROWS`` values deal classes into buckets. Within a bucket, pairs
   compare one byte of each value in steps of ``STEP``; a pair goes as soon as
   the posterior probability (uniform prior) that its similarity reaches the
   threshold falls under ``TOLERANCE``. What survives joins families; only what
   holds together is wanted here, so a large bucket goes block by block around a few
   pivots, and pairs of blocks meet only where that leaves members apart
   (``connect``). No rows are made for each pair.
2. A family's members meet again, with their texts: pairs are pruned the same
   way, the rest is verified exactly on the whole shingle sets. Out come the
   links of each class and a spanning forest of the verified links.

A family above ``BLOCK`` members is cut into blocks by a hash, as its links are
counted; each pair of blocks is one unit of work, and a member goes to every unit of its block.
There are at most ``SPREAD`` blocks, so that what moves grows in proportion to the
group, until a block would hold more than ``HELD`` values (shingles, or bytes of
signatures): from there on blocks keep that size. That many copies of a member are
the least that all pairs need where a task holds two blocks at a time.

Texts move only for members of families: a bounded filter of row keys stands
before that shuffle.

A pair at exactly the threshold meets in no band with probability
(1 - 0.8**4)**28, under 4e-7; above it, less.

Defined results: null, empty and white-space texts have no shingle, link to
nothing and are classes of their own row; texts of fewer than five words have
one shingle, all their words; a similarity of exactly the threshold is a link; rows
with null ids take part; repeated rows are members of one class like other copies,
told apart by where they stand; texts of any length are read whole, a family of very
long ones is cut into more blocks; an empty table gives an empty result; only
doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelode.operators.memory import give_back

from .batches import chunks, with_found
from .common import key_filter, numbered, own_name, passing, stored, without
from .connect import BLOCK, Forest, connected, in_units, unit_pairs, whole_units
from .graph import components
from .shingles import minhash, mix, set_fingerprint, shingle_sets

WORDS, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP = 112, 4, 16
TOLERANCE = 1e-5


def least_matches(hashes: int = HASHES, step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, the posterior probability of
    reaching the threshold is under the tolerance. Under a uniform prior that
    posterior is the chance of at most m successes in n + 1 trials. One byte of a
    value also agrees by chance, once in 256."""
    t, out = threshold + (1 - threshold) / 256, []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def prune(sig: np.ndarray, left: np.ndarray, right: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs (left, right) whose posterior stays above the tolerance."""
    alive, matched, at = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, m in needs:
        if not len(alive):
            break
        same = (sig[left[alive], at:n] == sig[right[alive], at:n]).sum(1)
        matched, at = matched + same, n
        stay = matched >= m
        alive, matched = alive[stay], matched[stay]
    return alive


SKETCH = T.StructType(
    [T.StructField("fp", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)


def sketch(docs: DataFrame) -> DataFrame:
    """docs (doc_id, row_, text) -> doc_id, row_, the fingerprint of the text's shingle set (null
    without shingles), its size, one byte of each MinHash value and a hash of each band."""
    bands = HASHES // ROWS
    place = mix(np.arange(1, HASHES + 1, dtype=np.uint64))

    def work(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"fp": [], "n_shingles": [], "sig": [], "bands": []}
        for a, b in chunks(texts):
            sets = shingle_sets(texts[a:b], WORDS)
            full = [s for s in sets if len(s)]
            values = minhash(full, HASHES) if full else np.zeros((0, HASHES), np.uint32)
            key = mix((mix(values.astype(np.uint64)) * (place | np.uint64(1))).reshape(len(full), bands, ROWS).sum(2, dtype=np.uint64) + place[:bands])
            rows = iter(range(len(full)))
            for s in sets:
                k = next(rows) if len(s) else None
                out["fp"].append(None if k is None else set_fingerprint(s))
                out["n_shingles"].append(len(s))
                out["sig"].append(None if k is None else (values[k] & 0xFF).astype(np.uint8).tobytes())
                out["bands"].append(None if k is None else key[k].view(np.int64))
        return out

    return with_found(docs, "text", SKETCH, work)


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), HASHES)


def families(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """classes (fp, sig, bands) -> (node, root) of all that may be linked with another:
    what pruning leaves together in some bucket."""
    needs = least_matches(threshold=threshold)
    dealt = classes.select(F.explode("bands").alias("key"), "fp", F.lit(HASHES).cast("long").alias("held"))

    def near(frame: pd.DataFrame) -> Callable:
        sig = _signatures(frame["sig"])
        return lambda left, right: prune(sig, left, right, needs)

    return connected(dealt, lambda rows: rows.join(classes.select("fp", "sig"), "fp"), near, block)


def verify(members: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """members (family, m, shingles, fp, weight, sig, text) -> rows (a, null, links) with
    the documents that class a links to, and rows (a, b, 0): a forest of the links.
    m, shingles: members of the family, and shingles in all of them."""
    needs = least_matches(threshold=threshold)
    units = in_units(members, ["family"], "m", F.col("shingles"), "fp", block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, first in whole_units(batches, ["family", "lo", "hi"]):
            sets = []
            for a, b in chunks(texts := frame["text"].tolist()):
                sets += shingle_sets(texts[a:b], WORDS)
            fp, weight = frame["fp"].tolist(), frame["weight"].to_numpy()
            if any(set_fingerprint(s) != f for s, f in zip(sets, fp, strict=True)):
                raise ValueError("the rows of docs changed between two reads")
            size, sig, side = np.array([len(s) for s in sets]), _signatures(frame["sig"]), frame["side"].to_numpy()
            links, forest = np.zeros(len(frame), np.int64), Forest(len(frame))
            for left, right in unit_pairs(first, side):
                near = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-9
                left, right = left[near], right[near]
                ok = prune(sig, left, right, needs)
                left, right = left[ok], right[ok]
                both = shared_counts(sets, left, right)
                ok = both >= threshold * (size[left] + size[right] - both) - 1e-9
                left, right = left[ok], right[ok]
                np.add.at(links, left, weight[right])
                np.add.at(links, right, weight[left])
                forest.add(left, right)
            some = np.flatnonzero(links)
            a, b = [fp[i] for i in some.tolist()], [None] * len(some)
            yield pd.DataFrame({"a": a + [fp[x] for x, _ in forest.edges], "b": b + [fp[y] for _, y in forest.edges], "links": links[some].tolist() + [0] * len(forest.edges)})
        give_back()

    return units.select("family", "lo", "hi", "side", "fp", "weight", "sig", "text").mapInPandas(run, "a binary, b binary, links long")


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections: many pairs of few sets by matrix products
    over slices of the shingles that several of them have, else set by set."""
    out = np.zeros(len(left), np.int64)
    if not len(left):
        return out
    rows, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    if len(left) < 8 * len(rows):
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            out[i] = np.count_nonzero(y[place] == x)
        return out
    one, two = at[: len(left)], at[len(left) :]
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    several = times > 1
    place = np.cumsum(several) - 1
    several = several[column]
    owner, column, n = owner[several], place[column[several]], int(place[-1]) + 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    wide = max(1, 4_000_000 // len(rows))
    for start in range(0, n, wide):
        a, b = np.searchsorted(column, [start, start + wide])
        grid = np.zeros((len(rows), min(wide, n - start)), np.float32)
        grid[owner[a:b], column[a:b] - start] = 1
        total += grid @ grid.T
    return total[one, two].astype(np.int64)


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest id among all that
    links connect), copy_id (smallest id with an equal shingle set), n_copies,
    n_links (documents with a similarity of the threshold or more, but itself)."""
    row = own_name(docs, "row_")
    return linked(numbered(docs, "ngram-rows", row), row, threshold).drop("row_", "kept")


def linked(docs: DataFrame, row: str, threshold: float = THRESHOLD) -> DataFrame:
    """join for a table with the row key ``row``: the same columns, row_, and
    whether the row is the one of its class that stays (the smallest id, null ids
    last, then the first row)."""
    if (1 - threshold**ROWS) ** (HASHES // ROWS) > TOLERANCE:
        raise ValueError(f"{HASHES // ROWS} bands of {ROWS} values miss too many pairs at a threshold of {threshold}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row_"), "text")
    sketches = stored(sketch(docs), "ngram-sketch")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_")
    classes = sketches.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("copy_id"), F.min(first).alias("first"), F.count(F.lit(1)).alias("weight"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "ngram-classes")
    held = families(classes, threshold).withColumnRenamed("node", "fp").withColumnRenamed("root", "family")
    held = held.join(classes.select("fp", "first.row_", "n_shingles", "weight", "sig"), "fp")
    held = stored(held, "ngram-held")
    sizes = held.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("shingles"))
    texts = passing(docs.select("row_", "text"), F.col("row_"), stored(key_filter(held, "row_"), "ngram-filter"))
    members = held.join(sizes, "family").join(texts, "row_").select("family", "m", "shingles", "fp", "weight", "sig", "text")
    found = stored(verify(members, threshold), "ngram-links")
    links = found.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "fp")
    named = classes.select("fp", "copy_id", "first", "weight").join(links, "fp", "left").join(roots, "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "ngram-named")
    best = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("first")["row_"].alias("stays"))
    named = named.join(best, "root").select("fp", "copy_id", "weight", "class_id", "stays", F.coalesce("links", F.lit(0)).alias("links"))
    return sketches.select("doc_id", "row_", "fp").join(named, "fp", "left").select(
        "doc_id",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("weight", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        "row_",
        (F.col("fp").isNull() | (F.col("row_") == F.col("stays"))).alias("kept"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, as they are: exactly one of each class, whatever
    ids its rows have. Rows without shingles all stay."""
    row = own_name(docs, "row_")
    rows = numbered(docs, "ngram-rows", row)
    gone = linked(rows, row).where("not kept").select(F.col("row_").alias(row))
    return without(rows, gone, row).select(*docs.columns)
