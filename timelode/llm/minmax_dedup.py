"""Near duplicates by min-max hashing.

Texts become sets of 5-word shingles (64-bit hashes, A-Z lower-cased); equal sets are one
class. ``PERMUTATIONS`` hash functions pass over a set, and both the minimum and the
maximum under each are kept: twice as many values as hash functions, each equal in
two sets with the probability of their Jaccard similarity. The share of equal values is
an unbiased estimate of it with half the variance, or less, that the minima alone
would have.

1. Bands of ``ROWS`` values, of minima or of maxima only, so of different functions,
   deal classes into buckets. A pair of a bucket stays while its share of equal values
   (one byte of each is compared) is within ``SPREAD`` standard deviations of the threshold.
2. What stays forms families; their texts move once, and links are confirmed on the
   whole shingle sets: 100 * intersection >= percent * union.

In both steps only what holds together is wanted (``connect``): work is linear in
a group that holds together, and no row is made for a pair.

A pair at exactly the threshold of 0.85 meets in no band with probability
(1 - 0.85**6)**30, under 7e-7, and is then dropped by the estimate with probability under
1e-6; above it, less.

Defined results: null, empty and white-space texts have no shingle and are linked
with nothing, not even with each other; texts of fewer than five words have one shingle,
all their words; a similarity of exactly the threshold is a link; a row with a null id takes
the smallest id that it reaches, null if there is none (then it is kept); repeated
rows are copies like others, so rows that share an id share kept; texts of any length are
read whole; an empty table gives an empty result; only doc_id and text are read,
so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import chunks, with_found
from .common import key_filter, numbered, own_name, passing, stored
from .connect import BLOCK, connected
from .ngram_join import shared_counts
from .shingles import min_max_hash, mix, set_fingerprint, shingle_sets

WORDS, PERCENT = 5, 85
PERMUTATIONS, ROWS, SPREAD = 90, 6, 5.5
VALUES = 2 * PERMUTATIONS

SKETCH = T.StructType(
    [T.StructField("fp", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)


def least_equal(percent: int = PERCENT) -> int:
    """Equal values below which a pair can't be a link, but for ``SPREAD`` deviations."""
    s = percent / 100
    return int(VALUES * s - SPREAD * (VALUES * s * (1 - s)) ** 0.5)


def sketch(docs: DataFrame) -> DataFrame:
    """docs (..., text) -> the fingerprint of the text's shingle set (null without
    shingles), its size, one byte of each value and a hash of each band."""
    bands = VALUES // ROWS
    place = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)

    def work(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"fp": [], "n_shingles": [], "sig": [], "bands": []}
        for a, b in chunks(texts):
            sets = shingle_sets(texts[a:b], WORDS, lower=True)
            full = [s for s in sets if len(s)]
            values = min_max_hash(full, PERMUTATIONS) if full else np.zeros((0, VALUES), np.uint32)
            key = mix((mix(values.astype(np.uint64)) * place).reshape(len(full), bands, ROWS).sum(2, dtype=np.uint64) + place[:bands])
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
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), VALUES)


def similar(percent: int) -> Callable[[pd.DataFrame], Callable]:
    """The test of a bucket: pairs whose estimate isn't out of reach."""
    least = least_equal(percent)

    def test(frame: pd.DataFrame, run: int = 100_000) -> Callable:
        sig = _signatures(frame["sig"])

        def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = [np.flatnonzero((sig[left[i : i + run]] == sig[right[i : i + run]]).sum(1) >= least) + i for i in range(0, len(left), run)]
            return np.concatenate(found) if found else np.zeros(0, int)

        return near

    return test


def linked(percent: int) -> Callable[[pd.DataFrame], Callable]:
    """The test of a family: whole shingle sets."""
    by_estimate = similar(percent)

    def test(frame: pd.DataFrame) -> Callable:
        sets = []
        for a, b in chunks(texts := frame["text"].tolist()):
            sets += shingle_sets(texts[a:b], WORDS, lower=True)
        if any(set_fingerprint(s) != f for s, f in zip(sets, frame["fp"], strict=True)):
            raise ValueError("the rows of docs changed between two reads")
        size, estimate = np.array([len(s) for s in sets]), by_estimate(frame)

        def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            low, high = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
            some = np.flatnonzero(100 * low >= percent * high)
            some = some[estimate(left[some], right[some])]
            one, two = left[some], right[some]
            both = shared_counts(sets, one, two)
            return some[100 * both >= percent * (size[one] + size[two] - both)]

        return near

    return test


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id that
    links reach), kept (whether that is its own)."""
    if (1 - (percent / 100) ** ROWS) ** (VALUES // ROWS) > 1e-6:
        raise ValueError(f"{VALUES // ROWS} bands of {ROWS} values miss too many pairs at {percent} percent")
    row = own_name(docs, "row_")
    docs = numbered(docs, "minmax-rows", row).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row_"), "text")
    sketches = stored(sketch(docs), "minmax-sketch")
    classes = sketches.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("low"), F.min("row_").alias("row_"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "minmax-classes")

    buckets = classes.select(F.explode("bands").alias("key"), "fp", F.lit(VALUES).cast("long").alias("held"))
    families = connected(buckets, lambda rows: rows.join(classes.select("fp", "sig"), "fp"), similar(percent), block)

    held = stored(families.withColumnsRenamed({"node": "fp", "root": "key"}).join(classes.select("fp", "row_", "n_shingles", "sig"), "fp"), "minmax-held")
    texts = passing(docs.select("row_", "text"), F.col("row_"), stored(key_filter(held, "row_"), "minmax-filter"))
    texts = held.select("fp", "sig", "row_").join(texts, "row_").select("fp", "sig", F.coalesce("text", F.lit("")).alias("text"))
    members = held.select("key", "fp", F.col("n_shingles").alias("held"))
    roots = connected(members, lambda rows: rows.join(texts, "fp"), linked(percent), block)

    named = classes.select("fp", "low").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "minmax-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    found = sketches.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    found = found.withColumn("component_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
