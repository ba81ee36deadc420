"""Weighted rendezvous hashing of record keys over shards.

A record goes to the shard with the best score; a score depends on the key and
the shard alone, so one more shard only takes records into itself. With weight
w and a uniform hash u of (key, shard) the score is -w / ln(u): shards get
records in proportion to their weights.

Slots number a shard's records without gaps. They are counted in two levels: a
record's place within one of ``BUCKETS`` buckets of its shard, plus the sizes of the
buckets before. Buckets are dealt by the record's row, not its key, so records that
share a key (a null one, say) spread evenly; no task sorts a whole shard. The table
of bucket sizes has shards x BUCKETS rows at most; it is broadcast only up to
``BROADCAST_ROWS`` of them, and joined by Spark's choice beyond.

Defined results: a null key is a key like others, and all such records share a
shard; a null text has no bytes, and the checksum of none; of equal scores the
shard with the higher number wins, with and without one more shard; repeated rows
share a shard and get slots of their own; texts of any length count whole; an empty
table gives an empty result; ``shard`` reads the key and text only, so other columns
never clash; ``write`` calls the folders ``folder``, which must not be a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1024
BROADCAST_ROWS = 100_000
ROW_BYTES = 16
_UNIT = 1 << 52


def score(key: Column, shard: Column, weight: Column) -> Column:
    u = (F.pmod(F.xxhash64(key, shard), F.lit(_UNIT)) + 0.5) / float(_UNIT)
    return -weight / F.ln(u)


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the best shard; of equal scores the higher number."""
    wanted = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in enumerate(weights) if w > 0])
    scored = F.transform(wanted, lambda x: F.struct(score(key, x["shard"], x["weight"]).alias("score"), x["shard"].alias("shard")))
    return F.array_max(scored)


def shard(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """docs (key, text) -> key, size, text_crc32, shard, slot and grown_shard, where
    the record would go with one more shard of weight ``grown_weight``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    extra = F.lit(len(weights))
    grows = score(F.col(key), extra, F.lit(float(grown_weight))) >= F.col("best.score")
    rows = docs.select(key, (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), best_shard(F.col(key), weights).alias("best"))
    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    rows = rows.select(key, "size", "text_crc32", F.col("best.shard").alias("shard"), bucket.alias("bucket"), F.when(grows, extra).otherwise(F.col("best.shard")).alias("grown_shard"))
    # written, so that both counts see the same buckets
    rows = stored(rows, "shard-rows")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32", "size")
    rows = rows.withColumn("place", F.row_number().over(place) - 1)
    rows = rows.join(F.broadcast(offsets) if len(weights) * buckets <= BROADCAST_ROWS else offsets, ["shard", "bucket"])
    return rows.select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, weights: Sequence[float], files: int = 1, key: str = "doc_id", folder: str = "shard") -> None:
    """docs as Parquet, a folder for each shard. A shard's rows go to ``files`` tasks
    by key and text, so that no task holds a whole shard of a large table."""
    if folder.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {folder}; name the folders otherwise")
    placed = docs.withColumn(folder, best_shard(F.col(key), weights)["shard"])
    part = F.pmod(F.xxhash64(key, "text"), F.lit(files))
    placed.repartition(max(1, len(weights) * files), folder, part).write.partitionBy(folder).parquet(path)
