"""From scored instants to a smoothed signal at ``HZ`` bins a second.

A group (a video, or a request and a video) is named by ``keys``. Bins are kept
sparse until they meet the kernel; each shuffle is on the keys and the bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HZ = 2
# Scales in seconds with their weights, and the cut of a kernel in sigmas.
SCALES, SCALE_WEIGHTS, TRUNCATE = (0.5, 1.5, 3.5), (0.35, 0.45, 0.20), 4.0
DEFAULT_SIGMA = 1.5


def gaussian(sigma_seconds: float, hz: int = HZ) -> dict[int, float]:
    sigma = max(0.5, sigma_seconds * hz)
    radius = int(TRUNCATE * sigma + 0.5)
    raw = {k: exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def multiscale(hz: int = HZ) -> dict[int, float]:
    """The weighted sum of the scales' kernels: smoothing is linear, one pass does."""
    out: dict[int, float] = {}
    for scale, weight in zip(SCALES, SCALE_WEIGHTS, strict=True):
        for k, v in gaussian(scale, hz).items():
            out[k] = out.get(k, 0.0) + weight * v
    return dict(sorted(out.items()))


def n_bins(duration, hz: int = HZ):
    return F.greatest(F.lit(1), F.ceil(duration * hz)).cast("long")


def bins(scored: DataFrame, keys: Sequence[str], hz: int = HZ) -> DataFrame:
    """scored (keys, t, score, duration_sec) -> keys, n, idx, score: the highest
    score of a bin, 0 at least. Halves round to even."""
    n = n_bins(F.col("duration_sec"), hz)
    idx = F.least(n - 1, F.greatest(F.lit(0), F.bround(F.col("t") * hz))).cast("long")
    return scored.select(*keys, n.alias("n"), idx.alias("idx"), F.greatest(F.lit(0.0), "score").alias("score")).groupBy(*keys, "n", "idx").agg(F.max("score").alias("score"))


def smooth(binned: DataFrame, keys: Sequence[str], kernel: dict[int, float], by: Sequence[str] | None = None) -> DataFrame:
    """binned (keys, n, idx, score) -> keys, n, idx, smoothed for every bin. The edge
    bins stand for all positions beyond them. by: those keys that tell groups apart,
    if others only go along."""
    radius = max(kernel)
    # sparse bins go to their group's partition once; the kernel's many parts, their
    # sums and all windows over a group then need no further shuffle. The number is
    # given, as sparse bins say little of the rows to come and would be coalesced
    parts = int(binned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    binned = binned.repartition(parts, *(by or keys))
    first = F.when(F.col("idx") == 0, -radius).otherwise(F.col("idx"))
    last = F.when(F.col("idx") == F.col("n") - 1, F.col("n") - 1 + radius).otherwise(F.col("idx"))
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kernel.items()])
    spread = binned.where("score > 0").select(*keys, "n", "score", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("at"))
    spread = spread.select(*keys, "n", "score", "at", F.explode(taps).alias("tap"))
    spread = spread.select(*keys, "n", (F.col("at") + F.col("tap.k")).alias("idx"), (F.col("score") * F.col("tap.w")).alias("part"))
    empty = binned.select(*keys, "n").distinct().select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"), F.lit(0.0).alias("part"))
    inside = spread.where((F.col("idx") >= 0) & (F.col("idx") < F.col("n")))
    return inside.unionByName(empty).groupBy(*keys, "n", "idx").agg(F.sum("part").alias("smoothed"))


def normalise(smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``value``: smoothed scaled to [0, 1] by the group's range (as it is where
    that is flat), to 9 places, so that comparisons don't hang on summation order."""
    whole = Window.partitionBy(*keys)
    low, high = F.min("smoothed").over(whole), F.max("smoothed").over(whole)
    ranged = smoothed.withColumn("low", low).withColumn("high", high)
    value = F.when(F.col("high") > F.col("low"), (F.col("smoothed") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("smoothed"))
    return ranged.select(*keys, "n", "idx", "smoothed", F.round(value, 9).alias("value"))


def heatmap(signal: DataFrame, keys: Sequence[str], hz: int = HZ) -> DataFrame:
    """signal (keys, n, idx, value, duration_sec) -> keys, sec, value: each second's
    bin, the last one where the timeline ends early."""
    seconds = F.ceil("duration_sec").cast("long")
    last = F.col("idx") == F.col("n") - 1
    own = F.when(F.col("idx") % hz == 0, F.array(F.floor(F.col("idx") / hz))).otherwise(F.array().cast("array<bigint>"))
    beyond = F.when(last & (F.floor((F.col("n") - 1) / hz) + 1 < seconds), F.sequence(F.floor((F.col("n") - 1) / hz) + 1, seconds - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = signal.select(*keys, "value", seconds.alias("seconds"), F.explode(F.concat(own, beyond)).alias("sec"))
    return rows.where("sec < seconds").select(*keys, "sec", F.round("value", 3).alias("value"))
