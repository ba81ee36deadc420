"""From a normalised signal to moments: threshold, clusters, valleys, suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the extraction.
THRESHOLD_FACTOR, GAP, VALLEY, MIN_SECONDS, MAX_SECONDS, OVERLAP = 0.8, 3, 0.7, 1.5, 60.0, 0.6


def thresholds(signal: DataFrame, keys: Sequence[str], factor: float = THRESHOLD_FACTOR) -> DataFrame:
    """keys, mu, sigma, theta over all bins of a group."""
    stats = signal.groupBy(*keys).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    return stats.withColumn("theta", F.round(F.col("mu") + factor * F.col("sigma"), 9))


def with_threshold(signal: DataFrame, keys: Sequence[str], factor: float | Column = THRESHOLD_FACTOR) -> DataFrame:
    """The same as a column of every bin: one shuffle with what follows, no join. The
    factor may be one of the keys."""
    whole = Window.partitionBy(*keys)
    return signal.withColumn("theta", F.round(F.avg("value").over(whole) + factor * F.stddev_pop("value").over(whole), 9))


def clusters(signal: DataFrame, keys: Sequence[str], gap: int = GAP) -> DataFrame:
    """Bins at or above the threshold with their cluster's number, from 0: a new one
    starts after more than ``gap`` bins."""
    order = Window.partitionBy(*keys).orderBy("idx")
    above = signal.where("value >= theta")
    starts = F.when(F.col("idx") - F.lag("idx").over(order) > gap, 1).otherwise(0)
    return above.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("starts")


def peaks(clustered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cluster, first, last, peak (the first highest bin), score."""
    return clustered.groupBy(*keys, "cluster").agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("idx", F.struct(-F.col("value"), F.col("idx"))).alias("peak"), F.max("value").alias("score")
    )


def valleys(signal: DataFrame, keys: Sequence[str], gap: int = GAP) -> DataFrame:
    """signal (keys, n, idx, value, theta) -> keys, n, cluster, peak, score, left, right.
    A walk from the peak stops at a bin at or under the threshold from which the
    signal rises again, or at the first bin under VALLEY times it. Both are flags
    of bins, so the walk is the nearest flag on each side, a running maximum or
    minimum."""
    order = Window.partitionBy(*keys).orderBy("idx")
    # the future is the past of the reversed order: a running value, where a frame
    # up to the end would be worked out anew for each bin
    back = Window.partitionBy(*keys).orderBy(F.desc("idx"))
    past, future = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (order, back))
    past_only, future_only = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))
    low, deep = F.col("value") <= F.col("theta"), F.col("value") < VALLEY * F.col("theta")
    above = F.col("value") >= F.col("theta")
    rows = signal.withColumn("rise_left", low & (F.lag("value").over(order) > F.col("value"))).withColumn("rise_right", low & (F.lead("value").over(order) > F.col("value"))).withColumn("deep", deep)
    # of a run of deep bins only the ends can be the nearest one to a peak
    inner = deep & F.coalesce(F.lag(deep).over(order) & F.lead(deep).over(order), F.lit(False))
    rows = rows.withColumn("inner", inner).where(~F.col("inner"))
    rows = rows.withColumn("before", F.max(F.when(above, F.col("idx"))).over(past_only))
    rows = rows.withColumn("starts", F.when(above & (F.col("idx") - F.col("before") > gap), 1).otherwise(0))
    rows = rows.withColumn("cluster", F.sum("starts").over(past).cast("long"))
    rows = rows.withColumn("left", F.greatest(F.max(F.when(F.col("rise_left"), F.col("idx"))).over(past), F.max(F.when(F.col("deep"), F.col("idx"))).over(past_only), F.lit(0)))
    rows = rows.withColumn("right", F.least(F.min(F.when(F.col("rise_right"), F.col("idx"))).over(future), F.min(F.when(F.col("deep"), F.col("idx"))).over(future_only), F.col("n") - 1))
    best = F.struct(-F.col("value"), F.col("idx"))
    found = rows.where(above).groupBy(*keys, "n", "cluster").agg(F.min_by(F.struct("idx", "value", "left", "right"), best).alias("at"))
    return found.select(*keys, "n", "cluster", F.col("at.idx").alias("peak"), F.col("at.value").alias("score"), F.col("at.left").alias("left"), F.col("at.right").alias("right"))


def bounded(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """found (keys, n, cluster, score, left, right, duration_sec) -> keys, cluster,
    t_start, t_end, score: bins as times, at least MIN_SECONDS (within the
    timeline) and at most MAX_SECONDS long."""
    step = F.when(F.col("n") > 1, F.col("duration_sec") / (F.col("n") - 1)).otherwise(0.0)
    end = F.when(F.col("n") > 1, F.col("duration_sec")).otherwise(0.0)
    rows = found.withColumn("s", F.col("left") * step).withColumn("e", F.col("right") * step).withColumn("end", end)
    rows = rows.withColumn("e", F.when(F.col("e") - F.col("s") < MIN_SECONDS, F.least("end", F.col("s") + MIN_SECONDS)).otherwise(F.col("e")))
    rows = rows.withColumn("e", F.when(F.col("e") - F.col("s") > MAX_SECONDS, F.col("s") + MAX_SECONDS).otherwise(F.col("e")))
    return rows.select(*keys, "cluster", F.round("s", 2).alias("t_start"), F.round("e", 2).alias("t_end"), F.round("score", 4).alias("score"))


def suppress(moments: DataFrame, keys: Sequence[str], overlap: float = OVERLAP) -> DataFrame:
    """moments (keys, cluster, t_start, t_end, score) -> those that greedy suppression
    keeps, with their rank from 1: best first (earlier first among equals), one
    goes if a kept one covers more than ``overlap`` of it. A group has few
    moments, one array; the groups are what scales."""
    one = F.struct((-F.col("score")).alias("worst"), "cluster", "t_start", "t_end", "score")
    lists = moments.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def step(kept, m):
        def covers(u):
            both = F.least(m["t_end"], u["t_end"]) - F.greatest(m["t_start"], u["t_start"])
            return (both > 0) & (both / F.greatest(F.lit(1e-5), m["t_end"] - m["t_start"]) > overlap)

        return F.when(F.exists(kept, covers), kept).otherwise(F.concat(kept, F.array(m)))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return lists.select(*keys, F.posexplode(kept).alias("at", "m")).select(*keys, (F.col("at") + 1).cast("long").alias("rank"), "m.t_start", "m.t_end", "m.score")
