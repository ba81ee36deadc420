"""Recall, mean overlap and onset error of predicted moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.functions.intervals import iou

# Fixed values of the evaluation.
TOP_KS, IOUS, MISSING_DELTA = (1, 5), (0.3, 0.5, 0.7), 100.0


def overlaps(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, rank, iou, delta: a row for each prediction, one with nulls for a
    query without any."""
    both = truth.join(predictions, "query_id", "left")
    overlap = F.when(F.col("rank").isNotNull(), iou(F.col("p_start"), F.col("p_end"), F.col("g_start"), F.col("g_end")))
    return both.select("query_id", "rank", overlap.alias("iou"), F.abs(F.col("p_start") - F.col("g_start")).alias("delta"))


def recall(predictions: DataFrame, truth: DataFrame, ks: Sequence[int] = TOP_KS, ious: Sequence[float] = IOUS) -> DataFrame:
    """k, theta, recall in percent: all cells from one row a query."""
    deep = overlaps(predictions.where(F.col("rank") <= max(ks)), truth)
    per = deep.groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("iou"))), F.lit(0.0)).alias(f"k{k}") for k in ks])
    cells = per.agg(*[F.avg(F.when(F.col(f"k{k}") >= t, 100.0).otherwise(0.0)).alias(f"c{k}_{i}") for k in ks for i, t in enumerate(ious)])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(t)).alias("theta"), F.round(f"c{k}_{i}", 2).alias("recall")) for k in ks for i, t in enumerate(ious)])
    return cells.select(F.explode(rows).alias("r")).select("r.*").where("recall is not null")


def mean_overlap(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """miou, mean_delta of the first predictions; no row without queries."""
    first = overlaps(predictions.where("rank = 1"), truth)
    out = first.agg(F.round(F.avg(F.coalesce("iou", F.lit(0.0))), 4).alias("miou"), F.round(F.avg(F.coalesce("delta", F.lit(MISSING_DELTA))), 2).alias("mean_delta"))
    return out.where("miou is not null")
