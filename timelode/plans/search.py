"""Whole plans: moments of a timeline, and moment search for requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.text import clean_caption
from timelode.operators import moments as M
from timelode.operators import retrieval as R
from timelode.operators import scoring as S
from timelode.operators import signal as G

FLOOR, CALIBRATION, LEAST_FACTOR = 0.12, 0.35, 0.40  # fixed values of the calibration


def signal(scored: DataFrame, keys: Sequence[str], kernel: dict[int, float] | None = None) -> DataFrame:
    """scored (keys, t, score, duration_sec) -> keys, n, idx, smoothed, value. The
    duration may be one of the keys: it goes along and tells no groups apart."""
    by = [k for k in keys if k != "duration_sec"]
    return G.normalise(G.smooth(G.bins(scored, keys), keys, kernel or G.multiscale(), by), keys)


def moments(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The moments of each group after suppression, ranked. The duration goes along as
    one of the keys, so nothing is joined back."""
    group = [*keys, "duration_sec"]
    found = M.valleys(M.with_threshold(signal(scored, group), group), group)
    return M.suppress(M.bounded(found, group), group).drop("duration_sec")


def _signals(frames: DataFrame, transcripts: DataFrame, videos: DataFrame, wanted: Sequence[S.Request], dim: int) -> tuple[DataFrame, list[str]]:
    """The signal of each request and video, and its keys: what is one value for a group
    (duration, top_k, factor, the highest value) goes along as a key, not by a join.
    Requests that smooth alike go through one kernel together."""
    spark = frames.sparkSession
    keys = ["request_id", "video_id", "duration_sec", "top_k", "factor"]
    scored = S.fused(frames, transcripts, videos, S.requests(spark, wanted), dim).join(videos, "video_id").withColumnRenamed("ts", "t")
    by_kernel: dict[float | None, list[S.Request]] = {}
    for r in wanted:
        by_kernel.setdefault(None if r.multiscale else float(r.gaussian_sigma), []).append(r)
    out = []
    for sigma, some in sorted(by_kernel.items(), key=lambda x: -1.0 if x[0] is None else x[0]):
        params = spark.createDataFrame([(r.request_id, int(r.top_k), float(r.threshold_factor)) for r in some], "request_id long, top_k int, factor double")
        out.append(signal(scored.join(params, "request_id"), keys, None if sigma is None else G.gaussian(sigma)))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("top", F.max("value").over(Window.partitionBy(*keys))), [*keys, "top"]


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best moments of each group, with calibrated scores; none where the signal is
    flat and faint."""
    found = M.valleys(M.with_threshold(rows.where(F.col("top") >= FLOOR), keys, F.col("factor")), keys)
    kept = M.suppress(M.bounded(found, keys), keys).where(F.col("rank") <= F.col("top_k"))
    factor = F.least(F.lit(1.0), F.greatest(F.lit(LEAST_FACTOR), F.col("top") / CALIBRATION))
    return kept.select("request_id", "video_id", "rank", "t_start", "t_end", F.round(F.col("score") * factor, 3).alias("score"))


def search(frames: DataFrame, transcripts: DataFrame, videos: DataFrame, wanted: Sequence[S.Request], dim: int, top_k: int | None = None) -> DataFrame:
    """request_id, video_id, rank, t_start, t_end, score: the best moments of each
    video for each request, by the request's own numbers. top_k: in place of theirs."""
    wanted = [replace(r, top_k=top_k) for r in wanted] if top_k else wanted
    return _best(*_signals(frames, transcripts, videos, wanted, dim))


def heatmaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The signals of ``_signals`` -> request_id, video_id, at, value: a value a second, or,
    without a match, every second bin."""
    match = G.heatmap(rows.where(F.col("top") >= FLOOR), ["request_id", "video_id"]).withColumnRenamed("sec", "at")
    none = rows.where((F.col("top") < FLOOR) & (F.col("idx") % 2 == 0))
    return match.unionByName(none.select("request_id", "video_id", F.floor(F.col("idx") / 2).alias("at"), F.round("value", 3).alias("value")))


def respond(frames: DataFrame, transcripts: DataFrame, videos: DataFrame, wanted: Sequence[S.Request], dim: int) -> DataFrame:
    """A whole response for each request and video: request_id, video_id, moments (structs
    with their preview's frame and caption), heatmap, total_duration, top_k. A
    timeline bounds both arrays."""
    rows, keys = _signals(frames, transcripts, videos, wanted, dim)
    found = hydrate(_best(rows, keys), frames)
    one = F.struct("rank", "t_start", "t_end", "score", "frame_id", "preview")
    moments_ = found.groupBy("request_id", "video_id").agg(F.array_sort(F.collect_list(one)).alias("moments"))
    heat = heatmaps(rows, keys).groupBy("request_id", "video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("heatmap"))
    asked = S.requests(frames.sparkSession, wanted)
    numbers = frames.sparkSession.createDataFrame([(r.request_id, int(r.top_k)) for r in wanted], "request_id long, top_k int")
    groups = S.pairs(videos, asked).join(numbers, "request_id").select("request_id", "video_id", F.round("duration_sec", 2).alias("total_duration"), "top_k")
    whole = groups.join(heat, ["request_id", "video_id"], "left").join(moments_, ["request_id", "video_id"], "left")
    nothing = F.array().cast(found.select(F.array(one).alias("m")).schema["m"].dataType)
    empty = F.array().cast("array<double>")
    return whole.select("request_id", "video_id", F.coalesce("moments", nothing).alias("moments"), F.coalesce("heatmap", empty).alias("heatmap"), "total_duration", "top_k")


def hydrate(found: DataFrame, frames: DataFrame) -> DataFrame:
    """Moments with their nearest frame and a presentable caption."""
    numbered = found.withColumn("id", F.xxhash64("request_id", "video_id", "rank"))
    points = numbered.select("video_id", "id", ((F.col("t_start") + F.col("t_end")) / 2).alias("t"))
    near = R.nearest(points, frames).select("id", "frame_id")
    named = frames.select(F.col("id").alias("frame_id"), "caption")
    return numbered.join(near, "id", "left").join(named, "frame_id", "left").select(
        "request_id", "video_id", "rank", "t_start", "t_end", "score", "frame_id", clean_caption(F.col("caption")).alias("preview")
    )


def log_entries(found: DataFrame, asked: DataFrame, latency_ms: float) -> DataFrame:
    """asked (request_id, query, video_id) -> a row of search_logs for each request,
    those without moments too. The id follows from the request, not from chance."""
    n = found.groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = asked.join(n, "request_id", "left")
    return rows.select(
        F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), "query", F.current_timestamp().cast("string")), 256).alias("id"),
        F.col("query").alias("query_text"), F.col("video_id").cast("string").alias("video_id"), F.lit(float(latency_ms)).cast("float").alias("latency_ms"),
        F.coalesce("n", F.lit(0)).alias("retrieved_moments_count"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
    )
