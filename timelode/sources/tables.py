"""Schemas of the five tables, and the views of the driver's tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "videos": "id string, filename string, filepath string, duration_sec float, fps float, resolution string, total_frames bigint, ingestion_phase string, created_at string",
    "scenes": "id string, video_id string, scene_index int, t_start float, t_end float, keyframe_count int",
    "video_frames": "id string, video_id string, scene_id string, timestamp float, frame_path string, siglip2_vector array<float>, vlm_caption string, has_dense_caption boolean",
    "transcripts": "id string, video_id string, t_start float, t_end float, speaker_tag string, spoken_text string",
    "search_logs": "id string, query_text string, video_id string, latency_ms float, retrieved_moments_count int, created_at string",
}
TIMELINE_SECONDS = 720.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, id, ts (seconds), vector, caption (null until captioned)."""
    place = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("id"), (F.row_number().over(place) - 1).cast("double").alias("ts"), F.col("embedding").alias("vector")
    )
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("caption"))
    return e.join(d, "id", "left").select("video_id", "id", "ts", "vector", "caption")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.floor(F.col("conv_id") / 10) * 8 + F.col("turn")).cast("double")
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 10).alias("video_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), start.alias("t_start"), (start + 0.8).alias("t_end"), F.col("role").alias("speaker"), F.col("text").alias("spoken")
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, duration_sec: a second past the last frame or word. Frame times
    follow from counts, so no frame is numbered or joined for this."""
    last = read(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("video_id")).agg((F.count(F.lit(1)) - 1).cast("double").alias("t"))
    said = transcripts(spark, sf_dir).groupBy("video_id").agg(F.max("t_end").alias("t"))
    return last.unionByName(said).groupBy("video_id").agg((F.ceil(F.max("t")) + 1).cast("double").alias("duration_sec"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten seconds each: video_id, scene_index, t_start, t_end, keyframe_count, frame_ids."""
    index = F.floor(F.col("ts") / 10).cast("long")
    grouped = frames(spark, sf_dir).groupBy("video_id", index.alias("scene_index")).agg(
        F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.count(F.lit(1)).alias("keyframe_count"), F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("frames")
    )
    return grouped.withColumn("frame_ids", F.col("frames.id")).drop("frames")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, score, duration_sec: hours since 2024 read as seconds."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 3.6e9
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), t.alias("t"), (F.col("value") / 500).alias("score"), F.lit(TIMELINE_SECONDS).alias("duration_sec"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "ts", "event_id", F.col("value").alias("progress"), F.col("event_type").alias("stage"), F.get_json_object("props", "$.k").cast("long").alias("detail"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.row_number().over(place).cast("long").alias("rank"), F.col("l_quantity").alias("p_start"), (F.col("l_quantity") + 5 + 100 * F.col("l_discount")).alias("p_end")
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_custkey") % 50).cast("double")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), start.alias("g_start"), (start + 10).alias("g_end"))
