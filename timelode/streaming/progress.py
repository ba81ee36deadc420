"""Streaming twins: progress of ingestion and its replay, captions that meet their
frames, throttled reports, windows of events."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timelode.functions.text import stripped
from timelode.operators.ingest import REPORT_SECONDS, overwrite_partitions, phase_of, reported, told, upsert

#: State lives on disk; a store reserves no log of megabytes for a few bytes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextlib.contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """A query that starts in here keeps its state as STATE says."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """The newest state of each video and the highest progress so far (for update mode)."""
    state = stream.groupBy("video_id").agg(
        F.max_by(F.struct("event_id", "progress", "stage"), F.struct("ts", "event_id")).alias("e"), F.max("progress").alias("best")
    )
    return state.select("video_id", "e.event_id", "e.progress", "e.stage", "best")


def phases(stream: DataFrame) -> DataFrame:
    """The phase of ingestion of each video by its newest event (for update mode)."""
    return latest(stream).select("video_id", phase_of(F.col("stage"), F.col("progress")).alias("ingestion_phase"))


def push(stream: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of changed states to ``deliver``, then ends with the data."""
    with _on_disk(stream.sparkSession):
        return latest(stream).writeStream.outputMode("update").foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, checkpoint: str, asked: DataFrame) -> DataFrame:
    """asked (video_id) -> what each late watcher is told on connecting: the newest state that
    ``push`` keeps below ``checkpoint``, as of its last batch. Events aren't read again."""
    kept = spark.read.format("statestore").load(checkpoint)
    newest = [f.name for f in kept.schema["value"].dataType.fields if f.dataType.typeName() == "struct" and "progress" in f.dataType.names][0]
    return told(kept.select("key.video_id", f"value.{newest}.*"), asked)


def captioned(frames: DataFrame, captions: DataFrame) -> DataFrame:
    """Streams of frames (video_id, id, ...) and of captions (id, caption, and what
    orders them, ``at``) -> video_id, id, caption of frames that are there and have one
    (for update mode). Each waits for the other in the state, without limit, so none is lost
    in whatever order they come; of captions of one frame the newest counts."""
    seen = frames.select("video_id", "id", F.lit(True).alias("there"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast(captions.schema["at"].dataType).alias("at"))
    said = captions.select(F.lit(None).cast(frames.schema["video_id"].dataType).alias("video_id"), "id", F.lit(None).cast("boolean").alias("there"), "caption", "at")
    both = seen.unionByName(said).groupBy("id").agg(F.max("video_id").alias("video_id"), F.max("there").alias("there"), F.max_by("caption", F.when(F.col("caption").isNotNull(), F.struct("at", "caption"))).alias("caption"))
    return both.where("there AND caption IS NOT NULL").select("video_id", "id", "caption")


def enrich(frames: DataFrame, captions: DataFrame, frames_path: str, checkpoint: str) -> StreamingQuery:
    """The second phase: frames arrive and are kept in the table at ``frames_path`` by whoever
    writes them; captions overlay its rows as soon as both are known. Only touched
    partitions are rewritten, and redoing a batch changes nothing."""

    def overlay(batch: DataFrame, number: int) -> None:
        spark, met = batch.sparkSession, f"{checkpoint}-met"
        batch.write.mode("overwrite").parquet(met)  # worked out once: reading it updates the state
        new = spark.read.parquet(met)
        rows = spark.read.parquet(frames_path).join(new.select("video_id").distinct(), "video_id", "left_semi")
        done = upsert(rows, new, "id", ["caption"])
        staged = f"{checkpoint}-staged"
        done.write.mode("overwrite").parquet(staged)
        overwrite_partitions(spark.read.parquet(staged), frames_path)

    with _on_disk(frames.sparkSession):
        return captioned(frames, captions).writeStream.outputMode("update").foreachBatch(overlay).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled(segments: DataFrame, videos: DataFrame, every: float = REPORT_SECONDS) -> DataFrame:
    """The reports of running transcriptions (for append mode): a stream of segments
    (video_id, id, t_end, spoken) against the table videos (video_id, duration_sec). The state of a
    video is the end of the segment last reported and the segments so far, so the
    reports are the same however its segments are cut into micro-batches; within a batch
    they are put in order."""
    rows = segments.join(videos, "video_id").select(
        "video_id", "id", F.col("t_end").cast("double").alias("t_end"), F.greatest(F.lit(1.0), "duration_sec").alias("total"), (F.coalesce(stripped(F.col("spoken")), F.lit("")) != "").alias("full")
    )

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (-1.0, 0)
        own = pd.concat(list(parts)).sort_values(["t_end", "id"], kind="stable")
        own["segments"] = n + own["full"].cumsum().astype("int64")
        kept = []
        for end, total in zip(own["t_end"], own["total"], strict=True):
            report = end - last >= every or end >= total
            last = end if report else last
            kept.append(report)
        state.update((float(last), int(n + own["full"].sum())))
        yield own[kept][["video_id", "id", "t_end", "total", "segments"]]

    found = rows.groupBy("video_id").applyInPandasWithState(run, "video_id long, id long, t_end double, total double, segments long", "last double, n long", "append", GroupStateTimeout.NoTimeout)
    return reported(found)


def report(stream: DataFrame, videos: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the reports of ``throttled`` to the table ``out``, then ends with the data."""
    with _on_disk(stream.sparkSession):
        return throttled(stream, videos).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(stream: DataFrame) -> DataFrame:
    """Watermarks need instants; times without a zone are read in the session's."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: bursts of events of one video, closed after a gap."""
    return _timed(stream).withWatermark("ts", late).groupBy("video_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("progress").alias("best"))


def heat(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extension: the highest value of each video and window, while late data may come."""
    return _timed(stream).withWatermark("ts", late).groupBy("video_id", F.window("ts", width)).agg(F.max("progress").alias("best"))
