"""Arithmetic of ingestion and upkeep of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelode.functions import vectors as V
from timelode.functions.text import keyframe_name, stripped

# Fixed values of the ingestion: numbers, stages in their order, and those that are shown.
MAX_FRAMES, PER_SECOND, MAX_SHOTS, FALLBACK_SECONDS, FALLBACK_CHUNKS, KEYFRAME_TAU = 10, 1.0, 4, 10.0, 10, (1 - 0.65) * 0.15
REPORT_SECONDS = 1.0
STAGES = ("decoding", "scene_detect", "asr_whisper", "keyframe_ssim", "siglip2_embedding", "lancedb_commit", "vlm_caption", "complete")
SHOWN_STAGES = ("decoding", "scene_detect", "asr_whisper", "keyframe_ssim", "siglip2_embedding", "vlm_caption")


def sample_times(scenes: DataFrame, fps: float) -> DataFrame:
    """scenes (video_id, scene_index, t_start, t_end) -> i, ts, frame_idx of each sample."""
    span = F.col("t_end") - F.col("t_start")
    n = F.greatest(F.lit(1), F.least(F.lit(MAX_FRAMES), (span * PER_SECOND).cast("int"))).cast("long")
    rows = scenes.select("video_id", "scene_index", "t_start", span.alias("span"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    rows = rows.withColumn("ts", F.col("t_start") + F.col("i") / F.col("n") * F.col("span"))
    return rows.select("video_id", "scene_index", "i", "ts", (F.col("ts") * fps).cast("long").alias("frame_idx"))


def subsample(ids, most: int = MAX_SHOTS):
    """Of an array, at most ``most`` entries, evenly spread with both ends."""
    n = F.size(ids)
    k = F.least(F.lit(most), n)
    step = (n - 1) / F.greatest(F.lit(1), k - 1)
    picks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), k - 1)), lambda i: F.get(ids, (i * step).cast("int")))
    return F.when(n > 1, picks).otherwise(ids)


def fallback_scenes(videos: DataFrame, failed: bool = False) -> DataFrame:
    """One scene for a video without cuts; fixed chunks where detection failed."""
    if failed:
        rows = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FALLBACK_CHUNKS - 1).cast("long"))).alias("scene_index"))
        return rows.select("video_id", "scene_index", (F.col("scene_index") * FALLBACK_SECONDS).alias("t_start"), ((F.col("scene_index") + 1) * FALLBACK_SECONDS).alias("t_end"))
    return videos.select("video_id", F.lit(0).cast("long").alias("scene_index"), F.lit(0.0).alias("t_start"), F.col("duration_sec").alias("t_end"))


# Fixed values of the scene detection: ratio to the neighbourhood, seconds, frames on each side.
CUT_RATIO, LEAST_SECONDS, AROUND = 3.0, 1.5, 2


def detected_scenes(frames: DataFrame, videos: DataFrame, ratio: float = CUT_RATIO, least: float = LEAST_SECONDS, floor: float = 0.0) -> DataFrame:
    """frames (video_id, id, ts, vector), videos (video_id, duration_sec) -> video_id, scene_index,
    t_start, t_end. A frame is a cut if its difference from the one before is ``floor`` or more and
    ``ratio`` times the mean difference of the AROUND frames on each side or more, all of
    which must be there, and it comes ``least`` seconds or more after the last cut (or
    the start). A video without cuts is one scene.

    The last condition hangs on the cut before, so a video's candidates (few; a timeline
    bounds them) fold in order."""
    order = Window.partitionBy("video_id").orderBy("ts", "id")
    rows = frames.select("video_id", "id", "ts", F.round(V.mean_abs_difference(F.lag("vector").over(order), F.col("vector")), 9).alias("gap"))
    sides = [F.lag("gap", k).over(order) for k in range(1, AROUND + 1)] + [F.lead("gap", k).over(order) for k in range(1, AROUND + 1)]
    around = sides[0]
    for side in sides[1:]:
        around = around + side
    rows = rows.withColumn("around", F.round(around / len(sides), 9))  # null unless all are there
    high = (F.col("gap") >= floor) & F.when(F.col("around") > 0, F.round(F.col("gap") / F.col("around"), 9) >= ratio).otherwise(F.col("gap") > 0)
    lists = rows.where(high & F.col("around").isNotNull()).groupBy("video_id").agg(F.array_sort(F.collect_list("ts")).alias("all"))
    step = lambda kept, t: F.when(t - F.element_at(kept, -1) >= least, F.concat(kept, F.array(t))).otherwise(kept)
    cuts = F.aggregate(F.coalesce("all", F.array().cast("array<double>")), F.array(F.lit(0.0)), step)
    scenes = videos.join(lists, "video_id", "left").select("video_id", "duration_sec", cuts.alias("cuts"))
    scenes = scenes.select("video_id", "duration_sec", "cuts", F.posexplode("cuts").alias("at", "t_start"))
    t_end = F.coalesce(F.get("cuts", F.col("at") + 1), F.col("duration_sec"))
    return scenes.select("video_id", F.col("at").cast("long").alias("scene_index"), "t_start", t_end.alias("t_end"))


def keyframes(frames: DataFrame, tau: float = KEYFRAME_TAU, group: str = "scene_index") -> DataFrame:
    """frames (video_id, group, id, ts, vector) -> those that differ by tau or more
    from the last one kept. The choice hangs on the choice before, so a scene's
    frames (few; a scene is a unit of work) fold in order."""
    one = F.struct("ts", "id", "vector")
    lists = frames.groupBy("video_id", group).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def step(kept, x):
        last = F.element_at(kept, -1)
        far = F.when(F.size(kept) == 0, True).otherwise(V.mean_abs_difference(last["vector"], x["vector"]) >= tau)
        return F.when(far, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return lists.select("video_id", group, F.explode(kept).alias("f")).select("video_id", group, "f.id", "f.ts")


def upsert(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of ``changes`` where its key is the same and they aren't null."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, column: str = "video_id") -> dict[str, DataFrame]:
    """Each table without the rows of the deleted keys."""
    return {name: t.join(keys.select(column).distinct(), column, "left_anti") for name, t in tables.items()}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(out.agg(F.sum("n").alias("n")).select(F.lit("total").alias("table"), "n"))


def append(rows: DataFrame, path: str, by: str = "video_id") -> None:
    rows.write.mode("append").partitionBy(by).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, by: str = "video_id") -> None:
    """Replaces the partitions that rows touch and leaves the others alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def create_tables(spark: SparkSession, schemas: dict[str, str], root: str) -> None:
    """An empty table for each schema that has none yet."""
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their bytes, of the allowed endings."""
    from timelode.functions.text import allowed_file

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(allowed_file(F.col("path")))


def progress_monotone(progress: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return progress.withColumn("best", F.max("progress").over(order))


def latest(progress: DataFrame) -> DataFrame:
    """The newest event of each video."""
    newest = progress.groupBy("video_id").agg(F.max_by(F.struct("event_id", "progress", "stage", "detail"), F.struct("ts", "event_id")).alias("e"))
    return newest.select("video_id", "e.*")


def status(progress: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (video_id) -> the newest state of each, as it is replayed to who connects; a
    video without events is at the start."""
    return told(latest(progress), asked)


def told(newest: DataFrame, asked: DataFrame) -> DataFrame:
    """status from the newest states (video_id, event_id, progress, stage) themselves."""
    rows = asked.join(newest, "video_id", "left")
    return rows.select("video_id", F.coalesce("progress", F.lit(0.0)).alias("progress"), F.coalesce("stage", F.lit(STAGES[0])).alias("stage"), F.when(F.col("event_id").isNull(), F.lit("Initializing...")).otherwise(F.lit("")).alias("message"))


def completed_stages(progress: DataFrame) -> DataFrame:
    """progress (video_id, ts, event_id, progress, stage) -> each event with the stages that
    are done by then: those before its own (an unknown or first stage changes
    nothing), and all from the event on that is complete or at 100."""
    order = Window.partitionBy("video_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array(*[F.lit(s) for s in STAGES])
    place = F.array_position(names, F.when(F.col("stage") == "minicpmv_caption", "vlm_caption").otherwise(F.col("stage"))) - 1
    whole = (F.col("progress") >= 100) | (F.col("stage") == "complete")
    rows = progress.withColumn("ended", F.max(F.coalesce(whole, F.lit(False))).over(order))
    rows = rows.withColumn("n_done", F.coalesce(F.last(F.when(place > 0, place), ignorenulls=True).over(order), F.lit(0)))
    done = F.when(F.col("ended"), F.array(*[F.lit(s) for s in SHOWN_STAGES])).otherwise(F.slice(names, 1, F.col("n_done").cast("int")))
    return rows.select("video_id", "event_id", done.alias("done"), "ended")


def phases(progress: DataFrame) -> DataFrame:
    """video_id, ingestion_phase: by the newest event, searchable once the first
    phase committed, complete once the captions are in; null before that."""
    return latest(progress).select("video_id", phase_of(F.col("stage"), F.col("progress")).alias("ingestion_phase"))


def phase_of(stage: Column, progress: Column) -> Column:
    captioned, searchable = stage == "complete", stage.isin("lancedb_commit", "vlm_caption", "minicpmv_caption") | (progress >= 100)
    return F.when(captioned, "phase2_complete").when(searchable, "phase1_ready")


def speech(segments: DataFrame) -> DataFrame:
    """segments (video_id, id, t_start, t_end, spoken) as recognised -> stripped, without
    blank ones, numbered in their video."""
    text = stripped(F.col("spoken"))
    rows = segments.withColumn("spoken", text).where("spoken <> ''")
    order = Window.partitionBy("video_id").orderBy("t_start", "id")
    return rows.withColumn("segment", F.row_number().over(order).cast("long"))


def throttled(segments: DataFrame, videos: DataFrame, every: float = REPORT_SECONDS) -> DataFrame:
    """segments (video_id, id, t_end, spoken), videos (video_id, duration_sec) -> the reports of a
    transcription: at a segment that ends ``every`` seconds or more after the one
    last reported, or at the end. Which one is reported hangs on the one before, so a
    video's segments (few; a video is a unit of work) pass in order."""
    rows = segments.join(videos, "video_id").select(
        "video_id", "id", F.col("t_end").cast("double").alias("t_end"), F.greatest(F.lit(1.0), "duration_sec").alias("total"), (F.coalesce(stripped(F.col("spoken")), F.lit("")) != "").alias("full")
    )

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["t_end", "id"], kind="stable")
        own["segments"] = own["full"].cumsum().astype("int64")
        last, kept = -1.0, []
        for end, total in zip(own["t_end"], own["total"], strict=True):
            report = end - last >= every or end >= total
            last = end if report else last
            kept.append(report)
        return own[kept][["video_id", "id", "t_end", "total", "segments"]]

    return reported(rows.groupBy("video_id").applyInPandas(run, "video_id long, id long, t_end double, total double, segments long"))


def reported(found: DataFrame) -> DataFrame:
    """found (video_id, id, t_end, total, segments) -> the figures of each report."""
    share = F.col("t_end") / F.col("total")
    return found.select(
        "video_id", "id", "segments", F.least(F.lit(100), (share * 100).cast("int")).cast("long").alias("sub_percent"), F.least(F.lit(58), 25 + (share * 33).cast("int")).cast("long").alias("progress"), F.round("t_end", 1).alias("current_sec"), F.round("total", 1).alias("total_sec")
    )


def decoded(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """samples (video_id, scene_index, i, ts, frame_idx) with what was decoded (video_id,
    frame_idx, ...): pairs by frame, so a frame that can't be read takes its own time
    with it and moves no other."""
    return samples.join(frames, ["video_id", "frame_idx"])


def keyframe_sink(keyframes: DataFrame, folder: str) -> None:
    """keyframes (video_id, ts, image: encoded bytes) as files <folder>/<video_id>/f_<ts>s.jpg on
    a file system that all machines reach. All of them appear, or, where the job fails, none;
    redoing it writes the same files."""
    from timelode.sources.image_files import ImageFiles

    keyframes.sparkSession.dataSource.register(ImageFiles)
    name = F.concat_ws("/", F.col("video_id").cast("string"), keyframe_name(F.col("ts")))
    keyframes.select(name.alias("name"), F.col("image").alias("content")).write.format("image_files").mode("append").save(folder)


def apply_model(rows: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str | T.StructType, failing: str = "raise", by: str | None = None, size: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """A model at the edge: built once for each Python worker's task, fed Arrow batches, of at
    most ``size`` rows if given. profile: what a task of this stage needs (an accelerator, say).
    failing="empty": what the model fails on has no rows (a silent video). A batch that
    fails is tried again in parts, those of each value of ``by`` (a file, say), or without
    ``by`` row by row, so that others in it lose nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = model()
        for whole in batches:
            for at in range(0, len(whole), size or max(1, len(whole))):
                batch = whole.iloc[at : at + (size or len(whole))].reset_index(drop=True)
                try:
                    yield infer(batch)
                    continue
                except Exception:
                    if failing != "empty":
                        raise
                for _, part in batch.groupby(batch[by] if by else batch.index, sort=False, dropna=False):
                    try:
                        yield infer(part.reset_index(drop=True))
                    except Exception:
                        continue

    return rows.mapInPandas(run, schema, profile=profile)


def log_tail(lines: DataFrame, most: int = 40, like: str = "") -> DataFrame:
    """lines (at, value): the last ``most`` that aren't blank and hold ``like``, in any case."""
    wanted = lines.where((stripped(F.col("value")) != "") & F.contains(F.lower("value"), F.lower(F.lit(like))))
    return wanted.orderBy(F.desc("at")).limit(most)
