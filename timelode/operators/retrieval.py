"""Previews, answers and captions of moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions import intervals as I
from timelode.functions import text as X
from timelode.sources.storage import stored

FAR = 999.0  # fixed value: no frame this far from a moment is its preview
SPAN, PIECE, PAIRS = 3600.0, 256, 2_000_000


def nearest(points: DataFrame, frames: DataFrame, bucket: float = FAR) -> DataFrame:
    """points (video_id, id, t) -> the nearest frame of the same video within FAR
    seconds (earlier time, then smaller id, among equals), or nulls. An as-of join
    in two directions: frames and points are put in one order by time, and the
    last frame before and the first after a point are running values. No pair of a
    point and a frame is made but these two."""
    frame = frames.select("video_id", F.col("ts").alias("t"), F.lit(None).cast("long").alias("id"), F.struct("ts", F.col("id").alias("frame_id")).alias("f"), F.lit(0).alias("kind"))
    point = points.select("video_id", "t", "id", F.lit(None).cast("struct<ts:double,frame_id:bigint>").alias("f"), F.lit(1).alias("kind"))
    order = Window.partitionBy("video_id").orderBy("t", "kind", F.desc("f.frame_id"))
    both = frame.unionByName(point)
    both = both.withColumn("before", F.last("f", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    after = Window.partitionBy("video_id").orderBy(F.desc("t"), F.desc("kind"), F.desc("f.frame_id")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("after", F.last("f", ignorenulls=True).over(after)).where("kind = 1")
    gap_b, gap_a = F.abs(F.col("before.ts") - F.col("t")), F.abs(F.col("after.ts") - F.col("t"))
    best = F.when(F.col("after").isNull() | (gap_b <= gap_a), F.col("before")).otherwise(F.col("after"))
    rows = both.withColumn("best", best).withColumn("distance", F.abs(F.col("best.ts") - F.col("t")))
    near = F.col("distance") < bucket
    return rows.select("video_id", "id", F.when(near, F.col("best.frame_id")).alias("frame_id"), F.when(near, F.col("distance")).alias("distance"))


def tokens(question: str) -> list[str]:
    return [w for w in question.lower().split() if len(w) > 2]


def said(transcripts: DataFrame, question: str, most: int = 5) -> DataFrame:
    """The first ``most`` transcripts of each video that hold a token of the question;
    of a video without any, its first ones. matched tells which."""
    hit = X.any_keyword(X.plain(F.col("spoken")), X.literals(tokens(question)))
    rows = transcripts.withColumn("hit", hit)
    order = Window.partitionBy("video_id").orderBy(F.col("hit").desc(), "t_start", "id")
    whole = Window.partitionBy("video_id")
    rows = rows.withColumn("matched", F.max("hit").over(whole)).withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where((F.col("rank") <= most) & (F.col("hit") | ~F.col("matched"))).select("video_id", "id", "t_start", "t_end", "spoken", "matched", "rank")


def answers(transcripts: DataFrame, best_frames: DataFrame, question: str) -> DataFrame:
    """best_frames (video_id, rank, ts, caption) -> video_id, context, n_citations,
    cite_start, cite_end, citation: from at most two matching transcripts, else from
    the best frame; without either there is no citation."""
    line = F.format_string("[%.1fs - %.1fs]: %s", "t_start", "t_end", "spoken")
    talk = said(transcripts, question).groupBy("video_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("talk"),
        F.max("matched").alias("matched"),
        F.count_if(F.col("matched") & (F.col("rank") <= 2)).alias("n"),
        F.min_by(F.struct(F.round("t_start", 1).alias("s"), F.round("t_end", 1).alias("e"), F.substring("spoken", 1, 80).alias("text")), "rank").alias("first"),
    )
    seen = best_frames.where("rank = 1").select("video_id", F.struct(F.round(F.greatest(F.lit(0.0), F.col("ts") - 2), 1).alias("s"), F.round(F.col("ts") + 5, 1).alias("e"), F.coalesce("caption", F.lit("")).alias("text")).alias("shot"))
    both = talk.join(seen, "video_id", "full")
    cite = F.when(F.col("matched"), F.col("first")).otherwise(F.col("shot"))
    count = F.when(F.col("matched"), F.col("n")).when(F.col("shot").isNotNull(), 1).otherwise(0)
    rows = both.withColumn("cite", cite)
    return rows.select("video_id", F.coalesce("talk", F.lit("")).alias("context"), count.cast("long").alias("n_citations"), F.col("cite.s").alias("cite_start"), F.col("cite.e").alias("cite_end"), F.col("cite.text").alias("citation"))


def subtitles(clips: DataFrame, transcripts: DataFrame, width: float = SPAN, piece: int = PIECE) -> DataFrame:
    """clips (video_id, clip_id, c_start, c_end) x transcripts that touch them, in the
    clip's own time: video_id, clip_id, number, rel_start, rel_end, text. Both sides
    are dealt to spans of ``width`` seconds and meet only there, once: in the first
    span that they share. A span's transcripts are arrays in order, of at most ``piece`` each, so a
    pair is a row only when it comes out and none is shuffled or sorted: a first pass counts
    a clip's matches in each array, whose running sum is where the numbers of the next one start. An
    array that lies within a clip is counted by its bounds. Clips by span and by array grow with the
    square of a video's length but are thought as small as the videos they come from, so
    nothing is broadcast; the last join is dealt out by the number of pairs."""

    def dealt(rows: DataFrame, start: str, end: str, first: str) -> DataFrame:
        low, high = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width)
        return rows.withColumn(first, low).withColumn("span_", F.explode(F.sequence(low, high)))

    # what goes on from an earlier span is apart, for clips whose first span this is
    array = ["video_id", "span_", "late_", "piece_"]
    said = dealt(transcripts.select("video_id", "id", "t_start", "t_end", "spoken"), "t_start", "t_end", "t_span_").withColumn("late_", F.col("t_span_") == F.col("span_"))
    place = Window.partitionBy(*array[:3]).orderBy("t_start", "id", "t_end", "spoken")
    said = said.withColumn("piece_", F.floor((F.row_number().over(place) - 1) / piece))
    bounds = [f("t_" + x).alias(f"{n}_{x}_") for x in ("start", "end") for f, n in ((F.min, "low"), (F.max, "high"))]
    lists = said.groupBy(*array).agg(*bounds, F.array_sort(F.collect_list(F.struct("t_start", "id", "t_end", "spoken"))).alias("said_"))
    lists = lists.withColumn("times_", F.transform("said_", lambda t: F.struct(t["t_start"].alias("t_start"), t["t_end"].alias("t_end"))))
    lists = stored(lists, "subtitle-spans")
    parts = dealt(clips.select("video_id", "clip_id", "c_start", "c_end"), "c_start", "c_end", "c_span_")
    within = (F.col("low_end_") >= F.col("c_start")) & (F.col("high_start_") <= F.col("c_end"))

    def matches(texts: str) -> Column:
        return F.when(within, F.col(texts)).otherwise(F.filter(texts, lambda t: I.overlaps(F.col("c_start"), F.col("c_end"), t["t_start"], t["t_end"])))

    counted = parts.join(lists.drop("said_").hint("merge"), ["video_id", "span_"])
    counted = counted.where(I.overlaps(F.col("c_start"), F.col("c_end"), F.col("low_start_"), F.col("high_end_")) & (F.col("late_") | (F.col("span_") == F.col("c_span_"))))
    counted = counted.select("clip_id", "c_start", "c_end", *array, F.size(matches("times_")).alias("n_")).where("n_ > 0")
    # what starts before a clip's first span meets it there, so spans and pieces go in the order of the starts
    ahead = Window.partitionBy("video_id", "clip_id").orderBy("span_", "late_", "piece_").rowsBetween(Window.unboundedPreceding, -1)
    counted = stored(counted.withColumn("ahead_", F.coalesce(F.sum("n_").over(ahead), F.lit(0))), "subtitle-counts")
    pairs = counted.agg(F.sum("n_")).first()[0] or 0
    counted = counted.repartition(-(-pairs // PAIRS), *array) if pairs > PAIRS else counted
    met = counted.drop("n_").join(lists.drop("times_").hint("merge"), array)
    met = met.select("video_id", "clip_id", "c_start", "c_end", "ahead_", F.posexplode(matches("said_")).alias("at_", "t_"))
    length = F.greatest(F.lit(0.5), F.col("c_end") - F.col("c_start"))
    return met.select(
        "video_id", "clip_id", (F.col("ahead_") + F.col("at_") + 1).cast("long").alias("number"),
        F.greatest(F.lit(0.0), F.col("t_.t_start") - F.col("c_start")).alias("rel_start"), F.least(length, F.col("t_.t_end") - F.col("c_start")).alias("rel_end"), F.col("t_.spoken").alias("text"),
    )


def sanitised(frames: DataFrame, phrases: Sequence[str] = X.STORED_REFUSALS) -> DataFrame:
    """Frames with refusing captions replaced, and which these are."""
    bad = X.refused(F.col("caption"), phrases)
    return frames.withColumn("refused", bad).withColumn("caption", F.when(bad, F.lit(X.DEFAULT_CAPTION)).otherwise(F.col("caption")))
