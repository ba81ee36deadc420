"""Evidence of three kinds for requests: frames, captions, words spoken.

Requests for one video meet its rows in an equi-join. Those for every video are a
stated set that meets all rows, in blocks of at most ``BLOCK_VALUES`` numbers and
words each, so that what goes to a task has a bound however many they are: a block is a
matrix and an automaton of words there (``products``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.functions import text as X
from timelode.functions import vectors as V
from timelode.operators import products
from timelode.sources.storage import stored

BLOCK_VALUES = 1_000_000
# Weights of the modalities, and what an empty score map holds.
WEIGHT_VISUAL, WEIGHT_CAPTION, WEIGHT_AUDIO = 0.45, 0.35, 0.20
EMPTY_AT, EMPTY_SCORE = 0.0, 0.1
TOP_K, SIGMA, FACTOR = 5, 1.5, 0.8  # fixed values: defaults of a request


@dataclass(frozen=True)
class Request:
    request_id: int
    vector: Sequence[float]
    visual: Sequence[str] = ()
    audio: Sequence[str] = ()
    video_id: int | None = None
    weights: tuple[float, float, float] = field(default=(WEIGHT_VISUAL, WEIGHT_CAPTION, WEIGHT_AUDIO))
    top_k: int = TOP_K
    gaussian_sigma: float = SIGMA
    multiscale: bool = True
    threshold_factor: float = FACTOR


SCHEMA = "request_id long, q array<double>, visual array<string>, audio array<string>, only_video long, w_visual double, w_caption double, w_audio double"


@dataclass(frozen=True)
class Asked:
    """Requests of one video each (or None), and blocks of those for every video, as
    tables and as they are."""

    named: DataFrame | None
    blocks: tuple[DataFrame, ...]
    lists: tuple[tuple[Request, ...], ...] = ()

    def table(self) -> DataFrame:
        """All requests, of which there is one at least."""
        return reduce(DataFrame.unionByName, [*self.blocks, *([] if self.named is None else [self.named])])


def requests(spark: SparkSession, wanted: Sequence[Request]) -> Asked:
    def table(some: Sequence[Request]) -> DataFrame:
        rows = [(r.request_id, V.unit(r.vector), sorted(set(r.visual)), sorted(set(r.audio)), r.video_id, *map(float, r.weights)) for r in some]
        return spark.createDataFrame(rows, SCHEMA)

    blocks, block, held = [], [], 0
    for r in (r for r in wanted if r.video_id is None):
        size = len(r.vector) + len(r.visual) + len(r.audio) + 8
        if block and held + size > BLOCK_VALUES:
            blocks.append(tuple(block))
            block, held = [], 0
        block.append(r)
        held += size
    blocks += [tuple(block)] * bool(block)
    named = [r for r in wanted if r.video_id is not None]
    return Asked(table(named) if named else None, tuple(map(table, blocks)), tuple(blocks))


def _for_requests(rows: DataFrame, asked: Asked) -> DataFrame:
    parts = [rows.join(F.broadcast(block)) for block in asked.blocks]
    if asked.named is not None:
        parts.append(rows.join(asked.named, rows["video_id"] == asked.named["only_video"]))
    if not parts:
        return rows.join(rows.sparkSession.createDataFrame([], SCHEMA), F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def _named(rows: DataFrame, asked: Asked) -> list[DataFrame]:
    return [] if asked.named is None else [rows.join(asked.named, rows["video_id"] == asked.named["only_video"])]


def _united(parts: list[DataFrame], spark: SparkSession, like: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], like)


def cosines(frames: DataFrame, asked: Asked, dim: int) -> DataFrame:
    """request_id, video_id, id, ts, score of frames with a vector of ``dim``. Stored
    vectors have length 1."""
    keep = ["video_id", "id", "ts"]
    good = frames.where(V.valid(F.col("vector"), dim)).select(*keep, "vector")
    parts = [products.pairs(good, products.Block(block), keep, dim).select("request_id", *keep, "score") for block in asked.lists]
    parts += [rows.select("request_id", *keep, V.dot(F.col("vector"), F.col("q")).alias("score")) for rows in _named(good, asked)]
    return _united(parts, frames.sparkSession, "request_id long, video_id long, id long, ts double, score double")


def best_frames(frames: DataFrame, asked: Asked, dim: int, k: int = 3, by: str | None = "video_id") -> DataFrame:
    """request_id, id, rank, score (and ``by``): the k best frames of each request in each
    video, or, with by=None, in all of them. No row is made for a pair."""
    good = frames.where(V.valid(F.col("vector"), dim)).select("video_id", "id", "vector")
    own = [by] if by else []
    parts = [products.best(good, products.Block(block), dim, k, by).select("request_id", *own, "id", "rank", "score") for block in asked.lists]
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "id")
    for rows in _named(good, asked):  # one video each
        scored = rows.select("request_id", *own, "id", V.dot(F.col("vector"), F.col("q")).alias("score"))
        parts.append(scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("request_id", *own, "id", "rank", "score"))
    return _united(parts, frames.sparkSession, "request_id long, " + ("video_id long, " if by else "") + "id long, rank long, score double")


def top_frames(scored: DataFrame, k: int = 3) -> DataFrame:
    best = Window.partitionBy("request_id", "video_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _caption_value(own: Column) -> Column:
    """What a caption adds, null without a keyword."""
    hits = X.keyword_matches(own, F.col("visual"))
    return F.when(hits > 0, hits / F.size("visual") * F.col("w_caption"))


def caption_part(frames: DataFrame, asked: Asked) -> DataFrame:
    own = frames.select("video_id", "ts", F.concat(X.plain(F.col("caption")), F.lit(" ")).alias("own"))
    parts = [products.pairs(own, products.Block(block, "visual"), ["video_id", "ts"], words_weight=1) for block in asked.lists]
    parts = [p.select("request_id", "video_id", "ts", "part") for p in parts]
    parts += [rows.select("request_id", "video_id", "ts", _caption_value(F.col("own")).alias("part")).where("part is not null") for rows in _named(own, asked)]
    return _united(parts, frames.sparkSession, "request_id long, video_id long, ts double, part double")


def audio_part(transcripts: DataFrame, asked: Asked) -> DataFrame:
    own = transcripts.select("video_id", ((F.col("t_start") + F.col("t_end")) / 2).alias("ts"), X.plain(F.col("spoken")).alias("own"))
    parts = [products.pairs(own, products.Block(block, "audio"), ["video_id", "ts"], words_weight=2).select("request_id", "video_id", "ts", "part") for block in asked.lists]
    for rows in _named(own, asked):
        hits = rows.withColumn("hits", X.keyword_matches(F.col("own"), F.col("audio"))).where("hits > 0")
        parts.append(hits.select("request_id", "video_id", "ts", (F.col("hits") / F.size("audio") * F.col("w_audio")).alias("part")))
    return _united(parts, transcripts.sparkSession, "request_id long, video_id long, ts double, part double")


def frame_parts(frames: DataFrame, asked: Asked, dim: int) -> DataFrame:
    """request_id, video_id, ts, id, seen, part: what a frame's vector and its caption add,
    from one pass over the frames; frames without either are left out."""
    keep = ["video_id", "ts", "id"]
    own = frames.select(*keep, F.when(V.valid(F.col("vector"), dim), F.col("vector")).alias("vector"), F.concat(X.plain(F.col("caption")), F.lit(" ")).alias("own"))
    value = lambda score, weight: F.greatest(F.lit(0.0), score) * weight
    parts = []
    for block in asked.lists:
        weight = frames.sparkSession.createDataFrame([(r.request_id, float(r.weights[0])) for r in block], "request_id long, w_visual double")
        met = products.pairs(own, products.Block(block, "visual"), keep, dim, 1).join(F.broadcast(weight), "request_id")
        parts.append(met.select("request_id", *keep, F.when(F.col("score").isNotNull(), value(F.col("score"), F.col("w_visual"))).alias("seen"), "part"))
    for rows in _named(own, asked):
        seen = F.when(F.col("vector").isNotNull(), value(V.dot(F.col("vector"), F.col("q")), F.col("w_visual")))
        parts.append(rows.select("request_id", *keep, seen.alias("seen"), _caption_value(F.col("own")).alias("part")).where("seen is not null or part is not null"))
    return _united(parts, frames.sparkSession, "request_id long, video_id long, ts double, id long, seen double, part double")


def pairs(videos: DataFrame, asked: Asked) -> DataFrame:
    """Each request with each video that it is for, and the video's columns."""
    return _for_requests(videos, asked).select("request_id", *videos.columns)


def fused(frames: DataFrame, transcripts: DataFrame, videos: DataFrame, asked: Asked, dim: int) -> DataFrame:
    """request_id, video_id, ts, score: the sum of all evidence for one instant (of the
    vectors of frames at one time, the last frame's); a video without any has one
    faint instant."""
    said = audio_part(transcripts, asked).select("request_id", "video_id", "ts", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("seen"), "part")
    parts = frame_parts(frames, asked, dim).unionByName(said)
    last = F.max_by("seen", F.when(F.col("seen").isNotNull(), F.col("id")))
    scored = parts.groupBy("request_id", "video_id", "ts").agg((F.coalesce(last, F.lit(0.0)) + F.coalesce(F.sum("part"), F.lit(0.0))).alias("score"))
    return pairs(videos.select("video_id"), asked).join(scored, ["request_id", "video_id"], "left").select(
        "request_id", "video_id", F.coalesce("ts", F.lit(EMPTY_AT)).alias("ts"), F.coalesce("score", F.lit(EMPTY_SCORE)).alias("score")
    )


def written(number: Column) -> Column:
    """A double as text with a point and no exponent from 0.0001 up to 1e16, as in 10000000.0."""
    text = F.abs(number).cast("string")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"\.", "")
    digits = F.regexp_replace(digits, "(?<=.)0$", "")  # 1.0E7 has one digit
    large = F.concat(F.rpad(digits, power + 1, "0"), F.lit("."))
    rest = F.when(F.length(digits) > power + 1, digits.substr(power + 2, F.length(digits))).otherwise(F.lit("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(power.isNull(), text).when((power > 0) & (power < 16), F.concat(large, rest)).when((power < 0) & (power >= -4), small).otherwise(text)
    return F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), plain)


def item_key(id_: Column, timestamp: Column, rank: Column) -> Column:
    """What names an item of a ranked list: its id, without one (or an empty one) its
    time, without one (or at 0) its place."""
    return F.when(id_.isNotNull() & (id_.cast("string") != ""), id_.cast("string")).when(timestamp.isNotNull() & (timestamp != 0), written(timestamp.cast("double"))).otherwise(rank.cast("string"))


def ranked(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows (modality, item, s, ...) with their rank from 1 in their list, best s first,
    then the smaller item. All lists are dealt by ranges of (modality, s, item); a rank is the place
    within the range plus the sizes of those before, so no task holds a whole list."""
    dealt = rows.repartitionByRange(*([parts] if parts else []), "modality", F.desc("s"), "item").withColumn("range_", F.spark_partition_id())
    dealt = stored(dealt, "ranked")
    sizes = dealt.groupBy("modality", "range_").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("modality").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("modality", "range_", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead_"))
    order = Window.partitionBy("modality", "range_").orderBy(F.col("s").desc(), "item")
    done = dealt.withColumn("rank", F.row_number().over(order)).join(sizes, ["modality", "range_"])
    return done.withColumn("rank", (F.col("rank") + F.col("ahead_")).cast("long")).drop("range_", "ahead_")


def reciprocal_ranks(ranked: DataFrame, weights: dict[str, float], k: int = 60, default: float | None = None, lists: Sequence[str] | None = None, payload: str | None = None) -> DataFrame:
    """ranked (modality, item, rank) -> item, fused_score, modality_scores: weights
    over k + rank. An unnamed modality weighs ``default`` (1 over the number of lists).
    lists: their names in order, empty ones too (default: those that have rows, by
    name). payload: a column of which the first entry is kept, by list and rank."""
    if lists is None:
        lists = sorted(r["modality"] for r in ranked.select("modality").distinct().collect())
    default = 1.0 / max(1, len(lists)) if default is None else default
    pairs = [x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("modality")), F.lit(default)) if pairs else F.lit(default)
    place = F.array_position(F.array(*[F.lit(m) for m in lists]).cast("array<string>"), F.col("modality"))
    kept = F.col(payload) if payload else F.lit(None).cast("string")
    parts = ranked.select("item", "modality", "rank", (weight / (k + F.col("rank"))).alias("part"), place.alias("place"), kept.alias("payload"))
    # an item that a list repeats adds each time; its map holds the last place
    one = parts.groupBy("item", "modality", "place").agg(F.sum("part").alias("part"), F.max_by("part", "rank").alias("last"), F.min("rank").alias("rank"), F.min_by("payload", "rank").alias("payload"))
    out = one.groupBy("item").agg(
        F.sum("part").alias("fused_score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "last")))).alias("modality_scores"), F.min_by("payload", F.struct("place", "rank")).alias("payload")
    )
    return out if payload else out.drop("payload")
