"""Every timeline query by name. Its SQL twin is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions import intervals
from timelode.functions import text as X
from timelode.functions import vectors as V
from timelode.operators import evaluate, expand, index, ingest, ivfpq, moments, retrieval, scoring, signal, text_index, timelines
from timelode.plans import oracle, search
from timelode.sources import storage
from timelode.sources import tables as T
from timelode.sources.image_files import ImageFiles
from timelode.streaming import progress

KEYWORDS = ("the", "of", "and", "in")
QUESTION = "What is the thing and that"
DIM = 64
PHRASES = (*X.STORED_REFUSALS, "idiot", "worthless")
FILES = ("a.mp4", "B.MKV", "c.mov", "d.webm", "e.avi", "f.txt", "g.mp4.exe", "noending", ".mp4", "dir.mp4/plain", "h.Mp4")
QUERIES = ("คนใส่เสื้อสีเขียว", "a man in a red shirt", "รถยนต์ turning", "\t spaced  words \n", "", "\t\n ")
TAU = 0.14
SCENE_RATIO = 1.2
LONG = 256
FPS = 25.0
#: Stand-ins for the stages of ingestion in the events, and what makes their values percents.
STAGE_OF = {"signup": "decoding", "view": "scene_detect", "click": "asr_whisper", "purchase": "minicpmv_caption", "error": "lancedb_commit"}
PERCENT = 4.5
ABSENT = (10_000_001, 10_000_002)


def _asked(spark: SparkSession, sf_dir: str) -> list[scoring.Request]:
    """The request's vector is the first stored one: no encoder runs here."""
    first = T.read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [scoring.Request(0, first["embedding"], KEYWORDS, KEYWORDS)]


def _request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.requests(spark, _asked(spark, sf_dir))


def scan_videos(spark, sf_dir):
    return T.videos(spark, sf_dir)


def list_videos(spark, sf_dir):
    """All nine columns, each as its own type."""
    v = F.col("video_id").cast("string")
    name = F.concat(F.lit("video_"), v, F.lit(".mp4"))
    total = F.floor(F.col("duration_sec") * FPS)
    return T.videos(spark, sf_dir).select(
        v.alias("id"), name.alias("filename"), F.concat(F.lit("/videos/"), name).alias("filepath"), F.col("duration_sec").cast("double").alias("duration_sec"), F.lit(FPS).alias("fps"),
        F.lit("1280x720").alias("resolution"), total.cast("long").alias("total_frames"), F.lit("phase1_ready").alias("ingestion_phase"), F.lit("2024-01-01T00:00:00").alias("created_at"),
    )


def filter_frames_limit(spark, sf_dir):
    return T.frames(spark, sf_dir).where(F.col("video_id") == F.lit(3)).select("video_id", "id", "ts").orderBy("ts", "id").limit(10)


def valid_vectors(spark, sf_dir):
    good = V.valid(F.col("embedding"), DIM)
    return T.read(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("video_id")).agg(F.count_if(good).alias("n_valid"), F.count(F.lit(1)).alias("n_total"))


def table_counts(spark, sf_dir):
    return ingest.counts({n: T.read(spark, sf_dir, n) for n in ("embeddings", "conversations", "events", "documents")})


def upsert_captions(spark, sf_dir):
    frames = T.frames(spark, sf_dir).select("video_id", "id", "caption")
    changes = T.read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.concat(F.lit("caption of "), F.col("doc_id").cast("string")).alias("caption"))
    done = ingest.upsert(frames, changes, "id", ["caption"])
    return done.select("video_id", "id", F.length("caption").cast("long").alias("n_chars"), F.md5("caption").alias("caption_md5"))


def cascade_delete(spark, sf_dir):
    gone = T.videos(spark, sf_dir).where("video_id % 3 = 0").select("video_id")
    left = ingest.delete_cascade({"frames": T.frames(spark, sf_dir).select("video_id", "id"), "transcripts": T.transcripts(spark, sf_dir).select("video_id", "id")}, gone)
    frames, said = (left[n].select(F.lit(n).alias("table"), "video_id", "id") for n in ("frames", "transcripts"))
    return frames.unionByName(said)


def filter_allowed_ext(spark, sf_dir):
    """Every page's address with an ending that goes by its number."""
    ending = F.element_at(X.literals(FILES), (F.col("page_id") % len(FILES) + 1).cast("int"))
    rows = T.read(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/"), ending).alias("filename"))
    return rows.select("page_id", "filename", X.allowed_file(F.col("filename")).alias("allowed"))


def video_frames_join(spark, sf_dir):
    n = T.frames(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return T.videos(spark, sf_dir).join(n, "video_id").select("video_id", "n_frames", "duration_sec")


def cosine_scores(spark, sf_dir):
    return scoring.cosines(T.frames(spark, sf_dir), _request(spark, sf_dir), DIM).select("video_id", "id", F.round("score", 4).alias("score"))


def topk_frames(spark, sf_dir):
    best = scoring.best_frames(T.frames(spark, sf_dir), _request(spark, sf_dir), DIM)
    return best.select("video_id", "id", "rank", F.round("score", 4).alias("score"))


def keyword_match_count(spark, sf_dir):
    docs = T.frames(spark, sf_dir).select("id", X.keyword_matches(X.plain(F.col("caption")), X.literals(KEYWORDS)).alias("matches"))
    said = T.transcripts(spark, sf_dir).select("id", X.keyword_matches(X.plain(F.col("spoken")), X.literals(KEYWORDS)).alias("matches"))
    return docs.withColumn("kind", F.lit("frame")).unionByName(said.withColumn("kind", F.lit("transcript")))


def _part(rows: DataFrame) -> DataFrame:
    return rows.select("video_id", F.round("ts", 3).alias("ts"), F.round("part", 6).alias("boost"))


def caption_boost(spark, sf_dir):
    return _part(scoring.caption_part(T.frames(spark, sf_dir), _request(spark, sf_dir)))


def audio_boost(spark, sf_dir):
    return _part(scoring.audio_part(T.transcripts(spark, sf_dir), _request(spark, sf_dir)))


def fused_scores(spark, sf_dir):
    done = scoring.fused(T.frames(spark, sf_dir), T.transcripts(spark, sf_dir), T.videos(spark, sf_dir), _request(spark, sf_dir), DIM)
    return done.select("video_id", F.round("ts", 3).alias("ts"), F.round("score", 6).alias("score"))


def _typed(spark, sf_dir) -> DataFrame:
    """A query for each turn of every conversation: one of QUERIES, in turn, and, but for
    every other one of them, what was said."""
    key = F.col("conv_id") * 100 + F.col("turn")
    start = F.element_at(X.literals(QUERIES), (key % len(QUERIES) + 1).cast("int"))
    whole = F.when(F.floor(key / len(QUERIES)) % 2 == 0, start).otherwise(F.concat(start, F.lit(" "), F.coalesce("text", F.lit(""))))
    return T.read(spark, sf_dir, "conversations").select(key.alias("request_id"), whole.alias("query"))


def expand_concepts(spark, sf_dir):
    return expand.matched(_typed(spark, sf_dir), expand.concepts(spark)).select("request_id", "key", F.get("visual", F.lit(0)).alias("translation"))


def expand_query(spark, sf_dir):
    done = expand.expand(expand.accepted(_typed(spark, sf_dir)), expand.concepts(spark))
    return done.select("request_id", F.md5(F.array_join("visual", "|")).alias("visual_md5"), F.md5(F.array_join("audio", "|")).alias("audio_md5"), F.md5("expanded").alias("expanded_md5"))


def rrf_fuse(spark, sf_dir):
    """Three whole lists: frames by similarity, frames by keywords, words spoken by
    keywords, which have no id and go by their time."""
    frames = T.frames(spark, sf_dir)
    seen = scoring.cosines(frames, _request(spark, sf_dir), DIM).select(F.col("id").cast("string").alias("item"), F.round("score", 6).alias("s"), "ts")
    hits = frames.select(F.col("id").cast("string").alias("item"), X.keyword_matches(X.plain(F.col("caption")), X.literals(KEYWORDS)).cast("double").alias("s"), "ts").where("s > 0")
    t = (F.col("t_start") + F.col("t_end")) / 2
    said = T.transcripts(spark, sf_dir).select(F.concat(F.lit("said "), F.col("id").cast("string")).alias("item"), X.keyword_matches(X.plain(F.col("spoken")), X.literals(KEYWORDS)).cast("double").alias("s"), t.alias("ts")).where("s > 0")
    lists = [d.select(F.lit(m).alias("modality"), "item", "s", "ts") for m, d in (("visual", seen), ("caption", hits), ("audio", said))]
    ranked = scoring.ranked(lists[0].unionByName(lists[1]).unionByName(lists[2]))
    nameless = F.when(F.col("modality") != "audio", F.col("item"))
    ranked = ranked.withColumn("item", scoring.item_key(nameless, F.col("ts"), F.col("rank")))
    done = scoring.reciprocal_ranks(ranked, {"visual": 0.5, "caption": 0.3}, lists=("visual", "caption", "audio"), payload="ts")
    part = lambda m: F.round(F.coalesce(F.element_at("modality_scores", F.lit(m)), F.lit(0.0)), 8)
    return done.select(F.col("item").alias("id"), F.round("fused_score", 8).alias("fused_score"), part("visual").alias("visual_part"), part("audio").alias("audio_part"), F.round("payload", 3).alias("ts"))


def index_topk(spark, sf_dir):
    """The coarse index with every cell probed: the exact ten best frames."""
    frames = T.frames(spark, sf_dir)
    cells = index.fit_cells(frames, DIM)
    found = index.probe(index.assign(frames, cells, DIM), _request(spark, sf_dir), cells, len(cells.centres), 10)
    return found.select("request_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def log_tail(spark, sf_dir):
    """Turns of conversations as log lines, every fourth one blank."""
    at = F.col("conv_id") * 100 + F.col("turn")
    lines = T.read(spark, sf_dir, "conversations").select(at.alias("at"), F.when(at % 4 == 0, F.lit(" \t ")).otherwise(F.col("text")).alias("value"))
    return ingest.log_tail(lines, 40, "THE").select(F.col("at").alias("line"), F.md5("value").alias("value_md5"))


def srt_blocks(spark, sf_dir):
    rows = ingest.speech(T.transcripts(spark, sf_dir))
    block = X.srt_block(F.col("segment"), F.col("t_start") * 61.25, F.col("t_end") * 61.25, F.concat(F.lit("\t"), F.col("spoken"), F.lit(" ")))
    return rows.select("id", F.md5(block).alias("block_md5"))


def frame_lookup(spark, sf_dir):
    """Orders as videos: their length in seconds, and the frame at a time, within the video."""
    total, fps, t = F.col("o_custkey"), (F.col("o_orderkey") % 3) * 12.5, (F.col("o_orderkey") % 41) * 0.75
    orders = T.read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.round(intervals.duration(total, fps), 6).alias("duration_sec"), intervals.frame_at(t, fps, total).cast("long").alias("frame_idx"))


KEYS = ["video_id"]


def signal_bins(spark, sf_dir):
    return signal.bins(T.timeline(spark, sf_dir), KEYS).select("video_id", "idx", F.round("score", 6).alias("score"))


def _smooth(spark, sf_dir, kernel):
    return signal.smooth(signal.bins(T.timeline(spark, sf_dir), KEYS), KEYS, kernel)


def gaussian_multiscale(spark, sf_dir):
    return _smooth(spark, sf_dir, signal.multiscale()).select("video_id", "idx", F.round("smoothed", 6).alias("smoothed"))


def gaussian_single(spark, sf_dir):
    return _smooth(spark, sf_dir, signal.gaussian(signal.DEFAULT_SIGMA)).select("video_id", "idx", F.round("smoothed", 6).alias("smoothed"))


def _signal(spark, sf_dir):
    return search.signal(T.timeline(spark, sf_dir), KEYS)


def dynamic_threshold(spark, sf_dir):
    return moments.thresholds(_signal(spark, sf_dir), KEYS).select("video_id", *[F.round(c, 6).alias(c) for c in ("mu", "sigma", "theta")])


def _peaks(spark, sf_dir):
    return moments.peaks(moments.clusters(moments.with_threshold(_signal(spark, sf_dir), KEYS), KEYS), KEYS)


def moment_clusters(spark, sf_dir):
    return _peaks(spark, sf_dir).select("video_id", "cluster", "first", "last")


def moment_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir).select("video_id", "cluster", "peak", F.round("score", 6).alias("score"))


TIMED = ["video_id", "duration_sec"]


def _bounded(spark, sf_dir):
    rows = moments.with_threshold(search.signal(T.timeline(spark, sf_dir), TIMED), TIMED)
    return moments.bounded(moments.valleys(rows, TIMED), TIMED)


def valley_bounds(spark, sf_dir):
    return _bounded(spark, sf_dir).drop("duration_sec")


def gaussian_chunks(spark, sf_dir):
    """gaussian_multiscale with every timeline cut into chunks."""
    done = timelines.smooth(signal.bins(T.timeline(spark, sf_dir), KEYS), KEYS, signal.multiscale(), LONG)
    return done.select("video_id", "idx", F.round("smoothed", 6).alias("smoothed"))


def valley_chunks(spark, sf_dir):
    """valley_bounds with every timeline cut into chunks."""
    found = timelines.moments(signal.bins(T.timeline(spark, sf_dir), TIMED), TIMED, signal.multiscale(), LONG)
    return moments.bounded(found, TIMED).drop("duration_sec")


def greedy_nms(spark, sf_dir):
    return search.moments(T.timeline(spark, sf_dir), KEYS)


def heatmap_1hz(spark, sf_dir):
    return signal.heatmap(search.signal(T.timeline(spark, sf_dir), TIMED), KEYS)


def heatmap_bands(spark, sf_dir):
    return heatmap_1hz(spark, sf_dir).groupBy("video_id", X.heat_band(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))


def search_moments(spark, sf_dir):
    done = search.search(T.frames(spark, sf_dir), T.transcripts(spark, sf_dir), T.videos(spark, sf_dir), _asked(spark, sf_dir), DIM)
    return done.select("video_id", "rank", "t_start", "t_end", "score")


def _various(spark: SparkSession, sf_dir: str) -> list[scoring.Request]:
    """Requests with numbers of their own, one without any evidence, one of a single video."""
    plain = _asked(spark, sf_dir)[0]
    return [
        replace(plain, request_id=0, top_k=2),
        replace(plain, request_id=1, top_k=3, threshold_factor=0.4, multiscale=False, gaussian_sigma=3.0),
        scoring.Request(2, [0.0] * DIM, ("qqzzqq",), ("qqzzqq",)),
        replace(plain, request_id=3, video_id=4, weights=(0.1, 0.2, 0.7)),
    ]


def search_requests(spark, sf_dir):
    done = search.search(T.frames(spark, sf_dir), T.transcripts(spark, sf_dir), T.videos(spark, sf_dir), _various(spark, sf_dir), DIM)
    return done.select("request_id", "video_id", "rank", "t_start", "t_end", "score")


def search_response(spark, sf_dir):
    """Whole responses, in figures: previews by their frames and the captions' digest."""
    done = search.respond(T.frames(spark, sf_dir), T.transcripts(spark, sf_dir), T.videos(spark, sf_dir), _various(spark, sf_dir), DIM)
    joined = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")
    return done.select(
        "request_id", "video_id", F.size("moments").cast("long").alias("n_moments"), joined("moments.frame_id").alias("frame_ids"), F.md5(F.array_join("moments.preview", "|")).alias("previews_md5"),
        F.size("heatmap").cast("long").alias("n_heat"), F.aggregate("heatmap", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 1000).cast("long")).alias("heat_sum"), F.array_max("heatmap").alias("heat_peak"), "total_duration", F.col("top_k").cast("long").alias("top_k"),
    )


def nearest_frame(spark, sf_dir):
    points = T.transcripts(spark, sf_dir).select("video_id", "id", ((F.col("t_start") + F.col("t_end")) / 2).alias("t"))
    return retrieval.nearest(points, T.frames(spark, sf_dir)).select("id", "frame_id", F.round("distance", 3).alias("distance"))


def sanitize_captions(spark, sf_dir):
    done = retrieval.sanitised(T.frames(spark, sf_dir), PHRASES)
    return done.select("id", F.md5("caption").alias("caption_md5"), "refused")


def rag_transcripts(spark, sf_dir):
    return retrieval.said(T.transcripts(spark, sf_dir), QUESTION).select("video_id", "id", "matched", "rank")


def rag_answer(spark, sf_dir):
    frames = T.frames(spark, sf_dir)
    best = scoring.best_frames(frames, _request(spark, sf_dir), DIM, 1).select("id", "rank")
    best = best.join(frames.select("video_id", "id", "ts", "caption"), "id")
    return retrieval.answers(T.transcripts(spark, sf_dir), best, QUESTION).withColumn("context", F.md5("context"))


def _clips(spark, sf_dir) -> DataFrame:
    """A clip about every seventh second of each video, some beyond its end."""
    n = F.floor(F.col("duration_sec") / 7).cast("long")
    rows = T.videos(spark, sf_dir).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("clip_id"))
    return rows.select("video_id", "clip_id", (4.0 + 7 * F.col("clip_id") + F.col("video_id") / 10).alias("c_start"), (9.25 + 9 * F.col("clip_id")).alias("c_end"))


def subtitle_overlap(spark, sf_dir):
    """Only the texts' digests come out, so these go in: one a text, not one a pair."""
    met = retrieval.subtitles(_clips(spark, sf_dir), T.transcripts(spark, sf_dir).withColumn("spoken", F.md5("spoken")))
    return met.select("video_id", "clip_id", "number", F.round("rel_start", 3).alias("rel_start"), F.round("rel_end", 3).alias("rel_end"), F.col("text").alias("text_md5"))


def srt_format(spark, sf_dir):
    rows = T.transcripts(spark, sf_dir).withColumn("s", F.col("t_start") * 61.25)
    return rows.select("id", X.srt_time(F.col("s")).alias("srt"), X.clip_name(F.col("video_id"), F.col("t_start"), F.col("t_start") + 2).alias("clip"))


def temporal_iou(spark, sf_dir):
    return evaluate.overlaps(T.predictions(spark, sf_dir).where("rank = 1"), T.ground_truth(spark, sf_dir)).select("query_id", F.round("iou", 6).alias("iou"), F.round("delta", 6).alias("delta"))


def eval_recall(spark, sf_dir):
    return evaluate.recall(T.predictions(spark, sf_dir), T.ground_truth(spark, sf_dir))


def eval_miou(spark, sf_dir):
    return evaluate.mean_overlap(T.predictions(spark, sf_dir), T.ground_truth(spark, sf_dir))


def sample_timestamps(spark, sf_dir):
    done = ingest.sample_times(T.scenes(spark, sf_dir), 29.97)
    return done.select("video_id", "scene_index", "i", F.round("ts", 6).alias("ts"), "frame_idx")


def scene_groups(spark, sf_dir):
    rows = T.scenes(spark, sf_dir)
    return rows.select("video_id", "scene_index", "t_start", "t_end", "keyframe_count", F.array_join(F.transform("frame_ids", lambda x: x.cast("string")), ",").alias("frame_ids"))


def scene_fallback(spark, sf_dir):
    v = T.videos(spark, sf_dir)
    return ingest.fallback_scenes(v).withColumn("failed", F.lit(False)).unionByName(ingest.fallback_scenes(v, True).withColumn("failed", F.lit(True)))


def subsample_frames(spark, sf_dir):
    rows = T.scenes(spark, sf_dir).withColumn("picked", ingest.subsample(F.col("frame_ids")))
    return rows.select("video_id", "scene_index", F.array_join(F.transform("picked", lambda x: x.cast("string")), ",").alias("picked"))


def keyframe_filter(spark, sf_dir):
    frames = T.frames(spark, sf_dir).withColumn("scene_index", F.floor(F.col("ts") / 10).cast("long"))
    return ingest.keyframes(frames, TAU).select("video_id", "id")


def progress_latest(spark, sf_dir):
    return ingest.latest(T.progress(spark, sf_dir))


def progress_monotone(spark, sf_dir):
    return ingest.progress_monotone(T.progress(spark, sf_dir)).select("video_id", "event_id", "best")


def _staged(spark, sf_dir):
    stage = F.create_map(*[F.lit(x) for pair in STAGE_OF.items() for x in pair])
    return T.progress(spark, sf_dir).withColumn("stage", F.element_at(stage, F.col("stage"))).withColumn("progress", F.col("progress") / PERCENT)


def progress_status(spark, sf_dir):
    """What each video's watcher is told on connecting, of unknown videos too."""
    known = T.progress(spark, sf_dir).select("video_id").distinct()
    asked = known.unionByName(spark.createDataFrame([(v,) for v in ABSENT], "video_id long"))
    done = ingest.status(_staged(spark, sf_dir), asked)
    return done.select("video_id", F.round("progress", 6).alias("progress"), "stage", "message")


def stage_completion(spark, sf_dir):
    return ingest.completed_stages(_staged(spark, sf_dir)).select("video_id", "event_id", F.array_join("done", ",").alias("done"), "ended")


def ingest_phase(spark, sf_dir):
    return ingest.phases(_staged(spark, sf_dir))


def progress_throttled(spark, sf_dir):
    """Transcripts closer together than a report, so that some are held back."""
    said = T.transcripts(spark, sf_dir).withColumn("t_end", F.col("t_end") / 3)
    return ingest.throttled(said, T.videos(spark, sf_dir).withColumn("duration_sec", F.col("duration_sec") / 3))


def speech_segments(spark, sf_dir):
    """Every third segment blank, the others with white space around them."""
    blank = F.when(F.col("id") % 3 == 0, F.lit(" \t\n")).otherwise(F.concat(F.lit("\t "), F.col("spoken"), F.lit("\n")))
    done = ingest.speech(T.transcripts(spark, sf_dir).withColumn("spoken", blank))
    return done.select("video_id", "id", "segment", F.md5("spoken").alias("spoken_md5"))


def scene_captions(spark, sf_dir):
    """A captioner that says what the scene's first frame says, in part refusals."""
    first = T.frames(spark, sf_dir).select(F.col("id").alias("first"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("I'm Sorry, "), F.col("caption"))).otherwise(F.col("caption")).alias("said"))
    rows = T.scenes(spark, sf_dir).withColumn("first", F.get("frame_ids", F.lit(0))).join(first, "first", "left")
    return rows.select("video_id", "scene_index", F.md5(X.scene_caption(F.col("said"), F.col("keyframe_count"))).alias("caption_md5"))


def decoded_frames(spark, sf_dir):
    """Every seventh frame can't be read; its time goes with it."""
    samples = ingest.sample_times(T.scenes(spark, sf_dir), 29.97)
    read = samples.where("frame_idx % 7 <> 0").select("video_id", "frame_idx", (F.col("frame_idx") * 2).alias("content")).distinct()
    return ingest.decoded(samples, read).select("video_id", "scene_index", "i", F.round("ts", 6).alias("ts"), "frame_idx", "content", X.keyframe_name(F.round("ts", 6)).alias("file"))


def bm25_topk(spark, sf_dir):
    return index.bm25(T.read(spark, sf_dir, "documents"), KEYWORDS, 20)


def ivfpq_topk(spark, sf_dir):
    """The quantised index over all frames; every hundredth frame asks. Approximate: tests hold
    its recall against all products."""
    frames, path = T.frames(spark, sf_dir).select("id", "vector"), storage.shared_path(spark, "ivfpq")
    ivfpq.build(frames, ivfpq.fit(frames, DIM), DIM, path)
    asked = frames.where("id % 100 = 0").select(F.col("id").alias("request_id"), F.col("vector").alias("q"))
    return ivfpq.search(path, asked, DIM, 10).select("request_id", "id", "rank", F.round("score", 4).alias("score"))


def best_frames_topk(spark, sf_dir):
    """Several requests against the frames of all videos, or of their own."""
    best = scoring.best_frames(T.frames(spark, sf_dir), scoring.requests(spark, _various(spark, sf_dir)), DIM, 10, by=None)
    return best.select("request_id", "id", "rank", F.round("score", 4).alias("score"))


def text_index_topk(spark, sf_dir):
    """Both text columns from a stored index, which is filled in two steps, the second with
    the captions again, and merged."""
    path = storage.shared_path(spark, "text-index")
    docs = T.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("caption"))
    said = T.transcripts(spark, sf_dir).select(F.col("id").alias("doc_id"), "spoken")
    text_index.add(docs.withColumn("caption", F.lit("to be replaced")), ["caption"], f"{path}/captions")
    text_index.add(docs, ["caption"], f"{path}/captions")
    text_index.add(said, ["spoken"], f"{path}/spoken")
    text_index.merge(spark, f"{path}/captions")
    found = [text_index.search(spark, f"{path}/{p}", f, KEYWORDS, 20).select(F.lit(f).alias("field"), "doc_id", "score") for p, f in (("captions", "caption"), ("spoken", "spoken"))]
    return found[0].unionByName(found[1])


def scene_cuts(spark, sf_dir):
    """Stored vectors are less alike than neighbouring frames of a film: a lower ratio."""
    return ingest.detected_scenes(T.frames(spark, sf_dir), T.videos(spark, sf_dir), ratio=SCENE_RATIO)


def _landed(rows: DataFrame, label: str) -> str:
    """rows as files for a stream to pick up; their folder."""
    path = storage.shared_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return path


def progress_replay(spark, sf_dir):
    """progress_status from the state that a stream keeps."""
    staged = _staged(spark, sf_dir)
    state = storage.shared_path(spark, "progress-state")
    stream = progress.events(spark, _landed(staged.repartition(6), "progress"), staged.schema, 2)
    progress.push(stream, lambda batch, n: batch.write.format("noop").mode("overwrite").save(), state).awaitTermination()
    asked = T.progress(spark, sf_dir).select("video_id").distinct().unionByName(spark.createDataFrame([(v,) for v in ABSENT], "video_id long"))
    done = progress.replay(spark, state, asked)
    return done.select("video_id", F.round("progress", 6).alias("progress"), "stage", "message")


def streamed_captions(spark, sf_dir):
    """upsert_captions by two streams; captions come before their frames, after them, or
    for frames that never come."""
    frames = T.frames(spark, sf_dir).select("video_id", "id", "caption")
    said = F.concat(F.lit("caption of "), F.col("doc_id").cast("string"))
    captions = T.read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), said.alias("caption"), F.col("doc_id").alias("at"))
    path = storage.shared_path(spark, "captioned")
    ingest.append(frames, path)
    one = progress.events(spark, _landed(frames.repartitionByRange(4, "id"), "frames"), frames.schema, 1)
    two = progress.events(spark, _landed(captions.repartitionByRange(4, F.desc("id")), "captions"), captions.schema, 1)
    progress.enrich(one, two, path, storage.shared_path(spark, "enrich")).awaitTermination()
    return spark.read.schema(frames.schema).parquet(path).select("video_id", "id", F.length("caption").cast("long").alias("n_chars"), F.md5("caption").alias("caption_md5"))


def throttled_stream(spark, sf_dir):
    """progress_throttled by a stream that gets its segments in time, in three pieces."""
    said = T.transcripts(spark, sf_dir).select("video_id", "id", (F.col("t_end") / 3).alias("t_end"), "spoken")
    videos = T.videos(spark, sf_dir).withColumn("duration_sec", F.col("duration_sec") / 3)
    end, landed = said.agg(F.max("t_end")).first()[0] or 0.0, storage.shared_path(spark, "segments")
    third = F.least(F.lit(2), F.floor(F.col("t_end") * 3 / max(end, 1e-9)).cast("int"))
    for piece in range(3):  # a stream takes files in the order of their times
        said.where(third == piece).repartition("video_id").write.mode("append").parquet(landed)
    out = storage.shared_path(spark, "reports")
    progress.report(progress.events(spark, landed, said.schema, 3), videos, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out)


def file_round_trip(spark, sf_dir):
    """Pages as files, written all or none, and read again by the data source."""
    spark.dataSource.register(ImageFiles)
    folder = storage.shared_path(spark, "pages")
    ending = F.element_at(X.literals(FILES), (F.col("page_id") % len(FILES) + 1).cast("int"))
    name = F.concat((F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit("-"), F.regexp_replace(ending, "/", "-"))
    pages = T.read(spark, sf_dir, "pages").select(name.alias("name"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    pages.write.format("image_files").mode("append").save(folder)
    found = spark.read.format("image_files").load(folder).where(X.allowed_file(F.col("name")))
    return found.select("name", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("content_md5"))


NAMES = """scan_videos list_videos filter_frames_limit valid_vectors table_counts upsert_captions cascade_delete
filter_allowed_ext video_frames_join cosine_scores topk_frames keyword_match_count caption_boost audio_boost
fused_scores expand_concepts expand_query rrf_fuse signal_bins gaussian_multiscale gaussian_single
dynamic_threshold moment_clusters moment_peaks valley_bounds greedy_nms heatmap_1hz heatmap_bands
search_moments nearest_frame sanitize_captions rag_transcripts rag_answer subtitle_overlap srt_format
temporal_iou eval_recall eval_miou sample_timestamps scene_groups scene_fallback subsample_frames
keyframe_filter progress_latest progress_monotone bm25_topk search_requests search_response
progress_status stage_completion ingest_phase progress_throttled speech_segments scene_captions decoded_frames
index_topk log_tail srt_blocks frame_lookup ivfpq_topk best_frames_topk text_index_topk scene_cuts
progress_replay streamed_captions throttled_stream gaussian_chunks valley_chunks
file_round_trip""".split()
#: An approximate result has no twin; tests measure it.
WITHOUT_TWIN = ("ivfpq_topk",)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
