"""The published behaviour on small inputs, edge cases and properties."""

import random

import pytest
from pyspark.sql import functions as F

from timelode.functions import intervals, text, vectors
from timelode.operators import automaton, evaluate, expand, index, ingest, moments, retrieval, scoring, signal, timelines
from timelode.plans import search
from timelode.sources import image_files, tables
from timelode.sources.storage import stored
from timelode.streaming import progress

KEYS = ["video_id"]


def scored(spark, rows, duration):
    return spark.createDataFrame([(v, float(t), float(s), float(duration)) for v, t, s in rows], "video_id long, t double, score double, duration_sec double")


def as_signal(spark, groups):
    rows = [(v, len(s), i, float(x)) for v, s in groups.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "video_id long, n long, idx long, value double")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rrf_orders_by_agreement(spark):
    rows = [("visual", "frame_1", 1), ("visual", "frame_2", 2), ("caption", "frame_1", 1), ("audio", "aud_1", 1)]
    got = {r.item: r for r in scoring.reciprocal_ranks(spark.createDataFrame(rows, "modality string, item string, rank int"), {"visual": 0.5, "caption": 0.3, "audio": 0.2}).collect()}
    assert got["frame_1"].fused_score == pytest.approx(0.8 / 61) and got["frame_2"].fused_score == pytest.approx(0.5 / 62) and got["aud_1"].fused_score == pytest.approx(0.2 / 61)
    assert got["frame_1"].modality_scores == pytest.approx({"visual": 0.5 / 61, "caption": 0.3 / 61})


def test_rrf_repeat_in_one_list(spark):
    rows = [("a", "x", 1), ("a", "x", 3)]
    r = scoring.reciprocal_ranks(spark.createDataFrame(rows, "modality string, item string, rank int"), {}).first()
    assert r.fused_score == pytest.approx(1 / 61 + 1 / 63) and r.modality_scores == pytest.approx({"a": 1 / 63})


def test_smoother(spark):
    rows = search.signal(scored(spark, [(0, 10, 0.9), (0, 10.5, 0.95), (0, 11, 0.85)], 30), KEYS).orderBy("idx").collect()
    assert len(rows) == 60 and max(r.value for r in rows) == 1.0
    peak = max(rows, key=lambda r: r.value).idx
    assert 9 <= peak * 30 / 59 <= 12


def test_kernels():
    for kernel, radius in ((signal.multiscale(), 28), (signal.gaussian(0.5), 4), (signal.gaussian(1.5), 12)):
        assert sum(kernel.values()) == pytest.approx(1) and max(kernel) == radius == -min(kernel)
        assert all(kernel[k] == pytest.approx(kernel[-k]) for k in kernel)


def test_edges_repeat_and_single_bins(spark):
    rng = random.Random(1)
    points = [(0, t / 2, rng.random()) for t in range(10)] + [(1, 0.0, 0.4)]
    frame = scored(spark, points, 5).withColumn("duration_sec", F.when(F.col("video_id") == 1, 0.2).otherwise(F.col("duration_sec")))
    kernel = signal.multiscale()
    got = {(r.video_id, r.idx): r.smoothed for r in signal.smooth(signal.bins(frame, KEYS), KEYS, kernel).collect()}
    raw = [s for v, _, s in points if v == 0]
    for i in range(10):
        assert got[(0, i)] == pytest.approx(sum(w * raw[min(9, max(0, i - k))] for k, w in kernel.items()))
    assert got[(1, 0)] == pytest.approx(0.4) and len(got) == 11


def test_bins_round_half_to_even(spark):
    got = {r.idx: r.score for r in signal.bins(scored(spark, [(0, 0.25, 0.3), (0, 0.75, 0.4), (0, 99, 0.9), (0, -4, -1.0)], 10), KEYS).collect()}
    assert got == {0: 0.3, 2: 0.4, 19: 0.9}


def test_flat_signals(spark):
    got = {r.video_id: r.value for r in search.signal(scored(spark, [(0, 1, 0.0), (1, 0, 0.3)], 0.5), KEYS).collect()}
    assert got == {0: 0.0, 1: pytest.approx(0.3)}


def test_step_gives_its_interval(spark):
    s = [1.0 if 40 <= i < 60 else 0.0 for i in range(120)]
    rows = moments.with_threshold(as_signal(spark, {0: s}), KEYS)
    best = moments.bounded(moments.valleys(rows, KEYS).withColumn("duration_sec", F.lit(60.0)), KEYS).orderBy(F.desc("score")).first()
    assert best.t_start <= 21 and best.t_end >= 29


def walked(s, peak, theta):
    """The walk itself, one side at a time."""

    def side(step):
        at = peak
        while 0 <= at + step < len(s):
            here, ahead = s[at], s[at + step]
            if here <= theta and ahead > here:
                return at
            at += step
            if ahead < 0.7 * theta:
                return at
        return at

    return side(-1), side(1)


def test_valleys_equal_the_walk(spark):
    rng = random.Random(5)
    groups = {v: [round(rng.random() ** rng.choice((1, 3)), rng.choice((1, 4))) for _ in range(rng.randint(1, 60))] for v in range(150)}
    rows = moments.with_threshold(as_signal(spark, groups), KEYS)
    theta = {r.video_id: r.theta for r in rows.select("video_id", "theta").distinct().collect()}
    found = moments.valleys(rows, KEYS).collect()
    clusters = moments.peaks(moments.clusters(rows, KEYS), KEYS).collect()
    assert {(r.video_id, r.cluster, r.peak) for r in found} == {(r.video_id, r.cluster, r.peak) for r in clusters}
    for r in found:
        assert (r.left, r.right) == walked(groups[r.video_id], r.peak, theta[r.video_id])


def test_gap_of_three_joins_four_parts(spark):
    s = [0.0] * 40
    for i in (3, 6, 10, 20):
        s[i] = 1.0
    rows = moments.peaks(moments.clusters(moments.with_threshold(as_signal(spark, {0: s}), KEYS), KEYS), KEYS).orderBy("cluster").collect()
    assert [(r["first"], r["last"]) for r in rows] == [(3, 6), (10, 10), (20, 20)]


def test_durations_are_bounded(spark):
    rows = spark.createDataFrame([(0, 101, 0, 0.9, 100, 100), (0, 101, 1, 0.9, 50, 50), (0, 101, 2, 0.9, 0, 100)], "video_id long, n long, cluster long, score double, left long, right long")
    got = [(r.t_start, r.t_end) for r in moments.bounded(rows.withColumn("duration_sec", F.lit(100.0)), KEYS).orderBy("cluster").collect()]
    assert got == [(100.0, 100.0), (50.0, 51.5), (0.0, 60.0)]


def greedy(all_):
    kept = []
    for m in sorted(all_, key=lambda m: -m[2]):
        if not any(min(m[1], u[1]) > max(m[0], u[0]) and (min(m[1], u[1]) - max(m[0], u[0])) / max(1e-5, m[1] - m[0]) > 0.6 for u in kept):
            kept.append(m)
    return kept


def test_suppression(spark):
    rng = random.Random(9)
    groups = {v: [(a := float(rng.randint(0, 40)), a + rng.randint(0, 15), rng.choice((0.3, 0.5, 0.9))) for _ in range(rng.randint(1, 12))] for v in range(60)}
    groups[100] = [(0.0, 10.0, 0.9), (4.0, 14.0, 0.5), (3.0, 13.0, 0.4)]  # exactly 0.6 stays, above goes
    rows = spark.createDataFrame([(v, c, *m) for v, own in groups.items() for c, m in enumerate(own)], "video_id long, cluster long, t_start double, t_end double, score double")
    once = moments.suppress(rows, KEYS)
    got = {v: [] for v in groups}
    for r in once.orderBy("video_id", "rank").collect():
        got[r.video_id].append((r.t_start, r.t_end, r.score))
    assert got == {v: greedy(own) for v, own in groups.items()}
    again = moments.suppress(once.withColumn("cluster", F.col("rank")), KEYS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_iou_and_metrics(spark):
    pair = lambda a, b, c, d: value(spark, intervals.iou(*[F.lit(float(x)) for x in (a, b, c, d)]))
    assert pair(10, 20, 10, 20) == 1 and pair(10, 20, 15, 25) == pytest.approx(5 / 15) and pair(0, 5, 10, 15) == 0
    truth = spark.createDataFrame([(0, 10.0, 20.0), (1, 5.0, 9.0)], "query_id long, g_start double, g_end double")
    exact = truth.select("query_id", F.lit(1).alias("rank"), F.col("g_start").alias("p_start"), F.col("g_end").alias("p_end"))
    assert {(r.k, r.theta): r.recall for r in evaluate.recall(exact, truth).collect()} == {(k, t): 100.0 for k in (1, 5) for t in (0.3, 0.5, 0.7)}
    assert tuple(evaluate.mean_overlap(exact, truth).first()) == (1.0, 0.0)
    assert tuple(evaluate.mean_overlap(exact.where("query_id = 0"), truth).first()) == (0.5, 50.0)
    assert evaluate.recall(exact, truth.limit(0)).count() == 0 and evaluate.mean_overlap(exact, truth.limit(0)).count() == 0


def test_mock_benchmark(spark):
    ious = [(12.5, 14), (6.5, 8), (11, 13), (31, 35)]
    truth = spark.createDataFrame([(i, 0.0, float(n)) for i, (_, n) in enumerate(ious)], "query_id long, g_start double, g_end double")
    found = spark.createDataFrame([(i, 1, 0.0, float(m)) for i, (m, _) in enumerate(ious)], "query_id long, rank long, p_start double, p_end double")
    assert evaluate.mean_overlap(found, truth).first().miou == 0.8593


def test_expansion(spark):
    rows = spark.createDataFrame([(0, " คนใส่เสื้อสีเขียว "), (1, "Man in RED"), (2, "  ")], "request_id long, query string")
    got = {r.request_id: r for r in expand.expand(expand.accepted(rows), expand.concepts(spark)).collect()}
    assert set(got) == {0, 1}
    assert got[0].concepts == ["สีเขียว", "เขียว", "เสื้อ", "ใส่", "คน"] and got[0].expanded == "คนใส่เสื้อสีเขียว green shirt wearing person"
    assert "person" in got[0].visual and "เสื้อ" in got[0].audio
    assert got[1].visual == ["in", "man", "red"] and got[1].expanded == "Man in RED"


def test_text_rules(spark):
    names = {"a.MP4": True, "a.mp4.exe": False, ".mp4": False, "x": False, "d/e.Mkv": True}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.ok for r in rows.select("name", text.allowed_file(F.col("name")).alias("ok")).collect()} == names
    clean = lambda c: value(spark, text.clean_caption(F.lit(c).cast("string")))
    assert clean("SORRY, no") == clean(None) == clean("") == clean("x 你好") == text.DEFAULT_CAPTION and clean("a red car") == "a red car"
    assert value(spark, text.srt_time(F.lit(3661.5))) == "01:01:01,500"
    assert value(spark, text.srt_block(F.lit(1), F.lit(0.0), F.lit(1.25), F.lit(" hi "))) == "1\n00:00:00,000 --> 00:00:01,250\nhi\n\n"
    assert value(spark, text.clip_name(F.lit("abcdefghij"), F.lit(1.0), F.lit(2.55), True)).startswith("moment_abcdefgh_1.0_2.")
    assert value(spark, text.keyword_matches(F.lit("the other"), F.array(F.lit("the"), F.lit("he"), F.lit("x")))) == 2


def test_vectors(spark):
    assert vectors.unit([3, 4]) == [0.6, 0.8] and vectors.unit([0, 0]) == [0, 0]
    assert value(spark, vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "v array<double>")
    assert rows.where(vectors.valid(F.col("v"), 2)).count() == 1


def test_nearest_frame(spark):
    frames = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (0, 3, 3.0), (1, 9, 5000.0)], "video_id long, id long, ts double")
    points = spark.createDataFrame([(0, 10, 2.0), (0, 11, 2.1), (0, 12, 3.0), (0, 13, 50.0), (1, 14, 0.0), (2, 15, 0.0)], "video_id long, id long, t double")
    got = {r.id: r.frame_id for r in retrieval.nearest(points, frames).collect()}
    assert got == {10: 1, 11: 2, 12: 2, 13: 2, 14: None, 15: None}


def test_answers_without_evidence(spark):
    said = spark.createDataFrame([(0, 1, 0.0, 1.0, "nothing here")], "video_id long, id long, t_start double, t_end double, spoken string")
    none = spark.createDataFrame([], "video_id long, id long, rank long, ts double, caption string")
    r = retrieval.answers(said, none, "red car").first()
    assert r.n_citations == 0 and r.citation is None and "nothing here" in r.context


def test_search_without_evidence(spark):
    frames = spark.createDataFrame([(0, 1, 0.0, None, None)], "video_id long, id long, ts double, vector array<float>, caption string")
    said = spark.createDataFrame([], "video_id long, id long, t_start double, t_end double, spoken string")
    videos = spark.createDataFrame([(0, 0.2), (1, 30.0)], "video_id long, duration_sec double")
    request = scoring.Request(0, [1.0, 0.0], ("red",), ("red",))
    fused = scoring.fused(frames, said, videos, scoring.requests(spark, [request]), 2).collect()
    assert {(r.video_id, r.ts, r.score) for r in fused} == {(0, 0.0, 0.1), (1, 0.0, 0.1)}
    # a flat signal under the floor has no match; a longer one peaks where its faint instant is
    assert {r.video_id for r in search.search(frames, said, videos, [request], 2).collect()} == {1}
    # however many requests there are, they go in blocks of a bounded size
    many = [scoring.Request(i, [1.0, 0.0], ("red",), ("red",), 1 if i % 2 else None) for i in range(1500)]
    asked = scoring.requests(spark, many)
    assert len(asked.blocks) == 1 and asked.named.count() == 750
    assert scoring.fused(frames, said, videos, asked, 2).count() == 750 * 2 + 750


def test_blocks_of_requests_agree(spark, sf_dir, monkeypatch):
    wanted = [scoring.Request(i, [float(i == k) for k in range(64)], ("the",), ("of",), None if i < 5 else i % 10) for i in range(9)]
    run = lambda: sorted(tuple(r) for r in scoring.fused(tables.frames(spark, sf_dir), tables.transcripts(spark, sf_dir), tables.videos(spark, sf_dir), scoring.requests(spark, wanted), 64).selectExpr("request_id", "video_id", "ts", "round(score, 9) AS s").collect())
    whole = run()
    monkeypatch.setattr(scoring, "BLOCK_VALUES", 150)
    assert len(scoring.requests(spark, wanted).blocks) == 3 and run() == whole


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_in_ranges_are_the_ranks(spark, parts):
    rng = random.Random(parts)
    rows = [(m, f"i{k:04d}", float(rng.randint(0, 4) if m == "b" else rng.random())) for m, n in (("a", 400), ("b", 300), ("c", 1)) for k in range(n)]
    got = {(r.modality, r.item): r["rank"] for r in scoring.ranked(spark.createDataFrame(rows, "modality string, item string, s double"), parts).collect()}
    for m in "abc":
        order = sorted((-s, i) for n, i, s in rows if n == m)
        assert [got[m, i] for _, i in order] == list(range(1, len(order) + 1))


def test_fusion_names_weights_and_payload(spark):
    """An unnamed list weighs one over the lists; items without id go by time, then place."""
    rows = [("visual", "x", 5.0, 1), ("visual", None, 7.5, 2), ("audio", None, 7.5, 1), ("audio", "", 0.0, 2), ("text", "x", 9.0, 1)]
    ranked = spark.createDataFrame(rows, "modality string, id string, ts double, rank long").withColumn("item", scoring.item_key(F.col("id"), F.col("ts"), F.col("rank")))
    got = {r.item: r for r in scoring.reciprocal_ranks(ranked, {"visual": 0.5}, lists=["visual", "audio", "text"], payload="ts").collect()}
    assert set(got) == {"x", "7.5", "2"}
    assert got["x"].fused_score == pytest.approx(0.5 / 61 + 1 / 3 / 61) and got["x"].payload == 5.0
    assert got["7.5"].fused_score == pytest.approx(0.5 / 62 + 1 / 3 / 61) and got["2"].fused_score == pytest.approx(1 / 3 / 62)


def test_hydrated_search(spark, sf_dir):
    frames = tables.frames(spark, sf_dir)
    found = search.search(frames, tables.transcripts(spark, sf_dir), tables.videos(spark, sf_dir), [scoring.Request(7, [1.0] * 64, ("the",), ("the",))], 64, 2)
    rows = search.hydrate(found, frames).collect()
    assert rows and all(r.rank <= 2 and r.preview and r.frame_id is not None for r in rows)


def test_ingest_arithmetic(spark):
    scenes = spark.createDataFrame([(0, 0, 0.0, 0.5), (0, 1, 1.0, 4.0), (0, 2, 0.0, 100.0)], "video_id long, scene_index long, t_start double, t_end double")
    got = {}
    for r in ingest.sample_times(scenes, 30.0).orderBy("scene_index", "i").collect():
        got.setdefault(r.scene_index, []).append((r.ts, r.frame_idx))
    assert got[0] == [(0.0, 0)] and [f for _, f in got[1]] == [30, 60, 90] and len(got[2]) == 10 and got[2][9] == (90.0, 2700)
    pick = lambda n: value(spark, ingest.subsample(F.sequence(F.lit(0), F.lit(n - 1))))
    assert [pick(n) for n in (1, 2, 4, 10)] == [[0], [0, 1], [0, 1, 2, 3], [0, 3, 6, 9]]
    frames = spark.createDataFrame([(0, 0, i, float(i), [float(x)] * 4) for i, x in enumerate((0, 0.4, 0.9, 1.2, 2.0))], "video_id long, scene_index long, id long, ts double, vector array<double>")
    assert sorted(r.id for r in ingest.keyframes(frames, 0.9).collect()) == [0, 2, 4]
    assert value(spark, intervals.duration(F.lit(100), F.lit(0.0))) == 0 and value(spark, intervals.frame_at(F.lit(9.0), F.lit(30.0), F.lit(100))) == 99


def test_table_upkeep(spark, tmp_path):
    root = f"file://{tmp_path}"
    ingest.create_tables(spark, tables.SCHEMAS, root)
    assert spark.read.parquet(f"{root}/videos").count() == 0
    rows = spark.createDataFrame([(0, 1, None), (0, 2, "x"), (1, 3, None)], "video_id long, id long, caption string")
    ingest.append(rows, f"{root}/t")
    changed = ingest.upsert(spark.read.parquet(f"{root}/t").where("video_id = 0"), spark.createDataFrame([(1, "new"), (2, None)], "id long, caption string"), "id", ["caption"])
    ingest.overwrite_partitions(spark.createDataFrame(changed.collect(), changed.schema), f"{root}/t")
    assert {r.id: r.caption for r in spark.read.parquet(f"{root}/t").collect()} == {1: "new", 2: "x", 3: None}
    left = ingest.delete_cascade({"t": rows}, spark.createDataFrame([(0,), (0,)], "video_id long"))
    assert [r.id for r in left["t"].collect()] == [3]


def test_file_source(spark, tmp_path):
    for name in ("a.mp4", "b.txt", "c.MKV"):
        (tmp_path / name).write_bytes(b"abc")
    assert sorted(r.path.rsplit("/", 1)[1] for r in ingest.files(spark, str(tmp_path)).select("path").collect()) == ["a.mp4", "c.MKV"]


def test_model_boundary(spark):
    def build():
        return lambda batch: batch.assign(caption=["Scene showing keyframe visuals"] * len(batch))

    rows = ingest.apply_model(spark.range(5), build, "id long, caption string").collect()
    assert len(rows) == 5 and all(r.caption.startswith("Scene") for r in rows)


def test_captioner_and_speech_at_the_edge(spark):
    rows = [(1, " A red car. ", 3), (2, None, 2), (3, "Sorry, as an AI I can't", 1), (4, "", 4), (5, "never shown", 0)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string, n long").select("i", text.scene_caption(F.col("t"), F.col("n")).alias("c")).collect()}
    plain = lambda n: f"Scene showing keyframe visuals with {n} frames, subjects and ongoing activity."
    assert got == {1: "A red car.", 2: plain(2), 3: plain(1), 4: plain(4), 5: ""}

    def failing():
        def infer(batch):
            raise RuntimeError("silent video")

        return infer

    assert ingest.apply_model(spark.range(3), failing, "id long", failing="empty").count() == 0
    with pytest.raises(Exception, match="silent video"):
        ingest.apply_model(spark.range(3), failing, "id long").count()


def test_keyframe_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, b"a"), (1, 2.5, b"bc"), (2, 10.126, b"d")], "video_id long, ts double, image binary")
    for _ in range(2):  # written twice, the files are the same
        ingest.keyframe_sink(rows, f"file://{tmp_path}/frames")
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.jpg")}
    assert found == {"frames/1/f_0.00s.jpg": b"a", "frames/1/f_2.50s.jpg": b"bc", "frames/2/f_10.13s.jpg": b"d"}


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    """A task that fails takes all files of the job with it; names above the folder are refused; files of
    several partitions come back as they were."""
    spark.dataSource.register(image_files.ImageFiles)
    folder = f"file://{tmp_path}/frames"
    rows = spark.createDataFrame([(f"{i % 3}/f_{i}.jpg", bytes([i])) for i in range(20)], "name string, content binary").repartition(4)
    save = lambda df: df.write.format("image_files").mode("append").save(folder)
    left = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    for bad in (F.when(F.col("name") != "1/f_7.jpg", F.col("content")), F.col("content")):
        with pytest.raises(Exception):  # noqa: B017
            save(rows.withColumn("content", bad) if bad is not None and "CASE" in str(bad) else rows.withColumn("name", F.concat(F.lit("../"), "name")))
        assert left() == []
    save(rows)
    assert len(left()) == 20 and not any("_staged" in p for p in left())
    assert sorted(map(tuple, spark.read.format("image_files").load(folder).collect())) == sorted((r.name, r.content) for r in rows.collect())
    assert spark.read.format("image_files").load(f"{folder}/none").count() == 0


def test_numbers_as_text(spark):
    values = [0.5, 12.25, 1e7, 12345678.5, -1.5e7, 123456789012.125, 1e15, 0.0005, 0.00012, 98765432.1, 3.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scoring.written(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: repr(v) for v in values}


def test_requests_are_stripped_of_any_white_space(spark):
    typed = spark.createDataFrame([(1, "\t car \n"), (2, "\n\t "), (3, "\u00a0\u3000"), (4, "")], "request_id long, query string")
    assert [r.request_id for r in expand.accepted(typed).collect()] == [1]
    assert expand.expand(expand.accepted(typed), expand.concepts(spark)).first().query == "car"


def test_subtitles_meet_once_across_spans(spark):
    clips = spark.createDataFrame([(1, 0, 55.0, 200.0), (1, 1, 60.0, 60.0)], "video_id long, clip_id long, c_start double, c_end double")
    said = [(1, i, 20.0 * i, 20.0 * i + (150 if i == 2 else 5), f"t{i}") for i in range(12)]
    got = retrieval.subtitles(clips, spark.createDataFrame(said, "video_id long, id long, t_start double, t_end double, spoken string")).collect()
    expected = sorted((c, i) for c, (a, b) in enumerate([(55.0, 200.0), (60.0, 60.0)]) for _, i, s, e, _ in said if e >= a and s <= b)
    assert sorted((r.clip_id, int(r.text[1:])) for r in got) == expected


def test_bm25_matches_full_index(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    few = index.postings(docs, ["the", "of"]).where("tf > 0")
    whole = index.postings(docs).where("term in ('the', 'of')")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.select(*few.columns).collect()))


def test_streams_end_like_batches(spark, sf_dir, tmp_path):
    events = tables.progress(spark, sf_dir).repartition(3)
    source = f"file://{tmp_path}/events"
    events.write.parquet(source)
    got = {}
    stream = progress.events(spark, source, events.schema, 1)
    progress.push(stream, lambda batch, n: got.update({r.video_id: r for r in batch.collect()}), f"file://{tmp_path}/c1").awaitTermination()
    assert {(v, r.event_id, r.progress, r.stage) for v, r in got.items()} == {tuple(r) for r in ingest.latest(events).select("video_id", "event_id", "progress", "stage").collect()}
    best = {r.video_id: r.m for r in events.groupBy("video_id").agg(F.max("progress").alias("m")).collect()}
    assert {v: r.best for v, r in got.items()} == best
    for n, plan in (("s", progress.sessions(stream)), ("h", progress.heat(stream))):
        out = f"file://{tmp_path}/{n}"
        plan.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() > 0


@pytest.mark.parametrize("first", ["frames", "captions"])
def test_captions_and_frames_in_either_order(spark, tmp_path, first):
    """What comes first waits; of two captions of a frame the later one counts; a caption whose
    frame never comes changes nothing; a second run goes on where the first one ended."""
    table, at = f"file://{tmp_path}/table", {k: f"file://{tmp_path}/{k}" for k in ("frames", "captions")}
    frames = spark.createDataFrame([(0, 1, ""), (0, 2, ""), (1, 3, "")], "video_id long, id long, caption string")
    captions = spark.createDataFrame([(1, "a cat", 5), (1, "a dog", 9), (3, "late", 7), (20, "none", 8)], "id long, caption string, at long")
    rows = {"frames": frames, "captions": captions}
    ingest.append(frames, table)
    for k, df in rows.items():
        df.limit(0).write.parquet(at[k])
    run = lambda: progress.enrich(*[progress.events(spark, at[k], rows[k].schema, 1) for k in rows], table, f"file://{tmp_path}/c").awaitTermination()
    found = lambda: {r.id: r.caption for r in spark.read.parquet(table).collect()}
    rows[first].repartition(2).write.mode("append").parquet(at[first])
    run()
    assert found() == {1: "", 2: "", 3: ""}
    other = "captions" if first == "frames" else "frames"
    rows[other].repartition(2).write.mode("append").parquet(at[other])
    run()
    assert found() == {1: "a dog", 2: "", 3: "late"}
    run()
    assert found() == {1: "a dog", 2: "", 3: "late"}


def test_replay_from_state(spark, sf_dir, tmp_path):
    """A late watcher is told the newest state, also after the events are gone and new ones came."""
    rows = [(1, 10, 1, 5.0, "decoding"), (1, 30, 2, 80.0, "vlm_caption"), (2, 10, 3, 1.0, "decoding"), (1, 20, 4, 90.0, "asr_whisper")]
    source, state = f"file://{tmp_path}/events", f"file://{tmp_path}/state"
    schema = "video_id long, ts long, event_id long, progress double, stage string"
    asked = spark.createDataFrame([(1,), (2,), (3,)], "video_id long")
    told = lambda: {r.video_id: (r.progress, r.stage) for r in progress.replay(spark, state, asked).collect()}
    for n, part in enumerate((rows[:3], rows[3:], [(3, 40, 5, 2.0, "scene_detect")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        progress.push(progress.events(spark, source, spark.read.parquet(source).schema), lambda b, n: b.write.format("noop").mode("overwrite").save(), state).awaitTermination()
    assert told() == {1: (80.0, "vlm_caption"), 2: (1.0, "decoding"), 3: (2.0, "scene_detect")}


@pytest.mark.parametrize("pieces", [1, 4, 9])
def test_reports_of_any_micro_batches(spark, tmp_path, pieces):
    said = [(v, i, (i + 1) * (0.3 + 0.2 * v), "x" if i % 3 else " ") for v in range(3) for i in range(18)]
    schema = "video_id long, id long, t_end double, spoken string"
    videos = spark.createDataFrame([(v, 6.0 + v) for v in range(3)], "video_id long, duration_sec double")
    source, out = f"file://{tmp_path}/said", f"file://{tmp_path}/out"
    for k in range(pieces):
        spark.createDataFrame([r for r in said if r[1] * pieces // 18 == k], schema).coalesce(1).write.mode("append").parquet(source)
    progress.report(progress.events(spark, source, spark.read.parquet(source).schema, 1), videos, out, f"{out}-c").awaitTermination()
    whole = ingest.throttled(spark.createDataFrame(said, schema), videos)
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect())) and got.count() > 3


def test_one_failing_file_loses_itself_alone(spark):
    sizes = spark.sparkContext.accumulator(0)

    def build():
        def infer(batch):
            if len(batch) > 4:
                sizes.add(1)
            if (batch["file"] == "bad").any():
                raise RuntimeError("silent video")
            return batch

        return infer

    rows = spark.createDataFrame([(i, "bad" if i in (3, 7) else f"f{i // 4}") for i in range(20)], "id long, file string").coalesce(1)
    for by in (None, "file"):
        got = ingest.apply_model(rows, build, "id long, file string", failing="empty", by=by, size=4)
        assert sorted(r.id for r in got.collect()) == [i for i in range(20) if i not in (3, 7)]
    assert sizes.value == 0
    with pytest.raises(Exception, match="silent video"):
        ingest.apply_model(rows, build, "id long, file string").count()


def test_scene_cuts(spark):
    """Three shots, a flash that is too soon after a cut, a video that never changes."""
    value = lambda t: 0.0 if t < 10 else 5.0 if t < 20 else -5.0
    rows = [(1, t, float(t), [value(t), value(t) + 0.01 * (t % 2)]) for t in range(30)] + [(2, 100 + t, float(t), [1.0, 1.0]) for t in range(5)]
    videos = spark.createDataFrame([(1, 31.0), (2, 6.0), (3, 4.0)], "video_id long, duration_sec double")
    frames = spark.createDataFrame(rows, "video_id long, id long, ts double, vector array<double>")
    cuts = lambda **more: sorted((r.video_id, r.scene_index, r.t_start, r.t_end) for r in ingest.detected_scenes(frames, videos, **more).collect())
    assert cuts() == [(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (1, 2, 20.0, 31.0), (2, 0, 0.0, 6.0), (3, 0, 0.0, 4.0)]
    assert cuts(least=15.0) == [(1, 0, 0.0, 20.0), (1, 1, 20.0, 31.0), (2, 0, 0.0, 6.0), (3, 0, 0.0, 4.0)]
    assert cuts(floor=8.0)[:2] == [(1, 0, 0.0, 20.0), (1, 1, 20.0, 31.0)]


@pytest.mark.parametrize("chunk", [7, 64, 1024])
def test_timelines_in_chunks(spark, chunk):
    """Smoothed bins, islands, peaks and valleys as on whole groups: islands across chunks, flat
    and empty stretches, a timeline of one bin."""
    rng = random.Random(6)
    rows = [(1, rng.uniform(0, 700), rng.random()) for _ in range(60)] + [(1, 300 + i / 2, 0.9) for i in range(90)] + [(2, 3.0, 0.5), (3, 0.0, 1.0), (4, 50.0, 0.0), (5, 0.0, 0.7), (5, 99.9, 0.7)]
    timeline = spark.createDataFrame([(v, t, s, {1: 700.0, 3: 0.2}.get(v, 100.0)) for v, t, s in rows], "video_id long, t double, score double, duration_sec double")
    binned = signal.bins(timeline, KEYS)
    whole = signal.normalise(signal.smooth(binned, KEYS, signal.multiscale()), KEYS)
    cut = timelines.normalise(timelines.smooth(binned, KEYS, signal.multiscale(), chunk), KEYS)
    plain = lambda df: sorted((r.video_id, r.n, r.idx, round(r.value, 8)) for r in df.collect())
    assert plain(cut) == plain(whole)
    one = moments.valleys(moments.with_threshold(whole, KEYS, 0.1), KEYS)
    two = timelines.valleys(timelines.with_threshold(cut, KEYS, 0.1), KEYS, chunk)
    figures = lambda df: sorted((r.video_id, r.n, r.cluster, r.peak, round(r.score, 8), r.left, r.right) for r in df.collect())
    assert figures(two) == figures(one) and two.count() > 10


def test_keys_found_in_one_pass(spark):
    keys = ["ab", "b", "", "abc", "ab", "zz", "Ä"]
    texts = ["xabcx", "", None, "b", "zÄz", "ZZ"]
    got = automaton.find(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), F.col("t"), keys).orderBy("i").collect()
    assert [r.found for r in got] == [[] if t is None else [k for k, key in enumerate(keys) if key in t] for t in texts]
    assert [r.found for r in automaton.find(spark.createDataFrame([("a",)], "t string"), F.col("t"), []).collect()] == [[]]


def test_best_frames_of_many_requests(spark):
    """As by all products, in runs of few rows, with ties, null vectors and requests of one video."""
    rng = random.Random(4)
    rows = [(i % 3, i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(90)] + [(1, 500, None), (2, 501, [1.0])]
    frames = spark.createDataFrame(rows, "video_id long, id long, vector array<double>").withColumn("ts", F.lit(0.0)).repartition(5)
    wanted = [scoring.Request(n, [rng.gauss(0, 1) for _ in range(3)], video_id=None if n % 4 else 1) for n in range(12)] + [scoring.Request(50, [1.0, 0.0])]
    asked = scoring.requests(spark, wanted)
    dot = lambda r, v: sum(a * b for a, b in zip(vectors.unit(r.vector), v, strict=True))
    for by in ("video_id", None):
        got = {(r.request_id, r[by] if by else None, r["rank"]): r.id for r in scoring.best_frames(frames, asked, 3, 4, by).collect()}
        want = {}
        for r in wanted[:-1]:
            for v in [0, 1, 2] if by else [None]:
                own = [x for x in rows if x[2] and len(x[2]) == 3 and (v is None or x[0] == v) and r.video_id in (None, x[0])]
                for place, x in enumerate(sorted(own, key=lambda x: (-round(dot(r, x[2]), 12), x[1]))[:4]):
                    want[r.request_id, v, place + 1] = x[1]
        assert {k: round(dot(wanted[k[0]], rows[i][2]), 9) for k, i in got.items()} == {k: round(dot(wanted[k[0]], rows[i][2]), 9) for k, i in want.items()}
    plan = scoring.best_frames(frames, scoring.requests(spark, wanted[1:4]), 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_coarse_index_recall(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, vectors.unit([c + rng.gauss(0, 0.35) for c in rng.choice(centres)])) for i in range(1500)]
    frames = spark.createDataFrame(rows, "id long, vector array<double>").cache()
    cells = index.fit_cells(frames, 16)
    asked = scoring.requests(spark, [scoring.Request(i, rows[i][1]) for i in range(0, 1500, 100)])
    got = index.probe(index.assign(frames, cells, 16), asked, cells, 16, 10).select("request_id", "id")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    best = {(i, j) for i in range(0, 1500, 100) for j, _ in sorted(rows, key=lambda r: (-dot(r[1], rows[i][1]), r[0]))[:10]}
    assert len(best & {tuple(r) for r in got.collect()}) >= 0.9 * len(best)
    assert index.assign(frames, cells, 16).count() == 1500
    assert index.fit_cells(frames.limit(100), 16) is None


def test_search_log_and_tail(spark, tmp_path):
    found = spark.createDataFrame([(0, 5), (0, 6)], "request_id long, video_id long")
    asked = spark.createDataFrame([(0, "red car", 5), (1, "none", None)], "request_id long, query string, video_id long")
    rows = search.log_entries(found, asked, 12.5)
    assert rows.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " ").replace(",", ", ") == tables.SCHEMAS["search_logs"]
    assert {r.query_text: r.retrieved_moments_count for r in rows.collect()} == {"red car": 2, "none": 0}
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(["A error", "", "  ", "fine", "ERROR b", "c"])], "at long, value string")
    assert [r.value for r in ingest.log_tail(lines, 2).collect()] == ["c", "ERROR b"]
    assert [r.value for r in ingest.log_tail(lines, 5, "error").collect()] == ["ERROR b", "A error"]


def test_chunks_are_rows_until_the_end(spark):
    """Bins are arrays of a chunk: no aggregate of bins, which would spill, and a plan that doesn't
    grow with the steps. Null keys are a group; a batch may cut a chunk."""
    rng = random.Random(8)
    rows = [(v, rng.uniform(0, 300), rng.random(), 300.0) for v in (1, 2, None) for _ in range(80)]
    binned = signal.bins(spark.createDataFrame(rows, "video_id long, t double, score double, duration_sec double"), KEYS)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        smoothed = timelines.smooth(binned, KEYS, signal.multiscale(), 64)
        got = sorted((r.video_id or 0, r.n, r.idx, round(r.smoothed, 9)) for r in smoothed.collect())
        found = timelines.moments(binned, KEYS, signal.multiscale(), 64)
        plan = found._jdf.queryExecution().executedPlan().toString()
        figures = lambda df: sorted((r.video_id or 0, r.n, r.cluster, r.peak, round(r.score, 8), r.left, r.right) for r in df.collect())
        two = figures(found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == sorted((r.video_id or 0, r.n, r.idx, round(r.smoothed, 9)) for r in signal.smooth(binned, KEYS, signal.multiscale()).collect())
    whole = signal.normalise(signal.smooth(binned, KEYS, signal.multiscale()), KEYS)
    assert two == figures(moments.valleys(moments.with_threshold(whole, KEYS), KEYS)) and len(two) > 20
    assert plan.count("Scan parquet") <= 4 and plan.count("Exchange") <= 8, plan


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_subtitles_are_numbered_without_sorting_pairs(spark, piece):
    """Numbers by hand, over spans and pieces of them; pairs are neither shuffled nor sorted."""
    rng = random.Random(9)
    clips = [(v, c, s, s + rng.choice([0.0, 5.0, 70.0, 400.0])) for v in (1, 2) for c in range(12) for s in [rng.uniform(0, 500)]]
    said = [(v, i, s, s + rng.choice([-1.0, 2.0, 130.0]), f"t{i}") for v in (1, 2) for i in range(80) for s in [rng.uniform(0, 600)]]
    found = retrieval.subtitles(spark.createDataFrame(clips, "video_id long, clip_id long, c_start double, c_end double"), spark.createDataFrame(said, "video_id long, id long, t_start double, t_end double, spoken string"), piece=piece)
    expected = []
    for v, c, a, b in clips:
        own = sorted((s, i, e, t) for w, i, s, e, t in said if w == v and e >= a and s <= b)
        expected += [(v, c, n + 1, max(0.0, s - a), min(max(0.5, b - a), e - a), t) for n, (s, i, e, t) in enumerate(own)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "Exchange" not in above and "Window" not in above and "Sort" not in above


def test_subtitles_broadcast_no_clips(spark, monkeypatch):
    """Clips by span come from a row a video, so they look small; nothing is built in the driver. Numbers by
    hand over several spans, with texts that go on into later ones; arrays within a clip are taken whole."""
    monkeypatch.setattr(retrieval, "PAIRS", 1000, raising=False)
    videos = spark.range(3).repartition(2).groupBy(F.col("id").alias("video_id")).agg(F.max(F.lit(40)).alias("n"))
    clips = videos.select("video_id", F.explode(F.sequence(F.lit(0), "n")).alias("clip_id")).select("video_id", "clip_id", (F.col("clip_id") * 7.0 + F.col("video_id")).alias("c_start"), (F.col("clip_id") * 9.0 + 5).alias("c_end"))
    said = [(v, i, float(i), i + (90.0 if i % 37 == 0 else -1.5 if i % 11 == 0 else 0.8), f"t{i}") for v in range(3) for i in range(400)]
    found = retrieval.subtitles(clips, spark.createDataFrame(said, "video_id long, id long, t_start double, t_end double, spoken string"), width=50.0, piece=8)
    expected = []
    for v in range(3):
        for c in range(41):
            a, b = c * 7.0 + v, c * 9.0 + 5
            own = sorted((s, i, e, t) for w, i, s, e, t in said if w == v and e >= a and s <= b)
            expected += [(v, c, n + 1, max(0.0, s - a), min(max(0.5, b - a), e - a), t) for n, (s, i, e, t) in enumerate(own)]
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "hashpartitioning" in plan
    made = []
    monkeypatch.setattr(retrieval, "stored", lambda df, label: made.append(df) or stored(df, label))
    retrieval.subtitles(clips, spark.createDataFrame(said, "video_id long, id long, t_start double, t_end double, spoken string"))
    for df in made:
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString(), df
