"""The SQL twin of every timeline query, for DuckDB on the same tables."""

from __future__ import annotations

from timelode.functions import text as X
from timelode.functions.concepts import CONCEPTS


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_str(v) for v in values) + "]"


FRAMES = """frames AS (
  SELECT CAST(e.label AS BIGINT) AS video_id, e.vec_id AS id,
         CAST(row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) - 1 AS DOUBLE) AS ts,
         e.embedding AS vector, d.text AS caption
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""
SAID = """said AS (
  SELECT conv_id % 10 AS video_id, conv_id * 100 + turn AS id,
         CAST((conv_id // 10) * 8 + turn AS DOUBLE) AS t_start,
         CAST((conv_id // 10) * 8 + turn AS DOUBLE) + CAST(0.8 AS DOUBLE) AS t_end, text AS spoken
  FROM conversations)"""
VIDEOS = f"""{FRAMES}, {SAID}, vids AS (
  SELECT video_id, CAST(ceil(max(t)) + 1 AS DOUBLE) AS duration_sec
  FROM (SELECT video_id, ts AS t FROM frames UNION ALL SELECT video_id, t_end FROM said) GROUP BY video_id)"""
SCENES = f"""{FRAMES}, scn AS (
  SELECT video_id, CAST(floor(ts / 10) AS BIGINT) AS scene_index, min(ts) AS t_start, max(ts) AS t_end,
         count(*) AS keyframe_count, list(id ORDER BY ts, id) AS ids
  FROM frames GROUP BY ALL)"""
TIMELINE = """tl AS (
  SELECT 0 AS request_id, user_id AS video_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(3.6e9 AS DOUBLE) AS t,
         value / 500 AS score FROM events),
dur AS (SELECT DISTINCT 0 AS request_id, video_id, CAST(720 AS DOUBLE) AS duration, CAST(1440 AS BIGINT) AS n FROM tl)"""
PROGRESS = """pr AS (
  SELECT user_id AS video_id, ts, event_id, value AS progress, event_type AS stage,
         CAST(json_extract(props, '$.k') AS BIGINT) AS detail FROM events)"""
PRED = """pred AS (
  SELECT l_orderkey AS query_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank,
         l_quantity AS p_start, l_quantity + 5 + 100 * l_discount AS p_end FROM lineitem),
truth AS (SELECT o_orderkey AS query_id, CAST(o_custkey % 50 AS DOUBLE) AS g_start, CAST(o_custkey % 50 AS DOUBLE) + 10 AS g_end FROM orders),
pairs AS (
  SELECT t.query_id, p.rank, abs(p_start - g_start) AS delta,
         greatest(CAST(0 AS DOUBLE), least(p_end, g_end) - greatest(p_start, g_start))
           / greatest(CAST(1e-6 AS DOUBLE), greatest(p_end, g_end) - least(p_start, g_start)) AS iou
  FROM truth t LEFT JOIN pred p USING (query_id))"""


#: Scales in seconds with their weights, by request, and each request's factor of the threshold.
MULTI_SCALES = "(0, 0.5, 0.35), (0, 1.5, 0.45), (0, 3.5, 0.2)"
SINGLE_SCALE = "(0, 1.5, 1.0)"
ONE_FACTOR = "(0, 0.8)"


def _signal(scales: str, factors: str = ONE_FACTOR) -> str:
    """tl (request_id, video_id, t, score), dur -> bins, dense, sig, thr. The kernel comes
    from its definition: at two bins a second, cut at four sigmas, each scale's taps
    sum to its weight."""
    return f"""scales(request_id, s, w) AS (SELECT r, CAST(s AS DOUBLE), CAST(w AS DOUBLE) FROM (VALUES {scales}) v(r, s, w)),
factors(request_id, factor) AS (SELECT r, CAST(f AS DOUBLE) FROM (VALUES {factors}) v(r, f)),
shapes AS (SELECT request_id, s, w, greatest(CAST(0.5 AS DOUBLE), s * 2) AS sg FROM scales),
taps AS (SELECT *, unnest(range(-CAST(floor(4 * sg + CAST(0.5 AS DOUBLE)) AS BIGINT), CAST(floor(4 * sg + CAST(0.5 AS DOUBLE)) AS BIGINT) + 1)) AS k FROM shapes),
bells AS (SELECT *, exp(-(k / sg) * (k / sg) / 2) AS e FROM taps),
kernel AS (SELECT request_id, k, sum(w * e / whole) AS w FROM (SELECT *, sum(e) OVER (PARTITION BY request_id, s) AS whole FROM bells) GROUP BY request_id, k),
bins AS (
  SELECT request_id, video_id, n, CAST(least(n - 1, greatest(0, round_even(t * 2, 0))) AS BIGINT) AS idx, max(greatest(score, 0)) AS score
  FROM tl JOIN dur USING (request_id, video_id) GROUP BY ALL),
virt AS (
  SELECT request_id, video_id, n, score,
         unnest(range(CASE WHEN idx = 0 THEN -28 ELSE idx END, CASE WHEN idx = n - 1 THEN n + 28 ELSE idx + 1 END)) AS pos FROM bins),
parts AS (SELECT request_id, video_id, pos + k AS idx, sum(score * w) AS s FROM virt JOIN kernel USING (request_id) WHERE pos + k BETWEEN 0 AND n - 1 GROUP BY ALL),
grid AS (SELECT request_id, video_id, n, duration, unnest(range(0, n)) AS idx FROM dur),
dense AS (SELECT g.*, coalesce(s, CAST(0 AS DOUBLE)) AS smoothed FROM grid g LEFT JOIN parts p USING (request_id, video_id, idx)),
ranged AS (SELECT *, min(smoothed) OVER w AS lo, max(smoothed) OVER w AS hi FROM dense WINDOW w AS (PARTITION BY request_id, video_id)),
sig AS (SELECT request_id, video_id, n, duration, idx, round(CASE WHEN hi > lo THEN (smoothed - lo) / (hi - lo) ELSE smoothed END, 9) AS value FROM ranged),
thr AS (SELECT sig.*, round(avg(value) OVER w + factor * stddev_pop(value) OVER w, 9) AS theta FROM sig JOIN factors USING (request_id) WINDOW w AS (PARTITION BY request_id, video_id))"""


CLUSTERS = """above AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY request_id, video_id ORDER BY idx) > 3 THEN 1 ELSE 0 END AS starts FROM thr WHERE value >= theta),
clu AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY request_id, video_id ORDER BY idx) AS BIGINT) AS cluster FROM above),
pk AS (SELECT request_id, video_id, n, duration, any_value(theta) AS theta, cluster, min(idx) AS first, max(idx) AS last, max(value) AS score,
              min(idx) FILTER (WHERE value = best) AS peak
       FROM (SELECT *, max(value) OVER (PARTITION BY request_id, video_id, cluster) AS best FROM clu) GROUP BY ALL)""".replace("any_value(theta) AS theta, ", "theta, ")
VALLEYS = """flags AS (
  SELECT *, value <= theta AND lag(value) OVER w > value AS rl, value <= theta AND lead(value) OVER w > value AS rr,
         value < CAST(0.7 AS DOUBLE) * theta AS deep FROM thr WINDOW w AS (PARTITION BY request_id, video_id ORDER BY idx)),
walk AS (
  SELECT *,
    greatest(coalesce(max(CASE WHEN rl THEN idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0),
             coalesce(max(CASE WHEN deep THEN idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS l,
    least(coalesce(min(CASE WHEN rr THEN idx END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n - 1),
          coalesce(min(CASE WHEN deep THEN idx END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n - 1)) AS r
  FROM flags WINDOW w AS (PARTITION BY request_id, video_id ORDER BY idx)),
raw AS (
  SELECT p.request_id, p.video_id, p.cluster, p.score,
         l * (CASE WHEN p.n > 1 THEN p.duration / (p.n - 1) ELSE 0 END) AS s, r * (CASE WHEN p.n > 1 THEN p.duration / (p.n - 1) ELSE 0 END) AS e,
         CASE WHEN p.n > 1 THEN p.duration ELSE 0 END AS fin
  FROM pk p JOIN walk w ON w.request_id = p.request_id AND w.video_id = p.video_id AND w.idx = p.peak),
raised AS (SELECT *, CASE WHEN e - s < 1.5 THEN least(fin, s + 1.5) ELSE e END AS e2 FROM raw),
mom AS (
  SELECT request_id, video_id, cluster, round(s, 2) AS t_start, round(CASE WHEN e2 - s > 60 THEN s + 60 ELSE e2 END, 2) AS t_end, round(score, 4) AS score
  FROM raised)"""
NMS = """ord AS (SELECT *, row_number() OVER (PARTITION BY request_id, video_id ORDER BY score DESC, cluster) AS rn FROM mom),
nms AS (
  SELECT DISTINCT request_id, video_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(t_start DOUBLE, t_end DOUBLE, score DOUBLE)[]) AS kept FROM mom
  UNION ALL
  SELECT o.request_id, o.video_id, o.rn,
         CASE WHEN len(list_filter(kept, lambda u: least(o.t_end, u.t_end) - greatest(o.t_start, u.t_start) > 0
              AND (least(o.t_end, u.t_end) - greatest(o.t_start, u.t_start)) / greatest(CAST(1e-5 AS DOUBLE), o.t_end - o.t_start) > CAST(0.6 AS DOUBLE))) > 0
         THEN kept ELSE list_append(kept, {'t_start': o.t_start, 't_end': o.t_end, 'score': o.score}) END
  FROM nms JOIN ord o ON o.request_id = nms.request_id AND o.video_id = nms.video_id AND o.rn = nms.rn + 1),
fin AS (SELECT request_id, video_id, kept FROM nms QUALIFY row_number() OVER (PARTITION BY request_id, video_id ORDER BY rn DESC) = 1),
won AS (SELECT request_id, video_id, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept, recursive := true) FROM fin)"""

MULTI = f"{TIMELINE}, {_signal(MULTI_SCALES)}"
COS = "list_sum(list_transform(list_zip(vector, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
QUERY = "qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
UNIT = "qv AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS q FROM embeddings WHERE vec_id = 0)"
HEAT = """heat AS (
  SELECT h.request_id, h.video_id, sec, round(s.value, 3) AS value
  FROM (SELECT request_id, video_id, n, unnest(range(0, CAST(ceil(duration) AS BIGINT))) AS sec FROM dur) h
  JOIN sig s ON s.request_id = h.request_id AND s.video_id = h.video_id AND s.idx = least(h.n - 1, h.sec * 2))"""


#: request, weights, its only video, whether it has any evidence, most moments.
REQUESTS = """reqs(request_id, wv, wc, wa, only_video, has, top_k) AS (
  SELECT CAST(r AS BIGINT), CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), v, h, CAST(k AS BIGINT)
  FROM (VALUES (0, 0.45, 0.35, 0.2, NULL, true, 2), (1, 0.45, 0.35, 0.2, NULL, true, 3), (2, 0.45, 0.35, 0.2, NULL, false, 5), (3, 0.1, 0.2, 0.7, 4, true, 5)) x(r, a, b, c, v, h, k))"""
REQUEST_SCALES = ", ".join(f"({r}, {s}, {w})" for r in (0, 2, 3) for s, w in ((0.5, 0.35), (1.5, 0.45), (3.5, 0.2))) + ", (1, 3.0, 1.0)"
REQUEST_FACTORS = "(0, 0.8), (1, 0.4), (2, 0.8), (3, 0.8)"
PREVIEW = ("sorry", "cannot browse", "can't browse", "unable to browse", "large language model", "training data", "cutoff date", "对不起", "抱歉", "语言模型", "无法访问", "没有访问", "作为ai", "你好", "提供帮助", "javascript", "const numbers")
CAPTIONER = ("sorry", "cannot browse", "can't browse", "unable to browse", "not able to browse", "large language model", "training data", "cutoff date", "as an ai", "i am an ai", "don't have access", "not sure what you are asking", "clarify your question", "how can i help")
STAGED = f"""{PROGRESS}, staged AS (
  SELECT video_id, ts, event_id, progress / CAST(4.5 AS DOUBLE) AS progress, detail,
         CASE stage WHEN 'signup' THEN 'decoding' WHEN 'view' THEN 'scene_detect' WHEN 'click' THEN 'asr_whisper' WHEN 'purchase' THEN 'minicpmv_caption' WHEN 'error' THEN 'lancedb_commit' END AS stage FROM pr),
newest AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ts DESC, event_id DESC) = 1)"""


def _clock(s: str) -> str:
    whole = f"CAST(floor({s}) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', CAST(floor({s} / 3600) AS BIGINT), {whole} % 3600 // 60, {whole} % 60, CAST(floor(({s} - floor({s})) * 1000) AS BIGINT))"


def _hits(text: str, words) -> str:
    return f"CAST(len(list_filter({_list(words)}, lambda k: contains({text}, k))) AS BIGINT)"


def _bm25(source: str, key: str, text: str, terms) -> str:
    return f"""WITH d AS (SELECT {key} AS doc_id, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {source}),
p AS (SELECT doc_id, len(t) AS n, k, len(list_filter(t, lambda x: x = k)) AS tf FROM d, (SELECT unnest({_list(terms)}) AS k)),
c AS (SELECT count(*) / CAST({len(terms)} AS DOUBLE) AS docs, sum(n) / CAST(count(*) AS DOUBLE) AS mean FROM p),
i AS (SELECT k, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf, mean FROM p, c WHERE tf > 0 GROUP BY k, docs, mean)
SELECT doc_id, round(sum(idf * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / mean))), 6) AS score FROM p JOIN i USING (k) WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


def statements() -> dict[str, str]:
    from timelode.plans.registry import DIM, FILES, KEYWORDS, PHRASES, QUERIES, QUESTION, SCENE_RATIO, TAU
    from timelode.operators.retrieval import tokens

    frame_hits, said_hits = _hits("lower(coalesce(caption, '')) || ' '", KEYWORDS), _hits("lower(coalesce(spoken, ''))", KEYWORDS)
    caption = f"SELECT video_id, ts, {frame_hits} / CAST({len(KEYWORDS)} AS DOUBLE) * CAST(0.35 AS DOUBLE) AS part FROM frames WHERE {frame_hits} > 0"
    audio = f"SELECT video_id, (t_start + t_end) / 2 AS ts, {said_hits} / CAST({len(KEYWORDS)} AS DOUBLE) * CAST(0.2 AS DOUBLE) AS part FROM said WHERE {said_hits} > 0"
    visual = f"SELECT video_id, ts, greatest(CAST(0 AS DOUBLE), {COS}) * CAST(0.45 AS DOUBLE) AS part FROM frames, qv WHERE len(vector) = {DIM}"
    fused = f"{VIDEOS}, {UNIT}, parts0 AS ({visual} UNION ALL {caption} UNION ALL {audio}), sums AS (SELECT video_id, ts, sum(part) AS score FROM parts0 GROUP BY ALL), fused AS (SELECT v.video_id, v.duration_sec, coalesce(ts, CAST(0 AS DOUBLE)) AS ts, coalesce(score, CAST(0.1 AS DOUBLE)) AS score FROM vids v LEFT JOIN sums USING (video_id))"
    table = "concepts(position, key, visual, audio) AS (VALUES " + ", ".join(f"({p}, {_str(CONCEPTS[i][0])}, {_list(CONCEPTS[i][1])}, {_list(CONCEPTS[i][2])})" for p, i in enumerate(sorted(range(len(CONCEPTS)), key=lambda i: -len(CONCEPTS[i][0])))) + ")"
    typed = f"""typed AS (
  SELECT request_id, regexp_replace(CASE WHEN request_id // {len(QUERIES)} % 2 = 0 THEN start ELSE start || ' ' || text END, '^\\s+|\\s+$', '', 'g') AS query
  FROM (SELECT conv_id * 100 + turn AS request_id, ({_list(QUERIES)})[(conv_id * 100 + turn) % {len(QUERIES)} + 1] AS start, coalesce(text, '') AS text FROM conversations))"""
    clips = """clips AS (SELECT video_id, clip_id, 4 + 7 * clip_id + video_id / CAST(10 AS DOUBLE) AS c_start, CAST(9.25 AS DOUBLE) + 9 * clip_id AS c_end
  FROM (SELECT video_id, unnest(range(0, CAST(floor(duration_sec / 7) AS BIGINT) + 1)) AS clip_id FROM vids))"""
    refused = f"coalesce(len(list_filter({_list(PHRASES)}, lambda p: contains(lower(caption), p) OR contains(caption, p))) > 0, false)"
    hit = f"len(list_filter({_list(tokens(QUESTION))}, lambda k: contains(lower(coalesce(spoken, '')), k))) > 0"
    talk = f"""{SAID}, marked AS (SELECT *, {hit} AS hit FROM said),
ranked AS (SELECT *, max(hit) OVER (PARTITION BY video_id) AS matched, row_number() OVER (PARTITION BY video_id ORDER BY hit DESC, t_start, id) AS rank FROM marked),
few AS (SELECT * FROM ranked WHERE rank <= 5 AND (hit OR NOT matched))"""
    only = "(only_video IS NULL OR only_video = video_id)"
    asked = f"""{VIDEOS}, {UNIT}, {REQUESTS}, parts0 AS (
SELECT request_id, video_id, ts, CASE WHEN has THEN greatest(CAST(0 AS DOUBLE), {COS}) ELSE CAST(0 AS DOUBLE) END * wv AS part FROM frames, qv, reqs WHERE len(vector) = {DIM} AND {only}
UNION ALL SELECT request_id, video_id, ts, {frame_hits} / CAST({len(KEYWORDS)} AS DOUBLE) * wc FROM frames, reqs WHERE has AND {frame_hits} > 0 AND {only}
UNION ALL SELECT request_id, video_id, (t_start + t_end) / 2, {said_hits} / CAST({len(KEYWORDS)} AS DOUBLE) * wa FROM said, reqs WHERE has AND {said_hits} > 0 AND {only}),
sums AS (SELECT request_id, video_id, ts, sum(part) AS score FROM parts0 GROUP BY ALL),
tl AS (SELECT r.request_id, v.video_id, coalesce(ts, CAST(0 AS DOUBLE)) AS t, coalesce(score, CAST(0.1 AS DOUBLE)) AS score FROM (SELECT request_id, video_id FROM vids, reqs WHERE {only}) r JOIN vids v USING (video_id) LEFT JOIN sums USING (request_id, video_id)),
dur AS (SELECT request_id, video_id, duration_sec AS duration, greatest(1, CAST(ceil(duration_sec * 2) AS BIGINT)) AS n FROM vids, reqs WHERE {only}),
{_signal(REQUEST_SCALES, REQUEST_FACTORS)}, {CLUSTERS}, {VALLEYS}, {NMS}, top AS (SELECT request_id, video_id, max(value) AS peak FROM sig GROUP BY ALL),
best AS (SELECT request_id, video_id, rank, t_start, t_end, round(score * least(1, greatest(CAST(0.4 AS DOUBLE), peak / CAST(0.35 AS DOUBLE))), 3) AS score
  FROM won JOIN top USING (request_id, video_id) JOIN reqs USING (request_id) WHERE rank <= top_k AND peak >= CAST(0.12 AS DOUBLE))"""
    preview = f"CASE WHEN coalesce(caption, '') = '' OR len(list_filter({_list(PREVIEW)}, lambda p: contains(lower(caption), p) OR contains(caption, p))) > 0 THEN 'Visual keyframe capturing scene activity and subjects.' ELSE caption END"
    out = {
        "search_requests": f"WITH RECURSIVE {asked} SELECT request_id, video_id, rank, t_start, t_end, score FROM best",
        "search_response": f"""WITH RECURSIVE {asked}, {HEAT},
near AS (SELECT b.request_id, b.video_id, b.rank, f.id AS frame_id, {preview} AS preview FROM best b JOIN frames f ON f.video_id = b.video_id
  QUALIFY row_number() OVER (PARTITION BY b.request_id, b.video_id, b.rank ORDER BY abs(f.ts - (b.t_start + b.t_end) / 2), f.ts, f.id) = 1),
shown AS (SELECT request_id, video_id, count(*) AS n_moments, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY rank) AS frame_ids, string_agg(preview, '|' ORDER BY rank) AS previews FROM near GROUP BY ALL),
warm AS (
  SELECT h.request_id, h.video_id, value FROM heat h JOIN top USING (request_id, video_id) WHERE peak >= CAST(0.12 AS DOUBLE)
  UNION ALL SELECT s.request_id, s.video_id, round(s.value, 3) FROM sig s JOIN top USING (request_id, video_id) WHERE peak < CAST(0.12 AS DOUBLE) AND idx % 2 = 0),
sumh AS (SELECT request_id, video_id, count(*) AS n_heat, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS heat_sum, max(value) AS heat_peak FROM warm GROUP BY ALL)
SELECT request_id, video_id, coalesce(n_moments, 0) AS n_moments, coalesce(frame_ids, '') AS frame_ids, md5(coalesce(previews, '')) AS previews_md5, n_heat, heat_sum, heat_peak, round(duration, 2) AS total_duration, top_k
FROM dur JOIN reqs USING (request_id) LEFT JOIN sumh USING (request_id, video_id) LEFT JOIN shown USING (request_id, video_id)""",
        "progress_status": f"""WITH {STAGED}, asked AS (SELECT DISTINCT video_id FROM pr UNION ALL SELECT unnest([CAST(10000001 AS BIGINT), CAST(10000002 AS BIGINT)]))
SELECT video_id, round(coalesce(progress, 0), 6) AS progress, coalesce(stage, 'decoding') AS stage, CASE WHEN event_id IS NULL THEN 'Initializing...' ELSE '' END AS message FROM asked LEFT JOIN newest USING (video_id)""",
        "stage_completion": f"""WITH {STAGED}, placed AS (SELECT *, list_position(['scene_detect', 'asr_whisper', 'keyframe_ssim', 'siglip2_embedding', 'lancedb_commit', 'vlm_caption', 'complete'], CASE WHEN stage = 'minicpmv_caption' THEN 'vlm_caption' ELSE stage END) AS place FROM staged),
run AS (SELECT *, max(progress >= 100 OR stage = 'complete') OVER w AS ended, coalesce(last_value(CASE WHEN place > 0 THEN place END IGNORE NULLS) OVER w, 0) AS n_done FROM placed WINDOW w AS (PARTITION BY video_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT video_id, event_id, CASE WHEN ended THEN 'decoding,scene_detect,asr_whisper,keyframe_ssim,siglip2_embedding,vlm_caption'
  ELSE array_to_string((['decoding', 'scene_detect', 'asr_whisper', 'keyframe_ssim', 'siglip2_embedding', 'lancedb_commit', 'vlm_caption'])[1:n_done], ',') END AS done, ended FROM run""",
        "ingest_phase": f"WITH {STAGED} SELECT video_id, CASE WHEN stage = 'complete' THEN 'phase2_complete' WHEN stage IN ('lancedb_commit', 'minicpmv_caption') OR progress >= 100 THEN 'phase1_ready' END AS ingestion_phase FROM newest",
        "progress_throttled": f"""WITH RECURSIVE {VIDEOS}, o AS (
  SELECT video_id, id, t_end / 3 AS t, greatest(CAST(1 AS DOUBLE), duration_sec / 3) AS total, row_number() OVER w AS rn,
         count(*) FILTER (WHERE regexp_replace(coalesce(spoken, ''), '^\\s+|\\s+$', '', 'g') <> '') OVER (w ROWS UNBOUNDED PRECEDING) AS segments
  FROM said JOIN vids USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY t_end / 3, id)),
k AS (SELECT *, t AS last, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.*, CASE WHEN o.t - k.last >= 1 OR o.t >= o.total THEN o.t ELSE k.last END, o.t - k.last >= 1 OR o.t >= o.total FROM k JOIN o ON o.video_id = k.video_id AND o.rn = k.rn + 1)
SELECT video_id, id, segments, least(100, CAST(trunc(t / total * 100) AS BIGINT)) AS sub_percent, least(58, 25 + CAST(trunc(t / total * 33) AS BIGINT)) AS progress, round(t, 1) AS current_sec, round(total, 1) AS total_sec FROM k WHERE kept""",
        "speech_segments": f"""WITH {SAID}, s AS (SELECT video_id, id, t_start, regexp_replace(spoken, '^\\s+|\\s+$', '', 'g') AS spoken FROM said WHERE id % 3 <> 0)
SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY t_start, id) AS segment, md5(spoken) AS spoken_md5 FROM s WHERE spoken <> ''""",
        "scene_captions": f"""WITH {SCENES}, c AS (SELECT s.video_id, s.scene_index, s.keyframe_count, regexp_replace(CASE WHEN f.id % 5 = 0 THEN 'I''m Sorry, ' || f.caption ELSE f.caption END, '^\\s+|\\s+$', '', 'g') AS said FROM scn s JOIN frames f ON f.id = s.ids[1])
SELECT video_id, scene_index, md5(CASE WHEN said IS NULL OR said = '' OR len(list_filter({_list(CAPTIONER)}, lambda p: contains(lower(said), p))) > 0
  THEN printf('Scene showing keyframe visuals with %d frames, subjects and ongoing activity.', keyframe_count) ELSE said END) AS caption_md5 FROM c""",
        "decoded_frames": f"""WITH {SCENES}, c AS (SELECT video_id, scene_index, t_start, t_end - t_start AS span, greatest(1, least(10, CAST(trunc(t_end - t_start) AS BIGINT))) AS n FROM scn),
x AS (SELECT *, unnest(range(0, n)) AS i FROM c), y AS (SELECT video_id, scene_index, i, t_start + i / CAST(n AS DOUBLE) * span AS ts FROM x),
z AS (SELECT *, CAST(trunc(ts * CAST(29.97 AS DOUBLE)) AS BIGINT) AS frame_idx FROM y)
SELECT video_id, scene_index, i, round(ts, 6) AS ts, frame_idx, frame_idx * 2 AS content, printf('f_%.2fs.jpg', round(ts, 6)) AS file FROM z WHERE frame_idx % 7 <> 0""",
        "index_topk": f"WITH {FRAMES}, {UNIT}, c AS (SELECT id, {COS} AS s FROM frames, qv WHERE len(vector) = {DIM}) SELECT CAST(0 AS BIGINT) AS request_id, id, row_number() OVER (ORDER BY s DESC, id) AS rank, round(s, 4) AS score FROM c QUALIFY rank <= 10",
        "log_tail": """WITH l AS (SELECT conv_id * 100 + turn AS line, CASE WHEN (conv_id * 100 + turn) % 4 = 0 THEN ' ' ELSE text END AS value FROM conversations)
SELECT line, md5(value) AS value_md5 FROM l WHERE trim(value) <> '' AND contains(lower(value), 'the') ORDER BY line DESC LIMIT 40""",
        "srt_blocks": f"""WITH {SAID}, s AS (SELECT video_id, id, t_start, t_start * CAST(61.25 AS DOUBLE) AS a, t_end * CAST(61.25 AS DOUBLE) AS b, regexp_replace(spoken, '^\\s+|\\s+$', '', 'g') AS spoken FROM said),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_start, id) AS segment FROM s WHERE spoken <> '')
SELECT id, md5(segment || chr(10) || {_clock('a')} || ' --> ' || {_clock('b')} || chr(10) || spoken || chr(10) || chr(10)) AS block_md5 FROM n""",
        "frame_lookup": """WITH o AS (SELECT o_orderkey, o_custkey AS total, (o_orderkey % 3) * CAST(12.5 AS DOUBLE) AS fps, (o_orderkey % 41) * CAST(0.75 AS DOUBLE) AS t FROM orders)
SELECT o_orderkey, round(CASE WHEN fps > 0 THEN total / fps ELSE 0 END, 6) AS duration_sec, greatest(0, least(CAST(trunc(t * fps) AS BIGINT), greatest(0, total - 1))) AS frame_idx FROM o""",
        "scan_videos": f"WITH {VIDEOS} SELECT video_id, duration_sec FROM vids",
        "list_videos": f"""WITH {VIDEOS} SELECT CAST(video_id AS VARCHAR) AS id, 'video_' || video_id || '.mp4' AS filename, '/videos/video_' || video_id || '.mp4' AS filepath, duration_sec,
CAST(25 AS DOUBLE) AS fps, '1280x720' AS resolution, CAST(floor(duration_sec * 25) AS BIGINT) AS total_frames, 'phase1_ready' AS ingestion_phase, '2024-01-01T00:00:00' AS created_at FROM vids""",
        "filter_frames_limit": f"WITH {FRAMES} SELECT video_id, id, ts FROM frames WHERE video_id = 3 ORDER BY ts, id LIMIT 10",
        "valid_vectors": f"SELECT CAST(label AS BIGINT) AS video_id, count(*) FILTER (WHERE len(embedding) = {DIM}) AS n_valid, count(*) AS n_total FROM embeddings GROUP BY label",
        "table_counts": """WITH c AS (SELECT 'embeddings' AS "table", count(*) AS n FROM embeddings UNION ALL SELECT 'conversations', count(*) FROM conversations
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents)
SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c""",
        "upsert_captions": f"""WITH {FRAMES}, done AS (SELECT video_id, id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'caption of ' || l.doc_id END, caption) AS caption
FROM frames f LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = f.id)
SELECT video_id, id, length(caption) AS n_chars, md5(caption) AS caption_md5 FROM done""",
        "cascade_delete": f"""WITH {VIDEOS}, gone AS (SELECT video_id FROM vids WHERE video_id % 3 = 0)
SELECT 'frames' AS "table", video_id, id FROM frames WHERE video_id NOT IN (SELECT video_id FROM gone)
UNION ALL SELECT 'transcripts', video_id, id FROM said WHERE video_id NOT IN (SELECT video_id FROM gone)""",
        "filter_allowed_ext": f"""WITH f AS (SELECT page_id, url || '/' || ({_list(FILES)})[page_id % {len(FILES)} + 1] AS filename FROM pages)
SELECT page_id, filename, lower(regexp_extract(filename, '[^/](\\.[^./]*)$', 1)) IN ('.mp4', '.mkv', '.mov', '.webm', '.avi') AS allowed FROM f""",
        "file_round_trip": f"""WITH f AS (SELECT (page_id % 7) || '/' || page_id || '-' || replace(({_list(FILES)})[page_id % {len(FILES)} + 1], '/', '-') AS name, coalesce(html, '') AS html FROM pages)
SELECT name, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, md5(html) AS content_md5 FROM f WHERE lower(regexp_extract(name, '[^/](\\.[^./]*)$', 1)) IN ('.mp4', '.mkv', '.mov', '.webm', '.avi')""",
        "video_frames_join": f"WITH {VIDEOS} SELECT video_id, count(*) AS n_frames, duration_sec FROM vids JOIN frames USING (video_id) GROUP BY ALL",
        "cosine_scores": f"WITH {FRAMES}, {UNIT} SELECT video_id, id, round({COS}, 4) AS score FROM frames, qv WHERE len(vector) = {DIM}",
        "topk_frames": f"""WITH {FRAMES}, {UNIT}, c AS (SELECT video_id, id, {COS} AS s FROM frames, qv WHERE len(vector) = {DIM})
SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, id) AS rank, round(s, 4) AS score FROM c QUALIFY rank <= 3""",
        "keyword_match_count": f"WITH {FRAMES}, {SAID} SELECT id, {_hits('lower(coalesce(caption, $$$$))', KEYWORDS)} AS matches, 'frame' AS kind FROM frames UNION ALL SELECT id, {said_hits}, 'transcript' FROM said",
        "caption_boost": f"WITH {FRAMES} SELECT video_id, round(ts, 3) AS ts, round(part, 6) AS boost FROM ({caption})",
        "audio_boost": f"WITH {SAID} SELECT video_id, round(ts, 3) AS ts, round(part, 6) AS boost FROM ({audio})",
        "fused_scores": f"WITH {fused} SELECT video_id, round(ts, 3) AS ts, round(score, 6) AS score FROM fused",
        "expand_concepts": f"WITH {table}, {typed} SELECT request_id, key, visual[1] AS translation FROM typed JOIN concepts ON contains(lower(query), key)",
        "expand_query": f"""WITH {table}, {typed}, m AS (SELECT request_id, query, list(c ORDER BY position) FILTER (WHERE c.key IS NOT NULL) AS m FROM typed LEFT JOIN concepts c ON contains(lower(query), key) WHERE query <> '' GROUP BY ALL),
w AS (SELECT request_id, query, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS t, flatten(list_transform(coalesce(m, []), lambda x: x.visual)) AS v, flatten(list_transform(coalesce(m, []), lambda x: x.audio)) AS a,
  list_transform(coalesce(m, []), lambda x: x.visual[1]) AS f FROM m),
u AS (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i)[1:5] AS short FROM w)
SELECT request_id, md5(array_to_string(list_sort(list_distinct(list_concat(t, v))), '|')) AS visual_md5, md5(array_to_string(list_sort(list_distinct(list_concat(t, a))), '|')) AS audio_md5,
  md5(CASE WHEN len(short) > 0 THEN query || ' ' || array_to_string(short, ' ') ELSE query END) AS expanded_md5 FROM u""",
        "rrf_fuse": f"""WITH {FRAMES}, {SAID}, {UNIT}, lists AS (
SELECT 'visual' AS modality, 1 AS place, CAST(id AS VARCHAR) AS item, round({COS}, 6) AS s, ts FROM frames, qv WHERE len(vector) = {DIM}
UNION ALL SELECT 'caption', 2, CAST(id AS VARCHAR), CAST({frame_hits} AS DOUBLE), ts FROM frames WHERE {frame_hits} > 0
UNION ALL SELECT 'audio', 3, 'said ' || id, CAST({said_hits} AS DOUBLE), (t_start + t_end) / 2 FROM said WHERE {said_hits} > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY s DESC, item) AS rank FROM lists),
named AS (SELECT modality, place, rank, ts, CASE WHEN modality <> 'audio' THEN item WHEN ts <> 0 THEN CAST(ts AS VARCHAR) ELSE CAST(rank AS VARCHAR) END AS item FROM r),
p AS (SELECT *, CASE modality WHEN 'visual' THEN CAST(0.5 AS DOUBLE) WHEN 'caption' THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / 3 END / (60 + rank) AS part FROM named)
SELECT item AS id, round(sum(part), 8) AS fused_score, round(coalesce(arg_max(part, rank) FILTER (WHERE modality = 'visual'), 0), 8) AS visual_part,
round(coalesce(arg_max(part, rank) FILTER (WHERE modality = 'audio'), 0), 8) AS audio_part, round(arg_min(ts, CAST(place AS BIGINT) * 1000000000 + rank), 3) AS ts FROM p GROUP BY item""",
        "signal_bins": f"WITH {MULTI} SELECT video_id, idx, round(score, 6) AS score FROM bins",
        "gaussian_multiscale": f"WITH {MULTI} SELECT video_id, idx, round(smoothed, 6) AS smoothed FROM dense",
        "gaussian_single": f"WITH {TIMELINE}, {_signal(SINGLE_SCALE)} SELECT video_id, idx, round(smoothed, 6) AS smoothed FROM dense",
        "dynamic_threshold": f"WITH {MULTI} SELECT video_id, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sigma, round(round(avg(value) + CAST(0.8 AS DOUBLE) * stddev_pop(value), 9), 6) AS theta FROM sig GROUP BY video_id",
        "moment_clusters": f"WITH {MULTI}, {CLUSTERS} SELECT video_id, cluster, first, last FROM pk",
        "moment_peaks": f"WITH {MULTI}, {CLUSTERS} SELECT video_id, cluster, peak, round(score, 6) AS score FROM pk",
        "valley_bounds": f"WITH {MULTI}, {CLUSTERS}, {VALLEYS} SELECT video_id, cluster, t_start, t_end, score FROM mom",
        "greedy_nms": f"WITH RECURSIVE {MULTI}, {CLUSTERS}, {VALLEYS}, {NMS} SELECT video_id, rank, t_start, t_end, score FROM won",
        "heatmap_1hz": f"WITH {MULTI}, {HEAT} SELECT video_id, sec, value FROM heat",
        "heatmap_bands": f"WITH {MULTI}, {HEAT} SELECT video_id, CASE WHEN value >= 0.75 THEN 'high' WHEN value >= 0.5 THEN 'medium' WHEN value >= 0.3 THEN 'low' ELSE 'none' END AS band, count(*) AS n, max(value) AS peak FROM heat GROUP BY ALL",
        "search_moments": f"""WITH RECURSIVE {fused}, tl AS (SELECT CAST(0 AS BIGINT) AS request_id, video_id, ts AS t, score FROM fused),
dur AS (SELECT DISTINCT CAST(0 AS BIGINT) AS request_id, video_id, duration_sec AS duration, greatest(1, CAST(ceil(duration_sec * 2) AS BIGINT)) AS n FROM fused),
{_signal(MULTI_SCALES)}, {CLUSTERS}, {VALLEYS}, {NMS}, top AS (SELECT request_id, video_id, max(value) AS peak FROM sig GROUP BY ALL)
SELECT video_id, rank, t_start, t_end, round(score * least(1, greatest(CAST(0.4 AS DOUBLE), peak / CAST(0.35 AS DOUBLE))), 3) AS score FROM won JOIN top USING (request_id, video_id) WHERE rank <= 5 AND peak >= CAST(0.12 AS DOUBLE)""",
        "nearest_frame": f"""WITH {FRAMES}, {SAID}, p AS (SELECT video_id, id, (t_start + t_end) / 2 AS t FROM said),
c AS (SELECT p.id, f.id AS frame_id, abs(f.ts - p.t) AS d, row_number() OVER (PARTITION BY p.video_id, p.id, p.t ORDER BY abs(f.ts - p.t), f.ts, f.id) AS rn FROM p LEFT JOIN frames f ON f.video_id = p.video_id AND abs(f.ts - p.t) < 999)
SELECT id, frame_id, round(d, 3) AS distance FROM c WHERE rn = 1""",
        "sanitize_captions": f"WITH {FRAMES} SELECT id, md5(CASE WHEN {refused} THEN {_str(X.DEFAULT_CAPTION)} ELSE caption END) AS caption_md5, {refused} AS refused FROM frames",
        "rag_transcripts": f"WITH {talk} SELECT video_id, id, matched, rank FROM few",
        "rag_answer": f"""WITH {FRAMES}, {talk}, {UNIT}, shot AS (SELECT video_id, ts, caption FROM frames, qv WHERE len(vector) = {DIM} QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {COS} DESC, id) = 1),
t AS (SELECT video_id, string_agg(printf('[%.1fs - %.1fs]: %s', t_start, t_end, spoken), chr(10) ORDER BY rank) AS talk, bool_or(matched) AS matched, count(*) FILTER (WHERE matched AND rank <= 2) AS n,
  arg_min({{'s': round(t_start, 1), 'e': round(t_end, 1), 'text': spoken[1:80]}}, rank) AS first FROM few GROUP BY video_id)
SELECT video_id, md5(coalesce(talk, '')) AS context, CASE WHEN matched THEN n WHEN shot.video_id IS NOT NULL THEN 1 ELSE 0 END AS n_citations,
  CASE WHEN matched THEN first.s ELSE round(greatest(0, ts - 2), 1) END AS cite_start, CASE WHEN matched THEN first.e ELSE round(ts + 5, 1) END AS cite_end,
  CASE WHEN matched THEN first.text ELSE coalesce(caption, '') END AS citation FROM t FULL JOIN shot USING (video_id)""",
        "subtitle_overlap": f"""WITH {VIDEOS}, {clips} SELECT video_id, clip_id, row_number() OVER (PARTITION BY video_id, clip_id ORDER BY t_start, id) AS number,
round(greatest(0, t_start - c_start), 3) AS rel_start, round(least(greatest(CAST(0.5 AS DOUBLE), c_end - c_start), t_end - c_start), 3) AS rel_end, md5(spoken) AS text_md5
FROM clips JOIN said USING (video_id) WHERE t_end >= c_start AND t_start <= c_end""",
        "srt_format": f"""WITH {SAID}, s AS (SELECT *, t_start * CAST(61.25 AS DOUBLE) AS s FROM said)
SELECT id, printf('%02d:%02d:%02d,%03d', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s) AS BIGINT) % 3600 // 60, CAST(floor(s) AS BIGINT) % 60, CAST(floor((s - floor(s)) * 1000) AS BIGINT)) AS srt,
printf('moment_%s_%.1f_%.1f.mp4', left(CAST(video_id AS VARCHAR), 8), t_start, t_start + 2) AS clip FROM s""",
        "temporal_iou": f"WITH {PRED} SELECT t.query_id, round(iou, 6) AS iou, round(delta, 6) AS delta FROM truth t LEFT JOIN (SELECT * FROM pairs WHERE rank = 1) USING (query_id)",
        "eval_recall": f"""WITH {PRED}, per AS (SELECT query_id, k, coalesce(max(CASE WHEN rank <= k THEN iou END), 0) AS best FROM pairs, (VALUES (CAST(1 AS BIGINT)), (CAST(5 AS BIGINT))) ks(k) GROUP BY ALL)
SELECT k, theta, round(avg(CASE WHEN best >= theta THEN 100.0::DOUBLE ELSE 0 END), 2) AS recall FROM per, (VALUES (CAST(0.3 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.7 AS DOUBLE))) th(theta) GROUP BY ALL""",
        "eval_miou": f"WITH {PRED}, f AS (SELECT t.query_id, iou, delta FROM truth t LEFT JOIN (SELECT * FROM pairs WHERE rank = 1) USING (query_id)) SELECT round(avg(coalesce(iou, 0)), 4) AS miou, round(avg(coalesce(delta, 100)), 2) AS mean_delta FROM f",
        "sample_timestamps": f"""WITH {SCENES}, c AS (SELECT video_id, scene_index, t_start, t_end - t_start AS span, greatest(1, least(10, CAST(trunc(t_end - t_start) AS BIGINT))) AS n FROM scn),
x AS (SELECT *, unnest(range(0, n)) AS i FROM c)
SELECT video_id, scene_index, i, round(t_start + i / CAST(n AS DOUBLE) * span, 6) AS ts, CAST(trunc((t_start + i / CAST(n AS DOUBLE) * span) * CAST(29.97 AS DOUBLE)) AS BIGINT) AS frame_idx FROM x""",
        "scene_groups": f"WITH {SCENES} SELECT video_id, scene_index, t_start, t_end, keyframe_count, array_to_string(ids, ',') AS frame_ids FROM scn",
        "scene_fallback": f"""WITH {VIDEOS} SELECT video_id, CAST(0 AS BIGINT) AS scene_index, CAST(0 AS DOUBLE) AS t_start, duration_sec AS t_end, false AS failed FROM vids
UNION ALL SELECT video_id, i, CAST(i * 10 AS DOUBLE), CAST((i + 1) * 10 AS DOUBLE), true FROM (SELECT video_id, unnest(range(0, 10)) AS i FROM vids)""",
        "subsample_frames": f"""WITH {SCENES} SELECT video_id, scene_index, array_to_string(CASE WHEN len(ids) > 1 THEN
list_transform(range(0, least(4, len(ids))), lambda i: ids[1 + CAST(trunc(i * ((len(ids) - 1) / CAST(greatest(1, least(4, len(ids)) - 1) AS DOUBLE))) AS BIGINT)]) ELSE ids END, ',') AS picked FROM scn""",
        "keyframe_filter": f"""WITH RECURSIVE {FRAMES}, o AS (SELECT video_id, CAST(floor(ts / 10) AS BIGINT) AS sc, id, vector, row_number() OVER (PARTITION BY video_id, CAST(floor(ts / 10) AS BIGINT) ORDER BY ts, id) AS rn FROM frames),
k AS (SELECT video_id, sc, rn, id, vector AS last, true AS kept FROM o WHERE rn = 1
UNION ALL SELECT video_id, sc, rn, id, CASE WHEN far THEN vector ELSE last END, far FROM (SELECT o.video_id, o.sc, o.rn, o.id, o.vector, k.last,
  list_sum(list_transform(list_zip(o.vector, k.last), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) / len(o.vector) >= CAST({TAU} AS DOUBLE) AS far
  FROM k JOIN o ON o.video_id = k.video_id AND o.sc = k.sc AND o.rn = k.rn + 1))
SELECT video_id, id FROM k WHERE kept""",
        "progress_latest": f"WITH {PROGRESS} SELECT video_id, event_id, progress, stage, detail FROM pr QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ts DESC, event_id DESC) = 1",
        "progress_monotone": f"WITH {PROGRESS} SELECT video_id, event_id, max(progress) OVER (PARTITION BY video_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM pr",
        "bm25_topk": _bm25("documents", "doc_id", "text", KEYWORDS),
        "text_index_topk": f"SELECT 'caption' AS field, * FROM ({_bm25('documents', 'doc_id', 'text', KEYWORDS)}) UNION ALL SELECT 'spoken', * FROM (WITH {SAID} SELECT * FROM ({_bm25('said', 'id', 'spoken', KEYWORDS)}))",
        "best_frames_topk": f"""WITH {FRAMES}, {UNIT}, r(request_id, only_video, factor) AS (VALUES (0, NULL, 1), (1, NULL, 1), (2, NULL, 0), (3, 4, 1)),
c AS (SELECT CAST(request_id AS BIGINT) AS request_id, id, {COS} * factor AS s FROM frames, qv, r WHERE len(vector) = {DIM} AND (only_video IS NULL OR only_video = video_id))
SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, id) AS rank, round(s, 4) AS score FROM c QUALIFY rank <= 10""",
        "scene_cuts": f"""WITH RECURSIVE {VIDEOS}, g AS (
  SELECT video_id, id, ts, round(list_sum(list_transform(list_zip(vector, lag(vector) OVER w), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) / len(vector), 9) AS gap,
         row_number() OVER w AS rn FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY ts, id)),
a AS (SELECT video_id, ts, CASE WHEN rn > 1 THEN gap END AS gap, round((lag(CASE WHEN rn > 1 THEN gap END, 1) OVER w + lag(CASE WHEN rn > 1 THEN gap END, 2) OVER w + lead(gap, 1) OVER w + lead(gap, 2) OVER w) / 4, 9) AS around
  FROM g WINDOW w AS (PARTITION BY video_id ORDER BY rn)),
hi AS (SELECT video_id, ts, row_number() OVER (PARTITION BY video_id ORDER BY ts) AS rn FROM a WHERE around IS NOT NULL AND CASE WHEN around > 0 THEN round(gap / around, 9) >= CAST({SCENE_RATIO} AS DOUBLE) ELSE gap > 0 END),
k AS (SELECT video_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS last, true AS cut FROM vids
  UNION ALL SELECT k.video_id, hi.rn, CASE WHEN hi.ts - k.last >= 1.5 THEN hi.ts ELSE k.last END, hi.ts - k.last >= 1.5 FROM k JOIN hi ON hi.video_id = k.video_id AND hi.rn = k.rn + 1)
SELECT video_id, row_number() OVER w - 1 AS scene_index, last AS t_start, coalesce(lead(last) OVER w, duration_sec) AS t_end FROM k JOIN vids USING (video_id) WHERE cut WINDOW w AS (PARTITION BY video_id ORDER BY rn)""",
    }
    # the same results by streams, and in chunks
    out |= {"gaussian_chunks": out["gaussian_multiscale"], "valley_chunks": out["valley_bounds"]}
    out |= {"progress_replay": out["progress_status"], "streamed_captions": out["upsert_captions"], "throttled_stream": out["progress_throttled"]}
    return {k: v.replace("$$$$", "''") for k, v in out.items()}
