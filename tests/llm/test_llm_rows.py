"""Rows come out as they went in: ids of any size beside nulls, repeated and shared ids,
columns named like an operator's own, empty tables; and figures recomputed in plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import base_figures, pairs, shingles

import corpus_pipeline
from timelode.llm import common, connect, exact_dedup, license_scan, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scan, sharding

BIG = 9007199254740993  # 2**53 + 1: no float holds it
NAMES = "n_words long, content_share double, kept boolean, row_ long, times_ int, turn_ string, gone_ string, text_ string, spot_ long, word_ long, bits_ long, redacted_ string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def clash(spark, tmp_path_factory):
    """Ids null, shared, repeated and large; columns that clash with every helper's."""
    rng = random.Random(5)
    base = prose(rng, 150)
    near = base.split()
    near[70] = "changed"
    texts = [base, " ".join(near), base + " ", base.replace(" ", "\n", 3), prose(rng, 60), prose(rng, 80), "", None, "a b"]
    ids = [BIG, None, BIG, BIG + 2, None, 7, 7, None, -3]
    rows = [(i, t, "en", f"s{k % 2}", len(t or ""), -k, 0.5, None, 100 - k, 1, "t", "g", "x", k, k, k, "r") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[0], rows[0], rows[4], (None, None, None, None, None, *[None] * 12)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}"
    path = str(tmp_path_factory.mktemp("clash") / "documents")
    spark.createDataFrame(rows, schema).repartition(3, F.xxhash64("text")).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_large_ids_beside_nulls(clash):
    ids = pairs(clash, "doc_id")
    assert pairs(ngram_join.join(clash), "doc_id") == ids
    assert pairs(quality_rules.annotate(clash, quality_rules.DEFAULT), "doc_id", "n_chars") == pairs(clash, "doc_id", "n_chars")
    assert pairs(pii.scan(clash), "doc_id") == ids
    packed = packing.pack(packing.pieces(clash), group=4)
    assert pairs(packed.where("piece = 0"), "doc_id") == ids
    assert pairs(mixing.mix(clash, block=3), "doc_id") == ids
    assert pairs(exact_dedup.dedup(clash), "doc_id") == ids
    assert pairs(sharding.shard(clash, [1.0] * 4), "doc_id") == ids
    assert pairs(license_scan.scan(clash), "doc_id") == ids
    assert pairs(secret_scan.scan(clash, F.col("source"), F.col("lang")), "doc_id") == ids
    assert pairs(quality_classifier.classify(clash, quality_classifier.DEFAULT, F.col("source"), F.col("lang")), "doc_id") == ids


def test_stages_return_whole_rows(clash, spark, sf_dir):
    """Each stage's result is a part of its input (the mix may repeat it), every column as it was."""
    given = rows_of(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clash, sf_dir)
        assert found.columns == clash.columns and found.schema.simpleString() == clash.schema.simpleString()
        got = rows_of(found)
        assert set(got) <= set(given), name
        if name != "mixing":
            assert not got - given, name


def test_stages_on_an_empty_table(clash, spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clash.limit(0), sf_dir).count() == 0


def test_quality_stage_against_a_plain_field(clash):
    """The verdict by brute force: all ways to label up to 12 lines, whole texts."""
    from itertools import product

    field = quality_rules.DEFAULT
    rng = random.Random(2)
    lines = ["good prose of several words, and more of it.", "### | $$$ | *** |", "HOME | LOGIN | CART", "another fine line of text here, as usual.", "&&& <<< >>> ###"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) + "\n" + prose(rng, rng.randint(1, 30)) for _ in range(60)]
    found = quality_rules.judge(texts, field)
    for i, text in enumerate(texts):
        x, n, *_ = quality_rules.line_features([text])
        gain = x @ np.array(field.emit)

        def worth(path, gain=gain):
            return sum(g * s for g, s in zip(gain, path, strict=True)) + sum(field.step[a][b] for a, b in zip(path, path[1:], strict=False))

        best = max(product((1, 0), repeat=len(gain)), key=worth)
        share = sum(w * s for w, s in zip(n, best, strict=True)) / sum(n)
        assert found["content_share"][i] == pytest.approx(share)
        assert found["kept"][i] == (not base_figures(text)[-1] and share >= 0.5)


def test_lines_after_the_64th_teach_the_field(spark):
    """Two kinds of documents that differ in their 65th line and after only."""
    start = "\n".join(f"the same opening line number {i} for every document here" for i in range(64))
    docs = [(i, start + "\n" + "\n".join(("plain, words, again, and, again, here,", "plain words again and again here")[1 - i % 2] + f" {j}" for j in range(64))) for i in range(40)]
    known = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    field = quality_rules.fit(spark.createDataFrame(docs, "doc_id long, text string"), known)
    assert field.emit[quality_rules.FEATURES.index("points")] < -0.05


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    x, field = rng.normal(size=(7, len(quality_rules.FEATURES))), quality_rules.DEFAULT

    def likelihood(theta, good):
        from itertools import product

        gain, step = x @ theta[:-4], theta[-4:].reshape(2, 2)
        worth = [sum(g * s for g, s in zip(gain, p, strict=True)) + sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product((0, 1), repeat=7)]
        return (worth[-1] if good else worth[0]) - np.logaddexp.reduce(worth)

    theta = np.concatenate([field.emit, np.ravel(field.step)])
    for good in (0, 1):
        plain = [(likelihood(theta + e, good) - likelihood(theta - e, good)) / 2e-5 / 7 for e in np.eye(len(theta)) * 1e-5]
        assert quality_rules.gradient(x, good, field) == pytest.approx(np.array(plain), abs=1e-5)


# 1
def test_repeated_rows_are_mixed_one_by_one(spark):
    docs = spark.createDataFrame([(1, prose(random.Random(1), 32), "a")] * 40 + [(i, prose(random.Random(i), 200), "b") for i in range(2, 9)], "doc_id long, text string, source string")
    took = {r.source: (r.t, r.g) for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()}
    words = mixing.mixed_rows(docs).select("source", F.size(F.split("text", " ")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: t for s, (t, _) in took.items()}
    assert abs(took["a"][0] - took["a"][1]) <= 32


# 4
def test_templates_of_any_length(spark):
    rng = random.Random(9)
    body = prose(rng, 300)
    w = body.split()
    some = w[:]
    for i in range(0, 300, 10):
        some[i] = "zz"
    docs = [(1, prose(rng, 500) + " " + body + " " + prose(rng, 50)), (2, prose(rng, 77) + " " + " ".join(some)), (3, " ".join(w[:200])), (4, prose(rng, 900))]
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates=[("long", body), ("short", "released under the mit license")])
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in found.collect()}
    assert got[1] == ("long", 1.0) and got[2][0] == "long" and got[3] == got[4] == ("", 0.0)


def test_license_precision_and_recall(spark):
    """License texts as people change them against prose with the same words."""
    rng = random.Random(21)
    own = [(label, t) for label, t in license_scan.TEMPLATES if len(t.split()) >= 12]
    true = []
    for i in range(200):
        label, t = own[i % len(own)]
        w = t.split()
        for _ in range(len(w) // 14):  # a word in 14 is another one
            w[rng.randrange(len(w))] = rng.choice(["our", "said", "XYZ", "program"])
        true.append((i, prose(rng, rng.randint(0, 90)) + "\n * " + " ".join(w).upper() + "\n" + prose(rng, 30), label))
    false = ["Students at MIT released the list of guests under embargo", "The Apache helicopter is licensed; see version 2.0 of the manual", "free software and the general public: a license to copy, distribute and modify is granted to any person"]
    for label, t in own:
        w = t.split()
        rng.shuffle(w)
        false.append(" ".join(w))
        false.append(" and ".join(w))
    docs = true + [(1000 + i, prose(rng, 20) + " " + t + " " + prose(rng, 20), "") for i, t in enumerate(false)]
    got = {r.doc_id: (r.labels, r.base_labels) for r in license_scan.scan(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()}
    added = {(i, x) for i, (labels, base) in got.items() for x in labels.split(",") if x and x not in base.split(",")}
    want = {(i, label) for i, _, label in docs if label and label not in got[i][1].split(",")}
    assert len(added & want) >= 0.9 * len(want) and len(added & want) >= 0.9 * len(added), (len(want), len(added), sorted(added - want)[:5], sorted(want - added)[:5])
    assert got[1000][0] == ""


# 6
def test_posteriors_by_plain_sums(odd, labels):
    """Every posterior and verdict again, from the evidence alone."""
    model = quality_classifier.fit(odd, labels)
    rows = quality_classifier.classify(odd, model, F.col("source"), F.col("lang")).collect()
    unit = lambda r: round(r.evidence * 1e6) / 1e6
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        paths[r.host, r.path].append(unit(r))
        hosts[r.host].append(unit(r))
    every = [v for own in hosts.values() for v in own]
    n, mean = len(every), sum(every) / len(every)
    avg = lambda v: sum(v) / len(v)
    within = sum((v - avg(own)) ** 2 for own in paths.values() for v in own) / (n - len(paths))
    of_paths = sum(len(own) * (avg(own) - avg(hosts[h])) ** 2 for (h, _), own in paths.items())
    nested = sum(len(own) ** 2 / len(hosts[h]) for (h, _), own in paths.items())
    between_paths = max(0.0, (of_paths - (len(paths) - len(hosts)) * within) / max(1e-9, n - nested))
    of_hosts = sum(len(own) * (avg(own) - mean) ** 2 for own in hosts.values())
    part = nested - sum(len(own) ** 2 for own in paths.values()) / n
    between_hosts = (of_hosts - (len(hosts) - 1) * within - part * between_paths) / max(1e-9, n - sum(len(own) ** 2 for own in hosts.values()) / n)
    strength = lambda b: min(1e4, max(1.0, within / b)) if b > 1e-9 else 1e4
    kh, kp = strength(between_hosts), strength(between_paths)
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    for r in rows:
        host = (sum(hosts[r.host]) + kh * mean) / (len(hosts[r.host]) + kh)
        path = (sum(paths[r.host, r.path]) + kp * host) / (len(paths[r.host, r.path]) + kp)
        assert r.host_posterior == pytest.approx(host, abs=1e-6) and r.path_posterior == pytest.approx(path, abs=1e-6)
        quality = 1 / (1 + math.exp(-(logit(r.evidence) + 0.5 * (logit(path) - logit(mean)))))
        assert r.quality == pytest.approx(quality, abs=1e-5)


def test_spread_finds_the_components(spark):
    """Nested groups with known spreads: the strengths are their ratios."""
    rng = np.random.default_rng(8)
    rows = []
    for h in range(60):
        host = rng.normal(0.5, 0.08)
        for p in range(8):
            path = rng.normal(host, 0.04)
            rows += [(h, p, int(round(1e6 * v))) for v in np.clip(rng.normal(path, 0.1, 30), 0, 1)]
    flat = spark.createDataFrame(rows, "host int, path int, e long")
    paths = flat.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum((F.col("e") * F.col("e")).cast("decimal(38,0)")).alias("ss"))
    found = quality_classifier.spread(paths)
    assert found.mean == pytest.approx(0.5, abs=0.04)
    assert found.of_path == pytest.approx(0.1**2 / 0.04**2, rel=0.35) and found.of_host == pytest.approx(0.1**2 / 0.08**2, rel=0.5)


# 7
M64 = (1 << 64) - 1
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def rotl(x, r):
    return ((x << r) | (x >> (64 - r))) & M64


def mixed_bits(h):
    h = ((h ^ (h >> 33)) * P2) & M64
    h = ((h ^ (h >> 29)) * P3) & M64
    return h ^ (h >> 32)


def xx_long(v, seed):
    h = (seed + P5 + 8) & M64
    h ^= (rotl((v & M64) * P2 & M64, 31) * P1) & M64
    return mixed_bits((rotl(h, 27) * P1 + P4) & M64)


def xx_int(v, seed):
    h = (seed + P5 + 4) & M64
    h ^= ((v & 0xFFFFFFFF) * P1) & M64
    return mixed_bits((rotl(h, 23) * P2 + P3) & M64)


def test_shards_by_hand(spark):
    """Every shard and grown shard again, from the published 64-bit hash and the weights."""
    weights = [1.0, 2.0, 0.0, 0.5, 1.0]
    ids = [0, 1, -5, BIG, 77, 123456789] + list(range(1000, 1200))
    found = sharding.shard(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string"), weights, grown_weight=1.5).collect()

    def score(key, shard, weight):
        u = (xx_int(shard, xx_long(key, 42)) % (1 << 52) + 0.5) / (1 << 52)
        return -weight / math.log(u)

    for r in found:
        # the hash is signed in Spark; its positive remainder by a power of two is the same
        scores = [(score(r.doc_id, s, w), s) for s, w in enumerate(weights) if w > 0]
        assert r.shard == max(scores)[1]
        assert r.grown_shard == max([*scores, (score(r.doc_id, 5, 1.5), 5)])[1]


def test_hot_key_is_spread(spark):
    docs = spark.createDataFrame([(None, f"t{i}") for i in range(3000)] + [(i, "") for i in range(10)], "doc_id long, text string")
    for buckets in (16, 50_000):  # with and without the broadcast
        found = sharding.shard(docs, [1.0] * 4, buckets=buckets).collect()
        slots = defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(found) == 3010


# 8
FIRST, LAST = ["Anna", "Peter", "Maria", "John", "Claire", "Hans", "Laura", "David"], ["Whitfield", "Okonkwo", "Marchetti", "Lindqvist", "Abernathy", "Castellanos"]


def planted(rng, n):
    """Texts with true spans of the added kinds and decoys of the same look."""
    out = []
    for i in range(n):
        area, line = rng.choice(["415", "212", "646", "303"]), f"{rng.randint(200, 899)}-{rng.randint(1000, 9999)}"
        true = rng.random() < 0.5
        kind = rng.choice(["local_phone", "id_number", "name"])
        if kind == "local_phone":
            cue, span = ("please call ", f"({area}) {line}") if true else ("order ref ", f"{rng.choice(['011', '199', '100'])}-{rng.randint(100, 199)}-{rng.randint(1000, 9999)}")
        elif kind == "id_number":
            cue, span = ("social security ", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}") if true else ("part serial ", f"9{rng.randint(10, 99)}-00-{rng.randint(1000, 9999)}")
        else:
            cue, span = ("my name, signed by Mr ", f"{rng.choice(FIRST)} {rng.choice(LAST)}") if true else ("see our new article in ", rng.choice(["North Street", "Public License", "Privacy Policy", "West Park"]))
        before = prose(rng, 12) + " " + cue
        if kind == "name" and true:
            start, span = len(before) - 3, "Mr " + span
        else:
            start = len(before)
        text = before + (span[3:] if kind == "name" and true else span) + " " + prose(rng, 12)
        out.append((i, text, f"{kind}:{start}:{start + len(span)}" if true else ""))
    return out


def test_added_spans_on_planted_texts(spark):
    rows = planted(random.Random(12), 600)
    found = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    true = {(i, s) for i, _, s in rows if s}
    got = {(i, s) for i, spans in found.items() for s in spans.split(",") if s}
    right = len(true & got)
    assert right / len(got) >= 0.9 and right / len(true) >= 0.9, (right, len(got), len(true), sorted(got - true)[:5], sorted(true - got)[:5])


def test_scan_by_plain_counts(odd):
    """The patterns counted, the classifier trained and the spans listed again without Spark."""
    texts = [r.text or "" for r in odd.select("text").collect()]
    spans = [[(a, k, b, pii.pattern_of(t, a, k, b)) for a, k, b in pii.base_spans(t) + pii.more_spans(t, pii.base_spans(t))] for t in texts]
    import pandas as pd

    counts = Counter((k, p) for own in spans for _, k, _, p in own)
    patterns = pd.DataFrame([(k, p, n) for (k, p), n in counts.items()], columns=["kind", "pattern", "n"])
    weights = pii.train(patterns)
    taken = {(k, p) for k, p in counts if k >= 4 and 1 / (1 + math.exp(-(pii._vector(k, p) @ weights))) >= 0.5 and "1" in p.split(",")[:3]}
    expected = Counter(pii.listed([(a, k, b) for a, k, b, p in own if k < 4 or (k, p) in taken]) for own in spans)
    assert Counter(r.spans for r in pii.scan(odd).collect()) == expected


def test_labelers_can_disagree():
    text = "order ref (415) 555-0134 and call Maria Lindqvist, Privacy Policy; ssn 078-05-1120 or 123-45-6789; 10.0.0.1 127.0.0.1 8.8.8.8"
    seen = defaultdict(set)
    base = pii.base_spans(text)
    for a, k, b in base + pii.more_spans(text, base):
        for name, vote in zip(("shape", "gazetteer", "context"), pii.votes_of(text, a, k, b), strict=True):
            seen[pii.KINDS[k], name].add(vote)
    assert seen["name", "gazetteer"] == {1, -1} and seen["id_number", "gazetteer"] == {1, -1} and seen["ip", "gazetteer"] == {1, 0, -1}
    assert seen["local_phone", "gazetteer"] == {-1} and seen["local_phone", "context"] == {-1}


# 9
def test_the_longer_of_two_rows_with_one_id_stays(spark):
    for rows in ([(1, "a b"), (1, "a   b      ")], [(1, "a   b      "), (1, "a b")]):
        kept = exact_dedup.kept_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [r.text for r in kept] == ["a   b      "]


def test_state_goes_from_batch_to_batch(spark, tmp_path):
    """A second batch meets the first one's records in the state, and its content at the locators."""
    state, rows = f"file://{tmp_path}/state", lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    found = []
    for n, batch in enumerate([rows((1, "a b c"), (2, "x y"), (3, "only")), rows((4, "abc"), (5, "x  y"), (6, "new"), (7, "ab c"))]):
        batch.write.parquet(f"file://{tmp_path}/docs{n}")
        found.append({r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark.read.parquet(f"file://{tmp_path}/docs{n}"), state_dir=state).collect()})
    assert found[0] == {1: (1, 1, True), 2: (2, 1, True), 3: (3, 1, True)}
    assert found[1] == {4: (1, 3, False), 5: (5, 2, True), 6: (6, 1, True), 7: (1, 3, False)}


def test_equal_digests_of_different_texts_across_batches(spark, tmp_path):
    """No text passes for another because of its digest, whether its batch came from files or not."""
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    short = lambda text: F.unhex(F.substring(F.hex(F.length(text)), 1, 2))  # noqa: E731  texts of one length collide
    for files in (False, True):
        state = f"file://{tmp_path}/state{files}"
        for n, batch in enumerate([rows((1, "aaaa"), (3, "c c c")), rows((2, "bbbb"))]):
            if files:
                batch.write.parquet(f"file://{tmp_path}/batch{n}")
                batch = spark.read.parquet(f"file://{tmp_path}/batch{n}")
            if n == 0:
                assert all(r.kept for r in exact_dedup.dedup(batch, short, state_dir=state).collect())
            else:
                with pytest.raises(ValueError, match="differ in spite"):
                    exact_dedup.dedup(batch, short, state_dir=state)


def test_a_hit_without_content_stops(spark, tmp_path):
    rows, state = lambda *r: spark.createDataFrame(r, "doc_id long, text string"), f"file://{tmp_path}/state"
    exact_dedup.dedup(rows((1, "aaaa")), state_dir=state).collect()
    spark.createDataFrame([], "digest binary, clean string, bucket int").write.mode("overwrite").parquet(f"{state}/contents")
    with pytest.raises(ValueError, match="lacks the content"):
        exact_dedup.dedup(rows((2, "a a a a")), state_dir=state)


def test_a_repeated_row_of_a_later_batch_goes(spark, tmp_path):
    for n in range(3):
        found = exact_dedup.dedup(spark.createDataFrame([(1, "same"), (2 + n, "other")], "doc_id long, text string"), state_dir=f"file://{tmp_path}/state").collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found} == {1: (1, n + 1, n == 0), 2 + n: (2, n + 1, n == 0)}


# rows of derived tables
def derived(spark, tmp_path):
    """(name, table, rows): tables whose rows share a place in a file."""
    words = ["one two three four five six seven", "eight nine ten eleven twelve thirteen"]
    spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(words)], "doc_id long, text string, source string, k long").coalesce(1).write.parquet(f"file://{tmp_path}/docs")
    scan = spark.read.parquet(f"file://{tmp_path}/docs")
    yield "scan", scan, 2
    yield "filtered", scan.where("doc_id >= 0").select("doc_id", "text", "source"), 2
    yield "exploded", scan.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), 4
    yield "joined", scan.join(spark.createDataFrame([(0,), (1,), (1,)], "k long"), "k"), 3
    yield "united", scan.unionByName(scan), 4
    yield "twice", spark.read.parquet(f"file://{tmp_path}/docs", f"file://{tmp_path}/docs"), 4


def test_rows_of_derived_tables_stay_apart(spark, tmp_path):
    for name, docs, n in derived(spark, tmp_path):
        assert docs.count() == n, name
        assert common.numbered(docs, "t").select("row_").distinct().count() == n, name
        if name in ("scan", "filtered", "twice"):
            continue
        assert sorted(r.text for r in exact_dedup.kept_rows(docs).collect()) == sorted({r.text for r in docs.collect()}), name
        assert sorted(r.text for r in ngram_join.kept_rows(docs).collect()) == sorted({r.text for r in docs.collect()}), name
        mixed = mixing.mixed_rows(docs)
        assert mixed.columns == docs.columns and mixed.count() == n, name  # one source: each row once


def test_the_same_row_stays_wherever_it_is_stored(spark, tmp_path):
    """Of rows that tie in length and id, or in a class of near copies, one of the same content in each run."""
    rows = [(1, "a b c d e f g", f"lang{k}") for k in range(40)]
    stays = set()
    for n in range(3):
        random.Random(n).shuffle(rows)
        spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(f"file://{tmp_path}/run{n}")
        docs = spark.read.parquet(f"file://{tmp_path}/run{n}")
        stays.add((exact_dedup.kept_rows(docs).first().lang, ngram_join.kept_rows(docs).first().lang))
    assert len(stays) == 1


# 10
def test_very_many_matches_in_one_text(spark):
    """100,000 matches, one text: in seconds, every place right."""
    import time

    n = 100_000
    text = " ".join(f"token={i:08d}" for i in range(n))
    docs = spark.createDataFrame([(1, text, "s", "en"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    began = time.time()
    found = {r.doc_id: r for r in secret_scan.scan(docs, F.col("source"), F.struct("source", "lang")).collect()}
    assert time.time() - began < 90
    listed = ",".join(f"assign:{15 * i}:{15 * i + 14}" for i in range(n))
    assert found[1].n_assign == n and found[1].spans == listed and found[1].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert found[2].n_assign == 0 and found[2].spans == ""


def test_repositories_decide_between_two_owners(spark):
    value = lambda k: "ghp_" + k * 36
    rows = [(i, value("w"), "one", f"r{i}") for i in range(9)]  # one owner, nine repositories: live
    rows += [(20 + i, value("x"), f"o{i % 2}", f"r{i}") for i in range(6)]  # two owners, six: copied
    rows += [(40 + i, value("y"), f"o{i % 2}", f"r{i}") for i in range(4)]  # two owners, four: live
    rows += [(60 + i, value("z"), f"o{i}", "r") for i in range(3)]  # three owners: copied
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), F.col("source"), F.struct("source", "lang")).collect()
    assert {r.doc_id // 20: (bool(r.spans), r.most_owners, r.most_repositories) for r in found} == {0: (True, 1, 9), 1: (False, 2, 6), 2: (True, 2, 4), 3: (False, 3, 3)}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running(spark, n):
    """The scan over runs agrees with a plain one on either side of a run's end."""
    values = [(7 * i) % 23 for i in range(n)]
    row = spark.createDataFrame([(values,)], "v array<long>").select(
        secret_scan.running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), secret_scan.running(F.col("v"), F.lit(0), F.greatest).alias("m")
    ).first()
    assert row.s == [sum(values[:i]) for i in range(n)] and row.m == [max([0, *values[:i]]) for i in range(n)]


def test_near_copies_of_one_group_in_blocks(spark, monkeypatch):
    """A group far above the block size: links and classes as by brute force."""
    rng = random.Random(4)
    base = prose(rng, 60).split()
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"e{rng.randint(0, 400)}"
        rows.append((None if i % 10 == 0 else i, " ".join(w)))
    monkeypatch.setattr(ngram_join.families, "__defaults__", (0.8, 16))
    monkeypatch.setattr(ngram_join.verify, "__defaults__", (0.8, 16))
    monkeypatch.setattr(connect, "SPREAD", 4)
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [shingles(t) for _, t in rows]
    links = Counter((i, sum(len(a & b) >= 0.8 * len(a | b) for k, b in enumerate(sets) if k != j)) for j, ((i, _), a) in enumerate(zip(rows, sets, strict=True)))
    assert pairs(found, "doc_id", "n_links") == links


def test_thresholds_below_the_bands_are_refused(spark):
    with pytest.raises(ValueError):
        ngram_join.join(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), threshold=0.5)


def xx_bytes(data, seed):
    import xxhash

    return xxhash.xxh64(data, seed=seed).intdigest()


def test_mix_by_hand(spark):
    """Words taken, again from the published hash: chances, draws, order and landing."""
    rng = random.Random(6)
    rows = [(1000 + i, prose(rng, rng.randint(1, 60)), f"s{i % 3}") for i in range(36)]
    found = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    by = defaultdict(list)
    for i, text, source in rows:
        size = len(text.split())
        key = xx_long(size, xx_bytes(text.encode(), xx_bytes(source.encode(), xx_long(i, 42))))
        own = xx_long(0, xx_long(key, 42))
        draw = (xx_int(17, xx_long(own, 42)) % (1 << 30)) / (1 << 30)
        by[source].append((i, size, draw))
    for source, own in by.items():
        total = sum(s for _, s, _ in own)
        target = found[own[0][0]].target
        whole, chance = divmod(target / total, 1)
        own.sort(key=lambda x: (-x[1], x[2]))
        size, draw = (np.array(c, float) for c in list(zip(*own, strict=True))[1:])
        done = mixing.land(np.full(len(own), chance), size, draw) if 1e-9 < chance < 1 - 1e-9 else np.full(len(own), round(chance))
        for (i, s, _), one in zip(own, done, strict=True):
            assert found[i].taken == s * (whole + one), source


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_filters_lose_nothing(spark, words):
    """However many keys share a bit: exactly the rows whose key is gone go, null keys stay."""
    from timelode.llm.common import key_filter, passing, stored, without

    rows = stored(spark.range(1000).selectExpr("CASE WHEN id < 995 THEN id % 300 END AS id", "id AS spot_", "'x' AS word_"), "rows")
    gone = spark.range(0, 300, 7)
    left = without(rows, gone, "id", words)
    assert left.columns == rows.columns
    assert Counter(r.id for r in left.collect()) == Counter(r.id for r in rows.collect() if r.id is None or r.id % 7)
    assert {r.id for r in passing(rows, F.col("id"), key_filter(gone, "id", words), words).collect()} >= set(range(0, 300, 7))


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from timelode.llm.common import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
