"""Stored indexes: of vectors and of words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelode.operators import ivfpq, text_index
from timelode.sources import tables as T

DIM = 64


def exact(spark, frames, requests, k):
    """The best k of each request by all products."""
    rows = frames.select("id", "vector").collect()
    ids, vectors = [r["id"] for r in rows], np.array([r["vector"] for r in rows], float)
    out = {}
    for r in requests.collect():
        score = np.round(vectors @ np.array(r["q"], float), 9)
        out[r["request_id"]] = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k]
        out[r["request_id"]] = [ids[i] for i in out[r["request_id"]]]
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_over_all_frames(spark, tmp_path, sf):
    """Requests: every vector whose number is divisible by 100, against all vectors."""
    frames = T.frames(spark, f"/root/testdata/sf{sf}").select("id", "vector")
    path = f"file://{tmp_path}/index"
    ivfpq.build(frames, ivfpq.fit(frames, DIM), DIM, path)
    requests = frames.where("id % 100 = 0").select(F.col("id").alias("request_id"), F.col("vector").alias("q"))
    got = {}
    for r in ivfpq.search(path, requests, DIM, 10).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    want = exact(spark, frames, requests, 10)
    hits = sum(len(set(got[k]) & set(v)) for k, v in want.items())
    assert len(got) == len(want) and hits >= 0.9 * sum(map(len, want.values())), hits
    codes = spark.read.parquet(f"{path}/codes")
    assert codes.count() == frames.count() and codes.where(F.length("code") * 16 > DIM * 4).isEmpty()


def test_large_cells_and_odd_vectors(spark, tmp_path, monkeypatch):
    """All in one cell, in many blocks; null and short vectors are in none; ties by id."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 0.01 + 1).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(20)] + [(2000, None), (2001, [1.0])]
    frames = spark.createDataFrame(rows, "id long, vector array<double>")
    path = f"file://{tmp_path}/index"
    monkeypatch.setattr(ivfpq, "CODES", 50)
    monkeypatch.setattr(ivfpq, "REQUESTS", 7)
    ivfpq.build(frames, ivfpq.fit(frames, 8, cells=1, parts=4), 8, path)
    requests = frames.where("id < 30 OR id >= 1019").select(F.col("id").alias("request_id"), F.col("vector").alias("q"))
    found = ivfpq.search(path, requests, 8, 5, refine=100).collect()
    want = exact(spark, frames.where("id < 2000").withColumn("vector", F.col("vector").cast("array<float>")), requests.where("request_id < 2000"), 5)
    got = {k: [r["id"] for r in sorted((r for r in found if r["request_id"] == k), key=lambda r: r["rank"])] for k in want}
    assert got == want and {r["request_id"] for r in found} == set(want)
    with pytest.raises(ValueError):
        ivfpq.fit(frames, 8, parts=3)
    with pytest.raises(ValueError):
        ivfpq.fit(frames.where("id >= 2000"), 8, parts=4)


def test_a_search_reads_its_cells_only(spark, tmp_path):
    frames = T.frames(spark, "/root/testdata/sf0.01").select("id", "vector")
    path = f"file://{tmp_path}/index"
    ivfpq.build(frames, ivfpq.fit(frames, DIM), DIM, path)
    one = frames.where("id = 7").select(F.col("id").alias("request_id"), F.col("vector").alias("q"))
    plan = ivfpq.search(path, one, DIM, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert len([f for f in filters if "cell#" in f]) >= 2 and all(" IN (" in f or " = " in f for f in filters if "cell#" in f), filters


WORDS = ["alpha", "beta", "gamma", "delta", "Éta", "the"]


def texts(rng, n, start=0):
    return [(start + i, " ".join(rng.choice(WORDS, rng.integers(0, 30), p=[0.02, 0.1, 0.2, 0.3, 0.08, 0.3])) if i % 17 else None, " ".join(rng.choice(WORDS, 5))) for i in range(n)]


def bm25_by_hand(docs, column, terms, k):
    """All documents scored in plain Python."""
    import math
    import re
    from collections import Counter

    tokens = {d[0]: Counter(re.findall(r"\w+", (d[column] or "").lower())) for d in docs}
    mean = sum(sum(c.values()) for c in tokens.values()) / len(tokens)
    scores = {}
    for t in set(terms):
        df = sum(c[t] > 0 for c in tokens.values())
        idf = math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5))
        for d, c in tokens.items():
            if c[t]:
                scores[d] = scores.get(d, 0) + idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_text_index_from_increment_to_merge(spark, tmp_path, monkeypatch):
    """Two increments, the second with changed texts; both columns; before and after a merge."""
    monkeypatch.setattr(text_index, "BLOCK", 16)
    rng, path = np.random.default_rng(2), f"file://{tmp_path}/index"
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, caption string, spoken string")
    assert text_index.search(spark, path, "caption", ["alpha"], 3).collect() == []
    one, two = texts(rng, 200), texts(rng, 60, 180)
    docs = {d[0]: d for d in one}

    def agree():
        for field, column in (("caption", 1), ("spoken", 2)):
            for terms, k in ((["alpha"], 5), (["alpha", "beta", "alpha"], 12), (["éta", "nothing"], 3), (["nothing"], 3), (["the", "delta"], 500)):
                got = [(r["doc_id"], r["score"]) for r in text_index.search(spark, path, field, terms, k).collect()]
                want = bm25_by_hand(list(docs.values()), column, terms, k)
                assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=2e-6), (field, terms)

    text_index.add(table(one), ["caption", "spoken"], path)
    agree()
    text_index.add(table(two), ["caption", "spoken"], path)
    docs |= {d[0]: d for d in two}
    agree()
    assert text_index.merge(spark, path) == 2 and text_index.live_segments(spark, path) == [2]
    agree()


def test_text_search_leaves_blocks_out(spark, tmp_path, monkeypatch):
    """A search reads its terms' buckets, and opens few blocks."""
    monkeypatch.setattr(text_index, "BLOCK", 16)
    path = f"file://{tmp_path}/index"
    rows = [(i, "common " * (1 + i % 3) + ("rare " * 9 if i == 77 else ""), "") for i in range(2000)]
    text_index.add(spark.createDataFrame(rows, "doc_id long, caption string, spoken string"), ["caption"], path)
    report = {}
    found = text_index.search(spark, path, "caption", ["rare", "common"], 1, report=report)
    assert [r["doc_id"] for r in found.collect()] == [77]
    assert report["blocks"] >= 100 and report["opened"] <= 5, report
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("(field#" in f and "buck" in f for f in filters) and "In(term, [common,rare" in plan, filters


def test_a_block_is_inverted_in_one_task():
    """Tokens of a block's documents -> postings, no row for a document's term; a merge drops stale ones."""
    import pyarrow as pa

    key = (pa.scalar(3, pa.int32()),)
    rows = pa.table({"doc_id": [7, 2, 7, 9], "field": ["a", "a", "b", "a"], "tokens": pa.array([["x", "y", "x"], ["x"], ["y"], []], pa.list_(pa.string())), "n": [3, 1, 1, 0]})
    built = text_index._counted(key, rows)
    got = {(r["field"], r["term"]): (r["block"], r["n_docs"], r["most_tf"], r["least_n"], r["ids"], r["tfs"], r["ns"]) for r in built.to_pylist()}
    assert got == {("a", "x"): (3, 2, 2, 1, [2, 7], [1, 2], [1, 3]), ("a", "y"): (3, 1, 1, 3, [7], [1], [3]), ("b", "y"): (3, 1, 1, 1, [7], [1], [1])}
    assert text_index._counted(key, rows.slice(0, 0)).num_rows == 0 and text_index._counted(key, rows.slice(3)).num_rows == 0
    old = pa.concat_tables([built.append_column("segment", pa.array([s] * 3)) for s in (0, 1)])
    live = text_index._alive(key, old, pa.table({"doc_id": [9, 7, 2], "segment": [1, 1, 0]}))
    assert sorted(map(str, live.to_pylist())) == sorted(map(str, built.to_pylist()))
    assert text_index._alive(key, old.slice(0, 0), pa.table({"doc_id": pa.array([9]), "segment": pa.array([1])})).num_rows == 0


def test_postings_pass_through_their_parts(monkeypatch):
    """Rows of postings, packed by a task, unpacked by another: the same rows, each in its term's bucket; rows of one
    key become one, across batches too."""
    import pyarrow as pa

    monkeypatch.setattr(text_index, "ROWS", 5)
    key = lambda block: (pa.scalar(block, pa.int32()),)
    words = [["x", "y", "x"], ["x", "é"], [], ["y"]]
    docs = lambda first: pa.table({"doc_id": [first + i for i in range(4)], "tokens_0": words, "tokens_1": words[::-1]}, schema=pa.schema({"doc_id": pa.int64(), "tokens_0": pa.list_(pa.string()), "tokens_1": pa.list_(pa.string())}))
    built = [text_index._inverted(["a", "b"])(key(block), docs(first)) for block, first in ((3, 10), (4, 20), (3, 0))]
    packed = [b for b in text_index._packed(2)(x for t in built for x in t.to_batches(max_chunksize=2))]
    assert len(packed) > 2 and {p for b in packed for p in b["part"].to_pylist()} <= {0, 1}
    rows = [r for b in text_index._unpacked(7)(iter(packed)) for r in b.to_pylist()]
    own = lambda r: (r["field"], r["term"], r["block"], r["n_docs"], r["most_tf"], r["least_n"], r["ids"], r["tfs"], r["ns"])
    assert sorted(map(own, rows)) == sorted(own(r) for t in built for r in t.to_pylist())
    assert all(r["segment"] == 7 and r["bucket"] == text_index._hash(r["term"]) % text_index.BUCKETS for r in rows)
    place = lambda r: (r["field"], r["term"], r["block"])
    joined = [r for size in (1, 3, 50) for b in text_index._joined(iter(pa.Table.from_pylist(sorted(rows, key=place), schema=next(text_index._unpacked(7)(iter(packed))).schema).to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert len(joined) == 3 * len({place(r) for r in rows}) and {r["ids"] == sorted(r["ids"]) for r in joined} == {True}
    x = next(r for r in joined if place(r) == ("a", "x", 3))
    assert (x["n_docs"], x["most_tf"], x["least_n"], x["ids"], x["tfs"], x["ns"]) == (4, 2, 2, [0, 1, 10, 11], [2, 1, 2, 1], [3, 2, 3, 2])


def test_text_index_shuffles_texts_and_compressed_postings(spark, tmp_path, monkeypatch):
    """Neither tokens nor rows of postings are shuffled or stored on the way, and a merge sends what no one has replaced
    straight to its bucket, one row for a term and block. Bytes shuffled stay under those of the texts."""
    from timelode.sources.storage import stored

    monkeypatch.setattr(text_index, "BLOCK", 64)
    monkeypatch.setattr(text_index, "TOKENS", 20_000, raising=False)
    labels, rng, path = [], np.random.default_rng(4), f"file://{tmp_path}/index"
    monkeypatch.setattr(text_index, "stored", lambda df, label: labels.append(label) or stored(df, label))
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda: " ".join(rng.choice(vocabulary, 150))
    rows = [(i, words()) for i in range(1024)]
    size, began = sum(len(t) for _, t in rows), shuffled()
    for some in (rows[:512], rows[512:]):
        text_index.add(spark.createDataFrame(some, "doc_id long, caption string"), ["caption"], path)
    added = shuffled()
    assert added - began < 2 * size and "text-tokens" not in labels, (added - began, size)
    new = text_index.merge(spark, path)
    merged = shuffled()
    assert merged - added < 1.5 * size, (merged - added, size)
    kept = spark.read.parquet(f"{path}/postings").where(f"segment = {new}")
    assert kept.count() == kept.select("term", "block").distinct().count()
    assert kept.selectExpr("sum(n_docs)").first()[0] == sum(len(set(t.split())) for _, t in rows)
    got = [(r["doc_id"], r["score"]) for r in text_index.search(spark, path, "caption", ["w5", "w9"], 20).collect()]
    want = bm25_by_hand([(i, t) for i, t in rows], 1, ["w5", "w9"], 20)
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=2e-6)
