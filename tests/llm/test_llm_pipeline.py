"""The pipeline's stages against brute force, each on its own input."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import base_figures, shingles

import corpus_pipeline
from timelode.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found = stored(stage(spark, docs, sf_dir), f"test-{name}")
        out.append((docs, found))
        docs = found
    return out


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "mixing", "packing"]
    assert all(found.columns == docs.columns for docs, found in steps[:-1])


def test_quality(steps):
    docs, found = steps[0]
    assert 0 < found.count() < docs.count()
    assert not any(base_figures(r.text)[-1] for r in found.collect())


def test_exact(steps):
    docs, found = steps[1]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in found.collect()} == {min(g)[1] for g in groups.values()}


def test_near(steps):
    docs, found = steps[2]
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    group = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if j < i and a and b and len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {r.doc_id for r in found.collect()} == set(group.values())


def test_mix_takes_whole_rows(steps):
    docs, found = steps[3]
    given, taken = ({r.doc_id: r for r in d.collect()} for d in (docs, found))
    assert all(given[i] == r for i, r in taken.items())
    assert max(Counter(r.doc_id for r in found.collect()).values()) <= 3


def test_pack_covers_every_row(steps):
    docs, found = steps[4]
    rows = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in found.where("start = 0").collect()) == rows
    assert found.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_run_agrees_with_the_stages(spark, steps):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, found.select(*key).collect())) == Counter(map(tuple, steps[-1][1].select(*key).collect()))
