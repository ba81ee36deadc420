"""Components of random graphs, chains and hubs."""

import random

import pytest

from timelode.llm import graph


@pytest.mark.parametrize("one_task", [0, 20, 1_000_000])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components(spark, one_task, kind):
    rng = random.Random(one_task)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 501 + i) for i in range(80)] + [(7, 7), (900, 901), (901, 900)]
    name = (lambda x: x) if kind == "long" else (lambda x: x.to_bytes(2, "big"))
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            low = min(root[a], root[b])
            root[a] = root[b] = low
    joined = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(4)
    got = sorted((bytes(r.node) if kind == "binary" else r.node, bytes(r.root) if kind == "binary" else r.root) for r in graph.components(df, one_task).collect())
    assert got == sorted((name(x), name(root[x])) for x in joined)


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([], "a long, b long"), 0).collect() == []
