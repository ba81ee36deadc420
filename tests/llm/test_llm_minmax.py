"""op13 against all pairs, and what holds groups together."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timelode.llm import connect, minmax_dedup, ngram_join
from timelode.llm.shingles import min_max_hash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 85 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    low = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    return sorted([(repr(d), len(s), low[g], d == low[g]) for (d, _), s, g in zip(rows, sets, group, strict=True)], key=repr)


def got(docs, **more):
    return sorted([(repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs, **more).collect()], key=repr)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [5, 96])
def test_all_pairs(spark, block):
    """Chains, stars and lone texts, in blocks of few and of many."""
    rng = random.Random(3)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    rows, base = [], prose(150)
    for i in range(70):  # each a little further from the first: links hold it together, few meet the pivots
        base = edited(rng, base, 0.012)
        rows.append((i * 7 % 71, " ".join(base)))
    star = prose(200)
    rows += [(100 + i, " ".join(edited(rng, star, 0.01))) for i in range(60)]
    rows += [(200 + i, " ".join(prose(rng.randint(0, 60)))) for i in range(40)]
    for m in (20, 17, 40):  # m shingles of which m - k are shared, around the threshold
        one = prose(m + 4)
        rows += [(300 + 10 * m + k, " ".join(one[: m + 4 - k] + prose(k))) for k in range(5)]
    rows += [(None, rows[3][1].upper()), (None, None), (900, None), (901, ""), (902, " \t"), (903, "Two words"), (904, "two  WORDS"), (905, "É two"), (906, "é two"), (3, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, key long").repartition(5)
    assert got(docs, block=block) == expected(rows)


def test_odd_rows(odd, none):
    assert got(odd) == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert minmax_dedup.near_duplicates(none).collect() == []
    with pytest.raises(ValueError):
        minmax_dedup.near_duplicates(none, percent=50)


def test_min_max_estimates():
    """Unbiased, from 90 functions with about the variance of 180 independent minima."""
    rng = np.random.default_rng(5)
    off = []
    for seed in range(500):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        values = min_max_hash([np.unique(pool[:270]), np.unique(pool[30:])], 90, seed)
        off.append((values[0] == values[1]).mean() - 0.8)
    assert abs(np.mean(off)) < 0.005 and np.var(off) < 1.25 * 0.8 * 0.2 / 180
    assert minmax_dedup.least_equal() == 126


def test_work_on_a_large_group(spark):
    """20,000 members that hold together: an edge or so a member, few pairs looked at."""
    n = 20_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.unhex(F.md5(F.col("id").cast("string"))).alias("fp"), F.lit(180).cast("long").alias("held"), "id")
    looked = spark.sparkContext.accumulator(0)

    def test(frame: pd.DataFrame):
        ids = frame["id"].to_numpy()

        def near(left, right):
            looked.add(len(left))
            return np.flatnonzero((ids[left] + ids[right]) % 10 != 0)  # not every pair

        return near

    found = connect.connected(rows.drop("id"), lambda x: x.join(rows.select("fp", "id"), "fp"), test)
    assert found.select("node").distinct().count() == n and found.select("root").distinct().count() == 1
    assert looked.value < 100 * n, looked.value / n  # all pairs would be 10,000 a member


def test_families_of_near_copies(spark):
    """What op2 passes on of a bucket: an edge or so a member and band, many of them the same."""
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(edited(rng, base, 0.004))) for i in range(1500)], "doc_id long, text string")
    classes = ngram_join.sketch(docs.withColumn("row_", F.col("doc_id"))).dropDuplicates(["fp"]).select("fp", "sig", "bands").cache()
    n, held = classes.count(), ngram_join.families(classes)
    assert held.count() == n and held.select("root").distinct().count() == 1
