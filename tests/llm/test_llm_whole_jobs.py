"""Cases that a shorter version of an operator got wrong."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm_operators import shingles

from timelode.llm import mixing, ngram_join, packing, pii


# 1
def test_each_source_lands_with_its_largest(spark):
    """A source's size decides nothing about its neighbours, and the largest documents land last."""
    rng = np.random.default_rng(11)
    rows = [(s, int(n)) for s, many in (("a", 60), ("b", 700), ("c", 100), ("d", 900)) for n in rng.lognormal(5, 1, many)]
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, words long")
    got = mixing.mix(docs, block=100, size=F.col("words")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) <= 8 for r in got), got


# 5
@pytest.mark.parametrize("text", ["end <|endoftext|> next", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n b <|endof text|> <|endoftext", "x <|endoftext|> " + " " * 1_500_000 + "y"])
def test_added_tokens_in_texts(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0]
    assert 50256 in ids
    assert [*packing.Encoder(packing.default_vocabulary()).ids(text).tolist(), 0] == ids
    if len(ids) <= 2048:
        row = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# 8
def test_frequent_patterns_keep_their_weight():
    """The classifier of a corpus repeated many times is the classifier of the corpus."""
    rng = np.random.default_rng(3)
    votes = [f"{a},{b},{c},{share},{size}" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (0, 1) for share in range(6) for size in range(5)]
    patterns = pd.DataFrame([(k, v) for k in range(8) for v in votes if rng.uniform() < 0.12], columns=["kind", "pattern"])
    patterns["n"] = 100 * np.ceil(rng.lognormal(3, 3, len(patterns))).astype(int)

    def taken(times):
        weights = pii.train(patterns.assign(n=patterns["n"] * times))
        return {(k, p) for k, p in zip(patterns["kind"], patterns["pattern"], strict=True) if pii._vector(k, p) @ weights >= 0}

    assert taken(1) == taken(100) == taken(1_000_000)


# pipeline
def test_one_row_of_each_class_stays(odd, spark):
    """On repeated and null ids too: kept is one row a class, and nothing else goes."""
    other = "an unrelated text with an id that a near copy has as well as six others"
    clash = [(5, other, "en", "s1", 1, 1, True, 1, "x", 1), (None, other + " end", "en", "s1", 1, 1, True, 1, "x", 1)]
    docs = odd.unionByName(spark.createDataFrame(clash, odd.schema))
    rows = [(shingles(r.text), r) for r in docs.collect()]
    group = list(range(len(rows)))
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    ids = lambda k: (rows[k][1].doc_id is None, rows[k][1].doc_id or 0)
    best = {g: min(ids(k) for k in range(len(rows)) if group[k] == g) for g in group}
    kept = ngram_join.kept_rows(docs).collect()
    assert len(kept) == len(best)
    place = {(r.doc_id, r.text): g for (_, r), g in zip(rows, group, strict=True)}
    full = Counter(place[r.doc_id, r.text] for r in kept if shingles(r.text))
    assert set(full.values()) == {1}
    assert all((r.doc_id is None, r.doc_id or 0) == best[place[r.doc_id, r.text]] for r in kept if shingles(r.text))
    assert not Counter(r for r in kept) - Counter(r for _, r in rows)
