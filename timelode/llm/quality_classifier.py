"""Quality by hierarchical empirical Bayes.

A logistic classifier, trained on a bounded sample of labelled documents
(``sample_rows``), gives each document's own evidence. Grouped aggregation
turns the evidence of all documents into posteriors: a path's mean is shrunk
toward its host's posterior, a host's mean toward the corpus mean. How strongly
follows from variance components by the method of moments, from counts, sums and
sums of squares over all groups: the spread of documents within their paths, of
paths about their host, of hosts about the corpus. A level's prior counts as
many documents as the first spread is larger than its own. A document's quality
adds to its own log odds those of its path over the corpus's.

Sums are partial before they are shuffled, so a host with a third of all rows is
one row from each task; they are sums of whole numbers, so their order changes
nothing. Group posteriors return by an equi-join, whose hot keys Spark may split;
it broadcasts them only under its own size limit.

Defined results: a null or empty text has the features of an empty text and is
never kept (``MIN_WORDS``); a quality of exactly the threshold is kept; null hosts
and paths are groups like others; repeated rows count as rows; texts of any length
are read whole; an empty table gives an empty result; without labels of both kinds
the default weights hold; other columns are not read and never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

SAMPLE_ROWS = 5000
MIN_WORDS = 3
#: Evidence in whole millionths; the least and most documents that a prior counts as.
UNIT, LEAST_STRENGTH, MOST_STRENGTH = 1_000_000, 1.0, 1e4
FEATURES = ("bias", "symbols", "upper", "shouts", "pipes", "word_length", "repeats", "sameness", "log_words")


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]


#: Used where labels can't train a model, and the mean of the weights' prior.
DEFAULT = Model((4.0, -20.0, -5.0, -10.0, -10.0, 0.0, -6.0, -6.0, 0.0))


def features(text: Column) -> list[Column]:
    """Shares of symbols, capitals, exclamation marks, pipes, mean word length, the
    share of lines that repeat an earlier line, how far the text is from words that
    are all different (on a log scale), words."""
    text = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    own = F.array_remove(F.split(text, SPACE + "+"), "")
    words = F.greatest(F.lit(1.0), F.size(own).cast("double"))
    different = F.greatest(F.lit(1.0), F.size(F.array_distinct(own)).cast("double"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return [
        F.lit(1.0),
        F.least(F.lit(2.0), count(r"[#*$%&<>~^{}\\=_\[\]]") / words) / 2,
        count(r"[A-Z]") / F.greatest(F.lit(1.0), F.length(text)),
        F.least(F.lit(1.0), count(r"!") / words),
        F.least(F.lit(1.0), count(r"\|") / words),
        F.least(F.lit(2.0), (F.length(text) - count(SPACE)) / words / 10),
        1 - F.size(F.array_distinct(lines)) / F.greatest(F.lit(1), F.size(lines)),
        F.when(words > 1, 1 - F.ln(different) / F.ln(words)).otherwise(0.0),
        F.ln(words) / 8,
    ]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, ridge: float = 1.0) -> Model:
    """Newton steps on the labelled sample, drawn by a hash of the id; a Gaussian
    prior about ``DEFAULT``."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", F.array(*features(F.col("text"))).alias("x"), F.xxhash64("text").alias("key"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "key", "x").limit(sample_rows).toPandas()
    if sample.empty or sample.quality.nunique() < 2:
        return DEFAULT
    x, y = np.stack(sample["x"].to_numpy()).astype(float), sample["quality"].to_numpy(float)
    prior = np.array(DEFAULT.weights)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return Model(tuple(round(float(v), 9) for v in w))


def _logit(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.ln(p / (1 - p))


@dataclass(frozen=True)
class Spread:
    """The corpus mean and the strengths of the priors of hosts and of paths."""

    mean: float
    of_host: float
    of_path: float


def spread(paths: DataFrame) -> Spread:
    """paths (host, path, n, s, ss: count, sum and sum of squares of the evidence in
    ``UNIT``) -> variance components of the nested groups. One row reaches the driver."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.pow("s", F.lit(2)) / F.col("n")).alias("of_paths"))
    n = F.col("n").cast("double")
    row = hosts.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").cast("double").alias("ss"), F.sum("k").alias("paths"), F.count(F.lit(1)).alias("hosts"),
        F.sum("of_paths").alias("of_paths"), F.sum(F.pow("s", F.lit(2)) / n).alias("of_hosts"),
        F.sum("nn").cast("double").alias("path_nn"), F.sum(F.col("nn") / n).alias("nested_nn"), F.sum(n * n).alias("host_nn"),
    ).first()
    if not row["n"]:
        return Spread(0.5, MOST_STRENGTH, MOST_STRENGTH)
    total, mean = float(row["n"]), row["s"] / UNIT / row["n"]
    of_all = float(row["s"]) ** 2 / total
    squares = {k: v / UNIT**2 for k, v in {"within": row["ss"] - row["of_paths"], "paths": row["of_paths"] - row["of_hosts"], "hosts": row["of_hosts"] - of_all}.items()}
    within = squares["within"] / (total - row["paths"]) if total > row["paths"] else mean * (1 - mean)
    of_paths = (squares["paths"] - (row["paths"] - row["hosts"]) * within) / max(1e-9, total - row["nested_nn"])
    of_paths = max(0.0, of_paths)
    mixed = row["nested_nn"] - row["path_nn"] / total
    of_hosts = (squares["hosts"] - (row["hosts"] - 1) * within - mixed * of_paths) / max(1e-9, total - row["host_nn"] / total)
    strength = lambda between: float(min(MOST_STRENGTH, max(LEAST_STRENGTH, within / between))) if between > 1e-9 else MOST_STRENGTH
    return Spread(float(min(1 - 1e-6, max(1e-6, mean))), strength(of_hosts), strength(of_paths))


def classify(docs: DataFrame, model: Model, host: Column, path: Column, weight: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: doc_id, host, path, evidence (its own
    probability), host_posterior, path_posterior, quality, kept. weight: of the
    path's log odds beside the document's own."""
    linear = sum((x * w for x, w in zip(features(F.col("text")), model.weights, strict=True)), F.lit(0.0))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    evidence = (1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), linear))))).alias("evidence")
    rows = stored(docs.select("doc_id", host.alias("host"), path.alias("path"), words.cast("long").alias("n_words"), evidence), "quality-evidence")
    whole = F.round(F.col("evidence") * UNIT).cast("long")
    sums = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("s"), F.sum((whole * whole).cast("decimal(38,0)")).alias("ss"))
    paths = stored(sums, "quality-paths")
    found = spread(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts = hosts.select(F.col("host").alias("host_"), ((F.col("s") / UNIT + found.of_host * found.mean) / (F.col("n") + found.of_host)).alias("host_posterior"))
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["host_"]))
    paths = paths.select("host_", F.col("path").alias("path_"), "host_posterior", ((F.col("s") / UNIT + found.of_path * F.col("host_posterior")) / (F.col("n") + found.of_path)).alias("path_posterior"))
    rows = rows.join(paths, rows["host"].eqNullSafe(paths["host_"]) & rows["path"].eqNullSafe(paths["path_"]))
    odds = _logit(F.col("evidence")) + weight * (_logit(F.col("path_posterior")) - _logit(F.lit(found.mean)))
    quality = 1 / (1 + F.exp(-odds))
    rows = rows.withColumn("quality", quality)
    kept = (F.col("quality") >= threshold) & (F.col("n_words") >= MIN_WORDS)
    return rows.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", kept.alias("kept"))
