"""Extensions: BM25 over an inverted index, and a coarse index of vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions import vectors as V
from timelode.functions.text import TOKEN, literals
from timelode.operators.scoring import Asked
from timelode.sources.storage import stored

LEAST_VECTORS, MOST_CELLS, SAMPLE_ROWS = 128, 64, 20_000


def postings(docs: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (its tokens), term, tf. With ``terms``, other
    tokens are dropped before anything is shuffled."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({TOKEN})"))
    rows = docs.select("doc_id", tokens.alias("tokens")).withColumn("n", F.size("tokens").cast("long"))
    if terms is not None:
        counted = F.transform(literals(sorted(set(terms))), lambda t: F.struct(t.alias("term"), (F.size("tokens") - F.size(F.array_remove("tokens", t))).cast("long").alias("tf")))
        return rows.select("doc_id", "n", F.explode(counted).alias("p")).select("doc_id", "n", "p.term", "p.tf")
    return rows.select("doc_id", "n", F.explode("tokens").alias("term")).groupBy("doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, terms: Sequence[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for the terms. Each document has a row for each term, so
    one grouping by term, of as many rows, holds all corpus figures."""
    found = stored(postings(docs, terms), "bm25-postings")  # read for the figures and for the scores
    stats = found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), F.count_if(F.col("tf") > 0).alias("df"))
    weights = stats.select("term", "mean", F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    scored = found.where("tf > 0").join(F.broadcast(weights), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return scored.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


@dataclass(frozen=True)
class Cells:
    """Centres of a coarse index; cell i is of centre i."""

    centres: tuple[tuple[float, ...], ...]

    def column(self):
        return F.array(*[F.struct(F.lit(i).alias("cell"), F.array(*[F.lit(x) for x in c]).alias("centre")) for i, c in enumerate(self.centres)])


def fit_cells(frames: DataFrame, dim: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Cells | None:
    """Centres from at most ``sample_rows`` vectors, drawn by a hash of their id; None
    under LEAST_VECTORS, where a scan does."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    good = frames.where(V.valid(F.col("vector"), dim))
    sample = good.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    n = sample.count()
    if n < LEAST_VECTORS:
        return None
    model = KMeans(k=max(1, min(MOST_CELLS, n // 10)), seed=seed, maxIter=10).fit(sample)
    return Cells(tuple(tuple(float(x) for x in c) for c in model.clusterCenters()))


def _nearest_cells(vector, cells: Cells, most: int):
    apart = F.transform(cells.column(), lambda c: F.struct(F.aggregate(F.zip_with(vector, c["centre"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("d"), c["cell"].alias("cell")))
    return F.transform(F.slice(F.array_sort(apart), 1, most), lambda x: x["cell"])


def assign(frames: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """Every valid row with its cell; written partitioned by cell, a probe reads few files."""
    return frames.where(V.valid(F.col("vector"), dim)).withColumn("cell", F.get(_nearest_cells(F.col("vector"), cells, 1), F.lit(0)))


def probe(assigned: DataFrame, asked: Asked, cells: Cells, probes: int, k: int) -> DataFrame:
    """The k best of the ``probes`` nearest cells of each request."""
    wanted = asked.table().select("request_id", "q", F.explode(_nearest_cells(F.col("q"), cells, probes)).alias("cell"))
    scored = assigned.join(wanted, "cell").select("request_id", "id", V.dot(F.col("vector"), F.col("q")).alias("score"))
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
