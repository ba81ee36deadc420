"""Product-quantised index of vectors: coarse cells, byte codes of residuals, re-ranking.

Fitted on a bounded sample, applied to every vector. A vector's nearest centre is
its cell; what is left of it is cut into ``PARTS`` sub-vectors, each coded by the nearest
of at most 256 entries of a codebook: 16 bytes a vector. Stored are the codes and the
vectors, both partitioned by cell, so a search reads the folders of its cells.

How many cells a request must probe is measured: of up to ``ASKED`` vectors of the sample, the
least number of nearest cells that hold ``REACH`` of their ten nearest neighbours. (The
whole set is denser, its neighbours are nearer, so it needs no more.)

A search is a join of blocks, without a row for a pair of request and vector: requests
go to their nearest cells; in a cell, blocks of ``CODES`` codes meet blocks of
``REQUESTS`` requests, so a cell that holds a third of all vectors is many units of
work. A unit looks a request's products with all codebook entries up by code and
passes on its best only. These are merged for each request, and ``REFINE`` times as many as
asked for are compared by their whole vectors.

Scores are inner products (of vectors of length 1: cosines). Vectors that are null or of
another dimension are in no cell; requests likewise have no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.functions import vectors as V
from timelode.sources.storage import stored

SAMPLE_ROWS, PARTS, ENTRIES, MOST_CELLS, ROUNDS = 20_000, 16, 256, 1024, 12
REFINE, CODES, REQUESTS = 8, 65_536, 512
ASKED, REACH = 200, 0.97


@dataclass(frozen=True)
class Quantiser:
    """centres: cells x dim; codebooks: parts x entries x (dim / parts); probes: cells
    that a request needs."""

    centres: np.ndarray
    codebooks: np.ndarray
    probes: int = 1

    def nearest(self, vectors: np.ndarray, most: int = 1) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        far = (self.centres**2).sum(1) - 2 * vectors @ self.centres.T
        return np.argsort(far, 1, kind="stable")[:, :most]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its codes."""
        cell = self.nearest(vectors)[:, 0]
        left = (vectors - self.centres[cell]).reshape(len(vectors), len(self.codebooks), -1)
        codes = np.empty(left.shape[:2], np.uint8)
        for p, book in enumerate(self.codebooks):
            codes[:, p] = np.argmin((book**2).sum(1) - 2 * left[:, p] @ book.T, 1)
        return cell, codes

    def scores(self, requests: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, requests x codes: the centre's and, part by part,
        what a table holds for the code."""
        out = np.repeat((requests @ self.centres[cell])[:, None], len(codes), 1)
        parts = requests.reshape(len(requests), len(self.codebooks), -1)
        for p, book in enumerate(self.codebooks):
            out += (parts[:, p] @ book.T)[:, codes[:, p]]
        return out


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes the point that is furthest off."""
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * points @ centres.T
        near = np.argmin(far, 1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            off = ((points - centres[near]) ** 2).sum(1)
            centres[empty] = points[np.argsort(-off, kind="stable")[: len(empty)]]
    return centres


def _probes(points: np.ndarray, bare: Quantiser, k: int = 10) -> int:
    """The least number of cells that hold REACH of the k nearest neighbours."""
    asked = points[:: max(1, len(points) // ASKED)][:ASKED]
    k = min(k + 1, len(points))  # with itself
    near = np.argpartition(-(asked @ points.T), k - 1, 1)[:, :k]
    order = np.argsort(bare.nearest(asked, len(bare.centres)), 1)  # the place of each cell
    cell = bare.nearest(points)[:, 0]
    places = np.sort(np.take_along_axis(order, cell[near], 1).ravel())
    return int(places[int(np.ceil(REACH * len(places))) - 1]) + 1


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit(frames: DataFrame, dim: int, cells: int | None = None, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Quantiser:
    """frames (id, vector). At most ``sample_rows`` vectors, drawn by a hash of their
    id, place the centres (in one task) and the codebooks (a task for each part)."""
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} dimensions")
    sample = frames.where(V.valid(F.col("vector"), dim)).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(F.col("vector").cast("array<double>").alias("vector"))

    def place(rows: pa.Table) -> pa.Table:
        points = _matrix(rows["vector"], dim)
        k = cells or min(MOST_CELLS, max(1, int(4 * len(points) ** 0.5)), max(1, len(points) // 8))
        centres = _means(points, min(k, len(points)), np.random.default_rng(seed))
        bare = Quantiser(centres, np.zeros((0, 0, 0)))
        left = points - centres[bare.nearest(points)[:, 0]]
        return pa.table({"centres": [centres.ravel()], "left": [left.ravel()], "probes": [_probes(points, bare)]})

    first = sample.groupBy().applyInArrow(place, "centres array<double>, left array<double>, probes long").first()
    if first is None:
        raise ValueError("no vector to fit the index on")
    centres = np.array(first["centres"]).reshape(-1, dim)
    left = np.array(first["left"]).reshape(-1, parts, dim // parts)

    def book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("part").to_pylist():
                entries = _means(left[:, p], min(ENTRIES, len(left)), np.random.default_rng(seed + 1 + p))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([entries.ravel()], pa.list_(pa.float64()))], names=["part", "entries"])

    spark = frames.sparkSession
    books = spark.range(0, parts, 1, parts).withColumnRenamed("id", "part").mapInArrow(book, "part long, entries array<double>").collect()
    return Quantiser(centres, np.stack([np.array(r["entries"]).reshape(-1, dim // parts) for r in sorted(books, key=lambda r: r["part"])]), first["probes"])


def build(frames: DataFrame, quantiser: Quantiser, dim: int, path: str) -> None:
    """Writes <path>/codes and <path>/vectors, partitioned by cell, and <path>/quantiser."""
    good = frames.where(V.valid(F.col("vector"), dim)).select("id", F.col("vector").cast("array<float>").alias("vector"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes = quantiser.encode(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vector")], names=["id", "cell", "code", "vector"])

    kind = good.schema["id"].dataType.simpleString()
    whole = good.mapInArrow(encode, f"id {kind}, cell int, code binary, vector array<float>")
    # cells vary in size: a large one is spread over tasks, a small one is in one file
    dealt = whole.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.select("cell", "id", "vector").write.partitionBy("cell").parquet(f"{path}/vectors")
    again = frames.sparkSession.read.parquet(f"{path}/vectors").select("id", "vector")
    again.mapInArrow(encode, f"id {kind}, cell int, code binary, vector array<float>").select("cell", "id", "code").write.partitionBy("cell").parquet(f"{path}/codes")
    row = (quantiser.centres.shape[1], len(quantiser.codebooks), quantiser.probes, quantiser.centres.ravel().tolist(), quantiser.codebooks.ravel().tolist())
    frames.sparkSession.createDataFrame([row], "dim int, parts int, probes int, centres array<double>, codebooks array<double>").write.parquet(f"{path}/quantiser")


def load(spark: SparkSession, path: str) -> Quantiser:
    row = spark.read.parquet(f"{path}/quantiser").first()
    return Quantiser(np.array(row["centres"]).reshape(-1, row["dim"]), np.array(row["codebooks"]).reshape(row["parts"], -1, row["dim"] // row["parts"]), row["probes"])


def search(path: str, requests: DataFrame, dim: int, k: int, probes: int | None = None, refine: int = REFINE) -> DataFrame:
    """requests (request_id, q) -> request_id, id, rank (from 1), score of the k best.
    probes: cells for each request (default: as many as were found to do)."""
    spark = requests.sparkSession
    quantiser = load(spark, path)
    probes = probes or quantiser.probes
    wanted = k * refine

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = quantiser.nearest(_matrix(batch.column("q"), dim), probes)
            take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column("q").take(take), pa.array(near.ravel().astype(np.int32))], names=["request_id", "q", "cell"])

    good = stored(requests.where(V.valid(F.col("q"), dim)).select("request_id", F.col("q").cast("array<double>").alias("q")), "requests")
    asking = good.schema["request_id"].dataType.simpleString()
    asked = good.mapInArrow(probe, f"request_id {asking}, q array<double>, cell int")
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # as many as there are centres, at most
    codes = spark.read.parquet(f"{path}/codes").where(F.col("cell").isin(cells))
    kind = codes.schema["id"].dataType.simpleString()
    # each block of a cell's codes meets each block of its requests; the tables of sizes have a row a cell
    blocks = codes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CODES).cast("int").alias("code_blocks"))
    turns = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).cast("int").alias("request_blocks"))
    sizes = F.broadcast(blocks.join(turns, "cell"))
    left = codes.join(sizes, "cell").withColumn("c", F.pmod(F.xxhash64("id"), F.col("code_blocks")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("request_blocks") - 1)))
    right = asked.join(sizes, "cell").withColumn("r", F.pmod(F.xxhash64("request_id"), F.col("request_blocks")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("code_blocks") - 1)))

    def meet(key: tuple, own: pa.Table, some: pa.Table) -> pa.Table:
        ids = own["id"].combine_chunks()
        bytes_ = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        names, found, values = [], [], []
        q = _matrix(some["q"], dim) if len(some) else np.zeros((0, dim))
        for lo in range(0, len(q), 64):  # scores are requests x codes: a few MB at a time
            score = quantiser.scores(q[lo : lo + 64], key[0].as_py(), bytes_)
            n = min(wanted, score.shape[1])
            best = np.argpartition(-score, n - 1, 1)[:, :n] if n else np.zeros((len(score), 0), int)
            names.append(np.repeat(np.arange(lo, lo + len(score)), n))
            found.append(best.ravel())
            values.append(np.take_along_axis(score, best, 1).ravel())
        whole = [np.concatenate(x) if x else np.zeros(0) for x in (names, found, values)]
        return pa.table({"request_id": some["request_id"].combine_chunks().take(pa.array(whole[0].astype(np.int64))), "id": ids.take(pa.array(whole[1].astype(np.int64))), "about": pa.array(whole[2])})

    left, right = left.select("cell", "c", "r", "id", "code"), right.select("cell", "c", "r", "request_id", "q")
    met = left.groupBy("cell", "c", "r").cogroup(right.groupBy("cell", "c", "r")).applyInArrow(meet, f"request_id {asking}, id {kind}, about double")
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("about"), "id"))).where(F.col("place") <= wanted)
    vectors = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(cells)).select("id", "vector")
    exact = first.select("request_id", "id").join(vectors, "id").join(good, "request_id").select("request_id", "id", F.round(V.dot(F.col("vector"), F.col("q")), 9).alias("score"))
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("request_id", "id", "rank", "score")
