"""Rows against blocks of requests: matrix products and keywords, without a join.

A block of requests is bounded (``scoring.BLOCK_VALUES``) and goes to the tasks with the code: as one
matrix, and as one automaton over all its words. Arrow batches of rows are multiplied
with it in runs of at most ``CELLS`` products. Where only the best are wanted, a task
keeps the best of each request and passes these on; they are merged in two steps, so no row is made for a
pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelode.operators.automaton import Finder
from timelode.operators.memory import give_back, slices

CELLS, SALTS = 1_000_000, 32


class Block:
    """Requests as arrays. words: for each request, its keywords."""

    def __init__(self, requests: Sequence, kind: str | None = None) -> None:
        from timelode.functions import vectors as V

        self.ids = np.array([r.request_id for r in requests], np.int64)
        self.vectors = [V.unit(r.vector) for r in requests]
        self.weights = np.array([r.weights for r in requests], np.float64).reshape(-1, 3)
        words = [sorted(set(getattr(r, kind))) for r in requests] if kind else [[] for _ in requests]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.keys = sorted({x for w in words for x in w})
        place = {k: i for i, k in enumerate(self.keys)}
        self.users: list[list[int]] = [[] for _ in self.keys]
        for r, own in enumerate(words):
            for x in own:
                self.users[place[x]].append(r)

    def matrix(self, dim: int) -> np.ndarray:
        """dim x requests; a vector of another length has no products (not a number)."""
        none = [float("nan")] * dim
        return np.array([v if len(v) == dim else none for v in self.vectors], np.float64).reshape(-1, dim).T


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A row for each vector; null ones are not numbers."""
    out = np.full((len(column), dim), np.nan)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    out[good] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out


def _ranks(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, of whatever type these are."""
    return pc.rank(ids, tiebreaker="dense").to_numpy()


def _runs(batch: pa.RecordBatch, width: int, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of at most CELLS products, and, with a text column, of a bounded size of texts."""
    step = max(1, CELLS // max(1, width))
    for part in slices(batch, batch.schema.get_field_index(text)) if text else [batch]:
        for at in range(0, part.num_rows, step):
            yield part.slice(at, step)


def pairs(rows: DataFrame, block: Block, keep: Sequence[str], dim: int | None = None, words_weight: int | None = None) -> DataFrame:
    """rows (keep..., vector, own) -> request_id, keep..., score, part: the product with the
    request's vector (with ``dim``), and, with ``words_weight``, the share of the request's words
    that ``own`` holds, times that of its weights. Pairs that have neither are left out."""
    schema = T.StructType([T.StructField("request_id", T.LongType()), *[rows.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("part", T.DoubleType())])
    columns = [*keep, *(["vector"] if dim else []), *(["own"] if words_weight is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block.keys)
        users = [np.array(u, np.int64) for u in block.users]
        matrix = block.matrix(dim) if dim else None
        for whole in batches:
            for batch in _runs(whole, len(block.ids), None if words_weight is None else "own"):
                shape = (batch.num_rows, len(block.ids))
                score, hits = np.full(shape, np.nan), np.zeros(shape, np.int64)
                if dim:
                    score = _vectors(batch.column("vector"), dim) @ matrix
                if words_weight is not None:
                    for i, text in enumerate(batch.column("own").to_pylist()):
                        for k in finder.found(text):
                            hits[i, users[k]] += 1
                row, request = np.nonzero(~np.isnan(score) | (hits > 0))
                score, hits = score[row, request], hits[row, request]
                part = hits / np.maximum(1, block.n_words[request]) * (block.weights[request, words_weight] if words_weight is not None else 0)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[request]), *[batch.column(c).take(take) for c in keep], pa.array(score, mask=np.isnan(score)), pa.array(part, mask=hits == 0)], names=["request_id", *keep, "score", "part"]
                )
        give_back()

    return rows.select(*columns).mapInArrow(run, schema)


def best(rows: DataFrame, block: Block, dim: int, k: int, by: str | None = None) -> DataFrame:
    """rows (id, vector, and ``by``) -> request_id, by, id, score of each request's k best, for
    each value of ``by``; smaller ids first among equals. A task holds k rows for each request
    and value of a batch, or, without ``by``, for each request."""
    keep = ["id", *([by] if by else [])]
    schema = T.StructType([T.StructField("request_id", T.LongType()), *[rows.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def best_of(score: np.ndarray, group: np.ndarray, id_: np.ndarray) -> np.ndarray:
        """Places of the k best of each group."""
        order = np.lexsort((id_, -score, group))
        first = np.append(True, group[order][1:] != group[order][:-1])
        return order[np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, held = block.matrix(dim), None
        for whole in batches:
            for batch in _runs(whole, len(block.ids)):
                score = _vectors(batch.column("vector"), dim) @ matrix
                id_ = _ranks(batch.column("id"))
                kind = batch.column(by).dictionary_encode().indices.to_numpy(zero_copy_only=False) if by else np.zeros(batch.num_rows, np.int64)
                row, request = np.nonzero(~np.isnan(score))
                keep_ = best_of(score[row, request], request * (int(kind.max(initial=0)) + 1) + kind[row], id_[row])
                row, request = row[keep_], request[keep_]
                found = pa.RecordBatch.from_arrays([pa.array(block.ids[request]), *[batch.column(c).take(pa.array(row)) for c in keep], pa.array(score[row, request])], names=["request_id", *keep, "score"])
                if by:
                    yield found
                    continue
                # one list for each request, whatever the number of batches
                both = found if held is None else pa.concat_batches([held, found])
                held = both.take(pa.array(best_of(both.column("score").to_numpy(), both.column("request_id").to_numpy(), _ranks(both.column("id")))))
        if held is not None:
            yield held
        give_back()

    found = rows.select(*keep, "vector").mapInArrow(run, schema)
    order = [F.desc("score"), F.col("id")]
    own = ["request_id", *([by] if by else [])]
    some = Window.partitionBy(*own, "salt").orderBy(*order)
    few = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(*order)).cast("long")).where(F.col("rank") <= k).drop("salt")
