"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with
byte fallback, which adds the space itself) reads the text, so both spell the same
bytes. All of it is NumPy over runs of ``RUN`` characters of texts: a cumulative
sum of token lengths gives the ends; ``intersect1d`` the common cuts; ``searchsorted``
each token's group and the first and last B token that an A token's bytes touch;
``repeat`` expands these ranges to links.

A run becomes one row: what its documents need, the distinct id pairs of the run
with the number of its documents that hold each, and which document holds which
pair how often (compressed). That table is written once; texts are tokenised once
and never move. Counting shuffles a row for each distinct pair of a run, first with
a salt, then without: a pair that every document holds is a row for each run, not
for each document. Counts come back the same way: pair by pair to the runs, then
one row of counts to each run.

Bounds: a run's arrays are in proportion to RUN, or to one longer text. The most
frequent pair of each A id is a table of at most as many rows as A has entries,
which is broadcast.

Defined results: null and empty texts, and texts that A or B doesn't spell byte by
byte as they are (B may normalise), have no tokens: zeros and an empty string for
the hash; special tokens' strings inside texts are plain text; texts of any length
are read whole; of equal highest counts all are best; repeated rows are documents
of their own, null ids take part; an empty table gives an empty result; only doc_id
and text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks
from .common import stored
from .packing import Encoder, default_vocabulary

RUN, SALTS = 4_000_000, 16


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = enumerate(map(self._model.id_to_piece, range(self._model.get_piece_size())))
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in names}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), np.int64)


class Both:
    """Two tokenizers and tables over their ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = Encoder(a_path, added=False), Pieces(b_path)
        self.lengths = [np.array([len(t.bytes.get(i, b"")) for i in range(max(t.bytes) + 1)]) for t in (self.a, self.b)]
        n_a, n_b = map(len, self.lengths)
        # a token as it stands in a list of groups: A tokens end in , or |, B tokens in , or ;
        self.written = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, none where they don't spell the same bytes."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        want = (" " + text).encode()
        a, b = self.a.ids(" " + text).astype(np.int64), self.b.ids(text)
        # A cuts the bytes that it is given, so the number of bytes says all; B may put others in their place
        same = self.lengths[0][a].sum() == len(want) and b"".join(map(self.b.bytes.__getitem__, b.tolist())) == want
        return (a, b) if same else (none, none)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Token ids that spell the same bytes -> each token's group, and the links
        as places of A tokens and of B tokens."""
        size_a, size_b = self.lengths[0][a], self.lengths[1][b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        first = np.searchsorted(end_b, end_a - size_a, "right")
        n = np.searchsorted(end_b, end_a) - first + 1
        left = np.repeat(np.arange(len(a)), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n - first, n)
        return np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), left, right

    def in_groups(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
        """Places in ``written`` of all tokens: a group's A tokens, then its B tokens."""
        n_a, n_b = map(len, self.lengths)
        groups = int(group_a[-1]) + 1 if len(a) else 0
        of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        last_a = np.append(group_a[1:] != group_a[:-1], np.ones(min(1, len(a)), bool))
        last_b = np.append(group_b[1:] != group_b[:-1], np.ones(min(1, len(b)), bool))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]] = a + n_a * last_a
        out[np.arange(len(b)) + np.cumsum(of_a)[group_b]] = 2 * n_a + b + n_b * last_b
        return out


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
ROWS = "run long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>, pair array<long>, held array<long>, n_own long, own binary, times binary"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.int64)


def aligned_run(both: Both, texts: list[str | None]) -> dict[str, object]:
    """What a run of texts adds to ``ROWS``. own: sorted differences of document x
    number of pairs + pair, one value for each pair of a document."""
    ids = [both.tokens(t) for t in texts]
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
    group_a, group_b, left, right = both.align(a, b)
    order, ends = both.in_groups(a, b, group_a, group_b), np.cumsum(n_a + n_b)
    sha = []
    for lo, hi in zip((ends - n_a - n_b).tolist(), ends.tolist(), strict=True):
        text = "".join(map(both.written.__getitem__, order[lo:hi].tolist()))[:-1]
        sha.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
    doc = np.repeat(np.arange(len(texts)), n_a)
    starts = np.append(np.ones(min(1, len(a)), bool), group_a[1:] != group_a[:-1])
    pair, at = np.unique(a[left] << 32 | b[right], return_inverse=True)
    own, times = np.unique(doc[left] * max(1, len(pair)) + at, return_counts=True)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc[starts], minlength=len(texts)), "n_links": np.bincount(doc[left], minlength=len(texts)), "groups_sha256": sha,
        "pair": pair, "held": np.bincount(own % max(1, len(pair)), minlength=len(pair)), "n_own": len(own), "own": _packed(np.diff(own, prepend=0)), "times": _packed(times.astype(np.int64)),
    }


def runs(docs: DataFrame, a_path: str, b_path: str, run: int = RUN) -> DataFrame:
    """docs (doc_id, text) -> a row of ``ROWS`` for each run of texts."""
    names = [part.split()[0] for part in ROWS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, made = Both(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for lo, hi in chunks([t or "" for t in texts], run):
                row = {"run": made, "doc_id": doc_ids[lo:hi].to_pylist()} | aligned_run(both, texts[lo:hi])
                made += 1
                kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], kind) for n, kind in zip(names, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ROWS)


def pair_counts(found: DataFrame, salts: int = SALTS) -> DataFrame:
    """runs -> pair, a_id, b_id, count (documents that hold the two ids linked), best
    (whether no pair of the A id has a higher count)."""
    each = found.select(F.pmod(F.xxhash64("run"), F.lit(salts)).alias("salt"), F.explode(F.arrays_zip("pair", "held")).alias("p"))
    part = each.select("salt", "p.pair", "p.held").groupBy("pair", "salt").agg(F.sum("held").alias("held"))
    counts = part.groupBy("pair").agg(F.sum("held").alias("count"))
    counts = stored(counts.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "count"), "align-counts")
    highest = counts.groupBy("a_id").agg(F.max("count").alias("highest"))  # a row for each entry of A's vocabulary at most
    return counts.join(F.broadcast(highest), "a_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, run: int = RUN) -> DataFrame:
    """One row for each row of docs: ``RESULT``."""
    found = stored(runs(docs, a_path or default_vocabulary(), b_path or default_pieces(), run), "align-runs")
    counts = pair_counts(found)
    asked = found.select("run", F.posexplode("pair").alias("at", "pair")).join(counts, "pair")
    told = asked.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("told"))
    whole = found.select("run", "doc_id", *COUNTS, "groups_sha256", "n_own", "own", "times").join(told, "run", "left")
    whole = whole.select("doc_id", *COUNTS, "groups_sha256", "n_own", "own", "times", F.col("told.count").alias("count"), F.col("told.best").alias("best"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                docs_in = len(row["doc_id"])
                columns = {"doc_id": row["doc_id"].values} | {n: row[n].values for n in COUNTS}
                n_best = total = np.zeros(docs_in, np.int64)
                if row["count"].is_valid:
                    count, best = row["count"].values.to_numpy(zero_copy_only=False), row["best"].values.to_numpy(zero_copy_only=False)
                    own, times = (_unpacked(row[k].as_py(), row["n_own"].as_py()) for k in ("own", "times"))
                    own = np.cumsum(own)
                    doc, at = own // len(count), own % len(count)
                    n_best, total = np.zeros(docs_in, np.int64), np.zeros(docs_in, np.int64)
                    np.add.at(n_best, doc, times * best[at])
                    np.add.at(total, doc, times * count[at])
                columns |= {"n_best": pa.array(n_best), "count_sum": pa.array(total), "groups_sha256": row["groups_sha256"].values}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return whole.mapInArrow(work, RESULT)


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The alignment itself, for each row of docs: token ids of both, each token's
    group, and the links as places in the two lists."""
    a_path, b_path = a_path or default_vocabulary(), b_path or default_pieces()
    names = ["a_ids", "b_ids", "a_groups", "b_groups", "a_links", "b_links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Both(a_path, b_path)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                a, b = both.tokens(text)
                arrays = [pa.array([x], pa.list_(pa.int64())) for x in (a, b, *both.align(a, b))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i : i + 1], *arrays], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, " + ", ".join(f"{n} array<long>" for n in names))
