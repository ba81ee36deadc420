"""A stored inverted index of text columns, kept up to date by increments.

An index is a folder of segments. ``add`` writes one for a batch of documents: documents are
dealt by a hash to blocks of about ``BLOCK``; for each field, term and block there is one
row of postings (ids, counts, lengths) with its maxima, in the folder of the term's
bucket. A block is counted and inverted in one task, so what is shuffled is texts by block, as they
are, and rows of postings, compressed by the task that they go to: no tokens, no row for a document's
term. Newer segments take the place of documents that older ones hold, so a changed
text is added again. ``merge`` writes all segments as one: postings of blocks without a document
that has been replaced go straight to their bucket, those of others by way of their block.

``search`` reads the buckets of its terms only, in two steps. The first reads maxima, not
postings: the largest share that a block can have of a term is that of its largest
count in its shortest text, and a block's bound is the sum over the terms. The blocks
of highest bounds are scored, which gives a k-th best score; then those blocks alone
whose bound reaches it. The result is that of scoring every document.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.functions.text import TOKEN
from timelode.operators.memory import give_back
from timelode.sources.storage import shared_path, stored

BLOCK, BUCKETS, FIRST = 1024, 64, 4
#: Tokens whose postings are sorted in one task, at most; rows and bytes of postings that are compressed together.
TOKENS, ROWS, BYTES = 1 << 20, 500_000, 64_000_000
K1, B = 1.2, 0.75
POSTINGS = "segment long, field string, bucket int, term string, block int, n_docs long, most_tf long, least_n long, ids array<long>, tfs array<long>, ns array<long>"


def _segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segments that are whole: a segment's corpus figures come last."""
    try:
        return sorted(r["segment"] for r in spark.read.parquet(f"{path}/corpus").select("segment").distinct().collect())
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []


def _hash(term: str) -> int:
    return zlib.crc32(term.encode())


def _read(spark: SparkSession, path: str, part: str, segments: Sequence[int], first: Column | None = None) -> DataFrame:
    """first: a condition that goes before the segments'."""
    mine = F.col("segment").isin([*segments])
    return spark.read.parquet(f"{path}/{part}").where(mine if first is None else first & mine)


def add(docs: DataFrame, fields: Sequence[str], path: str, segment: int | None = None) -> int:
    """docs (doc_id, a column for each field) -> a new segment; its number. Of rows that share a
    doc_id the caller passes one. docs are read twice, for their lengths and for their tokens. A segment that a
    failed job left in part is written over."""
    spark = docs.sparkSession
    segments = _segments(spark, path)
    segment = max([-1, *segments]) + 1 if segment is None else segment
    text = lambda f: F.lower(F.coalesce(F.col(f), F.lit("")))
    pattern = F.lit(f"({TOKEN})")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *fields)
    lengths = F.create_map(*[x for f in fields for x in (F.lit(f), F.regexp_count(text(f), pattern).cast("long"))])
    _put(docs.select(F.lit(segment).cast("long").alias("segment"), "doc_id", lengths.alias("n")), f"{path}/docs")
    figures = _figures(_read(spark, path, "docs", [segment]), segment)
    rows = figures.collect()  # one for each field
    dealt = docs.withColumn("block", _block(F.col("doc_id"), _blocks(max([0, *(r["n_docs"] for r in rows)])))).repartition("block").sortWithinPartitions("block")
    tokens = dealt.select("block", "doc_id", *[F.regexp_extract_all(text(f), pattern).alias(f"tokens_{i}") for i, f in enumerate(fields)])
    _write(tokens.groupBy("block").applyInArrow(_inverted([*fields]), BUILT), path, segment, sum(r["n_tokens"] for r in rows))
    _put(figures, f"{path}/corpus")
    return segment


def _figures(docs: DataFrame, segment: int) -> DataFrame:
    each = docs.select(F.explode("n").alias("field", "n")).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))
    return each.select(F.lit(segment).cast("long").alias("segment"), "field", "n_docs", "n_tokens")


def _put(rows: DataFrame, path: str, *by: str) -> None:
    """Writes a segment's folder, and over what a failed job left of it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("segment", *by).parquet(path)


def _blocks(n_docs: int) -> int:
    """Numbers of blocks are powers of two, so a block of a small segment falls into whole ones of a larger."""
    return 1 << (max(1, -(-n_docs // BLOCK)) - 1).bit_length()


def _block(doc_id: Column, blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), blocks if isinstance(blocks, Column) else F.lit(blocks)).cast("int")


BUILT = "field string, term string, block int, n_docs long, most_tf long, least_n long, ids array<long>, tfs array<long>, ns array<long>"


def _built(block: int, fields: pa.Array, terms: pa.Array, ids: np.ndarray, tfs: np.ndarray, ns: np.ndarray) -> pa.Table:
    """A block's (field, term, document) with counts and lengths -> a row of postings for each
    field and term, documents in order."""
    field, term = fields.dictionary_encode(), terms.dictionary_encode()
    own = field.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
    order = np.lexsort((ids, own))
    own, lists = own[order], [x[order].astype(np.int64) for x in (ids, tfs, ns)]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    edges = pa.array(np.append(first, len(own)), pa.int32())
    key = own[first]
    low = lambda f, x: f.reduceat(x, first) if len(first) else x
    columns = [
        field.dictionary.take(pa.array(key // max(1, len(term.dictionary)))), term.dictionary.take(pa.array(key % max(1, len(term.dictionary)))), pa.array(np.full(len(first), block), pa.int32()), pa.array(np.diff(np.append(first, len(own)))),
        pa.array(low(np.maximum, lists[1])), pa.array(low(np.minimum, lists[2])), *(pa.ListArray.from_arrays(edges, pa.array(x)) for x in lists),
    ]
    return pa.table(columns, names=[part.split()[0] for part in BUILT.split(", ")])


def _flat(rows: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in rows[column].chunks]) if rows.num_rows else pa.array([], rows.schema.field(column).type.value_type)


def _repeated(rows: pa.Table, column: str) -> np.ndarray:
    """The place of the row that each value of a list came from."""
    return np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows[column]).to_numpy())


def _counted(key: tuple, rows: pa.Table) -> pa.Table:
    """A block's documents (doc_id, field, tokens, n), all of their tokens counted here."""
    terms, row = _flat(rows, "tokens").dictionary_encode(), _repeated(rows, "tokens")
    pair, tf = np.unique(row * max(1, len(terms.dictionary)) + terms.indices.to_numpy(), return_counts=True)
    row, term = pair // max(1, len(terms.dictionary)), pair % max(1, len(terms.dictionary))
    field = rows["field"].combine_chunks().take(pa.array(row))
    return _built(key[0].as_py(), field, terms.dictionary.take(pa.array(term)), rows["doc_id"].to_numpy()[row], tf, rows["n"].to_numpy()[row])


def _inverted(fields: Sequence[str]) -> Callable[[tuple, pa.Table], pa.Table]:
    """_counted of documents (doc_id, a column of tokens for each field)."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        each = []
        for i, field in enumerate(fields):
            tokens = docs[f"tokens_{i}"]
            each.append(pa.table({"doc_id": docs["doc_id"], "field": pa.array([field] * docs.num_rows, pa.string()), "tokens": tokens, "n": pc.list_value_length(tokens).cast(pa.int64())}))
        return _counted(key, pa.concat_tables(each))

    return run


def _alive(key: tuple, old: pa.Table, docs: pa.Table) -> pa.Table:
    """A block's postings of all segments, and its documents with their newest segment."""
    ids, tfs, ns = (_flat(old, c).to_numpy() for c in ("ids", "tfs", "ns"))
    row = _repeated(old, "ids")
    order = np.argsort(docs["doc_id"].to_numpy())
    known, newest = docs["doc_id"].to_numpy()[order], docs["segment"].to_numpy()[order]
    live = np.flatnonzero(newest[np.searchsorted(known, ids)] == old["segment"].to_numpy()[row]) if len(ids) else np.zeros(0, np.int64)
    take = pa.array(row[live])
    return _built(key[0].as_py(), old["field"].combine_chunks().take(take), old["term"].combine_chunks().take(take), ids[live], tfs[live], ns[live])


PACKED = "part int, packed binary"
#: A run's columns: keys by their values, lists by the bytes of one place.
RUN = {"compression": "zstd", "write_statistics": False, "store_schema": False, "use_dictionary": ["field", "term", "block"], "column_encoding": {f"{c}.list.element": "BYTE_STREAM_SPLIT" for c in ("ids", "tfs", "ns")}}


def _packed(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of postings -> a compressed run of them for each part, of terms dealt by their hash."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).select(["field", "term", "block", "ids", "tfs", "ns"]).combine_chunks()
        term = rows["term"].combine_chunks().dictionary_encode()
        part = np.fromiter((_hash(t) % parts for t in term.dictionary.to_pylist()), np.int64, len(term.dictionary))
        code = term.indices.to_numpy()
        order = np.lexsort((rows["block"].to_numpy(), code, part[code]))
        part, rows = part[code][order], rows.take(pa.array(order)).combine_chunks()
        edges, runs = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)), []
        for start, end in zip(edges[:-1], edges[1:]):
            sink = pa.BufferOutputStream()
            pq.write_table(rows.slice(start, end - start), sink, **RUN)
            runs.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(part[edges[:-1]], pa.int32()), pa.array(runs, pa.binary())], names=["part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(x.num_rows for x in held) >= ROWS or sum(x.nbytes for x in held) >= BYTES:
                yield emit(held)
                held = []
        if held:
            yield emit(held)
        give_back()

    return run


def _row(fields: pa.Array, terms: pa.Array, blocks: pa.Array, counts: np.ndarray, lists: Sequence[np.ndarray], segment: int) -> pa.RecordBatch:
    """Rows of POSTINGS from their keys, their numbers of documents (over 0) and all of their documents."""
    edges = np.append(0, np.cumsum(counts))
    first, offsets = edges[:-1], pa.array(edges, pa.int32())
    unique = terms.dictionary_encode()
    bucket = np.fromiter((_hash(t) % BUCKETS for t in unique.dictionary.to_pylist()), np.int32, len(unique.dictionary))[unique.indices.to_numpy()]
    columns = [
        pa.array(np.full(len(counts), segment)), fields, pa.array(bucket), terms, blocks, pa.array(counts.astype(np.int64)), pa.array(np.maximum.reduceat(lists[1], first)), pa.array(np.minimum.reduceat(lists[2], first)),
        *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists),
    ]
    return pa.record_batch(columns, names=[part.split()[0] for part in POSTINGS.split(", ")])


def _unpacked(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch["packed"]:
                rows = pq.ParquetFile(pa.BufferReader(packed.as_buffer())).read(use_threads=False).combine_chunks()
                field, term, block = (rows[c].combine_chunks() for c in ("field", "term", "block"))
                yield _row(field, term, block, pc.list_value_length(rows["ids"]).to_numpy(), [_flat(rows, c).to_numpy() for c in ("ids", "tfs", "ns")], segment)
        give_back()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of POSTINGS in the order of their keys -> rows of one key as one, documents in order."""

    def one(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        own = np.repeat(np.cumsum(new) - 1, pc.list_value_length(rows["ids"]).to_numpy())
        lists = [_flat(rows, c).to_numpy() for c in ("ids", "tfs", "ns")]
        order, keys = np.lexsort((lists[0], own)), rows.filter(pa.array(new)).combine_chunks()
        field, term, block = (keys[c].combine_chunks() for c in ("field", "term", "block"))
        return _row(field, term, block, np.bincount(own), [x[order] for x in lists], rows["segment"][0].as_py())

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        new = np.ones(rows.num_rows, bool)
        for i, c in enumerate(("field", "term", "block")):
            values = rows[c].combine_chunks()
            differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = differs if not i else new[1:] | differs
        last = int(np.flatnonzero(new)[-1])  # its key may go on in the next batch
        held = rows.slice(last)
        if last:
            yield one(rows.slice(0, last), new[:last])
    if held is not None:
        yield one(held, np.arange(held.num_rows) == 0)


def _write(built: DataFrame, path: str, segment: int, n_tokens: int, join: bool = False) -> None:
    """Rows with a field, term, block, ids, tfs and ns -> postings, sorted by term in their bucket. A row
    of postings holds a block's documents, at most. Parts are powers of two, so a bucket is whole ones or
    in one. join: several rows may share a term and block."""
    parts = 1 << (max(1, -(-n_tokens // TOKENS)) - 1).bit_length()
    order = ["segment", "field", "bucket", "term", "block"]
    packed = built.select("field", "term", "block", "ids", "tfs", "ns").mapInArrow(_packed(parts), PACKED)
    postings = packed.repartitionById(parts, F.col("part")).mapInArrow(_unpacked(segment), POSTINGS).sortWithinPartitions(*order)
    if join:
        postings = postings.mapInArrow(_joined, POSTINGS).sortWithinPartitions(*order)
    _put(postings, f"{path}/postings", "field", "bucket")


def merge(spark: SparkSession, path: str) -> int:
    """All segments as a new one; older ones are no longer read. Returns its number."""
    segments = _segments(spark, path)
    if len(segments) < 2:
        return segments[-1] if segments else -1
    new = segments[-1] + 1
    every = _read(spark, path, "docs", segments).select("segment", "doc_id", "n")
    docs = stored(every.groupBy("doc_id").agg(F.max_by("n", "segment").alias("n"), F.max("segment").alias("segment")), "text-docs")
    figures = _figures(docs, new)
    n_docs, n_tokens = docs.count(), sum(r["n_tokens"] for r in figures.collect())
    in_block = lambda x: _block(x, _blocks(n_docs))
    # a row for each block of a segment that has documents left: how many there were, and are
    blocks = {r["segment"]: _blocks(r["count"]) for r in every.groupBy("segment").count().collect()}
    own = _block(F.col("doc_id"), F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in blocks.items() for x in pair]), F.col("segment"))).alias("block")
    was, now = (x.groupBy("segment", own).agg(F.count(F.lit(1)).alias(n)) for x, n in ((every, "was"), (docs, "now")))
    left = stored(was.join(now, ["segment", "block"]), "text-blocks")
    alive = {r["segment"]: r["changed"] for r in left.groupBy("segment").agg(F.bool_or(F.col("now") < F.col("was")).alias("changed")).collect()}
    parts = []
    for changed in [False, *{True} & {*alive.values()}] if n_tokens else []:
        some = left.where((F.col("now") < F.col("was")) == changed).select("segment", "block")
        old = _read(spark, path, "postings", [*alive]).join(F.broadcast(some), ["segment", "block"], "left_semi").select("segment", "field", "term", "block", "ids", "tfs", "ns")
        if changed or any(blocks[s] < _blocks(n_docs) for s in alive):
            # rows of postings move as they are, cut only where a block falls into several
            old = old.select("segment", "field", "term", F.arrays_zip("ids", "tfs", "ns").alias("p"), F.explode(F.array_distinct(F.transform("ids", in_block))).alias("block"))
            old = old.withColumn("p", F.filter("p", lambda x: in_block(x["ids"]) == F.col("block"))).select("segment", "field", "term", "block", "p.ids", "p.tfs", "p.ns")
        if changed:
            known = docs.select("doc_id", "segment", in_block(F.col("doc_id")).alias("block"))
            old = old.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_alive, BUILT)
        parts.append(old.select("field", "term", "block", "ids", "tfs", "ns"))
    if parts:
        _write(functools.reduce(DataFrame.unionByName, parts), path, new, n_tokens, join=len(alive) > 1)
    _put(docs.select(F.lit(new).cast("long").alias("segment"), "doc_id", "n"), f"{path}/docs")
    _put(figures, f"{path}/corpus")
    spark.range(1).select(F.lit(new).cast("long").alias("first")).coalesce(1).write.mode("overwrite").parquet(f"{path}/since")
    return new


def live_segments(spark: SparkSession, path: str) -> list[int]:
    """Those from the last merge on."""
    try:
        since = spark.read.parquet(f"{path}/since").first()["first"]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        since = -1
    return [s for s in _segments(spark, path) if s >= since]


def _share(tf: Column, n: Column, mean: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def search(spark: SparkSession, path: str, field: str, terms: Sequence[str], k: int, first: int = FIRST, report: dict[str, int] | None = None) -> DataFrame:
    """doc_id, score of the k best documents for the terms in one field, smaller ids
    first among equals. first: blocks, in units of those that could hold k documents, that
    are scored before others are left out. report: gets the numbers of blocks with one of
    the terms, and of those opened."""
    segments, wanted = live_segments(spark, path), sorted(set(terms))
    empty = spark.createDataFrame([], "doc_id long, score double")
    if not segments or not wanted:
        return empty
    # a document's newest segment holds it; older postings of it are stale
    docs = _read(spark, path, "docs", segments)
    again = None
    if len(segments) > 1:
        newest = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.max("segment").alias("newest")).where("times > 1")
        again = stored(newest.select("doc_id", "newest"), "text-again")
        again = None if again.isEmpty() else again
    if again is None:
        totals = _read(spark, path, "corpus", segments).where(F.col("field") == field).agg(F.sum("n_docs").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    else:
        newest = docs.groupBy("doc_id").agg(F.max_by("n", "segment").alias("n"))
        totals = newest.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n")[field]).alias("tokens")).first()
    if not totals["n"] or not totals["tokens"]:
        return empty
    buckets = sorted({_hash(t) % BUCKETS for t in wanted})
    postings = _read(spark, path, "postings", segments, F.col("bucket").isin(buckets) & (F.col("field") == field) & F.col("term").isin(wanted))

    def opened(rows: DataFrame) -> DataFrame:
        each = rows.select("segment", "block", "term", F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("p")).select("segment", "block", "term", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.ns").alias("n"))
        if again is None:
            return each
        return each.join(again, "doc_id", "left").where("newest IS NULL OR newest = segment").drop("newest")

    counted = postings.groupBy("term").agg(F.sum("n_docs").alias("df")) if again is None else opened(postings).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # a row for each term asked for
    if not df:
        return empty
    idf = F.element_at(F.create_map(*[F.lit(x) for t, d in df.items() for x in (t, d)]), F.col("term"))
    idf = F.ln(1 + (F.lit(float(totals["n"])) - idf + 0.5) / (idf + 0.5))
    mean = F.lit(totals["tokens"] / totals["n"])
    bounds = postings.groupBy("segment", "block").agg(F.sum(_share(F.col("most_tf"), F.col("least_n"), mean, idf)).alias("bound"), F.max("n_docs").alias("least"))
    bounds = stored(bounds, "text-bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        rows = opened(postings.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi"))
        return rows.groupBy("doc_id").agg(F.round(F.sum(_share(F.col("tf"), F.col("n"), mean, idf)), 6).alias("score"))

    best = [F.col("score").desc(), F.col("doc_id")]
    some = max(1, -(-k // BLOCK)) * first
    top = scored(bounds.orderBy(F.desc("bound"), "segment", "block").limit(some)).orderBy(*best).limit(k)
    worst = top.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
    # a score is rounded, so a bound just under it may still hold an equal one
    reach = worst["score"] - 1e-6 if worst["n"] == k else float("-inf")
    opened_ = bounds.where(F.col("bound") >= reach)
    if report is not None:
        report.update(blocks=bounds.count(), opened=opened_.count())
    return scored(opened_).orderBy(*best).limit(k)


def index_path(spark: SparkSession) -> str:
    return shared_path(spark, "text-index")
