"""Exact deduplication as a stateful stream.

Records (digest, stable id, length, row, the file that holds the content) flow through
a streaming aggregation keyed by digest. Its state lives on disk (RocksDB, checkpointed to
the shared folder), never expires, and holds per digest the best record so far
and a count. Each micro-batch appends what changed; the newest entry of a digest
is its state. On a hit (a digest with more than one record) the whole
normalised texts are compared: the least and the greatest of a digest must agree.
Rows that differ in spite of an equal digest are grouped by their full text.

With ``state_dir`` the state goes on: a later call adds a further batch of documents
to what earlier calls have seen. The normalised text of each new digest is written
once, below ``state_dir``, in ``BUCKETS`` folders by digest; the state's locator names the
folder. A batch's hits are compared with the texts in the folders that they fall into,
and a hit whose text isn't there stops the job: none passes without its full bytes.

A bounded filter of the digests that were hit stands before the comparison, and each
task passes on the least and the greatest text of a digest, so texts without a
copy don't move, and a text with copies everywhere moves once a task.

Only DataFrame operations; the driver's Python merely starts the stream.

Defined results: a null text counts as empty, so all null, empty and
white-space texts are one group; rows with a null id take part and sort after
other ids of the same length; repeated rows are members like any other, and of rows
that tie in length and id the first row stays, so exactly one row of a group is
kept; texts of any length are compared whole; an empty table gives an empty
result; other columns never matter.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, key_filter, numbered, own_name, passing, shared_path, stored, without

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each store reserves megabytes of disk for a log of a few bytes
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 2000
BUCKETS = 256
#: What tasks pass on of a digest is merged in two steps, in this many parts first.
PARTS = 64


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _order(chars: Column, doc_id: Column) -> Column:
    """Least is best: most code points, then smallest id, null ids last."""
    return F.struct((-chars).alias("chars"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


def _record(locator: Column, batch: str) -> Column:
    """What the state keeps of a row (text, doc_id, row_): its order, then its batch (the
    earlier one stays), then its number, and where its content is."""
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return F.struct(_order(chars, F.col("doc_id")).alias("order"), F.lit(batch).alias("batch"), F.col("row_").alias("row"), locator.alias("locator"))


def _bucket(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BUCKETS)).cast("int")


def stream_state(spark: SparkSession, source: str, schema, files_per_batch: int = FILES_PER_BATCH, checkpoint: str | None = None) -> DataFrame:
    """Runs the records under ``source`` that ``checkpoint`` has not seen through
    the keyed state; returns (digest, best, n) of every digest they touched."""
    checkpoint = checkpoint or shared_path(spark, "dedup-state")
    changes = f"{checkpoint}-changes"
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    state = records.groupBy("digest").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    with _settings(spark, STATE):
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    try:
        seen = spark.read.parquet(changes)
    except Exception as error:  # no micro-batch ran: the source holds no file
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], state.schema)
    newest = seen.groupBy("digest").agg(F.max_by("best", "n").alias("best"), F.max("n").alias("n"))
    return newest


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, state_dir: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> one row for each: doc_id, keep_id, group_size, kept, digest,
    keep_locator (the file of the kept record; with ``state_dir`` the folder that holds its
    content). The kept record has the most code points, then the smallest id. With
    ``state_dir``, groups count all batches so far."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_"))
    return grouped(rows, digest, files_per_batch, state_dir).drop("row_")


def grouped(rows: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, state_dir: str | None = None) -> DataFrame:
    """dedup for rows (doc_id, text, row_); row_ goes along."""
    spark = rows.sparkSession
    clean = normalised(F.col("text"))
    # a batch's records are written once; the stream, and the result, read them from there
    folder = state_dir or shared_path(spark, "dedup")
    bucket = _bucket(digest(clean)).cast("string")
    locator = F.concat(F.lit(f"{folder}/contents/bucket="), bucket) if state_dir else F.input_file_name()
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    records = rows.select("doc_id", "row_", digest(clean).alias("digest"), _record(locator, batch).alias("best"))
    records.write.parquet(f"{folder}/records/{batch}")
    records = spark.read.schema(records.schema).parquet(f"{folder}/records/{batch}")
    state = stored(stream_state(spark, f"{folder}/records/*", records.schema, files_per_batch, f"{folder}/state"), "dedup-keys")
    hits = state.where("n > 1")
    if state_dir:
        hits = hits.join(records.select("digest").distinct(), "digest")
    hits = stored(hits, "dedup-hits")

    # Full bytes on hits. The filter lets through few other texts; these agree with
    # themselves and change nothing.
    filter_ = stored(key_filter(hits, "digest"), "dedup-filter")
    texts = rows.select("doc_id", "row_", "text")
    compared = texts.select("text")
    compared = compared.select(digest(clean).alias("digest"), clean.alias("clean"))
    if state_dir:
        new = _new_contents(state, records, texts.select(digest(clean).alias("digest"), "row_", clean.alias("clean")))
        compared = compared.unionByName(_kept_before(hits, new, folder))
    compared = passing(compared, F.col("digest"), filter_)
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    ends = compared.select("digest", part, "clean").groupBy("digest", "part").agg(F.min("clean").alias("low"), F.max("clean").alias("high"))
    ends = ends.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    mixed = stored(ends.where("low <> high").select("digest"), "dedup-mixed")
    if mixed.isEmpty():
        return _members(records, hits)
    if state_dir:
        raise ValueError("texts of several batches differ in spite of an equal digest: deduplicate them in one batch")
    plain = records.join(mixed, "digest", "left_anti")
    return _members(plain, hits).unionByName(_split(texts, digest, mixed))


def _new_contents(state: DataFrame, records: DataFrame, texts: DataFrame) -> DataFrame:
    """digest, clean of the digests that this batch brought, one text each, with the bucket."""
    here = records.groupBy("digest").agg(F.count(F.lit(1)).alias("here"))
    new = state.join(here, "digest").where("n = here").select("digest", F.col("best.row").alias("row_"))
    return texts.join(new, ["digest", "row_"]).select("digest", "clean", _bucket(F.col("digest")).alias("bucket"))


def _kept_before(hits: DataFrame, new: DataFrame, folder: str) -> DataFrame:
    """Adds the batch's new contents to those below ``folder``; gives digest and text of the
    hits that earlier batches kept. The driver gets numbers of buckets only."""
    spark, path = hits.sparkSession, f"{folder}/contents"
    new.sortWithinPartitions("bucket", "digest").write.mode("append").partitionBy("bucket").parquet(path)
    buckets = [r["bucket"] for r in hits.select(_bucket(F.col("digest")).alias("bucket")).distinct().collect()]
    kept = spark.read.schema("digest binary, clean string, bucket int").parquet(path).where(F.col("bucket").isin(buckets)).select("digest", "clean")
    kept = stored(passing(kept, F.col("digest"), key_filter(hits, "digest")).join(hits.select("digest"), "digest"), "dedup-kept")
    if not hits.join(kept, "digest", "left_anti").isEmpty():
        raise ValueError(f"{path} lacks the content of digests that were hit: the state and its contents don't belong together")
    return kept


def _members(records: DataFrame, hits: DataFrame) -> DataFrame:
    """A record without a hit is a group of its own."""
    hits = hits.select("digest", F.col("best").alias("top"), "n")
    top = F.coalesce("top", "best")
    return records.join(hits, "digest", "left").select(
        "doc_id",
        "row_",
        top["order"]["doc_id"].alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("best") == top).alias("kept"),
        "digest",
        top["locator"].alias("keep_locator"),
    )


def _split(texts: DataFrame, digest: Callable[[Column], Column], mixed: DataFrame) -> DataFrame:
    """Digests that stand for several texts: their groups go by the full text."""
    clean = normalised(F.col("text"))
    own = stored(texts.select("doc_id", "row_", digest(clean).alias("digest"), clean.alias("clean"), _record(F.input_file_name(), "").alias("best")).join(mixed, "digest"), "dedup-split")
    tops = own.groupBy("digest", "clean").agg(F.min("best").alias("top"), F.count(F.lit(1)).alias("n"))
    return own.join(tops, ["digest", "clean"]).select(
        "doc_id", "row_", F.col("top.order.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best") == F.col("top")).alias("kept"), "digest", F.col("top.locator").alias("keep_locator")
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each group of equal texts, all columns as
    they are. Rows are told apart by where they stand, whatever their ids."""
    row = own_name(docs, "row_")
    rows = numbered(docs, "dedup-rows", row)
    gone = grouped(rows.select("doc_id", "text", F.col(row).alias("row_"))).where("not kept").select(F.col("row_").alias(row))
    return without(rows, gone, row).select(*docs.columns)
