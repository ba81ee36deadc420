"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.sources.storage import shared_dir, shared_path, stored  # noqa: F401

#: A word: a run of anything but ASCII white space (same in Java, RE2 and Python).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores as set it apart from the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs are rows of files, each at most once: projections and filters that
    always give the same, over one relation of distinct paths."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    paths = {roots.apply(i).toString() for i in range(roots.size())}
    return len(paths) == roots.size()


def content_of(docs: DataFrame) -> Column:
    """A hash of all of a row. Maps can't be hashed; they count as text."""
    text = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[text(f) for f in docs.schema.fields])


def numbered(docs: DataFrame, label: str, row: str = "row_") -> DataFrame:
    """docs with a key of each row, ``row``, that sets rows apart whatever their ids: the
    hash of all of the row, then, for a Parquet scan, its file and its place in it, which
    every later read finds again however the files are split. Other DataFrames (joined,
    exploded, united) are numbered and written. Of rows in order of this key, the first
    has the same content in each run, wherever the rows are stored."""
    content = content_of(docs).alias("content")
    if "_metadata" not in docs.columns and _is_scan(docs):
        try:
            return docs.withColumn(row, F.struct(content, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
        except AnalysisException:
            pass  # files of another format
    return stored(docs.withColumn(row, F.struct(content, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), label)


def n_words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# A bounded filter of keys: each key sets one bit of WORDS 64-bit words. The table
# of words never has more than WORDS rows, whatever the number of keys, so it may be
# broadcast; keys that share a bit pass as well, and an exact join follows.
FILTER_WORDS = 1 << 20


def _place(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("filter")), F.lit(words * 64))


def key_filter(keys: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """keys -> (word_, bits_), at most ``words`` rows."""
    place = keys.select(_place(F.col(key), words).alias("p"))
    bit = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    return place.groupBy(F.expr("p div 64").alias("word_")).agg(F.bit_or(bit).alias("bits_"))


def _meeting(rows: DataFrame, key: Column, filter_: DataFrame, words: int) -> tuple[DataFrame, DataFrame, Column, str]:
    """rows with the place of their key, the filter, and when the two meet; under
    names that are no column of rows."""
    spot, word, bits = (own_name(rows, n) for n in ("spot_", "word_", "bits_"))
    filter_ = filter_.select(F.col("word_").alias(word), F.col("bits_").alias(bits))
    at = F.expr(f"shiftleft(1L, CAST({spot} % 64 AS INT))")
    hit = (F.expr(f"{spot} div 64") == F.col(word)) & (F.col(bits).bitwiseAND(at) != 0)
    return rows.withColumn(spot, _place(key, words)), F.broadcast(filter_), hit, spot


def passing(rows: DataFrame, key: Column, filter_: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose key may be in the filter (all whose key is, few others); no
    shuffle of rows."""
    placed, filter_, hit, spot = _meeting(rows, key, filter_, words)
    return placed.join(filter_, hit, "left_semi").drop(spot)


def without(rows: DataFrame, gone: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """rows (two reads of which agree) but those with a key in ``gone`` (key). Rows that the
    filter clears stay where they are; only the others meet ``gone`` in a join."""
    gone = stored(gone.select(key), "gone")
    filter_ = stored(key_filter(gone, key, words), "gone-filter")
    placed, other, hit, spot = _meeting(rows, F.col(key), filter_, words)
    clear = placed.join(other, hit, "left_anti").drop(spot)
    return clear.unionByName(passing(rows, F.col(key), filter_, words).join(gone, key, "left_anti").select(*rows.columns))
