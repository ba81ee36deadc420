"""Bilingual query expansion against the concept table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelode.functions.concepts import CONCEPTS
from timelode.functions.text import TOKEN, stripped
from timelode.operators.automaton import find

MAX_TRANSLATIONS, MOST_KEYS = 5, 100_000


def concepts(spark: SparkSession) -> DataFrame:
    """key, visual, audio, position: longer keys first, in table order among equals."""
    order = sorted(range(len(CONCEPTS)), key=lambda i: -len(CONCEPTS[i][0]))
    rows = [(CONCEPTS[i][0], list(CONCEPTS[i][1]), list(CONCEPTS[i][2]), p) for p, i in enumerate(order)]
    return spark.createDataFrame(rows, "key string, visual array<string>, audio array<string>, position int")


def matched(queries: DataFrame, table: DataFrame) -> DataFrame:
    """queries (request_id, query) -> a row for each concept whose key the query holds: one
    pass over a query for all keys, whose table has at most ``MOST_KEYS`` rows."""
    rows = table.orderBy("position").limit(MOST_KEYS + 1).collect()
    found = find(queries, F.lower(stripped(F.col("query"))), [r["key"] for r in rows], "found_")
    numbers = [(i, *r) for i, r in enumerate(rows)]
    table = table.sparkSession.createDataFrame(numbers, T.StructType([T.StructField("found_", T.IntegerType()), *table.schema.fields]))
    return found.withColumn("found_", F.explode("found_")).join(F.broadcast(table), "found_").drop("found_")


def expand(queries: DataFrame, table: DataFrame) -> DataFrame:
    """request_id, query, concepts, visual, audio (sorted sets), expanded."""
    found = matched(queries, table).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "key", "visual", "audio"))).alias("m")
    )
    found = found.select("request_id", F.col("m.key").alias("concepts"), F.flatten("m.visual").alias("v"), F.flatten("m.audio").alias("a"), F.transform("m.visual", lambda x: F.get(x, F.lit(0))).alias("first"))
    none = F.array().cast("array<string>")
    rows = queries.withColumn("query", stripped(F.col("query"))).join(found, "request_id", "left")
    tokens = F.regexp_extract_all(F.lower("query"), F.lit(f"({TOKEN})"))
    short = F.slice(F.array_distinct(F.coalesce("first", none)), 1, MAX_TRANSLATIONS)
    return rows.select(
        "request_id",
        "query",
        F.coalesce("concepts", none).alias("concepts"),
        F.array_sort(F.array_union(tokens, F.coalesce("v", none))).alias("visual"),
        F.array_sort(F.array_union(tokens, F.coalesce("a", none))).alias("audio"),
        F.when(F.size(short) > 0, F.concat_ws(" ", "query", F.array_join(short, " "))).otherwise(F.col("query")).alias("expanded"),
    )


def accepted(queries: DataFrame) -> DataFrame:
    """Requests with something to search for."""
    return queries.where(stripped(F.col("query")) != "")
