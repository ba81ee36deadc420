"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, as a table read back from Parquet.
All but the last return the columns of documents, each value as it came, whatever
the columns are named besides.

Odd input has a defined result in every stage. Rows are told apart by a row number,
never by id alone, so null, shared and repeated ids lose nothing. quality_rules
rejects null and empty texts (no words); exact_dedup would keep one of them, and
of rows that tie in length and id the first; ngram_join keeps every text without
words, and of a class the smallest id, then the first row; mixing draws repeated rows
one by one; packing gives a null text its end token. Texts are read whole. An empty
table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timelode.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from timelode.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling or the base rule rejects go."""
    field = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.kept_rows(docs, field)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return ngram_join.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the sequences."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("mixing", mix),
    ("packing", pack),
]

#: The field of the first stage is trained and the mix draws by hashes: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
