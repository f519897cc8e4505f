"""A corpus pipeline over the documents table: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written and read
again before the next. All but the last return the columns of documents; n_chars follows the text.

Quality drops what the rules reject. Near-dedup links texts whose
five-word shingles have a Jaccard similarity of 0.8 or more and keeps one row of each component: the least doc_id, null after all
others, and of equal ids the least 64-bit hash of the row (rows equal in all columns are one). Different texts under
one id, or without an id, are documents of their own. Substring dedup cuts repeated passages out and
keeps all rows. Personal data is replaced by its kind in brackets. Packing returns the pieces of each sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, pii, quality, simhash, substring
from tidemark.llm.common import new_path
from tidemark.llm.queries import table, tokenizer_file

#: Units whose ids a Python worker of the packing stage remembers: fewer than alone, since workers of earlier stages live on beside it.
REMEMBERED = 200_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)).select(*COLUMNS)


def row_key() -> Column:
    """A hash of all columns of a row, nulls told from missing values: equal for equal rows only."""
    return F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs.select(*COLUMNS)).where("_quality.kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS).withColumn("row_key", row_key())
    groups = simhash.near_texts(rows)
    ids = rows.select("row_key", "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = ids.join(groups.distinct(), "row_key").groupBy("group").agg(F.min(rank).alias("r")).select("r.row_key")
    # rows of one key are equal, so any of them stands for all; the join has dealt them by key already
    kept = rows.join(first.hint("shuffle_merge"), "row_key")
    return kept.groupBy("row_key").agg(F.first(F.struct(*COLUMNS)).alias("r")).select("r.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_documents(substring.dedup(docs.select(*COLUMNS)))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS)
    return as_documents(pii.redact(rows, pii.fit(rows)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, tokenizer_file(), remembered=REMEMBERED)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]
#: Near-duplicate groups, boosted trees and sequences can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
