"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Rows lie in ascending document order over files and within them, so that the stripes' and row groups' minima and
maxima prune by document id, and the Bloom filters answer for ids that fall between. Stripes are read in parallel:
a file is split at stripes of the size given. Each row holds its file's number and its start within the file; the
start among all documents is that plus the totals of the files before, one row for each file.

Defined results: a null text counts as empty (the end id only); rows without an id come first; rows that repeat an id
follow each other, ordered by a hash of their text, over several files if they are many (only equal texts of one id
share one); a text of any length is one row; an empty table gives an empty folder of files; further columns are not
written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import parts_for
from tidemark.llm.tokens import encoder

END_ID = 2
#: Text for a file, more once there would be MOST_FILES of them. A file has several stripes.
FILE_BYTES, MOST_FILES = 16 << 20, 100_000
STRIPE_BYTES = 2 << 20
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
ROWS = 500


def write_tokens(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Encode every text, append end_id and write the ids in ascending doc_id order as ORC files."""
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ["doc_id", F.xxhash64("text")]  # texts of one id, or without one, are dealt to several files
    ordered = rows.repartitionByRange(parts_for(total, max(file_bytes, total // MOST_FILES)), *keys).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part, before = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                raw = [x + end for x in encode_all(some.column(1).to_pylist())]
                n = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
                cut = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), some.column(0), pa.array(before + cut[:-1]), pa.array(n), ids], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                before += int(cut[-1])

    out = ordered.mapInArrow(encode, SCHEMA)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_bytes), "orc.rows.between.memory.checks": "100", "orc.compress": "NONE"}
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids as written; only the stripes that may hold doc_ids, if given."""
    files = spark.read.schema(SCHEMA).orc(path)
    rows = files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))
    return with_starts(spark, path, rows)


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """local_start replaced by start, the ids of all documents before."""
    totals = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), *[c for c in rows.columns if c not in ("part", "doc_id", "local_start")])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    read = spark.read.schema(SCHEMA).orc(path).select("part", "doc_id", "local_start", "ids")
    return with_starts(spark, path, read.mapInArrow(crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"))
