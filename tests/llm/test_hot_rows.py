"""Missing and repeated ids, repeated rows: results by brute force, and no file, block or group that holds all of them; what op6's ORC files hold."""

import zlib
from collections import Counter

import numpy as np
import pytest
from py4j.java_gateway import get_field
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import substring, token_store
from tidemark.llm.common import new_path

from test_llm import BPE, brute_substring, whole_ids

SCHEMA = "doc_id long, text string"
BASE = 1 << 40


def hot_rows(n=240):
    """A third without an id, a third under one id, a third of their own; some are repeated whole."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(words, 60))
    texts = [" ".join([*rng.choice(words, int(rng.integers(0, 50))), *([shared] if i % 9 == 0 else [])]) for i in range(n)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, t) for i, t in enumerate(texts)]
    return [*rows, *rows[:12], (None, None), (None, ""), (7, None)]


def test_substring_with_missing_and_repeated_ids(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = Counter((d, *told) for (d, _), told in zip(rows, brute_substring([t for _, t in rows]), strict=True))
    for block_bytes in (1 << 22, 3000):
        got = substring.repeated_spans(df, substring.digest_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string", ["doc_id"], block_bytes=block_bytes).collect()
        assert Counter(tuple(r) for r in got) == want


def test_no_block_holds_all_rows_of_an_id(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else 7, f"text {i:04d}") for i in range(3000)], "c0 long, text string")
    sizes = [r["count"] for r in rows.withColumn("block", substring.row_block(rows, ["c0"], 10)).groupBy("block").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400


def test_token_files_with_missing_and_repeated_ids(spark):
    rows = hot_rows()
    path = new_path(spark, "test")
    token_store.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), path, BPE, file_bytes=6000)
    got = sorted(token_store.checksums(spark, path).collect(), key=lambda r: r.start)
    ends = [np.append(x, 2).astype("<u4") for x in whole_ids([t for _, t in rows])]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ends, strict=True))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    held = spark.read.schema(token_store.SCHEMA).orc(path).where("doc_id is null").groupBy("part").count().collect()
    assert len(held) >= 3 and max(r["count"] for r in held) < sum(r["count"] for r in held) / 2


def test_orc_files_hold_run_lengths_indexes_and_filters_and_skip_stripes(spark):
    """Footers: integers by run-length encoding, a row index and a Bloom filter for doc_id; a search for one id reads one row group of one stripe."""
    path = new_path(spark, "test")
    df = spark.range(6000).select((F.col("id") * 2 + BASE).alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(x))) for x in "abcdef"]).alias("text"))
    token_store.write_tokens(df, path, BPE, stripe_bytes=1 << 18)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    file = next(f for f in spark.read.orc(path).inputFiles())
    orc = jvm.org.apache.orc
    reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), orc.OrcFile.readerOptions(conf))
    stripes = list(reader.getStripes())
    assert len(stripes) > 2
    names = list(reader.getSchema().getFieldNames())
    column = names.index("doc_id") + 1  # columns of the flat part are numbered from 1, before the list's own
    inner = reader.getSchema().getMaximumId()
    rows = reader.rows()
    for stripe in stripes:
        footer = rows.readStripeFooter(stripe)
        kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        assert (column, "ROW_INDEX") in kinds and (column, "BLOOM_FILTER_UTF8") in kinds
        assert {footer.getColumns(c).getKind().toString() for c in (column, inner)} == {"DIRECT_V2"}
    rows.close()

    def seen(doc_id):
        made = jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder()
        kind = getattr(jvm, "org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf$Type").LONG
        sarg = made.startAnd().equals("doc_id", kind, doc_id).end().build()
        found = reader.rows(reader.options().searchArgument(sarg, spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)))
        batch, n = reader.getSchema().createRowBatch(), 0
        while found.nextBatch(batch):
            n += get_field(batch, "size")
        found.close()
        return n

    assert 0 < seen(BASE + 6000) <= 1000  # the stride of the row index
    assert seen(BASE + 6001) == 0 or seen(BASE + 6003) == 0  # between two ids: minimum and maximum can't tell, the Bloom filter can
    assert seen(BASE + 10**9) == 0
    assert [r.doc_id for r in token_store.read_tokens(spark, path, [BASE + 6000, BASE + 6001]).collect()] == [BASE + 6000]
