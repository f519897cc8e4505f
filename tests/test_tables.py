"""Samples, fingerprints, distinct counts and contracts that do not depend on how rows are dealt or named."""

from pyspark.sql import functions as F

from tidemark.operators import clean, leakage, profile
from tidemark.plans import reference_queries
from tidemark.sources import tables as src


def test_sample_by_keys_is_the_same_in_any_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("x"))
    got = [sorted(r.id for r in profile.sampled(df.repartition(n), 5000, 1000, ["id"])[0].collect()) for n in (1, 5)]
    assert got[0] == got[1] and 850 < len(got[0]) < 1150
    twice = profile.sampled(df.union(df), 10_000, 2000, ["id"])[0].groupBy("id").count()
    assert twice.where("count <> 2").count() == 0
    nulls = spark.createDataFrame([(None,)] * 40, "id int")
    assert profile.sampled(nulls, 40, 10, ["id"])[0].count() in (0, 40)
    assert profile.sampled(df, 5000)[1]["sampled"] is False


def test_fingerprint_sees_nulls_and_places_but_no_order(spark):
    rows = [(1, None), (None, 1), (2, 2), (2, 2), (3, 4)]
    make = lambda some: tuple(src.fingerprint(spark.createDataFrame(some, "a int, b int")).first())
    assert make(rows) == make(rows[::-1])
    assert make([(1, None)]) != make([(None, 1)])
    assert make(rows)[0] == 5 and len(make(rows)[1]) == 16
    assert make(rows) != make(rows[:3])
    assert make([]) == (0, None)


def test_distinct_counts_of_odd_values(spark):
    df = spark.createDataFrame([(0.0, None, 1, "a"), (-0.0, None, 1, "b"), (float("nan"), None, 2, "b"), (None, None, 3, None)], "x double, none string, n int, weird_id string")
    got = {r.column_name: r.n_distinct for r in profile.distinct_counts(df, df.columns).collect()}
    assert got == {"x": 2, "n": 3, "weird_id": 2}
    told = {r.column_name: (r.n_distinct, r.is_id) for r in clean.id_columns(df).collect()}
    assert told == {"x": (2, False), "none": (0, False), "n": (3, False), "weird_id": (2, False)}


def test_id_like_and_normalised_on_empty_and_null_columns(spark):
    df = spark.range(30).select("id", F.lit(None).cast("int").alias("none"), (F.col("id") / 29).alias("unit"))
    got = {r.column_name: (r.distinct_share, r.flagged) for r in leakage.id_like(df, "id", ["id", "none"]).collect()}
    assert got == {"id": (1.0, True), "none": (0.0, False)}
    flagged = {r.column_name for r in leakage.normalised(df, ["unit", "none"]).where("flagged").collect()}
    assert flagged == {"unit"}
    assert not leakage.id_like(df.limit(0), "id", ["id", "none"]).where("flagged").count()
    assert not leakage.normalised(df.limit(0), ["unit"]).where("flagged").count()


def test_catalog_query_leaves_no_table(spark):
    rows = reference_queries.a3(spark, "/root/testdata/sf0.001")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_customer")]
    assert rows.where("c_custkey is not null").count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()


def test_distinct_counts_expand_no_rows(spark):
    """Ids and normalised columns are counted by groups: no aggregate multiplies its rows by the number of columns."""
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for out in (clean.id_columns(df), leakage.normalised(df, ["o_totalprice", "o_custkey"])):
        assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
