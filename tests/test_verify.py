"""Truncation for all cutoffs in two builds finds what one build for each cutoff finds."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as fs
from tidemark.operators import labels as lb
from tidemark.operators import verify
from tidemark.operators.features import Feature, Path


@pytest.fixture(scope="module", params=["int", "string", "negative"])
def shop(spark, request):
    cast = (lambda c: F.concat(F.lit("c/"), c.cast("string"))) if request.param == "string" else (lambda c: (c - 6).cast("int")) if request.param == "negative" else (lambda c: c.cast("int"))
    orders = spark.range(400).select(F.col("id").alias("order_id"), cast(F.col("id") % 11).alias("who"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") * 37 % 360).cast("int"))).alias("at"))
    items = spark.range(900).select((F.col("id") % 400).alias("order_of"), F.col("id").alias("amount"))
    people = orders.select("who").distinct()
    spine = lb.entity_cutoffs(people, "who", lb.cutoffs(spark, "2024-02-01", "2024-12-01", 1, "months"))
    return spine, {"orders": (orders, "at"), "items": (items, None)}


KEYS = {"orders": ["who", "order_id"], "items": ["order_of"]}


def spent(bounded):
    def make(spine, tables):
        o, i = tables["orders"], tables["items"]
        joined = i.join(o, i["order_of"] == o["order_id"])
        if bounded:
            return fs.compute(spine, Path(joined, "who", "at"), [Feature("value", "sum", "amount", 90)])
        last = joined.groupBy("who").agg(F.max("amount").alias("value"))
        return spine.select(*lb.KEYS).join(last, F.col("entity_id") == F.col("who"), "left").select(*lb.KEYS, "value")

    return make


def test_two_builds_equal_one_for_each_cutoff(shop):
    spine, tables = shop
    builds = []

    def counted(make):
        return lambda s, t: builds.append(1) or make(s, t)

    assert verify.truncation(counted(spent(True)), spine, tables, keys=KEYS).count() == 0 and len(builds) == 2
    leak = verify.truncation(counted(spent(False)), spine, tables, keys=KEYS)
    assert len(builds) == 4
    slow = verify.truncation(spent(False), spine, tables)
    assert sorted(leak.collect()) == sorted(slow.collect()) and leak.count() > 20
    assert dict(leak.dtypes)["entity_id"] == dict(spine.dtypes)["entity_id"]


def test_no_cutoffs(shop):
    spine, tables = shop
    assert verify.truncation(spent(False), spine.where("false"), tables, keys=KEYS).count() == 0
    assert verify.truncation(spent(False), spine.where("false"), tables).count() == 0
