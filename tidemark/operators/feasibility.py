"""Checks of label counts: each gives one row of (check, status, numbers). The rules run as columns over one row a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _worst(block, warn):
    return F.when(block, "block").when(warn, "warn").otherwise("ok")


def positives_per_part(counts: DataFrame) -> DataFrame:
    """part, positives, status; counts has cutoff_time, positives and part (train, val, test)."""
    per = counts.where(F.col("part").isin("train", "val", "test")).groupBy("part").agg(F.sum("positives").alias("positives"))
    least = F.when(F.col("part") == "train", 50).otherwise(20)
    return per.select("part", "positives", _worst(F.col("positives") < least, F.col("positives") < 200).alias("status"))


def base_rate_per_cutoff(counts: DataFrame) -> DataFrame:
    """min_rate, max_rate, empty_cutoffs, status: a cutoff without positives, or rates over 3 times apart."""
    c = counts.agg(F.min("base_rate").alias("min_rate"), F.max("base_rate").alias("max_rate"), F.count_if(F.col("positives") == 0).alias("empty_cutoffs"))
    return c.withColumn("status", _worst(F.lit(False), (F.col("empty_cutoffs") > 0) | (F.try_divide(F.col("max_rate"), F.col("min_rate")) > 3)))


def eligible_drops(counts: DataFrame) -> DataFrame:
    """cutoff_time, before, eligible, status for each cutoff after the first; counts has a row for each cutoff (at most 2,000)."""
    lagged = counts.select("cutoff_time", F.lag("eligible").over(Window.orderBy("cutoff_time")).alias("before"), "eligible").where("before is not null")
    return lagged.withColumn("status", _worst(F.lit(False), F.col("eligible") * 2 < F.col("before")))


def imbalance(counts: DataFrame) -> DataFrame:
    c = counts.agg((F.sum("positives") / F.sum("eligible")).alias("rate"))
    rarer = F.least(F.col("rate"), 1 - F.col("rate"))
    return c.select("rate", rarer.alias("rarer_share"), _worst(F.lit(False), rarer < 0.01).alias("status"))


def coverage(covered: DataFrame) -> DataFrame:
    """best share of entities with earlier rows over the linked tables; under 5 per cent, or none, is a warning."""
    c = covered.agg(F.max(F.try_divide(F.col("covered").cast("double"), F.col("eligible").cast("double"))).alias("best"))
    return c.select("best", _worst(F.lit(False), F.coalesce(F.col("best") < 0.05, F.lit(True))).alias("status"))


def dropped(cutoffs: DataFrame) -> DataFrame:
    return cutoffs.agg(F.count("*").alias("n_dropped")).select("n_dropped", _worst(F.lit(False), F.col("n_dropped") > 0).alias("status"))


def target_moments(counts: DataFrame) -> DataFrame:
    """part, n, mean, std, zero_share, status, pooled from the regression counts of each cutoff (population deviations)."""
    per = counts.where(F.col("part").isin("train", "val", "test")).groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * (F.pow("std", F.lit(2.0)) + F.pow("mean", F.lit(2.0)))).alias("q"), F.sum(F.col("n") * F.col("zero_share")).alias("z"))
    m = F.col("s") / F.col("n")
    out = per.select("part", "n", m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - m * m)).alias("std"), (F.col("z") / F.col("n")).alias("zero_share"))
    nonzero = F.round(F.col("n") * (1 - F.col("zero_share")))
    least = F.when(F.col("part") == "train", 50).otherwise(20)
    block = ((F.col("part") == "train") & (F.col("std") == 0)) | (nonzero < least)
    return out.withColumn("status", _worst(block, F.col("zero_share") > 0.9))


def classes_per_part(counts: DataFrame) -> DataFrame:
    """part, n_classes, n_rows, smallest, unseen (classes not in train), status; counts has part, label, n."""
    per = counts.where(F.col("part").isin("train", "val", "test")).groupBy("part", "label").agg(F.sum("n").alias("n"))
    known = per.where("part = 'train'").select("label", F.lit(1).alias("known"))
    c = per.join(known, "label", "left").groupBy("part").agg(F.count("*").alias("n_classes"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest"), F.count_if(F.col("known").isNull()).alias("unseen"))
    train = F.col("part") == "train"
    block = (F.col("n_classes") > 30) | train & (F.col("n_classes") < 2) | ~train & (F.col("n_rows") < 20)
    return c.withColumn("status", _worst(block, train & (F.col("smallest") < 30) | (F.col("unseen") > 0)))
