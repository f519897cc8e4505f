"""Ranks, deciles, training statistics, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.operators.profile import quantiles
from tidemark.operators.splits import ordered_rank
from tidemark.sources.shared import written

DECILES = [i / 10 for i in range(1, 10)]


def rank_rows(df: DataFrame, score: str = "score", key: str = "entity_id") -> DataFrame:
    """df with rank (1 is the highest score, ties by key) and decile (1 is the best)."""
    n = df.count()
    ranked = ordered_rank(df, [F.desc(score), F.col(key)])
    return ranked.withColumn("decile", F.least(F.lit(10), 1 + F.floor((F.col("rank") - 1) * 10 / F.lit(max(n, 1)))).cast("int"))


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each feature: null_rate, mean, std (sample), edges (distinct deciles)."""
    parts = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [F.avg(x.isNull().cast("double")).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("null_rate"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(columns)])
    edges = quantiles(df, columns, DECILES).select(F.col("column_name").alias("feature"), F.array_distinct("q").alias("edges"))
    return df.agg(*parts).select(F.inline(rows)).join(F.broadcast(edges), "feature", "left")


def bin_shares(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """feature, bin, share: bin is the number of edges that are at most the value; nulls are left out. stats has a row for each feature."""
    edges = {r["feature"]: r["edges"] or [] for r in stats.select("feature", "edges").collect()}
    cells = []
    for c in columns:
        at = F.lit(0)
        for e in edges[c]:
            at = at + F.when(F.col(c).cast("double") >= F.lit(float(e)), 1).otherwise(0)
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), at).alias("bin")))
    counts = df.select(F.explode(F.array(*cells)).alias("x")).where("x.bin is not null").groupBy("x.feature", "x.bin").agg(F.count("*").alias("n"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("t"))
    every = [(c, b) for c in columns for b in range(len(edges[c]) + 1)]
    grid = df.sparkSession.createDataFrame(every, "feature string, bin int")
    return grid.join(F.broadcast(counts), ["feature", "bin"], "left").join(F.broadcast(total), "feature", "left").select("feature", "bin", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("t").cast("double")), F.lit(0.0)).alias("share"))


def psi(train: DataFrame, now: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """feature, psi: sum of (now - train) ln(now / train) over the bins, shares clipped at 1e-4."""
    a = bin_shares(train, columns, stats).withColumnRenamed("share", "a")
    b = bin_shares(now, columns, stats).withColumnRenamed("share", "b")
    x, y = F.greatest(F.col("a"), F.lit(1e-4)), F.greatest(F.col("b"), F.lit(1e-4))
    return a.join(b, ["feature", "bin"]).groupBy("feature").agg(F.sum((y - x) * F.log(y / x)).alias("psi"))


def drift(train: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    """feature, null_gap, mean_shift (in deviations), psi and one flag for each limit (0.10, 3, 0.2)."""
    old = feature_stats(train, columns)
    new = feature_stats(now, columns).select("feature", F.col("null_rate").alias("now_null"), F.col("mean").alias("now_mean"))
    rows = old.join(new, "feature").join(psi(train, now, columns, old), "feature")
    gap, shift = F.abs(F.col("now_null") - F.col("null_rate")), F.try_divide(F.abs(F.col("now_mean") - F.col("mean")), F.col("std"))
    return rows.select("feature", gap.alias("null_gap"), shift.alias("mean_shift"), "psi", (gap > 0.10).alias("null_drift"), F.coalesce(shift > 3, F.lit(False)).alias("mean_drift"), (F.col("psi") > 0.2).alias("psi_drift"))


def summary(ranked: DataFrame, k: int, score: str = "score") -> DataFrame:
    """n_scored, score_at_k, expected_in_top (sum of scores in the top k), expected."""
    top = F.col("rank") <= k
    return ranked.agg(F.count("*").alias("n_scored"), F.min(F.when(top, F.col(score))).alias("score_at_k"), F.sum(F.when(top, F.col(score))).alias("expected_in_top"), F.sum(score).alias("expected"))


def history_row(now: DataFrame, cutoff: str, columns: list[str], psis: DataFrame, most: float = 0.2) -> DataFrame:
    """One row for a scoring: cutoff_time, n_scored, hash of what was scored, psi by feature, drifted (features over the limit)."""
    what = now.agg(F.count("*").alias("n_scored"), F.coalesce(F.bit_xor(F.xxhash64("entity_id", *columns)), F.lit(0)).alias("hash"))
    by = F.sort_array(F.collect_list(F.struct("feature", "psi")))  # a pair for each feature
    drifted = F.transform(F.filter(by, lambda p: p["psi"] > most), lambda p: p["feature"])
    return what.crossJoin(psis.agg(F.map_from_entries(by).alias("psi"), drifted.alias("drifted"))).select(F.lit(cutoff).cast("timestamp_ntz").alias("cutoff_time"), "n_scored", "hash", "psi", "drifted")


def preview(model, df: DataFrame, columns: list[str], k: int = 20, key: str = "entity_id") -> DataFrame:
    """The k highest scores (ties by key) with the three columns that moved each most: key, score, rank, reason_1 to reason_3."""
    top = written(models.predict(model, df, columns).orderBy(F.desc("score"), key).limit(k), "top")  # all rows are scored once
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows
    why = models.reasons(model, top, columns, key).select(key, "reason_1", "reason_2", "reason_3")
    return ranked.join(why, key).select(key, "score", "rank", "reason_1", "reason_2", "reason_3")
