"""Temporal partition with purging, expanding folds, seeded random splits. Nothing depends on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written


def time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def partition(rows: DataFrame, val_from: str, test_from: str, cutoff: str = "cutoff_time", end: str = "label_window_end") -> DataFrame:
    """rows and `part`: train, val, test, purged_train or purged_val; a label window that ends before its cutoff is an error."""
    if rows.where(F.col(cutoff).isNull() | F.col(end).isNull() | (F.col(end) < F.col(cutoff))).take(1):
        raise ValueError("cutoffs and window ends must be present, and windows must not end before their cutoff")
    c, e, val, test = F.col(cutoff), F.col(end), time(val_from), time(test_from)
    part = F.when(c >= test, "test").when(c >= val, F.when(e <= test, "val").otherwise("purged_val")).when(e <= val, "train").otherwise("purged_train")
    return rows.withColumn("part", part)


def summary(parted: DataFrame) -> DataFrame:
    return parted.groupBy("part").agg(F.count("*").alias("n"), F.max("label_window_end").alias("max_window_end"))


def timeline(parted: DataFrame) -> DataFrame:
    return parted.groupBy("cutoff_time", "label_window_end", "part").agg(F.count("*").alias("n"))


def entity_overlap(parted: DataFrame) -> DataFrame:
    """For each pair of parts, the entities in both."""
    pairs = parted.select("entity_id", "part").distinct()
    other = pairs.select("entity_id", F.col("part").alias("other"))
    return pairs.join(other.hint("merge"), "entity_id").where("part < other").groupBy("part", "other").agg(F.count("*").alias("n_entities"))


def expanding_folds(train: DataFrame, folds: int) -> DataFrame:
    """Train rows with fold_1 ... fold_n: 'val' for its block of cutoffs, 'train' for earlier rows whose window has ended, else NULL.

    The distinct cutoffs (at most 2,000) are cut into folds + 1 consecutive blocks, the first ones one longer.
    """
    cuts = train.select("cutoff_time").distinct().withColumn("block", F.ntile(folds + 1).over(Window.orderBy("cutoff_time")))
    starts = {r["block"]: r["s"] for r in cuts.groupBy("block").agg(F.min("cutoff_time").alias("s")).collect()}
    out = train.join(F.broadcast(cuts), "cutoff_time")
    for i in range(1, folds + 1):
        begin = F.lit(starts[i + 1]) if i + 1 in starts else F.lit(None).cast("timestamp_ntz")
        out = out.withColumn(f"fold_{i}", F.when(F.col("block") == i + 1, "val").when((F.col("block") <= i) & (F.col("label_window_end") <= begin), "train"))
    return out.drop("block")


def _rank(by: list[str], keys: list[str], seed: int) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys))


def random_split(df: DataFrame, keys: list[str], label: str | None, seed: int = 42, shares: tuple[float, float] = (0.6, 0.2), slots: int = 64) -> DataFrame:
    """part: 60/20/20 within each class, by a seeded hash of the keys. Classes are cut into slots of the hash, so a large class is many groups."""
    by = ([label] if label else []) + ["_slot"]
    rows = df.withColumn("_slot", F.pmod(F.xxhash64(*keys, F.lit(seed + 1)), F.lit(slots)))
    r, n = _rank(by, keys, seed), F.count("*").over(Window.partitionBy(*by))
    share = (r - 0.5) / n
    return rows.withColumn("part", F.when(share <= shares[0], "train").when(share <= sum(shares), "val").otherwise("test")).drop("_slot")


def k_fold(df: DataFrame, keys: list[str], folds: int, label: str | None = None, seed: int = 42) -> DataFrame:
    """fold (0 to folds - 1), shuffled by a seeded hash, even within each class if a label is given."""
    slot = F.pmod(F.xxhash64(*keys, F.lit(seed + 1)), F.lit(64))
    rows = df.withColumn("_slot", slot)
    by = ([label] if label else []) + ["_slot"]
    return rows.withColumn("fold", F.pmod(_rank(by, keys, seed) + F.col("_slot"), F.lit(folds))).drop("_slot")


def repeated_k_fold(df: DataFrame, keys: list[str], folds: int = 5, repeats: int = 3, label: str | None = None, seed: int = 42) -> DataFrame:
    out = df
    for i in range(repeats):
        out = k_fold(out, keys, folds, label, seed + i).withColumnRenamed("fold", f"fold_{i + 1}")
    return out


def time_series_folds(df: DataFrame, order: str, folds: int, gap: int = 0) -> DataFrame:
    """Rows with fold_1 ... fold_n by rank in time: each fold's test block is n // (folds + 1) rows, trained on those before it less a gap."""
    n = df.count()
    size = n // (folds + 1)
    ranked = ordered_rank(df, [order])
    for i in range(1, folds + 1):
        begin = n - (folds - i + 1) * size
        r = F.col("rank") - 1
        ranked = ranked.withColumn(f"fold_{i}", F.when((r >= begin) & (r < begin + size), "val").when(r < begin - gap, "train"))
    return ranked.drop("rank")


def holdout(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """part: test where a seeded hash of the keys falls below the share."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000), "test").otherwise("train"))


def ordered_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rank from 1 in a total order, without bringing all rows to one task.

    Rows are dealt by ranges of the order; each range is ranked by itself and shifted by the rows of the ranges before it.
    """
    cols = [c if isinstance(c, Column) else F.col(c) for c in order]
    dealt = df.repartitionByRange(*cols).withColumn("_p", F.spark_partition_id())
    # written once: ranges are sampled, and both uses below must see the same ones
    local = written(dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*cols))), "ranges")
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", shift.alias("_shift"))  # a row for each range
    return local.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_r") + F.col("_shift")).drop("_p", "_r", "_shift")
