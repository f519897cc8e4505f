"""Leakage scan of a table with a target. Each check gives column_name, its evidence and a severity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.profile import _unpivot, distinct_counts, kind_of
from tidemark.operators.splits import ordered_rank

#: Words that name what happens after, or with, an outcome.
AFTER_WORDS = frozenset(
    "cancelled canceled cancellation churned refund refunded chargeback outcome result resolved resolution closed terminated termination "
    "default defaulted writeoff collections label after post final".split()
)


def id_like(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """column_name, distinct_share, rising, flagged: over 95 per cent distinct, and text, or an integer that rises (or falls) in the order.

    The order is followed within ranges; the last value of a range and the first of the next are compared by extremes.
    """
    kinds = dict(df.dtypes)
    ranked = ordered_rank(df.select(order, *[c for c in columns if c != order]), [order], "_i").withColumn("_b", F.floor(F.col("_i") / 100_000))
    w = Window.partitionBy("_b").orderBy("_i")
    steps, parts = ranked, {}
    whole = [c for c in columns if kind_of(kinds[c]) == "integer"]
    for c in whole:
        steps = steps.withColumn(f"_d_{c}", F.sign(F.col(c) - F.lag(c).over(w)))
    for c in columns:
        up = (F.coalesce(F.min(f"_d_{c}"), F.lit(0)) > 0) | (F.coalesce(F.max(f"_d_{c}"), F.lit(0)) < 0) if c in whole else F.lit(False)
        parts[c] = [up, F.lit(kind_of(kinds[c]) == "text"), F.count("*")]
    out = _unpivot(steps, parts, ["rising", "is_text", "n"]).join(F.broadcast(distinct_counts(df, columns)), "column_name", "left")
    out = out.withColumn("distinct_share", F.try_divide(F.coalesce("n_distinct", F.lit(0)).cast("double"), F.col("n").cast("double")))
    return out.select("column_name", "distinct_share", "rising", ((F.col("n") >= 20) & (F.col("distinct_share") > 0.95) & (F.col("is_text") | F.col("rising"))).alias("flagged"))


def target_copies(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """column_name, n_pairs, n_values, flagged: one value of the column for each of the target, and the other way round."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = df.where(F.col(target).isNotNull()).select(F.explode(pairs).alias("p"), F.col(target).cast("string").alias("y")).where("p.v is not null")
    cells = rows.groupBy("p.column_name", "p.v", "y").agg(F.count("*").alias("n"))
    c = cells.groupBy("column_name").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_cells"), F.count_distinct("v").alias("n_values"), F.count_distinct("y").alias("n_classes"))
    return c.select("column_name", "n_pairs", "n_values", ((F.col("n_pairs") >= 10) & (F.col("n_cells") == F.col("n_values")) & (F.col("n_values") == F.col("n_classes"))).alias("flagged"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """value and its average rank, over distinct values: counts first, then running totals in ranges of the value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranked = ordered_rank(counts, ["v"], "_i").withColumn("_b", F.floor(F.col("_i") / 100_000))
    before = ranked.groupBy("_b").agg(F.sum("n").alias("t"))
    shift = before.select("_b", F.coalesce(F.sum("t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    run = F.sum("n").over(Window.partitionBy("_b").orderBy("_i"))
    return ranked.withColumn("r", run).join(F.broadcast(shift), "_b").select(F.col("v").alias(column), (F.col("r") + F.col("s") - (F.col("n") - 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: spearman, flagged (over 0.999 in size), over rows with both."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    both = rows.join(average_ranks(rows, "a", "ra"), "a").join(average_ranks(rows, "b", "rb"), "b")
    return both.agg(F.corr("ra", "rb").alias("spearman")).withColumn("flagged", F.abs("spearman") > 0.999)


def _depth_three(x: np.ndarray, y: np.ndarray, depth: int = 3) -> list:
    """A small regression tree on one feature, as (thresholds, means) by recursion."""
    if depth == 0 or len(y) < 10:
        return [(np.inf, float(y.mean()) if len(y) else 0.0)]
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    cut = np.flatnonzero(xs[1:] > xs[:-1]) + 1
    if not len(cut):
        return [(np.inf, float(y.mean()))]
    s = np.cumsum(ys)
    gain = s[cut - 1] ** 2 / cut + (s[-1] - s[cut - 1]) ** 2 / (len(ys) - cut)
    k = int(cut[np.argmax(gain)])
    at = (xs[k - 1] + xs[k]) / 2
    left, right = _depth_three(xs[:k], ys[:k], depth - 1), _depth_three(xs[k:], ys[k:], depth - 1)
    return [(min(t, at), m) for t, m in left] + right


def _auc(y: np.ndarray, p: np.ndarray) -> float:
    values, where, n = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[where]
    pos = y.sum()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(1, pos * (len(y) - pos)))


def _fold_score(x: np.ndarray, y: np.ndarray, fold: np.ndarray, classes: np.ndarray | None) -> float:
    """The mean over three folds of a depth-3 tree's AUC (of one class against the rest, averaged) or R2."""
    def predicted(target: np.ndarray, f: int) -> np.ndarray:
        tree = _depth_three(x[fold != f], target[fold != f])
        return np.array([m for _, m in tree])[np.searchsorted(np.array([t for t, _ in tree])[:-1], x[fold == f], "left")]

    scores = []
    for f in range(3):
        held = y[fold == f]
        if classes is None:
            spread = ((held - held.mean()) ** 2).sum() if len(held) else 0.0
            if spread > 0:
                scores.append(1 - ((held - predicted(y, f)) ** 2).sum() / spread)
            continue
        there = [c for c in (classes[1:] if len(classes) == 2 else classes) if 0 < (held == c).sum() < len(held)]
        if there:
            scores.append(float(np.mean([_auc((held == c).astype(float), predicted((y == c).astype(float), f)) for c in there])))
    return float(np.mean(scores)) if scores else float("nan")


def single_feature(df: DataFrame, target: str, columns: list[str], sample: int = 20_000, seed: int = 42, most_classes: int = 20) -> DataFrame:
    """column_name, metric, score, severity: how well a depth-3 tree on one numeric column predicts the target; over 0.90 warn, 0.98 block.

    roc_auc for classes (text, boolean or at most two numbers; each class against the rest), r2 for other numbers, as the
    mean of three folds. The sample is bounded, so each column's group is too; columns are fitted in parallel. A target with a
    single value gives no score and no flag. Text with more than `most_classes` values keeps the most frequent classes' rows
    in the average only.
    """
    rows = df.select(F.col(target).alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns]).where("_y is not null").orderBy(F.xxhash64(*columns, F.lit(seed))).limit(sample)
    number = kind_of(dict(df.dtypes)[target]) in ("integer", "float")
    classify = not number or rows.select("_y").distinct().limit(3).count() <= 2
    y = F.col("_y").cast("double") if number else F.col("_y").cast("string")
    long = rows.select(y.alias("y"), F.xxhash64(*columns).alias("_k"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in columns])).alias("p")).select("p.column_name", "p.x", "y", "_k")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        # dealt in turn within each class, so every fold has its share of each
        group = group.sort_values(["y", "_k", "x"] if classify else ["_k", "x", "y"])
        codes, values = pd.factorize(group["y"], sort=True) if classify else (group["y"].to_numpy(float), None)
        classes = None
        if classify:
            sizes = np.bincount(codes, minlength=len(values))
            classes = np.sort(np.argsort(-sizes, kind="stable")[:most_classes])
        x = group["x"].fillna(-1e300).to_numpy()
        score = _fold_score(x, np.asarray(codes, float), np.arange(len(x)) % 3, classes if classes is None or len(classes) > 1 else classes[:0])
        return pd.DataFrame({"column_name": [group["column_name"].iloc[0]], "score": [score]})

    out = long.groupBy("column_name").applyInPandas(fit, "column_name string, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    severity = F.when(F.col("score") > 0.98, "block").when(F.col("score") > 0.90, "warn").otherwise("ok")
    return out.select("column_name", F.lit("roc_auc" if classify else "r2").alias("metric"), "score", severity.alias("severity"))


def duplicate_rows(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """n_rows, duplicates, share, mixed_groups (equal features, other targets), flagged (over 5 per cent of 20 rows or more)."""
    g = df.groupBy(*features).agg(F.count("*").alias("n"), F.count_distinct(target).alias("d"))
    c = g.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if((F.col("n") > 1) & (F.col("d") > 1)).alias("mixed_groups"))
    share = F.col("duplicates") / F.col("n_rows")
    return c.select("n_rows", "duplicates", share.alias("share"), "mixed_groups", ((F.col("n_rows") >= 20) & (share > 0.05)).alias("flagged"))


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, min, max, mean, std, flagged: 0 to 1, or mean 0 and deviation 1, and no whole numbers."""
    parts = {c: [F.min(c).cast("double"), F.max(c).cast("double"), F.avg(c), F.stddev_samp(c), F.count_if(F.col(c) != F.floor(c)), F.count("*")] for c in columns}
    out = _unpivot(df, parts, ["min", "max", "mean", "std", "broken", "n"]).join(F.broadcast(distinct_counts(df, columns)), "column_name", "left")
    unit = (F.col("min") == 0) & (F.col("max") == 1)
    z = (F.abs("mean") < 1e-3) & (F.abs(F.col("std") - 1) < 1e-2)
    return out.select("column_name", "min", "max", "mean", "std", ((F.col("n") >= 20) & (F.coalesce("n_distinct", F.lit(0)) > 2) & (F.col("broken") > 0) & (unit | z)).alias("flagged"))


def date_like(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """column_name, present, parsed, flagged for text columns, over all present values."""
    parts = {c: [F.count(c), F.count(F.expr(f"try_to_timestamp(`{c}`)"))] for c in columns}
    return _unpivot(df, parts, ["present", "parsed"]).withColumn("flagged", (F.col("present") > 0) & (F.col("parsed") >= least * F.col("present")))


def named_after(columns: list[str], target: str) -> list[str]:
    """Columns whose name holds a word of an outcome or of the target."""
    import re

    split = lambda n: {w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", n).lower()) if len(w) > 2}
    return [c for c in columns if c != target and (split(c) & AFTER_WORDS or split(c) & split(target))]


def scan(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """column_name, check_name, severity for attributes of the training rows."""
    kinds = dict(df.dtypes)
    out = target_copies(df, target, columns).where("flagged").select("column_name", F.lit("target_copy").alias("check_name"), F.lit("block").alias("severity"))
    numbers = [c for c in columns if kind_of(kinds[c]) in ("integer", "float")]
    if numbers:
        out = out.union(single_feature(df, target, numbers).where("severity <> 'ok'").select("column_name", F.lit("single_feature"), "severity"))
    named = named_after(columns, target)
    return out.union(df.sparkSession.createDataFrame([(c, "name", "warn") for c in named], "column_name string, check_name string, severity string")) if named else out
