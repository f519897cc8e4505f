"""Cleaning and encoding of feature tables. Every statistic is one aggregate over the rows it is fitted on."""

from __future__ import annotations

from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import _unpivot, distinct_counts, kind_of, quantile, top_values


def id_columns(df: DataFrame) -> DataFrame:
    """column_name, n_distinct, is_id: one value a row and no float, or a name that ends in id and 90 per cent distinct."""
    parts = {c: [F.count("*"), F.lit(kind_of(t) != "float"), F.lit(c.lower().endswith("id"))] for c, t in df.dtypes}
    both = _unpivot(df, parts, ["n", "whole", "named"]).join(F.broadcast(distinct_counts(df, df.columns)), "column_name", "left")
    d = F.coalesce("n_distinct", F.lit(0).cast("long"))
    return both.select("column_name", d.alias("n_distinct"), ((F.col("whole") & (d == F.col("n"))) | (F.col("named") & (d >= 0.9 * F.col("n")))).alias("is_id"))


def numeric_text(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """column_name, present, parsed, failures, is_numeric for text columns."""
    parts = {c: [F.count(c), F.count(F.expr(f"try_cast(trim(`{c}`) as double)")), F.count(c) - F.count(F.expr(f"try_cast(trim(`{c}`) as double)"))] for c in columns}
    return _unpivot(df, parts, ["present", "parsed", "failures"]).withColumn("is_numeric", (F.col("present") > 0) & (F.col("parsed") >= least * F.col("present")))


def fitted(df: DataFrame, aggregates: dict[str, Column]) -> dict:
    """One row of statistics of the rows that a step is fitted on."""
    return df.agg(*[a.alias(n) for n, a in aggregates.items()]).first().asDict()


def impute(df: DataFrame, fit_on: DataFrame, column: str, how: str) -> DataFrame:
    """median, mean, most_frequent or constant ('missing')."""
    x = F.col(column)
    if how == "constant":
        return df.withColumn(column, F.coalesce(x, F.lit("missing")))
    if how == "most_frequent":
        top = fit_on.where(x.isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).collect()
        return df.withColumn(column, F.coalesce(x, F.lit(top[0][0]))) if top else df
    value = quantile(fit_on, column, [0.5])[0] if how == "median" else fitted(fit_on, {"v": F.avg(x.cast("double"))})["v"]
    return df.withColumn(column, F.coalesce(x.cast("double"), F.lit(value)))


def scale(df: DataFrame, fit_on: DataFrame, column: str, how: str) -> DataFrame:
    """standard (population deviation), robust (median and quartiles) or min_max; a zero range gives 0."""
    x = F.col(column).cast("double")
    if how == "standard":
        s = fitted(fit_on, {"a": F.avg(x), "b": F.stddev_pop(x)})
    elif how == "robust":
        low, middle, high = quantile(fit_on, column, [0.25, 0.5, 0.75])
        s = {"a": middle, "b": None if low is None else high - low}
    else:
        q = fitted(fit_on, {"lo": F.min(x), "hi": F.max(x)})
        s = {"a": q["lo"], "b": None if q["lo"] is None else q["hi"] - q["lo"]}
    return df.withColumn(column, (x - F.lit(s["a"])) / F.lit(s["b"] or 1.0))


def levels(fit_on: DataFrame, column: str, most: int = 20) -> list[str]:
    """The most frequent levels (count falling, then value), at most `most`."""
    return [r["value"] for r in top_values(fit_on, [column], most).orderBy("position").collect()]


def one_hot(df: DataFrame, fit_on: DataFrame, column: str, most: int = 20) -> DataFrame:
    """column_<level> 0/1 columns of the most frequent levels and column_other; unknown and missing give all zeros but other."""
    known = levels(fit_on, column, most)
    x = F.col(column).cast("string")
    flags = {f"{column}_{v}": F.coalesce((x == v).cast("int"), F.lit(0)) for v in known}
    return df.withColumns(flags | {f"{column}_other": (x.isNotNull() & ~x.isin(known)).cast("int") if known else x.isNotNull().cast("int")})


def to_category(df: DataFrame, fit_on: DataFrame, column: str) -> DataFrame:
    """Levels seen in training; others become NULL. Levels are a table, joined by key, so their number is not bounded."""
    seen = fit_on.select(F.col(column).alias(column), F.lit(1).alias("_seen")).where(F.col(column).isNotNull()).distinct()
    return df.join(seen, column, "left").withColumn(column, F.when(F.col("_seen") == 1, F.col(column))).drop("_seen")


def target_encode(df: DataFrame, column: str, target: str, key: str, folds: int = 5, smoothing: float = 10.0) -> DataFrame:
    """column_te: for each row the smoothed target mean of its level over the other folds (folds by a hash of the key).

    Per level and fold sums are pre-aggregated; a level's total less its fold's sums is what the other folds hold.
    """
    rows = df.withColumn("_f", F.pmod(F.xxhash64(key), F.lit(folds)))
    y = F.col(target).cast("double")
    by_fold = rows.groupBy(column, "_f").agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    total = by_fold.groupBy(column).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    mean = rows.agg(F.avg(y).alias("m"))
    out_of = by_fold.join(total, by_fold[column].eqNullSafe(total[column])).drop(total[column]).crossJoin(F.broadcast(mean))
    value = (F.col("ts") - F.col("s") + F.col("m") * smoothing) / (F.col("tn") - F.col("n") + smoothing)
    table = out_of.select(F.col(column).alias("_c"), F.col("_f").alias("_g"), value.alias(f"{column}_te"))
    return rows.join(table, rows[column].eqNullSafe(table["_c"]) & (F.col("_f") == F.col("_g")), "left").drop("_f", "_g", "_c")


def build(df: DataFrame, fit_on: DataFrame, plan: dict[str, list[str]], target: str | None = None, key: str | None = None) -> DataFrame:
    """A cleaning plan: for each column steps impute_*, scale_*, one_hot, target_encode, log1p or keep; other columns are dropped."""
    out, kept = df, []
    for column, steps in plan.items():
        names = [column]
        for step in steps:
            if step.startswith("impute_"):
                out, fit_on = impute(out, fit_on, column, step[7:]), impute(fit_on, fit_on, column, step[7:])
            elif step.startswith("scale_"):
                out = scale(out, fit_on, column, step[6:])
            elif step == "one_hot":
                before = set(out.columns)
                out = one_hot(out, fit_on, column)
                names = [c for c in out.columns if c not in before]
            elif step == "target_encode":
                out, names = target_encode(out, column, target, key), [f"{column}_te"]
            elif step == "log1p":
                out = out.withColumn(column, F.log1p(F.col(column).cast("double")))
            elif step != "keep":
                raise ValueError(f"{column}: no step {step}")
        kept += names
    return out.select(*([key] if key and key not in kept else []), *kept)


def label_encode(df: DataFrame, target: str, positive: str | None = None) -> DataFrame:
    """df and label_code. Two classes: 1 is the given or the rarer one (ties: the last in order); more: their order. At most 1,000 classes."""
    counts = sorted((r[0], r[1]) for r in df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string")).count().limit(1001).collect())  # a 1,001st class raises, whichever it is
    if len(counts) > 1000:
        raise ValueError("more than 1,000 classes")
    names = [c for c, _ in counts]
    if len(names) == 2:
        one = positive if positive is not None else min(counts, key=lambda x: (x[1], -names.index(x[0])))[0]
        if one not in names:
            raise ValueError(f"no class {one}")
        code = {c: int(c == one) for c in names}
    else:
        code = {c: i for i, c in enumerate(names)}
    pick = F.coalesce(*[F.when(F.col(target).cast("string") == c, F.lit(i)) for c, i in code.items()], F.lit(None).cast("int"))
    return df.withColumn("label_code", pick)


def constant_columns(train: DataFrame, columns: list[str], most: float = 0.99) -> DataFrame:
    """column_name, top_share, drop: the share of the most frequent value; a missing value is a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    counts = train.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.v").agg(F.count("*").alias("n"))
    return counts.groupBy("column_name").agg((F.max("n") / F.sum("n")).alias("top_share")).withColumn("drop", F.col("top_share") > most)


def duplicate_columns(train: DataFrame, columns: list[str], most: float = 0.99, sample: int = 5000, seed: int = 42, least_pairs: int = 30) -> list[tuple[str, str]]:
    """(column, earlier column kept) for numeric columns that equal or correlate with an earlier one; missing values must match.

    The correlations come from one job for each pattern of missing values, over a bounded seeded sample of train rows.
    """
    order = F.xxhash64(*columns, F.lit(seed))
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).orderBy(order).limit(sample)
    rows = rows.persist()
    masks = rows.agg(*[F.sum(F.when(F.col(c).isNull(), F.xxhash64(*columns)).otherwise(0).cast("decimal(38,0)")).alias(c) for c in columns], *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    groups: dict = {}
    for c in columns:
        groups.setdefault((masks[c], masks[f"n_{c}"]), []).append(c)
    found: list[tuple[str, str]] = []
    for (_, n), cols in groups.items():
        if len(cols) < 2 or n < least_pairs:
            continue
        vec = rows.where(F.col(cols[0]).isNotNull()).select(F.array(*cols).alias("a"))
        from pyspark.ml.functions import array_to_vector

        matrix = Correlation.corr(vec.select(array_to_vector("a").alias("v")), "v").first()[0].toArray()
        kept: list[int] = []
        for i in range(len(cols)):
            twin = next((j for j in kept if abs(matrix[i][j]) > most), None)
            if twin is None:
                kept.append(i)
            else:
                found.append((cols[i], cols[twin]))
    rows.unpersist()
    return sorted(found, key=lambda p: columns.index(p[0]))


def model_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as double, times as days since 1970, the rest as text."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        k = kind_of(kinds[c])
        if k in ("integer", "float", "boolean"):
            x = F.col(c).cast("double")
        elif k in ("timestamp", "date"):
            x = F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86400e6)
        else:
            x = F.col(c).cast("string")
        out.append(x.alias(c))
    return df.select(*out)
