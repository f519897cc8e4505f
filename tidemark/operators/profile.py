"""Statistics and profiles of tables; schema discovery by data (keys, overlaps, changed columns)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

SAMPLE_ROWS, SEED, CHUNK = 1_000_000, 42, 40
#: Size of a quantile sketch: ranks within 0.14 per cent of the rows.
SKETCH_K = 2000


def kind_of(dtype: str) -> str:
    t = dtype.lower()
    for kind, words in (("timestamp", ("timestamp", "datetime")), ("integer", ("int", "serial")), ("float", ("float", "double", "real", "numeric", "decimal")), ("text", ("char", "text", "string", "uuid", "clob")), ("boolean", ("bool",))):
        if any(w in t for w in words):
            return kind
    return "date" if t.startswith("date") else "other"


def sampled(df: DataFrame, rows: int, limit: int = SAMPLE_ROWS, keys: list[str] | None = None) -> tuple[DataFrame, dict]:
    """df, or a seeded Bernoulli sample of about `limit` rows if it is larger, and what was done.

    With the keys of the rows, a hash of key and seed chooses, so the sample is the same however the rows are dealt; rows
    of one key are then taken together. Without keys the choice depends on the partitions.
    """
    if rows <= limit:
        return df, {"sampled": False, "fraction": 1.0, "method": None}
    if keys:
        fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(chr(0))) for c in keys]
        place = F.conv(F.substring(F.md5(F.concat_ws(chr(31), F.lit(str(SEED)), *fields).cast("binary")), 1, 8), 16, 10).cast("long")
        return df.where(place < F.lit(int(limit / rows * 2**32))), {"sampled": True, "fraction": limit / rows, "method": "bernoulli"}
    return df.sample(fraction=limit / rows, seed=SEED), {"sampled": True, "fraction": limit / rows, "method": "bernoulli"}


def _unpivot(df: DataFrame, parts: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """One wide row of aggregates as a row for each column."""
    wide = df.agg(*[c.alias(f"{n}_{i}") for i, cols in enumerate(parts.values()) for n, c in zip(names, cols, strict=True)])
    rows = F.array(*[F.struct(F.lit(name).alias("column_name"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, name in enumerate(parts)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def quantiles_of_counts(counts: DataFrame, shares: list[float]) -> DataFrame:
    """c, n, n_distinct, q: the interpolated quantiles of each c's numbers, from distinct rows (c, x, n).

    The counts are dealt by ranges of c and x and written once; each range's total says which ranges hold a position that is
    asked for, and only those are sorted. What is joined by broadcast has a row for each c and range at most.
    """
    dealt = written(counts.repartitionByRange("c", "x").withColumn("_p", F.spark_partition_id()), "quantiles")
    by_range = Window.partitionBy("c").orderBy("_p")
    sizes = dealt.groupBy("c", "_p").agg(F.sum("n").alias("m"), F.count("*").alias("d"))
    sizes = sizes.withColumns({"first": F.sum("m").over(by_range) - F.col("m"), "total": F.sum("m").over(Window.partitionBy("c")), "distinct": F.sum("d").over(Window.partitionBy("c"))})
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in shares]
    places = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    sizes = sizes.withColumn("places", F.filter(places, lambda t: (t >= F.col("first")) & (t < F.col("first") + F.col("m"))))
    asked = sizes.where(F.size("places") > 0).select("c", "_p", "first", "places")
    run = F.sum("n").over(Window.partitionBy("c", "_p").orderBy("x")) + F.col("first")
    rows = dealt.join(F.broadcast(asked), ["c", "_p"]).select("c", "x", "n", "places", run.alias("end"))
    hits = rows.select("c", "x", F.explode(F.filter("places", lambda t: (t >= F.col("end") - F.col("n")) & (t < F.col("end")))).alias("t"))
    found = hits.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("t", "x"))).alias("v"))  # at most two for each share
    totals = sizes.groupBy("c").agg(F.max("total").alias("total"), F.max("distinct").alias("n_distinct"))

    def between(a: Column) -> Column:
        low, high = F.floor(a), F.ceil(a)
        x, y = F.element_at("v", low.cast("long")), F.element_at("v", high.cast("long"))
        return F.when((low == high) | (x == y), x).otherwise((high - a) * x + (a - low) * y)

    return totals.join(F.broadcast(found), "c").select("c", F.col("total").alias("n"), "n_distinct", F.array(*[between(a) for a in at]).alias("q"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column_name, n (numbers), n_distinct, q (an array in the order of shares): exact and interpolated, nulls left out.

    Equal numbers are counted before anything is dealt, so a frequent one is one row. A column without a number gives no row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), (F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias("x")) for c in columns])
    counts = df.select(F.inline(pairs)).where("x is not null").groupBy("c", "x").agg(F.count("*").alias("n"))
    return quantiles_of_counts(counts, shares).withColumnRenamed("c", "column_name")


def rank_error(k: int) -> float:
    """The rank error (share of the rows) that a KLL sketch of size k keeps with 99 per cent confidence."""
    return 2.296 / k**0.9723


def sketched_quantiles(df: DataFrame, columns: list[str], shares: list[float], k: int = SKETCH_K) -> DataFrame:
    """As `quantiles`, from mergeable KLL sketches: one pass, no shuffle of values, ranks within rank_error(k); n_distinct by HyperLogLog (1 per cent)."""
    numbers = {c: F.col(f"`{c}`").cast("double") for c in columns}
    x = {c: F.when(~F.isnan(v), v) for c, v in numbers.items()}
    wide = df.agg(*[a.alias(f"{n}_{i}") for i, v in enumerate(x.values()) for n, a in (("n", F.count(v)), ("d", F.approx_count_distinct(v, 0.01)), ("s", F.kll_sketch_agg_double(v, F.lit(k))))])
    at = lambda i, q: F.when(F.col(f"n_{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s_{i}"), F.lit(float(q))))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n"), F.col(f"d_{i}").alias("n_distinct"), F.array(*[at(i, q) for q in shares]).alias("q")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows)).where("n > 0")


def quantile(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The quantiles of one column on the driver."""
    row = quantiles(df, [column], shares).first()
    return list(row["q"]) if row else [None] * len(shares)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_distinct: values as text (both zeros are one), one job for all columns; a column without a value gives no row."""
    kinds = dict(df.dtypes)
    value = lambda c: F.col(f"`{c}`") + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("float", "double") else F.col(f"`{c}`")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).cast("string").alias("v")) for c in columns])
    return df.select(F.inline(pairs)).where("v is not null").groupBy("column_name", "v").agg(F.lit(1)).groupBy("column_name").agg(F.count("*").alias("n_distinct"))


def table_stats(df: DataFrame, columns: list[str] | None = None, chunk: int = CHUNK, shares: tuple[float, ...] = (0.01, 0.5, 0.99), sketch: bool = False) -> DataFrame:
    """For each column: non_null, n_distinct, null_fraction, min_text, max_text; numbers (and shares of true) mean, std, p1, p50, p99.

    Columns are taken in chunks. Numbers get distinct counts and quantiles from one table of counted values, other columns
    theirs from another, so no aggregate expands its rows or holds a column's values. Numbers are compared as doubles, but
    for whole ones of 64 bits and decimals, whose distinct values are counted as text.

    Exact by default; with `sketch` quantiles and distinct counts of numbers come from mergeable sketches of a stated error.
    """
    kinds = dict(df.dtypes)
    names = ["non_null", "null_fraction", "min_text", "max_text", "mean", "std"]
    marks = [f"p{round(q * 100)}" for q in shares]
    todo, out = columns or df.columns, None
    for lo in range(0, len(todo), chunk):
        parts = {}
        for c in todo[lo : lo + chunk]:
            col, kind = F.col(f"`{c}`"), kind_of(kinds[c])
            none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
            number = kind in ("integer", "float")
            x = col.cast("double") if number else None
            mean = F.avg(x) if number else F.avg(F.when(F.coalesce(col, F.lit(False)), 1.0).otherwise(0.0)) if kind == "boolean" else none_d
            ordered = number or kind in ("timestamp", "date")
            parts[c] = [
                F.count(col),
                F.try_divide(F.count_if(col.isNull()).cast("double"), F.count("*").cast("double")),
                (F.min(x if number else col)).cast("string") if ordered else none_s,
                (F.max(x if number else col)).cast("string") if ordered else none_s,
                mean,
                F.stddev_samp(x) if number else none_d,
            ]
        numbers = [c for c in parts if kind_of(kinds[c]) in ("integer", "float")]
        wide = [] if sketch else [c for c in numbers if kinds[c] == "bigint" or kinds[c].startswith("decimal")]
        texts = [c for c in parts if kind_of(kinds[c]) not in ("integer", "float", "other")] + wide
        one = _unpivot(df, parts, names)
        if numbers:
            q = (sketched_quantiles if sketch else quantiles)(df, numbers, list(shares)).select("column_name", F.col("n_distinct").alias("_d"), "q")
            one = one.join(F.broadcast(q), "column_name", "left")
        else:
            one = one.withColumns({"_d": F.lit(None).cast("long"), "q": F.lit(None).cast("array<double>")})
        if texts:
            one = one.join(F.broadcast(distinct_counts(df, texts)), "column_name", "left")
        else:
            one = one.withColumn("n_distinct", F.lit(None).cast("long"))
        distinct = F.when(F.col("column_name").isin([c for c in parts if kind_of(kinds[c]) == "other"]), F.lit(None)).otherwise(F.coalesce("n_distinct", "_d", F.lit(0)))
        one = one.select("column_name", "non_null", distinct.cast("long").alias("n_distinct"), *names[1:], *[F.get("q", F.lit(i)).alias(m) for i, m in enumerate(marks)])
        out = one if out is None else out.union(one)
    return out


def top_values(df: DataFrame, columns: list[str], k: int = 10, most_levels: int | None = None) -> DataFrame:
    """column_name, value, n, position: the k most frequent values of each column (count falling, then value), in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counted = df.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))
    if most_levels is not None:
        few = counted.groupBy("column_name").agg(F.count("*").alias("levels")).where(F.col("levels") <= most_levels)
        counted = counted.join(F.broadcast(few.select("column_name")), "column_name")
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counted.withColumn("position", rank).where(F.col("position") <= k)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, missing_rate, duplicate_rows (repeats after the first)."""
    missing = sum((F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns[1:]), F.sum(F.col(f"`{df.columns[0]}`").isNull().cast("long")))
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    repeats = counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    whole = df.agg(F.count("*").alias("n_rows"), F.try_divide(missing.cast("double"), (F.count("*") * len(df.columns)).cast("double")).alias("missing_rate"))
    return whole.crossJoin(repeats).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "missing_rate", "duplicate_rows")  # one row each


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, missing, mean, std, min, q25, median, q75, max, and bias-corrected skew and excess kurtosis."""
    names = ["n", "missing", "mean", "std", "min", "max", "skew", "kurtosis"]
    parts = {}
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        n = F.count(x).cast("double")
        g1, g2 = F.skewness(x), F.kurtosis(x)
        skew = F.when(n >= 3, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))
        kurt = F.when(n >= 4, F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3)))
        parts[c] = [F.count(x), F.count_if(x.isNull()), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), skew, kurt]
    q = quantiles(df, columns, [0.25, 0.5, 0.75]).select("column_name", "q")
    both = _unpivot(df, parts, names).join(F.broadcast(q), "column_name", "left")
    return both.select("column_name", *names[:5], *[F.get("q", F.lit(i)).alias(m) for i, m in enumerate(("q25", "median", "q75"))], *names[5:])


def text_stats(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """column_name, n, missing, n_unique, value, value_n, position: each column's counts beside its k most frequent values.

    A column without a value has one row, whose value is null.
    """
    parts = {c: [F.count(f"`{c}`"), F.count_if(F.col(f"`{c}`").isNull())] for c in columns}
    whole = _unpivot(df, parts, ["n", "missing"]).join(F.broadcast(distinct_counts(df, columns)), "column_name", "left")
    top = top_values(df, columns, k).withColumnRenamed("n", "value_n")
    return whole.join(F.broadcast(top), "column_name", "left").select("column_name", "n", "missing", F.coalesce("n_distinct", F.lit(0)).alias("n_unique"), "value", "value_n", "position")


def target_balance(df: DataFrame, target: str, levels: int = 10) -> DataFrame:
    """Continuous (a number with more than `levels` values): mean, std, min, max. Else the classes' shares. As (measure, value)."""
    number = kind_of(dict(df.dtypes)[target]) in ("integer", "float")
    if number and df.select(target).distinct().limit(levels + 1).count() > levels:
        x = F.col(target).cast("double")
        wide = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        return wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("mean", "std", "min", "max")])).alias("r")).select("r.*")
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("measure")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("measure", (F.col("n") / F.col("t")).alias("value"))


def column_shape(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """bin, n, height: equal-width bins (the last closed on the right) of a column, scaled by the fullest."""
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint, height double")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return every.crossJoin(F.broadcast(top)).select("bin", "n", (F.col("n") / F.col("top")).alias("height"))


def _canonical(column: Column, kind: str) -> Column:
    """A value as text, equal for equal values of comparable kinds: 7, 7.0 and a decimal 7.00 are one."""
    if kind == "integer":
        return F.concat(F.lit("n"), column.cast("decimal(38,0)").cast("string"))
    if kind == "float":
        x = column.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.concat(F.lit("n"), F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")))
    return F.concat(F.lit(kind[0]), column.cast("string"))


def value_columns(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """v, i, n: each non-null value, the number of the (table, column) that it stands in, and its rows there; a scan for each table."""
    out = None
    for name, df in tables.items():
        mine = [(i, c) for i, (t, c) in enumerate(columns) if t == name]
        if not mine:
            continue
        kinds = dict(df.dtypes)
        cells = F.array(*[F.struct(F.lit(i).alias("i"), _canonical(F.col(f"`{c}`"), kind_of(kinds[c])).alias("v")) for i, c in mine])
        one = df.select(F.inline(cells)).where("v is not null")
        out = one if out is None else out.union(one)
    return out.groupBy("v", "i").agg(F.count("*").alias("n"))


def inclusions(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """For each (child, child_column, parent, parent_column): n_keys, matched and overlap over the child's distinct non-null values, and whether the parent's are unique.

    All columns of all pairs are unpivoted into one table of values; a value meets the set of columns that hold it once,
    and every pair follows from these sets, so each table is scanned once however many pairs there are.
    """
    columns = list(dict.fromkeys([x for a, b, c, d in pairs for x in ((a, b), (c, d))]))
    place = {x: i for i, x in enumerate(columns)}
    held = value_columns(tables, columns).groupBy("v").agg(F.collect_list("i").alias("held"), F.array_compact(F.collect_list(F.when(F.col("n") > 1, F.col("i")))).alias("twice"))  # bounded by the columns
    has = lambda side, x: F.array_contains(side, place[x])
    every = [(F.count_if(has("held", (a, b))), F.count_if(has("held", (a, b)) & has("held", (c, d))), F.count_if(has("twice", (c, d)))) for a, b, c, d in pairs]
    wide = held.agg(*[x.alias(f"{n}_{i}") for i, some in enumerate(every) for n, x in zip("kmt", some, strict=True)])
    names = ("child", "child_column", "parent", "parent_column")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, pair, strict=True)], F.col(f"k_{i}").alias("n_keys"), F.col(f"m_{i}").alias("matched"), (F.col(f"t_{i}") == 0).alias("unique_parent")) for i, pair in enumerate(pairs)])
    return wide.select(F.inline(rows)).withColumn("overlap", F.try_divide(F.col("matched").cast("double"), F.col("n_keys").cast("double")))


def key_overlap(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """child_column, parent_column, n_keys, matched, overlap over distinct non-null child keys: one pass for all pairs."""
    found = inclusions({"child": child, "parent": parent}, [("child", c, "parent", p) for c, p in pairs])
    return found.select("child_column", "parent_column", "n_keys", "matched", "overlap")


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, non_null, n_distinct, is_unique: values are counted by column, so no row is multiplied."""
    counts = value_columns({"t": df}, [("t", c) for c in columns]).groupBy("i").agg(F.sum("n").alias("non_null"), F.count("*").alias("n_distinct"))
    every = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column_name string")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("non_null", "n_distinct")]
    return every.join(counts, "i", "left").select("column_name", *zero).withColumn("is_unique", F.col("non_null") == F.col("n_distinct"))


def changed_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column_name, n_changed over rows of both snapshots with the same key; nulls are equal. A repeated key is an error."""
    for df in (old, new):
        if df.groupBy(key).count().where("count > 1").take(1):
            raise ValueError(f"{key} repeats")
    both = old.select(key, *[F.col(c).alias(f"o_{c}") for c in columns]).join(new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns]), key)
    return _unpivot(both, {c: [F.coalesce(F.sum((~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))).cast("long")), F.lit(0))] for c in columns}, ["n_changed"])


def _stem(name: str) -> str:
    n = name.lower()
    return re.sub(r"_?(id|key|no|code)$", "", n)


def _singular(name: str) -> str:
    n = name.lower()
    if n.endswith(("ss", "us", "is")):  # glass, status, analysis
        return n
    if n.endswith("ies") and len(n) > 4:
        return f"{n[:-3]}y"
    if n.endswith(("sses", "xes", "ches", "shes")):
        return n[:-2]
    return n.removesuffix("s")


def name_strength(column: str, parent: str) -> float:
    """1.0 if the column's stem is the parent's name, 0.7 if one ends in the other after a role or prefix, else 0."""
    stem, name = _singular(_stem(column)), _singular(parent)
    if stem == name:
        return 1.0
    return 0.7 if stem.endswith(f"_{name}") or name.endswith(f"_{stem}") or stem.endswith(name) and len(name) > 2 else 0.0


def infer_edges(tables: dict[str, DataFrame], keys: dict[str, str], least: float = 0.95) -> list[dict]:
    """Foreign keys: a child column named for a parent, of its kind, whose keys (at least 95 per cent) are in its unique key.

    Names and kinds choose the pairs; one job over all tables then tests them all, and the keys' uniqueness with them.
    """
    kinds = {p: kind_of(dict(tables[p].dtypes)[k]) for p, k in keys.items()}
    named = [(child, c, p, name_strength(c, p)) for child, df in tables.items() for c, t in df.dtypes if c != keys.get(child) for p in keys if p != child and kinds[p] == kind_of(t)]
    named = [x for x in named if x[3] > 0]
    if not named:
        return []
    tested = {(r["child"], r["child_column"], r["parent"]): r for r in inclusions(tables, [(child, c, p, keys[p]) for child, c, p, _ in named]).collect()}
    best: dict[tuple[str, str], tuple] = {}
    for child, c, p, strength in sorted(named):
        r = tested[child, c, p]
        score = (strength, r["overlap"] or 0.0)
        if r["unique_parent"] and score[1] >= least and ((child, c) not in best or score > best[child, c][0]):
            best[child, c] = (score, p)
    return [{"child": child, "column": c, "parent": p, "key": keys[p], "strength": s, "overlap": o, "confidence": 0.5 * s + 0.5 * o} for (child, c), ((s, o), p) in best.items()]
