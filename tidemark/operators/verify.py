"""Checks that features keep their contract and read nothing at or after the cutoff; entity sampling; user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.labels import KEYS
from tidemark.operators.profile import quantiles_of_counts
from tidemark.sources.shared import written

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def contract(result: DataFrame, spine: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: repeated_keys, foreign_rows, missing_rows; a wrong set of columns is an error."""
    want = [*KEYS, *(columns or ["value"])]
    if sorted(result.columns) != sorted(want):
        raise ValueError(f"the columns must be {want}, not {result.columns}")
    keys, own = result.groupBy(*KEYS).agg(F.count("*").alias("n")), spine.select(*KEYS).distinct()
    both = keys.withColumn("r", F.lit(1)).join(own.withColumn("s", F.lit(1)), KEYS, "full")
    return both.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("s").isNull()).alias("foreign_rows"), F.count_if(F.col("r").isNull()).alias("missing_rows"))


def some_cutoffs(spine: DataFrame, most: int) -> list:
    """Up to `most` cutoffs, spread evenly from the first to the last."""
    cuts = [r[0] for r in spine.select("cutoff_time").distinct().orderBy("cutoff_time").collect()]  # at most 2,000
    if len(cuts) <= most:
        return cuts
    return [cuts[round(i * (len(cuts) - 1) / (most - 1))] for i in range(most)]


def drawn(spine: DataFrame, cutoffs: int, rows: int, seed: int) -> tuple[DataFrame, list]:
    """Up to `rows` rows of each of some cutoffs, drawn by a hash of the entity, written; and those cutoffs."""
    cuts, out = some_cutoffs(spine, cutoffs), None
    for c in cuts:
        one = spine.where(F.col("cutoff_time") == F.lit(c)).orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id").limit(rows)
        out = one if out is None else out.union(one)
    return written(spine.limit(0) if out is None else out, "drawn"), cuts


def before_cutoff(df: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Rows before a cutoff; for DATE times the whole day of the cutoff goes."""
    return df.where(F.col(time) < (F.to_date(cutoff) if dict(df.dtypes)[time] == "date" else cutoff))


def _own(key: Column, kind: str, number: Column, n: int) -> Column:
    """A key that only rows of one cutoff share: integers stay integers."""
    if kind in INTEGERS:
        return key.cast("long") * n + number
    return F.concat(number.cast("string"), F.lit("/"), key.cast("string"))


def truncation(make: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], spine: DataFrame, tables: dict[str, tuple[DataFrame, str | None]], value: str = "value", cutoffs: int = 5, rows: int = 200, seed: int = 42, tolerance: float = 1e-9, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """entity_id, cutoff_time, full, truncated where a feature changes once all rows at or after the cutoff are gone.

    make(spine, tables) builds the feature. For DATE times the whole day of the cutoff goes. Nulls are equal.

    With `keys` (for each table all columns that it is joined by, the entity's among them) the feature is built twice
    whatever the cutoffs: each truncated table holds its rows once for each drawn cutoff after them, under keys and
    entities of that cutoff's own, so that rows of different cutoffs never meet. That needs a feature whose value depends
    on rows with its keys only; one that looks at a whole table (its mean, a global rank) would see all cutoffs' rows, so
    leave `keys` out for it and it is built once for each cutoff.
    """
    part, cuts = drawn(spine, cutoffs, rows, seed)
    full = make(part, {n: df for n, (df, _) in tables.items()}).select(*KEYS, F.col(value).cast("double").alias("full"))
    if keys is None:
        less = None
        for c in cuts:
            cut = {n: df if t is None else before_cutoff(df, t, F.lit(c)) for n, (df, t) in tables.items()}
            one = make(part.where(F.col("cutoff_time") == F.lit(c)), cut).select(*KEYS, F.col(value).cast("double").alias("truncated"))
            less = one if less is None else less.union(one)
        less = full.select(*KEYS, F.col("full").alias("truncated")).limit(0) if less is None else less
    else:
        kind, n = dict(spine.dtypes)["entity_id"], max(1, len(cuts))
        numbered = spine.sparkSession.createDataFrame(list(enumerate(cuts)), "_i int, _cut timestamp_ntz")  # a row for each drawn cutoff
        number = F.broadcast(numbered)
        cut = {}
        for name, (df, t) in tables.items():
            kinds = dict(df.dtypes)
            each = df.crossJoin(number)  # at most `cutoffs` rows on the right
            each = each if t is None else before_cutoff(each, t, F.col("_cut"))
            cut[name] = each.withColumns({k: _own(F.col(k), kinds[k], F.col("_i"), n) for k in keys.get(name, [])}).drop("_i", "_cut")
        own = part.join(number, F.col("cutoff_time") == F.col("_cut")).withColumn("entity_id", _own(F.col("entity_id"), kind, F.col("_i"), n)).drop("_i", "_cut")
        made = make(own, cut).select(*KEYS, F.col(value).cast("double").alias("truncated"))
        back = F.regexp_replace("entity_id", "^[0-9]+/", "") if kind not in INTEGERS else F.expr(f"(entity_id - pmod(entity_id, {n})) div {n}")
        less = made.withColumn("entity_id", back.cast(spine.schema["entity_id"].dataType))
    same = F.col("full").eqNullSafe(F.col("truncated")) | F.coalesce(F.abs(F.col("full") - F.col("truncated")) <= tolerance * F.greatest(F.lit(1.0), F.abs("full")), F.lit(False))
    return full.join(less, KEYS, "full").where(~same)


def sample_entities(labels: DataFrame, most_rows: int, seed: int = 42) -> DataFrame:
    """Label rows of a seeded share of the entities, whole, equally among the ever and the never positive."""
    n = labels.count()
    if n <= most_rows:
        return labels
    per = labels.groupBy("entity_id").agg(F.max(F.col("label").cast("double")).alias("_ever"))
    h = F.pmod(F.xxhash64("entity_id", F.lit(seed)), F.lit(1 << 31)).cast("double")
    # a rank by hash within each stratum: the hash's quantile is the cut
    cells = per.select(F.coalesce(F.col("_ever").cast("string"), F.lit("")).alias("c"), h.alias("x")).groupBy("c", "x").agg(F.count("*").alias("n"))
    cut = quantiles_of_counts(cells, [most_rows / n]).select("c", F.get("q", F.lit(0)).alias("_cut"))
    kept = per.withColumn("c", F.coalesce(F.col("_ever").cast("string"), F.lit(""))).join(F.broadcast(cut), "c").where(h <= F.col("_cut")).select("entity_id")
    return labels.join(kept, "entity_id", "left_semi")


def accept(make: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], spine: DataFrame, tables: dict[str, tuple[DataFrame, str | None]], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """One row: accepted, with the contract's counts and the number of rows that truncation changes."""
    result = make(spine, {n: df for n, (df, _) in tables.items()})
    changed = truncation(make, spine, tables, keys=keys).agg(F.count("*").alias("changed_rows"))
    whole = contract(result, spine).crossJoin(changed)  # one row each
    return whole.withColumn("accepted", (F.col("repeated_keys") == 0) & (F.col("foreign_rows") == 0) & (F.col("changed_rows") == 0))
