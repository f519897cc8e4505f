"""Cutoffs, eligibility and label tables.

History is strictly before a cutoff; a label window is (cutoff, window end]. Times are naive UTC (timestamp_ntz).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.intervals import FEW_CUTOFFS, KEYS, MOST_CUTOFFS, Measure, Source, aggregate, micros, ordered



@dataclass(frozen=True)
class Rule:
    """Some (or no) row of `table` with `key` equal to the entity, before the cutoff and passing `where`.

    `where` is a SQL predicate on the table's columns that may use :cutoff.
    """

    table: DataFrame
    key: str
    time: str
    where: str | None = None


@dataclass(frozen=True)
class Target:
    """What happens to an entity in the label window: agg is count, sum, avg, min, max, count_distinct or first."""

    table: DataFrame
    key: str
    time: str
    agg: str = "count"
    column: str | None = None
    where: str | None = None
    compare: tuple[str, float] | None = None
    classes: bool = field(default=False)


def bound(predicate: str, cutoff: str = "cutoff_time") -> Column:
    """A SQL predicate in which :cutoff stands for the cutoff column."""
    return F.expr(re.sub(r":cutoff\b", f"`{cutoff}`", predicate))


def cutoffs(spark: SparkSession, start: str, end: str, every: int, unit: str) -> DataFrame:
    """cutoff_time: start, start + every, ... up to end; unit is days, weeks or months (day of month kept, clamped)."""
    steps = spark.range(MOST_CUTOFFS + 1).select(F.col("id").cast("int").alias("i"))
    first = F.lit(start).cast("timestamp_ntz")
    if unit == "months":
        day = F.add_months(first.cast("date"), F.col("i") * every)
        at = day.cast("timestamp_ntz") + (first - F.date_trunc("day", first))
    else:
        at = first + F.make_dt_interval(days=F.col("i") * every * (7 if unit == "weeks" else 1))
    found = steps.select(at.cast("timestamp_ntz").alias("cutoff_time"), "i").where(F.col("cutoff_time") <= F.lit(end).cast("timestamp_ntz"))
    if found.where(F.col("i") == MOST_CUTOFFS).take(1):
        raise ValueError(f"more than {MOST_CUTOFFS} cutoffs")
    return found.select("cutoff_time")


def windows(cuts: DataFrame, horizon_days: int, as_of: str, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped cutoffs with label_window_end: the horizon, or an earlier fixed end; kept if it ends by as_of."""
    end = F.col("cutoff_time") + F.make_dt_interval(days=F.lit(horizon_days))
    if until is not None:
        end = F.least(end, F.lit(until).cast("timestamp_ntz"))
    both = cuts.select("cutoff_time", end.cast("timestamp_ntz").alias("label_window_end"))
    kept = F.col("label_window_end") <= F.lit(as_of).cast("timestamp_ntz")
    return both.where(kept), both.where(~kept)


def entity_cutoffs(entities: DataFrame, key: str, cuts: DataFrame, created: str | None = None, where: str | None = None) -> DataFrame:
    """Every entity at every cutoff (at most 2,000, so they are broadcast), once it exists and passes `where`."""
    rows = entities.crossJoin(F.broadcast(cuts))
    if created is not None:
        rows = rows.where(F.col(created) < F.col("cutoff_time"))
    if where is not None:
        rows = rows.where(bound(where))
    return rows.select(F.col(key).alias("entity_id"), *cuts.columns)



def _lowest(rule: Rule) -> re.Match | None:
    """The bound below the rule's times, if that is all the rule asks."""
    return re.fullmatch(rf"\s*{re.escape(rule.time)}\s*>=\s*(:cutoff\s*-\s*interval\s+\d+\s+\w+)\s*", rule.where or "")


def _reach(spine: DataFrame, rule: Rule) -> DataFrame:
    """The rule's rows that some cutoff can see: before the latest one, and not before the earliest bound if that is all the rule asks."""
    lowest = _lowest(rule)
    ends = spine.agg(F.min(bound(lowest[1]) if lowest else F.col("cutoff_time")).alias("low"), F.max("cutoff_time").alias("high"))
    low, high = (None if v is None else F.lit(v).cast(ends.schema[n].dataType) for n, v in ends.select(*[F.col(n).cast("string") for n in ends.columns]).first().asDict().items())
    if high is None:
        return rule.table.where("false")
    rows = rule.table.where(F.col(rule.time) < high)
    return rows.where(F.col(rule.time) >= low) if lowest else rows


def _eligible(rule: Rule, entities: DataFrame, key: str, cuts: DataFrame) -> DataFrame | None:
    """The rows of entity_cutoffs(entities, key, cuts) for which the rule's row exists; None if the cutoffs are not few or the rule asks more than a span of time.

    A row of the rule's table tells the cutoffs that see it by the bits of a long, so an entity is one row until its cutoffs are known.
    """
    lowest = _lowest(rule)
    bounded = cuts.withColumn("_low", bound(lowest[1])) if lowest else cuts
    if not lowest or not all(isinstance(bounded.schema[n].dataType, T.TimestampNTZType) for n in ("cutoff_time", "_low")):
        return None
    rows = bounded.limit(FEW_CUTOFFS + 1).collect()
    if not 0 < len(rows) <= FEW_CUTOFFS:
        return None
    time, bits = F.col(rule.time), F.lit(0).cast("long")
    for i, r in enumerate(rows):
        low, high = (F.lit(None if r[n] is None else str(r[n])).cast("timestamp_ntz") for n in ("_low", "cutoff_time"))
        bits = bits.bitwiseOR(F.when((time >= low) & (time < high), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    seen = rule.table.select(F.col(rule.key).alias("_e"), bits.alias("_b")).where("_b != 0").groupBy("_e").agg(F.bit_or("_b").alias("_bits"))
    numbered = cuts.sparkSession.createDataFrame([(i, *[r[c] for c in cuts.columns]) for i, r in enumerate(rows)], T.StructType([T.StructField("_i", T.IntegerType()), *cuts.schema.fields]))
    found = entities.select(F.col(key).alias("entity_id")).join(seen.hint("merge"), F.col("entity_id") == F.col("_e"))
    return found.join(F.broadcast(numbered), F.expr("(_bits & shiftleft(1L, _i)) != 0")).select("entity_id", *cuts.columns)


def apply_rule(spine: DataFrame, rule: Rule, exists: bool = True, made_of: tuple[DataFrame, str, DataFrame] | None = None) -> DataFrame:
    """Spine rows for which the rule's row exists (semi join) or does not (anti join). made_of says that spine is entity_cutoffs(*made_of), whose other rows then need not be made."""
    found = _eligible(rule, *made_of) if made_of and exists else None
    if found is not None:
        return found
    names = {c: f"_r_{c}" for c in rule.table.columns}
    right = _reach(spine, rule).select(*[F.col(c).alias(n) for c, n in names.items()])
    near = (F.col("entity_id") == F.col(names[rule.key])) & (F.col(names[rule.time]) < F.col("cutoff_time"))
    if rule.where:
        text = rule.where
        for c in sorted(rule.table.columns, key=len, reverse=True):
            text = re.sub(rf"\b{re.escape(c)}\b", f"`{names[c]}`", text)
        # a bound that only depends on the cutoff is found once for a spine row, not for each pair
        bounds: dict[str, str] = {}
        text = re.sub(r":cutoff\s*[-+]\s*interval\s+\d+\s+\w+", lambda m: bounds.setdefault(m[0], f"`_bound{len(bounds)}`"), text)
        columns = spine.columns
        spine = spine.withColumns({n.strip("`"): bound(b) for b, n in bounds.items()})
        return spine.join(right, near & bound(text), "left_semi" if exists else "left_anti").select(*columns)
    return spine.join(right, near, "left_semi" if exists else "left_anti")


def window_ends(spine: DataFrame) -> list[tuple[int, int]] | None:
    """The distinct cutoffs with their window's end in microseconds; None if there are too many, or one cutoff has two ends."""
    pairs = spine.select(micros(F.col("cutoff_time")).alias("c"), micros(F.col("label_window_end")).alias("e")).where("c is not null").distinct().limit(MOST_CUTOFFS + 1).collect()
    if len(pairs) > MOST_CUTOFFS or len({r["c"] for r in pairs}) < len(pairs):
        return None
    return sorted((r["c"], r["e"]) for r in pairs)


def labels(spine: DataFrame, target: Target) -> DataFrame:
    """entity_id, cutoff_time, label, label_window_end; rows whose label is NULL are dropped.

    spine has entity_id, cutoff_time and label_window_end. Where every cutoff has one window end (a schedule), the work is
    linear in the target's rows (see `intervals`); rows with windows of their own are joined with theirs.
    """
    ends = window_ends(spine)
    if not ends or any(e is None for _, e in ends):
        return labels_by_join(spine, target)
    source = label_source(target, ends)
    if source is None:
        return labels_by_join(spine, target)
    found = aggregate(spine, source.rows, source.entity, source.time, [c for c, _ in ends], source.windows, source.measures)
    return closed(found, spine, target, ends)


#: The measure that a label is made of.
VALUE = "_value"


def _child(target: Target) -> DataFrame:
    rows = target.table.where(target.where) if target.where else target.table
    value = F.col(target.column) if target.column else F.lit(1)
    value = value.cast("string") if target.agg == "first" else value
    return rows.select(F.col(target.key).alias("_k"), F.col(target.time).alias("_t"), value.alias("_v"))


def label_source(target: Target, ends: list[tuple[int, int | None]]) -> Source | None:
    """The target's rows and the measure of its windows, by the ends of the cutoffs (None: an empty window); None if the windows are not ordered."""
    edges = [(c + 1, max(c, c if e is None else e) + 1) for c, e in ends]  # a window is (cutoff, end]; one that ends before it begins is empty
    if not ordered({"label": edges}):
        return None
    kind = {"avg": "mean", "count_distinct": "distinct"}.get(target.agg, target.agg)
    measure = Measure(VALUE, kind, "label", "_v is not null" if kind == "first" else None, None if kind == "count" else "_v", "_v" if kind == "first" else None)
    return Source(_child(target), "_k", "_t", {"label": edges}, [measure])


def closed(found: DataFrame, spine: DataFrame, target: Target, ends: list[tuple[int, int | None]]) -> DataFrame:
    """entity_id, cutoff_time, label, label_window_end and the other columns of found, which has the measure of `label_source`; rows without an end have no label."""
    kind = _child(target).select(_aggregates(target)).schema[0].dataType
    value = F.col(VALUE).cast(kind)
    value = F.coalesce(value, F.lit(0)) if target.agg in ("sum", "count") else value
    table = spine.sparkSession.createDataFrame(ends, "_c long, _e long")
    rows = found.withColumn("value", value).withColumn("_c", micros(F.col("cutoff_time"))).join(F.broadcast(table), "_c").withColumn("label_window_end", F.timestamp_micros("_e").cast("timestamp_ntz"))
    ended = _labelled(rows.where("_e is not null"), target)
    if any(e is None for _, e in ends):
        label = F.when(F.col("_e").isNotNull(), _label(target))
        ended = rows.where("_e is null or value is not null").withColumn("label", label)
    entity = F.col("entity_id").cast(spine.schema["entity_id"].dataType).alias("entity_id")
    return ended.select(entity, "cutoff_time", "label", "label_window_end", *[c for c in found.columns if c not in (*KEYS, VALUE)])


def _aggregates(target: Target) -> Column:
    return {
        "count": F.count("_k"),
        "sum": F.coalesce(F.sum("_v"), F.lit(0)),
        "avg": F.avg("_v"),
        "min": F.min("_v"),
        "max": F.max("_v"),
        "count_distinct": F.count_distinct("_v"),
        "first": F.min_by("_v", F.struct("_t", "_v")),
    }[target.agg]


def _label(target: Target) -> Column:
    if target.compare:
        op, limit = target.compare
        return F.expr(f"case when value {op} {limit} then 1 else 0 end")
    return F.col("value")


def _labelled(found: DataFrame, target: Target) -> DataFrame:
    return found.where("value is not null").withColumn("label", _label(target))


def labels_by_join(spine: DataFrame, target: Target) -> DataFrame:
    """`labels` with each row of the target's table paired with the windows it lies in.

    The child's scan is bounded by the earliest cutoff and the latest window end, which the residual range condition
    alone does not tell the scan.
    """
    low, high = spine.agg(F.min("cutoff_time"), F.max("label_window_end")).first()
    rows = target.table.where(target.where) if target.where else target.table
    if low is not None:
        rows = rows.where((F.col(target.time) > F.lit(low)) & (F.col(target.time) <= F.lit(high)))
    value = F.col(target.column) if target.column else F.lit(1)
    child = rows.select(F.col(target.key).alias("_k"), F.col(target.time).alias("_t"), value.alias("_v"))
    inside = (F.col("entity_id") == F.col("_k")) & (F.col("_t") > F.col("cutoff_time")) & (F.col("_t") <= F.col("label_window_end"))
    first = target.agg == "first"
    if first:
        child = child.where("_v is not null").withColumn("_v", F.col("_v").cast("string"))
    found = spine.join(child.hint("merge"), inside, "inner" if first else "left").groupBy("entity_id", "cutoff_time", "label_window_end").agg(_aggregates(target).alias("value"))
    return _labelled(found, target).select("entity_id", "cutoff_time", "label", "label_window_end")


def label_counts(rows: DataFrame, kind: str = "binary") -> DataFrame:
    """Per cutoff: binary eligible, positives, base_rate; regression n, mean, population std, zero_share; multiclass n per class."""
    if kind == "multiclass":
        return rows.groupBy("cutoff_time", "label").agg(F.count("*").alias("n"))
    if kind == "regression":
        y = F.col("label").cast("double")
        return rows.groupBy("cutoff_time").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.avg((y == 0).cast("double")).alias("zero_share"))
    return rows.groupBy("cutoff_time").agg(F.count("*").alias("eligible"), F.sum("label").cast("long").alias("positives"), F.avg("label").alias("base_rate"))


def coverage(spine: DataFrame, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """For each event table: of the entities at the first cutoff, how many have an earlier row in it."""
    first = spine.agg(F.min("cutoff_time").alias("m"))
    start = spine.join(F.broadcast(first), F.col("cutoff_time") == F.col("m"), "left_semi").select(*KEYS)
    out = None
    for name, (table, key, time) in tables.items():
        seen = apply_rule(start, Rule(table, key, time)).select("entity_id", F.lit(1).alias("s"))
        one = start.join(seen.hint("merge"), "entity_id", "left").agg(F.count("*").alias("eligible"), F.count("s").alias("covered")).select(F.lit(name).alias("table_name"), "eligible", "covered")
        out = one if out is None else out.union(one)
    return out


def latest_cutoff(times: list[tuple[DataFrame, str]]) -> DataFrame:
    """One row: the start of the day of the least of the tables' largest event times, and the largest of all."""
    maxima = None
    for df, c in times:
        one = df.agg(F.max(c).alias("t"))
        maxima = one if maxima is None else maxima.union(one)
    return maxima.agg(F.date_trunc("day", F.min("t")).cast("timestamp_ntz").alias("cutoff_time"), F.max("t").alias("data_end"))


def own_labels(df: DataFrame, entity: str, time: str, label: str, horizon_days: int) -> DataFrame:
    """Labels that the user brings; keys must be unique and present."""
    rows = df.select(F.col(entity).alias("entity_id"), F.col(time).alias("cutoff_time"), F.col(label).alias("label"))
    if rows.where("entity_id is null or cutoff_time is null").take(1):
        raise ValueError("entity and time must be present in every row")
    if rows.groupBy(*KEYS).count().where("count > 1").take(1):
        raise ValueError("(entity, time) must be unique")
    return rows.withColumn("label_window_end", (F.col("cutoff_time") + F.make_dt_interval(days=F.lit(horizon_days))).cast("timestamp_ntz"))
