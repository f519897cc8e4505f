"""Point-in-time features: all features of one path from one aggregation by segments of time.

A feature reads rows with `time < cutoff` only (and `time >= cutoff - days` with a window). `pit_join` adds these
bounds itself, so a feature cannot be written without them; it also bounds the child's scan by constants.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.operators.intervals import KEYS, Measure, Source, aggregate, aggregate_together, cutoff_times, few, merged
from tidemark.sources.shared import written

AGGREGATES = ("count", "count_distinct", "sum", "mean", "min", "max", "std", "days_since_last", "days_since_first", "share", "latest", "exists")
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "in", "is_null", "is_not_null")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object = None

    def column_expression(self) -> Column:
        c = F.col(self.column)
        if self.op not in OPERATORS:
            raise ValueError(f"where.op: {self.op} is none of {', '.join(OPERATORS)}")
        if self.op == "in" and len(self.value) > 50:
            raise ValueError("where.value: at most 50 values")
        return {
            "=": lambda: c == self.value,
            "!=": lambda: c != self.value,
            "<": lambda: c < self.value,
            "<=": lambda: c <= self.value,
            ">": lambda: c > self.value,
            ">=": lambda: c >= self.value,
            "in": lambda: c.isin(list(self.value)),
            "is_null": lambda: c.isNull(),
            "is_not_null": lambda: c.isNotNull(),
        }[self.op]()


@dataclass(frozen=True)
class Feature:
    """One aggregate of a path's rows before the cutoff.

    For `share` the filter is what is counted and every joined row is in the denominator, also the empty one of an
    entity without rows (empty="zero", giving 0, or 1 for is_null); empty="null" gives NULL there.
    """

    name: str
    agg: str
    column: str | None = None
    days: int | None = None
    where: tuple[Predicate, ...] = ()
    log1p: bool = False
    empty: str = "zero"

    def __post_init__(self) -> None:
        if self.agg not in AGGREGATES:
            raise ValueError(f"agg: {self.agg} is none of {', '.join(AGGREGATES)}")
        if self.days is not None and not 1 <= self.days <= 3650:
            raise ValueError("days: 1 to 3650")
        if len(self.where) > 5:
            raise ValueError("where: at most 5 predicates")
        if self.log1p and self.agg not in ("count", "count_distinct", "share", "std", "days_since_last", "days_since_first", "exists"):
            raise ValueError("log1p: only on aggregates that are never negative")


@dataclass(frozen=True)
class Path:
    """A source of rows: `key` joins to the entity, `time` is the event time that is bounded.

    For a path of several hops, join the tables beforehand (a child without a time of its own with its timed parent):
    that does not depend on the cutoff. Further timed hops on the way are listed in `also`. `sizes` is a table with the summed
    columns that is cheaper to read than `table`, has at least as many rows and all their values (the child of such a join).
    """

    table: DataFrame
    key: str
    time: str
    also: tuple[str, ...] = ()
    tie: str | None = None
    sizes: DataFrame | None = None


def pit_join(spine: DataFrame, path: Path, days: int | None = None) -> DataFrame:
    """spine left-joined with the path's rows before each cutoff; every spine row survives. Columns `_key` and `_t` are added."""
    keys = spine.select(*KEYS)
    low, high = keys.agg(F.min("cutoff_time"), F.max("cutoff_time")).first()
    rows = path.table.where(F.col(path.time).isNotNull())
    if high is not None:
        rows = rows.where(F.col(path.time) < F.lit(high))
        if days is not None:
            rows = rows.where(F.col(path.time) >= F.expr(f"timestamp_ntz '{low}' - interval {days} days"))
    rows = rows.withColumns({"_key": F.col(path.key), "_t": F.col(path.time)})
    near = (F.col("entity_id") == F.col("_key")) & (F.col("_t") < F.col("cutoff_time"))
    for c in path.also:
        near = near & (F.col(c) < F.col("cutoff_time"))
    if days is not None:
        near = near & (F.col("_t") >= F.col("cutoff_time") - F.make_dt_interval(days=F.lit(days)))
    return keys.join(rows, near, "left")


def seconds(c: Column) -> Column:
    """Whole seconds of a naive time (sessions run in UTC)."""
    return F.unix_seconds(c.cast("timestamp"))


def _aggregate(f: Feature, tie: str | None) -> Column:
    inside = F.col("_key").isNotNull()
    if f.days is not None:
        inside = inside & (F.col("_t") >= F.col("cutoff_time") - F.make_dt_interval(days=F.lit(f.days)))
    cond = F.lit(True)
    for p in f.where:
        cond = cond & p.column_expression()
    if f.agg == "share":
        hit = F.when(cond, 1.0).otherwise(0.0)
        if f.empty == "null":
            return F.avg(F.when(inside, hit))
        none = F.max(F.when(F.col("_key").isNull() & cond, 1.0).otherwise(0.0)) if f.days is None else F.lit(1.0 if all(p.op == "is_null" for p in f.where) else 0.0)
        return F.coalesce(F.avg(F.when(inside, hit)), none)
    on = inside & cond
    value = F.when(on, F.col(f.column)) if f.column else F.when(on, F.col("_key"))
    time = F.when(on, F.col("_t"))
    since = lambda t: (seconds(F.first("cutoff_time")) - seconds(t)) / F.lit(86400.0)
    made = {
        "count": lambda: F.count(F.when(on, F.col("_key"))),
        "count_distinct": lambda: F.count_distinct(value),
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0)),
        "mean": lambda: F.avg(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "std": lambda: F.stddev_samp(value),
        "days_since_last": lambda: since(F.max(time)),
        "days_since_first": lambda: since(F.min(time)),
        "latest": lambda: F.max_by(F.col(f.column), F.when(on, F.struct("_t", *([tie] if tie else [])))),
        "exists": lambda: F.max(F.when(on, 1).otherwise(0)),
    }[f.agg]()
    return F.log1p(made) if f.log1p else made


DAY = 86_400_000_000
_KINDS = {"count_distinct": "distinct", "days_since_last": "last_time", "days_since_first": "first_time", "latest": "last", "exists": "count", "share": "count"}


def compute(spine: DataFrame, path: Path, features: list[Feature]) -> DataFrame:
    """entity_id, cutoff_time and a column for each feature, in work linear in the path's rows (see `intervals`).

    Cutoffs of which each row may have its own (more than 2,000 different ones), and paths with several timed hops, are
    computed by the join instead.
    """
    cuts = None if path.also else cutoff_times(spine)
    if not cuts:
        return compute_by_join(spine, path, features)
    source = _source(path, features, cuts)
    found = aggregate(spine, source.rows, source.entity, source.time, cuts, source.windows, source.measures, source.sizes)
    return _typed(spine, found, [(path, features)])


def compute_paths(spine: DataFrame, paths: list[tuple[Path, list[Feature]]]) -> DataFrame:
    """`compute` of several paths side by side, in one aggregation if the cutoffs are few; no two features share a name."""
    cuts = None if any(p.also for p, _ in paths) else cutoff_times(spine)
    sources = [_source(p, f, cuts) for p, f in paths] if cuts else []
    if not cuts or not all(few(cuts, s) for s in sources):
        return wide(spine.select(*KEYS), [compute(spine, p, f) for p, f in paths])
    return _typed(spine, aggregate_together(spine, cuts, sources), paths)


def labelled(spine: DataFrame, target: lb.Target, paths: list[tuple[Path, list[Feature]]]) -> DataFrame:
    """`labels.labels` of the spine with the features of the paths, all from one aggregation if the cutoffs are few.

    Rows without a window end are kept: they have features and no label.
    """
    ends = lb.window_ends(spine)
    usable = bool(ends) and not any(p.also for p, _ in paths)
    cuts = [c for c, _ in ends] if usable else []
    source = lb.label_source(target, ends) if usable else None
    sources = [*[_source(p, f, cuts) for p, f in paths], *([source] if source else [])]
    if source and all(few(cuts, s) for s in sources):
        return lb.closed(_typed(spine, aggregate_together(spine, cuts, sources), paths, (lb.VALUE,)), spine, target, ends)
    rows = lb.labels(spine.where("label_window_end is not null"), target).unionByName(spine.where("label_window_end is null").select(*KEYS, "label_window_end"), allowMissingColumns=True)
    rows = written(rows, "labels")
    return wide(rows, [compute_paths(rows, paths)])


def _source(path: Path, features: list[Feature], cuts: list[int]) -> Source:
    """The path's rows and the measures of its features."""
    conditions = {w: f"_on{i}" for i, w in enumerate(dict.fromkeys(f.where for f in features if f.where))}
    added = {"_key": F.col(path.key), "_t": F.col(path.time).cast("timestamp_ntz")}
    for where, name in conditions.items():
        cond = F.lit(True)
        for p in where:
            cond = cond & p.column_expression()
        added[name] = F.coalesce(cond, F.lit(False))
    used = {c for f in features for c in (f.column, path.tie) if c}
    rows = path.table.withColumns(added).select("_key", "_t", *conditions.values(), *used)
    windows = {_window(f): [(None if f.days is None else c - f.days * DAY, c) for c in cuts] for f in features}
    measures = []
    for f in features:
        kind = _KINDS.get(f.agg, f.agg)
        needs = kind not in ("count", "last_time", "first_time")
        measures.append(Measure(f.name, kind, _window(f), conditions.get(f.where), (f.column or "_key") if needs else None, path.tie if kind == "last" else None))
        if f.agg == "share":
            measures.append(Measure(f"{f.name}/all", "count", _window(f)))
    return Source(rows, "_key", "_t", windows, measures, path.sizes)


def _typed(spine: DataFrame, found: DataFrame, paths: list[tuple[Path, list[Feature]]], kept: tuple[str, ...] = ()) -> DataFrame:
    """The features from their measures, in the types that the plain aggregates have, and the columns that are kept."""
    columns = []
    for path, features in paths:
        # a type depends on the aggregate and its column only
        plain = {(f.agg, f.column, f.log1p): replace(f, name=f"_f{i}", days=None, where=()) for i, f in enumerate(features)}
        typed = path.table.withColumns({"_key": F.col(path.key), "_t": F.col(path.time), "cutoff_time": F.lit(None).cast("timestamp_ntz")}).agg(*[_aggregate(f, path.tie).alias(f.name) for f in plain.values()]).schema
        columns += [_finished(f).cast(typed[plain[f.agg, f.column, f.log1p].name].dataType).alias(f.name) for f in features]
    return found.select(F.col("entity_id").cast(spine.schema["entity_id"].dataType).alias("entity_id"), "cutoff_time", *kept, *columns)


def _window(f: Feature) -> str:
    return "all" if f.days is None else f"d{f.days}"


def _finished(f: Feature) -> Column:
    """A feature from its measure."""
    c = F.col(f"`{f.name}`")
    if f.agg == "share":
        n = F.col(f"`{f.name}/all`")
        none = F.lit(None) if f.empty == "null" else F.lit(1.0 if all(p.op == "is_null" for p in f.where) else 0.0)
        c = F.when(n > 0, c / n).otherwise(none)
    elif f.agg == "exists":
        c = (c > 0).cast("int")
    elif f.agg == "sum":
        c = F.coalesce(c, F.lit(0))
    elif f.agg in ("days_since_last", "days_since_first"):
        c = (seconds(F.col("cutoff_time")) - seconds(c)) / F.lit(86400.0)
    return F.log1p(c) if f.log1p else c


def compute_by_join(spine: DataFrame, path: Path, features: list[Feature]) -> DataFrame:
    """`compute` with one join and one aggregation: each row is paired with the cutoffs after it."""
    days = None if any(f.days is None for f in features) else max(f.days for f in features)
    joined = pit_join(spine, path, days)
    return joined.groupBy(*KEYS).agg(*[_aggregate(f, path.tie).alias(f.name) for f in features])


def ratio(frame: DataFrame, name: str, over: str, under: str) -> DataFrame:
    """A column over / under of two features of the same frame, NULL at zero."""
    return frame.withColumn(name, F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")))


def entity_values(spine: DataFrame, entities: DataFrame, key: str, columns: list[str], time: str | None = None, age: str | None = None) -> DataFrame:
    """Columns of the entity's own row (bounded by its time, if it has one), and its age in days at the cutoff."""
    names = {c: f"_e_{c}" for c in entities.columns}
    right = entities.select(*[F.col(c).alias(n) for c, n in names.items()])
    near = F.col("entity_id") == F.col(names[key])
    if time:
        near = near & (F.col(names[time]) < F.col("cutoff_time"))
    out = spine.select(*KEYS).join(right, near, "left")
    more = [((seconds(F.col("cutoff_time")) - seconds(F.col(names[time]))) / F.lit(86400.0)).alias(age)] if age and time else []
    return out.select(*KEYS, *[F.col(names[c]).alias(c) for c in columns], *more)


def wide(spine: DataFrame, frames: list[DataFrame]) -> DataFrame:
    """spine with the columns of every path's frame: a join for each path, not for each feature."""
    out = spine
    for f in frames:
        out = merged(out, f, "left")
    return out


def running(spine: DataFrame, path: Path, sums: dict[str, str]) -> DataFrame:
    """All-history counts and sums in time linear in the events, however many cutoffs follow them.

    Events are assigned to the first of their entity's cutoffs after them, pre-aggregated there, and running totals are taken
    over the cutoffs. Gives the same as `compute` for count (column n) and sum.
    """
    from pyspark.sql import Window

    keys = spine.select(*KEYS)
    marks = keys.select("entity_id", F.col("cutoff_time").alias("at"), F.lit(1).alias("c"), *[F.lit(0.0).alias(n) for n in sums], F.lit(0).alias("n"))
    events = path.table.select(F.col(path.key).alias("entity_id"), F.col(path.time).alias("at"), F.lit(0).alias("c"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(n) for n, v in sums.items()], F.lit(1).alias("n"))
    events = events.join(keys.select("entity_id").distinct().hint("merge"), "entity_id", "left_semi").groupBy("entity_id", "at", "c").agg(*[F.sum(n).alias(n) for n in sums], F.sum("n").alias("n"))
    # at equal times the cutoff (c = 1) comes first: an event exactly then is not before it
    over = Window.partitionBy("entity_id").orderBy("at", F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(events)
    done = both.select("entity_id", F.col("at").alias("cutoff_time"), "c", F.sum("n").over(over).alias("n"), *[F.sum(s).over(over).alias(s) for s in sums])
    return done.where("c = 1").drop("c")
