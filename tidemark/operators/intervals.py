"""Aggregates of timed rows over one or several windows for each cutoff, in work linear in the rows.

All windows of all cutoffs have at most a few thousand distinct edges. They cut time into segments, and every window is
a run of whole segments. So the rows are first aggregated by (entity, segment), with map-side combination: whatever
follows sees at most as many rows for an entity as there are edges, also for an entity that holds a third of all rows,
and no row is ever paired with a cutoff. Then

- counts, sums, means and deviations are differences of running totals at a window's two edges;
- latest rows are running maxima at the upper edge, valid if they lie above the lower one; first rows of a window are running
  minima from the end back to its lower edge, valid if they lie below the upper one;
- extremes inside a window are two look-ups in a sparse table (extremes of 1, 2, 4, ... segments from each on);
- distinct counts add 1 for the range of cutoffs that see a value's occurrence but not the one before it, as
  differences that are summed over the cutoffs.

With at most FEW_CUTOFFS cutoffs the entity's segments are paired with its cutoffs instead and aggregated there (but for
first and last rows and extremes of texts): a segment meets at most so many cutoffs, and no row is made for an edge. The
segments of several tables then meet the cutoffs together.

Sums of doubles are split into multiples of two fixed powers of two, chosen from the largest value and the number of
rows, whose totals are exact in any order; so a difference of totals is as exact as the sum of the window's own rows, but for
parts below 1e-30 of (number of rows times largest value).
NaN and infinities are counted apart and put back. Deviations come from such sums of values and squares around the
column's approximate median; their relative error is about 1e-16 times the square of (mean of the window - median) / deviation,
and squares below 1e-30 of (number of rows times largest square) are lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import written

KEYS = ["entity_id", "cutoff_time"]
MOST_CUTOFFS = 2000
#: Up to so many cutoffs, segments are paired with them (each is a bit of a long).
FEW_CUTOFFS = 32
#: What the results of one task's keys take in memory, about.
TASK_BYTES = 32 << 20
#: A sum of squared deviations below this share of its terms can't be told from none.
ROUNDING = 2e-15
#: Edges of [low, high) in microseconds for each cutoff; low None is all history.
Edges = list[tuple[int | None, int]]


@dataclass(frozen=True)
class Measure:
    """One aggregate of the rows of `window` for which `on` holds.

    kind: count, sum, mean, std, min, max, distinct (of value), first or last (value of the first or last row by time and
    `tie`), first_time, last_time. `on` and `value` are SQL expressions or names of columns of the rows.
    """

    name: str
    kind: str
    window: str
    on: str | None = None
    value: str | None = None
    tie: str | None = None


@dataclass(frozen=True)
class Source:
    """Timed rows and what is aggregated of them, by the windows (edges for each cutoff) that the measures name.

    sizes stands in for the rows where only the summed values' sizes are asked: at least as many rows and all values.
    """

    rows: DataFrame
    entity: str
    time: str
    windows: dict[str, Edges]
    measures: list[Measure]
    sizes: DataFrame | None = None


def micros(time: Column) -> Column:
    """Microseconds of a naive time (sessions run in UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def merged(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by KEYS, never broadcast: millions of keys are a few MB as Parquet, which is all that Spark knows of a written table, and GBs on the driver."""
    return left.join(right.hint("merge"), KEYS, how)


def cutoff_times(keys: DataFrame) -> list[int] | None:
    """The distinct cutoffs in microseconds, ascending; None if there are more than MOST_CUTOFFS."""
    found = keys.select(micros(F.col("cutoff_time")).alias("c")).where("c is not null").distinct().limit(MOST_CUTOFFS + 1).collect()
    return None if len(found) > MOST_CUTOFFS else sorted(r["c"] for r in found)


def ordered(windows: dict[str, Edges]) -> bool:
    """Whether the edges of each window never go back from one cutoff to the next."""
    return all(a[1] <= b[1] and (a[0] is None or a[0] <= b[0]) for w in windows.values() for a, b in zip(w[:-1], w[1:], strict=True))


class Plan:
    """The edges of all windows in order, and where each window of each cutoff begins and ends among them."""

    def __init__(self, cutoffs: list[int], windows: dict[str, Edges]) -> None:
        self.cutoffs, self.windows = cutoffs, windows
        self.edges = sorted({e for w in windows.values() for pair in w for e in pair if e is not None})
        self.place = {e: i for i, e in enumerate(self.edges)}
        #: (window, side) of each mark of a cutoff; windows that share an edge at every cutoff share the mark
        self.marks, self.mark_of = [], {}
        for name, w in windows.items():
            for side in (0, 1):
                at = tuple(None if pair[side] is None else self.place[pair[side]] for pair in w)
                if at and at[0] is None:
                    self.mark_of[name, side] = None
                    continue
                if at not in self.marks:
                    self.marks.append(at)
                self.mark_of[name, side] = self.marks.index(at)

    def segment(self, rows: DataFrame, time: str, out: str) -> DataFrame:
        """rows with the number of edges at or before their time."""
        base = self.edges[0]
        splits = [-math.inf, *[float(e - base) for e in self.edges], math.inf]
        cut = Bucketizer(splits=splits, inputCol="_since", outputCol="_bucket", handleInvalid="skip")
        return cut.transform(rows.withColumn("_since", (micros(F.col(time)) - F.lit(base)).cast("double"))).withColumn(out, F.col("_bucket").cast("int")).drop("_since", "_bucket")

    def marked(self, keys: DataFrame) -> DataFrame:
        """keys with a row for each mark: `_w` its number and `_at` its edge (cutoffs are at most 2,000, so they are broadcast)."""
        table = keys.sparkSession.createDataFrame([(c, [m[i] for m in self.marks]) for i, c in enumerate(self.cutoffs)], "_c long, _marks array<int>")
        return keys.withColumn("_c", micros(F.col("cutoff_time"))).join(F.broadcast(table), "_c").select(*KEYS, F.posexplode("_marks").alias("_w", "_at"))


def _floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


Unit = tuple[float, float]


def unit_of(most: float, n: int) -> Unit:
    """The two powers of two whose multiples add up exactly over n values of at most this size."""
    room = math.ceil(math.log2(max(n, 1))) + 1
    coarse = max(math.frexp(most or 1.0)[1] + room - 52, -1000)
    return 2.0**coarse, 2.0 ** max(coarse + room - 53, -1060)


Spread = tuple[int, float, float, bool]


def spreads(rows: DataFrame, columns: dict[str, Column], centred: list[str]) -> dict[str, Spread]:
    """For each column the number of rows, the largest size of a finite value, for `centred` the approximate median, and whether all values are finite (one aggregate)."""
    if not columns:
        return {}
    finite = {n: F.when(F.abs(c) < math.inf, c.cast("double")) for n, c in columns.items()}
    odd = [F.count_if(F.coalesce(F.isnan(c.cast("double")) | (F.abs(c) == math.inf), F.lit(False))).alias(f"{n} odd") for n, c in columns.items()]
    r = rows.agg(F.count("*").alias("_n"), *odd, *[F.max(F.abs(c)).alias(n) for n, c in finite.items()], *[F.percentile_approx(finite[n], 0.5, 1000).alias(f"{n} mid") for n in centred]).first()
    return {n: (r["_n"], r[n] or 0.0, (r[f"{n} mid"] or 0.0) if n in centred else 0.0, r[f"{n} odd"] == 0) for n in columns}


def _exact(x: Column, unit: Unit) -> tuple[Column, Column]:
    """The totals of x in coarse and in fine units."""
    coarse = F.rint(x / F.lit(unit[0])) * F.lit(unit[0])
    return F.sum(coarse), F.sum(F.rint((x - coarse) / F.lit(unit[1])) * F.lit(unit[1]))


def _sums(kind: T.DataType, value: Column, spread: Spread | None) -> dict[str, Column]:
    """Per-segment totals of a value whose running differences are exact."""
    if not _floating(kind):
        return {"s": F.sum(value)}
    x = F.when(F.abs(value) < math.inf, value.cast("double"))
    coarse, fine = _exact(x, unit_of(spread[1], spread[0]))
    odd = {} if spread[3] else {"nan": F.isnan(value), "up": value == math.inf, "down": value == -math.inf}
    return {"s": coarse, "f": fine} | {n: F.count_if(F.coalesce(c, F.lit(False))) for n, c in odd.items()}


class Builder:
    """Collects, for a list of measures, the totals of segments, the running columns at marks, and the results."""

    def __init__(self, rows: DataFrame, time: str, plan: Plan, tag: str = "") -> None:
        self.rows, self.time, self.plan, self.tag = rows, time, plan, tag
        self.segments: dict[str, Column] = {}  # totals of a segment
        self.running: dict[str, Column] = {}  # what runs over them, by name
        self.extremes: dict[str, str] = {}  # segment column -> min or max
        self.kinds: dict[str, T.DataType] = {}
        self.spreads: dict[str, Spread] = {}
        self.wanted: set[tuple[str, int]] = set()
        self.tabled: dict[str, list[str]] = {}  # the extremes that are looked up for a window
        self.backward: dict[str, Column] = {}  # what runs from the last segment back
        self.asked: set[tuple[str, int]] = set()  # of those, what is wanted at which mark
        self.bounds: list[tuple[str, int]] = []  # windows and sides whose edges are compared with times
        self.keys: dict[tuple, str] = {}
        self.paired = False
        self.pairs: dict[str, tuple[str, str, int]] = {}  # of segments and cutoffs: column -> segment column, how, window

    def name(self, *what: object) -> str:
        return self.keys.setdefault(what, f"_x{self.tag}{len(self.keys)}")

    def on(self, m: Measure) -> Column:
        return F.expr(m.on) if m.on else F.lit(True)

    def value(self, m: Measure) -> Column:
        return F.when(self.on(m), F.expr(m.value))

    def total(self, m: Measure, what: str, made: Column) -> str:
        """A column that runs as a total."""
        n = self.name(m.on, m.value, what)
        self.segments[n] = made
        self.running[n] = F.sum(n)
        return n

    def at(self, n: str, window: str, side: int) -> Column | None:
        """A running column at a window's edge; None at the edge of all history."""
        mark = self.plan.mark_of[window, side]
        if mark is None:
            return None
        self.wanted.add((n, mark))
        return F.col(f"{n}_{mark}")

    def pair(self, n: str, how: str, window: str) -> str:
        """The column of a window's aggregate of a segment column."""
        w = list(self.plan.windows).index(window)
        self.pairs[f"{n}_{w}"] = n, how, w
        return f"{n}_{w}"

    def within(self, n: str, window: str) -> Column:
        """A total inside a window."""
        if self.paired:
            return F.expr(f"coalesce({self.pair(n, 'sum', window)}, 0)")
        marks = [self.plan.mark_of[window, side] for side in (0, 1)]
        self.wanted |= {(n, m) for m in marks if m is not None}
        low, high = (f"coalesce({n}_{m}, 0)" for m in marks)
        return F.expr(high if marks[0] is None else f"{high} - {low}")

    def result(self, m: Measure) -> Column:
        low = self.plan.mark_of[m.window, 0]
        if m.kind == "count":
            return self.within(self.total(m, "n", F.count_if(F.coalesce(self.on(m), F.lit(False)))), m.window)
        if m.kind in ("sum", "mean"):
            kind = self.kinds[m.value]
            count = self.within(self.total(m, "nn", F.count(self.value(m))), m.window)
            parts = {n: self.within(self.total(m, n, c), m.window) for n, c in _sums(kind, self.value(m), self.spreads.get(m.value)).items()}
            s = parts["s"]
            if "f" in parts:
                s = s + parts["f"]
            if "nan" in parts:
                wrong = (parts["nan"] > 0) | ((parts["up"] > 0) & (parts["down"] > 0))
                s = F.when(wrong, F.lit(math.nan)).when(parts["up"] > 0, F.lit(math.inf)).when(parts["down"] > 0, F.lit(-math.inf)).otherwise(s)
            return F.when(count > 0, s if m.kind == "sum" else s / count)
        if m.kind == "std":
            n_rows, most, mid, finite = self.spreads[m.value]
            x = self.value(m).cast("double")
            off, reach = F.when(F.abs(x) < math.inf, x) - F.lit(mid), most + abs(mid)
            made = {"dn": F.count(off)} | ({} if finite else {"do": F.count(self.value(m)) - F.count(off)})
            made |= dict(zip(("da", "df"), _exact(off, unit_of(reach, n_rows)), strict=True)) | dict(zip(("db", "dg"), _exact(off * off, unit_of(reach * reach, n_rows)), strict=True))
            got = {k: self.within(self.total(m, k, c), m.window) for k, c in made.items()}
            n, a, b = got["dn"], got["da"] + got["df"], got["db"] + got["dg"]
            squares = b - a * a / n
            lost = n * F.lit(unit_of(reach * reach, n_rows)[1])
            squares = F.when((squares > b * F.lit(ROUNDING)) & (squares > lost), squares).otherwise(F.lit(0.0))
            odd = got.get("do", F.lit(0))
            return F.when(n + odd >= 2, F.when(odd > 0, F.lit(math.nan)).otherwise(F.sqrt(squares / (n - 1))))
        row = F.when(self.on(m), F.struct(F.col(self.time).alias("t"), (F.col(m.tie) if m.tie else F.lit(0)).alias("tie"), F.expr(m.value).alias("v"))) if m.kind in ("first", "last") else None
        made = {"min": lambda: self.value(m), "max": lambda: self.value(m), "first": lambda: row, "last": lambda: row}.get(m.kind, lambda: F.when(self.on(m), F.col(self.time)))()
        most = m.kind in ("max", "last", "last_time")
        n = self.name(m.on, m.value, m.tie, "most" if most else "least", "row" if row is not None else m.kind in ("min", "max"))
        self.segments[n] = (F.max if most else F.min)(made)
        if self.paired:
            return F.col(self.pair(n, "max" if most else "min", m.window))
        if low is None or m.kind in ("last", "last_time"):  # the running extreme at the upper edge
            self.running[n] = (F.max if most else F.min)(n)
            found = self.at(n, m.window, 1)
            if low is not None:  # valid if it lies inside
                time = micros(found["t"] if row is not None else found)
                self.bounds.append((m.window, 0))
                found = F.when(time >= F.col(f"_edge0_{m.window}"), found)
        elif m.kind in ("first", "first_time"):  # the running extreme back to the lower edge, valid if it lies inside
            self.backward[f"{n}_back"] = F.min(n)
            self.asked.add((f"{n}_back", low))
            self.bounds.append((m.window, 1))
            found = F.col(f"{n}_back_{low}")
            found = F.when(micros(found["t"] if row is not None else found) < F.col(f"_edge1_{m.window}"), found)
        else:
            self.extremes[n] = "max" if most else "min"
            self.tabled.setdefault(m.window, []).append(n)
            found = F.col(f"{n}@{m.window}")
        return found["v"] if row is not None else found


def _looked_up(places: DataFrame, segments: DataFrame, builder: Builder) -> DataFrame:
    """KEYS and the extreme columns `segment column@window`: two look-ups for each window in tables of 2^j segments.

    places has the number of the entity's segments up to each edge.
    """
    plan, names = builder.plan, list(builder.extremes)
    over = Window.partitionBy("entity_id").orderBy("_at")
    table = segments.select("entity_id", "_at", F.struct(*names).alias("_t0")).withColumn("_k", F.row_number().over(over).cast("long"))
    levels = max(1, (len(plan.edges) + 1).bit_length())
    for j in range(1, levels):
        ahead, now = F.lead(f"_t{j - 1}", 1 << (j - 1)).over(over), F.col(f"_t{j - 1}")
        both = [(F.least if builder.extremes[n] == "min" else F.greatest)(now[n], F.coalesce(F.col("_next")[n], now[n])).alias(n) for n in names]
        table = table.withColumn("_next", ahead).withColumn(f"_t{j}", F.struct(*both)).drop("_next")
    table = table.select("entity_id", "_k", F.array(*[f"_t{j}" for j in range(levels)]).alias("_t"))
    asked = []
    for i, w in enumerate(builder.tabled):
        low, high = (F.coalesce(F.col(f"_k_{plan.mark_of[w, s]}"), F.lit(0)) for s in (0, 1))
        j = F.length(F.bin(high - low)) - 1
        side = lambda k: F.struct(F.lit(i).alias("w"), j.alias("j"), k.alias("k"))  # noqa: B023, E731
        asked.append(F.when(high > low, F.array(side(low + 1), side(high - F.pow(F.lit(2.0), j).cast("long") + 1))))  # noqa: B023
    each = places.select(*KEYS, F.explode(F.flatten(F.array_compact(F.array(*asked)))).alias("_q")).select(*KEYS, F.col("_q.w").alias("_w"), F.col("_q.j").alias("_j"), F.col("_q.k").alias("_k"))
    got = each.join(table.hint("merge"), ["entity_id", "_k"]).withColumn("_v", F.get("_t", F.col("_j")))
    columns = [(F.min if how == "min" else F.max)(F.when(F.col("_w") == i, F.col("_v")[n])).alias(f"{n}@{w}") for i, (w, some) in enumerate(builder.tabled.items()) for n in dict.fromkeys(some) for how in [builder.extremes[n]]]
    return merged(places.select(*KEYS), got.groupBy(*KEYS).agg(*columns), "left")


def _distinct(keys: DataFrame, rows: DataFrame, builder: Builder, measures: list[Measure], entity: str) -> DataFrame:
    """keys with the distinct counts of measures that share `on` and `value`."""
    plan, m = builder.plan, measures[0]
    seen = rows.select(F.col(entity).alias("entity_id"), builder.value(m).alias("_v"), "_at").where("_v is not null").groupBy("entity_id", "_v", "_at").agg(F.lit(1).alias("_1"))
    before = F.lag("_at").over(Window.partitionBy("entity_id", "_v").orderBy("_at"))
    seen = seen.withColumn("_before", before)
    end, n = len(plan.cutoffs), len(plan.edges) + 1
    first = lambda at, s: next((c for c, p in enumerate(at) if p is not None and p >= s), end)
    table = []
    for s in range(n):
        line = []
        for x in measures:
            w = plan.windows[x.window]
            low = [None if a is None else plan.place[a] for a, _ in w]
            line.append((first([plan.place[b] for _, b in w], s), first(low, s)))
        table.append((s, line))
    edges = keys.sparkSession.createDataFrame(table, "_s int, _e array<struct<shown:int,gone:int>>")  # a row for each edge
    found = seen.join(F.broadcast(edges), F.col("_at") == F.col("_s")).drop("_s").withColumnRenamed("_e", "_now").join(F.broadcast(edges), F.col("_before") == F.col("_s"), "left")
    changes = []
    for i in range(len(measures)):
        now, old = F.col("_now")[i], F.get("_e", F.lit(i))
        start = F.greatest(now["shown"], F.coalesce(old["gone"], F.lit(0)))
        step = lambda c, v: F.struct(c.alias("c"), F.lit(i).alias("i"), F.lit(v).alias("v"))  # noqa: B023, E731
        changes.append(F.when((start < now["gone"]) & (start < end), F.array(step(start, 1), step(now["gone"], -1))))
    moved = found.select("entity_id", F.explode(F.flatten(F.array_compact(F.array(*changes)))).alias("_m"))
    sums = moved.groupBy("entity_id", F.col("_m.c").alias("_c")).agg(*[F.sum(F.when(F.col("_m.i") == i, F.col("_m.v"))).alias(f"_d{i}") for i in range(len(measures))])
    place = keys.sparkSession.createDataFrame(list(enumerate(plan.cutoffs)), "_c int, _micros long")
    marks = keys.withColumn("_micros", micros(F.col("cutoff_time"))).join(F.broadcast(place), "_micros").select(*KEYS, "_c")
    both = sums.withColumns({"cutoff_time": F.lit(None).cast("timestamp_ntz"), "_mark": F.lit(0)}).unionByName(marks.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    over = Window.partitionBy("entity_id").orderBy("_c", "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.select(*KEYS, "_mark", *[F.coalesce(F.sum(f"_d{i}").over(over), F.lit(0)).alias(x.name) for i, x in enumerate(measures)])
    return run.where("_mark = 1").drop("_mark")


def _seen(rows: DataFrame, entity: str, time: str, windows: dict[str, Edges]) -> DataFrame:
    """The rows that some window can hold; gaps between windows are left out if few ranges tell them."""
    t, at = micros(F.col(time)), F.lit
    if isinstance(rows.schema[time].dataType, T.TimestampNTZType):  # then the bounds are constants that reach the scan
        t, at = F.col(time), lambda m: F.timestamp_micros(F.lit(m)).cast("timestamp_ntz")
    pairs = sorted({e for w in windows.values() for e in w if e[0] is not None and e[0] < e[1]})
    kept = F.col(entity).isNotNull() & F.col(time).isNotNull()
    if any(e[0] is None for w in windows.values() for e in w):
        return rows.where(kept & (t < at(max(e[1] for w in windows.values() for e in w))))
    ranges: list[tuple[int, int]] = []
    for low, high in pairs:
        if ranges and low <= ranges[-1][1]:
            ranges[-1] = ranges[-1][0], max(high, ranges[-1][1])
        else:
            ranges.append((low, high))
    if not 0 < len(ranges) <= FEW_CUTOFFS:
        ranges = [(min(e[0] for w in windows.values() for e in w), max(e[1] for w in windows.values() for e in w))]
    near = F.lit(False)
    for low, high in ranges:
        near = near | ((t >= at(low)) & (t < at(high)))
    return rows.where(kept & near)


def _begun(source: Source, plan: Plan, tag: str = "") -> tuple[Builder, DataFrame]:
    """The builder of a source and its rows in segments; the source's measures are not yet asked."""
    rows, measures = _seen(source.rows, source.entity, source.time, source.windows), source.measures
    b = Builder(rows, source.time, plan, tag)
    b.kinds = {m.value: rows.select(F.expr(m.value).alias("v")).schema["v"].dataType for m in measures if m.value}
    centred = list(dict.fromkeys(m.value for m in measures if m.kind == "std"))
    summed = [m.value for m in measures if m.kind in ("sum", "mean") and _floating(b.kinds[m.value])]
    b.spreads = spreads(rows if source.sizes is None else source.sizes, {c: F.expr(c) for c in dict.fromkeys([*summed, *centred])}, centred)
    return b, plan.segment(rows, source.time, "_at")


def few(cutoffs: list[int], source: Source) -> bool:
    """Whether the source's segments can be paired with the cutoffs."""
    kinds = {m.value: source.rows.select(F.expr(m.value).alias("v")).schema["v"].dataType for m in source.measures if m.value}
    return 0 < len(cutoffs) <= FEW_CUTOFFS and all(m.kind != "distinct" and _fixed(m, kinds) for m in source.measures)


def aggregate_together(keys: DataFrame, cutoffs: list[int], sources: list[Source]) -> DataFrame:
    """`aggregate` of several sources for the same keys, each of them `few`: their segments meet the cutoffs in one join.

    A window's name stands for the same edges in all sources, and no two measures share a name.
    """
    plan = Plan(cutoffs, {n: w for s in sources for n, w in s.windows.items()})
    made = []
    for i, source in enumerate(sources):
        b, cut = _begun(source, plan, f"{i}_")
        b.paired = True
        made.append((b, {m.name: b.result(m) for m in source.measures}, _segments(source, b, cut)))
    return _paired(keys.select(*KEYS), made)


def aggregate(keys: DataFrame, rows: DataFrame, entity: str, time: str, cutoffs: list[int], windows: dict[str, Edges], measures: list[Measure], sizes: DataFrame | None = None) -> DataFrame:
    """entity_id, cutoff_time and a column for each measure; keys are unique and all of them come back.

    windows has, by name, the edges for each of the cutoffs (in microseconds, ascending). Rows without an entity or a
    time are in no window. For sizes see Source.
    """
    if not cutoffs:
        return keys.select(*KEYS, *[F.lit(None).alias(m.name) for m in measures])
    source = Source(rows, entity, time, windows, measures, sizes)
    plan = Plan(cutoffs, windows)
    b, cut = _begun(source, plan)
    plain = [m for m in measures if m.kind != "distinct"]
    b.paired = len(cutoffs) <= FEW_CUTOFFS and all(_fixed(m, b.kinds) for m in plain)
    results = {m.name: b.result(m) for m in plain}
    out = keys.select(*KEYS)
    if b.extremes or b.wanted and b.asked or len(plain) < len(measures):  # several parts read the keys
        out = keys = written(out, "keys")
    if plain:
        out = _paired(out, [(b, results, _segments(source, b, cut))]) if b.paired else _plain(out, cut, b, results, entity)
    distinct: dict[tuple, list[Measure]] = {}
    for m in measures:
        if m.kind == "distinct":
            distinct.setdefault((m.on, m.value), []).append(m)
    for some in distinct.values():
        out = merged(out, _distinct(keys.select(*KEYS), cut, b, some, entity), "left")
    return out.select(*KEYS, *[m.name for m in measures])


def _fixed(m: Measure, kinds: dict[str, T.DataType]) -> bool:
    """Whether a measure runs in columns of fixed width, which are aggregated by hash."""
    if m.kind in ("min", "max"):
        return isinstance(kinds[m.value], (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return m.kind not in ("first", "last")


def _segments(source: Source, b: Builder, cut: DataFrame) -> DataFrame:
    """`_e`, `_at` and the totals of an entity's segment."""
    return cut.groupBy(F.col(source.entity).alias("_e"), "_at").agg(*[c.alias(n) for n, c in b.segments.items()])


def _paired(keys: DataFrame, made: list[tuple[Builder, dict[str, Column], DataFrame]]) -> DataFrame:
    """The results for few cutoffs: an entity's segments meet those of its cutoffs in whose widest window they lie.

    made has the builder, results and segments of each source. The cutoffs of an entity travel as the bits of a long, and
    the keys are dealt to so many tasks that the results of each take about TASK_BYTES, however many keys there are.
    """
    plan, spark = made[0][0].plan, keys.sparkSession
    pairs = {name: p for b, _, _ in made for name, p in b.pairs.items()}
    used = sorted({w for _, _, w in pairs.values()})
    edges = [[e[i] for e in plan.windows.values()] for i in range(len(plan.cutoffs))]
    sides = [[(-1 if e[w][0] is None else plan.place[e[w][0]], plan.place[e[w][1]]) for w in used] for e in edges]
    rows = [(c, i, min(x for x, _ in s), max(y for _, y in s), *[v for side in s for v in side]) for i, (c, s) in enumerate(zip(plan.cutoffs, sides, strict=True))]
    table = F.broadcast(spark.createDataFrame(rows, ", ".join(["_c long, _i int, _low int, _high int", *[f"_l{w} int, _h{w} int" for w in used]])))  # a row for each cutoff
    tasks = max(1, math.ceil(keys.count() * (len(pairs) + 4) * 8 / TASK_BYTES))
    bits = keys.withColumn("_c", micros(F.col("cutoff_time"))).join(table.select("_c", "_i"), "_c").groupBy("entity_id").agg(F.expr("bit_or(shiftleft(1L, _i))").alias("_bits"))
    each = bits.repartition(tasks, "entity_id").join(table, F.expr("(_bits & shiftleft(1L, _i)) != 0"))
    segments = made[0][2]
    for _, _, more in made[1:]:
        segments = segments.unionByName(more, allowMissingColumns=True)
    segments = segments.repartition(tasks, "_e")
    near = (F.col("entity_id") == F.col("_e")) & (F.col("_at") > F.col("_low")) & (F.col("_at") <= F.col("_high"))
    columns = [F.expr(f"{how}(case when _at > _l{w} and _at <= _h{w} then {n} end) as {name}") for name, (n, how, w) in pairs.items()]
    out = each.join(segments.hint("merge"), near, "left").groupBy("entity_id", "_c").agg(*columns)
    time = F.timestamp_micros("_c").cast(keys.schema["cutoff_time"].dataType)
    return out.withColumn("cutoff_time", time).select(*KEYS, *[c.alias(n) for _, results, _ in made for n, c in results.items()])


def _at_marks(marks: DataFrame, segments: DataFrame, running: dict[str, Column], wanted: set[tuple[str, int]], back: bool = False) -> DataFrame:
    """KEYS and, for each (name, mark) wanted, the running column there; `back` runs from the last segment to the mark."""
    used = {w for _, w in wanted}
    both = segments.withColumn("_mark", F.lit(0)).unionByName(marks.where(F.col("_w").isin(*used)).withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy("entity_id").orderBy(*([F.desc("_at"), F.desc("_mark")] if back else ["_at", "_mark"]), "cutoff_time")
    over = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [c.over(over).alias(n) for n, c in running.items()]
    if len(used) == 1:  # a key has one row, and a repeated key lies beside its copy
        run = both.select(*KEYS, "_mark", *columns, F.lag("cutoff_time").over(by).alias("_before")).where("_mark = 1 and not (_before <=> cutoff_time)")
        return run.select(*KEYS, *[F.col(n).alias(f"{n}_{w}") for n, w in sorted(wanted)])
    run = both.select(*KEYS, "_w", "_mark", *columns).where("_mark = 1")
    return run.groupBy(*KEYS).agg(*[F.expr(f"max(case when _w = {w} then {n} end) as {n}_{w}") for n, w in sorted(wanted)])


def _plain(keys: DataFrame, cut: DataFrame, b: Builder, results: dict[str, Column], entity: str) -> DataFrame:
    plan = b.plan
    segments = cut.groupBy(entity, "_at").agg(*[c.alias(n) for n, c in b.segments.items()]).withColumnRenamed(entity, "entity_id")
    marks, out = plan.marked(keys), None
    if b.extremes or b.wanted and b.asked:  # read for the totals, both ways, for the places of segments and for the table
        segments = written(segments, "segments")
    if b.wanted:
        out = _at_marks(marks, segments, b.running, b.wanted)
    if b.asked:
        found = _at_marks(marks, segments, b.backward, b.asked, back=True)
        out = found if out is None else merged(out, found)
    if b.extremes:
        places = {("_k", plan.mark_of[w, side]) for w in b.tabled for side in (0, 1)}
        ones = segments.select("entity_id", "_at", F.lit(1).cast("long").alias("_one"))
        found = _looked_up(_at_marks(marks, ones, {"_k": F.sum("_one")}, places), segments, b)
        out = found if out is None else merged(out, found)
    if b.bounds:
        bounds = list(dict.fromkeys(b.bounds))
        table = keys.sparkSession.createDataFrame([(c, *[plan.windows[w][i][side] for w, side in bounds]) for i, c in enumerate(plan.cutoffs)], ", ".join(["_c long", *[f"_edge{side}_{w} long" for w, side in bounds]]))
        out = out.withColumn("_c", micros(F.col("cutoff_time"))).join(F.broadcast(table), "_c")
    return out.select(*KEYS, *[c.alias(n) for n, c in results.items()])
