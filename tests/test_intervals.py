"""Windows in linear work: equal to the join for every aggregate, flat in the cutoffs, and even under one hot entity."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as fs
from tidemark.operators import intervals
from tidemark.operators import labels as lb
from tidemark.operators.features import Feature, Path, Predicate
from tidemark.operators.labels import Target

DAYS = (None, 3, 90)
WHERE = (Predicate("kind", "in", ("a", "b")), Predicate("x", "is_not_null"))


def every_feature():
    out = []
    for d in DAYS:
        for agg, column in (("count", None), ("count_distinct", "kind"), ("count_distinct", "x"), ("sum", "x"), ("sum", "n"), ("mean", "x"), ("mean", "n"), ("std", "x"), ("min", "x"), ("max", "kind"), ("min", "n"), ("days_since_last", None), ("days_since_first", None), ("latest", "kind"), ("latest", "x"), ("exists", None)):
            for i, where in enumerate(((), WHERE)):
                out.append(Feature(f"{agg}_{column}_{d}_{i}", agg, column, d, where))
        out += [Feature(f"share_{d}_{e}", "share", None, d, (Predicate("kind", "=", "a"),), empty=e) for e in ("zero", "null")]
        out += [Feature(f"nulls_{d}", "share", None, d, (Predicate("kind", "is_null"),)), Feature(f"log_{d}", "count", None, d, log1p=True)]
    return out


def events(spark, n, seed=1, odd=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35
        t = f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d} {rng.choice(['00:00:00', '12:30:15.000001', '23:59:59.999999'])}"
        x = rng.choice([None, 0.1, -2.5, 1e-3, 1234.5, 7.0, 1e6])
        if odd and rng.random() < 0.1:
            x = rng.choice([math.nan, math.inf, -math.inf, 1e7])
        rows.append((i, 1 if hot else rng.choice([None, *range(2, 15)]), None if rng.random() < 0.02 else t, rng.choice([None, "a", "b", "c"]), x, rng.choice([None, 1, 5, -3])))
    return spark.createDataFrame(rows, "id long, who int, at string, kind string, x double, n int").withColumn("at", F.col("at").cast("timestamp_ntz"))


def spine(spark, every=1, unit="months", end="2024-12-01"):
    people = spark.createDataFrame([(i,) for i in range(1, 18)], "who int")
    return lb.entity_cutoffs(people, "who", lb.windows(lb.cutoffs(spark, "2024-01-01", end, every, unit), 45, "2030-01-01", until="2024-11-20")[0])


def same(a, b, within=1e-9):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= within * max(1.0, abs(a), abs(b))
    return a == b


def test_every_aggregate_equals_the_join(spark):
    path = Path(events(spark, 600, odd=True), "who", "at", tie="id")
    feats = every_feature()
    keys = spine(spark).select(*lb.KEYS)
    fast, slow = fs.compute(keys, path, feats), fs.compute_by_join(keys, path, feats)
    assert fast.dtypes == slow.dtypes
    a, b = ({(r.entity_id, r.cutoff_time): r for r in x.collect()} for x in (fast, slow))
    assert a.keys() == b.keys() and len(a) == 17 * 12
    wrong = [(k, f.name, a[k][f.name], b[k][f.name]) for k in a for f in feats if not same(a[k][f.name], b[k][f.name], 1e-6 if f.agg == "std" else 1e-9)]
    assert not wrong, wrong[:5]


def test_sums_of_windows_are_exact_beside_large_values(spark):
    rows = [(1, 1, "2024-01-05", 1e18), (2, 1, "2024-02-05", 0.1), (3, 1, "2024-02-06", 0.2)]
    df = spark.createDataFrame(rows, "id long, who int, at string, x double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    keys = spine(spark).select(*lb.KEYS).where("entity_id = 1 and cutoff_time = timestamp_ntz '2024-03-01'")
    more = spine(spark).select(*lb.KEYS).where("entity_id = 1")
    for k in (keys, more):
        r = fs.compute(k, Path(df, "who", "at"), [Feature("s", "sum", "x", 30), Feature("m", "mean", "x", 30)]).where("cutoff_time = timestamp_ntz '2024-03-01'").first()
        assert abs(r.s - 0.3) < 1e-11 and abs(r.m - 0.15) < 1e-11


@pytest.mark.parametrize("agg,column", [("count", None), ("sum", "n"), ("sum", "x"), ("avg", "x"), ("min", "x"), ("max", "n"), ("count_distinct", "kind"), ("first", "kind")])
def test_labels_equal_the_join(spark, agg, column):
    keys = spine(spark)
    target = Target(events(spark, 500, 2), "who", "at", agg, column, "n is null or n > -5")
    fast, slow = lb.labels(keys, target), lb.labels_by_join(keys, target)
    assert fast.dtypes == slow.dtypes
    a, b = ({(r.entity_id, r.cutoff_time): (r.label, r.label_window_end) for r in x.collect()} for x in (fast, slow))
    assert a.keys() == b.keys() and all(same(a[k][0], b[k][0]) and a[k][1] == b[k][1] for k in a)


def test_dates_and_text_keys(spark):
    df = events(spark, 200, 3).withColumns({"who": F.col("who").cast("string"), "at": F.to_date("at")})
    keys = spine(spark).select(F.col("entity_id").cast("string").alias("entity_id"), "cutoff_time")
    feats = [Feature("n", "count", days=30), Feature("last", "days_since_last"), Feature("kinds", "count_distinct", "kind", 30)]
    path = Path(df, "who", "at", tie="id")
    assert sorted(fs.compute(keys, path, feats).collect()) == sorted(fs.compute_by_join(keys, path, feats).collect())


def test_no_rows_and_no_cutoffs(spark):
    path = Path(events(spark, 20).where("false"), "who", "at", tie="id")
    feats = [f for f in every_feature() if f.days == 90 and not f.where]
    keys = spine(spark).select(*lb.KEYS)
    assert sorted(fs.compute(keys, path, feats).collect()) == sorted(fs.compute_by_join(keys, path, feats).collect())
    assert fs.compute(keys.where("false"), path, feats).count() == 0


def shuffled_rows(df):
    """Rows written by all exchanges of a query that has run."""
    df._jdf.queryExecution().executedPlan().execute().count()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.length())]
    return total


def test_rows_shuffled_do_not_grow_with_events_times_cutoffs(spark):
    """Five times the cutoffs over 20,000 rows of few entities: the join pairs them all, segments do not."""
    many = events(spark, 20_000, 4)
    feats = [Feature("n", "count"), Feature("s", "sum", "n", 90), Feature("m", "min", "x", 90), Feature("d", "count_distinct", "kind", 90), Feature("l", "latest", "kind", 90)]
    few, lots = (shuffled_rows(fs.compute(spine(spark, e, u).select(*lb.KEYS), Path(many, "who", "at", tie="id"), feats)) for e, u in ((1, "months"), (6, "days")))
    assert few < 20_000 and lots < 20_000 * 2
    joined = fs.pit_join(spine(spark, 6, "days").select(*lb.KEYS), Path(many, "who", "at"))
    assert joined.count() > 400_000


def test_a_hot_entity_is_aggregated_before_it_is_dealt(spark):
    """A third of all rows under one entity: after the first aggregation it has at most a row for each segment and task."""
    many = events(spark, 20_000, 5)
    cuts = intervals.cutoff_times(spine(spark))
    plan = intervals.Plan(cuts, {"w": [(c - 30 * fs.DAY, c) for c in cuts]})
    rows = plan.segment(many.where("at is not null and who is not null"), "at", "_at")
    per = rows.groupBy("who", "_at").count()
    assert per.where("who = 1").count() <= len(plan.edges) + 1 and rows.where("who = 1").count() > 6000
    assert shuffled_rows(per) <= 4 * 14 * (len(plan.edges) + 1)


def joins_by_key(df) -> list[str]:
    """The joins of a plan whose keys include the entity."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x.strip(" :+-") for x in lines if "Join [entity_id" in x]


def test_keys_are_never_broadcast(spark):
    """A written table of keys is a few MB as Parquet with millions of rows; its size does not tell what it takes on the driver."""
    orders = spark.sql("select id as k, timestamp_ntz '2024-01-05' + make_dt_interval(cast(id % 20 as int)) as t, id % 3 as v, double(id) as x from range(60)")
    cuts, _ = lb.windows(lb.cutoffs(spark, "2024-01-06", "2024-01-20", 7, "days"), 5, "2024-03-01")
    spine = lb.entity_cutoffs(spark.range(60), "id", cuts)
    distinct = lb.labels(spine, lb.Target(orders, "k", "t", agg="count_distinct", column="v"))
    path = fs.Path(orders, "k", "t")
    both = fs.compute(spine, path, [fs.Feature("n", "count_distinct", "v", 9), fs.Feature("low", "min", "x", 9), fs.Feature("total", "sum", "x")])
    for df in (distinct, both, fs.wide(spine, [both])):
        assert joins_by_key(df)
        assert not [x for x in joins_by_key(df) if x.startswith("Broadcast")]


def test_first_labels_without_look_ups(spark):
    """The first row of a window comes from one pass back over its entity's segments: no join by key, equal to the join, ties and repeated keys included."""
    rows = events(spark, 300).withColumn("kind", F.when(F.col("id") % 7 > 0, F.col("kind")))
    cuts, _ = lb.windows(lb.cutoffs(spark, "2024-02-01", "2024-11-01", 1, "months"), 45, "2025-03-01")
    spine = lb.entity_cutoffs(spark.sql("select explode(sequence(1, 16)) as who union all select 3"), "who", cuts)
    target = Target(rows, "who", "at", agg="first", column="kind")
    got = lb.labels(spine, target)
    assert not joins_by_key(got)
    want = lb.labels_by_join(spine, target)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 30


def numeric_features():
    made = (("count", None), ("sum", "x"), ("sum", "n"), ("mean", "x"), ("std", "x"), ("min", "x"), ("max", "n"), ("days_since_last", None), ("days_since_first", None), ("exists", None))
    return [Feature(f"{a}_{c}_{d}_{i}", a, c, d, w) for d in DAYS for a, c in made for i, w in enumerate(((), WHERE))]


def test_few_cutoffs_are_paired_with_segments(spark):
    """Equal to the join, with repeated keys, a missing entity and entities without rows; no row for each edge of a key runs through a window."""
    path, feats = Path(events(spark, 600, odd=True), "who", "at", tie="id"), numeric_features()
    keys = spine(spark).select(*lb.KEYS)
    more = keys.union(keys.where("entity_id = 3")).union(keys.where("entity_id = 4").withColumn("entity_id", F.lit(None).cast("int")))
    fast, slow = fs.compute(more, path, feats), fs.compute_by_join(more.distinct(), path, feats)
    assert fast.dtypes == slow.dtypes
    a, b = ({(r.entity_id, r.cutoff_time): r for r in x.collect()} for x in (fast, slow))
    assert a.keys() == b.keys() and len(a) == 18 * 12 == fast.count()
    wrong = [(k, f.name, a[k][f.name], b[k][f.name]) for k in a for f in feats if not same(a[k][f.name], b[k][f.name], 1e-6 if f.agg == "std" else 1e-9)]
    assert not wrong, wrong[:5]
    assert "Window" not in fast._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 32])
def test_both_ways_give_the_same_sums(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW_CUTOFFS", few)
    got = fs.compute(spine(spark).select(*lb.KEYS), Path(events(spark, 400), "who", "at"), [Feature("s", "sum", "x", 90), Feature("m", "max", "x", 90), Feature("n", "count")])
    want = fs.compute_by_join(spine(spark).select(*lb.KEYS), Path(events(spark, 400), "who", "at"), [Feature("s", "sum", "x", 90), Feature("m", "max", "x", 90), Feature("n", "count")])
    a, b = (sorted((r.entity_id, str(r.cutoff_time), round(r.s, 6), r.m or 0.0, r.n) for r in x.collect()) for x in (got, want))
    assert a == b


def test_tasks_grow_with_the_keys(spark, monkeypatch):
    """The results of a task stay about as large, however many keys there are (fixed partitions grew with them)."""
    monkeypatch.setattr(intervals, "TASK_BYTES", 500)
    path, feats = Path(events(spark, 300), "who", "at"), [Feature("n", "count", days=30), Feature("s", "sum", "x", 90)]
    one, all_ = (fs.compute(spine(spark).select(*lb.KEYS).where(w), path, feats).rdd.getNumPartitions() for w in ("entity_id < 4", "true"))
    assert all_ >= 4 * one > 0


def test_sizes_of_sums_come_from_the_cheaper_table(spark):
    """Units are chosen from `sizes`, so that a joined path is not run twice; sums stay those of the joined rows."""
    rows = events(spark, 300).where("x is not null")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    slow = rows.withColumn("x", counted(F.col("x")))
    keys, feats = spine(spark).select(*lb.KEYS), [Feature("s", "sum", "x", 90)]
    got = sorted(map(tuple, fs.compute(keys, Path(slow, "who", "at", sizes=rows), feats).collect()))
    assert calls.value <= 300
    assert got == sorted(map(tuple, fs.compute(keys, Path(rows, "who", "at"), feats).collect()))


def test_a_bound_of_the_cutoff_is_not_found_for_each_pair(spark):
    people = spine(spark).select(*lb.KEYS)
    rule = lb.Rule(events(spark, 300), "who", "at", "at >= :cutoff - interval 20 days")
    got = lb.apply_rule(people, rule)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == people.columns and not [x for x in plan.split("\n") if "Join" in x and "INTERVAL" in x.upper()]
    want = people.join(rule.table, F.expr("who = entity_id and at < cutoff_time and at >= cutoff_time - interval 20 days"), "left_semi")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count()


def test_a_rule_reads_only_rows_that_a_cutoff_can_see(spark):
    cut = "timestamp_ntz '2020-06-01'"
    people = spark.range(3).select(F.col("id").alias("entity_id"), F.expr(cut).alias("cutoff_time"))
    times = {"early": "2020-01-01", "edge": "2020-05-02", "inside": "2020-05-20", "cutoff": "2020-06-01", "late": "2020-07-01"}
    events = spark.createDataFrame([(i % 3, n, t) for i, (n, t) in enumerate(times.items())], "k long, n string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    seen = lambda where, who=people: {r.n for r in lb._reach(who, lb.Rule(events, "k", "t", where)).collect()}
    assert seen("t >= :cutoff - interval 30 days") == {"edge", "inside"}
    assert seen("n != 'edge' and t >= :cutoff - interval 30 days") == seen(None) == {"early", "edge", "inside"}
    assert seen("t >= :cutoff - interval 30 days or n = 'early'") == {"early", "edge", "inside"}
    assert seen(None, people.where("false")) == set()
    assert lb.apply_rule(people, lb.Rule(events, "k", "t", "t >= :cutoff - interval 30 days")).count() == 2
    assert lb.apply_rule(people.where("entity_id = 1"), lb.Rule(events.where("false"), "k", "t"), exists=False).count() == 1


def test_eligible_entities_are_found_without_every_pair(spark, monkeypatch):
    """By the bits of the cutoffs: the same rows as by the join, at the edges of the span, for repeated and null entities."""
    from tidemark.operators import labels as lb

    rows = [(1, "1995-03-01 00:00:00"), (1, "1995-02-28 23:59:59.999999"), (2, "1996-02-29 00:00:00"), (2, "1996-01-01 00:00:00"), (3, None), (None, "1996-01-05 00:00:00"), (4, "1994-01-01 00:00:00"), (5, "1996-02-28 12:00:00")]
    table = spark.createDataFrame(rows, "k long, t string").select("k", F.col("t").cast("timestamp_ntz").alias("t"))
    entities = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (5,), (None,)], "id long")
    cuts = lb.windows(lb.cutoffs(spark, "1996-01-01", "1996-03-01", 1, "months"), 90, "2001-08-01")[0]
    every = entities, "id", cuts
    rule = lb.Rule(table, "k", "t", "t >= :cutoff - interval 366 days")
    want = lb.apply_rule(lb.entity_cutoffs(*every), rule)
    got = lb.apply_rule(lb.entity_cutoffs(*every), rule, made_of=every)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    more = lb.Rule(table, "k", "t", "t >= :cutoff - interval 366 days and k < 5")  # asks more than a span: by the join
    assert sorted(map(str, lb.apply_rule(lb.entity_cutoffs(*every), more, made_of=every).collect())) == sorted(map(str, lb.apply_rule(lb.entity_cutoffs(*every), more).collect()))


def test_paths_together_equal_each_by_its_join(spark):
    """Cutoffs with gaps between their windows, two tables, rows on every edge and a value that is not finite."""
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1995, 1996, 1998, 2000) for m in (1, 2, 6) for d in (1, 2, 28)]
    rows = [(i % 4, t, float(i) if i % 11 else math.inf) for i, t in enumerate(days * 2)]
    a = spark.createDataFrame(rows, "k long, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    b = a.where("v < 40").select("k", "t", (F.col("v") / 7).alias("w"))
    keys = spark.createDataFrame([(i, c) for i in range(5) for c in ("1996-02-01", "1996-03-01", "2000-06-28")], "entity_id long, c string").select("entity_id", F.col("c").cast("timestamp_ntz").alias("cutoff_time"))
    first, second = [fs.Feature("n", "count", days=30), fs.Feature("mean", "mean", "v", 60), fs.Feature("last", "days_since_last", days=365)], [fs.Feature("total", "sum", "w", 30), fs.Feature("top", "max", "w", 90)]
    got = fs.compute_paths(keys, [(fs.Path(a, "k", "t"), first), (fs.Path(b, "k", "t"), second)])
    want = fs.wide(keys, [fs.compute_by_join(keys, fs.Path(a, "k", "t"), first), fs.compute_by_join(keys, fs.Path(b, "k", "t"), second)])
    assert got.dtypes == want.dtypes
    x, y = ({(r.entity_id, r.cutoff_time): r for r in f.collect()} for f in (got, want))
    assert x.keys() == y.keys() and len(x) == 15
    for k in x:
        for c in ("n", "mean", "last", "total", "top"):
            assert x[k][c] == y[k][c] or abs(x[k][c] - y[k][c]) < 1e-9, (k, c, x[k][c], y[k][c])
