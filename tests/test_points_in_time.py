"""Hand-checked rows of a tiny shop, and properties: bounds, folds, sampling, leaks, contributions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.formula import formula
from tidemark.operators import clean, dfs, leakage, metrics, models, profile, scoring, splits, verify
from tidemark.operators import features as fs
from tidemark.operators import labels as lb
from tidemark.operators.features import Feature, Path, Predicate
from tidemark.operators.labels import Rule, Target
from tidemark.sources import tables as src


@pytest.fixture(scope="module")
def shop(spark):
    customers = [(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-01"), (4, "2024-03-10"), (5, "2024-01-05")]
    orders = [
        (1, 1, "2024-02-10 12:00"), (2, 1, "2024-03-31 00:00"), (3, 2, "2024-02-20 09:00"), (4, 2, "2024-04-01 00:00"), (5, 2, "2024-05-15 10:00"), (6, 3, "2024-06-20 10:00"),
        (7, 4, "2024-03-20 10:00"), (8, 4, "2024-04-20 10:00"), (9, 5, "2024-02-01 10:00"), (10, 5, "2024-03-15 10:00"), (11, 5, "2024-06-15 10:00"),
    ]
    c = spark.createDataFrame(customers, "customer_id int, signup_at string").withColumn("signup_at", F.col("signup_at").cast("timestamp_ntz"))
    o = spark.createDataFrame([(*x, "cancelled" if x[0] == 10 else "completed") for x in orders], "order_id int, customer_id int, ordered_at string, status string").withColumn("ordered_at", F.col("ordered_at").cast("timestamp_ntz"))
    cuts = lb.windows(lb.cutoffs(spark, "2024-03-01", "2024-05-01", 1, "months"), 30, "2024-07-01")[0]
    every = lb.entity_cutoffs(c, "customer_id", cuts, created="signup_at")
    return c, o, every


def by_month(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cutoff_time.month, set()).add((r.entity_id, r.label))
    return out


def test_churn_labels_by_hand(shop):
    _, o, every = shop
    spine = lb.apply_rule(every, Rule(o, "customer_id", "ordered_at"))
    got = lb.labels(spine, Target(o, "customer_id", "ordered_at", where="status <> 'cancelled'", compare=("=", 0)))
    assert by_month(got) == {3: {(1, 0), (2, 1), (5, 1)}, 4: {(1, 1), (2, 1), (4, 0), (5, 1)}, 5: {(1, 1), (2, 0), (4, 1), (5, 1)}}


def test_count_labels_by_hand(shop):
    _, o, every = shop
    spine = lb.apply_rule(every, Rule(o, "customer_id", "ordered_at", "status = 'cancelled'"), exists=False)
    got = lb.labels(spine, Target(o, "customer_id", "ordered_at", where="status <> 'cancelled'"))
    assert by_month(got) == {3: {(1, 1), (2, 0), (3, 0), (5, 0)}, 4: {(1, 0), (2, 0), (3, 0), (4, 1)}, 5: {(1, 0), (2, 1), (3, 0), (4, 0)}}


def test_event_at_the_cutoff_is_in_neither_side(shop):
    _, o, every = shop
    at = every.where("entity_id = 2 and cutoff_time = timestamp_ntz '2024-04-01'")
    r = fs.compute(at, Path(o, "customer_id", "ordered_at"), [Feature("n", "count"), Feature("since", "days_since_last"), Feature("share", "share", where=(Predicate("status", "=", "completed"),))]).first()
    assert r.n == 1 and abs(r.since - 40.625) < 1e-9 and r.share == 1.0
    assert lb.labels(at, Target(o, "customer_id", "ordered_at")).first().label == 0


def test_share_of_no_history(shop):
    _, o, every = shop
    at = every.where("entity_id = 3 and cutoff_time = timestamp_ntz '2024-04-01'")
    p = Path(o, "customer_id", "ordered_at")
    feats = [Feature("a", "share", where=(Predicate("status", "=", "x"),)), Feature("b", "share", where=(Predicate("status", "is_null"),)), Feature("c", "share", where=(Predicate("status", "=", "x"),), empty="null")]
    r = fs.compute(at, p, feats).first()
    assert (r.a, r.b, r.c) == (0.0, 1.0, None)


def test_running_totals_equal_the_join(shop):
    _, o, every = shop
    p = Path(o.withColumn("v", F.col("order_id") * 1.5), "customer_id", "ordered_at")
    a = {(r.entity_id, r.cutoff_time): (r.n, r.v) for r in fs.compute(every, p, [Feature("n", "count"), Feature("v", "sum", "v")]).collect()}
    b = {(r.entity_id, r.cutoff_time): (r.n, r.v) for r in fs.running(every, p, {"v": "v"}).collect()}
    assert a == b


def test_random_features_ignore_the_future(spark, shop):
    _, o, every = shop
    rng = random.Random(1)
    o = o.withColumn("v", F.col("order_id") * 1.0)
    feats = []
    for i in range(25):
        agg = rng.choice(["count", "sum", "mean", "min", "max", "std", "days_since_last", "days_since_first", "share"])
        where = (Predicate("status", rng.choice(["=", "!="]), "completed"),) if agg == "share" or rng.random() < 0.4 else ()
        feats.append(Feature(f"f{i}", agg, "v" if agg in ("sum", "mean", "min", "max", "std") else None, rng.choice([None, 7, 30, 90]), where))
    cut = dt.datetime(2024, 4, 1)
    spine = every.where(F.col("cutoff_time") == F.lit(cut))
    full = {r.entity_id: r for r in fs.compute(spine, Path(o, "customer_id", "ordered_at"), feats).collect()}
    less = {r.entity_id: r for r in fs.compute(spine, Path(o.where(F.col("ordered_at") < F.lit(cut)), "customer_id", "ordered_at"), feats).collect()}
    assert full == less


def test_truncation_finds_a_leak(shop):
    _, o, every = shop
    t = {"orders": (o, "ordered_at")}
    good = lambda s, x: fs.compute(s, Path(x["orders"], "customer_id", "ordered_at"), [Feature("value", "count")])
    bad = lambda s, x: s.select(*lb.KEYS).join(x["orders"].groupBy("customer_id").agg(F.count("*").alias("value")), F.col("entity_id") == F.col("customer_id"), "left").select(*lb.KEYS, "value")
    assert verify.truncation(good, every, t).count() == 0 and verify.truncation(bad, every, t).count() > 0
    assert verify.accept(good, every, t).first().accepted and not verify.accept(bad, every, t).first().accepted


def test_errors_name_their_field(shop):
    _, o, every = shop
    with pytest.raises(ValueError, match="days"):
        Feature("x", "count", days=0)
    with pytest.raises(ValueError, match="agg"):
        Feature("x", "median")
    with pytest.raises(ValueError, match="columns"):
        verify.contract(every, every)
    with pytest.raises(ValueError, match="unique"):
        lb.own_labels(o.withColumn("l", F.lit(1)).withColumn("k", F.lit(1)).withColumn("t", F.lit("2024-01-01").cast("timestamp_ntz")), "k", "t", "l", 3)
    for text in ("__import__('os')", "a.b", "1 + 1", "x ** 9", "f(x)", "x" * 1001, "[x]"):
        with pytest.raises(ValueError, match="formula"):
            formula(text, ["x"])


def test_purging_and_folds(spark):
    rows = [(i, dt.datetime(2024, 1 + m, 1), dt.datetime(2024, 1 + m, 1) + dt.timedelta(days=30), i % 2) for m in range(11) for i in range(3)]
    df = spark.createDataFrame(rows, "entity_id int, cutoff_time timestamp_ntz, label_window_end timestamp_ntz, label int")
    p = splits.partition(df, "2024-07-01", "2024-10-01")
    val, test = dt.datetime(2024, 7, 1), dt.datetime(2024, 10, 1)
    for r in p.collect():
        if r.part == "train":
            assert r.label_window_end <= val
        if r.part == "val":
            assert r.cutoff_time >= val and r.label_window_end <= test
    folds = splits.expanding_folds(p.where("part = 'train'"), 2)
    for i in (1, 2):
        first = folds.where(f"fold_{i} = 'val'").agg(F.min("cutoff_time")).first()[0]
        assert folds.where(f"fold_{i} = 'train'").agg(F.max("label_window_end")).first()[0] <= first


def test_random_splits_are_even_and_repeatable(spark):
    df = spark.range(5000).withColumn("y", F.col("id") % 5 == 0)
    a = splits.random_split(df, ["id"], "y")
    shares = {(r.y, r.part): r["count"] for r in a.groupBy("y", "part").count().collect()}
    assert abs(shares[True, "train"] - 600) < 40 and abs(shares[False, "test"] - 800) < 60
    assert sorted(a.collect()) == sorted(splits.random_split(df.repartition(7), ["id"], "y").collect())
    k = {r.fold: r["count"] for r in splits.k_fold(df, ["id"], 5).groupBy("fold").count().collect()}
    assert len(k) == 5 and max(k.values()) - min(k.values()) < 100
    ranks = [r.rank for r in splits.ordered_rank(df, [F.desc("id")]).orderBy(F.desc("id")).collect()]
    assert ranks == list(range(1, 5001))


def test_planted_leaks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        churn = rng.random() < 0.3
        rows.append((rng.randint(1, 70), rng.uniform(20, 120), int(churn), 1 - int(churn), int(churn) if rng.random() > 0.01 else 1 - int(churn), "moved" if churn else "stays"))
    df = spark.createDataFrame(rows, "tenure int, charges double, Churn int, is_active int, final_status int, cancellation_reason string")
    got = {r.column_name for r in leakage.scan(df, "Churn", ["tenure", "charges", "is_active", "final_status", "cancellation_reason"]).collect()}
    assert got == {"is_active", "final_status", "cancellation_reason"}
    assert leakage.scan(df, "Churn", ["tenure", "charges"]).count() == 0
    twice = df.union(df.limit(500))
    assert leakage.duplicate_rows(twice, ["tenure", "charges"], "Churn").first().flagged and not leakage.duplicate_rows(df, ["tenure", "charges"], "Churn").first().flagged
    scaled = clean.scale(df, df, "charges", "min_max")
    assert {r.column_name for r in leakage.normalised(scaled, ["charges"]).where("flagged").collect()} == {"charges"}


def test_copies_of_columns_are_dropped(spark):
    df = spark.range(400).select("id", (F.rand(1) * 10).alias("a")).withColumn("b", F.col("a") * 3 - 1).withColumn("c", F.rand(2)).withColumn("d", F.when(F.col("id") % 2 == 0, F.col("a")))
    df = df.cache()
    assert clean.duplicate_columns(df, ["a", "b", "c", "d"]) == [("b", "a")]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.1, 0)], "k int, s double, y int")
    assert abs(metrics.average_precision(df, "s", "y").first()[0] - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12
    assert abs(metrics.roc_auc(df, "s", "y").first()[0] - 0.875) < 1e-12
    assert metrics.brier(df, "s", "y").first()[0] == pytest.approx((0.01 + 0.64 + 0.04 + 0.01) / 4)
    t = metrics.best_threshold(df, "s", "y").first()
    assert t.threshold == 0.8 and t.f1 == pytest.approx(0.8)
    assert metrics.k_of(0.07, 100) == 7 and metrics.k_of(0.001, 10) == 1
    gain = spark.createDataFrame([(1, 0.6, 0.65), (2, 0.6, 0.66), (3, 0.6, 0.64)], "fold int, base double, cand double")
    assert metrics.paired_gain(gain).first().accepted


def test_contributions_add_up(spark):
    df = spark.range(600).select("id", F.rand(1).alias("a"), F.when(F.rand(3) > 0.1, F.rand(2)).alias("b"))
    df = df.withColumn("label", ((F.col("a") + F.coalesce("b", F.lit(0.9))) > 1).cast("int")).withColumn("part", F.when(F.col("id") % 4 == 0, "val").otherwise("train")).cache()
    model, names = models.fit_validated(df, ["a", "b"], rounds=6, depth=3)
    got = {r.id: r for r in models.reasons(model, df, ["a", "b"], "id").collect()}
    data, _ = models.ready(df, ["a", "b"])
    for r in model.transform(data).collect():
        assert got[r.id].margin == pytest.approx(r.rawPrediction[1] / 1, abs=1e-6) or 2 * got[r.id].margin == pytest.approx(r.rawPrediction[1], abs=1e-6)
    assert metrics.roc_auc(models.predict(model, df.where("part = 'val'"), ["a", "b"]), "score", "label").first()[0] > 0.95
    assert abs(sum(r.share for r in models.importances(model, names, spark).collect()) - 1) < 1e-9


def test_sources(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,x,yes,none,text\n1,1.5,Yes,NA,a\n2,2,No,,\"b,c\"\n3,NULL,Yes,n/a,d\n")
    df = src.read_text_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string", "string"] and df.where("x is null").count() == 1
    with pytest.raises(ValueError, match="more than 2"):
        src.bounded(df, 2)
    with pytest.raises(ValueError, match="text"):
        src.typed_time(df, "text")
    a, b = src.store_version(df, str(tmp_path / "v")), src.store_version(df.orderBy(F.desc("id")), str(tmp_path / "v"))
    assert a == b and a != src.store_version(df.where("id > 1"), str(tmp_path / "v"))


def test_snapshot_identity(spark, shop, tmp_path):
    c, o, _ = shop
    root = str(tmp_path)
    v1, at = src.snapshot(spark, {"o": (o, "ordered_at"), "c": (c, None)}, "2024-04-01", root)
    assert spark.read.parquet(f"{at}/o").count() == 7
    assert src.snapshot(spark, {"o": (o, "ordered_at"), "c": (c, None)}, "2024-04-01", root)[0] == v1
    changed = o.withColumn("status", F.when(F.col("order_id") == 1, "x").otherwise(F.col("status")))
    assert src.snapshot(spark, {"o": (changed, "ordered_at"), "c": (c, None)}, "2024-04-01", root)[0] != v1


def test_foreign_keys_are_found(spark):
    customers = spark.range(100).select(F.col("id").alias("id"))
    orders = spark.range(300).select(F.col("id").alias("order_no"), (F.col("id") % 100).alias("customer_id"), (F.col("id") % 100 + 1000).alias("legacy_customer_id"), (F.col("id") % 200).alias("half_customer_id"), F.col("id").alias("region_id"))
    got = {(e["child"], e["column"], e["parent"]) for e in profile.infer_edges({"customers": customers, "orders": orders}, {"customers": "id", "orders": "order_no"})}
    assert got == {("orders", "customer_id", "customers")}


def test_inclusions_scan_each_table_once(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.5), (None, None, 3.0), (7, "y", 7.0)], "k long, s string, d double")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "x")], "p int, t string")
    pairs = [("a", "k", "b", "p"), ("a", "d", "b", "p"), ("a", "s", "b", "t"), ("b", "p", "a", "k")]
    found = profile.inclusions({"a": a, "b": b}, pairs)
    got = {(r.child_column, r.parent_column): (r.n_keys, r.matched, r.unique_parent) for r in found.collect()}
    assert got == {("k", "p"): (3, 2, True), ("d", "p"): (4, 2, True), ("s", "t"): (2, 1, False), ("p", "k"): (3, 2, True)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    empty = profile.uniqueness(a.where("false"), ["k", "s"]).collect()
    assert [(r.non_null, r.n_distinct, r.is_unique) for r in empty] == [(0, 0, True)] * 2


def test_generator_names_and_paths(spark, shop):
    c, o, every = shop
    cat = {"customers": dfs.Table(c, "customer_id", "signup_at"), "orders": dfs.Table(o, "order_id", "ordered_at", {"customer_id": "customers"}), "notes": dfs.Table(o, "order_id", None, {"customer_id": "customers"})}
    found, skipped = dfs.paths(cat, "customers")
    assert list(found) == ["orders"] and skipped == ["notes: no event time"]
    out = dfs.feature_table(every.select(*lb.KEYS), cat, "customers", {"orders": ["status"]})
    assert out.count() == every.count() and "orders_status_completed_count_30d" in out.columns and len(dfs.short("x" * 90)) == 63
    assert verify.contract(out, every, [x for x in out.columns if x not in lb.KEYS]).first().repeated_keys == 0


def test_entity_sample_is_whole_and_repeatable(spark):
    lab = spark.range(3000).select((F.col("id") % 1000).alias("entity_id"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id / 1000 as int))").alias("cutoff_time"), ((F.col("id") % 10) == 0).cast("int").alias("label"))
    s = verify.sample_entities(lab, 900)
    n = s.groupBy("entity_id").count()
    assert n.where("count <> 3").count() == 0 and 240 <= n.count() <= 360
    assert sorted(s.collect()) == sorted(verify.sample_entities(lab.repartition(5), 900).collect())


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), np.full(700, 1.5), [-0.0, 0.0]])
    rows = [(float(v), int(i % 7), None if i % 3 else 2.5, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, k int, `odd name` double, none double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["column_name"]: r for r in profile.quantiles(df, df.columns, shares).collect()}
    assert set(got) == {"x", "k", "odd name"}
    assert got["x"]["n"] == len(x) and got["x"]["n_distinct"] == len(np.unique(x))
    for name, values in (("x", x), ("k", np.arange(len(x)) % 7), ("odd name", np.full(401, 2.5))):
        assert np.allclose(got[name]["q"], np.quantile(values, shares), atol=1e-12)
    assert profile.quantiles(df.where("false"), ["x"], [0.5]).count() == 0
    assert profile.quantile(df.where("false"), "x", [0.5]) == [None]
    stats = {r["column_name"]: r for r in profile.table_stats(df).collect()}
    assert stats["none"]["n_distinct"] == 0 and stats["none"]["p50"] is None and stats["k"]["n_distinct"] == 7


def test_single_features_by_kind_of_target(spark):
    rows = [(i, float(i % 5), float((i * 7919) % 1000), "abc"[i % 3], i % 2, float(i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, a double, noise double, cls string, two int, third double")
    score = lambda y, cols: {r["column_name"]: (r["metric"], r["severity"]) for r in leakage.single_feature(df, y, cols).collect()}
    assert score("cls", ["third", "noise"]) == {"third": ("roc_auc", "block"), "noise": ("roc_auc", "ok")}
    assert score("a", ["a", "noise"]) == {"a": ("r2", "block"), "noise": ("r2", "ok")}
    assert score("two", ["two", "third"]) == {"two": ("roc_auc", "block"), "third": ("roc_auc", "ok")}
    assert leakage.single_feature(df.withColumn("one", F.lit(1)), "one", ["a"]).first()["score"] is None


def test_scoring_history_names_what_drifted(spark):
    train = spark.createDataFrame([(i, float(i % 50), float(i % 40)) for i in range(1000)], "entity_id int, same double, moved double")
    now = train.withColumn("moved", F.col("moved") + 30)
    stats = scoring.feature_stats(train, ["same", "moved"])
    row = scoring.history_row(now, "2020-01-01", ["same", "moved"], scoring.psi(train, now, ["same", "moved"], stats)).first()
    assert row["n_scored"] == 1000 and row["drifted"] == ["moved"] and row["psi"]["same"] == 0.0


def test_parent_names(spark):
    assert profile.name_strength("status_id", "status") == 1.0 and profile.name_strength("box_id", "boxes") == 1.0
    assert profile.name_strength("category_id", "categories") == 1.0 and profile.name_strength("billing_customer_id", "customers") == 0.7
    assert profile.name_strength("customer_id", "shop_customers") == 0.7 and profile.name_strength("price", "customers") == 0.0


def test_database_catalog_lists_tables_keys_and_edges(spark):
    """Two tables made by SQL in an embedded database, one with a key of two columns and foreign keys to the other."""
    url, how = "jdbc:derby:memory:tidemark_catalog;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    with src.database(spark, url, how) as connection:
        for text in ("create table customer (ck int primary key, name varchar(20))", "create table orders (ok int, line int, ck int references customer, placed timestamp, primary key (ok, line))", "insert into customer values (1, 'a'), (2, 'b'), (900, 'c')", "insert into orders values (1, 1, 1, timestamp('2024-01-01 00:00:00')), (1, 2, 1, null), (2, 1, 900, timestamp('2024-02-01 00:00:00'))"):
            connection.createStatement().execute(text)
    found = src.catalog(spark, url, how)
    names = {n.lower().rpartition(".")[2]: t for n, t in found.items()}
    assert set(names) == {"customer", "orders"}
    assert names["customer"].key == ("CK",) and names["orders"].key == ("OK", "LINE")
    assert [(e.columns, e.parent.rpartition(".")[2], e.parent_columns) for e in names["orders"].foreign] == [(("CK",), "CUSTOMER", ("CK",))]
    frames = src.read_catalog(spark, url, how, parts=3)
    customer = frames[next(n for n in found if n.endswith("CUSTOMER"))]
    assert customer.rdd.getNumPartitions() == 3 and {r.NAME for r in customer.collect()} == {"a", "b", "c"}
    assert sum(f.count() for f in frames.values()) == 6
    src.write_back(spark.createDataFrame([(1, "2024-01-01", 0.5)], "entity_id int, cutoff_time string, score double"), "run", url=url, table="scores", properties=how)
    assert src.read_jdbc(spark, url, "scores", properties=how).count() == 1


def test_quantile_sketches_keep_their_rank_error(spark):
    df = spark.range(40_000).select(((F.col("id") * 7919) % 40_000).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 100).alias("b"), F.lit(None).cast("double").alias("c"))
    got = {r.column_name: r for r in profile.sketched_quantiles(df.repartition(7), ["a", "b", "c"], [0.01, 0.5, 0.99]).collect()}
    assert set(got) == {"a", "b"} and got["a"].n == 40_000 and got["b"].n == 32_000
    for q, x in zip([0.01, 0.5, 0.99], got["a"].q, strict=True):
        assert abs(x / 40_000 - q) <= profile.rank_error(profile.SKETCH_K)
    exact = profile.table_stats(df, ["a"]).first()
    near = profile.table_stats(df, ["a"], sketch=True).first()
    assert exact.p50 == 19999.5 and abs(near.p50 - exact.p50) <= 40_000 * profile.rank_error(profile.SKETCH_K)


def test_database_table_is_read_in_ranges(spark):
    url, how = "jdbc:derby:memory:tidemark_test;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(500).select(F.col("id").alias("ck"), (F.col("id") % 7).alias("v")).write.mode("overwrite").jdbc(url, "c", properties=how)
    got = src.read_jdbc(spark, url, "c", "ck", 4, how)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in got.collect()) == [(i, i % 7) for i in range(500)]
