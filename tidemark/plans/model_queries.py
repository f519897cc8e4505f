"""Queries whose result depends on a fitted model (rows only, with properties held in the tests) or a written file (with SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as fs
from tidemark.operators import labels as lb
from tidemark.operators import metrics, models, scoring, splits
from tidemark.operators.features import Feature
from tidemark.plans.reference_queries import SC, S, drift_features, items_path, load, orders_path, orders_target, parted, parted_windows, scored, t1_rule, t1_spine
from tidemark.sources import tables as src
from tidemark.sources.shared import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COLUMNS = ["n_30", "n_90", "n_365", "mean_price", "since_last", "quantity"]
#: The parts that models are fitted and compared on.
FITTED = ("train", "val")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def frame(spark: SparkSession, d: str, keys: DataFrame | None = None, parts: tuple[str, ...] = (), also: DataFrame | None = None) -> DataFrame:
    """Features of both paths, written once; with labels and parts unless keys are given. Of parts, if given, only: rows that no one reads are not built.

    Keys in `also` get the same features in the same pass, and neither label nor part.
    """
    feats = [*[Feature(f"n_{n}", "count", days=n) for n in (30, 90, 365)], Feature("mean_price", "mean", "o_totalprice"), Feature("since_last", "days_since_last")]
    paths = [(orders_path(spark, d), feats), (items_path(spark, d), [Feature("quantity", "sum", "l_quantity", 365)])]
    if keys is not None:
        return written(fs.wide(keys, [fs.compute_paths(keys.select(*lb.KEYS), paths)]), "frame")
    windows = parted_windows(spark, parts)
    spine = t1_spine(spark, d, windows.drop("part"))
    spine = spine if also is None else spine.unionByName(also, allowMissingColumns=True)
    rows = fs.labelled(spine, orders_target(spark, d, compare=("=", 0)), paths)
    part = F.broadcast(windows.select("cutoff_time", "part"))  # a part follows from the cutoff's window
    return written(rows.join(part, "cutoff_time", "left").select(*lb.KEYS, "label", "label_window_end", "part", *COLUMNS), "frame")


@query("A1", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') as o_orderdate, o_orderpriority from orders")
def a1(spark, d):
    path = new_path(spark, "csv-orders")
    load(spark, d, "orders").write.csv(path, header=True)
    return src.read_text_table(spark, path)


@query("A5_snapshot")
def a5_snapshot(spark, d):
    tables = {"orders": (load(spark, d, "orders"), "o_orderdate"), "customer": (load(spark, d, "customer"), None)}
    version, path = src.snapshot(spark, tables, "1998-01-01", new_path(spark, "snapshots"))
    return spark.read.parquet(f"{path}/orders").agg(F.count("*").alias("n_rows"), F.max("o_orderdate").alias("max_time")).withColumn("version", F.lit(version))


@query("A13", f"with {S} select entity_id, cutoff_time, count(o_orderkey) as n_orders from spine left join orders on o_custkey = entity_id and o_orderdate < cutoff_time group by entity_id, cutoff_time")
def a13(spark, d):
    """The data's checksum is the version; the second call reads what the first has written, and builds nothing."""
    spine, feats, root = t1_spine(spark, d), [Feature("n_orders", "count")], new_path(spark, "features")
    orders = load(spark, d, "orders")
    version = str(orders.agg(src.checksum(orders)).first()[0])
    src.cached_features(spark, root, feats, version, spine, lambda: fs.compute(spine, orders_path(spark, d), feats))

    def again():
        raise RuntimeError("the written features were not found")

    return src.cached_features(spark, root, feats, version, spine, again)


@query("A14", f"with {SC}, k as (select entity_id, score, row_number() over (order by score desc, entity_id) as rank, count(*) over () as n from sc where cutoff_time = timestamp '1996-12-01') select entity_id, score, rank, least(10, 1 + (rank - 1) * 10 // n)::bigint as decile from k")
def a14(spark, d):
    ranked = scoring.rank_rows(scored(spark, d).where("cutoff_time = timestamp_ntz '1996-12-01'").select("entity_id", "score"))
    return src.read_text_table(spark, src.write_scores_csv(ranked, new_path(spark, "scores"), "1996-12-01"))


@query("A15")
def a15(spark, d):
    """Two scorings of one model's features, appended one after the other; the training rows are those of the drift queries."""
    path, cols = new_path(spark, "history"), ["n_orders", "mean_price"]
    f = written(drift_features(spark, d), "features")
    train = f.where("cutoff_time < timestamp_ntz '1996-07-01'")
    stats = written(scoring.feature_stats(train, cols), "stats")
    for cutoff in ("1996-11-01", "1996-12-01"):
        now = f.where(F.col("cutoff_time") == F.lit(cutoff).cast("timestamp_ntz"))
        src.append_history(scoring.history_row(now, cutoff, cols, scoring.psi(train, now, cols, stats)), path)
    return spark.read.parquet(path)


@query("A16", f"with {SC} select 'run-1' as run_id, entity_id, cutoff_time, score from sc")
def a16(spark, d):
    path = new_path(spark, "scores")
    src.write_back(scored(spark, d), "run-1", path=path)
    return spark.read.parquet(path).drop("created_at")


@query("M1")
def m1(spark, d):
    f = frame(spark, d, parts=("train", "val", "test"))
    model, _ = models.fit_validated(f, COLUMNS)
    return metrics.roc_auc(models.predict(model, f.where("part = 'test'"), COLUMNS), "score", "label")


@query("M2")
def m2(spark, d):
    rows = written(lb.labels(t1_spine(spark, d), orders_target(spark, d, agg="sum", column="o_totalprice")), "labels")
    f = fs.wide(splits.partition(rows, "1996-07-01", "1996-10-01"), [fs.compute(rows, orders_path(spark, d), [Feature("n_365", "count", days=365), Feature("mean_price", "mean", "o_totalprice")])])
    f = written(f.withColumns({"label": F.col("label") / 1e5, "mean_price": F.col("mean_price") / 1e5}), "frame")
    kind = models.task_kind(f)
    model, _ = models.fit_validated(f, ["n_365", "mean_price"], kind=kind)
    return metrics.regression(models.predict(model, f.where("part = 'val'"), ["n_365", "mean_price"]), "label", "score").withColumn("kind", F.lit(kind))


@query("M2_multiclass")
def m2_multiclass(spark, d):
    """The status of the first order after the cutoff, by boosted trees with a softmax."""
    rows = written(lb.labels(t1_spine(spark, d), orders_target(spark, d, agg="first", column="o_orderstatus")), "labels")
    feats = [Feature("n_365", "count", days=365), Feature("mean_price", "mean", "o_totalprice"), Feature("since_last", "days_since_last")]
    columns = [x.name for x in feats]
    f = written(fs.wide(splits.partition(rows, "1996-07-01", "1996-10-01"), [fs.compute(rows, orders_path(spark, d), feats)]), "frame")
    model, _ = models.fit_validated(f, columns, kind=models.task_kind(f), rounds=5)
    place = F.array_position(F.array(*map(F.lit, model.classes)), F.col("label")).cast("int") - 1
    val = models.predict_classes(model, f.where("part = 'val'"), columns)
    return metrics.multiclass(val, "label", "prediction", F.coalesce(F.get("probabilities", place), F.lit(0.0)), f.where("part = 'train'"))


@query("M3")
def m3(spark, d):
    return models.compare(frame(spark, d, parts=FITTED), COLUMNS)


@query("M4")
def m4(spark, d):
    return models.battery(frame(spark, d, parts=FITTED), COLUMNS)


@query("M5")
def m5(spark, d):
    return models.search(frame(spark, d, parts=FITTED), COLUMNS)


@query("M6")
def m6(spark, d):
    f, _ = models.ready(frame(spark, d, parts=FITTED).withColumn("label_d", F.col("label").cast("double")).withColumn("row_id", F.col("entity_id") * 100 + F.month("cutoff_time")), COLUMNS)
    makers = [RandomForestClassifier(labelCol="label_d", numTrees=10, seed=1), LogisticRegression(labelCol="label_d"), RandomForestClassifier(labelCol="label_d", numTrees=10, maxDepth=3, seed=2)]
    return models.vote([m.fit(f.where("part = 'train'")).transform(f.where("part = 'val'")) for m in makers], "row_id")


@query("M7")
def m7(spark, d):
    f = frame(spark, d, splits.expanding_folds(parted(spark, d, where="cutoff_time < timestamp_ntz '1996-10-01'"), 2))
    return models.fold_scores(f, COLUMNS, ["fold_1", "fold_2"])


@query("M9")
def m9(spark, d):
    all_rows = frame(spark, d)
    f = written(splits.expanding_folds(all_rows.where("cutoff_time < timestamp_ntz '1996-10-01'"), 2), "folds")
    kept, log = models.forward_selection(f, ["n_30"], ["n_365", "since_last"], ["fold_1", "fold_2"])
    end = models.refit_score(all_rows, kept)
    steps = spark.createDataFrame([(x["column"], x["gain"], x["accepted"]) for x in log], "column_name string, gain double, accepted boolean")
    return steps.crossJoin(F.broadcast(end.withColumnRenamed("roc_auc", "test_roc_auc")))  # one row


@query("M10")
def m10(spark, d):
    f = frame(spark, d, parts=FITTED)
    model, _ = models.fit_validated(f, COLUMNS, rounds=5)
    auc = metrics.roc_auc(models.predict(model, f.where("part = 'val'"), COLUMNS), "score", "label").first()[0]
    return spark.createDataFrame([(auc, models.rebuilds(model, f, COLUMNS, auc))], "roc_auc double, rebuilt boolean")


@query("M11")
def m11(spark, d):
    model, names = models.fit_validated(frame(spark, d, parts=FITTED), COLUMNS)
    return models.importances(model, names, spark)


@query("M12")
def m12(spark, d):
    f = frame(spark, d, parts=FITTED)
    model, _ = models.fit_validated(f, COLUMNS, rounds=5, depth=3)
    rows = f.where("part = 'val'").withColumn("row_id", F.col("entity_id") * 100 + F.month("cutoff_time"))
    return models.reasons(model, rows, COLUMNS, "row_id")


@query("M12_summary")
def m12_summary(spark, d):
    f = frame(spark, d, parts=FITTED)
    model, _ = models.fit_validated(f, COLUMNS, rounds=5, depth=3)
    rows = f.where("part = 'val'").withColumn("row_id", F.col("entity_id") * 100 + F.month("cutoff_time"))
    return models.reason_summary(model, rows, COLUMNS, "row_id")


@query("V9")
def v9(spark, d):
    rows = scored(spark, d)
    fitted = models.calibrate(rows)
    return metrics.calibration_error(fitted(rows) if fitted else rows.withColumn("calibrated", F.col("score")), "calibrated", "label")


@query("V12")
def v12(spark, d):
    """Calibrated and given a threshold on the first half of the year, measured on the second."""
    rows = scored(spark, d)
    early, late = (rows.where(f"cutoff_time {op} timestamp_ntz '1996-07-01'") for op in ("<", ">="))
    fitted = models.calibrate(early)
    if not fitted:
        fitted = lambda x: x.withColumn("calibrated", F.col("score"))
    threshold = metrics.best_threshold(fitted(early), "calibrated", "label").first()["threshold"]
    return metrics.at_threshold(fitted(late), "calibrated", "label", threshold)


@query("D1")
def d1(spark, d):
    f = frame(spark, d, parts=FITTED, also=now_eligible(spark, d))
    model, _ = models.fit_validated(f, COLUMNS)
    got = models.predict(model, f.where("part is null"), COLUMNS)
    return scoring.rank_rows(got.select("entity_id", "score")).select("entity_id", "score", "rank", "decile")


def now_eligible(spark: SparkSession, d: str) -> DataFrame:
    every = load(spark, d, "customer"), "c_custkey", lb.cutoffs(spark, "2001-05-01", "2001-05-01", 1, "months")
    return written(lb.apply_rule(lb.entity_cutoffs(*every), t1_rule(spark, d), made_of=every), "keys")


@query("D7")
def d7(spark, d):
    """The rows to fit and those to score get their features together, so orders and their lines are joined once for both."""
    f = frame(spark, d, parts=FITTED, also=now_eligible(spark, d))
    model, _ = models.fit_validated(f, COLUMNS, rounds=5, depth=3)
    return scoring.preview(model, f.where("part is null"), COLUMNS, 20)
