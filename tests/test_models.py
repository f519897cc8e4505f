"""Contributions against all coalitions, multiclass boosting, fits side by side."""

import itertools
import random
import time
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models


def random_tree(rng, depth, features, rows=1000.0):
    nodes = []

    def grow(d, n):
        at = len(nodes)
        nodes.append(None)
        if d == 0 or rng.random() < 0.1:
            nodes[at] = (-1, 0.0, -1, -1, rng.uniform(-2, 2), n)
            return at
        part = rng.uniform(0.1, 0.9)
        f, t = rng.randrange(features), rng.uniform(-1, 1)
        left, right = grow(d - 1, n * part), grow(d - 1, n * (1 - part))
        nodes[at] = (f, t, left, right, 0.0, n)
        return at

    grow(depth, rows)
    return nodes


def expected(nodes, x, known, at=0):
    """A tree's value if only some features are known: unknown ones go both ways by their rows."""
    f, t, left, right, value, rows = nodes[at]
    if f < 0:
        return value
    if f in known:
        return expected(nodes, x, known, left if x[f] <= t else right)
    return sum(nodes[c][5] / rows * expected(nodes, x, known, c) for c in (left, right))


def test_contributions_equal_all_coalitions():
    rng, n = random.Random(3), 5
    trees = [(0.5, random_tree(rng, 4, n)), (1.0, random_tree(rng, 6, n)), (0.3, random_tree(rng, 0, n))]
    x = np.array([[rng.uniform(-1.5, 1.5) for _ in range(n)] for _ in range(12)])
    base, phi = models.contributions([(w, models.leaves_of(t)) for w, t in trees], x)
    for row, got in zip(x, phi, strict=True):
        for i in range(n):
            others = [j for j in range(n) if j != i]
            want = 0.0
            for size in range(n):
                for s in itertools.combinations(others, size):
                    weight = factorial(size) * factorial(n - 1 - size) / factorial(n)
                    want += weight * sum(w * (expected(t, row, {*s, i}) - expected(t, row, set(s))) for w, t in trees)
            assert abs(got[i] - want) < 1e-9
        assert abs(base + got.sum() - sum(w * expected(t, row, set(range(n))) for w, t in trees)) < 1e-9


def test_contributions_of_many_rows_are_quick():
    rng = random.Random(4)
    trees = [(1.0, models.leaves_of(random_tree(rng, 5, 12))) for _ in range(10)]
    x = np.random.default_rng(1).uniform(-1.5, 1.5, (100_000, 12))
    began = time.process_time()
    models.contributions(trees, x)
    assert time.process_time() - began < 60


def test_deep_paths_share_patterns_beyond_a_word():
    nodes, n = [], 70
    for i in range(n):  # a chain of 70 different features
        nodes.append((i, 0.0, 2 * i + 1, 2 * i + 2, 0.0, float(2 * (n - i))))
        nodes.append((-1, 0.0, -1, -1, float(i), 1.0))
    nodes.append((-1, 0.0, -1, -1, 5.0, 1.0))
    chain = [(f, t, l, r, v, w) for f, t, l, r, v, w in nodes]
    leaves = models.leaves_of(chain)
    assert max(len(x.features) for x in leaves) == n
    x = np.random.default_rng(2).uniform(-1, 1, (8, n))
    base, phi = models.contributions([(1.0, leaves)], x)
    want = [expected(chain, row, set(range(n))) for row in x]
    assert np.allclose(base + phi.sum(axis=1), want, atol=1e-6)


def test_softmax_boosting_beats_a_forest(spark):
    """Three classes by two thresholds and a product, one class that only the validation rows have."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    from tidemark.operators import metrics

    df = spark.range(1500).select("id", (F.rand(1) * 2 - 1).alias("a"), (F.rand(2) * 2 - 1).alias("b"), F.when(F.rand(3) > 0.2, F.rand(4)).alias("c"))
    kind = F.when(F.col("a") * F.col("b") > 0.1, "both").when(F.coalesce("c", F.lit(0.0)) > 0.5, "high").otherwise("low")
    df = df.withColumn("part", F.when(F.col("id") % 4 == 0, "val").otherwise("train")).withColumn("label", F.when(F.col("id") % 100 == 0, "rare").otherwise(kind)).cache()
    model, _ = models.fit_validated(df, ["a", "b", "c"], kind="multiclass", rounds=12)
    assert model.classes == ("both", "high", "low") and 1 <= len(model.rounds) <= 12
    val = models.predict_classes(model, df.where("part = 'val'"), ["a", "b", "c"])
    place = F.array_position(F.array(*map(F.lit, model.classes)), F.col("label")).cast("int") - 1
    got = metrics.multiclass(val, "label", "prediction", F.coalesce(F.get("probabilities", place), F.lit(0.0)), df.where("part = 'train'")).first()
    assert got.n_unseen_class == 15 and got.accuracy > 0.9
    data, _ = models.ready(df, ["a", "b", "c"])
    train = data.where("part = 'train'")
    indexed = StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip").fit(train)
    forest = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=4, seed=7).fit(indexed.transform(train))
    out = PipelineModel([indexed, forest]).transform(data.where("part = 'val'"))
    loss = metrics.log_loss(out, F.element_at(models.vector_to_array("probability"), F.col("y").cast("int") + 1)).first()[0]
    assert got.log_loss < loss
    p = np.array([r.probabilities for r in val.collect()])
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def test_softmax_needs_two_classes(spark):
    df = spark.range(20).select(F.lit("x").alias("label"), F.rand(1).alias("a"), F.lit("train").alias("part"))
    with pytest.raises(ValueError, match="classes"):
        models.fit_validated(df, ["a"], kind="multiclass")


def test_fits_side_by_side_keep_their_order_and_failures():
    def slow(i):
        time.sleep(0.2 * (3 - i))
        return i

    began = time.time()
    assert models.side_by_side([lambda i=i: slow(i) for i in range(3)]) == [0, 1, 2]
    assert time.time() - began < 1.1
    with pytest.raises(ZeroDivisionError):
        models.side_by_side([lambda: 1, lambda: 1 // 0])


def test_isotonic_is_fitted_to_pooled_scores(spark, monkeypatch):
    """One row for each score reaches the fit, and it gives what the single rows give."""
    from pyspark.ml.regression import IsotonicRegression

    df = spark.range(4000).select((F.pmod(F.col("id") * 7919, F.lit(50)) / 50).alias("score"), (F.pmod(F.xxhash64("id"), F.lit(100)) < F.pmod(F.col("id") * 7919, F.lit(50))).cast("int").alias("label"))
    seen, plain = [], IsotonicRegression.fit
    want = plain(IsotonicRegression(featuresCol="score", labelCol="label"), df.withColumn("label", F.col("label").cast("double")))
    monkeypatch.setattr(IsotonicRegression, "fit", lambda self, rows: (seen.append(rows.count()), plain(self, rows))[1])
    fitted = models.calibrate(df)
    assert seen == [50]
    a = {r.score: r.calibrated for r in fitted(df).distinct().collect()}
    b = {r.score: r.prediction for r in want.transform(df).distinct().collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_battery_keeps_only_what_its_fits_read(spark, monkeypatch):
    df = spark.range(300).select("id", F.rand(1).alias("a"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test").alias("part"))
    kept, plain = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: (kept.append((self.columns, self.count())), plain(self, *a))[1] if not kept else plain(self, *a))
    got = models.battery(df, ["a"])
    assert kept == [(["features", "label_d", "part"], 200)] and got.where("error is null").count() == 3


def test_frames_of_some_parts_are_those_rows_of_the_whole(spark):
    from tidemark.plans import model_queries as mq

    d = "/root/testdata/sf0.001"
    whole, some = mq.frame(spark, d), mq.frame(spark, d, parts=mq.FITTED)
    assert whole.columns == some.columns
    assert sorted(map(str, whole.where("part in ('train', 'val')").collect())) == sorted(map(str, some.collect()))


def test_vectors_are_kept_while_a_fit_reads_them(spark, monkeypatch):
    df = spark.range(300).select("id", F.rand(1).alias("a"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("part"))
    kept, plain = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: (kept.append(plain(self, *a)), kept[-1])[1])
    models.fit_validated(df, ["a"], rounds=2)
    assert [k.columns for k in kept] == [["features", "label_d", "_val"]]
    for made, n in ((models.compare(df, ["a"]), 3), (models.search(df, ["a"], tries=2), 2)):
        assert made.count() == n
    assert [k.columns for k in kept] == [["features", "label_d", "_val"], ["features", "label_d", "part"], ["features", "label_d", "_val"]]
    assert not any(k.storageLevel.useMemory for k in kept)  # and let go after it


def test_parts_that_are_not_read_get_no_spine(spark, monkeypatch):
    from tidemark.operators import labels as lb
    from tidemark.plans import reference_queries as rq

    spines, plain = [], lb.apply_rule
    monkeypatch.setattr(lb, "apply_rule", lambda *a, **k: (spines.append(a[0].select("cutoff_time").distinct().count()), plain(*a, **k))[1])
    d = "/root/testdata/sf0.001"
    whole = rq.parted(spark, d)
    some, early = rq.parted(spark, d, ("train", "val")), rq.parted(spark, d, where="cutoff_time < timestamp_ntz '1996-10-01'")
    assert spines == [12, 5, 9]
    for got, where in ((some, "part in ('train', 'val')"), (early, "cutoff_time < timestamp_ntz '1996-10-01'")):
        assert got.columns == whole.columns and sorted(map(str, got.collect())) == sorted(map(str, whole.where(where).collect()))


def test_rows_to_score_share_the_pass_of_the_rows_to_fit(spark, monkeypatch):
    """D7 joins orders and their lines once, and the rows are those of two frames."""
    from tidemark.operators import intervals
    from tidemark.plans import model_queries as mq

    d = "/root/testdata/sf0.001"
    columns = ["entity_id", "cutoff_time", *mq.COLUMNS]
    both = mq.frame(spark, d, parts=mq.FITTED, also=mq.now_eligible(spark, d))
    fit, now = mq.frame(spark, d, parts=mq.FITTED), mq.frame(spark, d, mq.now_eligible(spark, d))
    assert sorted(map(str, both.where("part is not null").collect())) == sorted(map(str, fit.collect())) != []
    scored = both.where("part is null")
    assert scored.where("label is not null or label_window_end is not null").count() == 0
    assert sorted(map(str, scored.select(*columns).collect())) == sorted(map(str, now.select(*columns).collect())) != []
    joins, passes, path, paired = [], [], mq.items_path, intervals._paired
    monkeypatch.setattr(mq, "items_path", lambda *a: (joins.append(1), path(*a))[1])
    monkeypatch.setattr(intervals, "_paired", lambda *a: (passes.append(1), paired(*a))[1])
    assert mq.d7(spark, d).count() == 20
    assert len(joins) == 1 and len(passes) == 1


def test_labels_and_features_are_one_aggregation(spark, monkeypatch):
    from tidemark.operators import intervals
    from tidemark.plans import model_queries as mq
    from tidemark.plans import reference_queries as rq

    d = "/root/testdata/sf0.001"
    want = rq.parted(spark, d, mq.FITTED).select("entity_id", "cutoff_time", "label", "label_window_end", "part")
    passes, paired = [], intervals._paired
    monkeypatch.setattr(intervals, "_paired", lambda *a: (passes.append(1), paired(*a))[1])
    got = mq.frame(spark, d, parts=mq.FITTED)
    assert len(passes) == 1
    assert got.select(*want.columns).dtypes == want.dtypes
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) != []


def test_a_summary_explains_its_rows_once(spark, monkeypatch):
    df = spark.range(300).select("id", F.rand(1).alias("a"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("part"))
    model, _ = models.fit_validated(df, ["a"], rounds=2)
    made, plain = spark.sparkContext.accumulator(0), models.contributions
    monkeypatch.setattr(models, "contributions", lambda trees, x: (made.add(len(x)), plain(trees, x))[1])
    got = models.reason_summary(model, df.where("part = 'val'"), ["a"], "id").collect()
    assert [r["share"] for r in got] == [1.0] and made.value == 100


def test_a_summary_is_over_all_rows(spark):
    """The means of all 3,000 rows, not of 2,000 drawn from them."""
    df = spark.range(6000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.when(F.col("id") % 2 == 0, "val").otherwise("train").alias("part"))
    df = df.withColumn("label", (F.col("a") + F.col("b") * F.col("b") > 0.8).cast("int")).cache()
    model, _ = models.fit_validated(df, ["a", "b"], rounds=3)
    val = df.where("part = 'val'")
    each = np.array([r.contributions for r in models.reasons(model, val, ["a", "b"], "id").collect()])
    got = {r.source: r for r in models.reason_summary(model, val, ["a", "b"], "id").collect()}
    want = np.abs(each).mean(axis=0)
    assert len(each) == 3000 and (want > 0).all()
    assert np.allclose([got[c].mean_abs for c in ("a", "b")], want, rtol=1e-9)
    assert np.allclose([got[c].share for c in ("a", "b")], want / want.sum(), rtol=1e-9)


@pytest.mark.parametrize("noise", [0.02, 0.9])
def test_a_search_covers_the_grid_as_single_fits_do(spark, noise):
    """Little noise: fits that go on to their last round; much: fits that are stopped early and stand for more rounds."""
    df = spark.range(1200).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("u"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("part"))
    df = df.withColumn("label", ((F.col("a") * F.col("b") > 0.25) != (F.col("u") < noise / 2)).cast("int")).cache()
    data, _ = models.ready(df, ["a", "b"])
    data = data.withColumn("label_d", F.col("label").cast("double")).withColumn("_val", F.col("part") == "val")
    want, trees = [], []
    depths = (2, 3, 4) if noise > 0.5 else (2,)
    for depth, rounds in itertools.product(depths, (5, 10, 20)):
        model = models.boosted("binary", rounds, depth, 7).fit(data)
        trees.append((rounds, model.getNumTrees))
        scored = model.transform(data.where("_val")).withColumn("score", models.vector_to_array("probability")[1])
        want.append((depth, rounds, models.metrics.roc_auc(scored, "score", "label_d").first()[0]))
    assert any(n < r for r, n in trees) if noise > 0.5 else any(n == r > 5 for r, n in trees)
    got = [tuple(r) for r in models.search(df, ["a", "b"]).collect()]
    assert len(got) == 9 and [r for r in got if r[0] in depths] == sorted(want, key=lambda r: (-r[2], r[0], r[1]))


def test_the_search_query_fits_the_whole_grid(spark):
    from tidemark.plans import model_queries as mq

    got = mq.m5(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.depth, r.rounds) for r in got) == list(itertools.product((2, 3, 4), (5, 10, 20)))
