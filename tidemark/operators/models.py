"""Models over feature frames with MLlib: boosted trees, baselines, search, ensembles, selection, reasons."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.sources.shared import written

#: Fits that run side by side; Spark's scheduler shares the cores among their jobs.
AT_ONCE = 4


def side_by_side(jobs: list[Callable], most: int = AT_ONCE) -> list:
    """The results of all jobs in order, several running at a time; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(max(1, min(most, len(jobs)))) as pool:
        begun = [pool.submit(inheritable_thread_target(job)) for job in jobs]
    return [b.result() for b in begun]


def ready(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df and `features`: missing values as 0 beside an indicator column for each (MLlib has no missing values)."""
    names = [*columns, *[f"{c}_missing" for c in columns]]
    x = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns} | {f"_f_{c}_missing": F.col(c).isNull().cast("double") for c in columns})
    return VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol="features").transform(x).drop(*[f"_f_{n}" for n in names]), names


def task_kind(labels: DataFrame, label: str = "label", most_classes: int = 30) -> str:
    """binary, multiclass, tweedie (no negatives, over 30 per cent zeros) or regression."""
    y = F.col(label).cast("double")
    if labels.schema[label].dataType.simpleString() == "string":
        return "multiclass"
    r = labels.agg(F.count_if(~y.isin(0.0, 1.0)).alias("other"), F.min(y).alias("least"), F.avg((y == 0).cast("double")).alias("zeros")).first()
    return "binary" if r["other"] == 0 else "tweedie" if r["least"] >= 0 and r["zeros"] > 0.3 else "regression"


def fit_validated(df: DataFrame, columns: list[str], label: str = "label", kind: str = "binary", rounds: int = 20, depth: int = 4, seed: int = 7):
    """(model, feature names): trees on part train, stopped early on part val."""
    data, names = ready(df.where(F.col("part").isin("train", "val")), columns)
    data = data.withColumn("_val", F.col("part") == "val").withColumn("label_d", F.col(label).cast("double"))
    if kind == "tweedie":
        return GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="label_d", maxIter=20, regParam=0.01).fit(data.where(~F.col("_val"))), names
    if kind == "multiclass":
        return fit_softmax(data, label, rounds=rounds, depth=depth, seed=seed), names
    data = data.select("features", "label_d", "_val").persist()  # vectors are assembled once, not for each of the fit's passes
    try:
        return boosted(kind, rounds, depth, seed).fit(data), names
    finally:
        data.unpersist()


def boosted(kind: str, rounds: int, depth: int, seed: int):
    maker = GBTClassifier if kind == "binary" else GBTRegressor
    return maker(labelCol="label_d", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed, validationIndicatorCol="_val")


@dataclass(frozen=True)
class SoftmaxTrees:
    """Boosted trees for several classes: in each round a regression tree for each class adds to that class's margin."""

    classes: tuple[str, ...]
    start: tuple[float, ...]
    step: float
    rounds: tuple[tuple[list, ...], ...] = field(default=())  # nodes of each round's trees, by class

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probabilities (in the order of classes) and prediction, a class."""
        trees, start, step = self.rounds, np.array(self.start), self.step

        @F.pandas_udf("array<double>")
        def share(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            margins = np.tile(start, (len(rows), 1))
            for some in trees:
                for k, nodes in enumerate(some):
                    margins[:, k] += step * leaf_values(nodes, rows)
            e = np.exp(margins - margins.max(axis=1, keepdims=True))
            return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

        out = df.withColumn("probabilities", share(vector_to_array("features")))
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn("prediction", F.get(names, F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1))


def leaf_values(nodes: list, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of x comes to."""
    feature, threshold, left, right, value = (np.array([n[i] for n in nodes]) for i in range(5))
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (inner := feature[at] >= 0).any():
        go = rows[inner]
        here = at[inner]
        at[go] = np.where(x[go, feature[here]] <= threshold[here], left[here], right[here])
    return value[at]


def fit_softmax(data: DataFrame, label: str, rounds: int = 20, depth: int = 4, step: float = 0.3, patience: int = 3, most_classes: int = 30, seed: int = 7) -> SoftmaxTrees:
    """Newton boosting of the softmax loss on rows without `_val`, ended by the loss of those with it.

    In each round the trees of all classes are fitted side by side: to the residual over p(1 - p), weighed by p(1 - p), so
    that a leaf's mean is its Newton step. Only the vectors, the class and the margins are written between rounds. Classes
    are those of the training rows; other rows are not part of the loss.
    """
    counts = {r["c"]: r["n"] for r in data.where(~F.col("_val") & F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("c")).agg(F.count("*").alias("n")).limit(most_classes + 1).collect()}
    if not 2 <= len(counts) <= most_classes:
        raise ValueError(f"between 2 and {most_classes} classes, not {len(counts)}")
    classes, total = tuple(sorted(counts)), sum(counts.values())
    start = tuple(float(np.log(counts[c] / total)) for c in classes)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1
    rows = written(data.select("features", number.alias("y"), "_val", F.array(*[F.lit(v) for v in start]).alias("m")).where("y >= 0"), "boosting")
    k, made, best, best_loss = len(classes), [], 0, None
    top = F.array_max("m")
    shares = F.transform("m", lambda v: F.exp(v - top))
    p = [shares[c] / F.aggregate(shares, F.lit(0.0), lambda a, v: a + v) for c in range(k)]

    def tree(c: int):
        weight = F.greatest(p[c] * (1 - p[c]), F.lit(1e-6))
        target = ((F.col("y") == c).cast("double") - p[c]) / weight * F.lit((k - 1) / k)
        part = rows.where("not _val").select("features", weight.alias("w"), F.greatest(F.least(target, F.lit(4.0)), F.lit(-4.0)).alias("t"))
        return DecisionTreeRegressor(labelCol="t", weightCol="w", maxDepth=depth, seed=seed + c).fit(part)

    for _ in range(rounds):
        fitted = side_by_side([lambda c=c: tree(c) for c in range(k)])
        for c, t in enumerate(fitted):
            rows = t.setPredictionCol(f"t{c}").transform(rows)
        grown = F.array(*[F.col("m")[c] + F.lit(step) * F.col(f"t{c}") for c in range(k)])
        rows = written(rows.select("features", "y", "_val", grown.alias("m")), "boosting")
        made.append(tuple(nodes_of(t) for t in fitted))
        loss = rows.where("_val").agg(F.avg(F.log(F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)) + top - F.get("m", F.col("y").cast("int")))).first()[0]
        if loss is None or best_loss is None or loss < best_loss:
            best, best_loss = len(made), loss
        elif len(made) - best >= patience:
            break
    return SoftmaxTrees(classes, start, step, tuple(made[:best]))


def predict_classes(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with prediction (a class) and probabilities."""
    data, _ = ready(df, columns)
    return model.transform(data).select(*df.columns, "prediction", "probabilities")


def predict(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """df and score: the probability of class 1, or the prediction."""
    data, _ = ready(df, columns)
    out = model.transform(data)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*df.columns, score.alias("score"))


def engines(seed: int = 7) -> dict:
    return {"random_forest": RandomForestClassifier(labelCol="label_d", numTrees=20, maxDepth=5, seed=seed), "gradient_boosting": GBTClassifier(labelCol="label_d", maxIter=10, maxDepth=3, seed=seed), "logistic_regression": LogisticRegression(labelCol="label_d", maxIter=30, regParam=0.01)}


def battery(df: DataFrame, columns: list[str], label: str = "label", makers: dict | None = None) -> DataFrame:
    """model, accuracy, f1, error on part val; one model's failure does not stop the others."""
    data, _ = ready(df.where(F.col("part").isin("train", "val")).withColumn("label_d", F.col(label).cast("double")), columns)
    data = data.select("features", "label_d", "part").persist()  # all fits read it; the scores below are small and brought in before it is let go

    def one(name: str, maker) -> tuple:
        try:
            got = maker.fit(data.where("part = 'train'")).transform(data.where("part = 'val'"))
            r = metrics.classification(got, "label_d", "prediction").first()
            return name, r["accuracy"], r["f1"], None
        except Exception as e:  # noqa: BLE001
            return name, None, None, str(e)[:200]

    out = side_by_side([lambda n=n, m=m: one(n, m) for n, m in (makers or engines()).items()])
    data.unpersist()
    return df.sparkSession.createDataFrame(out, "model string, accuracy double, f1 double, error string")


def compare(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """The classification measures of each engine on part val, and engine; all fits and scores read vectors that are assembled once."""
    data, _ = ready(df.where(F.col("part").isin("train", "val")).withColumn("label_d", F.col(label).cast("double")), columns)
    data = data.select("features", "label_d", "part").persist()

    def one(name: str, maker) -> tuple:
        got = metrics.classification(maker.fit(data.where("part = 'train'")).transform(data.where("part = 'val'")), "label_d", "prediction")
        got = got.withColumn("engine", F.lit(name))
        return got.schema, tuple(got.first())

    try:
        out = side_by_side([lambda n=n, m=m: one(n, m) for n, m in engines().items()])
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame([r for _, r in out], out[0][0])


def search(df: DataFrame, columns: list[str], label: str = "label", tries: int | None = None, seed: int = 7) -> DataFrame:
    """depth, rounds, roc_auc on part val for all of the grid (or a seeded choice of `tries`), the best first, of equals the smaller model.

    A fit that part val has stopped before its last round is the fit of more rounds too (same rows, seed and stop), so it
    is made and scored once for them.
    """
    grid = list(itertools.product((2, 3, 4), (5, 10, 20)))
    random.Random(seed).shuffle(grid)
    chosen = sorted(grid[:tries])
    data, _ = ready(df.where(F.col("part").isin("train", "val")), columns)
    data = data.select("features", F.col(label).cast("double").alias("label_d"), (F.col("part") == "val").alias("_val")).persist()  # all fits and their scores read it

    def one(depth: int) -> list[tuple]:
        out, stopped = [], False
        for rounds in (r for d, r in chosen if d == depth):
            if not stopped:
                model = boosted("binary", rounds, depth, seed).fit(data)
                stopped = model.getNumTrees < rounds
                scored = model.transform(data.where("_val")).withColumn("score", vector_to_array("probability")[1])
                auc = metrics.roc_auc(scored, "score", "label_d").first()[0]
            out.append((depth, rounds, auc))
        return out

    try:
        rows = sum(side_by_side([lambda d=d: one(d) for d in sorted({d for d, _ in chosen})]), [])
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-(r[2] or 0), *r[:2])), "depth int, rounds int, roc_auc double")


def vote(predictions: list[DataFrame], key: str) -> DataFrame:
    """key, vote: the most frequent of the models' predictions (ties: the smallest)."""
    both = None
    for p in predictions:
        one = p.select(key, F.col("prediction").alias("p"))
        both = one if both is None else both.union(one)
    counts = both.groupBy(key, "p").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("vote"))


def fold_scores(df: DataFrame, columns: list[str], folds: list[str], label: str = "label", seed: int = 7) -> DataFrame:
    """fold, roc_auc for each fold column, whose values are 'train' and 'val'."""

    def one(i: int, f: str) -> tuple:
        part = df.withColumn("part", F.col(f)).where("part is not null")
        model, _ = fit_validated(part, columns, label, rounds=8, depth=3, seed=seed)
        return i + 1, metrics.roc_auc(predict(model, part.where("part = 'val'"), columns), "score", label).first()[0]

    rows = side_by_side([lambda i=i, f=f: one(i, f) for i, f in enumerate(folds)])
    return df.sparkSession.createDataFrame(rows, "fold int, roc_auc double")


def forward_selection(df: DataFrame, base: list[str], candidates: list[str], folds: list[str], label: str = "label", patience: int = 3, max_rounds: int = 20) -> tuple[list[str], list[dict]]:
    """Columns accepted one at a time by the paired gain rule on the folds, and what was decided. Test rows are not read."""
    kept, log, misses = list(base), [], 0
    before = fold_scores(df, kept, folds, label) if kept else None
    for c in candidates[:max_rounds]:
        now = fold_scores(df, [*kept, c], folds, label)
        pairs = now.withColumnRenamed("roc_auc", "cand").join(before.withColumnRenamed("roc_auc", "base"), "fold") if before is not None else now.select("fold", F.col("roc_auc").alias("cand"), F.lit(0.5).alias("base"))
        r = metrics.paired_gain(pairs).first()
        log.append({"column": c, "gain": r["mean_gain"], "accepted": r["accepted"]})
        misses = 0 if r["accepted"] else misses + 1
        if r["accepted"]:
            kept, before = [*kept, c], now
        if misses >= patience:
            break
    return kept, log


def refit_score(df: DataFrame, columns: list[str], label: str = "label", rounds: int = 8, depth: int = 3, seed: int = 7) -> DataFrame:
    """roc_auc, n_test: the chosen columns' model, fitted once more on parts train and val, on part test; to be read once, at the end."""
    data, _ = ready(df.where(F.col("part").isin("train", "val")).withColumn("label_d", F.col(label).cast("double")), columns)
    model = GBTClassifier(labelCol="label_d", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed).fit(data)
    test = predict(model, df.where("part = 'test'"), columns)
    return metrics.roc_auc(test, "score", label).crossJoin(test.agg(F.count("*").alias("n_test")))  # one row each


def rebuilds(model, df: DataFrame, columns: list[str], recorded: float, label: str = "label") -> bool:
    """Whether the metric on part val is rebuilt from the stored features and model within 1e-6."""
    now = metrics.roc_auc(predict(model, df.where("part = 'val'"), columns), "score", label).first()[0]
    return abs(now - recorded) <= 1e-6


def importances(model, names: list[str], spark, n: int = 20) -> DataFrame:
    """source, share: importance summed back to the source column."""
    values = np.asarray(model.featureImportances.toArray())
    rows = [(c.removesuffix("_missing"), float(v)) for c, v in zip(names, values, strict=True)]
    df = spark.createDataFrame(rows, "source string, v double")
    return df.groupBy("source").agg(F.sum("v").alias("share")).orderBy(F.desc("share"), "source").limit(n)


def calibrate(df: DataFrame, p: str = "score", label: str = "label", least_error: float = 0.05, isotonic_rows: int = 1000):
    """None if the error is small; else a function that adds `calibrated`: isotonic from 1,000 rows on, Platt below."""
    if (metrics.calibration_error(df, p, label).first()[0] or 0) <= least_error:
        return None
    data = df.select(F.col(p).alias("p"), F.col(label).cast("double").alias("label"))
    if df.count() >= isotonic_rows:
        # rows of one score are pooled before anything else, so each score is one row weighed by its rows
        pooled = data.groupBy("p").agg(F.avg("label").alias("label"), F.count("label").cast("double").alias("n")).where("n > 0")
        model = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="n").fit(pooled)
        return lambda d: model.setFeaturesCol(p).setPredictionCol("calibrated").transform(d)
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    fitted = LogisticRegression(labelCol="label").fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(data.withColumn("z", logit(F.col("p")))))
    a, b = float(fitted.coefficients[0]), float(fitted.intercept)
    return lambda d: d.withColumn("calibrated", 1 / (1 + F.exp(-(logit(F.col(p)) * a + b))))


def nodes_of(tree) -> list:
    """The nodes of a tree: (feature, threshold, left, right, value, weight of rows), the root first; leaves have feature -1."""
    nodes: list = []

    def walk(n) -> int:
        at = len(nodes)
        nodes.append(None)
        rows = float(n.impurityStats().count())
        if n.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, -1, -1, float(n.prediction()), rows)
        else:
            left, right = walk(n.leftChild()), walk(n.rightChild())
            nodes[at] = (int(n.split().featureIndex()), float(n.split().threshold()), left, right, 0.0, rows)
        return at

    walk(tree._call_java("rootNode"))
    return nodes


def trees_of(model) -> list[tuple[float, list]]:
    """(weight, nodes) of each tree."""
    return [(float(w), nodes_of(t)) for w, t in zip(model.treeWeights, model.trees, strict=True)]


@dataclass(frozen=True)
class Leaf:
    """A leaf's path: its distinct features, the share of rows that follow the path where a feature is unknown, and the splits to pass."""

    value: float
    features: np.ndarray  # the path's distinct features
    shares: np.ndarray  # for each of them, the share of rows that go this way
    splits: tuple[tuple[int, int, float, bool], ...]  # place among features, feature, threshold, whether to the left


def leaves_of(nodes: list) -> list[Leaf]:
    """The paths of a tree from `trees_of`."""
    out = []
    todo: list[tuple[int, dict[int, float], tuple]] = [(0, {}, ())]
    while todo:
        at, shares, splits = todo.pop()
        f, threshold, left, right, value, rows = nodes[at]
        if f < 0:
            place = {x: k for k, x in enumerate(shares)}
            out.append(Leaf(value, np.array(list(shares), np.int64), np.array(list(shares.values())), tuple((place[x], x, t, to) for x, t, to in splits)))
            continue
        for child, to in ((left, True), (right, False)):
            todo.append((child, shares | {f: shares.get(f, 1.0) * nodes[child][5] / rows}, (*splits, (f, threshold, to))))
    return out


def coalition_weights(shares: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """For each pattern (row of `follows`: whether each feature of the path leads to the leaf) the features' exact Shapley shares of its value.

    Over the other features of a path, the products of (share or follows) are collected by the coalition's size; sizes
    are weighed by the share of orders in which just that many features come first.
    """
    rows, m = follows.shape
    hits, out = follows.astype(float), np.empty((rows, m))
    orders = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    for i in range(m):
        sizes = np.ones((rows, 1))
        for j in range(m):
            if j != i:
                wider = np.zeros((rows, sizes.shape[1] + 1))
                wider[:, :-1] = sizes * shares[j]
                wider[:, 1:] += sizes * hits[:, j : j + 1]
                sizes = wider
        out[:, i] = (hits[:, i] - shares[i]) * (sizes * orders).sum(axis=1)
    return out


def contributions(trees: list[tuple[float, list[Leaf]]], x: np.ndarray) -> tuple[float, np.ndarray]:
    """The expected value of all trees and the exact contributions of each feature (columns) to each row of x.

    Rows that pass and fail the same features of a leaf's path share one evaluation, so its cost is bounded by the
    patterns that occur, not by the rows.
    """
    base, phi = 0.0, np.zeros(x.shape)
    for weight, leaves in trees:
        for leaf in leaves:
            base += weight * leaf.value * float(leaf.shares.prod())
            if not len(leaf.features):
                continue
            follows = np.ones((len(x), len(leaf.features)), bool)
            for place, feature, threshold, left in leaf.splits:
                follows[:, place] &= (x[:, feature] <= threshold) == left
            if len(leaf.features) < 63:
                code = (follows << np.arange(len(leaf.features), dtype=np.int64)).sum(axis=1)
                _, first, which = np.unique(code, return_index=True, return_inverse=True)
            else:
                _, first, which = np.unique(np.packbits(follows, axis=1), axis=0, return_index=True, return_inverse=True)
            shares = coalition_weights(leaf.shares, follows[first])
            phi[:, leaf.features] += weight * leaf.value * shares[which.ravel()]
    return base, phi


def reasons(model, df: DataFrame, columns: list[str], key: str, top: int = 3) -> DataFrame:
    """key, margin, base, reason_1 ... and contributions, summed back to source columns: base + their sum is the margin."""
    trees = [(w, leaves_of(nodes)) for w, nodes in trees_of(model)]
    data, names = ready(df, columns)
    place = {c: i for i, c in enumerate(columns)}
    source = np.array([place[n.removesuffix("_missing")] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(names))
            base, phi = contributions(trees, x)
            total = np.zeros((len(x), len(columns)))
            np.add.at(total.T, source, phi.T)
            order = np.argsort(-np.abs(total), axis=1, kind="stable")[:, :top]
            named = pa.array(np.array(columns, object)[order].ravel(), pa.string())
            shares, chosen = (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), v) for n, v in ((len(columns), pa.array(total.ravel())), (order.shape[1], named)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), base)), pa.array(base + total.sum(axis=1)), shares, chosen], names=[key, "base", "margin", "contributions", "reasons"])

    kind = dict(df.dtypes)[key]
    out = data.select(key, vector_to_array("features").alias("x")).mapInArrow(run, f"{key} {kind}, base double, margin double, contributions array<double>, reasons array<string>")
    return out.select(key, "base", "margin", "contributions", *[F.get("reasons", F.lit(i)).alias(f"reason_{i + 1}") for i in range(top)])


def reason_summary(model, df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """source, mean_abs, share: the mean size of each column's contributions over all rows of df."""
    each = reasons(model, df, columns, key).select(F.posexplode("contributions").alias("i", "v"))
    means = written(each.groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs")), "means")  # rows are explained once, not for the total too
    total = means.agg(F.sum("mean_abs").alias("t"))
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return means.crossJoin(F.broadcast(total)).select(named.alias("source"), "mean_abs", F.try_divide("mean_abs", "t").alias("share"))
