"""Learners by name: Spark ML estimators behind one interface, and the learners that Spark lacks in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml import classification as C
from pyspark.ml import regression as G
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Estimator factories by learner name; keyword arguments go to the estimator.
LEARNERS: dict[str, Callable[..., Estimator]] = {
    "logistic": lambda **k: C.LogisticRegression(**{"maxIter": 30} | k),
    "elastic_net": lambda **k: C.LogisticRegression(**{"maxIter": 30, "regParam": 0.01, "elasticNetParam": 0.5} | k),
    "linear_svm": lambda **k: C.LinearSVC(**{"maxIter": 30, "regParam": 0.01} | k),
    "tree": lambda **k: C.DecisionTreeClassifier(**{"maxDepth": 5, "seed": SEED} | k),
    "forest": lambda **k: C.RandomForestClassifier(**{"numTrees": 20, "maxDepth": 5, "seed": SEED} | k),
    "boosting": lambda **k: C.GBTClassifier(**{"maxIter": 8, "maxDepth": 3, "seed": SEED} | k),
    "perceptron": lambda **k: C.MultilayerPerceptronClassifier(**{"maxIter": 40, "seed": SEED} | k),
    "bayes": lambda **k: C.NaiveBayes(**{"modelType": "gaussian"} | k),
    "linear": lambda **k: G.LinearRegression(**{"regParam": 0.0} | k),
    "lasso": lambda **k: G.LinearRegression(**{"regParam": 0.01, "elasticNetParam": 1.0} | k),
    "glm": lambda **k: G.GeneralizedLinearRegression(**{"family": "gaussian"} | k),
    "tree_regression": lambda **k: G.DecisionTreeRegressor(**{"maxDepth": 5, "seed": SEED} | k),
    "forest_regression": lambda **k: G.RandomForestRegressor(**{"numTrees": 20, "maxDepth": 5, "seed": SEED} | k),
    "boosting_regression": lambda **k: G.GBTRegressor(**{"maxIter": 8, "maxDepth": 3, "seed": SEED} | k),
    "survival": lambda **k: G.AFTSurvivalRegression(**{"censorCol": "censor"} | k),
    "isotonic": lambda **k: G.IsotonicRegression(**k),
}


def vectors(df: DataFrame, array: str, label: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>"))).withColumn("label", F.col(label).cast("double"))


def predict(name: str, train: DataFrame, test: DataFrame, case: str, **options) -> DataFrame:
    """(case, prediction) of the test rows."""
    model = LEARNERS[name](**options).fit(train)
    return model.transform(test).select(case, F.col("prediction"))


def components(train: DataFrame, df: DataFrame, case: str, k: int) -> DataFrame:
    """Scores on the first k principal components; signs are fixed by each component's largest loading."""
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(train)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)]).tolist()
    scores = vector_to_array("scores")
    return model.transform(df).select(case, F.array(*[scores[i] * sign[i] for i in range(k)]).alias("scores"))


def ridge_grid(rows: DataFrame, keys: list[str], features: str, y: str, in_test: str, grid: list[float]) -> DataFrame:
    """Ridge regression for each fold and penalty: Gram matrices summed by Spark, solved once a fold, scored by a join.

    keys: the fold columns. Returns (keys, penalty, mse) on the test rows.
    """
    d = len(rows.select(features).first()[0])
    width = d + 1

    def gram(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys):
                x = np.c_[np.ones(len(part)), np.array(part[features].tolist(), dtype=float)]
                v = part[y].to_numpy(dtype=float)
                z = np.c_[x, v]
                total[key] = total.get(key, 0) + z.T @ z
        for key, g in total.items():
            yield pd.DataFrame({**{c: [k] for c, k in zip(keys, key, strict=True)}, "g": [g.ravel().tolist()]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    parts = rows.select(*keys, features, y, in_test).withColumn("_part", F.col(in_test))

    def sums(df: DataFrame) -> DataFrame:
        g = df.select(*keys, features, y).mapInPandas(gram, f"{head}, g array<double>")
        flat = g.select(*keys, F.posexplode("g").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        return flat.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("g"))  # width squared values a fold

    train, test = sums(parts.filter(~F.col("_part"))), sums(parts.filter("_part")).withColumnRenamed("g", "h")

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g, h = (np.array(row[c]).reshape(width + 1, width + 1) for c in ("g", "h"))
                for p in grid:
                    pen = np.eye(width) * p
                    pen[0, 0] = 0
                    b = np.linalg.solve(g[:width, :width] + pen, g[:width, width])
                    sse = h[width, width] - 2 * b @ h[:width, width] + b @ h[:width, :width] @ b
                    out.append({**{k: row[k] for k in keys}, "penalty": p, "mse": sse / h[0, 0]})
            yield pd.DataFrame(out)

    return train.join(test, keys).mapInPandas(solve, f"{head}, penalty double, mse double")


def nmf(df: DataFrame, case: str, features: str, k: int, rounds: int = 40) -> DataFrame:
    """Non-negative factors by multiplicative updates: rows keep their own weights, the k x d factor is summed by Spark.

    Each round is one pass; only the k x d factor and its sums meet on the driver.
    """
    d = len(df.select(features).first()[0])
    h = np.random.default_rng(SEED).uniform(0.1, 1, (k, d))

    def weights(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = np.full((len(x), k), 0.5)
        for _ in range(30):
            w *= (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        return w

    for _ in range(rounds // 10):
        def step(batches, h=h):
            a, b = np.zeros((k, d)), np.zeros((k, k))
            for pdf in batches:
                x = np.array(pdf[features].tolist(), dtype=float)
                if len(x):
                    w = weights(x, h)
                    a, b = a + w.T @ x, b + w.T @ w
            yield pd.DataFrame({"a": [a.ravel().tolist()], "b": [b.ravel().tolist()]})

        rows = df.select(features).mapInPandas(step, "a array<double>, b array<double>").collect()  # k x d numbers a partition
        a, b = sum(np.array(r["a"]) for r in rows).reshape(k, d), sum(np.array(r["b"]) for r in rows).reshape(k, k)
        for _ in range(10):
            h = h * a / np.maximum(b @ h, 1e-12)

    def last(batches):
        for pdf in batches:
            yield pd.DataFrame({case: pdf[case], "weights": weights(np.array(pdf[features].tolist(), dtype=float), h).tolist()})

    return df.select(case, features).mapInPandas(last, f"{case} {dict(df.dtypes)[case]}, weights array<double>")


def permutation_importance(model, test: DataFrame, array: str, label: str, features: list[int]) -> DataFrame:
    """Loss of accuracy when a feature's values are dealt anew: each row takes the feature of the row after it in hash order."""
    from pyspark.sql import Window

    base = test.select(array, label).withColumn("_h", F.xxhash64(F.col(array)))
    right = lambda df: model.transform(vectors(df, array, label)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    whole = right(base)
    out = []
    for f in features:
        w = Window.partitionBy(F.pmod(F.xxhash64("_h", F.lit(f)), F.lit(64))).orderBy("_h")
        moved = base.withColumn("_v", F.coalesce(F.lead(F.col(array)[f]).over(w), F.col(array)[f]))
        moved = moved.withColumn(array, _replaced(array, f))
        out.append((f, float(whole - right(moved))))
    return test.sparkSession.createDataFrame(out, "feature int, loss double")


def _replaced(array: str, f: int):
    return F.transform(F.col(array), lambda x, i: F.when(i == f, F.col("_v")).otherwise(x))
