"""Further fit/apply steps: robust scales, symbols, label imputation, projections, covariate components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import nearest, vote
from .order import counted, hazen, running
from .prep import applied


def zero_out(df: DataFrame) -> DataFrame:
    """Features without any finite value become 0 in every row."""
    s = df.groupBy("feat").agg(F.count_if(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).alias("_n"))
    return applied(df, s, ["feat"]).withColumn("value", F.when(F.col("_n") == 0, 0.0).otherwise(F.col("value"))).drop("_n")


def rank_transform(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Test values as their Hazen share among the training values of the feature."""
    from .stats import inverse_percentile

    return inverse_percentile(train.select(*keys, "value"), test, keys, "value").withColumn("value", F.col("percent") / 100).drop("percent")


def inspector(df: DataFrame, part: list[str]) -> DataFrame:
    """Mean, median, variance, interquartile range, share of the most frequent value and of missing ones, in percent."""
    q = hazen(df, part, "value", [25, 50, 75]).select(*part, F.col("p50").alias("median"), (F.col("p75") - F.col("p25")).alias("iqr"))
    c = df.groupBy(*part, "value").agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy(*part).agg((F.max(F.when(F.col("value").isNotNull(), F.col("n"))) * 100 / F.sum("n")).alias("percent_identical"), (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) * 100 / F.sum("n")).alias("percent_missing"))
    m = df.groupBy(*part).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return m.join(q, part).join(s, part)


def first_seen_codes(df: DataFrame, order: str, column: str) -> DataFrame:
    """Each value's number in the order of its first row (a table of one row a value); missing values have none."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    return first.select(column, F.row_number().over(Window.orderBy("_first")).alias("code"))


def padded(array: Column, width: int) -> Column:
    """An array cut or filled with nulls to a width."""
    return F.slice(F.concat(array, F.array_repeat(F.lit(None).cast("double"), width)), 1, width)


def strat_permutation(df: DataFrame, case: str, cls: str, seed: int) -> DataFrame:
    """A shuffle inside each class: each case takes the case that stands, in hash order, where it stands in id order."""
    own = df.select(case, cls).withColumn("one", F.lit(1).cast("long"))
    a = running(own, [cls], case, ["one"]).select(case, cls, F.col("before_one").alias("place"))
    h = own.withColumn("h", F.conv(F.substring(F.md5(F.concat(F.col(case).cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long"))
    b = running(h, [cls], "h", ["one"]).select(F.col(case).alias("taken"), F.col(cls).alias("_c"), F.col("before_one").alias("_p"))
    return a.join(b, (F.col(cls) == F.col("_c")) & (F.col("place") == F.col("_p"))).select(case, cls, "taken")


def label_impute(df: DataFrame, case: str, features: str, label: str, k: int) -> DataFrame:
    """Missing labels become the most frequent label of the k nearest labelled cases."""
    known, gaps = df.filter(F.col(label).isNotNull()), df.filter(F.col(label).isNull())
    return vote(nearest(known, gaps, case, features, k), known, case, label).select(F.col("query").alias(case), F.col("predicted").alias(label))


#: Cases of a window over symbols.
SYMBOL_BLOCK = 4096


def symbol_entropies(df: DataFrame, params: DataFrame, case: str, start: int, stop: int, width: float, word: int) -> DataFrame:
    """For each feature and number of bins: the entropy of words of `word` neighbouring symbols (cases in id order).

    params: centre, sd by feat. Bins cut centre +- width x sd evenly. The smallest number of bins whose
    entropy reaches 99 % of the greatest is the feature's choice.
    """
    own = applied(df, params, ["feat"]).filter("value is not null").withColumn("bins", F.explode(F.sequence(F.lit(start), F.lit(stop))))
    share = (F.col("value") - (F.col("centre") - width * F.col("sd"))) / (2 * width * F.col("sd"))
    own = own.withColumn("symbol", F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor(share * F.col("bins")))).cast("string"))
    placed = running(own.filter(F.col("bins") == start).select("feat", case, F.lit(1).cast("long").alias("_one")), ["feat"], case, ["_one"])
    own = own.join(placed.select(F.col("feat").alias("_f"), F.col(case).alias("_case"), F.col("before__one").alias("_place")), (F.col("feat") == F.col("_f")) & (F.col(case) == F.col("_case")))
    # blocks of places; the first word - 1 cases of a block stand at the end of the one before as well
    at = F.floor(F.col("_place") / SYMBOL_BLOCK)
    also = F.when((F.col("_place") % SYMBOL_BLOCK < word - 1) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    own = own.withColumn("_at", at).withColumn("_block", F.explode(also))
    block = Window.partitionBy("feat", "bins", "_block").orderBy("_place")
    words = own.withColumn("w", F.concat_ws("-", "symbol", *[F.lead("symbol", i).over(block) for i in range(1, word)])).withColumn("last", F.lead("symbol", word - 1).over(block)).filter("last is not null and _block = _at")
    c = words.groupBy("feat", "bins", "w").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return c.groupBy("feat", "bins").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def symbol_bins(entropies: DataFrame) -> DataFrame:
    top = entropies.groupBy("feat").agg(F.max("entropy").alias("_top"))
    return applied(entropies, top, ["feat"]).filter(F.col("entropy") >= 0.99 * F.col("_top")).groupBy("feat").agg(F.min("bins").alias("bins"))


def gram(df: DataFrame, features: str, keys: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count of an array column: d x d sums a partition, added on the driver."""
    d = len(df.select(features).first()[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, ss, n = np.zeros(d), np.zeros((d, d)), 0
        for pdf in batches:
            x = np.array(pdf[features].tolist(), dtype=float).reshape(-1, d)
            s, ss, n = s + x.sum(axis=0), ss + x.T @ x, n + len(x)
        yield pd.DataFrame({"s": [s.tolist()], "ss": [ss.ravel().tolist()], "n": [n]})

    rows = df.select(features).mapInPandas(sums, "s array<double>, ss array<double>, n long").collect()
    n = sum(r["n"] for r in rows)
    mean = sum(np.array(r["s"]) for r in rows) / n
    return mean, sum(np.array(r["ss"]).reshape(d, d) for r in rows) / n - np.outer(mean, mean), n


def projected(df: DataFrame, case: str, features: str, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(case, scores): rows less the mean, on the basis' columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf[features].tolist(), dtype=float).reshape(len(pdf), len(mean))
            yield pd.DataFrame({case: pdf[case], "scores": ((x - mean) @ basis).tolist()})

    return df.select(case, features).mapInPandas(run, f"{case} {dict(df.dtypes)[case]}, scores array<double>")


def signed(basis: np.ndarray) -> np.ndarray:
    """Columns with their largest loading positive."""
    return basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])


def discriminant(df: DataFrame, features: str, cls: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and basis of the supervised projection: between-class over within-class scatter.

    Any number of classes: their sums are added by Spark, and the scatter between them is a sum over classes.
    """
    mean, total, n = gram(df, features)
    d = len(mean)
    kind = dict(df.dtypes)[cls]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, part in pdf.groupby(cls):
                x = np.array(part[features].tolist(), dtype=float)
                yield pd.DataFrame({"c": [c] * d, "i": np.arange(d), "s": x.sum(axis=0), "n": [len(x)] * d})

    parts = df.select(cls, features).mapInPandas(sums, f"c {kind}, i int, s double, n long").groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = parts.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"), F.first("n").alias("n"))  # d numbers a class

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((d, d))
        for pdf in batches:
            for s, m in zip(pdf["s"], pdf["n"], strict=True):
                off = np.asarray(s) / m - mean
                out += m * np.outer(off, off)
        yield pd.DataFrame({"b": [out.ravel().tolist()]})

    between = sum((np.array(r["b"]).reshape(d, d) for r in means.mapInPandas(scatter, "b array<double>").collect()), np.zeros((d, d))) / n
    values, vectors = np.linalg.eig(np.linalg.solve(total - between + 1e-9 * np.eye(d), between))
    order = np.argsort(-values.real)[:k]
    return mean, signed(vectors.real[:, order])


def mahalanobis(df: DataFrame, case: str, features: str) -> DataFrame:
    """Squared distance of each row to the mean under the table's covariance (n - 1)."""
    mean, cov, n = gram(df, features)
    root = np.linalg.cholesky(np.linalg.pinv(cov * n / (n - 1)) + 1e-12 * np.eye(len(mean)))
    s = projected(df, case, features, mean, root)
    return s.select(case, F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x).alias("d2"))


def without_components(df: DataFrame, case: str, features: str, covariate: str, limit: float) -> DataFrame:
    """(case, features): principal components whose |correlation| with the covariate passes the limit are taken out."""
    mean, cov, _ = gram(df, features)
    values, vectors = np.linalg.eigh(cov)
    basis = signed(vectors[:, np.argsort(-values)])
    scores = projected(df, case, features, mean, basis).join(df.select(F.col(case).alias("_c"), F.col(covariate).cast("double").alias("_v")), F.col(case) == F.col("_c"))
    d = len(mean)
    from ..functions.scalar import correlation

    wide = scores.select("_v", *[F.col("scores")[i].alias(f"s{i}") for i in range(d)])
    r = wide.agg(*[correlation(f"s{i}", "_v").alias(f"r{i}") for i in range(d)]).first()
    out = np.array([abs(r[f"r{i}"] or 0) > limit for i in range(d)])
    gone = basis[:, out] @ basis[:, out].T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf[features].tolist(), dtype=float).reshape(len(pdf), d)
            yield pd.DataFrame({case: pdf[case], features: (x - (x - mean) @ gone).tolist()})

    return df.select(case, features).mapInPandas(run, f"{case} {dict(df.dtypes)[case]}, {features} array<double>")


def knee(points: DataFrame, x: str, y: str) -> DataFrame:
    """The split of a curve (a table of few points) whose two straight pieces miss it least."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        miss = lambda u, v: np.abs(v - np.polyval(np.polyfit(u, v, 1), u)).sum()
        cost = [(miss(a[: k + 1], b[: k + 1]) + miss(a[k:], b[k:]), a[k]) for k in range(1, len(a) - 1)]
        return pd.DataFrame({x: [min(cost)[1]]})

    kind = dict(points.dtypes)[x]
    return points.select(x, y).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda p: run(p).astype({x: "float64"}), f"{x} double").select(F.col(x).cast(kind).alias(x))


def label_counts(df: DataFrame, label: str, kind: str) -> DataFrame:
    """Checks a label column (text for classes, numbers for regression) and counts its values."""
    is_text = dict(df.dtypes)[label] == "string"
    if is_text != (kind == "classification"):
        raise ValueError(f"labels of a {kind} must be {'text' if kind == 'classification' else 'numbers'}; {label} is {dict(df.dtypes)[label]}")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def quantile_counts(df: DataFrame, part: list[str]) -> DataFrame:
    return counted(df, part, "value")
