"""Models: boosted trees with calibration, an isolation forest, a combined score, contributions, pinned artifacts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.lineage import cut


def temporal_split(df: DataFrame, at: str, cut) -> tuple[DataFrame, DataFrame]:
    """(before the cut, from the cut on); never a random split, which would leak the future."""
    return df.filter(F.col(at) < F.lit(cut)), df.filter(F.col(at) >= F.lit(cut))


def balanced(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights under which both classes count the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    return df.join(F.broadcast(counts), label).withColumn(name, total / (2.0 * F.col("__n"))).drop("__n")  # one row per class


class Calibrated:
    """Boosted trees whose probability is calibrated on rows that did not train them."""

    def __init__(self, features: list[str], label: str, seed: int = 42, rounds: int = 20, depth: int = 4):
        self.features, self.label, self.seed = features, label, seed
        self.trees = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
        self.assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")

    def fit(self, train: DataFrame, validation: DataFrame) -> Calibrated:
        self.model = self.trees.fit(self.assembler.transform(balanced(train, self.label)))
        self.isotonic = IsotonicRegression(featuresCol="raw", labelCol=self.label).fit(self._raw(validation))
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.assembler.transform(df))
        return out.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, df: DataFrame) -> DataFrame:
        return self.isotonic.transform(self._raw(df)).withColumnRenamed("prediction", "score").drop("raw")


def isolation_forest(df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """``df`` with ``anomaly`` between 0 and 1. Trees are grown on the driver from at most ``trees * sample`` rows, the
    first by a hash of their values; all rows are scored, in Arrow batches."""
    some = df.select(*[F.col(f).cast("double") for f in features]).na.fill(0.0).orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(trees * sample)
    x = some.toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(2, min(sample, len(x)))))

    def grow(rows, depth):
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            return len(rows)
        f = int(rng.choice(spread))
        at = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] < at
        return f, at, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    forest = [grow(x[rng.choice(len(x), min(sample, len(x)), replace=False)], 0) for _ in range(trees)] if len(x) else []
    usual = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def depths(tree, rows, at, depth, out):
        if not isinstance(tree, tuple):
            out[at] += depth + usual(tree)
            return
        f, cut, left, right = tree
        go = rows[at, f] < cut
        depths(left, rows, at[go], depth + 1, out)
        depths(right, rows, at[~go], depth + 1, out)

    def run(batches):
        for pdf in batches:
            rows = pdf[features].astype(float).fillna(0.0).to_numpy()
            total = np.zeros(len(rows))
            for tree in forest:
                depths(tree, rows, np.arange(len(rows)), 0, total)
            pdf["anomaly"] = 2 ** (-total / max(1, len(forest)) / max(1e-9, usual(min(sample, len(x)))))
            yield pdf

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("anomaly", T.DoubleType())]))


def percentile_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """``df`` with the share of rows whose score is lower, ties sharing theirs; from one row per distinct score."""
    steps = df.groupBy(score).agg(F.count(F.lit(1)).alias("__n"))
    dealt = cut(steps.repartitionByRange(64, score).withColumn("__p", F.spark_partition_id()))
    totals = dealt.groupBy("__p").agg(F.sum("__n").alias("__t"))
    carried = totals.select("__p", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"), F.sum("__t").over(Window.partitionBy()).alias("__all"))
    inside = Window.partitionBy("__p").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("__b", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(carried, "__p")
    ranked = ranked.select(F.col(score).alias("__s"), F.coalesce(F.try_divide(F.col("__b") + F.col("__c"), F.col("__all") - 1), F.lit(0.0)).alias(name))
    return df.join(ranked, F.col(score).eqNullSafe(F.col("__s"))).drop("__s")


def ensemble(df: DataFrame, parts: dict[str, float]) -> Column:
    """Weighted mean of the parts that are there; null if none is."""
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return F.try_divide(value, weight)


def top_contributions(weights: dict[str, float], k: int) -> Column:
    """The ``k`` features that move a linear score most, as (size, feature, contribution)."""
    parts = F.array(*[F.struct((-F.abs(F.col(f) * w)).alias("order"), F.lit(f).alias("feature"), (F.col(f) * w).alias("contribution")) for f, w in weights.items()])
    return F.transform(F.slice(F.array_sort(F.filter(parts, lambda p: p["contribution"].isNotNull())), 1, k), lambda p: F.struct(p["feature"], p["contribution"]))


def artifact_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def load_pinned(path: str, digest: str) -> bytes:
    """A model file, refused unless it is the one that was pinned."""
    with open(path, "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"{path} is not the artifact that was pinned")
    return data


def shuffled_labels(df: DataFrame, label: str, seed: int = 7) -> DataFrame:
    """``df`` with labels drawn by hash at the same rate: a model trained on it must do no better than the base rate."""
    rate = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *df.columns), 11) / float(1 << 53)
    return df.withColumn(label, (unit < rate).cast("int"))
