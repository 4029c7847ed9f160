"""Classifiers (survey 2.H) on an assembled ``features`` vector column.

Most are ``pyspark.ml`` estimators configured like the original catalog:

1 logistic regression  L2, C = 1 (regParam = 1/n), 100 iterations
2 linear discriminant  pooled within-class covariance from ONE aggregate
                       pass, solved on the driver (d x d), scored as a
                       column expression
3 k nearest neighbours exact, see ``operators.knn``
4 decision tree        depth 30, Spark's rules (``operators.deep_trees``)
5 gaussian naive Bayes
6 random forest        100 trees of depth 30 (``operators.deep_trees``)
7 gradient boosting    100 trees of 31 leaves, the best leaf split next, step 0.1
                       (``operators.boost.LEAF_WISE``)
8 gradient boosting    100 trees of depth 6, weight penalty 1, step 0.3, a learnt
                       side for missing values (``operators.boost.REGULARISED``)

Every fitted model exposes ``transform(df)`` adding ``prediction`` and
``probability``; ``with_probabilities`` adds the two probability columns
of the score table.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudframe.operators.boost import LEAF_WISE, REGULARISED, BoostedTrees
from fraudframe.operators.deep_trees import DeepTrees

#: Depth of the single tree and of the forest's trees, the most that Spark's own trees have.
TREE_DEPTH = FOREST_DEPTH = 30


def make_classifier(code: int, n_rows: int, seed: int = 0, label: str = "label", features: str = "features",
                    key: str | None = None):
    common = dict(labelCol=label, featuresCol=features)
    if code == 1:
        return LogisticRegression(regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False,
                                  maxIter=100, **common)
    if code == 2:
        return LinearDiscriminant(label, features)
    if code == 3:
        from fraudframe.operators.knn import KNNClassifier
        return KNNClassifier(k=5, label=label, features=features, key=key)
    if code == 4:
        return DeepTrees(1, TREE_DEPTH, seed, label, features)
    if code == 5:
        return NaiveBayes(modelType="gaussian", **common)
    if code == 6:
        return DeepTrees(100, FOREST_DEPTH, seed, label, features, key)
    if code in (7, 8):
        return BoostedTrees(LEAF_WISE if code == 7 else REGULARISED, label, features)
    raise ValueError(f"unknown model code {code}")


def with_probabilities(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """prediction INT, positive_probability, negative_probability."""
    p = vector_to_array(F.col(probability))
    return (scored.withColumn("prediction", F.col("prediction").cast("int"))
            .withColumn("positive_probability", p[1]).withColumn("negative_probability", p[0]))


# ---------------------------------------------------------------------------
# linear discriminant analysis
# ---------------------------------------------------------------------------

@dataclass
class LinearDiscriminantModel:
    weights: np.ndarray
    bias: float
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.features))
        score = sum((x[i] * F.lit(float(w)) for i, w in enumerate(self.weights)), F.lit(float(self.bias)))
        p1 = 1.0 / (1.0 + F.exp(-score))
        return (df.withColumn("prediction", (score > 0).cast("double"))
                .withColumn("probability", array_to_vector(F.array(1.0 - p1, p1))))


class LinearDiscriminant:
    """Two-class LDA: class means from one vector summary, then the pooled
    covariance of the vectors less their class's mean (so large offsets don't
    cancel), both computed by Spark; the d x d solve runs on the driver."""

    def __init__(self, label: str = "label", features: str = "features"):
        self.label, self.features = label, features

    def fit(self, df: DataFrame) -> LinearDiscriminantModel:
        rows = df.select(F.col(self.label).cast("int").alias("y"), F.col(self.features).alias("x"))
        found = rows.groupBy("y").agg(Summarizer.mean(F.col("x")).alias("mean"), F.count(F.lit(1)).alias("n")).limit(3).collect()
        n = {r["y"]: r["n"] for r in found}
        if set(n) != {0, 1}:
            raise ValueError(f"classes 0 and 1 expected, got {sorted(map(str, n))}")
        m0, m1 = (next(r["mean"].toArray() for r in found if r["y"] == c) for c in (0, 1))
        mean = F.when(F.col("y") == 1, F.array(*[F.lit(float(v)) for v in m1])).otherwise(
            F.array(*[F.lit(float(v)) for v in m0]))
        centred = rows.select(array_to_vector(F.zip_with(vector_to_array("x"), mean, lambda v, m: v - m)).alias("c"))
        total = n[0] + n[1]
        # the centred columns have mean 0: correlation and variance give the scatter
        spread = np.sqrt(centred.agg(Summarizer.variance(F.col("c")).alias("v")).first()["v"].toArray() * (total - 1))
        corr = np.nan_to_num(Correlation.corr(centred, "c").first()[0].toArray())  # a constant column has none
        cov = corr * np.outer(spread, spread) / max(total - 2, 1)
        inv = np.linalg.pinv(cov)
        w = inv @ (m1 - m0)
        b = -0.5 * (m1 @ inv @ m1 - m0 @ inv @ m0) + np.log(n[1] / n[0])
        return LinearDiscriminantModel(w, float(b), self.features)
