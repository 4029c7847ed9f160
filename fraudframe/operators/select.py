"""Feature selectors (survey 2.G) on an assembled ``features`` vector.

pca_95          centre, fit PCA, keep the fewest components explaining at
                least 95 % of the variance
truncated_svd_2 project on the first two right singular vectors (no centring)
rfecv           recursive elimination with a random forest: at each size,
                score by cross-validated accuracy, drop the least important
                feature; keep the best size (all folds in the same jobs,
                ``operators/forests.py``)
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudframe.operators.forests import blocks_of, eliminate

VARIANCE_KEPT = 0.95
SVD_COMPONENTS = 2


@dataclass
class SelectorModel:
    kind: str
    stages: list = field(default_factory=list)
    matrix: np.ndarray | None = None
    indices: list[int] | None = None
    n_out: int = 0

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        if self.kind == "pca_95":
            centre, pca, slicer = self.stages
            out = centre.transform(df.withColumnRenamed(features, "__raw"))
            out = pca.transform(out).drop("__raw", "__centred")
            return slicer.transform(out).drop("__pca")
        if self.kind == "truncated_svd_2":
            x = vector_to_array(F.col(features))
            comps = [sum((x[i] * F.lit(float(v)) for i, v in enumerate(self.matrix[:, j])), F.lit(0.0))
                     for j in range(self.matrix.shape[1])]
            return df.withColumn(features, array_to_vector(F.array(*comps)))
        if self.kind == "rfecv_random_forest":
            return self.stages[0].transform(df.withColumnRenamed(features, "__raw")).drop("__raw")
        raise ValueError(self.kind)


def fit_pca95(df: DataFrame, features: str = "features") -> SelectorModel:
    d = len(df.select(features).first()[0])
    centre = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__centred").fit(
        df.select(F.col(features).alias("__raw")))
    centred = centre.transform(df.select(F.col(features).alias("__raw")))
    pca = PCA(k=d, inputCol="__centred", outputCol="__pca").fit(centred)
    cum = np.cumsum(pca.explainedVariance.toArray())
    k = int(np.searchsorted(cum, VARIANCE_KEPT - 1e-12) + 1)
    slicer = VectorSlicer(inputCol="__pca", outputCol=features, indices=list(range(min(k, d))))
    return SelectorModel("pca_95", [centre, pca, slicer], n_out=min(k, d))


def fit_svd2(df: DataFrame, features: str = "features") -> SelectorModel:
    from pyspark.mllib.util import MLUtils
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(features), features)).computeSVD(SVD_COMPONENTS, computeU=False)
    v = svd.V.toArray()
    return SelectorModel("truncated_svd_2", matrix=v, n_out=v.shape[1])


def fit_rfecv(df: DataFrame, key: str, label: str = "label", features: str = "features", folds: int = 5,
              step: int = 1, num_trees: int = 100, seed: int = 0, min_features: int = 1,
              max_depth: int = 5) -> SelectorModel:
    """Recursive feature elimination with cross-validated accuracy.  The rows are binned and stored
    once; at each size the forests of all folds and of the whole table grow in the same jobs.
    ``max_depth`` bounds the trees of these rankings, not of any model."""
    blocks, d = blocks_of(df, key, label, features, folds, seed)
    try:
        kept, _ = eliminate(blocks, d, folds, step, num_trees, max_depth, seed, min_features)
    finally:
        blocks.unpersist()
    slicer = VectorSlicer(inputCol="__raw", outputCol=features, indices=kept)
    return SelectorModel("rfecv_random_forest", [slicer], indices=kept, n_out=len(kept))


def fit_selector(kind: str, df: DataFrame, key: str, label: str = "label", features: str = "features",
                 **rfecv_args) -> SelectorModel:
    if kind == "pca_95":
        return fit_pca95(df, features)
    if kind == "truncated_svd_2":
        return fit_svd2(df, features)
    if kind == "rfecv_random_forest":
        return fit_rfecv(df, key, label, features, **rfecv_args)
    raise ValueError(f"unknown selector {kind!r}")
