"""A radial-kernel machine: random Fourier features before the linear one.

For w from a normal distribution of variance 2 gamma and b uniform over a turn,
sqrt(2 / D) cos(w x + b) has inner products that tend to exp(-gamma |x - y|^2) as
the number D of features grows (Rahimi and Recht 2007), so a linear machine over
them approximates the kernel's, and trains as the linear one does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fourier_features(vector: Column, weights: np.ndarray, shift: np.ndarray) -> Column:
    """array<double> of D features of an array<double>."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(weights)))
        return pd.Series(list(np.sqrt(2 / len(shift)) * np.cos(rows @ weights + shift)))

    return run(vector)


class RadialMachine(Estimator, HasFeaturesCol, HasLabelCol):
    """One machine a class over random Fourier features; gamma is 1 / (columns x variance of all entries) unless given."""

    def __init__(self, size: int = 256, gamma: float | None = None, seed: int = 42, rounds: int = 100):
        super().__init__()
        self.size, self.gamma, self.seed, self.rounds = size, gamma, seed, rounds

    def setFeaturesCol(self, name: str) -> "RadialMachine":  # noqa: N802
        return self._set(featuresCol=name)

    def setLabelCol(self, name: str) -> "RadialMachine":  # noqa: N802
        return self._set(labelCol=name)

    def _fit(self, df: DataFrame) -> "RadialModel":
        col = self.getFeaturesCol()
        s = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("s")).select("s.*").first()
        means, n = s["mean"].toArray(), s["count"]
        spread = float((s["variance"].toArray() * (n - 1) / n).mean() + means.var())
        gamma = self.gamma or 1 / (len(means) * (spread or 1.0))
        rng = np.random.default_rng(self.seed)
        weights, shift = rng.normal(0, np.sqrt(2 * gamma), (len(means), self.size)), rng.uniform(0, 2 * np.pi, self.size)
        held = RadialModel(weights, shift, col, None)
        machine = OneVsRest(classifier=LinearSVC(maxIter=self.rounds), featuresCol=held.column, labelCol=self.getLabelCol())
        return RadialModel(weights, shift, col, machine.fit(held.lifted(df)))


class RadialModel(Model):
    column = "__fourier"

    def __init__(self, weights: np.ndarray, shift: np.ndarray, features: str, machine):
        super().__init__()
        self.weights, self.shift, self.features, self.machine = weights, shift, features, machine

    def lifted(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, array_to_vector(fourier_features(vector_to_array(self.features), self.weights, self.shift)))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.machine.transform(self.lifted(df)).drop(self.column)
