"""Random Fourier features: a linear model over them is one with a Gaussian kernel, trained in time linear in the rows."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def directions(width: int, features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions (features x width) of the kernel exp(-gamma |a - b|^2), and phases."""
    dice = np.random.default_rng(seed)
    return dice.normal(0, np.sqrt(2 * gamma), (features, width)), dice.uniform(0, 2 * np.pi, features)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """sqrt(2 / features) * cos(Wz + b) of a vector of ``width`` numbers; products of two rows' features are near the kernel."""

    width = Param(Params._dummy(), "width", "length of the input vectors", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "how many", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "of the kernel", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the directions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "z", outputCol: str = "r", width: int = 1, features: int = 256, gamma: float = 1.0, seed: int = 7):  # noqa: N803
        super().__init__()
        self._setDefault(inputCol="z", outputCol="r", width=1, features=256, gamma=1.0, seed=7)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        get = self.getOrDefault
        w, b = directions(get(self.width), get(self.features), get(self.gamma), get(self.seed))
        rows = "array(" + ", ".join(f"struct(array({', '.join(f'{v!r}D' for v in map(float, r))}) AS w, {float(p)!r}D AS b)" for r, p in zip(w, b, strict=True)) + ")"
        put = F.expr(f"transform({rows}, f -> {float(np.sqrt(2 / len(b)))!r}D * cos(f.b + aggregate(zip_with(f.w, _fourier, (a, c) -> a * c), 0D, (s, v) -> s + v)))")
        return df.withColumn("_fourier", vector_to_array(self.getInputCol())).withColumn(self.getOutputCol(), array_to_vector(put)).drop("_fourier")
