"""Batch scoring with a user-supplied model.

The model is loaded once per Python worker by ``make_predict_fn`` and fed
Arrow batches of texts (``predict_batch_udf``); the function returns, per
batch, the two class probabilities. Spark only moves the text column and the
probabilities; the scoring itself scales with the number of executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_score(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
                text_col: str = "text", batch_size: int = 64) -> DataFrame:
    """Adds ``p0``, ``p1`` and ``prediction`` (argmax; a tie goes to class 0)."""
    scorer = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                               batch_size=batch_size)
    out = df.withColumn("__probs", scorer(F.col(text_col)))
    return (out.withColumn("p0", F.col("__probs")[0]).withColumn("p1", F.col("__probs")[1])
            .withColumn("prediction", (F.col("p1") > F.col("p0")).cast("int")).drop("__probs"))


def length_logit_model(weight: float = 1.5, bias: float = -11.0):
    """A tiny stand-in model: logistic of ln(text length). ``make_predict_fn`` shape."""
    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            lengths = np.array([len(t) if t is not None else 0 for t in texts], dtype=np.float64)
            z = weight * np.log1p(lengths) + bias
            p1 = 1.0 / (1.0 + np.exp(-z))
            return np.stack([1.0 - p1, p1], axis=1)
        return predict
    return make
