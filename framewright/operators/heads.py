"""Inference of frame classifiers with weights that the caller supplies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(x: Column, weights: list[list[float]], bias: list[float], relu: bool = True) -> Column:
    """One frame's logits: W relu(x) + b, as an expression."""
    h = F.transform(x, lambda v: F.greatest(v, F.lit(0.0).cast("float"))) if relu else x
    row = lambda w, b: F.aggregate(F.zip_with(h, F.array(*[F.lit(float(c)) for c in w]), lambda a, c: a.cast("double") * c), F.lit(0.0), lambda s, v: s + v) + b
    return F.array(*[row(w, b) for w, b in zip(weights, bias, strict=True)])


def _matrix(frames: list) -> np.ndarray:
    return np.stack([np.asarray(f, np.float64) for f in frames]) if len(frames) else np.zeros((0, 0))


def two_layer(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(x, 0) @ w1.T + b1, 0) @ w2.T + b2


def cnn(x: np.ndarray, layers: list[tuple], w: np.ndarray, b: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """[convolution over frames with equal padding, batch norm, relu] per layer, then linear. layers: (kernel [out, in, k], bias, mean, var, gamma, beta)."""
    for kernel, bias, mean, var, gamma, beta in layers:
        k = kernel.shape[2]
        padded = np.pad(x, ((k // 2, k - 1 - k // 2), (0, 0)))
        windows = np.stack([padded[i : i + len(x)] for i in range(k)], axis=2)
        y = np.einsum("tik,oik->to", windows, kernel) + bias
        x = np.maximum((y - mean) / np.sqrt(var + eps) * gamma + beta, 0)
    return x @ w.T + b


def predict(frames: Column, head, *weights) -> Column:
    """array<array<float>> of an utterance -> the class of each frame by ``head(matrix, *weights)``."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if f is None else head(_matrix(list(f)), *weights).argmax(1).astype(np.int32) if len(f) else np.zeros(0, np.int32) for f in s], dtype=object)

    return run(frames)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax of the label; null without one."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.when(label.isNotNull(), F.log(total) + top - F.get(logits, label))
