"""Distributed gradient steps: partial gradients in tasks, one small sum on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (batch, weights) -> (loss, gradient of the shape of the weights)
Gradient = Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]]


def summed(rows: DataFrame, part: Gradient, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows; every task returns one vector of the model's size."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(weights)
    shape = weights.shape

    def run(batches):
        loss, total = 0.0, np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                a, g = part(batch, shared.value)
                loss += a
                total += g
        yield pa.RecordBatch.from_pydict({"loss": [loss], "gradient": [total.tobytes()]})

    loss, gradient = 0.0, np.zeros(shape)
    for row in rows.mapInArrow(run, "loss double, gradient binary").collect():
        loss += row.loss
        gradient += np.frombuffer(row.gradient).reshape(shape)
    shared.destroy()
    return loss, gradient


def adagrad(rows: DataFrame, part: Gradient, weights: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch AdaGrad: the step of each coordinate shrinks with its own past gradients."""
    seen = np.zeros(weights.shape)
    for _ in range(steps):
        _, gradient = summed(rows, part, weights)
        seen += gradient**2
        weights = weights - rate * gradient / np.sqrt(seen + 1e-12)
    return weights


def sparse(batch: pa.RecordBatch, ids: str = "ids", values: str | None = "counts") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, feature of each entry, value of each entry) of list columns."""
    column = batch.column(batch.schema.get_field_index(ids))
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(batch.num_rows), lengths)
    features = column.flatten().to_numpy(zero_copy_only=False)
    if values is None:
        return rows, features, np.ones(len(features))
    return rows, features, batch.column(batch.schema.get_field_index(values)).flatten().to_numpy(zero_copy_only=False)


def lbfgs(rows: DataFrame, part: Gradient, weights: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-7) -> np.ndarray:
    """Limited-memory BFGS for a smooth loss; every evaluation is one pass over the rows."""
    loss, gradient = summed(rows, part, weights)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < steps and np.abs(gradient).max() > tolerance:
        direction, scales = gradient.copy(), []
        for s, y in reversed(past):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            scales.append(a)
        direction *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(gradient).sum())
        for (s, y), a in zip(past, reversed(scales), strict=True):
            direction += (a - (y @ direction) / (s @ y)) * s
        slope, length = gradient @ direction, 1.0
        while used < steps:
            step = -length * direction
            new_loss, new_gradient = summed(rows, part, weights + step)
            used += 1
            if new_loss <= loss - 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        change = new_gradient - gradient
        if step @ change > 1e-12:
            past = [*past, (step, change)][-memory:]
        weights, loss, gradient = weights + step, new_loss, new_gradient
    return weights
