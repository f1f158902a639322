"""Ridge regression by coordinate descent, from sums that tasks add up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSES = 64
PENALTY = 1e-3


def moments(rows: DataFrame, features: list[str], label: str, weight: str) -> tuple[np.ndarray, np.ndarray]:
    """(sum of w x x', sum of w x y) with x_0 = 1: each batch is a product of matrices, each task adds its own up, and as many
    rows as the matrix has cells are shuffled per task. Rows with a null or a number that isn't finite are left out."""
    size = len(features) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            table = table[np.isfinite(table).all(1)]
            x = np.column_stack([np.ones(len(table)), table[:, : size - 1]])
            total += (x * table[:, -1:]).T @ np.column_stack([x, table[:, -2]])
        at = np.arange(size * (size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at // (size + 1), pa.int32()), pa.array(at % (size + 1), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    chosen = rows.select(*[F.col(c).cast("double") for c in (*features, label, weight)])
    out = np.zeros((size, size + 1))
    for r in chosen.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out[:, :-1], out[:, -1]


def descend(gram: np.ndarray, right: np.ndarray, passes: int = PASSES, penalty: float = PENALTY) -> np.ndarray:
    """The intercept and the coefficients after so many passes over all of them, from zero.

    As defined, the intercept enters every prediction once more than its own term: what remains of the labels for a
    coefficient is taken after it twice, and for the intercept after its last value. The intercept has no penalty."""
    c = np.zeros(len(right))
    for _ in range(passes):
        for j in range(len(c)):
            rest = right[j] - gram[j, 0] * c[0] - (gram[j] @ c - gram[j, j] * c[j])
            under = gram[j, j] + (penalty if j else 0.0)
            if not (np.isfinite(under) and under > 0):
                raise ValueError("a feature without any weight")
            c[j] = rest / under
    return c


def fit_ridge(rows: DataFrame, features: list[str], label: str, weight: str) -> dict[str, float]:
    """Coefficient by feature, and the intercept under the empty name."""
    gram, right = moments(rows, features, label, weight)
    return dict(zip(["", *features], descend(gram, right).tolist(), strict=True))
