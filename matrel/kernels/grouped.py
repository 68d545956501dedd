"""Dense kernels over many matrices at once: one group a matrix, so the parallelism is the number of matrices; and tall-skinny QR over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.relation import Matrix


def _dense(f: pd.DataFrame, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols))
    np.add.at(out, (f["i"].to_numpy(), f["j"].to_numpy()), f["v"].to_numpy(float))
    return out


def map_matrices(df: DataFrame, rows: int, cols: int, kernel: Callable[[np.ndarray], dict[str, float]], schema: str, key: str = "id") -> DataFrame:
    """``kernel(matrix) -> {column: value}`` for each ``key`` of ``key, i, j, v``. A group is one matrix of the given size: bounded."""

    def run(keys: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: keys[0], **kernel(_dense(f, rows, cols))}])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), "i", "j", F.col("v").cast("double").alias("v")).groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def map_elements(df: DataFrame, rows: int, cols: int, kernel: Callable[[np.ndarray], np.ndarray], key: str = "id", result: str = "double") -> DataFrame:
    """``kernel(matrix) -> matrix`` for each key, as ``key, i, j, v`` with ``v`` of type ``result``."""

    def run(keys: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = np.atleast_2d(kernel(_dense(f, rows, cols)))
        i, j = np.indices(out.shape)
        return pd.DataFrame({key: keys[0], "i": i.reshape(-1), "j": j.reshape(-1), "v": out.reshape(-1)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), "i", "j", F.col("v").cast("double").alias("v")).groupBy(key).applyInPandas(run, f"{key} {kind}, i long, j long, v {result}")


def tall_r(rows: DataFrame, ncols: int) -> np.ndarray:
    """R of a tall, narrow matrix given as ``row array<double>``: each task reduces its rows to one small R, the driver joins these.

    What comes to the driver is ncols**2 numbers a task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, ncols))
        for f in frames:
            if len(f):
                held = np.linalg.qr(np.concatenate([held, np.stack(f["row"].to_numpy())]), mode="r")
        if len(held):
            yield pd.DataFrame({"row": list(held)})

    parts = rows.select("row").mapInPandas(run, "row array<double>").collect()
    if not parts:
        return np.zeros((ncols, ncols))
    r = np.linalg.qr(np.array([p["row"] for p in parts]), mode="r")
    r = np.concatenate([r, np.zeros((ncols - len(r), ncols))]) if len(r) < ncols else r
    return r * np.where(np.diag(r) < 0, -1, 1)[:, None]


def gram(a: Matrix) -> np.ndarray:
    """``A^T A`` of a tall, narrow matrix, summed by Spark; ncols**2 numbers come to the driver."""
    from matrel.operators.products import matmul
    from matrel.operators.views import transposed

    return matmul(transposed(a), a).to_numpy()


def tall_svd(a: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall, narrow matrix from its Gram matrix."""
    w, v = np.linalg.eigh(gram(a).astype(float))
    return np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1]


def least_squares(a: Matrix, b) -> np.ndarray:
    """By normal equations: one pass over the rows, a small solve on the driver."""
    from matrel.operators.products import mult_transposed

    return np.linalg.solve(gram(a).astype(float), mult_transposed(a, b).to_numpy().astype(float))
