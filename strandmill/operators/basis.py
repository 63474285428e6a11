"""Random bases, and least-squares projection on a basis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.quantize import _matrix


def random_basis(dim: int, n: int, seed: int = 0, orthogonal: bool = True) -> np.ndarray:
    """n vectors of `dim` numbers as rows: orthonormal while n <= dim, else (or on demand) of unit length only."""
    x = np.random.default_rng(seed).standard_normal((dim, n))
    if orthogonal and n <= dim:
        q, r = np.linalg.qr(x)
        return (q * np.sign(np.diag(r))).T
    return (x / np.linalg.norm(x, axis=0)).T


def projected(points: DataFrame, basis: np.ndarray, id: str = "id", vector: str = "vec") -> DataFrame:
    """(id, coef, rest): least-squares coefficients of every vector on the basis' rows, and the norm of what they leave.

    The basis is a bounded matrix and sent to the tasks; null vectors are left out.  Nothing is shuffled.
    """
    solve = np.linalg.pinv(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), basis.shape[1])
            c = x @ solve
            rest = np.linalg.norm(x - c @ basis, axis=1)
            ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(c.ravel())), pa.array(rest)], names=["id", "coef", "rest"])

    d = points.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    return d.mapInArrow(run, "id bigint, coef array<double>, rest double")
