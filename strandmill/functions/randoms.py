"""Reproducible random tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.text import fnv1a


def random_tokens(lengths: DataFrame, size: int, seed: int = 0, id: str = "pid", length: str = "n_res") -> DataFrame:
    """(pid, tokens): uniform tokens below `size` from numpy's default generator, seeded by the FNV-1a hash of the pid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pid": b["pid"], "tokens": [np.random.default_rng(h).integers(0, size, n) for h, n in zip(b["h"], b["n"])]})

    rows = lengths.select(F.col(id).alias("pid"), fnv1a(id, seed).alias("h"), F.col(length).alias("n")).where("n IS NOT NULL AND pid IS NOT NULL")
    return rows.mapInPandas(run, "pid string, tokens array<bigint>")


def random_codebook(spark, size: int, dim: int, seed: int = 0) -> DataFrame:
    """(code, vec): standard normal vectors in single precision."""
    book = np.random.default_rng(seed).standard_normal((size, dim)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "code bigint, vec array<float>")
