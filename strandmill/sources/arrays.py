"""Keyed array files (.npz, .npy) as tables, and back."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, key string, ord int, dtype string, shape array<int>, data array<double>"


def _unpacked(path: str, content: bytes) -> list[tuple]:
    at = io.BytesIO(content)
    if path.endswith(".npy"):
        named = [(path.rsplit("/", 1)[-1][:-4], np.load(at, allow_pickle=False))]
    elif path.endswith(".npz"):
        with np.load(at, allow_pickle=False) as z:
            named = [(k, z[k]) for k in z.files]
    else:
        raise ValueError(f"{path}: keyed arrays are .npz or .npy; pickles are never loaded")
    return [(path, k, i, str(a.dtype), list(a.shape), a.astype(np.float64).ravel() if a.dtype.kind in "biuf" else None) for i, (k, a) in enumerate(named)]


def arrays_of(files: DataFrame) -> DataFrame:
    """One row for each array of (path, content) files, in the files' key order; numbers as doubles, other types null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield pd.DataFrame(_unpacked(p, c), columns=["path", "key", "ord", "dtype", "shape", "data"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    """The arrays of all files below a path, each file read whole by one task."""
    return arrays_of(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def kinds(arrays: DataFrame) -> DataFrame:
    """(path, kind): tokens (one dimension) or continuous (two), by the file's first array."""
    first = arrays.groupBy("path").agg(F.min(F.struct("ord", F.size("shape").alias("dims"))).alias("f"))
    return first.select("path", F.when(F.col("f.dims") == 1, "tokens").when(F.col("f.dims") == 2, "continuous").otherwise("other").alias("kind"))


def archives(arrays: DataFrame, group: str, compressed: bool = False, dtype: str = "int64") -> DataFrame:
    """(group, content): an .npz for each group of (group, key, ord, data); a group is one bounded archive."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, out = pdf.sort_values("ord"), io.BytesIO()
        (np.savez_compressed if compressed else np.savez)(out, **{k: np.asarray(v).astype(dtype) for k, v in zip(p["key"], p["data"])})
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "content": [out.getvalue()]})

    return arrays.select(F.col(group).cast("string").alias("grp"), "key", "ord", "data").groupBy("grp").applyInPandas(run, "grp string, content binary")


def matrices(rows: DataFrame, group: str, order: str, column: str, dtype: str = "float32") -> DataFrame:
    """(group, content): a .npy matrix for each group, one row for each array in the given order; a group is one bounded file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.stack([np.asarray(v, dtype) for v in pdf.sort_values("o")["v"]]), allow_pickle=False)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "content": [out.getvalue()]})

    return rows.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("o"), F.col(column).alias("v")).groupBy("grp").applyInPandas(run, "grp string, content binary")


def labels_of(arrays: DataFrame) -> DataFrame:
    """(path, key, pos, label): the labels of flat (.npy) and keyed (.npz) files, in single precision; the key of a flat file is null."""
    flat = F.when(~F.col("path").endswith(".npy"), F.col("key"))
    return arrays.where("data IS NOT NULL").select("path", flat.alias("key"), F.posexplode("data").alias("pos", "label")).withColumn("label", F.col("label").cast("float"))
