"""Spark-native ensemble tokenization and token analytics.

Every operator is a function from DataFrames to DataFrames.  Functions that run in Python workers are shipped by
value, so executors do not need this package, but PySpark, numpy, pandas and pyarrow; the operators for
training data also need regex, xxhash and tiktoken there.
"""

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Public names and the modules that define them; each is imported when it is first used.
_EXPORTS = {
    "get_spark": "session", "Scratch": "session", "load": "tables",
    "nearest_code": "operators.quantize", "residual_tokens": "operators.quantize", "decode": "operators.quantize", "kmeans_fit": "operators.quantize", "standardize": "operators.quantize",
    "codebook_use": "operators.tokenstats", "plurality_vote": "operators.tokenstats", "masked_pool": "operators.tokenstats",
    "eta_squared": "operators.stats", "seed_cells": "operators.stats", "spearman": "operators.ranks", "auroc": "operators.ranks", "average_precision": "operators.ranks",
    "descriptors": "operators.geometry", "rmsf": "operators.geometry", "selected_frames": "operators.geometry", "residues": "operators.segment",
    "descriptor": "operators.registry", "tokenize": "operators.registry", "tokenizer": "operators.registry",
    "lookup": "operators.lookup", "projected": "operators.basis", "dangling": "operators.orphans", "audit": "operators.report", "random_tokens": "functions.randoms",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
