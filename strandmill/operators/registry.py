"""Registries of descriptors and tokenizers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import text, vec

#: name: a column of the descriptor, from the column of a vector.
DESCRIPTORS: dict[str, Callable[[Column], Column]] = {
    "raw": lambda v: v,
    "unit": lambda v: vec.scale(v, 1 / F.greatest(vec.norm(v), F.lit(1e-12))),
    "steps": lambda v: F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: a - b),
    "norm": lambda v: F.array(vec.norm(v)),
}

Tokenizer = Callable[..., DataFrame]
TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Callable[[Tokenizer], Tokenizer]:
    """Registers a function of rows (and parameters) that returns (pid, residue, token)."""

    def add(f: Tokenizer) -> Tokenizer:
        TOKENIZERS[name] = f
        return f

    return add


def descriptor(mode: str, column: Column | str) -> Column:
    if mode not in DESCRIPTORS:
        raise ValueError(f"unknown descriptor {mode!r}; known are {', '.join(DESCRIPTORS)}")
    return DESCRIPTORS[mode](F.col(column) if isinstance(column, str) else column)


def tokenize(name: str, rows: DataFrame, **parameters) -> DataFrame:
    """(tag, pid, residue, token) by the tokenizer of that name; an unknown name is an error."""
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; known are {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name](rows, **parameters).select(F.lit(name).alias("tag"), "pid", "residue", "token")


@tokenizer("residue")
def residue_tokens(rows: DataFrame) -> DataFrame:
    """The residue's place in the alphabet, of (pid, seq)."""
    letter = F.regexp_extract_all("seq", F.lit("(?s)(.)"), F.lit(1))
    return rows.select("pid", F.posexplode(letter).alias("residue", "aa")).select("pid", "residue", text.residue_index("aa").cast("bigint").alias("token"))


@tokenizer("random")
def random_residue_tokens(rows: DataFrame, size: int = 64, seed: int = 0) -> DataFrame:
    """Uniform tokens seeded by the pid, of (pid, seq)."""
    from strandmill.functions.randoms import random_tokens

    t = random_tokens(rows.select("pid", F.length("seq").alias("n_res")), size, seed)
    return t.select("pid", F.posexplode("tokens").alias("residue", "token"))


@tokenizer("nearest")
def nearest_tokens(rows: DataFrame, codebook: DataFrame | None = None) -> DataFrame:
    """The nearest code of a codebook (code, vec), of (pid, residue, vec)."""
    from strandmill.operators.quantize import nearest_code

    if codebook is None:
        raise ValueError("the nearest code needs a codebook")
    id_ = F.struct("pid", "residue")
    numbered = rows.withColumn("_id", F.xxhash64(id_))
    t = nearest_code(numbered.select(F.col("_id").alias("id"), "vec"), codebook).distinct()
    return numbered.join(t, numbered["_id"] == t["id"]).select("pid", "residue", F.col("code").alias("token"))
