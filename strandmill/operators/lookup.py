"""Lookup of cached structures, checks of their shapes, and dense batches of ragged arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.keys import key, name

#: The atoms of a cached backbone in the order of their slots, and the slots of the wide layout that hold them.
ATOMS = ("n", "ca", "c", "o", "cb")
WIDE = {"n": 0, "ca": 1, "c": 2, "cb": 3, "o": 4}
SLOTS = 37


def lookup(wanted: DataFrame, cache: DataFrame, dataset: str, frames: int, columns: list[str], datasets: tuple[str, ...] | None = None, pid: str = "pid") -> DataFrame:
    """(pid, columns...): for every wanted pid the cached columns of a dataset at so many frames; nulls where there is none.

    With `datasets` an unknown dataset is an error, as in the lookup of backbones; without, it finds nothing,
    as in the lookups of further atoms.  A pid cached several times gives its greatest row by (columns...).
    One shuffle join on the pid; the cache is filtered first.
    """
    if datasets is not None and dataset not in datasets:
        raise ValueError(f"unknown dataset {dataset!r}; known are {', '.join(datasets)}")
    c = cache.where((name("dataset") == dataset) & (F.col("n_frames") == frames)).select(key(pid).alias("pid"), F.struct(*columns).alias("x")).where("pid IS NOT NULL")
    c = c.groupBy("pid").agg(F.max("x").alias("x"))
    return wanted.select(key(pid).alias("pid")).where("pid IS NOT NULL").distinct().join(c, "pid", "left").select("pid", *[F.col(f"x.{v}").alias(v) for v in columns])


def wide_atoms(atoms: dict[str, Column]) -> tuple[Column, Column]:
    """(SLOTS positions, SLOTS flags) of a residue's atoms (null if absent); empty slots are zeros."""
    at = {WIDE[a]: c for a, c in atoms.items()}
    zero = F.array(*[F.lit(0.0)] * 3)
    xyz = F.array(*[F.coalesce(at[i], zero) if i in at else zero for i in range(SLOTS)])
    return xyz, F.array(*[at[i].isNotNull() if i in at else F.lit(False) for i in range(SLOTS)])


def checked(rows: DataFrame, shape: dict[str, int]) -> DataFrame:
    """`rows`, in which every array has its length; the first row that differs ends the query with an error."""
    bad = [(c, n, F.col(c).isNull() | (F.size(c) != n)) for c, n in shape.items()]
    say = F.concat_ws("; ", *[F.when(b, F.concat(F.lit(f"{c} must have {n} elements, not "), F.coalesce(F.size(c).cast("string"), F.lit("null")))) for c, n, b in bad])
    return rows.withColumn("_said", F.when(say != "", F.raise_error(say).cast("string"))).where("_said IS NULL").drop("_said")


def padded(array: Column | str, size: int, pad: float | int = 0) -> tuple[Column, Column]:
    """An array cut or filled up to `size`, and the mask of its own elements."""
    a = F.col(array) if isinstance(array, str) else array
    n = F.least(F.size(a), F.lit(size))
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(pad), size - n)), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < n)


def wild_types(rows: DataFrame, assay: str = "assay", mutant: str = "mutant", sequence: str = "mutated_sequence", order: str = "ord") -> DataFrame:
    """(assay, wt): each assay's sequence with its mutations undone, from its first single mutant, else its first multiple one.

    Rows that do not parse or fit are skipped; an assay with none that does has no row.
    """
    from strandmill.functions.text import reverted

    r = rows.select(F.col(assay).alias("assay"), F.col(mutant).contains(":").alias("several"), F.col(order).alias("o"), reverted(mutant, sequence).alias("wt"))
    return r.where("wt IS NOT NULL").groupBy("assay").agg(F.min(F.struct("several", "o", "wt")).alias("x")).select("assay", "x.wt")


def sliding_dot(rows: DataFrame, group: str, order: str, value: str, weights: list[float], out: str = "conv") -> DataFrame:
    """`rows` with the weighted sum of each row's neighbourhood along its group, zeros beyond the ends.

    The receptive field of one convolution with len(weights) taps (odd); a group is one sequence.
    """
    from pyspark.sql import Window as W

    w, half = W.partitionBy(group).orderBy(order), len(weights) // 2
    terms = [F.lag(value, half - i, 0.0).over(w) * F.lit(k) for i, k in enumerate(weights)]
    return rows.withColumn(out, sum(terms[1:], terms[0]))
