"""Vector quantization against bounded codebooks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import vec

#: A codebook is sent to every task; this bounds its numbers (codes times dimensions).
MAX_NUMBERS = 1 << 24


def codebook_matrix(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, and their vectors; larger codebooks than MAX_NUMBERS are refused."""
    size = codebook.agg(F.coalesce(F.sum(F.size("vec").cast("bigint")), F.lit(0))).first()[0]
    if not size or size > MAX_NUMBERS:
        raise ValueError(f"a codebook has 1 to {MAX_NUMBERS} numbers, this one {size}")
    rows = codebook.select("code", vec.doubles("vec").alias("vec")).orderBy("code").collect()  # its size is checked above
    return np.array([r["code"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of c, the first of equal ones, and the squared distance."""
    best, dist = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, (1 << 22) // max(1, len(c)))
    cc = (c**2).sum(1)
    for i in range(0, len(x), step):
        y = x[i : i + step]
        d = cc[None] - 2 * y @ c.T + (y**2).sum(1)[:, None]
        low = d.min(1)
        close = d <= (low + 1e-9 * (1 + np.abs(low)) + 1e-12 * (y**2).sum(1))[:, None]
        r, k = np.nonzero(close)
        exact = ((y[r] - c[k]) ** 2).sum(1)
        order = np.lexsort((k, exact, r))
        first = np.ones(len(r), bool)
        first[1:] = r[order][1:] != r[order][:-1]
        best[i : i + step], dist[i : i + step] = k[order][first], exact[order][first]
    return best, dist


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.cast(pa.list_(pa.float64()))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != dim * len(column):
        raise ValueError(f"every vector must have the codebook's {dim} dimensions")
    return flat.reshape(len(column), dim)


def residual_tokens(points: DataFrame, codebooks: list[DataFrame], id: str = "id", vector: str = "vec") -> DataFrame:
    """(id, tokens, d2, residual): a code of each level for every point; level l sees what the levels before left.

    tokens holds one code a level, d2 the squared distance at each; ties go to the first code.
    Null vectors are left out.  Codebooks are bounded and sent to the tasks, distances are matrix
    products on Arrow batches: no shuffle, at any number of points.
    """
    books = [codebook_matrix(b) for b in codebooks]
    dim = books[0][1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim).copy()
            tokens, dists = [], []
            for codes, c in books:
                k, d = _nearest(x, c)
                x -= c[k]
                tokens.append(codes[k])
                dists.append(d)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(books))
            wide = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(ends, pa.array(np.stack(tokens, 1).ravel())),
                    pa.ListArray.from_arrays(ends, pa.array(np.stack(dists, 1).ravel())),
                    pa.ListArray.from_arrays(wide, pa.array(x.ravel())),
                ],
                names=["id", "tokens", "d2", "residual"],
            )

    p = points.select(F.col(id).cast("bigint").alias("id"), vec.doubles(vector).alias("v")).where("v IS NOT NULL")
    return p.mapInArrow(run, "id bigint, tokens array<bigint>, d2 array<double>, residual array<double>")


def nearest_code(points: DataFrame, codebook: DataFrame, id: str = "id", vector: str = "vec") -> DataFrame:
    """(id, code, d2): the nearest code by Euclidean distance, the first of equal ones."""
    t = residual_tokens(points, [codebook], id, vector)
    return t.select("id", F.get("tokens", F.lit(0)).alias("code"), F.get("d2", F.lit(0)).alias("d2"))


def decode(tokens: DataFrame, codebooks: list[DataFrame]) -> DataFrame:
    """(id, decoded): the sum of the levels' code vectors; a token that a codebook lacks gives no row."""
    out = tokens.select("id", "tokens")
    for level, book in enumerate(codebooks):
        codebook_matrix(book)  # bounded, so it may be broadcast
        b = book.select(F.col("code").cast("bigint").alias("c"), vec.doubles("vec").alias(f"v{level}"))
        out = out.join(F.broadcast(b), F.get("tokens", F.lit(level)) == F.col("c")).drop("c")
    total = F.col("v0")
    for level in range(1, len(codebooks)):
        total = vec.add(total, f"v{level}")
    return out.select("id", total.alias("decoded"))


def code_sums(points: DataFrame, codebook: DataFrame, id: str = "id", vector: str = "vec") -> DataFrame:
    """(code, n, total): members of every code that has any, and the sum of their vectors.

    Sums are taken in each task first, so the shuffle carries one row a code and task.
    """
    codes, c = codebook_matrix(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(codes), np.int64), np.zeros_like(c)
        for b in batches:
            x = _matrix(b.column(0), c.shape[1])
            k, _ = _nearest(x, c)
            np.add.at(s, k, x)
            n += np.bincount(k, minlength=len(codes))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(codes[some]), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.float64()))], names=["code", "n", "s"])

    p = points.select(vec.doubles(vector).alias("v")).where("v IS NOT NULL").mapInArrow(run, "code bigint, n bigint, s array<double>")
    at = p.select("code", "n", F.posexplode("s").alias("pos", "x")).groupBy("code", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return at.groupBy("code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("total"))


def kmeans_step(points: DataFrame, codebook: DataFrame, id: str = "id", vector: str = "vec") -> DataFrame:
    """(code, n, vec): each code moved to the mean of its members; a code without members keeps its place (n = 0)."""
    sums = code_sums(points, codebook, id, vector)
    moved = codebook.select(F.col("code").cast("bigint").alias("code"), vec.doubles("vec").alias("old")).join(F.broadcast(sums), "code", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return moved.select("code", n.alias("n"), F.when(n > 0, F.transform("total", lambda x: x / n)).otherwise(F.col("old")).alias("vec"))


def kmeans_fit(points: DataFrame, m: int, rounds: int = 20, seed: int = 0, id: str = "id", vector: str = "vec") -> DataFrame:
    """(code, n, vec): a codebook of m codes after `rounds` steps.

    It starts from the m points first in a seeded hash order; a code without members is replaced by the
    next point of that order.  Only the bounded codebook comes to the driver, once a round.
    """
    spark = points.sparkSession
    p = points.select(F.col(id).alias("id"), vec.doubles(vector).alias("vec")).where("vec IS NOT NULL")
    first = [r["vec"] for r in p.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(2 * m).collect()]  # 2 m vectors
    if len(first) < m:
        raise ValueError(f"{m} codes need at least as many points")
    spare = first[m:] or first
    book = [(i, 0, v) for i, v in enumerate(first[:m])]
    schema, used = "code bigint, n bigint, vec array<double>", 0
    for _ in range(rounds):
        got = kmeans_step(p, spark.createDataFrame(book, schema)).orderBy("code").collect()  # m vectors
        book = []
        for r in got:
            if r["n"]:
                book.append((r["code"], r["n"], r["vec"]))
            else:
                book.append((r["code"], 0, spare[used % len(spare)]))
                used += 1
    return spark.createDataFrame(book, schema)


def ema_step(state: DataFrame, points: DataFrame, decay: float = 0.99, seed: int = 0, id: str = "id", vector: str = "vec") -> DataFrame:
    """(code, ema_count, ema_weight, vec): the codebook after one batch of points.

    Counts and sums decay towards the batch's; a code's vector is its weight over its count, smoothed by
    1e-5.  Codes with a count under 1 are dead: they restart, with count 1, from points of the batch in
    a seeded hash order, the dead code of rank r from the r-th.
    """
    book = state.select("code", "vec")
    sums = code_sums(points, book, id, vector)
    m = state.count()
    s = state.select(F.col("code").cast("bigint").alias("code"), F.col("ema_count").alias("c"), vec.doubles("ema_weight").alias("w")).join(F.broadcast(sums), "code", "left")
    n = F.coalesce("n", F.lit(0))
    s = s.withColumn("c", F.col("c") * decay + n * (1 - decay))
    s = s.withColumn("w", F.when(F.col("total").isNull(), vec.scale("w", decay)).otherwise(F.zip_with("w", "total", lambda a, b: a * decay + b * (1 - decay))))
    total = s.agg(F.sum("c").alias("all"))
    s = s.join(F.broadcast(total), how="cross")  # one row
    smooth = (F.col("c") + 1e-5) / (F.col("all") + m * 1e-5) * F.col("all")
    s = s.withColumn("vec", F.transform("w", lambda x: x / smooth))
    dead = [r["code"] for r in s.where("c < 1").select("code").orderBy("code").collect()]  # at most the codebook
    if not dead:
        return s.select("code", F.col("c").alias("ema_count"), F.col("w").alias("ema_weight"), "vec")
    fresh = points.select(F.col(id).alias("id"), vec.doubles(vector).alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(len(dead)).collect()
    new = points.sparkSession.createDataFrame([(c, fresh[i % len(fresh)]["v"]) for i, c in enumerate(dead)], "code bigint, fresh array<double>")
    s = s.join(F.broadcast(new), "code", "left")
    is_new = F.col("fresh").isNotNull()
    return s.select("code", F.when(is_new, 1.0).otherwise(F.col("c")).alias("ema_count"), F.coalesce("fresh", "w").alias("ema_weight"), F.coalesce("fresh", "vec").alias("vec"))


def statistics(points: DataFrame, vector: str = "vec") -> DataFrame:
    """One row (st): an array of struct<pos, mu, sd>, the mean and population std of every dimension; a std under 1e-6 counts as 1."""
    p = points.select(F.posexplode(vec.doubles(vector)).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    return p.agg(F.array_sort(F.collect_list(F.struct("pos", "mu", F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")).alias("sd")))).alias("st"))


def apply_statistics(points: DataFrame, stats: DataFrame, id: str = "id", vector: str = "vec") -> DataFrame:
    """(id, z): (x - mean) / std by dimension, with stored statistics (one row, broadcast)."""
    p = points.select(F.col(id).alias("id"), vec.doubles(vector).alias("v"))
    return p.join(F.broadcast(stats), how="cross").select("id", F.zip_with("v", "st", lambda x, s: (x - s["mu"]) / s["sd"]).alias("z"))


def standardize(points: DataFrame, id: str = "id", vector: str = "vec") -> DataFrame:
    """(id, z): (x - mean) / std by dimension, with the statistics of the points themselves."""
    return apply_statistics(points, statistics(points, vector), id, vector)
