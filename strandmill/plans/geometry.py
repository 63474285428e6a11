"""Queries of structures, which SQL cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from strandmill.operators import geometry, segment
from strandmill.plans.registry import query
from strandmill.plans.shared import coords, points
from strandmill.sources import files


@query()
def a23_rmsf(spark: SparkSession, d: str) -> DataFrame:
    return geometry.rmsf(coords(spark, d)).withColumn("rmsf", F.round("rmsf", 6))


@query()
def f10_kabsch(spark: SparkSession, d: str) -> DataFrame:
    """Fluctuation after superposing every frame on the first one."""
    return geometry.rmsf(coords(spark, d), rounds=0).withColumn("rmsf", F.round("rmsf", 6))


@query()
def f11_local_pca(spark: SparkSession, d: str) -> DataFrame:
    return geometry.local_motion(coords(spark, d), radius=0.4)


@query()
def t5_fps(spark: SparkSession, d: str) -> DataFrame:
    return geometry.selected_frames(coords(spark, d), 8)


def backbone(spark: SparkSession, d: str) -> DataFrame:
    """(pid, frame, res, n, ca, c, o): a backbone rebuilt on the first 21 x 3 numbers of every vector."""
    xyz = coords(spark, d).select("pid", "frame", "res", *[(F.get("xyz", F.lit(i)) * 10).alias(a) for i, a in enumerate("xyz")])
    b = segment.ideal_backbone(xyz, ["pid", "frame"], "res")
    return b.select("pid", "frame", "res", "n", F.array("x", "y", "z").alias("ca"), "c", "o")


@query()
def f13_ideal_backbone(spark: SparkSession, d: str) -> DataFrame:
    return backbone(spark, d)


@query()
def f12_frame_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return geometry.descriptors(backbone(spark, d))


@query()
def f14_virtual_cb(spark: SparkSession, d: str) -> DataFrame:
    b = backbone(spark, d)
    cb = F.when(F.col("res") % 2 == 0, F.lit(None).cast("array<double>")).otherwise(F.col("ca"))
    return b.select("pid", "frame", "res", segment.cb_or_virtual(cb, F.col("n"), F.col("ca"), F.col("c")).alias("cb"))


@query()
def s14_structure_text(spark: SparkSession, d: str) -> DataFrame:
    b = backbone(spark, d).where("frame = 0").withColumn("aa", F.lit("A")).withColumn("cb", F.lit(None).cast("array<double>"))
    return files.structures(b, "pid")


@query("""WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    q AS (SELECT id, list_transform(range(4), lambda i: v[i * 8 + 1 : i * 8 + 8]) AS a, list_transform(range(4), lambda i: v[i * 8 + 33 : i * 8 + 40]) AS b FROM p),
    e AS (SELECT id, i, j, pow(list_distance(a[i], b[j]), 2) / 8 AS c FROM q, range(1, 5) AS r(i), range(1, 5) AS s(j))
    SELECT w.id AS key, round(min(w.c + x.c + y.c + z.c) / 4, 6) AS loss FROM e w JOIN e x ON w.id = x.id AND w.i = 1 AND x.i = 2 JOIN e y ON x.id = y.id AND y.i = 3 JOIN e z ON y.id = z.id AND z.i = 4
    WHERE w.j <> x.j AND w.j <> y.j AND w.j <> z.j AND x.j <> y.j AND x.j <> z.j AND y.j <> z.j GROUP BY w.id""")
def j17_assignment(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vec", i * 8 + a, 8))
    p = points(spark, d).select(F.col("id").alias("key"), cut(1).alias("pred"), cut(33).alias("target"))
    return geometry.matched_loss(p).withColumn("loss", F.round("loss", 6))


