"""The tables of a data folder in the shapes that the reference queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import vec
from strandmill.functions.keys import key
from strandmill.tables import load

TYPES = ("click", "error", "purchase", "signup", "view")

#: Vectors as points; the first 16 are the codes of level 0, the next 8, halved, those of level 1.
POINTS = """p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
c0 AS (SELECT id AS code, v AS c FROM p WHERE id < 16),
c1 AS (SELECT id - 16 AS code, list_transform(v, lambda x: x * 0.5) AS c FROM p WHERE id >= 16 AND id < 24),
n0 AS (SELECT id, v, label, code, c, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d2, 12), code) AS r FROM (SELECT p.*, c0.*, pow(list_distance(v, c), 2) AS d2 FROM p, c0)) WHERE r = 1),
r0 AS (SELECT id, label, code AS t0, list_transform(list_zip(v, c), lambda x: x[1] - x[2]) AS v FROM n0),
n1 AS (SELECT id, label, t0, v, code AS t1, c, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d2, 12), code) AS r FROM (SELECT r0.*, c1.*, pow(list_distance(v, c), 2) AS d2 FROM r0, c1)) WHERE r = 1)"""
FRAMES = "f AS (SELECT user_id AS key, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS token, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_id, ts FROM events)"
RECORDS = "t AS (SELECT tag, level, nullif(upper(trim(pid, ' ' || chr(9))), '') AS pid, max(tokens) AS tokens FROM tokens WHERE tokens IS NOT NULL GROUP BY ALL)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles("embedding").alias("vec"), "label")


def books(spark: SparkSession, d: str) -> list[DataFrame]:
    p = points(spark, d)
    first = p.where("id < 16").select(F.col("id").alias("code"), "vec")
    return [first, p.where("id >= 16 AND id < 24").select((F.col("id") - 16).alias("code"), vec.scale("vec", 0.5).alias("vec"))]


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Users as residues, their events in order as frames, the type as token."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    token = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int") - 1
    return load(spark, d, "events").select(F.col("user_id").alias("key"), token.alias("token"), (F.row_number().over(w) - 1).alias("frame"), "value", "event_id", "ts")


def records(spark: SparkSession, d: str) -> DataFrame:
    """One token array for each (tag, level, pid)."""
    t = load(spark, d, "tokens").where("tokens IS NOT NULL")
    return t.groupBy("tag", "level", key("pid").alias("pid")).agg(F.max("tokens").alias("tokens"))


def coords(spark: SparkSession, d: str) -> DataFrame:
    """(pid, frame, res, xyz): the vectors of a label as frames of 21 residues."""
    p = points(spark, d)
    w = W.partitionBy("label").orderBy("id")
    p = p.select(F.concat(F.lit("L"), "label").alias("pid"), (F.row_number().over(w) - 1).cast("int").alias("frame"), "vec")
    cut = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice("vec", i * 3 + 1, 3))
    return p.select("pid", "frame", F.posexplode(cut).alias("res", "xyz"))
