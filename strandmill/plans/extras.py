"""Queries of lookups, registries, bases, probes, result files and arguments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import args, vec
from strandmill.functions.keys import key
from strandmill.operators import basis, lookup, probes, ranks, registry
from strandmill.plans.registry import query
from strandmill.plans.shared import FRAMES, POINTS, RECORDS, books, frames, points, records
from strandmill.sources import arrays, files
from strandmill.tables import load

_PID = "nullif(upper(trim(pid, ' ' || chr(9))), '')"
_WANTED = f"w AS (SELECT DISTINCT {_PID} AS pid FROM splits WHERE {_PID} IS NOT NULL)"


@query(f"""WITH {_WANTED}, c AS (SELECT {_PID} AS pid, max({{'n_res': n_res, 'chosen_indices': chosen_indices}}) AS x FROM real_bb WHERE lower(trim(dataset, ' ' || chr(9))) = 'misato' AND n_frames = 8 GROUP BY 1)
    SELECT w.pid, x.n_res AS n_res, x.chosen_indices AS chosen_indices FROM w LEFT JOIN c USING (pid)""")
def s4_backbone_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup(load(spark, d, "splits"), load(spark, d, "real_bb"), "misato", 8, ["n_res", "chosen_indices"], ("misato", "mdcath"))


@query(f"""WITH {_WANTED}, c AS (SELECT {_PID} AS pid, max(n_res) AS n_res FROM real_bb WHERE lower(trim(dataset, ' ' || chr(9))) = 'mdcath' AND n_frames = 10 GROUP BY 1) SELECT w.pid, n_res FROM w LEFT JOIN c USING (pid)""")
def s5_atom_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup(load(spark, d, "splits"), load(spark, d, "real_bb"), "mdcath", 10, ["n_res"])


@query("SELECT tag, unnest(range(m))::BIGINT AS code FROM codebook_sizes WHERE level = 0")
def s13_level0_codes(spark: SparkSession, d: str) -> DataFrame:
    """The codes of the first level of every codebook."""
    c = load(spark, d, "codebook_sizes").where("level = 0")
    return c.select("tag", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint") - 1)).alias("code"))


@query(f"WITH {POINTS} SELECT label::VARCHAR AS path, NULL::VARCHAR AS key, count(*) * 64 AS n, round(sum(list_sum(v)), 3) AS total FROM p GROUP BY label")
def s17_npy_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as one .npy matrix for each label, read back by the flat label scan (S17, S3)."""
    m = arrays.matrices(points(spark, d), "label", "id", "vec")
    labels = arrays.labels_of(arrays.arrays_of(m.select(F.concat("grp", F.lit(".npy")).alias("path"), "content")))
    out = labels.groupBy("path", "key").agg(F.count("*").alias("n"), F.round(F.sum(F.col("label").cast("double")), 3).alias("total"))
    return out.withColumn("path", F.replace("path", F.lit(".npy"), F.lit("")))


@query("WITH r AS (SELECT l_returnflag AS tag, l_linenumber AS seed, count(*) AS n, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY ALL) SELECT tag, seed, n, value FROM r")
def s18_json_results(spark: SparkSession, d: str) -> DataFrame:
    """Runs as JSON objects, read back."""
    r = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tag"), F.col("l_linenumber").alias("seed")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("value"))
    back = files.results_json(r).select(F.from_json("json", "tag string, seed int, n bigint, value double").alias("r"))
    return back.select("r.tag", "r.seed", "r.n", "r.value")


@query(f"WITH {POINTS} SELECT id, [v[1], v[2], v[3]] AS n, [v[7], v[8], v[9]] AS c, CASE WHEN id % 5 = 0 THEN [0.0, 0.0, 0.0]::DOUBLE[] ELSE [v[13], v[14], v[15]] END AS cb, 37::BIGINT AS slots, (CASE WHEN id % 5 = 0 THEN 4 ELSE 5 END)::BIGINT AS present FROM p")
def proj6_wide_atoms(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.slice("vec", i * 3 + 1, 3)
    xyz, here = lookup.wide_atoms({"n": at(0), "ca": at(1), "c": at(2), "o": at(3), "cb": F.when(F.col("id") % 5 != 0, at(4))})
    w = points(spark, d).select("id", xyz.alias("xyz"), here.alias("here"))
    slot = lambda a: F.get("xyz", F.lit(lookup.WIDE[a])).alias(a)
    return w.select("id", slot("n"), slot("c"), slot("cb"), F.size("xyz").cast("bigint").alias("slots"), F.size(F.filter("here", lambda x: x)).cast("bigint").alias("present"))


@query(f"""WITH {POINTS}, s AS (SELECT i, avg(v[i]) AS mean, greatest(stddev_pop(v[i]), 1e-12) AS std FROM p, range(1, 65) AS r(i) WHERE id < 200 GROUP BY i)
    SELECT id, list(round((v[i] - mean) / std, 6) + 0.0 ORDER BY i) AS z FROM p, s GROUP BY id""")
def proj12_stored_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the first vectors, kept and applied to all."""
    from strandmill.operators.quantize import apply_statistics, statistics

    p = points(spark, d)
    return apply_statistics(p, statistics(p.where("id < 200"))).select("id", vec.rounded("z").alias("z"))


@query(f"WITH {RECORDS} SELECT tag, level, pid, list_resize(list_slice(tokens, 1, 256), 256, -1) AS dense, least(len(tokens), 256)::BIGINT AS n_valid FROM t")
def proj20_padding(spark: SparkSession, d: str) -> DataFrame:
    dense, mask = lookup.padded("tokens", 256, F.lit(-1).cast("bigint"))
    return records(spark, d).select("tag", "level", "pid", dense.alias("dense"), F.size(F.filter(mask, lambda x: x)).cast("bigint").alias("n_valid"))


@query("SELECT vec_id AS id, len(embedding)::INT AS n FROM embeddings")
def proj21_checked_shapes(spark: SparkSession, d: str) -> DataFrame:
    e = lookup.checked(load(spark, d, "embeddings"), {"embedding": 64})
    return e.select(F.col("vec_id").alias("id"), F.size("embedding").alias("n"))


@query(f"""WITH {FRAMES} SELECT event_id, round(0.1 * coalesce(lag(value, 2) OVER w, 0) + 0.2 * coalesce(lag(value) OVER w, 0) + 0.4 * value + 0.2 * coalesce(lead(value) OVER w, 0) + 0.1 * coalesce(lead(value, 2) OVER w, 0), 6) AS conv
    FROM f WINDOW w AS (PARTITION BY key ORDER BY frame)""")
def w6_sliding_dot(spark: SparkSession, d: str) -> DataFrame:
    c = lookup.sliding_dot(frames(spark, d), "key", "frame", "value", [0.1, 0.2, 0.4, 0.2, 0.1])
    return c.select("event_id", F.round("conv", 6).alias("conv"))


@query(f"""WITH {POINTS}, b AS (SELECT a.v AS x, c.v AS y, list_dot_product(a.v, a.v) AS xx, list_dot_product(a.v, c.v) AS xy, list_dot_product(c.v, c.v) AS yy FROM p a, p c WHERE a.id = 0 AND c.id = 1),
    k AS (SELECT id, v, x, y, list_dot_product(v, x) AS vx, list_dot_product(v, y) AS vy, xx, xy, yy FROM p, b),
    s AS (SELECT id, (vx * yy - vy * xy) / (xx * yy - xy * xy) AS c0, (vy * xx - vx * xy) / (xx * yy - xy * xy) AS c1, list_dot_product(v, v) AS vv, vx, vy FROM k)
    SELECT id, [round(c0, 6) + 0.0, round(c1, 6) + 0.0] AS coef, round(sqrt(greatest(vv - c0 * vx - c1 * vy, 0)), 5) + 0.0 AS rest FROM s""")
def f17_projection(spark: SparkSession, d: str) -> DataFrame:
    """Least squares on the first two vectors, which are not orthogonal."""
    p = points(spark, d)
    two = [r["vec"] for r in p.where("id < 2").orderBy("id").collect()]
    out = basis.projected(p, np.array(two))
    return out.select("id", vec.rounded("coef").alias("coef"), (F.round("rest", 5) + 0.0).alias("rest"))


@query()
def f17_random_basis(spark: SparkSession, d: str) -> DataFrame:
    out = basis.projected(points(spark, d), basis.random_basis(64, 8, seed=3))
    return out.select("id", vec.rounded("coef").alias("coef"), F.round("rest", 6).alias("rest"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS name, CASE WHEN p_size % 4 <> 0 THEN '/data/' || p_type || '=1' END AS path FROM part""")
def f21_named_paths(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit(" "), "p_brand", F.lit(" = /data/"), "p_type", F.lit("=1"))).otherwise(F.concat(F.lit("= "), "p_type"))
    return load(spark, d, "part").select("p_partkey", args.named_column(t).alias("a")).select("p_partkey", "a.name", "a.path")


@query(f"""WITH {POINTS} SELECT 'raw' AS mode, id, 64::BIGINT AS n, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM p UNION ALL SELECT 'unit', id, 64, 1.0 FROM p
    UNION ALL SELECT 'steps', id, 63, round(sqrt(list_sum(list_transform(range(1, 64), lambda i: pow(v[i + 1] - v[i], 2)))), 6) FROM p UNION ALL SELECT 'norm', id, 1, round(sqrt(list_dot_product(v, v)), 6) FROM p""")
def x1_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Every registered descriptor of every vector."""
    p = points(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), registry.descriptor(m, "vec").alias("x")) for m in registry.DESCRIPTORS])).alias("e")
    return p.select("id", each).select("e.mode", "id", F.size("e.x").cast("bigint").alias("n"), F.round(vec.norm("e.x"), 6).alias("norm"))


_SEQ = r"regexp_replace(upper(seq), '[^\p{L}]', '', 'g')"


@query(rf"""WITH {POINTS}, s AS (SELECT {_PID} AS pid, max({_SEQ}) AS seq FROM real_bb WHERE seq IS NOT NULL AND {_PID} IS NOT NULL GROUP BY 1 HAVING max({_SEQ}) <> ''),
    l AS (SELECT CASE WHEN strpos('ACDEFGHIKLMNPQRSTVWY', aa) = 0 THEN 20 ELSE strpos('ACDEFGHIKLMNPQRSTVWY', aa) - 1 END AS token FROM (SELECT unnest(string_split(seq, '')) AS aa FROM s))
    SELECT 'residue' AS tag, token::BIGINT AS token, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'nearest', code::BIGINT, count(*) FROM n0 GROUP BY ALL""")
def x2_tokenizers(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of registered tokenizers under one contract, counted."""
    from strandmill.functions.keys import letters

    s = load(spark, d, "real_bb").where("seq IS NOT NULL").groupBy(key("pid").alias("pid")).agg(F.max(letters("seq")).alias("seq")).where("pid IS NOT NULL AND seq <> ''")
    v = points(spark, d).select(F.col("label").cast("string").alias("pid"), F.col("id").alias("residue"), "vec")
    both = registry.tokenize("residue", s).unionByName(registry.tokenize("nearest", v, codebook=books(spark, d)[0]))
    return both.groupBy("tag", "token").agg(F.count("*").alias("n"))


@query()
def l7_token_regression(spark: SparkSession, d: str) -> DataFrame:
    """A linear probe of a value on one-hot tokens: Spearman of the held-out rows."""
    f = probes.token_features(frames(spark, d), "token", 5)
    out = probes.regression(f, "features", "value", "event_id")
    return ranks.spearman(out, "prediction", "label").select("n", F.round("rho", 6).alias("rho"))


@query()
def l8_pooled_regression(spark: SparkSession, d: str) -> DataFrame:
    """A linear probe on pooled residues: the vectors of a key, mean and maximum."""
    from strandmill.operators.tokenstats import masked_pool

    r = points(spark, d).select(F.pmod("id", F.lit(100)).alias("key"), "vec", F.lit(True).alias("mask"), "label")
    y = r.groupBy("key").agg(F.avg("label").alias("y"))
    return probes.regression(masked_pool(r).join(y, "key"), "pooled", "y", "key").select("key", F.round("label", 6).alias("label"), F.round("prediction", 4).alias("prediction"))


@query()
def l9_multilabel(spark: SparkSession, d: str) -> DataFrame:
    """One-vs-rest probes of the vectors' labels, and the whole bundle of their scores."""
    p = points(spark, d)
    scored = probes.multilabel(p, p.select("id", F.col("label").cast("string").alias("label")), "vec", [str(i) for i in range(4)])
    b = probes.multilabel_bundle(scored)
    return b.select("n_classes", "n_items", *[F.round(c, 4).alias(c) for c in b.columns[2:]])
