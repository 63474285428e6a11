"""Queries of codebooks, tokens and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import vec
from strandmill.operators import quantize, tokenstats
from strandmill.plans.registry import query
from strandmill.plans.shared import FRAMES, POINTS, RECORDS, books, frames, points, records
from strandmill.tables import load

_ROUND = "list_transform({}, lambda x: round(x, 6) + 0.0)"


@query(f"WITH {POINTS} SELECT id, code, round(d2, 6) AS d2 FROM n0")
def j11_nearest_code(spark: SparkSession, d: str) -> DataFrame:
    return quantize.nearest_code(points(spark, d), books(spark, d)[0]).select("id", "code", F.round("d2", 6).alias("d2"))


@query(f"WITH {POINTS} SELECT id, t0, t1, round(d2, 6) AS d2 FROM n1")
def w11_residual_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = quantize.residual_tokens(points(spark, d), books(spark, d))
    at = lambda c, i: F.get(c, F.lit(i))
    return t.select("id", at("tokens", 0).alias("t0"), at("tokens", 1).alias("t1"), F.round(at("d2", 1), 6).alias("d2"))


@query(f"WITH {POINTS} SELECT avg(d2 / 64) AS mse, avg(d2 / 64) * 0.25 AS commitment, avg(d2 / 64) * 0.5 AS codebook, count(*) AS n FROM n1".replace("avg(d2 / 64)", "round(avg(d2 / 64), 9)"))
def j10_decode_error(spark: SparkSession, d: str) -> DataFrame:
    p, b = points(spark, d), books(spark, d)
    t = quantize.decode(quantize.residual_tokens(p, b), b).join(p, "id")
    e = F.round(F.avg(vec.sqdist("vec", "decoded") / F.size("vec")), 9)
    return t.agg(e.alias("mse"), (e * 0.25).alias("commitment"), (e * 0.5).alias("codebook"), F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT id, {_ROUND.format('list_transform(list_zip(n1.c, c0.c), lambda x: x[1] + x[2])')} AS decoded FROM n1 JOIN c0 ON n1.t0 = c0.code")
def l5_decode_all(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    return quantize.decode(quantize.residual_tokens(points(spark, d), b), b).select("id", vec.rounded("decoded").alias("decoded"))


@query(f"""WITH {POINTS}, t AS (SELECT 0 AS level, t0 AS token FROM n1 UNION ALL SELECT 1, t1 FROM n1), c AS (SELECT level, token, count(*) AS c FROM t GROUP BY ALL),
    s AS (SELECT level, sum(c)::BIGINT AS n, count(*) AS u, -sum(c / tot * ln(c / tot)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY level) AS tot FROM c) GROUP BY level)
    SELECT level, n, u AS n_unique, round(u / CASE level WHEN 0 THEN 16 ELSE 8 END, 9) AS utilization, round(exp(h), 6) AS perplexity FROM s""")
def a8_level_summary(spark: SparkSession, d: str) -> DataFrame:
    t = quantize.residual_tokens(points(spark, d), books(spark, d)).select(F.posexplode("tokens").alias("level", "token"))
    sizes = spark.createDataFrame([(0, 16), (1, 8)], "level int, m int")
    return tokenstats.codebook_use(t, sizes).select("level", "n", "n_unique", F.round("utilization", 9).alias("utilization"), F.round("perplexity", 6).alias("perplexity"))


@query(f"""WITH {RECORDS}, o AS (SELECT t.tag, t.level, m, unnest(tokens) AS token FROM t JOIN codebook_sizes s ON t.tag = s.tag AND t.level = s.level),
    c AS (SELECT tag, level, m, token, count(*) AS c FROM o WHERE token >= 0 AND token < m GROUP BY ALL)
    SELECT tag, level, sum(c)::BIGINT AS n, count(*) AS n_unique, round(count(*) / max(m), 9) AS utilization, round(exp(-sum(c / tot * ln(c / tot))), 6) AS perplexity
    FROM (SELECT *, sum(c) OVER (PARTITION BY tag, level) AS tot FROM c) GROUP BY tag, level""")
def a5_a6_codebook_stats(spark: SparkSession, d: str) -> DataFrame:
    sizes = load(spark, d, "codebook_sizes").withColumn("lv", F.struct("tag", "level"))
    t = records(spark, d).select("tag", "level", F.explode("tokens").alias("token")).join(F.broadcast(sizes), ["tag", "level"])
    t = t.where(F.col("token").between(0, F.col("m") - 1)).select("lv", "token")
    use = tokenstats.codebook_use(t, sizes.select(F.col("lv").alias("level"), "m"), level="lv")
    return use.select("level.tag", "level.level", "n", "n_unique", F.round("utilization", 9).alias("utilization"), F.round("perplexity", 6).alias("perplexity"))


@query(f"WITH {FRAMES}, c AS (SELECT token, count(*) AS n FROM f GROUP BY token) SELECT r.k::BIGINT AS token, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM f), 9) AS p FROM range(8) AS r(k) LEFT JOIN c ON c.token = r.k")
def a2_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tokenstats.histogram(frames(spark, d), 8).withColumn("p", F.round("p", 9))


@query("SELECT tag, round(sum(log2(m)), 9) AS bits FROM codebook_sizes GROUP BY tag")
def a7_effective_bits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "codebook_sizes").groupBy("tag").agg(F.round(F.sum(F.log2("m")), 9).alias("bits"))


@query(f"WITH {POINTS} SELECT id, list_transform(range(16), lambda i: CASE WHEN i = t0 THEN 1.0::DOUBLE ELSE 0.0 END) AS one_hot, list_transform(range(24), lambda i: CASE WHEN i = t0 OR i = t1 + 16 THEN 1.0::DOUBLE ELSE 0.0 END) AS multi_hot FROM n1")
def f8_onehot_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = quantize.residual_tokens(points(spark, d), books(spark, d))
    a, b = vec.one_hot(F.get("tokens", F.lit(0)), 16), vec.one_hot(F.get("tokens", F.lit(1)), 8)
    return t.select("id", a.alias("one_hot"), F.concat(a, b).alias("multi_hot"))


@query(f"""WITH {POINTS}, u AS (SELECT id, i, v[i] AS x FROM p, range(1, 65) AS r(i)), m AS (SELECT i, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS sd FROM u GROUP BY i)
    SELECT id, list(round((x - mu) / sd, 6) + 0.0 ORDER BY i) AS z FROM u JOIN m USING (i) GROUP BY id""")
def proj13_standardize(spark: SparkSession, d: str) -> DataFrame:
    return quantize.standardize(points(spark, d)).select("id", vec.rounded("z").alias("z"))


@query(f"""WITH {POINTS}, u AS (SELECT code, i, avg(v[i]) AS x, count(*) AS n FROM n0, range(1, 65) AS r(i) GROUP BY ALL)
    SELECT code, any_value(n) AS n, list(round(x, 6) + 0.0 ORDER BY i) AS vec FROM u GROUP BY code""")
def a24_kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    return quantize.kmeans_step(points(spark, d), books(spark, d)[0]).select("code", "n", vec.rounded("vec").alias("vec"))


@query()
def a24_kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    return quantize.kmeans_fit(points(spark, d), 16, rounds=20)


@query(f"""WITH {POINTS}, u AS (SELECT code, i, sum(v[i]) AS s, count(*) AS n FROM n0, range(1, 65) AS r(i) GROUP BY ALL),
    e AS (SELECT c0.code, r.i, 0.99::DOUBLE * 20 + 0.01::DOUBLE * coalesce(n, 0) AS c, 0.99::DOUBLE * 20 * c0.c[r.i] + 0.01::DOUBLE * coalesce(s, 0) AS w FROM c0 CROSS JOIN range(1, 65) AS r(i) LEFT JOIN u ON u.code = c0.code AND u.i = r.i),
    a AS (SELECT sum(c) AS al FROM (SELECT DISTINCT code, c FROM e))
    SELECT code, round(any_value(c), 9) AS ema_count, list(round(w / ((c + 1e-5) / (al + 16 * 1e-5) * al), 6) + 0.0 ORDER BY i) AS vec FROM e, a GROUP BY code""")
def a25_ema_step(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)[0]
    state = b.select("code", F.lit(20.0).alias("ema_count"), vec.scale("vec", 20.0).alias("ema_weight"), "vec")
    return quantize.ema_step(state, points(spark, d)).select("code", F.round("ema_count", 9).alias("ema_count"), vec.rounded("vec").alias("vec"))


@query(f"""WITH {POINTS}, {FRAMES}, g AS (SELECT * FROM f WHERE frame < 4), c AS (SELECT key, token, count(*) AS n FROM g GROUP BY ALL),
    w AS (SELECT *, max(n) OVER (PARTITION BY key) AS top FROM c), k AS (SELECT key, any_value(top) AS top, count(*) FILTER (n = top) AS ties FROM w GROUP BY key),
    sure AS (SELECT w.key, w.token::BIGINT AS token, true AS voted FROM w JOIN k ON w.key = k.key WHERE k.top >= 2 AND k.ties = 1 AND w.n = k.top),
    m AS (SELECT g.key, i, avg(c0.c[i]) AS x FROM g JOIN k ON g.key = k.key JOIN c0 ON c0.code = g.token, range(1, 65) AS r(i) WHERE NOT (k.top >= 2 AND k.ties = 1) GROUP BY ALL),
    l AS (SELECT key, list(x ORDER BY i) AS v FROM m GROUP BY key),
    n AS (SELECT key, code, row_number() OVER (PARTITION BY key ORDER BY round(list_distance(v, c), 12), code) AS r FROM l, c0)
    SELECT * FROM sure UNION ALL SELECT key, code, false FROM n WHERE r = 1""")
def a3_plurality_vote(spark: SparkSession, d: str) -> DataFrame:
    return tokenstats.plurality_vote(frames(spark, d).where("frame < 4"), books(spark, d)[0])


@query(f"WITH {FRAMES}, c AS (SELECT key, token, count(*) AS n FROM f GROUP BY ALL) SELECT key, list(round(coalesce(n, 0) / al, 9) ORDER BY i) AS hist FROM (SELECT key, count(*) AS al FROM f GROUP BY key) k CROSS JOIN range(5) AS r(i) LEFT JOIN c USING (key) WHERE false GROUP BY key".replace("LEFT JOIN c USING (key) WHERE false GROUP BY key", "LEFT JOIN c ON c.key = k.key AND c.token = r.i GROUP BY k.key").replace("SELECT key, list(round", "SELECT k.key, list(round"))
def a4_frame_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tokenstats.frame_histogram(frames(spark, d), 5).select("key", F.transform("hist", lambda x: F.round(x, 9)).alias("hist"))


@query(f"""WITH {POINTS}, {FRAMES}, c AS (SELECT key, token, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT code, list_transform(range(2), lambda i: v[i + 1]) AS v FROM (SELECT id AS code, v FROM p WHERE id < 5)),
    h AS (SELECT k.key, b.code, coalesce(n, 0) / al AS share, b.v FROM (SELECT key, count(*) AS al FROM f GROUP BY key) k CROSS JOIN b LEFT JOIN c ON c.key = k.key AND c.token = b.code)
    SELECT key, flatten(list([round(share, 9), round(v[1], 9), round(v[2], 9)] ORDER BY code)) AS profile FROM h GROUP BY key""")
def j14_interleave(spark: SparkSession, d: str) -> DataFrame:
    book = points(spark, d).where("id < 5").select(F.col("id").alias("code"), F.slice("vec", 1, 2).alias("vec"))
    p = tokenstats.profile(tokenstats.frame_histogram(frames(spark, d), 5), book)
    return p.select("key", F.transform("profile", lambda x: F.round(x, 9)).alias("profile"))


@query(f"""WITH {POINTS}, a AS (SELECT id AS key, t0 AS a FROM n1), b AS (SELECT id AS key, code AS b FROM (SELECT p.id, code, row_number() OVER (PARTITION BY p.id ORDER BY round(list_distance(v, c), 12), code) AS r FROM p, c0 WHERE code < 12) WHERE r = 1 AND id >= 5),
    j AS (SELECT coalesce(a.key, b.key) AS key, a, b FROM a FULL JOIN b ON a.key = b.key)
    SELECT count(a) AS n_left, count(b) AS n_right, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (a <> b) AS n_diff, (SELECT list_sort(list(key)) FROM (SELECT key FROM j WHERE a <> b ORDER BY key LIMIT 5)) AS first_diffs FROM j""")
def a31_array_diff(spark: SparkSession, d: str) -> DataFrame:
    p, b = points(spark, d), books(spark, d)[0]
    one = quantize.nearest_code(p, b).select(F.col("id").alias("key"), F.col("code").alias("token"))
    two = quantize.nearest_code(p.where("id >= 5"), b.where("code < 12")).select(F.col("id").alias("key"), F.col("code").alias("token"))
    return tokenstats.array_diff(one, two)


@query(f"""WITH {POINTS}, u AS (SELECT label AS key, i, avg(v[i]) FILTER (id % 3 <> 0) AS a, max(v[i]) FILTER (id % 3 <> 0) AS b FROM p, range(1, 65) AS r(i) GROUP BY ALL)
    SELECT key, list_concat(list(round(coalesce(a, 0), 6) + 0.0 ORDER BY i), list(round(coalesce(b, 0), 6) + 0.0 ORDER BY i)) AS pooled FROM u GROUP BY key""")
def a26_masked_pool(spark: SparkSession, d: str) -> DataFrame:
    r = points(spark, d).select(F.col("label").alias("key"), "vec", (F.col("id") % 3 != 0).alias("mask"))
    return tokenstats.masked_pool(r).select("key", vec.rounded("pooled").alias("pooled"))


@query(f"WITH {RECORDS} SELECT t.tag, t.level, t.pid, list_transform(tokens, lambda x: greatest(0, least(x, m - 1)))::BIGINT[] AS clipped FROM t JOIN codebook_sizes s ON t.tag = s.tag AND t.level = s.level")
def proj14_clip(spark: SparkSession, d: str) -> DataFrame:
    sizes = load(spark, d, "codebook_sizes").select("tag", "level", F.col("m").cast("bigint").alias("m"))
    t = records(spark, d).join(F.broadcast(sizes), ["tag", "level"])
    zero = F.lit(0).cast("bigint")
    return t.select("tag", "level", "pid", F.transform("tokens", lambda x: F.greatest(zero, F.least(x, F.col("m") - 1))).alias("clipped"))


@query(f"""WITH {POINTS}, q AS (SELECT id, v FROM p WHERE id < 40), r AS (SELECT p.id, q.id AS frame, list_distance(p.v, q.v) AS dist FROM p, q),
    b AS (SELECT id, coalesce(min(frame) FILTER (dist < 1e-3), arg_min(frame, struct_pack(a := round(dist, 12), b := frame))) AS frame FROM r GROUP BY id)
    SELECT b.id, b.frame, round(dist, 6) AS dist FROM b JOIN r ON b.id = r.id AND b.frame = r.frame WHERE dist <= 1.2""")
def j9_capped_nearest(spark: SparkSession, d: str) -> DataFrame:
    from strandmill.operators.geometry import capped_nearest

    p = points(spark, d)
    out = capped_nearest(p.select("id", "vec"), p.where("id < 40").select(F.col("id").alias("frame"), "vec"), 1.2)
    return out.withColumn("dist", F.round("dist", 6))


@query(f"""WITH {POINTS}, r AS (SELECT a.label AS key, a.id, b.id AS neighbour, pow(list_distance(a.v, b.v), 2) AS d2 FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id)
    SELECT * FROM (SELECT key::BIGINT AS key, id, neighbour, row_number() OVER (PARTITION BY id ORDER BY round(d2, 12), neighbour)::INT AS rank, round(d2, 6) AS d2 FROM r) WHERE rank <= 3""")
def j13_knn(spark: SparkSession, d: str) -> DataFrame:
    from strandmill.operators.geometry import nearest_rows

    return nearest_rows(points(spark, d), 3, "label", "id", "vec").withColumn("d2", F.round("d2", 6))


@query(f"""WITH {POINTS}, q AS (SELECT label AS key, id, v[1] * 20 AS x, v[2] * 20 AS y, v[3] * 20 AS z FROM p)
    SELECT a.key, a.id AS a, b.id AS b FROM q a JOIN q b ON a.key = b.key WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 4""")
def j12_radius_ball(spark: SparkSession, d: str) -> DataFrame:
    from strandmill.operators.geometry import radius_pairs

    at = lambda i: (F.get("vec", F.lit(i)) * 20)
    p = points(spark, d).select(F.col("label").alias("key"), "id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return radius_pairs(p, 2.0)


@query(f"""WITH {POINTS}, {RECORDS}, w AS (SELECT pid, tokens AS a FROM t WHERE tag = 'ens_a' AND level = 1), m AS (SELECT pid, tokens AS b FROM t WHERE tag = 'ens_a' AND level = 2),
    j AS (SELECT pid, a, b FROM w JOIN m USING (pid) WHERE len(a) = len(b)),
    e AS (SELECT pid, i, a[i] % 16 AS x, b[i] % 16 AS y FROM j, unnest(range(1, len(a) + 1)) AS r(i) WHERE a[i] >= 0 AND b[i] >= 0)
    SELECT pid, round(sum(list_distance(u.c, v.c)), 6) AS disruption, count(*) AS n FROM e JOIN c0 u ON u.code = x JOIN c0 v ON v.code = y GROUP BY pid HAVING count(*) >= 10""")
def a20_disruption(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("tag = 'ens_a'")
    wt, mut = r.where("level = 1").select("pid", F.col("tokens").alias("a")), r.where("level = 2").select("pid", F.col("tokens").alias("b"))
    e = wt.join(mut, "pid").where(F.size("a") == F.size("b")).select("pid", F.explode(F.arrays_zip("a", "b")).alias("e")).where("e.a >= 0 AND e.b >= 0")
    book = books(spark, d)[0]
    e = e.select("pid", (F.col("e.a") % 16).alias("x"), (F.col("e.b") % 16).alias("y"))
    # each pair of codes that occurs is measured once, not once a position
    e = e.groupBy("pid", "x", "y").agg(F.count("*").alias("c"))
    far = e.select("x", "y").distinct().join(F.broadcast(book.toDF("x", "u")), "x").join(F.broadcast(book.toDF("y", "v")), "y").select("x", "y", F.sqrt(vec.sqdist("u", "v")).alias("far"))
    return e.join(far, ["x", "y"]).groupBy("pid").agg(F.round(F.sum(F.col("c") * F.col("far")), 6).alias("disruption"), F.sum("c").alias("n")).where("n >= 10")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-code tokens of all vectors, and the use of each code and of the codebook."""
    t = quantize.nearest_code(points(spark, d), books(spark, d)[0]).select(F.lit(0).alias("level"), F.col("code").alias("token"))
    use = tokenstats.codebook_use(t, spark.createDataFrame([(0, 16)], "level int, m int")).select("utilization", "perplexity")
    return tokenstats.histogram(t, 16).join(F.broadcast(use), how="cross")  # one row


@query(f"""WITH {POINTS}, c AS (SELECT code AS token, count(*) AS n FROM n0 GROUP BY code), s AS (SELECT sum(n) AS al, count(*) AS u FROM c)
    SELECT r.k::BIGINT AS token, coalesce(n, 0) AS n, round(coalesce(n, 0) / al, 9) AS p, round(u / 16, 9) AS utilization, round(exp(-(SELECT sum(n / al * ln(n / al)) FROM c, s)), 6) AS perplexity FROM range(16) AS r(k) LEFT JOIN c ON c.token = r.k, s""")
def e0_flagship(spark: SparkSession, d: str) -> DataFrame:
    f = flagship(spark, d)
    return f.select("token", "n", F.round("p", 9).alias("p"), F.round("utilization", 9).alias("utilization"), F.round("perplexity", 6).alias("perplexity"))
