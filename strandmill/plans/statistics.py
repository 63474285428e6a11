"""Queries of rank statistics, effect sizes, error measures and seed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import text, vec
from strandmill.operators import ranks, report, stats
from strandmill.plans.registry import query
from strandmill.plans.shared import FRAMES, frames
from strandmill.tables import load


def _r(c: str, digits: int = 9):
    return F.round(c, digits).alias(c)


@query(f"""WITH {FRAMES}, g AS (SELECT key, count(*) AS n, avg(value) AS mu, var_pop(value) AS v FROM f WHERE value > 0 GROUP BY key HAVING count(*) >= 80),
    s AS (SELECT count(*) AS m, sum(n)::BIGINT AS n, sum(n * mu) / sum(n) AS gm, sum(n * v) AS w FROM g), b AS (SELECT sum(n * pow(mu - gm, 2)) AS b FROM g, (SELECT gm FROM s))
    SELECT round(b / (b + w), 9) AS eta2, m, n FROM s, b""")
def a1_eta_squared(spark: SparkSession, d: str) -> DataFrame:
    return stats.eta_squared(frames(spark, d).where("value > 0 AND NOT isnan(value)"), "value", "key", 80).withColumn("eta2", F.round("eta2", 9))


_RANKS = "(rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0)"


@query(f"WITH {FRAMES} SELECT event_id, round({_RANKS.format(g='token', x='round(value, 0)')}, 3)::DOUBLE AS rank FROM f")
def w1_ranksum(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("x", F.round("value", 0))
    return ranks.average_ranks(f, "x", ["token"]).select("event_id", F.round("rank", 3).alias("rank"))


@query(f"WITH {FRAMES}, r AS (SELECT token, {_RANKS.format(g='token', x='round(value, 0)')} AS a, {_RANKS.format(g='token', x='key')} AS b FROM f) SELECT token, count(*) AS n, round(corr(a, b), 9) AS rho FROM r GROUP BY token")
def a19_spearman(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("x", F.round("value", 0))
    return ranks.spearman(f, "x", "key", ["token"]).select("token", "n", _r("rho"))


@query("""WITH y AS (SELECT round(value, 1) AS s, event_type = 'click' AS y FROM events), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM y),
    c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n, sum(r) FILTER (y) AS s FROM r) SELECT p AS n_pos, n AS n_neg, round((s - p * (p + 1) / 2) / (p * n), 9) AS auroc FROM c""")
def a16_auroc(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.round("value", 1).alias("s"), (F.col("event_type") == "click").alias("y"))
    return ranks.auroc(e, "s", "y").select("n_pos", "n_neg", _r("auroc"))


_SCORED = """s AS (SELECT event_id, event_type, c.k AS cls, (hash_ % 101) / 100.0::DOUBLE AS score, (event_type = c.k)::INT AS y
    FROM events, (VALUES ('click', 7), ('error', 11), ('purchase', 13), ('signup', 17), ('view', 19)) AS c(k, w), LATERAL (SELECT ((event_id * c.w) % 1009 + user_id * c.w) AS hash_))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in (("click", 7), ("error", 11), ("purchase", 13), ("signup", 17), ("view", 19))])).alias("c")
    e = load(spark, d, "events").select("event_id", "event_type", "user_id", c)
    h = (F.col("event_id") * F.col("c.w")) % 1009 + F.col("user_id") * F.col("c.w")
    return e.select("event_id", F.col("c.k").alias("cls"), ((h % 101) / 100.0).alias("score"), (F.col("event_type") == F.col("c.k")).cast("int").alias("y"))


@query(f"""WITH {_SCORED}, t AS (SELECT cls, score, count(*) AS n, sum(y) AS p FROM s GROUP BY ALL), u AS (SELECT 'micro' AS kind, score, sum(n) AS n, sum(p) AS p FROM t GROUP BY score UNION ALL SELECT cls, score, n, p FROM t),
    c AS (SELECT kind, p, sum(p) OVER w / sum(n) OVER w AS prec FROM u WINDOW w AS (PARTITION BY kind ORDER BY score DESC)), a AS (SELECT kind, sum(p * prec) / sum(p) AS ap FROM c GROUP BY kind)
    SELECT round(avg(ap) FILTER (kind <> 'micro'), 9) AS macro_ap, round(max(ap) FILTER (kind = 'micro'), 9) AS micro_ap FROM a""")
def a13_average_precision(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    macro = ranks.average_precision(s, "score", "y", ["cls"]).agg(F.avg("ap").alias("macro_ap"))
    return macro.join(ranks.average_precision(s, "score", "y").select(F.col("ap").alias("micro_ap")), how="cross").select(_r("macro_ap"), _r("micro_ap"))  # one row each


@query(f"""WITH {_SCORED}, c AS (SELECT cls, count(*) FILTER (score > 0.5 AND y = 1) AS tp, count(*) FILTER (score > 0.5 AND y = 0) AS fp, count(*) FILTER (score <= 0.5 AND y = 1) AS fn FROM s GROUP BY cls)
    SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1 FROM c""")
def a14_f1(spark: SparkSession, d: str) -> DataFrame:
    return stats.f1(_scored(spark, d), "score", "y", "cls").select(_r("macro_f1"), _r("micro_f1"))


@query(f"WITH {_SCORED} SELECT round(avg((y = 1)::INT), 9) AS top1 FROM (SELECT y, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, cls) AS r FROM s) WHERE r = 1")
def a15_top1_hit(spark: SparkSession, d: str) -> DataFrame:
    return stats.top1_hit(_scored(spark, d), "event_id", "score", "y", "cls").select(_r("top1"))


@query(f"""WITH {_SCORED}, t AS (SELECT cls, score, count(*) AS n, sum(y) AS p FROM s GROUP BY ALL), u AS (SELECT 'micro' AS kind, score, sum(n) AS n, sum(p) AS p FROM t GROUP BY score UNION ALL SELECT cls, score, n, p FROM t),
    v AS (SELECT kind, p, sum(p) OVER w / sum(n) OVER w AS prec FROM u WINDOW w AS (PARTITION BY kind ORDER BY score DESC)), ap AS (SELECT kind, sum(p * prec) / sum(p) AS ap FROM v GROUP BY kind),
    r AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0::DOUBLE AS r FROM s), q AS (SELECT cls, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n, sum(r) FILTER (y = 1) AS w FROM r GROUP BY cls),
    c AS (SELECT cls, count(*) FILTER (score > 0.5 AND y = 1) AS tp, count(*) FILTER (score > 0.5 AND y = 0) AS fp, count(*) FILTER (score <= 0.5 AND y = 1) AS fn FROM s GROUP BY cls),
    f AS (SELECT avg(2 * tp / (2 * tp + fp + fn)) AS macro, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro FROM c),
    h AS (SELECT avg((y = 1)::INT) AS top1 FROM (SELECT y, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, cls) AS r FROM s) WHERE r = 1)
    SELECT (SELECT count(DISTINCT cls) FROM s) AS n_classes, (SELECT count(DISTINCT event_id) FROM s) AS n_items, (SELECT round(avg(ap), 9) FROM ap WHERE kind <> 'micro') AS macro_ap, (SELECT round(ap, 9) FROM ap WHERE kind = 'micro') AS micro_ap,
      (SELECT round(avg((w - p * (p + 1) / 2) / (p * n)), 9) FROM q) AS macro_auroc, round(macro, 9) AS macro_f1, round(micro, 9) AS micro_f1, (SELECT round(top1, 9) FROM h) AS top1 FROM f""")
def a12_multilabel_bundle(spark: SparkSession, d: str) -> DataFrame:
    from strandmill.operators.probes import multilabel_bundle

    b = multilabel_bundle(_scored(spark, d), "event_id")
    return b.select("n_classes", "n_items", *[_r(c) for c in b.columns[2:]])


@query("WITH x AS (SELECT l_returnflag AS flag, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem) SELECT flag, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(pow(y - p, 2)), 2) AS mse FROM x GROUP BY flag")
def a17_r2_mse(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    return x.groupBy("flag").agg(F.round(stats.r2("y", "p"), 6).alias("r2"), F.round(stats.mse("y", "p"), 2).alias("mse"))


@query(f"WITH {FRAMES} SELECT event_id, round((value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-12), 6) + 0.0 AS z FROM f WINDOW w AS (PARTITION BY key)")
def w2_zscore(spark: SparkSession, d: str) -> DataFrame:
    return ranks.zscores(frames(spark, d), "value", ["key"]).select("event_id", (F.round("z", 6) + 0.0).alias("z"))


@query(f"""WITH {FRAMES}, z AS (SELECT token, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-12) AS a, (key - avg(key) OVER w) / greatest(stddev_pop(key) OVER w, 1e-12) AS b, event_id % 97 AS y FROM f WINDOW w AS (PARTITION BY token)),
    m AS (SELECT token, alpha::DOUBLE AS alpha, y, round(alpha * a + (1 - alpha) * b, 9) AS x FROM z, (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4), (0.5)) AS l(alpha)),
    r AS (SELECT token, alpha, {_RANKS.format(g='token, alpha', x='x')} AS p, {_RANKS.format(g='token, alpha', x='y')} AS q FROM m) SELECT token, alpha, round(corr(p, q), 5) AS rho FROM r GROUP BY token, alpha""")
def f20_zmix_ladder(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("y", F.col("event_id") % 97).withColumn("key", F.col("key").cast("double"))
    return ranks.blend_ladder(f, "value", "key", "y", ["token"]).withColumn("rho", F.round("rho", 5))


@query(f"WITH {FRAMES} SELECT token, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS max FROM f GROUP BY token")
def a21_assay_summary(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).groupBy("token").agg(*stats.summary("value"))
    return s.select("token", _r("mean", 6), _r("median", 6), _r("p90", 6), "max")


_RUNS = "r AS (SELECT l_returnflag AS section, l_linestatus AS split, l_linenumber AS seed, avg(l_discount) AS value FROM lineitem GROUP BY ALL), c AS (SELECT section, split, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(value) AS n FROM r GROUP BY section, split)"
#: The canonical side: the same cells from the even seeds only.
_CANON = "k AS (SELECT section, split, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(value) AS n FROM r WHERE seed % 2 = 0 AND section <> 'R' GROUP BY section, split)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("split"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("value"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return stats.seed_cells(_runs(spark, d), ["section", "split"], "value")


@query(f"WITH {_RUNS} SELECT section, split, round(mean, 9) AS mean, round(std, 9) AS std, n FROM c")
def a9_seed_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("section", "split", _r("mean"), _r("std"), "n")


@query(f"WITH {_RUNS} SELECT section, split, row_number() OVER (PARTITION BY section ORDER BY mean DESC, split)::INT AS rank FROM c")
def t2_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return report.leaderboard(_cells(spark, d), "section", "split").select("section", "split", "rank")


_WELCH = "sqrt(nullif(s1 * s1 / n1 + s2 * s2 / n2, 0))"


@query(f"WITH {_RUNS}, {_CANON}, j AS (SELECT c.section, c.split, c.mean AS m1, c.std AS s1, c.n AS n1, k.mean AS m2, k.std AS s2, k.n AS n2 FROM c JOIN k USING (section, split)) SELECT section, split, round((m1 - m2) / {_WELCH}, 6) AS t, round(pow(s1 * s1 / n1 + s2 * s2 / n2, 2) / (pow(s1 * s1 / n1, 2) / greatest(n1 - 1, 1) + pow(s2 * s2 / n2, 2) / greatest(n2 - 1, 1)), 6) AS df FROM j")
def a29_welch_t(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d, False)
    return a.where("m2 IS NOT NULL").select("section", "split", _r("t", 6), _r("df", 6))


def _audit(spark: SparkSession, d: str, with_p: bool) -> DataFrame:
    r = _runs(spark, d)
    canon = stats.seed_cells(r.where("seed % 2 = 0 AND section <> 'R'"), ["section", "split"], "value")
    return report.audit(stats.seed_cells(r, ["section", "split"], "value"), canon, ["section", "split"], with_p)


@query(f"""WITH {_RUNS}, {_CANON} SELECT section, split, round(c.mean - k.mean, 9) + 0.0 AS d_mean, round(greatest(0.002, 2.5 * k.std / sqrt(k.n)), 9) AS tol_mean, round(greatest(0.003, 0.5 * k.std), 9) AS tol_std,
    CASE WHEN k.mean IS NULL THEN 'canon-miss' WHEN c.n < k.n THEN 'partial' WHEN abs(c.mean - k.mean) <= greatest(0.002, 2.5 * k.std / sqrt(k.n)) AND abs(c.std - k.std) <= greatest(0.003, 0.5 * k.std) THEN 'match' ELSE 'off' END AS status FROM c LEFT JOIN k USING (section, split)""".replace("round(greatest(0.002, 2.5 * k.std / sqrt(k.n)), 9) AS", "round(CASE WHEN k.std IS NOT NULL THEN greatest(0.002, 2.5 * k.std / sqrt(k.n)) ELSE 0.002 END, 9) AS").replace("round(greatest(0.003, 0.5 * k.std), 9) AS", "round(CASE WHEN k.std IS NOT NULL THEN greatest(0.003, 0.5 * k.std) ELSE 0.003 END, 9) AS"))
def a30_tolerance_audit(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d, False)
    return a.select("section", "split", (F.round("d_mean", 9) + 0.0).alias("d_mean"), _r("tol_mean"), _r("tol_std"), "status")


@query()
def t3_audit_order(spark: SparkSession, d: str) -> DataFrame:
    return report.audit_order(_audit(spark, d, True)).select("section", "split", "p", "d_mean", "status")


@query(f"WITH {_RUNS}, t AS (SELECT section, split, printf('%.4f ± %.4f (n=%d)', mean, std, n) AS cell FROM c) SELECT section, split, cell, regexp_extract(cell, '^[0-9.]+')::DOUBLE AS mean, regexp_extract(cell, '± ([0-9.]+)', 1)::DOUBLE AS std, regexp_extract(cell, 'n=([0-9]+)', 1)::INT AS n FROM t")
def f18_parse_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).select("section", "split", text.cell_text(F.col("mean"), F.col("std"), F.col("n")).alias("cell"))
    return report.parsed_cells(c)


@query(f"WITH {_RUNS} SELECT section, split AS baseline, printf('%.4f ± %.4f (n=%d)', mean, std, n) AS cell FROM c")
def s20_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    board = report.leaderboard(_cells(spark, d), "section", "split").select("section", "rank", F.col("split").alias("baseline"), text.cell_text(F.col("mean"), F.col("std"), F.col("n")).alias("cell"))
    lines = report.markdown_lines(board).withColumn("doc", F.col("section"))
    return report.parse_markdown(lines).select("section", "baseline", "cell")


@query(f"WITH {_RUNS}, b AS (SELECT section, split, mean, std, n, row_number() OVER (PARTITION BY section ORDER BY mean DESC, split) AS rank FROM c) SELECT section, (rank + 3)::INT AS line_no, printf('| %s | %.4f ± %.4f (n=%d) |', split, mean, std, n) AS line FROM b UNION ALL SELECT DISTINCT section, k::INT, CASE k WHEN 1 THEN '## ' || section WHEN 2 THEN '| baseline | score |' ELSE '|---|---|' END FROM c, (VALUES (1), (2), (3)) AS h(k)")
def s19_leaderboard_lines(spark: SparkSession, d: str) -> DataFrame:
    board = report.leaderboard(_cells(spark, d), "section", "split").select("section", "rank", F.col("split").alias("baseline"), text.cell_text(F.col("mean"), F.col("std"), F.col("n")).alias("cell"))
    return report.markdown_lines(board)


@query(f"WITH {_RUNS} SELECT section, split, round(mean, 9) AS mean, abs(mean - round(mean, 4)) <= 0.0005 AND abs(std - round(std, 4)) <= 0.001 AS ok FROM c")
def a32_recomputed_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    shown = report.parsed_cells(c.select("section", "split", text.cell_text(F.col("mean"), F.col("std"), F.col("n")).alias("cell"))).select("section", "split", F.col("mean").alias("m"), F.col("std").alias("s"))
    j = c.join(shown, ["section", "split"])
    return j.select("section", "split", _r("mean"), ((F.abs(F.col("mean") - F.col("m")) <= 0.0005) & (F.abs(F.col("std") - F.col("s")) <= 0.001)).alias("ok"))


@query(f"WITH {FRAMES} SELECT key, round(sum(value * (frame + 1)) / sum(frame + 1), 6) AS loss FROM f GROUP BY key")
def a27_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("n", F.col("frame") + 1)
    return f.groupBy("key").agg(F.round(stats.weighted_mean("value", "n"), 6).alias("loss"))


@query(f"WITH {FRAMES}, x AS (SELECT key, (value - 60) / 30 AS x, (token = 2)::INT AS y, frame % 4 <> 0 AS m FROM f), b AS (SELECT key, sum(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) FILTER (m) / nullif(count(*) FILTER (m), 0) AS loss FROM x GROUP BY key) SELECT round(avg(loss), 6) AS epoch_loss, count(loss) AS n_batches FROM b")
def a28_masked_bce(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("key", ((F.col("value") - 60) / 30).alias("x"), (F.col("token") == 2).cast("int").alias("y"), (F.col("frame") % 4 != 0).alias("m"))
    b = f.groupBy("key").agg(stats.masked_bce("x", "y", "m").alias("loss"))
    return b.agg(F.round(F.avg("loss"), 6).alias("epoch_loss"), F.count("loss").alias("n_batches"))


@query(f"WITH {FRAMES} SELECT event_id, max(value) OVER (PARTITION BY key ORDER BY frame) AS best FROM f")
def w7_best_so_far(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("key").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return frames(spark, d).select("event_id", F.max("value").over(w).alias("best"))


@query(f"""WITH {FRAMES}, b AS (SELECT key, frame, value, min(value) OVER (PARTITION BY key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM f),
    i AS (SELECT key, frame, sum((low IS NULL OR value < low - 1e-4)::INT) OVER (PARTITION BY key ORDER BY frame) AS run FROM b), c AS (SELECT key, run, frame, row_number() OVER (PARTITION BY key, run ORDER BY frame) - 1 AS stale FROM i)
    SELECT key, min(frame)::INT AS stop_frame FROM c WHERE stale >= 8 GROUP BY key""")
def w8_early_stop(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("key").orderBy("frame")
    f = frames(spark, d).withColumn("low", F.min("value").over(w.rowsBetween(W.unboundedPreceding, -1)))
    f = f.withColumn("run", F.sum((F.col("low").isNull() | (F.col("value") < F.col("low") - 1e-4)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    f = f.withColumn("stale", F.row_number().over(W.partitionBy("key", "run").orderBy("frame")) - 1)
    return f.where("stale >= 8").groupBy("key").agg(F.min("frame").cast("int").alias("stop_frame"))


@query("SELECT step::BIGINT AS step, round(CASE WHEN step < 50 THEN 3e-4 * (step + 1) / 50 ELSE 3e-4 * 0.5 * (1 + cos(pi() * (step - 50) / 950)) END, 12) AS lr FROM range(1000) AS r(step)")
def w10_learning_rate(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("id")
    lr = F.when(s < 50, 3e-4 * (s + 1) / 50).otherwise(3e-4 * 0.5 * (1 + F.cos(F.pi() * (s - 50) / 950)))
    return spark.range(1000).select(s.alias("step"), F.round(lr, 12).alias("lr"))


@query(f"""WITH {FRAMES}, x AS (SELECT event_id, key, (value - 60) * 40 AS x FROM f), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY key)) AS e, avg(x) OVER (PARTITION BY key) AS mu, stddev_pop(x) OVER (PARTITION BY key) AS sd FROM x)
    SELECT event_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 6) AS sigmoid, round(greatest(x, 0), 6) AS relu, round(e / sum(e) OVER (PARTITION BY key), 6) AS softmax,
      round(0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))), 5) + 0.0 AS gelu, round((x - mu) / sqrt(sd * sd + 1e-5), 6) + 0.0 AS layer_norm FROM e""")
def f22_activations(spark: SparkSession, d: str) -> DataFrame:
    """Activations of values up to thousands; the softmax is taken from each key's maximum, so it stays finite."""
    f = frames(spark, d).select("event_id", "key", ((F.col("value") - 60) * 40).alias("x"))
    top = f.groupBy("key").agg(F.max("x").alias("top"), F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    f = f.join(top, "key")
    total = f.groupBy("key").agg(F.sum(F.exp(F.col("x") - F.col("top"))).alias("t"))
    x = F.col("x")
    gelu = 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))
    return f.join(total, "key").select(
        "event_id", F.round(F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x))), 6).alias("sigmoid"), F.round(F.greatest(x, F.lit(0.0)), 6).alias("relu"),
        F.round(F.exp(x - F.col("top")) / F.col("t"), 6).alias("softmax"), (F.round(gelu, 5) + 0.0).alias("gelu"), (F.round((x - F.col("mu")) / F.sqrt(F.col("sd") * F.col("sd") + 1e-5), 6) + 0.0).alias("layer_norm"),
    )


@query(f"WITH {FRAMES}, r AS (SELECT event_id, {_RANKS.format(g='token', x='round(value, 0)')} AS a, {_RANKS.format(g='token', x='key')} AS b FROM f) SELECT event_id, round((a + b) / 2, 3) AS blend FROM r")
def w1_rank_blend(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("x", F.round("value", 0))
    return ranks.rank_sum(f, ["x", "key"], ["token"]).select("event_id", F.round("blend", 3).alias("blend"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN round(p_size / 10, 1)::DOUBLE END AS alpha, CASE WHEN p_size % 3 = 0 THEN round(-p_size / 7, 4)::DOUBLE END AS value FROM part")
def f18_grid_best(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    t = F.when(n % 3 == 0, F.format_string("**Grid-best α = %.1f → %+.4f**", n / 10, F.round(-n / 7, 4))).otherwise("—")
    return load(spark, d, "part").select("p_partkey", text.grid_best(t).alias("g")).select("p_partkey", "g.alpha", "g.value")


@query("""WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT id AS i, v AS w FROM p WHERE id = 0)
    SELECT id, round(list_distance(v, w), 6) AS dist, round(pow(list_distance(v, w), 2), 6) AS sq, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM p, q""")
def f16_distances(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles("embedding").alias("v"))
    q = p.where("id = 0").select(F.col("v").alias("w"))
    sq = vec.sqdist("v", "w")
    return p.join(F.broadcast(q), how="cross").select("id", F.round(F.sqrt(sq), 6).alias("dist"), F.round(sq, 6).alias("sq"), F.round(vec.norm("v"), 6).alias("norm"))  # one row
