"""Probes on tokens and pooled features with the linear models of Spark ML.

They stand in for heads with published weights: the data they take and the scores they give are the same,
the model is linear.  Rows are split by a hash of their id, so the split does not hang on their order.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import ranks, stats


def _split(rows: DataFrame, id: str, held: float, seed: int) -> tuple[DataFrame, DataFrame]:
    u = F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1_000_000)) / 1e6
    return rows.where(u >= held), rows.where(u < held)


def regression(rows: DataFrame, features: str, label: str, id: str = "id", held: float = 0.2, seed: int = 0, ridge: float = 1e-3) -> DataFrame:
    """(id, label, prediction) of the held-out rows, by ridge regression on an array of numbers; null labels are left out."""
    d = rows.select(id, array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label")).dropna()
    train, test = _split(d, id, held, seed)
    return LinearRegression(regParam=ridge, solver="normal" if ridge else "auto").fit(train).transform(test).select(id, "label", "prediction")


def token_features(rows: DataFrame, token: str, size: int, around: str | None = None) -> DataFrame:
    """`rows` with the one-hot array of their token as features."""
    from strandmill.functions.vec import one_hot

    return rows.withColumn("features", one_hot(token, size))


def multilabel(rows: DataFrame, labels: DataFrame, features: str, classes: list[str], id: str = "id", held: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, cls, score, y) of the held-out rows: one logistic regression for each class (a bounded list).

    `labels` is (id, label).  A class without both kinds of training rows scores its share of positives.
    """
    d = rows.select(id, array_to_vector(F.col(features).cast("array<double>")).alias("features")).dropna()
    wide = labels.where(F.col("label").isin(classes)).groupBy(id).agg(F.collect_set("label").alias("_has"))
    d = d.join(wide, id, "left").select(id, "features", *[F.coalesce(F.array_contains("_has", c), F.lit(False)).cast("double").alias(f"_y{i}") for i, c in enumerate(classes)])
    train, test = _split(d, id, held, seed)
    shares = train.agg(*[F.avg(f"_y{i}").alias(f"s{i}") for i in range(len(classes))]).first()
    out = test
    for i in range(len(classes)):
        p = shares[i] or 0.0
        if 0 < p < 1:
            m = LogisticRegression(labelCol=f"_y{i}", maxIter=20, regParam=1e-3, predictionCol=f"_p{i}", probabilityCol=f"_q{i}", rawPredictionCol=f"_r{i}").fit(train)
            out = m.transform(out).withColumn(f"_s{i}", F.get(vector_to_array(f"_q{i}"), F.lit(1))).drop(f"_p{i}", f"_q{i}", f"_r{i}")
        else:
            out = out.withColumn(f"_s{i}", F.lit(p))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"_s{i}").alias("score"), F.col(f"_y{i}").cast("int").alias("y")) for i, c in enumerate(classes)])).alias("e")
    return out.select(id, each).select(id, "e.cls", "e.score", "e.y")


def multilabel_bundle(scored: DataFrame, id: str = "id") -> DataFrame:
    """(n_classes, n_items, macro_ap, micro_ap, macro_auroc, macro_f1, micro_f1, top1) of (id, cls, score, y).

    Classes without positives are dropped; if none is left, n_classes is 0 and the scores are NaN.
    """
    pos = scored.groupBy("cls").agg(F.sum("y").alias("p")).where("p > 0").select("cls")
    s = scored.join(F.broadcast(pos), "cls")  # one row a class
    n = s.agg(F.count_distinct("cls").alias("n_classes"), F.count_distinct(id).alias("n_items"))
    ap = ranks.average_precision(s, "score", "y", ["cls"]).agg(F.avg("ap").alias("macro_ap"))
    micro = ranks.average_precision(s, "score", "y").select(F.col("ap").alias("micro_ap"))
    roc = ranks.auroc(s, "score", "y", ["cls"]).agg(F.avg("auroc").alias("macro_auroc"))
    out = n
    for part in (ap, micro, roc, stats.f1(s, "score", "y", "cls"), stats.top1_hit(s, id, "score", "y", "cls")):
        out = out.join(part, F.lit(True), "left")  # one row each
    nan = lambda c: F.coalesce(F.when(F.col("n_classes") > 0, F.col(c)), F.lit(float("nan"))).alias(c)
    return out.select("n_classes", "n_items", *map(nan, ("macro_ap", "micro_ap", "macro_auroc", "macro_f1", "micro_f1", "top1")))
