"""Label spaces, frequent labels, and buckets of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.ranks import numbered


def class_space(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, idx): the distinct labels in order, numbered from 0.

    Labels of any kind in their own order (strings by code point); nulls are left out.  They are
    numbered within ranges of the order, so they are never sorted in one task.
    """
    d = labels.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct()
    return numbered(d, ["label"])


def top_labels(labels: DataFrame, k: int, label: str, order: str, place: str) -> DataFrame:
    """(label, n): the k most frequent labels; of equally frequent ones those first seen by (order, place)."""
    c = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(F.struct(order, place)).alias("first"))
    return c.orderBy(F.desc("n"), "first").limit(k).select("label", "n")


def split_buckets(items: DataFrame, splits: DataFrame, key: str = "pid") -> DataFrame:
    """`items` with one bucket each: train before val before test where a split lists one in several."""
    order = F.create_map(F.lit("train"), F.lit(0), F.lit("val"), F.lit(1), F.lit("test"), F.lit(2))
    s = splits.select(key, "bucket", F.try_element_at(order, F.col("bucket")).alias("p")).where("p IS NOT NULL")
    s = s.groupBy(key).agg(F.min(F.struct("p", "bucket")).alias("b")).select(key, F.col("b.bucket").alias("bucket"))
    return items.join(s, key)


def with_positive_label(items: DataFrame, labels: DataFrame, kept: DataFrame, key: str = "pid") -> DataFrame:
    """`items` that carry at least one of the kept labels."""
    return items.join(labels.join(kept.select("label"), "label", "left_semi").select(key).distinct(), key, "left_semi")


def round_robin(jobs: DataFrame, n: int, i: int, order: str) -> DataFrame:
    """Every n-th job from the i-th on: every job has a number of its own, equal ones by their other columns."""
    rest = [f.name for f in jobs.schema.fields if f.name != order and f.dataType.typeName() not in ("map", "variant")]
    return numbered(jobs, [order, *rest], "_idx").where(F.pmod("_idx", F.lit(n)) == i).drop("_idx")
