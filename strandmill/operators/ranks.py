"""Rank statistics, with ties at their average, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.session import Scratch


def running(counts: DataFrame, group: list[str], value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """`counts` (one row a group and value) with before_<s>, the sum of each s over the values ranked earlier.

    The counts are parted by ranges of group and value and written once; the running sum within a
    range is added to the sums of the group's ranges before, so a group of any size is sorted in as many tasks as
    the shuffle has partitions.
    """
    ranged = counts.repartitionByRange(*group, value).withColumn("_slice", F.spark_partition_id())
    c = Scratch(counts.sparkSession).write(ranged, "ranges")
    order = F.desc if descending else F.asc
    per = c.groupBy(*group, "_slice").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    w = W.partitionBy(*group).orderBy(order("_slice"))  # one row a range
    per = per.select(*group, "_slice", *[(F.sum(f"_{s}").over(w) - F.col(f"_{s}")).alias(f"_off_{s}") for s in sums])
    inner = W.partitionBy(*group, "_slice").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    c = c.select("*", *[(F.sum(s).over(inner) - F.col(s)).alias(f"_in_{s}") for s in sums]).join(per, [*group, "_slice"])
    out = c.select("*", *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"before_{s}") for s in sums])
    return out.drop("_slice", *[f"_in_{s}" for s in sums], *[f"_off_{s}" for s in sums])


def numbered(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """`rows` with their place, from 0, in the order of the given columns; of equal rows any comes first.

    Rows are sorted within ranges and written once with their place in the range; the number of rows in
    the ranges before is added.  So no task sorts more than its range.
    """
    place = F.monotonically_increasing_id()  # the range's number in the upper bits, the place in it in the lower 33
    d = Scratch(rows.sparkSession).write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place), "numbered")
    d = d.withColumn("_range", F.shiftright("_at", 33))
    per = d.groupBy("_range").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before")  # one row a range
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(F.broadcast(per.select("_range", before)), "_range").withColumn(name, inside + F.col("_before")).drop("_range", "_at", "_before")


def average_ranks(rows: DataFrame, value: str, group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """`rows` with the rank of `value`, from 1, equal values at the average of their places."""
    group = group or []
    c = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    r = running(c, group, value, ["_n"]).select(*group, value, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(r, [*group, value], "left")


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(rows: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """(group..., n, rho): Pearson's r of the average ranks; rows with a null in x or y are left out."""
    group = group or []
    r = rows.select(*group, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(r, x, group, "_rx"), y, group, "_ry")
    return r.groupBy(*group).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))


def auroc(rows: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """(group..., n_pos, n_neg, auroc): by the rank sum of the positives; null without both classes."""
    group = group or []
    y = F.col(label).cast("int")
    c = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("_n"), F.sum(y).cast("bigint").alias("_p"))
    c = running(c, group, score, ["_n"])
    pos, neg = F.sum("_p"), F.sum("_n") - F.sum("_p")
    ranks = F.sum(F.col("_p") * (F.col("before__n") + (F.col("_n") + 1) / 2))
    return c.groupBy(*group).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.try_divide(ranks - pos * (pos + 1) / 2, pos * neg).alias("auroc"))


def average_precision(rows: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """(group..., n_pos, ap): sum of (recall step) x precision over the distinct scores, descending; null without positives."""
    group = group or []
    y = F.col(label).cast("int")
    c = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("_n"), F.sum(y).cast("bigint").alias("_p"))
    c = running(c, group, score, ["_n", "_p"], descending=True)
    gain = F.sum(F.col("_p") * (F.col("before__p") + F.col("_p")) / (F.col("before__n") + F.col("_n")))
    return c.groupBy(*group).agg(F.sum("_p").alias("n_pos"), F.try_divide(gain, F.sum("_p")).alias("ap"))


def zscores(rows: DataFrame, value: str, group: list[str], name: str = "z") -> DataFrame:
    """`rows` with (x - mean) / std within the group; population std, 1e-12 at least.

    The group's moments are aggregated and joined back, so a large group isn't gathered in one task.
    """
    m = rows.groupBy(*group).agg(F.avg(value).alias("_mu"), F.greatest(F.stddev_pop(value), F.lit(1e-12)).alias("_sd"))
    return rows.join(m, group).withColumn(name, (F.col(value) - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


def blend_ladder(rows: DataFrame, score: str, other: str, truth: str, group: list[str], alphas: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """(group..., alpha, rho): Spearman of a z(score) + (1 - a) z(other) with the truth, for every a."""
    d = rows.where(F.col(score).isNotNull() & F.col(other).isNotNull())
    moments = [f(c).alias(f"_{n}{i}") for i, c in enumerate((score, other)) for n, f in (("mu", F.avg), ("sd", F.stddev_pop))]
    m = d.groupBy(*group).agg(*moments)
    z = lambda i, c: ((F.col(c) - F.col(f"_mu{i}")) / F.greatest(f"_sd{i}", F.lit(1e-12))).alias("_za" if i == 0 else "_zb")
    z = d.where(F.col(truth).isNotNull()).join(m, group).select(*group, truth, z(0, score), z(1, other))
    z = Scratch(rows.sparkSession).write(z, "z")
    # the truth's ranks are the same for every a
    z = average_ranks(z, truth, group, "_rt").select(*group, "_za", "_zb", "_rt")
    ladder = z.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    ladder = ladder.select(*group, "alpha", "_rt", F.round(F.col("alpha") * F.col("_za") + (1 - F.col("alpha")) * F.col("_zb"), 9).alias("_mix"))
    # ranks of equal blends are equal, so rows are summed by blend before they are ranked
    m = ladder.groupBy(*group, "alpha", "_mix").agg(F.count("*").alias("_n"), F.sum("_rt").alias("_t"), F.sum(F.col("_rt") * F.col("_rt")).alias("_t2"))
    m = running(m, [*group, "alpha"], "_mix", ["_n"]).withColumn("_r", F.col("before__n") + (F.col("_n") + 1) / 2)
    n, x, y = F.sum("_n"), F.sum(F.col("_n") * F.col("_r")), F.sum("_t")
    xx, yy, xy = F.sum(F.col("_n") * F.col("_r") * F.col("_r")), F.sum("_t2"), F.sum(F.col("_r") * F.col("_t"))
    rho = F.try_divide(xy - x * y / n, F.sqrt(F.greatest(xx - x * x / n, F.lit(0.0))) * F.sqrt(F.greatest(yy - y * y / n, F.lit(0.0))))
    return m.groupBy(*group, "alpha").agg(rho.alias("rho"))


def rank_sum(rows: DataFrame, values: list[str], group: list[str], name: str = "blend") -> DataFrame:
    """`rows` with the mean of their average ranks under several scores, within the group; null if a score is null."""
    out = rows
    for i, v in enumerate(values):
        out = average_ranks(out, v, group, f"_rank{i}")
    total = sum((F.col(f"_rank{i}") for i in range(1, len(values))), F.col("_rank0"))
    return out.withColumn(name, total / len(values)).drop(*[f"_rank{i}" for i in range(len(values))])
