"""Statistics of tokens: histograms, use of a codebook, votes over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import vec


def histogram(tokens: DataFrame, size: int, token: str = "token") -> DataFrame:
    """(token, n, p): counts of the codes 0 to size - 1, zeros included; other values and nulls don't count."""
    codes = tokens.sparkSession.range(size).select(F.col("id").alias("token"))
    n = tokens.select(F.col(token).cast("bigint").alias("token")).where(F.col("token").between(0, size - 1)).groupBy("token").agg(F.count("*").alias("n"))
    out = codes.join(F.broadcast(n), "token", "left").select("token", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))  # at most `size` rows
    total = F.sum("n").over(W.partitionBy())
    return out.select("token", "n", F.try_divide(F.col("n"), total).alias("p"))


def codebook_use(tokens: DataFrame, sizes: DataFrame, level: str = "level", token: str = "token") -> DataFrame:
    """(level, n, n_unique, utilization, perplexity): one row a level of `sizes` (level, m).

    utilization is distinct / m, perplexity exp(-sum p ln p); a level without tokens has 0 and null.
    """
    per = tokens.where(F.col(token).isNotNull()).groupBy(F.col(level).alias("level"), token).agg(F.count("*").alias("c"))
    by = per.groupBy("level").agg(F.sum("c").alias("n"), F.count("*").alias("n_unique"), F.sum(F.col("c") * F.ln("c")).alias("cl"))
    out = sizes.join(F.broadcast(by), "level", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    u = F.coalesce("n_unique", F.lit(0).cast("bigint"))
    return out.select("level", n.alias("n"), u.alias("n_unique"), (u / F.col("m")).alias("utilization"), F.exp(F.ln("n") - F.col("cl") / F.col("n")).alias("perplexity"))


def effective_bits(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.sum(F.log2("m")).alias("bits"))


def plurality_vote(frames: DataFrame, codebook: DataFrame, key: str = "key", token: str = "token") -> DataFrame:
    """(key, token, voted): the token most frames agree on.

    A token wins with at least two frames and more than any other; else the code nearest to the mean of
    the frames' code vectors does, the first of equal ones (voted false).  The mean comes from the counts
    of each token, so the frames themselves are shuffled once.
    """
    from strandmill.operators.quantize import nearest_code

    c = frames.where(F.col(token).isNotNull()).groupBy(F.col(key).alias("key"), F.col(token).cast("bigint").alias("token")).agg(F.count("*").alias("n"))
    w = W.partitionBy("key")
    c = c.withColumn("top", F.max("n").over(w)).withColumn("ties", F.count_if(F.col("n") == F.col("top")).over(w))
    won = (F.col("top") >= 2) & (F.col("ties") == 1)
    sure = c.where(won & (F.col("n") == F.col("top"))).select("key", "token", F.lit(True).alias("voted"))
    book = codebook.select(F.col("code").cast("bigint").alias("token"), vec.doubles("vec").alias("vec"))
    open_ = c.where(~won).join(F.broadcast(book), "token").select("key", "n", F.posexplode("vec").alias("pos", "x"))
    mean = open_.groupBy("key", "pos").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    mean = mean.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vec"))
    near = nearest_code(mean, codebook, id="key").select(F.col("id").alias("key"), F.col("code").alias("token"), F.lit(False).alias("voted"))
    return sure.unionByName(near)


def frame_histogram(frames: DataFrame, size: int, key: str = "key", token: str = "token") -> DataFrame:
    """(key, hist): for each key the share of its frames with each of the codes 0 to size - 1."""
    c = frames.where(F.col(token).isNotNull()).groupBy(F.col(key).alias("key"), F.col(token).cast("int").alias("token")).agg(F.count("*").alias("n"))
    by = c.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("m"), F.sum("n").alias("all"))
    return by.select("key", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("all")).alias("hist"))


def profile(hist: DataFrame, codebook: DataFrame) -> DataFrame:
    """(key, profile): each share before its code's vector, in one array."""
    book = codebook.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", vec.doubles("vec").alias("v")))), lambda e: e["v"]).alias("vs"))
    return hist.join(F.broadcast(book), how="cross").select("key", vec.interleave("hist", "vs").alias("profile"))  # one row


def array_diff(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """(n_left, n_right, n_both, n_diff, first_diffs): two keyed token tables compared position by position."""
    a, b = left.select(key, F.col("token").alias("a")), right.select(key, F.col("token").alias("b"))
    j = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full")
    differ = (F.col("l") == 1) & (F.col("r") == 1) & ~F.col("a").eqNullSafe(F.col("b"))
    counts = j.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count_if(F.coalesce(differ, F.lit(False))).alias("n_diff"))
    first = j.where(differ).orderBy(key).limit(5).agg(F.array_sort(F.collect_list(key)).alias("first_diffs"))
    return counts.join(first, how="cross")  # one row each


def masked_pool(residues: DataFrame, key: str = "key", vector: str = "vec", mask: str = "mask") -> DataFrame:
    """(key, pooled): mean then maximum over the unmasked residues, by dimension; all masked gives zeros."""
    x = residues.select(F.col(key).alias("key"), F.col(mask).alias("m"), F.posexplode(vec.doubles(vector)).alias("pos", "x"))
    live = F.when(F.col("m"), F.col("x"))
    d = x.groupBy("key", "pos").agg(F.coalesce(F.avg(live), F.lit(0.0)).alias("mean"), F.coalesce(F.max(live), F.lit(0.0)).alias("top"))
    both = F.array_sort(F.collect_list(F.struct("pos", "mean", "top")))
    return d.groupBy("key").agg(F.concat(F.transform(both, lambda e: e["mean"]), F.transform(both, lambda e: e["top"])).alias("pooled"))
