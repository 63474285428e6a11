"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.session import Scratch


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, lead) for every node of `edges(a, b)`: lead is the smallest node it is connected to.

    Alternates the large-star and small-star contractions until no edge changes; a graph of n
    nodes takes O(log^2 n) rounds.  Minima are taken by aggregation with map-side combine and
    joined back, so a node that holds a third of all edges is split by the adaptive skew join
    instead of landing in one task.  Each round is a table in the shared folder.
    Nulls and self-loops are dropped; repeated edges count once; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    a, b = F.col("a"), F.col("b")
    kind = edges.schema["a"].dataType
    cur = scratch.write(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        both = cur.select("a", "b").union(cur.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a is hung below a's minimum
        large = cur.select(b.alias("a"), a.alias("v")).join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).where(a != b)
        # small star: a and its smaller neighbours are hung below the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(a, F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where(a != b)
            .distinct()
        )
        nxt = scratch.write(small, "edges")
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        scratch.drop(cur)
        cur, seen = nxt, (row[0], row[1])
        if seen == mark or row[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leads = cur.select(b.alias("node"), b.alias("lead")).distinct()
    out = cur.select(a.alias("node"), b.alias("lead")).union(leads)
    return out.select(F.col("node").cast(kind), F.col("lead").cast(kind))
