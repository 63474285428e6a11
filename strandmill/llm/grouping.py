"""Groups of related records, and splits that keep each group together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.functions.keys import entity, key, letters, name
from strandmill.operators.graph import components
from strandmill.session import Scratch

RELATIONS = ("depositor", "study", "entity")
#: Groups of at least this share of all records are placed one by one; there are at most 1 / LARGE of them.
LARGE = 0.0005


def groups(backbones: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(pid, lead_pid) for every pid: lead_pid is the smallest pid of its group.

    Two pids are related when any of their rows agree in a relation, compared by letters and digits
    only and without case; a value without a digit names nothing.  Groups are connected sets; a pid
    without relatives is its own group.

    Cases: null and blank pids are left out; repeated rows count once; a value that only one pid has
    relates nothing; empty tables give no rows; further columns are ignored.

    Each value hangs its pids on the smallest one (a minimum with map-side combine), so a value that a third
    of all rows share costs one edge for each pid and never a pair of them.  Values of one pid
    make no edge.  Components are then taken over the pids.
    """
    scratch = Scratch(backbones.sparkSession)
    rel = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), entity(c).alias("value")) for i, c in enumerate(relations)])).alias("r")
    b = backbones.select(key("pid").alias("pid"), rel).where("pid IS NOT NULL AND r.value IS NOT NULL").select("pid", "r.kind", "r.value").distinct()
    b = scratch.write(b, "relations")
    low = b.groupBy("kind", "value").agg(F.min("pid").alias("lead"), F.max("pid").alias("other")).where("lead < other").drop("other")
    edges = b.join(low, ["kind", "value"]).select(F.col("pid").alias("a"), F.col("lead").alias("b"))
    found = components(edges).withColumnsRenamed({"node": "pid", "lead": "lead_pid"})
    every = backbones.select(key("pid").alias("pid")).where("pid IS NOT NULL").distinct()
    return every.join(found, "pid", "left").select("pid", F.coalesce("lead_pid", "pid").alias("lead_pid"))


def listings(splits: DataFrame) -> DataFrame:
    """(split_name, bucket, pid) in normal form, each once; rows with a null among them are left out."""
    return splits.select("split_name", name("bucket").alias("bucket"), key("pid").alias("pid")).dropna().distinct()


def broken(splits: DataFrame, grouped: DataFrame) -> DataFrame:
    """(split_name, pid, lead_pid): the listed pids of groups that a split lists in more than one bucket.

    Pids without a group (unknown to the groups' table) are left out.  The number of buckets is taken
    as a minimum and a maximum for each group, so a group of any size is one aggregated row.
    """
    listed = listings(splits).join(grouped, "pid")
    torn = listed.groupBy("split_name", "lead_pid").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo < hi").select("split_name", "lead_pid")
    return listed.join(torn, ["split_name", "lead_pid"], "left_semi").select("split_name", "pid", "lead_pid").distinct()


def label_vectors(backbones: DataFrame) -> DataFrame:
    """(pid, label): the strata of a pid: its dataset and the quarter-octave of its sequence's length."""
    n = F.length(letters("seq"))
    best = backbones.select(key("pid").alias("pid"), F.lower(F.trim("dataset")).alias("dataset"), n.alias("n")).where("pid IS NOT NULL")
    best = best.groupBy("pid").agg(F.max("dataset").alias("dataset"), F.max("n").alias("n"))
    size = F.when(F.coalesce("n", F.lit(0)) > 0, F.concat(F.lit("length:"), F.least(F.floor(F.log2("n") * 2), F.lit(24)).cast("string"))).otherwise("length:none")
    return best.select("pid", F.explode(F.array(F.concat(F.lit("dataset:"), F.coalesce("dataset", F.lit("none"))), size)).alias("label"))


def assign(pids: DataFrame, grouped: DataFrame, labels: DataFrame, targets: DataFrame, seed: int = 29) -> DataFrame:
    """(pid, lead_pid, bucket): every pid in one bucket, groups whole, buckets near the target shares.

    Grouped iterative stratification.  Label vectors are summed for each group.  Labels are taken from
    the rarest to the most common among the groups not yet placed; the groups that carry a label go, largest
    first, into the bucket that lacks most of it against its share.  Groups of at least LARGE of all
    records, at most 1 / LARGE of them, are placed one by one; the rest of a label's groups
    fill the buckets' outstanding amounts along the running sum of a seeded shuffle, which is taken in
    slices, so that no task holds all groups.

    Cases: a pid unknown to `grouped` is its own group; a pid without labels has the label `none`;
    null pids are left out; shares are scaled to sum to 1, null or negative ones are 0; ties go to the
    bucket first by name; no pids give no rows; no targets are an error.
    """
    scratch = Scratch(pids.sparkSession)
    goal = {r[0]: max(0.0, r[1] or 0.0) for r in targets.select(name("bucket").alias("b"), "share").where("b IS NOT NULL").collect()}  # one row a bucket
    if not goal or not sum(goal.values()):
        raise ValueError("split targets name no bucket with a share")
    goal = {b: s / sum(goal.values()) for b, s in sorted(goal.items())}
    mine = pids.select("pid").where("pid IS NOT NULL").distinct().join(grouped.select("pid", "lead_pid"), "pid", "left")
    mine = scratch.write(mine.select("pid", F.coalesce("lead_pid", "pid").alias("lead_pid")), "listed")
    carried = mine.join(labels.distinct(), "pid", "left").groupBy("lead_pid", F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))
    size = mine.groupBy("lead_pid").agg(F.count("*").alias("size"))
    vector = scratch.write(carried.groupBy("lead_pid").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("v")).join(size, "lead_pid"), "vectors")
    total, open_ = mine.count(), {}
    for r in vector.select(F.explode("v").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect():  # one row a label
        open_[r["label"]] = r["n"]
    if not total:
        return mine.withColumn("bucket", F.lit(None).cast("string"))
    lack = {(x, b): n * s for x, n in open_.items() for b, s in goal.items()}
    room = {b: total * s for b, s in goal.items()}
    placed: list[tuple[str, str]] = []

    def put(bucket: str, v: dict[str, int], n: int) -> None:
        for x, c in v.items():
            lack[x, bucket] -= c
        room[bucket] -= n

    large = [(r["v"], r["size"], r["lead_pid"]) for r in vector.where(F.col("size") >= max(2, LARGE * total)).collect()]
    left = {x: n for x, n in open_.items()}
    while large:
        here = {x for v, _, _ in large for x in v}
        x = min(here, key=lambda y: (left[y], y))
        batch = sorted((g for g in large if x in g[0]), key=lambda g: (-g[0][x], -g[1], g[2]))
        for v, n, lead in batch:
            bucket = max(goal, key=lambda b: (lack[x, b], room[b]))
            put(bucket, v, n)
            placed.append((lead, bucket))
            for y, c in v.items():
                left[y] -= c
        taken = {g[2] for g in batch}
        large = [g for g in large if g[2] not in taken]

    spark = pids.sparkSession
    fixed = spark.createDataFrame(placed, "lead_pid string, bucket string") if placed else spark.createDataFrame([], "lead_pid string, bucket string")
    rest = vector.join(F.broadcast(fixed.select("lead_pid")), "lead_pid", "left_anti")  # at most 1 / LARGE rows
    # the label by which a group is placed: its rarest
    order = sorted(left, key=lambda y: (left[y], y))
    rank = F.create_map(*[F.lit(z) for i, y in enumerate(order) for z in (y, i)])
    rest = rest.withColumn("by", F.array_min(F.transform(F.map_keys("v"), lambda y: rank[y])))
    rest = rest.withColumn("c", F.element_at("v", F.element_at(F.lit(order), F.col("by") + 1)))
    rest = rest.withColumn("h", F.xxhash64(F.lit(seed), "lead_pid")).withColumn("slice", F.pmod("h", F.lit(256)))
    rest = scratch.write(rest, "rest")
    sums = rest.groupBy("by", "slice").agg(F.sum("c").alias("s"))
    before = sums.select("by", "slice", (F.sum("s").over(W.partitionBy("by").orderBy("slice")) - F.col("s")).alias("before"))
    run = F.sum("c").over(W.partitionBy("by", "slice").orderBy(F.desc("c"), "h", "lead_pid").rowsBetween(W.unboundedPreceding, 0))
    amounts = {r["by"]: r["s"] for r in rest.groupBy("by").agg(F.sum("c").alias("s")).collect()}  # one row a label
    vectors = {(r["by"], r["label"]): r["n"] for r in rest.select("by", F.explode("v").alias("label", "n")).groupBy("by", "label").agg(F.sum("n").alias("n")).collect()}
    cuts = []
    for by in sorted(amounts):
        want = {b: max(0.0, lack[order[by], b]) for b in goal}
        if not sum(want.values()):
            want = dict(goal)
        part, at = {b: w / sum(want.values()) for b, w in want.items()}, 0.0
        for b, w in part.items():
            cuts.append((by, b, at * amounts[by], (at + w) * amounts[by] if b != list(part)[-1] else float("inf")))
            at += w
            for (y, x), n in vectors.items():
                if y == by:
                    lack[x, b] -= w * n
    small = fixed.limit(0)
    if cuts:
        table = spark.createDataFrame(cuts, "by int, bucket string, lo double, hi double")  # labels x buckets
        mid = rest.withColumn("run", run).join(before, ["by", "slice"]).withColumn("mid", F.col("run") + F.col("before") - F.col("c") / 2)
        small = mid.join(F.broadcast(table), (mid["by"] == table["by"]) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi"))).select("lead_pid", "bucket")
    return mine.join(fixed.unionByName(small), "lead_pid").select("pid", "lead_pid", "bucket")


def assignment_report(assigned: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(bucket, label, n, share, target, deviation): how near an assignment (pid, bucket) comes to the targets.

    One row for each bucket and label of the assigned pids, and one with a null label for the bucket as a
    whole; buckets without pids have n 0.  target is the bucket's share scaled to sum to 1, deviation share - target.
    """
    goal = targets.select(name("bucket").alias("bucket"), F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("s")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.max("s").alias("s"))
    goal = goal.join(F.broadcast(goal.agg(F.sum("s").alias("all"))), how="cross").select("bucket", (F.col("s") / F.col("all")).alias("target"))  # one row
    a = assigned.select("pid", "bucket").join(labels.distinct(), "pid", "left").select("pid", "bucket", F.coalesce("label", F.lit("none")).alias("label"))
    per = a.groupBy("bucket", "label").agg(F.count("*").alias("n")).unionByName(assigned.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("label", F.lit(None).cast("string")))
    total = per.groupBy("label").agg(F.sum("n").alias("all"))
    every = total.join(F.broadcast(goal), how="cross")  # labels x buckets
    have = per.select(F.col("bucket").alias("b"), F.col("label").alias("l"), F.col("n").alias("m"))
    out = every.join(have, F.col("label").eqNullSafe(F.col("l")) & (F.col("bucket") == F.col("b")), "left").select("bucket", "label", F.coalesce("m", F.lit(0)).alias("n"), "all", "target")
    return out.select("bucket", "label", "n", (F.col("n") / F.col("all")).alias("share"), "target", (F.col("n") / F.col("all") - F.col("target")).alias("deviation"))
