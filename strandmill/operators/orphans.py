"""References to records that are missing, deleted or not yet there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.keys import key
from strandmill.session import Scratch

#: A key and month is heavy from this share of all references on; there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.002
#: Heavy ones are broadcast up to so many versions in all; beyond, both sides are split over SALTS parts.
MAX_BROADCAST_VERSIONS = 100_000
SALTS = 64
ON = ["ref_field", "k", "period"]


def references(refs: DataFrame, fields: list[str], row_id: str = "row_id", at: str = "ran_at") -> DataFrame:
    """(row_id, ran_at, ref_field, k, period): every reference once, null and blank ones left out."""
    # rows are brought together by their id, so both distinct steps share one shuffle
    d = refs.select(F.col(row_id).alias("row_id"), F.col(at).alias("ran_at"), *[key(f).alias(f"_{i}") for i, f in enumerate(fields)]).repartition("row_id").distinct()
    flat = d.select("row_id", "ran_at", F.expr("stack({}, {}) AS (ref_field, k)".format(len(fields), ", ".join(f"'{f}', `_{i}`" for i, f in enumerate(fields)))))
    return flat.where("k IS NOT NULL").distinct().withColumn("period", F.date_format("ran_at", "yyyy-MM"))


def key_months(flat: DataFrame, fields: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(ref_field, k, period, n, state, first, open, versions): the references of a key and month, and what became of them.

    state is `missing`, `later` or `deleted` where that holds for all of them, `held` where none is dangling,
    and `mixed` where the key comes or goes between the first and the last of them; versions are then the
    key's versions that touch that time, first its earliest loaded_at (open: a version has none).
    The references are pre-aggregated, so a key that a third of all rows refer to is one row a month here.
    """
    versions = reduce(
        DataFrame.unionByName,
        [t.select(F.lit(f).alias("ref_field"), key(c).alias("k"), F.col("loaded_at").alias("on"), F.col("deleted_at").alias("off")) for f, (t, c) in fields.items()],
    ).where("k IS NOT NULL").distinct().withColumn("known", F.lit(True))
    loads = flat.groupBy(*ON).agg(F.count("*").alias("n"), F.min("ran_at").alias("lo"), F.max("ran_at").alias("hi"))
    on, off, lo, hi = F.col("on"), F.col("off"), F.col("lo"), F.col("hi")
    touches = (on <= hi) & (off.isNull() | (off > lo))
    no = lambda c: F.coalesce(c, F.lit(False))
    j = loads.join(versions, ["ref_field", "k"], "left")
    s = j.groupBy(*ON, "n", "lo", "hi").agg(
        F.bool_or(F.col("known")).alias("known"),
        F.bool_or(no((on <= lo) & (off.isNull() | (off > hi)))).alias("held"),
        F.bool_and(no(on > hi)).alias("later"),
        F.bool_or(no(on <= lo) | on.isNull()).alias("before"),
        F.collect_set(F.when(no(touches), F.struct("on", "off"))).alias("versions"),
        F.min("on").alias("first"),
        F.bool_or(on.isNull()).alias("open"),
    )
    state = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("lo").isNull(), "deleted")  # without a time nothing holds, and nothing is later
        .when(F.col("held"), "held")
        .when(F.col("later"), "later")
        .when((F.size("versions") == 0) & F.col("before"), "deleted")
        .otherwise("mixed")
    )
    return s.select(*ON, "n", state.alias("state"), "first", "open", F.when(state == "mixed", F.col("versions")).alias("versions"))


def _reason(at: Column) -> Column:
    alive = F.coalesce(F.exists("versions", lambda v: (v["on"] <= at) & (v["off"].isNull() | (v["off"] > at))), F.lit(False))
    later = F.coalesce(~F.col("open") & (F.col("first") > at), F.lit(False))
    return F.when(F.col("state") != "mixed", F.col("state")).when(alive, "held").when(later, "later").otherwise("deleted")


def _joined(flat: DataFrame, months: DataFrame) -> DataFrame:
    """`flat` with the states of its keys and months: heavy ones by broadcast or salted, the rest by a shuffle join."""
    total = months.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > max(1.0, HEAVY_SHARE * total)
    hot = months.where(heavy).drop("n")
    size = hot.agg(F.count("*") + F.coalesce(F.sum(F.coalesce(F.size("versions"), F.lit(0))), F.lit(0))).first()[0]
    if not size:
        return flat.join(months.drop("n"), ON)
    keys = F.broadcast(hot.select(*ON))  # at most 1 / HEAVY_SHARE rows
    rest = flat.join(keys, ON, "left_anti").join(months.where(~heavy).drop("n"), ON)
    if size <= MAX_BROADCAST_VERSIONS:
        return rest.unionByName(flat.join(F.broadcast(hot), ON))
    salted = flat.join(keys, ON, "left_semi").withColumn("salt", F.pmod(F.xxhash64("row_id", "ran_at"), F.lit(SALTS)).cast("int"))
    every = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rest.unionByName(salted.join(every, [*ON, "salt"]).drop("salt"))


def dangling(refs: DataFrame, fields: dict[str, tuple[DataFrame, str]], row_id: str = "row_id", at: str = "ran_at") -> DataFrame:
    """(row_id, ref_field, reason, period): references that were dangling when the row ran.

    `fields` maps a reference column of `refs` to (table, key column); the table has loaded_at and
    deleted_at.  A reference holds if some row of its key has loaded_at <= at and deleted_at null
    or > at.  Otherwise the reason is `missing` (no row has the key), `later` (all its rows have
    loaded_at > at) or `deleted`.  period is the month of `at` as yyyy-MM.

    Cases: null or blank references are no references; keys compare trimmed and without case;
    repeated rows give one row; a null `at` satisfies nothing, so a known key is `deleted` with a
    null period; a null loaded_at is never loaded and never later; empty tables make every
    reference `missing`; further columns are ignored.

    References are pre-aggregated per key and month, and the state of most keys and months is decided there
    (key_months).  The rows of the dangling and undecided ones are then looked up: the at most 1 / HEAVY_SHARE
    heavy ones by a broadcast of checked size, or salted beyond it, the others by one shuffle join.  The versions
    of one key that touch one month travel as one array.
    """
    scratch = Scratch(refs.sparkSession)
    flat = scratch.write(references(refs, list(fields), row_id, at), "references")
    months = scratch.write(key_months(flat, fields).where("state <> 'held'"), "months")
    none = F.lit("")  # months of null times meet too
    met = _joined(flat.withColumn("period", F.coalesce("period", none)), months.withColumn("period", F.coalesce("period", none)))
    out = met.select("row_id", "ref_field", _reason(F.col("ran_at")).alias("reason"), F.when(F.col("period") != "", F.col("period")).alias("period"))
    return out.where("reason <> 'held'").distinct()


def dangling_counts(refs: DataFrame, fields: dict[str, tuple[DataFrame, str]], tables: dict[str, str], row_id: str = "row_id", at: str = "ran_at") -> DataFrame:
    """(ref_table, period, reason, n_rows, n_total): dangling references per referred table and month, and all references of it.

    Counted from the pre-aggregate; only the references of keys that come or go within a month are
    looked up one by one.  The cases are those of `dangling`; a row with a reference in several spellings or
    times counts as several.
    """
    scratch = Scratch(refs.sparkSession)
    flat = scratch.write(references(refs, list(fields), row_id, at), "references")
    months = scratch.write(key_months(flat, fields), "months")
    name = F.create_map(*[F.lit(x) for pair in tables.items() for x in pair])[F.col("ref_field")].alias("ref_table")
    none = F.lit("")
    flat, months = (x.withColumn("period", F.coalesce("period", none)) for x in (flat, months))
    total = months.groupBy("ref_field", "period").agg(F.sum("n").alias("n_total"))
    sure = months.where("state NOT IN ('mixed', 'held')").groupBy("ref_field", "period", F.col("state").alias("reason")).agg(F.sum("n").alias("n"))
    mixed = _joined(flat, months.where("state = 'mixed'")).select("ref_field", "period", _reason(F.col("ran_at")).alias("reason")).where("reason <> 'held'")
    both = sure.unionByName(mixed.groupBy("ref_field", "period", "reason").agg(F.count("*").alias("n")))
    out = both.groupBy("ref_field", "period", "reason").agg(F.sum("n").alias("n_rows")).join(total, ["ref_field", "period"])
    return out.select(name, F.when(F.col("period") != "", F.col("period")).alias("period"), "reason", "n_rows", "n_total")
