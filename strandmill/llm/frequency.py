"""How often every token occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.keys import key
from strandmill.llm.packed import NULL, pack_column, unpack
from strandmill.session import Scratch

#: Heavy values are looked for in so many records; the choice decides only where a value is counted.
SAMPLE = 2_000
#: A value is heavy from this share of the sampled values of its tag and level on: at most 1 / HEAVY of them.
HEAVY = 1 / 8192


def records(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """(tag, level, pid, n, packed): one row for each (tag, level, pid) with an array.

    Of repeated rows the longest array counts, of equally long ones the greatest by bytes.  pid is
    in normal form; a null pid is a pid of its own.
    """
    rows = tokens.where(F.col(column).isNotNull()).select("tag", "level", key("pid").alias("pid"), F.size(column).alias("n"), F.col(column).alias("packed"))
    schema = "tag string, level int, pid string, n int, packed binary"
    best = rows.mapInArrow(pack_column("packed"), schema).groupBy("tag", "level", "pid").agg(F.max(F.struct("n", "packed")).alias("x"))
    return best.select("tag", "level", "pid", "x.n", "x.packed")


def _count(heavy: dict[tuple, np.ndarray]):
    """mapInArrow: heavy values go into exact counters of the task, the others out, summed by batch."""
    schema = pa.schema([("tag", pa.string()), ("level", pa.int32()), ("token", pa.int64()), ("n_occ", pa.int64()), ("n_rec", pa.int64()), ("kind", pa.string())])

    def rows(tag, level, token, occ, rec, kind) -> pa.RecordBatch:
        n = len(token)
        return pa.RecordBatch.from_arrays(
            [pa.array([tag] * n, pa.string()), pa.array([level] * n, pa.int32()), pa.array(token, pa.int64()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64()), pa.array([kind] * n, pa.string())],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple, tuple] = {}
        seen: dict[tuple, int] = {}
        for b in batches:
            groups: dict[tuple, list[bytes]] = {}
            for tag, level, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                groups.setdefault((tag, level), []).append(data)
            for g, datas in groups.items():
                seen[g] = seen.get(g, 0) + len(datas)
                arrays = [unpack(x) for x in datas]
                values = np.concatenate(arrays)
                record = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
                keep = values != NULL
                values, record = values[keep], record[keep]
                if not len(values):
                    continue
                token, idx, occ = np.unique(values, return_inverse=True, return_counts=True)
                pairs = np.unique(idx * np.int64(len(arrays)) + record)
                rec = np.bincount(pairs // len(arrays), minlength=len(token))
                top = heavy.get(g, np.empty(0, np.int64))
                at = np.searchsorted(top, token)
                hit = at < len(top)
                hit[hit] = top[at[hit]] == token[hit]
                if hit.any():
                    c = counters.setdefault(g, (np.zeros(len(top), np.int64), np.zeros(len(top), np.int64)))
                    c[0][at[hit]] += occ[hit]
                    c[1][at[hit]] += rec[hit]
                if not hit.all():
                    yield rows(*g, token[~hit], occ[~hit], rec[~hit], "light")
        for g, (occ, rec) in counters.items():
            some = occ > 0
            yield rows(*g, heavy[g][some], occ[some], rec[some], "heavy")
        for g, n in seen.items():
            yield rows(*g, [0], [0], [n], "records")

    return run, "tag string, level int, token bigint, n_occ bigint, n_rec bigint, kind string"


def token_counts(tokens: DataFrame, sizes: DataFrame, rare: int = 3, common: float = 0.9, column: str = "tokens") -> DataFrame:
    """(tag, level, token, n_occ, n_rec, n_records, rare, common, invalid) for every value that occurs and every code.

    A record is a (tag, level, pid) whose array isn't null.  rare: a code (0 to m - 1) in fewer than
    `rare` records, none included; common: a code in more than `common` of the records of its tag
    and level; invalid: a value outside 0 to m - 1.

    Cases: null arrays are no records, null elements no values; an empty array is a record without
    values; repeated rows count once; values of a tag and level without a size get no mark; codes of a
    level without records are all rare; empty tables give no rows; further columns are ignored.

    Values found frequent in a bounded sample are broadcast (at most 1 / HEAVY for each tag and
    level) and counted in exact arrays of each task; only the others are shuffled one by one, summed by
    batch before; the two tables of counts have no value in common and are united.
    """
    scratch = Scratch(tokens.sparkSession)
    some = tokens.where(F.col(column).isNotNull()).select("tag", "level", F.col(column).alias("v"), F.xxhash64("tag", "level", "pid").alias("h")).orderBy("h").limit(SAMPLE)
    freq = some.select("tag", "level", F.explode("v").alias("token")).where("token IS NOT NULL").groupBy("tag", "level", "token").agg(F.count("*").alias("n"))
    found: dict[tuple, list[tuple[int, int]]] = {}
    total = freq.groupBy("tag", "level").agg(F.sum("n").alias("all"))
    for r in freq.join(total, ["tag", "level"]).where(F.col("n") >= F.col("all") * HEAVY).collect():
        found.setdefault((r["tag"], r["level"]), []).append(r["token"])
    heavy = {g: np.sort(np.array(v, np.int64)) for g, v in found.items()}
    run, schema = _count(heavy)
    parts = scratch.write(records(tokens, column).select("tag", "level", "packed").mapInArrow(run, schema), "counts")

    def summed(kind: str) -> DataFrame:
        return parts.where(F.col("kind") == kind).groupBy("tag", "level", "token").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_rec").alias("n_rec"))

    counts = summed("heavy").unionByName(summed("light"))
    n = parts.where("kind = 'records'").groupBy("tag", "level").agg(F.sum("n_rec").alias("n_records"))
    m = sizes.where("tag IS NOT NULL AND level IS NOT NULL").groupBy("tag", "level").agg(F.max("m").alias("m"))
    codes = m.where("m > 0").select("tag", "level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint") - 1)).alias("token"))
    every = counts.join(codes, ["tag", "level", "token"], "full")
    every = every.join(m, ["tag", "level"], "left").join(n, ["tag", "level"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    code = F.col("token").between(0, F.col("m") - 1)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return every.select("tag", "level", "token", "m", zero("n_occ"), zero("n_rec"), zero("n_records")).select(
        "tag", "level", "token", "n_occ", "n_rec", "n_records",
        flag(code & (F.col("n_rec") < rare)).alias("rare"),
        flag(code & (F.col("n_rec") > common * F.col("n_records"))).alias("common"),
        flag(~code & (F.col("n_occ") > 0)).alias("invalid"),
    )


def marked(counts: DataFrame) -> DataFrame:
    """(tag, level, token, mark): one row for each mark of a value."""
    marks = F.array_compact(F.array(*[F.when(F.col(x), x) for x in ("rare", "common", "invalid")]))
    return counts.select("tag", "level", "token", F.explode(marks).alias("mark"))
