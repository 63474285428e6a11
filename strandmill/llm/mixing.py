"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.functions.keys import name
from strandmill.session import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A source is cut into so many slices of its shuffled order for the running sums.
SLICES = 1024


@lru_cache(maxsize=2)
def _encoding(table: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): the size of every document in tokens; source in normal form, null text 0.

    The vocabulary is read here, by the driver, and broadcast: its size is that of a public file, whatever the data's.
    """
    with open(vocabulary, "rb") as f:
        table = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(table.value)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    d = documents.select(F.col("doc_id").cast("bigint"), name("source").alias("source"), "text")
    return d.mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def _supply(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, n_docs, size, longest, share, max_repeats, budget): what each source has and what is wanted of it."""
    have = sizes.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("size"), F.max("tokens").alias("longest"))
    have = Scratch(sizes.sparkSession).write(have, "sources")  # read twice: the documents are tokenized once
    want = (
        targets.select(name("source").alias("source"), "share", "max_repeats")
        .where("source IS NOT NULL AND share IS NOT NULL")
        .groupBy("source")
        .agg(F.max(F.struct("share", "max_repeats")).alias("t"))
        .select("source", "t.share", F.coalesce("t.max_repeats", F.lit(1)).alias("max_repeats"))
    )
    total = have.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    return have.join(want, "source", "full").join(F.broadcast(total), how="cross")  # one row


def _running(d: DataFrame, seed: int) -> DataFrame:
    """`d` (doc_id, source, tokens, ...) with run: the running sum of a source's tokens in its shuffled order.

    The sum is taken in SLICES slices of that order, so no source is sorted in one task.
    """
    h = F.xxhash64(F.lit(seed), "doc_id")
    d = d.withColumn("h", h).withColumn("slice", F.floor((F.col("h") / 2.0**63 + 1) / 2 * SLICES).cast("int"))
    sums = d.groupBy("source", "slice").agg(F.sum("tokens").alias("s"))
    before = sums.select("source", "slice", (F.sum("s").over(W.partitionBy("source").orderBy("slice")) - F.col("s")).alias("before"))
    inner = F.sum("tokens").over(W.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("run", inner).join(before, ["source", "slice"]).withColumn("run", F.col("run") + F.col("before"))


def queue_report(sizes: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """What each source can do: one row for each source of `sizes` (doc_id, source, tokens) or `targets`.

    (source, n_docs, size, share, max_repeats, lap, budget, state).  lap is the virtual finish time of
    the source's last document on its first pass, size / share.  The queue stops at the budget, the
    tokens of all documents with a source; a source whose first lap reaches it is `sampled`
    (share * total / size <= 1), one that reaches it within max_repeats laps `repeated`, else `short`;
    `untargeted` has no target, `absent` no documents.  Both come from the queue of `mix`: the
    running sums of the shuffled documents and their virtual finish times.  `sizes` is read more than once.

    Cases: a null source or null share is left out (no target); repeated targets of a source count
    once, with the greatest share; documents without tokens make a source with a positive share
    `short`; a share of 0 makes it `sampled`; a null max_repeats is 1.
    """
    both = Scratch(sizes.sparkSession).write(_supply(sizes, targets), "supply")
    live = both.where("n_docs IS NOT NULL AND share > 0").select("source", "share")  # one row a source of the targets table
    queue = _running(sizes.join(F.broadcast(live), "source"), seed).withColumn("finish", F.col("run") / F.col("share"))
    ends = queue.groupBy("source").agg(F.max("finish").alias("lap"), F.max("run").alias("last"))
    # the queue's stop against the last finish time, multiplied out as the required result has it
    q = F.when(F.col("last") > 0, F.col("share") * F.col("budget") / F.col("last"))
    state = (
        F.when(F.col("n_docs").isNull(), "absent")
        .when(F.col("share").isNull(), "untargeted")
        .when((F.col("share") <= 0) | (q <= 1), "sampled")
        .when(q <= F.col("max_repeats"), "repeated")
        .otherwise("short")
    )
    out = both.join(ends, "source", "left")
    return out.select("source", "n_docs", "size", "longest", "share", "max_repeats", "lap", "budget", state.alias("state"))


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, copy, tokens, finish): the documents taken, in the order of `finish`.

    `budget` is in tokens; None is what the sources can give of their shares of all tokens, so that a
    source is repeated as its state says and none makes up for one that is short.

    Each source's documents are shuffled by a seeded hash; a document's virtual finish time is the
    running sum of its source's tokens, laps before it included, divided by the source's share.
    Those with the least finish are taken while their tokens stay within the budget.  Ties go by
    source, document and copy.  A document row is used at most max_repeats times.

    The queue's total up to a time t is known from the sources' sizes to within one document
    of each source, so only the rows of that margin are sorted globally.
    """
    scratch = Scratch(sizes.sparkSession)
    plan = [r.asDict() for r in _supply(sizes, targets).where("share IS NOT NULL").collect()]  # one row a source of the targets
    live = [p for p in plan if p["size"] and p["share"] and p["share"] > 0 and p["max_repeats"] > 0]
    if not live:
        return sizes.select("doc_id", "source", F.lit(0).alias("copy"), "tokens", F.lit(0.0).alias("finish")).limit(0)

    def reached(t: float) -> float:
        return sum(min(p["share"] * t, p["max_repeats"] * p["size"]) for p in live)

    if budget is None:
        budget = int(reached(live[0]["budget"]))

    def when(tokens: float) -> float:
        """The time at which the queue, cut at any token, has given so many."""
        ends = sorted(p["max_repeats"] * p["size"] / p["share"] for p in live)
        if reached(ends[-1]) <= tokens:
            return float("inf")
        t0 = max([0.0, *(e for e in ends if reached(e) <= tokens)])
        rate = sum(p["share"] for p in live if p["max_repeats"] * p["size"] / p["share"] > t0)
        return t0 + (tokens - reached(t0)) / rate

    sure, last = when(budget) * (1 - 1e-12), when(budget + sum(p["longest"] for p in live)) * (1 + 1e-12)
    spark = sizes.sparkSession
    facts = spark.createDataFrame([(p["source"], float(p["share"]), int(p["max_repeats"]), int(p["size"])) for p in live], "source string, share double, max_repeats int, size bigint")
    d = _running(sizes.join(F.broadcast(facts), "source"), seed)  # one row a source of the targets table
    laps = F.sequence(F.lit(0), F.col("max_repeats") - 1)
    d = d.select("doc_id", "source", "tokens", "run", "share", "size", F.explode(laps).alias("copy"))
    d = d.withColumn("finish", (F.col("run") + F.col("copy") * F.col("size")) / F.col("share"))
    d = scratch.write(d.where(F.col("finish") <= last).select("doc_id", "source", "copy", "tokens", "finish"), "queue")
    early = d.where(F.col("finish") <= sure)
    used = early.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    late = d.where(F.col("finish") > sure).withColumn("all", F.sum("tokens").over(W.orderBy("finish", "source", "doc_id", "copy").rowsBetween(W.unboundedPreceding, 0)))
    return early.unionByName(late.where(F.col("all") + used <= budget).drop("all"))


def shares(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """The report with the tokens, the share and the repeats that each source reached in the mix."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("taken"), (F.max("copy") + 1).alias("repeats"))
    total = F.sum(F.coalesce("taken", F.lit(0))).over(W.partitionBy())  # one row a source
    out = report.join(got, "source", "left")
    reached: Column = F.coalesce("taken", F.lit(0)) / F.when(total > 0, total)
    return out.select("source", "state", "n_docs", "size", "share", "max_repeats", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("repeats", F.lit(0)).alias("repeats"), reached.alias("share_reached"))
