"""Long exact stretches that several records share, by content-defined cut points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.functions.keys import key, letters
from strandmill.llm.packed import document, gear, minima, mix, pack, pack_column, unpack, windows
from strandmill.session import Scratch

#: field: (length of a shared window, elements hashed at a cut point)
WINDOWS = {"seq": (30, 8), "tokens": (20, 8)}
#: So many elements are hashed at once in a task.
CHUNK = 2_000_000


def elements(backbones: DataFrame, tokens: DataFrame) -> DataFrame:
    """(field, tag, level, pid, packed): every row's sequence letters or token values as packed integers.

    Rows that are shorter than the field's window, null, or without a pid can share nothing and are left out.
    """
    text = backbones.select(key("pid").alias("pid"), letters("seq").alias("seq")).where((F.length("seq") >= WINDOWS["seq"][0]) & F.col("pid").isNotNull())

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pack(np.frombuffer(s.encode("utf-32-le"), "<i4").astype(np.int64)) for s in b.column(1).to_pylist()]
            n = len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(["seq"] * n), pa.array([""] * n), pa.array([-1] * n, pa.int32()), b.column(0), pa.array(packed, pa.binary())], names=["field", "tag", "level", "pid", "packed"])

    schema = "field string, tag string, level int, pid string, packed binary"
    arrays = tokens.where(F.size("tokens") >= WINDOWS["tokens"][0]).select(F.lit("tokens").alias("field"), "tag", "level", key("pid").alias("pid"), F.col("tokens").alias("packed")).where("pid IS NOT NULL")
    return text.mapInArrow(letters_of, schema).unionByName(arrays.mapInArrow(pack_column("packed"), schema))


def _chunks(batches: Iterator[pa.RecordBatch], field: int, packed: int):
    """(field, rows of the batch, values in a row, ends) in chunks of one field and at most CHUNK elements or one row."""
    for b in batches:
        names, datas = b.column(field).to_pylist(), b.column(packed).to_pylist()
        at = 0
        while at < len(names):
            end, n = at, 0
            while end < len(names) and names[end] == names[at] and (n < CHUNK or end == at):
                n += len(datas[end])
                end += 1
            arrays = [unpack(x) for x in datas[at:end]]
            yield names[at], b.slice(at, end - at), np.concatenate(arrays), np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
            at = end


def _combined(digest: np.ndarray, doc: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-aggregation before the shuffle: columns k, doc, pos, done.

    A digest that several documents of this chunk have is decided here: its rows go on under a key of
    their own (so a hot digest spreads over all tasks), and only two markers, for the least and the
    greatest of its documents (pos -1), stay under the digest to tell the other chunks.
    """
    order = np.argsort(digest)
    d, o = digest[order], doc[order]
    starts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    low, high = np.minimum.reduceat(o, starts), np.maximum.reduceat(o, starts)
    several = low < high
    decided = np.zeros(len(digest), bool)
    decided[order] = np.repeat(several, np.diff(np.append(starts, len(d))))
    spread = mix(doc.view(np.uint64) * np.uint64(31) + where.view(np.uint64)).view(np.int64)
    told = d[starts[several]]
    none = np.full(2 * len(told), -1, np.int64)
    return (
        np.concatenate([np.where(decided, spread, digest), told, told]),
        np.concatenate([doc, low[several], high[several]]),
        np.concatenate([where, none]),
        np.concatenate([decided, none > 0]),
    )


def _salt(field: str, tag: list, level: list) -> np.ndarray:
    """A number for each row's (field, tag, level), mixed into its digests."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"{field}\0{t}\0{v}") for t, v in zip(tag, level)], np.uint64)


def _cut_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """field, tag, level, doc, packed -> k, doc, pos: the cut points; -2 - pos if decided."""
    for field, b, values, ends in _chunks(batches, 0, 4):
        span, k = WINDOWS[field]
        h = gear(values, k)
        _, at = minima(h, ends, k, span - k + 1)
        if not len(at):
            continue
        keep = np.ones(len(at), bool)
        keep[1:] = at[1:] != at[:-1]
        at = at[keep]
        row = document(ends, at)
        digest = mix(h[at] ^ _salt(field, b.column(1).to_pylist(), b.column(2).to_pylist())[row]).view(np.int64)
        key_, doc, where, done = _combined(digest, b.column(3).to_numpy()[row], at - ends[row])
        yield pa.RecordBatch.from_arrays([pa.array(key_), pa.array(doc), pa.array(np.where(done, -2 - where, where).astype(np.int32))], names=["k", "doc", "pos"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """field, tag, level, doc, packed, at -> k, doc, pos: the windows whose cut point another document may share; -2 - pos if decided."""
    for field, b, values, ends in _chunks(batches, 0, 4):
        span, k = WINDOWS[field]
        h = gear(values, k)
        start, at = minima(h, ends, k, span - k + 1)
        points, cuts = b.column(5).values.to_numpy(), b.column(5).offsets.to_numpy()
        points = points[cuts[0] : cuts[-1]].astype(np.int64) + np.repeat(ends[:-1], np.diff(cuts))
        wanted = np.zeros(len(values) + 1, bool)
        wanted[points[(points >= 0) & (points < len(values))]] = True
        start = start[wanted[at]]
        if not len(start):
            continue
        row = document(ends, start)
        digest = mix(windows(values, start, span) ^ _salt(field, b.column(1).to_pylist(), b.column(2).to_pylist())[row]).view(np.int64)
        doc = b.column(3).to_numpy()[row]
        where = start - ends[row]
        key_, doc, where, done = _combined(digest, doc, where)
        yield pa.RecordBatch.from_arrays([pa.array(key_), pa.array(doc), pa.array(np.where(done, -2 - where, where).astype(np.int32))], names=["k", "doc", "pos"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """field, tag, level, pid, starts -> one row for each maximal stretch of windows that overlap or touch."""
    for b in batches:
        cols = b.column(4)
        values, cuts = cols.values.to_numpy(), cols.offsets.to_numpy()
        rows, lo, hi = [], [], []
        for i, field in enumerate(b.column(0).to_pylist()):
            s = np.unique(values[cuts[i] : cuts[i + 1]])
            span = WINDOWS[field][0]
            new = np.flatnonzero(np.diff(s) > span)
            rows += [i] * (len(new) + 1)
            lo += s[np.append(0, new + 1)].tolist()
            hi += (s[np.append(new, len(s) - 1)] + span).tolist()
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(4)], pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["field", "tag", "level", "pid", "span_start", "span_end"])


def shared_spans(backbones: DataFrame, tokens: DataFrame) -> DataFrame:
    """(field, tag, level, pid, span_start, span_end): the maximal stretches covered by shared windows.

    A window (WINDOWS: 30 letters, 20 values) is shared when another pid has it verbatim, tokens within the
    same tag and level.  Windows that overlap or touch are joined; spans are 0-based, [start, end).
    Of several rows of a pid the longest counts, of equally long ones the greatest.

    Cases: null, empty and short rows and null pids share nothing; null elements of an array equal each
    other; a window repeated within one pid only is not shared; equal rows of two pids are shared
    whole; sequences and arrays are used whole, at any length; empty tables give no rows; further
    columns are ignored.

    Cut points are the least gear hashes of every window (content-defined, so they move with an
    insertion), and each window has exactly one.  Stage 1 deduplicates the digests at the cut points,
    about one for 8 to 11 elements; stage 2 takes only the windows whose cut point several documents
    have, and deduplicates digests of the whole windows.  Digests that several documents of one chunk
    have are decided before the shuffle, so a hot digest reaches its task with two rows of each chunk.
    """
    rows = elements(backbones, tokens)
    doc = F.xxhash64("field", "tag", "level", "pid").alias("doc")
    keyed = rows.select("field", "tag", "level", doc, "packed")
    w = W.partitionBy("k")
    several = (F.col("pos") < -1) | (F.min("doc").over(w) < F.max("doc").over(w))
    place = F.when(F.col("pos") < 0, -2 - F.col("pos")).otherwise(F.col("pos"))
    marks = keyed.mapInArrow(_cut_points, "k bigint, doc bigint, pos int").withColumn("shared", several).where("shared AND pos <> -1")
    points = Scratch(backbones.sparkSession).write(marks.select("doc", place.alias("p")).groupBy("doc").agg(F.collect_set("p").alias("at")), "points")
    # one shuffle of the texts serves both the choice of a pid's row and the join with its points
    parted = rows.select("field", "tag", "level", "pid", doc, "packed").repartition("doc")
    best = parted.groupBy("doc", "field", "tag", "level", "pid").agg(F.max(F.struct(F.length("packed").alias("n"), "packed")).alias("x"))
    wanted = best.select("doc", "field", "tag", "level", "x.packed").join(points, "doc")
    found = wanted.select("field", "tag", "level", "doc", "packed", "at").mapInArrow(_windows, "k bigint, doc bigint, pos int")
    found = found.withColumn("shared", several).where("shared AND pos <> -1").select("doc", place.alias("pos"))
    starts = found.groupBy("doc").agg(F.collect_list("pos").alias("starts"))
    ids = backbones.select(F.lit("seq").alias("field"), F.lit("").alias("tag"), F.lit(-1).alias("level"), key("pid").alias("pid"))
    ids = ids.unionByName(tokens.select(F.lit("tokens").alias("field"), "tag", "level", key("pid").alias("pid")))
    named = ids.where("pid IS NOT NULL").distinct().withColumn("doc", F.xxhash64("field", "tag", "level", "pid"))
    out = named.join(starts, "doc").select("field", "tag", "level", "pid", "starts")
    return out.mapInArrow(_stretches, "field string, tag string, level int, pid string, span_start int, span_end int")


def shared_share(spans: DataFrame, backbones: DataFrame, tokens: DataFrame) -> DataFrame:
    """(field, tag, level, pid, length, shared, share): how much of each record other records share, 0 included.

    Records too short for a window are included; a share of an empty record is null.
    """
    seqs = backbones.select(F.lit("seq").alias("field"), F.lit("").alias("tag"), F.lit(-1).alias("level"), key("pid").alias("pid"), F.length(letters("seq")).alias("length"))
    toks = tokens.where("tokens IS NOT NULL").select(F.lit("tokens").alias("field"), "tag", "level", key("pid").alias("pid"), F.size("tokens").alias("length"))
    every = seqs.unionByName(toks).where("pid IS NOT NULL AND length IS NOT NULL").groupBy("field", "tag", "level", "pid").agg(F.max("length").alias("length"))
    got = spans.groupBy("field", "tag", "level", "pid").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    n = F.coalesce("shared", F.lit(0))
    return every.join(got, ["field", "tag", "level", "pid"], "left").select("field", "tag", "level", "pid", "length", n.cast("bigint").alias("shared"), F.when(F.col("length") > 0, n / F.col("length")).alias("share"))
