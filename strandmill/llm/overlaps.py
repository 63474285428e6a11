"""The same or nearly the same record on both sides of a split, by winnowing fingerprints."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.keys import key, letters
from strandmill.llm.grouping import listings
from strandmill.llm.packed import document, gear, minima, mix
from strandmill.session import Scratch

#: (shortest length, letters of a seed, seeds in a window) of a tier: a window is k + w - 1 letters, so short
#: that a tenth of the letters edited leaves at least one window of any longer sequence unedited.
TIERS = ((0, 2, 1), (12, 4, 2), (44, 6, 3), (130, 7, 2))
#: Frequencies of seeds are counted in 2 ** BUCKETS cells; the table is of this size whatever the data's.
BUCKETS = 20
#: Two sides of a split, as bits of one mask.
SIDE = 31
#: So many letters of pairs are compared at once in a task.
CHUNK = 400_000


def sequences(backbones: DataFrame) -> DataFrame:
    """(pid, seq): one cleaned, non-empty sequence for each pid, the longest, of equally long ones the greatest."""
    s = backbones.select(key("pid").alias("pid"), letters("seq").alias("seq")).where("pid IS NOT NULL AND seq <> ''")
    return s.groupBy("pid").agg(F.max(F.struct(F.length("seq").alias("n"), "seq")).alias("x")).select("pid", "x.seq")


def _limit(n: np.ndarray, least: float) -> np.ndarray:
    """The most edits of a pair whose longer sequence has n letters."""
    return np.floor(n * (1 - least) + 1e-9).astype(np.int64)


def _tier(n: np.ndarray) -> np.ndarray:
    return np.searchsorted([t[0] for t in TIERS], n, side="right") - 1


def _spare(n: int, span: int, least: float) -> int:
    """So many windows of a sequence of n letters may be left out: every similar partner shares more."""
    longer = np.arange(n, int(n / least + 1e-9) + 1)
    return max(0, int((longer - span + 1 - span * _limit(longer, least)).min()) - 1)


def _letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = column.to_pylist()
    codes = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(np.int64)
    return codes, np.concatenate(([0], np.cumsum([len(t) for t in text], dtype=np.int64)))


def _grams(codes: np.ndarray, ends: np.ndarray, least: float) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(tier, k, w, rows of the tier, hashes): a sequence is in the tier of its length and in that of its shortest partner."""
    lens = np.diff(ends)
    own, low = _tier(lens), _tier(np.ceil(lens * least - 1e-9))
    for t, (_, k, w) in enumerate(TIERS):
        mine = (own == t) | (low == t)
        if mine.any() and len(codes) >= k:
            yield t, k, w, mine, gear(codes, k)


def _frequencies(least: float):
    """seq -> block, counts: how often the seeds of each cell occur in the task, in blocks of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKETS, np.int64)
        for b in batches:
            codes, ends = _letters_of(b.column(0))
            for _, k, w, mine, h in _grams(codes, ends, least):
                at = np.arange(len(h))
                row = document(ends, at)
                at = at[mine[row] & (at + k <= ends[row + 1])]
                n += np.bincount((h[at] >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=len(n))
        if n.any():
            blocks = n.reshape(64, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "n"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, counts sorted by block -> block, the logarithms of the sums in one byte a cell."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(v, np.int64)
            total[i] = total[i] + x if i in total else x
    for i, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.log2(x + 1.0).astype(np.uint8).tobytes()], pa.binary())], names=["block", "n"])


def seed_ranks(seqs: DataFrame, least: float) -> np.ndarray:
    """One byte for each of 2 ** BUCKETS cells: the logarithm of the number of seeds in it, over all sequences."""
    part = seqs.select("seq").mapInArrow(_frequencies(least), "block int, n binary")
    got = part.repartition("block").mapInArrow(_summed, "block int, n binary").collect()  # 64 rows of 16 KB
    out = np.zeros((64, (1 << BUCKETS) // 64), np.uint8)
    for r in got:
        out[r[0]] = np.frombuffer(bytes(r[1]), np.uint8)
    return out.ravel()


def _seeds(rank: np.ndarray, least: float):
    """sid, seq, mask -> k, sid, spot, mask: a sequence's seeds; spot holds the position and the length.

    A window's seed is the least of its hashes, rare cells first, so equal windows have equal seeds.  A
    sequence leaves out its windows with the greatest seeds, as many as every similar partner shares beyond
    one (_spare): the least shared seed is then kept on both sides.  So a seed that very many
    sequences have is a sequence's only where nearly all of it is made of such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, ends = _letters_of(b.column(1))
            lens = np.diff(ends)
            for t, k, w, mine, h in _grams(codes, ends, least):
                order = (rank[(h >> np.uint64(64 - BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                # minima() compares the upper 36 bits: the rank and 28 bits of the hash, ties to the left
                start, at = minima(order, ends, k, w)
                row = document(ends, start)
                use = mine[row]
                at, row = at[use], row[use]
                if not len(at):
                    continue
                value = order[at] >> np.uint64(28)
                by = np.lexsort((value, row))
                n = np.bincount(row, minlength=len(lens))
                spare = {int(x): _spare(int(x), k + w - 1, least) for x in np.unique(lens[mine])}
                left = np.array([spare.get(int(x), 0) for x in lens], np.int64)
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                last = first + np.maximum(n - left, 1) - 1
                cut = np.zeros(len(lens), np.uint64)
                some = n > 0
                cut[some] = value[by[last[some]]]
                keep = value <= cut[row]  # all of a kept value, so that equal seeds stay together
                at, row = at[keep], row[keep]
                fresh = np.ones(len(at), bool)
                fresh[1:] = at[1:] != at[:-1]
                at, row = at[fresh], row[fresh]
                spot = ((at - ends[row]) << 32) | lens[row]
                take = pa.array(row)
                key_ = mix(h[at] ^ mix(np.full(1, t + 1, np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key_), b.column(0).take(take), pa.array(spot), b.column(2).take(take)], names=["k", "sid", "spot", "mask"])

    return run


def _anchors(a: np.ndarray, b: np.ndarray, most: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Rows pair, start in a, start in b, length: the maximal equal stretches of k letters and more, shifted by `most` at most.

    a and b are padded with numbers that equal nothing.
    """
    for d in range(-int(most.max()), int(most.max()) + 1):
        lo, hi = max(0, -d), min(a.shape[1], b.shape[1] - d)
        rows = np.flatnonzero(most >= abs(d))
        if hi - lo < k or not len(rows):
            continue
        x = np.zeros((len(rows), hi - lo + 2), bool)
        x[:, 1:-1] = a[rows, lo:hi] == b[rows, lo + d : hi + d]
        flips = np.flatnonzero(x[:, 1:] != x[:, :-1])
        pair, at = np.divmod(flips, x.shape[1] - 1)
        n = at[1::2] - at[0::2]
        long = n >= k
        s = at[0::2][long] + lo
        yield np.stack([rows[pair[0::2][long]], s, s + d, n[long]], 1)


def chained(anchors: np.ndarray) -> list[tuple[int, int, int]]:
    """The collinear anchors (start, start, length) with the most letters: both starts go up and no two overlap.

    Starts and ends are swept along the first sequence; a frontier of the best chains by their end in the second
    one answers each start by bisection.
    """
    n = len(anchors)
    best, before = [0] * n, [-1] * n
    x, y, m = (anchors[:, i].tolist() for i in range(3))
    events = sorted([(x[i], 1, i) for i in range(n)] + [(x[i] + m[i], 0, i) for i in range(n)])
    ends: list[int] = []  # ends in the second sequence, ascending, with ever better chains
    held: list[int] = []
    for _, opens, i in events:
        if opens:
            j = bisect_left(ends, y[i] + 1) - 1
            before[i] = held[j] if j >= 0 else -1
            best[i] = m[i] + (best[held[j]] if j >= 0 else 0)
        else:
            e = y[i] + m[i]
            j = bisect_left(ends, e + 1)
            if j and best[held[j - 1]] >= best[i]:
                continue
            if j and ends[j - 1] == e:
                j -= 1
            to = j
            while to < len(ends) and best[held[to]] <= best[i]:
                to += 1
            ends[j:to], held[j:to] = [e], [i]
    out, i = [], max(range(n), key=best.__getitem__) if n else -1
    while i >= 0:
        out.append((x[i], y[i], m[i]))
        i = before[i]
    return out[::-1]


def _extended(a: str, b: str, chain: list[tuple[int, int, int]]) -> int:
    """Edits that surely turn a into b: the gaps of the chain are replaced letter by letter, or whole where their lengths differ."""
    edits, i, j = 0, 0, 0
    for x, y, m in [*chain, (len(a), len(b), 0)]:
        s, t = a[i:x], b[j:y]
        edits += sum(map(str.__ne__, s, t)) if len(s) == len(t) else max(len(s), len(t))
        i, j = x + m, y + m
    return edits


def _words(spans: list[tuple[int, int]], n: int) -> list[int]:
    bits = 0
    for s, m in spans:
        bits |= ((1 << m) - 1) << s
    return np.frombuffer(bits.to_bytes(-(-n // 64) * 8, "little"), np.int64).tolist()


def _compared(least: float):
    """a, b, n_seeds, s, t -> the pairs that may be similar, with their most edits and the letters that the chain covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = b.column(3).to_pylist(), b.column(4).to_pylist()
            n, m = np.array([len(v) for v in s], np.int64), np.array([len(v) for v in t], np.int64)
            most, tier = _limit(m, least), _tier(n)
            keep, edits, left, right = [], [], [], []
            order = np.lexsort((m, tier))
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and tier[order[end]] == tier[order[at]] and (end - at + 1) * m[order[end]] <= CHUNK:
                    end += 1
                own = order[at:end]
                at = end
                k = TIERS[tier[own[0]]][1]
                x = np.full((len(own), int(n[own].max())), 0xFFFFFFFF, np.uint32)
                y = np.full((len(own), int(m[own].max())), 0xFFFFFFFE, np.uint32)
                for i, r in enumerate(own):
                    x[i, : n[r]] = np.frombuffer(s[r].encode("utf-32-le"), "<u4")
                    y[i, : m[r]] = np.frombuffer(t[r].encode("utf-32-le"), "<u4")
                found = np.concatenate([np.empty((0, 4), np.int64), *_anchors(x, y, most[own], k)])
                found = found[np.lexsort((found[:, 1], found[:, 0]))]
                # an edit breaks k seeds at most, so a similar pair has so many of them left
                have = np.bincount(found[:, 0], weights=found[:, 3] - k + 1, minlength=len(own))
                cuts = np.searchsorted(found[:, 0], np.arange(len(own) + 1))
                for i in np.flatnonzero(have >= m[own] - k + 1 - k * most[own]):
                    r = own[i]
                    chain = chained(found[cuts[i] : cuts[i + 1], 1:])
                    keep.append(r)
                    edits.append(min(int(most[r]), _extended(s[r], t[r], chain)))
                    left.append(_words([(p, z) for p, _, z in chain], int(n[r])))
                    right.append(_words([(q, z) for _, q, z in chain], int(m[r])))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(take) for i in range(5)], pa.array(edits, pa.int32()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                names=["a", "b", "n_seeds", "s", "t", "most", "covered_a", "covered_b"],
            )

    return run


def near_pairs(seqs: DataFrame, least: float = 0.9) -> DataFrame:
    """(a, b, n_seeds, edits, similarity, covered_a, covered_b): pairs of distinct sequences of similarity `least` and more.

    `seqs` is (sid BIGINT, seq, mask BIGINT), each distinct sequence once, with the splits that list it
    in train in the lower bits and those that list it for evaluation SIDE bits higher; only pairs that
    some split may have on both sides are sought.  a is the shorter, of equally long ones the
    one with the smaller sid.  similarity is 1 - edits / longer length, edits the Levenshtein distance.
    covered_a and covered_b are bit sets, 64 letters in a number: the letters in the anchors of the chain.

    1. Every similar pair shares a window without an edit (TIERS), and so its seed, at positions
       that differ by the edits at most.  Seeds are ordered by how rare they are, so the seeds
       of frequent stretches are left out wherever that loses no pair (see _seeds).
    2. Pairs with such a seed are compared: equal stretches of a seed's length and more become anchors, too few
       of them end the comparison, and the best collinear chain is extended over its gaps, which
       bounds the edits from above.
    3. The pair is aligned within that bound, which gives the exact distance.

    The joins are merge joins, hinted since nothing is known of the size of what Python returns.
    """
    if least < 0.9:
        raise ValueError("the seeds are dense enough for similarities of 0.9 and more")
    rank = seed_ranks(seqs, least)
    seeds = seqs.select("sid", "seq", "mask").mapInArrow(_seeds(rank, least), "k bigint, sid bigint, spot bigint, mask bigint")
    n, n2 = (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") for c in ("x.spot", "y.spot"))
    at, at2 = (F.shiftright(c, 32).cast("int") for c in ("x.spot", "y.spot"))
    most = F.floor(n2 * (1 - least) + 1e-9)
    sides = F.lit((1 << SIDE) - 1)
    across = F.col("x.mask").bitwiseAND(F.shiftright("y.mask", SIDE)).bitwiseOR(F.shiftright("x.mask", SIDE).bitwiseAND(F.col("y.mask"))).bitwiseAND(sides)
    ok = ((n < n2) | ((n == n2) & (F.col("x.sid") < F.col("y.sid")))) & (n2 - n <= most) & (F.abs(at - at2) <= most) & (across != 0)
    # aliases only, so that both sides are one plan and the seeds are computed and shuffled once
    pairs = seeds.alias("x").hint("merge").join(seeds.alias("y").hint("merge"), F.col("x.k") == F.col("y.k")).where(ok)
    pairs = pairs.groupBy(F.col("x.sid").alias("sid"), F.col("y.sid").alias("sid2")).agg(F.count("*").alias("n_seeds"))
    s, t = (seqs.select(F.col("sid").alias(i), F.col("seq").alias(c)) for i, c in (("sid", "s"), ("sid2", "t")))
    pairs = pairs.hint("merge").join(s, "sid").hint("merge").join(t, "sid2").select("sid", "sid2", "n_seeds", "s", "t")
    schema = "a bigint, b bigint, n_seeds bigint, s string, t string, most int, covered_a array<bigint>, covered_b array<bigint>"
    out = pairs.mapInArrow(_compared(least), schema).withColumn("edits", F.expr("levenshtein(s, t, most)")).where("edits >= 0")
    return out.select("a", "b", "n_seeds", "edits", (1 - F.col("edits") / F.length("t")).alias("similarity"), "covered_a", "covered_b")


def _near(backbones: DataFrame, splits: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split_name, pid, train) of the known pids, (pid, sid, n) of those with a sequence, and the similar pairs of sids in both directions."""
    scratch = Scratch(backbones.sparkSession)
    side = listings(splits).where(F.col("bucket").isin("train", "val", "test")).select("split_name", "pid", (F.col("bucket") == "train").alias("train")).distinct()
    known = backbones.select(key("pid").alias("pid")).where("pid IS NOT NULL").distinct()
    side = scratch.write(side.join(known, "pid", "left_semi"), "sides")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(F.xxhash64("split_name"), F.lit(SIDE)) + F.when(F.col("train"), 0).otherwise(SIDE)).cast("int"))
    masks = side.withColumn("mask", bit).groupBy("pid").agg(F.bit_or("mask").alias("mask"))
    members = scratch.write(sequences(backbones).join(masks, "pid").select("pid", "seq", "mask"), "members")
    # numbered once and written, so every reader sees the same numbers
    classes = members.groupBy("seq").agg(F.bit_or("mask").alias("mask")).select(F.monotonically_increasing_id().alias("sid"), "seq", "mask")
    classes = scratch.write(classes, "classes")
    members = scratch.write(members.join(classes.select("seq", "sid"), "seq").select("pid", "sid", F.length("seq").alias("n")), "numbered")
    near = near_pairs(classes, least).select("a", "b", "similarity", "covered_a", "covered_b")
    every = F.lit(-1).cast("bigint")
    whole = F.transform(F.sequence(F.lit(1), F.ceil(F.length("seq") / 64)), lambda i: F.when(i * 64 <= F.length("seq"), every).otherwise(F.call_function("shiftrightunsigned", every, (i * 64 - F.length("seq")).cast("int"))))
    same = classes.select(F.col("sid").alias("a"), F.col("sid").alias("b"), F.lit(1.0).alias("similarity"), whole.alias("covered_a"), whole.alias("covered_b"))
    near = scratch.write(near.unionByName(same), "near")
    back = near.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", F.col("covered_b").alias("covered_a"), F.col("covered_a").alias("covered_b"))
    return side, members, near.unionByName(back)


def cross_split(backbones: DataFrame, splits: DataFrame, least: float = 0.9) -> DataFrame:
    """(split_name, pid_a, pid_b, similarity): records of one split on both sides, the same or nearly so.

    One pid is listed in train and the other in val or test of the split; pid_a < pid_b.  A pid of
    `backbones` listed on both sides is a case with itself, similarity 1, whatever its sequence.

    Cases: pids that `backbones` lacks are left out; null and empty sequences are similar to none; rows and
    listings that repeat count once; equal sequences of several pids are compared once, as one class, and
    their pids are paired from the classes at the end, as the required result names pairs of pids;
    sequences are compared whole; empty tables give no rows; further columns are ignored.
    """
    side, members, near = _near(backbones, splits, least)
    both = side.groupBy("split_name", "pid").agg(F.min("train").alias("lo"), F.max("train").alias("hi")).where("NOT lo AND hi")
    selfs = both.select("split_name", F.col("pid").alias("pid_a"), F.col("pid").alias("pid_b"), F.lit(1.0).alias("similarity"))
    who = members.select("pid", "sid").join(side, "pid")
    t = who.where("train").select(F.col("sid").alias("a"), "split_name", F.col("pid").alias("p"))
    e = who.where("NOT train").select(F.col("sid").alias("b"), "split_name", F.col("pid").alias("q"))
    pairs = near.select("a", "b", "similarity").join(t, "a").join(e, ["b", "split_name"]).where("p <> q")
    pairs = pairs.select("split_name", F.least("p", "q").alias("pid_a"), F.greatest("p", "q").alias("pid_b"), "similarity")
    return pairs.unionByName(selfs).groupBy("split_name", "pid_a", "pid_b").agg(F.max("similarity").alias("similarity"))


def _datasets(backbones: DataFrame) -> DataFrame:
    """(pid, dataset): the greatest of a pid's datasets, in lower case; null if it has none."""
    named = backbones.select(key("pid").alias("pid"), F.lower(F.trim("dataset")).alias("dataset")).where("pid IS NOT NULL")
    return named.groupBy("pid").agg(F.max("dataset").alias("dataset"))


def overlap_counts(found: DataFrame, backbones: DataFrame) -> DataFrame:
    """(split_name, dataset, n_same, n_near): cases counted by split and the dataset of pid_a."""
    same = F.col("pid_a") == F.col("pid_b")
    sets = _datasets(backbones).withColumnRenamed("pid", "pid_a")
    return found.join(sets, "pid_a", "left").groupBy("split_name", "dataset").agg(F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_near"))


def coverage(backbones: DataFrame, splits: DataFrame, least: float = 0.9) -> DataFrame:
    """(split_name, pid, dataset, n_train, length, covered, share): how much of a val or test record train records of a dataset cover.

    One row for each listed record and each dataset of its similar train records: n_train of them, its own
    listing in train included, and the letters that lie in an anchor of the chain with any of them.
    Records without a sequence, and those without a similar train record, have no row; the other cases
    are those of cross_split.

    Train records of a class are counted before the join, and the letters are united as bit sets,
    64 letters in a row, so no group of partners is gathered.
    """
    side, members, near = _near(backbones, splits, least)
    who = members.join(side, "pid")
    t = who.where("train").join(_datasets(backbones), "pid").groupBy(F.col("sid").alias("a"), "split_name", "dataset").agg(F.count("*").alias("n_train"))
    e = who.where("NOT train").select(F.col("sid").alias("b"), "split_name", "pid", "n")
    hits = near.select("a", "b", F.col("covered_b").alias("covered")).join(t, "a").join(e, ["b", "split_name"])
    by = ["split_name", "pid", "dataset"]
    words = hits.select(*by, "n", "n_train", F.posexplode("covered").alias("i", "word")).groupBy(*by, "i").agg(F.bit_or("word").alias("word"), F.max("n").alias("n"), F.sum("n_train").alias("n_train"))
    out = words.groupBy(*by).agg(F.max("n_train").alias("n_train"), F.max("n").alias("length"), F.sum(F.bit_count("word")).alias("covered"))
    return out.select(*by, "n_train", "length", "covered", (F.col("covered") / F.col("length")).alias("share"))
