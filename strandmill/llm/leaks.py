"""Passages of held-out texts inside documents, by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.packed import inside, mix
from strandmill.session import Scratch

SPAN = 13
#: Spans of fewer words are found only whole.
LEAST = 8
#: Bits of the filters of the held-out words and of their spans; both are of this size whatever the data's.
WORD_BITS, SPAN_BITS = 22, 26
#: The words' numbers that a task keeps at hand.
CACHE = 1_000_000


class _Words:
    """Words of texts, and a 64-bit number for each."""

    def __init__(self):
        import regex

        self.pattern, self.number = regex.compile(r"[\p{L}\p{N}]+"), {}

    def of(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words in a row, their numbers, and where each text ends."""
        import xxhash

        if len(self.number) > CACHE:
            self.number.clear()
        words: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                words.extend(self.pattern.findall(t.lower()))
            ends.append(len(words))
        number = self.number
        for w in set(words).difference(number):
            number[w] = xxhash.xxh64_intdigest(w)
        return words, np.fromiter(map(number.__getitem__, words), np.uint64, len(words)), np.array(ends, np.int64)


def _masks(span: int, most_differing: int) -> list[list[int]]:
    """The positions that each mask keeps; whichever `most_differing` positions differ, some mask ignores them all.

    Positions are dealt in turn to most_differing + 2 groups and a mask keeps two of them: the words
    replaced lie in at most most_differing groups, so two groups are whole.
    """
    if span < LEAST:
        return [list(range(span))]
    groups = most_differing + 2
    return [[p for p in range(span) if p % groups in two] for two in combinations(range(groups), 2)]


def _hash(ids: np.ndarray, at: np.ndarray, kept: list[int], span: int) -> np.ndarray:
    """A hash of the kept words of the spans from `at`, of the mask and of the span's length."""
    salt = hash((span, *kept)) & 0xFFFFFFFFFFFFFFFF
    h = np.full(len(at), np.uint64(salt), np.uint64)
    for p in kept:
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[at + p]
        h ^= h >> np.uint64(29)
    return mix(h)


def _bit(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _in(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits of a packed bit set are on."""
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _spans(span: int, most_differing: int):
    """item_id, text -> h, n, item_id, words: the spans of the items under every mask, each once for an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _Words()
        for b in batches:
            words, ids, ends = words_of.of(b.column(1).to_pylist())
            lens = np.diff(ends)
            for n in np.unique(np.minimum(lens, span)):
                if not n:
                    continue
                ok = lens >= span if n == span else lens == n
                at = np.flatnonzero(inside(ends, int(n)))
                doc = np.searchsorted(ends, at, side="right") - 1
                at, doc = at[ok[doc]], doc[ok[doc]]
                text = [" ".join(words[i : i + n]) for i in at]
                once = list(dict(zip(zip(doc.tolist(), text), range(len(at)))).values())  # a repeated span counts once
                at, doc, text = at[once], doc[once], [text[i] for i in once]
                for mask in _masks(int(n), most_differing):
                    h = _hash(ids, at, mask, int(n)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(at), n, np.int32)), b.column(0).take(pa.array(doc)), pa.array(text, pa.string())], names=["h", "n", "item_id", "words"])

    return run


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, words -> block, bits: which words and which hashes there are, as bit sets in blocks of equal size."""
    words_of, span, word = _Words(), np.zeros(1 << SPAN_BITS, bool), np.zeros(1 << WORD_BITS, bool)
    for b in batches:
        span[_bit(b.column(0).to_numpy().view(np.uint64), SPAN_BITS)] = True
        word[_bit(words_of.of(b.column(1).to_pylist())[1], WORD_BITS)] = True
    size = 1 << WORD_BITS
    blocks = [(i, span[i * size : (i + 1) * size]) for i in range(len(span) // size)] + [(-1, word)]
    blocks = [(i, x) for i, x in blocks if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([np.packbits(x).tobytes() for _, x in blocks], pa.binary())], names=["block", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(v, np.uint8)
            total[i] = total[i] | x if i in total else x
    for i, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "bits"])


def _candidates(filters: Broadcast, spans: list[int], most_differing: int):
    """doc_id, text -> h, n, doc_id, at, run, words: the spans that the filters let pass, under each mask that finds them.

    Their words follow once for each run of words that such spans cover, in rows without h; run is its first word's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _Words()
        span, word = (np.frombuffer(x, np.uint8) for x in filters.value)
        for b in batches:
            words, ids, ends = words_of.of(b.column(1).to_pylist())
            known = _in(word, _bit(ids, WORD_BITS))
            found = []
            for n in spans:
                whole = inside(ends, n)
                if not len(whole):
                    continue
                for mask in _masks(n, most_differing):
                    ok = whole.copy()
                    for p in mask:
                        ok &= known[p : p + len(ok)]
                    at = np.flatnonzero(ok)
                    h = _hash(ids, at, mask, n).view(np.int64)
                    hit = _in(span, _bit(h.view(np.uint64), SPAN_BITS))
                    found.append(np.stack([h[hit], at[hit], np.full(int(hit.sum()), n)], 1))
            x = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            if not len(x):
                continue
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, x[:, 1], 1)
            np.add.at(change, x[:, 1] + x[:, 2], -1)
            covered = np.cumsum(change[:-1]) > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            edge = ends[:-1][ends[:-1] < len(words)]
            begins[edge] = covered[edge]
            first = np.flatnonzero(begins)
            length = np.add.reduceat(covered, first) if len(first) else first
            mine = first[np.searchsorted(first, x[:, 1], side="right") - 1]
            start = np.concatenate([x[:, 1], first])
            doc = np.searchsorted(ends, start, side="right") - 1
            ints = lambda v: pa.array(v.astype(np.int32))
            none = np.zeros(len(first), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(x[:, 0], first), mask=np.append(np.zeros(len(x), bool), ~none)),
                    ints(np.append(x[:, 2], none)),
                    b.column(0).take(pa.array(doc)),
                    ints(start - ends[doc]),
                    ints(np.append(mine, first) - ends[doc]),
                    pa.array([None] * len(x) + [" ".join(words[i : i + m]) for i, m in zip(first, length)], pa.string()),
                ],
                names=["h", "n", "doc_id", "at", "run", "words"],
            )

    return run


def leaked(documents: DataFrame, items: DataFrame, span: int = SPAN, most_differing: int = 2) -> DataFrame:
    """(doc_id, item_id, differing, first_word, span, n_spots): documents that hold a passage of an item.

    A passage is `span` consecutive words of the item, or all words of a shorter one, with at most
    `most_differing` words replaced (none in spans under 8 words).  differing is the least
    number replaced over all such spots, first_word the first such spot, n_spots how many word positions
    begin one.  differing = 0 are the exact passages: any mask finds each of them.  Nothing within
    these limits is missed: the masks together ignore every choice of most_differing positions.

    Words are runs of letters and digits of the lower-cased text.  Cases: null and empty texts hold
    and are no passages; texts are searched whole at any length; repeated documents and items count
    once; null ids are left out; empty tables give no rows; further columns are ignored.

    Masks ignore some word positions each, so that replaced words leave the hash of another mask
    equal.  The items' spans are a table of hashes; two bit sets of fixed size, of their words and of their hashes, are
    broadcast, every document is read once, and only the hashes of the spans that both let pass are shuffled to meet the
    items' under the same hash.  Each meeting is verified word by word.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, differing int, first_word int, span int, n_spots bigint"
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    table = Scratch(spark).write(held.mapInArrow(_spans(span, most_differing), "h bigint, n int, item_id bigint, words string").distinct(), "spans")
    spans = sorted(r[0] for r in table.select("n").distinct().collect())  # at most `span` of them
    if not spans:
        return spark.createDataFrame([], schema)
    blocks = table.select("h", "words").mapInArrow(_filters, "block int, bits binary").repartition("block").mapInArrow(_united, "block int, bits binary")
    size = (1 << WORD_BITS) // 8
    bits = {r[0]: bytes(r[1]) for r in blocks.collect()}  # of fixed size
    whole = b"".join(bits.get(i, bytes(size)) for i in range(1 << (SPAN_BITS - WORD_BITS)))
    filters = spark.sparkContext.broadcast((whole, bits[-1]))
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = d.mapInArrow(_candidates(filters, spans, most_differing), "h bigint, n int, doc_id bigint, at int, run int, words string")
    found = Scratch(spark).write(found, "candidates")
    met = found.where("h IS NOT NULL").select("h", "n", "doc_id", "at", "run").hint("merge").join(table.withColumnRenamed("words", "theirs"), ["h", "n"])
    met = met.select("doc_id", "run", "at", "n", "item_id", "theirs").distinct()  # several masks find most of them
    texts = found.where("h IS NULL").select("doc_id", "run", F.split("words", " ").alias("words")).distinct()
    met = met.join(texts, ["doc_id", "run"]).withColumn("mine", F.slice("words", F.col("at") - F.col("run") + 1, F.col("n")))
    differing = F.size(F.filter(F.zip_with("mine", F.split("theirs", " "), lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    met = met.select("doc_id", "item_id", "at", "n", differing.alias("differing"))
    met = met.where(F.col("differing") <= F.when(F.col("n") >= LEAST, most_differing).otherwise(0))
    spots = met.groupBy("doc_id", "item_id", "at").agg(F.min(F.struct("differing", F.col("at").alias("first_word"), F.col("n").alias("span"))).alias("b"))
    best = spots.groupBy("doc_id", "item_id").agg(F.min("b").alias("b"), F.count("*").alias("n_spots"))
    return best.select("doc_id", "item_id", "b.differing", "b.first_word", "b.span", "n_spots")
