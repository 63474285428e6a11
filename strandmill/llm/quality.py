"""Text statistics of every document, and the documents that are no natural prose."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n\u00a0"
#: Common words are tested in place up to so many; a longer list is joined.
MAX_IN_PLACE = 20_000
#: name: (least, most) of the statistics that tell prose from the rest; None is no limit.
RANGES = {"n_words": (20, None), "word_len": (3.4, 7.0), "common": (0.20, None), "symbols": (None, 0.12), "line_end": (0.50, None)}

#: Words of an n-gram, and the share of a text's word characters above which its dominant one is repetition.
NGRAM, DOMINANT = 3, 0.3


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _repeated(items: Column) -> Column:
    """Share of the items that repeat an earlier one."""
    return _ratio((F.size(items) - F.size(F.array_distinct(items))).cast("double"), F.size(items))


def _top_share(words: Column, n: int) -> Column:
    """top_share of ngram_coverage: runs in the sorted n-grams are counted, so a text costs one sort."""
    follow = lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)])
    grams = F.sort_array(F.transform(F.slice(words, 1, F.size(words) - (n - 1)), follow))

    def count(a: Column, g: Column) -> Column:
        run = F.when(g == a["g"], a["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(g.alias("g"), run.alias("run"), F.greatest(a["most"], run * (F.length(g) - (n - 1))).alias("most"))

    none = F.struct(F.lit("").alias("g"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("most"))
    most = F.aggregate(grams, none, count, lambda a: a["most"])
    return F.when(F.size(words) >= n, F.least(F.lit(1.0), most / F.length(F.array_join(words, ""))))


def text_stats(documents: DataFrame, common_words: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the statistics of its text; one row for each row of `documents`.

    n_words, word_len, common, symbols, line_end as in the project's statement of problem 9;
    dup_lines and dup_paragraphs, the shares of non-blank lines and paragraphs that repeat an
    earlier one of the same text; bullets, the share of lines that begin like a list item or a
    table row; top_share, the share of the word characters in the dominant n-gram of NGRAM words, null
    under NGRAM words; kind, the combined verdict: `boilerplate` (repetition), `list` (lines that don't end
    as sentences and mostly begin as items), `junk` (few words or symbols over the limit) or `prose`.

    Repetition is a share over 0.3 of repeated lines or of repeated paragraphs, or a top_share over
    DOMINANT in a text that has enough words, of natural length; with words out of the range of
    word_len, which are fragments rather than a phrase, it is `junk` unless its lines or paragraphs repeat.

    Cases: a null text has only nulls; a statistic without a denominator is null; blanks only give
    n_words 0 and null shares; texts are used whole, at any length; ties do not arise; an empty
    table gives no rows; further columns, whatever their names, are ignored.  All of it is a
    projection in the JVM: no shuffle, unless the list of common words is too long to test in place.
    """
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    low = F.lower("t")
    known = common_words.select(F.col("word").alias("w")).where("w IS NOT NULL").distinct()
    words = [r[0] for r in known.limit(MAX_IN_PLACE + 1).collect()]
    d = d.withColumn("words", F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    if len(words) <= MAX_IN_PLACE:
        d = d.withColumn("n_common", F.size(F.filter("words", lambda w: w.isin(words))) if words else F.when(F.col("t").isNotNull(), 0))
    else:
        # the number hangs on the text alone, so every distinct text is looked up once, under its digest
        d = d.withColumn("digest", F.sha2("t", 256))
        texts = d.where("t IS NOT NULL").dropDuplicates(["digest"]).select("digest", F.explode("words").alias("w")).groupBy("digest", "w").agg(F.count("*").alias("n"))
        hits = texts.join(known, "w").groupBy("digest").agg(F.sum("n").alias("n_common"))
        d = d.join(hits, "digest", "left").withColumn("n_common", F.when(F.col("t").isNotNull(), F.coalesce("n_common", F.lit(0)))).drop("digest")
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x, F.lit(BLANK))), lambda x: x != "")
    blank = r"[ \t\r\n\u00a0]"
    paragraphs = F.filter(F.transform(F.split("t", r"\n[ \t\r\u00a0]*\n"), lambda x: F.trim(x, F.lit(BLANK))), lambda x: x != "")
    ended = F.size(F.filter("lines", lambda x: F.right(x, F.lit(1)).isin(".", "!", "?")))
    items = F.size(F.filter("lines", lambda x: x.rlike(r"^([-*•|#>]|\(?\p{N}{1,3}[.)])")))
    n = F.col("n_words")
    out = (
        d.withColumn("n_words", F.when(F.col("t").isNotNull(), F.size("words")))
        .withColumn("lines", lines)
        .select(
            "doc_id",
            "n_words",
            _ratio(F.length(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")).cast("double"), n).alias("word_len"),
            _ratio(F.col("n_common").cast("double"), n).alias("common"),
            _ratio(F.length(F.regexp_replace("t", r"[\p{L}\p{N} \t\r\n\u00a0]+", "")).cast("double"), F.length(F.regexp_replace("t", blank + "+", ""))).alias("symbols"),
            _ratio(ended.cast("double"), F.size("lines")).alias("line_end"),
            _repeated(F.col("lines")).alias("dup_lines"),
            _repeated(paragraphs).alias("dup_paragraphs"),
            _ratio(items.cast("double"), F.size("lines")).alias("bullets"),
            _top_share(F.col("words"), NGRAM).alias("top_share"),
        )
    )
    bad = lambda s: F.coalesce(_outside(s), F.lit(False))
    dominant = (F.coalesce("top_share", F.lit(0.0)) > DOMINANT) & ~bad("n_words") & ~bad("word_len")
    kind = (
        F.when(F.col("n_words").isNull(), None)
        .when((F.coalesce("dup_lines", F.lit(0.0)) > 0.3) | (F.coalesce("dup_paragraphs", F.lit(0.0)) > 0.3) | dominant, "boilerplate")
        .when(bad("line_end") & (F.coalesce("bullets", F.lit(0.0)) > 0.3), "list")
        .when(bad("n_words") | bad("symbols") | bad("common") | bad("word_len"), "junk")
        .otherwise("prose")
    )
    return out.withColumn("kind", kind)


def _outside(stat: str) -> Column:
    least, most = RANGES[stat]
    c = F.col(stat)
    return (c < least if least is not None else F.lit(False)) | (c > most if most is not None else F.lit(False))


def not_prose(stats: DataFrame, at_least: int = 2) -> DataFrame:
    """(doc_id, stat): one row for each statistic out of its range, of documents with `at_least` of them.

    A null statistic is not out of range.  Repeated rows of a document are given once.
    """
    out = F.array_compact(F.array(*[F.when(_outside(s), s) for s in RANGES]))
    # bound in a lambda, so the statistics are not computed a second time for a filter
    many = F.flatten(F.transform(F.array(out), lambda o: F.when(F.size(o) >= at_least, o)))
    return stats.select("doc_id", F.explode(many).alias("stat")).distinct()


def ngram_coverage(documents: DataFrame, n: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, top_ngram, top_share): the word n-gram that covers most characters of a text, and its share.

    top_share counts the characters of all occurrences of the n-gram against the characters of all
    words; ties go to the smallest n-gram; texts with fewer than n words or null give nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(r"[\p{L}\p{N}]+")
        for b in batches:
            top, share = [], []
            for t in b.column(1).to_pylist():
                w = word.findall(t.lower()) if t is not None else []
                if len(w) < n:
                    top.append(None)
                    share.append(None)
                    continue
                seen = Counter(zip(*[w[i:] for i in range(n)]))
                gram, _ = min(((g, -c * sum(map(len, g))) for g, c in seen.items()), key=lambda x: (x[1], x[0]))
                top.append(" ".join(gram))
                share.append(min(1.0, seen[gram] * sum(map(len, gram)) / sum(map(len, w))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "top_ngram", "top_share"])

    d = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return d.mapInArrow(run, "doc_id bigint, top_ngram string, top_share double")
