"""The queries of the operators for training data, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import clusters, frequency, grouping, leaks, mixing, overlaps, quality, spans
from strandmill.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.density_clusters(load(spark, d, "descriptors"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "descriptors")
    return clusters.cluster_summary(rows, clusters.density_clusters(rows))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(load(spark, d, "real_bb"), load(spark, d, "tokens"))


def p3_share(spark: SparkSession, d: str) -> DataFrame:
    b, t = load(spark, d, "real_bb"), load(spark, d, "tokens")
    return spans.shared_share(spans.shared_spans(b, t), b, t)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.broken(load(spark, d, "splits"), grouping.groups(load(spark, d, "real_bb")))


def p4_assign(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "real_bb")
    pids = grouping.listings(load(spark, d, "splits")).select("pid")
    return grouping.assign(pids, grouping.groups(b), grouping.label_vectors(b), load(spark, d, "split_targets"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    report = grouping.assignment_report(p4_assign(spark, d), grouping.label_vectors(load(spark, d, "real_bb")), load(spark, d, "split_targets"))
    return report.select("bucket", "label", "n", *[F.round(c, 6).alias(c) for c in ("share", "target", "deviation")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked(frequency.token_counts(load(spark, d, "tokens"), load(spark, d, "codebook_sizes")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.token_counts(load(spark, d, "tokens"), load(spark, d, "codebook_sizes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cross_split(load(spark, d, "real_bb"), load(spark, d, "splits")).drop("similarity")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "real_bb")
    return overlaps.overlap_counts(overlaps.cross_split(b, load(spark, d, "splits")), b)


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = overlaps.coverage(load(spark, d, "real_bb"), load(spark, d, "splits"))
    return out.withColumn("share", F.round("share", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaked(load(spark, d, "documents"), load(spark, d, "eval_items"))
    return found.where("differing = 0").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    found = p7_leaks(spark, d).groupBy("item_id").agg(F.count_if(F.col("differing") == 0).alias("n_exact"), F.count_if(F.col("differing") > 0).alias("n_near"))
    items = load(spark, d, "eval_items").select("item_id", "suite", "kind")
    return items.join(found, "item_id").select("item_id", "suite", "kind", "n_exact", "n_near")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Scratch(spark).write(mixing.sized(load(spark, d, "documents")), "sizes")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.queue_report(_sized(spark, d), load(spark, d, "mix_targets")).select("source", "state")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), load(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sized(spark, d), load(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), mixing.queue_report(sizes, targets))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(quality.text_stats(load(spark, d, "documents"), load(spark, d, "common_words")))


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    stats = quality.text_stats(docs, load(spark, d, "common_words"))
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes]
    return stats.select(*rounded)


def p9_repetition(spark: SparkSession, d: str) -> DataFrame:
    return quality.ngram_coverage(load(spark, d, "documents")).withColumn("top_share", F.round("top_share", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        p1_found, p1_clusters, p3_found, p3_share, p4_found, p4_assign, p4_report, p5_found, p5_counts, p6_found, p6_counts, p6_coverage,
        p7_found, p7_leaks, p7_items, p8_found, p8_mix, p8_shares, p9_found, p9_stats, p9_repetition,
    )
    return {f.__name__: f for f in names}


_KEY = r"nullif(upper(trim({}, ' ' || chr(9))), '')"
_NAME = r"nullif(lower(trim({}, ' ' || chr(9))), '')"
_SEQ = r"regexp_replace(upper({}), '[^\p{{L}}]', '', 'g')"


def _oracles() -> dict[str, str]:
    pid, seq = _KEY.format("pid"), _SEQ.format("seq")
    best = f"(SELECT pid, seq FROM (SELECT pid, seq, row_number() OVER (PARTITION BY pid ORDER BY length(seq) DESC, seq DESC) AS r FROM (SELECT {pid} AS pid, {seq} AS seq FROM real_bb) WHERE pid IS NOT NULL AND seq <> '') WHERE r = 1)"
    arrays = f"(SELECT tag, level, pid, tokens FROM (SELECT *, row_number() OVER (PARTITION BY tag, level, pid ORDER BY len(tokens) DESC, tokens DESC) AS r FROM (SELECT tag, level, {pid} AS pid, tokens FROM tokens WHERE tokens IS NOT NULL)) WHERE r = 1)"
    side = f"(SELECT DISTINCT s.split_name, s.pid, s.train FROM (SELECT split_name, {pid} AS pid, {_NAME.format('bucket')} = 'train' AS train FROM splits WHERE {_NAME.format('bucket')} IN ('train', 'val', 'test')) s SEMI JOIN (SELECT DISTINCT {pid} AS pid FROM real_bb) b ON s.pid = b.pid WHERE s.split_name IS NOT NULL AND s.pid IS NOT NULL)"
    ent = r"CASE WHEN regexp_matches({0}, '\p{{N}}') THEN upper(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')) END"
    blank = r"[ \t\r\n\x{00A0}]"
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    p5 = f"""
        WITH r AS {arrays},
        o AS (SELECT tag, level, pid, unnest(tokens) AS token FROM r),
        c AS (SELECT tag, level, token, count(*) AS n_occ, count(DISTINCT coalesce(pid, '')) AS n_rec FROM o WHERE token IS NOT NULL GROUP BY ALL),
        n AS (SELECT tag, level, count(*) AS n_records FROM r GROUP BY ALL),
        z AS (SELECT tag, level, m, unnest(range(m))::BIGINT AS token FROM codebook_sizes),
        e AS (SELECT coalesce(c.tag, z.tag) AS tag, coalesce(c.level, z.level) AS level, coalesce(c.token, z.token) AS token, coalesce(n_occ, 0) AS n_occ, coalesce(n_rec, 0) AS n_rec
              FROM c FULL JOIN z ON c.tag = z.tag AND c.level = z.level AND c.token = z.token)
        SELECT e.tag, e.level, token, n_occ, n_rec, coalesce(n_records, 0) AS n_records,
          coalesce(token >= 0 AND token < m AND n_rec < 3, false) AS rare,
          coalesce(token >= 0 AND token < m AND n_rec > 0.9 * coalesce(n_records, 0), false) AS common,
          coalesce((token < 0 OR token >= m) AND n_occ > 0, false) AS invalid
        FROM e LEFT JOIN codebook_sizes s ON e.tag = s.tag AND e.level = s.level LEFT JOIN n ON e.tag = n.tag AND e.level = n.level"""
    p9 = f"""
        WITH w AS (SELECT doc_id, text, {words} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS lines FROM documents),
        known AS (SELECT list(DISTINCT word) AS known FROM common_words),
        s AS (SELECT doc_id, len(words) AS n_words,
          CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / len(words) END AS word_len,
          CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: list_contains(known, x))) / len(words) END AS common,
          length(regexp_replace(text, '[\\p{{L}}\\p{{N}} \\t\\r\\n\\x{{00A0}}]', '', 'g')) / nullif(length(regexp_replace(text, '{blank}', '', 'g')), 0) AS symbols,
          len(list_filter(lines, lambda x: regexp_matches(x, '[.!?]{blank}*$'))) / nullif(len(lines), 0) AS line_end
          FROM w, known WHERE text IS NOT NULL)"""
    p1 = """
            WITH RECURSIVE x AS (SELECT desc_id, any_value(d)::DOUBLE[192] AS d FROM descriptors WHERE desc_id IS NOT NULL AND len(list_filter(d, lambda v: v IS NOT NULL AND isfinite(v))) = 192 AND len(d) = 192 GROUP BY desc_id),
            e AS MATERIALIZED (SELECT a.desc_id AS p, b.desc_id AS q FROM x a JOIN x b ON array_distance(a.d, b.d) <= 2.0 AND a.desc_id <> b.desc_id),
            c AS (SELECT p, p AS lead FROM e UNION SELECT e.q, c.lead FROM c JOIN e ON c.p = e.p),
            f AS MATERIALIZED (SELECT p AS desc_id, min(lead) AS cluster_id FROM c GROUP BY p)"""
    spans = rf"""
            WITH s AS {best}, t AS {arrays},
            u AS (SELECT 'seq' AS field, '' AS tag, -1 AS level, pid, i AS pos, 30 AS n, substr(seq, i + 1, 30) AS w FROM s, unnest(range(length(seq) - 29)) AS x(i) WHERE length(seq) >= 30
              UNION ALL SELECT 'tokens', tag, level, pid, i, 20, list_slice(tokens, i + 1, i + 20)::VARCHAR FROM t, unnest(range(len(tokens) - 19)) AS x(i) WHERE len(tokens) >= 20 AND pid IS NOT NULL),
            shared AS (SELECT * FROM (SELECT *, min(pid) OVER g < max(pid) OVER g AS many FROM u WINDOW g AS (PARTITION BY field, tag, level, w)) WHERE many),
            runs AS (SELECT *, sum(fresh) OVER (PARTITION BY field, tag, level, pid ORDER BY pos) AS run
              FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY field, tag, level, pid ORDER BY pos) <= n THEN 0 ELSE 1 END AS fresh FROM shared)),
            f AS (SELECT field, tag, level, pid, min(pos)::INT AS span_start, (max(pos) + any_value(n))::INT AS span_end FROM runs GROUP BY field, tag, level, pid, run)"""
    p6 = f"""
            WITH side AS {side}, s AS {best},
            k AS (SELECT side.*, seq, length(seq) AS n FROM side JOIN s USING (pid)),
            d AS (SELECT DISTINCT least(t.pid, e.pid) AS pid_a, greatest(t.pid, e.pid) AS pid_b, t.seq AS x, e.seq AS y FROM k t JOIN k e ON t.split_name = e.split_name AND t.train AND NOT e.train AND t.pid <> e.pid AND least(t.n, e.n) >= 0.9 * greatest(t.n, e.n)),
            near AS (SELECT DISTINCT pid_a, pid_b FROM d WHERE 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.9 - 1e-9),
            f AS (SELECT DISTINCT t.split_name, near.pid_a, near.pid_b FROM near, side t, side e WHERE t.split_name = e.split_name AND t.train AND NOT e.train AND ((t.pid = pid_a AND e.pid = pid_b) OR (t.pid = pid_b AND e.pid = pid_a))
            UNION SELECT split_name, pid, pid FROM side GROUP BY split_name, pid HAVING bool_or(train) AND NOT bool_and(train))"""
    # two replaced words leave one of three blocks of a span whole
    p7 = f"""
            WITH i AS (SELECT item_id, {words} AS w FROM eval_items WHERE item_id IS NOT NULL), d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
            x AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, k + 1, k + least(len(w), 13)) AS s FROM i, unnest(range(greatest(len(w) - 12, 1))) AS r(k) WHERE len(w) > 0),
            y AS (SELECT doc_id, n, k, list_slice(w, k + 1, k + n) AS s FROM d, (SELECT DISTINCT n FROM x), unnest(range(len(w) - n + 1)) AS r(k) WHERE len(w) >= n),
            b AS (SELECT unnest([0, 1, 2]) AS b),
            xb AS (SELECT x.*, b, CASE WHEN n < 8 THEN s::VARCHAR ELSE list_slice(s, n * b // 3 + 1, n * (b + 1) // 3)::VARCHAR END AS h FROM x, b WHERE n >= 8 OR b = 0),
            yb AS (SELECT y.*, b, CASE WHEN n < 8 THEN s::VARCHAR ELSE list_slice(s, n * b // 3 + 1, n * (b + 1) // 3)::VARCHAR END AS h FROM y, b WHERE n >= 8 OR b = 0),
            m AS (SELECT doc_id, item_id, k, n, len(list_filter(list_zip(xb.s, yb.s), lambda p: p[1] <> p[2])) AS differing FROM xb JOIN yb USING (n, b, h)),
            g AS (SELECT doc_id, item_id, k, min(differing) AS differing, arg_min(n, (differing, n)) AS span FROM m WHERE differing <= CASE WHEN n >= 8 THEN 2 ELSE 0 END GROUP BY ALL),
            f AS (SELECT doc_id, item_id, min(differing)::INT AS differing, arg_min(k, (differing, k))::INT AS first_word, arg_min(span, (differing, k))::INT AS span, count(*) AS n_spots FROM g GROUP BY ALL)"""
    solid = r"regexp_replace(x, '^[ \t\r\n\x{00A0}]+|[ \t\r\n\x{00A0}]+$', '', 'g')"
    outside = "coalesce({0}, false)".format
    bad = {"n_words": "n_words < 20", "word_len": "word_len < 3.4 OR word_len > 7.0", "common": "common < 0.20", "symbols": "symbols > 0.12", "line_end": "line_end < 0.50"}
    bad = {k: outside(f"({v})") for k, v in bad.items()}
    grams = """g AS (SELECT rid, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram, count(*) AS n FROM r, unnest(range(1, len(w) - 1)) AS x(k) WHERE len(w) >= 3 GROUP BY ALL),
            top AS (SELECT rid, max(n * (length(gram) - 2)) AS most, arg_min(gram, (-n * (length(gram) - 2), gram)) AS gram FROM g GROUP BY rid)"""
    return {
        "p1_found": f"{p1} SELECT desc_id, cluster_id FROM f",
        "p1_clusters": f"""{p1},
            m AS (SELECT cluster_id, i, avg(x.d[i]) AS mean FROM f JOIN x USING (desc_id), unnest(range(1, 193)) AS r(i) GROUP BY ALL),
            l AS (SELECT cluster_id, list(mean ORDER BY i)::DOUBLE[192] AS mean FROM m GROUP BY cluster_id),
            q AS (SELECT cluster_id, desc_id, pow(array_distance(x.d, mean), 2) AS sq FROM f JOIN x USING (desc_id) JOIN l USING (cluster_id))
            SELECT cluster_id, count(*) AS size, arg_min(desc_id, (round(sq, 7), desc_id)) AS medoid_id, list_slice(list(desc_id ORDER BY round(sq, 7), desc_id), 1, 3) AS typical_ids, round(sqrt(avg(sq)), 6) AS spread FROM q GROUP BY cluster_id""",
        "p3_found": f"{spans} SELECT field, tag, level, pid, span_start, span_end FROM f",
        "p3_share": f"""{spans},
            e AS (SELECT 'seq' AS field, '' AS tag, -1 AS level, {pid} AS pid, max(length({seq})) AS length FROM real_bb WHERE {pid} IS NOT NULL AND seq IS NOT NULL GROUP BY 4
              UNION ALL SELECT 'tokens', tag, level, {pid}, max(len(tokens)) FROM tokens WHERE {pid} IS NOT NULL AND tokens IS NOT NULL GROUP BY 2, 3, 4),
            h AS (SELECT field, tag, level, pid, sum(span_end - span_start) AS shared FROM f GROUP BY ALL)
            SELECT e.field, e.tag, e.level, e.pid, length::INT AS length, coalesce(shared, 0)::BIGINT AS shared, coalesce(shared, 0) / nullif(length, 0) AS share
            FROM e LEFT JOIN h ON e.field = h.field AND e.tag IS NOT DISTINCT FROM h.tag AND e.level IS NOT DISTINCT FROM h.level AND e.pid = h.pid""",
        "p6_found": f"{p6} SELECT split_name, pid_a, pid_b FROM f",
        "p6_counts": f"""{p6}, n AS (SELECT {pid} AS pid_a, max(lower(trim(dataset))) AS dataset FROM real_bb GROUP BY 1)
            SELECT split_name, dataset, count(*) FILTER (pid_a = pid_b) AS n_same, count(*) FILTER (pid_a <> pid_b) AS n_near FROM f LEFT JOIN n USING (pid_a) GROUP BY ALL""",
        "p7_leaks": f"{p7} SELECT * FROM f",
        "p7_items": f"{p7} SELECT item_id, suite, kind, count(*) FILTER (differing = 0) AS n_exact, count(*) FILTER (differing > 0) AS n_near FROM f JOIN eval_items USING (item_id) GROUP BY ALL",
        "p9_repetition": f"""WITH r AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
            {grams}
            SELECT doc_id, gram AS top_ngram, CASE WHEN len(w) >= 3 THEN round(least(1.0, most / length(array_to_string(w, ''))), 6) END AS top_share FROM r LEFT JOIN top USING (rid)""",
        "p9_stats": rf"""WITH r AS (SELECT row_number() OVER () AS rid, doc_id, text AS t, {words} AS w,
              list_filter(list_transform(string_split(text, chr(10)), lambda x: {solid}), lambda x: x <> '') AS lines,
              list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r\x{{00A0}}]*\n'), lambda x: {solid}), lambda x: x <> '') AS paragraphs FROM documents),
            known AS (SELECT list(DISTINCT word) AS known FROM common_words),
            {grams},
            s AS (SELECT doc_id, t, len(w)::INT AS n_words,
              list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0) AS word_len,
              len(list_filter(w, lambda x: list_contains(known, x))) / nullif(len(w), 0) AS common,
              length(regexp_replace(t, '[\p{{L}}\p{{N}} \t\r\n\x{{00A0}}]', '', 'g')) / nullif(length(regexp_replace(t, '{blank}', '', 'g')), 0) AS symbols,
              len(list_filter(lines, lambda x: right(x, 1) IN ('.', '!', '?'))) / nullif(len(lines), 0) AS line_end,
              (len(lines) - len(list_distinct(lines))) / nullif(len(lines), 0) AS dup_lines,
              (len(paragraphs) - len(list_distinct(paragraphs))) / nullif(len(paragraphs), 0) AS dup_paragraphs,
              len(list_filter(lines, lambda x: regexp_matches(x, '^([-*•|#>]|\(?\p{{N}}{{1,3}}[.)])'))) / nullif(len(lines), 0) AS bullets,
              CASE WHEN len(w) >= 3 THEN least(1.0, most / length(array_to_string(w, ''))) END AS top_share FROM r LEFT JOIN top USING (rid), known)
            SELECT doc_id, n_words, round(word_len, 6) AS word_len, round(common, 6) AS common, round(symbols, 6) AS symbols, round(line_end, 6) AS line_end, round(dup_lines, 6) AS dup_lines,
              round(dup_paragraphs, 6) AS dup_paragraphs, round(bullets, 6) AS bullets, round(top_share, 6) AS top_share,
              CASE WHEN t IS NULL THEN NULL WHEN coalesce(dup_lines, 0) > 0.3 OR coalesce(dup_paragraphs, 0) > 0.3 OR (coalesce(top_share, 0) > 0.3 AND NOT {bad['n_words']} AND NOT {bad['word_len']}) THEN 'boilerplate'
                WHEN {bad['line_end']} AND coalesce(bullets, 0) > 0.3 THEN 'list' WHEN {bad['n_words']} OR {bad['symbols']} OR {bad['common']} OR {bad['word_len']} THEN 'junk' ELSE 'prose' END AS kind FROM s""",
        "p8_found": f"""
            WITH d AS (SELECT {_NAME.format('source')} AS source, sum(coalesce(length(text), 0)) AS size FROM documents WHERE {_NAME.format('source')} IS NOT NULL GROUP BY 1),
            t AS (SELECT {_NAME.format('source')} AS source, max(share) AS share, arg_max(max_repeats, share) AS laps FROM mix_targets GROUP BY 1), b AS (SELECT sum(size) AS total FROM d)
            SELECT coalesce(d.source, t.source) AS source, CASE WHEN d.source IS NULL THEN 'absent' WHEN share IS NULL THEN 'untargeted' WHEN share * total / size <= 1 THEN 'sampled'
              WHEN share * total / size <= laps THEN 'repeated' ELSE 'short' END AS state FROM d FULL JOIN t ON d.source = t.source, b""",
        "p4_found": f"""
            WITH RECURSIVE r AS (SELECT DISTINCT {pid} AS pid, kind, value FROM (
              SELECT pid, 0 AS kind, {ent.format('depositor')} AS value FROM real_bb UNION ALL SELECT pid, 1, {ent.format('study')} FROM real_bb UNION ALL SELECT pid, 2, {ent.format('entity')} FROM real_bb)
              WHERE value IS NOT NULL AND {pid} IS NOT NULL),
            e AS (SELECT DISTINCT a.pid AS p, b.pid AS q FROM r a JOIN r b USING (kind, value)),
            c AS (SELECT DISTINCT {pid} AS p, {pid} AS lead FROM real_bb WHERE {pid} IS NOT NULL UNION SELECT e.q, c.lead FROM c JOIN e ON c.p = e.p),
            g AS (SELECT p AS pid, min(lead) AS lead_pid FROM c GROUP BY p),
            l AS (SELECT DISTINCT split_name, {_NAME.format('bucket')} AS bucket, {pid} AS pid FROM splits WHERE split_name IS NOT NULL AND {_NAME.format('bucket')} IS NOT NULL AND {pid} IS NOT NULL),
            m AS (SELECT split_name, bucket, pid, lead_pid FROM l JOIN g USING (pid)),
            t AS (SELECT split_name, lead_pid FROM m GROUP BY ALL HAVING count(DISTINCT bucket) > 1)
            SELECT DISTINCT split_name, pid, lead_pid FROM m SEMI JOIN t USING (split_name, lead_pid)""",
        "p5_counts": p5,
        "p5_found": f"SELECT tag, level, token, mark FROM (UNPIVOT (SELECT tag, level, token, CASE WHEN rare THEN 1 END AS rare, CASE WHEN common THEN 1 END AS common, CASE WHEN invalid THEN 1 END AS invalid FROM ({p5})) ON rare, common, invalid INTO NAME mark VALUE v)",
        "p7_found": f"""
            WITH i AS (SELECT item_id, {words} AS w FROM eval_items), d AS (SELECT doc_id, {words} AS w FROM documents),
            x AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, k + 1, k + least(len(w), 13)), ' ') AS s FROM i, unnest(range(greatest(len(w) - 12, 1))) AS r(k) WHERE len(w) > 0),
            lens AS (SELECT DISTINCT n FROM x),
            y AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, k + 1, k + n), ' ') AS s FROM d, lens, unnest(range(len(w) - n + 1)) AS r(k) WHERE len(w) >= n)
            SELECT DISTINCT doc_id, item_id FROM x JOIN y ON x.n = y.n AND x.s = y.s""",
        "p9_found": f"""{p9}
            , o AS (SELECT doc_id, list_filter([CASE WHEN n_words < 20 THEN 'n_words' END, CASE WHEN word_len < 3.4 OR word_len > 7.0 THEN 'word_len' END, CASE WHEN common < 0.20 THEN 'common' END,
              CASE WHEN symbols > 0.12 THEN 'symbols' END, CASE WHEN line_end < 0.50 THEN 'line_end' END], lambda x: x IS NOT NULL) AS stats FROM s)
            SELECT DISTINCT doc_id, unnest(stats) AS stat FROM o WHERE len(stats) >= 2""",
    }


def oracle_sql() -> dict[str, str]:
    return _oracles()
