"""Queries of joins, filters, label spaces, segments, strings, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import text, vec
from strandmill.functions.keys import key, letters, name
from strandmill.operators import labels, segment, stats
from strandmill.plans.registry import query
from strandmill.plans.shared import FRAMES, POINTS, RECORDS, frames, points, records
from strandmill.sources import arrays, files
from strandmill.tables import load

_PID = "nullif(upper(trim(pid, ' ' || chr(9))), '')"
_SPLITS = f"sp AS (SELECT DISTINCT split_name, lower(trim(bucket, ' ' || chr(9))) AS bucket, {_PID} AS pid FROM splits WHERE {_PID} IS NOT NULL)"
_BB = f"bb AS (SELECT {_PID} AS pid, max(lower(trim(dataset))) AS dataset, max(n_res) AS n_res FROM real_bb WHERE {_PID} IS NOT NULL GROUP BY 1)"
_AFF = f"af AS (SELECT {_PID} AS pid, affinity FROM affinity_labels WHERE {_PID} IS NOT NULL AND isfinite(affinity))"
_SEQ = f"sq AS (SELECT {_PID} AS pid, max(regexp_replace(upper(seq), '[^\\p{{L}}]', '', 'g')) AS seq FROM real_bb WHERE seq IS NOT NULL GROUP BY 1 HAVING max(regexp_replace(upper(seq), '[^\\p{{L}}]', '', 'g')) <> '')"


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "splits").select("split_name", name("bucket").alias("bucket"), key("pid").alias("pid")).where("pid IS NOT NULL").distinct()


def _bb(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "real_bb").select(key("pid").alias("pid"), F.lower(F.trim("dataset")).alias("dataset"), "n_res").where("pid IS NOT NULL")
    return b.groupBy("pid").agg(F.max("dataset").alias("dataset"), F.max("n_res").alias("n_res"))


def _affinity(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "affinity_labels").select(key("pid").alias("pid"), "affinity").where(F.col("pid").isNotNull() & vec.finite("affinity"))


def _seqs(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "real_bb").where("seq IS NOT NULL").groupBy(key("pid").alias("pid")).agg(F.max(letters("seq")).alias("seq"))
    return s.where("seq <> ''")


def _of(spark: SparkSession, d: str, tag: str, level: int, as_: str) -> DataFrame:
    return records(spark, d).where((F.col("tag") == tag) & (F.col("level") == level)).select("pid", F.col("tokens").alias(as_))


# projections and filters


@query(f"WITH {_SPLITS} SELECT split_name, bucket, count(DISTINCT pid) AS n FROM sp GROUP BY ALL")
def proj1_upper_keys(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).groupBy("split_name", "bucket").agg(F.count_distinct("pid").alias("n"))


@query(f"WITH {_AFF} SELECT pid, round(avg(affinity), 6) AS affinity, count(*) AS n FROM af GROUP BY pid")
def proj2_finite_labels(spark: SparkSession, d: str) -> DataFrame:
    return _affinity(spark, d).groupBy("pid").agg(F.round(F.avg("affinity"), 6).alias("affinity"), F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT tag, level, pid, len(tokens)::INT AS n FROM t WHERE len(tokens) >= 60 AND len(tokens) <= 600")
def proj3_length_limits(spark: SparkSession, d: str) -> DataFrame:
    """The minimum length and the length guard (P3, P17)."""
    return records(spark, d).select("tag", "level", "pid", F.size("tokens").alias("n")).where("n >= 60 AND n <= 600")


@query(f"WITH {RECORDS} SELECT a.pid, a.tokens[1:least(len(a.tokens), len(b.tokens) - 5)] AS x, len(a.tokens) = len(b.tokens) AS same FROM t a JOIN t b ON a.pid = b.pid AND a.tag = 'ens_a' AND a.level = 0 AND b.tag = 'ens_b' AND b.level = 0 WHERE len(b.tokens) > 5")
def proj4_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Truncation to a common length, and the test of equal shapes (P4, P18)."""
    j = _of(spark, d, "ens_a", 0, "a").join(_of(spark, d, "ens_b", 0, "b"), "pid").where(F.size("b") > 5)
    return j.select("pid", F.slice("a", F.lit(1), F.least(F.size("a"), F.size("b") - 5)).alias("x"), (F.size("a") == F.size("b")).alias("same"))


@query("SELECT frame, count(*) AS n, count(DISTINCT residue_id) AS n_residues FROM descriptors WHERE frame < 3 GROUP BY frame")
def proj5_frame_prefix(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "descriptors").where("frame < 3").groupBy("frame").agg(F.count("*").alias("n"), F.count_distinct("residue_id").alias("n_residues"))


@query(f"WITH {POINTS} SELECT id, [v[1], v[2], v[3]] AS n, [v[4], v[5], v[6]] AS ca, [v[7], v[8], v[9]] AS c, [v[13], v[14], v[15]] AS cb FROM p")
def proj6_atom_slots(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.slice("vec", i * 3 + 1, 3)
    return points(spark, d).select("id", at(0).alias("n"), at(1).alias("ca"), at(2).alias("c"), at(4).alias("cb"))


@query(f"WITH {FRAMES} SELECT event_id, value FROM f WHERE value > 50 AND key IN (SELECT key FROM f WHERE value > 50 GROUP BY key HAVING count(*) >= 25)")
def proj8_positive_groups(spark: SparkSession, d: str) -> DataFrame:
    """The response filter and the group-size predicate (P8, P9, U5): groups as a semi-join, not a window over their rows."""
    f = frames(spark, d).where("value > 50 AND NOT isnan(value)")
    big = f.groupBy("key").agg(F.count("*").alias("n")).where("n >= 25")
    return f.join(big, "key", "left_semi").select("event_id", "value")


@query("SELECT p_partkey AS key, p_size AS resid, 'ALA' AS resname, 0 AS n, 1 AS ca, 2 AS c, 3 AS o, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 4 END AS cb FROM part")
def proj10_atom_parse(spark: SparkSession, d: str) -> DataFrame:
    """Atom lines made from the parts' sizes, parsed: the second residue lacks C and O, a fifth have a malformed CB line."""
    atoms = list(enumerate(("N", "CA", "C", "O", "CB", "N", "CA")))
    size = F.col("p_size")
    lines = [
        F.format_string("ATOM  %5d  %-3s %-4sA%4s    ", F.lit(i + 1), F.lit(a), F.lit("ALA" if i < 5 else "GLY"), F.when(F.lit(i == 4) & (size % 5 == 0), "x1").otherwise((size + (i >= 5) * 1).cast("string")))
        for i, a in atoms
    ]
    t = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat_ws("\n", *lines, F.lit("HETATM")).alias("text"))
    return segment.atoms(t)


@query("SELECT desc_id, frame FROM descriptors WHERE frame % 2 = 0 AND pid IS NOT NULL GROUP BY ALL")
def proj11_stride(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "descriptors").where("frame % 2 = 0 AND pid IS NOT NULL").select("desc_id", "frame").distinct()


@query(f"WITH {POINTS} SELECT id, CASE WHEN id % 3 = 0 THEN [v[4], v[5], v[6]] ELSE [v[1], v[2], v[3]] END AS cb FROM p")
def proj15_coalesce_nan(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    a = F.when(F.col("id") % 3 == 0, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))).otherwise(F.slice("vec", 1, 3))
    return p.select("id", F.when(F.exists(a, lambda x: F.isnan(x)), F.slice("vec", 4, 3)).otherwise(a).alias("cb"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'S%' THEN 'prefix' WHEN p_size > 10 THEN 'mode' ELSE 'none' END AS mode FROM part")
def proj16_column_choice(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.when(F.startswith("p_type", F.lit("S")), "prefix").when(F.col("p_size") > 10, "mode").otherwise("none").alias("mode"))


@query(f"WITH {_BB}, {_AFF} SELECT dataset, count(*) AS n FROM bb WHERE pid IN (SELECT pid FROM af GROUP BY pid HAVING count(*) >= 2) GROUP BY dataset")
def proj19_min_members(spark: SparkSession, d: str) -> DataFrame:
    many = _affinity(spark, d).groupBy("pid").agg(F.count("*").alias("n")).where("n >= 2")
    return _bb(spark, d).join(many, "pid", "left_semi").groupBy("dataset").agg(F.count("*").alias("n"))


# joins and set operations


@query(f"WITH {RECORDS}, {_BB} SELECT DISTINCT a.pid FROM t a JOIN t b ON a.pid = b.pid JOIN bb ON bb.pid = a.pid WHERE a.tag = 'ens_a' AND b.tag = 'ens_b'")
def j1_three_way(spark: SparkSession, d: str) -> DataFrame:
    a, b = (records(spark, d).where(F.col("tag") == t).select("pid") for t in ("ens_a", "ens_b"))
    return a.intersect(b).join(_bb(spark, d), "pid", "left_semi")


@query(f"WITH {RECORDS}, {_AFF} SELECT t.pid, len(tokens)::INT AS n, affinity FROM t JOIN af USING (pid) WHERE tag = 'ens_a' AND level = 1")
def j2_variant_scores(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "ens_a", 1, "x").join(_affinity(spark, d), "pid").select("pid", F.size("x").alias("n"), "affinity")


@query(f"WITH {_BB}, {_AFF}, m AS (SELECT pid, avg(affinity) AS a FROM af GROUP BY pid) SELECT dataset, count(*) AS n, count(a) AS n_scored, bool_and(a IS NOT NULL) AS all_scored FROM bb LEFT JOIN m USING (pid) GROUP BY dataset")
def j3_left_scores(spark: SparkSession, d: str) -> DataFrame:
    m = _affinity(spark, d).groupBy("pid").agg(F.avg("affinity").alias("a"))
    j = _bb(spark, d).join(m, "pid", "left")
    return j.groupBy("dataset").agg(F.count("*").alias("n"), F.count("a").alias("n_scored"), F.bool_and(F.col("a").isNotNull()).alias("all_scored"))


_LIG = "lg AS (SELECT DISTINCT nullif(upper(trim(ligand, ' ' || chr(9))), '') AS ligand FROM ligand_maccs WHERE maccs IS NOT NULL)"


@query(f"""WITH {RECORDS}, {_AFF}, {_LIG}, {_SPLITS}, pr AS (SELECT DISTINCT {_PID} AS pid, nullif(upper(trim(ligand, ' ' || chr(9))), '') AS ligand FROM probe_affinity), x AS (SELECT pid FROM t WHERE tag = 'ens_a' AND level = 0 AND len(tokens) >= 10)
    SELECT bucket, count(*) AS n FROM (SELECT DISTINCT pr.pid, pr.ligand, bucket FROM pr JOIN x USING (pid) JOIN lg USING (ligand) JOIN (SELECT DISTINCT pid FROM af) a USING (pid) JOIN sp ON sp.pid = pr.pid AND split_name = 'random') GROUP BY bucket""")
def j4_affinity_buckets(spark: SparkSession, d: str) -> DataFrame:
    pr = load(spark, d, "probe_affinity").select(key("pid").alias("pid"), key("ligand").alias("ligand")).dropna().distinct()
    lig = load(spark, d, "ligand_maccs").where("maccs IS NOT NULL").select(key("ligand").alias("ligand")).distinct()
    x = _of(spark, d, "ens_a", 0, "x").where(F.size("x") >= 10)
    j = pr.join(x, "pid", "left_semi").join(lig, "ligand", "left_semi").join(_affinity(spark, d), "pid", "left_semi")
    return j.join(_splits(spark, d).where("split_name = 'random'"), "pid").groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS}, {_SPLITS}, x AS (SELECT pid FROM t WHERE tag = 'ens_b' AND level = 0 AND len(tokens) >= 10) SELECT split_name, bucket, count(*) AS n FROM x JOIN sp USING (pid) GROUP BY ALL")
def j5_site_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "ens_b", 0, "x").where(F.size("x") >= 10).join(_splits(spark, d), "pid").groupBy("split_name", "bucket").agg(F.count("*").alias("n"))


@query(f"WITH {_BB}, {_SPLITS} SELECT pid, dataset, CASE min(list_position(['train', 'val', 'test'], bucket)) WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS bucket FROM bb JOIN sp USING (pid) WHERE split_name = 'structure' GROUP BY pid, dataset")
def j6_split_buckets(spark: SparkSession, d: str) -> DataFrame:
    return labels.split_buckets(_bb(spark, d).select("pid", "dataset"), _splits(spark, d).where("split_name = 'structure'"))


@query(f"WITH {RECORDS}, {_SPLITS}, x AS (SELECT pid, unnest(tokens) AS token FROM t WHERE tag = 'ens_b' AND level = 1) SELECT bucket, count(*) AS n, sum(token)::BIGINT AS total FROM x JOIN sp USING (pid) WHERE split_name = 'sequence' GROUP BY bucket")
def j7_stacked_splits(spark: SparkSession, d: str) -> DataFrame:
    """No precedence: a pid listed in two buckets is in both."""
    x = _of(spark, d, "ens_b", 1, "x").join(_splits(spark, d).where("split_name = 'sequence'"), "pid")
    return x.select("bucket", F.explode("x").alias("t")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("total"))


@query("WITH s AS (SELECT DISTINCT residue_id, CASE WHEN residue_id % 10 < 8 THEN 'train' ELSE 'val' END AS bucket FROM descriptors) SELECT bucket, count(DISTINCT desc_id) AS n FROM descriptors JOIN s USING (residue_id) GROUP BY bucket")
def j8_index_join(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "descriptors").select("desc_id", "residue_id")
    s = rows.select("residue_id", F.when(F.col("residue_id") % 10 < 8, "train").otherwise("val").alias("bucket")).distinct()
    return rows.join(s, "residue_id").groupBy("bucket").agg(F.count_distinct("desc_id").alias("n"))


@query(f"WITH {RECORDS} SELECT a.pid, list_transform(list_zip(a.tokens, b.tokens, true), lambda x: [x[1], x[2]]) AS features FROM t a JOIN t b ON a.pid = b.pid AND a.tag = 'ens_a' AND b.tag = 'ens_a' AND a.level = 1 AND b.level = 2")
def j15_feature_concat(spark: SparkSession, d: str) -> DataFrame:
    j = _of(spark, d, "ens_a", 1, "a").join(_of(spark, d, "ens_a", 2, "b"), "pid")
    n = F.least(F.size("a"), F.size("b"))
    return j.select("pid", F.zip_with(F.slice("a", F.lit(1), n), F.slice("b", F.lit(1), n), lambda x, y: F.array(x, y)).alias("features"))


@query(f"WITH {RECORDS}, {_BB} SELECT t.tag, t.level, count(*) FILTER (len(tokens) = n_res) AS n_aligned, count(*) FILTER (len(tokens) <> n_res) AS n_skipped FROM t JOIN bb USING (pid) GROUP BY ALL")
def j16_positional_join(spark: SparkSession, d: str) -> DataFrame:
    j = records(spark, d).join(_bb(spark, d), "pid")
    return j.groupBy("tag", "level").agg(F.count_if(F.size("tokens") == F.col("n_res")).alias("n_aligned"), F.count_if(F.size("tokens") != F.col("n_res")).alias("n_skipped"))


@query("WITH a AS (SELECT DISTINCT p_brand AS name, p_brand AS plain FROM part), b AS (SELECT p_brand AS plain, avg(p_retailprice) AS m, round(avg(p_retailprice), 4) AS v FROM part GROUP BY 1) SELECT '**' || name || '** (n=3)' AS shown, a.plain, v, abs(m - v) <= 5e-4 AS ok FROM a JOIN b USING (plain)")
def j19_normalised_names(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    shown = p.select(F.concat(F.lit("**"), "p_brand", F.lit("** (n=3)")).alias("shown"), F.col("p_retailprice").alias("r")).groupBy("shown").agg(F.avg("r").alias("m")).withColumn("plain", text.plain_name("shown"))
    canon = p.groupBy(F.col("p_brand").alias("plain")).agg(F.round(F.avg("p_retailprice"), 4).alias("v"))
    return shown.join(canon, "plain").select("shown", "plain", "v", (F.abs(F.col("m") - F.col("v")) <= 5e-4).alias("ok"))


@query(f"WITH {_SEQ}, l AS (SELECT unnest(string_split(seq, '')) AS aa FROM sq), m AS (SELECT aa, map {{'A':'ALA','C':'CYS','D':'ASP','E':'GLU','F':'PHE','G':'GLY','H':'HIS','I':'ILE','K':'LYS','L':'LEU','M':'MET','N':'ASN','P':'PRO','Q':'GLN','R':'ARG','S':'SER','T':'THR','V':'VAL','W':'TRP','Y':'TYR'}}[aa] AS three FROM l) SELECT coalesce(three, 'UNK') AS three, count(*) AS n FROM m GROUP BY 1")
def j20_residue_names(spark: SparkSession, d: str) -> DataFrame:
    l = _seqs(spark, d).select(F.explode(F.regexp_extract_all("seq", F.lit("(.)"), F.lit(1))).alias("aa"))
    return l.groupBy("aa").agg(F.count("*").alias("n")).groupBy(text.three_letters("aa").alias("three")).agg(F.sum("n").alias("n"))


@query(f"WITH {_SPLITS}, {_BB} SELECT split_name, bucket, pid FROM sp WHERE pid NOT IN (SELECT pid FROM bb)")
def u4_unknown_listed(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one set without those of another."""
    return _splits(spark, d).join(_bb(spark, d), "pid", "left_anti").select("split_name", "bucket", "pid")


@query("SELECT 'probe' AS side, count(DISTINCT tag) AS n FROM probe_affinity UNION ALL SELECT 'tokens', count(DISTINCT tag) FROM tokens")
def u2_union_sides(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, n: load(spark, d, t).select(F.lit(n).alias("side"), "tag")
    return one("probe_affinity", "probe").unionByName(one("tokens", "tokens")).groupBy("side").agg(F.count_distinct("tag").alias("n"))


# labels


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE replace(p_brand, 'Brand#', '') || '.' || p_size % 7 END AS code2, list_sort(list_distinct([replace(p_brand, 'Brand#', '')])) AS codes FROM part")
def f1_ec_truncate(spark: SparkSession, d: str) -> DataFrame:
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    full = F.when(F.col("p_size") % 3 == 0, brand).otherwise(F.concat_ws(".", brand, F.col("p_size") % 7, F.lit("-")))
    p = load(spark, d, "part").withColumn("ec", full)
    one = F.transform(F.array("ec", "ec"), lambda e: F.substring_index(e, ".", 1))
    return p.select("p_partkey", text.truncated_code("ec", 2).alias("code2"), F.array_sort(F.array_distinct(one)).alias("codes"))


@query(f"WITH {_BB}, {_SPLITS}, l AS (SELECT DISTINCT p_brand || '/' || p_type AS label FROM part) SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM l")
def a10_class_space(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_space(load(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_type").alias("label")))


@query("WITH c AS (SELECT p_type AS label, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1) SELECT label, n FROM c ORDER BY n DESC, f LIMIT 3")
def a11_topk_terms(spark: SparkSession, d: str) -> DataFrame:
    return labels.top_labels(load(spark, d, "part"), 3, "p_type", "p_partkey", "p_size")


@query(f"WITH {_BB}, k AS (SELECT dataset AS label FROM bb WHERE dataset IS NOT NULL GROUP BY dataset ORDER BY count(*) DESC, dataset LIMIT 1) SELECT pid FROM bb JOIN k ON dataset = label")
def proj7_positive_labels(spark: SparkSession, d: str) -> DataFrame:
    b = _bb(spark, d)
    mine = b.where("dataset IS NOT NULL").select("pid", F.col("dataset").alias("label"))
    kept = labels.top_labels(mine, 1, "label", "label", "pid")
    return labels.with_positive_label(b.select("pid"), mine, kept)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 7 = 3")
def w9_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return labels.round_robin(load(spark, d, "orders").select("o_orderkey"), 7, 3, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t4_top_limit(spark: SparkSession, d: str) -> DataFrame:
    """Sort and limit (T1, T4): one pass with a bounded heap in each task."""
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query()
def t8_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 16384 rows first in a seeded hash order (T8, T9)."""
    return load(spark, d, "descriptors").select("desc_id").distinct().orderBy(F.xxhash64("desc_id", F.lit(7)), "desc_id").limit(16384)


# segments and atoms


@query(f"WITH {FRAMES}, b AS (SELECT key, frame, coalesce(abs(value - lag(value) OVER w) > 40, false)::INT AS new FROM f WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)), s AS (SELECT key, frame, sum(new) OVER (PARTITION BY key ORDER BY frame) AS segment FROM b) SELECT key, segment::BIGINT AS segment, min(frame)::INT AS first, (max(frame) + 1)::INT AS last, count(*) AS n FROM s GROUP BY key, segment")
def w3_chain_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(frames(spark, d).select("key", "ts", "event_id", "value"), "key", ["ts", "event_id"], F.abs(F.col("value") - F.col("prev_value")) > 40)


@query(f"WITH {FRAMES}, b AS (SELECT event_id, value AS x, lag(value) OVER w AS p, lead(value) OVER w AS q FROM f WINDOW w AS (PARTITION BY key ORDER BY frame)) SELECT event_id, round(coalesce(q, 2 * x - p, x) - coalesce(p, 2 * x - q, x), 6) + 0.0 AS tangent FROM b")
def w5_lead_lag_tangent(spark: SparkSession, d: str) -> DataFrame:
    return segment.tangents(frames(spark, d), "key", ["frame"], "value").select("event_id", (F.round("tangent", 6) + 0.0).alias("tangent"))


#: Atoms between CA and the carbonyl of every residue: k carbon, n, o, s, h.
_SIDES = {
    "A": "hkhhh", "C": "hkhhsh", "D": "hkhhkoo", "E": "hkhhkhhkoo", "F": "hkhhkkhkhkhkhkh", "G": "hh", "H": "hkhhknhkhnkh", "I": "hkhkhhkhhhkhhh",
    "K": "hkhhkhhkhhkhhnhhh", "L": "hkhhkhkhhhkhhh", "M": "hkhhkhhskhhh", "N": "hkhhkonhh", "P": "hkhhkhhkhh", "Q": "hkhhkhhkonhh", "R": "hkhhkhhkhhnhknhhnhh",
    "S": "hkhhoh", "T": "hkhohkhhh", "V": "hkhkhhhkhhh", "W": "hkhhkkhnhkkkhkhkhkh", "Y": "hkhhkkhkhkohkhkh", "X": "hkhhss",
}


@query(f"WITH {_SEQ} SELECT pid AS key, (i - 1)::INT AS r, CASE WHEN strpos('ACDEFGHIKLMNPQRSTVWY', seq[i]) > 0 THEN seq[i] ELSE 'X' END AS aa FROM sq, unnest(range(1, length(seq) + 1)) AS x(i)")
def w4_residue_segments(spark: SparkSession, d: str) -> DataFrame:
    """The atoms of every sequence's residues, segmented and named again (W4, F9, A35): all kinds, proline and valine by distance."""
    number = {"k": 6, "n": 7, "o": 8, "s": 16, "h": 1}
    maps: dict[str, list] = {"number": [], "kind": [], "x": []}
    for aa, side in _SIDES.items():
        atoms = ("n" if aa == "P" else "nh") + "k" + side + "Ko"
        at = len(atoms) - 2 - len(side)
        maps["number"] += [F.lit(aa), F.array(*[F.lit(number[a.lower()]) for a in atoms])]
        maps["kind"] += [F.lit(aa), F.array(*[F.lit(3 if a == "K" else 1) for a in atoms])]
        maps["x"] += [F.lit(aa), F.array(*[F.lit((1.5 if aa == "P" else 3.0) if at <= i < len(atoms) - 2 else 0.0) for i in range(len(atoms))])]
    aa = F.transform(F.regexp_extract_all("seq", F.lit("(.)"), F.lit(1)), lambda c: F.when(c.isin(*[a for a in _SIDES if a != "X"]), c).otherwise("X"))
    chain = _seqs(spark, d).select(F.col("pid").alias("key"), aa.alias("aa"))

    def spelled(table: list):
        return F.flatten(F.transform("aa", lambda c: F.element_at(F.create_map(*table), c)))

    chain = chain.select("key", *[spelled(table).alias(n) for n, table in maps.items()]).withColumn("xyz", F.transform("x", lambda v: F.array(v, F.lit(0.0), F.lit(0.0))))
    return segment.residues(chain).select("key", "r", "aa")


# strings


@query("SELECT p_partkey, p_brand AS head, p_type || '__' || p_size AS tail FROM part WHERE p_size % 2 = 0")
def f2_key_split(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("p_size") % 2 == 0, F.concat_ws("__", "p_brand", "p_type", "p_size")).otherwise(F.col("p_brand"))
    return load(spark, d, "part").select("p_partkey", text.split_key(k).alias("k")).where("k IS NOT NULL").select("p_partkey", "k.head", "k.tail")


@query(f"WITH {_SEQ} SELECT pid, seq AS wt FROM sq")
def f3_wildtype(spark: SparkSession, d: str) -> DataFrame:
    s = _seqs(spark, d).withColumn("p", F.pmod(F.xxhash64("pid"), F.length("seq")).cast("int") + 1)
    mutant = F.concat(F.substring("seq", F.col("p"), F.lit(1)), F.col("p").cast("string"), F.lit("W"))
    return s.select("pid", text.reverted(mutant, F.overlay("seq", F.lit("W"), F.col("p"), F.lit(1))).alias("wt"))


@query("SELECT doc_id, left(sha1(text), 16) AS h FROM documents WHERE text IS NOT NULL")
def f4_sha1_prefix(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.sha1_prefix("text").alias("h"))


@query("SELECT p_partkey, list_reduce(list_concat([(xor(2166136261, 3) * 16777619) & 4294967295], list_transform(string_split(p_brand, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::BIGINT AS h FROM part")
def f5_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", text.fnv1a("p_brand", 3).alias("h"))


@query()
def f6_random_tokens(spark: SparkSession, d: str) -> DataFrame:
    from strandmill.functions.randoms import random_tokens

    return random_tokens(_bb(spark, d).select("pid", "n_res"), 2048)


@query(f"WITH {_SEQ}, l AS (SELECT pid, unnest(string_split(seq, '')) AS aa FROM sq), i AS (SELECT pid, CASE WHEN strpos('ACDEFGHIKLMNPQRSTVWY', aa) = 0 THEN 20 ELSE strpos('ACDEFGHIKLMNPQRSTVWY', aa) - 1 END AS i FROM l) SELECT pid, list_transform(range(21), lambda k: len(list_filter(list(i), lambda x: x = k))::BIGINT) AS counts FROM i GROUP BY pid")
def f7_aa_onehot(spark: SparkSession, d: str) -> DataFrame:
    """The sums of each sequence's one-hot rows."""
    s = _seqs(spark, d).select("pid", F.transform(F.regexp_extract_all("seq", F.lit("(.)"), F.lit(1)), lambda c: text.residue_index(c)).alias("i"))
    return s.select("pid", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.size(F.filter("i", lambda x: x == k)).cast("bigint")).alias("counts"))


@query("SELECT event_id, (props->>'$.k')::INT AS k, NULL::VARCHAR AS missing FROM events")
def f19_json_path(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return load(spark, d, "events").select("event_id", files.json_at(p, "k").cast("int").alias("k"), files.json_at(p, "a.b").alias("missing"))


@query(f"WITH {_BB} SELECT pid, CASE WHEN n_res <= 512 THEN 512 WHEN n_res <= 1024 THEN 1024 WHEN n_res <= 2048 THEN 2048 END AS bucket FROM bb")
def l11_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_res")
    return _bb(spark, d).select("pid", F.when(n <= 512, 512).when(n <= 1024, 1024).when(n <= 2048, 2048).alias("bucket"))


# sources, sinks, gates


@query(f"WITH {RECORDS} SELECT pid AS path, tag || '_' || level AS key, 'int64' AS dtype, len(tokens)::INT AS n, list_sum(tokens)::DOUBLE AS total, 'tokens' AS kind FROM t WHERE pid IS NOT NULL AND len(tokens) > 0")
def s1_keyed_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Token arrays written as one archive for each pid, and read back (S1, S2, S15, S16)."""
    r = records(spark, d).where("pid IS NOT NULL").where(F.size("tokens") > 0).select("pid", F.concat_ws("_", "tag", "level").alias("key"), F.col("level").alias("ord"), F.col("tokens").alias("data"))
    a = arrays.arrays_of(arrays.archives(r, "pid").select(F.concat("grp", F.lit(".npz")).alias("path"), "content"))
    a = a.join(arrays.kinds(a), "path")
    return a.select(F.replace("path", F.lit(".npz"), F.lit("")).alias("path"), "key", "dtype", F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total"), "kind")


@query(f"WITH {RECORDS} SELECT pid, list_sort(list(DISTINCT tag)) AS labels FROM t WHERE pid IS NOT NULL GROUP BY pid")
def s10_label_lists(spark: SparkSession, d: str) -> DataFrame:
    j = records(spark, d).where("pid IS NOT NULL").groupBy("pid").agg(F.array_sort(F.collect_set("tag")).alias("t"))
    return files.label_lists(j.select(F.to_json(F.create_map(F.lower("pid"), "t")).alias("value")), "value")


@query(f"WITH {_BB}, {RECORDS} SELECT pid FROM bb WHERE pid NOT IN (SELECT pid FROM t WHERE pid IS NOT NULL AND tag = 'ens_b')")
def s23_pending(spark: SparkSession, d: str) -> DataFrame:
    done = records(spark, d).where("tag = 'ens_b'").select("pid").distinct()
    return files.pending(_bb(spark, d).select("pid"), done, ["pid"])


@query("SELECT desc_id, count(*) AS n FROM descriptors WHERE d IS NOT NULL AND len(d) = 192 GROUP BY desc_id")
def s24_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "descriptors")
    return stats.quality_gate(rows, F.size("d") == 192, 0.5).groupBy("desc_id").agg(F.count("*").alias("n"))


@query("SELECT left(CASE WHEN d IS NULL THEN 'no descriptor at all' WHEN len(d) <> 192 THEN 'wrong length ' || len(d) ELSE 'ok' END, 12) AS status, count(*) AS n FROM descriptors GROUP BY 1")
def s25_status_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("d").isNull(), "no descriptor at all").when(F.size("d") != 192, F.concat(F.lit("wrong length "), F.size("d"))).otherwise("ok")
    return stats.status_counts(load(spark, d, "descriptors").withColumn("status", s), "status")


@query(f"""WITH {RECORDS}, k AS (SELECT * FROM (VALUES ('ec', 0, 200), ('go', 1, 1), ('site', 0, 50), ('none', 9, 1)) AS k(task, level, least)), c AS (SELECT tag, task, k.level, least FROM (SELECT DISTINCT tag FROM codebook_sizes), k)
    SELECT c.tag, c.task, count(pid) AS n_records FROM c LEFT JOIN t ON t.tag = c.tag AND t.level = c.level AND len(t.tokens) >= least GROUP BY ALL""")
def x3_task_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of tasks (the level and the least length each takes) crossed with the tokenizers, and the records each has."""
    tasks = spark.createDataFrame([("ec", 0, 200), ("go", 1, 1), ("site", 0, 50), ("none", 9, 1)], "task string, level int, least int")
    every = load(spark, d, "codebook_sizes").select("tag").distinct().join(F.broadcast(tasks), how="cross")  # tags x tasks
    t = records(spark, d).select("tag", "level", "pid", F.size("tokens").alias("n"))
    fits = every.join(t, ["tag", "level"], "left").withColumn("pid", F.when(F.col("n") >= F.col("least"), F.col("pid")))
    return fits.groupBy("tag", "task").agg(F.count("pid").alias("n_records"))


@query(f"WITH {FRAMES}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, token, count(*) AS n FROM f GROUP BY ALL) SELECT h::VARCHAR AS hour, token, n FROM w")
def s0_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the windowed token counts."""
    from strandmill.streaming.counts import windowed_counts

    c = windowed_counts(frames(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "token"), "ts", "token")
    return c.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "token", "n")

