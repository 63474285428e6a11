"""Small fixtures with exact expected values."""

import datetime as dt
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import args, keys, text, vec
from strandmill.operators import basis, geometry, graph, labels, lookup, orphans, quantize, ranks, registry, report, segment, stats, tokenstats
from strandmill.sources import arrays, files


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, **cols):
    return rows(spark.range(1).select(*[c.alias(k) for k, c in cols.items()]))[0]


def test_keys(spark):
    df = spark.createDataFrame([(" a\tb \t",), (" \t",), (None,)], "k string")
    assert rows(df.select(keys.key("k"), keys.name("k"))) == [("A\tB", "a\tb"), (None, None), (None, None)]
    assert one(spark, a=keys.letters(F.lit("ab-c\n1*D")), b=keys.entity(F.lit("dep-1x.")), c=keys.entity(F.lit("n/a"))) == ("ABCD", "DEP1X", None)


def test_hashes_and_codes(spark):
    got = one(spark, a=text.fnv1a(F.lit(""), 0), b=text.fnv1a(F.lit("10GS"), 0), c=text.fnv1a(F.lit("10GS"), 1), d=text.fnv1a(F.lit("12asA00"), 0))
    assert got == (84696351, 1708077896, 750431647, 3388626883)
    assert one(spark, a=text.truncated_code(F.lit("1.4.3.21"), 2), b=text.truncated_code(F.lit("1"), 2), c=text.truncated_code(F.lit("2.-.-.-"), 2)) == ("1.4", None, "2.-")
    a, b = one(spark, a=text.split_key(F.lit("A_B__x__y")), b=text.split_key(F.lit("plain")))
    assert tuple(a) == ("A_B", "x__y") and b is None


def test_random_tokens(spark):
    from strandmill.functions.randoms import random_tokens

    df = spark.createDataFrame([("10GS", 5), ("none", None)], "pid string, n_res int")
    assert rows(random_tokens(df, 2048)) == [("10GS", [1475, 252, 569, 1228, 782])]


def test_reverted(spark):
    r = lambda m, s: text.reverted(F.lit(m), F.lit(s))
    assert one(spark, a=r("A1W", "WCD"), b=r("A1W:C2Y", "WYD"), c=r("A9W", "WCD"), d=r("AxW", "WCD"), e=r("", "WCD")) == ("ACD", "ACD", None, None, None)


def test_cells(spark):
    a, b, c = one(spark, a=text.cell(F.lit("-0.0123 ± 0.1011 (n=10)")), b=text.cell(F.lit("—")), c=text.plain_name(F.lit("**own** (n=3)")))
    assert tuple(a) == (-0.0123, 0.1011, 10) and b is None and c == "own"
    assert one(spark, a=text.cell_text(F.lit(0.5), F.lit(0.0), F.lit(1)), b=text.cell_text(F.lit(0.5), F.lit(0.0), F.lit(0))) == ("0.5000 ± 0.0000 (n=1)", "—")


def test_eta_squared(spark):
    df = spark.createDataFrame([(float(v), g) for v, g in zip((1, 2, 3, 10, 11, 12, 99), (0, 0, 0, 1, 1, 1, 2))], "v double, g int")
    assert rows(stats.eta_squared(df, "v", "g", 2)) == [(pytest.approx(0.9681274900398407), 2, 6)]
    assert rows(stats.eta_squared(df, "v", "g", 50)) == [(None, 0, 0)]


def test_ranks(spark):
    x, y = (1, 2, 2, 3, 5), (2, 1, 4, 4, 5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    r = ranks.average_ranks(ranks.average_ranks(df, "x", name="rx"), "y", name="ry").orderBy("i").collect()
    assert [t["rx"] for t in r] == [1, 2.5, 2.5, 4, 5] and [t["ry"] for t in r] == [2, 1, 3.5, 3.5, 5]
    assert rows(ranks.spearman(df, "x", "y")) == [(5, pytest.approx(0.7631578947368421))]
    assert rows(ranks.spearman(df.withColumn("c", F.lit(1.0)), "x", "c"))[0][1] is None


def test_auroc_and_ap(spark):
    df = spark.createDataFrame(list(zip((1, 0, 1, 0, 1), (0.9, 0.8, 0.8, 0.3, 0.1))), "y int, s double")
    assert rows(ranks.auroc(df, "s", "y"))[0][2] == pytest.approx(0.5833333333333334)
    assert rows(ranks.average_precision(df, "s", "y"))[0][1] == pytest.approx(0.7555555555555555)
    assert rows(ranks.auroc(df.where("y = 1"), "s", "y"))[0][2] is None


def test_running_many_values(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(300)).cast("double").alias("v"))
    got = {r["v"]: r["rank"] for r in ranks.average_ranks(df, "v").collect()}
    v = np.sort([r[0] for r in df.collect()])
    for k, r in got.items():
        assert r == np.mean(np.flatnonzero(v == k) + 1)


def test_zscores(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    z = [r["z"] for r in ranks.zscores(df, "v", ["g"]).orderBy("v").collect()]
    assert z == pytest.approx([-1.3416407864998738, -0.4472135954999579, 0.4472135954999579, 1.3416407864998738])


def test_token_statistics(spark):
    df = spark.createDataFrame([(0, t) for t in (0, 0, 1, 1, 3)], "level int, token int")
    got = rows(tokenstats.codebook_use(df, spark.createDataFrame([(0, 4), (1, 4)], "level int, m int")).orderBy("level"))
    assert got[0] == (0, 5, 3, 0.75, pytest.approx(2.8717458874925876)) and got[1] == (1, 0, 0, 0.0, None)


def test_plurality(spark):
    book = spark.createDataFrame([(i, [float(i)]) for i in range(8)], "code int, vec array<double>")
    df = spark.createDataFrame([("a", t) for t in (3, 3, 5)] + [("b", t) for t in (3, 3, 5, 5)] + [("c", t) for t in (1, 2, 6)] + [("d", 7)], "key string, token int")
    df = df.withColumn("key", F.ascii("key").cast("bigint"))
    got = {chr(k): (t, v) for k, t, v in rows(tokenstats.plurality_vote(df, book))}
    assert got == {"a": (3, True), "b": (4, False), "c": (3, False), "d": (7, False)}


def test_nearest_code_tie_and_residuals(spark):
    book = spark.createDataFrame([(4, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [5.0, 5.0])], "code int, vec array<double>")
    pts = spark.createDataFrame([(1, [1.0, 1.0]), (2, [5.0, 4.0]), (3, None)], "id bigint, vec array<double>")
    assert sorted(rows(quantize.nearest_code(pts, book))) == [(1, 4, 1.0), (2, 9, 1.0)]
    with pytest.raises(ValueError):
        quantize.nearest_code(pts, book.limit(0))


def test_standardize_constant(spark):
    pts = spark.createDataFrame([(1, [1.0, 7.0]), (2, [3.0, 7.0])], "id int, vec array<double>")
    assert sorted(rows(quantize.standardize(pts))) == [(1, [-1.0, 0.0]), (2, [1.0, 0.0])]


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    pts = [(i, (rng.normal(size=3) * 0.01 + 10 * (i % 3)).tolist()) for i in range(60)]
    got = rows(quantize.kmeans_fit(spark.createDataFrame(pts, "id int, vec array<double>"), 6, rounds=6).agg(F.sum("n")))
    assert got == [(60,)]


def test_ema_revives_dead_codes(spark):
    state = spark.createDataFrame([(0, 5.0, [0.0], [0.0]), (1, 0.5, [50.0], [100.0])], "code int, ema_count double, ema_weight array<double>, vec array<double>")
    pts = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id int, vec array<double>")
    got = {r["code"]: r for r in quantize.ema_step(state, pts, 0.9).collect()}
    assert got[0]["ema_count"] == pytest.approx(5 * 0.9 + 0.4) and got[1]["ema_count"] == 1.0 and got[1]["vec"][0] in (0, 1, 2, 3)


def test_welch(spark):
    df = spark.createDataFrame([(0.70, 0.02, 10, 0.68, 0.01, 10), (0.5, 0.0, 3, 0.4, 0.0, 3)], "a double, b double, c int, d double, e double, f int")
    t, nu = stats.welch(*"abcdef")
    got = rows(df.select(t.alias("t"), nu.alias("df")).select("t", "df", stats.t_test_p("t", "df")))
    assert got[0][:2] == (pytest.approx(2.828427124746177), pytest.approx(13.235294117647058))
    assert got[0][2] == pytest.approx(0.0141, abs=2e-4) and got[1] == (None, None, None)


def test_t_tail_matches_known_values():
    from strandmill.operators.stats import _beta_tail

    nu = np.array([1.0, 2.0, 10.0])
    t = np.array([1.0, 2.0, 2.228138851986])
    got = _beta_tail(nu / (nu + t**2), nu / 2, np.full(3, 0.5))
    assert got == pytest.approx([0.5, 1 - 2 / math.sqrt(6), 0.05], abs=1e-9)


def test_seed_cells_and_tolerance(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.3)], "k string, v double")
    assert sorted(rows(stats.seed_cells(df, ["k"], "v"))) == [("a", 0.5, 0.0, 1), ("b", pytest.approx(0.2), pytest.approx(0.1414213562), 2)]
    m, s = stats.tolerance("s", "n")
    assert rows(spark.createDataFrame([(0.01, 10)], "s double, n int").select(m, s)) == [(pytest.approx(max(0.002, 0.025 / math.sqrt(10))), 0.005)]


def test_quality_gate(spark):
    df = spark.range(10)
    assert stats.quality_gate(df, F.col("id") < 5).count() == 5
    for bad in (F.col("id") < 4, F.col("id") < 0):
        with pytest.raises(ValueError):
            stats.quality_gate(df, bad)


def test_farthest_frames_and_matching():
    at = lambda *x: np.array([[[v, 0.0, 0.0]] for v in x])
    assert geometry.farthest_frames(at(0, 10, 1, 6), 3) == [0, 1, 3]
    assert geometry.farthest_frames(at(2, 2, 2), 3) == [0]
    rng = np.random.default_rng(3)
    for n in (2, 5, 7, 11):
        cost = rng.random((n, n))
        perm, total = geometry.assignment(cost)
        assert sorted(perm) == list(range(n)) and total == pytest.approx(cost[np.arange(n), perm].sum())
    cost = rng.random((7, 7))
    from itertools import permutations

    assert geometry.assignment(cost)[1] == pytest.approx(min(cost[np.arange(7), p].sum() for p in permutations(range(7))))


def _turned(rng, n, residues=14):
    base = rng.normal(size=(residues, 3)) * 4
    out = []
    for _ in range(n):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q[:, 0] *= np.sign(np.linalg.det(q))
        out.append(base @ q.T + rng.normal(size=3))
    return np.array(out)


def test_rigid_motion_has_no_fluctuation():
    x = _turned(np.random.default_rng(1), 5)
    assert geometry.fluctuation(x).max() < 1e-5 and geometry.fluctuation(x, 0).max() < 1e-5
    assert geometry.local_pca(x)[:, 0].max() < 1e-4
    assert not geometry.local_pca(np.array([[[0.0, 0, 0], [50, 0, 0]]] * 3)).any()
    n, ca, c = x[0], x[0] + 1, x[0] + np.arange(3)
    turned = [_ @ np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]).T + 5 for _ in (n, ca, c)]
    assert geometry.frame_descriptor(n, ca, c) == pytest.approx(geometry.frame_descriptor(*turned), abs=1e-9)


def test_radius_pairs(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(60, 3)) * 3
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pts)], "key int, id int, x double, y double, z double")
    got = {(a, b) for _, a, b in rows(geometry.radius_pairs(df, 2.0))}
    want = {(i, j) for i in range(60) for j in range(60) if ((pts[i] - pts[j]) ** 2).sum() <= 4}
    assert got == want


def test_segments_and_backbone(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((1, 2, 50, 51))] + [("b", 0, 1.0)], "key string, i int, value double")
    got = sorted(rows(segment.segments(df, "key", ["i"], F.abs(F.col("value") - F.col("prev_value")) > 5)))
    assert got == [("a", 0, 0, 2, 2), ("a", 1, 2, 4, 2), ("b", 0, 0, 1, 1)]
    line = spark.createDataFrame([(1, i, 3.8 * i, 0.0, 0.0) for i in range(4)] + [(2, 0, 1.0, 2.0, 3.0)], "k int, r int, x double, y double, z double")
    got = {(r["k"], r["r"]): r for r in segment.ideal_backbone(line, ["k"], "r").collect()}
    assert got[1, 1]["n"] == pytest.approx([3.8 - 1.191, 0.844, 0.0], abs=1e-6) and got[1, 1]["c"] == pytest.approx([3.8 + 1.264, 0.844, 0.0], abs=1e-6)
    assert got[2, 0]["n"] == [1.0, 2.0, 3.0] and got[2, 0]["o"] == [2.23, 2.0, 3.0]


def test_atom_lines(spark):
    line = lambda i, a, r: f"ATOM  {i:5d}  {a:<3s} ALA A{r:>4s}    "
    t = "\n".join(["REMARK", line(1, "N", "5"), line(2, "CA", "5"), line(3, "C", "5"), line(4, "X", "zz"), line(5, "O", "5"), line(6, "N", "6")])
    assert rows(segment.atoms(spark.createDataFrame([("k", t)], "key string, text string"))) == [("k", 5, "ALA", 0, 1, 2, 4, None)]


def test_residues(spark):
    ala, gly = [7, 1, 6, 1, 6, 1, 1, 1, 6, 8], [7, 1, 6, 1, 6, 8]
    kinds = [3 if i in (8, 14) else 1 for i in range(16)]
    xyz = [[0.0, 0.0, 0.0]] * 16
    df = spark.createDataFrame([("k", ala + gly, kinds, xyz), ("void", ala[:-1], kinds[:9], xyz[:9])], "key string, number array<int>, kind array<int>, xyz array<array<double>>")
    assert rows(segment.residues(df)) == [("k", 0, 0, 2, 8, 9, 4, "A"), ("k", 1, 10, 12, 14, 15, None, "G")]
    far, near = (lambda i: (9.0, 0, 0)), (lambda i: (1.0, 0, 0))
    zero = (0.0, 0, 0)
    assert segment.residue_name("hkhkhkh", True, near, zero) == "P" and segment.residue_name("hkhkhkh", True, far, zero) == "V"
    assert [segment.residue_name(s, True, far, zero) for s in ("hkhhkkk", "hkhkkk", "hkkkk", "kkoo")] == ["L", "I", "X", "D"]


def test_markdown_round_trip(spark):
    text_ = ["| a | b |", "## One (x)", "| baseline | s |", "|---|---|", "| **own** | 0.5 |", "| bad |", "### EC depth-1", "#### random", "| baseline | s | t |", "|:--|--|--|", "| own | 1 | 2 |", "## Two", "### plain", "| baseline | s |", "|-|-|", "| o | 3 |"]
    df = spark.createDataFrame([("d", i, l) for i, l in enumerate(text_)], "doc string, line_no int, line string")
    got = sorted(rows(report.parse_markdown(df)))
    assert got == sorted([("d", "One (x)", "", "**own**", "s", "0.5"), ("d", "One (x)", "EC depth-1/random", "own", "s", "1"), ("d", "One (x)", "EC depth-1/random", "own", "t", "2"), ("d", "Two", "plain", "o", "s", "3")])


def test_audit(spark):
    schema = "k string, mean double, std double, n int"
    ours = spark.createDataFrame([("a", 0.5, 0.01, 10), ("b", 0.9, 0.01, 10), ("c", 0.5, 0.01, 5), ("d", 0.1, 0.0, 1)], schema)
    canon = spark.createDataFrame([("a", 0.501, 0.01, 10), ("b", 0.5, 0.01, 10), ("c", 0.5, 0.01, 10)], schema)
    got = {r["k"]: r["status"] for r in report.audit(ours, canon, ["k"]).collect()}
    assert got == {"a": "match", "b": "off", "c": "partial", "d": "canon-miss"}
    assert report.audit_order(report.audit(ours, canon, ["k"])).first()["k"] == "b"


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", "c", "a", None, "abcde", "abcdf")], "label string")
    assert sorted(rows(labels.class_space(df))) == [("a", 0), ("abcde", 1), ("abcdf", 2), ("b", 3), ("c", 4)]
    items = spark.createDataFrame([("P",), ("Q",), ("R",)], "pid string")
    splits = spark.createDataFrame([("P", "test"), ("P", "val"), ("Q", "train"), ("Q", "test"), ("R", "other")], "pid string, bucket string")
    assert sorted(rows(labels.split_buckets(items, splits))) == [("P", "val"), ("Q", "train")]


def test_class_space_of_any_labels(spark):
    words = ["aé", "zz", "zzzz", "a", "a\t", "日本語日本", "日本", "", *[f"GO:{i}" for i in range(300)]]
    got = rows(labels.class_space(spark.createDataFrame([(w,) for w in words * 2], "label string")))
    assert sorted(got, key=lambda r: r[1]) == [(w, i) for i, w in enumerate(sorted(words, key=lambda w: w.encode()))]
    assert rows(labels.class_space(spark.createDataFrame([], "label string"))) == []


def test_round_robin_with_ties(spark):
    df = spark.createDataFrame([(1, f"j{i}") for i in range(7)] + [(0, "first"), (None, "null")], "o int, job string")
    parts = [{r["job"] for r in labels.round_robin(df, 3, i, "o").collect()} for i in range(3)]
    assert [len(p) for p in parts] == [3, 3, 3] and len(set().union(*parts)) == 9 and "null" in parts[0] and "first" in parts[1]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(0, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7)]
    got = dict(rows(graph.components(spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint"))))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    assert rows(graph.components(spark.createDataFrame([], "a string, b string"))) == []


T = lambda *a: dt.datetime(2023, *a)
REFS = "row_id bigint, pid string, ran_at timestamp_ntz, extra int"
TABLE = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, row_id int, reason string"


def _brute(refs, table):
    out = set()
    for i, p, at, _ in refs:
        k = (p or "").strip(" \t").upper()
        if not k:
            continue
        mine = [(a, b) for key, a, b, *_ in table if (key or "").strip(" \t").upper() == k]
        if any(at is not None and a is not None and a <= at and (b is None or b > at) for a, b in mine):
            continue
        why = "missing" if not mine else "later" if at is not None and all(a is not None and a > at for a, _ in mine) else "deleted"
        out.add((i, "pid", why, at.strftime("%Y-%m") if at else None))
    return out


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("hot", [0, 1500])
def test_dangling(spark, monkeypatch, most, hot):
    monkeypatch.setattr(orphans, "MAX_BROADCAST_VERSIONS", most)
    refs = [(1, " a\t", T(2, 1), 0), (1, "A", T(2, 1), 0), (2, "a", T(1, 1), 0), (3, "b", T(5, 1), 1), (4, "x", T(5, 1), 1), (5, None, T(5, 1), 1), (6, " \t", T(5, 1), 1), (7, "a", None, 1), (8, "c", T(1, 5, 10), 1), (9, "c", T(1, 5, 12), 1), (10, "a", T(3, 1), 1), (11, "d", T(3, 1), 0), (12, "x", None, 0)]
    refs += [(100 + i, "a", T(1 + i % 4, 1 + i % 25), 0) for i in range(hot)]
    table = [("A", T(1, 15), T(3, 1), 0, ""), ("a ", T(4, 1), None, 0, ""), ("a", T(4, 1), None, 0, ""), ("B", T(1, 1), T(2, 1), 0, ""), ("c", T(1, 5, 11), T(1, 5, 11, 30), 0, ""), ("c", T(1, 5, 12), None, 0, ""), ("d", None, None, 0, ""), (None, T(1, 1), None, 0, "")]
    table += [("E", T(1 + i % 5, 1, i % 24), T(1 + i % 5, 2 + i % 20), 0, "") for i in range(400)]  # very many versions
    refs += [(3000 + i, " e", T(1 + i % 7, 1 + i % 28, 5), 0) for i in range(200)]
    fields = {"pid": (spark.createDataFrame(table, TABLE), "id")}
    got = orphans.dangling(spark.createDataFrame(refs, REFS), fields)
    counted = rows(orphans.dangling_counts(spark.createDataFrame(refs, REFS), fields, {"pid": "t"}))
    want = _brute(refs, table)
    assert {(r[1], r[2]): r[3] for r in counted} == {k: sum((p, w) == k for _, _, w, p in want) for k in {(p, w) for _, _, w, p in want}}
    every = {(i, (p or "").strip(" \t").upper(), at) for i, p, at, _ in refs if (p or "").strip(" \t")}
    assert all(r[4] == sum((at.strftime("%Y-%m") if at else None) == r[1] for _, _, at in every) for r in counted)
    assert got.columns == ["row_id", "ref_field", "reason", "period"] and got.count() == got.distinct().count()
    assert set(rows(got)) == _brute(refs, table)


def test_dangling_empty(spark):
    none, some = spark.createDataFrame([], TABLE), spark.createDataFrame([(1, "a", T(1, 1), 0)], REFS)
    assert rows(orphans.dangling(some, {"pid": (none, "id")})) == [(1, "pid", "missing", "2023-01")]
    assert rows(orphans.dangling(some.limit(0), {"pid": (none, "id")})) == []


def test_array_files(spark):
    at = io.BytesIO()
    np.savez(at, b=np.arange(3), a=np.ones((2, 2), np.float32), s=np.array(["x"]))
    df = spark.createDataFrame([("x/f.npz", bytearray(at.getvalue()))], "path string, content binary")
    got = sorted(rows(arrays.arrays_of(df).drop("path")))
    assert got == [("a", 1, "float32", [2, 2], [1.0] * 4), ("b", 0, "int64", [3], [0.0, 1.0, 2.0]), ("s", 2, "<U1", [1], None)]
    with pytest.raises(Exception, match="never loaded"):
        arrays.arrays_of(spark.createDataFrame([("f.pkl", bytearray(b""))], "path string, content binary")).collect()


def test_json_and_csv_sources(spark, tmp_path):
    j = spark.createDataFrame([('{"random": {"train": ["a", "b"], "val": ["c"]}}',), ('{"train": ["d"]}',)], "v string")
    assert sorted(rows(files.splits_of(j, "v"))) == [("", "train", "D"), ("random", "train", "A"), ("random", "train", "B"), ("random", "val", "C")]
    s = spark.createDataFrame([('{"X": {"A1C": 0.5, "D2E": null}}',)], "v string")
    assert sorted(rows(files.nested_scores(s, "v"))) == [("X", "A1C", 0.5), ("X", "D2E", None)]
    (tmp_path / "a.csv").write_text("mutant,mutated_sequence,z\nA1C,CDE,1\nA2C,,2\n")
    assert rows(files.read_assay(spark, str(tmp_path / "a.csv"))) == [("A1C", "CDE")]
    out = str(tmp_path / "o")
    files.write_once(spark.range(3), out)
    files.write_once(spark.range(9), out)
    assert spark.read.parquet(out).count() == 3
    files.write_once(spark.range(9), out, force=True)
    assert spark.read.parquet(out).count() == 9


def test_structure_text(spark):
    df = spark.createDataFrame([("k", 0, "A", [1.0, 2.0, 3.0], [2.0] * 3, [3.0] * 3, [4.0] * 3, [float("nan"), 0.0, 0.0]), ("k", 1, "J", [1.0] * 3, [2.0] * 3, [3.0] * 3, [4.0] * 3, [5.0] * 3)], "key string, res int, aa string, n array<double>, ca array<double>, c array<double>, o array<double>, cb array<double>")
    pdb = rows(files.structures(df))[0][1].split("\n")
    assert pdb[0] == "ATOM      1  N   ALA A   1       1.000   2.000   3.000  1.00  0.00           N" and len(pdb) == 11 and "  CB  UNK A   2" in pdb[7] and pdb[-2] == "END"


def test_vec(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, n=vec.norm(a), d=vec.sqdist(a, b), s=vec.dot(a, a), h=vec.one_hot(F.lit(1), 3), f=vec.finite(F.lit(float("nan")))) == (5.0, 25.0, 25.0, [0.0, 1.0, 0.0], False)


def test_capped_nearest(spark):
    r = spark.createDataFrame([(1, [0.0]), (2, [5.0]), (3, [100.0])], "id bigint, vec array<double>")
    f = spark.createDataFrame([(0, [0.0005]), (1, [0.0]), (2, [4.0])], "frame int, vec array<double>")
    assert sorted(rows(geometry.capped_nearest(r, f, 2.0))) == [(1, 0, 0.0005), (2, 2, 1.0)]


def test_streaming_counts(spark, tmp_path):
    from strandmill.streaming.counts import windowed_counts

    spark.createDataFrame([(dt.datetime(2023, 1, 1, 0, 5), 1), (dt.datetime(2023, 1, 1, 0, 9), 1), (dt.datetime(2023, 1, 1, 1, 9), 2)], "ts timestamp, token int").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, token int").parquet(str(tmp_path / "in"))
    q = windowed_counts(s, "ts", "token").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("counted").collect()) == [1, 2]


def test_lookup_padding_and_shapes(spark):
    cache = spark.createDataFrame([("a ", "Misato", 8, 3), ("A", "misato", 8, 5), ("b", "misato", 4, 7), ("c", "mdcath", 8, 9)], "pid string, dataset string, n_frames int, n int")
    wanted = spark.createDataFrame([("A",), ("b",), ("c",), (None,)], "pid string")
    assert sorted(rows(lookup.lookup(wanted, cache, "misato", 8, ["n"], ("misato", "mdcath")))) == [("A", 5), ("B", None), ("C", None)]
    with pytest.raises(ValueError):
        lookup.lookup(wanted, cache, "other", 8, ["n"], ("misato", "mdcath"))
    assert {r[1] for r in rows(lookup.lookup(wanted, cache, "other", 8, ["n"]))} == {None}
    dense, mask = lookup.padded(F.array(F.lit(1), F.lit(2)), 3)
    assert one(spark, a=dense, b=mask) == ([1, 2, 0], [True, True, False])
    bad = spark.createDataFrame([([1.0],), (None,)], "x array<double>")
    with pytest.raises(Exception, match="x must have 2 elements"):
        lookup.checked(bad, {"x": 2}).collect()
    df = spark.createDataFrame([(0, i, float(i)) for i in range(4)], "g int, o int, v double")
    assert [r[3] for r in sorted(rows(lookup.sliding_dot(df, "g", "o", "v", [1.0, 10.0, 100.0])))] == [100.0, 210.0, 321.0, 32.0]


def test_wild_types(spark):
    df = spark.createDataFrame([("x", "A1W:C2Y", "WYD", 0), ("x", "D3E", "ACEZ", 2), ("x", "bad", "ACD", 1), ("y", "A1W:C2Y", "WYD", 5), ("z", "A9W", "W", 0)], "assay string, mutant string, mutated_sequence string, ord int")
    assert sorted(rows(lookup.wild_types(df))) == [("x", "ACDZ"), ("y", "ACD")]


def test_registries_basis_and_arguments(spark):
    assert one(spark, a=registry.descriptor("steps", F.array(F.lit(1.0), F.lit(4.0), F.lit(2.0)))) == ([3.0, -2.0],)
    with pytest.raises(ValueError):
        registry.descriptor("none", "x")
    with pytest.raises(ValueError):
        registry.tokenize("none", spark.range(1))
    b = basis.random_basis(6, 3, seed=1)
    assert np.allclose(b @ b.T, np.eye(3)) and np.allclose(np.linalg.norm(basis.random_basis(3, 6), axis=1), 1)
    x = (2 * b[0] - b[2]).tolist()
    (_, c, rest), = rows(basis.projected(spark.createDataFrame([(1, x)], "id bigint, vec array<double>"), b))
    assert c == pytest.approx([2, 0, -1], abs=1e-9) and rest == pytest.approx(0, abs=1e-9)
    assert args.named("a = b=c") == ("a", "b=c") and args.listed("1, 2,", int) == [1, 2] and args.shard("0/3") == (0, 3) and args.spread([1], 2) == [1, 1]
    for wrong in (lambda: args.named("x"), lambda: args.shard("3/3"), lambda: args.spread([1, 2], 3)):
        with pytest.raises(ValueError):
            wrong()


def test_bundle_without_positives(spark):
    from strandmill.operators.probes import multilabel_bundle

    r = multilabel_bundle(spark.createDataFrame([(1, "a", 0.5, 0)], "id int, cls string, score double, y int")).first()
    assert r["n_classes"] == 0 and all(math.isnan(r[c]) for c in ("macro_ap", "micro_ap", "top1"))


def test_grid_best_and_sections(spark):
    assert tuple(one(spark, a=text.grid_best(F.lit("Grid-best α = 0.3 → +0.4512")))[0]) == (0.3, 0.4512)
    assert tuple(one(spark, a=text.cell(F.lit("+0.1000 ± 0.0100 (n=3)")))[0]) == (0.1, 0.01, 3)
    df = spark.createDataFrame([("EC", "**own** (n=3)"), ("gone", "x")], "section string, baseline string")
    assert rows(report.with_sections(df, {"EC": "ec"}, {"own": "Own model"})) == [("ec", "Own model")]


def test_frames_in_batches(spark):
    rng = np.random.default_rng(2)
    data = [(f"P{p}", f, r, *[rng.normal(size=3).tolist() for _ in range(3)]) for p in range(3) for f in range(4) for r in range(5 + p * 14)]
    df = spark.createDataFrame(data, "pid string, frame int, res int, n array<double>, ca array<double>, c array<double>")
    got = {r[:3]: r[3] for r in rows(geometry.descriptors(df, 4))}
    assert len(got) == len(data)
    for p, f in (("P0", 0), ("P2", 3)):
        mine = [x for x in data if x[:2] == (p, f)]
        want = geometry.frame_descriptor(*[np.array([x[i] for x in mine]) for i in (3, 4, 5)], 4)
        assert np.allclose([got[p, f, x[2]] for x in mine], want)


def test_exports_and_command_line(spark, tmp_path):
    import strandmill
    from strandmill import cli

    assert all(getattr(strandmill, n) is not None for n in strandmill.__all__)
    spark.createDataFrame([("P", "ACX")], "pid string, seq string").write.parquet(str(tmp_path / "in"))
    cli.main(["--cores", "4", "--out", str(tmp_path / "out"), "tokenize", "residue", str(tmp_path / "in")])
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")).select("residue", "token"))) == [(0, 0), (1, 1), (2, 20)]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["unknown"])
