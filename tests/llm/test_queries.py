"""The operators for training data against brute force, and on difficult rows."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from strandmill.llm import clusters, frequency, grouping, leaks, mixing, overlaps, packed, quality, spans


def rows(df):
    return [tuple(r) for r in df.collect()]


def same(df, want):
    got = rows(df)
    assert len(got) == len(set(got))
    assert set(got) == set(want)


# 1 clusters

D = "desc_id bigint, d array<float>, id int, v string, lead bigint"


def brute_clusters(data, eps=2.0):
    ok = {}
    for i, d in data:
        if i is not None and d is not None and len(d) == 192 and all(x is not None for x in d) and np.isfinite(d).all():
            ok.setdefault(i, np.array(d, np.float32))
    ids = sorted(ok)
    if not ids:
        return set()
    x = np.stack([ok[i] for i in ids]).astype(float)
    d2 = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    a, b = np.nonzero(np.triu(d2 <= eps * eps, 1))
    root = clusters._roots(len(ids), a, b)
    n = np.bincount(root, minlength=len(ids))
    return {(ids[i], ids[root[i]]) for i in range(len(ids)) if n[root[i]] > 1}


def some_vectors(seed=0, hot=0):
    rng = np.random.default_rng(seed)
    data, i = [], 0
    for c in range(60):
        mid = rng.normal(size=192) * 0.6
        for _ in range(int(rng.integers(1, 5))):
            step = rng.normal(size=192)
            data.append((i, (mid + step / np.linalg.norm(step) * rng.uniform(0, 0.9)).astype(np.float32).tolist()))
            i += 1
    start = rng.normal(size=192) * 0.6
    for _ in range(30):  # a chain whose ends are far apart
        step = rng.normal(size=192)
        start = start + step / np.linalg.norm(step) * 1.9
        data.append((i, start.astype(np.float32).tolist()))
        i += 1
    mid = rng.normal(size=192) * 0.6
    for _ in range(hot):
        data.append((i, (mid + rng.normal(size=192) * 0.045).astype(np.float32).tolist()))
        i += 1
    return data


@pytest.mark.parametrize("hot,part", [(0, 8192), (150, 8192), (150, 40)])
def test_clusters(spark, monkeypatch, hot, part):
    monkeypatch.setattr(clusters, "PART", part)
    monkeypatch.setattr(clusters, "PIVOTS", 6)
    data = some_vectors(hot, hot)
    odd = [(None, data[0][1]), (9001, None), (9002, [1.0]), (9003, [float("nan")] + [0.0] * 191), (9004, [float("inf")] * 192), (9005, [None] + [0.0] * 191), data[5], (9006, data[5][1]), (9007, [1e30] * 192)]
    df = spark.createDataFrame([(i, d, 0, "x", 1) for i, d in data + odd], D)
    found = clusters.density_clusters(df)
    same(found, brute_clusters(data + odd))
    if hot and part > 1000:
        got = {r["cluster_id"]: r for r in clusters.cluster_summary(df, found).collect()}
        by = {}
        for i, c in rows(found):
            by.setdefault(c, []).append(i)
        vec = dict((i, np.array(d, float)) for i, d in data + odd if d is not None and len(d) == 192 and i is not None and i != 9005)
        for c, ids in by.items():
            x = np.stack([vec[i] for i in ids])
            assert got[c]["size"] == len(ids)
            far = ((x[:, None] - x[None]) ** 2).sum((1, 2))
            assert far[ids.index(got[c]["medoid_id"])] == pytest.approx(far.min(), rel=1e-6)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], D)
    assert rows(clusters.density_clusters(df)) == []
    assert rows(clusters.cluster_summary(df, clusters.density_clusters(df))) == []
    assert rows(clusters.density_clusters(spark.createDataFrame([(1, [0.0] * 192, 0, "", 1)], D))) == []


@pytest.mark.parametrize("norm", [1.0, 3.0, 3.9])
def test_clusters_of_small_norms(spark, norm):
    rng = np.random.default_rng(int(10 * norm))
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=192))
    data = []
    for i in range(60 if norm > 2 else 1):
        a = unit() * norm
        data += [(2 * i, a.astype(np.float32).tolist()), (2 * i + 1, (a + unit() * 1.95).astype(np.float32).tolist())]
    df = spark.createDataFrame([(i, d, 0, "x", 1) for i, d in data], D)
    same(clusters.density_clusters(df), brute_clusters(data))


@pytest.mark.parametrize("norm", [1.0, 1000.0])
def test_distances_at_the_limit(norm):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 192))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * norm).astype(np.float32)
    step = rng.normal(size=(300, 192))
    y = (x + step / np.linalg.norm(step, axis=1, keepdims=True) * (2 + rng.uniform(-1e-6, 1e-6, (300, 1)))).astype(np.float32)
    want = ((x[:, None].astype(float) - y[None].astype(float)) ** 2).sum(-1) <= 4
    assert (clusters._near(x, y, 2.0)[0] == want).all() and 0 < want.sum()
    both = np.concatenate([x, y])
    d2 = ((both[:, None].astype(float) - both[None].astype(float)) ** 2).sum(-1)
    a, b = np.nonzero(np.triu(d2 <= 4, 1))
    want = clusters._roots(len(both), a, b)
    for n in (200, 600):
        at = np.r_[0 : n // 2, 300 : 300 + n // 2]
        a, b = np.nonzero(np.triu(d2[np.ix_(at, at)] <= 4, 1))
        assert (clusters._linked(both[at], 2.0) == clusters._roots(len(at), a, b)).all()


@pytest.mark.parametrize("spread", [0.07, 0.1, 0.5])
def test_divided_groups(spark, monkeypatch, spread):
    monkeypatch.setattr(clusters, "PART", 60)
    monkeypatch.setattr(clusters, "PIVOTS", 5)
    rng = np.random.default_rng(int(spread * 100))
    walk = np.cumsum(rng.normal(size=(250, 192)) * 0.1, 0)  # a long thin group
    x = np.concatenate([rng.normal(size=(250, 192)) * spread, walk]).astype(np.float32)
    d2 = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    a, b = np.nonzero(np.triu(d2 <= 4, 1))
    want = clusters._roots(len(x), a, b)
    at = iter([pa.RecordBatch.from_arrays([clusters._bytes(x)], names=["v"])])
    rows_ = [(1 if i < 250 else 2, i, v, 250) for i, v in enumerate(next(at).column(0).to_pylist())]
    edges = rows(clusters._divided(spark.createDataFrame(rows_, "g bigint, id bigint, v binary, n bigint"), 192, 2.0))
    got = clusters._roots(len(x), np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int))
    one = [clusters._roots(250, *np.nonzero(np.triu(d2[i : i + 250, i : i + 250] <= 4, 1))) + i for i in (0, 250)]
    assert (got == np.concatenate(one)).all()


def test_linked_large_block():
    data = np.array([d for _, d in some_vectors(3, 400)], np.float32)
    d2 = ((data[:, None] - data[None]) ** 2).sum(-1)
    a, b = np.nonzero(np.triu(d2 <= 4, 1))
    assert (clusters._linked(data, 2.0) == clusters._roots(len(data), a, b)).all()


# 3 spans

BB = "pid string, seq string, field string, k bigint"
TOK = "tag string, level int, pid string, tokens array<bigint>, doc bigint, packed string"


def brute_spans(bb, tok):
    texts = {}
    for pid, seq, *_ in bb:
        if pid and pid.strip(" \t") and seq is not None:
            s = re.sub(r"[^A-Z]", "", seq.upper())
            k = ("seq", "", -1, pid.strip(" \t").upper())
            texts[k] = max(texts.get(k, ""), s, key=lambda t: (len(t), t))
    for tag, level, pid, t, *_ in tok:
        if pid and pid.strip(" \t") and t is not None:
            k = ("tokens", tag, level, pid.strip(" \t").upper())
            texts[k] = max(texts.get(k, ()), tuple(t), key=len)
    where = {}
    for k, t in texts.items():
        w = 30 if k[0] == "seq" else 20
        for i in range(len(t) - w + 1):
            where.setdefault((k[:3], t[i : i + w]), set()).add(k[3])
    out = set()
    for k, t in texts.items():
        w, lo, hi = 30 if k[0] == "seq" else 20, None, None
        for i in range(len(t) - w + 1):
            if len(where[k[:3], t[i : i + w]]) > 1:
                if lo is not None and i <= hi:
                    hi = i + w
                else:
                    if lo is not None:
                        out.add((*k, lo, hi))
                    lo, hi = i, i + w
        if lo is not None:
            out.add((*k, lo, hi))
    return out


def some_texts(seed):
    r = random.Random(seed)
    word = lambda n, a: [r.choice(a) for _ in range(n)]
    pool = [word(r.randrange(25, 90), "ACDEFGHIKL") for _ in range(12)]
    bb = []
    for i in range(40):
        s = word(r.randrange(0, 60), "ACDEFGHIKL")
        for _ in range(r.randrange(3)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            s += p[a : a + r.randrange(20, 70)] + word(r.randrange(0, 8), "ACDEFGHIKL")
        bb.append((f" p{i}\t" if i % 5 == 0 else f"P{i}", "".join(s).lower() if i % 3 == 0 else "-".join(["".join(s), "*"]), "x", 1))
    pool = [word(r.randrange(15, 60), range(8)) for _ in range(6)]
    tok = []
    for i in range(60):
        t = word(r.randrange(0, 30), range(300))
        for _ in range(r.randrange(3)):
            t += r.choice(pool)[r.randrange(10) :] + word(r.randrange(4), range(300))
        tok.append((r.choice("ab"), r.randrange(2), f"P{i}", t, 1, "x"))
    return bb, tok


@pytest.mark.parametrize("seed", range(3))
def test_spans(spark, seed):
    bb, tok = some_texts(seed)
    bb += [(None, "A" * 80, "", 0), ("N1", None, "", 0), ("N2", "", "", 0), ("R1", "AC" * 40, "", 0), ("R1", "AC" * 40, "", 0), ("R2", "AC" * 3000, "", 0), ("LOOP", "KKKKKRRRRR" * 20, "", 0)]
    tok += [("a", 0, "Z1", None, 0, ""), ("a", 0, "Z2", [], 0, ""), ("a", 0, "Z3", [-1] * 50, 0, ""), ("a", 0, "Z4", [-1] * 21 + [2**40] * 3, 0, ""), ("b", 0, "Z5", [-1] * 50, 0, ""), ("a", 0, None, [-1] * 50, 0, "")]
    tok += [("a", 1, f"H{i}", list(range(30)), 0, "") for i in range(60)]
    b, t = spark.createDataFrame(bb, BB), spark.createDataFrame(tok, TOK)
    want = brute_spans(bb, tok)
    found = spans.shared_spans(b, t)
    same(found, want)
    share = {r[:4]: r[4:] for r in rows(spans.shared_share(found, b, t))}
    for k in {w[:4] for w in want}:
        assert share[k][1] == sum(w[5] - w[4] for w in want if w[:4] == k)


def test_spans_of_nothing(spark):
    b, t = spark.createDataFrame([], BB), spark.createDataFrame([], TOK)
    assert rows(spans.shared_spans(b, t)) == []


def test_packing():
    for v in ([], [0, -128, 127], [300], [70000], [2**40, packed.NULL]):
        assert packed.unpack(packed.pack(np.array(v, np.int64))).tolist() == v


def test_minima_agree_on_equal_windows():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 3, 500)
    ends = np.array([0, 100, 100, 103, 500])
    h = packed.gear(v, 4)
    start, at = packed.minima(h, ends, 4, 7)
    assert len(start) == (100 - 9) + (397 - 9)
    seen = {}
    for s, p in zip(start, at):
        assert s <= p <= s + 6 and h[p] >> np.uint64(28) == min(h[s : s + 7]) >> np.uint64(28)
        assert seen.setdefault(tuple(v[s : s + 10]), p - s) == p - s


# 4 groups and splits

RB = "pid string, depositor string, study string, entity string, dataset string, seq string, lead_pid string, kind int"
SP = "split_name string, bucket string, pid string, lead_pid string"


def norm(x):
    if x is None or not re.search(r"\d", x):
        return None
    return re.sub(r"[^A-Z0-9]", "", x.upper())


def brute_groups(bb):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for pid, *rel in bb:
        p = (pid or "").strip(" \t").upper()
        if not p:
            continue
        parent.setdefault(p, p)
        for kind, v in enumerate(rel[:3]):
            if norm(v) is not None:
                q = seen.setdefault((kind, norm(v)), p)
                x, y = sorted((find(p), find(q)))
                parent[y] = x
    return {p: find(p) for p in parent}


def some_backbones(seed, n=120):
    r = random.Random(seed)
    pick = lambda k, m: r.choice([None, "", "unknown", "n/a", "none", f"{k}-{r.randrange(m)}", f" {k.lower()}_{r.randrange(m)} ", f"{k}{r.randrange(m)}."])
    bb = [(r.choice([f"P{i}", f"p{i} ", f"\tP{i}"]), pick("DEP", 60), pick("STU", 90), pick("ENT", 90), r.choice(["misato", None]), "A" * r.randrange(200), "x", 1) for i in range(n) for _ in range(r.choice([1, 1, 2]))]
    return bb + [(None, "DEP-1", None, None, None, None, "x", 1), (" ", "DEP-2", None, None, None, None, "x", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_groups_and_broken(spark, seed):
    bb = some_backbones(seed)
    if seed == 2:
        bb += [(f"H{i}", "DEP-777", None, None, "d", "AC", "x", 1) for i in range(200)]
    r = random.Random(seed + 50)
    names = [f"P{i}" for i in range(130)] + [f"H{i}" for i in range(200)] * (seed == 2)
    sp = [(s, r.choice(["train", " Train", "val\t", "TEST"]), r.choice([p, p.lower() + " "]), "x") for s in ("a", "b") for p in names if r.random() < 0.8]
    sp += [("a", None, "P1", "x"), ("a", "val", None, "x"), (None, "val", "P1", "x"), sp[0]]
    df = spark.createDataFrame(bb, RB)
    want = brute_groups(bb)
    g = grouping.groups(df)
    same(g, set(want.items()))
    listed = {(s, b.strip(" \t").lower(), p.strip(" \t").upper()) for s, b, p, _ in sp if s and b and p}
    buckets = {}
    for s, b, p in listed:
        if p in want:
            buckets.setdefault((s, want[p]), set()).add(b)
    splits = spark.createDataFrame(sp, SP)
    same(grouping.broken(splits, g), {(s, p, want[p]) for s, b, p in listed if p in want and len(buckets[s, want[p]]) > 1})
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), (None, 0.5)], "bucket string, share double")
    got = rows(grouping.assign(grouping.listings(splits).select("pid"), g, grouping.label_vectors(df), targets))
    assert sorted(p for p, *_ in got) == sorted({p for _, _, p in listed})
    assert all(lead == want.get(p, p) for p, lead, _ in got)
    by = {}
    for p, lead, b in got:
        assert by.setdefault(lead, b) == b
    size = max(sum(1 for _, x, _ in got if x == lead) for lead in by)
    for b, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(sum(1 for *_, x in got if x == b) - share * len(got)) <= max(size, 0.08 * len(got))


def test_assign_large_input_keeps_shares(spark):
    g = spark.range(4000).select(F.concat(F.lit("P"), "id").alias("pid"), F.concat(F.lit("P"), F.floor(F.col("id") / 2)).alias("lead_pid"))
    lab = g.select("pid", F.when(F.pmod(F.xxhash64("lead_pid"), F.lit(10)) == 0, "rare").otherwise("usual").alias("label"))
    t = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "bucket string, share double")
    a = grouping.assign(g.select("pid"), g, lab, t).join(lab, "pid")
    n = {tuple(r[:2]): r[2] for r in a.groupBy("label", "bucket").count().collect()}
    for x in ("rare", "usual"):
        total = sum(v for (y, _), v in n.items() if y == x)
        assert n[x, "train"] == pytest.approx(0.8 * total, abs=8) and n[x, "val"] == pytest.approx(0.1 * total, abs=8)
    assert a.groupBy("lead_pid").agg(F.count_distinct("bucket").alias("b")).where("b > 1").count() == 0


def test_assignment_report(spark):
    a = spark.createDataFrame([("P", "train"), ("Q", "train"), ("R", "val"), ("S", "train")], "pid string, bucket string")
    lab = spark.createDataFrame([("P", "x"), ("Q", "x"), ("R", "x"), ("R", "y")], "pid string, label string")
    t = spark.createDataFrame([("train", 3.0), (" VAL", 1.0), ("test", 0.0), (None, 1.0)], "bucket string, share double")
    got = {r[:2]: r[2:] for r in rows(grouping.assignment_report(a, lab, t))}
    assert got["train", None] == (3, 0.75, 0.75, 0.0) and got["val", "y"] == (1, 1.0, 0.25, 0.75) and got["test", "x"] == (0, 0.0, 0.0, 0.0) and len(got) == 12


def test_groups_of_nothing(spark):
    g = grouping.groups(spark.createDataFrame([], RB))
    assert rows(g) == [] and rows(grouping.broken(spark.createDataFrame([], SP), g)) == []
    t = spark.createDataFrame([("train", 1.0)], "bucket string, share double")
    assert rows(grouping.assign(spark.createDataFrame([], "pid string"), g, grouping.label_vectors(spark.createDataFrame([], RB)), t)) == []
    with pytest.raises(ValueError):
        grouping.assign(spark.createDataFrame([], "pid string"), g, g, t.limit(0))


# 5 frequencies

SIZES = "tag string, level int, m int, token int"


@pytest.mark.parametrize("sample", [1, 2000])
def test_token_counts(spark, monkeypatch, sample):
    monkeypatch.setattr(frequency, "SAMPLE", sample)
    r = random.Random(4)
    tok = [("a", 0, f"P{i}", [r.choice([0, 0, 1, 2, 3, 7, -1, 12]) for _ in range(r.randrange(30))], 1, "x") for i in range(50)]
    tok += [("a", 0, " p1", tok[1][3], 1, "x"), tok[2], ("a", 0, "Q", None, 1, "x"), ("a", 0, "R", [None, 2**45], 1, "x"), ("a", 1, "P1", [3], 1, "x"), ("z", 0, "P1", [5], 1, "x"), ("a", 0, "S", [], 1, "x")]
    sizes = [("a", 0, 10, 1), ("a", 1, 2, 1), ("b", 0, 3, 1)]
    recs = {}
    for tag, level, pid, t, *_ in tok:
        if t is not None:
            k = (tag, level, pid.strip().upper())
            recs[k] = max(recs.get(k, []), t, key=len)
    want = set()
    m = {s[:2]: s[2] for s in sizes}
    for g in {k[:2] for k in recs} | set(m):
        mine = [t for k, t in recs.items() if k[:2] == g]
        values = {v for t in mine for v in t if v is not None} | set(range(m.get(g, 0)))
        for v in values:
            n = sum(v in t for t in mine)
            code = g in m and 0 <= v < m[g]
            want.add((*g, v, sum(t.count(v) for t in mine), n, len(mine), code and n < 3, code and n > 0.9 * len(mine), g in m and not code and n > 0))
    got = frequency.token_counts(spark.createDataFrame(tok, TOK), spark.createDataFrame(sizes, SIZES))
    same(got, want)
    same(frequency.marked(got), {(*w[:3], x) for w in want for x, on in zip(("rare", "common", "invalid"), w[6:]) if on})


def test_counts_of_nothing(spark):
    none = spark.createDataFrame([], TOK)
    assert rows(frequency.token_counts(none, spark.createDataFrame([], SIZES))) == []
    got = rows(frequency.marked(frequency.token_counts(none, spark.createDataFrame([("a", 0, 2, 1)], SIZES))))
    assert sorted(got) == [("a", 0, 0, "rare"), ("a", 0, 1, "rare")]


# 6 overlaps

B6 = "pid string, seq string, dataset string, sid bigint, train boolean"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def mutated(r, s, n, even=False):
    s = list(s)
    spots = [int((i + 0.5) * len(s) / n) for i in range(n)] if even else [r.randrange(len(s)) for _ in range(n)]
    for p in sorted(spots, reverse=True):
        kind = 0 if even else r.randrange(3)
        if kind == 0:
            s[p] = r.choice([c for c in "ACDEFGHIKLMNPQRSTVWY" if c != s[p]])
        elif kind == 1:
            s.insert(p, r.choice("ACDEFGHIKLMNPQRSTVWY"))
        else:
            del s[p]
    return "".join(s)


@pytest.mark.parametrize("seed", range(2))
def test_cross_split(spark, seed):
    r = random.Random(seed)
    seqs = {}
    for i in range(25):
        s = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(r.choice([1, 5, 10, 13, 21, 30, 43, 44, 50, 90, 129, 131, 150, 260])))
        seqs[f"P{i}"] = s
        most = len(s) // 10
        for k in range(3):
            seqs[f"P{i}X{k}"] = mutated(r, s, r.choice([0, 1, most, most + 1]) if s else 0, even=k == 0) or "A"
    seqs |= {"SAME1": "MKV" * 30, "SAME2": "MKV" * 30, "LONG1": "ACDEFGHIKL" * 200, "LONG2": "ACDEFGHIKL" * 195}
    bb = [(f" {p.lower()}" if r.random() < 0.3 else p, "-".join([s[: len(s) // 2], s[len(s) // 2 :]]), r.choice(["misato", None]), 1, True) for p, s in seqs.items()]
    bb += [("NOSEQ", None, None, 1, True), ("EMPTY", "--", None, 1, True), (None, "ACD", None, 1, True), bb[0]]
    sp = [(n, r.choice(["train", "Train ", "val", "test"]), p, "x") for n in ("one", "two") for p in [*seqs, "NOSEQ", "GONE"] for _ in range(r.choice([0, 1, 1, 2]))]
    sp += [("one", "train", "NOSEQ", "x"), ("one", "val", "NOSEQ", "x"), ("one", "val", "EMPTY", "x"), ("one", None, "P1", "x"), ("one", "holdout", "P1", "x")]
    listed = {(n, p, b.strip().lower() == "train") for n, b, p, _ in sp if b and b.strip().lower() in ("train", "val", "test")}
    want = set()
    for n in ("one", "two"):
        t, e = ({p for m, p, x in listed if m == n and x == k and (p in seqs or p in ("NOSEQ", "EMPTY"))} for k in (True, False))
        want |= {(n, p, p) for p in t & e}
        for p in t & set(seqs):
            for q in e & set(seqs):
                a, b = seqs[p], seqs[q]
                if p != q and abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and 10 * edits(a, b) <= max(len(a), len(b)):
                    want.add((n, min(p, q), max(p, q)))
    b, s = spark.createDataFrame(bb, B6), spark.createDataFrame(sp, SP)
    same(overlaps.cross_split(b, s).drop("similarity"), want)


def test_coverage(spark):
    r = random.Random(9)
    a = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200))
    b = a[:100] + ("A" if a[100] != "A" else "C") + a[101:]  # one letter replaced
    c = a[:60] + a[63:]  # three letters less
    bb = [("T1", b, "misato", 0, True), ("T2", a, "other", 0, True), ("T3", c, "other", 0, True), ("E1", a, "x", 0, True), ("E2", "MKV" * 30, "x", 0, True), ("B", "ACDE" * 20, None, 0, True), ("N", None, "x", 0, True)]
    sp = [("s", "train", p, "") for p in ("T1", "T2", "T3", "B", "N")] + [("s", "val", p, "") for p in ("E1", "E2", "B", "N")]
    got = {x[:3]: x[3:] for x in rows(overlaps.coverage(spark.createDataFrame(bb, B6), spark.createDataFrame(sp, SP)))}
    assert got == {("s", "E1", "misato"): (1, 200, 199, 199 / 200), ("s", "E1", "other"): (2, 200, 200, 1.0), ("s", "B", None): (1, 80, 80, 1.0)}
    assert rows(overlaps.coverage(spark.createDataFrame([], B6), spark.createDataFrame([], SP))) == []


def test_cross_split_of_nothing(spark):
    b, s = spark.createDataFrame([], B6), spark.createDataFrame([], SP)
    assert rows(overlaps.cross_split(b, s)) == []


# 7 leaks

DOC = "doc_id bigint, text string, i int, t string, item_id int"
ITEM = "item_id bigint, text string, doc_id int, suite string"


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", t.lower()) if t else []


def brute_leaks(docs, items):
    grams = {}
    for i, t, *_ in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks(spark, monkeypatch):
    r = random.Random(1)
    w = lambda n: [r.choice(["Ä", "beta", "γ", "x1", "the", "of", "İ", "3d", "ende", "word"]) + str(r.randrange(40)) for _ in range(n)]
    items = [(i, r.choice([" ", ", ", "\n"]).join(w(r.choice([0, 1, 3, 8, 12, 13, 14, 40]))), 1, "val") for i in range(40)]
    items += [(100, None, 1, "val"), (101, "...", 1, "val"), items[5], (102, items[5][1], 1, "val"), (None, "a b", 1, "val")]
    docs = []
    for i in range(80):
        t = w(r.randrange(60))
        for _ in range(r.randrange(3)):
            x = words(r.choice(items[:40])[1])
            a = r.randrange(len(x) + 1)
            t += x[a : a + r.choice([5, 12, 13, 40])]
        docs.append((i, r.choice([" ", " - ", ";"]).join(t).upper(), 1, "x", 2))
    docs += [(200, None, 1, "", 1), (201, "", 1, "", 1), docs[3], (202, docs[3][1] * 50, 1, "", 1)]
    d, it = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    want = brute_leaks(docs, [x for x in items if x[0] is not None])
    for bits in (22, 4):  # small filters let nearly everything pass
        monkeypatch.setattr(leaks, "WORD_BITS", bits)
        monkeypatch.setattr(leaks, "SPAN_BITS", bits + 4)
        same(leaks.leaked(d, it).where("differing = 0").select("doc_id", "item_id"), want)


def test_leaks_with_replaced_words(spark):
    text = [f"w{i}" for i in range(13)]
    docs = []
    for a in range(13):
        t = list(text)
        t[a] = "other"
        docs.append((a, "before " + " ".join(t) + " after", 1, "", 1))
    far = ["x"] * 5 + text[5:]
    docs.append((50, " ".join(far), 1, "", 1))
    got = rows(leaks.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, " ".join(text), 1, "")], ITEM)))
    assert len(got) == 13 and all(r[1:] == (7, 1, 1, 13, 1) for r in got) and 50 not in {r[0] for r in got}


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 13])
def test_leaks_with_any_two_words_replaced(spark, n):
    text = [f"w{i}" for i in range(n)]
    places = [*combinations(range(n), 1), *combinations(range(n), 2)]
    changed = [*places, *combinations(range(n), 3)]
    docs = [(i, " ".join("other" if k in c else w for k, w in enumerate(text)), 1, "", 1) for i, c in enumerate(changed)]
    got = leaks.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, " ".join(text), 1, "")], ITEM))
    same(got, {(i, 7, len(c), 0, n, 1) for i, c in enumerate(places)})


def test_leaks_by_brute_force(spark):
    r = random.Random(2)
    w = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    items = [(i, w(r.choice([7, 8, 9, 12, 13, 14, 30]))) for i in range(30)]
    docs = []
    for i in range(150):
        x = r.choice(items)[1]
        a = r.randrange(max(1, len(x) - 12))
        x = list(x[a : a + 15])
        for _ in range(r.randrange(5)):
            x[r.randrange(len(x))] = r.choice(["other", *w(1)])
        docs.append((i, w(r.randrange(5)) + x + w(5)))
    want = set()
    for d, t in docs:
        for i, x in items:
            n = min(13, len(x))
            pairs = [(sum(p != q for p, q in zip(t[k : k + n], x[j : j + n])), k) for k in range(len(t) - n + 1) for j in range(len(x) - n + 1)]
            near = [(c, k) for c, k in pairs if c <= (2 if n >= 8 else 0)]
            if near:
                want.add((d, i, *min(near), n, len({k for _, k in near})))
    assert {x[2] for x in want} == {0, 1, 2}
    d = spark.createDataFrame([(i, " ".join(t), 1, "", 1) for i, t in docs], DOC)
    same(leaks.leaked(d, spark.createDataFrame([(i, " ".join(t), 1, "") for i, t in items], ITEM)), want)


def test_leaks_of_nothing(spark):
    d, it = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert rows(leaks.leaked(d, it)) == []
    assert rows(leaks.leaked(d, spark.createDataFrame([(1, "a", 1, "")], ITEM))) == []


# 8 mixing

SIZED = "doc_id bigint, source string, tokens bigint"
TARGET = "source string, share double, max_repeats int, size int, tokens int"


def test_states(spark):
    sizes = [(i, s, n) for i, (s, n) in enumerate([("a", 50)] * 10 + [("b", 10)] * 10 + [("c", 5)] * 10 + [("d", 25)] * 10 + [("empty", 0)] + [(None, 999)])]
    t = [("A ", 0.5, 1, 0, 0), ("b", 0.3, 4, 0, 0), ("c", 0.2, 2, 0, 0), ("gone", 0.1, 2, 0, 0), ("empty", 0.1, 9, 0, 0), (None, 0.5, 1, 0, 0), ("b", 0.1, 9, 0, 0), ("nul", None, 1, 0, 0)]
    rep = mixing.queue_report(spark.createDataFrame(sizes, SIZED), spark.createDataFrame(t, TARGET))
    got = {r["source"]: r["state"] for r in rep.collect()}
    assert got == {"a": "sampled", "b": "repeated", "c": "short", "d": "untargeted", "gone": "absent", "empty": "short"}


def test_states_are_the_queues(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, "ab"[i % 2], i % 7) for i in range(200)], SIZED)
    t = spark.createDataFrame([("a", 0.2, 1, 0, 0), ("b", 0.8, 2, 0, 0)], TARGET)
    seen = []
    running = mixing._running
    monkeypatch.setattr(mixing, "_running", lambda d, seed: seen.append(running(d, seed)) or seen[-1])
    got = {r["source"]: r for r in mixing.queue_report(sizes, t).collect()}
    last = {}
    for r in seen[0].collect():
        last[r["source"]] = max(last.get(r["source"], 0), r["run"] / {"a": 0.2, "b": 0.8}[r["source"]])
    assert {k: r["lap"] for k, r in got.items()} == last
    assert {k: r["state"] for k, r in got.items()} == {"a": "sampled", "b": "repeated"}
    whole = mixing.mix(sizes, t, 10**9)
    first = {r["source"]: r["f"] for r in whole.where("copy = 0").groupBy("source").agg(F.max("finish").alias("f")).collect()}
    assert first == last


@pytest.mark.parametrize("budget", [None, 0, 137, 3000, 10**9])
def test_mix_is_the_queue(spark, budget):
    r = random.Random(2)
    sizes = [(i, r.choice("aaaaaabbc"), r.randrange(0, 30)) for i in range(300)]
    t = [("a", 0.5, 1, 0, 0), ("b", 0.3, 3, 0, 0), ("c", 0.2, 2, 0, 0), ("none", 0.2, 2, 0, 0)]
    df = spark.createDataFrame(sizes, SIZED)
    got = sorted(rows(mixing.mix(df, spark.createDataFrame(t, TARGET), budget)), key=lambda x: (x[4], x[1], x[0], x[2]))
    order = {x[0]: x[1] for x in rows(df.select("doc_id", F.xxhash64(F.lit(17), "doc_id")))}
    queue, size = [], {}
    for s, share, laps, *_ in t:
        mine = sorted((x for x in sizes if x[1] == s), key=lambda x: (order[x[0]], x[0]))
        total = size[s] = sum(x[2] for x in mine)
        run = 0
        for d, _, n in mine:
            run += n
            queue += [(d, s, k, n, (run + k * total) / share) for k in range(laps)]
    if budget is None:
        every = sum(x[2] for x in sizes)
        budget = int(sum(min(share * every, laps * size[s]) for s, share, laps, *_ in t))
    want, used = [], 0
    for x in sorted(queue, key=lambda x: (x[4], x[1], x[0], x[2])):
        used += x[3]
        if used > budget:
            break
        want.append(x)
    assert [g[:4] for g in got] == [w[:4] for w in want]


def test_mix_of_nothing(spark):
    none, t = spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 1.0, 2, 0, 0)], TARGET)
    assert rows(mixing.mix(none, t)) == []
    assert [(r["source"], r["state"]) for r in mixing.queue_report(none, t).collect()] == [("a", "absent")]
    assert rows(mixing.queue_report(none, t.limit(0))) == []


def test_sizes(spark):
    docs = spark.createDataFrame([(1, None, " Lab\t"), (2, "", "lab"), (3, "hello world", None), (4, "<|endoftext|> " + "ab" * 5000, " ")], "doc_id bigint, text string, source string")
    got = {r[0]: r[1:] for r in rows(mixing.sized(docs))}
    assert got[1] == ("lab", 0) and got[2] == ("lab", 0) and got[3] == (None, 2) and got[4][0] is None and got[4][1] > 100


# 9 quality

Q = "doc_id bigint, text string, w string, words int, lines string, n_words int"
COMMON = {"the", "of", "und", "ist", "a"}


def brute_prose(text):
    if text is None:
        return None
    blank = " \t\r\n\u00a0"
    w = words(text)
    solid = [c for c in text if c not in blank]
    lines = [x.strip(blank) for x in text.split("\n") if x.strip(blank)]
    out = []
    if len(w) < 20:
        out.append("n_words")
    if w and not 3.4 <= sum(map(len, w)) / len(w) <= 7.0:
        out.append("word_len")
    if w and sum(x in COMMON for x in w) / len(w) < 0.2:
        out.append("common")
    if solid and sum(not regex.match(r"[\p{L}\p{N}]", c) for c in solid) / len(solid) > 0.12:
        out.append("symbols")
    if lines and sum(x[-1] in ".!?" for x in lines) / len(lines) < 0.5:
        out.append("line_end")
    return out if len(out) > 1 else []


@pytest.mark.parametrize("in_place", [20_000, 2])
def test_prose(spark, monkeypatch, in_place):
    monkeypatch.setattr(quality, "MAX_IN_PLACE", in_place)
    r = random.Random(6)
    parts = ["the", "of", "Und", "ist", "naïve", "1.5", "Å", "x", "longerwords", "##", "|", "\n", "\r\n", "\u00a0", "x\u00a0", " ", "\t", ". ", "!\n", "?  \n", "—", "İstanbul", "é"]
    docs = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(90))), "x", 1, "y", 2) for i in range(200)]
    docs += [(900, None, "", 0, "", 0), (901, "", "", 0, "", 0), (902, "  \n", "", 0, "", 0), (903, "the of a. " * 20_000, "", 0, "", 0), docs[0], (904, "- x\n" * 40, "", 0, "", 0), (905, "same line here\n" * 30, "", 0, "", 0)]
    common = spark.createDataFrame([(w, "en") for w in COMMON] + [("the", "de"), (None, "en")], "word string, lang string")
    df = spark.createDataFrame(docs, Q)
    stats = quality.text_stats(df, common)
    same(quality.not_prose(stats), {(d, s) for d, t, *_ in docs for s in brute_prose(t) or ()})
    got = {r["doc_id"]: r for r in stats.collect()}
    assert got[900]["kind"] is None and got[903]["kind"] == "junk" and got[903]["n_words"] == 60_000 and got[904]["kind"] == "boilerplate" and got[905]["dup_lines"] == pytest.approx(29 / 30)
    top = {r[0]: r[1:] for r in rows(quality.ngram_coverage(df))}
    assert top[900] == (None, None) and top[905] == ("same line here", 1.0)


def test_repetition_inside_a_line(spark):
    filler = " ".join(f"natural{i}" for i in range(70))
    texts = {
        1: "click to expand " * 30,
        2: ("the natural word of " * 30).strip() + ".",
        3: filler + " read the whole" * 7 + ".",
        4: " ".join(f"the natural{i}" for i in range(20)) + ".",
        5: "click to expand " * 6,
        6: "one two",
        7: None,
        8: "",
        9: "İ Å3 naïve " * 20,
        10: "of a the " * 20,
    }
    df = spark.createDataFrame([(i, t, "", 0, "", 0) for i, t in texts.items()], Q)
    got = {r["doc_id"]: r for r in quality.text_stats(df, spark.createDataFrame([("the",), ("to",)], "word string")).collect()}
    assert {i: r["top_share"] for i, r in got.items()} == pytest.approx({r["doc_id"]: r["top_share"] for r in quality.ngram_coverage(df).collect()})
    assert [got[i]["kind"] for i in (1, 2)] == ["boilerplate"] * 2
    assert got[3]["kind"] == "junk" and 0.1 < got[3]["top_share"] < 0.3  # few common words
    assert got[4]["kind"] == "prose"
    assert got[5]["kind"] != "boilerplate" and got[5]["n_words"] == 18 and got[5]["top_share"] == 1.0
    assert got[6]["top_share"] is None and got[7]["kind"] is None and got[8]["top_share"] is None
    assert got[10]["kind"] == "junk" and got[10]["top_share"] == 1.0  # no natural words


def test_common_words_by_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the of x", "", 0, "", 0), (1, "the of x", "", 0, "", 0), (1, "x y", "", 0, "", 0), (None, "a the", "", 0, "", 0), (None, None, "", 0, "", 0)], Q)
    common = spark.createDataFrame([("the",), ("of",), ("a",)], "word string")
    got = []
    for most in (20_000, 1):
        monkeypatch.setattr(quality, "MAX_IN_PLACE", most)
        got.append(sorted(((r["doc_id"], r["n_words"], r["common"]) for r in quality.text_stats(docs, common).collect()), key=repr))
    assert got[0] == got[1] == sorted([(1, 3, 2 / 3), (1, 3, 2 / 3), (1, 2, 0.0), (None, 2, 1.0), (None, None, None)], key=repr)


def test_quality_of_nothing(spark):
    none = quality.text_stats(spark.createDataFrame([], Q), spark.createDataFrame([], "word string"))
    assert rows(none) == [] and rows(quality.not_prose(none)) == []
    one = quality.text_stats(spark.createDataFrame([(1, "a b. " * 20, "", 1, "", 1)], Q), spark.createDataFrame([], "word string"))
    assert set(rows(quality.not_prose(one))) == {(1, "word_len"), (1, "common"), (1, "symbols")}
