"""Clusters of mutually similar vectors, and their most typical members."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.llm.packed import mix
from strandmill.operators.graph import components
from strandmill.session import Scratch

#: Vectors are reduced to so many dimensions for the partitions.
REDUCED = 48
#: Overlapping partitions of the reduced space, and directions that make up a cell of each.
PARTITIONS, DEPTH = 26, 3
#: Cells tell directions apart, so they part close rows near the origin: rows up to so many eps share one more cell.
CENTRE = 3.0
#: Dimensions of the sketch that travels with a row.  A pair at the limit keeps less than SHARE of its
#: squared distance in the sketch but for a chance of 9e-6, the tail of Beta(8, 88).
SKETCH, SHARE = 16, 0.25
#: Buckets with more rows are first covered by leaders.
SMALL = 48
#: Candidate groups with more rows are split by PIVOTS of their rows, at most ROUNDS times.
PART, PIVOTS, ROUNDS = 8_192, 32, 4
EDGE = np.iinfo(np.int64).min
#: A task contracts its pairs whenever it holds so many.
FOREST = 1_000_000


def _turns(seed: int, dim: int, out: int, n: int) -> list[np.ndarray]:
    """n random orthonormal bases of `out` columns."""
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :out].astype(np.float32) for _ in range(n)]


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with `dim` finite numbers, and their matrix."""
    column = column.cast(pa.list_(pa.float32()))
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    ok = np.diff(ends) == dim
    if column.null_count:
        ok &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    x = values[ends[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim), np.float32)
    fine = np.isfinite(x).all(1)
    return rows[fine], np.ascontiguousarray(x[fine], np.float32)


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    same = (half.astype(np.float32) == x).all(1)
    return pa.array([half[i].tobytes() if same[i] else x[i].tobytes() for i in range(len(x))], pa.binary())


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    out = np.empty((len(column), dim), np.float32)
    for i, v in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(v, np.float16 if len(v) == 2 * dim else np.float32)
    return out


def _cover(s: np.ndarray, near: float, link: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaders of the rows of s: each row's leader, within `near` of it, and pairs of leaders within `link`."""
    n = len(s)
    lead = np.full(n, -1, np.int64)
    leaders: list[int] = []
    left = np.arange(n)
    while len(left):
        i = left[0]
        d = ((s[left] - s[i]) ** 2).sum(1)
        close = d <= near * near
        lead[left[close]] = i
        leaders.append(i)
        left = left[~close]
    at = np.array(leaders, np.int64)
    a, b = [], []
    for i in range(0, len(at) if link else 0, 512):
        block = s[at[i : i + 512]]
        d = (block**2).sum(1)[:, None] + (s[at] ** 2).sum(1)[None] - 2 * block @ s[at].T
        p, q = np.nonzero(d <= link * link)
        keep = p + i < q
        a.append(at[p[keep] + i])
        b.append(at[q[keep]])
    return lead, np.concatenate(a) if a else at[:0], np.concatenate(b) if b else at[:0]


def _links(s: np.ndarray, loose: np.ndarray, near: float, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect all rows of s within tau of each other, without enumerating a dense part's pairs.

    Rows join their leader; leaders join where they, or any of their rows, are within tau.  A loose row stands
    for others within `near` of it, so tau grows by `near` for each loose row of a pair.
    """
    slack = near * loose
    lead, p, q = _cover(s, near, tau + 4 * near)
    if not len(p):
        return np.arange(len(s)), lead
    d = np.sqrt(((s[p] - s[q]) ** 2).sum(1))
    sure = d <= tau + slack[p] + slack[q]
    root = _roots(len(s), p[sure], q[sure])
    a, b = [np.arange(len(s)), p[sure]], [lead, q[sure]]
    balls: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(~sure)[np.argsort(d[~sure])]:
        if root[p[i]] == root[q[i]]:
            continue
        m, o = (balls.setdefault(int(j), np.flatnonzero(lead == j)) for j in (p[i], q[i]))
        if len(m) == len(o) == 1:
            continue
        limit = tau + slack[o]
        for j in range(0, len(m), 512):
            if (_squares(s[m[j : j + 512]], s[o]) <= (limit[None] + slack[m[j : j + 512], None]) ** 2).any():
                root[root == max(root[p[i]], root[q[i]])] = min(root[p[i]], root[q[i]])
                a.append(p[i : i + 1])
                b.append(q[i : i + 1])
                break
    return np.concatenate(a), np.concatenate(b)


def _cells(dim: int, eps: float, seed: int):
    """id, d -> k, id, s1, s2: the row under its cell of every partition, with its sketch.

    Cells are Voronoi cells of the reduced, randomly turned vectors: DEPTH times the direction they
    lie furthest along.  Where many rows of a batch share a cell, rows close to a leader are
    replaced by an edge to it (s2 = EDGE, s1 = the leader), so a dense cell sends few rows to its task.
    The lowest bit of s2 marks a leader that stands for others.  Rows with a norm of at most CENTRE * eps are
    under one more cell, all together.
    """
    unit = eps / 64
    near, tau = 0.15 * eps, eps * SHARE**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = _turns(seed, dim, REDUCED, PARTITIONS)
        turn = _turns(seed + 1, REDUCED, REDUCED, PARTITIONS * (DEPTH - 1))
        sketch = _turns(seed + 2, dim, SKETCH, 1)[0]
        for b in batches:
            rows, x = vectors(b.column(1), dim)
            if not len(rows):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            s = np.clip(np.rint(x @ sketch / np.float32(unit)), -127, 127).astype(np.int8)
            words = np.ascontiguousarray(s).view(np.int64)
            words[:, 1] &= ~1
            real = s.astype(np.float32) * np.float32(unit)
            out: list[list[np.ndarray]] = [[], [], [], []]
            centre = np.square(x, dtype=np.float64).sum(1) <= (CENTRE * eps) ** 2
            for t in range(PARTITIONS + 1):
                use = np.ones(len(rows), bool) if t < PARTITIONS else centre
                if not use.any():
                    continue
                k = np.full(len(rows), np.uint64(t + 1), np.uint64)
                y = x @ small[t] if t < PARTITIONS else None
                for j in range(DEPTH if t < PARTITIONS else 0):
                    z = y if not j else y @ turn[t * (DEPTH - 1) + j - 1]
                    a = np.abs(z).argmax(1)
                    side = z[np.arange(len(z)), a] > 0
                    k = k * np.uint64(4 * REDUCED) + (2 * a + side).astype(np.uint64)
                k = mix(k).view(np.int64)
                order = np.argsort(k, kind="stable")
                order = order[use[order]]
                cuts = np.flatnonzero(np.diff(k[order])) + 1
                lo, hi = np.append(0, cuts), np.append(cuts, len(order))
                send, stands = use.copy(), np.zeros(len(rows), np.int64)
                for i in np.flatnonzero(hi - lo > SMALL):
                    own = order[lo[i] : hi[i]]
                    lead, _, _ = _cover(real[own], near, 0)
                    gone = lead != np.arange(len(own))
                    send[own[gone]] = False
                    stands[own[lead[gone]]] = 1
                    out[0].append(ids[own[gone]])
                    out[1].append(ids[own[gone]])
                    out[2].append(ids[own[lead[gone]]])
                    out[3].append(np.full(int(gone.sum()), EDGE))
                out[0].append(k[send])
                out[1].append(ids[send])
                out[2].append(words[send, 0])
                out[3].append(words[send, 1] | stands[send])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["k", "id", "s1", "s2"])

    return run, (unit, near, tau)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by a column, cut so that no value of it is in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.concat_batches(held)
            held = []
        others = np.flatnonzero(k != k[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _candidates(unit: float, near: float, tau: float):
    """k, id, s1, s2 sorted by k -> a, b: pairs of a cell whose sketches are close enough, and passed edges.

    The pairs that a task finds in all its cells are contracted to a forest before they go on.
    """

    def forest(pairs: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(pairs)
        nodes, at = np.unique(both, return_inverse=True)
        at = at.reshape(both.shape)
        root = _roots(len(nodes), at[:, 0], at[:, 1])
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return np.stack([nodes[root[own]], nodes[own]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in _whole_groups(batches, 0):
            k, ids, s1, s2 = (b.column(i).to_numpy() for i in range(4))
            edge = s2 == EDGE
            left, right = [ids[edge]], [s1[edge]]
            k, ids, s1, s2 = k[~edge], ids[~edge], s1[~edge], s2[~edge]
            loose = s2 & 1
            s = np.stack([s1, s2 & ~1], 1).view(np.int8).reshape(len(k), SKETCH).astype(np.float32) * np.float32(unit)
            cuts = np.flatnonzero(np.diff(k)) + 1
            lo, hi = np.append(0, cuts), np.append(cuts, len(k))
            n = np.repeat(hi - lo, hi - lo)
            place = np.arange(len(k)) - np.repeat(lo, hi - lo)
            for shift in range(1, SMALL):
                i = np.flatnonzero((place >= shift) & (n <= SMALL))
                if not len(i):
                    break
                close = ((s[i] - s[i - shift]) ** 2).sum(1) <= (tau + near * (loose[i] + loose[i - shift])) ** 2
                left.append(ids[i[close]])
                right.append(ids[i[close] - shift])
            for g in np.flatnonzero(hi - lo > SMALL):
                own = ids[lo[g] : hi[g]]
                p, q = _links(s[lo[g] : hi[g]], loose[lo[g] : hi[g]], near, tau)
                left.append(own[p])
                right.append(own[q])
            held.append(np.stack([np.concatenate(left), np.concatenate(right)], 1))
            if sum(map(len, held)) > FOREST:
                held = [forest(held)]
                if len(held[0]) > FOREST // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held[0].T], names=["a", "b"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in forest(held).T], names=["a", "b"])

    return run


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T)


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x and y are within eps, as the differences in double precision have it, and the squared distances.

    The distances are a matrix product over the rows from the first one on; where its error could decide, the
    differences themselves are squared.
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    a, b = x - x[0], y - x[0]
    m, n = (a**2).sum(1), (b**2).sum(1)
    sq = m[:, None] + n[None] - 2 * a @ b.T
    p, q = np.nonzero(np.abs(sq - eps * eps) <= 1e-12 * (m[:, None] + n[None] + eps * eps))
    for i in range(0, len(p), 8192):
        j = slice(i, i + 8192)
        sq[p[j], q[j]] = ((x[p[j]] - y[q[j]]) ** 2).sum(1)
    return sq <= eps * eps, np.maximum(sq, 0)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is connected to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def _linked(x: np.ndarray, eps: float, label: np.ndarray | None = None) -> np.ndarray:
    """Exact density clusters of a block: the root of every row of x; rows of one label are joined from the start.

    Every row is similar to its leader.  Only leaders within 3 eps of each other can have similar rows, and
    of these rows only those within 2 eps of the other leader; they are compared where nothing has joined the leaders yet.
    """
    n = len(x)
    edges = []
    if label is not None:
        _, first, own = np.unique(label, return_index=True, return_inverse=True)
        edges.append(np.stack([first[own], np.arange(n)], 1))
    if n <= 256:
        edges.append(np.stack(np.nonzero(np.triu(_near(x, x, eps)[0], 1)), 1))
        return _roots(n, *np.concatenate(edges).T)
    lead, left, at = np.full(n, -1), np.arange(n), []
    while len(left):
        close = _near(x[left[:1]], x[left], eps)[0][0]
        lead[left[close]] = left[0]
        at.append(left[0])
        left = left[~close]
    at = np.array(at)
    edges.append(np.stack([lead, np.arange(n)], 1))
    root = _roots(n, *np.concatenate(edges).T)
    balls = {int(i): np.flatnonzero(lead == i) for i in at}
    pairs = []
    for i in range(0, len(at), 512):
        d = _near(x[at[i : i + 512]], x[at], eps)[1]
        p, q = np.nonzero(d <= 9.000001 * eps * eps)
        keep = p + i < q
        pairs.append(np.stack([d[p[keep], q[keep]], at[p[keep] + i], at[q[keep]]], 1))
    pairs = np.concatenate(pairs)
    for _, u, v in pairs[np.argsort(pairs[:, 0])]:
        u, v = int(u), int(v)
        if root[u] == root[v]:
            continue
        m, o = (balls[i][_near(x[j : j + 1], x[balls[i]], eps)[1][0] <= 4.000001 * eps * eps] for i, j in ((u, v), (v, u)))
        if len(o) and any(_near(x[m[j : j + 512]], x[o], eps)[0].any() for j in range(0, len(m), 512)):
            keep, drop = min(root[u], root[v]), max(root[u], root[v])
            root[root == drop] = keep
    return root


def _parts(dim: int, eps: float):
    """g, id, comp, v sorted by g -> id, comp, root: exact clusters of each group, named by their smallest comp.

    Rows of one comp are known to be one cluster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches, 0):
            g, ids, comp = (b.column(i).to_numpy() for i in range(3))
            order = np.lexsort((comp, ids, g))
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[order][1:] != g[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[fresh]
            order = order[np.lexsort((ids[order], comp[order], g[order]))]  # a cluster's least row has its least comp
            g, ids, comp = g[order], ids[order], comp[order]
            x = _floats(b.column(3).take(pa.array(order)), dim)
            cuts = np.flatnonzero(np.diff(g)) + 1
            lo, hi = np.append(0, cuts), np.append(cuts, len(g))
            small = np.repeat(hi - lo <= SMALL, hi - lo)
            place = np.arange(len(g)) - np.repeat(lo, hi - lo)
            a, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for shift in range(1, SMALL):
                i = np.flatnonzero((place >= shift) & small)
                if not len(i):
                    break
                for j in range(0, len(i), 8192):
                    k = i[j : j + 8192]
                    close = (((x[k].astype(np.float64) - x[k - shift]) ** 2).sum(1) <= eps * eps) | (comp[k] == comp[k - shift])
                    a.append(k[close])
                    c.append(k[close] - shift)
            root = _roots(len(g), np.concatenate(a), np.concatenate(c))
            for i in np.flatnonzero(hi - lo > SMALL):
                root[lo[i] : hi[i]] = lo[i] + _linked(x[lo[i] : hi[i]], eps, comp[lo[i] : hi[i]])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comp), pa.array(comp[root])], names=["id", "comp", "root"])

    return run


def _chunks_of(batches: Iterator[pa.RecordBatch], dim: int):
    """c, kind, g, id, comp, v sorted by c and kind -> (g, (ids, comps, vectors) of the pivots, the same of the rows)."""
    for b in _whole_groups(batches, 0):
        c, kind, g, ids, comp = (b.column(i).to_numpy() for i in range(5))
        cuts = np.flatnonzero(np.diff(c)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(c))):
            x = _floats(b.column(5).slice(lo, hi - lo), dim)
            n = int((kind[lo:hi] == 0).sum())
            yield g[lo], (ids[lo : lo + n], comp[lo : lo + n], x[:n]), (ids[lo + n : hi], comp[lo + n : hi], x[n:])


def _absorbed(dim: int, eps: float):
    """Pivots and rows of a chunk -> g, id, part, comp, a, b: edges (a, b) between comps, as a forest, and where each row has to be.

    A row within eps of a pivot is of the pivot's comp and belongs to the part of its nearest pivot; all others are of
    part -1.  Copies go where rows of another comp may be similar: these lie within eps of their pivot q, so the row is
    within 2 eps of q, and within eps of the plane between q and its own pivot.  Two rows that pivots have absorbed
    meet in the later pivot's part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, (_, pc, px), (ids, rc, rx) in _chunks_of(batches, dim):
            if not len(rc) or not len(pc):
                continue
            close, sq = _near(rx, px, eps)
            nodes, at = np.unique(np.concatenate([pc, rc]), return_inverse=True)
            p, q = np.nonzero(close)
            root = _roots(len(nodes), at[len(pc) + p], at[q])
            own = np.flatnonzero(root != np.arange(len(nodes)))
            mine = sq.argmin(1)
            least = sq[np.arange(len(sq)), mine]
            held = least <= eps * eps
            apart = np.sqrt(_near(px, px, eps)[1])
            copy = (sq <= 4.000001 * eps * eps) & (sq - least[:, None] <= 2 * eps * apart[mine] * (1 + 1e-9) + 1e-9 * (1 + sq))
            later = (np.arange(len(pc))[None] > mine[:, None]) & (root[at[: len(pc)]][None] != root[at[mine]][:, None])
            r, q = np.nonzero(copy & (later | ~held[:, None]))
            comp = np.where(held, pc[mine], rc)
            n, m = len(own), len(ids) + len(r)
            out = [np.full(n + m, g), np.append(np.zeros(n, np.int64), np.append(ids, ids[r])), np.append(np.zeros(n, np.int64), np.append(np.where(held, mine, -1), q))]
            out += [np.append(np.zeros(n, np.int64), np.append(comp, comp[r])), np.append(nodes[root[own]], np.zeros(m, np.int64)), np.append(nodes[own], np.zeros(m, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["g", "id", "part", "comp", "a", "b"])

    return run


def _solved(work: DataFrame, dim: int, eps: float) -> DataFrame:
    """(a, b): comps of `work` (g, id, comp, v) that are one cluster, each group in one task."""
    out = work.select("g", "id", "comp", "v").repartition("g").sortWithinPartitions("g").mapInArrow(_parts(dim, eps), "id bigint, comp bigint, root bigint")
    return out.where("comp <> root").select(F.col("root").alias("a"), F.col("comp").alias("b")).distinct()


def _divided(work: DataFrame, dim: int, eps: float) -> DataFrame:
    """(a, b): ids of `work` (g, id, v, n), the rows of groups of n > PART rows, that are one cluster, as a forest's edges.

    Every row within eps of a pivot is joined to it, so a dense group is one cluster by its shared core points
    alone, in as many tasks as it has PART rows.  Where that leaves several comps, the group is divided into
    the cells of its pivots, with margins, and the rows that no pivot holds; cells of one comp are done, the
    others are clustered locally and merged through the rows they share.  What is still large is divided
    again, unless it holds nearly all of its group.
    """
    scratch = Scratch(work.sparkSession)
    work = scratch.write(work.select("g", "id", F.col("id").alias("comp"), "v", "n"), "large")
    edges: list[DataFrame] = []
    for last in [False] * (ROUNDS - 1) + [True]:
        h, salts = F.xxhash64("id"), F.ceil(F.col("n") / PART)
        pivots = work.groupBy("g", "n", F.pmod(h, F.lit(PIVOTS)).alias("i")).agg(F.min(F.struct(h.alias("h"), "id", "comp", "v")).alias("p"))
        pivots = pivots.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("s"), "p.*")
        rows = work.select(F.xxhash64("g", F.pmod(F.xxhash64("id", F.lit(5)), salts)).alias("c"), F.lit(1).alias("kind"), "g", "id", "comp", "v")
        both = pivots.select(F.xxhash64("g", "s").alias("c"), F.lit(0).alias("kind"), "g", "id", "comp", "v").unionByName(rows)
        both = both.repartition("c").sortWithinPartitions("c", "kind", "id")
        seen = scratch.write(both.mapInArrow(_absorbed(dim, eps), "g bigint, id bigint, part bigint, comp bigint, a bigint, b bigint"), "absorbed")
        edges.append(seen.where("a <> b").select("a", "b"))
        names = components(edges[-1])
        places = seen.where("a = b").select("g", "id", "part", "comp").join(names, F.col("comp") == F.col("node"), "left")
        places = scratch.write(places.select("g", "id", "part", F.coalesce("lead", "comp").alias("comp")), "places")
        open_ = places.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        open_ = scratch.write(open_.select("g", "part", "n"), "open")
        if not open_.take(1):
            break
        sizes = work.select("g", F.col("n").alias("most")).distinct()
        again = (F.col("n") > PART) & (F.col("n") < 0.9 * F.col("most")) & F.lit(not last)
        open_ = open_.join(sizes, "g").select("g", "part", "n", again.alias("again"))
        wanted = places.join(open_, ["g", "part"]).select(F.xxhash64("g", "part").alias("g"), "id", "comp", "n", "again")
        parts = scratch.write(wanted.join(work.select("id", "v").dropDuplicates(["id"]), "id"), "parts")
        edges.append(scratch.write(_solved(parts.where("NOT again"), dim, eps), "solved"))
        work = parts.where("again").select("g", "id", "comp", "v", "n")
        if not work.take(1):
            break
    return reduce(DataFrame.union, edges)


def density_clusters(rows: DataFrame, eps: float = 2.0, dim: int = 192, id: str = "desc_id", column: str = "d", seed: int = 11) -> DataFrame:
    """(desc_id, cluster_id): the rows in clusters of two or more; cluster_id is the smallest id in it.

    Two rows are similar at a Euclidean distance of at most `eps`; clusters are the sets connected
    through similar pairs (every row with a neighbour is a core point).

    Cases: rows whose vector is null, of another length or not finite, and rows with a null id are left
    out; repeated rows of an id (the same vector) count once; equal vectors under several ids are similar;
    an empty table gives no rows; further columns are ignored.

    1. Vectors are reduced by random orthonormal bases, which never lengthen a distance, and the
       reduced space is cut into Voronoi cells in PARTITIONS overlapping ways.  Cells go by direction, so the
       chance that a pair at the limit has no common cell hangs on norm / eps: simulated at 1.95 for eps 2,
       2e-5 at a norm of 8, 3e-4 at 6.6, 0.7 % at 5, 4 % at 4; closer pairs are met far more surely.  Pairs with a
       norm of at most (CENTRE - 1) * eps are always in a common cell, that of the rows near the origin.
    2. Within a cell only rows with close sketches become candidates, which a pair at the limit is but for a
       chance of 9e-6.  Dense cells are covered by
       leaders, before the shuffle and after it, so no group's pairs are enumerated.
    3. Candidates are connected into groups (a superset of the clusters), and each is clustered exactly on
       the whole vectors.
    4. Groups with more than PART rows are divided spatially, with margins, and their local clusters merged
       through shared core points (see _divided).
    """
    scratch = Scratch(rows.sparkSession)
    spark = rows.sparkSession
    d = rows.select(F.col(id).cast("bigint").alias("id"), F.col(column).alias("d")).where(F.col("id").isNotNull() & (F.size("d") == dim))
    run, (unit, near, tau) = _cells(dim, eps, seed)
    cells = d.mapInArrow(run, "k bigint, id bigint, s1 bigint, s2 bigint")
    cells = cells.repartition("k").sortWithinPartitions("k")
    edges = cells.mapInArrow(_candidates(unit, near, tau), "a bigint, b bigint")
    group = scratch.write(components(edges), "groups")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = vectors(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _bytes(x)], names=["id", "v"])

    large = scratch.write(group.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > PART), "sizes")
    some = bool(large.take(1))
    group = group.select(F.col("node").alias("id"), F.col("lead").alias("g"))
    v = d.mapInArrow(packed, "id bigint, v binary")
    if some:  # the vectors are joined once for both kinds of groups
        sized = group.join(large.select(F.col("lead").alias("g"), "n"), "g", "left")
        met = scratch.write(v.join(sized, "id").dropDuplicates(["id"]).select("g", "id", "v", "n"), "grouped")
        ordinary = met.where("n IS NULL")
    else:
        ordinary = v.join(group, "id")
    whole = ordinary.select("g", "id", F.col("id").alias("comp"), "v").repartition("g").sortWithinPartitions("g")
    local = whole.mapInArrow(_parts(dim, eps), "id bigint, comp bigint, root bigint").select("id", F.col("root").alias("cluster"))
    if some:
        names = components(_divided(met.where("n IS NOT NULL"), dim, eps)).withColumnsRenamed({"node": "id", "lead": "cluster"})
        local = local.unionByName(names.select("id", "cluster"))
    local = scratch.write(local, "local")
    alone = local.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return local.join(alone, "cluster", "left_semi").select(F.col("id").alias("desc_id"), F.col("cluster").alias("cluster_id"))


def cluster_summary(rows: DataFrame, found: DataFrame, typical: int = 3, dim: int = 192, id: str = "desc_id", column: str = "d", slices: int = 64) -> DataFrame:
    """(cluster_id, size, medoid_id, typical_ids, spread): each cluster's size and most typical rows.

    The medoid is the row with the least sum of squared distances to the cluster's rows, which is the one nearest
    to their mean; typical_ids are the `typical` nearest ones, ties by id; spread is the root mean
    square distance to the mean.  Means are summed by slices of a cluster before they are united.
    """
    d = rows.select(F.col(id).cast("bigint").alias("desc_id"), F.col(column).alias("d")).where(F.size("d") == dim)
    mine = d.join(found, "desc_id").dropDuplicates(["desc_id"]).select("cluster_id", "desc_id", "d")
    mine = Scratch(rows.sparkSession).write(mine, "members")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = vectors(b.column(1), dim)
            c, own = np.unique(b.column(0).to_numpy()[at], return_inverse=True)
            s = np.zeros((len(c), dim))
            np.add.at(s, own, x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.bincount(own)), pa.array([r.tobytes() for r in s], pa.binary())], names=["cluster_id", "n", "s"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches, 0):
            c, own = np.unique(b.column(0).to_numpy(), return_inverse=True)
            s, n = np.zeros((len(c), dim)), np.bincount(own, weights=b.column(1).to_numpy()).astype(np.int64)
            np.add.at(s, own, np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n), pa.array((s / n[:, None]).tolist(), pa.list_(pa.float64()))], names=["cluster_id", "n", "mean"])

    part = mine.select("cluster_id", "d").mapInArrow(sums, "cluster_id bigint, n bigint, s binary")
    means = part.repartition("cluster_id").sortWithinPartitions("cluster_id").mapInArrow(united, "cluster_id bigint, n bigint, mean array<double>")
    sq = F.aggregate(F.zip_with("d", "mean", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    far = mine.join(means, "cluster_id").select("cluster_id", "desc_id", "n", sq.alias("sq"))
    far = Scratch(rows.sparkSession).write(far, "distances")
    top = far.withColumn("slice", F.pmod(F.xxhash64("desc_id"), F.lit(slices)))
    for by in (["cluster_id", "slice"], ["cluster_id"]):  # the best of each slice first, so no task sorts a large cluster
        top = top.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.round("sq", 7), "desc_id"))).where(F.col("r") <= typical)
    top = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "desc_id"))).alias("t"))
    spread = far.groupBy("cluster_id").agg(F.max("n").alias("size"), F.sqrt(F.avg("sq")).alias("spread"))
    ids = F.transform("t", lambda x: x["desc_id"])
    return spread.join(top, "cluster_id").select("cluster_id", "size", F.get(ids, F.lit(0)).alias("medoid_id"), ids.alias("typical_ids"), F.round("spread", 6).alias("spread"))
