"""Superposition, fluctuation, neighbourhoods and frame selection, a protein at a time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One group (a protein) holds at most so many numbers; a larger one is an error, not a lost executor.
MAX_GROUP = 50_000_000


def rotation(h: np.ndarray) -> np.ndarray:
    """Proper rotations (..., 3, 3) that carry centered points x onto y best, from h = x^T y."""
    u, _, vt = np.linalg.svd(h)
    v, ut = np.swapaxes(vt, -1, -2), np.swapaxes(u, -1, -2)
    flip = np.ones(h.shape[:-1])
    flip[..., 2] = np.sign(np.linalg.det(v @ ut))
    return (v * flip[..., None, :]) @ ut


def superposed(frames: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Every frame (P, L, 3) moved rigidly onto one structure (L, 3)."""
    mid, goal = frames.mean(1, keepdims=True), onto.mean(0)
    x = frames - mid
    r = rotation(np.einsum("pli,lj->pij", x, onto - goal))
    return np.einsum("plj,pij->pli", x, r) + goal


def fluctuation(frames: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Root mean square fluctuation of each residue; rounds = 0 aligns on the first frame, else on the running mean."""
    x = frames.astype(np.float64)
    if rounds == 0:
        x = np.concatenate([x[:1], superposed(x[1:], x[0])]) if len(x) > 1 else x
    for _ in range(rounds):
        x = superposed(x, x.mean(0))
    return np.sqrt(x.var(0).sum(-1))


def local_pca(frames: np.ndarray, radius: float = 10.0) -> np.ndarray:
    """(L, 6): singular values and first axis of each residue's motion against its ball of the first frame.

    Every other frame's ball is superposed on the first frame's; only the residue itself is followed.
    A ball of fewer than 4 residues gives zeros; the axis' largest component is positive.
    """
    x = frames.astype(np.float64)
    ref, out = x[0], np.zeros((x.shape[1], 6))
    for r in range(x.shape[1]):
        ball = np.flatnonzero(((ref - ref[r]) ** 2).sum(1) <= radius * radius)
        if len(ball) < 4:
            continue
        mine, goal = x[1:, ball], ref[ball].mean(0)
        mid = mine.mean(1)
        try:
            rot = rotation(np.einsum("pli,lj->pij", mine - mid[:, None], ref[ball] - goal))
            path = np.concatenate([ref[r][None], np.einsum("pj,pij->pi", x[1:, r] - mid, rot) + goal])
            _, s, vt = np.linalg.svd(path - path.mean(0), full_matrices=False)
        except np.linalg.LinAlgError:
            continue
        axis = vt[0] * (-1 if vt[0][np.abs(vt[0]).argmax()] < 0 else 1)
        out[r, : min(3, len(s))], out[r, 3:] = s[:3], axis
    return out


def farthest_frames(frames: np.ndarray, k: int) -> list[int]:
    """Up to k frames, from the first on each the one farthest from those taken; sorted."""
    flat = frames.reshape(len(frames), -1).astype(np.float64)
    taken, far = [0], np.full(len(flat), np.inf)
    while len(taken) < k:
        far = np.minimum(far, np.sqrt(((flat - flat[taken[-1]]) ** 2).sum(1)))
        best = int(far.argmax())
        if best in taken:
            break
        taken.append(best)
    return sorted(taken)


def frame_descriptor(n: np.ndarray, ca: np.ndarray, c: np.ndarray, k: int = 16) -> np.ndarray:
    """(..., L, 12 k): the k nearest residues' frames seen from each residue's own frame, of atoms (..., L, 3).

    A residue's frame is Gram-Schmidt on CA-C and CA-N with its origin at CA.  Neighbours go by CA
    distance, the residue itself first, ties by index; missing neighbours are the residue itself.
    This rule is this library's own.
    """
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-8)

    e1 = unit(c - ca)
    w = n - ca
    e2 = unit(w - (w * e1).sum(-1, keepdims=True) * e1)
    rot = np.stack([e1, e2, np.cross(e1, e2)], -1)
    size = ca.shape[-2]
    d = ((ca[..., :, None, :] - ca[..., None, :, :]) ** 2).sum(-1)
    near = np.argsort(d, axis=-1, kind="stable")[..., :k]
    if near.shape[-1] < k:
        own = np.broadcast_to(np.arange(size)[:, None], (*near.shape[:-1], k - near.shape[-1]))
        near = np.concatenate([near, own], -1)
    flat = near.reshape(*near.shape[:-2], size * k)
    theirs = np.take_along_axis(rot, flat[..., None, None], -3).reshape(*near.shape, 3, 3)
    place = np.take_along_axis(ca, flat[..., None], -2).reshape(*near.shape, 3)
    rel = np.swapaxes(rot, -1, -2)[..., None, :, :] @ theirs
    shift = ((place - ca[..., None, :])[..., None, :] @ rot[..., None, :, :])[..., 0, :]
    return np.concatenate([rel.reshape(*near.shape, 9), shift], -1).reshape(*ca.shape[:-1], 12 * k)


def assignment(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """The permutation of least total cost: by trial up to 6 rows, beyond by shortest augmenting paths."""
    n = len(cost)
    if n <= 6:
        perms = np.array(list(itertools.permutations(range(n))))
        total = cost[np.arange(n), perms].sum(1)
        return perms[total.argmin()], float(total.min())
    row_of, u, v = np.full(n + 1, -1), np.zeros(n), np.zeros(n + 1)
    for i in range(n):
        row_of[n], j = i, n
        slack, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            free = np.flatnonzero(~done[:n])
            cut = cost[r, free] - u[r] - v[free]
            better = cut < slack[free]
            slack[free[better]], back[free[better]] = cut[better], j
            nxt = free[slack[free].argmin()]
            step = slack[nxt]
            for q in np.flatnonzero(done):
                u[row_of[q]] += step
                v[q] -= step
            slack[free] -= step
            j = nxt
        while j != n:
            row_of[j] = row_of[back[j]]
            j = back[j]
    perm = np.empty(n, np.int64)
    perm[row_of[:n]] = np.arange(n)
    return perm, float(cost[np.arange(n), perm].sum())


def _cube(pdf: pd.DataFrame) -> np.ndarray:
    """(frames, residues, 3) of one protein's rows (frame, res, xyz)."""
    if len(pdf) * 3 > MAX_GROUP:
        raise ValueError("a protein is too large for one task")
    p = pdf.sort_values(["frame", "res"])
    n = p["frame"].nunique()
    return np.stack(p["xyz"].to_numpy()).astype(np.float64).reshape(n, -1, 3)


def rmsf(coords: DataFrame, rounds: int = 3) -> DataFrame:
    """(pid, res, rmsf) of coordinates (pid, frame, res, xyz); a protein is one bounded group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pid": pdf["pid"].iloc[0], "res": np.sort(pdf["res"].unique()), "rmsf": fluctuation(_cube(pdf), rounds)})

    return coords.select("pid", "frame", "res", "xyz").groupBy("pid").applyInPandas(run, "pid string, res int, rmsf double")


def local_motion(coords: DataFrame, radius: float = 10.0) -> DataFrame:
    """(pid, res, s1, s2, s3, v1) of coordinates (pid, frame, res, xyz)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = local_pca(_cube(pdf), radius)
        return pd.DataFrame({"pid": pdf["pid"].iloc[0], "res": np.sort(pdf["res"].unique()), "s1": f[:, 0], "s2": f[:, 1], "s3": f[:, 2], "v1": list(f[:, 3:])})

    return coords.select("pid", "frame", "res", "xyz").groupBy("pid").applyInPandas(run, "pid string, res int, s1 double, s2 double, s3 double, v1 array<double>")


def selected_frames(coords: DataFrame, k: int) -> DataFrame:
    """(pid, frames): the frames that farthest-point sampling takes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf["frame"].unique())
        return pd.DataFrame({"pid": [pdf["pid"].iloc[0]], "frames": [names[farthest_frames(_cube(pdf), k)]]})

    return coords.select("pid", "frame", "res", "xyz").groupBy("pid").applyInPandas(run, "pid string, frames array<int>")


def _whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by pid and frame (columns 0 and 1), cut so that no frame is in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        name = (b.column(0)[-1], b.column(1)[-1])
        last = pc.and_(pc.equal(b.column(0), name[0]), pc.equal(b.column(1), name[1])).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if held and (cut or (held[-1].column(0)[-1], held[-1].column(1)[-1]) != name):
            whole = pa.concat_batches([*held, b.slice(0, cut)])
            held = []
            yield whole
        elif cut:
            yield b.slice(0, cut)
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def descriptors(backbone: DataFrame, k: int = 16) -> DataFrame:
    """(pid, frame, res, d) of a backbone (pid, frame, res, n, ca, c).

    Rows are brought together and sorted by frame, and all frames of one length in a batch are computed at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_frames(batches):
            fresh = pc.or_(pc.not_equal(b.column(0)[1:], b.column(0)[:-1]), pc.not_equal(b.column(1)[1:], b.column(1)[:-1])).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(fresh) + 1)
            size = np.diff(np.append(starts, len(b)))
            atoms = [b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3) for i in (3, 4, 5)]
            for n in np.unique(size):
                step = max(1, (1 << 20) // int(n * n))
                own = starts[size == n]
                for i in range(0, len(own), step):
                    at = own[i : i + step, None] + np.arange(n)
                    d = frame_descriptor(*[a[at] for a in atoms], k).reshape(-1, 12 * k)
                    take = pa.array(at.ravel())
                    ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * (12 * k))
                    yield pa.RecordBatch.from_arrays([*[b.column(j).take(take) for j in range(3)], pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], names=["pid", "frame", "res", "d"])

    rows = backbone.select("pid", "frame", "res", "n", "ca", "c").where("pid IS NOT NULL AND frame IS NOT NULL")
    rows = rows.repartition("pid", "frame").sortWithinPartitions("pid", "frame", "res")
    return rows.mapInArrow(run, "pid string, frame int, res int, d array<double>")


def matched_loss(pairs: DataFrame) -> DataFrame:
    """(key, loss): least mean squared error of (key, pred, target), arrays of vectors, over the orders of pred."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, t in zip(b["pred"], b["target"]):
                x, y = np.stack(p), np.stack(t)
                out.append(assignment(((x[:, None] - y[None]) ** 2).mean(-1))[1] / len(x))
            yield pd.DataFrame({"key": b["key"], "loss": out})

    return pairs.select(F.col("key").cast("bigint").alias("key"), "pred", "target").mapInPandas(run, "key bigint, loss double")


def radius_pairs(points: DataFrame, radius: float, key: str = "key", id: str = "id", xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(key, a, b): ordered pairs of a key's points within `radius`, a point with itself included.

    Space is cut into cubes of the radius; one side is sent to its cube's 27 neighbours, so the range join is an
    equi-join on (key, cube) and no group of all pairs arises.
    """
    from functools import reduce

    cell = [F.floor(F.col(c) / radius).cast("int") for c in xyz]
    p = points.select(F.col(key).alias("key"), F.col(id).alias("i"), *[F.col(c).cast("double").alias(n) for c, n in zip(xyz, "xyz")], *[c.alias(f"c{n}") for c, n in zip(cell, "xyz")])
    q = p.select("key", F.col("i").alias("j"), *[F.col(n).alias(f"{n}2") for n in "xyz"], *[F.col(f"c{n}") for n in "xyz"])
    for n in "xyz":
        q = q.withColumn(f"c{n}", F.explode(F.array(*[F.col(f"c{n}") + s for s in (-1, 0, 1)])))
    d2 = reduce(lambda a, b: a + b, [(F.col(n) - F.col(f"{n}2")) ** 2 for n in "xyz"])
    return p.join(q, ["key", "cx", "cy", "cz"]).where(d2 <= radius * radius).select("key", F.col("i").alias("a"), F.col("j").alias("b"))


def nearest_rows(rows: DataFrame, k: int, key: str, id: str, vector: str) -> DataFrame:
    """(key, id, neighbour, rank, d2): the k nearest other rows of the same key, ties by id.

    A key (a protein's frame) is one bounded group; distances are one matrix product.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("id")
        x, ids = np.stack(p["v"].to_numpy()).astype(np.float64), p["id"].to_numpy()
        if x.size > MAX_GROUP:
            raise ValueError("a group is too large for one task")
        out = []
        for i in range(0, len(x), 512):
            d = ((x[i : i + 512, None] - x[None]) ** 2).sum(-1) if x.size * 512 < 1 << 24 else np.maximum(0, (x[i : i + 512] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[i : i + 512] @ x.T)
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            near = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, : min(k, len(x) - 1)]
            r = np.repeat(np.arange(len(d)), near.shape[1])
            out.append(pd.DataFrame({"key": p["key"].iloc[0], "id": ids[r + i], "neighbour": ids[near.ravel()], "rank": np.tile(np.arange(1, near.shape[1] + 1), len(d)), "d2": d[r, near.ravel()]}))
        return pd.concat(out)

    p = rows.select(F.col(key).cast("bigint").alias("key"), F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return p.groupBy("key").applyInPandas(run, "key bigint, id bigint, neighbour bigint, rank int, d2 double")


def capped_nearest(rows: DataFrame, frames: DataFrame, cap: float, exact: float = 1e-3) -> DataFrame:
    """(id, frame, dist): for each row (id, vec) the frame (frame, vec) at the least distance, up to `cap`.

    The first frame closer than `exact` is taken even if a later one is closer still; else ties go to the
    first.  Frames of one trajectory are bounded and sent to the tasks.
    """
    from strandmill.operators.quantize import _nearest, codebook_matrix

    book = frames.select(F.col("frame").alias("code"), "vec")
    codes, c = codebook_matrix(book)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy()).astype(np.float64)
            best, sq = _nearest(x, c)
            close = np.flatnonzero(sq < exact * exact)  # only there an earlier frame can be close enough too
            for i in range(0, len(close), 64):
                at = close[i : i + 64]
                d = ((x[at][:, None] - c[None]) ** 2).sum(-1)
                best[at] = (d < exact * exact).argmax(1)
                sq[at] = d[np.arange(len(at)), best[at]]
            dist = np.sqrt(sq)
            ok = dist <= cap
            yield pd.DataFrame({"id": b["id"][ok], "frame": codes[best[ok]], "dist": dist[ok]})

    p = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("v"))
    return p.mapInPandas(run, "id bigint, frame bigint, dist double")
