"""Chains, residues and geometry along a chain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import vec

#: Fixed values of the ideal backbone: offsets of N, C and the bend along and across the tangent, the C=O bond, in Angstrom.
ALPHA_N, ALPHA_C, BETA, O_BOND = 1.191, 1.264, 0.844, 1.23
EPS = 1e-8
#: One-letter residue by its side chain's heavy atoms (C, N, O, S); two signatures need geometry.
SIDE_CHAINS = {
    (1, 0, 0, 0): "A", (1, 0, 0, 1): "C", (2, 0, 2, 0): "D", (3, 0, 2, 0): "E", (7, 0, 0, 0): "F", (4, 2, 0, 0): "H",
    (4, 1, 0, 0): "K", (3, 0, 0, 1): "M", (2, 1, 1, 0): "N", (3, 1, 1, 0): "Q", (4, 3, 0, 0): "R", (1, 0, 1, 0): "S",
    (2, 0, 1, 0): "T", (9, 1, 0, 0): "W", (7, 0, 1, 0): "Y",
}


def segments(rows: DataFrame, key: str, order: list[str], gap: Column) -> DataFrame:
    """(key, first, last, n): half-open stretches of rows between the rows where `gap` is true.

    `gap` is evaluated with the previous row of the key in columns prev_<name> for every name in `order`
    and `value`; the first row of a key opens a stretch.
    """
    w = W.partitionBy(key).orderBy(*order)
    r = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("prev_value", F.lag("value").over(w))
    r = r.withColumn("_new", F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0))
    r = r.withColumn("segment", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(key, "segment").agg(F.min("_i").alias("first"), (F.max("_i") + 1).alias("last"), F.count("*").alias("n"))


def tangents(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """`rows` with the unit-free tangent next - previous; ends extend the chain by reflection, one row gives 0."""
    w = W.partitionBy(key).orderBy(*order)
    x, prev, nxt = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return rows.withColumn("tangent", F.coalesce(nxt, 2 * x - prev, x) - F.coalesce(prev, 2 * x - nxt, x))


def atoms(lines: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, resid, resname, n, ca, c, o, cb): backbone atom numbers of every residue that has N, CA, C and O.

    Atoms are numbered along the ATOM lines of a text, from 0; a line with a malformed residue number
    counts as an atom; a repeated atom's last number holds, a residue's first name.
    """
    part = lambda a, n: F.trim(F.substring("line", a, n))
    a = lines.select(F.col(key).alias("key"), F.posexplode(F.filter(F.split(text, "\n"), lambda x: x.startswith("ATOM"))).alias("i", "line"))
    a = a.select("key", "i", part(13, 4).alias("name"), F.expr("try_cast(trim(substring(line, 23, 4)) AS int)").alias("resid"), part(18, 4).alias("resname"))
    a = a.where("resid IS NOT NULL AND name IN ('N', 'CA', 'C', 'O', 'CB')")
    last = lambda n: F.max(F.when(F.col("name") == n, F.col("i")))
    r = a.groupBy("key", "resid").agg(F.min(F.struct("i", "resname")).alias("f"), *[last(n).alias(n.lower()) for n in ("N", "CA", "C", "O", "CB")])
    return r.dropna(subset=["n", "ca", "c", "o"]).select("key", "resid", F.col("f.resname").alias("resname"), "n", "ca", "c", "o", "cb")


def _unit(v: Column) -> Column:
    """v over its length (plus EPS); v is bound in a lambda, so it is computed once."""
    return F.get(F.transform(F.array(v), lambda a: vec.scale(a, 1 / (vec.norm(a) + EPS))), F.lit(0))


def ideal_backbone(rows: DataFrame, key: list[str], order: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """`rows` with n, c and o atoms (arrays) rebuilt from the CA trace alone.

    N and C lie along the tangent of the neighbours and bent outward from their midpoint; where three
    CAs are in line any perpendicular serves; O is trigonal between CA and the next residue's N.
    A chain of one residue gets N = C = CA.  Neighbours come from one window a chain.
    """
    w = W.partitionBy(*key).orderBy(order)
    ca = F.array(*[F.col(a).cast("double") for a in xyz])
    r = rows.withColumn("_v", ca).withColumn("_p", F.lag("_v").over(w)).withColumn("_q", F.lead("_v").over(w))
    beyond = lambda other: vec.sub(vec.scale("_v", 2.0), other)
    one = F.col("_p").isNull() & F.col("_q").isNull()
    r = r.withColumn("_one", one).withColumn("_a", F.coalesce("_p", beyond(F.col("_q")), "_v")).withColumn("_b", F.coalesce("_q", beyond(F.col("_p")), "_v"))
    r = r.withColumn("_t", _unit(vec.sub("_b", "_a")))
    across = lambda v: vec.sub(v, vec.scale("_t", vec.dot(v, "_t")))
    steep = F.abs(F.get("_t", F.lit(1))) > 0.9
    axis = F.when(steep, F.array(*map(F.lit, (0.0, 0.0, 1.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, 0.0))))
    r = r.withColumn("_m", across(vec.sub("_v", vec.scale(vec.add("_a", "_b"), 0.5)))).withColumn("_s", across(axis))
    r = r.withColumn("_n", _unit(F.when(vec.norm("_m") < 1e-3, F.col("_s")).otherwise(F.col("_m"))))
    side = lambda k: F.when(F.col("_one"), F.col("_v")).otherwise(vec.add("_v", vec.add(vec.scale("_t", k), vec.scale("_n", BETA))))
    r = r.withColumn("n", side(-ALPHA_N)).withColumn("c", side(ALPHA_C))
    r = r.withColumn("_next", F.coalesce(F.lead("n").over(w), vec.add("c", vec.sub("n", "_v"))))
    out = _unit(vec.scale(vec.add(_unit(vec.sub("_v", "c")), _unit(vec.sub("_next", "c"))), -1.0))
    r = r.withColumn("o", F.when(F.col("_one"), vec.add("_v", F.array(F.lit(O_BOND), F.lit(0.0), F.lit(0.0)))).otherwise(vec.add("c", vec.scale(out, O_BOND))))
    return r.drop("_v", "_p", "_q", "_one", "_a", "_b", "_t", "_m", "_s", "_n", "_next")


def trigonal_cb(n: Column, ca: Column, c: Column) -> Column:
    """CA + 1.522 A away from N and C, for residues without a CB of their own."""
    away = vec.scale(_unit(vec.add(_unit(vec.sub(n, ca)), _unit(vec.sub(c, ca)))), -1.522)
    return vec.add(ca, away)


def cb_or_virtual(cb: Column, n: Column, ca: Column, c: Column) -> Column:
    """The CB itself, or the virtual one where it is null or has a NaN."""
    return F.when(cb.isNull() | F.exists(cb, lambda x: F.isnan(x)), trigonal_cb(n, ca, c)).otherwise(cb)


def residues(chains: DataFrame) -> DataFrame:
    """(key, r, n, ca, c, o, cb, aa): the residues of atom chains (key, number, kind, x, y, z arrays), by atom pattern.

    A residue begins at the nitrogen behind a carbonyl: carbon of kind 3, hydrogens, oxygen, hydrogens
    or oxygens, then a nitrogen whose next heavy atom is a carbon of another kind.  A chain with a
    malformed residue gives no rows.  The atoms become a string of one letter each, and the pattern
    is a regular expression over it; one chain is one bounded record.
    """
    import re

    begin = re.compile(r"Kh*o[ho]*(?=nh*k)")  # K: carbon of kind 3, k: another carbon
    schema = "key string, r int, n int, ca int, c int, o int, cb int, aa string"

    def of_chain(number: list[int], kind: list[int], xyz: list[tuple[float, float, float]]) -> list[tuple] | None:
        s = "".join({1: "h", 7: "n", 8: "o", 16: "s", 6: "K" if k == 3 else "k"}.get(a, "x") for a, k in zip(number, kind))
        starts = ([0] if s[:1] == "n" else []) + [m.end() for m in begin.finditer(s)]
        out = []
        for r, (a, b) in enumerate(zip(starts, [*starts[1:], len(s)])):
            body = re.compile(r"[^kK]*([kK])", re.S).match(s, a + 1, b)
            if not body:
                return None
            ca = body.start(1)
            c = s.rfind("K", ca + 1, b)
            tail = re.compile(r"h*o").match(s, c + 1, b) if c >= 0 else None
            if not tail:
                return None
            inner = s[ca + 1 : c]
            first = re.search("[kK]", inner)
            cb = ca + 1 + first.start() if first else None
            out.append((r, a, ca, c, tail.end() - 1, cb, residue_name(inner, cb is not None, lambda i: xyz[ca + 1 + i], xyz[a])))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *x) for k, a, t, p in zip(b["key"], b["number"], b["kind"], b["xyz"]) for x in of_chain(list(a), list(t), [tuple(q) for q in p]) or []]
            yield pd.DataFrame(rows, columns=["key", "r", "n", "ca", "c", "o", "cb", "aa"]).astype({"cb": "Int32"})

    return chains.select(F.col("key").cast("string").alias("key"), "number", "kind", "xyz").mapInPandas(run, schema)


def residue_name(inner: str, has_cb: bool, place, nitrogen) -> str:
    """One-letter name by the heavy atoms between CA and C (letters k, K, n, o, s, h)."""
    if not has_cb:
        return "G"
    low = inner.lower()
    sig = tuple(low.count(x) for x in "knos")
    if sig == (3, 0, 0, 0):  # valine, or proline whose last atom closes on N
        last = max(i for i, x in enumerate(low) if x != "h")
        return "P" if sum((p - q) ** 2 for p, q in zip(place(last), nitrogen)) < 4.0 else "V"
    if sig == (4, 0, 0, 0):  # leucine has two hydrogens on CB, isoleucine one
        rest = low[low.index("k") + 1 :]
        return {0: "X", 1: "I"}.get(len(rest) - len(rest.lstrip("h")), "L")
    return SIDE_CHAINS.get(sig, "X")
