"""String functions: codes, keys, hashes, mutations, report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The amino acid alphabet, and three-letter names by one-letter code.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
THREE_LETTERS = {
    "A": "ALA", "C": "CYS", "D": "ASP", "E": "GLU", "F": "PHE", "G": "GLY", "H": "HIS", "I": "ILE", "K": "LYS", "L": "LEU",
    "M": "MET", "N": "ASN", "P": "PRO", "Q": "GLN", "R": "ARG", "S": "SER", "T": "THR", "V": "VAL", "W": "TRP", "Y": "TYR", "X": "UNK",
}
FNV_BASIS, FNV_PRIME, WORD = 2166136261, 16777619, 0xFFFFFFFF
#: The formats of a report's cells.
CELL = r"([+-]?\d+\.\d+)\s*±\s*(\d+\.\d+)\s*\(n=(\d+)\)"
GRID_BEST = r"Grid-best α = (\d+(?:\.\d+)?) → ([+-]?\d+\.\d+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncated_code(code: Column | str, depth: int) -> Column:
    """The first `depth` dotted parts; null if there are fewer."""
    c = _c(code)
    return F.when(F.size(F.split(c, "[.]")) >= depth, F.substring_index(c, ".", depth))


def split_key(key: Column | str, mark: str = "__") -> Column:
    """struct<head, tail> at the first mark; null without one."""
    k = _c(key)
    at = F.instr(k, mark)
    return F.when(at > 0, F.struct(F.substring(k, F.lit(1), at - 1).alias("head"), F.substring(k, at + len(mark), F.length(k)).alias("tail")))


def sha1_prefix(text: Column | str, digits: int = 16) -> Column:
    return F.substring(F.sha1(_c(text)), 1, digits)


def fnv1a(text: Column | str, seed: int = 0) -> Column:
    """32-bit FNV-1a over a seed and the characters of a text, as BIGINT."""
    word = F.lit(WORD).cast("bigint")
    start = F.lit(((FNV_BASIS ^ (seed & WORD)) * FNV_PRIME) & WORD).cast("bigint")
    codes = F.transform(F.regexp_extract_all(_c(text), F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(word))


def residue_index(letter: Column | str) -> Column:
    """Place of a residue in the alphabet, 20 for any other letter, without case."""
    at = F.instr(F.lit(ALPHABET), F.upper(_c(letter)))
    return F.when((at > 0) & (F.length(_c(letter)) == 1), at - 1).otherwise(20)


def three_letters(letter: Column | str) -> Column:
    table = F.create_map(*[F.lit(v) for pair in THREE_LETTERS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, _c(letter)), F.lit("UNK"))


def reverted(mutant: Column | str, sequence: Column | str) -> Column:
    """A sequence with its substitutions (A12B, several joined by colons) undone; null if one doesn't parse or fit."""
    s = _c(sequence)
    subs = F.filter(F.split(_c(mutant), ":"), lambda x: x != "")
    place = lambda x: F.try_to_number(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("9999999")).cast("int")
    undone = F.aggregate(subs, s, lambda acc, x: F.overlay(acc, F.substring(x, 1, 1), place(x), F.lit(1)))
    ok = F.forall(subs, lambda x: F.coalesce(place(x).between(1, F.length(s)), F.lit(False)))
    return F.when((s != "") & (_c(mutant) != "") & F.coalesce(ok, F.lit(False)), undone)


def cell(text: Column | str) -> Column:
    """struct<mean, std, n> of a report cell `mean ± std (n=k)`; null if it holds none."""
    t = _c(text)
    part = lambda i: F.regexp_extract(t, CELL, i)
    return F.when(t.rlike(CELL), F.struct(part(1).cast("double").alias("mean"), part(2).cast("double").alias("std"), part(3).cast("int").alias("n")))


def cell_text(mean: Column, std: Column, n: Column) -> Column:
    return F.when(n > 0, F.format_string("%.4f ± %.4f (n=%d)", mean, std, n)).otherwise("—")


def plain_name(text: Column | str) -> Column:
    """Without bold marks and a closing parenthesis."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"\*\*", ""), r"\s*\([^)]*\)\s*$", ""))


def grid_best(text: Column | str) -> Column:
    """struct<alpha, value> of a cell that names the best of a grid; null if it names none."""
    t = _c(text)
    part = lambda i: F.regexp_extract(t, GRID_BEST, i).cast("double")
    return F.when(t.rlike(GRID_BEST), F.struct(part(1).alias("alpha"), part(2).alias("value")))
