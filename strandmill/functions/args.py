"""Arguments of the steps: named paths, lists and shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(text: str) -> tuple[str, str]:
    """NAME=PATH; the path may hold further equal signs."""
    name, mark, path = text.partition("=")
    if not mark or not name.strip() or not path.strip():
        raise ValueError(f"expected NAME=PATH, not {text!r}")
    return name.strip(), path.strip()


def listed(text: str, kind: type = str) -> list:
    """A list separated by commas; empty parts are left out."""
    return [kind(x.strip()) for x in text.split(",") if x.strip()]


def shard(text: str) -> tuple[int, int]:
    """I/N with 0 <= I < N."""
    i, _, n = text.partition("/")
    if not (i.strip().isdigit() and n.strip().isdigit() and int(i) < int(n)):
        raise ValueError(f"expected I/N with I below N, not {text!r}")
    return int(i), int(n)


def spread(values: list, n: int) -> list:
    """One value for each of n places: a single one serves for all."""
    if len(values) not in (1, n):
        raise ValueError(f"expected 1 or {n} values, not {len(values)}")
    return list(values) * (n if len(values) == 1 else 1)


def named_column(text: Column | str) -> Column:
    """struct<name, path> of NAME=PATH; null if it is none."""
    t = F.col(text) if isinstance(text, str) else text
    at = F.instr(t, "=")
    head, tail = F.trim(F.substring(t, F.lit(1), at - 1)), F.trim(F.substring(t, at + 1, F.length(t)))
    return F.when((at > 0) & (head != "") & (tail != ""), F.struct(head.alias("name"), tail.alias("path")))
