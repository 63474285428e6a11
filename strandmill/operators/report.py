"""Leaderboards: rendering, reading back, and comparing with canonical figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import text
from strandmill.operators.stats import t_test_p, tolerance, welch


def leaderboard(cells: DataFrame, section: str, place: str) -> DataFrame:
    """`cells` (section, mean, ...) with their rank in the section: mean descending, missing means last, ties by catalogue place."""
    w = W.partitionBy(section).orderBy(F.desc(F.coalesce("mean", F.lit(-1e9))), place)
    return cells.withColumn("rank", F.row_number().over(w))


def markdown_lines(cells: DataFrame, column: str = "score") -> DataFrame:
    """(section, line_no, line): one table for each section, its rows in rank order; cells are (section, rank, baseline, cell)."""
    row = cells.select("section", (F.col("rank") + 3).alias("line_no"), F.concat(F.lit("| "), "baseline", F.lit(" | "), "cell", F.lit(" |")).alias("line"))
    heads = cells.select("section").distinct().select(
        "section",
        F.explode(F.array(
            F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("## "), "section").alias("line")),
            F.struct(F.lit(2).alias("line_no"), F.lit(f"| baseline | {column} |").alias("line")),
            F.struct(F.lit(3).alias("line_no"), F.lit("|---|---|").alias("line")),
        )).alias("h"),
    ).select("section", "h.line_no", "h.line")
    return heads.unionByName(row)


def parse_markdown(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, section, sub, baseline, col, cell) of the tables in (doc, line_no, line).

    `##` opens a section, `###` or `####` a subsection, a nested one below "EC depth" headings as
    parent/child; a table right below a section has the subsection "".  The first table row below a heading
    is its header; separator rows and rows with another number of cells are skipped; tables before any
    section are ignored.  Of a baseline that a table repeats the last row counts.
    """
    s = lines.select(F.col(doc).alias("doc"), "line_no", F.col("line").alias("l"))
    w = W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    level = F.length(F.regexp_extract("l", r"^(#{2,4}) ", 1))
    s = s.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("l", r"^#{2,4} ", "")))
    deep = (F.col("level") == 3) & F.col("title").startswith("EC depth-")
    s = s.withColumn("section", F.last(F.when(F.col("level") == 2, F.col("title")), True).over(w))
    s = s.withColumn("part", F.sum((F.col("level") == 2).cast("int")).over(w))
    v = W.partitionBy("doc", "part").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("depth", F.last(F.when(deep, F.col("title")), True).over(v))
    own = (F.col("level") >= 3) & ~deep
    sub = F.when(F.col("depth").isNull(), F.col("title")).otherwise(F.concat_ws("/", "depth", "title"))
    s = s.withColumn("sub", F.coalesce(F.last(F.when(own, sub).when(deep, F.lit("")), True).over(v), F.lit("")))
    s = s.withColumn("table", F.sum(((F.col("level") == 2) | own).cast("int")).over(w))
    bar = F.trim("l").startswith("|") & F.col("section").isNotNull()
    cells = F.transform(F.split(F.regexp_replace(F.trim("l"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    s = s.where(bar).withColumn("cells", cells)
    t = W.partitionBy("doc", "part", "table").orderBy("line_no")
    s = s.withColumn("head", F.first("cells").over(t)).withColumn("r", F.row_number().over(t)).where("r > 1")
    s = s.where(~F.forall("cells", lambda c: c.rlike("^[-:]*$"))).where(F.size("cells") == F.size("head"))
    last = s.groupBy("doc", "section", "sub", F.get("cells", F.lit(0)).alias("baseline")).agg(F.max(F.struct("line_no", "head", "cells")).alias("x"))
    pairs = F.slice(F.arrays_zip(F.col("x.head").alias("col"), F.col("x.cells").alias("cell")), 2, F.greatest(F.lit(1), F.size("x.head")))
    return last.select("doc", "section", "sub", "baseline", F.explode(pairs).alias("p")).select("doc", "section", "sub", "baseline", F.col("p.col").alias("col"), F.col("p.cell").alias("cell"))


def audit(ours: DataFrame, canon: DataFrame, keys: list[str], with_p: bool = True) -> DataFrame:
    """Our cells (keys..., mean, std, n) against the canonical ones: differences, tolerances, Welch's t and a status.

    status: `match`, `off` (mean or std out of tolerance), `partial` (fewer seeds), `dash` (ours is missing)
    or `canon-miss`.
    """
    a = ours.select(*keys, F.col("mean").alias("m1"), F.col("std").alias("s1"), F.col("n").alias("n1"))
    b = canon.select(*keys, F.col("mean").alias("m2"), F.col("std").alias("s2"), F.col("n").alias("n2"))
    j = a.join(b, keys, "left")
    tm, ts = tolerance("s2", "n2")
    t, df = welch("m1", "s1", "n1", "m2", "s2", "n2")
    j = j.withColumn("tol_mean", tm).withColumn("tol_std", ts).withColumn("t", t).withColumn("df", df)
    dm, ds = F.abs(F.col("m1") - F.col("m2")), F.abs(F.col("s1") - F.col("s2"))
    status = F.when(F.col("m2").isNull(), "canon-miss").when(F.col("m1").isNull(), "dash").when(F.col("n1") < F.col("n2"), "partial").when((dm <= F.col("tol_mean")) & (ds <= F.col("tol_std")), "match").otherwise("off")
    j = j.withColumn("d_mean", F.col("m1") - F.col("m2")).withColumn("d_std", F.col("s1") - F.col("s2")).withColumn("status", status)
    return j.withColumn("p", t_test_p("t", "df")) if with_p else j


def with_sections(cells: DataFrame, names: dict[str, str], shown: dict[str, str] | None = None, section: str = "section", baseline: str = "baseline") -> DataFrame:
    """`cells` under the sections' other names and the baselines' display names, without marks; unknown sections are left out.

    Both maps are bounded tables of a report's layout.
    """
    of = lambda m, c: F.try_element_at(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]), c)
    plain = text.plain_name(baseline)
    out = cells.withColumn(section, of(names, F.col(section))).where(F.col(section).isNotNull())
    return out.withColumn(baseline, F.coalesce(of(shown, plain), plain) if shown else plain)


def audit_order(rows: DataFrame) -> DataFrame:
    """Most surprising first: p ascending, missing p as 1, then the larger difference."""
    rest = [c for c in rows.columns if c not in ("p", "d_mean")]
    return rows.orderBy(F.coalesce("p", F.lit(1.0)), F.desc(F.abs("d_mean")), *rest)


def parsed_cells(cells: DataFrame, column: str = "cell") -> DataFrame:
    return cells.withColumn("parsed", text.cell(column)).select("*", "parsed.mean", "parsed.std", "parsed.n").drop("parsed")
