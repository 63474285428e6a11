"""Text, JSON and CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import three_letters

BUCKETS = "map<string,array<string>>"


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return splits_of(spark.read.text(path, wholetext=True), "value")


def splits_of(texts: DataFrame, column: str) -> DataFrame:
    """(split_name, bucket, pid) of split files: nested {split: {bucket: [pid]}} or flat {bucket: [pid]} ("" as name); pids in upper case."""
    c = F.col(column)
    nested = texts.select(F.explode(F.from_json(c, f"map<string,{BUCKETS}>")).alias("split_name", "b")).select("split_name", F.explode("b").alias("bucket", "p"))
    flat = texts.select(F.lit("").alias("split_name"), F.explode(F.from_json(c, BUCKETS)).alias("bucket", "p"))
    return nested.unionByName(flat).select("split_name", "bucket", F.explode("p").alias("pid")).select("split_name", "bucket", F.upper("pid").alias("pid"))


def nested_scores(texts: DataFrame, column: str) -> DataFrame:
    """(assay, mut, score) of {assay: {mut: score}}."""
    s = texts.select(F.explode(F.from_json(F.col(column), "map<string,map<string,double>>")).alias("assay", "m"))
    return s.select("assay", F.explode("m").alias("mut", "score"))


def label_lists(texts: DataFrame, column: str) -> DataFrame:
    """(pid, labels) of {pid: [label]}; pids in upper case."""
    return texts.select(F.explode(F.from_json(F.col(column), "map<string,array<string>>")).alias("pid", "labels")).select(F.upper("pid").alias("pid"), "labels")


def read_assay(spark: SparkSession, path: str) -> DataFrame:
    """(mutant, mutated_sequence) of a CSV with header; rows without a sequence are dropped."""
    return assay_rows(spark.read.csv(path, header=True))


def assay_rows(rows: DataFrame) -> DataFrame:
    return rows.select("mutant", "mutated_sequence").where(F.coalesce("mutated_sequence", F.lit("")) != "")


def atom_line(serial: Column, name: Column, aa: Column, resid: Column, xyz: list[Column], element: Column) -> Column:
    """A fixed-width ATOM line of chain A."""
    return F.format_string("ATOM  %5d  %-3s %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", serial, name, three_letters(aa), resid, *xyz, element)


def structures(residues: DataFrame, key: str = "key") -> DataFrame:
    """(key, pdb): a minimal structure text of (key, res, aa, n, ca, c, o, cb): N, CA, C, CB where it has no NaN, O; residues from 1."""
    def atom(name: str, place: int, col: str):
        return F.struct(F.lit(place).alias("p"), F.lit(name).alias("name"), F.col(col).alias("xyz"))

    has = F.col("cb").isNotNull() & ~F.exists("cb", lambda x: F.isnan(x))
    plain = F.array(atom("N", 0, "n"), atom("CA", 1, "ca"), atom("C", 2, "c"))
    all_ = F.concat(plain, F.when(has, F.array(atom("CB", 3, "cb"), atom("O", 4, "o"))).otherwise(F.array(atom("O", 4, "o"))))
    per = residues.select(F.col(key).alias("key"), F.struct("res", "aa", all_.alias("atoms")).alias("r")).groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    flat = per.select("key", F.posexplode(F.flatten(F.transform("rs", lambda r: F.transform(r["atoms"], lambda a: F.struct(r["res"].alias("res"), r["aa"].alias("aa"), a["name"].alias("name"), a["xyz"].alias("xyz")))))).alias("i", "a"))
    line = atom_line(F.col("i") + 1, F.col("a.name"), F.col("a.aa"), F.col("a.res").cast("int") + 1, [F.get("a.xyz", F.lit(k)) for k in range(3)], F.substring("a.name", 1, 1))
    lines = flat.select("key", F.struct("i", line.alias("l")).alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select("key", F.concat(F.array_join(F.transform("xs", lambda x: x["l"]), "\n"), F.lit("\nEND\n")).alias("pdb"))


def write_once(rows: DataFrame, path: str, force: bool = False) -> None:
    """Parquet, unless it exists; with force it is replaced."""
    rows.write.mode("overwrite" if force else "ignore").parquet(path)


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """The keys without a finished result."""
    return keys.join(done.select(*on), on, "left_anti")


def json_at(column: Column, path: str) -> Column:
    """A nested value as text, null where the path breaks off; keys joined by dots."""
    return F.get_json_object(column, "$." + path)


def write_audit(rows: DataFrame, path: str, fields: list[str]) -> None:
    rows.select(*fields).write.mode("overwrite").csv(path, header=True)


def results_json(runs: DataFrame, value: str = "json") -> DataFrame:
    """One JSON object for each run, keys in the columns' order, nulls left out."""
    return runs.select(F.to_json(F.struct(*runs.columns)).alias(value))


def write_results(runs: DataFrame, path: str) -> None:
    """The runs' objects, one a line, added to those already there."""
    results_json(runs, "value").write.mode("append").text(path)
