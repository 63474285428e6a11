"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(cores: int | str = "*", name: str = "strandmill", **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster the launcher's own settings apply."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Where it is unset (tests, one machine) a temporary folder is made and set; on a cluster an
    unset folder is an error, since a machine-local one would not survive a lost executor.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set("spark.checkpoint.dir", at)
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is already gone
        pass


class Scratch:
    """Intermediate tables of one query, written as Parquet below the shared folder.

    A table written here cuts the lineage: a lost executor costs only the tasks that read it, and
    the shuffle files of the steps before it are removed as soon as it is whole.
    `drop` removes a table that no later step reads; the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.root = f"{shared_dir(spark)}/strandmill-{app}"
        if self.root not in _CLEANED:
            _CLEANED.add(self.root)
            atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}-{tag}"
        kept = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, kept)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strandmill_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_strandmill_path", None):
            _delete(self.spark, path)
