"""Session helpers: a tuned local session for tests and benches, and shipping of the package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("prismlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver's sys.path has it."""
    have = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; on one machine, where the session names none, a temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='spark-prismlake-')}")
    return _own[0]


#: Tables that materialize() wrote, in their order.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends, and a lost executor costs only its own tasks.

    The table stays until drop_tables(): results may be read from it later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


def tables_written() -> int:
    """A mark for drop_tables()."""
    return len(_written)


def drop_tables(spark: SparkSession, mark: int) -> None:
    """Removes the tables that materialize() wrote since a mark, when nothing will read them any more."""
    while len(_written) > mark:
        remove(spark, _written.pop())


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of the steps of one job, written as materialize() does, and removed when the job has its result."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())
