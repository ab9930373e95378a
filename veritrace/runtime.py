"""Session, table loading and shared-folder materialisation used by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a set of 64-bit keys is broadcast (about 16 bytes a row on the wire); larger sets are joined by shuffle.
BROADCAST_ROWS = 500_000


def local_session(name: str = "veritrace", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Unset is accepted on a local master only (tests, bench), where a temporary folder is as good; on a cluster a
    machine-local folder would be lost with its executor, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="veritrace-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_WRITTEN: list[str] = []


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, is pruned by column.

    The table is deleted at the end of the scratch() it was written in, and at the latest when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veritrace/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialize wrote inside it; results must have been written or read by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[before:]:
            fs, at = file_system(spark, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)
        del _WRITTEN[before:]
