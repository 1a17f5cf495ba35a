"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int | str = "*", app: str = "tideline", **conf: str) -> SparkSession:
    """A single-node session for tests and benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only where spark.checkpoint.dir is unset and the master is local (tests) is
    a temporary folder set; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = "file://" + tempfile.mkdtemp(prefix="tideline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over the cores where the input has fewer splits than there are cores; a larger input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a DataFrame once into the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and is columnar, so that later
    passes read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH doesn't name its folder: Spark sends them a zip of it, once per context."""
    home = Path(__file__).resolve().parent.parent
    if str(home) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _SHIPPED:
        return
    d = tempfile.mkdtemp(prefix="tideline-zip-")  # on the driver; Spark's file server reads it as long as the context lives
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/tideline", "zip", home, "tideline"))
    _SHIPPED.add(spark.sparkContext.applicationId)
