"""Writers: partitioned parquet, publication with a manifest, idempotent builds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_dir


def write_partitions(df: DataFrame, by: Sequence[str], order: Sequence[str], path: str | None = None, split: int = 1, mode: str = "errorifexists") -> str:
    """Zstd parquet under by=value folders, rows sorted inside; returns the path.

    Rows meet by partition key before the write, so each folder gets ``split``
    files, not one from every task. ``split`` > 1 salts a hot partition over
    several writers.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/partitions-{uuid.uuid4().hex}"
    salt = F.pmod(F.xxhash64(*order), F.lit(split))
    df.repartition(*by, salt).sortWithinPartitions(*by, *order).write.partitionBy(*by).option("compression", "zstd").mode(mode).parquet(path)
    return path


def read_partitions(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Read such a folder; a predicate on partition columns prunes folders, on others it reaches the parquet scan."""
    df = spark.read.parquet(path)
    return df.where(where) if where else df


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def _read_text(spark: SparkSession, path: str) -> str | None:
    rows = spark.read.option("wholetext", True).text(path).collect() if _fs(spark, path)[0].exists(_fs(spark, path)[1]) else []
    return rows[0][0] if rows else None


def publish(df: DataFrame, path: str, key: dict, by: Sequence[str] = ()) -> dict:
    """Write a data set and, last, its manifest; the manifest marks it as accepted.

    ``key`` says what the data set is made of (inputs, parameters). A folder whose
    manifest has the same key is left as it is and its manifest returned; a folder
    without a manifest is an aborted write and is replaced; another key is an error.
    """
    spark = df.sparkSession
    text = json.dumps(key, sort_keys=True)
    fs, manifest = _fs(spark, f"{path}/manifest.json")
    if fs.exists(manifest):
        old = json.loads(_read_text(spark, f"{path}/manifest.json"))
        if json.dumps(old["key"], sort_keys=True) != text:
            raise FileExistsError(f"{path} holds another data set")
        return old
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/data")
    n, digest = spark.read.parquet(f"{path}/data").select(F.xxhash64(*df.columns).cast("decimal(20,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    told = {"key": key, "rows": n, "digest": str(digest), "columns": df.dtypes}
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.tmp"), True)
    out.write(bytearray(json.dumps(told, sort_keys=True), "utf-8"))
    out.close()
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.tmp"), manifest)
    return json.loads(json.dumps(told))


def report_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON document per row with its own hash beside it."""
    body = F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})
    return df.select(body.alias("document")).withColumn("sha256", F.sha2("document", 256))
