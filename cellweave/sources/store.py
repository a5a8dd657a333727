"""Append-only tables (ledger, register) and content-addressed results, as Parquet under a root that Spark can reach."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER = "id string, kind string, family string, actor string, split string, spec string, p double, effect double, result string, code_version string, data_version string, at string"


def key_of(declaration: dict) -> str:
    """The key of a declaration: changing any of it gives another key."""
    return hashlib.sha256(json.dumps(declaration, sort_keys=True, default=str).encode()).hexdigest()[:32]


def put(df: DataFrame, root: str, kind: str, declaration: dict) -> str:
    """Writes a result under its declaration's key with the declaration beside it; a result already there stays."""
    spark, key = df.sparkSession, key_of(declaration)
    path = f"{root}/{kind}/{key}"
    if get(spark, root, kind, declaration) is None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
        spark.createDataFrame([(key, json.dumps(declaration, sort_keys=True, default=str))], "key string, declaration string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return key


def get(spark: SparkSession, root: str, kind: str, declaration: dict) -> DataFrame | None:
    """The result of a declaration, or None. It counts as there once its manifest does."""
    path = f"{root}/{kind}/{key_of(declaration)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(f"{path}/data")


def append(rows: DataFrame, path: str) -> None:
    """Adds states to an append-only table."""
    rows.write.mode("append").option("compression", "zstd").parquet(path)


def compacted(spark: SparkSession, path: str, to: str, *, rows_per_file: int = 1_000_000) -> None:
    """Rewrites the many small parts of an append-only table as few."""
    spark.read.parquet(path).write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").mode("overwrite").parquet(to)


def export(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Every table in a folder of its own, as Parquet, CSV or JSON."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{folder}/{name}") if fmt == "csv" else w.format(fmt).save(f"{folder}/{name}")


def ensure_year(records: DataFrame, root: str) -> None:
    """A dataset's records by year, written once and overwritten year by year on a second run."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(root)


def ledger_status(ledger: DataFrame) -> DataFrame:
    """Tests by family and actor, and how many of them have a result."""
    per = ledger.groupBy("id", "family", "actor").agg(F.max((F.col("kind") == "result").cast("int")).alias("done"))
    return per.groupBy("family", "actor").agg(F.count("*").alias("tests"), F.sum("done").alias("results"))
