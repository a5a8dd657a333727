"""Tables written to the cluster's shared folder, so that long jobs survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under spark.checkpoint.dir (a local folder only where none is set) and read again."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="cellweave-"))
        top = _own[0]
    path = f"{top}/cellweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
