"""Tables, scratch space and small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of this machine only where none is set and Spark runs on it alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own_scratch:
        _own_scratch["dir"] = tempfile.mkdtemp(prefix="cellweave-scratch-")
    return _own_scratch["dir"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sealed(docs: DataFrame, keep: list[str], made: tuple[str, ...] = ()) -> tuple[list[Column], list[Column], str]:
    """The kept columns under names that nothing else uses, how to show them again, and their types as a schema.

    A kept column that has the name of a column that the operator makes is left out: the operator's wins.
    """
    hidden = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    shown = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c not in made]
    return hidden, shown, ", ".join(f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))


def chunks(batches: Iterator[pd.DataFrame], column: str, most: int) -> Iterator[pd.DataFrame]:
    """Slices of the Arrow batches whose texts hold about ``most`` characters, so that memory stays bounded.

    A text that alone is longer makes a slice of its own. Empty batches are passed over.
    """
    for batch in batches:
        if not len(batch):
            continue
        sizes = batch[column].str.len().fillna(0).to_numpy().astype("int64").cumsum()
        start = 0
        while start < len(batch):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(sizes.searchsorted(before + most, side="right")))
            yield batch.iloc[start:end]
            start = end


def texts(column: pd.Series) -> list[str]:
    """The texts, with null as the empty text."""
    return ["" if x is None or x != x else x for x in column.tolist()]
