"""A training corpus from raw documents, in five stages of the text operators.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet before
the next one reads it. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.llm import mixing, near_text, packing, quality, secrets
from cellweave.llm.common import staged, table

#: No SQL: the classifier is trained, and the tokenizer isn't a SQL function. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (a score of at least 1/2).

    Null and empty texts are scored as texts without tokens. Repeated rows and ties in id get equal scores and stay or
    go together; texts of any length are read whole. An empty table gives an empty table.
    """
    weights = quality.fit(docs)
    return quality.score(docs, weights, keep=docs.columns).where("score >= 0.5").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies, that of least id, then least hash of its text and row.

    Classes are of texts: an id that different texts share keeps each of them that is no near copy of another. Null and
    empty texts are copies of nothing but repeated rows of their own id. Documents without an id stay; an empty table
    gives an empty table.
    """
    return near_text.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced and lengths counted anew.

    Null and empty texts stay as they are. Repeated rows are masked alike; texts of any length are searched whole. An
    empty table gives an empty table.
    """
    return secrets.masked(docs)


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in order of training. Documents without id come once, at the end.

    Documents without words (null and empty texts) are taken no time. Rows of one id are placed one after the other, by
    size. An empty table gives an empty table.
    """
    named = docs.where("doc_id is not null").withColumn("_cellweave_row", near_text.row_hash(docs))
    shares = mixing.mixed(named, keep=("_cellweave_row",)).where("copies > 0").select("doc_id", "_cellweave_row", F.explode("positions").alias("_cellweave_at"))
    # rows alike in every column have one hash: one of them stands for all, with the positions of all
    rows = named.dropDuplicates(["doc_id", "_cellweave_row"]).join(shares, ["doc_id", "_cellweave_row"]).select(*docs.columns, "_cellweave_at")
    rows = rows.union(docs.where("doc_id is null").withColumn("_cellweave_at", F.lit(2.0)))
    return rows.repartitionByRange("_cellweave_at", "doc_id").sortWithinPartitions("_cellweave_at", "doc_id").drop("_cellweave_at")


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a training sequence.

    Null texts count as empty and hold the end token alone. Repeated rows are documents of their own and may trade
    places; long texts are cut in pieces of the capacity. An empty table gives an empty table.
    """
    return packing.packed(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed_by_source),
    ("packing", in_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
