"""Repeated lines dropped from all documents but the first that holds them, in DataFrame functions only.

Documents come in batches of ascending ids. What is known of earlier batches are runs: tables of line hashes with the
smallest document that holds each, bucketed and sorted by hash. A batch's own hashes, aggregated before any shuffle,
are merge-joined with every run; those that no run has (the anti-join) become a run of level 0. As soon as a level has
``fanout`` runs, they are merged into one of the next level, so that a batch meets few runs however many came before. Since
every run is bucketed alike, only the batch's hashes are shuffled for these joins.

Texts are hashed once; what follows works on the staged hashes. Those found in two documents, with their first document, then decide all lines, and one join brings the dropped places to the texts.
Hashes that make up a thousandth of all lines or more (so at most a thousand of them) are sent to all tasks; the
others are joined by shuffling, where each is rare. Line hashes have 128 bits.

    store = Runs(spark)
    repeated = store.add(line_keys(first_batch))   # and so on for later batches
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellweave.llm.common import scratch_dir, sealed, staged

#: Fixed values of the contract: what is stripped, and the least length of a key.
BLANKS, SHORTEST = " \t\n\x0b\x0c\r", 10
#: A hash that makes up more than one in so many lines is common.
COMMON = 1000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MADE = ("n_lines", "n_dropped", "kept")
HASH = ["k1", "k2"]


def key(line: Column) -> Column:
    """What two lines must share to be the same: the stripped line, A to Z in lower case (and no other letter)."""
    inner = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(inner) == F.length(inner), F.lower(inner)).otherwise(F.translate(inner, _UPPER, _UPPER.lower()))


def hashes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(id, text_hash, at, k1, k2): a row for each line whose key has at least ``shortest`` code points."""
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("parts"))
    rows = rows.select("id", "text_hash", F.posexplode("parts").alias("at", "line"))  # what is of the text is made before, once
    rows = rows.where(F.length(F.btrim("line", F.lit(BLANKS))) >= shortest).select("id", "text_hash", "at", key(F.col("line")).alias("key"))
    return rows.select("id", "text_hash", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), F.col("key")).alias("k2"))


class Runs:
    """Runs of line hashes on levels; ``add`` takes a batch whose ids are above those of earlier batches.

    Runs are tables of the session's catalog that lie in the shared folder under names of their own.
    """

    def __init__(self, spark: SparkSession, *, fanout: int = 3, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("runs are merged two at a time at least")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        name = f"cellweave_run_{uuid.uuid4().hex}"
        out = rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{scratch_dir(self.spark)}/cellweave/{name}").option("compression", "zstd")
        out.format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame, *, last: bool = False) -> DataFrame:
        """The batch's hashes that two documents hold, in it or before: (k1, k2, owner, lines); its new ones become a run.

        batch: (id, k1, k2). owner: the smallest id that holds the hash, now or earlier; lines: rows of the batch. A null
        id is a document of its own that comes after all others. last: no batch follows, so nothing is merged.
        """
        own = batch.groupBy(*HASH).agg(F.min("id").alias("own"), F.max("id").alias("top"), F.max(F.col("id").isNull()).alias("any_null"), F.count("*").alias("lines"))
        found = own
        for i, run in enumerate(r for level in self.levels for r in level):
            found = found.join(run.select(*HASH, F.col("owner").alias(f"o{i}"), F.lit(True).alias(f"h{i}")).hint("merge"), HASH, "left")
        n = sum(map(len, self.levels))
        held = reduce(lambda a, b: a | b, [F.col(f"h{i}").isNotNull() for i in range(n)], F.lit(False))
        owner = F.coalesce(*[F.col(f"o{i}") for i in range(n)], F.col("own"))
        here = (F.col("own") < F.col("top")) | (F.col("any_null") & F.col("own").isNotNull())
        rows = found.select(*HASH, owner.alias("owner"), "lines", (~held).alias("fresh"), (held | F.coalesce(here, F.lit(False))).alias("repeated"))
        rows = self._sorted(rows.repartition(self.buckets, *HASH) if n == 0 else rows)
        if not last:
            self._place(rows.where("fresh").select(*HASH, "owner"), 0)
        return rows.where("repeated").select(*HASH, "owner", "lines")

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level]).repartition(self.buckets, *HASH)
            self.levels[level] = []
            self._place(self._sorted(merged), level + 1)


def _bounds(rows: DataFrame, id: str, batches: int) -> list[int]:
    """Ids that part the rows into about equal batches; at most ``batches`` - 1 numbers come to the driver."""
    if batches < 2:
        return []
    cuts = rows.agg(F.percentile_approx(id, [i / batches for i in range(1, batches)], 1000).alias("c")).first().c
    return sorted(set(cuts or []))


def deduplicated(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: list[str], shortest: int = SHORTEST, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Each row's n_lines, n_dropped and kept text, with the kept columns.

    A line whose key two documents hold stays in the one with the smallest id alone, as often as that has it. Rows of one
    id are one document, and repeated rows have equal results. A null id is a document after all others; a null or
    empty text is one empty line, which is too short to be a key. Long texts are rows like others: a text's lines are
    arrays in one row. Kept columns that have the name of a made one give way to it. An empty table gives an empty
    result. ``batches`` only says in how many steps the documents meet the runs, not what comes out.
    """
    spark = docs.sparkSession
    hidden, shown, _ = sealed(docs, keep, MADE)
    lines = staged(hashes(docs, id=id, text=text, shortest=shortest), "line-hashes")
    store, repeated = Runs(spark, fanout=fanout), []
    cuts = _bounds(lines, "id", batches)
    for i in range(len(cuts) + 1):
        here = F.lit(True)
        if i:
            here = here & F.coalesce(F.col("id") > cuts[i - 1], F.lit(i == len(cuts)))
        if i < len(cuts):
            here = here & (F.col("id") <= cuts[i])
        repeated.append(store.add(lines.where(here).select("id", *HASH), last=i == len(cuts)))
    owners = reduce(DataFrame.unionByName, repeated).groupBy(*HASH).agg(F.min("owner").alias("owner"), F.sum("lines").alias("lines"))
    owners = staged(owners, "line-owners")
    common = owners.where(F.col("lines") > owners.agg(F.sum("lines")).first()[0] / COMMON) if owners.head(1) else owners
    lines = lines.join(F.broadcast(common.select(*HASH, F.col("owner").alias("first"))), HASH, "left")
    # The lines that are decided go where their document and place put them, so that no task gets all of them.
    spread = F.col("first").isNotNull()
    lines = lines.select("id", "text_hash", "at", "first", F.when(spread, F.xxhash64("id", "text_hash", "at")).otherwise(F.col("k1")).alias("k1"), F.when(spread, F.lit(-1)).otherwise(F.col("k2")).alias("k2"))
    lines = lines.join(owners.select(*HASH, "owner"), HASH, "left").withColumn("owner", F.coalesce("first", "owner"))
    dropped = lines.where(F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner")))
    dropped = dropped.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("at").alias("_at"))
    rows = docs.select(*hidden, F.col(id).alias("_own"), F.xxhash64(text).alias("_text_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.join(dropped, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    rows = rows.select(*[c for c in rows.columns if c.startswith("_k")], F.split("_text", "\n", -1).alias("_lines"), "_text", "_at")
    kept = F.expr(r"array_join(transform(array_except(sequence(0, size(_lines) - 1), _at), i -> _lines[i]), '\n')")
    return rows.select(
        *shown,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_at").isNull(), F.col("_text")).otherwise(kept).alias("kept"),
    )


#: The same in SQL, where the table has no null id.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY doc_id
"""
