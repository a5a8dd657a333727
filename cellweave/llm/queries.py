"""The thin queries over the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.llm import lines, media, mixing, near_text, near_vectors, packing, periodic, pii, pipeline, prefix_trie, quality, repeats, secrets, spans, toxicity
from cellweave.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; only documents with crc32(doc_id) mod 3 other than 1 are learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = table(spark, sf_dir, "labels").where(~held & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = toxicity.MAX_ROWS
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = docs.join(F.broadcast(known), "doc_id").select(F.col("doc_id").alias("id"), "text", "label")
    weights = toxicity.fit(labelled, max_rows=rows)
    scored = toxicity.score(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality and whether the classifier keeps it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs), keep=["doc_id"])
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.VOCABULARY))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and number of links."""
    return near_text.classes(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a progressive JPEG and read back; the RGB tensor is the last column."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    out = media.stored(docs, keep=["doc_id", "n_bytes"])
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", F.octet_length("payload") - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        "rgb",
    )


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix, in order of training."""
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and hash of the base spans of each document, and all its spans."""
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.k = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its long repeats."""
    out = repeats.removed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return _digest(pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"]), pii.KINDS)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return _digest(secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]), secrets.KINDS)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, one in ten of which is made periodic from a place on, as its id says."""
    hashed = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", hashed.alias("h"))
    repeated = F.expr(
        r"""aggregate(array(1), filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != ''), (a, x) -> a, w ->
        CASE WHEN size(w) = 0 THEN '' ELSE array_join(transform(w, (x, i) -> CASE
          WHEN i < (h div 10) % size(w) THEN x
          ELSE w[cast((h div 10) % size(w) + (i - (h div 10) % size(w)) % (1 + (size(w) - (h div 10) % size(w)) div (3 + (h div 10) % 8)) AS int)]
          END), ' ') END)"""
    )
    docs = docs.select("doc_id", F.when(F.col("h") % 10 == 0, repeated).otherwise(F.col("text")).alias("text"))
    found = periodic.runs(docs, keep=["doc_id"])
    found = found.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each beginning with turns of the one whose id is the next lower multiple of 20."""
    own = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    heads = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    both = own.join(heads, F.col("head_id") == F.col("conv_id") - F.col("conv_id") % 20, "left")
    turns = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return prefix_trie.trie(both.select("conv_id", turns.alias("turns")))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the lines that an earlier one holds."""
    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_packing": op2_packing, "op3_jaccard": op3_jaccard, "op4_media": op4_media, "op5_vectors": op5_vectors, "op6_mixing": op6_mixing, "op7_repeats": op7_repeats, "op8_pii": op8_pii, "op9_secrets": op9_secrets, "op10_quality": op10_quality, "op11_periodic": op11_periodic, "op12_trie": op12_trie, "op13_lines": op13_lines, "pipeline": pipeline.run}
ORACLES: dict[str, str] = {"op5_vectors": near_vectors.SQL, "op6_mixing": mixing.SQL, "op12_trie": prefix_trie.SQL, "op13_lines": lines.SQL}
