"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Training time runs from 0 to 1. Source s has the schedule w_s(t) = target_s * (1 + slope_s * (2t - 1)), whose
integral is its cumulative token demand D_s(t) = target_s * (t + slope_s * (t*t - t)). The source's documents, in a
scrambled order that depends on their ids alone, are laid end to end (again and again if the target exceeds the
source), and the document whose words begin at offset c gets the position D_s^-1(c / target_s). Documents of all
sources are then range-sorted by position.

Targets: sources share the words of all documents by weight, but none gets more than ``most_repeats`` times its
size; what they can't take is shared by the others by weight until none is above. The last round of a source stops
at the word where its target is met, so that taken words equal the rounded target.

Null texts have no words; a null source is a source of its own, last in order; rows with a null id are placed by a
hash of their text. Ties in the scrambled order are broken by id and size; repeated rows are taken as
separate documents. Documents without words take nothing and get a position all the same. An empty table gives an
empty result. Running sums work within buckets of each source, so a source that holds most rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.llm.common import sealed, staged

#: Fixed value of the contract: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: A multiplier that scrambles ids, and the bits that it works on.
SCRAMBLE, BITS = 2654435761, 31


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scrambled(id: Column) -> Column:
    """The place of a document in its source's order before ties: the id times a constant, modulo 2 ** 31."""
    return F.pmod(F.pmod(id, F.lit(1 << BITS)) * F.lit(SCRAMBLE), F.lit(1 << BITS))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """(source, source_size, weight, target) for sizes (source, size): one row per source.

    The sources that their cap holds are those of least cap per weight, so one pass in that order finds them all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", cycle.cast("double"))
    cap = (F.lit(most_repeats) * F.col("source_size")).cast("double")
    before = W.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") < cap)
    # The level rises while sources are held by their cap and falls after the first that isn't.
    final = F.max(F.when(F.col("_open"), F.col("_level"))).over(every)
    target = F.coalesce(F.least(cap, final * F.col("weight")), cap)
    return per.select("source", "source_size", "weight", F.round(target, 6).alias("target"))


def mixed(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, per_bucket: int = 10_000) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies, position, positions) and ``keep``, range-sorted by position.

    taken: words the mix takes of the document; copies: how many whole copies that is, with the one that the target
    cuts counted if at least half of it is taken; position: where in training its first round begins; positions: where each copy does.
    """
    made = ("id", "source", "size", "source_size", "target", "taken", "copies", "position", "positions", id)
    hidden, shown, _ = sealed(docs, list(keep), made)
    own = [f"_k{i}" for i in range(len(keep))]
    place = F.coalesce(scrambled(F.col(id)), F.pmod(F.xxhash64(text), F.lit(1 << BITS)))
    sizes = staged(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), place.alias("place"), *hidden), "sizes")
    per = source_targets(sizes, weights=weights, most_repeats=most_repeats)
    # The scrambled order is cut in equal ranges; there are more of them the more documents there are.
    n = sizes.count()
    shift = max(0, BITS - max(0, (n // per_bucket).bit_length()))
    rows = sizes.withColumn("bucket", F.shiftright(F.col("place"), shift))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    per = per.withColumnRenamed("source", "_p")
    starts = starts.join(per, F.col("source").eqNullSafe(F.col("_p"))).drop("_p")
    within = W.partitionBy("source", "bucket").orderBy("place", "id", "size", *own).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    s = starts.withColumnsRenamed({"source": "_s", "bucket": "_b"})
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    offset = F.col("_start") + F.col("_within")
    quota = F.round(F.col("target")).cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    left = quota - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - offset))
    taken = full * F.col("size") + part
    copies = full + F.when((part > 0) & (part * 2 >= F.col("size")), 1).otherwise(0)
    # Slopes: light sources come early, heavy ones late.
    slope = (F.col("weight") - F.lit(sum(weights) / len(weights))) / F.lit(2.0 * max(weights))
    flat = F.lit(1.0) - slope

    def position(begin: Column) -> Column:
        share = F.when(F.col("target") > 0, F.least(F.lit(1.0), begin / F.col("target"))).otherwise(F.lit(0.0))
        return F.when(slope == 0, share).otherwise((F.sqrt(flat * flat + F.lit(4.0) * slope * share) - flat) / (F.lit(2.0) * slope))

    rows = rows.withColumn("copies", copies.cast("int"))
    each = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda j: position(offset + j * F.col("source_size")))).otherwise(F.array().cast("array<double>"))
    out = rows.select("id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", position(offset).alias("position"), each.alias("positions"), *own)
    out = out.repartitionByRange("position", "id").sortWithinPartitions("position", "id")
    return out.select(F.col("id").alias(id), *made[1:-1], *shown)


#: The same in SQL, where the table has no null id; the running sums need no buckets there.
SQL = r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM per),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT max(lev) AS lev FROM levels WHERE lev * weight < cap),
targets AS (SELECT source, source_size, round(CASE WHEN final.lev IS NULL THEN cap ELSE least(cap, final.lev * weight) END, 6) AS target FROM levels, final),
placed AS (SELECT *, coalesce((((doc_id % 2147483648) + 2147483648) % 2147483648 * 2654435761) % 2147483648, -1) AS place FROM sizes),
laid AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM placed)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (round(target)::BIGINT // source_size) * size
     + greatest(0, least(size, round(target)::BIGINT - (round(target)::BIGINT // source_size) * source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM laid JOIN targets t ON laid.source IS NOT DISTINCT FROM t.source
"""
