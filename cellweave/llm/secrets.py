"""Secrets in whole texts, with weak parts linked to complementary ones, in DataFrame functions only.

Base spans (assignments of secrets, access identifiers, long hexadecimal runs) are always reported. Wider patterns
propose weak parts, each too common to report alone: identifiers of other forms, secrets without a name, endpoints.
Parts become rows of (text, place); an interval join on (text, scope window) links parts that lie within ``scope``
characters of each other, and a weak identifier or secret is reported only where a complementary part co-occurs: an
identifier with a secret, or a secret with an identifier or with a named endpoint. A window of a text holds few
parts (each has several characters), so the join's output is bounded by the texts' lengths.

Null texts count as empty. Texts are known by their hash, so repeated rows get equal results. A weak part that
overlaps a base span isn't reported again. Columns beyond the named ones pass through ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm import spans
from cellweave.llm.common import sealed, staged

KINDS = ("assign", "access", "hex")
#: Fixed values of the contract; the last two with the least length in the pattern, which finds the same spans.
#: Every pattern here and below is searched for in every text.
BASE = {
    "assign": (None, r"""(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+([A-Za-z0-9+/_.=-]++)""", 1),
    "access": (None, "AKIA[A-Z0-9]{16,}+", 0),
    "hex": (None, "(?<![0-9a-f])[0-9a-f]{24,}+", 0),
}
#: Weak parts by role: identifier, secret, endpoint.
WEAK = {
    "weak_id": (None, r"""(?<![A-Za-z0-9])(?:(?:ASIA|AKIA)[A-Z0-9]{12,}+|(?i:client_?id|username|user)["']?+ *+[:=] *+["']?+[A-Za-z0-9+/_.@-]{3,}+)""", 0),
    "weak_secret": (None, r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/_=-])", 0),
    "endpoint": (None, r"https?://[A-Za-z0-9.-]{3,253}+(?::[0-9]{1,5})?+", 0),
}
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


def _part(name: str):
    return lambda x: F.struct(F.lit(name).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(name in BASE).alias("base"))


def parts(docs: DataFrame, *, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` (under names of its own), the text's hash and its parts (k, s, e, base), base spans first."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = spans.with_matches(rows, "_t", BASE | WEAK)
    made = []
    for name in BASE | WEAK:
        some = F.filter(name, lambda x: F.length(x["w"]) >= 6) if name == "assign" else F.col(name)
        made.append(F.transform(some, _part(name)))
    return found.select(*[f"_k{i}" for i in range(len(keep))], F.xxhash64("_t").alias("_text"), F.length("_t").alias("_length"), F.flatten(F.array(*made)).alias("parts"))


def linked(each: DataFrame, *, scope: int) -> DataFrame:
    """Pairs of complementary parts (_text, _length, k, s, e, and the other's) within ``scope`` characters."""
    each = each.withColumn("role", F.element_at(F.create_map(*[F.lit(x) for p in ROLE.items() for x in p]), F.col("k")))
    left = each.where("not base and role <> 'endpoint'").withColumn("window", F.explode(F.sequence(F.expr(f"cast((s - {scope}) as int) div {scope}"), F.expr(f"cast((e + {scope}) as int) div {scope}"))))
    right = each.select("_text", "_length", F.col("role").alias("other"), F.col("k").alias("other_k"), F.col("s").alias("other_s"), F.col("e").alias("other_e"))
    # a part that doesn't overlap is met at the end that is nearer, so two windows do for any length
    right = right.withColumn("window", F.explode(F.array_distinct(F.array(F.expr(f"cast(other_s as int) div {scope}"), F.expr(f"cast(other_e as int) div {scope}")))))
    met = left.join(right, ["_text", "_length", "window"])
    apart = F.greatest(F.col("s") - F.col("other_e"), F.col("other_s") - F.col("e"))
    return met.where((F.col("role") != F.col("other")) & (apart <= scope) & (apart >= 0) & ((F.col("role") == "secret") | (F.col("other") == "secret")))


def scan(docs: DataFrame, *, text: str = "text", keep: list[str], scope: int = 200) -> DataFrame:
    """``keep`` and ``spans``: (k, s, e, base) of each text by start, then kind as listed.

    A linked weak identifier is reported as ``access``, a linked weak secret as ``assign``.
    """
    hidden, shown, _ = sealed(docs, keep, ("spans",))
    found = staged(parts(docs, text=text, keep=hidden), "secrets")
    each = found.where("exists(parts, p -> not p.base)").select("_text", "_length", F.explode("parts").alias("p")).select("_text", "_length", "p.*").distinct()
    weak = linked(each, scope=scope).groupBy("_text", "_length").agg(F.collect_set(F.struct("k", "s", "e")).alias("_weak"))
    w = weak.withColumnsRenamed({"_text": "_wt", "_length": "_wl"})
    # only texts with weak parts are joined with what was linked
    some = found.where("exists(parts, p -> not p.base)").join(w, (F.col("_text") == F.col("_wt")) & (F.col("_length") == F.col("_wl")), "left").drop("_wt", "_wl")
    rows = found.where("not exists(parts, p -> not p.base)").withColumn("_weak", F.lit(None).cast("array<struct<k:string,s:int,e:int>>")).unionByName(some)
    base = F.filter("parts", lambda p: p["base"])
    name = lambda k: F.when(k == "weak_id", "access").when(k == "weak_secret", "assign").otherwise(k)
    rows = rows.withColumn("_base", base)
    more = F.filter(F.coalesce("_weak", F.array().cast("array<struct<k:string,s:int,e:int>>")), lambda x: ~spans.overlaps(x, F.col("_base")))
    both = F.concat(F.transform("_base", lambda x: F.struct(x["s"], F.array_position(F.array(*map(F.lit, KINDS)), x["k"]).alias("i"), x["e"], x["k"], x["base"])), F.transform(more, lambda x: F.struct(x["s"], F.array_position(F.array(*map(F.lit, KINDS)), name(x["k"])).alias("i"), x["e"], name(x["k"]).alias("k"), F.lit(False).alias("base"))))
    return rows.select(*shown, F.transform(F.array_sort(both), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))).alias("spans"))


def masked(docs: DataFrame, *, text: str = "text", length: str = "n_chars", mask: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``, overlapping ones by one; ``length`` counts anew."""
    own = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    t = own[text]
    found = scan(docs.withColumnsRenamed(own), text=t, keep=list(own.values()), scope=scope)
    new = F.expr(
        f"""CASE WHEN size(spans) = 0 THEN {t} ELSE
        aggregate(spans, named_struct('at', 0, 'out', ''),
          (a, x) -> named_struct('at', greatest(a.at, x.e), 'out',
            CASE WHEN x.s < a.at THEN a.out ELSE concat(a.out, substring({t}, a.at + 1, x.s - a.at), '{mask}') END),
          a -> concat(a.out, substring({t}, a.at + 1, length({t})))) END"""
    )
    made = {t: new}
    if length in own:
        made[own[length]] = F.when(F.size("spans") == 0, F.col(own[length])).otherwise(F.length(new)).cast(docs.schema[length].dataType)
    return found.withColumns(made).select(*[F.col(d).alias(c) for c, d in own.items()])
