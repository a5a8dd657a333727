"""Personal data in whole texts by weak supervision, in DataFrame functions only.

Patterns propose spans of emails, IP addresses, card and phone numbers. Those that pass the fixed base rules are
always reported. Wider patterns propose further spans (addresses with the signs spelt out, phone numbers without a
country code, and card and phone numbers that stand beside other digits, so that the base rules drop the whole run).
Four labelers vote on every candidate: the form rules, a gazetteer of known value parts, cue words
before the span, and the characters around it. Spark counts the vote patterns of all candidates (at most 4 kinds
times 2 origins times 81); expectation-maximisation over these counts estimates each labeler's reliability and each pattern's
posterior. The posteriors of all candidates train the final span classifier, log-odds of the span's features summed
over all candidates by Spark, and further spans are reported where it is at least ``certain`` sure and no base span
overlaps.

Null texts count as empty. Without candidates nothing is reported. Repeated rows get equal results; ties in start
can't occur within a kind except between a base span and none. Columns beyond the named ones pass through ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm import spans
from cellweave.llm.common import sealed, staged

#: The order in which kinds are reported.
KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the contract, as patterns that match the same spans without backtracking.
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0),
    "card": (r"[0-9](?:[ -]?+[0-9]){15}", r"[0-9](?:[ -]?+[0-9])++", 0),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0),
}
#: Wider patterns, by the kind that they propose.
WIDE = {
    "wide_email": (r"(?i)[(\[]at[)\]]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}+)++", 0),
    "wide_card": (r"[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4}", r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])", 0),
    "wide_phone": (r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?)?+\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])", 0),
}
#: Words that announce a kind, and words that announce something else, in the languages of the corpus.
CUES = {
    "email": "e-?mail|mail|contact|correo|courriel|kontakt|schreib|write",
    "ip": r"\bip\b|host|server|address|adresse|direcci",
    "card": "card|carte|karte|tarjeta|visa|credit|kredit",
    "phone": "phone|tel|call|fax|mobil|cell|whatsapp|anruf|appel|llama",
}
OTHER_CUES = r"version|section|isbn|order|invoice|\bv\b|release|chapter|doi|item"
#: Known parts of values.
KNOWN = {
    "email": r"(?i)[.) ](?:com|org|net|edu|gov|io|info|de|fr|es|uk)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:3[47]|4|5[1-5]|6011|65|2[2-7])",
    "phone": r"^(?:\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])|\(?[2-9][0-9]{2})",
}


def base_valid(kind: str, value: Column) -> Column:
    """The fixed rules that a match of a kind must pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        d = spans.digits(value)
        return F.when(F.length(d).between(16, 19), spans.luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(spans.digits(value)).between(8, 15)
    return F.lit(True)


def form_vote(kind: str, wide: bool, value: Column) -> Column:
    """What the form rules say of a match: 1 yes, 0 no, 2 nothing (a wide match without a rule of its own)."""
    if wide and kind == "email":
        return F.lit(2)
    vote = F.when(base_valid(kind, value), 1).otherwise(0)
    return F.when(value.startswith("+"), vote).otherwise(F.lit(2)) if wide and kind == "phone" else vote


def _candidate(name: str, around: int):
    """What makes a candidate of one match of the pattern ``name``."""
    kind = name.removeprefix("wide_")
    wide = name != kind

    def span(x: Column) -> Column:
        before = F.lower(F.substring("_t", F.greatest(x["s"] - around + 1, F.lit(1)), F.least(x["s"], F.lit(around))))
        last = F.when(x["s"] > 0, F.substring("_t", x["s"], F.lit(1))).otherwise(F.lit(""))
        next = F.substring("_t", x["e"] + 1, F.lit(1))
        valid = F.lit(False) if wide else base_valid(kind, x["v"])
        votes = F.array(
            form_vote(kind, wide, x["v"]),
            F.when(x["v"].rlike(KNOWN[kind]), 1).otherwise(0),
            F.when(before.rlike(CUES[kind]), 1).when(before.rlike(OTHER_CUES), 0).otherwise(2),
            F.when(last.rlike("[A-Za-z0-9_/=#]") | next.rlike("[A-Za-z0-9_/=#]"), 0).when(last.rlike(r"[\s(<:;,]") | (last == ""), 1).otherwise(2),
        )
        n = F.length(spans.digits(x["v"]))
        features = F.array(
            F.concat(F.lit(f"{kind} form "), votes[0].cast("string")),
            F.concat(F.lit(f"{kind} digits "), F.least(n, F.lit(24)).cast("string")),
            F.concat(F.lit(f"{kind} length "), F.least(F.floor(F.length(x["v"]) / 4), F.lit(12)).cast("string")),
            F.concat(F.lit("left "), F.when(last.rlike(r"\s"), "space").when(last.rlike("[A-Za-z0-9]"), "word").when(last == "", "none").otherwise("sign")),
            F.concat(F.lit("right "), F.when(next.rlike(r"\s"), "space").when(next.rlike("[A-Za-z0-9]"), "word").when(next == "", "none").otherwise("sign")),
            F.concat(F.lit(f"{kind} cue "), votes[2].cast("string")),
            F.concat(F.lit(f"{kind} known "), votes[1].cast("string")),
        )
        return F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), valid.alias("base"), F.lit(wide).alias("wide"), votes.alias("votes"), features.alias("features"))

    return span


def candidates(docs: DataFrame, *, text: str, keep: list[Column], around: int = 40) -> DataFrame:
    """``keep`` (under names of its own) and the candidates of each text: kind, place, whether base, the votes (1 yes, 0 no, 2 silent), features."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = spans.with_matches(rows, "_t", BASE | WIDE)
    made = [F.when(F.size(name) > 0, F.transform(name, _candidate(name, around))) for name in BASE | WIDE]
    empty = F.array().cast("array<struct<k:string,s:int,e:int,base:boolean,wide:boolean,votes:array<int>,features:array<string>>>")
    return found.select(*[f"_k{i}" for i in range(len(keep))], F.flatten(F.array(*[F.coalesce(m, empty) for m in made])).alias("found"))


def reliabilities(counts: dict[tuple, int], *, rounds: int = 50, smooth: float = 1.0) -> dict[tuple, float]:
    """The posterior of every (kind, wide, votes), by expectation-maximisation over their counts.

    Each kind has its own share of personal spans and its own labelers' reliabilities; it begins from the majority.
    """
    out: dict[tuple, float] = {}
    for kind in sorted({k[0] for k in counts}):
        own = {k: n for k, n in counts.items() if k[0] == kind}
        p = {k: (1 + k[2].count(1)) / (2 + k[2].count(1) + k[2].count(0)) for k in own}
        for _ in range(rounds):
            total = sum(own.values()) + 2 * smooth
            share = (sum(n * p[k] for k, n in own.items()) + smooth) / total
            seen = [[[smooth] * 3 for _ in range(4)] for _ in range(2)]
            for k, n in own.items():
                for j, v in enumerate(k[2]):
                    seen[1][j][v] += n * p[k]
                    seen[0][j][v] += n * (1 - p[k])
            for k in own:
                odds = math.log(share / (1 - share))
                for j, v in enumerate(k[2]):
                    if v != 2:  # a silent labeler says nothing
                        odds += math.log(seen[1][j][v] / sum(seen[1][j][:2])) - math.log(seen[0][j][v] / sum(seen[0][j][:2]))
                p[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= p
    return out


def span_classifier(spans_of: DataFrame, posterior: dict[tuple, float], *, smooth: float = 5.0) -> tuple[float, dict[str, float]]:
    """Intercept and weight of each feature: log-odds of its soft labels over all candidates, shrunk to those of all by ``smooth`` of them."""
    if not posterior:
        return 0.0, {}
    per = {k: F.lit(float(v)) for k, v in posterior.items()}
    known = F.create_map(*[x for k, v in per.items() for x in (F.lit(_code(k)), v)])
    code = F.concat_ws("|", "k", F.col("wide").cast("string"), F.concat_ws("", F.transform("votes", lambda v: v.cast("string"))))
    rows = spans_of.withColumn("p", F.coalesce(F.element_at(known, code), F.lit(0.5)))
    sums = rows.select("p", F.explode(F.concat(F.array(F.lit("")), "features")).alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    found = {r.f: (r.yes, r.no) for r in sums.collect()}  # a row for each kind of feature
    yes, no = found.pop("")
    share = (yes + 1) / (yes + no + 2)
    prior = math.log(share / (1 - share))
    return prior, {f: math.log((y + smooth * share) / (n + smooth * (1 - share))) - prior for f, (y, n) in found.items()}


def _code(key: tuple) -> str:
    return f"{key[0]}|{str(key[1]).lower()}|{''.join(map(str, key[2]))}"


def detect(docs: DataFrame, *, text: str = "text", keep: list[str], certain: float = 0.9) -> DataFrame:
    """``keep`` and ``spans``: (k, s, e, base) of each text, by kind as listed and start."""
    hidden, shown, _ = sealed(docs, keep, ("spans",))
    found = staged(candidates(docs, text=text, keep=hidden), "personal")
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counts = {(r.k, r.wide, tuple(r.votes)): r.n for r in each.groupBy("k", "wide", "votes").agg(F.count("*").alias("n")).collect()}
    prior, weights = span_classifier(each, reliabilities(counts))
    per = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    sure = math.log(certain / (1 - certain))
    base = F.filter("found", lambda c: c["base"])
    with_base = found.withColumn("_base", base)

    def added(c: Column) -> Column:
        odds = F.aggregate(c["features"], F.lit(float(prior)), lambda a, f: a + F.coalesce(F.element_at(per, f), F.lit(0.0)))
        return c["wide"] & (odds >= sure) & ~spans.overlaps(c, F.col("_base"))

    more = F.filter("found", added)
    order = F.array_sort(
        F.transform(F.concat("_base", more), lambda c: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), c["k"]).alias("i"), c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), c["base"].alias("base")))
    )
    return with_base.select(*shown, F.transform(order, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))).alias("spans"))
