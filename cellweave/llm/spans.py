"""Spans of pattern matches in whole texts, with code point offsets, in DataFrame functions only.

The text between matches (split) and the matches themselves (regexp_extract_all) alternate, so running lengths give
every match its place. Patterns are written so that no text makes them backtrack: runs are possessive, and a match
may begin in the midst of a run only where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<s:int,e:int,v:string,w:string>>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str | None, str, int]]) -> DataFrame:
    """Adds for each name the array of its matches: s, e (end exclusive), v (the match) and w (a group of it).

    patterns: name to (a cheap pattern that a text must contain to be searched, None to search every text, the pattern,
    the group of w).
    """
    keep = [F.col(c) for c in df.columns]
    none = F.array().cast("array<string>")

    def matches(cheap: str | None, pattern: str) -> Column:
        all_of = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), none)
        return all_of if cheap is None else F.when(F.col(text).rlike(cheap), all_of).otherwise(none)

    def where_any(name: str, value: Column) -> Column:
        return F.when(F.size(f"_m_{name}") > 0, value).otherwise(none)

    searched = df.select(*keep, *[matches(cheap, p).alias(f"_m_{k}") for k, (cheap, p, _) in patterns.items()])
    found = searched.select(
        *keep,
        *[F.col(f"_m_{k}") for k in patterns],
        *[where_any(k, F.regexp_extract_all(text, F.lit(p), F.lit(g))).alias(f"_g_{k}") for k, (_, p, g) in patterns.items() if g],
        *[where_any(k, F.split(text, p, -1)).alias(f"_p_{k}") for k, (_, p, _) in patterns.items()],
    )
    return found.select(*keep, *[_placed(f"_m_{k}", f"_p_{k}", f"_g_{k}" if g else f"_m_{k}").alias(k) for k, (_, _, g) in patterns.items()])


def _placed(matches: str, between: str, group: str) -> Column:
    return F.expr(
        f"""CASE WHEN size({matches}) = 0 THEN cast(array() AS {SPAN}) ELSE
        aggregate(sequence(0, size({matches}) - 1), named_struct('at', 0, 'out', cast(array() AS {SPAN})),
          (a, i) -> named_struct('at', a.at + length({between}[i]) + length({matches}[i]),
            'out', concat(a.out, array(named_struct('s', a.at + length({between}[i]), 'e', a.at + length({between}[i]) + length({matches}[i]), 'v', {matches}[i], 'w', {group}[i])))),
          a -> a.out) END"""
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_right = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(
            F.filter(from_right, lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def joined(spans: Column) -> Column:
    """kind:start:end of spans (k, s, e), comma-joined, in the order that they have."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["s"] < span["e"]) & (span["s"] < o["e"]))
