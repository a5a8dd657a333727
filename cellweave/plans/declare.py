"""What a dataset's roles allow: fields that can be read, and why others can't; small grammars of declarations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.sources.records import Roles

LAWS = {"count": "sum", "measure": "weighted_mean", "share": "ratio_of_sums", "flow": "ratio_of_sums", "interval": "weighted_mean", "quality": "ratio_of_sums", "level": "none"}
#: Supports from fine to coarse.
SUPPORTS = ("place", "region", "nation")


@dataclass(frozen=True)
class Field:
    """One series: dataset:event:classifier:node, its kind, the law by which it is lifted, and its finest support."""

    dataset: str
    event: str
    classifier: str
    node: str
    kind: str = "count"
    support: str = "place"

    @property
    def law(self) -> str:
        return LAWS[self.kind]

    @property
    def name(self) -> str:
        return ":".join((self.dataset, self.event, self.classifier, self.node))

    @classmethod
    def parse(cls, name: str, **more: str) -> Field:
        parts = name.split(":")
        if len(parts) != 4 or not all(parts):
            raise ValueError(f"{name!r} isn't dataset:event:classifier:node")
        return cls(*parts, **more)


def common_support(a: Field, b: Field) -> str:
    """The finest support that both fields have."""
    return max(a.support, b.support, key=SUPPORTS.index)


def declared(roles: Roles) -> dict[str, str]:
    """Kind of field to what reads it, or the reason why nothing does."""
    return {
        "count": "event_counts",
        "measure": "mark_moments" if roles.mark else "no mark is declared",
        "share": "share_moments" if roles.status else "no status is declared",
        "quality": "quality_share" if roles.status else "no status is declared",
        "flow": "away_counts" if roles.facility_place else "no second place is declared",
        "interval": "delay_counts" if roles.reported else "no second date is declared",
    }


def coverage(records: DataFrame, roles: Roles) -> list[tuple[str, str]]:
    """Every column with the roles that read it, or that nothing does."""
    used = {role: str(getattr(roles, role)) for role in Roles.__dataclass_fields__ if role != "missing" and getattr(roles, role)}
    out = []
    for c in records.columns:
        by = [role for role, expression in used.items() if re.search(rf"\b{re.escape(c)}\b", expression)]
        out.append((c, ", ".join(by) or "nothing reads it"))
    return out


def base_and_modifiers(text: str) -> tuple[str, list[str]]:
    """The parts of "base+modifier+modifier"."""
    found = re.fullmatch(r"([^+]+)((?:\+[^+]+)*)", text)
    if not found:
        raise ValueError(f"{text!r} isn't base+modifier+...")
    return found[1], re.findall(r"[^+]+", found[2])


@dataclass(frozen=True)
class Offer:
    """A series that a record table offers: its kind, the expression that it reads, and a value if it is of one."""

    kind: str
    column: str
    value: str | None = None


def offers(records: DataFrame, roles: Roles, *, values: dict[str, list] | None = None, classifiers: tuple[str, ...] = (), places: tuple[str, ...] = (), groups: dict[str, tuple[str, ...]] | None = None, links: tuple[str, ...] = ()) -> list[Offer]:
    """All series of a record table by declaration: measures, shares, missing values, flows, delays, classifiers, supports, mentions, links.

    Measures are numeric columns that no role reads; ``values`` has the values of columns that make shares (see
    ``reading.value_shares``); classifiers, places, groups of code columns and links are declared, as their names don't tell.
    """
    used = {c for c, by in coverage(records, roles) if by != "nothing reads it"}
    kinds = dict(records.dtypes)
    out = [Offer("measure", c) for c, kind in kinds.items() if c not in used and re.match("(tiny|small|big)?int|float|double|decimal", kind)]
    out += [Offer("measure", roles.mark)] if roles.mark else []
    out += [Offer("share", c, str(v)) for c, several in (values or {}).items() for v in several]
    out += [Offer("quality", c) for c in kinds]
    out += [Offer("flow", roles.facility_place)] if roles.facility_place else []
    out += [Offer("interval", roles.reported)] if roles.reported else []
    out += [Offer("classifier", c) for c in classifiers] + [Offer("support", c) for c in places]
    out += [Offer("mention", c, name) for name, columns in (groups or {}).items() for c in columns]
    return out + [Offer("link", c) for c in links]


def band_edges(bands: list[str]) -> list[int]:
    """Lower edges of age bands such as "0-4", "5-9", "80+", which must follow one another without a gap."""
    edges, end = [], None
    for band in bands:
        m = re.fullmatch(r"(\d+)(?:-(\d+)|\+)", band)
        if not m or (end is not None and int(m[1]) != end + 1):
            raise ValueError(f"band {band!r} doesn't follow")
        edges.append(int(m[1]))
        end = int(m[2]) if m[2] else None
    if end is not None:
        raise ValueError("the last band must be open")
    return edges


def exposure_source(roles: Roles, years: tuple[int, int], offered: dict[str, tuple[int, int, bool]]) -> str:
    """Which exposure a count is read against: the first offered that covers the years and has ages if the records do.

    offered: name to first year, last year, whether by age.
    """
    for name, (first, last, aged) in offered.items():
        if first <= years[0] and years[1] <= last and (aged or not roles.age):
            return name
    raise ValueError(f"no exposure covers {years[0]} to {years[1]}")


def outcome(text: str) -> Column:
    """The predicate that "column=v1,v2" (one of the values) or "column~A1,B" (a packed code that begins so) declares."""
    m = re.fullmatch(r"(\w+)([=~])(.+)", text)
    if not m:
        raise ValueError(f"{text!r} is neither column=values nor column~prefixes")
    column, sign, values = m[1], m[2], m[3].split(",")
    if sign == "=":
        return F.col(column).isin(*values)
    codes = F.regexp_extract_all(F.col(column), F.lit(r"[A-Za-z][0-9]+"), F.lit(0))
    return F.exists(codes, lambda c: F.coalesce(*[F.when(c.startswith(v), F.lit(True)) for v in values], F.lit(False)))


def code_range(codes: DataFrame, low: str, high: str, *, column: str = "code") -> DataFrame:
    """Known codes between two, in lexical order, with all that begin with the last."""
    return codes.where((F.col(column) >= low) & ((F.col(column) <= high) | F.col(column).startswith(high)))


def interval_sign(records: DataFrame, first: str, second: str) -> int:
    """1 if the second date mostly follows the first, -1 if it mostly precedes it, from the median difference."""
    d = records.agg(F.median(F.datediff(second, first)).alias("d")).first().d
    return -1 if d is not None and d < 0 else 1
