"""A small formula language: ``y ~ a + b + a:b + C(kind)`` becomes numeric columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Design:
    """The response, the design columns, and the columns of each term; ``levels`` hold factors' levels for new data."""

    y: str
    columns: list[str]
    terms: dict[str, list[str]]
    levels: dict[str, list[str]]


def parse(text: str) -> tuple[str, list[str]]:
    """Response and terms; ``a*b`` means both and their interaction, the intercept always stays."""
    left, mark, right = text.partition("~")
    if not mark or not left.strip():
        raise ValueError("a formula needs a response and ~")
    terms: list[str] = []
    for part in re.split(r"\+", right):
        part = part.strip()
        if part in ("1", ""):
            continue
        if part in ("0", "-1") or part.startswith("offset("):
            raise ValueError("the intercept can't be dropped and offsets aren't supported")
        names = [p.strip() for p in part.split("*")]
        new = [*names, ":".join(names)] if len(names) > 1 else [":".join(p.strip() for p in part.split(":"))]
        terms += [t for t in new if t not in terms]
    return left.strip(), terms


def _factor(df: DataFrame, name: str) -> str | None:
    if m := re.fullmatch(r"C\((.+)\)", name):
        return m[1].strip()
    return name if isinstance(df.schema[name].dataType, (T.StringType, T.BooleanType)) else None


def build(df: DataFrame, text: str, levels: dict[str, list[str]] | None = None) -> tuple[DataFrame, Design]:
    """``df`` with the formula's design columns, and what they are.

    A factor gives one column for each level but the first (in order of
    strings); with ``levels`` of an earlier design, new data get the same columns,
    and a level it didn't have is an error.  Nulls are an error.
    """
    y, terms = parse(text)
    found: dict[str, list[str]] = dict(levels or {})
    cols: dict[str, list[str]] = {}

    def main(name: str) -> list[str]:
        nonlocal df
        if name in cols:
            return cols[name]
        own = _factor(df, name)
        if own is None:
            cols[name] = [name]
            return cols[name]
        seen = sorted(str(r[0]) for r in df.select(F.col(own).cast("string")).distinct().limit(1001).collect())
        if len(seen) > 1000:
            raise ValueError(f"{own} has more than 1000 levels")
        if "None" in seen and df.filter(F.col(own).isNull()).limit(1).count():
            raise ValueError(f"{own} holds nulls")
        known = found.setdefault(own, seen)
        if set(seen) - set(known):
            raise ValueError(f"{own} has new levels {sorted(set(seen) - set(known))}")
        cols[name] = [f"{own}{v}" for v in known[1:]]
        df = df.withColumns({f"{own}{v}": (F.col(own).cast("string") == v).cast("double") for v in known[1:]})
        return cols[name]

    by_term: dict[str, list[str]] = {}
    for t in terms:
        parts = t.split(":")
        own = main(parts[0])
        for p in parts[1:]:
            own = [f"{a}:{b}" for a in own for b in main(p)]
            df = df.withColumns({c: F.col(f"`{c.rpartition(':')[0]}`") * F.col(f"`{c.rpartition(':')[2]}`") for c in own})
        by_term[t] = own
    flat = [c for own in by_term.values() for c in own]
    nulls = df.select(*[F.count_if(F.col(f"`{c}`").isNull()).alias(str(i)) for i, c in enumerate([y, *flat])]).first()
    if any(nulls):
        raise ValueError("the model's columns hold nulls")
    return df, Design(y, flat, by_term, found)
