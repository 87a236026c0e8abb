"""Rule lists compiled to one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v)).getItem(0)


def first_match(rules: list[tuple[object, Column]], default: object | None = None) -> Column:
    """Value of the first rule whose predicate holds."""
    out = None
    for value, predicate in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(predicate, v) if out is None else out.when(predicate, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(d)


def lookup(c: Column, table: dict[str, object], default: object | None = None) -> Column:
    """Exact value map."""
    return first_match([(v, c == k) for k, v in table.items()], default)


def search(c: Column, pattern: str) -> Column:
    """Case-insensitive regular expression search; null text never matches."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """One rule of a rule set: when ``predicate`` holds the item gets a finding."""

    id: str
    predicate: Column
    severity: str
    message: str


def all_matches(rules: list[Rule]) -> Column:
    """Array of the rules that fire."""
    fired = [
        F.when(r.predicate, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"),
                                     F.lit(r.message).alias("message")))
        for r in rules
    ]
    return F.array_compact(F.array(*fired))


def flags(named: dict[str, Column]) -> Column:
    """Array of the names whose predicate holds."""
    return F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in named.items()]))


def score(parts: list[tuple[int, Column]]) -> Column:
    """Sum of the points whose predicate holds."""
    out = F.lit(0)
    for points, p in parts:
        out = out + F.when(p, points).otherwise(0)
    return out
