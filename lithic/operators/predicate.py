"""Predicates that can exclude whole segments by their least and greatest values.

``column()`` is the filter itself, applied to every row that is read;
``possible(stats)`` says of a segment's statistics whether a row of it can
match.  What isn't known never excludes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    def __and__(self, other: "Predicate") -> "Predicate":
        return Both(self, other)

    def column(self) -> Column:
        raise NotImplementedError

    def possible(self, known: set[str]) -> Column:
        """A condition on the manifest's columns; ``known`` has the columns with statistics."""
        return F.lit(True)


def stat(column: str, kind: str) -> Column:
    return F.col(f"`{column}.{kind}`")


@dataclass
class Compare(Predicate):
    name: str
    op: str
    value: Any

    def column(self) -> Column:
        c, v = F.col(f"`{self.name}`"), F.lit(self.value)
        return {"<": c < v, "<=": c <= v, "=": c == v, ">=": c >= v, ">": c > v}[self.op]

    def possible(self, known: set[str]) -> Column:
        if self.name not in known:
            return F.lit(True)
        low, high, v = stat(self.name, "min"), stat(self.name, "max"), F.lit(self.value)
        fits = {"<": low < v, "<=": low <= v, "=": (low <= v) & (high >= v), ">=": high >= v, ">": high > v}[self.op]
        # No values at all: nothing compares.  No statistics: anything may.
        return F.when(stat(self.name, "values") == 0, F.lit(False)).otherwise(F.coalesce(fits, F.lit(True)))


@dataclass
class Prefix(Predicate):
    """LIKE 'p%'."""

    name: str
    prefix: str

    def column(self) -> Column:
        return F.col(f"`{self.name}`").startswith(self.prefix)

    def possible(self, known: set[str]) -> Column:
        if self.name not in known or not self.prefix:
            return F.lit(True)
        low, high = stat(self.name, "min"), stat(self.name, "max")
        n = len(self.prefix)
        fits = (F.substring(low, 1, n) <= self.prefix) & (high >= self.prefix)
        return F.when(stat(self.name, "values") == 0, F.lit(False)).otherwise(F.coalesce(fits, F.lit(True)))


@dataclass
class Both(Predicate):
    left: Predicate
    right: Predicate

    def column(self) -> Column:
        return self.left.column() & self.right.column()

    def possible(self, known: set[str]) -> Column:
        return self.left.possible(known) & self.right.possible(known)


@dataclass
class Other(Predicate):
    """Any other condition: filters, never excludes a segment."""

    condition: Column

    def column(self) -> Column:
        return self.condition


def between(name: str, low: Any, high: Any) -> Predicate:
    return Compare(name, ">=", low) & Compare(name, "<=", high)
