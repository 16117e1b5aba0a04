"""Interval relations between windows, as index ranges and as column predicates."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Relation(str, Enum):
    EQUAL = "equal"
    MEETS = "meets"
    BEFORE = "before"
    OVERLAPS = "overlaps"
    NONE = "none"

    @classmethod
    def of(cls, name: str | None) -> Relation:
        """By name in any case; None is unrestricted."""
        if name is None:
            return cls.NONE
        try:
            return cls(name.lower())
        except ValueError:
            raise ValueError(f"{name!r} is no relation; one of {', '.join(r.value for r in cls)}") from None


def target_range(relation: Relation, i: int, offset: int, m: int, n_target: int) -> tuple[int, int] | None:
    """First and last target window for source window i on a shared grid; offset: grid steps from target's to source's start.

    equal: same place; meets: starts one step after the source ends; before: that or later; overlaps: starts within the
    source, with two steps in common at least. None if there is no such window.
    """
    at = i + offset
    lo, hi = {
        Relation.EQUAL: (at, at),
        Relation.MEETS: (at + m, at + m),
        Relation.BEFORE: (max(at + m, 0), n_target - 1),
        Relation.OVERLAPS: (max(at + 1, 0), min(at + m - 2, n_target - 1)),
        Relation.NONE: (0, n_target - 1),
    }[relation]
    return (lo, hi) if 0 <= lo <= hi < n_target else None


def predicate(relation: Relation, i: Column, offset: Column, m: int, j: Column) -> Column:
    """The same as a join condition on existing windows i and j; equal and meets are equi-conditions on j."""
    at = i + offset
    return {
        Relation.EQUAL: j == at,
        Relation.MEETS: j == at + m,
        Relation.BEFORE: j >= at + m,
        Relation.OVERLAPS: (j >= at + 1) & (j <= at + m - 2),
        Relation.NONE: F.lit(True),
    }[relation]
