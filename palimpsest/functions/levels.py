"""Levels of conclusions: numbers in the tables, names on the wire."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names of conclusion levels, by number.
LEVELS = ("explicit", "deductive", "inductive", "contradiction")


def level_name(level: Column) -> Column:
    """The wire name of a level number."""
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def level_number(name: Column) -> Column:
    """The number of a level's name; -1 for other names."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), name) - 1
