"""Naming the value of an expression within another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it. Filters don't
    share common parts of an expression, so a parsed value would be parsed again at each use."""
    return F.transform(F.array(value), body)[0]
