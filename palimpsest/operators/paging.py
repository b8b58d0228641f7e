"""Ordered listings by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order keys of the listings; the last key is unique, so that pages don't overlap.
ORDERS = {"created": ("created_at", "id"), "seq": ("seq",), "times_derived": ("times_derived", "created_at", "id")}
DEFAULT_SIZE, MOST_SIZE = 50, 100


def _order(keys: tuple[str, ...], reverse: bool) -> list[Column]:
    return [F.desc_nulls_last(k) if reverse else F.asc_nulls_first(k) for k in keys]


def page(frame: DataFrame, keys: tuple[str, ...], number: int = 1, size: int = DEFAULT_SIZE, reverse: bool = False) -> DataFrame:
    """One page, in order; a page past the end is empty. reverse turns every key."""
    if number < 1 or not 1 <= size <= MOST_SIZE:
        raise ValueError(f"page {number} of size {size}")
    return frame.orderBy(*_order(keys, reverse)).offset((number - 1) * size).limit(size)


def totals(frame: DataFrame, size: int = DEFAULT_SIZE) -> DataFrame:
    """total and pages of a listing: one row."""
    return frame.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(size).alias("size"), F.ceil(F.col("total") / size).alias("pages"))


def envelope(frame: DataFrame, keys: tuple[str, ...], number: int = 1, size: int = DEFAULT_SIZE, reverse: bool = False) -> DataFrame:
    """One row with a page and what it is a page of: items (an array of rows, in order), page,
    total, size and pages."""
    rows = page(frame, keys, number, size, reverse)
    place = F.row_number().over(Window.orderBy(*_order(keys, reverse)))  # of at most MOST_SIZE rows
    items = rows.withColumn("_place", place).agg(F.array_sort(F.collect_list(F.struct("_place", F.struct(*frame.columns).alias("item")))).alias("x"))
    return totals(frame, size).crossJoin(items).select(F.transform("x", lambda x: x["item"]).alias("items"), F.lit(number).alias("page"), "total", "size", "pages")


def each_page(frame: DataFrame, keys: tuple[str, ...]):
    """All rows in order, a partition at a time."""
    yield from frame.orderBy(*keys).toLocalIterator()


def seq_range(frame: DataFrame, first: int, last: int) -> DataFrame:
    """Messages with first <= seq <= last, ascending."""
    return frame.where(F.col("seq").between(first, last)).orderBy("seq")


def with_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Joins names to a page's rows only: call it after page()."""
    return rows.join(names, key, "left")
