"""Registry of query keys -> (Spark builder, DuckDB oracle SQL or None).

Registered outputs are flattened for engine-neutral comparison: arrays are
``|``-joined (sorted where the order is not part of the result), maps become
columns, timestamps become ``yyyy-MM-dd HH:mm:ss`` strings and doubles are
rounded to 6 decimals, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql)
        return fn
    return deco


# Spark-side canonical forms -------------------------------------------------

def arr(c: Column | str, ordered: bool = False) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(col if ordered else F.sort_array(col), "|")


def ts(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def dbl(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


# SQL-side canonical forms ---------------------------------------------------

def s_arr(x: str, ordered: bool = False) -> str:
    return f"array_to_string({x if ordered else f'list_sort({x})'}, '|')"


def s_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def s_dbl(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
