"""Joins whose key may be held by a large part of all rows, or be null in all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000  # rows of the broadcast at most
HOT_ROWS = 100_000  # rows of a key from which it may be one of them


def join_per_key(df: DataFrame, per_key: DataFrame, key: str, salt_on: str, how: str = "left", rows: str = "n_events", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``df`` with a table of one row per key, of which column ``rows`` tells how many rows of ``df`` hold the key.

    The keys with most rows (at most ``HOT_KEYS``) are found by a broadcast of their rows. All others meet in a plain join, where no key
    has more rows than the last of those; rows whose key was found or is null are dealt out there by a hash of ``salt_on`` and match
    nothing. No row is repeated on either side.
    """
    extra = [c for c in per_key.columns if c != key]
    hot = per_key.filter(F.col(rows) >= hot_rows).orderBy(F.desc(rows), key).limit(HOT_KEYS)
    hot = hot.select(key, F.struct(*extra).alias("_hot"))
    marked = df.join(F.broadcast(hot), key, "left")
    dealt: Column = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_salt", F.when(dealt, F.xxhash64(salt_on)).otherwise(F.lit(0).cast("long"))) \
        .withColumn("_key", F.when(~dealt, F.col(key)))
    plain = per_key.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_salt"), F.struct(*extra).alias("_plain"))
    out = marked.join(plain, ["_key", "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_plain"))
    out = out if how == "left" else out.filter(F.col("_found").isNotNull())
    return out.select(key, *[c for c in df.columns if c != key], *[F.col(f"_found.{c}").alias(c) for c in extra])
