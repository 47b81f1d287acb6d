"""Ingestion: content hashes, deterministic ids, in-run and cross-run de-duplication,
the seen-hash ledger and per-feed conditional-fetch state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(source: Column, source_url: Column, raw_text: Column, existing: Column | None = None) -> Column:
    """SHA-256 hex of ``source|source_url|raw_text`` (nulls as ""), an existing hash kept."""
    h = F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("|"), F.coalesce(source_url, F.lit("")), F.lit("|"),
                        F.coalesce(raw_text, F.lit(""))), 256)
    if existing is None:
        return h
    return F.coalesce(F.when(existing != "", existing), h)


def event_id_from_hash(h: Column) -> Column:
    """UUID-shaped id cut from the content hash, so a retried run gets the same ids."""
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def with_hash(raw: DataFrame) -> DataFrame:
    existing = F.col("content_hash") if "content_hash" in raw.columns else None
    return raw.withColumn("content_hash", content_hash(F.col("source"), F.col("source_url"), F.col("raw_text"), existing))


def dedup_in_run(events: DataFrame, order_cols: list[str]) -> DataFrame:
    """First event per content hash in source order (``order_cols`` define that order).

    An aggregate, not a window: copies of one text may be a third of all rows.
    """
    return dedup_in_run_grouped(events, order_cols)


def dedup_in_run_grouped(events: DataFrame, order_cols: list[str]) -> DataFrame:
    """Same as ``dedup_in_run`` but as an aggregate (``min_by``), which combines map-side,
    so a hash repeated across a third of all rows is never sorted in one task."""
    cols = [c for c in events.columns if c != "content_hash"]
    key = F.struct(*[F.col(c) for c in order_cols])
    first = events.groupBy("content_hash").agg(F.min_by(F.struct(*cols), key).alias("_r"))
    return first.select("content_hash", *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*events.columns)


def drop_seen(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose hash is not in the ledger (anti-join; the ledger side is key-only)."""
    return events.join(ledger.select("content_hash").distinct(), "content_hash", "left_anti")


def mark_hashes(ledger: DataFrame, new_events: DataFrame, first_seen: Column | None = None) -> DataFrame:
    """Ledger rows to append: unseen hashes with event id, source, url, first_seen."""
    fresh = drop_seen(new_events, ledger)
    return fresh.select("content_hash", "event_id", "source", "source_url",
                        (first_seen if first_seen is not None else F.current_timestamp()).alias("first_seen"))


def collect(raw: DataFrame, ledger: DataFrame, order_cols: list[str]) -> DataFrame:
    """Union of sources -> hash -> first per hash in the run -> drop hashes already in the ledger."""
    return drop_seen(dedup_in_run_grouped(with_hash(raw), order_cols), ledger)


def feed_state_upsert(state: DataFrame, fetches: DataFrame) -> DataFrame:
    """New feed state per url: latest non-null etag / last_modified, latest fetch time.

    ``state`` and ``fetches`` are (source_url, etag, last_modified, fetched_at);
    a null header in a later fetch keeps the earlier value.
    """
    u = state.unionByName(fetches)
    return u.groupBy("source_url").agg(
        F.max_by(F.col("etag"), F.when(F.col("etag").isNotNull(), F.col("fetched_at"))).alias("etag"),
        F.max_by(F.col("last_modified"), F.when(F.col("last_modified").isNotNull(), F.col("fetched_at"))).alias("last_modified"),
        F.max("fetched_at").alias("fetched_at"))


def skip_unchanged(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """Landed snapshots that are not 304s: a snapshot is unchanged when it carries the
    stored validator (non-empty etag or last_modified) for its url."""
    s = state.select(F.col("source_url").alias("_u"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    cond = (F.col("source_url") == F.col("_u")) & (
        (F.coalesce(F.col("_e"), F.lit("")) != "") & F.col("etag").eqNullSafe(F.col("_e"))
        | (F.coalesce(F.col("_m"), F.lit("")) != "") & F.col("last_modified").eqNullSafe(F.col("_m")))
    return snapshots.join(s, cond, "left_anti")


def fetch_counts(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows fetched per source (before de-duplication) and rows kept."""
    k = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    f = raw.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"))
    return f.join(k, "source", "left").select("source", "fetched", F.coalesce("kept", F.lit(0)).alias("kept"))
