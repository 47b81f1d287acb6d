"""Registered queries: ingestion (hashing, de-duplication, ledger, feed state)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import ingest as G
from vigil.plans import oracle as O
from vigil.plans.registry import register, s_ts, ts
from vigil.plans.views import Chain, read_table

# documents as one feed (source "documents", no url): the hash then depends on the text only
DOC_FEED_SQL = """dh AS (
  SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) AS event_id, 'documents' AS source, '' AS source_url,
         sha256('documents' || '|' || '' || '|' || coalesce(text, '')) AS content_hash FROM documents),
dh_first AS (SELECT * FROM dh QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1),
ledger AS (SELECT DISTINCT content_hash FROM dh WHERE doc_id % 2 = 0)"""


def doc_feed(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id")
    ev = d.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event_id"),
                  F.lit("documents").alias("source"), F.lit("").alias("source_url"), F.col("text").alias("raw_text"))
    return G.with_hash(ev)


def ledger_of(feed):
    return feed.filter(F.col("doc_id") % 2 == 0).select("content_hash").distinct()


@register("ing_content_hash", O.chain("raw") + """
SELECT event_id, sha256(coalesce(source, '') || '|' || coalesce(source_url, '') || '|' || coalesce(raw_text, '')) AS content_hash FROM raw""")
def ing_content_hash(spark, sf):
    return G.with_hash(Chain.of(spark, sf).raw).select("event_id", "content_hash")


@register("ing_event_id", O.chain("raw") + """,
h AS (SELECT event_id, sha256(coalesce(source, '') || '|' || coalesce(source_url, '') || '|' || coalesce(raw_text, '')) AS c FROM raw)
SELECT event_id, substr(c, 1, 8) || '-' || substr(c, 9, 4) || '-' || substr(c, 13, 4) || '-' || substr(c, 17, 4) || '-'
       || substr(c, 21, 12) AS new_event_id FROM h""")
def ing_event_id(spark, sf):
    h = G.with_hash(Chain.of(spark, sf).raw)
    return h.select("event_id", G.event_id_from_hash(F.col("content_hash")).alias("new_event_id"))


@register("ing_dedup_in_run", "WITH " + DOC_FEED_SQL + "\nSELECT content_hash, event_id FROM dh_first")
def ing_dedup_in_run(spark, sf):
    return G.dedup_in_run(doc_feed(spark, sf), ["doc_id"]).select("content_hash", "event_id")


@register("ing_dedup_cross_run", "WITH " + DOC_FEED_SQL + """
SELECT event_id FROM dh_first WHERE content_hash NOT IN (SELECT content_hash FROM ledger)""")
def ing_dedup_cross_run(spark, sf):
    f = doc_feed(spark, sf)
    return G.drop_seen(G.dedup_in_run_grouped(f, ["doc_id"]), ledger_of(f)).select("event_id")


@register("ing_mark_hashes", "WITH " + DOC_FEED_SQL + """
SELECT content_hash, event_id, source, source_url, TIMESTAMP '2024-02-01 00:00:00' AS first_seen FROM dh_first
WHERE content_hash NOT IN (SELECT content_hash FROM ledger)""".replace(
    "TIMESTAMP '2024-02-01 00:00:00' AS first_seen", s_ts("TIMESTAMP '2024-02-01 00:00:00'") + " AS first_seen"))
def ing_mark_hashes(spark, sf):
    f = doc_feed(spark, sf)
    out = G.mark_hashes(ledger_of(f), G.dedup_in_run_grouped(f, ["doc_id"]),
                        F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.withColumn("first_seen", ts("first_seen"))


def fetch_log(spark, sf):
    """Conditional-fetch log derived from events: url per user bucket, headers sometimes absent."""
    e = read_table(spark, sf, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("feed://"), (F.col("user_id") % 20).cast("string")).alias("source_url"),
        F.when(F.col("event_type") == "click", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("W/"), F.col("event_type"), (F.col("event_id") % 3).cast("string"))).alias("etag"),
        F.when(F.col("event_type").isin("view", "click"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("lm"), F.floor("value").cast("long").cast("string"))).alias("last_modified"),
        F.col("ts").cast("timestamp").alias("fetched_at"))


FETCH_SQL = """fl AS (
  SELECT event_id, 'feed://' || CAST(user_id % 20 AS VARCHAR) AS source_url,
         CASE WHEN event_type = 'click' THEN NULL ELSE 'W/' || event_type || CAST(event_id % 3 AS VARCHAR) END AS etag,
         CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 'lm' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS last_modified,
         ts AS fetched_at FROM events),
st AS (
  SELECT source_url, arg_max(etag, fetched_at) FILTER (WHERE etag IS NOT NULL) AS etag,
         arg_max(last_modified, fetched_at) FILTER (WHERE last_modified IS NOT NULL) AS last_modified,
         max(fetched_at) AS fetched_at FROM fl WHERE fetched_at < TIMESTAMP '2024-01-15' GROUP BY source_url)"""


@register("ing_feed_state", "WITH " + FETCH_SQL + f""",
fin AS (
  SELECT source_url, arg_max(etag, fetched_at) FILTER (WHERE etag IS NOT NULL) AS etag,
         arg_max(last_modified, fetched_at) FILTER (WHERE last_modified IS NOT NULL) AS last_modified,
         max(fetched_at) AS fetched_at
  FROM (SELECT source_url, etag, last_modified, fetched_at FROM st
        UNION ALL SELECT source_url, etag, last_modified, fetched_at FROM fl WHERE fetched_at >= TIMESTAMP '2024-01-15')
  GROUP BY source_url)
SELECT source_url, etag, last_modified, {s_ts('fetched_at')} AS fetched_at FROM fin""")
def ing_feed_state(spark, sf):
    log = fetch_log(spark, sf).drop("event_id")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    empty = log.limit(0)
    state0 = G.feed_state_upsert(empty, log.filter(F.col("fetched_at") < cut))
    final = G.feed_state_upsert(state0, log.filter(F.col("fetched_at") >= cut))
    return final.withColumn("fetched_at", ts("fetched_at"))


@register("ing_skip_unchanged", "WITH " + FETCH_SQL + """
SELECT f.event_id FROM fl f WHERE f.fetched_at >= TIMESTAMP '2024-01-15' AND NOT EXISTS (
  SELECT 1 FROM st s WHERE s.source_url = f.source_url AND (
    (coalesce(s.etag, '') <> '' AND f.etag IS NOT DISTINCT FROM s.etag)
    OR (coalesce(s.last_modified, '') <> '' AND f.last_modified IS NOT DISTINCT FROM s.last_modified)))""")
def ing_skip_unchanged(spark, sf):
    log = fetch_log(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    state = G.feed_state_upsert(log.drop("event_id").limit(0), log.filter(F.col("fetched_at") < cut).drop("event_id"))
    return G.skip_unchanged(log.filter(F.col("fetched_at") >= cut), state).select("event_id")


RAW_LEDGER_SQL = """rh AS (
  SELECT event_id, source, CASE WHEN event_id LIKE 'd%' THEN 0 ELSE 1 END AS src_order,
         CAST(substr(event_id, 2) AS BIGINT) AS pos,
         sha256(coalesce(source, '') || '|' || coalesce(source_url, '') || '|' || coalesce(raw_text, '')) AS content_hash FROM raw),
rledger AS (SELECT DISTINCT content_hash FROM rh WHERE pos % 3 = 0),
rfirst AS (SELECT * FROM rh QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY src_order, pos) = 1)"""


def _raw_ordered(spark, sf):
    r = Chain.of(spark, sf).raw
    return r.withColumn("src_order", F.when(F.col("event_id").startswith("d"), 0).otherwise(1)) \
        .withColumn("pos", F.substring("event_id", 2, 64).cast("long"))


@register("ing_collect", O.chain("raw") + "," + RAW_LEDGER_SQL + """
SELECT event_id, content_hash FROM rfirst WHERE content_hash NOT IN (SELECT content_hash FROM rledger)""")
def ing_collect(spark, sf):
    r = _raw_ordered(spark, sf)
    ledger = G.with_hash(r).filter(F.col("pos") % 3 == 0).select("content_hash").distinct()
    return G.collect(r, ledger, ["src_order", "pos"]).select("event_id", "content_hash")


@register("src_fetch_counts", O.chain("raw") + "," + RAW_LEDGER_SQL + """
SELECT f.source, f.fetched, coalesce(k.kept, 0) AS kept
FROM (SELECT source, count(*) AS fetched FROM rh GROUP BY source) f
LEFT JOIN (SELECT source, count(*) AS kept FROM rfirst GROUP BY source) k USING (source)""")
def src_fetch_counts(spark, sf):
    r = _raw_ordered(spark, sf)
    kept = G.dedup_in_run_grouped(G.with_hash(r), ["src_order", "pos"])
    return G.fetch_counts(r, kept)
