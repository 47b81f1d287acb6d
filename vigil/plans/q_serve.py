"""Registered queries: reporting, serving (API) and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import params as P
from vigil.operators import correlate as C
from vigil.operators import dash as D
from vigil.operators import iocs as IO
from vigil.operators import report as R
from vigil.operators import serve as Q
from vigil.plans import oracle as O
from vigil.plans.registry import arr, dbl, register, s_arr, s_dbl, s_ts, ts
from vigil.plans.views import Chain
from vigil.session import scratch

ITEMS_CTE = """ioc_lists AS (
  SELECT source_event_id AS event_id, list_sort(list(normalized_value)) AS _all FROM ioc
  WHERE source_event_id IS NOT NULL GROUP BY source_event_id),
items0 AS (
  SELECT a.event_id, a.incident_type, a.sector, s.severity_label, s.severity, s.confidence,
         coalesce(c.mitre_tactics, CAST([] AS VARCHAR[])) AS mitre_tactics,
         coalesce(l._all[1:10], CAST([] AS VARCHAR[])) AS iocs, CAST(coalesce(len(l._all), 0) AS BIGINT) AS n_iocs
  FROM ana a JOIN sco s USING (event_id) LEFT JOIN cor c USING (event_id) LEFT JOIN ioc_lists l USING (event_id)),
items AS (
  SELECT *, concat_ws('; ',
    CASE WHEN incident_type IS NOT NULL AND incident_type <> '' AND incident_type <> 'unknown'
         THEN 'Likely ' || incident_type || ' activity' ELSE 'Unclassified activity' END,
    CASE WHEN sector IS NOT NULL AND sector <> '' AND sector <> 'unknown' THEN 'targeting ' || sector || ' sector' END,
    CASE WHEN severity_label IS NOT NULL AND severity_label <> '' THEN 'severity assessed as ' || severity_label END,
    CASE WHEN n_iocs > 0 THEN CAST(n_iocs AS VARCHAR) || ' IOCs observed' END,
    CASE WHEN len(mitre_tactics) > 0 THEN 'MITRE tactics: ' || array_to_string(mitre_tactics[1:4], ', ') END) AS summary
  FROM items0)"""
ITEMS = O.chain("sco") + "," + ITEMS_CTE + "\n"


def items(spark, sf):
    c = Chain.of(spark, sf)
    return R.items(c.ana, c.sco, c.cor, c.ioc)


def _item_cols(df):
    return df.select("event_id", "incident_type", "sector", "severity_label", dbl("severity").alias("severity"),
                     dbl("confidence").alias("confidence"), arr("mitre_tactics", True).alias("mitre_tactics"),
                     arr("iocs", True).alias("iocs"), "n_iocs", "summary")


_ITEM_SQL = (f"SELECT event_id, incident_type, sector, severity_label, {s_dbl('severity')} AS severity, "
             f"{s_dbl('confidence')} AS confidence, {s_arr('mitre_tactics', True)} AS mitre_tactics, "
             f"{s_arr('iocs', True)} AS iocs, n_iocs, summary FROM items")


@register("rep_items", ITEMS + _ITEM_SQL)
def rep_items(spark, sf):
    return _item_cols(items(spark, sf))


@register("rep_ioc_list", O.chain("ioc") + f""",
l AS (SELECT source_event_id AS event_id, list_sort(list(normalized_value)) AS a FROM ioc
      WHERE source_event_id IS NOT NULL GROUP BY source_event_id)
SELECT event_id, {s_arr('a[1:10]', True)} AS iocs, CAST(len(a) AS BIGINT) AS n_iocs FROM l""")
def rep_ioc_list(spark, sf):
    return R.ioc_lists(Chain.of(spark, sf).ioc).select("event_id", arr("iocs", True).alias("iocs"), "n_iocs")


@register("rep_summary_text", ITEMS + "SELECT event_id, summary FROM items")
def rep_summary_text(spark, sf):
    return items(spark, sf).select("event_id", "summary")


@register("rep_sort", ITEMS + "SELECT event_id, row_number() OVER (ORDER BY severity DESC, event_id) AS rank FROM items")
def rep_sort(spark, sf):
    return R.ranked(items(spark, sf)).select("event_id", "rank")


@register("rep_bundle", O.chain("camp") + "," + O.cte_sco() + f""",
b AS (SELECT 'item' AS kind, a.event_id AS key, a.incident_type AS name, s.severity_label AS label, s.severity AS value FROM ana a JOIN sco s USING (event_id)
      UNION ALL SELECT 'campaign', campaign_id, name, NULL, confidence FROM camp)
SELECT kind, key, name, label, {s_dbl('value')} AS value, '2024-02-01 00:00:00' AS generated_at FROM b""")
def rep_bundle(spark, sf):
    """The JSON report, read back field by field."""
    c = Chain.of(spark, sf)
    bundle = R.bundle_json(R.items(c.ana, c.sco, c.cor, c.ioc), c.camp, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    field = lambda *names: F.coalesce(*[F.get_json_object("json", f"$.{n}") for n in names])
    return bundle.select("kind", "key", field("incident_type", "name").alias("name"), field("severity_label").alias("label"),
                         dbl(F.when(F.col("kind") == "item", field("severity")).otherwise(field("confidence"))).alias("value"),
                         ts("generated_at").alias("generated_at"))


@register("rep_text_lines", ITEMS + """,
top AS (SELECT *, row_number() OVER (ORDER BY severity DESC, event_id) AS rank FROM items ORDER BY severity DESC, event_id LIMIT 50),
lines AS (
  SELECT rank, 1 AS line_no, 'event' AS kind, 'Event: ' || event_id AS text, CAST(NULL AS BIGINT) AS cents FROM top
  UNION ALL SELECT rank, 2, 'summary', 'Summary: ' || summary, NULL FROM top
  UNION ALL SELECT rank, 3, 'severity', NULL, CAST(round(severity * 100) AS BIGINT) FROM top
  UNION ALL SELECT rank, 4, 'confidence', NULL, CAST(round(confidence * 100) AS BIGINT) FROM top
  UNION ALL SELECT rank, 5, 'mitre', 'MITRE: ' || array_to_string(mitre_tactics, ', '), NULL FROM top WHERE len(mitre_tactics) > 0
  UNION ALL SELECT rank, 6, 'iocs', 'IOCs: ' || array_to_string(iocs, ', '), NULL FROM top WHERE len(iocs) > 0
  UNION ALL SELECT rank, 7, 'separator', '-', NULL FROM top)
SELECT rank, line_no, kind, coalesce(text, 'cents:' || CAST(cents AS VARCHAR)) AS text FROM lines""")
def rep_text_lines(spark, sf):
    t = R.text_lines(items(spark, sf))
    # the 2-decimal rendering is engine-specific at .5 borders; compare its integer cents
    return t.select(F.col("rank").cast("long").alias("rank"), "line_no", "kind",
                    F.when(F.col("cents").isNull(), F.col("text"))
                    .otherwise(F.concat(F.lit("cents:"), F.col("cents").cast("string"))).alias("text"))


# --- serving -----------------------------------------------------------------

STORED_IOCS = """stored_iocs AS (
  SELECT source_event_id, ioc_type, normalized_value, min(value) AS value FROM ioc
  GROUP BY source_event_id, ioc_type, normalized_value)"""


@register("qry_summary", O.chain("camp") + ",\n" + O.cte_sco() + ",\n" + STORED_IOCS + """,
sevl AS (SELECT * FROM (VALUES ('high'), ('medium'), ('low'), ('informational')) t(severity_label)),
sevc AS (SELECT severity_label, count(*) AS n FROM sco GROUP BY severity_label)
SELECT 'total_events' AS metric, '' AS key, CAST(count(*) AS BIGINT) AS n FROM sco
UNION ALL SELECT 'campaign_count', '', count(*) FROM camp
UNION ALL SELECT 'ioc_count', '', count(*) FROM stored_iocs
UNION ALL SELECT 'severity', l.severity_label, coalesce(c.n, 0) FROM sevl l LEFT JOIN sevc c USING (severity_label)
UNION ALL SELECT 'severity', severity_label, n FROM sevc WHERE severity_label NOT IN (SELECT severity_label FROM sevl)
UNION ALL SELECT 'incident', incident_type, count(*) FROM ana GROUP BY incident_type
UNION ALL SELECT 'sector', sector, count(*) FROM ana GROUP BY sector""")
def qry_summary(spark, sf):
    c = Chain.of(spark, sf)
    return Q.summary(c.sco, c.ana, c.camp, IO.dedup(c.ioc))


@register("qry_severity_counts", O.chain("sco") + """,
sevl AS (SELECT * FROM (VALUES ('high'), ('medium'), ('low'), ('informational')) t(severity_label)),
sevc AS (SELECT severity_label, count(*) AS n FROM sco GROUP BY severity_label)
SELECT l.severity_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM sevl l LEFT JOIN sevc c USING (severity_label)
UNION ALL SELECT severity_label, n FROM sevc WHERE severity_label NOT IN (SELECT severity_label FROM sevl)""")
def qry_severity_counts(spark, sf):
    return Q.severity_counts(Chain.of(spark, sf).sco)


@register("qry_incident_counts", O.chain("ana") + "SELECT incident_type, count(*) AS n FROM ana GROUP BY incident_type")
def qry_incident_counts(spark, sf):
    return Q.incident_counts(Chain.of(spark, sf).ana)


@register("qry_sector_counts", O.chain("ana") + "SELECT sector, count(*) AS n FROM ana GROUP BY sector")
def qry_sector_counts(spark, sf):
    return Q.sector_counts(Chain.of(spark, sf).ana)


@register("qry_events", O.chain("sco") + f"""
SELECT s.event_id, a.incident_type, a.sector, {s_dbl('s.severity')} AS severity, s.severity_label,
       {s_dbl('s.confidence')} AS confidence, {s_ts('n.fetched_at')} AS fetched_at, n.source, n.source_url,
       {s_arr('coalesce(c.mitre_tactics, CAST([] AS VARCHAR[]))', True)} AS mitre_tactics, c.campaign_id
FROM sco s JOIN ana a USING (event_id) JOIN norm n USING (event_id) LEFT JOIN cor c USING (event_id)
ORDER BY s.severity DESC, s.event_id LIMIT 50 OFFSET 10""")
def qry_events(spark, sf):
    c = Chain.of(spark, sf)
    e = Q.events(spark, c.event_pages, limit=50, offset=10)
    return e.select("event_id", "incident_type", "sector", dbl("severity").alias("severity"), "severity_label",
                    dbl("confidence").alias("confidence"), ts("fetched_at").alias("fetched_at"), "source", "source_url",
                    arr("mitre_tactics", True).alias("mitre_tactics"), "campaign_id")


@register("qry_events_filtered", O.chain("sco") + f"""
SELECT s.event_id, {s_dbl('s.severity')} AS severity
FROM sco s JOIN ana a USING (event_id) JOIN norm n USING (event_id) LEFT JOIN cor c USING (event_id)
WHERE s.severity_label = 'low' AND a.incident_type = 'chatter'
ORDER BY s.severity DESC, s.event_id LIMIT 25""")
def qry_events_filtered(spark, sf):
    c = Chain.of(spark, sf)
    e = Q.events(spark, c.event_pages, severity="low", incident="chatter", limit=25)
    return e.select("event_id", dbl("severity").alias("severity"))


DETAIL_ID = "p1"


@register("qry_event_detail", O.chain("sco") + f"""
SELECT a.event_id, a.incident_type, {s_dbl('a.incident_confidence')} AS incident_confidence, a.sector,
       {s_dbl('a.sector_confidence')} AS sector_confidence, {s_dbl('s.severity')} AS severity, s.severity_label,
       {s_dbl('s.confidence')} AS confidence, {s_ts('n.fetched_at')} AS fetched_at, n.source, n.source_url, n.clean_text,
       {s_arr('coalesce(c.mitre_tactics, CAST([] AS VARCHAR[]))', True)} AS mitre_tactics, c.campaign_id,
       {s_arr('coalesce(c.shared_iocs, CAST([] AS VARCHAR[]))', True)} AS shared_iocs,
       coalesce((SELECT {s_arr('list(normalized_value)')} FROM ioc WHERE source_event_id = '{DETAIL_ID}'), '') AS iocs
FROM ana a JOIN sco s USING (event_id) JOIN norm n USING (event_id) LEFT JOIN cor c USING (event_id)
WHERE a.event_id = '{DETAIL_ID}'""")
def qry_event_detail(spark, sf):
    c = Chain.of(spark, sf)
    d = Q.event_detail(DETAIL_ID, c.sco, c.ana, c.norm, c.cor, c.ioc)
    return d.select("event_id", "incident_type", dbl("incident_confidence").alias("incident_confidence"), "sector",
                    dbl("sector_confidence").alias("sector_confidence"), dbl("severity").alias("severity"),
                    "severity_label", dbl("confidence").alias("confidence"), ts("fetched_at").alias("fetched_at"),
                    "source", "source_url", "clean_text", arr("mitre_tactics", True).alias("mitre_tactics"),
                    "campaign_id", arr("shared_iocs", True).alias("shared_iocs"), arr("iocs").alias("iocs"))


@register("qry_campaigns", O.chain("camp") + f"""
SELECT campaign_id, name, {s_ts('start_time')} AS start_time, {s_ts('end_time')} AS end_time, n_events, n_iocs,
       {s_arr('mitre_tactics')} AS mitre_tactics, {s_dbl('confidence')} AS confidence FROM camp""")
def qry_campaigns(spark, sf):
    c = Q.campaign_list(Chain.of(spark, sf).camp)
    return c.select("campaign_id", "name", ts("start_time").alias("start_time"), ts("end_time").alias("end_time"),
                    "n_events", F.col("n_iocs").cast("long").alias("n_iocs"), arr("mitre_tactics").alias("mitre_tactics"),
                    dbl("confidence").alias("confidence"))


@register("qry_campaign_events", O.chain("camp") + """
SELECT campaign_id, event_id FROM membership WHERE campaign_id IS NOT NULL""")
def qry_campaign_events(spark, sf):
    return Q.campaign_members(Chain.of(spark, sf).membership)


@register("qry_campaign_iocs", O.chain("camp") + "SELECT campaign_id, ioc FROM camp_iocs")
def qry_campaign_iocs(spark, sf):
    c = Chain.of(spark, sf)
    return C.campaign_iocs(c.cor, c.membership)


@register("qry_campaign_page", O.chain("camp") + """
SELECT campaign_id, event_id FROM membership WHERE campaign_id = (SELECT min(campaign_id) FROM camp) ORDER BY event_id LIMIT 50""")
def qry_campaign_page(spark, sf):
    """The first page of one campaign's members."""
    c = Chain.of(spark, sf)
    first = c.camp.agg(F.min("campaign_id")).first()[0]
    return Q.campaign_members(c.membership, first, limit=50)


@register("qry_iocs", O.chain("ioc") + "," + STORED_IOCS + """,
ided AS (SELECT *, source_event_id || '|' || ioc_type || '|' || normalized_value AS id FROM stored_iocs)
SELECT id, ioc_type, value, normalized_value, source_event_id FROM ided ORDER BY id DESC LIMIT 100""")
def qry_iocs(spark, sf):
    s = IO.dedup(Chain.of(spark, sf).ioc)
    s = s.withColumn("id", F.concat_ws("|", "source_event_id", "ioc_type", "normalized_value"))
    path = scratch(spark, "ioc_pages")
    Q.write_ioc_pages(path, s)
    return Q.ioc_page(spark, path, limit=100).select("id", "ioc_type", "value", "normalized_value", "source_event_id")


# --- dashboard -----------------------------------------------------------------

@register("dsh_count_by", ITEMS + """
SELECT 'incident' AS dimension, coalesce(nullif(incident_type, ''), 'unknown') AS key, count(*) AS n FROM items GROUP BY 2
UNION ALL SELECT 'sector', coalesce(nullif(sector, ''), 'unknown'), count(*) FROM items GROUP BY 2
UNION ALL SELECT 'severity', coalesce(nullif(severity_label, ''), 'informational'), count(*) FROM items GROUP BY 2""")
def dsh_count_by(spark, sf):
    return D.count_by(items(spark, sf))


_TOP_SQL = """,
cnt AS (
  SELECT 'incident' AS dimension, coalesce(nullif(incident_type, ''), 'unknown') AS key, count(*) AS n FROM items GROUP BY 2
  UNION ALL SELECT 'sector', coalesce(nullif(sector, ''), 'unknown'), count(*) FROM items GROUP BY 2
  UNION ALL SELECT 'tactic', coalesce(nullif(t, ''), 'unknown'), count(*) FROM (SELECT unnest(mitre_tactics) AS t FROM items) GROUP BY 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS rank FROM cnt),
top AS (SELECT * FROM rk WHERE rank <= CASE WHEN dimension = 'tactic' THEN 3 ELSE 2 END)
"""


@register("dsh_top_keys", ITEMS + _TOP_SQL + "SELECT dimension, key, n, rank FROM top")
def dsh_top_keys(spark, sf):
    return D.top_keys(items(spark, sf)).select("dimension", "key", "n", F.col("rank").cast("long").alias("rank"))


@register("dsh_tactic_counts", ITEMS + """
SELECT coalesce(nullif(t, ''), 'unknown') AS key, count(*) AS n FROM (SELECT unnest(mitre_tactics) AS t FROM items) GROUP BY 1""")
def dsh_tactic_counts(spark, sf):
    return D.tactic_counts(items(spark, sf))


@register("dsh_distinct_iocs", ITEMS + """
SELECT count(DISTINCT i) AS n_distinct, count(*) AS n_total,
       CASE WHEN count(DISTINCT i) > 0 THEN count(DISTINCT i) ELSE count(*) END AS indicator_count
FROM (SELECT ioc.normalized_value AS i FROM ioc JOIN items ON items.event_id = ioc.source_event_id)""")
def dsh_distinct_iocs(spark, sf):
    return D.distinct_iocs(items(spark, sf), Chain.of(spark, sf).ioc)


@register("dsh_severity_distribution", ITEMS + """
SELECT CAST(sum(CASE WHEN severity_label = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high,
       CAST(sum(CASE WHEN severity_label = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS medium,
       CAST(sum(CASE WHEN severity_label = 'low' THEN 1 ELSE 0 END) AS BIGINT) AS low,
       CAST(sum(CASE WHEN coalesce(nullif(severity_label, ''), 'informational') = 'informational' THEN 1 ELSE 0 END) AS BIGINT) AS informational,
       CAST(count(*) AS BIGINT) AS n_items, (SELECT CAST(count(*) AS BIGINT) FROM camp) AS n_campaigns FROM items""")
def dsh_severity_distribution(spark, sf):
    c = Chain.of(spark, sf)
    return D.severity_distribution(R.items(c.ana, c.sco, c.cor, c.ioc), c.camp)


def _brief_sql() -> str:
    q = O.q

    def listed(w: tuple, col: str) -> str:
        return f"{q(w[1])} || CASE WHEN len({col}) > 0 THEN array_to_string({col}, ', ') ELSE {q(w[2])} END || '.'"

    rows = [
        (P.BRIEF_SCOPE, f"{q(P.BRIEF_SCOPE[1])} || CASE WHEN n_items > 0 THEN CAST(n_items AS VARCHAR) ELSE {q(P.BRIEF_SCOPE[2])} END || {q(P.BRIEF_SCOPE[3])}"),
        (P.BRIEF_INCIDENTS, listed(P.BRIEF_INCIDENTS, "inc")),
        (P.BRIEF_SECTORS, listed(P.BRIEF_SECTORS, "sec")),
        (P.BRIEF_SIGNAL, q(P.BRIEF_SIGNAL[1])),
        (P.BRIEF_SEVERITY, f"printf({q(P.BRIEF_SEVERITY[1])}, high, medium, low, informational)"),
        (P.BRIEF_INDICATORS, f"CASE WHEN ind > 0 THEN printf({q(P.BRIEF_INDICATORS[1])}, ind) ELSE {q(P.BRIEF_INDICATORS[2])} END"),
        (P.BRIEF_CAMPAIGNS, f"CASE WHEN n_camp > 0 THEN printf({q(P.BRIEF_CAMPAIGNS[1])}, n_camp, CASE WHEN n_camp = 1 THEN '' ELSE 's' END) ELSE {q(P.BRIEF_CAMPAIGNS[2])} END"),
        (P.BRIEF_TACTICS, f"CASE WHEN len(tac) > 0 THEN {listed(P.BRIEF_TACTICS, 'tac')} ELSE {q(P.BRIEF_TACTICS[3])} END"),
        (P.BRIEF_ACTION, q(P.BRIEF_ACTION[1])),
        (P.BRIEF_POSTURE, q(P.BRIEF_POSTURE[1])),
    ]
    return " UNION ALL ".join(f"SELECT {i + 1} AS no, {q(w[0])} AS title, {d} AS detail FROM b" for i, (w, d) in enumerate(rows))


@register("dsh_brief", ITEMS + _TOP_SQL.replace("top AS", "topk AS").rstrip() + """,
agg AS (
  SELECT (SELECT coalesce(list(key ORDER BY rank), CAST([] AS VARCHAR[])) FROM topk WHERE dimension = 'incident') AS inc,
         (SELECT coalesce(list(key ORDER BY rank), CAST([] AS VARCHAR[])) FROM topk WHERE dimension = 'sector') AS sec,
         (SELECT coalesce(list(key ORDER BY rank), CAST([] AS VARCHAR[])) FROM topk WHERE dimension = 'tactic') AS tac,
         (SELECT count(DISTINCT ioc.normalized_value) FROM ioc JOIN items ON items.event_id = ioc.source_event_id) AS n_ind,
         (SELECT count(*) FROM ioc JOIN items ON items.event_id = ioc.source_event_id) AS n_shown,
         (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM camp) AS n_camp,
         (SELECT count(*) FROM items WHERE severity_label = 'high') AS high,
         (SELECT count(*) FROM items WHERE severity_label = 'medium') AS medium,
         (SELECT count(*) FROM items WHERE severity_label = 'low') AS low,
         (SELECT count(*) FROM items WHERE severity_label = 'informational') AS informational),
b AS (SELECT *, CASE WHEN n_ind > 0 THEN n_ind ELSE n_shown END AS ind FROM agg)
""" + _brief_sql())
def dsh_brief(spark, sf):
    c = Chain.of(spark, sf)
    return D.brief(R.items(c.ana, c.sco, c.cor, c.ioc), c.camp, c.ioc)


@register("dsh_sort_events", ITEMS + """
SELECT event_id, row_number() OVER (ORDER BY CASE severity_label WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2
       WHEN 'informational' THEN 1 ELSE 0 END DESC, event_id) AS rank FROM items""")
def dsh_sort_events(spark, sf):
    return D.sort_events(items(spark, sf), "severity_label", "desc").select("event_id", "rank")


@register("dsh_sort_events_default", ITEMS + """
SELECT event_id, row_number() OVER (ORDER BY confidence DESC, event_id) AS rank FROM items""")
def dsh_sort_events_default(spark, sf):
    return D.sort_events(items(spark, sf)).select("event_id", "rank")


@register("dsh_sort_iocs", O.chain("ioc") + """
SELECT source_event_id, ioc_type, value, row_number() OVER (
  ORDER BY lower(coalesce(nullif(normalized_value, ''), nullif(value, ''), '')), source_event_id, ioc_type, value) AS rank FROM ioc""")
def dsh_sort_iocs(spark, sf):
    return D.sort_iocs(Chain.of(spark, sf).ioc).select("source_event_id", "ioc_type", "value", "rank")
