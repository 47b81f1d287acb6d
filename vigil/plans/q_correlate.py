"""Registered queries: correlation, graph, campaigns and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import correlate as C
from vigil.operators import score as S
from vigil.params import CorrelationParams
from vigil.plans import oracle as O
from vigil.plans.registry import arr, dbl, register, s_arr, s_dbl, s_ts, ts
from vigil.plans.views import Chain, read_table

COR = O.chain("cor")
CAMP = O.chain("camp")
SCO = O.chain("sco")
DEFAULT_GRAPH = "WITH RECURSIVE " + ",\n".join([O.RAW, O.cte_norm(), O.cte_ioc(), O.cte_ana(),
                            O.cte_graph(use_clusters=True, use_temporal=True)]) + "\n"


@register("cor_ioc_index", O.chain("ioc") + """
SELECT DISTINCT normalized_value AS value, source_event_id AS event_id FROM ioc
WHERE normalized_value IS NOT NULL AND source_event_id IS NOT NULL""")
def cor_ioc_index(spark, sf):
    return C.ioc_index(Chain.of(spark, sf).ioc)


@register("cor_shared_iocs", COR + f"SELECT event_id, {s_arr('shared_iocs', True)} AS shared_iocs, n_shared FROM shared")
def cor_shared_iocs(spark, sf):
    s = C.shared_iocs(Chain.of(spark, sf).ioc)
    return s.select("event_id", arr("shared_iocs", True).alias("shared_iocs"), "n_shared")


@register("cor_temporal_key", f"SELECT event_id, {O.sql_temporal_key('ts')} AS temporal_cluster FROM events")
def cor_temporal_key(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", C.temporal_key(F.col("ts")).alias("temporal_cluster"))


@register("cor_temporal_groups", f"""
SELECT {O.sql_temporal_key('ts')} AS temporal_cluster, count(*) AS n_events FROM events GROUP BY 1""")
def cor_temporal_groups(spark, sf):
    e = read_table(spark, sf, "events").withColumnRenamed("ts", "fetched_at")
    return C.temporal_groups(e)


@register("cor_cluster_groups", "SELECT label AS cluster_id, count(*) AS n_events FROM embeddings GROUP BY label")
def cor_cluster_groups(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"))
    return C.cluster_groups(e)


@register("cor_edges", DEFAULT_GRAPH + """
SELECT src, dst, CASE WHEN dst LIKE '#ioc:%' THEN 'shared_ioc' WHEN dst LIKE '#clu:%' THEN 'analysis_cluster'
       ELSE 'temporal_window' END AS reason FROM hub""")
def cor_edges(spark, sf):
    c = Chain.of(spark, sf, cor_params=CorrelationParams())
    return C.hub_edges(c.norm, c.ioc, c.ana, c.cor_params)


@register("cor_components", COR + "SELECT event_id, component_number, component_size FROM membership")
def cor_components(spark, sf):
    return Chain.of(spark, sf).membership.select("event_id", "component_number", "component_size")


@register("cor_components_default", DEFAULT_GRAPH + "SELECT event_id, component_number, component_size, campaign_id FROM membership")
def cor_components_default(spark, sf):
    c = Chain.of(spark, sf, cor_params=CorrelationParams())
    return c.membership.select("event_id", "component_number", "component_size", "campaign_id")


def _shared_graph(k):
    return O.with_ctes(O.RAW, O.cte_norm(), O.cte_ioc(), O.cte_graph(min_shared=k))


def _shared_membership(spark, sf, k):
    p = CorrelationParams(use_analysis_clusters=False, use_temporal_window=False, min_shared_iocs=k)
    return Chain.of(spark, sf, cor_params=p).membership.select("event_id", "component_number", "component_size")


@register("cor_components_min2", _shared_graph(2) + "SELECT event_id, component_number, component_size FROM membership")
def cor_components_min2(spark, sf):
    """Events linked by at least two shared indicators."""
    return _shared_membership(spark, sf, 2)


@register("cor_components_min3", _shared_graph(3) + "SELECT event_id, component_number, component_size FROM membership")
def cor_components_min3(spark, sf):
    return _shared_membership(spark, sf, 3)


@register("cor_campaign_ids", COR + """
SELECT component_number, min(event_id) AS first_event, count(*) AS component_size,
       min(campaign_id) AS campaign_id FROM membership GROUP BY component_number""")
def cor_campaign_ids(spark, sf):
    m = Chain.of(spark, sf).membership
    return m.groupBy("component_number").agg(F.min("event_id").alias("first_event"),
                                             F.count(F.lit(1)).alias("component_size"),
                                             F.min("campaign_id").alias("campaign_id"))


@register("cor_min_size", COR + """
SELECT campaign_id, count(*) AS n_events FROM membership WHERE campaign_id IS NOT NULL GROUP BY campaign_id""")
def cor_min_size(spark, sf):
    m = Chain.of(spark, sf).membership
    return m.filter(F.col("campaign_id").isNotNull()).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_events"))


@register("cor_membership", COR + "SELECT event_id, campaign_id FROM cor")
def cor_membership(spark, sf):
    return Chain.of(spark, sf).cor.select("event_id", "campaign_id")


@register("cor_campaign_span", CAMP + f"SELECT campaign_id, {s_ts('start_time')} AS start_time, {s_ts('end_time')} AS end_time FROM camp")
def cor_campaign_span(spark, sf):
    c = Chain.of(spark, sf).camp
    return c.select("campaign_id", ts("start_time").alias("start_time"), ts("end_time").alias("end_time"))


@register("cor_campaign_iocs", CAMP + "SELECT campaign_id, ioc FROM camp_iocs")
def cor_campaign_iocs(spark, sf):
    c = Chain.of(spark, sf)
    return C.campaign_iocs(c.cor, c.membership)


@register("cor_campaign_tactics", CAMP + f"SELECT campaign_id, {s_arr('mitre_tactics')} AS mitre_tactics FROM camp")
def cor_campaign_tactics(spark, sf):
    c = Chain.of(spark, sf).camp
    return c.select("campaign_id", arr("mitre_tactics").alias("mitre_tactics"))


@register("cor_campaign_confidence", CAMP + f"SELECT campaign_id, n_events, n_iocs, {s_dbl('confidence')} AS confidence FROM camp")
def cor_campaign_confidence(spark, sf):
    c = Chain.of(spark, sf).camp
    return c.select("campaign_id", "n_events", F.col("n_iocs").cast("long").alias("n_iocs"), dbl("confidence").alias("confidence"))


@register("cor_shared_score", COR + f"""
SELECT n.event_id, {s_dbl("CASE WHEN s.n_shared > 0 THEN least(1.0, s.n_shared / CAST((SELECT mx FROM max_shared) AS DOUBLE)) ELSE 0.0 END")} AS shared_score
FROM norm n LEFT JOIN shared s USING (event_id)""")
def cor_shared_score(spark, sf):
    c = Chain.of(spark, sf)
    sh = C.shared_iocs(c.ioc)
    mx = sh.agg(F.max("n_shared")).first()[0] or 1
    return c.norm.select("event_id").join(sh, "event_id", "left").select(
        "event_id", dbl(F.when(F.col("n_shared") > 0, F.least(F.lit(1.0), F.col("n_shared") / F.lit(float(mx))))
                        .otherwise(0.0)).alias("shared_score"))


@register("cor_cluster_score", """
SELECT vec_id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN 1.0 ELSE 0.0 END AS cluster_score FROM embeddings""")
def cor_cluster_score(spark, sf):
    e = read_table(spark, sf, "embeddings")
    sizes = C.cluster_groups(e.select(F.col("label").alias("cluster_id")))
    return e.select("vec_id", F.col("label").alias("cluster_id")).join(sizes, "cluster_id").select(
        "vec_id", F.when(F.col("n_events") > 1, 1.0).otherwise(0.0).alias("cluster_score"))


@register("cor_temporal_score", f"""
SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY {O.sql_temporal_key('ts')}) > 1 THEN 1.0 ELSE 0.0 END AS temporal_score
FROM events""")
def cor_temporal_score(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", F.col("ts").alias("fetched_at"))
    w = C.event_windows(e)
    return w.select("event_id", F.when(F.col("window_size") > 1, 1.0).otherwise(0.0).alias("temporal_score"))


@register("cor_confidence", COR + f"SELECT event_id, {s_dbl('confidence')} AS confidence FROM cor")
def cor_confidence(spark, sf):
    return Chain.of(spark, sf).cor.select("event_id", dbl("confidence").alias("confidence"))


@register("cor_correlate", COR + f"""
SELECT event_id, campaign_id, {s_arr('shared_iocs', True)} AS shared_iocs, temporal_cluster,
       {s_arr('mitre_tactics', True)} AS mitre_tactics, {s_dbl('confidence')} AS confidence FROM cor""")
def cor_correlate(spark, sf):
    c = Chain.of(spark, sf).cor
    return c.select("event_id", "campaign_id", arr("shared_iocs", True).alias("shared_iocs"), "temporal_cluster",
                    arr("mitre_tactics", True).alias("mitre_tactics"), dbl("confidence").alias("confidence"))


@register("cor_campaigns", CAMP + f"""
SELECT campaign_id, name, {s_ts('start_time')} AS start_time, {s_ts('end_time')} AS end_time, n_events, n_iocs,
       {s_arr('mitre_tactics')} AS mitre_tactics, {s_dbl('confidence')} AS confidence FROM camp""")
def cor_campaigns(spark, sf):
    c = Chain.of(spark, sf).camp
    return c.select("campaign_id", "name", ts("start_time").alias("start_time"), ts("end_time").alias("end_time"),
                    "n_events", F.col("n_iocs").cast("long").alias("n_iocs"), arr("mitre_tactics").alias("mitre_tactics"),
                    dbl("confidence").alias("confidence"))


# --- scoring -----------------------------------------------------------------

@register("sco_ioc_score", O.chain("sco") + f"SELECT event_id, {s_dbl('ioc_score')} AS ioc_score FROM sco")
def sco_ioc_score(spark, sf):
    c = Chain.of(spark, sf)
    return c.norm.select("event_id").join(c.ioc_counts.withColumnRenamed("source_event_id", "event_id"), "event_id", "left") \
        .select("event_id", dbl(S.ioc_score(F.col("ioc_count"))).alias("ioc_score"))


@register("sco_mitre_score", COR + f"""
SELECT event_id, {s_dbl('least(1.0, CAST(len(mitre_tactics) AS DOUBLE) / 5.0)')} AS mitre_score FROM cor""")
def sco_mitre_score(spark, sf):
    c = Chain.of(spark, sf).cor
    return c.select("event_id", dbl(S.mitre_score(F.col("mitre_tactics"))).alias("mitre_score"))


@register("sco_severity", SCO + f"SELECT event_id, {s_dbl('severity')} AS severity FROM sco")
def sco_severity(spark, sf):
    return Chain.of(spark, sf).sco.select("event_id", dbl("severity").alias("severity"))


@register("sco_label", """
SELECT event_id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.3 THEN 'low'
       ELSE 'informational' END AS severity_label
FROM (SELECT event_id, value / (SELECT max(value) FROM events) AS s FROM events)""")
def sco_label(spark, sf):
    e = read_table(spark, sf, "events")
    mx = e.agg(F.max("value")).first()[0]
    return e.select("event_id", S.severity_label(F.col("value") / F.lit(mx)).alias("severity_label"))


@register("sco_confidence", SCO + f"SELECT event_id, {s_dbl('confidence')} AS confidence FROM sco")
def sco_confidence(spark, sf):
    return Chain.of(spark, sf).sco.select("event_id", dbl("confidence").alias("confidence"))


@register("sco_rationale", SCO + f"""
SELECT event_id, {s_dbl('incident_conf')} AS incident_conf, {s_dbl('sector_conf')} AS sector_conf,
       {s_dbl('correlation_conf')} AS correlation_conf, {s_dbl('ioc_score')} AS ioc_score,
       {s_dbl('mitre_score')} AS mitre_score FROM sco""")
def sco_rationale(spark, sf):
    s = Chain.of(spark, sf).sco
    return s.select("event_id", *[dbl(F.col("rationale")[k]).alias(k) for k in
                                  ("incident_conf", "sector_conf", "correlation_conf", "ioc_score", "mitre_score")])


@register("sco_score", SCO + f"""
SELECT event_id, {s_dbl('severity')} AS severity, severity_label, {s_dbl('confidence')} AS confidence FROM sco""")
def sco_score(spark, sf):
    s = Chain.of(spark, sf).sco
    return s.select("event_id", dbl("severity").alias("severity"), "severity_label", dbl("confidence").alias("confidence"))
