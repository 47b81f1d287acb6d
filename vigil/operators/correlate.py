"""Correlation: shared indicators, time windows, clusters, campaigns and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.keywords import mitre_tactics
from vigil.operators.graph import connected_components, dense_rank_by
from vigil.operators.overlap import overlap_links
from vigil.operators.score import clip01
from vigil.operators.skew import join_per_key
from vigil.params import CorrelationParams

HUB_IOC, HUB_CLUSTER, HUB_WINDOW = "#ioc:", "#clu:", "#win:"


def temporal_key(ts: Column, window_hours: int = 24) -> Column:
    """``window_<epoch>`` of the UTC bucket start."""
    w = int(window_hours) * 3600
    secs = F.unix_seconds(ts.cast("timestamp"))
    return F.concat(F.lit("window_"), (F.floor(secs / F.lit(w)) * F.lit(w)).cast("long").cast("string"))


def ioc_index(iocs: DataFrame) -> DataFrame:
    """Distinct (normalized_value, event) pairs; the type is ignored."""
    return iocs.select(F.col("normalized_value").alias("value"), F.col("source_event_id").alias("event_id")) \
        .filter(F.col("value").isNotNull() & F.col("event_id").isNotNull()).distinct()


def value_event_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("value").agg(F.count(F.lit(1)).alias("n_events"))


def shared_iocs(iocs: DataFrame) -> DataFrame:
    """Per event: sorted values seen in at least two events, and their number.

    The per-event list is bounded by the event's own text; the per-value
    count is a partial aggregate, so a value present in a third of all events
    is never gathered in one place.
    """
    idx = ioc_index(iocs)
    multi = value_event_counts(idx).filter("n_events >= 2")
    return join_per_key(idx, multi, "value", "event_id", "inner").groupBy("event_id").agg(
        F.sort_array(F.collect_list("value")).alias("shared_iocs"),
        F.count(F.lit(1)).alias("n_shared"))


def event_windows(norm: DataFrame, window_hours: int = 24) -> DataFrame:
    """(event_id, fetched_at, temporal_cluster, window_size)."""
    ev = norm.select("event_id", "fetched_at", temporal_key(F.col("fetched_at"), window_hours).alias("temporal_cluster"))
    sizes = ev.groupBy("temporal_cluster").agg(F.count(F.lit(1)).alias("window_size"))
    return join_per_key(ev, sizes, "temporal_cluster", "event_id", rows="window_size")


def temporal_groups(norm: DataFrame, window_hours: int = 24) -> DataFrame:
    """Events per window: (temporal_cluster, n_events)."""
    ev = norm.select(temporal_key(F.col("fetched_at"), window_hours).alias("temporal_cluster"))
    return ev.groupBy("temporal_cluster").agg(F.count(F.lit(1)).alias("n_events"))


def cluster_groups(analysis: DataFrame) -> DataFrame:
    """Events per analysis cluster (null cluster is its own group, never linked)."""
    return analysis.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_events"))


def hub_edges(norm: DataFrame, iocs: DataFrame, analysis: DataFrame, p: CorrelationParams) -> DataFrame:
    """Star edges event -> hub for every linking group with at least two events."""
    idx = ioc_index(iocs)
    if p.min_shared_iocs > 1:
        edges = overlap_links(idx, "event_id", "value", p.min_shared_iocs).select(
            F.col("member").alias("src"), F.concat(F.lit(HUB_IOC), F.col("hub")).alias("dst"), F.lit("shared_ioc").alias("reason"))
    else:
        multi = value_event_counts(idx).filter("n_events >= 2")
        edges = join_per_key(idx, multi, "value", "event_id", "inner").select(
            F.col("event_id").alias("src"), F.concat(F.lit(HUB_IOC), F.col("value")).alias("dst"),
            F.lit("shared_ioc").alias("reason"))
    if p.use_analysis_clusters:
        a = analysis.filter(F.col("cluster_id").isNotNull()).select("event_id", "cluster_id")
        big = a.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_events")).filter("n_events >= 2")
        edges = edges.unionByName(join_per_key(a, big, "cluster_id", "event_id", "inner").select(
            F.col("event_id").alias("src"),
            F.concat(F.lit(HUB_CLUSTER), F.col("cluster_id").cast("string")).alias("dst"),
            F.lit("analysis_cluster").alias("reason")))
    if p.use_temporal_window:
        w = event_windows(norm, p.temporal_window_hours).filter("window_size >= 2")
        edges = edges.unionByName(w.select(
            F.col("event_id").alias("src"),
            F.concat(F.lit(HUB_WINDOW), F.col("temporal_cluster")).alias("dst"),
            F.lit("temporal_window").alias("reason")))
    return edges


def event_components(norm: DataFrame, iocs: DataFrame, analysis: DataFrame, p: CorrelationParams) -> DataFrame:
    """(event_id, component, known) for every event node of the graph."""
    edges = hub_edges(norm, iocs, analysis, p)
    nodes = norm.select(F.col("event_id").alias("node"))
    comps = connected_components(nodes, edges.select("src", "dst"))
    hub = F.col("node").startswith(HUB_IOC) | F.col("node").startswith(HUB_CLUSTER) | F.col("node").startswith(HUB_WINDOW)
    known = norm.select(F.col("event_id").alias("node"), F.lit(True).alias("known"))
    return comps.filter(~hub).join(known, "node", "left").select(
        F.col("node").alias("event_id"), "component", F.coalesce(F.col("known"), F.lit(False)).alias("known"))


def campaign_membership(norm: DataFrame, iocs: DataFrame, analysis: DataFrame,
                        p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """(event_id, known, component_number, component_size, campaign_id).

    Components are numbered 1.. in the order of their first event (known
    events by id first, then ids seen only in edges), counting every component,
    so numbers of dropped small components leave gaps; components with at
    least ``min_campaign_size`` events become ``CAMP-%04d`` campaigns.
    """
    ec = event_components(norm, iocs, analysis, p)
    first = ec.groupBy("component").agg(
        F.min(F.struct((~F.col("known")).alias("unk"), F.col("event_id").alias("eid"))).alias("first"),
        F.count(F.lit(1)).alias("component_size"))
    first = first.withColumn("order_key", F.concat(F.when(F.col("first.unk"), "1").otherwise("0"), F.col("first.eid")))
    ranked = dense_rank_by(first.select("component", "component_size", "order_key"), "order_key", "component_number")
    # one component may hold nearly all events
    out = join_per_key(ec, ranked.select("component", "component_size", "component_number"), "component", "event_id", "inner", rows="component_size")
    return out.select(
        "event_id", "known", "component_number", "component_size",
        F.when(F.col("component_size") >= p.min_campaign_size,
               F.format_string("CAMP-%04d", F.col("component_number"))).alias("campaign_id"))


def correlate(norm: DataFrame, iocs: DataFrame, analysis: DataFrame,
              p: CorrelationParams = CorrelationParams(),
              membership: DataFrame | None = None) -> DataFrame:
    """correlation_results: one row per normalized event."""
    mem = membership if membership is not None else campaign_membership(norm, iocs, analysis, p)
    sh = shared_iocs(iocs)
    max_shared = sh.agg(F.max("n_shared")).first()[0] or 1
    win = event_windows(norm, p.temporal_window_hours)
    csize = cluster_groups(analysis).filter(F.col("cluster_id").isNotNull())
    ana = join_per_key(analysis.select("event_id", "cluster_id", "incident_confidence", "sector_confidence"), csize, "cluster_id", "event_id")
    ev = norm.select("event_id", mitre_tactics(F.col("clean_text")).alias("mitre_tactics"))
    df = (ev.join(win.select("event_id", "temporal_cluster", "window_size"), "event_id", "left")
          .join(sh, "event_id", "left")
          .join(ana, "event_id", "left")
          .join(mem.select("event_id", "campaign_id"), "event_id", "left"))
    shared_score = F.when(F.col("n_shared") > 0, F.least(F.lit(1.0), F.col("n_shared") / F.lit(float(max_shared)))) \
        .otherwise(F.lit(0.0))
    cluster_score = F.when(F.col("cluster_id").isNotNull() & (F.col("n_events") > 1), 1.0).otherwise(0.0)
    temporal_score = F.when(F.col("window_size") > 1, 1.0).otherwise(0.0)
    conf = clip01(p.w_shared_ioc * shared_score + p.w_analysis_cluster * cluster_score
                  + p.w_temporal * temporal_score
                  + p.w_incident_conf * F.coalesce(F.col("incident_confidence"), F.lit(0.0))
                  + p.w_sector_conf * F.coalesce(F.col("sector_confidence"), F.lit(0.0)))
    return df.select(
        "event_id", "campaign_id",
        F.coalesce(F.col("shared_iocs"), F.array().cast("array<string>")).alias("shared_iocs"),
        "temporal_cluster", "mitre_tactics", conf.alias("confidence"))


def campaigns(norm: DataFrame, correlation: DataFrame, membership: DataFrame) -> DataFrame:
    """campaigns: id, name, span, member/indicator counts, tactics, confidence.

    Members and indicators stay long-form (``campaign_events``,
    ``campaign_iocs``); the aggregate row holds counts so that a campaign
    holding a third of all events is never gathered into one array.
    """
    mem = membership.filter(F.col("campaign_id").isNotNull()).select("event_id", "campaign_id")
    ev = norm.select("event_id", "fetched_at")
    span = mem.join(ev, "event_id", "left").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("fetched_at").alias("start_time"), F.max("fetched_at").alias("end_time"))
    span = span.select("campaign_id", "n_events",
                       F.coalesce("start_time", F.current_timestamp()).alias("start_time"),
                       F.coalesce("end_time", F.current_timestamp()).alias("end_time"))
    ci = campaign_iocs(correlation, membership).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_iocs"))
    tac = campaign_tactics(correlation, membership)
    out = span.join(ci, "campaign_id", "left").join(tac, "campaign_id", "left")
    n_iocs = F.coalesce(F.col("n_iocs"), F.lit(0))
    return out.select(
        "campaign_id", F.col("campaign_id").alias("name"), "start_time", "end_time",
        "n_events", n_iocs.alias("n_iocs"),
        F.coalesce(F.col("mitre_tactics"), F.array().cast("array<string>")).alias("mitre_tactics"),
        F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * F.col("n_events") + F.lit(0.05) * n_iocs).alias("confidence"))


def campaign_events(membership: DataFrame) -> DataFrame:
    return membership.filter(F.col("campaign_id").isNotNull()).select("campaign_id", "event_id")


def campaign_iocs(correlation: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct shared values of each campaign's members."""
    mem = campaign_events(membership)
    return mem.join(correlation.select("event_id", F.explode("shared_iocs").alias("ioc")), "event_id") \
        .select("campaign_id", "ioc").distinct()


def campaign_tactics(correlation: DataFrame, membership: DataFrame) -> DataFrame:
    """Union of member tactics (at most the 12 tactics per campaign)."""
    mem = campaign_events(membership)
    return mem.join(correlation.select("event_id", F.explode("mitre_tactics").alias("t")), "event_id") \
        .groupBy("campaign_id").agg(F.sort_array(F.collect_set("t")).alias("mitre_tactics"))

