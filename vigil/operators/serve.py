"""Serving queries over the stored tables (summary, listings, detail, pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import pages
from vigil.params import SEVERITY_LABELS

EVENTS_MAX_LIMIT = 500
IOCS_MAX_LIMIT = 1000


def severity_counts(scores: DataFrame) -> DataFrame:
    """Count per severity label, the four labels zero-filled (a 4-row right side)."""
    spark = scores.sparkSession
    labels = spark.createDataFrame([(lab,) for lab in SEVERITY_LABELS], "severity_label string")
    counts = scores.groupBy("severity_label").agg(F.count(F.lit(1)).alias("n"))
    zero_filled = labels.join(counts, "severity_label", "left").select(
        "severity_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    other = counts.join(labels, "severity_label", "left_anti").select("severity_label", F.col("n").cast("long"))
    return zero_filled.unionByName(other)


def incident_counts(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("incident_type").agg(F.count(F.lit(1)).alias("n"))


def sector_counts(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def summary(scores: DataFrame, analysis: DataFrame, campaigns: DataFrame, stored_iocs: DataFrame) -> DataFrame:
    """Totals and the three count maps as one long table (metric, key, n); no joins."""
    def total(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("long").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")

    def counts(df: DataFrame, metric: str, col: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), F.col(col).alias("key"), F.col("n").cast("long").alias("n"))

    return (total(scores, "total_events")
            .unionByName(total(campaigns, "campaign_count"))
            .unionByName(total(stored_iocs, "ioc_count"))
            .unionByName(counts(severity_counts(scores), "severity", "severity_label"))
            .unionByName(counts(incident_counts(analysis), "incident", "incident_type"))
            .unionByName(counts(sector_counts(analysis), "sector", "sector")))


EVENT_FILTERS = ["severity_label", "incident_type", "sector"]


def event_order() -> list:
    return [F.desc("severity"), F.asc("event_id")]


def event_listing(scores: DataFrame, analysis: DataFrame, norm: DataFrame, correlation: DataFrame) -> DataFrame:
    """All rows of the event listing."""
    s = scores.select("event_id", "severity", "severity_label", "confidence")
    a = analysis.select("event_id", "incident_type", "sector")
    n = norm.select("event_id", "fetched_at", "source", "source_url")
    c = correlation.select("event_id", "mitre_tactics", "campaign_id")
    return s.join(a, "event_id").join(n, "event_id").join(c, "event_id", "left").select(
        "event_id", "incident_type", "sector", "severity", "severity_label", "confidence", "fetched_at",
        "source", "source_url", F.coalesce("mitre_tactics", F.array().cast("array<string>")).alias("mitre_tactics"), "campaign_id")


def write_event_pages(path: str, listing: DataFrame, rows_a_file: int = pages.ROWS_A_FILE) -> None:
    """The event listing clustered by severity and id, with an index by file and filter values."""
    pages.write_clustered(listing, event_order(), path, EVENT_FILTERS, rows_a_file)


def events(spark: SparkSession, path: str, severity: str | None = None, incident: str | None = None, sector: str | None = None,
           limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the event listing at ``path``: severity descending (event id breaks ties), filtered."""
    if not 1 <= limit <= EVENTS_MAX_LIMIT or offset < 0:
        raise ValueError("limit must be 1..500 and offset >= 0")
    return pages.read_page(spark, path, event_order(), limit, offset, severity_label=severity, incident_type=incident, sector=sector)


def event_detail(event_id: str, scores: DataFrame, analysis: DataFrame, norm: DataFrame,
                 correlation: DataFrame, iocs: DataFrame) -> DataFrame:
    """One event's detail; no row when its analysis, score or event is missing."""
    key = F.col("event_id") == event_id
    a = analysis.filter(key).select("event_id", "incident_type", "incident_confidence", "sector", "sector_confidence")
    s = scores.filter(key).select("event_id", "severity", "severity_label", "confidence")
    n = norm.filter(key).select("event_id", "fetched_at", "source", "source_url", "clean_text")
    c = correlation.filter(key).select("event_id", "mitre_tactics", "campaign_id", "shared_iocs")
    i = iocs.filter(F.col("source_event_id") == event_id).groupBy(F.col("source_event_id").alias("event_id")) \
        .agg(F.sort_array(F.collect_list("normalized_value")).alias("iocs"))
    empty = F.array().cast("array<string>")
    return a.join(s, "event_id").join(n, "event_id").join(c, "event_id", "left").join(i, "event_id", "left").select(
        "event_id", "incident_type", "incident_confidence", "sector", "sector_confidence", "severity",
        "severity_label", "confidence", "fetched_at", "source", "source_url", "clean_text",
        F.coalesce("mitre_tactics", empty).alias("mitre_tactics"), "campaign_id",
        F.coalesce("shared_iocs", empty).alias("shared_iocs"), F.coalesce("iocs", empty).alias("iocs"))


def campaign_list(campaigns: DataFrame) -> DataFrame:
    """All campaigns, confidence descending (campaign id breaks ties)."""
    return campaigns.orderBy(F.desc("confidence"), F.asc("campaign_id"))


def campaign_members(membership: DataFrame, campaign_id: str | None = None, after: str = "", limit: int | None = None) -> DataFrame:
    """(campaign_id, event_id): all members, or one campaign's after an event id, a page at a time."""
    m = membership.filter(F.col("campaign_id").isNotNull()).select("campaign_id", "event_id")
    if campaign_id is None:
        return m
    page = m.filter((F.col("campaign_id") == campaign_id) & (F.col("event_id") > after)).orderBy("event_id")
    return page.limit(limit) if limit else page


def write_ioc_pages(path: str, stored_iocs: DataFrame, id_col: str = "id", rows_a_file: int = pages.ROWS_A_FILE) -> None:
    """Stored indicators clustered by surrogate id, newest first, with an index by file."""
    pages.write_clustered(stored_iocs, [F.desc(id_col)], path, [], rows_a_file)


def ioc_page(spark: SparkSession, path: str, id_col: str = "id", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the indicators at ``path``, newest surrogate id first."""
    if not 1 <= limit <= IOCS_MAX_LIMIT or offset < 0:
        raise ValueError("limit must be 1..1000 and offset >= 0")
    return pages.read_page(spark, path, [F.desc(id_col)], limit, offset)
