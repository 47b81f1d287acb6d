"""Reporting: report items, summary sentences, ordering and text/JSON renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.graph import global_rank

IOCS_SHOWN = 10
TACTICS_IN_SUMMARY = 4
TEXT_REPORT_ITEMS = 50


def ioc_lists(iocs: DataFrame) -> DataFrame:
    """Per event: sorted normalized values (all raw rows), the first 10, and the full count.

    The per-event list is bounded by the event's own text.
    """
    g = iocs.filter(F.col("source_event_id").isNotNull()).groupBy("source_event_id").agg(
        F.sort_array(F.collect_list("normalized_value")).alias("_all"))
    return g.select(F.col("source_event_id").alias("event_id"),
                    F.slice("_all", 1, IOCS_SHOWN).alias("iocs"), F.size("_all").cast("long").alias("n_iocs"))


def summary_text(incident: Column, sector: Column, severity_label: Column, ioc_count: Column, tactics: Column) -> Column:
    """'; '-joined analyst sentence."""
    parts = [
        F.when(incident.isNotNull() & (incident != "") & (incident != "unknown"),
               F.concat(F.lit("Likely "), incident, F.lit(" activity"))).otherwise(F.lit("Unclassified activity")),
        F.when(sector.isNotNull() & (sector != "") & (sector != "unknown"),
               F.concat(F.lit("targeting "), sector, F.lit(" sector"))),
        F.when(severity_label.isNotNull() & (severity_label != ""),
               F.concat(F.lit("severity assessed as "), severity_label)),
        F.when(ioc_count > 0, F.concat(ioc_count.cast("string"), F.lit(" IOCs observed"))),
        F.when(F.size(tactics) > 0,
               F.concat(F.lit("MITRE tactics: "), F.array_join(F.slice(tactics, 1, TACTICS_IN_SUMMARY), ", "))),
    ]
    return F.concat_ws("; ", *parts)


def items(analysis: DataFrame, scores: DataFrame, correlation: DataFrame, iocs: DataFrame) -> DataFrame:
    """One report item per analysed event that has a score."""
    lists = ioc_lists(iocs)
    df = (analysis.select("event_id", "incident_type", "sector")
          .join(scores.select("event_id", "severity_label", "severity", "confidence"), "event_id")
          .join(correlation.select("event_id", "mitre_tactics"), "event_id", "left")
          .join(lists, "event_id", "left"))
    tactics = F.coalesce(F.col("mitre_tactics"), F.array().cast("array<string>"))
    n = F.coalesce(F.col("n_iocs"), F.lit(0).cast("long"))
    return df.select(
        "event_id", "incident_type", "sector", "severity_label", "severity", "confidence",
        tactics.alias("mitre_tactics"),
        F.coalesce(F.col("iocs"), F.array().cast("array<string>")).alias("iocs"),
        n.alias("n_iocs"),
        summary_text(F.col("incident_type"), F.col("sector"), F.col("severity_label"), n, tactics).alias("summary"))


def ranked(report_items: DataFrame) -> DataFrame:
    """Items with their 1-based report position: severity descending, event id breaking ties."""
    return global_rank(report_items, [F.desc("severity"), F.asc("event_id")], "rank")


def top_items(report_items: DataFrame, n: int = TEXT_REPORT_ITEMS) -> DataFrame:
    """The first ``n`` items of the report order (a top-k, served by TakeOrderedAndProject)."""
    return report_items.orderBy(F.desc("severity"), F.asc("event_id")).limit(n)


def text_lines(report_items: DataFrame, n: int = TEXT_REPORT_ITEMS) -> DataFrame:
    """Plain-text report body for the top ``n`` items: (rank, line_no, kind, text, cents).

    ``text`` holds the rendered line (2-decimal numbers via ``format_string``),
    ``cents`` the rounded value behind numeric lines.
    """
    top = top_items(report_items, n)
    w = Window.orderBy(F.desc("severity"), F.asc("event_id"))
    top = top.withColumn("rank", F.row_number().over(w))  # over at most n rows
    def line(no: int, kind: str, text: Column, cents: Column | None = None) -> Column:
        return F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), text.alias("text"),
                        (cents if cents is not None else F.lit(None)).cast("long").alias("cents"))

    lines = F.array_compact(F.array(
        line(1, "event", F.concat(F.lit("Event: "), F.col("event_id"))),
        line(2, "summary", F.concat(F.lit("Summary: "), F.col("summary"))),
        line(3, "severity", F.format_string("Severity: %s (%.2f)", F.col("severity_label"), F.col("severity")),
             F.round(F.col("severity") * 100)),
        line(4, "confidence", F.format_string("Confidence: %.2f", F.col("confidence")), F.round(F.col("confidence") * 100)),
        F.when(F.size("mitre_tactics") > 0, line(5, "mitre", F.concat(F.lit("MITRE: "), F.array_join("mitre_tactics", ", ")))),
        F.when(F.size("iocs") > 0, line(6, "iocs", F.concat(F.lit("IOCs: "), F.array_join("iocs", ", ")))),
        line(7, "separator", F.lit("-")),
    ))
    return top.select("rank", F.explode(lines).alias("l")).select(
        "rank", F.col("l.no").alias("line_no"), F.col("l.kind").alias("kind"), F.col("l.text").alias("text"),
        F.col("l.cents").alias("cents"))


def bundle_json(report_items: DataFrame, campaigns: DataFrame, generated_at: Column) -> DataFrame:
    """Report as JSON rows (one per item and per campaign) stamped with ``generated_at``."""
    it = report_items.select(F.lit("item").alias("kind"), F.col("event_id").alias("key"),
                             F.to_json(F.struct(*report_items.columns)).alias("json"))
    ca = campaigns.select(F.lit("campaign").alias("kind"), F.col("campaign_id").alias("key"),
                          F.to_json(F.struct(*campaigns.columns)).alias("json"))
    return it.unionByName(ca).withColumn("generated_at", generated_at)
