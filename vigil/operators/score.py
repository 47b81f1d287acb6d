"""Scoring: severity, label, confidence and rationale per analysed event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.params import ScoringParams


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def severity_label(sev: Column, p: ScoringParams = ScoringParams()) -> Column:
    return (F.when(sev >= p.high, "high").when(sev >= p.medium, "medium")
            .when(sev >= p.low, "low").otherwise("informational"))


def ioc_score(count: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(count, F.lit(0)) / F.lit(10.0))


def mitre_score(tactics: Column) -> Column:
    return F.when(tactics.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.size(tactics) / F.lit(5.0)))


def score(analysis: DataFrame, correlation: DataFrame, ioc_counts: DataFrame,
          p: ScoringParams = ScoringParams()) -> DataFrame:
    """scores rows, one per analysis row; missing correlation or IOCs count as 0."""
    cor = correlation.select("event_id", F.col("confidence").alias("_cc"), F.col("mitre_tactics").alias("_mt"))
    cnt = ioc_counts.select(F.col("source_event_id").alias("event_id"), F.col("ioc_count").alias("_n"))
    df = analysis.select("event_id", "incident_confidence", "sector_confidence").join(cor, "event_id", "left") \
        .join(cnt, "event_id", "left")
    df = df.select(
        "event_id", "incident_confidence", "sector_confidence",
        F.coalesce(F.col("_cc"), F.lit(0.0)).alias("correlation_conf"),
        ioc_score(F.col("_n")).alias("ioc_score"),
        mitre_score(F.col("_mt")).alias("mitre_score"),
    )
    sev = clip01(p.w_incident_conf * F.col("incident_confidence") + p.w_sector_conf * F.col("sector_confidence")
                 + p.w_correlation_conf * F.col("correlation_conf") + p.w_ioc_count * F.col("ioc_score")
                 + p.w_mitre_tactics * F.col("mitre_score"))
    return df.select(
        "event_id",
        sev.alias("severity"),
        severity_label(sev, p).alias("severity_label"),
        F.greatest(F.col("incident_confidence"), F.col("correlation_conf")).alias("confidence"),
        F.struct(F.col("incident_confidence").alias("incident_conf"),
                 F.col("sector_confidence").alias("sector_conf"),
                 "correlation_conf", "ioc_score", "mitre_score").alias("rationale"),
    )
