"""Stage-table readers: explicit schemas, defaults for optional keys, a missing path as an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.session import read_if_exists

# Fixed schemas of the stage tables (JSON lines on disk).
SCHEMAS = {
    "raw_events": "event_id string, source string, source_url string, fetched_at timestamp, raw_text string, "
                  "raw_metadata string, content_hash string",
    "normalized_events": "event_id string, source string, source_url string, fetched_at timestamp, language string, "
                         "language_confidence double, clean_text string, tokens array<string>, raw_metadata string, "
                         "content_hash string",
    "iocs": "ioc_type string, value string, normalized_value string, confidence double, source_event_id string, "
            "context string",
    "analysis_results": "event_id string, incident_type string, incident_confidence double, sector string, "
                        "sector_confidence double, cluster_id int, cluster_confidence double, "
                        "explanations map<string, array<string>>",
    "correlation_results": "event_id string, campaign_id string, shared_iocs array<string>, temporal_cluster string, "
                           "mitre_tactics array<string>, confidence double",
    "campaigns": "campaign_id string, name string, start_time timestamp, end_time timestamp, n_events long, "
                 "n_iocs long, mitre_tactics array<string>, confidence double",
    "scores": "event_id string, severity double, severity_label string, confidence double, "
              "rationale struct<incident_conf: double, sector_conf: double, correlation_conf: double, "
              "ioc_score: double, mitre_score: double>",
}

# Defaults for optional keys, per table (built lazily: columns need an active session).
def defaults(table: str) -> dict:
    empty = F.array().cast("array<string>")
    return {
        "normalized_events": {"language": F.lit("unknown"), "language_confidence": F.lit(0.0),
                              "tokens": empty, "raw_metadata": F.lit("{}")},
        "raw_events": {"raw_metadata": F.lit("{}")},
        "iocs": {"normalized_value": F.col("value"), "confidence": F.lit(0.0)},
        "analysis_results": {"incident_type": F.lit("unknown"), "incident_confidence": F.lit(0.0),
                             "sector": F.lit("unknown"), "sector_confidence": F.lit(0.0),
                             "cluster_confidence": F.lit(0.0)},
        "correlation_results": {"shared_iocs": empty, "mitre_tactics": empty, "confidence": F.lit(0.0)},
        "campaigns": {"name": F.col("campaign_id"), "mitre_tactics": empty},
        "scores": {"severity_label": F.lit("informational")},
    }.get(table, {})


def read_stage(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one stage table; absent optional keys take their defaults, a missing path is empty."""
    schema = StructType.fromDDL(SCHEMAS[table])
    df = read_if_exists(lambda: spark.read.schema(schema).json(path))
    if df is None:
        return spark.createDataFrame([], schema)
    for col, default in defaults(table).items():
        df = df.withColumn(col, F.coalesce(F.col(col), default))
    return df
