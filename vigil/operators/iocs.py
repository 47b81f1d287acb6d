"""IOC extraction, per-event counts and key de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import ioc as I
from vigil.params import IocParams

IOC_KEY = ["source_event_id", "ioc_type", "normalized_value"]


def extract(norm: DataFrame, params: IocParams = IocParams(), text_col: str = "clean_text",
            id_col: str = "event_id") -> DataFrame:
    """One row per (event, type, distinct value): normalized value, constant confidence, context.

    A single scan with ``explode``; no shuffle.
    """
    hits = norm.select(F.col(id_col).alias("source_event_id"), F.col(text_col).alias("_text"),
                       F.explode(I.extract_all(F.col(text_col))).alias("_h"))
    return hits.select(
        F.col("_h.ioc_type").alias("ioc_type"),
        F.col("_h.value").alias("value"),
        I.normalize_ioc(F.col("_h.ioc_type"), F.col("_h.value"), params.suffixes).alias("normalized_value"),
        F.lit(float(params.confidence)).alias("confidence"),
        "source_event_id",
        I.context_expr("_text", "_h.value", params.context_window).alias("context"),
    )


def count_by_event(iocs: DataFrame) -> DataFrame:
    """Raw IOC rows per event (null/blank ids ignored); partial aggregation before the shuffle."""
    return (iocs.filter(F.col("source_event_id").isNotNull() & (F.col("source_event_id") != ""))
            .groupBy("source_event_id").agg(F.count(F.lit(1)).alias("ioc_count")))


def dedup(iocs: DataFrame, order_col: str = "value") -> DataFrame:
    """First row per (event, type, normalized value), ``order_col`` deciding 'first'
    (a ``min_by`` aggregate: combines map-side, no per-key sort)."""
    cols = [c for c in iocs.columns if c not in IOC_KEY]
    kept = iocs.groupBy(*IOC_KEY).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r"))
    return kept.select(*IOC_KEY, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*iocs.columns)


def dedup_audit(iocs: DataFrame) -> DataFrame:
    """Total rows, distinct keys and duplicate rows in one aggregate row."""
    per_key = iocs.groupBy(*IOC_KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("long").alias("total_rows"),
        F.count(F.lit(1)).cast("long").alias("distinct_keys"),
        (F.sum("n") - F.count(F.lit(1))).cast("long").alias("duplicate_rows"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("duplicated_keys"),
    )


def dedup_rebuild(iocs_with_id: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the row with the smallest surrogate id per key (``min_by`` aggregate, no window sort)."""
    cols = [c for c in iocs_with_id.columns if c not in IOC_KEY]
    kept = iocs_with_id.groupBy(*IOC_KEY).agg(
        F.min_by(F.struct(*cols), F.col(id_col)).alias("_row"))
    return kept.select(*IOC_KEY, *[F.col(f"_row.{c}").alias(c) for c in cols])
