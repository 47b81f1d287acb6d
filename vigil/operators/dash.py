"""Dashboard aggregates over report items, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import params as P
from vigil.operators.graph import global_rank
from vigil.session import materialize

SEVERITY_RANK = {"high": 4, "medium": 3, "low": 2, "informational": 1}
TOP_INCIDENTS, TOP_SECTORS, TOP_TACTICS = 2, 2, 3


def _key(col: Column, default: str) -> Column:
    return F.coalesce(F.when(col != "", col), F.lit(default))


def count_by(items: DataFrame) -> DataFrame:
    """(dimension, key, n) for incident, sector and severity label; blanks default."""
    inc = items.select(F.lit("incident").alias("dimension"), _key(F.col("incident_type"), "unknown").alias("key"))
    sec = items.select(F.lit("sector").alias("dimension"), _key(F.col("sector"), "unknown").alias("key"))
    sev = items.select(F.lit("severity").alias("dimension"), _key(F.col("severity_label"), "informational").alias("key"))
    return inc.unionByName(sec).unionByName(sev).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def tactic_counts(items: DataFrame) -> DataFrame:
    t = items.select(F.explode("mitre_tactics").alias("t"))
    return t.select(_key(F.col("t"), "unknown").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def top_keys(items: DataFrame) -> DataFrame:
    """(dimension, rank, key, n): top 2 incidents, 2 sectors, 3 tactics by count (key breaks ties).

    The window runs per dimension over already-aggregated counts (bounded by
    the number of distinct labels).
    """
    counts = count_by(items).filter(F.col("dimension") != "severity") \
        .unionByName(tactic_counts(items).select(F.lit("tactic").alias("dimension"), "key", "n"))
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("key"))
    limit = F.when(F.col("dimension") == "incident", TOP_INCIDENTS).when(F.col("dimension") == "sector", TOP_SECTORS) \
        .otherwise(TOP_TACTICS)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def item_indicators(items: DataFrame, iocs: DataFrame) -> DataFrame:
    """All indicators (key) of the report's events, one row per occurrence; the items themselves show only a few each."""
    of = iocs.select(F.col("source_event_id").alias("event_id"), F.col("normalized_value").alias("key"))
    return of.join(items.select("event_id"), "event_id", "left_semi").select("key")


def distinct_iocs(items: DataFrame, iocs: DataFrame) -> DataFrame:
    """Distinct indicators over all items, and their total (fallback when none)."""
    ex = item_indicators(items, iocs).withColumnRenamed("key", "i")
    return ex.agg(F.count_distinct("i").alias("n_distinct"), F.count(F.lit(1)).alias("n_total")).select(
        "n_distinct", "n_total",
        F.when(F.col("n_distinct") > 0, F.col("n_distinct")).otherwise(F.col("n_total")).alias("indicator_count"))


def severity_distribution(items: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row: high/medium/low/informational, items and campaigns (a union, then one aggregate)."""
    lab = _key(F.col("severity_label"), "informational")
    it = items.select(lab.alias("l"), F.lit(1).alias("item"), F.lit(0).alias("camp"))
    ca = campaigns.select(F.lit(None).cast("string").alias("l"), F.lit(0).alias("item"), F.lit(1).alias("camp"))
    u = it.unionByName(ca)
    return u.agg(*[F.sum(F.when(F.col("l") == k, 1).otherwise(0)).cast("long").alias(k) for k in SEVERITY_RANK],
                 F.sum("item").cast("long").alias("n_items"), F.sum("camp").cast("long").alias("n_campaigns"))


def _fmt_list(keys: Column, fallback: str) -> Column:
    return F.when(F.size(keys) > 0, F.array_join(keys, ", ")).otherwise(F.lit(fallback))


def brief(items: DataFrame, campaigns: DataFrame, iocs: DataFrame) -> DataFrame:
    """Briefing bullets (no, title, detail) built from one aggregate row.

    What is counted of the items is written once: their joins are otherwise planned and run again for each of the counts, all at the same time.
    """
    items = materialize(items.select("event_id", "incident_type", "sector", "severity_label", "mitre_tactics", "n_iocs"), "brief_items")
    tk = top_keys(items).select("dimension", "rank", "key", F.lit(None).cast("long").alias("v"))
    ex = item_indicators(items, iocs).distinct().select(
        F.lit("indicator").alias("dimension"), F.lit(0).alias("rank"), "key", F.lit(None).cast("long").alias("v"))
    tot = items.select(F.lit("shown").alias("dimension"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("key"),
                       F.col("n_iocs").alias("v"))
    sev = items.select(F.lit("sev").alias("dimension"), F.lit(0).alias("rank"),
                       _key(F.col("severity_label"), "informational").alias("key"), F.lit(1).cast("long").alias("v"))
    cam = campaigns.select(F.lit("camp").alias("dimension"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("key"),
                           F.lit(1).cast("long").alias("v"))
    u = tk.unionByName(ex).unionByName(tot).unionByName(sev).unionByName(cam)

    def top(dim: str) -> Column:
        s = F.sort_array(F.collect_list(F.when(F.col("dimension") == dim, F.struct("rank", "key"))))
        return F.transform(s, lambda x: x["key"])

    row = u.agg(
        top("incident").alias("inc"), top("sector").alias("sec"), top("tactic").alias("tac"),
        F.count(F.when((F.col("dimension") == "indicator") & F.col("key").isNotNull(), 1)).alias("n_ind"),
        F.coalesce(F.sum(F.when(F.col("dimension") == "shown", F.col("v"))), F.lit(0)).alias("n_shown"),
        F.count(F.when(F.col("dimension") == "sev", 1)).alias("n_items"),
        F.count(F.when(F.col("dimension") == "camp", 1)).alias("n_camp"),
        *[F.count(F.when((F.col("dimension") == "sev") & (F.col("key") == k), 1)).alias(k) for k in SEVERITY_RANK],
    )
    ind = F.when(F.col("n_ind") > 0, F.col("n_ind")).otherwise(F.col("n_shown"))
    n_items = F.when(F.col("n_items") > 0, F.col("n_items").cast("string")).otherwise(F.lit(P.BRIEF_SCOPE[2]))
    plural = F.when(F.col("n_camp") == 1, F.lit("")).otherwise(F.lit("s"))

    def listed(wording: tuple, keys: Column) -> Column:
        return F.concat(F.lit(wording[1]), _fmt_list(keys, wording[2]), F.lit("."))

    bullets = [
        (P.BRIEF_SCOPE, F.concat(F.lit(P.BRIEF_SCOPE[1]), n_items, F.lit(P.BRIEF_SCOPE[3]))),
        (P.BRIEF_INCIDENTS, listed(P.BRIEF_INCIDENTS, F.col("inc"))),
        (P.BRIEF_SECTORS, listed(P.BRIEF_SECTORS, F.col("sec"))),
        (P.BRIEF_SIGNAL, F.lit(P.BRIEF_SIGNAL[1])),
        (P.BRIEF_SEVERITY, F.format_string(P.BRIEF_SEVERITY[1], *[F.col(k) for k in SEVERITY_RANK])),
        (P.BRIEF_INDICATORS, F.when(ind > 0, F.format_string(P.BRIEF_INDICATORS[1], ind)).otherwise(F.lit(P.BRIEF_INDICATORS[2]))),
        (P.BRIEF_CAMPAIGNS, F.when(F.col("n_camp") > 0, F.format_string(P.BRIEF_CAMPAIGNS[1], F.col("n_camp"), plural))
         .otherwise(F.lit(P.BRIEF_CAMPAIGNS[2]))),
        (P.BRIEF_TACTICS, F.when(F.size("tac") > 0, listed(P.BRIEF_TACTICS, F.col("tac"))).otherwise(F.lit(P.BRIEF_TACTICS[3]))),
        (P.BRIEF_ACTION, F.lit(P.BRIEF_ACTION[1])),
        (P.BRIEF_POSTURE, F.lit(P.BRIEF_POSTURE[1])),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(w[0]).alias("title"), d.alias("detail"))
                    for i, (w, d) in enumerate(bullets)])
    return row.select(F.inline(arr))


def severity_rank(label: Column) -> Column:
    expr = F.lit(0)
    for k, v in SEVERITY_RANK.items():
        expr = F.when(label == k, F.lit(v)).otherwise(expr)
    return expr


def sort_events(items: DataFrame, key: str = "confidence", direction: str = "desc") -> DataFrame:
    """Global order of the event list by any column (severity by rank, text case-insensitive)."""
    if key == "severity_label":
        k = severity_rank(F.col("severity_label"))
    elif key in ("confidence", "severity"):
        k = F.col(key).cast("double")
    else:
        k = F.lower(F.coalesce(F.col(key).cast("string"), F.lit("")))
    o = k.asc() if direction == "asc" else k.desc()
    return global_rank(items.withColumn("_k", k), [o, F.asc("event_id")], "rank").drop("_k")


def sort_iocs(iocs: DataFrame, key: str = "value", direction: str = "asc") -> DataFrame:
    """Global order of the IOC list; 'value' sorts by lower(normalized value, else value)."""
    if key == "value":
        k = F.lower(F.coalesce(F.when(F.col("normalized_value") != "", F.col("normalized_value")),
                               F.when(F.col("value") != "", F.col("value")), F.lit("")))
    elif key == "confidence":
        k = F.col("confidence").cast("double")
    else:
        k = F.lower(F.coalesce(F.col(key).cast("string"), F.lit("")))
    o = k.asc() if direction == "asc" else k.desc()
    return global_rank(iocs.withColumn("_k", k), [o, F.asc("source_event_id"), F.asc("ioc_type"), F.asc("value")],
                       "rank").drop("_k")
