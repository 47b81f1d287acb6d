"""Stage tables derived from the driver tables (the test bindings).

``raw`` maps documents and pages onto the raw-event schema; the later views
push it through our own stages. Parameters used by the oracle queries are
fixed here so the Spark side and the SQL side agree.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigil.operators import classify, clusters, correlate, iocs, preprocess, score, serve
from vigil.session import arrow_rows, ensure_checkpoint_dir, materialize, scratch
from vigil.params import (INCIDENT_KEYWORDS, NOISE_PATTERNS, SECTOR_KEYWORDS, ClassifierParams,
                          CorrelationParams, IocParams, PreprocessParams, ScoringParams)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Test parameters: the reference keyword maps plus labels drawn from the
# driver's invented vocabulary, so that classification is not all "unknown".
TEST_NOISE_PATTERNS = tuple(NOISE_PATTERNS) + ("^the and attion", "nicht aulich", "^ietzte\\.$")
TEST_INCIDENT = {**INCIDENT_KEYWORDS, "chatter": ["the", "and", "tion"], "murmur": ["que", "les", "eau"]}
TEST_SECTOR = {**SECTOR_KEYWORDS, "klatsch": ["sch", "der", "und"], "charla": ["los", "del", "para"]}
TEST_PRE = PreprocessParams(noise_patterns=TEST_NOISE_PATTERNS)
TEST_INC = ClassifierParams(label_keywords=TEST_INCIDENT, min_confidence=0.6)
TEST_SEC = ClassifierParams(label_keywords=TEST_SECTOR, min_confidence=0.6)
# Cluster and window edges off: many campaigns instead of one.
TEST_COR = CorrelationParams(use_analysis_clusters=False, use_temporal_window=False)
# Clustering of the analysis stage: single words, the configured number of features, the automatic number of clusters.
TEST_FEATURES = 2000
BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
TEXT_ROWS = 1024  # texts that go to Python together
_RUNS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *spread_on: str) -> DataFrame:
    # all times are UTC: bucketing and rendering must not depend on the host zone
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, *spread_on) if spread_on else df


PER_SPLIT = 3  # dealt parts for each split of the scan


def spread(df: DataFrame, *on: str) -> DataFrame:
    """Raw text for CPU-bound cleaning, dealt out evenly by a hash of the columns ``on``.

    The number of splits of a scan says nothing about the work in them: a split holds the row groups that begin in it, and a file may be a single
    row group, whatever its size. Then one task would clean it all while the other splits are empty.
    """
    return df.repartition(PER_SPLIT * max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism), *on)


def raw_events(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """documents and pages as raw events (event_id, source, source_url, fetched_at, raw_text), ``dealt`` out for the work on their texts."""
    docs = read_table(spark, sf_dir, "documents", *(("doc_id", "text") if dealt else ())).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event_id"),
        F.col("source"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_url"),
        F.timestamp_seconds(F.lit(BASE_EPOCH) + (F.col("doc_id") % 240) * 3600).alias("fetched_at"),
        F.col("text").alias("raw_text"))
    pages = read_table(spark, sf_dir, "pages", *(("page_id", "html") if dealt else ())).select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("event_id"),
        F.lit("pages").alias("source"),
        F.col("url").alias("source_url"),
        F.timestamp_seconds(F.lit(BASE_EPOCH) + (F.col("page_id") % 240) * 3600).alias("fetched_at"),
        F.col("html").alias("raw_text"))
    return docs.unionByName(pages)


@dataclass
class Chain:
    """The stage tables of one run over the driver tables, each written once and counted as it is written.

    A stage is shared by every query whose parameters for that stage and the stages before it are the same, so a changed
    correlation setting doesn't clean and extract the corpus again. ``forget`` ends the sharing (changed input, end of a run).
    """

    spark: SparkSession
    sf_dir: str
    pre: PreprocessParams = TEST_PRE
    inc: ClassifierParams = TEST_INC
    sec: ClassifierParams = TEST_SEC
    cor_params: CorrelationParams = TEST_COR
    ioc_params: IocParams = IocParams()
    sco_params: ScoringParams = ScoringParams()
    with_clusters: bool = True

    def __post_init__(self) -> None:
        ensure_checkpoint_dir(self.spark)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, **params) -> "Chain":
        return cls(spark, sf_dir, **params)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _stage(self, name: str, params: tuple, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, repr(params))
        if key not in _RUNS:
            seen = Observation(f"{name}_{uuid.uuid4().hex[:8]}")
            with arrow_rows(self.spark, TEXT_ROWS):
                table = materialize(build().observe(seen, F.count(F.lit(1)).alias("n")), name)
            _RUNS[key] = table, int(seen.get["n"])
        return _RUNS[key][0]

    def count(self, name: str, params: tuple) -> int:
        return _RUNS[(self.spark.sparkContext.applicationId, self.sf_dir, name, repr(params))][1]

    @property
    def _ana_params(self) -> tuple:
        return self.pre, self.inc, self.sec, self.with_clusters

    @property
    def _cor_stage_params(self) -> tuple:
        return *self._ana_params, self.ioc_params, self.cor_params

    @property
    def _sco_stage_params(self) -> tuple:
        return *self._cor_stage_params, self.sco_params

    @property
    def raw(self) -> DataFrame:
        return raw_events(self.spark, self.sf_dir)

    @property
    def norm(self) -> DataFrame:
        # cleaning is the costly regex pass
        return self._stage("norm", (self.pre,), lambda: preprocess.normalize(self.raw, self.pre))

    @property
    def ioc(self) -> DataFrame:
        return self._stage("iocs", (self.pre, self.ioc_params), lambda: iocs.extract(self.norm, self.ioc_params))

    @property
    def clusters(self) -> DataFrame | None:
        """(event_id, cluster_id, cluster_confidence) by mini-batch k-means over the cleaned texts."""
        if not self.with_clusters:
            return None
        return self._stage("clusters", (self.pre,), lambda: clusters.kmeans_texts(self.norm, "event_id", "clean_text", TEST_FEATURES, ngram_max=1, stop_words=()))

    @property
    def ana(self) -> DataFrame:
        return self._stage("analysis", self._ana_params, lambda: classify.analyze(self.norm, self.inc, self.sec, self.clusters))

    @property
    def membership(self) -> DataFrame:
        return self._stage("membership", self._cor_stage_params,
                           lambda: correlate.campaign_membership(self.norm, self.ioc, self.ana, self.cor_params))

    @property
    def cor(self) -> DataFrame:
        return self._stage("correlation", self._cor_stage_params,
                           lambda: correlate.correlate(self.norm, self.ioc, self.ana, self.cor_params, self.membership))

    @property
    def camp(self) -> DataFrame:
        return self._stage("campaigns", self._cor_stage_params, lambda: correlate.campaigns(self.norm, self.cor, self.membership))

    @property
    def ioc_counts(self) -> DataFrame:
        return iocs.count_by_event(self.ioc)

    @property
    def sco(self) -> DataFrame:
        return self._stage("scores", self._sco_stage_params, lambda: score.score(self.ana, self.cor, self.ioc_counts, self.sco_params))

    @property
    def event_pages(self) -> str:
        """Folder of the event listing, clustered for paging."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "event_pages", repr(self._sco_stage_params))
        if key not in _RUNS:
            path = scratch(self.spark, "event_pages")
            serve.write_event_pages(path, serve.event_listing(self.sco, self.ana, self.norm, self.cor))
            _RUNS[key] = path
        return _RUNS[key]

    def counts(self) -> dict[str, int]:
        """Rows of each stage table, as counted while it was written; the input is counted from its files."""
        self.sco, self.camp
        return {"raw_events": raw_events(self.spark, self.sf_dir, dealt=False).count(), "normalized_events": self.count("norm", (self.pre,)), "iocs": self.count("iocs", (self.pre, self.ioc_params)),
                "analysis_results": self.count("analysis", self._ana_params), "correlation_results": self.count("correlation", self._cor_stage_params),
                "campaigns": self.count("campaigns", self._cor_stage_params), "scores": self.count("scores", self._sco_stage_params)}


def forget() -> None:
    """End the sharing of stage tables between queries."""
    _RUNS.clear()
