"""The whole chain as one job: raw -> norm -> iocs -> analysis -> correlation -> scores -> report items,
with each stage table counted by ``observe`` while it is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vigil.operators import report as R
from vigil.plans.views import Chain


@dataclass
class RunOutput:
    scores: DataFrame
    items: DataFrame
    counts: dict


def run_pipeline(spark: SparkSession, sf_dir: str, **params) -> RunOutput:
    c = Chain.of(spark, sf_dir, **params)
    counts = c.counts()
    return RunOutput(c.sco, R.items(c.ana, c.sco, c.cor, c.ioc), counts)
