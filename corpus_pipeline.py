"""The training-data pipeline: five stages over ``documents``, each the next one's input.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared checkpoint folder and reads back as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import line_dedup, mixing, near_dedup, packing, toxicity
from vigil.llm.queries import prepare, tokenizer_file
from vigil.session import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    prepare(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that stand in many documents; a null text stays null."""
    prepare(spark)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    row = F.col("row").withField("text", text).withField("n_chars", F.coalesce(F.length(text).cast("long"), F.col("row.n_chars")))
    return line_dedup.drop_lines(docs).select(row.alias("row")).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return near_dedup.near_dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    prepare(spark)
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix and their places in the sequences."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("source mix", mix_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


# The toxicity, similarity and packing decisions have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
