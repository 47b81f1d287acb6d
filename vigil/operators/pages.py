"""Listings served from tables that are clustered on their sort key, with an index of their files.

A listing is written once per run, sorted by range; the index has, for each file and each combination of the filter columns, the number of rows. A page
is found by a running sum over the index (a row per file and combination) and read from the one or few files that hold it, so page
p costs the same wherever it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_A_FILE = 100_000


def write_clustered(df: DataFrame, order: list[Column], path: str, filters: list[str] = (), rows_a_file: int = ROWS_A_FILE) -> None:
    """Write ``df`` to ``path`` in the order of ``order``, with its index."""
    spark = df.sparkSession
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/rows")
    # part-00012-<uuid>-c003...: range partition and file of it, in key order
    name = F.col("_metadata.file_name")
    seq = F.struct(F.regexp_extract(name, r"^part-(\d+)-", 1).cast("long").alias("part"), F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long").alias("nth"))
    rows = spark.read.parquet(f"{path}/rows").select(*filters, name.alias("file"), seq.alias("seq"))
    rows.groupBy("file", "seq", *filters).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, order: list[Column], limit: int, offset: int = 0, **filters: str | None) -> DataFrame:
    """Rows offset .. offset + limit of those with the given values, in order."""
    wanted = [F.col(c) == v for c, v in filters.items() if v]
    index = spark.read.parquet(f"{path}/index")
    for w in wanted:
        index = index.filter(w)
    upto = F.sum("n").over(Window.orderBy("seq"))
    files = index.groupBy("file", "seq").agg(F.sum("n").alias("n")).withColumn("before", upto - F.col("n"))
    hit = files.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).select("file", "before").orderBy("before").collect()  # at most limit files
    if not hit:
        return spark.read.parquet(f"{path}/rows").limit(0)
    rows = spark.read.parquet(*[f"{path}/rows/{r['file']}" for r in hit])
    for w in wanted:
        rows = rows.filter(w)
    return rows.orderBy(*order).offset(offset - hit[0]["before"]).limit(limit)
