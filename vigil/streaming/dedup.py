"""Streaming first-seen filter: one event per content hash, across micro-batches and restarts.

The stream's keyed state holds, per hash, only the place of the first event in source order (about 80 bytes); texts never
enter it, nor any shuffle. A batch reduces its rows to (hash, place, file), combined in each Arrow batch before the shuffle, so copies
that make up a third of a batch do not meet in one task; the state tells which of them are new or earlier than what was seen; and
the batch's own files are read once more for just these rows, which are written out. No batch reads a ledger. A repeated batch replaces
what it wrote. ``first_events`` reads the result.

Hashes are told apart by their first 128 bits. Places are compared as the order columns are: nulls first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType, IntegralType, StringType, StructType, TimestampType

from vigil.operators import ingest as G

SEP = "\x01"
KEY_HEX = 32  # hex digits of the hash that name it in the state


def place(columns: list[tuple[str, DataType]]) -> Column:
    """The order columns as one string whose byte order is theirs."""
    parts = []
    for name, kind in columns:
        c = F.col(name)
        if isinstance(kind, (IntegralType, TimestampType)):
            number = F.unix_micros(c) if isinstance(kind, TimestampType) else c.cast("long")
            value = F.lpad(F.hex(number.bitwiseXOR(F.lit(-2 ** 63))), 16, "0")
        elif isinstance(kind, StringType):
            value = F.concat(F.regexp_replace(c, "[\x01\x02]", "\x02$0"), F.lit("\x00"))
        else:
            raise ValueError(f"cannot order by {name}: {kind.simpleString()}")
        parts.append(F.coalesce(F.concat(F.lit("1"), value), F.lit("0")))
    return F.concat(*parts)


def _earliest_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by("key").aggregate([("at", "min")]).select(["key", "at_min"]).rename_columns(["key", "at"])
            yield from t.combine_chunks().to_batches()


def _first_seen(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits the key with its earliest place and file if no earlier place was seen."""
    at, _, file = min(r["at"].min() for r in rows).rpartition(SEP)
    if not state.exists or at < state.get[0]:
        state.update((at,))
        yield pd.DataFrame({"key": [key[0]], "at": [at], "file": [file]})


def run_dedup_stream(spark: SparkSession, source_dir: str, schema: StructType | str, out_dir: str, checkpoint_dir: str, order_cols: list[str],
                     files_per_batch: int | None = None) -> None:
    """Process every landed file in ``source_dir`` that is new (availableNow) and stop."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at = place([(c, schema[c].dataType) for c in order_cols])
    key = F.substring("content_hash", 1, KEY_HEX)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    narrow = G.with_hash(reader.parquet(source_dir).select("*", F.col("_metadata.file_path").alias("_file"))) \
        .select(F.unhex(key).alias("key"), F.concat(at, F.lit(SEP), F.col("_file")).alias("at"))
    first = narrow.mapInArrow(_earliest_of_batch, "key binary, at string").groupBy("key").applyInPandasWithState(
        _first_seen, "key binary, at string, file string", "at string", "append", GroupStateTimeout.NoTimeout)

    def batch(new: DataFrame, batch_id: int) -> None:
        new = new.persist()
        files = [r["file"] for r in new.select("file").distinct().collect()]  # of this batch
        if files:
            rows = G.with_hash(spark.read.schema(schema).parquet(*files)).withColumns({"_key": F.unhex(key), "_at": at})
            kept = rows.join(new.select(F.col("key").alias("_key"), F.col("at").alias("_at")), ["_key", "_at"], "left_semi").drop("_key", "_at")
            G.dedup_in_run_grouped(kept, order_cols).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        new.unpersist()

    q = first.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()


def first_events(spark: SparkSession, out_dir: str, order_cols: list[str]) -> DataFrame:
    """The first event of each content hash over all batches."""
    return G.dedup_in_run_grouped(spark.read.parquet(out_dir).drop("batch"), order_cols)
