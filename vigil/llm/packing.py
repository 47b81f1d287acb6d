"""Best-fit packing planned over the histogram of piece lengths.

1. One pass over the texts makes pieces: token ids plus an end id, cut at ``capacity`` only where a document is longer. A task
   numbers its pieces of each length; the table is written once, so the numbers hold whatever is retried later.
2. The histogram has at most ``capacity`` rows. Best-fit decreasing runs over its counts, not over documents: all pieces
   of one length that go to sequences with the same free space are placed in one step, as a run of ranks and a run of
   sequence numbers. The plan's size depends on the lengths, not on the number of documents.
3. A piece's rank within its length is its task's offset plus its number in the task; it takes its slot by joining the plan on
   length and rank. No length is ever gathered, so one length may hold a third of all pieces.

Null texts are empty documents (the end id alone); repeated rows are packed each for itself; an empty table gives an empty result;
other columns are ignored, whatever their names. The plan is broadcast only while it has at most ``MAX_BROADCAST_STEPS`` steps.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.arrow import slices
from vigil.llm.tokens import encoder
from vigil.session import arrow_rows, materialize

CAPACITY = 2048
END_ID = 0
MAX_BROADCAST_STEPS = 200_000
BATCH_ROWS = 2048  # texts that a worker has in memory at a time

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def plan_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: steps (length, first rank, end rank, first sequence, offset in the sequence)."""
    open_runs: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, count)
    spaces: list[int] = []  # the free spaces that have runs, in order
    steps, n_sequences = [], 0

    def give(space: int, run: tuple[int, int]) -> None:
        if space <= 0:
            return
        if space not in open_runs:
            open_runs[space] = []
            insort(spaces, space)
        open_runs[space].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = open_runs[space].pop()
                take = min(n, left)
                if take < n:
                    open_runs[space].append((first + take, n - take))
                elif not open_runs[space]:
                    del open_runs[space], spaces[k]
                steps.append((length, rank, rank + take, first, capacity - space))
                give(space - length, (first, take))
            else:
                # new sequences take as many of this length as fit, one layer at a time
                per = capacity // length
                take = -(-left // per)
                first, n_sequences = n_sequences, n_sequences + take
                steps.append((length, rank, rank + take, first, 0))
                give(capacity - length, (first, take))
            rank, left = rank + take, left - take
    return steps


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece, numbered per length within its task; ``ids`` (little-endian unsigned 32 bit) only on demand."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for b in slices(batches, BATCH_ROWS):
            rows = {f.name: [] for f in _PIECES}
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.ids(texts), strict=True):
                ids = np.concatenate((ids, end))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    raw = ids[start:start + capacity].tobytes()
                    n = len(raw) // 4
                    for name, value in (("doc_id", doc_id), ("piece", piece), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(raw)),
                                        ("task", task), ("nth", int(seen[n])), ("ids", raw if with_ids else None)):
                        rows[name].append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_pydict(rows, schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        p = materialize(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pack_pieces")
    by_task = p.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    steps = plan_histogram(histogram, capacity)
    plan = spark.createDataFrame(pa.table(dict(zip(("p_length", "from_rank", "to_rank", "first_sequence", "offset"),
                                                   np.array(steps, np.int64).reshape(-1, 5).T, strict=True))))
    if len(steps) <= MAX_BROADCAST_STEPS:
        plan = F.broadcast(plan)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    offsets = by_task.select("task", "length", before.alias("before"))
    ranked = p.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    slots = ranked.join(plan, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return slots.select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids) from ``pack_documents(..., with_ids=True)``: at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda x: x["ids"]), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
