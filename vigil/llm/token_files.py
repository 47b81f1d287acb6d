"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file is one shard: a header, the document ids and the document boundaries as two Elias-Fano sequences, and the ids
of all its documents in 16 or 32 bits. Shards are written in ascending doc_id order: texts are range-partitioned by doc_id,
sorted, encoded in that order, and cut into shards of about ``shard_bytes``. Spark's text writer puts one shard
in one file (so any store that Spark reaches will do, and its committer handles lost tasks); the byte after a shard is
that writer's line end. Files are read back with Spark's binaryFile source.

Offsets come from select: the read takes ``BATCH`` document numbers at a time and selects their ids and boundaries from the
blocks that hold them, so no table of a shard's offsets is made. A document's start among all documents adds the sizes of
the shards before it, a sum over one row per shard.

Null texts are empty (the end id alone); null doc_ids come first; repeated doc_ids are documents of their own, in the
order of their texts' hashes; an
empty table gives no document; other columns are ignored. A document larger than a shard gets a shard of its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm import elias_fano
from vigil.llm.arrow import batch, slices
from vigil.llm.tokens import encoder
from vigil.llm.worker import keep
from vigil.session import ensure_checkpoint_dir, materialize

END_ID = 0
SHARD_BYTES = 8 * 2 ** 20  # of ids; with executors of more than 3 GB, 64 MB make fewer files
_HEAD = struct.Struct(">8sIIQQQB")  # magic, part, shard of the part, documents, null doc_ids, ids, bytes an id
_FIELDS = {"part": (9, 4), "shard": (13, 4), "n_ids": (33, 8)}  # first byte and length in the header, for SQL
_MAGIC = b"EFTOKEN1"
BATCH = 4096  # documents of a shard read at a time


def encode_shard(part: int, shard: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    sizes = np.array([len(x) for x in ids], np.int64)
    joined = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    width = 2 if not len(joined) or int(joined.max()) < 2 ** 16 else 4
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    return (_HEAD.pack(_MAGIC, part, shard, len(doc_ids), len(doc_ids) - len(known), len(joined), width) + elias_fano.encode(known)
            + elias_fano.encode(np.concatenate(([0], np.cumsum(sizes)))) + joined.astype(f"<u{width}").tobytes())


class Shard:
    """Reads one shard: ``doc(i)`` by two selects, ``documents()`` all of them in order."""

    def __init__(self, data: bytes):
        magic, self.part, self.shard, self.n_docs, self.n_null, self.n_ids, self.width = _HEAD.unpack_from(data, 0)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        self.doc_ids = elias_fano.Sequence(data, _HEAD.size)
        self.bounds = elias_fano.Sequence(data, self.doc_ids.end)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, self.bounds.end)

    def docs(self, first: int, end: int) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents first..end and their boundaries, one more than documents, by select."""
        nulls = max(0, min(end, self.n_null) - first)
        known = self.doc_ids.select_many(np.arange(first + nulls, end) - self.n_null)
        return [None] * nulls + known.tolist(), self.bounds.select_many(np.arange(first, end + 1))

    def doc(self, i: int) -> tuple[int | None, np.ndarray]:
        (doc_id,), (a, z) = self.docs(i, i + 1)
        return doc_id, self.ids[a:z]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for k in range(0, self.n_docs, BATCH):
            doc_ids, bounds = self.docs(k, min(k + BATCH, self.n_docs))
            for doc_id, a, z in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield doc_id, a, self.ids[a:z]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    def run(batches):
        part, shard, doc_ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for b in slices(batches, 4096):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.ids(texts), strict=True):
                doc_ids.append(doc_id)
                parts.append(np.concatenate((ids, end)))
                size += 2 * len(parts[-1])
                if size >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_shard(part, shard, doc_ids, parts)], pa.binary())], names=["shard"])
                    shard, doc_ids, parts, size = shard + 1, [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([encode_shard(part, shard, doc_ids, parts)], pa.binary())], names=["shard"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))  # rows of one doc_id have an order, and may stand in several ranges
    shards = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie").mapInArrow(run, "shard binary")
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document of the files at ``path``."""
    rows = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()),
                      ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def documents(batches):
        keep("token files", dict)  # frees an encoder that this worker has had
        for b in batches:
            for x in b.column(0):
                s = Shard(x.as_buffer())
                for k in range(0, s.n_docs, BATCH):
                    doc_ids, bounds = s.docs(k, min(k + BATCH, s.n_docs))
                    raw = memoryview(s.ids[bounds[0]:bounds[-1]].astype("<u4")).cast("B")
                    at = (4 * (bounds - bounds[0])).tolist()
                    parts = [raw[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
                    yield batch(rows, part=np.full(len(doc_ids), s.part), shard=np.full(len(doc_ids), s.shard), doc_id=doc_ids, local=bounds[:-1],
                                n_tokens=np.diff(bounds), ids_crc32=[zlib.crc32(p) for p in parts], ids=[bytes(p) if with_ids else None for p in parts])

    shards = _shards(spark, path)
    order = Window.orderBy("part", "shard")  # one row per shard
    heads = shards.select(*[F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long").alias(name) for name, (at, n) in _FIELDS.items()])
    starts = materialize(heads.select("part", "shard", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("before")), "token_shards")
    docs = shards.mapInArrow(documents, "part long, shard long, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
                                                       *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the files into the shared checkpoint folder and reads them back."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex[:12]}"
    write_token_files(docs, path, tokenizer_path, end_id, shard_bytes)
    return read_token_files(docs.sparkSession, path)
