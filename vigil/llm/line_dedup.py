"""Line deduplication: lines found in many documents go, in every document.

Lines become 128-bit key hashes, range-partitioned by (hash, document) and sorted by hash, document and position.
A task streams its sorted rows: it holds the rows of a hash until ``min_docs`` documents have been seen and passes
all later rows on at once, so a line that stands in a third of all documents is never held. Such a hash may
span several ranges; a document's rows of one hash never do. Only the first and last hash of a range can go on elsewhere, so
their document counts (two rows a range) are summed and settle the rows still held. The result is one compressed
keep bitmap per document that loses lines, not text; ``drop_lines`` joins the bitmaps to the documents.

A document is told by (doc_id, hash of its text): rows that repeat both count once and lose the same lines; rows
with one doc_id and different texts are different documents. Null doc_ids are a value like others. A null or empty text
is one empty line; keys shorter than ``min_chars`` code points are kept. Extra columns are carried, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.arrow import batch
from vigil.llm.text import ascii_lower, strip_space
from vigil.session import materialize

MIN_DOCS = 10
MIN_CHARS = 1

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32())])
_OUT = pa.schema([("kind", pa.int32()), *_LINES, ("n_docs", pa.int64())])
_DROPPED, _HELD, _COUNT = 0, 1, 2


def _did() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63))


def _tag() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull())


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, did, tag, pos) per line whose key has at least ``min_chars`` code points."""
    lines = docs.select(_did().alias("did"), _tag().alias("tag"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("did", "tag", "pos", ascii_lower(strip_space(F.col("line"))).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), "did", "tag", "pos")


def _stream(batches, min_docs: int):
    """Over rows sorted by hash, document and position: dropped rows, and what the neighbouring ranges may settle."""
    key, docs_seen, last_doc, held, first = None, 0, None, [], True

    def out(kind, cols, n_docs=0):
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(c, f.type) for c, f in zip(cols, _LINES, strict=True)],
                                           pa.array(np.full(n, n_docs, np.int64))], schema=_OUT)

    def close():
        """The hash ``key`` ends here; an edge of the range tells its count and the rows it still holds."""
        rows = [out(_COUNT, [np.array([x]) for x in (*key, 0, 0, 0)], docs_seen)]
        if held:
            rows.append(out(_HELD, [np.concatenate(c) for c in zip(*held, strict=True)]))
        return rows

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        h1, h2, did, tag, _ = cols
        n = len(h1)
        if not n:
            continue
        new_hash = np.ones(n, bool)
        new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_hash.copy()
        new_doc[1:] |= (did[1:] != did[:-1]) | (tag[1:] != tag[:-1])
        starts = np.flatnonzero(new_hash)
        ends = np.append(starts[1:], n)
        counts = np.add.reduceat(new_doc.astype(np.int64), starts)
        inner = np.zeros(n, bool)
        for g in dict.fromkeys((0, len(starts) - 1)):
            a, z = starts[g], ends[g]
            here, doc = (h1[a], h2[a]), (did[a], tag[a])
            if g:  # all hashes strictly between the first and the last of the batch are whole
                whole = np.flatnonzero(counts[1:-1] >= min_docs) + 1
                for w in whole:
                    inner[starts[w]:ends[w]] = True
                if inner.any():
                    yield out(_DROPPED, [c[inner] for c in cols])
            if here != key:
                if key is not None:
                    if first:
                        yield from close()
                    first = False
                key, docs_seen, last_doc, held = here, 0, None, []
            docs_seen += int(counts[g]) - (doc == last_doc)
            last_doc = (did[z - 1], tag[z - 1])
            held.append([c[a:z] for c in cols])
            if docs_seen >= min_docs:
                yield out(_DROPPED, [np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
    if key is not None:
        yield from close()


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, tag, n_dropped, keep): zlib-compressed bits, most significant first, 0 for a line that goes.

    Lines past the last bit stay. Documents that lose nothing have no row.
    """
    order = ["h1", "h2", "did", "tag"]
    # written first: Spark reads the rows twice, once for the ranges' bounds, and these are far narrower than the texts
    ranged = materialize(line_keys(docs, min_chars), "line_keys").repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    streamed = materialize(ranged.mapInArrow(lambda it: _stream(it, min_docs), "kind int, h1 long, h2 long, did long, tag long, pos int, n_docs long"), "line_stream")
    shared = streamed.filter(F.col("kind") == _COUNT).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= min_docs)
    settled = streamed.filter(F.col("kind") == _HELD).join(shared, ["h1", "h2"], "left_semi").select("did", "tag", "pos")
    dropped = streamed.filter(F.col("kind") == _DROPPED).select("did", "tag", "pos").unionByName(settled)
    per_doc = dropped.groupBy("did", "tag").agg(F.collect_set("pos").alias("drop"))  # at most a document's own lines

    def pack(batches):
        schema = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
        for b in batches:
            keep = []
            for d in b.column(2):
                pos = d.values.to_numpy(zero_copy_only=False)
                bits = np.ones(-(-(int(pos.max()) + 1) // 8) * 8, np.uint8)
                bits[pos] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield batch(schema, did=b.column(0), tag=b.column(1), n_dropped=[len(d) for d in b.column(2)], keep=keep)

    return per_doc.mapInArrow(pack, "did long, tag long, n_dropped long, keep binary")


def unpack_keep(keep: bytes, n_lines: int) -> np.ndarray:
    """The keep bits of ``n_lines`` lines."""
    bits = np.ones(n_lines, bool)
    got = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines]
    bits[:len(got)] = got
    return bits


def _without(text: str, keep: bytes) -> str:
    lines = text.split("\n")
    return "\n".join([x for x, k in zip(lines, unpack_keep(keep, len(lines)), strict=True) if k])


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, n_lines, n_dropped, kept): the caller's row as a struct and its text without the dropped lines."""
    maps = keep_bitmaps(docs, min_docs, min_chars)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("body"),
                    _did().alias("did"), _tag().alias("tag"))
    joined = d.join(maps, ["did", "tag"], "left")

    @F.arrow_udf("string")
    def apply_bits(body: pa.Array, keep: pa.Array) -> pa.Array:
        return pa.array([None if k is None else _without(t, k) for t, k in zip(body.to_pylist(), keep.to_pylist(), strict=True)], pa.string())

    # only texts that lose lines go to Python; the rest of the row stays where it is
    kept = F.coalesce(apply_bits(F.when(F.col("keep").isNotNull(), F.col("body")), F.col("keep")), F.col("body"))
    return joined.select("row", F.size(F.split("body", "\n", -1)).cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_digest(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    return drop_lines(docs, min_docs, min_chars).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls[i] AS line, i,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
bad AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, bad.key IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.key = bad.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
