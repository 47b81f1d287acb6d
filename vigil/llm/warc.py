"""WARC files and a Merkle audit of their replicas.

Pages become WARC records, each a gzip member of its own whose header tells its length (so records are found without
inflating), in files of about ``FILE_BYTES``; each file starts with a warcinfo member that names it. Files are written where
the pages are read, without a shuffle.

A replica's leaves hash the stored bytes of its records and are keyed by (file, offset). Inner nodes hash what starts in an offset range of the
file, ``RANGES`` from narrow to wide, in offset order; a file's root covers all of it, and ``FANOUT`` files in order make a
node, and so on up to one root. Two replicas are compared from the top: only what lies under nodes that
differ is looked at on the next level, down to the records. A damaged member header hides one record; the next member is found by
its signature, at the same offset as in the other replica.

Scale: a task holds one file; a node has at most the records that start within 64 KB, or 16 children; a level is a
16th of the one below; the descent joins only differing branches.

Cases: null urls and pages are empty strings; rows that repeat are records of their own; a null page_id is written as an empty id; an empty
table makes no file and an empty result; other columns are ignored. A file that only one
replica has, or whose name is damaged, differs in all its records; records that only one replica has are reported too, whichever
it is. A file without a readable name goes by its path's last part, or by the name of the other replica's file
that has no counterpart either and shares the most records with it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.arrow import batch
from vigil.session import ensure_checkpoint_dir, materialize

FILE_BYTES = 8 * 2 ** 20
RANGES = (2 ** 16, 2 ** 20, 2 ** 24, 2 ** 62)  # bytes of an offset range on each level; the last covers any file
FANOUT = 16
_MEMBER = struct.Struct("<4sIBBH2sHII")  # gzip header with an extra field: bytes of the member, bytes of the record
_SIGNATURE = b"\x1f\x8b\x08\x04"
_NAME = re.compile(rb"WARC/1\.1\r\nWARC-Type: warcinfo\r\nWARC-Filename: (\d{8}-\d{8})\.warc\.gz\r\n")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d*)>\r\n")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One page as a WARC resource record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", ""),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _write_files(files: DataFrame, path: str) -> None:
    """One file per row; the text writer's line end follows each."""
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def member(data: bytes) -> bytes:
    """A gzip member whose extra field tells its own length and that of its content."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(_SIGNATURE, 0, 0, 255, 12, b"SL", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def members(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of the members of a file; after a damaged header, of the next ones that can be told."""
    at, end = 0, len(data) - 1  # the writer's line end
    while at + _MEMBER.size <= end:
        signature, _, _, _, n_extra, field, n_field, size, _ = _MEMBER.unpack_from(data, at)
        if (signature, n_extra, field, n_field) == (_SIGNATURE, 12, b"SL", 8) and _MEMBER.size < size <= end - at:
            yield at, size
            at += size
        else:
            at = data.find(_SIGNATURE, at + 1)
            if at < 0:
                return


def content(stored: bytes) -> bytes | None:
    """A member's record, or nothing if its bytes are damaged."""
    try:
        return zlib.decompress(stored, 31)
    except zlib.error:
        return None


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    def run(batches):
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def cut():
            info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Filename: %08d-%08d.warc.gz\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (part, n)
            return pa.RecordBatch.from_arrays([pa.array([member(info) + b"".join(held)], pa.binary())], names=["file"])

        for b in batches:
            for r in b.column(0).to_pylist():
                held.append(member(r))
                size += len(held[-1])
                if size >= file_bytes:
                    yield cut()
                    n, held, size = n + 1, [], 0
        if held:
            yield cut()

    _write_files(pages.select(record(F.col("page_id"), F.col("url"), F.col("html")).cast("binary").alias("record")).mapInArrow(run, "file binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content", "path")


def file_name(data: bytes) -> str | None:
    at, size = next(members(data), (0, 0))
    m = _NAME.match(content(data[at:at + size]) or b"") if size and not at else None
    return m[1].decode() if m else None


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, named, offset, length, hash, page_id, record_bytes, record_sha256) per member; offset 0 is the warcinfo record.

    The last three are null where a record can't be read; a file without a readable name is not ``named`` and goes by its path's last part.
    """
    schema = pa.schema([("file", pa.string()), ("named", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64()), ("hash", pa.binary()), ("page_id", pa.int64()),
                        ("record_bytes", pa.int64()), ("record_sha256", pa.string())])

    def run(batches):
        for b in batches:
            for x, path in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = x.as_py()
                name = file_name(data)
                out = {f.name: [] for f in schema}
                for at, size in members(data):
                    stored = data[at:at + size]
                    r = content(stored)
                    found = _ID.search(r[:r.find(b"\r\n\r\n") + 2]) if r is not None else None
                    for key, value in (("file", name or path.rsplit("/", 1)[-1]), ("named", name is not None), ("offset", at), ("length", size), ("hash", hashlib.sha256(stored).digest()),
                                       ("page_id", int(found[1]) if found and found[1] else None), ("record_bytes", None if r is None else len(r)),
                                       ("record_sha256", None if r is None else hashlib.sha256(r).hexdigest())):
                        out[key].append(value)
                yield batch(schema, **out)

    return _files(spark, path).mapInArrow(run, "file string, named boolean, offset long, length long, hash binary, page_id long, record_bytes long, record_sha256 string")


def _fold(nodes: DataFrame, keys: list[str], number: str, width: int) -> DataFrame:
    """The next level: the nodes whose numbers lie in one range of ``width``, hashed in order with their numbers."""
    parent = F.floor(F.col(number) / width).alias(number)
    children = F.transform(F.array_sort(F.collect_list(F.struct(number, "hash"))), lambda x: F.concat(x[number].cast("string").cast("binary"), F.lit(b":"), x["hash"]))
    digest = F.unhex(F.sha2(F.aggregate(children, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)), 256))
    return nodes.groupBy(*keys, parent).agg(digest.alias("hash"))


def file_tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of (file, offset, hash), from the records to whole files; offset is the number of a range on its level."""
    levels, narrow = [leaves.select("file", "offset", "hash")], 1
    for wide in RANGES:
        levels.append(materialize(_fold(levels[-1], ["file"], "offset", wide // narrow), "warc_level"))
        narrow = wide
    return levels


def top_tree(files: DataFrame, numbers: DataFrame, n_files: int) -> list[DataFrame]:
    """Levels of (number, hash), from the files to one root over all."""
    levels = [materialize(files.join(numbers, "file").select("number", "hash"), "warc_files")]
    width = 1
    while width < n_files:
        levels.append(materialize(_fold(levels[-1], [], "number", FANOUT), "warc_level"))
        width *= FANOUT
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str], under: DataFrame | None = None, parents: dict[str, Column] | None = None) -> DataFrame:
    """Keys of either side whose hash is not that of the other, of those whose parent is in ``under``."""
    if under is not None:
        up = {f"up_{k}": c for k, c in parents.items()}
        under = under.select(*[F.col(k).alias(f"up_{k}") for k in parents])
        a, b = (x.withColumns(up).join(under, list(up), "left_semi") for x in (a, b))
    both = a.select(*keys, F.col("hash").alias("a_hash")).join(b.select(*keys, F.col("hash").alias("b_hash")), keys, "full")
    return materialize(both.filter(~F.col("a_hash").eqNullSafe(F.col("b_hash"))).select(*keys), "warc_differ")


def _counterparts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, name): files that only one replica has, one of them without a readable name, and that are each other's best match by equal records."""
    a, b = (x.join(y.select("file").distinct(), "file", "left_anti").filter("offset > 0").select(F.struct("file", "named").alias(side), "offset", "hash")
            for x, y, side in ((ours, theirs, "a"), (theirs, ours, "b")))
    pairs = a.join(b, ["offset", "hash"]).filter(~F.col("a.named") | ~F.col("b.named")).groupBy("a", "b").count()

    def first(x: str, y: str) -> Column:
        return F.row_number().over(Window.partitionBy(f"{x}.file").orderBy(F.desc("count"), f"{y}.file")) == 1

    best = pairs.withColumns({"of_a": first("a", "b"), "of_b": first("b", "a")}).filter("of_a AND of_b")
    name = F.when(F.col("b.named"), F.col("b.file")).otherwise(F.col("a.file")).alias("name")
    return materialize(best.select(F.explode(F.array("a.file", "b.file")).alias("file"), name), "warc_names")


def audit(spark: SparkSession, path: str, replica: str) -> DataFrame:
    """The index of the files at ``path`` with ``corrupt``: the replica has other bytes, or none, for that record.

    Records that only the replica has follow, as the replica has them; they are corrupt.
    """
    ours, theirs = (materialize(index(spark, p), "warc_index") for p in (path, replica))
    names = ours.select("file", "named").union(theirs.select("file", "named")).groupBy("file").agg(F.bool_and("named").alias("named"))
    numbers = materialize(names.select("file", "named", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("number")), "warc_numbers")  # a row per file
    n_files, n_nameless = numbers.agg(F.count(F.lit(1)), F.count_if(~F.col("named"))).first()
    numbers = numbers.drop("named")
    low_a, low_b = file_tree(ours), file_tree(theirs)
    high_a, high_b = top_tree(low_a[-1], numbers, n_files), top_tree(low_b[-1], numbers, n_files)
    wrong = _differing(high_a[-1], high_b[-1], ["number"])
    for a, b in zip(high_a[-2::-1], high_b[-2::-1], strict=True):
        wrong = _differing(a, b, ["number"], wrong, {"number": F.floor(F.col("number") / FANOUT)})
    wrong = wrong.join(numbers, "number").select("file", F.lit(0).cast("long").alias("offset"))
    below = dict(zip(range(len(RANGES) + 1), (1, *RANGES), strict=True))
    for k in range(len(RANGES) - 1, -1, -1):
        width = below[k + 1] // below[k]
        wrong = _differing(low_a[k], low_b[k], ["file", "offset"], wrong, {"file": F.col("file"), "offset": F.floor(F.col("offset") / width)})
    if n_nameless:
        same = _counterparts(ours, theirs)
        ours, theirs, wrong = (x.join(same, "file", "left").withColumn("file", F.coalesce("name", "file")).drop("name") for x in (ours, theirs, wrong))
    found = wrong.distinct().withColumn("corrupt", F.lit(True))
    present = ours.join(found, ["file", "offset"], "left").withColumn("corrupt", F.coalesce("corrupt", F.lit(False)))
    absent = theirs.join(found, ["file", "offset"]).join(ours.select("file", "offset"), ["file", "offset"], "left_anti")
    return present.unionByName(absent).drop("named")


def copy_damaged(spark: SparkSession, path: str, replica: str) -> None:
    """A replica with a known fault: in records whose id's md5 starts with 0, one bit in the middle of the stored bytes is flipped."""
    def run(batches):
        for b in batches:
            for x in b.column(0):
                data = bytearray(x.as_py()[:-1])
                for at, size in list(members(bytes(data) + b"\n"))[1:]:
                    page = _ID.search(content(bytes(data[at:at + size])))[1]
                    if hashlib.md5(page).hexdigest()[0] == "0":
                        data[at + size // 2] ^= 1
                yield pa.RecordBatch.from_arrays([pa.array([bytes(data)], pa.binary())], names=["file"])

    _write_files(_files(spark, path).mapInArrow(run, "file binary"), replica)


def audit_pages(pages: DataFrame) -> DataFrame:
    """(page_id, record_bytes, record_sha256, corrupt) per page: its record in WARC files, audited against a damaged replica."""
    spark = pages.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    write_warc(pages, f"{root}/primary")
    copy_damaged(spark, f"{root}/primary", f"{root}/replica")
    return audit(spark, f"{root}/primary", f"{root}/replica").filter("offset > 0").select("page_id", "record_bytes", "record_sha256", "corrupt")


ORACLE = r"""
WITH r AS (
  SELECT page_id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages)
SELECT page_id, strlen(rec)::BIGINT AS record_bytes, sha256(rec) AS record_sha256,
       substr(md5(coalesce(page_id::VARCHAR, '')), 1, 1) = '0' AS corrupt
FROM r
"""
