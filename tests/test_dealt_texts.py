"""Texts are dealt out by what they hold, and cleaning gives the same however it is written."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vigil.functions import ioc as I
from vigil.functions import text as T
from vigil.operators import clusters
from vigil.plans import views


def test_one_row_group_is_dealt_out(spark, tmp_path):
    rng = random.Random(3)
    rows = 400
    text = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz 0123456789", k=100_000)) for _ in range(rows)]
    ids = pa.array([None] * rows, pa.int64())  # a key may be null
    pq.write_table(pa.table({"doc_id": ids, "text": text}), tmp_path / "documents.parquet", row_group_size=rows)
    plain = views.read_table(spark, str(tmp_path), "documents")
    assert plain.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # splits enough, but one holds all rows
    assert sum(n > 0 for n in plain.select("doc_id").rdd.glom().map(len).collect()) == 1
    dealt = views.read_table(spark, str(tmp_path), "documents", "doc_id", "text").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in dealt) == rows
    assert max(r["count"] for r in dealt) <= rows // 4


def test_noise_lines_by_kind_of_pattern(spark):
    patterns = ["^share$", "^a|b$", "^x+$", "noise", "^nul"]
    blanks = [chr(i) for i in range(0x3002) if T.WS_CHARS.count(chr(i))]
    assert len(blanks) == 29
    texts = ["Share\nkeep share\r\n\r\n a noise \x0bnull snull\x85xx\x1cxxy", "", None, *[f"{b}k{b}{b}\n{b}\nshare{b}" for b in blanks]]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    stripped = F.transform(F.split("t", T.LINE_BREAK), T.py_strip)
    plainly = F.array_join(F.filter(stripped, lambda x: (x != "") & ~x.rlike(T.noise_regex(patterns))), "\n")
    got = d.select(T.remove_noise_lines(F.col("t"), patterns).alias("a"), plainly.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a == "keep share\nsnull\nxxy"


def test_markup_is_removed_once(spark):
    d = spark.createDataFrame([("<p>a &amp;lt; b</p>",), ("a &amp; b",), (None,)], "t string").select(T.strip_html(F.col("t")).alias("s"))
    assert [r.s for r in d.collect()] == [" a &lt; b ", "a &amp; b", None]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("script") <= 2  # one pattern names it twice


def test_hash_types_share_one_look(spark):
    d = spark.createDataFrame([("x " + "a" * 32 + " " + "b" * 40 + " " + "c" * 64 + " 1.2.3.4 v1.2",), ("1.2.3",), (None,)], "t string")
    found = d.select(I.extract_all(F.col("t")).alias("h"))
    got = [[(x.ioc_type, x.value) for x in r.h] if r.h is not None else None for r in found.collect()]
    assert got[0] == [("ipv4", "1.2.3.4"), ("md5", "a" * 32), ("sha1", "b" * 40), ("sha256", "c" * 64)] and got[1] == [] and got[2] is None
    assert len(re.findall(r"RLIKE\([^,]*, \[a-fA-F0-9]\{32}\)", found._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_distances_and_their_sums():
    at, w = pa.array([[0, 2], [], [1]], pa.list_(pa.int32())), pa.array([[0.6, 0.8], [], [1.0]])
    centres = np.array([[1.0, 0.0, 0.0], [0.0, 0.5, 0.5]])
    got = clusters._distances(at, w, centres, (centres ** 2).sum(1))
    x = np.array([[0.6, 0, 0.8], [0, 0, 0], [0, 1.0, 0]])
    assert np.allclose(got, np.sqrt(((x[:, None] - centres) ** 2).sum(2)))
