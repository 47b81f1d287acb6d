"""Links between sets that share at least k values, without a table of pairs.

Values are numbered from rare to common and every set is its sorted array of numbers; equal sets are one class. Two sets that share k values share
their first common one among the n - k + 1 rarest of each, so sets meet in blocks keyed by one such value. A block of at most ``BLOCK`` sets
is compared in its task and sends a spanning forest of its links. A larger block is split by the next value that could be shared, and so on; a block
keyed by k values needs no comparison at all, all of its sets hang on its smallest. So a value, or a combination of fewer than k, that
most sets hold costs rows in proportion to its sets, never to their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.graph import global_rank
from vigil.session import materialize

BLOCK = 64  # sets compared with each other in one task


def value_sets(index: DataFrame, member: str, value: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(sets: set_id, numbers; membership: member, set_id) for the members with k or more values that others have too."""
    counts = index.groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    numbers = global_rank(counts, [F.col("n"), F.col(value)], "number").select(value, "number")
    rows = index.join(numbers, value).groupBy(member).agg(F.array_sort(F.collect_list("number")).alias("numbers")).filter(F.size("numbers") >= k)
    rows = materialize(rows, "value_sets")
    sets = materialize(rows.groupBy("numbers").agg(F.min(F.col(member).cast("string")).alias("first")).withColumn("set_id", F.monotonically_increasing_id()), "distinct_sets")
    return sets.select("set_id", "numbers"), rows.join(sets.select("numbers", "set_id"), "numbers").select(member, "set_id")


def forest(members: list[tuple[int, set]], k: int) -> Iterator[tuple[int, int]]:
    """Links (a, b) that join the sets with k common numbers, one fewer than sets in each group."""
    group = {m: m for m, _ in members}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, (a, x) in enumerate(members):
        for b, y in members[:i]:
            ra, rb = root(a), root(b)
            if ra != rb and len(x & y) >= k:
                group[ra] = rb
                yield a, b


def set_links(sets: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(a, b) pairs of set ids that join all sets with at least k common numbers."""
    # depth d: the key is d numbers of the set, ``rest`` the numbers after the last of them
    start = F.sequence(F.lit(1), F.size("numbers") - (k - 1))
    entries = sets.select("set_id", "numbers", F.explode(start).alias("at")).select(
        "set_id", F.array(F.get("numbers", F.col("at") - 1)).alias("key"), F.expr("slice(numbers, at + 1, size(numbers))").alias("rest"))
    out = []
    for depth in range(1, k + 1):
        entries = materialize(entries, "overlap_entries")
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("smallest")).filter("n >= 2")
        met = entries.join(sizes, "key")
        if depth == k:
            out.append(met.filter("set_id != smallest").select(F.col("set_id").alias("a"), F.col("smallest").alias("b")))
            break

        def run(batches: Iterator[pa.RecordBatch], need: int = k - depth) -> Iterator[pa.RecordBatch]:
            for b in batches:
                links = [x for block in b.column(0).to_pylist() for x in forest([(m["set_id"], set(m["rest"])) for m in block], need)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        small = met.filter(F.col("n") <= block).groupBy("key").agg(F.collect_list(F.struct("set_id", "rest")).alias("members"))
        out.append(small.select("members").mapInArrow(run, "a long, b long"))
        more = met.filter(F.col("n") > block).withColumn("last", F.size("rest") - (k - depth - 1)).filter("last > 0")
        entries = more.select("set_id", "key", "rest", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("at")).select(
            "set_id", F.expr("array_append(key, rest[at - 1])").alias("key"), F.expr("slice(rest, at + 1, size(rest))").alias("rest"))
    links = out[0]
    for x in out[1:]:
        links = links.unionByName(x)
    return links.distinct()


def overlap_links(index: DataFrame, member: str, value: str, k: int, block: int = BLOCK) -> DataFrame:
    """(member, hub): star links whose components are those of the graph that joins members with at least k common values.

    ``index`` holds distinct (member, value) rows. Hubs are ``set:<number>``; a set's own members hang on it, and a set that links another
    hangs there as well, by one of its members.
    """
    sets, membership = value_sets(index, member, value, k)
    sets, membership = materialize(sets, "overlap_sets"), materialize(membership, "overlap_members")
    own = membership.select(F.col(member).alias("member"), F.col("set_id").alias("hub"))
    speaker = membership.groupBy("set_id").agg(F.min(member).alias("member"))
    across = set_links(sets, k, block).join(speaker.withColumnRenamed("set_id", "a"), "a").select("member", F.col("b").alias("hub"))
    return own.unionByName(across).select("member", F.concat(F.lit("set:"), F.col("hub").cast("string")).alias("hub"))
