"""Connected components over an edge DataFrame, and global ranks.

Components are found by star contraction over 64-bit node numbers. An edge goes from its larger to its smaller end. Each round, a node that has one
edge and no other leaves the edge table with a pointer to its only neighbour; then every larger end of a
node is hooked to the smallest neighbour of that node (large star), and every smaller end of a node to that node's smallest one (small
star). So settled components leave at once, and the number of rounds is logarithmic in practice, chains included. At the end the pointers
are followed back, round by round.

Groups are linked through hub nodes (star edges) rather than cliques, so the edge count stays linear in the membership rows even when one hub
holds most events. Each round is written to the shared checkpoint folder; aggregates combine before the shuffle; a hub is a skewed join
key, which AQE splits.
"""

from __future__ import annotations

import logging
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir, materialize

log = logging.getLogger(__name__)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``nodes`` or in an edge.

    ``nodes`` has a column ``node``; ``edges`` has ``src`` and ``dst``. The component is the smallest node id in it (string order).
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")) \
        .filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    e = materialize(e, "cc_edges")
    names = nodes.select(F.col("node").cast("string").alias("node")).union(e.select("src")).union(e.select("dst")).distinct()
    names = materialize(names.withColumn("id", F.monotonically_increasing_id()), "cc_nodes")
    a, b = (names.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")) for end in ("src", "dst"))
    ids = e.join(a, "src").join(b, "dst")
    roots = component_ids(ids.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
    found = names.join(roots, "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    first = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(first, "root").select("node", "component")


def component_ids(links: DataFrame) -> DataFrame:
    """(id, root) for the nodes of ``links`` (a, b: long) that are not roots themselves; equal roots mean equal components."""
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc_round")
    left, n_edges = [], edges.count()
    for step in count():
        if not n_edges:
            break
        ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("x")).select("x.*")
        stats = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("n_low"), F.count_if(F.col("v") > F.col("u")).alias("n_high"))
        low = stats.select(F.col("u").alias("lo"), "m")
        high = stats.filter("n_low > 0").select(F.col("u").alias("hi"), ((F.col("n_low") == 1) & (F.col("n_high") == 0)).alias("leaf"))
        seen = materialize(edges.join(low, "lo").join(high, "hi").select("hi", F.when(F.col("leaf"), F.col("lo")).otherwise(F.col("m")).alias("lo"), "leaf"), "cc_large")
        left.append(seen.filter("leaf").select(F.col("hi").alias("id"), F.col("lo").alias("parent")))
        rest = seen.filter("NOT leaf").select("hi", "lo").distinct()
        smallest = rest.groupBy("hi").agg(F.min("lo").alias("m"))
        hooked = rest.join(smallest, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        edges = materialize(hooked.select("x.*").filter("hi > lo").distinct(), "cc_round")
        before, n_edges = n_edges, edges.count()
        log.info("components, round %d: %d edges, then %d", step, before, n_edges)
    if not left:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    roots = left[-1].select("id", F.col("parent").alias("root"))
    for pointers in left[-2::-1]:
        more = pointers.join(roots.select(F.col("id").alias("parent"), "root"), "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))
        roots = materialize(roots.unionByName(more), "cc_roots")
    return roots


def global_rank(df: DataFrame, order: list, rank_col: str = "rank") -> DataFrame:
    """1-based position of every row in the total order ``order`` (which must be unique).

    No single-partition window: rows are range-partitioned on the order, sorted, and written once with their
    partition and position in it (both from ``monotonically_increasing_id`` after the sort). Counts and rows are
    read from that one table, so they can't disagree; a partition's offset is a running sum over one row per
    partition, which is what gets broadcast.
    """
    from pyspark.sql import Window

    at = F.monotonically_increasing_id()
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "rank")
    placed = placed.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at") - F.shiftleft("_pid", 33))
    counts = placed.groupBy("_pid").agg((F.max("_pos") + 1).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return placed.join(F.broadcast(offsets), "_pid").withColumn(rank_col, F.col("_off") + F.col("_pos") + 1) \
        .drop("_at", "_pid", "_pos", "_off")


def dense_rank_by(df: DataFrame, order_col: str, rank_col: str = "rank") -> DataFrame:
    """Global rank of distinct values of ``order_col`` (see ``global_rank``)."""
    return global_rank(df, [F.col(order_col).asc()], rank_col)
