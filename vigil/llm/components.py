"""Connected components of a link table with integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vigil.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    A node takes the smallest label among its own and its neighbours', then its label's label, until nothing changes; labels only
    fall and always name a node of the component. Each round is written to the shared folder, so lineage stays short. Nodes
    without a link have no row. A node with very many links is a skewed join key, which AQE splits.
    """
    e = links.filter("a != b")
    edges = materialize(e.select("a", "b").union(e.select("b", "a")).distinct(), "cc_edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")), "cc_labels")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        seen = Observation(f"cc_{step}")
        moved = moved.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")) \
            .observe(seen, F.coalesce(F.sum((F.col("label") != F.col("old")).cast("long")), F.lit(0)).alias("changed"))
        labels = materialize(moved, "cc_labels").select("node", "label")
        if not seen.get["changed"]:
            return labels.select("node", F.col("label").alias("component"))
