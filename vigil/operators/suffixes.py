"""Registrable domains by a table of public suffix rules.

Rules are plain names, wildcards (``*.ck``: one label more before ``ck``) and exceptions to them (``!www.ck``). Each distinct name is split
into its tails, tails meet the rules in one join on the name, and the best rule of a name wins: an exception before any other,
else the one with most labels. The rules are a table of any length; the plan does not grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.features import lookup_side
from vigil.operators.skew import join_per_key


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a suffix list file: one rule a line, ``//`` comments and blank lines skipped."""
    return rules_of(spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S*)", 1).alias("rule")))


def rules_of(lines: DataFrame) -> DataFrame:
    low = F.lower("rule")
    return lines.filter((F.col("rule") != "") & ~F.col("rule").startswith("//")).select(low.alias("rule")).distinct()


def registrable(names: DataFrame, rules: DataFrame, column: str = "value") -> DataFrame:
    """(column, registrable) per distinct value: the label before its public suffix and the suffix, lower-cased; the lower-cased name
    itself without a rule, or if it is a suffix."""
    name = F.regexp_replace("rule", r"^(?:\*\.|!)", "")
    kind = F.when(F.col("rule").startswith("!"), -1).when(F.col("rule").startswith("*."), 1).otherwise(0)
    side = lookup_side(rules.select(name.alias("tail"), kind.alias("more")).groupBy("tail").agg(F.collect_set("more").alias("kinds")))
    labels = F.split(F.lower(column), r"\.", -1)
    d = names.select(column).distinct().select(column, labels.alias("labels"), F.posexplode(F.sequence(F.lit(1), F.size(labels))).alias("at", "start"))
    tails = d.select(column, "start", F.size("labels").alias("n"), F.array_join(F.expr("slice(labels, start, size(labels))"), ".").alias("tail"))
    hits = tails.join(side, "tail").select(column, F.col("n"), (F.col("n") - F.col("start") + 1).alias("size"), F.explode("kinds").alias("more"))
    hits = hits.filter((F.col("more") <= 0) | (F.col("size") < F.col("n")))  # a wildcard needs a label before its name
    best = hits.groupBy(column).agg(F.max(F.struct((F.col("more") == -1).alias("spared"), (F.col("size") + F.col("more")).alias("suffix"))).alias("b"))
    out = names.select(column).distinct().join(best, column, "left")
    n = F.size(F.split(column, r"\.", -1))
    whole = F.col("b").isNull() | (F.col("b.suffix") >= n)
    tail = F.array_join(F.slice(labels, n - F.col("b.suffix"), n), ".")
    return out.select(column, F.when(whole, F.lower(column)).otherwise(tail).alias("registrable"))


def with_registrable(rows: DataFrame, rules: DataFrame, column: str, salt_on: str) -> DataFrame:
    """``rows`` with ``registrable``; one name may be in most of them."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_events"))
    per_name = registrable(counts.select(column), rules, column).join(counts, column)
    return join_per_key(rows, per_name, column, salt_on).drop("n_events")
