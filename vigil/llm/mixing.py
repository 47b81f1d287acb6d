"""Mixing sources to target weights by Pareto order sampling (built-in expressions only).

A source's target is its weight's share of all words, at most ``max_repeat`` times what the source has;
the excess is reshared by weight. With r = target / words of the source, every document is taken floor(r)
times; for the rest of the target the documents of the source are ranked by random odds divided by
inclusion odds (Pareto order sampling) and the first of them, up to the words still wanted, are taken once more.

Scale: one pass makes (source, size, rank key) rows; the cut of each source is found from the sums of
``CELLS`` rank cells (combined map-side, so a source with a third of all rows is not gathered) and a window
over the one cell in which the cut falls, about 1 / ``CELLS`` of the source. The per-source table is written and joined back;
Spark broadcasts it only if its file is below the broadcast threshold. Documents are not shuffled.

Cases: a null text has size 0; documents of size 0 are never taken; sources with no words get target 0; a null
source is a source of its own, last; rows of one doc_id, or of none, have ranks of their own by their texts, and rows that are equal
altogether are dealt into ``SUBS`` parts by their place in the table, so that a part of them can be taken; an empty table gives an empty result; other columns, whatever their names, are carried by ``mix_documents`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.text import word_count
from vigil.session import materialize

CELLS = 4096
SUBS = 1024
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HALF_SIZE = 100  # a document of so many words has half the inclusion odds of a very long one


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """One struct column with the caller's row, next to the columns used here; ``sub`` deals equal rows out over ``SUBS`` parts."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    sub = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SUBS))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2 ** 52))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"),
                       F.col("source"), word_count(F.col("text")).alias("size"), u.alias("u"),
                       F.struct(F.col("doc_id"), sub.alias("sub")).alias("tie"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, whole, rest, odds) per source.

    The targets are a water level: target = least(cap, level * weight). With sources in order of cap / weight,
    the level is the largest of (all words - caps before) / (weights from here on), so no loop is needed.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    t = sums.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * float(max_repeat))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(every).cast("double")
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    t = t.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("w")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio).cast("long")
    part = ratio - whole
    return t.select("source", "source_size", "target", whole.alias("whole"),
                    F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("rest"),
                    (part / (1 - part)).alias("odds"))


def _ranked(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``v`` in [0, 1], which rises with random odds / inclusion odds; null where no part copy can be had."""
    t = targets.withColumnRenamed("source", "t_source")
    joined = sized.join(t, sized["source"].eqNullSafe(t["t_source"]), "left").drop("t_source")
    odds = F.col("odds") * F.col("size") / (F.col("size") + F.lit(float(HALF_SIZE)))
    q = (F.col("u") / (1 - F.col("u"))) / odds
    return joined.withColumn("v", F.when((F.col("odds") > 0) & (F.col("size") > 0), q / (1 + q)))


def _cuts(ranked: DataFrame) -> DataFrame:
    """(source, cut_v, cut_tie): the last rank taken in each source.

    A document at the cut is taken if that brings the words taken nearer to the target; of equal rows at the cut, as many parts as do.
    """
    cell = F.least(F.floor(F.col("v") * CELLS), F.lit(CELLS - 1)).alias("cell")
    r = ranked.filter("v IS NOT NULL").select("source", "tie", "size", "v", "rest", cell)
    run = Window.partitionBy("source").orderBy("cell")
    cells = r.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"),
                                            F.max(F.struct("v", "tie")).alias("last"))
    cells = cells.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    # the cell in which the rest runs out, or the last one
    first = cells.groupBy("source").agg(F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("cell", "before"))).alias("hit"),
                                        F.max("last").alias("last"))
    first = materialize(first.select("source", F.col("hit.cell").alias("hit_cell"), F.col("hit.before").alias("before"), "last"),
                        "mix_cells")
    inside = r.join(first.select(F.col("source").alias("c_source"), "hit_cell", "before"),
                    r["source"].eqNullSafe(F.col("c_source")) & (r["cell"] == F.col("hit_cell"))) \
        .groupBy("source", "v", "tie").agg(F.sum("size").alias("size"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    order = Window.partitionBy("source").orderBy("v", "tie")
    upto = F.sum("size").over(order) + F.col("before")
    picked = inside.withColumn("take", upto - F.col("size") / 2 <= F.col("rest")) \
        .groupBy("source").agg(F.max(F.when(F.col("take"), F.struct("v", "tie"))).alias("got"),
                               F.max("before").alias("before"), F.max("rest").alias("rest"))
    picked = picked.withColumnRenamed("source", "p_source")
    # no document of the hit cell taken: everything in the cells before it, which lie below the cell's lower edge
    return first.join(picked, first["source"].eqNullSafe(F.col("p_source")), "left").select(
        first["source"].alias("cut_source"),
        F.coalesce(F.col("got.v"), F.when(F.col("hit_cell").isNull(), F.col("last.v")).otherwise(F.col("hit_cell") / F.lit(float(CELLS)))).alias("cut_v"),
        F.when(F.col("got").isNotNull(), F.col("got.tie")).when(F.col("hit_cell").isNull(), F.col("last.tie")).alias("cut_tie"),
        (F.col("got").isNull() & F.col("hit_cell").isNotNull()).alias("below"))


def _mixed(docs: DataFrame, weights: tuple, max_repeat: int, seed: str, keep_rows: bool) -> DataFrame:
    sized = _sized(docs, seed)
    # sizes are counted once; the rank passes and the plan read this narrow table, not the texts
    narrow = materialize(sized.drop("row"), "mix_sizes")
    targets = materialize(source_targets(narrow, weights, max_repeat), "mix_targets")
    cuts = materialize(_cuts(_ranked(narrow, targets)), "mix_cuts")
    r = _ranked(sized if keep_rows else narrow, targets)
    r = r.join(cuts, r["source"].eqNullSafe(cuts["cut_source"]), "left")
    at_cut = (F.col("v") == F.col("cut_v")) & (F.col("tie") <= F.col("cut_tie"))
    more = F.coalesce((F.col("v") < F.col("cut_v")) | (~F.col("below") & at_cut), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0).cast("long"))
    return r.withColumn("copies", copies)


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) per document of ``docs`` (doc_id, text, source, ...)."""
    m = _mixed(docs, weights, max_repeat, seed, keep_rows=False)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it, with the same columns."""
    m = _mixed(docs, weights, max_repeat, seed, keep_rows=True)
    return m.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .select("row.*")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM s GROUP BY source),
lev AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
tgt AS (SELECT *, least(cap, (max(level) OVER ()) * w) AS target FROM lev),
rat AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM tgt),
par AS (SELECT source, source_size, target, floor(ratio)::BIGINT AS whole,
               greatest(0.0, target - floor(ratio) * source_size) AS rest,
               (ratio - floor(ratio)) / (1 - (ratio - floor(ratio))) AS odds FROM rat),
rk AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.rest,
         CASE WHEN p.odds > 0 AND s.size > 0 THEN (u / (1 - u)) / (p.odds * s.size / (s.size + 100.0)) END AS q
  FROM s JOIN par p ON s.source IS NOT DISTINCT FROM p.source),
cum AS (
  SELECT *, CASE WHEN q IS NULL THEN NULL ELSE q / (1 + q) END AS v,
         sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q), doc_id NULLS FIRST) AS upto
  FROM rk)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE size * (whole + CASE WHEN v IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) END::BIGINT AS taken,
       CASE WHEN size = 0 THEN 0
            ELSE whole + CASE WHEN v IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END END::BIGINT AS copies
FROM cum
"""
