"""Density clustering of sparse unit vectors by cosine distance, without a table of pairs.

Equal vectors are one class with its number of rows. First, every class meets the ``PIVOTS`` classes whose hashes are lowest. A class with enough neighbours
among them is a core, whatever its other neighbours are, and it belongs to the group of the core pivots it is near to. That settles most of a dense
corpus in one pass that grows with the number of classes.

What is left open is compared with all, exactly: classes are dealt into parts, and parts meet two by two: a task holds two parts of at most ``BLOCK``
classes and compares them tile by tile, as single-precision matrix products; a pair whose product is nearer to the limit than their
rounding error is looked at again in double precision. Two passes: the first counts the neighbours of the classes not known as cores (up to what makes a core);
the second joins the cores of each pair of parts by a spanning forest and hangs border classes on the cores they touch, and there the cores of the
largest group meet all others, but not each other: they are joined. Connected components of groups and forests are the clusters, numbered
by their smallest core id; a border row goes to the cluster with the smallest number among its core neighbours. Noise, and rows without a
feature, get no cluster.

Where the pivots settle nothing (a thin corpus) every pair is compared, once a pass: then the work is quadratic in the number of different vectors.
(Blocks of a prefix filter hold most classes each where the features are few and frequent, and send a class once per feature and part.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.graph import component_ids, global_rank
from vigil.operators.skew import join_per_key
from vigil.session import materialize

BLOCK = 16_384  # classes of a part at most
SMALL = 1_024  # classes of a part at least, where there are more parts than it takes
PIVOTS = 2_048  # classes that all others meet first
TILE = 2_048
DIGITS = 9  # of a distance that are compared
SAME = 2  # side of the members of a part that meets itself; 0 and 1 are the sides where two parts meet


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches sorted by it."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        keys = t.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and a < z and held[-1].column("key")[0].as_py() != keys[a]:
                yield pa.concat_tables(held)
                held = []
            if a < z:
                held.append(t.slice(a, z - a))
    if held:
        yield pa.concat_tables(held)


class _Rows:
    """Classes of one side as dense rows, in single precision for all pairs and in double precision for a few. Other features than ``names`` are left out."""

    def __init__(self, t: pa.Table, names: np.ndarray) -> None:
        t = t.combine_chunks()
        self.cid, self.m = t.column("cid").to_numpy(), t.column("m").to_numpy()
        self.core, self.open = (t.column(c).to_numpy(zero_copy_only=False) if c in t.column_names else None for c in ("core", "open"))
        self.label = pc.coalesce(t.column("grp"), t.column("cid")).to_numpy() if "grp" in t.column_names else self.cid
        at, w = (pa.concat_arrays(t.column(c).chunks) if t.num_rows else None for c in ("at", "w"))
        row = np.repeat(np.arange(t.num_rows), np.diff(at.offsets.to_numpy()))
        self.exact = np.zeros((t.num_rows, len(names)))
        at, w = at.flatten().to_numpy(), w.flatten().to_numpy()
        place = np.minimum(np.searchsorted(names, at), len(names) - 1)
        known = names[place] == at
        self.exact[row[known], place[known]] = w[known]
        self.fast = self.exact.astype(np.float32)


def _names(t: pa.Table) -> np.ndarray:
    return np.unique(pa.concat_arrays(t.combine_chunks().column("at").chunks).flatten().to_numpy())


def _sides(t: pa.Table) -> tuple[_Rows, _Rows] | None:
    """The two sides of a pair of parts, one object where a part meets itself; None if there is nothing to compare."""
    names = _names(t)
    side = t.column("side").to_numpy()
    if side[0] == SAME:
        rows = _Rows(t, names)
        return (rows, rows) if t.num_rows > 1 else None
    if not 0 < side.sum() < len(side):
        return None
    a, b = (_Rows(t.filter(pa.array(side == k)), names) for k in (0, 1))
    return a, b


def _near(a: _Rows, b: _Rows, i: slice, j: slice, eps: float) -> np.ndarray:
    """Mask of the pairs within eps of the rows i of ``a`` and j of ``b``; a row is not its own neighbour."""
    dots = a.fast[i] @ b.fast[j].T
    limit, doubt = 1 - eps, 2.0 ** -23 * (a.fast.shape[1] + 8)  # a bound of the rounding error for unit vectors
    ok = dots >= limit
    x, y = np.nonzero(np.abs(dots - np.float32(limit)) <= doubt + 10.0 ** -DIGITS)
    for k in range(0, len(x), TILE):
        p, q = x[k:k + TILE], y[k:k + TILE]
        ok[p, q] = np.round(1 - np.einsum("rf,rf->r", a.exact[i][p], b.exact[j][q]), DIGITS) <= eps
    if a is b and i == j:
        np.fill_diagonal(ok, False)
    return ok


def _tiles(a: _Rows, b: _Rows) -> Iterator[tuple[slice, slice]]:
    for i in range(0, len(a.cid), TILE):
        for j in range(i if a is b else 0, len(b.cid), TILE):
            yield slice(i, min(i + TILE, len(a.cid))), slice(j, min(j + TILE, len(b.cid)))


def _forest(ok: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (row, column) that join what the mask joins, fewer than rows and columns together."""
    seen_row, seen_col = np.zeros(ok.shape[0], bool), np.zeros(ok.shape[1], bool)
    for start in range(ok.shape[0]):
        front = np.array([start]) if not seen_row[start] else np.zeros(0, np.int64)
        seen_row[start] = True
        while len(front):
            met = ok[front] & ~seen_col
            cols = np.flatnonzero(met.any(0))
            yield from zip(front[met[:, cols].argmax(0)].tolist(), cols.tolist(), strict=True)
            seen_col[cols] = True
            back = ok[:, cols] & ~seen_row[:, None]
            front = np.flatnonzero(back.any(1)) if len(cols) else np.zeros(0, np.int64)
            if len(front):
                yield from zip(front.tolist(), cols[back[front].argmax(1)].tolist(), strict=True)
                seen_row[front] = True


class _Joined:
    """Disjoint sets of 0 to n - 1; those with equal labels are joined from the start."""

    def __init__(self, labels: np.ndarray) -> None:
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[back].tolist()

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        p, q = self.root(x), self.root(y)
        self.up[p] = q
        return p != q


def _blocks(classes: DataFrame, parts: int, settled: Column | None = None, settled_parts: int = 0) -> DataFrame:
    """A row per class and part that its own part meets, sorted by pair of parts; pairs are dealt out evenly. ``classes``: (cid, m, at, w, ...).

    The ``settled`` classes lie in parts of their own, which meet the other ``parts`` but not each other.
    """
    long, other = lambda n: F.lit(n).cast("long"), F.col("other")
    own, meets = F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("long"), F.sequence(long(0), long(parts + settled_parts - 1))
    if settled_parts:
        own = F.when(settled, F.pmod(F.xxhash64("cid"), F.lit(settled_parts)).cast("long") + parts).otherwise(own)
        meets = F.when(settled, F.sequence(long(0), long(parts - 1))).otherwise(meets)
    rows = classes.select(*classes.columns, own.alias("own"), F.explode(meets).alias("other"))
    high, low = F.greatest("own", other), F.least("own", other)
    key = F.when(high < parts, F.expr("greatest(own, other) * (greatest(own, other) + 1) div 2") + low).otherwise((high - parts) * parts + low + parts * (parts + 1) // 2)
    keyed = rows.select(key.alias("key"), F.when(high == low, SAME).otherwise((F.col("own") == high).cast("int")).cast("int").alias("side"), *classes.columns)
    n = min(parts * (parts + 1) // 2 + parts * settled_parts, 4 * classes.sparkSession.sparkContext.defaultParallelism)
    return keyed.repartitionById(n, (F.col("key") % n).cast("int")).sortWithinPartitions("key")


def _open_blocks(classes: DataFrame) -> DataFrame | None:
    """``_blocks`` of (cid, m, at, w, open, ...): all pairs with an open class; None without one."""
    n, n_open = classes.agg(F.count(F.lit(1)), F.count_if("open")).first()
    if not n_open:
        return None
    slots, n_settled = classes.sparkSession.sparkContext.defaultParallelism, n - n_open
    parts, settled = -(-n_open // BLOCK), -(-n_settled // BLOCK)
    if n_settled > n_open:  # some tasks for each slot
        settled = max(settled, min(-(-4 * slots // parts), -(-n_settled // SMALL)))
    else:
        parts = max(parts, min(math.ceil(math.sqrt(8 * slots)), -(-n_open // SMALL)))
    return _blocks(classes, parts, ~F.col("open"), settled)


def _meet_pivots(classes: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``classes`` with ``known`` (a core, by its neighbours among the pivots) and ``grp`` (its group of joined cores, if any)."""
    last = classes.select("key").orderBy("key").limit(PIVOTS).agg(F.max("key")).first()[0]
    table = classes.filter(F.col("key") <= last).select("cid", "m", "at", "w").toArrow() if last else None  # at most PIVOTS rows
    if table is None:
        return classes.select("*", F.lit(False).alias("known"), F.lit(None).cast("long").alias("grp"))
    table = table.sort_by("cid")
    names = _names(table)
    pivots = _Rows(table, names)
    every = slice(0, len(pivots.cid))
    near = _near(pivots, pivots, every, every, eps)
    core = pivots.m + near @ np.minimum(pivots.m, min_samples) >= min_samples
    joined = _Joined(pivots.cid)
    for x, y in _forest(near & core[:, None] & core[None, :]):
        joined.join(x, y)
    group = np.array([joined.root(x) for x in range(len(core))])  # of each pivot; meaningful for cores

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Rows(table, names)
        weight, group_of = np.minimum(p.m, min_samples).astype(np.float32), _Joined(p.cid)
        for b in batches:
            for start in range(0, b.num_rows, TILE):
                t = pa.Table.from_batches([b.slice(start, TILE)])
                rows = _Rows(t, names)
                ok = _near(rows, p, slice(0, t.num_rows), slice(0, len(p.cid)), eps)
                own = np.minimum(np.searchsorted(p.cid, rows.cid), len(p.cid) - 1)
                same = np.flatnonzero(p.cid[own] == rows.cid)
                ok[same, own[same]] = False
                known = rows.m + ok @ weight >= min_samples
                ok[same, own[same]] = True
                ok &= core
                first = np.where(known & ok.any(1), group[ok.argmax(1)], -1)
                more: list[list[int]] = [[] for _ in first]
                for r in np.flatnonzero((first >= 0) & (ok & (group != first[:, None])).any(1)):
                    more[r] = [int(p.cid[g]) for g in np.unique(group[ok[r]]) if group_of.join(int(first[r]), int(g))]
                grp = pa.array(p.cid[first], pa.int64(), mask=first < 0)
                yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in columns), pa.array(known), grp, pa.array(more, pa.list_(pa.int64()))], names=[*columns, "known", "grp", "more"])

    columns = classes.columns
    schema = ", ".join(f"{c} {kind}" for c, kind in classes.dtypes)
    met = materialize(classes.mapInArrow(meet, f"{schema}, known boolean, grp long, more array<long>"), "density_met")
    roots = component_ids(met.select(F.col("grp").alias("a"), F.explode("more").alias("b")))  # of at most PIVOTS groups
    return met.drop("more").join(F.broadcast(roots.withColumnRenamed("id", "grp")), "grp", "left").select(*columns, "known", F.coalesce("root", "grp").alias("grp"))


def density_clusters(vectors: DataFrame, eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """(id, cluster_id, cluster_confidence) per row of ``vectors`` (id, at, w); no cluster and 0.0 for noise."""
    v = vectors.select("id", F.md5(F.concat(F.to_json("at"), F.lit("|"), F.to_json("w"))).alias("key"), "at", "w")
    alike = v.filter(F.size("at") > 0).groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("at").alias("at"), F.any_value("w").alias("w"))
    classes = _meet_pivots(materialize(alike.withColumn("cid", F.monotonically_increasing_id()), "density_classes"), eps, min_samples)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            sides = _sides(t)
            if sides is None:
                continue
            a, b = sides
            n = [np.zeros(len(x.cid), np.int64) for x in sides]
            for i, j in _tiles(a, b):
                ok = _near(a, b, i, j, eps).astype(np.float32)
                n[0][i] += (ok @ np.minimum(b.m[j], min_samples).astype(np.float32)).astype(np.int64)
                if (a is not b or i != j) and b.open[j].any():
                    n[0 if a is b else 1][j] += (np.minimum(a.m[i], min_samples).astype(np.float32) @ ok).astype(np.int64)
            for x, c in zip((a,) if a is b else (a, b), n, strict=False):
                some = np.flatnonzero(c * x.open)
                yield pa.RecordBatch.from_arrays([pa.array(x.cid[some]), pa.array(np.minimum(c[some], min_samples))], names=["cid", "n"])

    blocks = _open_blocks(classes.select("cid", "m", "at", "w", (~F.col("known")).alias("open")))
    found = blocks.mapInArrow(counts, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n")) if blocks else classes.select("cid", F.lit(0).alias("n")).limit(0)
    core = F.col("known") | (F.col("m") + F.coalesce("n", F.lit(0)) >= min_samples)
    cored = materialize(classes.join(found, "cid", "left").select("cid", "key", "rep", "m", "at", "w", core.alias("core"), "grp"), "density_cores")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            sides = _sides(t.sort_by("grp"))  # so the classes of a group share tiles
            if sides is None or not (sides[0].core.any() or sides[1].core.any()):
                continue
            a, b = sides
            place = (np.arange(len(a.cid)), np.arange(len(b.cid)) + (0 if a is b else len(a.cid)))  # of both sides in one list
            cid, label = (getattr(a, c) if a is b else np.concatenate([getattr(a, c), getattr(b, c)]) for c in ("cid", "label"))
            joined = _Joined(label)
            ends, border = [], set()
            for i, j in _tiles(a, b):
                rows, cols = place[0][i], place[1][j]
                core_row, core_col = a.core[i], b.core[j]
                if not (core_row.any() or core_col.any()):
                    continue
                if core_row.all() and core_col.all() and len({joined.root(x) for x in (*rows.tolist(), *cols.tolist())}) == 1:
                    continue
                ok = _near(a, b, i, j, eps)
                for x, y in _forest(ok & core_row[:, None] & core_col[None, :]):
                    if joined.join(int(rows[x]), int(cols[y])):
                        ends.append((rows[x], cols[y]))
                for x, y in zip(*np.nonzero(ok & (core_row[:, None] != core_col[None, :])), strict=True):
                    border.add((rows[x], cols[y]) if core_col[y] else (cols[y], rows[x]))
            hung = sorted({(x, joined.root(int(y))) for x, y in border})
            ends, hung = (np.array(x, np.int64).reshape(-1, 2) for x in (ends, hung))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([label[ends[:, 0]], cid[hung[:, 0]]]), pa.int64()), pa.array(np.concatenate([label[ends[:, 1]], cid[hung[:, 1]]]), pa.int64()),
                                              pa.array([False] * len(ends) + [True] * len(hung), pa.bool_())], names=["a", "b", "border"])

    groups = cored.filter("core").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("grp IS NOT NULL").orderBy(F.desc("n"), "grp").collect()  # at most PIVOTS
    largest = F.lit(groups[0]["grp"] if groups else None).cast("long")
    blocks = _open_blocks(cored.select("cid", "m", "core", "at", "w", "grp", (~(F.col("core") & F.col("grp").eqNullSafe(largest) & F.col("grp").isNotNull())).alias("open")))
    links_of = blocks.mapInArrow(links, "a long, b long, border boolean") if blocks else cored.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(False).alias("border")).limit(0)
    joined = materialize(links_of, "density_links")
    roots = component_ids(joined.filter("NOT border").select("a", "b"))  # of labels: a group, or a class without one
    known = cored.filter("core AND grp IS NOT NULL").join(F.broadcast(cored.select("grp").filter("grp IS NOT NULL").distinct().join(roots, F.col("id") == F.col("grp"), "left").select("grp", "root")), "grp")
    alone = cored.filter("core AND grp IS NULL").join(roots, F.col("id") == F.col("cid"), "left")
    cores = known.select("cid", "rep", F.coalesce("root", "grp").alias("root")).unionByName(alone.select("cid", "rep", F.coalesce("root", "cid").alias("root")))
    numbers = global_rank(cores.groupBy("root").agg(F.min("rep").alias("first")), [F.col("first")], "number").select("root", (F.col("number") - 1).cast("int").alias("cluster_id"))
    of_core = materialize(cores.join(numbers, "root").select("cid", "cluster_id"), "density_numbers")
    of_border = joined.filter("border").join(of_core.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("cluster_id").alias("cluster_id"))
    per_class = cored.join(of_core.unionByName(of_border), "cid").select("key", "m", "cluster_id")
    out = join_per_key(v.select("id", "key"), per_class, "key", "id", rows="m")
    return out.select("id", "cluster_id", F.when(F.col("cluster_id").isNull(), 0.0).otherwise(1.0).alias("cluster_confidence"))
