"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one queue over all trees, exact reranking.

Fit: ``N_TREES`` complete binary trees on at most ``SAMPLE_ROWS`` distinct vectors (in hash order): a node's direction joins two random
sample points of the node, its threshold is the median of the node's points. Largest inner product becomes nearest angle by one more
coordinate, sqrt(M^2 - |x|^2), with M the largest norm. What is sent to the tasks (directions, thresholds, sample) is bounded by
the parameters, about 7 MB at 64 dimensions.

Index: every vector goes down every tree to one leaf. Search: a leaf's key is the largest distance to a split that the query has to cross
on the way to it; leaves of all trees are taken in the order of that one queue, the nearest ``LEAVES`` of them. Leaves stand in groups
(a subtree, dealt into chunks of about ``CHUNK`` vectors); a task holds one chunk and streams the queries that visit it, scoring the visited
leaves' vectors exactly in double precision. It passes on a query's best few that are no worse than the best sample
points it will meet, and a window keeps the nearest ``K`` per query. Both bounds are the ``K`` + 1st best over entries of different
smallest ids: at least ``K`` ids other than the query's own are as near, however many vectors an id has.

Equal vectors are one entry of the index with its ``K`` + 1 smallest vec_ids, which is all that any result can show of them, so
a vector that a third of the rows share costs as much as any other.

Queries are the rows whose vec_id is divisible by ``QUERY_STEP``; a query's own vec_id is no candidate. Vectors that are null, zero, of another
length than most or hold null or non-finite components take no part, nor do null vec_ids. Rows that repeat a
vec_id with the same vector count once; of a query id with several vectors the one that is smallest as an array asks, and
a candidate id keeps its best score. Ties go to the smaller vec_id. With no usable vector the result is empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.arrow import batch
from vigil.session import materialize

K = 20
QUERY_STEP = 20
N_TREES = 16
DEPTH = 10
SAMPLE_ROWS = 8192
LEAF_SAMPLE = 8  # sample points of a leaf; a smaller sample makes shallower trees
LEAVES = 768
GROUP_LEVELS = 4  # a tree's groups are its subtrees at this level
CHUNK = 4096
QUERY_BLOCK = 256


class Forest:
    """Complete trees in heap order: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, largest: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.largest = largest
        x = self.lift(sample)
        self.depth = int(np.clip(np.floor(np.log2(max(1, len(x)) / LEAF_SAMPLE)), 0, DEPTH))
        n_inner = 2 ** self.depth - 1
        self.direction = np.zeros((N_TREES, n_inner, x.shape[1]), np.float32)
        self.threshold = np.zeros((N_TREES, n_inner), np.float32)
        for t in range(N_TREES):
            inside: list[np.ndarray] = [np.arange(len(x))]
            for node in range(n_inner):
                at = inside[node]
                w = rng.standard_normal(x.shape[1]) if len(at) < 2 else np.subtract(*x[rng.choice(at, 2, replace=False)])
                w = w / max(np.linalg.norm(w), 1e-12)
                p = x[at] @ w.astype(np.float32)
                cut = np.float32(np.median(p)) if len(at) else np.float32(0)
                self.direction[t, node], self.threshold[t, node] = w, cut
                inside += [at[p <= cut], at[p > cut]]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest ** 2 - (x.astype(np.float64) ** 2).sum(1), 0))
        return (np.column_stack([x, rest]) / max(self.largest, 1e-300)).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector."""
        v = self.lift(x)
        out = np.zeros((len(v), N_TREES), np.int32)
        for t in range(N_TREES):
            node = np.zeros(len(v), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", v, self.direction[t, node])
                node = 2 * node + 1 + (p > self.threshold[t, node])
            out[:, t] = node - (2 ** self.depth - 1)
        return out

    def visits(self, q: np.ndarray, n_leaves: int) -> np.ndarray:
        """(rows, trees * leaves) mask of the leaves that come first in the queue over all trees."""
        unit = q / np.maximum(np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True), 1e-300)
        v = np.column_stack([unit, np.zeros(len(q))]).astype(np.float32)
        keys = []
        for t in range(N_TREES):
            key = np.zeros((len(v), 1), np.float32)
            first = 0
            for level in range(self.depth):
                n = 2 ** level
                margin = v @ self.direction[t, first:first + n].T - self.threshold[t, first:first + n]
                nxt = np.empty((len(v), 2 * n), np.float32)
                nxt[:, 0::2] = np.maximum(key, np.maximum(margin, 0))  # the left side is p <= threshold
                nxt[:, 1::2] = np.maximum(key, np.maximum(-margin, 0))
                key, first = nxt, first + n
            keys.append(key)
        all_keys = np.concatenate(keys, axis=1)
        mask = np.zeros(all_keys.shape, bool)
        if n_leaves >= all_keys.shape[1]:
            mask[:] = True
        else:
            np.put_along_axis(mask, np.argpartition(all_keys, n_leaves - 1, axis=1)[:, :n_leaves], True, axis=1)
        return mask


def _matrix(column, dtype: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, 0), dtype)


def _usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, v) with usable vectors, and the numpy type of their components."""
    dtype = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if dtype == "<f4" else "array<double>").alias("v"))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(_fine()), dtype


def _fine():
    v = F.col("v")
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _to_binary(df: DataFrame, dtype: str, keep: list[str], types: str) -> DataFrame:
    """The array column ``v`` as bytes."""
    def run(batches):
        for b in batches:
            lists = b.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            raw, width = flat.tobytes(), np.dtype(dtype).itemsize
            v = [raw[a * width:z * width] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(v, pa.binary())], names=[*keep, "v"])

    return df.select(*keep, "v").mapInArrow(run, f"{types}, v binary")


def _groups(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns in the order of their owners, and the first of each owner; nothing if no owner repeats."""
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(owner[order]) != 0)) if len(owner) else order
    return None if len(first) == len(owner) else (order, first)


def _nth_best(scores: np.ndarray, groups: tuple[np.ndarray, np.ndarray] | None, n: int) -> np.ndarray:
    """Per row the n-th largest of the owners' best scores, -inf where there are fewer owners."""
    if groups is not None:
        scores = np.maximum.reduceat(scores[:, groups[0]], groups[1], axis=1)
    return np.partition(scores, -n, axis=1)[:, -n] if scores.shape[1] >= n else np.full(len(scores), -np.inf)


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, n_leaves: int = LEAVES) -> DataFrame:
    """(query_id, rank, vec_id, score) from ``vectors`` (vec_id, embedding, ...)."""
    spark = vectors.sparkSession
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("id").cast("double").alias("score"))
    usable, dtype = _usable(vectors)
    top = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return empty
    usable = usable.filter(F.size("v") == top["n"])
    # equal vectors: one entry with its k + 1 smallest ids; the limit works before the shuffle
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = usable.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1) \
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.xxhash64("v"))
    entries = materialize(_to_binary(entries, dtype, ["entry", "ids"], "entry long, ids array<long>"), "ann_entries")
    queries = usable.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(_to_binary(queries, dtype, ["vec_id"], "vec_id long"), "ann_queries")

    def norms(batches):
        for b in batches:
            x = _matrix(b.column("v"), dtype).astype(np.float64)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x ** 2).sum(1)).max())]), pa.array([len(x)])], names=["norm", "n"])

    largest, n = entries.select("v").mapInArrow(norms, "norm double, n long").agg(F.max("norm"), F.sum("n")).first()
    sample = entries.orderBy("entry").limit(SAMPLE_ROWS).select("v", F.element_at("ids", 1).alias("owner")).collect()  # at most SAMPLE_ROWS vectors
    points = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), dtype).reshape(len(sample), -1)
    forest = spark.sparkContext.broadcast((Forest(points, largest), points, _groups(np.array([r["owner"] for r in sample], np.int64))))
    levels = min(GROUP_LEVELS, forest.value[0].depth)
    per_group = 2 ** (forest.value[0].depth - levels)
    n_chunks = -(-int(n) // (2 ** levels * CHUNK))
    schema = pa.schema([("gid", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("leaves", pa.list_(pa.int32())), ("floor", pa.float64()),
                        ("ids", pa.list_(pa.int64())), ("v", pa.binary())])
    columns = "gid long, kind int, id long, leaves array<int>, floor double, ids array<long>, v binary"

    def gid(tree, group, chunk):
        return (tree * 2 ** levels + group) * n_chunks + chunk

    def index(batches):
        f = forest.value[0]
        for b in batches:
            raw, ids, entry = b.column("v").to_pylist(), b.column("ids").to_pylist(), b.column("entry").to_numpy()
            if not raw:
                continue
            leaf = f.leaves(_matrix(b.column("v"), dtype))
            for t in range(N_TREES):
                yield batch(schema, gid=gid(t, leaf[:, t] // per_group, entry % n_chunks), kind=[0] * len(raw), id=entry,
                            leaves=[[x] for x in (leaf[:, t] % per_group).tolist()], floor=[None] * len(raw), ids=ids, v=raw)

    def search(batches):
        f, points, owners = forest.value
        base, at_leaf = points.astype(np.float64), f.leaves(points)
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                raw, ids, q = part.column("v").to_pylist(), part.column("vec_id").to_pylist(), _matrix(part.column("v"), dtype)
                mask = f.visits(q, n_leaves)
                # the k + 1 best of the sample points that the search will meet: one of them may be the query itself
                met = np.zeros((len(q), len(base)), bool)
                for t in range(N_TREES):
                    met |= mask[:, t * 2 ** f.depth + at_leaf[:, t]]
                s = np.where(met, q.astype(np.float64) @ base.T, -np.inf)
                floor = _nth_best(s, owners, k + 1)
                floor = floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
                mask = mask.reshape(len(q), N_TREES, 2 ** levels, per_group)
                row, tree, group = np.nonzero(mask.any(-1))
                visited = [np.flatnonzero(mask[r, t, g]).tolist() for r, t, g in zip(row, tree, group, strict=True)]
                for c in range(n_chunks):
                    yield batch(schema, gid=gid(tree, group, c), kind=[1] * len(row), id=[ids[r] for r in row], leaves=visited,
                                floor=floor[row], ids=[None] * len(row), v=[raw[r] for r in row])

    def rerank(batches):
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        here, parts, x, leaf, ids, owners = None, [], None, None, None, None
        for b in batches:
            g = b.column("gid").to_numpy()
            kind = b.column("kind").to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if a == z:
                    continue
                if g[a] != here:
                    here, parts, x = g[a], [], None
                rows = b.slice(a, z - a)
                if kind[a] == 0:
                    parts.append(rows)
                    continue
                if not parts:
                    continue  # a chunk without vectors
                if x is None:
                    x = np.concatenate([_matrix(p.column("v"), dtype) for p in parts]).astype(np.float64)
                    leaf = np.concatenate([p.column("leaves").flatten().to_numpy() for p in parts])
                    ids = [i for p in parts for i in p.column("ids").to_pylist()]
                    owners = _groups(np.array([i[0] for i in ids], np.int64))
                    members = {v: np.flatnonzero(leaf == v) for v in np.unique(leaf).tolist()}
                for at in range(0, rows.num_rows, QUERY_BLOCK):
                    part = rows.slice(at, QUERY_BLOCK)
                    q = _matrix(part.column("v"), dtype).astype(np.float64)
                    asked: dict[int, list[int]] = {}
                    for r, visited in enumerate(part.column("leaves").to_pylist()):
                        for v in visited:
                            asked.setdefault(v, []).append(r)
                    scores = np.full((len(q), len(x)), -np.inf)
                    for v, who in asked.items():
                        if v in members:
                            scores[np.ix_(who, members[v])] = q[who] @ x[members[v]].T
                    scores[scores < part.column("floor").to_numpy()[:, None]] = -np.inf
                    scores[scores < _nth_best(scores, owners, k + 1)[:, None]] = -np.inf
                    r, c = np.nonzero(scores > -np.inf)
                    if not len(r):
                        continue
                    exact = np.einsum("ij,ij->i", q[r], x[c])
                    asker = part.column("id").to_numpy()[r]
                    n_ids = np.array([len(ids[j]) for j in c.tolist()])
                    found = np.concatenate([ids[j] for j in c.tolist()])
                    query_id, score = np.repeat(asker, n_ids), np.repeat(exact, n_ids)
                    other = np.flatnonzero(query_id != found)
                    if owners is not None:  # an id's best vector is enough
                        other = other[np.lexsort((-score[other], found[other], query_id[other]))]
                        other = other[np.append(True, (np.diff(query_id[other]) != 0) | (np.diff(found[other]) != 0))[:len(other)]]
                    yield batch(out, query_id=query_id[other], vec_id=found[other], score=score[other])

    both = entries.mapInArrow(index, columns).unionByName(queries.mapInArrow(search, columns))
    hits = both.repartition("gid").sortWithinPartitions("gid", "kind").mapInArrow(rerank, "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
