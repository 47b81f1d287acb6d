"""Near-duplicate detection with a MinHash LSH forest and exact confirmation.

1. One pass makes each text's shingle set, a 128-bit hash of the set and a signature of 64 minimum hashes. Texts with equal
   sets are one class from here on, named by its smallest doc_id.
2. The forest: the signature is turned in ``N_TREES`` ways, each starting with other columns, and every turn is an order of all classes, sorted
   by range over all tasks. In an order, a class's candidates are its neighbours, up to ``WINDOW`` before it, that share a prefix of at least
   ``MIN_DEPTH`` columns with it. Where a stretch of classes with such a prefix is wider than the window, the window holds those with the
   deepest common prefixes, so the depth adapts to how dense the region is.
3. Pairs are taken by the length of their common prefix, deepest first. Pairs whose signatures agree in fewer than
   ``MIN_AGREE`` columns are passed over (at similarity 0.85 that loses fewer than one link in a million), the others are confirmed on
   the full sets unless they are connected already. A chunk of an order sends at most one link per class.
4. Classes of stretches wider than the window, as far as they are in different components, meet once more in blocks by their rarest
   shingles (prefix filtering), which finds all that the windows missed. So nothing is capped, and no pair table is ever made.
5. Connected components over the links; every document gets its class's component.

At similarity 0.85, two texts share no region in any order with probability (1 - 0.85^4)^16, less than one in 100,000.

Cases: a very long text is one row of a batch, its set stays in one task; a text with 1 to 4 words is one shingle; texts without words are linked with nothing and kept; rows that share a
doc_id count as linked, since a component is named by doc_ids; rows with a null doc_id are linked with nothing, are kept and have a null
component; extra columns are carried by ``near_dedup`` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.arrow import batch
from vigil.llm.components import components
from vigil.llm.shingles import N_HASHES, overlap, pack_set, set_hash, shingle_set, signature, unpack_set
from vigil.llm.words import word_hashes
from vigil.operators.graph import global_rank
from vigil.session import materialize

PERCENT = 85
N_TREES = 16
MIN_DEPTH = 4
SORTED = 8  # columns of an order that are sorted over all tasks; within equal ones any order will do
WINDOW = 64  # neighbours looked at before each row of an order
CHUNK = 1024  # rows of an order that one task holds at a time
BLOCK = 256
MIN_AGREE = 40
_WIDTH = 2  # bytes of a column
_TURN = N_HASHES // N_TREES  # columns by which one order starts after another


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sig) per row; s1, s2 and sig are null without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        hashes = word_hashes()
        for b in batches:
            n, s1, s2, sig = [], [], [], []
            for data in b.column("text").to_pylist():
                s = shingle_set(data or b"", hashes)
                n.append(len(s))
                x, y = set_hash(s) if len(s) else (None, None)
                s1.append(x)
                s2.append(y)
                sig.append(signature(s) if len(s) else None)
            yield batch(schema, doc_id=b.column("doc_id"), n_shingles=n, s1=s1, s2=s2, sig=sig)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s1, s2, shingles): the full sets of the classes in ``nodes``, from the texts of the rows that name them.

    The classes grow with the input, so texts and classes meet by a sort-merge join at every size; texts are
    compressed for it.
    """
    def compress(batches):
        z, schema = zstandard.ZstdCompressor(1), pa.schema([("node", pa.int64()), ("packed", pa.binary())])
        for b in batches:
            yield batch(schema, node=b.column("node"), packed=[z.compress(x or b"") for x in b.column("text").to_pylist()])

    def sets(batches):
        hashes, z = word_hashes(), zstandard.ZstdDecompressor()
        schema = pa.schema([("node", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.binary())])
        before, given = None, set()
        for b in batches:
            out = {f.name: [] for f in schema}
            for node, s1, s2, packed in zip(*(b.column(c).to_pylist() for c in ("node", "s1", "s2", "packed")), strict=True):
                s = shingle_set(z.decompress(packed), hashes)
                if node != before:
                    before, given = node, set()
                if set_hash(s) == (s1, s2) and (s1, s2) not in given:  # another row of this doc_id may have another text
                    given.add((s1, s2))
                    for name, value in (("node", node), ("s1", s1), ("s2", s2), ("shingles", pack_set(s))):
                        out[name].append(value)
            yield batch(schema, **out)

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text")).filter("node IS NOT NULL") \
        .mapInArrow(compress, "node long, packed binary")
    return texts.join(nodes.hint("merge"), "node").select("node", "s1", "s2", "packed").mapInArrow(sets, "node long, s1 long, s2 long, shingles binary")


def _orders(classes: DataFrame) -> DataFrame:
    """(gid, rank, halo, tree, region, node, s1, s2, dense) of the classes that share at least ``MIN_DEPTH`` columns with a neighbour in an order.

    Every order is sorted by range over all tasks and cut into chunks; a chunk gets the ``WINDOW`` rows before it as well (``halo``), so
    neighbours across a border are neighbours. Rows of a stretch in which some are farther apart than the window are ``dense``.
    """
    twice = F.concat("sig", "sig")
    heads = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring(twice, t * _TURN * _WIDTH + 1, SORTED * _WIDTH).alias("head")) for t in range(N_TREES)]))
    rows = classes.select(heads.alias("o"), "node", "s1", "s2").select("o.tree", "o.head", "node", "s1", "s2")
    ranked = global_rank(rows, [F.col(c) for c in ("tree", "head", "node", "s1", "s2")], "rank")
    chunk, at = F.floor((F.col("rank") - 1) / CHUNK), (F.col("rank") - 1) % CHUNK
    here = F.array(F.struct(chunk.alias("gid"), F.lit(False).alias("halo")))
    both = F.concat(here, F.array(F.struct((chunk + 1).alias("gid"), F.lit(True).alias("halo"))))
    dealt = ranked.select("rank", "tree", "head", "node", "s1", "s2", F.explode(F.when(at >= CHUNK - WINDOW, both).otherwise(here)).alias("g")) \
        .select("g.gid", "rank", "g.halo", "tree", "head", "node", "s1", "s2")

    def stretches(batches):
        for t in _by_gid(batches):
            head = np.frombuffer(b"".join(t.column("head").to_pylist()), ">u2").reshape(-1, SORTED)
            tree = t.column("tree").to_numpy()
            shares = np.concatenate(([False], (head[1:, :MIN_DEPTH] == head[:-1, :MIN_DEPTH]).all(1) & (tree[1:] == tree[:-1]), [False]))
            n = np.arange(len(tree))
            start = np.maximum.accumulate(np.where(shares[:-1], 0, n))
            far = np.flatnonzero(n - start >= WINDOW)
            dense = np.zeros(len(tree), bool)
            dense[far] = dense[far - WINDOW] = True
            kept = np.flatnonzero(shares[:-1] | shares[1:])
            if len(kept):
                out = t.take(pa.array(kept)).drop_columns(["head"]).append_column("dense", pa.array(dense[kept]))
                yield from out.combine_chunks().to_batches()

    kinds = "gid long, rank long, halo boolean, tree int, node long, s1 long, s2 long, dense boolean"
    return materialize(dealt.repartition("gid").sortWithinPartitions("gid", "rank").mapInArrow(stretches, kinds), "forest_members")


def _window_pairs(window: int, sig: np.ndarray, tree: np.ndarray, halo: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Index pairs of a chunk to be looked at: neighbours in the order up to ``window`` apart, longest common prefix first.

    In a stretch of more classes than the window holds, what stands within it are those with the deepest prefixes. A pair that an
    earlier order has brought together is left out, unless both are dense (that order's window may have been too small).
    """
    n = len(sig)
    turned = sig[np.arange(n)[:, None], (tree[:, None] * _TURN + np.arange(N_HASHES)) % N_HASHES]
    step = turned[1:] == turned[:-1]
    prefix = np.concatenate(([0], np.where(step.all(1), N_HASHES, step.argmin(1)) * (tree[1:] == tree[:-1])))  # with the row before
    least, found = np.full(n, N_HASHES), []
    for d in range(1, min(window, n - 1) + 1):
        least[d:] = np.minimum(least[d:], prefix[1:n - d + 1])
        b = np.flatnonzero(least >= MIN_DEPTH)
        b = b[b >= d]
        if not len(b):
            break
        b = b[~halo[b]]
        a = b - d
        eq = sig[a] == sig[b]
        fits = eq.sum(1) >= MIN_AGREE
        early = eq.reshape(len(b), N_TREES, _TURN).all(2).argmax(1) < tree[b]
        fits &= ~early | (dense[a] & dense[b])
        found.append(np.column_stack([a, b, least[b]])[fits])
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return pairs[np.argsort(-pairs[:, 2], kind="stable"), :2]


def _block_pairs(sig: np.ndarray, side: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Index pairs of classes in different components, one on each side of the block."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return np.zeros((0, 2), np.int64)
    fits = ((sig[a][:, None, :] == sig[b][None, :, :]).sum(-1) >= MIN_AGREE) & (component[a][:, None] != component[b][None, :])
    i, j = np.nonzero(fits)
    return np.column_stack([a[i], b[j]])


def _by_gid(batches):
    """Groups of rows with one gid, from batches sorted by it, as tables."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        gid = t.column("gid").to_numpy()
        cuts = np.flatnonzero(gid[1:] != gid[:-1]) + 1
        if held and held[-1].column("gid")[0].as_py() != gid[0]:
            yield pa.concat_tables(held)
            held = []
        at = 0
        for c in cuts.tolist():
            yield pa.concat_tables([*held, t.slice(at, c - at)])
            held, at = [], c
        held.append(t.slice(at))
    if held:
        yield pa.concat_tables(held)


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, N_HASHES).astype(np.uint16)


_ROWS = "gid long, rank long, halo boolean, tree int, node long, s1 long, s2 long, sig binary, dense boolean, side int, component long"


def _pairs(t: pa.Table, window: int) -> np.ndarray:
    sig, tree = _sig_matrix(t.column("sig")), t.column("tree").to_numpy()
    if tree[0] < 0:
        return _block_pairs(sig, t.column("side").to_numpy(), t.column("component").to_numpy())
    return _window_pairs(window, sig, tree, *(t.column(c).to_numpy(zero_copy_only=False) for c in ("halo", "dense")))


def _candidates(groups: DataFrame) -> DataFrame:
    """The rows of ``groups`` that have at least one pair to be looked at in their group."""
    window = WINDOW

    def run(batches):
        for t in _by_gid(batches):
            if t.num_rows > 1:
                p = _pairs(t, window)
                if len(p):
                    yield from t.take(pa.array(np.unique(p))).combine_chunks().to_batches()

    rows = groups.select(*[c.split()[0] for c in _ROWS.split(", ")])
    return materialize(rows.repartition("gid").sortWithinPartitions("gid", "rank").mapInArrow(run, _ROWS), "forest_groups")


def _confirm(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one group, confirmed on the full sets: a spanning forest of each group's links."""
    window = WINDOW

    def links(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in _by_gid(batches):
            node = t.column("node").to_pylist()
            packed, sets = t.column("shingles").to_pylist(), {}
            parent = list(range(len(node)))

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            a, b = [], []
            for i, j in _pairs(t, window).tolist():
                x, y = root(i), root(j)
                small, large = sorted((len(packed[i]) // 6, len(packed[j]) // 6))
                if x == y or 100 * small < percent * large:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = unpack_set(packed[k])
                both = overlap(sets[i], sets[j])
                if 100 * both >= percent * (small + large - both):
                    parent[x] = y
                    a.append(node[i])
                    b.append(node[j])
            if a:
                yield batch(schema, a=a, b=b)

    full = rows.join(sets, ["node", "s1", "s2"]).select("gid", "rank", "halo", "tree", "node", "sig", "dense", "side", "component", "shingles")
    return full.repartition("gid").sortWithinPartitions("gid", "rank").mapInArrow(links, "a long, b long")


def _rest(dense: DataFrame, classes: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Groups for what the windows of dense stretches may have missed, by prefix filtering of the sets.

    Two sets as similar as ``percent`` share one of each one's first n - ceil(percent n) + 1 shingles, in any order of all shingles. Those that
    few sets hold come first, so groups by shingle are small even where most texts share a long passage. In a group, what is outside its
    largest component is compared with all of it, block by block; groups of one component are done.
    """
    placed = dense.join(found, "node", "left").select("node", "s1", "s2", F.coalesce("component", "node").alias("component"))

    def tokens(batches):
        schema = pa.schema([("node", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("token", pa.int64())])
        for b in batches:
            for i in range(b.num_rows):
                token = unpack_set(b.column("shingles")[i].as_py()).view(np.int64)
                yield batch(schema, **{c: [b.column(c)[i].as_py()] * len(token) for c in ("node", "s1", "s2", "component")}, n=[len(token)] * len(token), token=token)

    held = placed.join(sets, ["node", "s1", "s2"]).select("node", "s1", "s2", "component", "shingles")
    held = materialize(held.mapInArrow(tokens, "node long, s1 long, s2 long, component long, n long, token long"), "forest_tokens")
    common = held.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > BLOCK).select("token", F.lit(1).alias("common"))
    order = F.row_number().over(Window.partitionBy("node", "s1", "s2").orderBy(F.coalesce("common", F.lit(0)), "token"))  # shingles of one text
    first = held.join(common, "token", "left").withColumn("nth", order).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    first = materialize(first.select("node", "s1", "s2", "component", "token"), "forest_first")
    parts = first.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("token").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("size")) \
        .select("token", F.col("m.component").alias("main"), "size", (F.col("size") - F.col("m.n")).alias("others")).filter("others > 0")
    met = first.join(main, "token").join(classes.select("node", "s1", "s2", "sig"), ["node", "s1", "s2"])
    blocks, other_blocks = F.ceil(F.col("size") / BLOCK), F.ceil(F.col("others") / BLOCK)
    own, other = F.pmod(F.xxhash64("node"), blocks), F.pmod(F.xxhash64(F.lit("other"), F.col("node")), other_blocks)
    row = ["token", "node", "s1", "s2", "sig", "component"]
    every = met.select(*row, F.lit(0).alias("side"), own.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), other_blocks - 1)).alias("o"))
    outside = met.filter(F.col("component") != F.col("main")).select(*row, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("g"), other.alias("o"))
    return every.unionByName(outside).select(F.xxhash64("token", "g", "o").alias("gid"), F.xxhash64("node", "s1").alias("rank"), F.lit(False).alias("halo"), F.lit(-1).alias("tree"),
                                             "node", "s1", "s2", "sig", F.lit(True).alias("dense"), "side", "component")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text, ...)."""
    sigs = materialize(signatures(docs), "forest_signatures")
    named = sigs.filter(F.col("s1").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(named.groupBy("s1", "s2").agg(F.min_by("sig", "doc_id").alias("sig"), F.min("doc_id").alias("node")), "forest_classes")
    members = _orders(classes)
    crowded = materialize(members.filter("dense").select("node", "s1", "s2").distinct(), "forest_dense")
    marked = classes.join(crowded.withColumn("dense", F.lit(True)), ["node", "s1", "s2"], "left").select("node", "s1", "s2", "sig", F.coalesce("dense", F.lit(False)).alias("dense"))
    groups = members.drop("dense").join(marked, ["node", "s1", "s2"]).withColumns({"side": F.lit(0), "component": F.lit(0).cast("long")})
    rows = _candidates(groups)
    # one pass over the texts serves both phases
    needed = rows.select("node", "s1", "s2").union(crowded).distinct()
    sets = materialize(_sets(docs, needed), "forest_sets")
    links = materialize(_confirm(rows, sets, percent), "forest_links")
    found = components(links)
    if not crowded.isEmpty():
        more = materialize(_confirm(_candidates(_rest(crowded, classes, sets, found, percent)), sets, percent), "forest_links")
        found = components(links.union(more))
    # rows of one doc_id are linked: their classes may differ in name only if another class is smaller
    shared = named.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).filter("x != y")
    if not shared.isEmpty():
        alias = named.join(shared.select("doc_id"), "doc_id", "left_semi").join(classes.select("s1", "s2", "node"), ["s1", "s2"])
        same = alias.groupBy("doc_id").agg(F.min("node").alias("a")).join(alias.select("doc_id", F.col("node").alias("b")), "doc_id").select("a", "b")
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same))
    place = materialize(classes.select("s1", "s2", "node").join(found, "node", "left")
                        .select("s1", "s2", F.coalesce("component", "node").alias("component_id")), "forest_components")
    rows = sigs.select("doc_id", "n_shingles", "s1", "s2")
    return rows.join(place, ["s1", "s2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with the same columns."""
    gone = materialize(near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "forest_gone")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))
    d = d.join(gone, d["doc_id"] == gone["gone"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    named = d.filter(F.col("doc_id").isNotNull()).withColumn("nth", first).filter("nth = 1").select("row.*")
    return named.unionByName(d.filter(F.col("doc_id").isNull()).select("row.*"))
