"""A Merkle manifest of a dataset: a leaf per row, a tree per key (language), a tree over the keys' roots, a proof per row.

Rows are numbered within their key by a range sort, and cut into aligned blocks of ``fanout ** BLOCK_LEVELS`` leaves. A block hashes its
own subtree. Then the blocks exchange: in each round the blocks of ``fanout`` neighbouring subtrees that stand at the same place
in their subtrees swap the subtrees' roots, and each of them hashes the parent for itself. A round is one shuffle of a
row per block. When one node remains, every block holds the upper part of its proofs, the key's root and the dataset's root, so nothing is
sent down. Where a subtree has fewer blocks than its neighbours, its blocks answer for several places in turn. The keys' roots
are nodes of further rounds of the same kind. Last, each block hashes its subtree again for the lower part of its rows' proofs.

Digests are lowercase hex SHA-256; a node is the digest of its children's hex text, the last run of a level may have fewer children, even one.

Scale: texts are hashed where they are read, only (key, order, leaf) is shuffled: once by range, twice by block; a block is at most 4,096 rows; a
round has a row per block and the number of rounds is logarithmic. A key that holds most rows is many blocks.

Cases: null key is a key of its own, before the others; null fields hash as ``-``; a null doc_id comes first; rows with equal key and doc_id stand in the order
of their leaves, and equal rows get the proofs of their places, in any order; a very long text is hashed as one value; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.graph import global_rank
from vigil.session import materialize

FANOUT = 2
BLOCK_LEVELS = 12
STEP = "struct<before: array<string>, after: array<string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: Iterable[Column]) -> Column:
    """Each field as its UTF-8 byte count, a colon and its value, or ``-`` if null; together one SHA-256."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def _hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def subtree(leaves: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The levels of a tree from its leaves up: ``levels`` of them, or until one node remains."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append([_hash(out[-1][k:k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def _levels(n: int, fanout: int, block_levels: int) -> int | None:
    """A block of a key with ``n`` leaves is ``block_levels`` high, unless it is the key's only one."""
    return block_levels if n > fanout ** block_levels else None


def _number(leaves: DataFrame) -> DataFrame:
    """Adds ``pos`` (place within the key, from 0) and ``n`` (rows of the key). One written table, sorted by range."""
    order = [F.col("key"), F.col("doc_id"), F.col("leaf"), F.col("_row")]
    placed = materialize(leaves.withColumn("_row", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()), "manifest_leaves")
    placed = placed.withColumn("_pid", F.shiftright("_at", 33)).drop("_row")
    parts = placed.groupBy("key", "_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))  # rows: partitions + keys
    w = Window.partitionBy("key")
    running = F.sum("_rows").over(w.orderBy("_pid"))
    parts = parts.select("key", "_pid", (running - F.col("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(w).alias("n"))
    return placed.join(parts, ["key", "_pid"]).select("key", "doc_id", "leaf", *[c for c in leaves.columns if c not in ("key", "doc_id", "leaf")],
                                                      (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _block_roots(rows: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        top = subtree(table.column("leaf").to_pylist(), fanout, _levels(n, fanout, block_levels))[-1]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [n], top], schema=schema)

    return rows.select("key", "part", "pos", "n", "leaf").groupBy("key", "part").applyInArrow(run, "key string, part long, n long, digest string")


def _exchange(state: DataFrame, fanout: int) -> DataFrame:
    """One round. ``state``: a row per block with its node on this level (``tree``, ``node``), its place among the node's ``cnt`` blocks (``off``), the
    number of places in its group (``width``), the node's ``digest`` and the block's own ``me`` and ``path``. Returns the same for the parents, without ``width``.
    """
    slots = F.explode(F.sequence("off", F.col("width") - 1, "cnt"))
    sent = state.select("tree", "node", "off", "cnt", "digest", F.floor(F.col("node") / fanout).alias("parent"), F.struct("me", "path").alias("own"), slots.alias("slot"))
    member = F.struct("node", "cnt", "digest", F.when(F.col("slot") == F.col("off"), F.col("own")).alias("own"))
    met = sent.groupBy("tree", "parent", "slot").agg(F.array_sort(F.collect_list(member)).alias("members"))  # at most fanout of them
    digests = F.transform("members", lambda m: m["digest"])
    met = met.select("tree", "parent", "slot", "members", digests.alias("digests"), F.sha2(F.array_join(digests, ""), 256).alias("digest"),
                     F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + m["cnt"]).alias("cnt"))
    each = met.select("*", F.posexplode("members").alias("at", "m")).filter(F.col("m.own").isNotNull())
    step = F.struct(F.slice("digests", F.lit(1), F.col("at")).alias("before"), F.slice("digests", F.col("at") + 2, F.size("digests")).alias("after"))
    before = F.aggregate(F.slice("members", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, m: a + m["cnt"])
    return each.select("tree", F.col("parent").alias("node"), (F.col("slot") + before).alias("off"), "cnt", "digest", F.col("m.own.me").alias("me"),
                       F.concat("m.own.path", F.array(step)).alias("path"))


def _within_keys(blocks: DataFrame, fanout: int) -> DataFrame:
    """(key, part, parts, path, subroot) per block, after the rounds within keys."""
    most = blocks.agg(F.max("parts")).first()[0] or 0
    state = blocks.select(F.col("key").alias("tree"), F.struct("part", "parts").alias("me"), "digest", F.lit(None).cast(f"array<{STEP}>").alias("path")) \
        .withColumn("path", F.coalesce("path", F.array().cast(f"array<{STEP}>")))
    step = 1  # blocks under a node
    while step < most:
        part, parts = F.col("me.part"), F.col("me.parts")
        node = F.floor(part / step)
        more = state.filter(parts > step).withColumns({"node": node, "off": part % step, "cnt": F.least(F.lit(step).cast("long"), parts - node * step)})
        alone = F.floor(node / fanout) * fanout * step + step >= parts  # the only node of its group
        met = _exchange(more.withColumn("width", F.when(alone, F.col("cnt")).otherwise(F.lit(step).cast("long"))), fanout)
        state = materialize(met.select(*state.columns).unionByName(state.filter(parts <= step)), "manifest_round")
        step *= fanout
    return state.select(F.col("tree").alias("key"), "me.part", "me.parts", "path", F.col("digest").alias("subroot"))


def _across_keys(blocks: DataFrame, fanout: int) -> DataFrame:
    """(key, part, path, subroot, root) per block, after the rounds over keys in order."""
    keys = materialize(global_rank(blocks.filter("part = 0").select("key"), [F.col("key")], "rank"), "manifest_keys")
    n_nodes = keys.count()
    state = blocks.join(keys, "key").select(F.lit(0).alias("tree"), (F.col("rank") - 1).alias("node"), F.col("part").alias("off"), F.col("parts").alias("cnt"),
                                            F.col("subroot").alias("digest"), F.struct("key", "part", "subroot").alias("me"), "path")
    while n_nodes > 1:
        parent = F.floor(F.col("node") / fanout)
        widths = state.filter("off = 0").groupBy(parent.alias("parent")).agg(F.max("cnt").alias("width"))  # a row per node
        state = materialize(_exchange(state.withColumn("parent", parent).join(widths, "parent").drop("parent"), fanout), "manifest_round")
        n_nodes = -(-n_nodes // fanout)
    return state.select("me.key", "me.part", "path", "me.subroot", F.col("digest").alias("root"))


def manifest(docs: DataFrame, key: str = "lang", extra: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, key, leaf, the columns of ``extra``, subroot, root, proof) per row of ``docs``.

    ``proof`` has a step per level from the leaf up, with the digests before and after in its run; ``fold`` recomputes the root from it.
    """
    extra = extra or {}
    more = [f"x_{name}" for name in extra]
    marked = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # null first, then bytewise
    leaves = docs.select(marked.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col(c) for c in FIELDS).alias("leaf"),
                         *[c.alias(f"x_{name}") for name, c in extra.items()])
    size = fanout ** block_levels
    rows = _number(leaves).withColumn("part", F.floor(F.col("pos") / size))
    blocks = materialize(_block_roots(rows, fanout, block_levels).withColumn("parts", F.ceil(F.col("n") / size)), "manifest_blocks")
    upper = _across_keys(_within_keys(blocks, fanout), fanout)
    schema = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.string()), *[(f"x_{name}", pa.string()) for name in extra],
                        ("subroot", pa.string()), ("root", pa.string()),
                        ("proof", pa.list_(pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])))])

    def run(place: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        levels = subtree(table.column("leaf").to_pylist(), fanout, _levels(table.column("n")[0].as_py(), fanout, block_levels))
        path, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        proofs = []
        for k in range(table.num_rows):
            steps = []
            for level in levels[:-1]:
                first = k - k % fanout
                steps.append({"before": level[first:k], "after": level[k + 1:first + fanout]})
                k //= fanout
            proofs.append(steps + path)
        same = [pa.repeat(pa.scalar(x, pa.string()), table.num_rows) for x in (subroot, root)]
        return pa.table([*[table.column(c) for c in ("key", "doc_id", "leaf", *more)], *same, pa.array(proofs, schema.field("proof").type)], schema=schema)

    types = f"key string, doc_id long, leaf string, {''.join(f'x_{name} string, ' for name in extra)}subroot string, root string, proof array<{STEP}>"
    proved = rows.drop("part").withColumn("part", F.floor(F.col("pos") / size)).groupBy("key", "part").cogroup(upper.groupBy("key", "part")).applyInArrow(run, types)
    return proved.select("doc_id", F.when(F.col("key") != "", F.substring("key", 2, 2 ** 31 - 1)).alias(key), "leaf", *[F.col(f"x_{name}").alias(name) for name in extra],
                         "subroot", "root", "proof")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(F.array_join(s["before"], ""), h, F.array_join(s["after"], "")), 256))


def audit_digest(docs: DataFrame) -> DataFrame:
    """Each row's leaf, roots and proof, and the root recomputed after a stated tampering: n_chars plus 1 where 7 divides the checksum of doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(hit, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    given = F.when(hit, digest(changed if c == "n_chars" else F.col(c) for c in FIELDS))
    rows = manifest(docs, extra={"given": given})
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: F.concat(s["before"], s["after"]))), "")
    folded = F.when(F.col("given").isNull(), fold(F.col("leaf"), F.col("proof"))).otherwise(fold(F.col("given"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE bytes AS (
  SELECT DISTINCT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS b FROM documents),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) AS crc
  FROM bytes),
given AS (
  SELECT d.doc_id, d.lang,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS more_chars,
    coalesce(strlen(text) || ':' || text, '-') AS tail, crc % 7 = 0 AS hit
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
hashed AS (
  SELECT doc_id, lang, sha256(head || chars || tail) AS leaf, CASE WHEN hit THEN sha256(head || more_chars || tail) ELSE sha256(head || chars || tail) END AS start FROM given),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
leaves AS MATERIALIZED (
  SELECT doc_id, tree, leaf, start, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed h JOIN langs l ON h.lang IS NOT DISTINCT FROM l.lang),
nodes AS (
  SELECT tree, 0 AS lvl, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 2, n),
low AS MATERIALIZED (SELECT * FROM nodes),
tops AS (
  SELECT 0 AS lvl, tree AS idx, h, (SELECT count(*) FROM langs) AS n FROM low WHERE n = 1
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n),
high AS MATERIALIZED (SELECT * FROM tops),
climb AS (
  SELECT doc_id, tree, leaf, idx AS first, idx, 0 AS lvl, n, start AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.first, c.idx // 2, c.lvl + 1, (c.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN c.h WHEN c.idx % 2 = 0 THEN c.h || s.h ELSE s.h || c.h END), c.proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN low s ON s.tree = c.tree AND s.lvl = c.lvl AND s.idx = xor(c.idx, 1) WHERE c.n > 1),
keyed AS (
  SELECT c.doc_id, c.tree, c.leaf, c.first, c.tree AS idx, 0 AS lvl, (SELECT count(*) FROM langs) AS n, c.h, c.proof FROM climb c WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.first, c.idx // 2, c.lvl + 1, (c.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN c.h WHEN c.idx % 2 = 0 THEN c.h || s.h ELSE s.h || c.h END), c.proof || coalesce(s.h, '')
  FROM keyed c LEFT JOIN high s ON s.lvl = c.lvl AND s.idx = xor(c.idx, 1) WHERE c.n > 1)
SELECT k.doc_id, k.leaf, l.h AS subroot, r.h AS root, sha256(k.proof) AS proof_sha256, k.h AS folded_root, k.h = r.h AS verified
FROM keyed k JOIN (SELECT tree, h FROM low WHERE n = 1) l ON l.tree = k.tree, (SELECT h FROM high WHERE n = 1) r
WHERE k.n = 1
"""
