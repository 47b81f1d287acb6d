"""URL verdicts by rules, and by the standing of a host in the link graph where no rule fits.

A rule is (verdict, host, path): it fits its host and all subdomains where the path begins with the rule's; the longest rule wins (host and path
together; then the longer host; of contradicting ones, block).

Host graph: a host links the hosts that its pages name in ``href`` and ``src`` (a page counts once for each) and, both ways, the domain one label
up, as long as that has two labels. Seeds come from the rules: a host's share of pages that rules allow is its trust, the
share that they block its distrust. Personalised PageRank carries trust along the links, and distrust against them, from a blocked
host to those that link it; a host without links keeps what it has. So both are shares again, averaged over where links come from,
and a host is blocked where distrust exceeds trust by more than ``THRESHOLD``. Rounds go on until all hosts together change by
less than ``TOLERANCE`` of the seeds' mass.

Scale: texts are read once, for links, in built-in expressions; pages are reduced to (host, first characters of the path) before rules are
looked up, by joins on equal keys; the graph has a row per host and per linked pair, and per round one join and one aggregate that combine before the shuffle.
Nothing but a few numbers comes to the driver.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule, is no node and is allowed; null html has no links; repeated pages and
null ids give a row each; very long hosts are looked up by the ends that are as long as some rule's host; an empty table gives no rows; without rules
all is allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigil.llm.text import ascii_lower
from vigil.session import materialize

DAMPING = 0.7
TOLERANCE = 1e-4
THRESHOLD = 0.5
ROUNDS_A_WRITE = 4
DIGITS = 3  # of a rank that are compared
MAX_HOST = 253  # characters of a domain name; what is longer is no node
# fixed values: the stated rules
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

_LINK = r"""(?i)(?:href|src)\s*+=\s*+["']?+\s*+(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)"))
    return (F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, cut, rule, rule_verdict) for the places (host, cut) that a rule fits."""
    longest = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("n_host"), (F.col("verdict") == "block").alias("block"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" after "allow"
    n_host = rules.agg(F.max(F.length("host"))).first()[0] or 0
    end = F.expr(f"substring(host, -{n_host + 1}, {n_host + 1})")
    pieces = F.split(end, r"\.", -1)  # after each dot begins a domain
    domains = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, k + 1, F.size(pieces)), "."))
    domains = F.when(F.size(pieces) > 1, domains).otherwise(F.array().cast("array<string>"))
    domains = F.when(F.length("host") <= n_host, F.array_append(domains, F.col("host"))).otherwise(domains)
    ends = places.select("host", "cut", F.explode(F.array_distinct(domains)).alias("domain"))
    lengths = rules.select(F.col("host").alias("domain"), F.length("path").alias("n_path")).distinct()
    keys = ends.join(lengths, "domain").filter(F.length("cut") >= F.col("n_path")).select("host", "cut", "domain", F.expr("left(cut, n_path)").alias("prefix"))
    found = rules.select(F.col("host").alias("domain"), F.col("path").alias("prefix"), F.concat("host", "path").alias("rule"), "verdict", longest.alias("order"))
    best = keys.join(found, ["domain", "prefix"]).groupBy("host", "cut").agg(F.max(F.struct("order", "rule", "verdict")).alias("best"))
    return best.select("host", "cut", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of src that link dst, and 1 more between a host and the domain above it. ``pages`` has ``host`` and ``html``."""
    named = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), ascii_lower))
    links = pages.filter(_is_node("host")).select(F.col("host").alias("src"), F.explode(named).alias("dst")).filter(_is_node("dst") & (F.col("src") != F.col("dst"))) \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    links = materialize(links, "host_links")
    hosts = pages.filter(_is_node("host")).select("host").union(links.select("dst")).distinct()
    labels = F.split("host", r"\.", -1)

    def end(k: Column) -> Column:
        return F.array_join(F.slice(labels, k, F.size(labels)), ".")

    steps = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(end(k).alias("src"), end(k + 1).alias("dst"))))
    up = hosts.select(F.explode(steps).alias("s")).select("s.src", "s.dst").filter("src != '' AND dst != ''").distinct()
    both = up.union(up.select("dst", "src")).withColumn("weight", F.lit(1).cast("long"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _is_node(host: str) -> Column:
    return F.length(host).between(1, MAX_HOST)


def host_ranks(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust) of every host of ``seeds`` (host, trust, distrust) and ``links``."""
    links = materialize(links, "host_graph")
    hosts = links.select(F.col("src").alias("host")).union(links.select("dst")).union(seeds.select("host")).distinct()
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.coalesce("trust", F.lit(0.0)).alias("seed")),
                              F.struct(F.lit("distrust").alias("kind"), F.coalesce("distrust", F.lit(0.0)).alias("seed")))).alias("k")
    nodes = materialize(hosts.join(seeds, "host", "left").select("host", kinds).select("host", "k.kind", "k.seed"), "host_seeds")
    # trust goes from src to dst, distrust from dst to src, each by its share of the giver's weight
    ways = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("taker")),
                             F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("taker")))).alias("w")
    moves = links.select(ways, "weight").select("w.*", "weight")
    total = moves.groupBy("kind", "giver").agg(F.sum("weight").alias("total"))
    moves = moves.join(total, ["kind", "giver"]).select("kind", F.col("giver").alias("host"), "taker", (F.col("weight") / F.col("total")).alias("share"))
    alone = nodes.join(moves.select("host", "kind").distinct(), ["host", "kind"], "left_anti").select("kind", "host", F.col("host").alias("taker"), F.lit(1.0).alias("share"))
    moves = moves.union(alone).withColumn("own", F.lit(0))
    # one more row per node carries its seed and last rank along, so that a round is one join and one aggregate
    own = nodes.select("kind", "host", F.col("host").alias("taker"), F.lit(0.0).alias("share"), F.lit(1).alias("own"))
    moves = materialize(moves.union(own), "host_moves")
    state, mass = nodes.select("host", "kind", F.col("seed").alias("rank"), "seed"), nodes.agg(F.sum("seed")).first()[0] or 0.0
    rank = DAMPING * F.col("rank") * F.col("share") + (1 - DAMPING) * F.col("seed") * F.col("own")
    changed, step = mass, 0
    while changed > TOLERANCE * mass:
        for _ in range(ROUNDS_A_WRITE):
            given = state.join(moves, ["host", "kind"]).select(F.col("taker").alias("host"), "kind", rank.alias("rank"), (F.col("seed") * F.col("own")).alias("seed"),
                                                               (F.col("rank") * F.col("own")).alias("old"))
            state = given.groupBy("host", "kind").agg(*[F.sum(c).alias(c) for c in ("rank", "seed", "old")])
        seen, step = Observation(f"host_ranks_{step}"), step + 1
        state = materialize(state.observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("changed")), "host_ranks").drop("old")
        changed = seen.get["changed"] or 0.0
    return state.groupBy("host").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) per page; the last two are its host's."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rules = materialize(rules, "url_rules")
    n_path = rules.agg(F.max(F.length("path"))).first()[0] or 0
    cut = F.expr(f"left(path, {n_path})")
    places = materialize(read.groupBy("host", cut.alias("cut")).agg(F.count(F.lit(1)).alias("pages")), "url_places")
    ruled = materialize(places.join(match_rules(places, rules), ["host", "cut"], "left"), "url_ruled")

    def share(verdict: str) -> Column:
        return (F.sum(F.when(F.col("rule_verdict") == verdict, F.col("pages")).otherwise(0)) / F.sum("pages")).alias({"allow": "trust", "block": "distrust"}[verdict])

    seeds = ruled.filter(_is_node("host")).groupBy("host").agg(share("allow"), share("block"))
    ranks = host_ranks(seeds, host_links(read))
    verdict = F.when(F.round(F.col("distrust") - F.col("trust"), DIGITS) > THRESHOLD, "block").otherwise("allow")
    known = materialize(ruled.join(ranks, "host", "left").withColumn("verdict", F.coalesce("rule_verdict", verdict)).drop("rule_verdict", "pages"), "url_verdicts")
    return read.drop("html").withColumn("cut", cut).join(known, ["host", "cut"]).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def url_digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")


# The rounds number more than the tolerance asks for.
ORACLE = r"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES @RULES@),
ruled AS (
  SELECT host, path, rule, verdict FROM (
    SELECT q.host, q.path, h || p AS rule, verdict, row_number() OVER (PARTITION BY q.host, q.path ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS k
    FROM (SELECT DISTINCT host, path FROM parsed) q JOIN rules ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, p)) WHERE k = 1),
judged AS MATERIALIZED (SELECT p.page_id, p.host, p.path, r.rule, r.verdict FROM parsed p LEFT JOIN ruled r ON p.host = r.host AND p.path = r.path),
seeds AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0.0 END) AS trust, avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0.0 END) AS distrust
  FROM judged WHERE length(host) BETWEEN 1 AND 253 GROUP BY host),
named AS (
  SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''),
    '(?i)(?:href|src)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst
  FROM parsed WHERE length(host) BETWEEN 1 AND 253),
links AS (SELECT src, dst, count(*) AS weight FROM named WHERE src <> dst AND length(dst) BETWEEN 1 AND 253 GROUP BY src, dst),
hosts AS (SELECT host FROM seeds UNION SELECT dst FROM links),
labels AS (SELECT string_split(host, '.') AS l FROM hosts),
up AS (
  SELECT DISTINCT array_to_string(l[k:], '.') AS src, array_to_string(l[k + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels)
  WHERE array_to_string(l[k:], '.') <> '' AND array_to_string(l[k + 1:], '.') <> ''),
graph AS (
  SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY src, dst),
nodes AS MATERIALIZED (
  SELECT h.host, kind, CASE WHEN kind = 'trust' THEN coalesce(trust, 0) ELSE coalesce(distrust, 0) END AS seed
  FROM (SELECT src AS host FROM graph UNION SELECT dst FROM graph UNION SELECT host FROM seeds) h LEFT JOIN seeds s ON s.host = h.host, (VALUES ('trust'), ('distrust')) AS k(kind)),
ways AS (SELECT 'trust' AS kind, src AS giver, dst AS taker, weight FROM graph UNION ALL SELECT 'distrust', dst, src, weight FROM graph),
moves AS MATERIALIZED (
  SELECT kind, giver, taker, weight::DOUBLE / sum(weight) OVER (PARTITION BY kind, giver) AS share FROM ways
  UNION ALL SELECT kind, host, host, 1.0 FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.kind = n.kind AND w.giver = n.host)),
rounds AS (
  SELECT 0 AS step, host, kind, seed AS rank FROM nodes
  UNION ALL
  SELECT g.step, n.host, n.kind, @DAMPING@ * g.got + (1 - @DAMPING@) * n.seed
  FROM nodes n JOIN (SELECT r.step + 1 AS step, m.taker, m.kind, sum(r.rank * m.share) AS got FROM rounds r JOIN moves m ON m.giver = r.host AND m.kind = r.kind
                     WHERE r.step < 100 GROUP BY r.step, m.taker, m.kind) g ON g.taker = n.host AND g.kind = n.kind),
ranks AS (
  SELECT host, max(rank) FILTER (kind = 'trust') AS trust, max(rank) FILTER (kind = 'distrust') AS distrust FROM rounds WHERE step = 100 GROUP BY host)
SELECT page_id, j.host, path, rule,
       coalesce(verdict, CASE WHEN round(coalesce(distrust, 0) - coalesce(trust, 0), 3) > @THRESHOLD@ THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN ranks r ON r.host = j.host
""".replace("@RULES@", ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)).replace("@DAMPING@", str(DAMPING)).replace("@THRESHOLD@", str(THRESHOLD))
