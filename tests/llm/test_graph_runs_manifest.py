"""URL verdicts over a host graph, word runs and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.llm import link_graph, manifest, runs

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- word runs ------------------------------------------------------------------------

def runs_brute(w, min_length):
    """Every maximal stretch of period p, two periods long or more, with its smallest period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - a >= 2 * p:
                found.setdefault((a, i + p - a), p)
    return sorted(((a, n, p) for (a, n), p in found.items() if n >= min_length), key=lambda x: (x[0], x[2]))


def random_words(rng, n):
    k = rng.choice([1, 2, 2, 3, 6])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        w = w[:a] + [w[a + j % p] for j in range(n - a)]
    return w


def test_runs_equal_brute_force_however_they_are_appended(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        texts = [random_words(rng, rng.randint(0, 70)) for _ in range(rng.randint(1, 8))]
        least = rng.choice([2, 4, 12])
        monkeypatch.setattr(runs, "PACK", rng.choice([1, 60, 10_000]))
        got = runs.runs_of_many(texts, least, chunk=rng.choice([1, 2, 3, 7, 50, 1000]))
        assert [list(map(tuple, g.tolist())) for g in got] == [runs_brute(w, least) for w in texts]


def test_runs_are_reported_while_words_are_appended():
    c = runs.Catchers(100)
    import numpy as np

    seen = []
    for x in [9, 8] + [1, 2, 3] * 4 + [7, 7]:
        c.append(np.array([x]))
        square = c.end - c.start >= 2 * c.period
        seen.append(sorted(zip(c.start[square].tolist(), c.period[square].tolist(), strict=True)))
    assert seen[7] == [(2, 3)] and seen[6] == []  # the square 123123 is known with its sixth word
    assert (2, 12, 3) in map(tuple, c.finish().tolist())


def test_runs_of_special_words():
    t = [0]
    for _ in range(11):
        t += [1 - x for x in t]
    assert list(map(tuple, runs.runs_of(t[:700], 2).tolist())) == runs_brute(t[:700], 2)  # Thue and Morse: no overlaps
    assert all(n == 2 * p for _, n, p in runs.runs_of(t, 2).tolist())
    x, y = [0], [0, 1]
    while len(y) < 600:
        x, y = y, y + x
    assert list(map(tuple, runs.runs_of(y, 2).tolist())) == runs_brute(y, 2)
    assert runs.runs_of([b"a"] * 300_000).tolist() == [[0, 300_000, 1]]
    half = list(range(50_000))
    assert runs.runs_of(half + half + half[:7]).tolist() == [[0, 100_007, 50_000]]


def digest_brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_brute(w, 12)
    drop = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def test_run_digest(llm_spark, clashing, docs_rows):
    got = runs.run_digest(runs.find_runs(clashing, planted=True)).collect()
    want = {r[0]: digest_brute(r[0], r[1]) for r in docs_rows if len((r[1] or "").split()) < 3000}
    assert len(got) == len(docs_rows) and sum(r.n_runs > 0 for r in got) > 3
    assert all(tuple(r) == want[r.doc_id] for r in got if r.doc_id in want)


def test_run_digest_cases(llm_spark):
    rows = [(None, "a b " * 9), (None, None), (1, ""), (1, ""), (2, " \t\n"), (3, "é ü é ü é ü é ü é ü é ü"), (4, "x"), (-5, "Z z " * 8), (6, "q\x0bq\x0cq " * 6)]
    got = runs.run_digest(runs.find_runs(llm_spark.createDataFrame(rows, "doc_id long, text string"), planted=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digest_brute(*r) for r in rows), key=str)
    assert runs.find_runs(llm_spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = llm_spark.createDataFrame([(11, "many words of one run " * 60_000)], "doc_id long, text string")
    r = runs.find_runs(long).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 5)] and r.collapsed == "many words of one run"


# --- Merkle manifest --------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, add=0):
    n = None if r[4] is None else r[4] + add
    return H(*[field(x) for x in (r[0], r[3], r[2], n, r[1])])


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k:k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, k, fanout):
    for level in levels[:-1]:
        first = k - k % fanout
        yield level[first:k], level[k + 1:first + fanout]
        k //= fanout


def manifest_brute(rows, fanout):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) per row; rows are (doc_id, text, lang, source, n_chars)."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([leaf_of(r) for r in sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))], fanout) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs], fanout)
    out = []
    for j, x in enumerate(langs):
        for k, r in enumerate(sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))):
            path = [*path_of(trees[x], k, fanout), *path_of(top, j, fanout)]
            h = leaf_of(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for before, after in path:
                h = H(*before, h, *after)
            out.append((r[0], leaf_of(r), trees[x][-1][0], top[-1][0], H(*[s for b, a in path for s in b + a]), h, h == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 8 + ["de", "fr", "é", "Z", None, ""]
    rows = [(rng.randrange(3 * n), rng.choice([None, "", "text é", "t" * rng.randrange(300)]), rng.choice(langs), rng.choice([None, "s", "ß"]),
             rng.choice([None, 0, 7, 2 ** 63 - 1])) for _ in range(n)]
    return rows + rows[:5] * 3 + [(None, "no id", "en", "s", 4)] * 3 + [(None, None, None, None, None)]


@pytest.mark.parametrize(("fanout", "block_levels", "n"), [(2, 12, 60), (2, 1, 90), (2, 2, 43), (3, 1, 130), (2, 0, 21)])
def test_manifest(llm_spark, monkeypatch, fanout, block_levels, n):
    rows = manifest_rows(n, seed=n)
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.withColumns({c: F.lit("other") for c in ("key", "leaf", "part", "pos", "n", "digest", "root", "path", "x_given", "given")})
    build = manifest.manifest
    monkeypatch.setattr(manifest, "manifest", lambda d, **kw: build(d, fanout=fanout, block_levels=block_levels, **kw))
    got = sorted(map(tuple, manifest.audit_digest(docs).collect()), key=str)
    assert got == manifest_brute(rows, fanout)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_few_rows(llm_spark, no_docs):
    assert manifest.audit_digest(no_docs).count() == 0
    one = llm_spark.createDataFrame([(3, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = manifest.manifest(one).first()
    assert r.root == r.subroot == r.leaf == leaf_of((3, "x", "en", "s", 1)) and r.proof == []


def test_manifest_exchange_gives_every_block_every_upper_proof(llm_spark):
    """One hot key of many blocks beside keys of one: all blocks end with the same root, and their paths lead to it."""
    rows = [(k, f"t{k}", "en" if k % 10 else f"l{k % 70}", "s", k) for k in range(700)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = manifest.manifest(docs, block_levels=3)
    got = m.withColumn("again", manifest.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == 700 and len({r.root for r in got}) == 1 and all(r.again == r.root for r in got)


# --- URL verdicts -------------------------------------------------------------------------

def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(AZ), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path, rules):
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


def verdicts_brute(rows, rules, rounds=200):
    parsed = [(r[0], *parse(r[1]), r[2]) for r in rows]
    ruled = [rule_of(h, p, rules) for _, h, p, _ in parsed]
    node = lambda h: 1 <= len(h) <= 253
    weight, seeds = defaultdict(float), defaultdict(lambda: [0, 0, 0])
    for (_, host, _, html), (_, v) in zip(parsed, ruled, strict=True):
        if node(host):
            seeds[host][0] += 1
            seeds[host][1] += v == "allow"
            seeds[host][2] += v == "block"
            named = re.findall(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)""", html or "")
            for dst in {x.translate(AZ) for x in named}:
                if dst != host and node(dst):
                    weight[(host, dst)] += 1
    hosts = set(seeds) | {d for _, d in weight}
    for h in hosts:
        while h.count(".") >= 2:
            up = h.split(".", 1)[1]
            if h and up:
                for e in ((h, up), (up, h)):
                    weight[(*e, "tree")] = 1
            h = up
    graph = defaultdict(float)
    for e, w in weight.items():
        graph[e[:2]] += w
    hosts |= {x for e in graph for x in e}
    rank = {}
    for k in (1, 2):
        moves = [((a, b) if k == 1 else (b, a), w) for (a, b), w in graph.items()]
        out = defaultdict(float)
        for (a, _), w in moves:
            out[a] += w
        seed = {h: seeds[h][k] / seeds[h][0] if h in seeds and seeds[h][0] else 0.0 for h in hosts}
        r = dict(seed)
        for _ in range(rounds):
            nxt = {h: (1 - link_graph.DAMPING) * seed[h] + (link_graph.DAMPING * r[h] if not out[h] else 0) for h in hosts}
            for (a, b), w in moves:
                nxt[b] += link_graph.DAMPING * r[a] * w / out[a]
            r = nxt
        rank[k] = r
    by_host = {h: "block" if round(rank[2][h] - rank[1][h], link_graph.DIGITS) > link_graph.THRESHOLD else "allow" for h in hosts}
    return [(i, h, p, rule, v or by_host.get(h, "allow")) for (i, h, p, _), (rule, v) in zip(parsed, ruled, strict=True)]


LINKED = [
    (1, "http://good.com/x", '<a href="http://friend.org/a">x</a> <IMG SRC = //Pics.Friend.org/1.png>'), (2, "https://FRIEND.org/p?q#r", "<a href='/self'>"),
    (3, "http://bad.net/fr/1", None), (4, "http://bad.net/fr/2", ""), (5, "http://helper.org/a", '<a href="https://bad.net/fr/9">'),
    (6, "http://helper.org/b", '<a href=http://bad.net/x><a href="https://bad.net/y">'), (7, "http://helper.org", "<a href=//bad.net>"), (8, "http://lonely.org/z", "no link"),
    (9, None, "<a href=//bad.net>"), (10, "no scheme", "x"), (11, "://", ""), (12, "x://?q", None), (13, "http://www.example.com/en/a", ""), (14, "http://example.com/en/a", ""),
    (15, "http://EXAMPLE.com/en", ""), (16, "http://a.b.example.com/en/x?/y", ""), (17, "http://notexample.com/en/x", ""), (18, "http://.com/x", ""), (19, "http://x..com/", ""),
    (20, "http://deep.sub.bad.net/es/1#f", ""), (None, "http://bad.net/fr/1", None), (1, "http://good.com/x", "repeated"), (21, "http://u:p@Host.com:80/é?x", ""), (22, "a://b://c.net/es/", ""),
    (23, "http://" + "l." * 300 + "net/es/x", ""), (24, "http://" + "y" * 400 + ".org/", "<a href=//good.com>"), (25, "http://net/es/", ""), (26, "http://com", ""),
]


def test_url_verdicts(llm_spark):
    pages = llm_spark.createDataFrame(LINKED, "page_id long, url string, html string").repartition(3).withColumns(
        {c: F.lit("other") for c in ("host", "path", "rule", "verdict", "cut", "kind", "rank", "trust", "src", "dst")})
    judged = link_graph.judge_urls(pages, link_graph.rule_table(llm_spark, link_graph.RULES))
    got = sorted(map(tuple, link_graph.url_digest(judged).collect()), key=str)
    want = sorted(verdicts_brute(LINKED, link_graph.RULES), key=str)
    assert got == want
    by_id = {r[0]: r for r in want}
    assert by_id[5][3] is None and by_id[5][4] == "block" and by_id[2][4] == "allow" and by_id[8][4] == "allow"  # who links a blocked host, who is linked by a good one


def test_url_verdicts_on_random_graphs(llm_spark):
    rng = random.Random(4)
    for seed in range(2):
        hosts = [f"{a}{b}.{t}" for a in ("", "www.", "m.x.") for b in "abcdef" for t in ("com", "net", "example.org")]
        rows = [(k, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'es'])}/{k}", "".join(f'<a href="http://{rng.choice(hosts)}/">' for _ in range(rng.randrange(4))))
                for k in range(120)]
        rules = [("allow", "a.com", "/"), ("block", "b.com", "/"), ("block", "net", "/fr/"), ("allow", "net", "/fr/1"), ("block", "org", ""), ("allow", "org", "/e"), ("allow", "b.com", "/")]
        pages = llm_spark.createDataFrame(rows, "page_id long, url string, html string")
        got = link_graph.url_digest(link_graph.judge_urls(pages, link_graph.rule_table(llm_spark, rules))).collect()
        want = verdicts_brute(rows, rules)
        assert sorted(map(tuple, got)) == sorted(want) and {w[4] for w in want} == {"allow", "block"}


def test_url_verdicts_without_pages_or_rules(llm_spark):
    pages = llm_spark.createDataFrame(LINKED, "page_id long, url string, html string")
    none = llm_spark.createDataFrame([], "verdict string, host string, path string")
    assert link_graph.judge_urls(pages.limit(0), link_graph.rule_table(llm_spark, link_graph.RULES)).count() == 0
    got = link_graph.url_digest(link_graph.judge_urls(pages, none)).collect()
    assert len(got) == len(LINKED) and {(r.rule, r.verdict) for r in got} == {(None, "allow")}
