"""License scan by ordered signature rules (built-in expressions only, no shuffle).

A text becomes its word sequence (A-Z lower-cased, words are runs of ASCII letters, digits and characters beyond
ASCII) joined by single blanks. Rules are regular expressions over that string. Each rule has a keyword, and a rule
is tried only in texts that hold its keyword; texts that hold no keyword at all are passed over by one pattern.
Rules stand in tiers (an SPDX tag before a grant, before a versioned title, before a name, before a generic
notice). A detection whose words lie inside a detection of an earlier tier, or inside a longer one of its
own tier, is suppressed. Surviving detections give labels and a score 1 - product(1 - tier weight) over distinct labels.

Base phrases are counted at all their places and are never suppressed.

Cases: null and empty texts have no words, labels "" and score 0; a very long text is scanned whole, in time that grows with its length
and its detections; repeated rows are scanned each for itself, a null doc_id stays null; an empty table gives no rows;
every row of the input gives one row; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.text import ascii_lower

# Phrases and labels of the base scan.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # on the text as it is: A-Z count as letters
TIER_WEIGHT = {1: 0.95, 2: 0.9, 3: 0.7, 4: 0.5, 5: 0.3}

# (label, names over normalized words, versions, SPDX id stem or None)
FAMILIES = (
    ("gpl", ("(?:gnu )?general public licen[sc]e", "(?:gnu )?gpl", "gplv1", "gplv2", "gplv3"), ("1", "2", "3"), "gpl"),
    ("lgpl", ("(?:gnu )?lesser general public licen[sc]e", "(?:gnu )?library general public licen[sc]e", "(?:gnu )?lgpl"), ("2", "2 1", "3"), "lgpl"),
    ("agpl", ("(?:gnu )?affero general public licen[sc]e", "(?:gnu )?agpl"), ("1", "3"), "agpl"),
    ("gfdl", ("(?:gnu )?free documentation licen[sc]e", "gfdl"), ("1 1", "1 2", "1 3"), "gfdl"),
    ("apache", ("apache(?: software)? licen[sc]e",), ("1", "1 1", "2"), "apache"),
    ("mit", ("mit(?: x11)? licen[sc]e", "expat licen[sc]e", "x11 licen[sc]e"), (), "mit"),
    ("bsd-2-clause", ("simplified bsd(?: licen[sc]e)?", "freebsd licen[sc]e", "bsd 2 clause(?: licen[sc]e)?", "2 clause bsd(?: licen[sc]e)?", "two clause bsd(?: licen[sc]e)?"), (), "bsd 2 clause"),
    ("bsd-3-clause", ("new bsd(?: licen[sc]e)?", "modified bsd(?: licen[sc]e)?", "revised bsd(?: licen[sc]e)?", "bsd 3 clause(?: licen[sc]e)?", "3 clause bsd(?: licen[sc]e)?", "three clause bsd(?: licen[sc]e)?"), (), "bsd 3 clause"),
    ("bsd-4-clause", ("original bsd(?: licen[sc]e)?", "bsd 4 clause(?: licen[sc]e)?", "4 clause bsd(?: licen[sc]e)?"), (), "bsd 4 clause"),
    ("bsd", ("berkeley licen[sc]e", "bsd(?: style)? licen[sc]e"), (), None),
    ("0bsd", ("zero clause bsd(?: licen[sc]e)?", "bsd zero clause(?: licen[sc]e)?", "0bsd(?: licen[sc]e)?"), (), "0bsd"),
    ("isc", ("isc licen[sc]e",), (), "isc"),
    ("zlib", ("zlib(?: libpng)? licen[sc]e",), (), "zlib"),
    ("libpng", ("libpng licen[sc]e",), ("2",), "libpng"),
    ("mpl", ("mozilla public licen[sc]e",), ("1", "1 1", "2"), "mpl"),
    ("epl", ("eclipse public licen[sc]e",), ("1", "2"), "epl"),
    ("cddl", ("common development and distribution licen[sc]e", "cddl"), ("1", "1 1"), "cddl"),
    ("cpl", ("common public licen[sc]e",), ("1",), "cpl"),
    ("eupl", ("european union public licen[sc]e", "eupl"), ("1", "1 1", "1 2"), "eupl"),
    ("osl", ("open software licen[sc]e",), ("1", "2", "2 1", "3"), "osl"),
    ("afl", ("academic free licen[sc]e",), ("1 1", "2", "2 1", "3"), "afl"),
    ("artistic", ("(?:perl )?artistic licen[sc]e",), ("1", "2"), "artistic"),
    ("boost", ("boost software licen[sc]e",), ("1",), "bsl"),
    ("bsl", ("business source licen[sc]e",), ("1", "1 1"), "busl"),
    ("sspl", ("server side public licen[sc]e", "sspl"), ("1",), "sspl"),
    ("python", ("python software foundation licen[sc]e", "psf licen[sc]e"), ("2",), "psf"),
    ("php", ("php licen[sc]e",), ("3", "3 01"), "php"),
    ("ruby", ("ruby licen[sc]e",), (), "ruby"),
    ("openssl", ("openssl licen[sc]e",), (), "openssl"),
    ("postgresql", ("postgresql licen[sc]e",), (), "postgresql"),
    ("ofl", ("(?:sil )?open font licen[sc]e",), ("1", "1 1"), "ofl"),
    ("wtfpl", ("do what the fuck you want to public licen[sc]e", "wtfpl"), ("2",), "wtfpl"),
    ("unlicense", ("(?:the )?unlicense",), (), "unlicense"),
    ("ms-pl", ("microsoft public licen[sc]e",), (), "ms pl"),
    ("ms-rl", ("microsoft reciprocal licen[sc]e",), (), "ms rl"),
    ("odbl", ("open (?:data commons open )?database licen[sc]e", "odbl"), ("1",), "odbl"),
    ("odc-by", ("open data commons attribution licen[sc]e",), ("1",), "odc by"),
    ("ogl", ("open government licen[sc]e",), ("1", "2", "3"), "ogl uk"),
    ("cc0", ("cc0", "cc zero", "creative commons zero"), ("1",), "cc0"),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative|ative works|atives|s)?"), ("2", "2 5", "3", "4"), "cc by nc nd"),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution non ?commercial share ?alike"), ("2", "2 5", "3", "4"), "cc by nc sa"),
    ("cc-by-nc", ("cc by nc", "creative commons attribution non ?commercial"), ("2", "2 5", "3", "4"), "cc by nc"),
    ("cc-by-nd", ("cc by nd", "creative commons attribution no ?deriv(?:ative|ative works|atives|s)?"), ("2", "2 5", "3", "4"), "cc by nd"),
    ("cc-by-sa", ("cc by sa", "creative commons attribution share ?alike"), ("2", "2 5", "3", "4"), "cc by sa"),
    ("cc-by", ("cc by", "creative commons attribution"), ("2", "2 5", "3", "4"), "cc by"),
    ("creative-commons", ("creative commons(?: licen[sc]e)?",), (), None),
)
# (label, pattern, keyword) of notices that name no license family
GENERIC = (
    ("public-domain", "(?:released into|dedicated to|in) the public domain", "domain"),
    ("public-domain", "public domain dedication", "domain"),
    ("all-rights-reserved", "all rights reserved", "reserved"),
    ("proprietary", "proprietary and confidential|confidential and proprietary", "proprietary"),
    ("proprietary", "(?:unauthori[sz]ed (?:copying|use|reproduction|distribution)) [^ ]+(?: [^ ]+){0,8} (?:strictly )?prohibited", "prohibited"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright"),
    ("no-warranty", "(?:provided )?as is without warranty of any kind", "warranty"),
    ("no-warranty", "without warranties or conditions of any kind", "warranties"),
    ("redistribution", "redistribution and use in source and binary forms", "redistribution"),
    ("permission", "permission is hereby granted free of charge", "permission"),
    ("permission", "permission to use copy modify and (?:or )?distribute this software", "permission"),
)

GRANT = "(?:dual )?(?:licen[sc]ed|released|distributed|published|available|covered|provided|governed|redistribute) (?:[^ ]+ ){0,4}?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:a )?"
VERSION_WORD = "(?:version |v |ver )?"
SPAN = "struct<tier:int,label:string,first:int,last:int>"
CHUNK = 256
GLUE = "(?: |)"  # between a name and its version


def _version(v: str) -> str:
    body = v if " " in v else f"{v}(?: 0)?"
    return f"{GLUE}(?:{VERSION_WORD}{body}|v{body})"


# words of names that tell little; a rule's keyword is another word of its name where there is one
COMMON_WORDS = frozenset("licen public open software free the and data what you want to commons zero clause side simplified modified revised original new two three".split())


def keyword(name: str) -> str:
    """The longest word that every text matching ``name`` holds, common words last."""
    fixed = re.sub(r"\(\?:[^()]*\)\??|[a-z] ?\?", " ", re.sub(r"\(\?:[^()]*\)\?", " ", name))
    words = re.findall(r"[a-z0-9]{2,}", fixed.replace("licen[sc]e", "licen"))
    return max(words, key=lambda w: (w not in COMMON_WORDS, len(w)))


def signature_rules() -> list[tuple[int, str, str, str]]:
    """(tier, label, pattern, keyword) in order: for each name an SPDX tag, grants, versioned titles and the name."""
    rules: list[tuple[int, str, str, str]] = []
    for label, names, versions, spdx in FAMILIES:
        if spdx:
            rules.append((1, label, f"spdx licen[sc]e identifier {spdx}", "spdx"))
            rules += [(1, f"{label}-{_dotted(v)}", f"spdx licen[sc]e identifier {spdx} {v}(?: 0)?(?: only| or later)?", "spdx") for v in versions]
        for name in names:
            for v in versions:
                later = "(?: or (?:any )?later(?: version)?| only)?"
                rules.append((2, f"{label}-{_dotted(v)}", f"{GRANT}{name}{_version(v)}{later}", keyword(name)))
                rules.append((3, f"{label}-{_dotted(v)}", f"{name}{_version(v)}{later}", keyword(name)))
            rules.append((2, label, f"{GRANT}{name}", keyword(name)))
            rules.append((4, label, name, keyword(name)))
    return rules + [(5, label, f"(?:{p})", k) for label, p, k in GENERIC]


def _dotted(version: str) -> str:
    return version.replace(" ", ".") if " " in version else version + ".0"


def _gate(rules: list[tuple[int, str, str, str]]) -> str:
    """On the raw text: a word that starts with "licen", or the keyword of a rule that can do without such a word.

    The keyword is a whole word, but where a version may follow it without a blank ("LGPLv3"), the start of one.
    """
    other = sorted({k for _, _, p, k in rules if not re.search(r"\blicen", re.sub(r"\(\?:[^()]*\)\?", "", p.removeprefix(GRANT)))}
                   | {phrase.split(" ")[0] for phrase, _ in BASE_PHRASES if "licen" not in phrase})
    glued = {k for _, _, p, k in rules if k + GLUE in p}
    by_letter: dict[str, list[str]] = {}
    for k in other:
        by_letter.setdefault(k[0], []).append(k[1:] + ("" if k in glued else "(?![a-z0-9])"))
    words = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items())
    return rf"(?i)(?<![a-z0-9])(?:licen|{words})"


def _rule_array(rules) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(label).alias("label"),
                              F.lit(f"(?<= )(?:{p})(?= )").alias("pattern"), F.lit(" " + k).alias("keyword"))
                     for t, label, p, k in rules])


def _n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda x: x != ""))


def _scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Results of ``step`` (state, item) -> (state, result) over an array in order; in chunks, as appending to a long array copies it."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        after, result = step(acc["state"], x)
        return F.struct(after.alias("state"), F.array_append(acc["out"], result).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        done = F.aggregate(F.slice(items, c * CHUNK + 1, CHUNK), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.struct(done["state"].alias("state"), F.array_append(acc["out"], done["out"]).alias("out"))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    chunks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(chunks, start, chunk, lambda acc: acc["out"]))


def _places(norm: Column, rule: Column) -> Column:
    """Detections of one rule: (tier, label, first, last) with word positions, ``last`` exclusive."""
    hits = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    gaps = F.split(norm, rule["pattern"], -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(_n_words(g).alias("g"), _n_words(h).alias("h")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        first = at + x["g"]
        return first + x["h"], F.struct(rule["tier"].alias("tier"), rule["label"].alias("label"), first.alias("first"), (first + x["h"]).alias("last"))

    return _scan(pairs, F.lit(0), step, SPAN)


def _kept(detections: Column) -> Column:
    """Detections that no other one covers which is of a lower tier, or of the same one and longer.

    In the order of (first, -last, tier) whatever covers a detection comes before it, so the farthest end seen so far on each tier tells.
    """
    tiers = sorted(TIER_WEIGHT)
    inner = F.sort_array(F.transform(detections, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), d["tier"].alias("tier"), d["label"].alias("label"))))
    far = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("back"))  # back: minus the start, so that of equal ends the longest is largest

    def step(state: Column, d: Column) -> tuple[Column, Column]:
        last = -d["back"]
        me = F.struct(last.alias("last"), (-d["first"]).alias("back"))
        covered = F.lit(False)
        for t in tiers:
            s = state[f"t{t}"]
            covered = covered | ((d["tier"] > t) & (s["last"] >= last)) \
                | ((d["tier"] == t) & ((s["last"] > last) | ((s["last"] == last) & (s["back"] > me["back"]))))
        after = F.struct(*[F.when((d["tier"] == t) & (me > state[f"t{t}"]), me).otherwise(state[f"t{t}"]).alias(f"t{t}") for t in tiers])
        span = F.struct(d["tier"].alias("tier"), d["label"].alias("label"), d["first"].alias("first"), last.alias("last"))
        return after, F.when(~covered, span)

    found = _scan(inner, F.struct(*[far.alias(f"t{t}") for t in tiers]), step, SPAN)
    return F.filter(found, lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, rules: list | None = None, base=BASE_PHRASES) -> DataFrame:
    """(doc_id, n_words, base_spans, detections, kept) per row: spans are (tier, label, first, last) in words."""
    rules = signature_rules() if rules is None else rules
    all_rules = _rule_array(rules)
    base_rules = _rule_array([(0, label, phrase, phrase) for phrase, label in base])
    kind = f"array<{SPAN}>"
    none = F.array().cast(kind)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.split(text, NOT_WORD, -1).alias("words"), text.rlike(_gate(rules)).alias("gated"))
    # a text that starts or ends with other characters has an empty first or last part
    blank = (F.element_at("words", 1) == "").cast("int") + (F.element_at("words", -1) == "").cast("int")
    n_words = F.greatest(F.size("words") - blank, F.lit(0)).cast("long")
    joined = F.concat(F.lit(" "), ascii_lower(F.btrim(F.array_join("words", " "))), F.lit(" "))
    d = d.select("doc_id", n_words.alias("n_words"), F.when(F.col("gated"), joined).alias("norm"))

    def spans(rule_array: Column) -> Column:
        # most rules whose keyword is there still find nothing, and one search tells that
        tried = F.filter(rule_array, lambda r: F.contains(F.col("norm"), r["keyword"]) & F.regexp_like(F.col("norm"), r["pattern"]))
        return F.flatten(F.transform(tried, lambda r: _places(F.col("norm"), r))).cast(kind)

    d = d.select("doc_id", "n_words", F.when(F.col("norm").isNull(), none).otherwise(spans(base_rules)).alias("base_spans"),
                 F.when(F.col("norm").isNull(), none).otherwise(spans(all_rules)).alias("detections"))
    return d.select("doc_id", "n_words", "base_spans", "detections", _kept(F.col("detections")).alias("kept"))


def license_digest(scan: DataFrame) -> DataFrame:
    """The contract's columns from ``scan_licenses``."""
    weights = F.create_map(*[F.lit(x) for kv in TIER_WEIGHT.items() for x in kv])
    base_labels = F.array_sort(F.array_distinct(F.transform("base_spans", lambda s: s["label"])))
    labels = F.array_sort(F.array_union(F.transform("base_spans", lambda s: s["label"]), F.transform("kept", lambda s: s["label"])))
    best = F.transform(F.array_distinct(F.transform("kept", lambda s: s["label"])),
                       lambda label: F.array_max(F.transform(F.filter("kept", lambda s: s["label"] == label), lambda s: weights[s["tier"]])))
    return scan.select(
        "doc_id", "n_words", F.size("base_spans").cast("long").alias("n_base"),
        F.array_min(F.transform("base_spans", lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base_spans", lambda s: s["first"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when((F.size("base_spans") == 0) & (F.size("kept") == 0), F.lit(0.0))
        .otherwise(F.greatest(F.when(F.size("base_spans") > 0, F.lit(TIER_WEIGHT[4])).otherwise(F.lit(0.0)),
                              F.lit(1.0) - F.aggregate(best, F.lit(1.0), lambda p, w: p * (1 - w)))).alias("score"),
        F.size("detections").cast("long").alias("n_detections"), F.size("kept").cast("long").alias("n_kept"))
