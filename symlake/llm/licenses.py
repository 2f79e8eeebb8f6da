"""License detection with ordered signature rules, in Spark SQL functions only.

A rule is a regular expression with a keyword, a label, a priority and a confidence. A rule runs on a text only if its
keyword occurs in it, whatever white space stands between the keyword's words, which for most texts means that no rule
runs. Every match of a rule holds its keyword. All matches of the rules that run become intervals;
sorted by start, then length, then priority, they pass one fold that drops what lies inside an earlier interval and, of
two that overlap in part, keeps the better one by priority.

Base phrases are looked for word by word (ASCII letters in either case, any separators), independent of the rules.

Defined results: null counts as empty text, without words, labels or detections and with score 0; repeated rows are read
each on their own.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[^a-z0-9]{1,4}"
HIT = "start int, `end` int, priority int, confidence double, label string"


def _versions(template: str, numbers: str) -> list[tuple[str, str]]:
    """One rule per version: ``{v}`` in the template stands for the number."""
    out = []
    for v in numbers.split():
        major = v.removesuffix(".0")
        tail = rf"{re.escape(major)}(?:\.0)?(?![.\d]*\d)" if v.endswith(".0") else rf"{re.escape(v)}(?!\d)"
        out.append((v, template.replace("{v}", tail)))
    return out


def rules() -> list[dict]:
    """All rules in order of priority (smaller is better). Patterns are for lower-case text and work in Java."""
    out: list[dict] = []

    def add(keyword: str, label: str, pattern: str, confidence: float) -> None:
        out.append({"keyword": keyword, "label": label, "pattern": pattern, "priority": len(out), "confidence": confidence})

    version = r",?\s*(?:version|v\.?|ver\.?)?\s*"
    or_later = r"(?:\s*(?:,|or|\(or)?\s*(?:\(?at your option\)?\s*)?(?:or\s+)?(?:any\s+)?later(?:\s+version)?|\+)"
    gnu = [("agpl", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e", "affero", "1.0 3.0"),
           ("lgpl", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[sc]e", "general public", "2.0 2.1 3.0"),
           ("gfdl", r"gnu\s+free\s+documentation\s+licen[sc]e", "free documentation", "1.1 1.2 1.3"),
           ("gpl", r"(?:gnu\s+)?general\s+public\s+licen[sc]e", "general public", "1.0 2.0 3.0")]
    # Machine-readable tags come first: they say what they mean.
    tags = {
        "mit": "mit", "mit-0": "mit-0", "isc": "isc", "0bsd": "0bsd", "zlib": "zlib", "unlicense": "unlicense", "wtfpl": "wtfpl",
        "cc0-1.0": "cc0-1.0", "bsl-1.0": "bsl-1.0", "psf-2.0": "psf-2.0", "ncsa": "ncsa", "postgresql": "postgresql", "x11": "x11",
        "ofl-1.1": "ofl-1.1", "artistic-1.0": "artistic-1.0", "artistic-2.0": "artistic-2.0", "apache-1.0": "apache-1", "apache-1.1": "apache-1.1",
        "apache-2.0": "apache-2", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "ecl-2.0": "ecl-2.0", "upl-1.0": "upl-1.0", "mulanpsl-2.0": "mulanpsl-2.0",
        "busl-1.1": "busl-1.1", "sspl-1.0": "sspl-1.0", "elastic-2.0": "elastic-2.0", "odbl-1.0": "odbl-1.0", "curl": "curl", "openssl": "openssl",
    }
    families = {"bsd-{}-clause": "1 2 3 4", "epl-{}": "1.0 2.0", "mpl-{}": "1.0 1.1 2.0", "eupl-{}": "1.0 1.1 1.2", "cddl-{}": "1.0 1.1",
                "afl-{}": "1.2 2.0 2.1 3.0", "osl-{}": "1.0 2.0 2.1 3.0", "lppl-{}": "1.0 1.1 1.2 1.3c", "cecill-{}": "1.0 2.0 2.1 b c"}
    tags |= {f.format(v): f.format(v) for f, vs in families.items() for v in vs.split()}
    tags |= {f"cc-by{kind}-{v}": f"cc-by{kind}" for kind in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
    tags |= {f"{g}-{v}{end}": f"{g}-{v.removesuffix('.0')}" for g, _, _, vs in gnu for v in vs.split() for end in ("", "-only", "-or-later")}
    for tag, label in tags.items():
        add("spdx", label, rf"spdx-license-identifier:\s*\(?{re.escape(tag)}(?![\w.-]*\w)", 1.0)

    # Texts and notices with a version.
    for name, words, keyword, numbers in gnu:
        for v, pattern in _versions(rf"{words}{version}{{v}}", numbers):
            add(keyword, f"{name}-{v.removesuffix('.0')}-or-later", rf"{pattern}{or_later}", 0.97)
            add(keyword, f"{name}-{v.removesuffix('.0')}", pattern, 0.95)
        short = rf"(?<![a-z]){name}" + version.replace(r"\s*", r"[\s-]*")
        for v, pattern in _versions(f"{short}{{v}}", numbers):
            add(name, f"{name}-{v.removesuffix('.0')}", pattern, 0.9)
    named = [
        ("apache", "apache", rf"apache\s+(?:software\s+)?licen[sc]e{version}{{v}}", "1.0 1.1 2.0", 0.97),
        ("mozilla", "mpl", rf"mozilla\s+public\s+licen[sc]e{version}{{v}}", "1.0 1.1 2.0", 0.95),
        ("eclipse", "epl", rf"eclipse\s+public\s+licen[sc]e{version}{{v}}", "1.0 2.0", 0.95),
        ("european union", "eupl", rf"european\s+union\s+public\s+licen[sc]e{version}{{v}}", "1.0 1.1 1.2", 0.95),
        ("common development", "cddl", rf"common\s+development\s+and\s+distribution\s+licen[sc]e{version}{{v}}", "1.0 1.1", 0.95),
        ("academic free", "afl", rf"academic\s+free\s+licen[sc]e{version}{{v}}", "1.2 2.0 2.1 3.0", 0.95),
        ("open software", "osl", rf"open\s+software\s+licen[sc]e{version}{{v}}", "1.0 2.0 2.1 3.0", 0.95),
        ("artistic", "artistic", rf"artistic\s+licen[sc]e{version}{{v}}", "1.0 2.0", 0.95),
        ("latex project", "lppl", rf"latex\s+project\s+public\s+licen[sc]e{version}{{v}}", "1.0 1.1 1.2 1.3c", 0.95),
        ("boost", "bsl", rf"boost\s+software\s+licen[sc]e{version}{{v}}", "1.0", 0.95),
        ("open font", "ofl", rf"(?:sil\s+)?open\s+font\s+licen[sc]e{version}{{v}}", "1.0 1.1", 0.95),
        ("python software", "psf", rf"python\s+software\s+foundation\s+licen[sc]e{version}{{v}}", "2.0", 0.95),
        ("educational", "ecl", rf"educational\s+community\s+licen[sc]e{version}{{v}}", "1.0 2.0", 0.95),
        ("business source", "busl", rf"business\s+source\s+licen[sc]e{version}{{v}}", "1.0 1.1", 0.95),
        ("server side", "sspl", rf"server\s+side\s+public\s+licen[sc]e{version}{{v}}", "1.0", 0.95),
        ("elastic", "elastic", rf"elastic\s+licen[sc]e{version}{{v}}", "1.0 2.0", 0.95),
        ("open data", "odbl", rf"open\s+(?:data\s*base|database)\s+licen[sc]e{version}{{v}}", "1.0", 0.95),
        ("universal permissive", "upl", rf"universal\s+permissive\s+licen[sc]e{version}{{v}}", "1.0", 0.95),
        ("cecill", "cecill", rf"cecill{version}{{v}}", "1.0 2.0 2.1", 0.9),
        ("mulan", "mulanpsl", rf"mulan\s+permissive\s+software\s+licen[sc]e{version}{{v}}", "1.0 2.0", 0.95),
    ]
    for keyword, name, template, numbers, confidence in named:
        for v, pattern in _versions(template, numbers):
            label = "apache-" + v.removesuffix(".0") if name == "apache" else f"{name}-{v}"
            add(keyword, label, pattern, confidence)

    # Creative Commons, most specific first.
    kinds = {"cc-by-nc-sa": ("nc", "sa"), "cc-by-nc-nd": ("nc", "nd"), "cc-by-nc": ("nc",), "cc-by-sa": ("sa",), "cc-by-nd": ("nd",), "cc-by": ()}
    spelled = {"nc": r"non-?\s?commercial", "sa": r"share-?\s?alike", "nd": r"no-?\s?deriv(?:ative)?s?(?:\s+works)?"}
    for label, parts in kinds.items():
        add("cc", label, r"(?<![a-z0-9])cc" + GAP + "by" + "".join(GAP + p for p in parts) + r"(?:\W{0,3}\d(?:\.\d)?)?(?![a-z0-9])", 0.95)
        add("creative commons", label, r"creative\s+commons\s+attribution" + "".join(r"[\s,-]*(?:and\s+)?" + spelled[p] for p in parts) +
            r"(?:\s+\d(?:\.\d)?)?(?:\s+(?:international|unported|generic))?(?:\s+public)?(?:\s+licen[sc]e)?", 0.95)
    add("cc0", "cc0-1.0", r"(?<![a-z0-9])cc0(?:\W{1,3}1(?:\.0)?)?(?![a-z0-9])", 0.9)
    add("creative commons", "cc0-1.0", r"creative\s+commons\s+(?:zero|cc0)", 0.95)
    add("publicdomain", "cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0", 1.0)
    for label, parts in kinds.items():
        add("creativecommons.org", label, r"creativecommons\.org/licenses/by" + "".join(f"-{p}" for p in parts) + r"/\d\.\d", 1.0)

    # Families without a version, and characteristic sentences of license texts.
    for keyword, label, pattern, confidence in [
        ("mit", "mit", r"(?<![a-z0-9])(?:under\s+)?(?:the\s+)?(?:terms\s+of\s+the\s+)?mit[\s-]+licen[sc]ed?(?![a-z])", 0.9),
        ("permission is hereby granted", "mit", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 0.95),
        ("mit-0", "mit-0", r"(?<![a-z0-9])mit-0(?![a-z0-9])", 0.9),
        ("x11", "x11", r"(?<![a-z0-9])x11\s+licen[sc]e", 0.85),
        ("apache", "apache", r"apache\s+(?:software\s+)?licen[sc]e", 0.8),
        ("apache.org", "apache-2", r"apache\.org/licenses/license-2\.0", 1.0),
        ("bsd", "0bsd", r"(?<![a-z0-9])(?:0|zero)[\s-]?(?:clause[\s-]+)?bsd(?:[\s-]+licen[sc]e)?", 0.85),
        ("bsd", "bsd-2-clause", r"(?:2|two)[\s-]clause\s+bsd(?:\s+licen[sc]e)?|freebsd\s+(?:bsd\s+)?licen[sc]e|bsd[\s-]2[\s-]clause", 0.9),
        ("simplified", "bsd-2-clause", r"simplified\s+(?:bsd\s+)?licen[sc]e", 0.9),
        ("bsd", "bsd-3-clause", r"(?:3|three)[\s-]clause\s+bsd(?:\s+licen[sc]e)?|(?:new|modified|revised)\s+bsd\s+licen[sc]e|bsd[\s-]3[\s-]clause", 0.9),
        ("bsd", "bsd-4-clause", r"(?:4|four)[\s-]clause\s+bsd(?:\s+licen[sc]e)?|original\s+bsd\s+licen[sc]e|bsd[\s-]4[\s-]clause", 0.9),
        ("bsd", "bsd", r"(?<![a-z0-9])bsd(?:[\s-]style)?\s+licen[sc]e", 0.8),
        ("redistribution and use", "bsd", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification,\s+are\s+permitted", 0.9),
        ("isc", "isc", r"(?<![a-z0-9])isc\s+licen[sc]e", 0.9),
        ("permission to use, copy", "isc", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee", 0.9),
        ("zlib", "zlib", r"(?<![a-z0-9])zlib(?:/libpng)?\s+licen[sc]e", 0.9),
        ("as-is", "zlib", r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty", 0.85),
        ("unlicen", "unlicense", r"(?<![a-z0-9])unlicen[sc]e(?![a-z])", 0.85),
        ("public domain", "public-domain", r"(?:released|dedicated|placed|is)\s+(?:in)?to\s+the\s+public\s+domain|in\s+the\s+public\s+domain", 0.8),
        ("what the fuck", "wtfpl", r"do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+licen[sc]e", 0.95),
        ("wtfpl", "wtfpl", r"(?<![a-z0-9])wtfpl(?![a-z0-9])", 0.85),
        ("general public", "gpl", r"(?:gnu\s+)?general\s+public\s+licen[sc]e", 0.8),
        ("affero", "agpl", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e", 0.85),
        ("lesser", "lgpl", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e", 0.85),
        ("gpl", "gpl", r"(?<![a-z0-9])gpl\s+licen[sc]e|licen[sc]ed\s+under\s+(?:the\s+)?gpl", 0.75),
        ("mozilla", "mpl", r"mozilla\s+public\s+licen[sc]e", 0.8),
        ("eclipse", "epl", r"eclipse\s+public\s+licen[sc]e", 0.8),
        ("creative commons", "cc", r"creative\s+commons(?:\s+licen[sc]e)?", 0.6),
        ("boost", "bsl-1.0", r"boost\s+software\s+licen[sc]e", 0.85),
        ("open font", "ofl", r"(?:sil\s+)?open\s+font\s+licen[sc]e", 0.8),
        ("artistic", "artistic", r"artistic\s+licen[sc]e", 0.75),
        ("postgresql", "postgresql", r"postgresql\s+licen[sc]e", 0.85),
        ("microsoft", "ms-pl", r"microsoft\s+public\s+licen[sc]e", 0.9),
        ("microsoft", "ms-rl", r"microsoft\s+reciprocal\s+licen[sc]e", 0.9),
        ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/)?ncsa\s+(?:open\s+source\s+)?licen[sc]e", 0.9),
        ("openssl", "openssl", r"openssl\s+licen[sc]e", 0.85),
        ("proprietary", "proprietary", r"proprietary\s+(?:and\s+confidential|licen[sc]e|software)", 0.7),
        ("all rights reserved", "all-rights-reserved", r"all\s+rights\s+reserved", 0.5),
    ]:
        add(keyword, label, pattern, confidence)
    return out


def stems(known: list[dict]) -> list[str]:
    """Few strings without white space, at least one of which any match needs: ``licen`` where a pattern cannot do
    without, else the longest word of the rule's keyword."""
    needed = set()
    for r in known:
        firm, before = r["pattern"], None
        while firm != before:
            before, firm = firm, re.sub(r"\((?:\?[:!<=]+)?[^()]*\)[?*]", "", firm)
        needed.add("licen" if "licen" in firm and "|" not in firm else max(r["keyword"].split(), key=len))
    return sorted(k for k in needed if not any(o != k and o in k for o in needed))


def _rule_table(known: list[dict]) -> Column:
    """The rules as one constant array."""
    kind = "array<struct<keyword:string,label:string,pattern:string,priority:int,confidence:double>>"
    return F.from_json(F.lit(json.dumps(known)), kind)


def detections(low: Column, known: list[dict]) -> Column:
    """Kept detections of a lower-case text, in order: start and end (code points, end exclusive), priority, confidence
    and label."""
    # Keywords are looked for in a copy with single spaces, which the outer array makes once for all rules.
    folded = F.array(F.regexp_replace(low, r"\s+", " "))
    live = F.get(F.transform(folded, lambda text: F.filter(_rule_table(known), lambda r: F.contains(text, r["keyword"]))), 0)

    def hits(r: Column) -> Column:
        found = F.regexp_extract_all(low, r["pattern"], F.lit(0))
        between = F.split(low, r["pattern"], -1)
        # Each match starts where the texts and matches before it end.
        walked = F.aggregate(
            F.arrays_zip(between.alias("gap"), found.alias("match")),
            F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS array<struct<{HIT.replace(' int', ':int').replace(' double', ':double').replace(' string', ':string')}>>)").alias("rows")),
            lambda acc, x: F.when(x["match"].isNull(), acc).otherwise(F.struct(
                (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("at"),
                F.array_append(acc["rows"], F.struct(
                    (acc["at"] + F.char_length(x["gap"])).alias("start"),
                    (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("end"),
                    r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["label"].alias("label"))).alias("rows"))))
        return F.when(F.rlike(low, r["pattern"]), walked["rows"])

    every = F.flatten(F.filter(F.transform(live, hits), lambda x: x.isNotNull()))
    ordered = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(
        a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["priority"] - b["priority"]))
    return suppress(ordered)


def suppress(ordered: Column) -> Column:
    """One pass over sorted detections. ``ends``: how far the kept ones reach."""
    empty = F.filter(ordered, lambda h: F.lit(False))
    start = F.struct(F.lit(0).alias("ends"), empty.alias("kept"))

    def step(acc: Column, h: Column) -> Column:
        last = F.element_at(acc["kept"], -1)
        # Sorted by start: what ends no later than an earlier one lies inside it.
        inside = h["end"] <= acc["ends"]
        apart = (F.size(acc["kept"]) == 0) | (h["start"] >= acc["ends"])
        better = h["priority"] < last["priority"]
        return (F.when(inside, acc)
                .when(apart, F.struct(h["end"].alias("ends"), F.array_append(acc["kept"], h).alias("kept")))
                .when(better, F.struct(h["end"].alias("ends"), F.array_append(F.slice(acc["kept"], F.lit(1), F.size(acc["kept"]) - 1), h).alias("kept")))
                .otherwise(acc))

    return F.aggregate(ordered, start, step)["kept"]


def phrase_places(words: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase starts. The first word is found by position, so a long text is walked
    once."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _all(
        [F.get(words, i + k) == p for k, p in enumerate(parts)]))).otherwise(F.array().cast("array<int>"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def scan(docs: DataFrame, known: list[dict] | None = None) -> DataFrame:
    """``doc_id, n_words, places, found`` for every row: the base phrases' places by label, and the rules' detections."""
    known = rules() if known is None else known
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"))
    # Every phrase holds one of these; most texts hold none, and nothing else runs on them.
    maybe = F.contains("low", F.lit("license")) | F.col("low").rlike(r"cc[^a-z0-9]+by")
    words = F.regexp_extract_all("low", F.lit(WORD), F.lit(0))
    places = F.struct(*[F.when(maybe, phrase_places(F.col("words"), p)).otherwise(F.array().cast("array<int>")).alias(label.replace("-", "_"))
                        for p, label in PHRASES.items()])
    # Words are matched by ASCII letters in either case: `low` differs from that only outside ASCII, inside words.
    split = read.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("bigint").alias("n_words"), "low", F.when(maybe, words).alias("words"))
    any_stem = F.lit(False)
    for stem in stems(known):
        any_stem = any_stem | F.contains("low", F.lit(stem))
    none = "cast(array() AS array<struct<start:int,`end`:int,priority:int,confidence:double,label:string>>)"
    return split.select("doc_id", "n_words", places.alias("places"),
                        F.when(any_stem, detections(F.col("low"), known)).otherwise(F.expr(none)).alias("found"))


def base_labels(places: str = "places") -> Column:
    """Labels of the base phrases that occur."""
    return F.array_compact(F.array(*[F.when(F.size(F.col(places)[label.replace("-", "_")]) > 0, F.lit(label)) for label in PHRASES.values()]))


def all_places(places: str = "places") -> Column:
    return F.concat(*[F.col(places)[label.replace("-", "_")] for label in PHRASES.values()])
