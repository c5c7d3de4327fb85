"""License scans by ordered signature rules [native].

A rule is a regular expression over the words of a text (lower-cased, one space between
words, one at either end), with a keyword that the text must hold before the expression is
tried at all, a label and a priority. ``rules()`` builds some hundreds of them from families,
versions and the phrasings that licence notices use; they are ordered by priority. A whole
text is first gated by a hash lookup of its words; only texts that pass meet the rules, and
each rule only texts with its keyword. Detections are intervals of words; one that lies inside
an interval of a rule with higher priority (or of the same priority, but longer) is
suppressed. Base phrases and their labels are found beside the rules and never suppressed.

Work grows with the logarithm of a text's length times the length: places are running sums over
the pieces between matches, and what lies inside what follows from running maxima of ends over
detections in order of their starts.

Null texts count as empty; a text without words has no labels and score 0; repeated rows are
scanned one by one; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table, whole_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families: label, names as a pattern over words, versions that exist, keyword.
FAMILIES = (
    ("apache", "apache(?: software)?", ("1.0", "1.1", "2.0"), "apache"),
    ("gpl", "(?:gnu )?(?:gpl|general public)", ("1.0", "2.0", "3.0"), "gpl|general public"),
    ("lgpl", "(?:gnu )?(?:lgpl|lesser general public|library general public)", ("2.0", "2.1", "3.0"), "lgpl|lesser general|library general"),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)", ("1.0", "3.0"), "agpl|affero"),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation)", ("1.1", "1.2", "1.3"), "gfdl|free documentation"),
    ("mpl", "(?:mpl|mozilla public)", ("1.0", "1.1", "2.0"), " mpl|mozilla"),
    ("epl", "(?:epl|eclipse public)", ("1.0", "2.0"), " epl|eclipse"),
    ("cddl", "(?:cddl|common development and distribution)", ("1.0", "1.1"), "cddl|common development"),
    ("eupl", "(?:eupl|european union public)", ("1.0", "1.1", "1.2"), "eupl|european union"),
    ("cpl", "(?:cpl|common public)", ("1.0",), " cpl|common public"),
    ("osl", "(?:osl|open software)", ("1.0", "2.0", "2.1", "3.0"), " osl|open software"),
    ("afl", "(?:afl|academic free)", ("1.2", "2.0", "2.1", "3.0"), " afl|academic free"),
    ("artistic", "artistic", ("1.0", "2.0"), "artistic"),
    ("bsl", "(?:bsl|boost software)", ("1.0",), " bsl|boost"),
    ("python", "python software foundation", ("2.0",), "python"),
    ("zpl", "(?:zpl|zope public)", ("1.1", "2.0", "2.1"), " zpl|zope"),
    ("ofl", "(?:ofl|sil open font)", ("1.0", "1.1"), " ofl|open font"),
    ("odc-by", "open data commons attribution", ("1.0",), "open data"),
    ("odbl", "(?:odbl|open database)", ("1.0",), "odbl|open database"),
    ("pddl", "(?:pddl|public domain dedication and)", ("1.0",), "pddl|public domain"),
    ("ms-pl", "microsoft public", ("1.0",), "microsoft"),
    ("ms-rl", "microsoft reciprocal", ("1.0",), "microsoft"),
    ("upl", "universal permissive", ("1.0",), "permissive"),
    ("cecill", "cecill", ("1.0", "1.1", "2.0", "2.1"), "cecill"),
)

#: Creative Commons: clauses and versions.
CC_CLAUSES, CC_VERSIONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:s|atives)", "nc": "non ?commercial"}

#: Signatures without versions, by hand: label, pattern, keyword, priority.
SIGNATURES = (
    ("mit", "mit license", "mit license", 60),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 80),
    ("mit", "the software is provided as is without warranty of any kind", "warranty", 50),
    ("isc", "isc license", "isc license", 60),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 80),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?", "bsd", 70),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?", "bsd", 70),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd", 70),
    ("bsd", "bsd license", "bsd", 40),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution", 50),
    ("bsd-3-clause", "neither the name of .{1,80} nor the names of its contributors", "neither the name", 75),
    ("0bsd", "(?:0bsd|zero clause bsd)", "bsd|0bsd", 75),
    ("zlib", "zlib(?: libpng)? license", "zlib", 60),
    ("unlicense", "(?:the unlicense|free and unencumbered software released into the public domain)", "unlicense|unencumbered", 80),
    ("wtfpl", "(?:wtfpl|do what the f\\S+ you want to public license)", "wtfpl|want to public", 80),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0|cc zero|creative commons", 80),
    ("public-domain", "(?:in|into|to) the public domain", "public domain", 40),
    ("public-domain", "public domain dedication", "public domain", 45),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "confidential", 60),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution)", "unauthorized", 50),
    ("proprietary", "no part of this (?:work|book|document|publication) may be reproduced", "reproduced", 60),
    ("proprietary", "may not be (?:copied|reproduced|distributed)(?: or (?:copied|reproduced|distributed))? without (?:prior |written |express )*permission", "permission", 55),
    ("copyright", "copyright (?:c )?(?:19|20)\\d\\d", "copyright", 20),
    ("spdx", "spdx license identifier [^ ]+", "spdx", 30),
    ("copyleft", "under the same license as", "same license", 25),
    ("free-software", "this program is free software you can redistribute it and or modify it", "free software", 45),
    ("no-warranty", "without any warranty without even the implied warranty", "implied warranty", 15),
    ("x11", "x11 license", "x11", 60),
    ("vim", "vim license", "vim", 60),
    ("php", "php license", "php", 60),
    ("ruby", "ruby license", "ruby", 60),
    ("openssl", "openssl license", "openssl", 60),
    ("curl", "curl license", "curl", 60),
    ("postgresql", "postgresql license", "postgresql", 60),
    ("json", "shall be used for good not evil", "not evil", 80),
    ("beerware", "(?:beer ?ware|buy me a beer)", "beer|beerware", 80),
    ("elastic", "elastic license(?: 2 0)?", "elastic", 60),
    ("sspl", "(?:sspl|server side public license)", "sspl|server side", 70),
    ("busl", "business source license(?: 1 1)?", "business", 70),
    ("unicode", "unicode license agreement", "unicode", 60),
    ("ncsa", "(?:ncsa|university of illinois)(?: ncsa)? open source license", "open source", 70),
    ("llama", "llama \\d(?: \\d)? community license", "community license", 70),
    ("rail", "(?:open ?rail|responsible ai license)", "rail|openrail|responsible ai", 60),
    ("cc", "creative commons", "creative commons", 10),
    ("license", "(?:licensed|released|distributed|available) under", "licensed under|released under|distributed under|available under", 5),
)


def rules() -> list[dict]:
    """All rules in order: highest priority first, then as written. Patterns are over words, without the spaces around."""
    found = []

    def add(label: str, pattern: str, keyword: str, priority: int) -> None:
        found.append({"label": label, "pattern": f" (?:{pattern})(?= )", "keywords": keyword.split("|"), "priority": priority})

    for label, names, versions, keyword in FAMILIES:
        for v in versions:
            major, minor = v.split(".")
            number = f"v?{major}(?: {minor})?" if minor == "0" else f"v?{major} {minor}"
            add(f"{label}-{v}", f"{names} licen[cs]e(?: version)? {number}", keyword, 90)
            add(f"{label}-{v}", f"{names}(?: version)? {number}", keyword, 80)
            add(f"{label}-{v}-or-later", f"{names} licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version)? {number} (?:of the license )?or (?:at your option )?(?:any )?later", keyword, 95)
            add(f"{label}-{v}-only", f"{names}(?: licen[cs]e)?(?: version)? {number} only", keyword, 94)
        add(label, f"{names} licen[cs]e", keyword, 40)
    for clauses in CC_CLAUSES:
        spoken = " ".join(CC_WORDS[c] for c in clauses.split())
        for v in CC_VERSIONS:
            number, label = v.replace(".", " "), f"cc-{clauses.replace(' ', '-')}-{v}"
            add(label, f"cc {clauses} {number}", "cc by", 85 + clauses.count(" "))
            add(label, f"creative commons {spoken}(?: {number}| licen[cs]e {number})", "creative commons", 85 + clauses.count(" "))
        add(f"cc-{clauses.replace(' ', '-')}", f"cc {clauses}", "cc by", 60 + clauses.count(" "))
        add(f"cc-{clauses.replace(' ', '-')}", f"creative commons {spoken}", "creative commons", 60 + clauses.count(" "))
    for s in SIGNATURES:
        add(*s)
    found.sort(key=lambda r: -r["priority"])
    return found



def words_of(text: Column) -> Column:
    """The words of a text in lower case, with an empty string before or after where the text begins or ends with something else. (Unicode's other capitals are lowered as well; none of them becomes a letter of A-Z in a phrase.)"""
    return F.split(F.lower(text), NOT_WORD)


def gate_words() -> list[str]:
    """One word of each keyword, its longest: a text without any of them holds no keyword."""
    return sorted({max(k.split(), key=len) for r in rules() for k in r["keywords"]} | {p.split()[0] for p in BASE})


def _rule_table() -> Column:
    kind = "array<struct<label:string,pattern:string,keywords:array<string>,priority:int>>"
    return F.from_json(F.lit(json.dumps(rules())), kind)


def _running(values: Column, combine) -> Column:
    """Running totals of an array under an associative ``combine``: each step joins what lies 1, 2, 4, ... places before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(now: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(now, lambda x, i: F.when(i >= back, combine(x, F.get(now, i - back))).otherwise(x))

    return F.aggregate(steps, values, step)


def _with(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(norm: Column, rule: Column) -> Column:
    """Intervals [start, end) of words at which the rule's pattern stands in norm."""
    # Each match is marked by a line feed, which norm cannot hold; the spaces of the pieces between are summed up.
    pieces = F.split(F.regexp_replace(norm, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit("\n$1\n")), "\n")
    spaces = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))))
    ends = lambda sums: F.transform(F.sequence(F.lit(1), F.size(sums) - 2, F.lit(2)), lambda i: F.struct(F.get(sums, i - 1).alias("s"), F.get(sums, i).alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return _with(spaces, lambda x: F.when(F.size(x) > 1, _with(_running(x, lambda a, b: a + b), ends)).otherwise(none))


def _outermost(hits: Column, priority: Column) -> Column:
    """The hits of this priority that lie inside none of a higher priority, nor inside a longer one of their own."""
    # In order of starts, longer ones first, higher priorities before their own. Equal intervals of one priority don't suppress each other, so each looks at what stands before the first of its kind.
    row = lambda h: F.struct(h["s"].alias("s"), (-h["e"]).alias("back"), (h["priority"] == priority).alias("own"), h["label"].alias("label"))
    ordered = F.array_sort(F.transform(F.filter(hits, lambda h: h["priority"] >= priority), row))
    once = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (x != F.get(rows, i - 1)))

    def judged(rows: Column) -> Column:
        before = lambda x, i: F.get(rows, i - 1)
        fresh = F.transform(rows, lambda x, i: F.when((i > 0) & (before(x, i)["s"] == x["s"]) & (before(x, i)["back"] == x["back"]) & (before(x, i)["own"] == x["own"]), F.lit(0)).otherwise(i))
        reach = _running(F.transform(rows, lambda x: -x["back"]), F.greatest)

        def kept(both: Column) -> Column:
            place = lambda i: F.get(both["first"], i)
            alone = lambda x, i: x["own"] & ((place(i) == 0) | (F.get(both["reach"], place(i) - 1) < -x["back"]))
            return F.transform(F.filter(F.transform(rows, lambda x, i: F.struct(x.alias("x"), alone(x, i).alias("ok"))), lambda y: y["ok"]), lambda y: F.struct(y["x"]["label"].alias("label"), priority.alias("priority"), y["x"]["s"].alias("s"), (-y["x"]["back"]).alias("e")))

        return _with(F.struct(_running(fresh, F.greatest).alias("first"), reach.alias("reach")), kept)

    return _with(_with(ordered, once), judged)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: counts, first and last base place, labels, the surviving detections and a score from 0 to 1."""
    out = docs.select(F.col(id_col).alias("doc_id"), words_of(whole_text(text_col)).alias("_words"))
    ends = (F.get("_words", F.lit(0)) == "").cast("long") + ((F.size("_words") > 1) & (F.element_at("_words", -1) == "")).cast("long")
    out = out.withColumn("n_words", F.size("_words").cast("long") - ends)
    # One hash lookup for each word decides which few texts are looked at again.
    gated = F.arrays_overlap("_words", F.lit(gate_words()))
    norm = F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w != ""), " "), F.lit(" "))
    out = out.withColumn("_norm", F.when(gated, norm).otherwise(F.lit(" "))).drop("_words")
    # The base phrases: one pass over the words of the few texts that hold one.
    holds = F.lit(False)
    for phrase in BASE:
        holds = holds | F.contains("_norm", F.lit(f" {phrase} "))
    out = out.withColumn("_list", F.when(holds, F.split(F.trim("_norm"), " ")).otherwise(F.array().cast("array<string>")))

    def at(i: Column) -> Column:
        kind = F.lit(None).cast("string")
        for phrase, label in reversed(BASE.items()):
            same = F.lit(True)
            for k, word in enumerate(phrase.split(" ")):
                same = same & (F.coalesce(F.get("_list", i + k), F.lit("")) == word)
            kind = F.when(same, F.lit(label)).otherwise(kind)
        return kind

    found = F.filter(F.transform("_list", lambda w, i: F.struct(i.cast("long").alias("at"), F.when(w.isin(*sorted({p.split(" ")[0] for p in BASE})), at(i)).alias("label"))), lambda x: x["label"].isNotNull())
    out = out.withColumn("_base", found).withColumn("n_base", F.size("_base").cast("long"))
    out = out.withColumn("first_word", F.get("_base", F.lit(0))["at"]).withColumn("last_word", F.when(F.col("n_base") > 0, F.element_at("_base", -1)["at"]))
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["label"])))
    out = out.withColumn("_base_labels", base_labels)
    # The rules, for texts that pass the gate; a rule only where its keyword stands.
    kinds = "array<struct<label:string,priority:int,s:int,e:int>>"
    tried = F.filter(_rule_table(), lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("_norm"), k)))
    hits = F.flatten(F.transform(tried, lambda r: F.transform(_places(F.col("_norm"), r), lambda p: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), p["s"].alias("s"), p["e"].alias("e")))))
    out = out.withColumn("_hits", F.when(F.col("_norm") != " ", hits).otherwise(F.array().cast(kinds)))
    priorities = F.array_distinct(F.transform("_hits", lambda h: h["priority"]))
    out = out.withColumn("detections", F.flatten(F.transform(priorities, lambda p: _outermost(F.col("_hits"), p))))
    labels = F.array_sort(F.array_distinct(F.concat("_base_labels", F.transform("detections", lambda x: x["label"]))))
    out = out.withColumn("base_labels", F.array_join("_base_labels", ",")).withColumn("labels", F.array_join(labels, ","))
    covered = F.aggregate(F.transform("detections", lambda x: (x["e"] - x["s"]) * x["priority"] / 100), F.lit(0.0), lambda a, x: a + x) + F.col("n_base")
    # The weight of all detections against that of a short notice; more words than detections tell of a text that only mentions a licence.
    out = out.withColumn("score", F.least(F.lit(1.0), covered / 10))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("_hits").alias("n_detected"), F.size("detections").alias("n_detections"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
