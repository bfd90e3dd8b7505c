"""License scans with ordered signature rules (DataFrame functions only).

Texts become words, each with a space on either side.  A rule is a regex over
such words with a label, a priority and a keyword.  A document that holds none of
the gate words runs no rule; others run the rules of which they hold a
keyword; every text that a rule's regex matches holds one, so the prefilter loses
no detection (the SQL has none).  Arrays are folded in blocks, so that a long
text full of license lines does not copy all earlier detections for each new one.
Detections are intervals of words.  One that lies inside another of the same or
a higher priority is suppressed; of equal intervals the rule that stands first
stays.  Besides the rules, three base phrases are counted everywhere.

Nulls, ties and edges: a null text is empty, with 0 words, no place (null first
and last word), empty labels and score 0; repeated rows and a null doc_id get a
result row each; phrases may overlap and are all counted; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrases, longest words first where one could hide another; none can.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licenses by label, a name regex, the SPDX identifier's words, and a keyword of the name.
LICENSES = (
    ("mit", "(mit|expat) licen[cs]e", "mit", "licen"),
    ("mit-0", "mit no attribution", "mit 0", "attribution"),
    ("apache-1.1", "apache (software )?licen[cs]e (version |v)?1 1", "apache 1 1", "apache"),
    ("apache-2.0", "apache (software )?licen[cs]e (version |v)?2( 0)?", "apache 2 0", "apache"),
    ("apache", "apache (software )?licen[cs]e", "apache", "apache"),
    ("gpl-1.0", "(gnu )?general public licen[cs]e (version |v)1( 0)?", "gpl 1 0", "general"),
    ("gpl-2.0", "(gnu )?general public licen[cs]e (version |v)2( 0)?", "gpl 2 0", "general"),
    ("gpl-3.0", "(gnu )?general public licen[cs]e (version |v)3( 0)?", "gpl 3 0", "general"),
    ("gpl", "(gnu )?general public licen[cs]e", "gpl", "general"),
    ("gpl", "gnu gpl", "gnu gpl", "gpl"),
    ("gpl-2.0", "gplv2", "gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", "gplv3", "gplv3"),
    ("lgpl-2.0", "(gnu )?library general public licen[cs]e (version |v)2( 0)?", "lgpl 2 0", "library"),
    ("lgpl-2.1", "(gnu )?lesser general public licen[cs]e (version |v)2 1", "lgpl 2 1", "lesser"),
    ("lgpl-3.0", "(gnu )?lesser general public licen[cs]e (version |v)3( 0)?", "lgpl 3 0", "lesser"),
    ("lgpl", "(gnu )?(lesser|library) general public licen[cs]e", "lgpl", "general"),
    ("agpl-3.0", "(gnu )?affero general public licen[cs]e (version |v)3( 0)?", "agpl 3 0", "affero"),
    ("agpl", "(gnu )?affero general public licen[cs]e", "agpl", "affero"),
    ("gfdl", "(gnu )?free documentation licen[cs]e", "gfdl 1 3", "documentation"),
    ("bsd-2-clause", "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[cs]e", "bsd 2 clause", "licen"),
    ("bsd-3-clause", "(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e", "bsd 3 clause", "bsd"),
    ("bsd-4-clause", "(bsd 4 clause|4 clause bsd|original bsd) licen[cs]e", "bsd 4 clause", "bsd"),
    ("0bsd", "(bsd zero clause|zero clause bsd|0bsd) licen[cs]e", "0bsd", "licen"),
    ("bsd", "bsd (style )?licen[cs]e", "bsd", "bsd"),
    ("isc", "isc licen[cs]e", "isc", "isc"),
    ("mpl-1.1", "mozilla public licen[cs]e (version |v)?1 1", "mpl 1 1", "mozilla"),
    ("mpl-2.0", "mozilla public licen[cs]e (version |v)?2( 0)?", "mpl 2 0", "mozilla"),
    ("mpl", "mozilla public licen[cs]e", "mpl", "mozilla"),
    ("epl-1.0", "eclipse public licen[cs]e (version |v)?1( 0)?", "epl 1 0", "eclipse"),
    ("epl-2.0", "eclipse public licen[cs]e (version |v)?2( 0)?", "epl 2 0", "eclipse"),
    ("epl", "eclipse public licen[cs]e", "epl", "eclipse"),
    ("cddl-1.0", "common development and distribution licen[cs]e( (version |v)?1( 0)?)?", "cddl 1 0", "distribution"),
    ("cpl-1.0", "common public licen[cs]e( (version |v)?1( 0)?)?", "cpl 1 0", "common"),
    ("eupl-1.1", "european union public licen[cs]e (version |v)?1 1", "eupl 1 1", "union"),
    ("eupl-1.2", "european union public licen[cs]e( (version |v)?1 2)?", "eupl 1 2", "union"),
    ("cecill-2.1", "cecill (free software )?licen[cs]e( agreement)?", "cecill 2 1", "cecill"),
    ("artistic-1.0", "artistic licen[cs]e (version |v)?1( 0)?", "artistic 1 0", "artistic"),
    ("artistic-2.0", "artistic licen[cs]e( (version |v)?2( 0)?)?", "artistic 2 0", "artistic"),
    ("bsl-1.0", "boost software licen[cs]e( (version |v)?1( 0)?)?", "bsl 1 0", "boost"),
    ("busl-1.1", "business source licen[cs]e( (version |v)?1 1)?", "busl 1 1", "business"),
    ("sspl-1.0", "server side public licen[cs]e( (version |v)?1( 0)?)?", "sspl 1 0", "server"),
    ("elastic-2.0", "elastic licen[cs]e( (version |v)?2( 0)?)?", "elastic 2 0", "elastic"),
    ("zlib", "zlib( libpng)? licen[cs]e", "zlib", "zlib"),
    ("libpng", "(png reference library|libpng) licen[cs]e", "libpng 2 0", "licen"),
    ("openssl", "openssl licen[cs]e", "openssl", "openssl"),
    ("php-3.01", "php licen[cs]e( (version |v)?3 01)?", "php 3 01", "php"),
    ("psf-2.0", "(python software foundation|psf) licen[cs]e( agreement)?( (version |v)?2)?", "psf 2 0", "licen"),
    ("python-2.0", "python licen[cs]e( 2 0)?", "python 2 0", "python"),
    ("ruby", "ruby licen[cs]e", "ruby", "ruby"),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "postgresql"),
    ("ncsa", "(university of illinois )?ncsa (open source )?licen[cs]e", "ncsa", "ncsa"),
    ("w3c", "w3c (software (notice and )?)?licen[cs]e", "w3c", "w3c"),
    ("x11", "x11 licen[cs]e", "x11", "x11"),
    ("unlicense", "(the unlicense|unlicense licen[cs]e)", "unlicense", "unlicense"),
    ("wtfpl", "(do what the fuck you want to public licen[cs]e|wtfpl)", "wtfpl", "wtfpl"),
    ("ofl-1.1", "(sil )?open font licen[cs]e( (version |v)?1 1)?", "ofl 1 1", "font"),
    ("odbl-1.0", "open (data commons open )?database licen[cs]e( (version |v)?1( 0)?)?", "odbl 1 0", "database"),
    ("odc-by-1.0", "open data commons attribution licen[cs]e", "odc by 1 0", "commons"),
    ("pddl-1.0", "public domain dedication and licen[cs]e", "pddl 1 0", "dedication"),
    ("cc0-1.0", "(creative commons zero|cc0)( universal)?( 1 0)?( universal)?", "cc0 1 0", "cc0"),
    ("cc-by-2.0", "(creative commons attribution|cc by) 2 0", "cc by 2 0", "by"),
    ("cc-by-3.0", "(creative commons attribution|cc by) 3 0", "cc by 3 0", "by"),
    ("cc-by-4.0", "(creative commons attribution|cc by) 4 0", "cc by 4 0", "by"),
    ("cc-by", "creative commons attribution( international)?( public)? licen[cs]e", "cc by", "creative"),
    ("cc-by-sa-3.0", "(creative commons attribution share ?alike|cc by sa) 3 0", "cc by sa 3 0", "sa"),
    ("cc-by-sa-4.0", "(creative commons attribution share ?alike|cc by sa) 4 0", "cc by sa 4 0", "sa"),
    ("cc-by-nc-3.0", "(creative commons attribution non ?commercial|cc by nc) 3 0", "cc by nc 3 0", "nc"),
    ("cc-by-nc-4.0", "(creative commons attribution non ?commercial|cc by nc) 4 0", "cc by nc 4 0", "nc"),
    ("cc-by-nd-4.0", "(creative commons attribution no ?derivatives|cc by nd) 4 0", "cc by nd 4 0", "nd"),
    ("cc-by-nc-sa-4.0", "(creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0", "cc by nc sa 4 0", "sa"),
    ("cc-by-nc-nd-4.0", "(creative commons attribution non ?commercial no ?derivatives|cc by nc nd) 4 0", "cc by nc nd 4 0", "nd"),
    ("openrail", "(creativeml )?open ?rail (m )?licen[cs]e", "openrail", "licen"),
    ("llama-community", "llama( 2| 3)? community licen[cs]e( agreement)?", "llama2", "llama"),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", "microsoft"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", "microsoft"),
    ("osl-3.0", "open software licen[cs]e( (version |v)?3( 0)?)?", "osl 3 0", "open"),
    ("afl-3.0", "academic free licen[cs]e( (version |v)?3( 0)?)?", "afl 3 0", "academic"),
    ("mulan-psl-2.0", "mulan (psl|permissive software licen[cs]e)( (version |v)?2( 0)?)?", "mulanpsl 2 0", "mulan"),
    ("vim", "vim licen[cs]e", "vim", "vim"),
    ("json", "json licen[cs]e", "json", "json"),
)

#: Words of which each text that a name's regex matches holds one, for names whose keyword is not in all their alternatives.
EITHER = {"wtfpl": ("fuck", "wtfpl"), "cc0-1.0": ("commons", "cc0")} | {label: ("commons", "cc  by") for label, name, _, _ in LICENSES if "|cc by" in name}

#: Forms in which a license is told: priority (0 is the highest), confidence, and the regex around its name.
FORMS = (
    ("grant", 0, 0.95, "(licen[cs]ed|released|distributed|available|published|provided|redistributed|covered) (under|by) (the )?((terms|conditions) (and conditions )?of )?(the )?(either )?{name}( licen[cs]e)?"),
    ("header", 1, 0.9, "(this|the) (file|work|program|software|project|library|code|document|text) is (free software )?(licen[cs]ed )?(under )?(the )?{name}( licen[cs]e)?"),
    ("field", 1, 0.85, "licen[cs]e {name}( licen[cs]e)?"),
    ("name", 2, 0.6, "{name}"),
)
#: Form of a machine-readable tag.
TAG = ("tag", 0, 1.0, "spdx licen[cs]e identifier {spdx}( only| or later)?")
#: Sentences of license texts, by label and regex; each with a keyword that all its alternatives hold.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd-3-clause", "neither the name of the (copyright holder|university|author|company|project) nor the names of its contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "basis"),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license", "patent"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute"),
    ("gpl", "is distributed in the hope that it will be useful but without any warranty", "warranty"),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e", "received"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", "verbatim"),
    ("lgpl", "you should have received a copy of the gnu (lesser|library) general public licen[cs]e", "received"),
    ("agpl", "must prominently offer all users interacting with it remotely through a computer network", "remotely"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "permission"),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("epl", "the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "eclipse"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "contents"),
    ("cc-by", "free to share copy and redistribute the material in any medium or format", "redistribute"),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", "credit"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "commercial"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e", "remix"),
    ("cc0-1.0", "waived all copyright and related or neighboring rights", "waived"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission"),
    ("isc", "the author disclaims all warranties with regard to this software", "disclaims"),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty"),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented"),
    ("zlib", "altered source versions must be plainly marked as such", "altered"),
    ("bsl-1.0", "any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e", "organization"),
    ("ofl-1.1", "the font software may be sold as part of a larger software package", "font"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("php-3.01", "this product includes php software freely available", "php"),
    ("postgresql", "in no event shall the university of california be liable to any party", "california"),
    ("ncsa", "this list of conditions and the following disclaimers", "disclaimers"),
    ("artistic-2.0", "this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "establishes"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document", "verbatim"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "hosted"),
    ("busl-1.1", "make non production use of the licensed work", "production"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", "functionality"),
    ("psf-2.0", "this licen[cs]e agreement is between the python software foundation", "python"),
    ("json", "the software shall be used for good not evil", "evil"),
    ("proprietary", "all rights reserved", "reserved"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized"),
    ("proprietary", "(proprietary and confidential|confidential and proprietary)", "confidential"),
    ("public-domain", "(released|dedicated|placed) (in|into|to) the public domain", "domain"),
    ("public-domain", "this work is in the public domain", "domain"),
    ("public-domain", "the author disclaims copyright to this source code", "disclaims"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "stuff"),
)
_GATE = ("licen", "spdx", "copyright", "unlicense", "public domain", "permission", "redistribution", "warranty", "reserved", "cc by", "cc0", "creative commons", "wtfpl", "gpl", "attribution", "identifier", "published", "released", "openrail", "psl")
#: A document without any of these holds no detection; a notice without one brings its keyword.
GATE = (*_GATE, *sorted({k for _, text, k in NOTICES if not any(w in re.sub(r"\(.*?\)", "", text) for w in _GATE)}))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keyword: str
    regex: str
    #: The scan runs the rule on texts that hold one of these; without any, on those that hold the keyword.
    either: tuple[str, str] | None = None


def compiled(pattern: str) -> str:
    """A regex over words that have a space on either side: each word keeps its own two spaces."""
    pattern = re.sub(r"(\w+) \?(\w+)", r"(\1 \2|\1\2)", pattern)
    words = re.sub(r"[a-z0-9](?:[a-z0-9]|\[[a-z]+\])*", lambda m: f"_{m[0]}_", pattern.replace("(", "(?:"))
    return words.replace(" ", "").replace("_", " ")


def rules() -> list[Rule]:
    """All rules in their order."""
    out = [Rule(f"notice:{i}", label, 0, 0.98, keyword, compiled(text)) for i, (label, text, keyword) in enumerate(NOTICES)]
    for form, priority, confidence, around in (TAG, *FORMS):
        for i, (label, name, spdx, keyword) in enumerate(LICENSES):
            regex = around.replace("{name}", f"({name})" if form != "name" else name).replace("{spdx}", spdx)
            out.append(Rule(f"{form}:{i}", label, priority, confidence, "spdx" if form == "tag" else keyword, compiled(regex), None if form == "tag" else EITHER.get(label)))
    return out


RULES = rules()


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, each with a space on either side; "" without words."""
    # lower() makes ASCII of two other letters; with these replaced it serves, as only a-z and 0-9 are compared
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9"))
    words = F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def n_words(spaced: Column) -> Column:
    """Words of a stretch of :func:`spaced_words`."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _base(spaced: Column, phrase: str) -> Column:
    """Places of a phrase: their number and the words before the first and the last."""
    regex, size = compiled(phrase), phrase.count(" ") + 1
    parts = F.split(spaced, regex, -1)
    found = F.struct(
        (F.size(parts) - 1).cast("long").alias("n"),
        n_words(F.element_at(parts, 1)).alias("first"),
        (n_words(spaced) - n_words(F.element_at(parts, -1)) - size).alias("last"),
    )
    return F.when(F.contains(spaced, F.lit(regex)), found)


#: Elements of a block of :func:`_fold`.
FOLD = 256


def _fold(items: Column, state: Column, kind: str, step) -> Column:
    """The elements that ``step(state, item)`` makes, as struct(state, found or null), in order: appended within a block, then block by block."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        made = step(acc["state"], x)
        return F.struct(made["state"].alias("state"), F.when(made["found"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(made["found"]))).alias("found"))

    def block(acc: Column, i: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), none.alias("found"))
        return F.aggregate(F.slice(items, i * FOLD + 1, F.lit(FOLD)), start, one, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["found"], F.array(r["found"])).alias("found")))

    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / FOLD).cast("int"))
    zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("found"))
    return F.aggregate(blocks, zero, block, lambda acc: F.flatten(acc["found"]))


def _constant(value: object, kind: str) -> Column:
    """A nested constant, which the optimiser folds to one literal: hundreds of literals of their own make a plan slow to analyse."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(spaced: Column, rule: Column) -> Column:
    """Detections of one rule as structs, in word positions."""
    hits, parts = F.regexp_extract_all(spaced, rule["regex"], F.lit(0)), F.split(spaced, rule["regex"], F.lit(-1))

    def step(at: Column, x: Column) -> Column:
        start = at + n_words(x["part"])
        end = start + n_words(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["id"].alias("rule"))
        return F.struct(end.alias("state"), one.alias("found"))

    # the part after the last hit has none beside it
    pairs = F.filter(F.arrays_zip(hits.alias("hit"), parts.alias("part")), lambda x: x["hit"].isNotNull())
    return _bound(pairs, lambda p: _fold(p, F.lit(0).cast("long"), "struct<start:bigint,`end`:bigint,priority:int,rule:int>", step))


def _suppress(found: Column) -> Column:
    """Detections that lie in no other of the same or a higher priority."""
    levels = 1 + max(r.priority for r in RULES)
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["rule"].alias("rule"))))

    # tops: how far detections of each priority reach so far
    def step(tops: Column, d: Column) -> Column:
        inside = F.exists(F.slice(tops, F.lit(1), d["priority"] + 1), lambda t: t >= -d["back"])
        reach = F.transform(tops, lambda t, i: F.when(i == d["priority"], F.greatest(t, -d["back"])).otherwise(t))
        kept = F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"))
        return F.struct(reach.alias("state"), F.when(~inside, kept).alias("found"))

    return _bound(ordered, lambda x: _fold(x, F.array_repeat(F.lit(-1).cast("long"), levels), "struct<start:bigint,`end`:bigint,priority:int,rule:int>", step))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with n_words, the base phrases' columns, detections, labels and score.

    Columns of these names are replaced.  Detections are structs of label, first word, word after the last, rule and confidence.
    """
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score", "_spaced", "_found", "_kept", "_labels", *[f"_base{i}" for i in range(len(BASE))])
    # rules stand by their keywords, so that a keyword is looked for once
    by: dict[tuple[str, str | None], list[dict]] = {}
    for i, r in enumerate(rules):
        by.setdefault(r.either or (r.keyword, None), []).append({"regex": r.regex, "priority": r.priority, "id": i})
    table = _constant([{"keyword": a, "other": b, "rules": some} for (a, b), some in by.items()], "array<struct<keyword:string,other:string,rules:array<struct<regex:string,priority:int,id:int>>>>")
    told = _constant([{"label": r.label, "name": r.name, "confidence": r.confidence} for r in rules], "array<struct<label:string,name:string,confidence:double>>")
    spaced = F.col("_spaced")
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(spaced, F.lit(word.replace(" ", "  ")))
    held = F.filter(table, lambda g: F.contains(spaced, g["keyword"]) | F.contains(spaced, g["other"]))
    run = F.flatten(F.transform(F.flatten(F.transform(held, lambda g: g["rules"])), lambda r: _spans(spaced, r)))
    out = docs.withColumn("_spaced", spaced_words(docs["text"]))
    out = out.withColumns({f"_base{i}": _base(spaced, phrase) for i, (phrase, _) in enumerate(BASE)} | {"_found": F.when(gate, run)})
    out = out.withColumn("_kept", F.when(F.size("_found") > 0, _suppress(F.col("_found"))))
    base = [F.col(f"_base{i}") for i in range(len(BASE))]
    base_labels = F.array_compact(F.array(*[F.when(b.isNotNull(), F.lit(label)) for b, (_, label) in zip(base, BASE, strict=True)]))
    detections = F.transform(
        F.coalesce("_kept", F.array().cast("array<struct<start:bigint,`end`:bigint,priority:int,rule:int>>")),
        lambda d: F.struct(F.get(told, d["rule"])["label"].alias("label"), d["start"].alias("start"), d["end"].alias("end"), F.get(told, d["rule"])["name"].alias("rule"), F.get(told, d["rule"])["confidence"].alias("confidence")),
    )
    out = out.withColumns({"detections": detections, "_labels": base_labels})
    zero = F.lit(0).cast("long")
    labels = F.array_sort(F.array_distinct(F.concat(F.col("_labels"), F.transform("detections", lambda d: d["label"]))))
    out = out.withColumns({
        "n_words": n_words(spaced),
        "n_base": sum((F.coalesce(b["n"], zero) for b in base), zero),
        "first_word": F.least(*[b["first"] for b in base]),
        "last_word": F.greatest(*[b["last"] for b in base]),
        "base_labels": F.array_join(F.array_sort("_labels"), ","),
        "labels": F.array_join(labels, ","),
        "score": F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)),
    })
    return out.drop("_spaced", "_found", "_kept", "_labels", *[f"_base{i}" for i in range(len(BASE))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base places, labels of base phrases and rules, and the best rule's confidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({i}, {quote(r.label)}, {r.priority}, {r.confidence}, {quote(r.regex)})" for i, r in enumerate(RULES))
    tried = ",\n".join(f"CASE WHEN regexp_matches(s, {quote(r.regex)}) THEN {i} END" for i, r in enumerate(RULES))
    base = ",\n".join(f"({quote(label)}, {quote(compiled(p))}, {p.count(' ') + 1})" for p, label in BASE)
    return rf"""
WITH rules(rule, label, priority, confidence, regex) AS (VALUES
{values}
), base(label, phrase, size) AS (VALUES
{base}
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), n AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS s FROM words
), bp AS (
  SELECT doc_id, label, string_split(s, phrase) AS parts, size, n_words FROM n, base WHERE contains(s, phrase)
), b AS (
  SELECT doc_id, sum(len(parts) - 1)::BIGINT AS n_base,
         min((length(parts[1]) - length(replace(parts[1], ' ', ''))) // 2)::BIGINT AS first_word,
         max(n_words - (length(parts[-1]) - length(replace(parts[-1], ' ', ''))) // 2 - size)::BIGINT AS last_word,
         list(label) AS labels
  FROM bp GROUP BY 1
), c AS (
  SELECT doc_id, rule, priority, label, confidence, string_split_regex(s, regex) AS parts, regexp_extract_all(s, regex) AS hits
  FROM (SELECT doc_id, s, unnest([{tried}]) AS rule FROM n) JOIN rules USING (rule)
), h AS (
  SELECT doc_id, rule, priority, label, confidence, unnest(range(1, len(hits) + 1)) AS i, parts, hits FROM c
), d AS (
  SELECT doc_id, rule, priority, label, confidence,
         (length(before) - length(replace(before, ' ', ''))) // 2 AS a,
         (length(before || hit) - length(replace(before || hit, ' ', ''))) // 2 AS z
  FROM (SELECT *, array_to_string(parts[1:i], '') || array_to_string(hits[1:i - 1], '') AS before, hits[i] AS hit FROM h)
), kept AS (
  SELECT * FROM d WHERE NOT EXISTS (
    SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.a <= d.a AND e.z >= d.z AND e.priority <= d.priority
      AND (e.a <> d.a OR e.z <> d.z OR e.priority < d.priority OR e.rule < d.rule))
), k AS (SELECT doc_id, list(label) AS labels, max(confidence)::DOUBLE AS score FROM kept GROUP BY 1)
SELECT n.doc_id, n.n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ','), '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM n LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


SQL = _sql()
