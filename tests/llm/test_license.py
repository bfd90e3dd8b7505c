"""License rules against a plain version without prefilter, and long texts."""

import re

from skein.llm import license_scan


def plain(text):
    """Labels by trying every rule on the words; intervals inside one of the same or a higher priority go."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = "".join(f" {x} " for x in w)
    found = []
    for i, r in enumerate(license_scan.RULES):
        for m in re.finditer(r.regex, s):
            found.append((s[: m.start()].count(" ") // 2, s[: m.end()].count(" ") // 2, r.priority, i))
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:2] != d[:2] or (e[2], e[3]) < (d[2], d[3])) for e in found)]
    return sorted({license_scan.RULES[d[3]].label for d in kept} | {label for p, label in license_scan.BASE if license_scan.compiled(p) in s})


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file",
    "MİT LICENSE and MIT KLICENSE; do what the fuK you want",
    "Licensed under Creative Commons Attribution-ShareAlike 4.0.",
    "CREATIVE COMMONS ZERO 1.0 universal",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. GNU General Public License v3, or the MIT license",
    "The Software shall be used for Good, not Evil. Proprietary and confidential.",
    "a paragraph on licence fees, published under pressure",
    "THE FONT SOFTWARE may be sold as part of a larger software package. BSD 3-Clause License",
    "must prominently offer all users interacting with it remotely through a computer network",
]


def test_labels_are_those_of_a_plain_scan(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert got == {i: ",".join(plain(t)) for i, t in enumerate(TEXTS)}
    assert got[1] == "" and got[2] == "cc-by-sa-4.0" and got[3] == "cc0-1.0"


def test_long_text_full_of_license_lines(spark):
    line = "Released under the MIT License.\nSPDX-License-Identifier: Apache-2.0\n"
    r = license_scan.scan(spark.createDataFrame([(1, line * 2000)], "doc_id long, text string")).first()
    assert r.n_base == 2000 and r.labels == "apache-2.0,mit" and len(r.detections) == 4000
    assert [d.start for d in r.detections[:3]] == [0, 5, 11] and r.detections[-1].end == r.n_words == 22_000
