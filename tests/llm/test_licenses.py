import re
import time

from pyspark.sql import functions as F

from sortloom.llm import licenses
from tests.llm.helpers import both, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(text):
    w = WORD.findall((text or "").translate(FOLD))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    docs = both(spark, 1000)
    got = sorted((tuple(r) for r in licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)


def overlaps(text):
    """Detections that stay, with Python's patterns, pair by pair."""
    low, found = text.lower(), []
    for o, (label, _, priority, pattern) in enumerate(licenses.rules()):
        found += [(m.start(), -m.end(), -priority, o, label) for m in re.finditer(pattern, low)]
    found.sort()
    stays = []
    for i, (s, n, p, _, label) in enumerate(found):
        if not any(j < i and s2 <= s and n2 <= n and p2 <= p for j, (s2, n2, p2, _, _) in enumerate(found)):
            stays.append((s, -n, label))
    return stays


def test_rules_and_suppression_equal_brute_force(spark):
    lines = [
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: BSD-3-Clause", "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU Lesser General Public License v2.1 and GNU GPL v2", "a committed licensee",
        "Redistribution and use in source and binary forms, with or without modification, are permitted. All rights reserved.", "(c) 2020, in the public domain; SIL Open Font License, MIT License",
    ]
    lines += [" ".join(lines)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, line in enumerate(lines):
        assert [(d["start"], d["end"], d["label"]) for d in got[i]["detections"]] == overlaps(line), line
        assert set(got[i]["labels"].split(",")) - {""} == {x[2] for x in overlaps(line)} | set(got[i]["base_labels"].split(",")) - {""}
    assert [got[i]["labels"] for i in (0, 1, 2, 3, 4, 7)] == ["apache,apache-2.0", "gpl,gpl-3.0", "mit", "cc-by-nc-4.0", "bsd-3-clause", ""]
    assert got[7]["score"] == 0.0 and got[4]["score"] == 1.0


def test_hundreds_of_rules_with_keywords_in_what_they_match():
    assert len(licenses.rules()) > 250
    assert all(k and k == k.lower() for _, gate, _, _ in licenses.rules() for a in gate for k in a) and all(a for _, gate, _, _ in licenses.rules() for a in gate)


def test_no_rows_and_a_very_common_line(spark):
    assert licenses.scan(empty(spark)).count() == 0
    row = licenses.scan(spark.createDataFrame([(1, "Released under the MIT License.\n" * 2000)], "doc_id long, text string")).first()
    assert (row["n_base"], row["n_words"], row["last_word"]) == (2000, 10000, 9998)
    assert licenses.counted(F.lit("")) is not None


def plain(text):
    """labels, score of a text by all rules, no gate, pair by pair."""
    low, found = text.lower(), []
    for o, (label, _, p, pattern) in enumerate(licenses.rules()):
        found += [(m.start(), -m.end(), -p, o, label) for m in re.finditer(pattern, low)]
    found.sort()
    stays = [x for i, x in enumerate(found) if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in found[:i])]
    base = {k for k in brute(text)[4].split(",") if k}
    return ",".join(sorted({x[4] for x in stays} | base)), max([licenses.CONFIDENCE[-x[2]] for x in stays] + [licenses.CONFIDENCE[licenses.NAMED]] * bool(base) + [0.0])


def test_labels_and_score_equal_brute_force(spark):
    docs = both(spark, 250).select("doc_id", "text")
    wanted = sorted((str(r["doc_id"]), *plain(r["text"] or "")) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["labels"], r["score"]) for r in licenses.scan(docs).collect()) == wanted and sum(bool(w[1]) for w in wanted) > 5


def test_time_grows_with_the_text(spark):
    seconds = []
    for n in (100, 10000, 20000):
        docs = spark.createDataFrame([(1, "mit license, gpl " * n)], "doc_id long, text string")
        at = time.perf_counter()
        row = licenses.scan(docs).first()
        assert row["n_base"] == n and len(row["detections"]) == 1 * n
        seconds.append(time.perf_counter() - at)
    assert seconds[2] < 60 and seconds[2] - seconds[0] < 3 * (seconds[1] - seconds[0]) + 3, seconds


def test_no_gate_costs_a_match(spark):
    """The rules without any keyword, on wording that has no license word in it, or is wrapped as headers are."""
    lines = [
        "Released under 3-clause BSD.", "https://mozilla.org/MPL/2.0/", "https://www.eclipse.org/legal/epl-v20", "This program is freeware.", "proprietary and confidential", "without prior written consent",
        "shall be included in all copies or substantial portions", "GNU General\n# Public License version 3", "put into the public\n * domain", "SIL Open\n  Font License", "GNU Free\n// Documentation License",
        "Expat license", "Creative Commons Attribution 4.0", "PSF License", "Free Public License 1.0.0", "either version 2 or any later version", "provided 'as is', without any express or implied warranty",
        "This software is provided 'as is', without any express or implied warranty", "Open RAIL-M License", "https://www.gnu.org/licenses/gpl-3.0", "nothing of the kind, 2 0 3 4",
    ]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").unionByName(both(spark, 300).select("doc_id", "text"))
    ungated = [(label, re.compile(pattern)) for label, _, _, pattern in licenses.rules()]
    for text, r in zip([r["text"] or "" for r in docs.collect()], licenses.scan(docs).collect(), strict=True):
        found = [(m.start(), m.end(), label) for label, rx in ungated for m in rx.finditer(text.lower())]
        assert {(d["start"], d["end"], d["label"]) for d in r["detections"]} <= set(found), text
        # Whatever is suppressed lies within what stays.
        assert all(any(d["start"] <= s and e <= d["end"] for d in r["detections"]) for s, e, _ in found), text
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs.limit(len(lines))).collect()}
    assert all(got[i] for i in range(len(lines)) if i not in (16, 20)) and got[0] == "bsd-3-clause" and got[7] == "gpl,gpl-3.0"


def test_keywords_are_in_whatever_their_rules_match():
    assert licenses.pieces("a(?:b|c)? d ?e [xy]f.{1,80}? g|h?i") == [["a", "d", "e", "f", "g"], ["i"]]
    assert licenses.needed("bsd licen[sc]e|freebsd(?: x)?") == [["licen", "bsd", "e"], ["freebsd"]]
