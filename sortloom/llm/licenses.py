"""License scans, natively: ordered signature rules, each a pattern behind a keyword, with overlaps resolved by
priority and containment.

RULES are made from LICENSES and TEXTS: for each license a tag (`SPDX-License-Identifier: ...`), a statement (`licensed
under the ...`) and a mention of its name; and signatures of licenses' own wording. A rule is tried on a text only
if, of one alternative of its pattern, the keywords are in it: pieces of words that whatever it matches must hold (`needed`), so no match is lost. Of
the detections one that lies within another of the same or a higher priority is suppressed (of equal places the higher priority, then
the earlier rule, stays). A text's score is the greatest confidence of what stays.

Base phrases are looked for apart from the rules, in the words of the text; their labels always stay.

Defined results: null text counts as empty; no words give null first and last word; texts of any length are read
whole; A-Z are lower-cased (other letters too, where rules look, which no rule can tell); repeated rows get equal
results; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm.common import bound, matches, scan as scanned, table

#: Whatever isn't in a word, in a text without A-Z, and with them.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
IN_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Priorities: wording of the license itself or a tag, a statement, a mention. Confidence by priority.
OWN, STATED, NAMED = 3, 2, 1
CONFIDENCE = {OWN: 1.0, STATED: 0.9, NAMED: 0.6}

#: label; name as a pattern (a blank stands for any separators); identifiers as a pattern.
LICENSES = [
    ("mit", r"mit(?: x11)? licen[sc]e|expat licen[sc]e|x11 licen[sc]e", r"mit(?: 0| cmu)?"),
    ("apache-1.1", r"apache (?:software )?licen[sc]e(?: version| v)? ?1 1", r"apache 1 1"),
    ("apache-2.0", r"apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?|apache 2(?: 0)?(?: licen[sc]e)?", r"apache 2 0"),
    ("apache", r"apache (?:software )?licen[sc]e", r"apache"),
    ("gpl-1.0", r"(?:gnu )?general public licen[sc]e(?: version| v)? ?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", r"(?:gnu )?general public licen[sc]e(?: version| v)? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-2.0", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", r"gnu gpl 2"),
    ("gpl-3.0", r"(?:gnu )?general public licen[sc]e(?: version| v)? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-3.0", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", r"gnu gpl 3"),
    ("gpl", r"(?:gnu )?general public licen[sc]e", r"gpl"),
    ("lgpl-2.0", r"(?:gnu )?library general public licen[sc]e", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", r"(?:gnu )?lesser general public licen[sc]e", r"lgpl"),
    ("agpl-3.0", r"(?:gnu )?affero general public licen[sc]e(?: version| v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", r"agpl"),
    ("gfdl-1.3", r"gnu free documentation licen[sc]e(?: version| v)? ?1 3", r"gfdl 1 3(?: only| or later)?"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e", r"gfdl"),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: licen[sc]e)?|simplified bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?|freebsd licen[sc]e", r"bsd 2 clause"),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?", r"bsd 3 clause"),
    ("bsd-4-clause", r"(?:4|four) clause bsd(?: licen[sc]e)?|original bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?", r"bsd 4 clause"),
    ("0bsd", r"(?:zero|0) clause bsd(?: licen[sc]e)?|bsd zero clause licen[sc]e|free public licen[sc]e 1 0 0", r"0bsd"),
    ("bsd", r"bsd(?: style)? licen[sc]e", r"bsd"),
    ("isc", r"isc licen[sc]e", r"isc"),
    ("mpl-1.1", r"mozilla public licen[sc]e(?: version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-2.0", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", r"mpl 2 0"),
    ("mpl", r"mozilla public licen[sc]e", r"mpl"),
    ("epl-1.0", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", r"epl 2 0"),
    ("epl", r"eclipse public licen[sc]e", r"epl"),
    ("edl-1.0", r"eclipse distribution licen[sc]e", r"edl 1 0"),
    ("cpl-1.0", r"common public licen[sc]e", r"cpl 1 0"),
    ("cddl-1.0", r"common development and distribution licen[sc]e(?: version| v)? ?1(?: 0)?", r"cddl 1 0"),
    ("cddl", r"common development and distribution licen[sc]e", r"cddl"),
    ("eupl-1.2", r"european union public licen[sc]e(?: version| v)? ?1 2", r"eupl 1 2"),
    ("eupl", r"european union public licen[sc]e", r"eupl"),
    ("cecill-2.1", r"cecill(?: free software)? licen[sc]e(?: agreement)?(?: version| v)? ?2 1", r"cecill 2 1"),
    ("cecill", r"cecill(?: [bc])? licen[sc]e|licence cecill", r"cecill(?: [bc])?"),
    ("artistic-1.0", r"artistic licen[sc]e(?: version| v)? ?1(?: 0)?", r"artistic 1 0"),
    ("artistic-2.0", r"artistic licen[sc]e(?: version| v)? ?2(?: 0)?", r"artistic 2 0"),
    ("artistic", r"artistic licen[sc]e", r"artistic"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib"),
    ("libpng", r"libpng licen[sc]e", r"libpng(?: 2 0)?"),
    ("bsl-1.0", r"boost software licen[sc]e", r"bsl 1 0"),
    ("busl-1.1", r"business source licen[sc]e", r"busl 1 1"),
    ("sspl-1.0", r"server side public licen[sc]e", r"sspl 1 0"),
    ("elastic-2.0", r"elastic licen[sc]e", r"elastic 2 0"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", r"do what the [a-z]{4} you want to public licen[sc]e", r"wtfpl"),
    ("psf-2.0", r"python software foundation licen[sc]e|psf licen[sc]e", r"psf 2 0|python 2 0"),
    ("php-3.01", r"php licen[sc]e(?: version| v)? ?3 01", r"php 3 01"),
    ("ruby", r"ruby licen[sc]e", r"ruby"),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql"),
    ("openssl", r"openssl licen[sc]e", r"openssl"),
    ("curl", r"curl licen[sc]e", r"curl"),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e", r"ofl 1 1"),
    ("odbl-1.0", r"open (?:data commons )?(?:open )?database licen[sc]e", r"odbl 1 0"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e", r"odc by 1 0"),
    ("pddl-1.0", r"open data commons public domain dedication and licen[sc]e", r"pddl 1 0"),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    ("osl-3.0", r"open software licen[sc]e", r"osl 3 0"),
    ("afl-3.0", r"academic free licen[sc]e", r"afl 3 0"),
    ("ecl-2.0", r"educational community licen[sc]e", r"ecl 2 0"),
    ("upl-1.0", r"universal permissive licen[sc]e", r"upl 1 0"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", r"ncsa"),
    ("w3c", r"w3c (?:software )?licen[sc]e", r"w3c"),
    ("lppl-1.3c", r"latex project public licen[sc]e", r"lppl 1 3c"),
    ("blueoak-1.0.0", r"blue oak model licen[sc]e", r"blueoak 1 0 0"),
    ("mulan-2.0", r"mulan (?:psl|permissive software licen[sc]e)", r"mulanpsl 2 0"),
    ("openrail", r"(?:bigscience )?open ?rail(?: m)? licen[sc]e", r"openrail(?: m)?"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by-2.0", r"cc by 2 0|creative commons attribution 2 0", r"cc by 2 0"),
    ("cc-by-3.0", r"cc by 3 0|creative commons attribution 3 0", r"cc by 3 0"),
    ("cc-by-4.0", r"cc by 4 0|creative commons attribution 4 0", r"cc by 4 0"),
    ("cc-by-sa-3.0", r"cc by sa 3 0", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", r"cc by sa 4 0", r"cc by sa 4 0"),
    ("cc-by-nc-3.0", r"cc by nc 3 0", r"cc by nc 3 0"),
    ("cc-by-nc-4.0", r"cc by nc 4 0", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", r"cc by nd 4 0", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa 4 0", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", r"cc by nc nd 4 0", r"cc by nc nd 4 0"),
    ("cc-by-nc", r"cc by nc", r"cc by nc"),
    ("cc-by-sa", r"cc by sa", r"cc by sa"),
    ("cc-by", r"cc by", r"cc by"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [0-9])?(?: international| unported)?", r"cc sa"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [0-9])?(?: international| unported)?", r"cc nc"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [0-9])?(?: international| unported)?", r"cc nd"),
    ("cc", r"creative commons", r"cc"),
]

#: label; priority; wording of licenses and notices.
TEXTS = [
    ("mit", OWN, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", OWN, r"to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", OWN, r"shall be included in all copies or substantial portions"),
    ("mit-0", OWN, r"mit no attribution"),
    ("isc", OWN, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("apache-2.0", OWN, r"www apache org licenses license 2 0"),
    ("apache-2.0", OWN, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", OWN, r"grant of patent license subject to the terms"),
    ("gpl", OWN, r"either version [123](?: of the license)? or (?:at your option )?any later version"),
    ("gpl", OWN, r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", OWN, r"www gnu org licenses gpl 3 0"),
    ("lgpl", OWN, r"modify it under the terms of the gnu lesser general public license"),
    ("agpl", OWN, r"modify it under the terms of the gnu affero general public license"),
    ("bsd-3-clause", OWN, r"neither the name of .{1,80}? nor the names of its contributors"),
    ("bsd", OWN, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", OWN, r"all advertising materials mentioning features or use of this software"),
    ("zlib", OWN, r"this software is provided as is without any express or implied warranty"),
    ("zlib", OWN, r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", OWN, r"www boost org license 1 0"),
    ("mpl-2.0", OWN, r"mozilla org mpl 2 0"),
    ("mpl", OWN, r"this source code form is subject to the terms of the mozilla public license"),
    ("epl", OWN, r"www eclipse org legal epl"),
    ("unlicense", OWN, r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", OWN, r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", OWN, r"creativecommons org licenses by [1-4] [0-9]"),
    ("cc-by-sa", OWN, r"creativecommons org licenses by sa [1-4] [0-9]"),
    ("cc-by-nc", OWN, r"creativecommons org licenses by nc [1-4] [0-9]"),
    ("cc-by-nd", OWN, r"creativecommons org licenses by nd [1-4] [0-9]"),
    ("cc-by-nc-sa-4.0", OWN, r"creativecommons org licenses by nc sa 4 0"),
    ("public-domain", STATED, r"(?:released|dedicated|placed|put) (?:in|into|to) the public domain"),
    ("public-domain", NAMED, r"in the public domain|public domain work"),
    ("proprietary", NAMED, r"all rights reserved"),
    ("proprietary", STATED, r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", STATED, r"without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", NAMED, r"commercial licen[sc]e"),
    ("shareware", NAMED, r"this (?:program|software) is shareware"),
    ("freeware", NAMED, r"this (?:program|software) is freeware"),
    ("no-license", NAMED, r"no licen[sc]e is granted"),
]
BETWEEN = r"[^0-9a-z]{1,12}"


def spelled(pattern: str) -> str:
    """The pattern with a blank for any separators, and nothing of a word on either side."""
    return f"(?<![0-9a-z])(?:{pattern.replace(' ?', f'(?:{BETWEEN})?').replace(' ', BETWEEN)})(?![0-9a-z])"


def pieces(pattern: str) -> list[list[str]]:
    """For each alternative of a pattern the pieces of words that its every match holds; of groups none is relied on."""
    flat = pattern.replace(" ?", "\0")
    while (less := re.sub(r"\(\?:[^()]*\)\??", "\0", flat)) != flat:
        flat = less
    flat = re.sub(r"(?:\[[^\]]*\]|\.)(?:\{[^}]*\})?\??|[^\0]\?", "\0", flat)
    return [re.findall("[0-9a-z]+", a) for a in flat.split("|")]


#: Keywords of an alternative: its longest pieces.
KEYWORDS = 4


def needed(pattern: str) -> list[list[str]]:
    """For each alternative of a pattern the keywords that its every match holds: the longest pieces. A text without all of one alternative's can't match."""
    return [sorted(dict.fromkeys(sorted(a, key=lambda w: -len(w))), key=lambda w: -len(w))[:KEYWORDS] for a in pieces(pattern)]


def rules() -> list[tuple[str, list[list[str]], int, str]]:
    """(label, keywords by alternative, priority, pattern), in order."""
    out = [(label, needed(text), priority, spelled(text)) for label, priority, text in TEXTS]
    out += [(label, [["spdx"]], OWN, spelled(f"spdx license identifier (?:{ids})")) for label, _, ids in LICENSES]
    under = r"(?:licen[sc]ed|released|distributed|available|published|covered|provided|offered|shared) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
    out += [(label, [["under", *a] for a in needed(name)], STATED, spelled(f"{under}(?:{name})")) for label, name, _ in LICENSES]
    out += [(label, needed(name), NAMED, spelled(name)) for label, name, _ in LICENSES]
    return out


def counted(text: Column) -> Column:
    """Words of a text, in either case."""
    parts = F.split(text, GAP_ANY_CASE + "+", -1)
    return F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)


def phrase_pattern() -> str:
    each = "|".join(p.replace(" ", GAP + "++") for p in PHRASES)
    return f"(?<!{IN_WORD})(?:{each})(?!{IN_WORD})"


KIND = "struct<s: int, n: int, p: int, o: int, label: string>"


def detections(low: Column) -> Column:
    """array<struct<s, n, p, o, label>>: start, minus end, minus priority, rule's order, label of every match of every rule, sorted."""
    known = rules()
    keywords = sorted({k for _, gate, _, _ in known for a in gate for k in a})
    number = {k: F.lit(i) for i, k in enumerate(keywords)}
    listed = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(-priority).alias("p"), F.lit(o).alias("o"), F.lit(pattern).alias("rx"), F.array(*[F.array(*[number[k] for k in a]) for a in gate]).alias("gate"))
        for o, (label, gate, priority, pattern) in enumerate(known)
    ])
    # Each keyword is looked for once; a rule is tried if all keywords of one of its alternatives are there.
    there = F.transform(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))
    tried = bound(there, lambda held: F.filter(listed, lambda r: F.exists(r["gate"], lambda a: F.forall(a, lambda k: F.get(held, k)))))
    found = F.flatten(F.transform(tried, lambda r: F.transform(matches(low, r["rx"]), lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("n"), r["p"].alias("p"), r["o"].alias("o"), r["label"].alias("label")))))
    return F.sort_array(found)


def standing(found: Column) -> Column:
    """The detections (sorted) that don't lie within one of the same or a higher priority: those before them reach less far."""
    start = F.struct(*[F.lit(-1).alias(f"r{p}") for p in CONFIDENCE])

    def step(reached: Column, x: Column) -> tuple[Column, Column]:
        end = -x["n"]
        reach = F.when(x["p"] == -OWN, reached[f"r{OWN}"]).when(x["p"] == -STATED, F.greatest(reached[f"r{OWN}"], reached[f"r{STATED}"])).otherwise(F.greatest(*[reached[f"r{p}"] for p in CONFIDENCE]))
        # What is suppressed reaches no further than what suppresses it.
        more = F.struct(*[F.when((x["p"] == -p) & (end > reach), end).otherwise(reached[f"r{p}"]).alias(f"r{p}") for p in CONFIDENCE])
        return more, F.when(end > reach, x)

    return F.filter(scanned(found, start, KIND, step), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, labels, score, and detections (start, end, label, priority) of each row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t")).withColumn("low", F.lower("t"))
    empty = F.expr(f"cast(array() as array<{KIND}>)")
    rows = rows.withColumn("base", F.when(F.contains("low", F.lit("license")), matches(F.col("low"), phrase_pattern())).otherwise(F.expr("cast(array() as array<struct<s: int, e: int, v: string>>)")))
    rows = rows.withColumn("found", detections(F.col("low")))
    rows = rows.withColumn("stays", F.when(F.size("found") > 0, standing(F.col("found"))).otherwise(empty))
    words_before = lambda at: F.when(F.size("base") > 0, counted(F.concat(F.substr("low", F.lit(1), at["s"]), F.lit(" ")))).cast("bigint")
    base_labels = F.array_distinct(F.transform("base", lambda m: F.when(F.startswith(m["v"], F.lit("mit")), F.lit("mit")).when(F.startswith(m["v"], F.lit("apache")), F.lit("apache")).otherwise(F.lit("gpl"))))
    rows = rows.withColumn("bl", F.sort_array(base_labels))
    confidence = F.transform("stays", lambda d: F.when(d["p"] == -OWN, F.lit(CONFIDENCE[OWN])).when(d["p"] == -STATED, F.lit(CONFIDENCE[STATED])).otherwise(F.lit(CONFIDENCE[NAMED])))
    all_labels = F.sort_array(F.array_union("bl", F.transform("stays", lambda d: d["label"])))
    return rows.select(
        "doc_id",
        counted(F.col("t")).cast("bigint").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"),
        words_before(F.try_element_at("base", F.lit(1))).alias("first_word"),
        words_before(F.try_element_at("base", F.lit(-1))).alias("last_word"),
        F.array_join("bl", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(confidence), F.lit(0.0)), F.when(F.size("bl") > 0, CONFIDENCE[NAMED]).otherwise(0.0)).alias("score"),
        F.transform("stays", lambda d: F.struct(d["s"].alias("start"), (-d["n"]).alias("end"), d["label"].alias("label"), (-d["p"]).alias("priority"))).alias("detections"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
