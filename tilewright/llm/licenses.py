"""License scan: ordered signature rules over word runs, as column expressions only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.quality import behind_generate

#: Anything else is a word character once A-Z are lower-cased.
BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The phrases that every scan reports, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed values: (label, name as a regular expression over lower-case words, SPDX identifier as words, version words, anchors). A text that the name matches has one of the anchors as a word.
FAMILIES = [
    ("agpl", "(?:gnu )?(?:agpl|affero general public licen[cs]e)", "agpl", ["3 0", "3"], "agpl affero"),
    ("lgpl", "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", "lgpl", ["2 0", "2 1", "3 0", "2", "3"], "lgpl lesser library"),
    ("gpl", "(?:gnu )?(?:gpl|general public licen[cs]e)", "gpl", ["1 0", "2 0", "3 0", "1", "2", "3"], "gpl general"),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation licen[cs]e)", "gfdl", ["1 1", "1 2", "1 3"], "gfdl documentation"),
    ("apache", "apache(?: software)? licen[cs]e", "apache", ["1 0", "1 1", "2 0", "2"], "apache"),
    ("bsd", "(?:[234] clause |simplified |modified |new )?bsd(?: [234] clause)?(?: licen[cs]e)?", "bsd", ["2 clause", "3 clause", "4 clause"], "bsd"),
    ("mit", "(?:mit|expat) licen[cs]e", "mit", ["0"], "mit expat"),
    ("isc", "isc licen[cs]e", "isc", [], "isc"),
    ("mpl", "(?:mpl|mozilla public licen[cs]e)", "mpl", ["1 0", "1 1", "2 0"], "mpl mozilla"),
    ("epl", "(?:epl|eclipse public licen[cs]e)", "epl", ["1 0", "2 0"], "epl eclipse"),
    ("eupl", "(?:eupl|european union public licen[cs]e)", "eupl", ["1 1", "1 2"], "eupl union"),
    ("cddl", "(?:cddl|common development and distribution licen[cs]e)", "cddl", ["1 0", "1 1"], "cddl distribution"),
    ("artistic", "artistic licen[cs]e", "artistic", ["1 0", "2 0"], "artistic"),
    ("bsl", "boost software licen[cs]e", "bsl", ["1 0"], "bsl boost"),
    ("ofl", "(?:ofl|sil open font licen[cs]e)", "ofl", ["1 0", "1 1"], "ofl font"),
    ("osl", "open software licen[cs]e", "osl", ["2 1", "3 0"], "osl software"),
    ("afl", "academic free licen[cs]e", "afl", ["2 1", "3 0"], "afl academic"),
    ("psf", "python software foundation licen[cs]e", "psf", ["2 0", "2"], "psf python"),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", [], "ms microsoft"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", [], "zlib"),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa", [], "ncsa"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public licen[cs]e)", "wtfpl", ["2"], "wtfpl fuck"),
    ("unlicense", "(?:the )?unlicense", "unlicense", [], "unlicense"),
    ("cc0", "(?:cc0|creative commons zero|cc zero)", "cc0", ["1 0"], "cc0 zero"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", "cc by nc nd", ["2 0", "2 5", "3 0", "4 0"], "cc attribution"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by nc sa", ["2 0", "2 5", "3 0", "4 0"], "cc attribution"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", "cc by nc", ["2 0", "2 5", "3 0", "4 0"], "cc attribution"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", "cc by nd", ["2 0", "2 5", "3 0", "4 0"], "cc attribution"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", "cc by sa", ["2 0", "2 5", "3 0", "4 0"], "cc attribution"),
    ("cc-by", "(?:cc by|creative commons attribution)", "cc by", ["2 0", "2 5", "3 0", "4 0"], "cc attribution"),
    ("sspl", "(?:sspl|server side public licen[cs]e)", "sspl", ["1 0", "1"], "sspl server"),
    ("busl", "(?:busl|business source licen[cs]e)", "busl", ["1 1"], "busl business"),
    ("elastic", "elastic licen[cs]e", "elastic", ["2 0"], "elastic"),
    ("cpl", "(?:cpl|common public licen[cs]e)", "cpl", ["1 0"], "cpl common"),
    ("ipl", "(?:ipl|ibm public licen[cs]e)", "ipl", ["1 0"], "ipl ibm"),
    ("ruby", "ruby licen[cs]e", "ruby", [], "ruby"),
    ("php", "php licen[cs]e", "php", ["3 0", "3 01"], "php"),
    ("openssl", "openssl licen[cs]e", "openssl", [], "openssl"),
    ("blueoak", "blue oak model licen[cs]e", "blueoak", ["1 0 0"], "oak blueoak"),
    ("0bsd", "(?:0bsd|zero clause bsd)(?: licen[cs]e)?", "0bsd", [], "0bsd zero"),
    ("mulanpsl", "(?:mulanpsl|mulan permissive software licen[cs]e)", "mulanpsl", ["1 0", "2 0"], "mulanpsl mulan"),
    ("odbl", "(?:odbl|open database licen[cs]e)", "odbl", ["1 0"], "odbl database"),
    ("pddl", "(?:pddl|public domain dedication and licen[cs]e)", "pddl", ["1 0"], "pddl dedication"),
    ("odc-by", "open data commons attribution licen[cs]e", "odc by", ["1 0"], "odc commons"),
    ("qpl", "(?:qpl|q public licen[cs]e)", "qpl", ["1 0"], "qpl q"),
    ("cecill", "cecill(?: [bc])?(?: licen[cs]e)?", "cecill", ["1 0", "2 0", "2 1"], "cecill"),
    ("upl", "(?:upl|universal permissive licen[cs]e)", "upl", ["1 0"], "upl universal"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", [], "ms reciprocal"),
    ("lppl", "(?:lppl|latex project public licen[cs]e)", "lppl", ["1 3"], "lppl latex"),
    ("polyform", "polyform (?:noncommercial|shield|strict) licen[cs]e", "polyform", ["1 0 0"], "polyform"),
    ("w3c", "w3c software (?:notice and )?licen[cs]e", "w3c", [], "w3c"),
    ("x11", "x11 licen[cs]e", "x11", [], "x11"),
    ("postgresql", "postgresql licen[cs]e", "postgresql", [], "postgresql"),
    ("curl", "curl licen[cs]e", "curl", [], "curl"),
    ("openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", "openrail", [], "openrail"),
]
#: Fixed values: (label, pattern, level) of single rules.
SINGLE_RULES = [
    ("public-domain", "(?:released|dedicated|placed|is|in)(?: in| into| to)?(?: the)? public domain", 2),
    ("public-domain", "(?:waives?|waived) all (?:copyright|rights) (?:and related rights )?(?:to|in) (?:this|the) (?:work|software|text)", 2),
    ("public-domain", "no (?:rights|copyright) reserved", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1),
    ("cc0", "to the extent possible under law (?:[^ ]+ ){0,12}?has waived all copyright and related or neighboring rights", 1),
    ("proprietary", "all rights reserved", 3),
    ("proprietary", "(?:unauthori[sz]ed )?(?:copying|reproduction) (?:or distribution )?of this (?:file|document|work) (?:[^ ]+ ){0,8}?strictly prohibited", 2),
    ("proprietary", "(?:this (?:file|document|software) is )?proprietary and confidential", 2),
    ("proprietary", "may not be (?:copied|reproduced)(?: or distributed)? without (?:the )?(?:prior )?(?:written )?permission", 2),
    ("permissive-notice", "permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 1),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?", 1),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 0),
    ("hpnd", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted", 1),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){0,12}?nor the names of its contributors may be used to endorse or promote products", 1),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1),
    ("bsd", "redistributions of source code must retain the above copyright notice", 2),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 2),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1),
    ("zlib", "the origin of this software must not be misrepresented", 1),
    ("zlib", "altered source versions must be plainly marked as such", 1),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind", 3),
    ("warranty-disclaimer", "without even the implied warranty of merchantability or fitness for a particular purpose", 3),
    ("copyleft-notice", "this program is free software you can redistribute it and or modify it", 1),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", 1),
    ("lgpl", "under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", 1),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", 1),
    ("gpl-2.0", "as published by the free software foundation (?:either )?version 2 of the license", 0),
    ("gpl-3.0", "as published by the free software foundation (?:either )?version 3 of the license", 0),
    ("gpl", "you should have received a copy of the gnu general public license along with", 2),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with", 2),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1),
    ("gpl-exception", "as a special exception (?:[^ ]+ ){0,12}?gives? (?:you )?permission to link", 1),
    ("gpl-exception", "(?:with )?(?:the )?classpath exception", 1),
    ("gpl-exception", "(?:with )?(?:the )?(?:gcc )?runtime library exception", 1),
    ("gpl-exception", "(?:with )?(?:the )?(?:autoconf|bison|font|linking) exception", 1),
    ("llvm-exception", "(?:with )?(?:the )?llvm exceptions?", 1),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0),
    ("apache", "you may obtain a copy of the license at (?:http|https) www apache org licenses", 1),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license", 1),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0),
    ("mpl", "the contents of this file are subject to the mozilla public license", 1),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", 1),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", 1),
    ("ofl", "this font software is licensed under the sil open font license", 1),
    ("artistic", "the artistic license or the gnu general public license", 1),
    ("perl", "under the same terms as perl(?: itself)?", 2),
    ("dual-license", "dual licensed under", 2),
    ("dual-license", "(?:under|at your option) either the (?:[^ ]+ ){1,4}?licen[cs]e or", 3),
    ("dual-license", "(?:licensed )?under your choice of", 3),
    ("commercial", "(?:a )?commercial licen[cs]e (?:is available|can be obtained|may be purchased)", 2),
    ("no-derivatives", "(?:no|without) derivative works? (?:is |are )?(?:permitted|allowed)", 3),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", 2),
    ("non-commercial", "(?:free )?for personal (?:and|or) (?:educational|non ?commercial) use", 3),
    ("cc", "this work is licensed under a creative commons", 1),
    ("cc", "some rights reserved", 3),
    ("beerware", "(?:the )?beer ?ware license", 1),
    ("json", "the software shall be used for good not evil", 1),
    ("commons-clause", "commons clause (?:license )?condition", 1),
    ("gov", "this is a work of the (?:u s|united states) government", 2),
    ("license-file", "see (?:the )?(?:file )?(?:license|licence|copying)(?: txt| md)? (?:file )?for (?:more )?details", 4),
    ("license-file", "(?:the )?(?:full )?licen[cs]e (?:text )?(?:is|can be found) in the (?:file )?(?:license|licence|copying)", 4),
]
#: A rule is tried on a text that has its keyword as a word.
KEYWORDS = ["license", "licence", "licensed", "spdx", "gpl", "agpl", "lgpl", "gfdl", "bsd", "mpl", "epl", "eupl", "cddl", "ofl", "wtfpl", "unlicense", "cc0", "cc", "creative", "domain", "reserved", "hereby", "redistribution", "redistribute", "copying", "sspl", "busl", "cpl", "ipl", "0bsd", "mulanpsl", "odbl", "pddl", "qpl", "cecill", "upl", "lppl", "openrail", "copyright", "proprietary", "permission", "warranty", "prohibited", "exception", "exceptions", "redistributions", "misrepresented", "altered", "advertising", "contributors", "perl", "choice", "commercial", "noncommercial", "personal", "derivative", "evil", "clause", "government", "rights"]
#: By level of the rule: SPDX tag or full notice, grant of a named version, named version, grant, bare name.
LEVEL_SCORES = [1.0, 0.95, 0.9, 0.8, 0.6, 0.5]
GRANT = "(?:licensed|released|distributed|available|published|provided|offered|redistributed) (?:freely )?under (?:the )?(?:terms of (?:the )?)?"


def build_rules() -> list[tuple]:
    """(label, pattern, level, keywords, anchors, version), in order of priority within a level; some hundreds.

    For each family: its SPDX tag, its grant and its name, each with every version and
    bare. A version label is ``family-version``. Every match of a rule has a word from each of its three
    last lists.
    """
    rules = []

    def add(label: str, pattern: str, level: int, anchors: list[str], version: str = "") -> None:
        keywords = [k for k in KEYWORDS if _can_hold(pattern, k)]
        rules.append((label, pattern, level, keywords, anchors or keywords, version.split()[:1] or keywords))

    for label, name, spdx, versions, words in FAMILIES:
        anchors = words.split()
        for v in versions:
            dashed = f"{label}-{v.replace(' clause', '-clause').replace(' ', '.')}"
            dashed = f"{dashed}.0" if v.isdigit() and label not in ("mit", "wtfpl") else dashed
            after = f"(?: version| v)? {v}" if "clause" not in v else ""
            named = f"{name}{after}" if after else f"(?:{v} (?:simplified |modified )?bsd|bsd {v})(?: licen[cs]e)?"
            add(dashed, f"spdx license identifier {spdx} {v}(?: only| or later)?", 0, anchors, v)
            add(dashed, f"{GRANT}{named}(?: licen[cs]e)?(?: or later| or any later version)?", 1, anchors, v)
            add(dashed, f"{named}(?: or later| or any later version)?", 2, anchors, v)
        add(label, f"spdx license identifier {spdx}", 0, anchors)
        add(label, f"{GRANT}{name}", 3, anchors)
        add(label, name, 4, anchors)
    for label, pattern, level in SINGLE_RULES:
        add(label, pattern, level, [])
    return rules


def _can_hold(pattern: str, keyword: str) -> bool:
    """Whether ``keyword`` is one of the words in the pattern's text, with and without its optional letters and spaces."""
    plain = pattern.replace("licen[cs]e", "license licence")
    words: set[str] = set()
    for text in (re.sub(r"(\w|\s)\?", r"\1", plain), re.sub(r"(\w|\s)\?", "", plain)):
        words.update(re.sub(r"[()?:|\[\]^+{},]", " ", text).split())
    return keyword in words


RULES = build_rules()


def _places(norm: Column, pattern: Column) -> Column:
    """array<struct<s int, e int>>: the word runs that the pattern matches, end exclusive.

    ``norm`` is a mark, then each word after one space, then a space. Cutting in front of every
    match leaves pieces whose spaces count the words before the next match.
    """
    cut = F.split(norm, F.concat(F.lit("(?= (?:"), pattern, F.lit(") )")))
    extract = F.concat(F.lit("^( (?:"), pattern, F.lit(")) "))

    def spaces(x: Column) -> Column:
        return F.size(F.split(x, " ")) - 1

    empty = F.array().cast("array<struct<s:int,e:int>>")

    def read(pieces: Column) -> Column:
        start = F.struct(spaces(F.get(pieces, F.lit(0))).alias("n"), empty.alias("out"))

        def step(state: Column, k: Column) -> Column:
            # optional first words and bounded gaps let a rule match again inside its own match; where eight pieces do not hold it, all that follow are read
            def match(n: Column) -> Column:
                return F.call_function("regexp_extract", F.concat(F.array_join(F.slice(pieces, k, n), ""), F.lit(" ")), extract, F.lit(1))

            near = match(F.lit(8))
            size = F.when(F.length(near) > 0, spaces(near)).otherwise(spaces(match(F.size(pieces))))
            found = F.struct(state["n"].alias("s"), (state["n"] + size).alias("e"))
            return F.struct((state["n"] + spaces(F.element_at(pieces, k))).alias("n"), F.concat(state["out"], F.array(found)).alias("out"))

        found = F.aggregate(F.sequence(F.lit(2), F.size(pieces)), start, step, lambda s: s["out"])
        return F.when(F.size(pieces) < 2, empty).otherwise(found)

    # a one-element array binds the pieces, so that the text is cut once
    return F.get(F.transform(F.array(cut), read), F.lit(0))


def license_scan(docs: DataFrame, text: str = "text", rules: list | None = None) -> DataFrame:
    """Add what licenses each text names.

    A-Z are lower-cased; words are maximal runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
    Added: ``n_words``, ``n_base`` (places of the base phrases), ``first_word``, ``last_word``
    (their least and greatest start; null without any), ``base_labels``, ``labels`` (distinct,
    sorted, comma-joined; empty string without any), ``detections`` (array of start, end, label,
    level after suppression) and ``score`` (0 to 1: that of the best level, base phrases 0.5).

    Rules given here are (label, pattern, level, keywords, anchors, version words); a match must hold one of each list. A rule runs only on texts that hold a word of each of its keyword lists. Of the detections, one is dropped if
    another contains it and has a lower level, or the same level and more words, or comes
    from an earlier rule over the same words. Labels of base phrases always stay.

    A null text counts as empty. An added name that the input already has is replaced. Rows
    stand alone, so repeats and empty tables need no rule; a text of any length is scanned whole.
    """
    rules = RULES if rules is None else rules
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score"]
    names = [c for c in docs.columns if c.lower() not in added]
    keep = [F.col(f"`{c}`") for c in names]
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS), "")
    gate = sorted({k for r in rules for k in r[3]} | {"license", "cc"})
    looked_for = sorted({k for r in rules for group in r[3:] for k in group} | set(gate))
    a = docs.select(*keep, words.alias("_w"))
    hits = F.array_distinct(F.filter(F.transform(F.col("_w"), F.lower), lambda x: x.isin(looked_for)))
    a = a.select(*keep, F.size("_w").cast("long").alias("n_words"), F.col("_w"), hits.alias("_hits"))
    norm = F.concat(F.lit("^ "), F.translate(F.array_join("_w", " "), UPPER, LOWER), F.lit(" "))
    a = a.select(*keep, "n_words", "_hits", F.when(F.arrays_overlap("_hits", F.array(*map(F.lit, gate))), norm).alias("_norm"))

    # one constant: some hundred structs built one by one would take seconds of the driver
    rows = [{"p": p, "l": label, "v": level, "i": i, "k0": k0, "k1": k1, "k2": k2} for i, (label, p, level, k0, k1, k2) in enumerate(rules)]
    kind = "array<struct<p:string,l:string,v:int,i:int,k0:array<string>,k1:array<string>,k2:array<string>>>"
    table = F.from_json(F.lit(json.dumps(rows)), kind)
    base = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(label).alias("l")) for p, label in BASE_PHRASES.items()])
    on = F.col("_norm").isNotNull()
    in_base = F.filter(base, lambda r: F.contains(F.col("_norm"), F.concat(F.lit(" "), r["p"], F.lit(" "))))
    base_found = F.flatten(F.transform(in_base, lambda r: F.transform(_places(F.col("_norm"), r["p"]), lambda x: F.struct(x["s"].alias("s"), r["l"].alias("l")))))
    tried = F.filter(table, lambda r: F.arrays_overlap(r["k0"], F.col("_hits")) & F.arrays_overlap(r["k1"], F.col("_hits")) & F.arrays_overlap(r["k2"], F.col("_hits")))
    found = F.flatten(F.transform(tried, lambda r: F.transform(_places(F.col("_norm"), r["p"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), r["v"].alias("v"), r["i"].alias("i"), r["l"].alias("l")))))
    a = a.select(*keep, "n_words", F.when(on, base_found).alias("_b"), F.when(on, F.array_sort(found)).alias("_f"))

    levels = len(LEVEL_SCORES)
    kind = "array<struct<start:int,end:int,label:string,level:int>>"
    begin = F.struct(F.array(*[F.lit(-1)] * levels).alias("far"), F.array().cast(kind).alias("out"))

    def sweep(state: Column, x: Column) -> Column:
        # by start, longest first: a containing detection is met before what it contains
        covered = F.array_max(F.slice(state["far"], F.lit(1), x["v"] + 1)) >= -x["ne"]
        far = F.transform(state["far"], lambda m, k: F.when(k == x["v"], F.greatest(m, -x["ne"])).otherwise(m))
        one = F.array(F.struct(x["s"].alias("start"), (-x["ne"]).alias("end"), x["l"].alias("label"), x["v"].alias("level")))
        return F.struct(far.alias("far"), F.when(covered, state["out"]).otherwise(F.concat(state["out"], one)).alias("out"))

    none = F.array().cast(kind)
    detections = F.coalesce(F.aggregate("_f", begin, sweep, lambda s: s["out"]), none)
    a = a.select(*keep, "n_words", "_b", detections.alias("detections"))
    b = F.coalesce(F.col("_b"), F.array().cast("array<struct<s:int,l:string>>"))
    base_labels = F.array_sort(F.array_distinct(b["l"]))
    all_labels = F.array_sort(F.array_distinct(F.concat(b["l"], F.col("detections")["label"])))
    best = F.get(F.array(*[F.lit(x) for x in LEVEL_SCORES]), F.array_min(F.col("detections")["level"]))
    made = F.struct(
        "n_words",
        F.size(b).cast("long").alias("n_base"),
        F.array_min(b["s"]).cast("long").alias("first_word"),
        F.array_max(b["s"]).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        "detections",
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(b) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
    return behind_generate(a, names, made, added)
