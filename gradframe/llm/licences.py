"""License scan: ordered signatures behind a keyword gate, overlaps resolved by priority.

A signature is a regular expression over the lower-cased words of a text, joined
by single spaces. There are sentences of well-known license texts, headers and notices, written out one by
one, and short forms built by rule: every license name in the table is put into every form. A text is matched only against signatures
whose keyword and name it contains; the words of a text are only looked at if it passes a gate made from the same tables. Detections are sorted by start, longest first; one inside an
accepted detection is suppressed, and of two that overlap partly the one with
the better priority stays. The accepted labels join those of the base phrases.

Defined cases: a null text counts as empty (zero words, null places, empty
labels, score 0); texts of any length are read whole; repeated rows give repeated results; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import UPPER, positions, starts, text_of

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # fixed values: what separates words, before lower-casing
# fixed values: base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: license names as words, the phrases of which a text with the name has one, and the versions; "" is no version
NAMES = {
    "mit": ("mit|expat", "mit|expat", ("",)),
    "apache": ("apache(?: software)?", "apache", ("1 0", "1 1", "2 0", "")),
    "gpl": ("(?:gnu )?(?:general public|gpl)", "general public|gpl", ("1", "2", "3", "")),
    "lgpl": ("(?:gnu )?(?:(?:lesser|library) general public|lgpl)", "lesser general public|library general public|lgpl", ("2", "2 1", "3", "")),
    "agpl": ("(?:gnu )?(?:affero general public|agpl)", "affero general public|agpl", ("1", "3", "")),
    "fdl": ("gnu free documentation|gfdl", "gnu free documentation|gfdl", ("1 1", "1 2", "1 3", "")),
    "bsd": ("(?:new |modified |simplified )?bsd", "bsd", ("2 clause", "3 clause", "4 clause", "")),
    "mpl": ("mozilla public|mpl", "mozilla public|mpl", ("1 0", "1 1", "2 0", "")),
    "epl": ("eclipse public|epl", "eclipse public|epl", ("1 0", "2 0", "")),
    "cddl": ("common development and distribution|cddl", "common development and distribution|cddl", ("1 0", "1 1", "")),
    "isc": ("isc", "isc", ("",)),
    "zlib": ("zlib(?: libpng)?", "zlib", ("",)),
    "artistic": ("artistic", "artistic", ("1 0", "2 0", "")),
    "boost": ("boost software", "boost software", ("1 0", "")),
    "unlicense": ("unlicense", "unlicense", ("",)),
    "wtfpl": ("wtfpl|do what the fuck you want to public", "wtfpl|do what the fuck you want to public", ("",)),
    "psf": ("python software foundation|psf", "python software foundation|psf", ("2", "")),
    "ofl": ("sil open font|ofl", "sil open font|ofl", ("1 0", "1 1", "")),
    "eupl": ("european union public|eupl", "european union public|eupl", ("1 1", "1 2", "")),
    "cc-by-nc-nd": ("cc by nc nd|creative commons attribution non ?commercial no ?deriv\\w+", "cc by nc nd|creative commons attribution", ("2 0", "3 0", "4 0", "")),
    "cc-by-nc-sa": ("cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc by nc sa|creative commons attribution", ("2 0", "3 0", "4 0", "")),
    "cc-by-nc": ("cc by nc|creative commons attribution non ?commercial", "cc by nc|creative commons attribution", ("2 0", "3 0", "4 0", "")),
    "cc-by-nd": ("cc by nd|creative commons attribution no ?deriv\\w+", "cc by nd|creative commons attribution", ("2 0", "3 0", "4 0", "")),
    "cc-by-sa": ("cc by sa|creative commons attribution share ?alike", "cc by sa|creative commons attribution", ("2 0", "3 0", "4 0", "")),
    "cc-by": ("cc by|creative commons attribution", "cc by|creative commons attribution", ("2 0", "2 5", "3 0", "4 0", "")),
    "cc0": ("cc0|cc zero|creative commons zero", "cc0|cc zero|creative commons zero", ("1 0", "")),
}
# fixed values: notice forms by priority (0 is best), the weight of a detection, and the keyword it needs
FORMS = (
    (0, 0.98, "spdx license identifier (?:{name}){version}", "spdx"),
    (1, 0.95, "(?:licensed|released|distributed|published|available|provided)(?: \\w+){0,4}? under(?: the)?(?: terms of(?: the)?)? (?:{name})(?: license)?{version}", "under"),
    (2, 0.85, "(?:{name}) license{version}", "license"),
    (3, 0.6, "license (?:{name}){version}", "license"),
    (4, 0.5, "(?:{name}){needed}", ""),
)
# fixed values: notices that name no license: label, words, keyword, priority, weight
NOTICES = (
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary", 1, 0.8),
    ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", "public domain", 1, 0.8),
    ("permissive", "permission is hereby granted free of charge to any person", "permission is hereby", 1, 0.9),
    ("permissive", "redistribution and use in source and binary forms", "redistribution and use", 1, 0.9),
    ("copyright", "copyright (?:c )?(?:[0-9]{4}|by|holders?)", "copyright", 5, 0.4),
)
# fixed values: sentences of well-known license texts, headers and notices, by label
TEXTS = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "licensed under either of apache license version 2 0 or mit license at your option",
    ),
    "isc": (
        "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted",
        "the software is provided as is and the author disclaims all warranties with regard to this software",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions",
        "this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties",
    ),
    "bsd-3-clause": (
        "neither the name of(?: \\w+){1,8} nor the names of its contributors may be used to endorse or promote products",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-4-clause": (
        "all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
        "this product includes software developed by the university of california berkeley and its contributors",
    ),
    "apache-2.0": (
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at https? www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide",
    ),
    "apache-1.1": ("this product includes software developed by the apache software foundation https? www apache org",),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "(?:this program|it) is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
        "you should have received a copy of the gnu general public license along with this (?:program|software|package)",
        "free software foundation inc 675 mass(?:achusetts)? ave(?:nue)? cambridge ma 02139 usa",
        "free software foundation inc 59 temple place(?: suite 330)? boston ma 02111 1307 usa",
        "free software foundation inc 51 franklin st(?:reet)? fifth floor boston ma 02110 1301 usa",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ),
    "gpl-2": (
        "the licenses for most software are designed to take away your freedom to share and change it",
        "under the terms of the gnu general public license version 2 only",
    ),
    "gpl-2-or-later": ("either version 2 of the license or at your option any later version",),
    "gpl-3": ("the gnu general public license is a free copyleft license for software and other kinds of works",),
    "gpl-3-or-later": ("either version 3 of the license or at your option any later version",),
    "gpl-exception": (
        "as a special exception the copyright holders(?: of this \\w+)? give you permission to link",
        "linking this library statically or dynamically with other modules is making a combined work based on this library",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
        "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)",
    ),
    "lgpl-2.1-or-later": ("either version 2 1 of the license or at your option any later version",),
    "agpl": (
        "it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license",
        "remote network interaction use with the gnu general public license",
    ),
    "fdl": (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "with no invariant sections no front cover texts and no back cover texts",
    ),
    "mpl-1.1": ("the contents of this file are subject to the mozilla public license version 1 1",),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "this source code form is incompatible with secondary licenses as defined by the mozilla public license",
    ),
    "mpl-gpl": ("alternatively the contents of this file may be used under the terms of either the gnu general public license",),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license",),
    "cpl": (
        "this program and the accompanying materials are made available under the terms of the common public license",
        "the accompanying program is provided under the terms of this common public license",
    ),
    "cddl": (
        "the contents of this file are subject to the terms of the common development and distribution license",
        "when distributing covered code include this cddl header in each file and include the license file",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution",
    ),
    "boost-1.0": (
        "distributed under the boost software license version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
    ),
    "cc0": (
        "to the extent possible under law(?: \\w+){0,10} waived all copyright and related or neighboring rights",
        "the person who associated a work with this deed has dedicated the work to the public domain",
    ),
    "cc-by": (
        "this work is licensed under (?:the|a) creative commons attribution (?:[0-9] [0-9] )?(?:international |unported |generic )?license",
        "you must give appropriate credit provide a link to the license and indicate if changes were made",
    ),
    "cc-by-sa": ("if you remix transform or build upon the material you must distribute your contributions under the same license",),
    "cc-nc": ("you may not use the material for commercial purposes",),
    "cc-nd": ("if you remix transform or build upon the material you may not distribute the modified material",),
    "cc": (
        "you are free to share copy and redistribute the material in any medium or format",
        "you may not apply legal terms or technological measures that legally restrict others from doing anything the license permits",
        "you accept and agree to be bound by the terms and conditions of this creative commons",
    ),
    "artistic": (
        "the intent of this document is to state the conditions under which a package may be copied",
        "you can redistribute it and or modify it under the terms of the artistic license",
    ),
    "perl": ("you can redistribute it and or modify it under the same terms as perl itself",),
    "psf-2": (
        "this license agreement is between the python software foundation psf and the individual or organization",
        "psf is making python available to licensee on an as is basis",
    ),
    "php": ("this product includes php software freely available from",),
    "openssl": (
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        "this product includes cryptographic software written by eric young",
    ),
    "unicode": ("permission is hereby granted free of charge to any person obtaining a copy of the unicode data files",),
    "w3c": ("permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty",),
    "hpnd": ("permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that",),
    "json": ("the software shall be used for good not evil",),
    "beerware": ("as long as you retain this notice you can do whatever you want with this stuff",),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed",),
    "blessing": ("the author disclaims copyright to this source code in place of a legal notice here is a blessing",),
    "us-government": (
        "not subject to copyright protection(?: and is)?(?: in)? the(?: public domain| united states)",
        "use duplication or disclosure by the (?:u s )?government is subject to (?:the )?restrictions",
    ),
    "sspl": ("server side public license",),
    "busl": ("business source license 1 1", "change date(?: \\w+){0,8} change license"),
    "elastic": ("elastic license 2 0",),
    "commons-clause": ("the software is provided to you by the licensor under the license as defined below subject to the following condition",),
    "polyform": ("polyform (?:noncommercial|small business|shield|perimeter|strict) license",),
    "ms-pl": ("microsoft public license",),
    "ms-rl": ("microsoft reciprocal license",),
    "apsl": ("apple public source license",),
    "ipl": ("ibm public license version 1 0",),
    "npl": ("netscape public license version 1 1",),
    "qpl": ("the q public license version 1 0",),
    "afl": ("licensed under the academic free license version",),
    "osl": ("licensed under the open software license version",),
    "ncsa": ("university of illinois ncsa open source license",),
    "mulan": ("mulan permissive software license version 2",),
    "blueoak": ("blue oak model license",),
    "cecill": ("this software is governed by the cecill license under french law",),
    "odbl": ("made available under the open database license", "any rights in individual contents of the database are licensed under"),
    "ogl": ("contains public sector information licensed under the open government licence",),
    "oracle-bcl": ("oracle binary code license agreement",),
    "rust-dual": ("may not be copied modified or distributed except according to those terms",),
    "proprietary": (
        "this software is the confidential and proprietary information of",
        "unauthorized (?:copying|reproduction|use|distribution|duplication)(?: \\w+){0,8} is strictly prohibited",
        "this is an unpublished work protected (?:under|by) copyright",
        "licensed materials property of",
        "contains trade secrets and proprietary information",
    ),
    "reserved": (
        "no part of this (?:publication|book|document|work|report) may be reproduced",
        "may not be reproduced distributed or transmitted in any form or by any means",
        "reproduction in whole or in part without(?: written)? permission is prohibited",
    ),
    "eula": (
        "this end user license agreement is a legal agreement between you",
        "by installing copying or otherwise using (?:the|this) software(?: product)? you agree to be bound",
        "you may not reverse engineer decompile or disassemble",
        "this license is effective until terminated",
        "the software is licensed not sold",
    ),
    "disclaimer": (
        "to the maximum extent permitted by applicable law",
        "disclaims? (?:all|any) (?:liability|warranties|responsibility)",
        "provided as is without warrant(?:y|ies) of any kind",
        "implied warranties of merchantability fitness for a particular purpose and non ?infringement",
    ),
}
# fixed values: words of which every text above has one
SIGNS = (
    "licen[cs]", "copyright", "warrant", "permission", "permitted", "redistribut", "proprietary", "public domain", "liab", "disclaim",
    "free software", "this product includes", "unencumbered", "free to copy", "misrepresented", "removed or altered", "endorse or promote",
    "advertising materials", "linking this library", "invariant sections", "commercial purposes", "modified material", "package may be copied",
    "perl itself", "making python available", "good not evil", "retain this notice", "government is subject", "change date", "mpl", "combined work",
    "may not be copied", "strictly prohibited", "trade secrets", "may be reproduced", "not be reproduced", "property of", "decompile", "agree to be bound",
)
START = r"(?<![0-9A-Za-z\x{80}-\x{10FFFF}])"  # where a word begins


def gate() -> str:
    """Regular expression that finds something in every text with a base phrase or a signature's match.

    It is made from the tables: the base phrases, the notices, the beginning of
    each form, and the names that need no form, all with any separators.
    """
    heads = ["spdx", "license", FORMS[1][2].partition(" under")[0] + " under"]
    bare = [words for words, _, versions in NAMES.values() if any(versions)]
    every = [*PHRASES, *heads, *[body for _, body, *_ in NOTICES], *SIGNS, *bare]
    plain = "|".join(f"(?:{x})" for x in dict.fromkeys(every))
    return f"(?i){START}(?:" + plain.replace("\\w", "[0-9A-Za-z]").replace(" ?", f"{GAP[:-1]}*").replace(" ", GAP) + ")"


def groups() -> list[tuple[list[str], list[tuple[str, str, str, int, float]]]]:
    """The signatures by license: phrases of which a text must hold one, then
    ``(label, regular expression, keyword, priority, weight)`` for every version and form."""
    out = []
    for name, (words, keys, versions) in NAMES.items():
        own = []
        for version in versions:
            label = "-".join([name, version.replace(" clause", "-clause").replace(" ", ".")]).rstrip("-")
            number = version if version.endswith("clause") else f"(?:version |v )?v?{version}(?: 0)?"
            tail = f" (?:or later )?{number}" if version else ""
            if version.endswith("clause"):
                words_now, tail = f"(?:{version} (?:{words})|(?:{words}) {version})", ""
            else:
                words_now = words
            for priority, weight, form, keyword in FORMS:
                if "{needed}" in form and not version:
                    continue  # a bare name without a version says nothing
                body = form.replace("{name}", words_now).replace("{version}", tail).replace("{needed}", tail)
                own.append((label, f"(?<= )(?:{body})(?= )", keyword, priority, weight))
        out.append(([f" {key} " for key in keys.split("|")], own))
    texts = [(label, body, _plain(body), 1, 0.9) for label, bodies in TEXTS.items() for body in bodies]
    out += [([keyword], [(label, f"(?<= )(?:{body})(?= )", keyword, p, w)]) for label, body, keyword, p, w in (*NOTICES, *texts)]
    return out


def _plain(body: str) -> str:
    """The longest stretch of a notice that stands in its texts as it is."""
    parts = re.split(r"\(\?:[^()]*\)(?:\?|\{[^}]*\})?|\[[^\]]*\]|.\?", body)
    return max((part.strip() for part in parts), key=len)


def signatures() -> list[tuple[str, str, str, int, float]]:
    """All signatures."""
    return [s for _, own in groups() for s in own]


def _table() -> Column:
    """The signatures as one constant array of groups; constant folding builds it once."""
    row = lambda label, body, keyword, priority, weight: F.struct(
        F.lit(label).alias("label"), F.lit(body).alias("pattern"), F.lit(keyword).alias("keyword"),
        F.lit(priority).alias("priority"), F.lit(weight).alias("weight"),
    )
    return F.array(*[
        F.struct(F.array(*map(F.lit, keys)).alias("keys"), F.array(*[row(*s) for s in own]).alias("own"))
        for keys, own in groups()
    ])


def _detections(joined: Column) -> Column:
    """All matches of all signatures whose keyword is there, in the order of resolution."""

    def of(s: Column) -> Column:
        matches = F.regexp_extract_all(joined, s["pattern"], F.lit(0))
        pieces = F.split(joined, s["pattern"], -1)
        begin = F.when(F.size(matches) > 0, starts(matches, pieces))
        return F.transform(
            F.coalesce(begin, F.array().cast("array<bigint>")),
            lambda at, k: F.struct(
                at.alias("start"),
                (-(at + F.length(F.get(matches, k)))).alias("minus_end"),
                s["priority"].alias("priority"),
                s["label"].alias("label"),
                s["weight"].alias("weight"),
            ),
        )

    near = F.filter(_table(), lambda g: F.exists(g["keys"], lambda k: F.contains(joined, k)))
    keyed = F.flatten(F.transform(near, lambda g: F.filter(g["own"], lambda s: F.contains(joined, s["keyword"]))))
    return F.sort_array(F.flatten(F.transform(keyed, of)))


def _resolved(found: Column) -> Column:
    """Sweep over the sorted detections: accepted labels and the chance that none of them is right.

    ``last`` is the newest accepted detection; its label is only counted once
    the next one that does not displace it comes.
    """
    none = F.array().cast("array<string>")
    begin = F.struct(
        none.alias("labels"), F.lit(1.0).alias("miss"), F.lit(-1).cast("bigint").alias("end"),
        F.lit(99).alias("priority"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("weight"),
    )

    def state(labels, miss, end, priority, label, weight):
        names = ("labels", "miss", "end", "priority", "label", "weight")
        return F.struct(*[c.alias(n) for c, n in zip((labels, miss, end, priority, label, weight), names)])

    def counted(acc: Column) -> Column:
        return F.when(acc["label"].isNull(), acc["labels"]).otherwise(
            F.array_union(acc["labels"], F.array(acc["label"]))
        )

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        inside, beside = end <= acc["end"], d["start"] >= acc["end"]
        new = state(counted(acc), acc["miss"] * (F.lit(1.0) - acc["weight"]), end, d["priority"], d["label"], d["weight"])
        over = state(acc["labels"], acc["miss"], end, d["priority"], d["label"], d["weight"])
        return (
            F.when(inside, acc).when(beside, new).when(d["priority"] < acc["priority"], over).otherwise(acc)
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            counted(acc).alias("labels"), (acc["miss"] * (F.lit(1.0) - acc["weight"])).alias("miss")
        )

    return F.aggregate(found, begin, step, finish)


def _places(phrase: str) -> Column:
    """Word numbers at which a phrase stands."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & (F.get("words", i + k) == part)
        return same

    return F.filter(positions(F.size("words") - len(parts) + 1), here)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License detections of every text, as the columns named in the query's contract.

    ``score`` is the chance that at least one of the detections is right, taking
    their weights as independent; a base phrase counts with 0.5.
    """
    whole = df.select(df[key].alias("doc_id"), text_of(df, text).alias("text"))
    split = whole.select(
        "doc_id",
        F.array_remove(F.split("text", GAP), "").alias("words"),
        F.col("text").rlike(gate()).alias("gate"),
    )
    none = F.array().cast("array<string>")
    lowered = F.split(F.translate(F.array_join("words", " "), UPPER, UPPER.lower()), " ")
    gated = split.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.when(F.col("gate"), lowered).otherwise(none).alias("words"),
    )
    placed = gated.select(
        "doc_id",
        "n_words",
        F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("joined"),
        *[_places(p).alias(label) for p, label in PHRASES.items()],
    )
    every = F.concat(*[F.col(f"`{label}`") for label in PHRASES.values()])
    base = F.sort_array(
        F.array_compact(F.array(*[F.when(F.size(f"`{x}`") > 0, F.lit(x)) for x in PHRASES.values()]))
    )
    empty = F.struct(none.alias("labels"), F.lit(1.0).alias("miss"))
    found = placed.select(
        "doc_id",
        "n_words",
        every.alias("every"),
        base.alias("base"),
        F.when(F.length("joined") > 2, _detections(F.col("joined"))).alias("found"),
    ).select(
        "doc_id", "n_words", "every", "base",
        F.when(F.size("found") > 0, _resolved(F.col("found"))).otherwise(empty).alias("more"),
    )
    labels = F.sort_array(F.array_union("base", F.col("more.labels")))
    miss = F.col("more.miss") * F.when(F.size("base") > 0, 0.5).otherwise(1.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("every").cast("bigint").alias("n_base"),
        F.array_min("every").cast("bigint").alias("first_word"),
        F.array_max("every").cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.round(F.lit(1.0) - miss, 6).alias("score"),
    )
