"""Licence scans by sentence rules. DataFrame operations only.

A text is normalised (lower case, runs of other characters than letters and digits as
one space) and cut at sentence ends, blank lines and line breaks. A line break may also
be a mere wrap: a known licence sentence is found where its words run over several lines
of a paragraph, comment prefixes between them or not, as well as on a line of its own.
A known sentence may have variable parts, ``<...>``, of some words (holders' names, years). All known sentences
are found by one expression, and a map from normalised sentences gives their identifiers; a text becomes the
sequence of them. A rule is an ordered sequence of identifiers, and holds where they follow each other with at
most ``gap`` unknown sentences between neighbours.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence -> its rules, each a list of sentences in order.
RULES: dict[str, list[list[str]]] = {
    "MIT": [
        ["Released under the MIT License."],
        ["Licensed under the MIT License."],
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ],
    ],
    "Apache-2.0": [
        ["Licensed under the Apache License, Version 2.0."],
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\");",
            "you may not use this file except in compliance with the License.",
        ],
    ],
    "GPL-3.0": [
        ["This work is licensed under the GNU General Public License, version 3."],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
            "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ],
    ],
    "CC-BY-NC-4.0": [
        ["Licensed under CC BY-NC 4.0."],
        ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    ],
    "CC-BY-4.0": [
        ["Licensed under CC BY 4.0."],
        ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    ],
    "CC0-1.0": [["This work is dedicated to the public domain under CC0 1.0."]],
    "BSD-3-Clause": [
        [
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ]
    ],
    "BSD-2-Clause": [
        [
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ]
    ],
    "MPL-2.0": [["This Source Code Form is subject to the terms of the Mozilla Public License, v.", "2.0."]],
    "ISC": [
        ["Licensed under the ISC License."],
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ],
        [
            "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ],
    ],
    "GPL-2.0": [
        ["This work is licensed under the GNU General Public License, version 2."],
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
        ],
        ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    ],
    "LGPL-2.1": [
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ],
        ["Licensed under the GNU Lesser General Public License, version 2.1."],
    ],
    "LGPL-3.0": [
        [
            "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ],
        ["Licensed under the GNU Lesser General Public License, version 3."],
    ],
    "AGPL-3.0": [
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ],
        ["Licensed under the GNU Affero General Public License, version 3."],
    ],
    "Unlicense": [
        [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ],
    ],
    "EPL-2.0": [
        ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <address>."],
        ["Licensed under the Eclipse Public License 2.0."],
    ],
    "Zlib": [
        [
            "This software is provided 'as-is', without any express or implied warranty.",
            "In no event will the authors be held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        ],
    ],
    "BSL-1.0": [["Distributed under the Boost Software License, Version 1.0."], ["Licensed under the Boost Software License, Version 1.0."]],
    "CC-BY-SA-4.0": [
        ["Licensed under CC BY-SA 4.0."],
        ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    ],
    "CC-BY-ND-4.0": [
        ["Licensed under CC BY-ND 4.0."],
        ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    ],
}
#: A further form of a known rule: the holder's own name stands in the third clause.
RULES["BSD-3-Clause"].append([*RULES["BSD-3-Clause"][0][:2], "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."])
#: The most words of a variable part.
VARIABLE_WORDS = 12

#: A sentence ends at one of these followed by white space, or at a blank line; it may end at a line break.
SENTENCE_END = r"([.!?;:])\s+"
#: Comment prefixes made of letters (others are no words anyway).
COMMENT_WORDS = r"(?m)^[ \t]*(?:dnl|rem)(?=[ \t\r\n]|$)"


def normalise(sentence: str) -> str:
    """Words of a sentence; a variable part becomes ``*``."""
    return re.sub(r" *\x00 *", " * ", re.sub(r"[^a-z0-9\x00]+", " ", re.sub("<[^>]*>", "\x00", sentence.lower()))).strip()


def compile_rules(rules: dict[str, list[list[str]]], gap: int):
    """(sentence -> identifier from 1, [(licence, identifiers, pattern over the identifier sequence)])."""
    known: dict[str, int] = {}
    compiled = []
    for licence, variants in rules.items():
        for sentences in variants:
            ids = [known.setdefault(normalise(s), len(known) + 1) for s in sentences]
            compiled.append((licence, ids, f"(?:0000 ){{0,{gap}}}".join(f"{i:04d} " for i in ids)))
    return known, compiled


def sentence_pattern(sentence: str) -> str:
    """A known sentence in a marked text: lines may break between words, sentences end where its own text has an end."""
    variable = f"[a-z0-9]+(?:[ LE][a-z0-9]+){{0,{VARIABLE_WORDS - 1}}}"
    cut = re.sub(SENTENCE_END, "\\1\n", sentence)
    parts = [normalise(p).replace(" ", "[ L]").replace("*", variable) for p in cut.split("\n")]
    return "[ LE]".join(p for p in parts if p)


def marked_text(text: Column) -> Column:
    """The text in words of a-z and 0-9 with the marks P (blank line), E (sentence end) and L (line break) between, P around."""
    t = F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(t, COMMENT_WORDS, "")
    t = F.regexp_replace(t, r"[\r\n][^a-z0-9]*[\r\n]", "P")
    t = F.regexp_replace(t, SENTENCE_END, "E")
    t = F.regexp_replace(t, r"[\r\n]+", "L")
    t = F.concat(F.lit("P"), F.regexp_replace(t, "[^a-z0-9PEL]+", " "), F.lit("P"))
    # of several marks in a row the strongest stays
    t = F.regexp_replace(t, "(?<![ EL])[ EL]*+P[ PEL]*+", "P")
    t = F.regexp_replace(t, "(?<![ L])[ L]*+E[ EL]*+", "E")
    return F.regexp_replace(t, " ?L[ L]*+", "L")


def sentence_ids(text: Column, known: dict[str, int], patterns: dict[str, str]) -> Column:
    """Identifiers of a text's sentences in order; 0 for an unknown sentence, empty ones left out."""
    # a long sentence before one that is a part of it
    every = "|".join(patterns[s] for s in sorted(known, key=lambda s: (-len(s.split()), s)))
    pieces = F.split(F.regexp_replace(marked_text(text), f"(?<=[PEL])(?:{every})(?=[PEL])", "K$0K"), "K")
    fixed = [s for s in known if "*" not in s]
    ids = F.create_map(*[F.lit(x) for s in fixed for x in (s, known[s])])

    def known_id(piece):
        found = F.try_element_at(ids, F.translate(piece, "LE", "  "))
        for s in known:
            if "*" in s:
                found = F.coalesce(found, F.when(piece.rlike(f"^{patterns[s]}$"), F.lit(known[s])))
        return F.array(found)

    def unknown(piece):
        return F.transform(F.filter(F.split(piece, "[PE]+"), lambda s: F.translate(s, "L ", "") != ""), lambda s: F.lit(0))

    # what stands at odd places was found
    return F.flatten(F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, known_id(piece)).otherwise(unknown(piece))))


def marking_words(sentences: list[str]) -> list[str]:
    """A few words so that every sentence holds one of them: again and again the one of over six letters that most of the others hold."""
    left, out = [set(s.split()) - {"*"} for s in sentences], []
    while left:
        words = sorted({w for s in left for w in s})
        best = max(words, key=lambda w: (sum(w in s for s in left) * (len(w) > 6), len(w), w))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def scan(docs: DataFrame, rules: dict[str, list[list[str]]] | None = None, gap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_sentences, sentence_ids, licences)`` per row of docs.

    n_sentences counts known licence sentences; sentence_ids lists their identifiers in
    order, comma-joined; licences lists the licences of which a rule holds, sorted and
    comma-joined, a rule being left out where a longer rule of another licence contains
    it. A null or empty text has none of them; repeated rows come back as often as they came; an empty
    table gives no rows; other columns are not read, so their names can't clash. All work is local to the row: no shuffle.
    """
    rules = RULES if rules is None else rules
    known, compiled = compile_rules(rules, gap)
    patterns = {normalise(s): sentence_pattern(s) for variants in rules.values() for v in variants for s in v}
    text = F.col(text_col)
    marks = marking_words(list(known))  # a text without any of these words needs no cutting
    may = F.lower(text).rlike("|".join(marks))
    ids = F.when(may, sentence_ids(text, known, patterns)).otherwise(F.array().cast("array<int>"))
    seq = docs.select(F.col(id_col), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    seq = seq.select(id_col, F.filter("ids", lambda i: i > 0).alias("hit"), F.concat(F.array_join(F.transform("ids", lambda i: F.lpad(i.cast("string"), 4, "0")), " "), F.lit(" ")).alias("line"))
    line = F.col("line")
    found = []
    for licence, ids_of, pattern in compiled:
        rest = line
        for other, longer, wider in compiled:
            if other != licence and len(longer) > len(ids_of) and longer[: len(ids_of)] == ids_of:
                rest = F.regexp_replace(rest, wider, "0000 ")
        found.append(F.when(rest.rlike(rf"(?:^| ){pattern}"), F.lit(licence)))
    some = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return seq.select(
        id_col,
        F.size("hit").cast("long").alias("n_sentences"),
        F.array_join("hit", ",").alias("sentence_ids"),
        F.when(F.size("hit") > 0, F.array_join(some, ",")).otherwise(F.lit("")).alias("licences"),
    )
