"""Licence scans by sentence rules, in DataFrame functions.

A text is cut into sentences, each normalised to lower-case letters and digits;
normalised sentences are looked up among known licence sentences, and the
sequence of their identifiers is matched with ordered rules.  A rule takes the
identifiers it matches, so that later, shorter rules don't see them again.  Texts
are cut twice, with line ends as sentence ends and with lines joined inside
paragraphs, because notices come both as single lines and wrapped.

Cases: null and empty texts have no sentences; texts without any of the words
that every known sentence holds are not cut at all.  A licence found several
times in a text counts once, in the order of the rules.  Identifiers that no rule takes are
counted, as are sentences with licence words that are not known.  Rows are judged
alone: repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of which every known sentence has one.
TRIGGER = r"licen[sc]|copyright|permission|warrant|redistribut|public domain|liable|copyleft"

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache2-short": "Licensed under the Apache License, Version 2.0",
    "apache2-notice": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-name": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "lgpl-short": "Licensed under the GNU Lesser General Public License, version 3",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
#: Rules in order, longest sequences of a licence first.
RULES = (
    ("Apache-2.0", ("apache2-notice", "apache2-comply", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-notice", "apache2-comply")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("LGPL-3.0-only", ("lgpl-short",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("Unlicense", ("unlicense-domain",)),
)

#: Sentence ends; a sentence that holds one of them inside is known by its parts.
END = r"[.!?]+(?:\s+|$)"
BY_LINE, BY_PARAGRAPH = rf"{END}|\n+", rf"{END}|\n\s*\n"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def parts_of(sentence: str) -> list[str]:
    """What a cut leaves of a sentence that has ends inside, without parts that have no licence word."""
    return [p for p in map(normalised, re.split(END, sentence)) if re.search(TRIGGER, p)]


def known() -> dict[str, str]:
    """Identifier by normalised sentence.  A sentence with ends inside has its parts under it, numbered, in order."""
    out: dict[str, str] = {}
    for name, sentence in SENTENCES.items():
        parts = parts_of(sentence)
        for n, part in enumerate(parts):
            out.setdefault(part, name if len(parts) == 1 else f"{name}.{n}")
    return out


def sequence(names: tuple[str, ...]) -> str:
    """Text form of a rule: the identifiers of its sentences, parts in order."""
    table, out = known(), []
    for name in names:
        out += [table[p] for p in parts_of(SENTENCES[name])]
    return "".join(f"<{x}>" for x in out)


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _matched(state: Column) -> tuple[list[Column], Column]:
    """For each rule whether it matches, and what no rule has taken."""
    found = []
    for _, names in RULES:
        found.append(F.contains(state, F.lit(sequence(names))))
        state = F.replace(state, F.lit(sequence(names)), F.lit("|"))
    return found, state


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, sentence_ids, n_unmatched, n_unknown`` of every whole text.

    ``sentence_ids`` are the identifiers found line by line, in order;
    ``n_unmatched`` of them are in no rule.  ``n_unknown`` sentences have a licence
    word and are not known.
    """
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    likely = F.lower(text).rlike(TRIGGER)

    def sentences(end: str) -> Column:
        none = F.expr("cast(array() as array<string>)")
        return F.when(likely, F.transform(F.split(text, end), _normal)).otherwise(none)

    cut = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        sentences(BY_LINE).alias("_lines"),
        sentences(BY_PARAGRAPH).alias("_paragraphs"),
    )
    ids = lambda c: F.filter(F.transform(c, lambda s: table[s]), F.isnotnull)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    named = cut.select(
        "doc_id",
        ids(F.col("_lines")).alias("sentence_ids"),
        joined(ids(F.col("_paragraphs"))).alias("_wrapped"),
        F.size(F.filter("_lines", lambda s: s.rlike(TRIGGER) & table[s].isNull())).cast("bigint").alias("n_unknown"),
    ).withColumn("_single", joined(F.col("sentence_ids")))
    (single, rest), (wrapped, _) = _matched(F.col("_single")), _matched(F.col("_wrapped"))
    found = [F.when(a | b, F.lit(name)) for (name, _), a, b in zip(RULES, single, wrapped, strict=True)]
    return named.select(
        "doc_id",
        F.array_distinct(F.array_compact(F.array(*found))).alias("licenses"),
        "sentence_ids",
        (F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit("")))).cast("bigint").alias("n_unmatched"),
        "n_unknown",
    )
