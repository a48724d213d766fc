"""Licence scan by sentence rules.

Texts are cut into pieces at line ends and sentence stops; the longest run of pieces whose normal form (lower case, words only) is a known licence
sentence becomes its identifier, so wrapped lines do not matter.  Identifier sequences are then matched against ordered rules: a rule is a list of identifiers that must follow each other, with
at most `gap` unknown sentences between two of them.  Rules are tried at each place from the longest to the shortest, and a match consumes its sentences.
A tag "SPDX-License-Identifier:" is followed by an expression of identifiers with AND, OR, WITH and parentheses; each licence of it gives a row, with its
exception behind WITH.

The known sentences are notes ("licensed under ..."), source headers and characteristic sentences of the texts of the licences in NAMES.  A licence text in full is
found by those, not compared word for word.

Rows: a null or empty text has no sentence and gives no row.  Repeated licences in one text give a row each; equal rows give equal
results.  The cost is linear in the text.  Rows are (doc_id, licence, rule, start, end) with code points, end exclusive.  Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.shared import keyed_text

# Openings of licence notes, names of licences, and sentences of licence texts.
OPENINGS = (
    "licensed under", "released under", "distributed under", "available under", "published under", "this work is licensed under", "this software is licensed under", "this project is licensed under",
    "this file is licensed under", "this program is licensed under", "this document is licensed under", "this package is licensed under", "this content is licensed under", "this library is licensed under",
    "this code is licensed under", "this material is licensed under", "license",
)
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0", "apache license v2.0", "apache license v2", "apache license version 2"),
    "MIT": ("mit license", "mit", "expat license"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v2.0", "mozilla public license v 2.0", "mpl 2.0", "mpl v2.0", "mpl version 2.0"),
    "BSD-2-Clause": ("bsd 2 clause license", "bsd 2 clause", "simplified bsd license", "2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "bsd 3 clause", "new bsd license", "modified bsd license", "3 clause bsd license"),
    "ISC": ("isc license", "isc"),
    "CC0-1.0": ("cc0", "cc0 1.0", "cc0 1.0 universal", "creative commons zero v1.0 universal"),
    "EPL-1.0": ("eclipse public license version 1.0", "eclipse public license v1.0", "eclipse public license 1.0", "epl 1.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license v 2.0", "eclipse public license 2.0", "epl 2.0"),
    "Unlicense": ("unlicense",),
}
# Families of licences with their versions.
GNU = {"GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2.1", "3")), "AGPL": ("gnu affero general public license", ("3",))}
CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def gnu_id(family: str, version: str) -> str:
    return f"{family}-{version}" if "." in version else f"{family}-{version}.0"


def family_names() -> dict[str, list[str]]:
    """The names of the licences of GNU and CC, by rule."""
    out: dict[str, list[str]] = {}
    for family, (title, versions) in GNU.items():
        for version in versions:
            short = family.lower()
            numbers = (version, f"v{version}", f"version {version}", f"v {version}", *(() if "." in version else (f"{version}.0", f"v{version}.0", f"version {version}.0")))
            out[gnu_id(family, version)] = [f"{name} {n}{later}" for name in (title, short, f"gnu {short}") for n in numbers for later in ("", " only", " or later", " or any later version")] + [f"{short}v{version}"]
    for kind, title in CC.items():
        for version in CC_VERSIONS:
            words = kind.lower().replace("-", " ")
            out[f"CC-{kind}-{version}"] = [f"cc {words} {version}", f"a creative commons {title} {version} international license", f"a creative commons {title} {version} unported license"] + [f"creative commons {title} {version}{rest}" for rest in ("", " license", " international", " international license", " unported license", " generic license", " international public license")]
    return out


SENTENCES = {
    "reserved": "All rights reserved.",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache.comply": "you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl.header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl.contributor": "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "epl1.header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "epl1.accept": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").",
    "epl2.header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl2.header.v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at",
    "apache.define": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "gpl3.preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl2.preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl2.intended": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "lgpl21.preamble": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "lgpl3.preamble": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl3.preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "cc0.deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "cc0.purpose": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
    "public.domain": "This is free and unencumbered software released into the public domain.",
}
RULES = (
    ("MIT", "mit-text", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", "mit-grant", ("mit.grant", "mit.notice")),
    ("MIT", "mit-grant-only", ("mit.grant",)),
    ("Apache-2.0", "apache-header", ("note:Apache-2.0", "apache.comply", "apache.copy", "apache.asis")),
    ("Apache-2.0", "apache-comply", ("note:Apache-2.0", "apache.comply")),
    ("Apache-2.0", "apache-terms", ("apache.comply", "apache.copy", "apache.asis")),
    ("Apache-2.0", "apache-comply-only", ("apache.comply",)),
    ("Apache-2.0", "apache-asis", ("apache.asis",)),
    ("Apache-2.0", "apache-text", ("apache.define",)),
    ("MPL-2.0", "mpl-header", ("mpl.header",)),
    ("MPL-2.0", "mpl-text", ("mpl.contributor",)),
    ("EPL-1.0", "epl-header", ("epl1.header",)),
    ("EPL-1.0", "epl-text", ("epl1.accept",)),
    ("EPL-2.0", "epl-header", ("epl2.header",)),
    ("EPL-2.0", "epl-header-v", ("epl2.header.v",)),
    ("GPL-3.0", "gpl-text", ("gpl3.preamble",)),
    ("GPL-2.0", "gpl-text", ("gpl2.preamble", "gpl2.intended")),
    ("GPL-2.0", "gpl-preamble", ("gpl2.preamble",)),
    ("LGPL-2.1", "lgpl-text", ("gpl2.preamble", "gpl2.intended", "lgpl21.preamble")),
    ("LGPL-2.1", "lgpl-preamble", ("lgpl21.preamble",)),
    ("LGPL-3.0", "lgpl-text", ("lgpl3.preamble",)),
    ("AGPL-3.0", "agpl-text", ("agpl3.preamble",)),
    ("CC0-1.0", "cc0-deed", ("cc0.deed",)),
    ("CC0-1.0", "cc0-text", ("cc0.purpose",)),
    ("BSD-3-Clause", "bsd3-text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", "bsd2-text", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("ISC", "isc-grant", ("isc.grant",)),
    ("Unlicense", "public-domain", ("public.domain",)),
    ("Proprietary", "reserved", ("reserved",)),
)

#: A text without any of these, in lower case, has no known sentence: each known sentence has one (a test holds that).  Each is part of
#: one word, so line ends and spacing can't hide it.
HINTS = ("licens", "reserved", "permission", "warrant", "redistribut", "domain", "released", "distributed", "available", "published", "contributor", "copyright", "freedom")
_CUT = re.compile(r"[^\n.!?;:]+(?:[.!?;:](?!\s|$)[^\n.!?;:]*)*[.!?;:]*")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


_TAG = re.compile(r"SPDX-License-Identifier:[\x20\t]*([^\n]*)", re.IGNORECASE)
_ADDRESS = re.compile(r"https?://\S+")
_OPERATORS = ("AND", "OR", "WITH")
_TERM = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*|[()]")


def normal(sentence: str) -> str:
    """Lower-case words, without web addresses."""
    return " ".join(_WORD.findall(_ADDRESS.sub(" ", sentence.lower())))


@dataclass(frozen=True)
class Book:
    """Identifiers of the known sentences, all their beginnings, the rules by their first identifier, longest first, and licences by lower case."""

    known: dict[str, str]
    heads: frozenset[str]
    rules: dict[str, list[tuple[str, str, tuple[str, ...]]]]
    spelled: dict[str, str]


def gnu_sentences() -> dict[str, str]:
    """The notices of the GNU licences by rule; key: free:<identifier>."""
    out = {}
    for family, (title, versions) in GNU.items():
        for version in versions:
            for thing in ("program", "library", "software", "file"):
                for tail in ("version {} of the License, or (at your option) any later version.", "version {} of the License.", "version {} only."):
                    for comma in ("either ", ""):
                        out[f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, {comma}{tail.format(version)}"] = f"free:{gnu_id(family, version)}"
    return out


def book() -> Book:
    known = {normal(s): k for k, s in SENTENCES.items()}
    known.update({normal(s): k for s, k in gnu_sentences().items()})
    names = {**NAMES, **family_names()}
    for licence, forms in names.items():
        for name in forms:
            for opening in OPENINGS:
                for article in ("", "the "):
                    for short in ("", ' (the "License")'):
                        known[normal(f"{opening} {article}{name}{short}")] = f"note:{licence}"
    notices = [(gnu_id(family, v), f"{family.lower()}-{part}", (f"free:{gnu_id(family, v)}", *hope)) for family, (_, versions) in GNU.items() for v in versions for part, hope in (("header", ("gpl.hope",)), ("header-library", ("lgpl.hope",)), ("free", ()))]
    rules: dict[str, list] = {}
    for rule in (*RULES, *notices, *((licence, "note", (f"note:{licence}",)) for licence in names)):
        rules.setdefault(rule[2][0], []).append(rule)
    heads = frozenset(s[:k] for s in known for k in [*(m.start() for m in re.finditer(" ", s)), len(s)])
    spelled = {k.lower(): k for k in names}
    return Book(known, heads, {k: sorted(v, key=lambda r: -len(r[2])) for k, v in rules.items()}, spelled)


def tagged(text: str, b: Book) -> list[tuple[str, str, int, int]]:
    """(licence, rule, start, end) of each licence in the expressions of SPDX tags; an expression ends at the first word that can't go on with it."""
    out = []
    for m in _TAG.finditer(text):
        want, last = "id", None  # what may come next
        for term in _TERM.finditer(text, m.start(1), m.end(1)):
            word = term[0]
            between = text[last[1] if last else m.start(1) : term.start()]
            if between.strip():
                break
            if word == "(" and want == "id" or word == ")" and want == "operator":
                pass
            elif want == "operator" and word in _OPERATORS:
                want = "exception" if word == "WITH" else "id"
            elif word in "()" or word in _OPERATORS:
                break
            elif want == "exception":
                licence, rule, start, _ = out.pop()
                out.append((f"{licence} WITH {word}", rule, start, term.end()))
                want = "operator"
            elif want == "id":
                out.append((b.spelled.get(word.lower(), word), "spdx", term.start(), term.end()))
                want = "operator"
            else:
                break
            last = term.span()
    return out


def matches(text: str, b: Book, gap: int = 1) -> list[tuple[str, str, int, int]]:
    """(licence, rule, start, end) in the order of the text."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    pieces = [(n, m) for m in _CUT.finditer(text) if (n := normal(m[0]))]  # a bare comment mark is no sentence
    found, k = [], 0  # (first piece, last piece, identifier, start, end)
    while k < len(pieces):
        so_far, best, j = "", None, k
        while j < len(pieces):
            so_far = f"{so_far} {pieces[j][0]}".strip()
            if so_far not in b.heads:
                break
            best = (j, b.known[so_far]) if so_far in b.known else best
            j += 1
        if best is not None:
            first, last = pieces[k][1], pieces[best[0]][1]
            found.append((k, *best, first.start() + len(first[0]) - len(first[0].lstrip()), last.start() + len(last[0].rstrip())))
            k = best[0]
        k += 1
    out, at = [], 0
    while at < len(found):
        for licence, rule, names in b.rules.get(found[at][2], ()):
            run = found[at : at + len(names)]
            if len(run) == len(names) and all(x[2] == n for x, n in zip(run, names, strict=True)) and all(y[0] - x[1] <= gap + 1 for x, y in zip(run, run[1:], strict=False)):
                out.append((licence, rule, run[0][3], run[-1][4]))
                at += len(names)
                break
        else:
            at += 1
    return sorted(out + tagged(text, b), key=lambda m: m[2:]) if "spdx-license" in low else out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 1) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(book())  # of fixed size

    def run(batches):
        b = shared.value
        for batch in batches:
            rows = [(i, *m) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in matches(text, b, gap)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "licence", "rule", "start", "end"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, licence string, rule string, start long, end long")
