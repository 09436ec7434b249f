"""Licence scan by sentence rules.

A text's sentences (parts between line breaks, and after . ! or ? with white space) are normalised: A-Z lower-cased,
everything but ASCII letters, digits and non-ASCII characters to one space; n_sentences counts them. They are cut again
after ; : and ) with white space, and known licence sentences are looked for among these pieces and runs of neighbouring
pieces, the longest run first: a run may go on over single line breaks, whatever signs (or `dnl`, `rem`) begin the next
line, but not over a blank line or the end of a sentence (`v.` before a digit ends none). What equals a known sentence becomes its identifier.
Sentences with holes (`HOLED`: a holder's or a programme's name) are matched by their fixed parts around one to GAP words.
An unknown sentence right after the two conditions that all BSD licences share becomes `bsd-other`, unless it begins as
their disclaimer does or a known further condition follows: a condition that is not known never makes the licence a more
permissive one. The identifiers of a text, in order and without unknown sentences between them, are matched against the rules in their
order, longer rules first: a rule names a licence for one sequence of identifiers, and a sequence that it matches is
used up.

Known are sentences of licence texts and headers (`SENTENCES`, `HOLED`), notices (`NOTICES` with `NAMES`), the GNU header with its
subjects, licences and versions (-only and -or-later), the Creative Commons notice with its elements and versions, and
`SPDX-License-Identifier:` with an expression: each licence in it, between OR, AND and WITH and with + as -or-later, is
a notice of its own; exceptions and unknown identifiers are passed over. The SQL knows a sentence on one line only, and names
without a full stop in holes; on texts without wrapped sentences both give the same.

Defined results: doc_ids are whole numbers or null; null and empty texts have no sentences and no licences; repeated notices count each time; rows that
share a doc_id each give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table, tidy, utf8

#: Names by which notices call a licence, by SPDX identifier.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "Apache License, Version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPLv2", "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPLv3", "the GNU GPL v3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3"],
    "GPL-2.0-or-later": ["the GNU General Public License, version 2 or later", "the GNU GPL v2 or later"],
    "GPL-3.0-or-later": ["the GNU General Public License, version 3 or later", "the GNU GPL v3 or later"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "ISC": ["the ISC License"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "Unlicense": ["the Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
NOTICES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is released under {}.", "This project is licensed under {}.", "This file is licensed under {}."]
#: The GNU header, what it may speak of, and the versions of each licence.
GNU = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}."
GNU_SUBJECTS = ["This program", "This library", "This file", "This software", "This package", "It"]
GNU_FIXED = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the Free Software Foundation."
GNU_LIBRARY = "Library General Public License"
GNU_LICENCES = {"GPL": ("General Public License", ["2.0", "3.0"]), "LGPL": ("Lesser General Public License", ["2.1", "3.0"]), "AGPL": ("Affero General Public License", ["3.0"])}
GNU_VERSIONS = {"or-later": "either version {} of the License, or (at your option) any later version", "only": "version {} of the License"}
#: The Creative Commons notice, its elements and versions.
CC = "This work is licensed under {} Creative Commons {} {} License."
CC_ELEMENTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "4.0 International", "3.0": "3.0 Unported"}
#: SPDX identifiers besides those above.
SPDX_IDS = ["0BSD", "AFL-3.0", "Artistic-2.0", "BSD-4-Clause", "CDDL-1.0", "EPL-1.0", "EUPL-1.2", "LGPL-2.0", "MIT-0", "MPL-1.1", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL", "X11"]
#: Sentences of licence texts and headers, and what sequence of them names which licence.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache-use": "You may not use this file except in compliance with the License.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-defines": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "apache-licensor": '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    "apache-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-away": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl-2-share": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "lgpl-2.1-share": "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "lgpl-3-adds": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl-3-copyleft": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-1.1-subject": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "epl-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "mit-notice-next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "apache-or-mit": "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}
#: Sentences with holes, by the identifier that they become.
HOLED = [
    ("bsd-names", "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "Neither the names of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "Neither the name of {} nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names-author", "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-as-is", 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("apache-header", '{} licenses this file to you under the Apache License, Version 2.0 (the "License");'),
]
#: Words that a hole may have, and, for speed, the words of which any sentence with holes has one.
GAP, HOLED_SAY = 12, (b"endorse", b"disclaimed", b"licenses", b"redistribute")
RULES = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names-university"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names-author"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names-university"]),
    ("LicenseRef-BSD-other", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-other"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("Apache-2.0", ["apache-defines", "apache-licensor", "apache-grant"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice-next"]),
    ("Apache-2.0", ["apache-header", "apache-use"]),
    ("MPL-1.1", ["mpl-1.1-subject", "apache-use"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0", ["gpl-away", "gpl-2-share"]),
    ("LGPL-2.1", ["gpl-away", "lgpl-2.1-share"]),
    ("Unlicense", ["unlicense", "unlicense-anyone"]),
    ("MIT-0", ["mit-0-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Apache-2.0", ["apache-header"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0", ["gpl-3-copyleft"]),
    ("LGPL-3.0", ["lgpl-3-adds"]),
    ("AGPL-3.0", ["agpl-3-copyleft"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("MPL-1.1", ["mpl-1.1-subject"]),
    ("EPL-2.0", ["epl-made"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-grant"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("LicenseRef-BSD-style", ["bsd-style"]),
    ("Apache-2.0 OR MIT", ["apache-or-mit"]),
]
#: How the sentence begins that ends the conditions of a BSD licence, and identifiers of its further conditions.
DISCLAIMER, FURTHER = b"this software is provided", ("bsd-names", "bsd-advertising")
SPDX = b"spdx license identifier "
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_OTHER = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_CUT = re.compile(rb"(?<=[.!?])[ \t\x0b\x0c]+")
_PIECE = re.compile(rb"(?<=[;:)])[ \t\x0b\x0c]+")
_OPERATOR = re.compile(rb" (?:or|and|with) ")
_END = re.compile(rb"[.!?][ \t\x0b\x0c]*\Z")
#: Words that begin a comment line.
_PREFIXES = (b"dnl", b"rem")


def normalised(sentence: bytes) -> bytes:
    return _OTHER.sub(b" ", sentence.translate(_LOWER)).strip(b" ")


def spdx_ids() -> list[str]:
    """The SPDX identifiers that an expression may name."""
    gnu = [f"{short}-{version}{which}" for short, (_, versions) in GNU_LICENCES.items() for version in versions for which in ("", *(f"-{w}" for w in GNU_VERSIONS))]
    cc = [f"CC-{element}-{version}" for element in CC_ELEMENTS for version in CC_VERSIONS]
    return list(dict.fromkeys([*NAMES, *gnu, "LGPL-2.0-only", "LGPL-2.0-or-later", *cc, *SPDX_IDS]))


def operands(sentence: bytes) -> list[bytes]:
    """What an SPDX sentence names: as sentences of one identifier each, in order."""
    said = normalised(sentence.replace(b"+", b" or later ")).replace(b" or later", b" orlater")
    return [SPDX + x for x in _OPERATOR.split(said[len(SPDX) :])]


def known_sentences() -> dict[bytes, str]:
    """Identifiers of normalised sentences; a notice's identifier is `says-` and its licence."""
    out = {normalised(s.encode()): k for k, s in SENTENCES.items()}
    for licence, names in NAMES.items():
        for name, notice in itertools.product(names, NOTICES):
            out.setdefault(normalised(notice.format(name).encode()), f"says-{licence}")
    for short, (name, versions) in GNU_LICENCES.items():
        for version, subject, (which, words) in itertools.product(versions, GNU_SUBJECTS, GNU_VERSIONS.items()):
            said = GNU.format(subject, name, words.format(version.removesuffix(".0")))
            out.setdefault(normalised(said.encode()), f"says-{short}-{version}-{which}")
        for version, subject in itertools.product(versions, GNU_SUBJECTS):
            out.setdefault(normalised(GNU_FIXED.format(subject, name, version.removesuffix(".0")).encode()), f"says-{short}-{version}-only")
    for (element, name), (version, kind), article in itertools.product(CC_ELEMENTS.items(), CC_VERSIONS.items(), ("a", "the")):
        out.setdefault(normalised(CC.format(article, name, kind).encode()), f"says-CC-{element}-{version}")
    for licence in spdx_ids():
        out.setdefault(operands(f"SPDX-License-Identifier: {licence}".encode())[0], f"says-{licence}")
    return out


def holed() -> list[tuple[str, str]]:
    """Identifiers and the regular expressions of sentences with holes, for normalised text."""
    gnu = []
    for short, (name, versions) in [*GNU_LICENCES.items(), ("LGPL", (GNU_LIBRARY, ["2.0"]))]:
        for version in versions:
            said = version.removesuffix(".0")
            gnu += [(f"says-{short}-{version}-{which}", GNU.format("{}", name, words.format(said))) for which, words in GNU_VERSIONS.items()]
            gnu.append((f"says-{short}-{version}-only", GNU_FIXED.format("{}", name, said)))
    out = []
    for i, sentence in HOLED + gnu:
        parts = [normalised(p.encode()).decode() for p in sentence.split("{}")]
        out.append((i, "".join(p if k == 0 else f"{' ' * bool(parts[k - 1])}([^ ]+ ){{1,{GAP}}}{p}" for k, p in enumerate(parts))))
    return out


def holes() -> tuple[regex.Pattern, list[tuple[str, regex.Pattern]]]:
    """Any sentence with holes, and each."""
    each = [(i, regex.compile(p.encode())) for i, p in holed()]
    return regex.compile("|".join(f"(?:{p})" for _, p in holed()).encode()), each


def rules() -> list[tuple[str, str]]:
    """(licence, identifiers as they follow each other, each in angle brackets), longer rules first."""
    own = [(licence, "".join(f"<{i}>" for i in ids)) for licence, ids in sorted(RULES, key=lambda rule: -len(rule[1]))]
    return own + [(licence, f"<says-{licence}>") for licence in spdx_ids()]


def beginnings(known: dict[bytes, str]) -> set[bytes]:
    """The known sentences cut off after each of their words."""
    words = [k.split(b" ") for k in known]
    return {b" ".join(w[: n + 1]) for w in words for n in range(len(w))}


def pieces(text: bytes) -> tuple[int, list[bytes], list[bool], list[bool]]:
    """The number of sentences, the normalised pieces of them, and whether each goes on with the piece before, and is near it (no blank line between)."""
    n, out, joins, nears = 0, [], [], []
    near = ended = False  # whether the last piece is on this line or the one before, and ends a sentence
    for line in text.splitlines():
        blank, named = True, False
        for part in _CUT.split(line):
            sentence = normalised(part)
            if not sentence:
                continue
            n += 1
            if blank and sentence in _PREFIXES:
                continue
            named = sentence.startswith(SPDX)
            if named:  # an expression stands on one line and joins nothing
                found = operands(part)
                out += found
                joins += [False] * len(found)
                nears += [False] * len(found)
                blank, near = False, False
                continue
            cut = _PIECE.split(part)
            found = [sentence] if len(cut) == 1 else [x for x in map(normalised, cut) if x]
            if blank and found[0].split(b" ", 1)[0] in _PREFIXES:
                found[0] = found[0][4:]
            for piece in found:
                joins.append(near and (not ended or out[-1].rpartition(b" ")[2] == b"v" and piece[:1].isdigit()))
                nears.append(near)
                out.append(piece)
                near, ended = True, False
            blank, ended = False, True
        near, ended = not blank and not named, bool(_END.search(line))
    return n, out, joins, nears


def _with_holes(parts: list[bytes], nears: list[bool], at: int, any_hole: regex.Pattern, each: list[tuple[str, regex.Pattern]]) -> tuple[str | None, int]:
    """The identifier of the longest run from at that is a sentence with holes, and where the run ends; names may hold full stops."""
    run, end, last, after = parts[at], at + 1, None, at
    while (met := any_hole.fullmatch(run, partial=True)) is not None:
        if not met.partial:
            last, after = next(i for i, p in each if p.fullmatch(run)), end
        if end == len(parts) or not nears[end]:
            break
        run, end = run + b" " + parts[end], end + 1
    return last, after


def _trivial(piece: bytes) -> bool:
    """Whether a piece is no more than the number of a condition."""
    return len(piece) < 3


def scan(text: bytes, known: dict[bytes, str], begun: set[bytes], ordered: list[tuple[str, str]], holes: tuple | None = None) -> tuple[int, str, list[str]]:
    """The number of sentences, the sequence of identifiers and the licences found, one for each match."""
    n, parts, joins, nears = pieces(text)
    ids, at, low = [], 0, text.translate(_LOWER)
    holes = holes if any(s in low for s in HOLED_SAY) else None
    shared = other = False  # whether the last sentence is the second shared BSD condition, and an unknown one follows it
    while at < len(parts):
        run, last, after, end = parts[at], None, at, at + 1
        while run in begun:
            if run in known:
                last, after = known[run], end
            if end == len(parts) or not joins[end]:
                break
            run, end = run + b" " + parts[end], end + 1
        if holes:
            found_in, longer = _with_holes(parts, nears, at, *holes)
            if longer > after:
                last, after = found_in, longer
        if last is not None:
            if other and not last.startswith(FURTHER):
                ids.append("bsd-other")
            ids.append(last)
            at, shared, other = after, last == "bsd-binary", False
            continue
        if shared and not _trivial(parts[at]):  # the first sentence behind the shared conditions
            shared, other = False, not (parts[at].startswith(DISCLAIMER) or DISCLAIMER.startswith(parts[at]))
        at += 1
    if other:
        ids.append("bsd-other")
    sequence = left = "".join(f"<{i}>" for i in ids)
    found: list[str] = []
    if left:
        for licence, rule in ordered:
            found += [licence] * left.count(rule)
            left = left.replace(rule, "|")
    return n, sequence, sorted(found)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, ordered, own = known_sentences(), rules(), holes()
    begun = beginnings(known)
    for batch in steps(batches, "text"):
        n, sequence, found = zip(*[scan(t, known, begun, ordered, own) for t in utf8(batch, "text")], strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(sequence, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(sorted(set(x))) for x in found], pa.string())],
            names=["doc_id", "n_sentences", "sentence_ids", "n_notices", "licences"],
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, n_notices and licences (distinct, sorted, comma-joined) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidy(_scanned), "doc_id long, n_sentences long, sentence_ids string, n_notices long, licences string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"('{s.decode()}', '{i}')" for s, i in known_sentences().items())
    chained, alone = rules()[: len(RULES)], rules()[len(RULES) :]  # rules of one notice each do not touch one another
    steps_ = [f"r{k} AS (SELECT *, (length(s{k}) - length(replace(s{k}, '{rule}', ''))) // {len(rule)} AS c{k}, replace(s{k}, '{rule}', '|') AS s{k + 1} FROM {'seqs' if k == 0 else f'r{k - 1}'})" for k, (_, rule) in enumerate(chained)]
    left = f"s{len(chained)}"
    counts = [f"c{k}" for k in range(len(chained))] + [f"(length({left}) - length(replace({left}, '{rule}', ''))) // {len(rule)}" for _, rule in alone]
    names = [f"CASE WHEN c{k} > 0 THEN '{licence}' END" for k, (licence, _) in enumerate(chained)] + [f"CASE WHEN contains({left}, '{rule}') THEN '{licence}' END" for licence, rule in alone]

    def plain(p: str) -> str:
        return rf"trim(regexp_replace(translate({p}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ')"

    spdx, in_holes = SPDX.decode(), " ".join(f"WHEN regexp_full_match(sentence, '{p}') THEN '{i}'" for i, p in holed())
    return rf"""
WITH cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t\x0b\x0c]+', '\1' || chr(10), 'g'), '[\n\r]+') AS parts FROM documents
), said AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda p: CASE WHEN starts_with({plain("p")}, '{spdx}') THEN replace({plain("replace(p, '+', ' or later ')")}, ' or later', ' orlater') ELSE {plain("p")} END), lambda p: p <> '') AS sentences FROM cut
), known(sentence, id) AS (VALUES {values}),
parts AS (
  SELECT doc_id, place, CASE WHEN starts_with(sentence, '{spdx}') THEN list_transform(string_split_regex(substr(sentence, {len(spdx) + 1}), ' (or|and|with) '), lambda x: '{spdx}' || x) ELSE [sentence] END AS named
  FROM (SELECT doc_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS place FROM said)
),
one AS (SELECT doc_id, place, unnest(named) AS sentence, unnest(range(len(named))) AS spot FROM parts),
met AS (SELECT doc_id, place, spot, sentence, coalesce(id, CASE {in_holes} END) AS id FROM one LEFT JOIN known USING (sentence)),
near AS (SELECT *, lead(id) OVER w AS next, lead(id IGNORE NULLS) OVER w AS later, lead(sentence) OVER w AS said FROM met WHERE id IS NOT NULL OR strlen(sentence) >= 3 WINDOW w AS (PARTITION BY doc_id ORDER BY place, spot)),
listed AS (
  SELECT doc_id, string_agg('<' || id || '>' || CASE WHEN id = 'bsd-binary' AND next IS NULL AND NOT starts_with(said, '{DISCLAIMER.decode()}') AND NOT regexp_matches(coalesce(later, ''), '^({"|".join(FURTHER)})') THEN '<bsd-other>' ELSE '' END, '' ORDER BY place, spot) AS seq
  FROM near WHERE id IS NOT NULL GROUP BY doc_id
),
seqs AS (SELECT doc_id, len(sentences)::BIGINT AS n_sentences, coalesce(seq, '') AS sentence_ids, coalesce(seq, '') AS s0 FROM said LEFT JOIN listed USING (doc_id)),
{", ".join(steps_)}
SELECT doc_id, n_sentences, sentence_ids, ({" + ".join(counts)})::BIGINT AS n_notices,
  array_to_string(list_sort(list_distinct(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL))), ',') AS licences FROM r{len(steps_) - 1}
"""


OP10_SQL = _sql()
