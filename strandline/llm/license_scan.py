"""License scans by conditional compression.

Blocks of words around licensing words are compressed plain and with each template as a raw Zstandard dictionary. What a
dictionary saves, squared and divided by the template's size, ranks the templates: one that is in the block as a whole goes
before one that shares a phrase with it. The RANKED best, and no others, are held against the block word by word. A template
is confirmed when the words that tell it from its kin are there, in their places, no word that belongs to another license has
come in between, and at least MIN_MATCH of its words are matched; a template that is a name only must fill its line. Among the
confirmed the one with the most matched and fewest differing words wins (of equals the better ranked, then the earlier in the
list), its own part of the block and its exact wording differences are reported, and what is left of the block before and
after that part is ranked and searched again. Where a notice names several licenses at once, each name is reported.

Templates are made by rule from identifiers and names (FORMS), and are whole texts or the opening passages of licenses.
Words are compared in one spelling: lower case, licence as license, "version" and "v" left out, 2.0 as 2, a + after a number
as "later". A block reaches as far from its licensing word as the longest template of its kind is long, and half as far again
for whole texts, twice as far for notices; so no notice is longer than its block's room for it, over any number of line ends.

Positions count code points in the whole text, the end is exclusive. A null or empty text has no block. What lies in several
blocks is reported once. Rows that repeat give rows that repeat; doc_id may be null; extra columns are ignored. Blocks
overlap only by their reach, so the cost grows with the text. A notice that is denied ("not licensed under ...") is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Identifier of a license, its names, and the words of each that must be matched.
LICENSED = (
    ("MIT", ("MIT License", "mit license")),
    ("Apache-2.0", ("Apache License, Version 2.0", "apache 2"), ("Apache 2.0 license", "apache 2"), ("Apache Software License 2.0", "apache 2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "gnu general 3"), ("GNU GPL version 3", "gpl 3"), ("GPL version 3 license", "gpl 3")),
    ("GPL-3.0-or-later", ("GNU General Public License, version 3 or any later version", "gnu general 3 later"), ("GPL version 3 or later", "gpl 3 later")),
    ("GPL-2.0", ("GNU General Public License, version 2", "gnu general 2"), ("GNU GPL version 2", "gpl 2"), ("GPL version 2 license", "gpl 2")),
    ("GPL-2.0-or-later", ("GNU General Public License, version 2 or any later version", "gnu general 2 later"), ("GPL version 2 or later", "gpl 2 later")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "gnu lesser 3"), ("GNU LGPL version 3", "lgpl 3"), ("LGPL version 3 license", "lgpl 3")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "gnu lesser 2.1"), ("GNU LGPL version 2.1", "lgpl 2.1"), ("LGPL version 2.1 license", "lgpl 2.1")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "gnu affero 3"), ("GNU AGPL version 3", "agpl 3"), ("AGPL version 3 license", "agpl 3")),
    ("LGPL-3.0-or-later", ("GNU Lesser General Public License, version 3 or any later version", "gnu lesser 3 later"), ("LGPL version 3 or later", "lgpl 3 later")),
    ("LGPL-2.1-or-later", ("GNU Lesser General Public License, version 2.1 or any later version", "gnu lesser 2.1 later"), ("LGPL version 2.1 or later", "lgpl 2.1 later")),
    ("AGPL-3.0-or-later", ("GNU Affero General Public License, version 3 or any later version", "gnu affero 3 later"), ("AGPL version 3 or later", "agpl 3 later")),
    ("EUPL-1.2", ("European Union Public License, version 1.2", "european union 1.2"), ("EUPL 1.2", "eupl 1.2")),
    ("BSD-1-Clause", ("BSD 1-Clause License", "bsd 1"), ("1-Clause BSD License", "bsd 1")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "bsd 3"), ("3-Clause BSD License", "bsd 3"), ("New BSD License", "new bsd")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "bsd 2"), ("2-Clause BSD License", "bsd 2"), ("Simplified BSD License", "simplified bsd")),
    ("ISC", ("ISC License", "isc license")),
    ("MPL-2.0", ("Mozilla Public License, v. 2.0", "mozilla 2"), ("MPL 2.0 license", "mpl 2")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "eclipse 2"), ("EPL 2.0 license", "epl 2")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "boost 1")),
    ("Artistic-2.0", ("Artistic License 2.0", "artistic 2")),
    ("Zlib", ("zlib License", "zlib license")),
    ("WTFPL", ("Do What The Fuck You Want To Public License", "fuck want public")),
    ("Unlicense", ("Unlicense", "unlicense")),
    ("CC-BY-4.0", ("CC BY 4.0", "cc by 4"), ("Creative Commons Attribution 4.0 International License", "creative attribution 4")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "cc by sa 4"), ("Creative Commons Attribution-ShareAlike 4.0 International License", "creative attribution sharealike 4")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "cc by nc 4"), ("Creative Commons Attribution-NonCommercial 4.0 International License", "creative attribution noncommercial 4")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "cc by nd 4"), ("Creative Commons Attribution-NoDerivatives 4.0 International License", "creative attribution noderivatives 4")),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0", "cc by nc sa 4"), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative attribution noncommercial sharealike 4")),
    ("CC-BY-3.0", ("CC BY 3.0", "cc by 3"), ("Creative Commons Attribution 3.0 Unported License", "creative attribution 3")),
    ("CC-BY-SA-3.0", ("CC BY-SA 3.0", "cc by sa 3"), ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "creative attribution sharealike 3")),
    ("CC0-1.0", ("CC0 1.0 Universal", "cc 0 1"), ("CC0", "cc 0")),
)
#: The usual wording around a name. The last is the name alone, on a line of its own.
FORMS = ("Licensed under the {}.", "This work is licensed under the terms of the {}.", "Released under the {}.", "Distributed under {}.", "This project is under {}.", "{}")
#: License, words that must be matched, whole text or opening passage.
TEXTS = (
    ("MIT", "permission granted free charge sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "permission granted free charge sublicense warranty merchantability", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "apache 2 warranties", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "apache 2 terms conditions definitions", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-3.0", "gnu general 3 preamble", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "gnu general 2 preamble", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("GPL-3.0-or-later", "gnu general 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "gnu general 2 later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0-or-later", "gnu lesser 3 later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "gnu lesser 2.1 later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "gnu affero 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "redistribution source binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "redistribution source binary redistributions disclaimer", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("BSD-3-Clause", "redistribution source binary redistributions disclaimer neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "permission use copy modify fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "as-is express implied misrepresented", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("BSL-1.0", "permission granted free charge display execute", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "eclipse 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Artistic-2.0", "artistic 2", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License version 2.0."),
    ("CC0-1.0", "cc 0 1 dedicated", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "free unencumbered public domain", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "free unencumbered public domain anyone", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Words that tell one license from another; none may stand in a block's aligned part that the template lacks.
TELLING = frozenset("mit apache gnu gpl lgpl agpl eupl european lesser library affero general bsd isc mozilla mpl eclipse epl boost artistic zlib unlicense cc creative by sa nc nd attribution sharealike noncommercial noderivatives not no".split())
ANCHOR = r"(?i)licen[sc]|spdx|public\W+domain|permission\W+(?:is|to)\b|redistribution\W+and\W+use|creative\W+commons|\bcc[ -]?(?:by|0)|free\W+software|unencumbered|source\W+code\W+form|\b[al]?gpl|express\W+or\W+implied|\beupl"
#: Words without one of which no template is confirmed, in one spelling.
_MARKS = frozenset("license licensed unlicense spdx domain permission redistribution commons cc free unencumbered gpl lgpl agpl eupl source express".split())
MIN_MATCH = 0.6
RANKED = 12

_anchor = re.compile(ANCHOR)
_token = re.compile(r"[a-z]+(?:-is\b)?|[0-9]+(?:\.[0-9]+)*\+?")
_spelling = {"licence": "license", "licenced": "licensed", "licences": "license", "licenses": "license", "gplv": "gpl", "lgplv": "lgpl", "agplv": "agpl", "mplv": "mpl", "v": "", "version": "", "ver": ""}

_V = r"(?:,?[ -](?:v(?:ersion)?\.?[ ]?)?|[ -]?v)"
_L = r"Public\s+License"
_LATER = r"(?:-or-later\b|\+|,?\s+or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?\b)"
#: Names by which a notice lists licenses, the longer before the shorter.
NAMED = (
    ("LGPL-3.0-or-later", rf"(?:(?:GNU\s+)?LGPL|GNU\s+Lesser\s+General\s+{_L}){_V}3(?:\.0)?{_LATER}"),
    ("LGPL-2.1-or-later", rf"(?:(?:GNU\s+)?LGPL|GNU\s+Lesser\s+General\s+{_L}){_V}2\.1{_LATER}"),
    ("AGPL-3.0-or-later", rf"(?:(?:GNU\s+)?AGPL|GNU\s+Affero\s+General\s+{_L}){_V}3(?:\.0)?{_LATER}"),
    ("LGPL-3.0", rf"(?:(?:GNU\s+)?LGPL|GNU\s+Lesser\s+General\s+{_L}){_V}3(?:\.0)?(?:-only)?"),
    ("LGPL-2.1", rf"(?:(?:GNU\s+)?LGPL|GNU\s+Lesser\s+General\s+{_L}){_V}2\.1(?:-only)?"),
    ("AGPL-3.0", rf"(?:(?:GNU\s+)?AGPL|GNU\s+Affero\s+General\s+{_L}){_V}3(?:\.0)?(?:-only)?"),
    ("GPL-3.0-or-later", rf"(?:(?:GNU\s+)?GPL|GNU\s+General\s+{_L}){_V}3(?:\.0)?{_LATER}"),
    ("GPL-2.0-or-later", rf"(?:(?:GNU\s+)?GPL|GNU\s+General\s+{_L}){_V}2(?:\.0)?{_LATER}"),
    ("GPL-3.0", rf"(?:(?:GNU\s+)?GPL|GNU\s+General\s+{_L}){_V}3(?:\.0)?(?:-only)?"),
    ("GPL-2.0", rf"(?:(?:GNU\s+)?GPL|GNU\s+General\s+{_L}){_V}2(?:\.0)?(?:-only)?"),
    ("MIT", r"MIT"),
    ("Apache-2.0", rf"Apache(?:\s+Software)?(?:\s+License)?{_V}2(?:\.0)?"),
    ("BSD-3-Clause", r"BSD[ -]3[ -]Clause|3[ -]Clause BSD"),
    ("BSD-2-Clause", r"BSD[ -]2[ -]Clause|2[ -]Clause BSD"),
    ("ISC", r"ISC"),
    ("MPL-2.0", rf"(?:MPL|Mozilla\s+{_L}){_V}2\.0"),
    ("EPL-2.0", rf"(?:EPL|Eclipse\s+{_L}){_V}2\.0"),
    *((f"CC-{k}-4.0", rf"CC[ -]{k.replace('-', '[ -]')}[ -]4\.0") for k in ("BY-NC-SA", "BY-NC", "BY-ND", "BY-SA", "BY")),
    *((f"CC-{k}-3.0", rf"CC[ -]{k.replace('-', '[ -]')}[ -]3\.0") for k in ("BY-SA", "BY")),
    ("EUPL-1.2", rf"EUPL{_V}1\.2"),
    ("BSD-1-Clause", r"BSD[ -]1[ -]Clause|1[ -]Clause BSD"),
    ("CC0-1.0", r"CC0[ -]1\.0"),
    ("Unlicense", r"Unlicense"),
)
_name = re.compile("(?i)(?:" + "|".join(f"({x})" for _, x in NAMED) + r")(?![\w-]|\.\d)(?:\s+licen[cs]es?\b)?")
_under = re.compile(r"(?i)\b(?:under|SPDX-License-Identifier:)(?:\s+(?:either|both|any|one|of|the|terms|following|licenses))*[:\s(]*")
_more = re.compile(r"(?i)(?:\s*[,;/|]\s*(?:(?:and/or|and|or)\s+)?|\s+(?:and/or|and|or)\s+)(?:under\s+)?(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?")




#: A notice that these words lead to says what the license is not.
_denied = re.compile(r"(?:\b(?:not|never|nor|cannot|no\s+longer)|n['’]t)\s+(?:\w+\s+){0,2}(?:the\s+)?$", re.I)


def wording(text: str, at: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """The words of a part of a lower-case text in one spelling, with their bounds."""
    for m in _token.finditer(text, at, len(text) if end is None else end):
        w = m.group()
        later = w[-1] == "+"
        w = w.rstrip("+")
        while w.endswith(".0"):
            w = w[:-2]
        w = _spelling.get(w, w)
        if w:
            yield w, m.start(), m.end() - later
        if later:
            yield "later", m.end() - 1, m.end()


class _Template:
    def __init__(self, name: str, needs: str, text: str, alone: bool = False) -> None:
        self.name, self.needs, self.alone = name, set(needs.split()), alone
        self.words = [w for w, _, _ in wording(text.lower())]
        held = " ".join(self.words).encode()
        self.size = len(held)
        dictionary = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False)


def notices() -> list[tuple[str, str, str, bool]]:
    """License, needed words, wording and whether it must fill its line, of the templates made by rule."""
    out = []
    for name, *told in LICENSED:
        words = " ".join(w for w, _, _ in wording(name.lower()))
        out.append((name, f"spdx {words}", f"SPDX-License-Identifier: {name}", False))
        out += [(name, needs, form.format(x), form == FORMS[-1]) for x, needs in told for form in FORMS]
    return out


@lru_cache(1)
def templates() -> tuple[list[_Template], list[_Template]]:
    """Those of notices, and whole texts."""
    return [_Template(*t) for t in notices()], [_Template(*t) for t in TEXTS]


def reach(long: bool) -> int:
    most = max(len(t.words) for t in templates()[long])
    return most + most // 2 if long else 2 * most


def blocks(text: str, n: int) -> Iterator[list[tuple[str, int, int]]]:
    """The words around each licensing word of a lower-case text, n before it and n to 2 n after it; a licensing word that
    has n words after it in the block before, or all of the text, has no block of its own."""
    upto = -1
    for m in _anchor.finditer(text):
        if m.start() <= upto:
            continue
        start = m.start()
        while start and text[start - 1].isalpha():  # a licensing word may end a longer one
            start -= 1
        after = list(islice(wording(text, start), 2 * n))
        upto = after[n][1] if len(after) == 2 * n else len(text)
        far = 8 * n
        while True:
            low = max(0, start - far)
            before = list(wording(text, low, start))
            if not low or len(before) > n:
                break
            far *= 4
        yield [*before[-n:], *after]


_plain = zstandard.ZstdCompressor(level=3, write_content_size=False)


def ranked(words: list[str], among: list[_Template]) -> list[tuple[float, _Template]]:
    """The templates whose dictionaries save most for their size, and the share of bytes that each saves, best first."""
    data = " ".join(words).encode()
    plain = len(_plain.compress(data))
    saved = ((plain - len(t.zip.compress(data)), t) for t in among)
    best = sorted(((x * x / t.size, x / plain, t) for x, t in saved if x > 0), key=lambda x: -x[0])
    return [(share, t) for _, share, t in best[:RANKED]]


def compare(t: _Template, match: SequenceMatcher, words: list[str]) -> tuple[int, int, list[str], int, int] | None:
    """Matched words, differing words, the differences and the bounds of the part of the block that lines up best with the
    template; None if no part is this license."""
    match.set_seq1(t.words)
    ops = match.get_opcodes()
    equal = [k for k, op in enumerate(ops) if op[0] == "equal"]
    best = None
    for x, first in enumerate(equal):
        # what the block has before and after a part is none of its wording
        matched: set[str] = set()
        a, c = ops[first][1], ops[first][3]
        same, other, told = 0, a, [f"-{' '.join(t.words[:a])} +"] if a else []
        gap = first
        for last in equal[x:]:
            between = ops[gap + 1 : last] if last > first else []
            if any(w in TELLING or w[0].isdigit() for op in between for w in words[op[3] : op[4]]):
                break
            other += sum(max(op[2] - op[1], op[4] - op[3]) for op in between)
            told = told + [f"-{' '.join(t.words[op[1]:op[2]])} +{' '.join(words[op[3]:op[4]])}" for op in between]
            b, d = ops[last][2], ops[last][4]
            matched.update(t.words[ops[last][1] : b])
            same += b - ops[last][1]
            gap = last
            left = len(t.words) - b
            if t.needs <= matched and same >= MIN_MATCH * len(t.words) and other + left <= max(3, 0.4 * len(t.words)) and (best is None or same - 2 * (other + left) > best[0] - 2 * best[1]):
                best = (same, other + left, [*told, f"-{' '.join(t.words[b:])} +"] if left else told, c, d)
    return best


def identify(text: str, block: list[tuple[str, int, int]], long: bool) -> list[tuple[int, int, int, str, float, int, str]]:
    """Score (matched less twice the differing words), bounds, license, share saved, differing words and differences of
    each confirmed notice of a block; none overlaps another."""
    out, parts = [], [(0, len(block))]
    while parts:
        low, high = parts.pop()
        words = [w for w, _, _ in block[low:high]]
        if not _MARKS & set(words):
            continue
        match = SequenceMatcher(None, "", words, autojunk=False)
        best = None
        for saved, t in ranked(words, templates()[long]):
            if not t.needs <= set(words) or not (found := compare(t, match, words)):
                continue
            same, other, told, c, d = found
            if t.alone and not _fills_line(text, block, low + c, low + d):
                continue
            if best is None or same - 2 * other > best[0]:
                best = (same - 2 * other, low + c, low + d, (t.name, saved, other, "; ".join(told)))
        if best:
            score, c, d, hit = best
            out.append((score, block[c][1], block[d - 1][2], *hit))
            parts += [(low, c), (d, high)]
    return out


def _fills_line(text: str, block: list[tuple[str, int, int]], c: int, d: int) -> bool:
    """Whether the lines of a part of a block have two other words at most."""
    a = text.rfind("\n", 0, block[c][1]) + 1
    b = text.find("\n", block[d - 1][2])
    around = (*wording(text, a, block[c][1]), *islice(wording(text, block[d - 1][2], len(text) if b < 0 else b), 3))
    return len(around) <= 2


def listed(text: str) -> list[tuple[int, int, int, str, float, int, str]]:
    """The licenses of a notice that names several at once ("under either of A or B"), with no difference in wording."""
    out = []
    for m in _under.finditer(text):
        at, hits = m.end(), []
        if _denied.search(text, max(0, m.start() - 60), m.start()):
            continue
        while name := _name.match(text, at):
            hits.append((name.start(), name.end(), NAMED[name.lastindex - 1][0]))
            more = _more.match(text, name.end())
            if not more:
                break
            at = more.end()
        if len(hits) > 1:
            words = [w for w, _, _ in wording(text[m.start() : hits[-1][1]].lower())]
            plain = len(_plain.compress(" ".join(words).encode()))
            saved = {x: max(plain - len(t.zip.compress(" ".join(words).encode())) for t in templates()[0] if t.name == x) / plain for *_, x in hits}
            out += [(0, a, b, x, saved[x], 0, "") for a, b, x in hits]
    return out


def licenses(text: str) -> list[tuple[int, int, str, float, int, str]]:
    """Bounds, license, share saved, differing words and differences of each notice, in order; none overlaps another."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters have longer lower cases; ASCII has the licensing words
        lower = "".join(c.lower() if c.isascii() else c for c in text)
    hits = {(-score, *hit) for long in (False, True) for block in blocks(lower, reach(long)) for score, *hit in identify(lower, block, long)}
    hits |= {(-score, *hit) for score, *hit in listed(text)}
    hits = {h for h in hits if not _denied.search(lower, max(0, h[1] - 60), h[1])}
    out: list[tuple[int, int, str, float, int, str]] = []
    # a block may end within a notice that another block holds whole, so the best go first
    for _, a, b, *hit in sorted(hits):
        k = bisect_left(out, (a, b))
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or out[k][0] >= b):
            out.insert(k, (a, b, *hit))
    return out


NAMES = ["doc_id", "text_key", "block_start", "block_end", "license", "saved", "n_differences", "differences"]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string())
    for batch in batches:
        some = pa.Table.from_batches([batch]).filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), ANCHOR), False))
        columns = (some.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))
        rows = [(i, k, *x) for i, k, t in zip(*columns, strict=True) for x in licenses(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each confirmed notice: doc_id, text_key (xxhash64 of the text), block_start, block_end, license, saved
    (share of the block's compressed bytes that the template saves), n_differences, differences."""
    lean(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_run, "doc_id long, text_key long, block_start long, block_end long, license string, saved double, n_differences long, differences string")
