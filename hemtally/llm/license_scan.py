"""License scans by ordered signature rules."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks

#: Fixed values of the base scan: phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: Licenses by hand: label, keyword that every form of the name holds, name, identifiers, versions (each with its pattern), web address.
_V = r"[ ,]*(?:\(?(?:the )?(?:version|ver\.?|v\.?) ?)?"
FAMILIES: list[tuple[str, str, str, str, tuple[str, ...], str]] = [
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache", ("2.0", "1.1", "1.0"), r"apache\.org/licenses"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", r"gpl", ("3.0", "2.0", "1.0"), r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl", ("3.0", "2.1", "2.0"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl", ("3.0", "1.0"), r"gnu\.org/licenses/agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl", ("1.3", "1.2", "1.1"), r"gnu\.org/licenses/fdl"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl", ("2.0", "1.1", "1.0"), r"mozilla\.org/mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl", ("2.0", "1.0"), r"eclipse\.org/legal/epl"),
    ("eupl", "european union", r"european union public licen[cs]e", r"eupl", ("1.2", "1.1", "1.0"), r"eupl\.eu"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", r"cddl", ("1.1", "1.0"), r"sun\.com/cddl"),
    ("cpl", "common public", r"common public licen[cs]e", r"cpl", ("1.0",), r"eclipse\.org/legal/cpl"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic", ("2.0", "1.0"), r"perlfoundation\.org/artistic"),
    ("osl", "open software", r"open software licen[cs]e", r"osl", ("3.0", "2.1", "2.0", "1.0"), r"opensource\.org/licenses/osl"),
    ("afl", "academic free", r"academic free licen[cs]e", r"afl", ("3.0", "2.1", "2.0"), r"opensource\.org/licenses/afl"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", r"ofl", ("1.1", "1.0"), r"scripts\.sil\.org/ofl"),
    ("odbl", "open database", r"open database licen[cs]e", r"odbl", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    ("zpl", "zope", r"zope public licen[cs]e", r"zpl", ("2.1", "2.0"), r"zope\.org/zpl"),
    ("lppl", "latex project", r"latex project public licen[cs]e", r"lppl", ("1.3c", "1.3a", "1.2"), r"latex-project\.org/lppl"),
    ("psf", "python software", r"python software foundation licen[cs]e", r"psf", ("2.0",), r"python\.org/psf/license"),
    ("bsl", "boost", r"boost software licen[cs]e", r"bsl", ("1.0",), r"boost\.org/license"),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e", r"cecill", ("2.1", "2.0", "1.0"), r"cecill\.info/licen[cs]es"),
    ("mit", "mit licen", r"mit licen[cs]e", r"mit", (), r"opensource\.org/licenses/mit"),
    ("isc", "isc licen", r"isc licen[cs]e", r"isc", (), r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", (), r"zlib\.net/zlib_license"),
    ("unlicense", "the unlicen", r"the unlicen[cs]e", r"unlicense", (), r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?", r"wtfpl", (), r"wtfpl\.net"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2[- ]clause|freebsd) licen[cs]e", r"bsd-2-clause", (), r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3[- ]clause) licen[cs]e", r"bsd-3-clause", (), r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4[- ]clause) licen[cs]e", r"bsd-4-clause", (), r"spdx\.org/licenses/bsd-4"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[cs]e", r"bsd", (), r"opensource\.org/licenses/bsd-license"),
    ("cc0", "cc0", r"cc0(?: public domain dedication)?", r"cc0-1\.0", (), r"creativecommons\.org/publicdomain/zero"),
]
#: Creative Commons: label, words, identifier.
CREATIVE_COMMONS = [
    ("cc-by-nc-nd", r"attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s(?: works)?", "by-nc-nd"),
    ("cc-by-nc-sa", r"attribution[- ]non-?commercial[- ]share-?alike", "by-nc-sa"),
    ("cc-by-nc", r"attribution[- ]non-?commercial", "by-nc"),
    ("cc-by-nd", r"attribution[- ]no-?deriv(?:ative)?s(?: works)?", "by-nd"),
    ("cc-by-sa", r"attribution[- ]share-?alike", "by-sa"),
    ("cc-by", r"attribution", "by"),
]
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")
#: Phrases of license texts themselves: label, keyword, pattern. Every match holds its keyword, but for one of Apache's: other licenses use that
#: sentence too, so the text must name Apache besides.
TEXTS = [
    ("mit", "permission is hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("gpl", "free software", r"this program is free software[;:,] you can redistribute it"),
    ("lgpl", "free software", r"this library is free software[;:,] you can redistribute it"),
    ("apache", "apache", r"you may not use this file except in compliance with the licen[cs]e"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[cs]e"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated)(?: in)?to the public domain|(?:is|are) in the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "to deal in the software", r"to deal in the software without restriction, including without limitation the rights to use"),
    ("x11", "x consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("isc", "the software is provided", r"the software is provided \"as is\" and the author disclaims all warranties"),
    ("isc", "isc disclaims", r"isc disclaims all warranties with regard to this software"),
    ("0bsd", "permission to use", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.? the software"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"may(?: not)? be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "this product includes software developed by", r"this product includes software developed by"),
    ("bsd-clear", "no express or implied licenses", r"no express or implied licenses to any party's patent rights are granted"),
    ("apache", "apache", r"licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "work and derivative works thereof", r"work and derivative works thereof"),
    ("gpl-3.0", "free software foundation", r"as published by the free software foundation[;,] (?:either )?version 3"),
    ("gpl-2.0", "free software foundation", r"as published by the free software foundation[;,] (?:either )?version 2"),
    ("gpl", "you should have received a copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "you should have received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", "preamble", r"preamble the licen[cs]es for most software are designed to take away your freedom"),
    ("gpl-exception", "runtime library exception|classpath exception|linking exception", r"(?:gcc runtime library|classpath|linking) exception"),
    ("lgpl", "combined work", r"you may convey a combined work under terms of your choice"),
    ("agpl", "remote network interaction", r"remote network interaction; use with the gnu general public licen[cs]e"),
    ("gfdl", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("mpl", "incompatible with secondary", r"incompatible with secondary licen[cs]es"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", "agreement steward", r"the eclipse foundation is the initial agreement steward"),
    ("cpl", "accompanying materials", r"accompanying materials are made available under the terms of the common public"),
    ("ipl", "ibm public licen", r"ibm public licen[cs]e(?: version 1\.0)?"),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution"),
    ("artistic", "freely available", r"place your modifications in the public domain or otherwise make them freely available"),
    ("artistic-2.0", "standard version", r"you are permitted to use the standard version and create and use modified versions for any purpose"),
    ("artistic", "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("libpng", "libpng licen|png reference library", r"(?:libpng|png reference library) licen[cs]e"),
    ("bsl-1.0", "machine-executable", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0-1.0", "waive", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc-by", "appropriate credit", r"you must give appropriate credit, provide a link to the licen[cs]e"),
    ("cc-by-sa", "same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "modified material", r"you may not distribute the modified material"),
    ("cc-by-sa", "wikipedia", r"text is available under the creative commons attribution-share-?alike licen[cs]e"),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font name"),
    ("ofl", "with reserved font name", r"with reserved font name"),
    ("odbl", "open database", r"this .{1,60}? is made available under the open database"),
    ("odc-by", "open data commons attribution", r"open data commons attribution licen[cs]e"),
    ("pddl", "public domain dedication and licen", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("ogl-uk", "open government licen", r"open government licen[cs]e(?: v?[123]\.0)?"),
    ("etalab", "licence ouverte", r"licence ouverte(?:/open licence)?"),
    ("psf", "for python", r"psf licen[cs]e agreement for python"),
    ("php", "php licen", r"php licen[cs]e(?:,? version 3\.0?1)?"),
    ("php", "this product includes php", r"this product includes php software, freely available from"),
    ("ruby", "ruby's licen", r"ruby's licen[cs]e"),
    ("vim", "vim licen", r"vim licen[cs]e"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project|openssl licen[cs]e"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", "curl licen", r"curl licen[cs]e"),
    ("ncsa", "illinois/ncsa", r"university of illinois/ncsa open source licen[cs]e"),
    ("ntp", "university of delaware", r"the university of delaware makes no representations about the suitability"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat (?:public )?licen[cs]e"),
    ("qpl", "q public", r"q public licen[cs]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("wxwindows", "wxwindows", r"wxwindows library licen[cs]e"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl)"),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e"),
    ("sspl", "server side public", r"server side public licen[cs]e"),
    ("elastic", "elastic licen", r"elastic licen[cs]e(?: 2\.0)?"),
    ("busl", "business source", r"business source licen[cs]e"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e"),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?:-m|\+\+)?"),
    ("llama", "community license agreement", r"llama [23](?:\.[0-9])? community license agreement"),
    ("beerware", "beer-ware|beerware", r"the beer-ware licen[cs]e|beerware licen[cs]e"),
    ("json", "good, not evil", r"the software shall be used for good, not evil"),
    ("afl", "academic free", r"licensed under the academic free licen[cs]e"),
    ("osl", "open software licen", r"licensed under the open software licen[cs]e"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)(?:,? or (?:copying|reproduction|use|distribution))? of this (?:file|software|document) is (?:strictly )?prohibited"),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:confidential information and )?trade secrets? of"),
    ("proprietary", "end user licen", r"end user licen[cs]e agreement"),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?:, distributed)?(?:,? or transmitted)? in any form"),
    ("proprietary", "prior written", r"without (?:the )?(?:express )?prior written (?:permission|consent) of the (?:publisher|author|copyright holder)"),
    ("dual-license", "dual", r"(?:dual[- ]licensed|dually licensed) under"),
    ("unknown-license", "licen", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?\w[\w.+-]{0,30}(?: \w[\w.+-]{0,30}){0,3} licen[cs]e"),
]

#: White space that is not a single space: over line ends with the comment marks behind them, or within a line.
_GAP = re.compile(r"[^\S\n]*+\n\s*+(?:(?:(?:[#*;%>|!]+|//+!?|/\*+|--+|\.\.)(?:\s++|(?=\w))|(?:dnl|rem)\b\s++))*+|\s\s++|[^\S ]")
#: The number of a list's item, and what may stand before a version.
_ITEM, _VERSION = re.compile(r"\d+[.)](?!\d)"), re.compile(r"\b(?:version|ver\.?|v\.?)$")


@cache
def rules() -> list[tuple[int, str, tuple[str, ...], re.Pattern, float]]:
    """(priority, label, keywords, pattern, weight), the most telling first: identifiers, web addresses, versioned names, names, texts.

    What a pattern matches holds one of its keywords (divided by |), so a text without them need not be searched.
    """
    found: list[tuple[str, str, str, float, int]] = []
    for label, keyword, name, short, versions, address in FAMILIES:
        site = re.split(r"[(\[]", address)[0].replace("\\", "")
        for v in versions:
            number = re.escape(v).replace(r"\.0", r"(?:\.0)?")
            found.append((f"{label}-{v}", "spdx", rf"spdx-license-identifier: ?{short}-{number}(?:-only|-or-later|\+)?(?![\w.])", 1.0, 0))
            found.append((f"{label}-{v}", short, rf"\b{short}[- ]?v?{number}\b(?!\.\d)", 0.8, 2))
            found.append((f"{label}-{v}", site, rf"{address}[-/]?{number}\b", 0.95, 1))
            found.append((f"{label}-{v}", keyword, rf"\b{name}{_V}{number}\b(?!\.\d)", 0.95, 2))
        found.append((label, "spdx", rf"spdx-license-identifier: ?{short}(?![\w.-])", 1.0, 0))
        found.append((label, site, address, 0.9, 1))
        found.append((label, keyword, rf"\b(?:licensed|released|distributed) under (?:the )?(?:terms of the )?{name}", 0.9, 3))
        found.append((label, keyword, rf"\b{name}", 0.7, 4))
    for label, words, short in CREATIVE_COMMONS:
        dashed = short.replace("-", "[- ]")
        for v in CC_VERSIONS:
            number = re.escape(v)
            found.append((f"{label}-{v}", "spdx", rf"spdx-license-identifier: ?cc-{short}-{number}", 1.0, 0))
            found.append((f"{label}-{v}", "creativecommons", rf"creativecommons\.org/licenses/{short}/{number}", 0.95, 1))
            found.append((f"{label}-{v}", "cc by|cc-by|cc- by", rf"\bcc[- ]{dashed}[- ]{number}", 0.95, 2))
            found.append((f"{label}-{v}", "creative commons", rf"\bcreative commons {words} {number}", 0.95, 2))
        found.append((label, "cc by|cc-by|cc- by", rf"\bcc[- ]{dashed}\b(?![- ](?:nc|nd|sa)\b)", 0.8, 4))
        found.append((label, "creative commons", rf"\bcreative commons {words}", 0.8, 4))
    found += [(label, keyword, pattern, 0.6 if label != "unknown-license" else 0.3, 6 if label == "unknown-license" else 5) for label, keyword, pattern in TEXTS]
    # a line may end behind a hyphen
    return [(p, label, tuple(k.split("|")), re.compile(pattern.replace("[- ]", "(?:- ?| )"), re.S), w) for label, k, pattern, w, p in sorted(found, key=lambda x: x[4])]


def flat(text: str) -> tuple[str, list[int], list[int]]:
    """The text with each run of white space, comment marks at line starts included, as one space; where these stand, and where their runs end in `text`.

    Ahead of a numbered item of a list a line end stands for the run, as the number is no version then. Single spaces stay and are not listed.
    """
    parts, at, ends, done, length = [], [], [], 0, 0
    for m in _GAP.finditer(text):
        begin, end = m.span()
        listed = "\n" in m.group() and _ITEM.match(text, end) and not _VERSION.search(text[max(begin - 9, 0) : begin])
        parts += (text[done:begin], "\n" if listed else " ")
        length += begin - done + 1
        at.append(length - 1)
        ends.append(end)
        done = end
    return "".join(parts) + text[done:], at, ends


@cache
def _prefilter() -> tuple[ahocorasick.Automaton, list[list[int]]]:
    """What finds all keywords in one pass over a text, and the rules of each."""
    rules_of: dict[str, list[int]] = {}
    for order, (_, _, keywords, _, _) in enumerate(rules()):
        for k in keywords:
            rules_of.setdefault(k, []).append(order)
    automaton = ahocorasick.Automaton()
    for i, k in enumerate(rules_of):
        automaton.add_word(k, i)
    automaton.make_automaton()
    return automaton, list(rules_of.values())


def standing(found: list[tuple[int, int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, weight) of the detections that stand; `found`: (priority, start, -end, order, label, weight).

    Priority by priority: what overlaps a better one that stands is out by a look at those' merged intervals. Of the rest what lies inside another is out
    by the furthest end so far, as starts go up; of equal intervals the first rule's stands. So the time is that of sorting.
    """
    stands: list[tuple[int, int, int, str, float]] = []
    covered: list[tuple[int, int]] = []
    for priority, same in itertools.groupby(sorted(found), key=lambda x: x[0]):
        begins, far, new = [s for s, _ in covered], -1, []
        for _, start, end, _, label, weight in same:
            i = bisect_left(begins, -end) - 1  # the last interval that begins before this one's end
            if -end > far and not (i >= 0 and covered[i][1] > start):
                far = -end
                new.append((start, far, priority, label, weight))
        stands += new
        merged: list[tuple[int, int]] = []
        for s, e in sorted([*covered, *((s, e) for s, e, *_ in new)]):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        covered = merged
    return stands


def detections(lower: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) of the detections that stand, by start.

    Rules run on the flat text, each only if one of its keywords occurs. A detection falls that lies inside one that stands, or overlaps one of a
    better priority.
    """
    text, at, ends = flat(lower)
    automaton, by_keyword = _prefilter()
    wanted = sorted({order for _, k in automaton.iter(text) for order in by_keyword[k]})
    found = []
    for order in wanted:
        priority, label, _, pattern, weight = rules()[order]
        found += [(priority, m.start(), -m.end(), order, label, weight) for m in pattern.finditer(text)]
    stands = standing(found)

    def place(i: int) -> int:
        gaps = bisect_left(at, i)
        return i if not gaps else ends[gaps - 1] + i - at[gaps - 1] - 1

    return [(place(s), place(e - 1) + 1, label, w) for s, e, _, label, w in sorted(stands)]


_WORD_BYTE = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections (start, end, label).

    A-Z is lower-cased; words are runs of digits, a-z and characters beyond ASCII. The base places are those where a phrase's words stand one
    after another, first_word and last_word the smallest and largest number of a place's first word (null without any). The rules add
    labels, across line ends and comment marks too; both are distinct, sorted and comma-joined, and empty without any. score: 1 less the product of what each
    standing detection leaves open, at least 0.7 for a base place. A null text counts as empty. One row per row; nothing is shuffled.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks(frames, "text"):
            lows = ["" if t is None else t.translate(_UPPER) if not t.isascii() else t.lower() for t in rows["text"].tolist()]
            parts = [t.encode("utf-8", "replace") for t in lows]
            word = _WORD_BYTE[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
            rise = np.flatnonzero(word & ~np.append(False, word[:-1]))
            ends = np.cumsum([len(p) + 1 for p in parts])
            n_words = np.diff(np.searchsorted(rise, ends), prepend=0)
            out = []
            for low in lows:
                places, base = [], set()
                if "license" in low:
                    words = _WORD.findall(low)
                    for i, w in enumerate(words):
                        if w == "license":
                            for phrase, label in PHRASES.items():
                                at = i - len(phrase) + 1
                                if at >= 0 and tuple(words[at : i + 1]) == phrase:
                                    places.append(at)
                                    base.add(label)
                stands = detections(low)
                left = 1.0
                for *_, weight in stands:
                    left *= 1 - weight
                score = max(1 - left, 0.7 if places else 0.0)
                out.append((
                    len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {x[2] for x in stands})), score, [{"start": s, "end": e, "label": x} for s, e, x, _ in stands],
                ))
            frame = pd.DataFrame(out, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            frame = frame.astype({"first_word": "Int64", "last_word": "Int64"})
            frame.insert(0, "n_words", n_words)
            frame.insert(0, "id", rows["id"].to_numpy() if len(rows) else rows["id"])
            yield frame

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string>>"
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scan, schema).withColumnRenamed("id", id_col)
