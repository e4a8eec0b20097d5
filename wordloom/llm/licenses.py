"""1. Licence scans by sentence-rule recognition.

A text is cut into pieces: at line ends, after . ! ? ; : before white space, and before the words that open a copyright
line or a part of a licence text (_OPENS), so that texts without lines are cut too; comment marks at the start of a line
are dropped. Each piece is normalised: A-Z in lower case, everything but 0-9, a-z and characters beyond ASCII a blank, single
blanks. Three kinds of sentences have identifiers:

* those of SENTENCES; * in one stands for up to HOLDER words (a holder's name, an address);
* notices, anywhere in a sentence: "released (licensed, distributed, ...) under (the terms of) the NAME" with a name of
  NAMES, or an SPDX identifier;
* copyright lines, which are part of any licence text: rules read past them.

A sentence is a piece, or pieces of following lines of a paragraph without another cut or an empty line between; the longest
counts. Rules are ordered sequences of identifiers; a rule matches where its identifiers follow each other among the
recognised sentences of a text, with at most MAX_GAP unknown sentences (of one or more lines) between two. n_sentences and
spans count pieces. From left to right the longest rule matches first, equal ones in the order of RULES, and matches don't
overlap.

Defined results: null and empty texts have no sentences and no licences; repeated rows are scanned one by one; a
licence found several times is named once, and each match is listed. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches, table
from wordloom.llm.decontamination import NORMAL

MAX_GAP, HOLDER, JOINED = 2, 12, 3
_OPENS = rb"Licensed[\x20\t]+under\b|Copyright[\x20\t]+(?:\([cC]\)|\xc2\xa9|[12]\d{3})|Permission[\x20\t]+(?:is|to[\x20\t]+use)\b|Redistributions?[\x20\t]+(?:and[\x20\t]+use|of[\x20\t]+source|in[\x20\t]+binary)|Neither[\x20\t]+the[\x20\t]+name\b|THE[\x20\t]+SOFTWARE[\x20\t]+IS[\x20\t]+PROVIDED"
_CUT = re.compile(rb"((?<=[.!?;:])(?<!Identifier:)[\x20\x09-\x0D]+|[\r\n]+|(?<=[^\x20\x09-\x0D])[\x20\t]+(?=" + _OPENS + rb"))")
_MARK = re.compile(rb"(?<![^\r\n])[\x20\t]*(?:[!-/:-@\[-`{-~]+|dnl|rem|REM)[\x20\t]+")
_LINE_END = (b"\n", b"\r\n", b"\r")
COPYRIGHT = "copyright"

_DISCLAIMER = "this list of conditions and the following disclaimer"
_REDISTRIBUTE = "you can redistribute it and or modify it under the terms of the"
_PUBLISHED = "as published by the free software foundation either version {} of the license or at your option any later version"
#: Normalised sentence -> identifier.
SENTENCES = {
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-condition",
    "you may obtain a copy of the license at": "apache2-copy",
    "apache license": "apache-title",
    "apache license version 2 0 january 2004": "apache2-title",
    "version 2 0 january 2004": "apache2-version",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "this program is free software": "gpl-free",
    "this file is free software": "gpl-free",
    "this library is free software": "lgpl-free",
    "* is free software": "gpl-free",
    **{f"{_REDISTRIBUTE} gnu {kind} public license {_PUBLISHED.format(v)}": name for kind, v, name in (("general", "3", "gpl3-terms"), ("general", "2", "gpl2-terms"), ("lesser general", "2 1", "lgpl21-terms"), ("lesser general", "3", "lgpl3-terms"), ("affero general", "3", "agpl3-terms"))},
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    f"redistributions of source code must retain the above copyright notice {_DISCLAIMER}": "bsd-source",
    f"1 redistributions of source code must retain the above copyright notice {_DISCLAIMER}": "bsd-source",
    f"redistributions in binary form must reproduce the above copyright notice {_DISCLAIMER} in the documentation and or other materials provided with the distribution": "bsd-binary",
    f"2 redistributions in binary form must reproduce the above copyright notice {_DISCLAIMER} in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at *": "mpl2-copy",
    "mozilla public license version 2 0": "mpl2-title",
    "isc license": "isc-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "boost software license version 1 0 august 17th 2003": "boost-title",
    "distributed under the boost software license version 1 0": "boost-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-grant",
    "cc0 1 0 universal": "cc0-title",
    "all rights reserved": "reserved",
}

#: Normalised name in a notice -> licence. The longest name at a place counts.
NAMES = {
    "mit license": "MIT",
    "mit": "MIT",
    "expat license": "MIT",
    **{x: "Apache-2.0" for x in ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0", "apache license v2 0")},
    **{x: "BSD-3-Clause" for x in ("bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license")},
    **{x: "BSD-2-Clause" for x in ("bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license", "freebsd license")},
    **{f"{family} {form.format(v)}".strip(): f"{name}-{v.replace(' ', '.')}{'' if '.' in v.replace(' ', '.') else '.0'}" for family, name in (("gnu general public license", "GPL"), ("gpl", "GPL"), ("gnu lesser general public license", "LGPL"), ("lgpl", "LGPL"), ("gnu affero general public license", "AGPL"), ("agpl", "AGPL")) for v in ("2", "3", "2 1") for form in ("version {}", "v{}", "{}", "version {} 0", "v{} 0", "{} 0")},
    **{f"{short}v{v}": f"{short.upper()}-{v}.0" for short in ("gpl", "lgpl", "agpl") for v in "23"},
    **{x: "MPL-2.0" for x in ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl version 2 0")},
    "isc license": "ISC",
    "isc": "ISC",
    "unlicense": "Unlicense",
    "boost software license": "BSL-1.0",
    "zlib license": "Zlib",
    "zlib": "Zlib",
    **{x: "CC0-1.0" for x in ("cc0 1 0 universal", "cc0 1 0", "cc0", "creative commons zero")},
    **{f"cc {k} {v} 0".replace("  ", " "): f"CC-{k.upper().replace(' ', '-')}-{v}.0" for k in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd") for v in "34"},
    **{
        f"creative commons attribution{long} {v} 0{tail}": f"CC-BY{short}-{v}.0"
        for long, short in (("", ""), (" sharealike", "-SA"), (" share alike", "-SA"), (" noderivatives", "-ND"), (" noncommercial", "-NC"), (" non commercial", "-NC"), (" noncommercial sharealike", "-NC-SA"), (" noncommercial noderivatives", "-NC-ND"))
        for v in "34"
        for tail in ("", " international", " international license", " license", " unported", " unported license")
    },
}
_NAME = "|".join(sorted(NAMES, key=lambda x: (-len(x), x)))
#: Also as SPDX writes them: "GPL-3.0-or-later" ends in words that say nothing about the name.
_NOTICE = re.compile(rf"(?<![^ ])(?:(?:licensed|licenced|released|distributed|available|published|provided|covered|offered|shared|governed)(?: [^ ]+){{0,4}}? (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?|spdx license identifier )({_NAME})(?: licen[sc]e)?(?![^ ])".encode())
_UNDER = (b"under", b"by", b"identifier")


def _notice(licence: str) -> str:
    return f"notice:{licence}"


#: (rule, licence, identifiers in order), long before short.
RULES = (
    ("mit-full", "MIT", ("mit-title", "mit-grant", "mit-condition")),
    ("mit-text", "MIT", ("mit-grant", "mit-condition")),
    ("apache2-header", "Apache-2.0", ("apache2-notice", "apache2-condition", "apache2-copy")),
    ("apache2-full", "Apache-2.0", ("apache-title", "apache2-version", "apache2-terms")),
    ("apache2-short", "Apache-2.0", ("apache2-notice", "apache2-condition")),
    ("apache2-titled", "Apache-2.0", ("apache2-title", "apache2-terms")),
    *((f"{k}-header", name, (free, f"{k}-terms")) for k, name, free in (("gpl3", "GPL-3.0", "gpl-free"), ("gpl2", "GPL-2.0", "gpl-free"), ("lgpl21", "LGPL-2.1", "lgpl-free"), ("lgpl3", "LGPL-3.0", "lgpl-free"), ("agpl3", "AGPL-3.0", "gpl-free"))),
    *((f"{k}-program", name, ("gpl-free", f"{k}-terms")) for k, name in (("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"))),
    *((f"{k}-library", name, ("lgpl-free", f"{k}-terms")) for k, name in (("gpl3", "GPL-3.0"), ("gpl2", "GPL-2.0"))),
    *((f"{k}-full", name, (f"{k}-title", "gnu-verbatim")) for k, name in (("gpl3", "GPL-3.0"), ("gpl2", "GPL-2.0"), ("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0"))),
    ("bsd3-full", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd2-full", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("mpl2-header", "MPL-2.0", ("mpl2-header", "mpl2-copy")),
    ("isc-full", "ISC", ("isc-title", "isc-grant")),
    ("isc-text", "ISC", ("isc-grant",)),
    ("unlicense", "Unlicense", ("unlicense-grant",)),
    ("boost-full", "BSL-1.0", ("boost-title", "boost-grant")),
    ("boost-text", "BSL-1.0", ("boost-grant",)),
    ("boost-notice", "BSL-1.0", ("boost-notice",)),
    ("zlib-text", "Zlib", ("zlib-grant",)),
    ("cc0-full", "CC0-1.0", ("cc0-title", "cc0-grant")),
    ("cc0-text", "CC0-1.0", ("cc0-grant",)),
    ("mpl2-title", "MPL-2.0", ("mpl2-title",)),
    ("bsd3-text", "BSD-3-Clause", ("bsd-grant", "bsd-endorse")),
    ("bsd-text", "BSD-2-Clause", ("bsd-grant",)),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("apache2-notice", "Apache-2.0", ("apache2-notice",)),
    *((_notice(x), x, (_notice(x),)) for x in dict.fromkeys(NAMES.values())),
    ("reserved", "proprietary", ("reserved",)),
)
RESTRICTED = {"GPL-2.0", "GPL-3.0", "AGPL-3.0", "proprietary", *(x for x in NAMES.values() if "-NC" in x or "-ND" in x)}


class Scanner:
    def __init__(self, sentences: dict[str, str], rules, max_gap: int):
        self.known = {k.encode(): v for k, v in sentences.items() if "*" not in k}
        #: (words before the star, words behind it, identifier)
        self.open = [(*(part.strip().encode() for part in k.split("*")), v) for k, v in sentences.items() if "*" in k]
        #: First words, to look only at sentences that can be known, and all beginnings, to join lines no further.
        fixed = [*self.known, *(before for before, _, _ in self.open)]
        self.first = {k.split()[0] for k in fixed if k}
        self.begins = {b" ".join(k.split()[:n]) for k in fixed for n in range(1, len(k.split()) + 1)}
        self.max_gap, self.by_first = max_gap, {}
        for n, rule in enumerate(rules):
            self.by_first.setdefault(rule[2][0], []).append((-len(rule[2]), n, rule))
        for v in self.by_first.values():
            v.sort()

    def _named(self, key: bytes) -> str | None:
        """Identifier of a normalised sentence."""
        if found := self.known.get(key):
            return found
        for before, behind, name in self.open:
            if key.startswith(before) and key.endswith(behind) and len(key) > len(before) + len(behind):
                if 1 <= len(key[len(before) : len(key) - len(behind)].split()) <= HOLDER:
                    return name
        return None

    def _may_go_on(self, key: bytes) -> bool:
        """Could a known sentence begin like this?"""
        if key in self.begins:
            return True
        for before, behind, _ in self.open:
            if before and key.startswith(before):
                rest = key[len(before) :].split()
                if len(rest) > HOLDER + len(behind.split()):
                    continue
                at = next((i for i, w in enumerate(rest) if behind.startswith(b" ".join(rest[i:]))), len(rest))
                return at <= HOLDER and len(rest) - at <= len(behind.split())
        return False

    def recognise(self, text: bytes) -> tuple[int, list[tuple[int, int, int, str]]]:
        """Pieces in the text, and (first piece, last piece, number of the sentence, identifier) of the known sentences."""
        cut = _CUT.split(_MARK.sub(b"", text))
        pieces: list[tuple[list[bytes], bool]] = []  # words, whether the sentence may go on from the line before
        on = False
        for at in range(0, len(cut), 2):
            ws = cut[at].translate(NORMAL).split()
            if ws:
                pieces.append((ws, on))
            on = bool(ws) and at + 1 < len(cut) and cut[at + 1] in _LINE_END and cut[at][-1:] not in b".!?;:"
        n, sentence, found, known = 0, -1, [], True
        while n < len(pieces):
            ws, on = pieces[n]
            last, name = self._longest(pieces, n)
            if name is None:
                if ws[0] == b"copyright" or ws[:2] in ([b"c", b"copyright"], [b"spdx", b"filecopyrighttext"]):
                    last, name = n, COPYRIGHT
                else:
                    last, name = self._notice_at(pieces, n)
            if name != COPYRIGHT and (name or known or not on):
                sentence += 1
            known = bool(name)
            if name:
                found.append((n, last, sentence, name))
            n = last + 1
        return len(pieces), found

    def _longest(self, pieces: list, n: int) -> tuple[int, str | None]:
        """Last piece and identifier of the longest known sentence that begins with piece n."""
        ws = pieces[n][0]
        last, name, end, key = n, None, n, b" ".join(ws)
        if ws[0] not in self.first:
            return n, self._named(key) if key.endswith(b" is free software") else None
        while True:
            if found := self._named(key):
                last, name = end, found
            end += 1
            if not self._may_go_on(key) or end == len(pieces) or not pieces[end][1]:
                return last, name
            key += b" " + b" ".join(pieces[end][0])

    def _notice_at(self, pieces: list, n: int) -> tuple[int, str | None]:
        """The same of a notice in piece n, or in it and up to JOINED - 1 lines that go on."""
        ws, end = pieces[n][0], n
        if not any(w in ws for w in _UNDER) and not (n + 1 < len(pieces) and pieces[n + 1][1] and any(w in pieces[n + 1][0] for w in _UNDER) and any(w[-2:] == b"ed" or w == b"available" for w in ws)):
            return n, None
        key, best = b" ".join(ws), (n, None, 0)
        while True:
            m = _NOTICE.search(key)
            if m and len(m[0]) > best[2]:
                best = end, _notice(NAMES[m[1].decode()]), len(m[0])
            end += 1
            if end == len(pieces) or end - n >= JOINED or not pieces[end][1]:
                return best[0], best[1]
            key += b" " + b" ".join(pieces[end][0])

    def match(self, found: list[tuple[int, int, int, str]]) -> list[tuple[str, str, int, int]]:
        """(rule, licence, first and last piece) of every match."""
        found = [x for x in found if x[3] != COPYRIGHT]
        out, at = [], 0
        while at < len(found):
            for _, _, (name, licence, ids) in self.by_first.get(found[at][3], ()):
                part = found[at : at + len(ids)]
                if tuple(x[3] for x in part) == ids and all(b[2] - a[2] - 1 <= self.max_gap for a, b in zip(part, part[1:])):
                    out.append((name, licence, part[0][0], part[-1][1]))
                    at += len(ids) - 1
                    break
            at += 1
        return out


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_known, licenses (sorted), rules, spans (pieces), restricted."""
    scanner = Scanner(sentences, rules, max_gap)
    restricted = RESTRICTED

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_sentences", "n_known", "licenses", "rules", "spans", "restricted")}
            for text in b["text"]:
                n, found = scanner.recognise(text or b"")
                matches = scanner.match(found)
                names = sorted({m[1] for m in matches})
                for k, v in zip(out, (n, len(found), names, [m[0] for m in matches], [[m[2], m[3]] for m in matches], any(x in restricted for x in names))):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"]} | out

    kind = docs.schema["doc_id"].dataType.simpleString()
    data = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_batches(data, run, f"doc_id {kind}, n_sentences long, n_known long, licenses array<string>, rules array<string>, spans array<array<long>>, restricted boolean")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join("licenses", ",").alias("licenses"), F.array_join("rules", ",").alias("rules"), "restricted")
