"""Licence texts as they stand in files: whole, wrapped, behind comment marks, on one line; and notices inside sentences."""

import textwrap

import pytest

from wordloom.llm import licenses

COPY = "Copyright (c) 2020 Some Body\n\n"
GNU = "GNU {kind} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
HEADER = COPY + "This {what} is free software: you can redistribute it and/or modify it under the terms of the " + GNU + "\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.\n"
ANY = "FOR ANY PURPOSE"
TEXTS = {
    ("mit-full", "MIT"): "MIT License\n\n" + COPY + """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
""",
    ("apache2-header", "Apache-2.0"): COPY + """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS.
""",
    ("apache2-titled", "Apache-2.0"): """Apache License
Version 2.0, January 2004
http://www.apache.org/licenses/

TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
""",
    ("bsd2-full", "BSD-2-Clause"): COPY + """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
""",
    ("gpl3-header", "GPL-3.0"): HEADER.format(what="program", kind="General", v="3"),
    ("gpl2-header", "GPL-2.0"): HEADER.format(what="program", kind="General", v="2"),
    ("lgpl21-header", "LGPL-2.1"): HEADER.format(what="library", kind="Lesser General", v="2.1"),
    ("lgpl3-header", "LGPL-3.0"): HEADER.format(what="library", kind="Lesser General", v="3"),
    ("agpl3-header", "AGPL-3.0"): HEADER.format(what="program", kind="Affero General", v="3"),
    ("gpl3-full", "GPL-3.0"): "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n",
    ("mpl2-header", "MPL-2.0"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    ("isc-full", "ISC"): "ISC License\n\n" + COPY + f"Permission to use, copy, modify, and/or distribute this software {ANY.lower()} with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n",
    ("unlicense", "Unlicense"): "This is free and unencumbered software released into the public domain.\n",
    ("zlib-text", "Zlib"): COPY + "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n",
    ("boost-text", "BSL-1.0"): "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n",
}
TEXTS["bsd3-full", "BSD-3-Clause"] = TEXTS["bsd2-full", "BSD-2-Clause"] + "\n3. Neither the name of the Regents of Somewhere nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
NOTICES = {
    "Foo is released under the MIT License.": "MIT",
    "This project, like its tools, is licensed under the terms of the BSD 3-Clause License, see below.": "BSD-3-Clause",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "The code is distributed under the GNU General Public License version 3 or later.": "GPL-3.0",
    "Available under the GNU Lesser General Public License v2.1": "LGPL-2.1",
    "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Text is published under the\nCreative Commons Attribution 4.0 International License": "CC-BY-4.0",
    "It is made available under the Mozilla Public License, version 2.0.": "MPL-2.0",
    "We released all of it under the Unlicense.": "Unlicense",
}
CLEAN = ("a word under the table", "The MIT campus lies by the river.", "He was licensed to drive.", "provided by the city of Zlibenstadt", "under the terms of the peace", "", "copyright matters are dull")


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.SENTENCES, licenses.RULES, licenses.MAX_GAP)


def found(scanner, text):
    return [m[:2] for m in scanner.match(scanner.recognise(text.encode())[1])]


@pytest.mark.parametrize("rule", TEXTS)
def test_texts(scanner, rule):
    text = TEXTS[rule]
    for mark in ("", "# ", " * ", "// ", ";; ", "dnl "):
        for width in (40, 72, 10_000):
            for end in ("\n", "\r\n"):
                lines = [mark + x for line in text.split("\n") for x in (textwrap.wrap(line, width, break_on_hyphens=False) or [""])]
                got = found(scanner, end.join(["some text before.", "", *lines, "", "some text after"]))
                assert got[:1] == [rule] and {x for _, x in got} == {rule[1]}, (mark, width, got)
    flat = found(scanner, "Before. " + " ".join(text.split()) + " After.")
    assert rule[1] in {x for _, x in flat} or rule[0] in ("apache2-titled", "gpl3-full", "isc-full"), flat


def test_a_whole_text_on_one_line(scanner):
    flat = " ".join(TEXTS["mit-full", "MIT"].split())
    assert found(scanner, flat) == [("mit-full", "MIT")]
    assert found(scanner, " ".join(TEXTS["bsd3-full", "BSD-3-Clause"].split())) == [("bsd3-full", "BSD-3-Clause")]


@pytest.mark.parametrize("text", NOTICES)
def test_notices(scanner, text):
    assert [x for _, x in found(scanner, text)] == [NOTICES[text]]
    assert NOTICES[text] in [x for _, x in found(scanner, f"Intro words here.\n{text}\n\nMore.")]


def test_clean_and_hostile_texts(scanner):
    import time

    for text in CLEAN:
        assert found(scanner, text) == []
    for bad in ("under the ", "licensed under ", "Copyright (c) ", "neither the name of ", "mit license\n", "licensed a b c d ", "released\nunder\n"):
        began = time.time()
        scanner.recognise((bad * (400_000 // len(bad))).encode())
        assert time.time() - began < 10, bad
