"""Licence scans over known texts."""

import itertools
import random
import re

import pytest

from gridloom.llm import license_scan as L
from tests.llm import cases

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions.

2. Redistributions in binary form must reproduce the above copyright notice.

3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software.

This software is provided by the holders as is, and any express or implied warranties are disclaimed.
"""
TEXTS = {
    "This work is licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: MIT\nprint(1)": "MIT",
    "This file is released under the MIT License. Other words follow.": "MIT",
    "Licensed under the GNU General Public License v3.0 or later.": "GPL-3.0+",
    "/* SPDX-License-Identifier: GPL-2.0+ OR BSD-3-Clause */\nLicensed under the Apache License, Version 2.0.\nint x;": "GPL-2.0+ OR BSD-3-Clause,Apache-2.0",
    BSD: "BSD-3-Clause",
    BSD.replace("3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software.", ""): "BSD-2-Clause",
    "This text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Nothing of the sort is said in this text.": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nThe software is provided \"as is\", without warranty of any kind, express or implied.": "MIT",
}


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(text):
    assert L.scan_text(text.encode())[2] == TEXTS[text]


def test_specific_rules_come_first():
    names = [(n, "") for n in ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "MitRef", "BsdGrant")]
    assert L.licences(names) == (["BSD-2-Clause", "MIT"], ["BsdGrant"])


def test_every_rule_matches_its_own_sequence():
    for licence, rule in L.RULES:
        if licence:
            assert L.licences([(n, "") for n in rule])[0] == [licence]


def test_rules_name_known_sentences():
    known = {n for n, _ in L.SENTENCES} | {"Spdx"}
    assert all(set(rule) <= known for _, rule in L.RULES)


def test_documents_with_licence_lines_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op1_license_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        said = docs[r.doc_id]
        if "SPDX-License-Identifier:" in said or "Licensed under the Apache License" in said:
            assert r.licenses
        found = [(n, "") for n in r.sentence_ids.split(",") if n]
        assert (len(found), bool(found) or not r.licenses) == (r.n_sentences, True)


def test_edge_cases(spark):
    rows = L.scan(cases.documents(spark)).collect()
    assert len(rows) == len(cases.rows()) and all(r.licenses == "" for r in rows)
    assert L.scan(cases.empty(spark)).count() == 0


def least(parsed):
    """The shortest texts of a parsed pattern, one for each choice among its alternatives."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append(["1"])  # digits are the only class
        elif name == "BRANCH":
            parts.append([x for one in arg[1] for x in least(one)])
        elif name == "SUBPATTERN":
            parts.append(least(arg[3]))
        elif name == "MAX_REPEAT":
            parts.append(["".join(x) for x in itertools.product(least(arg[2]), repeat=arg[0])])
        else:
            assert name in ("ANY", "AT"), name
            parts.append(["x"])
    return ["".join(x) for x in itertools.product(*parts)]


@pytest.mark.parametrize(("name", "pattern"), L.SENTENCES)
def test_the_shortest_text_of_every_sentence_is_scanned(name, pattern):
    for text in least(re._parser.parse(pattern.replace(" .* ", " x "))):
        for said in (text, text.upper(), text.replace(" ", "\u00a0"), f"Words before.\n\n{text}.\n\nWords after."):
            assert L.scan_text(said.encode())[0] == 1, said
        assert L.identify(text)[0][0] == name or text in ("cc0", "creative commons zero")


def test_sentences_without_the_word_licence():
    assert L.scan_text(b"This work is released under CC BY-SA 4.0.")[2] == "CC-BY-SA-4.0"
    assert L.scan_text(b"Dedicated under CC0 1.0 Universal.")[2] == "CC0-1.0"
    assert L.scan_text(b"All rights reserved.")[1] == "AllRights"
    assert L.scan_text(b"This work is dedicated to the public\ndomain.")[2] == "PublicDomain"


MIT_WRAPPED = """MIT License

Copyright (c) 2020 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_WRAPPED = """Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
"""
APACHE_WRAPPED = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
WRAPPED = {
    "MIT": (MIT_WRAPPED, ""),
    "BSD-3-Clause": (BSD_WRAPPED, "Copyright,AllRights"),
    "BSD-2-Clause": (BSD_WRAPPED[: BSD_WRAPPED.index("3. ")] + BSD_WRAPPED[BSD_WRAPPED.index("THIS") :], "Copyright,AllRights"),
    "Apache-2.0": (APACHE_WRAPPED, ""),
}


@pytest.mark.parametrize("licence", WRAPPED)
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_standard_wrapped_texts(licence, mark, end):
    text, rest = WRAPPED[licence]
    said = "".join(mark + line + end for line in text.split("\n"))
    _, _, found, unmatched = L.scan_text(said.encode())
    assert found == licence
    assert set(unmatched.split(",")) <= {"", "Copyright", *rest.split(",")}


def test_a_sentence_goes_on_in_capitals_and_a_title_ends():
    assert L.scan_text(b"This file is released under the\nMIT License.")[2] == "MIT"
    assert L.scan_text(b"Licensed under the GNU\nGeneral Public License,\nVersion 3\nAll rights reserved")[1:3] == ("GplRef,AllRights", "GPL-3")
    assert L.scan_text(b"Copyright 2020 A. Holder\nAll rights reserved\nLicensed under the MIT License\nCC0 1.0")[1] == "Copyright,AllRights,MitRef,Cc0Ref"


GNU = """This {0} is free software{3} you can redistribute it and/or modify
it under the terms of the GNU {1} as published by
the Free Software Foundation; either version {2} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1} for more details.

You should have received a copy of the GNU {1}
along with this {0}.  If not, see <https://www.gnu.org/licenses/>.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
ISC = """ISC License

Copyright (c) 2020, A. Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
FULL = [
    ("GPL-3+", GNU.format("program", "General Public License", 3, ":").replace("Foundation;", "Foundation,")), ("GPL-2+", GNU.format("program", "General Public License", 2, ";")), ("AGPL-3+", GNU.format("program", "Affero General Public License", 3, ":").replace("Foundation;", "Foundation,")),
    ("LGPL-2.1+", GNU.format("library", "Lesser General Public License", 2.1, ";").replace("Foundation;", "Foundation,")), ("GPL-2", "This program is free software; you can redistribute it and/or modify\nit under the terms of version 2 of the GNU General Public License as\npublished by the Free Software Foundation.\n"),
    ("Zlib", ZLIB), ("ISC", ISC), ("MPL-2.0", MPL), ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with\nthis work has waived all copyright and related or neighboring rights to it.\n"), ("CC0-1.0", "Creative Commons Zero 1.0 Universal\n"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.\n"), ("CC-BY-4.0", "Attribution 4.0 International\n"), ("GPL-2", "Distributed under the GPLv2.\n"), ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose.\n"),
]


@pytest.mark.parametrize(("licence", "text"), FULL, ids=[f"{k}-{x[0]}" for k, x in enumerate(FULL)])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_full_texts(licence, text, mark):
    for end in ("\n", "\r\n"):
        said = "".join((mark + line).rstrip() + end for line in text.split("\n"))
        assert L.scan_text(said.encode())[2:] == (licence, "")


def brute(names):
    """Rules as strings in a string of names: the first place of a rule is taken, until it has none."""
    said, found = "".join(f"<{n}>" for n in names), []
    for licence, rule in L.RULES:
        own = "".join(f"<{n}>" for n in rule)
        while (at := said.find(own)) >= 0:
            found.append((said[:at].count("<"), licence))
            said = said[:at] + "".join(f"<~{n}>" for n in rule) + said[at + len(own) :]
    return list(dict.fromkeys(x for _, x in sorted(found))), [n for n in re.findall(r"<(\w+)>", said)]


def test_rules_agree_with_brute_force_over_sequences_of_sentences():
    rng = random.Random(8)
    said = {name: least(re._parser.parse(p.replace(" .* ", " x ")))[0] for name, p in L.SENTENCES}
    found_any = 0
    for _ in range(400):
        names = []
        for _ in range(rng.randint(0, 7)):
            names += rng.choice(L.RULES)[1] if rng.random() < 0.6 else [rng.choice(list(said))]
        names = [n for n in names if n != "Spdx" and n != "CcTitle"]
        text = " ".join(f"{said[n].capitalize()}." + (" Nothing known is said here." if rng.random() < 0.3 else "") for n in names)
        found = L.identified(text.encode())
        assert [n for n, _ in found] == names
        known, rest = L.licences([(n, "") for n in names])
        assert (known, rest) == brute(names)
        found_any += bool(known)
    assert found_any > 200


def test_first_words_are_those_of_every_text_that_fits():
    for name, pattern in L.SENTENCES:
        for text in least(re._parser.parse(pattern.replace(" .* ", " x "))) + every(re._parser.parse(pattern.replace(" .* ", " x "))):
            assert L.ANYWHERE.search(text) or text.split(" ")[0] in L.FIRST, (name, text)
    assert not any("*" in x or not x for x in L.FIRST)


def every(parsed):
    """Texts of a parsed pattern with all its optional parts, one for each choice."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "MAX_REPEAT":
            parts.append([] if str(arg[2][0][0]) == "ANY" else every(arg[2]))
            parts[-1] = parts[-1] or [""]
        else:
            parts.append(every(arg[3]) if name == "SUBPATTERN" else [x for one in arg[1] for x in every(one)] if name == "BRANCH" else least([(op, arg)]))
    return ["".join(x) for x in itertools.product(*parts)]
