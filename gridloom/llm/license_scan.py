"""Licence scans by sentence rules.

A text is cut into sentences, these are normalised and mapped to identifiers of known licence sentences; the document's
sequence of identifiers is then matched against ordered licence rules, the most specific first. A rule takes the
identifiers that it matches, so that a general rule doesn't see them again. Every sentence of every text is looked up, by
its first word, which is read off the patterns; no filter goes before.

Defined results: a null or empty text has no identifiers and no licences; a licence that occurs again is listed once, in
the order of first occurrence; identifiers that no rule takes are listed as unmatched; repeated rows give repeated
rows; null ids are carried along; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import as_bytes, map_rows, table

SCHEMA = "doc_id long, n_sentences long, sentence_ids string, licenses string, unmatched string"
_VERSION = r"(?: (?:v |version |v)?(\d+(?: \d+)*))"
_IS = "(?:this (?:work|file|project|software|program|library|text|document) is )?(?:free software )?"
_UNDER = _IS + "(?:released|licensed|distributed|made available|available|shared|published) under (?:the terms of )?"
_LATER = r"( or (?:at your option )?(?:any )?later.*)?"
_SHORT_VERSION = r"(?: ?v(?:ersion)?)?(?: ?(\d+(?: \d+)*))?"
_FREE = "(?:this (?:program|library|software|file) is free software )?you can redistribute it and or modify it under the terms of (?:version (\\d+(?: \\d+)*) of )?the gnu {} as published by the free software foundation(?: either)?(?: version (\\d+(?: \\d+)*))?(?: of the license)?" + _LATER
#: Identifier and pattern of each known sentence, over normalised text. The first that fits holds; groups say the version.
SENTENCES = [
    ("ApacheGrant", rf"{_IS}licensed under the apache license{_VERSION}?(?: the license)?"),
    ("ApacheTitle", rf"apache license{_VERSION} january 2004.*"),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at(?: .*)?"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("ApacheLimits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", rf"{_UNDER}the (?:terms of the )?mit license"),
    ("MitTitle", r"(?:the )?mit license(?: mit)?"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("MitLiable", r"in no event shall the authors or copyright holders be liable for any claim.*"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("BoostNotice", r"the copyright notices in the software and this entire statement including the above license grant.*"),
    ("Boost", r"distributed under the boost software license version 1 0"),
    ("IscTitle", r"isc license.*"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that.*"),
    ("ZeroGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", r"the software is provided as is and .* disclaims all warranties.*"),
    ("IscLiable", r"in no event shall .* be liable for any special direct indirect or consequential damages.*"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", r"(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdAdvert", r"(?:3 )?all advertising materials mentioning features or use of this software must display the following acknowledgement.*"),
    ("BsdEndorse", r"(?:3 |4 )?neither the name of .* may be used to endorse or promote products.*"),
    ("BsdAsIs", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("BsdLiable", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages.*"),
    ("AgplRef", rf"{_UNDER}the gnu affero general public license{_VERSION}?{_LATER}"),
    ("LgplRef", rf"{_UNDER}the gnu (?:lesser|library) general public license{_VERSION}?{_LATER}"),
    ("GplRef", rf"{_UNDER}the gnu general public license{_VERSION}?{_LATER}"),
    ("AgplShort", rf"{_UNDER}the (?:gnu )?agpl{_SHORT_VERSION}{_LATER}"),
    ("LgplShort", rf"{_UNDER}the (?:gnu )?lgpl{_SHORT_VERSION}{_LATER}"),
    ("GplShort", rf"{_UNDER}the (?:gnu )?gpl{_SHORT_VERSION}{_LATER}"),
    ("AgplFree", _FREE.format("affero general public license")),
    ("LgplFree", _FREE.format("(?:lesser|library) general public license")),
    ("GplFree", _FREE.format("general public license")),
    ("GnuVersion", rf"either version (\d+(?: \d+)*) of the license{_LATER}"),
    ("GnuNoWarranty", r"this (?:program|library|software|file) is distributed in the hope that it will be useful but without any warranty.*"),
    ("GnuImplied", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GnuSee", r"see the gnu (?:affero |lesser |library )?general public license for more details"),
    ("GnuCopy", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license along with this (?:program|library|software|file).*"),
    ("MplRef", rf"this source code form is subject to the terms of the mozilla public license{_VERSION}?"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("EplRef", rf"(?:.* )?made available under the terms of the eclipse public license{_VERSION}?.*"),
    ("EuplRef", rf"{_UNDER}the (?:european union public licence|eupl){_VERSION}?.*"),
    ("CddlRef", r"the contents of this file are subject to the terms of the common development and distribution license.*"),
    ("OflRef", rf"this font software is licensed under the sil open font license{_VERSION}?"),
    ("WtfplTitle", rf"do what the fuck you want to public license(?:{_VERSION})?.*"),
    ("Cc0Waive", r"to the extent possible under law .* waived all copyright and related or neighboring rights.*"),
    ("Cc0Ref", r"(?:.* )?(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?.*"),
    ("CcRef", rf"{_UNDER}(?:a |the )?(?:cc|creative commons) ((?:by|attribution)(?: (?:nc|sa|nd|noncommercial|sharealike|noderivatives))*)(?: (\d+(?: \d+)*))?.*"),
    ("CcTitle", r"(?:creative commons )?((?:attribution)(?: (?:noncommercial|sharealike|noderivatives))*) (\d+(?: \d+)*) international.*"),
    ("Unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("UnlicenseFree", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("PublicDomain", r"this (?:work|software|file|text|document)(?: is| has been)?(?: released into| dedicated to| in| placed in) the public domain"),
    ("Zlib", r"this software is provided as is without any express or implied warranty"),
    ("ZlibLiable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications.*"),
    ("ZlibOrigin", r"(?:1 )?the origin of this software must not be misrepresented"),
    ("ZlibAltered", r"(?:2 )?altered source versions must be plainly marked as such.*"),
    ("ZlibNotice", r"(?:3 )?this notice may not be removed or altered from any source distribution"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright (?:c )?(?:\d{4}).*"),
]


def over_lines(pattern: str) -> re.Pattern:
    """A pattern of SENTENCES over lines: its blanks may be line ends, it ends with a line, and an open start or end, or a version, stays in its line."""
    pattern = pattern.replace(" .* ", " (?s:.*?) ")
    pattern = re.sub(r"(?<!\(\?:\.\*) (?!\.\*\)|\\d\+\)\*)", r"[ \\n]", pattern)
    return re.compile(rf"{pattern}$", re.M)


def beginnings(parsed) -> set[str]:
    """The first words of all texts that a parsed pattern fits, each up to its first blank, that included; a text that may
    go on after the pattern has none."""
    found = {""}
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            parts = {chr(arg)}
        elif kind == "BRANCH":
            parts = set().union(*map(beginnings, arg[1]))
        elif kind == "SUBPATTERN":
            parts = beginnings(arg[3])
        elif kind == "MAX_REPEAT" and (arg[1] == 1 or all(" " in x for x in beginnings(arg[2]))):
            parts = beginnings(arg[2]) | ({""} if not arg[0] else set())
        else:
            return {x if " " in x else x + "*" for x in found}  # any character or number: the word is open from here
        found = {x if x[-1:] in (" ", "*") else (x + y).split(" ")[0] + (" " if " " in x + y else "") for x in found for y in parts}
        if all(x[-1:] in (" ", "*") for x in found):
            break
    return found


#: The words with which a known sentence can start; `*`: any start, with the words that such a sentence holds at least.
FIRST: set[str] = set()
ANYWHERE = re.compile(r"cc0|creative[ \n]commons[ \n]zero|eclipse[ \n]public[ \n]license")
for _, _pattern in SENTENCES:
    if not _pattern.startswith("(?:.* )?"):
        FIRST |= {x.strip() for x in beginnings(re._parser.parse(_pattern))}
_COMPILED = {name: over_lines(pattern) for name, pattern in SENTENCES}
#: All patterns at once: a match's last group is the sentence that fits, as an outer group closes last.
_ANY = re.compile("|".join(f"(?P<{name}>{pattern.pattern})" for name, pattern in _COMPILED.items()), re.M)
_GNU = ("GnuVersion?", "GnuNoWarranty?", "GnuImplied?", "GnuSee?", "GnuCopy?")
#: Licence and the identifiers that it takes, in order, with nothing between; those with a question mark may be absent.
ORDERED = [
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse", "BsdAsIs", "BsdLiable?")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiable?")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiable?")),
    ("Apache", ("ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheLimits?")),
    ("MIT", ("MitTitle?", "Copyright?", "AllRights?", "MitGrant", "MitNotice", "MitAsIs", "MitLiable?")),
    ("MIT", ("MitRef", "MitGrant", "MitNotice", "MitAsIs", "MitLiable?")),
    ("AGPL", ("AgplFree", *_GNU)),
    ("LGPL", ("LgplFree", *_GNU)),
    ("GPL", ("GplFree", *_GNU)),
    ("ISC", ("IscTitle?", "Copyright?", "IscGrant", "IscAsIs", "IscLiable?")),
    ("0BSD", ("ZeroGrant", "IscAsIs", "IscLiable?")),
    ("BSL-1.0", ("BoostGrant", "BoostNotice", "MitAsIs?")),
    ("Zlib", ("Zlib", "ZlibLiable?", "ZlibGrant", "ZlibOrigin?", "ZlibAltered?", "ZlibNotice?")),
    ("MPL", ("MplRef", "MplCopy?")),
    ("Unlicense", ("Unencumbered", "UnlicenseFree?")),
    ("Apache", ("ApacheTitle",)),
    ("Apache", ("ApacheGrant",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitTitle",)),
    ("ISC", ("IscTitle",)),
    ("AGPL", ("AgplRef",)),
    ("AGPL", ("AgplShort",)),
    ("LGPL", ("LgplRef",)),
    ("LGPL", ("LgplShort",)),
    ("GPL", ("GplRef",)),
    ("GPL", ("GplShort",)),
    ("EPL", ("EplRef",)),
    ("EUPL", ("EuplRef",)),
    ("CDDL", ("CddlRef",)),
    ("OFL", ("OflRef",)),
    ("WTFPL", ("WtfplTitle",)),
    ("CC0-1.0", ("Cc0Waive",)),
    ("CC0-1.0", ("Cc0Ref",)),
    ("CC", ("CcRef",)),
    ("CC", ("CcTitle",)),
    ("BSL-1.0", ("Boost",)),
    ("PublicDomain", ("PublicDomain",)),
    ("", ("Spdx",)),
]


def forms(rule: tuple[str, ...]) -> list[tuple[str, ...]]:
    """A rule with and without the parts that may be absent, the longest form first."""
    out: list[tuple[str, ...]] = [()]
    for part in rule:
        name = part.rstrip("?")
        out = [x + y for x in out for y in (((name,), ()) if part.endswith("?") else ((name,),))]
    return sorted(out, key=len, reverse=True)


RULES = [(licence, form) for licence, rule in ORDERED for form in forms(rule)]
_END = re.compile(rb"[.;!?\n](?:(?<=[.;!?])(?<!\b[vV]\.)(?=\s|$)|(?<=\n)[^\S\n]*\n)")
#: Where a sentence may end, or a known one go on: a title has no full stop, and a wrapped text goes on in capitals.
_LINE = re.compile(rb"(?<![,\w-])\n|\n(?=[A-Z0-9*#/;%<!: -]*[A-Z])")
#: A tag line is a sentence of its own, and what it says is kept as it is written.
_TAG = re.compile(rb"SPDX-License-Identifier:[^\S\n]*([A-Za-z0-9.+():-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+():-]+)*)[^\n]*", re.I)
#: Letters in lower case and digits; all other bytes are blanks.
_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SHORT = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd"}


def plain(line: bytes) -> str:
    return b" ".join(line.translate(_PLAIN).split()).decode()


def sentences(text: bytes) -> list[str]:
    """Normalised sentences: ASCII letters in lower case and digits, single blanks, and a line end wherever the sentence may
    end before its full stop. A full stop within a number, or after the v of a version, ends none."""
    out = []
    for part in _END.split(text):
        said = "\n".join(x for line in _LINE.split(part) if (x := plain(line))) if b"\n" in part else plain(part)
        if said:
            out.append(said)
    return out


def identify(sentence: str) -> list[tuple[str, str]]:
    """(identifier, what it says of the version or kind) of the known sentences that whole lines of a normalised one hold."""
    found, at, anywhere = [], 0, ANYWHERE.search(sentence)
    while at < len(sentence):
        end = sentence.find("\n", at)
        blank = sentence.find(" ", at, end) if 0 <= end else sentence.find(" ", at)
        if not anywhere and sentence[at : blank if 0 <= blank else end if 0 <= end else None] not in FIRST:  # no pattern starts so
            at = end + 1 if 0 <= end else len(sentence)
            continue
        if known := _ANY.match(sentence, at):
            name = known.lastgroup
            said = [g.replace("\n", " ") for g in _COMPILED[name].match(sentence, at).groups() if g]
            later = bool(said) and said[-1].startswith(" or ")
            said = said[:-1] if later else said
            found.append((name, " ".join(said) + ("+" if later else "")))
            end = known.end()
        at = end + 1 if 0 <= end else len(sentence)
    return found


def identified(text: bytes) -> list[tuple[str, str]]:
    """The identifiers of a text's known sentences, in order."""
    found, at = [], 0
    for tag in [*_TAG.finditer(text), None]:
        found += [x for s in sentences(text[at : tag.start() if tag else len(text)]) for x in identify(s)]
        if tag:
            found.append(("Spdx", tag[1].decode()))
            at = tag.end()
    return found


def named(licence: str, said: str) -> str:
    if licence == "":
        return said
    plus = said.endswith("+")
    said = said.rstrip("+")
    if licence == "CC":
        words = [_SHORT.get(w, w) for w in said.split()]
        kinds, numbers = [w for w in words if not w.isdigit()], [w for w in words if w.isdigit()]
        return "-".join(["CC", "-".join(kinds).upper(), ".".join(numbers)]).rstrip("-")
    numbers = said.replace(" ", ".")
    return "-".join(x for x in (licence, numbers) if x) + ("+" if plus else "")


def licences(found: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Licences by rule, in order of place, and the identifiers that no rule takes."""
    names = [name for name, _ in found]
    present = set(names)
    taken: list[str | None] = [None] * len(found)
    heads: list[tuple[int, str]] = []
    for licence, rule in RULES:
        if rule[0] not in present:
            continue
        for i in range(len(names) - len(rule) + 1):
            if tuple(names[i : i + len(rule)]) == rule and not any(taken[i : i + len(rule)]):
                taken[i : i + len(rule)] = [licence or "Spdx"] * len(rule)
                said = next((s for _, s in found[i : i + len(rule)] if s), "")
                heads.append((i, named(licence, said)))
    return list(dict.fromkeys(x for _, x in sorted(heads))), [n for n, t in zip(names, taken, strict=True) if not t]


def scan_text(text: bytes) -> tuple[int, str, str, str]:
    """The columns of SCHEMA after doc_id."""
    found = identified(text)
    known, rest = licences(found)
    return len(found), ",".join(n for n, _ in found), ",".join(known), ",".join(rest)


def scan(docs: DataFrame) -> DataFrame:
    def rows(_, batch):
        yield [batch.column(0), *zip(*(scan_text(t.as_py()) for t in batch.column(1)), strict=True)]

    return map_rows(docs.select("doc_id", as_bytes()), rows, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
