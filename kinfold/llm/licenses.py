"""Licence scans: sentences to known identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

# Licence sentences, normalised, as patterns over a whole sentence. First fit names it.
SENTENCES = (
    ("SPDX", r"(?:.* )?spdx license identifier ([a-z0-9.+ ]+)"),
    ("Copyright", r"(?:.* )?(?:copyright|©).*\d{4}.*"),
    ("AllRights", r"all rights reserved"),
    ("ApacheRef", r"(?:.* )?(?:licensed|released|distributed) under the apache license,? version 2(?:\.0)?(?: the license)?"),
    ("ApacheComply", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at .*apache.*"),
    ("ApacheWarranty", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MITRef", r"(?:.* )?(?:licensed|released|distributed|available) under the (?:terms of the )?mit license"),
    ("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITWarranty", r"the software is provided as is without warranty of any kind .*"),
    ("MITLiability", r"in no event shall the authors or copyright holders be liable .*"),
    ("LGPLRef", r"(?:.* )?under the (?:terms of the )?gnu lesser general public license,? ?(?:as published by the free software foundation )?(?:either )?(?:version |v)?(2\.1|3)?.*"),
    ("AGPLRef", r"(?:.* )?under the (?:terms of the )?gnu affero general public license.*"),
    ("GPL3Ref", r"(?:.* )?under the (?:terms of the )?gnu general public license,? ?(?:as published by the free software foundation )?(?:either )?(?:version |v)3(?:\.0)?"),
    ("GPL3Later", r"(?:.* )?under the (?:terms of the )?gnu general public license,? ?(?:as published by the free software foundation )?(?:either )?(?:version |v)3(?:\.0)? of the license or (?:at your option )?any later version"),
    ("GPL2Ref", r"(?:.* )?under the (?:terms of the )?gnu general public license,? ?(?:as published by the free software foundation )?(?:either )?(?:version |v)2(?:\.0)?"),
    ("GPL2Later", r"(?:.* )?under the (?:terms of the )?gnu general public license,? ?(?:as published by the free software foundation )?(?:either )?(?:version |v)2(?:\.0)? of the license or (?:at your option )?any later version"),
    ("GPLWarranty", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("GPLCopy", r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this program.*"),
    ("MPLRef", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)?\.? ?2\.0"),
    ("MPLCopy", r"if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("BSDGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BSDSource", r"(?:\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation.*"),
    ("BSDNames", r"(?:\d )?neither the name of .* may be used to endorse or promote products .*"),
    ("BSDWarranty", r"this software is provided by .* as is and any express or implied warranties .*"),
    ("BSDRef", r"(?:.* )?under the (?:terms of the )?bsd license"),
    ("BSD0Grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCGrant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted.*"),
    ("PostgreSQLGrant", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted.*"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions.*"),
    ("ZlibWarranty", r"this software is provided as is without any express or implied warranty"),
    ("BoostRef", r"(?:.* )?under the boost software license version 1\.0.*"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("EPL2Ref", r"(?:.* )?eclipse public license,? ?(?:v|v\. |version )?2\.0.*"),
    ("EPL1Ref", r"(?:.* )?eclipse public license,? ?(?:v|v\. |version )?1\.0.*"),
    ("CDDLRef", r"(?:.* )?common development and distribution license.*"),
    ("EUPLRef", r"(?:.* )?(?:european union public licence|licensed under the eupl).*"),
    ("ArtisticRef", r"(?:.* )?under the (?:terms of the )?artistic license 2\.0.*"),
    ("OFLRef", r"(?:.* )?sil open font license.*"),
    ("GFDLRef", r"(?:.* )?under the terms of the gnu free documentation license.*"),
    ("PSFRef", r"(?:.* )?python software foundation license.*"),
    ("MSPLRef", r"(?:.* )?microsoft public license.*"),
    ("WTFPLRef", r"(?:.* )?do what the fuck you want to public license.*"),
    ("ApacheTitle", r"apache license version 2\.0 january 2004.*"),
    ("MITTitle", r"(?:the )?mit license"),
    ("GPL3Title", r"gnu general public license version 3 29 june 2007.*"),
    ("GPL2Title", r"gnu general public license version 2 june 1991.*"),
    ("LGPL3Title", r"gnu lesser general public license version 3 29 june 2007.*"),
    ("LGPL21Title", r"gnu lesser general public license version 2\.1 february 1999.*"),
    ("AGPL3Title", r"gnu affero general public license version 3 19 november 2007.*"),
    ("MPLTitle", r"mozilla public license version 2\.0"),
    ("CCBYSA", r"(?:.* )?under (?:a |the )?(?:creative commons attribution sharealike|cc by sa) ?(\d\.\d)?.*"),
    ("CCBYNC", r"(?:.* )?under (?:a |the )?(?:creative commons attribution noncommercial|cc by nc) ?(\d\.\d)?.*"),
    ("CCBY", r"(?:.* )?under (?:a |the )?(?:creative commons attribution|cc by) ?(\d\.\d)?.*"),
    ("CC0", r"(?:.* )?(?:cc0|creative commons zero).*"),
    ("PublicDomain", r"this is free and unencumbered software released into the public domain"),
)
# Rules in the order in which they are tried at a sentence.
RULES = (
    ("SPDX", ("SPDX",)),
    ("Apache-2.0", ("ApacheRef", "ApacheComply", "ApacheCopy", "ApacheWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef", "ApacheComply")),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty")),
    ("MIT", ("MITRef",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNames", "BSDWarranty")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDWarranty")),
    ("BSD", ("BSDRef",)),
    ("ISC", ("ISCGrant", "BSDWarranty")),
    ("ISC", ("ISCGrant", "MITWarranty")),
    ("ISC", ("ISCGrant",)),
    ("LGPL", ("LGPLRef", "GPLWarranty", "GPLCopy")),
    ("LGPL", ("LGPLRef",)),
    ("AGPL-3.0", ("AGPLRef",)),
    ("GPL-3.0-or-later", ("GPL3Later", "GPLWarranty", "GPLCopy")),
    ("GPL-3.0-or-later", ("GPL3Later",)),
    ("GPL-3.0", ("GPL3Ref",)),
    ("GPL-2.0-or-later", ("GPL2Later", "GPLWarranty", "GPLCopy")),
    ("GPL-2.0-or-later", ("GPL2Later",)),
    ("GPL-2.0", ("GPL2Ref",)),
    ("MPL-2.0", ("MPLRef", "MPLCopy")),
    ("MPL-2.0", ("MPLRef",)),
    ("CC-BY-SA", ("CCBYSA",)),
    ("CC-BY-NC", ("CCBYNC",)),
    ("CC-BY", ("CCBY",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("PublicDomain",)),
    ("0BSD", ("BSD0Grant", "MITWarranty")),
    ("0BSD", ("BSD0Grant",)),
    ("PostgreSQL", ("PostgreSQLGrant",)),
    ("Zlib", ("ZlibWarranty", "ZlibGrant")),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostRef",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("EPL-2.0", ("EPL2Ref",)),
    ("EPL-1.0", ("EPL1Ref",)),
    ("CDDL", ("CDDLRef",)),
    ("EUPL", ("EUPLRef",)),
    ("Artistic-2.0", ("ArtisticRef",)),
    ("OFL", ("OFLRef",)),
    ("GFDL", ("GFDLRef",)),
    ("PSF-2.0", ("PSFRef",)),
    ("MS-PL", ("MSPLRef",)),
    ("WTFPL", ("WTFPLRef",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("MIT", ("MITTitle",)),
    ("GPL-3.0", ("GPL3Title",)),
    ("GPL-2.0", ("GPL2Title",)),
    ("LGPL-3.0", ("LGPL3Title",)),
    ("LGPL-2.1", ("LGPL21Title",)),
    ("AGPL-3.0", ("AGPL3Title",)),
    ("MPL-2.0", ("MPLTitle",)),
    ("unrecognised licence text", ("MITWarranty",)),
    ("unrecognised licence text", ("BSDGrant",)),
)
# Identifiers that SPDX tags use; a tag's other words are joined by hyphens.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL "
    "GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c Libpng MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP OFL-1.1 OSL-3.0 OpenSSL PHP-3.01 PSF-2.0 PostgreSQL Python-2.0 Ruby SSPL-1.0 Sleepycat "
    "TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 ZPL-2.1 Zlib curl Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note"
).split()
#: Each pattern above needs one of these in its sentence, so other sentences aren't looked at; words of a phrase may be on two lines.
NEEDED = ("licen", "copyright", "©", "warrant", "permission", "redistribution", "cc0", "unencumbered", "eupl")
NEEDED_PHRASES = {"neither": "neither the name", "event": "in no event", "rights": "all rights", "cc": "cc by", "creative": "creative commons", "mpl": "mpl was"}
#: Unknown sentences that may stand between two sentences of a rule, such as a copyright line.
GAP = 1

_PHRASES = {word: re.compile(r"[\W_]+".join(x.split())) for word, x in NEEDED_PHRASES.items()}


def _literals(pattern: str) -> tuple[str, ...]:
    """Plain texts one of which each match of a pattern holds."""
    left = pattern
    while (shorter := re.sub(r"\([^()]*\)\??", "\n", left)) != left:
        left = shorter
    longest = max(re.split(r"\[[^]]*\][+*?]?|\{\d+\}|\\.|.[?*]|[^a-z0-9 ]", left), key=len)
    return (longest,) if len(longest) > 2 else tuple(re.search(r"\(\?:([^()]*)\)(?!\?)", pattern)[1].split("|"))


_KNOWN = [(name, re.compile(p), _literals(p)) for name, p in SENTENCES]
#: Where such a text begins, the shortest one.
_LITERAL = re.compile("(?=(" + "|".join(sorted({re.escape(x) for _, _, found in _KNOWN for x in found}, key=len)) + "))")
#: Comment marks at the start and the end of a line; a line of marks only is an empty one.
_OPENS = re.compile(r"^[ \t]*(?:<!--|/\*+!?|\*+/|//+!?|--+|[*#;%>|]+|(?:dnl|rem)\b)*[ \t]*", re.I | re.M)
_CLOSES = re.compile(r"[ \t]*(?:\*+/|-->|[*#|]+)[ \t]*$", re.M)
#: A sentence ends at its full stop, except after a few abbreviations, and at an empty line.
_END = re.compile(r"(?<=[.!?])(?<!\bv\.)(?<!\bver\.)(?<!\binc\.)(?<!\bltd\.)(?<!\bcorp\.)(?<!\bco\.)[)\"'”’]*\s+|\n\s*\n", re.I)
#: Where a sentence without a full stop may end too; what is known decides.
_MAY_END = re.compile(r"\n|;")
#: Words of a sentence that is put together from lines; a line by itself may be longer.
JOINED_WORDS = 200
#: These don't run on over a line that starts with a capital or a digit.
ONE_LINE = ("SPDX", "Copyright")
#: An SPDX tag ends with its line.
_TAG = re.compile(r"(spdx-license-identifier:[^\n]*)\n", re.I)
_PLAIN = re.compile(r"[^\w.+©]+|_")


def _needed(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in NEEDED) or any(word in low and phrase.search(low) for word, phrase in _PHRASES.items())


def normalise(sentence: str) -> str:
    """Lower case, punctuation and comment marks as one space, no closing dots."""
    return _PLAIN.sub(" ", sentence.lower()).strip(" .+")


def identify(sentence: str) -> str | None:
    return _name(normalise(sentence))


#: Sentences without variable parts are looked up, before the patterns are tried.
_EXACT = {p: name for name, p in reversed(SENTENCES) if re.fullmatch("[a-z0-9 ]+", p)}


def _name(plain: str) -> str | None:
    if plain in _EXACT:
        return _EXACT[plain]
    for name, pattern, literals in _KNOWN:
        if any(x in plain for x in literals) and (m := pattern.fullmatch(plain)):
            return f"SPDX:{m[1].strip()}" if name == "SPDX" else name
    return None


_TAGS = {normalise(x): x for x in SPDX}


def tagged(expression: str) -> list[str]:
    """Identifiers in a normalised SPDX expression: the longest known ones, else the words up to the next operator."""
    words, out, at = expression.split(), [], 0
    while at < len(words):
        n = next((n for n in range(min(len(words) - at, 6), 0, -1) if " ".join(words[at : at + n]) in _TAGS), 0)
        if n:
            out.append(_TAGS[" ".join(words[at : at + n])])
        elif words[at] not in ("and", "or", "with"):
            n = next((k for k in range(1, len(words) - at) if words[at + k] in ("and", "or", "with")), len(words) - at)
            out.append("-".join(words[at : at + n]))
        at += max(n, 1)
    return out


def known(segment: str) -> list[str]:
    """Identifiers of the known sentences in a text without full stops, in order.

    Each is a run of lines (or of parts between semicolons); of all ways to choose them the one with
    most sentences counts, and of these the one whose sentences have most words.
    """
    raw = [x for x in _MAY_END.split(segment) if normalise(x)]
    parts = [normalise(x) for x in raw]
    runs_on = [x.lstrip()[:1].islower() for x in raw]
    words = [x.count(" ") + 1 for x in parts]
    # The first part up to which a sentence that begins with a part has what each pattern needs.
    ends = list(accumulate(len(x) + 1 for x in parts))
    enough = [len(parts)] * (len(parts) + 1)
    for m in _LITERAL.finditer(" ".join(parts)):
        at = bisect_right(ends, m.start())
        enough[at] = min(enough[at], bisect_right(ends, m.end(1) - 1))
    best: list[tuple[int, int, tuple]] = [(0, 0, ())] * (len(parts) + 1)
    for i in range(len(parts) - 1, -1, -1):
        best[i] = best[i + 1]
        enough[i] = min(enough[i], enough[i + 1])
        n, plain, one_line = 0, "", True
        for j in range(i, len(parts)):
            n += words[j]
            if j > i and n > JOINED_WORDS:
                break
            plain = f"{plain} {parts[j]}" if plain else parts[j]
            one_line &= j == i or runs_on[j]
            if j >= enough[i] and (name := _name(plain)) and (one_line or name.split(":")[0] not in ONE_LINE):
                best[i] = max(best[i], (best[j + 1][0] + 1, best[j + 1][1] + n, (name, best[j + 1][2])), key=lambda x: x[:2])
    found, rest = [], best[0][2]
    while rest:
        name, rest = rest
        found.append(name)
    return found


def scan(text: str | None) -> tuple[list[str], list[str]]:
    """Identifiers of the known sentences in order, and the licences whose rules they meet, sorted."""
    if not text or not _needed(text):
        return [], []
    found: list[tuple[int, str]] = []
    text = _CLOSES.sub("", _OPENS.sub("", text.replace("\r\n", "\n")))
    # The number of a list item is no sentence.
    segments = [x for x in _END.split(_TAG.sub(r"\1\n\n", text)) if not (plain := normalise(x)).isdigit() and plain]
    for k, segment in enumerate(segments):
        if _needed(segment):
            found += [(k, name) for name in known(segment)]
    licences, at = set(), 0
    while at < len(found):
        for licence, rule in RULES:
            part = found[at : at + len(rule)]
            if [n.split(":")[0] for _, n in part] == list(rule) and all(b[0] - a[0] <= 1 + GAP for a, b in zip(part, part[1:], strict=False)):
                licences.update(tagged(part[0][1].partition(":")[2]) if licence == "SPDX" else [licence])
                at += len(rule)
                break
        else:
            at += 1
    return [n for _, n in found], sorted(licences)


def scans(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order), licences (sorted), n_sentences and licence (the names, comma-joined) of each row.

    A narrow pass over whole texts, without a shuffle. Null and empty texts have none; repeated rows
    are scanned alike; other columns are dropped.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = [scan(t) for t in batch.column("text").to_pylist()]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], lists), pa.array([x[1] for x in found], lists)], names=["doc_id", "sentences", "licences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanned, "doc_id long, sentences array<string>, licences array<string>")
    return rows.withColumns({"n_sentences": F.size("sentences").cast("long"), "licence": F.array_join("licences", ",")})
