"""License scans by ordered signature rules.

Each rule is a regular expression with a label, a priority and keywords, single words that each of its
matches holds; a rule runs only on texts that hold all of them. Rules are the words of the licenses' notices,
headers and warranty clauses and their addresses, and the forms in which texts name a license. Where detections
overlap, those of higher priority win, then longer ones; a
detection inside the interval of a kept one, or overlapping one of its own label, is suppressed. A text that says
it is not under a license is a detection too, of no label: it suppresses what it holds.
Three base phrases are counted word by word whatever the rules say.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Label | keyword | the names by which a text calls the license, as patterns between
# words (a blank stands for what separates words) | SPDX identifiers.
LICENSES = r"""
mit | mit | mit;expat | MIT
apache-2 | apache | apache (?:software )?(?:license )?(?:version |v )?2(?: 0)?;asl 2(?: 0)? | Apache-2.0
apache-1.1 | apache | apache (?:software )?(?:license )?(?:version |v )?1 1 | Apache-1.1
bsd-2-clause | bsd | bsd 2 clause;2 clause bsd;simplified bsd;freebsd | BSD-2-Clause
bsd-3-clause | bsd | bsd 3 clause;3 clause bsd;new bsd;modified bsd | BSD-3-Clause
bsd-4-clause | bsd | bsd 4 clause;4 clause bsd;original bsd | BSD-4-Clause
0bsd | bsd | zero clause bsd;bsd zero clause;0bsd | 0BSD
isc | isc | isc | ISC
zlib | zlib | zlib;zlib libpng | Zlib
boost-1 | boost | boost software(?: license)?(?: version)?(?: 1(?: 0)?)? | BSL-1.0
unlicense | unlicense | unlicense | Unlicense
wtfpl | wtfpl | wtfpl;do what the f\w* you want to public license | WTFPL
gpl-2 | gpl | gpl(?: version)?(?: v)? ?2(?: 0)?;gplv2 | GPL-2.0-only;GPL-2.0-or-later;GPL-2.0
gpl-3 | gpl | gpl(?: version)?(?: v)? ?3(?: 0)?;gplv3 | GPL-3.0-only;GPL-3.0-or-later;GPL-3.0
gpl-2 | general public | gnu general public license(?: as published by the free software foundation)?,? (?:either )?(?:version|v) ?2 |
gpl-3 | general public | gnu general public license(?: as published by the free software foundation)?,? (?:either )?(?:version|v) ?3 |
lgpl-2.1 | lgpl | lgpl(?: version)?(?: v)? ?2 1;lgplv2 1 | LGPL-2.1-only;LGPL-2.1-or-later;LGPL-2.1
lgpl-3 | lgpl | lgpl(?: version)?(?: v)? ?3(?: 0)?;lgplv3 | LGPL-3.0-only;LGPL-3.0-or-later;LGPL-3.0
lgpl-2.1 | lesser general | gnu lesser general public license,? (?:version|v) ?2 1 |
lgpl-3 | lesser general | gnu lesser general public license,? (?:version|v) ?3 |
agpl-3 | agpl | agpl(?: version)?(?: v)? ?3(?: 0)?;agplv3 | AGPL-3.0-only;AGPL-3.0-or-later;AGPL-3.0
agpl-3 | affero | gnu affero general public license(?:,? (?:version|v) ?3)? |
mpl-1.1 | mozilla | mozilla public(?: license)?(?: version)?(?: v)? 1 1 | MPL-1.1
mpl-2 | mozilla | mozilla public(?: license)?(?: version)?(?: v)? 2(?: 0)? | MPL-2.0
epl-1 | eclipse | eclipse public(?: license)?(?: version)?(?: v)? 1(?: 0)? | EPL-1.0
epl-2 | eclipse | eclipse public(?: license)?(?: version)?(?: v)? 2(?: 0)? | EPL-2.0
cddl-1 | cddl | cddl(?: 1(?: 0)?)? | CDDL-1.0
artistic-2 | artistic | artistic(?: license)? 2(?: 0)? | Artistic-2.0
psf-2 | python software foundation | python software foundation(?: license)?(?: version)?(?: 2)? | PSF-2.0
ofl-1.1 | open font | sil open font(?: license)?(?: version)?(?: 1 1)? | OFL-1.1
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)? | CC0-1.0
cc-by | cc | cc by(?: [1-4] \d)?(?! (?:nc|sa|nd)\b) | CC-BY-4.0;CC-BY-3.0
cc-by-sa | cc | cc by sa(?: [1-4] \d)? | CC-BY-SA-4.0;CC-BY-SA-3.0
cc-by-nd | cc | cc by nd(?: [1-4] \d)? | CC-BY-ND-4.0
cc-by-nc | cc | cc by nc(?: [1-4] \d)?(?! (?:sa|nd)\b) | CC-BY-NC-4.0;CC-BY-NC-3.0
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] \d)? | CC-BY-NC-SA-4.0
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] \d)? | CC-BY-NC-ND-4.0
cc-by | creative commons | creative commons attribution(?: [1-4] \d)?(?! (?:non ?commercial|share ?alike|no ?deriv)) |
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] \d)? |
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] \d)?(?! (?:share ?alike|no ?deriv)) |
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] \d)? |
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv\w*(?: [1-4] \d)? |
cc0-1 | public domain | public domain dedication |
odbl-1 | open database | open (?:data commons )?(?:open )?database(?: license)? | ODbL-1.0
eupl-1.2 | european union public | european union public(?: licen[cs]e)?(?:,? (?:version|v)? ?1 2)? | EUPL-1.2
ms-pl | microsoft public | microsoft public | MS-PL
all-rights-reserved | rights reserved | all rights reserved |
proprietary | proprietary | proprietary and confidential;proprietary software |
"""

# Name, priority, confidence and pattern of the forms; NAME and ID are filled in.
FORMS = r"""
negated | 99 | 0 | (?:not|never|no longer)(?:_|[^\w.!?])+(?:\w+(?:_|[^\w.!?])+){0,4}?(?:under|with|by|per)(?:_|[^\w.!?])+(?:the terms (?:and conditions )?of )?(?:an? |the )?NAME(?: licen[cs]es?)?
terms | 80 | 0.95 | (?:under|subject to|per) the (?:terms (?:and conditions )?of )?(?:the )?NAME(?: licen[cs]es?)?
licensed | 75 | 0.95 | (?:licen[cs]ed|released|distributed|available|published|provided) (?:\w+ ){0,3}?(?:under|with|by) (?:an? |the )?NAME(?: licen[cs]es?)?
header | 70 | 0.9 | licen[cs]e (?:is )?(?:the )?NAME\b
license | 60 | 0.85 | NAME licen[cs]es?
dual | 55 | 0.8 | dual licen[cs]ed (?:\w+ ){0,4}?NAME
compatible | 30 | 0.4 | NAME compatible
"""
# Label | keywords | priority | confidence | the words of notices, headers, warranty
# clauses and addresses, as above.
NOTICES = r"""
mit | hereby granted obtaining | 95 | 1 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | notice substantial portions | 92 | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | warranty noninfringement | 85 | 0.8 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | opensource licenses mit | 88 | 0.95 | opensource org licenses mit(?: license)?
isc | hereby granted provided | 95 | 1 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc | opensource licenses isc | 88 | 0.95 | opensource org licenses isc(?: license)?
0bsd | hereby granted | 94 | 0.95 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)
bsd-2-clause | redistributions following disclaimer | 90 | 0.7 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | neither endorse | 93 | 0.95 | neither the name of (?:\w+ ){1,12}?nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising acknowledgement | 94 | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | redistribution binary permitted | 91 | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
bsd | implied warranties | 85 | 0.8 | this software is provided by the (?:copyright holders|regents|authors?)(?: and contributors)? as is and any express or implied warranties
bsd-2-clause | opensource bsd | 88 | 0.95 | opensource org licenses bsd 2 clause
bsd-3-clause | opensource bsd | 88 | 0.95 | opensource org licenses bsd 3 clause
apache-2 | apache compliance | 95 | 1 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | unless applicable | 90 | 0.85 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | apache licenses | 88 | 0.95 | (?:www )?apache org licenses license 2 0(?: txt| html)?
gpl-2 | redistribute published foundation | 96 | 1 | this (?:program|software|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-3 | redistribute published foundation | 96 | 1 | this (?:program|software|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-2 | redistribute published version | 95 | 1 | under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2) as published by the free software foundation
gpl | hope merchantability | 85 | 0.8 | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | received general along | 86 | 0.85 | you should have received a copy of the gnu general public license along with
gpl-2 | gnu licenses gpl | 88 | 0.95 | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3 | gnu licenses gpl | 88 | 0.95 | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
lgpl-2.1 | redistribute lesser foundation | 96 | 1 | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version 2(?: 1)?
lgpl-3 | redistribute lesser foundation | 96 | 1 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl | received lesser along | 86 | 0.85 | you should have received a copy of the gnu lesser general public license along with
lgpl-2.1 | gnu licenses lgpl | 88 | 0.95 | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3 | gnu licenses lgpl | 88 | 0.95 | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
agpl-3 | redistribute affero foundation | 96 | 1 | under the terms of the gnu affero general public license as published by the free software foundation either version 3
agpl-3 | received affero along | 86 | 0.9 | you should have received a copy of the gnu affero general public license along with
agpl-3 | gnu licenses agpl | 88 | 0.95 | (?:www )?gnu org licenses agpl 3 0(?: html| txt)?
mpl-2 | mozilla source form | 96 | 1 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | mpl distributed obtain | 90 | 0.95 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla contents subject | 96 | 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2 | mozilla mpl | 88 | 0.95 | mozilla org (?:en us )?mpl 2 0
epl-1 | eclipse accompanying materials | 96 | 1 | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2 | eclipse accompanying materials | 96 | 1 | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0
epl-2 | eclipse legal epl | 88 | 0.95 | eclipse org legal epl (?:v ?20|2 0)
cddl-1 | development distribution cddl | 95 | 0.95 | subject to the terms of the common development and distribution license
zlib | authors liable damages | 95 | 0.95 | in no event will the authors be held liable for any damages arising from the use of this software
zlib | altered misrepresented | 93 | 0.95 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1 | hereby granted organization | 95 | 1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost-1 | boost license | 88 | 0.95 | boost org license 1 0(?: txt)?
unlicense | unencumbered | 95 | 1 | this is free and unencumbered software released into the public domain
unlicense | anyone compile sell | 90 | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | wtfpl | 88 | 0.95 | (?:www )?wtfpl net
cc0-1 | dedicated deed | 95 | 0.95 | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1 | extent waived | 93 | 0.9 | to the extent possible under law (?:\w+ ){1,12}?(?:has|have) waived all copyright and related or neighboring rights
cc0-1 | creativecommons publicdomain | 88 | 0.95 | creativecommons org publicdomain zero 1 0
cc-by | creativecommons licenses | 88 | 0.95 | creativecommons org licenses by [1-4] \d
cc-by-sa | creativecommons licenses | 88 | 0.95 | creativecommons org licenses by sa [1-4] \d
cc-by-nd | creativecommons licenses | 88 | 0.95 | creativecommons org licenses by nd [1-4] \d
cc-by-nc | creativecommons licenses | 88 | 0.95 | creativecommons org licenses by nc [1-4] \d
cc-by-nc-sa | creativecommons licenses | 88 | 0.95 | creativecommons org licenses by nc sa [1-4] \d
cc-by-nc-nd | creativecommons licenses | 88 | 0.95 | creativecommons org licenses by nc nd [1-4] \d
ofl-1.1 | font sil | 95 | 1 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | sil ofl | 88 | 0.95 | scripts sil org ofl
odbl-1 | opendatacommons odbl | 88 | 0.95 | opendatacommons org licenses odbl(?: 1 0)?
psf-2 | psf agreement | 90 | 0.9 | psf license agreement
proprietary | unauthorized copying prohibited | 95 | 0.95 | unauthorized copying of this file via any medium is strictly prohibited
proprietary | confidential proprietary information | 93 | 0.95 | this software is the confidential and proprietary information of
all-rights-reserved | reproduced permission | 80 | 0.7 | no part of this (?:publication|document|work|book|software) may be reproduced (?:\w+ ){0,20}?without (?:the )?(?:prior )?written permission
"""
#: Keywords that are whole words in every match; others may be parts of words, as in "gplv3".
WHOLE = frozenset({"cc", "isc", "mit"})
#: Of these a bare name is a detection too: nothing else is called so.
PLAIN = {"agpl-3", "apache-1.1", "apache-2", "all-rights-reserved", "artistic-2", "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0-1", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "mpl-1.1", "mpl-2", "proprietary", "wtfpl"}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keywords: frozenset[str]
    pattern: str


def _keywords(name: str, keyword: str) -> frozenset[str]:
    """The words of a row's keyword that each match of a name holds as they stand; if none, the longest it holds."""
    shown = None
    while shown != name:  # groups may be optional, alternatives or looked ahead
        shown, name = name, re.sub(r"\([^()]*\)\??", " ", name)
    held = re.findall(r"[a-z0-9]+", re.sub(r"\[[^]]*\]|\\.|.\?", " ", name))
    return frozenset(set(keyword.split()) & set(held) or {max(held, key=len)})


def _spaced(pattern: str) -> str:
    """The pattern between words: a blank is a run of what parts words, \\w a letter or digit.

    The underscore parts words. No character is in both classes, so there is one way to cut a run of either, and none is tried again.
    """
    apart = re.sub(r"(?<!\[\^) ", r"[\\W_]+", pattern).replace(r"[\W_]+?", r"[\W_]*")
    return r"(?<![^\W_])" + re.sub(r"(?<!\[\^)\\w", r"[^\\W_]", apart) + r"(?![^\W_])"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first: the forms for every name, and tags for every identifier."""
    out = []
    forms = [[x.strip() for x in line.split(" | ")] for line in FORMS.strip().splitlines()]
    for line in LICENSES.strip().splitlines():
        label, keyword, names, ids = _cells(line)
        for k, name in enumerate(n for n in names.split(";") if n):
            held = _keywords(name, keyword)
            for form, priority, confidence, pattern in forms:
                out.append(Rule(f"{label}:{keyword}:{k}:{form}", label if float(confidence) else "", int(priority), float(confidence), held, _spaced(pattern.replace("NAME", f"(?:{name})"))))
            if label in PLAIN:
                out.append(Rule(f"{label}:{keyword}:{k}:plain", label, 40, 0.7, held, _spaced(f"(?:{name})")))
        for spdx in (i for i in ids.split(";") if i):
            out.append(Rule(f"{label}:spdx:{spdx}", label, 90, 1.0, frozenset({"spdx"}), r"spdx-license-identifier:\s*\(?" + re.escape(spdx.lower()) + r"(?![\w.-])"))
            out.append(Rule(f"{label}:id:{spdx}", label, 65, 0.9, frozenset({"licen"}), r"\"?licen[cs]e\"?\s*[:=]\s*\"?" + re.escape(spdx.lower()) + r"(?![\w.-])"))
    for k, line in enumerate(NOTICES.strip().splitlines()):
        label, keywords, priority, confidence, pattern = _cells(line)
        held = frozenset(w for w in keywords.split() if re.search(rf"\b{w}\b", re.sub(r"\([^()]*\)\??", " ", pattern)))
        out.append(Rule(f"{label}:notice:{k}", label, int(priority), float(confidence), held, _spaced(pattern)))
    return tuple(sorted(out, key=lambda r: (-r.priority, r.name)))


def _cells(line: str) -> list[str]:
    """Cells of a line whose patterns hold bars: the bars between cells have blanks around them."""
    cells = [c.strip() for c in re.split(r" \|(?: |$)", line)]
    return cells + [""] * (4 - len(cells))


@lru_cache(maxsize=1)
def _gates():
    import ahocorasick

    by_keywords: dict[frozenset[str], list[Rule]] = {}
    for r in rules():
        by_keywords.setdefault(r.keywords, []).append(r)
    automaton = ahocorasick.Automaton()
    for k in frozenset().union(*by_keywords):
        automaton.add_word(k, k)
    automaton.make_automaton()
    return automaton, by_keywords


def _due(low: str) -> Iterator[Rule]:
    """The rules whose keywords a text in lower case holds."""
    automaton, by_keywords = _gates()
    held = {k for end, k in automaton.iter(low) if k not in WHOLE or not (low[end + 1 : end + 2].isalnum() or low[max(end - len(k), 0) : end - len(k) + 1].isalnum())}
    for keywords, own in by_keywords.items():
        if keywords <= held:
            yield from own


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PHRASES = [(re.compile(b"(?<![^ ])" + b" +".join(w.encode() for w in p.split()) + b"(?![^ ])"), p.split()[-2].encode(), label) for p, label in BASE]


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (first word, label) of each place of a base phrase."""
    data = text.encode("utf-8", "surrogatepass").translate(_NORMAL)
    inside = np.frombuffer(data, dtype=np.uint8) != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts, places = np.flatnonzero(begins), []
    for pattern, rare, label in _PHRASES:
        if rare in data:
            found = np.array([m.start() for m in pattern.finditer(data)], dtype=np.int64)
            places += [(int(k), label) for k in np.searchsorted(starts, found)]
    return len(starts), sorted(places)


def unsuppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Those of the detections that no kept one suppresses, by priority, then length, then place.

    Kept ones of one label don't overlap, so per label only the last one that begins before a
    detection's end can hold or overlap it.
    """
    kept: dict[str, list[tuple[int, int, Rule]]] = {}

    def free(start: int, end: int, label: str) -> bool:
        for own, held in kept.items():
            at = bisect_right(held, start, key=lambda d: d[0]) - 1
            if at >= 0 and end <= held[at][1]:
                return False
            if own == label and (at >= 0 and start < held[at][1] or at + 1 < len(held) and held[at + 1][0] < end):
                return False
        return True

    for start, end, r in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name)):
        if free(start, end, r.label):
            insort(kept.setdefault(r.label, []), (start, end, r), key=lambda d: d[0])
    return sorted((d for held in kept.values() for d in held), key=lambda d: (d[0], d[1], d[2].name))


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """Kept detections (start, end, rule) in order of place; those of negated licenses have no label and are left out."""
    low = lowered(text)
    found = []
    for r in _due(low):
        found += [(m.start(), m.end(), r) for m in _compiled(r.pattern).finditer(low) if m.end() > m.start()]
    return [d for d in unsuppressed(found) if d[2].label]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, base (places: word, label), detections: a row for each row of docs.

    Whole texts are scanned; null ones are empty. Detections hold start and end (code points, to
    excluded), label, rule and confidence.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                n, places = base_places(t)
                own = [{"start": a, "end": b, "label": r.label, "rule": r.name, "confidence": r.confidence} for a, b, r in detections(t)]
                out.append((k, n, [{"word": w, "label": x} for w, x in places], own))
            yield pd.DataFrame(out, columns=["key", "n_words", "base", "detections"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.mapInPandas(run, f"key {kind}, n_words long, base array<struct<word:long,label:string>>, detections array<struct<start:int,end:int,label:string,rule:string,confidence:double>>")
    return found.withColumnRenamed("key", key)


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    base = F.transform("base", lambda p: p["label"])
    added = F.transform("detections", lambda d: d["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    sure = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, added)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(sure, F.lit(0.0))).alias("score"),
    )
