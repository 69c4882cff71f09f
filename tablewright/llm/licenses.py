"""License scans by ordered signature rules.

Base phrases are runs of words (letters, digits and all beyond ASCII; A-Z lowered).  On top,
signature rules run over the lowered text.  They are of two kinds: each way to name a license with
each family's names put in (36 families, 8 ways), and rules written by hand for the licenses' own
texts, titles and headers.  Words may be parted by any white space, and by comment marks after a line
end.  A rule is tried only where its keyword occurs, and a text is looked at only where some keyword
does.  Rules are ordered by priority; a detection that lies inside another of at least
its priority is suppressed, so that "the GNU Lesser General Public License" isn't also the GPL.

A null text counts as empty: no words, no labels, score 0.  Rows are independent: repeated rows give
repeated results, an empty table an empty one.  Only the id and the text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, letters_only, map_arrow, mapped, text_of

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What may stand between two words: white space, and after a line end the marks of a comment.
BLANK = "[ \\t\\r\\f\\v\xa0]"
GAP = rf"(?:{BLANK}*(?:\n[{BLANK[1:-1]}*#;/%!>|-]*)+|{BLANK}+)"

# License families.  label: (name as a pattern over lowered text, keywords of which each form holds one, SPDX names, path on a web site)
FAMILIES = {
    "mit": (r"(?:the )?(?:mit|expat)", "mit|expat", r"mit", r"opensource\.org/licenses?/mit"),
    "mit-0": (r"mit no attribution", "mit", r"mit-0", r"opensource\.org/licenses?/mit-0"),
    "apache-2": (r"(?:the )?apache(?: software)?(?: license)?,? ?(?:version |v\.? ?)?2(?:\.0)?", "apache", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    "apache-1.1": (r"(?:the )?apache(?: software)?(?: license)?,? ?(?:version |v\.? ?)?1\.1", "apache", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    "gpl-2": (r"(?:the )?(?:gnu )?(?:general public license|gpl),? ?\(?(?:version |v\.? ?)?2(?:\.0)?\)?", "general public|gpl", r"gpl-2\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    "gpl-3": (r"(?:the )?(?:gnu )?(?:general public license|gpl),? ?\(?(?:version |v\.? ?)?3(?:\.0)?\)?", "general public|gpl", r"gpl-3\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/gpl-3\.0"),
    "gpl": (r"(?:the )?(?:gnu )?(?:general public license|gpl)", "general public|gpl", r"gpl", r"gnu\.org/(?:licenses/gpl|copyleft/gpl)"),
    "lgpl-2.1": (r"(?:the )?(?:gnu )?(?:(?:lesser|library) general public license|lgpl),? ?\(?(?:version |v\.? ?)?2(?:\.[01])?\)?", "general public|lgpl", r"lgpl-2\.[01](?:-only|-or-later)?\+?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    "lgpl-3": (r"(?:the )?(?:gnu )?(?:lesser general public license|lgpl),? ?\(?(?:version |v\.? ?)?3(?:\.0)?\)?", "general public|lgpl", r"lgpl-3\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/lgpl-3\.0"),
    "lgpl": (r"(?:the )?(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", "general public|lgpl|lesser", r"lgpl", r"gnu\.org/(?:licenses/lgpl|copyleft/lesser)"),
    "agpl-3": (r"(?:the )?(?:gnu )?(?:affero general public license|agpl),? ?\(?(?:version |v\.? ?)?3(?:\.0)?\)?", "affero|agpl", r"agpl-3\.0(?:-only|-or-later)?\+?", r"gnu\.org/licenses/agpl-3\.0"),
    "agpl": (r"(?:the )?(?:gnu )?(?:affero general public license|agpl)", "affero|agpl", r"agpl", r"gnu\.org/licenses/agpl"),
    "fdl": (r"(?:the )?(?:gnu )?(?:free documentation license|gfdl)", "documentation|fdl", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    "bsd-2": (r"(?:the )?(?:bsd[- ]2|2[- ]clause bsd|simplified bsd|freebsd|two[- ]clause bsd)(?:[- ]clause)?", "bsd", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    "bsd-3": (r"(?:the )?(?:bsd[- ]3|3[- ]clause bsd|new bsd|modified bsd|three[- ]clause bsd)(?:[- ]clause)?", "bsd", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    "bsd": (r"(?:the |a )?bsd(?:[- ]style)?", "bsd", r"bsd", r"opensource\.org/licenses?/bsd"),
    "mpl-2": (r"(?:the )?(?:mozilla public license|mpl),? ?(?:version |v\.? ?)?2(?:\.0)?", "mozilla|mpl", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    "mpl-1.1": (r"(?:the )?(?:mozilla public license|mpl),? ?(?:version |v\.? ?)?1\.[01]", "mozilla|mpl", r"mpl-1\.[01]", r"mozilla\.org/mpl/mpl-1\.1"),
    "epl": (r"(?:the )?(?:eclipse public license|epl)(?:,? ?(?:version |v\.? ?)?[12](?:\.0)?)?", "eclipse|epl", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    "cddl": (r"(?:the )?(?:common development and distribution license|cddl)", "common development|cddl", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    "isc": (r"(?:the )?isc", "isc", r"isc", r"opensource\.org/licenses?/isc"),
    "zlib": (r"(?:the )?zlib(?:/libpng)?", "zlib", r"zlib", r"opensource\.org/licenses?/zlib"),
    "boost": (r"(?:the )?boost(?: software)?", "boost|bsl", r"bsl-1\.0", r"boost\.org/license_1_0"),
    "artistic": (r"(?:the )?artistic(?: license)?(?: 2(?:\.0)?)?", "artistic", r"artistic-[12]\.0", r"opensource\.org/licenses?/artistic"),
    "unlicense": (r"(?:the )?unlicense", "unlicense", r"unlicense", r"unlicense\.org"),
    "wtfpl": (r"(?:the )?wtfpl", "wtfpl", r"wtfpl", r"wtfpl\.net"),
    "eupl": (r"(?:the )?(?:european union public licen[cs]e|eupl)", "european union|eupl", r"eupl-1\.[12]", r"eupl\.eu"),
    "odbl": (r"(?:the )?(?:open database license|odbl)", "open database|odbl", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "openrail": (r"(?:the )?(?:bigscience |creativeml )?openrail(?:-m|\+\+)?", "openrail|bigscience", r"openrail", r"huggingface\.co/spaces/bigscience/license"),
    "cc0": (r"(?:the )?(?:creative commons zero|cc0)(?: 1\.0)?", "cc0|zero", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    "cc-by-nc-nd": (r"(?:the |a )?(?:cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non-?commercial[- ]no ?derivatives)(?: \d\.\d)?", "cc by|cc-by|creative", r"cc-by-nc-nd-\d\.\d", r"creativecommons\.org/licenses/by-nc-nd"),
    "cc-by-nc-sa": (r"(?:the |a )?(?:cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non-?commercial[- ]share ?alike)(?: \d\.\d)?", "cc by|cc-by|creative", r"cc-by-nc-sa-\d\.\d", r"creativecommons\.org/licenses/by-nc-sa"),
    "cc-by-nc": (r"(?:the |a )?(?:cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial)(?: \d\.\d)?", "cc by|cc-by|creative", r"cc-by-nc-\d\.\d", r"creativecommons\.org/licenses/by-nc"),
    "cc-by-nd": (r"(?:the |a )?(?:cc[- ]by[- ]nd|creative commons attribution[- ]no ?derivatives)(?: \d\.\d)?", "cc by|cc-by|creative", r"cc-by-nd-\d\.\d", r"creativecommons\.org/licenses/by-nd"),
    "cc-by-sa": (r"(?:the |a )?(?:cc[- ]by[- ]sa|creative commons attribution[- ]share ?alike)(?: \d\.\d)?", "cc by|cc-by|creative", r"cc-by-sa-\d\.\d", r"creativecommons\.org/licenses/by-sa"),
    "cc-by": (r"(?:the |a )?(?:cc[- ]by|creative commons attribution)(?: \d\.\d)?", "cc by|cc-by|creative", r"cc-by-\d\.\d", r"creativecommons\.org/licenses/by"),
}

# The ways to name a license.  NAME, SPDX and PATH stand for a family's patterns; (priority, score, keyword, pattern).
WAYS = (
    (90, 1.0, "spdx-license-identifier", r"spdx-license-identifier:\s*SPDX\b"),
    (80, 0.95, "licen", r"\blicen[cs]ed (?:to you )?under (?:the terms of )?NAME\b(?: licen[cs]e)?"),
    (80, 0.95, "under", r"\b(?:released|distributed|published|available|provided|covered) under (?:the terms of )?NAME\b(?: licen[cs]e)?"),
    (75, 0.9, "terms of", r"\b(?:subject to|under) the terms of NAME\b(?: licen[cs]e)?"),
    (70, 0.85, "://", r"https?://(?:www\.)?PATH\b"),
    (65, 0.8, "licen", r"\blicen[cs]e\s*[:=]\s*[\"']?(?:NAME|SPDX)\b"),
    (60, 0.75, "licen", r"\bNAME licen[cs]e\b"),
    (40, 0.5, "copy of", r"\bcopy of NAME\b"),
)

# Rules of no family.
LOOSE = (
    ("all-rights-reserved", 30, 0.4, "all rights reserved", r"\ball rights reserved\b"),
    ("public-domain", 50, 0.6, "public domain", r"\b(?:released|dedicated|placed) (?:in)?to the public domain\b"),
    ("proprietary", 50, 0.6, "proprietary", r"\bproprietary and confidential\b"),
)


# The licenses' own texts, titles and headers.  (label, priority, score, keyword, pattern); what is read further has the higher priority.
BSD = r"redistribution and use in source and binary forms,? with or without modification,? (?:are|is) permitted"
GRANT = r"permission to use, copy, modify,? and(?:/or|or)? distribute this software"
FSF = r"(?:(?:licen[cs]ed|released|distributed|published|available|provided|covered) )?(?:under )?(?:the )?(?:terms of )?(?:the )?(?:gnu )?"
EITHER = r"(?:,? version \d(?:\.\d)?,?)? as published by the free software foundation[;,.:]? (?:either |in )?version "
TEXTS = (
    ("mit", 92, 1.0, "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-0", 94, 1.0, "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files[\s\S]{0,400}?furnished to do so\.\W{0,40}the software is provided"),
    ("boost", 92, 1.0, "free of charge", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", 94, 1.0, "hereby granted", GRANT + r" for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 92, 1.0, "hereby granted", GRANT + r" for any purpose with or without fee is hereby granted\.\W{0,40}the software is provided"),
    ("hpnd", 92, 0.95, "hereby granted", GRANT + r" and its documentation (?:for any purpose|for any purpose and without fee|for any purpose, without fee|for any purpose, without fee, and without a written agreement) is hereby granted"),
    ("bsd", 92, 0.95, "redistribution and use", BSD),
    ("bsd-2", 94, 1.0, "redistribution and use", BSD + r"[\s\S]{0,900}?provided with the distribution[.;]\W{0,40}this software is provided"),
    ("bsd-3", 94, 1.0, "redistribution and use", BSD + r"[\s\S]{0,1200}?(?:neither the names? of|names? of [^.]{1,200} may not be used to endorse)"),
    ("bsd-4", 96, 1.0, "redistribution and use", BSD + r"[\s\S]{0,1200}?all advertising materials mentioning features[\s\S]{0,500}?(?:neither the names? of|names? of [^.]{1,200} may not be used to endorse)"),
    ("apache-2", 92, 1.0, "january 2004", r"apache license,? version 2\.0, january 2004"),
    ("apache-2", 92, 1.0, "apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("gpl-2", 92, 1.0, "june 1991", r"gnu general public license,? version 2, june 1991"),
    ("gpl-3", 92, 1.0, "june 2007", r"gnu general public license,? version 3, 29 june 2007"),
    ("lgpl-2.1", 92, 1.0, "june 1991", r"gnu library general public license,? version 2, june 1991"),
    ("lgpl-2.1", 92, 1.0, "february 1999", r"gnu lesser general public license,? version 2\.1, february 1999"),
    ("lgpl-3", 92, 1.0, "june 2007", r"gnu lesser general public license,? version 3, 29 june 2007"),
    ("agpl-3", 92, 1.0, "november 2007", r"gnu affero general public license,? version 3, 19 november 2007"),
    ("fdl", 92, 1.0, "free documentation", r"gnu free documentation license,? version 1\.[123], \d{0,2} ?(?:march|november) \d{4}"),
    ("fdl", 92, 1.0, "free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gpl-2", 92, 1.0, "free software foundation", FSF + r"general public license" + EITHER + r"2\b"),
    ("gpl-3", 92, 1.0, "free software foundation", FSF + r"general public license" + EITHER + r"3\b"),
    ("lgpl-2.1", 92, 1.0, "free software foundation", FSF + r"(?:lesser|library) general public license" + EITHER + r"2(?:\.[01])?\b"),
    ("lgpl-3", 92, 1.0, "free software foundation", FSF + r"lesser general public license" + EITHER + r"3\b"),
    ("agpl-3", 92, 1.0, "free software foundation", FSF + r"affero general public license" + EITHER + r"3\b"),
    ("mpl-2", 92, 1.0, "source code form", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-1.1", 92, 1.0, "mozilla", r"the contents of this file are subject to the (?:terms of the )?(?:mozilla public license|mpl),? (?:version )?1\.[01]"),
    ("epl", 92, 1.0, "eclipse", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl", 92, 1.0, "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", 92, 1.0, "held liable", r"this software is provided ['‘\"“`]?as[- ]is['’\"”`]*,? without any express or implied warranty\. in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("unlicense", 92, 1.0, "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 92, 1.0, "do what the fuck", r"do what the fuck you want to(?: public license)?"),
    ("artistic", 92, 1.0, "a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 92, 1.0, "free software package", r"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed"),
    ("cc0", 92, 1.0, "affirmer hereby", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc0", 92, 1.0, "dedicated the work", r"has dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("eupl", 92, 1.0, "european union", r"this european union public licen[cs]e \(the ['‘\"“]?eupl['’\"”]?\) applies to the work"),
    ("odbl", 92, 1.0, "open database", r"the open database license \(odbl\) is a license agreement intended to allow users"),
    *(
        (label, 92, 1.0, "attribution", rf"(?<![a-z]-)(?:(?:creative commons|cc) )?\battribution{rest} \d\.\d (?:international|unported|generic)(?: (?:public )?licen[cs]e)?")
        for label, rest in (("cc-by-nc-nd", r"[- ]non-?commercial[- ]no ?deriv(?:ative)?s"), ("cc-by-nc-sa", r"[- ]non-?commercial[- ]share ?alike"), ("cc-by-nc", r"[- ]non-?commercial"), ("cc-by-nd", r"[- ]no ?deriv(?:ative)?s"), ("cc-by-sa", r"[- ]share ?alike"), ("cc-by", ""))
    ),
)


def worded(pattern: str) -> re.Pattern:
    """The pattern with every space, also those it only allows, standing for any gap between words."""
    return re.compile(pattern.replace("[- ]", "(?:-| )").replace(" ", GAP))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    keyword: str
    #: One of these must occur as well, if there are any.
    family: tuple[str, ...]
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, the first to be tried first; the later families of a kind have the shorter names."""
    found = [Rule(label, p, s, k, tuple(words.split("|")), worded(w.replace("NAME", f"(?:{name})").replace("SPDX", f"(?:{spdx})").replace("PATH", f"(?:{path})"))) for label, (name, words, spdx, path) in FAMILIES.items() for p, s, k, w in WAYS]
    found += [Rule(label, p, s, k, (), worded(w)) for label, p, s, k, w in (*TEXTS, *LOOSE)]
    return sorted(found, key=lambda r: -r.priority)


RULES = rules()
KEYWORDS = frozenset(k for r in RULES for k in (r.keyword, *r.family))
EVEN = re.compile(GAP)
#: A text without any of these has no detection.
ANY_KEYWORD = "|".join(["licen|spdx|all rights reserved|public domain|proprietary|://|copy of|terms of|(released|distributed|published|available|provided|covered) under", *sorted({k for _, _, _, k, _ in TEXTS})]).replace(" ", GAP)
WORD_BYTE = rb"[0-9a-z\x80-\xff]"
BETWEEN = rb"[^0-9a-z\x80-\xff]+"
BASE = {label: re.compile(rb"(?<!" + WORD_BYTE + rb")" + BETWEEN.join(w.encode() for w in phrase.split()) + rb"(?!" + WORD_BYTE + rb")") for phrase, label in PHRASES.items()}
#: Words that each base phrase holds, for a cheap test.
ANY_PHRASE = "license|by[^0-9a-z]+nc"


def detect(text: str) -> list[tuple[int, int, Rule]]:
    """Detections in a lowered text that no other of at least their priority contains, by start."""
    even = EVEN.sub(" ", text)
    present = {k for k in KEYWORDS if k in even}
    tried = ((n, r) for n, r in enumerate(RULES) if r.keyword in present and (not r.family or not present.isdisjoint(r.family)))
    found = [(m.start(), m.end(), n, r) for n, r in tried for m in r.pattern.finditer(text)]
    # widest first, then highest priority, then rule order: what contains comes before what it contains
    found.sort(key=lambda x: (x[0], -x[1], -x[3].priority, x[2]))
    kept: list[tuple[int, int, Rule]] = []
    reach: dict[int, int] = {}  # by priority: how far the kept detections of it go
    for start, end, _, r in found:
        if not any(e >= end for p, e in reach.items() if p >= r.priority):
            kept.append((start, end, r))
            reach[r.priority] = max(end, reach.get(r.priority, 0))
    return kept


def scan_licenses(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """For each row: words, base places, first and last base word, base labels, all labels, score, and the detections' spans."""
    word_table = letters_only()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lowered = mapped(part.column("text"), LOWER)
        n = len(lowered)
        offsets = np.frombuffer(lowered.buffers()[1], np.int64)[: n + 1]
        data = np.frombuffer(lowered.buffers()[2].to_pybytes().translate(word_table), np.uint8)
        inside = np.concatenate([[False], data != 0x20, [False]])
        starts = inside[1:-1] & ~inside[:-2]
        borders = offsets[:-1][np.diff(offsets) > 0]
        starts[borders] = inside[1:-1][borders]  # words end with their text
        before = np.concatenate([[0], np.cumsum(starts)])
        n_words = before[offsets[1:]] - before[offsets[:-1]]
        n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
        base_labels, labels, score, spans = [""] * n, [""] * n, np.zeros(n), [""] * n
        maybe = pc.match_substring_regex(lowered, f"{ANY_KEYWORD}|{ANY_PHRASE}")
        for i in np.flatnonzero(np.asarray(maybe)).tolist():
            text = lowered[i].as_py()
            raw = text.encode()
            places = [(int(before[offsets[i] + m.start()] - before[offsets[i]]), label) for label, p in BASE.items() for m in p.finditer(raw)]
            found = detect(text)
            base = {label for _, label in places}
            if places:
                n_base[i], first[i], last[i] = len(places), min(places)[0], max(places)[0]
            base_labels[i] = ",".join(sorted(base))
            labels[i] = ",".join(sorted(base | {r.label for _, _, r in found}))
            score[i] = max([r.score for _, _, r in found] + [0.9] * bool(base), default=0.0)
            spans[i] = ",".join(f"{r.label}:{a}:{b}" for a, b, r in found)
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score), pa.array(spans, pa.string())],
            ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return map_arrow(docs.select(F.col(id_column).alias("id"), text_of().alias("text")), run, schema).withColumnRenamed("id", id_column)
