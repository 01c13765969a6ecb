"""Operator 9: license scans by sentence-rule recognition.  DataFrame functions only.

A text is lower-cased and keeps its letters and digits, single-spaced, with
marks for stops (``. ! ? ;`` before white space) and for line breaks (with the
comment signs that follow).  Known license sentences have identifiers.  One is
found where its words stand between two marks; line breaks within it, blank
lines too, are white space, as wrapped texts have them, while a stop must be
one of its own.  Of several that begin at a mark, the longest counts.  A slot
(``{}``) in a sentence takes one to ``SLOT`` words: a holder, an organisation.

Licenses are also named inside sentences: after ``licensed under`` and its like
(``NAMING``, unless after ``not``) and in SPDX lines, every name up to the next
stop (in SPDX lines, the line's end), of at most ``NAMED`` words, counts as a
sentence of its own (``NAMES``); a name of a version goes before one without.

A document's known sentences, in order, give its identifier sequence, and
licenses are rules over it: ordered identifier lists that must occur in a row
(sentences that aren't known don't break a row).  A rule that lies inside another
matched rule's row gives way to it, so a whole text isn't also reported by a part
of it: the two-clause BSD text stands only where no third clause follows.

Only documents with a word that some known sentence needs are looked at (every
known sentence has one of ``TRIGGERS``, which is checked on import), and nothing
is shuffled.  The two tables are the fixed ones below.

Edge cases: null and empty texts have no license; repeated rows get equal results; a
sentence that occurs twice counts twice in the sequence, the license once; an
empty table gives an empty result.  Only ``text`` is read; other columns pass
through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Identifier -> sentence, as licenses and their notices have them.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    3: "you may not use this file except in compliance with the License",
    4: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    5: "See the License for the specific language governing permissions and limitations under the License",
    6: "Released under the MIT License",
    7: "Licensed under the MIT License",
    8: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    9: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    10: "This work is licensed under the GNU General Public License, version 3",
    11: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    12: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    13: "You should have received a copy of the GNU General Public License along with this program",
    14: "Licensed under CC BY-NC 4.0",
    15: "Licensed under CC BY 4.0",
    16: "Licensed under CC BY-SA 4.0",
    17: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    18: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    19: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    20: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    21: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    22: "Neither the name of {} nor the names of {} contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    23: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    24: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    25: "This is free and unencumbered software released into the public domain",
    26: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    27: "Licensed under the BSD 3-Clause License",
    28: "Licensed under the BSD 2-Clause License",
    29: "This work is licensed under the GNU General Public License, version 2",
    30: "This work is licensed under the GNU Lesser General Public License, version 3",
    31: "All rights reserved",
    32: "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission",
    33: "The names of {} may not be used to endorse or promote products derived from this software without specific prior written permission",
    34: "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {}",
    35: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    36: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    37: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    38: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    39: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    40: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    41: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    42: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    43: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at {}",
    44: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {}",
    45: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}",
}
#: Identifier -> (license, wordings of its name).  The license's own
#: identifier, in words, is a name of it as well.
NAMES = {
    101: ("MIT", ["mit license", "mit licence", "expat license", "mit"]),
    102: ("Apache-2.0", ["apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache software license version 2 0", "apache software license 2 0",
                         "apache public license 2 0", "apache licence version 2 0", "apache licence 2 0", "apache license v2", "apache v2", "apache license", "apache licence"]),
    103: ("BSD-2-Clause", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd two clause license", "two clause bsd license"]),
    104: ("BSD-3-Clause", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd three clause license", "three clause bsd license"]),
    105: ("GPL-2.0-only", ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl v2", "gpl version 2", "gpl 2 0"]),
    106: ("GPL-2.0-or-later", ["gnu general public license version 2 or any later version", "gnu general public license version 2 or later", "gnu general public license v2 or later",
                               "gnu gpl version 2 or later", "gplv2 or later", "gpl version 2 or later", "gpl v2 or later"]),
    107: ("GPL-3.0-only", ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl v3", "gpl version 3", "gpl 3 0"]),
    108: ("GPL-3.0-or-later", ["gnu general public license version 3 or any later version", "gnu general public license version 3 or later", "gnu general public license v3 or later",
                               "gnu gpl version 3 or later", "gplv3 or later", "gpl version 3 or later", "gpl v3 or later"]),
    109: ("LGPL-2.1-only", ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1"]),
    110: ("LGPL-2.1-or-later", ["gnu lesser general public license version 2 1 or any later version", "gnu lesser general public license version 2 1 or later", "lgplv2 1 or later"]),
    111: ("LGPL-3.0-only", ["gnu lesser general public license version 3", "gnu lesser general public license v3", "lgplv3", "lgpl v3", "lgpl 3 0"]),
    112: ("LGPL-3.0-or-later", ["gnu lesser general public license version 3 or any later version", "gnu lesser general public license version 3 or later", "lgplv3 or later"]),
    113: ("AGPL-3.0-only", ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "agplv3", "agpl v3", "agpl 3 0"]),
    114: ("AGPL-3.0-or-later", ["gnu affero general public license version 3 or any later version", "gnu affero general public license version 3 or later", "agplv3 or later"]),
    115: ("MPL-2.0", ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0"]),
    116: ("EPL-1.0", ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0"]),
    117: ("EPL-2.0", ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license v2 0", "eclipse public license 2 0"]),
    118: ("ISC", ["isc license", "isc licence"]),
    119: ("Zlib", ["zlib license", "zlib libpng license"]),
    120: ("BSL-1.0", ["boost software license version 1 0", "boost software license 1 0", "boost software license"]),
    121: ("0BSD", ["zero clause bsd license", "bsd zero clause license"]),
    122: ("Unlicense", ["unlicense"]),
    123: ("CC0-1.0", ["cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0 license"]),
    124: ("CC-BY-4.0", ["creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"]),
    125: ("CC-BY-SA-4.0", ["creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international"]),
    126: ("CC-BY-NC-4.0", ["creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international"]),
}
#: What a license is named after, in words.
NAMING = ("licensed under", "licenced under", "released under", "distributed under", "available under", "provided under", "published under", "covered by", "governed by")
SPDX = "spdx license identifier"
SLOT, NAMED = 12, 60
#: Fixed values: (license, identifiers in order).
RULES = [
    ("Apache-2.0", (1,)), ("Apache-2.0", (2,)), ("Apache-2.0", (4,)), ("Apache-2.0", (2, 3, 4, 5)), ("Apache-2.0", (2, 3, 4)), ("Apache-2.0", (2, 3)),
    ("MIT", (6,)), ("MIT", (7,)), ("MIT", (8, 9)), ("MIT", (8,)),
    ("GPL-3.0-only", (10,)), ("GPL-3.0-or-later", (11,)), ("GPL-3.0-or-later", (11, 13)), ("GPL-2.0-only", (29,)),
    ("GPL-2.0-or-later", (12,)), ("GPL-2.0-or-later", (12, 13)), ("LGPL-3.0-only", (30,)),
    ("CC-BY-NC-4.0", (14,)), ("CC-BY-NC-4.0", (19,)), ("CC-BY-4.0", (15,)), ("CC-BY-4.0", (17,)), ("CC-BY-SA-4.0", (16,)), ("CC-BY-SA-4.0", (18,)),
    ("BSD-3-Clause", (20, 21, 22)), ("BSD-3-Clause", (20, 21, 32)), ("BSD-3-Clause", (20, 21, 33)), ("BSD-2-Clause", (20, 21)),
    ("BSD-4-Clause", (20, 21, 34, 22)), ("BSD-4-Clause", (20, 21, 34, 32)), ("BSD-4-Clause", (20, 21, 34)), ("BSD-3-Clause", (27,)), ("BSD-2-Clause", (28,)),
    ("ISC", (23,)), ("0BSD", (35,)), ("MPL-2.0", (24,)), ("MPL-2.0", (45,)), ("Unlicense", (25,)), ("CC0-1.0", (26,)), ("all-rights-reserved", (31,)),
    ("LGPL-2.1-or-later", (36,)), ("GPL-2.0-only", (37,)), ("GPL-2.0-only", (38,)), ("AGPL-3.0-or-later", (39,)), ("LGPL-3.0-or-later", (40,)),
    ("Zlib", (41,)), ("BSL-1.0", (42,)), ("EPL-1.0", (43,)), ("EPL-2.0", (44,)),
    *((name, (k,)) for k, (name, _) in NAMES.items()),
]
TRIGGERS = ("licens", "licenc", "permission", "copyright", "redistribut", "public domain", "rights reserved", "endorse or promote", "advertising materials")
#: Marks of a text's stops and line breaks: upper case, which no lower-cased text has.
STOP, LINE = "S", "L"
_MARKING = [(r"[\r\n]++[^0-9a-z]*+", f" {LINE} "), (r"[.!?;]++(?=\s|$)", f" {STOP} "), (rf"[^0-9a-z{STOP}{LINE}]++", " ")]


def normal(sentence: str) -> list[str]:
    """The words, marks and slots of a listed sentence, as ``marked`` has them; a stop at its end isn't part of it."""
    words = sentence.lower().replace("{}", " zslotz ")
    for pattern, by in _MARKING:
        words = re.sub(pattern, by, words)
    return words.strip(f" {STOP}{LINE}").replace("zslotz", "{}").split(" ")


def _words(sentence: str) -> str:
    return " ".join(x for x in normal(sentence) if x not in (STOP, LINE))


def _pattern(words: list[str], line: str, stop: str) -> str:
    """The expression of a run of words; ``line`` and ``stop`` are what may stand between."""
    out = ""
    for k, word in enumerate(words):
        if word == STOP:
            out += f"{STOP} {stop}"
        else:
            # a stop within a slot ends an abbreviation, as in "Inc."
            out += rf"(?:(?:[0-9a-z]+|{STOP}) {line}){{1,{SLOT}}}?" if word == "{}" else f"{word} {line}"
    return out[:len(out) - len(line)].rstrip(" ") if words[-1] != "{}" else out + "(?=[SL])"


_BY_SIZE = sorted(SENTENCES, key=lambda k: -len(SENTENCES[k]))
#: Words without marks -> identifier, and the expressions of sentences with slots.
_KNOWN = {_words(SENTENCES[k]): k for k in _BY_SIZE if "{}" not in SENTENCES[k]}
_SLOTTED = {k: " ".join(rf"(?:[0-9a-z]+ ){{0,{SLOT - 1}}}[0-9a-z]+" if w == "{}" else w for w in _words(SENTENCES[k]).split(" ")) for k in _BY_SIZE if "{}" in SENTENCES[k]}
#: Wording of a name -> identifier; longest first, as the pattern tries them.
_NAMED = {w: k for w, k in sorted(
    {w: k for k, (name, wordings) in NAMES.items() for w in (*wordings, re.sub("[^0-9a-z]+", " ", name.lower()))}.items(), key=lambda x: -len(x[0]))}
if len({_words(x) for x in SENTENCES.values()}) < len(SENTENCES):
    raise ValueError("two license sentences have the same words")
if not all(any(t in _words(x) for t in TRIGGERS) for x in SENTENCES.values()):
    raise ValueError("a license sentence without a trigger word would never be looked for")
_TRIGGER = "|".join(t.replace(" ", "[^0-9a-z]+") for t in TRIGGERS)
_LINES, _MARKS = f"(?:{LINE} )*+", f"(?:[{STOP}{LINE}] )*+"
_WHOLE = "|".join(_pattern(normal(SENTENCES[k]), _LINES, _MARKS) for k in _BY_SIZE)
_HEAD = "|".join(_pattern(x.split(" "), _LINES, _MARKS) for x in NAMING)
_NAMES = r"(?<![0-9a-z])(?:" + "|".join(_NAMED) + r")(?![0-9a-z])"
#: A known sentence between two marks; what follows a naming word; an SPDX line.
_SENTENCE = (rf"((?<=[{STOP}{LINE}] )(?:{_WHOLE})(?= ?[{STOP}{LINE}])"
             rf"|(?<![0-9a-z])(?<!\bnot )(?:{_HEAD}) (?:(?:[0-9a-z]+|{LINE}) ){{1,{NAMED}}}"
             rf"|(?<![0-9a-z]){SPDX} (?:[0-9a-z]+ ){{1,{NAMED}}})")


def marked(text: Column) -> Column:
    """A text's words and marks, single-spaced, between two stops."""
    text = F.lower(text)
    for pattern, by in _MARKING:
        text = F.regexp_replace(text, pattern, by)
    return F.concat(F.lit(f"{STOP} "), F.trim(text), F.lit(f" {STOP}"))


def identifiers(run: Column) -> Column:
    """What a matched run of words stands for: one sentence, or the licenses named in it."""
    words = F.trim(F.regexp_replace(run, f"(?<![^ ])[{STOP}{LINE}](?: |$)", ""))
    known = F.create_map(*(F.lit(x) for item in _KNOWN.items() for x in item))
    named = F.create_map(*(F.lit(x) for item in _NAMED.items() for x in item))

    def of(x: Column) -> Column:
        one = F.element_at(known, x)
        for k, pattern in _SLOTTED.items():
            one = F.coalesce(one, F.when(x.rlike(f"^(?:{pattern})$"), F.lit(k)))
        return F.when(one.isNotNull(), F.array(one)).otherwise(F.transform(F.regexp_extract_all(x, F.lit(_NAMES), F.lit(0)), lambda n: F.element_at(named, n)))

    return F.transform(F.array(words), of)[0]  # the words are bound once


def found(docs: DataFrame) -> DataFrame:
    """``docs`` with sequence (array of identifiers) and licenses (array of names, sorted)."""
    none = F.array().cast("array<string>")
    sequence = F.flatten(F.transform(F.regexp_extract_all(marked(F.col("text")), F.lit(_SENTENCE), F.lit(1)), identifiers))
    rows = C.saved(docs.withColumn("__sequence", F.when(F.lower(F.col("text")).rlike(_TRIGGER), sequence)).drop("text"), "license-rows")
    seq = rows.withColumn("__sequence", F.coalesce("__sequence", F.array().cast("array<int>")))
    text = F.concat(F.lit(","), F.array_join(F.transform("__sequence", lambda x: x.cast("string")), ","), F.lit(","))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(map(str, ids)) + ",").alias("ids")) for name, ids in RULES))
    hit = F.filter(rules, lambda r: F.col("__ids").contains(r["ids"]))
    # a rule stands if it still occurs once every longer matched rule's row is taken out
    left = F.filter("__hit", lambda r: F.aggregate(
        F.filter("__hit", lambda o: (F.length(o["ids"]) > F.length(r["ids"])) & o["ids"].contains(r["ids"])), F.col("__ids"),
        lambda acc, o: F.replace(acc, o["ids"], F.lit(",,"))).contains(r["ids"]))
    named = F.array_sort(F.array_distinct(F.transform(left, lambda r: r["name"])))
    return (seq.withColumn("__ids", text).withColumn("__hit", F.when(F.size("__sequence") > 0, hit))
            .select(*(c for c in docs.columns if c != "text"), F.col("__sequence").alias("sequence"), F.coalesce(named, none).alias("licenses")))


def op9_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_sentences (identified), sequence (comma-joined), licenses (comma-joined)."""
    rows = found(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("sequence").cast("long").alias("n_sentences"),
                       F.array_join(F.transform("sequence", lambda x: x.cast("string")), ",").alias("sequence"),
                       F.array_join("licenses", ",").alias("licenses"))
