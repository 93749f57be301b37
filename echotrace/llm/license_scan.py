"""License scans by sentence-rule recognition. DataFrame functions only.

A text is cut into sentences twice: at line breaks and after . ! ? ; before white space, for licence lines of their own,
and at blank lines and after those signs and colons only, for sentences that are wrapped over lines. A sentence is normalised (lower case, runs of
other characters than a-z and 0-9 to one space, line prefixes such as comment signs gone with them) and mapped to
the identifier of a known licence sentence, or to none. Sentences with variable parts are brought to one form first (SLOTS): the
holder's name in the third BSD clause, which may itself hold full stops and so be cut, and subject, verb and the hint at a
file around a licence's name ("This project is licensed under the MIT License - see the LICENSE file for details"). The identifiers of a document, in order, form one string with a letter for
each known sentence and "." for any other. A rule is an ordered list of identifiers; it matches where they follow each
other with at most its gap of other sentences, known or not, between. All of it is a projection of the document's own row: no
shuffle, no join, and a document of any length is one string of one letter a sentence.

Known sentences and rules come from NOTICES and LINES: a notice is cut and normalised as a text is, once by each cut, and its parts in
order are a rule. A licence whose notice begins another's (BSD-2-Clause) counts where it stands outside of the other's matches.

Defined results: null and empty text match nothing; a sentence of any length is looked up after it was normalised; repeated
rows return repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.llm._common import text_or_empty

LINE_CUT = "\n+|[.!?;][ \t\r]+"
WRAPPED_CUT = "\n[ \t\r]*\n|[.!?;:][ \t\r\n]+"

#: Lines that name a licence by themselves.
LINES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["SPDX-License-Identifier: ISC"],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0"],
    "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0"],
    "Zlib": ["SPDX-License-Identifier: Zlib"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "all-rights-reserved": ["All rights reserved."],
}

#: The names that one line gives a licence.
NAMES = {
    "Apache-2.0": ["Apache 2.0", "Apache 2", "Apache-2.0", "Apache License 2.0", "Apache License v2.0", "Apache License, Version 2.0", "Apache Software License 2.0"],
    "MIT": ["MIT", "MIT/X11", "Expat"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "BSD-3-Clause", "BSD 3-Clause \"New\" or \"Revised\"", "New BSD", "Modified BSD", "Revised BSD"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "BSD-2-Clause", "BSD 2-Clause \"Simplified\"", "Simplified BSD", "FreeBSD"],
    "ISC": ["ISC"],
    "MPL-2.0": ["MPL 2.0", "MPL-2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"],
    "EPL-2.0": ["EPL 2.0", "EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "Zlib": ["zlib", "zlib/libpng"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC-BY-4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    **{
        f"{short}-{version}": [
            form.format(short=short, v=v, name=name)
            for v in ([version, version[:-2]] if version.endswith(".0") else [version])
            for form in ("{short} {v}", "{short}-{v}", "{short}v{v}", "{short} v{v}", "{short} version {v}", "GNU {short} v{v}", "GNU {short}v{v}", "GNU {name} v{v}", "GNU {name} version {v}", "GNU {name} {v}", "GNU {name}, version {v} or later")
        ]
        for short, name, version in (
            ("GPL", "General Public License", "2.0"),
            ("GPL", "General Public License", "3.0"),
            ("LGPL", "Lesser General Public License", "2.1"),
            ("LGPL", "Lesser General Public License", "3.0"),
            ("AGPL", "Affero General Public License", "3.0"),
        )
    },
}

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
)
_GNU = (
    "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{b} "
    "either version {version} of the License, or (at your option) any later version.\n\n"
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY{c} without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
#: Licence, gap, and the sentences of its notice that must be there.
NOTICES = [
    (
        "Apache-2.0",
        1,
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    ("Apache-2.0", 1, "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0"),
    (
        "Apache-2.0",
        6,
        'you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("MIT", 3, "MIT License\n\n" + _MIT_GRANT),
    ("MIT", 3, "The MIT License (MIT)\n\n" + _MIT_GRANT),
    (
        "MIT",
        1,
        _MIT_GRANT + 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    ("BSD-2-Clause", 4, _BSD),
    (
        "BSD-3-Clause",
        4,
        _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        0,
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC0-1.0", 0, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # Cut after "v."; no other version has this wording.
    ("MPL-2.0", 0, "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("MPL-2.0", 0, "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("EPL-2.0", 0, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    (
        "EPL-2.0",
        0,
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("EPL-2.0", 0, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v."),
    ("Unlicense", 0, "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        3,
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    *(
        (f"{license}-{version}{'' if '.' in version else '.0'}", 2, _GNU.format(what=what, name=name, version=version, a=a, b=b, c=c))
        for (license, name, whats, versions), a, b, c in product(
            [
                ("GPL", "", ["program"], ["2", "3"]),
                ("LGPL", "Lesser ", ["program", "library"], ["2.1", "3"]),
                ("AGPL", "Affero ", ["program"], ["3"]),
            ], ";:,", ";,", ";,"
        )
        for what, version in product(whats, versions)
    ),
]
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
#: Forms that variable parts of a normalised sentence are brought to, one after another. Only what all three engines understand alike.
SLOTS = [
    # A holder's name with a full stop is cut, so what stands before "nor" may be any part of it, or nothing.
    (
        "^(?:[a-z0-9 ]{0,300} )?nor the names of (?:its |their |any |the |other |any other )?contributors may be used to endorse or promote products derived from this software without (?:specific )?prior written permission$",
        f"nor the names of its contributors {_ENDORSE}",
    ),
    (
        "^(?:the )?names? of .{1,200} may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission$",
        f"nor the names of its contributors {_ENDORSE}",
    ),
    ("^permission to use copy modify and distribute ", "permission to use copy modify and or distribute "),
    (
        "^(?:(?:this|the|our|all) (?:[a-z0-9]+ ){0,6}?(?:is|are) )?(?:open source )?(?:(?:dual )?licen[cs]ed |released |distributed |available |made available |published |provided |covered )?under (?:the )?(?:terms of (?:the )?)?(.{1,80}?)(?: licen[cs]e)?(?: (?:please )?see (?:the )?(?:file |accompanying )?licen[cs]e.{0,60})?$",
        "under {1}",
    ),
    ("^(?:the |project )?licen[cs]e (?:is )?(?:the )?(.{1,80}?)(?: licen[cs]e)?$", "under {1}"),
]
#: A more specific licence, and those whose notice is part of its own.
HIDES = {"BSD-3-Clause": ["BSD-2-Clause"]}


@dataclass(frozen=True)
class Rule:
    license: str
    sentences: tuple[str, ...]
    gap: int = 0


def normalised(sentence: str) -> str:
    text = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    for slot, form in SLOTS:
        text = re.sub(slot, form.replace("{1}", "\\1"), text)
    return text


def parts_of(text: str, cut: str) -> tuple[str, ...]:
    return tuple(x for x in map(normalised, re.split(cut, text)) if x)


#: Each rule once; identifiers are the normalised sentences themselves.
RULES = list(
    dict.fromkeys(
        [
            *(Rule(license, (normalised(line),)) for license, lines in LINES.items() for line in lines),
            *(Rule(license, (normalised(f"Licensed under the {name}."),)) for license, names in NAMES.items() for name in names),
            *(Rule(license, parts_of(text, cut), gap) for license, gap, text in NOTICES for cut in (LINE_CUT, WRAPPED_CUT)),
        ]
    )
)


def sentences_of(rules: list[Rule]) -> list[str]:
    return list(dict.fromkeys(s for r in rules for s in r.sentences))


def letter(i: int) -> str:
    """The letter of the i-th known sentence."""
    return chr(0xE000 + i)


#: Words of licence sentences that are rare in other texts.
_RARE = (
    "license",
    "licensed",
    "licenses",
    "redistribution",
    "redistributions",
    "permission",
    "software",
    "warranty",
    "warranties",
    "copyright",
    "rights",
    "redistribute",
    "endorse",
)


def _likely(sentences: list[str]) -> str:
    """A pattern that any text with a known sentence matches: a rare word of each, or its longest; "under" stands for two forms."""
    words = {next((w for w in _RARE if w in s.split()), max(s.split(), key=len)) for s in sentences if not s.startswith("under ")}
    words |= {"under", "licen"} if any(s.startswith("under ") for s in sentences) else set()
    return "(?i)" + "|".join(sorted(w for w in words if not any(v != w and v in w for v in words)))


def codes(text: Column, cut: str, sentences: list[str]) -> Column:
    """One letter for each sentence of the text."""
    known = F.create_map(*(F.lit(x) for i, s in enumerate(sentences) for x in (s, letter(i))))

    def plain(s: Column) -> Column:
        text = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
        for slot, form in SLOTS:
            text = F.regexp_replace(text, slot, form.replace("{1}", "$1"))
        return text

    one = lambda s: F.when(
        F.rlike(s, F.lit(_likely(sentences))), F.coalesce(F.element_at(known, plain(s)), F.lit("."))
    ).otherwise(F.lit("."))
    return F.array_join(F.transform(F.split(text, cut), one), "")


def pattern(rule: Rule, sentences: list[str]) -> str:
    """Letters of the sentences in order, with any letters of the same cut in the gaps."""
    return f".{{0,{rule.gap}}}".join(letter(sentences.index(s)) for s in rule.sentences)


def _patterns(rules: list[Rule], sentences: list[str]) -> dict[str, str]:
    by_license: dict[str, list[str]] = {}
    for r in rules:
        by_license.setdefault(r.license, []).append(pattern(r, sentences))
    return {name: "|".join(by_license[name]) for name in sorted(by_license)}


def license_scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (sorted, distinct), n_known (known licence sentences, by the cut that finds more), n_sentences for each row."""
    rules = rules or RULES
    sentences = sentences_of(rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = rows.withColumn("n_sentences", F.size(F.split("t", LINE_CUT)))
    # Both cuts, a line break between them; most texts have none of the words and are not looked at again.
    both = F.concat_ws("\n", codes(F.col("t"), LINE_CUT, sentences), codes(F.col("t"), WRAPPED_CUT, sentences))
    rows = rows.withColumn("c", F.when(F.rlike("t", F.lit(_likely(sentences))), both).otherwise("")).drop("t")
    patterns, found = _patterns(rules, sentences), []
    for name, p in patterns.items():
        rest = F.col("c")
        for by in (by for by, names in HIDES.items() if name in names and by in patterns):
            rest = F.regexp_replace(rest, F.lit(patterns[by]), F.lit("."))
        found.append(F.when(F.rlike(rest, F.lit(p)), F.lit(name)))
    known = [F.length(F.replace(F.element_at(F.split("c", "\n"), i), F.lit("."), F.lit(""))) for i in (1, -1)]
    # Texts without a letter of a known sentence skip the rules.
    licenses = F.when(F.translate("c", ".\n", "") == "", F.array().cast("array<string>")).otherwise(
        F.filter(F.array(*found), lambda x: x.isNotNull())
    )
    return rows.select("doc_id", licenses.alias("licenses"), F.greatest(*known).alias("n_known"), "n_sentences")


def oracle() -> str:
    """The scan in SQL for DuckDB, with the same sentences and rules."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sentences = sentences_of(RULES)
    known = "MAP {" + ", ".join(f"{quoted(s)}: '{letter(i)}'" for i, s in enumerate(sentences)) + "}"
    plain = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for slot, form in SLOTS:
        plain = f"regexp_replace({plain}, {quoted(slot)}, {quoted(form.replace('{1}', chr(92) + '1'))})"
    one = f"coalesce(m[{plain}], '.')"
    patterns, hits = _patterns(RULES, sentences), []
    for name, p in patterns.items():
        rest = "c"
        for by in (by for by, names in HIDES.items() if name in names):
            rest = f"regexp_replace({rest}, '{patterns[by]}', '.', 'g')"
        hits.append(f"CASE WHEN regexp_matches({rest}, '{p}') THEN {quoted(name)} END")
    part = lambda cut: f"array_to_string(list_transform(string_split_regex(t, '{cut}'), lambda s: {one}), '')"
    line, wrapped = LINE_CUT.encode("unicode_escape").decode(), WRAPPED_CUT.encode("unicode_escape").decode()
    return f"""
        WITH known AS (SELECT {known} AS m),
        cut AS (SELECT doc_id, t, {part(line)} AS c1, {part(wrapped)} AS c2, len(string_split_regex(t, '{line}')) AS n
                FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), known),
        joined AS (SELECT doc_id, c1 || chr(10) || c2 AS c, c1, c2, n FROM cut)
        SELECT doc_id, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS licenses,
            CAST(greatest(length(replace(c1, '.', '')), length(replace(c2, '.', ''))) AS INTEGER) AS n_known, CAST(n AS INTEGER) AS n_sentences
        FROM joined"""
