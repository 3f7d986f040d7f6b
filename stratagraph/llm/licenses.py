"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, sentences are normalised (lower case, runs of other characters
than letters and digits become one space) and known licence sentences become identifiers.
The document's identifiers, in order, are matched against ordered licence rules: each rule is
a sequence of identifiers, longer and more specific rules come first and use up what they
match. Sentences that aren't known may stand between; they have no identifier.

One pass over the texts without a shuffle; each row is on its own, so no group can be hot. Every
pattern reads a text in linear time.

Licences as they are printed are wrapped, commented and have sentences without closing marks. So
comment marks and margins go first; titles, copyright lines, list marks, addresses on lines of their
own, blank lines and colons before a capital end a sentence as closing marks do; single line breaks
are joined. Where a joined sentence isn't known, its lines are looked up one by one. Identifiers
keep the text's order and repeats. Texts without one of the ``ANCHORS`` are skipped; every known
sentence holds one (checked when the module is loaded).

Defined results: a null text counts as empty and matches nothing; repeated rows each get a
row; null ids stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import id_and_text

# Sentences of public licences as the licences have them, and the short notices that name a licence.
SENTENCES = {
    "apache-name": "Licensed under the Apache License, Version 2.0",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-name": "Released under the MIT License",
    "mit-name-2": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-title-2": "MIT License",
    "mit-title-3": "The MIT License (MIT)",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-head": "Distributed under the Boost Software License, Version 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-head": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "apache-title": "Apache License Version 2.0, January 2004",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl2-name": "This work is licensed under the GNU General Public License, version 2",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-short": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl3-name": "Licensed under the GNU Lesser General Public License, version 3",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-name": "Licensed under CC BY 4.0",
    "cc-by-sa-name": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-name": "Licensed under CC BY-NC 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-name": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain under the Unlicense",
    "unlicense-2": "This is free and unencumbered software released into the public domain",
    "all-rights": "Copyright all rights reserved",
    "all-rights-2": "All rights reserved",
}
# Other wordings of the same sentences.
VARIANTS = [
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-title", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl3-free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("bsl-head", "Distributed under the Boost Software License, Version 1.0 (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("bsl-head", "Distributed under the Boost Software License, Version 1.0 (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
]
# Names that an SPDX tag may give.
SPDX = ["AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
        "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
ANCHORS = ("licens", "copyright", "permission", "redistribut", "warrant", "reserved", "misrepresented", "unencumbered", "notice", "mpl")

#: (licence, identifiers in order); longer rules first. An identifier may take part in several rules.
RULES = [
    ("Apache-2.0", ["apache-head", "apache-copy", "apache-as-is", "apache-see"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("BSD-3-Clause", ["all-rights-2", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["all-rights-2", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-warranty", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("GPL-3.0-only", ["gpl3-title", "gpl-free", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-title", "gpl2-free", "gpl-hope"]),
    ("LGPL-2.1-only", ["lgpl21-title", "lgpl21-free", "lgpl-hope"]),
    ("AGPL-3.0-only", ["agpl3-title", "agpl3-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("MPL-2.0", ["mpl2-title", "mpl2-head", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-head", "mpl2-copy"]),
    ("BSL-1.0", ["bsl-title", "bsl-grant"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("Apache-2.0", ["apache-head"]),
    ("Apache-2.0", ["apache-name"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-name-2"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("LGPL-3.0-only", ["lgpl3-name"]),
    ("MPL-2.0", ["mpl2-head"]),
    ("CC-BY-4.0", ["cc-by-name"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-name"]),
    ("CC0-1.0", ["cc0-name"]),
    ("Unlicense", ["unlicense"]),
    ("LicenseRef-all-rights-reserved", ["all-rights"]),
    ("LicenseRef-all-rights-reserved", ["all-rights-2"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-2.0-only", ["gpl2-title"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("LGPL-2.1-only", ["lgpl21-title"]),
    ("LGPL-3.0-only", ["lgpl3-title"]),
    ("AGPL-3.0-only", ["agpl3-title"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("EPL-2.0", ["epl2-head"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("BSL-1.0", ["bsl-title"]),
    ("BSL-1.0", ["bsl-head"]),
    ("Unlicense", ["unlicense-2"]),
    *((name, [f"spdx-{name.lower()}"]) for name in SPDX),
]

def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


KNOWN = {normalise(s): name for name, s in [*SENTENCES.items(), *VARIANTS, *((f"spdx-{x.lower()}", f"SPDX-License-Identifier {x}") for x in SPDX)]}
if not all(any(a in s for a in ANCHORS) for s in KNOWN):
    raise ValueError("a known sentence has no anchor word")

# What ends a sentence becomes CUT. Steps, in order, on a text between two line breaks: (pattern, replacement).
CUT = "\u0001"
HOLDER = r"\n((copyright ?(\(c\)|\u00a9)?|\(c\)|\u00a9)[ ,:]*([0-9]{4}|<year>|\[yyyy\]|\[year\])"
STEPS = [
    (r"[ \t\r\f]+", " "),
    (r"\n[ #*;%<>!/-]*", "\n"),  # margins and comment marks
    (r" ?(\*/|-->)? ?\n", "\n"),
    (r"(?i)(spdx-license-identifier):", "$1"),
    (r"(?i)([ (,\n])(v|ver)\. ?\n?([0-9])", "$1$2 $3"),
    (rf"(?i){HOLDER}[^\n]*?)[., ](all rights reserved)", "$1\n$5"),  # copyright lines
    (rf"(?i){HOLDER}[^\n]*)", f"\n{CUT}"),
    (r"\n\(?([0-9]{1,2}|[a-zA-Z]|[ivx]{2,4})[.)] ", f"\n{CUT}"),  # list marks
    (r"\n{2,}", CUT),  # blank lines
    (rf"[\n{CUT}](https?://[^ \n{CUT}]+)[\n{CUT}]", f" $1{CUT}"),  # an address on its own line ends the sentence before it
    (r":( |\n| \n)([A-Z0-9(\"])", f"{CUT}$2"),  # a colon before a capital
    (rf"[.!?][ \n{CUT}]", CUT),
]


def sentences(text: Column) -> Column:
    """The sentences of a text, in order; line breaks inside them stay."""
    text = F.concat(F.lit("\n"), text, F.lit("\n"))
    for pattern, to in STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return F.split(text, CUT)


def identifiers(text: Column) -> Column:
    """The known sentences' identifiers, in the text's order."""
    table = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    anchors = "|".join(ANCHORS)

    def known(sentence: Column) -> Column:
        return F.try_element_at(table, F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")))

    def of(sentence: Column) -> Column:
        """The sentence's identifier, else those of its lines."""
        lines = F.filter(F.transform(F.split(sentence, "\n"), known), lambda i: i.isNotNull())
        return F.coalesce(F.transform(F.array(known(sentence)), lambda i: F.when(i.isNotNull(), F.array(i)))[0], lines)

    anchored = F.filter(sentences(text), lambda s: F.lower(s).rlike(anchors))
    return F.when(F.lower(text).rlike(anchors), F.flatten(F.transform(anchored, of))).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """(left, found, n): the rules, in order, each on what the rules before have left of the identifiers."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(own) + ",").alias("ids")) for name, own in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc.left, rule.ids, F.lit("\u0002"))
        times = ((F.length(acc.left) - F.length(rest)) / (F.length(rule.ids) - 1)).cast("long")
        return F.when(
            F.contains(acc.left, rule.ids), F.struct(rest.alias("left"), F.concat(acc.found, F.array(rule["name"])).alias("found"), (acc.n + times).alias("n"))
        ).otherwise(acc)

    return F.aggregate(rules, start, step)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, identifiers, licenses, n_matches)``: comma-joined identifiers and sorted distinct licences."""
    rows = id_and_text(df, id_col, text_col).select("doc_id", identifiers(F.col("text")).alias("ids"))
    rows = rows.select("doc_id", "ids", F.when(F.size("ids") > 0, matched(F.col("ids"))).alias("m"))
    return rows.select(
        "doc_id",
        F.array_join("ids", ",").alias("identifiers"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("m.found")), ","), F.lit("")).alias("licenses"),
        F.coalesce("m.n", F.lit(0).cast("long")).alias("n_matches"),
    )
