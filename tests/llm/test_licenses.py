import re
import textwrap

from stratagraph.llm import licenses as L
from stratagraph.llm import queries

MIT = "The MIT License.\n\nCopyright (c) 2020 X\n\n" + "\n".join(L.SENTENCES[k] + "." for k in ("mit-grant", "mit-notice", "mit-as-is"))
APACHE = "# " + "\n# ".join(x + "." for x in (L.SENTENCES["apache-head"], L.SENTENCES["apache-copy"], L.SENTENCES["apache-as-is"], L.SENTENCES["apache-see"]))


YEAR = r"([0-9]{4}|<year>|\[yyyy\]|\[year\])"
HOLDER = re.compile(rf"(copyright ?(\(c\)|©)?|\(c\)|©)[ ,:]*{YEAR}", re.I)


def cut(text):
    """The sentences of a text, each a list of its lines: a line at a time, then a character at a time."""
    out, now = [], []  # now: (line, joined to the one before by)
    for raw in text.split("\n"):
        line = re.sub(r"[ \t\r\f]+", " ", raw).lstrip(" #*;%<>!/-")
        for end in (" ", "*/", "-->", " "):
            line = line.removesuffix(end)
        now.append(line)
    joined = "\n" + "\n".join(now) + "\n"
    joined = re.sub("(?i)spdx-license-identifier:", lambda m: m[0][:-1], joined)
    joined = re.sub(r"(?i)([ (,\n])(v|ver)\. ?\n?([0-9])", r"\1\2 \3", joined)
    lines = []
    for line in joined[1:-1].split("\n"):
        if HOLDER.match(line):
            lines.append(None)
            if "all rights reserved" in line.lower() and line[line.lower().index("all rights reserved") - 1] in "., ":
                lines.append(line[line.lower().index("all rights reserved") :])
        elif m := re.match(r"\(?([0-9]{1,2}|[a-zA-Z]|[ivx]{2,4})[.)] ", line):
            lines += [None, line[m.end() :]] if line[m.end() :] else [None]
        else:
            lines.append(line or None)
    blocks, block = [], []
    for line in [*lines, None]:
        if line is None:
            blocks.append(block)
            block = []
        elif re.fullmatch("https?://[^ ]+", line):  # ends the block before it
            own = block or (blocks.pop() if blocks else [])
            blocks.append([*own[:-1], f"{own[-1]} {line}"] if own else [line])
            block = []
        else:
            block.append(line)
    for block in blocks:
        text = "\n".join(block) + "\n"
        start = at = 0
        while at < len(text):
            after = re.match(r":( \n|\n| )(?=[A-Z0-9(\"])", text[at : at + 4])
            if after:
                out.append(text[start:at])
                start = at = at + after.end()
            elif text[at] in ".!?" and text[at + 1] in " \n":
                out.append(text[start : at + 1])
                start = at = at + 2
            else:
                at += 1
        out.append(text[start:])
    return [s.split("\n") for s in out]


def brute(text):
    ids = []
    for lines in cut(text):
        name = L.KNOWN.get(L.normalise(" ".join(lines)))
        ids += [name] if name else [n for x in lines if (n := L.KNOWN.get(L.normalise(x)))]
    left, found, count = list(ids), set(), 0
    for name, rule in L.RULES:
        i = 0
        while i + len(rule) <= len(left):
            if left[i : i + len(rule)] == rule:
                left = left[:i] + [None] + left[i + len(rule) :]
                found.add(name)
                count += 1
            i += 1
    return ",".join(ids), ",".join(sorted(found)), count


def test_rules(spark):
    texts = [None, "", "Plain words only.", MIT, APACHE, MIT + "\n" + APACHE, "Intro.\nLicensed under CC BY-NC 4.0.", "x Licensed under CC BY-NC 4.0.",
             L.SENTENCES["bsd-grant"] + ".\n" + L.SENTENCES["bsd-source"] + ".\n" + L.SENTENCES["bsd-binary"] + ".",
             "Permission is hereby\ngranted, free of charge, to nobody.", "Released under the MIT License. " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.identifiers, r.licenses, r.n_matches) for r in L.scan(df).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}
    assert got[3][1] == "MIT" and got[4][1] == "Apache-2.0" and got[5][1] == "Apache-2.0,MIT"
    assert got[6][1] == "CC-BY-NC-4.0" and got[7][1] == "" and got[8][1] == "BSD-2-Clause"
    assert L.scan(df.limit(0)).count() == 0
    assert got[10] == ("mit-name,mit-name,mit-name", "MIT", 3)  # repeats count


def test_edge_rows(spark):
    long = "word " * 400_000 + "\n" + " " * 200_000 + "." * 200_000 + "\n" * 200_000 + "Released under the MIT License."
    rows = [(None, "Released under the MIT License.", "a", 1), (1, None, "a", 2), (1, "All rights reserved.", "b", 2), (1, "All rights reserved.", "b", 2), (2, long, "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, identifiers string, n_matches int")
    got = sorted(((r.doc_id or 0, r.licenses, r.n_matches) for r in L.scan(df).collect()))
    assert got == [(0, "MIT", 1), (1, "", 0), (1, "LicenseRef-all-rights-reserved", 1), (1, "LicenseRef-all-rights-reserved", 1), (2, "MIT", 1)]


COMMON = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}


def test_full_texts_of_the_system(spark):
    """The licences that Debian systems keep, whole, plain and as comments."""
    import pathlib

    rows = []
    for file, name in COMMON.items():
        path = pathlib.Path("/usr/share/common-licenses") / file
        if path.exists():
            text = path.read_text()
            rows += [(name, text), (name, "/*\n" + "".join(f" * {x}\n" for x in text.split("\n")) + " */\n"), (name, "".join(f"# {x}\n" for x in text.split("\n")))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] or [(0, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    for i, (name, text) in enumerate(rows):
        assert got[i].licenses.split(",") == [name], (name, got[i])
        assert (got[i].identifiers, got[i].licenses, got[i].n_matches) == brute(text)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.identifiers, r.licenses, r.n_matches) for r in queries.op8_license_sentence_rules(spark, sf).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}
    assert any(v[1] for v in got.values())


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op8_license_sentence_rules"]).fetchall()}
    got = {r.doc_id: (r.identifiers, r.licenses, r.n_matches) for r in queries.op8_license_sentence_rules(spark, sf).collect()}
    assert got == want


def test_all_rights_reserved(spark):
    texts = ["Words. All rights reserved. More words.", "Some line\nAll rights reserved.\n", "Copyright (c) 2021 Some Name. All rights reserved.", "Reserved words."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in L.scan(df).collect()}
    assert got == {0: "LicenseRef-all-rights-reserved", 1: "LicenseRef-all-rights-reserved", 2: "LicenseRef-all-rights-reserved", 3: ""}


def wrapped(*parts, margin="", width=76):
    lines = [ln for k, p in enumerate(parts) for ln in ([""] if k else []) + (textwrap.wrap(p, width) or [""])]
    return "\n".join((margin + ln).rstrip() for ln in lines) + "\n"


S = {k: v.rstrip(":") for k, v in L.SENTENCES.items()}
LIABLE = "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, ARISING FROM THE SOFTWARE OR THE USE OF IT."
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
       "1. " + S["bsd-source"] + ".", "2. " + S["bsd-binary"] + ".", "3. " + S["bsd-endorse"] + ".", "THIS SOFTWARE IS PROVIDED \"AS IS\" AND ANY WARRANTIES ARE DISCLAIMED. " + LIABLE]
APACHE_2 = ["Copyright 2020 Some Name", S["apache-head"] + ". You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0", S["apache-as-is"] + ". " + S["apache-see"] + "."]
PRINTED = {
    "MIT": [wrapped("MIT License", "Copyright (c) 2020 Some Name", S["mit-grant"] + ":", S["mit-notice"] + ".", S["mit-as-is"] + ". " + LIABLE, margin=m) for m in ("", "# ", " * ", "// ")]
    + [S["mit-grant"] + ": " + S["mit-notice"] + ". " + S["mit-as-is"] + "."],
    "BSD-3-Clause": [wrapped("Copyright (c) 2020, Some Name", *BSD), wrapped("Copyright (c) 2020, Some Name. All rights reserved.", *BSD, margin="# "),
                     "Copyright (c) 2020, Some Name\nAll rights reserved.\n\n" + wrapped(*BSD).replace("\n\n", "\n")],
    "BSD-2-Clause": [wrapped(*BSD[:3], BSD[4], margin=" * ")],
    "Apache-2.0": [wrapped(*APACHE_2, margin=m) for m in ("", "# ", "   ")],
    "GPL-3.0-or-later": [wrapped("Some program", "Copyright (C) 2020  Some Name", S["gpl-free"] + ".", S["gpl-hope"] + ".  See the GNU General Public License for more details.", margin=m, width=w) for m, w in (("", 70), ("# ", 33))],
    "Zlib": [wrapped("Copyright (C) 2020 Some Name", "  " + S["zlib-warranty"] + ".  In no event will the authors be held liable for any damages arising from the use of this software.", S["zlib-grant"] + ":",
                     "1. " + S["zlib-origin"] + ". If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
                     "2. " + S["zlib-altered"] + ".", "3. " + S["zlib-notice"] + ".", margin=m, width=w) for m, w in (("", 76), ("  ", 60), ("// ", 80))],
    "BSL-1.0": [wrapped(S["bsl-title"], S["bsl-grant"] + ":", "The copyright notices in the Software must be included.", margin=m) for m in ("", "// ")],
    "MPL-2.0": [wrapped(S["mpl2-head"] + ". " + S["mpl2-copy"] + ".", margin=m, width=w) for m in ("", "# ", " * ") for w in (60, 70, 80)],
    "LGPL-2.1-or-later": [wrapped("Copyright (C) 2020 X", S["lgpl21-free"] + ".", S["lgpl-hope"] + ".  See the GNU Lesser General Public License for more details.", margin=" * ", width=w) for w in (60, 72)],
    "AGPL-3.0-or-later": [wrapped("Copyright (C) 2020 X", S["agpl3-free"] + ".", S["gpl-hope"] + ". See more.", margin="", width=w) for w in (60, 72)],
    "EPL-2.0": [wrapped("Copyright (c) 2020 X", S["epl2-head"], margin=" * ")],
    "ISC": [wrapped("ISC License", "Copyright (c) 2020, Some Name", S["isc-grant"] + ".", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."), wrapped("(c) 2020 X", S["isc-grant"] + ".")],
}


def test_printed_licences(spark):
    rows = [(name, text) for name, texts in PRINTED.items() for text in texts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_matches, r.identifiers) for r in L.scan(df).collect()}
    for i, (name, text) in enumerate(rows):
        assert got[i][:2] == (name, 1), (text, got[i])
        assert brute(text) == (got[i][2], *got[i][:2])
    assert "apache-head,apache-copy,apache-as-is,apache-see" in {v[2] for v in got.values()}
    both = spark.createDataFrame([(1, PRINTED["MIT"][0] + "\n" + PRINTED["BSD-3-Clause"][1])], "doc_id long, text string")
    assert [(r.licenses, r.n_matches) for r in L.scan(both).collect()] == [("BSD-3-Clause,MIT", 2)]
    tag = spark.createDataFrame([(1, "// SPDX-License-Identifier: Apache-2.0\nint x;\n"), (2, "x = 1  # no tag\n")], "doc_id long, text string")
    assert [r.licenses for r in L.scan(tag).orderBy("doc_id").collect()] == ["Apache-2.0", ""]


def test_sql_on_printed_texts(spark):
    import duckdb
    import pyarrow as pa

    texts = [t for ts in PRINTED.values() for t in ts] + [MIT, APACHE, None, "", "v. 2.0: A", "Note: The MIT License: A b.", "(a) x\n(c) 2020 Y. All rights reserved. Z", "a\n\nhttp://x.y/z\nb copyright"]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    con = duckdb.connect()
    con.register("documents", table)
    want = {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op8_license_sentence_rules"]).fetchall()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.identifiers, r.licenses, r.n_matches) for r in L.scan(df).collect()} == want
    assert want == {i: brute(t or "") for i, t in enumerate(texts)}
