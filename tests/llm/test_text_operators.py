import hashlib
import random
import re

import duckdb
import pytest
import xxhash

from cohortal.llm import fingerprint as FP
from cohortal.llm import licenses, quality, secrets
from cohortal.llm.bitfilter import bit_filter, marked
from cohortal.llm.jaccard import drop_near_duplicates
from cohortal.llm.secrets import redact_secrets
from tests.llm.helpers import documents, prose, repeated_words, words

TEXTS = [None, "", " \n\t ", "a", "one two\none two\n\none two\x0bx", "x " * 500, "a b c d e a b c d e f", "ä ö ü ß z #*$", "𝔘𝔫𝔦 😀 😀 😀 😀 😀 😀", "w " * 30_000]


@pytest.mark.parametrize("text", [*TEXTS, prose(random.Random(1), 400, 7), prose(random.Random(2), 9_000, 8_000) + " " + prose(random.Random(2), 60, 8_000)])
def test_quality_counts(text):
    got = quality.clean(text)
    t = text or ""
    lines = [x for x in t.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    want = (len(words(t)), sum(map(len, words(t))), len(re.findall(r"[#*$%&|<>]", t)), dup, repeated_words(t))
    assert got[:5] == want


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(4)
    clean = ".\n".join(prose(rng, 12).capitalize() for _ in range(5)) + "."
    junk = [" | ".join(prose(rng, 40).split()), "\n".join("HE!! SAYS!! THIS!! LOUD!! AND!! LONG!!" for _ in range(4)), "%%% ".join(prose(rng, 60).split())]
    rows = [(0, clean), (1, clean + "\nAll rights reserved."), (2, "Home | About | Contact\n" + clean), *[(10 + k, j) for k, j in enumerate(junk)], (20, None), (21, "")]
    got = {r.doc_id: r for r in quality.line_quality(documents(spark, rows)).collect()}
    assert got[0].kept and got[0].clean_text == clean
    assert got[1].kept and "rights" not in got[1].clean_text
    assert got[2].kept and "Contact" not in got[2].clean_text
    assert not any(got[10 + k].kept for k in range(3))
    assert got[20].base_failed and got[20].n_words == 0 and not got[21].kept


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("Alle Rechte vorbehalten.", "boilerplate"), ("Tous droits réservés", "boilerplate"), ("Todos los derechos reservados.", "boilerplate"), ("Startseite · Über uns · Kontakt", "navigation"),
        ("Accueil > Plan du site", "navigation"), ("Menú · Contacto · Quiénes somos", "navigation"), ("Er kam zur Startseite zurück.", None), ("Il faut partager le pain.", None),
    ],
)
def test_lines_in_four_languages(line, fault):
    assert quality.line_fault(words(line), line) == fault


def plain_spans(text):
    t = text or ""
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end(), 0))
    out += [("access", m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[1], x[3]))


SECRET_TEXTS = [
    None, "", "token = 'abcdef'", "Token=abc password: hunter22 PASSWD=\"x/y+z=..\"", "toKen = abcdef1 ſecret=abcdefg", "api_key : 0123456789abcdef0123456789abcdef rest",
    "AKIA" + "A1" * 8 + " AKIASHORT", "f" * 23 + " " + "f" * 24 + "\n" + "0" * 64, "secret==abcdef tokentoken=abcdefgh", "😀 apikey=zzzzzzz " + "ab" * 13,
]


@pytest.mark.parametrize("text", SECRET_TEXTS)
def test_secret_spans(text):
    want = plain_spans(text)
    got = [x for x in secrets.find(text) if x[0] in secrets.KINDS[:3]]
    assert [(k, a, b) for k, a, b, _ in got] == [(k, a, b) for k, a, b, _ in want]


def test_ownership_separates_examples_from_live_credentials(spark):
    example, live = "token = 8f14e45fceea167a5a36dedd4bea2543aa", "token = 1c383cd30b7c298ab50293adfecb7b18bb"
    rows = [(k, f"see {example} here", f"o{k}") for k in range(4)]
    rows += [(10, f"x {live} y", "o1"), (11, f"x {live} y", "o1"), (12, "password = changeme1", "o2"), (13, None, None), (14, "", "o1"), (None, f"x {live}", "o1"), (10, f"x {live} y", "o1")]
    docs = documents(spark, [r for r in rows])
    got = secrets.secret_scan(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].n_copied == 2 and by[0].n_live == 0
    assert by[10].n_live == 2 and by[10].live_spans == "assign:2:44,hex:10:44"
    assert by[12].n_weak == 1 and by[13].spans == "" and by[13].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {(r.doc_id, r.text) for r in secrets.redact_secrets(docs).collect()}
    assert (10, "x <assign> y") in masked and (0, rows[0][1]) in masked and (13, None) in masked
    assert secrets.redact_secrets(docs).count() == len(rows)
    assert secrets.secret_scan(docs.limit(0)).count() == 0


def test_weak_values_of_few_owners_are_masked(spark):
    shared = "password = changeme1"
    rows = [(k, f"see {shared}", f"o{k}") for k in range(4)]
    rows += [(10, "password=Tr0ub4dor3 x", "o1"), (11, "token = mytestvalue12345 y", "o1"), (12, f"{shared} and secret: hunter22", "o2")]
    got = {r.doc_id: r.text for r in secrets.redact_secrets(documents(spark, rows)).collect()}
    assert got[10] == "<assign> x" and got[11] == "<assign> y"
    assert got[0] == rows[0][1] and got[12] == f"{shared} and <assign>"
    assert "own_spans" not in secrets.secret_scan(documents(spark, rows)).columns


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_edited_fingerprints(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(TEXTS + [prose(rng, 40)])) for i in range(n)]
    got = {r.doc_id: r for r in FP.edited_fingerprints(documents(spark, rows), partitions=5).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        edit = t[: len(t) - c] + nxt[:c]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert got[i].fingerprint == FP.digest(t) and got[i].edited_fingerprint == FP.digest(edit)
        assert got[i].near_next == float(FP.digest(t) == FP.digest(nxt)) and got[i].near_edited == float(FP.digest(t) == FP.digest(edit))
    assert len(got) == n


def test_canonical_form_and_groups(spark):
    same = ["Straße  A\n", "STRASSE\ta", "ﬁx Å", "fix Å", " Fix å "]
    rows = [(k, t) for k, t in enumerate(same)] + [(9, None), (10, ""), (11, " \n"), (12, "other"), (None, "other"), (12, "other")]
    got = FP.fingerprint_groups(documents(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, []).append(r)
    assert sorted(len(v) for v in by.values()) == [2, 3, 3, 3]
    assert all(r.group_size == len(v) for v in by.values() for r in v)
    assert {r.group_id for r in got} == {0, 2, 9, 12}


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(FP, "digest", lambda t: "0" * 32)
    docs = documents(spark, [(1, "a"), (2, "b"), (3, "A")])
    found = FP.fingerprint_groups(docs).collect()
    by = {r.doc_id: r.fingerprint for r in found}
    assert by[1] == by[3] == "0" * 32 and by[2] not in (None, "0" * 32)


def test_digest_is_xxhash_of_canonical_bytes():
    assert FP.digest("  A  b ") == xxhash.xxh3_128_hexdigest(b"a b")
    assert FP.canonical("\ud800x") == "\ud800x" and FP.digest("\ud800")


def test_licenses(spark):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License. All rights reserved."),
        (3, "Redistribution and use in source and binary forms, with or without modification, are permitted.\nNeither the name of X may be used."),
        (4, "Neither the name of X. Redistribution and use in source and binary forms"), (5, None), (6, ""), (7, "a license to speak"), (8, "LICENSED UNDER CC BY-NC 4.0"),
        (None, "All rights reserved"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert got[1].license == "Apache-2.0" and got[2].licenses == "MIT,Proprietary"
    assert got[3].license == "BSD-3-Clause" and got[4].license == "BSD-2-Clause"
    assert got[5].license is None and got[6].n_sentences == 0 and got[7].license is None
    assert got[8].license == "CC-BY-NC" and got[None].license == "Proprietary"


def test_wrapped_licences_and_subjects(spark):
    gpl = (
        "    This program is free software{} you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
        "    the Free Software Foundation{} either version {} of the License, or\n    (at your option) any later version.\n\n"
        "    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY.\n"
    )
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS.\n'
    )
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software, to deal\nin the Software without restriction.\n\n"
        "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    )
    want = [
        (gpl.format(":", ",", 3), "GPL-3.0"), (gpl.format(";", ";", 2), "GPL-2.0"), (apache, "Apache-2.0"), (mit, "MIT"),
        ("This project is licensed under the MIT License.", "MIT"), ("It is licensed under the\nMIT License for all.", "MIT"),
        ("This work is licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("no mark here\nLicensed under CC BY-NC 4.0\nmore", "CC-BY-NC"),
        ("This is not licensed under the MIT License.", None), ("Books in the public domain are old.", None), ("It is in the public\ndomain\nand more", "Public-Domain"),
    ]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(documents(spark, [(k, t) for k, (t, _) in enumerate(want)])).collect()}
    assert [got[k] for k in range(len(want))] == [w for _, w in want]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1}General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation."""
BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
COMMENT = {"c": ("/*\n", " * ", "\n */"), "sh": ("", "# ", ""), "cpp": ("", "// ", ""), "lisp": ("", ";; ", ""), "none": ("", "", ""), "html": ("<!--\n", "", "\n-->"), "mail": ("", "> ", "")}
PUBLIC_TEXTS = [
    (APACHE, "Apache-2.0"), (MIT, "MIT"), ("MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + MIT, "MIT"), (ISC, "ISC"), ("ISC License\n\nCopyright (c) 2004 X\n\n" + ISC, "ISC"),
    (GPL.format(":", "", ",", 3), "GPL-3.0"), (GPL.format(";", "", ";", 2), "GPL-2.0"), (GPL.format(":", "Lesser ", ",", 3), "LGPL-3.0"), (GPL.format(";", "Lesser ", ";", "2.1"), "LGPL-2.1"),
    (GPL.format(":", "Affero ", ",", 3), "AGPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation", "GPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"), ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"), (BSD, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"),
    (MPL, "MPL-2.0"), ("Mozilla Public License Version 2.0\n==================================", "MPL-2.0"),
]
SHORT_TEXTS = [
    *[(f"x = 1\n{mark}SPDX-License-Identifier: {name}\nint main", want) for mark, name, want in [
        ("// ", "MIT", "MIT"), ("# ", "Apache-2.0", "Apache-2.0"), ("", "GPL-3.0-or-later", "GPL-3.0"), ("* ", "GPL-2.0-only", "GPL-2.0"), ("", "BSD-3-Clause", "BSD-3-Clause"), ("", "MPL-2.0", "MPL-2.0"),
        ("", "ISC", "ISC"), ("", "CC0-1.0", "CC0-1.0"), ("", "LGPL-2.1-only", "LGPL-2.1"), ("", "MIT OR Apache-2.0", "MIT")]],
    ("This project is licensed under the terms of the MIT license.", "MIT"), ("Released under the 3-Clause BSD License.", "BSD-3-Clause"), ("Licensed under GPLv3", "GPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA"), ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("It was not licensed under the MIT License, he said", None), ("Permission is hereby granted, free of charge, to any person obtaining a copy", None), ("free software for all", None), ("licence \n copyright", None),
    (MIT.split("The above")[0] + "word. " * 20 + "The above" + MIT.split("The above")[1], None), (None, None), ("", None), ("\n\n\n", None), ("(c) 2020", None),
    (MIT.replace("\n\n", " ").replace("\n", " "), "MIT"), (BSD3.replace("\n\n", " ").replace("\n", " "), "BSD-3-Clause"), ("y " * 50_000 + "\n" + MIT, "MIT"),
]


def licence_texts():
    for text, want in PUBLIC_TEXTS:
        for start, mark, end in COMMENT.values():
            yield start + "\n".join((mark + line).rstrip() for line in text.split("\n")) + end, want
            yield (start + "\n".join((mark + line).rstrip() for line in text.split("\n")) + end).replace("\n", "\r\n") + "\r\n\r\nint x;", want
    yield from SHORT_TEXTS


def test_public_licence_texts_and_sql(spark, tmp_path):
    rows = list(licence_texts())
    docs = documents(spark, [(k, t) for k, (t, _) in enumerate(rows)])
    got = {r.doc_id: r.asDict() for r in licenses.scan_licenses(docs).collect()}
    assert [(k, got[k]["license"]) for k in range(len(rows))] == [(k, want) for k, (_, want) in enumerate(rows)]
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    sql = licenses.oracle(f"read_parquet('{tmp_path}/d/*.parquet')")
    names = list(got[0])
    other = {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()}
    assert other == got


def test_licence_scan_runs_no_python(spark):
    plan = licenses.scan_licenses(documents(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_bit_filter_never_loses_a_key(spark):
    keys = spark.range(0, 70_000, 7).withColumnRenamed("id", "k")
    maybe = bit_filter(keys, "k")
    rows = spark.range(70_000).withColumn("m", maybe("id"))
    assert rows.where("id % 7 = 0 and not m").count() == 0
    assert rows.where("id % 7 != 0 and m").count() < 200
    assert spark.range(10).where(bit_filter(keys.limit(0), "k")("id")).count() == 0


def test_marking_never_loses_a_key_and_runs_no_python(spark):
    keys = spark.range(0, 70_000, 7).withColumnRenamed("id", "k")
    rows = marked(spark.range(70_000), "id", keys, "k", "m")
    assert rows.count() == 70_000
    assert rows.where("id % 7 = 0 and not m").count() == 0
    assert rows.where("id % 7 != 0 and m").count() < 200
    assert marked(spark.range(10), "id", keys.limit(0), "k").where("maybe").count() == 0
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_stages_that_mark_rows_have_one_python_step(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "password = hunter2hunter2"), (4, None)])
    assert "Python" not in drop_near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    one = redact_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert one.count("ArrowEvalPython") == 1
