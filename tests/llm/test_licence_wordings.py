"""Wordings of licences beyond their own texts: expressions, references, several at once; in Spark and SQL."""

import duckdb

from cohortal.llm import licenses
from tests.llm.helpers import documents

ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute it."""
BSD4 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement: This product includes software.
4. Neither the name of the organization nor the names of its contributors may be used."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
CDDL = """The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
DUAL = """Licensed under either of

 * Apache License, Version 2.0 ([LICENSE-APACHE](LICENSE-APACHE) or http://www.apache.org/licenses/LICENSE-2.0)
 * MIT license ([LICENSE-MIT](LICENSE-MIT) or http://opensource.org/licenses/MIT)

at your option."""

#: Text, its licences in the order of the rules.
WORDINGS = [
    (GPL2, "GPL-2.0"), ("This work is licensed under CC BY 4.0.", "CC-BY"), ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA"),
    ("This code is NOT licensed under the MIT License.", ""), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0,MIT"),
    ("This project is dual-licensed under the MIT License or the Apache License.", "Apache,MIT"), ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD"), ("Use of this source code is governed by an MIT-style\nlicense that can be found here", "MIT"),
    ("It is licenced under the MIT Licence.", "MIT"), ('{"name": "x", "license": "MIT", "version": "1"}', "MIT"), (ZLIB, "Zlib"), (BOOST, "BSL-1.0"), (EPL, "EPL-2.0"), (CDDL, "CDDL"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "WTFPL"), (BSD4, "BSD-4-Clause,BSD-3-Clause,BSD-2-Clause"),
    # More of the kind.
    (DUAL, "Apache-2.0,MIT"), ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "MIT,GPL-2.0"), ("/* SPDX-License-Identifier: MPL-2.0 OR EPL-2.0 OR CDDL-1.1 OR Zlib OR BSL-1.0 */", "MPL-2.0,Zlib,BSL-1.0,EPL-2.0,CDDL-1.1"),
    ('license = "MIT OR Apache-2.0"\nedition = "2021"', "Apache-2.0,MIT"), ("Name: x\nLicense: Apache License 2.0\nAuthor: y", "Apache-2.0"), ("Name: x\nLicense: BSD-3-Clause", "BSD-3-Clause"),
    ("The software is jointly licensed under the GNU General Public License version 3 and under the Mozilla Public License 2.0.", "GPL-3.0,MPL-2.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Released under the zlib license.", "Zlib"), ("Licensed under the Common Development and Distribution License, Version 1.0", "CDDL-1.0"), ("Licensed under the EPL 1.0 or the LGPL 2.1.", "LGPL-2.1,EPL-1.0"), ("available under the WTFPL", "WTFPL"),
    ("Provided under the terms and conditions of the Apache License, Version 2.0 and nothing else.", "Apache-2.0"),
    # Nothing of a licence's.
    ("A licence or permit is governed by the state and the town.", ""), ("The origin of the licence is a misrepresented story.", ""), ("We are not dual-licensed, and no license under the sun or moon is free.", ""), ("license: see the file", ""), (None, ""), ("", ""),
]


def test_wordings_in_spark_and_sql(spark, tmp_path):
    docs = documents(spark, [(k, t) for k, (t, _) in enumerate(WORDINGS)])
    got = {r.doc_id: r.asDict() for r in licenses.scan_licenses(docs).collect()}
    assert [(t, got[k]["licenses"]) for k, (t, _) in enumerate(WORDINGS)] == [(t, want) for t, want in WORDINGS]
    docs.write.parquet(f"{tmp_path}/d")
    out = duckdb.connect().execute(licenses.oracle(f"read_parquet('{tmp_path}/d/*.parquet')"))
    names = [c[0] for c in out.description]
    assert {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in out.fetchall()} == got


def test_many_terms(spark):
    text = "SPDX-License-Identifier: " + " OR ".join(["MIT"] * 300 + ["Zlib"])
    row = licenses.scan_licenses(documents(spark, [(1, text)])).first()
    assert (row.n_sentences, row.licenses) == (301, "MIT,Zlib")
