"""Holders' names, more licences, tags of source files; and the SQL twin on the same wrapped texts."""

import duckdb
import pandas as pd
import pytest

from recallgrid.llm import license_scan

from test_license_notices import BSD2, BSD3, CASES

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
ROWS = [
    (BSD3.replace("the copyright holder", "Example Industries, Inc."), "BSD-3-Clause"),
    (BSD3.replace("the copyright holder", "the <organization>").replace("its\n   contributors", "its contributors"), "BSD-3-Clause"),
    (BSD3.replace("the copyright holder", "one two three four five six seven eight nine"), "BSD-2-Clause"),  # nine words are no name
    (BSD2, "BSD-2-Clause"), (ISC, "ISC"), (ISC.split(", provided")[0] + ".", "0BSD"), (ZLIB, "Zlib"), (LGPL21, "LGPL-2.1-or-later"), (EPL, "EPL-2.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0"),
    ("Released under the\nMIT license.", "MIT"), ("Released under the\n\nMIT license.", ""),
    ("#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0-only"), ("/* SPDX-License-Identifier: Apache-2.0 */\n/* next */", "Apache-2.0"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ""), ("SPDX-License-Identifier: LicenseRef-mine", ""),
    ("Neither the name of X\x01 may be\x02 used.", ""), (None, ""), ("", ""), (BSD3 + "\n\n" + "word " * 50_000 + "\n\n" + ISC, "BSD-3-Clause,ISC"),
    *[(text, name) for name, text in CASES.items()],
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ROWS)] + [(0, ROWS[0][0])], "doc_id long, text string")
    return sorted((r["doc_id"], r["n_sentences"], ",".join(r["sentence_ids"]), ",".join(r["licences"])) for r in license_scan.license_scan(docs).collect())


def test_licences(found):
    assert [(i, x) for i, _, _, x in found] == [(0, "BSD-3-Clause"), *[(i, name) for i, (_, name) in enumerate(ROWS)]]


def test_the_twin_finds_the_same(found):
    con = duckdb.connect()
    texts = pd.Series([t for t, _ in ROWS] + [ROWS[0][0]], dtype=object)
    con.register("documents", pd.DataFrame({"doc_id": [*range(len(ROWS)), 0], "text": texts}))
    assert sorted(con.sql(license_scan.ORACLES["op7_license_scan"]).fetchall()) == found
