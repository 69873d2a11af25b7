"""Real licence notices, wrapped and punctuated as published."""

import pytest

from recallgrid.llm import license_scan

MIT = """Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
CASES = {"MIT": MIT, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "MPL-2.0": MPL, "Apache-2.0": APACHE, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}


def scan(spark, texts):
    out = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r["licences"] for r in out.orderBy("doc_id").collect()]


@pytest.mark.parametrize("form", ["wrapped", "comment", "windows", "one line"])
def test_real_notices(spark, form):
    as_form = {
        "wrapped": lambda t: t,
        "comment": lambda t: "\n".join(f" * {x}" if x else "" for x in t.split("\n")),
        "windows": lambda t: t.replace("\n", "\r\n"),
        "one line": lambda t: " ".join(t.removeprefix("Copyright (c) 2024 Someone").split()),  # a name without a mark would run into the grant
    }[form]
    assert scan(spark, [as_form(t) for t in CASES.values()]) == [[name] for name in CASES]


def test_no_sentence_over_a_blank_line_or_within_another(spark):
    assert scan(spark, ["Released under the\n\nMIT License.", "It was not released under the\nMIT License", "Released under\nthe MIT License now", "Released under the\nMIT License"]) == [[], [], [], ["MIT"]]
