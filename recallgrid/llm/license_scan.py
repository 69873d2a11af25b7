"""License scans by sentence rules: known sentences become identifiers, sequences of them name licences.

A text is split into sentences; each is normalised (ASCII lower case, runs of anything but letters, digits
and dots become one space) and looked up among known licence sentences. The identifiers found, in order, are
matched against rules: a rule names a licence and lists identifiers that must follow each other among those
found. Only JVM functions are used; the dictionary is a constant, so nothing is shuffled.

Published sentences run over line feeds, colons and semicolons, where a text is split. So a known sentence is
looked for across the pieces of a paragraph: it begins and ends where pieces do, and may have their ends between
its words. Blank lines are never within a sentence. The number of sentences counts the pieces.

After German, Manabe and Inoue, A sentence-matching method for automatic license identification (2010).

Defined results: null and empty texts have no sentences, no identifiers and no licences; long texts are scanned
whole. An SPDX tag counts where it names one licence, not an expression of several. Repeated rows each
get their own result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Sentences of published licences and licence notices, normalised, and the names given to them here; * stands for one to
# eight words, such as a holder's name.
SENTENCES = {
    "mit_notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache2_notice": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0", "this work is licensed under the apache license version 2.0"],
    "apache2_may": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "gpl3_notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2_notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl_redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl3_notice": ["licensed under the gnu lesser general public license version 3"],
    "agpl3_notice": ["licensed under the gnu affero general public license version 3"],
    "mpl2_notice": ["this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission", "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission", "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "ccbync4_notice": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0"],
    "ccby4_notice": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "ccbysa4_notice": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0"],
    "cc0_notice": ["this work is dedicated to the public domain under cc0 1.0"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zero_bsd_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense_free": ["this is free and unencumbered software released into the public domain"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "lgpl21_redistribute": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"],
    "epl2_notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at *", "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution", "licensed under the eclipse public license version 2.0"],
    "bsl1_notice": ["distributed under the boost software license version 1.0", "licensed under the boost software license version 1.0"],
    "bsl1_grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
}
# Licences and the identifiers that must follow each other, in this order.
RULES = [
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_grant", "mit_keep", "as_is"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("Apache-2.0", ["apache2_may", "apache2_copy"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("GPL-2.0-only", ["gpl2_notice"]),
    ("GPL-3.0-or-later", ["gpl_redistribute", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_redistribute", "gpl_hope"]),
    ("LGPL-3.0-only", ["lgpl3_notice"]),
    ("AGPL-3.0-only", ["agpl3_notice"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("CC-BY-NC-4.0", ["ccbync4_notice"]),
    ("CC-BY-4.0", ["ccby4_notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4_notice"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["zero_bsd_grant"]),
    ("Unlicense", ["unlicense_free"]),
    ("Zlib", ["zlib_grant"]),
    ("LGPL-2.1-or-later", ["lgpl21_redistribute"]),
    ("EPL-2.0", ["epl2_notice"]),
    ("BSL-1.0", ["bsl1_notice"]),
    ("BSL-1.0", ["bsl1_grant"]),
]
# Tags of source files, `SPDX-License-Identifier: X`, are sentences of their own, one for each of these.
TAGGED = [*dict.fromkeys(name for name, _ in RULES), "LGPL-2.1-only", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "MIT-0"]
for _tag in TAGGED:
    SENTENCES[f"spdx:{_tag}"] = ["spdx license identifier " + _tag.lower().replace("-", " ")]
    RULES.append((_tag, [f"spdx:{_tag}"]))
#: Sentences end at line feeds, or at these marks where white space or the text's end follows.
SENTENCE_END = r"[.!?;:]+(?:[ \t\r\f]+|$)|[.!?;:]*\n+"
KEPT = r"[^a-z0-9.]+"
#: Between paragraphs; in joined pieces, the marks of a piece's end and of a paragraph.
BLANK = r"\n[ \t\r\f]*\n"
END, PARAGRAPH = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    """Normalised, non-empty sentences of a text."""
    normal = lambda s: F.trim(F.regexp_replace(s, KEPT, " "))
    return F.filter(F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SENTENCE_END), normal), lambda s: s != "")


def pieces(text: Column) -> Column:
    """The sentences of each paragraph in turn, and PARAGRAPH after each paragraph."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANK)
    return F.flatten(F.transform(parts, lambda p: F.concat(sentences(p), F.array(F.lit(PARAGRAPH)))))


def _bare(sentence: str) -> str:
    """A sentence without the full stops at the ends of its words, which splitting may remove."""
    return " ".join(w.rstrip(".") for w in sentence.split(" "))


#: The words that may stand for *.
ANY, ANY_WORDS = "*", 8


def _across(sentence: str) -> str:
    """A pattern of a sentence whose words may be parted by the ends of pieces."""
    word = f"[^ {END}{PARAGRAPH}]+"
    some = f"{word}(?:[ {END}]{word}){{0,{ANY_WORDS - 1}}}?"
    return f"[ {END}]".join(some if w == ANY else re.escape(w.rstrip(".")) + r"\.?" * w.endswith(".") for w in sentence.split(" "))


def identifiers(found: Column) -> Column:
    """The identifiers of known sentences in pieces, in order; of two that begin alike the longer counts."""
    every = sorted((s for same in SENTENCES.values() for s in same), key=len, reverse=True)
    known = F.create_map(*[F.lit(x) for name, same in SENTENCES.items() for s in same if ANY not in s for x in (_bare(s), name)])
    blanks = [(f"^{'.+'.join(map(re.escape, _bare(s).split(ANY)))}$", name) for name, same in SENTENCES.items() for s in same if ANY in s]

    def name_of(hit: Column) -> Column:
        bare = F.regexp_replace(F.trim(F.translate(hit, END, " ")), r"\.( |$)", "$1")
        return F.coalesce(F.try_element_at(known, bare), *[F.when(bare.rlike(p), F.lit(name)) for p, name in blanks])

    joined = F.concat(F.lit(END), F.array_join(found, END), F.lit(END))
    hits = F.regexp_extract_all(joined, F.lit(f"{END}(?:{'|'.join(map(_across, every))})(?={END})"), F.lit(0))
    return F.transform(hits, name_of)


def _sequence(rule: list[str]) -> str:
    return f",{','.join(rule)},"


def _longer(rule: list[str]) -> list[list[str]]:
    return [more for _, more in RULES if more != rule and _sequence(rule) in _sequence(more)]


def licences(ids: Column) -> Column:
    """The licences whose rules match, sorted, without repeats. A match of a rule that holds another rule's
    whole sequence stands for both."""
    joined = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    has = lambda rule: joined.contains(_sequence(rule))
    hits = [F.when(reduce(lambda c, more: c & ~has(more), _longer(rule), has(rule)), F.lit(name)) for name, rule in RULES]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sentence_ids array, licences array) of each row."""
    split = docs.select(id_col, pieces(F.col(text_col)).alias("s"))
    known = split.select(id_col, F.size(F.array_remove("s", PARAGRAPH)).cast("long").alias("n_sentences"), identifiers(F.col("s")).alias("sentence_ids"))
    return known.withColumn("licences", licences(F.col("sentence_ids")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _oracle() -> str:
    """SQL that looks for the sentences across the pieces of a paragraph, too. Pieces are parted by two marks, so that
    a match can take the one before and the one behind it."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    word = r"[^ \x01\x02]+"
    gap = r"(?: |\x01\x01)"
    some = f"{word}(?:{gap}{word}){{0,7}}?"
    every = sorted((s for same in SENTENCES.values() for s in same), key=len, reverse=True)
    shape = lambda s: gap.join(some if w == "*" else w[:-1].replace(".", "[.]") + "[.]?" if w.endswith(".") else w.replace(".", "[.]").replace("+", "[+]") for w in s.split(" "))
    known = ", ".join(f"({text(' '.join(w.rstrip('.') for w in s.split(' ')).replace('*', '%'))}, {text(name)})" for name, same in SENTENCES.items() for s in same)
    rules = ", ".join(f"({text(name)}, {text(',' + ','.join(rule) + ',')})" for name, rule in RULES)
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return rf"""
WITH known(s, name) AS (VALUES {known}), rules(licence, seq) AS (VALUES {rules}),
x AS (SELECT row_number() OVER () AS r, doc_id, {low} AS t FROM documents),
p AS (SELECT r, doc_id, list_transform(regexp_split_to_array(t, '{BLANK}'), lambda g: list_filter(list_transform(regexp_split_to_array(g, '{SENTENCE_END}'), lambda y: trim(regexp_replace(y, '{KEPT}', ' ', 'g'))), lambda y: y <> '')) AS parts FROM x),
j AS (SELECT r, doc_id, len(flatten(parts)) AS n, chr(1) || chr(1) || array_to_string(flatten(list_transform(parts, lambda g: list_append(g, chr(2)))), chr(1) || chr(1)) || chr(1) || chr(1) AS joined FROM p),
h AS (SELECT r, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM (SELECT r, regexp_extract_all(joined, '\x01(?:{'|'.join(map(shape, every))})\x01') AS hits FROM j)),
b AS (SELECT r, i, regexp_replace(trim(regexp_replace(hit, '\x01+', ' ', 'g')), '\.( |$)', '\1', 'g') AS bare FROM h),
k AS (SELECT r, string_agg(name, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, i, name FROM b JOIN known ON bare LIKE s) GROUP BY r),
m AS (SELECT r, licence, seq FROM k JOIN rules ON contains(',' || ids || ',', seq)),
l AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.r = m.r AND o.seq <> m.seq AND contains(o.seq, m.seq)) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM j LEFT JOIN k USING (r) LEFT JOIN l USING (r)
"""


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES = {"op7_license_scan": _oracle()}
