"""Licence scans: known sentences by normalised text, then ordered rules over their identifiers.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkyard.llm.common import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (identifier, sentence); fixed values: wording of public licences and notices. They end where sentences are cut.
_SENTENCES = (
    (1, "Released under the MIT License."),
    (2, "Licensed under the MIT License."),
    (3, "This project is licensed under the MIT License."),
    (4, "Licensed under the Apache License, Version 2.0."),
    (5, "This work is licensed under the GNU General Public License, version 3."),
    (6, "Licensed under CC BY-NC 4.0."),
    (7, "Licensed under CC BY 4.0."),
    (8, "Licensed under CC BY-SA 4.0."),
    (9, "All rights reserved."),
    (10, "SPDX-License-Identifier:"),
    (11, "MIT"),
    (12, "Apache-2.0"),
    (13, "GPL-3.0-or-later"),
    (20, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    (21, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (22, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    (23, "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    (30, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (31, 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    (32, "See the License for the specific language governing permissions and limitations under the License."),
    (40, "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (41, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    (42, "See the GNU General Public License for more details."),
    (43, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    (44, "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (45, "See the GNU Affero General Public License for more details."),
    (46, "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (47, "See the GNU Lesser General Public License for more details."),
    (48, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    (50, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (51, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (52, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (53, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (60, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (61, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (62, 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    (63, "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    (64, "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (65, "This is free and unencumbered software released into the public domain."),
    (66, "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    (67, "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    (68, "This software is distributed without any warranty."),
    (69, 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    (70, "Version 2.0, January 2004"),
    (71, "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
)
#: (licence, sentence identifiers in order); fixed values.
_RULES = (
    ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)), ("MIT", (10, 11)), ("MIT", (20, 21, 22, 23)),
    ("Apache-2.0", (4,)), ("Apache-2.0", (10, 12)), ("Apache-2.0", (30, 31, 32)),
    ("Apache-2.0", (70, 71)),
    ("GPL-3.0", (5,)), ("GPL-3.0", (10, 13)), ("GPL-3.0", (40, 41, 42)), ("GPL-2.0", (43, 41, 42)),
    ("AGPL-3.0", (44, 41, 45)), ("LGPL-3.0", (46, 41, 47)), ("LGPL-2.1", (48,)),
    ("ISC", (60, 62)), ("0BSD", (61, 62)), ("MPL-2.0", (63, 64)), ("Unlicense", (65, 66)), ("CC0-1.0", (67, 68)), ("BSL-1.0", (69,)),
    ("CC-BY-NC-4.0", (6,)), ("CC-BY-4.0", (7,)), ("CC-BY-SA-4.0", (8,)),
    ("BSD-3-Clause", (50, 51, 52, 53)), ("BSD-2-Clause", (50, 51, 52)),
    ("all-rights-reserved", (9,)),
)
#: (licence, its identifiers after `SPDX-License-Identifier:`, its names in notices); fixed values.
NAMES = (
    ("MIT", ("MIT",), ("MIT License",)),
    ("Apache-2.0", ("Apache-2.0",), ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    ("GPL-3.0", ("GPL-3.0-only", "GPL-3.0-or-later"), ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3")),
    ("GPL-2.0", ("GPL-2.0-only", "GPL-2.0-or-later"), ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2")),
    ("AGPL-3.0", ("AGPL-3.0-only", "AGPL-3.0-or-later"), ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3")),
    ("LGPL-3.0", ("LGPL-3.0-only", "LGPL-3.0-or-later"), ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3")),
    ("LGPL-2.1", ("LGPL-2.1-only", "LGPL-2.1-or-later"), ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1")),
    ("BSD-3-Clause", ("BSD-3-Clause",), ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License")),
    ("BSD-2-Clause", ("BSD-2-Clause",), ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("ISC", ("ISC",), ("ISC License",)),
    ("0BSD", ("0BSD",), ("Zero-Clause BSD License", "BSD Zero Clause License")),
    ("MPL-2.0", ("MPL-2.0",), ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0")),
    ("Unlicense", ("Unlicense",), ("Unlicense",)),
    ("CC0-1.0", ("CC0-1.0",), ("CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal")),
    ("BSL-1.0", ("BSL-1.0",), ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("CC-BY-4.0", ("CC-BY-4.0",), ("Creative Commons Attribution 4.0 International License",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4.0",), ("Creative Commons Attribution-ShareAlike 4.0 International License",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4.0",), ("Creative Commons Attribution-NonCommercial 4.0 International License",)),
)
#: How notices name a licence; fixed values.
FORMS = ("Released under the {}.", "Licensed under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "This work is licensed under the {}.")
_SPDX, _NOTICE = 100, 1000  # first numbers of generated sentences


def rule_base(sentences=_SENTENCES, rules=_RULES, names=NAMES):
    """The sentences and rules, with those that the names give; a sentence that is there already keeps its number."""
    sentences, rules = list(sentences), list(rules)
    number = {normalised(s): i for i, s in reversed(sentences)}

    def sentence(text: str, first: int) -> int:
        norm = normalised(text)
        if norm not in number:
            number[norm] = max([first, *(i + 1 for i, _ in sentences if first <= i < 10 * first)])
            sentences.append((number[norm], text))
        return number[norm]

    for licence, identifiers, known in names:
        found = [(number[normalised("SPDX-License-Identifier:")], sentence(i, _SPDX)) for i in identifiers]
        found += [(sentence(form.format(name), _NOTICE),) for name in known for form in FORMS]
        rules += [(licence, ids) for ids in found if (licence, ids) not in rules]
    return tuple(sentences), tuple(rules)


def normalised(sentence: str) -> str:
    """What the expression below makes of a sentence."""
    s = "".join(c.lower() if c in UPPER else c if c in LOWER + "0123456789" else " " for c in sentence)
    return " ".join(s.split())


SENTENCES, RULES = rule_base()


def norm_column(c: Column) -> Column:
    """A-Z lower-cased, runs of all but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, UPPER, LOWER), "[^a-z0-9]+", " "))


def license_matches(docs: DataFrame, sentences=SENTENCES, rules=RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_matches, first_sentence: a row for each document and licence found in it.

    Sentences end at `.`, `!`, `?` or `:` before white space. Read by lines (a line end ends a sentence too) and
    as running text (only an empty line does), whichever has more matches of a licence counts. A rule
    matches where its identifiers follow one another among the document's known sentences; text
    between them is free. Where one rule begins another, the longer one's match replaces the shorter's. first_sentence counts all sentences from 0, by the reading that counted, by lines if
    equal. Null and empty texts match nothing; rows that repeat a doc_id are scanned apart and their
    counts add up; a null doc_id is a value like others; an empty table gives no rows. The two tables are constants of this module or of the
    caller's rule base and broadcast up to BROADCAST_BYTES; beyond that the joins shuffle.
    """
    spark = docs.sparkSession
    longest = max((len(ids) for _, ids in rules), default=1)
    numbers = {normalised(s): i for i, s in reversed(sentences)}  # of equal sentences the first
    known = small(spark.createDataFrame([(i, s) for s, i in numbers.items()], "sid int, norm string"), sum(len(s) + 50 for s in numbers))
    least = min((len(normalised(s)) for _, s in sentences), default=1)
    ruled = small(spark.createDataFrame([(name, list(ids), ids[0], len(ids)) for name, ids in rules], "license string, ids array<int>, sid int, k int"), sum(len(n) + 8 * len(ids) + 50 for n, ids in rules))

    text = F.col("text")
    by_line = F.regexp_replace(text, r"([.!?:])[ \t\r\f]+", "$1\n")
    flow = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n[ \t\r\f]*\n", "\u0001"), r"[ \t\r\f\n]+", " "), "([.!?:]) ", "$1\u0001")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").withColumn("row", F.monotonically_increasing_id())
    # Both readings of a row come from one scan, so they share its number.
    both = F.array(F.struct(F.lit(0).alias("how"), F.split(by_line, "\n").alias("l")), F.struct(F.lit(1).alias("how"), F.split(flow, "\u0001").alias("l")))
    pieces = rows.select("doc_id", "row", F.explode(both).alias("r")).select("doc_id", "row", "r.how", F.posexplode("r.l")).where(F.length("col") >= least)
    found = pieces.select("doc_id", "row", "how", "pos", norm_column(F.col("col")).alias("norm")).join(known, "norm")
    ahead = Window.partitionBy("row", "how").orderBy("pos").rowsBetween(0, longest - 1)
    follow = found.withColumn("next", F.collect_list("sid").over(ahead))
    hits = follow.join(ruled, "sid").where(F.slice("next", 1, F.col("k")) == F.col("ids"))
    best = hits.groupBy("doc_id", "row", "how", "pos").agg(F.max_by("license", F.struct("k", "license")).alias("license"))
    counted = best.groupBy("doc_id", "row", "license", "how").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    chosen = counted.groupBy("doc_id", "row", "license").agg(F.max_by(F.struct("n", "first"), F.struct("n", -F.col("how"))).alias("m"))
    return chosen.groupBy("doc_id", "license").agg(F.sum("m.n").alias("n_matches"), F.min("m.first").alias("first_sentence"))


def license_sql(sentences=SENTENCES, rules=RULES) -> str:
    """The same in DuckDB's SQL over documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {q(normalised(s))})" for i, s in sentences)
    ruled = ", ".join(f"({q(n)}, {list(ids)}, {ids[0]}, {len(ids)})" for n, ids in rules)
    longest = max(len(ids) for _, ids in rules)
    return rf"""
WITH known(sid, norm) AS (VALUES {known}), ruled(license, ids, sid, k) AS (VALUES {ruled}),
d AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents WHERE text IS NOT NULL),
lists AS (
  SELECT doc_id, row, 0 AS how, string_split(regexp_replace(text, '([.!?:])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10)) AS l FROM d
  UNION ALL
  SELECT doc_id, row, 1, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n[ \t\r\f]*\n', chr(1), 'g'), '[ \t\r\f\n]+', ' ', 'g'), '([.!?:]) ', '\1' || chr(1), 'g'), chr(1)) FROM d),
pieces AS (SELECT doc_id, row, how, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM lists),
found AS (SELECT doc_id, row, how, pos, sid FROM pieces JOIN known ON norm = trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))),
follow AS (SELECT *, list(sid) OVER (PARTITION BY row, how ORDER BY pos ROWS BETWEEN CURRENT ROW AND {longest - 1} FOLLOWING) AS next FROM found),
hits AS (SELECT f.*, r.license, r.k FROM follow f JOIN ruled r ON f.sid = r.sid WHERE list_slice(next, 1, k) = ids),
best AS (SELECT doc_id, row, how, pos, license FROM (SELECT *, row_number() OVER (PARTITION BY row, how, pos ORDER BY k DESC, license DESC) AS rn FROM hits) WHERE rn = 1),
counted AS (SELECT doc_id, row, license, how, count(*) AS n, min(pos) AS first FROM best GROUP BY ALL),
chosen AS (SELECT doc_id, license, n, first FROM (SELECT *, row_number() OVER (PARTITION BY row, license ORDER BY n DESC, how) AS rn FROM counted) WHERE rn = 1)
SELECT doc_id, license, CAST(sum(n) AS BIGINT) AS n_matches, CAST(min(first) AS INTEGER) AS first_sentence FROM chosen GROUP BY doc_id, license"""
