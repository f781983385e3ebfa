"""Licence scan by sentence rules, in DataFrame functions alone.

A text's known licence sentences map to identifiers: a sentence is recognised where it stands between two ends, of
sentences or of lines, however its words are spread over lines. Read from left to right, the longest one at each place,
they are one sequence of identifiers; ordered rules, each a licence's run of identifiers, are matched against it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.url_rules import LOWER, UPPER

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "apache2-long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "unlicense-released": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-available": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "boost-grant": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-provided": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "wtfpl-work": "This program is free software. It comes without any warranty, to the extent permitted by applicable law.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

# Licences by SPDX identifier and what prose calls them.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "BSD-4-Clause": ["the BSD 4-Clause License"],
    "0BSD": ["the Zero-Clause BSD License"],
    "ISC": ["the ISC License"],
    "Zlib": ["the zlib License"],
    "Unlicense": ["the Unlicense"],
    "WTFPL": ["the WTFPL"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "Artistic-2.0": ["the Artistic License 2.0"],
    "PostgreSQL": ["the PostgreSQL License"],
    "Python-2.0": ["the Python Software Foundation License"],
    "PHP-3.01": ["the PHP License, version 3.01"],
    "OFL-1.1": ["the SIL Open Font License, Version 1.1"],
    "MS-PL": ["the Microsoft Public License"],
    "CDDL-1.0": ["the Common Development and Distribution License 1.0"],
    "MPL-1.1": ["the Mozilla Public License 1.1"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0"],
    "EPL-1.0": ["the Eclipse Public License 1.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0"],
    "EUPL-1.2": ["the European Union Public Licence 1.2", "the EUPL 1.2"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "GPL-2.0-or-later": ["the GNU General Public License, version 2 or later", "the GNU GPL v2 or later"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "GPL-3.0-or-later": ["the GNU General Public License, version 3 or later", "the GNU GPL v3 or later"],
    "LGPL-2.1-only": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-2.1-or-later": ["the GNU Lesser General Public License, version 2.1 or later"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3"],
    "LGPL-3.0-or-later": ["the GNU Lesser General Public License, version 3 or later"],
    "AGPL-3.0-only": ["the GNU Affero General Public License, version 3"],
    "AGPL-3.0-or-later": ["the GNU Affero General Public License, version 3 or later"],
    "CC0-1.0": ["CC0 1.0", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-3.0": ["CC BY 3.0", "a Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "ODbL-1.0": ["the Open Database License 1.0"],
    "ODC-By-1.0": ["the Open Data Commons Attribution License 1.0"],
}

# How a notice says it, around a name, and the line that states an identifier.
PHRASES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is released under {}.", "This file is licensed under {}."]
SPDX = "SPDX-License-Identifier: {}"

# Ordered rules of whole notices: the first that fits takes its sentences, so longer runs stand before the shorter ones
# they contain. After them, each named licence has a rule of its own.
NOTICES = [
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("Apache-2.0", ["apache2-long", "apache2-copy", "apache2-unless", "apache2-limits"]),
    ("Apache-2.0", ["apache2-long", "apache2-copy"]),
    ("Apache-2.0", ["apache2-long"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-provided", "zlib-permission"]),
    ("Unlicense", ["unlicense-released", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-released"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("EPL-2.0", ["epl2-available"]),
    ("EPL-1.0", ["epl1-available"]),
    ("BSL-1.0", ["boost-grant"]),
    ("CC0-1.0", ["cc0-waiver"]),
]
RULES = NOTICES + [(name, [name]) for name in NAMES]

MARK, LINE = "\u0002", "\u0003"
STOP = r"[.!?:]+(\s+|$)"


def normal(sentence: str) -> str:
    """A-Z lower-cased, every run of other characters than a-z and 0-9 one blank, ends trimmed."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def catalogue(sentences: dict[str, str] = SENTENCES, names: dict[str, list[str]] = NAMES) -> dict[str, str]:
    """Normalised sentence -> identifier: sentences of their own, then each name in each phrase, under the licence's name."""
    known: dict[str, str] = {}
    for name, text in sentences.items():
        known.setdefault(normal(text), name)
    for name, own in names.items():
        for text in [SPDX.format(name), *[p.format(x) for x in own for p in PHRASES]]:
            known.setdefault(normal(text), name)
    return {k: v for k, v in known.items() if k}


KNOWN = catalogue()


def anchors(known: Sequence[str]) -> list[str]:
    """A few words of which every known sentence holds one: other texts needn't be searched."""
    left, out = set(known), []
    while left:
        count: dict[str, int] = {}
        for sentence in left:
            for word in set(sentence.split()):
                count[word] = count.get(word, 0) + len(word) ** 2  # long words are rare
        best = max(sorted(count), key=count.__getitem__)
        out.append(best)
        left = {s for s in left if best not in s}
    return out


def recognised(text: Column, known: Sequence[str]) -> Column:
    """The known sentences of a text in order, normalised: each between two ends, of sentences (`.`, `!`, `?` or `:` before
    white space or the end) or of lines, over any number of lines. At one place the longest counts; the next one begins after
    it. Other signs than a-z and 0-9 (comment marks) don't count."""
    x = F.translate(text, UPPER + MARK + LINE, LOWER + "  ")
    x = F.regexp_replace(x, STOP, MARK)
    x = F.regexp_replace(F.translate(x, "\n", LINE), f"[^a-z0-9{MARK}{LINE}]+", " ")
    # Blanks stand alone by now, so at most one is between an end and the next word.
    some = "|".join(k.replace(" ", f"[ {LINE}{MARK}]++") for k in sorted(known, key=len, reverse=True))
    runs = F.regexp_extract_all(x, F.lit(f"(?:^|[{MARK}{LINE}]) ?({some})(?! ?[a-z0-9])"), F.lit(1))
    return F.transform(runs, lambda s: F.regexp_replace(s, f"[ {LINE}{MARK}]+", " "))


def scan_licences(docs: DataFrame, known: dict[str, str] = KNOWN, rules: Sequence[tuple[str, Sequence[str]]] = RULES, text_col: str = "text") -> DataFrame:
    """Adds licences, rules_hit and sentence_ids (arrays of strings, numbers and strings) to every row; no shuffle, no row
    lost or added.

    sentence_ids: the identifiers of the recognised sentences in the order of the text. Rules apply in their order; a rule
    whose identifiers stand in a row takes all such runs out, and the rules after it see the rest. rules_hit: the rules'
    numbers from 1; licences: their distinct names in that order. A null or empty text has empty arrays. Columns of `docs`
    with these names are replaced. Only texts that hold one of a few words of the known sentences are searched.
    """
    numbers = {name: str(i) for i, name in enumerate(dict.fromkeys(known.values()))}
    to_name = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    to_number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    possible = [(k, name, run) for k, (name, run) in enumerate(rules, 1) if all(x in numbers for x in run)]
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f",{',,'.join(numbers[x] for x in run)},").alias("run")) for k, _, run in possible])
    names_of = F.array(*[F.lit(name) for name, _ in rules])
    none = F.array().cast("array<string>")

    def ids(text: Column) -> Column:
        low = F.lower(text)
        some = F.lit(False)
        for word in anchors(list(known)):
            some = some | F.contains(low, F.lit(word))
        return F.coalesce(F.when(some, F.transform(recognised(text, list(known)), lambda s: to_name[s])), none)

    def matched(seen: Column) -> Column:
        # Between any two identifiers stand two commas, so that one run's end isn't the next one's beginning.
        line = F.concat(F.lit(","), F.array_join(F.transform(seen, lambda s: to_number[s]), ",,"), F.lit(","))
        runs = F.aggregate(
            table,
            F.struct(line.alias("left"), F.array().cast("array<int>").alias("hit")),
            lambda acc, r: F.when(
                F.contains(acc["left"], r["run"]),
                F.struct(F.replace(acc["left"], r["run"], F.lit("|")).alias("left"), F.concat(acc["hit"], F.array(r["k"])).alias("hit")),
            ).otherwise(acc),
        )
        return F.when(F.size(seen) > 0, runs["hit"]).otherwise(F.array().cast("array<int>"))

    # One struct, made anew at each step, so that no column of `docs` can clash with what is worked out.
    kept = [F.col(c) for c in docs.columns if c not in {"licences", "rules_hit", "sentence_ids"}]
    seen = F.transform(F.array(ids(F.coalesce(F.col(text_col), F.lit("")))), lambda s: F.struct(s.alias("ids"), matched(s).alias("hit")))
    both = F.get(seen, F.lit(0))
    out = docs.select(*kept, F.inline(F.array(F.struct(both["ids"].alias("sentence_ids"), both["hit"].alias("rules_hit")))))
    return out.select(*[F.col(c) for c in out.columns if c not in {"rules_hit", "sentence_ids"}], F.array_distinct(F.transform("rules_hit", lambda k: names_of[k - 1])).alias("licences"), "rules_hit", "sentence_ids")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, licences, rules_hit and sentence_ids, each joined by commas (empty: none).

    Every row gives one, repeated ids too; null and empty texts have none. An empty table gives no rows. Only doc_id and
    text are read.
    """
    out = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join(F.col("rules_hit").cast("array<string>"), ",").alias("rules_hit"), F.array_join("sentence_ids", ",").alias("sentence_ids"))


def oracle() -> str:
    """The same scan as DuckDB SQL, by another way: a text's pieces between ends, runs of them that make up a known sentence,
    the longest of each start, then greedily from left to right, and the rules by replacement."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    numbers = {name: i for i, name in enumerate(dict.fromkeys(KNOWN.values()))}
    rows = ", ".join(f"({quoted(s)}, {len(s.split())}, {quoted(n)}, '{numbers[n]}')" for s, n in KNOWN.items())
    ends = rf"regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}' || chr(2) || chr(3), '{LOWER}  '), '[.!?:]+(\s+|$)', chr(2), 'g'), '\n', chr(2), 'g')"
    steps, before = [], "m0"
    for k, (_, run) in enumerate(RULES, 1):
        own = f",{',,'.join(str(numbers[x]) for x in run)},"
        steps.append(f"m{k} AS (SELECT row, replace(line, '{own}', '|') AS line, CASE WHEN contains(line, '{own}') THEN list_append(hit, {k}) ELSE hit END AS hit FROM {before})")
        before = f"m{k}"
    names = "[" + ", ".join(quoted(n) for n, _ in RULES) + "]"
    return f"""
WITH RECURSIVE known(sentence, words, name, number) AS (VALUES {rows}),
docs AS (SELECT doc_id, row_number() OVER () AS row, list_filter(list_transform(string_split({ends}, chr(2)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS pieces FROM documents),
flat AS (SELECT row, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM docs),
sized AS (SELECT *, sum(len(string_split(piece, ' '))) OVER (PARTITION BY row ORDER BY i)::BIGINT AS upto FROM flat),
begun AS (SELECT s.row, s.i, s.upto - len(string_split(s.piece, ' ')) AS before, k.* FROM sized s JOIN known k ON starts_with(k.sentence, s.piece)),
found AS (SELECT b.row, b.i, e.i AS j, b.words, b.name, b.number FROM begun b JOIN sized e ON e.row = b.row AND e.upto = b.before + b.words JOIN docs d ON d.row = b.row WHERE array_to_string(d.pieces[b.i:e.i], ' ') = b.sentence),
longest AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY row, i ORDER BY words DESC) = 1),
taken AS (
  SELECT * FROM (SELECT * FROM longest QUALIFY row_number() OVER (PARTITION BY row ORDER BY i) = 1)
  UNION ALL
  SELECT row, i, j, words, name, number FROM (SELECT l.*, row_number() OVER (PARTITION BY l.row ORDER BY l.i) AS k FROM taken t JOIN longest l ON l.row = t.row AND l.i > t.j) WHERE k = 1
),
seen AS (SELECT row, string_agg(number, ',,' ORDER BY i) AS line, string_agg(name, ',' ORDER BY i) AS names FROM taken GROUP BY row),
m0 AS MATERIALIZED (SELECT row, ',' || line || ',' AS line, []::INTEGER[] AS hit FROM seen),
{', '.join(steps)}
SELECT d.doc_id, array_to_string(list_distinct_in_order, ',') AS licences, array_to_string(coalesce(m.hit, []), ',') AS rules_hit, coalesce(s.names, '') AS sentence_ids
FROM docs d LEFT JOIN seen s USING (row) LEFT JOIN {before} m USING (row),
LATERAL (SELECT coalesce(list(n ORDER BY k), []) AS list_distinct_in_order FROM (SELECT {names}[x] AS n, min(x) AS k FROM (SELECT unnest(m.hit) AS x) GROUP BY 1))
"""
