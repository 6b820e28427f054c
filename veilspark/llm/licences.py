"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences: after ``. ! ? ; :`` before white space, and at blank lines. A sentence that runs over lines is
tried whole and line by line, since licence lines are wrapped as well as put alone below other text. Normalised
sentences (lower-case letters and digits, all else one space) are joined with the table of known licence
sentences, which gives each its identifier. That table comes with the rules, not the data; up to ``BROADCAST_CHARS``
it is broadcast and only the known sentences are shuffled, beyond that Spark joins it as it finds best. A document's identifiers in order are then matched with
the rules: each licence or notice is an ordered sequence of identifiers, found wherever the document's sequence holds it
without another known sentence between. Rules are looked up by their first identifier.

Results for odd input: a null or empty text matches nothing; rows with null ids are kept apart by their text; rows equal
in id and text are reported once; several matches of a rule in a document are one row with their number; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table

# Rule name, licence, text. The texts are the licences' own words and common notices.
RULES = (
    ("mit-text", "MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
     "IN THE SOFTWARE."),
    ("mit-grant", "MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software."),
    ("mit-released", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mit-project", "MIT", "This project is licensed under the MIT License."),
    ("isc-text", "ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
     "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("bsd-2-text", "BSD-2-Clause",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("bsd-3-text", "BSD-3-Clause",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("apache-2-header", "Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
     "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("apache-2-licensed", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-released", "Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("gpl-3-header", "GPL-3.0-or-later",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
     "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
     "details."),
    ("gpl-2-header", "GPL-2.0-or-later",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
     "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
     "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
     "details."),
    ("gpl-3-work", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2-work", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("mpl-2-header", "MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense-text", "Unlicense",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
     "commercial or non-commercial, and by any means."),
    ("cc-by-4", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4-work", "CC-BY-4.0",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4-work", "CC-BY-SA-4.0",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-work", "CC0-1.0",
     "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # the same header with blank lines around its address, or one before it: what they part are sentences of their own, of
    # which the address, and the line that leads to it, are not asked for
    *((name, "Apache-2.0",
       "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
       f"with the License. {address}Unless required by applicable law or agreed to in writing, software distributed under "
       "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
       "implied. See the License for the specific language governing permissions and limitations under the License.")
      for name, address in (("apache-2-header-spaced", ""),
                            ("apache-2-header-spaced-before", "http://www.apache.org/licenses/LICENSE-2.0 "))),
)
# end of fixed values

CUT = "\x1e"
AFTER = r"([.!?;:])[ \t\n\r\f]+"
BLANK = r"\n[ \t\r\f]*\n[ \t\n\r\f]*"
OTHER = "[^a-z0-9]+"
BROADCAST_CHARS = 4_000_000


def sentences(text: str) -> list[str]:
    """Normalised sentences of a rule's text, which has no line ends."""
    parts = re.sub(AFTER, r"\1" + CUT, text).split(CUT)
    return [s for s in (re.sub(OTHER, " ", p.lower()).strip() for p in parts) if s]


def sentence_ids(rules=RULES) -> dict[str, int]:
    found: dict[str, int] = {}
    for _, _, text in rules:
        for sentence in sentences(text):
            found.setdefault(sentence, len(found) + 1)
    return found


def rule_rows(rules=RULES) -> list[tuple[str, str, int, list[int]]]:
    """(rule, licence, first identifier, identifiers)"""
    ids = sentence_ids(rules)
    rows = [(name, licence, [ids[s] for s in sentences(text)]) for name, licence, text in rules]
    return [(name, licence, sequence[0], sequence) for name, licence, sequence in rows if sequence]


def small(df: DataFrame, values: list) -> DataFrame:
    """The table of rules or sentences, to be broadcast while its values have less than ``BROADCAST_CHARS`` characters."""
    return F.broadcast(df) if len(str(values)) < BROADCAST_CHARS else df


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), OTHER, " "))


def known_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, mark, at, part, sentence_id): each known sentence of a text, by its place; ``mark`` tells texts of one id apart."""
    spark = docs.sparkSession
    values = list(sentence_ids(rules).items())
    known = small(spark.createDataFrame(values, "sentence string, sentence_id int"), values)
    cut = F.split(F.regexp_replace(F.regexp_replace(F.col(text_col), AFTER, f"$1{CUT}"), BLANK, CUT), CUT)
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.posexplode(cut).alias("at", "piece"))
    lines = F.when(F.instr("piece", "\n") > 0, F.concat(F.array("piece"), F.split("piece", "\n"))).otherwise(F.array("piece"))
    each = whole.select("id", "mark", "at", F.posexplode(lines).alias("part", "piece"))
    return (each.select("id", "mark", "at", "part", normal(F.col("piece")).alias("sentence"))
            .join(known, "sentence").select("id", "mark", "at", "part", "sentence_id"))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, rule, licence, matches, first_sentence): a row for each rule that a text's sentences follow."""
    spark = docs.sparkSession
    values = rule_rows(rules)
    patterns = small(spark.createDataFrame(values, "rule string, licence string, first int, sequence array<int>"), values)
    found = known_sentences(docs, id_col, text_col, rules).distinct()
    ordered = found.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("at", "part", "sentence_id"))).alias("s"))
    held = ordered.select("id", "mark", F.col("s.at").alias("places"), F.col("s.sentence_id").alias("ids"))
    tried = held.withColumn("first", F.explode(F.array_distinct("ids"))).join(patterns, "first")
    starts = F.filter(F.sequence(F.lit(1), F.size("ids")),
                      lambda i: F.slice(F.col("ids"), i, F.size("sequence")) == F.col("sequence"))
    matched = tried.withColumn("starts", starts).where(F.size("starts") > 0)
    return matched.select("id", "rule", "licence", F.size("starts").cast("long").alias("matches"),
                          F.element_at("places", F.col("starts")[0]).cast("long").alias("first_sentence"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence rule that a document's sentences follow."""
    found = licences(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "rule", "licence", "matches", "first_sentence")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


ORACLE = f"""
WITH known(sentence, sid) AS (VALUES {", ".join(f"({_sql_text(s)}, {i})" for s, i in sentence_ids().items())}),
rules(rule, licence, seq) AS (VALUES {", ".join(f"({_sql_text(r)}, {_sql_text(li)}, {q})" for r, li, _, q in rule_rows())}),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?;:])[ \\t\\n\\r\\f]+', '\\1' || chr(30), 'g'),
          '\\n[ \\t\\r\\f]*\\n[ \\t\\n\\r\\f]*', chr(30), 'g'), chr(30)) AS w FROM documents),
whole AS (SELECT doc_id, unnest(w) AS piece, generate_subscripts(w, 1) - 1 AS pos FROM cut),
parts AS (SELECT doc_id, pos, CASE WHEN contains(piece, chr(10)) THEN list_concat([piece], string_split(piece, chr(10)))
          ELSE [piece] END AS q FROM whole),
each AS (SELECT doc_id, pos, unnest(q) AS piece, generate_subscripts(q, 1) AS part FROM parts),
found AS (SELECT doc_id, pos, part, sid FROM (SELECT doc_id, pos, part,
            trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM each) JOIN known USING (sentence)),
docs AS (SELECT doc_id, list(sid ORDER BY pos, part) AS ids, list(pos ORDER BY pos, part) AS places FROM found GROUP BY doc_id),
hits AS (SELECT doc_id, rule, licence, places, list_filter(range(1, CAST(len(ids) AS INTEGER) + 1),
           lambda i: ids[i:i + len(seq) - 1] = seq) AS starts
         FROM docs JOIN rules ON list_contains(ids, seq[1]))
SELECT doc_id, rule, licence, CAST(len(starts) AS BIGINT) AS matches, CAST(places[starts[1]] AS BIGINT) AS first_sentence
FROM hits WHERE len(starts) > 0
"""
