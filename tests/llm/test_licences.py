import re
import textwrap

from veilspark.llm import licences as lic
from veilspark.llm.common import table

SF = "/root/testdata/sf0.01"


def plain(text):
    """Rules that a text follows: (rule, number of matches)."""
    ids, known = [], lic.sentence_ids()
    for piece in re.sub(lic.BLANK, lic.CUT, re.sub(lic.AFTER, r"\1" + lic.CUT, text or "")).split(lic.CUT):
        for part in [piece, *piece.split("\n")] if "\n" in piece else [piece]:
            found = known.get(re.sub(lic.OTHER, " ", part.lower()).strip())
            ids += [found] if found else []
    out = set()
    for rule, _, _, seq in lic.rule_rows():
        n = sum(ids[i:i + len(seq)] == seq for i in range(len(ids)))
        if n:
            out.add((rule, n))
    return out


def test_query_equals_plain_rules(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = {(d.doc_id, rule, n) for d in docs for rule, n in plain(d.text)}
    got = {(r.doc_id, r.rule, r.matches) for r in lic.op2_license_rules(spark, SF).collect()}
    assert got == want and len(want) > 10


def test_whole_licences_wrapped_and_in_order(spark):
    full = {rule: text for rule, _, text in lic.RULES}
    wrapped = re.sub(r"((?:\S+\s+){7}\S+)\s", r"\1\n", full["mit-text"])
    parts = lic.sentences(full["gpl-3-header"])
    rows = [(1, "MIT License\n\nCopyright (c) me\n\n" + wrapped), (2, "heading\nreleased under the mit license\nmore words"),
            (3, ". ".join(reversed(parts))), (4, full["bsd-3-text"]), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0. " * 3000),
            (None, full["isc-text"]), (None, full["isc-text"]), (8, "A name. " + full["isc-text"]), (8, full["cc-by-4"])]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, at int, sentence string")
    got = {(r.id, r.rule, r.matches) for r in lic.licences(docs).collect()}
    assert got == {(i, rule, n) for i, t in rows for rule, n in plain(t)}
    assert {(1, "mit-text", 1), (1, "mit-grant", 1), (2, "mit-released", 1), (4, "bsd-2-text", 1), (4, "bsd-3-text", 1),
            (7, "cc-by-nc-4", 3000), (None, "isc-text", 1)} <= got
    assert not any(i == 3 for i, _, _ in got)
    assert lic.licences(docs).count() == len(got)
    assert lic.licences(docs.limit(0)).count() == 0


def test_every_rule_matches_its_own_text(spark):
    docs = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(lic.RULES)], "doc_id long, text string")
    got = {(r.id, r.rule) for r in lic.licences(docs).collect()}
    assert {(i, rule) for i, (rule, _, _) in enumerate(lic.RULES)} <= got


def test_plan_is_native(spark):
    plan = lic.op2_license_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


#: How licences are laid out in files: the header of Apache-2.0 as its appendix has it, the others as their authors publish them.
APACHE = """   Copyright 2020 A. Author

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BREAKS = {"mit-text": ["The above", "THE SOFTWARE IS"], "mit-grant": ["The above"], "isc-text": ["THE SOFTWARE IS"],
          "bsd-2-text": ["Redistributions of", "Redistributions in"],
          "bsd-3-text": ["Redistributions of", "Redistributions in", "Neither"],
          "gpl-3-header": ["This program is distributed"], "gpl-2-header": ["This program is distributed"],
          "unlicense-text": ["Anyone is free"]}


def test_canonical_layouts(spark):
    crlf, marked = APACHE.replace("\n", "\r\n"), re.sub("(?m)^ *", " * ", APACHE)
    before = APACHE.replace("LICENSE-2.0\n\n", "LICENSE-2.0\n")
    after = APACHE.replace("License at\n\n", "License at\n")
    rows = [(name, text) for name, text in (("plain", APACHE), ("crlf", crlf), ("marked", marked), ("before", before),
                                            ("after", after))]
    for rule, _, text in lic.RULES:
        for start in BREAKS.get(rule, ()):
            text = text.replace(" " + start, "\n\n" + start)
        for width in (60, 78):
            for indent in ("", "    "):
                paragraphs = [textwrap.fill(p, width, initial_indent=indent, subsequent_indent=indent, break_long_words=False,
                                            break_on_hyphens=False) for p in text.split("\n\n")]
                rows.append((rule, "A name\n\n" + "\n\n".join(paragraphs) + "\n\nAnother line\n"))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in lic.licences(docs).collect():
        got.setdefault(r.id, {})[r.rule] = r.licence
    for i, (rule, _) in enumerate(rows):
        if i < 5:
            assert list(got.get(i, {}).values()) == ["Apache-2.0"], rule
        else:
            assert rule in got.get(i, {}), rows[i]
