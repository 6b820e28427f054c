"""The pattern scan: one sentence per rule, and equality with Python's ``re``."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import resolve
from veilspark.functions.scan import plain_sql, scan_sql, settled_sql
from veilspark.functions.spans import MARK, is_valid_bsn, regex_spans
from veilspark.plans.analyze import analyze_rows
from tests.conftest import SF

SENTENCES = [
    ("Bel ons op 0612345678.", "PHONE_NUMBER", "0612345678"),
    ("Bereikbaar op 0031612345678.", "PHONE_NUMBER", "0031612345678"),
    ("Bereikbaar op +31 6 12345678.", "PHONE_NUMBER", "+31 6 12345678"),
    ("Stuur een e-mail naar support@example.nl voor meer informatie.", "EMAIL", "support@example.nl"),
    ("IBAN: NL91ABNA0417164300.", "IBAN", "NL91ABNA0417164300"),
    ("Rekeningnummer: NL91 ABNA 0417 1643 00.", "IBAN", "NL91 ABNA 0417 1643 00"),
    ("Buitenland: DE89370400440532013000.", "IBAN", "DE89370400440532013000"),
    ("BSN: 111222333.", "BSN", "111222333"),
    ("BSN: 111-222-333.", "BSN", "111-222-333"),
    ("Geboortedatum: 15-03-1990.", "DATE_TIME", "15-03-1990"),
    ("Datum 2024/11/02 is gezet.", "DATE_TIME", "2024/11/02"),
    ("Datum 11.25.2024 is gezet.", "DATE_TIME", "11.25.2024"),
    ("Datum 3 12 24 is gezet.", "DATE_TIME", "3 12 24"),
    ("Op 1 september 2020 werd het ingediend.", "DATE_TIME", "1 september 2020"),
    ("Op 1 September 2020 werd het ingediend.", "DATE_TIME", "1 September 2020"),
    ("Paspoortnummer: AB1234561.", "ID_NO", "AB1234561"),
    ("BTW-nummer: NL123456789B01.", "VAT_NUMBER", "NL123456789B01"),
    ("Kenteken AB-12-CD werd gesignaleerd.", "LICENSE_PLATE", "AB-12-CD"),
    ("Kenteken 9-XX-123 werd gesignaleerd.", "LICENSE_PLATE", "9-XX-123"),
    ("Verbonden via IP 192.168.1.1.", "IP_ADDRESS", "192.168.1.1"),
    ("Zaaknummer Z-2023-12345 is in behandeling.", "CASE_NO", "Z-2023-12345"),
    ("Verzoek WOO-2024-1234 loopt.", "CASE_NO", "WOO-2024-1234"),
    ("Zaak 2023/456789 loopt.", "CASE_NO", "2023/456789"),
    ("BAG 0363010000659001 hoort erbij.", "CASE_NO", "0363010000659001"),
    ("Zaak 123e4567-e89b-12d3-a456-426614174000 loopt.", "CASE_NO", "123e4567-e89b-12d3-a456-426614174000"),
    ("Civiel C/13/123456 loopt.", "CASE_NO", "C/13/123456"),
    ("Bezwaar AWB 21/12345 ingediend.", "CASE_NO", "AWB 21/12345"),
    ("Arrest HR 21/00123 gewezen.", "CASE_NO", "HR 21/00123"),
    ("Hof 200.12345 wees toe.", "CASE_NO", "200.12345"),
    ("Parket 08/123456-89 vervolgt.", "CASE_NO", "08/123456-89"),
    ("Rechtbank RBAMS 21/12345 oordeelt.", "CASE_NO", "RBAMS 21/12345"),
    ("Rijbewijsnummer: 1234567890.", "DRIVERS_LICENSE", "1234567890"),
    ("KvK-nummer: 12345678.", "KVK_NUMBER", "12345678"),
    ("Adres 1234 AB Utrecht.", "POSTCODE", "1234 AB"),
    ("Kaart AA:BB:cc:DD:EE:0f actief.", "MAC_ADDRESS", "AA:BB:cc:DD:EE:0f"),
    ("Kaart AA-BB-CC-DD-EE-FF actief.", "MAC_ADDRESS", "AA-BB-CC-DD-EE-FF"),
    ("Kaart AABB.CCDD.EEFF actief.", "MAC_ADDRESS", "AABB.CCDD.EEFF"),
]

REJECTED = [
    ("BSN: 123456789.", "BSN"),            # checksum
    ("Adres 1234 SA Utrecht.", "POSTCODE"),
    ("Adres 0234 AB Utrecht.", "POSTCODE"),
    ("Datum 01-01-2025 IN behandeling.", "POSTCODE"),
    ("Adres 12.34.56.7890 x", "IP_ADDRESS"),
    ("IP 192.168.01.300 x", "IP_ADDRESS"),
    ("Zaaknummer 12/345678 is in behandeling.", "CASE_NO"),  # matches no case pattern
    ("Zaak 08/12345678 loopt.", "KVK_NUMBER"),
    ("Paspoort AO1234567.", "ID_NO"),
    ("x0612345678 los", "PHONE_NUMBER"),
    ("btw NL123456789B01 los", "IBAN"),
]


def test_each_rule_finds_its_value(found):
    rows = found(*[s for s, _, _ in SENTENCES])
    for i, (sentence, kind, value) in enumerate(SENTENCES):
        mine = [(r[1], r[4].rstrip(" -")) for r in rows if r[0] == i]
        assert (kind, value) in mine, (sentence, mine)


def test_each_rule_rejects(found):
    rows = found(*[s for s, _ in REJECTED])
    for i, (sentence, kind) in enumerate(REJECTED):
        assert not [r for r in rows if r[0] == i and r[1] == kind], sentence


def test_every_pattern_has_a_sentence(spark, docs):
    rows = analyze_rows(docs(*[s for s, _, _ in SENTENCES]), "all", profile="all")
    seen = {r.pattern for r in rows.select("pattern").distinct().collect()}
    # NL_DOC_NEW and NL_DOC_OLD share a span: the better score stays
    assert {r.pattern for r in catalog.builtin_catalogue()} - seen <= {"NL_DOC_OLD", "DATE_MM_DD_YYYY"} | seen


def test_phone_scores_above_licence(found):
    rows = found("Bel 0612345678.")
    scores = {r[1]: r[5] for r in rows}
    assert scores == {"PHONE_NUMBER": 0.6, "DRIVERS_LICENSE": 0.45}


def test_phone_swallows_a_space(found):
    text = "Bel mij op 06-12345678 als je er bent."
    assert [(r[2], r[3]) for r in found(text, entities=["PHONE_NUMBER"])] == [(11, 23)]
    assert [(r[2], r[3], r[4]) for r in found(text, entities=["PHONE_NUMBER"], trim_spans=True)] == [
        (11, 22, "06-12345678")]


def test_case_option(found):
    text = "kenteken ab-12-cd en iban nl91abna0417164300"
    assert found(text) == []
    assert {r[1] for r in found(text, case="insensitive")} >= {"LICENSE_PLATE", "IBAN"}
    with pytest.raises(ValueError):
        found(text, case="upper")


def test_validated_score(found):
    assert [r[5] for r in found("BSN: 111222333.", entities=["BSN"])] == [0.6]
    assert [r[5] for r in found("BSN: 111222333.", entities=["BSN"], validated_score=1.0)] == [1.0]


def test_bsn_checksum_against_plain_arithmetic(spark):
    df = spark.range(0, 3000).selectExpr("lpad(cast(id * 339733 % 1000000000 as string), 9, '0') as v")
    rows = df.select("v", is_valid_bsn("v").alias("ok")).collect()
    for r in rows:
        total = sum((9 - i) * int(r.v[i]) for i in range(8))
        assert r.ok == (total % 11 == int(r.v[8]))
    odd = spark.createDataFrame([("12345678",), (None,), ("111-222-333",), ("x",)], "v string")
    assert [r[0] for r in odd.select(is_valid_bsn("v")).collect()] == [False, False, True, False]


def python_spans(text, rows, insensitive=False):
    flags = re.IGNORECASE if insensitive else 0
    return {(r.pattern, m.start(), m.end(), m.group())
            for r in rows for m in re.finditer(r.regex, text, flags)}


def spark_spans(df, rows, insensitive=False):
    """Raw matches per pattern, before checks and duplicate removal."""
    cols = [regex_spans("text", r.regex, insensitive).alias(r.pattern) for r in rows]
    out = {}
    for row in df.select("doc_id", *cols).collect():
        out[row.doc_id] = {(r.pattern, h.start, h.end, h.text) for r in rows for h in row[r.pattern]}
    return out


@pytest.mark.parametrize("insensitive", [False, True])
def test_regex_spans_equal_python(spark, docs, letters_df, insensitive):
    rows = catalog.builtin_catalogue()
    rng = random.Random(7)
    atoms = [v for _, _, v in SENTENCES] + [
        " ", "  ", "\n", "-", "/", ".", "é", "😀", "ß", "0", "12", "NL", "AB", "a@b.nl", "12.10.20.3",
        "10.10.10.10", "x.y@z.nl|q", "SA", MARK, "_"]
    noise = ["".join(rng.choice(atoms) + rng.choice(["", " ", ", "]) for _ in range(25)) for _ in range(60)]
    df = docs(*[s for s, _, _ in SENTENCES], *noise)
    texts = {r.doc_id: r.text for r in df.collect()}
    got = spark_spans(df, rows, insensitive)
    for i, text in texts.items():
        assert got[i] == python_spans(text, rows, insensitive), text
    sample = letters_df.select("doc_id", "text")
    got = spark_spans(sample, rows, insensitive)
    for r in sample.collect():
        assert got[r.doc_id] == python_spans(r.text, rows, insensitive)


def brute_analyze(text, rows, insensitive=False):
    """Matches, checksum and same-type duplicate removal, written out plainly."""
    spans = set()
    for r in rows:
        for m in re.finditer(r.regex, text, re.IGNORECASE if insensitive else 0):
            if r.validator == "bsn":
                d = [int(c) for c in m.group() if c.isdigit()]
                if len(d) != 9 or sum((9 - i) * d[i] for i in range(8)) % 11 != d[8]:
                    continue
            spans.add((r.entity_type, m.start(), m.end(), r.score))
    return {a for a in spans if not any(
        b != a and b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] for b in spans)}


@pytest.mark.parametrize("insensitive", [False, True])
def test_grouped_scan_equals_brute_force(spark, docs, letters_df, insensitive):
    rows = catalog.builtin_catalogue()
    case = "insensitive" if insensitive else "as_written"
    rng = random.Random(11)
    atoms = [v for _, _, v in SENTENCES] + [" ", "\n", "-", "/", "12", "é", "😀", "10.10.10.10", "0"]
    noise = ["x" + "".join(rng.choice(atoms) + rng.choice(["", " ", ", "]) for _ in range(30)) + "x" for _ in range(80)]
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (docs(*noise), letters_df.select("doc_id", "text"), documents):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = {i: set() for i in texts}
        for r in analyze_rows(df, "all", profile="all", case=case).collect():
            assert texts[r.doc_id].strip()[r.start:r.end] == r.text
            got[r.doc_id].add((r.entity_type, r.start, r.end, r.score))
        for i, text in texts.items():
            assert got[i] == brute_analyze((text or "").strip(), rows, insensitive), text


def test_offsets_count_code_points(found):
    rows = found("😀 é 😀 mail a.b@c.nl 😀", entities=["EMAIL"])
    text = "😀 é 😀 mail a.b@c.nl 😀"
    assert [text[r[2]:r[3]] for r in rows] == ["a.b@c.nl"]


def test_text_with_the_mark_character(found):
    text = f"a{MARK}b mail a.b@c.nl {MARK} IP 10.0.0.1"
    assert {(text[r[2]:r[3]], r[4]) for r in found(text)} == {("a.b@c.nl",) * 2, ("10.0.0.1",) * 2}


def test_long_text(found):
    text = ("woord " * 3000 + "mail a.b@c.nl en ") * 5
    rows = found(text, entities=["EMAIL"])
    assert len(rows) == 5 and all(text.strip()[r[2]:r[3]] == "a.b@c.nl" for r in rows)


def test_null_and_no_match(spark):
    df = spark.createDataFrame([(None,), ("niets",)], "text string")
    got = [r[0] for r in df.select(regex_spans("text", r"\d+")).collect()]
    assert got == [None, []]


def test_every_match_holds_what_its_pattern_needs(found):
    """Hints on strings change no result, also where case is ignored."""
    text = ("nl91abna0417164300 NL91ABNA0417164300 nl123456789b01 ab-12-cd AB-12-CD z-2023-00001 woo-2023-001 WP/2023/001 "
            "c/13/123456 AWB 21/1234 awb 21/1234 hr 22/12345 200.12345 08/123456-23 rbams 20/1234 1.2.3.4")
    for case in ("as_written", "insensitive"):
        with_hints = found(text, case=case)
        plain = [replace(r, needs=()) for r in catalog.builtin_catalogue()]
        assert with_hints and with_hints == found(text, case=case, catalogue=plain)


def test_one_pass_finds_what_passes_row_by_row_find(spark):
    """Texts of a few pieces of identifiers, so that matches of one row overlap, touch and end in unlike places."""
    pieces = ["0", "06", "+31", "12", "123", "1234", "12345678", "0612345678", "NL91", "ABNA", "DE12 3456 7890 ", "B01", "ZX", "WOO",
              "AWB", "200.", "C/", "-", "/", " ", ".", ":", "AB", "3f", "EF", "2023", "1-2-20", "-12-2020", " mei ", "111222333", "_",
              "é", "\u0301", "\u0663", "(", "\n", "\u017f", "\x85", "\x02", "\U0001f600", "a@b.nl", "00112233-", "1000 AB"]
    draw = random.Random(3)
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    texts += ["AB12 3456 7890 " * 8, "0612345678 " * 500, "", "XY1111117"]
    rows = catalog.builtin_catalogue()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for insensitive in (False, True):
        by_row = resolve.stable_order("u")
        both = df.withColumn("r", F.expr(scan_sql("text", rows, insensitive, 0.45, plain="false"))).withColumn(
            "u", F.expr(resolve.dedup_same_type("r"))).withColumn("want", F.expr(by_row)).withColumn(
            "p", F.expr(plain_sql("text"))).withColumn("got", F.expr(scan_sql("text", rows, insensitive, 0.45, "p"))).withColumn(
            "still", F.expr(settled_sql("text", rows, "p")))
        seen = both.selectExpr("text", "still", "got", "want", "r").collect()
        assert sum(r.still for r in seen) > 300 and not all(r.still for r in seen)
        assert all(r.got == r.want for r in seen if r.still)
        assert all({tuple(s) for s in r.want} <= {tuple(s) for s in r.got} for r in seen)
        assert any(len(r.r) > len(r.want) for r in seen if r.still)
