import hashlib

import pytest
from pyspark.sql import functions as F

from veilspark.catalog import Recognizer
from veilspark.plans.analyze import analyze, analyze_rows, anonymize

LETTER = (
    "Op 15-03-2023 heeft Jan Jansen (BSN: 111222333) een aanvraag ingediend bij Gemeente Amsterdam. "
    "Zijn contactgegevens: jan.jansen@example.com, tel 0612345678. "
    "Bankrekeningnummer: NL91ABNA0417164300. Zaaknummer: Z-2023-12345.")
VALUES = ["111222333", "jan.jansen@example.com", "0612345678", "NL91ABNA0417164300", "15-03-2023"]


def text_of(df):
    return [r.anonymized_text for r in df.orderBy("doc_id").collect()]


def test_default_types(docs):
    kinds = {r.entity_type for r in analyze_rows(docs(LETTER)).collect()}
    assert kinds == {"EMAIL", "PHONE_NUMBER", "IBAN", "BSN", "DATE_TIME"}


def test_replace(docs):
    got = text_of(anonymize(docs(LETTER)))[0]
    assert not [v for v in VALUES if v in got]
    assert "Z-2023-12345" in got  # not among the default types
    assert "(BSN: <BSN>)" in got and "tel <PHONE_NUMBER>." in got


def test_strategies(docs):
    results = {s: text_of(anonymize(docs(LETTER), strategy=s))[0] for s in ("replace", "redact", "mask", "hash")}
    assert len(set(results.values())) == 4
    assert not [1 for r in results.values() for v in VALUES if v in r]
    assert "tel ******5678." in results["mask"]
    assert hashlib.sha256(b"111222333").hexdigest() in results["hash"]
    assert "(BSN: )" in results["redact"]


def test_only_requested_types_change(docs):
    got = text_of(anonymize(docs(LETTER), ["IBAN"]))[0]
    assert "<IBAN>" in got and "0612345678" in got and "jan.jansen@example.com" in got


def test_entities_found_equals_analyze(docs):
    a = analyze(docs(LETTER), "all").first().pii_entities
    b = anonymize(docs(LETTER), "all").first().entities_found
    assert a == b


def test_mask_options(docs):
    d = docs("bsn 111222333 x", "1.1.1.1")
    get = lambda **o: text_of(anonymize(d, ["BSN", "IP_ADDRESS"], "mask", **o))
    assert get() == ["bsn ******333 x", "******1"]
    assert get(mask_options={"chars_to_mask": 20, "masking_char": "#"}) == ["bsn ######### x", "#######"]
    assert get(mask_options={"chars_to_mask": 2, "from_end": True}) == ["bsn 1112223** x", "1.1.1**"]


def test_operators_per_type_and_salt(docs):
    got = text_of(anonymize(docs(LETTER), operators={"BSN": "hash", "EMAIL": "redact"}, salt="s"))[0]
    assert hashlib.sha256(b"s111222333").hexdigest() in got
    assert "contactgegevens: , tel <PHONE_NUMBER>" in got
    with pytest.raises(ValueError):
        anonymize(docs(LETTER), operators={"BSN": "shred"})


def test_strategy_column(spark):
    df = spark.createDataFrame(
        [(0, "bsn 111222333", "hash"), (1, "bsn 111222333", None), (2, "bsn 111222333", "redact")],
        "doc_id bigint, text string, how string")
    rows = anonymize(df, strategy_col="how").orderBy("doc_id").collect()
    assert [r.anonymization_strategy for r in rows] == ["hash", "replace", "redact"]
    assert rows[0].anonymized_text == "bsn " + hashlib.sha256(b"111222333").hexdigest()
    assert [r.anonymized_text for r in rows[1:]] == ["bsn <BSN>", "bsn "]


def test_unicode_and_long_text(docs):
    unit = "é😀 mail a.b@c.nl en bsn 111222333, "
    text = (unit * 900).strip()
    got = text_of(anonymize(docs(text, "😀a.b@c.nl😀")))
    assert got[0] == (unit.replace("a.b@c.nl", "<EMAIL>").replace("111222333", "<BSN>") * 900).strip()
    assert got[1] == "😀<EMAIL>😀"
    hashed = text_of(anonymize(docs(text), strategy="hash"))[0]
    assert hashed.count(hashlib.sha256(b"111222333").hexdigest()) == 900


def test_conflicts(docs):
    # a date inside a case-like number; an MAC address whose tail is a date
    got = text_of(anonymize(docs("Bel 0612345678, zaak Z-2023-12345."), "all"))
    assert got == ["Bel <PHONE_NUMBER>, zaak <CASE_NO>."]


def test_merge_adjacent(docs):
    d = docs("Bel 12345678 87654321 nu.")
    plain = text_of(anonymize(d, ["KVK_NUMBER"], extra=[]))
    extra = [Recognizer("r", "CODE", "c", r"\b[A-Z]\d\b", 0.5)]
    assert plain == ["Bel <KVK_NUMBER> 87654321 nu."]
    d = docs("Code A1  B2 en C3.")
    assert text_of(anonymize(d, ["CODE"], extra=extra)) == ["Code <CODE>  <CODE> en <CODE>."]
    assert text_of(anonymize(d, ["CODE"], extra=extra, merge_adjacent=True)) == ["Code <CODE> en <CODE>."]
    assert text_of(anonymize(d, ["CODE"], "hash", extra=extra, merge_adjacent=True))[0].startswith(
        "Code " + hashlib.sha256(b"A1  B2").hexdigest())


def test_no_resolved_value_survives(letters_df):
    out = anonymize(letters_df.select("doc_id", "text"), "all", profile="all")
    left = out.select("doc_id", "anonymized_text", F.explode("entities_found.text").alias("v")).filter(
        F.col("anonymized_text").contains(F.col("v")))
    assert left.count() == 0


def test_gap_text_is_untouched(docs):
    assert text_of(anonymize(docs("niets te zien", "  111222333  "), "all")) == ["niets te zien", "<BSN>"]


def test_drop_original(docs):
    assert "original_text" not in anonymize(docs(LETTER), keep_original=False).columns


def test_custom_recognizer_and_validator(docs):
    def even(value):
        return f"int(right({value}, 1)) % 2 = 0"
    extra = [Recognizer("order", "ORDER_NO", "o", r"\bORD'\d{3}\b", 0.7, validator=even)]
    rows = analyze_rows(docs("ORD'123 ORD'124"), ["ORDER_NO"], extra=extra).collect()
    assert [(r.text, r.score, r.recognizer) for r in rows] == [("ORD'124", 0.7, "order")]


def test_plan_is_one_map(docs, spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = anonymize(df, "all", "hash")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    rows = analyze_rows(df, "all")._jdf.queryExecution().executedPlan().toString()
    # the expression of one pattern: in its group's guard and in its own scan, once each
    assert "Exchange" not in rows
    assert rows.count(r"(?=AWB)\bAWB") == 2 and rows.count(r"(?U)(?=AWB)\bAWB") == 1


def test_filters_do_not_repeat_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hit = analyze(df, "all").filter(F.size("pii_entities") > 0)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"(?U)(?=AWB)\bAWB") == 1 and hit.count() > 0
    new = anonymize(df, "all").filter(F.col("anonymized_text") != F.col("original_text"))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"(?U)(?=AWB)\bAWB") == 1 and new.count() == hit.count()
