from veilspark.plans import sql
from veilspark.plans.analyze import analyze_rows, anonymize


def test_sql_functions(spark, letters_df):
    sql.register(spark, "all", "all", "hash")
    texts = letters_df.select("doc_id", "text")
    texts.createOrReplaceTempView("letter_view")
    rows = spark.sql(
        "SELECT doc_id, s.* FROM (SELECT doc_id, pii_spans(text) AS a FROM letter_view) "
        "LATERAL VIEW OUTER explode(a) AS s WHERE s IS NOT NULL")
    want = analyze_rows(texts, "all", profile="all").select(*rows.columns)
    assert rows.exceptAll(want).count() == 0 and want.exceptAll(rows).count() == 0
    new = spark.sql("SELECT doc_id, pii_anonymize(text) AS anonymized_text FROM letter_view")
    assert new.exceptAll(anonymize(texts, "all", "hash", profile="all").select(*new.columns)).count() == 0
    assert spark.sql("SELECT pii_valid_bsn('111222333'), pii_valid_bsn('x'), pii_spans(NULL)").first()[:] == (
        True, False, None)


def test_spans_table(spark, letters_df):
    sql.register(spark, ["EMAIL", "IBAN"])
    texts = letters_df.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "niets")], "doc_id bigint, text string"))
    texts.createOrReplaceTempView("letter_view")
    rows = spark.sql("SELECT d.doc_id, s.* FROM (SELECT doc_id, pii_spans(text) AS a FROM letter_view) d, LATERAL spans_table(d.a) s")
    want = analyze_rows(texts, ["EMAIL", "IBAN"], position="position").select(*rows.columns)
    assert rows.count() == 300 and rows.exceptAll(want).count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan or "BatchEvalPythonUDTF" in plan
    assert "Exchange hashpartitioning" not in plan
