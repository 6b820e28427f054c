import pytest
from pyspark.sql.functions import spark_partition_id
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from veilspark.operators.names import load_names
from veilspark.plans.analyze import analyze, anonymize
from veilspark.plans.jobs import main
from veilspark.sources import readers, sinks
from veilspark.streaming import stream


def test_stream_equals_batch(spark, letters_df, tmp_path):
    source = str(tmp_path / "in")
    letters_df.select("doc_id", "text").repartition(3).write.parquet(source)
    schema = "doc_id bigint, text string"
    for name, make_stream, make_batch in (
            ("a", stream.analyze_stream, analyze), ("b", stream.anonymize_stream, anonymize)):
        out = str(tmp_path / name)
        df = stream.read_stream(spark, source, schema)
        assert df.isStreaming
        stream.write_stream(make_stream(df, "all"), out, str(tmp_path / f"ck{name}"), once=True).awaitTermination(120)
        want = make_batch(spark.read.parquet(source), "all")
        got = spark.read.schema(want.schema).parquet(out)
        assert got.count() == 150 and got.exceptAll(want).count() == 0


def test_dictionary_in_batches(spark, letters_df, tmp_path):
    source = str(tmp_path / "in")
    letters_df.select("doc_id", "text").repartition(2).write.parquet(source)
    names = letters_df.select(F.col("c_name").alias("name"), F.lit("PERSON").alias("entity_type"))
    df = stream.read_stream(spark, source, "doc_id bigint, text string")
    with pytest.raises(ValueError, match="write_batches"):
        stream.analyze_stream(df, gazetteer=load_names(names, limit=100))
    with pytest.raises(ValueError, match="write_batches"):
        stream.anonymize_stream(df, external=names)
    out = str(tmp_path / "out")
    stream.write_batches(df, lambda b: analyze(b, gazetteer=names), out, str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == 150


def test_names_on_a_stream(spark, letters_df, tmp_path):
    source = str(tmp_path / "in")
    letters_df.select("doc_id", "text").repartition(3).write.parquet(source)
    names = letters_df.select(F.col("c_name").alias("name"), F.lit("PERSON").alias("entity_type")).unionByName(
        letters_df.select(F.col("n_name").alias("name"), F.lit("LOCATION").alias("entity_type")))
    for kind, make_stream, make_batch in (
            ("a", stream.analyze_stream, analyze), ("b", stream.anonymize_stream, anonymize)):
        df, out = stream.read_stream(spark, source, "doc_id bigint, text string"), str(tmp_path / kind)
        stream.write_stream(make_stream(df, gazetteer=names), out, str(tmp_path / f"ck{kind}"), once=True).awaitTermination(120)
        want = make_batch(spark.read.parquet(source), gazetteer=names)
        got = spark.read.schema(want.schema).parquet(out)
        assert got.count() == 150 and got.exceptAll(want).count() == 0
        large = make_batch(spark.read.parquet(source), gazetteer=load_names(names, limit=100))
        assert large.count() == 150 and large.exceptAll(want).count() == 0


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@b.nl"), (2, "niets")], "doc_id bigint, text string")
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        (df.write.option("header", False).csv(path) if fmt == "csv" else df.write.format(fmt).save(path))
        got = readers.read_texts(spark, path, fmt, schema="doc_id bigint, text string")
        assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "mail a@b.nl"), (2, "niets")]
    (tmp_path / "lines.txt").write_text("mail a@b.nl\nniets\n")
    got = readers.read_texts(spark, str(tmp_path / "lines.txt"), "text")
    assert got.count() == 2 and got.select("doc_id").distinct().count() == 2
    with pytest.raises(ValueError):
        readers.read_texts(spark, "x", "avro")


def test_sinks(spark, docs, tmp_path):
    out = anonymize(docs("mail a@b.nl"))
    for fmt in sinks.FORMATS:
        path = str(tmp_path / fmt)
        sinks.write_anonymized(out, path, fmt, keep_original=False)
        back = spark.read.format(fmt).load(path)
        assert "original_text" not in back.columns and back.first().anonymized_text == "mail <EMAIL>"
    with pytest.raises(ValueError):
        sinks.write_table(out, "x", "xml")


def test_table_jobs(spark, tmp_path):
    args = ["--input", f"{SF}/documents.parquet", "--entities", "email"]
    assert main(["analyze", *args, "--output", str(tmp_path / "a")]) == 0
    assert main(["anonymize", *args, "--strategy", "mask", "--output", str(tmp_path / "b"), "--drop-original"]) == 0
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 200


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "anonymized_text" in df.columns


def test_every_query_has_an_oracle():
    import veil_oracle
    import veil_queries

    assert set(veil_queries.QUERIES) == set(veil_oracle.ORACLE)
    assert set(veil_queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["scan_documents", "anonymize_all", "resolve_rows", "confusion_long", "golden_report"])
def test_query_equals_oracle(spark, name):
    import duckdb

    import check_oracle

    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    outcome = check_oracle.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert outcome.startswith("ok"), outcome


def test_rows_of_one_split_are_dealt_before_texts_are_made(spark, tmp_path):
    from veilspark.sources.letters import dossiers, letters

    spark.range(9000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "id % 3 AS c_nationkey").coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("id AS n_nationkey", "'NL' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(9000).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for made in (letters(spark, str(tmp_path)), dossiers(spark, str(tmp_path))):
        sizes = [r["count"] for r in made.groupBy(spark_partition_id()).count().collect()]
        assert sum(sizes) == 9000 and len(sizes) == 8 and max(sizes) <= 1500


@pytest.mark.parametrize("limit", [1000, 0])
def test_stream_with_few_and_many_names(spark, tmp_path, limit):
    from veilspark.operators import ner
    from veilspark.streaming import stream

    rows = [(i, f"Jan Bos mailt a{i}@b.nl") for i in range(5)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/in")
    names = ner.load_names(spark.createDataFrame([("Jan Bos", "PERSON")], "name string, entity_type string"), limit=limit)
    texts = stream.read_stream(spark, f"{tmp_path}/in", "doc_id bigint, text string")
    running, schema, files = stream.write_analyzed(texts, f"{tmp_path}/out", f"{tmp_path}/state", once=True, gazetteer=names)
    running.awaitTermination()
    found = spark.read.schema(schema).parquet(files).selectExpr("doc_id", "inline(pii_entities)").collect()
    assert sorted((r.doc_id, r.entity_type) for r in found) == [(i, t) for i in range(5) for t in ("EMAIL", "PERSON")]
