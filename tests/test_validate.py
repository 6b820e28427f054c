import pytest
from pyspark.errors import PySparkException

from veilspark import catalog
from veilspark.operators.validate import bad_spans, prepare, rejected_rows
from veilspark.plans.analyze import analyze, analyze_rows, anonymize
from veilspark.plans.config import options_of, profile_config
from veilspark.sources import readers, sinks


def test_blank_text_is_rejected(spark):
    df = spark.createDataFrame(
        [(0, ""), (1, "   "), (2, None), (3, " \x1f\n"), (4, " ok ")], "doc_id bigint, text string")
    assert [(r.doc_id, r.text_length) for r in analyze(df).collect()] == [(4, 2)]
    assert sorted(r.doc_id for r in rejected_rows(df).collect()) == [0, 1, 2, 3]
    with pytest.raises(PySparkException, match="empty"):
        analyze(df, mode="fail").collect()


def test_language(spark):
    df = spark.createDataFrame(
        [(0, "x 10.0.0.1", "nl"), (1, "x 10.0.0.1", "en"), (2, "x", "fr"), (3, "x", None)],
        "doc_id bigint, text string, language string")
    rows = {r.doc_id: r for r in analyze(df, "all", language_col="language").collect()}
    assert {i: r.language for i, r in rows.items()} == {0: "nl", 1: "en", 3: "nl"}
    assert len(rows[1].pii_entities) == 1
    assert [(r.doc_id, r.reason) for r in rejected_rows(df, language_col="language").collect()] == [
        (2, "unsupported language")]
    with pytest.raises(ValueError):
        analyze(df, language="fr")


def test_strategy(docs, spark):
    with pytest.raises(ValueError):
        anonymize(docs("x"), strategy="invalid")
    df = spark.createDataFrame([(0, "x", "shred"), (1, "x", "mask")], "doc_id bigint, text string, s string")
    assert [r.doc_id for r in anonymize(df, strategy_col="s").collect()] == [1]


def test_offsets_refer_to_stripped_text(found):
    assert [(r[2], r[3]) for r in found("\n\t  10.0.0.1 　")] == [(0, 8)]


def test_entity_sets():
    assert catalog.resolve_entities(None) == catalog.resolve_entities([]) == catalog.DEFAULT_ENTITIES
    assert catalog.resolve_entities("all") is None
    assert len(catalog.DECLARED_ENTITIES) == 15
    assert catalog.parse_entity_list(" email, Iban") == ("EMAIL", "IBAN")


def test_pruning_and_unknown_types():
    assert {r.entity_type for r in catalog.select(entities=["IBAN"]).rows} == {"IBAN"}
    with pytest.raises(ValueError):
        catalog.select(entities=["NOPE"])
    with pytest.raises(ValueError):
        catalog.select(profile="gpu", entities=["IBAN"])
    with pytest.raises(ValueError, match="NOPE"):
        catalog.select(entities=["IBAN", "NOPE"])
    with pytest.raises(ValueError):
        catalog.select(profile="nope")


def test_profiles():
    kinds = lambda p: set(catalog.select(p, "all").pattern_entities)
    assert "POSTCODE" not in kinds("classic") and "MAC_ADDRESS" in kinds("classic")
    assert kinds("all") == kinds("classic") | {"POSTCODE"}
    assert kinds("gpu") == kinds("default") == {"MAC_ADDRESS"}
    assert kinds("gpu_full") == kinds("classic")
    assert len(catalog.builtin_catalogue()) == 32


def test_zero_shot_displaces_names():
    plan = catalog.select("classic", "all", detectors={"spacy": ["PERSON"], "gliner": ["PERSON"]})
    assert plan.detectors == ("gliner",)


def test_plugin_config():
    assert len(catalog.recognizer_from_config({"name": "MACAddressRecognizer", "type": "pattern"})) == 3
    assert catalog.recognizer_from_config({"name": "MACAddressRecognizer", "type": "pattern", "enabled": False}) == []
    own = catalog.recognizer_from_config({
        "name": "o", "type": "pattern", "entity_type": "ORDER", "patterns": [{"name": "p", "regex": "x", "score": 1}]})
    assert own[0].entity_type == "ORDER"
    for bad in ({"name": "x", "type": "magic"}, {"name": "Nope", "type": "pattern"}):
        with pytest.raises(ValueError):
            catalog.recognizer_from_config(bad)


def test_entities_column(spark):
    df = spark.createDataFrame(
        [(0, "10.0.0.1 a@b.nl", ["IP_ADDRESS"]), (1, "10.0.0.1 a@b.nl", None), (2, "10.0.0.1 a@b.nl", [])],
        "doc_id bigint, text string, want array<string>")
    got = {(r.doc_id, r.entity_type) for r in analyze_rows(df, entities_col="want").collect()}
    assert got == {(0, "IP_ADDRESS"), (1, "EMAIL"), (2, "EMAIL")}


def test_score_sanity(letters_df, spark):
    spans = analyze_rows(letters_df, "all", profile="all")
    assert bad_spans(spans).count() == 0
    odd = spark.createDataFrame(
        [(0, 3, 0.5), (3, 3, 0.5), (-1, 2, 0.5), (0, 1, 0.0), (0, 1, 1.5), (0, 1, None), (0, 1, float("nan"))],
        "start int, end int, score double")
    assert bad_spans(odd).count() == 6


def test_min_score(found):
    assert {r[1] for r in found("Bel 0612345678.", min_score=0.5)} == {"PHONE_NUMBER"}


def test_catalogue_table(spark):
    table = catalog.catalogue_table(spark)
    assert table.count() == 32 and table.filter("validator = 'bsn'").count() == 1


def test_checked_write_in_one_pass(spark, tmp_path):
    rows = [(0, " a ", "nl", None), (1, "  ", "nl", None), (2, None, "nl", None), (3, "b", "fr", None), (4, "c", None, "shred"), (5, "d", "en", "hash")]
    df = spark.createDataFrame(rows, "doc_id int, text string, l string, s string")
    seen = sinks.write_checked(df, str(tmp_path / "out"), language_col="l", strategy_col="s")
    assert seen == {"valid": 2, "text cannot be empty": 2, "unsupported language": 1, "unsupported strategy": 1}
    back = {r.doc_id: (r.outcome, r.text, r.language) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back[0] == ("valid", "a", "nl") and back[5] == ("valid", "d", "en") and back[3] == ("rejected", "b", "fr")
    valid = spark.read.parquet(str(tmp_path / "out" / "outcome=valid")).select("doc_id", "text", "language")
    assert valid.exceptAll(prepare(df, language_col="l", strategy_col="s").select("doc_id", "text", "language")).count() == 0
    assert sinks.write_checked(df.limit(0), str(tmp_path / "none"))["valid"] == 0


def test_config_file(spark, docs, tmp_path):
    (tmp_path / "c.yaml").write_text("""
language: nl
ner: {enabled: true}
recognizers:
  - {name: EmailRecognizer, type: pattern}
  - {name: DutchIBANRecognizer, type: pattern, enabled: false}
  - {name: mine, type: llm, enabled: true}
context_aware_enhancer: {enabled: true, words: {EMAIL: [mail]}}
""")
    config = readers.read_config(spark, str(tmp_path / "c.yaml"))
    options = options_of(config, without_models=True)
    assert {r.entity_type for r in options["catalogue"]} == {"EMAIL"} and options["detectors"] == []
    rows = analyze_rows(docs("mail a@b.nl NL91ABNA0417164300"), "all", **options).collect()
    assert [(r.entity_type, round(r.score, 2)) for r in rows] == [("EMAIL", 0.95)]
    with pytest.raises(ValueError, match="mine|spacy"):
        options_of(config)
    for bad in ({"recognizers": [{"name": "x", "type": "magic"}]}, {"language": "fr"}, {"recognizers": [{"name": "Nope", "type": "pattern"}]}):
        with pytest.raises(ValueError):
            options_of(bad)
    assert options_of(profile_config({"EmailRecognizer": True, "IPv4Recognizer": False}))["catalogue"][0].entity_type == "EMAIL"
