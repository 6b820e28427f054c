import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.operators import ner
from veilspark.plans.analyze import analyze, analyze_rows, anonymize, explode_spans

NAMES = [("Pieter van den Berg", "PERSON"), ("Pieter", "PERSON"), ("Rotterdam", "LOCATION"), ("ING Bank", "ORGANIZATION"),
         ("support", "ORGANIZATION"), ("van", "LOCATION")]


@pytest.fixture
def names(spark):
    return spark.createDataFrame(NAMES, "name string, entity_type string")


def test_dictionary(docs, names):
    df = docs("Pieter van den Berg belde gisteren.", "De vergadering in Rotterdam, met ING\nBank.", "Niets.")
    rows = {(r.doc_id, r.entity_type, r.text) for r in analyze_rows(df, gazetteer=names).collect()}
    assert rows >= {(0, "PERSON", "Pieter van den Berg"), (1, "LOCATION", "Rotterdam"), (1, "ORGANIZATION", "ING\nBank")}
    # the longest name per start wins; another start is another span
    assert (0, "PERSON", "Pieter") not in rows and (0, "LOCATION", "van") in rows


def test_pattern_wins_over_name(docs, names):
    rows = analyze_rows(docs("Mail support@example.nl of support."), gazetteer=names).collect()
    assert {(r.entity_type, r.text) for r in rows} == {("EMAIL", "support@example.nl"), ("ORGANIZATION", "support")}
    assert [r.start for r in rows if r.entity_type == "ORGANIZATION"] == [27]


def test_names_only_in_the_engine_language(spark, names):
    df = spark.createDataFrame([(0, "in Rotterdam", "en"), (1, "in Rotterdam", "nl")], "doc_id bigint, text string, l string")
    assert [r.doc_id for r in analyze_rows(df, gazetteer=names, language_col="l").collect()] == [1]


def test_repeated_ids(spark, names):
    df = spark.createDataFrame([(0, "in Rotterdam"), (0, "in Rotterdam"), (0, "Pieter")], "doc_id bigint, text string")
    out = anonymize(df, gazetteer=names)
    assert sorted(r.anonymized_text for r in out.collect()) == ["<PERSON>", "in <LOCATION>", "in <LOCATION>"]


def test_external(docs, spark):
    outside = spark.createDataFrame([(0, "PERSON", 0, 3), (0, "PERSON", 0, 3), (1, "CITY", 0, 2)],
                                    "doc_id bigint, entity_type string, start int, end int")
    rows = analyze_rows(docs("Jan belt.", "Xy"), "all", external=outside).collect()
    assert {(r.doc_id, r.entity_type, r.text, r.recognizer) for r in rows} == {
        (0, "PERSON", "Jan", "external"), (1, "CITY", "Xy", "external")}
    assert len(rows) == 2


def fake_model():
    """Nested, so that it travels to the workers by value."""
    def model(frames):
        loaded = {"Jan": ("PER", 0.9), "Utrecht": ("GPE", 0.85), "salaris": ("salaris", 0.5), "zwak": ("naam", 0.1)}
        for pdf in frames:
            found = [(i, loaded[w][0], t.index(w), t.index(w) + len(w), loaded[w][1])
                     for i, t in zip(pdf.doc_id, pdf.text) for w in loaded if w in t]
            yield pd.DataFrame(found, columns=["doc_id", "entity_type", "start", "end", "score"])
    return model


def test_model_plug(docs, spark):
    ner.register_detector("spacy", fake_model(), ["PERSON", "LOCATION"])
    df = docs("Jan woont in Utrecht.", "Niets.", "mail Jan@x.nl").repartition(1)
    rows = {(r.doc_id, r.entity_type, r.text, r.score) for r in analyze_rows(df, detectors=["spacy"]).collect()}
    assert rows == {(0, "PERSON", "Jan", 0.9), (0, "LOCATION", "Utrecht", 0.85), (2, "EMAIL", "Jan@x.nl", 0.6)}
    with pytest.raises(ValueError):
        analyze_rows(df, detectors=["nope"])
    with pytest.raises(ValueError):
        ner.register_detector("external", fake_model(), [])


def test_zero_shot_threshold_and_labels(docs):
    ner.register_detector("gliner", fake_model(), catalog.DETECTOR_ENTITIES["gliner"])
    rows = analyze_rows(docs("salaris van zwak"), "all", profile="gpu", detectors=["gliner"]).collect()
    assert [(r.entity_type, r.text) for r in rows] == [("INCOME", "salaris")]


def test_labels(spark):
    df = spark.createDataFrame([("PER",), ("GPE",), ("NORP",), (None,)], "l string")
    assert [r[0] for r in df.select(ner.map_label("l")).collect()] == ["PERSON", "LOCATION", "NORP", None]
    assert len(catalog.ZERO_SHOT_LABELS) == 22 and len(set(catalog.ZERO_SHOT_LABELS.values())) == 8


def test_context(docs):
    df = docs("KvK nummer 12345678 en nog iets heel anders dan 87654321.")
    plain = {r.text: r.score for r in analyze_rows(df, ["KVK_NUMBER"]).collect()}
    assert plain == {"12345678": 0.45, "87654321": 0.45}
    got = {r.text: round(r.score, 6) for r in analyze_rows(
        df, ["KVK_NUMBER"], context={"KVK_NUMBER": ["KVK"]}, context_window=3).collect()}
    assert got == {"12345678": 0.8, "87654321": 0.45}
    capped = analyze_rows(docs("mac AA:BB:CC:DD:EE:FF"), ["MAC_ADDRESS"], context={"MAC_ADDRESS": ["mac"]}).first()
    assert capped.score == 1.0


def test_verify(docs):
    spans = analyze_rows(docs("10.0.0.1 en 10.0.0.2"), ["IP_ADDRESS"])
    assert [r.text for r in ner.verify(spans, F.col("text").endswith("2")).collect()] == ["10.0.0.2"]

    @F.pandas_udf("boolean")
    def model(values: pd.Series) -> pd.Series:
        return values.str.endswith("1")

    assert [r.text for r in ner.verify(spans, model("text")).collect()] == ["10.0.0.1"]


def test_models_share_one_stage(docs):
    def reads_ahead():
        def model(frames):
            held = list(frames)
            for pdf in held:
                found = [(i, "GPE", t.index("Utrecht"), t.index("Utrecht") + 7) for i, t in zip(pdf.doc_id, pdf.text) if "Utrecht" in t]
                pdf["text"] = "spoiled"
                yield pd.DataFrame(found, columns=["doc_id", "entity_type", "start", "end"])
        return model

    ner.register_detector("spacy", fake_model(), ["PERSON"])
    ner.register_detector("places", reads_ahead(), ["LOCATION"])
    df = docs("Jan woont in Utrecht.", None, "Niets.", "Utrecht", "Jan").repartition(2)
    frame = analyze_rows(df, ["PERSON", "LOCATION"], detectors=["spacy", "places"])
    assert {(r.doc_id, r.text) for r in frame.collect()} == {(0, "Jan"), (0, "Utrecht"), (3, "Utrecht"), (4, "Jan")}
    unrun = analyze_rows(docs("Jan"), ["PERSON", "LOCATION"], detectors=["spacy", "places"])
    assert unrun._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_verifier_sees_candidates_only(spark, docs):
    def model(frames):
        for pdf in frames:
            assert len(pdf) and set(pdf.entity_type) == {"IP_ADDRESS"} and not pdf.before.str.contains("geheim").any()
            yield (pdf.after.str.len() > 0) & pdf.before.str.endswith("van ")

    texts = ["geheim " * 20 + "van 10.0.0.1 naar 10.0.0.2 a@b.nl", "mail a@b.nl", "van 10.0.0.3", "van 10.0.0.4 x", "niets"]
    found = analyze(docs(*texts).repartition(3), ["IP_ADDRESS", "EMAIL"], keep=["text"])
    kept = explode_spans(ner.verify_with(found, model, ["IP_ADDRESS"], window=10))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(0, "10.0.0.1"), (0, "a@b.nl"), (1, "a@b.nl"), (3, "10.0.0.4")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert ner.verify_with(found.coalesce(1), model, ["IP_ADDRESS"], window=10).select("doc_id").count() == 5
        again = explode_spans(ner.verify_with(found.coalesce(1), model, ["IP_ADDRESS"], window=10))
        assert again.count() == 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
