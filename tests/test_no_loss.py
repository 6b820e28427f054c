"""Cases in which a switch or cap once lost data."""

import pytest
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.operators import evaluate as E
from veilspark.operators import ner
from veilspark.operators.validate import bad_labels
from veilspark.plans import jobs
from veilspark.plans.analyze import analyze_rows


def test_dictionary_names_of_any_length(spark, docs):
    long = "Stichting tot behoud van het oude raadhuis te Amsterdam Noord"
    names = spark.createDataFrame([(long, "ORGANIZATION"), ("oude raadhuis", "LOCATION"), ("Amsterdam", "LOCATION")],
                                  "name string, entity_type string")
    text = f"De {long} en Amsterdam."
    rows = ner.dictionary_spans(docs(text, ""), names, ["doc_id"]).collect()
    cut = sorted((text[r.start:r.end], r.entity_type) for r in rows)
    assert cut == [("Amsterdam", "LOCATION"), ("Amsterdam", "LOCATION"), (long, "ORGANIZATION"), ("oude raadhuis", "LOCATION")]
    assert ner.dictionary_spans(docs(text), names.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("lead", [None, "", "ticket", "[a-z]{3}", "t"])
def test_a_true_lead_excludes_nothing(docs, lead):
    own = catalog.Recognizer("T", "TICKET", "ticket", r"\bticket-\d+\b", 0.5, lead=lead)
    rows = analyze_rows(docs("see ticket-123 and ticket-4"), ["TICKET"], extra=[own]).collect()
    assert [r.text for r in rows] == ["ticket-123", "ticket-4"]


def test_empty_matches_are_dropped(docs):
    own = catalog.Recognizer("D", "DIGITS", "digits", r"\d*", 0.5)
    rows = analyze_rows(docs("ab 12 c3"), ["DIGITS"], extra=[own]).collect()
    assert [(r.start, r.end) for r in rows] == [(3, 5), (7, 8)]


def test_name_model_runs_where_no_zero_shot_model_does():
    plan = catalog.select("gpu_full", "all", detectors={"spacy": ("PERSON",)})
    assert plan.detectors == ("spacy",)
    plan = catalog.select("gpu_full", "all", detectors={"spacy": ("PERSON",), "gliner": ("PERSON",)})
    assert plan.detectors == ("gliner",)


def test_asked_type_without_an_active_source():
    with pytest.raises(ValueError, match="PERSON"):
        catalog.select("classic", ["PERSON"])
    for strict in (False, True):
        with pytest.raises(ValueError, match="PERSON"):
            catalog.select("classic", ["PERSON", "EMAIL"], strict_contract=strict)
    assert catalog.select("classic").rows and catalog.select("classic", []).rows
    with pytest.raises(ValueError, match="PERSON"):
        catalog.select("classic", strict_contract=True)
    assert catalog.select("classic", ["PERSON"], detectors={"spacy": ("PERSON",)}).detectors == ("spacy",)
    assert catalog.parse_entity_list("email, iban,") == ("EMAIL", "IBAN")


def test_weak_copies_of_a_prediction_are_no_errors(spark):
    truth = spark.createDataFrame([("s", "EMAIL", 0, 5, 1)], "sample_id string, entity_type string, start int, end int, n long")
    rows = spark.createDataFrame([("s", "EMAIL", 0, 5, 0.9), ("s", "EMAIL", 0, 5, 0.1), ("s", "EMAIL", 0, 5, 0.8)],
                                 "sample_id string, entity_type string, start int, end int, score double")
    got = E.evaluate(E.unique_spans(rows, scored=True), truth, score_threshold=0.3).counts.first()
    assert (got.tp, got.fp, got.fn) == (1, 1, 0)


def test_labels_without_offsets_are_bad(spark):
    samples = spark.createDataFrame(
        [(1, "abc", [("X", "abc", None, 3)])],
        "sample_id long, text string, spans array<struct<entity_type: string, text: string, start: int, end: int>>")
    assert bad_labels(samples).count() == 1


def test_reports_print_every_row(spark, capsys):
    jobs.print_rows(spark.range(2500).select(F.col("id")))
    assert len(capsys.readouterr().out.splitlines()) == 2501


def test_building_scans_runs_no_job(spark):
    import veil_queries

    from conftest import SF

    for name in ("scan_documents", "scan_letters", "anonymize_documents", "golden_report"):
        spark.sparkContext.setJobGroup(f"build-{name}", "building")
        df = veil_queries.QUERIES[name](spark, SF)
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(f"build-{name}") for s in tracker.getJobInfo(j).stageIds]
        # reading a Parquet footer for its schema is the only job that building may run
        assert all(tracker.getStageInfo(s).name.startswith(("parquet at", "load at")) for s in stages if tracker.getStageInfo(s)), name
        assert "RoundRobin" not in df._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
