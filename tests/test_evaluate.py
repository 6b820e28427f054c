"""Evaluation against a plain Python evaluator, and the golden comparison."""

import json
import random
from collections import Counter

import pytest

from veilspark.functions.spans import SPANS_TYPE
from veilspark.operators import evaluate as E
from veilspark.plans.jobs import evaluate_samples, golden_by_profile, golden_comparison, main, pattern_entity_filter
from veilspark.sources import readers

TEXT = "abcdefghijklmnopqrstuvwxyz" * 4
TYPES = ["EMAIL", "IBAN", "PERSON"]


def random_samples(seed, n=80):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        def span():
            s = rng.randrange(60)
            return rng.choice(TYPES), s, s + rng.randrange(1, 14)
        truth = [span() for _ in range(rng.randrange(6))]
        preds = {}
        for _ in range(rng.randrange(6)):
            preds[span()] = rng.choice([0.2, 0.5, 0.6])
        for t in truth:  # near misses and wrong types
            if rng.random() < 0.6:
                preds[(rng.choice([t[0], rng.choice(TYPES)]), max(0, t[1] - rng.randrange(2)), t[2])] = 0.6
        if truth and rng.random() < 0.2:
            truth.append(truth[0])
        out.append((i, truth, [(*k, v) for k, v in preds.items()]))
    return out


def iou(a, b):
    inter = min(a[2], b[2]) - max(a[1], b[1])
    return inter / ((a[2] - a[1]) + (b[2] - b[1]) - inter) if inter > 0 else 0.0


def plain_evaluation(samples, threshold, minimum):
    counts, matrix = {}, Counter()
    kinds = Counter()
    bump = lambda t, k: counts.setdefault(t, Counter()).update([k])
    for _, truth, preds in samples:
        preds = sorted((p for p in preds if p[3] >= minimum), key=lambda p: (-p[3], p[1], -p[2], p[0]))
        used = set()
        for t in truth:
            hits = [i for i, p in enumerate(preds) if p[0] == t[0] and iou(p, t) >= threshold]
            if hits:
                bump(t[0], "tp")
                used.add(hits[0])
                matrix[t[0], t[0]] += 1
                continue
            bump(t[0], "fn")
            kinds["false_negative"] += 1
            matrix["O", t[0]] += 1
            others = [(-iou(p, t), i) for i, p in enumerate(preds) if p[0] != t[0] and iou(p, t) >= threshold]
            if others:
                best = min(others)[1]
                used.add(best)
                matrix[t[0], preds[best][0]] += 1
                kinds["partial"] += 1
        for i, p in enumerate(preds):
            if i not in used:
                bump(p[0], "fp")
                kinds["false_positive"] += 1
                matrix[p[0], "O"] += 1
    known = {*counts, "O"}
    return counts, {k: v for k, v in matrix.items() if k[0] in known and k[1] in known}, kinds


def frames(spark, samples):
    rows = [(i, TEXT, [(t, None, s, e) for t, s, e in truth], [(t, None, s, e, sc, "r", "p") for t, s, e, sc in preds])
            for i, truth, preds in samples]
    df = spark.createDataFrame(
        rows, "sample_id bigint, text string, spans array<struct<entity_type:string,text:string,start:int,end:int>>, "
        f"found {SPANS_TYPE}")
    return E.prediction_rows(df, spans_col="found"), E.truth_rows(df)


@pytest.mark.parametrize("threshold,minimum", [(0.5, 0.3), (0.8, 0.55)])
def test_equals_plain_evaluation(spark, threshold, minimum):
    samples = random_samples(5)
    counts, matrix, kinds = plain_evaluation(samples, threshold, minimum)
    result = E.evaluate(*frames(spark, samples), threshold, minimum).persisted()
    got = {r.entity_type: Counter(tp=r.tp, fp=r.fp, fn=r.fn) for r in result.metrics.collect()}
    assert {t: +c for t, c in got.items()} == counts
    assert {(r.row_label, r.col_label): r.n for r in result.confusion.collect()} == matrix
    summary = {r.kind: r.n for r in result.error_summary.collect()}
    summary.pop("low_iou", None)
    assert summary == dict(kinds)
    square = {r.row_label: r.asDict() for r in result.confusion_matrix().collect()}
    assert set(square) == {*counts, "O"}
    assert all(square[r][c] == matrix.get((r, c), 0) for r in square for c in square)
    overall = result.overall.first()
    assert overall.tp == sum(c["tp"] for c in counts.values())
    report = json.loads(result.report().first().report)
    assert report["global"]["fp"] == sum(c["fp"] for c in counts.values())
    assert set(report["per_entity"]) == set(counts)


def test_worked_example(spark):
    samples = [(0, [("EMAIL", 10, 20)], [("IBAN", 10, 20, 0.6), ("EMAIL", 18, 40, 0.6)])]
    result = E.evaluate(*frames(spark, samples))
    assert {(r.row_label, r.col_label, r.n) for r in result.confusion.collect()} == {
        ("O", "EMAIL", 1), ("EMAIL", "O", 1)}  # IBAN has no counts of its own, so no label
    errors = {r.kind: r for r in result.errors.collect()}
    assert errors["partial"].predicted == TEXT[10:20] and errors["partial"].iou == 1.0
    assert errors["false_negative"].context == TEXT[0:40] and errors["false_positive"].context == TEXT[0:60]
    assert "low_iou" not in errors


def test_low_iou_is_listed_but_not_counted(spark):
    result = E.evaluate(*frames(spark, [(0, [("EMAIL", 10, 20)], [("EMAIL", 18, 40, 0.6)])]))
    kinds = {r.kind for r in result.errors.collect()}
    assert kinds == {"false_negative", "false_positive", "low_iou"}
    m = result.metrics.first()
    assert (m.tp, m.fp, m.fn, m.f1) == (0, 1, 1, 0.0)


def test_bad_threshold(spark):
    with pytest.raises(ValueError):
        E.evaluate(*frames(spark, []), iou_threshold=0.0)


def test_empty_input(spark):
    assert E.evaluate(*frames(spark, [(0, [], [])])).overall.first().f1 == 0.0


GOLDEN = [
    {"id": "mail", "text": "Mail gerust naar hulp@loket.nl voor vragen.",
     "entities": [{"entity_type": "EMAIL", "text": "hulp@loket.nl", "start": 17, "end": 30}]},
    {"id": "tel", "text": "Bel mij op 06-12345678 als je er bent.",
     "entities": [{"entity_type": "PHONE_NUMBER", "text": "06-12345678", "start": 11, "end": 22}]},
    {"id": "zaak", "text": "Zaaknummer 12/345678 is in behandeling.",
     "entities": [{"entity_type": "CASE_NO", "text": "12/345678", "start": 11, "end": 20}]},
    {"id": "plaat", "text": "Kenteken AB-123-C gezien.",
     "entities": [{"entity_type": "LICENSE_PLATE", "text": "AB-123-C", "start": 9, "end": 17}]},
]


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "set.jsonl"
    path.write_text("\n\n".join(json.dumps(g) for g in GOLDEN) + "\n", encoding="utf-8")
    return readers.read_golden(spark, str(path))


def test_golden(golden):
    compared = golden_comparison(golden)
    report = {r.entity_type: r for r in compared.report.collect()}
    assert report["EMAIL"].f1 == 1.0 and report["LICENSE_PLATE"].recall == 1.0
    # the phone pattern takes the space, the case number matches no pattern
    assert report["PHONE_NUMBER"].recall == 0.0 and report["CASE_NO"].recall == 0.0
    assert {r.missing for r in compared.missing.collect()} == {"tel:PHONE_NUMBER@11", "zaak:CASE_NO@11"}
    assert ("tel", "PHONE_NUMBER", 11, 23) in [tuple(r) for r in compared.extra_shown().collect()]
    data = json.loads(compared.to_json(golden).first().report)
    assert data["total_examples"] == 4 and data["per_entity"]["EMAIL"]["correct"] == 1 and data["missing"] == 2
    floors = {r.entity_type: r.passed for r in compared.floors({"EMAIL": 1.0, "PHONE_NUMBER": 1.0, "IBAN": 1.0}).collect()}
    assert floors == {"EMAIL": True, "PHONE_NUMBER": False}
    trimmed = golden_comparison(golden, trim_spans=True)
    assert {r.entity_type: r.recall for r in trimmed.report.collect()}["PHONE_NUMBER"] == 1.0


def test_golden_with_default_types_and_profiles(golden):
    report = {r.entity_type: r.recall for r in golden_comparison(golden, entities=None).report.collect()}
    assert report["LICENSE_PLATE"] == report["CASE_NO"] == 0.0 and report["EMAIL"] == 1.0
    wide = {r.entity_type: (r.classic, r.gpu) for r in golden_by_profile(golden, ["classic", "gpu"]).collect()}
    assert wide["EMAIL"] == (1.0, 0.0)


SAMPLES = [
    {"full_text": "Mail hulp@loket.nl nu.", "spans": [
        {"entity_type": "EMAIL", "entity_value": "hulp@loket.nl", "start_position": 5, "end_position": 18}]},
    {"full_text": "BSN: 111222333.", "spans": [
        {"entity_type": "BSN", "entity_value": "111222333", "start_position": 4, "end_position": 13}]},
    {"full_text": "  IP 10.0.0.1", "spans": [
        {"entity_type": "IP_ADDRESS", "entity_value": "10.0.0.1", "start_position": 5, "end_position": 13}]},
    {"full_text": "Niets hier."},
]


@pytest.fixture
def files(tmp_path):
    data, minimums = tmp_path / "samples.json", tmp_path / "min.yaml"
    data.write_text(json.dumps(SAMPLES), encoding="utf-8")
    minimums.write_text("EMAIL:\n  precision: 0.9\n  recall: 0.9\nPERSON:\n  recall: 0.0\n", encoding="utf-8")
    return data, minimums


def test_samples(spark, files):
    from veilspark.operators.validate import bad_labels

    samples = readers.read_samples(spark, str(files[0]))
    assert samples.count() == 4
    metrics = {r.entity_type: (r.tp, r.fp, r.fn) for r in evaluate_samples(samples).metrics.collect()}
    assert metrics == {"EMAIL": (1, 0, 0), "BSN": (1, 0, 0), "IP_ADDRESS": (1, 0, 0)}
    wrong = bad_labels(samples).collect()
    assert [(r.entity_type, r.stated, r.found) for r in wrong] == [("BSN", "111222333", " 11122233")]


def test_job_exit_codes(spark, files, tmp_path):
    data, minimums = map(str, files)
    run = lambda *a: main(["evaluate", "--data", data, "--thresholds", minimums, "--fail-on-threshold", *a])
    assert run("--output", str(tmp_path / "report"), "--show-errors") == 0
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value)["global"]["tp"] == 3
    files[1].write_text("PERSON:\n  recall: 0.5\n")
    assert run() == 1
    assert run("--entities", "email, bsn") == 0
    assert run("--pattern-only") == 0
    files[0].write_text("{not json")
    assert run() == 2


def test_golden_job_gates_exact_counts(spark, tmp_path):
    good, bad, broken = (tmp_path / n for n in ("good.jsonl", "bad.jsonl", "broken.jsonl"))
    bad.write_text("\n".join(json.dumps(g) for g in GOLDEN), encoding="utf-8")
    good.write_text("\n".join(json.dumps(g) for g in GOLDEN if g["id"] not in ("tel", "zaak")), encoding="utf-8")
    broken.write_text(json.dumps(GOLDEN[0]) + "\n{not json\n")
    run = lambda path, *a: main(["golden", "--data", str(path), *a])
    assert run(good, "--output", str(tmp_path / "out")) == 0
    assert run(bad) == 1 and run(bad, "--no-gate") == 0
    assert run(broken) == 2 and run(tmp_path / "absent") == 2
    types = {r.entity_type for r in spark.read.json(str(tmp_path / "out" / "types")).collect()}
    assert "EMAIL" in types and json.loads(spark.read.text(str(tmp_path / "out" / "report")).first().value)["missing"] == 0
    config = tmp_path / "c.yaml"
    config.write_text("recognizers: [{name: MACAddressRecognizer, type: pattern}]")
    assert run(good, "--config", str(config)) == 1
    config.write_text("recognizers: [{name: x, type: magic}]")
    assert run(good, "--config", str(config)) == 2


def test_gates(spark, files):
    result = evaluate_samples(readers.read_samples(spark, str(files[0])))
    gated = {r.entity_type: r.passed for r in result.gate(E.recall_floor(spark, {"PERSON": 0.5, "EMAIL": 1.0})).collect()}
    assert gated == {"PERSON": False, "EMAIL": True, "BSN": True, "IP_ADDRESS": True}
    with pytest.raises(E.ThresholdError, match="PERSON"):
        E.require(result.gate(E.recall_floor(spark, {"PERSON": 0.5})))
    E.require(result.gate(E.recall_floor(spark, {"PERSON": 0.5}), skip_missing=True))


def test_pattern_filter():
    assert "POSTCODE" not in pattern_entity_filter() and "MAC_ADDRESS" in pattern_entity_filter()
