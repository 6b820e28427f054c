"""A plug-in file as the options of a job.

The file is YAML: ``language``; ``ner`` (``enabled``, ``entities``) for the name model;
``recognizers``, a list of ``{name, type, enabled}`` where a ``pattern`` names a built-in recognizer or brings its own
``entity_type`` and ``patterns``, and any other type is a model; ``context_aware_enhancer`` (``enabled``, and ``words`` per type).
"""

from __future__ import annotations

from collections.abc import Mapping

from veilspark.catalog import DEFAULT_LANGUAGE, load_recognizer, recognizer_from_config
from veilspark.operators.ner import detector_entities
from veilspark.operators.validate import check_language


def options_of(config: Mapping, without_models: bool = False) -> dict:
    """``catalogue, detectors, language[, context]`` for :func:`veilspark.plans.analyze.scan`.

    Whatever can't be loaded is an error before the job starts: an unknown type, pattern or language, and a
    model nobody has registered, unless ``without_models`` leaves those out.  Disabled entries are not looked at.
    """
    rows, models = [], []
    if config.get("ner", {}).get("enabled", bool(config.get("ner"))):
        models.append("spacy")
    for entry in config.get("recognizers") or ():
        if not entry.get("enabled", True):
            continue
        rows += recognizer_from_config(entry)
        if entry["type"] != "pattern":
            models.append(entry["type"] if entry["type"] in ("spacy", "gliner") else entry["name"])
    models = [] if without_models else list(dict.fromkeys(models))
    for model in models:
        detector_entities(model)
    options = {"catalogue": rows, "detectors": models, "language": check_language(config.get("language", DEFAULT_LANGUAGE))}
    enhancer = config.get("context_aware_enhancer") or {}
    if enhancer.get("enabled") and enhancer.get("words"):
        options["context"] = {kind: tuple(words) for kind, words in enhancer["words"].items()}
    return options


def profile_config(recognizers: Mapping[str, bool]) -> dict:
    """A configuration that switches built-in recognizers on or off by name."""
    for name in recognizers:
        load_recognizer(name)
    return {"recognizers": [{"name": n, "type": "pattern", "enabled": on} for n, on in recognizers.items()]}
