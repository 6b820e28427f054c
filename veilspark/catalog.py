"""Recognizer catalogue, profiles and entity sets.

Everything here is small driver-side configuration.  Choosing a profile and a
set of entity types prunes catalogue rows *before* a plan is built, so an
expression for a pattern nobody asked for never reaches Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must be what users of the service rely on: recognizer
# names, entity types, pattern names, expressions and scores.
# ---------------------------------------------------------------------------

DEFAULT_ENTITIES = (
    "PERSON", "LOCATION", "ORGANIZATION", "PHONE_NUMBER", "EMAIL", "IBAN", "BSN", "DATE_TIME",
)
DECLARED_ENTITIES = DEFAULT_ENTITIES + (
    "ID_NO", "DRIVERS_LICENSE", "CASE_NO", "VAT_NUMBER", "KVK_NUMBER", "LICENSE_PLATE", "IP_ADDRESS",
)
LANGUAGES = ("nl", "en")
DEFAULT_LANGUAGE = "nl"
STRATEGIES = ("replace", "mask", "redact", "hash")
DEFAULT_STRATEGY = "replace"

# Label of a name model -> entity type.
NER_LABELS = {
    "PER": "PERSON", "PERSON": "PERSON",
    "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION",
    "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION",
}
NER_SCORE = 0.85

# Raw labels the name model is asked for.
NER_RAW_LABELS = ("DATE", "FAC", "GPE", "LOC", "MONEY", "NORP", "ORG", "PERSON")

# Label of the zero-shot model -> entity type.
ZERO_SHOT_LABELS = {
    "persoon": "PERSON", "naam": "PERSON",
    "locatie": "LOCATION", "woonplaats": "LOCATION", "gpe": "LOCATION", "gemeente": "LOCATION",
    "stad": "LOCATION", "wijk": "LOCATION", "buurt": "LOCATION",
    "straatnaam": "STREET_ADDRESS", "adres": "STREET_ADDRESS",
    "nationaliteit": "NORP", "religie": "NORP", "politieke_groep": "NORP",
    "politieke_partij": "POLITICAL_PARTY",
    "organisatie": "ORGANIZATION", "werkgever": "ORGANIZATION", "bedrijf": "ORGANIZATION",
    "inkomen": "INCOME", "salaris": "INCOME",
    "opleidingsniveau": "EDUCATION_LEVEL", "opleiding": "EDUCATION_LEVEL",
}
ZERO_SHOT_THRESHOLD = 0.45

# Context boost.
CONTEXT_FACTOR = 0.35
CONTEXT_MIN_SCORE = 0.4

# Building blocks of the date, plate and address expressions.
_DAY = r"(?:0?[1-9]|[12][0-9]|3[01])"
_MONTH = r"(?:0?[1-9]|1[0-2])"
_YEAR = r"(?:19|20)\d{2}"
_DATE_SEP = r"[-/.]"
_MONTH_NAMES = (
    "januari", "februari", "maart", "april", "mei", "juni",
    "juli", "augustus", "september", "oktober", "november", "december",
)
# X is a capital letter, 9 a digit.
_PLATE_LAYOUTS = (
    "XX-99-99", "99-99-XX", "99-XX-99", "XX-99-XX", "XX-XX-99", "99-XX-XX", "99-XXX-9",
    "9-XXX-99", "XX-999-X", "X-999-XX", "XXX-99-X", "X-99-XXX", "9-XX-999", "999-XX-9",
)
_PLATE = "|".join(p.replace("X", "[A-Z]").replace("9", r"\d") for p in _PLATE_LAYOUTS)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]"

# recognizer, entity type, ((pattern, expression, score, lead), ...), validator.
# "lead" restates how a match begins; it only speeds the scan up (see scan_regex).
_PATTERN_TABLE = (
    ("DutchPhoneNumberRecognizer", "PHONE_NUMBER", (
        ("DUTCH_PHONE", r"(?<!\w)(?:0|\+31|0031)[- ]?(?:\d[- ]?){9}\b", 0.6, r"[0+]"),
    ), None),
    ("DutchIBANRecognizer", "IBAN", (
        ("DUTCH_IBAN", r"\bNL\d{2}\s?[A-Z]{4}\s?(?:\d{10}|\d{4}\s?\d{4}\s?\d{2})\b", 0.6, r"NL\d"),
        ("INTL_IBAN", r"\b(?!NL)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b", 0.55, r"[A-Z]{2}\d"),
    ), None),
    ("EmailRecognizer", "EMAIL", (
        ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.6, None),
    ), None),
    ("DutchBSNRecognizer", "BSN", (
        ("NL_BSN", r"\b\d{3}[- ]?\d{3}[- ]?\d{3}\b", 0.6, r"\d{3}"),
    ), "bsn"),
    ("DutchPostcodeRecognizer", "POSTCODE", (
        ("NL_POSTCODE", r"(?<!\d[-/.])\b[1-9]\d{3}\s?(?!SA|SD|SS)[A-HJ-NP-Z]{2}\b", 0.55, r"[1-9]\d{3}"),
    ), None),
    ("DutchVATRecognizer", "VAT_NUMBER", (
        ("NL_VAT", r"\bNL\d{9}B\d{2}\b", 0.6, r"NL\d"),
    ), None),
    ("DutchKvKRecognizer", "KVK_NUMBER", (
        ("KVK_8_DIGIT", r"(?<!\d[/ ])\b\d{8}\b", 0.45, r"\d{8}"),
    ), None),
    ("DutchLicensePlateRecognizer", "LICENSE_PLATE", (
        ("NL_PLATE", rf"\b(?:{_PLATE})\b", 0.5, r"[A-Z\d]{1,3}-"),
    ), None),
    ("IPv4Recognizer", "IP_ADDRESS", (
        ("IPV4", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", 0.5, r"\d"),
    ), None),
    ("DutchDateRecognizer", "DATE_TIME", (
        ("DATE_DD_MM_YYYY", rf"\b{_DAY}{_DATE_SEP}{_MONTH}{_DATE_SEP}{_YEAR}\b", 0.5, r"\d"),
        ("DATE_MM_DD_YYYY", rf"\b{_MONTH}{_DATE_SEP}{_DAY}{_DATE_SEP}{_YEAR}\b", 0.5, r"\d"),
        ("DATE_YYYY_MM_DD", rf"\b{_YEAR}{_DATE_SEP}{_MONTH}{_DATE_SEP}{_DAY}\b", 0.5, r"\d{4}"),
        ("DATE_DD_MM_YY", rf"\b{_DAY}[\s/.-]{_MONTH}[\s/.-]\d{{2}}(?!\.\d)\b", 0.45, r"\d"),
        ("DATE_DD_MONTH_YYYY", rf"(?i)\b{_DAY}\s+(?:{'|'.join(_MONTH_NAMES)})\s+{_YEAR}\b", 0.5, r"\d"),
    ), None),
    ("DutchPassportIdRecognizer", "ID_NO", (
        ("NL_DOC_OLD", r"\b[A-NP-Z]{2}[A-NP-Z0-9]{6}\d\b", 0.55, r"[A-Z]{2}"),
        ("NL_DOC_NEW", r"\b[A-NP-Z]{2}[A-NP-Z1-9]{6}[1-9]\b", 0.6, r"[A-Z]{2}"),
    ), None),
    ("CaseNumberRecognizer", "CASE_NO", (
        ("CASE_Z", r"\bZ[-/]?\d{4}[-/]?\d{4,6}\b", 0.55, r"Z"),
        ("CASE_PREFIXED", r"\b(?:WOO|BEZWAAR|INT|VTH|WP)[-/]?\d{4}[-/]?\d{3,6}\b", 0.6, r"[BIVW]"),
        ("CASE_YEAR_NUMBER", r"\b\d{4}[-/]\d{4,6}\b", 0.45, r"\d{4}"),
        ("CASE_BAG_ID", r"\b\d{16}\b", 0.4, r"\d{16}"),
        ("CASE_UUID", rf"\b{_HEX}{{8}}-(?:{_HEX}{{4}}-){{3}}{_HEX}{{12}}\b", 0.35, rf"{_HEX}{{8}}-"),
        ("CASE_C_CIVIL", r"\bC/\d{2}/\d{5,8}\b", 0.55, r"C/"),
        ("CASE_AWB", r"\bAWB\s?\d{2}/\d{3,6}\b", 0.6, r"AWB"),
        ("CASE_HR", r"\bHR\s?\d{2}/\d{5}\b", 0.6, r"HR"),
        ("CASE_GERECHTSHOF", r"\b200\.\d{5}\b", 0.55, r"200"),
        ("CASE_OM", r"\b\d{2}/\d{6}-\d{2}\b", 0.6, r"\d{2}/"),
        ("CASE_COURT_GENERIC", r"\b[A-Z]{4,5}\s?\d{2}/\d{3,6}\b", 0.55, r"[A-Z]{4}"),
    ), None),
    ("MACAddressRecognizer", "MAC_ADDRESS", (
        ("MAC_COLON", rf"\b(?:{_HEX}{{2}}:){{5}}{_HEX}{{2}}\b", 0.9, rf"{_HEX}{{2}}:"),
        ("MAC_DASH", rf"\b(?:{_HEX}{{2}}-){{5}}{_HEX}{{2}}\b", 0.9, rf"{_HEX}{{2}}-"),
        ("MAC_CISCO_DOT", rf"\b(?:{_HEX}{{4}}\.){{2}}{_HEX}{{4}}\b", 0.85, rf"{_HEX}{{4}}\."),
    ), None),
    ("DutchDriversLicenseRecognizer", "DRIVERS_LICENSE", (
        ("NL_DRIVERS_LICENSE", r"\b\d{10}\b", 0.45, r"\d{10}"),
    ), None),
)

# pattern -> strings one of which is in every match; a text with none of them is not passed over.
_NEEDS = {
    "DUTCH_IBAN": ("NL",), "NL_VAT": ("NL",), "NL_PLATE": ("-",), "IPV4": (".",), "DATE_YYYY_MM_DD": ("-", "/", "."),
    "CASE_Z": ("Z",), "CASE_PREFIXED": ("WOO", "BEZWAAR", "INT", "VTH", "WP"), "CASE_YEAR_NUMBER": ("-", "/"),
    "CASE_UUID": ("-",), "CASE_C_CIVIL": ("C/",), "CASE_AWB": ("AWB",), "CASE_HR": ("HR",), "CASE_GERECHTSHOF": ("200.",),
    "CASE_OM": ("/",), "CASE_COURT_GENERIC": ("/",), "MAC_COLON": (":",), "MAC_DASH": ("-",), "MAC_CISCO_DOT": (".",),
}

# profile -> (pattern recognizers, name detectors)
_ALL_PATTERN_RECOGNIZERS = tuple(row[0] for row in _PATTERN_TABLE)
_CLASSIC_RECOGNIZERS = tuple(n for n in _ALL_PATTERN_RECOGNIZERS if n != "DutchPostcodeRecognizer")
PROFILES = {
    # patterns and the name model
    "classic": (_CLASSIC_RECOGNIZERS, ("spacy",)),
    # as shipped: every pattern off but MAC, zero-shot model instead of the name model
    "gpu": (("MACAddressRecognizer",), ("gliner",)),
    # what the service uses when no profile is named: the same switches as "gpu"
    "default": (("MACAddressRecognizer",), ("gliner",)),
    # as documented: patterns and the zero-shot model
    "gpu_full": (_CLASSIC_RECOGNIZERS, ("gliner",)),
    # classic and the postcode recognizer no shipped profile lists
    "all": (_ALL_PATTERN_RECOGNIZERS, ("spacy",)),
}
DEFAULT_PROFILE = "classic"

DETECTOR_ENTITIES = {
    "spacy": ("PERSON", "LOCATION", "ORGANIZATION"),
    "gliner": tuple(dict.fromkeys(ZERO_SHOT_LABELS.values())),
}
# Detectors whose spans give way to any overlapping pattern span.
NER_ENTITIES = tuple(dict.fromkeys(NER_LABELS.values()))

# Pattern entity types when no catalogue is at hand.
FALLBACK_PATTERN_ENTITIES = (
    "PHONE_NUMBER", "IBAN", "BSN", "DATE_TIME", "EMAIL", "ID_NO", "DRIVERS_LICENSE",
    "VAT_NUMBER", "KVK_NUMBER", "LICENSE_PLATE", "IP_ADDRESS", "CASE_NO",
)

# Recall floors of the quality gates.
PATTERN_RECALL_FLOOR = {
    e: 1.0 for e in (
        "EMAIL", "PHONE_NUMBER", "IBAN", "DATE_TIME", "BSN", "LICENSE_PLATE", "KVK_NUMBER",
        "CASE_NO", "IP_ADDRESS",
    )
}
NER_RECALL_BANDS = {
    "classic": {"PERSON": 0.75, "LOCATION": 0.75, "ORGANIZATION": 0.50},
    "gpu": {"PERSON": 0.85, "LOCATION": 0.80, "ORGANIZATION": 0.60},
}

# ---------------------------------------------------------------------------
# Catalogue
# ---------------------------------------------------------------------------

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("recognizer", T.StringType(), False),
    T.StructField("entity_type", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("regex", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("validator", T.StringType(), True),
    T.StructField("language", T.StringType(), False),
    T.StructField("context", T.ArrayType(T.StringType()), True),
])


@dataclass(frozen=True)
class Recognizer:
    """One pattern of one recognizer.

    ``validator`` is the name of a registered check or a ``Column -> Column``
    function over the matched text; matches that fail it are dropped.
    ``lead`` optionally states how every match begins (a regular expression);
    it is a speed hint and must not exclude a real match.  ``group`` is set for
    built-in rows only: they share a guard with rows that begin alike.  ``needs``
    are strings one of which stands in every match, as another speed hint.
    """

    recognizer: str
    entity_type: str
    pattern: str
    regex: str
    score: float
    validator: str | Callable[[Column], Column] | None = None
    language: str = DEFAULT_LANGUAGE
    context: tuple[str, ...] = ()
    lead: str | None = None
    group: str | None = None
    needs: tuple[str, ...] = ()


def _builtin_group(lead: str | None) -> str | None:
    if lead is None:
        return None
    if lead.startswith(_HEX):
        return "hex"
    return "capital" if lead[0].isalpha() or lead.startswith(("[A-Z", "[B")) else "digit"


def builtin_catalogue() -> list[Recognizer]:
    """Every built-in pattern as catalogue rows."""
    return [
        Recognizer(name, entity, pattern, regex, score, validator, lead=lead,
                   group=_builtin_group(lead), needs=_NEEDS.get(pattern, ()))
        for name, entity, patterns, validator in _PATTERN_TABLE
        for pattern, regex, score, lead in patterns
    ]


def load_recognizer(name: str) -> list[Recognizer]:
    """The catalogue rows of one built-in recognizer, by name."""
    rows = [r for r in builtin_catalogue() if r.recognizer == name]
    if not rows:
        raise ValueError(f"unknown recognizer {name!r}")
    return rows


@dataclass(frozen=True)
class Plan:
    """What one job will look for: pattern rows, detectors, wanted types."""

    profile: str
    rows: tuple[Recognizer, ...]
    detectors: tuple[str, ...]
    entities: tuple[str, ...] | None  # None = every type

    @property
    def pattern_entities(self) -> tuple[str, ...]:
        return tuple(sorted({r.entity_type for r in self.rows}))


def resolve_entities(entities: Iterable[str] | str | None) -> tuple[str, ...] | None:
    """``None`` and an empty list mean the default set; ``"all"`` means no filter."""
    if isinstance(entities, str):
        if entities == "all":
            return None
        entities = [entities]
    return tuple(dict.fromkeys(entities or ())) or DEFAULT_ENTITIES


def parse_entity_list(text: str) -> tuple[str, ...]:
    """``"email, iban"`` -> ``("EMAIL", "IBAN")``."""
    return tuple(dict.fromkeys(p.strip().upper() for p in text.split(",") if p.strip()))


def recognizer_from_config(entry: Mapping) -> list[Recognizer]:
    """Catalogue rows of one plug-in entry ``{name, type, enabled, ...}``.

    A ``pattern`` entry names a built-in recognizer or brings its own
    ``entity_type`` and ``patterns``; a detector entry has no rows here.
    """
    kind = entry.get("type")
    if kind not in ("pattern", "spacy", "transformer", "llm", "gliner"):
        raise ValueError(f"unknown plug-in type {kind!r} of {entry.get('name')!r}")
    if kind != "pattern" or not entry.get("enabled", True):
        return []
    if "patterns" not in entry:
        return load_recognizer(entry["name"])
    return [
        Recognizer(entry["name"], entry["entity_type"], p["name"], p["regex"], float(p["score"]),
                   validator=entry.get("validator"), context=tuple(entry.get("context", ())))
        for p in entry["patterns"]
    ]


def select(
    profile: str = DEFAULT_PROFILE,
    entities: Iterable[str] | str | None = None,
    extra: Iterable[Recognizer] = (),
    detectors: Mapping[str, Iterable[str]] | None = None,
    strict_contract: bool = False,
    catalogue: Iterable[Recognizer] | None = None,
) -> Plan:
    """Prune the catalogue to what a job needs, or fail before it starts.

    ``detectors`` maps the name of each available detector to the entity types
    it yields; they widen the set of types that can be asked for.  A type asked for that
    no active source yields is an error; with ``strict_contract`` one of the default types is too.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known: {', '.join(PROFILES)}")
    names, _ = PROFILES[profile]
    rows = list(catalogue) if catalogue is not None else [
        r for r in builtin_catalogue() if r.recognizer in names
    ]
    rows += list(extra)
    available = {d: tuple(t) for d, t in (detectors or {}).items()}
    # a zero-shot model that runs displaces the name model
    if "gliner" in available:
        available.pop("spacy", None)
    wanted = resolve_entities(entities)
    # what an active source yields; external spans may be of any type
    contract = {r.entity_type for r in rows}
    for types in available.values():
        contract.update(types)
    if wanted is not None:
        asked = strict_contract or (entities and wanted != DEFAULT_ENTITIES)
        unknown = [e for e in wanted if e not in contract]
        if asked and unknown and "external" not in available:
            raise ValueError(
                f"no recognizer of profile {profile!r} supports: {', '.join(unknown)}")
        rows = [r for r in rows if r.entity_type in wanted]
    return Plan(profile, tuple(rows), tuple(available), wanted)


def with_context(rows: Iterable[Recognizer], words: Mapping[str, Iterable[str]]) -> list[Recognizer]:
    """Attach context words per entity type."""
    return [replace(r, context=tuple(words.get(r.entity_type, r.context))) for r in rows]


def catalogue_table(spark: SparkSession, rows: Iterable[Recognizer] | None = None) -> DataFrame:
    """The catalogue as a DataFrame (audit, joins with quality tables)."""
    data = [
        (r.recognizer, r.entity_type, r.pattern, r.regex, r.score,
         r.validator if isinstance(r.validator, str) or r.validator is None else "custom",
         r.language, list(r.context))
        for r in (builtin_catalogue() if rows is None else rows)
    ]
    return spark.createDataFrame(data, CATALOGUE_SCHEMA)
