"""One query per operator, over whole tables.

``letters`` (made from customer and nation) carries most identifiers;
``documents``, ``conversations``, ``pages`` and ``benchmark`` are scanned as
they are.  Results are flat rows so that they can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import resolve as R
from veilspark.functions.spans import is_valid_bsn, regex_spans, strip_text
from veilspark.operators import evaluate as E
from veilspark.operators import ner
from veilspark.operators import rows as rows_form
from veilspark.operators.lineage import shared_path
from veilspark.operators.validate import bad_labels, bad_spans, prepare, rejected_rows
from veilspark.plans.analyze import analyze, analyze_rows, anonymize, explode_spans
from veilspark.plans import sql
from veilspark.plans.config import options_of
from veilspark.plans.jobs import evaluate_samples, golden_comparison, pattern_entity_filter
from veilspark.plans.jobs import golden_floors as golden_minimums
from veilspark.sources.letters import dossiers, letters
from veilspark.sources.readers import read_config, read_golden, read_samples, read_texts, read_thresholds, spread
from veilspark.sources.sinks import write_checked, write_golden
from veilspark.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SPAN = ("entity_type", "start", "end", "score", "text")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def parted(df: DataFrame) -> DataFrame:
    """Split further only where the session asks for a number of splits; one small file has one row group."""
    return spread(df, int(df.sparkSession.conf.get("spark.sql.files.minPartitionNum", None) or 0))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return parted(read_texts(spark, f"{sf}/documents.parquet"))


def letter_texts(spark: SparkSession, sf: str) -> DataFrame:
    return letters(spark, sf).select("doc_id", "text")


def dossier_texts(spark: SparkSession, sf: str) -> DataFrame:
    return dossiers(spark, sf)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


# --- the scan ---------------------------------------------------------------


def _scan_query(name: str, table, entities, **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return analyze_rows(table(spark, sf), entities, profile="all", **options).select(
            "doc_id", *SPAN, "pattern")
    QUERIES[name] = run


_scan_query("scan_documents", documents, "all")
_scan_query("scan_letters", letter_texts, "all")
_scan_query("scan_dossiers", dossier_texts, "all")
for _entity in ("PHONE_NUMBER", "IBAN", "EMAIL", "BSN", "POSTCODE", "VAT_NUMBER", "KVK_NUMBER",
                "LICENSE_PLATE", "IP_ADDRESS", "DATE_TIME", "ID_NO", "CASE_NO", "MAC_ADDRESS",
                "DRIVERS_LICENSE"):
    _scan_query(f"find_{_entity.lower()}", letter_texts, [_entity])
_scan_query("scan_letters_insensitive", letter_texts, "all", case="insensitive")


# Patterns whose values stand in the dossiers; the others stand in the letters.
IN_DOSSIERS = (
    "INTL_IBAN", "NL_DOC_NEW", "DATE_YYYY_MM_DD", "DATE_DD_MM_YY", "DATE_DD_MONTH_YYYY", "CASE_PREFIXED",
    "CASE_BAG_ID", "CASE_UUID", "CASE_C_CIVIL", "CASE_AWB", "CASE_HR", "CASE_GERECHTSHOF", "CASE_OM",
    "CASE_COURT_GENERIC", "MAC_DASH", "MAC_CISCO_DOT",
)


def _pattern_query(row: catalog.Recognizer):
    table = dossier_texts if row.pattern in IN_DOSSIERS else letter_texts

    def run(spark: SparkSession, sf: str) -> DataFrame:
        texts = table(spark, sf).unionByName(
            documents(spark, sf).select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
        hits = texts.select("doc_id", F.explode_outer(regex_spans("text", row.regex)).alias("h"))
        return hits.filter("h is not null").select("doc_id", "h.start", "h.end", "h.text")
    QUERIES[f"pattern_{row.pattern.lower()}"] = run


for _row in catalog.builtin_catalogue():
    _pattern_query(_row)


@query
def valid_bsn(spark, sf):
    """The checksum on every customer name's digits."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    digits = F.expr("lpad(cast((c_custkey * 7919 + 123456782) % 1000000000 as string), 9, '0')")
    return c.select("c_custkey", digits.alias("bsn")).withColumn("ok", is_valid_bsn("bsn")).withColumn(
        "ok_name", is_valid_bsn_of_name()).select("c_custkey", "bsn", "ok", "ok_name")


def is_valid_bsn_of_name():
    return is_valid_bsn("replace(lpad(cast(c_custkey * 31 as string), 9, '0'), ' ', '')")


@query
def scan_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    return analyze_rows(parted(turns), "all", id_col="conv_id", keep=["turn"]).select("conv_id", "turn", *SPAN)


@query
def scan_pages(spark, sf):
    """Defaults on raw page source."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    return analyze_rows(parted(pages), id_col="page_id", text_col="html").select("page_id", *SPAN)


@query
def scan_benchmark(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    return analyze(parted(items), "all", id_col="item_id").select(
        "item_id", "text_length", "language", F.size("pii_entities").alias("n"))


# --- responses, validation, filters -----------------------------------------


@query
def analyze_letters(spark, sf):
    """The response per text, entities counted and written out."""
    a = analyze(letter_texts(spark, sf))
    return a.select("doc_id", "text_length", "language", F.size("pii_entities").alias("n"), F.array_join(
        F.expr("transform(pii_entities, s -> concat_ws(':', s.entity_type, s.start, s.end))"), "|").alias("entities"))


def _with_padding(spark, sf):
    """Letters with white space around them, some blank, some in other languages."""
    return letters(spark, sf).select(
        "doc_id",
        F.expr("case when doc_id % 10 = 0 then ' \t\n ' when doc_id % 10 = 1 then null "
               "when doc_id % 10 = 2 then '' else concat('\t ', text, ' \n\n') end").alias("text"),
        F.expr("case when doc_id % 7 = 0 then 'fr' when doc_id % 7 = 1 then 'en' when doc_id % 7 = 2 then null "
               "else 'nl' end").alias("language"),
        F.expr("case when doc_id % 11 = 0 then 'shred' when doc_id % 11 = 1 then 'mask' end").alias("strategy"))


@query
def valid_rows(spark, sf):
    ok = prepare(_with_padding(spark, sf), language_col="language", strategy_col="strategy")
    return ok.select("doc_id", F.length("text").alias("text_length"), "language")


@query
def rejected(spark, sf):
    bad = rejected_rows(_with_padding(spark, sf), language_col="language", strategy_col="strategy")
    return bad.select("doc_id", "reason")


@query
def stripped_texts(spark, sf):
    return documents(spark, sf).select("doc_id", F.length(strip_text(F.col("text"))).alias("text_length"))


@query
def default_entities(spark, sf):
    """No filter and an empty filter both mean the default types."""
    return analyze_rows(letter_texts(spark, sf), []).groupBy("entity_type").agg(F.count("*").alias("n"))


@query
def entity_filter(spark, sf):
    return analyze_rows(letter_texts(spark, sf), ["IBAN", "EMAIL", "KVK_NUMBER"]).groupBy("entity_type").agg(
        F.count("*").alias("n"), F.sum("start").alias("sum_start"))


@query
def score_threshold(spark, sf):
    return analyze_rows(letter_texts(spark, sf), "all", min_score=0.5).groupBy("entity_type", "score").agg(
        F.count("*").alias("n"))


@query
def profile_gpu(spark, sf):
    return analyze_rows(letter_texts(spark, sf), "all", profile="gpu").select("doc_id", *SPAN)


@query
def trimmed_spans(spark, sf):
    return analyze_rows(letter_texts(spark, sf), ["PHONE_NUMBER"], trim_spans=True).select("doc_id", *SPAN)


@query
def score_sanity(spark, sf):
    """Broken span rows; there are none, so the counts are zero."""
    spans = analyze_rows(letter_texts(spark, sf), "all", profile="all")
    return bad_spans(spans).agg(F.count("*").alias("bad"))


@query
def catalogue_coverage(spark, sf):
    """Hits per catalogue row, also of rows without any."""
    hits = analyze_rows(letter_texts(spark, sf), "all", profile="all").groupBy("pattern").agg(
        F.count("*").alias("n"))
    rows = catalog.catalogue_table(spark).select("entity_type", "pattern", "score")
    return rows.join(hits, "pattern", "left").na.fill(0, ["n"]).select("entity_type", "pattern", "score", "n")


@query
def checked_write(spark, sf):
    """Valid and rejected rows written in one pass, read back; the counts seen on the way beside those of the files."""
    path = shared_path(spark, "checked")
    seen = write_checked(_with_padding(spark, sf), path, language_col="language", strategy_col="strategy")
    rows = spark.read.parquet(path).groupBy("outcome", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("outcome") == "valid", F.length("text"))), F.lit(0)).alias("chars"))
    observed = F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])
    return rows.select("outcome", "reason", "n", observed[F.col("reason")].alias("seen"), "chars")


@query
def config_profile(spark, sf):
    """A plug-in file instead of a profile: some recognizers on, one off, one of its own."""
    path = shared_path(spark, "config")
    text = """
language: nl
recognizers:
  - {name: EmailRecognizer, type: pattern}
  - {name: MACAddressRecognizer, type: pattern, enabled: true}
  - {name: DutchIBANRecognizer, type: pattern, enabled: false}
  - name: PassRecognizer
    type: pattern
    entity_type: PASS_NOTE
    patterns: [{name: pass_note, regex: 'paspoort ZX[0-9]{7}', score: 0.7}]
"""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    options = options_of(read_config(spark, path))
    return analyze_rows(letter_texts(spark, sf), "all", **options).select("doc_id", *SPAN)


@query
def sql_spans_table(spark, sf):
    """Spans as rows by the SQL table function."""
    sql.register(spark, ["EMAIL", "IBAN"])
    letter_texts(spark, sf).createOrReplaceTempView("veil_letters")
    return spark.sql("SELECT d.doc_id, s.position, s.entity_type, s.start, s.end, s.text "
                     "FROM (SELECT doc_id, pii_spans(text) AS a FROM veil_letters) d, LATERAL spans_table(d.a) s")


@query
def sql_anonymize(spark, sf):
    """The SQL function that rewrites a text."""
    sql.register(spark, _WANTED)
    letter_texts(spark, sf).createOrReplaceTempView("veil_letters")
    return spark.sql("SELECT doc_id, pii_anonymize(text) AS anonymized_text FROM veil_letters")


# --- span sets ---------------------------------------------------------------


@query
def union_spans(spark, sf):
    """Dictionary spans and pattern spans in one table."""
    patterns = analyze_rows(letter_texts(spark, sf), ["EMAIL", "IP_ADDRESS"])
    names = ner.dictionary_spans(letter_texts(spark, sf), nation_names(spark, sf), ["doc_id"])
    return rows_form.union_spans(patterns, names).select("doc_id", "entity_type", "start", "end", "score")


def date_candidates(spark, sf):
    """All matches of the date patterns, before duplicates go: one row each."""
    rows = [r for r in catalog.builtin_catalogue() if r.entity_type == "DATE_TIME"]
    hits = None
    for r in rows:
        part = letter_texts(spark, sf).select("doc_id", F.explode_outer(regex_spans("text", r.regex)).alias("h")).filter(
            "h is not null").select(
            "doc_id", F.lit(r.entity_type).alias("entity_type"), "h.text", "h.start", "h.end",
            F.lit(r.score).alias("score"), F.lit(r.recognizer).alias("recognizer"), F.lit(r.pattern).alias("pattern"))
        hits = part if hits is None else hits.unionByName(part)
    return hits


@query
def dedup_rows(spark, sf):
    """Row form of duplicate removal."""
    return rows_form.dedup_same_type(date_candidates(spark, sf)).select(
        "doc_id", "entity_type", "start", "end", "score")


def synthetic_spans(spark, sf):
    """Overlapping spans of several types per order, from lineitem columns."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.expr("case l_linenumber % 4 when 0 then 'EMAIL' when 1 then 'PERSON' when 2 then 'IBAN' else 'LOCATION' end")
        .alias("entity_type"),
        F.lit(None).cast("string").alias("text"),
        F.expr("int(l_partkey % 60)").alias("start"),
        F.expr("int(l_partkey % 60 + 1 + l_suppkey % 13)").alias("end"),
        F.expr("case l_suppkey % 3 when 0 then 0.4D when 1 then 0.5D else 0.6D end").alias("score"),
        F.lit("r").alias("recognizer"), F.lit("p").alias("pattern"))


def _per_document(spans: DataFrame) -> DataFrame:
    return spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct(
        "entity_type", "text", "start", "end", "score", "recognizer", "pattern")).alias("spans"))


@query
def ner_overlap_rows(spark, sf):
    """Row form of the pattern-over-name rule."""
    return rows_form.drop_ner_overlaps(synthetic_spans(spark, sf), ["EMAIL", "IBAN"]).groupBy("entity_type").agg(
        F.count("*").alias("n"), F.sum("start").alias("sum_start"))


@query
def ner_overlap_arrays(spark, sf):
    """Array form of the pattern-over-name rule."""
    docs = _per_document(synthetic_spans(spark, sf)).select("doc_id", F.expr(
        R.drop_ner_overlaps("spans", ["EMAIL", "IBAN"], catalog.NER_ENTITIES)).alias("s"))
    return explode_spans(docs, "doc_id", "s").select("doc_id", "entity_type", "start", "end", "score")


@query
def dedup_arrays(spark, sf):
    docs = _per_document(synthetic_spans(spark, sf)).select(
        "doc_id", F.expr(R.dedup_same_type("spans")).alias("s"))
    return explode_spans(docs, "doc_id", "s").select("doc_id", "entity_type", "start", "end", "score")


@query
def merge_rows(spark, sf):
    return rows_form.merge_same_type(synthetic_spans(spark, sf)).select(
        "doc_id", "entity_type", "start", "end", "score")


@query
def merge_arrays(spark, sf):
    docs = _per_document(synthetic_spans(spark, sf)).select(
        "doc_id", F.expr(R.merge_same_type("spans")).alias("s"))
    return explode_spans(docs, "doc_id", "s").select("doc_id", "entity_type", "start", "end", "score")


@query
def resolve_rows(spark, sf):
    return rows_form.resolve_conflicts(synthetic_spans(spark, sf)).select(
        "doc_id", "entity_type", "start", "end", "score")


@query
def resolve_arrays(spark, sf):
    docs = _per_document(synthetic_spans(spark, sf)).select(
        "doc_id", F.expr(R.resolve_conflicts("spans")).alias("s"))
    return explode_spans(docs, "doc_id", "s").select("doc_id", "entity_type", "start", "end", "score")


@query
def result_order(spark, sf):
    """Place of every span in the result order of its letter."""
    return analyze_rows(letter_texts(spark, sf), "all", position="pred_idx").select(
        "doc_id", "pred_idx", "entity_type", "start", "end")


@query
def overlapping_pairs(spark, sf):
    """Pattern pairs that overlap within a letter, counted per pair of types."""
    s = rows_form.with_buckets(analyze_rows(letter_texts(spark, sf), "all", profile="all").select(
        "doc_id", "entity_type", "start", "end"))
    o = s.select(*[F.col(c).alias(f"o_{c}") for c in s.columns])
    pairs = s.join(o, (F.col("doc_id") == F.col("o_doc_id")) & (F.col("_bucket") == F.col("o__bucket"))
                   & (F.col("entity_type") < F.col("o_entity_type"))
                   & (F.col("start") < F.col("o_end")) & (F.col("end") > F.col("o_start"))
                   # a pair meets in every bucket both touch; count it in the first
                   & (F.col("_bucket") == F.floor(F.greatest("start", "o_start") / rows_form.BUCKET)))
    return pairs.groupBy("entity_type", F.col("o_entity_type").alias("other_type")).agg(F.count("*").alias("n"))


# --- anonymization -----------------------------------------------------------


def anonymize_documents(spark, sf):
    return anonymize(documents(spark, sf), "all", profile="all").select(
        "doc_id", "anonymized_text", "text_length", "anonymization_strategy",
        F.size("entities_found").alias("n"))


def _anonymize_query(name: str, table, entities, strategy: str, **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return anonymize(table(spark, sf), entities, strategy, **options).select("doc_id", "anonymized_text")
    QUERIES[name] = run


_WANTED = ["EMAIL", "IBAN", "IP_ADDRESS", "MAC_ADDRESS"]
_anonymize_query("anonymize_replace", letter_texts, _WANTED, "replace")
_anonymize_query("anonymize_redact", letter_texts, _WANTED, "redact")
_anonymize_query("anonymize_hash", letter_texts, _WANTED, "hash")
_anonymize_query("anonymize_mask", letter_texts, _WANTED, "mask")
_anonymize_query("anonymize_hash_salted", letter_texts, _WANTED, "hash", salt="zout")
_anonymize_query("anonymize_per_type", letter_texts, _WANTED, "replace",
                 operators={"EMAIL": "hash", "IBAN": "mask", "MAC_ADDRESS": "redact"})
_anonymize_query("anonymize_all", letter_texts, "all", "replace")


@query
def adjacent_merge(spark, sf):
    """Addresses with nothing but blanks between them become one placeholder."""
    texts = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.expr(
        "concat(c_name, ': klant', c_custkey, '@voorbeeld.nl', space(int(1 + c_custkey % 3)), 'a', c_custkey, "
        "'@voorbeeld.nl en b@voorbeeld.nl')").alias("text"))
    return anonymize(texts, ["EMAIL"], merge_adjacent=True).select("doc_id", "anonymized_text")


_anonymize_query("anonymize_documents_email", documents, ["EMAIL"], "replace")


@query
def entities_found(spark, sf):
    """Entities beside the new text are those of analyze."""
    a = anonymize(letter_texts(spark, sf), _WANTED)
    return explode_spans(a, "doc_id", "entities_found").select("doc_id", *SPAN)


# --- names -------------------------------------------------------------------


def nation_names(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select(
        F.col("n_name").alias("name"), F.lit("LOCATION").alias("entity_type"))


def gazetteer(spark, sf):
    people = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_name").alias("name"), F.lit("PERSON").alias("entity_type"))
    return people.unionByName(nation_names(spark, sf))


@query
def dictionary_names(spark, sf):
    return ner.dictionary_spans(letter_texts(spark, sf), gazetteer(spark, sf), ["doc_id"]).select(
        "doc_id", "entity_type", "start", "end", "score")


@query
def dictionary_large(spark, sf):
    """The same with names taken for too many to broadcast: bitmap of their beginnings, then one join."""
    names = ner.load_names(gazetteer(spark, sf), limit=0)
    return ner.dictionary_spans(letter_texts(spark, sf), names, ["doc_id"]).select(
        "doc_id", "entity_type", "start", "end", "score")


@query
def dictionary_own_types(spark, sf):
    """A dictionary of another type than the three of name models, asked for by that type."""
    brands = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("MAC AA:BB:CC:DD:EE:"), F.expr("lpad(cast(c_custkey % 50 as string), 2, '0')")).alias("name"),
        F.lit("DEVICE").alias("entity_type"))
    return analyze_rows(letter_texts(spark, sf), ["DEVICE", "EMAIL"], gazetteer=brands).select("doc_id", *SPAN)


@query
def stream_names(spark, sf):
    """Letters written as files and read as a stream, with names matched in the rows, or batch by batch if they are many."""
    source, out, state = (shared_path(spark, f"stream-{k}") for k in ("in", "out", "state"))
    letter_texts(spark, sf).write.parquet(source)
    texts = stream.read_stream(spark, source, "doc_id bigint, text string")
    running, schema, files = stream.write_analyzed(texts, out, state, once=True, gazetteer=gazetteer(spark, sf))
    running.awaitTermination()
    return explode_spans(spark.read.schema(schema).parquet(files)).select("doc_id", *SPAN)


@query
def dictionary_long_names(spark, sf):
    """Names of one to eight and more words: the phrase after ``schreef``, cut at six places."""
    ls = letters(spark, sf)
    tail = "13 + length(c_name) + length(n_name)"
    size = (f"CASE doc_id % 6 WHEN 0 THEN 7 WHEN 1 THEN 8 + length(c_name) WHEN 2 THEN 12 + length(c_name) "
            f"WHEN 3 THEN {tail} WHEN 4 THEN {tail} + 16 ELSE {tail} + 23 END")
    names = ls.select(F.expr(f"substring(text, instr(text, 'schreef'), int({size}))").alias("name"),
                      F.lit("PERSON").alias("entity_type"))
    return ner.dictionary_spans(letter_texts(spark, sf), names, ["doc_id"]).select(
        "doc_id", "entity_type", "start", "end", "score")


@query
def custom_recognizer(spark, sf):
    """A user's pattern whose matches begin with a lower-case word, stated as its lead."""
    own = catalog.Recognizer("PassRecognizer", "PASS_NOTE", "pass_note", r"\bpaspoort ZX\d{7}\b", 0.7, lead="paspoort")
    return analyze_rows(letter_texts(spark, sf), ["PASS_NOTE"], extra=[own]).select("doc_id", *SPAN)


@query
def analyze_with_dictionary(spark, sf):
    """Names give way to patterns that overlap them."""
    return analyze_rows(letter_texts(spark, sf), gazetteer=gazetteer(spark, sf)).select("doc_id", *SPAN)


@query
def external_spans(spark, sf):
    """Spans computed elsewhere join in: the place name, by position."""
    ls = letters(spark, sf)
    outside = ls.select("doc_id", F.lit("LOCATION").alias("entity_type"), F.expr("int(instr(text, n_name) - 1)").alias(
        "start"), F.expr("int(instr(text, n_name) - 1 + length(n_name))").alias("end"))
    return analyze_rows(letter_texts(spark, sf), ["LOCATION", "EMAIL"], external=outside).select(
        "doc_id", *SPAN, "recognizer")


@query
def label_map(spark, sf):
    """Model labels to entity types, counted over the parts' brands as stand-in labels."""
    labels = spark.read.parquet(f"{sf}/orders.parquet").select(F.expr(
        "element_at(array('PER', 'GPE', 'LOC', 'ORG', 'NORP', 'PERSON', 'DATE'), int(o_orderkey % 7) + 1)").alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).select(
        "label", ner.map_label("label").alias("entity_type"), "n")


@query
def zero_shot_label_map(spark, sf):
    labels = spark.read.parquet(f"{sf}/orders.parquet").select(F.expr(
        "element_at(array('persoon', 'wijk', 'adres', 'religie', 'werkgever', 'salaris', 'opleiding', 'x'), "
        "int(o_orderkey % 8) + 1)").alias("label"))
    mapped = labels.groupBy("label").agg(F.count("*").alias("n"))
    return mapped.select("label", ner.map_label("label", catalog.ZERO_SHOT_LABELS).alias("entity_type"), "n")


@query
def model_detector(spark, sf):
    """A user's model in Arrow batches; its label is mapped to an entity type."""
    def name_model(frames):  # stand-in for a model: the word after "schreef"
        import re

        import pandas as pd
        rule = re.compile(r"schreef (\S+)")
        for pdf in frames:
            yield pd.DataFrame(
                [(i, "PER", m.start(1), m.end(1)) for i, t in zip(pdf.doc_id, pdf.text) for m in rule.finditer(t)],
                columns=["doc_id", "entity_type", "start", "end"])

    ner.register_detector("spacy", name_model, ["PERSON"])
    return analyze_rows(letter_texts(spark, sf), ["PERSON", "IBAN"], detectors=["spacy"]).select(
        "doc_id", *SPAN, "recognizer")


@query
def zero_shot_labels(spark, sf):
    """Every label of the zero-shot model, and one it does not have."""
    labels = F.array(*map(F.lit, [*catalog.ZERO_SHOT_LABELS, "x"]))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    named = orders.select(F.get(labels, F.expr("int(o_orderkey % 23)")).alias("label"))
    return named.groupBy("label").agg(F.count("*").alias("n")).select(
        "label", ner.map_label("label", catalog.ZERO_SHOT_LABELS).alias("entity_type"), "n")


def word_model(rule: str, label: str):
    """A stand-in for a model: what a rule finds, under a model's label."""
    def model(frames):
        import re

        import pandas as pd
        found = re.compile(rule)
        for pdf in frames:
            yield pd.DataFrame(
                [(i, label, *m.span(1)) for i, t in zip(pdf.doc_id, pdf.text) for m in found.finditer(t)],
                columns=["doc_id", "entity_type", "start", "end"])
    return model


@query
def two_detectors(spark, sf):
    """Two models in one stage: names and places."""
    ner.register_detector("spacy", word_model(r"schreef (\S+)", "PER"), ["PERSON"])
    ner.register_detector("places", word_model(r" uit (.+?) \(BSN", "GPE"), ["LOCATION"])
    return analyze_rows(letter_texts(spark, sf), ["PERSON", "LOCATION", "IBAN"], detectors=["spacy", "places"]).select(
        "doc_id", *SPAN, "recognizer")


@query
def verified_by_model(spark, sf):
    """A model that sees candidates with the text around them, and nothing else."""
    def even_after_passport(frames):
        for pdf in frames:
            yield pdf["before"].str.endswith("paspoort ") & pdf["text"].str.contains("[02468]$")

    found = analyze(letter_texts(spark, sf), ["ID_NO", "BSN"], keep=["text"])
    return explode_spans(ner.verify_with(found, even_after_passport, ["ID_NO"])).select("doc_id", *SPAN)


@query
def context_boost(spark, sf):
    return analyze_rows(letter_texts(spark, sf), ["KVK_NUMBER", "VAT_NUMBER"], context={
        "KVK_NUMBER": ["kvk"], "VAT_NUMBER": ["kenteken"]}, context_window=3).select(
        "doc_id", "entity_type", "start", "end", F.round("score", 6).alias("score"))


@query
def context_boost_some(spark, sf):
    """Context words that stand near some spans of a type and not near others: places before a citizen number."""
    return analyze_rows(letter_texts(spark, sf), ["BSN", "DATE_TIME", "EMAIL"], context={
        "BSN": ["Germany", "france", "CHINA"], "DATE_TIME": ["nooit"]}, context_window=2).select(
        "doc_id", "entity_type", "start", "end", F.round("score", 6).alias("score"))


@query
def verified_spans(spark, sf):
    """A second check on candidates only ever removes some."""
    spans = analyze_rows(letter_texts(spark, sf), ["ID_NO", "BSN"])
    return ner.verify(spans, F.expr("entity_type <> 'ID_NO' or text rlike '[02468]$'")).select("doc_id", *SPAN)


# --- evaluation --------------------------------------------------------------

# Labels of a letter: what it holds by construction, some shifted by one, some
# under a wrong type.
_LABELS = [
    ("EMAIL", r"\S+@voorbeeld\.nl"), ("IBAN", r"NL91ABNA\d{10}"), ("VAT_NUMBER", r"NL\d{9}B01"),
    ("LICENSE_PLATE", r"AB-\d{2}-CD"), ("IP_ADDRESS", r"192\.168\.\d+\.1"),
]


def labelled_letters(spark, sf):
    """``sample_id, text, spans``: labels cut by position, one in five shifted, one in seven mistyped."""
    ls = letters(spark, sf).select(F.col("doc_id").alias("sample_id"), "text")
    parts = []
    for i, (kind, rx) in enumerate(_LABELS):
        hit = f"regexp_substr(text, r'{rx}')"
        move = f"if((sample_id + {i}) % 5 = 0, {4 if i % 2 else 30}, 0)"
        name = f"if((sample_id + {i}) % 7 = 0, 'KVK_NUMBER', '{kind}')"
        parts.append(
            f"named_struct('entity_type', {name}, 'text', {hit}, 'start', int(instr(text, {hit}) - 1 + {move}), "
            f"'end', int(instr(text, {hit}) - 1 + {move} + length({hit})))")
    return ls.withColumn("spans", F.expr(f"array({', '.join(parts)})"))


def letter_evaluation(spark, sf, **options) -> E.Evaluation:
    """Every type of the classic profile against the labels."""
    return evaluate_samples(labelled_letters(spark, sf), **options)


@query
def eval_metrics(spark, sf):
    return rounded(letter_evaluation(spark, sf).metrics, "precision", "recall", "f1")


@query
def eval_repeated_predictions(spark, sf):
    """Each prediction twice, once under the threshold: the weak copies count for nothing."""
    samples = labelled_letters(spark, sf)
    found = analyze(samples, "all", id_col="sample_id", keep=["text"])
    twice = found.withColumn("spans", F.expr(
        "concat(pii_entities, transform(pii_entities, s -> named_struct('entity_type', s.entity_type, 'text', s.text, "
        "'start', s.start, 'end', s.end, 'score', 0.1D, 'recognizer', s.recognizer, 'pattern', s.pattern)))"))
    return rounded(E.evaluate(E.prediction_rows(twice), E.truth_rows(samples)).metrics, "precision", "recall", "f1")


@query
def eval_overall(spark, sf):
    return rounded(letter_evaluation(spark, sf).overall, "precision", "recall", "f1")


@query
def eval_rollup(spark, sf):
    return rounded(letter_evaluation(spark, sf).metrics_rollup, "precision", "recall", "f1")


@query
def eval_metrics_table(spark, sf):
    return letter_evaluation(spark, sf).metrics_table


@query
def eval_entity_filter(spark, sf):
    return rounded(letter_evaluation(spark, sf, entities=["EMAIL", "IBAN"]).metrics, "precision", "recall", "f1")


@query
def eval_score_threshold(spark, sf):
    return rounded(letter_evaluation(spark, sf, score_threshold=0.55, iou_threshold=0.9).metrics,
                   "precision", "recall", "f1")


@query
def confusion_long(spark, sf):
    return letter_evaluation(spark, sf).confusion


@query
def confusion_share(spark, sf):
    return rounded(letter_evaluation(spark, sf).confusion_normalised, "share")


@query
def confusion_square(spark, sf):
    return letter_evaluation(spark, sf).confusion_matrix(
        ["EMAIL", "IBAN", "IP_ADDRESS", "KVK_NUMBER", "LICENSE_PLATE", "VAT_NUMBER"])


@query
def eval_errors(spark, sf):
    return rounded(letter_evaluation(spark, sf).errors, "iou")


@query
def eval_error_samples(spark, sf):
    return rounded(letter_evaluation(spark, sf).error_samples(), "iou").select(
        "kind", "entity_type", "sample_id", "start", "end", "total")


@query
def eval_error_distribution(spark, sf):
    return letter_evaluation(spark, sf).error_distribution


@query
def eval_error_summary(spark, sf):
    return letter_evaluation(spark, sf).error_summary


@query
def threshold_gate(spark, sf):
    minimums = E.thresholds_table(spark, {
        "EMAIL": {"precision": 0.5, "recall": 0.5}, "KVK_NUMBER": {"recall": 0.5}, "PERSON": {"precision": 0.1}})
    return rounded(letter_evaluation(spark, sf).gate(minimums), "precision", "recall", "f1")


@query
def gate_verdict(spark, sf):
    minimums = E.recall_floor(spark, catalog.PATTERN_RECALL_FLOOR)
    return E.verdict(letter_evaluation(spark, sf).gate(minimums, skip_missing=True))


@query
def recall_bands(spark, sf):
    """Soft recall bands; types without counts are left out."""
    bands = E.recall_floor(spark, {**catalog.NER_RECALL_BANDS["classic"], "EMAIL": 0.75})
    return rounded(letter_evaluation(spark, sf).gate(bands, skip_missing=True), "precision", "recall", "f1")


@query
def label_check(spark, sf):
    """Labels that do not cut out the stated value."""
    return bad_labels(labelled_letters(spark, sf)).select("sample_id", "entity_type", "start", "end", "stated", "found")


@query
def pattern_only_types(spark, sf):
    """Evaluation over the types of active pattern recognizers only."""
    return letter_evaluation(spark, sf, entities=pattern_entity_filter()).counts


@query
def iou_pairs(spark, sf):
    """IoU of neighbouring line items seen as spans."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    s1, e1 = F.expr("l_partkey % 50"), F.expr("l_partkey % 50 + 1 + l_suppkey % 20")
    s2, e2 = F.expr("l_suppkey % 50"), F.expr("l_suppkey % 50 + 1 + l_partkey % 20")
    from veilspark.functions.spans import iou
    return li.groupBy(F.round(iou(s1, e1, s2, e2), 6).alias("iou")).agg(F.count("*").alias("n"))


def _golden(spark, sf, profile: str = "classic", entities="all") -> E.GoldenComparison:
    samples = labelled_letters(spark, sf)
    golden = samples.select(F.col("sample_id").alias("id"), "text", F.col("spans").alias("entities"))
    return golden_comparison(golden, profile=profile, entities=entities)


@query
def golden_report(spark, sf):
    return rounded(_golden(spark, sf).report, "precision", "recall", "f1")


@query
def golden_missing(spark, sf):
    return _golden(spark, sf).missing


@query
def golden_extra(spark, sf):
    return _golden(spark, sf).extra


@query
def golden_extra_shown(spark, sf):
    return _golden(spark, sf).extra_shown()


@query
def golden_default_types(spark, sf):
    """The golden comparison with default types: others score zero recall."""
    return rounded(_golden(spark, sf, entities=None).report, "precision", "recall", "f1")


@query
def golden_profiles(spark, sf):
    reports = {p: _golden(spark, sf, p).report for p in ("classic", "gpu")}
    return rounded(E.compare_profiles(reports), "classic", "gpu")


@query
def evaluation_report(spark, sf):
    """The evaluation as one JSON document, read again: a row per type, and one without type for all."""
    block = "struct<precision: double, recall: double, f1: double, tp: long, fp: long, fn: long>"
    parsed = letter_evaluation(spark, sf).report().select(
        F.from_json("report", f"global {block}, per_entity map<string, {block}>").alias("j"))
    overall = F.struct(F.lit(None).cast("string").alias("key"), F.col("j.global").alias("value"))
    rows = parsed.select(F.explode(F.concat(F.map_entries("j.per_entity"), F.array(overall))).alias("r"))
    return rounded(rows.select(F.col("r.key").alias("entity_type"), "r.value.*"), "precision", "recall", "f1")


def sample_file(spark, sf) -> str:
    """The labelled letters as files that hold a JSON array each, one of every split."""
    def arrays(batches):
        import pandas as pd
        yield pd.DataFrame({"value": ["[" + ",".join(j for b in batches for j in b["j"]) + "]"]})

    rows = labelled_letters(spark, sf).select(F.to_json(F.struct(F.col("text").alias("full_text"), F.expr(
        "transform(spans, s -> named_struct('entity_type', s.entity_type, 'entity_value', s.text, "
        "'start_position', s.start, 'end_position', s.end))").alias("spans"))).alias("j"))
    path = shared_path(spark, "samples")
    rows.mapInPandas(arrays, "value string").write.text(path)
    return path


@query
def gate_from_files(spark, sf):
    """Samples and thresholds from files, evaluated and gated."""
    minimums = shared_path(spark, "thresholds")
    spark.createDataFrame([("EMAIL: {precision: 0.5, recall: 0.5}\nKVK_NUMBER: {recall: 0.5}\nPERSON: {precision: 0.1}",)],
                          "value string").coalesce(1).write.text(minimums)
    result = evaluate_samples(read_samples(spark, sample_file(spark, sf)))
    return rounded(result.gate(read_thresholds(spark, minimums)), "precision", "recall", "f1")


@query
def golden_from_files(spark, sf):
    """A golden set of JSON lines, compared, written as tables and read back."""
    source, out = shared_path(spark, "golden"), shared_path(spark, "golden-report")
    labelled_letters(spark, sf).select(F.col("sample_id").cast("string").alias("id"), "text", F.col("spans").alias("entities")
                                       ).write.json(source)
    golden = read_golden(spark, source)
    write_golden(golden_comparison(golden).persisted(), golden, out)
    kinds = "entity_type string, expected long, detected long, correct long"
    types = spark.read.schema(kinds).json(f"{out}/types")
    missing = spark.read.schema("missing string").json(f"{out}/missing").select(
        F.regexp_extract("missing", ":(.*)@", 1).alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("missing"))
    return types.join(missing, "entity_type", "left").na.fill(0, ["missing"])


@query
def golden_floors(spark, sf):
    """The exact recall of expected types beside its floor."""
    return _golden(spark, sf).floors(golden_minimums("classic")).select(
        "entity_type", "tp", "fp", "fn", F.round("recall", 6).alias("recall"), "min_recall", "passed")


QUERIES["anonymize_documents"] = anonymize_documents
