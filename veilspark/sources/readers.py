"""Sources: texts, labelled samples, golden examples, thresholds.  Schemas are declared."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators.evaluate import thresholds_table

GOLDEN_SCHEMA = (
    "id STRING, text STRING, "
    "entities ARRAY<STRUCT<entity_type: STRING, text: STRING, start: INT, end: INT>>")
SAMPLE_SCHEMA = (
    "full_text STRING, spans ARRAY<STRUCT<entity_type: STRING, entity_value: STRING, "
    "start_position: INT, end_position: INT>>")
TEXT_SCHEMA = "doc_id BIGINT, text STRING, language STRING"


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id",
               text_col: str = "text", keep: tuple[str, ...] = (), schema: T.StructType | str | None = None,
               min_partitions: int | None = None, **options) -> DataFrame:
    """Texts of a parquet, ORC, JSON, CSV or plain-text source as ``doc_id, text``.

    Plain text gives one row per line, or per file with ``wholetext=True``; its
    id is a hash of file name and line, so repeated lines of one file share it.
    """
    reader = spark.read.options(**options)
    if fmt == "text":
        df = reader.text(path).select(
            F.xxhash64(F.col("_metadata.file_path"), "value").alias("doc_id"), F.col("value").alias("text"))
    elif fmt in ("json", "csv"):
        df = reader.format(fmt).schema(schema or TEXT_SCHEMA).load(path).select(
            F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    elif fmt in ("parquet", "orc"):
        df = reader.format(fmt).load(path).select(
            F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return spread(df, min_partitions)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Repartition a source if asked to: a single small file would keep one core busy.

    Without ``partitions`` the source's own splits are kept and no text is shuffled.
    """
    return df.repartition(partitions) if partitions else df


def spread_rows(df: DataFrame) -> DataFrame:
    """Narrow rows from which texts will be made, dealt over the session's shuffle partitions.

    A columnar file of a few megabytes is one split, however many texts come of it.  Rows are dealt by their places, so
    copies and null keys do no harm; a number given by hand is not coalesced to the size of the narrow rows.
    """
    conf = df.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), int(conf.get("spark.sql.files.minPartitionNum", None) or 0))
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    return placed.repartitionById(parts, F.pmod("_place", F.lit(parts)).cast("int")).drop("_place")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``id, text, entities``; blank lines are skipped, a line that does not parse ends the job."""
    return spark.read.schema(GOLDEN_SCHEMA).option("mode", "FAILFAST").json(path)


def golden_spans(golden: DataFrame) -> DataFrame:
    """``id, entity_type, start, end`` of every label."""
    # the outer form: for explode the optimizer would put the whole array into a filter below
    exploded = golden.select("id", F.explode_outer("entities").alias("e")).filter(F.col("e").isNotNull())
    return exploded.select("id", "e.entity_type", "e.start", "e.end")


def _label_array(spans: str, text: str, start: str, end: str) -> Column:
    return F.expr(
        f"transform(coalesce({spans}, array()), s -> named_struct('entity_type', s.entity_type, "
        f"'text', s.{text}, 'start', s.{start}, 'end', s.{end}))")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled sentences as ``sample_id, text, spans``.

    An absent ``spans`` is an empty list.  The id is a hash of text and labels;
    equal samples share it, and the evaluation counts their spans.
    """
    raw = spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(
        F.xxhash64("full_text", F.to_json("spans")).alias("sample_id"), F.col("full_text").alias("text"),
        _label_array("spans", "entity_value", "start_position", "end_position").alias("spans"))


def golden_as_samples(golden: DataFrame) -> DataFrame:
    """Golden examples in the shape of samples."""
    return golden.select(F.col("id").alias("sample_id"), "text",
                         _label_array("entities", "text", "start", "end").alias("spans"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """A YAML map ``type: {precision, recall}`` (a few dozen types)."""
    data = _yaml(spark, path)
    if not isinstance(data, Mapping):
        raise ValueError(f"{path}: not a map of entity types")
    return thresholds_table(spark, {k: v or {} for k, v in data.items()})


def read_config(spark: SparkSession, path: str) -> dict:
    """A plug-in file, for :func:`veilspark.plans.config.options_of`."""
    data = _yaml(spark, path)
    if not isinstance(data, Mapping):
        raise ValueError(f"{path}: not a map")
    return dict(data)


def _yaml(spark: SparkSession, path: str):
    """A small YAML file, from wherever Spark reads."""
    import yaml

    return yaml.safe_load("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())) or {}
