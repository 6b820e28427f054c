"""Structured Streaming: the same maps on a stream.

``analyze`` and ``anonymize`` are stateless, so they run in append mode without
a watermark; so does a dictionary that is matched in the rows.  One too large for that, and
external spans, need a grouping, so they belong in ``foreachBatch`` (:func:`write_batches`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veilspark.operators.names import Names, load_names
from veilspark.plans.analyze import analyze, anonymize


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                **options) -> DataFrame:
    """New files of a folder as a stream of texts."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def analyze_stream(df: DataFrame, *args, **options) -> DataFrame:
    return analyze(df, *args, **_without_grouping(options))


def anonymize_stream(df: DataFrame, *args, **options) -> DataFrame:
    return anonymize(df, *args, **_without_grouping(options))


def _without_grouping(options: dict) -> dict:
    """The options with the dictionary loaded once; fails where spans would have to be grouped."""
    if options.get("external") is not None:
        raise ValueError("external spans need a grouping: use write_batches")
    given = options.get("gazetteer")
    if given is None:
        return options
    names = given if isinstance(given, Names) else load_names(given)
    if names.trie is None:
        raise ValueError("a dictionary of this size needs a grouping: use write_batches")
    return {**options, "gazetteer": names}


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 once: bool = False) -> StreamingQuery:
    """Append results to files; ``once`` handles what is there and stops."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def write_analyzed(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False,
                   **options) -> tuple[StreamingQuery, StructType, str]:
    """Analyze a stream into files; returns the query, the schema of the results and the pattern of their paths.

    A dictionary that is matched in the rows, or none, stays one map; one too large for that and external spans are
    analyzed batch by batch.  The dictionary is loaded once.
    """
    given = options.get("gazetteer")
    if given is not None and not isinstance(given, Names):
        options["gazetteer"] = given = load_names(given)
    if options.get("external") is None and (given is None or given.trie is not None):
        found = analyze_stream(df, **options)
        return write_stream(found, path, checkpoint, fmt, once), found.schema, path
    schema = analyze(df.sparkSession.createDataFrame([], df.schema), **options).schema
    return write_batches(df, lambda batch: analyze(batch, **options), path, checkpoint, fmt, once), schema, f"{path}/batch=*"


def write_batches(df: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                  fmt: str = "parquet", once: bool = False) -> StreamingQuery:
    """Run a batch-only transform per micro-batch.

    Each batch has its own folder, overwritten on a retry, so a restart after a
    failure repeats no rows.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.format(fmt).mode("overwrite").save(f"{path}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
