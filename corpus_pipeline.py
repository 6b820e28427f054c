"""From documents to token ids: five stages, each of which works on all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows into the folder named by ``spark.checkpoint.dir`` and reads them again for the next.

Odd rows: documents whose text is null or has no letter go in the first stage, with those of no clear language;
repeated rows and rows with null ids are near duplicates like others, so one of each group stays; a text that
only repeats earlier documents stays as an empty one; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, langid, pieces, simhash, substring
from veilspark.llm.common import cut, discard, table

#: SQL can express neither the fitted language model nor the hashes of the second stage.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language of at least 0.3 probability."""
    return langid.keep_known(docs, langid.trained(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has too."""
    return substring.remove_repeats(docs, length_col="n_chars")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, and whether decoding gives the text back."""
    encode = pieces.encoder_of(spark, pieces.Vocabulary.load(), check=True)
    return docs.select("doc_id", "lang", "source", encode(F.col("text")).alias("r")).select("doc_id", "lang", "source", "r.*")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings),
          ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if held is not None:
            discard(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
