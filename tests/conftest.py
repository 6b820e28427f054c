import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ckpt-"))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def letters_df(spark):
    from veilspark.sources.letters import letters

    return letters(spark, SF).cache()


@pytest.fixture
def docs(spark):
    """Texts -> ``doc_id, text`` rows."""
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return make


@pytest.fixture
def found(docs):
    """Texts -> list of ``(doc_id, entity_type, start, end, text, score)``."""
    from veilspark.plans.analyze import analyze_rows

    def run(*texts, entities="all", profile="all", **options):
        rows = analyze_rows(docs(*texts), entities, profile=profile, **options).collect()
        return [(r.doc_id, r.entity_type, r.start, r.end, r.text, r.score) for r in rows]
    return run
