import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from styloscope.session import DEFAULT_CONF, configure

    b = SparkSession.builder.master("local[4]").appName("styloscope-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="styloscope-test-ckpt-"))
    configure(s)
    yield s
    s.stop()


def problems_df(spark, texts, difficulty="easy"):
    """Literal problems: list of texts (lines joined by newlines) -> problems DataFrame."""
    rows = [(i, difficulty, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "problem_id long, difficulty string, text string")


def sentences_df(spark, texts, difficulty="easy"):
    from styloscope.operators.sentences import split_sentences
    return split_sentences(problems_df(spark, texts, difficulty))
