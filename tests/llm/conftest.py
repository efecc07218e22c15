import pytest
from pyspark.sql import functions as F

from .odd import ODD, prose


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "lang", k % 3, k) for k, t in enumerate(ODD)] + [(5, ODD[5], "lang", 0, 1), (None, "null id " + prose(20), None, None, None), (99, ODD[6], "x", 1, 2)]
    # extra columns that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, n_words long").withColumn("base", F.lit(1)).withColumn("hit", F.lit("h"))
