import pytest


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    out = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "2g").getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


#: Texts that every operator must take: nulls, empty, white space, ties, repeats, long, other scripts.
ODD = [None, "", " \n\t ", "a", "a", "Word word WORD", "é ñ ß " * 5, "x" * 30_000, "one two three " * 3_000, "0", "абв \U0001f600", "a\nb\n\na\n"]


@pytest.fixture
def odd(spark):
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(ODD)] + [(4, "a", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int")
