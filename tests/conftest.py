import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from counterpoise.operators.generate import Lexicons  # noqa: E402
from counterpoise.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def lex(spark):
    return Lexicons(
        antonyms=spark.createDataFrame(
            [("good", "bad"), ("happy", "sad"), ("hot", "cold")], "word string, repl string"
        ),
        similar=spark.createDataFrame(
            [("a", "great", "awesome"), ("a", "day", "night"), ("b", "great", "big")],
            "name string, word string, repl string",
        ),
        senti=spark.createDataFrame([("good",)], "word string"),
    )
