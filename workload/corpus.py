"""The test corpus: labelled sentences of the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.session import spread

# A text holds fewer than 2^31 characters, so sentence numbers never reach the next document.
IDS_PER_DOCUMENT = 1 << 31


def labelled_sentences(spark: SparkSession, sf_dir: str, third: bool = False) -> DataFrame:
    """(id, sentiment, text): the sentences of ``documents`` with the class of their ``labels``.

    Commas become spaces, as in a comma-separated corpus.  The documents hold no negated
    words, so two frequent words are turned into them.  ``third``: toxic documents are a class of
    their own, ``neutral``.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    two = F.when(F.col("quality") == 1, "positive").otherwise("negative")
    named = F.when(F.col("toxic") == 1, "neutral").otherwise(two) if third else two
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", named.alias("sentiment"))
    # cleaned inside the array: a filter on an expression would be pushed down, and evaluate it twice
    cleaned = F.transform(F.split("text", "[.\n]"), _cleaned)
    sentences = spread(documents, "doc_id").join(labels, "doc_id").select(
        "doc_id", "sentiment", F.posexplode(cleaned).alias("nth", "text")
    )
    return sentences.select(
        (F.col("doc_id") * IDS_PER_DOCUMENT + F.col("nth")).alias("id"), "sentiment", "text"
    ).filter(F.col("text") != "")


def _cleaned(sentence: Column) -> Column:
    text = F.replace(sentence, F.lit(","), F.lit(" "))
    text = F.replace(text, F.lit(" it "), F.lit(" NOT_"))
    text = F.replace(text, F.lit(" are "), F.lit(" arenot "))
    return F.btrim(F.regexp_replace(text, "[ \t\r\n]+", " "))
