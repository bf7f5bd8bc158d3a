"""Lexicon and vocabulary loaders.

All of them take lines as ``(value, line_no)``; ``line_no`` may be any orderable column and
decides which of several entries for one word wins (the last).  De-duplication is an
aggregation with map-side combine, so a word listed very often is harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an order: file, start of the split in it, row within the split."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
    )


# Room for the place of an entry below the number of its line.
PLACES = 1 << 32


def _number(rows: DataFrame, column: str) -> Column | None:
    """One number in the order of ``column`` if that is a long or a (long, int), else NULL.

    Numbers are compared in a hash aggregation; for any other order Spark sorts all rows.
    """
    kind = rows.schema[column].dataType
    if isinstance(kind, LongType):
        return F.col(column)
    if isinstance(kind, StructType) and [type(f.dataType) for f in kind] == [LongType, IntegerType]:
        line, nth = (F.col(column)[f.name].cast("decimal(19,0)") for f in kind)
        line = F.coalesce(line, F.lit(str(-(1 << 63) - 1)).cast("decimal(19,0)"))
        nth = F.coalesce(nth, F.lit(str(-(1 << 31) - 1)).cast("decimal(19,0)"))
        return F.when(F.col(column).isNotNull(), line * F.lit(PLACES).cast("decimal(10,0)") + nth)
    return None


def _last_wins(pairs: DataFrame, name: str) -> DataFrame:
    """The last entry of every word.  The last line of equal entries is found first, by hashing."""
    rows = pairs.dropna(subset=["word", "repl"])
    number = _number(rows, "line_no")
    if number is not None:
        last = F.max(number).alias("line_no")
        rows = rows.groupBy("word", "repl").agg(last)
    return (
        rows.groupBy("word")
        .agg(F.max_by("repl", "line_no").alias("repl"))
        .select(F.lit(name).alias("name"), "word", "repl")
    )


def antonym_lexicon(lines: DataFrame, name: str = "antonyms") -> DataFrame:
    """``word,antonym[,ignored...]`` -> (name, word, repl), both in lower case."""
    parts = F.split("value", ",")
    pairs = lines.select(
        F.lower(F.get(parts, F.lit(0))).alias("word"),
        F.lower(F.get(parts, F.lit(1))).alias("repl"),
        "line_no",
    )
    return _last_wins(pairs, name)


def similar_lexicon(lines: DataFrame, name: str) -> DataFrame:
    """``word<TAB>nearest,second,...`` -> (name, word, repl); only the nearest one is kept."""
    parts = F.split("value", "\t")
    nearest = F.get(F.split(F.get(parts, F.lit(1)), ","), F.lit(0))
    pairs = lines.select(
        F.lower(F.get(parts, F.lit(0))).alias("word"), F.lower(nearest).alias("repl"), "line_no"
    )
    return _last_wins(pairs, name)


def sentiment_vocabulary(lines: DataFrame, key: str = "term") -> DataFrame:
    """Words with a sentiment, from ``pos, synset, pos_score, neg_score, "term#rank ...", gloss``.

    A term's score is the sum over its ranks of (positive - negative) / rank; terms whose
    scores cancel out are left out.  ``key='term_pos'`` keeps keys of the form ``term#pos``,
    which bare words never match; ``key='term'`` strips the part of speech.
    """
    if key not in ("term", "term_pos"):
        raise ValueError("key must be 'term' or 'term_pos'")
    # exploded, so that a line is made and split once, and not for every word of it
    fields = F.when(~F.startswith(F.btrim("value"), F.lit("#")), F.split("value", "\t"))
    split = lines.select("line_no", F.explode(F.array(fields)).alias("f"))

    def field(i: int) -> Column:
        return F.get("f", F.lit(i))

    entries = split.select(
        "line_no",
        field(0).alias("pos"),
        (field(2).try_cast("double") - field(3).try_cast("double")).alias("score"),
        F.posexplode(F.split(field(4), " ")).alias("nth", "entry"),
    )
    ranked = entries.select(
        F.concat_ws("#", F.get(F.split("entry", "#"), F.lit(0)), "pos").alias("term"),
        F.get(F.split("entry", "#"), F.lit(1)).try_cast("int").alias("rank"),
        "score",
        F.struct("line_no", "nth").alias("seen"),
    ).dropna(subset=["rank", "score"])
    number = _number(ranked, "seen")
    if number is not None:
        ranked = ranked.withColumn("seen", number)
    per_rank = ranked.groupBy("term", "rank").agg(F.max_by("score", "seen").alias("score"))
    scored = per_rank.groupBy("term").agg(F.sum(F.col("score") / F.col("rank")).alias("score"))
    # Rounding absorbs the order of summation, which would decide whether a sum is exactly 0.
    kept = scored.filter(F.round("score", 9) != 0)
    if key == "term_pos":
        return kept.select(F.col("term").alias("word"))
    return kept.select(F.substring_index("term", "#", 1).alias("word")).distinct()
