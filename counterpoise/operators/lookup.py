"""Joining tokens with a table that has one row per key.

A table of checked size is broadcast.  Of a larger one, the rows of the most frequent keys are
broadcast, as many as the same bound allows; the rest is joined by shuffle.  Word frequencies
fall off steeply, so that leaves few tokens to move and no key frequent enough to overload a
task, whatever share of all tokens it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from counterpoise.session import spool

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20
IN_ROW_BYTES = 16 << 20
BUCKETS = 4096
STEPS_PER_DOUBLING = 8


def text_bytes(table: DataFrame) -> Column:
    """Bytes of a row of ``table`` as text; numbers in an array have eight each."""

    def width(c: str) -> Column:
        kind = table.schema[c].dataType
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
            return 8 * F.size(c)
        return F.octet_length(F.col(c).cast("string"))

    widths = [F.coalesce(width(c), F.lit(0)) for c in table.columns]
    return sum(widths[1:], widths[0])


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether a table is small enough to be sent to every task, by rows and by bytes."""
    # added up where the rows are: a limit would take them all to one task
    size = table.agg(F.count("*").alias("rows"), F.sum(text_bytes(table)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) + 64 * size["rows"] <= max_bytes


def frequent_keys(rows: DataFrame, key: str, max_rows: int) -> DataFrame:
    """The most frequent keys of ``rows``, at most ``max_rows`` of them."""
    counts = spool(rows.groupBy(key).agg(F.count("*").alias("_n")), "frequency")
    return most_frequent(counts, key, max_rows)


def most_frequent(counts: DataFrame, key: str, max_rows: int) -> DataFrame:
    """The keys with the largest counts ``counts(key, _n)``, at most ``max_rows`` of them."""
    step = F.floor(F.log2("_n") * STEPS_PER_DOUBLING).cast("int").alias("_step")
    # a few hundred rows: one per step of the logarithmic scale
    steps = counts.groupBy(step).agg(F.count("*").alias("keys")).collect()
    cut, taken = None, 0
    for r in sorted(steps, key=lambda r: -r["_step"]):
        taken += r["keys"]
        if taken > max_rows:
            break
        cut = r["_step"]
    return counts.filter(F.lit(False) if cut is None else step >= cut).select(key)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    table_rows: int | None = None,
    head: DataFrame | None = None,
) -> DataFrame:
    """``rows`` left or inner joined with ``table`` (unique on ``key``).

    ``table_rows``: number of rows of ``table``, if the caller has counted them already, and their
    bytes with it; ``head``: the frequent keys, at most ``max_rows``, if the caller knows them.
    """
    fits = fits_broadcast(table, max_rows) if table_rows is None else table_rows <= max_rows
    if fits:
        return rows.join(F.broadcast(table), key, how)
    if head is None:
        head = frequent_keys(rows, key, max_rows)
    head_table = table.join(F.broadcast(head), key, "left_semi")
    if how == "left":
        head_table = head.join(F.broadcast(head_table), key, "left")
    in_head = rows.join(F.broadcast(head_table), key)
    in_tail = rows.join(F.broadcast(head), key, "left_anti").join(table, key, how)
    return in_head.unionByName(in_tail)


# ---------------------------------------------------------------- lookups inside the row


def fits_in_row(table: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the text of ``table`` is small enough to be held by every task."""
    limit = IN_ROW_BYTES if max_bytes is None else max_bytes
    return (table.agg(F.sum(text_bytes(table))).first()[0] or 0) <= limit


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def lookup_value(table: DataFrame, key: str) -> DataFrame:
    """``table`` (unique on ``key``) as one value: an array of small maps, by hash of the key."""
    values = F.struct(*[c for c in table.columns if c != key]).alias("v")
    entries = table.select(_bucket(F.col(key)).alias("b"), F.struct(F.col(key).alias("k"), values).alias("e"))
    filled = entries.groupBy("b").agg(F.collect_list("e").alias("e"))
    every = table.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    parts = every.join(filled, "b", "left").agg(F.sort_array(F.collect_list(F.struct("b", "e"))))
    return parts.toDF("parts").select(
        F.transform(
            "parts",
            lambda p: F.map_from_entries(p["e"]),
        )
    )


def look_up(value: Column, word: Column) -> Column:
    """The struct that ``lookup_value`` holds for a word, or NULL."""
    return F.element_at(F.get(value, _bucket(word)), word)


# ---------------------------------------------------------------- lookups that may miss

BITMAP_BITS = 1 << 27  # at most, 16 MB
BITS_PER_KEY = 8


def bitmap_value(table: DataFrame, key: str, level: int = 0) -> tuple[DataFrame, int]:
    """The keys of ``table`` as one value, a bit map over their hashes, and its number of bits.

    It never grows beyond BITMAP_BITS: more keys only mean more words that look like one.
    """
    keys = table.count()
    bits = 64
    while bits < min(BITMAP_BITS, keys * BITS_PER_KEY):
        bits *= 2
    bit = _bit(F.col(key), bits, level)
    words = table.select(bit.alias("_b")).select(
        F.shiftright("_b", 6).cast("int").alias("i"),
        F.expr("shiftleft(1L, cast(_b & 63L as int))").alias("m"),
    )
    filled = words.groupBy("i").agg(F.bit_or("m").alias("m"))
    every = table.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("i"))
    parts = every.join(filled, "i", "left").fillna(0, ["m"])
    value = parts.agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("parts"))
    return value.select(F.transform("parts", lambda p: p["m"])), bits


def _bit(word: Column, bits: int, level: int = 0) -> Column:
    hashed = F.xxhash64(word, F.lit(level)) if level else F.xxhash64(word)
    return F.pmod(hashed, F.lit(bits).cast("bigint"))


def may_hold(bitmap: Column, bits: int, word: Column, level: int = 0) -> Column:
    """False for words that are certainly no key of the bit map."""
    bit = _bit(word, bits, level)
    held = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
    return F.getbit(held, bit.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1


# ---------------------------------------------------------------- exact sets


@dataclass(frozen=True)
class WordSet:
    """Which of the words that will be asked for are held, exactly, in a few bit maps.

    The first one has the bits of the words that are held, each further one those of the words that
    the one before takes for others; ``last`` are the words the last one is wrong about.
    """

    levels: list[tuple[DataFrame, int]]
    last: DataFrame
    key: str

    def values(self) -> dict[str, Column]:
        """Columns that ``holds`` expects."""
        maps = {f"_bits{i}": value.scalar() for i, (value, _) in enumerate(self.levels)}
        return maps | {"_last": lookup_value(self.last, self.key).scalar()}

    def holds(self, word: Column) -> Column:
        held = look_up(F.col("_last"), word).isNotNull()
        for i, (_, bits) in reversed(list(enumerate(self.levels))):
            held = may_hold(F.col(f"_bits{i}"), bits, word, i) & ~held
        return held


def word_set(words: DataFrame, key: str, max_bytes: int | None = None) -> WordSet | None:
    """The set for ``words(key, held)``, which are all words that will be asked for; None where there
    are too many words for bit maps to tell them apart."""
    inside, outside = (words.filter(c).select(key) for c in (F.col("held"), ~F.col("held")))
    levels: list[tuple[DataFrame, int]] = []
    before = outside.count()
    while True:
        level = len(levels)
        value, bits = bitmap_value(inside, key, level)
        levels.append((value, bits))
        tried = outside.withColumn("_bits", value.scalar())
        wrong = tried.filter(may_hold(F.col("_bits"), bits, F.col(key), level)).select(key)
        wrong = spool(wrong.withColumn("yes", F.lit(True)), "mistaken")
        if fits_in_row(wrong, max_bytes):
            return WordSet(levels, wrong, key)
        found = wrong.count()
        if bits >= BITMAP_BITS and 2 * found > before:
            return None
        inside, outside, before = wrong.select(key), inside, inside.count()
