"""Column expressions shared by all operators: tokens, labels and portable hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two class names and their numeric labels.  Any other name counts as 1.
POSITIVE = "positive"
NEGATIVE = "negative"

# Words that are never dropped, besides those carrying a NOT/not affix.
PROTECTED_WORDS = ["dont", "havent", "cant", "cannot", "arent", "aint"]

HASH_SPACE = 1 << 32


def tokens(text: Column | str) -> Column:
    """Single-space split.  Trailing empty tokens vanish, leading and inner ones stay."""
    return F.split(F.rtrim(text), " ")


def label_of(sentiment: Column | str) -> Column:
    """0 for the positive class, 1 for everything else."""
    sentiment = F.col(sentiment) if isinstance(sentiment, str) else sentiment
    return F.when(sentiment == POSITIVE, F.lit(0)).otherwise(F.lit(1))


def flipped(sentiment: Column | str) -> Column:
    sentiment = F.col(sentiment) if isinstance(sentiment, str) else sentiment
    return F.when(sentiment == POSITIVE, F.lit(NEGATIVE)).otherwise(F.lit(POSITIVE))


def order_key(salt: str, *parts: Column | str) -> Column:
    """Hex digest of ``salt:part:part``: a random but repeatable order, the same in any engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(salt), *[c.cast("string") for c in cols]))


def content_key(*columns: str) -> Column:
    """Hex digest over whole rows: orders rows that share all other keys, the same in any engine."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *parts))


def hash_below(key: Column, probability: float) -> Column:
    """True for about ``probability`` of all keys."""
    if probability >= 1:
        return F.lit(True)
    bound = format(max(0, int(round(probability * HASH_SPACE))), "08x")
    return F.substring(key, 1, 8) < F.lit(bound)


def hash_bucket(key: Column, buckets: int) -> Column:
    """Uniform bucket number 0..buckets-1."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def fold_of(*parts: Column | str, folds: int = 10, salt: str = "fold") -> Column:
    return hash_bucket(order_key(salt, *parts), folds)


def is_negated(word: Column) -> Column:
    """Lower-case form starts or ends with ``not``."""
    low = F.lower(word)
    return F.startswith(low, F.lit("not")) | F.endswith(low, F.lit("not"))


def stripped(word: Column, prefix: bool = True, lower_suffix: bool = False) -> Column:
    """The word without its negation affix, NULL if it has none.  The prefix is tried first."""
    tail = F.lower(word) if lower_suffix else word
    cut = F.when(
        F.endswith(tail, F.lit("not")), F.substring(word, F.lit(1), F.length(word) - 3)
    )
    if not prefix:
        return cut
    return F.when(
        F.startswith(word, F.lit("NOT")), F.replace(word, F.lit("NOT"), F.lit(""))
    ).otherwise(cut)


def is_protected(word: Column) -> Column:
    return (
        F.startswith(word, F.lit("NOT"))
        | F.startswith(word, F.lit("not"))
        | F.endswith(word, F.lit("not"))
        | word.isin(PROTECTED_WORDS)
    )
