"""Sampling and class balance with repeatable, partition-independent randomness.

"The first n rows" means the n rows with the smallest order key (a hash), so it does not
depend on partitions.  The n-th key is found without sorting the data: keys are counted per
3-digit prefix, a running sum over those at most 4,096 counts names the prefix that holds the
n-th key, and the search goes on with three more digits inside that slice until it is small
enough to be ranked by one task.  The sample itself is then a plain filter.

Where more rows have the n-th key than are still wanted, the same search goes on among them with
a second key, a hash of their content.  Rows that share that too are equal; they are counted,
not ranked, and as many of them are kept as are wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.text import content_key, hash_below, label_of, order_key

DIGITS = 3
RANKED_ROWS = 1_000_000
KEY_DIGITS = 32  # of an md5 in hexadecimal
NOTHING, EVERYTHING = "", "~"  # below and above every hex digest


@dataclass(frozen=True)
class Limits:
    """Row counts of some groups and, for some of them, the key of the n-th row.

    ties   where more rows have that key than are wanted: the second key of the n-th row
    rest   where more rows have both than are wanted: how many of these equal rows are
    """

    counts: dict[str, int]
    keys: dict[str, str]
    ties: dict[str, str]
    rest: dict[str, int]

    def within(self, group: str, key: str = "_key", tie: str = "_tie", nth: str = "_nth") -> str:
        """Being among the first n rows of a group, as SQL over the given expressions.

        ``nth`` numbers equal rows from 1; it is used only where ``rest`` says so.
        """
        last = self.keys[group]
        if group not in self.ties:
            return f"({key} <= '{last}')"
        then = f"{tie} <= '{self.ties[group]}'"
        if group in self.rest:
            equal = f"{tie} = '{self.ties[group]}' AND {nth} <= {self.rest[group]}"
            then = f"({tie} < '{self.ties[group]}' OR ({equal}))"
        return f"({key} < '{last}' OR ({key} = '{last}' AND {then}))"

    def equal_rows(self, key: str = "_key", tie: str = "_tie") -> str | None:
        """The rows that have to be numbered, as SQL, or None."""
        some = [f"({key} = '{self.keys[g]}' AND {tie} = '{self.ties[g]}')" for g in self.rest]
        return " OR ".join(sorted(set(some))) or None


def number_equal(df: DataFrame, some: str | None, name: str = "_nth") -> DataFrame:
    """Adds ``name``: the rows where ``some`` holds are numbered among rows equal in all columns,
    all others have 1.  Equal rows are counted before they meet."""
    one = F.lit(1).cast("long").alias(name)
    if some is None:
        return df.select("*", one)
    cut = F.coalesce(F.expr(some), F.lit(False))
    equal = df.filter(cut).groupBy(*df.columns).agg(F.count("*").alias("_same"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))).alias(name)
    return df.filter(~cut).select("*", one).unionByName(equal.select(*df.columns, again))


def find_limits(
    df: DataFrame,
    key: Column,
    groups: Mapping[str, Column],
    take: Mapping[str, Callable[[dict[str, int]], int]],
    tie: Column | None = None,
    tied: DataFrame | None = None,
) -> Limits:
    """Counts ``groups`` (boolean columns) and locates the last key among the first n rows.

    ``take`` maps a group to a function of all counts giving its n.  ``tie`` is the second key, of
    the rows of ``tied`` if they are not in ``df``.  Only one small row per group reaches the driver.
    """
    counts, keys, wanted = _search(df, key, groups, take)
    if not wanted or tie is None:
        return Limits(counts, keys, {}, {})
    rows = df if tied is None else tied
    rows = rows.withColumn("_first", key).filter(F.col("_first").isin(sorted({keys[g] for g in wanted})))
    among = {g: groups[g] & (F.col("_first") == keys[g]) for g in wanted}
    _, ties, rest = _search(rows, tie, among, {g: (lambda c, n=n: n) for g, n in wanted.items()})
    return Limits(counts, keys, ties, rest)


def _search(df, key, groups, take) -> tuple[dict[str, int], dict[str, str], dict[str, int]]:
    """(counts, last keys, how many rows of the last key are wanted where it has more)."""
    names = list(groups)
    flagged = df.select(key.alias("_key"), *[groups[g].cast("tinyint").alias(g) for g in names])
    # rows in the same groups are counted together; there are only a few combinations
    alike = flagged.groupBy(
        F.substring("_key", 1, DIGITS).alias("_prefix"), F.array(*names).alias("_in")
    ).agg(F.count("*").alias("_c"))
    per_prefix = alike.groupBy("_prefix").agg(
        *[F.sum(F.col("_in")[i] * F.col("_c")).alias(g) for i, g in enumerate(names)]
    )
    # at most 4,096 rows with one small number per group
    table = [r.asDict() for r in per_prefix.collect()]
    counts = {g: sum(r[g] for r in table) for g in names}
    keys: dict[str, str] = {}
    edges: dict[str, tuple[str, int, int]] = {}  # group -> prefix, rank within it, its rows
    for g, f in take.items():
        n = f(counts)
        if n <= 0:
            keys[g] = NOTHING
        elif n >= counts[g]:
            keys[g] = EVERYTHING
        else:
            edges[g] = _edge([(r["_prefix"], r[g]) for r in table], n)
    ties: dict[str, int] = {}
    while edges:
        # a slice of one whole key cannot be narrowed any more
        for g, (prefix, rank, rows) in list(edges.items()):
            if len(prefix) >= KEY_DIGITS:
                keys[g] = prefix
                if rank < rows:
                    ties[g] = rank
                del edges[g]
        if not edges or max(rows for _, _, rows in edges.values()) <= RANKED_ROWS:
            break
        edges = _refine(flagged, edges)
    if edges:
        for g, (edge_key, wanted, rows) in _rank(flagged, edges).items():
            keys[g] = edge_key
            if wanted < rows:
                ties[g] = wanted
    return counts, keys, ties


def _edge(per_prefix: list[tuple[str, int]], n: int) -> tuple[str, int, int]:
    """The prefix that holds the n-th key, the key's rank within it, and its row count."""
    before = 0
    for prefix, rows in sorted(per_prefix):
        if before + rows >= n:
            return prefix, n - before, rows
        before += rows
    raise ValueError("fewer rows than asked for")


def _in_edges(flagged: DataFrame, edges: Mapping[str, tuple[str, int, int]]) -> DataFrame:
    """(_g, _key) of the rows in the edge slice of their group."""
    slices = [
        F.when(F.startswith("_key", F.lit(prefix)) & (F.col(g) == 1), F.lit(g))
        for g, (prefix, _, _) in edges.items()
    ]
    return flagged.select("_key", F.explode(F.array_compact(F.array(*slices))).alias("_g"))


def _refine(flagged: DataFrame, edges: dict[str, tuple[str, int, int]]) -> dict:
    digits = len(next(iter(edges.values()))[0]) + DIGITS
    found = (
        _in_edges(flagged, edges)
        .groupBy("_g", F.substring("_key", 1, digits).alias("_prefix"))
        .agg(F.count("*").alias("rows"))
        .collect()  # at most 4,096 rows per group
    )
    return {
        g: _edge([(r["_prefix"], r["rows"]) for r in found if r["_g"] == g], rank)
        for g, (_, rank, _) in edges.items()
    }


def _rank(flagged: DataFrame, edges: Mapping[str, tuple[str, int, int]]) -> dict:
    """Per group the n-th key, how many of its rows are wanted, and how many there are."""
    ranks = F.create_map(*[F.lit(x) for g, e in edges.items() for x in (g, e[1])])
    same = _in_edges(flagged, edges).groupBy("_g", "_key").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_key"))
    wanted = F.element_at(ranks, F.col("_g"))
    found = (
        same.withColumn("_upto", upto)
        .filter((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_n") < wanted))
        .select("_g", "_key", (wanted - F.col("_upto") + F.col("_n")).alias("_wanted"), "_n")
        .collect()  # one row per group
    )
    return {r["_g"]: (r["_key"], r["_wanted"], r["_n"]) for r in found}


def locate(
    rows: DataFrame,
    by: Sequence[str],
    key: str,
    groups: Mapping[str, Callable],
    take: Mapping[str, Callable[[dict[str, int]], int]],
) -> tuple[dict[str, int], dict[str, tuple[str, int, int]]]:
    """For many groups that are made of the few kinds of rows in the columns ``by``.

    Returns the rows of every group, and for those in ``take`` the key of their n-th row, its
    rank among the rows of that key, and how many these are.  ``groups`` maps a name to a
    condition on a row of ``by``; keys are hex digests.  However many groups there are, a pass counts rows
    by kind and prefix, two digits more each time, in the slices that hold an n-th row; it ends
    where a slice is one key.
    """
    digits, slices, counts = 2, {}, {}
    out: dict[str, tuple[str, int, int]] = {}
    while True:
        inner = rows
        if slices:
            some = sorted({prefix for prefix, _ in slices.values()})
            inner = rows.filter(F.substring(key, 1, digits - 2).isin(some))
        found = (
            inner.groupBy(*by, F.substring(key, 1, digits).alias("_prefix"))
            .agg(F.count("*").alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
            .collect()  # at most 256 rows per slice and kind
        )
        kinds: dict[tuple, dict] = {}
        for r in found:
            kind = kinds.setdefault(tuple(r[c] for c in by), {"row": r, "slices": {}})
            kind["slices"].setdefault(r["_prefix"][:-2], []).append(r)
        own = {g: [k for k in kinds.values() if f(k["row"])] for g, f in groups.items()}
        if not slices:
            for g, ks in own.items():
                counts[g] = sum(r["_n"] for k in ks for rs in k["slices"].values() for r in rs)
            for g, f in take.items():
                n = f(counts)
                if n <= 0:
                    out[g] = (NOTHING, 0, 0)
                elif n >= counts[g]:
                    out[g] = (EVERYTHING, 0, 0)
                else:
                    slices[g] = ("", n)
        for g, (prefix, rank) in list(slices.items()):
            table: dict[str, list] = {}
            for k in own[g]:
                for r in k["slices"].get(prefix, []):
                    n, low, high = table.get(r["_prefix"], (0, r["_low"], r["_high"]))
                    table[r["_prefix"]] = (n + r["_n"], min(low, r["_low"]), max(high, r["_high"]))
            longer, left, _ = _edge([(p, v[0]) for p, v in table.items()], rank)
            n, low, high = table[longer]
            if low == high:
                out[g] = (low, left, n)
                del slices[g]
            else:
                slices[g] = (longer, left)
        if not slices:
            return counts, out
        digits += 2


def _upto(df: DataFrame, key: Column, found: Limits, group: str, scope: Column | None = None):
    """The first rows of ``df`` up to a limit; rows outside of ``scope`` are kept."""
    rows = _with_keys(df, key, found)
    first = F.expr(found.within(group))
    return rows.filter(first if scope is None else ~scope | first).select(*df.columns)


def _with_keys(df: DataFrame, key: Column, found: Limits) -> DataFrame:
    tie = content_key(*df.columns)
    keyed = df.withColumn("_key", key).withColumn("_tie", tie)
    return number_equal(keyed, found.equal_rows()) if found.rest else keyed


def _first(df: DataFrame, key: tuple[str, ...], salt: str, take) -> DataFrame:
    k = order_key(salt, *key)
    tie = content_key(*df.columns)
    found = find_limits(df, k, {"rows": F.lit(True)}, {"rows": take}, tie)
    return _upto(df, k, found, "rows")


def first_n(df: DataFrame, n: int, *key: str, salt: str = "order") -> DataFrame:
    """Exactly min(n, rows) rows of ``df``, in the random order of the ``key`` columns."""
    return _first(df, key, salt, lambda c: n)


def first_fraction(df: DataFrame, fraction: float, *key: str, salt: str = "order") -> DataFrame:
    """The first floor(rows * fraction) rows."""
    return _first(df, key, salt, lambda c: int(c["rows"] * fraction))


def bernoulli(df: DataFrame, probability: float, *key: str, salt: str = "sample") -> DataFrame:
    """Each row independently with the given probability."""
    return df.filter(hash_below(order_key(salt, *key), probability))


def copies(count: Column) -> Column:
    """1..count as an array to explode; empty for count 0."""
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(
        F.array().cast("array<int>")
    )


def undersample(df: DataFrame, *key: str, salt: str = "order") -> DataFrame:
    """All rows of label 1 and as many of label 0, from ``df(sentiment, ...)``."""
    k, tie = order_key(salt, *key), content_key(*df.columns)
    major = label_of("sentiment") == 0
    groups = {"major": major, "minor": ~major}
    found = find_limits(df, k, groups, {"major": lambda c: c["minor"]}, tie)
    return _upto(df, k, found, "major", major)


def minority_copies_sql(cap: int, major_n: int, minor_n: int, extra: str) -> str:
    """Copies of a minority row, so that the minority reaches the majority.

    At most ``cap``; the rows where ``extra`` holds take one more than the others.
    """
    if minor_n == 0:
        return "1"
    if major_n >= cap * minor_n:
        return str(cap)
    base = major_n // minor_n
    return f"CASE WHEN {extra} THEN {base + 1} ELSE {base} END"


def oversample(df: DataFrame, cap: int, *key: str, salt: str = "order") -> DataFrame:
    """Repeats rows of label 1 (column ``copy``) up to the number of label 0, ``cap`` at most."""
    k, tie = order_key(salt, *key), content_key(*df.columns)
    minor = label_of("sentiment") == 1
    found = find_limits(
        df,
        k,
        {"major": ~minor, "minor": minor},
        {"minor": lambda c: c["major"] % c["minor"] if c["minor"] else 0},
        tie,
    )
    c = found.counts
    repeat = minority_copies_sql(cap, c["major"], c["minor"], found.within("minor"))
    n = F.when(minor, F.expr(repeat)).otherwise(F.lit(1))
    rows = _with_keys(df, k, found)
    return rows.withColumn("_n", n).select(*df.columns, F.explode(copies(F.col("_n"))).alias("copy"))


# ---------------------------------------------------------------- dataset profiles

# Fixed value: share of the minority class that is kept.
MINORITY_SHARE = 0.2


def in_minority_sample(share: float = MINORITY_SHARE) -> Column:
    """Positive rows, and a random share of the negative ones."""
    kept = (F.col("sentiment") == "negative") & hash_below(order_key("sample", "id"), share)
    return (F.col("sentiment") == "positive") | kept


def prepare(
    corpus: DataFrame,
    profile: str,
    share: float = MINORITY_SHARE,
    cap: int | None = None,
) -> DataFrame:
    """Training rows of one dataset profile.

    sampled_minority  all positives, a random share of the negatives
    capped            the first ``cap`` positives, a random share of the negatives
    asis              every row, also of further classes, which count as the minority
    """
    if profile == "asis":
        return corpus
    if profile == "capped":
        if cap is None:
            raise ValueError("the capped profile needs a cap")
        corpus = capped_majority(corpus, cap)
    elif profile != "sampled_minority":
        raise ValueError(f"unknown profile {profile!r}")
    return corpus.filter(in_minority_sample(share))


def capped_majority(corpus: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` positives and all other rows: the test side of the capped profile."""
    k = order_key("cap", "id")
    major = F.coalesce(F.col("sentiment") == "positive", F.lit(False))
    tie = content_key(*corpus.columns)
    found = find_limits(corpus, k, {"major": major}, {"major": lambda c: cap}, tie)
    return _upto(corpus, k, found, "major", major)
