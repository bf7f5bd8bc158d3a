"""Mixing sources to target weights by subset sums.

1. Documents are counted by exact token length per source; only these counts go further.
2. Each source's word budget comes from the weights, capped at a multiple of what it holds;
   the excess is reshared by weight until no source is above its cap.
3. Per source, whole repeats of every document come first; the rest of the budget is fitted by a
   bounded-knapsack dynamic program over the lengths.  Its cost is the budget times the steps over
   the lengths; up to DP_BITS it runs over all documents, so the words taken are the closest sum.
   A larger rest is first spread evenly over the lengths and filled up with long documents, and
   the program fits the last words with what is left.  If that misses the budget, fewer documents
   are fixed beforehand and the program is given more words, up to RETRIES times.
4. Of each length, the documents with the smallest seeded hashes are taken, as many as the plan
   says.  Long lists of one length are cut into chunks by hash, so no task ranks all of them.

Defined results: a NULL text has size 0; a NULL source is a source of its own, ranked last;
documents of size 0 follow their source's whole repeats only; repeated rows are separate
documents with equal hashes, so either may be taken; a source of size 0 has target 0; an empty
table gives no rows.  Input columns named like an added column are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import word_count
from counterpoise.session import spool

MAX_SOURCES = 1_000_000  # one row each on the driver
DP_WORDS = 16_384  # words that the dynamic program fits at least
DP_BITS = 1 << 29  # words times steps of one dynamic program, one bit each
RETRIES = 2  # with four times the words each
CHUNK_ROWS = 100_000  # documents of one source and length that one task ranks

PLAN = (
    "mix_key string, size long, mix_n long, mix_base int, mix_extra long, "
    "source_size long, target double"
)


def targets(sizes: dict[str | None, int], weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Words per source; weights repeat over the sources in code point order, NULL last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget = share * sum(sizes.values())
    full: set = set()
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(cap * sizes[s] for s in names if s in full)
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            want = {s: left * weight[s] / total for s in free}
            return {s: want.get(s, float(cap * sizes[s])) for s in names}
        full.update(over)


def fit_counts(lengths: list[int], counts: list[int], budget: float) -> list[int]:
    """How many documents of each length to take, bounded by the counts, without passing
    ``budget``.

    The words are the closest sum there is if budget and lengths are small enough for DP_BITS, or
    if the budget is met exactly; else the closest one found.
    """
    words = sum(a * c for a, c in zip(lengths, counts))
    if words <= 0 or budget <= 0:
        return [0] * len(lengths)
    steps = sum(c.bit_length() for c in counts)
    window = max(DP_WORDS, DP_BITS // steps)
    best, least = None, None
    for _ in range(1 + RETRIES):
        taken = _prefilled(lengths, counts, int(min(budget, words)), words, window)
        rest = int(budget) - sum(a * k for a, k in zip(lengths, taken))
        free = [c - k for c, k in zip(counts, taken)]
        for i, k in _knapsack(lengths, free, max(0, min(rest, window))).items():
            taken[i] += k
        short = int(min(budget, words)) - sum(a * k for a, k in zip(lengths, taken))
        if best is None or short < least:
            best, least = taken, short
        if least == 0 or window >= budget:
            break
        window *= 4
    return best


def _prefilled(lengths, counts, budget: int, words: int, window: int) -> list[int]:
    """Documents that are fixed before the dynamic program fits the last ``window`` words."""
    if budget <= window:
        return [0] * len(lengths)
    share = (budget - window) / words
    taken = [int(c * share) for c in counts]
    rest = budget - sum(a * k for a, k in zip(lengths, taken))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= window or lengths[i] <= 0:
            break
        k = min(counts[i] - taken[i], -(-(rest - window) // lengths[i]), rest // lengths[i])
        taken[i] += k
        rest -= lengths[i] * k
    return taken


def _knapsack(lengths: list[int], free: list[int], budget: int) -> dict[int, int]:
    """Bounded subset sum; reachable sums are the bits of one integer."""
    mask = (1 << (budget + 1)) - 1
    sums, steps = 1, []
    for i, length in enumerate(lengths):
        most = min(free[i], budget // length) if length > 0 else 0
        piece = 1
        while most > 0 and not sums >> budget & 1:
            k = min(piece, most)
            steps.append((sums, i, k))
            sums |= sums << (length * k) & mask
            most -= k
            piece *= 2
    at, used = sums.bit_length() - 1, {}
    for before, i, k in reversed(steps):
        if not before >> at & 1:
            used[i] = used.get(i, 0) + k
            at -= lengths[i] * k
    return used


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size").reset_index(drop=True)
    size, n = [int(x) for x in rows["size"]], [int(x) for x in rows["mix_n"]]
    total, target = int(rows["source_size"][0]), float(rows["target"][0])
    base = int(target // total) if total else 0
    rows["mix_base"] = base
    rows["mix_extra"] = fit_counts(size, n, target - base * total)
    return rows[["mix_key", "size", "mix_n", "mix_base", "mix_extra", "source_size", "target"]]


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def mix_plan(sized: DataFrame, weights=(3, 1, 2), share=1.5, cap=2.0) -> DataFrame:
    """Plan (mix_key, size, mix_n, mix_base, mix_extra, source_size, target) for rows (mix_key, size)."""
    spark = sized.sparkSession
    counts = spool(sized.groupBy("mix_key", "size").agg(F.count("*").alias("mix_n")), "lengths")
    by_source = counts.groupBy("mix_key").agg(F.sum(F.col("size") * F.col("mix_n")).alias("words"))
    found = by_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {None if r[0] == "-" else r[0][1:]: r[1] for r in found}
    goal = targets(sizes, weights, share, cap) if sizes else {}
    wanted = spark.createDataFrame(
        [("-" if s is None else "+" + s, sizes[s], float(t)) for s, t in goal.items()],
        "mix_key string, source_size long, target double",
    )
    fitted = counts.join(wanted, "mix_key").groupBy("mix_key").applyInPandas(_fit_source, PLAN)
    return spool(fitted, "mix-plan")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: str | None = None,
    weights=(3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0, 1 or 2 for a cap of 2).

    ``size`` names a column that already holds word counts; else ``text`` is counted.
    """
    words = F.col(size) if size else word_count(F.col(text))
    sized = docs.withColumn("size", words).withColumn("mix_key", _key(F.col(source)))
    plan = mix_plan(sized.select("mix_key", "size"), weights, share, cap)
    sized = sized.drop("source_size", "target", "copies")
    sized = sized.withColumn("mix_at", F.xxhash64(F.lit(seed), F.col(key)))
    rows = sized.join(plan, ["mix_key", "size"])

    some = (F.col("mix_extra") > 0) & (F.col("mix_extra") < F.col("mix_n"))
    whole = rows.filter(~some).withColumn(
        "copies", F.col("mix_base") + F.when(F.col("mix_extra") > 0, 1).otherwise(0)
    )
    chunks = F.ceil(F.col("mix_n") / CHUNK_ROWS)
    place = F.pmod(F.xxhash64(F.col("mix_at"), F.lit("chunk")), chunks).cast("long")
    part = rows.filter(some).withColumn("mix_chunk", place)
    narrow = sized.select("mix_key", "size", "mix_at").join(plan, ["mix_key", "size"])
    cells = (
        narrow.filter(some)
        .withColumn("mix_chunk", place)
        .groupBy("mix_key", "size", "mix_chunk")
        .agg(F.count("*").alias("mix_cell"))
    )
    before = Window.partitionBy("mix_key", "size").orderBy("mix_chunk")
    cells = cells.withColumn("mix_before", F.sum("mix_cell").over(before) - F.col("mix_cell")).drop("mix_cell")
    order = Window.partitionBy("mix_key", "size", "mix_chunk").orderBy("mix_at", key)
    rank = F.col("mix_before") + F.row_number().over(order)
    part = part.join(cells, ["mix_key", "size", "mix_chunk"]).withColumn("mix_rank", rank)
    part = part.withColumn(
        "copies", F.col("mix_base") + F.when(F.col("mix_rank") <= F.col("mix_extra"), 1).otherwise(0)
    )
    both = whole.unionByName(part.drop("mix_chunk", "mix_before", "mix_rank"))
    return both.drop("mix_key", "mix_at", "mix_n", "mix_base", "mix_extra")


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    often = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter(F.col("copies") > 0).withColumn("mix_copy", often).select(*columns)
