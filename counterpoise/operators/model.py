"""Bag-of-words classifiers as aggregations, for any number of training sets at once.

Multinomial Naive Bayes and a linear SVM after one gradient step from zero both depend on
per-class term counts only (further steps are in ``svm``).  Term counts add up, so the model that leaves out fold f is
(all folds) - (fold f): one pass over the training tokens serves every fold, and, with one
count per scenario in an array, every scenario.

Inputs
    train(fold, label, text, w)        w: copies per scenario
    test(key, fold, label, text, tw)   tw: test rows per scenario; key identifies the row
Both classifiers are linear, so a test row needs one vector of sums over its tokens.  Test
rows are partitioned by key while they are whole texts; with a broadcast model nothing else is
moved.  Terms are used as they are, with the vocabulary size of the hashed feature space, or, with
``hashed`` buckets, as the buckets of the ml library's hashing, so that terms collide as they do
there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.text import tokens
from counterpoise.operators.lookup import most_frequent
from counterpoise.session import spool

# Buckets of the hashed feature space and the additive smoothing.
FEATURES = 1_500_000
SMOOTHING = 1.0

NAIVE_BAYES, SVM_ONE_STEP = "nb", "svm1"
MARGIN_DIGITS = 9
RUN = [("size", "<i2"), ("value", "<f8")]  # of equal weights
STEP = 1.0  # length of the SVM's first gradient step, as in the library
BROADCAST_MB = 256  # for the weight table
SALTS = 64  # tasks that identical test rows may be spread over


def term_counts(df: DataFrame, *key: str) -> DataFrame:
    """(key..., term, tf): how often each term occurs in each row of ``df(key..., text)``."""
    return (
        df.select(*key, F.explode(tokens("text")).alias("term"))
        .groupBy(*key, "term")
        .agg(F.count("*").alias("tf"))
    )


def hashed_features(df: DataFrame, features: int = FEATURES) -> DataFrame:
    """Adds ``features``: sparse vectors of hashed term counts, for the ml library."""
    with_words = df.withColumn("_words", tokens("text"))
    hashing = HashingTF(inputCol="_words", outputCol="features", numFeatures=features)
    return hashing.transform(with_words).drop("_words")


def exploded(df: DataFrame, *columns: str, hashed: int | None = None) -> DataFrame:
    """(columns..., term, tf): the terms of every text, or its buckets with their counts."""
    if hashed is None:
        return df.select(*columns, F.explode(tokens("text")).alias("term"), F.lit(1).alias("tf"))
    vector = F.unwrap_udt("features")
    entries = F.arrays_zip(vector["indices"].alias("term"), vector["values"].cast("array<int>").alias("tf"))
    made = hashed_features(df, hashed).select(*columns, F.explode(entries).alias("e"))
    return made.select(*columns, "e.term", "e.tf")


# ---------------------------------------------------------------- training


def training_stats(train: DataFrame, hashed: int | None = None) -> DataFrame:
    """(term, fold, label, pattern, w, c): all a model needs, from one pass over the texts.

    Rows with the same copy vector are counted together (``c``); there are only a few
    different vectors, so the table is little wider than plain term counts.  The NULL term
    counts the rows themselves and holds the vector ``w``; terms only have its hash ``pattern``.
    """
    by = ["fold", "label", "pattern"]
    rows = train.withColumn("pattern", F.xxhash64("w"))
    vector = F.when(F.col("term").isNull(), F.col("w")).alias("w")
    if hashed is None:
        terms = F.array_append(tokens("text"), F.lit(None).cast("string"))
        found = rows.select(*by, "w", F.explode(terms).alias("term")).select("term", *by, vector)
        return found.groupBy("term", *by, "w").agg(F.count("*").alias("c"))
    # a bucket below zero stands for the row until the counts are made
    features = F.unwrap_udt("features")
    entries = F.arrays_zip(features["indices"].alias("term"), features["values"].cast("array<int>").alias("tf"))
    row = F.struct(F.lit(-1).alias("term"), F.lit(1).alias("tf"))
    found = hashed_features(rows, hashed).select(*by, "w", F.explode(F.array_append(entries, row)).alias("e"))
    named = found.select(F.when(F.col("e.term") >= 0, F.col("e.term")).alias("term"), *by, "w", "e.tf")
    counted = named.select("term", *by, vector, "tf").groupBy("term", *by, "w")
    return counted.agg(F.sum("tf").alias("c"))


def copy_vectors(stats: DataFrame) -> DataFrame:
    """(pattern, w): the few different copy vectors."""
    return stats.filter(F.col("term").isNull()).select("pattern", "w").distinct()


def class_totals(stats: DataFrame, n: int) -> DataFrame:
    """(fold, label, docs, terms): rows and tokens per scenario, two small rows per fold."""
    w, is_row = F.col("w"), F.col("term").isNull()
    alike = stats.groupBy("fold", "label", "pattern").agg(
        F.sum(F.when(is_row, F.col("c")).otherwise(0)).alias("docs"),
        F.sum(F.when(~is_row, F.col("c")).otherwise(0)).alias("terms"),
    ).join(F.broadcast(copy_vectors(stats)), "pattern")
    return alike.groupBy("fold", "label").agg(
        *[
            F.array(*[F.sum(w[s] * F.col(name)) for s in range(n)]).alias(name)
            for name in ("docs", "terms")
        ]
    )


def term_weights(stats: DataFrame, n: int, classifier: str, vectors: DataFrame | None = None) -> DataFrame:
    """(term, by_fold): contribution of one occurrence of a term towards label 1.

    Vectors over scenarios, leaving one fold out each.  ``by_fold`` only lists the folds the term
    occurs in; leaving out another one changes nothing, so fold -1 stands for all of these.  Rows
    are moved once, by term, while they are narrow, and become vectors only where they are added
    up, a batch of whole terms at a time.  ``vectors``: ``copy_vectors``, if ``stats`` has only
    some of the terms.
    """
    return _weighed(stats, n, classifier, vectors, False)


def packed_weights(stats: DataFrame, n: int, classifier: str) -> DataFrame:
    """``term_weights`` with vectors as runs of equal values: by_fold is a map to bytes, ten per run (its
    length and its value) and none where all weights are zero.  Terms that weigh nothing in any fold are
    left out."""
    return _weighed(stats, n, classifier, None, True)


def _weighed(
    stats: DataFrame, n: int, classifier: str, vectors: DataFrame | None, packed: bool
) -> DataFrame:
    few = (copy_vectors(stats) if vectors is None else vectors).collect()
    few = sorted((r["pattern"], list(r["w"])) for r in few)
    bayes, smoothing = classifier != SVM_ONE_STEP, SMOOTHING

    def weigh(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        run = np.dtype(RUN)
        patterns = np.array([p for p, _ in few], dtype=np.int64)
        copies = np.array([w for _, w in few], dtype=np.float64).reshape(len(few), n)

        def weight(n0, n1):
            # a gradient step from zero: all rows are within the margin, weights have nothing to
            # shrink; margins divide by the number of rows
            return np.log(n1 + smoothing) - np.log(n0 + smoothing) if bayes else n1 - n0

        def lists(values):
            """A list per row of ``values``, or its runs as bytes."""
            size = len(values)
            if not packed:
                every = pa.array(np.arange(size + 1, dtype=np.int32) * n)
                return pa.ListArray.from_arrays(every, pa.array(values.reshape(-1)))
            new = np.ones(values.shape, dtype=bool)
            new[:, 1:] = values[:, 1:] != values[:, :-1]
            new &= values.any(axis=1)[:, None]
            start = np.flatnonzero(new)
            row = start // n
            ends = np.append(start[1:], 0)
            last = np.append(row[1:] != row[:-1], True)[: len(row)]
            runs = np.empty(len(start), dtype=run)
            runs["size"] = np.where(last, (row + 1) * n, ends[: len(row)]) - start
            runs["value"] = values.reshape(-1)[start]
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=size))).astype(np.int32)
            buffers = [None, pa.py_buffer((ends * run.itemsize).tobytes()), pa.py_buffer(runs.tobytes())]
            return pa.Array.from_buffers(pa.binary(), size, buffers)

        def whole(rows, starts):
            """The weights of whole terms that start at ``starts``."""
            fold, label = rows["fold"].to_numpy(), rows["label"].to_numpy()
            new = np.zeros(rows.num_rows, dtype=bool)
            new[starts] = True
            cut = new.copy()
            cut[1:] |= fold[1:] != fold[:-1]
            at = np.flatnonzero(cut)  # where each term and fold starts
            counted = copies[np.searchsorted(patterns, rows["pattern"].to_numpy())]
            counted = counted * rows["c"].to_numpy()[:, None]
            own = [np.add.reduceat(counted * (label == c)[:, None], at, axis=0) for c in (0, 1)]
            first = np.flatnonzero(new[at])
            total = [np.add.reduceat(x, first, axis=0) for x in own]
            term = np.cumsum(new[at]) - 1
            # the entry of all folds comes first, then one per fold
            size = len(first) + len(at)
            keys, values = np.full(size, -1, dtype=np.int32), np.empty((size, n))
            heads, others = first + np.arange(len(first)), np.arange(len(at)) + term + 1
            values[heads] = weight(*total)
            values[others] = weight(*[t[term] - o for t, o in zip(total, own)])
            keys[others] = fold[at]
            offsets = pa.array(np.append(heads, size).astype(np.int32))
            maps = pa.MapArray.from_arrays(offsets, pa.array(keys), lists(values))
            terms = rows["term"].take(pa.array(starts))
            made = pa.RecordBatch.from_arrays([terms, maps], names=["term", "by_fold"])
            if not packed:
                return made
            return made.filter(pa.array(np.logical_or.reduceat(values.any(axis=1), heads)))

        def starts_of(rows):
            terms = rows["term"]
            other = pc.not_equal(terms.slice(1), terms.slice(0, rows.num_rows - 1))
            return np.append(0, np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1)

        held = None  # rows of the last term so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            starts = starts_of(rows)
            if len(starts) > 1:
                yield whole(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held is not None:
            yield whole(held, np.array([0]))

    terms = stats.filter(F.col("term").isNotNull()).select("term", "fold", "label", "pattern", "c")
    kind = stats.schema["term"].dataType.simpleString()
    vector = "binary" if packed else "array<double>"
    placed = terms.repartition("term").sortWithinPartitions("term", "fold")
    return placed.mapInArrow(weigh, f"term {kind}, by_fold map<int, {vector}>")


def class_constants(stats: DataFrame, n: int, folds: int, features: int) -> DataFrame:
    """(fold, docs0, docs1, prior, per_word): one row per test fold, vectors over scenarios."""
    entries = F.collect_list(F.struct("fold", "label", "docs", "terms"))
    totals = class_totals(stats, n).agg(entries.alias("e"))  # two entries per fold
    zeros = F.array_repeat(F.lit(0).cast("bigint"), n)

    def left(field: str, label: int) -> Column:
        others = F.filter("e", lambda e: (e["label"] == label) & (e["fold"] != F.col("fold")))
        return F.aggregate(
            others, zeros, lambda acc, e: F.zip_with(acc, e[field], lambda a, b: a + b)
        )

    def log_ratio(over: str, under: str, added: float) -> Column:
        return F.zip_with(over, under, lambda a, b: F.log(a + added) - F.log(b + added))

    per_fold = totals.select("e", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    return per_fold.select(
        "fold",
        *[left(f, c).alias(f"{f}{c}") for f in ("docs", "terms") for c in (0, 1)],
    ).select(
        "fold",
        "docs0",
        "docs1",
        log_ratio("docs1", "docs0", SMOOTHING).alias("prior"),
        log_ratio("terms0", "terms1", SMOOTHING * features).alias("per_word"),
    )


def fold_constants(stats: DataFrame, n: int, folds: int, features: int) -> dict:
    """What the models that leave a fold out take from all rows, as arrays over folds and scenarios:
    docs per label, prior, per_word, and the least margin that is not rounded to zero or below;
    ``sizes``: rows per label and scenario."""
    import numpy as np

    vectors = {r["pattern"]: np.array(r["w"], dtype=np.int64) for r in copy_vectors(stats).collect()}
    docs, terms = np.zeros((2, 2, folds, n), dtype=np.int64)
    is_row = F.col("term").isNull()
    alike = stats.groupBy("fold", "label", "pattern").agg(
        F.sum(F.when(is_row, F.col("c")).otherwise(0)).alias("docs"),
        F.sum(F.when(~is_row, F.col("c")).otherwise(0)).alias("terms"),
    )
    for r in alike.collect():  # a few hundred vectors per fold
        docs[r["label"], r["fold"]] += r["docs"] * vectors[r["pattern"]]
        terms[r["label"], r["fold"]] += r["terms"] * vectors[r["pattern"]]
    sizes = docs.sum(axis=1)
    docs, terms = (x.sum(axis=1, keepdims=True) - x for x in (docs, terms))
    added = SMOOTHING * features
    return {
        "docs": docs,
        "prior": np.log(docs[1] + SMOOTHING) - np.log(docs[0] + SMOOTHING),
        "per_word": np.log(terms[0] + added) - np.log(terms[1] + added),
        "least": 0.5 * 10.0**-MARGIN_DIGITS,
        "sizes": sizes,
    }


# ---------------------------------------------------------------- scoring


def _model_size(stats: DataFrame, n: int) -> tuple[int, int]:
    """(rows of the weight table, how many rows may be broadcast).

    The whole table is measured by the folds its terms occur in.  If that is too much, only
    frequent terms are sent, and these are taken to occur in as many folds as any term does.
    """
    fold = F.bit_or(F.expr("shiftleft(1L, cast(fold % 63 as int))"))
    size = (
        stats.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.bit_count(fold).alias("folds"))
        .agg(F.count("*").alias("terms"), F.sum("folds").alias("all"), F.max("folds").alias("most"))
        .first()
    )
    terms, budget, vector = size["terms"], BROADCAST_MB << 20, 8 * n + 32
    if terms * (64 + vector) + (size["all"] or 0) * vector <= budget:
        return terms, terms
    return terms, max(1, budget // (64 + (1 + size["most"]) * vector))


def _frequent_terms(stats: DataFrame, max_rows: int) -> DataFrame:
    """(term) of the terms that are most frequent in training, at most ``max_rows``."""
    seen = stats.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("c").alias("_n"))
    return most_frequent(spool(seen, "frequency"), "term", max_rows)


def margins(
    stats: DataFrame,
    test: DataFrame,
    key: Sequence[str],
    n: int,
    classifier: str = NAIVE_BAYES,
    folds: int = 10,
    features: int = FEATURES,
    hashed: int | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """(key..., fold, label, tw, same, m, prediction): distinct test rows, vectors over scenarios.

    A row of fold f is scored by the models of all training rows outside fold f.  Keys need not
    be unique: rows are told apart by their texts too, and ``same`` counts identical ones.  A row
    that repeats very often is split by the partition it comes from, so it never meets whole.

    Each token adds its vector of weights to one row of sums; tokens are not multiplied by the
    scenarios.  ``weights(term, by_fold)`` may come from elsewhere, as from ``svm``.
    """
    rows, max_rows = _model_size(stats, n)
    carried = [*key, "fold", "label", "tw"]
    place = ["_at", "_text"]
    salt = (F.spark_partition_id() % SALTS).cast("string")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in (*key, "fold")]
    once = (
        test.withColumns({"_text": F.xxhash64("text"), "_at": F.xxhash64(*parts, salt)})
        .repartition(*place)
        .groupBy(*carried, *place, "text")
        .agg(F.count("*").alias("_same"))
    )
    row = [*carried, *place, "_same", "_len"]
    tok = exploded(once.withColumn("_len", F.size(tokens("text"))), *row, hashed=hashed)
    none = F.array_repeat(F.lit(0.0), n)
    by_fold = F.col("by_fold")
    v = F.coalesce(F.try_element_at(by_fold, F.col("fold")), F.try_element_at(by_fold, F.lit(-1)))

    def sums(found: DataFrame, *by: str) -> DataFrame:
        added = [F.sum(F.col("v")[s] * F.col("tf")).alias(f"_m{s}") for s in range(n)]
        made = found.groupBy(*by).agg(*added)
        return made.select(*by, F.array(*[f"_m{s}" for s in range(n)]).alias("m"))

    def model(some: DataFrame | None = None, how: str = "left_semi") -> DataFrame:
        table = stats if weights is None else weights
        if some is not None:
            table = table.join(F.broadcast(some), "term", how)
        return term_weights(table, n, classifier, copy_vectors(stats)) if weights is None else table

    head = None if rows <= max_rows else _frequent_terms(stats, max_rows)
    matched = tok.join(F.broadcast(model(head)), "term", "left")
    summed = sums(matched.select(*row, F.coalesce(v, none).alias("v"), "tf"), *row)
    if head is not None:
        # rare terms meet their weights by shuffle, without the rows; only sums of rows in which
        # one of them weighs anything come back to the rows, which stay where they are
        texts = once.select(*place, "fold", "text").distinct()
        rare = exploded(texts, *place, "fold", hashed=hashed).join(F.broadcast(head), "term", "left_anti")
        weighed = rare.join(model(head, "left_anti"), "term").select(*place, v.alias("v"), "tf")
        more = sums(weighed.filter(F.exists("v", lambda x: x != 0)), *place)
        both = summed.join(more.withColumnRenamed("m", "_more").hint("shuffle_hash"), place, "left")
        added = F.zip_with("m", F.coalesce("_more", none), lambda a, b: a + b)
        summed = both.withColumn("m", added).drop("_more")
    if classifier == SVM_ONE_STEP:
        # the step is taken along the mean over the training rows: sums are divided while they are whole
        step = F.transform(
            F.arrays_zip("m", "docs0", "docs1"),
            lambda x: STEP * x["m"] / F.greatest(x["docs0"] + x["docs1"], F.lit(1)),
        )
        constants = class_constants(stats, n, folds, features).select("fold", "docs0", "docs1")
        summed = summed.join(F.broadcast(constants), "fold", "left").withColumn("m", step)
    if classifier != NAIVE_BAYES:
        made = summed.withColumn("prediction", F.transform("m", lambda m: (m > 0).cast("int")))
        return made.select(*carried, F.col("_same").alias("same"), "m", "prediction")
    constants = class_constants(stats, n, folds, features)  # one row per fold
    full = F.transform(
        F.arrays_zip("m", "prior", "per_word"),
        lambda x: F.round(x["m"] + x["prior"] + F.col("_len") * x["per_word"], MARGIN_DIGITS),
    )
    # a class without training rows is never predicted
    predicted = F.transform(
        F.arrays_zip("m", "docs0", "docs1"),
        lambda x: F.when(x["docs1"] == 0, 0).when(x["docs0"] == 0, 1).otherwise(
            (x["m"] > 0).cast("int")
        ),
    )
    joined = summed.join(F.broadcast(constants), "fold", "left").withColumn("m", full)
    return joined.withColumn("prediction", predicted).select(
        *carried, F.col("_same").alias("same"), "m", "prediction"
    )


def score(
    stats: DataFrame,
    test: DataFrame,
    key: Sequence[str],
    n: int,
    classifier: str = NAIVE_BAYES,
    folds: int = 10,
    features: int = FEATURES,
    hashed: int | None = None,
) -> DataFrame:
    """(key..., fold, label, s, tw, margin, prediction) of the rows tested in scenario ``s``:
    ``margins``, one row per test row and scenario."""
    wide = margins(stats, test, key, n, classifier, folds, features, hashed)
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))).alias("_nth")
    each = wide.select(*key, "fold", "label", "tw", "m", "prediction", nth)
    values = F.posexplode(F.arrays_zip("tw", F.col("m").alias("margin"), "prediction")).alias("s", "x")
    return each.select(*key, "fold", "label", values).select(
        *key, "fold", "label", "s", "x.tw", "x.margin", "x.prediction"
    ).filter(F.col("tw") > 0)


def fit_predict(
    train: DataFrame,
    test: DataFrame,
    key: str,
    classifier: str = NAIVE_BAYES,
    features: int = FEATURES,
    hashed: int | None = None,
) -> DataFrame:
    """(key, label, margin, prediction): one training set, one test set."""
    once = F.array(F.lit(1).cast("short"))
    rows = train.select(F.lit(0).alias("fold"), "label", "text", once.alias("w"))
    stats, features = training_stats(rows, hashed), hashed or features
    tested = test.select(key, F.lit(1).alias("fold"), "label", "text", once.alias("tw"))
    scored = score(spool(stats, "stats"), tested, [key], 1, classifier, 2, features, hashed)
    return scored.select(key, "label", "margin", "prediction")


def nb_model(train: DataFrame, features: int = FEATURES) -> DataFrame:
    """(label, term, tf, pi, theta) of multinomial Naive Bayes for ``train(label, text)``."""
    counts = (
        train.select("label", F.explode(tokens("text")).alias("term"))
        .groupBy("label", "term")
        .agg(F.count("*").alias("tf"))
    )
    classes = train.groupBy("label").agg(
        F.count("*").alias("docs"), F.sum(F.size(tokens("text"))).alias("terms")
    )
    # one row per class
    n_docs = F.aggregate(
        "all", F.lit(0).cast("bigint"), lambda acc, c: acc + c["docs"]
    )
    everything = classes.agg(F.collect_list(F.struct("label", "docs", "terms")).alias("all"))
    priors = everything.select("all", F.explode("all").alias("c")).select(
        F.col("c.label").alias("label"),
        F.log((F.col("c.docs") + SMOOTHING) / (n_docs + F.size("all") * SMOOTHING)).alias("pi"),
        F.col("c.terms").alias("terms"),
    )
    theta = F.log((F.col("tf") + SMOOTHING) / (F.col("terms") + SMOOTHING * features))
    return counts.join(F.broadcast(priors), "label").select(
        "label", "term", "tf", "pi", theta.alias("theta")
    )


def svm1_model(train: DataFrame) -> DataFrame:
    """(term, weight) of the linear SVM after one full gradient step from zero."""
    side = F.when(F.col("label") == 1, 1).otherwise(-1)
    rows = train.select(F.count("*")).scalar()
    return (
        train.select(side.alias("y"), F.explode(tokens("text")).alias("term"))
        .groupBy("term")
        .agg(F.sum("y").alias("s"))
        .select("term", (F.col("s") / rows).alias("weight"))
    )


def denoise(made: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Generated rows that Naive Bayes classifies as labelled.

    Trained on the generated rows themselves, or on them together with ``original``.
    ``made(src_id, label, text)`` has one row per src_id.
    """
    train = made.select("label", "text")
    if original is not None:
        train = train.unionByName(original.select("label", "text"))
    return fit_predict(train, made, "src_id").filter(F.col("prediction") == F.col("label"))

