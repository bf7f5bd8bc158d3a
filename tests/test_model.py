"""Classifiers and metrics against the ml libraries, and the two join strategies."""

import random
import warnings

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from counterpoise.operators import metrics as M
from counterpoise.operators import model as B
from counterpoise.operators.lookup import frequent_keys, lookup_join
from counterpoise.operators.svm import svm_model, svm_weights
from counterpoise.plans import specs as P
from counterpoise.plans.suites import run_suite


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        label = int(rnd.random() < 0.35)
        pool = words[:30] if label == 0 else words[12:]
        rows.append((i, label, " ".join(rnd.choice(pool) for _ in range(rnd.randint(2, 9)))))
    return spark.createDataFrame(rows, "id long, label int, text string").cache()


def test_naive_bayes_equals_ml(labelled):
    vectors = B.hashed_features(labelled).select("id", F.col("label").cast("double"), "features")
    model = NaiveBayes(smoothing=1.0).fit(vectors)
    expected = {r["id"]: int(r["prediction"]) for r in model.transform(vectors).collect()}
    got = {r["id"]: r["prediction"] for r in B.fit_predict(labelled, labelled, "id").collect()}
    assert got == expected
    pi = {r["label"]: r["pi"] for r in B.nb_model(labelled).collect()}
    assert [pi[0], pi[1]] == pytest.approx(list(model.pi))


def test_one_step_svm_equals_mllib(spark, labelled):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint

    rows = labelled.collect()
    index = {w: i for i, w in enumerate(sorted({w for r in rows for w in r["text"].split()}))}

    def vector(text):
        v = [0.0] * len(index)
        for w in text.split():
            v[index[w]] += 1
        return Vectors.dense(v)

    points = spark.sparkContext.parallelize(
        [LabeledPoint(r["label"], vector(r["text"])) for r in rows]
    )
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        model = SVMWithSGD.train(points, 1)
    weights = {r["term"]: r["weight"] for r in B.svm1_model(labelled).collect()}
    assert [weights[w] for w in index] == pytest.approx(list(model.weights))
    got = {r["id"]: r["prediction"]
           for r in B.fit_predict(labelled, labelled, "id", B.SVM_ONE_STEP).collect()}
    assert got == {r["id"]: model.predict(vector(r["text"])) for r in rows}


@pytest.mark.parametrize("iterations", [1, 5, 20])
def test_svm_steps_equal_mllib(spark, labelled, iterations):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint

    rows = labelled.collect()
    index = {w: i for i, w in enumerate(sorted({w for r in rows for w in r["text"].split()}))}

    def vector(text):
        v = [0.0] * len(index)
        for w in text.split():
            v[index[w]] += 1
        return Vectors.dense(v)

    def library(chosen):
        points = [LabeledPoint(r["label"], vector(r["text"])) for r in chosen]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            model = SVMWithSGD.train(spark.sparkContext.parallelize(points, 2), iterations)
        return dict(zip(index, model.weights.tolist()))

    want = library(rows)
    got = {r["term"]: r["weight"] for r in svm_model(labelled, iterations).collect()}
    assert {w: got.get(w, 0.0) for w in index} == pytest.approx(want, abs=1e-6)
    # two folds and two scenarios at once, the second with every positive row twice
    fold = F.col("id") % 2
    twice = F.array(F.lit(1), F.col("label") + 1).cast("array<short>")
    train = labelled.select(fold.cast("int").alias("fold"), "label", "text", twice.alias("w"))
    found = {r["term"]: r["by_fold"] for r in svm_weights(train, 2, 2, iterations).collect()}
    for f in (0, 1):
        kept = [r for r in rows if r["id"] % 2 != f]
        for s, chosen in enumerate((kept, kept + [r for r in kept if r["label"] == 1])):
            want = library(chosen)
            assert {w: found[w][f][s] for w in index} == pytest.approx(want, abs=1e-6)


def test_hashed_folds_equal_ml(spark, labelled):
    fold = F.col("id") % 3
    once = F.array(F.lit(1).cast("short"))
    rows = labelled.select("id", fold.cast("int").alias("fold"), "label", "text")
    for buckets in (16, 1000):
        stats = B.training_stats(rows.withColumn("w", once), hashed=buckets)
        test = rows.withColumn("tw", once)
        scored = B.score(stats, test, ["id"], 1, B.NAIVE_BAYES, 3, buckets, buckets).collect()
        vectors = B.hashed_features(rows, buckets).withColumn("label", F.col("label").cast("double"))
        want = {}
        for f in range(3):
            model = NaiveBayes(smoothing=1.0).fit(vectors.filter(F.col("fold") != f))
            found = model.transform(vectors.filter(F.col("fold") == f))
            want |= {r["id"]: int(r["prediction"]) for r in found.collect()}
        assert {r["id"]: r["prediction"] for r in scored} == want


def test_one_class_only(spark):
    train = spark.createDataFrame([(1, "a b"), (1, "c")], "label int, text string")
    test = spark.createDataFrame([(1, 0, "zz"), (2, 1, "a")], "id long, label int, text string")
    assert {r["prediction"] for r in B.fit_predict(train, test, "id").collect()} == {1}


@pytest.mark.parametrize(
    "tp,fp,fn,tn,f1_at_1,f1_at_0,aupr,auroc",
    [
        (3, 2, 1, 4, 0.666667, 0.571429, 0.575, 0.708333),
        (0, 0, 2, 3, None, 0.571429, 0.4, 0.5),
        (2, 3, 0, 0, 0.571429, None, 0.4, 0.5),
    ],
)
def test_metric_golden(spark, tp, fp, fn, tn, f1_at_1, f1_at_0, aupr, auroc):
    row = M.binary_metrics(
        spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")
    ).first()
    for name, want in (("f1_at_1", f1_at_1), ("f1_at_0", f1_at_0), ("aupr", aupr),
                       ("auroc", auroc)):
        assert row[name] is None if want is None else row[name] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "cells", [(3, 2, 1, 4), (0, 0, 2, 3), (2, 3, 0, 0), (0, 2, 0, 5), (4, 0, 3, 0), (0, 3, 2, 1)]
)
def test_metrics_equal_mllib(spark, cells):
    from pyspark.mllib.evaluation import BinaryClassificationMetrics, MulticlassMetrics

    pairs = [(p, y) for n, (p, y) in zip(cells, ((1, 1), (1, 0), (0, 1), (0, 0))) for _ in range(n)]
    rdd = spark.sparkContext.parallelize([(float(p), float(y)) for p, y in pairs])
    scored = spark.createDataFrame(pairs, "prediction int, label int")
    binary = BinaryClassificationMetrics(rdd)
    row = M.binary_metrics(M.cells()(scored)).first()
    assert row["aupr"] == pytest.approx(binary.areaUnderPR)
    assert row["auroc"] == pytest.approx(binary.areaUnderROC)
    multi = MulticlassMetrics(rdd)
    for r in M.metrics_by_label(scored).filter("n > 0").collect():
        label = float(r["label"])
        assert r["precision"] == pytest.approx(multi.precision(label))
        assert r["recall"] == pytest.approx(multi.recall(label))
        assert r["f1"] == pytest.approx(multi.fMeasure(label))
    if cells[0] + cells[2] and cells[1] + cells[3]:
        w = M.weighted_metrics(scored).first()
        assert w["weighted_precision"] == pytest.approx(multi.weightedPrecision)
        assert w["weighted_recall"] == pytest.approx(multi.weightedRecall)
        assert w["weighted_f1"] == pytest.approx(multi.weightedFMeasure())
        assert w["weighted_fpr"] == pytest.approx(multi.weightedFalsePositiveRate)


def test_large_table_join_equals_broadcast(spark):
    """One key holds half of all rows, another is missing from the table."""
    rows = spark.createDataFrame(
        [(i, "hot" if i % 2 else f"k{i % 37}") for i in range(1000)]
        + [(i, "absent") for i in range(1000, 1100)],
        "id long, term string",
    )
    table = spark.createDataFrame(
        [("hot", 1)] + [(f"k{i}", i) for i in range(1, 37)], "term string, v int"
    )
    for how in ("left", "inner"):
        small = sorted(map(tuple, lookup_join(rows, table, "term", how).collect()), key=repr)
        large = lookup_join(rows, table, "term", how, max_rows=5).select("term", "id", "v")
        assert sorted(map(tuple, large.collect()), key=repr) == small
    head = [r[0] for r in frequent_keys(rows, "term", 5).collect()]
    assert "hot" in head and len(head) <= 5


def test_scores_do_not_depend_on_the_join(spark, labelled, monkeypatch):
    usual = sorted(map(tuple, B.fit_predict(labelled, labelled, "id").collect()))
    monkeypatch.setattr(B, "BROADCAST_MB", 0)
    assert sorted(map(tuple, B.fit_predict(labelled, labelled, "id").collect())) == usual


def test_terms_are_counted_without_copy_vectors(spark, labelled):
    rows = labelled.select(
        (F.col("id") % 2).alias("fold"), "label", "text", F.array(F.lit(1), F.col("label")).cast("array<smallint>").alias("w")
    )
    stats = B.training_stats(rows)
    assert stats.filter("term is not null and w is not null").count() == 0
    assert {tuple(r["w"]) for r in B.copy_vectors(stats).collect()} == {(1, 0), (1, 1)}
    docs = {(r["fold"], r["label"]): r["docs"] for r in B.class_totals(stats, 2).collect()}
    for (_, label), (first, second) in docs.items():
        assert second == first * label


def test_suite_scores_do_not_depend_on_the_broadcast_head(spark, labelled, lex, monkeypatch):
    corpus = labelled.select(
        F.when(F.col("id") > 3, F.col("id")).alias("id"),  # some rows share a missing id
        F.when(F.col("label") == 0, "positive").otherwise("negative").alias("sentiment"),
        F.concat_ws(" ", F.lit("good great"), "text", F.concat(F.lit("rare"), "id")).alias("text"),
    )
    specs = [P.plain(), P.with_blankout(2, True, False, "over", test="augmented")]
    usual = sorted(map(tuple, run_suite(corpus, specs, lex, in_sample=F.lit(True)).collect()))
    size = B._model_size
    monkeypatch.setattr(B, "_model_size", lambda stats, n: (size(stats, n)[0], 9))
    few = sorted(map(tuple, run_suite(corpus, specs, lex, in_sample=F.lit(True)).collect()))
    assert few == usual


def test_suite_with_independent_folds(spark, labelled, lex):
    corpus = labelled.select(
        "id", F.when(F.col("label") == 0, "positive").otherwise("negative").alias("sentiment"),
        F.concat(F.lit("good great "), "text").alias("text"),
    )
    specs = [P.plain(), P.with_blankout(2, True, True, "over"),
             P.with_blankout(2, False, False, None, test="augmented")]
    for folds in ("by_source", "independent"):
        rows = {r["scenario"]: r for r in run_suite(
            corpus, specs, lex, in_sample=F.lit(True), folds=folds).collect()}
        assert set(rows) == {s.scenario for s in specs}
        n = labelled.filter("label = 1").count()
        assert rows["plain"]["n_label_1"] == n
        over = rows["blankout_k2_minority_senti_over"]
        assert over["n_label_1"] == min(120 - n, 4 * 2 * n)
        assert all(0 <= r["aupr"] <= 1 for r in rows.values())


def test_rows_that_share_a_key_are_scored_apart(spark):
    train = spark.createDataFrame([(0, "a b"), (1, "c d")], "label int, text string")
    test = spark.createDataFrame(
        [(1, 0, "a a"), (1, 1, "c c"), (1, 1, "c c"), (2, 1, "d")], "id int, label int, text string"
    )
    found = B.fit_predict(train, test, "id").select("id", "label", "prediction").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_frequencies_are_counted_once_for_all_steps(spark, monkeypatch):
    from counterpoise.operators import svm

    rows = [(i % 2, f"a b w{i % 7} x{i % 5} {'good' if i % 2 else 'bad'}") for i in range(60)]
    df = spark.createDataFrame(rows, "label int, text string")
    held = {r["term"]: r["weight"] for r in svm.svm_model(df, 4).collect()}
    counted = []
    usual = svm.frequent_keys
    monkeypatch.setattr(svm, "frequent_keys", lambda *a: (counted.append(1), usual(*a))[1])
    monkeypatch.setattr(svm, "fits_broadcast", lambda table: False)
    monkeypatch.setattr(svm, "BROADCAST_ROWS", 4)
    moved = {r["term"]: r["weight"] for r in svm.svm_model(df, 4).collect()}
    assert moved.keys() == held.keys() and len(counted) == 1
    assert all(abs(moved[t] - held[t]) < 1e-9 for t in held)


def test_size_of_a_table_is_added_up_where_it_is(spark):
    from counterpoise.operators.lookup import fits_broadcast

    table = spark.range(100).selectExpr("cast(id as string) term", "array(1e-300D, 2e-300D) v")
    assert fits_broadcast(table, 100, 100 * (16 + 2 + 64))
    assert not fits_broadcast(table, 99) and not fits_broadcast(table, 100, 100 * (16 + 64))
