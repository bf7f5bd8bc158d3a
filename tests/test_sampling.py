"""Exact sampling and rebalancing, against brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from counterpoise.operators import sampling as S
from counterpoise.plans import specs as P
from counterpoise.plans.training_sets import build_training_set


def corpus(spark, pos, neg):
    rows = [(i, "positive", f"a b c d w{i}") for i in range(pos)]
    rows += [(1000 + i, "negative", f"great b c d e w{i}") for i in range(neg)]
    return spark.createDataFrame(rows, "id long, sentiment string, text string")


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("ranked", [1_000_000, 3])
@pytest.mark.parametrize("n", [0, 1, 137, 499, 500, 900])
def test_first_n_is_exact(spark, monkeypatch, ranked, n):
    monkeypatch.setattr(S, "RANKED_ROWS", ranked)
    monkeypatch.setattr(S, "DIGITS", 1 if ranked == 3 else 3)
    got = {r["id"] for r in S.first_n(corpus(spark, 500, 0), n, "id").collect()}
    expected = sorted(range(500), key=lambda i: md5("order", i))[:n]
    assert got == set(expected)


def test_rebalancing_counts(spark):
    c = corpus(spark, 17, 3)
    by = Counter(r["sentiment"] for r in S.undersample(c, "id").collect())
    assert by == {"positive": 3, "negative": 3}
    for cap, copies in ((4, [4, 4, 4]), (10, [5, 6, 6])):
        rows = S.oversample(c, cap, "id").collect()
        per_id = Counter(r["id"] for r in rows if r["sentiment"] == "negative")
        assert sorted(per_id.values()) == copies
        assert sum(r["sentiment"] == "positive" for r in rows) == 17


@pytest.mark.parametrize("pos,neg", [(3, 17), (5, 0), (0, 5)])
def test_rebalancing_of_odd_class_sizes(spark, pos, neg):
    c = corpus(spark, pos, neg)
    under = Counter(r["sentiment"] for r in S.undersample(c, "id").collect())
    assert under["positive"] == min(pos, neg) and under["negative"] == neg
    over = Counter(r["sentiment"] for r in S.oversample(c, 4, "id").collect())
    assert over["positive"] == pos and over["negative"] == min(4 * neg, pos)


def test_profiles(spark):
    c = corpus(spark, 400, 300)
    share = S.prepare(c, "sampled_minority").filter("sentiment = 'negative'").count()
    assert 30 <= share <= 90
    assert S.prepare(c, "capped", cap=100).filter("sentiment = 'positive'").count() == 100
    assert S.prepare(c, "asis").count() == 700
    with pytest.raises(ValueError):
        S.prepare(c, "other")


def test_fraction_of_generated_rows(spark, lex):
    spec = P.with_similars("a", "all", False, None, fraction=0.3)
    rows = build_training_set(corpus(spark, 5, 40), spec, lex, in_sample=F.lit(True))
    by = Counter(r["method"] for r in rows.collect())
    assert by == {"original": 45, "similar": 12}


def test_perturbed_set(spark):
    from counterpoise.operators.generate import Lexicons

    rows = [(i, "positive", "good x") for i in range(7)]
    rows += [(100 + i, "negative", "bad x") for i in range(9)]
    c = spark.createDataFrame(rows, "id long, sentiment string, text string")
    ant = spark.createDataFrame([("good", "bad"), ("bad", "good")], "word string, repl string")
    got = build_training_set(c, P.perturbed(2), Lexicons(ant), in_sample=F.lit(True)).collect()
    by = Counter((r["method"], r["label"]) for r in got)
    assert by == {
        ("original", 1): 9, ("original", 0): 3, ("antonym", 0): 3, ("antonym", 1): 7,
    }


def test_redrawn_copies_differ(spark, lex):
    spec = P.with_blankout(2, True, False, "over")
    c = corpus(spark, 200, 10)
    got = build_training_set(c, spec, lex, in_sample=F.lit(True), redraw=True).collect()
    per_row = {}
    for r in got:
        if r["method"] == "blankout":
            per_row.setdefault(r["src_id"], []).append(r["text"])
    assert all(len(t) == 4 for t in per_row.values()) and len(per_row) == 10
    assert all(len(t.split(" ")) == 4 for ts in per_row.values() for t in ts)
    assert sum(len(set(t)) > 1 for t in per_row.values()) >= 9


def test_ties_end_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr("counterpoise.operators.sampling.RANKED_ROWS", 1)
    from counterpoise.operators.sampling import first_n, undersample

    rows = [(7, "positive", str(i % 3)) for i in range(6)] + [(8, "negative", "x")] * 2
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    for n in range(9):
        assert first_n(df, n, "id").count() == n
    assert undersample(df, "id").groupBy("sentiment").count().collect() == [
        ("positive", 2), ("negative", 2)] or undersample(df, "id").count() == 4


def test_further_classes_are_kept(spark):
    from counterpoise.operators.sampling import prepare

    rows = [(1, "positive", "a"), (2, "neutral", "b"), (3, None, "c")]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    assert prepare(df, "asis").count() == 3


def test_sets_are_exact_where_all_rows_share_an_id(spark):
    rows = [(1, "positive", f"p{i // 2}") for i in range(7)] + [(2, "negative", f"n{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    under = build_training_set(df, P.plain("under"), in_sample=F.lit(True)).collect()
    assert Counter(r["label"] for r in under) == {0: 3, 1: 3}
    tied = [(1, "negative", "same")] * 5 + [(10 + i, "positive", f"p{i}") for i in range(7)]
    df = spark.createDataFrame(tied, "id long, sentiment string, text string")
    assert S.oversample(df, 10, "id").filter("sentiment = 'negative'").count() == 7
    over = build_training_set(df, P.plain("over"), in_sample=F.lit(True)).collect()
    assert Counter(r["label"] for r in over) == {0: 7, 1: 7}
