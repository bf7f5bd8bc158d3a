"""Suites whose variants are changes of their source rows, against suites of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from counterpoise.operators import changes
from counterpoise.operators import model as B
from counterpoise.operators.generate import Lexicons, antonym, blankout, generate, similar
from counterpoise.plans import specs as P
from counterpoise.plans import suites


@pytest.fixture(scope="module")
def odd_lex(spark):
    return Lexicons(
        antonyms=spark.createDataFrame(
            [("good", "bad"), ("happy", "not so sad"), ("gone", ""), ("bad", " ")], "word string, repl string"
        ),
        similar=spark.createDataFrame(
            [("a", "great", "Awesome thing"), ("a", "day", ""), ("b", "great", "big"), ("b", "good", "good")],
            "name string, word string, repl string",
        ),
        senti=spark.createDataFrame([("good",), ("great",)], "word string"),
    )


@pytest.fixture(scope="module")
def odd_corpus(spark):
    """Words that become empty or several, empty and missing texts, spaces at all places."""
    rnd = random.Random(5)
    words = ["good", "GOOD", "great", "Great", "day", "happy", "gone", "NOT", "NOTgood", "arenot", "not", "w", "x", "Y", "bad"]
    rows = []
    for i in range(240):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))
        text = {0: " " + text, 1: text.replace(" ", "  ", 1), 2: text + " ", 3: "", 4: None}.get(i % 23, text)
        sentiment = rnd.choice(["positive", "positive", "negative", "neutral", "Positive", None])
        rows.append((i, sentiment, text))
    return spark.createDataFrame(rows, "id long, sentiment string, text string").cache()


GENS = [antonym(c, s) for c in range(6) for s in (False, True)] + [
    similar("a"), similar("a", "one"), similar("b"), similar("b", "one"),
    blankout(2), blankout(3, senti=True), blankout(1, protect=False, min_left=0), blankout(2, min_left=0),
]


def test_changes_give_the_words_of_the_texts(odd_corpus, odd_lex):
    want = {}
    for r in generate(odd_corpus, GENS, odd_lex).collect():
        want[r["src_id"], r["gen"]] = sorted(r["text"].rstrip(" ").split(" "))
    table = changes.changes(odd_corpus, GENS, odd_lex, F.lit(True), 10)
    got = {}
    for r in table.collect():
        for gen, removed, added in zip(r["v_gen"], r["v_removed"], r["v_added"]):
            left = [w for i, w in enumerate(r["terms"]) if i not in removed]
            got[r["src_id"], gen] = sorted(left + added)
    assert got == want and len({g for _, g in got}) == len(GENS)


SPECS = (
    [P.plain(), P.plain("over"), P.plain("under", test="augmented")]
    + [P.with_antonyms(c, s, r, test=t) for c, s, r, t in (
        (0, False, "over", "augmented"), (2, True, None, "generated"), (3, False, "under", "original"),
        (5, False, "over", "original"))]
    + [P.with_similars("a", "all", False, None), P.with_similars("a", "one", True, "over", test="augmented")]
    + [P.with_blankout(2, m, s, r, test=t) for m, s, r, t in (
        (True, False, "over", "augmented"), (False, True, "over", "original"), (False, False, "under", "augmented"))]
    + P.balanced_family(2, ("b",))[-2:] + [P.perturbed(2)]
)


@pytest.mark.parametrize("classifier,redraw", [(B.NAIVE_BAYES, False), (B.SVM_ONE_STEP, False), (B.NAIVE_BAYES, True)])
def test_suites_of_changes_equal_suites_of_texts(odd_corpus, odd_lex, monkeypatch, classifier, redraw):
    def run(some):
        made = suites.run_suite(odd_corpus, some, odd_lex, classifier, redraw=redraw)
        return sorted((r["scenario"], r["n_label_0"], r["n_label_1"],
                       *[None if r[m] is None else round(r[m], 9) for m in ("f1_at_0", "f1_at_1", "aupr", "auroc")])
                      for r in made.collect())

    monkeypatch.setattr(changes, "ROWS_AT_ONCE", 7)
    some = SPECS if not redraw else SPECS[:5] + SPECS[9:12]
    got, got_sampled = run(some), run([s for s in some if s.test == "augmented" and s.base == "sampled"])
    monkeypatch.setattr(suites, "_suite_of_changes", lambda *a: None)
    assert got == run(some)
    assert got_sampled == run([s for s in some if s.test == "augmented" and s.base == "sampled"])


def test_lexicons_are_looked_up_once_for_all_scenarios(spark, lex, monkeypatch):
    looked_up = []
    usual = changes.with_tokens
    monkeypatch.setattr(changes, "with_tokens", lambda *a: (looked_up.append(1), usual(*a))[1])
    rows = [(i, "positive" if i % 3 else "negative", f"good great w{i} x y") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    specs = P.blankout_family() + [P.with_antonyms(c, False, "over") for c in range(6)]
    assert len(specs) > suites.SCENARIOS_PER_PASS
    assert suites.run_suite(df, specs, lex).count() == len(specs)
    assert len(looked_up) == 1


def test_parts_hold_one_fold_and_fall_into_buckets_of_their_own(spark, lex, monkeypatch):
    monkeypatch.setattr(changes, "ROWS_PER_PART", 20)
    rows = [(i, "positive", f"good great w{i} x y") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    table = changes.placed(changes.changes(df, [blankout(2)], lex, F.lit(True), 10), 500, 10)
    parts = table.groupBy("part").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n")).collect()
    assert len(parts) > 10 and all(r["folds"] == 1 for r in parts) and sum(r["n"] for r in parts) == 500
    buckets = table.select("part", F.pmod(F.hash("part"), F.lit(30)).alias("b")).distinct().collect()
    assert len({r["b"] for r in buckets}) == len(buckets)
    plan = table.groupBy("part").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_one_step_margins_equal_mllib(spark):
    import warnings

    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint

    rows = [(i, i % 3 // 2, f"a w{i % 5} x{i % 7} {'good good' if i % 2 else 'bad'}") for i in range(40)]
    words = sorted({w for _, _, text in rows for w in text.split()})
    vector = lambda text: Vectors.dense([text.split().count(w) for w in words])
    points = spark.sparkContext.parallelize([LabeledPoint(y, vector(text)) for _, y, text in rows])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        model = SVMWithSGD.train(points, 1)
    model.clearThreshold()
    df = spark.createDataFrame(rows, "id long, label int, text string")
    found = {r["id"]: r["margin"] for r in B.fit_predict(df, df, "id", B.SVM_ONE_STEP).collect()}
    assert found == pytest.approx({i: model.predict(vector(text)) for i, _, text in rows}, abs=1e-9)
