"""Golden edge cases and properties of the generators."""

import pytest

from counterpoise.operators.generate import (
    Gen,
    Lexicons,
    antonym,
    antonym_prefilter,
    blankout,
    count_dropped_empty,
    generate,
    similar,
)

ROWS = [
    (1, "positive", "i am good today"),
    (2, "negative", "NOTgood movie"),
    (3, "positive", "doesnot work good"),
    (4, "positive", "good and happy"),
    (5, "positive", "Good day"),
    (6, "negative", "NOT_happy NOTNOT x"),
    (7, "neutral", "so hot"),
    (8, "positive", "not"),
    (9, "positive", "plain words here"),
    (10, "positive", "x NOT y"),
]
SCHEMA = "id long, sentiment string, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def texts(df):
    return {r["src_id"]: r["text"] for r in df.collect()}


GOLDEN = {
    "D1": (antonym(0), {1: "i am bad today", 5: "bad day", 7: "so cold", 10: "x  y"}),
    "D2": (antonym(1), {1: "i am bad today", 10: "x  y"}),
    "D3": (
        antonym(2),
        {
            1: "i am bad today", 2: "good movie", 3: "does work bad", 4: "bad and sad",
            6: "_happy  x", 7: "so cold", 10: "x  y",
        },
    ),
    "D5": (
        antonym(4),
        {
            1: "i am bad today", 2: "good movie", 3: "does work good", 4: "bad and happy",
            6: "_happy NOTNOT x", 7: "so cold", 10: "x  y",
        },
    ),
    "D9": (
        antonym(2, senti=True),
        {
            1: "i am bad today", 2: "good movie", 3: "does work bad", 4: "bad and happy",
            5: "bad day", 6: "_happy  x", 10: "x  y",
        },
    ),
}


def test_antonym_golden_all_in_one_pass(corpus, lex):
    made = generate(corpus, [g for g, _ in GOLDEN.values()], lex).collect()
    for i, (name, (_, expected)) in enumerate(GOLDEN.items()):
        assert {r["src_id"]: r["text"] for r in made if r["gen"] == i} == expected, name
    new = {r["src_id"]: r["sentiment"] for r in made}
    assert new == {
        1: "negative", 2: "positive", 3: "negative", 4: "negative", 5: "negative",
        6: "positive", 7: "positive", 10: "negative",
    }


def test_vocabulary_with_part_of_speech_never_matches(spark, corpus, lex):
    vocabulary = spark.createDataFrame([("good#a",)], "word string")
    made = generate(corpus, [antonym(2, senti=True)], Lexicons(lex.antonyms, None, vocabulary))
    assert texts(made) == {2: "good movie", 3: "does work good", 6: "_happy  x", 10: "x  y"}


def test_prefilter(corpus, lex):
    kept = antonym_prefilter(corpus, lex.antonyms)
    assert {r["id"] for r in kept.collect()} == {1, 2, 5, 7, 8, 9, 10}


def test_empty_results_are_counted(corpus, lex):
    counts = count_dropped_empty(corpus, [antonym(2)], lex).collect()
    assert [(r["gen"], r["dropped_empty"]) for r in counts] == [(0, 1)]


def test_prefix_switch_repairs_the_dead_test(spark, lex):
    rows = spark.createDataFrame([(1, "negative", "NOTgood movie")], SCHEMA)
    assert texts(generate(rows, [antonym(0)], lex)) == {}
    assert texts(generate(rows, [antonym(0, prefix_raw=True)], lex)) == {1: "good movie"}


def test_similar_golden(spark, lex):
    rows = spark.createDataFrame(
        [(1, "Positive", "Great day Great"), (2, "negative", "bad Day"),
         (3, "negative", "nothing here")],
        SCHEMA,
    )
    gens = [similar("a"), similar("a", "one"), similar("b"), similar("a", minority=True)]
    made = {(r["gen"], r["src_id"]): (r["sentiment"], r["text"]) for r in
            generate(rows, gens, lex).collect()}
    assert made == {
        (0, 1): ("positive", "awesome night awesome"),
        (0, 2): ("negative", "bad night"),
        (1, 1): ("positive", "awesome day great"),
        (1, 2): ("negative", "bad night"),
        (2, 1): ("positive", "big day big"),
        (3, 2): ("negative", "bad night"),
    }


@pytest.mark.parametrize(
    "text,gen,left",
    [
        ("a b c d", blankout(2), None),
        ("a b c d e", blankout(2), 3),
        ("not nothing cannot dont NOTx", blankout(1), None),
        ("not cannot dont x NOTy", blankout(2), "not cannot dont NOTy"),
        ("a b c", blankout(1, protect=False), None),
        ("not a b c", blankout(1, protect=False), 3),
    ],
)
def test_blankout_golden(spark, text, gen, left):
    made = generate(spark.createDataFrame([(1, "negative", text)], SCHEMA), [gen]).collect()
    if left is None:
        assert made == []
    elif isinstance(left, str):
        assert made[0]["text"] == left
    else:
        words = made[0]["text"].split(" ")
        assert len(words) == left
        remaining = iter(text.split(" "))
        assert all(w in remaining for w in words)  # order kept


def test_blankout_drops_exactly_k_eligible_and_no_vocabulary_word(spark, lex):
    rows = spark.createDataFrame(
        [(i, "negative", f"good a{i} b not c{i} d e isnot") for i in range(200)], SCHEMA
    )
    made = generate(rows, [blankout(2, senti=True), blankout(3)], lex).collect()
    assert len(made) == 400
    for r in made:
        words = r["text"].split(" ")
        k = 2 if r["gen"] == 0 else 3
        assert r["n_changed"] == k and len(words) == 8 - k
        assert {"not", "isnot"} <= set(words)
        assert r["gen"] == 1 or "good" in words
    assert len({r["text"] for r in made}) > 250  # rows differ in what they lose


def test_results_do_not_depend_on_partitions(spark, lex):
    rows = [(i, "positive", f"good w{i} b c d NOTe") for i in range(50)]
    gens = [antonym(2), blankout(2, senti=True), similar("a")]
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    many = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = [sorted(map(tuple, generate(d, gens, lex).collect())) for d in (one, many, many)]
    assert got[0] == got[1] == got[2]


def test_digit_labels(spark, lex):
    rows = spark.createDataFrame([(1, " 1", "good x"), (2, "0", "good y"), (3, "?", "good")], SCHEMA)
    made = generate(rows, [Gen("antonym", case=4, flip="digit")], lex).collect()
    assert {r["src_id"]: r["sentiment"] for r in made} == {1: "0", 2: "1", 3: "1"}


def repeated(spark):
    rows = [(1, "positive", "a bad day"), (1, "positive", "good food here"),
            (1, "positive", "good food here"), (1, "positive", "so so")]
    return spark.createDataFrame(rows, "id long, sentiment string, text string")


def test_repeated_ids_stay_apart(spark, lex):
    made = generate(repeated(spark), [antonym(2)], lex)
    assert [r["text"] for r in made.collect()] == ["bad food here"] * 2


def test_large_lexicons_are_joined_with_the_same_result(spark, lex, monkeypatch):
    gens = [antonym(2), antonym(4, senti=True), similar("a"), blankout(1, senti=True)]
    small = sorted(map(tuple, generate(repeated(spark), gens, lex).collect()))
    monkeypatch.setattr("counterpoise.operators.lookup.IN_ROW_BYTES", 0)
    assert sorted(map(tuple, generate(repeated(spark), gens, lex).collect())) == small


@pytest.mark.parametrize("head_rows", [0, 2, 100])
def test_only_rows_with_rare_words_are_joined(spark, monkeypatch, head_rows):
    from counterpoise.operators import generate as module

    texts = ["the cat", "the dog", "the end", "no hit", "rare the", "rare the"] * 2 + ["odd"]
    rows = [(i // 2, "positive", t) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "id long, sentiment string, text string")
    words = [("the", "a"), ("cat", "tac"), ("rare", "well"), ("odd", "even"), ("x", "y")]
    antonyms = spark.createDataFrame(words, "word string, repl string")
    lex = Lexicons(antonyms=antonyms, senti=antonyms.select("word"))
    gens = [antonym(2), antonym(4, senti=True), blankout(1, senti=True, min_left=0)]
    usual = sorted(map(tuple, generate(corpus, gens, lex).collect()))
    moved, spool = [], module.spool

    def watched(df, name):
        if name == "tokens":
            moved.append(df.filter("size(_lw_maybe) > 0").count())
        return spool(df, name)

    monkeypatch.setattr(module, "spool", watched)
    monkeypatch.setattr(module, "HEAD_ROWS", head_rows)
    lex = Lexicons(antonyms=lex.antonyms, senti=lex.senti, max_bytes=1)
    assert sorted(map(tuple, generate(corpus, gens, lex).collect())) == usual
    # "the" is the most frequent word, then "rare"; "cat" occurs twice and "odd" once
    assert len(moved) == 1 and (moved[0] >= 11 if head_rows == 0 else moved[0] < 11)


def test_empty_rewrites_are_counted_in_the_same_pass(spark, lex):
    from pyspark.sql import Observation

    rows = [(1, "positive", "NOT"), (2, "positive", "good day"), (3, "negative", "not"), (4, "negative", "x")]
    corpus = spark.createDataFrame(rows, "id long, sentiment string, text string")
    gens = [antonym(2), antonym(3)]
    seen = Observation()
    made = generate(corpus, gens, lex, observation=seen).collect()
    assert {r["src_id"] for r in made} == {2}
    assert seen.get == {"dropped_empty_0": 2, "dropped_empty_1": 1}
    two_passes = {r["gen"]: r["dropped_empty"] for r in count_dropped_empty(corpus, gens, lex).collect()}
    assert two_passes == {0: 2, 1: 1}
    tagged = generate(corpus, gens, lex, keep_empty=True).collect()
    assert sorted((r["gen"], r["src_id"]) for r in tagged if r["dropped"]) == [(0, 1), (0, 3), (1, 1)]


def test_rows_without_texts_are_the_same_rows(spark, lex):
    texts = ["good great w", "NOT", "  NOT  ", "a  not  b", " good", "x", "NOT good day here", "   a   ", "a  b   c"]
    rows = [(i, "positive" if i % 2 else "negative", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    gens = [*(antonym(case) for case in range(6)), similar("a"), blankout(1), blankout(2, protect=False)]

    def key(made):
        return sorted((r["src_id"], r["gen"], r["sentiment"]) for r in made.collect())

    whole, bare = generate(df, gens, lex), generate(df, gens, lex, texts=False)
    assert "text" not in bare.columns
    assert key(whole) == key(bare) and whole.count() > 10


def test_only_minority_rows_are_drawn_again(spark):
    rows = [(1, "positive", "a b c d e f"), (2, "negative", "a b c d e f")]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    made = {r["src_id"]: r["drawn"] for r in generate(df, [blankout(2, draws=3)]).collect()}
    assert made[1] is None and len(made[2]) == 3


def test_large_vocabulary_moves_no_rows(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, "positive", " ".join(words[(i * j) % 3000] for j in range(1, 12))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    senti = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    gens = [blankout(2, senti=True)]
    held = generate(df, gens, Lexicons(senti=senti))
    told = generate(df, gens, Lexicons(senti=senti, max_bytes=100))
    assert sorted(held.collect()) == sorted(told.collect()) and held.count() > 100
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString().split("subquery")[0]
