"""Readers, lexicons, writers."""

from pyspark.sql import functions as F

import pytest

from counterpoise.operators.generate import generate, antonym
from counterpoise.plans.suites import augmented_sets
from counterpoise.sources.lexicons import (
    antonym_lexicon,
    read_numbered_lines,
    sentiment_vocabulary,
    similar_lexicon,
)
from counterpoise.sources.lines import (
    malformed_lines,
    parse_lines,
    read_corpus,
    to_lines,
    write_augmented,
)


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no int, value string")


def test_comma_layout_cuts_text_at_the_next_comma(spark):
    got = parse_lines(lines(spark, "7,positive,a b,rest", "x,positive,t", "8,negative"))
    rows = [tuple(r) for r in got.collect()]
    assert [r[1:] for r in rows] == [("positive", "a b"), ("positive", "t")]
    # an id that is no number is kept as its hash, not dropped
    hashed = spark.range(1).select(F.xxhash64(F.lit("x"))).first()[0]
    assert [r[0] for r in rows] == [7, hashed]
    bad = malformed_lines(lines(spark, "7,positive,a b", "x,positive,t", "8,negative"))
    assert [r[0] for r in bad.collect()] == ["8,negative"]


def test_other_layouts(spark):
    five = parse_lines(lines(spark, "5,x,y,some text,1"), "five_col").first()
    assert tuple(five) == (5, "5", "x", "y", "some text", "1")
    tsv = parse_lines(lines(spark, "5\tpositive\tz\tsome, text"), "tsv4").first()
    assert tuple(tsv) == (5, "5", "positive", "z", "some, text")


def test_files_round_trip(spark, lex, tmp_path):
    src = spark.createDataFrame(
        [(1, "positive", "good day x y"), (2, "negative", "great")],
        "id long, sentiment string, text string",
    )
    path = str(tmp_path / "corpus")
    to_lines(src, "id", "sentiment", "text").write.text(path)
    corpus = read_corpus(spark, path)
    assert sorted(map(tuple, corpus.collect())) == sorted(map(tuple, src.collect()))
    out = str(tmp_path / "sets")
    write_augmented(augmented_sets(corpus, lex, ["a", "b"]), out, "text")
    written = spark.read.text(out)
    assert {r["dataset"] for r in written.select("dataset").distinct().collect()} == {
        "antonym", "similar_a", "similar_b", "blankout",
    }
    flipped = written.filter("dataset = 'antonym'")
    assert {r["value"] for r in flipped.collect()} == {
        "1,positive,good day x y", "2,negative,great", "1,negative,bad day x y",
    }


def test_last_lexicon_line_wins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Good,Bad\nhot,cold,more\ngood,EVIL\nbroken\n")
    got = antonym_lexicon(read_numbered_lines(spark, str(tmp_path / "a.txt")))
    assert sorted((r["word"], r["repl"]) for r in got.collect()) == [
        ("good", "evil"), ("hot", "cold"),
    ]
    sim = similar_lexicon(lines(spark, "Day\tNight,noon", "day\tDusk"), "n")
    assert [tuple(r) for r in sim.collect()] == [("n", "day", "dusk")]


VOCABULARY = [
    "a\t1\t0.5\t0\tgood#1 fine#2\tg",
    "a\t2\t0\t0.25\tfine#1\tg",
    "  # comment",
    "n\t3\t0.5\t0.125\tgood#1 odd#3\tg",
    "n\t4\t0.5\t0.5\todd#3\tg",
]


def test_sentiment_vocabulary(spark):
    got = sentiment_vocabulary(lines(spark, *VOCABULARY), key="term_pos")
    assert sorted(r[0] for r in got.collect()) == ["good#a", "good#n"]
    got = sentiment_vocabulary(lines(spark, *VOCABULARY))
    assert [r[0] for r in got.collect()] == ["good"]


def test_generators_read_parsed_lines(spark, lex):
    rows = parse_lines(lines(spark, "1,positive,so good  x "))
    assert generate(rows, [antonym(4)], lex).first()["text"] == "so bad  x"


def test_malformed_lines_are_counted_in_one_pass(spark, tmp_path):
    from pyspark.sql import Observation

    from counterpoise.sources.lines import tagged_lines

    path = str(tmp_path / "lines")
    rows = ["1,positive,a", "x", "2,negative", "3,negative,b,c", "", ",,", "4,positive,"]
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(path)
    raw = spark.read.text(path)
    seen = Observation()
    parsed = parse_lines(raw, observation=seen)
    assert str(parsed._jdf.queryExecution().optimizedPlan()).count("Relation") == 1
    good = sorted(r["text"] for r in parsed.collect())
    two_passes = malformed_lines(raw).count()
    assert seen.get == {"lines": 7, "malformed": two_passes} and two_passes == 7 - len(good)
    tagged = tagged_lines(raw).collect()
    assert len(tagged) == 7
    assert sorted(r["text"] for r in tagged if r["_corrupt_record"] is None) == good
    assert good == sorted(r["text"] for r in parse_lines(raw).collect())


def test_interrupted_writes_leave_the_former_data(spark, tmp_path):
    from counterpoise.sources.lines import read_augmented

    path = str(tmp_path / "out")

    def sets(version, fail=""):
        rows = [(d, i, "original", "positive", f"{version} {d} {i}") for d in "abc" for i in range(5)]
        df = spark.createDataFrame(
            rows, "dataset string, src_id long, method string, sentiment string, text string")
        stop = F.raise_error(F.lit("lost")).cast("string")
        return df.withColumn("text", F.when(F.col("dataset") == fail, stop).otherwise(F.col("text")))

    def texts(*names):
        return sorted({r["text"].split(" ")[0] + r["dataset"] for r in read_augmented(spark, path, *names).collect()})

    with pytest.raises(ValueError):
        read_augmented(spark, path)
    first = write_augmented(sets("v1"), path)
    with pytest.raises(Exception, match="lost"):
        write_augmented(sets("v2", fail="b"), path, run="second")
    assert texts() == ["v1a", "v1b", "v1c"]
    # the unfinished run again, for two of the sets
    assert write_augmented(sets("v2"), path, datasets=["b", "c"], run="second") == "second"
    assert texts() == ["v1a", "v2b", "v2c"] and texts("b") == ["v2b"]
    assert read_augmented(spark, path).count() == 15
    with pytest.raises(ValueError):
        write_augmented(sets("v3"), path, run=first)
    with pytest.raises(ValueError):
        read_augmented(spark, path, "nowhere")
    plan = read_augmented(spark, path, "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dataset" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_last_lines_are_found_without_sorting_all_lines(spark):
    from counterpoise.sources.lexicons import antonym_lexicon, sentiment_vocabulary

    rows = [("a,b", 1, 0), ("a,c", 1, 2), ("a,b", 1, 1), ("x,y", None, None), ("x,z", -3, 5), ("n,m", None, 1)]
    lines = spark.createDataFrame(rows, "value string, line long, nth int")
    placed = lines.selectExpr("value", "struct(line, nth) as line_no")
    found = {r["word"]: r["repl"] for r in antonym_lexicon(placed).collect()}
    assert found == {"a": "c", "x": "z", "n": "m"}
    texts = spark.createDataFrame([("a\tb\t0.5\t0\tgood#1 good#1\tg", 7)], "value string, line_no long")
    made = sentiment_vocabulary(texts)
    assert [r["word"] for r in made.collect()] == ["good"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_vocabulary_lines_are_split_once(spark):
    lines = spark.createDataFrame([("a\t1\t0.5\t0\tgood#1 fine#2\tgloss", 1), ("# no\t1", 2)], "value string, line_no long")
    made = sentiment_vocabulary(lines)
    assert sorted(r["word"] for r in made.collect()) == ["fine", "good"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1
