"""Shape of the physical plans."""

from pyspark.sql import functions as F

from counterpoise.operators.generate import antonym, blankout, generate, similar
from counterpoise.operators.lookup import lookup_join
from counterpoise.plans import specs as P


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(1000).selectExpr(
        "id", "'positive' sentiment", "'good great w' text", "'x' unused"
    ).write.parquet(path)
    return spark.read.parquet(path).select("id", "sentiment", "text")


def test_generators_do_not_move_documents(spark, lex, tmp_path):
    df = generate(corpus(spark, tmp_path), [antonym(2), similar("a"), blankout(2, True)], lex)
    main = plan_of(df).split("Subqueries")[0]
    assert "Exchange" not in main.split("Subquery")[0]
    assert "Join" not in main.split("Subquery")[0]


def test_blankout_alone_does_not_shuffle(spark, tmp_path):
    plan = plan_of(generate(corpus(spark, tmp_path), [blankout(2)]))
    assert "Exchange" not in plan


def test_minority_scope_is_pushed_to_the_scan(spark, lex, tmp_path):
    plan = plan_of(generate(corpus(spark, tmp_path), [antonym(3)], lex))
    filters = [part.split("]")[0] for part in plan.split("DataFilters: [")[1:]]
    assert any("sentiment" in f for f in filters)


def test_large_tables_are_not_broadcast_whole(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(id % 50 as string) term")
    table = spark.range(50).selectExpr("cast(id as string) term", "id v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(lookup_join(rows, table, "term", "left", max_rows=5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_suite_sizes():
    assert len(P.similar_family()) == 32
    assert len(P.blankout_family()) == 48
    assert len(P.antonym_family()) == 36
    assert len(P.balanced_family()) == 12 and len(P.imbalance_family()) == 3
    names = [s.scenario for s in P.svm_suite()]
    assert len(names) == len(set(names)) == 104


def test_rows_without_lexicon_words_are_not_moved(spark, tmp_path):
    from counterpoise.operators.generate import Lexicons

    path = str(tmp_path / "c")
    spark.range(1000).selectExpr(
        "id", "'positive' sentiment", "if(id % 50 = 0, 'good great w', 'plain words ' || id) text"
    ).write.parquet(path)
    words = spark.createDataFrame([("good", "bad"), ("hot", "cold")], "word string, repl string")
    lex = Lexicons(antonyms=words, max_bytes=1)
    made = generate(spark.read.parquet(path), [antonym(2)], lex)
    assert made.count() == 20
    lines = plan_of(made).splitlines()

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    def below(at):
        """The lines of the node at a line and its children, without subqueries."""
        out, skip = [lines[at]], None
        for line in lines[at + 1 :]:
            if depth(line) <= depth(lines[at]):
                break
            skip = None if skip is not None and depth(line) <= skip else skip
            if skip is None and "Subquery" in line.lstrip(" :+-")[:20]:
                skip = depth(line)
            if skip is None:
                out.append(line)
        return chr(10).join(out)

    union = next(i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Union"))
    first = below(union + 1)
    # the first child of the union reads and rewrites, and exchanges nothing
    assert "parquet" in first and "Exchange" not in first and "Join" not in first


def test_suites_store_no_texts(spark, lex, monkeypatch):
    from counterpoise.operators import generate as gen_module
    from counterpoise.operators import model
    from counterpoise.plans import crossval, training_sets
    from counterpoise.plans.suites import run_suite

    stored = []
    for module in (gen_module, model, crossval, training_sets):
        usual = module.spool
        monkeypatch.setattr(
            module, "spool", lambda df, *name, usual=usual: (stored.append(df.columns), usual(df, *name))[1]
        )
    rows = [(i, "positive" if i % 3 else "negative", f"good great day w{i} x y") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    specs = [P.with_blankout(2, True, False, "over", test="augmented"), P.with_antonyms(2, False, "under")]
    assert run_suite(df, specs, lex).count() == 2
    assert len(stored) >= 2 and not any("text" in columns for columns in stored)


def test_sentences_are_cleaned_once(spark):
    from workload.corpus import labelled_sentences

    rows = labelled_sentences(spark, "/root/testdata/sf0.001")
    filters = [x for x in plan_of(rows).splitlines() if "Filter (" in x or "Filter NOT" in x]
    # no text is made again to be filtered
    assert filters and not any("regexp_replace" in x or "replace(" in x for x in filters)
    assert rows.filter("text = '' or text is null").count() == 0


def test_rows_outside_of_the_sample_make_no_variants(spark, lex):
    from counterpoise.plans.training_sets import weighted_variants

    rows = [(i, "negative", f"good great w{i} x y") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    specs = [P.with_antonyms(2, False, "over")]
    flags = [r["in_sample"] for r in weighted_variants(df, specs, lex).select("in_sample").collect()]
    assert flags and all(flags)
    full = [P.with_antonyms(2, False, "over", base="full")]
    assert not all(r["in_sample"] for r in weighted_variants(df, full, lex).select("in_sample").collect())


def test_tied_rows_are_read_once_per_search(spark, lex, monkeypatch):
    from counterpoise.plans import training_sets

    stored, made = [], []
    spooled, usual = training_sets.spool, training_sets.generate
    monkeypatch.setattr(
        training_sets, "spool", lambda df, name: (stored.append((name, df.columns)), spooled(df, name))[1]
    )
    monkeypatch.setattr(
        training_sets, "generate", lambda *a, **kw: (made.append(kw.get("texts", True)), usual(*a, **kw))[1]
    )
    rows = [(i % 2, "positive" if i % 3 else "negative", f"good great w{i} x y") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, sentiment string, text string")
    specs = [P.with_similars("a", "all", False, "under", 0.4)]
    rows = training_sets.training_set_rows(df, specs, lex, in_sample=F.lit(True))
    assert rows.filter("label = 1").count() == rows.filter("label = 0").count() > 0
    # limits fall among the rows of an id; what is searched is stored, without texts
    assert [name for name, _ in stored].count("tied") >= 2
    assert not any("text" in columns for _, columns in stored)
    assert made[0] is False and all(made[1:])
