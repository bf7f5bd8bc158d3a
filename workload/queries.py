"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.text import fold_of, label_of, tokens
from counterpoise.operators import generate as G
from counterpoise.operators import metrics as M
from counterpoise.operators import model as B
from counterpoise.operators import sampling as S
from counterpoise.operators.svm import SVM, svm_model, svm_weights
from counterpoise.plans import specs as P
from counterpoise.plans.crossval import FOLDS, fold_cells
from counterpoise.plans.suites import (
    BY_SOURCE,
    INDEPENDENT,
    augmented_sets,
    run_suite,
    suite_tables,
)
from counterpoise.plans.training_sets import build_training_set, training_set_rows
from counterpoise.session import scratch_dir, spool, tune
from counterpoise.sources.lexicons import antonym_lexicon, sentiment_vocabulary, similar_lexicon
from counterpoise.sources.lines import (
    parse_lines,
    read_augmented,
    tagged_lines,
    to_lines,
    write_augmented,
)
from workload import fixtures as X
from workload.corpus import IDS_PER_DOCUMENT, labelled_sentences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(tune(spark), sf_dir)

        QUERIES[name] = run
        return f

    return register


def lexicons(spark: SparkSession) -> G.Lexicons:
    return G.Lexicons(
        antonyms=spark.createDataFrame(X.ANTONYMS, "word string, repl string"),
        similar=spark.createDataFrame(X.SIMILARS, "name string, word string, repl string"),
        senti=spark.createDataFrame([(w,) for w in X.SENTI], "word string"),
    )


corpus = labelled_sentences


# ---------------------------------------------------------------- sources, projections


@query("corpus_scan")
def corpus_scan(spark, d):
    return parse_lines(to_lines(corpus(spark, d), "id", "sentiment", "text"))


@query("corpus_scan_tagged")
def corpus_scan_tagged(spark, d):
    """Good and malformed lines of one pass: every seventh line lacks its text."""
    rows = corpus(spark, d)
    whole = F.concat_ws(",", F.col("id").cast("string"), "sentiment", "text")
    cut = F.concat_ws(",", F.col("id").cast("string"), "sentiment")
    line = F.when(F.col("id") % 7 == 0, cut).otherwise(whole)
    return tagged_lines(rows.select(line.alias("value")))


def _neighbours(spark, d) -> DataFrame:
    """(word, next, line_no) for every two neighbouring words of all sentences."""
    words = tokens("text")
    two = F.arrays_zip(words.alias("word"), F.slice(words, 2, F.size(words)).alias("next"))
    pairs = corpus(spark, d).select("id", F.posexplode(two).alias("nth", "two"))
    return pairs.select(
        F.col("two.word"), F.col("two.next"), F.struct("id", "nth").alias("line_no")
    ).filter(F.col("next").isNotNull())


def _derived_antonyms(spark, d) -> DataFrame:
    line = F.concat_ws(",", "word", "next", F.lit("ignored"))
    return antonym_lexicon(_neighbours(spark, d).select(line.alias("value"), "line_no"))


def _derived_similar(spark, d, name: str) -> DataFrame:
    line = F.concat_ws("\t", "word", F.concat_ws(",", "next", F.lit("second")))
    return similar_lexicon(_neighbours(spark, d).select(line.alias("value"), "line_no"), name)


@query("lexicon_antonym")
def lexicon_antonym(spark, d):
    """Lexicon lines made of every two neighbouring words."""
    return _derived_antonyms(spark, d)


@query("lexicon_similar")
def lexicon_similar(spark, d):
    """Lexicon lines made of every two neighbouring words."""
    return _derived_similar(spark, d, "derived")


@query("senti_vocab")
def senti_vocab(spark, d):
    """Vocabulary lines made of all words of every sentence, ranked by position."""
    n = F.col("id")
    terms = F.transform(
        tokens(F.lower("text")),
        lambda w, i: F.concat(F.replace(w, F.lit("#"), F.lit("")), F.lit("#"),
                              (i + 1).cast("string")),
    )
    line = F.concat_ws(
        "\t",
        F.when(n % 2 == 0, "a").otherwise("n"),
        n.cast("string"),
        ((n % 5) / 8).cast("string"),
        ((F.floor(n / 5) % 3) / 8).cast("string"),
        F.array_join(terms, " "),
        F.lit("gloss"),
    )
    lines = corpus(spark, d).select(line.alias("value"), n.alias("line_no"))
    return sentiment_vocabulary(lines)


@query("label_encode")
def label_encode(spark, d):
    return corpus(spark, d).select("id", label_of("sentiment").cast("double").alias("label"))


@query("class_split")
def class_split(spark, d):
    return corpus(spark, d).filter(F.col("sentiment") == "negative")


@query("tokenize")
def tokenize(spark, d):
    return corpus(spark, d).select("id", F.posexplode(tokens("text")).alias("pos", "term"))


for _profile, _cap in (("sampled_minority", None), ("capped", X.CAP), ("asis", None)):
    QUERIES[f"prepare_{_profile}"] = lambda spark, d, p=_profile, cap=_cap: S.prepare(
        corpus(tune(spark), d), p, cap=cap
    )


@query("class_counts")
def class_counts(spark, d):
    labels = corpus(spark, d).select(label_of("sentiment").alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("n"))


@query("train_set_imbalanced")
def train_set_imbalanced(spark, d):
    rows = S.prepare(corpus(spark, d), "sampled_minority")
    labelled = rows.select("id", label_of("sentiment").alias("label"), "text")
    return B.term_counts(labelled, "id", "label")


@query("lexicon_hits")
def lexicon_hits(spark, d):
    return G.lexicon_hits(corpus(spark, d), lexicons(spark).similar)


@query("lexicon_coverage")
def lexicon_coverage(spark, d):
    return G.lexicon_coverage(corpus(spark, d), lexicons(spark).antonyms)


@query("antonym_prefilter")
def antonym_prefilter(spark, d):
    return G.antonym_prefilter(corpus(spark, d), lexicons(spark).antonyms)


# ---------------------------------------------------------------- generators


def _made(gen: G.Gen) -> Query:
    def run(spark, d):
        spark = tune(spark)
        return G.generate(corpus(spark, d), [gen], lexicons(spark)).drop("gen")

    return run


ANTONYM_NAMES = {
    "paper_both": 0,
    "paper_minority": 1,
    "all_both": 2,
    "all_minority": 3,
    "one_both": 4,
    "one_minority": 5,
}
SIMILAR_NAMES = {
    "all_both": ("all", False),
    "all_minority": ("all", True),
    "one_both": ("one", False),
    "one_minority": ("one", True),
}
for _name, _case in ANTONYM_NAMES.items():
    QUERIES[f"antonym_{_name}"] = _made(G.antonym(_case))
    QUERIES[f"antonym_{_name}_senti"] = _made(G.antonym(_case, senti=True))
for _name, (_words, _minority) in SIMILAR_NAMES.items():
    QUERIES[f"similar_{_name}"] = _made(G.similar("news", _words, _minority))
QUERIES["blankout"] = _made(G.blankout(X.K))
QUERIES["blankout_senti"] = _made(G.blankout(X.K, senti=True))


def _exported(gen: G.Gen) -> Query:
    """Generated rows as the text lines of the exported sets."""

    def run(spark, d):
        spark = tune(spark)
        made = G.generate(corpus(spark, d), [gen], lexicons(spark))
        return to_lines(made, "src_id", "sentiment", "text")

    return run


QUERIES["antonym_export"] = _exported(G.antonym(4))
QUERIES["similar_export"] = _exported(G.similar("news"))
QUERIES["blankout_export"] = _exported(G.blankout(1, protect=False))


def _made_large(gen: G.Gen, max_bytes: int | None = None) -> Query:
    """Generators over a lexicon derived from the whole corpus; one byte forces the joins."""

    def run(spark, d):
        spark = tune(spark)
        lex = G.Lexicons(
            antonyms=_derived_antonyms(spark, d) if gen.kind == "antonym" else None,
            similar=_derived_similar(spark, d, gen.lexicon) if gen.kind == "similar" else None,
            max_bytes=max_bytes,
        )
        return G.generate(corpus(spark, d), [gen], lex).drop("gen")

    return run


for _path, _bytes in (("large", None), ("joined", 1)):
    QUERIES[f"antonym_all_both_{_path}_lexicon"] = _made_large(G.antonym(2), _bytes)
    QUERIES[f"similar_all_both_{_path}_lexicon"] = _made_large(G.similar("news"), _bytes)


@query("blankout_senti_vocab")
def blankout_senti_vocab(spark, d):
    """Keeps every word of the vocabulary that the corpus itself gives."""
    lex = G.Lexicons(senti=QUERIES["senti_vocab"](spark, d))
    return G.generate(corpus(spark, d), [G.blankout(X.K, senti=True)], lex).drop("gen")


def _bare(spark, d) -> DataFrame:
    """Every third sentence is nothing but a negation, so that its rewrite is empty."""
    text = F.when(F.col("id") % 3 == 0, "NOT").otherwise(F.col("text"))
    return corpus(spark, d).withColumn("text", text)


@query("antonym_with_dropped")
def antonym_with_dropped(spark, d):
    """Rewrites and those left out as empty, from one pass."""
    made = G.generate(_bare(spark, d), [G.antonym(2)], lexicons(spark), keep_empty=True)
    return made.drop("gen")


@query("blankout_sweep")
def blankout_sweep(spark, d):
    """k = 2..5 in one pass."""
    gens = [G.blankout(k) for k in range(2, 6)]
    made = G.generate(corpus(spark, d), gens)
    return made.withColumn("k", F.col("gen") + 2).drop("gen")


def _tsv(spark, d, c0="id") -> DataFrame:
    rows = corpus(spark, d).withColumn("c2", F.lit("x"))
    return parse_lines(to_lines(rows, c0, "sentiment", "c2", "text", sep="\t"), "tsv4")


def _five(spark, d, c0="id", c1="sentiment") -> DataFrame:
    rows = corpus(spark, d).select(
        "id", "sentiment", F.lit("Q").alias("c2"), "text", label_of("sentiment").alias("label")
    )
    parsed = parse_lines(to_lines(rows, c0, c1, "c2", "text", "label"), "five_col")
    return parsed.withColumnRenamed("label", "sentiment")


@query("antonym_tsv")
def antonym_tsv(spark, d):
    gen = G.Gen("antonym", case=1, prefilter=False)
    made = G.generate(_tsv(spark, d), [gen], lexicons(spark))
    return made.select("src_id", "sentiment", "text", "n_changed")


@query("antonym_tsv_repeated_ids")
def antonym_tsv_repeated_ids(spark, d):
    """The class stands where the id should be, so very many lines share it."""
    gen = G.Gen("antonym", case=1, prefilter=False)
    made = G.generate(_tsv(spark, d, "sentiment"), [gen], lexicons(spark))
    return made.select("c0", "sentiment", "text", "n_changed")


@query("similar_tsv")
def similar_tsv(spark, d):
    gen = replace(G.similar("news"), flip="keep")
    made = G.generate(_tsv(spark, d), [gen], lexicons(spark))
    return made.select("src_id", "sentiment", "text", "n_changed")


def _made_five(gen: G.Gen, c0="id", c1="sentiment") -> Query:
    def run(spark, d):
        spark = tune(spark)
        made = G.generate(_five(spark, d, c0, c1), [replace(gen, flip="digit")], lexicons(spark))
        return made.select("c0", "c1", "c2", "text", F.col("sentiment").alias("label"))

    return run


QUERIES["antonym_five_col"] = _made_five(G.antonym(4))
QUERIES["similar_five_col"] = _made_five(G.similar("news"))
QUERIES["similar_five_col_repeated_ids"] = _made_five(G.similar("news"), "sentiment", "id")
QUERIES["blankout_five_col"] = _made_five(G.blankout(1, protect=False))


# ---------------------------------------------------------------- sampling


@query("undersample")
def undersample(spark, d):
    return S.undersample(corpus(spark, d), "id")


@query("oversample")
def oversample(spark, d):
    return S.oversample(corpus(spark, d), P.CAP_PLAIN, "id")


@query("sample_exact_n")
def sample_exact_n(spark, d):
    return S.first_n(corpus(spark, d), X.SAMPLE_N, "id")


def _by_document(spark, d) -> DataFrame:
    """The corpus with the number of the document as id of all its sentences."""
    return corpus(spark, d).withColumn("id", F.floor(F.col("id") / IDS_PER_DOCUMENT))


@query("sample_exact_n_repeated_ids")
def sample_exact_n_repeated_ids(spark, d):
    return S.first_n(_by_document(spark, d), X.SAMPLE_N, "id")


@query("undersample_repeated_ids")
def undersample_repeated_ids(spark, d):
    return S.undersample(_by_document(spark, d), "id")


@query("oversample_repeated_ids")
def oversample_repeated_ids(spark, d):
    return S.oversample(_by_document(spark, d), P.CAP_PLAIN, "id")


@query("sample_fraction")
def sample_fraction(spark, d):
    return S.bernoulli(corpus(spark, d), X.SAMPLE_SHARE, "id")


@query("kfold_assign")
def kfold_assign(spark, d):
    return corpus(spark, d).select("id", fold_of("id").alias("fold"))


# ---------------------------------------------------------------- training sets

SETS: dict[str, list[P.Spec]] = {}
for _senti in (True, False):
    _s = "_senti" if _senti else ""
    for _minority in (True, False):
        _scope = "minority" if _minority else "both"
        for _r in P.REBALANCES:
            _name = f"set_blankout_{_scope}{_s}" + (f"_{_r}" if _r else "")
            SETS[_name] = [P.with_blankout(X.K, _minority, _senti, _r)]
SETS["set_blankout_balanced"] = [s for s in P.balanced_family(X.K) if "blankout" in s.scenario]
for _senti in (False, True):
    for _r in P.REBALANCES:
        _name = "set_antonym" + ("_senti" if _senti else "") + (f"_{_r}" if _r else "")
        SETS[_name] = [P.with_antonyms(case, _senti, _r) for case in range(6)]
SETS["set_antonym_perturbed"] = P.perturbed_family()
for _words in ("all", "one"):
    SETS[f"set_similar_{_words}_both"] = [P.with_similars("news", _words, False, None)]
    for _r in P.REBALANCES:
        _name = f"set_similar_{_words}_minority" + (f"_{_r}" if _r else "")
        SETS[_name] = [P.with_similars("news", _words, True, _r)]
SETS["similar_fraction"] = [P.with_similars("news", "all", False, None, X.FRACTION)]


def _set_query(specs: list[P.Spec]) -> Query:
    def run(spark, d):
        spark = tune(spark)
        if len(specs) == 1:
            return build_training_set(corpus(spark, d), specs[0], lexicons(spark))
        return training_set_rows(corpus(spark, d), specs, lexicons(spark))

    return run


for _name, _specs in SETS.items():
    QUERIES[_name] = _set_query(_specs)


# the same where very many rows share an id, and with it their place in the order
TIED_SETS = {
    "set_antonym_over_repeated_ids": [P.with_antonyms(case, False, "over") for case in (2, 3)],
    "set_antonym_perturbed_repeated_ids": P.perturbed_family(),
    "similar_fraction_repeated_ids": [P.with_similars("news", "all", False, None, X.FRACTION)],
    "set_similar_under_repeated_ids": [P.with_similars("news", "all", True, "under", X.FRACTION)],
}


def _tied_set_query(specs: list[P.Spec]) -> Query:
    def run(spark, d):
        spark = tune(spark)
        return training_set_rows(_by_document(spark, d), specs, lexicons(spark))

    return run


for _name, _specs in TIED_SETS.items():
    QUERIES[_name] = _tied_set_query(_specs)

# toxic documents as a third class, everything as it is
THIRD_SET = P.with_similars("news", "all", True, "under")


@query("prepare_third_class")
def prepare_third_class(spark, d):
    return S.prepare(corpus(spark, d, third=True), "asis")


@query("set_third_class")
def set_third_class(spark, d):
    rows = corpus(spark, d, third=True)
    return build_training_set(rows, THIRD_SET, lexicons(spark), in_sample=F.lit(True))


REDRAWN = P.with_blankout(X.K, False, False, "over")


@query("set_blankout_both_over_redraw")
def set_blankout_both_over_redraw(spark, d):
    return build_training_set(corpus(spark, d), REDRAWN, lexicons(spark), redraw=True)


# ---------------------------------------------------------------- classifiers


def _labelled(spark, d) -> DataFrame:
    return corpus(spark, d).select("id", label_of("sentiment").alias("label"), "text")


@query("term_frequency")
def term_frequency(spark, d):
    return B.term_counts(corpus(spark, d), "id")


@query("nb_model")
def nb_model(spark, d):
    return B.nb_model(_labelled(spark, d)).select(
        "label", "term", "tf", F.round("pi", 6).alias("pi"), F.round("theta", 6).alias("theta")
    )


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.withColumn("margin", F.round("margin", 6))


@query("nb_predict")
def nb_predict(spark, d):
    rows = _labelled(spark, d)
    return _rounded(B.fit_predict(rows, rows, "id"))


@query("nb_holdout")
def nb_holdout(spark, d):
    rows = _labelled(spark, d)
    held_out = fold_of("id") == X.HOLDOUT_FOLD
    return _rounded(B.fit_predict(rows.filter(~held_out), rows.filter(held_out), "id"))


@query("svm1_model")
def svm1_model(spark, d):
    weights = B.svm1_model(_labelled(spark, d))
    return weights.select("term", F.round("weight", 9).alias("weight"))


@query("svm1_predict")
def svm1_predict(spark, d):
    rows = _labelled(spark, d)
    return B.fit_predict(rows, rows, "id", B.SVM_ONE_STEP).select("id", "label", "prediction")


@query("svm3_model")
def svm3_model(spark, d):
    weights = svm_model(_labelled(spark, d), X.SVM_STEPS)
    return weights.select("term", F.round("weight", 9).alias("weight"))


def _generated(spark, d) -> DataFrame:
    made = G.generate(corpus(spark, d), [G.antonym(2)], lexicons(spark))
    return made.select("src_id", label_of("sentiment").alias("label"), "text")


@query("denoise_synthetic")
def denoise_synthetic(spark, d):
    return _rounded(B.denoise(_generated(spark, d)))


@query("denoise_with_original")
def denoise_with_original(spark, d):
    return _rounded(B.denoise(_generated(spark, d), _labelled(spark, d)))


def _cv(classifier: str, folds: str = BY_SOURCE, hashed: int | None = None) -> Query:
    spec = replace(P.plain(), base="full")

    def run(spark, d):
        spark = tune(spark)
        train, test = suite_tables(corpus(spark, d), [spec], G.Lexicons(), folds=folds)
        stats = spool(B.training_stats(train, hashed))
        weights = svm_weights(train, 1, FOLDS, X.SVM_STEPS) if classifier == SVM else None
        scored = B.margins(
            stats, test, ["src_id"], 1, classifier, FOLDS, hashed or B.FEATURES, hashed, weights
        )
        cells = fold_cells(scored, [spec.scenario])
        return _round_metrics(
            cells.join(M.binary_metrics(cells).select("fold", *METRICS), "fold")
        ).drop("scenario")

    return run


METRICS = ("f1_at_0", "f1_at_1", "aupr", "auroc")


def _round_metrics(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({m: F.round(m, 6) for m in names or METRICS})


QUERIES["cv_nb"] = _cv(B.NAIVE_BAYES)
QUERIES["cv_nb_independent"] = _cv(B.NAIVE_BAYES, INDEPENDENT)
QUERIES["cv_svm1"] = _cv(B.SVM_ONE_STEP)
QUERIES["cv_svm3"] = _cv(SVM)
# few buckets, so that terms collide
QUERIES["cv_nb_hashed"] = _cv(B.NAIVE_BAYES, hashed=X.BUCKETS)


# ---------------------------------------------------------------- metrics


def _pairs(spark, d) -> DataFrame:
    """(fold, prediction, label) from the two label columns of the table."""
    return spark.read.parquet(f"{d}/labels.parquet").select(
        fold_of("doc_id").alias("fold"),
        F.col("toxic").alias("prediction"),
        (1 - F.col("quality")).alias("label"),
    )


def _fold_metrics(spark, d) -> DataFrame:
    return M.binary_metrics(M.cells("fold")(_pairs(spark, d)))


@query("metrics_binary")
def metrics_binary(spark, d):
    one = _fold_metrics(spark, d)
    return _round_metrics(one, *[c for c in one.columns if c != "fold"])


@query("metric_f1_threshold")
def metric_f1_threshold(spark, d):
    return _fold_metrics(spark, d).agg(
        F.round(F.avg("f1_at_0"), 6).alias("f1_at_0"),
        F.round(F.avg("f1_at_1"), 6).alias("f1_at_1"),
    )


@query("metric_aupr")
def metric_aupr(spark, d):
    return _fold_metrics(spark, d).agg(F.round(F.avg("aupr"), 6).alias("aupr"))


@query("metric_auroc")
def metric_auroc(spark, d):
    return _fold_metrics(spark, d).agg(F.round(F.avg("auroc"), 6).alias("auroc"))


@query("metrics_confusion")
def metrics_confusion(spark, d):
    return M.confusion_matrix(_pairs(spark, d))


@query("metrics_by_label")
def metrics_by_label(spark, d):
    return _round_metrics(
        M.metrics_by_label(_pairs(spark, d)), "precision", "recall", "fpr", "f1"
    )


@query("metrics_weighted")
def metrics_weighted(spark, d):
    one = M.weighted_metrics(_pairs(spark, d))
    return _round_metrics(one, *one.columns)


# ---------------------------------------------------------------- suites

SUITES: dict[str, tuple[list[P.Spec], str]] = {
    "suite_similar_fair": (P.similar_family(), B.NAIVE_BAYES),
    "suite_balanced": (P.balanced_family(X.K), B.NAIVE_BAYES),
    "suite_imbalance": (P.imbalance_family(), B.NAIVE_BAYES),
    "suite_blankout_fair": (P.blankout_family(), B.NAIVE_BAYES),
    "suite_antonym_fair": (P.antonym_family(), B.NAIVE_BAYES),
    "suite_blankout_bias": (
        [replace(s, test="augmented") for s in P.blankout_family()],
        B.NAIVE_BAYES,
    ),
    "suite_bias_other": (P.biased_others(X.K), B.NAIVE_BAYES),
    "suite_svm": (P.svm_suite(X.K), B.SVM_ONE_STEP),
}


def _suite_query(
    specs, classifier, cap=None, whole=False, folds=BY_SOURCE, redraw=False, third=False
) -> Query:
    def run(spark, d):
        spark = tune(spark)
        rows = corpus(spark, d, third=third)
        how = {"folds": folds, "in_sample": F.lit(True) if whole else None, "redraw": redraw}
        if cap is not None:
            rows = S.capped_majority(rows, cap)
        return _round_metrics(run_suite(rows, specs, lexicons(spark), classifier, **how))

    return run


for _name, (_specs, _classifier) in SUITES.items():
    QUERIES[_name] = _suite_query(_specs, _classifier)
# the headline suite on the other two profiles, and folds drawn apart
QUERIES["suite_similar_fair_capped"] = _suite_query(P.similar_family(), B.NAIVE_BAYES, X.CAP)
QUERIES["suite_similar_fair_asis"] = _suite_query(P.similar_family(), B.NAIVE_BAYES, whole=True)
QUERIES["suite_imbalance_independent"] = _suite_query(
    P.imbalance_family(), B.NAIVE_BAYES, folds=INDEPENDENT
)
REDRAWN_SUITE = P.blankout_family((X.K,), (False,)) + P.on_own_folds(
    [s for s in P.blankout_family((X.K,), (True,)) if s.rebalance == "over"]
)
QUERIES["suite_blankout_redraw"] = _suite_query(REDRAWN_SUITE, B.NAIVE_BAYES, redraw=True)
QUERIES["suite_third_class"] = _suite_query(
    P.imbalance_family() + [THIRD_SET], B.NAIVE_BAYES, whole=True, third=True
)


@query("augmented_export")
def augmented_export(spark, d):
    return augmented_sets(corpus(spark, d), lexicons(spark))


@query("augmented_read_back")
def augmented_read_back(spark, d):
    """Two of the exported sets, written with all others and read back alone."""
    path = f"{scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    write_augmented(augmented_sets(corpus(spark, d), lexicons(spark)), path)
    return read_augmented(spark, path, "antonym", "similar_news")
