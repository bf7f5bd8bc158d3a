"""Scenario suites: build all training sets, cross-validate all of them, report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.text import fold_of
from counterpoise.operators.changes import Vectors, changes, placed
from counterpoise.operators.generate import Gen, Lexicons, antonym, blankout, generate, similar
from counterpoise.operators.model import FEATURES, NAIVE_BAYES, SVM_ONE_STEP
from counterpoise.plans.crossval import FOLDS, cross_validate, cross_validate_changes
from counterpoise.plans.specs import SIMILAR_LEXICONS, Spec
from counterpoise.plans.training_sets import (
    ORIGINAL,
    Cell,
    RowPlan,
    distinct_gens,
    in_any_set,
    one_row_per_copy,
    row_plan,
    row_variants,
    sampled,
    weighted_variants,
)

SCENARIOS_PER_PASS = 48
SCENARIOS_OF_CHANGES = 128  # in one pass, where variants are changes of their source rows
BY_SOURCE, INDEPENDENT = "by_source", "independent"


def _test_weights(specs: Sequence[Spec]):
    """How often the rows of a cell with copies ``w`` are tested, per scenario."""
    for s in specs:
        if s.test not in ("original", "augmented", "generated"):
            raise ValueError(f"unknown test side {s.test!r}")

    def tested(cell: Cell, w: list[int]) -> list[int]:
        original = cell.gen == ORIGINAL
        by_side = {"original": lambda n: int(original), "augmented": lambda n: n,
                   "generated": lambda n: 0 if original else n}
        return [by_side[s.test](n) for s, n in zip(specs, w)]

    return tested


def suite_tables(
    corpus: DataFrame,
    specs: Sequence[Spec],
    lex: Lexicons,
    in_sample: Column | None = None,
    folds: str = BY_SOURCE,
    seed: str = "blank",
    redraw: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): train(fold, label, text, w) and test(src_id, gen, copy, fold, label, text, tw).

    by_source    everything made of one source row shares its fold, so no test row has a
                 relative in the training set
    independent  training and test folds are drawn separately, per copy
    redraw       copies of a blankout row drop other words each

    Nothing is written but the keys that limits need; both tables make their texts when they are
    read.  Where only originals are tested, the test side makes none.
    """
    if folds not in (BY_SOURCE, INDEPENDENT):
        raise ValueError(f"unknown fold rule {folds!r}")
    rows = weighted_variants(corpus, specs, lex, in_sample, seed, redraw, _test_weights(specs))
    if redraw:
        rows = rows.withColumn("tw", _of_one_copy(specs))
    elif folds == INDEPENDENT:
        rows = one_row_per_copy(rows, F.greatest(F.array_max("w"), F.array_max("tw")), "tw")
    else:
        rows = rows.withColumn("copy", F.lit(1))
    tested = rows
    if all(s.test == "original" for s in specs):
        originals = row_variants(corpus, [], Lexicons(), in_sample, seed)
        once = F.array(*[F.lit(1).cast("short")] * len(specs))
        tested = originals.withColumn("tw", once).withColumn("copy", F.lit(1))

    def fold(salt: str) -> Column:
        if folds == BY_SOURCE:
            return fold_of("src_id", folds=FOLDS)
        return fold_of("src_id", "method", "copy", folds=FOLDS, salt=salt)

    train = rows.filter(in_any_set("w")).select(fold("train").alias("fold"), "label", "text", "w")
    test = tested.filter(in_any_set("tw")).select(
        "src_id", "gen", "copy", fold("test").alias("fold"), "label", "text", "tw"
    )
    return train, test


def _of_one_copy(specs: Sequence[Spec]) -> Column:
    """Test weights where every row is one copy: it is tested as often as it is a training row, and
    of an original one copy is tested."""
    originals = F.array(*[F.lit(s.test == "original") for s in specs])
    return F.transform(
        F.arrays_zip("tw", "w", originals.alias("o")),
        lambda x: F.when(x["o"], F.when(F.col("copy") == 1, x["tw"]).otherwise(0))
        .when(x["tw"] > 0, x["w"]).otherwise(0).cast("short"),
    )


def run_suite(
    corpus: DataFrame,
    specs: Sequence[Spec],
    lex: Lexicons,
    classifier: str = NAIVE_BAYES,
    in_sample: Column | None = None,
    folds: str = BY_SOURCE,
    seed: str = "blank",
    features: int = FEATURES,
    redraw: bool = False,
    hashed: int | None = None,
    iterations: int = 1,
) -> DataFrame:
    """One row per scenario: size of its training set per class and its averaged metrics."""
    plain = classifier in (NAIVE_BAYES, SVM_ONE_STEP) and hashed is None and folds == BY_SOURCE
    if plain and not any(s.gen and s.fraction < 1 for s in specs):
        parts = [specs[i : i + SCENARIOS_OF_CHANGES] for i in range(0, len(specs), SCENARIOS_OF_CHANGES)]
        made = [
            _suite_of_changes(corpus, part, lex, classifier, in_sample, seed, features, redraw)
            for part in parts
        ]
        if all(one is not None for one in made):
            return reduce(DataFrame.unionByName, made)
    result = None
    for start in range(0, len(specs), SCENARIOS_PER_PASS):
        part = specs[start : start + SCENARIOS_PER_PASS]
        train, test = suite_tables(corpus, part, lex, in_sample, folds, seed, redraw)
        names = [s.scenario for s in part]
        one = cross_validate(
            train, test, ["src_id", "gen", "copy"], names, classifier, FOLDS, features, hashed,
            iterations,
        )
        result = one if result is None else result.unionByName(one)
    return result


def _suite_of_changes(
    corpus: DataFrame,
    specs: Sequence[Spec],
    lex: Lexicons,
    classifier: str,
    in_sample: Column | None,
    seed: str,
    features: int,
    redraw: bool,
) -> DataFrame | None:
    """``run_suite`` with folds by source row, where variants are changes of their source rows.

    None where a limit falls among rows that share an id: only their texts tell these apart.
    """
    gens, names = distinct_gens(specs), [s.scenario for s in specs]
    inside = sampled(in_sample)
    if all(s.base == "sampled" and s.test != "original" for s in specs):
        corpus = corpus.filter(inside)  # others are neither trained on nor tested
    outside = [any(s.base == "full" and s.gen and distinct_gens([s]) == [g] for s in specs) for g in gens]
    made = changes(corpus, gens, lex, inside, FOLDS, seed, outside, redraw)
    table = placed(made, corpus.count(), FOLDS)
    plan = row_plan(specs, gens, table)
    if plan.tied:
        return None
    vectors, drawn = _numbered(plan, specs, gens, redraw), seed if redraw else None
    return cross_validate_changes(table, gens, vectors, names, classifier, FOLDS, features, drawn)


def _numbered(plan: RowPlan, specs: Sequence[Spec], gens: Sequence[Gen], redraw: bool) -> Vectors:
    """The copy vectors of all cells; of a redrawn blankout row one per copy."""
    out = Vectors()
    nothing = out.number([0] * len(specs), [0] * len(specs))
    for gen, inside, label, cuts, ws, tws in plan.cells(_test_weights(specs)):
        numbers = []
        for w, tw in zip(ws, tws):
            if redraw and gen != ORIGINAL and gens[gen].kind == "blankout":
                each = [[int(n >= c) for n in w] for c in range(1, max(1, *w) + 1)]
                numbers.append([out.number(one, [x if t else 0 for x, t in zip(one, tw)]) for one in each])
            else:
                numbers.append([out.number(w, tw)])
        most = max(map(len, numbers))
        out.cells[gen, inside, label] = cuts, [one + [nothing] * (most - len(one)) for one in numbers]
    return out


# ---------------------------------------------------------------- export


def export_gens(lexicons: Sequence[str] = SIMILAR_LEXICONS) -> dict[str, Gen]:
    """The exported sets by name: one-word antonyms, all-word similars, one dropped word."""
    gens = {"antonym": antonym(4)}
    gens.update({f"similar_{name}": similar(name) for name in lexicons})
    gens["blankout"] = blankout(1, protect=False)
    return gens


def augmented_sets(
    corpus: DataFrame, lex: Lexicons, lexicons: Sequence[str] = SIMILAR_LEXICONS
) -> DataFrame:
    """(dataset, src_id, method, sentiment, text): originals and generated rows of every set."""
    gens = export_gens(lexicons)
    names = list(gens)
    made = generate(corpus, list(gens.values()), lex)
    name_of = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("gen") + 1)
    originals = corpus.select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("dataset"),
        F.col("id").alias("src_id"),
        F.lit("original").alias("method"),
        "sentiment",
        "text",
    )
    return originals.unionByName(
        made.select(name_of.alias("dataset"), "src_id", "method", "sentiment", "text")
    )
