"""Scenario descriptions.  A scenario says how a training set is made and how it is tested."""

from __future__ import annotations

from dataclasses import dataclass, replace

from counterpoise.operators.generate import Gen, antonym, blankout, similar

# How often a minority row may be repeated, by generator.
CAP_PLAIN = 10
CAP_BLANKOUT_MINORITY = 4
CAP_BLANKOUT_BOTH = 7
CAP_ANTONYM = 5
CAP_SIMILAR = 4

SIMILAR_LEXICONS = ("news", "tweets", "news_senti", "tweets_senti")


@dataclass(frozen=True)
class Spec:
    """One scenario.

    gen        generator, or None for originals only
    base       'sampled' (the imbalanced training rows) or 'full' (the whole corpus)
    fraction   share of the generated rows that is used
    rebalance  None, 'under' or 'over'
    cap        largest number of copies when oversampling
    perturb    replace half of the majority originals by generated majority rows
    test       'original' (fair), 'augmented' (folds of the training set itself) or
               'generated' (folds of the generated rows only)
    """

    scenario: str
    gen: Gen | None = None
    base: str = "sampled"
    fraction: float = 1.0
    rebalance: str | None = None
    cap: int = CAP_PLAIN
    perturb: bool = False
    test: str = "original"


def plain(rebalance: str | None = None, **kw) -> Spec:
    name = {None: "plain", "under": "plain_under", "over": "plain_over"}[rebalance]
    return Spec(name, None, rebalance=rebalance, cap=CAP_PLAIN, **kw)


def with_blankout(k: int, minority: bool, senti: bool, rebalance: str | None, **kw) -> Spec:
    scope = "minority" if minority else "both"
    name = "_".join(
        p for p in (f"blankout_k{k}", scope, "senti" if senti else "", rebalance or "") if p
    )
    cap = CAP_BLANKOUT_MINORITY if minority else CAP_BLANKOUT_BOTH
    return Spec(
        name, blankout(k, senti=senti, minority=minority), rebalance=rebalance, cap=cap, **kw
    )


def with_antonyms(case: int, senti: bool, rebalance: str | None, **kw) -> Spec:
    name = "_".join(p for p in (f"antonym_{case}", "senti" if senti else "", rebalance or "") if p)
    return Spec(name, antonym(case, senti), rebalance=rebalance, cap=CAP_ANTONYM, **kw)


def with_similars(
    lexicon: str, words: str, minority: bool, rebalance: str | None,
    fraction: float = 1.0, **kw,
) -> Spec:
    scope = "minority" if minority else "both"
    name = "_".join(p for p in (f"similar_{lexicon}", words, scope, rebalance or "") if p)
    return Spec(
        name, similar(lexicon, words, minority), fraction=fraction, rebalance=rebalance,
        cap=CAP_SIMILAR, **kw,
    )


def perturbed(case: int, **kw) -> Spec:
    return Spec(f"perturbed_{case}", antonym(case), perturb=True, cap=CAP_ANTONYM, **kw)


# ---------------------------------------------------------------- families

REBALANCES = (None, "under", "over")


def similar_family(
    lexicons: tuple[str, ...] = SIMILAR_LEXICONS, fraction: float = 1.0, **kw
) -> list[Spec]:
    """Per lexicon eight sets: both classes, minority, minority rebalanced; all/one word."""
    out = []
    for lexicon in lexicons:
        for words in ("all", "one"):
            out.append(with_similars(lexicon, words, False, None, fraction, **kw))
            for rebalance in REBALANCES:
                out.append(with_similars(lexicon, words, True, rebalance, fraction, **kw))
    return out


def blankout_family(ks=range(2, 6), sentis=(True, False), **kw) -> list[Spec]:
    return [
        with_blankout(k, minority, senti, rebalance, **kw)
        for k in ks
        for senti in sentis
        for minority in (True, False)
        for rebalance in REBALANCES
    ]


def antonym_family(sentis=(False, True), **kw) -> list[Spec]:
    return [
        with_antonyms(case, senti, rebalance, **kw)
        for senti in sentis
        for case in range(6)
        for rebalance in REBALANCES
    ]


def imbalance_family(**kw) -> list[Spec]:
    return [plain(r, **kw) for r in (None, "over", "under")]


def balanced_family(k: int = 2, lexicons: tuple[str, ...] = SIMILAR_LEXICONS) -> list[Spec]:
    """The whole corpus, alone or with one generator on top."""
    out = [replace(plain(), scenario="balanced_plain", base="full")]
    for case in range(6):
        out.append(Spec(f"balanced_antonym_{case}", antonym(case), base="full"))
    for lexicon in lexicons:
        out.append(Spec(f"balanced_similar_{lexicon}", similar(lexicon), base="full"))
    out.append(Spec("balanced_blankout", blankout(k, senti=True), base="full"))
    return out


def perturbed_family(**kw) -> list[Spec]:
    return [perturbed(case, **kw) for case in (0, 2, 4)]


def on_own_folds(specs: list[Spec], prefix: str = "own_") -> list[Spec]:
    """The same sets, tested on folds of the augmented set."""
    return [replace(s, scenario=prefix + s.scenario, test="augmented") for s in specs]


def biased_others(k: int = 2) -> list[Spec]:
    """Everything but the blankout family, tested on folds of the augmented sets.

    The balanced similar-word sets are tested on folds of the generated rows only, the
    perturbed sets on the original folds.
    """
    balanced = []
    for s in balanced_family(k):
        kind = s.gen.kind if s.gen else None
        test = {"similar": "generated", None: "original"}.get(kind, "augmented")
        balanced.append(replace(s, test=test))
    return (
        balanced
        + [replace(s, test="augmented") for s in imbalance_family()]
        + [replace(s, test="augmented") for s in antonym_family()]
        + perturbed_family()
        + [replace(s, test="augmented") for s in similar_family()]
    )


def svm_suite(k: int = 2) -> list[Spec]:
    own = [s for s in blankout_family((k,), (False,))]
    return (
        balanced_family(k)
        + imbalance_family()
        + blankout_family((k,))
        + on_own_folds(own)
        + antonym_family()
        + perturbed_family()
        + similar_family()
    )
