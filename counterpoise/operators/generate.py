"""The three generators: antonym/negation flip, similar words, blankout.

A generator is described by a ``Gen``.  ``generate`` runs any number of them over one corpus:

1. the lexicons become one small value, buckets of maps, that every task holds;
2. each token is looked up where it stands, so a row never leaves its place and needs no id;
3. each ``Gen`` becomes one array expression over the tokens.

Lexicons above a checked number of bytes are joined instead.  Their entries for the most frequent
words are still looked up inside the row; a bit map of the others tells which rare words may be
found; rows without one stay where they are, and of the others only those words are joined.
Of a large vocabulary only membership is asked: bit maps tell it exactly, and no row is moved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from counterpoise.functions.text import (
    content_key,
    flipped,
    is_negated,
    is_protected,
    label_of,
    order_key,
    stripped,
    tokens,
)
from counterpoise.operators.lookup import (
    WordSet,
    bitmap_value,
    fits_in_row,
    look_up,
    lookup_value,
    may_hold,
    most_frequent,
    text_bytes,
    word_set,
)
from counterpoise.session import spool

TWO_STAGE, SINGLE_PASS, ONE_WORD = "two_stage", "single_pass", "one_word"

# The six antonym cases as (mode, minority only, prefilter).
ANTONYM_CASES = {
    0: (TWO_STAGE, False, True),
    1: (TWO_STAGE, True, True),
    2: (SINGLE_PASS, False, False),
    3: (SINGLE_PASS, True, False),
    4: (ONE_WORD, False, False),
    5: (ONE_WORD, True, False),
}
# Entries of a joined lexicon that are looked up inside the row: most words are frequent ones.
HEAD_ROWS = 1 << 14
HEAD_ENTRY_BYTES = 256
# Case 0 tests the prefix on the lower-cased word, so upper-case NOT is never found.
LOWER_CASE_TESTS = 0


@dataclass(frozen=True)
class Gen:
    """One generator with its settings.

    kind      'antonym', 'similar' or 'blankout'
    case      antonym: 0..5; ``mode``/``minority``/``prefilter`` follow from it
    senti     antonym: swap only vocabulary words; blankout: never drop vocabulary words
    lexicon   similar: name of the lexicon
    words     similar: 'all' or 'one'
    k         blankout: number of words to drop
    protect   blankout: keep negations
    min_left  blankout: words that must remain
    minority  keep only rows whose resulting label is 1
    draw      blankout: number of the random draw
    draws     blankout: further draws that come along in the column ``drawn``
    """

    kind: str
    case: int = 4
    senti: bool = False
    lexicon: str = ""
    words: str = "all"
    k: int = 2
    protect: bool = True
    min_left: int = 3
    minority: bool = False
    prefilter: bool | None = None
    prefix_raw: bool = False
    flip: str = "name"
    draw: int = 0
    draws: int = 0


def antonym(case: int, senti: bool = False, **kw) -> Gen:
    mode, minority, prefilter = ANTONYM_CASES[case]
    kw.setdefault("prefilter", prefilter)
    return Gen("antonym", case=case, senti=senti, minority=minority, **kw)


def similar(lexicon: str, words: str = "all", minority: bool = False) -> Gen:
    return Gen("similar", lexicon=lexicon, words=words, minority=minority)


def blankout(k: int, senti: bool = False, minority: bool = False, **kw) -> Gen:
    return Gen("blankout", k=k, senti=senti, minority=minority, **kw)


@dataclass(frozen=True)
class Lexicons:
    """antonyms(word, repl), similar(name, word, repl), senti(word); any may be missing.

    max_bytes  lexicons of up to this size are looked up inside the row, larger ones are joined
    """

    antonyms: DataFrame | None = None
    similar: DataFrame | None = None
    senti: DataFrame | None = None
    max_bytes: int | None = None


# ---------------------------------------------------------------- token values


def strip_atom(g: Gen) -> str:
    return "strip_low" if g.case == LOWER_CASE_TESTS and not g.prefix_raw else (
        "strip_low_raw" if g.case == LOWER_CASE_TESTS else "strip_raw"
    )


def swap_atom(g: Gen) -> str:
    if g.senti:
        return "swap_senti"
    return "swap_low" if g.case == LOWER_CASE_TESTS else "swap_raw"


def _atoms(gens: Sequence[Gen]) -> list[str]:
    """Names of the per-token values the generators need, in a fixed order."""
    need: list[str] = []

    def add(*names: str) -> None:
        need.extend(n for n in names if n not in need)

    for g in gens:
        if g.kind == "antonym":
            add(strip_atom(g), swap_atom(g))
            if g.prefilter:
                add("negated", "swap_low")
        elif g.kind == "similar":
            add(f"similar_{g.lexicon}")
        elif g.kind == "blankout":
            if g.protect:
                add("protected")
            if g.senti:
                add("senti_raw")
        else:
            raise ValueError(f"unknown generator {g.kind!r}")
    return need


def _atom(name: str, w: Column, value) -> Column:
    """Value of one atom for a token; NULL means 'does not apply'.

    ``value`` gives the lexicon value of a name for the token.
    """
    if name == "strip_raw":
        return stripped(w)
    if name == "strip_low":
        return stripped(w, prefix=False, lower_suffix=True)
    if name == "strip_low_raw":
        return stripped(w, prefix=True, lower_suffix=True)
    if name == "negated":
        return F.when(is_negated(w), True)
    if name == "protected":
        return F.when(is_protected(w), True)
    if name == "swap_low":
        return value("l_antonym")
    if name == "swap_raw":
        # lexicon keys are lower case, so a raw hit is a hit on a word equal to its key
        return F.when(w == F.lower(w), value("l_antonym"))
    if name == "swap_senti":
        return F.when(value("l_senti"), value("l_antonym"))
    if name == "senti_raw":
        return value("l_senti_raw")
    if name == "lowered":
        return F.when(w != F.lower(w), F.lower(w))
    if name.startswith("similar_"):
        return value("l_" + name)
    raise ValueError(name)


def _word_table(gens: Sequence[Gen], lex: Lexicons) -> DataFrame | None:
    """All lower-case lookups as one table (lw, l_antonym, l_senti, l_similar_<name>...)."""
    parts: list[DataFrame] = []
    cols: list[str] = []

    def add(df: DataFrame, word: Column, value: Column, name: str) -> None:
        cols.append(name)
        parts.append(df.select(word.alias("lw"), F.lit(name).alias("what"), value.alias("v")))

    if any(g.kind == "antonym" for g in gens):
        add(lex.antonyms, F.col("word"), F.col("repl"), "l_antonym")
        if any(g.senti for g in gens if g.kind == "antonym"):
            add(lex.senti, F.col("word"), F.lit(""), "l_senti")
    for name in sorted({g.lexicon for g in gens if g.kind == "similar"}):
        one = lex.similar.filter(F.col("name") == name)
        add(one, F.col("word"), F.col("repl"), f"l_similar_{name}")
    if not parts:
        return None
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)

    def value(c: str) -> Column:
        v = F.max(F.when(F.col("what") == c, F.col("v")))
        return (F.when(v.isNotNull(), True) if c == "l_senti" else v).alias(c)

    return union.groupBy("lw").agg(*[value(c) for c in cols])


def with_tokens(
    df: DataFrame, gens: Sequence[Gen], lex: Lexicons, more: Sequence[str] = ()
) -> DataFrame:
    """Adds ``toks`` (pos, w, atoms...) and, per atom, how often and where it first occurs.

    ``more``: names of further atoms.
    """
    names = [*_atoms(gens), *more]
    table = _word_table(gens, lex)
    if table is None and "senti_raw" not in names:
        return df.withColumn("toks", _in_row_tokens(names, {}))

    tables: dict[str, DataFrame] = {}
    if table is not None:
        tables["lw"] = spool(table, "words")
    if "senti_raw" in names:
        words = lex.senti.select(F.col("word").alias("w"), F.lit(True).alias("l_senti_raw"))
        tables["w"] = spool(words.distinct(), "vocabulary")
    found, helpers = {}, {}
    if "w" in tables and not fits_in_row(tables["w"], lex.max_bytes):
        known = _vocabulary_set(df, tables["w"], lex.max_bytes)
        if known is not None:
            del tables["w"]
            helpers = known.values()
            entry = F.struct(F.lit(True).alias("l_senti_raw"))
            found["w"] = lambda w: F.when(known.holds(w), entry)
    if not all(fits_in_row(t, lex.max_bytes) for t in tables.values()):
        return _joined_tokens(df, names, tables, found, helpers)

    def find(key: str):
        return lambda w: look_up(F.col(f"_{key}_table"), _word(w, key))

    for key, t in tables.items():
        helpers[f"_{key}_table"] = lookup_value(t, key).scalar()
        found[key] = find(key)
    return _counted(df, names, found, helpers)


def _vocabulary_set(df: DataFrame, table: DataFrame, max_bytes: int | None) -> WordSet | None:
    """The vocabulary as a set that tells all words of ``df`` apart, so that no row is moved."""
    words = df.select(F.explode(_words("w")).alias("w")).distinct()
    held = table.select("w", F.lit(True).alias("held"))
    marked = words.join(held, "w", "left").select("w", F.coalesce("held", F.lit(False)).alias("held"))
    return word_set(spool(marked, "told"), "w", max_bytes)


def _counted(df: DataFrame, names: Sequence[str], find: dict, helpers: dict) -> DataFrame:
    rows = df.withColumns(helpers).withColumn("toks", _in_row_tokens(names, find)).drop(*helpers)
    hits = {n: _with_atom(n) for n in names}
    return rows.withColumns(
        {f"n_{n}": F.size(h) for n, h in hits.items()}
        | {f"at_{n}": F.get(h, F.lit(0))["pos"] for n, h in hits.items()}
    )


def _with_atom(name: str) -> Column:
    return F.filter("toks", lambda t: t[name].isNotNull())


def _in_row_tokens(names: Sequence[str], find: dict) -> Column:
    """``find`` gives the entry of a word by lexicon; a word is looked up once for all atoms."""

    def token(w: Column, i: Column, value) -> Column:
        atoms = [_atom(n, w, value).alias(n) for n in names]
        return F.struct(i.alias("pos"), w.alias("w"), *atoms)

    if not find:
        return F.transform(tokens("text"), lambda w, i: token(w, i, None))
    found = F.transform(
        tokens("text"), lambda w: F.struct(w.alias("word"), *[f(w).alias(key) for key, f in find.items()])
    )

    def with_entries(x: Column, i: Column) -> Column:
        return token(x["word"], i, lambda name: x["w" if name == "l_senti_raw" else "lw"][name])

    return F.transform(found, with_entries)


def _joined_tokens(
    df: DataFrame, names: Sequence[str], tables: dict, found_in_row: dict, helpers: dict
) -> DataFrame:
    """The same by joins, for tables that are too large for the row.

    The entries of the most frequent words are looked up inside the row like a small lexicon, so
    only rare words are joined, and only rows that hold one are moved.
    """
    columns = df.columns
    found = {key: _head_and_tail(df, t, key) for key, t in tables.items()}
    tried = df
    for key, (head, tail) in found.items():
        tried = _with_words_to_join(tried, head, tail, key)
    # rows that are equal share a key and the words found for it
    row = F.unhex(content_key(*columns)).alias("_row")
    tried = tried.select(*columns, row, *[f"_{key}_maybe" for key in tables])
    tried = spool(tried, "tokens")
    rare = F.lit(False)
    for key in tables:
        rare = rare | (F.size(f"_{key}_maybe") > 0)
    still, moved = tried.filter(~rare), tried.filter(rare)
    for key, (_, tail) in found.items():
        hits = _hits(tried, tail, key)
        kind = hits.schema[f"_{key}_hits"].dataType
        still = still.withColumn(f"_{key}_hits", F.lit(None).cast(kind))
        moved = moved.join(hits, "_row", "left")
    hit_names = [f"_{key}_hits" for key in tables]
    rows = still.select(*columns, *hit_names).unionByName(moved.select(*columns, *hit_names))
    values = {f"_{key}_table": lookup_value(head, key).scalar() for key, (head, _) in found.items()}

    def find(key: str):
        table, hits = F.col(f"_{key}_table"), F.col(f"_{key}_hits")
        return lambda w: F.coalesce(
            look_up(table, _word(w, key)), F.try_element_at(hits, _word(w, key))
        )

    every = found_in_row | {key: find(key) for key in tables}
    return _counted(rows, names, every, helpers | values).drop(*hit_names)


def _word(w: Column, key: str) -> Column:
    return w if key == "w" else F.lower(w)


def _words(key: str) -> Column:
    return tokens("text" if key == "w" else F.lower("text"))


def _head_and_tail(df: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The entries of ``table`` for the most frequent words of ``df``, and all others."""
    counts = df.select(F.explode(_words(key)).alias(key)).groupBy(key).agg(F.count("*").alias("_n"))
    short = table.filter(text_bytes(table) <= HEAD_ENTRY_BYTES).select(key)
    repeated = spool(counts.filter(F.col("_n") > 1).join(short, key, "left_semi"), "frequency")
    common = F.broadcast(most_frequent(repeated, key, HEAD_ROWS))
    return spool(table.join(common, key, "left_semi"), "head"), table.join(common, key, "left_anti")


def _with_words_to_join(df: DataFrame, head: DataFrame, tail: DataFrame, key: str) -> DataFrame:
    """Adds ``_<key>_maybe``: the words that are not in ``head`` and may be in ``tail``."""
    value, bits = bitmap_value(tail, key)
    held, bitmap = F.col("_held"), F.col("_bitmap")
    rare = F.filter(_words(key), lambda w: look_up(held, w).isNull() & may_hold(bitmap, bits, w))
    tried = df.withColumn("_held", lookup_value(head, key).scalar()).withColumn("_bitmap", value.scalar())
    maybe = F.coalesce(F.array_distinct(rare), F.array().cast("array<string>"))
    return tried.withColumn(f"_{key}_maybe", maybe).drop("_held", "_bitmap")


def _hits(tried: DataFrame, tail: DataFrame, key: str) -> DataFrame:
    """(_row, _<key>_hits): a map from rare words to their rows of ``tail``."""
    pairs = tried.select("_row", F.explode(f"_{key}_maybe").alias(key)).distinct()
    values = F.struct(*[c for c in tail.columns if c != key])
    entry = F.struct(F.col(key), values.alias("v"))
    hits = pairs.join(tail, key).groupBy("_row")
    return hits.agg(F.map_from_entries(F.collect_list(entry)).alias(f"_{key}_hits"))


# ---------------------------------------------------------------- rewriting


def _join_words(word_of) -> Column:
    """Text from ``toks`` with one expression per token, trimmed (so it may be empty)."""
    return F.btrim(F.array_join(F.transform("toks", word_of), " "))


def _replace_all(atom: str) -> Column:
    return _join_words(lambda t: F.coalesce(t[atom], t["w"]))


def _replace_first(atom: str) -> Column:
    at = F.col(f"at_{atom}")
    return _join_words(lambda t: F.when(t["pos"] == at, t[atom]).otherwise(t["w"]))


def _antonym_text(g: Gen) -> tuple[Column, Column, Column]:
    """(whether there is a text, the text, number of changed words), as of the other kinds."""
    strip, swap = strip_atom(g), swap_atom(g)
    n_strip, n_swap = F.col(f"n_{strip}"), F.col(f"n_{swap}")
    mode = ANTONYM_CASES[g.case][0]
    if mode == SINGLE_PASS:
        text = _join_words(lambda t: F.coalesce(t[strip], t[swap], t["w"]))
        changed = F.size(F.filter("toks", lambda t: F.coalesce(t[strip], t[swap]).isNotNull()))
        hit = (n_strip > 0) | (n_swap > 0)
    elif mode == TWO_STAGE:
        text = F.when(n_strip > 0, _replace_all(strip)).otherwise(_replace_all(swap))
        changed = F.when(n_strip > 0, n_strip).otherwise(n_swap)
        hit = (n_strip > 0) | (n_swap > 0)
    else:
        text = F.when(n_strip > 0, _replace_first(strip)).otherwise(_replace_first(swap))
        changed = F.lit(1)
        hit = (n_strip > 0) | (n_swap > 0)
    if g.prefilter:
        hit = hit & prefilter_keeps(F.col("n_negated"), F.col("n_swap_low"))
    return hit, text, changed


def prefilter_keeps(negations: Column, antonyms: Column) -> Column:
    """True for rows with at most one change in total, so that the flip is unambiguous."""
    return negations + antonyms <= 1


def _similar_text(g: Gen) -> tuple[Column, Column, Column]:
    atom = f"similar_{g.lexicon}"
    n, at = F.col(f"n_{atom}"), F.col(f"at_{atom}")
    if g.words == "one":
        text = _join_words(
            lambda t: F.when(t["pos"] == at, t[atom]).otherwise(F.lower(t["w"]))
        )
        return n > 0, text, F.lit(1)
    return n > 0, _join_words(lambda t: F.coalesce(t[atom], F.lower(t["w"]))), n


def _eligible_name(g: Gen) -> str:
    return f"el_{int(g.protect)}{int(g.senti)}_{g.draw}"


def _may_drop(g: Gen):
    def may_drop(t: Column) -> Column:
        ok = F.lit(True)
        if g.protect:
            ok = ok & t["protected"].isNull()
        if g.senti:
            ok = ok & t["senti_raw"].isNull()
        return ok

    return may_drop


def _eligible(g: Gen, seed: str) -> Column:
    """Positions that may be dropped, in a random but repeatable order."""
    salt = seed if g.draw == 0 else f"{seed}/{g.draw}"
    return F.sort_array(
        F.transform(
            F.filter("toks", _may_drop(g)),
            lambda t: F.struct(order_key(salt, F.col("id"), t["pos"]).alias("h"), t["pos"]),
        )
    )


def _dropped_name(g: Gen) -> str:
    return f"{_eligible_name(g)}_{g.k}"


def _with_dropped(rows: DataFrame, gens: Sequence[Gen], seed: str, texts: bool) -> DataFrame:
    """Adds the dropped positions of every blankout and draw, for the rows that need them: as columns,
    since within an expression over the words they would be looked for again at each word."""
    blankouts = [g for g in gens if g.kind == "blankout"]
    orders: dict[str, Column] = {}
    needed: dict[str, Column] = {}
    for g in blankouts:
        for d in _draws(g) if texts else [g]:
            need = F.lit(True) if texts and d.draw == g.draw else _is_minority(g)
            if not texts:
                need = ~_outnumber(F.lit(g.k))
            name = _eligible_name(d)
            orders[name] = _eligible(d, seed)
            needed[name] = needed[name] | need if name in needed else need
    if not orders:
        return rows
    rows = rows.withColumns({name: F.when(needed[name], order) for name, order in orders.items()})
    return rows.withColumns({
        _dropped_name(d): F.transform(F.slice(_eligible_name(d), 1, d.k), lambda s: s["pos"])
        for g in blankouts for d in (_draws(g) if texts else [g])
    })


def _is_minority(g: Gen) -> Column:
    return label_of(new_sentiment(g)) == 1


def _blankout_text(g: Gen) -> tuple[Column, Column, Column]:
    dropped = F.col(_dropped_name(g))
    kept = F.filter("toks", lambda t: ~F.array_contains(dropped, t["pos"]))
    text = F.btrim(F.array_join(F.transform(kept, lambda t: t["w"]), " "))
    long_enough = F.size("toks") - g.k >= g.min_left
    # needs no order
    hit = long_enough & F.exists("toks", _may_drop(g)) if g.k > 0 else F.lit(False)
    return hit, text, F.size(dropped)


def _draws(g: Gen) -> list[Gen]:
    return [replace(g, draw=g.draw + i) for i in range(g.draws + 1)] if g.kind == "blankout" else [g]


def _drawn(g: Gen) -> Column:
    """Texts of the further draws, each the first text if it would be empty.  Only rows of label 1
    have them: no others are repeated."""
    texts = [_blankout_text(d)[1] for d in _draws(g)]
    more = [F.coalesce(F.nullif(t, F.lit("")), texts[0]) for t in texts[1:]]
    return F.when(_is_minority(g), F.array(*more)) if more else F.array().cast("array<string>")


def _has_text(g: Gen, text: Column, changed: Column) -> Column:
    """``text``, but some other text where it is certainly not empty: where words that are not
    empty outnumber the changed ones, one of them stays."""
    most = F.lit(g.k) if g.kind == "blankout" else changed
    return F.when(_outnumber(most), F.lit("+")).otherwise(text)


def _outnumber(most: Column) -> Column:
    return F.size(F.filter("toks", lambda t: t["w"] != "")) > most


def new_sentiment(g: Gen) -> Column:
    s = F.col("sentiment")
    if g.kind == "antonym":
        if g.flip == "digit":
            return F.when(F.btrim(s) == "1", F.lit("0")).otherwise(F.lit("1"))
        return flipped(s)
    if g.kind == "similar" and g.flip == "name":
        return F.lower(s)
    return F.btrim(s) if g.kind == "blankout" and g.flip == "digit" else s


def source_filter(g: Gen) -> Column:
    """Rows that can contribute, decidable before any token work."""
    if not g.minority:
        return F.lit(True)
    if g.flip == "digit":
        return new_sentiment(g) == "1"
    return label_of(new_sentiment(g)) == 1


def generate(
    corpus: DataFrame,
    gens: Sequence[Gen],
    lex: Lexicons = Lexicons(),
    seed: str = "blank",
    observation: Observation | None = None,
    keep_empty: bool = False,
    texts: bool = True,
) -> DataFrame:
    """Pseudo-instances of ``corpus(id, sentiment, text, ...)``.

    Result: src_id, gen (index into ``gens``), method, sentiment, text, n_changed, and any
    further columns of the corpus; ``drawn`` if a generator asks for further draws.  A generator
    yields at most one row per source row.

    Rewritten texts that are empty are left out.  ``observation`` gets their number per generator
    (``dropped_empty_<gen>``), counted in the same pass; with ``keep_empty`` they come along, with
    true in the column ``dropped``.  Without ``texts`` the same rows come without text, n_changed and
    drawn, and texts are made only where they may be empty.
    """
    wanted = F.lit(False)
    for g in gens:
        wanted = wanted | source_filter(g)
    rows = with_tokens(corpus.filter(wanted), gens, lex)
    drawn = texts and any(g.draws for g in gens)
    rows = _with_dropped(rows, gens, seed, texts)

    makers = {"antonym": _antonym_text, "similar": _similar_text, "blankout": _blankout_text}
    results = []
    for i, g in enumerate(gens):
        hit, text, changed = makers[g.kind](g)
        if not texts:
            text = _has_text(g, text, changed)
        results.append(
            F.struct(
                F.lit(i).alias("gen"),
                F.lit(g.kind).alias("method"),
                new_sentiment(g).alias("sentiment"),
                F.when(source_filter(g) & hit, text).alias("text"),
                *([changed.cast("int").alias("n_changed")] if texts else []),
                *([F.when(hit, _drawn(g)).alias("drawn")] if drawn else []),
            )
        )
    others = [c for c in corpus.columns if c not in ("id", "sentiment", "text")]
    made = rows.select(
        F.col("id").alias("src_id"), *others, F.explode(F.array(*results)).alias("r")
    )
    made = made.select("src_id", *others, "r.*").filter(F.col("text").isNotNull())
    if observation is not None:
        empty = F.col("text") == ""
        counts = [
            F.count_if(empty & (F.col("gen") == i)).alias(f"dropped_empty_{i}") for i in range(len(gens))
        ]
        made = made.observe(observation, *counts)
    if keep_empty:
        return made.withColumn("dropped", F.col("text") == "")
    made = made.filter(F.col("text") != "")
    return made if texts else made.drop("text")


def count_dropped_empty(
    corpus: DataFrame, gens: Sequence[Gen], lex: Lexicons = Lexicons()
) -> DataFrame:
    """(gen, dropped_empty): per generator, how many rewritten texts were empty."""
    made = generate(corpus, gens, lex, keep_empty=True)
    counted = made.groupBy("gen").agg(F.count_if("dropped").alias("dropped_empty"))
    every = corpus.sparkSession.range(len(gens)).select(F.col("id").cast("int").alias("gen"))
    return every.join(counted, "gen", "left").fillna(0, ["dropped_empty"])


def antonym_prefilter(corpus: DataFrame, antonyms: DataFrame) -> DataFrame:
    """Rows with at most one negation or lexicon word, unchanged, with both counts."""
    probe = antonym(0)
    rows = with_tokens(corpus, [probe], Lexicons(antonyms=antonyms))
    return rows.filter(prefilter_keeps(F.col("n_negated"), F.col("n_swap_low"))).select(
        "id",
        "sentiment",
        "text",
        F.col("n_negated").alias("n_negations"),
        F.col("n_swap_low").alias("n_antonyms"),
    )


def lexicon_coverage(corpus: DataFrame, antonyms: DataFrame) -> DataFrame:
    """How many negations and lexicon words each row has, as counts of rows per combination."""
    rows = with_tokens(corpus, [antonym(0)], Lexicons(antonyms=antonyms))
    return rows.groupBy(
        F.col("n_negated").cast("long").alias("n_negations"),
        F.col("n_swap_low").cast("long").alias("n_antonyms"),
    ).agg(F.count("*").alias("n_rows"))


def lexicon_hits(corpus: DataFrame, lexicon: DataFrame) -> DataFrame:
    """How often each lexicon word occurs: (name, word, repl, n_hits)."""
    words = corpus.select(F.explode(tokens(F.lower("text"))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n_hits"))
    return counted.join(lexicon, "word").select("name", "word", "repl", "n_hits")
