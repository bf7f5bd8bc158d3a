"""The registered queries once more, as SQL for a second engine.

Written in relational form (one row per token, windows, joins) and independent of the Spark
plans, which work on arrays.  Scenario specifications are shared data; fixed values stand here
once more, so that a wrong one in the library shows.
"""

from __future__ import annotations

from collections.abc import Sequence

from counterpoise.operators.generate import Gen, antonym, blankout, similar
from counterpoise.plans.specs import Spec, imbalance_family, similar_family
from workload import fixtures as X
from workload.queries import (
    ANTONYM_NAMES,
    REDRAWN,
    REDRAWN_SUITE,
    SETS,
    SIMILAR_NAMES,
    SUITES,
    THIRD_SET,
    TIED_SETS,
)

ORACLES: dict[str, str] = {}

# Fixed values.
ANTONYM_MODES = {
    0: "two_stage",
    1: "two_stage",
    2: "single_pass",
    3: "single_pass",
    4: "one_word",
    5: "one_word",
}
PROTECTED = ["dont", "havent", "cant", "cannot", "arent", "aint"]
PLAIN_CAP = 10
LEXICONS = ("news", "tweets", "news_senti", "tweets_senti")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: Sequence[tuple]) -> str:
    def lit(v) -> str:
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def corpus_sql(sentiment: str) -> str:
    return rf"""
corpus AS (
  SELECT doc_id * 2147483648 + nth AS id, sentiment, text
  FROM (
    SELECT doc_id, nth, sentiment,
           trim(regexp_replace(replace(replace(replace(t, ',', ' '), ' it ', ' NOT_'),
                               ' are ', ' arenot '), '[ \t\r\n]+', ' ', 'g')) AS text
    FROM (SELECT doc_id, sentiment, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS nth
          FROM (SELECT doc_id, {sentiment} AS sentiment,
                       regexp_split_to_array(text, '[.\n]') AS parts
                FROM documents JOIN labels USING (doc_id))))
  WHERE text <> ''
)"""


CORPUS = corpus_sql("CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END")
THIRD_CORPUS = corpus_sql(
    "CASE WHEN toxic = 1 THEN 'neutral' WHEN quality = 1 THEN 'positive' ELSE 'negative' END"
)
TOK = """
tok AS (
  SELECT id, sentiment, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT id, sentiment, string_split(text, ' ') AS ws FROM corpus)
)"""
WORDS = f"""
ant AS (SELECT * FROM {values(X.ANTONYMS)} t(word, repl)),
sim AS (SELECT * FROM {values(X.SIMILARS)} t(name, word, repl)),
senti AS (SELECT * FROM {values([(w,) for w in X.SENTI])} t(word))"""
LABEL = "CASE WHEN sentiment = 'positive' THEN 0 ELSE 1 END"
FOLD = "CAST(('0x' || substr(md5('fold:' || {0}), 1, 8))::BIGINT % 10 AS INTEGER)"
TRAIN_FOLD, TEST_FOLD = FOLD.replace("fold:", "train:"), FOLD.replace("fold:", "test:")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# ---------------------------------------------------------------- generators


def antonym_sql(g: Gen) -> str:
    mode = ANTONYM_MODES[g.case]
    cut = "left(w, length(w) - 3)"
    if g.case == 0:
        strip = f"CASE WHEN ends_with(lower(w), 'not') THEN {cut} END"
    else:
        strip = (
            "CASE WHEN starts_with(w, 'NOT') THEN replace(w, 'NOT', '') "
            f"WHEN ends_with(w, 'not') THEN {cut} END"
        )
    if g.senti:
        swap = "CASE WHEN lower(w) IN (SELECT word FROM senti) THEN low.repl END"
    else:
        swap = "low.repl" if g.case == 0 else "raw.repl"
    new = {
        "single_pass": "coalesce(strip, swap, w)",
        "two_stage": "CASE WHEN n_strip > 0 THEN coalesce(strip, w) ELSE coalesce(swap, w) END",
        "one_word": "CASE WHEN n_strip > 0 THEN CASE WHEN pos = at_strip THEN strip ELSE w END "
        "WHEN pos = at_swap THEN swap ELSE w END",
    }[mode]
    changed = {
        "single_pass": "count(coalesce(strip, swap))",
        "two_stage": "CASE WHEN any_value(n_strip) > 0 THEN any_value(n_strip) "
        "ELSE any_value(n_swap) END",
        "one_word": "1",
    }[mode]
    if g.flip == "digit":
        status = "CASE WHEN trim(sentiment) = '1' THEN '0' ELSE '1' END"
        minority = f"{status} = '1'"
    else:
        status = "CASE WHEN sentiment = 'positive' THEN 'negative' ELSE 'positive' END"
        minority = f"{status} = 'negative'"
    having = ["any_value(n_strip) + any_value(n_swap) > 0"]
    if g.prefilter:
        having.append(
            "NOT ((any_value(n_ant) >= 1 AND any_value(n_neg) >= 1) "
            "OR any_value(n_neg) >= 2 OR any_value(n_ant) >= 2)"
        )
    if g.minority:
        having.append(minority)
    return f"""
SELECT * FROM (
  SELECT id AS src_id, 'antonym' AS method, {status} AS sentiment,
         trim(string_agg({new}, ' ' ORDER BY pos)) AS text,
         CAST({changed} AS INTEGER) AS n_changed
  FROM (
    SELECT *, count(strip) OVER r AS n_strip, count(swap) OVER r AS n_swap,
           min(CASE WHEN strip IS NOT NULL THEN pos END) OVER r AS at_strip,
           min(CASE WHEN swap IS NOT NULL THEN pos END) OVER r AS at_swap,
           count(*) FILTER (starts_with(lower(w), 'not') OR ends_with(lower(w), 'not'))
             OVER r AS n_neg,
           count(lowrepl) OVER r AS n_ant
    FROM (SELECT tok.*, {strip} AS strip, {swap} AS swap, low.repl AS lowrepl
          FROM tok LEFT JOIN ant raw ON tok.w = raw.word
               LEFT JOIN ant low ON lower(tok.w) = low.word)
    WINDOW r AS (PARTITION BY id))
  GROUP BY id, sentiment
  HAVING {" AND ".join(having)})
WHERE text <> ''"""


def similar_sql(g: Gen) -> str:
    new = "coalesce(repl, w)"
    changed = "count(repl)"
    if g.words == "one":
        new, changed = "CASE WHEN pos = hit THEN repl ELSE w END", "1"
    status = "sentiment" if g.flip != "name" else "lower(sentiment)"
    scope = "AND lower(sentiment) <> 'positive'" if g.minority else ""
    return f"""
SELECT * FROM (
  SELECT id AS src_id, 'similar' AS method, {status} AS sentiment,
         trim(string_agg({new}, ' ' ORDER BY pos)) AS text, CAST({changed} AS INTEGER) AS n_changed
  FROM (
    SELECT id, sentiment, pos, lower(w) AS w, repl,
           min(CASE WHEN repl IS NOT NULL THEN pos END) OVER (PARTITION BY id) AS hit
    FROM tok LEFT JOIN (SELECT * FROM sim WHERE name = {q(g.lexicon)}) s ON lower(w) = s.word)
  WHERE hit IS NOT NULL {scope}
  GROUP BY id, sentiment)
WHERE text <> ''"""


def blankout_sql(g: Gen) -> str:
    ok = []
    if g.protect:
        ok.append("NOT (starts_with(w, 'NOT') OR starts_with(w, 'not') OR ends_with(w, 'not'))")
        ok.append("w NOT IN (" + ", ".join(q(p) for p in PROTECTED) + ")")
    if g.senti:
        ok.append("w NOT IN (SELECT word FROM senti)")
    status = "trim(sentiment)" if g.flip == "digit" else "sentiment"
    scope = "AND sentiment <> 'positive'" if g.minority else ""
    salt = f"blank/{g.draw}" if g.draw else "blank"
    return f"""
SELECT * FROM (
  SELECT id AS src_id, 'blankout' AS method, {status} AS sentiment,
         trim(string_agg(w, ' ' ORDER BY pos) FILTER (NOT dropped)) AS text,
         CAST(count(*) FILTER (dropped) AS INTEGER) AS n_changed
  FROM (
    SELECT *, count(*) OVER (PARTITION BY id) AS n_words,
           ok AND row_number() OVER (PARTITION BY id, ok ORDER BY h) <= {g.k} AS dropped
    FROM (SELECT *, {" AND ".join(ok) or "TRUE"} AS ok, md5('{salt}:' || id || ':' || pos) AS h
          FROM tok))
  WHERE n_words - {g.k} >= {g.min_left} {scope}
  GROUP BY id, sentiment
  HAVING count(*) FILTER (dropped) > 0)
WHERE text <> ''"""


def gen_sql(g: Gen) -> str:
    return {"antonym": antonym_sql, "similar": similar_sql, "blankout": blankout_sql}[g.kind](g)


GEN_BASE = (CORPUS, TOK, WORDS)


def made_sql(g: Gen) -> str:
    return with_(*GEN_BASE) + gen_sql(g)


for _name, _case in ANTONYM_NAMES.items():
    ORACLES[f"antonym_{_name}"] = made_sql(antonym(_case))
    ORACLES[f"antonym_{_name}_senti"] = made_sql(antonym(_case, senti=True))
for _name, (_words, _minority) in SIMILAR_NAMES.items():
    ORACLES[f"similar_{_name}"] = made_sql(similar("news", _words, _minority))
ORACLES["blankout"] = made_sql(blankout(X.K))
ORACLES["blankout_senti"] = made_sql(blankout(X.K, senti=True))

for _name, _gen in (
    ("antonym", antonym(4)), ("similar", similar("news")), ("blankout", blankout(1, protect=False))
):
    ORACLES[f"{_name}_export"] = with_(*GEN_BASE) + (
        f"SELECT src_id || ',' || sentiment || ',' || text AS value FROM ({gen_sql(_gen)})"
    )

# every two neighbouring words as a lexicon line, the last line of a word wins
DERIVED = """
derived AS (
  SELECT word, repl FROM (
    SELECT lower(w) AS word, lower(after) AS repl,
           row_number() OVER (PARTITION BY lower(w) ORDER BY id DESC, pos DESC) AS rn
    FROM (SELECT *, lead(w) OVER (PARTITION BY id ORDER BY pos) AS after FROM tok)
    WHERE after IS NOT NULL)
  WHERE rn = 1)"""
LARGE_BASE = (
    CORPUS, TOK, DERIVED, "ant AS (SELECT * FROM derived)",
    "sim AS (SELECT 'news' AS name, * FROM derived)",
)
for _path in ("large", "joined"):
    ORACLES[f"antonym_all_both_{_path}_lexicon"] = with_(*LARGE_BASE) + gen_sql(antonym(2))
    ORACLES[f"similar_all_both_{_path}_lexicon"] = with_(*LARGE_BASE) + gen_sql(similar("news"))
_BARE = (
    CORPUS.replace("corpus AS", "whole AS", 1),
    "corpus AS (SELECT id, sentiment, CASE WHEN id % 3 = 0 THEN 'NOT' ELSE text END AS text FROM whole)",
    TOK, WORDS,
)
ORACLES["antonym_with_dropped"] = with_(*_BARE) + (
    "SELECT *, text = '' AS dropped FROM ("
    + antonym_sql(antonym(2)).replace("WHERE text <> ''", "WHERE text IS NOT NULL") + ")"
)
ORACLES["blankout_sweep"] = with_(*GEN_BASE) + "\nUNION ALL\n".join(
    f"SELECT *, {k} AS k FROM ({gen_sql(blankout(k))})" for k in range(2, 6)
)
_TSV = "SELECT src_id, sentiment, text, n_changed FROM ("
ORACLES["antonym_tsv"] = (
    with_(*GEN_BASE) + _TSV + gen_sql(Gen("antonym", case=1, prefilter=False)) + ")"
)
_MADE_FROM = "JOIN corpus c ON c.id = m.src_id"
ORACLES["antonym_tsv_repeated_ids"] = (
    with_(*GEN_BASE) + "SELECT c.sentiment AS c0, m.sentiment, m.text, m.n_changed FROM ("
    + gen_sql(Gen("antonym", case=1, prefilter=False)) + f") m {_MADE_FROM}"
)
ORACLES["similar_tsv"] = with_(*GEN_BASE) + _TSV + gen_sql(similar("news")) + ")"


def five_sql(g: Gen, c0="CAST(m.src_id AS VARCHAR)", c1="c.sentiment") -> str:
    """Label digits instead of class names; c0..c2 come from the source row."""
    g = Gen(**{**g.__dict__, "flip": "digit"})
    digits = "digits AS (SELECT id, CASE WHEN sentiment = 'positive' THEN '0' ELSE '1' END"
    tok = TOK.replace("FROM corpus", "FROM digits")
    digits += " AS sentiment, text FROM corpus)"
    return (
        with_(CORPUS, digits, tok, WORDS)
        + f"""SELECT {c0} AS c0, {c1} AS c1, 'Q' AS c2, m.text,
       m.sentiment AS label
FROM ({gen_sql(g)}) m JOIN corpus c ON c.id = m.src_id"""
    )


ORACLES["antonym_five_col"] = five_sql(antonym(4))
ORACLES["similar_five_col"] = five_sql(similar("news"))
ORACLES["similar_five_col_repeated_ids"] = five_sql(
    similar("news"), "c.sentiment", "CAST(m.src_id AS VARCHAR)"
)
ORACLES["blankout_five_col"] = five_sql(blankout(1, protect=False))

# ---------------------------------------------------------------- sources, projections

C = with_(CORPUS)
CT = with_(CORPUS, TOK)
ORACLES["corpus_scan"] = C + "SELECT id, sentiment, split_part(text, ',', 1) AS text FROM corpus"
ORACLES["corpus_scan_tagged"] = C + """
SELECT CASE WHEN id % 7 <> 0 THEN id END AS id, CASE WHEN id % 7 <> 0 THEN sentiment END AS sentiment,
       CASE WHEN id % 7 <> 0 THEN text END AS text,
       CASE WHEN id % 7 = 0 THEN id || ',' || sentiment END AS _corrupt_record
FROM corpus"""
for _name in ("antonyms", "derived"):
    ORACLES["lexicon_antonym" if _name == "antonyms" else "lexicon_similar"] = (
        with_(CORPUS, TOK, DERIVED) + f"SELECT {q(_name)} AS name, word, repl FROM derived"
    )
VOCABULARY = """
SELECT DISTINCT term AS word FROM (
  SELECT term, tag, sum(score / rank) AS total
  FROM (SELECT term, tag, rank, arg_max(score, id) AS score
        FROM (SELECT id, replace(lower(w), '#', '') AS term, id % 2 AS tag, pos + 1 AS rank,
                     (id % 5) / 8.0 - ((id // 5) % 3) / 8.0 AS score FROM tok)
        GROUP BY term, tag, rank)
  GROUP BY term, tag)
WHERE round(total, 9) <> 0"""
ORACLES["senti_vocab"] = CT + VOCABULARY
ORACLES["blankout_senti_vocab"] = with_(
    CORPUS, TOK, f"senti AS MATERIALIZED ({VOCABULARY})"
) + gen_sql(blankout(X.K, senti=True))
ORACLES["label_encode"] = C + f"SELECT id, CAST({LABEL} AS DOUBLE) AS label FROM corpus"
ORACLES["class_split"] = C + "SELECT * FROM corpus WHERE sentiment = 'negative'"
ORACLES["tokenize"] = CT + "SELECT id, CAST(pos AS INTEGER) AS pos, w AS term FROM tok"
SAMPLED = "(sentiment = 'positive' OR substr(md5('sample:' || id), 1, 8) < '33333333')"
ORACLES["prepare_asis"] = C + "SELECT * FROM corpus"
ORACLES["prepare_sampled_minority"] = C + f"SELECT * FROM corpus WHERE {SAMPLED}"
ORACLES["prepare_capped"] = C + f"""
SELECT id, sentiment, text
FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY md5('cap:' || id)) AS rn
      FROM corpus)
WHERE CASE WHEN sentiment = 'positive' THEN rn <= 5000 ELSE {SAMPLED} END"""
ORACLES["class_counts"] = C + f"SELECT {LABEL} AS label, count(*) AS n FROM corpus GROUP BY 1"
ORACLES["train_set_imbalanced"] = CT + f"""
SELECT id, {LABEL} AS label, w AS term, count(*) AS tf FROM tok WHERE {SAMPLED} GROUP BY 1, 2, 3"""
ORACLES["lexicon_hits"] = with_(*GEN_BASE) + """
SELECT name, word, repl, count(*) AS n_hits FROM tok JOIN sim ON lower(w) = word GROUP BY 1, 2, 3"""
_PER_ROW = """
SELECT id, any_value(sentiment) AS sentiment, string_agg(w, ' ' ORDER BY pos) AS text,
       count(*) FILTER (starts_with(lower(w), 'not') OR ends_with(lower(w), 'not')) AS n_negations,
       count(repl) AS n_antonyms
FROM tok LEFT JOIN ant ON lower(w) = word GROUP BY id"""
ORACLES["lexicon_coverage"] = with_(*GEN_BASE) + f"""
SELECT n_negations, n_antonyms, count(*) AS n_rows FROM ({_PER_ROW}) GROUP BY 1, 2"""
ORACLES["antonym_prefilter"] = with_(*GEN_BASE) + f"""
SELECT * FROM ({_PER_ROW})
WHERE NOT ((n_antonyms >= 1 AND n_negations >= 1) OR n_negations >= 2 OR n_antonyms >= 2)"""

# ---------------------------------------------------------------- sampling

_ORDERED = f"""
SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, id) AS rn,
       count(*) FILTER (label = 0) OVER () AS n0, count(*) FILTER (label = 1) OVER () AS n1
FROM (SELECT *, {LABEL} AS label, md5('order:' || id) AS o FROM corpus)"""
ORACLES["undersample"] = C + f"""
SELECT id, sentiment, text FROM ({_ORDERED}) WHERE label = 1 OR rn <= n1"""
ORACLES["oversample"] = C + f"""
SELECT id, sentiment, text, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy
FROM (SELECT *, CASE WHEN label = 0 THEN 1
                     ELSE least({PLAIN_CAP}, n0 // n1 + CASE WHEN rn <= n0 % n1 THEN 1 ELSE 0 END)
                END AS n
      FROM ({_ORDERED}))"""
ORACLES["sample_exact_n"] = C + f"""
SELECT id, sentiment, text FROM
  (SELECT *, row_number() OVER (ORDER BY md5('order:' || id), id) AS rn FROM corpus)
WHERE rn <= {X.SAMPLE_N}"""
_BY_DOCUMENT = "documents_as_ids AS (SELECT id // 2147483648 AS id, sentiment, text FROM corpus)"
_TIED = with_(CORPUS, _BY_DOCUMENT)
_CONTENT = "md5(concat_ws(chr(1), CAST(id AS VARCHAR), sentiment, text))"
ORACLES["sample_exact_n_repeated_ids"] = _TIED + f"""
SELECT id, sentiment, text FROM
  (SELECT *, row_number() OVER (ORDER BY md5('order:' || id), {_CONTENT}) AS rn
   FROM documents_as_ids)
WHERE rn <= {X.SAMPLE_N}"""
ORACLES["undersample_repeated_ids"] = _TIED + f"""
SELECT id, sentiment, text FROM (
  SELECT *, count(*) FILTER (label = 1) OVER () AS n1,
         row_number() OVER (PARTITION BY label ORDER BY md5('order:' || id), {_CONTENT}) AS rn
  FROM (SELECT *, {LABEL} AS label FROM documents_as_ids))
WHERE label = 1 OR rn <= n1"""
ORACLES["oversample_repeated_ids"] = _TIED + f"""
SELECT id, sentiment, text, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy
FROM (SELECT *, CASE WHEN label = 0 THEN 1
                     ELSE least({PLAIN_CAP}, n0 // n1 + CASE WHEN rn <= n0 % n1 THEN 1 ELSE 0 END)
                END AS n
      FROM (SELECT *, count(*) FILTER (label = 0) OVER () AS n0,
                   count(*) FILTER (label = 1) OVER () AS n1,
                   row_number() OVER (PARTITION BY label
                                      ORDER BY md5('order:' || id), {_CONTENT}) AS rn
            FROM (SELECT *, {LABEL} AS label FROM documents_as_ids)))"""
ORACLES["sample_fraction"] = C + f"""
SELECT * FROM corpus
WHERE ('0x' || substr(md5('sample:' || id), 1, 8))::BIGINT < round({X.SAMPLE_SHARE} * 4294967296)"""
ORACLES["kfold_assign"] = C + f"SELECT id, {FOLD.format('id')} AS fold FROM corpus"

# ---------------------------------------------------------------- training sets


def set_ctes(
    specs: Sequence[Spec], base: Sequence[str] = GEN_BASE, sampled: str = SAMPLED,
    ident: str = "src_id",
) -> list[str]:
    """weighted(s, src_id, gen, method, label, text, w, test): all members with their copies.

    ``ident``: the id that the order goes by, which rows may share.
    """
    gens: list[Gen] = []
    for s in specs:
        if s.gen and _scopeless(s.gen) not in gens:
            gens.append(_scopeless(s.gen))
    spec_rows = [
        (
            i, s.scenario, gens.index(_scopeless(s.gen)) if s.gen else -2,
            bool(s.gen and s.gen.minority), s.base == "full", s.fraction,
            s.rebalance or "", s.cap, s.perturb, s.test,
        )
        for i, s in enumerate(specs)
    ]
    names = "s, scenario, g, minority, whole, fraction, rebalance, cap, perturb, test"
    made = "".join(
        f"\nUNION ALL SELECT {i} AS gen, src_id, method, {LABEL} AS label, text FROM ({gen_sql(g)})"
        for i, g in enumerate(gens)
    )
    return [
        *base,
        f"\nspecs AS (SELECT * FROM {values(spec_rows)} t({names}))",
        f"\nmade AS MATERIALIZED (SELECT -1 AS gen, id AS src_id, 'original' AS method, "
        f"{LABEL} AS label, text FROM corpus{made})",
        f"""
variants AS MATERIALIZED (
  SELECT made.*, {sampled} AS in_sample, md5('order:' || {ident} || ':' || method) AS o,
         md5(concat_ws(chr(1), CAST(label AS VARCHAR), text)) AS tie
  FROM made JOIN (SELECT id, sentiment FROM corpus) c ON c.id = made.src_id)""",
        """
members AS (
  SELECT specs.*, variants.* FROM specs JOIN variants ON gen = -1 OR gen = g
  WHERE (whole OR in_sample) AND (gen = -1 OR NOT minority OR label = 1))""",
        """
taken AS (
  SELECT * EXCLUDE (nth, n_made) FROM (
    SELECT *, row_number() OVER (PARTITION BY s, gen = -1 ORDER BY o, tie) AS nth,
           count(*) OVER (PARTITION BY s, gen = -1) AS n_made FROM members)
  WHERE gen = -1 OR fraction >= 1 OR nth <= floor(n_made * fraction))""",
        """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s, label ORDER BY o, tie) AS rn,
         row_number() OVER (PARTITION BY s, label, gen = -1 ORDER BY o, tie) AS rg,
         count(*) FILTER (label = 0) OVER (PARTITION BY s) AS n0,
         count(*) FILTER (label = 1) OVER (PARTITION BY s) AS n1,
         count(*) FILTER (label = 0 AND gen = -1) OVER (PARTITION BY s) AS o0
  FROM taken)""",
        """
weighted AS (
  SELECT s, scenario, src_id, gen, method, label, text, test,
         CASE WHEN perturb THEN CASE WHEN label = 1 OR rg <= o0 // 2 THEN 1 ELSE 0 END
              WHEN rebalance = 'under' THEN CASE WHEN label = 1 OR rn <= n1 THEN 1 ELSE 0 END
              WHEN rebalance = 'over' AND label = 1
                THEN least(cap, n0 // n1 + CASE WHEN rn <= n0 % n1 THEN 1 ELSE 0 END)
              ELSE 1 END AS w
  FROM ranked)""",
    ]


def _scopeless(g: Gen) -> Gen:
    return g if g.kind == "antonym" else Gen(**{**g.__dict__, "minority": False})


for _name, _specs in SETS.items():
    _scenario = "scenario, " if len(_specs) > 1 else ""
    ORACLES[_name] = with_(*set_ctes(_specs)) + f"""
SELECT {_scenario}src_id, method, CAST(unnest(generate_series(1, w)) AS INTEGER) AS copy,
       label, text
FROM weighted WHERE w > 0"""

_DOCUMENT = "src_id // 2147483648"
for _name, _specs in TIED_SETS.items():
    _by_id = set_ctes(_specs, sampled=SAMPLED.replace("|| id)", "|| id // 2147483648)"), ident=_DOCUMENT)
    ORACLES[_name] = with_(*_by_id) + f"""
SELECT scenario, {_DOCUMENT} AS src_id, method,
       CAST(unnest(generate_series(1, w)) AS INTEGER) AS copy, label, text
FROM weighted WHERE w > 0"""

THIRD_BASE = (THIRD_CORPUS, TOK, WORDS)
ORACLES["prepare_third_class"] = with_(THIRD_CORPUS) + "SELECT * FROM corpus"
ORACLES["set_third_class"] = with_(*set_ctes([THIRD_SET], THIRD_BASE, "TRUE")) + """
SELECT src_id, method, CAST(unnest(generate_series(1, w)) AS INTEGER) AS copy, label, text
FROM weighted WHERE w > 0"""

_DRAWS = "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS copy, src_id, text FROM ("
    + gen_sql(blankout(X.K, draw=i)) + ")" for i in range(REDRAWN.cap)
)
ORACLES["set_blankout_both_over_redraw"] = with_(*set_ctes([REDRAWN]), f"draws AS ({_DRAWS})") + """
SELECT e.src_id, method, e.copy, label, coalesce(d.text, e.text) AS text
FROM (SELECT src_id, method, CAST(unnest(generate_series(1, w)) AS INTEGER) AS copy, label, text
      FROM weighted WHERE w > 0) e
LEFT JOIN draws d ON method = 'blankout' AND e.src_id = d.src_id AND e.copy = d.copy"""

# ---------------------------------------------------------------- classifiers

V = 1_500_000
LTOK = f"""
ltok AS (SELECT id, {LABEL} AS label, w AS term, {FOLD.format("id")} AS fold FROM tok)"""
ORACLES["term_frequency"] = CT + "SELECT id, w AS term, count(*) AS tf FROM tok GROUP BY 1, 2"
ORACLES["nb_model"] = with_(CORPUS, TOK, LTOK) + f"""
SELECT t.label, term, tf, round(ln((docs + 1) / (n + 2)), 6) AS pi,
       round(ln((tf + 1) / (terms + {V})), 6) AS theta
FROM (SELECT label, term, count(*) AS tf FROM ltok GROUP BY 1, 2) t
JOIN (SELECT label, count(DISTINCT id) AS docs, count(*) AS terms FROM ltok GROUP BY 1) c
  ON t.label = c.label
CROSS JOIN (SELECT count(DISTINCT id) AS n FROM ltok)"""


def nb_sql(train: str, test: str, key: str) -> str:
    """Naive Bayes on token tables train/test(key, label, term): key, label, prediction, margin."""
    return f"""
SELECT {key}, label, CASE WHEN m > 0 THEN 1 ELSE 0 END AS prediction, round(m, 6) AS margin
FROM (
  SELECT {key}, any_value(label) AS label,
         round(sum(ln((coalesce(c1, 0) + 1) / (t1 + {V}))
                   - ln((coalesce(c0, 0) + 1) / (t0 + {V})))
               + any_value(ln(d1 + 1) - ln(d0 + 1)), 9) AS m
  FROM {test} x
  LEFT JOIN (SELECT term, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1
             FROM {train} GROUP BY term) y ON x.term = y.term
  CROSS JOIN (SELECT count(*) FILTER (label = 0) AS t0, count(*) FILTER (label = 1) AS t1,
                     count(DISTINCT k) FILTER (label = 0) AS d0,
                     count(DISTINCT k) FILTER (label = 1) AS d1
              FROM (SELECT *, {key} AS k FROM {train})) z
  GROUP BY {key})"""


ORACLES["nb_predict"] = with_(CORPUS, TOK, LTOK) + nb_sql("ltok", "ltok", "id")
ORACLES["nb_holdout"] = with_(CORPUS, TOK, LTOK) + nb_sql(
    f"(SELECT * FROM ltok WHERE fold <> {X.HOLDOUT_FOLD})",
    f"(SELECT * FROM ltok WHERE fold = {X.HOLDOUT_FOLD})",
    "id",
)
ORACLES["svm1_model"] = with_(CORPUS, TOK, LTOK) + """
SELECT term, round(sum(CASE WHEN label = 1 THEN 1 ELSE -1 END)
                   / (SELECT count(*) FROM corpus), 9) AS weight
FROM ltok GROUP BY term"""
ORACLES["svm1_predict"] = with_(CORPUS, TOK, LTOK) + """
SELECT id, any_value(label) AS label,
       CASE WHEN sum(s) > 0 THEN 1 ELSE 0 END AS prediction
FROM ltok JOIN (SELECT term, sum(CASE WHEN label = 1 THEN 1 ELSE -1 END) AS s
                FROM ltok GROUP BY term) USING (term)
GROUP BY id"""


def svm_steps(left_out: str = "") -> list[str]:
    """w1, w2, w3: weights after one to three steps; of every fold that is left out, if asked."""
    f, by = (("f.fold AS f, ", "f, ") if left_out else ("", ""))
    folds = " CROSS JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(10)) f" if left_out else ""
    where = f"WHERE {left_out}" if left_out else ""
    on = "USING (f, term)" if left_out else "USING (term)"
    n = "USING (f)" if left_out else "ON TRUE"
    out = [
        "bag AS MATERIALIZED (SELECT id, CASE WHEN label = 1 THEN 1 ELSE -1 END AS y, fold, term, "
        "count(*) AS tf FROM ltok GROUP BY ALL)",
        f"sized AS MATERIALIZED (SELECT {f}count(DISTINCT id) AS n FROM bag{folds} {where} GROUP BY ALL)",
        f"""
w1 AS MATERIALIZED (
  SELECT {by}term, g * 1.0::DOUBLE / n AS w
  FROM (SELECT {f}term, sum(y * tf) AS g FROM bag{folds} {where} GROUP BY ALL) JOIN sized {n})""",
    ]
    for t in (2, 3):
        out.append(f"""
g{t} AS MATERIALIZED (
  SELECT {by}term, sum(y * tf) AS g
  FROM bag JOIN (SELECT {by}id FROM bag JOIN w{t - 1} USING (term) GROUP BY {by}id
                 HAVING any_value(y) * sum(tf * w) < 1) USING (id)
  {where.replace("f.fold", "f")} GROUP BY ALL)""")
        out.append(f"""
w{t} AS MATERIALIZED (
  SELECT {by}term, w * (1 - 0.01::DOUBLE / sqrt({t})) + coalesce(g, 0) / sqrt({t}) / n AS w
  FROM w{t - 1} LEFT JOIN g{t} {on} JOIN sized {n})""")
    return out


ORACLES["svm3_model"] = with_(CORPUS, TOK, LTOK, *svm_steps()) + "SELECT term, round(w, 9) AS weight FROM w3"
_MADE = f"""
made AS (SELECT src_id, {LABEL} AS label, text FROM ({gen_sql(antonym(2))})),
mtok AS (SELECT src_id, label, unnest(string_split(text, ' ')) AS term FROM made),
both_tok AS (SELECT 'g' || src_id AS src_id, label, term FROM mtok
             UNION ALL SELECT 'o' || id, {LABEL}, w FROM tok)"""
ORACLES["denoise_synthetic"] = (
    with_(*GEN_BASE, _MADE)
    + f"SELECT * FROM ({nb_sql('mtok', 'mtok', 'src_id')}) WHERE prediction = label"
)
ORACLES["denoise_with_original"] = (
    with_(*GEN_BASE, _MADE)
    + f"SELECT * FROM ({nb_sql('both_tok', 'mtok', 'src_id')}) WHERE prediction = label"
)

# ---------------------------------------------------------------- metrics

# precision/recall/F1 per threshold and the areas by the trapezoidal rule over explicit points
METRICS = """
  CASE WHEN fn + tn > 0 THEN (tp + fn) / (tp + fp + fn + tn) END AS precision_at_0,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision_at_1,
  CAST(CASE WHEN fn + tn > 0 THEN CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END END AS DOUBLE)
    AS recall_at_0,
  CASE WHEN tp + fp > 0 THEN CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END END
    AS recall_at_1,
  CASE WHEN fn + tn > 0 THEN 2 * (tp + fn) / (2 * (tp + fn) + fp + tn) END AS f1_at_0,
  CASE WHEN tp + fp > 0 THEN CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)
       ELSE 0.0 END END AS f1_at_1,
  CASE WHEN tp + fp = 0 THEN (tp + fn) / (tp + fp + fn + tn)
       ELSE (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) * (tp / (tp + fp))
          + (1 - CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END)
            * (tp / (tp + fp) + (tp + fn) / (tp + fp + fn + tn)) / 2 END AS aupr,
  CASE WHEN tp + fn = 0 THEN 0.0 WHEN fp + tn = 0 THEN 1.0
       ELSE (fp / (fp + tn)) * (tp / (tp + fn)) / 2
          + (1 - fp / (fp + tn)) * (tp / (tp + fn) + 1) / 2 END AS auroc"""
CELLS = """
  sum(n) FILTER (prediction = 1 AND label = 1) AS tp, sum(n) FILTER (prediction = 1 AND label = 0)
    AS fp, sum(n) FILTER (prediction = 0 AND label = 1) AS fn,
  sum(n) FILTER (prediction = 0 AND label = 0) AS tn"""
ZERO = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("tp", "fp", "fn", "tn"))
PAIRS = f"""
pairs AS (SELECT {FOLD.format("doc_id")} AS fold, toxic AS prediction, 1 - quality AS label,
                 1 AS n FROM labels),
cells AS (SELECT fold, {ZERO} FROM (SELECT fold, {CELLS} FROM pairs GROUP BY fold)),
per_fold AS (SELECT fold, {METRICS} FROM cells)"""
P_ = with_(PAIRS)
ALL_METRICS = [
    "precision_at_0", "precision_at_1", "recall_at_0", "recall_at_1", "f1_at_0", "f1_at_1",
    "aupr", "auroc",
]
ORACLES["metrics_binary"] = (
    P_ + "SELECT fold, " + ", ".join(f"round({m}, 6) AS {m}" for m in ALL_METRICS)
    + " FROM per_fold"
)
ORACLES["metric_f1_threshold"] = P_ + """
SELECT round(avg(f1_at_0), 6) AS f1_at_0, round(avg(f1_at_1), 6) AS f1_at_1 FROM per_fold"""
ORACLES["metric_aupr"] = P_ + "SELECT round(avg(aupr), 6) AS aupr FROM per_fold"
ORACLES["metric_auroc"] = P_ + "SELECT round(avg(auroc), 6) AS auroc FROM per_fold"
ORACLES["metrics_confusion"] = P_ + """
SELECT label, count(*) FILTER (prediction = 0) AS predicted_0,
       count(*) FILTER (prediction = 1) AS predicted_1 FROM pairs GROUP BY label"""
_BY_LABEL = """
SELECT l AS label, count(*) FILTER (label = l) AS n,
  coalesce(count(*) FILTER (prediction = l AND label = l)
    / nullif(count(*) FILTER (prediction = l), 0), 0.0) AS precision,
  coalesce(count(*) FILTER (prediction = l AND label = l)
    / nullif(count(*) FILTER (label = l), 0), 0.0) AS recall,
  coalesce(count(*) FILTER (prediction = l AND label <> l)
    / nullif(count(*) FILTER (label <> l), 0), 0.0) AS fpr,
  2 * count(*) FILTER (prediction = l AND label = l)
    / (count(*) FILTER (prediction = l) + count(*) FILTER (label = l)) AS f1
FROM pairs CROSS JOIN (VALUES (0), (1)) c(l) GROUP BY l"""
ORACLES["metrics_by_label"] = P_ + f"""
SELECT label, n, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(fpr, 6) AS fpr, round(f1, 6) AS f1 FROM ({_BY_LABEL})"""
ORACLES["metrics_weighted"] = P_ + "SELECT " + ", ".join(
    f"round(sum({m} * n) / sum(n), 6) AS weighted_{m}" for m in ("precision", "recall", "f1", "fpr")
) + f" FROM ({_BY_LABEL})"

# ---------------------------------------------------------------- cross-validation, suites


def draws_sql(specs: Sequence[Spec]) -> str:
    """draws(gen, src_id, copy, text): other random words for every copy of a blankout row."""
    gens: list[Gen] = []
    for s in specs:
        if s.gen and _scopeless(s.gen) not in gens:
            gens.append(_scopeless(s.gen))
    parts = [
        f"SELECT {i} AS gen, {d + 1} AS copy, src_id, text FROM ("
        + gen_sql(Gen(**{**g.__dict__, "draw": d})) + ")"
        for i, g in enumerate(gens) if g.kind == "blankout"
        for d in range(max(s.cap for s in specs if s.gen and _scopeless(s.gen) == g))
    ]
    return "\nUNION ALL\n".join(parts)


def cv_ctes(
    specs: Sequence[Spec], classifier: str, independent: bool = False, redraw: bool = False, **base
) -> list[str]:
    """cells(s, fold, tp, fp, fn, tn) over weighted rows, folds by source row.

    ``independent``: folds per copy, other ones for training and for testing; originals only
    are tested then.  ``redraw``: copies of a blankout row have texts of their own.
    """
    copy, train_w, train_fold = "1", "w", FOLD.format("src_id")
    test_fold, drawn = train_fold, "1"
    if independent:
        row = "src_id || ':' || method || ':' || copy"
        train_fold = TRAIN_FOLD.format(row)
        test_fold = TEST_FOLD.format("src_id || ':original:1'")
    if independent or redraw:
        copy, train_w = "unnest(generate_series(1, w))", "1"
    texts = "SELECT gen, src_id, 1 AS drawn, text FROM variants"
    draws: list[str] = []
    if redraw:
        drawn = "copy"
        draws = [f"draws AS MATERIALIZED ({draws_sql(specs)})"]
        texts = f"""
  SELECT v.gen, v.src_id, c.drawn, coalesce(d.text, v.text) AS text
  FROM variants v CROSS JOIN (SELECT range AS drawn FROM range(1, 11)) c
       LEFT JOIN draws d ON v.gen = d.gen AND v.src_id = d.src_id AND c.drawn = d.copy"""
    if classifier == "nb":
        margin = """
         sum(tf * (ln(coalesce(a1, 0) - coalesce(f1, 0) + 1)
                   - ln(coalesce(a0, 0) - coalesce(f0, 0) + 1)))"""
        rule = f"""
    CASE WHEN d1 = 0 THEN 0 WHEN d0 = 0 THEN 1
         WHEN round(m + ln(d1 + 1) - ln(d0 + 1) + len * (ln(t0 + {V}) - ln(t1 + {V})), 9) > 0
         THEN 1 ELSE 0 END"""
    else:
        margin = """
         sum(tf * ((coalesce(a1, 0) - coalesce(f1, 0)) - (coalesce(a0, 0) - coalesce(f0, 0))))"""
        rule = "CASE WHEN m > 0 THEN 1 ELSE 0 END"
    return [
        *set_ctes(specs, **base),
        *draws,
        f"""
texts AS MATERIALIZED ({texts})""",
        """
vterm AS MATERIALIZED (
  SELECT gen, src_id, drawn, term, count(*) AS tf
  FROM (SELECT gen, src_id, drawn, unnest(string_split(text, ' ')) AS term FROM texts)
  GROUP BY 1, 2, 3, 4)""",
        """
vlen AS MATERIALIZED (
  SELECT gen, src_id, drawn, len(string_split(text, ' ')) AS len FROM texts)""",
        f"""
train AS MATERIALIZED (
  SELECT s, gen, src_id, drawn, label, w, len, fold
  FROM (SELECT s, gen, src_id, {drawn} AS drawn, label, {train_w} AS w, {train_fold} AS fold
        FROM (SELECT *, {copy} AS copy FROM weighted WHERE w > 0))
       JOIN vlen USING (gen, src_id, drawn))""",
        f"""
test AS MATERIALIZED (
  SELECT s, gen, src_id, drawn, copy, label, len, n, fold FROM (
    SELECT s, gen, src_id, 1 AS drawn, 1 AS copy, label, 1 AS n, {test_fold} AS fold
    FROM variants CROSS JOIN specs WHERE test = 'original' AND gen = -1
    UNION ALL
    SELECT s, gen, src_id, {drawn}, copy, label, {train_w}, {FOLD.format("src_id")}
    FROM (SELECT *, {copy} AS copy FROM weighted WHERE w > 0)
    WHERE test = 'augmented' OR (test = 'generated' AND gen <> -1))
  JOIN vlen USING (gen, src_id, drawn))""",
        """
tcount AS MATERIALIZED (
  SELECT s, fold, term, coalesce(sum(w * tf) FILTER (label = 0), 0) AS f0,
         coalesce(sum(w * tf) FILTER (label = 1), 0) AS f1
  FROM train JOIN vterm USING (gen, src_id, drawn) GROUP BY 1, 2, 3)""",
        """
tall AS MATERIALIZED (
  SELECT s, term, sum(f0) AS a0, sum(f1) AS a1 FROM tcount GROUP BY 1, 2)""",
        """
classes AS (
  SELECT f.s, x.fold,
         coalesce(sum(w) FILTER (label = 0 AND f.fold <> x.fold), 0) AS d0,
         coalesce(sum(w) FILTER (label = 1 AND f.fold <> x.fold), 0) AS d1,
         coalesce(sum(w * len) FILTER (label = 0 AND f.fold <> x.fold), 0) AS t0,
         coalesce(sum(w * len) FILTER (label = 1 AND f.fold <> x.fold), 0) AS t1
  FROM train f CROSS JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(10)) x
  GROUP BY 1, 2)""",
        f"""
margins AS (
  SELECT s, gen, src_id, drawn, copy, fold, label, len, n, {margin} AS m
  FROM test JOIN vterm USING (gen, src_id, drawn)
       LEFT JOIN tall USING (s, term) LEFT JOIN tcount USING (s, fold, term)
  GROUP BY ALL)""",
        f"""
predicted AS (
  SELECT s, fold, label, n, {rule} AS prediction
  FROM margins JOIN classes USING (s, fold))""",
        f"""
cells AS (
  SELECT s, fold, {ZERO} FROM (SELECT s, fold, {CELLS} FROM predicted GROUP BY 1, 2))""",
        f"""
per_fold AS (SELECT s, fold, tp, fp, fn, tn, {METRICS} FROM cells)""",
    ]


AVERAGED = ("f1_at_0", "f1_at_1", "aupr", "auroc")


def suite_sql(specs: Sequence[Spec], classifier: str, **how) -> str:
    averages = ", ".join(f"round(avg({m}), 6) AS {m}" for m in AVERAGED)
    return with_(*cv_ctes(specs, classifier, **how)) + f"""
SELECT scenario, n_label_0, n_label_1, {", ".join(AVERAGED)}
FROM specs
JOIN (SELECT s, CAST(coalesce(sum(w) FILTER (label = 0), 0) AS BIGINT) AS n_label_0,
             CAST(coalesce(sum(w) FILTER (label = 1), 0) AS BIGINT) AS n_label_1
      FROM weighted GROUP BY s) USING (s)
JOIN (SELECT s, {averages} FROM per_fold GROUP BY s) USING (s)"""


for _name, (_specs, _classifier) in SUITES.items():
    ORACLES[_name] = suite_sql(_specs, _classifier)

CAPPED_BASE = (
    CORPUS.replace("corpus AS", "uncapped AS", 1),
    f"""
corpus AS (
  SELECT id, sentiment, text
  FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY md5('cap:' || id)) AS rn
        FROM uncapped)
  WHERE sentiment <> 'positive' OR rn <= {X.CAP})""",
    TOK,
    WORDS,
)
ORACLES["suite_similar_fair_capped"] = suite_sql(similar_family(), "nb", base=CAPPED_BASE)
ORACLES["suite_similar_fair_asis"] = suite_sql(similar_family(), "nb", sampled="TRUE")
ORACLES["suite_imbalance_independent"] = suite_sql(imbalance_family(), "nb", independent=True)

ORACLES["suite_blankout_redraw"] = suite_sql(REDRAWN_SUITE, "nb", redraw=True)
ORACLES["suite_third_class"] = suite_sql(
    [*imbalance_family(), THIRD_SET], "nb", base=THIRD_BASE, sampled="TRUE"
)

_PLAIN = [Spec("plain", None, base="full")]
for _name, _classifier, _apart in (
    ("cv_nb", "nb", False), ("cv_nb_independent", "nb", True), ("cv_svm1", "svm1", False)
):
    ORACLES[_name] = with_(*cv_ctes(_PLAIN, _classifier, _apart)) + (
        "SELECT fold, tp, fp, fn, tn, "
        + ", ".join(f"round({m}, 6) AS {m}" for m in AVERAGED)
        + " FROM per_fold"
    )

ORACLES["cv_svm3"] = with_(CORPUS, TOK, LTOK, *svm_steps("bag.fold <> f.fold"), f"""
scored AS (
  SELECT id, fold, any_value(label) AS label, coalesce(sum(w), 0) > 0 AS p
  FROM ltok LEFT JOIN w3 ON w3.term = ltok.term AND w3.f = ltok.fold GROUP BY id, fold)""", f"""
cells AS (
  SELECT fold, {ZERO} FROM (
    SELECT fold, {CELLS} FROM (SELECT fold, label, CAST(p AS INTEGER) AS prediction, 1 AS n FROM scored)
    GROUP BY fold))""", f"per_fold AS (SELECT *, {METRICS} FROM cells)") + (
    "SELECT fold, tp, fp, fn, tn, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in AVERAGED)
    + " FROM per_fold"
)

# ---------------------------------------------------------------- export

_EXPORT = {
    "antonym": antonym(4),
    **{f"similar_{name}": similar(name) for name in LEXICONS},
    "blankout": blankout(1, protect=False),
}
ORACLES["augmented_export"] = with_(*GEN_BASE) + "\nUNION ALL\n".join(
    f"""SELECT {q(name)} AS dataset, id AS src_id, 'original' AS method, sentiment, text FROM corpus
UNION ALL
SELECT {q(name)}, src_id, method, sentiment, text FROM ({gen_sql(g)})"""
    for name, g in _EXPORT.items()
)
ORACLES["augmented_read_back"] = (
    f"SELECT * FROM ({ORACLES['augmented_export']}) WHERE dataset IN ('antonym', 'similar_news')"
)
