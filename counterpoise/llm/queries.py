"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.llm import (
    decontaminate,
    divergence,
    langid,
    mixing,
    ngramlm,
    quality,
    repeats,
    sharding,
    simhash,
    surrogates,
    topk,
    urlfilter,
    urltable,
    vectorcodes,
)
from counterpoise.llm.common import held_out, read, word_count
from counterpoise.session import spool

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_mix_to_weights(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    sized = spool(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix(sized, size="size")
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


@query
def op9_virtual_slots(spark, d):
    docs, shards = read(spark, d, "documents"), 8
    text = F.col("text")
    sized = spool(
        docs.select(
            "doc_id",
            sharding.text_size(text).alias("size"),
            sharding.text_crc32(text).alias("text_crc32"),
            sharding.virtual_slot(F.col("doc_id"), text).alias("vslot"),
        ),
        "slots",
    )
    first = spool(sharding.first_map(sharding.slot_bytes(sized), shards), "slot-map")
    grown = sharding.grown_map(first, shards).select("vslot", F.col("shard").alias("next_shard"))
    placed = sharding.places(sized, first, ["doc_id", "text_crc32", "size"])
    return placed.join(F.broadcast(grown), "vslot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "next_shard",
    )


URL_RULES = [
    urlfilter.Rule("com/", "allow"),
    urlfilter.Rule("example.com/en/", "block"),
    urlfilter.Rule("www.example.com/en/", "allow"),
    urlfilter.Rule("net/es/", "block"),
    urlfilter.Rule("net/fr/", "block"),
]


@query
def op10_url_filter(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    labelled = spark.createDataFrame(urltable.rows(), "url string, verdict string")
    judged = urlfilter.filter_urls(pages, URL_RULES, labelled)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op4_benchmark_leaks(spark, d):
    docs = read(spark, d, "documents")
    return decontaminate.leaks(docs, read(spark, d, "benchmark"))


@query
def op5_quality_scores(spark, d):
    table = quality.stats_table(read(spark, d, "documents"))
    model = quality.fit(table, read(spark, d, "labels"))
    scored = table.withColumn("score", quality.scorer(model)(F.col("stats")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op7_simhash_components(spark, d):
    found = simhash.near_duplicates(read(spark, d, "documents"))
    return found.select(
        "doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query
def op3_top_inner_products(spark, d):
    rows = read(spark, d, "embeddings").select(
        "vec_id", topk.quantized(F.col("embedding")).alias("v")
    )
    return topk.top_inner_products(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


@query
def op8_language_id(spark, d):
    docs = read(spark, d, "documents")
    model = langid.fit(docs)
    found = docs.select("doc_id", langid.predicted(model, F.col("text")).alias("p"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "p.lang_pred",
        "p.score",
        (F.col("p.score") < model.threshold).alias("rejected"),
    )


@query
def op6_remove_repeats(spark, d):
    left = repeats.remove_repeats(read(spark, d, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return left.select("doc_id", "n_words", "n_removed", digest)


ORACLES["op6_remove_repeats"] = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), late AS (
    SELECT doc_id, i
    FROM win JOIN (SELECT g, min(doc_id) AS lo FROM win GROUP BY g) USING (g)
    WHERE doc_id > lo
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late
), words AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, p)
    GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op3_top_inner_products"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
      FROM s)
WHERE rank <= 5
"""


@query
def op2_surrogates(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, key=b"example key, replace it")


@query
def op13_vector_codes(spark, d):
    return vectorcodes.vector_codes(read(spark, d, "embeddings"))


def _assigned(books: str) -> str:
    """Every part with its nearest entry, ties to the lower one."""
    return f"""
    SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
    FROM (SELECT p.*, b.entry,
                 list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c)
                 + list_inner_product(b.c, b.c) AS d
          FROM parts p JOIN {books} b ON p.part = b.part)
    GROUP BY ALL"""


def _replaced(assigned: str, books: str) -> str:
    return f"""
    SELECT b.part, b.entry, coalesce(m.c, b.c) AS c
    FROM {books} b LEFT JOIN (
        SELECT part, entry, list(floor(s / n) ORDER BY i) AS c
        FROM (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n
              FROM {assigned}, range(1, 5) r(i) GROUP BY ALL)
        GROUP BY ALL) m ON b.part = m.part AND b.entry = m.entry"""


# for 64 dimensions; the whole numbers are exact in doubles
ORACLES["op13_vector_codes"] = f"""
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, part, e[4 * part + 1 : 4 * part + 4] AS x FROM v, range(16) r(part)
), c0 AS MATERIALIZED (
    SELECT part, entry, x AS c
    FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM parts)
    WHERE entry < 64
), a1 AS MATERIALIZED ({_assigned("c0")}
), c1 AS MATERIALIZED ({_replaced("a1", "c0")}
), a2 AS MATERIALIZED ({_assigned("c1")}
), c2 AS MATERIALIZED ({_replaced("a2", "c1")}
), a3 AS MATERIALIZED ({_assigned("c2")}
), coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
           sum(d)::BIGINT AS error
    FROM a3 GROUP BY ALL
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY part, entry, i))
        FROM c2, range(1, 5) r(i)) AS codebooks_sha256, label
FROM coded
"""


@query
def op12_source_divergence(spark, d):
    return divergence.divergence(read(spark, d, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents
), tf AS MATERIALIZED (
    SELECT i, lang, source, w, count(*) AS n
    FROM (SELECT i, lang, source, unnest(ws) AS w FROM d) GROUP BY ALL
), kept AS (
    SELECT lang, w FROM tf GROUP BY lang, w HAVING count(*) >= 30
), grp AS (
    SELECT DISTINCT lang, source FROM d
), held AS (
    SELECT g.lang, g.source, k.w, coalesce(c.n, 0)::HUGEINT AS n
    FROM grp g JOIN kept k USING (lang)
    LEFT JOIN (SELECT lang, source, w, sum(n) AS n FROM tf GROUP BY ALL) c USING (lang, source, w)
), share AS MATERIALIZED (
    SELECT lang, source, w, n,
           1 + (1000000000 * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p
    FROM held WINDOW g AS (PARTITION BY lang, source)
), whole AS (
    SELECT lang, w, 1 + (1000000000 * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS q
    FROM (SELECT lang, w, sum(n) AS n FROM share GROUP BY ALL) WINDOW g AS (PARTITION BY lang)
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
        FROM share x JOIN share y ON x.lang = y.lang AND x.w = y.w GROUP BY ALL
    ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL
    SELECT s.lang, s.source, 'term', s.w, p - q
    FROM share s JOIN whole USING (lang, w) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part
                                   ORDER BY value DESC, item)::INTEGER AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""


@query
def op11_ngram_scores(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return ngramlm.train_and_score(docs, fold != 0).scores
