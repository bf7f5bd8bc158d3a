"""Registered queries against SQL on the smallest data set; one suite as a sample."""

import math
import os

import duckdb
import pytest

from counterpoise.functions import text
from counterpoise.operators import generate, sampling
from counterpoise.plans import specs, suites
from workload.oracles import ORACLES
from workload.queries import QUERIES, SUITES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


# hashed as the ml library does, which SQL cannot; see test_model
WITHOUT_SQL = {"cv_nb_hashed"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def test_fixed_values():
    """Written out once more: cases, protected words, limits and the sets of the export."""
    modes = ["two_stage", "two_stage", "single_pass", "single_pass", "one_word", "one_word"]
    cases = {i: (mode, i % 2 == 1, i < 2) for i, mode in enumerate(modes)}
    assert generate.ANTONYM_CASES == cases
    assert text.PROTECTED_WORDS == ["dont", "havent", "cant", "cannot", "arent", "aint"]
    assert sampling.MINORITY_SHARE == 0.2
    caps = (specs.CAP_PLAIN, specs.CAP_BLANKOUT_MINORITY, specs.CAP_BLANKOUT_BOTH)
    assert caps == (10, 4, 7)
    assert (specs.CAP_ANTONYM, specs.CAP_SIMILAR) == (5, 4)
    names = ("news", "tweets", "news_senti", "tweets_senti")
    assert specs.SIMILAR_LEXICONS == names
    assert suites.export_gens() == {
        "antonym": generate.Gen("antonym", case=4, prefilter=False),
        **{f"similar_{n}": generate.Gen("similar", lexicon=n) for n in names},
        "blankout": generate.Gen("blankout", k=1, protect=False),
    }


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


SAMPLE = [q for q in QUERIES if q not in SUITES and q not in WITHOUT_SQL] + ["suite_imbalance"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rel = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got == normal(rel.fetchall(), rel.columns)
