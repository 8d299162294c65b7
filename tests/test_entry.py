import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["restructure_by_lang", "text_render", "realign_lines", "sentence_split", "tokens_alt", "reading_order", "usage_by_key", "latest_status", "option_parse", "uncovered_runs"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    tidy = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert tidy([tuple(r) for r in df.collect()]) == tidy([tuple(r[i] for i in at) for r in found.fetchall()])
