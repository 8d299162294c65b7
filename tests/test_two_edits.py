import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.operators.fuzzy import edits_allowed
from pagewright.plans import correction_queries as Q
from plain import osa

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    """Words as recognised and as given with their counts, by language."""
    words = Q.document_words(spark, DATA)
    terms = {(r["lang"], r["term"]): r["freq"] for r in Q.dictionary(words).collect()}
    asked = sorted((r["lang"], r["ocr"]) for r in words.select("lang", "ocr").distinct().collect() if r["lang"] is not None)
    return asked[:: max(len(asked) // 40, 1)], terms


@pytest.mark.parametrize("name", ["fuzzy_closest_two", "spell_top1_two", "spell_in_context_two"])
def test_two_edits_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA).select(*found.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))


def test_exchanges_against_brute_force(spark, sides):
    asked, terms = sides
    by_length, best = {}, {(r["lang"], r["word"]): (r["corrected"], r["distance"]) for r in entry.queries()["spell_top1_exchanges"](spark, DATA).collect()}
    for r in entry.queries()["fuzzy_closest_by_length"](spark, DATA).collect():
        by_length.setdefault((r["lang"], r["query"]), set()).add((r["term"], r["distance"]))
    for lang, word in asked:
        near = [(d, -n, t) for (x, t), n in terms.items() if x == lang and abs(len(t) - len(word)) <= 6 and (d := osa(word, t)) <= 6]
        two = min((x for x in near if x[0] <= 2), default=None)
        assert best[lang, word] == ((two[2], two[0]) if two else (word, None))
        allowed = [x for x in near if x[0] <= edits_allowed(len(word), 0.2, 6, None)]
        assert by_length.get((lang, word), set()) == {(t, d) for d, _, t in allowed if d == min(allowed)[0]}
