import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import fuzzy as Z, line_correction as L, transcription as C
from pagewright.sources import pages as P


def strings(seed: int, n: int, most: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice("abé~") for _ in range(pick.randrange(most + 1))) for _ in range(n)]


@pytest.mark.parametrize("swaps", [True, False])
@pytest.mark.parametrize("share, most", [(0.2, 6), (0.5, 6)])
def test_blocks_find_what_keys_find(spark, monkeypatch, share, most, swaps):
    """Groups cut into blocks give the pairs of the join by keys, nearest over all blocks."""
    monkeypatch.setattr(Z, "BLOCK", 7)
    q = spark.createDataFrame([(g, x, i) for g, most_chars in enumerate((4, 12, 30)) for i, x in enumerate(strings(g, 30, most_chars))], "g long, query string, place int")
    t = spark.createDataFrame([(g, x, i) for g, most_chars in enumerate((4, 12, 30, 9)) for i, x in enumerate(strings(g + 50, 40, most_chars))], "g long, term string, at int")
    found = Z.closest_in_groups(q, t, ["g"], share, most, swaps).collect()
    plain = Z.closest(Z.fuzzy_join(q, t.selectExpr("g", "term", "1 AS freq"), ["g"], share, most, swaps=swaps), ["g"])
    expected = plain.join(q, ["g", "query"]).join(t, ["g", "term"]).collect()
    row = lambda r: (r["g"], r["query"], r["place"], r["term"], r["at"], r["distance"])
    assert sorted(map(row, found)) == sorted(map(row, expected)) and found


def test_tallies_bound_edits():
    a, b = strings(1, 200, 70), strings(2, 200, 70)
    a, b = [*a, "eeeeeeee", "\U0001f600x", ""], [*b, "", "x", "y"]
    x, y = Z.tallies(a), Z.tallies(b)
    least = [max(sum(int(v).bit_count() for v in p & ~q), sum(int(v).bit_count() for v in q & ~p)) for p, q in zip(x, y)]
    assert all(n <= d for swaps in (True, False) for n, d in zip(least, Z.osa(a, b, swaps)))


def test_matches_shuffle_rows_by_document_not_by_candidate(spark):
    """Texts of a few syllables: pairs that share a piece were shuffled one by one, many times the n-grams."""
    pick = random.Random(3)
    words = [(d, i, "".join(pick.choice(["th", "an", "er", "in"]) for _ in range(4))) for d in range(3) for i in range(60)]
    man = spark.createDataFrame(words, "d long, pos int, word string")
    ocr = man.selectExpr("d", "pos", "IF(pos % 3 = 0, replace(word, 'e', 'c'), word) AS word")
    matches = C.ngram_matches(ocr, man, ["d"])
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and "ArrowEvalPython" in plan
    # A window of three words holds a place divisible by three; where its word has no `e`, the n-gram is its own nearest.
    assert matches.filter("ocrpos = manpos").count() == 3 * 58


def test_words_alike_at_their_start_share_no_key(spark):
    """Terms with the same seven first letters met in one key, whose pairs grew with the square of the dictionary."""
    rows = spark.createDataFrame([("internation" + x, 2) for x in ("al", "elle", "sbuero")] + [("interna" + x, 2) for x in ("xyz", "qvwk")], "term string, k int")
    keyed = Z.with_delete_keys(rows, "term", "k", 2).select("term", "key").distinct()
    found = [(r["term"], r["key"]) for r in keyed.collect()]
    pairs = {(a, b) for a, k in found for b, m in found if k == m and a < b}
    assert pairs and not any("interna" + x in pair for pair in pairs for x in ("xyz", "qvwk"))


def test_python_workers_get_small_batches(spark):
    """Ten thousand rows with texts went to a worker at once."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = spark.createDataFrame([(1, 0, "a b")], "d long, line_idx int, text string")
    L.correct_lines(lines, spark.createDataFrame([(1, "a c")], "d long, transcription string"), ["d"])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    P.write_back(spark.createDataFrame([("<a/>", [["b"]])], "xml string, text array<array<string>>"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_long_lines_are_aligned_as_difflib_does_but_sooner():
    from difflib import SequenceMatcher
    from random import Random
    from time import process_time

    from pagewright.operators.blocks import matching_blocks

    random = Random(3)
    for case in range(400):
        words = random.choice([1, 2, 3, 8, 50])
        a = [random.randrange(words) for _ in range(random.randrange(90))]
        b = [x if random.random() < 0.8 else random.randrange(words) for x in a if random.random() < 0.9]
        want = [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]
        assert all(matching_blocks(a, b, pairs) == want for pairs in (0, 30, 1 << 18)), (a, b)
    given = [f"w{random.randrange(8)}" for _ in range(5000)]
    read = ["x" + w if i % 7 == 3 else w for i, w in enumerate(given)]
    began = process_time()
    blocks = matching_blocks(read, given)
    assert process_time() - began < 30 and sum(n for _, _, n in blocks) > 4000  # difflib takes minutes


def shuffled_rows(spark, df):
    """Rows that a query hands from task to task, all its stages together."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    df.collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_ngrams_of_whole_texts_stay_with_their_text(spark):
    from pagewright.operators import words as W

    texts = [(k, " ".join(f"w{(k * i) % 17}" for i in range(200))) for k in range(1, 21)] + [(7, "a b c a b c"), (None, "x y z"), (None, "x y z"), (50, "a b"), (51, None)]
    docs = spark.createDataFrame(texts, "d long, text string").repartition(3).cache()
    docs.count()
    want = sorted(map(str, W.ngram_index(W.document_ngrams(docs, ["d"]), ["d"]).collect()))
    assert sorted(map(str, W.document_ngram_index(docs, ["d"]).collect())) == want
    assert shuffled_rows(spark, W.document_ngram_index(docs.filter("d < 7"), ["d"])) < 50
    pairs = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["a", "b", "c", "x", "y"]), (2, ["a"], ["a"]), (3, ["a b", "c", "d"], ["a", "b c", "d"])], "d long, o array<string>, g array<string>")
    assert [tuple(r) for r in W.shared_ngrams(pairs, ["d"], "o", "g").collect()] == [(1, 0)]
    lists = spark.createDataFrame([(1, [f"w{i}" for i in range(1000)], [i + 1 if i % 10 < 8 else None for i in range(1000)]), (2, ["a", "b"], [None, 0]), (3, [], []), (4, None, None)], "d long, w array<string>, p array<int>")
    runs = C.list_uncovered_runs(lists, ["d"], "w", "p")
    man = lists.select("d", F.posexplode(F.arrays_zip("w", "p")).alias("pos", "x")).select("d", "pos", F.col("x.w").alias("word"), F.col("x.p").alias("ocrpos"))
    covered = man.filter("ocrpos IS NOT NULL").select("d", F.col("pos").alias("manpos"), "ocrpos")
    want = sorted(map(str, C.uncovered_runs(man.drop("ocrpos"), covered, ["d"]).collect()))
    assert len(want) == 101 and sorted(map(str, runs.collect())) == want
    assert shuffled_rows(spark, runs) == 0


def test_words_and_long_lines_are_scored_in_one_batch():
    from time import process_time

    from pagewright.operators import evaluation as E
    from plain import levenshtein

    pick = random.Random(5)
    lists = [([pick.choice("abcd") for _ in range(pick.randrange(90))], [pick.choice("abcd") for _ in range(pick.randrange(90))]) for _ in range(150)]
    assert E.sequence_distances(lists).tolist() == [levenshtein(x, y) for x, y in lists]
    text = [pick.choice("abcdefgh ") for _ in range(20000)]
    began = process_time()
    assert E.sequence_distances([(text, [c for i, c in enumerate(text) if i % 9])]).tolist() == [len(range(0, 20000, 9))]
    assert process_time() - began < 10
