import itertools
import math
import random
import time

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions.unions import union
from pagewright.operators import alignment, anchors, evaluation as E, fuzzy as Z, line_correction as L, match_runs, spelling as S, transcription as C
from pagewright.plans import correction_queries as Q
from plain import greedy_sets as plain_sets, levenshtein, osa


def words(spark, *docs):
    rows = [(d, i, w) for d, text in docs for i, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "doc string, pos int, word string")


def test_osa():
    assert Z.osa(["ca", "abcd", "a", ""], ["abc", "acbd", "abcdef", ""]).tolist() == [3, 1, 5, 0]
    rng = random.Random(3)
    pairs = [["".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(2)] for _ in range(500)] + [["x" * 300, "y"], ["", "ab"], ["", ""]]
    pairs += [["a" * 64, "a" * 63 + "b"], ["ab" * 32, "ba" * 32], ["ab" * 40, "ba" * 40], ["b" + "ab" * 40, "ab" * 20]]
    pairs += [["".join(rng.choice("ab") for _ in range(rng.randint(55, 75))) for _ in range(2)] for _ in range(40)]
    assert Z.osa(*map(list, zip(*pairs))).tolist() == [osa(a, b) for a, b in pairs]
    assert Z.osa([], []).tolist() == []


def test_fuzzy_join_is_whole(spark):
    rng = random.Random(2)
    strings = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    q = spark.createDataFrame([("x", s) for s in strings[::2]], "lang string, query string")
    t = spark.createDataFrame([("x", s, 1) for s in strings[1::2]], "lang string, term string, freq long")
    for share, most in ((0.2, 6), (0.5, 6)):
        got = {(r["query"], r["term"], r["distance"]) for r in Z.fuzzy_join(q, t, ["lang"], share, most).collect()}
        want = {(a, b, osa(a, b)) for a, b in itertools.product(strings[::2], strings[1::2]) if osa(a, b) <= min(most, int(len(a) * share))}
        assert got == want
        near = {(r["query"], r["term"], r["distance"]) for r in Z.closest_terms(q, t, ["lang"], share, most).collect()}
        least = {a: min(d for x, _, d in want if x == a) for a, _, _ in want}
        assert near == {(a, b, d) for a, b, d in want if d == least[a]}
        near = {(r["query"], r["term"], r["distance"]) for r in Z.closest_by_share(q, t, ["lang"], share, most).collect()}
        assert near == {(a, b, d) for a, b, d in want if d == least[a]}


def test_fuzzy_join_of_long_strings(spark):
    """Strings long enough for pieces, changed by random edits, exchanges among them."""
    rng = random.Random(4)

    def changed(s, edits):
        for _ in range(edits):
            i = rng.randrange(len(s) - 1)
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("ab") + s[i:], s[:i] + s[i + 1] + s[i] + s[i + 2 :]])
        return s

    made = ["".join(rng.choice("ab~") for _ in range(rng.randint(12, 45))) for _ in range(25)]
    terms = sorted({changed(s, rng.randint(0, 6)) for s in made for _ in range(8)} | {""})
    q = spark.createDataFrame([("x", s) for s in [*made, None]], "lang string, query string")
    t = spark.createDataFrame([("x", s, 1) for s in [*terms, None]], "lang string, term string, freq long")
    for share, most, fixed in ((0.2, 6, None), (0.2, 6, 3)):
        got = {(r["query"], r["term"], r["distance"]) for r in Z.fuzzy_join(q, t, ["lang"], share, most, fixed).collect()}
        want = {(a, b, d) for a in made for b in terms if (d := osa(a, b)) <= (fixed or min(most, int(len(a) * share)))}
        assert got == want and len(want) > 60


def test_transcription_marks(spark):
    ocr = words(spark, ("d", "Thls is a smple text of exmple words heretoday gone"), ("e", "nothing alike"))
    man = words(spark, ("d", "This is a sample text of example words here to day gone"), ("e", "zzzz yyyy"))
    got = {(r["doc"], r["pos"]): r["corrected"] for r in C.correct_words(ocr, man, ["doc"]).collect()}
    line = " ".join(got["d", i] for i in range(10))
    assert "~This" in line and "~sample" in line and "~example" in line
    assert line.startswith("~This is a ~sample text of ~example words")
    assert "~~here ~~to ~~day" in line
    assert got["e", 0] == "[nothing]" and got["e", 1] == "[alike] [[zzzz yyyy]]"


def runs_of(matches):
    out = []
    for d, o, m in sorted(matches, key=lambda x: (x[1] - x[2], x[0], x[1])):
        if out and out[-1][0] == d and out[-1][1] - out[-1][2] == o - m and out[-1][1] + out[-1][3] == o:
            out[-1][3] += 1
        else:
            out.append([d, o, m, 1])
    return [tuple(x) for x in out]


def singles(runs):
    return sorted((s, o + i, m + i) for s, o, m, size in runs for i in range(size))


def test_greedy_runs():
    """The sets of runs are those of single matches, for n-grams of one to three words and sets that are given up."""
    rng = random.Random(5)
    for _ in range(1500):
        k = rng.choice([6, 12, 25])
        places = [(rng.randint(0, k), rng.randint(0, k)) for _ in range(rng.randint(0, 30))] + [(i, i + rng.choice([0, 0, 1])) for i in range(rng.randint(0, k))]
        matches = sorted({(o, m): (rng.randint(0, 2), o, m) for o, m in places}.values())
        n, least = rng.choice([1, 2, 3]), rng.choice([1, 1, 2, 3])
        found = singles(match_runs.greedy_runs(runs_of(matches), n, least))
        assert found == sorted(plain_sets(matches, n, least))
        owner = {}
        for s, o, m in found:
            for i in range(n):
                assert owner.setdefault(("o", o + i), s) == s and owner.setdefault(("m", m + i), s) == s


def test_match_sets_of_documents(spark):
    rng, rows = random.Random(6), []
    for d in range(6):
        places = {(i + rng.choice([0, 0, 0, 2]), i): rng.choice([0, 0, 1]) for i in range(rng.randint(0, 60)) if rng.random() < 0.9}
        rows += [(f"d{d}", k, o, m) for (o, m), k in places.items()]
    df = spark.createDataFrame(rows, "doc string, distance int, ocrpos int, manpos int").repartition(3)
    got = sorted((r["doc"], r["set_no"], r["ocrpos"], r["manpos"]) for r in C.match_sets(df, ["doc"]).collect())
    want = sorted((d, *x) for d in {r[0] for r in rows} for x in plain_sets([(k, o, m) for e, k, o, m in rows if e == d], 3))
    assert got == want
    assert C.match_runs(df, ["doc"]).agg(F.sum("n")).first()[0] == len(rows) > C.match_runs(df, ["doc"]).count()


def test_greedy_runs_of_a_long_document():
    took = []
    for n in (40_000, 160_000):  # gaps, so that the diagonal falls into many sets
        runs = runs_of([(0 if i % 50 > 20 else 1, i, i) for i in range(n) if i % 50 > 6] + [(4, i, i + 900) for i in range(n)])
        began = time.process_time()
        assert match_runs.greedy_runs(runs, 3)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def corrected(spark, line, man):
    lines = spark.createDataFrame([(1, 0, line)], "doc int, line_idx int, text string")
    return L.correct_lines(lines, spark.createDataFrame([(1, man)], "doc int, transcription string"), ["doc"]).first()["corrected"]


def test_line_correction(spark):
    assert corrected(spark, "This is a smple text.", "This is a sample text.") == "This is a ~sample text."
    assert corrected(spark, "The quick brown fox.", "The quick brown fox jumps over the lazy dog.") == "The quick brown fox [[jumps over the lazy dog]] ."
    assert corrected(spark, "aa bb", "cc dd") == "aa bb"


def test_lines_of_a_long_text_are_compared_with_what_stands_beside_them(spark):
    man = [f"line{i} has some words of its own{i}" for i in range(40)]
    ocr = [m.replace("some", "sme") for m in man]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(ocr)], "doc int, line_idx int, text string")
    whole = spark.createDataFrame([(1, " ".join(man))], "doc int, transcription string")
    assert [r["corrected"] for r in L.correct_lines(lines, whole, ["doc"]).orderBy("line_idx").collect()] == ocr
    got = [r["corrected"] for r in L.correct_lines(lines, whole, ["doc"], window=0).orderBy("line_idx").collect()]
    assert got == [m.replace("some", "~some") for m in man]


def test_anchors_of_a_long_text():
    """100,000 words against their transcription: linear, nearly all words placed right, and each line's span is its own."""
    rng, took = random.Random(1), []
    for n in (50_000, 200_000):
        man = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, n // 4)) if rng.random() < 0.5 else rng.choice(["the", "of", "and", "a"]) for _ in range(n)]
        kept = [(i, w) for i, w in enumerate(man) if rng.random() < 0.97]
        ocr = [w if rng.random() < 0.9 else w + "x" for _, w in kept]
        began = time.process_time()
        found = anchors.anchors(ocr, man)
        cuts = list(range(0, len(ocr), 10))
        spans = anchors.spans(cuts, len(ocr), found, n)
        took.append(time.process_time() - began)
        assert all(ocr[i] == man[j] for i, j in found) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))
        assert sum(kept[i][0] == j for i, j in found) > 0.99 * len(found) > 0.8 * n
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] <= b[1] for a, b in zip(spans, spans[1:]))
        assert sum(abs(kept[c][0] - a) <= 2 for c, (a, _) in zip(cuts, spans)) > 0.99 * len(cuts)
    assert took[1] < 9 * took[0] + 0.5


def test_anchors_against_a_plain_check():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 25))] for _ in range(2))
        found = anchors.anchors(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        pairs = anchors.unique_in_both(a, b)
        assert pairs == [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == b.count(x) == 1]
        best = anchors.rising(pairs)
        longest = max((n for n in range(len(pairs) + 1) if any(all(x[1] < y[1] for x, y in zip(c, c[1:])) for c in itertools.combinations(pairs, n))), default=0) if len(pairs) < 10 else len(best)
        assert len(best) == longest and all(x < y for (_, x), (_, y) in zip(best, best[1:]))
    assert anchors.spans([], 0, [], 3) == [] and anchors.spans([0], 0, [], 3) == [(0, 3)]


def test_documents_are_corrected_line_by_line(spark):
    rows = Q.document_line_correction(spark, "/root/testdata/sf0.001")
    lines = Q.whole_lines(spark, "/root/testdata/sf0.001")
    joined = rows.join(lines.filter("gt = ocr AND length(gt) > 60"), ["doc_id", "line_idx"]).select("ratio", "corrected_md5", F.md5("ocr").alias("same"))
    counted = joined.agg(F.count("*").alias("n"), F.count_if(F.col("ratio") > 0.9).alias("near")).first()
    assert counted["n"] == 0 or counted["near"] > 0.95 * counted["n"]
    assert rows.count() == lines.count() and rows.filter("ratio > 0.5").count() > 0.9 * lines.filter("length(gt) > 20").count()


def test_spelling(spark):
    terms = spark.createDataFrame([("en", "sample", 3), ("en", "simple", 5), ("en", "the", 9)], "lang string, term string, freq long")
    placed = spark.createDataFrame([(1, "en", 0, 0, "the"), (1, "en", 0, 1, "smple"), (1, "xx", 1, 2, "smple")], "doc int, lang string, line_idx int, pos int, word string")
    assert S.correct_text(placed, terms, ["doc"], ["lang"]).first()["text"] == "the simple\nsmple"
    counts = spark.createDataFrame([("en", "the", "sample", 2)], "lang string, before string, word string, n long")
    got = {r["pos"]: r["corrected"] for r in S.context_corrections(placed.filter("lang = 'en'"), terms, counts, ["doc"], ["lang"]).collect()}
    assert got == {0: "the", 1: "sample"}


def path_score(path, places, pairs, total):
    freq = [{c["term"]: c["freq"] for c in p} for p in places]
    alone = lambda i: (1 - S.BY_NEIGHBOUR) * (freq[i][path[i]] + 0.5) / (total + 1)
    score = math.log(alone(0))
    for i in range(1, len(path)):
        seen = pairs[i - 1].get((path[i - 1], path[i]), 0)
        score += math.log((S.BY_NEIGHBOUR * seen / max(freq[i - 1][path[i - 1]], seen) if seen else 0) + alone(i))
    return score


def test_best_paths_against_all_paths():
    rng = random.Random(31)
    for _ in range(300):
        places = [[{"term": t, "freq": rng.randint(0, 9)} for t in rng.sample("abcdef", rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]
        pairs = [{(b["term"], t["term"]): rng.randint(1, 5) for b in x for t in y if rng.random() < 0.4} for x, y in zip(places, places[1:])]
        got = S.best_path(places, pairs, 100.0)
        every = [path_score(p, places, pairs, 100.0) for p in itertools.product(*[[c["term"] for c in x] for x in places])]
        assert abs(path_score(got, places, pairs, 100.0) - max(every)) < 1e-9


def test_spelling_by_both_neighbours(spark):
    """What follows decides, and two misread words side by side help one another; words of the dictionary stay."""
    terms = [("hot", 5), ("hat", 9), ("soup", 5), ("soap", 9), ("rack", 5), ("the", 20), ("eat", 4)]
    terms = spark.createDataFrame([("en", t, n) for t, n in terms], "lang string, term string, freq long")
    counts = spark.createDataFrame([("en", "hot", "soup", 5), ("en", "the", "hat", 2), ("en", "hat", "rack", 4), ("en", "eat", "hot", 1)], "lang string, before string, word string, n long")
    lines = ["the hxt soup", "hxt soxp", "the hxt rack", "hxt", "the zzzz hxt soup hat", "hxt rack hxt soup"]
    rows = [(i, "en", p, w) for i, x in enumerate(lines) for p, w in enumerate(x.split())] + [(9, "xx", 0, "hxt"), (9, "xx", 1, "soup")]
    got = S.path_corrections(spark.createDataFrame(rows, "line int, lang string, pos int, word string"), terms, counts, ["line"], ["lang"]).collect()
    fixed = {}
    for r in sorted(got, key=lambda r: (r["line"], r["pos"])):
        fixed[r["line"]] = f"{fixed.get(r['line'], '')} {r['corrected']}".strip()
    assert len(got) == len(rows)
    assert fixed == {0: "the hot soup", 1: "hot soup", 2: "the hat rack", 3: "hat", 4: "the zzzz hot soup hat", 5: "hat rack hot soup", 9: "hxt soup"}


def test_paths_restore_more(spark):
    rows = Q.spell_restored(spark, "/root/testdata/sf0.001").collect()
    total = {c: sum(r[c] for r in rows) for c in ("n_wrong", "n_alone", "n_before", "n_path")}
    assert total["n_path"] > total["n_before"] >= total["n_alone"] and total["n_wrong"] > 1000, total


def test_evaluation_goldens(spark):
    pairs = spark.createDataFrame([(1, "text\nSome example test.", "test\nSome example text."), (2, "a’c d", "a c d"), (3, "", "")], "id int, gt string, ocr string")
    rates = {r["id"]: r for r in E.text_error_rates(pairs, ["id"]).collect()}
    assert abs(rates[1]["cer"] - 2 / 23) < 1e-12 and rates[1]["wer"] == 0.5
    assert rates[2]["n_characters"] == 5 and rates[2]["cer"] == 0.2
    lines = spark.createDataFrame([(1, "text", "test"), (1, "Some example test.", "Some example text.")], "id int, gt string, ocr string")
    found = E.difference_map(E.differences(lines, ["id"]), ["id"]).first()["differences"]
    assert found == {"x :: s": 1, "s :: x": 1}


def test_alignments_are_smallest():
    """As many edits as the edit distance, on 1,000 random pairs, with and without halving; and what is equal stands in both."""
    rng = random.Random(8)
    for _ in range(1000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        for bits in (1 << 28, 4, 20):
            found = alignment.edits(a, b, bits)
            lost, new = {i for i, _ in found}, {j for _, j in found}
            assert len(found) == levenshtein(a, b)
            assert [x for i, x in enumerate(a) if i not in lost] == [y for j, y in enumerate(b) if j not in new]
            assert all(i is None or j is None or a[i] != b[j] for i, j in found)


def test_pairs_are_aligned_together(monkeypatch):
    """Many pairs at once, empty and unlike ones among them, have the alignments of the whole tables; those with few edits are never aligned alone."""
    rng = random.Random(3)
    pairs = [([], []), ([1], []), ([], [2, 2]), ([7] * 700, [8] * 900)]
    for _ in range(600):
        a = [rng.randrange(rng.choice((1, 2, 40))) for _ in range(rng.choice((3, 30, 400)))]
        b = [x for x in a for x in ([x], [], [rng.randrange(40)], [x, 1])[rng.randrange(4) if rng.random() < 0.1 else 0]]
        pairs.append((a, b if rng.random() < 0.8 else [rng.randrange(3) for _ in range(rng.randrange(60))]))

    def together(pairs):
        sides = [(np.array([v for p in pairs for v in p[s]], np.uint32), [len(p[s]) for p in pairs]) for s in (0, 1)]
        found = [[] for _ in pairs]
        for p, i, j in zip(*(c.tolist() for c in alignment.edits_of_pairs(*sides[0], *sides[1]))):
            found[p].append((None if i < 0 else i, None if j < 0 else j))
        return found

    monkeypatch.setattr(alignment, "traced", lambda a, b, a0, b0, band: alignment.traced_whole(a, b, a0, b0))
    expected = [alignment.edits(a, b) for a, b in pairs]
    monkeypatch.undo()
    assert together(pairs) == expected
    assert [alignment.edits(a, b, band=8) for a, b in pairs] == expected
    few = [k for k, found in enumerate(expected) if len(found) <= alignment.MOST_EDITS]
    monkeypatch.setattr(alignment, "edits", None)
    assert len(few) > 500 and together([pairs[k] for k in few]) == [expected[k] for k in few]


def test_differences_of_any_characters(spark):
    """Characters of one and of several code points and plain lines in one batch, equal and null lines among them."""
    rows = [(1, "cafe\u0301 x", "cafe x"), (2, "a\r\nb", "ab"), (3, None, "\u2019"), (4, "same", "same"), (5, "\U0001f468\u200d\U0001f469 d", "\U0001f468 d"), (6, "l\u00e0 1", "la 1"), (7, "ab\r", "b\n"), (8, None, None)]
    lines = spark.createDataFrame(rows, "id int, gt string, ocr string").coalesce(1)
    found = {(r["id"], r["gt"], r["ocr"], r["n"]) for r in E.differences(lines, ["id"]).collect()}
    family = "\U0001f468\u200d\U0001f469"
    assert found == {(1, "\u00e9", "e", 1), (2, "\r\n", "", 1), (3, "", "'", 1), (5, family, "\U0001f468", 1), (6, "\u00e0", "a", 1), (7, "a", "", 1), (7, "\r", "\n", 1)}
    by_word = {(r["id"], r["gt"], r["ocr"], r["n"]) for r in E.differences(lines, ["id"], words=True).collect()}
    assert by_word == {(1, "caf\u00e9", "cafe", 1), (2, "a", "ab", 1), (2, "b", "", 1), (6, "l\u00e0", "la", 1), (7, "ab", "b", 1)}


def test_difference_totals_in_one_pass(spark, tmp_path):
    """Lines are made and read once, and documents without a number are one row, as in SQL."""
    word = "the quick green hen never jumped twice"
    rows = [(1, f"{word}\n{word}", "en"), (None, word, "en"), (2, "one", "en"), (None, word, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = Q.difference_totals(spark, str(tmp_path))
    assert {(r["doc_id"], r["characters"], r["words"]) for r in found.collect()} == {(1, 4, 4), (None, 4, 4)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_differences_do_not_depend_on_length(spark):
    """One changed word of 150 to 400 words is one difference, and ten characters lost are ten."""
    rows = []
    for n in (150, 190, 200, 260, 400):
        words_ = [f"w{i % 7}x" for i in range(n)]
        rows.append((n, " ".join(words_), " ".join([*words_[:99], "other", *words_[100:]])))
    pairs = spark.createDataFrame(rows, "id int, gt string, ocr string")
    assert {(r["id"], r["gt"], r["ocr"], r["n"]) for r in E.differences(pairs, ["id"], words=True).collect()} == {(n, "w1x", "other", 1) for n, _, _ in rows}
    by_char = E.differences(pairs, ["id"]).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in by_char} == {levenshtein("w1x", "other")}


def test_characters_are_grapheme_clusters(spark):
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    pairs = [(1, "caf\u00e9 au lait", "cafe\u0301 au lait"), (2, family + " x", "y x"), (3, "a\u0323\u0301b", "ab"), (4, "plain", "plane")]
    df = spark.createDataFrame(pairs, "id int, gt string, ocr string")
    got = {r["id"]: (r["char_errors"], r["n_chars"], r["word_errors"], r["n_words"]) for r in E.line_errors(df).collect()}
    assert got == {1: (0, 12, 0, 3), 2: (1, 3, 1, 1), 3: (1, 2, 1, 1), 4: (2, 5, 1, 1)}
    found = {(r["id"], r["gt"], r["ocr"]) for r in E.differences(df.filter("id < 4"), ["id"]).collect()}
    assert found == {(2, family, "y"), (3, "\u1ea1\u0301", "a")}


def test_whole_lines_against_plain_python(spark):
    """Lines of both sides of 200 words as the queries take them."""
    lines = Q.whole_lines(spark, "/root/testdata/sf0.001").filter("length(gt) < 3000").limit(400).cache()
    rows = {(r["doc_id"], r["line_idx"]): r for r in E.line_errors(lines).collect()}
    for r in rows.values():
        fix = lambda t: E.characters(t.replace("\u2019", "'"))
        assert (r["char_errors"], r["n_chars"]) == (levenshtein(fix(r["gt"]), fix(r["ocr"])), len(fix(r["gt"])))
        assert r["word_errors"] == levenshtein(*(E.words_of(r[c].replace("\u2019", "'")) for c in ("gt", "ocr")))
    for words_, column in ((False, "char_errors"), (True, "word_errors")):
        counted = {(r["doc_id"], r["line_idx"]): r["n"] for r in E.differences(lines, ["doc_id", "line_idx"], words_).groupBy("doc_id", "line_idx").agg(F.sum("n").alias("n")).collect()}
        assert counted == {k: r[column] for k, r in rows.items() if r[column]}


def test_word_codes_beyond_the_surrogates(spark):
    """More distinct words than there are characters before the surrogates, one of them changed and one lost."""
    gt = [f"w{i}" for i in range(36_000)]
    ocr = [*gt[:35_990], "other", *gt[35_991:35_995], *gt[35_996:]]
    found = spark.createDataFrame([(gt, ocr)], "g array<string>, o array<string>").select(E.word_codes(F.col("g"), F.col("o")).alias("c"))
    row = found.select(F.length("c.ours").alias("n"), F.substring("c.ours", 35_900, 200).alias("a"), F.substring("c.theirs", 35_900, 200).alias("b"))
    row = row.select("n", E.edit_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert row["n"] == 36_000 and row["d"] == 2


def test_line_errors_of_equal_and_null_lines(spark):
    pairs = [(1, "a b", "a b"), (2, None, "x y"), (3, "é è", "è é"), (4, None, None)]
    rows = E.line_errors(spark.createDataFrame(pairs, "id int, gt string, ocr string")).orderBy("id").collect()
    assert [(r["char_errors"], r["word_errors"], r["n_words"]) for r in rows] == [(0, 0, 2), (3, 2, 0), (2, 2, 2), (0, 0, 0)]


def test_edit_distance_beyond_bands(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("ab") for _ in range(300))
    b = "".join(rng.choice("ab") for _ in range(300))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(E.edit_distance(F.col("a"), F.col("b")), F.levenshtein("a", "b")).first()
    assert row[0] == row[1]


def test_unions_keep_keys_together(spark):
    """Sides partitioned alike, of different sizes: a window over the union must see all rows of a key."""
    sides = [spark.range(n).select((F.col("id") % 50).alias("k"), "id").repartition(8, "k").groupBy("k", "id").count() for n in (200, 60_000)]
    rows = union(*[s.groupBy("k").agg(F.max("id").alias("id")) for s in sides])
    order = Window.partitionBy("k").orderBy("id")
    assert rows.withColumn("r", F.row_number().over(order)).filter("r = 1").count() == 50
