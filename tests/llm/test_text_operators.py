import binascii
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import common, html_blocks, html_extract, language_id, license_scan, license_texts, mixing, piece_sampling, quality_rules, token_counts, toxicity
from pagewright.llm.queries import tokenizer_path
from page_probes import LATER, PROBES

WORDS = {"en": "the of and with that from this have were there which".split(), "de": "der die und nicht eine werden über für mit schön".split()}


def documents(spark, rows):
    """rows: doc_id, text, lang, source; with a column whose name clashes with results."""
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, score int")


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang := rng.choice(["en", "de"]), 60), lang, f"s{i % 3}") for i in range(200)]
    rows += [(1000, None, "en", None), (1001, "", None, "s1"), (1002, "123 !!", "en", "s1"), (None, "the of", None, "s1"), (5, rows[5][1], rows[5][2], "s2")]
    return documents(spark, rows)


def test_language_id(spark, docs):
    model = language_id.train(docs, sample=50)
    got = language_id.identify(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["text"] and re.search(r"[^\W\d_]", r["text"]):
            assert r["lang_pred"] == (r["lang"] or "en") and 0 < r["lang_score"] <= 1
        else:
            assert r["lang_pred"] == "und" and r["lang_score"] == 0
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(docs.limit(0))).collect()} == {"und"}


def plain_grams(text):
    """Every n-gram of a text, letters in lower case and all else one space."""
    kept = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    if not kept.strip():
        return []
    return [kept[i : i + n] for n in language_id.ORDERS for i in range(len(kept) - n + 1) if kept[i : i + n] != " "]


def test_language_id_against_plain_naive_bayes(spark, monkeypatch):
    """Training and scoring with n-grams as they are; buckets may collide, so the few languages are told apart all the same."""
    rng = random.Random(12)
    alphabets = {"a": "abcde é", "b": "cdefg ü", "c": "aeg ßé "}
    make = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    rows = [(i, make(k := rng.choice("abc"), rng.randint(3, 60)), k, "s") for i in range(600)]
    df = documents(spark, rows)
    model = language_id.train(df)
    kept = [r for r in rows if not binascii.crc32(str(r[0]).encode()) % 4 == 2]
    counts = {k: Counter() for k in alphabets}
    for _, t, k, _ in kept:
        counts[k].update(plain_grams(t))
    prior = Counter(r[2] for r in kept)

    def plain(text):
        found = plain_grams(text)
        if not found:
            return "und", 0.0
        log = {k: np.log(prior[k] / len(kept)) + sum(np.log((counts[k][g] + 0.1) / (sum(counts[k].values()) + 0.1 * language_id.BUCKETS)) for g in found) for k in alphabets}
        best = max(sorted(log), key=log.get)
        return best, 1 / sum(np.exp(v - log[best]) for v in log.values())

    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(df, model).collect()}
    for i, t, _, _ in rows:
        name, score = plain(t)
        assert got[i][0] == name and abs(got[i][1] - score) < 1e-6
    texts = [" ".join(r[1] for r in rows[:200]), *[r[1] for r in rows[:30]], "", "é" * 50]
    whole = model.score(texts)
    monkeypatch.setattr(language_id, "CELLS", 1)
    few = model.score(texts)
    assert few[0] == whole[0] and np.allclose(few[1], whole[1]) and np.allclose(few[2], whole[2])
    monkeypatch.setattr(language_id, "CHUNK", 64)
    parts = model.score(texts)
    assert parts[0] == whole[0] and np.allclose(parts[1], whole[1], atol=1e-3)


def test_language_id_of_long_texts_and_clashing_names(spark):
    rows = [(1, "the of and " * 40_000, "en", "s"), (2, "der die und " * 40_000, "de", "s"), (3, "x" * 300_000, None, "s"), (4, "der und nicht die", "de", "s"), (5, "the of and with", "en", "s")]
    df = documents(spark, rows).withColumn("lang_pred", F.lit(7)).withColumn("lang_score", F.col("text"))
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4, 5)] == ["en", "de", "de", "en"] and got[3]["lang_pred"] in ("en", "de")
    assert set(got[1].asDict()) == {*df.columns, "lang_fit"}


def test_many_languages(spark, monkeypatch):
    """Beyond the most classes the most frequent are learned, and nothing raises."""
    monkeypatch.setattr(common, "MOST_CLASSES", 3)
    rows = [(i, f"{'abcdefghij'[i % 7]} word", f"l{i % 7}", "s") for i in range(0, 400) if i % 7 < 3 or i < 100]
    model = language_id.train(documents(spark, rows))
    assert model.languages == ["l0", "l1", "l2"]
    monkeypatch.setattr(common, "MOST_CLASSES", 1000)
    rows = [(i, f"text number {i}", f"x{i}", "s") for i in range(0, 1400)]
    model = language_id.train(documents(spark, rows))
    assert len(model.languages) == 1000 and language_id.identify(documents(spark, rows[:50]), model).count() == 50


def test_language_score_does_not_depend_on_the_batch():
    counts = np.random.default_rng(1).random((language_id.BUCKETS, 2)) + 0.1
    model = language_id.Model(["a", "b"], np.log(counts / counts.sum(axis=0)), np.log([0.5, 0.5]))
    texts = ["ab!cd  e", "", "é", "x" * 5000, " ", "a-b"]
    whole = model.score(texts)
    for i, t in enumerate(texts):
        one = model.score([t])
        assert one[0][0] == whole[0][i] and one[1][0] == whole[1][i]


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_measures():
    rng = random.Random(4)
    texts = ["", " \n\n", "a", "x y\nx y\n \nx y", "\x0b\x0ca b  "]
    texts += ["".join(rng.choice(["ab", "c", " ", " ", "\n", "#", "é"]) for _ in range(rng.randint(0, 150))) for _ in range(150)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(100)]
    got = quality_rules.measure_texts(texts)
    for i, t in enumerate(texts):
        assert tuple(int(got[m][i]) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_measures(t)


def test_quality_votes_find_bad_documents():
    rng = np.random.default_rng(0)
    bad = rng.random(4000) < 0.15
    against = np.where(bad[:, None], rng.random((4000, 6)) < 0.6, rng.random((4000, 6)) < 0.02)
    votes = np.where(against, 2, np.where(rng.random((4000, 6)) < 0.2, 0, 1))
    patterns, place, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = quality_rules.fit_votes(patterns, n.astype(float)).posterior(patterns)[place.ravel()] >= 0.5
    assert (good == ~bad).mean() > 0.98


def test_quality_rules(spark, docs):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == docs.count() and {r["kept"] for r in rows if r["n_words"] < 20} == {False}
    assert sum(r["kept"] for r in rows) > 150
    assert quality_rules.judge(docs.limit(0)).count() == 0
    kept = quality_rules.judge(docs.withColumn("quality", F.lit("x")).withColumn("n_words", F.lit("y")), keep=["lang", "quality", "n_words"])
    assert {"lang", "quality", "n_words"} <= set(kept.columns) and kept.schema["quality"].dataType.simpleString() == "double"
    assert sorted(map(repr, kept.drop("lang").select(*rows[0].asDict()).collect())) == sorted(map(repr, rows))


def test_quality_of_long_texts(spark):
    long, again = " ".join(f"word{i}" for i in range(100_000)), "to be or not to be that is the question " * 20_000
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(spark, [(1, long, "en", "s"), (2, again, "en", "s"), (2, again, "en", "s")])).collect()}
    assert got[1]["n_words"] == 100_000 and got[1]["n_repeat_words"] == 0 and not got[1]["base_failed"]
    assert got[2]["n_repeat_words"] == got[2]["n_words"] == 200_000 and got[2]["base_failed"] and not got[2]["kept"]


def test_base_failures(spark):
    """At the limits: 20 words, and 30 in 100 of them in repeated windows."""
    fresh = lambda n: [f"w{i}" for i in range(n)]
    run = [f"r{i}" for i in range(9)]
    texts = [fresh(19), fresh(20), [*run, *fresh(42), *run], [*run, *fresh(41), *run]]
    rows = quality_rules.judge(documents(spark, [(i, " ".join(w), "en", "s") for i, w in enumerate(texts)])).collect()
    assert [r["base_failed"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [True, False, False, True]


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, "en", 40).split()
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["gorblax", "GORBLAXED", "g0rblax", "gоrblax"])  # the last has a Cyrillic letter
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(toxic)))
    rows += [(2000, None, "en", "s"), (2001, "", "en", "s")]
    docs = documents(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (3000, None), (0, 1)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, marks, sample=200)
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[i]["tox_score"] >= 0.3) == bool(t) for i, t in labels)
    assert 0 <= got[2000]["tox_score"] < 0.3 and got[2000]["tox_hits"] == 0
    assert toxicity.score(docs, toxicity.train(docs, marks.limit(0))).filter("tox_score >= 0.3").count() == 0


def test_folding():
    for text in ("1d10t", "id\u200biot", "i\u00addiot", "іdіоt", "IDIÓT", "i.d.i.o.t", "I D I O T", "ɪԁɪᴏᴛ", "𝓲𝓭𝓲𝓸𝓽", "ｉｄｉｏｔ"):
        assert toxicity.fold(text) == " idiot ", text
    assert toxicity.fold("a b c") == " a b c " and toxicity.fold("") == "  " and toxicity.fold("x - I am here") == " x i am here "


def test_toxic_hits_against_a_plain_matcher():
    """Every entry tried at every word, and every exception phrase at every place."""
    rng = random.Random(13)
    for _ in range(300):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(0, 12))]
        entries = {" " + "".join(rng.choice("ab") for _ in range(rng.randint(2, 4))) + rng.choice(["", " "]): float(rng.randint(1, 9)) for _ in range(4)}
        exempt = tuple({" ".join(rng.choices(words, k=2)) for _ in range(2)} if words else ())
        lexicon, total, hits = toxicity.Lexicon(entries, exempt), 0.0, 0
        for i, w in enumerate(words):
            fits = [v for e, v in entries.items() if (w == e.strip() if e.endswith(" ") else w.startswith(e.strip()))]
            phrase = any(words[j : j + 2] == x.split() for x in exempt for j in (i - 1, i) if j >= 0)
            if fits and not phrase:
                total, hits = total + max(fits), hits + 1
        raw, n, size = lexicon.raw([" ".join(words).upper()])
        assert (raw[0], n[0], size[0]) == (total, hits, len(words))


def test_exceptions_are_learned(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(900):
        text = prose(rng, "en", 30)
        if i % 3 == 0:
            text += " you gorblax"
        elif i % 60 == 1:
            text += " gorblax collection"
        rows.append((i, text + " end", "en", "s"))
        labels.append((i, int(i % 3 == 0)))
    docs = documents(spark, rows).withColumn("tox_score", F.lit("x"))
    lexicon = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "gorblax collection" in lexicon.exceptions and not any("you" in x.split() for x in lexicon.exceptions)
    got = {r["doc_id"]: r["tox_score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels)
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    nothing = toxicity.train(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.score(docs, nothing).filter("tox_score >= 0.3").count() == 0
    long = documents(spark, [(1, "the of " * 150_000 + "gorblax", "en", "s"), (2, "gorblax " * 100_000, "en", "s")])
    assert [r["tox_hits"] for r in toxicity.score(long, lexicon).orderBy("doc_id").collect()] == [1, 100_000]


def test_toxic_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon({" idiot": 1.0, " nice": 0.5}, exceptions=("idiot proof",))
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        _, hits, _ = lexicon.raw(["idiot proof nice " * n])
        took.append(time.process_time() - began)
        assert hits.tolist() == [n]
    assert took[1] < 8 * took[0] + 0.5


def test_toxic_exceptions_against_a_plain_check():
    rng = random.Random(17)
    lexicon = toxicity.Lexicon({" a": 1.0, " b ": 2.0, " cc": 3.0}, exceptions=("a b", "b a b", "cc a", "d cc"))
    for _ in range(200):
        folded = toxicity.fold(" ".join(rng.choice(["aa", "a", "b", "cc", "d"]) for _ in range(rng.randint(0, 14))))
        phrases = [" " + " ".join(toxicity.fold(p).split()) + " " for p in lexicon.exceptions]
        free = [(m.start(), m.start() + len(p) - 1) for p in phrases for m in re.finditer(f"(?={re.escape(p)})", folded)]
        plain = toxicity.Lexicon(lexicon.weights).hits(folded)
        assert lexicon.hits(folded) == {at: w for at, w in plain.items() if not any(x <= at < y for x, y in free)}


def test_toxic_exceptions_and_longest_entry():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " tras": 1.0, " idio": 3.0}, ("trash can",))
    raw, hits, words = lexicon.raw(["Trash trashy 1d10t", "a trash can", "", "strash"])
    assert raw.tolist() == [6.0, 0.0, 0.0, 0.0] and hits.tolist() == [3, 0, 0, 0] and words.tolist() == [3, 3, 0, 1]


def test_token_counts(spark, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    counter = token_counts.Counter(path)
    rng = random.Random(6)
    texts = ["", "a", "<|endoftext|> x", "\n\n  it's  ", "x" * 300] + ["".join(rng.choice(["ab", " ", "\n", "é", "1", "'s", "  "]) for _ in range(200)) for _ in range(60)]
    whole = [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.counts(texts).tolist() == whole
    for t, n in zip(texts, whole):
        parts = token_counts.pieces(t, 7)
        assert "".join(parts) == t and sum(len(counter.tokenizer.encode(p, add_special_tokens=False).ids) for p in parts) == n
    for t in [*texts, "a b  c\n d", "a\0 b", " x y", "x\u00a0 y", "one two\nthree four", "\x1c a"]:
        assert "".join(token_counts.words(t)) == t
    for most in (0, 5):  # whatever is kept between packs
        monkeypatch.setattr(token_counts, "KEPT", most)
        monkeypatch.setattr(token_counts, "KEPT_CHARS", most)
        monkeypatch.setattr(token_counts, "PACK_BYTES", 300)
        monkeypatch.setattr(token_counts, "PIECE_CHARS", 50)
        assert token_counts.Counter(path).counts([*texts, "new\nlines " * 90, *texts]).tolist() == [*whole, len(counter.tokenizer.encode("new\nlines " * 90, add_special_tokens=False).ids), *whole]
    monkeypatch.undo()
    odd = "!!\x1c!!\x1d\x1e a\x1fb "
    assert sum(len(counter.tokenizer.encode(p, add_special_tokens=False).ids) for p in token_counts.pieces(odd * 30, 5)) == len(counter.tokenizer.encode(odd * 30, add_special_tokens=False).ids)
    long = "The quick brown fox, it's 12 years old — naïve.\n\n  " * 8000
    df = documents(spark, [(7, long, "en", "s"), (8, "x" * 60_000, "en", "s")])
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df.withColumn("n_tokens", F.lit("x")), path).collect()}
    assert got == {i: (len(t.encode()), len(counter.tokenizer.encode(t, add_special_tokens=False).ids), True) for i, t in ((7, long), (8, "x" * 60_000))}
    assert token_counts.count_tokens(df.limit(0), path).count() == 0
    df = documents(spark, [(1, None, "en", "s"), (2, "é " * 600, "en", "s"), (2, "é " * 600, "en", "s"), (None, "a", None, None)])
    got = sorted(map(tuple, token_counts.count_tokens(df, path).collect()), key=repr)
    assert (1, 0, 0, False) in got and got.count(got[1]) == 2 and len(got) == 4


def test_license_places_against_brute_force():
    auto = license_scan.Automaton(license_scan.PHRASES, license_scan.TEMPLATES)
    rng = random.Random(7)
    vocabulary = "mit MIT apache general public License the gnu under licensed version 2 0 cc by nc é x".split()
    for _ in range(400):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want = sorted((i, p) for p, q in enumerate(license_scan.PHRASES) for i in range(len(words)) if words[i : i + len(q.split())] == q.split())
        n, places, _, _ = license_scan.scan_text(auto, text)
        assert n == len(words) and sorted(places) == want


def test_license_chain_against_brute_force():
    def brute(pieces):
        best = 0
        for mask in range(1 << len(pieces)):
            chosen = sorted(p for i, p in enumerate(pieces) if mask >> i & 1)
            if all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(p[2] for p in chosen))
        return best

    rng = random.Random(8)
    for _ in range(300):
        pieces = [(rng.randint(0, 20), rng.randint(0, 20), rng.randint(1, 6)) for _ in range(rng.randint(1, 7))]
        assert license_scan.chain(pieces)[0] == brute(pieces)


def test_matching_statistics_against_brute_force(monkeypatch):
    monkeypatch.setattr(license_scan, "LEAST_CLIP", 3)
    """At every word the longest run of words, ending there, that stands in some template."""
    rng = random.Random(15)
    templates = {f"t{i}": [" ".join(rng.choice("abcd") for _ in range(rng.randint(3, 14)))] for i in range(4)}
    auto = license_scan.Automaton({"a b": "x"}, templates)
    whole = [x[0].split() for x in templates.values()] + [["a", "b"]]
    occurs = lambda run: any(t[i : i + len(run)] == run for t in whole for i in range(len(t)))
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randint(1, 25))]
        longest = [max((n for n in range(i + 2) if occurs(words[i + 1 - n : i + 1])), default=0) for i in range(len(words))]
        # Maximal matches are those that the next word does not lengthen.
        want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= license_scan.LEAST_MATCH and (i + 1 == len(words) or longest[i + 1] <= n)]
        _, found, clipped = auto.stream([auto.number.get(w.encode(), -1) for w in words], 0)
        assert [(a, n) for a, n, _ in found] == want
        for a, n, state in found:
            ends = {(t, e) for t, e in auto.ends[state]}
            assert ends == {(t, i + n) for t, x in enumerate(whole[:-1]) for i in range(len(x) - n + 1) if x[i : i + n] == words[a : a + n]}
        # Clipped matches are all runs that a template shares and that neither side lengthens, on every diagonal.
        runs = set()
        for t, x in enumerate(whole[:-1]):
            for a, b in itertools.product(range(len(words)), range(len(x))):
                if words[a] == x[b] and not (a and b and words[a - 1] == x[b - 1]):
                    n = next((k for k in range(min(len(words) - a, len(x) - b)) if words[a + k] != x[b + k]), min(len(words) - a, len(x) - b))
                    runs |= {(t, a, b, n)} if n >= license_scan.LEAST_CLIP else set()
        assert len(clipped) == len(set(clipped)) and set(clipped) == runs


def test_license_spans():
    auto = license_scan.Automaton(license_scan.PHRASES, license_scan.TEMPLATES)
    whole = license_scan.TEMPLATES["mit"][-1]
    size = len(license_scan.words_of(whole))

    def spans(text):
        return [(a, b, round(share, 2)) for label, a, b, share in license_scan.scan_text(auto, text)[2] if label == "mit" and b - a > size // 2 and share > 0.9]

    assert spans(whole) == [(0, size, 1.0)]
    for between in ("", "other words of some kind " * 30):
        gap = len(between.split())
        assert spans(f"{whole} {between} {whole} {between} {whole}") == [(i * (size + gap), i * (size + gap) + size, 1.0) for i in range(3)]
    words = whole.split()
    labels = lambda text: license_scan.labels_of(*license_scan.scan_text(auto, text)[2:], license_scan.LEAST_COVER)
    for filler in (10, 600):  # words of a licence strewn over a text are no licence
        strewn = " ".join(" ".join(words[i : i + 3]) + " filler" * filler for i in range(0, len(words), 3))
        assert labels(strewn) == set()
    assert labels(" ".join(words[:60] + ["Some", "Name"] + words[60:])) == {"mit"}
    for label in ("bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "bsl", "mpl", "zlib", "apache", "gpl"):
        text = max(license_scan.TEMPLATES[label], key=len).split()
        assert labels(" ".join(text)) == {label}
        third = len(text) // 3  # with other words at two places
        assert labels(" ".join([*text[:third], "Copyright", "2020", "Someone", *text[third : 2 * third], "Inc", *text[2 * third :]])) == {label}


def test_quoting_more_of_a_licence_loses_no_label():
    """Every beginning of the MIT text that holds its first clause, every end that holds its last, and whole sections of long licences."""
    auto = license_scan.automaton_of(tuple(license_scan.PHRASES.items()), tuple((k, tuple(v)) for k, v in license_scan.TEMPLATES.items()))
    labels = lambda text: license_scan.labels_of(*license_scan.scan_text(auto, text)[2:], license_scan.LEAST_COVER)
    words = license_scan.TEMPLATES["mit"][-1].split()
    first, last = (len(license_scan.TEMPLATES["mit"][i].split()) for i in (1, 2))
    for n in range(min(first, last), len(words) + 1):
        assert n < first or labels(" ".join(words[:n])) == {"mit"}
        assert n < last or "mit" in labels(" ".join(words[-n:]))
    for label, names in license_texts.LONG.items():
        for name in names:
            whole, *sections = license_texts.long_texts(name)
            assert labels(whole) == {label} and len(sections) > 5
            assert all(label in labels(x) for x in sections)
    said = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    assert labels(said + "either version 3 of the License, or (at your option) any later version.") == {"gpl"}


def test_license_spans_of_long_texts():
    took = []
    whole = license_scan.TEMPLATES["mit"][-1]
    auto = license_scan.Automaton(license_scan.PHRASES, license_scan.TEMPLATES)
    for n in (40, 160):
        began = time.process_time()
        found = license_scan.scan_text(auto, f"{whole} the software is provided to any person " * n)[2]
        took.append(time.process_time() - began)
        assert sum(x[0] == "mit" and x[3] == 1 and x[2] - x[1] > 150 for x in found) == n
    assert took[1] < 8 * took[0] + 0.5


def test_licenses_of_odd_rows(spark):
    rows = [(1, "mit license " * 50_000, "en", "s"), (2, "", "en", "s"), (2, "", "en", "s"), (None, "Apache License", None, None)]
    df = documents(spark, rows).withColumn("labels", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted(license_scan.scan_licenses(df).collect(), key=lambda r: r["n_words"])
    assert [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in got] == [
        (2, 0, 0, None, None), (2, 0, 0, None, None), (None, 2, 1, 0, 0), (1, 100_000, 50_000, 0, 99_998),
    ]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_licenses(spark):
    df = documents(spark, [(1, "Released under the MIT License.", "en", "s"), (2, "Licensed under CC BY-NC 4.0.", "en", "s"), (3, None, None, None), (4, "permission", "en", "s")])
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    assert (got[1]["base_labels"], got[1]["labels"], got[1]["first_word"], got[1]["n_base"]) == ("mit", "mit", 3, 1)
    assert (got[2]["base_labels"], got[2]["labels"], got[2]["first_word"], got[2]["score"]) == ("", "cc-by-nc", None, 1.0)
    assert got[3]["n_words"] == 0 and got[4]["score"] == 0


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.Pieces(tokenizer_path("piece_bpe_32k.model"))


def nested(found, texts):
    """For each text its samples: (ids, log-probability, perturbed value, inclusion probability), best first."""
    out = [[] for _ in texts]
    for i, n in enumerate(found.owner.tolist()):
        out[n].append((found.ids[found.starts[i] : found.starts[i + 1]].tolist(), found.logp[i], found.value[i], found.inclusion[i]))
        assert found.rank[i] == len(out[n])
    return out


def test_samples_are_distinct_and_decode(pieces):
    rng = random.Random(9)
    texts = ["", " ", "a  b\n\tc", "日本 ẞ \U0001f600", "x" * 200] + ["".join(rng.choice("abé \n") for _ in range(80)) for _ in range(40)]
    keys = np.arange(len(texts), dtype=np.uint64)
    for t, found in zip(texts, nested(piece_sampling.sample_batch(pieces, texts, keys, 4), texts)):
        ids = [tuple(x[0]) for x in found]
        assert len(set(ids)) == len(ids) and all(pieces.processor.decode(list(i)) == t for i in ids)
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)


def every(pieces, s):
    return [()] if not s else [(pieces.number[s[:j]], *r) for j in range(1, len(s) + 1) if s[:j] in pieces.number for r in every(pieces, s[j:])]


def test_sampling_follows_the_lattice(pieces):
    first, second = (every(pieces, s) for s in pieces.segments("the hat"))
    paths = [a + b for a in first for b in second]
    p = np.exp([sum(pieces.weight[i] for i in x) for x in paths])
    p /= p.sum()
    n = 20_000
    texts = ["the hat"] * n
    found = nested(piece_sampling.sample_batch(pieces, texts, piece_sampling.mix64(np.arange(n, dtype=np.uint64)), 3), texts)
    top, estimate = Counter(tuple(f[0][0]) for f in found), Counter()
    for f in found:
        for ids, logp, _, chance in f:
            assert abs(logp - np.log(p[paths.index(tuple(ids))])) < 1e-9
            estimate[tuple(ids)] += np.exp(logp) / chance / n
    for x, q in zip(paths, p):
        assert abs(top[x] / n - q) < 0.015 and abs(estimate[x] - q) < 0.02


def test_all_segmentations_are_drawn_once(pieces):
    texts = ["of", "the", "a", ""]
    found = nested(piece_sampling.sample_batch(pieces, texts, np.arange(4, dtype=np.uint64), 1000), texts)
    for t, got in zip(texts, found):
        want = every(pieces, pieces.segments(t)[0]) if t else [()]
        assert sorted(tuple(x[0]) for x in got) == sorted(want) and all(x[3] == 1 for x in got)


def test_long_words_have_probabilities(pieces):
    word = "reconsideration" * 9
    (found,) = nested(piece_sampling.sample_batch(pieces, [word], np.array([3], np.uint64), 2), [word])
    for ids, logp, _, _ in found:
        text, total = pieces.segments(word)[0], [0.0]
        for end in range(1, len(text) + 1):
            ways = [total[a] + pieces.weight[pieces.number[text[a:end]]] for a in range(max(0, end - pieces.table.longest), end) if text[a:end] in pieces.number]
            total.append(np.logaddexp.reduce(ways))
        assert abs(logp - (sum(pieces.weight[i] for i in ids) - total[-1])) < 1e-6


def test_samples_do_not_depend_on_the_batch(pieces):
    texts = ["of the people", "by the people", "for the people " * 20]
    keys = np.array([5, 6, 7], np.uint64)
    whole = nested(piece_sampling.sample_batch(pieces, texts, keys, 3), texts)
    for i, t in enumerate(texts):
        assert nested(piece_sampling.sample_batch(pieces, [t], keys[i : i + 1], 3), [t]) == [whole[i]]


def test_encoding_and_decoding(spark, docs):
    path = tokenizer_path("piece_bpe_32k.model")
    made = piece_sampling.sample_pieces(docs.withColumn("sp_rank", F.lit("x")), path, k=2)
    back = piece_sampling.decode_pieces(made, path).collect()
    assert all(r["sp_text"] == (r["text"] or "") and r["sp_exact"] for r in back)
    assert {r["sp_rank"] for r in back if not r["text"]} == {1} and len(back) == 2 * docs.count() - 2
    assert piece_sampling.sample_pieces(docs.limit(0), path).count() == 0
    narrow = piece_sampling.sample_pieces(docs, path, keep=["doc_id"])
    assert narrow.columns == ["doc_id", *piece_sampling.ADDED] and sorted(r["sp_ids"] for r in narrow.collect()) == sorted(r["sp_ids"] for r in back)


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs.drop("score").withColumn("mix_copy", F.lit("x")), {"s0": 3, "s1": 1}, total=4000).collect()
    shares = Counter(r["source"] for r in got)
    assert set(shares) == {"s0", "s1"} and abs(shares["s0"] / len(got) - 0.75) < 0.03 and abs(len(got) - 4000) < 250
    by = Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    assert all(r["mix_copies"] == by[r["doc_id"], r["text"], r["source"]] for r in got if r["doc_id"] != 5)
    assert [r["mix_order"] for r in got] == sorted(r["mix_order"] for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs).filter("source IS NULL").count() >= 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"s0": -1})


def test_mixing_many_sources_and_ties(spark, docs, monkeypatch):
    """A salted join gives the same rows; copies with the same place have an order of their own."""
    rows = docs.drop("score").union(docs.drop("score").filter("doc_id < 3").withColumn("text", F.concat("text", F.lit("!"))))
    few = [tuple(r) for r in mixing.mix_sources(rows, total=3000).collect()]
    assert [r["mix_order"] for r in mixing.mix_sources(rows, total=3000).collect()] == sorted(r[-1] for r in few)
    again = [tuple(r) for r in mixing.mix_sources(rows.repartition(3).orderBy(F.desc("text")), total=3000).collect()]
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert few == again == [tuple(r) for r in mixing.mix_sources(rows, total=3000).collect()]
    large = mixing.mix_sources(docs.filter("source = 's0'"), total=67 * 60.0).collect()  # a mean that takes several parts
    assert abs(len(large) - 67 * 60) < 300 and max(r["mix_copies"] for r in large) > 60


def test_poisson_quantiles(spark):
    import math

    df = spark.range(3000).select(((F.col("id") + 0.5) / 3000).alias("u"))
    for mean in (0.0, 0.3, 4.0, 31.9):
        got = [r[0] for r in df.select(mixing.poisson_quantile(F.col("u"), mixing.poisson_steps(F.lit(mean)))).collect()]
        assert abs(np.mean(got) - mean) < 0.02 + mean / 500 and abs(np.var(got) - mean) < 0.05 + mean / 50
        assert all(sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k)) < (j + 0.5) / 3000 + 1e-9 for j, k in enumerate(got))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body><nav><ul><li><a href=1>Home<li><a href=2>About</ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy this now.</div><article><h1>A title &amp; more</h1><p>First   paragraph of the text,<br>with several words &lt;here&gt;.<p>Second one goes on as well, and it is long enough.</article>
<footer>&copy; 2020 Somebody</footer>"""


def test_blocks():
    assert [b.text for b in html_blocks.blocks(PAGE)] == [
        "T", "Home", "About", "Buy this now.", "A title & more", "First paragraph of the text, with several words <here>.",
        "Second one goes on as well, and it is long enough.", "© 2020 Somebody",
    ]
    assert html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("a < b")] == ["a < b"]
    assert html_blocks.blocks("<script>never closed") == []


def test_attributes_and_hidden_parts():
    names = lambda page: [sorted(b.names) for b in html_blocks.blocks(page)]
    assert names('<div data-id="ad" xclass=nav>a</div>') == [[]] and names("<div id=ad class='x nav'>a</div>") == [["ad", "nav"]]
    assert names('<p style="color:red;display : none">a<p hidden>b<p aria-hidden="true">c') == [["hidden"], ["hidden"], ["ariahidden"]]
    assert [b.text for b in html_blocks.blocks('<p class="a" ">one</p><p title="x > y">two</p><p title=\'">three</p><p>a<i hidden>b</i>c</p>')] == ["one", "two", "three", "a", "b", "c"]
    assert [b.text for b in html_blocks.blocks("<p>a<svg><text>b</text></svg>c</p>")] == ["ac"]


@pytest.fixture(scope="module")
def field(spark):
    """As it is trained in the registered query."""
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_html_extraction(spark, field):
    rows = [(i, f"u{i}", PAGE, "x") for i in range(20)] + [(50, None, None, "x"), (51, "u", "", "x"), (51, "u", "", "x"), (None, None, "<p>" + "Words of a long text. " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, field).collect()
    want = "A title & more First paragraph of the text, with several words <here>. Second one goes on as well, and it is long enough."
    assert len(got) == 24 and all(r["text"] == (want if r["page_id"] < 20 else "") and r["n_chars"] == len(r["text"]) for r in got if r["page_id"] is not None)
    assert [r["n_chars"] for r in got if r["page_id"] is None] == [50_000 * 22 - 1]
    assert html_extract.extract(pages.limit(0), field).count() == 0
    assert isinstance(html_extract.main_text(html_extract.train(pages.limit(0), made=20), PAGE)[0], str)


@pytest.mark.parametrize("kind, page, want", PROBES + LATER, ids=[p[0] for p in PROBES + LATER])
def test_pages_written_by_hand(field, kind, page, want):
    assert html_extract.main_text(field, page)[0] == want


def test_blocks_cost_grows_with_the_page():
    """Elements left open, nested or not, do not make later blocks dearer; nor do pages without any block element crash."""
    for make in (lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: "<div>x" * n, lambda n: "<b><p>x" * n, lambda n: "<i class='x'><p>x" * n, lambda n: "<center>" * n + "<p>x</p>" * n, lambda n: "<b>x</i>" * n):
        took = []
        for n in (3000, 12_000):
            began = time.process_time()
            html_blocks.features(html_blocks.blocks(make(n)))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5
    for page in ("hello", "<b>x", "<html>x", "<br><br>", "a<br><br>b"):
        assert all(html_blocks.features(html_blocks.blocks(page)))
    assert [b.text for b in html_blocks.blocks("a<br>b<br>\n<br/>c")] == ["a b", "c"]


def test_field_on_held_out_layouts():
    rng = random.Random(11)
    texts = [f"Sentence number {i} of a text. It has some words, and then it ends." for i in range(30)]
    field = html_extract.fit_field([html_extract.labelled(rng, texts) for _ in range(600)])
    right = total = 0
    for _ in range(100):
        found, labels = html_extract.labelled(rng, texts)
        right += sum(a == b for a, b in zip(field.decode(found), labels))
        total += len(labels)
    assert right / total > 0.96


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(50):
        names = [[f"f{rng.integers(4)}"] for _ in range(rng.integers(1, 7))]
        field = html_extract.Field({f"f{i}": tuple(rng.normal(size=2)) for i in range(4)}, rng.normal(size=(2, 2)), rng.normal(size=2))
        value = lambda ys: field.start[ys[0]] + sum(field.emit[n[0]][y] for n, y in zip(names, ys)) + sum(field.pair[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        assert abs(value(field.decode(names)) - max(map(value, itertools.product((0, 1), repeat=len(names))))) < 1e-9
