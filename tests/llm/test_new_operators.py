import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import common, fill_in_middle as M, queries, simhash as H, whitening as W

SMALL = "/root/testdata/sf0.001"


def plain_fim(doc_id, text):
    """The row that op11 is to return, written out over code points."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def odd_texts():
    rng = random.Random(5)
    shared = "".join(rng.choice("abc é漢\U0001f600 ") for _ in range(9000))
    texts = [None, "", "x", "<P>", "a<S", "<", "S><M", "é" * 700, "\U0001f600" * 3000, "no end " * 40_000, "<" + "P>" * 3, "x" * 200_000]
    for _ in range(60):
        texts.append("".join(rng.choice("ab<PSM> é漢") for _ in range(rng.randint(0, 40))))
        texts.append("".join(rng.choice("abé漢 ") for _ in range(rng.randint(0, 3000))) + shared[rng.randint(0, 50) :])
    for at in (255, 256, 257, 1023, 5000):  # a marker that a chunk's end may cut
        texts.append(shared[:at] + "<M>" + shared[at:])
    return texts


def test_fill_in_middle(spark):
    rows = [(None if i == 7 else i // 2, t, "x", i) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_text string, i int").repartition(3)
    made = M.fill_in_middle(docs).withColumn("back", M.restored())
    got = sorted((str(r["doc_id"]), r["back"], r["fim_n"], r["fim_form"], r["fim_prefix"] or 0, r["fim_middle"] or 0, r["fim_text"]) for r in made.collect())
    want = sorted((str(d), t or "", n, form, a or 0, b or 0, out) for d, t, _, _ in rows for n, form, a, b, out in [plain_fim(d, t)])
    assert got == want
    assert M.fill_in_middle(docs.limit(0)).count() == 0
    forms = M.fill_in_middle(docs, plain_from=0).select("fim_form").distinct().collect()
    assert [r[0] for r in forms] == ["plain"]


def test_chunks_of_shared_passages_are_found_in_the_memo():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    memo = M.Memo()
    for i in range(6):  # moved by another beginning each time
        M.Layout(rng.integers(97, 123, 100 + 37 * i, dtype=np.uint8).tobytes() + passage, memo)
    assert memo.hits > 4 * 30 and memo.hits > 3 * memo.misses
    small = M.Memo(5000)
    for _ in range(2):
        layout = M.Layout(passage, small)
        assert layout.points == 60_000 and layout.place(12_345) == 12_345 and small.size <= 5000
    data = np.frombuffer(passage, np.uint8)
    direct = np.zeros(len(data) - M.WINDOW + 1, np.uint64)
    for j in range(M.WINDOW):
        direct += M.GEAR[data[M.WINDOW - 1 - j : len(data) - j]] << np.uint64(j)
    assert (M.rolling(data)[M.WINDOW - 1 :] == direct).all()


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 50_000, dtype=np.int64).astype(np.uint8)
    whole = M.chunk_ends(data)
    monkeypatch.setattr(M, "STRETCH", 3001)
    assert M.chunk_ends(data) == whole and whole[-1] == len(data)


def test_fill_in_middle_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op11_fill_in_middle(spark, SMALL).collect():
        n, form, a, b, out = plain_fim(r["doc_id"], docs[r["doc_id"]])
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, a, b)
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(out), sha(docs[r["doc_id"]]))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest key of every row's component, by comparing all pairs of (key, fingerprint) rows."""
    label = list(range(len(rows)))
    links = [[j for j in range(len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4] for i in range(len(rows))]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min(label[j] for j in links[i])
            changed |= low < label[i]
            label[i] = min(low, label[i])
    least = {}
    for (key, _), k in zip(rows, label):
        if key is not None:
            least[k] = min(least.get(k, key), key)
    return [least.get(k) for k in label]


def test_simhash_query(spark):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {k: (f"{f:016x}", c) for (k, f), c in zip(rows, plain_components(rows))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash(spark, SMALL).collect()}
    assert got == want


def test_simhash_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(H, "STRETCH", 64)
    monkeypatch.setattr(H, "SHINGLES", 7)
    texts = [None, "", " \n", "one", "One two THREE", "a b c d", "É a b c d e", " x " * 500, "w " * 3 + "end", *("".join(random.Random(i).choice("ab \n") for _ in range(400)) for i in range(20))]
    rows = [(i if i % 5 else None, t, "clash", 1) for i, t in enumerate([*texts, *texts[:8]])]
    got = H.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string, fp string, component_id int"))
    plain = [(k, plain_fingerprint(t)) for k, t, _, _ in rows]
    want = sorted(map(str, [(k, f, c) for (k, f), c in zip(plain, plain_components(plain))]))
    assert sorted(map(str, [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got.collect()])) == want
    assert H.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).count() == 0


@pytest.mark.parametrize("block, few", [(1024, 32), (8, 3)])
def test_every_link_is_found(spark, monkeypatch, block, few):
    """Fingerprints at all distances, many in one bucket, in small and large blocks: the same components as by all pairs."""
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "FEW", few)
    rng = random.Random(3)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {flip(f, n) for f in base for n in (0, 1, 3, 4, 5, 6, 9)} | {flip(base[0], rng.randint(1, 8)) for _ in range(150)}
    fps |= {base[1] ^ (i << 43) for i in range(120)}  # all alike in two segments
    fps = sorted(fps)
    rows = list(enumerate(fps))
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in H.linking_edges(classes, len(fps)).collect()]
    label = {f: i for i, f in rows}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    assert [label[f] for f in fps] == plain_components(rows)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else 1 if i % 3 else i) for i in range(300)], "i int, k int")
    unique = spark.createDataFrame([(k, f"v{k}") for k in range(0, 300, 2)] + [(1, "v1")], "k int, v string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = common.hot_keys(counts, "k", "n", 300)
    assert [r["k"] for r in hot.collect()] == [1]
    for how in ("inner", "left"):
        got, want = common.spread_join(rows, unique, "k", hot, how), rows.join(unique, "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def plain_whitening(vectors, most=32):
    """n, deviations, variances and whitened rows (up to sign) by the covariance's eigenvectors."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return n, deviation, e[::-1], (y @ v[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)))[:, :most]


def test_whitening_query(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    n, deviation, e, white = plain_whitening([v for _, v in table])
    got = {(r["vec_id"], r["component"]): r for r in queries.op13_whitening(spark, SMALL).collect()}
    assert len(got) == 32 * len(table)
    found = np.array([[got[i, c]["whitened"] for c in range(1, 33)] for i, _ in table])
    assert np.abs(np.abs((found * white).mean(axis=0)) - 1).max() < 1e-9 and np.abs(np.abs(found) - np.abs(white)).max() < 1e-7
    for (i, _), d in zip(table, deviation):
        assert got[i, 1]["n"] == n and {got[i, c]["deviation"] for c in range(1, 33)} == {d}
    assert all(abs(got[table[0][0], c]["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-9 for c in range(1, 33))
    error = np.abs(np.cov(found.T, bias=True) - np.eye(32)).max()
    assert {r["identity_error"] for r in got.values()} == {got[table[0][0], 1]["identity_error"]} and abs(got[table[0][0], 1]["identity_error"] - error) < 1e-9 and error < 1e-9


def test_whitening_of_ill_conditioned_vectors(spark):
    """Directions whose variances differ by ten orders, where a Gram matrix alone loses the small ones."""
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    vectors = (rng.standard_normal((500, 6)) * [1e7, 1e5, 1e3, 100, 100, 100]) @ turn
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>").repartition(5)
    rows = sorted(W.whiten(df).collect(), key=lambda r: r["vec_id"])
    x = np.floor(64 * vectors)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.abs(np.array(rows[0]["explained"]) / (s**2 / (s**2).sum()) - 1).max() < 1e-6
    assert rows[0]["identity_error"] < 1e-6
    found = np.array([r["whitened"] for r in rows])
    assert np.abs(found.T @ found / 500 - np.eye(6)).max() < 1e-6


def test_whitening_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.5, 3.0], 0), (2, [1.0, 2.5, 3.0], 0), (None, [1.0, 4.0, 5.0], 0), (3, None, 0), (4, [1.0, None, 2.0], 0), (5, [nan, 1.0, 1.0], 0), (6, [inf, 1.0, 1.0], 0),
            (7, [1e300, 1.0, 1.0], 0), (8, [], 0), (9, [2.0], 0), (10, [1e13, 1.0, 2.0, 0.0], 0), (11, [-1e13, 1.0, 2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = W.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(x) for x in [1, 2, 2, None, 8, 9, 10, 11])
    by = {r["vec_id"]: r for r in got}
    n, deviation, e, white = plain_whitening([r[1] for r in rows[:4]])
    for i, (k, _, _) in enumerate(rows[:4]):
        assert (by[k]["n"], by[k]["deviation"]) == (4, deviation[i])
        assert np.allclose(np.abs(by[k]["whitened"][:2]), np.abs(white[i][:2])) and by[k]["whitened"][2] is None and by[k]["explained"][2] == 0
    assert by[1]["identity_error"] < 1e-9
    assert by[8]["whitened"] == [] and by[8]["n"] == 1 and by[9]["whitened"] == [None] and by[9]["identity_error"] is None and by[9]["deviation"] == 0
    assert by[10]["deviation"] is None and abs(by[10]["whitened"][0]) == 1 and by[10]["whitened"][1:] == [None] * 3
    assert W.whiten(df.limit(0)).count() == 0
