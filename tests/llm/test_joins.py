import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import components, near_duplicates as N, neighbours


def brute_classes(rows, threshold=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := N.WORD.findall((t or "").lower())) else set() for _, t in rows]
    n, links = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i].append(j)
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
    low = {}
    for i, k in enumerate(label):
        low[k] = min(low.get(k, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], low[label[i]], len(links[i])) for i in range(n))


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(copy) if rng.random() < 0.7 else " ".join(copy).upper() + "!"))
    hot = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(200)] = "new"
        rows.append((n := n + 1, " ".join(copy)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " .,"), (n + 4, None), (5, rows[4][1])]
    monkeypatch.setattr(N, "BUCKET", 16)
    monkeypatch.setattr(N, "BLOCK", 16)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(4)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in N.near_duplicates(df).collect())
    assert got == brute_classes(rows)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_null_keys_and_clashing_texts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (3, text), (4, "other words that are quite short"), (4, text + " end"), (None, "alone with a null key here")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r["class_id"] for r in got if r["n_links"] >= 2} == {3}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame([*edges, (None, 1)], "a int, b int")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def brute_neighbours(rows, k=5):
    """{query_id: [(vec_id, score)]} from (vec_id, vector) rows, by every pair."""
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q in kept:
        if q % 50 == 0:
            scored = [(i, neighbours.cosines(np.array(kept[q]), np.array([v]))[0]) for i, v in kept.items() if i != q and len(v) == len(kept[q])]
            out[q] = sorted(scored, key=lambda x: (-x[1], x[0]))[:k]
    return {q: found for q, found in out.items() if found}


def found_neighbours(df, kind="double"):
    rows = neighbours.usable(df)
    out = {}
    for r in neighbours.nearest(neighbours.build_index(rows), rows.filter(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    """Two lengths, a vector that a third of the rows share, ids that repeat with other vectors, and vectors that take no part."""
    rng = np.random.default_rng(3)
    centres, hot = rng.normal(size=(6, 16)), rng.normal(size=16)
    x = [*(centres[rng.integers(6, size=300)] + 0.05 * rng.normal(size=(300, 16))), *rng.normal(size=(300, 16)), *([hot] * 300), *rng.normal(size=(120, 5)), [1e200] * 5, [1.0]]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (None, [1.0] * 16), (2200, [float("inf")] * 16), (2250, []), (0, rows[0][1])]
    rows += [(50, [float(v) for v in rng.normal(size=16)]), (100, [float(v) for v in rng.normal(size=5)]), (7, [float(v) for v in 3 * hot]), (8, [float(v) for v in 2 * hot])]
    df = spark.createDataFrame([(*r, "id") for r in rows], "vec_id long, embedding array<double>, id string").repartition(4)
    monkeypatch.setattr(neighbours, "ROW_NUMBERS", 3000)
    monkeypatch.setattr(neighbours, "QUERY_NUMBERS", 80)
    got, want = found_neighbours(df), brute_neighbours(rows)
    assert set(got) == set(want) and 1021 not in got
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values())) and all(len(got[q]) == len(want[q]) for q in want)
    known = {q: dict(brute_neighbours(rows, len(rows))[q]) for q in want}
    assert all(s == known[q][v] or (np.isnan(s) and np.isnan(known[q][v])) for q in got for v, s in got[q])
    assert [v for v, _ in got[650]] == [v for v, _ in want[650]]  # one of the copies
    assert found_neighbours(df.filter("vec_id IN (51, 150)")) == brute_neighbours([r for r in rows if r[0] in (51, 150)])
    assert found_neighbours(df.limit(0)) == {} and found_neighbours(df.filter("vec_id = 50")) == {}


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e300])
def test_neighbours_of_any_magnitude(spark, size):
    """Vectors near the ends of the range of doubles have the neighbours that their directions have."""
    rng = np.random.default_rng(12)
    plain = rng.normal(size=(60, 8))
    for rows in (plain * size, np.concatenate([plain[:50] * size, plain[50:]])):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id int, embedding array<double>")
        got, want = found_neighbours(df), brute_neighbours([(i, v.tolist()) for i, v in enumerate(plain)])
        assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()} and len(got) == 2
        assert all(abs(a - b) < 1e-12 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def test_neighbours_in_a_dense_cluster(spark, monkeypatch):
    """Where bounds prune nothing all rows of a block survive: told as bits, and the result is the same."""
    rng = np.random.default_rng(13)
    rows = [(i, (np.ones(32) + 1e-4 * rng.normal(size=32)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    told = []
    pack = neighbours.packed_places
    monkeypatch.setattr(neighbours, "packed_places", lambda chosen: told.append(len(pack(chosen))) or pack(chosen))
    assert len(neighbours.packed_places(np.ones(4096, bool))) == 513 and told == [513]
    monkeypatch.undo()
    got, want = found_neighbours(df), brute_neighbours(rows)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.98 * 5 * 40
    for n in (0, 1, 7, 500, 1000):
        chosen = np.zeros(1000, bool)
        chosen[rng.permutation(1000)[:n]] = True
        assert (neighbours.unpacked_places(pack(chosen)) == np.flatnonzero(chosen)).all() and len(pack(chosen)) <= 126


def test_estimates_hold_within_their_bounds():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 64, 100, 700):
        turn = neighbours.rotation(dim)
        assert len(turn) >= neighbours.BITS and np.allclose(turn.T @ turn, np.eye(dim))
        rows, queries = rng.normal(size=(2000, dim)), rng.normal(size=(20, dim))
        block = neighbours.Codes(*neighbours.encode(rows, turn), len(turn))
        planes, scalars = neighbours.encode_query(queries, turn)
        outside, wide = 0, []
        for q, p, s in zip(queries, planes, scalars):
            guess, bound = block.estimate(p, s, neighbours.EPSILON)
            outside += int((np.abs(neighbours.cosines(q, rows) - guess) > bound + 1e-9).sum())
            wide.append(bound.max())
        assert outside <= 40 and max(wide) < 0.2, dim


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta the of and river stone light".split()) for _ in range(80)) + f" number{i} end{i}." for i in range(40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0", 1), (101, None, None, "s0", 0), (102, "123 456 !!", "en", "s0", 1), (103, "short text", "en", "s1", 1), (1, base[1], "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"out{i}")
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept[0] == sorted([*range(40), 1, 100, 103]) and kept[1] == sorted([*range(40), 1, 100]) and kept[2] == list(range(40))
    assert set(kept[3]) <= set(range(40)) and kept[4] == sorted(2 * kept[3])
    assert all(r["sp_exact"] for r in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def brute_groups(rows, threshold=0.8):
    """The rows of each class of near-duplicates."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := N.WORD.findall((t or "").lower())) else set() for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
    return [[rows[i] for i in range(len(rows)) if label[i] == k] for k in sorted(set(label))]


def test_one_document_per_class(spark):
    import corpus_pipeline

    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(60)) for _ in range(9)]
    rows = [(1, base[0]), (2, base[0] + " end"), (2, base[1]), (7, base[1] + " end"), (3, base[2]), (3, base[3])]
    rows += [(None, base[4]), (None, base[5]), (None, base[0]), (5, base[6])]
    rows += [(8, base[7]), (8, base[7]), (None, base[8]), (None, base[8]), (9, None), (9, ""), (None, None), (None, "..")]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df.repartition(4), "").collect()]
    for group in brute_groups(rows):
        ids = [i for i, _ in group if i is not None]
        allowed = {x for x in group if x[0] == (min(ids) if ids else None)}
        assert len([x for x in got if x in allowed]) == 1, group
    assert len(got) == len(brute_groups(rows))
    clashing = df.withColumnsRenamed({"lang": "row", "source": "again", "n_chars": "wordless"})
    kept = N.one_per_class(clashing)
    assert kept.columns == clashing.columns and sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(repr, got))
    again = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.drop_near_duplicates(spark, df.orderBy(F.desc("n_chars")), "").collect()]
    assert sorted((i or 0, t or "") for i, t, _ in again) == sorted((i or 0, t or "") for i, t in got) and (8, base[7], "s10") in again


def test_pipeline_of_nothing_and_of_null_ids(spark, tmp_path):
    """Empty documents; and null ids, repeated rows and two texts under one id, against the stages written out plainly."""
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rng = random.Random(21)
    base = [" ".join(rng.choice("alpha beta gamma delta the of and river stone light".split()) + rng.choice(["", "s"]) for _ in range(70)) for i in range(24)]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(base)] + [(1, base[5]), (1, base[1]), (None, base[3]), (None, base[7] + " end"), (50, "too short"), (51, None), (None, "!! 1")]
    rows = [(i, t, None if n % 7 == 0 else "en", f"s{n % 2}", n % 5) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "some" / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, "").write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append([tuple(r) for r in docs.collect()])
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(repr, seen[0])) == sorted(map(repr, lettered))
    enough = [r for r in lettered if len(r[1].split()) >= 20]
    assert sorted(map(repr, seen[1])) == sorted(map(repr, enough))
    groups = brute_groups([r[:2] for r in enough])
    assert len(seen[2]) == len(groups) and set(seen[2]) <= set(enough)
    for g in groups:
        ids = [i for i, _ in g if i is not None]
        assert sum(r[:2] in g and r[0] == (min(ids) if ids else None) for r in seen[2]) == 1


def test_runs_reach_the_recall():
    runs = N.runs_needed(0.8, 0.999)
    need = N.least_equal(0.8)
    assert len(set(N.roots_of(runs))) == runs and sorted(N.roots_of(64)) == list(range(64))
    assert N.miss_rate(0.8, runs, need) <= 0.001 < N.miss_rate(0.8, runs - 1, need)
    rng, missed, trials = np.random.default_rng(7), 0, 200_000
    equal = rng.random((trials, 64)) < 0.8
    missed = (~equal[:, N.roots_of(runs)].any(axis=1) | (equal.sum(axis=1) < need)).mean()
    assert abs(missed - N.miss_rate(0.8, runs, need, levels=0)) < 2e-4 and missed < 0.001
    assert N.runs_needed(1.0, 0.999) == 1
    with pytest.raises(ValueError):
        N.runs_needed(0.3, 0.999)


def test_recall_of_planted_pairs(spark):
    """3,000 pairs with a Jaccard of 0.80 to 0.85, by brute force: none or few are missed by the candidate search."""
    rng, rows, pairs = np.random.default_rng(8), [], 3000
    with np.errstate(over="ignore"):
        for p in range(pairs):
            shared, own = 160, rng.integers(28, 41)
            s = rng.integers(0, 1 << 63, shared + own, dtype=np.int64).astype(np.uint64)
            a, b = np.sort(s[: shared + own // 2]), np.sort(np.concatenate([s[:shared], s[shared + own // 2 :]]))
            assert 0.8 <= shared / (shared + own) <= 0.852
            rows += [(bytes([x]) + int(p).to_bytes(15, "big"), N.samples(t).tobytes()) for x, t in ((0, a), (1, b))]
    edges = N.candidate_edges(spark.createDataFrame(rows, "fp binary, sig binary"), 0.8, 0.999).collect()
    assert len({bytes(e["a"])[1:] for e in edges if bytes(e["a"])[1:] == bytes(e["b"])[1:]}) >= pairs - 5


def test_texts_without_key_are_linked(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(70)]
    chain = [" ".join(words), " ".join([*words[6:], *"xyz"]), " ".join([*words[12:], *"xyzuvw"])]
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (3, "lone text of some words"), (None, "other " * 9 + "one"), (None, "other " * 9 + "two"), (None, chain[1])]
    rows += [(None, " ".join(words[::-1])), (None, " ".join(words[::-1]) + " end"), (None, " ".join(words[::-1]) + " end")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in N.near_duplicates(docs).collect())
    named = [(i or 10**9, t) for i, t in rows]
    want = sorted((i % 10**9, c % 10**9, n) for i, c, n in brute_classes(named))
    assert got == want and got.count((0, 1, 3)) == 2 and (2, 1, 2) in got
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    groups = brute_groups(rows)
    assert len(kept) == len(groups) and all(sum(k in g for k in kept) == 1 for g in groups)
    assert {i for i, _ in kept} == {1, 3, None}
