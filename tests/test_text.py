import random
import time

from pyspark.sql import functions as F

from pagewright.functions import align, text as T
from pagewright.plans import steps as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<array<string>>' if v and isinstance(v[0], list) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_paragraphs_keep_empty_ones(spark):
    text = "a\n b \n\n\nc\r\nd\n\n"
    assert one(spark, T.paragraphs(F.col("t")), t=text) == [["a", "b"], [], ["c", "d"]]
    assert one(spark, T.paragraphs(F.col("t")), t="") == []


def test_render_round_trips(spark):
    text = "one\ntwo\n\nthree\nfour\n"
    df = spark.createDataFrame([(text,)], "content string")
    parser = S.Paragraphs()
    for _ in range(10):
        df = parser.render(parser.read(df), "content").select("content")
    assert df.first()[0] == text


def test_segmentation_and_back(spark):
    df = spark.createDataFrame([("A single\nsentence. And an-\nother one.",)], "content string")
    step = S.STEPS["SEGMENTATION"]()
    forward = step.forward(S.Paragraphs().read(df))
    assert forward.first()["text"] == [["A single sentence.", "And another one."]]
    assert step.backward(forward).first()["text"] == [["A single", "sentence. And another", "one."]]


def test_join_page_and_back(spark):
    text = [[f"line {i}" for i in range(4)], ["x", "y z", ""]]
    df = spark.createDataFrame([(text,)], "text array<array<string>>")
    step = S.JoinPage()
    forward = step.forward(df)
    assert forward.first()["text"] == [["line 0 line 1 line 2 line 3 x y z "]]
    assert step.backward(forward).first()["text"] == text


def test_join_page_of_nothing(spark):
    df = spark.createDataFrame([([["", ""]],), ([],)], "text array<array<string>>")
    step = S.JoinPage()
    assert [r["text"] for r in step.backward(step.forward(df)).collect()][1] == []


def test_realign_without_length(spark):
    assert one(spark, align.realign(F.col("s"), F.array(F.lit(0)), F.array().cast("array<int>")), s=["a b"]) == ["a b"]


def test_split_index(spark):
    for at, want in ((0, 1), (1, 1), (2, 4), (5, 6), (9, 6)):
        assert one(spark, align.split_index(F.col("t"), F.lit(at)), t="a bc d") == want


def test_realigning_is_the_contract(spark):
    """Against the rule written out: each end is the first space at or after the scaled one, halves rounded to even."""

    def plain(sentences, n_in, n_out):
        j, f = " ".join(sentences), len(" ".join(sentences)) / (sum(n_out) + len(n_out) - 1)
        ends = [round(f * (sum(n_in[: i + 1]) + i)) for i in range(len(n_in))]
        cut = [j.find(" ", e) if j.find(" ", e) >= 0 else len(j) for e in ends]
        cut[-1] = len(j)
        return [j[a:b] if a < b else "" for a, b in zip([0, *[c + 1 for c in cut]], cut)]

    rng = random.Random(1)
    for _ in range(300):
        lines = [" ".join(rng.choice(["a", "bé", "\U0001f600cd", "", "longer"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6))]
        new = ["".join(rng.choice(["x", "é ", " "]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 3))]
        n_in, n_out = list(map(len, lines)), [rng.randint(1, 12) for _ in range(rng.randint(1, 4))]
        assert align.realign_paragraph(new, n_in, n_out) == plain(new, n_in, n_out)


def test_long_documents_are_realigned_in_linear_time():
    took = []
    for n in (20_000, 80_000):
        lines = [f"line number {i} of some length" for i in range(n)]
        began = time.process_time()
        assert align.realign_paragraph([" ".join(lines)], list(map(len, lines)), [len(" ".join(lines))]) == lines
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 5


def test_null_documents_stay_null(spark):
    df = spark.createDataFrame([(1, None), (2, [["a b", "c"], []])], "id int, text array<array<string>>")
    for step in (S.STEPS["SEGMENTATION"](), S.JoinPage()):
        if step.name == "join_page":
            continue
        assert [r["text"] for r in step.backward(step.forward(df)).orderBy("id").collect()] == [None, [["a b", "c"], []]]


def test_tokens_and_rebuilding(spark):
    assert one(spark, T.tokens(F.col("t")), t="It's a&b x@y, (ok)!") == ["It's", "a&b", "x@y", ",", "(", "ok", ")", "!"]
    assert one(spark, T.rebuild_line(F.col("t")), t=["This", "is", "~sample", "text", "."]) == "This is ~sample text."
    assert one(spark, T.rebuild_line(F.col("t")), t=["a", "[[b]]", "."]) == "a [[b]] ."
    assert one(spark, T.rebuild_line(F.col("t")), t=[".", "a"]) == ". a" and one(spark, T.rebuild_line(F.col("t")), t=["x"]) == "x"


def test_plain_text_lines_and_marks(spark):
    text = " one \n\n two\r\nthree\u2028"
    assert one(spark, T.text_lines(F.col("t")), t=text) == ["one", "two", "three"]
    assert one(spark, T.text_lines(F.col("t"), False, False), t=text) == [" one ", "", " two", "three"]
    assert one(spark, T.restore_marks(F.col("t")), t="a__SEP__b__CR__") == "a b&#13;"
    assert one(spark, T.trim_page(F.col("t")), t=" \u00a0\n") is None and one(spark, T.trim_page(F.col("t")), t=" a ") == "a"
    assert one(spark, T.content_type(F.col("t")), t="x/y.XML") == "application/xml" and one(spark, T.content_type(F.col("t")), t="y.doc") is None


def test_catalogue_of_steps(spark):
    rows = {r["key"]: r for r in S.catalogue(spark).collect()}
    assert set(rows) == {*S.STEPS, S.RENDER} and all(r["name"] and r["description"] for r in rows.values())

def test_options():
    steps, render = S.make_steps([" segmentation", "render_txt", ""])
    assert [s.name for s in steps] == ["segmentation"] and render
    try:
        S.make_steps(["nope", "JOIN_PAGE", "zip"])
    except ValueError as e:
        assert "NOPE" in str(e) and "ZIP" in str(e)
    else:
        raise AssertionError


def test_service_step_keeps_lines(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["c"]]), (2, [["bad"]]), (3, [])], "id int, text array<array<string>>")

    def model(docs):
        if any("bad" in d for d in docs):
            raise ValueError("no")
        return [[x.upper() for x in d] for d in docs]

    rows = {r["id"]: r for r in S.Service("shout", model).forward(df).collect()}
    assert rows[1]["text"] == [["A", "B"], ["C"]] and rows[1]["shout_status"] == "SUCCESS"
    assert rows[2]["text"] == [["bad"]] and rows[2]["shout_status"] == "FAILED" and rows[2]["shout_error"] == "no"
    assert rows[3]["text"] == []


def test_service_loses_a_line(spark):
    df = spark.createDataFrame([(1, [["a", "b"]])], "id int, text array<array<string>>")
    row = S.Service("cut", lambda docs: [d[:1] for d in docs]).forward(df).first()
    assert row["cut_status"] == "FAILED" and row["text"] == [["a", "b"]]


def test_rebuilding_a_long_line_is_linear(spark):
    """Of a text of 20,000 tokens each token split the whole text again."""
    text = "word , " * 10000
    df = spark.createDataFrame([(text,)], "t string").select(T.rebuild_line(T.tokens(F.col("t"))).alias("x"))
    began = time.perf_counter()
    assert df.first()["x"] == " ".join(["word,"] * 10000)
    assert time.perf_counter() - began < 20
