import pytest
from pyspark.sql import functions as F

from pagewright.plans import steps as S
from pagewright.streaming import tasks as K


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_documents_flow_through_steps(spark, tmp_path):
    spark.createDataFrame([(1, "A single\nsentence. And an-\nother one.")], "id int, content string").write.parquet(str(tmp_path / "in"))
    docs = K.read_documents(spark, str(tmp_path / "in"), "id int, content string")
    rows = run(K.process(docs, [S.STEPS["SEGMENTATION"]()]).select("id", "result"), "flow").collect()
    assert rows[0]["result"] == "A single\nsentence. And another\none.\n"


def test_files_of_both_kinds_flow_through_steps(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_bytes("A single\nsentence – and an-\nother one.".encode("cp1252"))
    (folder / "b.xml").write_text('<PcGts><Page><TextRegion><TextLine><TextEquiv><Unicode>One line. And</Unicode></TextEquiv></TextLine><TextLine><TextEquiv><Unicode>two.</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>')
    (folder / "c.bin").write_bytes(bytes([0x81, 1, 2, 3]))
    flow = K.process(K.read_files(spark, str(folder)), [S.STEPS["SENTENCE_SEGMENTATION"](), S.Lines("mark", lambda x: F.replace(x, F.lit("n"), F.lit("nn")))])
    got = {r["path"].rpartition("/")[2]: r for r in run(flow.select("path", "format", "encoding", "result"), "kinds").collect()}
    assert got["a.txt"]["encoding"] == "windows-1252" and got["a.txt"]["result"] == "A sinngle\nsenntennce – annd ann-\nother onne.\n"
    assert got["b.xml"]["format"] == "page" and "<Unicode>Onne linne. Annd</Unicode>" in got["b.xml"]["result"] and got["c.bin"]["result"] is None


EVENT = "task_id string, status string, s long, error string"


def tasks(spark, rows, path, mode="error"):
    df = spark.createDataFrame(rows, EVENT).select("task_id", "status", F.timestamp_seconds("s").alias("ts"), "error")
    df.coalesce(1).write.mode(mode).parquet(str(path))
    return df.schema


def test_status_upserts(spark, tmp_path):
    def go(schema):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
        q = stream.writeStream.foreachBatch(K.upsert_into(str(tmp_path / "t"), parts=4)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {r["task_id"]: (r["status"], r["error"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()}

    schema = tasks(spark, [("a", "PENDING", 1, None), ("a", "SUCCESS", 3, None), ("b", "FAILED", 2, "why"), *[(f"t{i}", "PENDING", 1, None) for i in range(20)]], tmp_path / "e")
    assert go(schema)["a"] == ("SUCCESS", None)
    files = {str(f) for f in (tmp_path / "t").rglob("*.parquet")}
    tasks(spark, [("a", "IN_PROGRESS", 2, None), ("t3", "SUCCESS", 9, None)], tmp_path / "e", "append")  # an event that comes late changes nothing
    got = go(schema)
    assert got["a"] == ("SUCCESS", None) and got["b"] == ("FAILED", "why") and got["t3"] == ("SUCCESS", None) and len(got) == 22
    assert files & {str(f) for f in (tmp_path / "t").rglob("*.parquet")}  # parts that no event touched stay
    K.upsert_into(str(tmp_path / "t"), parts=4)(spark.read.parquet(str(tmp_path / "e")), 1)  # a batch that comes again
    assert {r["task_id"]: (r["status"], r["error"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == got


def results(spark, tmp_path, *batches):
    """A stream of results (task_id, s), one batch after the other."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "task_id string, s long").select("task_id", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        for f in (tmp_path / "r").glob("part-*.parquet"):
            if not f.name.startswith("part-n"):
                f.rename(tmp_path / "r" / f"part-n{n}.parquet")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))


DAY = 86_400


def test_results_are_live_for_a_day(spark, tmp_path):
    stream = results(spark, tmp_path, [("a", 0), ("a", 10), ("b", 5)], [("a", 20), ("c", 3 * DAY)], [("d", 3 * DAY + 5)], [("a", 4 * DAY)])
    got = sorted((r["task_id"], r["ts"].timestamp()) for r in run(K.live_results(stream), "live").collect())
    assert [t for t, _ in got] == ["a", "a", "b", "c", "d"] and got[1][1] == 4 * DAY


def test_results_expire_after_a_day(spark, tmp_path):
    stream = results(spark, tmp_path, [("a", 0), ("b", DAY // 2)], [("a", 60), ("c", DAY + 120)], [("d", 10 * DAY)])
    got = sorted((r["task_id"], r["ts"].timestamp()) for r in run(K.expired_results(stream), "gone").collect())
    assert got == [("a", 60), ("b", DAY // 2), ("c", DAY + 120)]


@pytest.fixture
def ending(spark):
    """Streams on processing time end when their input does."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_batches_complete_once(spark, tmp_path, ending):
    rows = [("x", "1", 2, True), ("x", "1", None, True), ("x", "2", 2, False), ("y", "1", 3, True), ("y", None, None, None), ("z", "1", 1, None)]
    df = spark.createDataFrame(rows, "batch_id string, member string, expected int, ok boolean")
    df.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "m"))
    got = run(K.completed_batches(stream), "complete").collect()
    assert sorted((r["batch_id"], r["n_done"], r["n_failed"]) for r in got) == [("x", 2, 1), ("z", 1, 1)]


MEMBER = "batch_id string, member string, expected int, ok boolean"


def test_batches_go_on_after_a_restart(spark, tmp_path, ending):
    """Members that come in several runs of a stream, one with the sign that once parted members, one again after the batch is complete."""

    def go(rows):
        spark.createDataFrame(rows, MEMBER).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
        stream = spark.readStream.schema(MEMBER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
        q = K.completed_batches(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
        found = sorted((r["batch_id"], r["n_done"], r["n_failed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        return found, sum(o["numRowsTotal"] for p in q.recentProgress[-1:] for o in [p.stateOperators[0]])

    many = [("x", f"m{i}", 100, True) for i in range(60)]
    assert go([*many, ("y", "a\x1fb", 3, True), ("y", "a", None, False)])[0] == []
    found, rows = go([*[("x", f"m{i}", None, i != 80) for i in range(40, 100)], ("y", "b", None, None)])
    assert found == [("x", 100, 1), ("y", 3, 2)]
    assert rows <= 4  # what was told of two batches, no member
    assert go([("x", "m3", 100, True), ("x", "late", 900, True), ("z", "1", 1, True)])[0] == [("x", 100, 1), ("y", 3, 2), ("z", 1, 0)]
