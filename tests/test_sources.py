import hashlib
import io
import random
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.plans import text_queries
from pagewright.sources import archives, encodings, files, ledger, pages as P

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<pc:PcGts xmlns:pc="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><pc:Metadata><pc:Creator>x</pc:Creator></pc:Metadata>
<pc:Page imageFilename="a.jpg" imageWidth="10" imageHeight="20"><pc:TextRegion id="r1"><pc:Coords points="0,0"/>
<pc:TextLine id="l1"><pc:Word id="w1"><pc:TextEquiv><pc:Unicode>old</pc:Unicode></pc:TextEquiv></pc:Word><pc:TextEquiv conf="0.5"><pc:Unicode> old one </pc:Unicode></pc:TextEquiv></pc:TextLine>
<pc:TextLine id="l2"><pc:TextEquiv><pc:Unicode/></pc:TextEquiv></pc:TextLine><pc:TextEquiv><pc:Unicode>old one</pc:Unicode></pc:TextEquiv></pc:TextRegion>
<pc:TextRegion id="r2"><pc:TextLine id="l3"><pc:TextEquiv><pc:Unicode>b</pc:Unicode></pc:TextEquiv><pc:TextEquiv><pc:Unicode>c</pc:Unicode></pc:TextEquiv></pc:TextLine></pc:TextRegion></pc:Page></pc:PcGts>"""


def pages(spark):
    return spark.createDataFrame([("a", PAGE), ("b", "plain"), ("c", "<PcGts><x"), ("d", None)], "page_id string, xml string")


def test_lines_of_a_prefixed_page(spark):
    rows = P.region_lines(pages(spark), ["page_id"]).orderBy("region_idx", "line_idx").collect()
    assert [(r["line_id"], r["text"], r["conf"], r["n_equivs"]) for r in rows] == [("l1", "old one", 0.5, 1), ("l2", "", None, 1), ("l3", "b", None, 2)]
    assert [r["text"] for r in P.flat_lines(pages(spark), ["page_id"]).collect()] == ["old one", "b"]


def test_formats(spark):
    assert [r["format"] for r in P.sniff_format(pages(spark), "xml").orderBy("page_id").collect()] == ["page", "text", "xml", "text"]


def test_write_back_touches_only_text(spark):
    new = P.page_text(pages(spark).filter("page_id = 'a'"), ["page_id"]).withColumn("text", F.array(F.array(F.lit("new two"), F.lit("x"), F.lit("extra"))))
    made = P.write_back(pages(spark).join(new, "page_id"), words=True, order=True).first()["xml"]
    assert "<pc:Unicode>new</pc:Unicode>" in made and "<pc:Creator>x</pc:Creator>" in made and "new two" in made and "extra" not in made
    assert "<pc:Unicode>b</pc:Unicode>" in made and "<pc:Unicode>new two&#13;\nx</pc:Unicode>" in made


def test_region_text_is_read_again_as_written(spark):
    new = P.page_text(pages(spark).filter("page_id = 'a'"), ["page_id"]).withColumn("text", F.array(F.array(F.lit("one"), F.lit("two"))))
    made = P.write_back(pages(spark).join(new, "page_id"), words=True)
    again = P.write_back(made.withColumn("text", F.lit(None).cast("array<array<string>>"))).first()["xml"]
    space = "{http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15}"
    for xml in (made.first()["xml"], again, P.patch_page(again, [])):
        region = ET.fromstring(xml).find(f".//{space}TextRegion")
        assert region.findtext(f"{space}TextEquiv/{space}Unicode") == "one\r\ntwo"


def test_pages_are_written_back_in_their_own_row(spark, tmp_path):
    """Documents without a number, and with the same one, keep their lines; a page is parsed once to be written and once to be read again."""
    rows = [(None, "a\nb"), (1, "x < y\n z "), (1, ""), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    made = text_queries.page_write_back(spark, str(tmp_path))
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    expected = [(None, 0, "# a"), (None, 1, "b"), (1, 0, "# x < y"), (1, 1, "z"), (1, 0, ""), (2, 0, "")]
    assert Counter(map(tuple, made.collect())) == Counter((d, i, digest(t)) for d, i, t in expected)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("from_xml(") == 2


def test_rows_that_are_no_pages(spark):
    assert [r["page_id"] for r in P.page_text(pages(spark), ["page_id"]).collect()] == ["a"]
    kept = {r["page_id"]: r["text"] for r in P.with_text(pages(spark)).collect()}
    assert kept == {"a": [["old one", ""], ["b"]], "b": None, "c": None, "d": None}
    assert {r["page_id"]: r["xml"] for r in P.write_back(P.with_text(pages(spark).filter("page_id <> 'a'"))).collect()} == {"b": "plain", "c": "<PcGts><x", "d": None}


REGION = '''<TextRegion id="tr_{0}"{1}><TextLine id="tl_{2}"{3}><TextEquiv><Unicode>Example Text {2}</Unicode></TextEquiv></TextLine>
<TextLine id="tl_{4}"{5}><TextEquiv><Unicode>Example Text {4}</Unicode></TextEquiv></TextLine></TextRegion>'''


def test_reading_order(spark):
    place = lambda i: f' custom="readingOrder {{index:{i}}}"'
    page = lambda order: (
        f'<PcGts xmlns="{P.NAMESPACE}"><Page imageFilename="orig.jpg">'
        + "".join(REGION.format(r + 1, order(r), 2 * r + 1, order(0), 2 * r + 2, order(1)) for r in (0, 1)) + "</Page></PcGts>"
    )
    assert ET.canonicalize(P.patch_page(page(lambda i: ""), [], order=True)) == ET.canonicalize(page(place))
    lines = P.region_lines(spark.createDataFrame([(1, page(lambda i: ""))], "page_id int, xml string"), ["page_id"])
    rows = P.reading_order(lines, ["page_id"]).orderBy("region_idx", "line_idx").collect()
    assert [(r["line_id"], r["region_order"], r["line_order"]) for r in rows] == [
        (f"tl_{2 * r + i + 1}", f"readingOrder {{index:{r}}}", f"readingOrder {{index:{i}}}") for r in (0, 1) for i in (0, 1)
    ]


def test_a_line_has_one_text(spark):
    lines = P.region_lines(pages(spark), ["page_id"])
    assert P.single_text(lines.filter("n_equivs = 1")).count() == 2
    with pytest.raises(Exception, match="not one text in line l3"):
        P.single_text(lines).collect()


def test_read_pages_and_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PAGE, encoding="utf-8")
    (tmp_path / "t.txt").write_text(" one \n\ntwo", encoding="utf-8")
    (tmp_path / "e.json").write_text('[{"pk": 1, "fields": {"name": "x", "description": "y"}}]')
    found = P.read_pages(spark, str(tmp_path / "a.xml"))
    assert [r["text"] for r in P.region_lines(found, ["path"]).orderBy("region_idx", "line_idx").collect()] == ["old one", "", "b"]
    assert [r["text"] for r in files.read_text_lines(spark, str(tmp_path / "t.txt")).collect()] == [" one ", "", "two"]
    size = files.read_files(spark, str(tmp_path / "t.txt")).first()
    assert size["size"] == len(size["content"]) == 10 and size["path"].endswith("t.txt")
    assert files.read_json_dimension(spark, str(tmp_path / "e.json")).collect() == [(1, "y", "x")]
    files.write_text_lines(spark.createDataFrame([("a",), ("b",)], "text string"), str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_decoding(spark):
    raw = [b"plain", "é€".encode(), "é €”".encode("cp1252"), b"\xff\xfea\x00", bytes([0x81, 1, 2, 3]), b""]
    rows = files.decode_text(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, content binary")).orderBy("i").collect()
    assert [r["text"] for r in rows] == ["plain", "é€", "é €”", "a", None, ""]
    assert rows[2]["encoding"] == "windows-1252" and rows[3]["encoding"] == "UTF-16LE"


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_batches(spark):
    rows = [("ok", zipped(**{"a.txt": "A", "sub/b.txt": "B"})), ("slip", zipped(**{"../x": "A"})), ("bad", b"no"), ("none", zipped())]
    found = files.unzip(spark.createDataFrame(rows, "batch_id string, content binary")).collect()
    assert {(r["batch_id"], r["member"], r["error"]) for r in found} == {("ok", "a.txt", None), ("slip", None, "unsafe path"), ("bad", None, "not a ZIP file"), ("none", None, "empty")}
    parts = [("b", "x/a.xml", ["1", "2"]), ("b", "a.xml", ["3"])]
    made = files.bundle(spark.createDataFrame(parts, "batch_id string, filename string, parts array<string>")).first()
    with zipfile.ZipFile(io.BytesIO(made["content"])) as z:
        assert sorted((n, z.read(n).decode()) for n in z.namelist()) == [("a (2).txt", "3"), ("a.txt", "1\n\n2")]


def test_ledger(spark, tmp_path):
    asked = spark.createDataFrame([(1, "ocr", "2024-01-01"), (2, "ocr", "2024-01-01")], "usage_id long, service string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    opened = ledger.open_usage(asked)
    results = spark.createDataFrame([(1, True, 7)], "usage_id long, ok boolean, target_size long").withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    ledger.append_usage(opened, str(tmp_path / "u"))
    ledger.append_usage(ledger.close_usage(opened, results), str(tmp_path / "u"))
    rows = spark.read.parquet(str(tmp_path / "u")).collect()
    assert sorted((r["usage_id"], r["status"], r["target_size"]) for r in rows) == [(1, "IN_PROGRESS", None), (1, "SUCCESS", 7), (2, "IN_PROGRESS", None)]


SAID = {
    "windows-1251": "Вчера вечером мы долго гуляли по набережной и говорили о том, что было бы хорошо поехать летом на море.",
    "koi8-r": "Вчера вечером мы долго гуляли по набережной и говорили о том, что было бы хорошо поехать летом на море.",
    "shift_jis": "昨日の夜、私たちは川沿いを長い間歩いて、夏に海へ行けたらいいねと話しました。テキストです。",
    "iso-8859-2": "Wczoraj wieczorem długo spacerowaliśmy nad rzeką i rozmawialiśmy o tym, że dobrze byłoby pojechać latem nad morze.",
    "utf-16-le": "A plain English sentence without any mark at its beginning.",
    "utf-16-be": "Ein Satz mit Umlauten: schöne Grüße aus München, heißt es.",
    "windows-1252": "Le café était fermé, “déjà” à midi — hélas ! Où est l’été ?",
    "utf-8": "Überall — 漢字 and Русский",
}


def test_encodings_without_a_mark(spark):
    """Texts in languages and scripts that the model has not seen; noise is refused, and the table's held-out texts are told."""
    model = encodings.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(k, t.encode(k)) for k, t in SAID.items()] + [("none", None), ("empty", b""), *[(f"noise{i}", random.Random(i).randbytes(300)) for i in range(20)]]
    df = spark.createDataFrame(rows, "was string, content binary").withColumn("text", F.lit(1))
    got = {r["was"]: r for r in encodings.tell_encoding(df.drop("text"), model).collect()}
    assert {k: (got[k]["encoding"], got[k]["text"]) for k in SAID} == {k: (k, t) for k, t in SAID.items()} and all(got[k]["confidence"] > 0.9 for k in SAID)
    assert all(got[f"noise{i}"]["text"] is None and got[f"noise{i}"]["confidence"] < 0.5 for i in range(20))
    assert got["none"]["text"] is None and (got["empty"]["text"], got["empty"]["encoding"]) == ("", "utf-8")
    told = text_queries.encoding_confusion(spark, "/root/testdata/sf0.01").collect()
    assert {r["was"] for r in told} == set(encodings.CANDIDATES)
    assert sum(r["n_right"] for r in told) > 0.97 * sum(r["n"] for r in told)
    assert sum(r["n"] for r in told if r["told"] not in (r["was"], "utf-8")) < 0.03 * sum(r["n"] for r in told)


def test_encoding_model_of_nothing(spark):
    model = encodings.learn(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"))
    assert model.tell(b"")[2] == "" and model.tell(b"a\xe9b")[0] in encodings.CANDIDATES


def test_archives_are_read_in_parallel_and_written_whole(spark, tmp_path):
    folder = tmp_path / "zips"
    rows = spark.createDataFrame([(f"b{i % 3}", f"sub/m{i}.txt", f"text {i} " * 200) for i in range(30)], "archive string, member string, content string")
    archives.write_archives(rows, str(folder))
    assert sorted(f.name for f in folder.iterdir()) == ["b0.zip", "b1.zip", "b2.zip"]
    (folder / "bad.zip").write_bytes(b"no")
    (folder / "none.zip").write_bytes(zipped())
    (folder / "slip.zip").write_bytes(zipped(**{"../x": "A"}))
    damaged = bytearray(zipped(**{"a.txt": "A" * 5000, "b.txt": "B"}))
    damaged[40] ^= 255
    (folder / "damaged.zip").write_bytes(damaged)
    found = spark.read.format("zip").option("bytes", 5000).load(str(folder))
    assert found.rdd.getNumPartitions() > 5
    got = found.withColumn("archive", F.element_at(F.split("archive", "/"), -1)).collect()
    good = {(r["archive"], r["member"], bytes(r["content"]).decode(), r["size"]) for r in got if r["content"] is not None}
    assert good == {(f"b{i % 3}.zip", f"sub/m{i}.txt", t := f"text {i} " * 200, len(t)) for i in range(30)} | {("damaged.zip", "b.txt", "B", 1)}
    errors = {(r["archive"], r["member"]): r["error"] for r in got if r["error"]}
    assert errors.pop(("damaged.zip", "a.txt")) and errors == {("bad.zip", None): "not a ZIP file", ("none.zip", None): "empty", ("slip.zip", None): "unsafe path"}
    # A write that fails leaves no archive and nothing unfinished, and keeps what was there.
    before = sorted(f.name for f in folder.iterdir())
    broken = rows.withColumn("archive", F.concat(F.lit("new"), "archive")).union(spark.createDataFrame([("newb1", "../out", "x")], rows.schema))
    with pytest.raises(Exception, match="unsafe path"):
        archives.write_archives(broken, str(folder))
    assert sorted(f.name for f in folder.iterdir()) == before


def test_archives_stream(spark, tmp_path):
    archives.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def go(name, **members):
        (folder / f"{name}.zip").write_bytes(zipped(**members))
        q = spark.readStream.format("zip").load(str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted(r["member"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go("one", a="1", b="2") == ["a", "b"]
    assert go("two", c="3") == ["a", "b", "c"]


def test_ledger_rows_of_a_batch_count_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "SUCCESS") for i in range(5)], "usage_id long, status string")
    write = ledger.append_once(str(tmp_path / "u"))
    for number in (0, 1, 1, 0):  # two batches come again
        write(rows.filter(F.col("usage_id") % 2 == number), number)
    ledger.append_once(str(tmp_path / "u"), "other")(rows.limit(1), 0)
    assert sorted(r["usage_id"] for r in ledger.read_usage(spark, str(tmp_path / "u")).collect()) == sorted([0, 1, 2, 3, 4, rows.first()["usage_id"]])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(ledger.append_once(str(tmp_path / "s"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and ledger.read_usage(spark, str(tmp_path / "s")).count() == 5
