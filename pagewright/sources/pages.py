"""Page-layout XML: reading lines, writing new text back, wrapping plain text.

Reading and wrapping are built-in expressions. Writing back patches only the
text elements of each page in an Arrow function, so that everything the schema
does not model stays as it was.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.text import let, strip

NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
SCHEMA = """Page STRUCT<_imageFilename: STRING, _imageWidth: INT, _imageHeight: INT,
  TextRegion: ARRAY<STRUCT<_id: STRING, _custom: STRING, Coords: STRUCT<_points: STRING>,
    TextLine: ARRAY<STRUCT<_id: STRING, _index: INT, _custom: STRING, Coords: STRUCT<_points: STRING>, Baseline: STRUCT<_points: STRING>,
      TextEquiv: ARRAY<STRUCT<_conf: DOUBLE, Unicode: STRING>>>>>>>,
  _corrupt_record STRING"""
OPTIONS = {"rowTag": "PcGts", "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def is_layout(parsed: Column, xml: Column) -> Column:
    """Whether a text is page-layout XML, told from what it was parsed to."""
    # from_xml drops nothing on bad input in permissive mode: it says so in _corrupt_record.
    return F.coalesce(parsed.isNotNull() & parsed["_corrupt_record"].isNull() & xml.rlike(r"<(\w+:)?PcGts[\s>]"), F.lit(False))


def parse_pages(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Add `parsed` (a struct of the page layout) and `is_page` (the text is such XML) to each row."""
    return pages.withColumn("parsed", F.from_xml(F.col(xml), SCHEMA, OPTIONS)).withColumn("is_page", is_layout(F.col("parsed"), F.col(xml)))


def parsed_page(xml: Column) -> Column:
    """A struct of the page layout; null where the text is not such XML. It is parsed once, as let binds it."""
    return let(F.from_xml(xml, SCHEMA, OPTIONS), lambda p: F.when(is_layout(p, xml), p))


def sniff_format(rows: DataFrame, content: str) -> DataFrame:
    """Add `format`: page (page layout), xml (other well-formed-looking mark-up) or text."""
    start = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "^\\uFEFF?\\s+", "")
    kind = F.when(parsed_page(F.col(content)).isNotNull(), "page").when(start.rlike(r"^<(\?xml|[A-Za-z_][\w.:-]*[\s/>])"), "xml").otherwise("text")
    return rows.withColumn("format", kind)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, xml."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("xml"))


def region_lines(pages: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """keys, region_idx, line_idx, region_id, line_id, custom, conf, text, n_equivs of every line of every page.

    Positions are 0-based, in page order. A line without text has an empty one.
    A line must have one text; `n_equivs` tells how many it has, and more or
    fewer is an error the caller may raise (see single_text).
    """
    # An outer explode with a filter behind it: a filter before it, which Spark adds to a plain one too, would parse pages again.
    regions = pages.select(*keys, F.posexplode_outer(parsed_page(F.col(xml))["Page"]["TextRegion"]).alias("region_idx", "region")).filter("region_idx IS NOT NULL")
    lines = regions.select(*keys, "region_idx", F.col("region._id").alias("region_id"), F.posexplode("region.TextLine").alias("line_idx", "line"))
    equiv = F.col("line.TextEquiv")
    return lines.select(
        *keys, "region_idx", "line_idx", "region_id", F.col("line._id").alias("line_id"), F.col("line._custom").alias("custom"),
        F.get(equiv, F.lit(0))["_conf"].alias("conf"), F.coalesce(strip(F.get(equiv, F.lit(0))["Unicode"]), F.lit("")).alias("text"),
        F.coalesce(F.size(equiv), F.lit(0)).alias("n_equivs"),
    )


def single_text(lines: DataFrame) -> DataFrame:
    """The same lines; the job fails at a line that has not exactly one text."""
    wrong = F.raise_error(F.concat(F.lit("not one text in line "), F.coalesce("line_id", F.lit("?"))))
    return lines.withColumn("text", F.when(F.col("n_equivs") == 1, F.col("text")).otherwise(wrong.cast("string")))


def flat_lines(pages: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """keys, line_idx (over the page), text: the lines with text, whatever region they are in."""
    lines = region_lines(pages, keys, xml).filter("text <> ''")
    ordered = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("region_idx", "line_idx", "text"))).alias("found"))
    return ordered.select(*keys, F.posexplode("found").alias("line_idx", "line")).select(*keys, "line_idx", F.col("line.text").alias("text"))


def layout_text(parsed: Column) -> Column:
    """Text of a parsed page as ARRAY<ARRAY<STRING>>: a paragraph per region, in page order; of a page without regions, none."""
    line = lambda x: F.coalesce(strip(F.get(x["TextEquiv"], F.lit(0))["Unicode"]), F.lit(""))
    text = F.transform(parsed["Page"]["TextRegion"], lambda r: F.coalesce(F.transform(r["TextLine"], line), F.array().cast("array<string>")))
    return F.coalesce(text, F.array().cast("array<array<string>>"))


def page_text(pages: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """keys, text (see layout_text) of the rows that are pages."""
    text = let(parsed_page(F.col(xml)), lambda p: F.when(p.isNotNull(), F.array(layout_text(p))))
    return pages.select(*keys, F.explode_outer(text).alias("text")).filter("text IS NOT NULL")


def with_text(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Add `text` (see layout_text) to each row; null where it is not a page, which write_back leaves as it is."""
    return pages.withColumn("text", let(parsed_page(F.col(xml)), lambda p: F.when(p.isNotNull(), layout_text(p))))


def reading_order(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add `region_order` and `line_order`, the custom attributes that name a region's and a line's place."""
    place = lambda i: F.format_string("readingOrder {index:%d}", F.col(i))
    return lines.withColumn("region_order", place("region_idx")).withColumn("line_order", place("line_idx"))


def zip_lines(lines: DataFrame, new_text: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with new text by position; lines without a partner keep theirs, new lines without one are dropped.

    new_text: keys, text as ARRAY<ARRAY<STRING>>.
    """
    new = new_text.select(*keys, F.posexplode("text").alias("region_idx", "par")).select(*keys, "region_idx", F.posexplode("par").alias("line_idx", "new_text"))
    joined = lines.join(new, [*keys, "region_idx", "line_idx"], "left")
    return joined.withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def patch_page(xml: str, text: list[list[str]], words: bool = False, order: bool = False) -> str:
    """A page with its lines' text replaced by region and position; what has no partner stays.

    words: line texts are split again for Word elements, and a region's own text
    becomes its lines joined by a carriage return and a line feed. order: every
    region and line is given its place.
    """
    parsing = ET.iterparse(io.StringIO(xml), events=["start-ns"])
    for _, (prefix, uri) in list(parsing):
        ET.register_namespace(prefix, uri)
    root = parsing.root
    space = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
    for i, region in enumerate(root.iter(f"{space}TextRegion")):
        if order:
            region.set("custom", f"readingOrder {{index:{i}}}")
        lines = list(region.iter(f"{space}TextLine"))
        for j, line in enumerate(lines):
            if order:
                line.set("custom", f"readingOrder {{index:{j}}}")
            if i >= len(text) or j >= len(text[i]):
                continue
            for unicode in line.findall(f"{space}TextEquiv/{space}Unicode"):
                unicode.text = text[i][j]
            if words:
                for word, new in zip(line.findall(f"{space}Word"), text[i][j].split()):
                    for unicode in word.findall(f"{space}TextEquiv/{space}Unicode"):
                        unicode.text = new
        if words:
            own = region.find(f"{space}TextEquiv/{space}Unicode")
            if own is not None:
                own.text = "\r\n".join(line.findtext(f"{space}TextEquiv/{space}Unicode") or "" for line in lines)
    # A bare carriage return would be read again as a line feed; in attributes it is written as a reference already.
    return ET.tostring(root, encoding="unicode").replace("\r", "&#13;")


def write_back(pages: DataFrame, xml: str = "xml", text: str = "text", words: bool = False, order: bool = False) -> DataFrame:
    """Replace `xml` by the page with the new text (ARRAY<ARRAY<STRING>>) in it; a null text leaves a page as it is."""
    small_batches(pages.sparkSession)
    names = pages.columns
    x, t = names.index(xml), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(x).to_pylist(), b.column(t).to_pylist())
            made = [p if p is None or n is None else patch_page(p, n, words, order) for p, n in pairs]
            columns = list(b.columns)
            columns[x] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.mapInArrow(run, pages.schema)


def wrap_lines(text: Column) -> Column:
    """A plain text as one region of lines: array of (line_id, text)."""
    return F.transform(
        F.split(text, "\n"), lambda x, i: F.struct(F.concat(F.lit("r1-l"), (i + 1).cast("string")).alias("line_id"), x.alias("text"))
    )


def wrap_page(text: Column) -> Column:
    """A plain text as page-layout XML with one region r1."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda r: F.concat(
        F.lit('<TextLine id="'), r["line_id"], F.lit('"><TextEquiv><Unicode>'), safe(r["text"]), F.lit("</Unicode></TextEquiv></TextLine>")
    )
    body = F.array_join(F.transform(wrap_lines(text), line), "")
    return F.concat(F.lit(f'<PcGts xmlns="{NAMESPACE}"><Metadata/><Page><TextRegion id="r1">'), body, F.lit("</TextRegion></Page></PcGts>"))
