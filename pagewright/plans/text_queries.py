"""Queries on reading, restructuring and rendering text, over documents, pages and conversations.

The documents have no blank lines and no words split at line ends, so both are
put in by position first, in Spark and in SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import align, text as T
from ..functions.unions import union
from ..operators import usage as U, words as W
from ..sources import archives, encodings, files, pages as P
from ..sources.checkpoints import shared_folder
from . import steps as S


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(files.table(spark, sf_dir, "documents")).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))


def broken(text: Column) -> Column:
    """The text with an empty line after every fourth line."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(i % 4 == 3, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.array_join(lines, "\n")


def with_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, content, text as paragraphs of lines."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", broken(F.col("text")).alias("content"))
    return S.Paragraphs().read(docs)


def doc_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))


#: SQL for the paragraphs of documents: par_idx, n (lines), lines; a document without any line has no row.
SQL_PARS = """
lines AS (SELECT doc_id, lang, i - 1 AS ln, trim(string_split(coalesce(text, ''), chr(10))[i], ' ' || chr(9) || chr(13)) AS line,
                 string_split(coalesce(text, ''), chr(10))[i] = '' AS bare, (i - 1) % 4 = 3 AS last
          FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
tail AS (SELECT doc_id, max(ln) AS top FROM lines GROUP BY doc_id),
runs AS (SELECT lines.*, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER w + coalesce(sum(CASE WHEN last THEN 1 ELSE 0 END) OVER b, 0) AS par_idx
         FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ln), b AS (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pars AS (SELECT doc_id, lang, par_idx, list(line ORDER BY ln) AS lines FROM runs WHERE line <> '' GROUP BY ALL),
"""


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pars = with_paragraphs(spark, sf_dir).select("doc_id", F.posexplode("text").alias("par_idx", "lines"))
    return pars.select("doc_id", "par_idx", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "|")).alias("lines_md5"))


def text_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.Paragraphs().render(with_paragraphs(spark, sf_dir))
    return docs.select("doc_id", F.length("result").alias("n_chars"), F.md5("result").alias("text_md5"))


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("n", T.lengths(F.split("text", "\n")))
    return docs.select("doc_id", F.size("n").alias("n_lines"), T.joined_length(F.col("n")).alias("n_joined"), F.array_max("n").alias("longest"))


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.line_offsets(doc_lines(documents(spark, sf_dir)), ["doc_id"]).select("doc_id", "line_idx", "ends", "before")


def join_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = T.join_page(F.col("text"))[0][0]
    return with_paragraphs(spark, sf_dir).select("doc_id", F.length(page).alias("n_chars"), F.md5(page).alias("page_md5"))


def join_page_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = S.JoinPage()
    docs = step.forward(with_paragraphs(spark, sf_dir))
    changed = docs.withColumn("text", F.transform("text", lambda p: F.transform(p, lambda x: F.replace(x, F.lit("th"), F.lit("thth")))))
    lines = step.backward(changed).select("doc_id", F.posexplode(F.flatten("text")).alias("line_idx", "line"))
    return lines.select("doc_id", "line_idx", F.md5("line").alias("line_md5"))


def realign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = S.STEPS["SEGMENTATION"]()
    docs = step.forward(with_paragraphs(spark, sf_dir))
    changed = docs.withColumn("text", F.transform("text", lambda p: F.transform(p, lambda x: F.replace(x, F.lit("th"), F.lit("thth")))))
    back = step.backward(changed).select("doc_id", F.posexplode("text").alias("par_idx", "lines"))
    lines = back.select("doc_id", "par_idx", F.posexplode("lines").alias("line_idx", "line"))
    return lines.select("doc_id", "par_idx", "line_idx", F.md5("line").alias("line_md5"))


def restructure_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = with_paragraphs(spark, sf_dir).withColumn("was", F.col("text"))
    step = S.STEPS["SEGMENTATION"]()
    docs = step.backward(step.forward(before))
    same = F.aggregate(
        F.zip_with(F.flatten("was"), F.flatten("text"), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x
    )
    per_doc = docs.select("lang", F.size(F.flatten("was")).alias("n"), same.alias("same"), T.joined_length(T.lengths(F.flatten("was"))).alias("size"))
    return per_doc.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.sum("size").alias("n_chars"), F.sum("same").alias("n_restored"),
        (F.sum("same") / F.sum("n")).alias("share_restored"),
    )


def hyphenated(text: Column) -> Column:
    return F.replace(text, F.lit(" the "), F.lit(" th-\ne "))


def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("lines", F.split(hyphenated(F.col("text")), "\n"))
    done = T.dehyphenate(F.col("lines"))
    return docs.select("doc_id", F.size("lines").alias("n_before"), F.size(done).alias("n_after"), F.md5(F.array_join(done, "\n")).alias("text_md5"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = T.split_sentences(T.join_lines(F.split("text", "\n")))
    found = documents(spark, sf_dir).select("doc_id", F.posexplode(sentences).alias("sentence_idx", "sentence"))
    return found.select("doc_id", "sentence_idx", F.length("sentence").alias("n_chars"), F.md5("sentence").alias("sentence_md5"))


def tokens_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("w", T.words(F.col("text")))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", "|")).alias("words_md5"), F.array_join(W.first_tokens(F.col("w")), "|").alias("first_words"))


def tokens_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("w", T.tokens(F.col("text")))
    return docs.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", "|")).alias("tokens_md5"))


def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = W.line_words(doc_lines(documents(spark, sf_dir)), ["doc_id"])
    return placed.groupBy("doc_id", "line_idx").agg(
        F.count("*").alias("n_words"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("word", "word_idx").alias("first_word"), F.max_by("word", "word_idx").alias("last_word")
    )


def ngrams3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.document_ngram_index(documents(spark, sf_dir), ["doc_id"])
    places = F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p + 1)
    return found.groupBy("doc_id").agg(F.sum(F.size("positions")).alias("n"), F.count("*").alias("n_distinct"), F.sum(F.length("ngram") * places).alias("weight"))


def ngram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.document_ngram_index(documents(spark, sf_dir), ["doc_id"])
    return found.filter(F.size("positions") > 1).select("doc_id", "ngram", F.size("positions").alias("n"), F.array_join("positions", ",").alias("positions"))


def dictionary_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dictionary(documents(spark, sf_dir).select("lang", F.explode(T.words(F.col("text"))).alias("word")), ["lang"])


def wrap_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("doc_id", F.explode(P.wrap_lines(F.col("text"))).alias("l"))
    return lines.select("doc_id", F.col("l.line_id").alias("line_id"), F.md5(F.col("l.text")).alias("text_md5"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = documents(spark, sf_dir).select("doc_id", P.wrap_page(F.col("text")).alias("xml"))
    lines = P.reading_order(P.region_lines(wrapped, ["doc_id"]), ["doc_id"])
    return lines.select("doc_id", "region_idx", "line_idx", "line_id", "region_order", "line_order", "n_equivs", F.md5("text").alias("text_md5"))


def marked(line: Column) -> Column:
    return F.concat(F.lit("# "), line)


def page_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wraps documents as pages, writes marked lines back (all but the last) and reads them again."""
    pages = documents(spark, sf_dir).select("doc_id", P.wrap_page(F.col("text")).alias("xml"))
    new = P.with_text(pages).withColumn("text", F.transform("text", lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), marked)))
    lines = P.region_lines(P.write_back(new), ["doc_id"])
    return lines.select("doc_id", "line_idx", F.md5("text").alias("text_md5"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the same document's marked lines by position, but for each document's last."""
    docs = documents(spark, sf_dir)
    lines = doc_lines(docs).withColumn("region_idx", F.lit(0))
    new = docs.select("doc_id", F.array(F.transform(F.slice(F.split("text", "\n"), F.lit(1), F.size(F.split("text", "\n")) - 1), marked)).alias("text"))
    return P.zip_lines(lines, new, ["doc_id"]).select("doc_id", "line_idx", F.md5("text").alias("text_md5"))


def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select(F.lit("document").alias("kind"), F.col("text").alias("content"))
    rows = rows.union(docs.select(F.lit("wrapped"), P.wrap_page(F.col("text"))))
    rows = rows.union(files.table(spark, sf_dir, "pages").select(F.lit("html"), "html")).union(
        files.table(spark, sf_dir, "pages").select(F.lit("markup"), F.concat(F.lit("\n <page>"), F.coalesce("url", F.lit("")), F.lit("</page>")))
    )
    return P.sniff_format(rows, "content").groupBy("kind", "format").agg(F.count("*").alias("n"))


def decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    latin = ~F.col("text").rlike("[^\\x00-\\x7F\\xA0-\\xFF]")
    raw = F.when((F.col("doc_id") % 3 == 1) & latin, F.encode("text", "ISO-8859-1")).when(F.col("doc_id") % 3 == 2, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    found = files.decode_text(docs.select("doc_id", F.col("text").alias("was"), raw.alias("content")))
    return found.select("doc_id", "encoding", (F.col("text") == F.col("was")).alias("same"), F.length("text").alias("n_chars"))


def encoding_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every second document written anew in one of seven encodings without a mark, told by a model of the others: by encoding, how
    many are taken for which, how many of them read as meant, and how sure that is at least."""
    docs = documents(spark, sf_dir)
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    model = encodings.learn(docs.filter(odd))
    told = encodings.tell_encoding(encodings.encoded(docs.filter(~odd)), model)
    right = F.count_if(F.col("text") == F.col("meant")).alias("n_right")
    return told.groupBy("was", F.coalesce("encoding", F.lit("refused")).alias("told")).agg(F.count("*").alias("n"), right, F.round(F.min("confidence"), 3).alias("least_confidence"))


def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.col("role"), F.coalesce("text", F.lit("")))
    turns = files.table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("turns/turn "), F.col("turn").cast("string"), F.lit(".xml")).alias("filename"), parts.alias("parts"))
    found = files.unzip(files.bundle(turns, "conv_id"), "conv_id")
    return found.select("conv_id", "member", F.md5("content").alias("content_md5"), "error")


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as one archive for each hundred conversations, and its members read in parallel."""
    turns = files.table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    member = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.row_number().over(order).cast("string"))
    rows = turns.select((F.col("conv_id") % 100).cast("string").alias("archive"), member.alias("member"), F.coalesce("text", F.lit("")).alias("content"))
    folder = f"{shared_folder(spark)}/archives-{uuid4().hex}"
    archives.write_archives(rows, folder)
    found = spark.read.format("zip").option("bytes", 1 << 20).load(folder)
    return found.select(F.regexp_extract("archive", r"([0-9]+)\.zip$", 1).alias("archive"), "member", "size", F.md5("content").alias("content_md5"), "error")


def multipage_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.assemble(files.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return found.select("conv_id", "n_pages", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def batch_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.collect_batch(files.table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role"])
    return found.select("conv_id", "n_results", F.array_join(F.transform("results", lambda r: r["role"]), ",").alias("roles"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = files.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return urls.select(
        "page_id", T.basename(F.col("path")).alias("basename"), T.extension(F.col("path")).alias("extension"), T.file_kind(F.col("path")).alias("kind"),
        T.corrected_name(F.col("path")).alias("corrected"), T.safe_name(F.col("path"), ".txt").alias("member"),
    )


def content_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("image/png", "text/html", "IMAGE/jpeg", "application/pdf")]), (F.col("page_id") % 4 + 1).cast("int"))
    fetched = files.table(spark, sf_dir, "pages").select("page_id", "url", kinds.alias("content_type"))
    good, bad = files.split_rejects(fetched, files.is_image(F.col("content_type")), "not an image")
    return union(good.withColumn("reason", F.lit("")), bad).groupBy("content_type", "reason").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, content: every second document as a page layout, the others as plain text with paragraphs."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, P.wrap_page(F.col("text"))).otherwise(broken(F.col("text"))).alias("content"))


def single_step_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page layouts and plain text joined line by line to one line a paragraph."""
    done = S.run_single(mixed_files(spark, sf_dir), S.STEPS["JOIN_LINES"]())
    return done.select("doc_id", "format", F.size(F.filter("text", lambda p: p[0] != "")).alias("n_paragraphs"), F.md5(F.array_join(F.filter(F.flatten("text"), lambda x: x != ""), "|")).alias("text_md5"))


def correct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step on every line, written back into the page or the text that came in, and read again."""
    files_ = mixed_files(spark, sf_dir).withColumn("path", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".xml").otherwise(".txt")))
    done = S.correct_files(files_, S.Lines("mark", marked), path="path").select("doc_id", "name", F.col("result").alias("content"))
    again = S.Sniffed().read(done)
    return again.select("doc_id", "name", "format", F.md5(F.array_join(F.flatten("text"), "|")).alias("text_md5"))


def page_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page layouts through segmentation, a change of every sentence, and back into the page, line by line."""
    pages = documents(spark, sf_dir).select("doc_id", P.wrap_page(F.col("text")).alias("content"))
    change = S.Lines("double", lambda x: F.replace(x, F.lit("th"), F.lit("thth")))
    done = S.run_pipeline(pages, S.PageLayout(), [S.STEPS["JOIN_PAGE"](), change])
    lines = P.region_lines(done.select("doc_id", F.col("result").alias("xml")), ["doc_id"])
    return lines.select("doc_id", "line_idx", "line_id", F.md5("text").alias("text_md5"))


def batch_of_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of page layouts and plain texts: unpacked, decoded, each member read by its kind, changed, and packed into one batch again."""
    turns = files.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    xml = F.col("turn") % 2 == 0
    member = F.concat_ws("-", F.col("turn").cast("string"), F.col("copy").cast("string"))
    sent = turns.select("conv_id", member.alias("filename"), F.array(F.when(xml, P.wrap_page(F.col("text"))).otherwise(F.col("text"))).alias("parts"), F.when(xml, ".xml").otherwise(".txt").alias("ext"))
    members = files.decode_text(files.unzip(files.bundle(sent, "conv_id", F.col("ext")), "conv_id")).select("conv_id", "member", F.col("text").alias("content"))
    done = S.correct_files(members, S.Lines("mark", marked))
    results = done.select("conv_id", F.col("member").alias("filename"), F.array("result").alias("parts"), F.when(F.col("format") == "page", ".xml").otherwise(".txt").alias("ext"))
    back = files.decode_text(files.unzip(files.bundle(results, "conv_id", F.col("ext")), "conv_id"))
    again = S.Sniffed().read(back.select("conv_id", "member", F.col("text").alias("content")))
    return again.select("conv_id", "member", "format", F.md5(F.array_join(F.flatten("text"), "|")).alias("text_md5"))


def text_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of plain text as they are, and stripped and without the empty ones."""
    docs = documents(spark, sf_dir).select("doc_id", T.text_lines(F.col("text"), False, False).alias("every"), T.text_lines(F.col("text")).alias("kept"))
    return docs.select("doc_id", F.size("every").alias("n_lines"), F.size("kept").alias("n_kept"), F.md5(F.array_join("kept", "|")).alias("kept_md5"))


def rebuilt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's tokens as one line again, and its placeholders as what they stand for."""
    docs = documents(spark, sf_dir).select("doc_id", "text", T.rebuild_line(T.tokens(F.col("text"))).alias("line"))
    restored = T.restore_marks(F.replace("text", F.lit(" "), F.lit("__SEP__")))
    return docs.select("doc_id", F.length("line").alias("n_chars"), F.md5("line").alias("line_md5"), F.md5(restored).alias("restored_md5"))


def evaluation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as they are scored."""
    docs = documents(spark, sf_dir).select("doc_id", T.evaluation_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", "|")).alias("words_md5"))


def metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document costs as a list of lines, as a text file and as bytes."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", U.text_size(F.split("text", "\n")).alias("as_lines"), U.file_size(F.concat(F.lit("\n "), F.col("text"), F.lit("\n"))).alias("as_file"), U.byte_size(F.col("text")).alias("as_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        restructure_by_lang, paragraph_split, text_render, line_lengths, running_offsets, join_page, join_page_backward, realign_lines, dehyphenate,
        sentence_split, tokens_ws, tokens_alt, word_positions, ngrams3, ngram_index, dictionary_freq, wrap_page_lines, reading_order, page_write_back,
        positional_zip, single_step_files, correct_files, page_pipeline, batch_of_both_kinds, metering, text_line_scan, rebuilt_text, evaluation_tokens, format_sniff, decode_files, encoding_confusion, zip_round_trip, archive_round_trip, multipage_assemble, batch_fan_in, file_names, content_type_gate,
    )
}

SQL_LINES = """lines AS (SELECT doc_id, lang, i - 1 AS line_idx, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i))"""
SQL_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
#: Marks sentence ends, as RE2 cannot look around.
SQL_SENTENCES = "list_filter(string_split(regexp_replace({0}, '([.!?][\"'')]?)\\s+([\"''(]?\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '')"
SQL_SEGMENT = SQL_SENTENCES.format("array_to_string(string_split(regexp_replace(array_to_string(lines, chr(10)), '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g'), chr(10)), ' ')")


def sql_realign(changed: str) -> str:
    """Common table expressions from pars to back(doc_id, lang, par_idx, line_idx, line, was)."""
    return f"""
seg AS (SELECT *, {SQL_SEGMENT} AS s FROM pars),
joined AS (SELECT *, array_to_string(list_transform(s, lambda x: {changed}), ' ') AS j, length(array_to_string(s, ' ')) AS n_out FROM seg),
ends AS (SELECT doc_id, lang, par_idx, j, i - 1 AS line_idx, lines[i] AS was, len(lines) AS n,
                round_even(length(j)::DOUBLE / n_out * length(array_to_string(lines[1:i], ' ')), 0)::BIGINT AS p
         FROM joined, unnest(range(1, len(lines) + 1)) AS t(i)),
splits AS (SELECT *, CASE WHEN instr(substr(j, p + 1), ' ') > 0 THEN p + instr(substr(j, p + 1), ' ') - 1 ELSE length(j) END AS e FROM ends),
bounds AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, par_idx ORDER BY line_idx) + 1, 0) AS a,
                  CASE WHEN line_idx = n - 1 THEN length(j) ELSE e END AS b FROM splits),
back AS (SELECT doc_id, lang, par_idx, line_idx, was, substr(j, a + 1, greatest(b - a, 0)) AS line FROM bounds)
"""


#: A line as marking leaves it, without white space at its ends.
SQL_MARKED = "CASE WHEN trim({0}, ' ' || chr(9) || chr(13)) = '' THEN '#' ELSE '# ' || trim({0}, ' ' || chr(9) || chr(13)) END"
SQL_BLANK = "trim({0}, ' ' || chr(9) || chr(13)) = ''"

ORACLE_SQL = {
    "single_step_files": f"""
WITH {SQL_PARS} joined AS (SELECT doc_id, par_idx, array_to_string(lines, ' ') AS j FROM pars),
plain AS (SELECT d.doc_id, 'text' AS format, count(j) AS n, coalesce(string_agg(j, '|' ORDER BY par_idx), '') AS t FROM documents d LEFT JOIN joined USING (doc_id) WHERE d.doc_id % 2 <> 0 GROUP BY d.doc_id),
page AS (SELECT doc_id, 'page' AS format, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), ' ') AS t FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, format, n::INTEGER AS n_paragraphs, md5(t) AS text_md5 FROM plain UNION ALL SELECT doc_id, format, (t <> '')::INTEGER, md5(t) FROM page
""",
    "correct_files": f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
SELECT doc_id, doc_id::VARCHAR || '_corrected' || CASE WHEN doc_id % 2 = 0 THEN '.xml' ELSE '.txt' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'page' ELSE 'text' END AS format,
       md5(array_to_string(list_transform(CASE WHEN doc_id % 2 = 0 THEN l ELSE list_filter(l, lambda x: NOT {SQL_BLANK.format("x")}) END, lambda x: {SQL_MARKED.format("x")}), '|')) AS text_md5 FROM l
""",
    "page_pipeline": """
WITH page AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS lines FROM documents),
joined AS (SELECT *, array_to_string(lines, ' ') AS x, replace(array_to_string(lines, ' '), 'th', 'thth') AS j FROM page),
ends AS (SELECT doc_id, j, i - 1 AS line_idx, CASE WHEN length(x) = 0 THEN 0 ELSE round_even(length(j)::DOUBLE / length(x) * length(array_to_string(lines[1:i], ' ')), 0)::BIGINT END AS p
         FROM joined, unnest(range(1, len(lines) + 1)) AS t(i)),
splits AS (SELECT *, CASE WHEN instr(substr(j, p + 1), ' ') > 0 THEN p + instr(substr(j, p + 1), ' ') - 1 ELSE length(j) END AS e FROM ends),
bounds AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY line_idx) + 1, 0) AS a FROM splits)
SELECT doc_id, line_idx::INTEGER AS line_idx, 'r1-l' || (line_idx + 1)::VARCHAR AS line_id, md5(trim(substr(j, a + 1, greatest(e - a, 0)), ' ')) AS text_md5 FROM bounds
""",
    "batch_of_both_kinds": f"""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS copy, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations)
SELECT conv_id, turn::VARCHAR || '-' || copy::VARCHAR || CASE WHEN turn % 2 = 0 THEN '.xml' ELSE '.txt' END AS member, CASE WHEN turn % 2 = 0 THEN 'page' ELSE 'text' END AS format,
       md5(array_to_string(list_transform(CASE WHEN turn % 2 = 0 THEN l ELSE list_filter(l, lambda x: NOT {SQL_BLANK.format("x")}) END, lambda x: {SQL_MARKED.format("x")}), '|')) AS text_md5 FROM t
""",
    "text_line_scan": f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM l),
c AS (SELECT doc_id, l, list_transform(list_filter(l, lambda x: NOT {SQL_BLANK.format("x")}), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS kept FROM k)
SELECT doc_id, len(l)::INTEGER AS n_lines, len(kept)::INTEGER AS n_kept, md5(array_to_string(kept, '|')) AS kept_md5 FROM c
""",
    "rebuilt_text": """
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}_]+(?:[' || chr(39) || '@&][\\p{L}\\p{M}\\p{N}_]+)*|[^\\p{L}\\p{M}\\p{N}_\\s]') AS w FROM documents),
r AS (SELECT doc_id, text, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 OR (regexp_matches(x, '^[[:punct:]]$') AND NOT ends_with(w[i - 1], ']')) THEN x ELSE ' ' || x END), '') AS line FROM w)
SELECT doc_id, length(line)::INTEGER AS n_chars, md5(line) AS line_md5, md5(coalesce(text, '')) AS restored_md5 FROM r
""",
    "evaluation_tokens": """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '’', chr(39)), '[\\p{L}\\p{N}]+') AS w FROM documents)
SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, '|')) AS words_md5 FROM w
""",
    "metering": """
SELECT doc_id, length(replace(coalesce(text, ''), chr(10), ''))::INTEGER AS as_lines, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)))::INTEGER AS as_file,
       strlen(coalesce(text, ''))::INTEGER AS as_bytes FROM documents
""",
    "restructure_by_lang": f"""
WITH {SQL_PARS} {sql_realign("x")},
docs AS (SELECT lang, doc_id, count(*) AS n, sum(length(was)) + count(*) - 1 AS size, sum(CASE WHEN was = line THEN 1 ELSE 0 END) AS same FROM back GROUP BY ALL),
every AS (SELECT d.lang, coalesce(n, 0) AS n, coalesce(size, -1) AS size, coalesce(same, 0) AS same FROM documents d LEFT JOIN docs USING (doc_id))
SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_lines, sum(size)::BIGINT AS n_chars, sum(same)::BIGINT AS n_restored, sum(same)::DOUBLE / sum(n) AS share_restored FROM every GROUP BY lang
""",
    "paragraph_split": f"""
WITH {SQL_PARS}
blanks AS (SELECT doc_id, sum((line = '' AND NOT (ln = top AND bare AND NOT last))::INTEGER + (last AND ln < top)::INTEGER) AS n FROM lines JOIN tail USING (doc_id) GROUP BY doc_id),
every AS (SELECT doc_id, unnest(range(0, n::BIGINT)) AS par_idx FROM blanks UNION SELECT doc_id, par_idx FROM pars)
SELECT e.doc_id, e.par_idx::INTEGER AS par_idx, coalesce(len(lines), 0)::INTEGER AS n_lines, md5(coalesce(array_to_string(lines, '|'), '')) AS lines_md5
FROM every e LEFT JOIN pars p ON e.doc_id = p.doc_id AND e.par_idx = p.par_idx
""",
    "text_render": f"""
WITH {SQL_PARS}
cut AS (SELECT doc_id, ln, CASE WHEN line = '' THEN chr(1) ELSE line END || CASE WHEN last AND ln < top THEN chr(10) || chr(1) ELSE '' END AS x
        FROM lines JOIN tail USING (doc_id) WHERE NOT (ln = top AND bare)),
one AS (SELECT d.doc_id, coalesce(string_agg(x, chr(10) ORDER BY ln), '') AS t FROM documents d LEFT JOIN cut USING (doc_id) GROUP BY d.doc_id),
made AS (SELECT doc_id, replace(regexp_replace(replace(replace(t, chr(10) || chr(1), chr(1)), chr(1) || chr(10), chr(1)), '\\x01$', ''), chr(1), chr(10) || chr(10)) || chr(10) AS r FROM one)
SELECT doc_id, length(r)::INTEGER AS n_chars, md5(r) AS text_md5 FROM made
""",
    "line_lengths": f"WITH {SQL_LINES} SELECT doc_id, count(*)::INTEGER AS n_lines, (sum(length(line)) + count(*) - 1)::INTEGER AS n_joined, max(length(line))::INTEGER AS longest FROM lines GROUP BY doc_id",
    "running_offsets": f"""
WITH {SQL_LINES},
ends AS (SELECT doc_id, line_idx, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx) - 1)::BIGINT AS ends FROM lines)
SELECT doc_id, line_idx::INTEGER AS line_idx, ends, lag(ends) OVER (PARTITION BY doc_id ORDER BY line_idx) AS before FROM ends
""",
    "join_page": f"""
WITH {SQL_PARS}
page AS (SELECT d.doc_id, coalesce(string_agg(array_to_string(lines, ' '), ' ' ORDER BY par_idx), '') AS p FROM documents d LEFT JOIN pars USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, length(p)::INTEGER AS n_chars, md5(p) AS page_md5 FROM page
""",
    "join_page_backward": f"""
WITH {SQL_PARS}
page AS (SELECT doc_id, flatten(list(lines ORDER BY par_idx)) AS lines FROM pars GROUP BY doc_id),
joined AS (SELECT *, array_to_string(lines, ' ') AS x, replace(array_to_string(lines, ' '), 'th', 'thth') AS j FROM page),
ends AS (SELECT doc_id, j, i - 1 AS line_idx, round_even(length(j)::DOUBLE / length(x) * length(array_to_string(lines[1:i], ' ')), 0)::BIGINT AS p
         FROM joined, unnest(range(1, len(lines) + 1)) AS t(i)),
splits AS (SELECT *, CASE WHEN instr(substr(j, p + 1), ' ') > 0 THEN p + instr(substr(j, p + 1), ' ') - 1 ELSE length(j) END AS e FROM ends),
bounds AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY line_idx) + 1, 0) AS a FROM splits)
SELECT doc_id, line_idx::INTEGER AS line_idx, md5(substr(j, a + 1, greatest(e - a, 0))) AS line_md5 FROM bounds
""",
    "realign_lines": f"""
WITH {SQL_PARS} {sql_realign("replace(x, 'th', 'thth')")}
SELECT doc_id, par_idx::INTEGER AS par_idx, line_idx::INTEGER AS line_idx, md5(line) AS line_md5 FROM back
""",
    "dehyphenate": """
WITH split AS (SELECT doc_id, replace(coalesce(text, ''), ' the ', ' th-' || chr(10) || 'e ') AS t FROM documents),
done AS (SELECT doc_id, t, regexp_replace(t, '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g') AS d FROM split)
SELECT doc_id, len(string_split(t, chr(10)))::INTEGER AS n_before, len(string_split(d, chr(10)))::INTEGER AS n_after, md5(d) AS text_md5 FROM done
""",
    "sentence_split": f"""
WITH s AS (SELECT doc_id, {SQL_SENTENCES.format("replace(coalesce(text, ''), chr(10), ' ')")} AS s FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS sentence_idx, length(s[i])::INTEGER AS n_chars, md5(s[i]) AS sentence_md5 FROM s, unnest(range(1, len(s) + 1)) AS t(i)
""",
    "tokens_ws": f"SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, '|')) AS words_md5, array_to_string(w[1:5], '|') AS first_words FROM (SELECT doc_id, {SQL_WORDS} AS w FROM documents)",
    "tokens_alt": """
SELECT doc_id, len(w)::INTEGER AS n_tokens, md5(array_to_string(w, '|')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}_]+(?:[''@&][\\p{L}\\p{M}\\p{N}_]+)*|[^\\p{L}\\p{M}\\p{N}_\\s]') AS w FROM documents)
""",
    "word_positions": f"""
WITH {SQL_LINES},
w AS (SELECT doc_id, line_idx, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM lines),
n AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT doc_id, line_idx::INTEGER AS line_idx, len(w) AS n_words, before::INTEGER AS first_pos, (before + len(w) - 1)::INTEGER AS last_pos, w[1] AS first_word, w[len(w)] AS last_word
FROM n WHERE len(w) > 0
""",
    "ngrams3": f"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 2], ' ') AS ngram FROM w, unnest(range(1, len(w) - 1)) AS t(i))
SELECT doc_id, count(*) AS n, count(DISTINCT ngram) AS n_distinct, sum(length(ngram) * (pos + 1))::BIGINT AS weight FROM g GROUP BY doc_id
""",
    "ngram_index": f"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 2], ' ') AS ngram FROM w, unnest(range(1, len(w) - 1)) AS t(i))
SELECT doc_id, ngram, count(*)::INTEGER AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM g GROUP BY doc_id, ngram HAVING count(*) > 1
""",
    "dictionary_freq": f"SELECT lang, term, count(*) AS freq FROM (SELECT lang, unnest({SQL_WORDS}) AS term FROM documents) GROUP BY ALL",
    "wrap_page_lines": f"WITH {SQL_LINES} SELECT doc_id, 'r1-l' || (line_idx + 1)::VARCHAR AS line_id, md5(line) AS text_md5 FROM lines",
    "reading_order": f"""
WITH {SQL_LINES}
SELECT doc_id, 0 AS region_idx, line_idx::INTEGER AS line_idx, 'r1-l' || (line_idx + 1)::VARCHAR AS line_id, 'readingOrder {{index:0}}' AS region_order,
       'readingOrder {{index:' || line_idx::VARCHAR || '}}' AS line_order, 1 AS n_equivs, md5(trim(line, ' ' || chr(9) || chr(13))) AS text_md5 FROM lines
""",
    "page_write_back": f"""
WITH {SQL_LINES}
SELECT doc_id, line_idx::INTEGER AS line_idx,
       md5(trim(CASE WHEN line_idx < max(line_idx) OVER (PARTITION BY doc_id) THEN '# ' || line ELSE line END, ' ' || chr(9) || chr(13))) AS text_md5 FROM lines
""",
    "positional_zip": f"""
WITH {SQL_LINES}
SELECT doc_id, line_idx::INTEGER AS line_idx, md5(CASE WHEN line_idx < max(line_idx) OVER (PARTITION BY doc_id) THEN '# ' || line ELSE line END) AS text_md5 FROM lines
""",
    "format_sniff": """
WITH rows AS (SELECT 'document' AS kind, coalesce(text, '') AS content FROM documents UNION ALL SELECT 'html', html FROM pages)
SELECT kind, CASE WHEN regexp_matches(coalesce(content, ''), '^\\s*<(\\?xml|[A-Za-z_][\\w.:-]*[\\s/>])') THEN 'xml' ELSE 'text' END AS format, count(*) AS n FROM rows GROUP BY ALL
UNION ALL SELECT 'wrapped', 'page', count(*) FROM documents HAVING count(*) > 0
UNION ALL SELECT 'markup', 'xml', count(*) FROM pages HAVING count(*) > 0
""",
    "decode_files": """
SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND NOT regexp_matches(t, '[^\\x00-\\x7F\\x{A0}-\\x{FF}]') AND regexp_matches(t, '[^\\x00-\\x7F]') THEN 'windows-1252'
                    WHEN doc_id % 3 = 2 AND t <> '' THEN 'UTF-16BE' ELSE 'UTF-8' END AS encoding, TRUE AS same, length(t)::INTEGER AS n_chars
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "zip_round_trip": "SELECT conv_id, 'turn ' || turn::VARCHAR || '.txt' AS member, md5(role || chr(10) || chr(10) || coalesce(text, '')) AS content_md5, NULL::VARCHAR AS error FROM conversations",
    "archive_round_trip": """
SELECT (conv_id % 100)::VARCHAR AS archive, conv_id::VARCHAR || '/' || turn::VARCHAR || '/' || (row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST))::VARCHAR AS member,
       strlen(coalesce(text, ''))::BIGINT AS size, md5(coalesce(text, '')) AS content_md5, NULL::VARCHAR AS error FROM conversations
""",
    "multipage_assemble": "SELECT conv_id, count(*) AS n_pages, length(string_agg(coalesce(text, ''), chr(10) ORDER BY turn))::INTEGER AS n_chars, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id",
    "batch_fan_in": "SELECT conv_id, count(*) AS n_results, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id",
    "file_names": """
WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]*)$', 1) AS b FROM pages),
e AS (SELECT page_id, b, lower(regexp_extract(b, '(\\.[^./\\\\]+)$', 1)) AS x, regexp_replace(b, '\\.[^.]*$', '') AS stem,
             regexp_replace(regexp_replace(b, '[^A-Za-z0-9._ -]', '_', 'g'), '\\.[^.]*$', '') AS bare FROM p)
SELECT page_id, b AS basename, x AS extension, CASE WHEN x IN ('.txt', '.pdf', '.xml') THEN substr(x, 2) ELSE 'other' END AS kind,
       stem || '_corrected' || regexp_extract(b, '(\\.[^.]*)$', 1) AS corrected, CASE WHEN bare = '' THEN 'file' ELSE bare END || '.txt' AS member FROM e
""",
    "content_type_gate": """
WITH f AS (SELECT url, ['image/png', 'text/html', 'IMAGE/jpeg', 'application/pdf'][page_id % 4 + 1] AS content_type FROM pages)
SELECT content_type, CASE WHEN starts_with(lower(content_type), 'image/') THEN '' ELSE 'not an image' END AS reason, count(*) AS n, min(url) AS first_url FROM f GROUP BY ALL
""",
}
