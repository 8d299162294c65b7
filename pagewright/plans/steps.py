"""Reversible steps and the pipelines made of them.

A step turns a DataFrame with a document's `text` into another and can turn
the (possibly changed) result back onto the original lines. What it needs for
that travels in the row, in columns of the step's own, so a pipeline of any
length is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align, text as T
from ..operators.enrich import Batch, enrich
from ..sources.pages import layout_text, parse_pages, write_back

RENDER = "RENDER_TXT"


class Step:
    """forward and backward both leave the text as it is."""

    def __init__(self, name: str = ""):
        self.name = name or type(self).__name__.lower()

    def forward(self, docs: DataFrame) -> DataFrame:
        return docs

    def backward(self, docs: DataFrame) -> DataFrame:
        return docs


class Segmentation(Step):
    """Applies a function of a paragraph's lines; backward maps sentences onto the original lines."""

    def __init__(self, name: str, segment: Callable[[Column], Column]):
        super().__init__(name)
        self.segment = segment
        self.n_in, self.n_out = f"{name}_n_in", f"{name}_n_out"

    def forward(self, docs: DataFrame) -> DataFrame:
        docs = docs.withColumn(self.n_in, T.line_lengths(F.col("text")))
        docs = docs.withColumn("text", F.transform("text", self.segment))
        return docs.withColumn(self.n_out, T.line_lengths(F.col("text")))

    def backward(self, docs: DataFrame) -> DataFrame:
        back = align.realign_document(F.col("text"), F.col(self.n_in), F.col(self.n_out))
        return docs.withColumn("text", back).drop(self.n_in, self.n_out)


class JoinPage(Step):
    """The whole document as one line; backward cuts it into the original lines."""

    def __init__(self, name: str = "join_page"):
        super().__init__(name)
        self.n_in, self.n_out = f"{name}_n_in", f"{name}_n_out"

    def forward(self, docs: DataFrame) -> DataFrame:
        docs = docs.withColumn(self.n_in, T.line_lengths(F.col("text"))).withColumn("text", T.join_page(F.col("text")))
        return docs.withColumn(self.n_out, T.line_lengths(F.col("text")))

    def backward(self, docs: DataFrame) -> DataFrame:
        back = align.split_page(F.col("text"), F.col(self.n_in), F.col(self.n_out))
        return docs.withColumn("text", back).drop(self.n_in, self.n_out)


class Lines(Step):
    """Applies a function of one line's text to every line, such as a correction by built-in expressions."""

    def __init__(self, name: str, change: Callable[[Column], Column]):
        super().__init__(name)
        self.change = change

    def forward(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("text", F.transform("text", lambda p: F.transform(p, self.change)))


class Service(Step):
    """Sends all lines of a document to a model of the user's; a document that fails keeps its text and an error.

    call: gets a list of documents, each a list of lines, and returns as many of
    each.
    """

    def __init__(self, name: str, call: Batch, on_error: str = "pass_through"):
        super().__init__(name)
        self.call, self.on_error = call, on_error

    def forward(self, docs: DataFrame) -> DataFrame:
        sent = docs.withColumn("_lines", F.flatten("text"))
        done = enrich(sent, self.call, "_lines", "_new", "array<string>", self.on_error).drop("_lines")
        done = done.withColumn("text", align.regroup(F.col("_new"), F.col("text"))).drop("_new")
        return done.withColumnRenamed("status", f"{self.name}_status").withColumnRenamed("error", f"{self.name}_error")


class Paragraphs:
    """Reads plain text into paragraphs of lines, and renders them."""

    def read(self, docs: DataFrame, content: str = "content") -> DataFrame:
        return docs.withColumn("text", T.paragraphs(F.col(content)))

    def render(self, docs: DataFrame, to: str = "result") -> DataFrame:
        return docs.withColumn(to, T.render(F.col("text")))


class PageLayout:
    """Reads page-layout XML into a paragraph per region, and writes the text back into the page."""

    def read(self, docs: DataFrame, content: str = "content") -> DataFrame:
        return parse_pages(docs, content).withColumn("text", layout_text(F.col("parsed"))).drop("parsed", "is_page")

    def render(self, docs: DataFrame, to: str = "result", content: str = "content") -> DataFrame:
        return write_back(docs.withColumn(to, F.col(content)), to, "text")


class Sniffed:
    """Reads page layouts and plain text side by side; each row's `format` (page or text) tells how it is read and rendered."""

    def read(self, docs: DataFrame, content: str = "content") -> DataFrame:
        parsed = parse_pages(docs, content)
        text = F.when(F.col("is_page"), layout_text(F.col("parsed"))).otherwise(T.paragraphs(F.col(content)))
        return parsed.withColumn("text", text).withColumn("format", F.when(F.col("is_page"), "page").otherwise("text")).drop("parsed", "is_page")

    def render(self, docs: DataFrame, to: str = "result", content: str = "content") -> DataFrame:
        # A row without XML is passed over by write_back.
        pages = write_back(docs.withColumn(to, F.when(F.col("format") == "page", F.col(content))), to, "text")
        return pages.withColumn(to, F.when(F.col("format") == "page", F.col(to)).otherwise(T.render(F.col("text"))))


Parser = Paragraphs | PageLayout | Sniffed


#: Steps by key; each value makes a new step.
STEPS: dict[str, Callable[[], Step]] = {
    "DEHYPHENATION": lambda: Segmentation("dehyphenation", T.dehyphenate),
    "JOIN_LINES": lambda: Segmentation("join_lines", T.join_lines),
    "SENTENCE_SEGMENTATION": lambda: Segmentation("sentences", T.split_sentences),
    "SEGMENTATION": lambda: Segmentation("segmentation", T.segment),
    "JOIN_PAGE": lambda: JoinPage(),
}
DESCRIPTIONS = {
    "DEHYPHENATION": ("Dehyphenation", "Joins words that a line end splits"),
    "JOIN_LINES": ("Join lines", "Makes one line of a paragraph"),
    "SENTENCE_SEGMENTATION": ("Sentence segmentation", "Puts every sentence on a line of its own"),
    "SEGMENTATION": ("Segmentation", "Dehyphenation, joining and sentence segmentation in one"),
    "JOIN_PAGE": ("Join page", "Makes one line of a document"),
    RENDER: ("Plain text", "Gives the result as plain text"),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """key, name, description of every option."""
    return spark.createDataFrame([(k, *v) for k, v in DESCRIPTIONS.items()], "key string, name string, description string")


def make_steps(options: Sequence[str]) -> tuple[list[Step], bool]:
    """Steps of options in their order, and whether plain text is asked for; unknown options raise, all named."""
    wanted = [o.strip().upper() for o in options if o.strip()]
    wrong = [o for o in wanted if o != RENDER and o not in STEPS]
    if wrong:
        raise ValueError("not valid: " + ", ".join(wrong))
    return [STEPS[o]() for o in wanted if o != RENDER], RENDER in wanted


def check_options(options: Column) -> Column:
    """Options that no step has, of a list column."""
    return F.array_except(options, F.array(*[F.lit(k) for k in [*STEPS, RENDER]]))


def run_steps(docs: DataFrame, steps: Sequence[Step], reconstruct: bool = True) -> DataFrame:
    """All steps forward and, if asked, all of them backward in reverse order."""
    for s in steps:
        docs = docs.transform(s.forward)
    for s in reversed(steps) if reconstruct else ():
        docs = docs.transform(s.backward)
    return docs


def run_pipeline(docs: DataFrame, parser: Parser, steps: Sequence[Step], reconstruct: bool = True, content: str = "content") -> DataFrame:
    """Read, run the steps and, if asked, map back and render into `result`; without it `text` is what the last step gave."""
    done = run_steps(parser.read(docs, content), steps, reconstruct)
    return parser.render(done) if reconstruct else done.withColumn("result", T.render(F.col("text")))


def run_single(docs: DataFrame, step: Step, content: str = "content") -> DataFrame:
    """One step on files, page layouts and plain text alike: `format`, `text` as nested lists and `file` as flat text."""
    return step.forward(Sniffed().read(docs, content)).withColumn("file", T.render(F.col("text")))


def correct_files(docs: DataFrame, step: Step, content: str = "content", path: str | None = None) -> DataFrame:
    """One step that keeps lines, on files: `result` is a file of the kind that came in, `name` (where a path is there) its name."""
    done = Sniffed().render(step.forward(Sniffed().read(docs, content)), content=content)
    return done if path is None else done.withColumn("name", T.corrected_name(F.col(path)))
