"""Corpus preparation in five stages.

Each function takes (spark, docs, sf_dir) and returns the documents the next
stage works on; the last returns sampled segmentations of the mixed corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language_id, mixing, near_duplicates, piece_sampling, quality_rules
from pagewright.llm.common import settle
from pagewright.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is taken as found at this posterior; below it, or with no letter, the document goes.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is `und` or has a posterior under SURE; the model is learned from the documents themselves.

    So null texts, empty ones and those without a letter go. A null lang teaches
    nothing but its document stays; a null doc_id does so too. Ties go to the
    language first in the alphabet. Repeated rows stay as often as they are
    there; where nothing can be learned every document goes.
    """
    found = language_id.identify(docs.select(*COLUMNS), language_id.train(docs))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= SURE)).select(*COLUMNS)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or whose posterior of being good is under one half.

    Null and empty texts fail. Equal votes have equal posteriors, and exactly one
    half stays. Other columns play no part, null or not; repeated rows stay as
    often as they are there; no rows give no rows.
    """
    return quality_rules.judge(docs, keep=COLUMNS[1:]).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates keep the document with the smallest doc_id, once.

    A document without doc_id stays unless it is like one with a doc_id, or like
    another without that is kept. One doc_id on two texts that are not alike
    keeps both. Rows with the same doc_id and text are one document; of them the
    smallest by its other columns is kept. Texts without words, null ones too,
    are like nothing and stay, every row. No rows give no rows.
    """
    return near_duplicates.one_per_class(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources have the target shares, in one random order.

    A null source is one of its own. Rows that repeat a doc_id are repeated
    equally often, a null doc_id counts as the empty text, and copies with the
    same place in the order are sorted by their other columns. No rows give none.
    """
    return mixing.mix_sources(docs).select(*COLUMNS)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, as piece ids.

    A text with one segmentation alone has one row, a null or empty text among
    them, without pieces. Rows that repeat a doc_id and a text get the same
    samples; no rows give no rows.
    """
    return piece_sampling.sample_pieces(docs, tokenizer_path("piece_bpe_32k.model"), keep=[c for c in COLUMNS if c != "text"])


STAGES = [
    ("language ID", identify_language),
    ("quality rules", judge_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", sample_segmentations),
]

#: The first, second and last stage have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
