"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fill_in_middle, html_extract, language_id, license_scan, mixing, near_duplicates, neighbours, piece_sampling, quality_rules, simhash, token_counts, toxicity,
    whitening,
)
from .common import held_out, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.3).cast("int").alias("predicted"),
        F.col("tox_hits").alias("n_hits"),
        F.col("tox_words").alias("n_words"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_sampling.sample_pieces(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"]).select(
        "doc_id",
        "sp_rank",
        F.size("sp_ids").alias("n_pieces"),
        F.xxhash64("sp_ids").alias("ids_hash"),
        F.round("sp_logp", 6).alias("sp_logp"),
        F.round("sp_gumbel", 6).alias("sp_gumbel"),
        F.round("sp_inclusion", 12).alias("sp_inclusion"),
        "sp_exact",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.usable(table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(neighbours.build_index(rows), rows.filter(F.col("vec_id") % 50 == 0))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix").alias("prefix_chars"),
        F.col("fim_middle").alias("middle_chars"),
        F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored().cast("binary"), 256).alias("restored_sha256"),
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality_rules, op3_ngram_jaccard, op4_html_extract, op5_mixing, op6_token_counts, op7_license_scan, op8_piece_sampling,
        op9_language_id, op10_neighbours, op11_fill_in_middle, op12_simhash, op13_whitening,
    )
}

ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM split, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y, c = a.n AND c = b.n AS equal FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, least(d.doc_id, (SELECT min(y) FROM links WHERE x = d.doc_id AND equal)) AS set_id,
       least(d.doc_id, (SELECT min(y) FROM reach WHERE x = d.doc_id)) AS class_id,
       (SELECT count(*) FROM links WHERE x = d.doc_id) AS n_links, coalesce(n, 0) AS n_shingles
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id
""",
    "op11_fill_in_middle": """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS y,
             ('0x' || substr(s, 17, 8))::BIGINT % 100 AS plain, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS spm FROM cut),
formed AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
                  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR plain >= 90 THEN 'plain'
                       WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
""",
    "op10_neighbours": """
WITH usable AS (SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                  AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
          FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op5_mixing": """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (SELECT source, n, sqrt(n::DOUBLE) AS share FROM sizes),
rates AS (SELECT source, coalesce(round((SELECT sum(n) FROM sizes)::DOUBLE * share / (SELECT sum(share) FROM shares) / n, 9), 0.0) AS rate FROM shares),
parts AS (SELECT source, rate, greatest(ceil(rate / 32), 1)::BIGINT AS m FROM rates),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below
        FROM (SELECT source, k, exp(-(rate / m)) * pow(rate / m, k) / gamma(k + 1) AS p
              FROM parts, (SELECT unnest(range(0, 129)) AS k))),
draws AS (SELECT d.doc_id, d.source, i,
                 (('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.m + 1)) AS t(i)),
counts AS (SELECT w.doc_id, w.source, sum(k)::INTEGER AS n FROM
           (SELECT draws.doc_id, draws.source, i, min(k) AS k FROM draws JOIN cdf ON draws.source IS NOT DISTINCT FROM cdf.source AND cdf.below >= draws.u GROUP BY ALL) w GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.rate AS mix_rate, c.n AS mix_copies, j::INTEGER AS mix_copy,
       ('0x' || substr(md5('order17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j::VARCHAR), 1, 13))::BIGINT AS mix_order
FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source, unnest(range(1, c.n + 1)) AS t(j)
""",
}
