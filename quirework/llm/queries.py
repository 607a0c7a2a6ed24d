"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

from quirework.llm import (
    alignment,
    embedding_dedup,
    exact_dedup,
    html_extraction,
    licenses,
    merkle,
    mixing,
    oracles,
    packing,
    pii,
    secrets,
    simhash,
    substring_dedup,
    toxicity,
)
from quirework.llm.common import table


def op1_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark, sf_dir):
    columns = ("doc_id", "size", "source_size", "target", "taken", "first_slot")
    return mixing.mix(table(spark, sf_dir, "documents")).select(*columns)


def op5_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_html_extraction(spark, sf_dir):
    return html_extraction.extract_text(table(spark, sf_dir, "pages")).drop("n_shared")


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark, sf_dir):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    f.__name__: f
    for f in (
        op1_licenses,
        op2_substring_dedup,
        op3_packing,
        op4_mixing,
        op5_pii,
        op6_embedding_dedup,
        op7_exact_dedup,
        op8_secrets,
        op9_simhash,
        op10_toxicity,
        op11_html_extraction,
        op12_merkle_manifest,
        op13_tokenizer_alignment,
    )
}

ORACLES = oracles.ORACLES | {
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op4_mixing": r"""
        WITH sizes AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents
        ), src AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) AS k
            FROM sizes GROUP BY source
        ), cap AS (
            SELECT *, [3, 1, 2][((k - 1) % 3 + 1)::INT] AS w, source_size * 2 AS c FROM src
        ), lvl AS (
            SELECT *, c / w AS r,
                   ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(c) OVER (ORDER BY c / w, k
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / (sum(w) OVER (ORDER BY c / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM cap
        ), tgt AS (
            SELECT source, k, source_size, least(
                       coalesce((SELECT arg_min(level, (r, k)) FROM lvl WHERE level <= r), 0.0) * w, c::DOUBLE) AS target
            FROM lvl
        ), quotas AS (
            SELECT *, floor(target)::BIGINT AS quota FROM tgt
        ), totals AS (
            SELECT sum(quota)::BIGINT AS total FROM quotas WHERE source_size > 0 AND target >= 1
        ), cut AS (
            SELECT source, k, source_size, quota, greatest(1, least((total + 65535) // 65536, quota // 256))::BIGINT AS block
            FROM quotas, totals WHERE source_size > 0 AND target >= 1
        ), counted AS (
            SELECT *, (source_size + block - 1) // block AS blocks, quota // source_size AS rounds, quota % source_size AS rest FROM cut
        ), numbered AS (
            SELECT *, (rounds * blocks + (rest + block - 1) // block)::BIGINT AS n FROM counted
        ), plan AS (
            SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(n) OVER ())::DOUBLE AS lo,
                   (sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / (sum(n) OVER ())::DOUBLE AS hi
            FROM numbered
        ), points AS (
            SELECT i AS slot, ((i >> 20)::DOUBLE * GOLDEN_20::DOUBLE + (i & 1048575)::DOUBLE * GOLDEN::DOUBLE) % 1 AS u
            FROM range((SELECT coalesce(sum(n), 0)::BIGINT FROM plan)) AS r(i)
        ), drawn AS (
            SELECT slot, plan.k, n, row_number() OVER (PARTITION BY plan.k ORDER BY slot) - 1 AS nth
            FROM points JOIN plan ON u >= lo AND u < hi
        ), reached AS (
            SELECT plan.k, plan.n, count(nth) AS had FROM plan LEFT JOIN drawn ON plan.k = drawn.k AND nth < plan.n GROUP BY plan.k, plan.n
        ), missed AS (
            SELECT k, had, unnest(range(had, n)) AS nth FROM reached WHERE had < n
        ), filled AS (
            SELECT slot, k, nth FROM drawn WHERE nth < n
            UNION ALL
            SELECT (SELECT count(*) FROM points) + row_number() OVER (ORDER BY nth - had, k) - 1, k, nth FROM missed
        ), placed AS (
            SELECT s.doc_id, s.size, t.source_size, t.target, t.k,
                   coalesce(sum(s.size) OVER (PARTITION BY t.k ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id NULLS FIRST,
                       s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
            FROM sizes s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source
        ), amounts AS (
            SELECT placed.*, block,
                   (coalesce(rounds, 0) * size + greatest(0, least(size, coalesce(rest, 0) - first_word)))::BIGINT AS taken
            FROM placed LEFT JOIN plan ON placed.k = plan.k
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target, taken, filled.slot::BIGINT AS first_slot
        FROM amounts LEFT JOIN filled ON amounts.k = filled.k AND filled.nth = first_word // block AND taken > 0
    """.replace("GOLDEN_20", repr(mixing.PHI_20)).replace("GOLDEN", repr(mixing.PHI)),
}
