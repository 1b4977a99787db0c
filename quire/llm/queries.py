"""Queries of the training-data operators over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, filter_audit, html_extract, lexical, lm_score, packing, pieces, quality, simhash, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assignments(_table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.indexed(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


QUERIES = (op1_quality, op2_toxicity, op3_packing, op4_lm_score, op5_token_counts, op6_html_extract, op7_suffix_dedup, op8_simhash, op9_exact_dedup, op10_decontam, op11_filter_audit, op12_lexical_search, op13_pieces)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": """
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
        """,
        "op11_filter_audit": r"""
            WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
            w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
            f AS (SELECT doc_id, part,
                len(words) < 100 AS a,
                100 * len(list_distinct(words)) < 80 * len(words) AS b,
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
                regexp_matches(t, '[#$%&*|]') AS d,
                doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w),
            l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
            m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
                FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
            x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
            p AS (SELECT p1.letter || p2.letter || p3.letter || p4.letter || p5.letter AS filter_order, [p1.bit, p2.bit, p3.bit, p4.bit, p5.bit] AS bits
                FROM x p1, x p2, x p3, x p4, x p5 WHERE p1.bit | p2.bit | p3.bit | p4.bit | p5.bit = 31),
            s AS (SELECT filter_order, k::INT AS step, bits[k] AS bit, list_sum(bits[1:k - 1])::INT AS gone FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM p)),
            r AS (SELECT part, filter_order, step, bit,
                sum(CASE WHEN mask & (coalesce(gone, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(gone, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(gone, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(gone, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(gone, 0) = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
                FROM m, s GROUP BY ALL)
            SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
        """,
        "op12_lexical_search": r"""
            WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            term AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
            tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
            len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
            total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM len),
            df AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nn),
            place AS (SELECT doc_id, 100 - 50 + ((50 * n * nn) // l) AS m FROM len, total),
            asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
                FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN place USING (doc_id) GROUP BY ALL),
            ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
            SELECT * FROM ranked WHERE rank <= 50
        """,
    }
