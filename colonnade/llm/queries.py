"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import (
    chat, decontaminate, filter_audit, hnsw, langid, linededup, mixing, pii, secrets, simhash, spelling, toxicity, warc,
)
from colonnade.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_simhash_balls")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query("op9_language_spans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


@query("op8_secret_ownership")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"), owner_col="source", repo_col="doc_id")


@query("op10_toxicity_lattice")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_decontaminate_cgk")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_temperature_mix")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Halfway between the sources' own shares and equal weights: the search decides whether sources are nearly equal or not.
    return mixing.mix(table(spark, sf_dir, "documents"), flatness=0.5, columns=["doc_id", "source"])


@query("op4_line_runs")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), min_words=50)


@query("op7_embedding_hnsw")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query(
    "op1_warc_merge",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_report(table(spark, sf_dir, "pages"), min_dedup=100)


@query("op2_pii_skip_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"), drop_every=199)


@query(
    "op12_chat_tokens",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), c AS (
        SELECT *, len(regexp_extract_all(text, '<\\*/?s>|\[\\*(?:/?(?:INST|SYS|ROLE)|END)\]')) AS escapes,
               len(regexp_extract_all(role, '<\\*/?s>|\[\\*(?:/?(?:INST|SYS|ROLE)|END)\]')) AS role_escapes
        FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(text) + escapes + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 13 WHEN 'system' THEN 11
               ELSE 18 + length(role) + role_escapes END)::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = chat.chat_report(table(spark, sf_dir, "conversations"))
    return report.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query(
    "op13_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
    ), f AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
                coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
        FROM d LEFT JOIN l USING (doc_id)
    ), n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
    ), a AS (SELECT unnest(range(1, 6)) AS i
    ), o AS (
        SELECT [p.i, q.i, r.i, s.i, t.i] AS axes
        FROM a p JOIN a q ON p.i <> q.i JOIN a r ON r.i NOT IN (p.i, q.i) JOIN a s ON s.i NOT IN (p.i, q.i, r.i)
        JOIN a t ON t.i NOT IN (p.i, q.i, r.i, s.i)
    ), x AS (
        SELECT part, array_to_string(list_transform(axes, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step,
               substr('ABCDE', axes[step], 1) AS filter, n, good, toxic,
               fails[axes[step]] AS own, len(list_filter(axes[:step - 1], lambda k: fails[k])) = 0 AS before,
               len(list_filter(fails, lambda v: v)) = 1 AS single
        FROM n, o, (SELECT unnest(range(1, 6))::INT AS step)
    ), g AS (
        SELECT part, filter_order, step, filter,
               sum(CASE WHEN before AND NOT own THEN n ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN before AND own THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN own AND NOT before THEN n ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN own AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN before AND own THEN good ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN before AND own THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM x GROUP BY ALL
    )
    SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM g
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
