"""The jobs as registered queries, each run twice into a folder of its own, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio import queries as q
from folio.functions import replies
from folio.operators import wire
from folio.sources import files
from jobs import _common, inbox, worklist


def job1_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all documents, planned twice."""
    out = files.new_folder(spark, "jobs/worklist")
    for _ in range(2):
        worklist.run(spark, f"{sf_dir}/documents.parquet", out, _common.config("worklist"))
    return worklist.result(spark, out)


def job2_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all pages; the second run finds nothing new."""
    out = files.new_folder(spark, "jobs/inbox")
    for _ in range(2):  # a pattern, as file streams take a single file by that alone
        inbox.run(spark, f"{sf_dir}/pages.parquet*", f"{out}/paragraphs", f"{out}/checkpoint", _common.config("inbox"))
    return inbox.result(spark, f"{out}/paragraphs")


_LANGUAGE = f"[{q.CJK}]|[A-Za-z]{{4,}}"
_HEAD, _MID, _TAIL = replies.INSTRUCTION.split("{}")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_worklist, job2_inbox)}
ORACLE_SQL = {
    "job1_worklist": f"""
WITH RECURSIVE lines AS (SELECT doc_id, lang, i AS ord, ls[i] AS x FROM (SELECT doc_id, lang, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))),
told AS (SELECT * FROM (SELECT doc_id, lang, ord, {q.q_trim(q.EXTRACTED)} AS t FROM lines)
         WHERE regexp_matches(t, '{_LANGUAGE}') AND NOT regexp_matches(t, '(?i)^arXiv:.*[0-9]{{4}}\\.[0-9]+')),
l AS (SELECT DISTINCT t AS doc_id, t AS text FROM told WHERE length(t) > 2800),{q.LONG},
pieces AS (SELECT doc_id AS t, piece FROM r WHERE piece IS NOT NULL UNION ALL SELECT DISTINCT t, t FROM told WHERE length(t) <= 2800),
u AS (SELECT lang, piece AS text, count(*) AS uses, min(doc_id) AS doc_id, arg_min(ord, (told.doc_id, ord)) AS ord FROM told JOIN pieces ON told.t = pieces.t GROUP BY lang, piece),
v AS (SELECT *, sha256(text) AS text_id FROM u)
SELECT text_id, text, length(text) AS n_chars, uses, doc_id, ord, 'https://model.example/v1/chat/completions' AS url,
       '{{"model":"{wire.CHAT_MODEL}","temperature":0.2,"messages":[{{"role":"user","content":' || to_json('{replies.SYSTEM}' || chr(10) || chr(10) || '{_HEAD}' || lang || '{_MID}{replies.TARGET}{_TAIL}'
         || to_json([{{'id': text_id, 'text': text}}])::VARCHAR)::VARCHAR || '}}]}}' AS body, NULL::VARCHAR AS error, lang
FROM v
""",
    "job2_inbox": f"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host, {q.q_split(q.q_html("html"))} AS ps FROM pages),
u AS (SELECT DISTINCT page_id, host, i AS ord, ps[i] AS text FROM (SELECT page_id, host, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
n AS (SELECT *, row_number() OVER (PARTITION BY host, text ORDER BY page_id NULLS FIRST, ord) = 1 AS is_new FROM u WHERE regexp_matches(text, '{_LANGUAGE}'))
SELECT page_id, ord, host, sha256(text) AS text_id, length(text) AS n_chars, is_new, CASE WHEN is_new THEN text END AS text, 0::BIGINT AS batch FROM n
""",
}
