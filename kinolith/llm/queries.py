"""Queries of the language-model problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.llm import bpe, conversations, overlap, packing, privacy, truncation
from kinolith.sources.tables import table


def _verdicts(spark, sf):
    found = conversations.rebuild(spark, f"{sf}/messages.parquet")
    return conversations.verdicts(found, table(spark, sf, "messages", "chat_id"), table(spark, sf, "chats", "id"))


def p3_found(spark, sf):
    return _verdicts(spark, sf).where("flaw IS NOT NULL").select("chat_id")


def p3_flaws(spark, sf):
    return _verdicts(spark, sf).groupBy("flaw").agg(F.count("*").alias("n_chats"), F.sum("n_turns").alias("n_turns"))


def p3_conversations(spark, sf):
    return conversations.conversations(conversations.rebuild(spark, f"{sf}/messages.parquet", contents=True))


def _outputs(spark, sf):
    """Model outputs of both tables with their source."""
    parts = [
        table(spark, sf, name, "row_id", source, "raw").select(
            F.lit(name).alias("src_table"), "row_id", F.col(source).alias("source"), "raw"
        )
        for name, source in (("out_of_distribution", "label"), ("clause_probe3", "ckpt"))
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark, sf):
    return truncation.truncated(_outputs(spark, sf)).select("src_table", "row_id")


def p4_rates(spark, sf):
    return truncation.truncation_rates(_outputs(spark, sf))


def _suites(spark, sf):
    return overlap.suites(*((t, table(spark, sf, t, "item_id", "prompt")) for t in ("ood_prompts", "ood_spatial")))


def _overlaps(spark, sf):
    return overlap.overlaps(_suites(spark, sf), table(spark, sf, "scene_train", "pair_id", "origin", "prompt"))


def p5_found(spark, sf):
    return _overlaps(spark, sf).select("eval_table", "item_id", "pair_id")


def p5_overlap_report(spark, sf):
    return overlap.overlap_report(_overlaps(spark, sf), _suites(spark, sf))


def p6_ids(spark, sf):
    return bpe.token_ids(table(spark, sf, "documents", "doc_id", "text"))


def p6_token_report(spark, sf):
    return bpe.token_report(table(spark, sf, "documents", "source", "text"))


def p7_containers(spark, sf):
    documents = table(spark, sf, "documents")
    row = F.struct("_metadata.file_path", "_metadata.row_index").alias("row")
    return packing.pack(documents.select("doc_id", "text", row), table(spark, sf, "pack_sizes"))


def p7_fill(spark, sf):
    return packing.fill_report(p7_containers(spark, sf))


def _mentions(spark, sf, **how):
    documents = table(spark, sf, "documents", "doc_id", "source", "text")
    return privacy.find(documents, table(spark, sf, "name_list", "word", "name_kind"), **how)


def p8_found(spark, sf):
    return privacy.mention_rows(_mentions(spark, sf))


def p8_masked(spark, sf):
    return _mentions(spark, sf, masked=True).select("doc_id", "text")


def p8_mention_report(spark, sf):
    return privacy.mention_report(_mentions(spark, sf, keep=("source",)))


QUERIES = {
    "p3_found": p3_found,
    "p3_flaws": p3_flaws,
    "p3_conversations": p3_conversations,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_overlap_report": p5_overlap_report,
    "p6_ids": p6_ids,
    "p6_token_report": p6_token_report,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_masked": p8_masked,
    "p8_mention_report": p8_mention_report,
}

#: Twin of p4: the structural rule alone, over all outputs, without trigrams.
_TRUNCATED = r"""WITH o AS (SELECT 'out_of_distribution' AS src_table, row_id, label AS source, raw FROM out_of_distribution
  UNION ALL SELECT 'clause_probe3', row_id, ckpt, raw FROM clause_probe3),
 c AS (SELECT DISTINCT src_table, row_id, string_split_regex(trim(regexp_replace(regexp_replace(lower(raw),
   '(\s|\.\.+|…|�|\[[^\]|;]*\]|<[^>|;]*>)+$', ''), '([|;])', ' \1 ', 'g')), '\s+') AS w
  FROM o WHERE regexp_replace(raw, '\s', '', 'g') <> ''),
 v AS (SELECT x, count(*) AS n FROM (SELECT unnest(w[:-2]) AS x FROM c) WHERE regexp_full_match(x, '[a-z]+') GROUP BY x),
 e AS (SELECT *, list_contains(w, 'tl') AS tl,
   coalesce(list_position(list_reverse(list_transform(w, lambda x: x IN (';', '|', 'tl'))), true) - 1, len(w)) AS n_last FROM c),
 k AS (SELECT e.src_table, e.row_id FROM e LEFT JOIN v own ON own.x = e.w[-1]
  WHERE NOT tl OR n_last < 4 OR (regexp_full_match(e.w[-1], '[a-z]+')
   AND EXISTS (SELECT 1 FROM v WHERE starts_with(v.x, e.w[-1]) AND v.x <> e.w[-1] AND v.n > 20 * coalesce(own.n, 0) AND v.n > 2)))
"""

#: Twin of p3: one batch of windows, without states, hours or segments.
_EDGES = r"'^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$'"
_CHATS = f"""WITH m AS (SELECT coalesce(id, md5(concat_ws('|', chat_id, role, content, created))) AS id, chat_id, lower(regexp_replace(role, {_EDGES}, '', 'g')) AS r,
   regexp_replace(content, {_EDGES}, '', 'g') AS content, CASE WHEN isnan(created) OR abs(created) >= 9e18 THEN NULL WHEN abs(created) >= 1e17 THEN round(created / 1e3)
   WHEN abs(created) >= 1e14 THEN round(created) WHEN abs(created) >= 1e11 THEN round(created * 1e3) ELSE round(created * 1e6) END AS t FROM messages),
 n AS (SELECT * EXCLUDE (r), CASE WHEN r IN ('user', 'usr', 'human') THEN 'user' WHEN r IN ('assistant', 'asst', 'bot', 'ai', 'model') THEN 'assistant' WHEN r IN ('system', 'sys') THEN 'system' END AS speaker FROM m),
 d AS (SELECT * FROM n WHERE chat_id IS NOT NULL AND content <> '' AND coalesce(speaker, '') <> 'system' QUALIFY row_number() OVER (PARTITION BY id ORDER BY t NULLS LAST) = 1),
 k AS (SELECT *, t - lag(t) OVER (PARTITION BY chat_id, speaker, content ORDER BY t) AS since FROM d WHERE t IS NOT NULL UNION ALL SELECT *, NULL FROM d WHERE t IS NULL),
 w AS (SELECT *, row_number() OVER o AS turn_no, lag(speaker) OVER o AS before, count(*) OVER (PARTITION BY chat_id) AS n_turns FROM k WHERE since IS NULL OR since > 2000000
   WINDOW o AS (PARTITION BY chat_id ORDER BY t NULLS LAST, coalesce(speaker, '') <> 'user', coalesce(speaker, ''), content, id)),
 j AS (SELECT chat_id, count(*) AS n_turns, CASE WHEN bool_or(t IS NULL) THEN 'no time' WHEN bool_or(speaker IS NULL) THEN 'no role' WHEN bool_or(speaker = before) THEN 'no alternation'
   WHEN max(speaker) FILTER (turn_no = 1) <> 'user' THEN 'no request first' WHEN max(speaker) FILTER (turn_no = n_turns) <> 'assistant' THEN 'no reply last' END AS flaw FROM w GROUP BY 1),
 c AS (SELECT chat_id, coalesce(n_turns, 0) AS n_turns, CASE WHEN n_turns IS NULL THEN 'empty' ELSE flaw END AS flaw
   FROM (SELECT chat_id FROM messages WHERE chat_id IS NOT NULL UNION SELECT id FROM chats WHERE id IS NOT NULL) LEFT JOIN j USING (chat_id))
"""

#: The merges, sweeps and similarities have no SQL twin; the tests compare with the public
#: tokenizer and with brute force.
ORACLE: dict = {
    "p3_found": _CHATS + "SELECT chat_id FROM c WHERE flaw IS NOT NULL",
    "p3_flaws": _CHATS + "SELECT flaw, count(*) AS n_chats, CAST(sum(n_turns) AS BIGINT) AS n_turns FROM c GROUP BY 1",
    "p3_conversations": _CHATS + "SELECT chat_id, turn_no, speaker, CAST(t AS BIGINT) AS at_micros, content FROM w WHERE chat_id IN (SELECT chat_id FROM c WHERE flaw IS NULL)",
    "p4_found": _TRUNCATED + "SELECT DISTINCT src_table, row_id FROM k",
    "p4_rates": _TRUNCATED
    + """SELECT src_table, source, count(*) AS n_outputs, count(k.row_id) AS n_truncated,
 round(count(k.row_id) / count(*), 6) AS share FROM (SELECT DISTINCT src_table, row_id, source FROM o)
 LEFT JOIN (SELECT DISTINCT * FROM k) k USING (src_table, row_id) GROUP BY ALL""",
}
