"""Model outputs that stop before their end, found by word trigrams in pure SQL.

Numbers count as one word. A trigram that often stands inside outputs but almost never at their
end is no place to stop; neither is one that nobody has seen but that a longer last word would
make a known one. Outputs that end so are suspects; an exact check then acquits those whose last
timeline entry is whole (four words, the last of them no piece of a known word).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinolith.session import through_table

#: A trigram is known from this many places inside outputs on.
LEAST_INSIDE = 3
#: It is a possible end if at least this share of its places are ends.
END_SHARE = 0.05
#: An end is proven if at least this share of all outputs stops there; others are checked exactly.
PROOF = 0.001
#: A last word is a piece if longer words with this beginning are so many times as frequent inside.
PIECE_RATIO = 20
#: Shards of the outputs in the joins, so that an ending shared by a third of them is split.
SALT = 16

#: Marks that stand where a text was cut, looked for in its last characters.
MARK_CHARS = 80
MARK = r"(\\s|\\.\\.+|…|�|\\[[^\\]|;]*\\]|<[^>|;]*>)+$"

#: Words of each output behind two start marks; numbers as '#', separators as words.
_WORDED = """
WITH kept AS (
  SELECT src_table, row_id, lower(concat(left(raw, length(raw) - {tail}), regexp_replace(right(raw, {tail}), '{mark}', ''))) AS t
  FROM {{outputs}} WHERE raw RLIKE '[^\\\\s\\\\p{{{{Z}}}}\\\\p{{{{C}}}}]'
), spaced AS (
  SELECT src_table, row_id, replace(replace(regexp_replace(t, '[0-9]+([.,][0-9]+)?', '#'), '|', ' | '), ';', ' ; ') AS t FROM kept
), split_up AS (
  SELECT src_table, row_id, filter(split(t, '[\\\\s\\\\p{{{{Z}}}}]+'), x -> x <> '') AS w FROM spaced
), worded AS (
  SELECT src_table, row_id, concat(array('^', '^'), CASE WHEN size(w) = 0 THEN array('') ELSE w END) AS w FROM split_up
)""".format(mark=MARK, tail=MARK_CHARS)

#: Trigrams inside outputs and at their ends.
COUNT_SQL = (
    _WORDED
    + """
SELECT g.a, g.b, g.c, count_if(NOT g.at_end) AS n_inside, count_if(g.at_end) AS n_end FROM (
  SELECT explode(transform(sequence(2, size(w) - 1), i -> struct(w[i - 2] AS a, w[i - 1] AS b, w[i] AS c, i = size(w) - 1 AS at_end))) AS g
  FROM worded) GROUP BY g.a, g.b, g.c
"""
)

#: Outputs joined with the verdict on their final trigram, then the exact check.
FOUND_SQL = (
    _WORDED
    + """, ends AS (
  SELECT src_table, row_id, element_at(w, -3) AS a, element_at(w, -2) AS b, element_at(w, -1) AS c,
    array_contains(w, 'tl') AS has_timeline,
    coalesce(least(nullif(array_position(reverse(w), ';'), 0), nullif(array_position(reverse(w), '|'), 0),
      nullif(array_position(reverse(w), 'tl'), 0)) - 1, size(w)) AS n_last,
    CAST(pmod(xxhash64(src_table, row_id), {salt}) AS INT) AS salt
  FROM worded
), open_ends AS (
  SELECT a, b, c FROM {{counted}} WHERE n_end > 0 AND n_inside < {least}
), longer AS (
  SELECT o.a, o.b, o.c, sum(k.n_inside) AS n_longer FROM
    (SELECT a, b, p AS c, n_inside FROM (SELECT a, b, n_inside, explode(transform(sequence(1, length(c) - 1), i -> substring(c, 1, i))) AS p
      FROM {{counted}} WHERE length(c) > 1 AND n_inside > 0)) k
    JOIN open_ends o ON o.a = k.a AND o.b = k.b AND o.c = k.c GROUP BY o.a, o.b, o.c
), judged AS (
  SELECT d.a, d.b, d.c, CASE
      WHEN d.c = '' THEN 'nothing left'
      WHEN d.n_inside >= {least} AND d.n_end < {share} * (d.n_inside + d.n_end) THEN 'inside only'
      WHEN l.n_longer >= {least} AND l.n_longer > {ratio} * d.n_inside THEN 'piece'
      WHEN d.n_end < greatest({least}, {proof} * (SELECT sum(n_end) FROM {{counted}})) THEN 'unproven' END AS verdict
  FROM {{counted}} d LEFT JOIN longer l ON d.a = l.a AND d.b = l.b AND d.c = l.c WHERE d.n_end > 0
), vocabulary AS (
  SELECT c AS word, sum(n_inside) AS n FROM {{counted}} WHERE length(c) > 0 GROUP BY c
), pieces AS (
  SELECT p AS word, sum(n) AS n_longer FROM (
    SELECT n, explode(transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))) AS p FROM vocabulary
    WHERE length(word) > 1 AND n >= {least}) GROUP BY p
), cut_words AS (
  SELECT p.word FROM pieces p LEFT JOIN vocabulary v ON p.word = v.word
  WHERE p.n_longer >= {least} AND p.n_longer > {ratio} * coalesce(v.n, 0)
), judged_salted AS (
  SELECT j.a, j.b, j.c, j.verdict, k.word IS NOT NULL AS cut_word, explode(sequence(0, {salt} - 1)) AS salt
  FROM judged j LEFT JOIN cut_words k ON j.c = k.word WHERE j.verdict IS NOT NULL
)
SELECT e.src_table, e.row_id, min(j.verdict) AS verdict
FROM ends e JOIN judged_salted j ON e.a = j.a AND e.b = j.b AND e.c = j.c AND e.salt = j.salt
WHERE NOT e.has_timeline OR e.n_last < 4 OR j.cut_word
GROUP BY e.src_table, e.row_id
""".format(least=LEAST_INSIDE, share=END_SHARE, proof=PROOF, ratio=PIECE_RATIO, salt=SALT)
)


def truncated(outputs: DataFrame) -> DataFrame:
    """Outputs (src_table, row_id, raw) that stop before their end, with the trigram's verdict.

    Columns: src_table, row_id, verdict ('inside only', 'piece', 'unproven' or 'nothing left').
    Null and blank outputs are none; one that holds only marks of a cut is one. Repeated rows
    count once. An empty table gives no rows; other columns are ignored. The trigram counts are
    written to the shared folder, as six later steps read them.
    """
    spark, rows = outputs.sparkSession, outputs.select("src_table", "row_id", "raw")
    counted = through_table(spark.sql(COUNT_SQL, outputs=rows), "trigrams")
    return spark.sql(FOUND_SQL, outputs=rows, counted=counted)


def truncation_rates(outputs: DataFrame) -> DataFrame:
    """Outputs, broken-off outputs and their share per table and source (null source kept).

    ``outputs`` has src_table, row_id, source, raw; rows repeated under one id count once.
    """
    cut = truncated(outputs).select("src_table", "row_id", "verdict")
    return outputs.sparkSession.sql(
        """SELECT src_table, source, count(*) AS n_outputs, count(verdict) AS n_truncated,
             round(count(verdict) / count(*), 6) AS share
           FROM (SELECT DISTINCT src_table, row_id, source FROM {outputs}) LEFT JOIN {cut} USING (src_table, row_id)
           GROUP BY src_table, source""",
        outputs=outputs,
        cut=cut,
    )
