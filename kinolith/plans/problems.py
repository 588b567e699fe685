"""Queries of the general problems: dangling references, continuous periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.operators import orphans, periods
from kinolith.sources.tables import table


def p1_found(spark, sf):
    return orphans.resolve_all(spark, sf).where("is_orphan").select("ref_field", "record_id")


def p1_orphans_by_month(spark, sf):
    return orphans.orphan_counts(orphans.resolve_all(spark, sf))


def p2_found(spark, sf):
    return periods.scene_table(spark, sf)


def p2_rejected(spark, sf):
    return periods.rejected_events(table(spark, sf, "scene_grammar", "scene_id", "who", "s", "e"))


def p2_actor_summary(spark, sf):
    """Covered and uncovered tenths per actor over all scenes."""
    found = periods.scene_table(spark, sf).withColumn("span", F.col("to_tenth") - F.col("from_tenth"))
    return found.groupBy("who").agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"),
        F.sum(F.when(F.col("kind") == "period", F.col("span")).otherwise(0)).cast("bigint").alias("covered"),
        F.count_if(F.col("kind") == "gap").alias("n_gaps"),
        F.sum(F.when(F.col("kind") == "gap", F.col("span")).otherwise(0)).cast("bigint").alias("uncovered"),
    )


_WORDS = "'', '-', '--', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'nothing', 'undefined', 'missing', 'void'"
_EDGE = r"'^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$'"


def _key(c: str, folders: bool = False) -> str:
    text = f"lower(regexp_replace({c}, {_EDGE}, '', 'g'))"
    if folders:
        text = rf"regexp_replace({text}, '^.*[/\\]', '')"
    return f"CASE WHEN {text} IN ({_WORDS}) THEN NULL ELSE nullif(replace({text}, '-', ''), '') END"


def _micros(c: str) -> str:
    return (
        f"CASE WHEN isnan({c}) OR abs({c}) >= 9e18 THEN NULL WHEN abs({c}) >= 1e17 THEN round({c} / 1e3)"
        f" WHEN abs({c}) >= 1e14 THEN round({c}) WHEN abs({c}) >= 1e11 THEN round({c} * 1e3) ELSE round({c} * 1e6) END"
    )


def _resolved(ref: orphans.Reference) -> str:
    removed = f"{ref.parent_removed} IS NOT NULL" if ref.parent_removed else "false"
    return f"""SELECT '{ref.field}' AS ref_field, c.id AS record_id, c.k, f.t,
 CASE WHEN p.k IS NULL THEN 'missing' WHEN p.removed THEN 'removed' WHEN p.t > f.t THEN 'younger' END AS reason
 FROM (SELECT DISTINCT {ref.child_id} AS id, {_key(ref.column, ref.folders)} AS k FROM {ref.child}) c
 JOIN (SELECT {ref.child_id} AS id, min({_micros(ref.child_time)}) AS t FROM {ref.child} GROUP BY 1) f ON f.id = c.id
 LEFT JOIN (SELECT {_key(ref.parent_key, ref.folders)} AS k, min({_micros(ref.parent_time)}) AS t,
   bool_or({removed}) AS removed FROM {ref.parent} GROUP BY 1) p ON p.k = c.k WHERE c.k IS NOT NULL"""


_ALL = " UNION ALL ".join(_resolved(r) for r in orphans.REFERENCES)

_PERIODS = f"""WITH v AS (SELECT DISTINCT scene_id, lower(regexp_replace(who, {_EDGE}, '', 'g')) AS who,
  CAST(floor(s * 10 + 0.5) AS BIGINT) AS a, CAST(floor(e * 10 + 0.5) AS BIGINT) AS b FROM scene_grammar
  WHERE scene_id IS NOT NULL AND regexp_replace(who, {_EDGE}, '', 'g') <> '' AND isfinite(s) AND isfinite(e) AND e > s AND abs(s) < 214748364 AND abs(e) < 214748364),
 w AS (SELECT *, max(b) OVER (PARTITION BY scene_id, who ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
  FROM v WHERE a < b),
 x AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id, who ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM w),
 p AS (SELECT scene_id, who, min(a) AS f, max(b) AS t FROM x GROUP BY scene_id, who, g),
 q AS (SELECT *, lead(f) OVER (PARTITION BY scene_id, who ORDER BY f) AS n FROM p),
 found AS (SELECT 'period' AS kind, scene_id, who, CAST(f AS INTEGER) AS from_tenth, CAST(t AS INTEGER) AS to_tenth FROM p
  UNION ALL SELECT 'gap', scene_id, who, CAST(t AS INTEGER), CAST(n AS INTEGER) FROM q WHERE n IS NOT NULL)
 """

QUERIES = {
    "p1_found": p1_found,
    "p1_orphans_by_month": p1_orphans_by_month,
    "p2_found": p2_found,
    "p2_actor_summary": p2_actor_summary,
    "p2_rejected": p2_rejected,
}

ORACLE = {
    "p1_found": f"SELECT ref_field, record_id FROM ({_ALL}) WHERE reason IS NOT NULL",
    "p1_orphans_by_month": f"""SELECT ref_field, strftime(make_timestamp(CAST(t AS BIGINT)), '%Y-%m') AS month,
 count(*) AS n_refs, count(reason) AS n_orphans, count(*) FILTER (reason = 'missing') AS n_missing,
 count(*) FILTER (reason = 'removed') AS n_removed, count(*) FILTER (reason = 'younger') AS n_younger
 FROM ({_ALL}) GROUP BY 1, 2""",
    "p2_found": _PERIODS + "SELECT * FROM found",
    "p2_rejected": f"""SELECT scene_id, lower(regexp_replace(who, {_EDGE}, '', 'g')) AS who, count(*) AS n_events FROM scene_grammar
 WHERE scene_id IS NOT NULL AND regexp_replace(who, {_EDGE}, '', 'g') <> '' AND isfinite(s) AND isfinite(e) AND e > s AND (abs(s) >= 214748364 OR abs(e) >= 214748364) GROUP BY 1, 2""",
    "p2_actor_summary": _PERIODS
    + """SELECT who, count(*) FILTER (kind = 'period') AS n_periods,
 CAST(coalesce(sum(to_tenth - from_tenth) FILTER (kind = 'period'), 0) AS BIGINT) AS covered,
 count(*) FILTER (kind = 'gap') AS n_gaps,
 CAST(coalesce(sum(to_tenth - from_tenth) FILTER (kind = 'gap'), 0) AS BIGINT) AS uncovered FROM found GROUP BY who""",
}
