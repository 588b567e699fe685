"""Queries of the scene language over model outputs and training scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.functions.text import clean
from kinolith.operators import scenes as S
from kinolith.sources.tables import table


def _outputs(spark, sf):
    return S.parse(table(spark, sf, "out_of_distribution", "row_id", "raw").distinct(), "raw")


def _training(spark, sf, *columns):
    return S.parse(table(spark, sf, "scene_train", "pair_id", "dsl", *columns), "dsl")


def dsl_parse(spark, sf):
    """Parse of every output: its first fault, or how much it holds."""
    return _outputs(spark, sf).select("row_id", F.md5("raw").alias("raw_md5"), "parse_error", "bg", "dur", F.size("cast").alias("n_cast"), F.size("props").alias("n_props"), F.size("timeline").alias("n_events"))


def dsl_roundtrip(spark, sf):
    """Text form of every parsed training scene; an empty section leaves one blank only."""
    return _training(spark, sf).where("parse_error IS NULL").select("pair_id", F.md5(clean(S.text_of())).alias("text_md5"))


def dsl_problems(spark, sf):
    """Problems of every parsed output, in rule order."""
    return _outputs(spark, sf).where("parse_error IS NULL").select("row_id", F.md5("raw").alias("raw_md5"), F.array_join(S.problems(), "|").alias("problems"))


def dsl_repair(spark, sf):
    """Repaired outputs: what was changed, and what is still wrong (overlapping kicks, late ends)."""
    fixed = S.repair(_outputs(spark, sf).where("parse_error IS NULL"))
    return fixed.select("row_id", F.md5("raw").alias("raw_md5"), F.array_join("changes", "|").alias("changes"), F.array_join(F.array_distinct(S.problems()), "|").alias("left_over"))


def stated_field_match(spark, sf):
    """Training scenes against what their intent states."""
    df = _training(spark, sf, "intent").where("parse_error IS NULL AND intent IS NOT NULL")
    df = df.withColumn("intent", F.col("intent").withField("acts_any", F.array().cast("array<string>")))
    return df.select("pair_id", *[c.alias(n) for n, c in S.stated_match("intent").items() if n != "actions_present"])


def scene_layout(spark, sf):
    return _training(spark, sf).where("parse_error IS NULL").select("pair_id", *[c.alias(n) for n, c in S.layout().items()])


def staging_metrics(spark, sf):
    return _training(spark, sf).where("parse_error IS NULL").select("pair_id", *[c.alias(n) for n, c in S.staging().items()])


QUERIES = {f.__name__: f for f in (dsl_parse, dsl_roundtrip, dsl_problems, dsl_repair, stated_field_match, scene_layout, staging_metrics)}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda w: w <> '')".replace("\\x85", "\\x{85}")


def _words(x: str) -> str:
    return _WORDS.replace("{}", x, 1)


def _parsed(source: str, raw: str, keys: str) -> str:
    """Sections and entries of the texts, without any check."""
    return f"""WITH src AS (SELECT DISTINCT {keys}, {raw} AS raw FROM {source}),
 p AS (SELECT *, list_transform(string_split(coalesce(raw, ''), '|'), lambda x: trim(x, ' ')) AS parts FROM src),
 s AS (SELECT *, {_words('parts[1]')} AS h, list_transform(list_filter(parts[2:], lambda x: len({_words('x')}) > 0), lambda x: {{'kind': {_words('x')}[1],
   'items': list_filter(list_transform(string_split(regexp_replace(trim(x, ' '), '^\\S+\\s*', ''), ';'), lambda i: {_words('i')}), lambda i: len(i) > 0)}}) AS sec FROM p),
 e AS (SELECT *, flatten(list_transform(list_filter(sec, lambda x: x.kind = 'cast'), lambda x: x.items)) AS c, flatten(list_transform(list_filter(sec, lambda x: x.kind = 'prop'), lambda x: x.items)) AS o,
   flatten(list_transform(list_filter(sec, lambda x: x.kind = 'tl'), lambda x: x.items)) AS t FROM s)"""


_NUM = r"regexp_full_match({}, '[+-]?(\d+\.?\d*|\.\d+)')"


def _bad(x: str) -> str:
    return f"CASE WHEN NOT {_NUM.format(x)} THEN 'not a number: ''' || {x} || '''' END"


def _quote(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda w: '''' || w || ''''), ', ') || ']'"


_FAULT = f"""CASE WHEN x.kind = 'cast' THEN CASE WHEN len(i) <> 4 THEN 'bad cast entry ' || {_quote('i')} ELSE coalesce({_bad('i[3]')}, {_bad('i[4]')}) END
 WHEN x.kind = 'prop' THEN CASE WHEN len(i) <> 3 THEN 'bad prop entry ' || {_quote('i')} ELSE coalesce({_bad('i[2]')}, {_bad('i[3]')}) END
 ELSE CASE WHEN len(i) < 4 THEN 'bad event ' || {_quote('i')} ELSE coalesce({_bad('i[1]')}, {_bad('i[2]')}, CASE WHEN i[4] IN ('walk', 'run') AND len(i) > 4 THEN {_bad('i[5]')} END) END END"""
_ERROR = f"""coalesce(CASE WHEN len({_words("coalesce(raw, '')")}) = 0 THEN 'empty output' END, CASE WHEN len(parts) < 2 THEN 'fewer than 2 sections' END,
 CASE WHEN NOT (len(h) >= 4 AND h[1] = 'bg' AND h[3] = 'dur') THEN 'bad header ''' || parts[1] || '''' END, {_bad('h[4]')},
 list_filter(flatten(list_transform(sec, lambda x: CASE WHEN x.kind NOT IN ('cast', 'prop', 'tl') THEN ['unknown section ''' || x.kind || ''''] ELSE list_transform(x.items, lambda i: {_FAULT}) END)), lambda f: f IS NOT NULL)[1],
 CASE WHEN len(c) = 0 THEN 'empty cast' END)"""
_OUT = _parsed("out_of_distribution", "raw", "row_id") + f", r AS (SELECT *, {_ERROR} AS err FROM e)"
_TRAIN = _parsed("scene_train", "dsl", "pair_id") + f", r AS (SELECT *, {_ERROR} AS err FROM e)"


def _rep(n: str, name: str) -> str:
    return f"list_transform(range({n}), lambda z: '{name}')"


def _in(x: str, values: tuple) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


_PROBLEMS = f"""list_concat(
 CASE WHEN NOT {_in('h[2]', S.BACKGROUNDS)} THEN ['background'] ELSE [] END, CASE WHEN CAST(h[4] AS DOUBLE) NOT BETWEEN 20 AND 400 THEN ['duration'] ELSE [] END,
 CASE WHEN list_unique(list_transform(c, lambda m: m[1])) <> len(c) THEN ['duplicate cast id'] ELSE [] END, CASE WHEN len(c) NOT BETWEEN 1 AND 8 THEN ['cast size'] ELSE [] END,
 list_transform(list_filter(c, lambda m: NOT {_in('m[2]', S.COLOURS)}), lambda m: 'colour'), list_transform(list_filter(c, lambda m: CAST(m[3] AS DOUBLE) NOT BETWEEN 4 AND 96), lambda m: 'off frame'),
 list_transform(list_filter(c, lambda m: CAST(m[4] AS DOUBLE) NOT BETWEEN 40 AND 120), lambda m: 'scale'), CASE WHEN list_unique(list_transform(c, lambda m: m[2])) <> len(c) THEN ['two characters share a colour'] ELSE [] END,
 list_transform(list_filter(o, lambda m: NOT {_in('m[1]', S.PROPS)}), lambda m: 'prop'), list_transform(list_filter(o, lambda m: CAST(m[2] AS DOUBLE) NOT BETWEEN 0 AND 100), lambda m: 'prop off frame'),
 list_transform(list_filter(t, lambda v: NOT list_contains(list_transform(c, lambda m: m[1]), v[3])), lambda v: 'unknown actor'), list_transform(list_filter(t, lambda v: NOT {_in('v[4]', S.ACTIONS)}), lambda v: 'unknown action'),
 list_transform(list_filter(t, lambda v: NOT (CAST(v[2] AS DOUBLE) > CAST(v[1] AS DOUBLE) AND CAST(v[1] AS DOUBLE) >= 0)), lambda v: 'bad window'), list_transform(list_filter(t, lambda v: CAST(v[2] AS DOUBLE) > CAST(h[4] AS DOUBLE)), lambda v: 'window past duration'),
 list_transform(list_filter(t, lambda v: v[4] IN ('walk', 'run') AND len(v) > 4 AND TRY_CAST(v[5] AS DOUBLE) NOT BETWEEN 4 AND 96), lambda v: 'target off frame'),
 list_transform(list_filter(t, lambda v: v[4] = 'kick' AND NOT list_contains(list_transform(o, lambda m: m[1]), 'ball')), lambda v: 'kick without ball'),
 list_transform(list_filter(t, lambda v: v[4] = 'kick' AND coalesce(v[6], '') <> '' AND NOT list_contains(list_transform(c, lambda m: m[1]), v[6]) AND NOT {_NUM.format('v[6]')}), lambda v: 'kick target'),
 list_transform(list_filter(c, lambda m: NOT list_contains(list_transform(t, lambda v: v[3]), m[1])), lambda m: 'mannequin'),
 list_transform(list_filter(range(1, len(k)), lambda i: k[i + 1].a < k[i].b), lambda i: 'overlapping kicks'))"""
_KICKS = "(SELECT *, list_sort(list_transform(list_filter(t, lambda v: v[4] = 'kick'), lambda v: {'a': CAST(v[1] AS DOUBLE), 'b': CAST(v[2] AS DOUBLE)})) AS k FROM r WHERE err IS NULL)"

ORACLE = {
    "dsl_parse": _OUT + """ SELECT row_id, md5(raw) AS raw_md5, err AS parse_error, CASE WHEN err IS NULL THEN h[2] END AS bg, CASE WHEN err IS NULL THEN CAST(h[4] AS DOUBLE) END AS dur,
 CASE WHEN err IS NULL THEN len(c) END AS n_cast, CASE WHEN err IS NULL THEN len(o) END AS n_props, CASE WHEN err IS NULL THEN len(t) END AS n_events FROM r""",
    "dsl_roundtrip": _TRAIN + " SELECT pair_id, md5(raw) AS text_md5 FROM r WHERE err IS NULL",
    "dsl_problems": _OUT + f" SELECT row_id, md5(raw) AS raw_md5, array_to_string({_PROBLEMS}, '|') AS problems FROM {_KICKS}",
    "stated_field_match": _parsed("scene_train", "dsl", "pair_id, intent") + f""", r AS (SELECT *, {_ERROR} AS err FROM e)
 SELECT pair_id, len(c) = intent.n_cast AS cast_count, CASE WHEN intent.bg <> '' THEN h[2] = intent.bg END AS background, intent.kick = list_contains(list_transform(t, lambda v: v[4]), 'kick') AS ball_interaction,
 CASE WHEN len(intent.props) > 0 THEN len(list_filter(intent.props, lambda p: NOT list_contains(list_transform(o, lambda m: m[1]), p))) = 0 END AS props_present,
 CASE WHEN len(map_keys(intent.colors)) > 0 THEN len(list_filter(map_entries(intent.colors), lambda q: NOT coalesce(c[CAST(q.key AS INT) + 1][2] = q.value, false))) = 0 END AS colors
 FROM r WHERE err IS NULL AND intent IS NOT NULL""",
    "scene_layout": _TRAIN + """, m AS (SELECT pair_id, list_transform(c, lambda m: CAST(m[3] AS DOUBLE)) AS xs, list_transform(c, lambda m: CAST(m[4] AS DOUBLE)) AS ss FROM r WHERE err IS NULL)
 SELECT pair_id, list_position(xs, list_min(xs)) - 1 AS leftmost, list_position(xs, list_max(xs)) - 1 AS rightmost, list_position(ss, list_min(ss)) - 1 AS back, list_position(ss, list_max(ss)) - 1 AS front, list_max(xs) - list_min(xs) AS span FROM m""",
    "staging_metrics": _TRAIN + """, m AS (SELECT pair_id, list_sort(list_transform(c, lambda m: CAST(m[3] AS DOUBLE))) AS xs FROM r WHERE err IS NULL),
 g AS (SELECT *, list_transform(range(1, len(xs)), lambda i: xs[i + 1] - xs[i]) AS gs FROM m)
 SELECT pair_id, list_min(gs) / 10 AS min_sep, CASE WHEN len(xs) > 1 THEN round((xs[-1] - xs[1]) / 60, 6) END AS span_frac,
 CASE WHEN len(xs) > 1 THEN round(sqrt(list_sum(list_transform(gs, lambda g: (g - (xs[-1] - xs[1]) / (len(xs) - 1)) ** 2)) / (len(xs) - 1)), 6) END AS evenness FROM g""",
}
