"""Queries of the corpus operators over ``documents`` and the tables of prompts, outputs and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.functions import text as T
from kinolith.operators import corpus as C
from kinolith.sources.tables import table

WS = T.WS


def _docs(spark, sf, *columns):
    return table(spark, sf, "documents", *columns)


def clean_text(spark, sf):
    return _docs(spark, sf, "doc_id", "text").select("doc_id", F.md5(T.clean(F.col("text"))).alias("clean_md5"), F.length(T.clean(F.col("text"))).alias("clean_len"))


def min_length_filter(spark, sf):
    return _docs(spark, sf, "doc_id", "text").where(F.length(T.clean(F.col("text"))) >= 15).select("doc_id")


def _rejected(spark, sf):
    df = _docs(spark, sf, "doc_id", "text", "lang", "source", "scene_name")
    n = F.size(T.lines(F.col("text")))
    return C.reject_cascade(
        df,
        ("no text", F.col("text").isNull()),
        ("short", F.length(T.clean(F.col("text"))) < 15),
        ("too many lines", n > 60),
        ("no scene", F.col("scene_name").isNull()),
        ("too long", F.length("text") > 4000),
        ("few lines", n < 2),
    )


def reject_cascade(spark, sf):
    return _rejected(spark, sf).select("doc_id", "reason")


def reason_histogram(spark, sf):
    return C.reason_histogram(_rejected(spark, sf))


def regex_grep(spark, sf):
    return _docs(spark, sf, "doc_id", "text", "lang", "source").where(T.grep("palette|lantern", F.col("text"), F.col("lang"), F.col("source"))).select("doc_id")


_CLASSES = {"kick": "kick", "jump": "jump", "wave": "wave", "danc": "dance", "run": "run"}


def keyword_classify(spark, sf):
    df = table(spark, sf, "scene_train", "pair_id", "prompt")
    return df.select("pair_id", T.classify(F.coalesce("prompt", F.lit("")), _CLASSES, "walk").alias("action"))


def rule_extract(spark, sf):
    """Colour by plain substring, action by whole word, count by number word or digits."""
    p = F.lower(F.coalesce("prompt", F.lit("")))
    df = table(spark, sf, "scene_train", "pair_id", "prompt")
    colours = {c: c for c in ("red", "green", "blue", "amber", "violet", "white")}
    action = F.regexp_extract(p, r"\b(jumps|waves|dances|runs|walks|kneels|spins|claps)\b", 1)
    count = F.regexp_extract(p, r"\b(one|two|three|four|five|six|seven|eight|nine|\d+)\b", 1)
    return df.select("pair_id", T.classify(p, colours, "none").alias("colour"), action.alias("action"), count.alias("count_word"))


def kv_parse_validate(spark, sf):
    """Lenient key=value words of log lines, coerced: unknown states become null, loss out of range drops."""
    df = _docs(spark, sf, "doc_id", "text")
    kv = T.key_values(F.col("text"), ("author", "phone", "state"))
    return df.select("doc_id", kv["author"].alias("author"), F.coalesce(F.when(kv["state"].isin("on", "off"), kv["state"]), F.lit("on")).alias("state")).where("author IS NOT NULL")


def take_while_lines(spark, sf):
    return _docs(spark, sf, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(T.take_while(F.col("text"), "@shp", "@ ")).alias("body_md5"))


def hash_split(spark, sf):
    return _docs(spark, sf, "doc_id").select("doc_id", T.split_of(F.col("doc_id").cast("string"), 0.05).alias("split"))


def split_totals(spark, sf):
    df = _docs(spark, sf, "doc_id", "text").withColumn("split", T.split_of(F.col("doc_id").cast("string"), 0.05))
    return df.groupBy("split").agg(F.count("*").alias("n_docs"), F.sum(F.size(T.tokens(F.col("text")))).alias("n_tokens"), F.round(F.sum(F.size(T.tokens(F.col("text")))) / 3600, 6).alias("hours"))


def body_hash(spark, sf):
    return _docs(spark, sf, "doc_id", "text").where("text IS NOT NULL").select("doc_id", T.body_key(F.col("text"), "step ").alias("body"))


def truncate_tokens(spark, sf):
    return _docs(spark, sf, "doc_id", "text").select("doc_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 12), " ").alias("head"))


def label_mask(spark, sf):
    """Token lengths of a prompt pair, the prompt's positions masked by -100."""
    df = table(spark, sf, "scene_train", "pair_id", "prompt", "dsl")
    both = F.concat(T.tokens(F.col("prompt")), T.tokens(F.col("dsl")))
    k = F.size(T.tokens(F.col("prompt")))
    return df.select("pair_id", F.transform(both, lambda x, i: F.when(i < k, F.lit(-100)).otherwise(F.length(x))).alias("labels"))


def pad_longest(spark, sf):
    """Label lists padded by -100 to the longest of their origin."""
    df = label_mask(spark, sf).join(table(spark, sf, "scene_train", "pair_id", "origin"), "pair_id")
    longest = df.groupBy("origin").agg(F.max(F.size("labels")).alias("longest"))
    padded = df.join(F.broadcast(longest), df["origin"].eqNullSafe(longest["origin"])).drop(longest["origin"])
    full = F.concat("labels", F.array_repeat(F.lit(-100), F.col("longest") - F.size("labels")))
    return padded.select("pair_id", F.size(full).alias("n"), F.aggregate(full, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def token_whitelist(spark, sf):
    """Distinct tokens that are grammar words, in full or without leading punctuation."""
    words = _docs(spark, sf, "text").select(F.explode(T.tokens(F.col("text"))).alias("tok"))
    rule = r"^(-?\d+(\.\d+)?|[a-z]{1,4}|#[0-9a-f]{6})$"
    return words.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("tok").rlike(rule) | F.regexp_replace("tok", r"^[(\[<]+", "").rlike(rule))


def regex_count_extract(spark, sf):
    df = table(spark, sf, "scene_train", "pair_id", "prompt")
    return df.select("pair_id", T.expected_count(F.coalesce("prompt", F.lit(""))).alias("expected"))


def dedup_two_stage(spark, sf):
    df = _docs(spark, sf, "doc_id", "text", "scene_name", "lang")
    return C.dedup_two_keys(df, "doc_id", "scene_name", "text", "text").select("doc_id")


def order_stats(spark, sf):
    df = _docs(spark, sf, "lang", "text").withColumn("n_tok", F.size(T.tokens(F.col("text"))))
    return C.order_statistics(df, ["lang"], "n_tok", {"median": 0.5, "p90": 0.9, "p10": 0.1})


def conditional_rates(spark, sf):
    df = table(spark, sf, "out_of_distribution", "parsed", "is_valid", "render", "dsl_exact", "match_flags").select(
        "parsed", F.col("is_valid").alias("valid"), "render",
        F.when(F.col("parsed"), F.col("match_flags")["cast_count"]).alias("cast_match"),
        F.when(F.col("parsed"), F.col("match_flags")["background"]).alias("bg_match"),
    )
    return C.conditional_rates(df, ["parsed", "valid", "render"], ["cast_match", "bg_match"])


def bool_and_rates(spark, sf):
    """Per source, how many parsed outputs match on all stated fields, and on all but the layout."""
    df = table(spark, sf, "out_of_distribution", "label", "parsed", "match_flags").where("parsed")
    flags = F.coalesce(F.map_values("match_flags"), F.array().cast("array<boolean>"))
    others = F.coalesce(F.map_values(F.map_filter("match_flags", lambda k, v: k != "layout")), F.array().cast("array<boolean>"))
    every = lambda a: F.forall(F.filter(a, lambda v: v.isNotNull()), lambda v: v)
    return df.groupBy("label").agg(F.count("*").alias("n"), F.count_if(every(flags)).alias("n_all"), F.count_if(every(others)).alias("n_all_but_layout"))


def group_rates(spark, sf):
    df = table(spark, sf, "out_of_distribution", "grp", "render", "is_valid")
    return df.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("render").alias("n_render"), F.count_if("is_valid").alias("n_valid"), F.round(F.count_if("is_valid") / F.count("*"), 6).alias("valid_rate"))


def normalised_top_k(spark, sf):
    """Problems without their particulars, the eight most common."""
    p = table(spark, sf, "out_of_distribution", "problems").select(F.explode("problems").alias("p"))
    kind = F.substring_index(F.substring_index("p", "=", 1), " x", 1)
    return C.reason_histogram(p.select(kind.alias("problem")), "problem", 8)


def explode_count(spark, sf):
    kinds = table(spark, sf, "scene_train", "intent").select(F.explode("intent.layout").alias("l")).select("l.kind")
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def pearson_agreement(spark, sf):
    df = table(spark, sf, "scene_train", "n_cast", "n_described", "origin")
    return df.groupBy("origin").agg(F.count("*").alias("n"), C.pearson("n_cast", "n_described").alias("r"), F.count_if(F.col("n_cast") == F.col("n_described")).alias("n_equal"))


def nan_excluding_mean(spark, sf):
    """Staging averages over rows with several actors only; NaN is no value."""
    s = table(spark, sf, "out_of_distribution", "label", "staging").where("staging.n_cast >= 2")
    value = lambda f: F.when(~F.isnan(f"staging.{f}"), F.col(f"staging.{f}"))
    return s.groupBy("label").agg(F.count(value("min_sep")).alias("n_sep"), F.round(F.avg(value("min_sep")), 6).alias("mean_sep"), F.round(F.avg(value("staging")), 6).alias("mean_staging"), F.round(F.avg(value("span_frac")), 6).alias("mean_span"))


def top_k(spark, sf):
    words = _docs(spark, sf, "text").select(F.explode(T.tokens(F.lower("text"))).alias("word"))
    return C.reason_histogram(words, "word", 15)


def budget_limit(spark, sf):
    """The first 40 documents of each source in order of id."""
    return C.top_k_per_group(_docs(spark, sf, "source", "doc_id"), ["source"], [F.col("doc_id")], 40).select("source", "doc_id", "rank")


def hash_shuffle_sample(spark, sf):
    """A tenth of the documents, chosen by a seeded hash of their id."""
    return _docs(spark, sf, "doc_id").where(T.hash_bucket(F.concat(F.lit("seed-7:"), F.col("doc_id").cast("string"))) < 1000)


def linspace_subsample(spark, sf):
    return C.even_subsample(_docs(spark, sf, "doc_id"), "doc_id", 25).select("position", "doc_id")


def union_labelled(spark, sf):
    """Both held-out suites and the training prompts as one set with a label."""
    parts = [("ood_prompts", "item_id"), ("ood_spatial", "item_id"), ("scene_train", "pair_id")]
    out = None
    for name, key in parts:
        df = table(spark, sf, name, key, "prompt").select(F.lit(name).alias("origin_table"), F.col(key).alias("id"), F.length("prompt").alias("n_chars"))
        out = df if out is None else out.unionByName(df)
    return out


def set_difference(spark, sf):
    """Acts that some training intent asks for and no held-out intent does."""
    train = table(spark, sf, "scene_train", "intent").select(F.explode(F.flatten(F.map_values("intent.acts"))).alias("act"))
    held = table(spark, sf, "ood_prompts", "intent").select(F.explode("intent.acts_any").alias("act"))
    return train.distinct().join(held.distinct(), "act", "left_anti")


def anti_join_disjoint(spark, sf):
    """Training prompts that no held-out suite holds word by word."""
    held = table(spark, sf, "ood_prompts", "prompt").unionByName(table(spark, sf, "ood_spatial", "prompt"))
    train = table(spark, sf, "scene_train", "pair_id", "prompt").withColumn("key", T.clean(F.lower("prompt")))
    return train.join(held.select(T.clean(F.lower("prompt")).alias("key")).distinct(), "key", "left_anti").select("pair_id")


def lookup_last_wins(spark, sf):
    """Held-out prompts with the described-count list of the last training row of the same prompt, else an empty list."""
    train = table(spark, sf, "scene_train", "pair_id", "prompt", "intent").where("prompt IS NOT NULL")
    last = train.groupBy("prompt").agg(F.max_by("intent.props", "pair_id").alias("props"))
    held = table(spark, sf, "ood_prompts", "item_id", "prompt")
    return held.join(last, "prompt", "left").select("item_id", F.coalesce("props", F.array().cast("array<string>")).alias("props"))


def tokenise(spark, sf):
    return _docs(spark, sf, "doc_id", "text").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("joined_md5"))


def num_tokens(spark, sf):
    df = _docs(spark, sf, "doc_id", "text")
    atoms = T.number_atoms(F.col("text"))
    return df.select("doc_id", F.size(F.filter(atoms, lambda a: a["tok"] == "<NUM>")).alias("n_numbers"), F.round(F.aggregate(atoms, F.lit(0.0), lambda s, a: s + F.coalesce(a["val"], F.lit(0.0))), 4).alias("total"), F.md5(T.atoms_text(atoms)).alias("text_md5"))


def regex_tags(spark, sf):
    """Hex colours of each document: how many, and the first with its parts."""
    df = _docs(spark, sf, "doc_id", "text")
    found = F.regexp_extract_all("text", F.lit("#[0-9a-f]{6}"), 0)
    return df.where(F.size(found) > 0).select("doc_id", F.size(found).alias("n"), F.element_at(found, 1).alias("first_colour"), T.rgb_of(F.element_at(found, 1)).alias("rgb"))


def prefix_before(spark, sf):
    return table(spark, sf, "messages", "id", "content").distinct().select("id", T.prefix_before(F.col("content"), ";").alias("head")).where("head IS NOT NULL")


def coalesce_first_nonblank(spark, sf):
    return _docs(spark, sf, "doc_id", "text", "scene_name", "lang").select("doc_id", F.length(T.first_nonblank(F.col("text"), F.col("scene_name"), F.col("lang"))).alias("n_chars"))


def pick_max_else_min(spark, sf):
    df = _docs(spark, sf, "source", "doc_id", "n_chars")
    return C.largest_or_smallest(df, "source", "n_chars", "doc_id", 500, 3000)


def scan_ordered(spark, sf):
    """Documents in scan order with their place, found by ranges rather than by one window."""
    return C.with_position(_docs(spark, sf, "doc_id"), "doc_id").select("doc_id", "position")


def scan_head_n(spark, sf):
    df = table(spark, sf, "ood_prompts", "item_id", "prompt").where(F.regexp_replace("prompt", WS, "") != "")
    return df.orderBy("item_id").limit(10).select("item_id")


def limit_after_filter(spark, sf):
    """The first 50 documents of at most 80 tokens: the limit counts kept rows only."""
    df = _docs(spark, sf, "doc_id", "text").withColumn("n", F.size(T.tokens(F.col("text")))).where("n <= 80")
    return df.orderBy("doc_id").limit(50).select("doc_id", "n")


def manifest_arrays(spark, sf):
    """Per source: documents, characters and the ordered lengths of its ten first documents."""
    df = _docs(spark, sf, "source", "doc_id", "n_chars")
    heads = C.top_k_per_group(df, ["source"], [F.col("doc_id")], 10).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("h"))
    totals = df.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return totals.join(heads, totals["source"].eqNullSafe(heads["source"])).select(totals["source"], "n_docs", "n_chars", F.col("h.n_chars").alias("first_lengths"))


def having_min_len(spark, sf):
    return table(spark, sf, "messages", "chat_id").groupBy("chat_id").agg(F.count("*").alias("n")).where("n >= 20")


def mode_share(spark, sf):
    """Most frequent cast count per checkpoint, the smallest on ties, with its share and the distinct counts."""
    counts = table(spark, sf, "clause_probe3", "ckpt", "cast_n").where("cast_n IS NOT NULL").groupBy("ckpt", "cast_n").agg(F.count("*").alias("c"))
    best = counts.groupBy("ckpt").agg(F.max_by("cast_n", F.struct("c", -F.col("cast_n"))).alias("mode"), F.max("c").alias("c"), F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    return best.select("ckpt", "mode", F.round(F.col("c") / F.col("n"), 6).alias("mode_share"), "n_distinct")


def pivot_first(spark, sf):
    """Numeral by clauses, the cast count of the lowest row id in each cell."""
    df = table(spark, sf, "clause_probe3", "numeral", "clauses", "cast_n", "row_id").where("numeral IS NOT NULL AND clauses BETWEEN 1 AND 4")
    first = df.groupBy("numeral", "clauses").agg(F.min_by("cast_n", "row_id").alias("cast_n"))
    cells = [F.max(F.when(F.col("clauses") == c, F.col("cast_n"))).alias(f"clauses_{c}") for c in (1, 2, 3, 4)]
    return first.groupBy("numeral").agg(*cells)


def slot_accuracy(spark, sf):
    """Hits and support of each stated field of the outputs."""
    df = table(spark, sf, "out_of_distribution", "match_flags").where("match_flags IS NOT NULL").select(F.explode("match_flags").alias("slot", "hit"))
    known = df.where("hit IS NOT NULL")
    return known.groupBy("slot").agg(F.count_if("hit").alias("hits"), F.count("*").alias("support"), F.round(F.count_if("hit") / F.count("*"), 6).alias("accuracy"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, min_length_filter, reject_cascade, reason_histogram, regex_grep, keyword_classify, rule_extract, kv_parse_validate,
        take_while_lines, hash_split, split_totals, body_hash, truncate_tokens, label_mask, pad_longest, token_whitelist,
        regex_count_extract, dedup_two_stage, order_stats, conditional_rates, bool_and_rates, group_rates, normalised_top_k, explode_count,
        pearson_agreement, nan_excluding_mean, top_k, budget_limit, hash_shuffle_sample, linspace_subsample, union_labelled, set_difference,
        anti_join_disjoint, lookup_last_wins, tokenise, num_tokens, regex_tags, prefix_before, coalesce_first_nonblank, pick_max_else_min,
        scan_ordered, scan_head_n, limit_after_filter, manifest_arrays, having_min_len, mode_share, pivot_first, slot_accuracy,
    )
}

_W = r"'[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {_W}, ' ', 'g'), ' ')"


def _tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), {_W}), lambda x: x <> '')"


def _bucket(c: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({c}), 1, 15) AS BIGINT) % 10000 AS BIGINT)"


_CL, _TK = _clean("text"), _tok("text")
_SPLIT = f"CASE WHEN {_bucket('CAST(doc_id AS VARCHAR)')} < 500 THEN 'val' ELSE 'train' END"
_REASON = f"""SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN length({_CL}) < 15 THEN 'short'
 WHEN len(string_split(text, chr(10))) > 60 THEN 'too many lines' WHEN scene_name IS NULL THEN 'no scene' WHEN length(text) > 4000 THEN 'too long'
 WHEN len(string_split(text, chr(10))) < 2 THEN 'few lines' END AS reason FROM documents"""
_MASK = f"""SELECT pair_id, origin, list_concat(list_transform({_tok('prompt')}, lambda x: -100), list_transform({_tok('dsl')}, lambda x: CAST(length(x) AS INTEGER))) AS labels FROM scene_train"""


def _case(text: str, words: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{n}'" for w, n in words.items()) + f" ELSE '{default}' END"


ORACLE = {
    "clean_text": f"SELECT doc_id, md5({_CL}) AS clean_md5, length({_CL}) AS clean_len FROM documents",
    "min_length_filter": f"SELECT doc_id FROM documents WHERE length({_CL}) >= 15",
    "reject_cascade": _REASON,
    "reason_histogram": f"SELECT reason, count(*) AS n FROM ({_REASON}) GROUP BY 1 ORDER BY n DESC, reason NULLS LAST LIMIT 15",
    "regex_grep": "SELECT doc_id FROM documents WHERE regexp_matches(concat_ws(' ', text, lang, source), '(?i)palette|lantern')",
    "keyword_classify": f"SELECT pair_id, {_case('lower(coalesce(prompt, chr(32)))', _CLASSES, 'walk')} AS action FROM scene_train",
    "rule_extract": r"""SELECT pair_id, """ + _case("lower(coalesce(prompt, chr(32)))", {c: c for c in ("red", "green", "blue", "amber", "violet", "white")}, "none")
    + r""" AS colour, regexp_extract(lower(coalesce(prompt, '')), '\b(jumps|waves|dances|runs|walks|kneels|spins|claps)\b', 1) AS action,
 regexp_extract(lower(coalesce(prompt, '')), '\b(one|two|three|four|five|six|seven|eight|nine|\d+)\b', 1) AS count_word FROM scene_train""",
    "kv_parse_validate": f"""SELECT doc_id, a[-1] AS author, CASE WHEN s[-1] IN ('on', 'off') THEN s[-1] ELSE 'on' END AS state FROM (
 SELECT doc_id, list_transform(list_filter(w, lambda x: starts_with(x, 'author=')), lambda x: substr(x, 8)) AS a,
 list_transform(list_filter(w, lambda x: starts_with(x, 'state=')), lambda x: substr(x, 7)) AS s
 FROM (SELECT doc_id, {_tok("replace(text, ',', ' ')")} AS w FROM documents)) WHERE len(a) > 0""",
    "take_while_lines": r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS r FROM documents WHERE text IS NOT NULL),
 h AS (SELECT *, list_position(list_transform(r, lambda x: starts_with(x, '@ ')), true) AS pos FROM l),
 k AS (SELECT *, list_filter(list_slice(r, coalesce(pos, 1), len(r)), lambda x: regexp_replace(x, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]', '', 'g') <> '') AS rest FROM h),
 b AS (SELECT *, list_position(list_transform(rest, lambda x: x[1] IN ('@', 's', 'h', 'p')), false) AS bad FROM k)
 SELECT doc_id, md5(CASE WHEN pos > 0 THEN array_to_string(CASE WHEN bad > 0 THEN list_slice(rest, 1, bad - 1) ELSE rest END, chr(10))
  ELSE regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') END) AS body_md5 FROM b""",
    "hash_split": f"SELECT doc_id, {_SPLIT} AS split FROM documents",
    "split_totals": f"SELECT {_SPLIT} AS split, count(*) AS n_docs, CAST(sum(len({_TK})) AS BIGINT) AS n_tokens, round(sum(len({_TK})) / 3600, 6) AS hours FROM documents GROUP BY 1",
    "body_hash": "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, 'step ')), chr(10))) AS body FROM documents WHERE text IS NOT NULL",
    "truncate_tokens": f"SELECT doc_id, array_to_string({_TK}[:12], ' ') AS head FROM documents",
    "label_mask": f"SELECT pair_id, labels FROM ({_MASK})",
    "pad_longest": f"SELECT pair_id, CAST(m AS INTEGER) AS n, CAST(coalesce(list_sum(labels), 0) - 100 * (m - len(labels)) AS BIGINT) AS total FROM (SELECT *, max(len(labels)) OVER (PARTITION BY origin) AS m FROM ({_MASK}))",
    "token_whitelist": rf"""SELECT tok, count(*) AS n FROM (SELECT unnest({_TK}) AS tok FROM documents)
 WHERE regexp_full_match(tok, '(-?\d+(\.\d+)?|[a-z]{{1,4}}|#[0-9a-f]{{6}})') OR regexp_full_match(regexp_replace(tok, '^[(\[<]+', ''), '(-?\d+(\.\d+)?|[a-z]{{1,4}}|#[0-9a-f]{{6}})') GROUP BY 1""",
    "regex_count_extract": rf"""SELECT pair_id, CAST(CASE WHEN w = '' THEN NULL WHEN list_position({list(T.NUMBER_WORDS)}, w) > 0 THEN list_position({list(T.NUMBER_WORDS)}, w) ELSE TRY_CAST(w AS BIGINT) END AS BIGINT) AS expected
 FROM (SELECT pair_id, lower(regexp_extract(coalesce(prompt, ''), '(?i)\b({"|".join(T.NUMBER_WORDS)}|\d+)\b[^.]{{0,40}}?\b(?:figures|dancers|shapes|tailors|bakers|hikers|weavers)\b', 1)) AS w FROM scene_train)""",
    "dedup_two_stage": f"""WITH a AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY scene_name ORDER BY doc_id) = 1)
 SELECT doc_id FROM a WHERE length({_CL}) >= 15
 QUALIFY row_number() OVER (PARTITION BY array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, 'H ')), chr(10)) ORDER BY doc_id) = 1""",
    "order_stats": f"""SELECT lang, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, max(x) AS largest, list_sort(list(x))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS median,
 list_sort(list(x))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90, list_sort(list(x))[CAST(floor(count(*) * 0.1) AS BIGINT) + 1] AS p10
 FROM (SELECT lang, CAST(len({_TK}) AS INTEGER) AS x FROM documents) GROUP BY 1""",
    "conditional_rates": """SELECT count(*) AS n, round(count(*) FILTER (parsed) / count(*), 6) AS parsed_rate, round(count(*) FILTER (is_valid) / count(*), 6) AS valid_rate, round(count(*) FILTER (render) / count(*), 6) AS render_rate,
 round(count(*) FILTER (parsed AND match_flags['cast_count']) / count(*) FILTER (parsed AND match_flags['cast_count'] IS NOT NULL), 6) AS cast_match_rate, count(*) FILTER (parsed AND match_flags['cast_count'] IS NOT NULL) AS cast_match_known,
 round(count(*) FILTER (parsed AND match_flags['background']) / count(*) FILTER (parsed AND match_flags['background'] IS NOT NULL), 6) AS bg_match_rate, count(*) FILTER (parsed AND match_flags['background'] IS NOT NULL) AS bg_match_known FROM out_of_distribution""",
    "bool_and_rates": """SELECT label, count(*) AS n, count(*) FILTER (NOT coalesce(list_contains(map_values(match_flags), false), false)) AS n_all,
 count(*) FILTER (len(list_filter(map_entries(match_flags), lambda e: e.key <> 'layout' AND e.value = false)) IS NULL OR len(list_filter(map_entries(match_flags), lambda e: e.key <> 'layout' AND e.value = false)) = 0) AS n_all_but_layout
 FROM out_of_distribution WHERE parsed GROUP BY 1""",
    "group_rates": "SELECT grp, count(*) AS n, count(*) FILTER (render) AS n_render, count(*) FILTER (is_valid) AS n_valid, round(count(*) FILTER (is_valid) / count(*), 6) AS valid_rate FROM out_of_distribution GROUP BY 1",
    "normalised_top_k": "SELECT split_part(split_part(p, '=', 1), ' x', 1) AS problem, count(*) AS n FROM (SELECT unnest(problems) AS p FROM out_of_distribution) GROUP BY 1 ORDER BY n DESC, problem NULLS LAST LIMIT 8",
    "explode_count": "SELECT l.kind AS kind, count(*) AS n FROM (SELECT unnest(intent.layout) AS l FROM scene_train) GROUP BY 1",
    "pearson_agreement": """SELECT origin, count(*) AS n, round(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS r, count(*) FILTER (n_cast = n_described) AS n_equal
 FROM (SELECT *, CASE WHEN n_described IS NOT NULL THEN n_cast END AS a, CASE WHEN n_cast IS NOT NULL THEN n_described END AS b FROM scene_train) GROUP BY 1""",
    "nan_excluding_mean": """SELECT label, count(s.min_sep) FILTER (NOT isnan(s.min_sep)) AS n_sep, round(avg(s.min_sep) FILTER (NOT isnan(s.min_sep)), 6) AS mean_sep,
 round(avg(s.staging) FILTER (NOT isnan(s.staging)), 6) AS mean_staging, round(avg(s.span_frac) FILTER (NOT isnan(s.span_frac)), 6) AS mean_span
 FROM (SELECT label, staging AS s FROM out_of_distribution) WHERE s.n_cast >= 2 GROUP BY 1""",
    "top_k": f"SELECT word, count(*) AS n FROM (SELECT unnest({_tok('lower(text)')}) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word NULLS LAST LIMIT 15",
    "budget_limit": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 40",
    "hash_shuffle_sample": f"SELECT doc_id FROM documents WHERE {_bucket(chr(39) + 'seed-7:' + chr(39) + ' || CAST(doc_id AS VARCHAR)')} < 1000",
    "linspace_subsample": """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)
 SELECT position, doc_id FROM p WHERE n <= 25 OR position IN (SELECT CAST(floor(i * (n - 1) / 24) AS BIGINT) FROM range(25) t(i))""",
    "union_labelled": """SELECT 'ood_prompts' AS origin_table, item_id AS id, length(prompt) AS n_chars FROM ood_prompts UNION ALL SELECT 'ood_spatial', item_id, length(prompt) FROM ood_spatial
 UNION ALL SELECT 'scene_train', pair_id, length(prompt) FROM scene_train""",
    "set_difference": "SELECT act FROM (SELECT DISTINCT unnest(flatten(map_values(intent.acts))) AS act FROM scene_train) WHERE act NOT IN (SELECT unnest(intent.acts_any) FROM ood_prompts)",
    "anti_join_disjoint": f"""SELECT pair_id FROM scene_train WHERE {_clean('lower(prompt)')} NOT IN (SELECT {_clean('lower(prompt)')} FROM ood_prompts UNION ALL SELECT {_clean('lower(prompt)')} FROM ood_spatial)""",
    "lookup_last_wins": """SELECT o.item_id, coalesce(t.props, []) AS props FROM ood_prompts o LEFT JOIN (SELECT prompt, intent.props AS props FROM scene_train WHERE prompt IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY pair_id DESC) = 1) t ON o.prompt = t.prompt""",
    "tokenise": f"SELECT doc_id, len({_TK}) AS n, md5(array_to_string({_TK}, ' ')) AS joined_md5 FROM documents",
    "num_tokens": rf"""SELECT doc_id, len(list_filter(w, lambda x: regexp_full_match(x, '-?\d{{1,15}}'))) AS n_numbers,
 round(coalesce(list_sum(list_transform(list_filter(w, lambda x: regexp_full_match(x, '-?\d{{1,15}}')), lambda x: CAST(x AS DOUBLE) / 100)), 0), 4) AS total,
 md5(array_to_string(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '-?\d{{1,15}}') THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE x END), ' ')) AS text_md5 FROM (SELECT doc_id, {_TK} AS w FROM documents)""",
    "regex_tags": """SELECT doc_id, len(f) AS n, f[1] AS first_colour, [CAST('0x' || substr(f[1], 2, 2) AS INTEGER), CAST('0x' || substr(f[1], 4, 2) AS INTEGER), CAST('0x' || substr(f[1], 6, 2) AS INTEGER)] AS rgb
 FROM (SELECT doc_id, regexp_extract_all(text, '#[0-9a-f]{6}') AS f FROM documents) WHERE len(f) > 0""",
    "prefix_before": "SELECT id, split_part(content, ';', 1) AS head FROM (SELECT DISTINCT id, content FROM messages) WHERE content IS NOT NULL",
    "coalesce_first_nonblank": r"""SELECT doc_id, length(coalesce(CASE WHEN regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]', '', 'g') <> '' THEN text END,
 CASE WHEN regexp_replace(scene_name, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]', '', 'g') <> '' THEN scene_name END, CASE WHEN regexp_replace(lang, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]', '', 'g') <> '' THEN lang END)) AS n_chars FROM documents""",
    "pick_max_else_min": """SELECT source, coalesce(arg_max(doc_id, n_chars * 1e10 - doc_id) FILTER (n_chars > 500 AND n_chars <= 3000), arg_min(doc_id, n_chars * 1e10 + doc_id)) AS picked,
 coalesce(max(n_chars) FILTER (n_chars > 500 AND n_chars <= 3000), min(n_chars)) AS picked_size FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""",
    "scan_ordered": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
    "scan_head_n": r"SELECT item_id FROM ood_prompts WHERE regexp_replace(prompt, '[\s\p{Z}]', '', 'g') <> '' ORDER BY item_id LIMIT 10",
    "limit_after_filter": f"SELECT doc_id, CAST(len({_TK}) AS INTEGER) AS n FROM documents WHERE len({_TK}) <= 80 ORDER BY doc_id LIMIT 50",
    "manifest_arrays": "SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, list(n_chars ORDER BY doc_id)[:10] AS first_lengths FROM documents GROUP BY 1",
    "having_min_len": "SELECT chat_id, count(*) AS n FROM messages GROUP BY 1 HAVING count(*) >= 20",
    "mode_share": """SELECT ckpt, arg_max(cast_n, c * 1e6 - cast_n) AS mode, round(max(c) / sum(c), 6) AS mode_share, count(*) AS n_distinct FROM (SELECT ckpt, cast_n, count(*) AS c FROM clause_probe3 WHERE cast_n IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "pivot_first": """SELECT numeral, max(v) FILTER (clauses = 1) AS clauses_1, max(v) FILTER (clauses = 2) AS clauses_2, max(v) FILTER (clauses = 3) AS clauses_3, max(v) FILTER (clauses = 4) AS clauses_4
 FROM (SELECT numeral, clauses, cast_n AS v FROM clause_probe3 WHERE numeral IS NOT NULL AND clauses BETWEEN 1 AND 4 QUALIFY row_number() OVER (PARTITION BY numeral, clauses ORDER BY row_id) = 1) GROUP BY 1""",
    "slot_accuracy": """SELECT e.key AS slot, count(*) FILTER (e.value) AS hits, count(*) AS support, round(count(*) FILTER (e.value) / count(*), 6) AS accuracy
 FROM (SELECT unnest(map_entries(match_flags)) AS e FROM out_of_distribution) WHERE e.value IS NOT NULL GROUP BY 1""",
}
