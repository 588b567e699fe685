"""Queries of the series, join and aggregate operators over events, orders, line items and scene timelines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kinolith.functions import maths as M
from kinolith.functions import text as T
from kinolith.functions.expressions import translate
from kinolith.operators import series as S
from kinolith.operators.corpus import order_statistics, top_k_per_group
from kinolith.sources.tables import table

KEY, TIME = ["user_id"], ["ts", "event_id"]


def _events(spark, sf, *columns):
    return table(spark, sf, "events", *(columns or ("event_id", "ts", "user_id", "event_type", "value")))


def _lines(spark, sf, *columns):
    return table(spark, sf, "lineitem", "l_orderkey", *ORDER, *[c for c in columns if c not in ORDER])


LINE = ["l_linenumber", "l_partkey", "l_suppkey"]
#: Lines repeat their numbers and parts, so their order takes quantity and price as well.
ORDER = [*LINE, "l_quantity", "l_extendedprice"]


def lag_diff(spark, sf):
    return _events(spark, sf).select("event_id", F.round(S.lag_change("value", KEY, TIME), 6).alias("change"))


def shot_sessions(spark, sf):
    return S.sessions(_events(spark, sf), "value", KEY, TIME, 60.0, 3)


def decimate_every_k(spark, sf):
    """Every fifth event of each user."""
    w = S.ordered(KEY, TIME)
    return _events(spark, sf).withColumn("pos", F.row_number().over(w) - 1).where("pos % 5 = 0").select("event_id", "pos")


def delta_replay(spark, sf):
    """Running sum of the changes, and the last stated visibility."""
    seen = F.when(F.col("event_type") == "error", F.lit(0)).when(F.col("event_type") == "click", F.lit(1))
    w = S.so_far(KEY, TIME)
    return _events(spark, sf).select("event_id", F.round(F.sum("value").over(w), 6).alias("position"), F.last(seen, True).over(w).alias("visible"))


def clamped_fold(spark, sf):
    """Opacity clamped to [0, 100] after every change."""
    df = _events(spark, sf).withColumn("delta", F.col("value") - 20)
    out = S.fold(df, KEY, TIME, "delta", lambda s, v: F.least(F.greatest(s + v, F.lit(0.0)), F.lit(100.0)), F.lit(100.0))
    return out.select("user_id", F.round("state", 6).alias("opacity"), "n")


def ema_fold(spark, sf):
    """Exponential smoothing by half; a missing value holds the state."""
    start = F.lit(None).cast("double")
    out = S.fold(_events(spark, sf), KEY, TIME, "value", lambda s, v: F.coalesce(s + (v - s) * 0.5, v, s), start)
    return out.select("user_id", F.round("state", 6).alias("level"), "n")


def sliding_windows(spark, sf):
    out = S.windows_of(_events(spark, sf), KEY, TIME, "value", 8)
    return out.select("event_id", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 4).alias("window_sum"), F.round("target", 6).alias("target"))


def hold_and_backfill(spark, sf):
    known = F.when(F.col("value") >= 5, F.col("value"))
    return _events(spark, sf).select("event_id", S.hold_and_backfill(known, KEY, TIME).alias("held"))


def activity_fraction(spark, sf):
    """Users and days on which at least half of the events are clicks."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    df = _events(spark, sf).groupBy("user_id", day).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("n_active"))
    return df.where(F.col("n_active") >= F.col("n") * 0.5)


def sign_vote(spark, sf):
    df = _events(spark, sf).groupBy("user_id").agg(F.avg(F.col("value") - 20).alias("m"))
    return df.select("user_id", F.when(F.col("m") > 0, 1).otherwise(-1).alias("side"))


def gap_evenness(spark, sf):
    """Gaps between the sorted values of a user and their distance from even gaps."""
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    gaps = _events(spark, sf).withColumn("gap", F.lead("value").over(w) - F.col("value")).where("gap IS NOT NULL")
    even = F.avg("gap").over(Window.partitionBy("user_id"))
    return gaps.withColumn("even", even).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("gap") - F.col("even"), 2))), 6).alias("rmse"))


def presence_stats(spark, sf):
    df = _events(spark, sf)
    there = F.col("value") >= 10
    return df.groupBy("user_id").agg(F.count_if(there).alias("n_present"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("value").alias("least"), F.round(F.avg(F.when(there, F.col("value"))), 6).alias("mean_present"))


def summary_stats(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 6).alias("std"))


def flicker_ratio(spark, sf):
    """Mean change of each type against that of the type 'view'; null where there is none."""
    df = _events(spark, sf).withColumn("change", S.lag_change("value", ["event_type"], TIME))
    means = df.groupBy("event_type").agg(F.avg("change").alias("mean_change"))
    base = means.where("event_type = 'view'").select(F.col("mean_change").alias("base"))
    return means.join(F.broadcast(base), how="left").select("event_type", F.round("mean_change", 6).alias("mean_change"), F.round(F.col("mean_change") / F.greatest("base", F.lit(1e-6)), 6).alias("ratio"))


def proportional_align(spark, sf):
    """Place of each event of a user on a grid of ten guides, half-even."""
    w = S.ordered(KEY, TIME)
    df = _events(spark, sf).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    at = F.least(F.lit(9), F.rint(F.col("i") * 9 / F.greatest(F.col("n") - 1, F.lit(1))).cast("int"))
    return df.select("event_id", at.alias("guide"))


def hist_embedding_cosine(spark, sf):
    """Cosine of each user's histogram of values with the histogram of all."""
    bins = F.least(F.floor(F.col("value") / 10), F.lit(11)).cast("int")
    mine = _events(spark, sf).groupBy("user_id", bins.alias("bin")).agg(F.count("*").alias("c"))
    whole = _events(spark, sf).groupBy(bins.alias("bin")).agg(F.count("*").alias("t"))
    norm = whole.agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("norm"))
    both = mine.join(F.broadcast(whole), "bin")
    dots = both.groupBy("user_id").agg(F.sum(F.col("c") * F.col("t")).alias("dot"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("own"))
    return dots.join(F.broadcast(norm)).select("user_id", F.round(F.coalesce(F.try_divide(F.col("dot"), F.col("own") * F.col("norm")), F.lit(0.0)), 6).alias("cosine"))


def principal_axis(spark, sf):
    """Angle of the principal axis of (hour, value) per user."""
    x, y = F.hour("ts").cast("double"), F.col("value")
    df = _events(spark, sf).groupBy("user_id").agg(F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"))
    return df.select("user_id", F.round(F.atan2(F.col("sxy") * 2, F.col("sxx") - F.col("syy")) * 0.5, 6).alias("angle"))


def asof_position(spark, sf):
    """Value of each user at the start of each hour: that of the last event before it."""
    df = _events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR"))
    return df.groupBy("user_id", "hour").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def json_probe(spark, sf):
    return table(spark, sf, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def distinct_pairs(spark, sf):
    return _events(spark, sf, "user_id", "event_type").distinct()


def interval_latest_start(spark, sf):
    """For each whole second of a scene with an actor's event start: the window open then that started last."""
    t = table(spark, sf, "scene_grammar", "event_no", "scene_id", "s", "e").where("scene_id IS NOT NULL AND NOT isnan(s) AND NOT isnan(e) AND e > s AND s >= 0 AND e < 100000")
    spans = t.select("scene_id", F.floor(F.col("s") * 10).alias("from_at"), F.floor(F.col("e") * 10 + 1).alias("to_at"), "event_no").distinct()
    points = t.select("scene_id", (F.floor("s") * 10).alias("at")).distinct()
    return S.latest_start(points, spans, "scene_id", "at", "from_at", "to_at", "event_no", 100)


def adjacent_overlap(spark, sf):
    """Kick windows of a scene that begin before the one before them ends."""
    t = table(spark, sf, "scene_grammar", "event_no", "scene_id", "s", "e", "act").where("act = 'kick' AND scene_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND NOT isnan(s) AND NOT isnan(e)").distinct()
    w = Window.partitionBy("scene_id").orderBy("s", "e", "event_no")
    return t.withColumn("next_s", F.lead("s").over(w)).where("next_s < e").select("scene_id", "event_no")


def cap_keep_first(spark, sf):
    t = table(spark, sf, "scene_grammar", "scene_id", "event_no", "who", "s").where("scene_id IS NOT NULL AND who IS NOT NULL").groupBy("scene_id", "event_no").agg(F.min(F.lower(F.trim("who"))).alias("who"), F.min("s").alias("s"))
    return S.first_then_fill(t, ["scene_id"], "who", ["event_no"], 6).select("scene_id", "event_no")


def stable_sort_rank(spark, sf):
    w = Window.partitionBy("scene_id").orderBy(F.col("s").asc_nulls_last(), F.col("who").asc_nulls_last(), "event_no")
    t = table(spark, sf, "scene_grammar", "scene_id", "s", "who", "event_no").where("scene_id IS NOT NULL").distinct()
    return t.select("scene_id", "event_no", F.row_number().over(w).alias("place"))


def depth_sort(spark, sf):
    """Painter's order: by depth, then as listed."""
    w = Window.partitionBy("scene_id").orderBy(F.col("to_x").asc_nulls_first(), "event_no")
    t = table(spark, sf, "scene_grammar", "scene_id", "to_x", "event_no").where("scene_id IS NOT NULL").groupBy("scene_id", "event_no").agg(F.min("to_x").alias("to_x"))
    return t.select("scene_id", "event_no", F.row_number().over(w).alias("layer"))


def collect_set_sorted(spark, sf):
    return table(spark, sf, "out_of_distribution", "label", "problems").groupBy("label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("problems")))).alias("problems"))


def budget_prefix_trim(spark, sf):
    w = S.so_far(["l_orderkey"], ORDER)
    return _lines(spark, sf, "l_quantity").withColumn("used", F.sum("l_quantity").over(w)).where("used <= 60").select("l_orderkey", *LINE, "used")


def same_as_first(spark, sf):
    """Lines that share the return flag of the order's first line."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    return _lines(spark, sf, "l_returnflag").withColumn("first_flag", F.first("l_returnflag").over(w)).where("l_returnflag = first_flag").select("l_orderkey", *LINE)


def relative_roundtrip(spark, sf):
    """Quantities as differences to the line before, and summed up again."""
    w = S.ordered(["l_orderkey"], ORDER)
    df = _lines(spark, sf, "l_quantity").withColumn("rel", F.col("l_quantity") - F.coalesce(F.lag("l_quantity").over(w), F.lit(0.0)))
    return df.select("l_orderkey", *LINE, "rel", F.sum("rel").over(S.so_far(["l_orderkey"], ORDER)).alias("back"))


def argmin_first(spark, sf):
    """Cheapest line of each order, the first on ties."""
    return _lines(spark, sf, "l_extendedprice").groupBy("l_orderkey").agg(F.min(F.struct("l_extendedprice", *LINE)).alias("m")).select("l_orderkey", "m.l_extendedprice", *[f"m.{c}" for c in LINE])


def ratio_of_sums(spark, sf):
    return table(spark, sf, "lineitem", "l_shipdate", "l_extendedprice", "l_quantity").groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("price"))


def count_distinct(spark, sf):
    return table(spark, sf, "lineitem", "l_returnflag", "l_partkey").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"))


def bbox_union(spark, sf):
    return table(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_discount").groupBy("l_suppkey").agg(F.min("l_quantity").alias("x0"), F.min("l_discount").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_discount").alias("y1"))


def mean_extent(spark, sf):
    return table(spark, sf, "lineitem", "l_linestatus", "l_quantity", "l_discount").groupBy("l_linestatus").agg(F.round(F.avg(F.greatest(F.col("l_quantity") / 50, F.col("l_discount") * 10)), 6).alias("half_width"))


def cell_mode(spark, sf):
    """Most frequent quantity of each cell, the smallest on ties."""
    counts = table(spark, sf, "lineitem", "l_suppkey", "l_quantity").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("c"))
    return counts.groupBy("l_suppkey").agg(F.max_by("l_quantity", F.struct("c", -F.col("l_quantity"))).alias("mode"))


def contiguous_ids(spark, sf):
    """Orders whose line numbers run from 1 without a gap."""
    df = _lines(spark, sf).groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("n"), F.max("l_linenumber").alias("last"), F.min("l_linenumber").alias("first"))
    return df.where("first = 1 AND n = last").select("l_orderkey", "n")


def set_recall(spark, sf):
    """Share of the wanted line numbers 1 to 4 that an order has."""
    want = F.sequence(F.lit(1), F.lit(4))
    df = _lines(spark, sf).groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("got"))
    return df.select("l_orderkey", (F.size(F.array_intersect(want, "got")) / F.size(want)).alias("recall"))


def serialise_roundtrip(spark, sf):
    """Lines of an order as text in tenths, and the sum that the text gives back."""
    item = F.format_string("%d x %d", F.col("l_linenumber"), F.rint(F.col("l_quantity") * 10).cast("bigint"))
    df = _lines(spark, sf, "l_quantity").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*ORDER, item.alias("t")))).alias("rows"))
    text = F.array_join(F.col("rows.t"), " ; ")
    back = F.aggregate(F.split(text, " ; "), F.lit(0).cast("bigint"), lambda a, x: a + F.split(x, " x ")[1].cast("bigint"))
    return df.select("l_orderkey", text.alias("dsl"), (back / 10).alias("total"))


def validate_rules(spark, sf):
    """Problems of each order in fixed order."""
    df = _lines(spark, sf, "l_quantity", "l_discount", "l_shipdate").join(table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = df.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("d"), F.max("l_quantity").alias("q"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"), F.max("o_totalprice").alias("p"))
    rules = [("n > 7", "too many lines"), ("d < n", "duplicate line number"), ("q > 45", "quantity out of range"), ("early > 0", "shipped before ordered"), ("p < 5000", "total too small")]
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for rule, name in rules]))
    return by.select("o_orderkey", F.array_join(found, "|").alias("problems"))


def repair_clamp(spark, sf):
    """Quantity into 5..45 and discount to 0.08 at most, with what was changed."""
    q, d = M.clip(F.col("l_quantity"), 5.0, 45.0), F.least("l_discount", F.lit(0.08))
    changes = F.array_compact(F.array(F.when(q != F.col("l_quantity"), "quantity"), F.when(d != F.col("l_discount"), "discount")))
    return _lines(spark, sf, "l_quantity", "l_discount").where(F.size(changes) > 0).select("l_orderkey", *LINE, q.alias("quantity"), d.alias("discount"), F.array_join(changes, ",").alias("changes"))


def verdict_rules(spark, sf):
    """Hard and soft failures of each order, and the verdict they give."""
    by = _lines(spark, sf, "l_quantity", "l_discount", "l_tax").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    hard = F.array_compact(F.array(F.when(F.col("q") < 8, "coverage"), F.when(F.col("d") >= 0.1, "warp")))
    soft = F.array_compact(F.array(F.when(F.col("q") < 15, "coverage"), F.when(F.col("d") > 0.06, "warp"), F.when(F.col("t") > 0.07, "flicker")))
    verdict = F.when(F.size(hard) > 0, "NOT-AN-ANIMATION").when(F.size(soft) > 0, "PROMISING").otherwise("USABLE")
    return by.select("l_orderkey", verdict.alias("verdict"), F.array_join(F.concat(hard, soft), "|").alias("why"))


def layout_facts(spark, sf):
    """Which part of an order stands leftmost (least discount) and rightmost, and whether all are close."""
    by = _lines(spark, sf, "l_discount").groupBy("l_orderkey").agg(F.min(F.struct("l_discount", *ORDER)).alias("a"), F.max(F.struct("l_discount", *ORDER)).alias("b"))
    return by.select("l_orderkey", F.col("a.l_partkey").alias("leftmost"), F.col("b.l_partkey").alias("rightmost"), (F.col("b.l_discount") - F.col("a.l_discount") < 0.025).alias("close"))


def hex_rgb(spark, sf):
    size = F.col("p_size")
    colour = T.hex_of(size * 5, F.lit(255) - size, F.pmod(size * 37, F.lit(256)))
    return table(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", colour.alias("colour"), T.rgb_of(colour).alias("rgb"))


def string_basics(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part", "p_partkey", "p_name").select("p_partkey", F.upper(n).alias("upper_name"), F.startswith(n, F.lit("red")).alias("is_red"), F.replace(n, F.lit(" "), F.lit("_")).alias("slug"), F.substring(n, 1, 6).alias("head"), F.contains(n, F.lit("ring")).alias("has_ring"))


def format_pct(spark, sf):
    whole = F.rint(F.col("share") * 1000).cast("bigint")
    df = table(spark, sf, "orders", "o_orderstatus", "o_orderpriority").groupBy("o_orderpriority").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share"))
    return df.select("o_orderpriority", F.format_string("%d.%d%%", F.floor(whole / 10).cast("bigint"), whole % 10).alias("pct"))


def template_choice(spark, sf):
    choices = F.array(*[F.lit(x) for x in ("animate %s", "draw me %s", "picture %s", "imagine %s", "please show %s")])
    pick = F.element_at(choices, (T.hash_bucket(F.col("c_name"), 5) + 1).cast("int"))
    return table(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", F.replace(pick, F.lit("%s"), F.lower("c_name")).alias("prompt"))


def override_coalesce(spark, sf):
    """A value other than zero replaces the base value."""
    override = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.col("p_size")).otherwise(F.lit(0))
    return table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.coalesce(F.nullif(override, F.lit(0)).cast("double"), F.col("p_retailprice")).alias("value"))


def unpivot_segments(spark, sf):
    df = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    rows = F.array(*[F.struct(F.lit(n).alias("segment"), c.cast("double").alias("value")) for n, c in (("size", F.col("p_size")), ("price", F.col("p_retailprice")), ("ratio", F.round(F.col("p_retailprice") / F.col("p_size"), 3)))])
    return df.select("p_partkey", F.inline(rows))


def route_and_expand(spark, sf):
    """Route of each part by its type, and one row a frame with its progress."""
    route = F.when(F.col("p_type") == "PROMO", "learned").when(F.col("p_size") > 25, "neural").otherwise("equations")
    df = table(spark, sf, "part", "p_partkey", "p_type", "p_size").withColumn("route", route)
    n = F.least(F.col("p_size"), F.lit(4))
    return df.select("p_partkey", "route", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"), n.alias("n")).select("p_partkey", "route", "frame", F.round(F.col("frame") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("progress"))


def bucket_rates(spark, sf):
    bucket = F.when(F.col("p_size").between(1, 5), "1-5").when(F.col("p_size").between(6, 15), "6-15").otherwise("16+")
    return table(spark, sf, "part", "p_size", "p_type").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("p_type") == "ECONOMY") / F.count("*"), 6).alias("rate"))


def grid_argmin(spark, sf):
    """Cheapest brand and type: a sweep over the stated grid."""
    cells = table(spark, sf, "part", "p_brand", "p_type", "p_retailprice").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("cost"), F.count("*").alias("n"))
    return cells.agg(F.min(F.struct("cost", "p_brand", "p_type", "n")).alias("m")).select("m.*", F.floor(F.lit(1_000_000) / F.col("m.cost")).alias("fits"))


def exceedance_fraction(spark, sf):
    return table(spark, sf, "orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") >= 250000).cast("int")), 6).alias("high"), F.round(F.avg((F.col("o_totalprice") < 100000).cast("int")), 6).alias("low"))


def left_join_messages(spark, sf):
    """Messages with the file of the video they name, null where there is none."""
    m = table(spark, sf, "messages", "id", "chat_id", "video_id", "created").distinct()
    v = table(spark, sf, "videos", "id", "file").groupBy(F.col("id").alias("video_id")).agg(F.min("file").alias("file"))
    return m.join(v, "video_id", "left").select("id", "chat_id", "created", "file")


def left_join_gallery(spark, sf):
    v = table(spark, sf, "videos", "id", "chat_id", "prompt").distinct()
    c = table(spark, sf, "chats", "id", "title").groupBy(F.col("id").alias("chat_id")).agg(F.min("title").alias("chat_title"))
    return v.join(c, "chat_id", "left").select("id", "prompt", "chat_title")


def scalar_count_subquery(spark, sf):
    """Chats with the number of their videos, zero for none."""
    c = table(spark, sf, "chats", "id").distinct()
    v = table(spark, sf, "videos", "chat_id").groupBy(F.col("chat_id").alias("id")).agg(F.count("*").alias("n"))
    return c.join(v, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_videos"))


def semi_anti_membership(spark, sf):
    """Chats that have messages but no video."""
    c = table(spark, sf, "chats", "id").distinct()
    m, v = table(spark, sf, "messages", "chat_id"), table(spark, sf, "videos", "chat_id")
    return c.join(m, c["id"] == m["chat_id"], "left_semi").join(v, c["id"] == v["chat_id"], "left_anti")


def ordered_collect(spark, sf):
    """Order keys of each customer by date, without open ones; customers without any get an empty list."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus <> 'O'")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("rows"))
    c = table(spark, sf, "customer", "c_custkey")
    return c.join(lists, c["c_custkey"] == lists["o_custkey"], "left").select("c_custkey", F.coalesce("rows.o_orderkey", F.array().cast("array<bigint>")).alias("orders"))


def cross_coverage(spark, sf):
    """Brands and nations whose suppliers' balance exceeds the brand's mean price more than half of the time."""
    p = table(spark, sf, "part", "p_brand", "p_retailprice").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price"))
    s = table(spark, sf, "supplier", "s_nationkey", "s_acctbal")
    both = s.join(F.broadcast(p))  # the brands are a fixed list
    return both.groupBy("p_brand", "s_nationkey").agg(F.count_if(F.col("s_acctbal") > F.col("mean_price") * 3).alias("k"), F.count("*").alias("n")).where("k > n * 0.5").select("p_brand", "s_nationkey", "k", "n")


def recursive_chain(spark, sf):
    """Ancestors of each nation in the chain n -> n / 2, twelve hops at most, by unrolled joins."""
    links = table(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").alias("k"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("up"))
    now = links.select(F.col("k").alias("root"), "up", F.lit(1).alias("depth"))
    out = now
    for _ in range(4):  # 25 nations: no chain is longer
        step = now.where("up > 0").withColumnRenamed("up", "k").join(F.broadcast(links), "k").select("root", "up", (F.col("depth") + 1).alias("depth"))
        out, now = out.unionByName(step), step
    return out.groupBy("root").agg(F.max("depth").alias("hops"))


def mismatched_pair_lift(spark, sf):
    """Matched rate, chance rate over all ordered pairs of different rows, and lift, from group counts alone."""
    df = table(spark, sf, "scene_train", "intent", "dsl").where("intent IS NOT NULL AND dsl IS NOT NULL").select(F.col("intent.bg").alias("want"), F.regexp_extract("dsl", r"^bg (\w+)", 1).alias("got"))
    total = df.agg(F.count("*").alias("n"), F.count_if(F.col("want") == F.col("got")).alias("hits"))
    w, g = df.groupBy("want").agg(F.count("*").alias("a")), df.groupBy(F.col("got").alias("want")).agg(F.count("*").alias("b"))
    pairs = w.join(g, "want").agg(F.sum(F.col("a") * F.col("b")).alias("same"))
    both = total.join(pairs)
    matched, chance = F.col("hits") / F.col("n"), F.try_divide(F.col("same") - F.col("hits"), F.col("n") * (F.col("n") - 1))
    return both.select(F.round(matched, 6).alias("matched"), F.round(chance, 6).alias("chance"), F.round(matched - chance, 6).alias("lift"))


def math_trig(spark, sf):
    x = F.col("l_discount") * 10
    return _lines(spark, sf, "l_discount", "l_tax").select("l_orderkey", *LINE, F.round(F.sin(x), 6).alias("s"), F.round(F.tanh(x), 6).alias("t"), F.round(F.atan2("l_discount", F.col("l_tax") + 0.01), 6).alias("a"), F.round(F.exp(-x), 6).alias("e"))


def math_log_domain(spark, sf):
    x = F.floor(F.col("value")) - 5
    return _events(spark, sf).select("event_id", F.round(F.when(x > 0, M.log_or_inf(x.cast("double"))), 6).alias("log"), (M.log_or_inf(x.cast("double")) == float("-inf")).alias("at_zero"), F.isnan(F.sqrt(x.cast("double"))).alias("bad_root"))


def math_round_even(spark, sf):
    x = F.col("l_quantity") / 2
    return _lines(spark, sf, "l_quantity").select("l_orderkey", *LINE, F.rint(x).alias("rounded"), F.floor(x).cast("double").alias("lower"), F.ceil(x).cast("double").alias("upper"), F.signum(x - 10).alias("side"))


def math_mod_fmod(spark, sf):
    x = F.floor(F.col("value")).cast("double") - 20
    return _events(spark, sf).select("event_id", M.floor_mod(x, F.lit(7.0)).alias("mod_pos"), M.floor_mod(x, F.lit(-7.0)).alias("mod_neg"), (M.trunc_mod(x, F.lit(7.0)) + 0.0).alias("fmod"))


def math_clip_where(spark, sf):
    q = F.col("l_quantity")
    return _lines(spark, sf, "l_quantity", "l_discount").select("l_orderkey", *LINE, M.clip(q, 10.0, 40.0).alias("clipped"), F.when(F.col("l_discount") > 0.05, q).otherwise(-q).alias("chosen"))


def math_shape_fns(spark, sf):
    x = F.col("value")
    return _events(spark, sf).select("event_id", F.round(M.gauss(x, 20.0, 5.0), 6).alias("gauss"), M.pulse(x, 8.0, 0.25).alias("pulse"), F.round(M.smoothstep(x, 5.0, 35.0), 6).alias("ramp"))


def colormap_lerp(spark, sf):
    return _events(spark, sf).select("event_id", M.colormap(F.col("value"), [(0.0, 10), (15.0, 120), (40.0, 250)]).alias("level"))


def fourier_features(spark, sf):
    f = M.fourier(F.col("value") / 50, (1, 2, 3))
    return _events(spark, sf).select("event_id", F.transform(f, lambda x: F.round(x, 6) + 0.0).alias("features"))


def expr_eval(spark, sf):
    """A user's equation over the line items, translated by a whitelist."""
    columns = {"q": F.col("l_quantity"), "d": F.col("l_discount")}
    value = translate("where(q > 25, q * (1 - d), maximum(q, 10) + a * sin(pi * d)) % 7", columns, {"a": 2.0})
    return _lines(spark, sf, "l_quantity", "l_discount").select("l_orderkey", *LINE, F.round(value, 6).alias("value"))


def map_merge_precedence(spark, sf):
    """Rules merged with a model's words: non-empty ones win, but a special rule stays."""
    t = table(spark, sf, "scene_train", "pair_id", "intent").where("intent IS NOT NULL")
    rules = F.create_map(F.lit("bg"), F.lit("park"), F.lit("kick"), F.when(F.col("intent.kick"), "special").otherwise("no"))
    model = F.map_filter(F.create_map(F.lit("bg"), F.coalesce("intent.bg", F.lit("")), F.lit("kick"), F.lit("maybe")), lambda k, v: v != "")
    pick = lambda k: F.coalesce(model[k], rules[k])
    return t.select("pair_id", pick("bg").alias("bg"), F.when(rules["kick"] == "special", "special").otherwise(pick("kick")).alias("kick"))


QUERIES = {
    f.__name__: f
    for f in (
        lag_diff, shot_sessions, decimate_every_k, delta_replay, clamped_fold, ema_fold, sliding_windows, hold_and_backfill, activity_fraction,
        sign_vote, gap_evenness, presence_stats, summary_stats, flicker_ratio, proportional_align, hist_embedding_cosine, principal_axis,
        asof_position, json_probe, distinct_pairs, interval_latest_start, adjacent_overlap, cap_keep_first, stable_sort_rank, depth_sort,
        collect_set_sorted, budget_prefix_trim, same_as_first, relative_roundtrip, argmin_first, ratio_of_sums, count_distinct, bbox_union,
        mean_extent, cell_mode, contiguous_ids, set_recall, serialise_roundtrip, validate_rules, repair_clamp, verdict_rules, layout_facts,
        hex_rgb, string_basics, format_pct, template_choice, override_coalesce, unpivot_segments, route_and_expand, bucket_rates, grid_argmin,
        exceedance_fraction, left_join_messages, left_join_gallery, scalar_count_subquery, semi_anti_membership, ordered_collect,
        cross_coverage, recursive_chain, mismatched_pair_lift, math_trig, math_log_domain, math_round_even, math_mod_fmod, math_clip_where,
        math_shape_fns, colormap_lerp, fourier_features, expr_eval, map_merge_precedence,
    )
}

_U = "PARTITION BY user_id ORDER BY ts, event_id"
_L = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_LK = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORACLE = {
    "lag_diff": f"SELECT event_id, round(abs(value - lag(value) OVER ({_U})), 6) AS change FROM events",
    "shot_sessions": f"""WITH a AS (SELECT *, row_number() OVER ({_U}) - 1 AS pos, coalesce(CAST(abs(value - lag(value) OVER ({_U})) > 60 AS INT), 0) AS cut FROM events),
 b AS (SELECT *, sum(cut) OVER ({_U} ROWS UNBOUNDED PRECEDING) AS segment FROM a)
 SELECT user_id, CAST(segment AS BIGINT) AS segment, min(pos) AS first_pos, max(pos) + 1 AS end_pos, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 3""",
    "decimate_every_k": f"SELECT event_id, row_number() OVER ({_U}) - 1 AS pos FROM events QUALIFY pos % 5 = 0",
    "delta_replay": f"""SELECT event_id, round(sum(value) OVER ({_U} ROWS UNBOUNDED PRECEDING), 6) AS position,
 last_value(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 END IGNORE NULLS) OVER ({_U} ROWS UNBOUNDED PRECEDING) AS visible FROM events""",
    "clamped_fold": "SELECT user_id, round(list_reduce(list_prepend(100.0, list(value - 20 ORDER BY ts, event_id)), lambda s, v: least(greatest(s + v, 0.0), 100.0)), 6) AS opacity, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1",
    "ema_fold": "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, v: coalesce(s + (v - s) * 0.5, v, s)), 6) AS level, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1",
    "sliding_windows": f"""SELECT event_id, round(sum(value) OVER ({_U} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), 4) AS window_sum, round(lead(value, 8) OVER ({_U}) - lead(value, 7) OVER ({_U}), 6) AS target FROM events QUALIFY target IS NOT NULL""",
    "hold_and_backfill": f"""SELECT event_id, coalesce(last_value(CASE WHEN value >= 5 THEN value END IGNORE NULLS) OVER ({_U} ROWS UNBOUNDED PRECEDING),
 first_value(CASE WHEN value >= 5 THEN value END IGNORE NULLS) OVER ({_U} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS held FROM events""",
    "activity_fraction": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_active FROM events GROUP BY 1, 2 HAVING n_active >= n * 0.5",
    "sign_vote": "SELECT user_id, CASE WHEN avg(value - 20) > 0 THEN 1 ELSE -1 END AS side FROM events GROUP BY 1",
    "gap_evenness": """WITH g AS (SELECT user_id, lead(value) OVER (PARTITION BY user_id ORDER BY value, event_id) - value AS gap FROM events), h AS (SELECT *, avg(gap) OVER (PARTITION BY user_id) AS m FROM g WHERE gap IS NOT NULL)
 SELECT user_id, count(*) AS n, round(sqrt(avg((gap - m) ** 2)), 6) AS rmse FROM h GROUP BY 1""",
    "presence_stats": "SELECT user_id, count(*) FILTER (value >= 10) AS n_present, round(avg(value), 6) AS mean_value, min(value) AS least, round(avg(value) FILTER (value >= 10), 6) AS mean_present FROM events GROUP BY 1",
    "summary_stats": "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1",
    "flicker_ratio": """WITH c AS (SELECT event_type, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS ch FROM events), m AS (SELECT event_type, avg(ch) AS mean_change FROM c GROUP BY 1)
 SELECT event_type, round(mean_change, 6) AS mean_change, round(mean_change / greatest((SELECT mean_change FROM m WHERE event_type = 'view'), 1e-6), 6) AS ratio FROM m""",
    "proportional_align": f"SELECT event_id, least(9, CAST(round_even((row_number() OVER ({_U}) - 1) * 9 / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1), 0) AS INTEGER)) AS guide FROM events",
    "hist_embedding_cosine": """WITH m AS (SELECT user_id, least(floor(value / 10), 11) AS b, count(*) AS c FROM events GROUP BY 1, 2), t AS (SELECT least(floor(value / 10), 11) AS b, count(*) AS t FROM events GROUP BY 1)
 SELECT user_id, round(sum(c * t) / (sqrt(sum(c * c)) * (SELECT sqrt(sum(t * t)) FROM t)), 6) AS cosine FROM m JOIN t USING (b) GROUP BY 1""",
    "principal_axis": "SELECT user_id, round(0.5 * atan2(2 * covar_pop(hour(ts), value), var_pop(hour(ts)) - var_pop(value)), 6) AS angle FROM events GROUP BY 1",
    "asof_position": "SELECT user_id, hour, value FROM (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY ts DESC, event_id DESC) = 1",
    "json_probe": "SELECT event_id, CAST(props::JSON->>'$.k' AS INTEGER) AS k FROM events",
    "distinct_pairs": "SELECT DISTINCT user_id, event_type FROM events",
    "interval_latest_start": """WITH t AS (SELECT * FROM scene_grammar WHERE scene_id IS NOT NULL AND NOT isnan(s) AND NOT isnan(e) AND e > s AND s >= 0 AND e < 100000),
 i AS (SELECT DISTINCT scene_id, CAST(floor(s * 10) AS BIGINT) AS f, CAST(floor(e * 10 + 1) AS BIGINT) AS u, event_no FROM t), p AS (SELECT DISTINCT scene_id, CAST(floor(s) AS BIGINT) * 10 AS at_t FROM t)
 SELECT p.scene_id, p.at_t AS at, i.event_no FROM p LEFT JOIN i ON i.scene_id = p.scene_id AND i.f <= p.at_t AND p.at_t < i.u QUALIFY row_number() OVER (PARTITION BY p.scene_id, p.at_t ORDER BY i.f DESC, i.event_no DESC) = 1""",
    "adjacent_overlap": """SELECT scene_id, event_no FROM (SELECT DISTINCT scene_id, event_no, s, e FROM scene_grammar WHERE act = 'kick' AND scene_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND NOT isnan(s) AND NOT isnan(e))
 QUALIFY lead(s) OVER (PARTITION BY scene_id ORDER BY s, e, event_no) < e""",
    "cap_keep_first": """WITH t AS (SELECT scene_id, event_no, min(lower(trim(who))) AS who FROM scene_grammar WHERE scene_id IS NOT NULL AND who IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id, who ORDER BY event_no) > 1 AS INT) AS again FROM t)
 SELECT scene_id, event_no FROM r QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY again, event_no) <= 6""",
    "stable_sort_rank": "SELECT scene_id, event_no, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY s NULLS LAST, who NULLS LAST, event_no) AS INTEGER) AS place FROM (SELECT DISTINCT scene_id, s, who, event_no FROM scene_grammar WHERE scene_id IS NOT NULL)",
    "depth_sort": "SELECT scene_id, event_no, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY to_x NULLS FIRST, event_no) AS INTEGER) AS layer FROM (SELECT scene_id, event_no, min(to_x) AS to_x FROM scene_grammar WHERE scene_id IS NOT NULL GROUP BY 1, 2)",
    "collect_set_sorted": "SELECT label, list_sort(list_distinct(coalesce(flatten(list(problems) FILTER (problems IS NOT NULL)), []))) AS problems FROM out_of_distribution GROUP BY 1",
    "budget_prefix_trim": f"SELECT {_LK}, sum(l_quantity) OVER ({_L} ROWS UNBOUNDED PRECEDING) AS used FROM lineitem QUALIFY used <= 60",
    "same_as_first": f"SELECT {_LK} FROM lineitem QUALIFY l_returnflag = first_value(l_returnflag) OVER ({_L})",
    "relative_roundtrip": f"""SELECT {_LK}, rel, sum(rel) OVER ({_L} ROWS UNBOUNDED PRECEDING) AS back FROM (SELECT {_LK}, l_quantity, l_extendedprice, l_quantity - coalesce(lag(l_quantity) OVER ({_L}), 0) AS rel FROM lineitem)""",
    "argmin_first": f"SELECT l_orderkey, l_extendedprice, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) = 1",
    "ratio_of_sums": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY 1",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1",
    "bbox_union": "SELECT l_suppkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_discount) AS y1 FROM lineitem GROUP BY 1",
    "mean_extent": "SELECT l_linestatus, round(avg(greatest(l_quantity / 50, l_discount * 10)), 6) AS half_width FROM lineitem GROUP BY 1",
    "cell_mode": "SELECT l_suppkey, l_quantity AS mode FROM (SELECT l_suppkey, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, l_quantity) = 1",
    "contiguous_ids": "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 1 AND count(DISTINCT l_linenumber) = max(l_linenumber)",
    "set_recall": "SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 1 AND 4) / 4 AS recall FROM lineitem GROUP BY 1",
    "serialise_roundtrip": "SELECT l_orderkey, string_agg(l_linenumber || ' x ' || CAST(round_even(l_quantity * 10, 0) AS BIGINT), ' ; ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dsl, sum(CAST(round_even(l_quantity * 10, 0) AS BIGINT)) / 10 AS total FROM lineitem GROUP BY 1",
    "validate_rules": """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN n > 7 THEN 'too many lines' END, CASE WHEN d < n THEN 'duplicate line number' END, CASE WHEN q > 45 THEN 'quantity out of range' END,
 CASE WHEN early > 0 THEN 'shipped before ordered' END, CASE WHEN p < 5000 THEN 'total too small' END], lambda x: x IS NOT NULL), '|') AS problems FROM (SELECT o_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, max(l_quantity) AS q,
 count(*) FILTER (l_shipdate < o_orderdate) AS early, max(o_totalprice) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""",
    "repair_clamp": f"""SELECT {_LK}, greatest(least(l_quantity, 45), 5) AS quantity, least(l_discount, 0.08) AS discount, array_to_string(list_filter([CASE WHEN l_quantity NOT BETWEEN 5 AND 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END], lambda x: x IS NOT NULL), ',') AS changes
 FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45 OR l_discount > 0.08""",
    "verdict_rules": """SELECT l_orderkey, CASE WHEN q < 8 OR d >= 0.1 THEN 'NOT-AN-ANIMATION' WHEN q < 15 OR d > 0.06 OR t > 0.07 THEN 'PROMISING' ELSE 'USABLE' END AS verdict,
 array_to_string(list_filter([CASE WHEN q < 8 THEN 'coverage' END, CASE WHEN d >= 0.1 THEN 'warp' END, CASE WHEN q < 15 THEN 'coverage' END, CASE WHEN d > 0.06 THEN 'warp' END, CASE WHEN t > 0.07 THEN 'flicker' END], lambda x: x IS NOT NULL), '|') AS why
 FROM (SELECT l_orderkey, avg(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1)""",
    "layout_facts": """SELECT l_orderkey, list(l_partkey ORDER BY l_discount, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)[1] AS leftmost, list(l_partkey ORDER BY l_discount, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)[-1] AS rightmost, max(l_discount) - min(l_discount) < 0.025 AS close FROM lineitem GROUP BY 1""",
    "hex_rgb": "SELECT p_partkey, printf('#%02X%02X%02X', p_size * 5, 255 - p_size, (p_size * 37) % 256) AS colour, [p_size * 5, 255 - p_size, (p_size * 37) % 256] AS rgb FROM part",
    "string_basics": "SELECT p_partkey, upper(p_name) AS upper_name, starts_with(p_name, 'red') AS is_red, replace(p_name, ' ', '_') AS slug, substr(p_name, 1, 6) AS head, contains(p_name, 'ring') AS has_ring FROM part",
    "format_pct": "SELECT o_orderpriority, (w // 10) || '.' || (w % 10) || '%' AS pct FROM (SELECT o_orderpriority, CAST(round_even(count(*) FILTER (o_orderstatus = 'F') / count(*) * 1000, 0) AS BIGINT) AS w FROM orders GROUP BY 1)",
    "template_choice": "SELECT c_custkey, replace(['animate %s', 'draw me %s', 'picture %s', 'imagine %s', 'please show %s'][CAST('0x' || substr(md5(c_name), 1, 15) AS BIGINT) % 5 + 1], '%s', lower(c_name)) AS prompt FROM customer",
    "override_coalesce": "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END, 0)::DOUBLE, p_retailprice) AS value FROM part",
    "unpivot_segments": "SELECT p_partkey, unnest(['size', 'price', 'ratio']) AS segment, unnest([p_size::DOUBLE, p_retailprice, round(p_retailprice / p_size, 3)]) AS value FROM part",
    "route_and_expand": """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'learned' WHEN p_size > 25 THEN 'neural' ELSE 'equations' END AS route, CAST(f AS INTEGER) AS frame, round(f / greatest(least(p_size, 4) - 1, 1), 6) AS progress
 FROM (SELECT *, unnest(range(least(p_size, 4))) AS f FROM part)""",
    "bucket_rates": "SELECT CASE WHEN p_size BETWEEN 1 AND 5 THEN '1-5' WHEN p_size BETWEEN 6 AND 15 THEN '6-15' ELSE '16+' END AS bucket, count(*) AS n, round(count(*) FILTER (p_type = 'ECONOMY') / count(*), 6) AS rate FROM part GROUP BY 1",
    "grid_argmin": "SELECT round(avg(p_retailprice), 6) AS cost, p_brand, p_type, count(*) AS n, CAST(floor(1000000 / round(avg(p_retailprice), 6)) AS BIGINT) AS fits FROM part GROUP BY p_brand, p_type ORDER BY cost, p_brand, p_type LIMIT 1",
    "exceedance_fraction": "SELECT o_orderpriority, round(avg(CAST(o_totalprice >= 250000 AS INT)), 6) AS high, round(avg(CAST(o_totalprice < 100000 AS INT)), 6) AS low FROM orders GROUP BY 1",
    "left_join_messages": "SELECT m.id, m.chat_id, m.created, v.file FROM (SELECT DISTINCT id, chat_id, video_id, created FROM messages) m LEFT JOIN (SELECT id, min(file) AS file FROM videos GROUP BY 1) v ON m.video_id = v.id",
    "left_join_gallery": "SELECT v.id, v.prompt, c.title AS chat_title FROM (SELECT DISTINCT id, chat_id, prompt FROM videos) v LEFT JOIN (SELECT id, min(title) AS title FROM chats GROUP BY 1) c ON v.chat_id = c.id",
    "scalar_count_subquery": "SELECT DISTINCT c.id, (SELECT count(*) FROM videos v WHERE v.chat_id = c.id) AS n_videos FROM chats c",
    "semi_anti_membership": "SELECT DISTINCT id FROM chats WHERE id IN (SELECT chat_id FROM messages) AND NOT EXISTS (SELECT 1 FROM videos v WHERE v.chat_id = chats.id)",
    "ordered_collect": "SELECT c_custkey, coalesce(o, []) AS orders FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS o FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) ON o_custkey = c_custkey",
    "cross_coverage": "SELECT p_brand, s_nationkey, count(*) FILTER (s_acctbal > m * 3) AS k, count(*) AS n FROM supplier, (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) GROUP BY 1, 2 HAVING k > n * 0.5",
    "recursive_chain": "WITH RECURSIVE c(root, up, depth) AS (SELECT n_nationkey, n_nationkey // 2, 1 FROM nation UNION ALL SELECT root, up // 2, depth + 1 FROM c WHERE up > 0 AND depth < 12) SELECT root, max(depth) AS hops FROM c GROUP BY 1",
    "mismatched_pair_lift": r"""WITH d AS (SELECT intent.bg AS want, regexp_extract(dsl, '^bg (\w+)', 1) AS got FROM scene_train WHERE intent IS NOT NULL AND dsl IS NOT NULL),
 t AS (SELECT count(*) AS n, count(*) FILTER (want = got) AS hits FROM d), s AS (SELECT sum(a * b) AS same FROM (SELECT want, count(*) AS a FROM d GROUP BY 1) JOIN (SELECT got AS want, count(*) AS b FROM d GROUP BY 1) USING (want))
 SELECT round(hits / n, 6) AS matched, round((same - hits) / (n * (n - 1)), 6) AS chance, round(hits / n - (same - hits) / (n * (n - 1)), 6) AS lift FROM t, s""",
    "math_trig": f"SELECT {_LK}, round(sin(l_discount * 10), 6) AS s, round(tanh(l_discount * 10), 6) AS t, round(atan2(l_discount, l_tax + 0.01), 6) AS a, round(exp(-l_discount * 10), 6) AS e FROM lineitem",
    "math_log_domain": "SELECT event_id, round(CASE WHEN x > 0 THEN ln(x) END, 6) AS log, x = 0 AS at_zero, x < 0 AS bad_root FROM (SELECT event_id, floor(value) - 5 AS x FROM events)",
    "math_round_even": f"SELECT {_LK}, round_even(l_quantity / 2, 0) AS rounded, floor(l_quantity / 2) AS lower, ceil(l_quantity / 2) AS upper, CAST(sign(l_quantity / 2 - 10) AS DOUBLE) AS side FROM lineitem",
    "math_mod_fmod": "SELECT event_id, x - 7 * floor(x / 7) AS mod_pos, x + 7 * floor(x / -7) AS mod_neg, x - 7 * trunc(x / 7) AS fmod FROM (SELECT event_id, floor(value) - 20.0::DOUBLE AS x FROM events)",
    "math_clip_where": f"SELECT {_LK}, greatest(least(l_quantity, 40), 10) AS clipped, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE -l_quantity END AS chosen FROM lineitem",
    "math_shape_fns": "SELECT event_id, round(exp(-0.5 * ((value - 20) / (5 + 1e-12)) ** 2), 6) AS gauss, CASE WHEN value - 8 * floor(value / 8) < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pulse, round(t * t * (3 - 2 * t), 6) AS ramp FROM (SELECT *, greatest(least((value - 5) / 30, 1), 0) AS t FROM events)",
    "colormap_lerp": "SELECT event_id, CAST(floor(CASE WHEN v < 15 THEN v / 15 * 110 + 10 WHEN v < 40 THEN (v - 15) / 25 * 130 + 120 ELSE 250 END) AS INTEGER) AS level FROM (SELECT event_id, greatest(least(value, 40), 0) AS v FROM events)",
    "fourier_features": "SELECT event_id, list_transform([sin(a), cos(a), sin(2 * a), cos(2 * a), sin(3 * a), cos(3 * a)], lambda x: round(x, 6) + 0.0) AS features FROM (SELECT event_id, value / 50 * 2 * pi() AS a FROM events)",
    "expr_eval": f"SELECT {_LK}, round(v - 7 * floor(v / 7), 6) AS value FROM (SELECT *, CASE WHEN l_quantity > 25 THEN l_quantity * (1 - l_discount) ELSE greatest(l_quantity, 10) + 2 * sin(pi() * l_discount) END AS v FROM lineitem)",
    "map_merge_precedence": "SELECT pair_id, CASE WHEN coalesce(intent.bg, '') <> '' THEN intent.bg ELSE 'park' END AS bg, CASE WHEN intent.kick THEN 'special' ELSE 'maybe' END AS kick FROM scene_train WHERE intent IS NOT NULL",
}
