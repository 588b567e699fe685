"""Cut-off outputs, planted in whole ones."""

from kinolith.llm import truncation as T

HEAD = "bg park dur 81 | cast mab red 43 60 ; ivo pink 19 90 | prop ball 26 100 | tl "
ENTRIES = ["5 20 mab jump", "9 30 ivo wave", "12 40 mab kick ball ivo", "20 44 ivo run 58", "31 50 mab dance"]


def whole(n):
    return [(f"w{i}", HEAD + " ; ".join(ENTRIES[i % 5 :] + ENTRIES[: i % 5])) for i in range(n)]


CUT = [
    "bg park dur 81", "bg park dur 81 | cast mab re", "bg park dur 81 | cast mab red 43 60 ;", HEAD, HEAD + "5 20", HEAD + "5 20 mab",
    HEAD + "5 20 mab jump ;", HEAD + "5 20 mab ki", HEAD + "5 20 mab kick ba", HEAD + "5 20 mab kick ball iv", HEAD + "5 20 ma…", HEAD + "5 20 mab da [truncated]", "...",
]
WHOLE = [HEAD + "5 20 mab sneeze", HEAD + "5 20 nobody jump", HEAD + "5 20 mab jump \n", HEAD.replace("dur", "len") + "5 20 mab walk", HEAD + "5 20 mab kick ball", None, "", " ​\n"]


def test_planted_cuts_are_found_and_whole_ones_are_not(spark):
    rows = [("t", i, r) for i, r in enumerate([*CUT, *WHOLE, *(w for _, w in whole(300))])]
    df = spark.createDataFrame(rows + rows[:3], "src_table string, row_id int, raw string")
    found = T.truncated(df).collect()
    assert sorted(r.row_id for r in found) == list(range(len(CUT)))


def test_rates_and_empty_table(spark):
    rows = [("t", i, "a" if i % 2 else None, w) for i, (_, w) in enumerate(whole(40))] + [("t", 40, "a", CUT[4])]
    df = spark.createDataFrame(rows, "src_table string, row_id int, source string, raw string")
    assert sorted((r.source or "", r.n_outputs, r.n_truncated) for r in T.truncation_rates(df).collect()) == [("", 20, 0), ("a", 21, 1)]
    assert T.truncated(df.where("row_id < 0")).collect() == []
