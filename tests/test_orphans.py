"""Dangling references on repeated and id-less rows."""

import pytest

import __spark_entry__ as entry
from kinolith.operators import orphans

REF = orphans.Reference("messages", "video_id", "videos", "id", "created")
JAN, MAR = 1_704_067_200.0, 1_709_251_200.0
CHILD, PARENT = "id string, video_id string, created double", "id string, created double"


def test_month_of_an_orphan_does_not_depend_on_the_filter(spark, monkeypatch):
    child = spark.createDataFrame(
        [("a", None, JAN), ("a", "gone", MAR), ("b", "here", JAN), ("b", "gone", MAR), ("c", "gone", None)], CHILD
    )
    parent = spark.createDataFrame([("here", JAN)], PARENT)
    months = {}
    for verdict in ("filter", "pass all"):
        if verdict == "pass all":
            monkeypatch.setattr(orphans, "might_contain", lambda spark, sieve, column: orphans.F.lit(True))
        found = orphans.orphan_counts(orphans.resolve(child, parent, REF))
        months[verdict] = sorted((r.month or "", r.n_refs, r.n_orphans) for r in found.collect())
    assert months["filter"] == [("", 1, 1), ("2024-01", 3, 2)]
    assert months["pass all"] == months["filter"]


def test_each_row_without_an_id_is_a_reference(spark):
    child = spark.createDataFrame(
        [(None, "gone", JAN), (None, "gone", JAN), (None, "gone", MAR), (None, "here", MAR), (None, None, JAN), ("a", "gone", JAN), ("a", "gone", JAN)],
        CHILD,
    )
    parent = spark.createDataFrame([("here", JAN)], PARENT)
    resolved = orphans.resolve(child, parent, REF)
    found = sorted((r.month, r.n_refs, r.n_orphans) for r in orphans.orphan_counts(resolved).collect())
    assert found == [("2024-01", 3, 3), ("2024-03", 2, 1)]
    assert sorted(str(r.record_id) for r in resolved.where("is_orphan").collect()) == ["None", "None", "None", "a"]


@pytest.mark.parametrize("name", ["p1_found", "p1_orphans_by_month"])
def test_given_tables_agree_with_the_sql_twin(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("messages", "videos", "chats", "video_files"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    twin = sorted(map(str, con.execute(entry.oracle_sql()[name]).fetchall()))
    assert sorted(str(tuple(r)) for r in entry.queries()[name](spark, sf).collect()) == twin


def test_filter_stays_out_of_the_plan_and_rejects_absent_keys(spark):
    parent = spark.range(200_000).select(orphans.F.concat(orphans.F.lit("k"), "id").alias("id"), orphans.F.lit(JAN).alias("created"))
    ids = spark.range(190_000, 290_000).select(orphans.F.col("id").cast("string").alias("id"), orphans.F.concat(orphans.F.lit("k"), "id").alias("video_id"))
    resolved = orphans.resolve(ids.withColumn("created", orphans.F.lit(MAR)), parent, REF)
    assert len(resolved._jdf.queryExecution().toString()) < 200_000
    assert resolved.where("is_orphan").count() == 90_000
    met = orphans.with_block(ids, "video_id", 200_000).join(orphans.sieve_table(parent, "id", 200_000), "block", "left")
    passed = met.where(orphans.might_contain(spark, "sieve", "video_id")).count()
    assert 10_000 <= passed < 10_000 + 0.05 * 90_000
