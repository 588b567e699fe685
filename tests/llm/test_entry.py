"""The driver contract with the llm folder in place."""

import __spark_entry__ as entry


def test_llm_queries_are_registered():
    names = set(entry.queries())
    assert {"p3_found", "p4_found", "p5_found", "p6_ids", "p7_containers", "p8_found"} <= names
    assert set(entry.oracle_sql()) <= names
