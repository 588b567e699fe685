"""The token and container queries over whole tables."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from kinolith.llm import bpe

SF = "/root/testdata/sf0.001"
PUBLIC = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="session")
def public():
    return Tokenizer.from_file(PUBLIC)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_document_has_the_ids_of_the_public_tokenizer(spark, public):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    found = entry.queries()["p6_ids"](spark, SF)
    assert found.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == public.encode(text, add_special_tokens=False).ids


def test_every_text_comes_out_whole_in_each_pack(spark, public):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    packs = {r.pack_name: r.capacity for r in spark.read.parquet(f"{SF}/pack_sizes.parquet").collect()}
    parts, room = defaultdict(list), defaultdict(int)
    for r in entry.queries()["p7_containers"](spark, SF).collect():
        parts[r.pack_name, r.doc_id].append((r.part_no, r.n_parts, r.text))
        room[r.pack_name, r.container_id] += r.n_tokens
    assert set(parts) == {(p, d) for p in packs for d in texts}
    for (pack, doc), held in parts.items():
        held.sort()
        assert [h[0] for h in held] == list(range(held[0][1]))
        assert "".join(h[2] or "" for h in held) == (texts[doc] or "")
        if len(held) > 1:
            assert len(public.encode(texts[doc], add_special_tokens=False).ids) > packs[pack]
    for (pack, _), n in room.items():
        assert n <= packs[pack]


def test_fill_report_covers_all_tokens(spark, public):
    texts = [r.text or "" for r in documents(spark).collect()]
    total = sum(len(public.encode(t, add_special_tokens=False).ids) for t in texts)
    rows = entry.queries()["p7_fill"](spark, SF).collect()
    assert len(rows) == 3
    assert all(r.n_tokens == total and 0 < r.fill <= 1 for r in rows)
    report = entry.queries()["p6_token_report"](spark, SF)
    assert report.agg(F.sum("n_tokens"), F.sum("n_docs")).first()[:] == (total, len(texts))


def test_special_strings_odd_texts_and_long_pieces(spark):
    own = Tokenizer.from_file(PUBLIC)
    own.encode_special_tokens = True
    texts = ["<|endoftext|> a", "", " ", "\n\n  x", "棒人間が踊る 🎬👍🏽", "e\u0301 ＠ \u200b", "a" * 50_000, "ab" * 20_000 + " 12345678901234567890"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (99, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in bpe.token_ids(df).collect())
    want = sorted((i if i is not None else -1, own.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert found == want
    assert bpe.token_ids(df.where("doc_id < 0")).collect() == []
