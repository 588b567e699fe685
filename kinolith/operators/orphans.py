"""References to records that do not exist.

A Bloom filter of the parent keys is kept as a table of 64-bit blocks, as many as the keys need; no
part of it passes the driver. A reference meets its block by a join; one that the block rejects is
a definite orphan and never shuffled again. Only the references it lets pass are verified by an
exact join with the parents, which also tells parents that are removed or younger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinolith.functions.clean import epoch_micros, key_of, month_of
from kinolith.operators.skew import lookup_join
from kinolith.session import through_table
from kinolith.sources.tables import table

#: Bits of the filter a parent key, and those of them that a key sets in its block.
BITS_PER_KEY = 12
BITS_SET = 4


@dataclass(frozen=True)
class Reference:
    """A referring column and the column it refers to."""

    child: str
    column: str
    parent: str
    parent_key: str
    parent_time: str
    child_id: str = "id"
    child_time: str = "created"
    parent_removed: str | None = None
    folders: bool = False

    @property
    def field(self) -> str:
        return f"{self.child}.{self.column}"


REFERENCES = (
    Reference("messages", "video_id", "videos", "id", "created"),
    Reference("videos", "chat_id", "chats", "id", "created"),
    Reference("videos", "file", "video_files", "file_name", "written", parent_removed="removed", folders=True),
)


def with_block(df: DataFrame, column: str, items: int) -> DataFrame:
    """``df`` with the ``block`` of each key in a filter for ``items`` keys."""
    blocks = max(1, items * BITS_PER_KEY // 64)
    return df.withColumn("block", F.pmod(F.xxhash64(column), F.lit(blocks)))


def key_bits(column: str) -> Column:
    """The bits that a key sets in its block."""
    mask = F.lit(0).cast("bigint")
    for i in range(BITS_SET):
        place = F.shiftrightunsigned(F.hash(column), 6 * i).bitwiseAND(63)
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def sieve_table(keys: DataFrame, column: str, items: int) -> DataFrame:
    """Bloom filter over ``column``: the ``block`` and its bits (``sieve``), blocks without a key left out."""
    return with_block(keys, column, items).groupBy("block").agg(F.bit_or(key_bits(column)).alias("sieve"))


def might_contain(spark: SparkSession, sieve: str, column: str) -> Column:
    """Whether the block in the column ``sieve`` lets ``column`` pass."""
    return F.coalesce(F.col(sieve).bitwiseAND(key_bits(column)) == key_bits(column), F.lit(False))


def resolve_many(parts: list[tuple[DataFrame, DataFrame, Reference]]) -> DataFrame:
    """All references of several columns with ``is_orphan`` and ``reason``, by one filter and one join.

    ``parts``: child, parent and reference of each column.
    Columns: ref_field, record_id, ref_key, t (earliest time of the record, microseconds or
    null), is_orphan, reason (missing, removed, younger or null).

    Null, blank and "nothing" keys are no references. Repeated rows of a record count once, at
    their earliest time; a record with several keys yields one row per key. Rows without an id
    can't be told to be repeated, so each is a reference of its own, at its own time. Null times
    never make a target younger. Empty tables give no rows (no child) or missing targets only (no
    parent).
    """
    spark = parts[0][0].sparkSession
    rows = targets = None
    n_parents = 0
    # one letter a reference column goes before its keys, so that all of them share a filter and a join
    codes = {chr(ord("a") + i): ref.field for i, (_, _, ref) in enumerate(parts)}
    for code, (child, parent, ref) in zip(codes, parts):
        made = child.select(
            F.lit(code).alias("code"),
            F.col(ref.child_id).cast("string").alias("record_id"),
            F.concat(F.lit(code), key_of(F.col(ref.column), ref.folders)).alias("key"),
            epoch_micros(F.col(ref.child_time)).alias("t"),
        )
        removed = F.col(ref.parent_removed).isNotNull() if ref.parent_removed else F.lit(False)
        known = parent.select(
            F.concat(F.lit(code), key_of(F.col(ref.parent_key), ref.folders)).alias("key"),
            epoch_micros(F.col(ref.parent_time)).alias("target_t"),
            removed.alias("removed"),
        )
        rows = made if rows is None else rows.unionByName(made)
        targets = known if targets is None else targets.unionByName(known)
        n_parents += parent.count()
    # the earliest time of a record may stand on a row that holds another key or none
    records = rows.where("record_id is not null").groupBy("code", "record_id").agg(F.min("t").alias("t"), F.collect_set("key").alias("keys"))
    pairs = records.select("record_id", F.explode("keys").alias("key"), "t")
    pairs = pairs.unionByName(rows.where("record_id is null and key is not null").select("record_id", "key", "t"))
    # read by the search for hot blocks and by the probe
    pairs = through_table(with_block(pairs, "key", n_parents), "references")
    targets = targets.where("key is not null")

    met = lookup_join(pairs, sieve_table(targets, "key", n_parents), "block")
    # read by the search for hot keys and by both branches behind the filter
    probed = through_table(met.select("record_id", "key", "t", might_contain(spark, "sieve", "key").alias("maybe")), "probed")
    definite = probed.where(~F.col("maybe")).select("record_id", "key", "t", F.lit("missing").alias("reason"))

    known = targets.groupBy("key").agg(F.min("target_t").alias("target_t"), F.max("removed").alias("removed"))
    checked = lookup_join(probed.where("maybe").select("record_id", "key", "t"), known, "key")
    reason = (
        F.when(F.col("removed").isNull(), "missing")
        .when(F.col("removed"), "removed")
        .when(F.col("target_t") > F.col("t"), "younger")
    )
    found = definite.unionByName(checked.select("record_id", "key", "t", reason.alias("reason")))
    field = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.substring("key", 1, 1)]
    return found.select(
        field.alias("ref_field"), "record_id", F.expr("substring(key, 2)").alias("ref_key"), "t", "reason", F.col("reason").isNotNull().alias("is_orphan")
    )


def resolve(child: DataFrame, parent: DataFrame, ref: Reference) -> DataFrame:
    """``resolve_many`` of one column."""
    return resolve_many([(child, parent, ref)])


def resolve_all(spark: SparkSession, folder: str) -> DataFrame:
    """``resolve_many`` over the three reference columns of the project."""
    parts = []
    for ref in REFERENCES:
        child = table(spark, folder, ref.child, ref.child_id, ref.column, ref.child_time)
        columns = [ref.parent_key, ref.parent_time] + ([ref.parent_removed] if ref.parent_removed else [])
        parts.append((child, table(spark, folder, ref.parent, *columns), ref))
    return resolve_many(parts)


def orphan_counts(resolved: DataFrame) -> DataFrame:
    """References and orphans per field and month of the referring record."""
    return resolved.groupBy("ref_field", month_of(F.col("t")).alias("month")).agg(
        F.count("*").alias("n_refs"),
        F.count_if("is_orphan").alias("n_orphans"),
        F.count_if(F.col("reason") == "missing").alias("n_missing"),
        F.count_if(F.col("reason") == "removed").alias("n_removed"),
        F.count_if(F.col("reason") == "younger").alias("n_younger"),
    )
