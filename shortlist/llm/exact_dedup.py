"""Exact de-duplication with a two-pass Bloom filter.

Two texts are equal when they are identical after deleting white space. Pass
one sets ``HASHES`` bits for each text hash in a blocked bit table (one block
of 32,768 bits holds all bits of a hash) and keeps the bits that were set
twice or more; pass two tests every row against those bits. Only rows that
have all their bits there can have an equal text: they alone are shuffled by
their hash. All other rows pass straight through.

The bit table takes ``BITS_PER_ROW`` bits a row, so it grows with the input.
It is broadcast while its computed size is at most ``BROADCAST_BYTES``;
beyond, the probe is an equi-join on the block number, in which only hashes
travel. Rows are the same either way.

Defined results: a null text counts as empty, and empty texts are equal to
each other. Of equal texts the row with most code points stays, then the
smallest doc_id (null ids last), then the row that comes first. Repeated rows
are separate members of their group, of which one stays. An empty table gives
an empty result. Extra columns pass through unchanged whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import SPACES, col, join_groups, text_or_empty, unpack, whole_row
from shortlist.session import cut_lineage

HASHES = 3
BITS_PER_ROW = 16
#: Bits of one bitmap that bitmap_construct_agg builds.
BLOCK_BITS = 32768
BROADCAST_BYTES = 64 << 20


def text_hash(text: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text without white space, in UTF-8."""
    return F.sha2(F.translate(text_or_empty(text), SPACES, ""), 256)


def n_blocks(rows: int) -> int:
    return max(1, math.ceil(rows * BITS_PER_ROW / BLOCK_BITS))


def _block(h: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(blocks))


def _bits(h: str) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(1, HASHES + 1)]


def repeated_bits(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """Pass one: (block, bitmap of the bits that two or more rows set)."""
    bits = hashes.select(_block(h, blocks).alias("block"), F.explode(F.array(*_bits(h))).alias("bit"))
    twice = bits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bitmap"))


def mark_repeated(df: DataFrame, h: str, table: DataFrame, blocks: int) -> DataFrame:
    """Pass two: df with the boolean column ``__maybe``, true for rows whose
    hash may occur twice (always true if it does)."""
    if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    table = table.select(F.col("block").alias("__block"), F.col("bitmap").alias("__bitmap"))

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
        return F.getbit(byte.cast("bigint"), bit % 8) == 1

    hit = F.lit(True)
    for bit in _bits(h):
        hit = hit & is_set(bit)
    joined = df.withColumn("__block", _block(h, blocks)).join(table, "__block", "left")
    return joined.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__block", "__bitmap")


def _order(doc_id: Column, n_chars: Column, *last: Column) -> Column:
    """Smallest for the row that stays."""
    return F.struct(-n_chars, doc_id.isNull(), doc_id, *last)


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    skeleton = cut_lineage(docs.select(
        col(doc_id).alias("doc_id"), text_hash(text).alias("text_sha256"),
        F.length(text_or_empty(text)).cast("bigint").alias("n_chars"),
        F.monotonically_increasing_id().alias("row")))
    blocks = n_blocks(skeleton.count())
    marked = mark_repeated(skeleton, "text_sha256", repeated_bits(skeleton, "text_sha256", blocks), blocks)
    straight = marked.filter(~F.col("__maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    shuffled = marked.filter("__maybe")
    best = shuffled.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(_order(F.col("doc_id"), F.col("n_chars"), F.col("row"))).alias("best"))
    best = cut_lineage(best.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"),
                                   F.col("best.row").alias("keep_row")))
    rest = join_groups(shuffled, best, "text_sha256", "group_size").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return straight.unionByName(rest)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows that cannot have
    an equal are not shuffled; of the others each task sends one row a group."""
    hashed = docs.select(whole_row(docs), text_hash(text).alias("__hash"))
    hashes = cut_lineage(hashed.select("__hash"))
    blocks = n_blocks(hashes.count())
    marked = mark_repeated(hashed, "__hash", repeated_bits(hashes, "__hash", blocks), blocks)
    row = F.col("__row")
    order = _order(row.getField(doc_id), F.length(F.coalesce(row.getField(text), F.lit(""))), row)
    once = marked.filter("__maybe").groupBy("__hash").agg(F.min_by(row, order).alias("__row"))
    kept = marked.filter(~F.col("__maybe")).select("__row").unionByName(once.select("__row"))
    return unpack(kept, docs.columns)
