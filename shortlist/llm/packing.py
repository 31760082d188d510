"""Conflict-constrained best-fit packing of documents into bins of
``CAPACITY`` words.

A document longer than a bin is cut into pieces of the bin's size and a rest.
Pieces are dealt to shards of about ``SHARD_PIECES`` by a seeded hash and
packed there, largest first. The bins of a shard stand in the order of their
free room; each carries a bitmap of the duplicate clusters and ``MAX_PER_SOURCE``
bitmaps of the sources (bit set in the k-th: k pieces of that source) that it
holds. The successor search starts at the tightest bin that has room and goes
on until a compatible one is found: no piece of the same cluster, fewer than
``MAX_PER_SOURCE`` of the same source. Without one a new bin is opened.

Texts are not moved: only (id, size, cluster hash, source hash) are. A shard
is bounded by its number of pieces, so hot sources and large clusters are
spread over all shards and fill bins there side by side.

Defined results: a document without words (or with a null text) has one row
with no bin; a null source is a source of its own; repeated rows and equal
texts share a cluster, so they never share a bin; ties in size are packed in a
seeded order; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import col, text_or_empty, word_count
from shortlist.llm.exact_dedup import text_hash
from shortlist.session import cut_lineage

CAPACITY = 2048
MAX_PER_SOURCE = 2
SHARD_PIECES = 8192
SEED = 9
#: Bin numbers: the shard's number times this, plus the place in the shard.
BIN_STEP = 1 << 32


class Bins:
    """The open bins of a shard in the order of their free room."""

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity = capacity
        self.room: list[tuple[int, int]] = []  # (free words, bin), sorted
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.levels = max_per_source

    def place(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """(bin, offset) of a piece. ``cluster`` and ``source`` are one-bit
        numbers; 0 conflicts with nothing."""
        at = bisect_left(self.room, (size, -1))
        while at < len(self.room):
            free, b = self.room[at]
            if not self.clusters[b] & cluster and not self.sources[b][-1] & source:
                break
            at += 1
        if at < len(self.room):
            self.room.pop(at)
        else:
            free, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.levels)
        self.clusters[b] |= cluster
        for level, held in enumerate(self.sources[b]):
            if not held & source:
                self.sources[b][level] |= source
                break
        if free > size:
            insort(self.room, (free - size, b))
        return b, self.capacity - free


def one_bit(values: list, least: int) -> list[int]:
    """A bit for each value that occurs more than ``least`` times; 0 for
    others, which cannot be in conflict."""
    number = {v: i for i, v in enumerate(v for v, n in Counter(values).items() if n > least)}
    return [1 << number[v] if v in number else 0 for v in values]


def pack_shard(sizes: list[int], clusters: list, sources: list, capacity: int,
               max_per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order."""
    bins = Bins(capacity, max_per_source)
    return [bins.place(*p) for p in zip(sizes, one_bit(clusters, 1), one_bit(sources, max_per_source))]


def pieces(docs: DataFrame, doc_id: str, text: str, source: str, capacity: int, cluster: Column | None,
           size: Column | None) -> DataFrame:
    """doc_id, piece, first_word, size, cluster, source of every piece."""
    body = docs.select(
        col(doc_id).alias("doc_id"), (word_count(text_or_empty(text)) if size is None else size).alias("words"),
        (F.xxhash64(text_hash(text)) if cluster is None else cluster).alias("cluster"),
        F.xxhash64(col(source)).alias("source"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1)).cast("int") - 1
    cut = body.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece").cast("bigint") * capacity
    return cut.withColumn("first_word", first).withColumn(
        "size", F.least(F.col("words") - first, F.lit(capacity)).cast("bigint"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, cluster: Column | None = None,
         size: Column | None = None, seed: int = SEED) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, size, bin, position (of
    its first word in the bin). ``size`` defaults to the number of words,
    ``cluster`` to the hash of the text without white space."""
    cut = cut_lineage(pieces(docs, doc_id, text, source, capacity, cluster, size))
    shards = max(1, math.ceil(cut.count() / SHARD_PIECES))
    dealt = cut.filter("size > 0").withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), "piece", "row"), F.lit(shards)))
    dealt = dealt.withColumn("tie", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), "piece"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "tie", "row"], ascending=[False, True, True])
        put = pack_shard(frame["size"].tolist(), frame["cluster"].tolist(), frame["source"].tolist(), capacity,
                         max_per_source)
        frame["bin"] = [int(s) * BIN_STEP + b for s, (b, _) in zip(frame["shard"], put)]
        frame["position"] = [p for _, p in put]
        return frame[["doc_id", "piece", "first_word", "size", "bin", "position"]]

    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, first_word bigint, size bigint, bin bigint, position bigint"
    packed = dealt.groupBy("shard").applyInPandas(fill, schema)
    empty = cut.filter("size <= 0").select(
        "doc_id", "piece", "first_word", "size", F.lit(None).cast("bigint").alias("bin"),
        F.lit(None).cast("bigint").alias("position"))
    return packed.unionByName(empty)
