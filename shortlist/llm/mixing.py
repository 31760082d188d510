"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its weight's share of ``MIX_PERCENT`` % of all words, at
most ``MAX_REPEATS`` times its own size; the excess is shared out again. Each
source is cut into shards by a seeded hash of doc_id. The shards' targets are
the votes and blocks of ``BLOCK_WORDS`` words the seats: the highest quotients
votes / (2 * seats + 1) get them. In a shard, documents stand in a seeded
order as one stream of words; its quota takes the stream's blocks from the
front, from the start again when the stream is used up.

The quotients are never listed: seats = floor(votes / d + 1/2) for the divisor
d that gives the right total. Bounds of d follow from the totals and are
narrowed by aggregations that try ``PROBES`` divisors at once; only quotients
between the last two bounds are ranked.

Defined results: a null text has size 0 and is taken 0 times; a null source is
a source of its own, last in order; repeated rows are separate documents, in
the order in which they come; with no words at all every target is 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import col, text_or_empty, unpack, whole_row, word_count
from shortlist.session import cut_lineage

WEIGHTS = (5, 2, 1)
MIX_PERCENT = 150
MAX_REPEATS = 2
BLOCK_WORDS = 32
SHARD_DOCS = 4096
SEED = 20
PROBES = 32
#: Quotients between the bounds of the divisor that are ranked one by one.
RANKED = 10_000
#: Up to so many sources (about 10 MB) the table of sources is broadcast.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target of a frame (source, size). One row
    per source; the window that orders them sees no documents."""
    src = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    src = src.withColumn("w", F.element_at(weights, ((place - 1) % len(WEIGHTS)).cast("int") + 1))
    src = src.withColumn("cap", (MAX_REPEATS * F.col("source_size")).cast("double"))
    # In the order of cap / weight, the sources up to some place stop at their
    # cap and all others get the same number of words per unit of weight.
    ratio = F.col("cap") / F.col("w")
    upward = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    src = src.withColumn("left", F.sum("source_size").over(everything) * (MIX_PERCENT / 100)
                         - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    src = src.withColumn("left_w", F.sum("w").over(upward.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("level", F.col("left") / F.col("left_w"))
    src = src.withColumn("level", F.min(F.when(F.col("level") <= ratio, F.struct(ratio, F.col("level"))))
                         .over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("level"), F.col("cap")))
    return src.select("source", "n_docs", "source_size", target.alias("target"))


def apportion(units: DataFrame, keys: list[str], votes: str, seats: int) -> DataFrame:
    """``units`` (one row per ``keys``) with the column ``quota``: exactly
    ``seats`` seats, by highest quotients; ties by ``keys``."""
    v = F.col(votes)
    total, n, largest = units.agg(F.sum(v), F.count(F.lit(1)), F.max(v)).first()
    if not total or seats <= 0:
        return units.withColumn("quota", F.lit(0).cast("bigint"))

    def rounded(divisor: float):
        return F.floor(v / F.lit(divisor) + 0.5).cast("bigint")

    few, many = total / (seats + n / 2 + 1), 2 * largest + 1  # divisors giving too many and too few seats
    if seats > n / 2 + 1:
        many = min(many, total / (seats - n / 2 - 1))
    got = {}

    def seats_at(divisors: list[float]) -> None:
        row = units.agg(*[F.sum(rounded(d)).alias(f"d{i}") for i, d in enumerate(divisors)]).first()
        got.update(zip(divisors, row))

    seats_at([few, many])
    for _ in range(12):
        if got[few] - got[many] <= RANKED:
            break
        probes = [few + (many - few) * i / (PROBES + 1) for i in range(1, PROBES + 1)]
        probes = [p for p in probes if few < p < many]
        if not probes:
            break
        seats_at(probes)
        few = max(d for d in got if got[d] >= seats)
        many = min(d for d in got if got[d] <= seats and d > few) if got[few] > seats else few
    base = units.withColumn("quota", rounded(many))
    missing = seats - got[many]
    if missing <= 0:
        return base
    more = base.filter(rounded(few) > F.col("quota")).select(
        *keys, v.alias("__v"), F.explode(F.sequence(F.col("quota"), rounded(few) - 1)).alias("__j"))
    more = more.withColumn("__q", F.col("__v") / (2 * F.col("__j") + 1))
    won = more.orderBy(F.desc("__q"), *[F.col(k).asc_nulls_last() for k in keys], "__j").limit(int(missing))
    won = won.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__more"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return base.join(won, on, "left").select(
        *[F.col(c) for c in units.columns], (F.col("quota") + F.coalesce("__more", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        seed: int = SEED, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. With
    ``carry`` the whole input row comes along as struct ``__row``."""
    sized = docs.select(
        col(doc_id).alias("doc_id"), col(source).alias("source"), word_count(text_or_empty(text)).alias("size"),
        F.monotonically_increasing_id().alias("row"), *([whole_row(docs)] if carry else []))
    sized = cut_lineage(sized)
    targets = cut_lineage(source_targets(sized.select("source", "size")))
    n_sources, all_words = targets.agg(F.count(F.lit(1)), F.sum("target")).first()
    seats = round((all_words or 0) / BLOCK_WORDS)
    small = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    shards = F.ceil(F.col("n_docs") / SHARD_DOCS)
    dealt = sized.join(small.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id"), shards))
    units = cut_lineage(dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")))
    units = units.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("words")
                                             / F.col("source_size")).otherwise(F.lit(0.0)))
    quotas = apportion(units, ["source", "shard"], "votes", seats).select(
        F.col("source").alias("__s"), F.col("shard").alias("__n"), "words",
        F.least(F.col("quota") * BLOCK_WORDS, MAX_REPEATS * F.col("words")).alias("granted"))
    joined = dealt.join(quotas, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__n")))
    order = Window.partitionBy("source", "shard").orderBy(
        F.xxhash64(F.lit(seed), F.lit("order"), "doc_id"), "doc_id", "row")
    joined = joined.withColumn("end", F.sum("size").over(order))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("granted") / F.col("words"))).otherwise(F.lit(0))
    joined = joined.withColumn("rounds", rounds.cast("bigint"))
    part = F.greatest(F.lit(0), F.least(F.col("end"), F.col("granted") - F.col("rounds") * F.col("words"))
                      - (F.col("end") - F.col("size")))
    taken = (F.col("rounds") * F.col("size") + part).cast("bigint")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"),
                         *(["__row"] if carry else []))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as its taken words make
    whole documents, rounded; at most one document of a shard is cut by its
    quota, so rounding moves less than half a document a shard. Documents
    without words are left out, as the mix takes no words from them."""
    taken = mix(docs, doc_id, text, source, seed, carry=True)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    many = taken.filter((F.col("size") > 0) & (F.col("taken") > 0)).withColumn("copies", copies).filter("copies > 0")
    return unpack(many.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)
