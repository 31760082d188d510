"""Quality rules of documents and of their hosts.

Every text gets its word, symbol, line and repetition counts and a base rule
over them. The method then judges hosts (column ``source``): the share of a
host's documents that fail the base rule is shrunk towards a beta prior that
is fitted by moments to the shares of all hosts, so that a host of few
documents is not judged on them alone. A host whose shrunk share exceeds
``MAX_HOST_FAILURE`` is rejected with all its documents.

All counts come from array functions on the row itself, so the texts are never
shuffled; hosts are pre-aggregated in each task. The verdict table has a row
per rejected host and is joined back by host: broadcast while it is small, so
that a host with a third of all documents stays spread over all tasks; beyond,
by a shuffle whose skewed partitions Spark splits.

Repeated three-word windows are found by sorting the window hashes of the
text: up to ``PACKED_WORDS`` words a window is one bigint (upper bits of its
hash, lower bits its position), beyond it a (64-bit hash, position) pair.

Defined results: a null text has no words and fails the base rule; a null
host has no host verdict; a null or repeated doc_id and repeated rows are
judged like any other row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import SPACES, col, text_or_empty
from shortlist.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_FAILURE = 0.5
SYMBOLS = "#*$%&|<>"
PACKED_WORDS = 1 << 15
#: Rejected hosts (about 50 bytes each) up to which they are broadcast.
BROADCAST_HOSTS = 500_000


def _repeat_positions(keyed: Column, same, position) -> Column:
    """Sorted positions of the windows whose key equals a neighbour's in the
    sorted array ``keyed``."""
    tail = F.slice(keyed, F.lit(2), F.greatest(F.size(keyed) - 1, F.lit(0)))
    left = F.zip_with(keyed, tail, lambda a, b: F.when(same(a, b), position(a)))
    right = F.zip_with(keyed, tail, lambda a, b: F.when(same(a, b), position(b)))
    return F.sort_array(F.array_compact(F.array_union(left, right)))


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  source: str = "source") -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed of every row."""
    body = docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), text_or_empty(text).alias("t"))
    split = body.select(
        "doc_id", "source", F.length(F.translate("t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.when(F.btrim(F.col("t"), F.lit(SPACES)) != "",
               F.split(F.btrim(F.col("t"), F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
        .otherwise(F.array().cast("array<string>")).alias("words"))
    counted = split.select(
        "doc_id", "source", "word_chars", "n_symbols", "words", F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.ceil(F.log2(F.size("words") + 1)).cast("int").alias("bits"))
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))

    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))

    def packed(w: Column, i: Column) -> Column:
        return F.call_function("shiftleft", F.call_function("shiftright", window(w, i), F.col("bits")),
                               F.col("bits")).bitwiseOR(i.cast("bigint"))

    few = F.col("n_words") <= PACKED_WORDS
    keyed = counted.select(
        "doc_id", "source", "word_chars", "n_symbols", "n_words", "n_dup_lines", "bits",
        F.when(few, F.sort_array(F.transform(starts, packed))).alias("packed"),
        F.when(~few, F.sort_array(F.transform(starts, lambda w, i: F.struct(window(w, i).alias("h"),
                                                                            i.cast("bigint").alias("i")))))
        .alias("pairs"))
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1)
    marked = keyed.select(
        "doc_id", "source", "word_chars", "n_symbols", "n_words", "n_dup_lines",
        F.when(F.col("packed").isNotNull(),
               _repeat_positions(F.col("packed"), lambda a, b: high(a) == high(b), low))
        .otherwise(_repeat_positions(F.col("pairs"), lambda a, b: a["h"] == b["h"], lambda a: a["i"]))
        .alias("at"))
    # A repeated window covers three words; the next one may begin inside it.
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")),
                      lambda a, b: F.coalesce(F.least(b - a, F.lit(3).cast("bigint")), F.lit(3).cast("bigint")))
    done = marked.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_repeat_words"))
    return done.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(features: DataFrame, max_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """source, n_docs, n_failed, shrunk_rate, host_rejected for every host
    that is not null. The prior's mean and weight come from the mean and the
    variance of the hosts' failure shares, each host counting once; without
    variance between hosts the prior has no weight."""
    hosts = features.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(share).alias("m"), F.var_pop(share).alias("v"))
    m, v = F.col("m"), F.col("v")
    weight = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0))).otherwise(F.lit(0.0))
    alpha = prior.select((m * weight).alias("a")).scalar()
    total = prior.select(weight.alias("w")).scalar()
    rate = (F.col("n_failed") + alpha) / (F.col("n_docs") + total)
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_rejected", F.col("shrunk_rate") > max_failure)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                  max_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """One row per document: its features, base_failed, host_rejected and
    kept (neither failed)."""
    features = cut_lineage(text_features(docs, doc_id, text, source))
    bad = cut_lineage(host_verdicts(features, max_failure).filter("host_rejected").select("source", "host_rejected"))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad
    judged = features.join(bad, "source", "left").withColumn(
        "host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_rejected")
