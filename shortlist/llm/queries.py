"""Registered queries of this subpackage: name -> (builder, DuckDB SQL or
None). Each applies an operator to its whole table with its production
parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm import (exact_dedup, minhash_dedup, mixing, packing, periodic_runs, pii, quality_rules,
                           secret_scan, sql, suffix_dedup, token_counts, toxicity, warc, whitening)
from shortlist.session import checkpoint_dir
from shortlist.sources.tables import read_table

#: Numbers the runs of a session, so that each has a folder of its own.
_RUNS = count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != "literal")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        count("literal"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(documents(spark, sf_dir))

    def count(*kinds: str) -> Column:
        return F.size(F.filter("__entities", lambda k: k.isin(*kinds))).cast("bigint")

    return done.select(
        "doc_id", "text", *[count(*({"ip": ("ip", "ip6")}.get(k, (k,)))).alias(f"n_{k}")
                            for k in ("email", "phone", "card", "ip", "ssn", "iban")],
        count("surname").alias("n_person"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "explained",
                        "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.get("explained", F.col("at")).alias("explained"), "identity_error")


def looped_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The sequence in which a text's n words are read: in a tenth of the
    documents, chosen by their id, the tail goes round in a loop. A null id
    has none."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return None
    a, at = g % n, np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(documents(spark, sf_dir), order=looped_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    start, period = -longest["start"], -longest["period"]
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"),
        longest["length"].alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * longest["length"] / period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{checkpoint_dir(spark).rstrip('/')}/warc-{spark.sparkContext.applicationId}-{next(_RUNS)}"
    return warc.round_trip(read_table(spark, sf_dir, "pages"), out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_secret_scan": (op1_secret_scan, None),
    "op2_exact_dedup": (op2_exact_dedup, sql.EXACT_DEDUP),
    "op3_quality_rules": (op3_quality_rules, sql.QUALITY_RULES),
    "op4_minhash_dedup": (op4_minhash_dedup, sql.MINHASH_DEDUP),
    "op5_toxicity": (op5_toxicity, None),
    "op6_pii": (op6_pii, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_mixing": (op8_mixing, None),
    "op9_packing": (op9_packing, None),
    "op10_suffix_dedup": (op10_suffix_dedup, sql.SUFFIX_DEDUP),
    "op11_whitening": (op11_whitening, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_warc": (op13_warc, sql.WARC),
}
