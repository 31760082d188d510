"""T12/T15 while replies arrive: explanations of a stream of asked requests.

Asked requests (how many items each has) and model replies are two streams
with event times. A reply counts if it comes within the time limit; the two
meet in a stream-stream left outer join on the request and that interval, so
state is kept for no longer than the limit and the watermark's delay. Of
several replies in time the first turn counts, as in the batch job. A request
is answered once the watermark has passed its limit: with its reply aligned to
the ranks, or, where none came in time, with the fallback text. Whatever comes
later changes nothing.

The sink is Spark's own file sink: each epoch is committed once, a restart goes
on from the checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions import text as T
from shortlist.operators.replies import parse_reply
from shortlist.schemas import GENERIC_REPLY, REPLY_LIMIT_SECONDS
from shortlist.session import checkpoint_dir

c = F.col

#: The request id of rows that only carry the time.
BEAT = -(1 << 62)
ASKED = "request_id bigint, asked_at timestamp, n_items int"
REPLIES = "request_id bigint, turn bigint, reply_text string, replied_at timestamp"


def timely_replies(asked: DataFrame, replies: DataFrame, limit_seconds: int = REPLY_LIMIT_SECONDS,
                   delay: str = "0 seconds") -> DataFrame:
    """request_id, asked_at, n_items and items: those of the first turn that
    came within the limit, null where none did. Two streams or two tables."""
    items = replies.select(c("request_id").alias("reply_to"), "turn", "replied_at",
                           parse_reply(c("reply_text"))["items"].alias("items")).withWatermark("replied_at", delay)
    first = asked.withWatermark("asked_at", delay)
    within = ((c("request_id") == c("reply_to")) & (c("replied_at") >= c("asked_at"))
              & (c("replied_at") <= c("asked_at") + F.expr(f"INTERVAL {int(limit_seconds)} SECONDS")))
    met = first.join(items, within, "left_outer")
    return met.groupBy("request_id", "asked_at").agg(F.max("n_items").alias("n_items"),
                                                     F.min_by("items", "turn").alias("items"))


def explained(answered: DataFrame) -> DataFrame:
    """One row per rank: request_id, rank, has_reply and ``why_llm``."""
    ranks = F.when(c("n_items") > 0, F.sequence(F.lit(1), c("n_items")))
    each = answered.select("request_id", "items", F.explode(ranks).alias("rank"))
    reply = F.when(c("items").isNotNull(), F.coalesce(F.try_element_at(c("items"), c("rank")), F.lit(GENERIC_REPLY)))
    return each.select("request_id", "rank", reply.isNotNull().alias("has_reply"),
                       T.explanation_with_fallback(reply, c("rank")).alias("why_llm"))


def start_explanation_stream(spark: SparkSession, asked_dir: str, replies_dir: str, sink_dir: str, checkpoint: str,
                             limit_seconds: int = REPLY_LIMIT_SECONDS, delay: str = "0 seconds",
                             available_now: bool = True):
    """Starts the job on folders of Parquet files; returns the query."""
    asked = spark.readStream.schema(ASKED).parquet(asked_dir)
    replies = spark.readStream.schema(REPLIES).parquet(replies_dir)
    out = explained(timely_replies(asked, replies, limit_seconds, delay))
    writer = out.writeStream.format("parquet").outputMode("append").option("path", sink_dir).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def beat(spark: SparkSession, asked_dir: str, replies_dir: str, at) -> None:
    """Moves both streams' event time on to ``at`` (a timestamp column), so that
    a quiet hour, or the end of a run, leaves no request unanswered. It takes a
    row of each that nobody asked for: one without an id would be filtered
    before the watermark sees it."""
    one = spark.range(1).select(F.lit(BEAT).alias("beat"))
    one.select(c("beat").cast("bigint").alias("request_id"), at.alias("asked_at"),
               F.lit(0).alias("n_items")).write.mode("append").parquet(asked_dir)
    one.select(c("beat").cast("bigint").alias("request_id"), F.lit(0).cast("bigint").alias("turn"),
               F.lit(None).cast("string").alias("reply_text"), at.alias("replied_at")).write.mode("append").parquet(
        replies_dir)


def explain_to_completion(spark: SparkSession, asked: DataFrame, replies: DataFrame,
                          limit_seconds: int = REPLY_LIMIT_SECONDS) -> DataFrame:
    """Lands both tables as files in the shared checkpoint folder, moves the
    time past the last limit, streams all and returns the sink."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/explanations-{uuid.uuid4().hex}"
    asked_dir, replies_dir, sink = f"{base}/asked", f"{base}/replies", f"{base}/explained"
    asked.select("request_id", "asked_at", "n_items").write.parquet(asked_dir)
    replies.select("request_id", "turn", "reply_text", "replied_at").write.parquet(replies_dir)
    last = F.coalesce(F.lit(asked.agg(F.max("asked_at")).first()[0]).cast("timestamp"), F.current_timestamp())
    for beats in (1, 2):  # the join lets the unanswered go at the first, the aggregation hands them out at the second
        beat(spark, asked_dir, replies_dir, last + F.expr(f"INTERVAL {beats * (2 * int(limit_seconds) + 60)} SECONDS"))
        query = start_explanation_stream(spark, asked_dir, replies_dir, sink, f"{base}/checkpoint", limit_seconds)
        query.awaitTermination()
        if query.exception() is not None:
            raise RuntimeError(f"explanation stream failed: {query.exception()}")
    return spark.read.schema("request_id bigint, rank int, has_reply boolean, why_llm string").parquet(sink)
