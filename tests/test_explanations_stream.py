"""T12/T15 on streams: replies in time, late, missing, several, and after the
watermark; a restart."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from shortlist.operators.replies import final_explanations
from shortlist.session import checkpoint_dir
from shortlist.streaming.explanations_stream import (ASKED, REPLIES, beat, explain_to_completion, explained,
                                                     start_explanation_stream, timely_replies)

T0 = dt.datetime(2026, 1, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def asked(spark, rows):
    return spark.createDataFrame([(i, at(s), n) for i, s, n in rows], ASKED)


def replies(spark, rows):
    return spark.createDataFrame([(i, t, text, at(s)) for i, t, text, s in rows], REPLIES)


REQUESTS = [(1, 0, 2), (2, 1, 2), (3, 2, 1), (4, 3, 3), (5, 4, 1), (6, 5, 0)]
ANSWERS = [(1, 1, '["a", "b"]', 12), (2, 1, '["late"]', 14), (4, 2, '["second"]', 5), (4, 1, '["first", "x"]', 9),
           (5, 1, "no list", 4), (99, 1, '["nobody asked"]', 3), (3, 1, '["before"]', 1)]


def rows(df):
    return sorted(tuple(r) for r in df.select("request_id", "rank", "has_reply", "why_llm").collect())


def expected(spark):
    """The batch job on the replies that came in time."""
    items = asked(spark, REQUESTS).filter("n_items > 0").select("request_id", F.explode(
        F.sequence(F.lit(1), "n_items")).alias("rank"))
    good = replies(spark, [ANSWERS[0], ANSWERS[2], ANSWERS[3], ANSWERS[4]])
    out = final_explanations(items, good)
    return rows(out.withColumn("has_reply", F.col("reply").isNotNull()))


def test_replies_in_time_count_and_others_fall_back(spark):
    out = explain_to_completion(spark, asked(spark, REQUESTS), replies(spark, ANSWERS))
    assert rows(out) == expected(spark) and len(rows(out)) == 9
    assert {r[0] for r in rows(out) if not r[2]} == {2, 3}


def test_tables_give_the_same_as_streams(spark):
    out = explained(timely_replies(asked(spark, REQUESTS), replies(spark, ANSWERS)))
    assert rows(out) == expected(spark)


def test_what_comes_after_the_watermark_changes_nothing(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/test-explain-{uuid.uuid4().hex}"
    a, r, sink, ckpt = (f"{base}/{x}" for x in ("asked", "replies", "out", "ckpt"))

    def run(seconds):
        beat(spark, a, r, F.lit(at(seconds)))
        query = start_explanation_stream(spark, a, r, sink, ckpt)
        query.awaitTermination()
        assert query.exception() is None

    asked(spark, [(1, 0, 1), (2, 0, 1)]).write.parquet(a)
    replies(spark, [(1, 1, '["quick"]', 3)]).write.parquet(r)
    run(100)
    # by its time stamp this reply is early enough, but the request has been given up
    replies(spark, [(2, 1, '["lost on the way"]', 5)]).write.mode("append").parquet(r)
    asked(spark, [(3, 120, 1)]).write.mode("append").parquet(a)
    replies(spark, [(3, 1, '["new"]', 121)]).write.mode("append").parquet(r)
    run(300)
    run(500)
    out = {x["request_id"]: x for x in spark.read.parquet(sink).collect()}
    assert sorted(out) == [1, 2, 3] and [out[i]["has_reply"] for i in (1, 2, 3)] == [True, False, True]
    assert out[1]["why_llm"].startswith("quick") and out[3]["why_llm"].startswith("new")


def test_nothing_asked_gives_no_rows(spark):
    assert explain_to_completion(spark, asked(spark, []), replies(spark, ANSWERS)).count() == 0
