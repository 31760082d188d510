"""ST1: a restarted stream resumes from its checkpoint (no epoch is
processed twice) and its output equals the batch shortlist."""

import uuid

from pyspark.sql import functions as F

from shortlist.plans.recommend import shortlist
from shortlist.session import checkpoint_dir
from shortlist.streaming.requests_stream import start_shortlist_stream


def _rows(df):
    cols = ["request_id", "rank", "catalog_pos", "adjusted_score"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_restart_is_idempotent(spark, tables):
    base = f"{checkpoint_dir(spark).rstrip('/')}/test-stream-{uuid.uuid4().hex}"
    src, sink, ckpt = f"{base}/requests", f"{base}/out", f"{base}/ckpt"
    reqs, cat, mk = tables.requests(), tables.catalog(), tables.market()
    reqs.filter(F.col("request_id") % 2 == 0).write.mode("append").parquet(src)
    start_shortlist_stream(spark, src, sink, ckpt, cat, mk).awaitTermination()
    first_epochs = sorted(r[0] for r in spark.read.parquet(sink).select("epoch").distinct().collect())
    start_shortlist_stream(spark, src, sink, ckpt, cat, mk).awaitTermination()   # restart: nothing new
    assert sorted(r[0] for r in spark.read.parquet(sink).select("epoch").distinct().collect()) == first_epochs
    reqs.filter(F.col("request_id") % 2 == 1).write.mode("append").parquet(src)   # new arrivals
    start_shortlist_stream(spark, src, sink, ckpt, cat, mk).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.select("epoch").distinct().count() > len(first_epochs)
    assert _rows(out) == _rows(shortlist(reqs, cat, mk))
