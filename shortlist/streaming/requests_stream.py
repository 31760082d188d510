"""ST1: requests arriving as a stream, catalog and market static or stored.

``readStream`` of request files -> ``foreachBatch`` running the same
``shortlist`` plan as the batch job (a per-request ``row_number`` is not
allowed on a streaming frame, but it is on each micro-batch). Each epoch is
written to its own ``epoch=<id>`` folder with overwrite, so a retried epoch
replaces its own output: the sink is idempotent and the stream survives
executor loss and restarts from its checkpoint.

Catalog and market may be given as paths of stored tables that other jobs
replace (``write_catalog``). Each epoch then answers from the versions that are
current when it begins and notes them in ``<checkpoint>/tables`` before it
works, so that a retried epoch uses the same ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from shortlist import schemas as S
from shortlist.operators.enrich import market_from_enhanced
from shortlist.plans.recommend import rejected_requests, shortlist
from shortlist.session import checkpoint_dir
from shortlist.sources.snapshots import record_once, snapshot
from shortlist.sources.tables import read_catalog, read_enhanced_catalog


def epoch_versions(spark: SparkSession, checkpoint: str, epoch_id: int, paths: dict[str, str]) -> dict[str, int]:
    """The versions of the stored tables that an epoch uses: the newest ones,
    or those that its first attempt has noted."""
    newest = {}
    for name, path in paths.items():
        kept = snapshot(spark, path)
        if kept is None:
            raise ValueError(f"{path} is no stored table: write_catalog makes one")
        newest[name] = kept.version
    note = f"{checkpoint.rstrip('/')}/tables/{epoch_id}.json"
    return json.loads(record_once(spark, note, json.dumps(newest)))


def start_shortlist_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                           catalog: DataFrame | str, market: DataFrame | str | None, available_now: bool = True,
                           source_format: str = "parquet", max_files_per_trigger: int | None = None):
    """Start the streaming job; returns the ``StreamingQuery``. ``catalog`` and
    ``market`` are frames, or paths of a stored catalog and a stored enhanced
    catalog that each epoch resolves anew."""
    reader = spark.readStream.schema(S.REQUEST)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    requests = reader.format(source_format).load(source_dir)
    paths = {name: t for name, t in (("catalog", catalog), ("market", market)) if isinstance(t, str)}

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        own = batch.sparkSession
        at = epoch_versions(own, checkpoint, epoch_id, paths) if paths else {}
        products, context = catalog, market
        if "catalog" in at:
            products = read_catalog(own, catalog, version=at["catalog"])
        if "market" in at:
            context = market_from_enhanced(read_enhanced_catalog(own, market, version=at["market"]))
        batch = batch.persist()  # read by the size check, the pairs and the request flags
        try:
            shortlist(batch, products, context).write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch_id}")
            rejected_requests(batch).write.mode("overwrite").parquet(f"{sink_dir}-rejected/epoch={epoch_id}")
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_to_completion(spark: SparkSession, requests: DataFrame, catalog: DataFrame,
                      market: DataFrame | None) -> DataFrame:
    """Land ``requests`` as request files in the shared checkpoint folder (as
    many as the frame has partitions), stream them through
    ``start_shortlist_stream`` until all are processed, and return the sink as
    a DataFrame. Invalid requests are written to ``<sink>-rejected``."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/shortlist-stream-{uuid.uuid4().hex}"
    source, sink, ckpt = f"{base}/requests", f"{base}/shortlist", f"{base}/checkpoint"
    requests.write.mode("overwrite").parquet(source)
    q = start_shortlist_stream(spark, source, sink, ckpt, catalog, market, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"shortlist stream failed: {q.exception()}")
    return spark.read.parquet(sink).drop("epoch")
