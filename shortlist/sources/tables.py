"""Sources and sinks.

Parquet is the storage format at scale; JSON array files are accepted for
compatibility with hand-made catalogs and request bodies. Schemas are always
given, never inferred.
"""

from __future__ import annotations

import logging

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from shortlist import schemas as S
from shortlist.functions import extract as X
from shortlist.functions.elements import arrow_hrefs, arrow_lists
from shortlist.session import cut_lineage
from shortlist.sources.snapshots import Snapshot, replace, snapshot

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed parquet table. Column pruning and filters reach the scan
    because everything downstream is declarative."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Up to so many splits of a scan (one for each 128 MB of a file) their
#: offsets are broadcast.
BROADCAST_SPLITS = 1_000_000
FORMATS = {"parquet": ("parquet", {}), "jsonl": ("json", {}), "json": ("json", {"multiLine": "true"})}


def in_file_order(scan: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of a file scan with ``__file``, ``__at`` (the row's number,
    from 1, over all files by path) and ``__line`` (within its file).

    A task reads each split of a file from its begin to its end, so the rows of
    a split are numbered by where they stand; only the splits' counts are
    gathered, ordered and handed back, the rows stay where they are read."""
    rows = scan.select(*columns, F.col("_metadata.file_path").alias("__file"),
                       F.col("_metadata.file_block_start").alias("__block"),
                       F.monotonically_increasing_id().alias("__id"))
    splits = cut_lineage(rows.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__file", "__block", "__first",
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                           F.coalesce(F.sum("__n").over(own), F.lit(0)).alias("__own"))
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    place = F.col("__id") - F.col("__first") + 1
    return rows.join(splits, ["__file", "__block"]).select(
        *columns, "__file", (place + F.col("__before")).alias("__at"), (place + F.col("__own")).alias("__line"))


def _scan(spark: SparkSession, path: str, fmt: str, schema: StructType, version: int | None = None) -> DataFrame:
    """A version of a stored table (by default the newest), or plain files. Where a row of plain files has no
    ``catalog_pos``, the positions of all rows are 1 to n in file order."""
    kept = snapshot(spark, path, version)
    if kept is not None:
        return spark.read.schema(schema).format(kept.fmt).load(kept.location)
    source, options = FORMATS[fmt]
    scan = spark.read.schema(schema).options(**options).format(source).load(path)
    if scan.filter(F.col("catalog_pos").isNull()).isEmpty():
        return scan
    columns = [f.name for f in schema]
    return in_file_order(scan, columns).withColumn("catalog_pos", F.col("__at")).select(*columns)


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """Catalog scan. A catalog that ``write_catalog`` has stored is read
    in its newest version, or in the one asked for. Of plain files ``fmt='json'`` reads JSON *arrays*
    (one a file, as hand-made catalogs are), ``'jsonl'`` JSON lines; rows
    without a position get 1 to n in file order."""
    return _scan(spark, path, fmt, S.CATALOG, version)


def _unreadable(error: BaseException) -> bool:
    """Whether a read failed because of what lies there (or does not), not
    because of the cluster."""
    return any(sign in str(error) for sign in (
        "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "MALFORMED_RECORD_IN_PARSING", "CANNOT_READ_FILE_FOOTER",
        "is not a Parquet file", "FAILED_READ_FILE.CANNOT_READ_FILE_FOOTER", "PARQUET_COLUMN_DATA_TYPE_MISMATCH"))


def read_enhanced_catalog(spark: SparkSession, path: str, fmt: str = "parquet",
                          version: int | None = None) -> DataFrame:
    """Enhanced catalog with fallback. A missing or malformed source gives
    an empty frame of the same schema (the market context is then empty), and
    the reason is logged; any other error is raised. Stored versions were
    counted when they were written and are not read twice; plain files are
    tried first."""
    try:
        if snapshot(spark, path, version) is not None:
            return _scan(spark, path, fmt, S.ENHANCED_CATALOG, version)
        source, options = FORMATS[fmt]
        strict = spark.read.schema(S.ENHANCED_CATALOG).options(**options, mode="FAILFAST").format(source).load(path)
        strict.agg(F.bit_xor(F.xxhash64(*strict.columns))).first()  # a malformed file shows now, in any of its rows
        return _scan(spark, path, fmt, S.ENHANCED_CATALOG)
    except (AnalysisException, Py4JJavaError, PySparkException) as error:
        if not _unreadable(error):
            raise
        log.warning("enhanced catalog unavailable at %s (%s); using empty market context", path, error)
        return spark.createDataFrame([], S.ENHANCED_CATALOG)


def write_catalog(df: DataFrame, path: str, fmt: str = "parquet") -> Snapshot:
    """Replacing sink (``fmt`` ``parquet`` or ``jsonl``). The rows go to
    a version folder of their own and are counted there; then one small file
    makes it the current version (``sources/snapshots.py``). A failure leaves
    the catalog as it was, and ``df`` may read the catalog that it replaces."""
    return replace(df, path, FORMATS[fmt][0])


def request_bodies(bodies: DataFrame, body: str, source: Column) -> DataFrame:
    """REQUEST columns and ``source`` (file, line, text): the text of a
    body that cannot be parsed, null for the others."""
    shape = StructType([*S.REQUEST.fields, StructField("_corrupt", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = bodies.select(F.from_json(F.col(body), shape, options).alias("__r"), F.col(body).alias("__body"),
                           source.alias("__source"))
    bad = F.col("__r").isNull() | F.col("__r._corrupt").isNotNull()
    return parsed.select(*[F.col(f"__r.{f.name}") for f in S.REQUEST],
                         F.col("__source").withField("text", F.when(bad, F.coalesce("__body", F.lit(""))))
                         .alias("source"))


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies as JSON lines with the fixed request schema. Each row
    knows its file and line; a line that is no request keeps its text in
    ``source`` and is rejected by validation (R3). Blank lines are no bodies."""
    lines = in_file_order(spark.read.text(path), ["value"]).filter(F.trim("value") != "")
    return request_bodies(lines, "value", F.struct(F.col("__file").alias("file"), F.col("__line").alias("line")))


def requests_from_json_column(df: DataFrame, col: str = "body") -> DataFrame:
    """S5 variant: parse a string column of JSON request bodies."""
    nowhere = F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("line"))
    return request_bodies(df, col, nowhere)


def page_anchors(pages: DataFrame) -> DataFrame:
    """The anchors of landed pages (page_id, url, html) as LISTING_ANCHORS,
    a row for each that has an href."""
    a = pages.select(F.col("page_id").alias("page_no"), F.posexplode(X.anchors(F.col("html"))).alias("anchor_idx", "a"))
    return a.filter(F.col("a.href").isNotNull()).select("page_no", "anchor_idx", "a.*")


def landed_product_pages(pages: DataFrame) -> DataFrame:
    """Landed pages as PRODUCT_PAGES: their URL without query and fragment,
    their text, and the lists of element texts (prices, sizes, descriptions,
    reviews, ratings, features) that the fixed selectors find."""
    lists = [f for f in S.PRODUCT_PAGES if f.name not in ("url", "body_text")]
    kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in lists])
    given = pages.select(F.regexp_extract("url", "^[^?#]*", 0).alias("url"),
                         X.shown_text(F.col("html")).alias("body_text"), "html")
    return given.mapInArrow(arrow_lists(kinds), S.PRODUCT_PAGES)


def page_links(pages: DataFrame, site_host: Column) -> DataFrame:
    """page_id and the links to visit: the page itself, then the links with
    ``page=`` on the same site, those of pagination blocks first, each once."""
    found = pages.select("page_id", "url", site_host.alias("host"), "html").mapInArrow(
        arrow_hrefs, "page_id bigint, url string, host string, hrefs array<string>")
    links = F.filter(X.absolute(F.col("url"), F.col("hrefs")),
                     lambda h: h.contains(F.col("host")) & h.contains("page="))
    return found.select("page_id", F.array_distinct(F.concat(F.array("url"), links)).alias("links"))
