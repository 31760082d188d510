"""Candidate generation: request x product pairs that pass the filters (J1),
with the market context attached to products (J2) and the global market flag
(J7).

The brand and use filters (F1, F3/F4) become one equi join. A product has one
set of use tags, kept as a five-bit mask; a request accepts the masks that
overlap its own. A request with brand preferences is repeated for each of its
brands, any other request stands for "any brand", and a product is offered
under its brand and under "any". So a pair meets in exactly one key, and only
pairs that pass meet at all; the carbon rule (F2) is left as a filter.

Two physical strategies give the same rows:

* **broadcast**: the product side is broadcast when its rows and bytes are
  checked to be at most ``shortlist.broadcast.maxRows`` and ``maxBytes``;
  requests stay
  partitioned by ``request_id`` so the later top-N window needs no further
  shuffle.
* **grid**: when the product side is larger, both sides are also dealt over a
  grid of request and product buckets and joined on (key, row, column). A key
  that holds a third of all products (and most requests) is split into cells
  of about ``shortlist.pairsPerCell`` pairs each. Nothing is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.predicates import USE_TAGS, allowed_tags, carbon_ok

c = F.col

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20
DEFAULT_PAIRS_PER_TASK = 1_000_000
DEFAULT_PAIRS_PER_CELL = 50_000_000
KEY = ["_any", "_brand", "_mask"]


def conf_int(df: DataFrame, key: str, default: int) -> int:
    v = df.sparkSession.conf.get(key, None)
    return int(v) if v else default


def broadcastable(df: DataFrame) -> tuple[bool, int]:
    """Whether a side may be broadcast, and its rows (one more than the bound
    if there are more). Rows are counted and their bytes added up, both of at
    most ``shortlist.broadcast.maxRows`` + 1 rows."""
    def width(field) -> Column:
        x, kind = c(field.name), field.dataType.typeName()
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(x), F.lit(0)) + 16
        if kind == "array":
            return F.coalesce(F.octet_length(F.to_json(x)), F.lit(0)) + 32
        return F.lit(8)

    max_rows = conf_int(df, "shortlist.broadcast.maxRows", DEFAULT_MAX_BROADCAST_ROWS)
    max_bytes = conf_int(df, "shortlist.broadcast.maxBytes", DEFAULT_MAX_BROADCAST_BYTES)
    total = sum((width(f) for f in df.schema), F.lit(16))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(total)).first()
    return rows <= max_rows and (size or 0) <= max_bytes, rows


def pair_partitioned(requests: DataFrame, n_products: int) -> DataFrame:
    """Hash-partition requests by request_id into enough partitions that
    each task meets about ``shortlist.pairsPerTask`` candidate pairs. The
    partition count is explicit because the request table itself is small:
    sized by bytes (or coalesced by AQE) it would become one task that does
    all of |requests| x |products| work. The later per-request window reuses
    this partitioning (no further shuffle)."""
    spark = requests.sparkSession
    per_task = conf_int(requests, "shortlist.pairsPerTask", DEFAULT_PAIRS_PER_TASK)
    n_requests = requests.count()
    floor = spark.sparkContext.defaultParallelism
    parts = max(floor, math.ceil(n_requests * max(n_products, 1) / per_task))
    return requests.repartition(parts, "request_id")


def with_market(catalog: DataFrame, market: DataFrame | None) -> DataFrame:
    """Left equi join of the (deduplicated) market context on
    (brand, model); unmatched products get null market columns."""
    if market is None:
        return (catalog.withColumn("mk_review_count", F.lit(None).cast("bigint"))
                .withColumn("mk_rating", F.lit(None).cast("double")))
    m = market.select("brand", "model", c("review_count").alias("mk_review_count"),
                      c("rating").alias("mk_rating"))
    return catalog.join(m, ["brand", "model"], "left")


def market_flag(market: DataFrame | None) -> Column:
    """True when the market context is non-empty at all. A scalar
    subquery (one aggregate job), not a cross join."""
    if market is None:
        return F.lit(False)
    return market.select((F.count(F.lit(1)) > 0).alias("has_market")).scalar()


def product_keys(products: DataFrame) -> DataFrame:
    """Each product under its own brand and under "any brand", with the mask
    of its use tags. Products without a use tag pass no request."""
    tags = F.array(*[c(f"p_{t}") for t in USE_TAGS])
    mask = sum((F.when(F.get(tags, F.lit(i)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(USE_TAGS))),
               F.lit(0))
    offers = F.array(F.struct(F.lit(True).alias("any"), F.lit("").alias("brand")),
                     F.struct(F.lit(False).alias("any"), c("brand").alias("brand")))
    keyed = products.withColumn("_mask", mask).filter("_mask > 0").withColumn("_o", F.explode(offers))
    return keyed.withColumns({"_any": c("_o.any"), "_brand": c("_o.brand")}).drop("_o")


def request_keys(requests: DataFrame, enhanced: bool) -> DataFrame:
    """Each request for every brand it prefers (or "any brand") and every mask
    that overlaps its accepted tags."""
    accepted = sum((F.when(F.array_contains(c("_tags"), t), F.lit(1 << i)).otherwise(F.lit(0))
                    for i, t in enumerate(USE_TAGS)), F.lit(0))
    masks = F.filter(F.sequence(F.lit(1), F.lit((1 << len(USE_TAGS)) - 1)),
                     lambda m: m.bitwiseAND(c("_accepted")) != 0)
    prefs = F.transform(F.array_distinct(c("r_prefs")),
                        lambda b: F.struct(F.lit(False).alias("any"), b.alias("brand")))
    wants = F.when(F.coalesce(F.size("r_prefs") > 0, F.lit(False)), prefs).otherwise(
        F.array(F.struct(F.lit(True).alias("any"), F.lit("").alias("brand"))))
    keyed = requests.withColumn("_tags", allowed_tags(enhanced)).withColumn("_accepted", accepted)
    keyed = keyed.withColumn("_w", F.explode(wants)).withColumn("_mask", F.explode(masks))
    return keyed.withColumns({"_any": c("_w.any"), "_brand": c("_w.brand")}).drop("_w", "_tags", "_accepted")


def candidate_pairs(requests: DataFrame, products: DataFrame, enhanced: bool = True,
                    strategy: str | None = None, offers: DataFrame | None = None) -> DataFrame:
    """All (request, product) pairs passing F6 (enhanced) or F1+F3
    (basic). ``requests`` are prepared (flat) requests, ``products`` a narrow
    product projection with ``catalog_pos`` and ``category``; ``offers``, if
    given, are those rows of its ``product_keys`` that are to be met."""
    n_products = None
    if offers is not None:
        n_products = offers.filter("_any").count()
    else:
        offers = product_keys(products)
    if strategy is None:
        fits, rows = broadcastable(offers)  # two rows a product
        strategy, n_products = ("broadcast", rows // 2 if n_products is None else n_products) if fits else ("grid", n_products)
    if strategy not in ("broadcast", "grid"):
        raise ValueError(f"unknown strategy {strategy}")
    if n_products is None:
        n_products = products.count()
    if strategy == "broadcast":
        reqs = request_keys(pair_partitioned(requests, n_products), enhanced)
        pairs = reqs.join(F.broadcast(offers), KEY)
    else:
        per_cell = conf_int(requests, "shortlist.pairsPerCell", DEFAULT_PAIRS_PER_CELL)
        cells = max(1, math.ceil(requests.count() * max(n_products, 1) / per_cell))
        side = math.ceil(math.sqrt(cells))
        parts = max(requests.sparkSession.sparkContext.defaultParallelism, cells)
        grid = [*KEY, "_rb", "_pb"]
        every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)).cast("array<bigint>"))
        prod = (offers.withColumn("_pb", F.pmod(F.xxhash64("catalog_pos"), F.lit(side)))
                .withColumn("_rb", every).repartition(parts, *grid))
        reqs = (request_keys(requests, enhanced).withColumn("_rb", F.pmod(F.xxhash64("request_id"), F.lit(side)))
                .withColumn("_pb", every).repartition(parts, *grid))
        pairs = reqs.join(prod, grid).drop("_rb", "_pb")
    return (pairs.filter(carbon_ok()) if enhanced else pairs).drop(*KEY)
