"""Per-request ranking (W1-W4) and the over-budget quota.

Every per-request window carries a *literal* upper bound next to the
per-row bound (``rank <= 20 and rank <= n``): with a literal, Catalyst plans
a WindowGroupLimit, which keeps at most 20 rows per request in each task
before sorting the survivors, instead of ranking every candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.schemas import MAX_RECOMMENDATIONS, OVER_BUDGET_QUOTA

c = F.col


def top_n_per_request(df: DataFrame, order: list[Column], n: Column,
                      bound: int = MAX_RECOMMENDATIONS, rank_col: str = "rank") -> DataFrame:
    """``row_number`` over (request_id ORDER BY order) kept while
    ``<= n`` (and ``<= bound``)."""
    w = Window.partitionBy("request_id").orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter((c(rank_col) <= bound) & (c(rank_col) <= n)))


def enhanced_order() -> list[Column]:
    """Adjusted score, then the pre-score (the first stable sort), then
    catalog order."""
    return [c("adjusted_score").desc(), c("original_score").desc(), c("catalog_pos").asc()]


def basic_order() -> list[Column]:
    """Stable sort by score: ties keep catalog order."""
    return [c("score").desc(), c("catalog_pos").asc()]


def over_budget_quota(scored: DataFrame, quota: int = OVER_BUDGET_QUOTA,
                      bound: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """with the limiter on, only the first ``quota`` over-budget pairs
    of a request in catalog order survive. ``scored`` has request_id,
    catalog_pos, score and ``_over``. One pass over the pairs: a window per
    (request, over budget or not) keeps the first ``quota`` over-budget rows
    in catalog order, and of the others the ``bound`` best, more than which
    cannot be ranked (both below a literal, for a WindowGroupLimit)."""
    w = Window.partitionBy("request_id", "_over").orderBy(
        F.when(c("_over"), c("catalog_pos")), c("score").desc(), c("catalog_pos").asc())
    return (scored.withColumn("_q", F.row_number().over(w))
            .filter((c("_q") <= bound) & (~c("_over") | (c("_q") <= quota))).drop("_q", "_over"))


def preview(ranked: DataFrame, k: int = 5, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` ranks of each request."""
    return ranked.filter(c(rank_col) <= k)
