"""Response assembly.

Groups are bounded: a request has at most 20 shortlist rows (the schema's
maximum), so collecting them into one array per request is safe. Requests
without any shortlist row survive through the left join from ``requests``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.functions import text as T
from shortlist.operators.requests import with_defaults

c = F.col

ITEM_FIELDS = ["brand", "model", "category", "price_usd", "plate", "drop_mm", "weight_g", "why_rules",
               "why_llm", "score", "sources"]


def item_projection(rows: DataFrame) -> DataFrame:
    """Shortlist row -> response item; missing optional texts become
    their defaults (``why_llm`` is filled by the explanation jobs)."""
    cols = {f: c(f) for f in ["brand", "model", "category", "price_usd", "plate", "drop_mm", "score"]}
    cols["weight_g"] = c("weight_g").cast("double")
    cols["why_rules"] = c("why_rules") if "why_rules" in rows.columns else F.lit("")
    cols["why_llm"] = c("why_llm") if "why_llm" in rows.columns else F.lit(None).cast("string")
    cols["sources"] = c("sources") if "sources" in rows.columns else F.array().cast("array<string>")
    return rows.select("request_id", "rank", F.struct(*[cols[f].alias(f) for f in ITEM_FIELDS]).alias("item"))


def request_summary(rows: DataFrame) -> DataFrame:
    """A4: item count and over-budget count per request (the over-budget
    count ignores whether the limiter is enabled, as the notes do)."""
    return rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(c("price_usd") > c("r_max_usd")).alias("n_over_budget"))


def response_notes(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """T16 per request (requests with no match get the no-match note)."""
    summary = request_summary(rows)
    return (requests.select("request_id").join(summary, "request_id", "left")
            .select("request_id", F.coalesce(c("n_items"), F.lit(0)).alias("n_items"),
                    F.coalesce(c("n_over_budget"), F.lit(0)).alias("n_over_budget"))
            .withColumn("notes", T.response_notes(c("n_items"), c("n_over_budget"))))


def nested_response(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """A10: one row per request: echoed (defaulted) request, shortlist array in
    rank order, notes."""
    items = item_projection(rows)
    agg = items.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct(c("rank"), c("item")))).alias("_ranked"))
    notes = response_notes(requests, rows)
    echo = with_defaults(requests)
    return (echo.join(agg, "request_id", "left").join(notes, "request_id", "left")
            .select("request_id",
                    F.struct(*[c(x) for x in echo.columns if x != "request_id"]).alias("inputs_echo"),
                    F.coalesce(F.transform("_ranked", lambda x: x["item"]),
                               F.array().cast(items.schema["item"].dataType.simpleString().join(
                                   ["array<", ">"]))).alias("shortlist"),
                    "notes"))


def display_columns(rows: DataFrame) -> DataFrame:
    """Score percentage, over-budget highlight, title-cased labels; drop
    and weight only where they are not 0."""
    drop, weight = c("drop_mm"), c("weight_g").cast("double")
    return rows.select(
        "request_id", "rank",
        T.score_percent(c("score")).alias("score_pct"),
        (c("r_limiter") & (c("price_usd") > c("r_max_usd"))).alias("over_budget_flag"),
        T.title_words(F.coalesce(c("plate"), F.lit("none"))).alias("plate_label"),
        T.title_words(F.array_join("category", ", ")).alias("category_label"),
        F.concat(F.lit("$"), T.num_text(c("price_usd"))).alias("price_label"),
        F.when(drop != 0, F.concat(T.num_text(drop), F.lit("mm"))).alias("drop_label"),
        F.when(weight != 0, F.concat(T.num_text(weight), F.lit("g"))).alias("weight_label"))
