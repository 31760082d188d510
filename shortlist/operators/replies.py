"""Model replies: parsing (T14), alignment to candidates (T15), final
explanations with fallback and rank suffix (T11, T12), the explanation
depth guard (T3) and quality multiplier (C15).

Replies arrive as a table (``request_id``, ``turn``, ``reply_text``); the
parse is a cascade of JSON attempts on the JVM side (``try_parse_json`` +
``schema_of_variant``), never Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions import text as T
from shortlist.functions.extract import collapse_spaces, strip
from shortlist.operators.dedup import first_per_key
from shortlist.schemas import GENERIC_REPLY

c = F.col


def string_list(text: Column) -> Column:
    """The text parsed as a JSON array of strings, else null. An element
    that is not a string (numbers, null, objects) rejects the whole list."""
    v = F.try_parse_json(text)
    schema = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<string>")
    ok = schema.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(arr, lambda x: x.isNull())
    return F.when(ok, arr)


def parse_reply(text: Column) -> Column:
    """T14 cascade: the whole text; else the first code-fence part (not the
    bare language tag) that parses; else the first ``[...]`` (shortest,
    across lines); else one generic line. Returns (items, method)."""
    whole = string_list(text)
    parts = F.filter(F.transform(F.split(text, "```"), lambda p: strip(p)),
                     lambda p: (F.lower(p) != "json") & (p != ""))
    fenced = F.when(text.contains("```"),
                    F.try_element_at(F.filter(F.transform(parts, string_list), lambda a: a.isNotNull()), F.lit(1)))
    bracket = string_list(F.regexp_extract(text, r"(?s)\[.*?\]", 0))
    items = F.coalesce(whole, fenced, bracket, F.array(F.lit(GENERIC_REPLY)))
    method = (F.when(whole.isNotNull(), F.lit("json")).when(fenced.isNotNull(), F.lit("fence"))
              .when(bracket.isNotNull(), F.lit("bracket")).otherwise(F.lit("fallback")))
    return F.struct(items.alias("items"), method.alias("method"))


def parse_replies(replies: DataFrame) -> DataFrame:
    p = parse_reply(c("reply_text"))
    return replies.select("request_id", "turn", p["items"].alias("items"), p["method"].alias("method"))


def first_reply(replies: DataFrame) -> DataFrame:
    """One reply per request: its first turn."""
    return first_per_key(parse_replies(replies), ["request_id"], [c("turn")])


def align(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Explanation ``i`` for the candidate of rank ``i``; the generic
    line when the list is short. ``reply`` is null when the request has no
    reply at all (the model was unavailable)."""
    j = rows.join(parsed.select("request_id", "items"), "request_id", "left")
    aligned = F.coalesce(F.try_element_at(c("items"), c("rank").cast("int")), F.lit(GENERIC_REPLY))
    return j.withColumn("reply", F.when(c("items").isNotNull(), aligned)).drop("items")


def final_explanations(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """T11 + T12: the aligned reply (or the unavailable text) with the rank
    suffix, as ``why_llm``."""
    a = align(rows, first_reply(replies))
    return a.withColumn("why_llm", T.explanation_with_fallback(c("reply"), c("rank")))


def sentence_count(text: Column) -> Column:
    """Sentences of a whitespace-normalised text: split after ., ! or ?
    followed by whitespace, empty pieces dropped."""
    return F.size(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != ""))


def ensure_depth(text: Column) -> Column:
    """Normalise whitespace; with fewer than two sentences, append
    "Specs: " with the first three facts and the over-budget sentence; an
    empty text gets a base sentence only if something is appended. Reads
    product columns and the flat request (``r_limiter``, ``r_max_usd``)."""
    norm = collapse_spaces(F.coalesce(text, F.lit("")))
    facts = F.array_compact(F.array(
        F.when(F.coalesce(c("plate"), F.lit("")).isin("", "none") == F.lit(False),
               F.concat(c("plate"), F.lit(" plate"))),
        F.when(c("drop_mm").isNotNull(), F.concat(T.num_text(c("drop_mm")), F.lit("mm drop"))),
        F.when(c("weight_g").isNotNull(), F.concat(F.lit("~"), T.num_text(c("weight_g")), F.lit("g weight"))),
        F.when(F.coalesce(c("cushioning_level"), F.lit("")) != "", F.concat(c("cushioning_level"), F.lit(" cushioning"))),
        F.when(F.coalesce(c("support_type"), F.lit("")) != "", F.concat(c("support_type"), F.lit(" support"))),
        F.when(c("heel_stack_mm").isNotNull() & c("forefoot_stack_mm").isNotNull(),
               F.concat(F.lit("stack "), T.num_text(c("heel_stack_mm")), F.lit("/"),
                        T.num_text(c("forefoot_stack_mm")), F.lit("mm"))),
        F.when(F.coalesce(F.size(c("category")), F.lit(0)) > 0,
               F.concat(F.lit("category: "), F.array_join(c("category"), ", ")))))
    price = c("price_usd")
    over = c("r_limiter") & price.isNotNull() & (price != 0) & (price > c("r_max_usd"))
    adds = F.array_compact(F.array(
        F.when(F.size(facts) > 0, F.concat(F.lit("Specs: "), F.array_join(F.slice(facts, 1, 3), ", "), F.lit("."))),
        F.when(over, F.lit("Priced above budget; consider for performance value."))))
    add_text = F.array_join(adds, " ")
    base = F.concat(c("brand"), F.lit(" "), c("model"), F.lit(" fits your "),
                    F.array_join(F.coalesce(c("category"), F.array().cast("array<string>")), ", "), F.lit(" needs."))
    grown = F.when(norm != "", F.concat(norm, F.lit(" "), add_text)).otherwise(F.concat(base, F.lit(" "), add_text))
    return F.when((sentence_count(norm) < 2) & (F.size(adds) > 0), grown).otherwise(norm)
