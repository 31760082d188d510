"""Page-text extraction (X1-X17) as Column expressions.

Regular expressions run in the JVM (java.util.regex); matching is ASCII for
``\\s``/``\\d`` (Python's is Unicode), and substring rules stay substring
rules ("long" matches "along"), as in the source behaviour.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.schemas import (BLOCK_TAGS, BRAND_PATTERNS, CATEGORY_WORDS, CUSHION_WORDS, DROP_PATTERN, ENTITIES,
                               GENDER_PREFIX,
                               OUNCE_GRAMS, PLATE_PATTERNS, PRICE_MAX, PRICE_MIN, SALE_MIN_GAP,
                               STABILITY_WORDS, STACK_PATTERN, WEIGHT_PATTERN, WIDE_WORDS)

c = F.col


def strip(x: Column) -> Column:
    """Python ``str.strip()`` (whitespace, not only spaces)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def collapse_spaces(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def _any_contains(text: Column, words: list[str]) -> Column:
    out = None
    for w in words:
        hit = text.contains(w)
        out = hit if out is None else out | hit
    return out


# --- X1 / X2 page level ------------------------------------------------------------

def shown_text(html: Column) -> Column:
    """The text a browser shows, in its case: scripts, styles, comments and
    tags go, block elements and ``<br>`` begin a new line, other white space is
    one space, named entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, f"(?i)</?(?:{BLOCK_TAGS})(?:\\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, " +", " "), " ?\n[ \n]*", "\n")
    return F.btrim(t, F.lit(" \n"))


def visible_text(html: Column) -> Column:
    """The text a browser shows, lower-cased."""
    return F.lower(shown_text(html))


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's attribute (quoted either way or not at
    all), null if it has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = F.regexp_replace(F.regexp_extract(tag, pattern, 1), "^[\"']|[\"']$", "")
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(f"&{entity};"), F.lit(char))
    return F.when(tag.rlike(pattern), value)


def anchors(html: Column) -> Column:
    """Every anchor of a page in order: struct<href, aria_label, text,
    sibling_text>. An anchor's text ends at its end tag or the next anchor; its
    sibling is the element after it, up to that element's first end tag or an
    anchor inside of it."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|(?s)<!--.*?-->", " ")
    pieces = F.split(F.regexp_replace(body, r"(?i)<a\s", "\x01<a "), "\x01")

    def parts(piece: Column) -> Column:
        tag = F.regexp_extract(piece, r"""^<a [^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""", 0)
        rest = F.substring(piece, F.length(tag) + 1, F.length(piece))
        inner = F.regexp_extract(rest, r"(?is)^(.*?)(?:</a\s*>|$)", 1)
        after = F.regexp_extract(rest, r"(?is)</a\s*>(.*)$", 1)
        name = F.lower(F.regexp_extract(after, "^[^<]*<([A-Za-z][A-Za-z0-9]*)", 1))
        element = F.regexp_replace(after, "^[^<]*", "")
        end = F.instr(F.lower(element), F.concat(F.lit("</"), name))
        sibling = F.when(name.isin("", "img", "br", "hr", "input"), "").otherwise(
            shown_text(F.when(end > 0, F.substring(element, F.lit(1), end - 1)).otherwise(element)))
        return F.struct(attribute(tag, "href").alias("href"), attribute(tag, "aria-label").alias("aria_label"),
                        shown_text(inner).alias("text"), sibling.alias("sibling"),
                        (~F.contains(after, F.lit("<")) & rest.rlike(r"(?i)</a\s*>")).alias("next"))

    each = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), parts)
    return F.get(F.transform(F.array(each), lambda a: F.transform(a, lambda x, i: F.struct(
        x["href"], x["aria_label"], x["text"],
        F.when(x["next"], F.coalesce(F.get(a, i + 1)["text"], F.lit(""))).otherwise(x["sibling"]).alias("sibling_text")))),
        F.lit(0))


def absolute(page_url: Column, hrefs: Column) -> Column:
    """Link targets resolved against the page's URL: absolute, ``//host``,
    ``/path``, ``?query``, ``#fragment`` and relative ones."""
    scheme = F.regexp_extract(page_url, r"^([a-z]+:)//", 1)
    origin = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]+)", 1)
    page = F.regexp_extract(page_url, r"^[^?#]*", 0)
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))

    def resolve(h: Column) -> Column:
        return (F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h))
                .when(h.startswith("/"), F.concat(origin, h)).when(h.startswith("?"), F.concat(page, h))
                .when(h.startswith("#") | (h == ""), F.concat(page, h)).otherwise(F.concat(folder, h)))

    return F.transform(hrefs, resolve)


# --- X3-X5 listing cards ---------------------------------------------------------------

def canonical_url(href: Column) -> Column:
    """Cut at ``?`` then at ``#``."""
    return F.regexp_replace(href, r"[?#].*$", "")


def is_product_link(href: Column, marker: str = "/product/") -> Column:
    """Search results: the marker anywhere in the link."""
    return F.coalesce(href.contains(marker), F.lit(False))


def is_product_path(href: Column, marker: str = "/product/") -> Column:
    """Listing links whose path begins with the marker, whether ``href`` is
    written as a path or as a whole address."""
    return F.coalesce(href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)?" + re.escape(marker)), F.lit(False))


def title_case(s: Column) -> Column:
    """Python ``str.title()`` for ASCII text: a letter run is capitalised,
    anything else is kept (so "3d" becomes "3D")."""
    runs = F.regexp_extract_all(s, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                              F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def card_title(aria: Column, text: Column, sibling: Column, href: Column) -> Column:
    """Aria-label (if longer than 10), else link text; if that is
    shorter than 5, the next sibling's text (if longer than 5); if still
    shorter than 5, the URL slug (if longer than 5) with dashes as spaces,
    title-cased. Null when no candidate qualifies.

    Written as "first candidate meeting its length rule" so every input is
    referenced once: the expression stays linear in size when Catalyst
    inlines it into later projections and pushed-down filters."""
    t1 = F.when(F.length(F.coalesce(aria, F.lit(""))) > 10, strip(aria))
    t2 = F.coalesce(F.nullif(t1, F.lit("")), strip(text))
    slug = F.substring_index(F.regexp_extract(href, r"^[^?#]*", 0), "/", -1)
    cands = F.array(
        F.struct(t2.alias("v"), F.lit(5).alias("m")),
        F.struct(strip(sibling).alias("v"), F.lit(6).alias("m")),
        F.struct(title_case(F.regexp_replace(slug, "-", " ")).alias("v"), F.lit(6).alias("m")))
    first = F.try_element_at(F.filter(cands, lambda x: F.length(x["v"]) >= x["m"]), F.lit(1))
    return collapse_spaces(first["v"])


def with_card_title(df: DataFrame, out: str = "title") -> DataFrame:
    return df.withColumn(out, card_title(c("aria_label"), c("text"), c("sibling_text"), c("href")))


def brand_model(title: Column) -> Column:
    """Strip a leading gender word; the first brand pattern (in
    priority order) that matches anywhere, case-insensitively, gives
    (brand, model). Null when no brand matches or the model is empty.

    The title is bound to a lambda variable (``transform`` over a
    one-element array) so it is evaluated once per row even though all 26
    pattern tests read it; otherwise Catalyst would inline the whole title
    expression into every test."""
    brands = F.array(*[F.lit(b) for b, _ in BRAND_PATTERNS])

    def match(t: Column) -> Column:
        hits = F.array(*[t.rlike("(?i)" + pat) for _, pat in BRAND_PATTERNS])
        models = F.array(*[F.regexp_extract(t, "(?i)" + pat, 1) for _, pat in BRAND_PATTERNS])
        zipped = F.arrays_zip(hits.alias("hit"), brands.alias("brand"), models.alias("model"))
        first = F.try_element_at(F.filter(zipped, lambda z: z["hit"]), F.lit(1))
        res = F.struct(first["brand"].alias("brand"), collapse_spaces(first["model"]).alias("model"))
        return F.when(F.length(res["model"]) > 0, res)

    bound = F.transform(F.array(F.regexp_replace(title, GENDER_PREFIX, "")), match)
    return F.try_element_at(bound, F.lit(1))


def with_brand_model(df: DataFrame, title: str = "title") -> DataFrame:
    df = df.withColumn("_bm", brand_model(c(title)))
    return df.withColumn("brand", c("_bm.brand")).withColumn("model", c("_bm.model")).drop("_bm")


# --- X6 price pair --------------------------------------------------------------------------

def price_candidates(texts: Column) -> Column:
    """Per text node: ``$d+.dd`` amounts, or bare ``d+.dd`` when there is no
    dollar amount; kept when within [50, 300]."""
    def per_text(t: Column) -> Column:
        dollars = F.regexp_extract_all(t, F.lit(r"\$(\d+\.\d{2})"), F.lit(1))
        bare = F.regexp_extract_all(t, F.lit(r"(\d+\.\d{2})"), F.lit(1))
        found = F.when(F.size(dollars) > 0, dollars).otherwise(bare)
        return F.transform(found, lambda x: x.cast("double"))
    prices = F.flatten(F.transform(F.filter(texts, lambda t: strip(t) != ""), per_text))
    return F.array_distinct(F.filter(prices, lambda p: (p >= PRICE_MIN) & (p <= PRICE_MAX)))


def price_pair(texts: Column) -> Column:
    """(regular, sale). One price -> (p, null); several -> (max, min),
    the sale dropped when max - min < 10; none -> (null, null)."""
    ps = price_candidates(texts)
    hi, lo = F.array_max(ps), F.array_min(ps)
    sale = F.when((F.size(ps) >= 2) & ((hi - lo) >= SALE_MIN_GAP), lo)
    return F.struct(hi.alias("price"), sale.alias("sale_price"))


# --- X7-X15 specs from lower-cased page text ---------------------------------------------

def categories(text: Column) -> Column:                                # X7
    return F.array_compact(F.array(*[F.when(_any_contains(text, words), F.lit(tag))
                                     for tag, words in CATEGORY_WORDS]))


def plate_class(text: Column) -> Column:                               # X8
    out = None
    for pat, cls in PLATE_PATTERNS:
        out = F.when(text.rlike(pat), F.lit(cls)) if out is None else out.when(text.rlike(pat), F.lit(cls))
    return out.otherwise(F.lit("none"))


def drop_mm(text: Column) -> Column:                                   # X9
    groups = [F.nullif(F.regexp_extract(text, DROP_PATTERN, i), F.lit("")) for i in range(1, 5)]
    return F.coalesce(*groups).cast("double")


def weight_g(text: Column) -> Column:                                  # X10
    groups = [F.nullif(F.regexp_extract(text, WEIGHT_PATTERN, i), F.lit("")) for i in range(1, 3)]
    oz = F.coalesce(*groups).cast("double")
    # round() to the nearest int, half-even on the exact binary value
    return F.call_function("format_number", oz * OUNCE_GRAMS, F.lit("0")).try_cast("int")


def cushioning(text: Column) -> Column:                                # X11
    out = None
    for level, words in CUSHION_WORDS:
        hit = _any_contains(text, words)
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    return out


def support(text: Column) -> Column:                                   # X12
    return (F.when(_any_contains(text, STABILITY_WORDS), F.lit("stability"))
            .when(text.contains("neutral"), F.lit("neutral")))


def stack_heights(text: Column) -> Column:                             # X13
    heel = F.nullif(F.regexp_extract(text, STACK_PATTERN, 3), F.lit("")).cast("double")
    fore = F.nullif(F.regexp_extract(text, STACK_PATTERN, 5), F.lit("")).cast("double")
    return F.struct(heel.alias("heel_stack_mm"), fore.alias("forefoot_stack_mm"))


def race_distances(text: Column) -> Column:                            # X14
    d = F.array_compact(F.array(
        F.when(text.rlike(r"\b5k\b"), F.lit("5k")),
        F.when(text.rlike(r"\b10k\b"), F.lit("10k")),
        F.when(text.contains("half marathon") | text.contains("half-marathon"), F.lit("half_marathon")),
        F.when(text.contains("marathon"), F.lit("marathon"))))
    return F.when(F.size(d) > 0, F.array_sort(F.array_distinct(d)))


def wide_options(text: Column) -> Column:                              # X15
    return F.when(_any_contains(text, WIDE_WORDS), F.lit(True))


def size_available(options: Column, size: Column) -> Column:           # X16
    """Some option whose trimmed text equals the size and neither it nor
    its parent is disabled / unavailable."""
    def ok(o: Column) -> Column:
        cls = F.lower(F.coalesce(o["class"], F.lit("")))
        aria = F.lower(F.coalesce(o["aria_disabled"], F.lit("")))
        parent = F.lower(F.coalesce(o["parent_class"], F.lit("")))
        disabled = cls.contains("disabled") | aria.isin("true", "aria-disabled")
        parent_disabled = parent.contains("disabled") | parent.contains("unavailable")
        return (strip(o["text"]) == size) & ~disabled & ~parent_disabled
    return F.coalesce(F.exists(options, ok), F.lit(False))


def specs(body_text: Column) -> Column:
    """X7-X15 from the page body as one struct. The lower-cased text is
    bound to a lambda variable, so it is computed once per row although
    about forty tests read it."""
    def extract(t: Column) -> Column:
        cats = categories(t)
        st = stack_heights(t)
        return F.struct(
            F.when(F.size(cats) > 0, cats).alias("category"),
            plate_class(t).alias("plate"), drop_mm(t).alias("drop_mm"), weight_g(t).alias("weight_g"),
            cushioning(t).alias("cushioning_level"), support(t).alias("support_type"),
            st["heel_stack_mm"].alias("heel_stack_mm"), st["forefoot_stack_mm"].alias("forefoot_stack_mm"),
            race_distances(t).alias("best_for_distances"), wide_options(t).alias("has_wide_options"))
    return F.try_element_at(F.transform(F.array(F.lower(body_text)), extract), F.lit(1))
