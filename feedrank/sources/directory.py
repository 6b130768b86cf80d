"""Rating directory: profile pages, autocomplete payloads, search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import html as H
from ..functions.names import slugify
from ..functions.scores import format_score, parse_score, reviews_text
from ..functions.text import blank_to_null, collapse_ws, pct_encode
from ..functions.urls import authority, canonical_profile_url, path
from ..schema import RATING


def parse_profile_pages(pages: DataFrame, host: str = R.PRIMARY_HOST) -> DataFrame:
    """Profile pages to directory rows.

    ``pages``: (slug, page_url, status, body), slug as requested. Returns
    (slug, status, profile_name, score, numeric, reviews, url); profile_name
    is null for a page that is no usable profile (not on the directory host,
    an error page, a score without reviews).
    """
    body = F.col("_html")

    def scoped(prop: str):
        """Content of a span with this itemprop."""
        piece = F.get(H.pieces(body, tag="span", having="itemprop", value=prop), 0)
        return H.balanced(piece, "span")

    def meta(scope, prop: str):
        tag = H.first_tag(scope, tag="meta", having="itemprop", value=prop)
        return F.trim(F.coalesce(H.attr(tag, "content"), F.lit("")))

    canonical = H.first_tag(body, tag="link", having="rel", value="[^\"'>]*canonical[^\"'>]*")
    heading = F.coalesce(
        H.first_element(body, tag="h1", class_name="reduce-h1"),
        H.first_element(F.get(H.pieces(body, class_name="company_header_basic_info"), 0), tag="h1"),
    )
    wrapper = F.get(H.pieces(body, class_name="score-value-wrapper"), 0)
    visual = F.coalesce(
        H.first_element(wrapper, class_name="c_rating"),
        H.first_element(body, class_name="score-value-wrapper"),
        H.first_element(body, class_name="c_rating"),
        H.first_element(body, class_name="b_rating"),
    )
    parsed = (
        pages.withColumn("_html", H.drop_hidden(F.coalesce("body", F.lit(""))))
        .withColumns({"_rating": scoped("aggregateRating"), "_item": scoped("itemReviewed")})
        .withColumns({
            "url": canonical_profile_url(
                F.coalesce(H.attr(canonical, "href"), F.lit("")), F.col("page_url"), host),
            "_name": F.coalesce(blank_to_null(H.text_of(heading)), blank_to_null(meta(F.col("_item"), "name"))),
            "_meta_score": parse_score(F.replace(meta(F.col("_rating"), "ratingValue"), F.lit(","), F.lit(".")), r"\."),
            "_visual_score": parse_score(F.coalesce(H.text_of(visual), F.lit(""))),
            "_count": meta(F.col("_rating"), "reviewCount"),
            "_shown_count": H.text_of(H.first_element(body, class_name="label_rating_font")),
        })
        .withColumn("_score", F.coalesce("_meta_score", "_visual_score"))
        .withColumn("reviews", reviews_text(F.col("_count"), F.coalesce("_shown_count", F.lit(R.NO_REVIEWS))))
    )
    empty_score = F.col("_score").isNotNull() & F.lower("reviews").isin("0 reviews", "0 review")
    usable = (
        F.col("url").isNotNull() & F.col("_name").isNotNull()
        & ~F.col("_name").rlike(R.ERROR_PAGE) & ~empty_score
    )
    return parsed.select(
        *[c for c in pages.columns if c not in ("body", "page_url")],
        F.when(usable, F.col("_name")).alias("profile_name"),
        format_score(F.col("_score")).alias("score"),
        F.coalesce("_score", F.lit(0.0)).alias("numeric"),
        "reviews",
        "url",
    )


def autocomplete_candidates(payloads: DataFrame) -> DataFrame:
    """Explode autocomplete payloads: (…, place, name, slug).

    The list is under ``results`` or ``json_list`` (a list or a map), or is the
    payload itself.
    """
    doc = F.try_parse_json(F.coalesce("body", F.lit("")))

    def values(at: str):
        items = F.coalesce(
            F.try_variant_get(F.col("_doc"), at, "array<variant>"),
            F.map_values(F.try_variant_get(F.col("_doc"), at, "map<string,variant>")),
        )
        return F.when(F.size(items) > 0, items)

    items = F.coalesce(values("$.results"), values("$.json_list"), F.try_variant_get(F.col("_doc"), "$", "array<variant>"))
    pick = lambda *keys: F.coalesce(
        *[blank_to_null(F.try_variant_get("item", f"$.{k}", "string")) for k in keys], F.lit(""))
    raw_slug = F.trim(pick("slug", "value"))
    cut = F.when(F.contains(raw_slug, F.lit("/companies/")),
                 F.substring_index(F.regexp_replace(raw_slug, "(?s)^.*?/companies/", ""), "/", 1)).otherwise(raw_slug)
    return (
        payloads.withColumn("_doc", doc)
        .select(*[c for c in payloads.columns if c != "body"], F.posexplode(items).alias("place", "item"))
        .withColumn("slug", slugify(cut))
        .filter((F.col("slug") != "") & F.schema_of_variant("item").startswith("OBJECT"))
        .withColumn("name", F.coalesce(blank_to_null(F.trim(pick("name", "label", "title"))),
                                       F.replace("slug", F.lit("-"), F.lit(" "))))
        .drop("item")
    )


def search_ratings(pages: DataFrame, host: str = R.FALLBACK_HOST) -> DataFrame:
    """Rating evidence in the first 8 results of each captured search.

    ``pages``: (company_key, company, status, body). Returns (company_key,
    rating), rating null when no result has a rating. All work is inside the
    row: a page has few results and nothing is shuffled.
    """
    def result(block):
        text = H.text_of(block)
        link = H.attr(H.first_tag(block, tag="a", class_name="result__a"), "href")
        from_host = F.contains(authority(link), F.lit(host)) & path(link).rlike(R.RATING_PAGES)
        long_form = blank_to_null(F.regexp_extract(text, R.RATING_SENTENCE, 1))
        score = F.coalesce(long_form, blank_to_null(F.regexp_extract(text, R.RATING_SHORT, 1)))
        count = F.when(long_form.isNotNull(), blank_to_null(F.regexp_extract(text, R.RATING_SENTENCE, 2)))
        return F.struct(F.when(F.coalesce(from_host, F.lit(False)), score).alias("score"), count.alias("count"))

    blocks = F.transform(
        F.slice(H.pieces(F.col("_html"), tag="div", class_name="result"), 1, R.CANDIDATES_PER_QUERY),
        lambda b: H.balanced(b, "div"))
    hits = F.filter(F.transform(blocks, result), lambda r: r["score"].isNotNull())
    number = F.replace(F.col("_hit.score"), F.lit(","), F.lit(".")).try_cast("double")
    found = (
        pages.withColumn("_html", F.when(F.col("status") == 200, H.drop_hidden(F.coalesce("body", F.lit(""))))
                         .otherwise(F.lit("")))
        .withColumn("_hit", F.get(hits, 0))
    )
    rating = F.struct(
        F.lit(R.FALLBACK_PLATFORM).alias("platform"),
        format_score(number).alias("score"),
        number.alias("numeric"),
        F.coalesce(F.concat(F.col("_hit.count"), F.lit(" Reviews")), F.lit(R.FALLBACK_REVIEWS)).alias("reviews"),
        F.concat(F.lit(R.FALLBACK_SEARCH_PREFIX), pct_encode(collapse_ws(F.col("company")))).alias("url"),
        F.lit(None).cast("string").alias("matched_name"),
        F.lit(None).cast("boolean").alias("alias_match"),
        F.lit(None).cast("bigint").alias("checked_at"),
    ).cast(RATING)
    return found.select("company_key", F.when(F.col("_hit").isNotNull(), rating).alias("rating"))
