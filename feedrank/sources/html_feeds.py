"""HTML feeds: captured listing pages to postings (same columns as JSON feeds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import html as H
from ..functions.dates import day_month_in_text
from ..functions.scores import salary_in_text
from ..functions.text import blank_to_null, contains_any, let
from ..functions.urls import absolute_url, id_after_dash, last_segment, strip_query
from ..operators.dedup import dedup_in_feed
from ..operators.limits import ok_pages
from ..session import once
from .captures import item_ordinal, within_limit
from .json_feeds import out_columns

# Defaults shown when a card does not name the field.
_NO_COMPANY_E = "Confidencial"
_NO_COMPANY_F = "Consultar Anúncio"
_NO_COMPANY_G = "Landing.jobs Partner"
_BASE_F = "https://www.itjobs.pt"
_BASE_G = "https://landing.jobs"


def _pages(captures: DataFrame, source: str) -> DataFrame:
    mine = captures.filter(F.col("source") == source)
    return ok_pages(mine).withColumn("_html", H.drop_hidden(F.coalesce("body", F.lit("")))).drop("body")


def _explode(df: DataFrame, cards: Column) -> DataFrame:
    keep = [c for c in df.columns if c != "_html"]
    return df.select(*keep, F.posexplode(cards).alias("_pos", "card"))


def _finish(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    text = lambda: F.lit(None).cast("string")
    full = {
        "seniority": text(),
        "salary": text(),
        "post_date": text(),
        "tags": F.array().cast("array<string>"),
        "description_snippet": text(),
        **fields,
        "raw": F.col("card"),
        "reject_reason": text(),
    }
    return df.withColumns({**full, "item_ordinal": item_ordinal()}).select(*out_columns(df))


def modality_of_card(location: Column, title: Column) -> tuple[Column, Column]:
    """(modality, is_remote): remote, hybrid or the default, by location and title."""
    place, name = F.lower(location), F.lower(title)
    remote = contains_any(place, ("remote", "remoto")) | F.contains(name, F.lit("remote"))
    hybrid = contains_any(place, ("hybrid", "híbrido")) | F.contains(name, F.lit("hybrid"))
    label = F.when(remote, F.lit("Remote")).when(hybrid, F.lit("Hybrid")).otherwise(F.lit("On-site / Hybrid"))
    return label, remote


def modality_of_text(text: Column) -> tuple[Column, Column]:
    """(modality, is_remote) from the text around a listing."""
    remote = contains_any(F.lower(text), ("remoto", "remote"))
    return F.when(remote, F.lit("100% Remote")).otherwise(F.lit("On-site / Hybrid")), remote


def modality_of_place(location: Column, title: Column) -> tuple[Column, Column]:
    remote = contains_any(F.lower(F.concat(location, F.lit(" "), title)), ("remote", "remoto"))
    return F.when(remote, F.lit("100% Remote")).otherwise(F.lit("Unknown")), remote


def location_of_text(text: Column) -> Column:
    """First city of the ladder, else remote, else the country."""
    low, out = F.lower(text), None
    for words, name in R.CITY_LADDER:
        hit = contains_any(low, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.when(contains_any(low, ("remoto", "remote")), F.lit("Portugal (Remote)")).otherwise(F.lit("Portugal"))


def parse_linkedin(captures: DataFrame) -> DataFrame:
    """Feed E: ``<li>`` cards with title and link; the rest is optional. A card may hold lists.

    Limit the result per request with ``limits.limit_by_manifest``: the limit
    counts kept cards over all pages.
    """
    card = F.col("card")
    parts = once(
        _explode(_pages(captures, "LinkedIn"), H.elements(F.col("_html"), "li")),
        _title=H.first_element(card, tag="h3", class_name="base-search-card__title"),
        _link=H.first_tag(card, tag="a", class_name="base-card__full-link"),
    ).filter(F.col("_title").isNotNull() & F.col("_link").isNotNull()).withColumns({
        "_company": H.first_element(card, tag="h4", class_name="base-search-card__subtitle"),
        "_place": H.first_element(card, tag="span", class_name="job-search-card__location"),
        "_time": H.first_element(card, tag="time"),
    }).withColumn("_texts", H.texts_of(
        (F.col("_title"), ""), (F.col("_company"), ""), (F.col("_place"), ""), (F.col("_time"), ""),
        (H.raw_attr(F.col("_link"), "href"), None),
    )).withColumns({
        "title": F.col("_texts")[0],
        "location": F.coalesce(F.col("_texts")[2], F.col("base_location"), F.lit("")),
        "job_url": strip_query(F.coalesce(F.col("_texts")[4], F.lit(""))),
    })
    label, remote = modality_of_card(F.col("location"), F.col("title"))
    return _finish(parts, {
        "job_id": id_after_dash(F.col("job_url")),
        "company": F.coalesce(F.col("_texts")[1], F.lit(_NO_COMPANY_E)),
        "modality": label,
        "is_remote": remote,
        "post_date": F.col("_texts")[3],
    })


#: Kinds of blocks around an offer, by preference: (tag, class).
_BLOCKS = (("div", "details"), ("div", "content"), ("article", None), ("li", None), ("div", None))


def _around(at: Column, spans: dict[str, Column]) -> Column:
    """The nearest enclosing block of the first kind that encloses the place; null for none."""
    found = []
    for tag, name in _BLOCKS:
        holds = lambda s: (s["start"] < at) & (at < s["end"])
        own = F.filter(spans[tag], holds)
        if name:
            pattern = f"(?is)^{H.open_tag_pattern(tag=tag, class_name=name)}"
            own = _opened(own, pattern)
        found.append(F.try_element_at(own, F.lit(-1)))  # spans are in order of their starts
    return F.coalesce(*found)


def _opened(blocks: Column, pattern: str) -> Column:
    return F.filter(blocks, lambda s: s["open"].rlike(pattern))


def _offers(html: Column) -> Column:
    """The offer links of a page in order: array of (link, card), card the block around the link or an empty text.

    What all links of a page need is computed once a page, and no row carries the page.
    """
    offer = dict(having="href", value="[^\"'>]*/oferta/[^\"'>]*")
    titled = H.open_tag_pattern(tag="a", class_name="title", **offer)
    plain = H.open_tag_pattern(tag="a", **offer)

    def starts(parts):
        """Where each part of the page begins: running lengths of the parts before it."""
        return F.aggregate(
            parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))

    def links(parts):
        whole = lambda at: F.transform(
            parts, lambda p, i: F.struct(F.get(at, i).alias("at"), H.until_close(p, "a").alias("link")))
        wanted = lambda has: F.filter(
            let(starts(parts), whole),
            lambda x: F.when(has, x["link"].rlike(f"(?is)^{titled}")).otherwise(x["link"].rlike(f"(?is)^{plain}")))
        return let(html.rlike(f"(?is){titled}"), wanted)

    def card(block):
        return F.when(block.isNotNull(), H.cut(html, block)).otherwise(F.lit(""))

    def placed(blocks):
        spans = {tag: blocks[tag] for tag in ("div", "article", "li")}
        return F.transform(
            let(F.split(html, r"(?i)(?=<a[\s>/])"), links),
            lambda x: F.struct(x["link"].alias("link"), let(_around(x["at"], spans), card).alias("card")))

    return let(F.struct(*[H.spans(html, t).alias(t) for t in ("div", "article", "li")]), placed)


def parse_itjobs(captures: DataFrame) -> DataFrame:
    """Feed F: the offer links of a page; one row per offer id and request.

    A link stands for an offer wherever it is; the block around it only fills
    the other fields.
    """
    pages = _pages(captures, "ITJobs.pt")
    keep = [c for c in pages.columns if c != "_html"]
    rows = pages.select(*keep, F.posexplode(_offers(F.col("_html"))).alias("_pos", "_found")).select(
        *keep, "_pos", F.col("_found.card").alias("card"), F.concat("_found.link", F.lit("</a>")).alias("link"))
    href = F.coalesce(F.col("_texts")[0], F.lit(""))
    number = F.regexp_extract(F.col("_href"), r"^/*[^/]+/([0-9]+)(?:/|$)", 1)
    owner = H.first_element(F.col("card"), tag="a", having="href", value="[^\"'>]*/empresa/[^\"'>]*")
    rows = once(rows.withColumn("_owner", owner), _texts=H.texts_of(
        (H.raw_attr(F.col("link"), "href"), None),
        (F.col("card"), " "),
        (F.col("link"), " "),
        (H.raw_attr(F.col("_owner"), "title"), None),
        (H.raw_attr(H.first_tag(F.col("_owner"), tag="img"), "alt"), None),
        (F.col("_owner"), ""),
    )).withColumns({"_href": href, "_text": F.col("_texts")[1]}).withColumns({
        "job_id": F.coalesce(blank_to_null(number), F.regexp_replace("_href", "[^a-z0-9]", "")),
        "title": F.col("_texts")[2],
    })
    label, remote = modality_of_text(F.col("_text"))
    company = F.coalesce(
        *[blank_to_null(F.col("_texts")[i]) for i in (3, 4, 5)],
        F.lit(_NO_COMPANY_F),
    )
    parsed = _finish(rows, {
        "company": company,
        "location": location_of_text(F.col("_text")),
        "job_url": absolute_url(F.col("_href"), _BASE_F, relative_prefix="/"),
        "modality": label,
        "is_remote": remote,
        "salary": salary_in_text(F.col("_text")),
        "post_date": day_month_in_text(F.col("_text")),
    })
    # An id counts as seen before its title is looked at.
    return dedup_in_feed(parsed).filter(F.length("title") >= 3)


def parse_landing(captures: DataFrame) -> DataFrame:
    """Feed G: ``<article>`` cards, else ``div.job-card``; the first limit of a page."""
    articles = F.transform(H.pieces(F.col("_html"), tag="article"), lambda c: H.until_close(c, "article"))
    divs = F.transform(H.pieces(F.col("_html"), tag="div", class_name="job-card"), lambda c: H.balanced(c, "div"))
    cards = let(articles, lambda a: F.when(F.size(a) > 0, a).otherwise(divs))
    card = F.col("card")
    parts = once(within_limit(_explode(_pages(captures, "Landing.jobs"), cards)).withColumns({
        "_main": H.first_element(card, tag="a", class_name="job-card__title"),
        "_heads": H.all_elements(card, "h[234]"),
        "_employer": H.first_element(card, class_part="company|employer"),
        "_place": H.first_element(card, class_part="location|where"),
    }).withColumn(
        "_title", F.coalesce("_main", H.first_element(card, tag="h2"), H.first_element(card, tag="h3"))
    ).withColumn(
        "_employer", F.coalesce(F.when(F.col("_employer") != F.col("_title"), F.col("_employer")),
                                F.get("_heads", 1))
    ).withColumn(
        "_link", F.coalesce(H.first_tag(card, tag="a", class_name="job-card__title", having="href"), "_main",
                            H.first_tag(card, tag="a", having="href"))
    ), _titled=F.col("_title").isNotNull(), _texts=H.texts_of(
        (F.col("_title"), ""), (F.col("_employer"), ""), (F.col("_place"), " "), (H.raw_attr(F.col("_link"), "href"), None),
    )).filter(F.col("_titled") & F.col("_texts")[3].isNotNull()).withColumns({
        "title": F.col("_texts")[0],
        "location": F.coalesce(F.col("_texts")[2], F.lit("Unknown")),
        "job_url": absolute_url(F.col("_texts")[3], _BASE_G),
    })
    label, remote = modality_of_place(F.col("location"), F.col("title"))
    return _finish(parts, {
        "job_id": strip_query(last_segment(F.col("job_url"))),
        "company": F.coalesce(F.col("_texts")[1], F.lit(_NO_COMPANY_G)),
        "modality": label,
        "is_remote": remote,
    })


PARSERS = {
    "LinkedIn": parse_linkedin,
    "ITJobs.pt": parse_itjobs,
    "Landing.jobs": parse_landing,
}
