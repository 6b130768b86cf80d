"""JSON feeds: captured API payloads to postings.

Each function returns the posting columns, the order columns, ``captured_at``,
``raw`` and ``reject_reason`` (null for a good row); see ``captures.accepted``
and ``captures.quarantine``. Payload fields change type between items, so items
stay VARIANT until each field is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.dates import posted_on
from ..functions.scores import salary_range
from ..functions.text import as_list, blank_to_null, truthy
from ..functions.urls import last_segment
from ..session import once
from .captures import item_ordinal, within_limit

_OUT = (
    "source", "query_ordinal", "item_ordinal", "job_id", "title", "company", "location", "job_url",
    "modality", "seniority", "is_remote", "salary", "post_date", "tags", "description_snippet",
    "captured_at", "raw", "reject_reason",
)
#: Where each feed's list of items is.
LIST_PATHS = {"Arbeitnow": "$.data", "Himalayas": "$.jobs", "Jobicy": "$.jobs", "RemoteOK": "$"}
#: The fields of an item that each feed reads.
FIELDS = {
    "Arbeitnow": ("slug", "title", "company_name", "location", "url", "remote", "created_at", "tags", "description", "job_description"),
    "Himalayas": ("id", "title", "companyName", "companySlug", "slug", "applicationLink", "guid", "locationRestrictions",
                  "minSalary", "maxSalary", "currency", "pubDate", "excerpt"),
    "Jobicy": ("id", "jobTitle", "companyName", "jobGeo", "url", "jobLevel", "pubDate", "jobTags", "tags", "jobDescription", "description"),
    "RemoteOK": ("id", "position", "company", "url", "date", "tags", "description"),
}


def out_columns(df: DataFrame) -> tuple[str, ...]:
    """Columns of parsed items; the run leads where captures name one."""
    return (*(c for c in ("run_id",) if c in df.columns), *_OUT)


_NONE = "None"  # fixed value: text of a null id


def _get(key: str) -> Column:
    return F.col("_fields").getField(key)


def _as_text(key: str) -> Column:
    return F.try_variant_get(_get(key), "$", "string")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _string(key: str, default: str | None) -> Column:
    """Text field: default when absent, null (rejected later) when not text."""
    value = _get(key)
    return F.when(value.isNull(), F.lit(default)).when(
        _kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _truthy_string(key: str) -> Column:
    """Text field, null when absent, null or ''."""
    return blank_to_null(_as_text(key))


def _any_text(value: Column) -> Column:
    """Text of any scalar, null when absent or null."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(_kind(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _id(key: str, default: Column) -> Column:
    value = _get(key)
    return F.when(value.isNull(), default).when(_kind(value) == "VOID", F.lit(_NONE)).otherwise(_any_text(value))


def _is_number(value: Column) -> Column:
    return _kind(value).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _number(value: Column) -> Column:
    return F.when(_is_number(value), F.try_variant_get(value, "$", "double"))


def _number_text(value: Column) -> Column:
    """Plain text of a JSON number; a fractional type keeps its '.0'."""
    text = F.try_variant_get(value, "$", "string")
    fraction = _kind(value).rlike("^(?:DECIMAL|DOUBLE|FLOAT)") & ~F.contains(text, F.lit("."))
    return F.when(_is_number(value), F.when(fraction, F.concat(text, F.lit(".0"))).otherwise(text))


def _date(key: str) -> Column:
    value = _get(key)
    return posted_on(F.try_variant_get(value, "$", "string"), _number(value))


def _first_text(*keys: str) -> Column:
    """First field that is not empty; '' when all are."""
    return F.coalesce(*[_truthy_string(k) for k in keys], F.lit(""))


def _tags(*keys: str) -> Column:
    lists = [as_list(_get(k)) for k in keys]
    out = lists[-1]
    for tags in reversed(lists[:-1]):
        out = F.when(F.size(tags) > 0, tags).otherwise(out)
    return out


def _items(captures: DataFrame, source: str) -> DataFrame:
    """One row per element of the payload's array, with its place."""
    return (
        captures.filter((F.col("source") == source) & (F.col("status") == 200))
        .withColumn("_doc", F.try_parse_json(F.coalesce("body", F.lit(""))))
        .withColumn("_list", F.try_variant_get("_doc", LIST_PATHS[source], "array<variant>"))
        .drop("body", "_doc")
    )


def _explode(df: DataFrame, source: str) -> DataFrame:
    """One row per item; ``_fields`` holds what the feed reads, taken from the item in one walk, null for no object."""
    keep = [c for c in df.columns if c != "_list"]
    items = within_limit(df.select(*keep, F.posexplode("_list").alias("_pos", "item")))
    fields = ", ".join(f"{name}: variant" for name in FIELDS[source])
    return once(items, _fields=F.try_variant_get("item", "$", f"struct<{fields}>"))


def _finish(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    full = {
        "seniority": F.lit(None).cast("string"),
        "salary": F.lit(None).cast("string"),
        "tags": F.array().cast("array<string>"),
        **fields,
    }
    need = ("title", "company", "location", "job_url")
    reason = F.when(F.col("_fields").isNull(), F.lit("item is not an object"))
    for name in need:
        reason = reason.when(F.col(name).isNull(), F.lit(f"{name} is not text"))
    if "_level_ok" in full:
        reason = reason.when(~F.col("_level_ok"), F.lit("level is not text"))
    return (
        df.withColumns({**full, "item_ordinal": item_ordinal()})
        .withColumns({"raw": F.to_json("item"), "reject_reason": reason})
        .select(*out_columns(df))
    )


def parse_arbeitnow(captures: DataFrame) -> DataFrame:
    """Feed A: ``data[:limit]``; remote flag given as boolean or word."""
    remote = truthy(_as_text("remote"))
    items = _explode(_items(captures, "Arbeitnow"), "Arbeitnow")
    return _finish(items, {
        "job_id": _id("slug", F.lit("")),
        "title": _string("title", ""),
        "company": _string("company_name", "N/A"),
        "location": _string("location", "Remote / Europe"),
        "job_url": _string("url", ""),
        "is_remote": remote,
        "modality": F.when(remote, F.lit("Remote")).otherwise(F.lit("Hybrid / On-site")),
        "post_date": _date("created_at"),
        "tags": _tags("tags"),
        "description_snippet": _first_text("description", "job_description"),
    })


def parse_himalayas(captures: DataFrame) -> DataFrame:
    """Feed B: URL ladder, salary text, location from restrictions; always remote."""
    company_slug, job_slug = _truthy_string("companySlug"), _truthy_string("slug")
    built = F.concat(F.lit("https://himalayas.app/companies/"), company_slug, F.lit("/jobs/"), job_slug)
    url = F.coalesce(_truthy_string("applicationLink"), _truthy_string("guid"), built,
                     F.lit("https://himalayas.app/jobs"))
    places = F.filter(as_list(_get("locationRestrictions")), lambda p: F.coalesce(p, F.lit("")) != "")
    place_kind = _kind(_get("locationRestrictions"))
    listed = F.when(place_kind.startswith("ARRAY") | (place_kind == "STRING"),
                    blank_to_null(F.array_join(places, ", ")))
    items = once(_explode(_items(captures, "Himalayas"), "Himalayas"),
                 _low=_number_text(_get("minSalary")), _high=_number_text(_get("maxSalary")))
    return _finish(items, {
        "job_id": _id("id", last_segment(url)),
        "title": _string("title", ""),
        "company": _string("companyName", "N/A"),
        "location": F.coalesce(listed, F.lit("Worldwide Remote")),
        "job_url": url,
        "is_remote": F.lit(True),
        "modality": F.lit("100% Remote"),
        "salary": salary_range(F.col("_low"), F.col("_high"),
                               F.coalesce(_any_text(_get("currency")),
                                          F.when(_get("currency").isNull(), F.lit("USD")).otherwise(F.lit(_NONE)))),
        "post_date": _date("pubDate"),
        "description_snippet": _string("excerpt", ""),
    })


def parse_jobicy(captures: DataFrame) -> DataFrame:
    """Feed C: rows without title or URL dropped; entry levels get the fixed label."""
    level = _string("jobLevel", "")
    entry = F.contains(F.lower(level), F.lit("entry")) | F.contains(F.lower(level), F.lit("junior"))
    empty = lambda key: F.coalesce(_as_text(key), F.lit("")) == ""
    items = _explode(_items(captures, "Jobicy"), "Jobicy").filter(
        F.col("_fields").isNull() | ~(empty("jobTitle") | empty("url")))
    return _finish(items, {
        "job_id": _id("id", F.lit("")),
        "title": _string("jobTitle", ""),
        "company": _string("companyName", "N/A"),
        "location": _string("jobGeo", "100% Remote"),
        "job_url": _string("url", ""),
        "is_remote": F.lit(True),
        "modality": F.lit("100% Remote"),
        "seniority": F.when(entry, F.lit(R.SENIORITY_LABEL)).otherwise(level),
        "_level_ok": level.isNotNull(),
        "post_date": _any_text(_get("pubDate")),
        "tags": _tags("jobTags", "tags"),
        "description_snippet": _first_text("jobDescription", "description"),
    })


def parse_remoteok(captures: DataFrame) -> DataFrame:
    """Feed D: array with a header element; id filter, then limit, then drop."""
    lists = _items(captures, "RemoteOK").withColumn(
        "_list", F.filter("_list", lambda i: F.try_variant_get(i, "$.id", "variant").isNotNull()))
    empty = lambda key: F.coalesce(_as_text(key), F.lit("")) == ""
    items = _explode(lists, "RemoteOK").filter(~(empty("position") | empty("url")))
    return _finish(items, {
        "job_id": _id("id", F.lit(_NONE)),
        "title": _string("position", ""),
        "company": _string("company", "N/A"),
        "location": F.lit("100% Remote"),
        "job_url": _string("url", ""),
        "is_remote": F.lit(True),
        "modality": F.lit("100% Remote"),
        "post_date": _any_text(_get("date")),
        "tags": _tags("tags"),
        "description_snippet": _string("description", ""),
    })


PARSERS = {
    "Arbeitnow": parse_arbeitnow,
    "Himalayas": parse_himalayas,
    "Jobicy": parse_jobicy,
    "RemoteOK": parse_remoteok,
}
