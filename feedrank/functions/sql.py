"""The name and key functions for use from SQL text.

Temporary SQL functions: Spark inlines them, so they cost what the Column
functions cost.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import rules
from .chars import _NOT_ASCII, FOLDER, NORMALIZER, marks
from .text import quote_java
from .urls import _IP_LITERAL, _SPLIT


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _unicode(method: tuple[str, str]) -> str:
    return f"reflect({_lit(method[0])}, {_lit(method[1])}, s, true)"


def _unless_ascii(folded: str, plain: str) -> str:
    return f"CASE WHEN s RLIKE {_lit(_NOT_ASCII)} THEN {folded} ELSE {plain} END"


def register(spark: SparkSession, suffixes=rules.SUFFIX_TOKENS) -> None:
    """Create fold_name, company_key, slugify, normalize_name, name_similarity,
    canonical_url and dedup_key in the session."""
    tail = "|".join(quote_java(s) for s in suffixes)
    clean = f"translate(regexp_replace(u, {_lit(r'(?U)^\s+|\s+$')}, ''), {_lit(chr(9) + chr(13) + chr(10))}, '')"
    part = lambda i: f"regexp_extract({clean}, {_lit(_SPLIT)}, {i})"
    plain = lambda c: f"regexp_replace(fold_case(coalesce({c}, '')), {_lit('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}, '')"
    functions = {
        "strip_marks(s STRING)": _unless_ascii(f"regexp_replace({_unicode(NORMALIZER)}, {_lit(marks())}, '')", "s"),
        "fold_case(s STRING)": _unless_ascii(_unicode(FOLDER), "lower(s)"),
        "fold_name(s STRING)": "lower(strip_marks(s))",
        "company_key(s STRING)": "regexp_replace(fold_name(s), '[^a-z0-9]', '')",
        "slugify(s STRING)": "trim(BOTH '-' FROM regexp_replace(replace(fold_name(s), '&', ' and '), '[^a-z0-9]+', '-'))",
        "normalize_folded(f STRING)": f"""coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_replace(
            replace(regexp_replace(f, {_lit(r'(?U)^\s+|\s+$')}, ''), '&', ' and '), {_lit(rules.LEGAL_FORM)}, ' '), '[^a-z0-9]+', ' ')),
            {_lit(f'(?:(?:^| )(?:{tail}))+$')}, ''), ''), regexp_replace(f, {_lit(r'(?U)^\s+|\s+$')}, ''))""",
        "normalize_name(s STRING)": "normalize_folded(fold_name(s))",
        "norm_similarity(a STRING, b STRING)": f"""CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.0D
            WHEN a = b THEN 1.0D WHEN size(array_except(split(a, {_lit(r'(?U)\s+')}), split(b, {_lit(r'(?U)\s+')}))) = 0 THEN 0.85D
            ELSE 0.0D END""",
        "name_similarity(a STRING, b STRING)": "norm_similarity(normalize_name(a), normalize_name(b))",
        "canonical_url(u STRING)": f"""CASE WHEN {part(2)} <> '' AND {part(3)} <> ''
            AND NOT ({part(2)} RLIKE {_lit(r'[\[\]]')} AND NOT {part(2)} RLIKE {_lit(_IP_LITERAL)})
            THEN concat(CASE WHEN {part(1)} = '' THEN '//' ELSE concat(lower({part(1)}), '://') END, lower({part(2)}),
             regexp_replace({part(3)}, '/+$', '')) END""",
        "dedup_key(u STRING, source STRING, job_id STRING, company STRING, title STRING)": f"""coalesce(concat('url:', canonical_url(u)),
            concat('job:', concat_ws(':', {', '.join(plain(c) for c in ('source', 'job_id', 'company', 'title'))})))""",
    }
    kinds = {"norm_similarity": "DOUBLE", "name_similarity": "DOUBLE"}
    for signature, body in functions.items():
        kind = kinds.get(signature.split("(")[0], "STRING")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
