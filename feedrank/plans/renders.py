"""Captured pages and payloads, rendered from the fixture frames.

They exercise the feed parsers on data that grows with the tables. Each page
holds 25 items, so no group is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 25


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _pages(postings: DataFrame, item: Column, source: str, head: str, sep: str, tail: str, where: Column | None = None) -> DataFrame:
    """Group the items of each request into pages, in feed order."""
    rows = postings if where is None else postings.filter(where)
    key = F.col("item_ordinal")
    return (
        rows.withColumn("page_no", F.floor(key / (7 * PAGE)).cast("int"))
        .groupBy("query_ordinal", "page_no")
        .agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), item.alias("item")))).alias("items"))
        .select(
            F.lit(source).alias("source"),
            "query_ordinal",
            "page_no",
            F.lit(200).alias("status"),
            _text(head, F.array_join(F.col("items.item"), sep), tail).alias("body"),
            F.lit("Portugal").alias("base_location"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("captured_at"),
        )
    )


def _when(mod: int, *cases) -> Column:
    """case i when item_ordinal % mod == i, the last one otherwise."""
    key, out = F.col("item_ordinal") % mod, None
    for i, c in enumerate(cases[:-1]):
        out = F.when(key == i, c) if out is None else out.when(key == i, c)
    return out.otherwise(cases[-1]) if out is not None else cases[-1]


def feed_a(p: DataFrame) -> DataFrame:
    q = lambda c: _text('"', c, '"')
    seconds = F.unix_timestamp("captured_at").cast("string")
    item = _text(
        '{"slug":', F.col("job_id"),
        ',"title":', F.when(F.col("item_ordinal") % 101 == 0, F.lit("7")).otherwise(q(F.col("title"))),
        F.when(F.col("item_ordinal") % 13 == 0, F.lit("")).otherwise(_text(',"company_name":', q(F.col("company")))),
        F.when(F.col("item_ordinal") % 11 == 0, F.lit("")).otherwise(_text(',"location":', q(F.col("location")))),
        ',"url":', q(F.col("job_url")),
        _when(4, F.lit(',"remote":true'), F.lit(',"remote":" Remote "'), F.lit(',"remote":"no"'), F.lit("")),
        _when(3, _text(',"created_at":', seconds), F.lit(',"created_at":"2024-01-05"'), F.lit("")),
        _when(3, _text(',"tags":[', q(F.col("tags")[0]), ',"x"]'), _text(',"tags":', q(F.col("tags")[0])), F.lit(',"tags":null')),
        ',"description":"","job_description":"more"}',
    )
    return _pages(p, item, "Arbeitnow", '{"data":[', ",", "]}")


def feed_b(p: DataFrame) -> DataFrame:
    q = lambda c: _text('"', c, '"')
    item = _text(
        '{"title":', q(F.col("title")), ',"companyName":', q(F.col("company")),
        _when(4, _text(',"applicationLink":', q(_text("https://a.example/x/", F.col("job_id")))),
              _text(',"applicationLink":"","guid":', q(_text("https://g.example/", F.col("job_id")))),
              _text(',"companySlug":"c","slug":', q(F.col("job_id"))), F.lit(',"companySlug":"c"')),
        F.when(F.col("item_ordinal") % 2 == 0, _text(',"id":', F.col("job_id"))).otherwise(F.lit("")),
        _when(3, _text(',"minSalary":', F.col("job_id"), ',"maxSalary":1234567,"currency":"EUR"'),
              F.lit(',"minSalary":1000.5,"maxSalary":2000.0'), F.lit(',"minSalary":"1","maxSalary":2')),
        _when(3, F.lit(',"locationRestrictions":["Spain","",null,"Portugal"]'), F.lit(',"locationRestrictions":"Spain"'),
              F.lit(',"locationRestrictions":[]')),
        ',"pubDate":', F.unix_timestamp("captured_at").cast("string"), ',"excerpt":"e"}',
    )
    return _pages(p, item, "Himalayas", '{"jobs":[', ",", "]}")


def feed_c(p: DataFrame) -> DataFrame:
    q = lambda c: _text('"', c, '"')
    item = _text(
        '{"id":', F.col("job_id"), ',"jobTitle":', q(F.when(F.col("item_ordinal") % 9 == 0, F.lit("")).otherwise(F.col("title"))),
        ',"url":', q(F.col("job_url")), ',"companyName":', q(F.col("company")),
        _when(4, F.lit(',"jobLevel":"Entry-Level"'), F.lit(',"jobLevel":"Midweight, JUNIOR"'), F.lit(',"jobLevel":"Any"'), F.lit("")),
        _when(2, _text(',"jobTags":[],"tags":[', q(F.col("tags")[0]), "]"), _text(',"jobTags":', q(F.col("tags")[0]))),
        _when(3, F.lit(',"pubDate":"2024-02-03"'), F.lit(',"pubDate":17'), F.lit("")),
        ',"jobGeo":"EMEA","jobDescription":"d"}',
    )
    return _pages(p, item, "Jobicy", '{"jobs":[', ",", "]}")


def feed_d(p: DataFrame) -> DataFrame:
    q = lambda c: _text('"', c, '"')
    item = _text(
        "{", F.when(F.col("item_ordinal") % 17 == 0, F.lit('"x":1')).otherwise(_text('"id":', q(F.col("job_id")))),
        ',"position":', q(F.col("title")), ',"company":', q(F.col("company")), ',"url":', q(F.col("job_url")),
        ',"tags":[', q(F.col("tags")[0]), '],"date":"2024-03-04","description":null}',
    )
    return _pages(p, item, "RemoteOK", '[{"legal":"header"},', ",", "]")


def feed_e(p: DataFrame) -> DataFrame:
    card = _text(
        '<li><!-- <h3 class="base-search-card__title">hidden</h3> --><div class="card">',
        '<a class="base-card__full-link x" href="https://l.example/jobs/view/role-at-', F.col("job_id"), '?trk=a&amp;b=1">open</a>',
        F.when(F.col("item_ordinal") % 19 == 0, F.lit("")).otherwise(
            _text('<h3 class="base-search-card__title">\n  ', F.col("title"), " &amp; more\n</h3>")),
        F.when(F.col("item_ordinal") % 13 == 0, F.lit("")).otherwise(
            _text('<h4 class="base-search-card__subtitle"><a href="#"> ', F.col("company"), " </a></h4>")),
        F.when(F.col("item_ordinal") % 11 == 0, F.lit("")).otherwise(
            _text("<span class='job-search-card__location'>", F.col("location"), "</span>")),
        F.when(F.col("item_ordinal") % 2 == 0, F.lit('<time datetime="x">2 days ago</time>')).otherwise(F.lit("")),
        "</div></li>",
    )
    return _pages(p, card, "LinkedIn", "<html><script>var a='<li>';</script><ul>", "\n", "</ul></html>")


def feed_f(p: DataFrame) -> DataFrame:
    word = _when(4, F.lit("Lisboa, trabalho remoto"), F.lit("Porto híbrido"), F.lit("Remote"), F.lit("sede"))
    card = _text(
        '<div class="block details"><div><a class="title" href="/oferta/', (F.col("item_ordinal") - F.col("item_ordinal") % 2).cast("string"),
        '/slug">', F.when(F.col("item_ordinal") % 23 == 0, F.lit("ab")).otherwise(F.col("title")), "</a></div>",
        _when(3, _text('<a href="/empresa/1" title=" ', F.col("company"), ' "></a>'),
              _text('<a href="/empresa/1"><img src="x" alt="', F.col("company"), '"></a>'),
              F.lit("")),
        "<p>14 ago ", word, "</p>",
        F.when(F.col("item_ordinal") % 4 == 0, F.lit("<b>€20 000 - €45 000</b>")).otherwise(F.lit("")),
        "</div>",
    )
    return _pages(p, card, "ITJobs.pt", "<body>", "", '<div class="footer">Braga</div></body>')


def feed_g(p: DataFrame) -> DataFrame:
    card = _text(
        "<article class='c'>",
        _when(3, _text('<a class="job-card__title" href="/at/x/', F.col("job_id"), '?r=1">', F.col("title"), "</a>"),
              _text("<h2>", F.col("title"), '</h2><a href="https://o.example/', F.col("job_id"), '">go</a>'),
              _text('<h3 class="company-x">', F.col("title"), '</h3><a href="/z/', F.col("job_id"), '">go</a>')),
        _when(3, _text('<div class="job-card__company">', F.col("company"), "</div>"), _text("<h4>", F.col("company"), "</h4>"), F.lit("")),
        F.when(F.col("item_ordinal") % 2 == 0, _text('<span class="job-card__location"><i>', F.col("location"), "</i> <b>PT</b></span>"))
        .otherwise(F.lit("")),
        "</article>",
    )
    return _pages(p, card, "Landing.jobs", "<main>", "", "</main>")


def profile_pages(profiles: DataFrame, host: str) -> DataFrame:
    """(profile_id, slug, page_url, status, body); five page layouts."""
    key = F.col("profile_id")
    case = lambda *c: _layout(key % 5, c)
    score = F.format_string("%.1f", F.nanvl("numeric_score", F.lit(1.0)))
    slug = _text("firm-", key.cast("string"))
    count = F.col("review_count").cast("string")
    return profiles.select(
        "profile_id",
        slug.alias("slug"),
        _text(f"https://{host}/companies/", slug).alias("page_url"),
        F.lit(200).alias("status"),
        _text(
            "<html><head>",
            case(_text(f'<link rel="canonical" href="https://{host}/companies/', slug, '/">'), F.lit(""),
                 _text(f"<link href='https://{host.upper()}/companies/", slug, "' rel='canonical nofollow'>"), F.lit(""),
                 F.lit('<link rel="canonical" href="https://other.example/companies/x">')),
            "</head><body>",
            case(_text('<h1 class="big reduce-h1"> ', F.col("profile_name"), " </h1>"),
                 _text('<div class="company_header_basic_info"><p>x</p><h1>', F.col("profile_name"), "</h1></div>"),
                 _text('<span itemprop="itemReviewed"><meta itemprop="name" content="', F.col("profile_name"), ' "></span>'),
                 F.lit('<h1 class="reduce-h1">ERRO  404</h1>'), F.lit('<h1 class="reduce-h1">Other</h1>')),
            case(_text('<span itemprop="aggregateRating"><span>a</span><meta itemprop="ratingValue" content="',
                       F.replace(score, F.lit("."), F.lit(",")), '"><meta itemprop="reviewCount" content="', count, '"></span>'),
                 _text('<div class="score-value-wrapper"><b class="c_rating">', score, '</b></div><i class="label_rating_font">',
                       count, " Reviews</i>"), F.lit("<p>no score</p>"), F.lit(""), F.lit("")),
            "</body></html>",
        ).alias("body"),
    )


def _layout(key: Column, cases) -> Column:
    out = None
    for i, c in enumerate(cases[:-1]):
        out = F.when(key == i, c) if out is None else out.when(key == i, c)
    return out.otherwise(cases[-1])


def search_pages(companies: DataFrame) -> DataFrame:
    """(company_key, company, status, body) from (c_custkey, company_key, company)."""
    key = F.col("c_custkey")
    said = _layout(key % 5, (
        F.lit("Company <b>rating of 4.2</b> out of 5 stars from 1,234 company reviews"),
        F.lit("score 3,5/5 today"), F.lit("nothing to see"), F.lit("Rating 4 out of 5"), F.lit("4.9 stars here")))
    return companies.select(
        "company_key", "company",
        F.when(key % 37 == 0, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        _text(
            '<div class="result first"><a class="result__a" href="https://other.example/Overview/x">o</a> rating 1 out of 5</div>',
            '<div class="result"><a class="result__a" href="https://www.glassdoor.com/About/x">o</a> rating 2 out of 5</div>',
            F.when(key % 3 == 0, F.lit("")).otherwise(_text(
                '<div class="result"><a class="result__a" href="https://www.Glassdoor.com/',
                F.when(key % 2 == 0, F.lit("Overview")).otherwise(F.lit("reviews")), '/x-E', key.cast("string"),
                '.htm">t</a><div class="result__snippet">', said, "</div></div>")),
        ).alias("body"),
    )
