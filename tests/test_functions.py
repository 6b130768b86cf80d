import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedrank.functions import chars, dates, html as H, names as N, scores as S, text as T, urls as U


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


def test_strip_accents_and_casefold(spark):
    texts = ["Estágio", "ﬁn ½ №", "Straße ǖ É", "ｆｕｌｌ 𝐀", "Ελληνικά", "plain", "İ ŉ ς", "㎏ Ⅷ", "Й"]
    strip = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert values(spark, chars.strip_accents, texts) == strip
    assert values(spark, chars.casefold, texts) == [t.casefold() for t in texts]


@pytest.mark.parametrize("url, key", [
    ("HTTPS://Jobs.Example/p/1/?x=1#f", "url:https://jobs.example/p/1"),
    (" https://H.com/ ", "url:https://h.com"),
    ("//h/a/", "url://h/a"),
    ("http://u:P@Host:80/A b/c", "url:http://u:p@host:80/A b/c"),
    ("http://[::1]/x", "url:http://[::1]/x"),
    ("https://h.com", "job:ab:12:ção:ss"),
    ("http://[bad/a", "job:ab:12:ção:ss"),
    ("mailto:x", "job:ab:12:ção:ss"),
    ("", "job:ab:12:ção:ss"),
    (None, "job:ab:12:ção:ss"),
])
def test_dedup_key(spark, url, key):
    fn = lambda u: U.dedup_key(u, F.lit("A b"), F.lit("1-2"), F.lit("Ção"), F.lit("ß"))
    assert values(spark, fn, [url]) == [key]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="aZ/:?#.@ é[]", max_size=20), min_size=60, max_size=60))
def test_dedup_key_is_idempotent(spark, tails):
    urls = ["https://Host.example/" + t for t in tails] + tails
    once = [u for u in values(spark, U.canonical_url, urls) if u]
    # a host without a path is no canonical URL any more
    assert [t for t in values(spark, U.canonical_url, once) if t] == [u for u in once if u.count("/") > 2]


def test_url_helpers(spark):
    assert values(spark, U.last_segment, ["https://a/b/c?d", "x"]) == ["c?d", "x"]
    assert values(spark, U.id_after_dash, ["https://a/x-y-77", "plain"]) == ["77", "plain"]
    assert values(spark, lambda c: U.absolute_url(c, "https://b"), ["/x", "http://y"]) == ["https://b/x", "http://y"]
    assert values(spark, U.safe_url, ["https://a/?x=1&y=<", "ftp://a/b", "https:///x", ""]) == [
        "https://a/?x=1&amp;y=&lt;", "", "", ""]
    host = "dir.example"
    assert values(spark, lambda c: U.canonical_profile_url(c, F.lit("https://dir.example/companies/fb"), host),
                  ["https://DIR.example/companies/a/?q", "https://other/companies/a", "", "https://dir.example/companies/a/b"]) == [
        "https://dir.example/companies/a", None, "https://dir.example/companies/fb", None]


def test_names(spark):
    texts = ["X, S.A.", "SA", "Group SA", "A & B Group", "n/a", "日本", "Ação Portugal Lda"]
    assert values(spark, N.normalize_name, texts) == ["x", "sa", "group sa", "a and b", "n a", "日本", "acao portugal lda"]
    assert values(spark, N.company_key, texts)[:4] == ["xsa", "sa", "groupsa", "abgroup"]
    assert values(spark, N.slugify, ["A & B, Lda."]) == ["a-and-b-lda"]
    assert values(spark, N.alias_slug, ["  Volkswagen  GROUP ", "unknown"]) == ["volkswagen-digital-solutions", None]


def test_name_variants(spark):
    got = values(spark, N.name_variants, ["Alpha Conclusion Beta", "A&B", "Group SA"])
    assert got[0] == ["Alpha Conclusion Beta", "alpha conclusion beta", "alpha beta", "alpha", "beta"]
    assert got[1] == ["A and B", "AandB", "a and b"]
    assert got[2] == ["Group SA", "group sa", "sa", "group"]


@pytest.mark.parametrize("sought, found, expected", [
    ("Neo Firm Group", "NEO FIRM", 1.0),
    ("Neo", "Neo Firm", 0.85),
    ("Neo Firm", "Neo", 0.0),
    ("Further Learning Group", "Cambrian Learning Group", 0.0),
    ("", "x", 0.0),
])
def test_similarity(spark, sought, found, expected):
    assert values(spark, lambda c: N.similarity(F.lit(sought), c), [found]) == [expected]


def test_scores(spark):
    inputs = ["nan", "inf", "-inf", "x", None, "4.2"]
    assert values(spark, S.finite_or_zero, inputs) == [0.0, 0.0, 0.0, 0.0, 0.0, 4.2]
    assert values(spark, S.parse_score, ["0.5", "10", "nota 4,2", "none"]) == [5.0, 1.0, 4.2, None]
    assert values(spark, lambda c: S.reviews_text(c, F.lit("d")), ["12", "many", ""]) == ["12 Reviews", "many", "d"]
    assert values(spark, lambda c: S.salary_range(c, F.lit("2000.0"), F.lit("EUR")), ["1234567", "1.5", "x"]) == [
        "EUR 1,234,567 - 2,000.0", "EUR 1.5 - 2,000.0", None]
    assert values(spark, S.salary_in_text, ["paga €20 000 - €45 000 ano", "sem"]) == ["€20 000 - €45 000", None]


def test_dates_and_text(spark):
    assert values(spark, lambda c: dates.epoch_to_date(c.try_cast("double")), ["1700000000", "1e300", None]) == ["14/11/2023", None, None]
    assert values(spark, dates.day_month_in_text, ["em 14 AGO de", "14 xyz"]) == ["14 AGO", None]
    assert values(spark, T.pct_encode, ["a b+*~é/"]) == ["a%20b%2B%2A~%C3%A9%2F"]
    assert values(spark, T.html_escape, ["<a href='x'>&\""]) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"]
    assert values(spark, T.title_case, ["o'neil-smith ANA"]) == ["O'Neil-Smith Ana"]
    assert values(spark, T.truthy, [" Remote ", "TRUE", "0", None]) == [True, True, False, False]


def test_markup(spark):
    page = ('<p title="a>b">One <b>two</b></p><!-- <i>no</i> --><script>var x="<i>";</script>'
            "<p>A&nbsp;B &amp;lt; &#8364;&#x20AC; &eacute; &unknown;</p>")
    assert values(spark, H.page_text, [page]) == ["One two A B &lt; €€ é &unknown;"]
    tag = "<a data-href='n' class=x HREF = \"u?a=1&amp;b=2\">"
    assert values(spark, lambda c: H.attr(c, "href"), [tag, "<a>"]) == ["u?a=1&b=2", None]
    nested = '<div class="x"><div>in</div>end</div><div>after</div>'
    assert values(spark, lambda c: H.text_of(H.balanced(c, "div")), [nested]) == ["in end"]
    cards = values(spark, lambda c: H.first_element(c, tag="h3", class_name="t"), ['<h3 class="tt">a</h3><h3 class="s t">b</h3>', "<p>"])
    assert cards == ['<h3 class="s t">b</h3>', None]


def test_folding_of_every_code_point(spark):
    import pandas as pd
    from feedrank.functions import chars

    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c) != chr(c).casefold() or 0xAC00 <= c <= 0xD7A3
              or (0x80 <= c and not 0xD800 <= c <= 0xDFFF and strip(chr(c)) != chr(c))]
    frame = spark.createDataFrame(pd.DataFrame({"c": [chr(c) for c in points]})).repartition(8)
    rows = frame.select("c", chars.strip_accents(F.col("c")).alias("s"), chars.casefold(F.col("c")).alias("f")).collect()
    assert len(rows) > 15_000
    assert [r.c for r in rows if r.s != strip(r.c)] == []
    assert [r.c for r in rows if r.f != r.c.casefold()] == []


def test_sql_and_column_keys_are_one_definition(spark):
    from feedrank.functions import sql
    from feedrank.functions.names import company_key
    from feedrank.functions.urls import dedup_key

    sql.register(spark)
    names = ["\ufb01rma \u03c2", "Stra\u00dfe", "\u0587x", "\uac00\ub098", "\u092bx \u0929", "plain & co", "\u00c9l\u00e8ve"]
    frame = spark.createDataFrame([(None, "S", "1", n, n.upper()) for n in names], "u string, s string, j string, c string, t string")
    rows = frame.select(
        dedup_key(*map(F.col, "usjct")).alias("a"), F.expr("dedup_key(u, s, j, c, t)").alias("b"),
        company_key(F.col("c")).alias("x"), F.expr("company_key(c)").alias("y")).collect()
    assert all(r.a == r.b and r.a.startswith("job:") and r.x == r.y for r in rows)


def test_spans_of_random_and_large_pages(spark):
    """Against a stack, on nested, unclosed and stray tags; a page of 50,000 tags."""
    import random
    import re
    import time

    def stacked(page):
        stack, out = [], []
        for m in re.finditer(r"(?i)<(/?)li[\s>/]", page):
            if not m[1]:
                stack.append(m.start())
            elif stack:
                out.append((stack.pop(), m.start()))
        return sorted(out + [(a, len(page)) for a in stack])

    rng = random.Random(1)
    pages = ["".join(rng.choice(["<li>", "</li>", "<LI class='a'>", "</li >", "x", "<line>", "é<b>"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    pages += ["", "<li>", "</li></li><li>a", "<li><li></li>"]
    got = values(spark, lambda c: H.spans(c, "li"), pages)
    assert [[(s.start, s.end) for s in g] for g in got] == [stacked(p) for p in pages]
    assert values(spark, lambda c: H.spans(c, "li"), [None, "<li>"])[0] is None
    seconds = []
    for n in (5_000, 25_000):
        page = "<ul>" + "<li>item<b>x</b></li>" * n
        began = time.time()
        rows = values(spark, lambda c: F.size(H.spans(c, "li")), [page])
        seconds.append(time.time() - began)
        assert rows == [n]
    assert seconds[1] < 12 * max(seconds[0], 0.5)
