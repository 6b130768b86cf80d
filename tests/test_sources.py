import json

import pytest
from pyspark.sql import functions as F

from feedrank import sinks
from feedrank.schema import CAPTURE, conform
from feedrank.sources import captures as C, directory as D, documents, html_feeds as H, json_feeds as J
from feedrank.state import load_state, save_state, versions


def cap(spark, source, *bodies, status=200):
    rows = [(source, 0, i, status, b, "Lisbon", None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, CAPTURE)


def test_bad_item_does_not_stop_the_feed(spark):
    body = json.dumps({"data": [{"title": "a", "url": "u"}, 5, {"title": None}, {"title": "b", "company_name": 3}, {"title": "c", "tags": "x"}]})
    parsed = J.parse_arbeitnow(cap(spark, "Arbeitnow", body, "{broken"))
    good = C.accepted(parsed).orderBy("item_ordinal").collect()
    assert [(r.title, r.company, r.location, r.tags, r.post_date) for r in good] == [
        ("a", "N/A", "Remote / Europe", [], "Recente"), ("c", "N/A", "Remote / Europe", ["x"], "Recente")]
    assert sorted(r.reason for r in C.quarantine(parsed).collect()) == ["company is not text", "item is not an object", "title is not text"]
    assert C.broken_bodies(cap(spark, "Arbeitnow", body, "{broken")).count() == 1


def test_header_element_and_limit_order(spark):
    items = [{"legal": "x"}] + [{"id": i, "position": "" if i == 0 else f"t{i}", "url": "u"} for i in range(4)]
    frame = cap(spark, "RemoteOK", json.dumps(items)).withColumn("row_limit", F.lit(2))
    assert [r.title for r in C.accepted(J.parse_remoteok(frame)).collect()] == ["t1"]


def test_status_and_page_sequence(spark):
    page = '<li><h3 class="base-search-card__title">Role</h3><a class="base-card__full-link" href="https://x/a-1?t">x</a></li>'
    frame = cap(spark, "LinkedIn", page, page).withColumn("status", F.when(F.col("page_no") == 0, F.lit(429)).otherwise(F.lit(200)))
    assert H.parse_linkedin(frame).count() == 0
    row = H.parse_linkedin(cap(spark, "LinkedIn", page)).first()
    assert (row.title, row.company, row.location, row.job_url, row.job_id) == ("Role", "Confidencial", "Lisbon", "https://x/a-1", "1")


def test_listing_without_title_class_and_outside_blocks(spark):
    page = '<li><a href="/oferta/12/x">Junior Dev</a> <a href="/empresa/1">Firm <b>X</b></a> Braga híbrido</li>'
    row = H.parse_itjobs(cap(spark, "ITJobs.pt", page)).first()
    assert (row.job_id, row.title, row.company, row.location, row.modality) == ("12", "Junior Dev", "FirmX", "Braga, Portugal", "On-site / Hybrid")
    bare = H.parse_itjobs(cap(spark, "ITJobs.pt", '<a class="title" href="https://o/oferta/x">Junior Dev</a>')).first()
    assert (bare.job_id, bare.company, bare.location) == ("httpsoofertax", "Consultar Anúncio", "Portugal")


def test_job_card_layout(spark):
    page = ('<div class="job-card"><div><h2>Junior AI</h2></div><h3>Firm</h3><a href="/at/9?x=1">go</a>'
            '<p class="where">Remote</p></div><div class="job-card"><h2>No link</h2></div>')
    rows = H.parse_landing(cap(spark, "Landing.jobs", page)).collect()
    assert [(r.title, r.company, r.job_id, r.location, r.modality) for r in rows] == [("Junior AI", "Firm", "9", "Remote", "100% Remote")]


def test_profile_page(spark):
    body = ('<link rel="canonical" href="https://pt.teamlyzer.com/companies/neo"><div class="company_header_basic_info">'
            '<h1 class="reduce-h1">Neo Firm</h1></div><span itemprop="aggregateRating"><meta itemprop="ratingValue" content="2.5">'
            '<meta itemprop="reviewCount" content="{}"></span>')
    pages = spark.createDataFrame([("neo", "https://pt.teamlyzer.com/companies/neo", 200, body.format(n)) for n in (22, 0)],
                                  "slug string, page_url string, status int, body string")
    rows = D.parse_profile_pages(pages).collect()
    assert [(r.profile_name, r.score, r.numeric, r.reviews) for r in rows] == [
        ("Neo Firm", "2.5/5", 2.5, "22 Reviews"), (None, "2.5/5", 2.5, "0 Reviews")]


def test_search_results(spark):
    body = ('<div class="result"><a class="result__a" href="https://www.glassdoor.com/Overview/A.htm">A</a>'
            '<a class="result__snippet">rating of 4.2 out of 5 stars from 100 company reviews</a></div>')
    pages = spark.createDataFrame([("a", "A b", 200, body), ("c", "C", 503, body)], "company_key string, company string, status int, body string")
    rows = {r.company_key: r.rating for r in D.search_ratings(pages).collect()}
    # the count is found only when no other digit stands before it
    assert (rows["a"].score, rows["a"].reviews, rows["a"].url) == (
        "4.2/5", "100 Reviews", "https://www.glassdoor.com/Search/results.htm?keyword=A%20b")
    assert rows["c"] is None


def test_documents(spark, tmp_path):
    cache = tmp_path / "cache.json"
    cache.write_text(json.dumps({"a": {"platform": "P", "numeric": 3, "score": "3.0/5"}, "b": 7}))
    assert [(r.company_key, r.numeric) for r in documents.read_cache(spark, str(cache)).collect()] == [("a", 3.0)]
    assert documents.read_cache(spark, str(tmp_path / "none.json")).count() == 0
    person = tmp_path / "p.json"
    person.write_text(json.dumps({"name": "R", "skills": ["Python"], "projects": [{"name": "x"}]}, indent=1))
    assert documents.read_profile(spark, str(person)).first().projects[0].name == "x"
    person.write_text('{"name": "R", ')
    assert documents.read_profile(spark, str(person)).count() == 0
    assert documents.read_profile(spark, str(tmp_path / "no.json")).count() == 0


def test_captures_and_bodies(spark, tmp_path):
    frame = cap(spark, "Arbeitnow", "{}")
    frame.write.parquet(str(tmp_path / "c"))
    landed = C.read_captures(spark, str(tmp_path / "c"))
    assert landed.columns == [*CAPTURE.names, "run_id"] and landed.first().run_id == ""
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "page-3.html").write_text("<li>\n</li>")
    row = C.read_bodies(spark, str(tmp_path / "b"), "LinkedIn", 4).first()
    assert (row.page_no, row.query_ordinal, row.body) == (3, 4, "<li>\n</li>")


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("s", 'a "b"\nc, d', ["x"])], "source string, title string, tags array<string>")
    full = conform(rows, run_ts="2024-01-01 00:00:00")
    sinks.write_csv(full, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, str(tmp_path / "csv")).first()
    assert (back.title, back.tags, back.job_id, back.fetched_at) == ('a "b"\nc, d', '["x"]', "", "2024-01-01 00:00:00")
    sinks.write_json(full, str(tmp_path / "json"))
    assert documents.read_published(spark, str(tmp_path / "json")).first().title == 'a "b"\nc, d'
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    assert '"salary":null' in text
    sinks.write_csv(full.limit(0), str(tmp_path / "csv"))
    assert sinks.read_csv(spark, str(tmp_path / "csv")).count() == 0


def test_state_versions(spark, tmp_path):
    root = str(tmp_path / "state")
    assert load_state(spark, root).count() == 0 and versions(spark, root) == []
    one = documents.explode_cache(spark.createDataFrame([('{"a":{"platform":"P"}}',)], "body string"))
    assert save_state(one, root) == 1
    assert save_state(load_state(spark, root).unionByName(one), root) == 2
    (tmp_path / "state" / "v=3").mkdir()  # a job that died
    assert load_state(spark, root).count() == 2 and load_state(spark, root, before=2).count() == 1


def test_offers_outside_the_blocks_and_in_any_kind_are_kept(spark):
    pages = (
        '<div class="details">side</div><ul><li><a href="/oferta/1/x">Junior A</a> Porto</li><li><a href="/oferta/2/x">Junior B</a> Braga</li></ul>',
        '<div class="details"><a href="/oferta/3/x">Junior C</a> Porto</div><li><a href="/oferta/4/x">Junior D</a> Braga</li>',
        '<li><div>x</div><a href="/oferta/5/x">Junior E</a> Braga</li>',
    )
    rows = H.parse_itjobs(cap(spark, "ITJobs.pt", *pages)).orderBy("item_ordinal").collect()
    assert [(r.job_id, r.location) for r in rows] == [
        ("1", "Porto, Portugal"), ("2", "Braga, Portugal"), ("3", "Porto, Portugal"), ("4", "Braga, Portugal"), ("5", "Braga, Portugal")]


def test_card_with_an_inner_list_is_kept(spark):
    page = ('<li><ul><li>tag</li><li>other</li></ul><h3 class="base-search-card__title">Role</h3>'
            '<a class="base-card__full-link" href="https://x/a-1?t">x</a></li>')
    assert [r.title for r in H.parse_linkedin(cap(spark, "LinkedIn", page)).collect()] == ["Role"]


def test_very_long_tags_do_not_end_the_job(spark):
    from feedrank.functions import html as M

    tags = ("<a " + "x" * 1_000_000 + ' href="u1">', '<a d="' + "y" * 1_000_000 + '" ' + 'k="v" ' * 20_000 + "href=u2>",
            '<a title="unclosed ' + "z" * 500_000, '<a title="x href=2" href="3">')
    frame = spark.createDataFrame(list(enumerate(tags)), "i int, tag string")
    assert [r[0] for r in frame.orderBy("i").select(M.raw_attr(F.col("tag"), "href")).collect()] == ["u1", "u2", None, "3"]


def test_runs_are_handled_each_for_itself(spark):
    from feedrank.operators import limits

    rows = [("LinkedIn", 0, page, 429 if run == "d1" and page == 0 else 200, "x", None, None, run)
            for run in ("d1", "d2") for page in range(3)]
    from feedrank.schema import CAPTURE_OF_RUN

    captures = spark.createDataFrame(rows, CAPTURE_OF_RUN)
    kept = limits.ok_pages(captures).groupBy("run_id").count().collect()
    assert [(r.run_id, r["count"]) for r in kept] == [("d2", 3)]
    cards = spark.range(50).select(F.concat(F.lit("d"), F.col("id") % 2).alias("run_id"), F.lit("LinkedIn").alias("source"),
                                   F.lit(0).alias("query_ordinal"), F.col("id").alias("item_ordinal"))
    requests = limits.manifest(spark, [("LinkedIn", "q", 30, None), ("Other", "q", None, None)])
    assert limits.limit_by_manifest(cards, requests).count() == 50
    assert limits.limit_by_manifest(cards.withColumn("run_id", F.lit("d")), requests).count() == 30
    other = cards.withColumn("source", F.lit("Other")).withColumn("query_ordinal", F.lit(1))
    assert limits.limit_by_manifest(other.unionByName(cards.withColumn("run_id", F.lit("d"))), requests).count() == 80


def test_nothing_landed_is_lost(spark):
    from feedrank.operators import limits
    from feedrank.plans.daily import ingest

    good = json.dumps({"data": [{"title": "a", "url": "u"}, {"title": None}]})
    landed = cap(spark, "Arbeitnow", good, good[:-3], json.dumps({"data": {"title": "x"}}), "")
    postings, aside = ingest(landed, limits.manifest(spark, [("Arbeitnow", "q", None, None)]))
    assert [r.title for r in postings.collect()] == ["a"]
    assert sorted(r.reason for r in aside.collect()) == [
        "body has no list of items", "body is not JSON", "body is not JSON", "title is not text"]


@pytest.mark.parametrize("parse, source, pattern, times", [
    (H.parse_itjobs, "ITJobs.pt", r"(?=<a[\s>/])", 1),
    (H.parse_itjobs, "ITJobs.pt", "/empresa/", 3),  # named once for each kind of quotes and bare
    (H.parse_linkedin, "LinkedIn", "base-search-card__title", 3),
    (H.parse_landing, "Landing.jobs", "company|employer", 2),
])
def test_no_filter_and_no_lambda_holds_a_copy_of_the_work_on_a_page(spark, tmp_path, parse, source, pattern, times):
    spark.createDataFrame([(source, 0, 0, 200, "<p></p>", None, None)], CAPTURE).write.parquet(str(tmp_path / "pages"))
    parsed = parse(spark.read.parquet(str(tmp_path / "pages")))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count(pattern) == times


def test_fields_of_an_item_are_taken_in_one_walk(spark):
    """Each field is one read of the item; what an item holds besides is not looked at."""
    items = [{"title": "a", "url": "u", "tags": ["x", 1], "remote": True, "deep": {"title": "no"}}, {"title": 7, "url": "u"}, [1], "t", None,
             {"title": None, "url": "u"}, {"url": {"a": 1}, "title": ""}]
    parsed = J.parse_arbeitnow(cap(spark, "Arbeitnow", json.dumps({"data": items})))
    got = [(r.title, r.tags, r.is_remote, r.reject_reason) for r in parsed.orderBy("item_ordinal").collect()]
    assert got == [("a", ["x", "1"], True, None), (None, [], False, "title is not text"), *[("", [], False, "item is not an object")] * 3,
                   (None, [], False, "title is not text"), ("", [], False, "job_url is not text")]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get(item") == 1


def test_elements_are_the_texts_of_the_spans(spark):
    from feedrank.functions import html as M

    pages = ["<ul><LI>a</li>x<li class='b'>b<link></Li ><li>c", "</li><li>a<li>b</li>c</li></li><li/>d", "<lix>no</lix>", "", None, "<li>é\n", "a<li>1</li><li>2</li>\n"]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    cut = F.transform(M.spans(F.col("html"), "li"), lambda s: M.cut(F.col("html"), s))
    rows = frame.select("i", M.elements(F.col("html"), "li").alias("new"), cut.alias("old")).orderBy("i").collect()
    assert [r.new for r in rows] == [r.old for r in rows] and rows[1].new == ["<li>a<li>b</li>c", "<li>b", "<li/>d"]


def test_only_items_set_aside_are_written_as_they_came(spark, tmp_path, monkeypatch):
    from feedrank.operators import limits
    from feedrank.plans import daily

    written = []
    monkeypatch.setattr(daily, "materialize", lambda df, label: written.append(df) or df)
    page = '<li><h3 class="base-search-card__title">Role</h3><a class="base-card__full-link" href="https://x/a-1?t">x</a></li>'
    body = json.dumps({"data": [{"title": "a", "url": "u"}, {"title": None}]})
    landed = cap(spark, "Arbeitnow", body).unionByName(cap(spark, "LinkedIn", page))
    postings, aside = daily.ingest(landed, limits.manifest(spark, [("Arbeitnow", "q", None, None)]))
    assert sorted(r.title for r in postings.collect()) == ["Role", "a"]
    assert [r.raw for r in written[0].collect() if r.raw] == ['{"title":null}'] == [r.body for r in aside.collect()]
