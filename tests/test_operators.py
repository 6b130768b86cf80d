import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from feedrank import rules as R
from feedrank.functions.names import similarity
from feedrank.operators import classify, contacts, containment, dedup, limits, ranking, ratings, report, resolve, skew, watchlist
from feedrank.schema import OUTREACH, POSTING, RATING, RATING_STATE, conform

COLS = "query_ordinal int, item_ordinal long, source string, job_id string, title string, company string, " \
       "location string, modality string, job_url string, tags array<string>, description_snippet string"


def posts(spark, *rows):
    out = []
    for i, row in enumerate(rows):
        base = dict(query_ordinal=0, item_ordinal=i, source="Test", job_id=str(i), title="Junior AI Engineer",
                    company="Example", location="Portugal", modality="Unknown", job_url=f"https://jobs.example/{i}",
                    tags=[], description_snippet=None)
        base.update(row)
        out.append(tuple(base[c.split()[0]] for c in COLS.split(", ")))
    return spark.createDataFrame(out, COLS)


ACCEPTED = [
    "Junior AI Engineer", "Gen AI Trainee", "Machine Learning Intern", "NLP Junior Research Scientist",
    "Data Science Internship", "ESTÁGIO em Inteligência Artificial", "Graduate Data Scientist",
    "Early Career AI Engineer", "Bolsa de Investigação em Machine Learning", "  Jr. AI Engineer ",
]
REJECTED = [
    ("AI Engineer", "Example"), ("Professional AI Engineer", "Example"), ("Junior Program Manager, AI", "Example"),
    ("Junior AI Engineer / Senior AI Engineer", "Example"), ("Junior AI Lead", "Example"),
    ("Junior Data Scientist", "DELOITTE Iberia"), ("Junior Software Engineer (JR/PL)", "Example"),
    ("Mid-Level AI Developer", "Example"), ("Director of Artificial Intelligence", "Example"), ("Junior Cook", "Example"),
]


def test_prefilter(spark):
    rows = [dict(title=t) for t in ACCEPTED] + [dict(title=t, company=c) for t, c in REJECTED]
    kept = classify.prefilter(posts(spark, *rows)).select("title", "category", "seniority").collect()
    assert sorted(r.title for r in kept) == sorted(ACCEPTED)
    assert {(r.category, r.seniority) for r in kept} == {(R.CATEGORY_AI, R.SENIORITY_LABEL)}


def test_topic_ladder_ignores_description(spark):
    df = posts(spark, dict(title="Software Engineer Intern", tags=["AI"], description_snippet="artificial intelligence"),
               dict(title="Trainee", tags=["nlp"]), dict(title="Trainee", tags=["devops"]), dict(title="Trainee", tags=None))
    got = df.select("job_id", classify.topic(F.col("title"), F.col("tags")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == ["SWE", "AI", "SWE", None]


def test_rules_from_table(spark):
    table = R.DEFAULT_RULES.to_table(spark).filter(F.col("rule_set") == "entry").limit(1)
    assert R.Rules().with_table(table).entry == (R.ENTRY_PATTERNS[0],)
    with pytest.raises(ValueError):
        R.Rules().with_table(R.DEFAULT_RULES.to_table(spark), max_patterns=3)


def test_eligibility(spark):
    rows = [(R.CATEGORY_AI, None), (R.CATEGORY_SWE, 3.0), (R.CATEGORY_SWE, 3.1), (R.CATEGORY_SWE, float("nan")),
            (R.CATEGORY_SWE, float("inf")), ("Other", 5.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "c string, s double")
    got = [r.e for r in df.select(classify.is_eligible(F.col("c"), F.col("s")).alias("e")).collect()]
    assert got == [True, False, True, False, False, False, False]


def test_first_seen_keeps_first_row_that_passes(spark):
    df = posts(spark, dict(title="Senior AI Engineer", job_url="https://a/1"), dict(job_url="https://A/1/", query_ordinal=1),
               dict(job_url="https://a/1?x", query_ordinal=0), dict(job_url="https://a/2"))
    kept = dedup.first_seen(classify.prefilter(df)).select("job_id").collect()
    assert sorted(r.job_id for r in kept) == ["2", "3"]


def test_dedup_in_feed_counts_short_titles(spark):
    df = posts(spark, dict(job_id="7", title="x"), dict(job_id="7"), dict(job_id="", title="none"))
    assert [r.title for r in dedup.dedup_in_feed(df).collect()] == ["x"]


def test_rank_is_a_permutation_in_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0.0, 3.1, 4.4, None, float("nan")]), rng.choice(["b", "A", "ß"]), str(i), f"u{i % 40}", 0, i)
            for i in range(500)]
    df = spark.createDataFrame(
        rows, "rating_score double, company string, title string, job_url string, query_ordinal int, item_ordinal long"
    ).repartition(7)
    got = sorted(ranking.ranked(df).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 501))
    score = lambda v: 0.0 if v is None or v != v else v
    keys = [(-score(r.rating_score), r.company.casefold(), r.title.casefold(), r.job_url) for r in got]
    assert keys == sorted(keys)
    assert [r.title for r in ranking.top_n(df, 5).collect()] == [r.title for r in got[:5]]
    with pytest.raises(ValueError):
        ranking.top_n(df, -1)


def test_position_in_groups(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"), (F.lit(1000) - F.col("id")).alias("o")).repartition(5)
    got = ranking.with_position(df, "n", [F.col("o")], groups=["g"]).collect()
    for g in range(3):
        part = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert [r.n for r in part] == list(range(1, 101))
        assert [r.o for r in part] == sorted(r.o for r in part)


@pytest.mark.parametrize("cell_rows", [10_000, 4, 1])
def test_best_candidates_equals_all_pairs(spark, cell_rows):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "common", "group"]
    name = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    sought = resolve.with_norm(spark.createDataFrame([(f"k{i}", name()) for i in range(30)] + [("z", "nothing")],
                                                     "company_key string, company string"))
    cands = resolve.with_norm(spark.createDataFrame([(i, name()) for i in range(60)], "profile_id long, profile_name string"),
                              "profile_name")
    pairs = sought.crossJoin(cands).select(
        "company_key", "profile_id", similarity(F.col("company"), F.col("profile_name")).alias("s")).filter("s >= 0.45").collect()
    expected = set()
    for key, rows in itertools.groupby(sorted(pairs), key=lambda r: r.company_key):
        best = sorted(rows, key=lambda r: (-r.s, r.profile_id))[:3]
        expected |= {(key, r.profile_id, r.s, i + 1) for i, r in enumerate(best)}
    got = resolve.best_candidates(sought, cands, k=3, cell_rows=cell_rows).collect()
    assert {(r.company_key, r.profile_id, r.similarity, r.place) for r in got} == expected


def test_containment_with_a_frequent_word(spark):
    """A third of the sought names share one word, a third of the candidates another: cells stay small, nothing is lost."""
    rng = random.Random(5)
    sought = [(f"n{i}", ["acme", f"city{rng.randint(0, 40)}", f"x{rng.randint(0, 3)}"] if i % 3 == 0 else [f"w{i % 50}", f"city{i % 41}"])
              for i in range(600)]
    sets = [(i, ["acme"] * (i % 5 == 0) + ["group"] * (i % 3 == 0) + [f"city{i % 41}", f"x{i % 4}", f"w{i % 50}"]) for i in range(900)]
    sought += [("only", ["group"]), ("both", ["acme", "group"]), ("none", ["acme", "absent"])]
    left = spark.createDataFrame(sought, "name string, words array<string>")
    right = spark.createDataFrame(sets, "id long, words array<string>")
    want = {n: [i for i, s in sets if set(w) <= set(s)] for n, w in sought}
    for cell_rows in (2_000, 20, 3):
        got = collections.defaultdict(set)
        for r in containment.holders(left, right, 8, cell_rows).collect():
            got[r.name].add(r.id)
        assert all(got[n] <= set(ids) and set(ids[:8]) <= got[n] for n, ids in want.items())
    nodes = spark.createDataFrame([("acme", 200, 180)], "node string, n_sought long, n_holding long")
    seeking = left.filter("array_contains(words, 'acme')").select("name", F.lit("acme").alias("node"), F.col("words").alias("path"))
    holding = right.filter("array_contains(words, 'acme')").withColumn("node", F.lit("acme"))
    for side in containment.compared(seeking, holding, nodes, 20):
        sizes = [r["count"] for r in side.groupBy("node", "i", "j").count().collect()]
        assert len(sizes) > 60 and max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]


def test_salted_join_equals_plain_join(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 600, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "key string, v int")
    counts = left.groupBy("key").count()
    hot = skew.hot_keys(counts, "key", "count", rows_per_salt=100)
    assert [(r.key, r._salts) for r in hot.collect()] == [("hot", 6)]
    got = skew.salted_left_join(left, right, "key", hot, "id").select("id", "v")
    assert sorted(got.collect()) == sorted(left.join(right, "key", "left").select("id", "v").collect())


def directory(spark, *rows):
    base = [(i, s, n, st, "4.0/5", 4.0, "3 Reviews", f"https://d/companies/{s}") for i, (s, n, st) in enumerate(rows)]
    df = spark.createDataFrame(base, "profile_id long, slug string, profile_name string, status int, score string, "
                                     "numeric double, reviews string, url string")
    return resolve.index_directory(df)


def companies(spark, *names):
    return resolve.companies_of(posts(spark, *[dict(company=n) for n in names]))


def test_primary_lookup(spark):
    pages = directory(
        spark, ("neo", "Neo Conclusion", 200), ("down", "Down Labs", 503), ("prime-it", "Another Label", 200),
        ("solo-portugal", "Solo", 200), ("wrong", "Unrelated", 200), ("404", "Gone", 404))
    names = ["Neo Conclusion", "Down Labs", "PrimeIT", "Solo", "Wrong", "Gone", "Missing"]
    got = {r.company_key: r for r in resolve.primary_lookup(companies(spark, *names), pages).collect()}
    assert {k: r.lookup_status for k, r in got.items()} == {
        "neoconclusion": "HIT", "downlabs": "UNAVAILABLE", "primeit": "HIT", "solo": "HIT", "wrong": "MISS",
        "gone": "MISS", "missing": "MISS"}
    assert got["primeit"].rating.alias_match and not got["neoconclusion"].rating.alias_match
    assert got["neoconclusion"].rating.url == "https://d/companies/neo"


NOW = 1_700_000_000


def entry(key, platform, matched=None, url="https://d/companies/x", checked=None, numeric=4.0, reviews="3 Reviews", alias=None):
    return (key, platform, "4.0/5", numeric, reviews, url, matched, alias, checked)


def test_decision_table(spark):
    P, G = R.PRIMARY_PLATFORM, R.FALLBACK_PLATFORM
    state = spark.createDataFrame([
        entry("legacygood", P, url="https://d/companies/legacy-good"),
        entry("legacybad", P, url="https://d/companies/elsewhere"),
        entry("named", P, matched="Named"),
        entry("renamed", P, matched="Different Firm"),
        entry("suspicious", P, matched="Suspicious", numeric=5.0, reviews="0 reviews"),
        entry("fresh", G, checked=NOW - 10),
        entry("stalehit", G, checked=NOW - 90_000),
        entry("stalemiss", G),
        entry("staledown", G),
        entry("na", P, matched="N/A"),
    ], RATING_STATE)
    names = ["Legacy Good", "Legacy Bad", "Named", "Renamed", "Suspicious", "Fresh", "Stale Hit", "Stale Miss", "Stale Down",
             "N/A", "New Hit", "New Miss", "New Down"]
    cos = companies(spark, *names)
    asked = {r.company_key for r in ratings.needs_lookup(cos, state, NOW).collect()}
    assert asked == {"legacybad", "renamed", "suspicious", "stalehit", "stalemiss", "staledown", "newhit", "newmiss", "newdown"}
    hit = (P, "3.3/5", 3.3, "9 Reviews", "u", "n", False, None)
    lookup = spark.createDataFrame(
        [(k, "HIT", hit) for k in ("stalehit", "newhit")] + [(k, "MISS", None) for k in ("stalemiss", "newmiss", "legacybad")]
        + [(k, "UNAVAILABLE", None) for k in ("staledown", "newdown", "renamed", "suspicious")],
        f"company_key string, lookup_status string, rating {RATING.simpleString()}")
    second = ratings.fallback_ratings(cos, spark.createDataFrame([], lookup.select("company_key", "rating").schema))
    decided = ratings.decide(cos, state, lookup, second, NOW)
    got = {r.company_key: r for r in decided.collect()}
    assert {k: r.action for k, r in got.items()} == {
        "legacygood": "none", "legacybad": "insert", "named": "none", "renamed": "delete", "suspicious": "delete",
        "fresh": "none", "stalehit": "replace", "stalemiss": "stamp", "staledown": "none", "na": "none",
        "newhit": "replace", "newmiss": "insert", "newdown": "none"}
    assert got["na"].rating is None and got["newdown"].rating is None and got["renamed"].rating is None
    assert got["staledown"].rating.platform == G and got["stalemiss"].rating.checked_at == NOW
    assert got["newmiss"].rating.score == R.UNRATED and got["newmiss"].rating.checked_at == NOW
    after = {r.company_key: r for r in ratings.upsert(state, decided).collect()}
    assert "renamed" not in after and after["stalehit"].score == "3.3/5" and after["fresh"].checked_at == NOW - 10
    # a second run of the same batch changes nothing
    state2 = ratings.upsert(state, decided)
    again = ratings.decide(cos, state2, lookup, second, NOW)
    assert sorted(ratings.upsert(state2, again).collect()) == sorted(state2.collect())


def test_rating_display(spark):
    row = lambda s: (R.PRIMARY_PLATFORM, s, 4.0, "3 Reviews", "u", None, None, None)
    df = spark.createDataFrame([("a", row("4.0/5")), ("b", row(R.UNRATED)), ("c", None)], f"k string, rating {RATING.simpleString()}")
    got = {r.k: (r.rating_score, r.company_score) for r in ratings.apply_rating(df).collect()}
    assert got == {"a": (4.0, "★ 4.0/5 (Teamlyzer)"), "b": (4.0, "🔍 Teamlyzer"), "c": (0.0, None)}


def test_targets_of_a_table(spark):
    """A table of targets gives the rows of the same list; short, empty, repeated and null targets, and null fields."""
    rng = random.Random(9)
    df = posts(spark, *[dict(company=rng.choice(["Acme Labs", "ÁREA Um", "", None, "aa", "Zeta"]), title=rng.choice(["Junior", "Data área", None, "aaa"]))
                        for _ in range(80)])
    for targets in (["acme", "área", "a", "aa", "aaa", "zeta", "nobody", "labs", "ju", "e l", "acme labs x"], ["", "ta"], ["none"]):
        table = spark.createDataFrame([(t,) for t in [*targets, targets[0], None]], "target string")
        listed, looked = (watchlist.target_counts(df, t).collect() for t in (targets, table))
        assert sorted(map(tuple, listed)) == sorted(map(tuple, looked))
        assert sorted(map(tuple, watchlist.target_matches(df, table).select("target", "job_id").collect())) == sorted(
            map(tuple, watchlist.target_matches(df, targets).select("target", "job_id").collect()))


def test_many_targets(spark):
    targets = spark.range(100_000).select(F.concat(F.lit("firm "), F.col("id")).alias("target"))
    df = spark.range(400).select(F.concat(F.lit("Firm "), F.col("id") * 7, F.lit(" Lda")).alias("company"), F.lit("x").alias("title"))
    counts = watchlist.target_counts(df, targets)
    names = [f"firm {7 * i} lda" for i in range(400)]
    want = sum(name.startswith(f"firm {n}") for name in names for n in {name.split()[1][:k] for k in range(1, 5)})
    assert counts.count() == 100_000 and counts.agg(F.sum("n")).first()[0] == want


def test_sections_and_targets(spark):
    df = posts(spark, dict(location="Lisboa", modality="Remote"), dict(location="World", modality="100% Remote"),
               dict(location="100% remote"), dict(location="Porto", company="Siemens Labs", title="Junior AI at VOLKSWAGEN"))
    got = [r.s for r in df.select("job_id", report.section(F.col("location"), F.col("modality")).alias("s")).orderBy("job_id").collect()]
    assert got == [1, 2, 2, 3]
    assert {r.section: r.n for r in report.section_counts(df.limit(1)).collect()} == {1: 1, 2: 0, 3: 0}
    counts = {r.target: r.n for r in watchlist.target_counts(df).collect()}
    assert counts == {"tensorops": 0, "volkswagen": 1, "euronext": 0, "innowave": 0, "siemens": 1, "priberam": 0}


def test_status_gate_and_limits(spark):
    pages = spark.createDataFrame([("s", 0, p, 429 if p == 2 else 200) for p in range(5)] + [("s", 1, 0, 200)],
                                  "source string, query_ordinal int, page_no int, status int")
    assert sorted((r.query_ordinal, r.page_no) for r in limits.ok_pages(pages).collect()) == [(0, 0), (0, 1), (1, 0)]
    requests = limits.manifest(spark)
    assert requests.count() == 42
    by_source = {r.source: r["count"] for r in requests.groupBy("source").count().collect()}
    assert by_source == {"LinkedIn": 19, "ITJobs.pt": 6, "Landing.jobs": 4, "Himalayas": 6, "Jobicy": 3, "Arbeitnow": 2, "RemoteOK": 2}


# --- contacts ------------------------------------------------------------------------

DIR = "company_key string, area string, tier int, query_ordinal int, result_ordinal int, title string, link string, snippet string"


def profile(spark, skills=("Python",), projects=()):
    from feedrank.sources.documents import PROFILE

    return spark.createDataFrame(
        [dict(name="R", skills=list(skills), projects=[dict(name=p, description="", technologies=[]) for p in projects],
              education=[], experience=[])], PROFILE)


def outreach(spark, rows, job=None, **person):
    df = dedup.with_dedup_key(posts(spark, job or dict(company="Tech Firm")))
    best = contacts.best_contact(spark.createDataFrame(rows, DIR))
    return contacts.with_outreach(df, best, profile(spark, **person)).first().human_outreach


def test_manager_found(spark):
    o = outreach(spark, [("techfirm", None, 0, 1, 0, "jo march - Head of AI & Machine Learning - Tech Firm | LinkedIn",
                          "https://pt.linkedin.com/in/jo?x=1", "Leading the ML team in Lisbon, we are hiring")],
                 projects=["RAG search"])
    assert (o.target_type, o.name, o.confidence, o.outreach_recommendation) == ("HIRING_MANAGER", "jo march", "HIGH", "YES")
    assert o.profile_url == "https://pt.linkedin.com/in/jo"
    assert o.suggested_message.startswith("Hi Jo — I applied for the Junior AI Engineer position today.")
    assert len(o.evidence) == 3


def test_recruiter_only_without_manager(spark):
    rows = [("techfirm", None, 1, 4, 0, "Ana Lima - Technical Recruiter - Tech Firm | LinkedIn", "https://x/in/a", "hiring in Madrid"),
            ("techfirm", None, 0, 0, 0, "Bo Ek - CTO and tech lead - Tech Firm", "https://x/in/b", ""),
            ("techfirm", None, 0, 0, 1, "Open Jobs - Engineering Manager - x", "https://x/in/c", ""),
            ("techfirm", None, 0, 0, 3, "Cy Dee - Engineering Manager - x", "https://x/in/d", "")]
    o = outreach(spark, rows)
    assert (o.target_type, o.name, o.confidence, o.outreach_recommendation) == ("RECRUITER", "Ana Lima", "MEDIUM", "VERIFY_FIRST")


def test_no_contact_gives_empty_record(spark):
    o = outreach(spark, [("other", None, 0, 0, 0, "A B - Engineering Manager", "https://x", "")])
    assert (o.target_found, o.target_type, o.confidence, o.outreach_recommendation, o.evidence) == (False, "NONE", "NONE", "NO", [])


def test_facts_follow_the_profile(spark):
    rows = [("techfirm", None, 0, 0, 0, "A B - Engineering Manager", "https://x", "")]
    plain = outreach(spark, rows)
    torch = outreach(spark, rows, skills=("Python", "PyTorch"))
    auto = outreach(spark, rows, projects=("Autonomous feeds",))
    assert plain.candidate_proof.startswith("developed practical")
    assert torch.candidate_proof.startswith("implemented machine learning")
    assert auto.candidate_proof.startswith("developed an asynchronous")


def test_enrich_top(spark):
    df = posts(spark, *[dict(company=f"C{i}", title=f"Job {i}") for i in range(8)])
    df = dedup.with_dedup_key(df).withColumn("rating_score", (F.lit(10) - F.col("item_ordinal")).cast("double"))
    best = contacts.best_contact(spark.createDataFrame([], DIR))
    got = contacts.enrich_top(df, best, profile(spark), n=3).collect()
    assert {r.job_id for r in got if r.human_outreach is not None} == {"0", "1", "2"} and len(got) == 8
    off = contacts.enrich_top(df, best, profile(spark), enabled=False).collect()
    assert all(r.human_outreach is None for r in off)
    nobody = contacts.enrich_top(df, best, profile(spark).limit(0), n=3).collect()
    assert all(r.human_outreach is None for r in nobody)


def test_options():
    assert contacts.flag_enabled(" ON ") and contacts.flag_enabled(None) and not contacts.flag_enabled("no")
    assert (contacts.lookup_cap("3"), contacts.lookup_cap("x"), contacts.lookup_cap(None)) == (3, 10, 10)
    with pytest.raises(ValueError):
        contacts.lookup_cap("-1")


def test_report_shows_contact(spark):
    df = dedup.with_dedup_key(posts(spark, dict(company="A & B")))
    rows = [("ab", None, 0, 0, 0, "Jo Lee - Engineering Manager", "https://x/in/j", "team")]
    full = contacts.with_outreach(df, contacts.best_contact(spark.createDataFrame(rows, DIR)), profile(spark))
    shown = report.report(conform(full, "query_ordinal", "item_ordinal", run_ts="2024-01-01 00:00:00")).first()
    assert (shown.contact_name, shown.company_text, shown.posted_text) == ("Jo Lee", "A &amp; B", R.RECENT)
    assert shown.contact_message.startswith("Hi Jo")


def test_conform_has_the_export_schema(spark):
    df = conform(posts(spark, {}), run_ts="2024-01-01 00:00:00")
    assert df.columns == [f.name for f in POSTING.fields] and df.schema["human_outreach"].dataType == OUTREACH
    row = df.first()
    assert (row.modality, row.is_remote, row.rating_score, row.category) == ("Unknown", False, 0.0, "AI / ML")


def test_rules_and_urls_are_evaluated_once(spark, tmp_path):
    """The filter on the topic does not repeat its rules; a URL is stripped once and split once for each of its parts."""
    from feedrank.functions.text import any_pattern
    from feedrank.functions.urls import _SPLIT, canonical_url
    from feedrank.operators.classify import prefilter
    from feedrank.rules import AI_PATTERNS

    spark.createDataFrame([("t", ["ai"], "c", " HTTPS://A.example/x/?q ")], "title string, tags array<string>, company string, url string") \
        .write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(prefilter(rows)).count(any_pattern(AI_PATTERNS)) == 2  # of the title and of the tags
    found = rows.select(canonical_url(rows.url).alias("u"))
    assert plan(found).count(_SPLIT) == 3 and found.first().u == "https://a.example/x"
