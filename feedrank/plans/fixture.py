"""Input frames derived from the driver tables.

No driver table holds postings, so the queries run on postings, directory
pages, cached ratings and search results computed from all rows of ``orders``
and ``customer``. Names are invented. ``oracle.py`` states the same frames in
SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.names import company_key, slugify
from ..functions.scores import format_score
from ..schema import RATING
from ..session import spread

RUN_EPOCH = 1_700_000_000
RUN_TS = "2023-11-14 22:13:20"

TITLES = (
    ("Junior AI Engineer", "python"),
    ("Gen AI Trainee", "llm"),
    ("Machine Learning Intern", "ml"),
    ("Estágio Profissional em Inteligência Artificial", "ia"),
    ("Software Engineer Intern", "AI"),
    ("JÚNIOR Backend Developer", "java"),
    ("Junior Developer", "nlp"),
    ("Trainee Consultant", "devops"),
    ("Graduate Analyst", "excel"),
    ("Senior AI Engineer", "ai"),
    ("Junior AI Lead", "ai"),
    ("Junior Software Engineer (JR/PL)", "java"),
    ("AI Engineer", "ai"),
    ("Jr. Full-Stack Developer", "js"),
    ("Entry-Level Data Analyst", "sql"),
    ("Director of Artificial Intelligence", "ai"),
)
PLACES = (
    ("Lisbon, Portugal", "Hybrid"),
    ("Worldwide Remote", "100% Remote"),
    ("Porto, Portugal", "On-site / Hybrid"),
    ("Oeiras", "Remote"),
    ("100% Remote", "Unknown"),
)
SUFFIXES = ("", " Group", ", S.A.", " Portugal", " Soluções")

PERSON = {
    "name": "Robin Sample",
    "skills": ["Python", "PyTorch", "FastAPI"],
    "projects": [
        {"name": "RAG & Semantic Search", "description": "search", "technologies": ["FastAPI"]},
        {"name": "Feed Aggregator", "description": "feeds", "technologies": ["Python"]},
    ],
    "education": [],
    "experience": [],
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a driver table (all without names)."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan.select(*columns) if columns else scan)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def customer_label(name: Column) -> Column:
    return F.replace(name, F.lit("#"), F.lit(" "))


def employer(custkey: Column, name: Column) -> Column:
    return F.concat(customer_label(name), _pick(SUFFIXES, custkey % 5))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order. Neighbouring orders share a URL up to its case,
    end slash and query; every 97th has none."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    host = F.when(key % 2 == 0, F.lit("https://Jobs.Example")).otherwise(F.lit("HTTPS://jobs.example"))
    tail = F.when(key % 3 == 0, F.lit("/")).when(key % 3 == 1, F.lit("?ref=x")).otherwise(F.lit(""))
    return orders.join(customer, cust == F.col("c_custkey")).select(
        (key % 7).cast("int").alias("query_ordinal"),
        key.alias("item_ordinal"),
        F.concat(F.lit("feed_"), (key % 7).cast("string")).alias("source"),
        key.cast("string").alias("job_id"),
        _pick([t for t, _ in TITLES], key % 16).alias("title"),
        F.array(_pick([t for _, t in TITLES], key % 16)).alias("tags"),
        F.when(cust % 41 == 0, F.lit("Confidencial"))
        .when(cust % 43 == 0, F.lit("N/A"))
        .otherwise(employer(cust, F.col("c_name")))
        .alias("company"),
        _pick([p for p, _ in PLACES], key % 5).alias("location"),
        _pick([m for _, m in PLACES], key % 5).alias("modality"),
        F.when(key % 97 == 0, F.lit(""))
        .otherwise(F.concat(host, F.lit("/p/"), (key - key % 3).cast("string"), tail))
        .alias("job_url"),
        F.lit(None).cast("string").alias("description_snippet"),
        F.col("o_orderdate").alias("captured_at"),
    )


def profiles(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """Reputation profiles of the customers; with ``gaps`` one in four has none, for lookups that miss."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return (customers.filter(key % 4 != 3) if gaps else customers).select(
        key.alias("profile_id"),
        F.concat(F.upper(customer_label(F.col("c_name"))),
                 F.when(key % 3 == 0, F.lit(" Soluções")).otherwise(F.lit(""))).alias("profile_name"),
        F.when(key % 50 == 1, F.lit(float("nan")))
        .otherwise((10 + key % 41).cast("double") / 10).alias("numeric_score"),
        (key % 150).alias("review_count"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles as parsed directory pages; some pages did not answer."""
    number = F.nanvl(F.col("numeric_score"), F.lit(None).cast("double"))
    key = F.col("profile_id")
    name = F.when(F.col("review_count") > 0, F.col("profile_name"))
    slug = slugify(F.col("profile_name"))
    return profiles(spark, sf_dir).select(
        "profile_id",
        slug.alias("slug"),
        name.alias("profile_name"),
        F.when(key % 29 == 0, F.lit(503)).when(key % 31 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        format_score(number).alias("score"),
        F.coalesce(number, F.lit(0.0)).alias("numeric"),
        F.concat(F.col("review_count").cast("string"), F.lit(" Reviews")).alias("reviews"),
        F.concat(F.lit(f"https://{R.PRIMARY_HOST}/companies/"), slug).alias("url"),
    )


def rating_state(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """Cached entries of nine kinds, one for each row of the decision table; with ``gaps`` three in twelve have none."""
    key, name = F.col("c_custkey"), employer(F.col("c_custkey"), F.col("c_name"))
    kind = key % 12
    slug = slugify(name)
    primary = kind < 6
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return (customers.filter(kind < 9) if gaps else customers).select(
        company_key(name).alias("company_key"),
        F.when(primary, F.lit(R.PRIMARY_PLATFORM)).otherwise(F.lit(R.FALLBACK_PLATFORM)).alias("platform"),
        F.when(kind == 5, F.lit("5.0/5")).when(primary, F.lit("3.5/5")).otherwise(F.lit("4.2/5")).alias("score"),
        F.when(kind == 5, F.lit(5.0)).when(primary, F.lit(3.5)).otherwise(F.lit(4.2)).alias("numeric"),
        F.when(kind == 5, F.lit("0 Reviews")).otherwise(F.lit("12 Reviews")).alias("reviews"),
        F.concat(F.lit(f"https://{R.PRIMARY_HOST}/companies/"),
                 F.when(kind == 1, F.lit("other-place")).otherwise(slug)).alias("url"),
        F.when(kind.isin(2, 5), name).when(kind.isin(3, 4), F.lit("Another Firm")).alias("matched_name"),
        F.when(primary, kind == 4).alias("alias_match"),
        F.when(kind == 6, F.lit(RUN_EPOCH - 100)).when(kind == 7, F.lit(RUN_EPOCH - 100_000))
        .cast("bigint").alias("checked_at"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback rating evidence for every customer; companies that no customer bears have none."""
    key, name = F.col("c_custkey"), employer(F.col("c_custkey"), F.col("c_name"))
    number = (10 + key % 41).cast("double") / 10
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        company_key(name).alias("company_key"),
        F.struct(
            F.lit(R.FALLBACK_PLATFORM).alias("platform"),
            format_score(number).alias("score"),
            number.alias("numeric"),
            F.lit(R.FALLBACK_REVIEWS).alias("reviews"),
            F.lit(R.FALLBACK_SEARCH_PREFIX).alias("url"),
            F.lit(None).cast("string").alias("matched_name"),
            F.lit(None).cast("boolean").alias("alias_match"),
            F.lit(None).cast("bigint").alias("checked_at"),
        ).cast(RATING).alias("rating"),
    )


def contact_directory(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """Captured people-search results, six queries with one or two results each; with ``gaps`` one in five firms has none."""
    key, name = F.col("c_custkey"), employer(F.col("c_custkey"), F.col("c_name"))
    query = F.col("q").cast("bigint")
    turn = (key + query) % 6
    role = (
        F.when(turn == 0, F.lit("Engineering Manager"))
        .when(turn == 1, F.lit("Head of AI & Machine Learning"))
        .when(turn == 2, F.lit("Technical Recruiter"))
        .when(turn == 3, F.lit("CTO and Tech Lead"))
        .when(turn == 4, F.lit("Sales"))
        .otherwise(F.lit("Talent Acquisition Partner"))
    )
    person = F.when(key % 17 == 0, F.lit("Jobs Overview")).otherwise(
        F.concat(F.lit("alex sample"), (key % 100).cast("string")))
    place = F.when(key % 3 == 0, F.lit("Lisbon")).when(key % 3 == 1, F.lit("Madrid")).otherwise(F.lit("EMEA"))
    return (
        table(spark, sf_dir, "customer", "c_custkey", "c_name")
        .filter((key % 5 != 4) | F.lit(not gaps))
        .withColumn("company_key", company_key(name))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(5))))
        .select(
            "company_key",
            F.when(F.col("q") == 0, F.lit("Machine Learning")).alias("area"),
            F.when(F.col("q") < 4, F.lit(0)).otherwise(F.lit(1)).alias("tier"),
            F.col("q").alias("query_ordinal"),
            (key % 4).cast("int").alias("result_ordinal"),
            F.concat(person, F.lit(" - "), role, F.lit(" - "), customer_label(F.col("c_name")),
                     F.lit(" | LinkedIn")).alias("title"),
            F.concat(F.lit("https://pt.linkedin.com/in/alex-"), key.cast("string"),
                     F.when(key % 2 == 0, F.lit("?trk=1")).otherwise(F.lit(""))).alias("link"),
            F.concat(F.lit("Machine Learning team in "), place).alias("snippet"),
        )
    )


def person(spark: SparkSession) -> DataFrame:
    from ..sources.documents import PROFILE

    return spark.createDataFrame([PERSON], PROFILE)
