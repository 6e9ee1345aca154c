"""Inputs: tables, files of firms, places, templates, results and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

# What is searched for where no template file is given.
DEFAULT_TEMPLATES = [
    "real estate company {location}",
    "realtor {location}",
    "property management company {location}",
    "real estate agency {location}",
    "property dealer {location}",
    "real estate brokerage {location}",
    "real estate agents {location}",
    "home buying company {location}",
    "commercial real estate {location}",
    "residential real estate {location}",
    "property investment {location}",
    "real estate developers {location}",
    "rental property management {location}",
    "real estate consultants {location}",
    "property appraisal {location}",
]


def companies(rows: DataFrame, place: str | None = None) -> DataFrame:
    """Firms with an address, at a place by part of its name in any case; a missing name is the address."""
    x = rows.where("trim(website_url) <> ''")
    if place:
        x = x.where(F.col("location").ilike(f"%{place}%"))
    return x.select("company_id", F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.col("website_url")).alias("company_name"), "website_url", "location")


def companies_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.csv of a folder, read by its header in any case: company_name, website, and the other columns as a map."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(f"{folder}/*.csv")
    x = raw.toDF(*[c.strip().lower() for c in raw.columns])
    text = lambda c: F.nullif(F.trim(c), F.lit("")) if c in x.columns else F.lit(None).cast("string")
    site = F.coalesce(text("website"), text("website_url"), text("url"))
    rest = [c for c in x.columns if c not in ("company_name", "title", "domain", "website", "website_url", "url")]
    more = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c) for c in rest])), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    name = F.coalesce(text("company_name"), text("title"), text("domain"), F.nullif(urls.host(urls.normalize(site)), F.lit("")), site)
    return x.select(name.alias("company_name"), site.alias("website"), more.alias("extra_columns")).where("website is not null")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON file (a list or lines); none if it is missing; broken rows are dropped."""
    try:
        return spark.read.schema(schema + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def newest_json(spark: SparkSession, folder: str, schema: str, pattern: str = "email_crawl_*.json") -> DataFrame:
    """The rows of the last file by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.max("path").alias("p")).first()["p"]
    return json_rows(spark, files, schema) if files else spark.createDataFrame([], schema)


def places(spark: SparkSession, path: str) -> DataFrame:
    """One place a line; blank lines and those that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("location")).where("location <> '' and not startswith(location, '#')")


def templates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Query templates of a YAML file's list, else the defaults: (n, template)."""
    if path is None:
        found = DEFAULT_TEMPLATES
    else:
        lines = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*-\s*[\"']?(.*?)[\"']?\s*$"), F.lit(1))))
        found = [r[0] for r in lines.limit(10_000).collect()]
    return spark.createDataFrame(list(enumerate(found)), "n int, template string")


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n of (line_no, line) in order."""
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")
