"""The path from pages to results: joins that stay off the driver."""

import re

import pytest
from pyspark.sql import functions as F

from quaylight.operators import html, pipeline

PAGE = "<html><body><a href='tel:+15550101234'>call</a><a href='https://www.linkedin.com/company/c'>in</a><a href='mailto:a@s.example'>a</a> b@s.example</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    # a plan whose size is known to be small, as that of keys from which pages are made
    return spark.range(20).select(F.col("id").alias("page_id"), (F.col("id") % 7).alias("company_id"), F.lit(1).alias("page_ord"), F.lit("https://s.example/team").alias("url"), F.lit(PAGE).alias("html"))


def joins(df) -> list[str]:
    """The joins of the plan that ran, with their keys."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(\w+Join) \[(\w+)#", plan)


@pytest.mark.parametrize("rows", [lambda p, mx: pipeline.company_phones(p), lambda p, mx: pipeline.company_links(p), lambda p, mx: pipeline.mails_of(p, mx)], ids=["phones", "links", "mails"])
def test_rows_of_pages_are_merged_with_their_pages(spark, pages, rows):
    mx = spark.createDataFrame([("s.example", True)], "domain string, has_mx boolean")
    kinds = {kind for kind, key in joins(rows(pages, mx)) if key == "page_id"}
    assert kinds == {"SortMergeJoin"}


def test_results_read_each_input_once(spark, pages):
    mx = spark.createDataFrame([("s.example", True)], "domain string, has_mx boolean")
    parsed = html.parse(pages)
    got = pipeline.company_results(pages, pipeline.contacts_of(pages, mx, parsed), pipeline.company_phones(pages, parsed), pipeline.company_links(pages, parsed))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # mailboxes and numbers once, links of the first and of the second pass once each
    assert len(re.findall(r"Generate inline", plan)) == 4
    rows = got.orderBy("company_id").collect()
    assert [r["company_id"] for r in rows] == list(range(7))
    assert {(r["status"], r["emails_found"], r["phones_found"], r["social_links_found"], r["best_contact_email"], r["primary_phone"], r["linkedin_url"]) for r in rows} == {("completed", 2, 1, 1, "a@s.example", "+15550101234", "https://www.linkedin.com/company/c")}
