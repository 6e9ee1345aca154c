"""From stored pages to ranked contacts and one result a company, each as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, urls
from . import choose, html


def _of_company(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows drawn from pages, with the company and the order of their page.

    Both sides grow with the pages. Rows that an array gives are estimated as one a page, so that either side may seem small enough to be sent to the driver and from
    there to all executors, which it isn't: they are always merged.
    """
    return rows.join(pages.select("page_id", "company_id", "page_ord").hint("merge"), "page_id")


def _new_to_company(rows: DataFrame, key: Column) -> DataFrame:
    """Rows without those of the second pass whose value an earlier page of the company gave already."""
    place = F.struct("page_ord", "page_id", "method_ord", "pos")
    w = choose.Window.partitionBy("company_id", key)
    return rows.withColumn("_first", F.min(place).over(w)).where((F.col("method") != "webextractor") | (F.col("_first") == place)).drop("_first")


def mails_of(pages: DataFrame, mx: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Every mailbox of a company's pages, in their order, with whose it is and whether it holds: the rows of contacts_of() before they are merged, rejected ones too (v.keep).

    The name and title beside a mailbox are those of people(), of every page but a home page; the role is that of the title.
    """
    parsed = html.parse(pages) if parsed is None else parsed
    rows = html.mails_of_both(parsed)
    # the second pass knows no type of page, and what it finds counts as found in text
    second = F.col("method") == "webextractor"
    rows = rows.withColumn("source_page_type", F.when(second, "other").otherwise(F.col("page_class")))
    # the first of a page by method and place; the rest says nothing new
    rows = choose.first_wins(rows.where("value <> ''"), ["page_id", "value"], ["method_ord", "pos"])
    rows = _new_to_company(_of_company(rows, pages), F.col("value"))
    home = F.col("page_class") == "homepage"
    told = lambda c: F.when(home, "").otherwise(F.col(c))
    rows = rows.withColumn("person_name", told("person_name")).withColumn("job_title", told("job_title")).withColumn("role", contacts.title_role(F.col("job_title")))
    rows = rows.withColumn("domain", urls.email_domain(F.col("value"))).join(mx, "domain", "left")
    valid = rows.withColumn("v", contacts.validated(F.col("value"), urls.host(F.col("url")), F.col("has_mx")))
    return valid.select(
        "company_id", F.col("value").alias("email"), F.col("url").alias("source_url"), "source_page_type", F.when(second, "regex").otherwise(F.col("method")).alias("extraction_method"), "person_name", "job_title", "role",
        F.lit(0).alias("confidence_score"), F.struct("page_ord", "page_id", "method_ord", "pos").alias("ord"), "v",
    )


def contacts_of(pages: DataFrame, mx: DataFrame, parsed: DataFrame | None = None, mails: DataFrame | None = None) -> DataFrame:
    """Ranked contacts of each company.

    pages: (page_id, company_id, page_ord, url, html); mx: (domain, has_mx); parsed: the pages as html.parse() gives them, mails: mails_of(), if they were written. Rows are taken
    in the order of page, method and place; the looser second pass comes last and adds what no earlier one gave. A mailbox that is malformed, disposable or not for replies is left out. Result: company_id, email_key,
    source_url, best_source_url, all_source_urls, extraction_method, source_page_type, person_name, job_title, role, confidence_score, confidence_level, score_reasons, rank.
    """
    merged = choose.merge_mailboxes((mails_of(pages, mx, parsed) if mails is None else mails).where("v.keep"), first=("v",))
    score = contacts.confidence(F.col("extraction_method"), F.col("source_page_type"), F.col("v.syntax_valid"), F.col("v.mx_valid"), F.col("v.domain_match"), F.col("person_name"), F.col("role"), F.col("v.is_disposable"))
    scored = merged.drop("confidence_score").withColumn("c", score).select("*", F.col("c.score").alias("confidence_score"), F.col("c.level").alias("confidence_level"), F.col("c.reasons").alias("score_reasons"))
    return choose.ranked(scored).drop("c", "v")


def company_links(pages: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(company_id, platform, link, ord): the profile links of a company, those of the looser second pass too, the first of each."""
    parsed = html.parse(pages) if parsed is None else parsed
    rows = html.socials_of_both(parsed).withColumn("link", F.when(F.col("method") == "webextractor", F.col("value")).otherwise(contacts.social_key(F.col("value"))))
    rows = _new_to_company(_of_company(rows, pages), contacts.social_key(F.col("value")))
    first = choose.first_wins(rows, ["company_id", "link"], ["page_ord", "page_id", "method_ord", "pos"])
    return first.select("company_id", "platform", "link", F.struct("page_ord", "page_id", "method_ord", "pos").alias("ord"))


def company_results(companies: DataFrame, ranked: DataFrame, phones: DataFrame, links: DataFrame, mails: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """One row a company, found or not: company_id, status, emails_found, emails_rejected, phones_found, social_links_found, best_contact_email, best_contact_name, best_contact_role,
    best_contact_score, primary_phone, linkedin_url, facebook_url, instagram_url, error_message.

    links: company_links(); mails: mails_of(), for what was rejected; failures: (company_id, error_message) of companies whose home page or run failed, which are
    failed whatever else is known of them.
    """
    # each of the three is read once, for what is counted and what is chosen
    calls = phones.groupBy("company_id").agg(F.countDistinct("phone").alias("phones_found"), choose.main_number())
    profiles = links.groupBy("company_id").agg(F.count(F.lit(1)).alias("social_links_found"), *choose.platform_urls())
    x = companies.select("company_id").distinct()
    parts = [choose.best_and_count(ranked), calls, profiles]
    if mails is not None:
        parts.append(mails.groupBy("company_id").agg(F.count_if(~F.col("v.keep")).alias("emails_rejected")))
    if failures is not None:
        parts.append(failures.groupBy("company_id").agg(F.min(F.coalesce("error_message", F.lit(""))).alias("error_message")))
    for part in parts:
        x = x.join(part, "company_id", "left")
    for c in ("emails_rejected",) if mails is None else ():
        x = x.withColumn(c, F.lit(0).cast("bigint"))
    x = x.withColumn("error_message", F.lit(None).cast("string")) if failures is None else x
    counts = ["emails_found", "phones_found", "social_links_found", "emails_rejected"]
    x = x.na.fill(0, counts)
    found = (F.col("emails_found") > 0) | (F.col("phones_found") > 0) | (F.col("social_links_found") > 0)
    status = F.when(F.col("error_message").isNotNull(), "failed").when(found, "completed").otherwise("no_contacts_found")
    return x.select("company_id", status.alias("status"), *counts, "best_contact_email", "best_contact_name", "best_contact_role", "best_contact_score", "primary_phone", "linkedin_url", "facebook_url", "instagram_url", "error_message")


def company_phones(pages: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(company_id, phone, country, is_fax, is_mobile, ord): the numbers of a company, those of the looser second pass too, the first of each."""
    parsed = html.parse(pages) if parsed is None else parsed
    found = html.phones_of_both(parsed)
    rows = _of_company(found, pages).withColumn("phone", contacts.phone_key(F.col("value")))
    first = choose.first_wins(rows.where("phone <> ''"), ["company_id", "phone"], ["page_ord", "page_id", "method_ord", "pos"])
    near = F.coalesce("near", F.lit(""))
    return first.select("company_id", "phone", contacts.phone_country(F.col("phone")).alias("country"), contacts.is_fax(near).alias("is_fax"), contacts.is_mobile(near).alias("is_mobile"), F.struct("page_ord", "page_id", "method_ord", "pos").alias("ord"))


def merged_engines(hits: DataFrame, first: str, second: str, enough: int = 5, most: int = 25) -> DataFrame:
    """(query, url, place): the first engine's hits of a query and, where they are fewer than `enough`, the second's new ones after them, `most` at most."""
    n = hits.where(F.col("engine") == first).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    x = hits.join(n, "query", "left").where((F.col("engine") == first) | ((F.col("engine") == second) & (F.coalesce("n", F.lit(0)) < enough)))
    order = [F.when(F.col("engine") == first, 0).otherwise(1), "hit_rank", "url"]
    once = choose.first_wins(x, ["query", "url"], order)
    w = choose.Window.partitionBy("query").orderBy(*order)
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "url", "place")


def first_success(attempts: DataFrame) -> DataFrame:
    """(page_id, ord, fetcher, status, html), the stored attempts at a page by rising cost -> (page_id, fetcher_used, html): the first with a status under 400 and a text; 'failed' and null if none."""
    ok = (F.col("status") < 400) & (F.coalesce(F.length("html"), F.lit(0)) > 0)
    best = attempts.groupBy("page_id").agg(F.min_by(F.when(ok, F.struct("fetcher", "html")), F.when(ok, F.col("ord"))).alias("b"))
    return best.select("page_id", F.coalesce("b.fetcher", F.lit("failed")).alias("fetcher_used"), "b.html")


def fallback_candidates(pages: DataFrame, found: DataFrame, least: int = 85, most: int = 5) -> DataFrame:
    """(company_id, page_id, place): the pages worth a browser: without contacts (found: page_id), of priority `least` or more, the `most` best of each company."""
    ranked = pages.join(found.select("page_id").distinct(), "page_id", "left_anti").select("company_id", "page_id", F.explode(F.array(urls.priority(F.col("url")))).alias("priority")).where(F.col("priority") >= least)
    w = choose.Window.partitionBy("company_id").orderBy(F.desc("priority"), "page_id")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("company_id", "page_id", "place")
