"""Queries over the stored tables: counts, joins, ranks, set operations and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contacts, urls
from ..operators import choose, store
from ..sources import readers, writers
from ..session import table
from .registry import query

EMAIL_SQL = "select distinct email_id, company_id, email, source_url, source_page_type, extraction_method, person_name, job_title, role, confidence_score, extracted_at, syntax_valid, mx_valid, domain_match, is_disposable from extracted_email"


def firms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "company_details")


def emails(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each delivery once: repeated ones differ in loaded_at only, which is not read."""
    return table(spark, d, "extracted_email").select("email_id", *columns).distinct()


@query("select company_id, coalesce(nullif(trim(company_name), ''), website_url) company_name, website_url, location from company_details where trim(website_url) <> '' and location ilike '%falls%'")
def companies_scan(spark, d):
    return readers.companies(firms(spark, d), "falls")


@query("""select count(*) n_all, count(*) filter (status = 'completed') n_completed, count(*) filter (status = 'failed') n_failed,
 (select count(*) from contact where email1 <> '') n_email, (select count(*) from contact where phone1 <> '') n_phone,
 (select count(*) from contact where coalesce(instagram_link, facebook_link, linkedin_link) is not null) n_social from company_details""")
def store_stats(spark, d):
    c = table(spark, d, "contact").agg(F.count_if(F.col("email1") != "").alias("n_email"), F.count_if(F.col("phone1") != "").alias("n_phone"), F.count_if(F.coalesce("instagram_link", "facebook_link", "linkedin_link").isNotNull()).alias("n_social"))
    f = firms(spark, d).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return f.crossJoin(c)  # one row each


@query("select location, count(*) n from company_details group by 1")
def location_counts(spark, d):
    return firms(spark, d).groupBy("location").agg(F.count(F.lit(1)).alias("n"))


@query("select status, count(*) n from company_details group by 1")
def status_counts(spark, d):
    return firms(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


STATES = ["completed", "pending", "failed", "no_contacts_found"]


@query("select location, " + ", ".join(f"count(*) filter (status = '{s}') {s}" for s in STATES) + " from company_details group by 1")
def location_status_pivot(spark, d):
    return firms(spark, d).groupBy("location").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def activity(spark, d):
    c = table(spark, d, "contact").select("company_id", "emails_found", "phones_found")
    return firms(spark, d).join(c, "company_id", "left")


@query("""select location, coalesce(sum(emails_found), 0)::bigint emails, coalesce(sum(phones_found), 0)::bigint phones, strftime(max(completed_at), '%Y-%m-%d %H:%M') last_done
 from company_details left join contact using (company_id) group by 1""")
def location_activity(spark, d):
    return activity(spark, d).groupBy("location").agg(F.coalesce(F.sum("emails_found"), F.lit(0)).alias("emails"), F.coalesce(F.sum("phones_found"), F.lit(0)).alias("phones"), F.date_format(F.max("completed_at"), "yyyy-MM-dd HH:mm").alias("last_done"))


@query("""with x as (select coalesce(location, '(none)') location, status from company_details)
 select location, sum(n)::bigint total, sum(done)::bigint done, round(100.0 * sum(done) / sum(n), 2) done_pct from
 (select case when grouping(location) = 1 then 'TOTAL' else location end location, count(*) n, count(*) filter (status = 'completed') done from x group by rollup (location)) group by 1""")
def location_totals_rollup(spark, d):
    x = firms(spark, d).select(F.coalesce("location", F.lit("(none)")).alias("location"), "status")
    r = x.rollup("location").agg(F.grouping("location").alias("g"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("done"))
    return r.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("location")).alias("location"), "total", "done", F.round(F.try_divide(F.lit(100.0) * F.col("done"), F.col("total")), 2).alias("done_pct"))


@query("select location, count(*) n from company_details where status = 'completed' and location in (select location from pipeline_runs) group by 1")
def completed_in_run_locations(spark, d):
    runs = table(spark, d, "pipeline_runs").select("location")
    return firms(spark, d).where("status = 'completed'").join(runs, "location", "left_semi").groupBy("location").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) filter (status = 'pending' and website_url <> '') pending, (select count(*) from pipeline_runs where status in ('queued', 'running')) active from company_details")
def pending_counts(spark, d):
    active = table(spark, d, "pipeline_runs").agg(F.count_if(F.col("status").isin("queued", "running")).alias("active"))
    return firms(spark, d).agg(F.count_if((F.col("status") == "pending") & (F.col("website_url") != "")).alias("pending")).crossJoin(active)


@query("select location from company_details where location is not null union select location from pipeline_runs where location is not null")
def distinct_locations(spark, d):
    return firms(spark, d).select("location").union(table(spark, d, "pipeline_runs").select("location")).where("location is not null").distinct()


@query("""select coalesce(sum(emails_found), 0)::bigint emails, coalesce(sum(phones_found), 0)::bigint phones, coalesce(sum(social_links_found), 0)::bigint socials,
 count(*) filter (emails_found > 0 or phones_found > 0 or email1 <> '' or phone1 <> '') with_contact, count(*) filter (status = 'failed') failed from contact""")
def run_summary(spark, d):
    some = (F.col("emails_found") > 0) | (F.col("phones_found") > 0) | (F.col("email1") != "") | (F.col("phone1") != "")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return table(spark, d, "contact").agg(total("emails_found").alias("emails"), total("phones_found").alias("phones"), total("social_links_found").alias("socials"), F.count_if(some).alias("with_contact"), F.count_if(F.col("status") == "failed").alias("failed"))


@query(f"""with ee as ({EMAIL_SQL}) select (select count(*) from company_details) companies, (select count(distinct company_id) from ee where company_id in (select company_id from company_details)) with_emails,
 count(*) emails, round(coalesce(avg(confidence_score), 0), 4) avg_score, (select coalesce(sum(pages_crawled), 0)::bigint from company_details) pages from ee""")
def summary_avg_score(spark, d):
    e = emails(spark, d, "company_id", "confidence_score")
    a = e.agg(F.count(F.lit(1)).alias("emails"), F.round(F.coalesce(F.avg("confidence_score"), F.lit(0.0)), 4).alias("avg_score"))
    f = firms(spark, d)
    w = e.select("company_id").distinct().join(f.select("company_id"), "company_id", "left_semi").agg(F.count(F.lit(1)).alias("with_emails"))
    return f.agg(F.count(F.lit(1)).alias("companies"), F.coalesce(F.sum("pages_crawled"), F.lit(0)).alias("pages")).crossJoin(w).crossJoin(a)


@query("select source_engine, count(*) n from company_details group by 1")
def engine_counts(spark, d):
    return firms(spark, d).groupBy("source_engine").agg(F.count(F.lit(1)).alias("n"))


@query("select extraction_method, count(distinct email_id) n from extracted_email group by 1")
def method_counts(spark, d):
    return emails(spark, d, "extraction_method").groupBy("extraction_method").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with ee as ({EMAIL_SQL}) select regexp_replace(lower(regexp_extract(source_url, '//([^/?#]*)', 1)), '^www\\.', '') host, count(distinct source_url) urls, count(*) n from ee where source_url <> '' group by 1""")
def urls_per_domain(spark, d):
    x = emails(spark, d, "source_url").where("source_url <> ''").withColumn("host", urls.host(F.col("source_url")))
    return x.groupBy("host", "source_url").agg(F.count(F.lit(1)).alias("k")).groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.sum("k").alias("n"))


@query("select greatest(1000, coalesce(max(company_id), 0) + 1)::bigint next_company, (select greatest(1000, coalesce(max(contact_id), 0) + 1)::bigint from contact) next_contact from company_details")
def next_ids(spark, d):
    up = lambda c: F.greatest(F.lit(1000), F.coalesce(F.max(c), F.lit(0)) + 1).cast("bigint")
    return firms(spark, d).agg(up("company_id").alias("next_company")).crossJoin(table(spark, d, "contact").agg(up("contact_id").alias("next_contact")))


@query("select company_id, company_name, c.contact_id, c.email1, coalesce(c.emails_found, 0) emails_found from company_details left join contact c using (company_id)")
def companies_with_contacts(spark, d):
    c = table(spark, d, "contact").select("company_id", "contact_id", "email1", "emails_found")
    return firms(spark, d).select("company_id", "company_name").join(c, "company_id", "left").withColumn("emails_found", F.coalesce("emails_found", F.lit(0)))


@query("""select company_id, company_name, coalesce(nullif(email1, ''), '') email1, coalesce(nullif(phone1, ''), '') phone1 from contact join company_details using (company_id)
 where emails_found > 0 or phones_found > 0 or coalesce(email1, '') <> '' or coalesce(phone1, '') <> ''""")
def contact_previews(spark, d):
    full = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(""))
    c = table(spark, d, "contact").where((F.col("emails_found") > 0) | (F.col("phones_found") > 0) | (full("email1") != "") | (full("phone1") != ""))
    return c.join(firms(spark, d).select("company_id", "company_name"), "company_id").select("company_id", "company_name", full("email1").alias("email1"), full("phone1").alias("phone1"))


@query("select company_id, status, 0 emails_found from company_details f where not exists (select 1 from contact c where c.company_id = f.company_id)")
def missing_contact_placeholders(spark, d):
    return firms(spark, d).join(table(spark, d, "contact").select("company_id"), "company_id", "left_anti").select("company_id", "status", F.lit(0).alias("emails_found"))


@query("""select company_id, company_name, location, completed_at from (select *, row_number() over (partition by location order by completed_at desc nulls last, company_id desc) n from company_details where location is not null) where n <= 10""")
def top_companies_per_location(spark, d):
    w = Window.partitionBy("location").orderBy(F.desc_nulls_last("completed_at"), F.desc("company_id"))
    return firms(spark, d).where("location is not null").withColumn("n", F.row_number().over(w)).where("n <= 10").select("company_id", "company_name", "location", "completed_at")


@query("select company_id, email1, completed_at from contact join company_details using (company_id) where email1 <> '' order by completed_at desc nulls last, company_id desc limit 10")
def top_contacts_overall(spark, d):
    c = table(spark, d, "contact").where("email1 <> ''").select("company_id", "email1")
    return c.join(firms(spark, d).select("company_id", "completed_at"), "company_id").orderBy(F.desc_nulls_last("completed_at"), F.desc("company_id")).limit(10)


@query("select company_id, website_url, error_type from company_details where status = 'failed' order by company_id desc limit 500")
def failed_recent(spark, d):
    return firms(spark, d).where("status = 'failed'").orderBy(F.desc("company_id")).limit(500).select("company_id", "website_url", "error_type")


@query("select run_id, location, status, created_at from pipeline_runs order by created_at desc, run_id limit 50")
def runs_recent(spark, d):
    return table(spark, d, "pipeline_runs").orderBy(F.desc("created_at"), "run_id").limit(50).select("run_id", "location", "status", "created_at")


@query("select company_id, emails_found from contact order by emails_found desc nulls last, company_id limit 20")
def top20_by_emails(spark, d):
    return table(spark, d, "contact").orderBy(F.desc_nulls_last("emails_found"), "company_id").limit(20).select("company_id", "emails_found")


@query("select website_url from company_details where website_url <> '' except select website_url from company_details where status in ('completed', 'no_contacts_found')")
def resume_remaining(spark, d):
    f = firms(spark, d)
    done = f.where(F.col("status").isin("completed", "no_contacts_found")).select("website_url")
    return f.where("website_url <> ''").select("website_url").distinct().join(done, "website_url", "left_anti")


KEY_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select company_id from company_details where status = 'pending' and website_url <> '' and (location is null or {KEY_SQL.format('location')} not in (select {KEY_SQL.format('location')} from pipeline_runs where status in ('queued', 'running') and location is not null))")
def pending_not_running(spark, d):
    busy = table(spark, d, "pipeline_runs").where(F.col("status").isin("queued", "running")).select(urls.place_key(F.col("location")).alias("k"))
    return firms(spark, d).where("status = 'pending' and website_url <> ''").withColumn("k", urls.place_key(F.col("location"))).join(busy, "k", "left_anti").select("company_id")


@query("select location from company_details where location is not null group by 1 having count(*) filter (status = 'completed') > 0 and location not in (select location from pipeline_runs where status in ('queued', 'running') and location is not null)")
def locations_done(spark, d):
    busy = table(spark, d, "pipeline_runs").where(F.col("status").isin("queued", "running")).select("location")
    return firms(spark, d).where("status = 'completed' and location is not null").select("location").distinct().join(busy, "location", "left_anti")


@query(f"""select k place_key, arg_min(location, (src, location)) location from (select {KEY_SQL.format('location')} k, location, 1 src from pipeline_runs union all select {KEY_SQL.format('location')}, location, 2 from company_details
 union all select {KEY_SQL.format('entry')}, entry, 3 from canonical_values where field_name = 'location') where location is not null and k <> '' group by 1""")
def locations_union(spark, d):
    src = lambda df, c, n: df.select(F.col(c).alias("location"), F.lit(n).alias("src"))
    x = src(table(spark, d, "pipeline_runs"), "location", 1).unionByName(src(firms(spark, d), "location", 2)).unionByName(src(table(spark, d, "canonical_values").where("field_name = 'location'"), "entry", 3))
    x = x.where("location is not null").withColumn("place_key", urls.place_key(F.col("location"))).where("place_key <> ''")
    return x.groupBy("place_key").agg(F.min_by("location", F.struct("src", "location")).alias("location"))


@query("select location, 'both' side from (select location from company_details intersect select location from pipeline_runs) where location is not null union all select location, 'run' from (select location from pipeline_runs except select location from company_details)")
def location_sets(spark, d):
    a, b = firms(spark, d).select("location"), table(spark, d, "pipeline_runs").select("location")
    return a.intersect(b).where("location is not null").withColumn("side", F.lit("both")).union(b.subtract(a).withColumn("side", F.lit("run")))


@query("""with q as (select location, status from pipeline_runs qualify row_number() over (partition by lower(trim(location)) order by created_at desc, run_id desc) = 1)
 select w.entry location, q.status from canonical_values w left join q on lower(trim(w.entry)) = lower(trim(q.location)) where w.field_name = 'location'""")
def wanted_locations(spark, d):
    k = F.lower(F.trim("location"))
    last = choose.first_wins(table(spark, d, "pipeline_runs").withColumn("k", k), ["k"], [F.desc("created_at"), F.desc("run_id")]).select("k", "status")
    want = table(spark, d, "canonical_values").where("field_name = 'location'").select(F.col("entry").alias("location")).withColumn("k", k)
    return want.join(last, "k", "left").select("location", "status")


@query("""select replace(replace(t, '{location}', entry), '{city}', trim(split_part(entry, ',', 1))) query from canonical_values, (values ('realtor in {city}'), ('brokers of {location}')) v(t) where field_name = 'location'""")
def template_queries(spark, d):
    t = spark.createDataFrame([("realtor in {city}",), ("brokers of {location}",)], "template string")
    places = table(spark, d, "canonical_values").where("field_name = 'location'").select("entry")
    # a fixed list of templates for each place
    return places.crossJoin(t).select(urls.fill_template(F.col("template"), F.col("entry")).alias("query"))


def ordered_emails(spark, d):
    e = emails(spark, d, "company_id", "email", "source_url", "source_page_type", "extraction_method", "person_name", "job_title", "role", "confidence_score", "extracted_at")
    return e.where("company_id is not null").withColumn("ord", F.struct("extracted_at", "email_id"))


METHOD_ORDER = ["mailto", "regex", "obfuscated", "cloudflare", "html_attribute", "json_ld", "structured_data", "javascript"]


@query(f"""with ee as ({EMAIL_SQL}) select source_url, lower(trim(email, ' ' || chr(9) || chr(10) || chr(13))) email_key, arg_min(email_id, (coalesce(nullif(list_position({METHOD_ORDER}, extraction_method), 0), 99), email_id)) email_id from ee where source_url <> '' and trim(email, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by 1, 2""")
def first_method_per_page(spark, d):
    e = emails(spark, d, "email", "source_url", "extraction_method").where("source_url <> ''").withColumn("email_key", contacts.plain(F.col("email")))
    at = F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), F.col("extraction_method"))
    return choose.first_wins(e.withColumn("m", F.coalesce(F.nullif(at, F.lit(0)), F.lit(99))), ["source_url", "email_key"], ["m", "email_id"]).select("source_url", "email_key", "email_id")


MERGED_SQL = f"""with ee as ({EMAIL_SQL}), x as (select *, lower(trim(email, ' ' || chr(9) || chr(10) || chr(13))) email_key, (extracted_at, email_id) ord from ee where company_id is not null and lower(trim(email, ' ' || chr(9) || chr(10) || chr(13))) <> ''),
 r as (select *, row_number() over (partition by company_id, email_key order by coalesce(confidence_score, 0) desc, case when extraction_method = 'mailto' then 0 else 1 end, extracted_at, email_id) wins, row_number() over (partition by company_id, email_key order by extracted_at, email_id) n from x),
 m as (select w.company_id, w.email_key, w.source_url, w.extraction_method, w.person_name, w.job_title, w.role, w.confidence_score, f.source_url best_source_url, f.extracted_at first_at, f.email_id first_id, w.source_page_type from r w join r f using (company_id, email_key) where w.wins = 1 and f.n = 1)"""


@query(MERGED_SQL + " select company_id, email_key, source_url, extraction_method, person_name, confidence_score, best_source_url from m")
def mailboxes_merged(spark, d):
    return choose.merge_mailboxes(ordered_emails(spark, d)).select("company_id", "email_key", "source_url", "extraction_method", "person_name", "confidence_score", "best_source_url")


def tier_sql(c: str) -> str:
    from ..functions import rules

    some = lambda ws: "(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in ws) + ")"
    return f"case when {some(rules.RANK_LOW)} then -1 when {some(rules.RANK_TIER_1)} then 1 when {some(rules.RANK_TIER_2)} then 2 when {some(rules.RANK_TIER_3)} then 3 else 0 end"


METHOD_SQL = "case extraction_method when 'mailto' then 0 when 'json_ld' then 1 when 'structured_data' then 1 when 'html_attribute' then 2 when 'regex' then 3 when 'obfuscated' then 3 when 'html_entity' then 3 when 'cloudflare' then 3 when 'javascript' then 4 else 5 end"
RANK_SQL = MERGED_SQL + f", k as (select *, row_number() over (partition by company_id order by coalesce(confidence_score, 0) desc, {tier_sql('role')}, {METHOD_SQL}, first_at, first_id) rank from m)"


def ranked_emails(spark, d):
    return choose.ranked(choose.merge_mailboxes(ordered_emails(spark, d)))


@query(RANK_SQL + " select company_id, email_key, rank::int rank from k")
def contact_rank(spark, d):
    return ranked_emails(spark, d).select("company_id", "email_key", "rank")


@query(RANK_SQL + " select company_id, email_key best_contact_email, person_name best_contact_name, coalesce(nullif(trim(role), ''), job_title) best_contact_role, confidence_score best_contact_score from k where rank = 1")
def best_contact(spark, d):
    return choose.best_contact(ranked_emails(spark, d))


@query(RANK_SQL + " select company_id, " + ", ".join(f"max(email_key) filter (rank = {n}) email{n}" for n in range(1, 6)) + " from k where rank <= 5 group by 1")
def contact_wide(spark, d):
    return choose.wide(ranked_emails(spark, d), "email_key", "email", 5)


@query(RANK_SQL + """ select f.company_id, coalesce(f.company_name, '') "Company Name", coalesce(a.email_key, '') "Email 1", coalesce(a.confidence_score::varchar, '') "Email 1 Score", coalesce(b.email_key, '') "Email 2", coalesce(f.error_type, '') "Error Type"
 from company_details f left join k a on a.company_id = f.company_id and a.rank = 1 left join k b on b.company_id = f.company_id and b.rank = 2""")
def result_file_rows(spark, d):
    return writers.wide_rows(firms(spark, d), ranked_emails(spark, d)).select("company_id", "Company Name", "Email 1", "Email 1 Score", "Email 2", "Error Type")


@query(f"""with ee as ({EMAIL_SQL}) select lower(split_part(email, '@', 1)) "local", arg_min(email_id, (-coalesce(confidence_score, -1), email, email_id)) email_id from ee where email is not null group by 1""")
def best_per_local_part(spark, d):
    e = emails(spark, d, "email", "confidence_score").where("email is not null")
    local = F.lower(F.substring_index("email", "@", 1))
    return choose.first_wins(e.withColumn("local", local), ["local"], [F.desc_nulls_last("confidence_score"), "email", "email_id"]).select("local", "email_id")


@query("""with x as (select company_id, coalesce(nullif(lower(trim(website_url)), ''), company_id::varchar) k, status, coalesce(emails_found, 0) e, coalesce(phones_found, 0) p, coalesce(best_contact_score, 0) s
 from (select f.company_id, f.website_url, f.status, c.emails_found, c.phones_found, c.best_contact_score from company_details f left join contact c using (company_id)))
 select k url_key, company_id from x qualify row_number() over (partition by k order by (status = 'completed') desc, e desc, p desc, s desc, company_id) = 1""")
def best_entry_per_url(spark, d):
    c = table(spark, d, "contact").select("company_id", "emails_found", "phones_found", "best_contact_score")
    x = firms(spark, d).select("company_id", "website_url", "status").join(c, "company_id", "left")
    k = F.coalesce(F.nullif(F.lower(F.trim("website_url")), F.lit("")), F.col("company_id").cast("string"))
    zero = lambda c: F.desc(F.coalesce(c, F.lit(0)))
    return choose.first_wins(x.withColumn("url_key", k), ["url_key"], [F.desc(F.coalesce(F.col("status") == "completed", F.lit(False))), zero("emails_found"), zero("phones_found"), zero("best_contact_score"), "company_id"]).select("url_key", "company_id")


def numbers(spark, d):
    slots = F.posexplode(F.array("phone1", "phone2", "phone3")).alias("ord", "phone")
    return table(spark, d, "contact").select("company_id", slots).where("phone <> ''")


@query("select company_id, coalesce(phone1, phone2, phone3) primary_phone from contact where coalesce(phone1, phone2, phone3) <> '' and company_id is not null")
def primary_phone(spark, d):
    return choose.primary_phone(numbers(spark, d).withColumn("is_fax", contacts.is_fax(F.lit("")))).where("company_id is not null")


@query("select company_id, linkedin_link linkedin_url, facebook_link facebook_url, instagram_link instagram_url from contact where coalesce(linkedin_link, facebook_link, instagram_link) is not null and company_id is not null")
def first_link_per_platform(spark, d):
    links = F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(i).alias("ord"), F.col(f"{p}_link").alias("link")) for i, p in enumerate(("linkedin", "facebook", "instagram"))]))
    x = table(spark, d, "contact").where("company_id is not null").select("company_id", links.alias("x")).select("company_id", "x.*").where("link is not null")
    return choose.first_per_platform(x)


@query("""with m as (select substr(email, strpos(email, '@') + 1) dom, * from (select distinct email_id, lower(trim(email, ' ' || chr(9) || chr(10) || chr(13))) email from extracted_email where email like '%@%')),
 mx as (select distinct split_part(lower(trim(email, ' ' || chr(9) || chr(10) || chr(13))), '@', 2) dom from extracted_email where email like '%@%' and mx_valid) select email_id, coalesce(mx.dom is not null, false) has_mx from m left join mx on split_part(m.email, '@', 2) = mx.dom""")
def mx_join(spark, d):
    e = emails(spark, d, "email", "mx_valid").where("email like '%@%'").withColumn("dom", urls.email_domain(F.col("email")))
    facts = e.where("mx_valid").select("dom").distinct().withColumn("has_mx", F.lit(True))
    return e.join(facts, "dom", "left").select("email_id", F.coalesce("has_mx", F.lit(False)).alias("has_mx"))


@query("""select f.company_id, coalesce(i.company_name, f.company_name) company_name, case when i.company_id is not null then 'completed' else f.status end status, f.location from company_details f
 left join (select * from company_details where company_id % 3 = 0) i on i.company_id = f.company_id""")
def upsert_latest_wins(spark, d):
    f = firms(spark, d).select("company_id", "company_name", "status", "location", "created_at")
    came = f.where("company_id % 3 = 0").withColumn("status", F.lit("completed")).withColumn("location", F.lit("elsewhere"))
    older = came.withColumn("status", F.lit("failed")).withColumn("created_at", F.col("created_at") - F.expr("interval 1 day"))
    return store.upsert(f, came.unionByName(older), "company_id", ["location"], ["created_at"]).select("company_id", "company_name", "status", "location")


@query("select company_id, website_url from company_details where company_id % 4 = 0 and website_url not in (select website_url from company_details where company_id % 2 = 1)")
def insert_do_nothing(spark, d):
    f = firms(spark, d).select("company_id", "website_url")
    return store.insert_new(f.where("company_id % 2 = 1"), f.where("company_id % 4 = 0"), "website_url", ["company_id"])


@query(f"""with q as (select {KEY_SQL.format('location')} k from pipeline_runs where status in ('queued', 'running', 'completed')), n as (select count(*) c from pipeline_runs),
 p as (select entry location, ref_id, {KEY_SQL.format('entry')} k from canonical_values where field_name = 'location' qualify row_number() over (partition by {KEY_SQL.format('entry')} order by ref_id) = 1)
 select location, k not in (select k from q) added, case when k not in (select k from q) then (select c from n) + row_number() over (partition by k not in (select k from q) order by ref_id) - 1 end priority from p""")
def enqueue_idempotent(spark, d):
    places = table(spark, d, "canonical_values").where("field_name = 'location'").select(F.col("entry").alias("location"), F.col("ref_id").alias("ord"))
    return store.enqueue(table(spark, d, "pipeline_runs"), places).select("location", "added", F.col("priority").cast("bigint").alias("priority"))


@query("select run_id, case when status = 'running' then 'queued' else status end status from pipeline_runs")
def requeue_running(spark, d):
    return store.set_status(table(spark, d, "pipeline_runs"), F.col("status") == "running", "queued").select("run_id", "status")


@query("select company_id, case when status = 'failed' and location ilike '%falls%' then 'pending' else status end status from company_details")
def reset_failed(spark, d):
    return store.set_status(firms(spark, d), (F.col("status") == "failed") & F.col("location").ilike("%falls%"), "pending").select("company_id", "status")


@query("select n_nationkey queue_id, case when n_nationkey % 5 = 0 then 24 - n_nationkey else n_nationkey end::bigint priority from nation")
def reorder_queue(spark, d):
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("queue_id"), F.col("n_nationkey").cast("bigint").alias("priority"))
    return store.reorder(q, q.where("queue_id % 5 = 0").select("queue_id", (F.lit(24) - F.col("queue_id")).cast("bigint").alias("position")))


@query("""select company_id, coalesce(nullif(trim(company_name), ''), trim(website_url)) company_name, trim(website_url) website_url from company_details where trim(website_url) <> ''""")
def bulk_company_rows(spark, d):
    return store.company_rows(firms(spark, d).select("company_id", "company_name", "website_url")).select("company_id", "company_name", "website_url")


@query("select company_id, (10000 + row_number() over (order by company_id))::bigint - 1 new_id from company_details where status = 'pending'")
def numbered_inserts(spark, d):
    old = spark.createDataFrame([(9999,)], "new_id bigint")
    return store.with_ids(firms(spark, d).where("status = 'pending'").select("company_id"), old, "new_id", ["company_id"])


@query("select line_no, line from (select row_number() over (order by ts, event_id) line_no, event_type || ' ' || props line from events) order by line_no desc limit 200")
def log_tail(spark, d):
    # the last 200 lines by time, numbered from the end: no line but those is numbered
    e = table(spark, d, "events")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    last = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    at = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id")))
    lines = last.withColumn("k", at).crossJoin(n).select((F.col("n") - F.col("k") + 1).alias("line_no"), F.concat_ws(" ", "event_type", "props").alias("line"))
    return readers.log_tail(lines, 200)
