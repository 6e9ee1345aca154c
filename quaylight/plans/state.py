"""Queries over stored attempts, runs, queues and links: filters, counts, orders and changes of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts, rules, urls
from ..operators import choose, html, pipeline, store
from ..session import table
from ..sources import readers, writers
from ..streaming import monitor
from .registry import query
from .tables import emails, firms


def runs(spark, d):
    return table(spark, d, "pipeline_runs")


# the runs as a work queue: their order of creation is their number, and the month their priority
QUEUE_SQL = "(select row_number() over (order by created_at, run_id) queue_id, location, status, month(created_at)::int priority, created_at from pipeline_runs)"


def queue(spark, d):
    # a work queue, not data: its rows fit one task
    n = F.row_number().over(choose.Window.orderBy("created_at", "run_id")).cast("bigint")
    return runs(spark, d).select(n.alias("queue_id"), "location", "status", F.month("created_at").alias("priority"), "created_at")


@query(f"select queue_id, location, row_number() over (order by priority, created_at, queue_id)::int place from {QUEUE_SQL}")
def queue_order(spark, d):
    return queue(spark, d).withColumn("place", F.row_number().over(choose.Window.orderBy("priority", "created_at", "queue_id"))).select("queue_id", "location", "place")


@query(f"select location from {QUEUE_SQL} where status = 'running' order by priority, created_at, queue_id limit 1")
def running_place(spark, d):
    return queue(spark, d).where("status = 'running'").orderBy("priority", "created_at", "queue_id").limit(1).select("location")


@query("select company_id, location, row_number() over (order by location nulls first, company_id)::int place from company_details where status = 'pending' and trim(website_url) <> ''")
def pending_order(spark, d):
    rows = firms(spark, d).where("status = 'pending' and trim(website_url) <> ''").select("company_id", "location")
    return store.with_ids(rows, rows.select(F.lit(0).alias("place")).limit(0), "place", [F.asc_nulls_first("location"), "company_id"], least=1).select("company_id", "location", F.col("place").cast("int").alias("place"))


@query("select coalesce(location, '') location, status, count(*) n from company_details where status in ('completed', 'failed', 'no_contacts_found') and location in (select location from pipeline_runs) group by 1, 2")
def ended_per_place(spark, d):
    return firms(spark, d).where("status in ('completed','failed','no_contacts_found')").join(runs(spark, d).select("location").distinct(), "location", "left_semi").groupBy("location", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with q(k, reason) as (select queue_id, case when status = 'running' then 'running' else '' end from {QUEUE_SQL} union all select 999999, 'not found') select k queue_id, reason = '' deleted, reason from q""")
def queue_delete(spark, d):
    q = queue(spark, d)
    ids = [r[0] for r in q.select("queue_id").collect()]  # a work queue
    return store.dequeue(q, [*ids, 999_999])


@query(f"select queue_id, location, status from {QUEUE_SQL} union all select 1000 + row_number() over (order by n_nationkey) - 1, n_name, 'queued' from nation where (select max(queue_id) from {QUEUE_SQL}) < 1000")
def queue_add(spark, d):
    q = queue(spark, d).select("queue_id", "location", "status")
    new = table(spark, d, "nation").select(F.col("n_name").alias("location"), "n_nationkey")
    return store.with_ids(new, q, "queue_id", ["n_nationkey"]).select("queue_id", "location", F.lit("queued").alias("status")).unionByName(q)


@query("""with n as (select run_id, 'rerun' status, created_at + interval 1 day created_at from pipeline_runs where status = 'failed'), b as (select run_id, status, created_at, 1 s from pipeline_runs union all select *, 0 from n),
 l as (select run_id, arg_min(status, s) status, arg_min(created_at, s) created_at from b group by 1) select * from l order by created_at desc nulls last, run_id limit 100""")
def runs_merged(spark, d):
    stored = runs(spark, d).select("run_id", "status", "created_at")
    again = stored.where("status = 'failed'").select("run_id", F.lit("rerun").alias("status"), (F.col("created_at") + F.expr("interval 1 day")).alias("created_at"))
    return store.merge_runs(stored, again)


ATTEMPTS = "(values (0, 'fast'), (1, 'stealth'), (2, 'dynamic')) a(k, way)"


@query("""with a as (select company_id, coalesce(pages_crawled, 0) p from company_details), x as (select company_id, case when p % 4 = 0 then 'fast' when p % 4 = 1 then 'stealth' when p % 4 = 2 then 'dynamic' else 'failed' end fetcher_used from a)
 select fetcher_used, count(*) n from x group by 1""")
def fetchers_used(spark, d):
    at = firms(spark, d).select("company_id", F.coalesce("pages_crawled", F.lit(0)).alias("p"), F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(w).alias("fetcher")) for k, w in enumerate(("fast", "stealth", "dynamic"))])).alias("x"))
    # stored attempts: an attempt before the one that held was refused, one after it is not asked
    tries = at.select(F.col("company_id").alias("page_id"), "x.*", F.when(F.col("x.ord") == F.col("p") % 4, 200).otherwise(F.when(F.col("x.ord") < F.col("p") % 4, 403).otherwise(200)).alias("status"), F.concat(F.lit("<p>"), "x.fetcher").alias("html"))
    return pipeline.first_success(tries).groupBy("fetcher_used").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select e.source_url, count(*) n from (select distinct email_id, source_url from extracted_email where source_url <> '') e group by 1), c as (select company_id, website_url from company_details where website_url is not null),
 w as (select company_id, website_url from c where website_url not in (select source_url from p)) select count(*) n_without, (select count(*) from c) n_all from w""")
def pages_without_contacts(spark, d):
    """How many home pages have no mailbox."""
    sites = firms(spark, d).where("website_url is not null").select("company_id", "website_url")
    found = emails(spark, d, "source_url").where("source_url <> ''").select(F.col("source_url").alias("website_url")).distinct()
    marked = sites.join(found.withColumn("has", F.lit(True)), "website_url", "left")
    return marked.agg(F.count_if(F.col("has").isNull()).alias("n_without"), F.count(F.lit(1)).alias("n_all"))


@query("""with p as (select c_custkey page_id, c_custkey // 20 company_id, 'https://s' || c_custkey || '.example' || case c_custkey % 4 when 0 then '/contact' when 1 then '/team' when 2 then '/about' else '/x/y/z' end url,
 case c_custkey % 4 when 0 then 100 when 1 then 95 when 2 then 85 else 10 end pr, c_custkey % 3 = 0 has from customer), r as (select *, row_number() over (partition by company_id order by pr desc, page_id) n from p where not has and pr >= 85) select company_id, page_id, n::int place from r where n <= 5""")
def fallback_candidates(spark, d):
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.expr("c_custkey div 20").alias("company_id"), F.concat(F.lit("https://s"), "c_custkey", F.lit(".example"), F.expr("case c_custkey % 4 when 0 then '/contact' when 1 then '/team' when 2 then '/about' else '/x/y/z' end")).alias("url"))
    return pipeline.fallback_candidates(pages, pages.where("page_id % 3 = 0").select("page_id"))


@query("select email_id, page_type, length(text) n from (select distinct email_id, source_url from extracted_email) e join (select url, min(page_type) page_type, min(text) text from documents where url is not null group by url) p on p.url = e.source_url")
def mail_pages(spark, d):
    """The stored page of each mailbox's source."""
    pages = table(spark, d, "documents").where("url is not null").groupBy("url").agg(F.min("page_type").alias("page_type"), F.min("text").alias("text"))
    return emails(spark, d, "source_url").join(pages, F.col("source_url") == F.col("url")).select("email_id", "page_type", F.length("text").cast("bigint").alias("n"))


@query("""with s as (select c_custkey page_id, 'https://www.site' || c_custkey || '.example' s, c_custkey % 3 k from customer) select page_id, list_sort([s || '/contact-us', s || case k when 2 then '/x/about?x=1' else '/about?x=1' end]) links from s""")
def links_sorted(spark, d):
    from .pages import parsed

    return html.internal_links(parsed(spark, d)).groupBy("page_id").agg(F.array_sort(F.collect_list("link")).alias("links"))


@query("select p_partkey, p_partkey % 5 in (0, 3) organic from part")
def organic_links(spark, d):
    href = F.expr("concat(case p_partkey % 5 when 0 then 'https://www.agency' when 1 then '/relative' when 2 then 'https://www.google.com/x' when 3 then 'http://homes.agency' else 'https://localhost/' end, case when p_partkey % 5 in (0, 3) then concat(p_partkey, '.example/') else '' end)")
    return table(spark, d, "part").select("p_partkey", urls.organic(href).alias("organic"))


@query("""select p_partkey, case p_partkey % 6 when 0 then 'owner' when 1 then 'billing' when 2 then 'broker' when 3 then 'Lead of sites' when 4 then 'Gardener' else 'hello' end "role",
 case p_partkey % 6 when 0 then 1 when 1 then -1 when 2 then 2 when 3 then 2 when 4 then 0 else 3 end tier, case p_partkey % 6 when 0 then 'Decision Maker' when 1 then 'Low Priority' when 2 then 'Broker/Agent' when 3 then 'Senior Contact' when 4 then 'Other' else 'General Contact' end label from part""")
def role_labels(spark, d):
    title = F.expr("case p_partkey % 6 when 0 then 'Owner of it' when 1 then 'Owner, billing' when 2 then 'Associate Broker' when 3 then 'Lead of sites' when 4 then 'Gardener' else '' end")
    x = contacts.person_role(F.lit("Ann Lee"), title, F.when(F.col("p_partkey") % 6 == 5, "hello@a.example").otherwise("x@a.example"))
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.*")


@query("""select p_partkey, case p_partkey % 5 when 0 then 'owner' when 1 then 'owner' when 2 then 'broker' when 3 then 'Gardener' else '' end "role" from part""")
def title_roles(spark, d):
    title = F.expr("case p_partkey % 5 when 0 then 'Owner of it' when 1 then 'Owner, billing' when 2 then 'Associate Broker' when 3 then 'Gardener' else '' end")
    return table(spark, d, "part").select("p_partkey", contacts.title_role(title).alias("role"))


@query("""select p_partkey, p_partkey % 4 = 0 is_fax, p_partkey % 4 = 1 is_mobile from part""")
def phone_kinds(spark, d):
    near = F.expr("case p_partkey % 4 when 0 then 'Our FAX: ' when 1 then 'Mobile ' when 2 then 'Call ' else '' end")
    return table(spark, d, "part").select("p_partkey", contacts.is_fax(near).alias("is_fax"), contacts.is_mobile(near).alias("is_mobile"))


@query("""select c_custkey company_id, case when c_custkey % 3 = 2 then null else '+1555' || c_custkey || (c_custkey % 3 + 1) end primary_phone from customer""")
def primary_phone_no_fax(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"))
    rows = n.select("company_id", F.concat(F.lit("+1555"), "company_id", "ord").alias("phone"), "ord", (F.col("ord") <= F.col("company_id") % 3).alias("is_fax"))
    return choose.primary_phone(rows)


@query("select 'real estate company {location}' template union all select unnest(['realtor {location}', 'property management company {location}', 'real estate agency {location}', 'property dealer {location}', 'real estate brokerage {location}', 'real estate agents {location}', 'home buying company {location}', 'commercial real estate {location}', 'residential real estate {location}', 'property investment {location}', 'real estate developers {location}', 'rental property management {location}', 'real estate consultants {location}', 'property appraisal {location}'])")
def default_templates(spark, d):
    return readers.templates(spark).select("template")


@query("""with h as (select p_partkey, p_size, 'https://site' || p_size || '.example/' || p_partkey u, p_name t, p_type s from part) select u url, t title, s snippet, p_partkey % 9 score, row_number() over (order by p_partkey % 9 desc, p_partkey)::int place from h""")
def results_by_score(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("https://site"), "p_size", F.lit(".example/"), "p_partkey").alias("url"), F.col("p_name").alias("title"), F.col("p_type").alias("snippet"), (F.col("p_partkey") % 9).alias("score"), "p_partkey")
    return store.with_ids(rows, rows.select(F.lit(0).alias("place")).limit(0), "place", [F.desc("score"), "p_partkey"], least=1).select("url", "title", "snippet", "score", F.col("place").cast("int").alias("place"))


@query("""select company_id, '"' || coalesce(replace(company_name, '"', '""'), '') || '","' || coalesce(replace(website_url, '"', '""'), '') || '","' || coalesce(replace(location, '"', '""'), '') || '"' line from company_details""")
def finder_lines(spark, d):
    return firms(spark, d).select("company_id", writers.quoted_line("company_name", "website_url", "location").alias("line"))


@query("""with l(ts, n, line) as (select ts, event_id, case event_id % 4 when 0 then '  RUNNING: Town ' || event_id when 1 then 'PHASE 1: URL FINDER' when 2 then 'Progress: ' || event_id || '/20000 (' || event_id % 100 || '%)' else 'x' end from events)
 select user_id, max(n) filter (line like '%RUNNING:%') last_running, arg_max(trim(split_part(line, 'RUNNING:', 2)), n) filter (line like '%RUNNING:%') place, max(n) filter (line like 'Progress%') last_progress, arg_max(try_cast(split_part(split_part(line, '(', 2), '%', 1) as int), n) filter (line like 'Progress%') percent
 from l join events on event_id = n group by 1""")
def log_state(spark, d):
    e = table(spark, d, "events")
    line = F.expr("case event_id % 4 when 0 then concat('  RUNNING: Town ', event_id) when 1 then 'PHASE 1: URL FINDER' when 2 then concat('Progress: ', event_id, '/20000 (', event_id % 100, '%)') else 'x' end")
    return monitor.log_state(e.select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))).withColumnRenamed("log", "user_id")


@query("""with b as (select user_id, epoch(date_trunc('day', ts))::bigint // 86400 poll, count(*) n, count(*) filter (event_type = 'purchase') done from events group by 1, 2),
 s as (select *, sum(n) over w total, sum(done) over w completed, lag(poll) over (partition by user_id order by poll) p from b window w as (partition by user_id order by poll)),
 g as (select *, n * 40 >= 50 or done > 0 moved from s), k as (select *, max(case when moved then poll end) over (partition by user_id order by poll) last from g)
 select user_id, poll, total::bigint lines, completed::bigint completed, moved progress, case when moved then 'ok' when poll - coalesce(last, poll) >= 3 then 'stuck' else 'quiet' end event from k""")
def poll_reports(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("process"), F.expr("cast(datediff(to_date(ts), date'1970-01-01') as bigint)").alias("poll"), (F.col("event_type") == "purchase").alias("completes"))
    return monitor.poll_reports(e, line_bytes=40, least_bytes=50, stuck_after=3).withColumnRenamed("process", "user_id")
