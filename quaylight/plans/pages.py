"""Queries over parsed pages. The pages are made from customer rows, so what must be found is known from the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..functions import contacts, rules
from ..operators import choose, html, pipeline
from ..session import cut, spread, table
from .registry import query

PAGE = """concat('<html><head><title>', case c_custkey % 4 when 0 then 'Meet the team' when 1 then 'Home' when 2 then 'Our story' else 'Call us' end, '</title><meta name="contact-email" content="meta', c_custkey, '@site.example"><meta property="article:publisher" content="https://www.facebook.com/pub', c_custkey, '">',
 '<meta name="description" content="Listings and more"><script>var m = "js', c_custkey, '@site.example";</script><script type="application/ld+json">{"@type":"Organization","email":"mailto:ld', c_custkey, '@site.example","sameAs":["https://www.linkedin.com/company/c-', c_custkey, '/"],"member":[{"email":"member', c_custkey, '@site.example"}]}</script></head>',
 '<body><h1>Welcome</h1><nav><a href="/contact-us/">Contact</a> <a href="about?x=1#top">About</a> <a href="https://other.example/z">Other</a> <a href="#top">Top</a> <a href="javascript:void(0)">No</a></nav>',
 '<div><h3>Ann Lee', '</h3><p>Managing Broker<p>Unclosed <b>bold<a href="mailto:Box.', c_custkey, '@site.example?subject=hi%20there">mail</a></div><p>Write to text', c_custkey, '@site.example, or ring +1 555 010 ', lpad(cast(c_custkey % 10000 as string), 4, '0'), '.</p>',
 '<p>hidden', c_custkey, ' [at] site [dot] example</p><span data-email="attr', c_custkey, '@site.example"></span><button onclick="go(''click', c_custkey, '@site.example'')">x</button>',
 '<a href="tel:+1', lpad(cast(c_custkey as string), 10, '2'), '">call</a><a class="social-link" href="https://www.instagram.com/c', c_custkey, '/?u=1">in</a><a href="https://x.com/search?q=1">find</a></body></html>')"""


def contact_pages(spark, d) -> DataFrame:
    u = F.expr("concat('https://www.site', c_custkey, case c_custkey % 3 when 0 then '.example/' when 1 then '.example/contact-us' else '.example/x/y' end)")
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("page_id"), u.alias("url"), F.expr(PAGE).alias("html"))


def parsed(spark, d) -> DataFrame:
    return html.parse(contact_pages(spark, d))


def mail_sql(name: str) -> str:
    return f"select c_custkey page_id, '{name}' || c_custkey || '@site.example' value from customer"


@query(mail_sql("box."))
def html_mailto(spark, d):
    return html.mailto(parsed(spark, d)).select("page_id", "value")


@query(mail_sql("text"))
def html_visible(spark, d):
    return html.visible_mails(parsed(spark, d)).select("page_id", "value")


@query(mail_sql("hidden"))
def html_hidden(spark, d):
    return html.hidden_mails(parsed(spark, d)).select("page_id", "value")


@query(mail_sql("attr") + " union all " + mail_sql("click"))
def html_attrs(spark, d):
    return html.attribute_mails(parsed(spark, d)).select("page_id", "value")


@query(mail_sql("ld") + " union all " + mail_sql("member"))
def html_jsonld(spark, d):
    return html.jsonld_mails(parsed(spark, d)).select("page_id", "value")


@query(mail_sql("meta"))
def html_meta(spark, d):
    return html.meta_mails(parsed(spark, d)).select("page_id", "value")


@query(mail_sql("js"))
def html_script(spark, d):
    return html.script_mails(parsed(spark, d)).select("page_id", "value")


ALL = [("box.", "mailto"), ("text", "regex"), ("hidden", "obfuscated"), ("attr", "html_attribute"), ("click", "html_attribute"), ("ld", "json_ld"), ("member", "json_ld"), ("meta", "structured_data"), ("js", "javascript")]


@query(" union all ".join(f"select c_custkey page_id, '{n}' || c_custkey || '@site.example' value, '{m}' \"method\" from customer" for n, m in ALL))
def page_mailboxes(spark, d):
    rows = html.all_mails(parsed(spark, d))
    return choose.first_wins(rows, ["page_id", "value"], ["method_ord", "pos"]).select("page_id", "value", "method")


@query("select c_custkey page_id, 'js' || c_custkey || '@site.example' value, 'javascript' \"method\" from customer")
def second_pass_repeats_nothing(spark, d):
    p = parsed(spark, d)
    again = html.second_pass(p).where("value like '%@%'")
    # the second pass finds the script's mailbox too, but the first has it already
    return html.script_mails(p).join(again.select("page_id", "value"), ["page_id", "value"], "left_anti").select("page_id", "value", "method")


@query("select c_custkey page_id, '+1' || lpad(c_custkey::varchar, 10, '2') value from customer")
def html_tel(spark, d):
    return html.tel(parsed(spark, d)).select("page_id", "value")


@query("""with p as (select c_custkey page_id, lpad((c_custkey % 10000)::varchar, 4, '0') l from customer)
 select page_id, '+1 555 010 ' || l value from p union select page_id, '555 010 ' || l from p""")
def html_phones(spark, d):
    return html.text_phones(parsed(spark, d)).select("page_id", "value").distinct()


@query("""select c_custkey page_id, 'linkedin' platform, 'https://www.linkedin.com/company/c-' || c_custkey link from customer union all select c_custkey, 'facebook', 'https://www.facebook.com/pub' || c_custkey from customer
 union all select c_custkey, 'instagram', 'https://www.instagram.com/c' || c_custkey from customer union all select c_custkey, 'twitter', 'https://x.com/search' from customer""")
def html_social(spark, d):
    from ..functions.contacts import social_key

    rows = html.socials(parsed(spark, d)).withColumn("link", social_key(F.col("value")))
    return choose.first_wins(rows, ["page_id", "link"], ["method_ord", "pos"]).select("page_id", "platform", "link")


@query("""with b as (select c_custkey page_id, 'https://www.site' || c_custkey || '.example' s, c_custkey % 3 k from customer) select page_id, s || '/contact-us' link from b union all
 select page_id, s || case k when 2 then '/x/about?x=1' else '/about?x=1' end from b""")
def html_links(spark, d):
    return html.internal_links(parsed(spark, d)).select("page_id", "link")


@query("select c_custkey page_id, case c_custkey % 3 when 0 then 'homepage' when 1 then 'contact' else case c_custkey % 4 when 0 then 'team' when 2 then 'about' when 3 then 'contact' else 'other' end end page_class from customer")
def page_class(spark, d):
    return html.page_class(parsed(spark, d)).select("page_id", "page_class")


@query("select c_custkey page_id, case c_custkey % 4 when 0 then 'Meet the team' when 1 then 'Home' when 2 then 'Our story' else 'Call us' end title, 'Welcome' h1 from customer")
def html_title_h1(spark, d):
    return parsed(spark, d).select("page_id", "title", F.get("headings", F.lit(0)).alias("h1"))


CARDS = [
    # markup around a mailbox, the name and the title that it gives
    ("<div><h3>{n}</h3><p>Managing Broker</p><a href='mailto:{m}'>Write to me today</a></div>", "{n}", "Managing Broker", "managing broker", 1),
    ("<ul><li><strong>{n}</strong> <em>Sales Associate, east side</em><br><span data-email='{m}'>reach me</span></li></ul>", "{n}", "Sales Associate, east side", "sales associate", 2),
    ("<table><tr><td>{n}<br>Team Leader<br>{m}</td></tr></table>", "{n}", "Team Leader", "team leader", 2),
    ("<section><p>please write to us</p><p>{n}</p><p>Vice President<p>{m}</section>", "{n}", "Vice President", "president", 1),
    ("<article><h2>{n} 555-010-1234</h2><p>Gardener since long ago</p><p>Mail: {m}</p></article>", "{n}", "", "", 0),
    ("<div><b>{n}</b><div><span><i><u><a href='mailto:{m}?subject=x'>m</a></u></i></span></div><p>Careers desk of the firm</p></div>", "{n}", "", "", 0),
]
NAMES = ["Ann Lee", "Mary Jane Watson", "Ludwig van Beek", "Ana Maria de Souza Lima", "O'Neil Smith-Hart"]


def cards(spark, d) -> DataFrame:
    """Pages with two people each, in one of the shapes of CARDS."""
    shape, name = F.col("c_custkey") % len(CARDS), F.col("c_custkey") % len(NAMES)
    mail = F.concat(F.lit("p"), "c_custkey", F.lit("@site.example"))
    body = F.coalesce(*[F.when(shape == k, F.lit(x[0])) for k, x in enumerate(CARDS)])
    who = F.coalesce(*[F.when(name == k, F.lit(x)) for k, x in enumerate(NAMES)])
    page = F.concat(F.lit("<html><head><title>Team</title></head><body><h1>Welcome</h1>"), F.replace(F.replace(body, F.lit("{n}"), who), F.lit("{m}"), mail), F.lit("<footer><div><h4>Head office desk</h4><p>Office hours by mail: desk@site.example</p></div></footer></body></html>"))
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("page_id"), F.lit("https://s.example/team/").alias("url"), page.alias("html"))


def _case(key: str, values: list[str]) -> str:
    return f"case {key} % {len(values)} " + " ".join("when {} then '{}'".format(k, v.replace("'", "''")) for k, v in enumerate(values)) + " end"


@query(f"""with p as (select c_custkey page_id, 'p' || c_custkey || '@site.example' mail, {_case("c_custkey", NAMES)} n, {_case("c_custkey", [x[2] for x in CARDS])} job_title, {_case("c_custkey", [x[3] for x in CARDS])} "role", ({_case("c_custkey", [str(x[4]) for x in CARDS])})::int tier from customer)
 select page_id, mail, n person_name, job_title, "role", tier from p union all select page_id, 'desk@site.example', 'Head office desk', 'Head office desk', 'office', 3 from p""")
def person_context(spark, d):
    return html.people(html.parse(cards(spark, d)))


@query("select n_nationkey, '<b>' || n_name || '</b> & co' said from nation")
def entities_decoded(spark, d):
    from ..functions.contacts import unescape

    return table(spark, d, "nation").select("n_nationkey", unescape(F.concat(F.lit("&lt;b&gt;"), "n_name", F.lit("&lt;/b&gt; &amp; co"))).alias("said"))


@query("""select n_nationkey, 'https://n' || n_nationkey || '.example' || p loc from nation, (values ('/contact'), ('/deep/team/page-1')) v(p)""")
def sitemap_pages(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("https://n"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("s"))
    robots = n.select(F.concat("s", F.lit("/robots.txt")).alias("url"), F.concat(F.lit("User-agent: *\nSitemap: "), "s", F.lit("/index.xml\n")).alias("body"))
    loc = lambda p: F.concat(F.lit("<url><loc>"), "s", F.lit(f"{p}</loc></url>"))
    index = n.select(F.concat("s", F.lit("/index.xml")).alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), "s", F.lit("/pages.xml</loc></sitemap></sitemapindex>")).alias("body"))
    maps = n.select(F.concat("s", F.lit("/pages.xml")).alias("url"), F.concat(F.lit("<urlset>"), loc("/contact/"), loc("/deep/team/page-1"), loc("/blog/team"), loc("/a/b/c"), F.lit("</urlset>")).alias("body"))
    found = html.discover_sitemap_urls(robots, index.unionByName(maps))
    return found.withColumn("s", F.regexp_extract("url", "^[^/]*//[^/]*", 0)).join(n, "s").select("n_nationkey", "loc")


@query("""with e as (select distinct email_id, html_context h from extracted_email where html_context <> '') select email_id, lower(regexp_extract(h, 'href="mailto:([^"?]*)', 1)) value from e where starts_with(h, '<') and regexp_matches(h, '<a href="mailto:[^"]*@[^"]*">[^<]*</a>')""")
def context_mailto(spark, d):
    e = table(spark, d, "extracted_email").where("html_context like '<%'").select(F.col("email_id").alias("page_id"), F.lit("https://s.example/").alias("url"), F.col("html_context").alias("html")).distinct()
    whole = e.where(F.col("html").rlike('<a href="mailto:[^"]*@[^"]*">[^<]*</a>'))
    return html.mailto(html.parse(whole)).select(F.col("page_id").alias("email_id"), "value")


@query("""select doc_id, url from documents where url is not null union select company_id, website_url from company_details where website_url is not null""")
def links_and_sites(spark, d):
    a = table(spark, d, "documents").where("url is not null").select("doc_id", "url")
    return a.union(table(spark, d, "company_details").where("website_url is not null").select("company_id", "website_url")).distinct()




def site_pages(spark, d) -> DataFrame:
    return contact_pages(spark, d).withColumn("company_id", F.col("page_id")).withColumn("page_ord", F.lit(1))


def site_mx(spark, d) -> DataFrame:
    return spark.createDataFrame([("site.example", True)], "domain string, has_mx boolean")


SITE_CLASS = "case c_custkey % 3 when 0 then 10 when 1 then 20 else case c_custkey % 4 when 0 then 25 when 2 then 10 when 3 then 20 else 0 end end"
# name and start of each mailbox, points of its method, and what stands beside it on other pages than the home page
MADE = """(values ('box.', 30, 'Ann Lee', 'Managing Broker', 'managing broker', 30), ('ld', 25, '', '', '', 0), ('member', 25, '', '', '', 0), ('meta', 20, '', '', '', 0), ('attr', 15, 'Welcome', 'Contact', 'contact', 5), ('click', 15, 'Welcome', 'Contact', 'contact', 5),
 ('hidden', 10, '', '', '', 0), ('js', 10, '', '', '', 0), ('text', 0, 'Welcome', 'Contact', 'contact', 5)) m(n, pts, who, title, role, more)"""


@query(f"""select c_custkey company_id, n || c_custkey || '@site.example' email_key, greatest(0, pts + {SITE_CLASS} + 5 + 15 - 30 + case when c_custkey % 3 <> 0 then more + case when who <> '' then 15 else 0 end else 0 end) confidence_score,
 case when c_custkey % 3 <> 0 then who else '' end person_name, case when c_custkey % 3 <> 0 then title else '' end job_title, case when c_custkey % 3 <> 0 then role else '' end "role" from customer, {MADE}""")
def pipeline_contacts(spark, d):
    return pipeline.contacts_of(site_pages(spark, d), site_mx(spark, d)).select("company_id", "email_key", "confidence_score", "person_name", "job_title", "role")


@query(f"""select c_custkey company_id, case when c_custkey % 10 = 0 then 'failed' else 'completed' end status, 9::bigint emails_found, 0::bigint emails_rejected, 4::bigint social_links_found, 'box.' || c_custkey || '@site.example' best_contact_email,
 case when c_custkey % 3 <> 0 then 'Ann Lee' else '' end best_contact_name, case when c_custkey % 3 <> 0 then 'managing broker' else '' end best_contact_role,
 20 + {SITE_CLASS} + case when c_custkey % 3 <> 0 then 45 else 0 end best_contact_score, '+1' || lpad(c_custkey::varchar, 10, '2') primary_phone, 'https://www.linkedin.com/company/c-' || c_custkey linkedin_url,
 'https://www.facebook.com/pub' || c_custkey facebook_url, 'https://www.instagram.com/c' || c_custkey instagram_url, case when c_custkey % 10 = 0 then 'timeout' end error_message from customer""")
def pipeline_results(spark, d):
    p = site_pages(spark, d)
    once = cut(html.parse(p))
    mx = site_mx(spark, d)
    failed = p.where("company_id % 10 = 0").select("company_id", F.lit("timeout").alias("error_message"))
    mails = cut(pipeline.mails_of(p, mx, once))
    out = pipeline.company_results(p, pipeline.contacts_of(p, mx, mails=mails), pipeline.company_phones(p, once), pipeline.company_links(p, once), mails, failed)
    return out.drop("phones_found")


@query("""select p_size::varchar query, 'https://u' || p_partkey || '.example' url, place::int place from (select *, row_number() over (partition by p_size order by g, p_partkey) place from (
 select *, p_partkey % 3 = 0 a, case when p_partkey % 3 = 0 then 0 else 1 end g, count(*) filter (p_partkey % 3 = 0) over (partition by p_size) n from part) where a or n < 14) where place <= 25""")
def engines_merged(spark, d):
    hits = table(spark, d, "part").select(F.col("p_size").cast("string").alias("query"), F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("b").alias("engine"), F.col("p_partkey").alias("hit_rank"), F.concat(F.lit("https://u"), "p_partkey", F.lit(".example")).alias("url"))
    return pipeline.merged_engines(hits, "a", "b", enough=14)


@query("select p_partkey, 'm' || p_partkey || '@a.example' value, 'up to ten: m' || p_partkey || '@a.example and after' context from part")
def mail_contexts(spark, d):
    t = F.concat(F.lit("far away and long before, this is up to ten: m"), F.col("p_partkey").cast("string"), F.lit("@a.example and after that nothing"))
    near = table(spark, d, "part").select("p_partkey", F.inline(contacts.contexts(t, rules.EMAIL, 11)))
    return near.select("p_partkey", "value", F.regexp_replace("context", "(and after).*$", "$1").alias("context"))


@query("select n_nationkey, unnest(['Town, ' || n_name, 'B']) place from nation")
def queue_input(spark, d):
    body = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("locations=Town%2C+"), F.replace("n_name", F.lit(" "), F.lit("+")), F.lit("%0A%0A%23no%0AB"))).otherwise(F.concat(F.lit("Town, "), "n_name", F.lit("\n# no\n\n B ")))
    return table(spark, d, "nation").select("n_nationkey", F.explode(contacts.queue_lines(body)).alias("place"))
