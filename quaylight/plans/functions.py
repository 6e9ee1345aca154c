"""Queries over scalar functions and search discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, rules, urls
from ..operators import choose
from ..session import table
from .registry import query
from .tables import KEY_SQL, emails, tier_sql

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def p_sql(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{PARTS}', {k})"


def any_sql(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sites(spark, d):
    return table(spark, d, "company_details").select("company_id", "website_url")


def pages(spark, d):
    return table(spark, d, "documents").select("doc_id", "url", "company_id").where("url is not null")


FULL = "(case when website_url like 'http://%' or website_url like 'https://%' then website_url else 'https://' || website_url end)"


@query(f"""with x as (select company_id, website_url, lower({p_sql(FULL, 1)}) s, lower({p_sql(FULL, 2)}) h, {p_sql(FULL, 3)} p, {p_sql(FULL, 4)} q from company_details)
 select company_id, case when website_url is null or website_url = '' then '' else s || '://' || regexp_replace(case s when 'http' then regexp_replace(h, ':80$', '') when 'https' then regexp_replace(h, ':443$', '') else h end, '\\.+$', '') ||
 case when p = '/' then p else regexp_replace(p, '/+$', '') end || case when q <> '' then '?' || q else '' end end normalized from x""")
def url_normalize(spark, d):
    return sites(spark, d).select("company_id", urls.normalize(F.col("website_url")).alias("normalized"))


@query(f"select doc_id, regexp_replace(lower({p_sql('url', 2)}), '^www\\.', '') host, array_to_string(list_slice(string_split(lower({p_sql('url', 2)}), '.'), -2, -1), '.') root from documents where url is not null")
def url_host(spark, d):
    return pages(spark, d).select("doc_id", urls.host(F.col("url")).alias("host"), urls.root_domain(F.col("url")).alias("root"))


PATH = f"rtrim(lower({p_sql('url', 3)}), '/')"
TYPE_SQL = f"case when {PATH} = '' then 'homepage' " + " ".join(f"when {any_sql(PATH, ['/' + w for w in ws])} then '{k}'" for k, ws in rules.PAGE_TYPES.items())
TYPE_SQL += f" when len(string_split(ltrim({PATH}, '/'), '/')) = 2 and (string_split(ltrim({PATH}, '/'), '/')[1] in ('agents','agent','team','realtors','brokers') and string_split(ltrim({PATH}, '/'), '/')[2] not in ('','page','search') or string_split(ltrim({PATH}, '/'), '/')[1] in ('brokerage','offices')) then 'agent_profile' else 'other' end"
PRIORITY_SQL = f"case when {PATH} = '' then 110 " + " ".join(f"when {any_sql(PATH, ['/' + w for w in ws])} then {k}" for k, ws in rules.PRIORITY_WORDS.items()) + f" when {any_sql(PATH, rules.LOW_PRIORITY)} then 5 else 10 end"


@query(f"select doc_id, {TYPE_SQL} page_type from documents where url is not null")
def url_page_type(spark, d):
    return pages(spark, d).select("doc_id", urls.page_type(F.col("url")).alias("page_type"))


@query(f"select doc_id, {PRIORITY_SQL} priority, {any_sql('lower(' + p_sql('url', 3) + ')', rules.LOW_PRIORITY)} low from documents where url is not null")
def url_priority(spark, d):
    return pages(spark, d).select("doc_id", urls.priority(F.col("url")).alias("priority"), urls.low_priority(F.col("url")).alias("low"))


@query(f"""with x as (select distinct company_id, url, {PRIORITY_SQL} priority from documents where url is not null and company_id is not null and not {any_sql('lower(' + p_sql('url', 3) + ')', rules.LOW_PRIORITY)})
 select company_id, url, priority from x qualify row_number() over (partition by company_id order by priority desc, url) <= 50""")
def prioritized_urls_top50(spark, d):
    x = pages(spark, d).where(~urls.low_priority(F.col("url"))).where("company_id is not null").select("company_id", "url").distinct().withColumn("priority", urls.priority(F.col("url")))
    w = choose.Window.partitionBy("company_id").orderBy(F.desc("priority"), "url")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 50").drop("n")


@query("select distinct email_id, case when contains(email, '@') then lower(trim(string_split(email, '@')[2], ' ' || chr(9) || chr(10) || chr(13))) else '' end domain, lower(trim(email, ' ' || chr(9) || chr(10) || chr(13))) email from extracted_email where email is not null")
def email_domain(spark, d):
    return emails(spark, d, "email").where("email is not null").select("email_id", urls.email_domain(F.col("email")).alias("domain"), contacts.plain(F.col("email")).alias("email"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'https://a.example/x?id=' || p_partkey when 1 then 'https://a.example/x' else 'https://a.example/y' end cleaned from part""")
def url_without_tracking(spark, d):
    u = F.expr("case p_partkey % 3 when 0 then concat('https://a.example/x?utm_source=s&id=', p_partkey, '&ref=z#top') when 1 then 'https://a.example/x?gclid=1&empty=' else 'https://a.example/y' end")
    return table(spark, d, "part").select("p_partkey", urls.without_tracking(u).alias("cleaned"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'https://s.example/a/c' || p_partkey when 1 then 'https://s.example/top' when 2 then 'https://t.example/q' else '' end link from part""")
def resolve_links(spark, d):
    h = F.expr("case p_partkey % 4 when 0 then concat('c', p_partkey) when 1 then '/top' when 2 then '//t.example/q' else '' end")
    return table(spark, d, "part").select("p_partkey", urls.absolute(F.lit("https://s.example/a/b"), h).alias("link"))


@query(f"select ref_id, {KEY_SQL.format('entry')} place_key, translate(replace(entry, ' ', '_'), ',.', '') place_slug, lower(regexp_replace(regexp_replace(entry, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) slug from canonical_values")
def place_slugs(spark, d):
    e = F.col("entry")
    return table(spark, d, "canonical_values").select("ref_id", urls.place_key(e).alias("place_key"), urls.place_slug(e).alias("place_slug"), urls.slug(e).alias("slug"))


@query("""with x as (select p_partkey, trim(string_split(string_split(p_name, ' - ')[1], ' | ')[1]) n from (select p_partkey, p_name || case p_partkey % 3 when 0 then ' - Homes | Site' when 1 then ' | Site' else '' end p_name from part)) select p_partkey, case when length(n) < 2 then 'd.example' else n end name from x""")
def name_from_title(spark, d):
    t = F.expr("concat(p_name, case p_partkey % 3 when 0 then ' - Homes | Site' when 1 then ' | Site' else '' end)")
    return table(spark, d, "part").select("p_partkey", urls.name_from_title(t, F.lit("d.example")).alias("name"))


PHONE = "case c_custkey % 5 when 0 then '+1 (555) 010-' || lpad((c_custkey % 10000)::varchar, 4, '0') when 1 then '+44 20 7946 ' || lpad((c_custkey % 10000)::varchar, 4, '0') when 2 then '0412 345 ' || lpad((c_custkey % 1000)::varchar, 3, '0') when 3 then '+420 601 123 456' else '12-34' end"


@query(f"""select c_custkey, (case when starts_with(p, '+') then '+' else '' end) || regexp_replace(p, '[^0-9]', '', 'g') phone, length(regexp_replace(p, '[^0-9]', '', 'g')) between 7 and 15 valid,
 case c_custkey % 5 when 0 then 'US/CA' when 1 then 'UK' when 2 then 'AU/UK' when 3 then 'CZ' else '' end country from (select c_custkey, {PHONE} p from customer)""")
def phone_keys(spark, d):
    p = F.expr(PHONE.replace("::varchar", "").replace("lpad((", "lpad(cast((").replace(" % 10000),", " % 10000) as string),").replace(" % 1000),", " % 1000) as string),"))
    x = table(spark, d, "customer").select("c_custkey", p.alias("p"))
    c = F.col("p")
    return x.select("c_custkey", contacts.phone_key(c).alias("phone"), contacts.phone_valid(c).alias("valid"), contacts.phone_country(c).alias("country"))


ALL_PHONES = "list_concat(" + "list_concat({}, {}), list_concat({}, {}))".format(*[f"regexp_extract_all(t, '{p}')" for p in rules.PHONES])


@query(f"""with t as (select distinct email_id, nearby_text t from extracted_email where nearby_text is not null), m as (select email_id, {ALL_PHONES} p from t)
 select email_id, array_to_string(list_filter(list_transform(p, lambda x: trim(x)), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 7 and 15), ';') phones from m""")
def text_phones(spark, d):
    return emails(spark, d, "nearby_text").where("nearby_text is not null").select("email_id", F.array_join(contacts.phones_in(F.col("nearby_text")), ";").alias("phones"))


@query(rf"""with m as (select distinct email_id, unnest(regexp_extract_all(nearby_text, '\b{rules.EMAIL}\b')) m from extracted_email where nearby_text is not null) select distinct email_id, lower(m) mail from m""")
def text_emails(spark, d):
    return emails(spark, d, "nearby_text").where("nearby_text is not null").select("email_id", F.explode(contacts.emails_in(F.col("nearby_text"))).alias("mail"))


@query("select c_custkey, 'c' || c_custkey || '@site.example' mail from customer")
def hidden_emails(spark, d):
    k = "concat('c', c_custkey)"
    t = F.expr(f"case c_custkey % 4 when 0 then concat('Write ', {k}, ' [at] site [dot] example now') when 1 then concat({k}, ' AT site DOT example') when 2 then concat({k}, '{{at}}site{{dot}}example') else concat({k}, '&#64;site.example') end")
    return table(spark, d, "customer").select("c_custkey", F.explode(contacts.hidden_emails_in(t)).alias("mail"))


@query("select c_custkey, 'c' || c_custkey || '@site.example' mail from customer")
def cfemail_decode(spark, d):
    plain = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@site.example"))
    key = (F.col("c_custkey") % 250).cast("int") + 1
    byte = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    code = F.concat(byte(key), F.array_join(F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: byte(F.ascii(c).bitwiseXOR(key))), ""))
    return table(spark, d, "customer").select("c_custkey", contacts.unmask_cfemail(code).alias("mail"))


LINK = "case c_custkey % 6 when 0 then 'https://www.linkedin.com/company/acme-homes/?x=1' when 1 then 'https://www.facebook.com/pages/Blue-Door/12' when 2 then 'https://instagram.com/c' || c_custkey || '/' when 3 then 'https://x.com/c#a' when 4 then 'https://youtu.be/@tube' else 'https://other.example/p' end"


@query(f"""select c_custkey, ['linkedin','facebook','instagram','twitter','youtube',''][c_custkey % 6 + 1] platform, c_custkey % 6 in (0, 1, 4) company, case c_custkey % 6 when 0 then 'Acme Homes' when 1 then 'Pages' when 2 then 'c' || c_custkey when 3 then 'c' when 4 then '@tube' else 'p' end profile,
 rtrim(regexp_extract({LINK}, '^[^?#]*'), '/') link from customer""")
def social_links(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.expr(LINK).alias("u"))
    u = F.col("u")
    return x.select("c_custkey", contacts.platform(u).alias("platform"), contacts.company_page(u).alias("company"), contacts.profile_name(u).alias("profile"), contacts.social_key(u).alias("link"))


MAIL = "case c_custkey % 6 when 0 then 'info@site.example' when 1 then 'no-reply@site.example' when 2 then 'a@mailinator.com' when 3 then 'b@gmail.com' when 4 then 'broken@' else 'x.y@mail.site.example' end"


@query("""select c_custkey, c_custkey % 6 <> 4 syntax_valid, c_custkey % 2 = 0 mx_valid, c_custkey % 6 in (0, 1, 5) domain_match, c_custkey % 6 = 2 is_disposable, c_custkey % 6 = 1 is_noreply, c_custkey % 6 = 3 is_personal, c_custkey % 6 in (0, 3, 5) keep from customer""")
def email_validate(spark, d):
    v = contacts.validated(F.expr(MAIL), F.lit("site.example"), F.when(F.col("c_custkey") % 2 == 0, True))
    return table(spark, d, "customer").select("c_custkey", v.alias("v")).select("c_custkey", "v.*")


@query("""with x as (select distinct email_id, lower(trim(string_split(email, '@')[2], ' ' || chr(9) || chr(10) || chr(13))) a, lower(trim(f.root_domain)) b from extracted_email e join company_details f using (company_id) where email like '%@%' and f.root_domain <> '')
 select email_id, a = b or ends_with(a, '.' || b) or ends_with(b, '.' || a) or array_to_string(list_slice(string_split(rtrim(a, '.'), '.'), -2, -1), '.') = array_to_string(list_slice(string_split(rtrim(b, '.'), '.'), -2, -1), '.') matches from x
 where regexp_matches(a, '^[a-z0-9.-]+$') and regexp_matches(b, '^[a-z0-9.-]+$')""")
def domain_match(spark, d):
    f = table(spark, d, "company_details").where("root_domain <> ''").select("company_id", F.lower(F.trim("root_domain")).alias("b"))
    e = emails(spark, d, "company_id", "email").where("email like '%@%'").withColumn("a", urls.email_domain(F.col("email"))).where("a rlike '^[a-z0-9.-]+$'")
    return e.join(f.where("b rlike '^[a-z0-9.-]+$'"), "company_id").select("email_id", contacts.domain_match(F.col("a"), F.col("b")).alias("matches"))


def list_sql(c: str, lists: list[tuple[list[str], int]]) -> str:
    return "case " + " ".join(f"when {any_sql(f'lower(coalesce({c}, chr(0)))', ws)} then {t}" for ws, t in lists) + " else 0 end"


@query(f"select distinct email_id, {list_sql('job_title', [(rules.TIER_1, 1), (rules.TIER_2, 2), (rules.TIER_3, 3), (rules.LOW_ROLES, -1)])} title_tier, {tier_sql('role')} rank_tier from extracted_email")
def role_tiers(spark, d):
    return emails(spark, d, "job_title", "role").select("email_id", contacts.title_tier(F.col("job_title")).alias("title_tier"), contacts.rank_tier(F.col("role")).alias("rank_tier"))


PERSON = "lower(coalesce(job_title, '') || ' ' || coalesce(person_name, '') || ' ' || coalesce(email, ''))"


@query(f"""with x as (select distinct email_id, case when {any_sql(PERSON, rules.LOW_ROLES)} then -1 when {any_sql(PERSON, rules.TIER_1)} then 1 when {any_sql(PERSON, rules.TIER_2)} then 2 when {any_sql(PERSON, rules.TIER_3)} then 3
 when regexp_matches(lower(coalesce(job_title, '')), '\\b(manager|lead|head|supervisor)\\b') then 2 else 0 end tier from extracted_email) select email_id, tier, ['Low Priority (Reject)','Unknown','Decision Maker','Broker/Agent','General Contact'][tier + 2] label from x""")
def role_person(spark, d):
    t = contacts.person_tier(F.col("person_name"), F.col("job_title"), F.col("email"))
    return emails(spark, d, "job_title", "person_name", "email").select("email_id", t.alias("tier")).withColumn("label", contacts.tier_label(F.col("tier")))


def _flag(c: str, plus: int, minus: int) -> str:
    return f"case when coalesce({c}, false) then {plus} else {minus} end"


SIGNALS = "coalesce(case extraction_method " + " ".join(f"when '{m}' then {n}" for m, (n, _) in rules.METHOD_POINTS.items()) + " end, 0) + coalesce(case source_page_type " + " ".join(f"when '{m}' then {n}" for m, (n, _) in rules.PAGE_POINTS.items()) + " end, 0)"
SIGNALS += f" + {_flag('syntax_valid', 5, -20)} + {_flag('mx_valid', 15, -5)} + {_flag('domain_match', 20, -30)} + case when coalesce(person_name, '') <> '' then 15 else 0 end + case when coalesce(is_disposable, false) then -100 else 0 end"
SIGNALS += " + [-30, 0, 30, 20, 5][" + list_sql("role", [(rules.RANK_TIER_1, 1), (rules.RANK_TIER_2, 2), (rules.RANK_TIER_3, 3), (rules.RANK_LOW, -1)]) + " + 2]"


@query(f"""with x as (select distinct email_id, greatest(0, least(100, {SIGNALS})) score, coalesce(syntax_valid, false) ok from extracted_email) select email_id, score, case when score >= 90 then 'excellent' when score >= 75 then 'high' when score >= 50 then 'medium' else 'low' end level, ok valid_said from x""")
def confidence_score(spark, d):
    flags = ["extraction_method", "source_page_type", "syntax_valid", "mx_valid", "domain_match", "person_name", "role", "is_disposable"]
    x = emails(spark, d, *flags).select("email_id", contacts.confidence(*[F.col(c) for c in flags]).alias("c"))
    return x.select("email_id", "c.score", "c.level", F.array_contains("c.reasons", "Syntax valid").alias("valid_said"))


def search_hits(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "cast(p_partkey % 4 + 1 as int) round_no", "1 engine_no", "cast(p_partkey % 7 as int) query_no", "p_partkey hit_rank",
        "concat('https://www.site', p_size, case p_partkey % 5 when 0 then '.example/' when 1 then '.example/about' when 2 then '.example/blog/x/y' when 3 then '.gov/' else '.x.com/' end) url",
        "concat(p_name, case when p_partkey % 3 = 0 then ' Realty Group' else ' top 10' end) title", "p_type snippet", "'Green Falls, USA' location",
    )


HITS = """select (p_partkey % 4 + 1)::int round_no, (p_partkey % 7)::int query_no, p_partkey hit_rank, 'https://www.site' || p_size || case p_partkey % 5 when 0 then '.example/' when 1 then '.example/about' when 2 then '.example/blog/x/y' when 3 then '.gov/' else '.x.com/' end url,
 'site' || p_size || case p_partkey % 5 when 3 then '.gov' when 4 then '.x.com' else '.example' end domain, lower(p_name || case when p_partkey % 3 = 0 then ' Realty Group' else ' top 10' end || ' ' || p_type) t, case p_partkey % 5 when 2 then 0 else 3 end path_points from part"""


def _score_sql() -> str:
    some = [f"case when contains(t, '{w}') or contains(domain, '{w}') then 2 else 0 end" for w in rules.SCORE_TERMS] + [f"case when contains(t, '{w}') then 1 else 0 end" for w in rules.SCORE_FIRMS]
    some += [f"case when contains(t, '{w}') then -3 else 0 end" for w in rules.SCORE_LISTS] + [f"case when contains(t, '{w}') then -5 else 0 end" for w in rules.SCORE_JOBS]
    some += [f"case when contains(t, '{w}') then 1 else 0 end" for w in ("green", "falls", "usa")]
    some += [f"case when {any_sql('domain', rules.AGGREGATORS)} then -6 else 0 end", "case when contains(url, '/blog/') then -4 else 0 end", "case when contains(domain, '.gov') then -10 else 0 end", "path_points"]
    return " + ".join(some)


HITS_SQL = f"with h as ({HITS}), s as (select *, {_score_sql()} score from h)"


@query(HITS_SQL + " select hit_rank, score from s")
def search_score(spark, d):
    x = search_hits(spark, d)
    return x.select("hit_rank", urls.result_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("location")).alias("score"))


@query(HITS_SQL + " select hit_rank from s where not contains(domain, 'x.com')")
def search_junk_filter(spark, d):
    return search_hits(spark, d).where(~urls.junk(F.col("url"))).select("hit_rank")


FIRST_SQL = HITS_SQL + ", f as (select domain, hit_rank, score, round_no from s where not contains(domain, 'x.com') and score >= 1 qualify row_number() over (partition by domain order by round_no, query_no, hit_rank) = 1)"


@query(FIRST_SQL + " select domain, hit_rank, score from f")
def search_first_per_domain(spark, d):
    return choose.first_hits(search_hits(spark, d)).select("domain", "hit_rank", "score")


@query(FIRST_SQL + ", r as (select round_no, count(*) new from f group by 1) select round_no, new, (sum(new) over (order by round_no))::bigint total, round_no = 1 or coalesce(sum(new) over (order by round_no rows between unbounded preceding and 1 preceding), 0) < 30 runs from r")
def search_rounds(spark, d):
    return choose.search_rounds(choose.first_hits(search_hits(spark, d)), 30)


@query()
def variant_queries(spark, d):
    base = table(spark, d, "canonical_values").select(F.concat(F.lit("realtor in "), "entry").alias("query"))
    return choose.variant_queries(base, "Green Falls, Westmarch, USA")
