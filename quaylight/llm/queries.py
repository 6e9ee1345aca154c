"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import abuse, canonical, leaks, names, residue, survivor, tokens, topn, truncation, urls


def _texts(spark: SparkSession, d: str) -> DataFrame:
    firms, emails = table(spark, d, "company_details"), table(spark, d, "extracted_email")
    residual = cut(residue.residue(firms, "company_id", ["snippet"], "website_url").select("company_id"))
    snippets = firms.join(residual, "company_id", "left_anti").select(F.lit("snippet").alias("field_name"), F.col("company_id").alias("record_id"), F.col("source_engine").alias("source"), F.col("snippet").alias("value"))
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in ("nearby_text", "html_context")]))
    contexts = emails.select(F.col("email_id").alias("record_id"), F.col("extraction_method").alias("source"), both.alias("x"))
    return snippets.unionByName(contexts.select(F.col("x.f").alias("field_name"), "record_id", "source", F.col("x.v").alias("value")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_texts(spark, d)).where("cut").select("field_name", "record_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut values for each field and source."""
    return truncation.rates(truncation.truncated(_texts(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_n(table(spark, d, "extracted_email"), "company_id", "confidence_score", "email_id", 5)
    known = table(spark, d, "company_details").select("company_id")
    return best.join(known, "company_id", "left_semi").select("company_id", "email_id")


P2_SQL = """
with one as (select company_id, email_id, max(confidence_score) s from extracted_email
  where company_id is not null and email_id is not null and confidence_score is not null group by 1, 2)
select company_id, email_id from one where company_id in (select company_id from company_details)
qualify row_number() over (partition by company_id order by s desc, email_id) <= 5"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    emails, firms = table(spark, d, "extracted_email"), table(spark, d, "company_details")
    typed = F.explode(F.array(F.struct(F.lit("job_title").alias("f"), F.col("job_title").alias("v")), F.struct(F.lit("role").alias("f"), F.col("role").alias("v"))))
    values = emails.select(F.col("email_id").alias("record_id"), typed.alias("x")).select(F.col("x.f").alias("field_name"), "record_id", F.col("x.v").alias("value"))
    values = values.unionByName(firms.select(F.lit("location").alias("field_name"), F.col("company_id").alias("record_id"), F.col("location").alias("value")))
    return canonical.map_values(values, table(spark, d, "canonical_values"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "company_details"), "company_id", ["snippet", "company_name"], "website_url").select("company_id", "field_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    classes = urls.address_classes(table(spark, d, "company_details"), "company_id", "website_url")
    return urls.class_pairs(classes, "company_id").select(F.col("a").alias("company_id_a"), F.col("b").alias("company_id_b"))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """One record for each address with the number of its copies."""
    classes = urls.address_classes(table(spark, d, "company_details"), "company_id", "website_url")
    return classes.where("company_id = class_id").select("company_id", "copies")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the class of its address and the number of records of it."""
    return urls.address_classes(table(spark, d, "company_details"), "company_id", "website_url")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the class of its three address fields together and the number of records of it."""
    return urls.record_classes(table(spark, d, "company_details"), "company_id", ["website_url", "normalized_url", "root_domain"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_email")
    best = survivor.survivors(rows, survivor.plain_mailbox(F.col("email")), "email_id", "confidence_score", "extracted_at", ["best_source_url"])
    return best.select(F.col("key").alias("email"), F.col("best_id").alias("score_email_id"), F.col("best_source_url_id").alias("url_email_id"))


def p6_golden(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each mailbox, its page type and confidence level brought up to date by currency reasoning."""
    rows = table(spark, d, "extracted_email").withColumn("urls", F.to_json("all_source_urls"))
    best = survivor.golden(rows, survivor.plain_mailbox(F.col("email")), "email_id", "confidence_score", "extracted_at", ["confidence_score", "best_source_url", "urls", "person_name", "job_title"], ["source_page_type", "confidence_level"])
    return best.withColumnRenamed("key", "email").withColumnRenamed("urls", "all_source_urls")


def p6_order(spark: SparkSession, d: str) -> DataFrame:
    """Which value of a field comes after which, as learned over all mailboxes."""
    rows = table(spark, d, "extracted_email")
    learned = [survivor.precedence(rows, survivor.plain_mailbox(F.col("email")), "extracted_at", f).select(F.lit(f).alias("field_name"), "earlier", "later") for f in ("source_page_type", "confidence_level")]
    return learned[0].unionByName(learned[1])


def _linked(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    firms, emails = table(spark, d, "company_details"), table(spark, d, "extracted_email")
    unnamed = residue.residue(firms, "company_id", ["company_name"], "website_url").select("company_id")
    firm_names = firms.join(unnamed, "company_id", "left_anti").select(F.lit(0).cast("bigint").alias("scope"), F.col("company_id").alias("id"), F.col("company_name").alias("name"))
    person_names = emails.select(F.col("company_id").alias("scope"), F.col("email_id").alias("id"), F.col("person_name").alias("name"))
    return [("company_name", names.linked_names(firm_names, names.firm_key)), ("person_name", names.linked_names(person_names, names.person_key))]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = [names.variant_pairs(linked).withColumn("field_name", F.lit(f)) for f, linked in _linked(spark, d)]
    return found[0].unionByName(found[1]).select("field_name", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each named record with its entity and the number of other names of it."""
    found = [names.classes(linked).withColumn("field_name", F.lit(f)) for f, linked in _linked(spark, d)]
    return found[0].unionByName(found[1]).select("field_name", "id", "entity", "links")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("abusive").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _judged(spark, d).select("doc_id", "score")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of abusive documents of each source."""
    return abuse.rates(_judged(spark, d))


_BLANK = r"[\s\x{0085}\x{00a0}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]+"
_PUNCT = urls.PUNCT.replace("'", "''")


def _p5_keys(column: str = "website_url") -> str:
    """Each company_id with an address in one spelling."""
    one = "regexp_replace({}, '{}', '{}'{})".format
    x = one(f"lower({column})", _BLANK, "", ", 'g'")
    x = one(x, f"^[{_PUNCT}]+|[{_PUNCT}=]+$", "", ", 'g'")
    for p in (r"^(?:[a-z][a-z0-9+.\-]*:/+|(?:https?|ftp):)", f"^[{_PUNCT}]+", r"^(?:www\.+)+"):
        x = one(x, p, "", "")
    for c in "/.,;:!?&#":
        x = one(x, f"[{c}]+", c, ", 'g'")
    x = one(x, r"^([^/?#]*):(?:80|443)([/?#]|$)", r"\1\2", "")
    head = one("split_part(x, '?', 1)", f"[{_PUNCT}]+$", "", "")
    host = one("regexp_extract(head, '^[^/]*')", f"[{_PUNCT}]+$", "", "")
    path = one("regexp_extract(head, '^[^/]*(.*)$', 1)", "/+", "/", ", 'g'")
    fields = "list_sort(list_filter(string_split(case when contains(x, '?') then substr(x, strpos(x, '?') + 1) else '' end, '&'), lambda q: q <> ''))"
    return f"""select company_id, {host} || chr(1) || {path} || chr(1) || array_to_string({fields}, '&') k from
 (select company_id, x, {head} head from (select company_id, {x} x from company_details where regexp_replace({column}, '{_BLANK}|[{_PUNCT}]', '', 'g') <> ''))"""


P5_SQL = f"with k as ({_p5_keys()}) select a.company_id company_id_a, b.company_id company_id_b from k a join k b on a.k = b.k and a.company_id < b.company_id"
P5_COPIES = f"with k as ({_p5_keys()}) select min(company_id) company_id, count(*) copies from k group by k"
P5_CLASSES = f"with k as ({_p5_keys()}) select company_id, min(company_id) over (partition by k) class_id, count(*) over (partition by k) copies from k"
P5_RECORDS = f"""with a as ({_p5_keys()}), b as ({_p5_keys("normalized_url")}), c as ({_p5_keys("root_domain")}),
 k as (select company_id, [a.k, b.k, c.k] k from a full join b using (company_id) full join c using (company_id))
 select company_id, min(company_id) over (partition by k) class_id, count(*) over (partition by k) copies from k"""

_MAIL = f"regexp_replace(lower(regexp_replace(email, '{_BLANK}', ' ', 'g')), '\\s*[\\[({{<]\\s*at\\s*[\\])}}>]\\s*', '@', 'g')"
_MAIL = f"regexp_replace(replace(regexp_replace({_MAIL}, '\\s*[\\[({{<]\\s*dot\\s*[\\])}}>]\\s*', '.', 'g'), '%40', '@'), '\\s*@\\s*', '@', 'g')"
P6_SQL = f"""with m as (select distinct email_id, regexp_extract(replace({_MAIL}, 'mailto:', ' '), '[a-z0-9][a-z0-9._%+''\\-]*@[a-z0-9](?:[a-z0-9.\\-]*[a-z0-9])?') email, confidence_score s, extracted_at w, best_source_url u from extracted_email where email is not null),
 r as (select *, row_number() over (partition by email order by s desc nulls last, w desc nulls last, email_id) n from m where email <> '')
 select email, max(email_id) filter (n = 1) score_email_id, coalesce(arg_min(email_id, n) filter (trim(u) <> ''), 0) url_email_id from r group by email having count(*) > 1"""


_BEST = "arg_min({0}, n) filter (trim({0}) <> '') {0}, coalesce(arg_min(email_id, n) filter (trim({0}) <> ''), 0) {0}_id".format
P6_GOLDEN = f"""with m as (select distinct email_id, regexp_extract(replace({_MAIL}, 'mailto:', ' '), '[a-z0-9][a-z0-9._%+''\\-]*@[a-z0-9](?:[a-z0-9.\\-]*[a-z0-9])?') email, confidence_score, extracted_at w, best_source_url, cast(to_json(all_source_urls) as varchar) urls, person_name, job_title, source_page_type, confidence_level from extracted_email where email is not null),
 r as (select *, row_number() over (partition by email order by confidence_score desc nulls last, w desc nulls last, email_id) n from m where email <> '')
 select email, arg_min(email_id, n) best_id, arg_min(confidence_score, n) filter (confidence_score is not null) confidence_score, coalesce(arg_min(email_id, n) filter (confidence_score is not null), 0) confidence_score_id, {_BEST("best_source_url")}, arg_min(urls, n) filter (urls <> '') all_source_urls, coalesce(arg_min(email_id, n) filter (urls <> ''), 0) urls_id,
 {_BEST("person_name")}, {_BEST("job_title")}, max({{'w': w, 'v': source_page_type}}) filter (source_page_type <> '').v source_page_type, max({{'w': w, 'v': confidence_level}}) filter (confidence_level <> '').v confidence_level from r group by email having count(*) > 1"""


def _p6_order(field: str) -> str:
    return f"""(with recursive r as (select distinct regexp_extract(replace({_MAIL}, 'mailto:', ' '), '[a-z0-9][a-z0-9._%+''\\-]*@[a-z0-9](?:[a-z0-9.\\-]*[a-z0-9])?') k, extracted_at w, {field} v from extracted_email where email is not null and extracted_at is not null and {field} <> ''),
 b as (select v, lag(v) over (partition by k order by w, v) b from r where k <> ''), n as (select b, v, count(*) n from b where b <> v group by b, v),
 s as (select x.b e, x.v l from n x left join n y on y.b = x.v and y.v = x.b where x.n > coalesce(y.n, 0) and x.n >= 3), c as (select e, l from s union select c.e, s.l from c join s on c.l = s.e)
 select '{field}' field_name, e earlier, l later from c where not exists (select 1 from c z where z.e = c.l and z.l = c.e))"""


P6_ORDER = _p6_order("source_page_type") + " union all " + _p6_order("confidence_level")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p5_found": P5_SQL, "p5_copies": P5_COPIES, "p5_classes": P5_CLASSES, "p5_records": P5_RECORDS, "p6_found": P6_SQL, "p6_golden": P6_GOLDEN, "p6_order": P6_ORDER}
