"""Choosing among rows: first wins, best wins, ranks and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts, urls


def first_wins(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. The order should decide all ties; null keys are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_mailboxes(rows: DataFrame, company: str = "company_id", first: tuple[str, ...] = ()) -> DataFrame:
    """One row for each mailbox of a company, from pre-scored or unscored rows in the order of `ord`.

    Of the rows with the highest confidence_score a mailto row wins, else the first. best_source_url and first_ord are those of the first row of all; all_source_urls
    are the distinct addresses in order. Expects email, source_url, source_page_type, extraction_method, person_name, job_title,
    role, confidence_score and ord; null scores count as 0. Columns named in `first` are those of the first row too.
    """
    x = rows.withColumn("email_key", contacts.plain(F.col("email"))).where("email_key <> ''")
    # an address of a mailbox is one row before its list is made, so a list holds distinct addresses only
    once = x.where("source_url <> ''").groupBy(company, "email_key", "source_url").agg(F.min("ord").alias("ord"))
    listed = once.groupBy(company, "email_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_url"))), lambda s: s["source_url"]).alias("all_source_urls"))
    win = F.struct(-F.coalesce(F.col("confidence_score"), F.lit(0)), F.when(F.col("extraction_method") == "mailto", 0).otherwise(1), F.col("ord"))
    fields = ["email", "source_url", "source_page_type", "extraction_method", "person_name", "job_title", "role", "confidence_score"]
    best = F.min_by(F.struct(*fields), win)
    kept = [F.min_by(c, "ord").alias(c) for c in first]
    merged = x.groupBy(company, "email_key").agg(best.alias("b"), *kept, F.min_by("source_url", "ord").alias("best_source_url"), F.min("ord").alias("first_ord"))
    both = merged.join(listed, [company, "email_key"], "left")
    return both.select(company, "email_key", "b.*", *first, "best_source_url", "first_ord", F.coalesce("all_source_urls", F.array().cast("array<string>")).alias("all_source_urls"))


def best_per_local_part(rows: DataFrame) -> DataFrame:
    """The highest-scored row for each local part (ties: smallest email)."""
    local = F.lower(F.substring_index("email", "@", 1))
    return first_wins(rows.withColumn("local", local), ["local"], [F.desc_nulls_last("confidence_score"), "email"])


def ranked(rows: DataFrame, company: str = "company_id", tie: str = "first_ord") -> DataFrame:
    """Contacts of each company in order: higher score, lower tier of role, method, then tie."""
    w = Window.partitionBy(company).orderBy(F.desc(F.coalesce("confidence_score", F.lit(0))), contacts.rank_tier(F.col("role")), contacts.method_rank(F.col("extraction_method")), tie)
    return rows.withColumn("rank", F.row_number().over(w))


def best_contact(rank: DataFrame, company: str = "company_id") -> DataFrame:
    return rank.where("rank = 1").select(company, *_as_best())


def _as_best() -> list[Column]:
    role = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.col("job_title"))
    return [F.col("email_key").alias("best_contact_email"), F.col("person_name").alias("best_contact_name"), role.alias("best_contact_role"), F.col("confidence_score").alias("best_contact_score")]


def best_and_count(rank: DataFrame, company: str = "company_id") -> DataFrame:
    """best_contact() and emails_found, the number of contacts, in one pass over them."""
    both = rank.groupBy(company).agg(F.count(F.lit(1)).alias("emails_found"), F.min_by(F.struct(*_as_best()), F.when(F.col("rank") == 1, 1)).alias("b"))
    return both.select(company, "emails_found", "b.*")


def wide(rank: DataFrame, value: str, prefix: str, n: int, company: str = "company_id") -> DataFrame:
    """The first n values of each company as columns prefix1..prefixn."""
    top = rank.where(F.col("rank") <= n).groupBy(company).agg(*[F.max(F.when(F.col("rank") == k, F.col(value))).alias(f"{prefix}{k}") for k in range(1, n + 1)])
    return top


def first_per_platform(links: DataFrame, company: str = "company_id") -> DataFrame:
    """The first link of each platform of a company: linkedin_url, facebook_url, instagram_url."""
    return links.groupBy(company).agg(*platform_urls())


def platform_urls() -> list[Column]:
    return [F.min_by(F.when(F.col("platform") == p, F.col("link")), F.when(F.col("platform") == p, F.col("ord"))).alias(f"{p}_url") for p in ("linkedin", "facebook", "instagram")]


def primary_phone(phones: DataFrame, company: str = "company_id") -> DataFrame:
    """The first number of a company that is no fax."""
    return phones.groupBy(company).agg(main_number())


def main_number() -> Column:
    ok = ~F.coalesce(F.col("is_fax"), F.lit(False))
    return F.min_by(F.when(ok, F.col("phone")), F.when(ok, F.col("ord"))).alias("primary_phone")


def first_hits(hits: DataFrame, min_score: int = 1, exclude: list[str] | None = None) -> DataFrame:
    """The first hit of each host in order of round, engine, query and rank, without junk and low scores."""
    scored = hits.withColumn("domain", urls.host(F.col("url"))).withColumn("score", urls.result_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("location")))
    kept = scored.where((F.col("domain") != "") & ~urls.junk(F.col("url"), exclude)).where(F.col("score") >= min_score)
    return first_wins(kept, ["domain"], ["round_no", "engine_no", "query_no", "hit_rank", "url"])


def search_rounds(firsts: DataFrame, target: int, retries: int = 3) -> DataFrame:
    """(round_no, new, total, runs): whether each round would have been run: round 1 always, a later one while earlier ones have
    not reached the target, no earlier retry found nothing, and at most `retries` retries."""
    rounds = firsts.groupBy("round_no").agg(F.count(F.lit(1)).alias("new"))
    # one row a round: at most retries + 1 of them matter
    w = Window.orderBy("round_no")
    total = F.sum("new").over(w)
    barren = F.max(F.when((F.col("round_no") > 1) & (F.col("new") == 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.lag(total).over(w), F.lit(0))
    out = rounds.where(F.col("round_no") <= retries + 1).withColumn("total", total).withColumn("before", before).withColumn("barren", F.coalesce(barren, F.lit(0)))
    return out.select("round_no", "new", "total", ((F.col("round_no") == 1) | ((F.col("before") < target) & (F.col("barren") == 0))).alias("runs"))


def variant_queries(base: DataFrame, location: str, seed: int = 0, extra: int = 10, most: int = 25) -> DataFrame:
    """(query): suffix variants for a place and `extra` of the base queries by a seeded hash, `most` at most."""
    from ..functions import rules

    city = location.replace(".", "").split(",")[0].strip() or location
    fixed = [f"{t} {city} {s}" for s in rules.VARIANT_SUFFIXES for t in rules.VARIANT_TOPICS]
    made = base.sparkSession.createDataFrame([(i, q) for i, q in enumerate(fixed)], "n int, query string")
    drawn = base.select("query").distinct().orderBy(F.xxhash64("query", F.lit(seed)), "query").limit(extra).withColumn("n", F.lit(len(fixed)))
    return made.unionByName(drawn.select("n", "query")).orderBy("n", "query").limit(most).select("query")
