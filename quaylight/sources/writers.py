"""Outputs: wide files, JSON, summaries and idempotent writes of micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules


def wide_rows(companies: DataFrame, ranked: DataFrame, n: int = 5) -> DataFrame:
    """One row a firm in the column order of the result file: head, n mailboxes of seven columns, tail.

    companies: company_id and the fields of the head and tail; ranked: contacts with their rank. Missing values are ''.
    """
    role = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.col("job_title"))
    each = F.struct("rank", F.col("email_key").alias("email"), F.col("person_name").alias("name"), role.alias("role"), F.col("confidence_score").cast("string").alias("score"), F.col("source_url").alias("source"), F.col("extraction_method").alias("method"), F.col("source_page_type").alias("page_type"))
    top = ranked.where(F.col("rank") <= n).groupBy("company_id").agg(F.array_sort(F.collect_list(each)).alias("top"))
    joined = companies.join(top, "company_id", "left")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = "company_name website_url normalized_url root_domain status pages_crawled pages_discovered emails_found emails_rejected best_contact_email best_contact_name best_contact_role best_contact_score".split()
    at = lambda k, f: text(F.get("top", F.lit(k))[f])
    cols = [text(F.col(c) if c in joined.columns else F.lit(None)).alias(t) for c, t in zip(head, rules.CSV_HEAD)]
    for k in range(n):
        cols += [at(k, f).alias(f"Email {k + 1}{t}") for f, t in zip("email name role score source method page_type".split(), rules.CSV_EACH)]
    tail: list[Column] = [F.coalesce(F.col("duration_seconds").cast("string"), F.lit("0")), text(F.col("error_type")), text(F.col("error_message")), F.coalesce(F.to_json(F.transform("top", lambda x: x.dropFields("rank"))), F.lit("[]"))]
    return joined.select("company_id", *cols, *[c.alias(t) for c, t in zip(tail, rules.CSV_TAIL)])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_all(rows: DataFrame, folder: str, stamp: str) -> dict[str, str]:
    """A dated and a latest CSV, and a JSON file."""
    out = {"csv": f"{folder}/email_crawl_{stamp}", "latest": f"{folder}/latest", "json": f"{folder}/email_crawl_{stamp}_json"}
    write_csv(rows, out["csv"])
    write_csv(rows, out["latest"])
    write_json(rows, out["json"])
    return out


def summary_lines(summary: DataFrame) -> DataFrame:
    """A one-row summary as lines of text, for write.text."""
    pairs = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in summary.columns])
    return summary.select(F.explode(pairs).alias("value"))


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    """A table that is made only if it isn't there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def empty(spark: SparkSession, rows: DataFrame, path: str) -> None:
    rows.limit(0).write.mode("overwrite").parquet(path)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def quoted_line(*columns: str) -> Column:
    """A line of values, each in quotes, quotes within doubled; null is empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"')) for c in columns])


def finder_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Search results as quoted lines below a header, in the order of their rows."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def site_list(rows: DataFrame, path: str, column: str = "website") -> None:
    """One address a line."""
    rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).write.mode("overwrite").text(path)
