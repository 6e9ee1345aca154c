"""Upserts, queue changes and other changes of stored tables, each as the new state of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import cut


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: list[str], order: list[Column | str]) -> DataFrame:
    """existing with the rows of incoming put in: of several incoming rows of a key the last by `order` wins; the columns of `keep`
    stay as they were for keys that were there. Rows with a null key are kept as they are. Columns are those of existing."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    last = incoming.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    old, new = existing.alias("old"), last.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    there, came = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    cols = []
    for c in existing.columns:
        o, n = F.col(f"old.{c}"), F.col(f"new.{c}") if c in last.columns else F.lit(None)
        cols.append(F.when(came & ~(there & F.lit(c in keep)), F.coalesce(n, o) if c not in last.columns else n).otherwise(o).alias(c))
    return both.select(*cols)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The rows of incoming whose key is not there yet, the first by `order` of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    first = incoming.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(existing.select(key), key, "left_anti")


def company_rows(raw: DataFrame) -> DataFrame:
    """Rows with any of website, website_url and url as company rows: address, name, normalised address and root domain."""
    at = [c for c in ("website", "website_url", "url") if c in raw.columns]
    url = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in at])
    out = raw.withColumn("website_url", url).where("website_url is not null")
    name = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.col("website_url")) if "company_name" in raw.columns else F.col("website_url")
    return out.withColumn("company_name", name).withColumn("normalized_url", urls.normalize(F.col("website_url"))).withColumn("root_domain", urls.root_domain(F.col("website_url")))


def with_ids(rows: DataFrame, existing: DataFrame, ident: str, order: list[Column | str], least: int = 1000) -> DataFrame:
    """rows numbered on from the highest id there, at least from `least`: counted in each partition of a sorted write, not in one task."""
    top = existing.agg(F.greatest(F.coalesce(F.max(ident) + 1, F.lit(least)), F.lit(least)).cast("bigint").alias("next")).first()["next"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*order)
    # written once: partitions and places in them are then the same for the sizes and for the rows, whatever is run again
    numbered = cut(placed.withColumn("_k", F.row_number().over(w)))
    sizes = numbered.groupBy("_p").count()
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return numbered.join(offsets, "_p").withColumn(ident, F.lit(top) + F.col("_o") + F.col("_k") - 1).drop("_p", "_k", "_o")


def enqueue(queue: DataFrame, places: DataFrame) -> DataFrame:
    """(location, place_key, added, priority): places, each once by its key in the first spelling; those that are queued, running or completed
    are not added; the others get priorities after the queue."""
    w = Window.partitionBy("place_key").orderBy("ord")
    first = places.withColumn("place_key", urls.place_key(F.col("location"))).withColumn("_n", F.row_number().over(w)).where("_n = 1 and place_key <> ''").drop("_n")
    known = queue.where("status in ('queued','running','completed')").select(urls.place_key(F.col("location")).alias("place_key")).distinct().withColumn("there", F.lit(True))
    n = queue.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    marked = first.join(known, "place_key", "left").withColumn("added", F.col("there").isNull())
    # a work queue, not data: its rows fit one task
    at = F.row_number().over(Window.partitionBy("added").orderBy("ord"))
    return marked.select("location", "place_key", "added", F.when(F.col("added"), F.lit(n) + at - 1).alias("priority"))


def dequeue(queue: DataFrame, ids: list[int]) -> DataFrame:
    """(queue_id, deleted, reason): for each of the ids whether it may be deleted: it must be there, and not running."""
    asked = queue.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "queue_id bigint")
    there = asked.join(queue.select(F.col("queue_id").cast("bigint").alias("queue_id"), "status"), "queue_id", "left")
    reason = F.when(F.col("status").isNull(), "not found").when(F.col("status") == "running", "running").otherwise("")
    return there.select("queue_id", (reason == "").alias("deleted"), reason.alias("reason"))


def add_runs(queue: DataFrame, runs: DataFrame, order: list[Column | str]) -> DataFrame:
    """The queue with new runs after it, each numbered on from the highest queue_id and with status queued; columns that runs lack are null."""
    new = with_ids(runs, queue, "queue_id", order, least=1).withColumn("status", F.lit("queued"))
    return queue.unionByName(new.select(*[c for c in queue.columns if c in new.columns]), allowMissingColumns=True)


def merge_runs(stored: DataFrame, incoming: DataFrame, most: int = 100) -> DataFrame:
    """Runs of two sources by run_id, those of incoming first, the newest `most` of them: the list is a report of recent runs."""
    both = stored.withColumn("_s", F.lit(1)).unionByName(incoming.withColumn("_s", F.lit(0)), allowMissingColumns=True)
    last = both.groupBy("run_id").agg(F.min_by(F.struct(*stored.columns), "_s").alias("r")).select("r.*")
    return last.orderBy(F.desc_nulls_last("created_at"), "run_id").limit(most)


def set_status(rows: DataFrame, where: Column, status: str) -> DataFrame:
    return rows.withColumn("status", F.when(F.coalesce(where, F.lit(False)), status).otherwise(F.col("status")))


def reorder(queue: DataFrame, order: DataFrame) -> DataFrame:
    """The queue with the priorities of (queue_id, position); others keep theirs."""
    return queue.join(order, "queue_id", "left").withColumn("priority", F.coalesce("position", "priority")).drop("position")
