"""Queries over events, and streams run to their end over stored rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import choose
from ..session import shared_dir, table
from ..streaming import monitor
from .functions import FIRST_SQL, search_hits
from .registry import query


@query("""select user_id, b silent_from, ts silent_to, s "seconds" from (select user_id, ts, lag(ts) over w b, date_diff('second', lag(ts) over w, ts) s0, (epoch_us(ts) - epoch_us(lag(ts) over w)) // 1000000 s from events window w as (partition by user_id order by ts)) where s >= 86400""")
def silence_windows(spark, d):
    return monitor.silences(table(spark, d, "events"), "user_id", "ts", 86400)


ACTIVE = """with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end new from events), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from x)
 select user_id, min(ts) started, max(ts) + interval '6 hours' ended, count(*) n from g group by user_id, k"""


@query(ACTIVE)
def activity_sessions(spark, d):
    return monitor.activity_windows(table(spark, d, "events"), "user_id", "ts", "6 hours")


def beats(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("beat_id"), at.alias("at"), (F.col("event_id") % 3 != 0).alias("alive"), (F.col("event_id") % 4 == 0).alias("progress"), (F.col("event_id") % 11 == 0).alias("paused"), F.lit(False).alias("locked"), (F.col("event_id") % 5).cast("int").alias("queued"))


WATCHDOG = """with recursive b as (select user_id "key", event_id, epoch_us(ts) / 1000000.0 "at", event_id % 3 <> 0 alive, event_id % 4 = 0 progress, event_id % 11 = 0 paused, event_id % 5 queued, row_number() over (partition by user_id order by ts, event_id) n from events),
 s as (select "key", 0::bigint n, null::double dead, null::double silent, null::double last_at, 0 restarts, ''::varchar "action", null::double "at" from (select distinct "key" from b)
 union all select "key", n, case "action" when 'paused' then dead when 'cooldown' then dead when 'confirming' then dead1 else null end, case when "action" = 'restart' then null when "action" in ('paused', 'cooldown', 'armed') then silent1 else null end, case "action" when 'restart' then "at" else last_at end, restarts + ("action" = 'restart')::int, "action", "at" from (
 select *, case when paused then 'paused' when last_at is not null and "at" - last_at < 900 then 'cooldown' when not alive and "at" - dead1 < 600 then 'confirming' when not alive and queued = 0 then 'idle' when alive and (silent1 is null or "at" - silent1 < 900) then 'armed' else 'restart' end "action"
 from (select b.*, s.dead, s.last_at, s.restarts, coalesce(s.dead, b."at") dead1, case when b.progress then null else coalesce(s.silent, b."at") end silent1 from s join b on b."key" = s."key" and b.n = s.n + 1)))
 select "key", "at", "action", restarts::int restarts from s where n > 0"""


@query(WATCHDOG)
def watchdog_actions(spark, d):
    return monitor.watchdog(beats(spark, d))


@query("select user_id log_id, arg_max(case event_type when 'click' then 'crawl' when 'purchase' then 'save' when 'view' then 'search' end, (ts, event_id)) stage from events where event_type in ('click', 'purchase', 'view') group by 1")
def stage_from_log(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("log_id"), F.struct("ts", "event_id").alias("line_no"), F.concat_ws(" ", "event_type", "props").alias("line"))
    return monitor.stage_of_log(e, {"click": "crawl", "purchase": "save", "view": "search"}).select("log_id", "stage")


@query("select p_partkey line_no, round(100.0 * (p_partkey % 10) / 10, 1) percent from part")
def progress_from_log(spark, d):
    lines = table(spark, d, "part").select(F.lit(0).alias("log_id"), F.col("p_partkey").alias("line_no"), F.expr("concat('  done ', p_partkey % 10, '/10 (', p_partkey % 10, '0%)')").alias("line"))
    return monitor.progress_of_log(lines).select("line_no", "percent")


def _ended(spark, rows: DataFrame, mode: str = "append") -> DataFrame:
    """A stream run over all its input; its rows come from a folder in the shared place."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def _stream(spark, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet" if _is_folder(spark, d, name) else f"{d}/{name}*.parquet")


def _is_folder(spark, d: str, name: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


@query("select distinct event_type from events")
def stream_first_per_key(spark, d):
    return _ended(spark, monitor.first_of_stream(_stream(spark, d, "events"), "event_type").select("event_type"))


@query(WATCHDOG)
def stream_watchdog(spark, d):
    e = _stream(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    b = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("beat_id"), at.alias("at"), (F.col("event_id") % 3 != 0).alias("alive"), (F.col("event_id") % 4 == 0).alias("progress"), (F.col("event_id") % 11 == 0).alias("paused"), F.lit(False).alias("locked"), (F.col("event_id") % 5).cast("int").alias("queued"))
    return _ended(spark, monitor.watchdog_stream(b))


@query("select company_id, website_url, status from company_details")
def stream_upsert(spark, d):
    base = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    rows = _stream(spark, d, "company_details").select("company_id", "website_url", "status")
    put = monitor.upsert_each_batch(lambda k: f"{base}/{k}", "company_id", [], ["status"])
    last = []
    q = rows.writeStream.foreachBatch(lambda b, k: (put(b, k), last.append(k))).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/{last[-1]}")


@query(FIRST_SQL + " select domain, hit_rank from f")
def first_per_domain_batch(spark, d):
    return choose.first_hits(search_hits(spark, d)).select("domain", "hit_rank")
