"""Problem 6: the best representative of each group of duplicate records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut


def plain_mailbox(raw: Column) -> Column:
    """The plain address in lower case of a mailbox as a record writes it; null if there is none.

    Known dress: white space, mailto: with or without a query, angle brackets or quotes, a display name before the
    brackets, closing punctuation, and (at), [at], (dot), [dot] for the signs.
    """
    x = F.lower(F.regexp_replace(raw, r"[\s\u00a0\u2000-\u200f\u202f\u2060\ufeff]+", " "))
    x = F.regexp_replace(x, r"\s*[\[({<]\s*at\s*[\])}>]\s*", "@")
    x = F.regexp_replace(x, r"\s*[\[({<]\s*dot\s*[\])}>]\s*", ".")
    x = F.regexp_replace(F.regexp_replace(x, "%40", "@"), r"\s*@\s*", "@")
    found = F.regexp_extract(F.regexp_replace(x, r"mailto:", " "), r"[a-z0-9][a-z0-9._%+'\-]*@[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?", 0)
    return F.nullif(found, F.lit(""))


def rank_key(score: Column, when: Column, ident: Column) -> Column:
    """Compares as: higher score, null last; later time, null last; smaller identifier."""
    return F.struct(score.isNotNull(), score, when.isNotNull(), when, F.bitwise_not(ident))


def survivors(records: DataFrame, key: Column, ident: str, score: str, when: str, fields: list[str]) -> DataFrame:
    """One row for each key with two or more identifiers.

    Result: key, records (distinct identifiers are counted as two or more, so: rows), best_id (the identifier of the best record) and, for each field f,
    f and f_id: value and identifier of the best record whose f is neither null nor empty (null and 0 if none has).
    Best: see rank_key. Rows with a null key or identifier are left out; an identifier delivered several times
    counts once, since a repeated row neither wins nor adds an identifier. All is one aggregate that combines
    before it shuffles, so a key of a third of all rows is no burden.
    """
    rows = records.select(key.alias("key"), F.col(ident).cast("bigint").alias("id"), F.col(score).alias("s"), F.col(when).alias("w"), *[F.col(f).alias(f"f_{f}") for f in fields])
    rows = rows.where("key is not null and id is not null")
    rank = rank_key(F.col("s"), F.col("w"), F.col("id"))
    aggs = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.max_by("id", rank).alias("best_id")]
    for f in fields:
        has = F.col(f"f_{f}").isNotNull() & (F.trim(F.col(f"f_{f}").cast("string")) != "")
        aggs.append(F.max(F.when(has, F.struct(rank.alias("k"), F.col("id").alias("id"), F.col(f"f_{f}").alias("v")))).alias(f"b_{f}"))
    best = rows.groupBy("key").agg(*aggs).where("lo < hi")
    return best.select("key", "best_id", *[x for f in fields for x in (F.col(f"b_{f}.v").alias(f), F.coalesce(F.col(f"b_{f}.id"), F.lit(0).cast("bigint")).alias(f"{f}_id"))])


def precedence(records: DataFrame, key: Column, when: str, value: str, support: int = 3) -> DataFrame:
    """Which value of a field comes after which: (earlier, later), learned from all timestamped rows and closed.

    A step holds if, over all keys, consecutive rows change from earlier to later more often than back, and at least `support`
    times. (earlier, later) is a pair if steps lead from earlier to later and none lead back; values that lead to each other are not ordered. Rows
    of one time count in the order of their values. The steps, not the rows, are closed: no more than the pairs of distinct values
    of the field, which must be few.
    """
    rows = records.select(key.alias("key"), F.col(when).alias("w"), F.col(value).cast("string").alias("v")).where("key is not null and w is not null and v <> ''").distinct()
    # neighbours within each hour of a key, then the ends of its hours: a key of a third of all rows is sorted in many tasks
    rows = rows.withColumn("hour", F.date_trunc("hour", "w") if dict(rows.dtypes)["w"].startswith("timestamp") else F.floor(F.col("w") / 3600))
    within = rows.select("v", F.lag("v").over(Window.partitionBy("key", "hour").orderBy("w", "v")).alias("before"))
    ends = rows.groupBy("key", "hour").agg(F.min(F.struct("w", "v"))["v"].alias("v"), F.max(F.struct("w", "v"))["v"].alias("last"))
    between = ends.select("v", F.lag("last").over(Window.partitionBy("key").orderBy("hour")).alias("before"))
    n = within.unionByName(between).where("before is not null and before <> v").groupBy("before", "v").agg(F.count(F.lit(1)).alias("n"))
    back = n.select(F.col("v").alias("before"), F.col("before").alias("v"), F.col("n").alias("m"))
    steps = cut(n.join(back, ["before", "v"], "left").where(f"n > coalesce(m, 0) and n >= {int(support)}").select(F.col("before").alias("earlier"), F.col("v").alias("later")))
    reach, known = steps, steps.count()
    while True:
        # paths twice as long each round
        longer = reach.select("earlier", F.col("later").alias("via")).join(reach.select(F.col("earlier").alias("via"), "later"), "via").select("earlier", "later")
        reach = cut(reach.unionByName(longer).distinct())
        if (found := reach.count()) == known:
            break
        known = found
    return reach.join(reach.select(F.col("later").alias("earlier"), F.col("earlier").alias("later")), ["earlier", "later"], "left_anti")


def current_values(records: DataFrame, key: Column, when: str, value: str, support: int = 3) -> DataFrame:
    """The current value of a field for each key: (key, value, dated).

    Where a row of the key with a value has a timestamp, the value of the latest one (of equal times the greatest
    value). Else the topologically latest of the key's values in the partial order of `precedence`: one after which no other value of the key
    comes, whether or not values between them are the key's own; of several the one in most rows, then the greatest.
    Null and empty values never count; a key without any is left out.
    """
    rows = records.select(key.alias("key"), F.col(when).alias("w"), F.col(value).cast("string").alias("v")).where("key is not null and v <> ''")
    have = cut(rows.groupBy("key", "v").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n")))
    dated = have.where("w is not null").groupBy("key").agg(F.max_by("v", F.struct("w", "v")).alias("value"))
    undated = have.join(dated.select("key"), "key", "left_anti")
    order = precedence(records, key, when, value, support)
    later = undated.join(order, undated.v == order.earlier).select("key", "v", "later")
    followed = later.join(undated.select("key", F.col("v").alias("later")), ["key", "later"], "left_semi").select("key", "v").distinct().withColumn("followed", F.lit(True))
    ends = undated.join(followed, ["key", "v"], "left").groupBy("key").agg(F.max_by("v", F.struct(F.col("followed").isNull(), "n", "v")).alias("value"))
    return dated.withColumn("dated", F.lit(True)).unionByName(ends.withColumn("dated", F.lit(False)))


def golden(records: DataFrame, key: Column, ident: str, score: str, when: str, fields: list[str], current: list[str]) -> DataFrame:
    """survivors() with, for each field of `current`, its value by current_values()."""
    base = survivors(records, key, ident, score, when, fields)
    parts = [current_values(records, key, when, c).select("key", F.col("value").alias(c)) for c in current]
    return reduce(lambda a, b: a.join(b, "key", "left"), parts, base)
