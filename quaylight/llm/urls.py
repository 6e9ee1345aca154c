"""Problem 5: records that differ in formatting only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# White space of any kind, and the punctuation that may stand around or be repeated in an address.
SPACE = r"[\s\u0085\u00a0\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+"
PUNCT = r"""/.,;:!?&#'"`<>()\[\]{}|\\*~^…«»‘’“”"""


def address_parts(url: Column) -> Column:
    """An address as the sorted array of its parts: host, path and each query field, marked h:, p: and q:."""
    x = F.regexp_replace(F.lower(url), SPACE, "")
    x = F.regexp_replace(x, f"^[{PUNCT}]+|[{PUNCT}=]+$", "")
    x = F.regexp_replace(x, r"^(?:[a-z][a-z0-9+.\-]*:/+|(?:https?|ftp):)", "")
    x = F.regexp_replace(x, f"^[{PUNCT}]+", "")
    x = F.regexp_replace(x, r"^(?:www\.+)+", "")
    x = F.regexp_replace(x, r"([/.,;:!?&#])\1+", "$1")
    x = F.regexp_replace(x, r"^([^/?#]*):(?:80|443)(?=[/?#]|$)", "$1")
    head = F.regexp_replace(F.substring_index(x, "?", 1), f"[{PUNCT}]+$", "")
    query = F.when(x.contains("?"), F.substring(x, F.locate("?", x) + 1, F.length(x))).otherwise("")
    host = F.regexp_replace(F.regexp_extract(head, "^[^/]*", 0), f"[{PUNCT}]+$", "")
    path = F.regexp_replace(F.regexp_extract(head, "^[^/]*(.*)$", 1), "/+", "/")
    fields = F.filter(F.split(query, "&"), lambda q: q != "")
    return F.array_sort(F.concat(F.array(F.concat(F.lit("h:"), host), F.concat(F.lit("p:"), path)), F.transform(fields, lambda q: F.concat(F.lit("q:"), q))))


def address_classes(records: DataFrame, ident: str, url: str) -> DataFrame:
    """Each record with the class of its address and the number of records of that class.

    records: any columns; ident (unique) and url name two of them. Result: ident, class_id (the smallest ident of
    the class), copies. Two addresses are of one class if they differ only in letter case, white space, scheme,
    `www.`, default port, repeated, leading or closing slashes and punctuation, or the order of query fields.
    A null or blank url names no address: its record is left out. An empty table gives an empty result.

    Each distinct spelling is taken apart once. Each distinct part gets an integer from a written dictionary (written, so
    that a task run again sees the same integers), spellings become sorted tuples of integers, and only tuples
    are grouped. The aggregates combine before they shuffle, so an address of a third of all rows is no burden.
    """
    raw = records.select(F.col(ident).alias("id"), F.col(url).alias("u")).where(F.regexp_replace("u", f"{SPACE}|[{PUNCT}]", "") != "")
    spellings = cut(raw.select("u").distinct().select("u", address_parts(F.col("u")).alias("parts")))
    parts = spellings.select("u", F.explode("parts").alias("part"))
    dictionary = cut(parts.select("part").distinct().withColumn("n", F.monotonically_increasing_id()))
    tuples = parts.join(dictionary, "part").groupBy("u").agg(F.sort_array(F.collect_list("n")).alias("t"))
    coded = raw.join(tuples, "u").select("id", "t")
    classes = coded.groupBy("t").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return coded.join(classes, "t").select(F.col("id").alias(ident), "class_id", "copies")


def class_pairs(classes: DataFrame, ident: str, part: int = 1_000) -> DataFrame:
    """All pairs of records of one class, the smaller ident first: (a, b). A class of more than `part` records is joined in as many tasks as it has parts."""
    many = classes.where("copies > 1").withColumn("parts", F.ceil(F.col("copies") / part))
    a = many.select("class_id", F.col(ident).alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("slice"))
    b = many.select("class_id", F.col(ident).alias("b"), F.pmod(F.xxhash64(ident), "parts").alias("slice"))
    return a.join(b, ["class_id", "slice"]).where("a < b").select("a", "b")


def record_classes(records: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """Each record with its class over several address fields: (ident, class_id, copies).

    Records are of one class if all their fields are the same address (see address_classes); null and blank count as the same, and a record of which
    all fields are so is left out. Each field is encoded by address_classes, and the tuples of class ids, one a field and 0 for none, are grouped.
    """
    coded = records.select(F.col(ident).alias("id"))
    for k, f in enumerate(fields):
        mine = address_classes(records, ident, f).select(F.col(ident).alias("id"), F.col("class_id").alias(f"c{k}"))
        coded = coded.join(mine, "id", "left")
    codes = [f"c{k}" for k in range(len(fields))]
    coded = cut(coded.select("id", F.array(*codes).alias("t")).where(F.exists("t", lambda c: c.isNotNull())))
    classes = coded.groupBy("t").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return coded.join(classes, "t").select(F.col("id").alias(ident), "class_id", "copies")
