"""Problem 2: the N highest-scoring items of every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_best(rows: pa.Table, n: int) -> pa.Table:
    """(g, s, i): of each group the n distinct items with the highest score, the smaller i first among equal ones; of each item its best row."""
    if not rows.num_rows:
        return rows
    rows = rows.sort_by([("g", "ascending"), ("i", "ascending"), ("s", "descending")])
    # group numbers, so that neighbours of any type compare
    g, i = pc.rank(rows["g"], tiebreaker="dense").to_numpy(), rows["i"].to_numpy()
    first = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
    rows = rows.filter(pa.array(first)).sort_by([("g", "ascending"), ("s", "descending"), ("i", "ascending")])
    g = pc.rank(rows["g"], tiebreaker="dense").to_numpy()
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return rows.filter(pa.array(place < n))


def bounded_heaps(rows: DataFrame, n: int, held: int = 400_000) -> DataFrame:
    """(g, s, i) -> (g, s, i): the rows of a task, kept as one heap of at most n distinct items for each group.

    A heap is mergeable: an item among the n best of a group is among the n best of each task that has its best row. Heaps are cut back
    whenever `held` rows have come; if they are more than half of that afterwards, there being many groups, they are passed on, which
    changes how much is shuffled and not what comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[pa.Table] = []
        size = 0
        for b in batches:
            heaps.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size >= held:
                best = keep_best(pa.concat_tables(heaps), n)
                heaps, size = [best], best.num_rows
                if size > held // 2:
                    yield from best.to_batches()
                    heaps, size = [], 0
        if heaps:
            yield from keep_best(pa.concat_tables(heaps), n).to_batches()

    return rows.mapInArrow(run, rows.schema)


def top_n(items: DataFrame, group: str, score: str, ident: str, n: int = 5) -> DataFrame:
    """The n items of each group with the highest score; of equal scores the smaller identifier comes first.

    items: any columns; group, score and ident (an integer) name three of them, the others are ignored.
    Result: group, ident, rank (from 1).
    Rows whose group, score or ident is null never count. An ident delivered several times with the same group
    and score counts once; with several scores the highest counts. A group of fewer than n items gives them all.
    An empty table gives an empty result.

    Heaps of n distinct items a group are built by the tasks that read the rows; only heaps are shuffled, once, by group, and are merged there.
    So a group of a third of all rows is n rows a task, however large it is.
    """
    rows = items.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(ident).cast("bigint").alias("i")).where("g is not null and i is not null and s is not null")
    heaps = bounded_heaps(rows, n).repartition("g")
    # both steps keep the rows where the one exchange has put them
    one = heaps.groupBy("g", "i").agg(F.max("s").alias("s"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))
    return one.withColumn("rank", place).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(ident), "rank")
