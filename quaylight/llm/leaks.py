"""Problem 9: evaluation texts that leaked into the corpus."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

_word = re.compile(r"[^\W_]+")
_silent = re.compile("[­​-‏⁠﻿]")


def words_of(text: str) -> list[str]:
    """The words of a text whatever its case, punctuation, layout and hidden characters."""
    t = _silent.sub("", unicodedata.normalize("NFKC", text)).casefold()
    return _word.findall(t)


def parts_of(text: str) -> list[str]:
    """The lines and sentences of a text."""
    return [p for p in re.split(r"(?<=[.!?:])\s+|\n+", text) if p.strip()]


def item_words(items: DataFrame, least: int = 3) -> DataFrame:
    """(item_id, words): the words of each item without the lines or sentences, of three words or more, that `least` or more of all items have in common.

    An item of nothing but such lines keeps them; one without a word is left out. Of several texts of one item_id the smallest counts.
    """
    have = items.where("text is not null and item_id is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("text").alias("text"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, ws) for i, t in zip(b["item_id"], b["text"]) for k, p in enumerate(parts_of(t)) if (ws := words_of(p))]
            yield pd.DataFrame(rows, columns=["item_id", "k", "ws"]).astype({"item_id": "int64", "k": "int32"})

    parts = cut(have.mapInPandas(split, "item_id bigint, k int, ws array<string>")).withColumn("key", F.xxhash64("ws"))
    shared = parts.where("size(ws) >= 3").groupBy("key").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= least)
    told = parts.join(shared, "key", "left").select("item_id", F.col("n").isNotNull().alias("common"), F.struct("k", "ws").alias("part"))
    lists = told.groupBy("item_id").agg(F.collect_list(F.when(~F.col("common"), F.col("part"))).alias("own"), F.collect_list("part").alias("all"))
    kept = F.array_sort(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("all")))
    return lists.select("item_id", F.flatten(F.transform(kept, lambda p: p["ws"])).alias("words"))


RUN = 3  # words of a term


def terms_of(words: list[str]) -> list[tuple[str, ...]]:
    """The terms of the index: each run of three words. Single words of one trade stand in most texts of it and would retrieve nearly everything."""
    return [tuple(words[k : k + RUN]) for k in range(len(words) - RUN + 1)]


def least_mass(times: dict, weight: dict, number: float) -> float:
    """The least that the distinct terms behind `number` terms of an item can weigh: its lightest terms for their number, the last in part."""
    mass = 0.0
    for w in sorted(times, key=lambda w: (weight[w] / times[w], w)):
        if times[w] >= number:
            return max(1e-12, (mass + weight[w] * number / times[w]) * (1 - 1e-9))
        mass, number = mass + weight[w], number - times[w]
    return max(1e-12, mass * (1 - 1e-9))


class Index:
    """BM25 over a block of test items with block-max WAND.

    df, n and mean (how many items have a term, one if it isn't there, how many items there are, and their mean number of terms) are those of all items, so what is found does
    not depend on the blocks. `share` of an item's words lie in at least a third as many of its terms; a posting's weight is its BM25 weight over the least
    that so many of its terms can weigh. So whatever holds that share of an item, in one place or in many, scores 1 or more, however long the item or the text is.
    """

    def __init__(self, items: list[tuple[int, list[str]]], df: dict, n: int, mean: float, share: float = 1 / 3, block: int = 32, k1: float = 1.2, b: float = 0.75):
        self.ids = [i for i, _ in items]
        self.words = [ws for _, ws in items]
        self.grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        lists: dict[tuple, list[tuple[int, float]]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            terms = terms_of(ws)
            for k, w in enumerate(terms):
                self.grams[w].append((i, k))
            times = Counter(terms)
            raw = {w: math.log(1 + (n - df.get(w, 1) + 0.5) / (df.get(w, 1) + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(terms) / mean)) for w, f in times.items()}
            least = least_mass(times, raw, share * len(ws) / RUN)
            for w, x in raw.items():
                lists[w].append((i, x / least))
        self.docs = {w: [i for i, _ in p] for w, p in lists.items()}
        self.weights = {w: [x for _, x in p] for w, p in lists.items()}
        self.most = {w: max(x) for w, x in self.weights.items()}
        self.block = block
        self.block_most = {w: [max(x[k : k + block]) for k in range(0, len(x), block)] for w, x in self.weights.items()}

    def above(self, query: set[tuple[str, ...]], least: float = 1.0) -> dict[int, float]:
        """All items (by place) that score `least` or more."""
        terms = [w for w in query if w in self.docs]
        if sum(self.most[w] for w in terms) < least:
            return {}
        # words that even together add little are only looked up where the others come near
        common, spare = [], 0.0
        for w in sorted(terms, key=self.most.__getitem__):
            if spare + self.most[w] > 0.5 * least:
                break
            spare += self.most[w]
            common.append(w)
        total, least = least, least - spare
        skip = set(common)
        at = {w: 0 for w in terms if w not in skip}
        out: dict[int, float] = {}
        live = sorted(at, key=lambda w: self.docs[w][0])
        while live:
            bound, pivot = 0.0, -1
            for k, w in enumerate(live):
                bound += self.most[w]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = self.docs[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.docs[live[pivot + 1]][at[live[pivot + 1]]] == doc:
                pivot += 1
            # the maxima of the blocks in which doc would lie
            tight = 0.0
            for w in live[: pivot + 1]:
                p = bisect_left(self.docs[w], doc, at[w])
                if p < len(self.docs[w]):
                    tight += self.block_most[w][p // self.block]
            if tight >= least:
                score = 0.0
                for w in live[: pivot + 1]:
                    p = bisect_left(self.docs[w], doc, at[w])
                    if p < len(self.docs[w]) and self.docs[w][p] == doc:
                        score += self.weights[w][p]
                if score >= least:
                    for w in common:
                        p = bisect_left(self.docs[w], doc)
                        if p < len(self.docs[w]) and self.docs[w][p] == doc:
                            score += self.weights[w][p]
                    if score >= total:
                        out[doc] = score
            for w in live[: pivot + 1]:
                at[w] = bisect_left(self.docs[w], doc + 1, at[w])
            live = sorted((w for w in live if at[w] < len(self.docs[w])), key=lambda w: self.docs[w][at[w]])
        return out

    def held(self, text: list[str], places: set[int], run: int = 8, dense: float = 0.75, gap: int = 4) -> dict[int, float]:
        """The share of the words of each item that the text holds in running parts.

        Seeds are three equal words in a row; seeds in line, with at most `gap` words changed, added or missing between
        them, are one part. A part counts if it has `run` equal words or more (or the whole item), and these are `dense` of its length.
        """
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k in range(len(text) - RUN + 1):
            for i, p in self.grams.get(tuple(text[k : k + RUN]), ()):
                if i in places:
                    seeds[i].append((k, p))
        out = {}
        for i, pairs in seeds.items():
            size = len(self.words[i])
            parts: list[list] = []  # [last text word, last item word, first text word, first item word, item words]
            open_: list[list] = []
            for k, p in pairs:
                open_ = [x for x in open_ if k - x[0] <= gap + 1]
                fit = [x for x in open_ if x[1] < p + 3 and -3 <= p - x[1] <= gap + 1 and abs((p - x[1]) - (k - x[0])) <= 2]
                if fit:
                    x = max(fit, key=lambda x: len(x[4]))
                    x[0], x[1] = max(x[0], k + 2), max(x[1], p + 2)
                    x[4] |= {p, p + 1, p + 2}
                else:
                    x = [k + 2, p + 2, k, p, {p, p + 1, p + 2}]
                    parts.append(x)
                    open_.append(x)
            have: set[int] = set()
            for x in parts:
                span = max(x[0] - x[2], x[1] - x[3]) + 1
                if (len(x[4]) >= run or len(x[4]) >= 0.9 * size) and len(x[4]) >= dense * span:
                    have |= x[4]
            out[i] = len(have) / max(1, size)
        return out


def leaked(documents: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", share: float = 1 / 3, block: int = 5_000) -> DataFrame:
    """(ident, item_id, share): every document with the test items that it holds, and the share of the item's words.

    documents: any columns; items: (item_id, text). Null, empty and blank texts, and items of fewer than three words, hold and match nothing. A repeated
    document gives its rows once. Empty tables give an empty result.

    Each document is one query, with all its runs of three words, to the index of test items; every item is retrieved of which it may hold `share`
    (see Index: none is lost, whatever the lengths), and is aligned word by word with the whole document. Frequencies, lengths
    and common lines are counted over all items. The index takes them in blocks of at most `block` items and 400 words an item on average, so what is
    sent is bounded for any number of items; documents are read once for each block, and the rows do not depend on the blocks.
    """
    kind = documents.schema[ident].dataType.simpleString()
    have = cut(item_words(items))
    texts = spread(documents.where(F.trim(text) != "").select(F.col(ident).alias("id"), F.col(text).alias("text")))
    have = have.where(F.size("words") >= RUN)
    n, total = have.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words") - RUN + 1), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-total // (400 * block)))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - RUN + 1), lambda k: F.slice("words", k, RUN))
    terms = have.select("item_id", F.explode(F.array_distinct(runs)).alias("w"))
    df = terms.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    df = cut(df) if blocks > 1 else df
    found = None
    for k in range(blocks):
        mine = have.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = [(r[0], list(r[1])) for r in mine.orderBy("item_id").collect()]
        known = df if blocks == 1 else df.join(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("w").distinct(), "w")
        part = texts.mapInPandas(_search(rows, {tuple(r[0]): r[1] for r in known.where("n > 1").select("w", "n").collect()}, n, total / max(1, n), share), f"id {kind}, item_id bigint, share double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("id", "item_id").agg(F.max("share").alias("share")).withColumnRenamed("id", ident)


def _search(rows: list[tuple[int, list[str]]], df: dict[str, int], n: int, mean: float, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(rows, df, n, mean, share)
        for b in batches:
            ids, item_ids, shares = [], [], []
            for i, t in zip(b["id"], b["text"]):
                ws = words_of(t)
                near = set(index.above(set(terms_of(ws))))
                if near:
                    for p, s in index.held(ws, near).items():
                        if s >= share:
                            ids.append(i), item_ids.append(index.ids[p]), shares.append(s)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "item_id": pd.Series(item_ids, dtype="int64"), "share": pd.Series(shares, dtype="float64")})

    return run
