"""Problem 8: the corpus encoded with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_file, sent_file, spread

# Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: neighbours with the lowest rank are merged first, of equal ones the leftmost. n log n in its length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Lexicon:
    """A minimal acyclic transducer: words to their ids.

    The automaton shares equal suffixes; the arcs carry how many words lie before them, so the path of a word adds up to its
    number, and the number leads to its ids. All of it is in a few flat arrays, which can be memory-mapped.
    """

    NAMES = ("first", "label", "target", "skip", "final", "at", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        for k in self.NAMES:
            setattr(self, k, arrays[k])

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Lexicon:
        order = sorted(words)
        arcs: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) not yet shared
        last = b""

        def share(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                key = (ends[child], tuple(arcs[child].items()))
                known = register.setdefault(key, child)
                arcs[parent][byte] = known

        for w in order:
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            share(k)
            node = path[-1][2] if path else 0
            for byte in w[k:]:
                arcs.append({})
                ends.append(False)
                arcs[node][byte] = len(arcs) - 1
                path.append((node, byte, len(arcs) - 1))
                node = len(arcs) - 1
            ends[node] = True
            last = w
        share(0)
        number, todo = {0: 0}, [0]
        for node in todo:
            for t in arcs[node].values():
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
        count: dict[int, int] = {}
        stack = [0]
        while stack:
            node = stack[-1]
            if open_ := [t for t in arcs[node].values() if t not in count]:
                stack += open_
                continue
            count[stack.pop()] = ends[node] + sum(count[t] for t in arcs[node].values())
        first, label, target, skip = [0], [], [], []
        for node in todo:
            before = int(ends[node])
            for byte in sorted(arcs[node]):
                t = arcs[node][byte]
                label.append(byte), target.append(number[t]), skip.append(before)
                before += count[t]
            first.append(len(label))
        lens = [len(words[w]) for w in order]
        return cls(
            {
                "first": np.array(first, np.int32), "label": np.array(label, np.uint8), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32), "final": np.array([ends[n] for n in todo], np.uint8),
                "at": np.concatenate(([0], np.cumsum(lens))).astype(np.int32), "ids": np.array([i for w in order for i in words[w]], np.int32),
            }
        )

    def find(self, word: bytes) -> list[int] | None:
        node = n = 0
        for byte in word:
            a, b = int(self.first[node]), int(self.first[node + 1])
            k = a + int(np.searchsorted(self.label[a:b], byte))
            if k >= b or self.label[k] != byte:
                return None
            n += int(self.skip[k])
            node = int(self.target[k])
        return self.ids[self.at[n] : self.at[n + 1]].tolist() if self.final[node] else None

    def save(self, path: str) -> None:
        """One file: the length of the head, the head (name, type and size of each array), and the arrays, each at a multiple of 64 bytes."""
        head = json.dumps([[k, v.dtype.str, len(v)] for k, v in self.arrays.items()]).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for v in self.arrays.values():
                f.write(b"\0" * (-f.tell() % 64) + v.tobytes())

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        data = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(data[:8].tobytes(), "little")
        arrays, at = {}, 8 + size
        for k, kind, n in json.loads(data[8:at].tobytes()):
            at += -at % 64
            arrays[k] = data[at : at + n * np.dtype(kind).itemsize].view(kind)
            at += n * np.dtype(kind).itemsize
        return cls(arrays)


class Encoder:
    """Texts to ids by a lexicon, exact merges for words that it lacks, and a bounded memory of recent words."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon, remembered: int = 200_000):
        self.ranks, self.lexicon, self.remembered, self.memory = ranks, lexicon, remembered, {}
        self.split = regex.compile(PATTERN)

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memory = self.memory
        for word in self.split.findall(text):
            ids = memory.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                ids = self.lexicon.find(raw)
                if ids is None:
                    ids = merge(raw, self.ranks)
                if len(memory) >= self.remembered:
                    memory.clear()
                if len(word) <= 64:
                    memory[word] = ids
            out += ids
        return out


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    split = regex.compile(PATTERN)
    n: Counter = Counter()

    def flush() -> pd.DataFrame:
        rows = pd.DataFrame({"word": list(n), "n": list(n.values())})
        n.clear()
        return rows.astype({"word": "string", "n": "int64"})

    for b in batches:
        for t in b["text"].dropna():
            n.update(w for w in split.findall(t) if len(w) <= 64)
            if len(n) > 200_000:
                yield flush()
    if n:
        yield flush()


def encode(documents: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY, frequent: int = 50_000) -> DataFrame:
    """(ident, ids) of every row: its text by a public byte-level BPE vocabulary, without special tokens.

    documents: any columns. Null and empty texts have the ids [] (an empty list, not null). Strings of special tokens are ordinary text. Repeated
    rows are encoded as often. vocabulary is the path of a rank file.

    The words of all texts are counted; the `frequent` most frequent ones (of equal counts the smaller word) are compiled into a
    transducer, whose size this parameter bounds. It is a file that every machine gets once and its workers map into memory, so
    they share one copy. All other words are merged exactly: the choice of words changes the speed only.
    """
    spark = documents.sparkSession
    ranks = read_ranks(vocabulary)
    texts = spread(documents.select(F.col(ident).alias("id"), F.col(text).alias("text")))
    counted = texts.select("text").where("text <> ''").mapInPandas(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(frequent).select("word").collect()
    lexicon = Lexicon.compile({w: merge(w, ranks) for w in (r[0].encode() for r in top)})
    file = send_file(spark, "lexicon.bin", lexicon.save)
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(sent.value, Lexicon.mapped(sent_file(file)))
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [encoder(None if t is None or t is pd.NA or t != t else t) for t in b["text"]]})

    kind = documents.schema[ident].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", ident)
