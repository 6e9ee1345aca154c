"""Problem 10: abusive, hateful or sexually explicit passages."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

BITS = 17
# Signs that stand for letters in disguised words.
SIGNS = str.maketrans({"@": "a", "$": "s", "€": "e", "£": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "i"})
_silent = re.compile("[­​-‏⁠﻿]")
_spaced = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*·•~+/\\ ]){2,}[^\W_](?![^\W_])")
_disguised = re.compile(r"(?<![\w$@])(?=[\w@$!|€£]*[^\W\d_])(?=[\w@$!|€£]*[0-9@$!|€£])[^\W_@$]?[\w@$€£!|]*[^\W_]|(?<!\w)[@$][^\W_]{2,}")
_word = re.compile(r"[^\W\d_]+(?:[*#]+[^\W\d_]*)*|\d+")
_split = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|[\r\n\u0085  ]+|\s+[|•·»]\s+")
_closed = re.compile(r"[.!?…][\"'”’»)\]]*$")


def passages(text: str, longest: int = 40) -> list[str]:
    """The sentences and lines of a whole text; those of more than `longest` words as windows that overlap by half. A piece that layout
    tore off (no end of sentence, and under five words or followed by a small letter) is put together with the next."""
    whole: list[str] = []
    for s in _split.split(text):
        if not s or not s.strip():
            continue
        s = s.strip()
        if whole and not _closed.search(whole[-1]) and (s[:1].islower() or len(whole[-1].split()) < 5):
            whole[-1] += " " + s
        else:
            whole.append(s)
    if len(whole) > 1 and len(whole[-1].split()) < 3 and not _closed.search(whole[-1]):
        whole[-2:] = [f"{whole[-2]} {whole[-1]}"]
    out = []
    for s in whole:
        words = s.split()
        if len(words) <= longest:
            out.append(s)
        else:
            out += [" ".join(words[k : k + longest]) for k in range(0, len(words) - longest // 2, longest // 2)]
    return out


def reveal(passage: str) -> list[str]:
    """The words of a passage, disguise undone: hidden signs, spaced letters, signs and digits for letters, drawn-out letters, capitals; numbers are one word."""
    t = _silent.sub("", unicodedata.normalize("NFKC", passage))
    t = t.lower()
    t = _spaced.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]), t)
    t = _disguised.sub(lambda m: m[0].translate(SIGNS), t)
    t = re.sub(r"([^\W\d_])\1{2,}", r"\1", t)
    # a sign within a word: f*ck, id.iot, mor-on
    t = re.sub(r"(?<=[^\W\d_])[.·_~+](?=[^\W\d_])", "", t)
    return ["zznum" if w.isdigit() else re.sub(r"[*#]+", "*", w) for w in _word.findall(t)]


def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def word_features(w: str) -> list[int]:
    """The word itself and its 3- to 5-grams of letters."""
    p = f"<{w}>"
    return [_hash("w" + w), *(_hash(p[i : i + n]) for n in (3, 4, 5) for i in range(len(p) - n + 1))] if not w.startswith("zz") else [_hash("w" + w)]


def features(words: list[str], memory: dict) -> list[int]:
    out: list[int] = []
    for w in words:
        f = memory.get(w)
        if f is None:
            f = memory[w] = word_features(w)
        out += f
    out += [_hash(f"2 {a} {b}") for a, b in zip(words, words[1:])]
    return out


class Model:
    """Bags of subword embeddings, averaged and given to a linear softmax; both are trained together."""

    def __init__(self, dims: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (1 << BITS, dims)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (dims, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.rng = rng

    def train(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.4) -> Model:
        ge, gw, gb = np.full(len(self.e), 1e-3, np.float32), np.full_like(self.w, 1e-2), np.full_like(self.b, 1e-2)
        order = np.arange(len(rows))
        for _ in range(epochs):
            self.rng.shuffle(order)
            for i in range(0, len(order), 128):
                part = order[i : i + 128]
                lens = np.array([len(rows[k]) for k in part])
                flat = np.concatenate([rows[k] for k in part])
                starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
                h = np.add.reduceat(self.e[flat], starts) / lens[:, None]
                z = h @ self.w + self.b
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                d = p.copy()
                d[np.arange(len(part)), y[part]] -= 1
                d *= weight[part][:, None] / len(part)
                dh = (d @ self.w.T) / lens[:, None]
                at, inv = np.unique(flat, return_inverse=True)
                owner = np.repeat(np.arange(len(part)), lens)
                g = np.stack([np.bincount(inv, dh[owner, k]) for k in range(dh.shape[1])], 1).astype(np.float32)
                dw, db = h.T @ d, d.sum(0)
                ge[at] += (g * g).mean(1)
                gw += dw * dw
                gb += db * db
                self.e[at] -= rate * g / np.sqrt(ge[at])[:, None]
                self.w -= rate * dw / np.sqrt(gw)
                self.b -= rate * db / np.sqrt(gb)
        return self

    def scalars(self) -> tuple[np.ndarray, float]:
        """The model is linear once trained: what each feature adds to the margin, before the mean, and the margin of none."""
        v = self.w[:, 1] - self.w[:, 0]
        return self.e @ v, float(self.b[1] - self.b[0])


class Scorer:
    """Probabilities of passages and documents, with a bounded memory of words and pairs."""

    def __init__(self, per: np.ndarray, bias: float, remembered: int = 300_000):
        self.per, self.bias, self.remembered, self.words, self.pairs = per, bias, remembered, {}, {}

    def passage(self, words: list[str]) -> float:
        if not words:
            return 0.0
        if len(self.words) > self.remembered:
            self.words.clear()
        if len(self.pairs) > self.remembered:
            self.pairs.clear()
        total, n, per = 0.0, len(words) - 1, self.per
        for w in words:
            x = self.words.get(w)
            if x is None:
                f = word_features(w)
                x = self.words[w] = (float(per[f].sum()), len(f))
            total += x[0]
            n += x[1]
        for p in zip(words, words[1:]):
            x = self.pairs.get(p)
            if x is None:
                x = self.pairs[p] = float(per[_hash(f"2 {p[0]} {p[1]}")])
            total += x
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, total / max(1, n) + self.bias))))

    def document(self, text: str | None) -> float:
        """The score of the worst passage; 0 for a null, empty or blank text."""
        return float(max((self.passage(reveal(s)) for s in passages(text)), default=0.0)) if text else 0.0


def fit(labelled: list[tuple[str, int]], rounds: int = 2, folds: int = 3, right: float = 0.85, seed: int = 5) -> Scorer:
    """From whole texts and their labels to a scorer of passages.

    A text labelled 1 has at least one abusive passage, which is not told; and labels err (`right` is the share presumed right). So a passage, by its
    revealed words, is suspected if the labels of the texts that have it are likelier for an abusive passage than for a clean one. Of
    the suspected those are positive at first whose words are out of line in texts labelled 0. In each round every suspected passage is judged by a
    model of the other folds, which has not seen it, and only those that it holds for abusive are positive in the next; so passages
    of texts that are labelled 1 by mistake are not learned by heart.
    """
    memory: dict = {}
    docs = [([k for s in passages(t) if (k := tuple(reveal(s)))], y) for t, y in labelled]
    docs = [(ps, y) for ps, y in docs if ps]
    base = sum(y for _, y in docs) / max(1, len(docs))
    if not docs or base in (0.0, 1.0):
        return Scorer(np.zeros(1 << BITS, np.float32), -4.0)
    # words of fewer than three texts, names mostly, are one in all that is counted; what is learned are the words themselves
    times = Counter(w for ps, _ in docs for w in {w for p in ps for w in p})
    usual = {w for w, n in times.items() if n >= 3}
    key_of: dict[tuple, tuple] = {}
    for ps, _ in docs:
        for p in ps:
            if p not in key_of:
                key_of[p] = tuple(w if w in usual else "~" for w in p)
    feats = {p: np.array(features(list(p), memory), np.int32) for p in key_of}
    seen, words = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for ps, y in docs:
        keys = {key_of[p] for p in ps}
        seen[y].update(keys)
        # words that texts labelled 0 use as well, to tell which passages are out of line
        words[y].update({w for k in keys for w in k})
    alike = Counter(key_of.values())
    n0, n1 = sum(1 for _, y in docs if y == 0), sum(1 for _, y in docs if y == 1)

    def odd(k: tuple) -> float:
        return sum(max(0.0, np.log((words[1][w] + 0.5) / (n1 + 1) / ((words[0][w] + 0.5) / (n0 + 1)))) for w in set(k)) / (len(set(k)) + 1)

    # an abusive passage stands mostly in texts labelled 1, a clean one in as many as chance would have it
    for_it, against = np.log(right / base), np.log((1 - right) / (1 - base))
    oddness = {k: odd(k) for k in seen[1] if seen[1][k] * for_it + seen[0][k] * against > 0}
    positive = {k for k, o in oddness.items() if o > 0.5}
    if not positive:
        positive = set(sorted(oddness, key=lambda k: (-oddness[k], k))[: max(1, n1 // 2)])
    fold = {k: _hash(" ".join(k)) % folds for k in alike}
    chosen = {p for p, k in key_of.items() if k in positive}

    def model(ps: list[tuple], steps: int, r: int) -> Scorer:
        epochs = max(4, min(40, steps * 128 // max(1, len(ps))))  # as many steps for few passages as for many
        y = np.array([int(p in chosen) for p in ps])
        weight = np.array([min(4.0, 1 + np.log(seen[0][key_of[p]] + seen[1][key_of[p]])) / np.sqrt(alike[key_of[p]]) for p in ps], np.float32)
        weight[y == 1] *= min(6.0, max(1.0, 0.5 * weight[y == 0].sum() / max(1e-9, weight[y == 1].sum())))
        return Scorer(*Model(seed=seed + r).train([feats[p] for p in ps], y, weight, epochs).scalars())

    for r in range(rounds):
        used = [p for p, k in key_of.items() if k not in oddness or p in chosen or r]
        judges = [model([p for p in used if fold[key_of[p]] != f], 400, r * folds + f) for f in range(folds)]
        kept = {p for p, k in key_of.items() if k in oddness and judges[fold[k]].passage(list(p)) > 0.2}
        if not kept:
            break
        chosen = kept
    return model(list(key_of), 800, 99)


def scored(documents: DataFrame, labels: DataFrame, most: int = 6_000, seed: int = 5) -> DataFrame:
    """(doc_id, source, score, abusive) of every document; abusive is score > 0.5.

    documents: (doc_id, text, source), other columns ignored. A null, empty or blank text scores 0. labels: (doc_id, abusive) with any number of judgements a
    document; null ones never count, and a document gets the label of the majority, or none at a tie. Labels of documents that
    are not there are ignored. Without labels of both kinds every score is under 0.5.

    The model is fitted on at most about `most` labelled documents, a documented bound, taken by a hash of the id; every document is scored whole.
    """
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share <> 0.5")
    votes = votes.select("doc_id", (F.col("share") > 0.5).cast("int").alias("y"))
    share = min(1.0, most / max(1, votes.count()))
    drawn = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about `most` pairs of an id and a number, so texts needn't be moved
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    model = fit([(r["text"], r["y"]) for r in rows], seed=seed)
    at = np.flatnonzero(np.abs(model.per) > 1e-6)
    packed = (at.astype(np.int32), model.per[at].astype(np.float32), model.bias)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per = np.zeros(1 << BITS, np.float32)
        per[packed[0]] = packed[1]
        scorer = Scorer(per, packed[2])
        for b in batches:
            s = np.array([scorer.document(t if isinstance(t, str) else None) for t in b["text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": s, "abusive": s > 0.5})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, f"doc_id {kind}, source string, score double, abusive boolean")


def rates(judged: DataFrame) -> DataFrame:
    """(source, n, n_abusive, rate): the documents of each source (null is one) and how many are abusive; a doc_id counts once."""
    once = judged.groupBy("source", "doc_id").agg(F.bool_or("abusive").alias("abusive"))
    return once.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("abusive").alias("n_abusive")).withColumn("rate", F.col("n_abusive") / F.col("n"))
