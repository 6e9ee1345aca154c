r"""Problem 1: texts cut off by field limits."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, send_file, sent_file

BITS = 18
_token = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[^\w\s]+|_+")
# the point after an initial or a short title ends no sentence
_end = re.compile(r"(?:(?<!\b[A-Z])(?<!\b[A-Z][a-z])(?<!\b[A-Z][a-z]{2})(?<!\b[A-Z][a-z]{3})|(?<=\bMay)|(?<=\bJune)|(?<=\bJuly))[.!?。！？](?:[\"'”’»)\]]*)\s+(?=\S)|[\n\r|•·»]+\s*")
_closing = re.compile(r"(?:(?<!\.)[.!?。！？]|[.!?]{2}(?<!\.\.))[\"'”’»)\]*]*$|[!?]+[\"'”’»)\]*]*$")
_more = re.compile(r"(?:\.{3,}|…|\[(?:\.{3}|…)\]|\((?:\.{3}|…|more)\)|\bread more|\bsee more|�+)[\"'”’»)\]]*$", re.I)
_tag = re.compile(r"<(/?)([a-zA-Z][\w\-]*)([^<>]*)>")
_void = set("br img hr input meta link area base col embed source wbr".split())
_abbreviation = re.compile(r"(?:^|[\s(])(?:[A-Z]|St|Ave|Dr|Mr|Mrs|Ms|Jr|Sr|No|no|lic|Inc|Ltd|Co|vs|approx|e\.g|i\.e|z\.B)\.$")


def kind_of(text: str) -> str:
    t = text.lstrip()
    return "html" if t[:1] == "<" else "json" if t[:1] in "{[" and '"' in t[:40] else "script" if re.match(r"(?:on\w+\s*[:=]|function\b|var |window\.|\w+\()", t) else "text"


def _open_html(t: str) -> tuple[list[str], bool, str]:
    """Tags that are open at the end, whether it ends within a tag or entity, and the run of tags."""
    stack: list[str] = []
    run = []
    for close, tag, rest in _tag.findall(t):
        tag = tag.lower()
        run.append(close + tag)
        if tag in _void or rest.endswith("/"):
            continue
        if not close:
            stack.append(tag)
        elif tag in stack:
            while stack.pop() != tag:
                pass
    within = t.rfind("<") > t.rfind(">") or re.search(r"&#?\w{0,8}$", t) is not None
    return stack, within, " ".join(run)


def _open_json(t: str) -> tuple[int, bool]:
    """Brackets that are open at the end, and whether it ends within a string."""
    bare = re.sub(r"\\.", "", t)
    strings = bare.split('"')
    outside = "".join(strings[::2])
    return outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]"), len(strings) % 2 == 0


class Words:
    """The usual words of a table (see usual_words)."""

    def __init__(self, words: list[str] | None = None):
        self.order = sorted(words or [])
        self.known = set(self.order)

    def __contains__(self, w: str) -> bool:
        return w in self.known

    def begun(self, w: str) -> bool:
        """Whether w is not usual itself but begins a usual word."""
        i = bisect_left(self.order, w)
        return w not in self.known and i < len(self.order) and self.order[i].startswith(w)

    def masked(self, text: str) -> list[str]:
        """The words and signs of a text, digits being 0; a word with a capital that is not usual, as most names are, is Zz."""
        return ["Zz" if w[0].isupper() and w not in self.known else w for w in _token.findall(re.sub(r"\d", "0", text))]


def usual_words(values: DataFrame, total: int, share: float = 2e-4) -> list[str]:
    """The words, digits being 0, that are in at least `share` of the `total` distinct values of the column `value` (three at least), counted over all values.

    A word at the very end, which may be cut, is not counted. The values hold so many words between them that no more than the words of a value over share can be usual.
    """
    pattern = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*(?=.)"
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace("value", "[0-9]", "0"), F.lit(f"(?s){pattern}"), F.lit(0)))
    n = values.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["w"] for r in n.where(F.col("n") >= max(3, share * total)).where(F.length("w") <= 40).select("w").collect())


def _begun(text: str, usual: Words) -> set[tuple[str, ...]]:
    """The first one, two and three words of the sentences of a text that are seen to begin after another and to end."""
    if kind_of(text) != "text":
        return set()
    parts = re.findall(r"(?<=[.!?])(?<!\b[A-Z]\.)(?<!\b[A-Z][a-z]\.)(?<!\b[A-Z][a-z]{2}\.)(?<!\b[A-Z][a-z]{3}\.)\s+([^.!?|•·\n]{12,}[.!?])(?=\s|$)", text)
    return {tuple(w[:k]) for part in parts for w in [usual.masked(part.strip())[:3]] for k in (1, 2, 3) if len(w) == 3}


def _with_beginnings(kept: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Openers and how their first words begin, for a sentence of which no more is left."""
    return kept | {("~", x[0][:k]) for x in kept if len(x) == 1 for k in range(1, len(x[0]))}


def openers_of(texts: list[str], usual: Words, least: int = 2) -> frozenset[tuple[str, ...]]:
    """The first one, two and three words of sentences that are seen to begin after another and to end, each in at least `least` texts."""
    n = Counter(x for t in texts for x in _begun(t, usual))
    return frozenset(_with_beginnings({x for x, c in n.items() if c >= least}))


def _opener_hash(x: tuple[str, ...]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Openers:
    """openers_of() of a whole table, as sorted hashes of eight bytes that can be memory-mapped."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.memory = hashes, {}

    def __contains__(self, x: tuple[str, ...]) -> bool:
        if x not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            h = np.int64(_opener_hash(x))
            i = int(np.searchsorted(self.hashes, h))
            self.memory[x] = i < len(self.hashes) and self.hashes[i] == h
        return self.memory[x]


def _count_openers(words: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        usual = Words(words)
        flush = lambda: pd.DataFrame({"opener": list(n.keys()), "n": list(n.values())})
        for b in batches:
            for t in b["value"]:
                n.update("\0".join(x) for x in _begun(t, usual))
            if len(n) > 200_000:
                yield flush()
                n.clear()
        if n:
            yield flush()

    return run


def _hash_openers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"h": [_opener_hash(x) for x in _with_beginnings({tuple(o.split("\0")) for o in b["opener"]})]}, dtype="int64")


def opener_hashes(texts: DataFrame, words: list[str], least: int = 2) -> np.ndarray:
    """The sorted hashes of openers_of() over all of the column `value`, counted where the rows are. The driver gets eight bytes an opener."""
    # two ends with enough between them are needed; what begins with a tag is no text
    some = texts.select("value").where(~F.col("value").startswith("<") & F.col("value").rlike("[.!?][^.!?|•·]{13,}[.!?]"))
    kept = some.mapInPandas(_count_openers(words), "opener string, n bigint").groupBy("opener").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(kept.mapInPandas(_hash_openers, "h bigint").distinct().toArrow().column("h").to_numpy().astype(np.int64))


def _opening(words: list[str], openers: frozenset | Openers, earlier: bool) -> tuple[int, int]:
    """Where in the words a sentence known to end elsewhere begins last, and how many of its first words are there; fewer than
    three tell only right after the end of an earlier sentence."""
    if earlier and len(words) == 1 and ("~", words[0]) in openers:
        return 0, 1
    for i in range(len(words) - 1, -1, -1):
        if words[i][:1].isupper() or i == 0:
            have = tuple(words[i : i + 3])
            for k in (3, 2, 1):
                # the last word may be cut
                if len(have) >= k and have[:k] in openers and (k == 3 or earlier and i == 0 and len(words) <= k + 1):
                    return i, k
    return -1, 0


def _last(t: str) -> tuple[str, bool]:
    """What stands after the last end of a sentence or line, and whether a sentence ends right before it."""
    at, back, size = 0, len(t), 240
    while not at and back > 0:
        # from the end backwards, as far as it takes
        back, size = max(0, len(t) - size), 4 * size
        at = max((m.end() for m in _end.finditer(t, back)), default=0)
    return t[at:], at > 0 and re.search(r"[.!?][\"'”’»)\]]*\s+$", t[max(0, at - 60) : at]) is not None


def shape_of(word: str) -> str:
    return "lower" if word.islower() else "cap" if word[:1].isupper() else "other"


def describe(text: str, limit: int = 0, openers: frozenset | Openers = frozenset(), usual: Words = Words()) -> list[str]:
    """The features of one value by name: its closing characters, punctuation, open structure and last words, and how its
    length lies to the limit of its source."""
    kind = kind_of(text)
    t = text.rstrip()
    out = [f"kind {kind}"]
    if limit:
        gap = limit - len(text)
        near = "at" if gap == 0 else "over" if gap < 0 else "close" if gap <= 12 else "under"
        out.append(f"limit {kind} {near}")
    if _more.search(t):
        return [*out, "omission", f"omission {t[-1:]}"]
    if kind == "html":
        stack, within, run = _open_html(t)
        state = "within" if within else f"open {len(stack) > 0}"
        ends = "tag" if t.endswith(">") else "bare"
        return [*out, f"html {state}", f"html {state} {ends}", f"run {run[-60:]} {ends}", f"run {run[:40]} {state} {ends}", f"limit {near if limit else ''} html {state}"]
    if kind == "json":
        depth, string = _open_json(t)
        return [*out, f"json {depth > 0} {string}", f"json last {t[-1:]} {depth > 0}"]
    if kind == "script":
        return [*out, f"script {t.count('(') > t.count(')')} {t.count(chr(39)) % 2} {t.count(chr(34)) % 2} {t[-1:] in ';})'}", f"script last {t[-1:] if not t[-1:].isalnum() else 'a'}"]
    ws = text != t and not text.endswith("\n")
    quoted = t.count('"') % 2 == 1 or t.count("“") > t.count("”") or t.count("«") > t.count("»")
    paren = t.count("(") > t.count(")") or t.count("[") > t.count("]")
    closed = bool(_closing.search(t))
    short = closed and bool(_abbreviation.search(t[-12:]))
    out += [f"space {ws} {closed}", f"quote {quoted} {closed}", f"paren {paren} {closed}"]
    if closed and not short:
        return [*out, "closed", f"closed {t[-1:]}", f"limit {near if limit else ''} closed"]
    last, earlier = _last(t)
    words, raw = usual.masked(last), _token.findall(last)
    begin, known = _opening(words, openers, earlier)
    out += [f"opening {known} {earlier}", f"opening {known} {min(len(words) - max(begin, 0), 6)}"]
    if known == 3:
        words, raw = words[begin:], raw[begin:]
    n = len(words)
    c = t[-1:]
    form = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else c
    mail = re.search(r"\S+@\S*$", t)
    if mail:
        out += [f"mail {mail[0].rpartition('.')[2] if '.' in mail[0].rpartition('@')[2] else '-'}"]
    w1, w2, w3 = ([*words[::-1], "^", "^", "^"])[:3]
    first = " ".join(words[:2])
    name = raw[-1] if raw and w1 == "Zz" else ""
    # a word that is usual, one that begins a usual word, or neither
    end = re.sub(r"\d", "0", raw[-1]) if raw else ""
    state = f"{'whole' if end in usual else 'begun' if usual.begun(end) else 'neither'} {shape_of(end)}"
    listed = sum(x in "|/•·>»-–,;" for x in words) > 0
    shape = f"{'lower' if w1.islower() else 'name' if name else 'cap' if w1[:1].isupper() else 'num' if w1[:1] == '0' else w1}"
    out += [
        f"form {form} {earlier}", f"earlier {earlier} {shape} {listed}", f"w1 {w1}", f"w1 {w1} {earlier}", f"w2 {w2} {w1}", f"w3 {w3} {w2} {w1}", f"first {first}", f"first {first} last {w1}",
        f"first {first} n {min(n, 30)}", f"first {' '.join(words[:3])} {w2} {w1} {min(n, 30)}", f"n {min(n, 12)} {listed} {earlier}", f"opening {known} {w2} {w1}", f"opening {known} {w3} {w2} {w1} {shape}", f"opening {known} {earlier} {shape} {listed}", f"limit {near if limit else ''} {earlier} {ws} {shape}", f"c3 {t[-3:].lower() if w1 != 'Zz' else name[-1:]}",
        f"usual {state}", f"usual {state} {earlier} {listed}", f"usual {state} {first}", f"usual {state} {w2}", f"titled {all(x[:1].isupper() or not x[:1].isalpha() or len(x) < 4 for x in raw)} {earlier} {n > 5}",
    ]
    return out


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), np.int64, int(lens.sum())), np.concatenate(([0], np.cumsum(lens)[:-1])) if len(rows) else np.zeros(0, np.int64)


def _margins(rows: list[list[int]], w: np.ndarray, bias: float) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    flat, starts = _flat(rows)
    return np.add.reduceat(w[flat], starts) + bias


def fit(rows: list[list[int]], y: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features by AdaGrad over small batches."""
    w, g2 = np.zeros(1 << BITS, np.float64), np.full(1 << BITS, 1e-2)
    bias, order, rng = 0.0, np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), 256):
            part = order[i : i + 256]
            flat, starts = _flat([rows[k] for k in part])
            m = np.add.reduceat(w[flat], starts) + bias
            e = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]
            each = np.repeat(e, np.diff(np.append(starts, len(flat))))
            at, inv = np.unique(flat, return_inverse=True)
            g = np.bincount(inv, each) + decay * w[at] * len(part)
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            bias -= 0.02 * e.mean()
    return w, bias


def cut_copy(text: str, rng: np.random.Generator, limits: list[int]) -> str | None:
    """An intact value cut as fields and transfers cut: at a limit, at any letter or word, with a sign of omission; None where the cut can't be seen."""
    t = text.strip()
    if len(t) < 12:
        return None
    fit_in = [x for x in limits if x < len(t) - 1]
    how = rng.random()
    at = int(rng.choice(fit_in)) if fit_in and how < 0.4 else int(rng.integers(max(8, len(t) // 5), len(t) - 1)) if len(t) > 12 else 9
    piece = t[:at]
    how = rng.random()
    if how < 0.45 and " " in piece[5:]:
        piece = piece[: piece.rfind(" ") + (1 if rng.random() < 0.3 else 0)]
    if rng.random() < 0.12:
        piece = piece.rstrip(" ,;:") + str(rng.choice(["...", "…", " ...", " …"]))
    elif rng.random() < 0.04:
        piece += "�"
    s = piece.rstrip()
    if kind_of(t) == "text" and not _more.search(s) and _closing.search(s):
        return None
    return piece if len(s) >= 5 else None


def train(values: list[tuple[str, str]], limits: dict[str, list[int]], openers: frozenset | Openers = frozenset(), usual: Words = Words(), seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit on (source, value): values presumed intact, and cut copies of them.

    Not presumed intact: values that end in a sign of omission, have open structure, lie at a limit without an end of sentence,
    or have a last sentence without an end that begins as others that have one.
    Headings and lists end like cut texts, so unclosed values are taken too at first; those that the first model, which
    has seen cut copies of the very same wording, holds for cut are then left out, and a second model is fitted.
    """
    rng = np.random.default_rng(seed)
    whole, cuts = [], []
    for source, v in values:
        t, kind = v.rstrip(), kind_of(v)
        near = limits.get(source, [])
        limit = _limit(len(v), near)
        if not t or _more.search(t):
            continue
        if kind == "html":
            stack, within, _ = _open_html(t)
            bad = bool(stack) or within
        elif kind == "json":
            depth, string = _open_json(t)
            bad = depth > 0 or string
        elif kind == "script":
            bad = t.count("(") > t.count(")") or t[-1:] not in ";})"
        else:
            last, earlier = _last(t)
            bad = not _closing.search(t) and (len(v) in near or _opening(usual.masked(last), openers, earlier)[1] > 0)
        if bad:
            continue
        closed = kind != "text" or bool(_closing.search(t))
        whole.append((hashed(describe(v, limit, openers, usual)), closed))
        # headings, lists and the like are too short for a limit: only what has an end to lose is cut
        for _ in range(2 if closed else 0):
            c = cut_copy(v, rng, near)
            if c is not None:
                cuts.append(hashed(describe(c, _limit(len(c), near), openers, usual)))
    if not whole or not cuts:
        return np.zeros(1 << BITS), -1.0
    rows, y = [w for w, _ in whole] + cuts, np.r_[np.zeros(len(whole)), np.ones(len(cuts))]
    w, b = fit(rows, y, epochs=3, seed=seed)
    sure = _margins([r for r, _ in whole], w, b)
    keep = [r for (r, closed), m in zip(whole, sure) if closed or m < 0]
    return fit(keep + cuts, np.r_[np.zeros(len(keep)), np.ones(len(cuts))], seed=seed)


def _limit(n: int, limits: list[int]) -> int:
    """The limit that a value of n characters lies at or next under; 0 if none."""
    return next((x for x in sorted(limits) if n <= x), limits and max(limits) or 0)


def limits_of(lengths: DataFrame, share: float = 8.0, least: float = 0.003) -> dict[str, list[int]]:
    """From (source, len, n), n distinct values, counted over all: for each source the lengths at which its values pile up, more than `share` times what the five lengths
    on each side hold on average (plus a half, so that few values are no pile), and at least the part `least` of the source's. No source has more than 1 / least."""
    w = Window.partitionBy("source").orderBy("len").rangeBetween(-5, 5)
    around = lengths.select("source", "len", "n", F.sum("n").over(Window.partitionBy("source")).alias("all"), ((F.sum("n").over(w) - F.col("n")) / 10).alias("around"))
    found: dict[str, list[int]] = {}
    for r in around.where((F.col("n") > share * (F.col("around") + 0.5)) & (F.col("n") >= least * F.col("all"))).collect():
        found.setdefault(r["source"], []).append(r["len"])
    return found


def drawn(have: DataFrame, distinct: dict[str, int], sample: int, longest: int) -> list[tuple[str, str]]:
    """(source, value): for each field its part of `sample` distinct values of up to `longest` characters, the first by a hash. A value of a third of all rows is one."""
    per = sample // max(1, len(distinct))
    at = F.pmod(F.xxhash64("value"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("field_name") == f, F.lit(min(1.0, 1.2 * per / max(1, n)))) for f, n in distinct.items()]) if distinct else F.lit(0.0)
    few = have.where((at < share * F.lit(float(1 << 30))) & (F.length("value") <= longest)).groupBy("field_name", "value").agg(F.min("at").alias("at"))
    rows = []
    for f in sorted(distinct):
        rows += [(r[0], r[1]) for r in few.where(F.col("field_name") == f).orderBy(at, "value").limit(per).select("at", "value").collect()]
    return rows


def truncated(values: DataFrame, sample: int = 20_000, longest: int = 5_000, seed: int = 7) -> DataFrame:
    """(field_name, record_id, source, score, cut): every value with the probability that it breaks off before its end.

    values: (field_name, record_id, source, value). Null, empty and blank values are left out; source may be null. cut is score > 0.5. Rows delivered
    several times are scored as often. An empty table, or one without an intact value, gives scores under 0.5.

    The model is fitted on at most `sample` distinct values of up to `longest` characters, documented bounds; they are taken by a hash of the value, evenly from all
    fields. Limits, usual words and openers are counted over all values, and every value is scored whole. The openers are a file that every
    machine gets once and its workers map into memory; the usual words have a bound of their own.
    """
    have = values.where("value is not null and trim(value) <> ''").select("field_name", "record_id", F.concat_ws("/", "field_name", F.coalesce("source", F.lit("-"))).alias("at"), "source", "value")
    # values of different length are different, so these add up
    lengths = cut(have.groupBy("field_name", F.col("at").alias("source"), F.length("value").alias("len")).agg(F.approx_count_distinct("value", 0.02).alias("n")))
    limits = limits_of(lengths)
    distinct = {r[0]: r[1] for r in lengths.groupBy("field_name").agg(F.sum("n")).collect()}
    rows = drawn(have, distinct, sample, longest)
    words = usual_words(have.where(~F.ltrim("value").startswith("<")), sum(distinct.values()))
    usual = Words(words)
    hashes = opener_hashes(have, words)
    openers = Openers(hashes)
    file = send_file(values.sparkSession, "openers.npy", lambda path: np.save(path, hashes))
    w, bias = train(rows, limits, openers, usual, seed)
    at = np.flatnonzero(w)
    packed = (at.astype(np.int32), w[at].astype(np.float32))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = np.zeros(1 << BITS, np.float32)
        full[packed[0]] = packed[1]
        openers, usual = Openers(np.load(sent_file(file), mmap_mode="r")), Words(words)
        for b in batches:
            rows = [hashed(describe(v, _limit(len(v), limits.get(s, [])), openers, usual)) for s, v in zip(b["at"], b["value"])]
            p = 1 / (1 + np.exp(-np.clip(_margins(rows, full, bias), -30, 30)))
            yield pd.DataFrame({"field_name": b["field_name"], "record_id": b["record_id"], "source": b["source"], "score": p, "cut": p > 0.5})

    return have.mapInPandas(score, "field_name string, record_id bigint, source string, score double, cut boolean")


def rates(scored: DataFrame) -> DataFrame:
    """(field_name, source, n, n_cut, share): of each source, how many values there are and how many are cut; a record counts once."""
    once = scored.groupBy("field_name", "source", "record_id").agg(F.bool_or("cut").alias("cut"))
    return once.groupBy("field_name", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n"))
