"""Problem 3: freely typed values mapped to the entries of a reference list."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Short forms of words in titles, and of titles.
SHORT = {
    "mgr": "manager", "mngr": "manager", "mgmt": "management", "asst": "assistant", "assist": "assistant", "assoc": "associate", "coord": "coordinator",
    "dir": "director", "dirctr": "director", "spec": "specialist", "spclst": "specialist", "splst": "specialist", "exec": "executive", "ofcr": "officer", "off": "officer",
    "recept": "receptionist", "rcpt": "receptionist", "appr": "appraiser", "consult": "consultant", "cons": "consultant", "supv": "supervisor", "spvr": "supervisor", "sup": "supervisor", "trx": "transaction",
    "trans": "transaction", "ops": "operations", "oper": "operations", "prop": "property", "mktg": "marketing", "mkt": "marketing", "biz": "business", "bus": "business",
    "devel": "development", "dev": "development", "adm": "administrative", "admin": "administrative", "princ": "principal", "brkr": "broker", "bkr": "broker", "mng": "managing", "mgng": "managing",
    "reg": "regional", "regl": "regional", "rep": "representative", "repr": "representative", "photog": "photographer", "photo": "photographer", "fndr": "founder", "cofounder": "founder", "acq": "acquisition", "invest": "investment", "strat": "strategist",
    "reloc": "relocation", "mtg": "mortgage", "cert": "certified", "lux": "luxury", "re": "real estate", "realestate": "real estate", "vp": "vice president", "hr": "human resources", "ceo": "chief executive officer", "coo": "chief operating officer",
    "agt": "agent", "adv": "advisor", "bookkpr": "bookkeeper", "bkpr": "bookkeeper", "lst": "listing", "list": "listing", "trng": "training", "pres": "president", "rec": "receptionist", "ownr": "owner", "esc": "escrow",
}
# Words of rank, licence, office, quarter and address that change no entry.
ADDED = {
    *"senior sr junior jr lead head chief deputy acting interim licensed certified registered realtor notary public part time full residential commercial north south east west central team office branch division".split(),
    *"usa us u s a united states of america the of and a an at in for dept department region area greater near downtown uptown midtown metro old town county city downtown side district outskirts suburbs around surroundings est vicinity".split(),
    *"i ii iii emeritus retired bilingual mba cpa esq phd gri crs abr new".split(),
}


def plain_words(value: str) -> list[str]:
    """The words of a value in lower case without accents; short forms written out."""
    t = unicodedata.normalize("NFKD", value.replace("&", " and ")).lower()
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("'", "").replace("’", "")
    t = re.sub(r"\b(?:[a-z]\.){2,}[a-z]?", lambda m: m[0].replace(".", "") + " ", t)
    out: list[str] = []
    for w in re.findall(r"[^\W_]+", t):
        out += SHORT.get(w, w).split()
    if out[-2:] in (["chief", "executive"], ["chief", "operating"]):
        out.append("officer")
    return out


def grams(words: list[str]) -> set[str]:
    """The set that is compared: the 2-grams of each word with its borders."""
    return {p[i : i + 2] for w in words for p in [f"<{w}>"] for i in range(len(p) - 1)}


def distance(a: str, b: str, most: int) -> int:
    """Edits, a swap of neighbours being one, or most + 1 if there are more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most and (not before or min(before) > most):
            return most + 1
    return row[-1]


def same_word(typed: str, meant: str, more: int = 0) -> float:
    """How well a typed word stands for the word of an entry: 1 exact, less for a typo, plural or short form, else 0.

    more: edits allowed beyond those usual for the length of the word.
    """
    if typed == meant:
        return 1.0
    if typed in (meant + "s", meant + "es"):
        return 0.98
    if len(meant) < 4 or len(typed) < 3:
        return 0.0
    most = 1 if len(meant) < 5 else 2 if len(meant) < 9 else 3
    d = distance(typed, meant, most + more)
    if d <= most + more and (more or d / len(meant) <= 0.34):
        return 0.95 - 0.1 * d
    if len(typed) < len(meant) and typed[0] == meant[0]:
        if meant.startswith(typed):
            return 0.75
        at = -1
        for c in typed:
            at = meant.find(c, at + 1)
            if at < 0:
                return 0.0
        if len(typed) >= 3 and not any(c in "aeiou" for c in typed[1:]):
            return 0.7
    return 0.0


class References:
    """The entries of one field with an inverted index of the rare prefixes of their surface forms."""

    def __init__(self, field: str, rows: list[tuple[int, str, str | None]], least: float = 0.4):
        self.field, self.least, self.forms = field, least, []
        self.exact = {entry for _, entry, _ in rows}
        for ref, entry, short in rows:
            main = plain_words(entry.split(",")[0]) if short else plain_words(entry)
            state = plain_words(entry.split(",")[1]) if short and "," in entry else []
            code = [short.lower()] if short else []
            for words in [main] if not short else [main, main + state, main + code, [*main, *state, "usa"]]:
                self.forms.append((ref, main, state, code, grams(words)))
        count = Counter(g for f in self.forms for g in f[4])
        self.rank = {g: i for i, (g, _) in enumerate(sorted(count.items(), key=lambda x: (x[1], x[0])))}
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.ordered = []
        for k, f in enumerate(self.forms):
            order = sorted(f[4], key=self.rank.__getitem__)
            self.ordered.append(len(order))
            # forms that overlap by least * the larger set share one of the len - ceil(least * len) + 1 rarest grams
            for i, g in enumerate(order[: len(order) - self._ceil(least * len(order)) + 1]):
                self.index[g].append((k, i))

    @staticmethod
    def _ceil(x: float) -> int:
        return max(1, int(-(-x // 1)))

    def candidates(self, words: list[str]) -> dict[int, float]:
        """Form number -> Jaccard similarity, of all forms with at least `least`."""
        have = grams(words)
        # grams that no entry has are the rarest of all
        order = sorted(have, key=lambda g: self.rank.get(g, -1))
        n, met = len(order), {}
        for i, g in enumerate(order[: n - self._ceil(self.least * n) + 1]):
            for k, j in self.index.get(g, ()):
                m = self.ordered[k]
                if min(n, m) < self.least * max(n, m):  # length filter
                    continue
                if (common := met.get(k, 0)) < 0:
                    continue
                # positional filter: what was met so far, this gram, and the fewer of those that follow it on either side
                met[k] = common + 1 if common + 1 + min(n - i - 1, m - j - 1) >= self.least / (1 + self.least) * (n + m) - 1e-9 else -1
        out = {}
        for k, common in met.items():
            if common > 0:
                common = len(have & self.forms[k][4])
                s = common / (n + self.ordered[k] - common)
                if s >= self.least:
                    out[k] = s
        return out

    def verify(self, words: list[str], k: int) -> float:
        """The similarity of the words to the entry of form k, word by word; 0 if the entry isn't meant."""
        _, main, state, code, _ = self.forms[k]
        left, total, spare = list(words), 0.0, len(main) > 1
        for w in sorted(main, key=lambda w: (w not in words, -len(w))):
            best = max(((same_word(x, w), i) for i, x in enumerate(left)), default=(0.0, -1))
            if best[0] == 0.0:
                if w in ("of", "and", "the"):
                    continue
                # one word of several may be spelled worse, if all others are there
                best = max(((same_word(x, w, 1), i) for i, x in enumerate(left) if x not in ADDED), default=(0.0, -1)) if spare else best
                if best[0] == 0.0:
                    return 0.0
                spare = False
            total += best[0]
            left.pop(best[1])
        total /= len(main)
        if not state:
            rest = [x for x in left if x not in ADDED and not x.isdigit()]
            if self.field == "role" and rest:
                return 0.0
            return total - 0.02 * len(rest)
        rest = [x for x in left if x not in ("usa", "us") and not x.isdigit()]
        if code[0] in rest:
            rest.remove(code[0])
            total += 1
        else:
            hit = 0.0
            for w in state:
                s, i = max(((same_word(x, w), i) for i, x in enumerate(rest)), default=(0.0, -1))
                if s == 0.0:
                    break
                hit += s
                rest.pop(i)
            else:
                total += hit / len(state)
        rest = [x for x in rest if x not in ADDED]
        # another state than the entry's, or words of another place
        return 0.0 if rest else total

    def best(self, value: str) -> list[tuple[float, float, int]]:
        """The two entries nearest to a value: (similarity word by word, Jaccard, ref_id), the nearest first."""
        words = plain_words(value)
        if not words:
            return []
        kept = [w for w in words if w not in ADDED and not w.isdigit()] or words
        near = self.candidates(words) | self.candidates(kept)
        scored: dict[int, tuple[float, float]] = {}
        for k, s in near.items():
            v = self.verify(words, k)
            if v > 0:
                ref = self.forms[k][0]
                scored[ref] = max(scored.get(ref, (0.0, 0.0)), (round(v, 6), s))
        return sorted(((v, s, ref) for ref, (v, s) in scored.items()), reverse=True)[:2]


def meant(field: str, near: list[tuple[float, float, int]]) -> int:
    """The ref_id that the nearest entries of a field, nearest first, tell: 0 if there is none or two are equally near; two places of one name are."""
    if not near:
        return 0
    if len(near) > 1 and near[0][0] == near[1][0] and (field == "location" or near[0][1] == near[1][1]):
        return 0
    return near[0][2]


def map_values(values: DataFrame, references: DataFrame, least: float = 0.4, block: int = 20_000) -> DataFrame:
    """(field_name, record_id, ref_id) of each typed value that is not, letter for letter, an entry of its field.

    values: (field_name, record_id, value); references: (ref_id, field_name, entry, short_form). ref_id is 0 where no entry
    is meant, or two are equally near. Null, empty and blank values are left out; a value of punctuation only means none.
    A record delivered several times gives its rows once. With an empty reference list every value maps to 0.

    Each distinct value is compared once. Candidates come from a set-similarity join on word-bordered 2-grams: grams
    ordered by rarity in the list, prefixes only, length and positional filter, exact Jaccard >= least; they are then
    compared word by word and the best is kept. The join takes the reference list in blocks of about `block` entries of one field, so
    what a task holds is bounded for a list of any size, and merges the two best of each block, so the blocks do not change the result.
    """
    have = values.where("value is not null and trim(value) <> ''").select("field_name", F.col("record_id").cast("bigint").alias("record_id"), "value")
    # few bytes but much work: as many tasks as there are cores, which would else be put together
    distinct = have.select("field_name", "value").distinct().repartition(2 * have.sparkSession.sparkContext.defaultParallelism, "value")
    count = {r[0]: r[1] for r in references.groupBy("field_name").count().collect()}
    blocks = max([1, *(-(-n // block) for n in count.values())])
    distinct = cut(distinct) if blocks > 1 else distinct
    parts = []
    for b in range(blocks):
        mine = references if blocks == 1 else references.where(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == b)
        rows: dict[str, list] = {}
        for r in mine.where("entry is not null").select("field_name", "ref_id", "entry", "short_form").collect():
            rows.setdefault(r[0], []).append(tuple(r)[1:])
        parts.append(distinct.mapInPandas(_mapper(rows, least), "field_name string, value string, ref_id int, entry boolean, near array<struct<v:double,s:double,ref_id:int>>"))
    mapped = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        # two entries of each block are enough to tell the nearest of all, and whether another is as near
        mapped = mapped.groupBy("field_name", "value").agg(F.bool_or("entry").alias("entry"), F.slice(F.sort_array(F.flatten(F.collect_list("near")), False), 1, 2).alias("near"))
        a, b = F.get("near", F.lit(0)), F.get("near", F.lit(1))
        tie = F.coalesce((a["v"] == b["v"]) & ((F.col("field_name") == "location") | (a["s"] == b["s"])), F.lit(False))
        mapped = mapped.select("field_name", "value", F.when(tie, 0).otherwise(F.coalesce(a["ref_id"], F.lit(0))).alias("ref_id"), "entry")
    typed = have.distinct()
    return typed.join(mapped, ["field_name", "value"]).where("not entry").select("field_name", "record_id", "ref_id").distinct()


def _mapper(rows: dict[str, list[tuple]], least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs: dict[str, References] = {}
        for b in batches:
            near = []
            for f, v in zip(b["field_name"], b["value"]):
                if f not in refs:
                    refs[f] = References(f, rows.get(f, []), least)
                near.append(refs[f].best(v))
            yield pd.DataFrame(
                {
                    "field_name": b["field_name"], "value": b["value"], "ref_id": pd.array([meant(f, x) for f, x in zip(b["field_name"], near)], dtype="int32"), "entry": [v in refs[f].exact for f, v in zip(b["field_name"], b["value"])],
                    "near": [[{"v": v, "s": s, "ref_id": r} for v, s, r in x] for x in near],
                }
            )

    return run
