r"""Problem 4: template residue, filler and error-page text in place of content."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .truncation import BITS, hashed
from .truncation import fit as logistic

# Unresolved slots, wherever they stand in a value.
SLOTS = [
    r"\{\{[^{}]{0,80}\}\}?",
    r"\{%[^{}]{0,80}%\}?",
    r"[$#]\{[^{}\s]{1,80}\}",
    r"<%[=\-]?[^<>]{0,80}%>?",
    r"<\?(?:php|=)",
    r"%%\s?[A-Za-z][\w. \-]{0,60}%%",
    r"(?<![\w%])%[A-Z][A-Z0-9_]{2,60}%",
    r"%\([a-z_]\w{0,60}\)s",
    r"(?<!\w)__[A-Za-z][\w.\-]{0,60}?__(?!\w)",
    r"\[\[\s?[A-Za-z][\w. \-]{0,60}\]\]",
    r"\[(?:[a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:[._\-][a-z]+)+|[A-Z]+(?:_[A-Z]+)+|[A-Z][a-z]+(?:_[A-Z]?[a-z]+)+)\]",
    r"\[(?i:(?:your|the|insert|enter|add)\s[\w' \-]{2,60}|(?:company|business|site|agency|firm|brand|agent|office|page|client|first|last|street|phone|user|item|post|product)?[\s_\-]?(?:name|title|city|state|town|address|location|tagline|slogan|description|headline|heading|subtitle|phone|email|url|website|company|county|region|zip|neighbou?rhood|date|year|agent|logo|text))\]",
    r"<(?:[A-Z][A-Z_ ]{2,40}|(?i:your|insert|company|business|site|city|client)[\w \-]{0,40})>",
    r"\[object \w+\]",
    r"(?<![\w{])\{(?:\d|[a-z]+(?:[_.A-Z][A-Za-z_.]*)?)\}(?!\w)",
    r"(?<!\w)@@\w+@@|@@?(?:Model|ViewBag)\.\w+|\*\|[A-Z_:]+\|\*",
    r"(?<![\w.\-])undefined(?:\s+undefined|(?=\s*(?:[.,;:|]|$))|\s+(?:offers|sells|for|is|has|in|and|at|of|serves|serving)\b)|\b(?:Call|Contact|Visit|Welcome to|Serving|in|of|by|at|with|since|Email|from)\s+undefined\b|^\s*undefined\b",
    r"(?<![\w.\-])null(?:\s*,?\s*null\b|(?=\s*\.?\s*$))|\b(?:Call|Contact|Visit|Serving|Welcome to|Email)\s+null\b|^\s*null\s",
    r"(?<!\w)NaN(?!\w)",
]
# Seed labels for what a message says when it is filler, an error message or a demand for scripts. Digits are all 0.
MESSAGES = [
    r"\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur\b",
    r"\b(?:sample|dummy|placeholder|filler|example|default|demo) (?:text|paragraph|content|page|sentence|title|heading|description|copy)\b",
    r"\b(?:text|title|heading|headline|tagline|slogan|description|name|content|bio|subtitle|caption|paragraph|copy|address|summary) (?:goes|comes|will go|will appear) here\b",
    r"^(?:your|insert|enter|type|add|put|replace|edit|write)\b.{0,60}\b(?:here|this box|own (?:words|text|content)|description|tagline|subtitle|title|placeholder)\b(?! for you)",
    r"\binsert (?:your |the |a |company )?(?:company |business |site |page )?(?:name|description|text|title|tagline|content|address|bio)\b",
    r"\breplace (?:it|this|me)\b.{0,40}\b(?:own|your|text|content|words)\b",
    r"\b(?:type|enter|write|add) (?:your|a|some) (?:subtitle|title|text|tagline|description|content|bio|heading|headline|company name|business name)\b",
    r"\bshort paragraph about\b|\bto be (?:supplied|provided|added|written|confirmed) by (?:the )?(?:client|customer|owner|agency|team)\b",
    r"^\W*(?:(\w+)\W+\1\W+\1)\W*$",
    r"^\W*(?:x{3,}|X{3,})\b.*\bx{2,}|^\W*(?:x{2,}[\s.,]+){2,}",
    r"\basdf\w*\b|\bqwerty\b|\bfoo ?bar\b|^\W*(?:blah\W+){2,}",
    r"^\W*(?:todo|tbd|fixme|tba)\b",
    r"\b(?:company|business|site|agency|firm|brand|page) name (?:placeholder|here|goes|to be|tbd|todo)\b|^\W*(?:your )?(?:company|business|site|agency|firm) (?:name|title)\W*$|\byour (?:company|business|site|agency|firm) name\b",
    r"^\W*untitled(?: (?:document|page|site|post|\d+))?\W*$|^\W*(?:new|test|blank|default) (?:page|document|site|post)\b\W*(?:$|[-|]| \d)|^\W*(?:hello world|just another \w+ site)\b",
    r"^\W*sample page\b",
    r"\b(?:coming soon|under construction)\W*$",
    r"^\W*(?:http )?(?:error|err|fehler|erreur|hata|errore)\W{0,3}\d{3}\b|\b[045]\d\d[: \-]{1,3}(?:not found|forbidden|unauthorized|bad gateway|bad request|gateway|internal|service|server|access|error|page|too many|method)|\b(?:error|fehler|erreur) [045]\d\d\W*$|\b[045]\d\d (?:error|fehler|erreur)\b",
    r"^\W*(?:oops|sorry|uh.?oh|whoops)\b.{0,40}\b(?:page|wrong|found|error|broke)|\bpage (?:was |is |could |can ?)?(?:not|n.t|cannot)(?: be)? found\b(?!\w)|\bpage can.?(?:t|not) be found\b|\bpage (?:you|that you) .{0,40}(?:not exist|n.t exist|moved|removed|not found|n.t be found)|\bpage (?:does not|doesn.t|no longer) exist",
    r"\bp[aá]gina no (?:encontrada|existe|disponible)|\bno se (?:ha )?(?:encontr\w+|pudo encontrar) la p[aá]gina|\bpage (?:non trouv[ée]e|introuvable)|\bseite (?:wurde )?nicht gefunden|\bseite (?:konnte|existiert) nicht|\bpagina non trovata",
    r"^\W*(?:access denied|zugriff verweigert|acc[eè]s refus[ée]|acceso denegado|permission denied|forbidden|unauthorized|not found|bad gateway|bad request|gateway time-?out|service unavailable|internal server error|server error|request time-?out|too many requests)\b(?! to (?!this|the (?:page|server|site|resource|requested)))|\bdo(?:es)? not have permission to\b|\bdon.t have permission to (?:access|view|open)",
    r"\binternal server error\b|\berreur interne\b|\berror interno\b|\binterner (?:server)?fehler\b|\bbad gateway\b|\bgateway time-?out\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\btemporarily un(?:able to service|available)\b|\bmaintenance downtime\b|\bdown for maintenance\b",
    r"\b(?:could not|cannot|can.t|unable to|failed to|error) (?:connect(?:ing)?|establish(?:ing)?) (?:a )?(?:to |connection to )?(?:the )?(?:database|server|mysql|db|host|upstream)|\berror establishing a database connection\b|\bconnection (?:refused|timed out|reset by)\b|\bsql syntax\b",
    r"^\W*(?:warning|notice|fatal error|parse error|deprecated|uncaught|traceback|exception)\b\W.{0,80}(?:undefined|\bon line\b|\.php\b|\bin /|\berror\b|exception|most recent call|variable|index|function)|\bstack trace\b|\bnullpointerexception\b|\bon line \d+\W*$|\bundefined (?:variable|index|offset|function|method)\b",
    r"\b(?:account|site|website|domain|page) has (?:been )?(?:suspended|expired|disabled|been removed)\b|\bsession (?:has )?(?:expired|timed out)\b|\bthis (?:domain|site) is (?:for sale|parked)\b|\bsign in again to\b",
    r"^\W*just a moment\b(?! (?:homes|realty|of))|\bchecking (?:your browser|that you are|if you are|if the site)|\b(?:not|are) a robot\b|\bverify (?:that )?you are (?:a )?human\b|\bcomplete the captcha\b|\bddos protection\b|\bray id\b",
    r"\b(?:enable|activate|activer|activez|activar|activa|active|aktivieren|aktiviere|habilitar|habilite|allow|turn on|switch on|einschalten|permita|autorisez|requires?|need|needs|require) (?:sie |el |los |las |le |les |bitte |your |the )?(?:java ?script|scripts?|cookies|js)\b|\bjava ?script (?:is |muss |must |needs? |has to |and cookies |est |est[aá] |ist |wird )?(?:to be |be |sein )?(?:disabled|required|enabled|aktiviert|ben[oö]tigt|d[ée]sactiv[ée]|deshabilitado|desactivado|deaktiviert|off\b|turned off|erforderlich|n[ée]cessaire|necesario|not enabled|blocked|aktivieren)|\bscripts? (?:are |is |be )?(?:required|disabled|blocked|needed)\b|\bblocks? (?:java)?scripts?\b|\bbrowser (?:is out of date|does not support|doesn.t support|is not supported)\b|\bunsupported browser\b|\bwithout java ?script\b|\bjava ?script\b.{0,40}\b(?:einschalten|aktivieren|activer|activar)\b",
]
_slot = "|".join(f"(?:{x})" for x in SLOTS)


def is_seed(value: str) -> bool:
    """Whether a value, its digits being 0, is worded like a known kind of filler, error message or demand for scripts."""
    t = value.replace("’", "'").lower()
    return any(re.search(m, t) for m in MESSAGES)


def has_slot(text: str) -> bool:
    return re.search(_slot, text) is not None


_space = re.compile(r"[\s\u0085\u00a0\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+")
SPREAD = 16  # hosts are counted up to this number
MINED = "id bigint, field_name string, leaf bigint, slot boolean, seed boolean, words array<string>, n bigint, seeds bigint, hosts array<bigint>"


def words_of(value: str) -> list[str]:
    """The words of a value; in each, digits are one and the same sign."""
    return re.sub(r"\d", "0", _space.sub(" ", value).strip()).split(" ")


def leaf_of(words: list[str], depth: int) -> int:
    """The leaf of the tree that a value comes to: by the number of its words, its first `depth` words and its last."""
    path = "\0".join([str(len(words)), *words[:depth], words[-1]])
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _mine(depth: int, held: int = 100_000):
    """One pass over the values: each with its leaf and what can be told of it alone, and the part of the tree that the task has grown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, bool, bool]] = {}
        tree: dict[int, list] = {}

        def grown() -> pd.DataFrame:
            rows = [(None, None, leaf, None, None, w, n, s, sorted(h)) for leaf, (w, n, s, h) in tree.items()]
            tree.clear()
            return pd.DataFrame(rows, columns=["id", "field_name", "leaf", "slot", "seed", "words", "n", "seeds", "hosts"]).astype({"id": "Int64", "n": "Int64", "seeds": "Int64", "slot": "boolean", "seed": "boolean"})

        for b in batches:
            out = []
            for v, host in zip(b["v"], b["host"]):
                words = None
                if v not in known:
                    words = words_of(v)
                    if len(known) > held:
                        known.clear()
                    known[v] = (leaf_of(words, depth), has_slot(v), is_seed(" ".join(words)))
                leaf, slot, seed = known[v]
                out.append((leaf, slot, seed))
                if leaf not in tree:
                    tree[leaf] = [words or words_of(v), 0, 0, set()]
                x = tree[leaf]
                if words and x[0] is not words:
                    x[0] = [p if p == q else None for p, q in zip(x[0], words)]
                elif words is None and x[1] == 0:
                    x[0] = words_of(v)
                x[1], x[2] = x[1] + 1, x[2] + seed
                if host == host and host is not None and (len(x[3]) < SPREAD or host < max(x[3])):
                    x[3] = set(sorted(x[3] | {int(host)})[:SPREAD])
            rows = pd.DataFrame(out, columns=["leaf", "slot", "seed"])
            yield rows.assign(id=b["id"].to_numpy(), field_name=b["field_name"].to_numpy(), words=None, n=None, seeds=None, hosts=None).astype({"n": "Int64", "seeds": "Int64"})
            if len(tree) > held:
                yield grown()
                # what is remembered of a value is no longer in the tree
                known.clear()
        if tree:
            yield grown()

    return run


def mine(values: DataFrame, depth: int = 4) -> DataFrame:
    """(id, field_name, v, host) -> the rows of MINED: for each value (id, field_name, leaf, slot, seed), and parts of a fixed-depth prefix tree (leaf, words, n, seeds, hosts).

    A leaf's words are null where its values differ; n counts its values and seeds those that are seeds; hosts are the smallest hashes of up to SPREAD hosts. Every task grows its own tree,
    so values are not shuffled, and a template of a third of all values is one row a task.
    """
    return values.mapInPandas(_mine(depth), MINED)


def templates_of(mined: DataFrame) -> DataFrame:
    """(leaf, template, n, seeds, spread): the parts of the tree merged; a word that differs is <*>."""
    same = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x == y, x))
    lists = mined.where("words is not null").groupBy("leaf").agg(F.collect_list("words").alias("w"), F.sum("n").alias("n"), F.sum("seeds").alias("seeds"), F.flatten(F.collect_list("hosts")).alias("hosts"))
    merged = F.reduce("w", F.get("w", F.lit(0)), same)
    text = F.array_join(F.transform(merged, lambda x: F.coalesce(x, F.lit("<*>"))), " ")
    return lists.select("leaf", text.alias("template"), "n", "seeds", F.least(F.size(F.array_distinct("hosts")), F.lit(SPREAD)).alias("spread"))


def describe(template: str) -> list[str]:
    """The features of a template: its words, their beginnings and the pairs of them. How often and how widely it is spread is none, as that grows with the table."""
    bare = [re.sub(r"^\W+|\W+$", "", w) or w for w in template.lower().split(" ")]
    return [*{f"w {w}" for w in bare}, *{f"p {a} {b}" for a, b in zip(bare, bare[1:])}, f"begin {' '.join(bare[:2])}", *{f"c {w[:4]}" for w in bare if len(w) > 5}]


def fit(rows: list[tuple[int, str, bool]], folds: int = 5, seed: int = 3) -> list[tuple[np.ndarray, float]]:
    """From (leaf, template, seed) to one model for each fold of the leaves, which has not seen that fold: a seed is learned from others like it only."""
    fold = np.array([r[0] % folds for r in rows], int)
    feats, y = [hashed(describe(r[1])) for r in rows], np.array([float(r[2]) for r in rows])
    out = []
    for k in range(folds):
        use = np.flatnonzero(fold != k)
        # without seeds, or without others, nothing is learned
        out.append(logistic([feats[i] for i in use], y[use], epochs=5, seed=seed) if 0 < y[use].sum() < len(use) else (np.zeros(1 << BITS), 0.0))
    return out


def margins(models: list[tuple[np.ndarray, float]], leaf: Iterable[int], template: Iterable[str]) -> np.ndarray:
    """How much speaks for a message in each template, by the model of the folds it is not in."""
    return np.array([w[hashed(describe(t))].sum() + b for x, t in zip(leaf, template) for w, b in [models[x % len(models)]]], float)


def residue(records: DataFrame, ident: str, fields: list[str], host: str | None = None, depth: int = 4, sample: int = 10_000, trust: float = 8.0, doubt: float = 1.0) -> DataFrame:
    """(ident, field_name, kind) of each value that is, or contains, residue; kind is 'message' or 'slot'.

    records: any columns; ident (an integer), the fields and host (the site of a record, if known) name some of them. Null, empty and blank values are no residue.
    A record delivered several times gives its rows once. Every value is mined and searched whole. An empty table gives an empty result.

    Values are grouped to templates by a fixed-depth prefix tree. Known wordings are seed labels only: a linear model over the words of templates is fitted on at most 2 * `sample` of them (a documented bound, taken by leaf; of each its first 500
    characters) and judges each template once, by folds that it is not in. Its values take the verdict over: a seed is a message unless the template's margin speaks
    against it by `trust`; another value is one if it speaks for it by `doubt`, and the template is spread over unlike hosts, as messages of servers and builders are. Unresolved slots are looked for in each value itself.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in fields]))
    site = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(host), F.lit("")), r"^(?:[A-Za-z]+:/+)?(?:www\.)?([^/?#]*)", 1))) if host else F.lit(None).cast("bigint")
    long = records.select(F.col(ident).cast("bigint").alias("id"), site.alias("host"), stack.alias("x")).select("id", "host", "x.field_name", "x.v").where("v is not null and trim(v) <> ''")
    mined = cut(mine(spread(long), depth))
    templates = cut(templates_of(mined))
    drawn = []
    for kind in ("seeds = n", "seeds = 0"):
        drawn += templates.where(kind).orderBy("leaf").limit(sample).select("leaf", F.substring("template", 1, 500), F.expr("seeds > 0")).collect()
    models = fit([tuple(r) for r in drawn])
    packed = [(np.flatnonzero(w).astype(np.int32), w[np.flatnonzero(w)].astype(np.float32), b) for w, b in models]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = []
        for at, x, bias in packed:
            w = np.zeros(1 << BITS)
            w[at] = x
            known.append((w, bias))
        for b in batches:
            yield pd.DataFrame({"leaf": b["leaf"], "margin": margins(known, b["leaf"], b["template"]), "spread": b["spread"]})

    judged = templates.mapInPandas(judge, "leaf bigint, margin double, spread int")
    told = mined.where("id is not null").select("id", "field_name", "leaf", "slot", "seed").distinct().join(judged, "leaf")
    message = F.when(F.col("seed"), F.col("margin") > -trust).otherwise((F.col("margin") > doubt) & (F.col("spread") > 1))
    found = told.withColumn("kind", F.when(message, "message").when(F.col("slot"), "slot")).where("kind is not null")
    return found.select(F.col("id").cast(records.schema[ident].dataType).alias(ident), "field_name", "kind").distinct()
