"""Problem 7: variant spellings of names typed by people."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Familiar forms of given names.
FAMILIAR = {
    "anthony": "tony ant", "charles": "charlie chuck chas chaz", "deborah": "debbie deb debby", "dolores": "lola lolita dolly", "elizabeth": "liz beth lizzie betty eliza betsy lisa libby",
    "francisco": "paco pancho frank cisco kiko", "frederick": "fred freddie freddy rick", "gabriela": "gabi gaby", "gregory": "greg gregg", "guadalupe": "lupe lupita", "harold": "harry hal", "hideko": "hide",
    "ignacio": "nacho iggy", "ingeborg": "inge inga", "jonathan": "jon jonny johnny jonnie", "katherine": "kate kathy katie kat kathie kay kitty", "leonard": "leo len lenny lennie", "margaret": "meg peggy maggie marge margie greta rita",
    "michael": "mike mick mickey mikey", "nathaniel": "nate nat nathan", "oliver": "ollie olly", "olumide": "olu", "penelope": "penny pen", "priyanka": "pri priya", "robert": "bob bobby rob robbie bert",
    "rosalind": "roz ros rosie rose", "samuel": "sam sammy", "theodore": "ted teddy theo", "ursula": "uschi ula", "victoria": "vicky vicki tori vic", "vincent": "vince vinny vinnie", "walter": "walt wally", "william": "bill billy will willie liam",
    "xiomara": "xio mara", "yolanda": "yoli yola", "zachary": "zach zack zac", "alexander": "alex sandy", "benjamin": "ben benny", "christopher": "chris", "daniel": "dan danny", "edward": "ed eddie ned", "james": "jim jimmy jamie", "jennifer": "jen jenny", "joseph": "joe joey", "matthew": "matt",
    "nicholas": "nick", "patricia": "pat patty trish", "richard": "dick rich richie", "stephen": "steve", "susan": "susie", "susannah": "sue suzy suzie susanna", "thomas": "tom tommy", "timothy": "tim", "andrew": "andy drew", "rebecca": "becky", "barbara": "barb babs", "catherine": "cathy", "jacqueline": "jackie", "raymond": "ray", "lawrence": "larry",
}
_familiar = {short: full for full, shorts in FAMILIAR.items() for short in shorts.split()}
# Titles, suffixes and callings beside a person's name; words of form in a firm's name.
TITLES = set("mr mrs ms miss mx dr prof sir madam jr sr ii iii iv esq phd mba cpa gri crs abr broker realtor agent owner manager notary she her he him they them hers his".split())
LEGAL = set("inc incorporated llc ltd limited co corp corporation company plc lp llp gmbh sa the and of a an".split())
# Short forms of the words for a firm's trade.
TRADE = {
    "rlty": "realty", "rlt": "realty", "grp": "group", "gp": "group", "ests": "estates", "est": "estates", "props": "properties", "prop": "property", "ptnrs": "partners", "ptnr": "partners", "prtnrs": "partners", "re": "real estate",
    "hm": "home", "hms": "homes", "brkge": "brokerage", "brkg": "brokerage", "brokg": "brokerage", "tm": "team", "ld": "land", "assocs": "associates", "mgmt": "management", "dev": "development",
}
TRADES = set("realty group estates properties property partners real estate home homes brokerage team land associates management development living agency".split())


def squashed(name: str) -> str:
    """A name without letter case, white space and punctuation."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", name).casefold())


def _plain(name: str) -> str:
    t = unicodedata.normalize("NFKD", name).lower()
    return "".join(c for c in t if not unicodedata.combining(c)).replace("’", "'")


def person_key(name: str) -> tuple[str, list[str]]:
    """('', the words that name a person: familiar forms written out, middle names kept, sorted; an initial beside two whole names says nothing, another short one keeps its dot)."""
    t = re.sub(r"\([^)]*\)|\[[^\]]*\]|\"[^\"]*\"", " ", _plain(name))
    words = [w for w in re.findall(r"[^\W\d_](?:[^\W\d_]|['\-](?=\w))*", t) if w not in TITLES]
    if sum(len(w) > 1 for w in words) >= 2:
        words = [w for w in words if len(w) > 1]
    words = [_familiar.get(w, w) for w in words]
    return "", sorted(w + "." if len(w) == 1 else w for w in words)


def firm_key(name: str) -> tuple[str, list[str]]:
    """(the words of the trade, sorted; the other words, sorted), without words of legal form; a short one keeps its dot."""
    t = re.sub(r"\br\.\s?e\.", "re ", _plain(name))
    trade, words = set(), []
    for w, dot in re.findall(r"([^\W_]+)(\.?)", t):
        if w in ("co", "company") and "land" in trade:
            trade.add("company")
        if w in LEGAL:
            continue
        for x in TRADE.get(w, w).split():
            near = next((v for v in TRADES if x != v and len(x) >= 4 and len(v) >= 5 and x[0] == v[0] and abs(len(x) - len(v)) <= 1 and _one_edit(x, v)), x) if x not in TRADES else x
            if near in TRADES:
                trade.add(near)
            else:
                words.append(x + "." if len(x) == 1 or (dot and len(x) <= 4) else x)
    return " ".join(sorted(trade)), sorted(words)


def _one_edit(a: str, b: str) -> bool:
    """One letter more, less, another, or two neighbours swapped."""
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def _parse(key: Callable[[str], tuple[str, list[str]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [key(n) for n in b["name"]]
            yield pd.DataFrame({"scope": b["scope"], "name": b["name"], "n": b["n"], "norm": [squashed(n) for n in b["name"]], "trade": [k[0] for k in keys], "words": [k[1] for k in keys]})

    return run


def _ends(w: Column) -> Column:
    """The q-grams at the borders of a word, 3 letters long, 2 in words of up to seven: one edit in a word of five letters or more leaves one of the two as it is."""
    long, mid = F.length(w) >= 7, F.length(w) <= 7
    return F.array_compact(F.array(*[F.when(c, F.concat(F.lit("^"), F.substring(w, 1, k))) for c, k in ((long, 3), (mid, 2))], *[F.when(c, F.concat(F.substring(w, -k, k), F.lit("$"))) for c, k in ((long, 3), (mid, 2))]))


def _swapped(a: Column, b: Column) -> Column:
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def _near_pairs(nodes: DataFrame) -> DataFrame:
    """(node, n, node2, n2, d, w, w2, rare) of nodes of two whole words: both are near, in whatever order.

    The prefix of a node is each pair of border q-grams of its two words. Near is one edit or swap in one word, or in each if both have five letters; rare asks
    that of two edits in one word of six letters or more (w, w2) one word be in no other node.
    """
    two = nodes.where("not short and size(words) = 2").select("node", "n", "scope", "trade", F.get("words", F.lit(0)).alias("a"), F.get("words", F.lit(1)).alias("b"))
    signs = F.array_distinct(F.flatten(F.transform(_ends(F.col("a")), lambda x: F.transform(_ends(F.col("b")), lambda y: F.array_join(F.array_sort(F.array(x, y)), " ")))))
    left = two.select("node", "n", "a", "b", "scope", "trade", F.explode(signs).alias("sign"))
    right = left.select(F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("b").alias("b2"), "scope", "trade", "sign")
    met = left.join(right, ["scope", "trade", "sign"]).where("node < node2 and abs(length(a) + length(b) - length(a2) - length(b2)) <= 2")
    cost = lambda x, y: F.levenshtein(x, y, 2)
    told = met.select("node", "n", "node2", "n2", "a", "b", "a2", "b2", cost("a", "a2").alias("aa"), cost("b", "b2").alias("bb"), cost("a", "b2").alias("ab"), cost("b", "a2").alias("ba"))
    # one row a pair, whatever q-grams it met by; what follows is computed from its columns
    told = told.where("(aa >= 0 and bb >= 0) or (ab >= 0 and ba >= 0)").distinct()
    straight = (F.col("aa") >= 0) & (F.col("bb") >= 0) & ((F.col("ab") < 0) | (F.col("ba") < 0) | (F.col("aa") + F.col("bb") <= F.col("ab") + F.col("ba")))
    pick = lambda x, y: F.when(straight, F.col(x)).otherwise(F.col(y))
    best = told.select("node", "n", "node2", "n2", F.col("a").alias("x"), F.col("b").alias("y"), pick("a2", "b2").alias("x2"), pick("b2", "a2").alias("y2"), pick("aa", "ab").alias("d1"), pick("bb", "ba").alias("d2"))
    one1, one2 = F.col("d1").between(0, 1) | _swapped(F.col("x"), F.col("x2")), F.col("d2").between(0, 1) | _swapped(F.col("y"), F.col("y2"))
    w, w2 = (F.when(F.col("d1") > 0, F.col(p)).otherwise(F.col(q)) for p, q in (("x", "y"), ("x2", "y2")))
    out = best.select("node", "n", "node2", "n2", (F.col("d1") + F.col("d2")).cast("int").alias("d"), w.alias("w"), w2.alias("w2"), ((F.col("d1") == 0) | (F.col("d2") == 0)).alias("single"), (one1 & one2).alias("usual"), F.least(*[F.length(c) for c in ("x", "x2", "y", "y2")]).alias("least"))
    out = out.withColumn("rare", ~F.col("usual")).where("d > 0 and ((single and usual and greatest(length(w), length(w2)) > 3) or (single and least(length(w), length(w2)) >= 6) or (usual and least >= 5))")
    return out.select("node", "n", "node2", "n2", "d", "w", "w2", "rare")


def _leaders(links: DataFrame) -> DataFrame:
    """(node, up): the leading spelling of each node that has one, from verified links (node, n, node2, n2, d), each given once.

    A node follows, of its neighbours that come before it, the nearest and of these the first: by the power of three of its records,
    then by the number of its neighbours at one edit, records and key. Paths are followed to their end, twice as far each round.
    """
    both = links.unionByName(links.select(F.col("node2").alias("node"), F.col("n2").alias("n"), F.col("node").alias("node2"), F.col("n").alias("n2"), "d"))
    beside = both.groupBy("node").agg(F.count_if(F.col("d") == 1).alias("beside"))
    known = both.join(beside, "node").join(beside.select(F.col("node").alias("node2"), F.col("beside").alias("beside2")), "node2")
    place = lambda n, beside, node: F.struct(F.floor(F.log(F.col(n)) / F.log(F.lit(3.0)) + 1e-9).alias("power"), F.col(beside).alias("beside"), F.col(n).alias("n"), F.col(node).alias("node"))
    ahead = known.withColumn("place", place("n2", "beside2", "node2")).where(F.col("place") > place("n", "beside", "node"))
    top = cut(ahead.groupBy("node").agg(F.max_by("node2", F.struct(-F.col("d"), "place")).alias("up")))
    while True:
        # the order is total, so there are no rings, and a node without a row is an end
        far = top.select(F.col("node").alias("up"), F.col("up").alias("far"))
        moved = cut(top.join(far, "up", "left").select("node", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("on")))
        top = moved.select("node", "up")
        if moved.where("on").isEmpty():
            return top


def linked_names(records: DataFrame, key: Callable[[str], tuple[str, list[str]]]) -> DataFrame:
    """(id, norm, entity): the entity that each record's name means, within its scope.

    records: (scope bigint, id bigint, name). Names are compared within a scope only. Null scopes, ids and names, and names without a
    letter or digit, are left out; a record delivered several times counts once. norm is the name without letter case,
    white space and punctuation; entity is a hash of scope and leading spelling.

    1. Each distinct name becomes the sorted set of its words (see person_key, firm_key): order, titles, legal forms, trade
       abbreviations and familiar forms no longer matter. Equal sets are one node.
    2. Candidates come from a join on prefixes of q-grams: of two words, a q-gram at the border of each; of more or fewer words, all words but one and a q-gram at a border
       of that one. One edit in a word of five letters or more cannot touch both borders, so no such pair is lost, and a surname that is shared by many
       is only compared with what is near in the other word too.
    3. They are verified word by word: one edit or swap in a word, or in both of two, or two edits in a long word that is rare within the scope (rare words
       count more); or a short form that begins the word, if it begins that of one entity only; or a person's name that lacks a word, if it lacks it of one entity only.
    4. Each node follows its best-supported neighbour of more support to the end of the path, so that two well-supported spellings are not
       joined through a typo between them. Among spellings about as frequent (within a power of three) the one with the most neighbours
       at one edit leads, as the right spelling lies beside all its typos.
    """
    named = records.where("scope is not null and id is not null and name is not null")
    typed = named.select("scope", F.col("id").cast("bigint").alias("id"), "name").distinct()
    shape = "scope bigint, name string, n bigint, norm string, trade string, words array<string>"
    spelled = typed.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"))
    parsed = spelled.mapInPandas(_parse(key), shape).where("norm <> '' and size(words) > 0")
    spellings = cut(parsed.withColumn("node", F.xxhash64("scope", "trade", "words")))
    nodes = spellings.groupBy("node").agg(F.first("scope").alias("scope"), F.first("trade").alias("trade"), F.first("words").alias("words"), F.sum("n").alias("n"))
    nodes = cut(nodes.withColumn("short", F.exists("words", lambda w: w.endswith("."))))

    each = nodes.select("node", "scope", "trade", "n", "short", "words", F.posexplode("words").alias("i", "w"))
    others = F.filter("words", lambda w, j: j != F.col("i"))
    each = each.select("node", "scope", "trade", "n", "w", F.size("words").alias("size"), F.col("w").endswith(".").alias("dot"), F.exists(others, lambda w: w.endswith(".")).alias("rest_dot"), F.xxhash64("scope", "trade", others).alias("rest"))

    full = each.where("not dot and not rest_dot")
    left = full.where("size <> 2").select("scope", "node", "n", "w", "rest", F.explode(_ends(F.col("w"))).alias("end"))
    right = left.select(F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("w").alias("w2"), "rest", "end")
    near = left.join(right, ["rest", "end"]).where("node < node2 and w <> w2 and abs(length(w) - length(w2)) <= 2 and greatest(length(w), length(w2)) > 3")
    near = near.withColumn("d", F.levenshtein("w", "w2", 2).cast("int")).where("d > 0").withColumn("rare", ~((F.col("d") == 1) | _swapped(F.col("w"), F.col("w2"))))
    met = near.where("not rare or least(length(w), length(w2)) >= 6").select("node", "n", "node2", "n2", "d", "w", "w2", "rare").distinct().unionByName(_near_pairs(nodes))
    met = cut(met)
    # how many nodes of the scope have a word is only asked where it matters
    asked = met.where("rare").join(nodes.select("node", "scope"), "node")
    df = full.join(asked.select("scope", F.explode(F.array("w", "w2")).alias("w")).distinct(), ["scope", "w"], "left_semi").groupBy("scope", "w").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.join(df, ["scope", "w"]).join(df.select("scope", F.col("w").alias("w2"), F.col("df").alias("df2")), ["scope", "w2"]).where("least(df, df2) <= 1")
    keep = ["node", "n", "node2", "n2", "d"]
    links = cut(met.where("not rare").select(*keep).unionByName(rare.select(*keep)))

    short = each.where("dot").select("node", F.expr("substring(w, 1, length(w) - 1)").alias("begin"), "rest").withColumn("letter", F.substring("begin", 1, 1))
    whole = full.select(F.col("node").alias("node2"), F.col("n").alias("n2"), "w", "rest", F.substring("w", 1, 1).alias("letter"))
    begun = short.join(whole, ["rest", "letter"]).where(F.col("w").startswith(F.col("begin")))
    # words that are typos of each other are one beginning
    top = _leaders(links)
    lead = begun.join(top.select(F.col("node").alias("node2"), "up"), "node2", "left").select("node", F.coalesce("up", "node2").alias("up"))
    one = lambda x: x.groupBy("node").agg(F.min("up").alias("up"), F.max("up").alias("last"))
    exact = cut(one(lead))

    # a short form beside a word with a typo, where no exact word is beside it
    two = nodes.where("size(words) = 2").select("node", "scope", "trade", F.explode(F.array(*[F.struct(F.get("words", F.lit(i)).alias("w"), F.get("words", F.lit(1 - i)).alias("other")) for i in (0, 1)])).alias("x")).select("node", "scope", "trade", "x.*")
    far = two.where("w like '%.' and other not like '%.' and length(other) > 4").join(exact.select("node"), "node", "left_anti")
    at = lambda c: F.explode(F.array(F.concat(F.lit("^"), F.substring(c, 1, 2)), F.concat(F.substring(c, -2, 2), F.lit("$"))))
    far = far.select("node", "scope", "trade", F.expr("substring(w, 1, length(w) - 1)").alias("begin"), "other", at("other").alias("end")).withColumn("letter", F.substring("begin", 1, 1))
    beside = two.where("w not like '%.' and other not like '%.'").select(F.col("node").alias("node2"), "scope", "trade", F.col("w").alias("w2"), F.col("other").alias("other2"), at("other").alias("end"), F.substring("w", 1, 1).alias("letter"))
    near = far.join(beside, ["scope", "trade", "letter", "end"]).where(F.col("w2").startswith(F.col("begin")) & (F.abs(F.length("other") - F.length("other2")) <= 1)).withColumn("d", F.levenshtein("other", "other2", 2))
    near = near.where((F.col("d") == 1) | (F.col("d") == 2) & _swapped(F.col("other"), F.col("other2")))
    loose = one(near.join(top.select(F.col("node").alias("node2"), "up"), "node2", "left").select("node", F.coalesce("up", "node2").alias("up")))
    # a person's name of two words or more that lacks one of another's
    lacking = each.where("trade = '' and size >= 3 and not dot and not rest_dot").select(F.col("node").alias("node2"), F.col("rest").alias("node"))
    lacking = lacking.join(nodes.select("node"), "node").join(top.select("node"), "node", "left_anti").join(top.select(F.col("node").alias("node2"), "up"), "node2", "left").select("node", F.coalesce("up", "node2").alias("up"))
    lacking = one(lacking)
    up = cut(top.unionByName(exact.unionByName(loose).unionByName(lacking).where("up = last").select("node", "up")))
    # what a short form or a name that lacks a word follows may follow another in turn
    up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up", "left").groupBy("node").agg(F.min(F.coalesce("far", "up")).alias("up"))
    return (
        typed.join(spellings.select("scope", "name", "norm", "node"), ["scope", "name"])
        .join(up, "node", "left")
        .select("id", "norm", F.coalesce("up", "node").alias("entity"))
    )


def variant_pairs(linked: DataFrame, part: int = 1_000) -> DataFrame:
    """(a, b): ids of one entity, the smaller first, whose names still differ without letter case, white space and punctuation.

    Only entities of several such names are joined; one of more than `part` records is joined in as many tasks as it has parts.
    """
    several = linked.groupBy("entity").agg(F.min("norm").alias("x"), F.max("norm").alias("y"), F.ceil(F.count(F.lit(1)) / part).alias("parts")).where("x <> y").select("entity", "parts")
    rows = linked.join(several, "entity")
    a = rows.select("entity", F.col("id").alias("a"), F.col("norm").alias("norm_a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("slice"))
    b = rows.select("entity", F.col("id").alias("b"), F.col("norm").alias("norm_b"), F.pmod(F.xxhash64("id"), "parts").alias("slice"))
    return a.join(b, ["entity", "slice"]).where("a < b and norm_a <> norm_b").select("a", "b").distinct()


def classes(linked: DataFrame) -> DataFrame:
    """(id, entity, links): each id with the smallest id of its entity, and the number of names of the entity, without letter case, white space and punctuation, that differ from its own."""
    rows = linked.distinct()
    sizes = rows.groupBy("entity").agg(F.min("id").alias("first"), F.countDistinct("norm").alias("names"))
    return rows.join(sizes, "entity").groupBy("id").agg(F.min("first").alias("entity"), F.max(F.col("names") - 1).alias("links"))
