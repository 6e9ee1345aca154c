"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quaylight.llm import abuse, canonical, leaks, names, residue, survivor, tokens, topn, truncation, urls


# ---- 2: top N
def test_topn_brute(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, 1, 5, 5, 9]), i, "x") for i in range(300)]
    rows += rows[:50]
    got = topn.top_n(spark.createDataFrame(rows, "g int, s int, i bigint, rank string"), "g", "s", "i", 4).collect()
    want = []
    for g in (1, 2, 3):
        best = sorted({(-s, i) for k, s, i, _ in rows if k == g and s is not None})[:4]
        want += [(g, i, n + 1) for n, (_, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_topn_empty_and_few(spark):
    schema = "g int, s int, i bigint"
    assert topn.top_n(spark.createDataFrame([], schema), "g", "s", "i").count() == 0
    got = topn.top_n(spark.createDataFrame([(1, 5, -(2**63)), (1, 5, 2**63 - 1), (2, None, 1)], schema), "g", "s", "i").collect()
    assert [r["i"] for r in got] == [-(2**63), 2**63 - 1]


def test_topn_heaps_are_merged(spark):
    """Repeated deliveries in several tasks, ties, one group of most rows, and heaps passed on early: the same as by sorting."""
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 6 + ["b", "c"]), rng.choice([1.0, 2.0, 2.0]), rng.randrange(40)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, s double, i bigint").repartition(6)
    best = {}
    for g, s, i in rows:
        best[g, i] = max(s, best.get((g, i), s))
    want = {(g, i) for k in "abc" for _, i, g in sorted((-s, i, g) for (g, i), s in best.items() if g == k)[:7]}
    assert {(r["g"], r["i"]) for r in topn.top_n(df, "g", "s", "i", 7).collect()} == want
    heaps = topn.bounded_heaps(df.select("g", "s", "i"), 7)
    assert heaps.count() <= 6 * 3 * 7
    early = topn.bounded_heaps(df.select("g", "s", "i"), 7, held=10).groupBy("g", "i").agg(F.max("s").alias("s")).toArrow().select(["g", "s", "i"])
    assert {(r["g"], r["i"]) for r in topn.keep_best(early, 7).to_pylist()} == want


# ---- 5: addresses
SAME = ["https://www.a-b.example/X?b=2&a=1", " HTTP://a-b.example:80//x/?a=1&b=2 ", "a-b.example/x?b=2&a=1.", "//www.A-B.example./x?a=1&b=2#", "https://www.a-b.example:443/x/?a=1&&b=2"]
OTHER = ["https://ab.example/x?a=1&b=2", "https://m.a-b.example/x?a=1&b=2", "https://a-b.example/y?a=1&b=2", "https://a-b.example/x?a=1&b=3", "https://a-b.example:8080/x?a=1&b=2", "https://a-b.example/x"]


def test_addresses(spark):
    rows = [(i, u, 0) for i, u in enumerate(SAME + OTHER + [None, "", "  ", "https://a-b.example/" + "z" * 100_000])]
    got = {r["id"]: (r["class_id"], r["copies"]) for r in urls.address_classes(spark.createDataFrame(rows, "id int, u string, copies int"), "id", "u").collect()}
    assert {i: got[i] for i in range(5)} == {i: (0, 5) for i in range(5)}
    assert {got[i] for i in range(5, 11)} == {(i, 1) for i in range(5, 11)}
    assert set(got) == {*range(11), 14}
    pairs = urls.class_pairs(urls.address_classes(spark.createDataFrame(rows, "id int, u string, copies int"), "id", "u"), "id").collect()
    assert sorted(map(tuple, pairs)) == list(itertools.combinations(range(5), 2))
    classes = spark.createDataFrame([(1, 1, 3), (2, 1, 3), (3, 1, 3)], "id int, class_id int, copies bigint")
    assert sorted(map(tuple, urls.class_pairs(classes, "id", part=2).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert urls.address_classes(spark.createDataFrame([], "id int, u string"), "id", "u").count() == 0


def test_records_of_several_addresses(spark):
    rows = [(1, "https://a.example/", "a.example", 0), (2, "A.example", "www.a.example", 0), (3, "a.example", None, 0), (4, "a.example", " ", 0), (5, None, None, 0), (6, "b.example", "a.example", 0)]
    got = {r["id"]: (r["class_id"], r["copies"]) for r in urls.record_classes(spark.createDataFrame(rows, "id int, u string, v string, copies int"), "id", ["u", "v"]).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 6: (6, 1)}


# ---- 6: survivors
@pytest.mark.parametrize("raw, want", [(" Ann@B.example\n", "ann@b.example"), ("mailto:a@b.example?subject=x", "a@b.example"), ('"A B" <a@b.example>', "a@b.example"), ("a (at) b [dot] example", "a@b.example"), ("a@b.example.,", "a@b.example"), ("none", None), ("", None), (None, None)])
def test_mailbox(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "e string").select(survivor.plain_mailbox(F.col("e"))).first()[0] == want


def test_survivors(spark):
    rows = [("a", 1, 5, 1, ""), ("a", 2, 5, 2, None), ("a", 3, None, 9, "u3"), ("a", 4, 5, 2, "u4"), ("a", 2, 5, 2, None), ("b", 7, 1, 1, "u"), ("b", 7, 1, 1, "u"), (None, 8, 1, 1, "u"), ("c", 9, None, None, None), ("c", 10, None, None, " ")]
    df = spark.createDataFrame(rows, "k string, i bigint, s int, w int, u string")
    got = {r["key"]: (r["best_id"], r["u"], r["u_id"]) for r in survivor.survivors(df, F.col("k"), "i", "s", "w", ["u"]).collect()}
    assert got == {"a": (2, "u4", 4), "c": (9, None, 0)}
    assert survivor.survivors(df.limit(0), F.col("k"), "i", "s", "w", ["u"]).count() == 0


def test_precedence_is_closed(spark):
    """c follows a by way of b, which the group doesn't have; x and y lead to each other over z, so neither is later."""
    steps = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")]
    rows = [(f"{p}{q}{i}", 3600 * 5 + k * (9000 if i else 1), v) for p, q in steps for i in range(4) for k, v in enumerate((p, q))] + [(None, 1, "a"), ("n", 1, None)]
    rows += [("g", None, v) for v in ("a", "a", "c")] + [("h", None, v) for v in ("x", "x", "y")] + [("j", None, v) for v in ("y", "b", "b")]
    df = spark.createDataFrame(rows, "k string, w bigint, v string")
    order = {tuple(r) for r in survivor.precedence(df, F.col("k"), "w", "v").collect()}
    assert order == {("a", "b"), ("b", "c"), ("a", "c")} | {(p, q) for p in "abc" for q in "xyz"}
    got = {r["key"]: (r["value"], r["dated"]) for r in survivor.current_values(df, F.col("k"), "w", "v").collect()}
    assert (got["g"], got["h"], got["j"]) == (("c", False), ("x", False), ("y", False))
    assert survivor.precedence(df.limit(0), F.col("k"), "w", "v").count() == 0


def test_currency(spark):
    rows = [(f"k{i}", 1, "new") for i in range(5)] + [(f"k{i}", 2, "mid") for i in range(5)] + [(f"k{i}", 3, "old") for i in range(5)]
    rows += [("t", 9, "new"), ("t", None, "old"), ("u", None, "new"), ("u", None, "mid"), ("u", None, "old"), ("v", None, "x"), ("v", None, "y"), ("v", None, "x"), ("w", None, ""), ("w", None, None)]
    got = {r["key"]: (r["value"], r["dated"]) for r in survivor.current_values(spark.createDataFrame(rows, "k string, w int, v string"), F.col("k"), "w", "v").collect()}
    assert got["t"] == ("new", True) and got["u"] == ("old", False) and got["v"] == ("x", False) and "w" not in got and got["k0"] == ("old", True)


# ---- 3: canonical values
REFS = [(1, "job_title", "Managing Broker", None), (2, "job_title", "Chief Executive Officer", None), (3, "job_title", "Sales Manager", None), (4, "role", "broker", None), (5, "location", "Dola Harbor, Lorrain Coast, USA", "LC"), (6, "location", "Dola Harbor, Norveland, USA", "NL"), (7, "location", "Pema, Norveland, USA", "NL")]


@pytest.mark.parametrize(
    "field, value, ref",
    [("job_title", "managing broker ", 1), ("job_title", "Broker, Managing", 1), ("job_title", "Mng Bkr", 1), ("job_title", "Managign Broker (part time)", 1), ("job_title", "C.E.O.", 2), ("job_title", "Sr. Sales Mgr", 3), ("job_title", "Gardener", 0), ("job_title", "???", 0), ("job_title", "Broker", 0),
     ("role", "BROKERS", 4), ("role", "lead brokre", 4), ("role", "pawn broker", 0), ("location", "dola harbor, nl", 6), ("location", "Dola Harbor", 0), ("location", "USA, Norveland, Pema", 7), ("location", "near Pema", 7), ("location", "Pema LC 12345", 0), ("location", "Pema Ridge, Doria, USA", 0), ("location", "x" * 20_000, 0)],
)
def test_canonical(field, value, ref):
    assert canonical.meant(field, canonical.References(field, [(r, e, s) for r, f, e, s in REFS if f == field]).best(value)) == ref


def test_prefix_filter_loses_nothing():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    refs = canonical.References("job_title", [(i, " ".join(rng.sample(words, 2)), None) for i in range(200)], 0.4)
    for _ in range(300):
        have = canonical.grams(v := rng.sample(words, rng.randint(1, 3)))
        want = {k for k, f in enumerate(refs.forms) if len(have & f[4]) / len(have | f[4]) >= 0.4}
        assert set(refs.candidates(v)) == want


def test_map_values(spark):
    rows = [("job_title", 1, "Managing Broker", 9), ("job_title", 2, "managing broker", 9), ("job_title", 2, "managing broker", 9), ("role", 3, None, 9), ("role", 4, " ", 9), ("location", 5, "Pema", 9)]
    values = spark.createDataFrame(rows, "field_name string, record_id bigint, value string, ref_id int")
    refs = spark.createDataFrame(REFS, "ref_id int, field_name string, entry string, short_form string")
    want = [("job_title", 2, 1), ("location", 5, 7)]
    assert sorted(map(tuple, canonical.map_values(values, refs).collect())) == want
    assert sorted(map(tuple, canonical.map_values(values, refs, block=2).collect())) == want
    assert sorted(map(tuple, canonical.map_values(values, refs.limit(0)).collect())) == [("job_title", 1, 0), ("job_title", 2, 0), ("location", 5, 0)]
    assert canonical.map_values(values.limit(0), refs).count() == 0


def test_blocks_of_references_change_nothing(spark):
    entries = ["Sales Manager", "Sale Manager", "Sales Managers", "Salee Manager", "Office Manager", "Manager", "Salee Manager"]
    refs = spark.createDataFrame([(i + 1, "job_title", e, None) for i, e in enumerate(entries)] + [(i, "location", f"Pema, {s}, USA", c) for i, (s, c) in enumerate((("Norveland", "NL"), ("Doria", "DR")), 20)], "ref_id int, field_name string, entry string, short_form string")
    typed = ["sales manager", "sale manager", "salee managr", "salee  manager", "manager", "Oficce Manager", "clerk", "Sales Manager"]
    values = spark.createDataFrame([("job_title", i, v) for i, v in enumerate(typed)] + [("location", 50, "pema"), ("location", 51, "pema dr")], "field_name string, record_id bigint, value string")
    want = {tuple(r) for r in canonical.map_values(values, refs).collect()}
    assert ("job_title", 0, 1) in want and ("job_title", 3, 0) in want and ("location", 50, 0) in want and ("location", 51, 21) in want and len(want) == 9
    for block in (1, 2, 20_000):
        assert {tuple(r) for r in canonical.map_values(values, refs, block=block).collect()} == want


# ---- 4: residue
RESIDUE = ["{{ company_name }} Homes", "Welcome to <%= city %>, your source.", "Contact [city] today.", "404 Not Found", "Please enable JavaScript to view this website.", "Lorem ipsum dolor sit", "undefined", "Your tagline goes here.", "Página no encontrada.", "Just a moment...", "%SITE_TITLE%", "The office of [object Object] sells."]
CONTENT = ["Suite 404 Realty of Ada Bo", "Error-Free Homes of Ada", "Cannot find the page in your contract that explains escrow? We can.", "Prices from $500K [sponsored listing] for lofts.", "0% commission plans (no hidden fees).", "Moment Homes of Ada", "We build websites and JavaScript widgets for tenants as well.", None, "", "  ", "word " * 30_000]


def test_residue(spark):
    rows = [(i, v, v) for i, v in enumerate(RESIDUE + CONTENT)] + [(0, RESIDUE[0], None)]
    got = residue.residue(spark.createDataFrame(rows, "id int, snippet string, kind string"), "id", ["snippet"]).collect()
    assert sorted(r["id"] for r in got) == list(range(len(RESIDUE)))
    assert residue.residue(spark.createDataFrame([], "id int, snippet string"), "id", ["snippet"]).count() == 0


def test_ordinary_wording_does_not_save_a_message(spark):
    rows = [(1, "Access is not denied to any buyer. Page not found."), (2, "Please enable JavaScript to continue. We also sell javascript widgets"), (3, "Access to the park is not denied to any resident of Ada Commons.")]
    assert sorted(r["id"] for r in residue.residue(spark.createDataFrame(rows, "id int, snippet string"), "id", ["snippet"]).collect()) == [1, 2]


def test_templates_are_mined_in_parts(spark):
    values = [f"Error in line {i} of the {x} page here" for i in range(3) for x in ("first", "last")] * 2 + ["one", "one two"]
    rows = [(i, v, f"https://www.h{i % 3}.example/a") for i, v in enumerate(values)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "id bigint, v string, u string").repartition(parts)
        mined = residue.mine(df.select("id", F.lit("f").alias("field_name"), "v", F.xxhash64("u").alias("host")))
        got = {r["template"]: (r["n"], r["spread"]) for r in residue.templates_of(mined).collect()}
        assert got == {"Error in line 0 of the <*> page here": (12, 3), "one": (1, 1), "one two": (1, 1)}
        assert mined.where("id is not null").count() == len(rows)


def test_messages_without_a_seed_are_found_by_their_template(spark):
    """Wordings that no pattern knows, near to those of known messages and spread over unlike hosts; content is as spread."""
    rng = random.Random(1)
    known = ["Page not found on this server, please try again", "This site requires scripts, please enable scripts and try again", "Internal server error on this server, please try again later"]
    fresh = "This server gave an error, please try again later"
    content = [f"Our {a} homes near the {b} sell in {c} weeks" for a in ("red", "old", "big", "new") for b in ("lake", "park", "mill", "hill") for c in ("two", "six", "ten")]
    assert not residue.is_seed(fresh)
    values = [(rng.choice(known) + f" {i}", f"h{i}.example") for i in range(60)] + [(fresh, f"g{i}.example") for i in range(12)] + [(c, f"k{i}{j}.example") for j in range(4) for i, c in enumerate(content)]
    df = spark.createDataFrame([(i, v, u) for i, (v, u) in enumerate(values)], "id int, snippet string, site string")
    assert {r["id"] for r in residue.residue(df, "id", ["snippet"], "site").collect()} == set(range(72))


# ---- 7: names
def test_names(spark):
    people = ["Gregory Hinasido", "Hinasido, Greg", "GREGORY HINASIDO", "Gregory F. Hinasido Jr.", "Gergory Hinasido", "Gregory Hinasdio", "G. Hinasido", "Margaret Hinasido", "Gregory Pavulo", None, "", "???"]
    rows = [(1, i, n) for i, n in enumerate(people)] + [(2, 20, "Gregory Hinasidu"), (None, 21, "Gregory Hinasido"), (1, 0, people[0]), (1, 30, "z" * 5000)]
    got = names.variant_pairs(names.linked_names(spark.createDataFrame(rows, "scope bigint, id bigint, name string"), names.person_key)).collect()
    want = {(a, b) for a, b in itertools.combinations([0, 1, 2, 3, 4, 5, 6], 2)} - {(0, 2)}
    assert set(map(tuple, got)) == want
    assert names.linked_names(spark.createDataFrame([], "scope bigint, id bigint, name string"), names.person_key).count() == 0


def test_ambiguous_initial_is_left(spark):
    rows = [(1, 1, "Gregory Hinasido"), (1, 2, "Guadalupe Hinasido"), (1, 3, "G. Hinasido")]
    assert names.variant_pairs(names.linked_names(spark.createDataFrame(rows, "scope bigint, id bigint, name string"), names.person_key)).count() == 0


def test_all_typos_of_a_name_are_one_entity(spark):
    """Whichever of the equally frequent spellings have the greater keys, and where the typos are repeated and the right one is not."""
    rows, want = [], set()
    for k, w in enumerate(["hinasidova", "pavulorike", "temozagupi", "wakelivuno", "zorubefima", "duchamoqel"]):
        forms = [w, *[w[:i] + "y" + w[i + 1 :] for i in (1, 3, 5, 7, 9)]]
        ids = [100 * k + 10 * i + j for i, f in enumerate(forms) for j in range(2 if k > 3 and i else 1)]
        rows += [(0, x, f"{forms[x % 100 // 10].title()} Kobu Realty") for x in ids]
        want |= {(a, b) for a, b in itertools.combinations(ids, 2) if a // 10 != b // 10}
    got = names.variant_pairs(names.linked_names(spark.createDataFrame(rows, "scope bigint, id bigint, name string"), names.firm_key)).collect()
    assert set(map(tuple, got)) == want


def test_well_supported_names_stay_apart(spark):
    rows = [(0, i, "Hinasido Kobu Realty") for i in range(4)] + [(0, 10 + i, "Hinabeso Kobu Realty") for i in range(4)] + [(0, 20, "Hinaseso Kobu Realty"), (0, 21, "Hinasiso Kobu Realty")]
    got = {tuple(r) for r in names.variant_pairs(names.linked_names(spark.createDataFrame(rows, "scope bigint, id bigint, name string"), names.firm_key)).collect()}
    assert (0, 10) not in got and (10, 20) in got and (0, 21) in got


def test_paths_are_followed_to_their_end(spark):
    links = spark.createDataFrame([(i, 3**i, i + 1, 3 ** (i + 1), 1) for i in range(12)], "node bigint, n bigint, node2 bigint, n2 bigint, d int")
    assert {r["node"]: r["up"] for r in names._leaders(links).collect()} == {i: 12 for i in range(12)}


def test_a_chain_of_spellings_is_one_entity(spark):
    """Seven spellings, each one edit from the next and each more frequent; and the same beside many other names."""
    chain = ["Hinasidova", "Hinasidove", "Hinasidole", "Hinasimole", "Hinakimole", "Himakimole", "Pimakimole"]
    rows = [(0, 100 * k + j, f"Gregory {w}") for k, w in enumerate(chain) for j in range(k + 1)]
    more = [(0, 10_000 + i, f"Walter {a}{b}{c}") for i, (a, b, c) in enumerate(itertools.product(("Bo", "Zu", "Ky"), ("ravip", "lemot", "tunag"), ("illo", "exena", "obuda"))) for _ in range(40)]
    for extra in ([], more):
        df = spark.createDataFrame(rows + extra, "scope bigint, id bigint, name string")
        linked = names.linked_names(df, names.person_key)
        assert linked.where("id < 10000").select("entity").distinct().count() == 1
    got = {r["id"]: (r["entity"], r["links"]) for r in names.classes(linked).collect()}
    assert {got[r[1]] for r in rows} == {(0, 6)} and got[10_000][0] == 10_000


def test_middle_names_tell_people_apart(spark):
    rows = [(1, 1, "Ana Maria Lopez"), (1, 2, "Ana Isabel Lopez"), (1, 3, "Ana Lopez"), (1, 4, "Lopez, Ana Mraia"), (2, 5, "Ana Maria Lopez"), (2, 6, "Ana Lopez"), (2, 7, "A. Lopez")]
    got = names.variant_pairs(names.linked_names(spark.createDataFrame(rows, "scope bigint, id bigint, name string"), names.person_key)).collect()
    assert set(map(tuple, got)) == {(1, 4), (5, 6), (5, 7), (6, 7)}


def test_a_typo_in_each_word(spark):
    """Whatever the number of names beside them: a rule that asks how common a word is would link them in one table and not in another."""
    two = [(1, 1, "Gregory Hinasido"), (1, 2, "Gergory Hinasdio"), (1, 3, "Hinasibo, Gregary")]
    many = [(1, 100 + i, f"{g} {s}") for i, (g, s) in enumerate(itertools.product(("Walter", "Gregory", "Ursula"), ("Pavulo", "Temoza", "Wakeli", "Zorube", "Ducham", "Lirofe", "Kobuna", "Setagu")))]
    for rows in (two, two + many):
        got = names.variant_pairs(names.linked_names(spark.createDataFrame(rows, "scope bigint, id bigint, name string"), names.person_key), part=2).collect()
        assert {tuple(r) for r in got if r["b"] < 100} == {(1, 2), (1, 3), (2, 3)}


def test_rare_is_told_within_the_scope(spark):
    rows = [(k, 10 * k + i, n) for k in range(3) for i, n in enumerate(["Wodu Hinasidova", "Wodu Hinysydova"])]
    got = names.variant_pairs(names.linked_names(spark.createDataFrame(rows, "scope bigint, id bigint, name string"), names.person_key)).collect()
    assert set(map(tuple, got)) == {(0, 1), (10, 11), (20, 21)}


@pytest.mark.parametrize("a, b, same", [("Rihu and Lose Realty LLC", "Realty, Rihu & Lose", True), ("Rihu Lose Rlty Grp", "Rihu-Lose Realty Group, Ltd.", True), ("The Rihu Lose R.E.", "Rihu and Lose Real Estate Inc.", True), ("Rihu Lose Homes", "Rihu Lose Realty", False)])
def test_firm_key(a, b, same):
    assert (names.firm_key(a) == names.firm_key(b)) == same


# ---- 1: truncation
SENTENCES = ["Our office has served {} County since {} and closes about {} sales.", "Ask about {} tours before you sell your next {} home.", "The seller replaced the roof in {} and added a {} porch.", "Taxes were last assessed in {}, so check the {} with the assessor.", "Many {} buyers ask us how to lease a {} house without a large deposit."]


def _text(rng):
    return " ".join(rng.choice(SENTENCES).format(rng.choice("red old new big".split()), rng.randint(1950, 2020), rng.randint(2, 60)) for _ in range(rng.randint(1, 4)))


def test_truncation_held_out(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(3000):
        t, cut = _text(rng), rng.random() < 0.3
        if cut:
            t = t[: rng.randint(20, len(t) - 3)]
            cut = not t.rstrip().endswith(".")
        elif rng.random() < 0.3:
            t = rng.choice(["Home > Listings > Ada", "Condos | Lofts | Vacant lots", "Suite 12, 400 Larch Street", "Open Mon-Fri 9:00-17:30"])
        rows.append(("nearby_text", i, "regex", t))
        truth[i] = cut
    rows += [("html_context", 9001, None, "<div><p>Hi.</p></div>"), ("html_context", 9002, None, "<div><p>Hi there and th"), ("html_context", 9003, None, '{"a":"b","c":"d'), ("nearby_text", 9004, None, "We sell homes in the…"), ("nearby_text", 9005, None, None), ("nearby_text", 9006, None, ""), ("nearby_text", 9007, None, "word " * 40_000 + "end.")]
    df = spark.createDataFrame(rows, "field_name string, record_id bigint, source string, value string")
    got = {r["record_id"]: r["cut"] for r in truncation.truncated(df).collect()}
    right = sum(got[i] == truth[i] for i in truth) / len(truth)
    assert right > 0.97
    assert (got[9001], got[9002], got[9003], got[9004], got[9007]) == (False, True, True, True, False) and 9005 not in got and 9006 not in got
    assert truncation.truncated(df.limit(0)).count() == 0
    assert truncation.rates(truncation.truncated(df)).count() == 3


def test_openers_are_those_of_all_values(spark, monkeypatch):
    texts = [f"We sell homes. {w} {x} porch has {i} steps and a rail. Ask us" for i, (w, x) in enumerate(itertools.product([f"W{a}ord{b}" for a in "abcdef" for b in "ghijkl"], ("red", "old")))]
    texts += ["<p>Hi there. Zulu homes are sold by us today. Ask.</p>", '{"a": "Hi there. Yoke homes are sold by us today. Ask", "b": 1}', "  <b> Hi there. Xray homes are sold by us. </b>", "One end only.", ""] * 2
    texts += ["Wa0b Wb1c sell."] * 3
    df = spark.createDataFrame([("nearby_text", i, None, t) for i, t in enumerate(texts)], "field_name string, record_id bigint, source string, value string")
    words = truncation.usual_words(df, len(texts))
    assert {"We", "sell", "homes", "Wa0b"} <= set(words) and "Waorda" not in words
    want = truncation.openers_of(texts, truncation.Words(words))
    assert len(want) >= 6 and ("Zz", "red", "porch") in want
    held = truncation.Openers(truncation.opener_hashes(df, words))
    assert len(held.hashes) == len(want) and all(x in held for x in want) and ("Zulu",) not in held and ("~", "Q") not in held
    # the draw for the fit has no say in them
    used = []
    monkeypatch.setattr(truncation, "train", lambda rows, limits, openers, usual, seed: used.append((len(rows), openers)) or (truncation.np.zeros(1 << truncation.BITS), -1.0))
    truncation.truncated(df, sample=20).count()
    assert used[0][0] < 60 and all(x in used[0][1] for x in want)
    assert len(truncation.opener_hashes(df.limit(0), [])) == 0


def test_the_draw_is_bounded(spark):
    """A value of most rows is drawn once, long ones are left to be scored only, and no more than the sample are taken."""
    rows = [("f", i, None, "The same sentence again.") for i in range(500)] + [("f", 1000 + i, None, f"Sentence number {i} is here.") for i in range(300)] + [("f", 5000, None, "long " * 400)]
    df = spark.createDataFrame(rows, "field_name string, record_id bigint, source string, value string").withColumn("at", F.lit("f/-"))
    got = truncation.drawn(df, {"f": 302}, 100, 1000)
    assert 60 < len(got) <= 100 and len({v for _, v in got}) == len(got) and all(len(v) < 1000 for _, v in got)


def test_limits_are_piles_at_any_size(spark):
    lengths = [("a", n, 30 + n % 3) for n in range(20, 400)] + [("a", 200, 900), ("a", 30, 700)] + [("b", n, 1) for n in range(20, 60)] + [("b", 100, 2)] + [("c", 40, 6), ("c", 77, 1)]
    got = truncation.limits_of(spark.createDataFrame(lengths, "source string, len int, n bigint").groupBy("source", "len").agg(F.sum("n").alias("n")))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [30, 200], "c": [40]}


def test_the_last_sentence_is_found_however_long():
    t = "One ends here. " + "word " * 2000
    assert truncation._last(t) == (t[15:], True) and truncation._last("word " * 500) == ("word " * 500, False)


# ---- 8: tokens
def test_tokens_against_library(spark):
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [None, "", " ", "a", "Hello  world\r\n\t x", "it's WE'LL don't", "日本語 🏡✨ é́ ​﻿", "<|endoftext|> x", "x" * 3000, "ab" * 5000, "\x00\x01", "مرحبا بالعالم", "1234567 €5", " \u0085 q", "word " * 20_000]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id int, text string, ids int")
    for frequent in (0, 3, 50_000):
        got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "doc_id", "text", frequent=frequent).collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate("tap taps top tops stop stops a ab abc".split())}
    lex = tokens.Lexicon.compile(words)
    lex.save(str(tmp_path / "lexicon"))
    mapped = tokens.Lexicon.mapped(str(tmp_path / "lexicon"))
    assert all(mapped.find(w) == ids for w, ids in words.items())
    assert all(mapped.find(w) is None for w in (b"", b"t", b"tapss", b"stopsx", b"zz"))
    assert len(lex.first) - 1 < sum(map(len, words))


# ---- 9: leaks
def test_leaks(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, "Read the passage and answer below. " + " ".join(rng.choice(vocab) for _ in range(60))) for i in range(30)]
    body = lambda i: items[i][1].split(". ")[1].split()
    noise = lambda n: [rng.choice(vocab) for _ in range(n)]
    changed = body(3)
    changed[5], changed[25] = "other", "thing"
    docs = [(1, " ".join(noise(50) + body(0) + noise(50))), (2, ",\n".join(noise(30) + body(1)[10:40]).upper()), (3, " ".join(noise(30) + changed)), (4, "Read the passage and answer below."), (5, " ".join(noise(30) + body(4)[:8] + noise(30))), (6, None), (7, ""), (8, " "), (9, " ".join(noise(20_000) + body(5))), (1, " ".join(noise(10)))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    t = spark.createDataFrame(items + [(99, ""), (98, None)], "item_id bigint, text string")
    want = {(1, 0), (2, 1), (3, 3), (9, 5)}
    assert {(r[0], r[1]) for r in leaks.leaked(d, t).collect()} == want
    assert {(r[0], r[1]) for r in leaks.leaked(d, t, block=7).collect()} == want
    assert leaks.leaked(d.limit(0), t).count() == leaks.leaked(d, t.limit(0)).count() == 0


def test_leaks_do_not_depend_on_length_or_blocks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    sizes = [3, 20, 100, 640, 800, 1000, 2000, 5000]
    line = "Answer the question with one of the options. "
    items = [(i, line + " ".join(word() for _ in range(n))) for i, n in enumerate(sizes)]
    own = [t[len(line) :].split() for _, t in items]
    noise = lambda n: [word() for _ in range(n)]
    docs = [(i, " ".join(noise(40) + ws + noise(40))) for i, ws in enumerate(own)]
    # a third of an item, in parts that stand far apart
    docs += [(20, " ".join(w for k in range(0, 1000, 100) for w in own[5][k : k + 36] + noise(400))), (21, line), (22, " ".join(noise(50) + own[6][:300] + noise(50)))]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(i, i) for i in range(len(sizes))} | {(20, 5)}
    for block in (1, 3, 5_000):
        assert {(r[0], r[1]) for r in leaks.leaked(d, t, block=block).collect()} == want


def test_wand_retrieves_all_above_and_all_that_is_held():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, rng.choices(vocab, weights=range(1, 13), k=rng.randint(5, 60))) for i in range(150)]
    df = leaks.Counter(w for _, ws in items for w in set(leaks.terms_of(ws)))
    index = leaks.Index(items, df, len(items), 30.0, block=8)
    for _ in range(150):
        text = rng.choices(vocab, weights=range(1, 13), k=30) + rng.choice(items)[1][: rng.randint(0, 30)]
        q = set(leaks.terms_of(text))
        scores = {}
        for w in q & index.docs.keys():
            for i, x in zip(index.docs[w], index.weights[w]):
                scores[i] = scores.get(i, 0) + x
        got = index.above(q)
        assert got.keys() == {i for i, s in scores.items() if s >= 1 + 1e-9} | {i for i in got if abs(scores[i] - 1) < 1e-9}
        held = lambda places: {i for i, s in index.held(text, places).items() if s >= 1 / 3}
        assert held(set(range(len(items)))) <= got.keys() and held(set(got)) == held(set(range(len(items))))


# ---- 10: abuse
BAD = ["you worthless {} get out of {} now", "every one of those {} is a disease on {}", "i will strangle you near {} you {}"]
GOOD = ["this {} home sits on a lot beside {}", "we help {} buyers find a house near {}", "the killer views and {} porch face {}", "ask about {} tours before you visit {}"]


def _review(rng, bad):
    some = ["park", "lake", "mill", "school"]
    lines = [rng.choice(GOOD).format(rng.choice("sunny quiet modern".split()), rng.choice(some)) for _ in range(6)]
    if bad:
        word = rng.choice("idiot moron scumbag vermin".split())
        word = rng.choice([word, ".".join(word), word.upper(), word.replace("i", "1").replace("o", "0"), word[0] + word[1] * 4 + word[2:]])
        lines[rng.randrange(6)] = rng.choice(BAD).format(word, rng.choice(some))
    return ".\n".join(lines) + "."


@pytest.mark.parametrize("text", ["Whore, get out of here", "Salope", "Pendejo", "Cabrones", "Miserable"])
def test_capitals_hide_nothing(text):
    assert abuse.reveal(text) == abuse.reveal(text.lower()) == [w.strip(",").lower() for w in text.split()]


def test_abuse_held_out(spark):
    rng = random.Random(6)
    docs = [(i, _review(rng, i % 4 == 0), f"s{i % 3}") for i in range(900)]
    docs += [(2000, None, "s0"), (2001, "", None), (2002, " \n", None), (2003, ("this sunny home sits on a lot beside lake. " * 5000), None)]
    labels = [(i, (i % 4 == 0) ^ (rng.random() < 0.05)) for i in range(500)] + [(1, None), (5, 0), (5, 0), (9999, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    judged = abuse.scored(d, spark.createDataFrame([(i, None if y is None else int(y)) for i, y in labels], "doc_id bigint, abusive int"))
    got = {r["doc_id"]: r for r in judged.collect()}
    right = sum(got[i]["abusive"] == (i % 4 == 0) for i in range(500, 900)) / 400
    assert right > 0.97
    assert [got[i]["score"] for i in (2000, 2001, 2002)] == [0.0, 0.0, 0.0] and not got[2003]["abusive"]
    assert abuse.rates(judged).where("source is null").first()["n"] == 3
    none = spark.createDataFrame([], "doc_id bigint, abusive int")
    assert abuse.scored(d, none).where("abusive").count() == 0 and abuse.scored(d.limit(0), none).count() == 0
