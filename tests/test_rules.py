"""Literal cases of functions, operators and the watchdog."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaylight.functions import contacts, urls
from quaylight.operators import choose, html, pipeline, store
from quaylight.sources import readers, writers
from quaylight.streaming import monitor


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()
    return row["v"]


@pytest.mark.parametrize(
    "raw, want",
    [("", ""), (None, ""), ("Site.Example", "https://site.example"), ("HTTP://a.example/", "https://http://a.example"), ("http://A.example:80/x/", "http://a.example/x"), ("https://a.example.:443/", "https://a.example/"), ("https://a.example/p?q=1#f", "https://a.example/p?q=1")],
)
def test_normalize(spark, raw, want):
    assert one(spark, urls.normalize(F.col("u")), u=raw) == want


@pytest.mark.parametrize("url, kind, points", [("https://a.example/", "homepage", 110), ("https://a.example/contact-us", "contact", 100), ("https://a.example/agent/ann", "agent_profile", 90), ("https://a.example/blog/x", "other", 5), ("https://a.example/zzz", "other", 10), ("https://a.example/agents/x", "team", 90)])
def test_page_type(spark, url, kind, points):
    assert one(spark, F.struct(urls.page_type(F.col("u")), urls.priority(F.col("u"))), u=url)[:] == (kind, points)


@pytest.mark.parametrize("url, want", [("https://www.b.co.uk/x", "b.co.uk"), ("mail.b.example:80", "b.example"), ("localhost", "localhost")])
def test_root(spark, url, want):
    assert one(spark, urls.root_domain(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, name", [("https://www.linkedin.com/in/john-o'neil", "John O'Neil"), ("https://facebook.com/blue-door", "Blue Door"), ("https://x.com/", "")])
def test_profile(spark, url, name):
    assert one(spark, contacts.profile_name(F.col("u")), u=url) == name


def test_parse_broken(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", None), (2, "https://a.example/", ""), (3, "https://a.example/", "<p>a<p>b <b>c</p><a href=mailto:x@y.example>z"), (4, "https://a.example/", "<script>'</p>'</script>" * 3)], "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in html.parse(pages).collect()}
    assert rows[1]["visible"] == rows[2]["visible"] == "" and rows[3]["links"][0]["href"] == "mailto:x@y.example" and rows[4]["visible"] == ""
    assert [r["value"] for r in html.mailto(html.parse(pages)).collect()] == ["x@y.example"]


def test_merge_prefers_score_then_mailto(spark):
    rows = spark.createDataFrame(
        [(1, "A@b.example", "u1", "regex", None, 1), (1, "a@b.example ", "u2", "mailto", None, 2), (1, "a@b.example", "u1", "json_ld", 5, 3)],
        "company_id int, email string, source_url string, extraction_method string, confidence_score int, ord int",
    )
    for c in ("source_page_type", "person_name", "job_title", "role"):
        rows = rows.withColumn(c, F.lit(""))
    low = choose.merge_mailboxes(rows.where("ord < 3")).first()
    high = choose.merge_mailboxes(rows).first()
    assert (low["extraction_method"], low["best_source_url"], low["all_source_urls"]) == ("mailto", "u1", ["u1", "u2"])
    assert high["extraction_method"] == "json_ld"


def test_upsert_of_empty(spark):
    old = spark.createDataFrame([], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert sorted(store.upsert(old, new, "k", [], ["v"]).collect()) == [("a", 2)]


START = (None, None, None, 0)


@pytest.mark.parametrize(
    "state, beat, action",
    [
        ((95.0, None, None, 0), dict(at=100, alive=False, progress=False), "confirming"),
        ((0.0, None, None, 0), dict(at=700, alive=False, progress=False), "restart"),
        ((0.0, None, None, 0), dict(at=700, alive=False, progress=False, queued=0), "idle"),
        ((None, 0.0, None, 0), dict(at=900, alive=True, progress=False), "restart"),
        ((None, 720.0, None, 0), dict(at=900, alive=True, progress=False), "armed"),
        ((None, 0.0, 840.0, 1), dict(at=900, alive=True, progress=False), "cooldown"),
        ((0.0, None, None, 0), dict(at=900, alive=False, progress=False, paused=True), "paused"),
        ((0.0, None, None, 0), dict(at=900, alive=False, progress=False, locked=True), "locked"),
        ((0.0, None, None, 0), dict(at=500, alive=True, progress=True), "armed"),
    ],
)
def test_watchdog(state, beat, action):
    after, said = monitor.decide(state, **({"paused": False, "locked": False, "queued": 1} | beat))
    assert said == action
    if action == "restart":
        assert after == (None, None, beat["at"], state[3] + 1)
    if action == "idle" or beat["alive"] and action == "armed":
        assert after[0] is None


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Company_Name,Website,City\nAnn & Co,a.example,"X, Y"\n,www.b.example,\n,,Z\n')
    got = {r["website"]: (r["company_name"], r["extra_columns"]) for r in readers.companies_from_csv(spark, str(tmp_path)).collect()}
    assert got == {"a.example": ("Ann & Co", {"city": "X, Y"}), "www.b.example": ("b.example", {})}
    (tmp_path / "p.txt").write_text("# no\n\n Town, State \n")
    assert readers.places(spark, str(tmp_path / "p.txt")).collect() == [("Town, State",)]
    assert readers.json_rows(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "t.yaml").write_text("queries:\n  - 'realtor in {city}'\n  - plain\n")
    assert [r["template"] for r in readers.templates(spark, str(tmp_path / "t.yaml")).collect()] == ["realtor in {city}", "plain"]
    rows = spark.createDataFrame([(1, 'a "b", c')], "n int, t string")
    paths = writers.write_all(rows, str(tmp_path / "out"), "1")
    assert spark.read.option("header", True).option("escape", '"').csv(paths["latest"]).first()["t"] == 'a "b", c'
    assert spark.read.json(paths["json"]).count() == 1
    assert [r[0] for r in writers.summary_lines(rows).collect()] == ["n: 1", 't: a "b", c']


def test_activity_ignores_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t), (1, t + dt.timedelta(minutes=5)), (1, t + dt.timedelta(hours=2))], "k int, ts timestamp_ntz")
    got = monitor.activity_windows(rows, "k", "ts", "15 minutes").orderBy("started").collect()
    assert [r["n"] for r in got] == [2, 1]


def test_second_pass_reaches_contacts(spark):
    late = '<noscript>Write to Only.Late@a.example or ring +1 555 010 7788</noscript><script type="application/json">{"m": "state@a.example"}</script>'
    pages = [
        (1, 7, 1, "https://a.example/", "<p>first@a.example</p>"),
        (2, 7, 2, "https://a.example/contact", f"<div>Ann Lee of the office <a href='mailto:first@a.example'>mail</a></div><noscript>first@a.example</noscript>{late}"),
        (3, 7, 3, "https://a.example/about", late),
        (4, 8, 1, "https://b.example/", "<p>none here</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, company_id bigint, page_ord int, url string, html string")
    mx = spark.createDataFrame([("a.example", True)], "domain string, has_mx boolean")
    got = {r["email_key"]: r for r in pipeline.contacts_of(df, mx).collect()}
    assert set(got) == {"first@a.example", "only.late@a.example", "state@a.example"}
    assert got["first@a.example"]["extraction_method"] == "mailto"
    late = got["only.late@a.example"]
    assert (late["extraction_method"], late["source_page_type"], late["all_source_urls"]) == ("regex", "other", ["https://a.example/contact"])
    phones = pipeline.company_phones(df).collect()
    assert {(r["company_id"], r["phone"][-10:], r["ord"]["page_ord"]) for r in phones} == {(7, "5550107788", 2)}
