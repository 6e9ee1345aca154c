"""Pages parsed once, and the rows that rules draw from the parsed form."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, rules, urls

PARSED = (
    "title string, headings array<string>, metas array<struct<name:string,content:string>>, links array<struct<pos:int,href:string,text:string,class:string,within:string,near:string>>, "
    "attributes array<struct<pos:int,name:string,value:string>>, scripts array<struct<pos:int,kind:string,body:string>>, classed array<struct<pos:int,class:string,id:string,prop:string,text:string>>, contexts array<struct<mail:string,name:string,title:string>>, ld_mails array<string>, ld_profiles array<string>, visible string, everything string"
)
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_SILENT = {"script", "style", "noscript"}
_BLOCK = set("address article aside blockquote dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_DATA = set("data-email data-contact data-contactemail data-contact-email onclick data-cfemail".split())


_CONTAINERS = set("div section article li tr td".split())
_MAIL = re.compile(rules.EMAIL_LOOSE)
_TITLES = [w.lower() for w in rules.TIER_1 + rules.TIER_2 + rules.TIER_3]


def clean_name(text: str) -> str:
    """A text without mailboxes and numbers, if what is left may be a name: 2 to 80 characters, no long number, no article or pronoun."""
    t = re.sub(r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "", _MAIL.sub("", text).strip()).strip()
    return "" if not 2 <= len(t) <= 80 or re.search(r"\d{3}", t) or t.lower() in rules.NO_NAMES else t


def looks_like_name(text: str) -> bool:
    """Two to five words, each with a capital (or no letter) in front, or a particle."""
    words = text.split()
    return 2 <= len(words) <= 5 and all(not w[0].islower() or w in rules.PARTICLES for w in words)


class _Part:
    """What lies between the start and the end of an element: places in the lists of the page's texts, headings, bold and slanted texts."""

    def __init__(self, reader: _Reader, start: tuple[int, ...]):
        self.reader, self.start, self.end = reader, start, reader.places()

    def lists(self) -> list[list]:
        return [x[a:b] for x, a, b in zip(self.reader.noted, self.start, self.end)]

    def size(self) -> int:
        return sum(map(len, self.reader.noted[0][self.start[0] : self.end[0]]))

    def person(self) -> tuple[str, str]:
        """The name and the title that it gives: the first heading, else the first bold text, else the first line that looks like a name; the first line with a role in it."""
        texts, heads, bold, slanted = self.lists()
        lines = [x for t in texts for x in (y.strip() for y in t.split("\n")) if x]
        marked = (clean_name(t) for part in (heads, bold) for _, t in sorted(part))
        plain = (n for n in map(clean_name, lines) if looks_like_name(n))
        titled = (x for x in [*lines, *(t for _, t in sorted(slanted))] if any(w in x.lower() for w in _TITLES))
        return next((n for n in marked if n), None) or next(plain, ""), next(titled, "")


class _Reader(HTMLParser):
    """Collects what the rules need in one pass. Tags that were never closed end with their parent, and a block ends an open paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.title, self.headings, self.metas, self.links, self.attributes, self.scripts, self.classed = "", [], [], [], [], [], []
        self.visible: list[str] = []
        self.everything: list[str] = []
        self.noted: list[list] = [[], [], [], []]  # texts; headings, bold and slanted texts with their places
        self.people: dict[str, tuple] = {}  # mailbox -> (how it was seen, place, name, title)
        self.pos = 0

    def places(self) -> tuple[int, ...]:
        return tuple(map(len, self.noted))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.pos += 1
        if tag == "meta":
            self.metas.append({"name": a.get("name") or a.get("property") or "", "content": a.get("content", "")})
        seen = []
        for k, v in a.items():
            if k in _DATA:
                self.attributes.append({"pos": self.pos, "name": k, "value": v})
            if "@" in v or "%40" in v:
                seen += [(1 if k == "href" else 2, self.pos, m.lower()) for m in _MAIL.findall(v)]
        if tag in _VOID:
            if self.stack and seen:
                # it stands in its parent, which is the first of those around it
                self.stack[-1].setdefault("mails", []).extend((x, 0, None) for x in seen)
            return
        if tag in _BLOCK and self.stack and self.stack[-1]["tag"] == "p":
            self._close(len(self.stack) - 1)
        within = f"{self.stack[-1]['within']} {self.stack[-1]['attrs'].get('class', '').lower()}" if self.stack else ""
        self.stack.append({"tag": tag, "attrs": a, "pos": self.pos, "text": [], "start": self.places(), "within": within[-500:], "own": seen})

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tag"] == tag:
                self._close(k)
                return

    def _close(self, to: int):
        while len(self.stack) > to:
            e = self.stack.pop()
            text = " ".join("".join(e["text"]).split())
            tag, a = e["tag"], e["attrs"]
            if tag == "title" and not self.title:
                self.title = text
            elif tag in ("h1", "h2"):
                self.headings.append(text)
            elif tag == "script":
                self.scripts.append({"pos": e["pos"], "kind": a.get("type", "").lower(), "body": "".join(e["text"])})
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.noted[1].append((e["pos"], text))
            elif tag in ("strong", "b"):
                self.noted[2].append((e["pos"], text))
            elif tag in ("em", "i", "span", "p"):
                self.noted[3].append((e["pos"], text))
            if tag == "a" and "href" in a:
                link = {"pos": e["pos"], "href": a["href"].strip(), "text": text, "class": a.get("class", ""), "within": e["within"].strip(), "near": None}
                self.links.append(link)
                if self.stack:
                    self.stack[-1].setdefault("wait", []).append((link, 1))
            if a.get("class") or a.get("id") or a.get("itemprop"):
                self.classed.append({"pos": e["pos"], "class": a.get("class", "").lower(), "id": a.get("id", "").lower(), "prop": a.get("itemprop", "").lower(), "text": text})
            for link, up in e.get("wait", []):
                # what surrounds a link: the nearest of five ancestors that says more than the link
                if len(text) > 20 or up == 5 or not self.stack:
                    link["near"] = text[:500]
                else:
                    self.stack[-1].setdefault("wait", []).append((link, up + 1))
            self._place(e)
            if self.stack and tag not in _SILENT:
                self.stack[-1]["text"].append((" " if tag in _BLOCK else "") + "".join(e["text"]) + (" " if tag in _BLOCK else ""))

    def _place(self, e: dict):
        """The mailboxes of an element that closes go to its parent, five up at most, until one of them holds enough to tell whose they are."""
        part = _Part(self, e["start"])
        going = [(x, 1, None) for x in e["own"]]
        for x, up, first in e.get("mails", []):
            up, first = up + 1 if up == 0 else up, first or part
            if up == 5 or (e["tag"] in _CONTAINERS and 20 < part.size() < 2000):
                self._told(x, part)
            else:
                going.append((x, up + 1, first))
        if self.stack:
            self.stack[-1].setdefault("mails", []).extend(going)
        else:
            # the page itself counts as one around; beyond it there is nothing, and what is next to the mailbox must do
            for x, up, first in going:
                self._told(x, first if first and up < 5 else _Part(self, (0, 0, 0, 0)) if up == 5 else part)

    def _told(self, seen: tuple, part: _Part):
        how, pos, mail = seen
        if mail not in self.people or (how, pos) < self.people[mail][:2]:
            self.people[mail] = (how, pos, *part.person())

    def handle_data(self, data):
        silent = any(e["tag"] in _SILENT for e in self.stack)
        if self.stack:
            self.stack[-1]["text"].append(data)
            if "@" in data:
                self.stack[-1]["own"] += [(0, self.pos, m) for m in _MAIL.findall(data) if m == m.lower()]
        self.everything.append(data)
        if not silent:
            self.visible.append(data)
            if data.strip():
                self.noted[0].append(data.strip())

    def row(self) -> dict:
        self._close(0)
        text = lambda parts: " ".join(" ".join(parts).split())
        data = [x["body"] for x in sorted(self.scripts, key=lambda x: x["pos"]) if "ld+json" in x["kind"]]
        return {
            "title": self.title, "headings": self.headings, "metas": self.metas, "links": sorted(self.links, key=lambda x: x["pos"]), "attributes": self.attributes, "scripts": self.scripts,
            "classed": sorted(self.classed, key=lambda x: x["pos"]), "contexts": [{"mail": m, "name": x[2], "title": x[3]} for m, x in self.people.items()],
            "ld_mails": [m for b in data for m in json_mails(b)], "ld_profiles": [m for b in data for m in json_profiles(b)], "visible": text(self.visible), "everything": text(self.everything),
        }


def read_page(html: str | None) -> dict:
    r = _Reader()
    try:
        r.feed(html or "")
        r.close()
    except (AssertionError, ValueError):
        pass
    return r.row()


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, raw, and the fields of PARSED): every page parsed once.

    A null or empty page gives a row of empty fields; broken markup gives what could be read. An operator, not a column
    expression, so that no rewrite of the plan evaluates the parser twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [read_page(h if isinstance(h, str) else None) for h in b["html"]]
            out = pd.DataFrame(rows, columns=["title", "headings", "metas", "links", "attributes", "scripts", "classed", "contexts", "ld_mails", "ld_profiles", "visible", "everything"])
            out.insert(0, "page_id", b["page_id"].to_numpy())
            out.insert(1, "url", b["url"].to_numpy())
            out.insert(2, "raw", b["html"].to_numpy())
            yield out

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInPandas(run, f"page_id bigint, url string, raw string, {PARSED}")


FOUND = "array<struct<method:string,method_ord:int,pos:int,value:string,near:string>>"


def _found(items: Column, method: str, order: int, value, near=None, pos=None) -> Column:
    """Items of a parsed page as rows to be: method, its order, position, value and what is near."""
    made = lambda x, i: F.struct(F.lit(method).alias("method"), F.lit(order).alias("method_ord"), (pos(x) if pos else i).cast("int").alias("pos"), value(x).alias("value"), (near(x) if near else F.lit("")).alias("near"))
    return F.transform(items, made).cast(FOUND)


def _rows(parsed: DataFrame, *found: Column) -> DataFrame:
    """One pass over the parsed pages, however many methods there are."""
    return parsed.select("page_id", "url", F.inline(F.concat(*found)))


def _mails(found: Column) -> Column:
    return F.filter(found, lambda r: r["value"].contains("@"))


def json_mails(body: str | None) -> list[str]:
    """Mailboxes of JSON-LD: of an item, of its contact point, and of its members, employees, authors and founders."""
    try:
        data = json.loads(body or "")
    except ValueError:
        return []
    out = []
    for item in data if isinstance(data, list) else [data]:
        if not isinstance(item, dict):
            continue
        near = [item]
        for k in ("contactPoint", "member", "employee", "author", "founder"):
            v = item.get(k)
            near += [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
        out += [re.sub(r"^mailto:", "", str(x["email"]), flags=re.I).strip().lower() for x in near if x.get("email") and "@" in str(x["email"])]
    return out


def json_profiles(body: str | None) -> list[str]:
    """The sameAs addresses of JSON-LD, within @graph too."""
    try:
        data = json.loads(body or "")
    except ValueError:
        return []
    items = data if isinstance(data, list) else [data]
    items = [y for x in items if isinstance(x, dict) for y in ([x, *x["@graph"]] if isinstance(x.get("@graph"), list) else [x])]
    out = []
    for x in items:
        same = x.get("sameAs") if isinstance(x, dict) else None
        out += [s for s in (same if isinstance(same, list) else [same]) if isinstance(s, str)]
    return out


def _mailto() -> Column:
    links = F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:"))
    plain = lambda x: F.replace(F.substring_index(F.regexp_replace(x["href"], "^(?i)mailto:", ""), "?", 1), F.lit("+"), F.lit("%2B"))
    return _mails(_found(links, "mailto", 1, lambda x: F.lower(F.trim(F.coalesce(F.try_url_decode(plain(x)), F.lit("")))), lambda x: x["near"], lambda x: x["pos"]))


def _visible_mails() -> Column:
    return _found(contacts.emails_in(F.col("visible")), "regex", 2, lambda v: v)


def _hidden_mails() -> Column:
    return _found(contacts.hidden_emails_in(F.coalesce("raw", F.lit(""))), "obfuscated", 3, lambda v: v)


def _masked_mails() -> Column:
    masked = F.filter("attributes", lambda x: x["name"] == "data-cfemail")
    return _mails(_found(masked, "cloudflare", 3, lambda x: contacts.unmask_cfemail(x["value"]), pos=lambda x: x["pos"]))


def _attribute_mails() -> Column:
    attrs = F.filter("attributes", lambda x: x["name"].startswith("data-") & (x["name"] != "data-cfemail") | (x["name"] == "onclick"))
    value = lambda x: F.lower(F.trim(F.when(x["name"] == "onclick", F.regexp_extract(x["value"], rules.EMAIL_LOOSE, 0)).otherwise(x["value"])))
    return _mails(_found(attrs, "html_attribute", 4, value, pos=lambda x: x["pos"]))


def _jsonld_mails() -> Column:
    return _found(F.col("ld_mails"), "json_ld", 5, lambda v: v)


def _meta_mails() -> Column:
    metas = F.filter("metas", lambda x: F.lower(x["name"]).rlike("email|contact"))
    return _found(F.flatten(F.transform(metas, lambda x: F.regexp_extract_all(x["content"], F.lit(rules.EMAIL_LOOSE), F.lit(0)))), "structured_data", 6, lambda v: F.lower(v))


def _script_mails() -> Column:
    scripts = F.filter("scripts", lambda x: ~x["kind"].contains("json"))
    return _found(F.flatten(F.transform(scripts, lambda x: F.regexp_extract_all(x["body"], F.lit(rules.EMAIL_LOOSE), F.lit(0)))), "javascript", 7, lambda v: F.lower(v))


def mailto(parsed: DataFrame) -> DataFrame:
    """Mailboxes of mailto: links, before the query, decoded."""
    return _rows(parsed, _mailto())


def visible_mails(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _visible_mails())


def hidden_mails(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _hidden_mails())


def masked_mails(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _masked_mails())


def attribute_mails(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _attribute_mails())


def jsonld_mails(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _jsonld_mails())


def meta_mails(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _meta_mails())


def script_mails(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _script_mails())


def all_mails(parsed: DataFrame) -> DataFrame:
    """The mailboxes of a page by all methods."""
    return _rows(parsed, _mailto(), _visible_mails(), _hidden_mails(), _masked_mails(), _attribute_mails(), _jsonld_mails(), _meta_mails(), _script_mails())


def _tel() -> Column:
    links = F.filter("links", lambda x: x["href"].startswith("tel:"))
    rows = _found(links, "tel", 1, lambda x: F.trim(F.regexp_replace(x["href"], "^tel:", "")), lambda x: x["near"], lambda x: x["pos"])
    return F.filter(rows, lambda r: contacts.phone_valid(r["value"]))


def _class_phones() -> Column:
    marked = F.filter("classed", lambda x: urls.has_any(x["class"], rules.PHONE_CLASSES) | urls.has_any(x["id"], rules.PHONE_IDS) | x["prop"].isin(rules.PHONE_PROPERTIES))
    pairs = F.flatten(F.transform(marked, lambda x: F.transform(contacts.phones_in(x["text"]), lambda v: F.struct(x["pos"].alias("pos"), v.alias("v"), x["text"].alias("t")))))
    return _found(pairs, "css", 2, lambda x: x["v"], lambda x: x["t"], lambda x: x["pos"])


def _text_phones() -> Column:
    return _found(contacts.phones_in(F.col("visible")), "regex", 3, lambda v: v)


def tel(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _tel())


def class_phones(parsed: DataFrame) -> DataFrame:
    """Numbers of elements whose class, id or property names a phone."""
    return _rows(parsed, _class_phones())


def text_phones(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _text_phones())


def all_phones(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, _tel(), _class_phones(), _text_phones())


def _loose_mails() -> Column:
    loose = F.array_distinct(F.transform(F.regexp_extract_all("everything", F.lit(rules.EMAIL), F.lit(0)), lambda x: F.lower(x)))
    return F.filter(_found(loose, "webextractor", 8, lambda v: v), lambda r: ~contacts.false_mail(r["value"]))


def _loose_phones() -> Column:
    return _found(F.array_distinct(contacts.phones_in(F.col("everything"))), "webextractor", 8, lambda v: v)


def _second_mails() -> Column:
    had = F.transform(F.concat(_mailto(), _visible_mails(), _hidden_mails(), _masked_mails(), _attribute_mails(), _jsonld_mails(), _meta_mails(), _script_mails()), lambda r: r["value"])
    return F.filter(_loose_mails(), lambda r: ~F.array_contains(had, r["value"]))


def _second_phones() -> Column:
    called = F.transform(F.concat(_tel(), _class_phones(), _text_phones()), lambda r: contacts.phone_key(r["value"]))
    return F.filter(_loose_phones(), lambda r: ~F.array_contains(called, contacts.phone_key(r["value"])))


def second_pass(parsed: DataFrame) -> DataFrame:
    """What a looser second pass adds: mailboxes and numbers of all text, scripts included, each value that the first pass has not found on the page."""
    return _rows(parsed, _second_mails(), _second_phones())


def mails_of_both(parsed: DataFrame) -> DataFrame:
    """The mailboxes of a page by all methods, then those that only the second pass finds; with the class of the page, and the name and title beside each."""
    # the first of a page is chosen later, so what the first pass has need not be looked up here
    found = F.concat(_mailto(), _visible_mails(), _hidden_mails(), _masked_mails(), _attribute_mails(), _jsonld_mails(), _meta_mails(), _script_mails(), _loose_mails())
    beside = lambda v: F.get(F.filter("contexts", lambda c: c["mail"] == F.lower(v)), F.lit(0))
    told = F.transform(found, lambda r: F.struct(r["method"].alias("method"), r["method_ord"].alias("method_ord"), r["pos"].alias("pos"), r["value"].alias("value"), r["near"].alias("near"), beside(r["value"]).alias("context")))
    rows = parsed.select("page_id", "url", _page_class().alias("page_class"), F.inline(told))
    return rows.select("page_id", "url", "page_class", "method", "method_ord", "pos", "value", "near", F.coalesce("context.name", F.lit("")).alias("person_name"), F.coalesce("context.title", F.lit("")).alias("job_title"))


def phones_of_both(parsed: DataFrame) -> DataFrame:
    """The numbers of a page by all methods, then those of the second pass; the first of each is chosen later."""
    return _rows(parsed, _tel(), _class_phones(), _text_phones(), _loose_phones())


def socials_of_both(parsed: DataFrame) -> DataFrame:
    """Profile links by all methods, then those of the second pass: every link to a platform, whatever its path."""
    again = _rows(parsed, _found(F.col("links"), "webextractor", 8, lambda x: x["href"], pos=lambda x: x["pos"])).withColumn("platform", contacts.platform(F.col("value"))).where("platform <> ''")
    return socials(parsed).unionByName(again)


def socials(parsed: DataFrame) -> DataFrame:
    """Profile links: of JSON-LD, of meta tags, of links that are marked as such or lie in a part that is, and of other links whose path names a profile."""
    metas = F.filter("metas", lambda x: F.lower(x["name"]).isin("og:url", "twitter:url", "article:author", "article:publisher"))
    in_social = lambda x: x["within"].contains("social-links") | F.array_contains(F.split(x["within"], r"\s+"), "social")
    marked = F.filter("links", lambda x: urls.has_any(F.lower(x["class"]), rules.SOCIAL_CLASSES) | urls.has_any(F.lower(x["href"]), rules.SOCIAL_HOSTS) | in_social(x))
    at = lambda x: x["pos"]
    page = F.struct("page_id", "url")
    found = F.concat(_found(F.col("ld_profiles"), "json_ld", 1, lambda v: v), _found(metas, "meta", 2, lambda x: x["content"]), _found(marked, "css", 3, lambda x: x["href"], pos=at), _found(F.col("links"), "anchor", 4, lambda x: x["href"], pos=at))
    rows = parsed.select(page.alias("page"), F.inline(found)).select("page.*", "method", "method_ord", "pos", "value", "near")
    first = F.lower(F.regexp_extract(urls.path(F.col("value")), "^/*([^/]*)", 1))
    return rows.withColumn("platform", contacts.platform(F.col("value"))).where((F.col("platform") != "") & ((F.col("method") != "anchor") | ~first.isin("", "feed", "search", "help", "about")))


def internal_links(parsed: DataFrame) -> DataFrame:
    """(page_id, url, link): links that stay on the site, absolute and normalised, each once."""
    links = parsed.select("page_id", "url", F.explode(F.array_distinct(F.transform("links", lambda x: x["href"]))).alias("href")).where("href <> '' and not href rlike '^(?i)(#|javascript:|mailto:|tel:)'")
    return links.mapInPandas(_resolved, "page_id bigint, url string, link string").distinct()


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links resolved, normalised and kept if they stay on the site, in one pass over the batch; addresses that come again are looked up."""
    known: dict[str, tuple[str, str]] = {}
    for b in batches:
        links = []
        for base, href in zip(b["url"], b["href"]):
            try:
                full = urljoin(base or "", href)
            except ValueError:
                full = ""
            links.append(urls.normal_link(full, known) if full and urls.normal_link(full, known)[1] == urls.normal_link(base or "", known)[1] else ("", ""))
        b["link"] = [x[0] for x in links]
        yield b.loc[b["link"] != "", ["page_id", "url", "link"]]


def _page_class() -> Column:
    signal = lambda t: F.coalesce(*[F.when(urls.has_any(F.lower(t), words), F.lit(k)) for k, words in rules.PAGE_SIGNALS.items()])
    by_heading = F.get(F.filter(F.transform("headings", signal), lambda x: x.isNotNull()), F.lit(0))
    described = F.get(F.filter("metas", lambda x: F.lower(x["name"]) == "description"), F.lit(0))["content"]
    return F.coalesce(F.nullif(urls.page_type(F.col("url")), F.lit("other")), signal(F.col("title")), by_heading, signal(F.coalesce(described, F.lit(""))), F.lit("other"))


def page_class(parsed: DataFrame) -> DataFrame:
    """(page_id, url, page_class): told by the address, else the title, else the headings, else the description."""
    return parsed.select("page_id", "url", _page_class().alias("page_class"))


def people(parsed: DataFrame) -> DataFrame:
    """(page_id, mail, person_name, job_title, role, tier): for each mailbox that the markup of a page shows, whose it is by the part of the page that it stands in.

    That part is the nearest of five elements around it that is a container of 21 to 1,999 characters, else the fifth, else the element itself. Its first heading, else
    its first bold text, else its first line that looks like a name is the name; its first line with a role in it is the title. Mailboxes are taken in texts first, in
    links second and in other attributes third.
    """
    rows = parsed.select("page_id", F.inline("contexts"))
    return rows.select("page_id", "mail", F.col("name").alias("person_name"), F.col("title").alias("job_title"), contacts.title_role(F.col("title")).alias("role"), contacts.title_tier(F.col("title")).alias("tier"))


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    """(url, body) of robots files -> (url, sitemap) of their Sitemap lines."""
    lines = docs.select("url", F.explode(F.split("body", r"\r?\n")).alias("line")).where("lower(trim(line)) like 'sitemap:%'")
    return lines.select("url", F.trim(F.regexp_replace(F.trim("line"), "^[^:]*:", "")).alias("sitemap")).where("sitemap <> ''")


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """(url, body) of sitemaps -> (url, kind, loc): the maps of an index, else the pages of a map."""
    of = lambda tag: F.regexp_extract_all(F.col("body"), F.lit(rf"(?s)<{tag}>.*?<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))
    kinds = docs.select("url", of("sitemap").alias("maps"), of("url").alias("pages"))
    return kinds.select("url", F.when(F.size("maps") > 0, "sitemap").otherwise("url").alias("kind"), F.explode(F.when(F.size("maps") > 0, F.col("maps")).otherwise(F.col("pages"))).alias("loc"))


def relevant_sitemap_urls(locs: DataFrame) -> DataFrame:
    """(url, loc): pages of the site that are short or hold a word of priority, normalised, each once."""
    p = F.lower(urls.path(F.col("loc")))
    seg = F.filter(F.split(p, "/"), lambda s: s != "")
    words = [w for ws in rules.PRIORITY_WORDS.values() for w in ws]
    keep = urls.same_domain(F.col("url"), F.col("loc")) & ~urls.has_any(F.lower("loc"), rules.LOW_PRIORITY) & (urls.has_any(p, words) | F.size(seg).between(1, 2))
    return locs.where(keep).select("url", urls.normalize(F.col("loc")).alias("loc")).distinct()


def discover_sitemap_urls(robots: DataFrame, docs: DataFrame) -> DataFrame:
    """From robots files and stored sitemaps (url, body) to the relevant pages of each site, one level of index deep."""
    named = robots_sitemaps(robots).select(F.col("url").alias("site"), "sitemap")
    usual = robots.select(F.col("url").alias("site"), F.explode(F.array(*[F.lit(x) for x in ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml")])).alias("p")).select("site", F.concat(F.regexp_extract("site", r"^[^/]*//[^/]*", 0), "p").alias("sitemap"))
    todo = named.unionByName(usual).distinct()
    found = sitemap_urls(docs).select(F.col("url").alias("sitemap"), "kind", "loc")
    first = todo.join(found, "sitemap").select("site", "kind", "loc")
    nested = first.where("kind = 'sitemap'").select("site", F.col("loc").alias("sitemap")).distinct().join(found.where("kind = 'url'"), "sitemap").select("site", "loc")
    pages = first.where("kind = 'url'").select("site", "loc").unionByName(nested)
    return relevant_sitemap_urls(pages.withColumnRenamed("site", "url"))
