"""Expressions over addresses. All are built-in expressions but absolute(), which needs a resolver."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules

# scheme, host, path, parameters of the last segment, query; a fragment is dropped
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def path(url: Column) -> Column:
    return part(url, 3)


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_of(text: Column, words: list[str]) -> Column:
    """The first of the words that the text contains, or null."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no dots after the host, no slash after the path, no fragment; '' for null or ''."""
    full = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))
    scheme, host = F.lower(part(full, 1)), F.lower(part(full, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host, p, q = F.regexp_replace(host, r"\.+$", ""), part(full, 3), part(full, 4)
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    whole = F.concat(scheme, F.lit("://"), host, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(url.isNull() | (url == ""), "").otherwise(whole)


def host(url: Column) -> Column:
    """The host in lower case without one leading www."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def bare_host(url: Column) -> Column:
    """The host of an address with or without a scheme, in lower case, without user, port and closing dots."""
    h = F.when(url.contains("://"), part(url, 2)).otherwise(F.regexp_extract(url, "^[^/?#]*", 0))
    return F.regexp_replace(F.regexp_replace(F.lower(h), r"^.*@", ""), r":[0-9]*$|\.+$", "")


def root_domain(url: Column) -> Column:
    """The label before the public suffix, with it; the host itself where there is no such label."""
    h = bare_host(url)
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(rules.SUFFIXES), F.substring_index(h, ".", -3)).otherwise(two)


def normal_link(url: str, known: dict[str, tuple[str, str]], most: int = 100_000) -> tuple[str, str]:
    """normalize() and root_domain() of one address outside of a plan, remembered in known."""
    if url not in known:
        if len(known) >= most:
            known.clear()
        full = url if url.startswith(("http://", "https://")) else f"https://{url}"
        m = re.match(PARTS, full, re.S)
        scheme, site, p, q = (m[k] or "" for k in (1, 2, 3, 4)) if m else ("", "", "", "")
        scheme, site = scheme.lower(), site.lower()
        site = re.sub(":80$" if scheme == "http" else ":443$" if scheme == "https" else "$^", "", site).rstrip(".")
        bare = re.sub(r":[0-9]*$|\.+$", "", re.sub(r"^.*@", "", site)).split(".")
        known[url] = f"{scheme}://{site}{p if p == '/' else p.rstrip('/')}{'?' + q if q else ''}", ".".join(bare[-3 if ".".join(bare[-2:]) in rules.SUFFIXES else -2 :])
    return known[url]


def same_domain(a: Column, b: Column) -> Column:
    return root_domain(a) == root_domain(b)


def absolute(base: Column, href: Column) -> Column:
    """href resolved against base; '' for a null or empty one."""

    @F.pandas_udf(StringType())
    def resolve(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                return urljoin(b or "", h) if h else ""
            except ValueError:
                return ""

        return pd.Series([one(b, h) for b, h in zip(bases, hrefs)])

    return resolve(base, href)


def strip(text: Column) -> Column:
    """Without blanks, tabs and line ends around it."""
    return F.trim(text, F.lit(" \t\r\n"))


def email_domain(email: Column) -> Column:
    """What follows the first @, in lower case; '' without one."""
    return F.when(email.contains("@"), F.lower(strip(F.get(F.split(email, "@"), F.lit(1))))).otherwise("")


def without_tracking(url: Column) -> Column:
    """The address without tracking parameters, parameters without a value, and fragment; an address without a query is left as it is."""
    q = part(url, 4)
    kept = F.filter(F.split(q, "&"), lambda x: ~F.lower(F.substring_index(x, "=", 1)).isin(rules.TRACKING) & F.regexp_like(x, F.lit("^[^=]+=.")))
    head = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.when(q == "", url).otherwise(F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _bare_path(url: Column) -> Column:
    return F.regexp_replace(F.lower(path(url)), "/+$", "")


def page_type(url: Column) -> Column:
    """The kind of page that the path tells of."""
    p = _bare_path(url)
    seg = F.split(F.regexp_replace(p, "^/+", ""), "/")
    out = F.when(p == "", "homepage")
    for kind, words in rules.PAGE_TYPES.items():
        out = out.when(has_any(p, ["/" + w for w in words]), kind)
    profile = (F.size(seg) == 2) & (seg[0].isin(rules.PROFILE_PARENTS) & ~F.get(seg, F.lit(1)).isin("", "page", "search") | seg[0].isin("brokerage", "offices"))
    return out.when(profile, "agent_profile").otherwise("other")


def priority(url: Column) -> Column:
    """110 for a homepage, else the highest priority of a word in the path, else 5 for what is rarely worth it, else 10."""
    p = _bare_path(url)
    out = F.when(p == "", 110)
    for points, words in rules.PRIORITY_WORDS.items():
        out = out.when(has_any(p, ["/" + w for w in words]), points)
    return out.when(has_any(p, rules.LOW_PRIORITY), 5).otherwise(10)


def low_priority(url: Column) -> Column:
    return has_any(F.lower(path(url)), rules.LOW_PRIORITY)


def result_score(url: Column, title: Column, snippet: Column, location: Column) -> Column:
    """How much a search result looks like the site of a firm at the location."""
    text, h, p = F.lower(F.concat_ws(" ", title, snippet)), host(url), F.filter(F.split(path(url), "/"), lambda s: s != "")
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    places = F.filter(F.split(F.replace(F.lower(location), F.lit(","), F.lit("")), r"\s+"), lambda w: (F.length(w) > 2) & F.contains(text, w))
    terms = [add(text.contains(t) | h.contains(t), 2) for t in rules.SCORE_TERMS] + [add(text.contains(t), 1) for t in rules.SCORE_FIRMS]
    terms += [F.when(F.size(p) <= 1, 3).when(F.size(p) == 2, 1).otherwise(0), F.size(places)]
    terms += [add(text.contains(t), -3) for t in rules.SCORE_LISTS] + [add(text.contains(t), -5) for t in rules.SCORE_JOBS]
    terms += [add(has_any(h, rules.AGGREGATORS), -6), add(has_any(url, ["/blog/", "/lists/", "/ranking/"]), -4), add(h.contains(".gov"), -10)]
    return reduce(lambda a, b: a + b, terms)


def junk(url: Column, more: list[str] | None = None) -> Column:
    return has_any(host(url), [*rules.JUNK_DOMAINS, *(more or [])])


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def place_slug(text: Column) -> Column:
    return F.translate(text, " ,.", "_")


def place_key(text: Column) -> Column:
    """A place in lower case with only letters, digits and single spaces' worth of anything else turned to spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def name_from_title(title: Column, domain: Column) -> Column:
    n = F.trim(F.substring_index(F.substring_index(title, " - ", 1), " | ", 1))
    return F.when(F.length(n) < 2, domain).otherwise(n)


def fill_template(template: Column, location: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{location}"), location), F.lit("{city}"), F.trim(F.substring_index(location, ",", 1)))


def organic(href: Column) -> Column:
    """Whether a link of a result page leads to a site of its own: http, a host with a dot, and no search engine's or other skipped host."""
    h = host(href)
    return F.coalesce(href.startswith("http") & h.contains(".") & ~has_any(h, rules.SKIPPED_HOSTS), F.lit(False))
