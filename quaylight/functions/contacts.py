"""Expressions over mailboxes, phone numbers, social links, names, roles and scores."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules
from .urls import email_domain, first_of, has_any, host, path, root_domain, strip


def plain(email: Column) -> Column:
    return F.lower(strip(email))


def digits(phone: Column) -> Column:
    return F.regexp_replace(phone, "[^0-9]", "")


def phone_key(phone: Column) -> Column:
    d = digits(phone)
    return F.when(phone.startswith("+") & (d != ""), F.concat(F.lit("+"), d)).otherwise(d)


def phone_valid(phone: Column) -> Column:
    return F.length(digits(phone)).between(7, 15)


def phone_country(phone: Column) -> Column:
    d, plus = digits(phone), phone.startswith("+")
    out = F.when(F.lit(False), "")
    for code, name in rules.CALLING_CODES:
        out = out.when(plus & d.startswith(code), name)
    return out.when(F.regexp_like(phone, F.lit("^0[0-9]")), "AU/UK").otherwise("")


def is_fax(context: Column) -> Column:
    return has_any(F.lower(context), rules.FAX_WORDS)


def is_mobile(context: Column) -> Column:
    return has_any(F.lower(context), rules.MOBILE_WORDS)


def phones_in(text: Column) -> Column:
    """The numbers in a text by four patterns, one after the other, those of 7 to 15 digits."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in rules.PHONES])
    return F.filter(F.transform(found, lambda x: F.trim(x)), phone_valid)


def emails_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"\b{rules.EMAIL}\b"), F.lit(0)), F.lower))


def hidden_emails_in(text: Column) -> Column:
    """Mailboxes whose signs are written out: (at) and (dot), AT and DOT, {at} and {dot}, character entities."""
    def written(p: str) -> Column:
        mail = lambda m: F.lower(F.concat(F.regexp_extract(m, p, 1), F.lit("@"), F.regexp_extract(m, p, 2), F.lit("."), F.regexp_extract(m, p, 3)))
        return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), mail)

    each = [written(p) for p in rules.OBFUSCATED]
    return F.array_distinct(F.concat(*each))


def unmask_cfemail(code: Column) -> Column:
    """The text behind a hex string whose first byte is the key of all others; '' if it is no such string."""
    byte = lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")
    ok = F.regexp_like(code, F.lit("^(?:[0-9a-fA-F]{2}){2,}$"))
    chars = F.transform(F.sequence(F.lit(3), F.length(code) - 1, F.lit(2)), lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1)))))
    return F.when(ok, F.lower(F.array_join(chars, ""))).otherwise("")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character entities of HTML resolved; no built-in expression does that."""
    return text.map(html.unescape, na_action="ignore")


def disposable(email: Column) -> Column:
    return email_domain(email).isin(rules.DISPOSABLE)


def personal(email: Column) -> Column:
    return email_domain(email).isin(rules.PERSONAL)


def noreply(email: Column) -> Column:
    return has_any(F.lower(F.substring_index(email, "@", 1)), rules.NOREPLY)


def syntax_valid(email: Column) -> Column:
    return F.regexp_like(email, F.lit(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]$"))


def false_mail(email: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(email).endswith(x) for x in rules.IMAGES]) | has_any(F.lower(email), rules.FALSE_MAILS)


def domain_match(mail_domain: Column, site_domain: Column) -> Column:
    a, b = F.lower(F.trim(mail_domain)), F.lower(F.trim(site_domain))
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)) | ((root_domain(a) == root_domain(b)) & (root_domain(a) != ""))


def validated(email: Column, site_domain: Column, has_mx: Column) -> Column:
    return F.struct(
        syntax_valid(email).alias("syntax_valid"), F.coalesce(has_mx, F.lit(False)).alias("mx_valid"), domain_match(email_domain(email), site_domain).alias("domain_match"), disposable(email).alias("is_disposable"),
        noreply(email).alias("is_noreply"), personal(email).alias("is_personal"), (syntax_valid(email) & ~disposable(email) & ~noreply(email)).alias("keep"),
    )


def platform(url: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, domains in rules.PLATFORMS.items():
        out = out.when(has_any(F.lower(url), domains), name)
    return out.otherwise("")


def company_page(url: Column) -> Column:
    return reduce(lambda a, b: a | b, [(platform(url) == p) & has_any(F.lower(url), words) for p, words in rules.COMPANY_PATHS.items()])


def profile_name(url: Column) -> Column:
    """The name in a profile's address; a letter after a character that is none is made upper case, as in O'Neil."""
    seg = F.filter(F.split(path(url), "/"), lambda s: s != "")
    titled = lambda s: F.array_join(F.transform(F.regexp_extract_all(F.replace(s, F.lit("-"), F.lit(" ")), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0)), F.initcap), "")
    p = platform(url)
    second = F.when((p == "linkedin") & (F.size(seg) >= 2), titled(F.get(seg, F.lit(1))))
    return F.coalesce(second, F.when(p == "facebook", titled(F.get(seg, F.lit(0)))), F.get(seg, F.lit(0)), F.lit(""))


def social_key(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), "/+$", "")


def _tiers(text: Column, lists: list[tuple[list[str], int]]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for words, tier in lists:
        out = out.when(has_any(text, words), tier)
    return out.otherwise(0)


def title_tier(title: Column) -> Column:
    return _tiers(F.lower(F.coalesce(title, F.lit(""))), [(rules.TIER_1, 1), (rules.TIER_2, 2), (rules.TIER_3, 3), (rules.LOW_ROLES, -1)])


def title_role(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(first_of(t, rules.TIER_1 + rules.TIER_2 + rules.TIER_3 + rules.LOW_ROLES), title, F.lit(""))


def person_role(name: Column, title: Column, email: Column) -> Column:
    """(role, tier, label) of a person: a word of low priority anywhere first, then one of the tiers, then a title's own words, then the title, then a common mailbox."""
    t, mail = F.coalesce(title, F.lit("")), F.coalesce(email, F.lit(""))
    text = F.lower(F.concat_ws(" ", t, F.coalesce(name, F.lit("")), mail))
    low = F.lower(t)
    of = lambda role, tier, label: F.struct(role.alias("role"), F.lit(tier).alias("tier"), F.lit(label).alias("label"))
    out = F.when(F.lit(False), of(F.lit(""), 0, ""))
    for words, tier, label in ((rules.LOW_ROLES, -1, "Low Priority"), (rules.TIER_1, 1, "Decision Maker"), (rules.TIER_2, 2, "Broker/Agent"), (rules.TIER_3, 3, "General Contact")):
        out = out.when(has_any(text, words), of(first_of(text, words), tier, label))
    for words, tier, label in rules.TITLE_WORDS:
        out = out.when(F.regexp_like(low, F.lit(rf"\b(?:{words})\b")), of(t, tier, label))
    out = out.when(t != "", of(t, 0, "Other"))
    local = F.substring_index(mail, "@", 1)
    return out.when(local.isin(rules.GENERAL_MAILS), of(local, 3, "General Contact")).otherwise(of(F.lit(""), 0, "Unknown"))


def person_tier(name: Column, title: Column, email: Column) -> Column:
    return person_role(name, title, email)["tier"]


def tier_label(tier: Column) -> Column:
    return F.when(tier == -1, "Low Priority (Reject)").when(tier == 1, "Decision Maker").when(tier == 2, "Broker/Agent").when(tier == 3, "General Contact").otherwise("Unknown")


def rank_tier(role: Column) -> Column:
    return _tiers(F.lower(F.coalesce(role, F.lit(""))), [(rules.RANK_LOW, -1), (rules.RANK_TIER_1, 1), (rules.RANK_TIER_2, 2), (rules.RANK_TIER_3, 3)])


def method_rank(method: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for m, r in rules.METHOD_RANK.items():
        out = out.when(method == m, r)
    return out.otherwise(5)


def confidence(method: Column, page: Column, syntax: Column, mx: Column, match: Column, person: Column, role: Column, is_disposable: Column) -> Column:
    """(score, level, reasons) from the signals of one mailbox; a null flag counts as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    r, name = F.lower(F.coalesce(role, F.lit(""))), F.coalesce(person, F.lit(""))
    signals = [(method == m, n, F.lit(why)) for m, (n, why) in rules.METHOD_POINTS.items()] + [(page == p, n, F.lit(why)) for p, (n, why) in rules.PAGE_POINTS.items()]
    for flag, plus, good, minus, bad in ((syntax, 5, "Syntax valid", -20, "Syntax invalid"), (mx, 15, "Valid MX records", -5, "No MX records"), (match, 20, "Domain matches company website", -30, "Domain does not match company website")):
        signals += [(yes(flag), plus, F.lit(good)), (~yes(flag), minus, F.lit(bad))]
    signals.append((name != "", 15, F.concat(F.lit("Person name detected: "), name)))
    tier = _tiers(r, [(rules.RANK_TIER_1, 1), (rules.RANK_TIER_2, 2), (rules.RANK_TIER_3, 3), (rules.RANK_LOW, -1)])
    signals += [(tier == t, n, F.lit(why)) for t, n, why in ((1, 30, "Decision-maker role detected"), (2, 20, "Relevant broker/agent role detected"), (3, 5, "General company contact"), (-1, -30, "Low-priority email type"))]
    signals.append((yes(is_disposable), -100, F.lit("Disposable email domain")))
    total = reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n, _ in signals])
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    level = F.when(score >= rules.LEVELS[0][0], rules.LEVELS[0][1]).when(score >= rules.LEVELS[1][0], rules.LEVELS[1][1]).when(score >= rules.LEVELS[2][0], rules.LEVELS[2][1]).otherwise("low")
    reasons = F.array_compact(F.array(*[F.when(c, why) for c, _, why in signals]))
    return F.struct(score.alias("score"), level.alias("level"), reasons.alias("reasons"))


def looks_like_name(text: Column) -> Column:
    """Two to five words, each without a small letter in front, or a particle."""
    words = F.split(F.trim(text), r"\s+")
    return F.size(words).between(2, 5) & F.forall(words, lambda w: ~F.regexp_like(w, F.lit(r"^\p{Ll}")) | w.isin(rules.PARTICLES))


def site_of(url: Column) -> Column:
    return host(url)


def contexts(text: Column, pattern: str, around: int = 150, most: int = 500) -> Column:
    """For each match in order (value, context): the match with what stands up to `around` characters before and after it."""
    ends = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{pattern})"), F.lit(0)), F.length)
    stops = F.transform(ends, lambda n, i: F.aggregate(F.slice(ends, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b))
    found = F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0))

    def slice_of(v: Column, i: Column) -> Column:
        start = F.greatest(F.get(stops, i) - F.length(v) - around, F.lit(0))
        return F.struct(v.alias("value"), F.substring(F.trim(F.substring(text, start + 1, F.get(stops, i) + around - start)), 1, most).alias("context"))

    return F.transform(found, slice_of)


def queue_lines(body: Column) -> Column:
    """The places of a form's text: one a line, decoded, never split at commas; blank lines and those that begin with # are none."""
    raw = F.when(body.rlike("^[A-Za-z_]+="), F.coalesce(F.try_url_decode(F.regexp_replace(body, "^[A-Za-z_]+=", "")), F.lit(""))).otherwise(body)
    return F.filter(F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
