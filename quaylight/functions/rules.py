"""Word lists and weights of the rule-based operators. All are fixed values, in their natural order."""

PRIORITY_WORDS = {
    100: "contact contact-us contact_us".split(),
    95: "team our-team our_team meet-the-team meet_the_team".split(),
    90: (
        "agents agent realtors realtor brokers broker staff people leadership management our-agents our_agents find-an-agent find_an_agent agent-directory agent_directory "
        "brokerage our-brokers our_brokers real-estate-agents real_estate_agents realtor-directory realtor_directory office locations"
    ).split(),
    85: "about about-us about_us company our-story our_story".split(),
    50: "services listings properties".split(),
    20: "privacy terms legal disclaimer sitemap".split(),
}
LOW_PRIORITY = "/blog/ /news/ /search /tag/ /category/ /page/ .pdf .jpg .jpeg .png .gif .svg .css .js .xml .zip .doc .docx".split()
PAGE_TYPES = {
    "contact": "contact get-in-touch reach-us email-us".split(),
    "team": "team our-team staff people leadership meet-the-team agents brokers".split(),
    "about": "about about-us company our-story mission".split(),
    "agent_directory": "agents find-an-agent agent-directory our-agents realtors".split(),
    "office": "office locations offices".split(),
}
PROFILE_PARENTS = "agents agent team realtors brokers".split()
PAGE_SIGNALS = {
    "contact": ["contact", "get in touch", "reach us", "email us", "call us"],
    "team": ["team", "our team", "staff", "people", "leadership", "meet the team"],
    "about": ["about", "our story", "company", "who we are", "our mission"],
    "agent_directory": ["agents", "find an agent", "our agents", "realtors", "brokers"],
}
TIER_1 = [
    "owner", "co-owner", "founder", "co-founder", "ceo", "chief executive officer", "president", "principal", "partner", "managing partner", "broker owner", "broker-owner", "managing broker", "director",
    "vice president", "vp", "chief operating officer", "coo", "chief financial officer", "cfo",
]
TIER_2 = [
    "broker", "associate broker", "broker associate", "team leader", "sales manager", "office manager", "regional manager", "realtor", "real estate agent", "agent", "licensed agent", "sales associate", "real estate professional",
]
TIER_3 = "info hello contact office admin sales support general inquiries".split()
LOW_ROLES = "privacy legal compliance careers jobs support help noreply no-reply donotreply do-not-reply unsubscribe marketing billing".split()
TITLE_WORDS = [("ceo|president|principal|founder|owner|partner|director|vp|vice.president", 1, "Decision Maker"), ("broker|realtor|agent|sales", 2, "Broker/Agent"), ("manager|lead|head|supervisor", 2, "Senior Contact")]
GENERAL_MAILS = "info hello contact office admin sales support".split()
RANK_TIER_1 = ["owner", "founder", "ceo", "president", "principal", "partner", "managing broker", "broker owner", "director", "vp"]
RANK_TIER_2 = ["broker", "realtor", "agent", "team leader", "sales manager"]
RANK_TIER_3 = "info hello contact office admin sales".split()
RANK_LOW = "noreply no-reply privacy legal careers support".split()
METHOD_RANK = {"mailto": 0, "json_ld": 1, "structured_data": 1, "html_attribute": 2, "regex": 3, "obfuscated": 3, "html_entity": 3, "cloudflare": 3, "javascript": 4}
METHOD_POINTS = {
    "mailto": (30, "Found in mailto link"), "json_ld": (25, "Found in structured data (JSON-LD)"), "structured_data": (20, "Found in structured data"), "html_attribute": (15, "Found in HTML attribute"),
    "obfuscated": (10, "Found as obfuscated email"), "html_entity": (10, "Found as HTML entity"), "javascript": (10, "Found in JavaScript"),
}
PAGE_POINTS = {
    "contact": (20, "Found on contact page"), "team": (25, "Found on team page"), "agent_profile": (30, "Found on individual agent page"), "agent_directory": (20, "Found on agent directory page"),
    "homepage": (10, "Found on homepage"), "about": (10, "Found on about page"),
}
LEVELS = [(90, "excellent"), (75, "high"), (50, "medium")]
DISPOSABLE = (
    "mailinator.com guerrillamail.com guerrillamail.net tempmail.com throwaway.email temp-mail.org fakeinbox.com sharklasers.com grr.la dispostable.com yopmail.com yopmail.fr maildrop.cc trashmail.com trashmail.net "
    "guerrillamailblock.com guerrillamail.info 10minutemail.com mintemail.com mohmal.com getnada.com emailondeck.com 33mail.com mytemp.email harakirimail.com tmail.io tmpmail.net tmpmail.org mailnesia.com"
).split()
NOREPLY = "noreply no-reply donotreply do-not-reply mailer-daemon postmaster bounce auto".split()
PERSONAL = (
    "gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com mail.com protonmail.com protonmail.ch zoho.com yandex.com gmx.com live.com msn.com me.com comcast.net att.net verizon.net cox.net"
).split()
JUNK_DOMAINS = (
    "youtube.com facebook.com twitter.com x.com instagram.com linkedin.com pinterest.com tiktok.com wikipedia.org reddit.com quora.com google.com bing.com duckduckgo.com yahoo.com apple.com microsoft.com amazon.com "
    "craigslist.org indeed.com glassdoor.com mapquest.com"
).split()
SCORE_TERMS = ["real estate", "realtor", "property", "brokerage", "broker", "realty", "properties", "homes", "apartments", "rental", "property management", "home buyers", "investors"]
SCORE_FIRMS = "llc inc group partners associates company corp services solutions".split()
SCORE_LISTS = [
    "top 10", "top 20", "top 50", "top 100", "best real estate", "list of", "directory", "reviews of", "compare", "find a realtor", "agent finder", "top-rated", "most powerful", "best commercial",
]
SCORE_JOBS = "jobs careers hiring salary resume".split()
AGGREGATORS = (
    "goodfirms.co f6s.com clutch.co sortlist.com expertise.com bark.com thumbtack.com homeadvisor.com angi.com porch.com fixr.com inven.ai retyn.ai proptechbuzz.com smartguy.com bestinhood.com "
    "propertymanagementlist.com belonghome.com builtinnyc.com easyleadz.com realtrends.com houzeo.com homelight.com fastexpert.com themanifest.com realestatebees.com accio.com allpropertymanagement.com "
    "managemyproperty.com realestate.usnews.com findrealestate.com propertymanagement.com smartlocalmove.com movoto.com homezero.com webuycash.com carrot.com placester.com ziprealty.com sulekha.com justdial.com"
).split()
PLATFORMS = {"linkedin": ["linkedin.com", "linkedin.cn"], "facebook": ["facebook.com", "fb.com", "fb.me"], "instagram": ["instagram.com"], "twitter": ["twitter.com", "x.com"], "youtube": ["youtube.com", "youtu.be"], "tiktok": ["tiktok.com"]}
COMPANY_PATHS = {"linkedin": ["/company/", "/school/", "/showcase/"], "facebook": ["/pages/", "/pg/"], "youtube": ["/channel/", "/c/", "/@"]}
CALLING_CODES = [("1", "US/CA"), ("44", "UK"), ("61", "AU"), ("91", "IN"), ("86", "CN"), ("81", "JP"), ("49", "DE"), ("33", "FR"), ("39", "IT"), ("34", "ES"), ("31", "NL"), ("46", "SE"), ("47", "NO"), ("45", "DK"), ("358", "FI"), ("48", "PL"), ("420", "CZ")]
TRACKING = "utm_source utm_medium utm_campaign utm_content utm_term fbclid gclid mc_cid mc_eid ref source _ga _gl msclkid twclid".split()
FAX_WORDS = "fax facsimile faksimile".split()
MOBILE_WORDS = "mobile cell cellular mobil sms".split()
#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = "co.uk org.uk me.uk ac.uk gov.uk com.au net.au org.au co.nz co.za com.br co.jp co.in com.mx com.sg com.hk co.kr com.tr".split()
VARIANT_SUFFIXES = "area metro county region district suburbs".split()
VARIANT_TOPICS = ["real estate company", "property management", "realtor"]
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z]{2,})+"
EMAIL_LOOSE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONES = [
    r"(?:\+[0-9]{1,3}[\s\-.]?)?(?:\([0-9]{2,4}\)[\s\-.]?)?[0-9]{2,4}[\s\-.]?[0-9]{3,4}[\s\-.]?[0-9]{3,4}",
    r"(?:\([0-9]{3}\)[\s\-.]?)?[0-9]{3}[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{4}",
    r"(?:\(0[0-9]\)[\s\-.]?)?0[0-9][\s\-.]?[0-9]{4}[\s\-.]?[0-9]{3,4}",
    r"0[0-9][\s\-.]?[0-9]{3,4}[\s\-.]?[0-9]{3,4}",
]
OBFUSCATED = [
    r"([A-Za-z0-9_][A-Za-z0-9_.%+\-]*)\s*[\[(]\s*[Aa][Tt]\s*[\])]\s*([A-Za-z0-9_][A-Za-z0-9_.\-]*)\s*[\[(]\s*[Dd][Oo][Tt]\s*[\])]\s*([A-Za-z0-9_]{2,})",
    r"([A-Za-z0-9_][A-Za-z0-9_.%+\-]*)\s+[Aa][Tt]\s+([A-Za-z0-9_][A-Za-z0-9_.\-]*)\s+[Dd][Oo][Tt]\s+([A-Za-z0-9_]{2,})",
    r"([A-Za-z0-9_][A-Za-z0-9_.%+\-]*)\s*\{[Aa][Tt]\}\s*([A-Za-z0-9_][A-Za-z0-9_.\-]*)\s*\{[Dd][Oo][Tt]\}\s*([A-Za-z0-9_]{2,})",
    r"([A-Za-z0-9_][A-Za-z0-9_.%+\-]+)&#(?:64|[xX]40);([A-Za-z0-9_.\-]+)\.([A-Za-z0-9_]{2,})",
]
FALSE_MAILS = "example.com test.com sentry.io wixpress.com".split()
PHONE_CLASSES = "phone tel contact".split()
PHONE_IDS = "phone tel".split()
PHONE_PROPERTIES = "telephone phone".split()
SOCIAL_CLASSES = "social linkedin facebook instagram twitter youtube tiktok".split()
SOCIAL_HOSTS = "linkedin.com facebook.com instagram.com twitter.com x.com youtube.com tiktok.com".split()
SKIPPED_HOSTS = "google.com goo.gl google.co googleapis.com bing.com microsoftonline.com microsoft.com youtube.com accounts.google.com support.google.com maps.google.com play.google.com".split()
NO_NAMES = "the a an and or but our we you".split()
PARTICLES = "de van von di da la el".split()
IMAGES = ".png .jpg .jpeg .gif .svg .webp .bmp .ico".split()
CSV_HEAD = ["Company Name", "Website", "Normalized URL", "Domain", "Status", "Pages Crawled", "Pages Discovered", "Emails Found", "Emails Rejected", "Best Email", "Best Contact Name", "Best Contact Role", "Best Score"]
CSV_EACH = ["", " Name", " Role", " Score", " Source", " Method", " Page Type"]
CSV_TAIL = ["Duration (s)", "Error Type", "Error Message", "All Emails (JSON)"]
