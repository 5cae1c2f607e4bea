"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "source", "campaign_id", "ad_id"]
# Substrings that keep a URL from being crawled.
EXCLUDED_EXTENSIONS = ".css .js .png .jpg .jpeg .gif .svg .ico .webp .bmp .mp3 .mp4 .avi .mov .wmv .flv .mkv .webm .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .rar .7z .gz .tar .bz2 .xz .exe .msi .deb .rpm .dmg .app .bin".split()
EXCLUDED_PATTERNS = "logout signout signin login register signup cart checkout payment billing account profile admin wp-admin dashboard settings config api/ ajax/ json".split()
MAX_LENGTH = 2048
#: Domains of high priority in the crawl.
HIGH_PRIORITY = ["wikipedia.org", "github.com", "stackoverflow.com", "arxiv.org"]


def excluded_regex() -> str:
    """One alternation for all excluded substrings."""
    return "|".join(x.replace(".", r"\.") for x in EXCLUDED_EXTENSIONS + EXCLUDED_PATTERNS)


def domain(url: Column) -> Column:
    """Lower-case host with port; '' without a scheme."""
    return F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1))


def bare_domain(url: Column) -> Column:
    """Host with port but without a leading www."""
    return F.regexp_replace(domain(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path without query and fragment, '/' if there is none."""
    found = F.regexp_extract(url, r"^.*?://[^/]*(/[^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def is_fetchable(url: Column) -> Column:
    """http or https and longer than ten characters."""
    return F.coalesce(url.rlike("^https?://") & (F.length(url) > 10), F.lit(False))


def is_valid(url: Column) -> Column:
    """A scheme, a host and at most 2048 characters."""
    return F.coalesce((F.length(url) <= MAX_LENGTH) & url.rlike("://[^/?#]"), F.lit(False))


def is_crawlable(url: Column) -> Column:
    """At most 500 characters and without excluded substrings (anywhere, as in the extension and pattern lists)."""
    return F.coalesce(~F.lower(url).rlike(excluded_regex()) & (F.length(url) <= 500), F.lit(False))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking or valueless parameters, single slashes, no trailing slash; '' if over 2048."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    head = F.regexp_extract(full, r"^(.*?://[^/?#]*)", 1)
    rest = F.regexp_replace(F.substr(full, F.length(head) + 1), r"(?s)#.*$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~F.substring_index(p, "=", 1).isin(*TRACKING)), "&")
    clean = F.regexp_replace(F.regexp_replace(rest, r"(?s)\?.*$", ""), "/+", "/")
    whole = F.concat(F.lower(head), clean, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    trimmed = F.when(whole.endswith("/") & (F.length(whole) > F.length(head) + 1), F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    return F.when(url.isNull() | (url == "") | (F.length(url) > MAX_LENGTH), "").otherwise(trimmed)


def resolve(base: Column, link: Column) -> Column:
    """An absolute, protocol-relative, root-relative or relative link against the page it stands on, normalised."""
    origin = F.regexp_extract(base, r"^(.*?://[^/]*)", 1)
    scheme = F.regexp_extract(base, r"^(.*?:)//", 1)
    folder = F.regexp_extract(base, r"^(.*/)", 1)
    joined = (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.when(scheme != "", scheme).otherwise("http:"), link))
        .when(link.startswith("/"), F.concat(F.when(origin != "", origin).otherwise(base), link))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(base, F.lit("/"))), link))
    )
    return F.when(F.coalesce(link, F.lit("")) == "", "").otherwise(normalize(joined))


def crawl_priority(url: Column, depth: Column) -> Column:
    """1 less 0.15 for each level (0.1 at least), more for education, government, news and reference, less for long URLs, at most 2."""
    d = domain(url)
    p = F.greatest(F.lit(0.1), 1.0 - depth * 0.15)
    p = p * F.when(d.isin(*HIGH_PRIORITY) | d.contains(".edu") | d.contains(".gov"), 1.3).otherwise(1.0)
    p = p * F.when(d.contains("news") | d.contains("wiki"), 1.2).otherwise(1.0)
    return F.least(p * F.when(F.length(url) > 200, 0.8).otherwise(1.0), F.lit(2.0))


# Authority of hosts and suffixes (scale 0 to 1, others 0.3).
AUTHORITY = {
    "wikipedia.org": 0.9, "github.com": 0.85, "stackoverflow.com": 0.8, "arxiv.org": 0.85, "nature.com": 0.9, "science.org": 0.9, "pubmed.ncbi.nlm.nih.gov": 0.85,
    ".edu": 0.8, ".ac.uk": 0.8, ".gov": 0.75, ".mil": 0.7, "reuters.com": 0.8, "bbc.com": 0.8, "cnn.com": 0.7, "npr.org": 0.75,
    "techcrunch.com": 0.7, "arstechnica.com": 0.75, "wired.com": 0.7, ".org": 0.6, ".com": 0.5, ".net": 0.45, ".info": 0.4, ".biz": 0.35,
}
# Rank of educational hosts (first and second tier) and suffixes (others 1.0).
RANK_TIER_1 = {
    "wikipedia.org": 2.0, "en.wikipedia.org": 2.0, "geeksforgeeks.org": 1.9, "stackoverflow.com": 1.8, "github.com": 1.7, "arxiv.org": 1.8, "nature.com": 1.7, "science.org": 1.7, "mit.edu": 1.8,
    "stanford.edu": 1.8, "harvard.edu": 1.8, "w3schools.com": 1.6, "mozilla.org": 1.6, "freecodecamp.org": 1.6, "codecademy.com": 1.5, "khanacademy.org": 1.7, "coursera.org": 1.5, "edx.org": 1.5,
    "udacity.com": 1.4, "udemy.com": 1.3, "tutorialspoint.com": 1.4, "javatpoint.com": 1.3, "programiz.com": 1.4, "leetcode.com": 1.5, "hackerrank.com": 1.4, "topcoder.com": 1.3, "codeforces.com": 1.3,
    "codechef.com": 1.3, "guru99.com": 1.2, "baeldung.com": 1.3, "spring.io": 1.4, "docs.python.org": 1.7, "docs.oracle.com": 1.6, "docs.microsoft.com": 1.5, "developer.mozilla.org": 1.8,
    "developer.android.com": 1.6, "developer.apple.com": 1.6, "aws.amazon.com": 1.5, "cloud.google.com": 1.5, "docs.aws.amazon.com": 1.5, "firebase.google.com": 1.4, "nodejs.org": 1.5,
    "reactjs.org": 1.5, "vuejs.org": 1.5, "angular.io": 1.5,
}
RANK_TIER_2 = {
    "medium.com": 1.4, "dev.to": 1.3, "towardsdatascience.com": 1.5, "hackernoon.com": 1.3, "scotch.io": 1.2, "css-tricks.com": 1.3, "smashingmagazine.com": 1.3, "alistapart.com": 1.3,
    "sitepoint.com": 1.2, "digitalocean.com": 1.3, "netlify.com": 1.2, "heroku.com": 1.2, "blog.google": 1.2, "engineering.fb.com": 1.3, "netflixtechblog.com": 1.3, "eng.uber.com": 1.3,
    "blog.twitter.com": 1.2, "blog.linkedin.com": 1.2, "blog.github.com": 1.2, "auth0.com": 1.2, "okta.com": 1.2, "twilio.com": 1.2, "stripe.com": 1.2, "segment.com": 1.2,
}
RANK_SUFFIXES = {".edu": 1.6, ".ac.uk": 1.5, ".ac.in": 1.4, ".edu.au": 1.4, ".edu.ca": 1.4, ".gov": 1.4, ".org": 1.2}


def by_domain(host: Column, table: dict[str, float], default: float) -> Column:
    """Exact host first, then the longest matching suffix, else the default. The table is a literal: no join, no shuffle."""
    exact = F.create_map(*[F.lit(x) for k, v in table.items() if k[0] != "." for x in (k, v)])[host]
    suffix = F.when(F.lit(False), F.lit(0.0))
    for k in sorted((k for k in table if k[0] == "."), key=lambda k: (-len(k), k)):
        suffix = suffix.when(host.endswith(k), table[k])
    return F.coalesce(exact, suffix, F.lit(default))


def authority(url: Column) -> Column:
    return by_domain(domain(url), AUTHORITY, 0.3)


def domain_rank(url: Column) -> Column:
    return by_domain(bare_domain(url), {**RANK_TIER_1, **RANK_TIER_2, **RANK_SUFFIXES}, 1.0)


def is_educational(url: Column) -> Column:
    return by_domain(bare_domain(url), {**RANK_TIER_1, **RANK_TIER_2, **RANK_SUFFIXES}, -1.0) > 0
