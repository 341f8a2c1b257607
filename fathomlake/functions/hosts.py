"""What a host or URL tells about a page, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import host_of, path_of, url_key, word_bounds

# Known hosts by kind. A host stands for its subdomains too.
AUTHORITY = (
    "wikipedia.org", "britannica.com", "nobelprize.org", "medlineplus.gov", "nih.gov", "cdc.gov", "who.int",
    "nasa.gov", "nature.com", "science.org", "scientificamerican.com", "mayoclinic.org", "nba.com", "espn.com",
    "reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "nytimes.com", "theguardian.com", "washingtonpost.com",
)
NEWSROOM = (
    "reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "nytimes.com", "theguardian.com", "washingtonpost.com",
    "npr.org", "cnn.com", "nbcnews.com", "cbsnews.com", "abcnews.go.com", "aljazeera.com", "euronews.com", "wsj.com",
    "bloomberg.com", "ft.com", "usatoday.com", "latimes.com", "axios.com", "politico.com", "news.yahoo.com",
    "foxnews.com", "pbs.org", "theatlantic.com", "economist.com", "news.sky.com", "dw.com", "france24.com",
)
PRESS = (
    "cnet.com", "techradar.com", "theverge.com", "tomsguide.com", "gsmarena.com", "phonearena.com",
    "androidauthority.com", "androidcentral.com", "pcmag.com", "mashable.com", "wired.com", "arstechnica.com",
    "cbssports.com", "sports.yahoo.com", "yahoo.com", "basketball-reference.com", "foxchase.org", "sciencefocus.com",
    "pearson.com", "nobelprize.org",
)
WEAK = ("blogspot.com", "wordpress.com", "sites.google.com", "wixsite.com", "weebly.com", "tumblr.com", "genially.com", "livejournal.com", "blogger.com")
SOCIAL = ("reddit.com", "facebook.com", "instagram.com", "tiktok.com", "pinterest.com", "x.com", "twitter.com", "quora.com")
SCHOLAR = (
    "doi.org", "arxiv.org", "ncbi.nlm.nih.gov", "nature.com", "science.org", "sciencedirect.com",
    "springer.com", "wiley.com", "cell.com", "thelancet.com", "nejm.org", "pnas.org", "plos.org",
    "frontiersin.org", "mdpi.com", "biorxiv.org", "medrxiv.org", "semanticscholar.org", "jstor.org",
    "acm.org", "ieee.org",
)
VIDEO = ("youtube.com", "youtu.be")
OFFICIAL = (r"\.(?:gov|edu|mil)(?:\.[a-z]{2})?$", r"\.state\.[a-z]{2}\.us$")
BLOCKED_HOST = r"(?i)(^|\.)(multporn|pornhub|xvideos|xnxx|xhamster|onlyfans|chaturbate|spankbang|redtube|youporn|tube8|porn360|xnxxes|hqporner|eporner|gotporn|porn\.com|xxx|nsfw|adultvideo|sexvid)(\.|$)"
BLOCKED_IN_HOST = r"(?i)porn|xxx|hentai|xvideo|camgirl"
BLOCKED_PATH = r"(?i)/(porn|xxx|nsfw|adult|sex|hentai|nude|naked)(/|$)"
FICTION = r"(?i)(?:^|\.)(fandom\.com|wikia\.com|gamepedia\.com|giantbomb\.com|nopixel\.wiki)$"
UNREACHABLE = r"^[\d.]+$|^\[|(^|\.)(localhost|local|internal|lan|home|arpa)$|pages\.dev$"
BLOCK_PAGE = r"(?i)\byour ip(?: address)?\b.{0,60}\b(?:has been|is|was) (?:blocked|banned)|\b(?:automated|unusual) (?:fetches|requests|queries|traffic)\b|\bviolation of robots\.txt\b|\bverify (?:that )?you are (?:a )?human\b|\bare you a robot\b|\bcaptcha\b|\benable (?:javascript and )?cookies to continue\b|\bchecking (?:if the site connection is secure|your browser)\b|\battention required!? \| cloudflare\b|\bjust a moment\.\.\.|\baccess (?:to this page has been )?denied\b|\brequest (?:was )?blocked\b|\b403 forbidden\b"


def among(host: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a host is one of these or a subdomain of one."""
    dotted = F.concat(F.lit("."), host)
    return reduce(lambda a, b: a | b, (dotted.endswith(f".{h}") for h in hosts))


def tier(host: Column) -> Column:
    """0 for encyclopedias, authorities and official sites, 1 for the press, 3 for free blogs, 2 for the rest."""
    official = reduce(lambda a, b: a | b, (host.rlike(p) for p in OFFICIAL))
    return F.when(host == "", 2).when(among(host, AUTHORITY) | official, 0).when(among(host, PRESS), 1).when(among(host, WEAK), 3).otherwise(2)


def spam_web_app(host: Column) -> Column:
    """A free app host with one long label, or a shorter one with digits, that looks made up."""
    label = F.regexp_extract(host, "^([^.-]+)\\.web\\.app$", 1)
    return (F.length(label) >= 12) | ((F.length(label) >= 8) & label.rlike("\\d"))


def blocked(url: Column) -> Column:
    """Whether a page is never shown."""
    host = host_of(url)
    return host.rlike(BLOCKED_HOST) | host.rlike(BLOCKED_IN_HOST) | spam_web_app(host) | path_of(url).rlike(BLOCKED_PATH)


def fetchable(url: Column) -> Column:
    """A public web page: http or https, no user, a usual port, a host name with a dot that is no local one."""
    parts = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), "^(?i:https?)://([^/?#]*@)?(\\[[^\\]]*\\]|[^/?#:@]*)(?::(\\d*))?(?:[/?#]|$)", k)
    host = F.lower(parts(2))
    return F.contains(host, F.lit(".")) & (parts(1) == "") & parts(3).isin("", "80", "443") & ~host.rlike(UNREACHABLE)


def same_source(a: Column, b: Column) -> Column:
    """Whether two URLs have the same host and path; the query doesn't count."""
    key = lambda u: url_key(F.regexp_replace(u, "[?#].*$", ""))
    return (host_of(a) != "") & (key(a) == key(b))


def is_block_page(text: Column) -> Column:
    """A short page that opens with a refusal to robots."""
    return (F.length(text) < 4000) & F.substring(text, 1, 800).rlike(word_bounds(BLOCK_PAGE))
