"""URL and domain functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = ("_ga", "fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
HEADER_WORDS = "company companies domain domains host link links name site sites url urls website websites домейн домейни компания сайт уебсайт фирма".split()
PLATFORMS = "facebook.com fb.com goo.gl google.com instagram.com linkedin.com pinterest.com snapchat.com t.me telegram.me threads.net tiktok.com twitter.com wa.me whatsapp.com wikidata.org wikipedia.org x.com youtu.be youtube.com".split()
EXACT_HOSTS = "blagoevgrad-ob.bg blagoevgrad.bg burgas.bg dobrich.bg e-gov.bg egov.bg gabrovo.bg government.bg haskovo.bg kardzhali.bg kyustendil.bg lovech-obshtina.bg lovech.bg montana.bg obshtina.bg obshtini.bg parliament.bg pazardzhik.bg pernik.bg pleven.bg plovdiv.bg razgrad.bg ruse.bg sandanski.bg shumen.bg silistra.bg sliven.bg smolyan.bg sofia-grad.bg sofia.bg stara-zagora.bg targovishte.bg varna.bg vidin.bg vratsa.bg vratza.bg yambol.bg".split()
SUFFIXES = (
    "2gis.bg 2gis.com airbnb.com alakart.bg bark.com bazar.bg bcci.bg bcpea.org bezplatno.net bgjobs.com bia-bg.com bing.com booking.com brra.bg burgas.biz businessaccountbg.com detskigradini.bg detskitegradini.com expedia.com facebook.com firma.bg firmeni.bg framar.bg goguide.bg google.com industryinfo.bg instagram.com jobs.bg justbook.bg "
    "karieri.bg katalog.bg korektnafirma.com linkedin.com medrec-m.com menuonline.bg oink.bg olx.bg opoznai.bg papagal.bg pazaruvaj.com plovdiv.biz puls.bg rabota.bg registarnadetskitegradini.com registryagency.bg restaurant.bg restogo.bg rezervaciq.com sofia.biz starofservice.bg starofservice.com takeaway.com thumbtack.com tiktok.com tripadvisor.bg tripadvisor.com trivago.com twitter.com varna.biz vsichkifirmi.com wikidata.org wikipedia.org x.com yelp.com youtube.com zaplata.bg zavedenia.com zdravencatalog.com zdravenportal.com"
).split()
PATTERNS = ((r"^ruo-", "regional education office"), (r"^rio-", "regional education inspectorate"), (r"\.government\.bg$", "government subdomain"), (r"^obshtina-", "municipal domain"))


def upload_domain(raw: Column) -> Column:
    """An uploaded cell as a domain: trimmed, lower case, no scheme, no leading www., cut at the first slash."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"^https?://", ""), r"^www\.", "")
    return F.split(bare, "/")[0]


def is_valid_domain(domain: Column) -> Column:
    return (domain != "") & domain.contains(".") & ~domain.rlike(r"\s")


def is_header_word(cell: Column) -> Column:
    return F.lower(F.trim(cell)).isin(HEADER_WORDS)


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def host(url: Column) -> Column:
    """Lower-case host without port, '' where there is no scheme."""
    return F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)")


def query(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?([^#]*)")


def normalized_url(raw: Column) -> Column:
    """One form for a page's address: https, bare host, no default port, no tracking, no last slash, no fragment.

    What can't be read as an absolute URL is trimmed, put in lower case and loses a last slash.
    """
    url = F.trim(raw)
    port = _part(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)")
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    where = path(url)
    where = F.when(where.isin("", "/"), "/").otherwise(F.regexp_replace(where, "/$", ""))
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING)), "&")
    whole = F.concat(F.lit("https://"), bare_host(url), port, where, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(host(url) != "", whole).otherwise(F.regexp_replace(F.lower(url), "/$", ""))


def raw_domain(raw: Column) -> Column:
    """Host of a URL or bare domain, without www."""
    return bare_host(F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw)))


def platform_host(raw: Column) -> Column:
    """Host without any of the generic first labels, however many."""
    return F.regexp_replace(host(F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))), r"^(?:(?:business|l|lm|m|mobile|web|www)\.)+", "")


def is_platform(raw: Column) -> Column:
    """Whether the host, or the one a level above it, is a platform that no company site lives on."""
    name = platform_host(raw)
    return name.isin(PLATFORMS) | F.regexp_replace(name, r"^[^.]*\.", "").isin(PLATFORMS)


def crawlability(raw: Column) -> Column:
    full = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    return F.when(F.trim(raw) == "", "UNKNOWN").when(~is_platform(raw), "CRAWLABLE").when(F.regexp_replace(path(full), "/+$", "") != "", "SOCIAL_PROFILE").otherwise("NON_CRAWLABLE_PLATFORM")


def parents(domain: Column) -> Column:
    """The domain and all above it, longest first."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def blocklist_hit(domain: Column, exact: list[str] = EXACT_HOSTS, suffixes: list[str] = SUFFIXES) -> Column:
    """The entry that blocks a domain, null if none: exact hosts, then suffixes, then patterns."""
    hit = F.when(domain.isin(exact), domain)
    hit = F.coalesce(hit, F.get(F.filter(parents(domain), lambda p: p.isin(suffixes)), F.lit(0)))
    for pattern, label in PATTERNS:
        hit = F.coalesce(hit, F.when(domain.rlike(pattern), F.lit(label)))
    return hit


def path_depth(url: Column) -> Column:
    """Path segments that aren't empty; 99 for what is no URL."""
    return F.when(host(url) == "", 99).otherwise(F.size(F.filter(F.split(path(url), "/"), lambda s: s != "")))


_SOCIAL = {"facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter", "youtube.com": "youtube"}
_REFUSED = {
    "facebook": "ads business dialog events gaming groups help live login logout marketplace policies privacy share sharer video videos watch".split(),
    "instagram": "about accounts directory explore p reel reels stories tv".split(),
    "twitter": "explore hashtag home i intent login messages notifications search settings share".split(),
    "youtube": "feed playlist results shorts trending watch".split(),
}


def social_profile(url: Column) -> Column:
    """struct(platform, url) of a profile on one of five networks, null for anything else."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r"^m\.", "")
    table = F.create_map(*(F.lit(x) for pair in _SOCIAL.items() for x in pair))
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    one, two, three = (F.get(parts, F.lit(k)) for k in range(3))
    first, n = F.lower(one), F.size(parts)
    ident = F.nullif(F.regexp_extract(query(url), r"(?:^|&)id=([^&]*)", 1), F.lit(""))
    under = lambda site, *rest: F.concat(F.lit(f"https://{site}/"), *rest)
    facebook = (
        F.when(first.isin(_REFUSED["facebook"]), None)
        .when(first == "profile.php", under("www.facebook.com", F.lit("profile.php?id="), ident))
        .when(first == "pages", F.when(n >= 3, under("www.facebook.com", F.lit("pages/"), two, F.lit("/"), three)))
        .when(first.rlike(r"^\d+$"), None)
        .otherwise(under("www.facebook.com", first))
    )
    youtube = F.when(first.isin(_REFUSED["youtube"]), None).when(one.startswith("@"), under("www.youtube.com", one)).when(first.isin("c", "channel", "user") & (n >= 2), under("www.youtube.com", one, F.lit("/"), two))
    by = {
        "facebook": facebook,
        "instagram": F.when(~first.isin(_REFUSED["instagram"]), under("www.instagram.com", one)),
        "linkedin": F.when((one == "company") & (n >= 2), under("www.linkedin.com/company", F.lower(two))),
        "twitter": F.when(~first.isin(_REFUSED["twitter"]) & one.rlike("^[A-Za-z0-9_]{1,50}$"), under("twitter.com", one)),
        "youtube": youtube,
    }
    platform = F.element_at(table, name)
    target = F.coalesce(*(F.when(platform == p, value) for p, value in by.items()))
    return F.when(url.startswith("http") & (n > 0) & target.isNotNull(), F.struct(platform.alias("platform"), target.alias("url")))
