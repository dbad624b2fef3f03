"""From pages to site profiles: names, descriptions, contacts, links, page types and the completion score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import contacts, text, urls
from leadlake.functions.html import html_facts, meta

CONTACT_PATHS = ("/contact", "/contact-us", "/contacts", "/kontakti", "/контакти", "/kontakt")
TEAM_PATHS = tuple("/" + p for p in "team about about-us aboutus leadership management people staff ekip za-nas za-firmata екип ръководство управление собственици за-нас за-фирмата".split())
OTHER_PATHS = ("/services", "/history")
SAVED_PATHS = tuple(sorted({*CONTACT_PATHS, *TEAM_PATHS, *OTHER_PATHS, "/service"}))
#: Page titles, entry pages, languages and their codes: nothing that a company is called by.
GENERIC_NAMES = (
    "404|access|access denied|account|admin|admin login|attention required|auth|authentication|bot check|client area|client portal|customer area|customer portal|dashboard|ddos protection|dealer area|dealer portal|forgot password|forgot your password|home|home page|homepage|human verification|index|index page|just a moment|"
    "landing|landing page|log in|login|main|main page|member area|my account|new page|not found|please wait|portal|register|reset password|secure login|security check|sign in|sign up|signin|start|start page|untitled|untitled document|user login|user portal|welcome|вход|влизане|добре дошли|добре дошли!|начало|начална страница|регистрация|"
    "bulgarian|croatian|czech|danish|deutsch|dutch|english|español|finnish|français|french|german|greek|hungarian|italian|italiano|macedonian|norwegian|polish|portuguese|português|romanian|română|russian|serbian|slovak|slovenian|spanish|swedish|turkish|ukrainian|"
    "bg|cs|da|de|el|en|es|fi|fr|hr|hu|it|mk|nl|no|pl|pt|ro|ru|sk|sl|sr|sv|tr|uk"
).split("|")
_LANGUAGES = "|".join(n for n in GENERIC_NAMES if n in "bulgarian croatian czech danish deutsch dutch english español finnish français french german greek hungarian italian italiano macedonian norwegian polish portuguese português romanian română russian serbian slovak slovenian spanish swedish turkish ukrainian".split())
_SWITCH = rf"^(?:[a-z]{{2,3}} (?:lang|language|page|site|version)|(?:{_LANGUAGES}) version|(?:change|choose|pick|select|switch) lang(?:uage)?|language (?:menu|options?|picker|select(?:ion|or)?|switch(?:er)?|toggle))$"
_BLOCKED_TITLE = r"^(?:403 forbidden|404.*|access denied|attention required|bot check|ddos protection|human verification|just a moment.*|please wait|security check) *\.{0,3}$"
WEIGHTS = {"name": 20, "description": 20, "emails": 15, "location": 10, "phones": 10, "services": 10, "history": 5, "social": 5, "team": 5}
BOTS = (
    ("cloudflare challenge", r"challenges\.cloudflare\.com"), ("cloudflare moment", r"<title[^>]*>\s*just a moment"), ("cloudflare script", "enable javascript and cookies to continue"), ("cloudflare check", "checking if the site connection is secure"),
    ("cloudflare ray", r"ray id:\s*[0-9a-f]{16}"), ("cloudflare wrapper", r"class=\"cf-wrapper\"|cf_chl_opt\s*="), ("ddos guard", r"ddos-guard\.net"), ("human check", "verify you are human"),
    ("human check title", r"<title[^>]*>\s*(?:bot check|human verification|security check)\s*</title>"), ("access denied", r"<title[^>]*>\s*access denied\s*</title>"), ("forbidden", r"<title[^>]*>\s*403\s+forbidden\s*</title>"),
)
LOGIN_WORDS = "login|log in|sign in|signin|sign-in|вход|парола|потребител|username|password|forgot password".split("|")


def page_facts(pages: DataFrame, unclosed: bool = True) -> DataFrame:
    """``pages`` (page_id, url, html) with ``facts``, parsed once a page; ``unclosed`` as in ``html_facts``."""
    return pages.withColumn("facts", html_facts(F.col("html"), unclosed))


def is_generic_name(name: Column) -> Column:
    """Whether a name is a page's title, an entry page, a language or a language switch; null is none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[-_]+", " "), r"\s+", " "))
    return plain.isin(GENERIC_NAMES) | plain.rlike(_SWITCH) | plain.rlike(_BLOCKED_TITLE)


def company_name(facts: Column, url: Column) -> Column:
    """og:site_name, else a part of the title, else the alternative text of a logo, else the domain."""
    good = lambda s: (s != "") & ~is_generic_name(s)
    site = meta(facts, "og:site_name")
    title = F.get(F.filter(F.transform(F.split(facts["title"], r"[|\-–]"), lambda x: F.trim(x)), good), F.lit(0))
    alts = F.transform(F.filter(facts["images"], lambda i: i["logo"] | F.lower(i["marks"]).contains("logo") | i["header"]), lambda i: F.trim(F.split(i["alt"], r"[|\-–]")[0]))
    logo = F.get(F.filter(alts, lambda a: good(a) & F.length(a).between(2, 80) & ~a.rlike(r"(?i)^(?:banner|icon|image|img|(?:company |header |site )?logo)$|\s(?:icon|logo)$|\.(?:gif|ico|jpg|png|svg|webp)$")), F.lit(0))
    return F.coalesce(F.when(good(site), site), title, logo, text.name_of_domain(urls.bare_host(url)))


def description(facts: Column) -> Column:
    """The first that is long enough of meta description, og:description and a paragraph."""
    own = lambda key: F.when(F.length(meta(facts, key)) > 20, meta(facts, key))
    return F.coalesce(own("description"), own("og:description"), F.get(F.filter(facts["paragraphs"], lambda p: F.length(p) > 60), F.lit(0)))


def _resolved(href: Column, base: Column) -> Column:
    href = F.regexp_replace(F.trim(href), "#.*$", "")
    folder = F.regexp_replace(base, r"[^/]*$", "")
    return (
        F.when(href == "", None).when(href.rlike(r"(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href)).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(href.startswith("/"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1), href)).otherwise(F.concat(F.when(folder.endswith("://"), F.concat(base, F.lit("/"))).otherwise(folder), href))
    )


def url_queue(facts: Column, base: Column) -> Column:
    """At most 18 addresses to visit next: found contact, team and navigation links, then guesses where none was found."""

    def links(keep, most: int) -> Column:
        found = F.transform(F.filter(facts["anchors"], keep), lambda a: _resolved(a["href"], base))
        own = F.filter(found, lambda u: u.isNotNull() & u.startswith(base) & (u != base) & (u != F.concat(base, F.lit("/"))))
        return F.slice(F.array_distinct(own), 1, most)

    either = lambda pattern: lambda a: a["href"].rlike(pattern) | a["text"].rlike(pattern)
    contact = links(either("(?iu)contact|kontakt|контакт"), 3)
    team = links(either(r"(?iu)\b(?:about|ekip|leadership|management|people|staff|team)\b|за[\s\-](?:нас|фирмата)|екип|ръководство|управлени[ея]|собственици"), 5)
    nav = links(lambda a: a["nav"] & ~a["href"].rlike("[?&]lang="), 10)
    guess = lambda paths: F.array(*(F.concat(base, F.lit(p)) for p in paths))
    none = F.array().cast("array<string>")
    every = F.concat(contact, team, nav, F.when(F.size(contact) == 0, guess(CONTACT_PATHS)).otherwise(none), F.when(F.size(team) == 0, guess(TEAM_PATHS)).otherwise(none), guess(OTHER_PATHS))
    return F.slice(F.array_distinct(F.transform(every, lambda u: F.regexp_replace(u, "(?<=.)/$", ""))), 1, 18)


def keeps_html(url: Column) -> Column:
    """Whether a page's markup is worth keeping, by its path."""
    out = F.lit(False)
    for path in SAVED_PATHS:
        out = out | url.contains(path)
    return out


def needs_login(facts: Column) -> Column:
    low = F.lower(facts["text"])
    says = F.lit(False)
    for word in LOGIN_WORDS:
        says = says | low.contains(word)
    return facts["password"] & says & (F.length(text.squeezed(facts["text"])) < 1500)


def bot_protection(html: Column, body: Column | None = None) -> Column:
    """The first sign of a human check in markup or text, '' if none."""
    seen = F.concat_ws("\n", html, body) if body is not None else html
    return F.coalesce(*(F.when(seen.rlike("(?is)" + pattern), name) for name, pattern in BOTS), F.lit(""))


def bot_protected(pages: DataFrame) -> DataFrame:
    """(company_id, indicator): of each company the sign on its first page (least page_id) that has one; companies without aren't given."""
    seen = pages.select("company_id", "page_id", bot_protection(F.col("html"), F.col("text")).alias("indicator")).where("indicator <> ''")
    return seen.groupBy("company_id").agg(F.min_by("indicator", "page_id").alias("indicator"))


def needs_browser(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """The companies whose plain pages (company_id, text) hold fewer than 200 characters in all, or that have no page."""
    size = pages.groupBy("company_id").agg(F.sum(F.length(F.trim("text"))).alias("_chars"))
    return companies.join(size.where("_chars >= 200"), "company_id", "left_anti")


def social_links(facts: Column) -> Column:
    """platform: profile, the first found of each."""
    refs = F.concat(F.transform(facts["anchors"], lambda a: a["href"]), F.transform(facts["links"], lambda x: x["href"]), F.filter(F.array(meta(facts, "og:url"), meta(facts, "article:publisher")), lambda x: x.isNotNull()))
    found = F.filter(F.transform(refs, urls.social_profile), lambda s: s.isNotNull())

    def first(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda s: s["platform"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(found, lambda s: s["platform"] == n), F.lit(0))["url"]))

    return contacts.let(found, first)


def logo_urls(facts: Column, base: Column) -> Column:
    """At most five, by how surely the image is a logo."""
    of = lambda keep: F.transform(F.filter(facts["images"], keep), lambda i: i["src"])
    shared = F.filter(F.array(meta(facts, "og:image"), meta(facts, "twitter:image")), lambda x: x.isNotNull())
    every = F.concat(of(lambda i: F.lower(i["marks"]).contains("logo")), of(lambda i: i["logo"]), of(lambda i: i["header"]), shared, of(lambda i: i["src"].endswith(".svg")))
    whole = F.transform(F.filter(every, lambda s: ~s.startswith("data:")), lambda s: _resolved(s, base))
    return F.slice(F.array_distinct(F.filter(whole, lambda u: u.isNotNull() & ~u.rlike(r"(?i)blank\.|lazyload|loading\.gif|no-?image|ph\.png|placeholder|spacer\."))), 1, 5)


def logo_name(url: Column) -> Column:
    """A name from a logo's file name, null if it says none."""
    stem = F.regexp_replace(F.regexp_extract(urls.path(url), r"([^/]*)$", 1), r"(?i)\.(?:avif|gif|jpe?g|png|svg|webp)$", "")
    stem = text.squeezed(F.regexp_replace(F.regexp_replace(stem, "[-_]+", " "), r"(?i)\b(?:banner|brand|header|icon|image|img|logo|site)\b", ""))
    return F.when(F.length(stem).between(2, 50) & stem.rlike(r"[A-Za-z\x{400}-\x{4FF}]"), F.initcap(stem))


def postal_location(facts: Column) -> Column:
    """An address element, else one in JSON-LD, else a line of text with a street in it and the line after it."""
    fine = lambda a: (F.length(a) >= 5) & ~text.looks_like_css(a) & ~text.looks_like_timeline(a) & ~text.looks_like_banner(a)
    element = F.get(F.filter(F.transform(facts["addresses"], text.clean_address), fine), F.lit(0))
    json = F.transform(facts["jsonld"], lambda j: F.concat_ws(", ", F.nullif(F.regexp_extract(j, r'"streetAddress"\s*:\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(j, r'"postalCode"\s*:\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(j, r'"addressLocality"\s*:\s*"([^"]*)"', 1), F.lit(""))))
    lines = F.filter(F.transform(F.split(facts["text"], "\n"), lambda x: F.trim(x)), lambda x: x != "")
    street = F.transform(F.filter(lines, lambda x: (text.address_score(x) >= 40) & (F.length(x) < 200) & fine(x)), text.clean_address)
    return F.coalesce(element, F.get(F.filter(json, lambda j: j != ""), F.lit(0)), F.get(street, F.lit(0)))


JUNK_SERVICE = r"(?i)^(?:debug|demo|error[:\s!.…]*|example|loading[.…]*|lorem(?: ipsum)?|n/a|nan|null|placeholder|sample|test\s*\d*|undefined|warning[:\s!.…]*)$"
SERVICE_WORDS = r"(?iu)capabilit|expertise|our work|service|solution|speciali[sz]|what we (?:build|do|offer|provide)|предлага|произвежда|решени|специализира|услуг"


def services(facts: Column) -> Column:
    """Items of lists under headings about services, then titles of service blocks; at most 20."""
    fine = lambda t: t.isNotNull() & F.length(t).between(3, 119) & ~t.rlike(JUNK_SERVICE) & ~t.rlike(r"[?:]\s*$") & ~t.rlike(r"(?iu)^(?:why (?:choose|pick|us|we)|защо|предимства)")
    listed = F.flatten(F.transform(F.filter(facts["lists"], lambda x: x["heading"].rlike(SERVICE_WORDS)), lambda x: x["items"]))
    titled = F.transform(F.filter(facts["blocks"], lambda b: b["classes"].rlike("capability|feature|offering|service|solution|(?:card|item|tile)-title")), lambda b: b["title"])
    marked = F.array_distinct(F.filter(F.concat(listed, F.filter(titled, lambda t: ~t.rlike(SERVICE_WORDS))), fine))
    return contacts.let(marked, lambda found: F.when(F.size(found) > 0, F.slice(found, 1, 20)).otherwise(services_in_text(facts["text"])))


_SERVICE_HEAD = r"(?iu)^(?:our |нашите )?(?:capabilities|expertise|services|solutions|what we (?:do|offer|provide)|дейности|предлагаме|решения|услуги)\s*:?$"
_SERVICE_STOP = r"(?iu)^(?:about|our |the )?\s*(?:about us|clients|contacts?|contact us|history|news|partners|projects|references|team|testimonials|за нас|клиенти|контакти|новини|партньори|проекти|екип)\s*:?$"
_NAVIGATION = r"(?i)^(?:about|blog|careers?|company|contact|get\s*started|home|learn\s*more|login|people|portfolio|read\s*more|sign\s*in|staff|team)$"


def services_in_text(body: Column) -> Column:
    """Short lines between a line that heads services and one that heads something else: two at least, at most 15."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    fine = lambda x: F.length(x).between(3, 80) & ~x.rlike(r"[.!?]$|^\d+$") & ~x.rlike(_NAVIGATION) & ~x.rlike(JUNK_SERVICE) & ~x.rlike(r"[?:]\s*$")
    empty = F.struct(F.lit(0).alias("on"), F.array().cast("array<string>").alias("items"))

    def step(s: Column, x: Column) -> Column:
        head, stop = x.rlike(_SERVICE_HEAD), x.rlike(_SERVICE_STOP)
        on = F.when(s["on"] == 2, 2).when(head, 1).when((s["on"] == 1) & stop, 2).otherwise(s["on"])
        take = (s["on"] == 1) & ~head & ~stop & fine(x) & (F.size(s["items"]) < 15)
        return F.struct(on.alias("on"), F.when(take, F.concat(s["items"], F.array(x))).otherwise(s["items"]).alias("items"))

    found = F.aggregate(lines, empty, step)["items"]
    return contacts.let(found, lambda v: F.when(F.size(v) >= 2, v).otherwise(F.array().cast("array<string>")))


PERSON = r"^\p{Lu}[\p{Ll}'’\-]+(?:\s+\p{Lu}[\p{Ll}'’\-]+){1,3}$"
_ROLE = r"(?:(?:account|assistant|business|chief|co|commercial|deputy|development|executive|finance|financial|general|hr|it|managing|marketing|office|operations|procurement|product|production|project|quality|regional|sales|senior|technical|изпълнителен|търговски|технически|финансов|генерален|главен|офис)[\s\-]+)*(?:accountant|administrator|bookkeeper|ceo|cfo|chairman|coo|cto|designer|developer|director|engineer|founder|head of [^,]+|lawyer|manager|officer|owner|partner|president|representative|vice president|vp|управител|директор|собственик|мениджър|счетоводител|инженер|адвокат|председател|основател|партньор|представител|съдружник|съсобственик|съуправител|финансист)"
ROLES = rf"(?iu)^{_ROLE}\b"


def team(facts: Column) -> Column:
    """struct(name, position) of people: in cards and headings followed by a role, and in lines "ROLE: NAME" or "NAME - ROLE"; at most 50."""
    person = lambda t: t.rlike(PERSON) & ~t.rlike(ROLES)
    member = lambda name, role: F.struct(name.alias("name"), role.alias("position"))
    role_of = lambda after: F.when(after.rlike(ROLES), F.regexp_extract(after, r"^([^,.;|]{2,60})", 1))
    headed = F.transform(F.filter(facts["headings"], lambda h: person(h["text"]) & h["after"].rlike(ROLES)), lambda h: member(h["text"], role_of(h["after"])))
    carded = F.transform(F.filter(facts["blocks"], lambda b: b["title"].isNotNull() & b["classes"].rlike("member|person|team") & person(b["title"])), lambda b: member(b["title"], F.lit(None).cast("string")))
    lines = F.transform(F.split(facts["text"], "\n"), lambda x: F.trim(x))
    half = lambda x, k: F.trim(F.regexp_extract(x, r"^(.{2,60}?)(?:\s*:\s*|\s+[-–—]\s*|\s*[–—]\s*)(.{2,60})$", k))
    paired = F.filter(F.transform(lines, lambda x: F.struct(half(x, 1).alias("a"), half(x, 2).alias("b"))), lambda x: x["a"] != "")
    turned = F.transform(paired, lambda x: F.when(x["a"].rlike(ROLES) & person(x["b"]), member(x["b"], x["a"])).when(x["b"].rlike(ROLES) & person(x["a"]), member(x["a"], x["b"])))
    said = F.filter(turned, lambda m: m.isNotNull())

    def first(every: Column) -> Column:
        names = F.array_distinct(F.transform(every, lambda m: m["name"]))
        return F.slice(F.transform(names, lambda n: F.get(F.filter(every, lambda m: m["name"] == n), F.lit(0))), 1, 50)

    return contacts.let(F.concat(headed, said, carded), first)


_ROLE_IN = rf"(?iu)(?:^|[\s,.:;(\-])({_ROLE})(?:[\s,.:;)\-]|$)"


def mailed_team(facts: Column) -> Column:
    """struct(name, position, email) of mail links that stand beside a role; the name is one beside it, if there is any."""
    named = lambda text_: F.get(F.filter(F.regexp_extract_all(text_, F.lit(r"(\p{Lu}\p{Ll}+(?:\s\p{Lu}\p{Ll}+)+)"), F.lit(1)), lambda n: n.rlike(PERSON) & ~n.rlike(ROLES)), F.lit(0))
    told = F.filter(facts["mails"], lambda m: m["email"].rlike(f"^{contacts.EMAIL}$") & m["context"].rlike(_ROLE_IN))
    return F.transform(told, lambda m: F.struct(named(m["context"]).alias("name"), F.regexp_extract(m["context"], _ROLE_IN, 1).alias("position"), m["email"].alias("email")))


def history(facts: Column, url: Column) -> Column:
    """What follows a heading about the past, or on an about page a paragraph that tells of it."""
    heads = F.filter(facts["headings"], lambda h: (h["level"] <= 4) & F.lower(h["text"]).rlike("(?iu)establish|found(?:ed|ing)|histor|journey|mileston|our story|(?:brand|company) story|timeline|история|основаване") & text.looks_like_history(h["after"]))
    about = url.rlike("(?iu)/(?:about(?:-us)?|story|history|история|за-нас)(?:$|[#/?])")
    told = F.filter(F.transform(facts["paragraphs"], text.squeezed), text.looks_like_history)
    return F.coalesce(F.get(heads, F.lit(0))["after"], F.when(about, F.get(told, F.lit(0))))


def completion_score(**has: Column) -> Column:
    """Points for the fields that are there; ``has`` names a condition for each of WEIGHTS."""
    return sum((F.when(F.coalesce(has[k], F.lit(False)), w).otherwise(0) for k, w in WEIGHTS.items()), F.lit(0))


_SIGNALS = {
    "muni": ("администрация на", "кмет ", "кметство ", "община ", "общинска ", "общински съвет", "официален сайт на община"),
    "registry": ("заповед №", "наредба №", "по реда на", "по чл.", "регистрирани", "регистри на", "регистър на", "списък на"),
    "directory": ("директория", "каталог", "намерени резулт", "покажи повече", "пълен списък", "сортирай", "филтрирай"),
    "news": ("автор:", "категория:", "коментари (", "предишна статия", "прочети повече", "публикувано на ", "публикувано:", "следваща статия", "споделяне", "тагове:"),
}
_MUNI_PATHS = "administracia byudzhet deynost detskata-gradini detski-gradini ekologia kmet kmetstvo kultura naredbi obrazovanie obshinskisavet obshtestveni obshtinska obstinskisavet registri sotsialni sport uchilishta uslugi zdraveopazvane".split()
_NEWS_PATHS = "aktualno arhiv blog news novini press publikacii sobitivia statii".split()


def _hits(where: Column, words) -> Column:
    return sum((F.when(where.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def _ranked(scores: list[tuple[str, Column]], least: int | Column) -> Column:
    """struct(type, score): the highest; of equals the first in the list, which stands in the order in which rules add them."""
    rows = F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("ord"), F.lit(n).alias("type")) for k, (n, s) in enumerate(scores)))
    best = F.array_max(rows)
    return F.struct(F.when((best["score"] >= least) & (best["score"] > 0), best["type"]).otherwise("UNKNOWN").alias("type"), best["score"].alias("score"))


def type_from_meta(url: Column, title: Column, snippet: Column, least: int | Column = 30) -> Column:
    """struct(type, score) by address, title and snippet alone."""
    host, path = urls.bare_host(url), F.lower(urls.path(url))
    said = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    points = lambda test, n: F.when(test, n).otherwise(0)
    under = lambda words: _hits(path, [f"/{w}" for w in words]) > 0
    listed = points(_hits(said, _SIGNALS["registry"]) > 0, 40)
    registry = points(host.rlike("regisar|registar|registrar"), 60) + listed
    directory = points(host.rlike("catalog|directory|katalog|kataloq|portal"), 60) + points(_hits(said, _SIGNALS["directory"]) > 0, 50) + points(text.token_repetition(said) >= 4, 30)
    news = points(under(_NEWS_PATHS), 50) + points(_hits(said, _SIGNALS["news"]) > 0, 40)
    muni = points(under(_MUNI_PATHS), 50) + _hits(said, _SIGNALS["muni"]) * 30 + F.when(listed > 0, 20).otherwise(0)
    target = points(registry + directory + news + muni == 0, 20)
    return _ranked([("OFFICIAL_REGISTRY", registry), ("DIRECTORY_OR_PORTAL", directory), ("SOCIAL_PAGE", points(urls.is_platform(url), 100)), ("NEWS_ARTICLE", news), ("MUNICIPALITY_PAGE", muni), ("TARGET_ORGANIZATION", target)], least)


def type_from_content(facts: Column, least: int | Column = 30) -> Column:
    """struct(type, score) by what the page holds."""
    body = F.lower(text.squeezed(facts["text"]))
    title, heads = F.lower(F.coalesce(facts["title"], F.lit(""))), F.filter(facts["headings"], lambda h: h["level"] == 1)
    head = F.concat_ws(" ", title, F.lower(F.get(heads, F.lit(0))["text"]))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    distinct = lambda pattern: F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1))))
    mails, phones = distinct(contacts.EMAIL), distinct(r"(?:0[7-9][0-9]{2}|(?:\+|00)359[0-9]{2})(?:[-.\s]?[0-9]{3}){2}|[0-9]{3,5}[-\s][0-9]{3,6}")
    many, some = (mails >= 5) | (phones >= 5), (mails >= 2) & (phones >= 2)
    n_muni = _hits(body, _SIGNALS["muni"])
    muni = points(_hits(head, _SIGNALS["muni"]) > 0, 70) + F.when(n_muni >= 2, n_muni * 20).otherwise(0)
    registry = points(_hits(title, _SIGNALS["registry"]) > 0, 50) + points(_hits(body, _SIGNALS["registry"]) > 0, 40)
    directory = F.when(many, 60).when(some, 30).otherwise(0) + points(_hits(body, _SIGNALS["directory"]) > 0, 50) + F.when((facts["rows"] >= 8) | (facts["items"] >= 10), 40).when((facts["rows"] >= 4) | (facts["items"] >= 4), 20).otherwise(0) + points(facts["paginated"], 30)
    target = points(~many & ~some & ((mails == 1) | ((mails == 0) & (phones == 1))), 30) + points((F.size(heads) == 1) & facts["about"], 40)
    news = points(facts["dated"] & facts["article"], 60)
    return _ranked([("MUNICIPALITY_PAGE", muni), ("OFFICIAL_REGISTRY", registry), ("DIRECTORY_OR_PORTAL", directory), ("TARGET_ORGANIZATION", target), ("NEWS_ARTICLE", news)], least)


def organisations(facts: Column) -> Column:
    """Names of organisations on a list page: from headings, else from lists of which two fifths look like names, else from links."""
    like = r"(?iu)^(?:(?:дг|оу|су|ну|пг|детска градина|училище|гимназия|хотел|ресторант|болница|читалище)\b.*|.*\b(?:academy|clinic|college|company|gmbh|hospital|hotel|inc|institute|kindergarten|llc|ltd|restaurant|school|university|еоод|оод|ад))$"
    fine = lambda n: F.length(n).between(4, 120) & n.rlike(like)
    heads = F.filter(F.transform(facts["headings"], lambda h: h["text"]), fine)
    lists = F.filter(facts["lists"], lambda x: (F.size(x["items"]) > 0) & (F.size(F.filter(x["items"], fine)) >= 0.4 * F.size(x["items"])))
    items = F.filter(F.flatten(F.transform(lists, lambda x: x["items"])), fine)
    linked = F.filter(F.transform(facts["anchors"], lambda a: text.squeezed(a["text"])), fine)
    found = F.array_distinct(F.concat(heads, items))
    return F.when(F.size(found) > 0, found).otherwise(F.array_distinct(linked))


def site_profiles(pages: DataFrame) -> DataFrame:
    """One row for each host: what its pages tell, the first page (smallest page_id) being the homepage.

    Parsing is one narrow pass; then the few facts a profile needs, not the markup, are shuffled once by host.
    """
    f, url = F.col("facts"), F.col("url")
    one = page_facts(pages.select("page_id", "url", "html").where("html is not null and url is not null"))
    told = one.select(
        urls.bare_host(url).alias("host"), "page_id", company_name(f, url).alias("name"), description(f).alias("description"), postal_location(f).alias("location"), contacts.merged_emails(f["text"], F.col("html")).alias("emails"),
        contacts.text_phones(f["text"]).alias("phones"), services(f).alias("services"), F.size(team(f)).alias("team"), history(f, url).alias("history"), social_links(f).alias("social"), type_from_content(f)["type"].alias("page_type"),
    )
    first = lambda c: F.min_by(c, "page_id")
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.col(c).alias("v")))), lambda x: x["v"])))
    found = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page_id")))
    sites = told.groupBy("host").agg(
        F.count("*").alias("pages"), first("name").alias("name"), first("description").alias("description"), found("location").alias("location"), union("emails").alias("emails"), union("phones").alias("phones"), union("services").alias("services"),
        F.sum("team").alias("team"), found("history").alias("history"), F.max(F.size("social")).alias("social"), first("page_type").alias("page_type"),
    )
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    score = completion_score(name=full("name"), description=full("description"), location=full("location"), emails=F.size("emails") > 0, phones=F.size("phones") > 0, services=F.size("services") > 0, team=F.col("team") > 0, history=full("history"), social=F.col("social") > 0)
    return sites.withColumn("completion_score", score)
