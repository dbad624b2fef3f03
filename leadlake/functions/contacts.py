"""E-mail addresses and phone numbers as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[-+%._0-9A-Za-z]+@[-.0-9A-Za-z]+\.[A-Za-z]{2,}"
JUNK_PARTS = "donotreply git@ no-reply noreply open@ recipient@ reply@ sender@ u003e user1@ user2@".split()
JUNK_DOMAINS = "cluster.mongodb.net company.com demo.com domain.com email.com example.bg example.com example.org mail.com mailserver.com mysite.com placeholder.com sampleemail.com sentry.io test.com website.com yourcompany.com yourdomain.com yoursite.com yourwebsite.com".split()
FILE_ENDINGS = "bmp css csv doc docx gif gz htm html ico jpeg jpg js json mp3 mp4 pdf png svg tar tif tiff txt webp xls xlsx xml zip".split()
#: Separators inside a phone number; a line break is none.
_SEP = r"[ \t\-./()]*"
PHONE = rf"(?<![0-9])((?:\+|00)[0-9]{{1,3}}{_SEP}(?: *\d{_SEP}){{6,14}}|0\d{{1,4}}{_SEP}(?:\d{_SEP}){{5,11}})(?![\d\-])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def clipped(mail: Column) -> Column:
    """Cuts a following word in capitals off the last label: x@y.comOUR is x@y.com."""
    return F.regexp_replace(mail, r"^([^@]*@.*\.[^.A-Z]{2,})[A-Z][^.]*$", "$1")


def filter_emails(mails: Column) -> Column:
    """Clipped and distinct, in first-seen order, without placeholders, file names and glued numbers."""

    def good(mail: Column) -> Column:
        low, last = F.lower(mail), F.regexp_extract(mail, r"\.([a-zA-Z0-9]+)$", 1)
        junk = low.rlike("|".join(JUNK_PARTS)) | F.regexp_extract(low, r"^[^@]*@(.*)$", 1).isin(JUNK_DOMAINS) | mail.rlike(r"^\d{4,}[^@]*@") | F.lower(last).isin(FILE_ENDINGS)
        return ~(junk | (last.rlike("[a-z]") & last.rlike("[A-Z]")))

    return F.array_distinct(F.filter(F.transform(mails, clipped), good))


def _raw_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))


def _raw_split(html: Column) -> Column:
    """Addresses whose name and domain have tags or white space between them."""
    joined = F.regexp_extract_all(html, F.lit(r"([-+%._0-9A-Za-z]+@(?:\s|<[^>]*>\s*)+[-.0-9A-Za-z]+\.[A-Za-z]{2,})"), F.lit(1))
    return F.transform(joined, lambda m: F.regexp_replace(m, r"<[^>]*>|\s", ""))


def _bracketed(word: str) -> str:
    return "(?i)" + "|".join(rf"\{a}\s*{word}\s*\{b}" for a, b in ("()", "[]", "{}"))


def _raw_obfuscated(text: Column) -> Column:
    """After undoing "[at]", "(dot)" and spaces around @ and the dots of the domain."""
    out = F.regexp_replace(text, _bracketed("at"), "@")
    out = F.regexp_replace(out, _bracketed("dot"), ".")
    out = F.regexp_replace(out, r"([-+%._0-9A-Za-z])\s+@\s+([0-9A-Za-z])", "$1@$2")
    for _ in range(2):
        out = F.regexp_replace(out, r"(@[-0-9A-Za-z]+(?:\.[-0-9A-Za-z]+)*)\s+\.\s+([A-Za-z]{2,})", "$1.$2")
    return _raw_text(out)


def decoded_cloudflare(code: Column) -> Column:
    """The text behind a protection code: hex, each byte XOR the first one."""
    byte = lambda k: F.conv(F.substring(code, k * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")
    chars = F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int") - 1), lambda k: F.char(byte(k).bitwiseXOR(byte(F.lit(0)))))
    return F.when((F.length(code) >= 4) & code.rlike("^[0-9a-fA-F]+$"), F.array_join(chars, ""))


def _raw_cloudflare(html: Column) -> Column:
    codes = F.regexp_extract_all(html, F.lit(r"(?i)(?:data-cfemail=[\"']|/cdn-cgi/l/email-protection#)([0-9a-f]{4,})"), F.lit(1))
    return F.filter(F.transform(codes, decoded_cloudflare), lambda m: m.rlike(f"^{EMAIL}$"))


def _raw_script(html: Column) -> Column:
    """Addresses put together in scripts from two strings and an @ between them."""
    whole = F.regexp_extract_all(html, F.lit(r"(?i)([\"'][a-z0-9._%+\-]+[\"']\s*\+\s*[\"'](?:@|&#64;)[\"']\s*\+\s*[\"'][a-z0-9.\-]+\.[a-z]{2,}[\"'])"), F.lit(1))
    return F.transform(whole, lambda m: F.regexp_replace(F.replace(m, F.lit("&#64;"), F.lit("@")), r"[\"'+\s]", ""))


def _raw_mailto(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?i)(?:href=[\"']mailto:|data-e?mail=[\"'])\s*([^\"'?]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda m: m.rlike(EMAIL))


def _raw_attribute(html: Column) -> Column:
    values = F.regexp_extract_all(html, F.lit(r"(?i)\s(?:alt|title|aria-label|content|placeholder|value|data-[a-z\-]+)=[\"']([^\"']*@[^\"']*)"), F.lit(1))
    return F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(f"({EMAIL})"), F.lit(1))))


def text_emails(text: Column) -> Column:
    return filter_emails(_raw_text(text))


def mailto_emails(html: Column) -> Column:
    return filter_emails(_raw_mailto(html))


def split_emails(html: Column) -> Column:
    return filter_emails(_raw_split(html))


def obfuscated_emails(text: Column) -> Column:
    return filter_emails(_raw_obfuscated(text))


def cloudflare_emails(html: Column) -> Column:
    return filter_emails(_raw_cloudflare(html))


def attribute_emails(html: Column) -> Column:
    return filter_emails(_raw_attribute(html))


def script_emails(html: Column) -> Column:
    return filter_emails(_raw_script(html))


def merged_emails(text: Column, html: Column) -> Column:
    """All of them in this order, without the twin of an address that only has up to three digits before it."""
    page = F.coalesce(html, F.lit(""))
    inner = F.array_join(F.regexp_extract_all(page, F.lit(r"(?is)<iframe[^>]*\bsrcdoc=\"([^\"]*)\""), F.lit(1)), " ")
    inner = F.replace(F.replace(F.replace(F.replace(inner, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    lists = [_raw_text(text), _raw_mailto(page), _raw_split(page), _raw_obfuscated(text), _raw_cloudflare(page), _raw_attribute(page), _raw_script(page), _raw_text(inner), _raw_mailto(inner)]
    every = filter_emails(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    return let(every, lambda mails: F.filter(mails, lambda m: ~(m.rlike(r"^\d{1,3}[^\d@]") & F.array_contains(mails, F.regexp_replace(m, r"^\d{1,3}", "")))))


def stripped_phone(phone: Column) -> Column:
    return F.regexp_replace(phone, r"[\s\-./()]", "")


def canonical_phone(stripped: Column, country: str = "359") -> Column:
    return F.when(stripped.startswith("+"), stripped).when(stripped.startswith("00" + country), F.concat(F.lit("+"), F.substring(stripped, 3, 99))).when(stripped.startswith("0") & ~stripped.startswith("00"), F.concat(F.lit("+" + country), F.substring(stripped, 2, 99))).otherwise(stripped)


def candidate_phone_key(phone: Column) -> Column:
    """The other rule, for matching candidates: national form."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(phone, r"[\s\-().+]", ""), "^00359", "0"), "^359", "0")


def text_phones(text: Column) -> Column:
    """Numbers as written, one for each canonical form in first-seen order; the international spelling is preferred."""
    shown = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(1)), lambda p: F.trim(F.regexp_replace(p, r"[\s\-./()]+$", "")))

    def good(p: Column) -> Column:
        digits = F.regexp_replace(p, r"\D", "")
        refused = p.rlike(r"^(?:[0-9]{1,2}[-./]){2}[0-9]{2,4}$") | p.rlike(r"(?:[0-9]{1,2}[-./]){2}(?:20|19)[0-9]{2}") | p.rlike(r"^\d+\.\d+$") | digits.rlike(r"^(19|20)\d{2}") | p.rlike(r"^(?:[0-9]+\.){3}[0-9]+$") | (p.rlike(r"^00\d") & p.rlike(r"\d\.\d{3}(\D|$)"))
        return F.length(digits).between(7, 15) & ~refused & stripped_phone(p).rlike(r"^[+0]")

    form = lambda p: canonical_phone(stripped_phone(p))
    whole = lambda p: stripped_phone(p).startswith("+")

    def best(kept: Column, key: Column) -> Column:
        own = F.filter(kept, lambda p: form(p) == key)
        return F.coalesce(F.get(F.filter(own, whole), F.lit(0)), F.get(own, F.lit(0)))

    return let(F.filter(shown, good), lambda kept: F.transform(F.array_distinct(F.transform(kept, form)), lambda key: best(kept, key)))
