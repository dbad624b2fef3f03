"""Names, keys, addresses, places and crawl errors as native column expressions.

Patterns are written for Java so that they mean what they should for Cyrillic too: case is folded with (?iu), word borders
are spelled out with look-around where letters of any script may stand next to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions import gazetteer
from leadlake.functions.contacts import let

ENTITIES = {"amp": "&", "apos": "'", "bdquo": "„", "gt": ">", "hellip": "…", "laquo": "«", "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "nbsp": " ", "ndash": "–", "quot": '"', "raquo": "»", "rdquo": "”", "rsquo": "’"}


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def clean_search_text(raw: Column) -> Column:
    """Text of a marked-up snippet: block tags are a space, inline tags nothing, entities characters; null if empty."""
    out = F.regexp_replace(raw, r"(?i)<br\s*/?>|</(?:div|h[1-6]|li|p|td|tr)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "")

    def code(text: Column, pattern: str, base: int) -> Column:
        # every second part of the split is the number of an entity
        parts = F.split(F.regexp_replace(text, pattern, "\u0000\u0001$1\u0000"), "\u0000")
        return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\u0001"), _code_point(F.conv(F.substring(p, 2, 9), base, 10).cast("int"))).otherwise(p)), "")

    out = F.when(out.rlike(r"&#\d+;"), code(out, r"&#(\d+);", 10)).otherwise(out)
    out = F.when(out.rlike(r"(?i)&#x[0-9a-f]+;"), code(out, r"(?i)&#x([0-9a-f]+);", 16)).otherwise(out)
    for name, char in sorted(ENTITIES.items(), key=lambda x: x[0] == "amp"):
        out = F.regexp_replace(out, rf"(?i)&{name};", char.replace("\\", "\\\\"))
    return F.nullif(squeezed(out), F.lit(""))


def _code_point(code: Column) -> Column:
    """The character of a code point, from its UTF-8 bytes."""
    hexed = lambda *bytes_: F.concat(*(F.lpad(F.hex(b), 2, "0") for b in bytes_))
    low = lambda shift: (F.shiftright(code, shift).bitwiseAND(F.lit(63))).bitwiseOR(F.lit(128))
    two = hexed(F.shiftright(code, 6).bitwiseOR(F.lit(192)), low(0))
    three = hexed(F.shiftright(code, 12).bitwiseOR(F.lit(224)), low(6), low(0))
    four = hexed(F.shiftright(code, 18).bitwiseOR(F.lit(240)), low(12), low(6), low(0))
    return F.decode(F.unhex(F.when(code < 128, hexed(code)).when(code < 2048, two).when(code < 65536, three).otherwise(four)), "UTF-8")


PREFIXES = (
    "детска градина|детски ясли|детско заведение|целодневна детска градина|обединено детско заведение|дг|цдг|дс|дя|одз|ддуи|дцср|цсри|начално училище|основно училище|средно училище|средно общообразователно училище|профилирана гимназия|"
    "природо-математическа гимназия|гимназия|колеж|ну|оу|су|суе|пмг|пг|пу|ог|многопрофилна болница за активно лечение|болница|мбал|диагностично-консултативен център|дкц|читалище|народно читалище|нчх|хотел|ресторант"
).split("|")


def org_key(name: Column) -> Column:
    """A name as a key: lower case, without quotes and dashes, without the first kind-of-institution prefix that fits."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[«»„“”\"'‘’\\-_]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(plain, "^(?:" + "|".join(PREFIXES) + ") ", ""))  # the first alternative that fits, in the order of the list


def search_query(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def discovery_key(persona: Column, location: Column, keywords: Column) -> Column:
    """A cache key: version, persona, location without its settlement mark, keywords in order."""
    place = F.trim(F.regexp_replace(search_query(location), r"^(гр\.|гр |град )", ""))
    words = F.when(F.trim(F.coalesce(keywords, F.lit(""))) == "", "").otherwise(F.array_join(F.array_sort(F.split(search_query(keywords), " ")), " "))
    return F.concat_ws("|", F.lit("v2"), search_query(persona), place, words)


def location_name(raw: Column) -> Column:
    out = F.regexp_replace(F.lower(raw), "[„“\"'`]", "")
    out = F.regexp_replace(out, r"^\s*(?:oblast|обл(?:аст|\.))\s+", "")
    out = F.regexp_replace(out, r"^\s*(?:с\.|село\s|град\s|гр[.\s])\s*", "")
    return squeezed(out)


_LATIN = dict(zip("абвгдезийклмнопрстуфхъ", "abvgdeziyklmnoprstufha")) | {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ь": "y", "ю": "yu", "я": "ya"}
_SINGLE = "".join(k for k, v in _LATIN.items() if len(v) == 1)


def transliterated(text: Column) -> Column:
    """Cyrillic in Latin letters: single letters in one pass, the others one by one."""
    out = F.translate(F.lower(text), _SINGLE, "".join(_LATIN[c] for c in _SINGLE))
    for letter, latin in _LATIN.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def spellings(text: Column) -> Column:
    """The ways in which people write a name in Latin letters; those of three letters or more."""
    base = transliterated(text)
    ways = [base, F.replace(base, F.lit("ts"), F.lit("c")), F.regexp_replace(base, "^v", "w"), F.replace(F.replace(base, F.lit("ya"), F.lit("ia")), F.lit("yu"), F.lit("iu")), F.regexp_replace(base, "a$", ""), F.replace(base, F.lit("zh"), F.lit("j"))]
    return F.filter(F.array_distinct(F.array(*ways)), lambda w: F.length(w) >= 3)


_NOT_BEFORE, _NOT_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def contains_exact(text: Column, name: Column) -> Column:
    """The name, with no letter or digit on either side."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iu)" + _NOT_BEFORE + r"\Q"), name, F.lit(r"\E" + _NOT_AFTER)))


def contains_stem(text: Column, name: Column) -> Column:
    """As ``contains_exact``, or the name without its last vowel and with up to five letters more."""
    stem = F.regexp_replace(name, "(?iu)[аяоеи]$", "")
    return contains_exact(text, name) | ((F.length(stem) >= 4) & F.regexp_like(text, F.concat(F.lit(r"(?iu)" + _NOT_BEFORE + r"\Q"), stem, F.lit(r"\E\p{L}{0,5}" + _NOT_AFTER))))


def marked_settlements(address: Column) -> Column:
    return F.regexp_extract_all(address, F.lit(r"(?:[(;,\s]|^)(?:община|общ\.|село|с\.|град|гр\.)\s*([ЁА-Я][ёа-я]+(?:\s+[ЁА-Я][ёа-я]+)?)"), F.lit(1))


def acceptable_places(location: Column) -> Column:
    """Lower-case names that satisfy a request: a province admits all its seats, in either script."""
    alias = F.create_map(*(F.lit(x) for pair in gazetteer.ALIASES.items() for x in pair))
    seats = F.create_map(*(x for k, towns in gazetteer.PROVINCES.items() for x in (F.lit(k), F.array(*(F.lit(t.lower()) for t in towns)))))
    key = location_name(location)
    key = F.coalesce(F.element_at(alias, key), key)
    towns = F.coalesce(F.element_at(seats, key), F.array(key))
    return F.array_distinct(F.concat(F.array(key), F.flatten(F.transform(towns, lambda t: F.concat(F.array(t), spellings(t)))), spellings(key)))


def location_signal(text: Column, location: Column, address: bool = False) -> Column:
    """struct(kind, found): "match" if an acceptable place is in the text, else "conflict" with another known one, else "unknown".

    In an address, places behind a settlement mark are trusted before any other.
    """
    hay = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    known = F.array(*(F.lit(t.lower()) for t in gazetteer.TOWNS))
    strict = F.array(*(F.lit(t) for t in gazetteer.TOWNS if len(t) >= 4 and t.lower() not in gazetteer.AMBIGUOUS))
    result = lambda kind, found: F.struct(F.lit(kind).alias("kind"), found.alias("found"))
    none = F.lit(None).cast("string")

    def told(v: Column) -> Column:
        hay, good = v["hay"], v["good"]
        hit = F.get(F.filter(good, lambda p: contains_stem(hay, p)), F.lit(0))
        other = F.get(F.filter(strict, lambda t: ~F.array_contains(good, F.lower(t)) & contains_exact(hay, F.lower(t))), F.lit(0))
        out = F.when((F.trim(hay) == "") | (location_name(location) == ""), result("unknown", none)).when(hit.isNotNull(), result("match", hit))
        if address:
            marked = marked_settlements(F.coalesce(text, F.lit("")))
            fits = F.get(F.filter(marked, lambda m: F.array_contains(good, F.lower(m))), F.lit(0))
            clash = F.get(F.filter(marked, lambda m: F.array_contains(known, F.lower(m)) & ~F.array_contains(good, F.lower(m))), F.lit(0))
            out = out.when(fits.isNotNull(), result("match", F.lower(fits))).when(clash.isNotNull(), result("conflict", clash))
        return out.when(other.isNotNull(), result("conflict", other)).otherwise(result("unknown", none))

    return let(F.struct(hay.alias("hay"), acceptable_places(location).alias("good")), told)


def address_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: F.length(w) >= 3))


def address_similarity(a: Column, b: Column) -> Column:
    """Words in common by the smaller number of words; 0 if either has none."""
    x, y = address_tokens(a), address_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def looks_like_timeline(text: Column) -> Column:
    years = F.size(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])((?:20|19)[0-9]{2})(?![0-9A-Za-z_])"), F.lit(1)))
    return text.rlike(r"(?<![0-9A-Za-z_])(?:20|19)[0-9]{2}[ЁёА-Яа-яA-Za-z]") | ((F.length(text) >= 40) & (years >= 2))


def looks_like_css(text: Column) -> Column:
    return text.rlike(r"(?i)rgba?\(|background|border|font-size|margin|padding|!important|:\s*(?:#[a-f0-9]{3,6}|[0-9]+px)|[{}]")


def looks_like_banner(text: Column) -> Column:
    return text.rlike(r"(?i)^(?:apache|nginx|microsoft-iis)\b|server at .+ port \d+")


_STREET = r"""(?iu)(?:бул|ж\.?к|кв|пл|ул)\.\s*["'«»“”]?\S|(?:blvd?|bul|str|ul)\.\s*["'«»“”]?[A-Za-z0-9_]|\b(?:avenue|boulevard|drive|lane|plaza|road|street)\b|(?:address|headquarters?|адрес)\s*:|(?:office|офис)\s+\d|,\s*no\.\s*\d"""


def address_score(text: Column, context: Column | None = None, company: Column | None = None, domain: Column | None = None) -> Column:
    """Points for a street, a postal code, a length, and what the context says; 0 for timelines, styles and navigation."""
    low = F.lower(F.coalesce(context, F.lit(""))) if context is not None else F.lit("")
    company = F.coalesce(company, F.lit("")) if company is not None else F.lit("")
    base = F.lower(F.split(F.coalesce(domain, F.lit("")), r"\.")[0]) if domain is not None else F.lit("")
    points = lambda test, n: F.when(test, n).otherwise(0)
    named = (company != "") & low.contains(F.lower(company))
    total = points(text.rlike(_STREET), 40) + points(text.rlike(r"(?<!\d)(?:\d{5}|[1-9]\d{3})(?!\d)"), 20) + points(F.length(text) >= 15, 10) + points(low.rlike("address|contact|headquarter|location|office|адрес|контакт|офис|седалище"), 10)
    total = total + F.when(named, 10).when((F.length(base) >= 4) & low.contains(base), 5).otherwise(0)
    bad = looks_like_timeline(text) | text.rlike(r"(?i)rgba?\(|!important|:\s*#[a-f0-9]{3,6}|[{}]") | text.rlike(r"\s·\s")
    return F.when(text.isNull() | (F.length(text) < 5) | bad, 0).otherwise(total)


def clean_address(raw: Column) -> Column:
    """Without label, map-widget buttons, tax numbers and navigation; the first of several forms."""
    out = F.regexp_replace(raw, r"(?iu)^\s*(?:address|адрес)\s*:\s*", "")
    for pattern in (r"(?i)\s+Distance:.*$", r"(?i)\s+(?:(?:get\s+)?directions?|(?:open|show|view)(?:\s+on)?\s+map)\b.*$", r"\s+ИН\s*:\s*[0-9].*$", r"(?i)\s+contacts?\b.*$"):
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(out)
    out = F.when(F.instr(out, " | ") > 1, F.trim(F.substring_index(out, " | ", 1))).otherwise(out)
    return F.trim(F.regexp_replace(out, r"[,;|.]\s*$", ""))


def greedy_distinct(texts: Column, least: float = 0.7) -> Column:
    """Of an array in order, the texts that are not near one already kept."""
    none = F.array().cast("array<string>")
    return F.aggregate(texts, none, lambda kept, t: F.when(F.exists(kept, lambda k: address_similarity(k, t) >= least), kept).otherwise(F.concat(kept, F.array(t))))


ERRORS = (
    ("EMPTY_DOCUMENT", r"reading '(?:content|innertext)'|(?:null|undefined) \(reading"),
    ("UNSUPPORTED_CONTENT_TYPE", r"served content-type .* but only .* are allowed|skipping resource"),
    ("BROWSER_LAUNCH", r"executable doesn'?t exist|browsertype\.launch|playwright install|failed to launch|target closed|browser has been closed"),
    ("DNS_NOT_FOUND", r"eai_again|enotfound|err_name_not_resolved|err_name_resolution_failed|getaddrinfo"),
    ("TLS_ERROR", r"cert_has_expired|depth_zero_self_signed|err_bad_ssl|err_cert_|err_ssl_|err_tls|self.signed certificate|unable to verify the first certificate"),
    ("CONNECTION_REFUSED", r"econnrefused|econnreset|ehostunreach|enetunreach|epipe|err_connection_|socket hang up"),
    ("TIMEOUT", r"timeouterror|navigation timeout|timed? ?out|etimedout|exceeded.*timeout|timeout.*exceeded"),
    ("HTTP_5XX", r"\b5[0-9]{2}\b\s*-\s|bad gateway|gateway time-?out|internal server error|service unavailable"),
)
NOTES = {
    "BROWSER_LAUNCH": "No browser could be started.",
    "CONNECTION_REFUSED": "The site refused to connect.",
    "DNS_NOT_FOUND": "The domain has no address; the site is gone.",
    "TIMEOUT": "The site took longer than the budget.",
    "TLS_ERROR": "The site's certificate is not valid.",
    "UNSUPPORTED_CONTENT_TYPE": "The address serves no web page.",
}


def error_code(message: Column) -> Column:
    """The first class whose pattern is in the message; patterns are in lower case, as the message is by then."""
    return F.coalesce(*(F.when(F.lower(message).rlike(pattern), code) for code, pattern in ERRORS), F.lit("UNKNOWN"))


def is_retryable(message: Column) -> Column:
    """An unknown error may pass; a name that isn't found only where the lookup itself failed."""
    return error_code(message).isin("CONNECTION_REFUSED", "HTTP_5XX", "TIMEOUT", "UNKNOWN") | F.lower(message).contains("eai_again")


def error_note(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair)), code)


def letters(text: Column) -> Column:
    """struct(cyrillic, latin): how many letters of each, by cutting out runs of them: that takes fewer steps than cutting out each other character."""
    count = lambda kind: F.length(text) - F.length(F.regexp_replace(text, kind, ""))
    return F.struct(count(r"[\x{400}-\x{4FF}]+").alias("cyrillic"), count("[A-Za-z]+").alias("latin"))


def _script(n: Column) -> Column:
    share = n["cyrillic"] / F.nullif(n["cyrillic"] + n["latin"], F.lit(0))
    return F.when(n["cyrillic"] + n["latin"] < 200, "mixed").when(share > 0.5, "cyrillic").when(share < 0.25, "latin").otherwise("mixed")


def site_script(text: Column) -> Column:
    """cyrillic, latin or mixed by the share of Cyrillic among letters; under 200 letters it is mixed."""
    return let(letters(text), _script)


def website_language(text: Column) -> Column:
    """bg or en, by the script; a mixed text is bg where Cyrillic letters are as many as Latin ones at least. Letters are counted once a text."""
    language = lambda n: F.when(_script(n) == "cyrillic", "bg").when(_script(n) == "latin", "en").when(n["cyrillic"] >= n["latin"], "bg").otherwise("en")
    return let(letters(text), language)


def email_language(preference: Column, detected: Column) -> Column:
    """The language that mails are written in: bg and en as asked for, "website" as detected; anything else, or nothing, is bg."""
    return F.when(preference.isin("bg", "en"), preference).when(preference == "website", F.coalesce(detected, F.lit("bg"))).otherwise("bg")


def email_language_instruction(language: Column) -> Column:
    """What a prompt says of the language."""
    names = {"bg": "Bulgarian (български език); other languages only in proper nouns, brand names and URLs", "en": "English"}
    return F.concat(F.lit("All text must be written in "), F.when(language == "bg", names["bg"]).otherwise(names["en"]), F.lit("."))


def token_repetition(text: Column, stop: list[str] = []) -> Column:
    """How often the most frequent word of more than three letters occurs."""
    words = F.array_sort(F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(stop) if stop else F.length(w) > 3))
    best = F.aggregate(words, F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("m")), lambda s, w: F.struct(w.alias("w"), F.when(s["w"] == w, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["m"], F.when(s["w"] == w, s["n"] + 1).otherwise(1)).alias("m")))
    return best["m"]


def social_confidence(url: Column, title: Column, snippet: Column, company: Column, domain: Column) -> Column:
    """Points that a social profile belongs to a company; two are enough."""
    bare = lambda x: F.regexp_replace(F.lower(x), "[-_.]", "")
    base = bare(F.split(domain, r"\.")[0])
    slug = bare(F.coalesce(F.get(F.reverse(F.filter(F.split(url, "/"), lambda s: s != "")), F.lit(0)), F.lit("")))
    said = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    name = F.lower(F.trim(F.coalesce(company, F.lit(""))))
    n = F.length(base)
    slug_points = F.when((n < 4) | (F.length(slug) < 2), 0).when(slug == base, 2).when((n >= 6) & (slug.startswith(base) | base.startswith(slug)), 2).when((n >= 7) & (slug.contains(base) | base.contains(slug)), 1).otherwise(0)
    long_words = F.filter(F.split(name, r"\s+"), lambda w: F.length(w) >= 7)
    name_points = F.when((F.length(name) >= 5) & said.contains(name), 1).when(F.exists(long_words, lambda w: said.contains(w)), 1).otherwise(0)
    return slug_points + name_points + F.when(F.lower(F.coalesce(snippet, F.lit(""))).contains(domain), 2).otherwise(0)


def json_answer(raw: Column, schema: str) -> Column:
    """A model's answer as a struct: from the first { to the last }, whatever stands around; null if that is no JSON."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)


def truncated(text: Column, half: int = 4000, mark: str = "\n…\n") -> Column:
    return F.when(F.length(text) <= 2 * half, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half))))


def looks_like_history(text: Column) -> Column:
    signs = (r"(?i)\b(?:began|created|established|founded|incorporated|launched|started)\b", r"(?i)\b(?:in|since)\s+(?:20|19)[0-9]{2}\b", "(?iu)(?:основан|създаден)[аео]", r"(?iu)(?:20|19)[0-9]{2}\s*г", "(?iu)история", r"(?iu)от\s+(?:20|19)[0-9]{2}")
    return (F.length(text) >= 30) & reduce(lambda a, b: a | b, (text.rlike(s) for s in signs))


_NOISE = "ad bg de eood eu fr gmbh gr inc llc ltd mk ood ro rs site uk us web".split()


def name_of_domain(host: Column) -> Column:
    """The first label of a host as a name: tashev-trans.bg is Tashev Trans; null where nothing is left."""
    label = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")[0]
    words = F.filter(F.split(label, "[-_]"), lambda w: (F.length(w) >= 2) & ~w.isin(_NOISE))
    return F.when(F.length(label) >= 3, F.nullif(F.initcap(F.array_join(words, " ")), F.lit("")))


def csv_cell(value: Column) -> Column:
    """Quoted only where a comma, a quote or a line feed makes it needed; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[,\"\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^-._\p{N}\p{L}]", "_")
