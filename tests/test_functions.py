"""Column functions on the cases where they are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from leadlake.functions import contacts, text, urls


def values(spark, make, cases, kind="string"):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], f"k int, x {kind}")
    return [r[1] for r in frame.select("k", make(F.col("x")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://WWW.Acme.BG:80/a/?utm_source=x&b=2&ref=q#f", "https://acme.bg/a?b=2"), ("https://acme.bg", "https://acme.bg/"), ("https://acme.bg:8443/", "https://acme.bg:8443/"), (" Not A Url/ ", "not a url"), ("https://acme.bg/?gclid=1", "https://acme.bg/"), ("https://acme.bg/A?x", "https://acme.bg/A?x"),
        (None, None),
    ],
)
def test_normalized_url(spark, raw, want):
    assert values(spark, urls.normalized_url, [raw]) == [want]


def test_hosts_and_platforms(spark):
    cases = ["https://www.m.facebook.com/x", "bg.linkedin.com", "a.b.google.com", "acme.bg", "https://x.com/"]
    assert values(spark, urls.is_platform, cases) == [True, True, False, False, True]
    assert values(spark, urls.crawlability, cases) == ["SOCIAL_PROFILE", "NON_CRAWLABLE_PLATFORM", "CRAWLABLE", "CRAWLABLE", "NON_CRAWLABLE_PLATFORM"]
    assert values(spark, urls.path_depth, ["https://a.bg//x/y/", "https://a.bg", "a.bg/x"]) == [2, 0, 99]
    assert values(spark, urls.blocklist_hit, ["varna.bg", "dg.varna.bg", "m.olx.bg", "ruo-x.bg", "x.government.bg"]) == ["varna.bg", None, "olx.bg", "regional education office", "government subdomain"]


PHONES = [
    ("0893 / 35 41 42", ["0893 / 35 41 42"]), ("0877/86-62-18", ["0877/86-62-18"]), ("0875 300 000\n   14", ["0875 300 000"]), ("0875300000 and +359 875 300 000", ["+359 875 300 000"]), ("01.02.2021 and 12/03/99", []), ("226.5000 192.168.10.10", []), ("2010 12345678", []), ("00359 2 981 0000", ["00359 2 981 0000"]),
    ("01/ 14.01.2021", []), ("001-2.077-1234567", []), ("", []),
]


@pytest.mark.parametrize("raw, want", PHONES)
def test_phones(spark, raw, want):
    assert values(spark, contacts.text_phones, [raw]) == [want]


def test_emails(spark):
    cases = ["office@acme.comOUR team", "logo@2x.png a@b.bg a@b.bg", "noreply@acme.bg", "9950user@acme.bg", "x@example.com y@sub.example.com", "a@b.xY"]
    assert values(spark, contacts.text_emails, cases) == [["office@acme.com"], ["a@b.bg"], [], [], ["y@sub.example.com"], []]
    assert values(spark, contacts.split_emails, ["contacts@<br />acme.bg", "info@<!-- --><span>firm.bg</span>"]) == [["contacts@acme.bg"], ["info@firm.bg"]]
    code = lambda mail, key=0x42: f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in mail)
    assert values(spark, contacts.decoded_cloudflare, [code("a.b@firm.bg"), "zz", "42"]) == ["a.b@firm.bg", None, None]
    page = f'<a data-cfemail="{code("cf@firm.bg")}"></a><a href="mailto:m@firm.bg?x">m</a><script>"js" + "@" + "firm.bg"</script><img alt="alt@firm.bg"><iframe srcdoc="&lt;p&gt;in@firm.bg&lt;/p&gt;"></iframe>'
    frame = spark.createDataFrame([("t@firm.bg 12m@firm.bg", page)], "t string, h string")
    assert frame.select(contacts.merged_emails(F.col("t"), F.col("h"))).first()[0] == ["t@firm.bg", "m@firm.bg", "cf@firm.bg", "alt@firm.bg", "js@firm.bg", "in@firm.bg"]


def test_names_and_places(spark):
    assert values(spark, text.org_key, ["ДГ „Слънце“", "Хотел  Мир-2", "Acme"]) == ["слънце", "мир 2", "acme"]
    assert values(spark, text.location_name, ["гр. Враца", "област София", "обл. Варна", "с. Бяла"]) == ["враца", "софия", "варна", "бяла"]
    assert "tsarevo" in values(spark, text.spellings, ["Царево"])[0] and "carevo" in values(spark, text.spellings, ["Царево"])[0]
    signal = lambda t, p, **k: spark.createDataFrame([(t, p)], "t string, p string").select(text.location_signal(F.col("t"), F.col("p"), **k).alias("s")).first().s
    assert signal("почивка край Рила", "София").kind == "unknown"
    assert tuple(signal("ул. Васил Левски, гр. Русе", "Варна", address=True)) == ("conflict", "Русе")
    assert tuple(signal("гр. Рила, ул. 5", "София", address=True)) == ("conflict", "Рила")
    assert signal("Дупница", "област Кюстендил").kind == "match"


def test_addresses(spark):
    assert values(spark, text.clean_address, ["Адрес: ул. Х 5 | София | BG", "ul. Y 3 Distance: 4 km", "ул. Z 1 ИН: 123 x", "Main St 4,"]) == ["ул. Х 5", "ul. Y 3", "ул. Z 1", "Main St 4"]
    kept = spark.createDataFrame([(["ul. Shipka 12 Sofia", "Shipka 12, Sofia", "bul. Vitosha 1"],)], "x array<string>").select(text.greedy_distinct(F.col("x"))).first()[0]
    assert kept == ["ul. Shipka 12 Sofia", "bul. Vitosha 1"]
    assert values(spark, text.looks_like_timeline, ["2008Construction", "x 1999 y 2003 " + "z" * 40, "1784 Sofia"]) == [True, True, False]


def test_small_ones(spark):
    assert values(spark, text.csv_cell, ['a"b', "a,b", "a\nb", "a\rb", None]) == ['"a""b"', '"a,b"', '"a\nb"', "a\rb", ""]
    assert values(spark, text.truncated, ["x" * 8000, "x" * 8001])[1] == "x" * 4000 + "\n…\n" + "x" * 4000
    assert values(spark, text.site_script, ["д" * 300, "a" * 300, "a" * 10, "д" * 100 + "a" * 200]) == ["cyrillic", "latin", "mixed", "mixed"]
    assert values(spark, text.website_language, ["д" * 300, "a" * 300, "a" * 10, "д" * 100 + "a" * 200]) == ["bg", "en", "en", "en"]  # never mixed
    assert values(spark, text.name_of_domain, ["tashev-trans.bg", "www.acme-ltd.com", "ab.bg"]) == ["Tashev Trans", "Acme", None]
    assert values(spark, text.safe_filename, ["отчет 1/2.csv"]) == ["отчет_1_2.csv"]
    assert values(spark, text.clean_search_text, ["&#x1F600;&#1046;&eacute;"]) == ["😀Ж&eacute;"]


def test_letters_are_counted_once_a_text(spark):
    texts = ["", "12 .,", "aZ@[`{é", "ЀӿϿԀ ж\U0001f600x" * 3, "д" * 101 + "a" * 100, "д" * 99 + "a" * 100 + "\n", "a" * 160 + "д" * 40, "a" * 151 + "д" * 50, None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.letters(F.col("t")).alias("n"), text.website_language(F.col("t")).alias("w"), text.site_script(F.col("t")).alias("s")).orderBy("k").collect()
    for t, r in zip(texts, got):
        cyrillic, latin = (None, None) if t is None else (sum("Ѐ" <= c <= "ӿ" for c in t), sum(c.isascii() and c.isalpha() for c in t))
        share = cyrillic / (cyrillic + latin) if t and cyrillic + latin >= 200 else 0.4
        script = "cyrillic" if share > 0.5 else "latin" if share < 0.25 else "mixed"
        assert (r.n.cyrillic, r.n.latin, r.s) == (cyrillic, latin, script)
        assert r.w == ("bg" if script == "cyrillic" or script == "mixed" and t is not None and cyrillic >= latin else "en")
    asked = spark.createDataFrame([("website", "a")], "p string, t string").select(text.email_language(F.col("p"), text.website_language(F.col("t"))).alias("x"))
    assert asked._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 2
