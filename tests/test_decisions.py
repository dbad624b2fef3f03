"""Rules of decisions, languages, teams, exports and queues on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from leadlake.functions import text
from leadlake.functions.html import html_facts
from leadlake.operators import decide, discovery, profile, progress, relational
from leadlake.sources import tables
from leadlake.streaming import jobs


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_stored_decisions(spark):
    rows = [("facebook.com", "IRRELEVANT", None, "ACCEPT", "x"), ("a.bg", "IRRELEVANT", "", "ACCEPT", "x"), ("a.bg", "IRRELEVANT", "https://l.bg", "ACCEPT", "ok"), ("a.bg", None, None, "REVIEW", "r"), (None, "UNKNOWN", None, "REJECT", "no"), ("a.bg", "UNKNOWN", None, None, None)]
    frame = spark.createDataFrame(rows, "d string, t string, e string, v string, r string")
    got = [tuple(r.s) for r in frame.select(decide.stored(*map(F.col, "dtevr")).alias("s")).collect()]
    assert got == [("BLOCKED", "NON_CRAWLABLE_PLATFORM"), ("BLOCKED", "BLOCKLISTED_AGGREGATOR"), ("KEPT", "ok"), ("REVIEW", "r"), ("FILTERED", "no"), ("FILTERED", None)]
    assert one(spark, a=decide.stored_domain(F.lit(None).cast("string"), F.lit("Фирма"), F.lit("u"))).a == "extracted-" + "Фирма".encode().hex()[:16] + ".local"


def test_language_of_mixed_texts(spark):
    rows = [("а" * 300, "bg"), ("a" * 300, "en"), ("а" * 100 + "a" * 150, "en"), ("а" * 10 + "a" * 10, "bg"), ("", "bg"), ("ab", "en")]
    frame = spark.createDataFrame(rows, "t string, w string")
    assert frame.where(text.website_language(F.col("t")) != F.col("w")).count() == 0
    assert one(spark, a=text.email_language(F.lit("website"), F.lit("en")), b=text.email_language(F.lit("fr"), F.lit("en")), c=text.email_language(F.lit(None).cast("string"), F.lit("en")), d=text.email_language(F.lit("website"), F.lit(None).cast("string"))) == ("en", "bg", "bg", "bg")
    assert "English" in one(spark, a=text.email_language_instruction(F.lit("en"))).a
    assert one(spark, a=text.error_code(F.lit("Cannot read properties of null, reading 'innerText'"))).a == "EMPTY_DOCUMENT"


def test_generic_names(spark):
    generic = ["Login", "sign-in", "BG", "English  version", "de site", "Select language", "Language switcher", "Начална страница", "Just a moment...", "403 Forbidden", "Untitled document", "language_menu"]
    fine = ["Acme", "Home Design", "Bulgarian Bakery", "English School Sofia", "", None]
    frame = spark.createDataFrame([(g, True) for g in generic] + [(f, False) for f in fine], "n string, w boolean")
    assert frame.where(profile.is_generic_name(F.col("n")) != F.col("w")).collect() == []


def test_team_of_a_site(spark):
    page = """<div><p>Управител: Иван Петров</p></div><p>Maria Ivanova – Marketing Manager</p><div>Peter Jones, Sales Director <a href="mailto:Peter@acme.bg?x">mail</a></div><a href="mailto:info@acme.bg">info</a>"""
    f = spark.createDataFrame([(page.replace("</p>", "</p>\n"),)], "h string").select(html_facts("h").alias("f"))
    row = f.select(profile.team(F.col("f")).alias("t"), profile.mailed_team(F.col("f")).alias("m")).first()
    assert {(m.name, m.position) for m in row.t} >= {("Иван Петров", "Управител"), ("Maria Ivanova", "Marketing Manager")}
    assert [(m.name, m.position, m.email) for m in row.m] == [("Peter Jones", "Sales Director", "peter@acme.bg")]
    person = "array<struct<name: string, position: string, email: string>>"
    full = "array<struct<name: string, position: string, email: string, phone: string>>"
    made = spark.createDataFrame(
        [("cyrillic", [("John Portman", "CEO", None)], [("Ann Lee", "Manager", "ann@acme.bg")], [(None, None, "x@y.org", "1")], ["info@acme.bg", "Ann@acme.bg", "bob.stone@acme.bg", "z@other.bg", "office2@acme.bg"]), ("latin", [("John Portman", "CEO", None), ("john portman", "CFO", None)], [], [], [])],
        f"s string, m {person}, a {person}, c {full}, e array<string>",
    )
    got = [[(m.name, m.email) for m in r.t] for r in made.select(discovery.site_team(F.col("m"), F.col("a"), F.col("c"), F.col("e"), F.lit("acme.bg"), F.col("s")).alias("t")).collect()]
    assert got == [[("Ann Lee", "ann@acme.bg"), (None, "x@y.org"), ("Bob Stone", "bob.stone@acme.bg")], [("John Portman", None)]]


def test_services_in_text(spark):
    body = "Menu\nOur services:\nRoofing\nHome\nWe build a lot.\n42\nPainting\nContact us\nNot this"
    assert one(spark, a=profile.services_in_text(F.lit(body)), b=profile.services_in_text(F.lit("services\nonly one"))) == (["Roofing", "Painting"], [])


def test_checks_of_a_crawl(spark):
    pages = spark.createDataFrame([(1, 2, "<p>x", "Ray ID: 0123456789abcdef"), (1, 1, "<title>Access Denied</title>", ""), (2, 1, "<p>fine", "fine")], "company_id int, page_id int, html string, text string")
    assert [tuple(r) for r in profile.bot_protected(pages).collect()] == [(1, "access denied")]
    companies = spark.createDataFrame([(1,), (2,), (3,)], "company_id int")
    long = spark.createDataFrame([(1, " " + "x" * 150), (1, "x" * 50 + " "), (2, "x" * 199 + "   ")], "company_id int, text string")
    assert sorted(r.company_id for r in profile.needs_browser(companies, long).collect()) == [2, 3]


def test_registry_queries(spark):
    frame = spark.createDataFrame([("детска градина", " Варна "), ("hotel", "Варна")], "persona string, location string")
    got = [r.query for r in discovery.registry_queries(frame).orderBy("nth").collect()]
    assert got == ["списък детска градина Варна", "регистър детска градина Варна", "детска градина Варна община"]


def test_last_administrator_stays(spark):
    users = spark.createDataFrame([(1, "ADMIN"), (2, "ADMIN"), (3, "USER")], "user_id int, role string")
    allowed = lambda *rows: {r.user_id: r.allowed for r in discovery.batch_admins(users, spark.createDataFrame(list(rows), "user_id int, role string")).collect()}
    assert allowed((1, "USER"), (2, "USER"), (3, "ADMIN")) == {1: True, 2: False, 3: True}
    assert allowed((1, "USER"), (3, "USER")) == {1: True, 3: True}


def test_only_zipped_workbooks_within_the_limit_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0" + b"0" * 60)
    with pytest.raises(Exception, match="zipped format"):
        tables.xlsx_cells(spark, str(tmp_path / "old.xls")).collect()
    monkeypatch.setattr(tables, "MOST_BYTES", 10)
    with pytest.raises(Exception, match="over the limit"):
        tables.xlsx_cells(spark, str(tmp_path / "old.xls")).collect()


def test_weeks_of_a_hot_user(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [("a", day(n), 1.0) for n in (0, 3, 7, 8, 15)] + [("b", day(n / 100), 2.0) for n in range(25_000)] + [(None, day(1), None), ("c", None, 1.0)]
    got = {r.user: (r.used, r.reset_at) for r in progress.weekly_usage(spark.createDataFrame(rows, "user string, t timestamp, n double"), "user", "t", "n").collect()}
    assert got["a"] == (1.0, day(15)) and got["b"] == (2.0 * (25_000 - 24_500), day(245)) and got[None] == (0.0, day(1)) and "c" not in got


def test_pages_as_json_and_survivors_of_nothing(spark):
    frame = spark.createDataFrame([(2, None), (1, "a")], "id int, v string")
    assert relational.json_page(frame, [F.asc("id")], 1, 1).first().body == '{"data":[{"id":1,"v":"a"}],"pagination":{"page":1,"limit":1,"total":2,"pages":2}}'
    assert relational.json_page(frame.limit(0), [F.asc("id")]).first().body == '{"data":[],"pagination":{"page":1,"limit":50,"total":0,"pages":0}}'


def test_queues_have_their_own_retries(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "company_id long, kind string, ts timestamp"
    for k, rows in enumerate([[(1, "fail", at(0)), (1, "fail", at(1)), (2, "done", at(0))], [(3, "start", at(500))], [(3, "done", at(600))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.job_states(jobs.read_stream(spark, str(tmp_path / "in"), schema, 1), "discover")
    jobs.keep_table(stream.drop("due"), str(tmp_path / "out"), ["company_id"], str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = sorted((tmp_path / "out").glob("v*"))[-1]
    got = {r.company_id: (r.status, r.tries) for r in spark.read.parquet(str(last)).collect()}
    assert got[2] == ("COMPLETED", 0) and got[3][0] == "COMPLETED" and got[1][1] == 2 and got[1][0] in ("PENDING", "DUE")
