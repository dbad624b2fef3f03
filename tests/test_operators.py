"""Operators on small tables with the borders and ties that matter."""

import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadlake.functions.html import SLICE, parse, slices
from leadlake.operators import decide, profile, progress, relational, resolve
from leadlake.operators.graph import connected_components
from leadlake.sources import sinks, tables
from leadlake.streaming import jobs

PAGE = """<html><head><title>Начало | Acme Steel</title><meta name="description" content="We make steel parts for cranes and ships."><meta property="og:image" content="/og.png"></head>
<body><header><a href="/" class="home"><img class="logo" src="/logo-acme.svg" alt="Acme"></a><nav><ul><li><a href="/about">About<li><a href="/news?page=2">News</a></ul></nav></header>
<h1>Acme</h1><p>one<p>two <b>bold</b><h2>Our services</h2><ul><li>Welding<li>Cutting</ul><h3>Maria Petrova</h3><div>Sales Manager, Sofia</div>
<h2>Company history</h2><p>Acme was founded in 1994 by two engineers from Pernik.</p><address>ул. Шипка 12, 1504 София</address>
<a href="https://www.facebook.com/acme">fb</a><a href="/contacts">Contact</a><script>var t="</p>";</script><p>call 0888 123 456 or office@acmesteel.bg</p></body></html>"""


def test_html_is_parsed_once_and_loosely():
    facts = parse(PAGE)
    assert facts["paragraphs"][:2] == ["one", "two bold"] and facts["items"] == 4 and "var t" not in facts["text"]
    assert [a["nav"] for a in facts["anchors"]] == [True, True, True, False, False]
    assert facts["lists"][1]["items"] == ["Welding", "Cutting"] and facts["lists"][1]["heading"] == "Our services"
    assert parse("")["title"] is None and parse("<p>a<table><tr><td>1<td>2<tr><td>3</table>")["rows"] == 2


def test_profile(spark):
    pages = spark.createDataFrame([(1, "https://acme-steel.bg/", PAGE), (2, "https://www.acme-steel.bg/x", "<p>info@acmesteel.bg"), (3, "https://b.bg/", None), (4, None, "x")], "page_id long, url string, html string")
    (row,) = profile.site_profiles(pages).collect()
    assert (row.host, row.pages, row["name"], row.description) == ("acme-steel.bg", 2, "Acme Steel", "We make steel parts for cranes and ships.")
    assert row.emails == ["office@acmesteel.bg", "info@acmesteel.bg"] and row.phones == ["0888 123 456"] and row.services == ["Welding", "Cutting"]
    assert row.location == "ул. Шипка 12, 1504 София" and row.history.startswith("Acme was founded") and row.team == 1 and row.completion_score == 100
    facts = profile.page_facts(pages.where("page_id = 1")).select(profile.url_queue(F.col("facts"), F.lit("https://acme-steel.bg")).alias("q"), profile.logo_urls(F.col("facts"), F.lit("https://acme-steel.bg/")).alias("l"), profile.social_links(F.col("facts")).alias("s")).first()
    assert facts.q[:2] == ["https://acme-steel.bg/contacts", "https://acme-steel.bg/about"] and len(facts.q) <= 18
    assert facts.l == ["https://acme-steel.bg/logo-acme.svg", "https://acme-steel.bg/og.png"] and facts.s == {"facebook": "https://www.facebook.com/acme"}


def test_progress(spark):
    rows = [("COMPLETED", 5, 2), ("FAILED", 4, 1), ("PROCESSING", 0, 0), ("PROCESSING", 3, 9), ("PENDING", -1, -2), ("PROCESSING", 4, 1), ("COMPLETED", 0, 0)]
    got = [tuple(r.p) for r in spark.createDataFrame(rows, "s string, t int, d int").select(progress.progress(F.col("s"), F.col("t"), F.col("d")).alias("p")).collect()]
    assert got == [(5, 5, 100.0, "COMPLETED"), (4, 1, 25.0, "FAILED"), (0, 0, 0.0, "PROCESSING"), (3, 3, 100.0, "COMPLETED"), (0, 0, 0.0, "PROCESSING"), (4, 1, 25.0, "PROCESSING"), (0, 0, 100.0, "COMPLETED")]


def test_ttl_borders(spark):
    now, ms = pd.Timestamp("2024-02-01"), pd.Timedelta(milliseconds=1)
    at = [now - pd.Timedelta(days=7) + d * ms for d in (1, 0, -1)]
    rows = spark.createDataFrame([(k, t.to_pydatetime(), (t - pd.Timedelta(days=23)).to_pydatetime()) for k, t in enumerate(at)], "k int, t timestamp, m timestamp")
    when = F.lit("2024-02-01").cast("timestamp")
    fresh = progress.freshness(F.lit("COMPLETED"), F.col("m"), F.lit(True), F.lit(80), F.lit(1), F.lit(0), F.lit("n"), F.lit(None), when, F.lit(False))["reason"]
    got = rows.orderBy("k").select(progress.page_action(F.col("t"), when), progress.search_is_cached(F.col("t"), when), progress.discovery_is_cached(F.col("m"), when), fresh).collect()
    assert [tuple(r) for r in got] == [("skip", True, True, "fresh"), ("update", True, True, "stale"), ("update", False, False, "stale")]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (4, 5), (12, 12), (None, 3), (20, 5), (11, 10)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {(k, 1) for k in (1, 2, 3, 4, 5, 20)} | {(10, 10), (11, 10)}
    chain = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert connected_components(chain).agg(F.max("component"), F.count("*")).first() == (0, 61)
    assert connected_components(chain.limit(0)).count() == 0


def test_entities_are_merged_in_order_of_confidence(spark):
    rows = [(1, "a.bg", "x@a.bg", None, "Alpha", "", None, 50), (2, None, "X@A.bg ", "0888 111 222", "Other", "ул. 1", None, 70), (3, None, None, "+359888111222", "", None, "w", 70), (4, "z.bg", None, None, "ДГ Мир", None, None, 10), (5, None, None, None, "детска градина мир", None, None, 10), (6, None, None, None, "ab", None, None, 1), (7, None, None, None, "ab", None, None, 1)]
    frame = spark.createDataFrame(rows, "id int, domain string, email string, phone string, name string, address string, website_url string, confidence int")
    got = {r.entity: r for r in resolve.merged(frame).collect()}
    assert set(got) == {1, 4, 6, 7}
    assert (got[1].id, got[1].domain, got[1]["name"], got[1].website_url, got[1].members) == (2, "a.bg", "Other", "w", 3) and (got[4].id, got[4].members) == (4, 2)


def test_verdicts(spark):
    rows = [
        ("a.bg", "", "TARGET_ORGANIZATION", None, None, None, "Acme", None, "гр. Враца", None, 60), ("www.facebook.com/x", "", "UNKNOWN", None, None, None, "B", None, None, None, 90), ("n.bg", "", "NEWS_ARTICLE", None, None, None, "C", None, None, None, 90), ("n.bg", "", "NEWS_ARTICLE", "https://l.bg/", None, None, "D", None, None, None, 90),
        ("l.bg", "", "UNKNOWN", "https://www.l.bg/list", None, None, "E", None, None, None, 90), ("x.local", "", "UNKNOWN", None, None, None, "F", None, None, None, 90), ("g.bg", "", "UNKNOWN", None, None, None, "G", None, "хотел Бургас", None, 90), ("h.bg", "", "UNKNOWN", None, None, None, "H", None, None, None, 45), ("i.bg", "", "UNKNOWN", None, None, None, "I", None, None, None, 39),
    ]
    frame = spark.createDataFrame(rows, "domain string, website_url string, page_type string, extracted_from string, email string, phone string, name string, title string, snippet string, address string, confidence int").withColumn("signals", F.array().cast(decide.SIGNALS))
    got = [(r.verdict, r.reason, r.confidence) for r in decide.qualify(frame, F.lit("hotel"), F.lit("Враца")).collect()]
    assert got == [("ACCEPT", "MATCHES_PERSONA_AND_LOCATION", 75), ("REJECT", "SOCIAL_PLATFORM", 90), ("REJECT", "NEWS_ARTICLE", 90), ("ACCEPT", "MATCHES_PERSONA_AND_LOCATION", 90), ("REJECT", "SAME_DOMAIN_AS_SOURCE", 100), ("REJECT", "NO_CONTACT_SIGNAL", 90), ("REVIEW", "LOCATION_CONFLICT", 90), ("REVIEW", "BORDERLINE_CONFIDENCE", 45), ("REJECT", "BELOW_CONFIDENCE_FLOOR", 39)]
    school = spark.createDataFrame([("ОУ Христо Ботев", "ou.bg"), ("Каталог на фирми", "k.bg"), ("Фирма", "f.bg")], "n string, d string")
    assert [tuple(r.e) for r in school.select(decide.education(F.col("n"), F.col("d"), F.lit(None), F.lit(None), F.lit(False)).alias("e")).collect()] == [(True, 80, None), (False, 0, "DIRECTORY_OR_PORTAL"), (False, 40, "NOT_TARGET_ORGANIZATION")]


def test_pages_and_upserts(spark):
    frame = spark.range(10)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(relational.page(frame, [F.desc("id")], 0, 3)) == [9, 8, 7] and ids(relational.page(frame, [F.asc("id")], 4, 3)) == [9] and len(ids(relational.page(frame, [F.asc("id")], 1, 0))) == 1
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "", "z"), (3, "c", None)], "k int, v string, w string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Domain,x\nhttps://www.A.bg/p,"b.bg",,\n\nc d,b.bg\n')
    got = {tuple(r) for r in tables.domains(tables.csv_cells(spark, str(tmp_path / "a.csv"))).collect()}
    assert got == {("x", False, 1), ("a.bg", True, 0), ("b.bg", True, 1), ("c d", False, 1)}
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook(["Domain", "n"], [["a.bg", 1], ["<&>", None]]))
    assert zipfile.is_zipfile(tmp_path / "a.xlsx")
    assert [r.cell for r in tables.xlsx_cells(spark, str(tmp_path / "a.xlsx")).collect()] == ["Domain", "n", "a.bg", "1", "<&>"]
    lines = [r.line for r in sinks.csv_lines(spark.createDataFrame([(2, 'q"', None), (1, "a,b", "x")], "k int, v string, w string"), [F.col("k")]).collect()]
    assert lines == ["k,v,w", '1,"a,b",x', '2,"q""",']
    with pytest.raises(ValueError):
        tables.check_upload("a.exe", 1)
    store = sinks.Snapshots(spark, str(tmp_path / "t"))
    assert store.version() == 0 and store.write(spark.range(3)) == 1 and store.write(store.read().where("id > 0")) == 2 and store.read().count() == 2


def test_search_answers(spark):
    rows = [("q", "one", 200, '{"web":{"results":[{"url":"https://a.bg","title":"A","description":"d"}]}}'), ("r", "two", 200, '{"organic":[{"link":"https://b.bg","title":"B","snippet":"s"},{"title":"no link"}]}'), ("s", "one", 429, ""), ("t", "one", 500, "x"), ("u", "one", 200, "not json")]
    frame = spark.createDataFrame(rows, "query string, provider string, status_code int, body string")
    assert sorted((r["query"], r["rank"], r.url) for r in tables.search_hits(frame).collect()) == [("q", 1, "https://a.bg"), ("r", 1, "https://b.bg")]
    assert [r["query"] for r in tables.refused(frame).collect()] == ["s"]


def test_jobs(spark, tmp_path):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    rows = [(1, "start", at(0)), (1, "done", at(1)), (1, "fail", at(2)), *((2, "fail", at(k)) for k in range(4)), (3, "fail", at(5)), (4, "blocked", at(1))]
    events = spark.createDataFrame(pd.DataFrame(rows, columns=["company_id", "kind", "ts"]), "company_id long, kind string, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    out = jobs.run_once(jobs.job_states(jobs.read_stream(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "))), "job_states", "update", str(tmp_path / "c"))
    got = {r.company_id: (r.status, r.tries) for r in out.collect()}
    assert got == {1: ("COMPLETED", 0), 2: ("FAILED", 4), 3: ("PENDING", 1), 4: ("BLOCKED", 0)}


CUT = "<title>Ivan &amp; Sons &lt;Sofia&gt; &copy; R&D &amphetamine; and&amp</title><a href='/x?a=1&amp;b=2&copy=3'>x</a><p>" + "a" * 60 + "&amp &#65; &#66 &quo</p><script>var t = '&amp;&amp';</script>"


def test_references_without_a_semicolon():
    facts = parse(CUT, unclosed=False)
    assert facts["title"] == "Ivan & Sons <Sofia> © R&D &amphetamine; and&amp" and facts["anchors"][0]["href"] == "/x?a=1&b=2&copy=3"
    assert facts["paragraphs"] == ["a" * 60 + "&amp A &#66 &quo"]
    assert parse(CUT)["title"] == "Ivan & Sons <Sofia> © R&D &hetamine; and&" and parse(CUT)["paragraphs"] == ["a" * 60 + "& A B &quo"]


def test_facts_are_read_in_slices_of_a_batch(spark):
    pages = ["<p>" + "x" * n for n in (0, SLICE // 2, SLICE // 2, 3 * SLICE, 5, 0)] + [None, ""]
    runs = [[len(p) if p is not None else None for p in s.to_pylist()] for s in slices(pa.array(pages))]
    assert runs == [[3, SLICE // 2 + 3], [SLICE // 2 + 3], [3 * SLICE + 3], [8, 3, None, 0]]
    assert [len(s) for s in slices(pa.array([None] * 3000, pa.string()))] == [1024, 1024, 952] and not list(slices(pa.array([], pa.string())))
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1)
    got = profile.page_facts(rows).select("page_id", F.length("facts.text").alias("n"), F.size("facts.paragraphs").alias("p"), F.col("facts.items").alias("i")).orderBy("page_id").collect()
    assert [(r.n, r.i) for r in got] == [(None, None) if p is None else (max(0, len(p) - 3), 0) for p in pages] and [r.p for r in got[:6]] == [1] * 6


def test_queues_of_one_batch_of_many_slices(spark):
    rows = [(k, f"https://h{k}.bg/", f"<nav><a href='/p{k}'>p</a></nav>" + " " * (SLICE // 3) * (k % 7 == 0)) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.q for r in profile.page_facts(pages).select("page_id", profile.url_queue(F.col("facts"), F.regexp_replace("url", "/$", "")).alias("q")).collect()}
    assert len(list(slices(pa.array([h for _, _, h in rows])))) == 3
    assert got == {k: [f"https://h{k}.bg{p}" for p in (f"/p{k}", *profile.CONTACT_PATHS, *profile.TEAM_PATHS, *profile.OTHER_PATHS)][:18] for k, _, _ in rows}
