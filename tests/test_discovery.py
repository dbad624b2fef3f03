"""Discovery and enrichment on small stored inputs."""

from pyspark.sql import functions as F

from leadlake.operators import decide, discovery


def test_queries(spark):
    rows = spark.createDataFrame([(1, " хотел ", "област Ловеч", "спа"), (2, "school", "Sofia", None)], "id int, persona string, location string, keywords string")
    got = [(r.id, r["query"]) for r in discovery.queries(rows).orderBy("id", "nth").collect()]
    assert len(got) == 7 + 4 and got[0][1] == "хотел област Ловеч спа официален сайт" and got[4][1] == "хотел Ловеч спа контакти" and got[-1][1] == "school Sofia услуги"


def test_merged_hits(spark):
    hits = spark.createDataFrame([(0, 1, "https://www.a.bg/x/y", "A", "<b>s</b>"), (1, 1, "https://a.bg/x", "B", None), (0, 2, "https://olx.bg/i", "C", ""), (0, 3, "bad", "D", "")], "nth int, rank int, url string, title string, snippet string")
    got = {r.domain: (r.title, r.snippet, r.blocked_by) for r in discovery.merged_hits(hits).collect()}
    assert got == {"a.bg": ("B", None, None), "olx.bg": ("C", None, "olx.bg")}


def test_registry_pages(spark):
    page = "<h1>Регистър на училищата</h1><ul>" + "".join(f"<li>ОУ Номер {k}</li>" for k in range(12)) + "</ul>"
    hits = spark.createDataFrame([("q", k, f"https://r{k}.bg/", "t") for k in range(5)], "query string, rank int, url string, title string")
    pages = spark.createDataFrame([("https://r1.bg/", page), ("https://r4.bg/", page)], "url string, html string")
    assert sorted(r.name for r in discovery.registry_organisations(hits, pages).collect()) == sorted(f"ОУ Номер {k}" for k in range(12))


def test_cache(spark):
    batches = spark.createDataFrame([("b1", "k", "t", "2024-01-10"), ("b2", "k", "t", "2024-01-20"), ("b3", "k", "t", "2023-11-01"), ("b4", "k", "u", "2024-01-25")], "batch_id string, discovery_key string, tenant_id string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    candidates = spark.createDataFrame([("b1", "x.bg", "2024"), ("b2", "x.bg", None), ("b3", "x.bg", "2024"), ("b4", "x.bg", "2024"), ("n", "y.bg", "2024"), ("b1", "y.bg", "2024")], "batch_id string, domain string, decided_at string")
    found = discovery.cached_batch(batches, candidates, F.lit("k"), F.lit("t"), F.lit("2024-01-30").cast("timestamp")).collect()
    assert [r.batch_id for r in found] == ["b1"]
    assert [(r.batch_id, r.domain) for r in discovery.reused(candidates, "b1", "n", candidates).collect()] == [("n", "x.bg")]


def test_verification(spark):
    rows = spark.createDataFrame([(1, "Варна", "гр. Русе, ул. 1"), (2, "Варна", "гр. Варна"), (3, "Варна", "nowhere"), (4, "Варна", None)], "id int, location string, address string").withColumns({"signals": F.array().cast(decide.SIGNALS), "status": F.lit("ACCEPT"), "excluded": F.lit(False)})
    got = {r.id: (r.status, r.excluded, [s.criterion for s in r.signals]) for r in discovery.verified(rows).collect()}
    assert got == {1: ("REVIEW", True, ["LOCATION_CONFLICT_VERIFIED"]), 2: ("ACCEPT", False, ["MATCHES_PERSONA_AND_LOCATION"]), 3: ("ACCEPT", False, ["LOCATION_UNKNOWN"]), 4: ("ACCEPT", False, [])}


def test_enrichment_from_hits(spark):
    companies = spark.createDataFrame([("acmebuild.bg", "Acme Build", None, {"linkedin": "x"}), ("b.bg", "B", "ул. Мир 5, Русе", {})], "domain string, name string, location string, social map<string,string>")
    hits = spark.createDataFrame(
        [("acmebuild.bg", 1, "https://facebook.com/other", "t", "s"), ("acmebuild.bg", 2, "https://facebook.com/acmebuild", "Acme Build", "адрес: ул. Шипка 12, 1504 София | ул. Шипка 12 София"), ("acmebuild.bg", 9, "https://facebook.com/acmebuild1", "Acme Build", "x"), ("b.bg", 1, "https://x.bg", "5 Main Street, 10001 NY", "")],
        "domain string, rank int, url string, title string, snippet string",
    )
    assert [tuple(r) for r in discovery.social_from_hits(companies, hits).collect()] == [("acmebuild.bg", "facebook", "https://www.facebook.com/acmebuild")]
    got = {r.domain: (r.address, r.source) for r in discovery.address_from_hits(companies, hits).collect()}
    assert got == {"acmebuild.bg": ("ул. Шипка 12, 1504 София", "search"), "b.bg": ("ул. Мир 5, Русе", "website")}


def test_small_rules(spark):
    one = lambda make, x, kind="string": spark.createDataFrame([(x,)], f"x {kind}").select(make(F.col("x")).alias("v")).first().v
    assert tuple(one(discovery.logo_text_name, "home\nACME STEEL\nBest parts ever\n12345")) == ("ACME STEEL", "Best parts ever", 80)
    assert tuple(one(discovery.logo_text_name, "123\n..")) == (None, None, 0)
    assert [one(discovery.person_of_mailbox, x) for x in ("toni2", "ivan.petrov", "info", "vtashev", "stoyan", "a_b", "maria_ivanova")] == ["Toni", "Ivan Petrov", None, None, "Stoyan", None, "Maria Ivanova"]
    assert [one(discovery.is_person_name, x) for x in ("Мария Петрова", "Sales Manager", "First Name", "maria petrova")] == [True, False, False, False]
    person = "array<struct<name: string, position: string, email: string, linkedin: string>>"
    team = [("A B", "Sales Director", None, None), ("C D", "CEO", "c@d.bg", None), (None, "clerk", None, None)]
    assert one(discovery.target_contact, team, person).name == "C D" and one(discovery.target_contact, [], person) is None
    assert one(discovery.team_line, team, person) == "A B (Sales Director); C D (CEO) <c@d.bg>; clerk"
    companies = spark.createDataFrame([("a.bg", "Acme", ["o@a.bg"], ["1", "2"], {"facebook": "f"}, None, "loc", team), ("b.bg", None, [], None, {}, "ind", None, None)], f"domain string, name string, emails array<string>, phones array<string>, social map<string,string>, industry string, location string, team {person}")
    rows = discovery.lead_rows(companies).collect()
    assert len(rows) == 3 and rows[0]["First Name"] == "A" and rows[1]["Email"] == "c@d.bg" and rows[0]["Telephone"] == "1, 2" and rows[2]["First Name"] == "" and rows[2]["Telephone"] == "" and rows[2]["Website"] == "https://b.bg"
    assert spark.range(1).select(discovery.outreach_prompt(F.lit("Hi {{who}} of {{firm}}"), {"who": F.lit("Ann"), "firm": F.lit("")})).first()[0] == "Hi Ann of n/a"
    users = spark.createDataFrame([(1, "ADMIN"), (2, "ADMIN"), (3, "USER")], "user_id int, role string")
    changes = spark.createDataFrame([(1, "USER"), (2, "USER"), (3, "ADMIN")], "user_id int, role string")
    assert {r.user_id: r.allowed for r in discovery.batch_admins(users, changes).collect()} == {1: True, 2: False, 3: True}


def test_enriched(spark):
    rows = spark.createDataFrame([(None, "d", None, [], ["s"], {"linkedin": "l"}, 35, "Logo", "hd", "addr", ["m@x.bg"], [], {"facebook": "f"})], "name string, description string, location string, emails array<string>, services array<string>, social map<string,string>, completion_score int, logo_name string, hit_description string, hit_address string, llm_emails array<string>, llm_services array<string>, hit_social map<string,string>")
    r = discovery.enriched(rows).first()
    assert (r.name, r.description, r.location, r.emails, r.services, r.social, r.completion_score) == ("Logo", "d", "addr", ["m@x.bg"], ["s"], {"linkedin": "l", "facebook": "f"}, 35 + 20 + 10 + 15)
