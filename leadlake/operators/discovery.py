"""From a search to candidates and back: queries, registry pages, cache reuse, verification, enrichment from stored hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import contacts, gazetteer, text, urls
from leadlake.operators import decide, profile, relational

TOWNS_A_PROVINCE = 3
REGISTRY_HITS = 3
SOCIAL_HITS = 5
PLATFORMS = ("facebook", "linkedin")
BONUS = {"login_name": 20, "login_description": 10, "login_social": 5, "address": 10, "emails": 15, "services": 10, "social": 5}


def queries(searches: DataFrame) -> DataFrame:
    """(…, nth, query): four phrasings, and one for each of the first towns of a province."""
    key = F.regexp_replace(F.lower(F.trim("location")), r"^(?:oblast|област)\s+", "")
    seats = F.create_map(*(x for k, towns in gazetteer.PROVINCES.items() if len(towns) > 1 for x in (F.lit(k), F.array(*map(F.lit, towns[:TOWNS_A_PROVINCE])))))
    who, where = F.trim("persona"), F.trim("location")
    more = F.when(F.trim(F.coalesce("keywords", F.lit(""))) == "", "").otherwise(F.concat(F.lit(" "), F.trim("keywords")))
    base = F.concat(who, F.lit(" "), where, more)
    four = F.array(F.concat(base, F.lit(" официален сайт")), F.concat(base, F.lit(" контакти телефон имейл")), F.concat(F.lit("site:.bg "), base), F.concat(base, F.lit(" услуги")))
    local = F.transform(F.coalesce(F.element_at(seats, key), F.array().cast("array<string>")), lambda t: F.concat(who, F.lit(" "), t, more, F.lit(" контакти")))
    return searches.select("*", F.posexplode(F.concat(four, local)).alias("nth", "query"))


def merged_hits(hits: DataFrame) -> DataFrame:
    """One hit for each domain: the shallowest address, then the first seen (query number, rank); blocked ones keep their entry."""
    own = hits.withColumn("domain", urls.bare_host(F.col("url"))).where("domain <> ''").withColumn("_depth", urls.path_depth(F.col("url")))
    best = relational.first_of(own, ["domain"], [F.asc("_depth"), F.asc("nth"), F.asc("rank")]).drop("_depth")
    return best.withColumn("title", text.clean_search_text(F.col("title"))).withColumn("snippet", text.clean_search_text(F.col("snippet"))).withColumn("blocked_by", urls.blocklist_hit(F.col("domain")))


def registry_organisations(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(query, url, name): organisations listed on the registry-like pages among each query's first hits."""
    top = relational.first_of(hits, ["query"], [F.asc("rank")], REGISTRY_HITS)
    likely = top.where(profile.type_from_meta(F.col("url"), F.col("title"), F.lit(""))["type"].isin("MUNICIPALITY_PAGE", "OFFICIAL_REGISTRY", "UNKNOWN"))
    seen = profile.page_facts(likely.join(pages.select("url", "html"), "url"))
    lists = seen.where(profile.type_from_content(F.col("facts"))["type"].isin("DIRECTORY_OR_PORTAL", "MUNICIPALITY_PAGE", "OFFICIAL_REGISTRY"))
    return lists.select("query", "url", F.explode(profile.organisations(F.col("facts"))).alias("name"))


def cached_batch(batches: DataFrame, candidates: DataFrame, key: Column, tenant: Column, now: Column) -> DataFrame:
    """The newest batch of a key that is still good: it has candidates, and none is undecided."""
    from leadlake.operators.progress import discovery_is_cached

    fine = candidates.groupBy("batch_id").agg(F.count_if(F.col("decided_at").isNull()).alias("open")).where("open = 0")
    good = batches.where((F.col("discovery_key") == key) & (F.col("tenant_id") == tenant) & discovery_is_cached(F.col("updated_at"), now))
    return relational.page(good.join(fine, "batch_id", "left_semi"), [F.desc("updated_at"), F.asc("batch_id")], 1, 1)


def reused(candidates: DataFrame, old_batch: str, new_batch: str, there: DataFrame) -> DataFrame:
    """Candidates of a batch copied to another one, but for domains that this has already."""
    copy = candidates.where(F.col("batch_id") == old_batch).withColumn("batch_id", F.lit(new_batch))
    return copy.join(there.where(F.col("batch_id") == new_batch).select("domain"), "domain", "left_anti")


def verified(decisions: DataFrame) -> DataFrame:
    """``decisions`` (location, address, signals, status, excluded) checked against the address that the site gives.

    Another place demotes to REVIEW and excludes the company, with a REJECT signal; a fitting or unknown one is noted.
    """
    sure = (F.trim(F.coalesce("address", F.lit(""))) != "") & (F.trim(F.coalesce("location", F.lit(""))) != "")
    place = text.location_signal(F.col("address"), F.col("location"), address=True)["kind"]
    told = decisions.withColumn("_kind", F.when(sure, place))
    note = (
        F.when(F.col("_kind") == "conflict", decide.signal("LOCATION_CONFLICT_VERIFIED", "REJECT", "post_crawl"))
        .when(F.col("_kind") == "match", decide.signal("MATCHES_PERSONA_AND_LOCATION", "ACCEPT", "post_crawl"))
        .when(F.col("_kind") == "unknown", decide.signal("LOCATION_UNKNOWN", "REVIEW", "post_crawl"))
    )
    bad = F.coalesce(F.col("_kind") == "conflict", F.lit(False))
    out = told.withColumn("signals", F.when(F.col("_kind").isNull(), F.col("signals").cast(decide.SIGNALS)).otherwise(F.array_append(F.col("signals").cast(decide.SIGNALS), note.cast(decide.SIGNALS[6:-1]))))
    return out.withColumn("status", F.when(bad, "REVIEW").otherwise(F.col("status"))).withColumn("excluded", F.col("excluded") | bad).withColumn("demoted", bad).drop("_kind")


def social_from_hits(companies: DataFrame, hits: DataFrame) -> DataFrame:
    """(domain, platform, profile): of each missing platform the first convincing profile among the first five hits."""
    top = hits.where(F.col("rank") <= SOCIAL_HITS).withColumn("s", urls.social_profile(F.col("url"))).where("s is not null").select("domain", "rank", "title", "snippet", F.col("s.platform").alias("platform"), F.col("s.url").alias("profile"))
    missing = companies.select("domain", "name", F.explode(F.array_except(F.array(*map(F.lit, PLATFORMS)), F.map_keys("social"))).alias("platform"))
    scored = missing.join(top, ["domain", "platform"]).where(text.social_confidence(F.col("profile"), F.col("title"), F.col("snippet"), F.col("name"), F.col("domain")) >= 2)
    return relational.first_of(scored, ["domain", "platform"], [F.asc("rank"), F.asc("profile")]).select("domain", "platform", "profile")


_ELSEWHERE = r"(?i)\b(?:associates and relatives|currently lives|home address|resides at)\b|,\s*(?:AL|AK|AZ|CA|CO|CT|DE|FL|GA|IL|MA|MD|MI|MN|NC|NJ|NV|NY|OH|OR|PA|TN|TX|UT|VA|WA|WI)\b|\b(?:Austria|Belgium|Brazil|Canada|China|France|Germany|Italy|Japan|Netherlands|Poland|Portugal|Romania|Russia|Spain|Sweden|Switzerland|Turkey|UK|USA|United Kingdom|United States)\b"


def address_from_hits(companies: DataFrame, hits: DataFrame) -> DataFrame:
    """(domain, address, source, score, others): the site's own address if it scores at all, else the best fragment of the hits."""
    parts = F.filter(F.transform(F.split(F.concat_ws("\n", "title", "snippet"), r"\.\.\.+|[|·…\r\n]"), lambda f: text.clean_address(F.trim(f))), lambda f: F.length(f).between(5, 199) & ~f.rlike(_ELSEWHERE) & ~text.looks_like_timeline(f))
    context = F.concat_ws("\n", "title", "snippet")
    scored = hits.join(companies.select("domain", "name"), "domain").select("domain", "rank", "name", context.alias("_c"), F.posexplode(parts).alias("_p", "_f")).withColumn("_s", text.address_score(F.col("_f"), F.col("_c"), F.col("name"), F.col("domain"))).where("_s >= 50")
    listed = scored.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), "rank", "_p", F.col("_f").alias("f")))).alias("_a"))
    best = listed.select("domain", text.greedy_distinct(F.transform("_a", lambda a: a["f"])).alias("others"), (-F.col("_a")[0]["s"]).alias("_best"))
    own = text.clean_address(F.col("location"))
    site = text.address_score(own, None, F.col("name"), F.col("domain"))
    joined = companies.join(best, "domain", "left").withColumn("_site", site)
    from_site = F.col("_site") > 0
    return joined.select(
        "domain", F.when(from_site, own).otherwise(F.get("others", F.lit(0))).alias("address"), F.when(from_site, "website").when(F.col("others").isNotNull(), "search").otherwise("none").alias("source"),
        F.when(from_site, F.col("_site")).otherwise(F.coalesce("_best", F.lit(0))).alias("score"), F.when(from_site, F.array().cast("array<string>")).otherwise(F.coalesce("others", F.array().cast("array<string>"))).alias("others"),
    )


_LOGO_GENERIC = r"(?iu)^(?:about|contact|home|login|menu|more|search|services|welcome|вход|за нас|контакти|меню|начало|още|търсене|услуги)$"


def logo_text_name(raw: Column) -> Column:
    """struct(name, slogan, confidence) from recognised text: the line that looks most like a name, and a runner-up."""

    def points(t: Column) -> Column:
        plus = lambda test, n: F.when(test, n).otherwise(0)
        none = (F.length(t) < 2) | t.rlike(_LOGO_GENERIC) | t.rlike(r"^(?:https?|www\.|[0-9]+$)") | ~t.rlike(r"[a-zA-Z\x{400}-\x{4FF}]") | (t.rlike("[.!?,]$") & (F.length(t) > 30))
        total = F.lit(40) + plus((t == F.upper(t)) & (F.length(t) > 2), 25) + plus(F.length(t).between(3, 35), 15) + plus(t.rlike(r"^(?:\p{Lu}(?:\p{Lo}|\p{Ll})+(?:\s(?=\p{Lu})|$))+$"), 10) + plus(t.rlike(r"(?i)\b(?:ad|bv|corp|eood|gmbh|inc|jsc|ltd|nv|ood|srl)\b"), 10) - plus(F.length(t) > 40, 20)
        return F.when(none, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))

    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda t: F.length(t) > 1)
    empty = F.struct(F.lit("").alias("name"), F.lit(0).alias("score"), F.lit("").alias("slogan"))

    def step(s: Column, t: Column) -> Column:
        p = points(t)
        better = p > s["score"]
        slogan = F.when(better & (s["name"] != "") & (s["score"] >= 30), s["name"]).when(~better & (p >= 30) & (t != s["name"]) & (s["slogan"] == ""), t).otherwise(s["slogan"])
        return F.struct(F.when(better, t).otherwise(s["name"]).alias("name"), F.greatest(p, s["score"]).alias("score"), slogan.alias("slogan"))

    def told(s: Column) -> Column:
        good = s["score"] >= 30
        return F.struct(F.when(good, s["name"]).alias("name"), F.when(good, F.nullif(s["slogan"], F.lit(""))).alias("slogan"), F.when(good, s["score"]).otherwise(0).alias("confidence"))

    return contacts.let(F.aggregate(lines, empty, step), told)


def enriched(profiles: DataFrame) -> DataFrame:
    """Profiles with what was found later, in a fixed order of trust, and the score raised for each gap that was filled, to at
    most 100. Columns: name, description, location, emails, phones, services, and logo_name, hit_description, hit_address, llm_emails,
    llm_services, hit_social beside social and completion_score."""
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.size(F.coalesce(F.col(c), F.array())) == 0
    got = lambda c: ~lacks(c)
    gain = lambda test, n: F.when(test, n).otherwise(0)
    more = gain(lacks("name") & got("logo_name"), BONUS["login_name"]) + gain(lacks("description") & got("hit_description"), BONUS["login_description"]) + gain(lacks("location") & got("hit_address"), BONUS["address"]) + gain(none("emails") & ~none("llm_emails"), BONUS["emails"]) + gain(none("services") & ~none("llm_services"), BONUS["services"]) + gain((F.size("social") == 0) & (F.size("hit_social") > 0), BONUS["social"])
    pick = lambda own, other: F.when(lacks(own), F.col(other)).otherwise(F.col(own))
    new = {
        "name": pick("name", "logo_name"), "description": pick("description", "hit_description"), "location": pick("location", "hit_address"), "emails": F.when(none("llm_emails"), F.col("emails")).otherwise(F.col("llm_emails")),
        "services": F.when(none("llm_services"), F.col("services")).otherwise(F.col("llm_services")), "social": F.map_zip_with("social", "hit_social", lambda k, a, b: F.coalesce(a, b)), "completion_score": F.least(F.lit(100), F.col("completion_score") + more),
    }
    return profiles.withColumns(new)


def pages_to_judge(pages: DataFrame, score: Column) -> DataFrame:
    """The two best pages of each company; equal ones in page order."""
    return relational.first_of(pages.withColumn("_score", score), ["company_id"], [F.desc("_score"), F.asc("page_id")], 2).drop("_score")


def page_for_emails(pages: DataFrame) -> DataFrame:
    """A contact page, else the one with most addresses, else the first."""
    contact = F.col("url").rlike("(?iu)contact|kontakt|контакт")
    return relational.first_of(pages.withColumn("_contact", contact).withColumn("_n", F.size("emails")), ["company_id"], [F.desc("_contact"), F.desc("_n"), F.asc("page_id")]).drop("_contact", "_n")


_TIERS = ("(?iu)ceo|owner|president|главен директор|изпълнителен директор|собственик|управител", "(?iu)business development|commercial director|sales director|бизнес развитие|търговски директор", "(?iu)hr (?:manager|мениджър)|human resources|мениджър.*човешки")


def target_contact(team: Column) -> Column:
    """The first person of the highest tier that anyone is in, null if none."""
    return F.coalesce(*(F.get(F.filter(team, lambda m: m["position"].rlike(tier)), F.lit(0)) for tier in _TIERS))


_BOXES = "accountant accounting accounts admin administrator billing careers compliance contact contacts delivery donotreply enquiries enquiry export factory finance hello help helpdesk hi hr humanresources import info inquiries inquiry invoice invoices it itsupport jobs legal logistics mail manager marketing media no-reply noreply office order orders post pr press production quality reception recruitment sales service services shop support team tech technical warehouse web webinfo webmaster website".split()
_STARTS = "bl br ch cl dr fl fr gl gr kh kn kr mn ph pl pr ps sc sh sk sl sm sn sp st sw tr ts tw tz zh".split()


def person_of_mailbox(local: Column) -> Column:
    """A display name from the part before the @, null for role mailboxes and for an initial run into a surname."""
    plain = F.regexp_replace(F.lower(F.trim(local)), r"\d+$", "")
    letters = "^[a-zа-яёіїє]{2,}$"

    def two(mark: str) -> Column:
        parts = F.filter(F.split(plain, mark), lambda p: p.rlike(letters))
        return F.when(F.size(parts) == 2, F.array_join(F.transform(parts, lambda p: F.initcap(p)), " "))

    head = F.substring(plain, 1, 2)
    initial = (F.length(plain) >= 5) & head.rlike("^[^aeiou][^aeiou]$") & ~head.isin(_STARTS)
    one = F.when(plain.rlike("^[a-zа-яёіїє]{3,20}$") & ~initial, F.initcap(plain))
    return F.when(~plain.isin(_BOXES) & (plain != ""), F.coalesce(two(r"\."), two("_"), one))


def is_person_name(name: Column) -> Column:
    return name.rlike(profile.PERSON) & ~name.rlike(profile.ROLES) & ~name.rlike(r"(?iu)\b(?:address|company|e-?mail|first|john doe|last|message|name|phone|subject|име|съобщение|телефон|фамилия)\b")


def site_team(members: Column, mailed: Column, clicked: Column, emails: Column, domain: Column, script: Column) -> Column:
    """struct(name, position, email, phone) of a site's people, each once, at most 50.

    ``members`` (name, position, email) come from the layout; on a Cyrillic site they are a theme's sample people, and left out,
    when all names are Latin and none has an address of the domain. Then come ``mailed`` (name, position, email), ``clicked``
    (name, position, email, phone), which are taken as they are, and the personal addresses of the domain among ``emails``.
    """
    person = "struct<name: string, position: string, email: string, phone: string>"
    blank = F.lit(None).cast("string")
    some = lambda c: F.coalesce(c, F.lit(""))
    own = lambda mail: F.lower(some(mail)).endswith(F.concat(F.lit("@"), domain)) | F.lower(some(mail)).endswith(F.concat(F.lit("."), domain))
    latin = F.forall(members, lambda m: ~m["name"].rlike(r"[\x{400}-\x{4FF}]"))
    sample = (script == "cyrillic") & latin & ~F.exists(members, lambda m: own(m["email"]))
    laid = F.transform(F.when(sample, F.slice(members, 1, 0)).otherwise(members), lambda m: F.struct(m["name"].alias("name"), m["position"].alias("position"), m["email"].alias("email"), blank.alias("phone")).cast(person))
    told = F.transform(mailed, lambda m: F.struct(m["name"].alias("name"), m["position"].alias("position"), m["email"].alias("email"), blank.alias("phone")).cast(person))
    local = lambda mail: F.regexp_extract(F.lower(mail), "^([^@]*)@", 1)
    personal = F.filter(F.array_distinct(F.transform(emails, lambda e: F.lower(e))), lambda e: own(e) & (local(e) != "") & ~F.regexp_replace(local(e), r"\d+$", "").isin(_BOXES))
    inferred = F.transform(personal, lambda e: F.struct(person_of_mailbox(local(e)).alias("name"), blank.alias("position"), e.alias("email"), blank.alias("phone")).cast(person))
    key = lambda m: F.when(some(m["email"]) != "", F.lower(m["email"])).otherwise(F.concat(F.lower(some(m["name"])), F.lit("|"), some(m["phone"])))
    names = lambda held: F.transform(held, lambda m: F.lower(some(m["name"])))

    def add(held: Column, m: Column) -> Column:
        there = F.exists(held, lambda h: key(h) == key(m)) | ((some(m["name"]) != "") & F.array_contains(names(held), F.lower(some(m["name"]))))
        return F.when(there, held).otherwise(F.concat(held, F.array(m)))

    return F.slice(F.aggregate(F.concat(laid, told, F.transform(clicked, lambda m: m.cast(person)), inferred), F.array().cast(f"array<{person}>"), add), 1, 50)


def recrawled(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` profiles (company_id, name, emails, phones, completion_score) upon ``old`` ones (company_id, name, emails, phones, logo_name):
    contacts that the new crawl didn't find are kept, for 15 and 10 points; so is the name, unless it is a generic one, which
    gives way to that of the logo."""
    was = old.select("company_id", F.col("name").alias("_name"), F.col("emails").alias("_emails"), F.col("phones").alias("_phones"), F.col("logo_name").alias("_logo"))
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    kept = lambda c: none(c) & ~none("_" + c)
    name = F.coalesce("name", F.when(profile.is_generic_name(F.col("_name")), F.nullif("_logo", F.lit(""))).otherwise(F.coalesce("_name", "_logo")))
    score = F.col("completion_score")
    score = F.when(kept("emails"), F.least(F.lit(100), score + 15)).otherwise(score)
    score = F.when(kept("phones"), F.least(F.lit(100), score + 10)).otherwise(score)
    values = {"name": name, "emails": F.when(kept("emails"), F.col("_emails")).otherwise(F.col("emails")), "phones": F.when(kept("phones"), F.col("_phones")).otherwise(F.col("phones")), "completion_score": score}
    return new.join(was, "company_id", "left").withColumns(values).select(new.columns)


def provider_metrics(answers: DataFrame) -> DataFrame:
    """One row of counters over answers (query, provider, status_code), where provider is "primary" or "fallback": requests, successes
    and failures of either, and the share of queries that went on to the fallback."""
    of = lambda name, test: F.count_if((F.col("provider") == name) & test)
    ok = F.col("status_code") == 200
    counts = [of(p, test).alias(f"{p}_{what}") for p in ("primary", "fallback") for what, test in (("requests", F.lit(True)), ("successes", ok), ("failures", ~ok))]
    return answers.agg(*counts).withColumn("fallback_rate", F.when(F.col("primary_requests") == 0, 0.0).otherwise(F.col("fallback_requests") / F.col("primary_requests")))


def platform_metrics(sites: DataFrame, site: str) -> DataFrame:
    """(rejected, social, skipped): sites on platforms that can't be crawled, those among them that are profiles, and crawl jobs skipped."""
    kind = urls.crawlability(F.col(site))
    return sites.agg(F.count_if(kind != "CRAWLABLE").alias("rejected"), F.count_if(kind == "SOCIAL_PROFILE").alias("social"), F.count_if(kind == "NON_CRAWLABLE_PLATFORM").alias("skipped"))


def month_usage(users: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """``users`` (user_id) with what they used in a month by ``usage`` (user_id, month, used); 0 where there is nothing."""
    used = usage.where(F.col("month") == month).groupBy("user_id").agg(F.sum("used").alias("used_this_month"))
    return users.join(used, "user_id", "left").fillna(0, ["used_this_month"])


REGISTRY_QUERIES = ("списък {persona} {location}", "регистър {persona} {location}", "{persona} {location} община")


def registry_queries(searches: DataFrame) -> DataFrame:
    """(…, nth, query): the fixed searches after registries for a persona of education; none for others."""
    filled = [F.replace(F.replace(F.lit(q), F.lit("{persona}"), F.trim("persona")), F.lit("{location}"), F.trim("location")) for q in REGISTRY_QUERIES]
    return searches.where(decide.is_education(F.col("persona"))).select("*", F.posexplode(F.array(*filled)).alias("nth", "query"))


ENRICHMENT = "Domain|Name|Description|Location|Emails|Phones|Services|Team|Facebook|LinkedIn|Other Social|Completion Score|Crawl Status|Crawl Note|Login Protected|Email Subject|Outreach Message|Campaign Email".split("|")


def enrichment_columns(companies: DataFrame) -> dict[str, Column]:
    """The columns of ENRICHMENT of a company, as an export shows them: lists joined, '' for what is missing, 0 for no score."""
    there = {c.lower() for c in companies.columns}
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in there else F.lit("")
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    social = lambda k: F.coalesce(F.element_at("social", F.lit(k)), F.lit(""))
    pairs = F.filter(F.array_sort(F.map_entries(F.coalesce("social", F.create_map().cast("map<string, string>")))), lambda e: ~e["key"].isin("facebook", "linkedin") & (F.coalesce(e["value"], F.lit("")) != ""))
    others = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")
    login = F.when(F.coalesce(F.col("login_protected"), F.lit(False)), "Yes").otherwise("No") if "login_protected" in there else F.lit("No")
    score = F.coalesce(F.col("completion_score").cast("int"), F.lit(0)) if "completion_score" in there else F.lit(0)
    values = [said("domain"), said("name"), said("description"), said("location"), listed("emails"), listed("phones"), listed("services"), team_line(F.col("team")), social("facebook"), social("linkedin"), others, score, said("crawl_status"), said("crawl_note"), login, said("email_subject"), said("outreach_message"), said("campaign_email")]
    return dict(zip(ENRICHMENT, values))


def enrichment_rows(companies: DataFrame) -> DataFrame:
    """The plain export: one row for each company with the columns of ENRICHMENT, oldest company first where that is known."""
    order = [c for c in ("created_at", "domain") if c in companies.columns]
    return companies.orderBy(*order).select(*(v.alias(k) for k, v in enrichment_columns(companies).items()))


def lead_rows(companies: DataFrame) -> DataFrame:
    """The lead export: a row for each person with a name, one with blanks where there is none. Empty is '', never null.
    Companies come oldest first where created_at is there, then by domain, their people in order."""
    text_ = lambda c: F.coalesce(F.col(c), F.lit(""))
    person = "struct<name: string, position: string, email: string, linkedin: string>"
    named = F.filter(F.coalesce(F.col("team").cast(f"array<{person}>"), F.array().cast(f"array<{person}>")), lambda m: F.trim(F.coalesce(m["name"], F.lit(""))) != "")
    rows = companies.select("*", F.posexplode_outer(named).alias("member_ord", "_m"))
    words = F.filter(F.split(F.trim(F.coalesce(F.col("_m.name"), F.lit(""))), r"\s+"), lambda w: w != "")
    of = lambda field: F.coalesce(F.col(f"_m.{field}"), F.lit(""))
    site = F.when(text_("domain") == "", "").when(F.lower("domain").rlike("^https?://"), F.col("domain")).otherwise(F.concat(F.lit("https://"), "domain"))
    social = lambda k: F.coalesce(F.element_at("social", F.lit(k)), F.lit(""))
    head = {
        "First Name": F.coalesce(F.get(words, F.lit(0)), F.lit("")), "Last Name": F.array_join(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), " "), "Job Title": of("position"), "Email": of("email"), "Linkedin URL": of("linkedin"), "Facebook URL": social("facebook"),
        "Company": text_("name"), "Website": site, "Office Email": F.coalesce(F.get("emails", F.lit(0)), F.lit("")), "Telephone": F.coalesce(F.array_join("phones", ", "), F.lit("")), "Company Linkedin": social("linkedin"), "Size": F.lit(""), "Industry": text_("industry"), "Location": text_("location"),
    }
    return rows.orderBy(*(c for c in ("created_at",) if c in companies.columns), "domain", "member_ord").select(*(c.alias(k) for k, c in head.items()))


def team_line(team: Column) -> Column:
    """Name (position) <email>; ..."""
    some = lambda c: F.coalesce(c, F.lit(""))

    def one(m: Column) -> Column:
        role = F.when(some(m["position"]) == "", "").when(some(m["name"]) == "", m["position"]).otherwise(F.concat(F.lit(" ("), m["position"], F.lit(")")))
        return F.trim(F.concat(some(m["name"]), role, F.when(some(m["email"]) == "", "").otherwise(F.concat(F.lit(" <"), m["email"], F.lit(">")))))

    return F.coalesce(F.array_join(F.filter(F.transform(team, one), lambda x: x != ""), "; "), F.lit(""))


def outreach_prompt(template: Column, fields: dict[str, Column]) -> Column:
    """A template with its {{placeholders}} filled; what is missing says so."""
    out = template
    for name, value in fields.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("n/a")))
    return out


def batch_admins(users: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (user_id, role) that may be applied: nobody takes away the last administrator's role.

    Only changes that take the role away are counted, and never more of them than there are administrators.
    """
    own = changes.join(users.select("user_id", F.col("role").alias("_old")), "user_id")
    losing = (F.col("_old") == "ADMIN") & (F.col("role") != "ADMIN")
    staying = users.where("role = 'ADMIN'").join(changes.where("role <> 'ADMIN'").select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("_left"))
    last = own.where(losing).agg(F.max("user_id").alias("_last"))
    # in the order of users, all but the last may go; the last only if another administrator stays
    told = own.crossJoin(F.broadcast(staying)).crossJoin(F.broadcast(last))  # of one row each
    return told.withColumn("allowed", ~losing | (F.col("_left") > 0) | (F.col("user_id") != F.col("_last"))).select("user_id", "role", "allowed")
