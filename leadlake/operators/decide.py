"""Verdicts on candidates: signals in a fixed order, folded into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import text, urls

REVIEW, ACCEPT = 40, 60
CHUNK = 15
NEGATIVE = {"MUNICIPALITY_PAGE": "MUNICIPALITY_PAGE", "DIRECTORY_OR_PORTAL": "DIRECTORY_OR_PORTAL", "NEWS_ARTICLE": "NEWS_ARTICLE", "SOCIAL_PAGE": "SOCIAL_PLATFORM", "OFFICIAL_REGISTRY": "OFFICIAL_REGISTRY", "IRRELEVANT": "NOT_TARGET_ORGANIZATION"}
CONFIDENCE = {"kept": 70, "review": 45, "filtered": 20, "blocked": 0}
SIGNALS = "array<struct<criterion: string, effect: string, stage: string, weight: int>>"


def signal(criterion: str | Column, effect: str, stage: str, weight: int = 0) -> Column:
    named = F.lit(criterion) if isinstance(criterion, str) else criterion
    return F.struct(named.alias("criterion"), F.lit(effect).alias("effect"), F.lit(stage).alias("stage"), F.lit(weight).alias("weight"))


def fold(signals: Column) -> Column:
    """struct(verdict, reason): the first REJECT, else the first REVIEW, else the first ACCEPT."""
    first = lambda effect: F.get(F.filter(signals, lambda s: s["effect"] == effect), F.lit(0))["criterion"]
    reject, review = first("REJECT"), first("REVIEW")
    verdict = F.when(reject.isNotNull(), "REJECT").when(review.isNotNull(), "REVIEW").otherwise("ACCEPT")
    return F.struct(verdict.alias("verdict"), F.coalesce(reject, review, first("ACCEPT"), F.lit("MATCHES_PERSONA_AND_LOCATION")).alias("reason"))


def is_education(persona: Column) -> Column:
    return F.lower(persona).rlike(r"(?iu)училищ|гимнази|детск\S* градин|детск\S* ясл|школ|school|kindergarten|(?<![\p{L}\p{N}])(?:дг|оу|су|ну|пг|цдг|одз)(?![\p{L}\p{N}])")


_SCHOOL = r"(?iu)^\s*[«„“\"']?(?:сред|основ|начал|професионал|профилиран|детска градина|цдг|одз|ддуи|пмг|пгсаг|дг|оу|су|ну|пг|соу|сменг|ег)(?![\p{L}\p{N}])"
_LESSON = r"(?iu)училищ|гимнази|детск\S* градин|детск\S* ясл|колеж|school|kindergarten|college"
_WRONG = (("MUNICIPALITY_PAGE", "(?iu)община|общински"), ("OFFICIAL_REGISTRY", "(?iu)регистър|списък"), ("DIRECTORY_OR_PORTAL", "(?iu)каталог|класация|пътеводител|портал|справочник|directory|guide|ranking"), ("NEWS_ARTICLE", "(?iu)новини|news"))


def education(name: Column, domain: Column, email: Column, phone: Column, extracted: Column) -> Column:
    """struct(accepted, score, reason) of a candidate for a search after schools."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    school = name.rlike(_SCHOOL) | name.rlike(_LESSON)
    wrong = F.coalesce(*(F.when(~school & name.rlike(p), code) for code, p in _WRONG), F.when(~extracted & some(domain) & domain.rlike("(?i)catalog|directory|guide|portal|regist(?:ar|er)|spravochnik"), "DIRECTORY_OR_PORTAL"))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = F.lit(30) + points(name.rlike(_SCHOOL), 40) + points(name.rlike(_LESSON), 20) + points(some(domain) & ~domain.endswith(".local"), 10) + points(some(email) | some(phone), 10)
    return F.struct((wrong.isNull() & (score >= 60)).alias("accepted"), F.when(wrong.isNotNull(), 0).otherwise(score).alias("score"), F.coalesce(wrong, F.when(score < 60, "NOT_TARGET_ORGANIZATION")).alias("reason"))


def qualify(candidates: DataFrame, persona: Column, location: Column) -> DataFrame:
    """``candidates`` with signals, confidence, verdict and reason.

    Columns: domain, website_url, page_type, extracted_from, email, phone, name, title, snippet, address, confidence, signals.
    """
    c, some = F.col, lambda x: F.coalesce(x, F.lit("")) != ""
    extracted = some(c("extracted_from"))
    social = F.coalesce(urls.is_platform(c("domain")), F.lit(False)) | F.coalesce(urls.is_platform(c("website_url")), F.lit(False))
    negative = F.element_at(F.create_map(*(F.lit(x) for pair in NEGATIVE.items() for x in pair)), c("page_type"))
    fatal = negative.isNotNull() & (~extracted | c("page_type").isin("OFFICIAL_REGISTRY", "SOCIAL_PAGE"))
    same = extracted & some(c("domain")) & (c("domain") == urls.bare_host(c("extracted_from")))
    contact = (some(c("domain")) & ~c("domain").endswith(".local")) | some(c("email")) | some(c("phone"))
    listed = extracted & negative.isNull()
    checked = F.exists("signals", lambda s: s["stage"] == "location")
    place = text.location_signal(F.concat_ws(" ", "name", "title", "snippet", "address"), location)["kind"]
    near, away = ~checked & (place == "match"), ~checked & (place == "conflict")
    name = F.coalesce(c("name"), c("title"))
    school = education(F.trim(name), c("domain"), c("email"), c("phone"), extracted)
    asked = is_education(persona) & name.isNotNull()
    level = F.greatest(F.lit(0), F.least(F.lit(100), c("confidence") + F.when(listed, 10).otherwise(0) + F.when(near, 15).otherwise(0) + F.when(asked & school["accepted"], 10).otherwise(0)))
    rows = [
        F.when(social, signal("SOCIAL_PLATFORM", "REJECT", "qualifier")),
        F.when(fatal, signal(negative, "REJECT", "classifier")),
        F.when(same, signal("SAME_DOMAIN_AS_SOURCE", "REJECT", "qualifier")),
        F.when(~contact, signal("NO_CONTACT_SIGNAL", "REJECT", "qualifier")),
        F.when(listed, signal("EXTRACTED_FROM_LIST", "ACCEPT", "qualifier", 10)),
        F.when(near, signal("MATCHES_PERSONA_AND_LOCATION", "ACCEPT", "location", 15)).when(away, signal("LOCATION_CONFLICT", "REVIEW", "location")),
        F.when(asked & school["accepted"], signal("MATCHES_PERSONA_AND_LOCATION", "ACCEPT", "qualifier", 10)).when(asked & school["reason"].isNotNull(), signal(school["reason"], "REJECT", "qualifier")),
        F.when(level < REVIEW, signal("BELOW_CONFIDENCE_FLOOR", "REJECT", "qualifier")).when(level < ACCEPT, signal("BORDERLINE_CONFIDENCE", "REVIEW", "qualifier")),
    ]
    every = F.concat(F.col("signals").cast(SIGNALS), F.filter(F.array(*(r.cast(SIGNALS[6:-1]) for r in rows)), lambda s: s.isNotNull()))
    every = F.when(F.exists(every, lambda s: s["effect"] == "ACCEPT"), every).otherwise(F.concat(every, F.array(signal("MATCHES_PERSONA_AND_LOCATION", "ACCEPT", "qualifier").cast(SIGNALS[6:-1]))))
    out = candidates.withColumn("_signals", every).withColumn("confidence", level)
    return out.withColumn("signals", F.col("_signals")).drop("_signals").withColumn("_fold", fold(F.col("signals"))).select("*", F.col("_fold.verdict").alias("verdict"), F.col("_fold.reason").alias("reason")).drop("_fold")


def stored(domain: Column, page_type: Column, extracted_from: Column, verdict: Column, reason: Column) -> Column:
    """struct(status, reason) of a candidate as it is written: KEPT, REVIEW, FILTERED or BLOCKED.

    A blocklisted page that was no source of others is BLOCKED, a platform that can't be crawled FILTERED; both outrank the
    verdict. The platform's reason goes before the blocklist's, that before the verdict's own.
    """
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    platform = some(domain) & F.coalesce(urls.is_platform(domain), F.lit(False))
    blocked = F.coalesce(page_type == "IRRELEVANT", F.lit(False)) & ~some(extracted_from)
    status = F.when(blocked, "BLOCKED").when(platform, "FILTERED").when(verdict == "ACCEPT", "KEPT").when(verdict == "REVIEW", "REVIEW").otherwise("FILTERED")
    return F.struct(status.alias("status"), F.when(platform, "NON_CRAWLABLE_PLATFORM").when(blocked, "BLOCKLISTED_AGGREGATOR").otherwise(reason).alias("reason"))


def stored_domain(domain: Column, name: Column, source_url: Column) -> Column:
    """The domain, or one made of the first bytes of the name (or address) for an organisation that has no site."""
    stem = F.substring(F.lower(F.hex(F.encode(F.substring(F.coalesce(name, source_url), 1, 40), "UTF-8"))), 1, 16)
    return F.coalesce(domain, F.concat(F.lit("extracted-"), stem, F.lit(".local")))


#: The page type that a rejected search result is given, by the reason.
REJECTED_TYPES = {"BLOCKLISTED_AGGREGATOR": "DIRECTORY_OR_PORTAL", "DIRECTORY_OR_PORTAL": "DIRECTORY_OR_PORTAL", "LOCATION_CONFLICT": "IRRELEVANT", "MUNICIPALITY_PAGE": "MUNICIPALITY_PAGE", "NEWS_ARTICLE": "NEWS_ARTICLE", "NOT_TARGET_ORGANIZATION": "IRRELEVANT", "OFFICIAL_REGISTRY": "OFFICIAL_REGISTRY", "SOCIAL_PLATFORM": "SOCIAL_PAGE"}


def _of(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def search_candidate(status: Column, reason: Column) -> Column:
    """struct(confidence, page_type) of a search result by what the search stage said of it."""
    page_type = F.when(status == "blocked", "IRRELEVANT").when(status == "filtered", F.coalesce(_of(REJECTED_TYPES, reason), F.lit("UNKNOWN"))).otherwise("UNKNOWN")
    return F.struct(_of(CONFIDENCE, status).alias("confidence"), page_type.alias("page_type"))


LIST_PAGES = ("DIRECTORY_OR_PORTAL", "MUNICIPALITY_PAGE", "OFFICIAL_REGISTRY")
SUSPECTS = 5
#: The least score at which address, title and snippet decide a page's type: a model's approval takes more to overrule.
META_LEAST, META_LEAST_APPROVED = 30, 60


def meta_classified(candidates: DataFrame, meta_type: Column) -> DataFrame:
    """``candidates`` (page_type, signals) with unknown types told from ``meta_type`` and a signal for it; a page on the blocklist is only
    ever raised to a list page, which is worth reading for the organisations on it, never to a target."""
    kind = F.when(F.col("page_type") == "IRRELEVANT", F.when(meta_type.isin(*LIST_PAGES), meta_type).otherwise("IRRELEVANT")).when(F.col("page_type") == "UNKNOWN", meta_type).otherwise(F.col("page_type"))
    told = (F.col("page_type") == "UNKNOWN") & (meta_type != "UNKNOWN")
    code = F.when(meta_type == "TARGET_ORGANIZATION", "MATCHES_PERSONA_AND_LOCATION").otherwise(_of(NEGATIVE, meta_type))
    effect = F.when(meta_type == "TARGET_ORGANIZATION", "ACCEPT").otherwise("REJECT")
    new = F.struct(code.alias("criterion"), effect.alias("effect"), F.lit("classifier").alias("stage"), F.lit(0).alias("weight")).cast(SIGNALS[6:-1])
    signals = F.col("signals").cast(SIGNALS)
    return candidates.withColumns({"signals": F.when(told, F.array_append(signals, new)).otherwise(signals), "page_type": kind})


def suspects(candidates: DataFrame, batch: list[str], order: list[Column]) -> DataFrame:
    """(batch, source_url): the first SUSPECTS distinct list pages of each batch, whose content is then looked at."""
    listed = candidates.where(F.col("page_type").isin(*LIST_PAGES))
    once = listed.withColumn("_n", F.row_number().over(Window.partitionBy(*batch, "source_url").orderBy(*order))).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(*batch).orderBy(*order))).where(F.col("_n") <= SUSPECTS).select(*batch, "source_url")


def confirmed(candidates: DataFrame, content: DataFrame, batch: list[str]) -> DataFrame:
    """``candidates`` with the page type that the content of their page (batch, source_url, content_type) has shown, where it was read."""
    told = content.select(*batch, "source_url", "content_type").dropDuplicates([*batch, "source_url"])
    return candidates.join(told, [*batch, "source_url"], "left").withColumn("page_type", F.coalesce("content_type", "page_type")).drop("content_type").select(candidates.columns)


def chunked(df: DataFrame, order: list[Column], batch: list[str], size: int = CHUNK) -> DataFrame:
    """Adds the chunk and the place in it, by batch; ``size`` rows a chunk."""
    nth = F.row_number().over(Window.partitionBy(*batch).orderBy(*order)) - 1
    return df.withColumn("_n", nth).withColumn("chunk", F.floor(F.col("_n") / size)).withColumn("idx", F.col("_n") % size).drop("_n")


#: Reasons that a model may give.
MODEL_REASONS = ("DIRECTORY_OR_PORTAL", "LOCATION_CONFLICT", "MUNICIPALITY_PAGE", "NEWS_ARTICLE", "NOT_TARGET_ORGANIZATION", "OFFICIAL_REGISTRY")
APPROVED_WEIGHT = 40


def apply_verdicts(candidates: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with status, status_reason and llm_approved from answers (``keys``, decision, code); the last of ``keys`` is the place in a chunk.

    A chunk that got no answer at all is degraded: all of it goes to review, as does a whole batch without a model. In an
    answered chunk a missing answer and an unsure one mean review too; KEEP approves, anything else rejects, for its reason if
    that is one a model may give. Each case leaves a signal, where candidates have signals.
    """
    chunk = keys[:-1]
    judged = answers.select(*chunk).distinct().withColumn("_judged", F.lit(True))
    joined = candidates.join(answers.select(*keys, "decision", "code"), keys, "left").join(judged, chunk, "left")
    degraded, keep = F.col("_judged").isNull(), F.col("decision") == "KEEP"
    code = F.when(F.col("code").isin(*MODEL_REASONS), F.col("code")).otherwise("NOT_TARGET_ORGANIZATION")
    review = F.when(degraded, "FILTER_DEGRADED").when(F.col("decision").isNull(), "LLM_UNJUDGED").when(F.col("decision") == "UNSURE", "LLM_UNCERTAIN")
    status = F.when(review.isNotNull(), "review").when(keep, "kept").otherwise("filtered")
    reason = F.coalesce(review, F.when(~keep, code))
    out = joined.withColumns({"status": status, "status_reason": reason, "llm_approved": F.coalesce(keep & review.isNull(), F.lit(False))})
    if "signals" in candidates.columns:
        effect = F.when(review.isNotNull(), "REVIEW").when(keep, "ACCEPT").otherwise("REJECT")
        new = F.struct(F.coalesce(reason, F.lit("MATCHES_PERSONA_AND_LOCATION")).alias("criterion"), effect.alias("effect"), F.lit("llm").alias("stage"), F.when(effect == "ACCEPT", APPROVED_WEIGHT).otherwise(0).alias("weight"))
        out = out.withColumn("signals", F.array_append(F.col("signals").cast(SIGNALS), new.cast(SIGNALS[6:-1])))
    return out.drop("_judged")
