"""Operator 4: URL filters over redirect equivalence.

URLs that differ in scheme, "www.", default port, fragment, tracking parameters or a last slash are one node. Edges are what
pages say of themselves (canonical link, og:url, a refresh that sends on), the mobile hosts that stand for a site, and
redirects where a table of them is given; pages in one connected component are aliases, and a block that hits one of them
holds for all. An explicit allow of a page's own URL takes precedence over every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm._graph import connected_components, durable

#: A host is blocked when one of its labels, split at hyphens, is one of these words.
BLOCK_WORDS = ("bets", "casino", "pills", "porn", "poker", "viagra", "xxx", "warez")
#: Hosts that are blocked or allowed with all their subdomains.
BLOCK_HOSTS: tuple[str, ...] = ()
ALLOW_HOSTS: tuple[str, ...] = ()
#: First labels of hosts that stand for the site behind them.
MOBILE = r"^(?:amp|m|mobile|touch)\.(?=[^/?:]*\.)"
TRACKING = "(?:utm_[a-z]+|ref|gclid|fbclid|mc_cid|mc_eid|igshid)"


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """The node of a URL: host, port unless default, path without a last slash, query without tracking; null stays null."""
    url = F.trim(url)
    port = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)", 1)
    port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.regexp_replace(query, rf"(?:^|&){TRACKING}(?:=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(url_host(url), port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, without its quotes; '' if there is none."""
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", 0)
    return F.trim(F.regexp_replace(value, rf"(?is)^\s*{name}\s*=\s*[\"']?|[\"']$", ""))


def said_targets(html: Column) -> Column:
    """The addresses that a page gives for itself, as they are written: canonical link, og:url, refresh; '' where there is none."""
    shared = _attribute(F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*[\"']?og:url\b)[^>]*>", 0), "content")
    sent = _attribute(F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>", 0), "content")
    target = F.regexp_replace(F.regexp_extract(sent, r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*(.*)$", 1), r"^[\"']|[\"']$", "")
    return F.array(canonical_link(html), shared, F.trim(target))


def canonical_link(html: Column) -> Column:
    """The target of the first <link rel=canonical>, as it is written; '' if there is none."""
    return _attribute(F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>", 0), "href")


def without_dots(url: Column) -> Column:
    """A URL whose path has no "." and ".." segments left; one above the top is dropped."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    parts = F.split(rest, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, p: F.when(p == ".", out).when(p == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(p))))
    path = F.array_join(kept, "/")
    path = F.when(rest.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    return F.when((site != "") & rest.rlike(r"/\.\.?(?:/|$)"), F.concat(site, path, tail)).otherwise(url)


def _resolved(target: Column, base: Column) -> Column:
    """An absolute form of a link on a page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return without_dots(
        F.when(target == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(F.regexp_replace(folder, r"/$", ""), F.lit("/"), target))
    )


def _under(host: Column, hosts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for name in hosts:
        out = out | (host == name) | host.endswith("." + name)
    return out


def main_key(key: Column) -> Column:
    """The key of the site that a mobile host stands for; null where the host is none."""
    return F.when(key.rlike(MOBILE), F.regexp_replace(key, MOBILE, ""))


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, block_words: tuple[str, ...] = BLOCK_WORDS, block_hosts: tuple[str, ...] = BLOCK_HOSTS, allow_hosts: tuple[str, ...] = ALLOW_HOSTS, block_urls: tuple[str, ...] = (), allow_urls: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, key, component, decision, reason) for every row of ``pages`` (page_id, url, html).

    ``redirects`` is (source, target). component is the smallest key among the aliases. decision is "allow", "block" or
    "pass"; reason is "allowed", "blocked", "alias of a blocked URL" or "". Redirect targets and sources that are no page take
    part, so a block passes through them. Rule lists are parameters of a job, not data.

    Nulls and empties: a null URL has null key and component and passes; null html says nothing; URLs that can't be read have
    the key ''  and are no aliases of each other. Repeated rows are each decided. An empty table gives no row. Other
    columns aren't read.
    """
    html = F.col("html").cast("string")
    none = F.array().cast("array<string>")
    said = F.when(html.rlike(r"(?i)canonical|og:url|http-equiv"), said_targets(html)).otherwise(none)
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), said.alias("_said"))
    keyed = own.withColumn("key", url_key(F.col("url")))
    targets = F.transform(F.coalesce("_said", none), lambda t: url_key(_resolved(t, F.trim("url"))))
    edges = keyed.select(F.col("key").alias("u"), F.explode(F.concat(targets, F.array(main_key(F.col("key"))))).alias("v"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("source").cast("string")).alias("u"), url_key(F.col("target").cast("string")).alias("v")))
    edges = durable(edges.where("u is not null and v is not null and u <> '' and v <> '' and u <> v").distinct())
    groups = connected_components(edges)

    host = F.regexp_extract("key", r"^([^/?:]*)", 1)
    keys = lambda urls: [F.lit(u) for u in urls]
    listed = lambda urls: F.array_contains(F.array(*(url_key(u) for u in keys(urls))), F.col("key")) if urls else F.lit(False)
    words = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, block_words))) if block_words else F.lit(False)
    blocked = F.coalesce((F.col("key") != "") & (words | _under(host, block_hosts) | listed(block_urls)), F.lit(False))
    allowed = F.coalesce((F.col("key") != "") & (_under(host, allow_hosts) | listed(allow_urls)), F.lit(False))

    bad = groups.withColumnRenamed("node", "key").where(blocked).select(F.col("component").alias("_bad")).distinct()
    named = keyed.select("page_id", "url", "key", allowed.alias("_allow"), blocked.alias("_block")).join(groups.withColumnRenamed("node", "key"), "key", "left")
    told = named.join(bad, F.col("component") == F.col("_bad"), "left")
    reason = F.when(F.col("_allow"), "allowed").when(F.col("_block"), "blocked").when(F.col("_bad").isNotNull(), "alias of a blocked URL").otherwise("")
    decision = F.when(F.col("_allow"), "allow").when(F.col("_block") | F.col("_bad").isNotNull(), "block").otherwise("pass")
    return told.select("page_id", "url", "key", F.coalesce("component", "key").alias("component"), decision.alias("decision"), reason.alias("reason"))
