"""Entity resolution: candidates that share a domain, an e-mail, a phone or a name are one organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import contacts, text
from leadlake.operators.graph import connected_components

FILLED = ("email", "phone", "address", "domain", "website_url", "name")


def shared_keys(candidates: DataFrame) -> DataFrame:
    """(id, key) for each key that a candidate has; short names are no key."""
    some = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(kind + ":"), c))
    name = text.org_key(F.col("name"))
    keys = F.array(some("d", F.lower("domain")), some("e", F.lower(F.trim("email"))), some("p", contacts.candidate_phone_key(F.col("phone"))), contacts.let(name, lambda n: some("n", F.when(F.length(n) > 2, n))))
    return candidates.select("id", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def entities(candidates: DataFrame) -> DataFrame:
    """(id, entity): the smallest id of all candidates that are tied together, by any chain of shared keys.

    Each key ties its holders to the least of them, so a key with n holders is n edges, not n squared.
    """
    keys = shared_keys(candidates)
    low = keys.groupBy("key").agg(F.min("id").alias("v"))
    groups = connected_components(keys.join(low, "key").select(F.col("id").alias("u"), "v").where("u <> v").distinct())
    return candidates.select("id").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("entity"))


def merged(candidates: DataFrame) -> DataFrame:
    """One row for each entity: that of the highest confidence (then the first), its gaps filled from the others in that order."""
    own = candidates.join(entities(candidates), "id")
    order = Window.partitionBy("entity").orderBy(F.desc("confidence"), F.asc("id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = own.select("entity", *(F.first(F.nullif(c, F.lit("")), ignorenulls=True).over(whole).alias(c) if c in FILLED else F.col(c) for c in candidates.columns), F.count("*").over(Window.partitionBy("entity")).alias("members"), F.row_number().over(order).alias("_nth"))
    return filled.where("_nth = 1").drop("_nth")
