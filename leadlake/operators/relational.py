"""Relational building blocks: tenant scope, pages, upserts, first-of-group and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    return df.where(F.col(column) == tenant)


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 50, most: int = 200) -> DataFrame:
    """One page of a total order; ``number`` below 1 is 1, ``limit`` is held within 1 and ``most``. Spark takes the first
    number * limit rows of each partition and merges them; nothing is sorted as a whole."""
    limit = min(most, max(1, limit))
    return df.orderBy(*order).offset((max(1, number) - 1) * limit).limit(limit)


def page_count(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / limit).cast("long").alias("pages"))


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_empty: list[str] = []) -> DataFrame:
    """``old`` with the rows of ``new``; in columns of ``keep_if_empty``, a null or '' of ``new`` leaves the old value."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    there = F.col(f"n.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keys or c not in new.columns:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
        fresh = F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")) if c in keep_if_empty else F.col(f"n.{c}")
        return F.when(there, fresh).otherwise(F.col(f"o.{c}"))

    return joined.select(*(value(c).alias(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it has not; of new rows with one key, the first in ``order``."""
    return old.unionByName(first_of(new, keys, order).join(old.select(*keys), keys, "left_anti"))


def delete_by(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str], parent: str) -> dict[str, DataFrame]:
    """All tables without the rows that belong to the parents in ``gone``; ``keys`` names each table's reference."""
    return {name: df.join(gone.select(F.col(parent).alias(keys[name])).distinct(), keys[name], "left_anti") if name in keys else df for name, df in tables.items()}


def remap(column: Column, codes: dict[str, str]) -> Column:
    """New codes for old ones; others stay."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), column), column)


def only_default(df: DataFrame, group: str, chosen: Column, key: str) -> DataFrame:
    """Exactly the chosen row of each group is the default."""
    return df.withColumn("is_default", F.coalesce(F.col(key) == F.max(F.when(chosen, F.col(key))).over(Window.partitionBy(group)), F.lit(False)))


def survivors(df: DataFrame, keys: list[str], score: Column, updated: str, ident: str) -> DataFrame:
    """Of each group the row of the highest score, then the newest, then the least id."""
    return first_of(df.withColumn("_score", score), keys, [F.desc("_score"), F.desc(updated), F.asc(ident)]).drop("_score")


def raw_survivors(rows: DataFrame, keys: list[str], updated: str, ident: str) -> DataFrame:
    """Duplicates of raw pages (``keys``, text, emails, phones) as one row each: the richest survives (characters of text, 100 an
    address, 50 a number; then the newest, then the least id) with the addresses and numbers of all, newest first, and the
    longest text, of equal ones the newest."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    score = F.length(F.coalesce("text", F.lit(""))) + size("emails") * 100 + size("phones") * 50
    best = lambda *order: F.max_by(ident, F.struct(*order))
    newest_first = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.unix_micros(F.col(updated).cast("timestamp")).alias("t"), (-F.col(ident)).alias("i"), F.coalesce(c, F.array().cast("array<string>")).alias("v"))), asc=False), lambda x: x["v"])))
    longest = F.max_by(F.coalesce("text", F.lit("")), F.struct(F.length(F.coalesce("text", F.lit(""))), F.col(updated), -F.col(ident)))
    return rows.groupBy(*keys).agg(best(score, F.col(updated), -F.col(ident)).alias(ident), longest.alias("text"), newest_first("emails").alias("emails"), newest_first("phones").alias("phones"), (F.count("*") - 1).alias("removed"))


def freshness_summary(rows: DataFrame, updated: str, now: Column, days: int = 7) -> DataFrame:
    """(fresh, stale): rows younger than ``days`` days, or just as old, and older ones."""
    stale = F.col(updated).cast("timestamp") < now.cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return rows.agg(F.count_if(~stale).alias("fresh"), F.count_if(stale).alias("stale"))


def json_page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 50, most: int = 200) -> DataFrame:
    """(body): one page as JSON text, its rows in order and the numbers of the pagination. A page has ``most`` rows at most."""
    limit, number = min(most, max(1, limit)), max(1, number)
    place = F.row_number().over(Window.orderBy(*order))  # of one page only
    rows = page(df, order, number, limit, most).select(place.alias("_n"), F.struct(*df.columns).alias("_row"))
    data = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_row"))), lambda x: x["_row"]).alias("data"))
    total = df.agg(F.count("*").alias("total"))
    told = F.struct(F.lit(number).alias("page"), F.lit(limit).alias("limit"), F.col("total"), F.ceil(F.col("total") / limit).cast("long").alias("pages"))
    return data.crossJoin(total).select(F.to_json(F.struct("data", told.alias("pagination")), {"ignoreNullFields": "false"}).alias("body"))  # two tables of one row
