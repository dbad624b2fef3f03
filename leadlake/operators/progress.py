"""Batch progress, freshness and cache decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("BLOCKED", "COMPLETED", "FAILED")
PROFILE_DAYS, PAGE_DAYS, SEARCH_DAYS, DISCOVERY_DAYS = 30, 7, 7, 30
LEAST_SCORE = 50


def batch_counts(bridge: DataFrame, companies: DataFrame, batch: str, company: str, status: str) -> DataFrame:
    """(batch, total, done) in one pass: members, and members whose crawl has ended."""
    joined = bridge.select(batch, company).join(companies.select(company, status), company)
    return joined.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(F.col(status).isin(*TERMINAL)).alias("done"))


def progress(stored: Column, total: Column, done: Column) -> Column:
    """struct(total_companies, processed_companies, percentage, status). Ended batches keep their status; a running one
    without members is at 0 %, one with all members done has ended."""
    total = F.greatest(F.lit(0), total)
    done = F.least(F.greatest(F.lit(0), done), total)
    ratio = F.when(total > 0, done / F.nullif(total, F.lit(0)) * 100).otherwise(0.0)
    status = F.when(stored.isin("COMPLETED", "FAILED"), stored).when((total > 0) & (done >= total), "COMPLETED").otherwise("PROCESSING")
    return F.struct(total.alias("total_companies"), F.when(stored == "COMPLETED", total).otherwise(done).alias("processed_companies"), F.when(stored == "COMPLETED", 100.0).otherwise(ratio).alias("percentage"), status.alias("status"))


def _age(moment: Column, now: Column) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))


def _days(n: int) -> int:
    return n * 86_400_000_000


def freshness(status: Column, crawled: Column, has_profile: Column, score: Column, mails: Column, phones: Column, name: Column, description: Column, now: Column, force: Column) -> Column:
    """struct(skip, reason): whether a stored profile is good enough to skip a crawl, by the first rule that says not."""
    lacks = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = (
        F.when(F.coalesce(force, F.lit(False)), "forced")
        .when(status.isin("BLOCKED", "FAILED", "PENDING"), F.concat(F.lit("status "), status))
        .when(crawled.isNull(), "never crawled")
        .when(_age(crawled, now) >= _days(PROFILE_DAYS), "stale")
        .when(~has_profile, "no profile")
        .when(score < LEAST_SCORE, "low score")
        .when((F.coalesce(mails, F.lit(0)) == 0) & (F.coalesce(phones, F.lit(0)) == 0), "no contact")
        .when(lacks(name) & lacks(description), "no name")
        .otherwise("fresh")
    )
    return F.struct((reason == "fresh").alias("skip"), reason.alias("reason"))


def page_action(updated: Column, now: Column) -> Column:
    """create, skip (younger than a week) or update."""
    return F.when(updated.isNull(), "create").when(_age(updated, now) < _days(PAGE_DAYS), "skip").otherwise("update")


def search_is_cached(stored: Column, now: Column) -> Column:
    """A search result holds up to and with seven days."""
    return F.coalesce(_age(stored, now) <= _days(SEARCH_DAYS), F.lit(False))


def discovery_is_cached(stored: Column, now: Column) -> Column:
    return F.coalesce(stored.cast("timestamp") >= now.cast("timestamp") - F.expr(f"INTERVAL {DISCOVERY_DAYS} DAYS"), F.lit(False))


def _weeks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (user, t, n) sorted by user and time: (user, used, reset_at) of each user's last week. Only the open week is kept."""
    week = _days(7)
    user, start, used = None, None, 0.0
    empty = True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, times, amounts = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        out = []
        edge = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for low, high in zip(edge, edge[1:]):
            if empty or keys[low] != user:
                if not empty:
                    out.append((user, used, start))
                user, start, used, empty = keys[low], int(times[low]), 0.0, False
            at = low
            while at < high:  # a step a week, not a use
                end = at + int(np.searchsorted(times[at:high], start + week, "left"))
                used += float(amounts[at:end].sum())
                if end < high:
                    start, used = int(times[end]), 0.0
                at = end
        yield _told(out, batch.schema.field(0).type)
    if not empty:
        yield _told([(user, used, start)], batch.schema.field(0).type)


def _told(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], ["user", "used", "t"])


def weekly_usage(events: DataFrame, user: str, moment: str, amount: str) -> DataFrame:
    """(user, used, reset_at): a week starts with the first use after the week before has run out.

    One shuffle by user; the uses of a user then stream by in time order, however many there are, and only the open week is
    held. Uses without a time are left out, a null amount counts as 0.
    """
    uses = events.where(F.col(moment).isNotNull()).select(F.col(user).alias("user"), F.unix_micros(F.col(moment).cast("timestamp")).alias("t"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("n"))
    kind = uses.schema["user"].dataType.simpleString()
    folded = uses.repartition("user").sortWithinPartitions("user", "t").mapInArrow(_weeks, f"user {kind}, used double, t long")
    return folded.select(F.col("user").alias(user), "used", F.timestamp_micros("t").alias("reset_at"))
