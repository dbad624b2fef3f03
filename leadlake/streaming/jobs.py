"""The flow of crawl jobs as a stream: states, retries with growing pauses, and counts that never count twice."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadlake.operators.graph import shared_folder

#: Queue: how often a job is tried again, the pause in seconds, and whether pauses double.
RETRY = {"crawl": (3, 60, True), "discover": (2, 30, False), "personalize": (2, 30, True)}
#: No event takes a company back out of COMPLETED.
STATES = {"start": "CRAWLING", "done": "COMPLETED", "blocked": "BLOCKED"}


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 5) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _advance(queue: str):
    retries, pause, doubles = RETRY[queue]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, tries, due = state.get if state.exists else ("PENDING", 0, None)
        if state.hasTimedOut:
            now, due = "DUE", None
        for rows in batches:
            for kind, moment in rows.sort_values(["ts", "kind"])[["kind", "ts"]].itertuples(index=False):
                if now == "COMPLETED":
                    break
                if kind == "fail":
                    tries += 1
                    now = "PENDING" if tries <= retries else "FAILED"
                    due = moment + pd.Timedelta(seconds=pause * (2 ** (tries - 1) if doubles else 1)) if now == "PENDING" else None
                elif kind in STATES:
                    now, due = STATES[kind], None
        state.update((now, tries, due))
        if due is not None and (mark := state.getCurrentWatermarkMs()) >= 0:
            state.setTimeoutTimestamp(max(mark + 1, int(pd.Timestamp(due).timestamp() * 1000)))
        yield pd.DataFrame({"company_id": [key[0]], "status": [now], "tries": [tries], "due": pd.Series([due], dtype="datetime64[us]")})

    return run


def job_states(events: DataFrame, queue: str = "crawl", late: str = "10 seconds") -> DataFrame:
    """(company_id, status, tries, due) after each micro-batch, from events (company_id, kind, ts).

    ``queue`` names the retry policy. When the watermark passes the time at which a failed job is due, the job is given out again
    as DUE, by the state's own timeout.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy("company_id").applyInPandasWithState(_advance(queue), "company_id long, status string, tries int, due timestamp", "status string, tries int, due timestamp", "update", GroupStateTimeout.EventTimeTimeout)


def keep_table(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Writes each micro-batch into a versioned table: the newest row of a key replaces the one before. A batch that is run again
    after a failure writes the same version again. Returns the writer, not yet started."""

    def write(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        new = rows.dropDuplicates(keys)
        if number:
            old = session.read.parquet(f"{path}/v{number - 1:09d}")
            new = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/v{number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def deduplicated(events: DataFrame, key: str = "event_id", moment: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, as long as the watermark remembers it."""
    return events.withWatermark(moment, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, moment: str = "ts", width: str = "1 day", late: str = "1 day", *by: str) -> DataFrame:
    counted = events.withWatermark(moment, late).groupBy(F.window(moment, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, through the stream's own plan, into a table in memory: for streams of aggregates, whose results are
    few. Its progress is kept in ``checkpoint``, or in a folder of its own in the shared folder of the cluster."""
    where = checkpoint or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", where).start().awaitTermination()
    return stream.sparkSession.table(name)
