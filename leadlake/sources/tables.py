"""Reading lists of domains (CSV and XLSX) and stored search answers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions import urls

MOST_BYTES = 4 * 1024 * 1024
ENDINGS = (".csv", ".xls", ".xlsx")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, for work that is heavy a row.

    A table of fewer splits than the cluster has cores, such as one small file, is dealt out to all cores first. Larger ones are
    read as they are: nothing is shuffled.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def check_upload(name: str, size: int) -> None:
    """Refuses other endings and files over the limit. A file of the old binary workbook format has an ending that is let in,
    and is refused when it is read, by its first bytes."""
    if not name.lower().endswith(ENDINGS):
        raise ValueError(f"only {', '.join(ENDINGS)} are read")
    if size > MOST_BYTES:
        raise ValueError(f"a file may have {MOST_BYTES} bytes")


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cell) of all rows and columns, however wide a row is: lines are split by Spark's own CSV reader."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    width = lines.select(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))))).first()[0] or 0
    schema = ", ".join(f"c{k} string" for k in range(width + 1))
    rows = spark.read.csv(path, schema=schema, header=False, mode="PERMISSIVE")
    return rows.select(F.explode(F.array(*rows.columns)).alias("cell")).where("trim(coalesce(cell, '')) <> ''")


def _sheet(raw: bytes) -> list[str]:
    """The cells of the first sheet as text."""
    if raw[:2] != b"PK":
        raise ValueError("only workbooks of the zipped format are read; save the old one as .xlsx")
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        tag = lambda e: e.tag.rpartition("}")[2]
        words = []
        if "xl/sharedStrings.xml" in book.namelist():
            words = ["".join(t.text or "" for t in item.iter() if tag(t) == "t") for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        first = min((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for cell in ElementTree.fromstring(book.read(first)).iter():
            if tag(cell) == "c":
                value = "".join(t.text or "" for t in cell.iter() if tag(t) in ("t", "v"))
                out.append(words[int(value)] if cell.get("t") == "s" and value else value)
        return [c for c in out if c.strip()]


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cell) of the first sheet of each workbook, read where the file lies; one over ``MOST_BYTES`` is an error."""
    files = spark.read.format("binaryFile").load(path)
    large = F.raise_error(F.concat(F.lit("over the limit of an upload: "), "path"))
    read = F.udf(_sheet, "array<string>")
    return files.select(F.explode(read(F.when(F.col("length") > MOST_BYTES, large.cast("binary")).otherwise(F.col("content")))).alias("cell"))


def domains(cells: DataFrame) -> DataFrame:
    """(domain, valid): uploaded cells as domains, without header words; repeated ones count as invalid, as do non-domains."""
    own = cells.where(~urls.is_header_word(F.col("cell"))).select(urls.upload_domain(F.col("cell")).alias("domain"))
    counted = own.groupBy("domain").agg(F.count("*").alias("n"))
    return counted.select("domain", urls.is_valid_domain(F.col("domain")).alias("valid"), (F.col("n") - F.when(urls.is_valid_domain(F.col("domain")), 1).otherwise(0)).alias("invalid_rows"))


def search_hits(answers: DataFrame) -> DataFrame:
    """(query, provider, rank, url, title, snippet) from stored answers (query, provider, status_code, body) of two shapes.

    Answers refused for want of rights or over a limit (401, 402, 403, 429) raise no row but are found in ``refused``.
    """
    one = "array<struct<url: string, title: string, description: string>>"
    two = "array<struct<link: string, title: string, snippet: string>>"
    ok = answers.where("status_code = 200").withColumn("a", F.from_json("body", f"web struct<results: {one}>, organic {two}"))
    hits = F.coalesce(F.transform("a.web.results", lambda h: F.struct(h["url"].alias("url"), h["title"].alias("title"), h["description"].alias("snippet"))), F.transform("a.organic", lambda h: F.struct(h["link"].alias("url"), h["title"].alias("title"), h["snippet"].alias("snippet"))))
    return ok.select("query", "provider", F.posexplode(hits).alias("rank", "h")).select("query", "provider", (F.col("rank") + 1).alias("rank"), "h.url", "h.title", "h.snippet").where("url is not null")


def refused(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("status_code").isin(401, 402, 403, 429))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The hits of the first provider; for queries where it has none, those of the second."""
    return first.unionByName(second.join(first.select("query").distinct(), "query", "left_anti"))
