"""Writing: CSV lines to the byte, workbooks, and versioned tables that are never overwritten while they are read."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.text import csv_cell


def csv_lines(df: DataFrame, order: list[Column]) -> DataFrame:
    """(ord, line): a header and a line for each row; cells are quoted only where they must be."""
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in df.columns)
    spark = df.sparkSession
    body = df.select(F.struct(*order).alias("_key"), F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns)).alias("line")).orderBy("_key").select("line")
    return spark.createDataFrame([(head,)], "line string").unionAll(body)


def workbook(headers: list[str], rows: list[list], sheet: str = "Leads") -> bytes:
    """A workbook of one sheet. It is an export of one batch, small by nature, and is made on the driver."""

    def name(k: int) -> str:
        out = ""
        while True:
            k, rest = divmod(k, 26)
            out = chr(65 + rest) + out
            if not k:
                return out
            k -= 1

    cell = lambda r, c, v: f'<c r="{name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    table = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([headers, *rows], 1))
    space, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData>{table}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for path, body in files.items():
            book.writestr(path, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


class Snapshots:
    """A table as numbered snapshots in a folder; readers keep theirs while the next one is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._dir = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._dir.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The newest snapshot that was written to its end; 0 if there is none."""
        if not self._fs.exists(self._dir):
            return 0
        return max((int(f.getPath().getName()[1:]) for f in self._fs.listStatus(self._dir) if self._fs.exists(self._path(f.getPath(), "_SUCCESS"))), default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version():08d}")

    def write(self, df: DataFrame) -> int:
        now = self.version() + 1
        df.write.parquet(f"{self.path}/v{now:08d}")
        return now
