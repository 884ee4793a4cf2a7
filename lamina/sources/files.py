"""File sources: whole messages, text tables, JSON envelopes, spreadsheets, generated rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.session import pin


def whole_files(spark: SparkSession, glob: str) -> DataFrame:
    """``file, content, modified`` of every file matching the pattern; no match gives no rows."""
    schema = "file string, content string, modified timestamp"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    if not (path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []):
        return spark.createDataFrame([], schema)
    df = spark.read.format("binaryFile").load(glob)
    return df.select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"))


def text_table(spark: SparkSession, path: str, columns: list[str] | None = None, *, bad_rows: bool = False) -> DataFrame:
    """Delimited file with header; every column a string, nothing inferred.

    With ``bad_rows`` malformed lines are kept in ``_corrupt`` instead of being read as nulls.
    """
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if columns is not None:
        fields = [T.StructField(c, T.StringType()) for c in columns]
        if bad_rows:
            fields.append(T.StructField("_corrupt", T.StringType()))
            r = r.option("columnNameOfCorruptRecord", "_corrupt")
        r = r.schema(T.StructType(fields))
    return r.csv(path)


def within_errors(df: DataFrame, most: int = 50) -> DataFrame:
    """Rows of a table read with ``bad_rows`` whose malformed lines number at most ``most``; more of them are an error."""
    kept = pin(df)  # the corrupt column cannot be asked alone
    n = kept.filter("_corrupt is not null").count()
    if n > most:
        raise ValueError(f"{n} malformed lines, at most {most} are allowed")
    return kept.filter("_corrupt is null").drop("_corrupt")


def json_envelope(spark: SparkSession, path: str, record: T.StructType | str, field: str = "data") -> DataFrame:
    """Multi-line JSON pages: the records of the ``field`` array, with a given schema."""
    kind = record if isinstance(record, str) else record.simpleString()
    pages = spark.read.option("multiLine", True).schema(f"{field} array<{kind}>").json(path)
    return pages.select(F.explode(field).alias("r")).select("r.*")


def unprefix(df: DataFrame, prefix: str = "data.") -> DataFrame:
    """Columns whose literal names begin with ``prefix``, without it."""
    return df.select(*[F.col(f"`{c}`").alias(c[len(prefix) :]) for c in df.columns if c.startswith(prefix)])


def json_field(c: str, key: str, kind: str) -> F.Column:
    """One field of a JSON text column."""
    return F.from_json(F.col(c), f"{key} {kind}")[key]


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as texts, row by row; gaps are None."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for row in ET.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                at = k if not ref else sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(ref.group()))) - 1
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                else:
                    v = c.find(f"{_NS}v")
                    text = v.text if v is not None else None
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def spreadsheet(spark: SparkSession, path: str, columns: list[str], header_row: int = 4) -> DataFrame:
    """First sheet of every workbook under ``path`` as strings: rows after ``header_row``, matched to ``columns`` by header.

    An unnamed header is ``col_<i>``; rows without any value are dropped. Each workbook is read by one task.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = list(_sheet_rows(content))
                head = [h.strip() if h else f"col_{i}" for i, h in enumerate(rows[header_row - 1])] if len(rows) >= header_row else []
                at = {h: i for i, h in enumerate(head)}
                body = [[(r[at[c]] if c in at and at[c] < len(r) else None) for c in columns] for r in rows[header_row:]]
                yield pd.DataFrame([b for b in body if any(x not in (None, "") for x in b)], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def dates(spark: SparkSession, first: str, last: str, name: str = "d") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias(name))


def numbers(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def changed_between(df: DataFrame, watermark: str, low: str, high: str, load_type: str = "incremental") -> DataFrame:
    """Incremental extract: low < watermark <= high; a full load takes every row. The filter reaches the scan."""
    if load_type != "incremental":
        return df
    lo, hi = F.lit(low).cast(df.schema[watermark].dataType), F.lit(high).cast(df.schema[watermark].dataType)
    return df.filter((F.col(watermark) > lo) & (F.col(watermark) <= hi))


def relational(spark: SparkSession, url: str, table: str, *, watermark: str | None = None, low: str | None = None, high: str | None = None, **options: str) -> DataFrame:
    """JDBC scan with the watermark window inside the pushed-down query."""
    where = f" WHERE {watermark} > '{low}' AND {watermark} <= '{high}'" if watermark else ""
    return spark.read.format("jdbc").options(url=url, query=f"SELECT * FROM {table}{where}", **options).load()
