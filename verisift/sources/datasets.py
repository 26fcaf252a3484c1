"""Labelled datasets in files: CSV, the first CSV of a ZIP, the first sheet of an XLSX, JSON lists; which of them to read; and a CSV sink.

All give (claim, label): rows without a title go, labels that are no number are 0. Paths are read through Spark, so any store works; a
ZIP or XLSX is one task's work, since neither can be split.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.operators.sampling import bottom_k

ROWS = 10_000
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _typed(df: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("label").try_cast("double").cast("int"), F.lit(0))
    return df.where(F.col("title").isNotNull()).select(F.col("title").alias("claim"), label.alias("label"))


def csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header. Rows with more fields than it are skipped, missing fields are null, a field in quotes is text even where
    it is empty, and bytes that are no UTF-8 are replaced."""
    read = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    # Fields without anything read as this value, which no text has, and so as null. Unless set, the last character is NUL, and those of texts go.
    read = read.option("nullValue", uuid.uuid4().hex).option("emptyValue", "").option("charToEscapeQuoteEscaping", '"')
    names = read.option("header", True).csv(path).columns
    kind = ", ".join(f"`{c}` string" for c in [*names, "_surplus"])
    rows = read.option("header", True).option("enforceSchema", True).schema(kind).csv(path)
    # All columns are parsed: a row's surplus shows only then.
    whole = rows.select(F.struct(*rows.columns).alias("r")).where("r._surplus IS NULL")
    return _typed(whole.select("r.title", "r.label"))


def _batches(rows: Iterator[list], header: list[str]) -> Iterator:
    import pandas as pd

    at = [header.index(c) for c in ("title", "label")]
    fit = (r for r in rows if len(r) <= len(header))
    while some := list(itertools.islice(fit, ROWS)):
        yield pd.DataFrame([[r[i] if i < len(r) and r[i] != "" else None for i in at] for r in some], columns=["title", "label"], dtype=object)


def _archived(df: DataFrame, write) -> DataFrame:
    """name and content of archives, one for each batch of rows, made in the tasks. Names ascend with the order of the rows."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                write(z, list(b.columns), b.astype(object).where(b.notna(), None).to_numpy().tolist())
            yield pd.DataFrame({"name": [f"{task:08d}-{k:08d}"], "content": [out.getvalue()]})

    return df.mapInPandas(run, "name string, content binary")


def _number(v):
    return int(v) if isinstance(v, float) and v.is_integer() else v


def zip_packed(df: DataFrame) -> DataFrame:
    """Rows as ZIP archives (name, content) with a CSV member each."""

    def write(z: zipfile.ZipFile, names: list, rows: list) -> None:
        out = io.StringIO(newline="")
        w = csv.writer(out)
        w.writerow(names)
        w.writerows([[_number(v) for v in r] for r in rows])
        z.writestr("rows.csv", out.getvalue())

    return _archived(df, write)


def zip_rows(archives: DataFrame) -> DataFrame:
    """The first CSV member of each ZIP archive (content); one without gives no rows."""

    def read(frames: Iterator) -> Iterator:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if member:
                        rows = csv.reader(io.TextIOWrapper(z.open(member), "utf-8", errors="replace", newline=""))
                        yield from _batches(rows, next(rows, ["title", "label"]))

    return _typed(archives.select("content").mapInPandas(read, "title string, label string"))


def zip_scan(spark: SparkSession, path: str) -> DataFrame:
    """The first CSV member of a ZIP file, or of each one of a folder."""
    return zip_rows(spark.read.format("binaryFile").load(path))


#: A character as sheets write what XML cannot hold.
_ESCAPE = re.compile("_x([0-9A-Fa-f]{4})_")
_FORBIDDEN = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff\r]|_(?=x[0-9A-Fa-f]{4}_)")


def xlsx_packed(df: DataFrame) -> DataFrame:
    """Rows as workbooks (name, content) of one sheet each, with a header."""

    def cell(at: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, str):
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", v))}</t></is></c>'
        return f'<c r="{at}"><v>{_number(v)}</v></c>'

    def write(z: zipfile.ZipFile, names: list, rows: list) -> None:
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{_SHEET[1:-1]}"><sheetData>'.encode())
            for i, r in enumerate([names, *rows], 1):
                out.write(f'<row r="{i}">{"".join(cell(f"{chr(65 + c)}{i}", v) for c, v in enumerate(r))}</row>'.encode())
            out.write(b"</sheetData></worksheet>")

    return _archived(df, write)


def xlsx_rows(books: DataFrame) -> DataFrame:
    """The first sheets of workbooks (name, content); a title counts once, with its first label in the order of names and rows."""

    def cells(z: zipfile.ZipFile) -> Iterator[list]:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().iter(f"{_SHEET}si")]
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        for _, row in ElementTree.iterparse(z.open(sheet)):
            if row.tag != f"{_SHEET}row":
                continue
            out: list = []
            for c in row.iter(f"{_SHEET}c"):
                column = 0
                for letter in (x for x in c.get("r", "") if x.isalpha()):
                    column = 26 * column + ord(letter) - 64
                out += [""] * ((column or len(out) + 1) - 1 - len(out))
                value = "".join(t.text or "" for t in c.iter() if t.tag in (f"{_SHEET}v", f"{_SHEET}t"))
                value = shared[int(value)] if c.get("t") == "s" and value else value
                out.append(_ESCAPE.sub(lambda m: chr(int(m[1], 16)), value))
            row.clear()
            yield out

    def read(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows, at = cells(z), 0
                    for b in _batches(rows, next(rows, ["title", "label"])):
                        b.insert(0, "at", pd.RangeIndex(at, at + len(b)))
                        b.insert(0, "name", name)
                        at += len(b)
                        yield b

    rows = books.select("name", "content").mapInPandas(read, "name string, at long, title string, label string")
    first = rows.where("title IS NOT NULL").groupBy("title").agg(F.min_by("label", F.struct("name", "at")).alias("label"))
    return _typed(first)


def xlsx_scan(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, or of each one of a folder."""
    return xlsx_rows(spark.read.format("binaryFile").load(path).withColumnRenamed("path", "name"))


def json_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of claims, read as it is."""
    return spark.read.option("multiLine", True).json(path)


def csv_sink(df: DataFrame, path: str) -> None:
    """With a header; quotes are doubled, and white space and line ends in values stay. Empty text stands in quotes, a null is nothing."""
    w = df.write.option("header", True).option("quote", '"').option("escape", '"')
    w.option("nullValue", "").option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(path)


def _status(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def ensure_min_csv(spark: SparkSession, folder: str, name: str) -> str | None:
    """The small CSV beside a workbook, written anew where it is missing or older; None without either."""
    book, small = f"{folder}/{name}.xlsx", f"{folder}/{name}.min.csv"
    source, made = _status(spark, book), _status(spark, small)
    if source and (not made or made.getModificationTime() < source.getModificationTime()):
        csv_sink(xlsx_scan(spark, book).withColumnRenamed("claim", "title"), small)
        made = _status(spark, small)
    return small if made else None


def load_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The first source there is: small CSV (made from the workbook), workbook, ZIP, CSV."""
    if small := ensure_min_csv(spark, folder, name):
        return csv_scan(spark, small)
    for ending, scan in (("xlsx", xlsx_scan), ("zip", zip_scan)):
        if _status(spark, path := f"{folder}/{name}.{ending}"):
            return scan(spark, path)
    return csv_scan(spark, f"{folder}/{name}.csv")


def rotating_pool(spark: SparkSession, folder: str, name: str, n: int) -> DataFrame:
    """A pool to draw n claims from: 20 n of the distinct claims, 500 at least, of the ZIP or else the CSV. Repeats of a claim take no place in it; of
    its labels the least counts."""
    zipped = f"{folder}/{name}.zip"
    rows = zip_scan(spark, zipped) if _status(spark, zipped) else csv_scan(spark, f"{folder}/{name}.csv")
    return bottom_k(rows, "claim", max(20 * n, 500))
