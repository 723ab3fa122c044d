"""File sources and sinks.  Paths go to Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import contextlib
import io
import re
import sqlite3
import uuid
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing number in CSV series.
MISSING = ["", ".", "NA", "N/A", "NaN", "nan", "null"]


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a JSON-lines file or folder under a declared schema; a malformed line fails, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """One object per line, non-ASCII kept; never over an existing path."""
    df.write.mode("error").option("compression", compression).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _children(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found) if found else []


def exactly_one(spark: SparkSession, pattern: str) -> str:
    found = _children(spark, pattern)
    if len(found) != 1:
        raise ValueError(f"{pattern} matches {len(found)} files, not one")
    return found[0]


def read_split(spark: SparkSession, folder: str, schema: str) -> dict[str, DataFrame]:
    """train and validation, each from the one file that matches."""
    return {name: read_jsonl(spark, exactly_one(spark, f"{folder}/*{name}*.jsonl"), schema) for name in ("train", "validation")}


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By extension: jsonl, json, csv (also gzip), parquet; anything else is an error."""
    for end, read in ((".jsonl", lambda: read_jsonl(spark, path, schema)), (".json", lambda: read_json(spark, path, schema)), (".csv", lambda: read_series_csv(spark, path)), (".csv.gz", lambda: read_series_csv(spark, path)), (".parquet", lambda: spark.read.parquet(path))):
        if path.endswith(end):
            return read()
    raise ValueError(f"no reader for {path}")


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns under unique headers; a byte-order mark is dropped and missing marks become null."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if len({n.lower() for n in names}) != len(names):
        raise ValueError("headers are not unique")
    df = df.toDF(*names)
    return df.select(*(F.when(~F.trim(c).isin(*MISSING), F.trim(c)).alias(c) for c in names))


def finite_number(c: Column) -> Column:
    """The number of a text; null where it is missing; texts that are no finite number fail."""
    v = c.try_cast("double")
    odd = c.isNotNull() & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(odd, F.raise_error(F.concat(F.lit("not a finite number: "), c)).cast("double")).otherwise(v)


def with_provenance(df: DataFrame) -> DataFrame:
    path = F.input_file_name()
    return df.withColumn("source_file", path).withColumn("file_name", F.element_at(F.split(path, "/"), -1))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sha256, bytes) of every file; hashes are taken where the files are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def tree_fingerprint(spark: SparkSession, path: str) -> str:
    lines = fingerprints(spark, path).select(F.concat_ws(" ", "sha256", "file_name").alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).first()[0]


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Writes a table that must not exist yet, and its manifest last; readers trust what has one."""
    spark = df.sparkSession
    df.write.mode("error").parquet(f"{folder}/{name}")
    found = fingerprints(spark, f"{folder}/{name}").where("file_name like 'part-%'")
    rows = spark.read.parquet(f"{folder}/{name}").count()
    found.withColumn("rows", F.lit(rows)).coalesce(1).write.mode("error").json(f"{folder}/{name}.manifest")
    return f"{folder}/{name}"


def checked(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """df if its columns and types are exactly those; an error else."""
    if df.dtypes != columns:
        raise ValueError(f"schema is {df.dtypes}, not {columns}")
    return df


def vintages_long(df: DataFrame, date: str, series: str) -> DataFrame:
    """SERIES_YYYYMMDD columns as rows (date, vintage_date, value)."""
    wide = [c for c in df.columns if c.startswith(f"{series}_")]
    long = df.unpivot([date], wide, "vintage", "value")
    return long.select(date, F.to_date(F.regexp_extract("vintage", r"_(\d{8})$", 1), "yyyyMMdd").alias("vintage_date"), "value")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which executors share; a local one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or '/tmp/checkpoints/millrace').rstrip('/')}/files-{uuid.uuid4().hex}"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("member", T.StringType()), T.StructField("text", T.StringType())])))
def zip_members(content: pd.Series) -> pd.Series:
    """Name and text of the files in each archive."""

    def members(raw):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [{"member": n, "text": z.read(n).decode("utf-8-sig")} for n in sorted(z.namelist())]

    return content.map(lambda raw: None if raw is None else members(raw))


def zipped_vintages(archives: DataFrame, content: str = "content") -> DataFrame:
    """(date, vintage_date, value) of archives of CSV files, each with a date column and SERIES_YYYYMMDD columns.

    Columns of all files are rows at once, so no wide table has to be merged; a vintage and
    date that two files give with different values is an error.
    """
    files = archives.select(F.explode(zip_members(F.col(content))).alias("m")).select(F.split(F.trim("m.text"), "\r?\n").alias("lines"))
    rows = files.select(F.split(F.col("lines")[0], ",").alias("head"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).select("head", F.split("line", ",").alias("cells"))
    cells = rows.select(F.to_date(F.col("cells")[0]).alias("date"), F.posexplode(F.arrays_zip(F.slice("head", 2, F.size("head")).alias("name"), F.slice("cells", 2, F.size("head")).alias("text"))).alias("k", "c"))
    value = finite_number(F.when(~F.trim("c.text").isin(*MISSING), F.trim("c.text")))
    long = cells.select("date", F.to_date(F.regexp_extract("c.name", r"_(\d{8})$", 1), "yyyyMMdd").alias("vintage_date"), value.alias("value")).where("value is not null")
    one = long.groupBy("date", "vintage_date").agg(F.min("value").alias("value"), F.max("value").alias("_high"))
    return one.select("date", "vintage_date", F.when(F.col("value") == F.col("_high"), F.col("value")).otherwise(F.raise_error(F.lit("two values of one vintage")).cast("double")).alias("value"))


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows in any order: rows are hashed where they are and only 32 hexadecimal sums meet."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    return df.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(p.cast("string") for p in parts)), 256)).first()[0]


def write_plan(df: DataFrame, path: str) -> str:
    """A plan table and its hash beside it; neither may exist."""
    df.write.mode("error").parquet(path)
    found = table_hash(df.sparkSession.read.parquet(path))
    df.sparkSession.createDataFrame([(found,)], "hash string").coalesce(1).write.mode("error").json(f"{path}.hash")
    return found


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The plan, if it still has the hash that was written with it; an error else."""
    df = spark.read.parquet(path)
    if table_hash(df) != spark.read.schema("hash string").json(f"{path}.hash").first()[0]:
        raise ValueError(f"{path} is not the plan that was written")
    return df


def sqlite_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, content): each report table as the bytes of a SQLite database, made by one task; reports are small by nature.

    Column types follow the schema; columns that may not be null say so.
    """
    out = None
    for name, df in tables.items():
        own = df.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(_snapshot(name, df.schema), "table string, content binary")
        out = own if out is None else out.unionByName(own)
    return out


def _snapshot(name: str, schema: T.StructType):
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}
    columns = ", ".join(f'"{f.name}" {kinds[f.dataType.simpleString()]}{"" if f.nullable else " NOT NULL"}' for f in schema.fields)
    marks = ", ".join("?" * len(schema.fields))

    def snapshot(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_one").astype(object)
        with contextlib.closing(sqlite3.connect(":memory:")) as con:
            con.execute(f'CREATE TABLE "{name}" ({columns})')
            con.executemany(f'INSERT INTO "{name}" VALUES ({marks})', rows.where(rows.notna(), None).itertuples(index=False))
            con.commit()
            return pd.DataFrame({"table": [name], "content": [con.serialize()]})

    return snapshot


def sqlite_rows(snapshots: DataFrame, sql: str, schema: str) -> DataFrame:
    """Rows of a SQL query over every snapshot, answered where the snapshot is."""

    def answer(batches):
        for batch in batches:
            for content in batch["content"]:
                with contextlib.closing(sqlite3.connect(":memory:")) as con:
                    con.deserialize(bytes(content))
                    got = con.execute(sql)
                    yield pd.DataFrame(got.fetchall(), columns=[c[0] for c in got.description])

    return snapshots.select("content").mapInPandas(answer, schema)


# Names of the spreadsheet format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_ILLEGAL = re.compile("[\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")


def workbook(names: list[str], rows) -> bytes:
    """A workbook of one sheet with a header; texts are inline, null cells are left out."""

    def cell(v):
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(v)))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [names, *rows])
    members = {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SHEET}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def sheet_cells(content: bytes) -> list[dict[str, str | None]]:
    """Rows of the first sheet as texts by header; shared and inline texts, gaps and cells without a reference are read."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    whole = lambda e: "".join(t.text or "" for t in e.iter(tag("t")))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [whole(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = next(iter(ET.fromstring(z.read("xl/workbook.xml")).iter(tag("sheet")))).get(f"{{{_OFFICE}}}id")
        target = next(e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if e.get("Id") == sheet)
        root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    head, out = None, []
    for row in root.iter(tag("row")):
        values, at = {}, 0
        for c in row.iter(tag("c")):
            if c.get("r"):
                at = 0
                for letter in filter(str.isalpha, c.get("r")):
                    at = at * 26 + ord(letter.upper()) - 64
                at -= 1
            v = c.find(tag("v"))
            values[at] = whole(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            at += 1
        if head is None:
            head = values
        else:
            out.append({name: values.get(k) for k, name in head.items() if name})
    return out


def write_workbook(df: DataFrame, path: str) -> None:
    """A report table as one workbook, made by one task and stored with its name as a binary table; never over an existing path."""
    names = df.columns

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        plain = [[v.item() if hasattr(v, "item") else v for v in r] for r in rows[names].itertuples(index=False)]
        return pd.DataFrame({"content": [workbook(names, plain)]})

    df.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(pack, "content binary").write.mode("error").parquet(path)


def read_workbooks(books: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """Rows of the first sheets of workbooks (as binaryFile reads them, or write_workbook stores them); cells that do not fit the schema fail."""

    @F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def cells(c: pd.Series) -> pd.Series:
        return c.map(lambda raw: None if raw is None else sheet_cells(bytes(raw)))

    rows = books.select(F.explode(cells(content)).alias("r"))
    return rows.select(*(F.col("r")[f.name].cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields))


def page_links(df: DataFrame, url: str, html: str) -> DataFrame:
    """df with one row per distinct link of a page: `href` as written and `link` in full; links within a page and scripts are left out."""
    hrefs = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)))
    rows = df.select("*", F.explode(F.transform(hrefs, lambda h: F.trim(h))).alias("href")).where("href <> '' and not (href rlike '(?i)^(#|javascript:|mailto:)')")
    base = F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(F.col(url), r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+(?:/.*)?/)[^/]*$", 1)
    href = F.col("href")
    full = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(F.col(url), r"^([^:]+:)", 1), href)).when(href.startswith("/"), F.concat(base, href)).otherwise(F.concat(F.when(folder == "", F.concat(base, F.lit("/"))).otherwise(folder), href))
    return rows.withColumn("link", full)


def bisected(items: list, fetch) -> list[tuple[list, object]]:
    """(items, answer) of the largest halves that fetch answers; one item that it does not answer has None.

    fetch gives None for a batch that failed; halves keep the order of items.
    """
    out, open_batches = [], [items] if items else []
    while open_batches:
        batch = open_batches.pop()
        if (got := fetch(batch)) is not None or len(batch) == 1:
            out.append((batch, got))
        else:
            middle = len(batch) // 2
            open_batches += [batch[middle:], batch[:middle]]
    return out
