"""Readers: files of many formats to one table of documents.

Every reader is DataFrame -> DataFrame over ``binaryFile`` or ``text`` scans, so files are read by
executors, and returns doc_id, text, source, filename, ext, size, is_tabular, content_hash,
metadata and error. Formats that need a parser are read by mapInPandas with the standard library.
Which files are read is decided on their paths, by a filter that prunes the scan's list of files: what is
excluded or of no known format is never opened. A file that its parser fails on is in the result as
raw text with the error beside it.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator
from fnmatch import translate
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import html_to_text

DOCUMENT = "doc_id string, text string, source string, filename string, ext string, size bigint, is_tabular boolean, content_hash string, metadata map<string,string>, error string"
#: Rows of a table shown as text.
CSV_ROWS, SHEET_ROWS = 500, 200
#: Folders that a scan for data files leaves out.
SKIPPED_DIRS = (".git", "__pycache__", ".venv", "venv", "node_modules")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

Loader = Callable[[bytes], tuple[str, dict[str, str], bool]]
_loaders: dict[str, Loader] = {}


def register_loader(*extensions: str):
    """Registers a function of a file's bytes -> (text, metadata, is_tabular) for these extensions."""

    def add(f: Loader) -> Loader:
        for e in extensions:
            _loaders[e.lower()] = f
        return f

    return add


def get_loader(ext: str) -> Loader | None:
    return _loaders.get(ext.lower())


def supported_extensions() -> list[str]:
    return sorted(_loaders)


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


@register_loader(".txt", ".md", ".markdown", ".text")
def load_text(data: bytes):
    return _decoded(data), {}, False


@register_loader(".jsonl")
def load_jsonl(data: bytes):
    """The data (or else text) field of each line; lines that are no JSON stay as they are."""
    import json

    lines = []
    for raw in _decoded(data).split("\n"):
        if line := raw.strip():
            try:
                obj = json.loads(line)
            except ValueError:
                lines.append(line)
                continue
            found = obj.get("data", obj.get("text", "")) if isinstance(obj, dict) else ""
            if found:
                lines.append(str(found))
    return "\n".join(lines), {"lines": str(len(lines))}, False


@register_loader(".docx")
def load_docx(data: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return _decoded(data), {"fallback": "true"}, False
    paras = ["".join(t.text or "" for t in p.iter(WORD + "t")) for p in root.iter(WORD + "p")]
    paras = [p for p in paras if p]
    return "\n".join(paras), {"paragraphs": str(len(paras))}, False


@register_loader(".pdf")
def load_pdf(data: bytes):
    """Pages by pypdf, where that is installed."""
    from pypdf import PdfReader

    pages = [t for p in PdfReader(io.BytesIO(data)).pages if (t := p.extract_text())]
    return "\n\n".join(pages), {"pages": str(len(pages))}, False


@register_loader(".html", ".htm")
def load_html(data: bytes):
    return html_to_text(_decoded(data)), {}, False


def table_text(headers: list[str], rows: list[list[str]], shown: int) -> list[str]:
    """A line of named values for each of the first rows; empty values are left out."""
    return [" | ".join(f"{h}: {v}" for h, v in zip(headers, r) if v) for r in rows[:shown]]


def row_text(*columns: str) -> Column:
    """The same for rows that are in a table already."""
    named = (F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns)
    return F.concat_ws(" | ", *named)


def csv_rows(data: bytes, delimiter: str = ",") -> tuple[list[str], list[list[str]]]:
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace")), delimiter=delimiter) if r]
    return (rows[0], rows[1:]) if rows else ([], [])


def _csv(data: bytes, delimiter: str):
    headers, rows = csv_rows(data, delimiter)
    text = "\n".join([f"Columns: {', '.join(headers)}", f"Total rows: {len(rows)}", "", *table_text(headers, rows, CSV_ROWS)])
    if len(rows) > CSV_ROWS:
        text += f"\n\n... ({len(rows) - CSV_ROWS} more rows)"
    return text, {"rows": str(len(rows)), "columns": ", ".join(headers)}, True


@register_loader(".csv")
def load_csv(data: bytes):
    return _csv(data, ",")


@register_loader(".tsv")
def load_tsv(data: bytes):
    return _csv(data, "\t")


def sheets(data: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(name, rows of strings) of each sheet of a workbook. Rows are parsed as they are asked for and forgotten after, so memory does not grow with a sheet; those of one sheet are read before the next is asked for."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(SHEET + "t")) for si in _elements(f, SHEET + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(SHEET + "sheet"):
            target = targets[s.get(RELATION)].lstrip("/")
            with z.open(target if target.startswith("xl/") else "xl/" + target) as f:
                yield s.get("name"), (_cells(r, shared) for r in _elements(f, SHEET + "row"))


def _elements(file, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, each dropped from the tree once the next is asked for."""
    path: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if e.tag == tag:
            yield e
            if path:
                path[-1].remove(e)


def _cells(row, shared: list[str]) -> list[str]:
    out: list[str] = []
    for c in row.iter(SHEET + "c"):
        letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
        at = 0
        for x in letters:
            at = at * 26 + ord(x) - 64
        out += [""] * (at - 1 - len(out))
        value = c.find(SHEET + "v")
        if c.get("t") == "s":
            out.append(shared[int(value.text)])
        elif c.get("t") == "inlineStr":
            out.append("".join(t.text or "" for t in c.iter(SHEET + "t")))
        else:
            out.append(value.text or "" if value is not None else "")
    return out


@register_loader(".xlsx", ".xls")
def load_xlsx(data: bytes):
    lines, total, n_sheets = [], 0, 0
    for name, rows in sheets(data):
        n_sheets += 1
        headers = next(rows, None)
        if headers is not None:
            first = list(itertools.islice(rows, SHEET_ROWS))
            n = len(first) + sum(1 for _ in rows)
            lines += [f"Sheet: {name}", f"Columns: {', '.join(headers)}", f"Rows: {n}", "", *table_text(headers, first, SHEET_ROWS), ""]
            total += n
    text = "\n".join(lines)
    if total > SHEET_ROWS:
        text += f"\n... ({total - SHEET_ROWS} more rows)"
    return text, {"sheets": str(n_sheets), "rows": str(total)}, True


def read_workbooks(spark: SparkSession, path: str | list[str], recursive: bool = True, exclude: tuple[str, ...] = (), batch: int = 10_000) -> DataFrame:
    """source, sheet, row (from 0, the headers), cells and error of all workbooks below the paths: a row of a sheet is a row here, so a workbook of any number of them is no one value. A workbook that breaks off has the rows before that and one row with the error."""
    kind = "source string, sheet string, row bigint, cells array<string>, error string"
    files = document_files(spark, path, recursive, exclude)
    if files is None:
        return spark.createDataFrame([], kind)
    names = ["source", "sheet", "row", "cells", "error"]

    def rows_of(source: str, data: bytes) -> Iterator[tuple]:
        try:
            for sheet, rows in sheets(data):
                yield from ((source, sheet, i, cells, None) for i, cells in enumerate(rows))
        except Exception as e:  # noqa: BLE001  a broken file must not end the scan
            yield source, None, None, None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, data in zip(b["path"], b["content"]):
                rows = rows_of(source, bytes(data))
                while some := list(itertools.islice(rows, batch)):
                    yield pd.DataFrame(some, columns=names).astype({"row": "Int64"})

    books = files.filter(F.rlike(F.lower("path"), F.lit(r"\.xlsx?$")))
    return books.select("path", "content").mapInPandas(run, kind)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def document_files(spark: SparkSession, path: str | list[str], recursive: bool = True, exclude: tuple[str, ...] = (), unknown_as_text: bool = False) -> DataFrame | None:
    """path, modificationTime, length and content of the files that ``read_documents`` reads; None where no path exists. The filter is on the scan's metadata, so it prunes files before any is opened, and content is read only where it is selected."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if _exists(spark, p)]
    if not paths:
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    # Metadata has paths as URIs.
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    wanted = F.lower(F.regexp_extract(place, r"(\.[^./]*)$", 1)).isin(*_loaders)
    for p in paths:
        # A path that is a file itself is read whatever its name.
        wanted = wanted | F.endswith(place, F.lit("/" + p.rstrip("/").split("://")[-1].lstrip("/"))) if _is_file(spark, p) else wanted
    keep = F.lit(True) if unknown_as_text else wanted
    for pattern in exclude:
        # The pattern matches the last parts of a path, as many as it has, or from some part on to the end.
        body = translate(pattern).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")
        keep = keep & ~F.rlike(place, F.lit(f"(?s)(^|/)({body})$"))
    return files.filter(keep)


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(place) and fs.getFileStatus(place).isFile()


def read_documents(spark: SparkSession, path: str | list[str], recursive: bool = True, exclude: tuple[str, ...] = (), unknown_as_text: bool = False) -> DataFrame:
    """Documents of all files below the paths whose extension has a loader, and of paths that are files themselves; paths that don't exist are left out.

    Excluded are paths that match any of the patterns, as a whole or by their last parts. A file that fails to parse has its raw
    text and ``error``; files of no known format are raw text with ``unknown_as_text`` or where they are named themselves.
    doc_id tells files apart by path and content, so equal files at two places are two documents.
    """
    files = document_files(spark, path, recursive, exclude, unknown_as_text)
    if files is None:
        return spark.createDataFrame([], DOCUMENT)
    loaders = dict(_loaders)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, size, data, digest, own in zip(b["path"], b["length"], b["content"], b["content_hash"], b["id"]):
                name = source.rsplit("/", 1)[-1]
                ext = "." + name.rsplit(".", 1)[-1] if "." in name else ""
                error = None
                try:
                    text, meta, tabular = (loaders.get(ext.lower()) or load_text)(bytes(data))
                except Exception as e:  # noqa: BLE001  a broken file must not end the scan
                    (text, meta, tabular), error = load_text(bytes(data)), f"{type(e).__name__}: {e}"[:500]
                out.append((own[:16], text, source, name, ext, size, tabular, digest, meta, error))
            yield pd.DataFrame(out, columns=["doc_id", "text", "source", "filename", "ext", "size", "is_tabular", "content_hash", "metadata", "error"])

    rows = files.select("path", "length", "content", F.md5("content").alias("content_hash"))
    return rows.withColumn("id", F.md5(F.concat_ws("|", "path", "content_hash"))).mapInPandas(parse, DOCUMENT)


def read_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Documents of strings, named input_0, input_1, ..."""
    rows = spark.createDataFrame([(f"input_{i}", t) for i, t in enumerate(texts)], "source string, text string")
    return rows.select(F.substring(F.md5(F.encode("source", "utf-8")), 1, 12).alias("doc_id"), "text", "source")


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of CSV and TSV files as strings with their ``_source``; columns that a file lacks are null."""
    out = None
    for p in paths:
        df = spark.read.csv(p, header=True, sep="\t" if p.endswith(".tsv") else ",", multiLine=True).withColumn("_source", F.col("_metadata.file_path"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: text of the lines in order, and their number; the Spark form of load_jsonl, for files of many lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).filter("line <> ''")
    return jsonl_text(lines, "source")


def jsonl_text(lines: DataFrame, key: str) -> DataFrame:
    """(key, text, lines) of lines (key, at, line): the data, or else text, of JSON objects, other lines as they are."""
    value = jsonl_value(F.col("line"))
    own = lines.select(key, "at", value.alias("value")).filter("value <> ''")
    return own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("own")).select(key, F.array_join(F.transform("own", lambda x: x["value"]), "\n").alias("text"), F.size("own").cast("long").alias("lines"))


def jsonl_value(line):
    """What a line of JSON lines says: of an object its data, and its text only where it has no data; empty values say nothing."""
    parsed, field = F.try_parse_json(line), lambda k: F.coalesce(F.get_json_object(line, f"$.{k}"), F.lit(""))
    found = F.when(F.array_contains(F.json_object_keys(line), "data"), field("data")).otherwise(field("text"))
    return F.when(parsed.isNull(), line).when(found.isin("0", "0.0", "false", "[]", "{}"), F.lit("")).otherwise(found)


def sniff(spark: SparkSession, path: str, sample: int = 4096) -> DataFrame:
    """Format of files by extension, first bytes and encoding: path, extension, size, magic_bytes, encoding, is_binary, suggested_loader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, sample)
    ext = F.lower(F.regexp_extract(F.regexp_extract("path", r"[^/]*$", 0), r"\.[^.]*$", 0))

    def encodings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, texts = [], []
            for data in b["head"]:
                for enc in ("utf-8", "gbk", "gb2312", "shift_jis", "latin-1"):
                    try:
                        texts.append(bytes(data).decode(enc)[:1000])
                        found.append(enc)
                        break
                    except UnicodeDecodeError:
                        continue
            yield b.drop(columns="head").assign(encoding=found, sample_text=texts)

    rows = files.select("path", ext.alias("extension"), F.col("length").alias("size"), F.lower(F.hex(F.substring("content", 1, 16))).alias("magic_bytes"), head.alias("head"))
    out = rows.mapInPandas(encodings, "path string, extension string, size bigint, magic_bytes string, encoding string, sample_text string")
    by_ext = F.when(F.col("extension").isin(".csv", ".tsv"), "csv").when(F.col("extension").isin(".json", ".jsonl"), "json").when(F.col("extension").isin(".yaml", ".yml"), "yaml")
    for kind in ("xml", "pdf", "docx", "xlsx", "html"):
        by_ext = by_ext.when(F.col("extension") == f".{kind}", kind)
    start = F.trim("sample_text")
    by_text = F.when(F.startswith(start, F.lit("{")) | F.startswith(start, F.lit("[")), "json").when(F.contains(F.left("sample_text", F.lit(200)), F.lit("\t")), "tsv").when(F.contains("sample_text", F.lit(",")), "csv")
    return out.withColumn("suggested_loader", F.coalesce(by_ext, by_text))


def save_manifest(files: DataFrame, path: str) -> None:
    """Keeps what data_files saw, for the next build to compare with."""
    files.write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest at a path, empty where there is none yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string, content_hash string, size bigint, mtime timestamp")
    return spark.read.parquet(path)


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash, size, mtime) of all files, without tool folders: what change detection compares."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    skipped = "/(" + "|".join(re.escape(d) for d in SKIPPED_DIRS) + ")/"
    return files.filter(~F.rlike("path", F.lit(skipped))).select("path", F.md5("content").alias("content_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
