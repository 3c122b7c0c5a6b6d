"""Files as sources and sinks: scanning, converting, caching."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import text as X

#: Suffixes of files that are taken in.
SUFFIXES = ["pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "csv", "md"]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, dataset_id, format, content, file_size, modified): the files below root, the first folder being the dataset; temporary and hidden files are left out. A path below one root is unique, so nothing is shuffled."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = files.select("path", relative.alias("relative"), X.file_format("path").alias("format"), "content", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    keep = ~name.startswith("~$") & ~name.startswith(".") & F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).isin(SUFFIXES)
    return rows.where(keep).withColumn("dataset_id", F.when(F.instr("relative", "/") > 0, F.split("relative", "/")[0]).otherwise("default"))


def version_map(spark: SparkSession, path: str) -> DataFrame:
    """(filename, source_key) of a JSON object; a missing or broken file gives none."""
    schema = "filename string, source_key string"
    try:
        raw = spark.read.text(path, wholetext=True)
        pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "source_key"))
        return pairs.where("source_key is not null")
    except Exception as e:  # noqa: BLE001 - as stated: no file, no versions
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def with_source_keys(files: DataFrame, versions: DataFrame) -> DataFrame:
    """files (relative, ...) with source_key by file name, null where none is known."""
    one = versions.groupBy("filename").agg(F.min("source_key").alias("source_key"))
    return files.withColumn("filename", F.regexp_extract("relative", "([^/]*)$", 1)).join(one, "filename", "left")


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (content binary or string) with content_hash, without those whose hash the cache has."""
    return files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256)).join(cache.select("content_hash").distinct(), "content_hash", "left_anti")


def cached_changes(sources: DataFrame, cache: DataFrame, pages: DataFrame) -> DataFrame:
    """sources (filename, content) that must be taken in: new, changed, or with an output of the cache (filename, hash, files_written array) that pages (path) no longer has."""
    lost = cache.select("filename", F.explode("files_written").alias("path")).join(pages.select("path").distinct(), "path", "left_anti").select("filename").distinct()
    good = cache.join(lost, "filename", "left_anti").select("filename", "hash")
    return sources.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)).join(good, ["filename", "hash"], "left_anti")


def repair_zip(data: bytes) -> bytes:
    """An archive whose members' paths use backslashes, with slashes; the input stays untouched."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if not any("\\" in i.filename for i in z.infolist()):
            return data
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            for i in z.infolist():
                w.writestr(i.filename.replace("\\", "/"), z.read(i))
        return out.getvalue()


def _csv_to_markdown(data: bytes) -> str:
    import csv

    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))) if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def _docx_to_markdown(data: bytes) -> str:
    import xml.etree.ElementTree as ET

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(repair_zip(data))) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(f"{w}p"):
        style = p.find(f"{w}pPr/{w}pStyle")
        level = "".join(c for c in (style.get(f"{w}val") if style is not None else "") if c.isdigit())
        content = "".join(t.text or "" for t in p.iter(f"{w}t"))
        lines.append(("#" * min(6, int(level)) + " " if level and content else "") + content)
    return "\n\n".join(x for x in lines if x)


def _pptx_to_markdown(data: bytes) -> str:
    import xml.etree.ElementTree as ET

    a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(repair_zip(data))) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for no, name in slides:
            lines = ["".join(t.text or "" for t in p.iter(f"{a}t")).strip() for p in ET.fromstring(z.read(name)).iter(f"{a}p")]
            lines = [x for x in lines if x]
            out.append(f"# {lines[0]}" if lines else f"# {no}")
            out += lines[1:]
    return "\n\n".join(out)


def _xlsx_to_markdown(data: bytes) -> str:
    import xml.etree.ElementTree as ET

    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(repair_zip(data))) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
        titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet")] if "xl/workbook.xml" in names else []
        sheets = sorted((int(k[1]), n) for n in names if (k := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        out = []
        for i, (_, name) in enumerate(sheets):
            rows = []
            for row in ET.fromstring(z.read(name)).iter(f"{m}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{m}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r") or "")[0]:
                        at = at * 26 + ord(letter) - 64
                    v, inline = c.find(f"{m}v"), c.find(f"{m}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{m}t")) if inline is not None else (v.text or "" if v is not None else "")
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    cells[at - 1 if at else len(cells)] = " ".join(text.split()).replace("|", "\\|")
                if any(cells.values()):
                    rows.append(cells)
            if not rows:
                continue
            width = max(max(r) for r in rows) + 1
            line = lambda r: "| " + " | ".join(r.get(j, "") for j in range(width)) + " |"
            title = titles[i] if i < len(titles) else str(i + 1)
            out.append("\n".join([f"## {title}", "", line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]))
    return "\n\n".join(out)


#: Converters by format, in the order in which they are tried; callers add their own for formats that need outside programs.
CONVERTERS: dict[str, list[Callable[[bytes], str]]] = {
    "md": [lambda b: b.decode("utf-8-sig", "replace")],
    "csv": [_csv_to_markdown],
    "docx": [_docx_to_markdown],
    "pptx": [_pptx_to_markdown],
    "xlsx": [_xlsx_to_markdown],
}


def to_markdown(files: DataFrame, converters: dict[str, list[Callable[[bytes], str]]] | None = None) -> DataFrame:
    """files (path, format, content binary) as (path, markdown, status): the first converter of the format that succeeds counts; without one the status says so."""
    known = converters or CONVERTERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for path, kind, data in zip(p["path"], p["format"], p["content"]):
                text, status = None, "no converter" if kind not in known else "failed"
                for f in known.get(kind, []):
                    try:
                        text, status = f(bytes(data)), "ok"
                        break
                    except Exception as e:  # noqa: BLE001 - the next converter is tried
                        status = f"failed: {type(e).__name__}"
                out.append((path, text, status))
            yield pd.DataFrame(out, columns=["path", "markdown", "status"])

    return files.select("path", "format", "content").mapInPandas(run, "path string, markdown string, status string")


def whole_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_name, content): each text file as one document under the hash of its content."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(X.short_hash("value").alias("doc_id"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, text): the Markdown files below path, hidden ones left out; the id is the file's stem, with its folder where two share a stem."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.where(~F.regexp_extract("path", "([^/]*)$", 1).startswith("."))
    rows = rows.withColumn("stem", X.stem("path")).withColumn("folder", F.regexp_extract("path", "([^/]*)/[^/]*$", 1))
    n = rows.groupBy("stem").agg(F.count("*").alias("n"))
    return rows.join(n, "stem").select(F.when(F.col("n") > 1, F.concat("folder", F.lit("/"), "stem")).otherwise(F.col("stem")).alias("id"), "path", "text")


def write_documents(tree: DataFrame, path: str) -> None:
    """documents_tree as JSON without its vectors."""
    bare = lambda c: F.when(F.col(c).isNotNull(), F.transform(c, lambda s: s.dropFields("vector"))).alias(c)
    nested = [c for c in ("children", "summaries", "attachments") if c in tree.columns]
    tree.drop("vector").select(*[c for c in tree.columns if c not in nested and c != "vector"], *map(bare, nested)).write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What write_documents wrote, in the schema of `like`; vectors are null."""
    return spark.read.schema(like.schema).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)
