"""Sources: a registry of loaders by file extension. All give units: path, unit, text, meta."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[SparkSession, str], DataFrame]
_loaders: dict[str, Loader] = {}
UNITS = "path string, unit int, text string, meta map<string,string>"


def register(*extensions: str) -> Callable[[Loader], Loader]:
    def add(f: Loader) -> Loader:
        _loaders.update({e.lower().lstrip("."): f for e in extensions})
        return f

    return add


def supported_extensions() -> list[str]:
    return sorted(_loaders)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Units of the file or files that path names; an unknown extension is an error."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension not in _loaders:
        raise ValueError(f"no loader for .{extension}; there are {', '.join(supported_extensions())}")
    return _loaders[extension](spark, path)


@register("txt", "md", "markdown")
def load_text(spark: SparkSession, path: str) -> DataFrame:
    """A file is a unit; undecodable bytes are replaced; blank files give none."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.filter(~F.col("text").rlike(r"^\s*$")).select("path", F.lit(0).alias("unit"), "text", F.create_map(F.lit("source"), "path").alias("meta"))


@register("csv")
def load_csv(spark: SparkSession, path: str, longest_meta: int = 64) -> DataFrame:
    """A record is a unit of "column: value" lines; columns whose values are all short are metadata too. Units are numbered from 0 in each file, in its order.

    Files that path names together have the same columns."""
    # A multi-line file is read by one task in order, so that the ids of its rows ascend by one from wherever they begin.
    read = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = read.columns
    rows = read.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_id"))
    longest = rows.agg(*[F.max(F.coalesce(F.char_length(f"c{i}"), F.lit(0))) for i in range(len(names))]).first()
    value = [F.coalesce(f"c{i}", F.lit("")) for i in range(len(names))]
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), v) for n, v in zip(names, value, strict=True)])
    first = rows.groupBy("_path").agg(F.min("_id").alias("_first"))
    unit = (F.col("_id") - F.col("_first")).cast("int")
    short = [x for i, n in enumerate(names) if (longest[i] or 0) <= longest_meta for x in (F.lit(n), value[i])]
    meta = F.create_map(*short, F.lit("source"), F.col("_path"), F.lit("row"), unit.cast("string"))
    return rows.join(first, "_path").select(F.col("_path").alias("path"), unit.alias("unit"), body.alias("text"), meta.alias("meta"))


@register("html", "htm")
def load_html(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))
    return files.select("path", F.lit(0).alias("unit"), html_text(F.col("html")).alias("text"), F.create_map(F.lit("source"), "path").alias("meta")).filter("text != ''")


def html_text(html):
    """Text of a page: scripts, styles, comments and tags out, the commonest entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"[\t\n\x0B\f\r ]+", " "))


@register("jsonl")
def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    lines = json_events(spark, path)
    return lines.select(F.lit(path).alias("path"), F.lit(0).alias("unit"), F.to_json("event").alias("text"), F.create_map(F.lit("source"), F.lit(path)).alias("meta"))


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """event (a map of text values) of each line that is a JSON object; other lines are skipped, and a path that names no file has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], "event map<string,string>")
    parsed = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("event"))
    return parsed.filter("event IS NOT NULL")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or no rows where there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _plugin(name: str, package: str, rows: Callable[[bytes], list[tuple[str, dict]]], *extensions: str) -> None:
    """Loaders for formats that need a library on the executors; without it they raise, and nothing is lost silently."""

    def load(spark: SparkSession, path: str) -> DataFrame:
        import importlib.util

        if importlib.util.find_spec(package) is None:
            raise RuntimeError(f"{name} files need the package {package}")

        def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(p, k, t, m) for p, c in zip(batch["path"], batch["content"], strict=True) for k, (t, m) in enumerate(rows(c))]
                yield pd.DataFrame(found, columns=["path", "unit", "text", "meta"])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(units, UNITS)

    register(*extensions)(load)


def _pdf(content: bytes) -> list[tuple[str, dict]]:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        pages = [(n, (page.extract_text() or "").strip()) for n, page in enumerate(pdf.pages, 1)]
    return [(text, {"page": str(n)}) for n, text in pages if text]


def _docx(content: bytes) -> list[tuple[str, dict]]:
    import io

    import docx

    document, lines = docx.Document(io.BytesIO(content)), []
    for p in document.paragraphs:
        level = p.style.name.removeprefix("Heading ") if p.style.name.startswith("Heading ") else ""
        lines.append(("#" * min(6, int(level)) + " " if level.isdigit() else "") + p.text)
    lines += ["| " + " | ".join(c.text for c in r.cells) + " |" for t in document.tables for r in t.rows]
    return [("\n".join(lines), {})]


def _xlsx(content: bytes) -> list[tuple[str, dict]]:
    import io

    import openpyxl

    out = []
    for sheet in openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True):
        rows = [["" if c is None else str(c) for c in r] for r in sheet.iter_rows(values_only=True)]
        rows = [r for r in rows if any(c.strip() for c in r)]
        if len(rows) >= 2:
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append(("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]), {"sheet": sheet.title}))
    return out


def _image(content: bytes) -> list[tuple[str, dict]]:
    import io

    import pytesseract
    from PIL import Image

    return [(pytesseract.image_to_string(Image.open(io.BytesIO(content))), {})]


_plugin("PDF", "pdfplumber", _pdf, "pdf")
_plugin("Word", "docx", _docx, "docx")
_plugin("Excel", "openpyxl", _xlsx, "xlsx")
_plugin("image", "pytesseract", _image, "png", "jpg", "jpeg")
