"""Readers of the formats the pipeline takes in (SRC01-SRC27)."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Texts that tabular tools take for a missing value.
MISSING = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool | None = None) -> DataFrame:
    """A JSON array, or JSON lines; told apart by the first character unless `lines` says so."""
    if lines is None:
        first = spark.read.text(path, wholetext=False).filter(F.trim("value") != "").limit(1).collect()
        lines = not (first and first[0][0].lstrip().startswith("["))
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=not lines)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, keep_empty: bool = False, infer: bool = False) -> DataFrame:
    """`keep_empty`: missing text is '', as it stands; else the usual signs of a missing value become null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if keep_empty:
        df = (reader if schema is None else reader.schema(schema)).option("nullValue", "\0").option("emptyValue", "").csv(path)
        return df.na.fill("")
    df = (reader.option("inferSchema", infer) if schema is None else reader.schema(schema)).csv(path)
    return df.select(*(F.when(~F.col(f.name).isin(*MISSING), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields))


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """By `fmt`, else by the extension; ValueError for an unknown one."""
    fmt = fmt or EXTENSIONS.get(PurePosixPath(path.rstrip("/*")).suffix.lower())
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, **options)
    if fmt in ("parquet", "orc"):
        schema = options.get("schema")
        return (spark.read if schema is None else spark.read.schema(schema)).format(fmt).load(path)
    raise ValueError(f"unsupported format: {path}")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size) of the files below a folder, directories left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"))


def read_all(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables, failures) by name; ValueError when all fail. A source that may be empty needs a schema, as none can be inferred."""
    tables, failures = {}, {}
    for name, path in paths.items():
        try:
            schema = (schemas or {}).get(name)
            df = read_any(spark, path, **({} if schema is None else {"schema": schema}))
            df.limit(0).count()  # a source that isn't there fails here
            tables[name] = df
        except Exception as e:  # noqa: BLE001 - a source that can't be read is reported, not fatal
            failures[name] = str(e).split("\n")[0][:200]
    if paths and not tables:
        raise ValueError(f"no source could be read: {failures}")
    return tables, failures


def read_json_or_default(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON at a path; an empty table if it is missing or empty."""
    try:
        df = read_json(spark, path, schema)
        df.limit(1).collect()
        return df
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], schema)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by the database; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def run_query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL with named parameters (:name), bound, never pasted."""
    return spark.sql(sql, args=params)


def load_yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


LOG_LINE = r"^\s*\[(\d{2}:\d{2}:\d{2})\]\s+(\w+)\s+(\S+)\s+rc=(\d+)"


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(time, level, task, rc) of the lines that have the form; others are left out."""
    part = lambda k: F.regexp_extract(column, LOG_LINE, k)
    return lines.filter(F.col(column).rlike(LOG_LINE)).select(part(1).alias("time"), part(2).alias("level"), F.split_part(part(3), F.lit("."), F.lit(1)).alias("task"), part(4).cast("int").alias("rc"))


_TAG = re.compile(rb"<[^>]+>")


def epub_pages(content: bytes) -> list[tuple[int, str, str]]:
    """(page, heading, text) of an EPUB's spine; pages of at most 40 characters are left out."""
    import html

    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        box = z.read("META-INF/container.xml").decode("utf-8", "replace")
        opf = re.search(r'full-path="([^"]+)"', box)[1]
        base = opf.rpartition("/")[0]
        book = z.read(opf).decode("utf-8", "replace")
        items = {m[1]: m[0] for m in ((re.search(r'href="([^"]+)"', t)[1], re.search(r'\bid="([^"]+)"', t)[1]) for t in re.findall(r"<item\b[^>]*>", book))}
        for ref in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', book):
            path = "/".join(x for x in (base, items.get(ref, "")) if x)
            if path not in names:
                continue
            page = z.read(path).decode("utf-8", "replace")
            page = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", page)
            head = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", page)
            plain = lambda s: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", s))).strip()
            body = re.search(r"(?is)<body[^>]*>(.*)</body>", page)
            text = plain(body[1] if body else page)
            if len(text) > 40:
                out.append((len(out) + 1, plain(head[1]) if head else "", text))
    return out


_PDF_STRING = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]+>|\bT(?:\*|[dD]\b)|'")
_PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
#: What the escapes of a PDF's strings stand for.
_PDF_SIGNS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_bytes(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _PDF_ESCAPE.sub(lambda m: _PDF_SIGNS.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1])


def pdf_text(content: bytes) -> str:
    """Text of a PDF's content streams: plain or deflated ones, with literal or hexadecimal strings of one byte a character; a line for each text block and each move to a next line. Fonts with codes of their own are not decoded."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            line = b"".join(b"\n" if t in (b"T*", b"Td", b"TD", b"'") else _pdf_bytes(t) for t in _PDF_STRING.findall(block))
            out.append(line.decode("latin-1").strip("\n"))
    return "\n".join(out)


def regex_rows(df: DataFrame, column: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """`df`'s other columns and, for every match of `pattern` in the text, its groups by name: a table out of running text. A text without a match has no row."""
    found = df.filter(F.col(column).rlike(pattern)).withColumn("__m", F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))))
    return found.select(*(c for c in df.columns if c != column), *(F.regexp_extract("__m", pattern, k + 1).alias(n) for k, n in enumerate(names)))


def paged(fetch: Callable[[int], Sequence[dict]], count: int, schema: str, spark: SparkSession) -> DataFrame:
    """The first `count` rows of a service that gives them page by page, from page 1; it ends at an empty page."""
    rows: list[dict] = []
    page = 1
    while len(rows) < count and (got := fetch(page)):
        rows += got
        page += 1
    return spark.createDataFrame([tuple(r.values()) for r in rows[:count]], schema)


def best_matches(answers: DataFrame, config: DataFrame) -> DataFrame:
    """(title, source_id, author, found) for every title of `config` (title, source_id, author): of a service's answers (title, place, answer_title, source_id, authors) the first whose title holds the wanted one, else the first; without any, what the configuration says."""
    holds = F.contains(F.lower("answer_title"), F.lower("title"))
    best = answers.groupBy("title").agg(F.min(F.struct((~F.coalesce(holds, F.lit(False))).alias("other"), "place", "source_id", "authors")).alias("b"))
    author = F.regexp_replace(F.coalesce(F.get("b.authors", F.lit(0)), F.lit("Unknown")), r"^([^,]*),\s*(.*)$", "$2 $1")
    own = config.select("title", F.col("source_id").alias("own_id"), F.col("author").alias("own_author"))
    found = F.col("b").isNotNull()
    return own.join(best, "title", "left").select("title", F.when(found, F.col("b.source_id")).otherwise(F.col("own_id")).alias("source_id"), F.when(found, author).otherwise(F.col("own_author")).alias("author"), found.alias("found"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, heading, text) of EPUB and PDF files; a file that can't be parsed gives no pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    pages: Iterable = epub_pages(c) if c[:2] == b"PK" else [(k + 1, "", t) for k, t in enumerate(pdf_text(c).split("\f"))] if c[:4] == b"%PDF" else []
                    rows += [(p, *x) for x in pages]
                except (KeyError, TypeError, zipfile.BadZipFile):
                    continue
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["path", "page", "heading", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page int, heading string, text string")


def pages_json(pages: list[tuple[int, str, str]]) -> str:
    return json.dumps([{"page": n, "heading": h, "text": t} for n, h, t in pages], ensure_ascii=False)
