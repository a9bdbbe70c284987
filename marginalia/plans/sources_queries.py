"""Queries that go through files of other formats: written to the shared scratch folder and read again."""

from __future__ import annotations

import html
import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions.rounding import half_even
from marginalia.plans.registry import ORACLES, query
from marginalia.plans.scoring_queries import jn23_cached_claims
from marginalia.session import scratch
from marginalia.sources.readers import best_matches, list_files, load_yaml, paged, parse_log_lines, read_all, read_any, read_books, read_csv, read_json, read_json_or_default, regex_rows, run_query
from marginalia.sources.sinks import VersionedTable, write_any
from marginalia.tables import table

_BOOKS = "SELECT book_id, title, author, pub_year, book_lang FROM books"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("book_id", "title", "author", "pub_year", "book_lang")


def _new(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"


@query("src01_json_lines", _BOOKS)
def src01_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01, SRC04, SRC07, SNK01, SNK20: JSON out and in again."""
    write_any(_books(spark, sf_dir), path := _new(spark, "books.json"))
    return read_json(spark, path, "book_id string, title string, author string, pub_year int, book_lang string")


@query("src02_csv_keeps_empty", "SELECT book_id, coalesce(book_lang, '') AS book_lang, coalesce(CAST(pub_year AS VARCHAR), '') AS pub_year FROM books")
def src02_csv_keeps_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC02: missing values are empty text."""
    write_any(_books(spark, sf_dir), path := _new(spark, "books.csv"))
    return read_csv(spark, path, keep_empty=True).select("book_id", "book_lang", "pub_year")


@query("src03_csv_missing", "SELECT book_id, title, book_lang, pub_year FROM books")
def src03_csv_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03: signs of missing values are null."""
    df = _books(spark, sf_dir).withColumn("book_lang", F.coalesce("book_lang", F.lit("N/A")))
    write_any(df, path := _new(spark, "books.csv"))
    return read_csv(spark, path, "book_id string, title string, author string, pub_year int, book_lang string").select("book_id", "title", "book_lang", "pub_year")


@query("src05_files", "SELECT CAST(3 AS BIGINT) AS folders, true AS filled")
def src05_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC05: files below a prefix."""
    root = _new(spark, "many")
    for fmt in ("csv", "json", "parquet"):
        write_any(_books(spark, sf_dir), f"{root}/books.{fmt}")
    files = list_files(spark, root, "part-*")
    return files.agg(F.count_distinct(F.regexp_extract("path", r"books\.(\w+)/", 1)).alias("folders"), (F.min("size") > 0).alias("filled"))


@query("src06_any_format", " UNION ALL ".join(f"SELECT '{f}' AS format, count(*) AS n, count(pub_year) AS dated FROM books" for f in ("csv", "json", "orc", "parquet")))
def src06_any_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC06, SRC08, SRC09, SNK02: one reader and writer for every format."""
    paths = {}
    for fmt in ("csv", "json", "orc", "parquet"):
        write_any(_books(spark, sf_dir), path := _new(spark, f"books.{fmt}"))
        paths[fmt] = path
    schema = "book_id string, title string, author string, pub_year int, book_lang string"
    tables, _ = read_all(spark, paths | {"gone": _new(spark, "gone.csv")}, dict.fromkeys(paths, schema))
    out = None
    for fmt, df in tables.items():
        row = df.agg(F.count("*").alias("n"), F.count("pub_year").alias("dated")).select(F.lit(fmt).alias("format"), "n", "dated")
        out = row if out is None else out.unionByName(row)
    return out


@query("src15_parameters", "SELECT run_id, confidence FROM compat_runs WHERE confidence >= 0.7 AND dominant_think = 'diverge'")
def src15_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13-SRC15: a query with bound parameters."""
    table(spark, sf_dir, "compat_runs").createOrReplaceTempView("marginalia_runs")
    return run_query(spark, "SELECT run_id, confidence FROM marginalia_runs WHERE confidence >= :least AND dominant_think = :kind", least=0.7, kind="diverge")


_LINES = r"SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(text, 'rc=\d')"


@query("src19_log_lines", rf"WITH l AS ({_LINES}), p AS (SELECT regexp_extract(line, '^\s*\[(\d{{2}}:\d{{2}}:\d{{2}})\]\s+(\w+)\s+(\S+)\s+rc=(\d+)', ['t', 'level', 'task', 'rc']) AS x FROM l WHERE regexp_matches(line, '^\s*\[(\d{{2}}:\d{{2}}:\d{{2}})\]\s+(\w+)\s+(\S+)\s+rc=(\d+)')) SELECT string_split(x.task, '.')[1] AS task, x.level AS level, count(*) AS n, CAST(sum(CAST(x.rc AS INTEGER)) AS BIGINT) AS rc FROM p GROUP BY 1, 2")
def src19_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19, AG43: log lines by task and level."""
    lines = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"rc=\d")).select(F.explode(F.split("text", "\n")).alias("value"))
    return parse_log_lines(lines).groupBy("task", "level").agg(F.count("*").alias("n"), F.sum("rc").alias("rc"))


@query("src23_default", "SELECT CAST(0 AS BIGINT) AS n")
def src23_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC23: a missing file is an empty table."""
    return read_json_or_default(spark, _new(spark, "gone.json"), "id string").agg(F.count("*").alias("n"))


@query("snk03_versions", "SELECT CAST(2 * count(*) AS BIGINT) AS n, count(DISTINCT book_id) AS books FROM books")
def snk03_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03, SNK04, SNK09, SNK17, H5: versions of a table, and the append that makes the next one."""
    t = VersionedTable(spark, _new(spark, "versions"))
    t.write(_books(spark, sf_dir))
    t.write(t.read().unionByName(_books(spark, sf_dir)))
    return t.read().agg(F.count("*").alias("n"), F.count_distinct("book_id").alias("books"))


@query("src06_by_extension", _BOOKS)
def src06_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC06: the format from the name."""
    write_any(_books(spark, sf_dir), path := _new(spark, "books.parquet"))
    return read_any(spark, path)


_LEVELS = r"p AS (SELECT regexp_extract(line, '^\s*\[(\d{2}:\d{2}:\d{2})\]\s+(\w+)\s+(\S+)\s+rc=(\d+)', ['t', 'level', 'task', 'rc']) AS x FROM l WHERE regexp_matches(line, '^\s*\[(\d{2}:\d{2}:\d{2})\]\s+(\w+)\s+(\S+)\s+rc=(\d+)'))"


@query("ag44_success_rates", f"WITH l AS ({_LINES}), {_LEVELS} SELECT string_split(x.task, '.')[1] AS task, count(*) FILTER (x.level <> 'ERROR') AS succeeded, count(*) FILTER (x.level = 'ERROR') AS failed, round_even(CAST(count(*) FILTER (x.level <> 'ERROR') AS DOUBLE) / count(*), 4) AS rate FROM p GROUP BY 1")
def ag44_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG44: how many runs of each task went well and how many failed, and the rate."""
    lines = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"rc=\d")).select(F.explode(F.split("text", "\n")).alias("value"))
    failed = F.count_if(F.col("level") == "ERROR")
    return parse_log_lines(lines).groupBy("task").agg((F.count("*") - failed).alias("succeeded"), failed.alias("failed"), half_even((F.count("*") - failed).cast("double") / F.count("*"), 4).alias("rate"))


_CONFIG = """
gates:
  least_confidence: 0.6
  kinds: [resonate, diverge]
"""


@query("src16_config", "SELECT run_id FROM compat_runs WHERE confidence >= 0.6 AND dominant_think IN ('resonate', 'diverge')")
def src16_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: limits of a YAML file as values of the plan."""
    gates = load_yaml(_CONFIG)["gates"]
    return table(spark, sf_dir, "compat_runs").filter((F.col("confidence") >= gates["least_confidence"]) & F.col("dominant_think").isin(*gates["kinds"])).select("run_id")


_ANSWERED = "ascii(book_id) % 4"


@query("src17_book_lookup", rf"SELECT book_id AS title, CASE WHEN {_ANSWERED} = 0 THEN gutenberg_id WHEN {_ANSWERED} = 1 THEN concat('other-', book_id) ELSE concat('id-', book_id) END AS source_id, CASE WHEN {_ANSWERED} = 0 THEN author WHEN {_ANSWERED} = 1 THEN 'Unknown' ELSE coalesce(regexp_replace(author, '^([^,]*),\s*(.*)$', '\2 \1'), 'Unknown') END AS author, {_ANSWERED} <> 0 AS found FROM books")
def src17_book_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17: books looked up by a service's answers, made here from the books: a quarter without an answer, a quarter with a wrong one only, the rest with a wrong one first."""
    b = table(spark, sf_dir, "books").select("book_id", "author", "gutenberg_id", F.expr(_ANSWERED).alias("k"))
    wrong = b.filter("k <> 0").select(F.col("book_id").alias("title"), F.lit(1).alias("place"), F.lit("another").alias("answer_title"), F.concat(F.lit("other-"), "book_id").alias("source_id"), F.array().cast("array<string>").alias("authors"))
    right = b.filter("k > 1").select(F.col("book_id").alias("title"), F.lit(2).alias("place"), F.concat(F.lit("The "), F.upper("book_id")).alias("answer_title"), F.concat(F.lit("id-"), "book_id").alias("source_id"), F.array("author").alias("authors"))
    return best_matches(wrong.unionByName(right), b.select(F.col("book_id").alias("title"), F.col("gutenberg_id").alias("source_id"), "author"))


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


def _epub(book_id: str, title: str, passage: str) -> bytes:
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        z.writestr("OPS/b.opf", '<package><manifest><item id="c1" href="c1.xhtml"/><item id="c2" href="c2.xhtml"/></manifest><spine><itemref idref="c2"/><itemref idref="c1"/></spine></package>')
        z.writestr("OPS/c1.xhtml", f"<html><body><h2>{html.escape(title)}</h2><p>{html.escape(passage)}</p></body></html>")
        z.writestr("OPS/c2.xhtml", "<html><body>Cover</body></html>")
    return box.getvalue()


@query("src20_epub_pages", r"SELECT book_id, CAST(1 AS INTEGER) AS page, title AS heading, length(trim(regexp_replace(concat(title, ' ', opening_passage), '\s+', ' ', 'g'))) AS n_chars FROM books WHERE title IS NOT NULL AND opening_passage IS NOT NULL AND length(trim(regexp_replace(concat(title, ' ', opening_passage), '\s+', ' ', 'g'))) > 40")
def src20_epub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20, UF11: EPUB files made of the fixed table of books, read again as pages; short pages are left out."""
    folder = _new(spark, "epub")
    rows = table(spark, sf_dir, "books").select("book_id", "title", "opening_passage").dropna().collect()
    for r in rows:
        _put(spark, f"{folder}/{r.book_id}.epub", _epub(*r))
    if not rows:
        return spark.createDataFrame([], "book_id string, page int, heading string, n_chars long")
    pages = read_books(spark, f"{folder}/*.epub")
    return pages.select(F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("book_id"), "page", "heading", F.length("text").cast("long").alias("n_chars"))


@query("src18_pdf_rows", "SELECT book_id, title, CAST(coalesce(pub_year, 0) AS VARCHAR) AS year FROM books WHERE title IS NOT NULL AND regexp_full_match(title, '[ -~]*')")
def src18_pdf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18, UF10: PDF files made of the fixed table of books, their text, and the fields that a pattern finds in it."""
    folder = _new(spark, "pdf")
    rows = table(spark, sf_dir, "books").filter(F.col("title").rlike("^[ -~]*$")).select("book_id", "title", F.coalesce("pub_year", F.lit(0)).alias("y")).collect()
    for r in rows:
        title = "".join(f"\\{c}" if c in "()\\" else c for c in r.title)
        _put(spark, f"{folder}/{r.book_id}.pdf", f"%PDF-1.4\nstream\nBT (Book: {r.book_id}) Tj T* (Title: {title}) Tj T* <{f'Year: {r.y}'.encode().hex()}> Tj ET\nendstream".encode())
    if not rows:
        return spark.createDataFrame([], "book_id string, title string, year string")
    return regex_rows(read_books(spark, f"{folder}/*.pdf").select("text"), "text", r"Book: (\S+)\nTitle: ([^\n]*)\nYear: (\d+)", ["book_id", "title", "year"])


def _saved(spark: SparkSession, df: DataFrame, name: str) -> str:
    write_any(df, path := _new(spark, f"{name}.parquet"))
    return path


@query("src24_replay", f"WITH k AS ({ORACLES['jn23_cached_claims']}) SELECT run_id, CAST(coalesce(a.n_claims, 0) AS INTEGER) AS claims_a, CAST(coalesce(b.n_claims, 0) AS INTEGER) AS claims_b, a.n_claims IS NOT NULL AND b.n_claims IS NOT NULL AS replayable FROM compat_runs r LEFT JOIN k a ON r.user_a = a.user_id AND r.book_id = a.book_id AND r.passage_id = a.passage_id LEFT JOIN k b ON r.user_b = b.user_id AND r.book_id = b.book_id AND r.passage_id = b.passage_id")
def src24_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC24, JN12: saved runs replayed with the saved claims of both of their readers."""
    claims, runs = (read_any(spark, _saved(spark, df, name)) for name, df in (("claims", jn23_cached_claims(spark, sf_dir)), ("runs", table(spark, sf_dir, "compat_runs").select("run_id", "user_a", "user_b", "book_id", "passage_id"))))
    side = lambda s: claims.select(F.col("user_id").alias(f"user_{s}"), "book_id", "passage_id", F.col("n_claims").alias(f"n_{s}"))
    r = runs.join(side("a"), ["user_a", "book_id", "passage_id"], "left").join(side("b"), ["user_b", "book_id", "passage_id"], "left")
    return r.select("run_id", *(F.coalesce(f"n_{s}", F.lit(0)).alias(f"claims_{s}") for s in "ab"), (F.col("n_a").isNotNull() & F.col("n_b").isNotNull()).alias("replayable"))


@query("src25_pages", "SELECT book_id, title FROM books ORDER BY title NULLS FIRST, book_id LIMIT 100")
def src25_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC25: the first hundred of a list that comes in pages of 32."""
    b = table(spark, sf_dir, "books").orderBy(F.asc_nulls_first("title"), "book_id").select("book_id", "title")
    fetch = lambda page: [r.asDict() for r in b.offset(32 * (page - 1)).limit(32).collect()]
    return paged(fetch, 100, "book_id string, title string", spark)


@query("ma02_tenths", "SELECT run_id, round_even(CAST(think_r AS DOUBLE) / 7, 1) AS a, round_even(confidence * 100 / 3, 1) AS b FROM compat_runs")
def ma02_tenths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA02, T2: numbers rounded to tenths by scaling, as arrays round."""
    return table(spark, sf_dir, "compat_runs").select("run_id", half_even(F.col("think_r").cast("double") / 7, 1).alias("a"), half_even(F.col("confidence") * 100 / 3, 1).alias("b"))
