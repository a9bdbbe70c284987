"""Queries of records: schemas, run metrics, pushes, reports, checks, inserts that give ids, named functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions.rounding import half_even
from marginalia.operators.records import Functions, check_row, markdown, metric_rows, pushes, retried, returning_ids, schema_anomalies, schema_rows, timed
from marginalia.operators.tables_dml import delete, upsert
from marginalia.plans.ranking_queries import edges
from marginalia.plans.registry import query
from marginalia.session import scratch
from marginalia.sources.sinks import VersionedTable
from marginalia.tables import table


def _new(spark: SparkSession, name: str) -> VersionedTable:
    return VersionedTable(spark, f"{scratch(spark)}/{name}-{uuid.uuid4().hex}")


_RUN_COLUMNS = {"run_id": "bigint", "user_a": "string", "book_id": "string", "think_r": "int", "confidence": "double", "dominant_think": "string"}


def _schema_sql(where: str = "") -> str:
    domain = "CASE WHEN count(DISTINCT {0}) BETWEEN 1 AND 20 THEN string_agg(DISTINCT {0}, ',' ORDER BY {0}) END"
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, count({c}) AS n_present, {domain.format(c) if t == 'string' else 'CAST(NULL AS VARCHAR)'} AS domain FROM compat_runs {where}" for c, t in _RUN_COLUMNS.items())


@query("snk19_schema", _schema_sql())
def snk19_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK19, AG18: the schema that the runs show: types, presence, and the values of columns with few."""
    return schema_rows(table(spark, sf_dir, "compat_runs").select(*_RUN_COLUMNS))


@query("ag18_anomalies", f"""WITH s AS ({_schema_sql("WHERE think_r <= 60 AND dominant_think <> 'resonate'")}), d AS (SELECT string_split(domain, ',') AS d FROM s WHERE "column" = 'dominant_think' AND domain IS NOT NULL) SELECT 'dominant_think' AS "column", 'value' AS anomaly, count(*) AS n FROM compat_runs, d WHERE NOT list_contains(d, dominant_think) HAVING count(*) > 0 UNION ALL SELECT 'verdict', 'new', NULL UNION ALL SELECT 'book_id', 'gone', NULL""")
def ag18_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18, AG49: all runs against the schema that a part of them shows, whose columns and values differ."""
    runs = table(spark, sf_dir, "compat_runs")
    same = [c for c in _RUN_COLUMNS if c not in ("book_id", "user_a")]
    seen = schema_rows(runs.filter("think_r <= 60 AND dominant_think <> 'resonate'").select(*same, "book_id"))
    return schema_anomalies(runs.select(*same, "verdict"), seen)


_METRICS = ("confidence", "think_r", "think_c", "think_d")


@query("snk22_run_metrics", " UNION ALL ".join([*(f"SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS parent_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM compat_runs WHERE {m} IS NOT NULL" for m in _METRICS), *(f"SELECT concat(run_id, '-', {u}), CAST(run_id AS VARCHAR), 'id_length', CAST(length({u}) AS DOUBLE) FROM compat_runs WHERE {u} IS NOT NULL" for u in ("user_a", "user_b"))]))
def snk22_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK22: metrics of runs, and of a child run for each of their readers, appended to a table of records."""
    runs = table(spark, sf_dir, "compat_runs")
    t = _new(spark, "metrics")
    t.append(metric_rows(runs, "run_id", _METRICS))
    children = edges(runs).filter("user_id IS NOT NULL").select(F.concat_ws("-", "run_id", "user_id").alias("child"), F.col("run_id").cast("string").alias("parent"), F.length("user_id").alias("id_length"))
    t.append(metric_rows(children, "child", ["id_length"], F.col("parent")))
    return t.read()


@query("snk23_pushes", "WITH s AS (SELECT event_type AS metric, user_id AS label, count(*) AS value FROM events GROUP BY 1, 2) SELECT *, CAST((row_number() OVER (PARTITION BY metric ORDER BY label) - 1) // 200 AS INTEGER) AS push_no FROM s")
def snk23_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK23: series of each metric dealt to pushes of at most 200."""
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.col("user_id").alias("label")).agg(F.count("*").alias("value"))
    return pushes(s, "metric", ["label"])


@query("snk24_report", "WITH c AS (SELECT dominant_think, count(*) AS n, min(think_r) AS least FROM compat_runs GROUP BY 1), l AS (SELECT row_number() OVER (ORDER BY n DESC, dominant_think) + 4 AS line_no, concat('| ', dominant_think, ' | ', n, ' | ', least, ' |') AS line FROM c) SELECT CAST(line_no AS INTEGER) AS line_no, line FROM l UNION ALL SELECT * FROM (VALUES (1, '## Runs'), (2, ''), (3, '| dominant_think | n | least |'), (4, '|---|---|---|')) v(line_no, line)")
def snk24_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK24: a result as the lines of a Markdown report."""
    c = table(spark, sf_dir, "compat_runs").groupBy("dominant_think").agg(F.count("*").alias("n"), F.min("think_r").alias("least"))
    return markdown(c, "Runs", [F.desc("n"), F.asc("dominant_think")])


@query("snk25_checks", "WITH c AS (SELECT count(*) AS n, count(*) FILTER (verdict IS NULL OR verdict = '') AS bad, count(*) FILTER (user_a = user_b) AS self FROM compat_runs) SELECT 'verdicts' AS \"check\", CASE WHEN bad = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, concat('{\"rows\":', n, ',\"missing\":', bad, '}') AS counts FROM c UNION ALL SELECT 'pairs', CASE WHEN self = 0 THEN 'PASSED' ELSE 'FAILED' END, concat('{\"rows\":', n, ',\"self\":', self, '}') FROM c")
def snk25_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK25: one row a check, appended to a table of checks."""
    r = table(spark, sf_dir, "compat_runs").agg(F.count("*").alias("n"), F.count_if(F.coalesce("verdict", F.lit("")) == "").alias("bad"), F.count_if(F.col("user_a") == F.col("user_b")).alias("self")).first()
    t = _new(spark, "checks")
    t.append(check_row(spark, "verdicts", {"rows": r.n, "missing": r.bad}, r.bad == 0))
    t.append(check_row(spark, "pairs", {"rows": r.n, "self": r.self}, r.self == 0))
    return t.read()


@query("snk26_alert_texts", "SELECT event_type AS label, concat('[', CASE WHEN count(*) FILTER (value > 90) * 20 >= count(*) THEN 'CRITICAL' ELSE 'INFO' END, '] ', event_type, ': ', count(*) FILTER (value > 90), ' of ', count(*), ' above 90') AS text FROM events GROUP BY 1")
def snk26_alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK26: what an alert says; sending it is not the engine's."""
    high = F.count_if(F.col("value") > 90)
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(high.alias("h"), F.count("*").alias("n"))
    level = F.when(F.col("h") * 20 >= F.col("n"), "CRITICAL").otherwise("INFO")
    return e.select("label", F.concat(F.lit("["), level, F.lit("] "), "label", F.lit(": "), F.col("h").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" above 90")).alias("text"))


@query("snk27_returned_ids", "SELECT DISTINCT md5(concat_ws('|', coalesce(user_a, ''), coalesce(book_id, ''))) AS shelf_id, coalesce(user_a, '') AS user_a, coalesce(book_id, '') AS book_id FROM compat_runs")
def snk27_returned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK27: rows inserted twice, of which each gets its one id back."""
    new = table(spark, sf_dir, "compat_runs").select(F.coalesce("user_a", F.lit("")).alias("user_a"), F.coalesce("book_id", F.lit("")).alias("book_id"))
    t = _new(spark, "shelves")
    empty = spark.createDataFrame([], "shelf_id string, user_a string, book_id string")
    for _ in range(2):
        rows, ids = returning_ids(t.read(empty.schema), new, "shelf_id", ["user_a", "book_id"])
        t.write(rows)
    return ids.join(t.read(), ["shelf_id", "user_a", "book_id"], "left_semi").select("shelf_id", "user_a", "book_id")


@query("snk06_chunks", "SELECT true AS bounded, count(*) AS n FROM compat_runs")
def snk06_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK06: one append, in files of at most 500 rows."""
    path = f"{scratch(spark)}/chunks-{uuid.uuid4().hex}"
    table(spark, sf_dir, "compat_runs").select("run_id", "confidence").write.option("maxRecordsPerFile", 500).mode("append").parquet(path)
    files = spark.read.schema("run_id long, confidence double").parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return files.agg(F.coalesce(F.max("n") <= 500, F.lit(True)).alias("bounded"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("snk11_truncated", "SELECT book_id, count(*) AS n FROM compat_runs GROUP BY 1")
def snk11_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11: a table emptied before it is worked out again, so that nothing of the run before is left."""
    n = table(spark, sf_dir, "compat_runs").groupBy("book_id").agg(F.count("*").alias("n"))
    t = _new(spark, "recomputed")
    t.write(n)
    t.truncate()
    t.append(n)
    return t.read()


@query("snk16_vectors", "SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS version, CAST(len(embedding) AS INTEGER) AS width FROM embeddings WHERE label <> 3 AND vec_id % 7 <> 0")
def snk16_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK16, SRC22: a collection of vectors: some put in again, some deleted by their id, all of one label deleted."""
    v = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").withColumn("version", F.lit(1))
    c = upsert(v, v.filter("vec_id % 5 = 0").withColumn("version", F.lit(2)), ["vec_id"])
    c = delete(c, v.filter("vec_id % 7 = 0").select("vec_id"), ["vec_id"])
    c = delete(c, v.filter("label = 3").select("label").distinct(), ["label"])
    return c.select("vec_id", "label", "version", F.size("embedding").alias("width"))


@query("uf12_functions", "SELECT run_id, round_even(CAST(think_r + feel_r AS DOUBLE) / 2, 1) AS agreement, CASE WHEN confidence >= 0.75 THEN 'sure' ELSE 'open' END AS label FROM compat_runs")
def uf12_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UF12: named functions of the session, which the optimizer puts in where they are called."""
    f = Functions(spark)
    f.add("marginalia_agreement", "a INT, b INT", "DOUBLE", "CAST(a + b AS DOUBLE) / 2")
    f.add("marginalia_label", "c DOUBLE", "STRING", "CASE WHEN c >= 0.75 THEN 'sure' ELSE 'open' END")
    return table(spark, sf_dir, "compat_runs").select("run_id", half_even(f.call("marginalia_agreement", "think_r", "feel_r"), 1).alias("agreement"), f.call("marginalia_label", "confidence").alias("label"))


@query("uf15_timed_steps", "SELECT * FROM (VALUES ('count', false, NULL), ('fail', false, 'ValueError: no rows'), ('sum', false, NULL)) t(step, slow, error)")
def uf15_timed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UF15: steps with how long they took, whether that is too long, and what went wrong."""
    r = table(spark, sf_dir, "compat_runs")

    def fail() -> None:
        raise ValueError("no rows")

    return timed(spark, {"count": r.count, "fail": fail, "sum": lambda: r.agg(F.sum("think_r")).first()}).drop("seconds")


@query("sm14_retries", "SELECT run_id, CAST(least(run_id % 8 + 1, 5) AS INTEGER) AS tries, run_id % 8 < 5 AS scored FROM compat_runs")
def sm14_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM14: a call per row to a service that is busy for the first few tries of some rows; five tries, waiting longer each time."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for i in b["run_id"]:
                left = iter(range(int(i) % 8))

                def call(left=left):
                    if next(left, None) is not None:
                        raise OSError("503 busy")
                    return True

                result, tries, _ = retried(call, sleep=lambda s: None)
                rows.append((i, tries, result is True))
            yield pd.DataFrame(rows, columns=["run_id", "tries", "scored"])

    return table(spark, sf_dir, "compat_runs").filter("run_id IS NOT NULL").select("run_id").mapInPandas(run, "run_id long, tries int, scored boolean")


@query("sm13_confirmed", "SELECT CASE WHEN confidence IS NOT NULL AND run_id % 4 <> 0 THEN CAST(run_id AS VARCHAR) ELSE concat('tmp-', md5(CAST(run_id AS VARCHAR))) END AS shown_id, run_id % 4 <> 0 AND confidence IS NOT NULL AS confirmed FROM compat_runs")
def sm13_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM13: rows shown under an id of their own at once, which the stored one replaces when it is confirmed."""
    r = table(spark, sf_dir, "compat_runs").withColumn("tmp", F.concat(F.lit("tmp-"), F.md5(F.col("run_id").cast("string"))))
    stored = r.filter("confidence IS NOT NULL AND run_id % 4 <> 0").select("tmp", F.col("run_id").cast("string").alias("id"))
    return r.select("tmp").join(stored, "tmp", "left").select(F.coalesce("id", "tmp").alias("shown_id"), F.col("id").isNotNull().alias("confirmed"))
