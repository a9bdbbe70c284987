"""Records of runs, metrics, checks and schemas as rows of tables (SNK19-SNK27, UF12, UF15, AG18)."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

#: Most series of one push, seconds between two, seconds from which a step is slow, tries of a call.
PUSHED_SERIES, PUSH_SPACING, SLOW_SECONDS, TRIES = 200, 30, 300, 5


def schema_rows(df: DataFrame, domain: int = 20) -> DataFrame:
    """(column, type, n_rows, n_present, domain): what a table's rows show of its schema, in one pass.

    `domain` lists a text column's values, in order, if there are no more than so many;
    else, and for other types, it is null. Values are gathered only of columns that a
    sketch of the first pass shows to have few.
    """
    cols = [f for f in df.schema.fields]
    text = [f.name for f in cols if isinstance(f.dataType, T.StringType)]
    q = lambda n: F.col(f"`{n}`")
    counts = df.agg(F.count("*").alias("n"), *(F.count(q(f.name)).alias(f"c{k}") for k, f in enumerate(cols)), *(F.approx_count_distinct(q(n)).alias(f"d{k}") for k, n in enumerate(text))).first()
    few = [n for k, n in enumerate(text) if counts[f"d{k}"] <= 2 * domain]
    found = df.agg(*(F.array_sort(F.collect_set(q(n))).alias(f"v{k}") for k, n in enumerate(few))).first() if few else []
    values = {n: list(v) for n, v in zip(few, found or []) if 0 < len(v) <= domain}
    rows = [(f.name, f.dataType.simpleString(), counts["n"], counts[f"c{k}"], ",".join(values[f.name]) if f.name in values else None) for k, f in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, type string, n_rows long, n_present long, domain string")


def schema_anomalies(df: DataFrame, schema: DataFrame) -> DataFrame:
    """(column, anomaly, n) of rows against the schema rows of other ones: columns gone or new, another type, missing where none was, values outside a domain. The schema is a row per column."""
    known = {r["column"]: r for r in schema.collect()}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [(c, "gone", None) for c in known if c not in types] + [(c, "new", None) for c in types if c not in known]
    out += [(c, "type", None) for c, r in known.items() if c in types and types[c] != r["type"]]
    checks = {}
    for c, r in known.items():
        if types.get(c) == r["type"]:
            if r["n_present"] == r["n_rows"]:
                checks[c, "missing"] = F.col(f"`{c}`").isNull()
            if r["domain"] is not None:
                checks[c, "value"] = F.coalesce(~F.col(f"`{c}`").isin(*r["domain"].split(",")), F.lit(False))
    if checks:
        row = df.agg(*(F.count_if(x) for x in checks.values())).first()
        out += [(c, a, n) for (c, a), n in zip(checks, row) if n]
    return df.sparkSession.createDataFrame(out, "column string, anomaly string, n long")


def metric_rows(runs: DataFrame, run_id: str, metrics: Sequence[str], parent: Column | None = None) -> DataFrame:
    """(run_id, parent_id, metric, value): a run's numbers as rows; nulls are no metrics."""
    long = runs.withColumn("parent_id", F.lit(None).cast("string") if parent is None else parent).select(F.col(run_id).cast("string").alias("run_id"), "parent_id", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["run_id", "parent_id"], list(metrics), "metric", "value")
    return long.filter(F.col("value").isNotNull())


def pushes(series: DataFrame, metric: str, labels: Sequence[str], size: int = PUSHED_SERIES) -> DataFrame:
    """`series` with push_no, from 0: those of one metric go out in pushes of at most `size`, in the order of their labels."""
    place = F.row_number().over(W.partitionBy(metric).orderBy(*labels))
    return series.withColumn("push_no", F.floor((place - 1) / size).cast("int"))


class Pusher:
    """Lets a push through only when the last one is long enough ago."""

    def __init__(self, push: Callable[[DataFrame], None], spacing: float = PUSH_SPACING, clock: Callable[[], float] = time.monotonic):
        self.push, self.spacing, self.clock, self.last = push, spacing, clock, None

    def __call__(self, df: DataFrame) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.spacing:
            return False
        self.last = now
        self.push(df)
        return True


def markdown(df: DataFrame, title: str, order: Sequence[str]) -> DataFrame:
    """(line_no, line) of a small result as a Markdown table: title, blank line, head, rule, one line a row. For reports: their rows go through one task."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    rows = df.select((F.row_number().over(W.orderBy(*order)) + 4).alias("line_no"), cells.alias("line"))
    head = [(1, f"## {title}"), (2, ""), (3, f"| {' | '.join(df.columns)} |"), (4, f"|{'---|' * len(df.columns)}")]
    return df.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(rows)


def check_row(spark: SparkSession, name: str, counts: Mapping[str, int], passed: bool) -> DataFrame:
    """One row of a checks table: (check, status, counts as JSON)."""
    text = "{" + ",".join(f'"{k}":{v}' for k, v in counts.items()) + "}"
    return spark.createDataFrame([(name, "PASSED" if passed else "FAILED", text)], "check string, status string, counts string")


def returning_ids(target: DataFrame, new: DataFrame, id_col: str, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(target with the new rows, their ids): an id comes from the key's values, so an insert that is run again finds its rows there."""
    ids = new.withColumn(id_col, F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)))).dropDuplicates([id_col])
    fresh = ids.join(target.select(id_col), id_col, "left_anti")
    return target.unionByName(fresh.select(*target.columns)), ids.select(id_col, *key)


def timed(spark: SparkSession, steps: Mapping[str, Callable[[], object]], slow: float = SLOW_SECONDS, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """(step, seconds, slow, error) of steps run one after another; a step that fails doesn't stop the others."""
    rows = []
    for name, step in steps.items():
        start, error = clock(), None
        try:
            step()
        except Exception as e:  # noqa: BLE001 - what went wrong is the record
            error = f"{type(e).__name__}: {e}"[:200]
        seconds = clock() - start
        rows.append((name, float(seconds), seconds > slow, error))
    return spark.createDataFrame(rows, "step string, seconds double, slow boolean, error string")


def retried(call: Callable[[], object], tries: int = TRIES, wait: float = 1.0, again: Callable[[Exception], bool] = lambda e: "503" in str(e), sleep: Callable[[float], None] = time.sleep) -> tuple[object, int, str | None]:
    """(result, tries made, error) of a call that is made again after waiting longer each time, as long as its error says that it may help."""
    for k in range(1, tries + 1):
        try:
            return call(), k, None
        except Exception as e:  # noqa: BLE001
            if k == tries or not again(e):
                return None, k, str(e)
            sleep(wait * k)
    return None, 0, None


class Functions:
    """Named SQL functions of a session, and a log of the calls made through it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known, self.log = spark, {}, []

    def add(self, name: str, params: str, returns: str, body: str) -> None:
        """A function that Spark puts in where it is called: nothing runs outside the plan."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
        self.known[name] = (params, returns)

    def call(self, name: str, *columns: str) -> Column:
        if name not in self.known:
            raise KeyError(f"no function {name}")
        self.log.append((len(self.log) + 1, name, ", ".join(columns)))
        return F.call_function(name, *map(F.col, columns))

    def calls(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, "call_no int, function string, arguments string")
