"""Structured Streaming helpers: bounded runs over the files that are there, into tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators.dedup import latest
from marginalia.session import scratch


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table's files, be it one file or a folder of files. Times without a zone become timestamps in UTC."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    df = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return with_zone(df)


def stream_folder(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the files of a folder, `files` of them a batch."""
    reader = spark.readStream.schema(schema)
    return with_zone((reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder))


def with_zone(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in df.schema.fields))


def run_available(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Process all that is there, batch by batch, and stop. State and offsets lie in the shared folder; a run with the checkpoint of another one goes on where that ended."""
    where = checkpoint or new_folder(stream.sparkSession, "stream")
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def run_periodic(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], seconds: float, until: Callable[[object], None] | None = None) -> None:
    """A batch every so many seconds; `until` gets the running query and returns when it is to stop, by default when all that was there is done."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", new_folder(stream.sparkSession, "stream")).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
    try:
        (until or (lambda x: x.processAllAvailable()))(q)
    finally:
        q.stop()


def to_table(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), checkpoint: str | None = None) -> DataFrame:
    """The result of a bounded run: all batches' rows; in update mode each key's row of the last batch that has it. A batch that is run again overwrites its own folder."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "out")
    seen: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        seen.append(number)

    run_available(stream, mode, each, checkpoint)
    if not seen:
        return spark.createDataFrame([], stream.schema)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())]) if mode == "update" else stream.schema
    out = spark.read.schema(schema).option("basePath", folder).parquet(folder) if mode == "update" else spark.read.schema(schema).parquet(*(f"{folder}/batch={n}" for n in sorted(set(seen))))
    return latest(out, list(keys), "batch").drop("batch") if mode == "update" else out


def last_n_stats(stream: DataFrame, label: str, value: str, order: str, tie: str, n: int = 1000) -> DataFrame:
    """(label, n, mean, p95) of the last n observations of each label (SM08), nulls left out.

    The state is a table of at most n rows a label, one version a batch. Of a batch each
    task keeps its last n of a label before they are shuffled, so a hot label is no
    large group anywhere.
    """
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "last")
    cut = stream.filter(F.col(value).isNotNull()).select(F.col(label).cast("string").alias("label"), F.unix_micros(order).alias("at"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("v"))
    state: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        before = [k for k in state if k < number]
        rows = batch if not before else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/{before[-1]}"))
        w = W.partitionBy("label").orderBy(F.desc("at"), F.desc("tie"))
        rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k").write.mode("overwrite").parquet(f"{folder}/{number}")
        state.append(number)

    run_available(cut, "append", each)
    held = spark.read.schema(cut.schema).parquet(f"{folder}/{state[-1]}") if state else spark.createDataFrame([], cut.schema)
    s = held.groupBy("label").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list("v")).alias("s"), F.sum(F.col("v").cast("decimal(30,9)")).cast("double").alias("total"))
    return s.select("label", "n", (F.col("total") / F.col("n")).alias("mean"), F.get("s", F.floor(F.col("n") * F.lit(0.95)).cast("int")).alias("p95"))


def breaches(events: DataFrame, threshold: float, width: str = "5 minutes") -> DataFrame:
    """(label, at, mean, breach): means over aligned windows and whether they exceed the threshold."""
    w = events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.avg("value").alias("mean"))
    return w.select(F.col("event_type").alias("label"), F.col("w.start").alias("at"), "mean", (F.col("mean") > threshold).alias("breach"))


def sustained(means: DataFrame, levels: dict[str, tuple[float, int]], width: int) -> DataFrame:
    """(label, level, first_us, windows) of the times over which a label's means (label, at_us, mean), a row per window of `width` seconds, stay above a level's threshold for its seconds or longer. A window without a mean ends nothing."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.lit(float(t)).alias("threshold"), F.lit(max(1, -(-s // width))).alias("least")) for n, (t, s) in levels.items())))
    b = means.withColumn("x", each).select("label", "at_us", "x.level", "x.least", (F.col("mean") > F.col("x.threshold")).alias("breach"))
    island = F.row_number().over(W.partitionBy("label", "level").orderBy("at_us")) - F.row_number().over(W.partitionBy("label", "level", "breach").orderBy("at_us"))
    runs = b.withColumn("island", island).filter("breach").groupBy("label", "level", "least", "island").agg(F.min("at_us").alias("first_us"), F.count("*").alias("windows"))
    return runs.filter("windows >= least").select("label", "level", "first_us", "windows")


def rate_limited(stream: DataFrame, label: str, at_us: str, period_us: int) -> DataFrame:
    """(label, alert_us): of the times of each label those at least a period after the last one let through; the state of a label is that one number. Times of a batch are taken in order, a time before the last one let through is dropped."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        out = []
        for t in sorted(t for p in parts for t in p["__at"]):
            if last is None or t - last >= period_us:
                out.append(t)
                last = t
        if last is not None:
            held.update((last,))
        yield pd.DataFrame({"label": [str(key[0])] * len(out), "alert_us": pd.Series(out, dtype="int64")})

    cut = stream.select(F.col(label).cast("string").alias("label"), F.col(at_us).alias("__at")).dropna()
    return cut.groupBy("label").applyInPandasWithState(run, "label string, alert_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_new_days(df: DataFrame, day: str, folder: str) -> list[str]:
    """Append the rows of those days that the table in `folder`, a part a day, doesn't hold yet; days that are there are never worked on again. Returns the days."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = {s.getPath().getName().removeprefix(f"{day}=") for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith(f"{day}=")}
    new = sorted(r[0] for r in df.select(day).dropna().distinct().collect() if r[0] not in done)
    if new:
        df.filter(F.col(day).isin(*new)).write.mode("append").partitionBy(day).parquet(folder)
    return new
