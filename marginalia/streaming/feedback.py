"""Votes as they come in: appended, read once each, and the strengths of their users fitted again (SM03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators.bradley_terry import counted, per_user_fit, weighted
from marginalia.operators.dedup import latest


class Feedback:
    """A folder with the votes and strengths of every batch; a batch that is run again overwrites its own part of either.

    Votes are never rewritten: a vote that is delivered again is dropped on reading.
    After a batch only its users are fitted again, over all their votes.
    """

    VOTES = "comparison_id string, user_id string, w long, l long, ingested_at timestamp"
    STRENGTHS = "user_id string, run_id long, bt_score double, n_comparisons long"

    def __init__(self, spark: SparkSession, folder: str, refit: bool = True):
        self.spark, self.folder, self.refit = spark, folder, refit
        self.batches: list[int] = []

    def _read(self, part: str, schema: str) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        root = f"{self.folder}/{part}"
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", root).parquet(*(f"{root}/batch={n}" for n in sorted(set(self.batches))))

    def append(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/votes/batch={number}")
        self.batches.append(number)
        if self.refit:
            users = batch.select("user_id").dropna().distinct()
            pairs = counted(self.votes().filter("w <> l").join(users, "user_id", "left_semi"))
            per_user_fit(weighted(pairs, None, [])).write.mode("overwrite").parquet(f"{self.folder}/strengths/batch={number}")

    def votes(self) -> DataFrame:
        """All votes, each once."""
        return latest(self._read("votes", self.VOTES), ["comparison_id"], "ingested_at", ["batch"]).drop("batch")

    def strengths(self) -> DataFrame:
        """Each user's strengths from the last batch that brought votes of theirs."""
        s = self._read("strengths", self.STRENGTHS)
        last = s.groupBy("user_id").agg(F.max("batch").alias("batch"))
        return s.join(last, ["user_id", "batch"]).drop("batch")
