"""The engine's public functions (survey 2.13, UF13, UF14): each takes ids or rows and returns DataFrames.

Reads see the tables of a folder and, over them, what was written through this object;
a write makes the next version of a table in `folder` and never touches the files read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marginalia.functions.json_text import merged
from marginalia.operators.bradley_terry import blended, counted, engagement, global_fit, per_user_fit, run_engagement, weighted
from marginalia.operators.dedup import latest
from marginalia.operators.pairing import anchor_pairs, overlap_scorer, score_pairs, split_claims
from marginalia.operators.records import returning_ids
from marginalia.operators.rollups import book_level, profile_level
from marginalia.operators.tables_dml import cascade, insert_absent, update, upsert
from marginalia.plans.gates_queries import result_errors
from marginalia.plans.ranking_queries import edges, number
from marginalia.plans.relational_queries import some
from marginalia.plans.serving_queries import display_name
from marginalia.plans.text_queries import outcomes
from marginalia.session import scratch
from marginalia.sources.sinks import VersionedTable
from marginalia.tables import table

#: Books that a reader's shelf holds at most; shortest message.
SHELF, LEAST_MESSAGE = 2, 1


class Engine:
    """One project's tables. `splitter` and `scorer` stand for models; the defaults are deterministic."""

    KEYS = {"interpretations": "interpretation_id", "users": "user_id", "whisper_messages": "message_id", "comparisons": "comparison_id"}

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str | None = None, splitter: Callable[[Column], Column] | None = None, scorer: Callable[[DataFrame], DataFrame] = overlap_scorer):
        self.spark, self.sf_dir, self.splitter, self.scorer = spark, sf_dir, splitter, scorer
        self.folder = folder or f"{scratch(spark)}/engine-{uuid.uuid4().hex}"
        self.last: dict[str, object] = {"status": "idle"}

    # tables -------------------------------------------------------------------
    def _versions(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table as it is now, every record once."""
        t = self._versions(name)
        df = t.read() if t.current() else table(self.spark, self.sf_dir, name)
        return latest(df, [self.KEYS[name]], "ingested_at") if name in self.KEYS else df

    def write(self, name: str, df: DataFrame) -> None:
        self._versions(name).write(df)

    def _name(self, df: DataFrame, key: str, out: str) -> DataFrame:
        u = self.read("users").select(F.col("user_id").alias(key), display_name().alias(out))
        return df.join(u, key, "left").withColumn(out, F.coalesce(out, F.lit("Unknown")))

    # daily run ----------------------------------------------------------------
    def run_day(self, day: str) -> DataFrame:
        """(interpretation_id, outcome, quality_score) of the live texts of a day, gated; the accepted ones are queued for matching, and the status tells the counts."""
        at = F.col("created_at")
        live = self.read("interpretations").filter(~F.col("is_deleted") & (F.trim("interpretation") != "") & (at >= F.lit(day).cast("timestamp")) & (at < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp")))
        out = outcomes(live.withColumnRenamed("interpretation", "text")).select("interpretation_id", "book_id", "passage_id", "user_id", "outcome", "quality_score")
        self.write(f"runs/{day}", out)
        done = self._versions(f"runs/{day}").read()
        counts = {r.outcome: r["count"] for r in done.groupBy("outcome").count().collect()}
        self.last = {"status": "ok", "day": day, "total": sum(counts.values()), "accepted": counts.get("accepted", 0), "rejected": {k: n for k, n in counts.items() if k != "accepted"}}
        return done.select("interpretation_id", "outcome", "quality_score")

    def status(self) -> dict[str, object]:
        return dict(self.last)

    def health(self) -> dict[str, object]:
        return {"status": "ok", "functions": ["decompose", "score", "match_batch", "health"], "default_splitter": self.splitter is None, "default_scorer": self.scorer is overlap_scorer}

    # models -------------------------------------------------------------------
    def decompose(self, texts: DataFrame, text_col: str = "interpretation") -> DataFrame:
        """`texts` with their weighted claims."""
        return split_claims(texts, text_col, self.splitter)

    def score(self, runs: DataFrame) -> DataFrame:
        """Scores of given pairs of readers, with what is wrong with each result."""
        s = score_pairs(runs, self.read("interpretations").filter(~F.col("is_deleted")), self.splitter, self.scorer)
        return s.withColumn("errors", result_errors(s))

    def match_batch(self, user_id: str, book_id: str, passage_id: str) -> DataFrame:
        """A reader scored with every other reader of a passage, the surest first."""
        on = some(self.read("interpretations").filter(~F.col("is_deleted")), book_id=book_id, passage_id=passage_id)
        anchors = on.filter(F.col("user_id") == user_id).select("book_id", "passage_id", F.col("user_id").alias("anchor")).distinct()
        pairs = anchor_pairs(on, anchors).withColumn("run_id", F.md5(F.concat_ws("|", "user_a", "user_b", "book_id", "passage_id")))
        s = self.score(pairs).join(pairs, "run_id").withColumn("route", F.when(F.size("errors") > 0, "discard").otherwise("display"))
        return s.orderBy(F.desc("confidence"), "run_id")

    # votes and rankings -------------------------------------------------------
    def feedback(self, votes: DataFrame) -> DataFrame:
        """Votes appended (comparison_id, user_id, winner_run_id, loser_run_id, and what else the table has); the strengths of their users, fitted again. A vote already known changes nothing."""
        have = self.read("comparisons")
        votes = votes.select(*((F.col(c) if c in votes.columns else F.lit(None)).cast(have.schema[c].dataType).alias(c) for c in have.columns))
        self.write("comparisons", insert_absent(have, votes, ["comparison_id"]))
        return self._fits(votes.select("user_id").distinct())[0]

    def _votes(self) -> DataFrame:
        return self.read("comparisons").select("user_id", number("winner_run_id").alias("w"), number("loser_run_id").alias("l")).filter("w <> l")

    def _fits(self, users: DataFrame) -> tuple[DataFrame, DataFrame]:
        c = self.read("comparisons")
        sure = F.when(F.col("winner_confidence") > 1, F.col("winner_confidence") / 100).otherwise(F.col("winner_confidence"))
        own = engagement(c.select("user_id", number("winner_run_id").alias("run_id"), F.when(sure.between(0, 1), sure).alias("value"), F.col("logged_at").alias("at")).filter("run_id IS NOT NULL"))
        pairs = counted(self._votes())
        mine = per_user_fit(weighted(pairs.join(users, "user_id", "left_semi"), own, ["user_id"]))
        return mine, global_fit(weighted(pairs.groupBy("w", "l").agg(F.sum("n").alias("n")), run_engagement(own), []))

    def rankings(self, user_id: str, book_id: str | None = None, passage_id: str | None = None, k: int = 5) -> DataFrame:
        """A reader's best matches on each passage, after a refit. No rows: the reader has no runs."""
        user = self.spark.createDataFrame([(user_id,)], "user_id string")
        runs = some(self.read("compat_runs"), book_id=book_id, passage_id=passage_id).filter((F.col("user_a") == user_id) | (F.col("user_b") == user_id))
        mine, all_ = self._fits(user)
        counts = self._votes().filter(F.col("user_id") == user_id).groupBy("user_id").agg(F.count("*").alias("n_comparisons"))
        return blended(runs, mine.drop("n_comparisons"), all_, counts, k).filter(F.col("user_id") == user_id)

    # reading ------------------------------------------------------------------
    def matches(self, user_id: str, least: float = 0.0, limit: int = 50) -> DataFrame:
        """A reader's surest matches with names and titles."""
        e = edges(self.read("compat_runs").filter((F.col("user_a") == user_id) | (F.col("user_b") == user_id))).filter((F.col("user_id") == user_id) & (F.col("confidence") >= least))
        top = e.orderBy(F.desc("confidence"), "run_id").limit(limit)
        return self._name(top, "match_user", "match_name").join(self.read("books").select("book_id", "title"), "book_id", "left").select("run_id", "match_user", "match_name", "book_id", "title", "confidence").orderBy(F.desc("confidence"), "run_id")

    def profile(self, user_id: str) -> DataFrame:
        return self.read("users").filter(F.col("user_id") == user_id).limit(1).select("user_id", display_name().alias("name"), "readername", "bio")

    def compatibility(self, user_id: str, by_book: bool = True) -> DataFrame:
        """Roll-ups of a reader's runs by partner, and by book or over all, each ranked."""
        books = book_level(self.read("compat_runs").filter((F.col("user_a") == user_id) | (F.col("user_b") == user_id)))
        e = edges(books if by_book else profile_level(books)).filter(F.col("user_id") == user_id)
        slot = ["user_id", "book_id"] if by_book else ["user_id"]
        e = e.withColumn("place", F.row_number().over(W.partitionBy(*slot).orderBy(F.desc("confidence"), "match_user")))
        return self._name(e, "match_user", "match_name").orderBy("place")

    # texts --------------------------------------------------------------------
    def texts(self, user_id: str) -> DataFrame:
        """A reader's live texts, the latest first, with the books' titles."""
        n = self.read("interpretations").filter((F.col("user_id") == user_id) & ~F.col("is_deleted"))
        return n.join(self.read("books").select("book_id", "title"), "book_id", "left").orderBy(F.desc("created_at"), "interpretation_id")

    def create_text(self, user_id: str, book_id: str, passage: str, text: str, at: str) -> str:
        """The id of a new text; the same text again gives the same id and no second row."""
        have = self.read("interpretations")
        values = {"user_id": user_id, "book_id": book_id, "passage": passage, "interpretation": text, "created_at": at, "ingested_at": at, "is_deleted": False, "word_count": len(text.split())}
        new = self.spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in have.schema.fields))
        rows, ids = returning_ids(have, new, "interpretation_id", ["user_id", "book_id", "passage", "interpretation"])
        out = ids.first()["interpretation_id"]
        self.write("interpretations", rows)
        return out

    def edit_text(self, user_id: str, interpretation_id: str, text: str, at: str) -> None:
        """A reader's own live text changed; any other stays."""
        own = (F.col("interpretation_id") == interpretation_id) & (F.col("user_id") == user_id) & ~F.col("is_deleted")
        self.write("interpretations", update(self.read("interpretations"), own, {"interpretation": F.lit(text), "interpretation_updated_at": F.lit(at).cast("timestamp"), "word_count": F.lit(len(text.split()))}))

    def delete_text(self, user_id: str, interpretation_id: str) -> None:
        """A reader's own text flagged as deleted."""
        self.write("interpretations", update(self.read("interpretations"), (F.col("interpretation_id") == interpretation_id) & (F.col("user_id") == user_id), {"is_deleted": F.lit(True)}))

    # whispers -----------------------------------------------------------------
    def threads(self, user_id: str) -> DataFrame:
        """(thread_id, n_messages, unread, last_at) of the threads that a reader is a member of, the latest first; what it sent itself isn't unread."""
        m = self.read("whisper_messages")
        mine = m.filter(F.col("sender_id") == user_id).select("thread_id").distinct()
        t = m.join(mine, "thread_id", "left_semi").groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("read_at").isNull() & (F.col("sender_id") != user_id)).alias("unread"), F.max("created_at").alias("last_at"))
        return t.orderBy(F.desc_nulls_last("last_at"), "thread_id")

    def messages(self, user_id: str, thread_id: str) -> DataFrame:
        """A thread's messages in order; none for a reader who isn't a member."""
        m = self.read("whisper_messages").filter(F.col("thread_id") == thread_id)
        member = m.filter(F.col("sender_id") == user_id).select("thread_id").distinct()
        return m.join(member, "thread_id", "left_semi").orderBy("created_at", "message_id")

    def send(self, user_id: str, thread_id: str, content: str, at: str) -> str:
        """The id of a new message; ValueError for one without content."""
        if len(content.strip()) < LEAST_MESSAGE:
            raise ValueError("a message needs content")
        have = self.read("whisper_messages")
        values = {"thread_id": thread_id, "sender_id": user_id, "msg_type": "whisper", "content": content, "created_at": at, "ingested_at": at}
        new = self.spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in have.schema.fields))
        rows, ids = returning_ids(have, new, "message_id", ["thread_id", "sender_id", "content", "created_at"])
        out = ids.first()["message_id"]
        self.write("whisper_messages", rows)
        return out

    def mark_read(self, user_id: str, thread_id: str, at: str) -> None:
        unread = (F.col("thread_id") == thread_id) & (F.col("sender_id") != user_id) & F.col("read_at").isNull()
        self.write("whisper_messages", update(self.read("whisper_messages"), unread, {"read_at": F.lit(at).cast("timestamp")}))

    def close_readers(self, user_id: str, limit: int = 6) -> DataFrame:
        """The partners whose six shares and confidence make the surest profile."""
        return self.compatibility(user_id, by_book=False).orderBy(F.desc("confidence"), "match_user").limit(limit)

    # users --------------------------------------------------------------------
    def name_is_free(self, readername: str) -> bool:
        return self.read("users").filter(F.lower("readername") == readername.lower()).limit(1).count() == 0

    def put_user(self, values: Mapping[str, object]) -> None:
        """A user inserted, or those of its columns given changed."""
        have = self.read("users")
        old = have.filter(F.col("user_id") == values["user_id"]).limit(1)
        given = lambda f: F.lit(values[f.name]).cast(f.dataType) if f.name in values else F.col(f"old.{f.name}")
        row = self.spark.range(1).select(F.lit(1).alias("one")).join(old.withColumn("one", F.lit(1)).alias("old"), "one", "left").select(*(given(f).alias(f.name) for f in have.schema.fields))
        self.write("users", upsert(have, row, ["user_id"]))

    def update_state(self, user_id: str, patch: Mapping[str, str]) -> None:
        """A patch merged into a reader's state; its values win."""
        values = F.create_map(*(F.lit(x) for kv in patch.items() for x in kv)) if patch else F.lit(None).cast("map<string,string>")
        state = F.to_json(merged(F.from_json("reading_state", "map<string,string>"), values))
        self.write("users", update(self.read("users"), F.col("user_id") == user_id, {"reading_state": state}))

    def add_to_shelf(self, user_id: str, book_id: str) -> bool:
        """Whether the book is on the reader's shelf now; a full one takes no more."""
        t = self._versions("shelves")
        have = t.read("user_id string, book_id string")
        mine = {r.book_id for r in have.filter(F.col("user_id") == user_id).limit(SHELF + 1).collect()}
        if book_id in mine or len(mine) >= SHELF:
            return book_id in mine
        t.write(have.unionByName(self.spark.createDataFrame([(user_id, book_id)], have.schema)))
        return True

    def erase(self, user_id: str) -> None:
        """A user and all that refers to it, gone from every table."""
        refs = {"users": ["user_id"], "interpretations": ["user_id"], "whisper_messages": ["sender_id"], "compat_runs": ["user_a", "user_b"], "comparisons": ["user_id"]}
        doomed = self.spark.createDataFrame([(user_id,)], "user_id string")
        for name, df in cascade({n: self.read(n) for n in refs}, doomed, refs, "user_id").items():
            self.write(name, df)
