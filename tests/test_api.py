"""The public functions on a small project: what each reads, writes and refuses."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.api import Engine

DIR = "/root/testdata/sf0.001"
AT = "2025-03-01 10:00:00"


@pytest.fixture
def engine(spark):
    return Engine(spark, DIR)


def test_daily_run_and_status(engine):
    n = engine.read("interpretations").filter("NOT is_deleted AND trim(interpretation) <> ''")
    day = n.groupBy(F.to_date("created_at").cast("string").alias("d")).count().orderBy(F.desc("count"), "d").first()
    assert engine.status() == {"status": "idle"}
    out = engine.run_day(day.d)
    assert out.count() == day["count"] == engine.status()["total"] and engine.status()["accepted"] == out.filter("outcome = 'accepted'").count()
    assert engine.run_day("1999-01-01").count() == 0 and engine.status()["total"] == 0
    assert engine.health()["default_scorer"]


def test_texts(engine):
    user = engine.read("interpretations").filter("NOT is_deleted").orderBy("user_id").first().user_id
    before = engine.texts(user).count()
    new = engine.create_text(user, "b", "a passage", "I think it is about the sea.", AT)
    assert engine.create_text(user, "b", "a passage", "I think it is about the sea.", AT) == new
    assert engine.texts(user).count() == before + 1
    engine.edit_text("somebody else", new, "no", AT)
    engine.edit_text(user, new, "About the river, then.", AT)
    row = engine.texts(user).filter(F.col("interpretation_id") == new).first()
    assert (row.interpretation, row.word_count, row.title) == ("About the river, then.", 4, None)
    engine.delete_text(user, new)
    assert engine.texts(user).count() == before


def test_matches_and_roll_ups(engine):
    runs = engine.read("compat_runs")
    user = runs.first().user_a
    own = runs.filter((F.col("user_a") == user) | (F.col("user_b") == user))
    got = engine.matches(user).collect()
    assert len(got) == min(50, own.count()) and [r.confidence for r in got] == sorted((r.confidence for r in got), reverse=True)
    assert engine.matches(user, limit=1).count() == 1 and engine.matches(user, least=2.0).count() == 0
    assert engine.compatibility(user).count() == own.select(F.least("user_a", "user_b"), F.greatest("user_a", "user_b"), "book_id").distinct().count()
    assert engine.compatibility(user, by_book=False).count() == engine.close_readers(user, 10_000).count()
    assert engine.profile(user).count() <= 1 and engine.profile("nobody").count() == 0


def test_votes_refit_the_rankings(engine, spark):
    run = engine.read("compat_runs").first()
    assert engine.rankings("nobody").count() == 0
    votes = spark.createDataFrame([(f"new{k}", run.user_a, str(run.run_id), str(run.run_id + 1 + k % 2), AT) for k in range(6)], "comparison_id string, user_id string, winner_run_id string, loser_run_id string, logged_at string")
    fit = {r.run_id: r.bt_score for r in engine.feedback(votes).collect() if r.user_id == run.user_a}
    assert fit[run.run_id] >= max(fit[run.run_id + 1], fit[run.run_id + 2])
    n = engine.read("comparisons").count()
    engine.feedback(votes)
    assert engine.read("comparisons").count() == n
    got = engine.rankings(run.user_a, run.book_id).collect()
    assert got and {r.user_id for r in got} == {run.user_a} and all(r.n_comparisons >= 6 for r in got)


def test_scoring_of_a_passage(engine, spark):
    rows = [("a", "The sea is calm. I like it."), ("b", "The sea is calm. I hate it!"), ("c", "A lamp."), ("d", " ")]
    for u, t in rows:
        engine.create_text(u, "b", "p", t, AT)
    n = engine.read("interpretations")
    engine.write("interpretations", n.withColumn("passage_id", F.when(F.col("passage") == "p", "p1").otherwise(F.col("passage_id"))))
    got = {r.user_b: r for r in engine.match_batch("a", "b", "p1").collect()}
    assert set(got) == {"b", "c"} and all(r.think_r + r.think_c + r.think_d == 100 and 0.2 <= r.confidence <= 0.95 and r.route == "display" for r in got.values())
    assert got["b"].think_r > got["c"].think_r and engine.match_batch("z", "b", "p1").count() == 0

    def none_match(pairs):
        left = lambda c: F.transform(c, lambda x: F.struct(x["id"].alias("id"), F.lit(True).alias("divergence")))
        return pairs.withColumns({"matched": F.array().cast("array<struct<weight_a:double,weight_b:double,think_r:double,think_c:double,feel_r:double,feel_c:double>>"), "unmatched_a": left("claims_a"), "unmatched_b": left("claims_b")})

    other = Engine(spark, DIR, engine.folder, scorer=none_match)
    assert {(r.think_d, r.feel_d, r.match_count) for r in other.match_batch("a", "b", "p1").collect()} == {(100, 100, 0)}
    assert other.decompose(n.filter("passage = 'p'")).filter("user_id = 'd'").first().subclaims == []


def test_whispers(engine):
    m = engine.read("whisper_messages").filter("sender_id IS NOT NULL").first()
    before = engine.messages(m.sender_id, m.thread_id).count()
    assert before >= 1 and engine.messages("nobody", m.thread_id).count() == 0
    new = engine.send("another", m.thread_id, "hello", AT)
    assert engine.messages(m.sender_id, m.thread_id).filter(F.col("message_id") == new).count() == 1
    unread = {r.thread_id: r.unread for r in engine.threads(m.sender_id).collect()}[m.thread_id]
    assert unread >= 1
    engine.mark_read(m.sender_id, m.thread_id, AT)
    assert {r.thread_id: r.unread for r in engine.threads(m.sender_id).collect()}[m.thread_id] == 0
    with pytest.raises(ValueError):
        engine.send("another", m.thread_id, "  ", AT)


def test_users(engine):
    u = engine.read("users").filter("readername IS NOT NULL AND reading_state IS NOT NULL").first()
    assert not engine.name_is_free(u.readername.upper()) and engine.name_is_free("no such reader")
    engine.put_user({"user_id": u.user_id, "bio": "new bio"})
    engine.put_user({"user_id": "fresh", "first_name": "Ada"})
    assert engine.profile(u.user_id).first().bio == "new bio" and engine.profile("fresh").first().name == "Ada"
    engine.update_state(u.user_id, {"page": "77", "theme": "dark"})
    state = engine.read("users").filter(F.col("user_id") == u.user_id).select(F.from_json("reading_state", "map<string,string>")).first()[0]
    assert state["page"] == "77" and state["theme"] == "dark" and "font" in state
    assert [engine.add_to_shelf(u.user_id, b) for b in ("x", "y", "z", "x")] == [True, True, False, True]
    engine.erase(u.user_id)
    assert engine.profile(u.user_id).count() == 0 and engine.texts(u.user_id).count() == 0 and engine.matches(u.user_id).count() == 0
