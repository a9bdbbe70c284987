"""Operators against brute force, invariants and round trips."""

from __future__ import annotations

import io
import itertools
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.rounding import half_even, largest_of, to_hundred
from marginalia.functions.stats import f_tail, incomplete_beta
from marginalia.operators.anomalies import nearest_rank_bounds, similar_texts
from marginalia.operators.bradley_terry import PRIOR, blend_weights, counted, fit, fit_each, global_fit, per_user_fit, spread_fit, weighted
from marginalia.operators.dedup import latest
from marginalia.operators.order import median, order_statistics, placed
from marginalia.operators.profiling import distribution, flattened, null_shares, schema_violations
from marginalia.operators.search import nearest
from marginalia.operators.tables_dml import cascade, insert_absent, update, upsert
from marginalia.plans.catalog import queries
from marginalia.sources.readers import epub_pages, pdf_text, read_any, read_books, read_csv, read_json
from marginalia.sources.sinks import VersionedTable, write_any


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rounding_and_ties(spark):
    rows = spark.createDataFrame([(2.5, 0), (0.5, 0), (2.675, 2), (-1.5, 0)], "v double, d int")
    assert [r[0] for r in rows.select(half_even(F.col("v"))).collect()] == [2.0, 0.0, 3.0, -2.0]
    cases = [(33.4, 33.3, 33.3), (50.0, 50.0, 0.0), (33.5, 33.5, 33.0), (0.0, 0.0, 100.0)]
    df = spark.createDataFrame(cases, "a double, b double, c double")
    t = to_hundred(*map(F.col, "abc"))
    out = df.select(*t, largest_of(*map(F.col, "abc"))).collect()
    assert all(sum(r[:3]) == 100 for r in out)
    assert [r[3] for r in out] == ["resonate", "resonate", "resonate", "diverge"]


def test_text_functions(spark):
    one = lambda f, s: value(spark, f(F.lit(s)))
    assert one(X.slug, "Emma O'Chen-Smith!") == "emma_ochensmith" and one(X.slug, "") == "unknown"
    assert one(X.short_md5, "Emma Chen") == "fd5e3def"
    assert one(X.word_count, "") == 0 and one(X.word_count, " a  b\n") == 2
    assert one(X.repaired, "cafÃ©") == "café" and one(X.repaired, "café") == "café" and one(X.repaired, "Ω") == "Ω"
    assert one(X.cleaned, "“Hi”…\t\tmail a@b.example\n\n\n\nx ") == '"Hi"... mail [EMAIL REMOVED]\n\nx'
    assert one(X.sentences, "One. Two!\nno") == ["One.", "Two!"] and one(X.sentences, "a") == ["a"]
    assert one(X.natural_name, "Last, First") == "First Last"
    assert one(X.trailing_number, "passage_3") == 3 and one(X.trailing_number, "x") == 0
    assert one(X.has_phone, "(555) 123-4567") is True and one(X.has_phone, "12 34") is False
    assert 0 <= one(X.reading_ease, "The cat sat on the mat.") <= 100
    assert one(X.reading_ease, "Incomprehensible institutional characterization.") < one(X.reading_ease, "The cat sat on the mat.")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=0, max_size=3))
def test_injection_pattern_compiles(words):
    import re

    assert re.compile(X.INJECTION_PATTERN.replace("(?im)", ""), re.I | re.M)


def cosines(texts: dict, stop: set, features: int) -> dict:
    """Brute force: cosine of every two texts' term weights."""
    from collections import Counter

    docs = {}
    for i, t in texts.items():
        w = [x for x in re.findall(r"\w{2,}", t.lower()) if x not in stop]
        docs[i] = Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
    df, cf = Counter(x for d in docs.values() for x in d), sum(docs.values(), Counter())
    kept = sorted((x for x in df if df[x] >= 2), key=lambda x: (-cf[x], x))[:features]
    idf = {x: np.log((1 + len(docs)) / (1 + df[x])) + 1 for x in kept}
    v = {i: {x: n * idf[x] for x, n in d.items() if x in idf} for i, d in docs.items()}
    v = {i: {x: y / np.sqrt(sum(z * z for z in d.values())) for x, y in d.items()} for i, d in v.items()}
    return {(a, b): sum(y * v[b].get(x, 0.0) for x, y in v[a].items()) for a, b in itertools.combinations(v, 2)}


@pytest.mark.parametrize("crowd", [2000, 3])
def test_similar_texts_against_all_pairs(spark, crowd):
    rng = random.Random(5)
    words = [a + b for a in "abcdefg" for b in "xyz"]
    rows = []
    for _ in range(40):
        w = rng.choices(words, k=rng.randint(1, 40))
        rows.append(" ".join(w))
        for _ in range(2):
            x = list(w)
            x[rng.randrange(len(x))] = rng.choice(words)
            rows.append(" ".join(x))
    rows += rows[:10] + ["", " ", "??", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in similar_texts(df, "doc_id", "text", ["ax", "by"], features=60, crowd=crowd).collect()}
    first = {}
    for i, t in enumerate(rows):
        if t is not None:
            first.setdefault(t, i)
    links = {i: set() for i in first.values()}
    for (a, b), x in cosines({i: t for t, i in first.items()}, {"ax", "by"}, 60).items():
        if x >= 0.85 - 1e-9:
            links[a].add(b)
            links[b].add(a)
    assert set(got) == {i for i, t in enumerate(rows) if t is not None} and sum(map(len, links.values())) > 20
    for i, r in got.items():
        c = first[rows[i]]
        others = links[c] | {k for k, t in enumerate(rows) if t == rows[i] and k != i}
        assert (r.class_id, r.n_links, r.first_match) == (c, len(links[c]), min(others, default=None))


def test_similar_texts_shuffle_less_than_the_texts_weigh(spark):
    """Texts of few words have crowds in common; their vectors don't follow each of their terms through a shuffle."""
    rng = random.Random(8)
    words = [a + b + c for a in "abcdefgh" for b in "aeio" for c in "nrst"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(3000)]
    texts += [f"{t} end" for t in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    got = similar_texts(df, "doc_id", "text").collect()
    moved = shuffled() - before
    assert {r.doc_id: r.first_match for r in got if r.first_match is not None} == {i: i + 3000 for i in range(30)} | {i + 3000: i for i in range(30)}
    assert 0 < moved < 4 * sum(map(len, texts))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = nearest(df.filter("id % 20 = 0"), df, "id", "v", 7).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        want = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:7]
        assert [r["id"] for r in sorted((r for r in got if r.query_id == q), key=lambda r: -r.similarity)] == want


def test_bounds_of_order_statistics(spark):
    for vals in ([1, 2, 3, 4, 5, 100], [7], [0, 0], list(range(1, 30))):
        b = nearest_rank_bounds(spark.createDataFrame([(x,) for x in vals], "v int"), ["v"])["v"]
        s = sorted(x for x in vals if x > 0)
        assert b is None if not s else (b["q1"], b["q3"]) == (s[len(s) // 4], s[3 * len(s) // 4])


@pytest.mark.parametrize("held", [50_000, 4])
def test_places_and_order_statistics(spark, held):
    rng = random.Random(3)
    vals = [rng.choice([1.0, 2.0, 2.0, 2.0, rng.random(), rng.gauss(0, 50)]) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vals)], "k int, v double").repartition(7)
    s = sorted(v for v in vals if v is not None)
    ranks = [0, 1, 750, 1500, 2999, 3000, -1]
    assert order_statistics(df, F.col("v"), ranks, held) == [*(s[r] for r in ranks[:5]), None, None]
    assert median(df, F.col("v")) == (s[1499] + s[1500]) / 2 and median(df.limit(0), F.col("v")) is None
    got = [(r.place, r.k) for r in placed(df, F.desc_nulls_last("v"), "k").collect()]
    want = sorted(range(len(vals)), key=lambda k: (vals[k] is None, -(vals[k] or 0), k))
    assert sorted(got) == [(i + 1, k) for i, k in enumerate(want)]
    assert placed(df.limit(0), "k").count() == 0


def test_strengths(spark):
    items, s = fit(np.array([1, 1, 2, 3]), np.array([2, 3, 3, 1]), np.ones(4))
    assert s.sum() == pytest.approx(1) and s[0] > s[2]
    n = spark.createDataFrame([(0,), (5,), (50,), (500,)], "n int")
    assert [tuple(r) for r in n.select(*blend_weights(F.col("n"))).collect()] == [(0.9, 0.1), (0.84, 0.16), (0.3, 0.7), (0.3, 0.7)]


def test_fit_is_the_maximum_of_the_likelihood():
    """No strength can be moved either way without the likelihood getting less; separable votes stay finite."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, (2, 120))
    a, b = np.r_[a[a != b], [90] * 4], np.r_[b[a != b], [0, 1, 2, 3]]
    w = rng.random(len(a)) + 0.5
    items, s = fit(a, b, w)
    at = {i: k for k, i in enumerate(items)}

    def height(t):
        x = np.array([t[at[i]] for i in a]) - np.array([t[at[i]] for i in b])
        return -(w * np.log1p(np.exp(-x))).sum() + PRIOR * (t - 2 * np.log1p(np.exp(t))).sum()

    t = np.log(s)
    shift = max(np.linspace(-5, 15, 4001), key=lambda c: height(t + c))  # the sum of 1 hides the prior's scale
    top = height(t + shift)
    for k in range(len(t)):
        for d in (-1e-2, 1e-2):
            assert height(t + shift + d * (np.arange(len(t)) == k)) < top + 1e-8
    assert np.isfinite(t).all() and s[at[90]] == s.max()


def test_engagement_is_a_votes_weight(spark):
    v = spark.createDataFrame([("u", 1, 2), ("u", 1, 2), ("u", 2, 1), ("v", 1, 2)], "user_id string, w long, l long")
    e = spark.createDataFrame([("u", 1, 0.5)], "user_id string, run_id long, engagement double")
    got = {(r.user_id, r.w, r.l): (r.n, r.weight) for r in weighted(counted(v), e, ["user_id"]).collect()}
    assert got == {("u", 1, 2): (2, 3.0), ("u", 2, 1): (1, 1.0), ("v", 1, 2): (1, 1.0)}


def uneven_votes(spark):
    """Votes with an unbeaten item, one without a win, and items of a single vote; and the same as arrays."""
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 12, (150, 2)) if a != b] + [(90, k, 1.0) for k in range(6)] + [(k, 91, 1.0) for k in range(4)] + [(92, 3, 1.0), (5, 93, 1.0), (92, 94, 1.0)]
    return spark.createDataFrame(rows, "w long, l long, weight double"), tuple(np.array(x) for x in zip(*rows))


def test_global_strengths_are_those_of_the_fit(spark):
    df, votes = uneven_votes(spark)
    want = dict(zip(*fit(*votes)))
    for got in (global_fit(df), global_fit(df, gathered=0)):
        got = {r.run_id: r.bt_score for r in got.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(x, abs=1.1e-6) for k, x in want.items())
    with pytest.raises(ValueError):
        spread_fit(df, [], sent=2)


def test_users_of_any_size_get_the_same_strengths(spark):
    df, _ = uneven_votes(spark)
    own = df.drop("weight").withColumn("user_id", F.lit("u"))
    own = weighted(counted(own.unionByName(own.filter("w < 9").withColumn("user_id", F.lit("v")))), None, [])
    near, far = ({(r.user_id, r.run_id): r.bt_score for r in per_user_fit(own, gathered=g).collect()} for g in (10_000, 0))
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k], abs=1.1e-6) for k in near)


def test_fits_of_nearly_separable_votes_take_few_passes(monkeypatch):
    """Items far out, whose curvature all but vanishes, neither halve the steps of the others nor slow down the last ones."""
    rng = np.random.default_rng(7)
    s = rng.normal(0, 3, 1500)
    a, b = rng.integers(0, 1500, (2, 4000))
    a, b = a[a != b], b[a != b]
    up = rng.random(len(a)) < 1 / (1 + np.exp(s[b] - s[a]))
    passes, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *x: passes.append(1) or plain(*x))
    fit(np.where(up, a, b), np.where(up, b, a), np.ones(len(a)))
    assert len(passes) < 10_000


def test_fits_of_many_users_at_once_are_those_of_each():
    rng = np.random.default_rng(3)
    user, a, b = (rng.integers(0, n, 400) for n in (9, 15, 15))
    user, a, b = (x[a != b] for x in (user, a, b))
    g, items, s = fit_each(user, a, b, np.ones(len(a)))
    for u in range(9):
        own, want = fit(a[user == u], b[user == u], np.ones((user == u).sum()))
        assert (items[g == u] == own).all() and s[g == u] == pytest.approx(want, abs=1e-6)


def test_rankings_fit_users_once(spark):
    plan = queries()["wn03_rankings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsIn") == 1  # that of all votes


def test_statistics_functions():
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert f_tail(4.0, 2, 10) == pytest.approx(0.05301, abs=1e-4) and f_tail(None, 1, 1) is None


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 5)], "g string, v int")
    d = {r.value: r for r in distribution(df, "g").collect()}
    assert d["a"].pct == 50.0 and d["b"].pct == 25.0 and set(d) == {"a", "b"}
    assert {r.column: r.nulls for r in null_shares(df, ["g", "v"]).collect()} == {"g": 1, "v": 1}
    v = {(r.column, r.rule): r.violations for r in schema_violations(df, {"v": {"required": True, "max": 2}, "gone": {"required": True}, "g": {"allowed": ["a"]}}).collect()}
    assert v == {("v", "required"): 1, ("v", "max"): 1, ("gone", "required"): 4, ("g", "allowed"): 2}
    nested = spark.sql("SELECT named_struct('R', 1, 'x', named_struct('y', 'z')) AS t, array('p', 'q') AS l, map('k', 1) AS m")
    assert flattened(nested).first().asDict() == {"t_R": 1, "t_x_y": "z", "l": "p, q", "m": '{"k":1}'}


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    s = spark.createDataFrame([("2", "B"), ("3", "C")], "k string, v string").withColumn("k", F.col("k").cast("long"))
    assert sorted(upsert(t, s, ["k"]).collect(), key=str) == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "n")], key=str)
    assert insert_absent(t, s, ["k"]).count() == 4
    assert [r.v for r in update(t, F.col("k") > 1, {"v": F.lit("x")}).collect()] == ["a", "x", "n"]
    out = cascade({"c": spark.createDataFrame([(1,), (9,), (None,)], "u long")}, t.filter("k = 1"), {"c": ["u"]}, "k")
    assert sorted(out["c"].collect(), key=str) == sorted([(9,), (None,)], key=str)


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", None, "c"), (None, 1, "d")], "k string, o int, t string")
    assert sorted((r.k or "", r.t) for r in latest(df, ["k"], "o", ["t"]).collect()) == [("", "d"), ("k", "b")]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None), (3, "NA")], "id int, s string")
    for ext in ("csv", "json", "parquet", "orc"):
        write_any(df, f"{tmp_path}/x.{ext}")
        assert read_any(spark, f"{tmp_path}/x.{ext}").count() == 3
    assert {r.s for r in read_csv(spark, f"{tmp_path}/x.csv").collect()} == {'a "q", b', None}
    assert {r.s for r in read_csv(spark, f"{tmp_path}/x.csv", keep_empty=True).collect()} == {'a "q", b', "", "NA"}
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert read_json(spark, f"{tmp_path}/a.json").count() == 2
    with pytest.raises(ValueError):
        read_any(spark, f"{tmp_path}/x.xyz")


def test_books_of_other_formats(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        z.writestr("OPS/b.opf", '<package><manifest><item id="c1" href="c1.xhtml"/><item id="c2" href="c2.xhtml"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/></spine></package>')
        z.writestr("OPS/c1.xhtml", f"<html><body><h1>One &amp; all</h1><p>{'word ' * 20}</p><script>x</script></body></html>")
        z.writestr("OPS/c2.xhtml", "<html><body>short</body></html>")
    assert epub_pages(box.getvalue())[0][:2] == (1, "One & all") and len(epub_pages(box.getvalue())) == 1
    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(rb"BT (Hello \(there\)) Tj ET") + b"\nendstream"
    assert pdf_text(pdf) == "Hello (there)"
    (tmp_path / "b.epub").write_bytes(box.getvalue())
    (tmp_path / "c.pdf").write_bytes(pdf)
    (tmp_path / "bad.epub").write_bytes(b"PKbad")
    assert {r.text[:5] for r in read_books(spark, f"{tmp_path}/*").collect()} == {"One &", "Hello"}


def test_versions_survive_a_lost_write(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read("a int").count() == 0
    t.write(spark.range(3).selectExpr("cast(id as int) a"))
    before = t.current()
    with pytest.raises(Exception):
        t.write(spark.range(3).selectExpr("cast(raise_error('x') as int) a"))
    assert t.current() == before and t.read().count() == 3


def test_public_hash_and_display_names(spark):
    from marginalia.functions import display as D
    from marginalia.functions.farm import signed

    # values that the documentation of a public function gives
    assert [signed(t.encode()) for t in ("1footrue", "2applefalse", "3true")] == [-1541654101129638711, 2794438866806483259, -4880158226897771312]
    assert len({signed(b"ab" * k) for k in range(200)}) == 200
    one = lambda f, *s: value(spark, f(*map(F.lit, s)))
    assert one(D.safe_name, "scheduled__2026-03-30T00:00:00+00:00") == "staging_scheduled__2026_03_30_00_00_00_00_00"
    assert [one(D.task_name, x) for x in ("[Load] x", "Checking the Schema", "hello", "bias in statistics")] == ["Load", "Schema Stats", "General", "Bias Detection"]
    got = spark.createDataFrame([(60, 30, 10), (34, 33, 33), (45, 40, 15), (0, 0, 0)], "r int, c int, d int").select(*D.band(*map(F.col, "rcd"))).collect()
    assert [tuple(r) for r in got] == [("strong", "R"), ("split", "R"), ("moderate", "R"), (None, None)]


def test_given_scores(spark):
    """What the described scorer's answers give: all left over is divergence; no weight, no row; both forms of lists."""
    from marginalia.operators.pairing import aggregate_scores, scoring_of

    claims = "array<struct<id:string,weight:double>>"
    rows = [
        (1, [("1", 1.0)], [("1", 1.0)], 50, 50, '{"matched_pairs":[],"unmatched_a":["1"],"unmatched_b":["1"]}'),
        (2, [("1", 0.6), ("2", 0.4)], [("1", 0.55), ("2", 0.45)], 38, 31, '{"matched_pairs":[{"a_id":"1","b_id":"1","weight_a":0.6,"weight_b":0.55,"think_q":[true,true,false,false,true],"feel_q":[true,true,true,true,true]}],"unmatched_a":[{"id":"2","divergence":true}],"unmatched_b":["2"]}'),
        (3, [], [], 0, 0, '{"matched_pairs":[],"unmatched_a":[],"unmatched_b":[]}'),
        (4, [("1", 1.0)], [("1", 1.0)], 1, 1, "no json"),
    ]
    df = spark.createDataFrame(rows, f"run_id int, claims_a {claims}, claims_b {claims}, wc_a int, wc_b int, answers string")
    m, a, b = scoring_of(F.col("answers"))
    got = {r.run_id: r for r in aggregate_scores(df.withColumns({"matched": m, "unmatched_a": a, "unmatched_b": b}), ["run_id"]).collect()}
    assert set(got) == {1, 2} and (got[1].think_d, got[1].feel_d, got[1].dominant_think, got[1].match_count) == (100, 100, "diverge", 0)
    r = got[2]
    total = 0.55 + 0.4 + 0.3 * 0.45
    assert (r.think_r, r.feel_r, r.feel_c, r.match_count) == (round(0.55 * 0.8 / total * 100), round(0.55 / total * 100), 0, 1)
    assert r.confidence == round(0.3 * 31 / 38 + 0.4 * 0.5 + 0.3 * (max(r.think_r, r.think_c, r.think_d) + max(r.feel_r, r.feel_c, r.feel_d)) / 200, 2)


def test_records(spark):
    from marginalia.operators.records import Functions, Pusher, retried, schema_anomalies, schema_rows, timed

    clock = iter([0.0, 10.0, 29.9, 30.0, 31.0]).__next__
    sent = []
    p = Pusher(sent.append, 30, clock)
    assert [p(k) for k in range(5)] == [True, False, False, True, False] and sent == [0, 3]
    waits, left = [], iter([OSError("503"), OSError("503"), None])

    def call():
        if (e := next(left)) is not None:
            raise e
        return "ok"

    assert retried(call, sleep=waits.append) == ("ok", 3, None) and waits == [1.0, 2.0]

    def broken():
        raise OSError("404")

    assert retried(broken)[1:] == (1, "404")
    seen = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    other = spark.createDataFrame([("z", None, 1.0), ("a", 3, 2.0)], "k string, v int, w double")
    assert {tuple(r) for r in schema_anomalies(other, schema_rows(seen)).collect()} == {("w", "new", None), ("k", "value", 1), ("v", "missing", 1)}
    t = timed(spark, {"a": lambda: 1, "b": broken}, 1, iter([0.0, 5.0, 5.0, 5.5]).__next__).collect()
    assert [(r.step, r.slow, r.error is None) for r in t] == [("a", True, True), ("b", False, False)]
    f = Functions(spark)
    f.add("marginalia_twice", "a INT", "INT", "a * 2")
    assert spark.range(2).selectExpr("CAST(id AS INT) AS a").select(f.call("marginalia_twice", "a")).collect()[1][0] == 2 and f.calls().count() == 1
    with pytest.raises(KeyError):
        f.call("gone")


def test_text_pages_keep_every_chapter(spark):
    from marginalia.operators.books import text_pages

    para = "A paragraph that is surely longer than sixty characters, so that it is kept."
    body = "".join(f"\nCHAPTER {k} of it\n\n" + "\n\n".join([para] * (25 if k == 2 else 1)) for k in range(1, 101))
    rows = [(1, f"junk *** START OF THE PROJECT GUTENBERG EBOOK X ***{body}*** END OF THE PROJECT GUTENBERG EBOOK X *** more"), (2, para), (3, "short"), (4, None), (5, " ")]
    got = text_pages(spark.createDataFrame(rows, "id int, t string"), "id", "t", F.lit("Whole")).orderBy("id", "chapter", "part").collect()
    one = [r for r in got if r.id == 1]
    assert len(one) == 101 and [(r.label, len(r.paragraphs)) for r in one[:3]] == [("CHAPTER 1 of it", 1), ("CHAPTER 2 of it (1/2)", 20), ("CHAPTER 2 of it (2/2)", 5)]
    assert [(r.id, r.label) for r in got if r.id != 1] == [(2, "Whole")]
