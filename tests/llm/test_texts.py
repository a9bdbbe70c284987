"""Encoding repair, look-alikes, languages, prose, content and private data on small cases and held-out rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("marginalia.llm")
from marginalia.llm import garbled, lookalikes, quality, ranking  # noqa: E402
from marginalia.llm.abuse import CATEGORIES, AbuseModel, undisguise  # noqa: E402
from marginalia.llm.holdout import HOLDOUT  # noqa: E402
from marginalia.llm.languages import Labeller, LanguageModel, label_of, word_rows  # noqa: E402
from marginalia.llm.pii_seeds import Maker, plain_samples  # noqa: E402
from marginalia.llm.private import LABELS, Crf, Lists, Names, Redactor, joined, segments  # noqa: E402
from marginalia.llm.queries import _names  # noqa: E402
from marginalia.llm.trees import BoostedTrees  # noqa: E402

WORDS = ["über", "déjà", "façade", "café", "naïve", "Großmutter", "corazón", "não", "don", "isn", "only", "the"]


@pytest.fixture(scope="module")
def repairer():
    return garbled.Repairer(WORDS)


@pytest.mark.parametrize("read", garbled.UTF8_READ_AS)
def test_misread_texts_come_back(repairer, read):
    right = "La façade du café, déjà vue — “naïve”, isn’t it?"
    wrong = garbled.misread(right, "utf-8", read)
    assert repairer.repair(wrong)[0] == right and repairer.repair(wrong)[1] > 0


def test_only_the_garbled_stretch_changes(repairer):
    assert repairer.repair("Ein café und ein cafÃ© für Zoë")[0] == "Ein café und ein café für Zoë"
    for right in ("Søren’s œuvre", "CORAÇÃO, 1641", "The engraver’s mark Ã, a worn capital", "λόγος", "Душа", "It’s 12 € — “fine”", "„Du wirst“", "manhã de", None, "", "plain"):
        assert repairer.repair(right) == (right, 0)


@pytest.mark.parametrize("wrong", ["Un caf&#195;&#169; noir", "Un caf&#xC3;&#xA9; noir", "Un caf&Atilde;&copy; noir"])
def test_entities_of_garbled_letters(repairer, wrong):
    assert repairer.repair(wrong) == ("Un café noir", 1)


def test_ordinary_entities_stay(repairer):
    assert repairer.repair("Fish &amp; chips &#8212; ok") == ("Fish &amp; chips &#8212; ok", 0)


def test_lost_characters_are_found(repairer):
    assert repairer.repair("d�j� vu")[0] == "déjà vu"
    assert repairer.repair("cr�zq")[1] == 1


@pytest.mark.parametrize("text,kind", [("ｔｈｅ cat", "wide"), ("ﬁrst", "joined"), ("café", "accent"), ("a​b", "invisible"), ("a b", "space"), ("old‑fashioned", "hyphen"), ("chaptеr", "script")])
def test_kinds_and_one_form(text, kind):
    assert kind in lookalikes.kinds(text)
    assert lookalikes.kinds(lookalikes.readable(text)) == set()
    assert lookalikes.skeleton(text) == lookalikes.skeleton(lookalikes.readable(text))


@pytest.mark.parametrize("text", ["👩‍🚀", "❤️", "Душа", "λόγος", "Søren œuvre", "“x” — y’s", "", None, "plain"])
def test_no_case(text):
    assert lookalikes.kinds(text) == set() and lookalikes.readable(text) == text


@pytest.mark.parametrize("text,form", [("bоoк", "book"), ("bооkж", "bookж"), ("lioη", "lion"), ("naїve", "naïve"), ("hօuse", "house"), ("ᎪBC", "ABC")])
def test_any_look_alike_letter_is_a_case(text, form):
    assert lookalikes.differs(text) and lookalikes.kinds(text) == {"script"}
    assert lookalikes.readable(text) == form and lookalikes.kinds(form) == set()


def test_skeletons_of_equal_looking_texts():
    assert lookalikes.skeleton("ｃａｆé​") == lookalikes.skeleton("café") == lookalikes.skeleton("cаfé")
    assert lookalikes.skeleton("cafe") != lookalikes.skeleton("café")


@pytest.mark.parametrize("label,code", [("en-US", "en"), ("English", "en"), ("pt_BR", "pt"), ("deu", "de"), ("", None), (None, None), ("und", None), ("??", None)])
def test_labels(label, code):
    assert label_of(label) == code


def test_languages_held_out(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").orderBy("sample_id").collect()]
    model = LanguageModel([t for i, (_, t) in enumerate(rows) if i % 5], [k for i, (k, _) in enumerate(rows) if i % 5])
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    s = model.scores([t for _, t in held])
    assert np.mean([model.langs[k] == lang for k, (lang, _) in zip(s.argmax(1), held)]) > 0.97
    mixed = Labeller(model).stretches([held[0][1] + " " + next(t for k, t in held if k != held[0][0]), "", "\0"])
    assert len({x[2] for x in mixed[0]}) == 2 and mixed[1] == []
    assert len(word_rows([("en", "the"), ("en", "of")])) > 0


def test_prose_holdout_and_statistics():
    model = quality.ProseModel([t for _, t in plain_samples()] * 3, ["the", "of", "and", "in", "is", "der", "und", "la", "de", "que"])
    p = model.score([t for t, _ in HOLDOUT])[1]
    assert np.mean((p > 0.5) == np.array([k == "prose" for _, k in HOLDOUT])) >= 0.9
    x = quality.statistics(["One two. Three", None, "", "- a\n- b"], model.common)
    assert x[0][0] == 3 and x[1].sum() == 0 and x[2].sum() == 0 and x[3][8] == 1.0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = BoostedTrees().fit(x[:1500], y[:1500]).calibrate(x[:1500], y[:1500])
    assert np.mean((m.probability(x[1500:]) > 0.5) == y[1500:]) > 0.93


def test_content_held_out(spark):
    rows = [(r.text, r.category) for r in spark.read.parquet("/root/testdata/sf0.001/reviewed_texts.parquet").orderBy("review_id").collect()]
    model = AbuseModel([r for i, r in enumerate(rows) if i % 4], [t for _, t in plain_samples()])
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    got = [{CATEGORIES[k] for k in np.flatnonzero(p >= 0.5)} or {"none"} for p in model.score([t for t, _ in held])]
    assert np.mean([g == {c} for g, (_, c) in zip(got, held)]) > 0.95
    assert model.score([None, "", " "]).sum() == 0
    assert undisguise("id*ot") == "idiot" and undisguise("m0ron") == "moron" and undisguise("plain") == "plain"


def test_private_data_held_out():
    maker = Maker(77)
    rows = maker.rows(2)
    lists = Lists(maker.cast, [a for a, _ in maker.users], [b for _, b in maker.users])
    r = Redactor(lists)
    found = r.crf.decode([t for t, _ in rows])
    hits = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, rows))
    assert hits / sum(map(len, found)) > 0.95 and hits / sum(len(b) for _, b in rows) > 0.93
    text = "Call me on 617-555-0166 or write to ann.lee@mail.example, says Ishmael."
    assert r.redact(text, r.spans([text])[0]) == "Call me on [PHONE] or write to [EMAIL], says Ishmael."
    assert r.spans([None, "", " ", "I read page 12 in 1999."]) == [[], [], [], []]


@pytest.mark.parametrize("space", ["\u3000", "\u2009", "\u00a0", "\u202f", "\t", "\n"])
def test_private_data_between_odd_spaces(space):
    r = Redactor(Lists(["Corin Kestle"], ["Nadira", "Dagny"], ["Halloway"]))
    for text, name in (("It happened to my cousin Dagny Drutosley almost word for word. The sentence is stubborn.", "Dagny Drutosley"), ("Nadie había hablado de el orgullo en aquella casa. Mi vecina Nadira Halloway me prestó el libro.", "Nadira Halloway"), ("You can always reach me by phone on 617-555-0166 in the evening.", "617-555-0166")):
        odd = text.replace(" ", space)
        assert [odd[a:z] for a, z, _ in r.spans([odd])[0]] == [name.replace(" ", space)]


def test_viterbi_is_the_best_path():
    """The decoded spans are those of the best of all paths, tried one by one."""
    crf = Crf(Lists([], [], [])).fit(Maker(5).rows(1)[:60], epochs=1)
    for text in ("Call 555 1234567", "Ann Lee wrote", "a@b.example", "12 Mill Row"):
        at = crf.tokens(text)[:3]
        text = text[: at[-1][1]]
        e, t, start = crf.emissions(text, at), crf.t[:-1], crf.t[-1]
        best = max(np.ndindex(*[e.shape[1]] * len(at)), key=lambda p: start[p[0]] + sum(e[i, k] for i, k in enumerate(p)) + sum(t[p[i - 1], p[i]] for i in range(1, len(p))))
        want: list[tuple[int, int, str]] = []
        for k, (y, (x, z)) in enumerate(zip(best, at)):
            if y and LABELS[y][0] == "I" and want and want[-1][2] == LABELS[y][2:] and best[k - 1]:
                want[-1] = (want[-1][0], z, want[-1][2])
            elif y:
                want.append((x, z, LABELS[y][2:]))
        assert crf.decode([text])[0] == want


def names_table(n: int) -> list[str]:
    """n made-up surnames, none a real word."""
    parts = ["bra", "dol", "fen", "gri", "hal", "kes", "lor", "mur", "nav", "ost", "pel", "ruv", "sca", "tor", "vil", "wen", "yar", "zem", "qui", "eld"]
    return [(a + b + c + d).capitalize() for a in parts for b in parts for c in parts for d in parts][:n]


def test_names_beyond_any_list(spark):
    """Of 50,000 surnames of users each is known, whatever its place; and names that no user has are put to the field as well."""
    last = names_table(50_000)
    rows = spark.createDataFrame([("Dagny", x) for x in last] + [("Nadira", None)], "first_name string, last_name string")
    names = _names(rows, "last_name")
    assert len(names) == 50_000 and all(x.lower() in names for x in last[::997]) and "unknown" not in names
    assert "élan" in Names(np.array([r[0] for r in spark.sql("SELECT xxhash64('élan')").collect()]))
    r = Redactor(Lists(["Corin Kestle"], Names(np.array([], np.int64)), names))
    for x in (last[0], last[-1], "Drutosley"):
        text = f"It happened to my cousin Dagny {x} almost word for word."
        assert [text[a:z] for a, z, _ in r.spans([text])[0]] == [f"Dagny {x}"]
    assert r.candidate("my cousin dagny drutosley told me") and r.candidate("MY COUSIN DAGNY DRUTOSLEY TOLD ME") and not r.candidate("The sea was calm.")


def test_the_gate_loses_next_to_nothing():
    """Spans found with the gate before the field against decoding every sentence of held-out rows."""
    maker = Maker(123)
    rows = [t for t, _ in maker.rows(2)]
    r = Redactor(Lists(maker.cast, [a for a, _ in maker.users], [b for _, b in maker.users]))
    some = r.spans(rows)
    r.known.clear()
    r.candidate = lambda s: True
    every = r.spans(rows)
    total = sum(map(len, every))
    assert total > 300 and sum(len(set(b) - set(a)) for a, b in zip(some, every)) <= 0.005 * total


def test_no_window_cuts_an_entity():
    r = Redactor(Lists([], ["Nadira"], ["Halloway"]))
    for n in range(0, 600, 37):
        text = "word " * (n // 5) + "my neighbour Nadira Halloway lives at 14 Mill Street and " + "more " * 200
        found = [text[a:z] for a, z, k in r.spans([text])[0] if k == "person_name"]
        assert found == ["Nadira Halloway"]
    assert joined([(0, 5, "a"), (3, 9, "a"), (9, 12, "b")]) == [(3, 9, "a"), (9, 12, "b")]
    big = "@" * 30_000 + " " + "1" * 30_000
    assert all(z - a <= 500 for a, z in segments(big)) and segments(big)[-1][1] == len(big)


def test_strengths_recover_the_truth(spark):
    rng = np.random.default_rng(3)
    true = np.exp(rng.normal(0, 1, 25))
    votes = []
    for _ in range(4000):
        i, j = rng.choice(25, 2, replace=False)
        votes.append((int(i), int(j)) if rng.random() < true[i] / (true[i] + true[j]) else (int(j), int(i)))
    items = spark.createDataFrame([(i,) for i in range(26)], "item long")
    out = {r["item"]: r.strength for r in ranking.strengths(spark.createDataFrame(votes, "winner long, loser long").withColumn("n", F.lit(1)), items).collect()}
    got = np.log([out[i] for i in range(25)])
    want = np.log(true) - np.log(true).mean()
    assert np.corrcoef(got, want)[0, 1] > 0.98 and np.abs(got - got.mean() - want).max() < 0.6
    assert out[25] == pytest.approx(1.0, rel=0.5)


def test_strengths_are_those_of_the_likelihood_at_any_size(spark):
    """The chain's fixed point against direct maximisation, with few and uneven votes, and the joined form against the sent one."""
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b), int(n)) for a, b, n in rng.integers(0, 9, (60, 3)) if a != b and n] + [(20, 1, 3), (2, 21, 2), (20, 22, 1)]
    votes = spark.createDataFrame(pairs, "winner long, loser long, n long")
    items = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p[:2]} | {30})], "item long")
    near, far = ({r["item"]: r.strength for r in ranking.strengths(votes, items, sent=s).collect()} for s in (100, 0))
    assert near.keys() == far.keys() and all(abs(np.log(near[k] / far[k])) < 5e-3 for k in near)
    names = sorted(near)
    t = np.zeros(len(names))
    for _ in range(20_000):  # fixed-point form of the same likelihood, with the same smoothing
        s = np.exp(t - t.mean())
        come, go = np.zeros(len(t)), np.zeros(len(t))
        for a, b, n in pairs:
            i, j = names.index(a), names.index(b)
            come[i] += n / (s[i] + s[j]) * s[j]
            go[j] += n / (s[i] + s[j])
        smooth = ranking.PRIOR / 2 / (s + 1)
        new = np.log((come + smooth) / (go + smooth))
        if np.abs(new - new.mean() - np.log(s)).max() < 1e-10:
            break
        t = 0.5 * new + 0.5 * t
    assert np.abs(np.log([near[k] for k in names]) - np.log(s)).max() < 0.03


def test_run_ids_written_unevenly(spark):
    rows = spark.createDataFrame([(x,) for x in ["12", " 12 ", "12.0", "012", "12.00", None, "x", "", "1.5"]], "t string")
    assert [r[0] for r in rows.select(ranking.run_id(rows.t)).collect()] == [12, 12, 12, 12, 12, None, None, None, None]
