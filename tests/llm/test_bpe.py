"""Encoding, splitting and packing against other libraries, brute force and round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("marginalia.llm")
from marginalia.llm import bpe, packing, pieces  # noqa: E402

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_same_ids_as_the_library_and_round_trip(text):
    b = bpe.load()
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json") if not hasattr(test_same_ids_as_the_library_and_round_trip, "t") else test_same_ids_as_the_library_and_round_trip.t
    t.encode_special_tokens = True
    test_same_ids_as_the_library_and_round_trip.t = t
    ids = b.encode(text)
    assert ids == t.encode(text, add_special_tokens=False).ids
    assert b.decode(ids).decode() == text


def test_long_words_special_strings_and_nothing(other):
    b = bpe.load()
    for s in ("a" * 4000, "ab" * 2500 + "zq" * 900, "<|endoftext|>", "é" * 99, "  \n\n x", "\x00\x01"):
        assert b.encode(s) == other.encode(s, add_special_tokens=False).ids
    assert b.encode("") == b.encode(None) == []


def test_segment_tree_is_a_leftmost_minimum():
    rng = random.Random(1)
    keys = [rng.randrange(50) * 64 + i for i in range(40)]
    tree = bpe.SegmentTree(list(keys))
    for _ in range(200):
        i = rng.randrange(40)
        keys[i] = rng.randrange(50) * 64 + i
        tree.put(i, keys[i])
        assert tree.nodes[1] == min(keys)


def test_sparse_table_against_brute_force():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 5, 200)
    late, early = pieces.SparseTable(v), pieces.SparseTable(v, latest=False)
    for _ in range(300):
        lo, hi = sorted(map(int, rng.integers(0, 200, 2)))
        best = v[lo : hi + 1].max()
        at = lo + np.flatnonzero(v[lo : hi + 1] == best)
        assert late.best(lo, hi) == (at[-1], best) and early.best(lo, hi) == (at[0], best)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_cover_the_text_within_the_limit(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 4000))
    strength = rng.choice([1, 1, 1, 2, 3, 4, 6], n).astype(np.int8)
    strength[-1] = 6
    cut = pieces.cut_points(strength, 200, 16, 0.5)
    assert cut[0][0] == 0 and cut[-1][1] == n
    for (a, z), (a2, z2) in zip(cut, cut[1:]):
        assert z - a <= 200 and z2 > z and 0 <= z - a2 <= 16
        assert strength[z - 1] == strength[a + 99 : a + 200].max()
    assert all(z - a <= 200 for a, z in cut)


def test_pieces_are_slices_of_the_text(spark):
    text = "One sentence here. Another, longer sentence follows it there!\n\nA new paragraph – é ü.\n" * 60
    df = spark.createDataFrame([(1, text, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (5, "é" * 900, "x")], "doc_id long, text string, piece string")
    rows = sorted(pieces.split_oversized(df, limit=128, overlap=8).collect())
    b = bpe.load()
    for doc in (1, 5):
        own = [r for r in rows if r.doc_id == doc]
        source = text if doc == 1 else "é" * 900
        assert [r.piece_no for r in own] == list(range(len(own))) and all(r.piece in source and r.n_tokens <= 128 for r in own)
        assert source.startswith(own[0].piece) and source.endswith(own[-1].piece)
    assert {r.doc_id for r in rows} == {1, 5} and len(b.encode(text)) > 128


def test_every_item_is_packed_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 30, 400, 700, 1100, 2047])) for i in range(700)] + [(1, 30)]
    items = spark.createDataFrame(rows, "doc_id long, size int").selectExpr("doc_id", "0 as part_no", "size")
    out = packing.pack(items, len(rows), 2048, ["doc_id", "part_no"], pool=300).collect()
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted(rows)
    loads: dict = {}
    for r in out:
        loads[(r.pool, r.bin)] = loads.get((r.pool, r.bin), 0) + r["size"]
    assert max(loads.values()) <= 2048
    assert len(loads) <= sum(s for _, s in rows) / 2048 * 1.1 + 4


def test_crossover_keeps_all_items():
    rng = random.Random(4)
    sizes = [rng.randint(1, 900) for _ in range(120)]
    a, b = packing.evolve(sizes, 2048, [], 1), packing.evolve(sizes, 2048, [], 2)
    child = packing.crossover(a, b, sizes, 2048, rng)
    assert sorted(i for x in child for i in x) == list(range(120)) and all(sum(sizes[i] for i in x) <= 2048 for x in child)


@pytest.mark.parametrize("kind", ["triplets", "thirds"])
def test_evolution_saves_containers_that_best_fit_misses(kind):
    """Sizes of which best fit makes too many bins: evolution gets at or next to the bound, and every item lies in one bin that holds it."""
    rng = random.Random(4)
    cap, sizes = 1000, []
    if kind == "triplets":  # threes that fill a bin exactly: the bound can be met
        for _ in range(40):
            a = rng.randint(380, 490)
            b = rng.randint((cap - a) * 45 // 100, (cap - a) // 2)
            sizes += [a, b, cap - a - b]
    else:
        sizes = [rng.randint(150, 440) for _ in range(300)]
    rng.shuffle(sizes)
    bound = -(-sum(sizes) // cap)
    plain: list[list[int]] = []
    packing.best_fit(plain, [], list(range(len(sizes))), sizes, cap)
    bins = packing.evolve(sizes, cap, [], 1)
    assert sorted(i for x in bins for i in x) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in x) <= cap for x in bins)
    assert len(plain) > bound and len(bins) < len(plain) and len(bins) <= bound + 1 + (kind == "triplets")


def test_exchange_keeps_every_item():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 60) for _ in range(40)]
        bins = [[0, 1], [2], [3, 4]]
        loads = [sum(sizes[i] for i in x) for x in bins]
        before = list(loads)
        cap = max(100, *loads)
        loose = packing.exchange(bins, loads, list(range(5, 40)), sizes, cap)
        assert sorted([i for x in bins for i in x] + loose) == list(range(40))
        assert loads == [sum(sizes[i] for i in x) for x in bins] and all(b <= x <= cap for b, x in zip(before, loads))
