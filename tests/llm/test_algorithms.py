"""Groups, co-occurrence, top N and list mapping against brute force and on their edge cases."""

import itertools
import math
import random

import numpy as np
import pytest

from lantern.llm.canonical import Dictionary, best_match, distance, map_to_list
from lantern.llm.components import connected_components
from lantern.llm import cooccur
from lantern.llm.cooccur import chances, fit_configuration, log10_tail, pair_counts, surprising_pairs
from lantern.llm.topn import top_n


def brute_groups(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {v: root(v) for v in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "circle"])
def test_components_against_union_find(spark, kind):
    rnd = random.Random(5)
    if kind == "random":
        pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)]
    elif kind == "chain":
        ids = list(range(60))
        rnd.shuffle(ids)
        pairs = list(zip(ids, ids[1:]))
    elif kind == "star":
        pairs = [(500, i) for i in range(400)] + [(i, 900 + i) for i in range(3)]
    else:
        pairs = [(i, (i * 7 + 3) % 101) for i in range(101)]
    pairs += pairs[:5] + [(b, a) for a, b in pairs[:5]] + [(7, 7), (None, 3), (4, None)]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "post_id int, related_post_id int, vertex string")
    got = {r.vertex: r.group_id for r in connected_components(df, "post_id", "related_post_id").collect()}
    assert got == brute_groups(pairs)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "a int, b int")
    out = connected_components(df, "a", "b")
    assert out.dtypes == [("vertex", "int"), ("group_id", "int")] and out.count() == 0


def test_pair_counts_against_brute_force_with_large_baskets(spark):
    rnd = random.Random(1)
    baskets = {b: {f"i{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 9))} for b in range(60)}
    baskets[99] = {f"i{n}" for n in range(700)}
    rows = [(b, i, 1) for b, s in baskets.items() for i in s] * 2 + [(None, "i1", 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "basket int, item string, n int")
    want = {}
    for s in baskets.values():
        for a, b in itertools.combinations(sorted(s), 2):
            want[a, b] = want.get((a, b), 0) + 1
    got = {(r.item_a, r.item_b): r.n_ab for r in pair_counts(df, "basket", "item").collect()}
    assert got == want
    often = {(r.item_a, r.item_b): r.n_ab for r in pair_counts(df, "basket", "item", 3).collect()}
    assert often == {k: v for k, v in want.items() if v >= 3}


def test_configuration_keeps_both_margins():
    freq, fm = np.array([2.0, 5.0, 9.0]), np.array([6.0, 4.0, 2.0])
    size = np.array([1.0, 2.0, 4.0])
    sm = np.array([10.0, 10.0, 5.0])
    freq = freq * (size * sm).sum() / (freq * fm).sum()
    p = chances(*fit_configuration(freq, fm, size, sm))
    assert np.allclose((p * sm).sum(1), freq, rtol=1e-6)
    assert np.allclose((p * fm[:, None]).sum(0), size, rtol=1e-6)


def test_tail_against_exact_sum():
    many = np.array([40.0, 25.0, 10.0])
    for p in ([0.01, 0.05, 0.2], [0.3, 0.1, 0.6], [0.001, 0.002, 0.004]):
        pmf = np.array([1.0])
        for k, n in zip(p, many):
            for _ in range(int(n)):
                pmf = np.convolve(pmf, [1 - k, k])
        for n in (1, 2, 4, 8, 15, 30):
            exact = math.log10(max(pmf[n:].sum(), 1e-300))
            got = log10_tail(np.array([n]), np.array([p]), many)[0]
            if exact > -60:
                assert abs(got - exact) < 0.03 + 0.02 * abs(exact), (p, n, got, exact)


def test_tail_against_exact_sum_on_random_margins(monkeypatch):
    rnd = np.random.default_rng(8)
    for _ in range(30):
        size, sm = np.sort(rnd.choice(np.arange(1, 9), 4, replace=False)).astype(float), rnd.integers(3, 40, 4).astype(float)
        freq = np.sort(rnd.choice(np.arange(1, 30), 6, replace=False)).astype(float)
        fm = np.maximum(np.round((size * sm).sum() / freq.sum() * np.ones(6)), 1)
        freq = freq * (size * sm).sum() / (freq * fm).sum()
        whole = fit_configuration(freq, fm, size, sm, 300)
        with monkeypatch.context() as m:
            m.setattr(cooccur, "CELLS", 5)
            parts = fit_configuration(freq, fm, size, sm, 300)
        assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
        p = (chances(whole[0][-2:-1], whole[1]) * chances(whole[0][-1:], whole[1]))[0]
        pmf = np.array([1.0])
        for k, n in zip(p, sm):
            for _ in range(int(n)):
                pmf = np.convolve(pmf, [1 - k, k])
        for n in range(1, int(sm.sum()), 3):
            exact = math.log10(max(pmf[n:].sum(), 1e-300))
            if exact > -12:
                assert abs(log10_tail(np.array([n]), p[None, :], sm)[0] - exact) < 0.05, (n, exact)


def test_ranks_count_pairs_below_the_least_count(spark):
    rows = [(b, i) for b in range(200) for i in (f"a{b % 7}", f"b{b % 11}")] + [(300 + b, i) for b in range(5) for i in ("x", "y")] + [(400 + 2 * k + b, i) for k in range(20) for b in (0, 1) for i in (f"r{k}", f"s{k}")]
    df = spark.createDataFrame(rows, "basket int, item string")
    every = surprising_pairs(df, "basket", "item", 1).collect()
    tests = len({i for _, i in rows})
    tests = tests * (tests - 1) / 2
    tails = sorted(r.log10_p for r in every)
    for r in surprising_pairs(df, "basket", "item", 4).collect():
        exact = min(10**t * tests / (k + 1) for k, t in enumerate(tails) if t >= r.log10_p - 1e-9 and (k + 1 == len(tails) or tails[k + 1] > t))
        assert exact <= r.q_value * 1.0001 and r.q_value <= max(1.05 * exact, 1e-12) or r.q_value == 1.0 <= exact * 1.05
    assert {(r.item_a, r.item_b): r.q_value for r in every if r.n_ab >= 4} == {(r.item_a, r.item_b): r.q_value for r in surprising_pairs(df, "basket", "item", 4).collect()}


def test_planted_pair_is_the_surprising_one(spark):
    rnd = random.Random(2)
    rows = []
    for b in range(400):
        items = {f"t{rnd.randrange(60)}" for _ in range(3)} | ({"left", "right"} if b < 12 else set())
        rows += [(b, i) for i in items]
    df = spark.createDataFrame(rows, "basket int, item string")
    out = surprising_pairs(df, "basket", "item").orderBy("log10_p").collect()
    assert (out[0].item_a, out[0].item_b) == ("left", "right") and out[0].q_value < 1e-6
    assert all(r.n == 400 and abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9 for r in out)


def test_surprise_of_nothing(spark):
    assert surprising_pairs(spark.createDataFrame([], "basket int, item string"), "basket", "item").count() == 0


def test_top_n_ties_nulls_and_order(spark):
    rows = [(1, 10, 5), (1, 11, 5), (1, 9, 5), (1, 8, 7), (1, 7, None), (2, 1, None), (None, 3, 9), (3, None, 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "parent_id int, post_id int, score int, rank_no string")
    got = [tuple(r) for r in top_n(df, ["parent_id"], "score", "post_id", 3).orderBy("parent_id", "rank_no").collect()]
    assert got == [(1, 1, 8), (1, 2, 9), (1, 3, 10), (2, 1, 1)]
    assert top_n(df.limit(0), ["parent_id"], "score", "post_id", 3).count() == 0
    plan = top_n(df, ["parent_id"], "score", "post_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_distance_counts_swaps_and_letters_between_them():
    assert distance("abcd", "abdc", 2)[0] == 1
    assert distance("ca", "abc", 2)[0] == 2
    assert distance("kitten", "sitting", 3)[0] == 3
    assert distance("same", "same", 2) == (0, 0.0)
    assert distance("abcdef", "a", 2)[0] > 2


PLACES = [(1, "Saint Velbrun", "Osk", "Norland", "NO"), (2, "Kalmirost", None, "Norland", "NO"), (3, "Kalmirost", "Esk", "Sudland", "SU"), (4, "Wéltrok", None, "Sudland", "SU")]


@pytest.fixture(scope="module")
def dictionary():
    return Dictionary.of([r[:4] for r in PLACES], [("Norland", "NO"), ("Sudland", "SU")])


@pytest.mark.parametrize(
    "text, want",
    [
        ("Saint Velbrun, Norland", 1), ("st velbrun", 1), ("St. Velbrun (NO)", 1), ("SAINT-VELBRUN", 1), ("saint vlebrun", 1), ("Saint Velbrrunn, Norland", 1), ("12 Oak Row, Saint Velbrun, Norland", 1),
        ("Kalmirost, Sudland", 3), ("Kalmirost (NO)", 2), ("SU-Kalmirost", 3), ("Kalmirost, Esk", 3), ("weltrok", 4), ("Weltrok&nbsp;Sudland", 4), ("📍Wéltrok!!", 4), ("Norland", 0), ("Osk, Norland", 0),
        ("Wéltrok, Norland", 0), ("Brindavel, Norland", 0), ("everywhere", 0), ("x" * 5000, 0), ("?!", 0), ("wéltrok@kalmir.example", 0),
    ],
)
def test_places_meant(dictionary, text, want):
    assert best_match(dictionary, text, {2: 5, 3: 1})[3] == want


def test_namesakes_without_country_by_frequency(dictionary):
    assert best_match(dictionary, "Kalmirost", {2: 5, 3: 1})[3] == 2
    assert best_match(dictionary, "Kalmirost", {2: 1, 3: 5})[3] == 3


def test_mapping_in_one_block_and_in_many(spark):
    places = spark.createDataFrame([*PLACES, (None, "Nowhere", None, "Norland", "NO"), (9, None, None, None, None)], "place_id int, city string, region string, country string, country_code string")
    rows = [(1, "Kalmirost, Sudland"), (2, "weltrok"), (3, None), (4, "  "), (5, "nothing at all"), (6, "Kalmirost, Norland"), (7, "Kalmirost, Norland"), (8, "kalmirots"), (None, "weltrok")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "user_id int, location string, key string")
    want = {1: 3, 2: 4, 5: 0, 6: 2, 7: 2, 8: 2}
    for block in (100, 1):
        got = {r.user_id: r.place_id for r in map_to_list(df, "user_id", "location", places, block).collect()}
        assert got == want
    assert map_to_list(df.limit(0), "user_id", "location", places).count() == 0
    assert {r.place_id for r in map_to_list(df, "user_id", "location", places.limit(0)).collect()} == {0}


STRADDLING = [
    (2, "Springfield", None, "Norland", "NO"), (3, "New Springfield", None, "Norland", "NO"), (5, "Brontik", None, "Norland", "NO"), (9, "Brontik", None, "Sudland", "SU"), (11, "Ulm", None, "Sudland", "SU"), (12, "Pau", "Esk", "Norland", "NO"),
    (13, "Velmarik", None, "Norland", "NO"), (14, "Velmarid", "Esk", "Sudland", "SU"), (15, "Oslo", None, "Norland", "NO"), (16, "Oslov", None, "Sudland", "SU"), (17, "Io", None, "Sudland", "SU"),
]
ENTERED = [
    "New Springfield", "new springfeild", "Springfield, New Norland", "Brontik", "brontik!", "Brontik, Sudland", "Brontik (SU)", "Brontik, Sudland", "Ulm, Sudland", "ULM", "Ulma", "Pau", "Pau, Norland", "pau, Sudland", "Io", "velmariq", "Velmarid, Esk", "Velmarik, Sudland",
    "Oslo, Sudland", "oslo", "oslov, norland", "Brontic", "between Springfield and Ulm", "Esk", "nothing", "Norland",
]


@pytest.mark.parametrize("block", [1, 2, 7])
def test_mapping_does_not_depend_on_the_blocks(spark, block):
    places = spark.createDataFrame(STRADDLING, "place_id int, city string, region string, country string, country_code string")
    df = spark.createDataFrame(list(enumerate(ENTERED)), "user_id int, location string")
    whole = {r.user_id: r.place_id for r in map_to_list(df, "user_id", "location", places).collect()}
    assert {r.user_id: r.place_id for r in map_to_list(df, "user_id", "location", places, block).collect()} == whole
    said = dict(zip(ENTERED, (whole[n] for n in range(len(ENTERED)))))
    assert (said["New Springfield"], said["Brontik"], said["Ulm, Sudland"], said["ULM"], said["Ulma"], said["Pau"], said["pau, Sudland"], said["Io"], said["nothing"]) == (3, 9, 11, 11, 0, 12, 0, 17, 0)
