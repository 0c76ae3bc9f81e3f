"""Drawn pairs and matched couples against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.scalars import draw
from tessella.operators import pairs


def test_numbers_of_pairs(spark):
    wide = 3_000_000_000  # members of a group whose pairs pass 2**53
    numbers = [*range(3000), *(wide * (wide - 1) // 2 + k for k in (-1, 0, 1))]
    i, j = pairs.pair_at(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in numbers], "t long").select("t", i, j).orderBy("t").collect()]
    assert [g[1:] for g in got[:3000]] == [(a, b) for b in range(1, 90) for a in range(b)][:3000]
    assert [g[1:] for g in got[3000:]] == [(wide - 2, wide - 1), (0, wide), (1, wide)]


def test_samples_are_drawn_evenly_from_all_pairs_that_fit(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LISTED", 1)
    sizes = {1: 40, 2: 25, 3: 2, 4: 1}
    rows = [(g, 100 * g + k, float(k % 7), 0.0, k % 3) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "image int, fix_id int, x double, y double, trial int")
    fits = (F.col("d") > 1) & (F.col("trial_i") != F.col("trial_j"))
    fit = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and abs(a[2] - b[2]) > 1 and a[4] != b[4]}
    seen = Counter()
    for seed in range(12):
        got = [(r.fix_id_i, r.fix_id_j) for r in pairs.sample_pairs(df, 60, f"s{seed}", fits, keep=("trial",)).collect()]
        assert len(got) == len(set(got)) == 60 and set(got) <= fit
        seen.update(got)
    share = sum(c for (a, _), c in seen.items() if a < 200) / seen.total()
    assert abs(share - sum(a < 200 for a, _ in fit) / len(fit)) < 0.06
    assert max(seen.values()) <= 8


def test_samples_of_few_pairs_are_all_that_fit(spark):
    rows = [(1, k, float(k), 0.0) for k in range(6)]
    df = spark.createDataFrame(rows, "image int, fix_id int, x double, y double")
    got = pairs.sample_pairs(df, 1000, "s", F.col("d") > 2)
    assert {(r.fix_id_i, r.fix_id_j) for r in got.collect()} == {(a, b) for a in range(6) for b in range(a + 3, 6)}
    assert pairs.sample_pairs(df.where("false"), 10, "s", F.col("d") > 2).count() == 0


def test_couples_are_the_first_that_fit_in_draw_order(spark, monkeypatch):
    monkeypatch.setattr(pairs, "FIRST", 1)
    monkeypatch.setattr(pairs, "FURTHER", 2)
    rng = random.Random(2)
    at = {k: (rng.random() * 4, rng.random() * 4) for k in range(40)}
    near = {(a, b): float(np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])) for a in at for b in at if a != b}
    others = [(a, b, d) for (a, b), d in near.items() if d < 2.5]
    sources = [(a, b, d) for a, b, d in others if a < b and b < 12]
    known = {(a, b) for a, b, _ in sources} | {(b, a) for a, b, _ in sources}
    schema = "a int, b int, d double"
    got = pairs.matched_pairs(spark.createDataFrame(sources, schema), spark.createDataFrame(others, schema), (F.col("m0") + F.col("m1")) % 3 == 0, "s")
    got = {(r.a, r.b): (r.m0, r.m1) for r in got.collect()}
    said = {side: {(r.a, r.b, r.m): r.u for r in spark.createDataFrame([(a, b, m) for a, b, _ in sources for m in at], "a int, b int, m int").select("a", "b", "m", draw(f"s-{side}", F.col("a"), F.col("b"), F.col("m")).alias("u")).collect()} for side in "ab"}
    want = {}
    for a, b, d in sources:
        one, two = (sorted((said[s][a, b, m], m) for m in at if m != of and near[of, m] <= min(d, 2.5)) for s, of in (("a", a), ("b", b)))
        fit = [(max(i, j), i, j, x, y) for i, (_, x) in enumerate(one) for j, (_, y) in enumerate(two) if x != y and (x, y) not in known and (x + y) % 3 == 0]
        if fit:
            want[a, b] = min(fit)[3:]
    assert want and got == want


@pytest.mark.parametrize("crowd", [0, 3, 10**6])
def test_pairs_meet_across_tiles_crowded_or_not(spark, monkeypatch, crowd):
    monkeypatch.setattr(pairs, "CROWD", crowd)
    rng = np.random.default_rng(5)
    rows = [(k % 2, k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-40, 40, (300, 2)) / 2)]  # tiles of 8, many rows on their borders
    df = spark.createDataFrame(rows, "image int, fix_id int, x double, y double")
    want = [(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 1]
    assert sorted((r.image, r.fix_id_i, r.fix_id_j) for r in pairs.return_pairs(df, 1.0).collect()) == sorted(want)


def test_both_directions_share_one_search(spark):
    df = spark.createDataFrame([(1, k, float(k), 0.0, 10.0 * k, 0.0) for k in range(5)], "image int, fix_id int, x double, y double, ux double, uy double")
    both = pairs.symmetric(pairs.return_pairs(df, 1.0, keep=("ux", "uy")), keep=("ux", "uy"))
    assert sorted((r.a, r.b, r.ux_a, r.ux_b) for r in both.collect()) == sorted((a, b, 10.0 * a, 10.0 * b) for a in range(5) for b in range(5) if abs(a - b) == 1)
    assert {r.source for r in pairs.one_sided_match(both, 10.0, "s").collect()} == set(range(5)) and not pairs.one_sided_match(both, 11.0, "s").count()
