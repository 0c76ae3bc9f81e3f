"""Nested bootstraps, sign flips and permutation tests against brute force."""

import random
from collections import defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import draws
from tessella.operators import nested, permutation, resample

SCHEMA = "region string, subject string, unit long, t int, value double"


def nested_rows(seed):
    rng = random.Random(seed)
    rows, unit = [], 0
    for region, sizes in {"A": [30, 7, 1], "B": [4], "hot": [60, 3, 9, 2, 5]}.items():
        for i, n in enumerate(sizes):
            for _ in range(n):
                unit += 1
                rows += [(region, f"s{i}", unit, t, rng.choice([None, rng.gauss(1, 2), rng.gauss(1, 2)])) for t in (0, 1) if t == 0 or rng.random() < 0.8]
    return rows


def key(*parts):
    return [int(w) for w in draws.words(*parts)]


def cubic_one(words, k):
    return sum(w * k**i for i, w in enumerate(words)) % (2**31 - 1)


def boots_brute(rows, n_boot, seed, stat):
    units, values = defaultdict(lambda: defaultdict(set)), defaultdict(dict)
    for region, subject, unit, t, v in rows:
        units[region][subject].add(unit)
        values[unit][t] = v
    out = {}
    for region, subjects in units.items():
        names = sorted(subjects)
        for b in range(n_boot):
            for t in (0, 1):
                slots = []
                for slot in range(len(names)):
                    own = sorted(subjects[names[cubic_one(key(f"{seed}-subject", b, region), slot) % len(names)]])
                    words = key(f"{seed}-unit", b, region, slot)
                    drawn = [values[own[cubic_one(words, k) % len(own)]].get(t) for k in range(len(own))]
                    drawn = [v for v in drawn if v is not None]
                    slots += [stat(drawn)] if drawn else []
                if slots:
                    out[region, t, b] = stat(slots)
    return out


@pytest.mark.parametrize(("chunk", "stat"), [(1 << 16, "mean"), (8, "mean"), (1 << 16, "median")])
def test_hierarchical_bootstraps(spark, monkeypatch, chunk, stat):
    monkeypatch.setattr(nested, "CHUNK", chunk)
    monkeypatch.setattr(nested, "SUBJECTS", 2)
    rows = nested_rows(4)
    got = nested.hier_boots(spark.createDataFrame(rows, SCHEMA), 21, "s", extra=("t",), stat=stat).collect()
    want = boots_brute(rows, 21, "s", {"mean": np.mean, "median": np.median}[stat])
    got = {(r.region, r.t, r.b): r.centre for r in got if r.centre is not None}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_median_needs_its_subject_whole(spark, monkeypatch):
    monkeypatch.setattr(nested, "CHUNK", 8)
    with pytest.raises(Exception, match="a median is taken of 8 at most"):
        nested.hier_boots(spark.createDataFrame(nested_rows(4), SCHEMA), 9, "s", stat="median", extra=("t",)).collect()


def test_bootstraps_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nested.hier_boots(none, 9, "s").count() == 0
    assert nested.sign_flip_test(none, 9, "s").count() == 0


@pytest.mark.parametrize("alternative", ["greater", "less", "both"])
def test_sign_flips(spark, monkeypatch, alternative):
    monkeypatch.setattr(nested, "BUCKET", 16)
    rows, n = nested_rows(5), 300
    got = nested.sign_flip_test(spark.createDataFrame(rows, SCHEMA), n, "f", alternative, extra=("t",)).collect()
    assert len(got) == 6
    for r in got:
        mine = [(s, u, v) for region, s, u, t, v in rows if region == r.region and t == r.t and v is not None]

        def mean(sign, mine=mine):
            by = defaultdict(list)
            for s, u, v in mine:
                by[s].append(v * sign(u))
            return np.mean([np.mean(v) for v in by.values()])

        observed = mean(lambda u: 1)
        nulls = [mean(lambda u, b=b: 1 - 2 * int(draws.bits([f"f-sign:{b // 128}:{u}"])[0, b % 128])) for b in range(n)]
        reached = {"greater": lambda c: c >= observed - 1e-9, "less": lambda c: c <= observed + 1e-9, "both": lambda c: abs(c) >= abs(observed) - 1e-9}[alternative]
        assert r.observed == pytest.approx(observed)
        assert r.p == pytest.approx(np.mean([reached(c) for c in nulls]))
        assert r.floor == pytest.approx(1 / (n + 1))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 100, 4099])
def test_places_are_bijections(n):
    keys = draws.bijection_keys("s", range(20))
    whole = draws.places(keys, n)
    assert (np.sort(whole, 1) == np.arange(n)).all()
    assert (draws.places(keys, n, n // 3, n - n // 4) == whole[:, n // 3 : n - n // 4]).all()


def test_bijections_are_about_uniform():
    orders = draws.places(draws.bijection_keys("u", range(24_000)), 4) @ 4 ** np.arange(4)
    counts = np.unique(orders, return_counts=True)[1]
    assert len(counts) == 24 and counts.min() > 850 and counts.max() < 1150
    x = np.arange(500.0) - 249.5  # in line with the places themselves
    null = np.concatenate([x[draws.places(draws.bijection_keys("v", range(lo, lo + 1000)), 500)] @ x for lo in range(0, 10_000, 1000)]) / (x @ x) * 500**0.5
    assert null.std() == pytest.approx(1, abs=0.03)
    assert np.quantile(null, [0.005, 0.025, 0.975, 0.995]) == pytest.approx([-2.56, -1.96, 1.96, 2.56], abs=0.15)


def test_cubics_draw_evenly():
    drawn = draws.cubic(np.array([draws.words("c", i) for i in range(300)]), np.arange(200)) % 7
    assert np.abs(np.bincount(drawn.ravel()) / drawn.size - 1 / 7).max() < 0.005


@pytest.mark.parametrize("chunk", [1 << 18, 16])
@pytest.mark.parametrize("alternative", ["greater", "less", "two-sided"])
def test_correlation_permutations(spark, monkeypatch, chunk, alternative):
    monkeypatch.setattr(permutation, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = [(g, int(k), float(x), float(0.2 * x + e)) for g, size in (("a", 40), ("b", 7), ("c", 1)) for k, x, e in zip(rng.permutation(size), rng.normal(size=size), rng.normal(size=size), strict=True)]
    rows += [("flat", i, 1.0, float(i)) for i in range(5)] + [("a", 100, None, 1.0), ("a", 101, 2.0, float("nan")), ("empty", 0, None, None)]
    df = spark.createDataFrame(rows, "g string, k long, x double, y double")
    n = 101
    got = {r.g: r for r in permutation.corr_perm_test(df, n, "q", ["g"], "k", alternative=alternative).collect()}
    assert set(got) == {"a", "b", "c", "flat"} and all(got[g].p is None and got[g].r is None for g in ("c", "flat"))
    keys = draws.bijection_keys("q", range(n))
    for g in ("a", "b"):
        mine = sorted((k, x, y) for h, k, x, y in rows if h == g and x is not None and y == y)
        x, y = np.array([m[1] for m in mine]), np.array([m[2] for m in mine])
        r = np.corrcoef(x, y)[0, 1]
        nulls = np.array([np.corrcoef(x, y[to])[0, 1] for to in draws.places(keys, len(x))])
        reached = {"greater": nulls >= r - 1e-9, "less": nulls <= r + 1e-9, "two-sided": np.abs(nulls) >= abs(r) - 1e-9}[alternative]
        assert got[g].r == pytest.approx(r) and got[g].p == pytest.approx(max(reached.mean(), 1 / (n + 1)))


@pytest.mark.parametrize("chunk", [1 << 18, 8])
def test_index_permutations(spark, monkeypatch, chunk):
    monkeypatch.setattr(permutation, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows = [(u, i, int(rng.integers(0, 2)), bool(rng.integers(0, 2)), float(rng.exponential())) for u, size in ((1, 60), (2, 24), (3, 2), (4, 30)) for i in range(size)]
    rows += [(1, 1000, 0, True, None), (1, 1001, None, True, 1.0), (1, 1002, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "u long, k long, cond int, cat boolean, v double")
    n = 77
    got = {r.u: r for r in permutation.index_perm_test(df, n, "i", "u", "k", F.col("cond"), F.col("cat"), "v").collect()}
    keys = draws.bijection_keys("i", range(n))
    assert set(got) == {1, 2, 3, 4} and got[3].p is None

    def index(v, cond, cat, c):
        inside, outside = (v[(cond == c) & (cat == a)].mean() for a in (True, False))
        return (inside - outside) / (inside + outside)

    for u in (1, 2, 4):
        mine = sorted(r[1:] for r in rows if r[0] == u and None not in r)
        cond, cat, v = (np.array([m[i] for m in mine]) for i in (1, 2, 3))
        observed = [index(v, cond, cat, c) for c in (0, 1)]
        assert [got[u].index0, got[u].index1] == pytest.approx(observed)
        beyond = []
        for b in range(n):
            label = np.zeros(len(v), int)
            for a in (True, False):
                own = np.flatnonzero(cat == a)
                label[own] = draws.places(keys[b : b + 1], len(own))[0] >= (cond[own] == 0).sum()
            beyond.append(abs(index(v, label, cat, 1) - index(v, label, cat, 0)) >= abs(observed[1] - observed[0]) - 1e-9)
        assert got[u].p == pytest.approx(max(np.mean(beyond), 1 / (n + 1)))


def test_words_of_many_texts_are_those_of_md5():
    for said in ("c-perm:12:", "", "x" * 50, "y" * 53):
        for lo, hi in ((0, 120), (995, 1010), (2**32 - 3, 2**32 + 3)):
            assert draws.first_words(said, lo, hi).tolist() == [int(md5(f"{said}{k}".encode()).hexdigest()[:8], 16) for k in range(lo, hi)]


@pytest.mark.parametrize("block", [1 << 16, 32])
def test_consistency_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "SEGMENT", 19)
    monkeypatch.setattr(resample, "HELD", 250)  # two units of 100 pairs
    rng = np.random.default_rng(6)
    n, n_boot, n_perm = 100, 5, 12
    x = {u: rng.normal(size=(2, n)) + np.arange(n) / 40 + 1000 for u in "abcd"} | {"flat": np.full((2, n), 7.0)}
    x["c"][0, 3] = np.nan
    rows = [(u, k, float(v[0, k]), float(v[1, k])) for u, v in x.items() for k in range(n) if (u, k) != ("d", 8)]
    got = {r.unit: r for r in resample.value_consistency(spark.createDataFrame(rows, "unit string, k long, a double, b double").repartition(3), n_boot, n_perm, "s").collect()}
    drawn = lambda name, *keys: np.array([int(md5(":".join(map(str, (f"s-{name}", *keys, k))).encode()).hexdigest()[:8], 16) for k in range(n)])

    def corr(p, q):
        ok = np.isfinite(p) & np.isfinite(q)
        return np.corrcoef(p[ok], q[ok])[0, 1]

    assert set(got) == set(x) and got["flat"].r is None and got["flat"].p is None and got["d"].n == n - 1
    x["d"][:, 8] = np.nan
    for u in "abcd":
        a, b = x[u]
        turned = lambda odd, a=a, b=b: (np.where(odd, b, a), np.where(odd, a, b))
        r = corr(*turned(drawn("side") % 2 == 1))
        boots = [corr(*(np.where(f, q[at], p[at]) for p, q in ((a, b), (b, a)))) for i in range(n_boot) for at, f in [(drawn("boot", i) % n, drawn("boot-side", i) % 2 == 1)]]
        nulls = [corr(p, q[np.argsort(np.argsort(drawn("perm", i), kind="stable"))]) for i in range(n_perm) for p, q in [turned(drawn("perm-side", i) % 2 == 1)]]
        p = max(1 - np.mean(r - np.array(nulls) > 0), 1 / (n_perm + 1))
        assert [got[u].r, got[u].boot_mean, got[u].boot_sd, got[u].p] == pytest.approx([r, np.mean(boots), np.std(boots), p])


def test_all_near_pairs_are_tested(spark, tmp_path):
    """More near pairs than the cap of 10,000 that the query had."""
    from tessella.plans import q_stats

    rows = spark.range(250).selectExpr("id as l_orderkey", "1L as l_partkey", "1L as l_suppkey", "1L as l_linenumber", "1.0D as l_quantity", "id * 10.0D + 1000 as l_extendedprice", "0.05D as l_discount", "id % 7 / 100.0D as l_tax", "'N' as l_returnflag", "'O' as l_linestatus", "timestamp'2020-01-01' as l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.unit: r.n for r in q_stats.self_consistency_perm_p(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(("price", "tax", "x"), 250 * 249 // 2)
