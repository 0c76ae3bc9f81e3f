"""The permutation test of fits against a brute-force version."""

import numpy as np
import pytest

from tessella.functions import draws
from tessella.operators import fit_tests


def corr(p, y):
    return np.corrcoef(p, y)[0, 1] if len(y) >= 2 and p.var() > 1e-8 and y.var() > 1e-8 else np.nan


def fit(x, y, fold, alpha):
    """Correlation of the held-out predictions, of each fold and pooled."""
    pred, each = np.full(len(y), np.nan), []
    for f in range(fold.max() + 1):
        train, test = fold != f, fold == f
        xm, ym = x[train].mean(0), y[train].mean()
        w = np.linalg.solve((x[train] - xm).T @ (x[train] - xm) + alpha * np.eye(x.shape[1]), (x[train] - xm).T @ (y[train] - ym))
        pred[test] = (x[test] - xm) @ w + ym
        each.append(corr(pred[test], y[test]))
    return np.array(each), corr(pred, y)


@pytest.mark.parametrize(("reference", "alternative", "small"), [(None, "two-sided", False), (1, "greater", True), (1, "less", False), (1, "two-sided", True)])
def test_fit_differences(spark, monkeypatch, reference, alternative, small):
    if small:  # several chunks of samples, pieces of responses and blocks of units
        for name, value in (("SAMPLES", 13), ("RESPONSES", 17), ("UNITS", 2)):
            monkeypatch.setattr(fit_tests, name, value)
    rng = np.random.default_rng(7)
    n, places, n_perm, alpha = 40, (0, 1, 2), 30, 0.7
    fold = np.arange(n) % 3
    x = {p: rng.normal(size=(n, 4)) for p in places}
    y = {u: (x[k][:, 0] + 0.5 * rng.normal(size=n), x[1][:, 1] + rng.normal(size=n)) for k, u in enumerate("abc")}
    features = [(p, k, int(fold[k]), [float(v) for v in x[p][k]]) for p in places for k in range(n)]
    features += [(0, 500, 0, [1.0] * 4), (0, 501, 1, [1.0] * 4), (1, 501, 1, [1.0] * 4), (2, 501, 1, [1.0] * 4)]  # not everywhere; without a response
    responses = [(k, u, float(y[u][0][k]), float(y[u][1][k])) for u in y for k in range(n)]
    responses += [(501, "a", 1.0, 1.0), (501, "b", None, 1.0), (501, "c", 2.0, 1.0), (500, "a", 1.0, 2.0), (500, "b", 1.0, 2.0), (500, "c", 1.0, 2.0)]
    df = spark.createDataFrame(features, "place int, key long, fold int, x array<double>"), spark.createDataFrame(responses, "key long, unit string, y0 double, y1 double")
    if small:
        got = fit_tests.fit_difference_test(*df, alpha, n_perm, "s", reference, alternative)
    else:
        got = fit_tests.fit_difference_test(df[0].repartition(5), df[1].repartition(3), alpha, n_perm, "s", reference, alternative)
    got = {(r.place, r.unit): r for r in got.collect()}
    assert set(got) == {(p, u) for p in places for u in y}

    moves = draws.places(draws.bijection_keys("s", range(n_perm)), 2 * n)
    for u in y:
        both = np.concatenate(y[u])
        gap = {p: fit(x[p], y[u][1], fold, alpha)[0] - fit(x[p], y[u][0], fold, alpha)[0] for p in places}
        null = {p: np.array([fit(x[p], both[to[n:]], fold, alpha)[0] - fit(x[p], both[to[:n]], fold, alpha)[0] for to in moves]) for p in places}
        for p in places:
            o, d = gap[p], null[p]
            if reference is not None:
                o, d = o - gap[reference], d - null[reference]
            beyond = {"two-sided": np.abs(o) - np.abs(d), "less": o - d, "greater": d - o}[alternative].ravel()
            want = max(1 - (beyond > 0).mean(), 1 / (1 + beyond.size))
            r = got[p, u]
            assert [r.corr0, r.corr1] == pytest.approx([fit(x[p], y[u][c], fold, alpha)[1] for c in (0, 1)])
            assert r.p is None if p == reference else r.p == pytest.approx(want)


def test_fit_differences_hold_few_samples_at_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n, places = 60, (0, 1, 2)
    features = [(p, k, int(k + (p == 2)) % 3, rng.normal(size=4).tolist()) for p in places for k in range(n)]  # one place deals the folds otherwise
    responses = [(k, u, *rng.normal(size=2).tolist()) for u in "ab" for k in range(n)]
    df = spark.createDataFrame(features, "place int, key long, fold int, x array<double>"), spark.createDataFrame(responses, "key long, unit string, y0 double, y1 double")
    monkeypatch.setattr(fit_tests, "CHUNKS", 1)
    run = lambda: {(r.place, r.unit): (r.corr0, r.corr1, r.p) for r in fit_tests.fit_difference_test(*df, 0.5, 40, "s").collect()}
    want = run()
    rows, multiply = 13, fit_tests._add_products

    def few(out, x, folds, y, k, *rest):
        if sum(map(len, x)) + len(k) > 2 * rows:
            raise AssertionError(f"{len(k)} samples are held at once")
        multiply(out, x, folds, y, k, *rest)

    monkeypatch.setattr(fit_tests, "ROWS", rows)
    monkeypatch.setattr(fit_tests, "_add_products", few)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = run()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got.keys() == want.keys() == {(p, u) for p in places for u in "ab"}
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("small", [False, True])
def test_units_are_fitted_in_their_own_field(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(fit_tests, "SAMPLES", 11)
        monkeypatch.setattr(fit_tests, "UNITS", 2)
    rng = np.random.default_rng(8)
    n, fields = 40, {"p": "ab", "q": "cdefg"}
    fold = np.arange(n) % 4
    x = {f: rng.normal(size=(n, 3)) for f in fields}
    y = {u: x[f][:, 0] * k + rng.normal(size=n) for f, units in fields.items() for k, u in enumerate(units)}
    y["g"] = np.ones(n)
    features = [(f, k, int(fold[k]), [float(v) for v in x[f][k]]) for f in fields for k in range(n)] + [("p", 99, 0, [9.0] * 3)]
    responses = [(f, u, k, float(y[u][k])) for f, units in fields.items() for u in units for k in range(n)] + [("p", "a", 99, 1.0), ("p", "b", 99, None)]
    got = fit_tests.fit_by_field(spark.createDataFrame(features, "field string, key long, fold int, x array<double>"), spark.createDataFrame(responses, "field string, unit string, key long, y double"), 0.4)
    got = {(r.field, r.unit): r for r in got.collect()}
    assert set(got) == {(f, u) for f, units in fields.items() for u in units}
    assert got["q", "g"].corr is None and got["q", "g"].r2 is None
    for (f, u), r in got.items():
        if u != "g":
            pred = np.full(n, np.nan)
            for k in range(4):
                train = fold != k
                xm, ym = x[f][train].mean(0), y[u][train].mean()
                w = np.linalg.solve((x[f][train] - xm).T @ (x[f][train] - xm) + 0.4 * np.eye(3), (x[f][train] - xm).T @ (y[u][train] - ym))
                pred[~train] = (x[f][~train] - xm) @ w + ym
            assert r.n == n and r.corr == pytest.approx(np.corrcoef(pred, y[u])[0, 1])
            assert r.r2 == pytest.approx(1 - ((y[u] - pred) ** 2).sum() / ((y[u] - y[u].mean()) ** 2).sum())


def test_bijections_of_chosen_numbers():
    keys, some = draws.bijection_keys("s", range(5)), np.array([9, 3, 77])
    assert (draws.places(keys, 100, at=some) == draws.places(keys, 100)[:, some]).all()


def test_features_are_attached_after_the_shuffles(spark):
    from tessella.plans import q_models

    for found in (q_models.places(spark, "/root/testdata/sf0.001"), q_models.positions(spark, "/root/testdata/sf0.001")):
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        first = next(line for line in plan if "Join" in line)
        assert "LeftOuter" in first and "ix" in first  # the look-up of features is the last join
