"""Models, geometry, sources, sinks and streams."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import models, space
from tessella.sources import readers, writers
from tessella.streaming import live


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 6))
    return x, np.stack([x[:, 0] - x[:, 2] + 0.1 * rng.standard_normal(120), rng.standard_normal(120)], 1), rng.integers(0, 4, 120)


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, fold = data
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i, 0]), float(y[i, 1]), int(fold[i])) for i in range(120)], "key long, x array<double>, a double, b double, fold int").repartition(5)


def test_ridge_is_a_direct_refit(frame, data):
    x, y, fold = data
    pred = np.zeros_like(y)
    for f in range(4):
        out = fold == f
        xm, ym = x[~out].mean(0), y[~out].mean(0)
        w = np.linalg.solve((x[~out] - xm).T @ (x[~out] - xm) + 2.0 * np.eye(6), (x[~out] - xm).T @ (y[~out] - ym))
        pred[out] = (x[out] - xm) @ w + ym
    got = {(r.unit, round(r.y, 9)): r.pred for r in models.cv_ridge(frame, [], "x", ["a", "b"], 2.0).collect()}
    assert len(got) == 240
    for i in range(120):
        assert got["a", round(y[i, 0], 9)] == pytest.approx(pred[i, 0]) and got["b", round(y[i, 1], 9)] == pytest.approx(pred[i, 1])
    scores = {r.unit: r for r in models.evaluate(models.cv_ridge(frame, [], "x", ["a", "b"], 2.0), []).collect()}
    assert scores["a"].corr == pytest.approx(np.corrcoef(pred[:, 0], y[:, 0])[0, 1])
    assert scores["a"].r2 == pytest.approx(1 - ((pred[:, 0] - y[:, 0]) ** 2).sum() / ((y[:, 0] - y[:, 0].mean()) ** 2).sum())


def test_projection_follows_its_unit(frame):
    fits = models.fit_folds(frame, [], "x", ["a", "b"], 2.0)
    got = models.feature_projection(frame, fits, {"a": (), "b": ()}, [], "x", ["a", "b"])
    assert got.where("unit = 'a'").agg(F.min("r")).first()[0] > 0.9
    assert models.pooled_folds(got, ["unit"], 4).where("r is not null").count() == 2
    assert models.pooled_folds(got, ["unit"], 5).where("r is not null").count() == 0


def test_model_queries_look_up_every_image_and_feature(spark):
    from tessella.plans import q_models

    sf = "/root/testdata/sf0.1"
    every = {tuple(map(float, r[0])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()}
    assert {tuple(r[0]) for r in q_models.places(spark, sf).select("feat").distinct().collect()} - {(0.0,) * 64} == every
    found = q_models.positions(spark, sf).select("image", "feat").groupBy("image").agg(F.max(F.size("feat")), F.count_if(F.col("feat")[0] != 0)).collect()
    assert {r[0] for r in found} == set(range(80)) and {r[1] for r in found} == {64} and all(r[2] for r in found)


@pytest.mark.parametrize("make", [lambda df: models.snake_folds(df, "g", 3), lambda df: models.greedy_folds(df, "g", 3, "s")])
def test_no_group_spans_folds(spark, make):
    df = spark.createDataFrame([(i, f"g{min(i % 11, i % 7)}") for i in range(200)], "i long, g string")
    got = make(df)
    assert got.count() == 200
    assert got.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert got.select("fold").distinct().count() == 3
    loads = [r["count"] for r in models.greedy_folds(df, "g", 3, "s").groupBy("fold").count().collect()]
    assert max(loads) - min(loads) <= df.groupBy("g").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("sizes", [[1] * 40, [90] + [1] * 70, [50, 50, 7, 7, 7, 3, 3, 1, 1, 1, 1, 1, 1], [9, 8, 7, 6, 5] + [2] * 31 + [1] * 3, [5]])
def test_greedy_folds_of_many_groups(spark, sizes):
    from tessella.functions.scalars import draw

    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g long").repartition(4)
    loads, want = [0] * 4, {}
    for r in df.groupBy("g").count().orderBy(F.col("count").desc(), draw("s", F.col("g")), "g").collect():
        want[r.g] = min(range(4), key=lambda i: (loads[i], i))
        loads[want[r.g]] += r["count"]
    got = models.greedy_folds(df, "g", 4, "s")
    assert got.count() == sum(sizes) and {r.g: r.fold for r in got.distinct().collect()} == want


def test_greedy_query_takes_every_alias(spark, monkeypatch):
    from tessella.plans import q_models

    seen = []
    of = models.canonical_groups
    monkeypatch.setattr(models, "canonical_groups", lambda rows, aliases, group: seen.append(aliases.count()) or of(rows, aliases, group))
    sf = "/root/testdata/sf0.001"
    q_models.group_kfold_greedy(spark, sf)
    merged = spark.read.parquet(f"{sf}/part.parquet").where("p_type in ('SMALL', 'MEDIUM')")
    assert seen == [merged.select("p_brand", "p_type").distinct().count()]


@pytest.mark.parametrize("per_split", [False, True])
def test_scores_from_sums_are_those_of_the_predictions(spark, per_split):
    rng = np.random.default_rng(8)
    data = [(p, int(f), rng.standard_normal(4).tolist(), float(v), 1.0) for p in range(3) for f in range(3) for v in rng.standard_normal(9) + 5]
    data += [(7, 0, [0.0] * 4, 1.0, 1.0), (7, 1, [1.0] * 4, 2.0, 1.0)]  # no fold can be fitted without the other
    rows_ = spark.createDataFrame(data, "place int, fold int, x array<double>, a double, flat double")
    got = models.cv_ridge_scores(rows_, ["place"], "x", ["a", "flat"], 0.5, per_split).toPandas()
    want = models.evaluate(models.cv_ridge(rows_, ["place"], "x", ["a", "flat"], 0.5), ["place"], per_split).toPandas()
    keys = ["place", "unit", *(["fold"] if per_split else [])]
    met = got.merge(want, on=keys, suffixes=("", "_w"))
    assert len(met) == len(got) == len(want) and (met.n == met.n_w).all()
    for c in ("corr", "r2"):
        assert met[c].isna().tolist() == met[f"{c}_w"].isna().tolist()
        assert np.allclose(met[c].fillna(0), met[f"{c}_w"].fillna(0), atol=1e-9)


def test_similar_images_share_a_group(spark):
    lines = spark.createDataFrame([("a\tb\tc",), ("d\te",), ("",)], "value string")
    df = spark.createDataFrame([("a",), ("c",), ("e",), ("z",)], "g string")
    assert rows(models.canonical_groups(df, models.alias_map(lines), "g"), "g") == [("a",), ("a",), ("d",), ("z",)]


def test_embed(spark):
    df = spark.createDataFrame([(i, bytes([i, 2 * i])) for i in range(5)], "image long, pixels binary")
    got = models.embed(df, lambda batch: [np.frombuffer(bytes(b), np.uint8).astype(float) for b in batch], batch=2)
    assert rows(got) == [(i, [float(i), 2.0 * i]) for i in range(5)]


# -- geometry


def test_grid_edges_and_lookup(spark):
    assert space.grid_edges(16, 2, 0.5)[:2] == [-8.75, -8.25] and len(space.grid_edges(16, 2, 0.5)) == 32
    grid = spark.createDataFrame([(1, 0, 0, [1.0]), (1, 1, 0, [2.0])], "image long, ix long, iy long, feat array<double>")
    ev = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.999, 0.0), (1, 1.0, 0.5), (1, 2.0, 0.0), (1, -0.01, 0.0), (2, 0.0, 0.0)], "image long, x double, y double")
    got = [r.feat[0] for r in space.grid_lookup(ev, grid, [-1.0], (0.0, 0.0), 1.0).orderBy("image", "x", "y").collect()]
    assert got == [-1.0, 1.0, 1.0, 2.0, -1.0, -1.0]


def test_dilation_keeps_component_ids(spark):
    mask = np.zeros((5, 9), np.uint8)
    mask[1:3, 1:3] = 255
    mask[2, 7] = 200
    df = spark.createDataFrame([(1, "face", 9, 5, mask.tobytes())], "image long, category string, width int, height int, pixels binary")
    got = {(r.px, r.py): r.component for r in space.mask_cells(df, 2).collect()}
    cells = {1: [(1, 1), (2, 1), (1, 2), (2, 2)], 2: [(7, 2)]}
    for x in range(-2, 11):
        for y in range(-2, 7):
            near = {c: min((x - a) ** 2 + (y - b) ** 2 for a, b in at) for c, at in cells.items()}
            best = min(near, key=lambda c: (near[c], c))
            assert got.get((x, y)) == (best if near[best] <= 4 else None)
    ev = spark.createDataFrame([(1, 7.5, 2.5), (1, 4.5, 4.5), (2, 0.0, 0.0), (3, 0.0, 0.0)], "image long, x double, y double")
    boxes = spark.createDataFrame([(1, 4.0, 4.0, 5.0, 5.0), (2, -1.0, -1.0, 1.0, 1.0)], "image long, x1 double, y1 double, x2 double, y2 double")
    assert rows(space.roi_hits(ev, boxes, space.mask_cells(df, 1)), "image", "x", "hit", "component") == [(1, 4.5, False, None), (1, 7.5, True, 2), (2, 0.0, True, 0), (3, 0.0, False, None)]


@pytest.mark.parametrize("seed", range(6))
def test_masks_as_runs(spark, seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 14), rng.integers(1, 18))) < rng.choice([0.1, 0.5, 0.9])
    ids, todo = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not ids[start]:
            todo, todo_cells = todo + 1, [start]
            while todo_cells:
                i, j = todo_cells.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not ids[i, j]:
                    ids[i, j] = todo
                    todo_cells += [(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)]
    line, first, last = space.runs_of(mask)
    assert [ids[y, x] for y, x in zip(line, first, strict=True)] == (space.run_components(line, first, last).tolist() if len(line) else [])
    for radius in (0, 1, 3):
        want = np.zeros((mask.shape[0] + 2 * radius, mask.shape[1] + 2 * radius), int)
        for y, x in np.ndindex(want.shape):
            near = [((y - radius - a) ** 2 + (x - radius - b) ** 2, ids[a, b]) for a, b in zip(*np.nonzero(mask), strict=True)]
            want[y, x] = min(near)[1] if near and min(near)[0] <= radius**2 else 0
        assert (space.dilate(ids, radius) == want).all()
    if seed == 0:
        df = spark.createDataFrame([(3, "c", mask.shape[1], mask.shape[0], (mask * np.uint8(255)).tobytes()), (4, "c", 2, 2, bytes(4))], "image long, category string, width int, height int, pixels binary")
        cells = [(3, int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)] * 2
        one = rows(space.mask_runs(df, 2), "py", "x0", "x1", "component")
        assert one == rows(space.cell_runs(spark.createDataFrame(cells, "image long, px long, py long"), 2, ["image"]), "py", "x0", "x1", "component") and one


def test_two_boxes_of_an_image_fail(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 10.0, 10.0)] * 2, "image long, x double, y double, w double, h double, image_w double, image_h double")
    with pytest.raises(Exception, match="more than one box"):
        space.scaled_boxes(df, F.lit(10.0), F.lit(10.0), 0.0).collect()


def test_control_points_are_equidistant(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, rng.uniform(-9, 9, 4))) for i in range(50)], "move_id long, x0 double, y0 double, x1 double, y1 double")
    for r in space.distances_to_control(space.control_points(df, 20.0, 20.0, "s")).collect():
        size = np.hypot(r.x1 - r.x0, r.y1 - r.y0)
        assert r.d0 == pytest.approx(size) and r.d1 == pytest.approx(size)
        assert (r.mx, r.my) == pytest.approx(((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2))


def test_gaussian_fit_finds_its_parameters(spark):
    x, y = (a.ravel() for a in np.meshgrid(np.arange(-7, 8.0), np.arange(-7, 8.0)))
    z = space.gaussian(np.array([2.0, 1.0, -2.0, 2.5, 1.5, 0.6, 0.1]), x, y)
    data = [("a", *map(float, v)) for v in zip(x, y, z, strict=True)] + [("flat", *map(float, v), 1.0) for v in zip(x, y, strict=True)]
    maps = spark.createDataFrame(data, "k string, x double, y double, z double")
    got = {r.k: r for r in space.fit_gaussians(maps, ["k"]).collect()}
    assert got["flat"].x0 is None
    a = got["a"]
    assert (a.x0, a.y0, a.amplitude, a.radius) == pytest.approx((1.0, -2.0, 2.0, np.sqrt(2.5 * 1.5)), abs=1e-3) and a.r_fit > 0.9999
    assert rows(space.acceptable_fit(space.fit_gaussians(maps, ["k"])), "k") == [("a",)]
    split = maps.where("k = 'a'").withColumn("split", F.explode(F.array(F.lit(0), F.lit(1))))
    cons = space.map_consistency(space.fit_gaussians(split, ["k", "split"]), split, ["k"]).collect()
    assert len(cons) == 2 and all(r.r > 0.999 for r in cons)


def single_fit(x, y, z, free, p):
    """A damped descent for one map, with derivatives by differences."""
    damp, error = 1e-2, ((space.gaussian(p, x, y) - z) ** 2).sum()
    for _ in range(200):
        base = space.gaussian(p, x, y)
        step = 1e-6 * np.maximum(np.abs(p), 1e-2)
        jac = np.stack([(space.gaussian(p + step * e, x, y) - base) / step[i] for i, e in enumerate(np.eye(7))], 1)[:, free]
        normal, tried = jac.T @ jac, p.copy()
        tried[free] += np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), jac.T @ (z - base))
        now = ((space.gaussian(tried, x, y) - z) ** 2).sum()
        p, error, damp = (tried, now, damp / 3) if now < error else (p, error, damp * 4)
        if damp > 1e8:
            break
    return p


@pytest.mark.parametrize("positive", [False, True])
def test_stacked_fits_are_single_fits(spark, positive):
    rng = np.random.default_rng(3)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(-6, 7.0), np.arange(-5, 6.0)))
    truth, data = {}, []
    for k in range(40):
        true = np.array([rng.uniform(0.5, 3), *rng.uniform(-2, 2, 2), rng.uniform(1.8, 2.6), rng.uniform(1, 1.5), rng.uniform(0, 3), 0.0 if positive else rng.uniform(-1, 1)])
        keep = rng.random(len(x)) < (1 if k % 2 else 0.8)  # every other map lacks cells
        z = space.gaussian(true, x, y) + 0.02 * rng.standard_normal(len(x))
        truth[k] = true, x[keep], y[keep], z[keep]
        data += [(k, *map(float, v)) for v in zip(x[keep], y[keep], z[keep], strict=True)] + [(k, 50.0, 50.0, None), (k, 60.0, 60.0, float("nan"))]
    maps = spark.createDataFrame(data, "k long, x double, y double, z double").repartition(3)
    got = {r.k: r for r in space.fit_gaussians(maps, ["k"], positive=positive).collect()}
    assert got.keys() == truth.keys()
    for k, (true, x_, y_, z_) in truth.items():
        r, up, top = got[k], np.maximum(z_, 0), z_.max()
        free = np.arange(1, 6) if positive else np.arange(7)
        start = true.copy()
        if positive:
            start[0] = 1.0
        p = single_fit(x_, y_, up / top if positive else z_, free, start)
        bump = space.gaussian(np.array([1, *p[1:6], 0]), x_, y_)
        assert (r.x0, r.y0, r.radius, r.top) == pytest.approx((p[1], p[2], np.sqrt(abs(p[3] * p[4])), top), abs=1e-4)
        assert (r.amplitude, r.offset) == pytest.approx((top, 0) if positive else (p[0], p[6]), abs=1e-4)
        assert r.r_fit == pytest.approx(np.corrcoef(bump, up if positive else z_)[0, 1], abs=1e-5) and r.r_start is not None
        mass = bump[z_ > 0].sum()  # none where no value is above 0
        assert r.weighted_fit == pytest.approx((bump * up).sum() / mass if mass else 0, abs=1e-4)
        assert r.coverage_fit == pytest.approx(bump.sum() / (2 * np.pi * abs(p[3] * p[4])), abs=1e-4)
        cell = z_[(x_ == np.floor(p[1])) & (y_ == np.floor(p[2]))]
        assert r.at_centre_fit == (cell[0] if len(cell) else None)


def test_fits_of_unfit_maps(spark):
    grid = [(float(i), float(j)) for i in range(4) for j in range(4)]
    data = [("low", i, j, -1.0 - i) for i, j in grid] + [("few", 0.0, 0.0, 1.0)] + [("none", 0.0, 0.0, None)] + [("line", float(i), 0.0, float(i == 5)) for i in range(12)]
    maps = spark.createDataFrame(data, "k string, x double, y double, z double")
    got = {r.k: r for r in space.fit_gaussians(maps, ["k"], positive=True).collect()}
    assert got.keys() == {"low", "few", "none", "line"} and all(r.x0 is None and r.r_fit is None for r in got.values())
    free = {r.k: r for r in space.fit_gaussians(maps, ["k"]).collect()}
    assert free["few"].x0 is None and free["none"].x0 is None and free["low"].x0 is not None
    assert free["line"].coverage_fit is None  # cells on a line have no area
    assert space.fit_gaussians(maps.limit(0), ["k"]).count() == 0


def test_many_maps_take_few_tasks(spark):
    xy = F.explode(F.sequence(F.lit(0), F.lit(63)))
    maps = spark.range(10_000).select(F.col("id").alias("k"), xy.alias("c")).select("k", (F.col("c") % 8).cast("double").alias("x"), F.floor(F.col("c") / 8).cast("double").alias("y"))
    bump = F.exp(-0.5 * (F.pow(F.col("x") - 3 - F.col("k") % 3, 2) + F.pow((F.col("y") - 4) / 1.5, 2)))
    fits = space.fit_gaussians(maps.withColumn("z", bump), ["k"], positive=True)
    got = fits.agg(F.count("*"), F.max(F.abs(F.col("x0") - 3 - F.col("k") % 3)), F.max(F.abs(F.col("y0") - 4)), F.min("r_fit")).first()
    assert got[0] == 10_000 and got[1] < 1e-4 and got[2] < 1e-4 and got[3] > 0.9999
    assert fits.rdd.getNumPartitions() <= 64


def test_moments_of_a_map(spark):
    rng = np.random.default_rng(3)
    x, y, w = rng.standard_normal(40), rng.standard_normal(40), np.maximum(rng.standard_normal(40), 0)
    df = spark.createDataFrame([(1, *map(float, v)) for v in zip(x, y, w, strict=True)], "k int, x double, y double, w double")
    r = space.weighted_moments(df, ["k"]).first()
    cov = np.cov(np.stack([x, y]), aweights=w, ddof=0)
    assert np.allclose([[r.cxx, r.cxy], [r.cxy, r.cyy]], cov)
    assert np.allclose([[r.ixx, r.ixy], [r.ixy, r.iyy]], np.linalg.inv(cov))


# -- sources and sinks


def test_guarded_writes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a, b = spark.createDataFrame([(1, 0.5), (2, None), (2, None)], "i long, v double"), spark.createDataFrame([(1, 0.5), (2, None)], "i long, v double")
    assert writers.save(a, path) == "created" and writers.save(a.select("v", "i"), path) == "equal"
    with pytest.raises(ValueError, match="other rows"):
        writers.save(b, path)
    assert writers.save(b, path, overwrite=True) == "overwritten" and spark.read.parquet(path).count() == 2
    nan = spark.createDataFrame([(float("nan"),)], "v double")
    assert writers.same_rows(nan, nan.select("v")) and not writers.same_rows(nan, nan.union(nan))
    assert writers.append_missing(spark.createDataFrame([(2, 9.0), (3, 9.0)], "i long, v double"), path, ["i"]) == 1
    assert rows(spark.read.parquet(path)) == [(1, 0.5), (2, None), (3, 9.0)]
    writers.save_quantized(spark.createDataFrame([(0.33333,), (float("nan"),)], "v double"), f"{path}q", 3, ["v"])
    assert rows(spark.read.parquet(f"{path}q")) == [(341 / 1024,), (None,)]


def test_results_are_committed(spark, tmp_path):
    r = writers.Results(spark, f"file://{tmp_path}/r")
    r.guard("s", "x")
    r.write("rate", spark.range(3))
    r.set("s", "x", seed=7)
    assert not r.is_done("s", "x")
    r.commit("s", "x")
    with pytest.raises(writers.AlreadyDone):
        r.guard("s", "x")
    assert not r.is_done("t", "x")
    r.link("rate", "rates")
    assert spark.table("rates").count() == 3
    other = writers.Results(spark, f"file://{tmp_path}/o")
    assert r.copy("rate", other) == "created" and r.copy("rate", other) == "equal"


def test_scans(spark, tmp_path):
    (tmp_path / "similar.tsv").write_text("a\tb\tc\nd\te\n")
    assert rows(readers.read_aliases(spark, f"file://{tmp_path}/similar.tsv")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    writers.write_csv(spark.createDataFrame([(1, "x")], "i int, s string"), f"file://{tmp_path}/c")
    assert rows(readers.read_csv(spark, f"file://{tmp_path}/c", "i int, s string")) == [(1, "x")]
    np.save(tmp_path / "a.npy", np.array([[0, 2.5], [np.nan, 1]]))
    assert rows(readers.read_arrays(spark, f"file://{tmp_path}/a.npy"), "row", "column", "value") == [(0, 1, 2.5), (1, 0, None), (1, 1, 1.0)]
    (tmp_path / "i.pgm").write_bytes(b"P5\n# made here\n2 1\n255\n\x01\x02")
    r = readers.decode_portable_images(spark, f"file://{tmp_path}/i.pgm").first()
    assert (r.width, r.height, bytes(r.pixels)) == (2, 1, b"\x01\x01\x01\x02\x02\x02")
    for s, extra in (("p1", ""), ("p2", ", 5 as more")):
        spark.sql(f"select 1 as unit{extra}").write.parquet(f"file://{tmp_path}/session={s}")
    config = spark.createDataFrame([("p2", "all_done", "True"), ("p1", "all_done", "false")], "session string, key string, value string")
    got = readers.read_sessions(spark, [f"file://{tmp_path}/session={s}" for s in ("p1", "p2")], config)
    assert rows(got, "session", "unit", "more") == [("p2", 1, 5)]
    assert readers.read_columns(spark, f"file://{tmp_path}/session=p1", ["1"]).count() == 1


def test_strict_lookups(spark):
    dim = spark.createDataFrame([(1, "a")], "k long, v string")
    assert rows(readers.lookup_strict(spark.createDataFrame([(1,), (1,)], "k long"), dim, "k"), "k", "v") == [(1, "a"), (1, "a")]
    with pytest.raises(Exception, match="no row for k 2"):
        readers.lookup_strict(spark.createDataFrame([(2,)], "k long"), dim, "k").collect()
    files = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "session string, t long")
    assert rows(readers.consistent(files, "t"), "t") == [(1,), (2,)]
    with pytest.raises(Exception, match="differs between files"):
        readers.consistent(files.where("not (session = 'b' and t = 2)"), "t").collect()


# -- streams


def test_live_cleaning_equals_batch(spark, tmp_path):
    schema = "trial long, fix_id long, t0 long, t1 long, x double, y double, ts timestamp"
    data = spark.createDataFrame([(1, 1, 90, 120, 1.0, 1.0), (1, 2, 130, 150, 2.0, 2.0), (1, 2, 130, 150, 2.0, 2.0), (2, 3, 0, 9, 0.0, 0.0)], schema.rsplit(",", 1)[0]).withColumn("ts", F.timestamp_seconds(F.col("t0")))
    data.write.parquet(f"file://{tmp_path}/in")
    shown = spark.createDataFrame([(1, 100, 200, 0.0, 0.0)], "trial long, onset long, offset long, px double, py double")
    stream = live.live_clean(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), shown)
    q = stream.writeStream.format("memory").queryName("live").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("live"), "fix_id", "t0", "duration", "zeroth") == [(1, 100, 20, True), (2, 130, 20, False)]
    rates = live.live_rates(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "trial", width="1 minute", delay="0 seconds")
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("rates"), "trial", "n") == [(1, 1), (1, 2), (2, 1)]
