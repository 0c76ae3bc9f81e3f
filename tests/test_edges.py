"""Edge semantics on small hand-made tables."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import moments, scalars
from tessella.operators import aggregates, align, crossing, events, hierarchy, pairs, resample, summary
from tessella.operators import tests as stat


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


# -- events

EVENTS = "trial long, fix_id long, t0 long, t1 long, x double, y double"
SHOWN = "trial long, onset long, offset long, px double, py double"


def clean(spark, data, shown=((1, 100, 200, 0.0, 0.0),)):
    met = events.overlapping(spark.createDataFrame(data, EVENTS), spark.createDataFrame(list(shown), SHOWN))
    return events.ordinals(events.durations(events.relative_position(events.clip_to_onset(met))))


def test_overlap_is_half_strict(spark):
    data = [(1, 1, 50, 100, 0.0, 0.0), (1, 2, 90, 101, 0.0, 0.0), (1, 3, 200, 250, 0.0, 0.0), (1, 4, 201, 250, 0.0, 0.0), (2, 5, 100, 150, 0.0, 0.0)]
    assert rows(clean(spark, data), "fix_id", "t0", "zeroth", "ord", "trial_time") == [(2, 100, True, 0, 0), (3, 200, False, 1, 100)]


def test_ordinals_follow_time_not_row_order(spark):
    data = [(1, 1, 180, 190, 0.0, 0.0), (1, 2, 120, 130, 0.0, 0.0), (1, 3, 150, 160, 0.0, 0.0)]
    out = events.with_neighbours(clean(spark, data))
    assert rows(out, "fix_id", "ord", "prev_id", "next_id") == [(1, 3, 3, None), (2, 1, None, 3), (3, 2, 2, 1)]


def test_neighbours_need_the_next_ordinal(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 3)], "trial long, fix_id long, ord long")
    assert rows(events.with_neighbours(df), "fix_id", "prev_id", "next_id") == [(1, None, 2), (2, 1, None), (3, None, None)]


def test_selection_bounds(spark):
    data = [(i, d, t, x, 0.0) for i, (d, t, x) in enumerate([(100.0, 500.0, 0.0), (99.0, 500.0, 0.0), (100.0, 499.0, 0.0), (100.0, 1400.0, 0.0), (100.0, 1401.0, 0.0), (100.0, 500.0, 5.0), (100.0, 500.0, -4.9)])]
    df = spark.createDataFrame(data, "fix_id long, duration double, trial_time double, rx double, ry double")
    assert rows(events.select_events(df, 2000, 100, 500, 10, 10), "fix_id") == [(0,), (3,), (6,)]


def test_separation_with_an_empty_side_is_the_size(spark):
    ev = spark.createDataFrame([(1, 1, 0, 0, 10, 0.0, 0.0), (1, 2, 1, 20, 30, 9.0, 0.0), (1, 3, 2, 40, 50, 1.0, 0.0)], "trial long, fix_id long, ord long, t0 long, t1 long, x double, y double")
    moves = events.transitions(ev)
    assert rows(events.separations(moves, ev, 100), "to_id", "size", "separation") == [(2, 9.0, 9.0), (3, 8.0, 8.0)]
    more = ev.union(spark.createDataFrame([(1, 4, 3, 60, 70, 1.5, 0.0)], ev.schema))
    assert dict(rows(events.separations(events.transitions(more), more, 100), "to_id", "separation"))[3] == 1.5


def test_tied_modes_are_averaged(spark):
    df = spark.createDataFrame([(v,) for v in (310.0, 290.0, 520.0, 480.0, 800.0, 60.0, 60.0, 60.0)], "d double")
    assert events.modal_value(df, F.col("d"), 100.0, 200.0).first().modal == 400.0
    assert rows(events.at_modal_value(df, F.col("d"), 100.0, 200.0), "d") == []


def test_latency_shift_and_outer_events(spark):
    ev = spark.createDataFrame([("s", 1.0, 2.0), ("none", 1.0, 2.0)], "session string, t0 double, t1 double")
    rigs, lat = spark.createDataFrame([("s", "A", "x")], "session string, rig string, tracker string"), spark.createDataFrame([("A", "x", 250.0)], "rig string, tracker string, latency double")
    assert rows(events.shift_by_latency(ev, rigs, lat), "session", "t0", "t1") == [("s", 0.75, 1.75)]


def test_sequences_and_bins(spark):
    w = spark.createDataFrame([(1, i, c) for i, c in enumerate([3, 2, 1, 3, 2, 2, 1, 3, 2, 1])], "trial long, t long, word int")
    assert rows(events.sequence_starts(w, [3, 2, 1], "word", "trial", ("t",)), "t") == [(0,), (7,)]
    iv = spark.createDataFrame([(1, 2, 5), (1, 4, 6), (1, 9, 9)], "trial long, t0 long, t1 long")
    assert rows(events.covered_bins(iv), "bin") == [(2,), (3,), (4,), (5,)]


# -- pairs


def test_pair_thresholds_and_order(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 2.5, 0.0), (2, 4, 0.0, 0.0)], "image long, fix_id long, x double, y double")
    assert rows(pairs.return_pairs(df, 1.0), "fix_id_i", "fix_id_j") == [(1, 2)]
    assert rows(pairs.all_pairs(df, farther_than=1.0), "fix_id_i", "fix_id_j") == [(1, 3), (2, 3)]
    assert pairs.return_pairs(df.where("image = 2"), 1.0).count() == 0


def test_return_pairs_are_brute_force_pairs(spark):
    rng = random.Random(1)
    data = [(rng.randrange(3), i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(120)]
    got = rows(pairs.return_pairs(spark.createDataFrame(data, "image long, fix_id long, x double, y double"), 2.0), "fix_id_i", "fix_id_j")
    want = [(a[1], b[1]) for a, b in itertools.combinations(data, 2) if a[0] == b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 2]
    assert got == sorted(want, key=str)


def test_ladder_is_nested(spark):
    df = spark.createDataFrame([(0.4,), (1.0,), (1.7,)], "d double")
    assert rows(pairs.ladder(df, [0.5, 1, 2]), "threshold", "d") == [(0.5, 0.4), (1.0, 0.4), (1.0, 1.0), (2.0, 0.4), (2.0, 1.0), (2.0, 1.7)]


def test_matched_controls_hold_their_conditions(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(4), rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 20), rng.uniform(0, 20), rng.choice("FO"), rng.choice(["F", "O", None]), 5.0) for i in range(150)]
    names = "move_id long, image long, x double, y double, fx double, fy double, to_category string, from_category string, size double"
    got = rows(pairs.matched_moves(spark.createDataFrame(data, names), 1.0, 4.0, "F", "s"))
    by = {d[0]: d for d in data}
    fits = lambda a, b: a[0] != b[0] and a[1] == b[1] and a[6] == b[6] == "F" and math.hypot(a[2] - b[2], a[3] - b[3]) <= 1 and b[7] not in ("F", None) and math.hypot(a[4] - b[4], a[5] - b[5]) >= 4
    assert got and all(fits(by[a], by[b]) for a, b in got)
    assert {a for a, _ in got} == {a[0] for a in data if any(fits(a, b) for b in data)}


# -- moments, rounding, names


def test_pearson_guards(spark):
    df = spark.createDataFrame([("const", 1.0, 1.0), ("const", 1.0, 2.0), ("one", 1.0, 1.0), ("null", None, 1.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, None)], "k string, x double, y double")
    assert rows(df.groupBy("k").agg(moments.pearson(F.col("x"), F.col("y")).alias("r"))) == [("const", None), ("null", None), ("ok", 1.0), ("one", None)]
    tiny = spark.createDataFrame([(1.0, 1.0), (1.0 + 1e-6, 2.0)], "x double, y double")
    assert tiny.agg(moments.pearson(F.col("x"), F.col("y"), 1e-8)).first()[0] is None


def test_index_of_nothing(spark):
    df = spark.createDataFrame([(1.0, True), (-1.0, False)], "v double, a boolean")
    assert df.agg(moments.selectivity_index(F.col("v"), F.col("a"))).first()[0] is None


def test_quantize_is_half_even(spark):
    r = one(spark, a=scalars.quantize(F.lit(0.5 / 1024), 3), b=scalars.quantize(F.lit(1.5 / 1024), 3), c=scalars.quantize(F.lit(-2.5 / 1024), 3))
    assert tuple(r) == (0.0, 2 / 1024, -2 / 1024)


def test_names(spark):
    r = one(
        spark, n=scalars.first_integer(F.lit("elec12-u3")), none=scalars.first_integer(F.lit("x")), level=scalars.level_of(F.lit("Channel/7/a")), bank=scalars.bank_of(F.lit(33)), seed=scalars.session_seed(F.lit("abc")),
        stem=scalars.file_stem(F.lit(r"a\b/c.d.png")), parts=scalars.shared_prefix(scalars.path_parts(F.lit("a/b/c")), scalars.path_parts(F.lit(r"a\b\x"))), numbers=scalars.parse_number_list(F.lit("[12.5, 13] pix per degree")),
        same=scalars.shared_prefix(scalars.path_parts(F.lit("a/b")), scalars.path_parts(F.lit("a/b"))),
    )
    import hashlib

    assert tuple(r) == (12, None, "Channel", 1, int(hashlib.sha512(b"abc").hexdigest()[-8:], 16), "c.d", ["a", "b"], [12.5, 13.0], ["a", "b"])
    assert one(spark, a=scalars.nan_to_null(F.lit(float("nan"))), b=scalars.nan_to_null(F.lit(1.0))) == (None, 1.0)
    assert [one(spark, s=scalars.significance(F.lit(p))).s for p in (0.2, 0.05, 0.04, 0.005, 0.0001)] == ["n.s.", "n.s.", "p < .05", "p < .01", "p < .001"]


def test_statistics_by_name():
    with pytest.raises(ValueError, match="none of"):
        moments.statistic("exec", F.lit(1))


# -- series


def crossings_brute(xs, a, b, direction):
    good = [(x, p, q) for x, p, q in zip(xs, a, b, strict=True) if p is not None and q is not None]
    out = set()
    for (x0, p0, q0), (x1, p1, q1) in itertools.pairwise(good):
        was, now = q0 > p0, q1 > p1
        if was != now and (direction == "both" or now == (direction == "up")):
            out.add(x0 + (p0 - q0) * (x1 - x0) / ((q1 - p1) - (q0 - p0)))
    return sorted(out)


def test_crossings(spark):
    cases = {"none": ([0, 0, 0], [1, 2, 3]), "one": ([0, 0, 0], [-1, 1, 2]), "several": ([0] * 6, [-1, 1, -1, 3, -2, 2]), "bridged": ([0, None, 0], [-1, 5, 1]), "short": ([0], [1]), "flat": ([0, 0, 0, 0], [-1, 0, 0, 1])}
    data = [(k, float(x), None if p is None else float(p), float(q)) for k, (a, b) in cases.items() for x, (p, q) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(data, "k string, t double, y0 double, y1 double")
    for direction in ("up", "down", "both"):
        got = crossing.crossings(df, ["k"], direction).distinct().collect()
        for k, (a, b) in cases.items():
            assert sorted(r.t for r in got if r.k == k) == pytest.approx(crossings_brute([float(i) for i in range(len(a))], a, b, direction))
    found = {r.k: (r.t, r.clearance) for r in crossing.central_crossing(df, ["k"], "up", 2.0).collect()}
    assert set(found) == {"one", "several", "bridged", "flat"}
    assert found["one"] == (0.5, 0.5) and found["bridged"] == (1.0, 1.0)
    assert found["several"] == (2.25, pytest.approx(1.75))


def test_peak_is_the_first_largest(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 3.0), (2.0, float("nan")), (3.0, None)], "t double, y double").withColumn("k", F.lit(1))
    assert rows(crossing.peaks(df, ["k"])) == [(1, 0.0, 3.0)]


def test_runs(spark):
    df = spark.createDataFrame([(t, v) for t, v in enumerate([0, 1, 1, None, 1, 0, 1])], "t long, v int").withColumn("k", F.lit(1))
    assert rows(crossing.runs(df, ["k"], F.col("v") == 1), "start", "stop", "n") == [(1, 2, 2), (4, 4, 1), (6, 6, 1)]


def test_moving_average_edges_are_mirrored(spark):
    values = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "unit long, t long, n double")
    padded = values[1::-1] + values + values[:-3:-1]
    for width, before in ((4, 2), (3, 1), (1, 0)):
        got = [r[0] for r in align.moving_average(df, width).orderBy("t").select("rate").collect()]
        assert got == pytest.approx([sum(padded[2 + i - before : 2 + i - before + width]) / width for i in range(5)])


def test_window_means_are_range_sums(spark):
    rng = random.Random(3)
    series = sorted({(rng.randrange(2), rng.randrange(-20, 60)) for _ in range(60)})
    data = [(u, t, float(rng.randint(1, 5))) for u, t in series]
    ev = [(i, rng.randrange(3), rng.randrange(-30, 70)) for i in range(40)]
    got = {r.event: r.resp for r in align.window_means(spark.createDataFrame(ev, "event long, unit long, t long"), spark.createDataFrame(data, "unit long, t long, n double"), F.col("t") - 3, 7).collect()}
    assert got == {e: pytest.approx(sum(n for u, t, n in data if u == unit and at - 3 <= t < at + 4) / 7) for e, unit, at in ev}


def long_unit():
    """Unit 1 holds nine tenths of all bins, over many blocks of 16 and with a gap of some; unit 2 starts below 0."""
    rng = random.Random(5)
    data = {(1, t): float(rng.randint(0, 9)) for t in range(-100, 500) if not 120 <= t < 200 and rng.random() < 0.8}
    return data | {(2, t): float(rng.randint(0, 9)) for t in range(-40, 10)}


def test_long_units_are_dealt_by_blocks(spark):
    from pyspark.sql import types as T

    data = long_unit()
    series = spark.createDataFrame([(u, t, n) for (u, t), n in data.items()], T.StructType.fromDDL("unit long, t long, n double"))
    dense = align.densify(series, span=16)
    want = {(u, t): data.get((u, t), 0.0) for u in (1, 2) for t in range(min(t for v, t in data if v == u), max(t for v, t in data if v == u) + 1)}
    assert dense.schema["t"].dataType == T.LongType() and {(r.unit, r.t): r.n for r in dense.collect()} == want
    for width in (2, 5, 40):  # 40 reaches over blocks, and over one and a half of those asked for
        before, after, got = width // 2, width - width // 2 - 1, {}
        for r in align.moving_average(dense, width, span=16).collect():
            assert (r.unit, r.t) not in got
            got[r.unit, r.t] = r.rate
        for u in (1, 2):
            times = sorted(t for v, t in want if v == u)
            v = [want[u, t] for t in times]
            padded = v[:before][::-1] + v + (v[-after:][::-1] if after else [])
            assert [got[u, t] for t in times] == pytest.approx([sum(padded[i : i + width]) / width for i in range(len(v))])
        assert got.keys() == want.keys()
    marks = [(i, u, t) for i, (u, t) in enumerate((u, t) for u in (1, 2, 3) for t in range(-130, 540, 7))]
    events = spark.createDataFrame(marks, "event long, unit long, t long")
    found = {r.event: r.resp for r in align.window_means(events, series, F.col("t"), 33, span=16).collect()}
    assert found == {e: pytest.approx(sum(data.get((u, t), 0.0) for t in range(at, at + 33)) / 33) for e, u, at in marks}


def test_no_window_holds_a_whole_unit(spark):
    """Tasks see a unit's blocks, or a row for each: with 20 blocks no window over bins has more than a block's."""
    series = spark.range(20 * 1000).select(F.lit(1).cast("long").alias("unit"), F.col("id").alias("t"), F.lit(1).alias("n"))
    plan = align.moving_average(align.densify(series, span=1000), 12, span=1000)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "+- Window " in line or line.lstrip().startswith("Window ")]
    assert windows and all("_b#" in line for line in windows)
    made = align.densify(series, span=1000).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in made) == 20 * 1000


def test_sums_of_empty_and_null(spark):
    series = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (None, 1, 5.0)], "unit long, t long, n double")
    events = spark.createDataFrame([(0, 1, 0), (1, None, 0), (2, 9, 0), (3, 1, None)], "event long, unit long, t long")
    got = {r.event: r.resp for r in align.window_means(events, series, F.col("t"), 2).collect()}
    assert (got[0], got[1], got[2]) == (1.0, 2.5, 0.0) and got.keys() == {0, 1, 2, 3}
    assert align.window_means(events.limit(0), series, F.col("t"), 2).count() == 0
    assert {r.resp for r in align.window_means(events.where("t is not null"), series.limit(0), F.col("t"), 2).collect()} == {0.0}


def test_offsets_end_before_or_at_post(spark):
    assert one(spark, a=align.offsets(4, 4, 2), b=align.offsets(4, 4, 2, True)) == ([-4, -2, 0, 2], [-4, -2, 0, 2, 4])


# -- p-values, ranks, FDR


def p_of(spark, sample, nulls, f, alternative):
    df = spark.createDataFrame([(sample, n) for n in nulls], "s double, n double")
    return df.agg(f(F.col("s"), F.col("n"), alternative)).first()[0]


def test_p_values(spark):
    assert p_of(spark, 1.0, [0.0, 0.5, 1.0, 2.0], resample.p_value, "greater") == 0.5  # the tie counts toward p
    assert p_of(spark, 9.0, [0.0] * 9, resample.p_value, "greater") == 0.1  # the floor
    assert p_of(spark, 9.0, [None, None], resample.p_value, "greater") is None
    assert p_of(spark, -3.0, [1.0, 2.0, None, -4.0], resample.p_value, "two-sided") == pytest.approx(1 / 3)
    # the statistic is condition 1 - condition 0, so "greater" asks for condition 0
    assert p_of(spark, -1.0, [0.0] * 9, resample.p_value_difference, "greater") == 0.1
    assert p_of(spark, -1.0, [0.0] * 9, resample.p_value_difference, "less") == 1.0


def test_subsample_sizes():
    assert resample.subsample_sizes(5, 7, 10) == (5, 7)
    for n0, n1 in ((100, 3), (3, 100), (60, 70), (5000, 5000)):
        a, b = resample.subsample_sizes(n0, n1, 10)
        assert a + b <= 20 and 2 <= a <= n0 and 2 <= b <= n1


def test_subsample_sizes_shrink_with_the_square_root(spark):
    known = {(9000, 20000): (7878, 12122), (15000, 30000): (8165, 11835), (100000, 12000): (15370, 4630), (12000, 100000): (4630, 15370), (8000, 12000): (8000, 12000)}
    assert {sizes: resample.subsample_sizes(*sizes) for sizes in known} == known
    df = spark.createDataFrame(list(known), "a long, b long").select("a", "b", *resample.subsample_size_columns(F.col("a"), F.col("b")))
    assert {(r[0], r[1]): (r[2], r[3]) for r in df.collect()} == known
    pairs = spark.range(60).selectExpr("id i", "id + 1 j", "cast(id < 45 as int) cond")
    kept = resample.subsampled(pairs, ["i", "j"], "s", most=10)
    assert {r["cond"]: r["count"] for r in kept.groupBy("cond").count().collect()} == dict(zip((0, 1), resample.subsample_sizes(15, 45, 10), strict=True))


def brute_r(x, y):
    ok = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    if len(ok) < 2 or len({a for a, _ in ok}) < 2 or len({b for _, b in ok}) < 2:
        return None
    return float(np.corrcoef(np.array(ok).T)[0, 1])


def drawn(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def test_pair_tests_against_brute_force(spark, monkeypatch):
    """Blocks of units and replicates change nothing; units may lack events, have nulls or no variance."""
    monkeypatch.setattr(resample, "UNITS_PER_BLOCK", 2)
    rng = random.Random(3)
    n = 12
    ij = [(rng.randrange(9), 9 + rng.randrange(9)) for _ in range(n)]
    resp = {(u, e): 1.0 if u == "flat" else rng.random() for u in ("a", "b", "c", "d", "flat") for e in range(18)}
    resp["b", ij[0][0]] = None
    del resp["c", ij[1][1]]
    pairs = spark.createDataFrame([(k, n, i, j, k % 3 % 2, k // 2) for k, (i, j) in enumerate(ij)], "k int, n long, i long, j long, cond int, couple int")
    events = spark.createDataFrame([(e, u, v) for (u, e), v in resp.items()], "event long, unit string, resp double")

    def sides(u, ks, coins):
        events_of = [[(u, e) for e in ij[k]] for k in ks]  # a unit without one of the events lacks the pair
        both = [tuple(resp[e] for e in pair) if all(e in resp for e in pair) else (None, None) for pair in events_of]
        turned = [(b, a) if c else (a, b) for (a, b), c in zip(both, coins, strict=True)]
        return [t[0] for t in turned], [t[1] for t in turned]

    def p_of(sample, nulls, beyond):
        ok = [v for v in nulls if v is not None and sample is not None]
        return max(1 - sum(beyond(sample, v) for v in ok) / len(ok), 1 / (1 + len(ok))) if ok else None

    got = {r.unit: r for r in resample.self_consistency(pairs, events, 7, 9, "s").collect()}
    for u in ("a", "b", "c", "d", "flat"):
        r = brute_r(*sides(u, range(n), [drawn("s-side", k) % 2 for k in range(n)]))
        boots = [brute_r(*sides(u, [drawn("s-boot", b, k) % n for k in range(n)], [drawn("s-boot-side", b, k) % 2 for k in range(n)])) for b in range(7)]
        nulls = []
        for b in range(9):
            x, y = sides(u, range(n), [drawn("s-perm-side", b, k) % 2 for k in range(n)])
            rank = {k: at for at, k in enumerate(sorted(range(n), key=lambda k: (drawn("s-perm", b, k), k)))}
            nulls.append(brute_r(x, [y[rank[k]] for k in range(n)]))
        found = [v for v in boots if v is not None]
        assert got[u].n == (n - sum(ij[k][1] == ij[1][1] for k in range(n)) if u == "c" else n)
        assert got[u].r == pytest.approx(r)
        assert got[u].boot_mean == (pytest.approx(np.mean(found)) if found else None)
        assert got[u].boot_sd == (pytest.approx(np.std(found)) if found else None)
        assert got[u].p == pytest.approx(p_of(r, nulls, lambda s, v: s > v))

    for paired in (False, True):
        got = {r.unit: r for r in resample.two_condition_test(pairs, events, 9, "t", paired=paired).collect()}
        cond = [k % 3 % 2 for k in range(n)]
        for u in ("a", "b", "c", "d", "flat"):
            of = lambda label, c, x, y: brute_r([v if g == c else None for v, g in zip(x, label, strict=True)], [v if g == c else None for v, g in zip(y, label, strict=True)])
            x, y = sides(u, range(n), [drawn("t-side", k) % 2 for k in range(n)])
            r0, r1 = of(cond, 0, x, y), of(cond, 1, x, y)
            nulls = []
            for b in range(9):
                if paired:
                    label = [1 - c if drawn("t-swap", b, k // 2) % 2 else c for k, c in enumerate(cond)]
                else:
                    first = sorted(range(n), key=lambda k: (drawn("t-label", b, k), k))[: cond.count(0)]
                    label = [0 if k in first else 1 for k in range(n)]
                x, y = sides(u, range(n), [drawn("t-label-side", b, k) % 2 for k in range(n)])
                a, c = of(label, 0, x, y), of(label, 1, x, y)
                nulls.append(None if a is None or c is None else c - a)
            assert (got[u].r0, got[u].r1) == (pytest.approx(r0), pytest.approx(r1))
            assert got[u].p == pytest.approx(p_of(None if r0 is None or r1 is None else r1 - r0, nulls, lambda s, v: abs(s) > abs(v)))


def test_rank_tests_against_brute_force(spark):
    rng = random.Random(4)
    a, b = [rng.randrange(6) for _ in range(12)], [rng.randrange(8) for _ in range(9)]
    df = spark.createDataFrame([(1, float(v), True) for v in a] + [(1, float(v), False) for v in b], "k int, v double, f boolean")
    r = stat.rank_sum(df, F.col("v"), F.col("f"), ["k"]).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = [(a + b).count(v) for v in set(a + b)]
    n = len(a + b)
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - sum(t**3 - t for t in ties) / (n * (n - 1))))
    assert r.u == u and r.z == pytest.approx((u - len(a) * len(b) / 2) / sd)
    exact = spark.createDataFrame([(1, float(v), v in (1, 2, 5)) for v in range(1, 8)], "k int, v double, f boolean")
    got = stat.rank_sum_p(stat.rank_sum(exact, F.col("v"), F.col("f"), ["k"])).first()
    us = [sum(x > y for x in c for y in range(1, 8) if y not in c) for c in itertools.combinations(range(1, 8), 3)]
    assert got.p == pytest.approx(min(1, 2 * sum(v >= max(got.u, 12 - got.u) for v in us) / len(us)))
    d = spark.createDataFrame([(1, v) for v in (0.0, 1.0, -1.0, 2.0, 3.0, None)] + [(2, 0.0), (3, 1.0)], "k int, d double")
    s = stat.signed_rank(d, F.col("d"), ["k"]).collect()
    assert [(x.k, x.n, x.w) for x in s] == [(1, 4, 8.5)]
    assert s[0].z == pytest.approx((8.5 - 5) / math.sqrt(4 * 5 * 9 / 24 - 6 / 48))


def test_normal_tail(spark):
    zs = [-40.0, -8.0, -3.3, 6.5, -1e-9, 0.0, 0.5, 1.96, 7.0, 7.08, 12.0, 37.0, 38.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stat.normal_tail(F.col("z")))
    for z, p in df.collect():
        assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-8 if z > 6 else 1e-12, abs=1e-300)


def test_exact_rank_tests(spark):
    """Every alternative against all orders and all signs; a sample of few beside one of many stays exact."""
    first = (1, 4, 6)
    df = spark.createDataFrame([(1, float(v), v in first) for v in range(1, 9)], "k int, v double, f boolean")
    tested = stat.rank_sum(df, F.col("v"), F.col("f"), ["k"])
    u_of = lambda c: sum(x > y for x in c for y in range(1, 9) if y not in c)
    us, u = [u_of(c) for c in itertools.combinations(range(1, 9), 3)], u_of(first)
    want = {"greater": sum(v >= u for v in us) / len(us), "less": sum(v <= u for v in us) / len(us)}
    want["two-sided"] = min(1, 2 * min(want.values()))
    for alternative, p in want.items():
        assert stat.rank_sum_p(tested, alternative).first().p == pytest.approx(p)
    normal = stat.rank_sum_p(tested, "greater", exact_up_to=2).first()
    assert normal.p == pytest.approx(0.5 * math.erfc((u - 7.5 - 0.5) / math.sqrt(15 / 12 * 9) / math.sqrt(2)))
    assert stat._u_tail(2, 20_000)[-1] == pytest.approx(1 / math.comb(20_002, 2)) and stat._u_tail(20_000, 2)[0] == 1
    tied = spark.createDataFrame([(1, 2.0, i < 3) for i in range(7)], "k int, v double, f boolean")
    assert stat.rank_sum_p(stat.rank_sum(tied, F.col("v"), F.col("f"), ["k"])).first().p is None
    d = [0.5, -1.5, 2.5, 3.5, -4.5, 5.5, 6.5]
    signed = stat.signed_rank(spark.createDataFrame([(1, v) for v in d] + [(2, v) for v in [0.0, *d]], "k int, d double"), F.col("d"), ["k"])
    ws, w = [sum(i for i, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=7)], 1 + 3 + 4 + 6 + 7
    want = {"greater": sum(v >= w for v in ws) / len(ws), "less": sum(v <= w for v in ws) / len(ws)}
    want["two-sided"] = min(1, 2 * min(want.values()))
    for alternative, p in want.items():
        got = {r.k: r for r in stat.signed_rank_p(signed, alternative).collect()}
        assert got[1].p == pytest.approx(p) and got[1].w == got[2].w == w
        z = (w - 14) / math.sqrt(7 * 8 * 15 / 24)
        assert got[2].p == pytest.approx({"greater": 0.5 * math.erfc(z / 2**0.5), "less": 0.5 * math.erfc(-z / 2**0.5), "two-sided": math.erfc(abs(z) / 2**0.5)}[alternative])


def bky(ps, q):
    level, m = q / (1 + q), len(ps)
    bh = lambda level: max([k for k, p in enumerate(sorted(ps), 1) if p <= level * k / m], default=0)
    r1 = bh(level)
    if r1 in (0, m):
        return r1
    return bh(level * m / (m - r1))


@pytest.mark.parametrize("seed", range(4))
def test_fdr(spark, monkeypatch, seed):
    rng = random.Random(seed)
    ps = [rng.random() ** rng.choice([1, 5]) * (0.001 if rng.random() < 0.3 else 1) for _ in range(60)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*ps, None, float("nan")])], "i long, p double")
    got = stat.fdr_two_stage(df, 0.05)
    assert got.count() == 62 and got.where("i >= 60 and reject").count() == 0
    assert {r.i for r in got.where("reject").collect()} == {ps.index(p) for p in sorted(ps)[: bky(ps, 0.05)]}
    # adjusted p-values, in one scope and in a scope of its own
    monkeypatch.setattr(stat, "RANKS_PER_BLOCK", 7)
    n, order = len(ps), sorted(range(len(ps)), key=lambda i: ps[i])
    r1 = max([k for k, i in enumerate(order, 1) if ps[i] <= 0.05 / 1.05 * k / n], default=0)
    share = (n - r1) / n if 0 < r1 < n else 1
    for out in (stat.fdr_two_stage(df, 0.05), stat.fdr_two_stage(df.withColumn("s", F.lit(1)), 0.05, ("s",))):
        by = {r.i: r for r in out.collect()}
        for place, i in enumerate(order):
            step_up = min(1, min(ps[j] * n / (k + 1) for k, j in enumerate(order) if k >= place))
            assert by[i].p_adj == pytest.approx(min(1, step_up * share * 1.05))
            assert by[i].reject == (by[i].p_adj <= 0.05)
        assert by[n].p_adj is None and by[n + 1].p_adj is None


def test_fdr_of_nothing_and_of_all(spark):
    assert stat.fdr_two_stage(spark.createDataFrame([], "p double")).count() == 0
    assert stat.fdr_two_stage(spark.createDataFrame([(1e-9,)] * 5, "p double")).where("reject").count() == 5


# -- groups


def test_groups_of_one_are_left_out_and_equal_ones_merged(spark):
    df = spark.createDataFrame([(1, "c1", "b1", "a1", 1.0), (2, "c1", "b1", "a1", 3.0), (3, "c2", "b2", "a1", 8.0)], "unit long, channel string, bank string, array string, v double")
    got = rows(aggregates.group_statistics(df, ["channel", "bank", "array"], "v"), "names", "members", "v")
    assert got == [(["array/a1"], 3, 4.0), (["bank/b1", "channel/c1"], 2, 2.0)]
    assert rows(aggregates.group_statistics(df, ["array"], "v", "max"), "v") == [(8.0,)]


def test_first_hit(spark):
    units = spark.createDataFrame([("u1", "c1", "a1"), ("u2", "c1", "a1"), ("u3", "c3", "a1"), ("u4", "c4", "a4")], "unit string, channel string, arr string")
    known = spark.createDataFrame([("unit", "u1", 1.0), ("channel", "c1", 2.0), ("array", "a1", 3.0)], "level string, key string, v double")
    got = hierarchy.first_hit(units, known, [("unit", F.col("unit")), ("channel", F.col("channel")), ("array", F.col("arr"))])
    assert rows(got, "unit", "level", "v") == [("u1", "unit", 1.0), ("u2", "channel", 2.0), ("u3", "array", 3.0)]


def test_every_unit_is_imputed(spark):
    units = spark.createDataFrame([("s", "u1", "c1", "a1"), ("s", "u2", "c2", "a2"), ("s", "u3", "c3", "a3")], "session string, unit string, channel string, array_id string")
    measured = spark.createDataFrame([("s", "unit", "u1", 52.4), ("r", "array_id", "a2", 87.6)], "session string, level string, key string, lat double")
    got = rows(hierarchy.impute(units, measured, ["lat"], 5.0, {"lat": 60.0}), "unit", "lat", "source")
    assert got == [("u1", 50.0, "unit"), ("u2", 90.0, "any_session"), ("u3", 60.0, "default")]


def test_cdf_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (20.0,), (21.0,)], "v double").withColumn("k", F.lit(1))
    assert rows(aggregates.cdf(df, "v", ["k"], 0.0, 20.0, 10.0), "bin", "share") == [(0, 0.5), (1, 1.0)]


def test_scalings_of_constants(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0)], "k int, v double")
    assert rows(aggregates.standardize(df, "v", ["k"]), "z") == [(0.0,), (0.0,)]
    assert rows(aggregates.percentile_scaled(df, "v", ["k"]), "scaled") == [(0.0,), (0.0,)]
    assert rows(aggregates.min_max_scaled(df, "v", ["k"], F.lit(True)), "scaled") == [(None,), (None,)]


def test_test_order_turns_the_alternative():
    t = summary.StatTest("b", "a", "greater").ordered(["a", "b"])
    assert (t.cond0, t.cond1, t.alternative) == ("a", "b", "less")
    assert summary.StatTest("a", "b", "both").ordered(["a", "b"]).name == "a-b"


def test_unit_selection(spark):
    df = spark.createDataFrame([(i, "r", "big" if i < 40 else "mid" if i < 60 else "rare", None if i == 0 else float("nan") if i == 1 else 1.0) for i in range(61)], "unit long, region string, subject string, v double")
    got = summary.select_units(df, df.where("unit <> 5"), ["v"], 0.1)
    assert {r.unit for r in got.collect()} == set(range(60)) - {0, 1, 5}


def test_draws_are_uniform(spark):
    x = np.array([r[0] for r in spark.range(4000).select(scalars.draw("s", F.col("id"))).collect()]) / 2**32
    assert abs(x.mean() - 0.5) < 0.02 and 0 <= x.min() and x.max() < 1


def test_only_responses_of_paired_events_are_shuffled(spark):
    responses = spark.range(1000).selectExpr("id as event", "stack(2, 'a', id, 'b', -id) as (unit, resp)")
    pairs = spark.createDataFrame([(0, 2, 5, 7), (1, 2, 900, 5)], "k long, n long, i long, j long")
    values = resample.unit_values(pairs, responses)
    assert sorted((r.k, r.unit, r.a, r.b) for r in values.collect()) == [(0, "a", 5.0, 7.0), (0, "b", -5.0, -7.0), (1, "a", 900.0, 5.0), (1, "b", -900.0, -5.0)]
    assert values._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2  # once for each side


def test_criteria_hold_on_their_border_up_to_rounding(spark):
    rows = spark.createDataFrame([(1.0, 100.0, 0.0, 2.0, 1.0, 0.0, 1.0, 99.99999999999999), (1.0, 100.0, 0.0, 2.0, 1.0, 24.999999999999996, 24.999999999999996, 100.0)], "t double, clearance double, peak0 double, peak1 double, valid double, bias double, sd double, mean_clearance double")
    accepted, report = crossing.acceptable_latency(rows)
    assert accepted.count() == 1 and report.first().asDict() == dict(finite=2, clear=2, between_peaks=2, valid=2, unbiased=1, precise=1, clear_boots=2, total=2)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [None, None], [3.0] * 50 + [9.0], [float(k * k % 101) for k in range(400)] + [None]])
def test_quantiles_are_those_of_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in (0.025, 0.5, 0.975)]))).first()[0] or [None] * 3
    assert events.exact_quantiles(df, "v", [0.025, 0.5, 0.975]) == want


def test_cells_of_masks_are_never_broadcast(spark):
    from tessella.operators import space

    rows = spark.createDataFrame([(1, 0.5, 0.5), (1, 5.0, 5.0), (2, 0.5, 0.5)], "image long, x double, y double")
    boxes = spark.createDataFrame([(2, 0.0, 0.0, 1.0, 1.0)], "image long, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(1, 0, 0, 3)], "image long, px long, py long, component int")
    got = space.roi_hits(rows, boxes, cells)
    assert sorted(((r.image, r.x, r.hit, r.component) for r in got.collect())) == [(1, 0.5, True, 3), (1, 5.0, False, None), (2, 0.5, True, 0)]
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2


def test_cells_are_shuffled_once_to_tasks_by_their_number(spark, monkeypatch):
    from tessella.operators import space

    monkeypatch.setattr(space, "CELLS", 10)
    cells = spark.range(1000).selectExpr("id % 7 as image", "id % 20 as px", "id % 3 as py")
    plan = space.cell_runs(cells, 1, ["image"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(image" in plan and ", 100)" in plan
