"""Event cleaning queries."""

from pyspark.sql import functions as F

from tessella.functions.scalars import quantize
from tessella.operators import aggregates as ag
from tessella.operators import events as ev
from tessella.plans.registry import query
from tessella.plans.views import EV, FIX, PRES, events, fixations, presentations

LENGTH, WIDTH, HEIGHT = 60, 100.0, 20.0

#: The cleaned table: overlap, clip, relative coordinates, durations, ordinals, neighbours.
CLEAN = f"""{FIX}, {PRES},
met AS (SELECT f.*, p.onset, p."offset", p.px, p.py, p.customer FROM fix f JOIN pres p USING (trial) WHERE f.t1 > p.onset AND f.t0 <= p."offset" + 2000),
clean AS (
  SELECT trial, fix_id, image, x, y, customer, greatest(t0, onset) AS t0, t1, onset, t0 <= onset AS zeroth, x - px AS rx, y - py AS ry,
         t1 - greatest(t0, onset) AS duration, greatest(greatest(t0, onset) - onset, 0) AS trial_time FROM met),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trial ORDER BY t0, fix_id) - max(CAST(zeroth AS INT)) OVER (PARTITION BY trial) AS ord FROM clean)"""


def cleaned(spark, sf_dir):
    shown = presentations(spark, sf_dir).withColumn("offset", F.col("offset") + 2000)
    met = ev.overlapping(fixations(spark, sf_dir), shown)
    return ev.ordinals(ev.durations(ev.relative_position(ev.clip_to_onset(met))))


@query(f"WITH {FIX}, {PRES} SELECT trial, fix_id, greatest(t0, onset) AS t0, t1, t0 <= onset AS zeroth, x - px AS rx, y - py AS ry, t1 - greatest(t0, onset) AS duration FROM fix JOIN pres USING (trial) WHERE t1 > onset AND t0 <= \"offset\"")
def event_overlap_clip(spark, sf_dir):
    met = ev.overlapping(fixations(spark, sf_dir), presentations(spark, sf_dir))
    out = ev.durations(ev.relative_position(ev.clip_to_onset(met)))
    return out.select("trial", "fix_id", "t0", "t1", "zeroth", "rx", "ry", "duration")


@query(f"WITH {CLEAN} SELECT trial, fix_id, CAST(ord AS BIGINT) AS ord, trial_time, lag(fix_id) OVER w AS prev_id, lead(fix_id) OVER w AS next_id FROM ranked WINDOW w AS (PARTITION BY trial ORDER BY ord, fix_id)")
def ordinal_prev_next(spark, sf_dir):
    out = ev.with_neighbours(cleaned(spark, sf_dir))
    return out.select("trial", "fix_id", F.col("ord").cast("long").alias("ord"), "trial_time", "prev_id", "next_id")


SELECTED = "duration >= 3 AND trial_time >= 5 AND trial_time + duration <= 2055 AND greatest(greatest(rx - 50, -50 - rx), greatest(ry - 10, -10 - ry)) < 0"


def selected(spark, sf_dir):
    return ev.select_events(cleaned(spark, sf_dir), LENGTH + 2000, 3, 5, WIDTH, HEIGHT)


@query(f"WITH {CLEAN} SELECT trial, fix_id, ord, rx, ry FROM ranked WHERE {SELECTED}")
def event_selection(spark, sf_dir):
    return selected(spark, sf_dir).select("trial", "fix_id", "ord", "rx", "ry")


@query(f"WITH {CLEAN} SELECT ord = 0 AS is_zeroth, count(*) AS n, round(avg(duration), 6) AS mean_duration FROM ranked GROUP BY 1")
def zeroth_selector(spark, sf_dir):
    all_ = cleaned(spark, sf_dir)
    parts = [ev.by_ordinal(all_, w).withColumn("is_zeroth", F.lit(w == "zeroth")) for w in ("zeroth", "nonzeroth")]
    return parts[0].unionByName(parts[1]).groupBy("is_zeroth").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("mean_duration"))


MOVES = f"""{CLEAN},
moved AS (
  SELECT trial, fix_id AS to_id, ord AS to_ord, t0 AS to_start, lag(fix_id) OVER w AS from_id, lag(ord) OVER w AS from_ord, lag(t1) OVER w AS from_end,
         x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy
  FROM ranked WHERE {SELECTED} WINDOW w AS (PARTITION BY trial ORDER BY ord, fix_id)),
moves AS (SELECT *, sqrt(dx * dx + dy * dy) AS size FROM moved WHERE from_ord = to_ord - 1)"""


def moves_of(spark, sf_dir):
    return ev.transitions(selected(spark, sf_dir))


@query(f"WITH {MOVES} SELECT trial, from_id, to_id, round(size, 6) AS size FROM moves")
def transition_sizes(spark, sf_dir):
    return moves_of(spark, sf_dir).select("trial", "from_id", "to_id", F.round("size", 6).alias("size"))


@query(f"""WITH {MOVES}, big AS (SELECT * FROM moves WHERE size >= 4),
b AS (SELECT m.trial, m.to_id, e.x, e.y FROM big m JOIN ranked e ON e.trial = m.trial AND e.ord < m.to_ord - 1 AND e.t1 > m.from_end - 100),
a AS (SELECT m.trial, m.to_id, e.x, e.y FROM big m JOIN ranked e ON e.trial = m.trial AND e.ord > m.to_ord AND e.t0 <= m.to_start + 100),
s AS (SELECT b.trial, b.to_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS least FROM b JOIN a ON a.trial = b.trial AND a.to_id = b.to_id GROUP BY ALL)
SELECT m.trial, m.from_id, m.to_id, round(m.size, 6) AS size, round(coalesce(least, m.size), 6) AS separation
FROM big m LEFT JOIN s ON s.trial = m.trial AND s.to_id = m.to_id WHERE coalesce(least, m.size) >= 4""")
def large_transitions(spark, sf_dir):
    big = ev.separations(ev.large(moves_of(spark, sf_dir)), cleaned(spark, sf_dir), 100)
    return big.where("separation >= 4").select("trial", "from_id", "to_id", F.round("size", 6).alias("size"), F.round("separation", 6).alias("separation"))


@query(f"WITH {CLEAN} SELECT trial, fix_id, CAST(t0 - lag(t1) OVER w AS BIGINT) AS gap, round(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 6) AS size FROM ranked WHERE ord <> 0 WINDOW w AS (PARTITION BY trial ORDER BY ord, fix_id)")
def movement_stats(spark, sf_dir):
    """Duration of the movement before an event, and its size; zeroth events are left out."""
    from pyspark.sql.window import Window

    from tessella.functions.scalars import distance

    rows, w = ev.by_ordinal(cleaned(spark, sf_dir), "nonzeroth"), Window.partitionBy("trial").orderBy("ord", "fix_id")
    size = distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))
    return rows.select("trial", "fix_id", (F.col("t0") - F.lag("t1").over(w)).alias("gap"), F.round(size, 6).alias("size"))


@query(f"""WITH {EV}, gaps AS (SELECT event_id, unit, lead(t) OVER (PARTITION BY unit ORDER BY t, event_id) - t AS gap FROM ev),
c AS (SELECT round_even(gap / 5.0, 0) * 5 AS bin, count(*) AS n FROM gaps WHERE gap IS NOT NULL AND round_even(gap / 5.0, 0) * 5 > 2 GROUP BY 1),
m AS (SELECT round_even(avg(bin) / 5, 0) * 5 AS modal FROM c WHERE n = (SELECT max(n) FROM c))
SELECT event_id, unit, gap, modal FROM gaps, m WHERE round_even(gap / 5.0, 0) * 5 = modal""")
def modal_gap_filter(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("unit").orderBy("t", "event_id")
    gaps = events(spark, sf_dir).select("event_id", "unit", (F.lead("t").over(w) - F.col("t")).alias("gap"))
    return ev.at_modal_value(gaps, F.col("gap"), 5.0, 2.0)


@query(f"WITH {FIX}, q AS (SELECT quantile_cont(price, 0.025) AS a, quantile_cont(price, 0.975) AS b FROM fix), lim AS (SELECT greatest(a - (b - a) * 0.1, 0.0) AS lo, b + (b - a) * 0.1 AS hi FROM q) SELECT count(*) AS n, round(sum(price) / 1000, 2) AS total FROM fix, lim WHERE price BETWEEN lo AND hi")
def outlier_clip(spark, sf_dir):
    rows = fixations(spark, sf_dir)
    met = rows.crossJoin(F.broadcast(ev.outlier_bounds(rows, "price"))).where("price between lo and hi")
    return met.agg(F.count("*").alias("n"), F.round(F.sum("price") / 1000, 2).alias("total"))


@query(f"""WITH {FIX}, r AS (SELECT image, fix_id, count(*) OVER (PARTITION BY image) AS n, row_number() OVER (PARTITION BY image ORDER BY price, fix_id) - 1 AS place FROM fix)
SELECT image, fix_id FROM r WHERE list_contains(list_transform(range(0, 7), lambda i: CAST(round_even(i / 6.0 * (n - 1), 0) AS BIGINT)), place)""")
def evenly_spaced_sample(spark, sf_dir):
    return ev.evenly_spaced(fixations(spark, sf_dir), 7, "image", ("price", "fix_id")).select("image", "fix_id")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(l_extendedprice / 1000 * l_tax * 1024, 0) / 1024 AS DOUBLE) AS q FROM lineitem")
def quantize_3dp(spark, sf_dir):
    from tessella.plans.views import table

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", quantize(F.col("l_extendedprice") / 1000 * F.col("l_tax"), 3).alias("q"))


@query(f"""WITH {EV}, s AS (SELECT *, lead(event_type) OVER w AS e1, lead(event_type, 2) OVER w AS e2 FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t, event_id))
SELECT unit, event_id, t FROM s WHERE event_type = 'view' AND e1 = 'click' AND e2 = 'purchase'""")
def header_sequence(spark, sf_dir):
    return ev.sequence_starts(events(spark, sf_dir), ["view", "click", "purchase"], "event_type", "unit", ("t", "event_id")).select("unit", "event_id", "t")


@query(f"""WITH {EV}, tr AS (SELECT unit AS trial, CAST(floor(t / 24) AS BIGINT) AS d, min(t) AS s, max(t) AS e FROM ev GROUP BY ALL),
er AS (SELECT unit AS trial, t FROM ev WHERE event_type = 'error')
SELECT tr.trial, d, s AS "start", e AS "end" FROM tr WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.trial = tr.trial AND er.t >= s - 2 AND er.t <= e + 2)""")
def trials_without_event(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("unit", "trial")
    tr = e.groupBy("trial", F.floor(F.col("t") / 24).alias("d")).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return ev.trials_with_event(tr, e, "error", 2).where("n_found = 0").drop("n_found")


@query(f"WITH {FIX} SELECT trial, count(DISTINCT b) AS n_bins FROM (SELECT trial, unnest(range(t0, t1)) AS b FROM fix) GROUP BY trial")
def interval_mask(spark, sf_dir):
    return ev.covered_bins(fixations(spark, sf_dir)).groupBy("trial").agg(F.count("*").alias("n_bins"))


@query(f"""WITH {EV}, h AS (SELECT (min(t) + max(t)) / 2.0 AS mid FROM ev),
r AS (SELECT unit, avg(CASE WHEN t >= mid THEN value END) AS late, avg(value) AS whole FROM ev, h GROUP BY unit)
SELECT unit, round(late / nullif(whole, 0), 6) AS ratio FROM r WHERE late <> 0 AND abs(late / nullif(whole, 0) - 1) <= 0.5""")
def stable_units(spark, sf_dir):
    return ag.stable_units(events(spark, sf_dir), "unit", "t", "value").withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {FIX}, {PRES}, rig(session, rig, tracker) AS (VALUES (0, 'A', 'x'), (1, 'A', 'y'), (2, 'B', 'x')), lat(rig, tracker, latency) AS (VALUES ('A', 'x', 5.0), ('A', 'y', 9.0), ('B', 'x', 12.0))
SELECT fix_id, session, round(t0 - latency / 1000, 6) AS t0, round(t1 - latency / 1000, 6) AS t1 FROM (SELECT *, fix_id % 3 AS session FROM fix) JOIN rig USING (session) JOIN lat USING (rig, tracker)""")
def latency_shift(spark, sf_dir):
    rigs = spark.createDataFrame([(0, "A", "x"), (1, "A", "y"), (2, "B", "x")], "session long, rig string, tracker string")
    lat = spark.createDataFrame([("A", "x", 5.0), ("A", "y", 9.0), ("B", "x", 12.0)], "rig string, tracker string, latency double")
    f = fixations(spark, sf_dir).withColumn("session", F.col("fix_id") % 3)
    out = ev.shift_by_latency(f, rigs, lat)
    return out.select("fix_id", "session", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))
