"""Aligned windows, crossings and peaks."""

from pyspark.sql import functions as F

from tessella.operators import align as al
from tessella.operators import crossing as cr
from tessella.plans.registry import query
from tessella.plans.views import EV, events

BINS = f"""{EV}, sr AS (SELECT unit, t, count(*) AS n FROM ev GROUP BY ALL),
sp AS (SELECT unit, min(t) AS lo, max(t) AS hi FROM sr GROUP BY unit),
dn AS (SELECT e.unit, e.t, coalesce(n, 0) AS n, lo, hi FROM (SELECT unit, unnest(range(lo, hi + 1)) AS t, lo, hi FROM sp) e LEFT JOIN sr ON sr.unit = e.unit AND sr.t = e.t)"""


def series(spark, sf_dir):
    return events(spark, sf_dir).groupBy("unit", "t").agg(F.count("*").alias("n"))


def errors(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("event"), "unit", "t")


@query(f"""WITH {BINS}, pad AS (SELECT unit, t, n, lo, hi FROM dn UNION ALL SELECT unit, 2 * lo - t - 1, n, lo, hi FROM dn WHERE t < lo + 6 UNION ALL SELECT unit, 2 * hi - t + 1, n, lo, hi FROM dn WHERE t > hi - 5),
ma AS (SELECT unit, t, lo, hi, avg(n) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN 6 PRECEDING AND 5 FOLLOWING) * 24 AS rate FROM pad)
SELECT unit, t, round(rate, 6) AS rate FROM ma WHERE t BETWEEN lo AND hi""")
def moving_average_rate(spark, sf_dir):
    out = al.moving_average(al.densify(series(spark, sf_dir)), 12, scale=24.0)
    return out.select("unit", "t", F.round("rate", 6).alias("rate"))


@query(f"""WITH {BINS}, er AS (SELECT event_id AS event, unit, t FROM ev WHERE event_type = 'error')
SELECT event, er.unit, off, coalesce(n, 0) AS resp FROM (SELECT *, unnest(range(-8, 12, 4)) AS off FROM er) er LEFT JOIN sr ON sr.unit = er.unit AND sr.t = er.t + off""")
def sliding_gather(spark, sf_dir):
    return al.gather(errors(spark, sf_dir), series(spark, sf_dir), al.offsets(8, 12, 4), F.col("t"))


@query(f"""WITH {BINS}, er AS (SELECT event_id AS event, unit, t FROM ev WHERE event_type = 'error')
SELECT event, er.unit, round(coalesce(sum(n), 0) / 24.0, 6) AS resp FROM er LEFT JOIN sr ON sr.unit = er.unit AND sr.t >= er.t - 12 AND sr.t < er.t + 12 GROUP BY ALL""")
def aligned_window_mean(spark, sf_dir):
    out = al.window_means(errors(spark, sf_dir), series(spark, sf_dir), F.col("t") - 12, 24)
    return out.withColumn("resp", F.round("resp", 6))


@query(f"""WITH {BINS}, er AS (SELECT event_id AS event, unit, t + greatest(unit % 60, 40) AS s FROM ev WHERE event_type = 'error')
SELECT event, er.unit, round(coalesce(sum(n), 0) / 30.0, 6) AS resp FROM er LEFT JOIN sr ON sr.unit = er.unit AND sr.t >= s AND sr.t < s + 30 GROUP BY ALL""")
def latency_window_mean(spark, sf_dir):
    s = series(spark, sf_dir)
    lat = s.select("unit").distinct().withColumn("latency", F.col("unit") % 60)
    return al.latency_window_means(errors(spark, sf_dir), s, lat, 30).withColumn("resp", F.round("resp", 6))


@query(f"""WITH {BINS}, er AS (SELECT event_id AS event, unit, t, unnest([-20, 0, 20]) AS off FROM ev WHERE event_type = 'error')
SELECT event, er.unit, off, round(coalesce(sum(n), 0) / 20.0, 6) AS resp FROM er LEFT JOIN sr ON sr.unit = er.unit AND sr.t >= er.t + off - 10 AND sr.t < er.t + off + 10 GROUP BY ALL""")
def binned_response(spark, sf_dir):
    return al.binned_response(errors(spark, sf_dir), series(spark, sf_dir), [-20, 0, 20], 20).withColumn("resp", F.round("resp", 6))


@query(f"""WITH {BINS}, er AS (SELECT unit, t, unnest(range(-5, 5)) AS off FROM ev WHERE event_type = 'error')
SELECT er.unit, off, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM er LEFT JOIN sr ON sr.unit = er.unit AND sr.t = er.t + off GROUP BY ALL""")
def peri_event_histogram(spark, sf_dir):
    return al.peri_event_histogram(errors(spark, sf_dir), series(spark, sf_dir), 5, 5)


@query(f"WITH {EV} SELECT unit, arg_min(t, (abs(t - 473520), t)) AS t FROM ev GROUP BY unit")
def nearest_bin(spark, sf_dir):
    return al.nearest_to(events(spark, sf_dir), ["unit"], "t", 473520.0)


#: Two series for each unit: daily means of early and late event kinds.
TWO = f"""{EV}, two AS (SELECT unit, CAST(floor(t / 24) AS BIGINT) - 19738 AS t, avg(CASE WHEN event_type IN ('view', 'click') THEN value END) AS y0, avg(CASE WHEN event_type NOT IN ('view', 'click') THEN value END) AS y1 FROM ev GROUP BY ALL),
gd AS (SELECT * FROM two WHERE y0 IS NOT NULL AND y1 IS NOT NULL)"""
CROSSED = """lg AS (SELECT unit, t, y0, y1, y1 > y0 AS up, lag(y1 > y0) OVER w AS was, y1 - y0 AS d, lag(y1 - y0) OVER w AS d0, lag(t) OVER w AS x0 FROM gd WINDOW w AS (PARTITION BY unit ORDER BY t)),
cx AS (SELECT DISTINCT unit, x0 + (-d0 * (t - x0)) / nullif(d - d0, 0) AS t FROM lg WHERE NOT was AND up),
eg AS (SELECT unit, min(t) AS lo, max(t) AS hi, count(*) AS n FROM gd GROUP BY unit),
cl AS (SELECT cx.unit, cx.t, coalesce(least(cx.t - lag(cx.t) OVER w, lead(cx.t) OVER w - cx.t), least(cx.t - lo, hi - cx.t)) AS clearance FROM cx JOIN eg USING (unit) WHERE n >= 2 WINDOW w AS (PARTITION BY cx.unit ORDER BY cx.t))"""


def two_series(spark, sf_dir):
    early = F.col("event_type").isin("view", "click")
    e = events(spark, sf_dir)
    return e.groupBy("unit", (F.floor(F.col("t") / 24) - 19738).alias("t")).agg(F.avg(F.when(early, F.col("value"))).alias("y0"), F.avg(F.when(~early, F.col("value"))).alias("y1"))


@query(f"WITH {TWO}, {CROSSED} SELECT unit, round(arg_min(t, (abs(t - 0), t)), 6) AS t, round(arg_min(clearance, (abs(t - 0), t)), 6) AS clearance FROM cl GROUP BY unit")
def crossing_point(spark, sf_dir):
    out = cr.central_crossing(two_series(spark, sf_dir), ["unit"])
    return out.select("unit", F.round("t", 6).alias("t"), F.round("clearance", 6).alias("clearance"))


@query(f"WITH {TWO}, {CROSSED} SELECT unit, count(*) AS n, round(sum(t), 6) AS total FROM cx GROUP BY unit")
def all_crossings(spark, sf_dir):
    return cr.crossings(two_series(spark, sf_dir), ["unit"]).distinct().groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum("t"), 6).alias("total"))


@query(f"WITH {TWO} SELECT unit, arg_max(t, (y1, -t)) AS peak_t, round(max(y1), 6) AS peak FROM two WHERE y1 IS NOT NULL GROUP BY unit")
def peak_time(spark, sf_dir):
    return cr.peaks(two_series(spark, sf_dir), ["unit"], "t", "y1").withColumn("peak", F.round("peak", 6))


@query(f"""WITH {EV}, ts AS (SELECT unit, CAST(floor(t / 24) AS BIGINT) - 19738 AS t, sum(value) AS y FROM ev GROUP BY ALL),
gd AS (SELECT unit, t, max(y) OVER (PARTITION BY unit) / 2 AS y0, y AS y1 FROM ts), {CROSSED}
SELECT unit, round(arg_min(t, (abs(t - 0), t)), 6) AS t, round(arg_min(clearance, (abs(t - 0), t)), 6) AS clearance FROM cl GROUP BY unit""")
def half_height_time(spark, sf_dir):
    ts = events(spark, sf_dir).groupBy("unit", (F.floor(F.col("t") / 24) - 19738).alias("t")).agg(F.sum("value").alias("y"))
    out = cr.half_height(ts, ["unit"])
    return out.select("unit", F.round("t", 6).alias("t"), F.round("clearance", 6).alias("clearance"))


#: Units in groups of ten: the group's daily mean is the parent series.
HIER = f"""{TWO}, gs AS (SELECT unit // 10 AS grp, t, avg(y0) AS y0, avg(y1) AS y1 FROM gd GROUP BY ALL)"""


@query(f"""WITH {HIER},
pl AS (SELECT grp, t, y1 > y0 AS up, lag(y1 > y0) OVER w AS was, y1 - y0 AS d, lag(y1 - y0) OVER w AS d0, lag(t) OVER w AS x0 FROM gs WINDOW w AS (PARTITION BY grp ORDER BY t)),
px AS (SELECT DISTINCT grp, x0 + (-d0 * (t - x0)) / nullif(d - d0, 0) AS t FROM pl WHERE NOT was AND up),
pc AS (SELECT px.grp, px.t, coalesce(least(px.t - lag(px.t) OVER w, lead(px.t) OVER w - px.t), least(px.t - lo, hi - px.t)) AS clearance FROM px JOIN (SELECT grp, min(t) AS lo, max(t) AS hi FROM gs GROUP BY grp) USING (grp) WINDOW w AS (PARTITION BY px.grp ORDER BY px.t)),
pb AS (SELECT grp, arg_min(t, (abs(t), t)) AS t, arg_min(clearance, (abs(t), t)) AS clearance FROM pc GROUP BY grp), {CROSSED},
ct AS (SELECT cl.*, coalesce(CASE WHEN pb.clearance >= 2 THEN pb.t END, 0) AS c FROM cl LEFT JOIN pb ON pb.grp = cl.unit // 10),
un AS (SELECT unit, arg_min(t, (abs(t - c), t)) AS t, arg_min(clearance, (abs(t - c), t)) AS clearance FROM ct GROUP BY unit)
SELECT 'group' AS level, 'g' || CAST(grp AS VARCHAR) AS name, round(t, 6) AS t, round(clearance, 6) AS clearance FROM pb
UNION ALL SELECT 'unit', 'u' || CAST(unit AS VARCHAR), round(t, 6), round(clearance, 6) FROM un""")
def hier_crossing_point(spark, sf_dir):
    two = two_series(spark, sf_dir).where("y0 is not null and y1 is not null").withColumn("grp", F.floor(F.col("unit") / 10).cast("long"))
    own = two.select(F.lit("unit").alias("level"), F.concat(F.lit("u"), "unit").alias("name"), "t", "y0", "y1")
    top = two.groupBy("grp", "t").agg(F.avg("y0").alias("y0"), F.avg("y1").alias("y1")).select(F.lit("group").alias("level"), F.concat(F.lit("g"), "grp").alias("name"), "t", "y0", "y1")
    tree = two.select(F.concat(F.lit("u"), "unit").alias("name"), F.lit("group").alias("ancestor_level"), F.concat(F.lit("g"), "grp").alias("ancestor")).distinct()
    out = cr.hier_central_crossing(top.unionByName(own), tree, ["group", "unit"], [], least_clearance=2.0)
    return out.select("level", "name", F.round("t", 6).alias("t"), F.round("clearance", 6).alias("clearance"))


@query(f"""WITH {TWO}, f AS (SELECT unit, t, coalesce(y1 > y0, false) AS f FROM two), g AS (SELECT *, sum(CASE WHEN f <> coalesce(pf, NOT f) THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY t) AS i FROM (SELECT *, lag(f) OVER (PARTITION BY unit ORDER BY t) AS pf FROM f))
SELECT unit, min(t) AS "start", max(t) AS stop, count(*) AS n FROM g WHERE f GROUP BY unit, i""")
def significance_runs(spark, sf_dir):
    return cr.runs(two_series(spark, sf_dir), ["unit"], F.col("y1") > F.col("y0"))
