"""Selections, alignments and summaries that combine operators."""

from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import aggregates as ag
from tessella.operators import align as al
from tessella.operators import crossing as cr
from tessella.operators import nested as ne
from tessella.operators.ranking import global_rank
from tessella.plans.q_events import CLEAN, cleaned
from tessella.plans.q_models import BOXES, boxes
from tessella.plans.q_pairs import MOVED, move_table
from tessella.plans.q_series import HIER, TWO, errors, series, two_series
from tessella.plans.q_stats import BOOTS as REPLICATES
from tessella.plans.q_stats import D, boots_sql
from tessella.plans.registry import query
from tessella.plans.views import CUST, EV, FIX, customers, events, fixations, table
from tessella.sources.readers import lookup_strict

R6 = lambda df, *names: df.withColumns({c: F.round(c, 6) for c in names})

#: Replicates of each unit's latency, made of its events: replicate b leaves out every event whose id is b modulo 8.
BOOTS = f"""{EV}, bo AS (SELECT unit, b, CASE WHEN b = 3 AND unit % 4 = 0 THEN NULL ELSE avg(value) * 10 END AS t, min(value) * 40 + 80 AS clearance FROM ev, (SELECT unnest(range(0, 8)) AS b) WHERE event_id % 8 <> b GROUP BY unit, b),
es AS (SELECT unit, avg(value) * 10 AS t, min(value) * 40 + 90 AS clearance, avg(value) * 5 AS peak0, avg(value) * 12 AS peak1 FROM ev GROUP BY unit),
ru AS (SELECT bo.unit, CASE WHEN b % 2 = 1 THEN 'train' ELSE 'test' END AS part, avg(bo.t) - any_value(es.t) AS bias, stddev_pop(bo.t) AS sd, avg(bo.clearance) AS mean_clearance, count(bo.t) / count(*) AS valid FROM bo JOIN es USING (unit) GROUP BY ALL)"""


def boots_and_estimates(spark, sf_dir):
    e = events(spark, sf_dir)
    b = e.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(7)))).where("event_id % 8 <> b").groupBy("unit", "b").agg((F.avg("value") * 10).alias("t"), (F.min("value") * 40 + 80).alias("clearance"))
    b = b.withColumn("t", F.when(~((F.col("b") == 3) & (F.col("unit") % 4 == 0)), F.col("t")))
    est = e.groupBy("unit").agg((F.avg("value") * 10).alias("t"), (F.min("value") * 40 + 90).alias("clearance"), (F.avg("value") * 5).alias("peak0"), (F.avg("value") * 12).alias("peak1"))
    return b, est


@query(f"WITH {BOOTS} SELECT unit, part, round(bias, 6) AS bias, round(sd, 6) AS sd, round(mean_clearance, 6) AS mean_clearance, round(valid, 6) AS valid FROM ru")
def boot_rollup(spark, sf_dir):
    b, est = boots_and_estimates(spark, sf_dir)
    return R6(cr.boot_rollup(b, ["unit"], est), "bias", "sd", "mean_clearance", "valid")


@query(f"""WITH {BOOTS}, j AS (SELECT es.*, bias, sd, mean_clearance, valid FROM es JOIN ru USING (unit) WHERE part = 'train')
SELECT unit, round(t, 6) AS t FROM j WHERE t IS NOT NULL AND clearance >= 100 AND t BETWEEN least(peak0, peak1) AND greatest(peak0, peak1) AND valid >= 0.5 AND abs(bias) < 25 AND sd < 25 AND mean_clearance >= 100""")
def latency_acceptance(spark, sf_dir):
    b, est = boots_and_estimates(spark, sf_dir)
    rolled = cr.boot_rollup(b, ["unit"], est).where("part = 'train'")
    return R6(cr.acceptable_latency(est.join(rolled, "unit"))[0].select("unit", "t"), "t")


@query(f"""WITH {BOOTS}, j AS (SELECT es.*, bias, sd, mean_clearance, valid FROM es JOIN ru USING (unit) WHERE part = 'train')
SELECT count(*) FILTER (t IS NOT NULL) AS finite, count(*) FILTER (clearance >= 100) AS clear, count(*) FILTER (t BETWEEN least(peak0, peak1) AND greatest(peak0, peak1)) AS between_peaks, count(*) FILTER (valid >= 0.5) AS valid,
 count(*) FILTER (abs(bias) < 25) AS unbiased, count(*) FILTER (sd < 25) AS precise, count(*) FILTER (mean_clearance >= 100) AS clear_boots, count(*) AS total FROM j""")
def latency_criteria_report(spark, sf_dir):
    b, est = boots_and_estimates(spark, sf_dir)
    return cr.acceptable_latency(est.join(cr.boot_rollup(b, ["unit"], est).where("part = 'train'"), "unit"))[1]


@query("""WITH l AS (SELECT r_name AS region, s_acctbal / 100 AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), s AS (SELECT stddev_pop(d) AS sd, avg(d) AS m FROM l)
SELECT region, count(*) FILTER (d - m < -1.65 * sd) AS earlier, count(*) FILTER (d - m > 1.65 * sd) AS later, count(*) AS n FROM l, s GROUP BY region""")
def latency_difference_units(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    d = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), (F.col("s_acctbal") / 100).alias("d"))
    return ag.beyond_spread(d, "d", ["region"])


@query(f"WITH {EV}, m AS (SELECT unit, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type <> 'view') AS b FROM ev GROUP BY unit) SELECT unit FROM m WHERE abs((a - b) / nullif(a + b, 0)) >= 0.1")
def selectivity_threshold(spark, sf_dir):
    from tessella.functions.moments import selectivity_index

    m = events(spark, sf_dir).groupBy("unit").agg(selectivity_index(F.col("value"), F.col("event_type") == "view").alias("i"))
    return m.where(F.abs("i") >= 0.1).select("unit")


@query(f"WITH {FIX}, {BOXES} SELECT DISTINCT trial FROM fix WHERE image IN (SELECT image FROM bx)")
def trials_with_roi(spark, sf_dir):
    return fixations(spark, sf_dir).join(boxes(spark, sf_dir).select("image"), "image", "left_semi").select("trial").distinct()


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT (p_partkey, p_size) FROM part)")
def composite_semi_join(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("l_suppkey")).distinct()
    return table(spark, sf_dir, "lineitem").join(keys, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def excluded_trials_anti_join(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(out, "o_orderkey", "left_anti").select("o_orderkey")


@query(f"""WITH {EV}, a AS (SELECT unit, avg(value) AS fit FROM ev WHERE event_type = 'view' GROUP BY unit HAVING count(*) > 10), b AS (SELECT unit, avg(value) AS cons FROM ev WHERE event_type = 'error' GROUP BY unit HAVING count(*) > 10),
c AS (SELECT unit, count(*) AS n FROM ev GROUP BY unit) SELECT unit, round(fit, 6) AS fit, round(cons, 6) AS cons, n FROM a JOIN b USING (unit) JOIN c USING (unit)""")
def cross_analysis_alignment(spark, sf_dir):
    e = events(spark, sf_dir)
    part = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("unit").agg(F.avg("value").alias(name), F.count("*").alias("k")).where("k > 10").drop("k")
    return R6(part("view", "fit").join(part("error", "cons"), "unit").join(e.groupBy("unit").agg(F.count("*").alias("n")), "unit"), "fit", "cons")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_size, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey")
def strict_feature_lookup(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return lookup_strict(line.select("l_orderkey", "l_linenumber", "l_partkey"), part.select("l_partkey", "p_size", "p_retailprice"), "l_partkey")


@query(f"WITH {EV} SELECT unit, bool_or(value > 30) AS any_high, NOT bool_or(event_type = 'error' AND value < 1) AS no_low_error, bool_or(event_type IN ('view', 'click') AND value > 30) AS any_high_early FROM ev GROUP BY unit")
def any_none_flags(spark, sf_dir):
    v, kind = F.col("value"), F.col("event_type")
    return events(spark, sf_dir).groupBy("unit").agg(F.bool_or(v > 30).alias("any_high"), (~F.bool_or((kind == "error") & (v < 1))).alias("no_low_error"), F.bool_or(kind.isin("view", "click") & (v > 30)).alias("any_high_early"))


@query(f"WITH {EV}, s AS (SELECT unit, event_id % 5 AS split, CASE WHEN count(*) > 8 THEN avg(value) END AS r FROM ev GROUP BY ALL) SELECT unit, round(avg(r), 6) AS r, count(r) AS n_splits FROM s GROUP BY unit")
def mean_across_splits(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("unit", (F.col("event_id") % 5).alias("split")).agg(F.when(F.count("*") > 8, F.avg("value")).alias("r"))
    return s.groupBy("unit").agg(F.round(F.avg("r"), 6).alias("r"), F.count("r").alias("n_splits"))


@query(f"""WITH {MOVED} SELECT 'move' AS anchor, to_id, from_end AS t FROM mv UNION ALL SELECT 'fixation', to_id, to_start FROM mv""")
def alignment_anchors(spark, sf_dir):
    m = move_table(spark, sf_dir)
    return m.select(F.lit("move").alias("anchor"), "to_id", al.anchors(m, "move").alias("t")).unionByName(m.select(F.lit("fixation").alias("anchor"), "to_id", al.anchors(m, "fixation").alias("t")))


@query(f"""WITH {EV}, sr AS (SELECT unit, t, count(*) AS n FROM ev GROUP BY ALL), er AS (SELECT event_id AS event, unit, t FROM ev WHERE event_type = 'error')
SELECT event, er.unit, round(coalesce(sum(n) FILTER (sr.t < er.t), 0) / 20.0 * 1000, 6) AS pre, round(coalesce(sum(n) FILTER (sr.t >= er.t), 0) / 20.0 * 1000, 6) AS post
FROM er LEFT JOIN sr ON sr.unit = er.unit AND sr.t >= er.t - 20 AND sr.t < er.t + 20 GROUP BY ALL""")
def pre_post_windows(spark, sf_dir):
    both = al.binned_response(errors(spark, sf_dir), series(spark, sf_dir), [-10, 10], 20)
    rate = lambda off: F.round(F.max(F.when(F.col("off") == off, F.col("resp"))) * 1000, 6)
    return both.groupBy("event", "unit").agg(rate(-10).alias("pre"), rate(10).alias("post"))


@query(f"""WITH {HIER}, l AS (SELECT 'unit' AS level, 'u' || CAST(unit AS VARCHAR) AS name, t, y1 FROM gd UNION ALL SELECT 'group', 'g' || CAST(grp AS VARCHAR), t, y1 FROM gs)
SELECT level, name, arg_max(t, (round(y1, 6), -t)) AS peak_t, max(round(y1, 6)) AS peak FROM l GROUP BY ALL""")
def hier_peak_time(spark, sf_dir):
    two = two_series(spark, sf_dir).where("y0 is not null and y1 is not null").withColumn("grp", F.floor(F.col("unit") / 10).cast("long"))
    own = two.select(F.lit("unit").alias("level"), F.concat(F.lit("u"), "unit").alias("name"), "t", F.round("y1", 6).alias("y"))
    top = two.groupBy("grp", "t").agg(F.round(F.avg("y1"), 6).alias("y")).select(F.lit("group").alias("level"), F.concat(F.lit("g"), "grp").alias("name"), "t", "y")
    return cr.hier_peaks(top.unionByName(own), ["group", "unit"], [])


@query(f"""WITH {CUST}, c AS (SELECT region, subject, unit, value FROM cust), {boots_sql(REPLICATES, "n", "c")},
bt AS (SELECT region, b, avg(s) AS centre FROM (SELECT region, b, slot, avg(CASE WHEN value < 2000 THEN 1.0 ELSE 0.0 END) AS s FROM vl GROUP BY ALL) GROUP BY ALL),
ob AS (SELECT region, avg(s) AS centre FROM (SELECT region, subject, avg(CASE WHEN value < 2000 THEN 1.0 ELSE 0.0 END) AS s FROM c GROUP BY ALL) GROUP BY region)
SELECT region, round(any_value(ob.centre), 6) AS share, round(quantile_cont(bt.centre, 0.025), 6) AS lo, round(quantile_cont(bt.centre, 0.975), 6) AS hi FROM bt JOIN ob USING (region) GROUP BY region""")
def region_low_share_boots(spark, sf_dir):
    """The share of low values in each region, with a hierarchical bootstrap interval."""
    rows = customers(spark, sf_dir).select("region", "subject", "unit", (F.col("value") < 2000).cast("double").alias("value"))
    ci = ne.spread(ne.hier_boots(rows, REPLICATES, "n"), ["region"])
    return R6(ne.two_level(rows).select("region", F.col("centre").alias("share")).join(ci, "region"), "share", "lo", "hi")


@query(f"""WITH {CUST}, c AS (SELECT region, subject, unit, e AS edge, CASE WHEN value <= e THEN 1.0 ELSE 0.0 END AS value FROM cust, (VALUES (0), (2500), (5000), (7500)) v(e)), {boots_sql(REPLICATES, "d", "c")},
bt AS (SELECT region, edge, b, avg(s) AS centre FROM (SELECT region, edge, b, slot, avg(value) AS s FROM vl GROUP BY ALL) GROUP BY ALL)
SELECT region, edge, round(quantile_cont(centre, 0.025), 6) AS lo, round(quantile_cont(centre, 0.975), 6) AS hi FROM bt GROUP BY ALL""")
def region_cdf_boots(spark, sf_dir):
    """Bootstrap intervals of each region's distribution function at some edges; all edges share the draws."""
    edges = F.explode(F.array(*[F.lit(e) for e in (0, 2500, 5000, 7500)]))
    rows = customers(spark, sf_dir).withColumn("edge", edges).select("region", "subject", "unit", "edge", (F.col("value") <= F.col("edge")).cast("double").alias("value"))
    return R6(ne.spread(ne.hier_boots(rows, REPLICATES, "d", extra=("edge",)), ["region", "edge"]), "lo", "hi")


@query(f"WITH {EV}, p AS (SELECT unit, count(*) FILTER (event_type = 'view') / count(*) / 5 AS p FROM ev GROUP BY unit) SELECT unit, CASE WHEN p >= 0.05 THEN 'n.s.' WHEN p >= 0.01 THEN 'p < .05' WHEN p >= 0.001 THEN 'p < .01' ELSE 'p < .001' END AS said FROM p")
def significance_text(spark, sf_dir):
    p = events(spark, sf_dir).groupBy("unit").agg((F.count_if(F.col("event_type") == "view") / F.count("*") / 5).alias("p"))
    return p.select("unit", scalars.significance(F.col("p")).alias("said"))


@query("""WITH n AS (SELECT substr(n_name, 1, 2) || s_suppkey % 101 || '-' || s_suppkey AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT name, row_number() OVER (ORDER BY list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda s: {'k': CASE WHEN s[1] BETWEEN '0' AND '9' THEN 0 ELSE 1 END, 'n': coalesce(TRY_CAST(s AS BIGINT), 0), 't': s})) AS place FROM n""")
def natural_sort(spark, sf_dir):
    """Unit names in natural order: AR9-110 stands before AR10-9."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    names = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.concat(F.substring("n_name", 1, 2), F.col("s_suppkey") % 101, F.lit("-"), "s_suppkey").alias("name"))  # 25 nations at any scale
    return global_rank(names, [scalars.natural_key(F.col("name"))], "place").select("name", "place")


@query(f"WITH {TWO}, w AS (SELECT * FROM two WHERE t BETWEEN -5 AND 5 AND t % 2 = 0) SELECT unit, count(*) AS n, round(avg(y1), 6) AS y1 FROM w GROUP BY unit")
def time_window_restriction(spark, sf_dir):
    w = two_series(spark, sf_dir).where(F.col("t").between(-5, 5) & (F.col("t") % 2 == 0))
    return w.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("y1"), 6).alias("y1"))


@query(f"WITH {CLEAN} SELECT fix_id, t0 FROM ranked ORDER BY t0, fix_id LIMIT 100")
def first_rows(spark, sf_dir):
    """The first hundred events in time (a top-k report)."""
    return cleaned(spark, sf_dir).select("fix_id", "t0").orderBy("t0", "fix_id").limit(100)


@query(f"""WITH {EV}, z AS (SELECT unit, event_type AS k, round(value / 10, 3) AS x, round(value / 7, 3) AS y FROM ev), o AS (SELECT unit, x, y, {D.format("'sub', unit, x")} % 3 AS part FROM z)
SELECT part, count(*) AS n FROM o GROUP BY part""")
def seeded_partition(spark, sf_dir):
    z = events(spark, sf_dir).select("unit", F.round(F.col("value") / 10, 3).alias("x"))
    return z.groupBy((scalars.draw("sub", F.col("unit"), F.col("x")) % 3).alias("part")).agg(F.count("*").alias("n"))
