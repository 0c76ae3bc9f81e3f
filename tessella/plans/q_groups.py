"""Grouped statistics, normalisations, hierarchies and set operations."""

from pyspark.sql import functions as F

from tessella.functions import moments, scalars
from tessella.operators import aggregates as ag
from tessella.operators import hierarchy as hi
from tessella.operators import nested
from tessella.operators import summary as sm
from tessella.plans.q_stats import BOOTS, PERMS, boots_sql, sign
from tessella.plans.registry import query
from tessella.plans.views import CUST, EV, FIX, customers, events, fixations, table

R6 = lambda df, *names: df.withColumns({c: F.round(c, 6) for c in names})


@query(f"WITH {EV} SELECT unit, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM ev GROUP BY ALL")
def psth_mean_sd(spark, sf_dir):
    return R6(ag.psth(events(spark, sf_dir), ["unit", "event_type"], "value"), "mean", "sd")


@query(f"""WITH {EV}, sr AS (SELECT unit, t, count(*) AS n FROM ev GROUP BY ALL), pd AS (SELECT DISTINCT unit, period, s, e FROM ev, (VALUES ('on', 473352, 473600), ('off', 473600, 474072)) p(period, s, e)),
x AS (SELECT pd.unit, period, e - s AS bins, coalesce(sum(n), 0) AS a, coalesce(sum(n * n), 0) AS b FROM pd LEFT JOIN sr ON sr.unit = pd.unit AND sr.t >= s AND sr.t < e GROUP BY ALL)
SELECT unit, period, round(a / bins, 6) AS mean, round(sqrt(greatest(b / bins - (a / bins) * (a / bins), 0)), 6) AS sd FROM x""")
def period_stats(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("unit", "t").agg(F.count("*").alias("n"))
    p = s.select("unit").distinct().select("unit", F.expr("stack(2, 'on', 473352, 473600, 'off', 473600, 474072) as (period, start, stop)"))
    return R6(ag.period_stats(s, p, ["unit"]), "mean", "sd")


@query(f"WITH {EV}, m AS (SELECT unit, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type <> 'view') AS b FROM ev GROUP BY unit) SELECT unit, round((a - b) / nullif(a + b, 0), 6) AS fsi FROM m")
def selectivity_index(spark, sf_dir):
    return events(spark, sf_dir).groupBy("unit").agg(F.round(moments.selectivity_index(F.col("value"), F.col("event_type") == "view"), 6).alias("fsi"))


@query(f"WITH {EV}, q AS (SELECT unit, quantile_cont(value, 0.95) AS q FROM ev GROUP BY unit) SELECT event_id, round(value / CASE WHEN q <> 0 THEN q ELSE 1 END, 6) AS scaled FROM ev JOIN q USING (unit)")
def percentile_normalised(spark, sf_dir):
    return R6(ag.percentile_scaled(events(spark, sf_dir), "value", ["unit"]), "scaled").select("event_id", "scaled")


@query(f"WITH {EV}, q AS (SELECT unit, min(value) AS lo, max(value) AS hi FROM ev WHERE event_type = 'view' GROUP BY unit) SELECT event_id, round((value - lo) / nullif(hi - lo, 0), 6) AS scaled FROM ev JOIN q USING (unit)")
def minmax_normalised(spark, sf_dir):
    return R6(ag.min_max_scaled(events(spark, sf_dir), "value", ["unit"], F.col("event_type") == "view"), "scaled").select("event_id", "scaled")


@query(f"WITH {EV}, m AS (SELECT unit, median(value) AS m FROM ev GROUP BY unit) SELECT unit, round(any_value(m), 6) AS median, round(median(abs(value - m)), 6) AS mad FROM ev JOIN m USING (unit) GROUP BY unit")
def mad_by_group(spark, sf_dir):
    return R6(ag.mad(events(spark, sf_dir), "value", ["unit"]), "median", "mad")


@query(f"WITH {EV}, m AS (SELECT unit, avg(value) AS m, stddev_pop(value) AS s FROM ev GROUP BY unit) SELECT event_id, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM ev JOIN m USING (unit)")
def standardized(spark, sf_dir):
    return R6(ag.standardize(events(spark, sf_dir), "value", ["unit"]), "z").select("event_id", "z")


@query(f"""WITH {EV}, k AS (SELECT event_id, unit, CASE WHEN value - 10 > 0 THEN (value - 10) * (value - 10) ELSE 0.0 END AS k FROM ev), m AS (SELECT unit, median(k) AS m FROM k GROUP BY unit),
a AS (SELECT unit, any_value(m) AS m, median(abs(k - m)) AS mad FROM k JOIN m USING (unit) GROUP BY unit)
SELECT event_id, round(CASE WHEN k - m < 3 * mad THEN 0.0 ELSE k END, 6) AS kept FROM k JOIN a USING (unit)""")
def robust_threshold(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.col("value") - 10)
    return R6(ag.robust_threshold(e, "v", ["unit"], 3.0), "kept").select("event_id", "kept")


@query(f"""WITH {EV}, c AS (SELECT event_type, CAST(least(floor((value - 0.0) / 5.0), 19) AS BIGINT) AS bin, count(*) AS n FROM ev WHERE value >= 0 AND value <= 100 GROUP BY ALL),
f AS (SELECT event_type, bin, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT event_type FROM c) CROSS JOIN (SELECT unnest(range(0, 20)) AS bin)) e LEFT JOIN c USING (event_type, bin))
SELECT event_type, bin, CAST((bin + 1) * 5.0 AS DOUBLE) AS edge, round(sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM f""")
def latency_cdf(spark, sf_dir):
    return R6(ag.cdf(events(spark, sf_dir), "value", ["event_type"], 0.0, 100.0, 5.0), "share")


@query(f"WITH {EV}, c AS (SELECT event_type, CAST(floor(value / 4.0) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY ALL) SELECT event_type, bin, n, round(n / (sum(n) OVER (PARTITION BY event_type) * 4.0), 8) AS density FROM c")
def value_histogram(spark, sf_dir):
    return ag.histogram(events(spark, sf_dir), "value", ["event_type"], 0.0, 4.0).withColumn("density", F.round("density", 8))


@query(f"WITH {EV} SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM ev GROUP BY event_type")
def source_shares(spark, sf_dir):
    return ag.shares(events(spark, sf_dir), "event_type").withColumn("share", F.round("share", 8))


@query(f"WITH {EV}, m AS (SELECT unit, avg(value) AS m FROM ev GROUP BY unit) SELECT count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(median(m), 6) AS median FROM m")
def subject_mean_stats(spark, sf_dir):
    return R6(ag.describe_groups(events(spark, sf_dir), "value", "unit"), "mean", "sd", "median")


@query(f"WITH {CUST} SELECT region, subject, round(median(value), 6) AS value_median, round(avg(value), 6) AS value_mean, arg_min(name, unit) AS name, count(*) AS n FROM cust GROUP BY ALL")
def median_table(spark, sf_dir):
    return R6(ag.median_table(customers(spark, sf_dir), ["region", "subject"], ["value"], {"name": "unit"}), "value_median", "value_mean")


@query(f"""WITH {CUST}, l AS (SELECT unit, value, 'subject' AS level, subject AS name FROM cust UNION ALL SELECT unit, value, 'region', region FROM cust UNION ALL SELECT unit, value, 'area', substr(region, 1, 20) FROM cust),
g AS (SELECT level, name, count(DISTINCT unit) AS members, list_sort(list(DISTINCT unit)) AS k FROM l GROUP BY ALL HAVING count(DISTINCT unit) >= 2),
d AS (SELECT k, members, min((level, name)) AS one, list_sort(list(level || '/' || name)) AS names FROM g GROUP BY k, members)
SELECT array_to_string(names, ',') AS names, members, round(avg(value), 8) AS value FROM l JOIN d ON (l.level, l.name) = d.one GROUP BY ALL""")
def hier_group_mean(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("area", F.substring("region", 1, 20))
    out = ag.group_statistics(rows, ["subject", "region", "area"], "value")
    return out.select(F.array_join("names", ",").alias("names"), "members", F.round("value", 8).alias("value"))


@query(f"""WITH {CUST}, n AS (SELECT region, subject, count(*) AS n FROM cust GROUP BY ALL)
SELECT *, CAST(coalesce(list_position(['ASIA', 'EUROPE', 'AFRICA'], region) - 1, -1) AS BIGINT) AS place FROM n""")
def nested_counts(spark, sf_dir):
    return sm.count_by(customers(spark, sf_dir), ["ASIA", "EUROPE", "AFRICA"]).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {EV}, u AS (SELECT unit, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS e, avg(value) AS m FROM ev GROUP BY unit),
c AS (SELECT unit, v > 10 AND v > e AND m >= 9 AS visual, v > 10 AND v > e AND m >= 9 AND e > 8 AS specific FROM u) SELECT visual, specific, count(*) AS n FROM c GROUP BY ALL""")
def selectivity_classes(spark, sf_dir):
    u = events(spark, sf_dir).groupBy("unit").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "error").alias("e"), F.avg("value").alias("r"))
    u = u.select("unit", (F.col("v") > 10).alias("valid"), (F.col("v") > F.col("e")).alias("reject"), "r", (F.col("e") > 8).alias("reject2"))
    return ag.selectivity_classes(u, 9.0).groupBy("visual", "specific").agg(F.count("*").alias("n"))


@query(f"WITH {CUST} SELECT segment AS kind, value > 9000 OR value < 500 AS significant, CASE WHEN value > 5000 THEN 'up' ELSE 'down' END AS direction, count(*) AS n FROM cust GROUP BY ALL")
def contingency_report(spark, sf_dir):
    v = F.col("value")
    return ag.contingency(customers(spark, sf_dir), (v > 9000) | (v < 500), F.when(v > 5000, "up").otherwise("down"), F.col("segment"))


@query(f"WITH {FIX} SELECT fix_id, round(CASE WHEN x - 10 > 0 THEN pow(least(greatest(tax * 100 / (x - 10), 0.0), 1.0), 2) END, 6) AS fit FROM fix")
def ceiling_normalised_fit(spark, sf_dir):
    return fixations(spark, sf_dir).select("fix_id", F.round(ag.normalised_fit(F.col("tax") * 100, F.col("x") - 10), 6).alias("fit"))


@query(f"WITH {FIX} SELECT image, round(CASE WHEN v THEN regr_slope(p, x) END, 4) AS slope, round(CASE WHEN v THEN regr_intercept(p, x) END, 4) AS intercept, round(CASE WHEN v THEN regr_r2(p, x) END, 4) AS r2 FROM (SELECT image, x, price / 1000 AS p, var_pop(x) OVER (PARTITION BY image) > 0 AS v FROM fix) GROUP BY image, v")
def baseline_regression(spark, sf_dir):
    rows = fixations(spark, sf_dir).withColumn("y1", F.col("price") / 1000)
    return ag.baseline_regression(rows, ["image"], "x", "y1").withColumns({c: F.round(c, 4) for c in ("slope", "intercept", "r2")})


@query(f"""WITH {EV}, l AS (SELECT unit AS session, count(DISTINCT floor(t / 24)) AS n_t FROM ev GROUP BY unit), u AS (SELECT DISTINCT unit AS session, event_type AS region, unit FROM ev)
SELECT n_t, region, count(DISTINCT unit) AS n_units FROM u JOIN l USING (session) GROUP BY ALL HAVING count(DISTINCT unit) >= 3""")
def by_grid_length(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("unit").alias("session"), F.floor(F.col("t") / 24).alias("day"), F.col("event_type").alias("region"), "unit")
    return ag.by_grid_length(rows, "session", "day", "region", "unit", 3)


@query("""WITH u AS (SELECT c_custkey AS unit, n_name AS subject, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT 'unit' AS level, CAST(s_suppkey AS VARCHAR) AS key, s_acctbal AS v FROM supplier UNION ALL
      SELECT 'subject', n_name, avg(s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 GROUP BY n_name UNION ALL
      SELECT 'region', r_name, avg(s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY r_name),
l AS (SELECT unit, 0 AS r, 'unit' AS level, CAST(unit AS VARCHAR) AS key FROM u UNION ALL SELECT unit, 1, 'subject', subject FROM u UNION ALL SELECT unit, 2, 'region', region FROM u)
SELECT unit, arg_min(level, r) AS level, arg_min(key, r) AS key, round(arg_min(v, r), 8) AS v FROM l JOIN k USING (level, key) GROUP BY unit""")
def hier_fallback_lookup(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    met = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    known = s.select(F.lit("unit").alias("level"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_acctbal").alias("v"))
    known = known.unionByName(met.where("n_nationkey % 3 = 0").groupBy(F.lit("subject").alias("level"), F.col("n_name").alias("key")).agg(F.avg("s_acctbal").alias("v")))
    known = known.unionByName(met.where("r_regionkey < 3").groupBy(F.lit("region").alias("level"), F.col("r_name").alias("key")).agg(F.avg("s_acctbal").alias("v")))
    out = hi.first_hit(customers(spark, sf_dir), known, [("unit", F.col("unit")), ("subject", F.col("subject")), ("region", F.col("region"))])
    return out.withColumn("v", F.round("v", 8))


@query("""WITH m AS (SELECT c_nationkey % 5 AS session, CASE c_custkey % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'channel' ELSE 'array_id' END AS level,
  CASE c_custkey % 3 WHEN 0 THEN 'u' || (c_custkey % 400) WHEN 1 THEN 'c' || (c_custkey % 130) ELSE 'a' || (c_custkey % 11) END AS key, round_even(c_acctbal / 100 / 5, 0) * 5 AS lat FROM customer),
u AS (SELECT s_suppkey, s_nationkey % 5 AS session, 'u' || s_suppkey AS unit, 'c' || (s_suppkey % 130) AS channel, 'a' || (s_suppkey % 13) AS array_id FROM supplier),
g AS (SELECT session, level, key, median(lat) AS lat FROM m GROUP BY ALL), a AS (SELECT key, median(lat) AS lat FROM m WHERE level = 'array_id' GROUP BY key)
SELECT u.unit, CASE WHEN coalesce(g1.lat, g2.lat, g3.lat, a.lat, 75.0) = 0 THEN 0.0 ELSE coalesce(g1.lat, g2.lat, g3.lat, a.lat, 75.0) END AS lat, CASE WHEN g1.lat IS NOT NULL THEN 'unit' WHEN g2.lat IS NOT NULL THEN 'channel' WHEN g3.lat IS NOT NULL THEN 'array_id' WHEN a.lat IS NOT NULL THEN 'any_session' ELSE 'default' END AS source
FROM u LEFT JOIN g g1 ON g1.session = u.session AND g1.level = 'unit' AND g1.key = unit LEFT JOIN g g2 ON g2.session = u.session AND g2.level = 'channel' AND g2.key = channel
LEFT JOIN g g3 ON g3.session = u.session AND g3.level = 'array_id' AND g3.key = array_id LEFT JOIN a ON a.key = array_id""")
def cascade_impute(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    level = F.expr("case c_custkey % 3 when 0 then 'unit' when 1 then 'channel' else 'array_id' end")
    key = F.expr("case c_custkey % 3 when 0 then concat('u', c_custkey % 400) when 1 then concat('c', c_custkey % 130) else concat('a', c_custkey % 11) end")
    measured = c.select((F.col("c_nationkey") % 5).alias("session"), level.alias("level"), key.alias("key"), (F.col("c_acctbal") / 100).alias("lat"))
    units = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("session"), F.expr("concat('u', s_suppkey)").alias("unit"), F.expr("concat('c', s_suppkey % 130)").alias("channel"), F.expr("concat('a', s_suppkey % 13)").alias("array_id"))
    return hi.impute(units, measured, ["lat"], 5.0, {"lat": 75.0}).select("unit", F.when(F.col("lat") == 0, 0.0).otherwise(F.col("lat")).alias("lat"), "source")


@query("""SELECT c_custkey AS unit, CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS channel, CAST(floor((CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) - 1) / 32.0) AS BIGINT) AS bank, substr(c_mktsegment, 1, 2) AS subject, n_name AS array_id
FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 25 AND n_regionkey = CAST(floor((CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) - 1) / 32.0) AS BIGINT)""")
def annotate_units(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    units = c.select(F.col("c_custkey").alias("unit"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("session"), (F.col("c_custkey") % 25).alias("k"))
    banks = n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("bank"), F.col("n_name").alias("array_id"))
    channel = scalars.first_integer(F.col("name"))
    named = units.withColumn("channel", channel).withColumn("bank", scalars.bank_of(channel)).withColumn("subject", F.substring("session", 1, 2))
    return named.join(banks, ["k", "bank"], "left").select("unit", "channel", "bank", "subject", "array_id")


@query(f"""WITH {CUST}, nm AS (SELECT 'subject/' || subject AS name FROM cust UNION SELECT 'region/' || region FROM cust UNION SELECT 'segment/' || segment FROM cust WHERE segment < 'C')
SELECT nm.name, CASE WHEN nm.name LIKE 'subject/%' THEN substr(nm.name, 9) END AS subject,
 CASE WHEN nm.name LIKE 'subject/%' THEN (SELECT any_value(region) FROM cust WHERE subject = substr(nm.name, 9)) WHEN nm.name LIKE 'region/%' THEN substr(nm.name, 8) END AS region
FROM nm WHERE nm.name NOT LIKE 'segment/%'""")
def annotate_names(spark, sf_dir):
    c = customers(spark, sf_dir)
    names = c.select(F.concat(F.lit("subject/"), "subject").alias("name")).union(c.select(F.concat(F.lit("region/"), "region"))).distinct()
    return hi.annotate_names(names, c, {"subject": "subject", "region": "region"}).select("name", "subject", "region")


@query(f"""WITH {CUST}, c AS (SELECT region, subject, unit, seg AS t, value - 4900 AS a, value / 2 - 2400 AS b FROM (SELECT *, unit % 2 AS seg FROM cust)),
cust2 AS (SELECT region, subject, unit, t, 'a' AS cond, a AS value FROM c UNION ALL SELECT region, subject, unit, t, 'b', b FROM c), {boots_sql(BOOTS, "r", "cust2")},
bt AS (SELECT region, t, cond, b, avg(s) AS centre FROM (SELECT region, t, cond, b, slot, avg(value) AS s FROM vl GROUP BY ALL) GROUP BY ALL),
ci AS (SELECT region, t, cond, quantile_cont(centre, 0.025) AS lo, quantile_cont(centre, 0.975) AS hi FROM bt GROUP BY ALL),
ob AS (SELECT region, t, cond, avg(s) AS centre, CAST(sum(n) AS BIGINT) AS n_units, count(*) AS n_subjects FROM (SELECT region, t, cond, subject, avg(value) AS s, count(*) AS n FROM cust2 GROUP BY ALL) GROUP BY ALL)
SELECT region, t, cond, round(centre, 8) AS centre, n_units, n_subjects, round(lo, 8) AS lo, round(hi, 8) AS hi FROM ob JOIN ci USING (region, t, cond)""")
def region_summary(spark, sf_dir):
    return sm.region_centres(_units(spark, sf_dir), ["a", "b"], BOOTS, "r").withColumns({c: F.round(c, 8) for c in ("centre", "lo", "hi")})


def _units(spark, sf_dir):
    return customers(spark, sf_dir).select("region", "subject", "unit", (F.col("unit") % 2).alias("t"), (F.col("value") - 4900).alias("a"), (F.col("value") / 2 - 2400).alias("b"))


def _tests_sql() -> str:
    def part(name: str, v: str, reached: str) -> tuple[str, str]:
        blocks, factor = sign(f"r-{name}", "rb", "c")
        key = name.replace("-", "_")
        flipped = f"f_{key} AS (SELECT region, t, subject, 128 * block + i AS rb, h, {v} AS v FROM c JOIN {blocks} ON su = unit, (SELECT unnest(range(0, 128)) AS i) WHERE 128 * block + i < {PERMS})"
        return flipped, f"""SELECT region, t, '{name}' AS test, observed, greatest(avg(CASE WHEN {reached} THEN 1.0 ELSE 0.0 END), 1.0 / (count(*) + 1)) AS p FROM (
  SELECT region, t, rb, avg(s) AS c FROM (SELECT region, t, rb, subject, avg(v * {factor}) AS s FROM f_{key} GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT region, t, avg(s) AS observed, avg(a) * {nested.TIE} AS near FROM (SELECT region, t, subject, avg({v}) AS s, avg(abs({v})) AS a FROM c GROUP BY ALL) GROUP BY ALL) USING (region, t) GROUP BY region, t, observed"""

    (rows_one, one), (rows_two, two) = part("a", "a", "c >= observed - near"), part("a-b", "a - b", "abs(c) >= abs(observed) - near")
    return f"""WITH {CUST}, c AS (SELECT region, subject, unit, unit % 2 AS t, value - 4900 AS a, value / 2 - 2400 AS b FROM cust), {rows_one}, {rows_two},
pv AS ({one} UNION ALL {two}), k1 AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM pv),
s1 AS (SELECT *, coalesce(max(CASE WHEN p <= (0.2 / 1.2) * k / m THEN k END) OVER (), 0) AS r1 FROM k1),
s2 AS (SELECT *, coalesce(max(CASE WHEN p <= CASE WHEN r1 < m THEN (0.2 / 1.2) * m / (m - r1) ELSE 1.0 END * k / m THEN k END) OVER (), 0) AS r2, max(p) FILTER (true) OVER () AS top FROM s1)
SELECT region, t, test, round(observed, 8) AS observed, p, r1 > 0 AND (r1 = m OR p <= (SELECT max(p) FROM s2 q WHERE q.k = q.r2)) AS reject FROM s2"""


@query(_tests_sql())
def region_summary_tests(spark, sf_dir):
    stat_tests = [sm.StatTest("a", None, "greater"), sm.StatTest("b", "a", "both")]
    return sm.region_tests(_units(spark, sf_dir), ["a", "b"], stat_tests, PERMS, 0.2, "r").select("region", "t", "test", F.round("observed", 8).alias("observed"), "p", "reject")


@query(f"""WITH {EV}, a AS (SELECT DISTINCT unit FROM ev WHERE event_type = 'view' AND value > 25), b AS (SELECT DISTINCT unit FROM ev WHERE event_type = 'error' AND value > 25)
SELECT 'both' AS part, unit FROM (SELECT unit FROM a INTERSECT SELECT unit FROM b) UNION ALL SELECT 'first', unit FROM (SELECT unit FROM a EXCEPT SELECT unit FROM b) UNION ALL SELECT 'any', unit FROM (SELECT unit FROM a UNION SELECT unit FROM b)""")
def key_set_operations(spark, sf_dir):
    e = events(spark, sf_dir).where("value > 25")
    a, b = (e.where(F.col("event_type") == k).select("unit").distinct() for k in ("view", "error"))
    parts = [("both", a.intersect(b)), ("first", a.exceptAll(b)), ("any", a.union(b).distinct())]
    out = [df.select(F.lit(name).alias("part"), "unit") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {EV}, k AS (SELECT DISTINCT c_custkey AS unit FROM customer), c AS (SELECT unit, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY unit) SELECT CAST(k.unit AS BIGINT) AS unit, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (unit)")
def reindex_with_fill(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")).distinct()
    counts = events(spark, sf_dir).where("event_type = 'view'").groupBy("unit").agg(F.count("*").alias("n"))
    return keys.join(counts, "unit", "left").select("unit", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def session_seeds(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("unit"), scalars.session_seed(F.col("c_name")).alias("seed"), scalars.first_integer(F.col("c_name")).alias("number"))


@query("""WITH p AS (SELECT page_id, string_split_regex(split_part(url, '://', 2), '[/\\\\]') AS parts FROM pages)
SELECT page_id, len(parts) AS n_parts, parts[1] AS host, regexp_replace(parts[-1], '\\.[^.]*$', '') AS stem FROM p""")
def path_functions(spark, sf_dir):
    url = F.split_part(F.col("url"), F.lit("://"), F.lit(2))
    parts = scalars.path_parts(url)
    return table(spark, sf_dir, "pages").select("page_id", F.size(parts).cast("long").alias("n_parts"), parts[0].alias("host"), scalars.file_stem(url).alias("stem"))
