"""Resampling, tests and region summaries."""

from pyspark.sql import functions as F

from tessella.functions import draws
from tessella.operators import nested as ne
from tessella.operators import pairs as pr
from tessella.operators import permutation as pm
from tessella.operators import resample as rs
from tessella.operators import tests as ts
from tessella.operators.ranking import global_rank
from tessella.plans.q_pairs import PAIRS
from tessella.plans.registry import query
from tessella.plans.views import CUST, EV, FIX, customers, events, fixations, table

D = "CAST(('0x' || substr(md5(concat_ws(':', {})), 1, 8)) AS BIGINT)"
#: Replicates of summaries and of tests over rows: bootstraps and permutations.
BOOTS, PERMS = 1000, 10_000
#: Replicates of the tests of pairs, each over 10,000 pairs.
PAIR_BOOTS, PAIR_PERMS = 100, 1000
TWO_LEVEL = "SELECT region, avg(s) AS centre, CAST(sum(n) AS BIGINT) AS n_units, count(*) AS n_subjects FROM (SELECT region, subject, avg(value) AS s, count(value) AS n FROM cust GROUP BY ALL) GROUP BY region"


@query(f"WITH {CUST} SELECT region, round(centre, 6) AS centre, n_units, n_subjects FROM ({TWO_LEVEL})")
def region_two_level_center(spark, sf_dir):
    return ne.two_level(customers(spark, sf_dir)).withColumn("centre", F.round("centre", 6))


def word(h: str, i: int) -> str:
    """A 32-bit word of an MD5 in SQL."""
    return f"CAST(('0x' || substr({h}, {1 + 8 * i}, 8)) AS BIGINT)"


WORDS = ", ".join(f"{word('h', i)} AS w{i}" for i in range(4))


def cubic(k: str) -> str:
    """``draws.cubic`` in SQL, over the words w0 to w3."""
    return f"((((w3 * {k} + w2) % {draws.PRIME} * {k} + w1) % {draws.PRIME} * {k} + w0) % {draws.PRIME})"


def sign(seed: str, b: str, unit: str) -> tuple[str, str]:
    """The sign of a unit in a replicate in SQL: a join of all blocks of 128 replicates, and the factor."""
    blocks = f"(SELECT block, unit AS su, md5('{seed}-sign:' || block || ':' || unit) AS h FROM (SELECT DISTINCT unit FROM {unit}), (SELECT unnest(range(0, {(PERMS + 127) // 128})) AS block))"
    nibble = f"CAST(('0x' || substr(h, CAST({b} % 128 // 4 + 1 AS BIGINT), 1)) AS BIGINT)"
    return f"{blocks} sg", f"CASE WHEN ({nibble} >> (3 - {b} % 4)) & 1 = 1 THEN -1.0 ELSE 1.0 END"


def boots_sql(n: int, seed: str, source: str = "cust") -> str:
    return f"""un AS (SELECT DISTINCT region, subject, unit FROM {source}),
u AS (SELECT *, row_number() OVER (PARTITION BY region, subject ORDER BY unit) - 1 AS u_at FROM un),
sb AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY subject) - 1 AS s_at, count(*) OVER (PARTITION BY region) AS n_s FROM (SELECT region, subject, count(*) AS n_u FROM un GROUP BY ALL)),
rb AS (SELECT region, b, {WORDS} FROM (SELECT region, b, md5('{seed}-subject:' || b || ':' || region) AS h FROM (SELECT DISTINCT region FROM un), (SELECT unnest(range(0, {n})) AS b))),
sl AS (SELECT sb.region, sb.s_at AS slot, b, {cubic("sb.s_at")} % n_s AS s_at FROM sb JOIN rb USING (region)),
sw AS (SELECT region, slot, b, s_at, {WORDS} FROM (SELECT *, md5('{seed}-unit:' || b || ':' || region || ':' || slot) AS h FROM sl)),
ch AS (SELECT sw.*, subject, n_u, unnest(range(0, n_u)) AS u_slot FROM sw JOIN sb ON sb.region = sw.region AND sb.s_at = sw.s_at),
tk AS (SELECT region, subject, slot, b, {cubic("u_slot")} % n_u AS u_at FROM ch),
vl AS (SELECT tk.region, b, slot, c.* EXCLUDE (region, subject, unit) FROM tk JOIN u USING (region, subject, u_at) JOIN {source} c ON c.region = tk.region AND c.subject = tk.subject AND c.unit = u.unit)"""


@query(f"""WITH {CUST}, {boots_sql(BOOTS, "h")},
bt AS (SELECT region, b, avg(s) AS centre FROM (SELECT region, b, slot, avg(value) AS s FROM vl GROUP BY ALL) GROUP BY ALL),
ci AS (SELECT region, quantile_cont(centre, 0.025) AS lo, quantile_cont(centre, 0.975) AS hi FROM bt GROUP BY region),
obs AS ({TWO_LEVEL})
SELECT region, round(centre, 8) AS centre, round(lo, 8) AS lo, round(hi, 8) AS hi, n_units, n_subjects FROM obs JOIN ci USING (region)""")
def region_hier_bootstrap_ci(spark, sf_dir):
    """Flagship: nested means of regions with confidence intervals of a hierarchical bootstrap."""
    rows = customers(spark, sf_dir).select("region", "subject", "unit", "value")
    ci = ne.spread(ne.hier_boots(rows, BOOTS, "h"), ["region"])
    out = ne.two_level(rows).join(ci, "region")
    return out.select("region", *[F.round(c, 8).alias(c) for c in ("centre", "lo", "hi")], "n_units", "n_subjects")


@query(f"""WITH {CUST}, {boots_sql(BOOTS, "s")},
bt AS (SELECT region, b, avg(s) AS centre FROM (SELECT region, b, slot, avg(value) AS s FROM vl GROUP BY ALL) GROUP BY ALL),
obs AS ({TWO_LEVEL}), j AS (SELECT bt.region, bt.centre - obs.centre AS e FROM bt JOIN obs USING (region))
SELECT region, round(sqrt(avg(e * e)), 8) AS sem, round(median(abs(e)), 8) AS mad FROM j GROUP BY region""")
def bootstrap_spreads(spark, sf_dir):
    rows = customers(spark, sf_dir).select("region", "subject", "unit", "value")
    met = ne.hier_boots(rows, BOOTS, "s").join(ne.two_level(rows).select("region", F.col("centre").alias("obs")), "region")
    sem, mad = (ne.spread(met, ["region"], kind, F.col("obs")) for kind in ("sem", "mad"))
    return sem.join(mad, "region").select("region", F.round("sem", 8).alias("sem"), F.round("mad", 8).alias("mad"))


@query(f"""WITH {CUST}, obs AS (SELECT region, avg(s) AS observed, avg(a) AS near FROM (SELECT region, subject, avg(value - 4900) AS s, avg(abs(value - 4900)) AS a FROM cust GROUP BY ALL) GROUP BY region),
fl AS (SELECT region, subject, 128 * block + i AS b, h, value - 4900 AS v FROM cust JOIN {sign("f", "", "cust")[0]} ON su = unit, (SELECT unnest(range(0, 128)) AS i) WHERE 128 * block + i < {PERMS}),
nl AS (SELECT region, b, avg(s) AS c FROM (SELECT region, b, subject, avg(v * {sign("f", "b", "")[1]}) AS s FROM fl GROUP BY ALL) GROUP BY ALL)
SELECT region, round(observed, 6) AS observed, avg(CASE WHEN c >= observed - near * {ne.TIE} THEN 1.0 ELSE 0.0 END) AS p, 1.0 / (count(*) + 1) AS floor FROM nl JOIN obs USING (region) GROUP BY region, observed""")
def region_sign_flip_test(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("value", F.col("value") - 4900)
    return ne.sign_flip_test(rows, PERMS, "f").withColumn("observed", F.round("observed", 6))


@query(f"""WITH {CUST}, n AS (SELECT region, subject, count(*) AS n FROM cust GROUP BY ALL), r AS (SELECT *, median(n) OVER (PARTITION BY region) AS med FROM n),
rare AS (SELECT region, subject FROM r WHERE n / med < 0.95)
SELECT unit, region, subject FROM cust ANTI JOIN rare USING (region, subject)""")
def rare_group_exclusion(spark, sf_dir):
    from tessella.operators.summary import without_rare

    return without_rare(customers(spark, sf_dir), 0.95).select("unit", "region", "subject")


NEAR = f"{PAIRS}, np AS (SELECT fix_id_i AS i, fix_id_j AS j, fi.flag AS flag_i, fj.flag AS flag_j FROM pairs JOIN fix fi ON fi.fix_id = fix_id_i JOIN fix fj ON fj.fix_id = fix_id_j WHERE d <= 1 AND trial_i <> trial_j)"
RESP = """resp AS (SELECT fix_id AS event, 'price' AS unit, price / 10000 AS resp FROM fix UNION ALL SELECT fix_id, 'tax', tax FROM fix UNION ALL SELECT fix_id, 'x', x FROM fix),
v AS (SELECT kp.*, ri.unit, ri.resp AS a, rj.resp AS b2 FROM kp JOIN resp ri ON ri.event = i JOIN resp rj ON rj.event = j AND rj.unit = ri.unit)"""
WHOLE = f"""{NEAR}, kp AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS k, count(*) OVER () AS n FROM np), {RESP}"""


def near_pairs(spark, sf_dir):
    found = pr.return_pairs(fixations(spark, sf_dir), 1.0, keep=("trial", "flag"))
    return pr.different(found, "trial").select(F.col("fix_id_i").alias("i"), F.col("fix_id_j").alias("j"), "flag_i", "flag_j")


def responses(spark, sf_dir):
    rows = fixations(spark, sf_dir)
    return rows.select(F.col("fix_id").alias("event"), F.expr("stack(3, 'price', price / 10000, 'tax', tax, 'x', x) as (unit, resp)"))


_R = "CASE WHEN count(*) >= 2 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN least(greatest(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})), -1.0), 1.0) END"


@query(f"""WITH {WHOLE},
ob AS (SELECT unit, count(*) AS n, {_R.format(x="x", y="y")} AS r FROM (SELECT unit, CASE WHEN f THEN b2 ELSE a END AS x, CASE WHEN f THEN a ELSE b2 END AS y FROM (SELECT *, {D.format("'c-side', k")} % 2 = 1 AS f FROM v)) GROUP BY unit),
sl AS (SELECT b, k AS s, {D.format("'c-boot', b, k")} % n AS k, {D.format("'c-boot-side', b, k")} % 2 = 1 AS f FROM kp, (SELECT unnest(range(0, {PAIR_BOOTS})) AS b)),
bt AS (SELECT unit, b, {_R.format(x="x", y="y")} AS r FROM (SELECT unit, b, CASE WHEN f THEN b2 ELSE a END AS x, CASE WHEN f THEN a ELSE b2 END AS y FROM sl JOIN v USING (k)) GROUP BY ALL),
pl AS (SELECT k, b, row_number() OVER (PARTITION BY b ORDER BY {D.format("'c-perm', b, k")}, k) - 1 AS o, {D.format("'c-perm-side', b, k")} % 2 = 1 AS f FROM kp, (SELECT unnest(range(0, {PAIR_PERMS})) AS b)),
nl AS (SELECT u.unit, p.b, {_R.format(x="CASE WHEN p.f THEN u.b2 ELSE u.a END", y="CASE WHEN q.f THEN w.a ELSE w.b2 END")} AS r0
       FROM pl p JOIN pl q ON q.b = p.b AND q.k = p.o JOIN v u ON u.k = p.k JOIN v w ON w.k = q.k AND w.unit = u.unit GROUP BY ALL),
pv AS (SELECT unit, greatest(1.0 - count(*) FILTER (r - r0 > 0) / count(r0), 1.0 / (count(r0) + 1)) AS p FROM nl JOIN ob USING (unit) GROUP BY unit)
SELECT unit, n, round(r, 6) AS r, round(boot_mean, 6) AS boot_mean, round(boot_sd, 6) AS boot_sd, round(p, 6) AS p
FROM ob JOIN (SELECT unit, avg(r) AS boot_mean, stddev_pop(r) AS boot_sd FROM bt GROUP BY unit) USING (unit) JOIN pv USING (unit)""")
def self_consistency_perm_p(spark, sf_dir):
    """Over all near pairs, which bring their responses with them."""
    rows = fixations(spark, sf_dir).withColumns({"r0": F.col("price") / 10000, "r1": F.col("tax"), "r2": F.col("x")})
    found = pr.different(pr.return_pairs(rows, 1.0, keep=("trial", "r0", "r1", "r2")), "trial")
    placed = global_rank(found.select(F.col("fix_id_i").alias("i"), F.col("fix_id_j").alias("j"), *[f"r{c}_{s}" for c in range(3) for s in "ij"]), ["i", "j"], "k")
    values = placed.select((F.col("k") - 1).alias("k"), F.expr("stack(3, 'price', r0_i, r0_j, 'tax', r1_i, r1_j, 'x', r2_i, r2_j) as (unit, a, b)"))
    out = rs.value_consistency(values, PAIR_BOOTS, PAIR_PERMS, "c")
    return out.select("unit", "n", *[F.round(c, 6).alias(c) for c in ("r", "boot_mean", "boot_sd", "p")])


@query(f"""WITH {NEAR}, cn AS (SELECT i, j, CASE WHEN flag_i = flag_j THEN 1 ELSE 0 END AS cond FROM np),
sz AS (SELECT *, {rs.MAX_PAIRS} AS most FROM (SELECT count(*) FILTER (cond = 0) AS n0, count(*) FILTER (cond = 1) AS n1 FROM cn)),
sm AS (SELECT *, least(CAST(round_even(2 + (most - 2) / sqrt((n0 + n1) / 2.0 - 2) * sqrt(greatest(least(n0, n1) - 2, 0)), 0) AS BIGINT), least(n0, n1)) AS kept FROM sz),
s0 AS (SELECT CASE WHEN n0 + n1 <= 2 * most THEN n0 WHEN n0 <= n1 THEN kept ELSE 2 * most - kept END AS z, CASE WHEN n0 + n1 <= 2 * most THEN n1 WHEN n0 <= n1 THEN 2 * most - kept ELSE kept END AS o FROM sm),
cp AS (SELECT i, j, cond FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY {D.format("'cap', i, j")}, i, j) AS place FROM cn), s0 WHERE place <= CASE cond WHEN 0 THEN z ELSE o END),
kp AS (SELECT i, j, cond, row_number() OVER (ORDER BY i, j) - 1 AS k, count(*) OVER () AS n FROM cp), {RESP},
r AS (SELECT unit, cond, {_R.format(x="CASE WHEN f THEN b2 ELSE a END", y="CASE WHEN f THEN a ELSE b2 END")} AS r FROM (SELECT *, {D.format("'t-side', k")} % 2 = 1 AS f FROM v) GROUP BY ALL),
ob AS (SELECT unit, max(r) FILTER (cond = 0) AS r0, max(r) FILTER (cond = 1) AS r1 FROM r GROUP BY unit),
lb AS (SELECT b, k, {D.format("'t-label-side', b, k")} % 2 = 1 AS f, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY {D.format("'t-label', b, k")}, k) <= (SELECT count(*) FROM kp WHERE cond = 0) THEN 0 ELSE 1 END AS l FROM kp, (SELECT unnest(range(0, {PAIR_PERMS})) AS b)),
nr AS (SELECT unit, b, l, {_R.format(x="CASE WHEN f THEN b2 ELSE a END", y="CASE WHEN f THEN a ELSE b2 END")} AS r FROM lb JOIN v USING (k) GROUP BY ALL),
nl AS (SELECT unit, b, max(r) FILTER (l = 1) - max(r) FILTER (l = 0) AS d0 FROM nr GROUP BY ALL)
SELECT unit, round(r0, 6) AS r0, round(r1, 6) AS r1, round(greatest(1.0 - count(*) FILTER (abs(r1 - r0) - abs(d0) > 0) / count(d0), 1.0 / (count(d0) + 1)), 6) AS p FROM nl JOIN ob USING (unit) GROUP BY unit, r0, r1""")
def two_condition_perm_p(spark, sf_dir):
    found = near_pairs(spark, sf_dir).select("i", "j", (F.col("flag_i") == F.col("flag_j")).cast("int").alias("cond"))
    pairs = rs.numbered(rs.subsampled(found, ["i", "j"], "cap"), ["i", "j"])
    out = rs.two_condition_test(pairs, responses(spark, sf_dir), PAIR_PERMS, "t")
    return out.select("unit", *[F.round(c, 6).alias(c) for c in ("r0", "r1", "p")])


@query(f"""WITH c AS (SELECT l_linestatus AS status, count(*) FILTER (l_returnflag = 'R') AS n0, count(*) FILTER (l_returnflag <> 'R') AS n1, {rs.MAX_PAIRS} AS most FROM lineitem GROUP BY 1),
k AS (SELECT *, least(CAST(round_even(2 + (most - 2) / sqrt((n0 + n1) / 2.0 - 2) * sqrt(greatest(least(n0, n1) - 2, 0)), 0) AS BIGINT), least(n0, n1)) AS kept FROM c)
SELECT status, n0, n1, CASE WHEN n0 + n1 <= 2 * most THEN n0 WHEN n0 <= n1 THEN kept ELSE 2 * most - kept END AS kept0, CASE WHEN n0 + n1 <= 2 * most THEN n1 WHEN n0 <= n1 THEN 2 * most - kept ELSE kept END AS kept1 FROM k""")
def subsample_rule(spark, sf_dir):
    """How many of two conditions of unequal size a test keeps."""
    line = table(spark, sf_dir, "lineitem")
    sizes = line.groupBy(F.col("l_linestatus").alias("status")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n0"), F.count_if(F.col("l_returnflag") != "R").alias("n1"))
    kept0, kept1 = rs.subsample_size_columns(F.col("n0"), F.col("n1"))
    return sizes.select("status", "n0", "n1", kept0.alias("kept0"), kept1.alias("kept1"))


def bijections(seed: str, sizes: str) -> str:
    """``draws.places`` in SQL: pm (n, b, k, x) for every n of a query, each replicate and place; needs WITH RECURSIVE."""
    key = lambda w: word(f"h{w // 4}", w % 4)
    said = f"""bk AS (SELECT b, {", ".join(f"{key(w)} AS q{w}" for w in range(2 * draws.STEPS))} FROM (SELECT b, {", ".join(f"md5('{seed}:' || b || ':{i}') AS h{i}" for i in range(draws.STEPS // 2))} FROM (SELECT unnest(range(0, {PERMS})) AS b))),
dm AS (SELECT n, hi, (n + hi - 1) // hi AS lo FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS hi FROM ({sizes}))),
wk AS (SELECT n, hi, lo, b, k, k AS x, 0 AS turn FROM dm, (SELECT unnest(range(0, {PERMS})) AS b), LATERAL (SELECT unnest(range(0, n)) AS k)
  UNION ALL SELECT n, hi, lo, b, k, l * lo + r, turn + 1 FROM """
    step = "(SELECT wk.*, x // lo AS l, x % lo AS r FROM wk WHERE turn = 0 OR x >= n) JOIN bk USING (b)"
    for i in range(draws.STEPS):
        one, two, size = ("r", "l", "hi") if i % 2 == 0 else ("l", "r", "lo")
        mixed = f"(SELECT *, (xor(m, m >> 15) * {int(draws.SPREAD)} & 4294967295) >> 16 AS f FROM (SELECT *, ({one} * (q{2 * i} | 1) + q{2 * i + 1}) & 4294967295 AS m FROM {step}))"
        step = f"(SELECT n, hi, lo, b, k, turn, {one}, ({two} + (f * {size} >> 16)) % {size} AS {two}, {', '.join(f'q{w}' for w in range(2 * i + 2, 2 * draws.STEPS)) or '0 AS q'} FROM {mixed})"
    return said + step + "),\npm AS (SELECT n, b, k, x FROM wk WHERE turn > 0 AND x < n)"


SPENT = "sp AS (SELECT region, unit, value AS x, CAST(coalesce(sum(o_totalprice), 0) AS DOUBLE) AS y FROM cust LEFT JOIN orders ON o_custkey = unit GROUP BY region, unit, value)"


@query(f"""WITH RECURSIVE {CUST}, {SPENT}, pl AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY unit) - 1 AS k, count(*) OVER (PARTITION BY region) AS n FROM sp),
{bijections("q", "SELECT DISTINCT n FROM pl")},
ob AS (SELECT region, n, {_R.format(x="x", y="y")} AS r, avg(x) AS mx, avg(y) AS my, sqrt(regr_sxx(x, x) * regr_sxx(y, y)) AS sd FROM pl GROUP BY region, n),
nl AS (SELECT u.region, pm.b, sum((u.x - mx) * (v.y - my)) / any_value(sd) AS r0, any_value(r) AS r FROM ob JOIN pm ON pm.n = ob.n JOIN pl u ON u.region = ob.region AND u.k = pm.k JOIN pl v ON v.region = ob.region AND v.k = pm.x GROUP BY ALL)
SELECT region, round(r, 6) AS r, round(greatest(avg(CASE WHEN r0 >= r - {pm.TIE} THEN 1.0 ELSE 0.0 END), 1.0 / (count(*) + 1)), 6) AS p FROM nl GROUP BY region, r""")
def correlation_perm_test(spark, sf_dir):
    """Whether customers with more on their account order more, by region."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.sum("o_totalprice").alias("y"))
    rows = customers(spark, sf_dir).join(orders, "unit", "left").select("region", "unit", "value", F.coalesce("y", F.lit(0.0)).alias("y"))
    out = pm.corr_perm_test(rows, PERMS, "q", ["region"], "unit", "value", "y")
    return out.select("region", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@query(f"""WITH RECURSIVE {EV}, z AS (SELECT unit, event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS cond, t % 2 = 0 AS cat, value AS v FROM ev WHERE value IS NOT NULL),
pl AS (SELECT *, row_number() OVER (PARTITION BY unit, cat ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY unit, cat) AS n, count(*) FILTER (cond = 0) OVER (PARTITION BY unit, cat) AS n0 FROM z),
{bijections("i", "SELECT DISTINCT n FROM pl")},
ix AS (SELECT unit, b, CASE WHEN x < n0 THEN 0 ELSE 1 END AS l, avg(v) FILTER (cat) AS a, avg(v) FILTER (NOT cat) AS o FROM pl JOIN pm USING (n, k) GROUP BY ALL),
nl AS (SELECT unit, b, max((a - o) / nullif(a + o, 0)) FILTER (l = 1) - max((a - o) / nullif(a + o, 0)) FILTER (l = 0) AS d0 FROM ix GROUP BY ALL),
oi AS (SELECT unit, cond, avg(v) FILTER (cat) AS a, avg(v) FILTER (NOT cat) AS o FROM z GROUP BY ALL),
ob AS (SELECT unit, max((a - o) / nullif(a + o, 0)) FILTER (cond = 0) AS i0, max((a - o) / nullif(a + o, 0)) FILTER (cond = 1) AS i1 FROM oi GROUP BY unit)
SELECT unit, round(i0, 6) AS index0, round(i1, 6) AS index1, round(greatest(count(*) FILTER (abs(d0) >= abs(i1 - i0) - {pm.TIE}) / nullif(count(d0) FILTER (i1 - i0 IS NOT NULL), 0), 1.0 / (count(d0) + 1)), 6) AS p FROM nl JOIN ob USING (unit) GROUP BY unit, i0, i1""")
def selectivity_perm_test(spark, sf_dir):
    rows = events(spark, sf_dir)
    out = pm.index_perm_test(rows, PERMS, "i", "unit", "event_id", F.col("event_type").isin("view", "click").cast("int"), F.col("t") % 2 == 0, "value")
    return out.select("unit", *[F.round(c, 6).alias(c) for c in ("index0", "index1", "p")])


RANKS = """rk AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY value) + (count(*) OVER (PARTITION BY unit, value) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY unit, value) AS ties FROM ev),
ag AS (SELECT unit, count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type <> 'click') AS n2, sum(rank) FILTER (event_type = 'click') AS r1, sum(ties * ties - 1) AS t FROM rk GROUP BY unit)"""


@query(f"""WITH {EV}, {RANKS} SELECT unit, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u,
 round((r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))), 0), 6) AS z FROM ag WHERE n1 > 0 AND n2 > 0""")
def rank_sum_z(spark, sf_dir):
    out = ts.rank_sum(events(spark, sf_dir), F.col("value"), F.col("event_type") == "click", ["unit"])
    return out.select("unit", "n1", "n2", "u", F.round("z", 6).alias("z"))


def _horner(coefficients: list[float]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * x + {c!r})"
    return out


#: The tail of the normal distribution above ``abs(z)`` in SQL, over a subquery that names it x.
TAIL = f"CASE WHEN x < {ts.HART_FAR} THEN exp(-x * x / 2) * {_horner(ts.HART_ABOVE)} / {_horner(ts.HART_BELOW)} ELSE exp(-x * x / 2) / (x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + {ts.HART_FRACTION}))))) / {ts.HART_ROOT} END"


@query(f"""WITH RECURSIVE {EV}, {RANKS},
ts AS (SELECT unit, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, t, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM ag WHERE n1 > 0 AND n2 > 0),
st AS (SELECT *, t = 0 AND least(n1, n2) <= 8 AS exact, greatest(u, n1 * n2 - u) AS s FROM ts),
g(a, b, i, w) AS (
  SELECT DISTINCT least(n1, n2), greatest(n1, n2), 0, list_transform(range(0, n1 * n2 + 1), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM st WHERE exact
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(0, a * b + 1), lambda k: list_sum(list_transform(range(0, k // (i + 1) + 1), lambda q: m[k - q * (i + 1) + 1])))
  FROM (SELECT a, b, i, list_transform(range(0, a * b + 1), lambda k: w[k + 1] - CASE WHEN k >= b + i + 1 THEN w[k - b - i] ELSE 0 END) AS m FROM g WHERE i < a)),
nm AS (SELECT *, abs((s - n1 * n2 / 2.0 - 0.5) / nullif(sd, 0)) AS x, (s - n1 * n2 / 2.0 - 0.5) >= 0 AS above FROM st)
SELECT unit, n1, n2, u, round(least(CASE WHEN exact THEN 2 * list_sum(w[CAST(s AS BIGINT) + 1:]) / list_sum(w) WHEN above THEN 2 * ({TAIL}) ELSE 2 * (1 - ({TAIL})) END, 1.0), 8) AS p
FROM nm LEFT JOIN g ON exact AND a = least(n1, n2) AND b = greatest(n1, n2) AND i = a""")
def rank_sum_p(spark, sf_dir):
    out = ts.rank_sum_p(ts.rank_sum(events(spark, sf_dir), F.col("value"), F.col("event_type") == "click", ["unit"]))
    return out.select("unit", "n1", "n2", "u", F.round("p", 8).alias("p"))


@query(f"""WITH {FIX}, dd AS (SELECT image AS unit, price / 10000 - x / 5 AS d FROM fix), k AS (SELECT * FROM dd WHERE d <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY abs(d)) + (count(*) OVER (PARTITION BY unit, abs(d)) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY unit, abs(d)) AS ties FROM k),
ag AS (SELECT unit, count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w, sum(ties * ties - 1) AS t FROM rk GROUP BY unit HAVING count(*) >= 2)
SELECT unit, n, CAST(w AS DOUBLE) AS w, round((w - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0), 0), 6) AS z FROM ag""")
def signed_rank_z(spark, sf_dir):
    rows = fixations(spark, sf_dir).withColumn("unit", F.col("image"))
    return ts.signed_rank(rows, F.col("price") / 10000 - F.col("x") / 5, ["unit"]).select("unit", "n", "w", F.round("z", 6).alias("z"))


@query(f"""WITH RECURSIVE {FIX}, dd AS (SELECT image AS unit, price / 10000 - x / 5 AS d FROM fix), k AS (SELECT * FROM dd WHERE d <> 0),
zr AS (SELECT DISTINCT unit FROM dd WHERE d = 0),
rk AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY abs(d)) + (count(*) OVER (PARTITION BY unit, abs(d)) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY unit, abs(d)) AS ties FROM k),
ag AS (SELECT unit, count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w, sum(ties * ties - 1) AS t FROM rk GROUP BY unit HAVING count(*) >= 2),
ways(m, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT m + 1, list_transform(range(0, len(c) + m + 1), lambda s: coalesce(c[s + 1], 0) + CASE WHEN s > m THEN c[s - m] ELSE 0 END) FROM ways WHERE m < 50),
st AS (SELECT ag.*, t = 0 AND n <= 50 AND zr.unit IS NULL AS exact, abs((w - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0), 0)) AS x FROM ag LEFT JOIN zr USING (unit))
SELECT unit, n, round(CASE WHEN exact THEN least(2 * least(list_sum(c[CAST(w AS BIGINT) + 1:]), list_sum(c[:CAST(w AS BIGINT) + 1])) / pow(2, n), 1.0) ELSE 2 * ({TAIL}) END, 8) AS p
FROM st LEFT JOIN ways ON exact AND m = n""")
def signed_rank_p(spark, sf_dir):
    rows = fixations(spark, sf_dir).withColumn("unit", F.col("image"))
    out = ts.signed_rank_p(ts.signed_rank(rows, F.col("price") / 10000 - F.col("x") / 5, ["unit"]))
    return out.select("unit", "n", F.round("p", 8).alias("p"))


def bky_sql(scope: str) -> str:
    """Step-up in two stages over p-like numbers of the parts."""
    by = f"PARTITION BY {scope}" if scope else ""
    return f"""WITH {FIX}, pv AS (SELECT image, flag, min(tax + price / 1e9) * min(x) / 50 / 5 AS p FROM fix GROUP BY ALL),
a AS (SELECT *, count(*) OVER ({by}) AS m, row_number() OVER ({by} ORDER BY p) AS k FROM pv),
b AS (SELECT *, coalesce(max(CASE WHEN p <= (0.05 / 1.05) * k / m THEN k END) OVER ({by}), 0) AS r1 FROM a),
c AS (SELECT *, coalesce(max(CASE WHEN p <= CASE WHEN r1 < m THEN (0.05 / 1.05) * m / (m - r1) ELSE 1.0 END * k / m THEN k END) OVER ({by}), 0) AS r2 FROM b)
SELECT image, flag, r1 > 0 AND (r1 = m OR k <= r2) AS reject,
 round(least(least(min(p * m / k) OVER ({by} ORDER BY k DESC), 1.0) * CASE WHEN r1 > 0 AND r1 < m THEN (m - r1) / CAST(m AS DOUBLE) ELSE 1.0 END * 1.05, 1.0), 8) AS p_adj FROM c"""


def p_like(spark, sf_dir):
    rows = fixations(spark, sf_dir)
    return rows.groupBy("image", "flag").agg((F.min(F.col("tax") + F.col("price") / 1e9) * F.min("x") / 50 / 5).alias("p"))


@query(bky_sql(""))
def fdr_bky_reject(spark, sf_dir):
    return ts.fdr_two_stage(p_like(spark, sf_dir), 0.05).select("image", "flag", "reject", F.round("p_adj", 8).alias("p_adj"))


@query(bky_sql("flag"))
def fdr_bky_by_scope(spark, sf_dir):
    return ts.fdr_two_stage(p_like(spark, sf_dir), 0.05, ("flag",)).select("image", "flag", "reject", F.round("p_adj", 8).alias("p_adj"))
