"""Pair queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.moments import pearson
from tessella.functions.scalars import distance
from tessella.operators import events as ev
from tessella.operators import pairs as pr
from tessella.plans.q_events import CLEAN, cleaned
from tessella.plans.registry import query
from tessella.plans.views import FIX, fixations
from tessella.scratch import materialize

PAIRS = f"""{FIX}, pairs AS (
  SELECT i.image, i.fix_id AS fix_id_i, j.fix_id AS fix_id_j, i.trial AS trial_i, j.trial AS trial_j, i.price AS price_i, j.price AS price_j,
         sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS d
  FROM fix i JOIN fix j ON i.image = j.image AND i.fix_id < j.fix_id)"""


def near(spark, sf_dir, threshold=2.0, keep=("trial", "price")):
    return pr.return_pairs(fixations(spark, sf_dir), threshold, keep=keep)


@query(f"WITH {PAIRS} SELECT image, fix_id_i, fix_id_j, round(d, 6) AS d FROM pairs WHERE d <= 2")
def return_pairs(spark, sf_dir):
    return near(spark, sf_dir).select("image", "fix_id_i", "fix_id_j", F.round("d", 6).alias("d"))


@query(f"WITH {PAIRS} SELECT image, count(*) AS n, round(avg(d), 6) AS mean_d FROM pairs WHERE d > 20 GROUP BY image")
def distant_pairs(spark, sf_dir):
    return pr.all_pairs(fixations(spark, sf_dir), farther_than=20.0).groupBy("image").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_d"))


@query(f"WITH {PAIRS} SELECT image, count(*) AS n FROM pairs GROUP BY image")
def same_image_pairs(spark, sf_dir):
    return pr.all_pairs(fixations(spark, sf_dir)).groupBy("image").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS}, t(threshold) AS (VALUES (0.5), (1.0), (2.0), (3.0)) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n, round(avg(d), 6) AS mean_d FROM pairs, t WHERE d <= threshold AND trial_i <> trial_j GROUP BY 1")
def pair_threshold_ladder(spark, sf_dir):
    steps = pr.ladder(pr.different(near(spark, sf_dir, 3.0), "trial"), [0.5, 1, 2, 3])
    return steps.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_d"))


@query(f"""WITH {FIX}, p AS (SELECT i.image, i.fix_id AS fix_id_i, j.fix_id AS fix_id_j FROM fix i JOIN fix j ON i.image = j.image AND i.fix_id < j.fix_id
  AND sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) <= 3 AND abs(i.t0 - j.t0) >= 200) SELECT * FROM p""")
def return_pairs_apart_in_time(spark, sf_dir):
    rows = fixations(spark, sf_dir).withColumnRenamed("t0", "time")
    return pr.return_pairs(rows, 3.0, least_time=200).select("image", "fix_id_i", "fix_id_j")


MOVED = f"""{CLEAN},
step AS (
  SELECT trial, fix_id AS to_id, image, x, y, flag_of.flag AS to_category, ord AS to_ord, t0 AS to_start, lag(fix_id) OVER w AS from_id, lag(ord) OVER w AS from_ord, lag(t1) OVER w AS from_end,
         lag(x) OVER w AS fx, lag(y) OVER w AS fy, lag(flag_of.flag) OVER w AS from_category, lag(image) OVER w AS from_image
  FROM ranked JOIN (SELECT fix_id, flag FROM fix) flag_of USING (fix_id) WINDOW w AS (PARTITION BY trial ORDER BY ord, fix_id)),
mv AS (SELECT *, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS size FROM step WHERE from_ord = to_ord - 1),
mp AS (SELECT i.image, i.to_id AS to_id_i, j.to_id AS to_id_j, sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS d
       FROM mv i JOIN mv j ON i.image = j.image AND i.to_id < j.to_id WHERE sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) <= 3)"""


def move_table(spark, sf_dir):
    return moves_of(cleaned(spark, sf_dir))


def moves_of(rows, *more):
    w = Window.partitionBy("trial").orderBy("ord", "fix_id")
    before = lambda c: F.lag(c).over(w)
    step = rows.select(
        "trial", F.col("fix_id").alias("to_id"), "image", "x", "y", F.col("flag").alias("to_category"), F.col("ord").alias("to_ord"), F.col("t0").alias("to_start"), before("fix_id").alias("from_id"),
        before("ord").alias("from_ord"), before("t1").alias("from_end"), before("x").alias("fx"), before("y").alias("fy"), before("flag").alias("from_category"), before("image").alias("from_image"), *more,
    )
    return step.where("from_ord = to_ord - 1").withColumn("size", distance(F.col("fx"), F.col("fy"), F.col("x"), F.col("y")))


def _beside(side: str) -> str:
    fits = "e.ord <= m.from_ord AND e.t1 > m.from_end - 100" if side == "current" else "e.ord >= m.to_ord AND e.t0 <= m.to_start + 100"
    return f"""WITH {MOVED}, pf AS (SELECT i.to_id AS to_id_i, j.to_id AS to_id_j, sqrt((i.fx - j.fx) * (i.fx - j.fx) + (i.fy - j.fy) * (i.fy - j.fy)) AS d
  FROM mv i JOIN mv j ON i.from_image = j.from_image AND i.to_id < j.to_id WHERE sqrt((i.fx - j.fx) * (i.fx - j.fx) + (i.fy - j.fy) * (i.fy - j.fy)) <= 3),
found AS (SELECT to_id_i, to_id_j, d FROM {"mp" if side == "current" else "pf"}),
beside AS (SELECT m.to_id AS k, e.x, e.y FROM mv m JOIN ranked e ON e.trial = m.trial AND {fits}),
near AS (SELECT to_id_i, to_id_j FROM found JOIN beside i ON i.k = to_id_i JOIN beside j ON j.k = to_id_j GROUP BY ALL HAVING min(sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y))) < 4)
SELECT to_id_i, to_id_j, round(d, 6) AS d FROM found ANTI JOIN near USING (to_id_i, to_id_j)"""


def _decorrelated(spark, sf_dir, side):
    """Pairs that return to a place with what they land on (current) or what they leave (previous)."""
    seen = F.collect_list(F.struct("ord", "t0", "t1", "x", "y")).over(Window.partitionBy("trial")).alias("seen")
    moves = pr.beside(moves_of(cleaned(spark, sf_dir), seen), side, 100)
    places = moves if side == "current" else moves.drop("image", "x", "y").withColumnsRenamed({"from_image": "image", "fx": "x", "fy": "y"})
    found = pr.return_pairs(places, 3.0, key="to_id", keep=("beside",))
    return pr.decorrelated(found, 4.0).select("to_id_i", "to_id_j", F.round("d", 6).alias("d"))


@query(_beside("current"))
def decorrelated_pairs(spark, sf_dir):
    return _decorrelated(spark, sf_dir, "current")


@query(_beside("previous"))
def decorrelated_previous_pairs(spark, sf_dir):
    return _decorrelated(spark, sf_dir, "previous")


@query(f"""WITH {CLEAN}, p AS (SELECT i.fix_id AS fi, j.fix_id AS fj, i.trial AS ti, j.trial AS tj, i.trial_time AS si, i.trial_time + i.duration AS ei, j.trial_time AS sj, j.trial_time + j.duration AS ej
  FROM ranked i JOIN ranked j ON i.image = j.image AND i.fix_id < j.fix_id AND sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) <= 3),
b(bin, lo, hi) AS (VALUES (0, 0, 200), (1, 200, 600), (2, 600, 1400))
SELECT DISTINCT bin, least(ti, tj) AS trial_i, greatest(ti, tj) AS trial_j FROM p, b WHERE si < hi AND ei >= lo AND sj < hi AND ej >= lo AND ti <> tj""")
def trial_pairs_per_bin(spark, sf_dir):
    found = pr.return_pairs(cleaned(spark, sf_dir), 3.0, keep=("trial", "trial_time", "duration"))
    return pr.trial_pairs_per_bin(found, [(0, 200), (200, 600), (600, 1400)])


_DRAW = "CAST(('0x' || substr(md5(concat_ws(':', {})), 1, 8)) AS BIGINT)"


@query(f"""WITH {MOVED}, s AS (SELECT * FROM mv WHERE to_category = 'R'),
both_ways AS (SELECT i.to_id AS a, j.to_id AS b, i.fx AS ax, i.fy AS ay, j.fx AS bx, j.fy AS byy, j.from_category AS cat FROM s i JOIN s j ON i.image = j.image AND i.to_id <> j.to_id
  AND sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) <= 3),
c AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY {_DRAW.format("'m', a, b")}, a, b) AS k FROM both_ways WHERE cat <> 'R' AND sqrt((ax - bx) * (ax - bx) + (ay - byy) * (ay - byy)) >= 4)
SELECT a AS source, b AS match FROM c WHERE k = 1""")
def matched_control(spark, sf_dir):
    return pr.matched_moves(move_table(spark, sf_dir).withColumnRenamed("to_id", "move_id"), 3.0, 4.0, "R", "m")


@query(f"""WITH {FIX}, sp AS (SELECT i.fix_id AS a, j.fix_id AS b, sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS d, i.price AS pa, j.price AS pb
  FROM fix i JOIN fix j ON i.image = j.image AND i.fix_id < j.fix_id AND sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) <= 3 WHERE i.flag = 'R' AND j.flag = 'R'),
op AS (SELECT i.fix_id AS a, j.fix_id AS b, sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS d
  FROM fix i JOIN fix j ON i.image = j.image AND i.fix_id <> j.fix_id AND sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) <= 3),
c AS (SELECT sp.a, sp.b, x.b AS m0, y.b AS m1 FROM sp JOIN op x ON x.a = sp.a JOIN op y ON y.a = sp.b WHERE x.b <> y.b AND x.d <= sp.d AND y.d <= sp.d AND x.b <> sp.b AND y.b <> sp.a
  AND NOT EXISTS (SELECT 1 FROM sp q WHERE (q.a = x.b AND q.b = y.b) OR (q.b = x.b AND q.a = y.b))),
x0 AS (SELECT sp.a, sp.b, o.b AS m0, row_number() OVER (PARTITION BY sp.a, sp.b ORDER BY {_DRAW.format("'p-a', sp.a, sp.b, o.b")}, o.b) AS r0 FROM sp JOIN op o ON o.a = sp.a AND o.d <= sp.d),
x1 AS (SELECT sp.a, sp.b, o.b AS m1, row_number() OVER (PARTITION BY sp.a, sp.b ORDER BY {_DRAW.format("'p-b', sp.a, sp.b, o.b")}, o.b) AS r1 FROM sp JOIN op o ON o.a = sp.b AND o.d <= sp.d),
r AS (SELECT a, b, m0, m1, row_number() OVER (PARTITION BY a, b ORDER BY greatest(r0, r1), r0, r1) AS k FROM c JOIN x0 USING (a, b, m0) JOIN x1 USING (a, b, m1))
SELECT a, b, m0, m1 FROM r WHERE k = 1""")
def matched_pairs(spark, sf_dir):
    rows = fixations(spark, sf_dir)
    found = materialize(pr.return_pairs(rows, 3.0, keep=("flag",)).drop("image"), "near-pairs")
    sources = found.where("flag_i = 'R' and flag_j = 'R'").select(F.col("fix_id_i").alias("a"), F.col("fix_id_j").alias("b"), "d")
    return pr.matched_pairs(sources, pr.symmetric(found), (F.col("m0") != F.col("b")) & (F.col("m1") != F.col("a")), "p")


#: Pairs that a sample is of, and draws that are enough for them at every scale of the SQL.
SAMPLE, DRAWS = 10_000, 80_000


@query(f"""WITH {FIX}, pl AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY fix_id) - 1 AS k FROM fix),
gr AS (SELECT image, n * (n - 1) // 2 AS p FROM (SELECT image, count(*) AS n FROM fix GROUP BY image) WHERE n > 1),
en AS (SELECT image, p, CAST(sum(p) OVER (ORDER BY image) AS BIGINT) AS e, CAST(sum(p) OVER () AS BIGINT) AS total FROM gr),
dr AS (SELECT i, CAST(('0x' || substr(md5('far:' || i), 1, 15)) AS BIGINT) % (SELECT any_value(total) FROM en) AS num FROM (SELECT unnest(range(0, {DRAWS})) AS i)),
lo AS (SELECT image, num - (e - p) AS t, min(i) AS i FROM dr ASOF JOIN en ON dr.num < en.e GROUP BY ALL),
ij AS (SELECT image, i, j, t - j * (j - 1) // 2 AS o FROM (SELECT *, CAST(floor((sqrt(8.0 * t + 1) + 1) / 2) AS BIGINT) AS j FROM lo)),
dd AS (SELECT ij.i, a.image, a.fix_id AS fix_id_i, b.fix_id AS fix_id_j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.trial AS ti, b.trial AS tj
  FROM ij JOIN pl a ON a.image = ij.image AND a.k = o JOIN pl b ON b.image = ij.image AND b.k = j),
al AS (SELECT a.image, a.fix_id AS fix_id_i, b.fix_id AS fix_id_j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.trial AS ti, b.trial AS tj FROM fix a JOIN fix b ON a.image = b.image AND a.fix_id < b.fix_id),
pk AS (SELECT image, fix_id_i, fix_id_j, d, i, 0 AS s FROM dd WHERE d > 15 AND ti <> tj AND (SELECT any_value(total) FROM en) > {pr.LISTED * SAMPLE}
  UNION ALL SELECT image, fix_id_i, fix_id_j, d, {_DRAW.format("'far', fix_id_i, fix_id_j")}, fix_id_i FROM al WHERE d > 15 AND ti <> tj AND (SELECT any_value(total) FROM en) <= {pr.LISTED * SAMPLE})
SELECT image, fix_id_i, fix_id_j, round(d, 6) AS d FROM pk ORDER BY i, s, fix_id_j LIMIT {SAMPLE}""")
def distant_pair_sample(spark, sf_dir):
    """10,000 of the pairs on one image and of different trials that lie apart, as tests of pairs take them."""
    apart = (F.col("d") > 15) & (F.col("trial_i") != F.col("trial_j"))
    found = pr.sample_pairs(fixations(spark, sf_dir), SAMPLE, "far", apart, keep=("trial",))
    return found.select("image", "fix_id_i", "fix_id_j", F.round("d", 6).alias("d"))


@query(f"""WITH {MOVED}, c AS (SELECT i.to_id AS a, j.to_id AS b, row_number() OVER (PARTITION BY i.to_id ORDER BY {_DRAW.format("'o', i.to_id, j.to_id")}, i.to_id, j.to_id) AS k
  FROM mv i JOIN mv j ON i.image = j.image AND i.to_id <> j.to_id AND sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) <= 3
  WHERE sqrt((i.fx - j.fx) * (i.fx - j.fx) + (i.fy - j.fy) * (i.fy - j.fy)) >= 4)
SELECT a AS source, b AS match FROM c WHERE k = 1""")
def one_sided_match(spark, sf_dir):
    moves = move_table(spark, sf_dir).withColumnsRenamed({"fx": "ux", "fy": "uy"})
    found = pr.return_pairs(moves, 3.0, key="to_id", keep=("ux", "uy"))
    return pr.one_sided_match(pr.symmetric(found, "to_id", ("ux", "uy")), 4.0, "o")


@query(f"""WITH {PAIRS}, z AS (SELECT image, price_i / 10000 AS a, price_j / 10000 AS b FROM pairs WHERE d <= 5),
m AS (SELECT image, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM z GROUP BY image)
SELECT image, n, CASE WHEN n >= 2 AND va > 0 AND vb > 0 THEN round(least(greatest(c / sqrt(va * vb), -1.0), 1.0), 6) END AS r FROM m""")
def pair_self_consistency(spark, sf_dir):
    found = near(spark, sf_dir, 5.0)
    return found.groupBy("image").agg(F.count("*").alias("n"), F.round(pearson(F.col("price_i") / 10000, F.col("price_j") / 10000), 6).alias("r"))


@query(f"""WITH {CLEAN}, s AS (SELECT DISTINCT image FROM ranked WHERE ord = 0)
SELECT trial, fix_id FROM ranked WHERE image IN (SELECT image FROM s)""")
def image_set_equalised(spark, sf_dir):
    """Events on images that have a zeroth event, too (semi-join on distinct images)."""
    rows = cleaned(spark, sf_dir)
    return rows.join(ev.by_ordinal(rows, "zeroth").select("image").distinct(), "image", "left_semi").select("trial", "fix_id")


@query(f"WITH {PAIRS} SELECT DISTINCT least(trial_i, trial_j) AS a, greatest(trial_i, trial_j) AS b FROM pairs WHERE d <= 2 ORDER BY a, b")
def canonical_pair_order(spark, sf_dir):
    both = near(spark, sf_dir).select(F.col("trial_i").alias("a"), F.col("trial_j").alias("b"))
    return pr.canonical(both).orderBy("a", "b")
