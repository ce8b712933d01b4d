"""Queries over points, tiles, landmarks and descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import decisions, registration, scoring, tiling
from ..sources.io import table
from .queries import H, STEP, TILE, W, query

POINTS = f"""p AS (SELECT l_orderkey, l_linenumber, (l_extendedprice * 7 + l_orderkey) % {W + 300} - 100 AS x, (l_extendedprice * 3 + l_quantity) % {H} AS y FROM lineitem),
xs AS (SELECT unnest([0, 1024, 2048, {W - TILE}]) AS x0, unnest(range(4)) AS col), ys AS (SELECT unnest([0, 1024, {H - TILE}]) AS y0, unnest(range(3)) AS row),
j AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, x, y ORDER BY (x - x0 - {TILE // 2}) ** 2 + (y - y0 - {TILE // 2}) ** 2, row, col) AS k
FROM p JOIN xs ON x >= x0 AND x < x0 + {TILE} JOIN ys ON y >= y0 AND y < y0 + {TILE})"""


def _points(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ((F.col("l_extendedprice") * 7 + F.col("l_orderkey")) % (W + 300) - 100).alias("x"), ((F.col("l_extendedprice") * 3 + F.col("l_quantity")) % H).alias("y"))


def _owner():
    return tiling.owner_of(F.col("x"), F.col("y"), F.lit(W), F.lit(H), TILE, STEP)


@query(f"""WITH {POINTS} SELECT 'r' || row || 'c' || col AS tile_id, count(*) AS n, round(sum(x - x0), 3) AS sum_x, round(sum(y - y0), 3) AS sum_y FROM j WHERE k = 1 GROUP BY 1""")
def tile_places(spark, d):
    p = _points(spark, d).filter((F.col("x") >= 0) & (F.col("x") < W)).withColumn("o", tiling.owned_or_fail(_owner(), F.col("l_orderkey")))
    return p.groupBy("o.tile_id").agg(F.count("*").alias("n"), F.round(F.sum("o.tile_x"), 3).alias("sum_x"), F.round(F.sum("o.tile_y"), 3).alias("sum_y"))


@query(f"WITH {POINTS} SELECT l_linenumber, count(*) AS n, count(*) FILTER (x < 0 OR x >= {W}) AS n_orphans FROM p GROUP BY 1")
def tile_orphans(spark, d):
    p = _points(spark, d).withColumn("o", _owner())
    return p.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("o").isNull()).alias("n_orphans"))


@query("""WITH i AS (SELECT o_custkey AS axis, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 300 AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY axis ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
e AS (SELECT axis, min(a) AS first, max(b) AS last FROM i GROUP BY 1)
SELECT axis, reach AS gap_start, a AS gap_stop FROM m WHERE a > reach UNION ALL SELECT axis, 0, first FROM e WHERE first > 0 UNION ALL SELECT axis, last, 2600 FROM e WHERE last < 2600""")
def tile_coverage_edges(spark, d):
    a = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    i = table(spark, d, "orders").select(F.col("o_custkey").alias("axis"), a.alias("a"), (a + 300).alias("b"))
    return tiling.uncovered_within(i, "axis", "a", "b", F.lit(0), F.lit(2600))


@query("""WITH k AS (SELECT l_suppkey % 8 AS cx, l_partkey % 8 AS cy, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey % 8, l_partkey % 8 ORDER BY l_orderkey * 10 + l_linenumber, l_extendedprice) AS k FROM lineitem)
SELECT cx, cy, id FROM k WHERE k <= 1 ORDER BY cx, cy, id LIMIT 50""")
def spread_sample(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("cx"), (F.col("l_partkey") % 8).alias("cy"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return tiling.thin_to(p, ["cx", "cy"], "id", 50, 64)


@query(f"""SELECT l_linenumber, count(*) FILTER (l_extendedprice % {W} - 400 >= 0 AND (l_extendedprice * 3) % {H} - 400 >= 0 AND l_extendedprice % {W} + 400 <= {W} AND (l_extendedprice * 3) % {H} + 400 <= {H}) AS n_inside, count(*) AS n FROM lineitem GROUP BY 1""")
def crops_in_frame(spark, d):
    x, y = F.col("l_extendedprice") % W, (F.col("l_extendedprice") * 3) % H
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(geometry.crop_inside(x, y, F.lit(400), F.lit(W), F.lit(H))).alias("n_inside"), F.count("*").alias("n"))


@query("""SELECT p_partkey, round(CASE WHEN p_size * 3 BETWEEN 1 AND 100 THEN p_retailprice / (p_size * 3) END, 6) AS scale,
round(CASE WHEN p_size / 2.0::DOUBLE BETWEEN 0.5 AND 20 THEN p_size / 2.0::DOUBLE * p_retailprice / 100 / 2 END, 6) AS radius FROM part""")
def scales_and_radii(spark, d):
    scale = geometry.pixels_per_mm(F.col("p_retailprice").cast("double"), F.col("p_size") * 3)
    radius = geometry.radius_px(F.col("p_size") / F.lit(2.0), F.col("p_retailprice").cast("double") / 100)
    return table(spark, d, "part").select("p_partkey", F.round(scale, 6).alias("scale"), F.round(radius, 6).alias("radius"))


@query("""WITH a AS (SELECT event_id, radians(event_id % 170 - 85) AS y, radians(event_id % 360 - 180) AS x, radians(event_id * 7 % 360 - 180) AS z FROM events WHERE event_type = 'click'),
m AS (SELECT event_id, cos(z) * cos(y) AS r00, sin(z) * cos(y) AS r10, -sin(y) AS r20, cos(y) * sin(x) AS r21, cos(y) * cos(x) AS r22 FROM a)
SELECT event_id, round(degrees(atan2(r21, r22)), 6) + 0.0 AS pitch, round(degrees(atan2(-r20, sqrt(r00 * r00 + r10 * r10))), 6) + 0.0 AS yaw, round(degrees(atan2(r10, r00)), 6) + 0.0 AS roll FROM m""")
def euler_angles(spark, d):
    e = table(spark, d, "events").filter("event_type = 'click'").select("event_id", F.radians(F.col("event_id") % 360 - 180).alias("x"), F.radians(F.col("event_id") % 170 - 85).alias("y"), F.radians(F.col("event_id") * 7 % 360 - 180).alias("z"))
    cx, sx, cy, sy, cz, sz = (f(c) for c in "xyz" for f in (F.cos, F.sin))
    r = [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]
    return e.select("event_id", *((F.round(a, 6) + 0.0).alias(n) for a, n in zip(geometry.euler_degrees(r), ("pitch", "yaw", "roll"))))


@query("""WITH c AS (SELECT p_partkey, p_size % 17 / 4.0::DOUBLE AS x, p_size % 13 / 4.0::DOUBLE AS y, 0.5::DOUBLE + p_size % 6 AS r FROM part)
SELECT p_partkey, count(*) FILTER ((i - x) * (i - x) + (j - y) * (j - y) <= r * r) AS n_pixels FROM c, range(-10, 20) a(i), range(-10, 20) b(j) GROUP BY 1""")
def disc_pixels(spark, d):
    size = F.col("p_size")
    disc = geometry.disc_pixels(size % 17 / F.lit(4.0), size % 13 / F.lit(4.0), size % 6 + F.lit(0.5))
    return table(spark, d, "part").select("p_partkey", F.size(disc).cast("long").alias("n_pixels"))


@query("""SELECT p_partkey, CASE WHEN (abs(p_size - 25) + abs(p_size - 30)) / 2.0::DOUBLE >= (abs(p_retailprice % 50 - 25) + abs(p_retailprice % 50 - 15) + abs(p_retailprice % 50 - 25)) / 3.0::DOUBLE THEN 'left' ELSE 'right' END AS side,
round(CASE WHEN greatest(p_size, p_retailprice % 50) > 0 THEN (1 - least(p_size, p_retailprice % 50) / greatest(p_size, p_retailprice % 50)) * 100 END, 6) AS loss FROM part""")
def face_sides(spark, d):
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") % 50
    return table(spark, d, "part").select("p_partkey", decisions.near_side(F.array(a, a - 5), F.array(b, b + 10, b), F.lit(25)).alias("side"), F.round(decisions.lens_loss(a, b), 6).alias("loss"))


@query("""WITH v AS (SELECT vec_id, (vec_id * 2654435761 % 4294967296)::BIGINT AS bits FROM embeddings),
p AS (SELECT a.vec_id AS query, b.vec_id AS id, bit_count(xor(a.bits, b.bits))::BIGINT AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS k FROM p)
SELECT a.query, a.id AS nearest, a.d AS d1, b.d AS d2, a.d < 0.8::DOUBLE * b.d AS accepted FROM k a JOIN k b USING (query) WHERE a.k = 1 AND b.k = 2""")
def binary_ratio_test(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 2654435761 % 4294967296).cast("long").alias("bits"))
    return scoring.nearest_two_bits(v.filter("vec_id % 100 = 0"), v, "vec_id", "bits", 0.8)


@query("""SELECT l_linenumber, count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS r,
round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ** 2)), 5) AS t FROM lineitem GROUP BY 1""")
def correlation_by_line(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"))
    c = scoring.correlation(li, "a", "b", "l_linenumber")
    return c.select("l_linenumber", "n", F.round("r", 9).alias("r"), F.round("t", 5).alias("t"))


STATS = "SELECT user_id, event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1, 2"


def _stats(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.median("value").alias("median"))


@query(f"""WITH s AS ({STATS}), p AS (SELECT user_id, coalesce(min(event_type) FILTER (contains(event_type, 'urch')), arg_min(event_type, (median, event_type))) AS picked, arg_min(event_type, (median, event_type)) AS best, min(median) AS median FROM s GROUP BY 1)
SELECT user_id, picked, best, round(median, 9) AS median FROM p""")
def method_choice(spark, d):
    s = _stats(spark, d)
    best = scoring.best_base(s, "user_id", "event_type").withColumnRenamed("event_type", "best")
    review = scoring.picked(s, "user_id", "event_type", "urch").withColumnRenamed("event_type", "picked")
    return review.join(best, "user_id").select("user_id", "picked", "best", F.round("median", 9).alias("median"))


@query(f"""WITH s AS ({STATS}) SELECT event_type, round(quantile_cont(median, 0.5), 9) AS median, count(*) AS n_pairs FROM s GROUP BY 1""")
def median_of_medians(spark, d):
    return scoring.median_of_medians(table(spark, d, "events"), "user_id", "event_type", "value").withColumn("median", F.round("median", 9))


@query("""WITH d AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, sqrt((l_quantity - 25) ** 2 + (l_discount * 100 - 5) ** 2) AS d FROM lineitem)
SELECT l_suppkey, arg_min(id, (d, id)) AS id, round(min(d), 6) AS d FROM d WHERE d <= 3 GROUP BY 1""")
def grabbed_point(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y"))
    return scoring.nearest_within(p, "l_suppkey", 25.0, 5.0, 3.0).withColumn("d", F.round("d", 6))


@query("""WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang),
a AS (SELECT * FROM c UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c)
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM a""")
def pooled_scores(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return scoring.pooled(j.groupBy("lang").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn")), "lang")


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings), s AS (SELECT label, dim, stddev_pop(x) / 2.5::DOUBLE AS mm FROM e GROUP BY 1, 2)
SELECT dim % 6 AS region, count(*) AS n, round(avg(mm), 7) AS mean, round(max(mm), 7) AS worst, round(quantile_cont(mm, 0.5), 7) AS median, round(quantile_cont(mm, 0.95), 7) AS p95 FROM s GROUP BY 1""")
def region_stats(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).select("label", F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("x"))
    r = registration.region_stats(registration.landmark_spread(e, ["label", "dim"], ["x"]), F.col("dim") % 6, 2.5)
    return r.select("region", "n", *(F.round(c, 7).alias(c) for c in ("mean", "worst", "median", "p95")))


@query("""WITH w AS (SELECT source, min(lang) AS owner FROM documents GROUP BY 1)
SELECT source, count(*) FILTER (lang = owner) AS n_owned, count(*) AS n FROM documents JOIN w USING (source) GROUP BY 1""")
def owned_views(spark, d):
    docs = table(spark, d, "documents").select("source", "lang")
    return registration.owned_counts(docs, docs.groupBy("source").agg(F.min("lang").alias("lang")), "source", "lang")


@query("""SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_discount * 10 >= 0.6) AS n_visible, count(*) FILTER (l_discount * 10 >= 0.3 AND l_discount * 10 < 0.6) AS n_partial, count(*) FILTER (l_quantity / 50 >= 0.5) AS n_confident FROM lineitem GROUP BY 1""")
def visible_regions(spark, d):
    seen = registration.visibility(F.col("l_discount") * 10)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(seen == "visible").alias("n_visible"), F.count_if(seen == "partial").alias("n_partial"), F.count_if(scoring.confident(F.col("l_quantity") / 50)).alias("n_confident"))
