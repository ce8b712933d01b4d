"""Registered queries of points that are thinned, fitted or still pending, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registration, tiling, workspace
from ..sources.io import table
from .queries import query


@query("""WITH p AS (SELECT o_orderkey, floor(o_totalprice / 50000)::BIGINT AS cx, o_custkey % 20 AS cy FROM orders)
SELECT o_orderkey, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY o_orderkey) AS k FROM p) WHERE k <= 3""")
def grid_thinning(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 50000).alias("cx"), (F.col("o_custkey") % 20).alias("cy"))
    return tiling.thin(p, ["cx", "cy"], "o_orderkey", 3)


@query("""WITH p AS (SELECT o_custkey % 20 AS pair, o_totalprice / 1000 AS x, (o_custkey % 7)::DOUBLE AS y, o_orderkey FROM orders),
q AS (SELECT pair, x, y, 2 * x - y + o_orderkey % 3 AS u, x + 2 * y + o_orderkey % 5 AS v FROM p),
s AS (SELECT pair, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, u) + covar_pop(y, v) AS a, covar_pop(x, v) - covar_pop(y, u) AS b, var_pop(x) + var_pop(y) AS s FROM q GROUP BY 1),
f AS (SELECT *, a / s AS c, b / s AS d FROM s)
SELECT pair, round(sqrt(c * c + d * d), 6) AS scale, round(degrees(atan2(d, c)), 6) AS degrees, round(mu - c * mx + d * my, 6) AS tx, round(mv - d * mx - c * my, 6) AS ty FROM f""")
def similarity_fit(spark, d):
    p = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("pair"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 7).cast("double").alias("y"), "o_orderkey")
    q = p.select("pair", "x", "y", (2 * F.col("x") - F.col("y") + F.col("o_orderkey") % 3).alias("u"), (F.col("x") + 2 * F.col("y") + F.col("o_orderkey") % 5).alias("v"))
    fit = registration.similarity(q, "pair")
    return fit.select("pair", *(F.round(c, 6).alias(c) for c in ("scale", "degrees", "tx", "ty")))


@query("""WITH p AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F'))
SELECT c_nationkey, c_custkey, coalesce(lead(c_custkey) OVER w, min(c_custkey) OVER (PARTITION BY c_nationkey)) AS next,
coalesce(lag(c_custkey) OVER w, max(c_custkey) OVER (PARTITION BY c_nationkey)) AS previous FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def next_pending(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    pending = table(spark, d, "customer").select("c_nationkey", "c_custkey").join(done, "c_custkey", "left_anti")
    return workspace.cyclic_neighbours(pending, "c_nationkey", "c_custkey")
