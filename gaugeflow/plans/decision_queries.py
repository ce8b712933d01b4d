"""Registered queries of workspace limits and verdicts, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, workspace
from ..sources.io import table
from .queries import query


@query("""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS back, count(*) OVER (PARTITION BY conv_id) - 1 AS m FROM conversations),
q AS (SELECT conv_id, n AS question FROM t WHERE back = 0), r AS (SELECT conv_id, turn, n, (least(8, m) - back) // 2 AS pair FROM t WHERE back BETWEEN 1 AND 8),
s AS (SELECT r.conv_id, turn, question + sum(n) OVER (PARTITION BY r.conv_id ORDER BY pair DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM r JOIN q ON q.conv_id = r.conv_id)
SELECT conv_id, turn FROM s WHERE total <= 600""")
def recent_turns(spark, d):
    return workspace.recent_turns(table(spark, d, "conversations"), "conv_id", "turn", "text", 8, 600)


@query("""WITH stored AS (SELECT source, n_chars, sha256(text) AS sha FROM documents WHERE lang = 'en'), u AS (SELECT source, sum(n_chars) AS used FROM stored GROUP BY 1), k AS (SELECT DISTINCT source, sha FROM stored)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT coalesce(n_chars <= 5000, false) THEN 'size' END, CASE WHEN NOT coalesce(coalesce(used, 0) + n_chars <= 300000, false) THEN 'room' END,
CASE WHEN k.sha IS NOT NULL THEN 'new_bytes' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents d LEFT JOIN u ON u.source = d.source LEFT JOIN k ON k.source = d.source AND k.sha = sha256(d.text) WHERE lang <> 'en'""")
def upload_limits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    judged = workspace.upload_reasons(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'"), "source", "n_chars", "sha", 5000, 300_000)
    return judged.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT count(*) FILTER (o IS NULL) AS only_left, count(*) FILTER (c IS NULL) AS only_right, count(*) FILTER (o IS NULL OR c IS NULL) = 0 AS same
FROM (SELECT DISTINCT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o""")
def same_members(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return workspace.same_keys(customers, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, max(value) FILTER (event_type = 'click') AS c, max(value) FILTER (event_type = 'view') AS e FROM events GROUP BY 1),
w AS (SELECT user_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) <= 0.03::DOUBLE * greatest(a, b, 1e-9) THEN 'tie' WHEN b > a THEN 'other' ELSE 'main' END END AS x,
CASE WHEN c IS NOT NULL AND e IS NOT NULL THEN CASE WHEN abs(c - e) <= 0.03::DOUBLE * greatest(c, e, 1e-9) THEN 'tie' WHEN e > c THEN 'other' ELSE 'main' END END AS y FROM m)
SELECT user_id, CASE WHEN x IS NULL THEN 'inconclusive' WHEN x = 'tie' THEN 'no difference' WHEN y IS NULL OR y = 'tie' OR y = x THEN 'use ' || x ELSE 'trade-off ' || x END AS choice FROM w""")
def lens_choice(spark, d):
    def of(f, kind):
        return f(F.when(F.col("event_type") == kind, F.col("value")))

    m = table(spark, d, "events").groupBy("user_id").agg(of(F.avg, "click").alias("a"), of(F.avg, "view").alias("b"), of(F.max, "click").alias("c"), of(F.max, "view").alias("e"))
    choice = decisions.lens_choice(decisions.winner(F.col("a"), F.col("b")), decisions.winner(F.col("c"), F.col("e")))
    return m.select("user_id", choice.alias("choice"))


@query("""WITH c AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_retailprice / 40)::DOUBLE AS r FROM part), e AS (SELECT p_partkey, s AS a, r AS b, sqrt(s * s + 1) AS c, r + 1 AS d, sqrt(s * s + r * r) AS p, sqrt(s * s + (r + 1) * (r + 1)) AS q FROM c)
SELECT p_partkey, round((a + b + c + d) / 4, 6) AS edge, round((greatest(a, b, c, d) - least(a, b, c, d)) / ((a + b + c + d) / 4) * 100, 6) AS spread_pct, round(greatest(p, q) / least(p, q), 6) AS diagonals,
round(greatest(a, c) / least(a, c), 6) AS opposite, CASE WHEN (greatest(a, b, c, d) - least(a, b, c, d)) / ((a + b + c + d) / 4) * 100 <= 25 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM e""")
def print_check(spark, d):
    s, r = F.col("p_size").cast("double"), (F.col("p_retailprice") / 40).cast("double")
    places = [(F.lit(0.0), F.lit(0.0)), (s, F.lit(0.0)), (s, r), (F.lit(0.0), r + 1)]
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in places))
    m = table(spark, d, "part").select("p_partkey", decisions.square_metrics(corners).alias("m"))
    return m.select("p_partkey", *(F.round(f"m.{c}", 6).alias(c) for c in ("edge", "spread_pct", "diagonals", "opposite")), decisions.print_verdict(F.col("m.spread_pct"), 25.0).alias("verdict"))
