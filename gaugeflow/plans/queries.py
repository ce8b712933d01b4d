"""The engine's registered queries on the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import ratio
from ..operators import capture, registration, scoring, splits, tiling, validation
from ..sources.io import table
from ..streaming.ingest import request_rate

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def day(column: str):
    return F.to_date(column)


@query("""SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS n_captures, count(*) FILTER (o.o_orderstatus = 'F') AS n_pass
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL ORDER BY n_captures DESC, c.c_custkey DESC LIMIT 10""")
def recent_sessions(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    return capture.recent_sessions(customers, orders, "c_custkey", F.col("o_orderstatus") == "F", [F.desc("n_captures"), F.desc("c_custkey")], 10)


DAYS = "SELECT ts::DATE AS d, count(*) FILTER (event_type = 'click') AS n_main, count(*) FILTER (event_type = 'view') AS n_other FROM events GROUP BY 1"


def _days(spark, d):
    return capture.pairs_per_day(table(spark, d, "events").withColumn("d", day("ts")), "d", "event_type", "click", "view")


@query(f"""WITH days_ AS ({DAYS}), t AS (SELECT sum(least(n_main, n_other))::BIGINT AS pairs, count(*) AS n_days, sum(abs(n_main - n_other))::BIGINT AS missing FROM days_)
SELECT pairs, n_days, missing, greatest(0, 2500 - pairs) AS remaining, greatest(0, 30 - n_days) AS days_remaining,
CASE WHEN pairs >= 2500 AND n_days >= 30 THEN 'complete' WHEN pairs >= 2500 THEN 'spread' ELSE 'in_progress' END AS status FROM t""")
def paired_repeats(spark, d):
    return capture.progress(_days(spark, d), 2500, 30)


@query(f"WITH days_ AS ({DAYS}) SELECT d, CASE WHEN n_main < n_other THEN 'click' ELSE 'view' END AS short_of, abs(n_main - n_other) AS missing FROM days_ WHERE n_main <> n_other")
def unpaired_days(spark, d):
    return capture.unpaired_days(_days(spark, d), "d", "click", "view")


@query(f"""WITH days_ AS ({DAYS}), s AS (SELECT d, n_main, n_other, unnest(range(1, greatest(n_main, n_other) + 1)) AS slot FROM days_)
SELECT d, slot, slot <= n_main AS has_main, slot <= n_other AS has_other FROM s""")
def sitting_slots(spark, d):
    return capture.slots(_days(spark, d), "d")


@query(f"""WITH days_ AS ({DAYS}), t AS (SELECT sum(least(n_main, n_other)) AS pairs, count(*) AS n_days FROM days_)
SELECT CASE WHEN (SELECT max(value) > 1e9 FROM events) THEN 'open' WHEN pairs >= 1 AND n_days >= 3 THEN 'analysis' ELSE 'shooting' END AS gate,
CASE WHEN pairs >= 1 AND n_days >= 3 THEN 'complete' WHEN pairs >= 1 THEN 'spread' ELSE 'in_progress' END AS status FROM t""")
def capture_gate(spark, d):
    locked = table(spark, d, "events").agg((F.max("value") > 1e9).alias("locked"))
    return capture.capture_gate(capture.progress(_days(spark, d), 1, 3).crossJoin(locked), F.col("locked")).select("gate", "status")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_state(spark, d):
    return capture.last_state(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("SELECT user_id, event_type AS name, arg_max((props::JSON ->> 'k')::INTEGER, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def covariate_merge(spark, d):
    value = F.get_json_object("props", "$.k").cast("int")
    return capture.merged_maps(table(spark, d, "events"), "user_id", F.col("event_type"), value, "ts", "event_id")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_by_hash(spark, d):
    return capture.first_of_content(table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "sha256", "doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')")
def not_yet_stored(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    return capture.new_content(customers, table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


RATIO = """d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), r AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM d),
s AS (SELECT *, greatest(1, least(round_even(n * 0.7::DOUBLE, 0), n - 2))::BIGINT AS t FROM r),
v AS (SELECT *, greatest(1, least(round_even(n * 0.15::DOUBLE, 0), n - t - 1))::BIGINT AS w FROM s),
b AS (SELECT d, CASE WHEN k <= t THEN 'train' WHEN k <= t + w THEN 'val' ELSE 'test' END AS block FROM v),
lt AS (SELECT max(d) AS x FROM b WHERE block = 'train'), lv AS (SELECT max(d) AS x FROM b, lt WHERE block = 'val' AND d - lt.x > 3),
plan AS (SELECT d, CASE WHEN block = 'train' THEN 'train' WHEN block = 'val' AND d - lt.x > 3 THEN 'val'
WHEN block = 'test' AND d - coalesce(lv.x, lt.x) > 3 THEN 'test' ELSE 'gap' END AS split FROM b, lt, lv)"""


def _plan(spark, d):
    return splits.ratio_split(table(spark, d, "orders").select(day("o_orderdate").alias("d")), "d", (0.7, 0.15, 0.15), 3)


@query(f"WITH {RATIO} SELECT d, split FROM plan")
def ratio_split(spark, d):
    return _plan(spark, d)


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), b AS (SELECT d, (SELECT max(d) FROM d) - d AS back FROM d)
SELECT d, CASE WHEN back <= 13 THEN 'test' WHEN back >= 17 AND back < 31 THEN 'val' WHEN back >= 34 THEN 'train' ELSE 'gap' END AS split FROM b""")
def trailing_split(spark, d):
    return splits.trailing_split(table(spark, d, "orders").select(day("o_orderdate").alias("d")), "d", 14, 14, 3)


@query(f"""WITH {RATIO} SELECT split, count(DISTINCT d) AS n_days, count(DISTINCT o_orderkey) AS n_sessions, count(*) AS n_images
FROM plan JOIN orders ON o_orderdate::DATE = d JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ROLLUP (split)""")
def split_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("d"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_images"))
    return splits.totals(splits.members(o, _plan(spark, d), "d").join(lines, "o_orderkey"), "d", "o_orderkey", "n_images")


@query(f"""WITH {RATIO} SELECT o_custkey, count(DISTINCT split) AS n_splits FROM plan JOIN orders ON o_orderdate::DATE = d
WHERE split <> 'gap' GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leak_check(spark, d):
    o = table(spark, d, "orders").select("o_custkey", day("o_orderdate").alias("d"))
    return splits.leaks(splits.members(o, _plan(spark, d), "d"), "o_custkey")


@query(f"""WITH {RATIO}, a AS (SELECT split, o_orderpriority = '1-URGENT' AS p FROM plan JOIN orders ON o_orderdate::DATE = d WHERE o_orderstatus = 'F' AND o_totalprice > 0),
c AS (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
count(*) FILTER (split = 'train' AND p) AS positive_train, count(*) FILTER (split = 'val' AND p) AS positive_val FROM a)
SELECT *, n_train > 0 AND n_val > 0 AND n_test > 0 AND positive_train > 0 AND positive_val > 0 AS ready FROM c""")
def split_readiness(spark, d):
    o = table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0)).select(day("o_orderdate").alias("d"), "o_orderpriority")
    return splits.readiness(splits.members(o, _plan(spark, d), "d"), F.col("o_orderpriority") == "1-URGENT")


TILE, STEP, W, H = 1280, 1024, 4032, 3024
POINTS = f"""p AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_suppkey % 5 AS image, (l_extendedprice * 7 + l_orderkey) % {W} AS x, (l_extendedprice * 3 + l_quantity) % {H} AS y FROM lineitem),
xs AS (SELECT unnest([0, 1024, 2048, {W - TILE}]) AS x0, unnest(range(4)) AS col), ys AS (SELECT unnest([0, 1024, {H - TILE}]) AS y0, unnest(range(3)) AS row),
t AS (SELECT row, col, x0, y0, x0 + {TILE} AS x1, y0 + {TILE} AS y1, 'r' || row || 'c' || col AS tile_id FROM xs, ys),
j AS (SELECT * FROM p JOIN t ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)"""


def _points(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 5).alias("image"), ((F.col("l_extendedprice") * 7 + F.col("l_orderkey")) % W).alias("x"), ((F.col("l_extendedprice") * 3 + F.col("l_quantity")) % H).alias("y"), F.lit(W).alias("w"), F.lit(H).alias("h"))


def _inside(spark, d):
    points = _points(spark, d)
    images = points.select("image", "w", "h").distinct()
    return tiling.tiles_of(points, tiling.grid(images, "image", "w", "h", TILE, STEP), "image", "x", "y", "w", "h", TILE, STEP)


@query(f"WITH {POINTS} SELECT image, tile_id, count(*) AS n FROM j GROUP BY 1, 2")
def tile_membership(spark, d):
    return _inside(spark, d).groupBy("image", "tile_id").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, k AS (SELECT id, tile_id, row_number() OVER (PARTITION BY id, x, y ORDER BY (x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2), row, col) AS k, x, y FROM j)
SELECT tile_id, count(*) AS n FROM k WHERE k = 1 GROUP BY 1""")
def tile_owner(spark, d):
    owner = tiling.owner_of(F.col("x"), F.col("y"), F.col("w"), F.col("h"), TILE, STEP)
    points = _points(spark, d).select(tiling.owned_or_fail(owner, F.col("id"))["tile_id"].alias("tile_id"))
    return points.groupBy("tile_id").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT o_custkey AS axis, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 200 AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY axis ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT axis, reach AS gap_start, a AS gap_stop FROM m WHERE a > reach""")
def tile_coverage(spark, d):
    a = F.datediff(day("o_orderdate"), F.lit("1995-01-01").cast("date"))
    i = table(spark, d, "orders").select(F.col("o_custkey").alias("axis"), a.alias("a"), (a + 200).alias("b"))
    return tiling.uncovered(i, "axis", "a", "b")


def _chat_sql(payload: str, size: str) -> str:
    return f"""WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(trim(coalesce(text, ''), ' ')) AS trimmed, {size} AS size, length(coalesce(text, '')) AS whole,
regexp_matches(coalesce(text, ''), '{payload}') AS payload FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AS wrong,
count(*) FILTER (trimmed < 1 OR size > 2000) AS bad, count(*) FILTER (payload) AS payloads, arg_max(role, k) AS last_, sum(whole) AS total FROM t GROUP BY 1)
SELECT conv_id, CASE WHEN n_turns > 9 THEN 'count' WHEN wrong > 0 THEN 'role_order' WHEN bad > 0 THEN 'length' WHEN payloads > 0 THEN 'payload'
WHEN last_ <> 'user' THEN 'last_role' WHEN total > 10000 THEN 'total' ELSE 'ok' END AS verdict, n_turns FROM c"""


@query(_chat_sql(validation.PAYLOAD, "length(trim(coalesce(text, ''), ' '))"))
def chat_validate(spark, d):
    return validation.chats(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(_chat_sql(validation.PAYLOAD_OR_IMAGE, "length(coalesce(text, ''))"))
def chat_validate_strict(spark, d):
    return validation.chats(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", validation.PAYLOAD_OR_IMAGE, raw_length=True)


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, array_to_string(list_filter([
CASE WHEN url NOT LIKE 'https://%' THEN 'https' END, CASE WHEN contains(url, '?') THEN 'no_query' END, CASE WHEN contains(url, '#') THEN 'no_fragment' END,
CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) NOT IN ('', '/') THEN 'no_path' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pages""")
def url_predicate(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", validation.url_parts(F.col("url"))["host"].alias("host"), F.array_join(validation.service_url(F.col("url")), ",").alias("reasons"))


@query("SELECT source, count(*) FILTER (regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+')) AS n_hit, count(*) AS n FROM documents GROUP BY 1")
def payload_scan(spark, d):
    hit = F.col("text").rlike("[a-z0-9.]+@[a-z0-9.]+")
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(hit).alias("n_hit"), F.count("*").alias("n"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT p_size >= 10 THEN 'blur' END, CASE WHEN NOT p_retailprice <= 1800 THEN 'highlights' END,
CASE WHEN NOT p_retailprice >= 905 THEN 'shadows' END], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN p_size >= 10 AND p_retailprice <= 1800 AND p_retailprice >= 905 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM part""")
def qa_reasons(spark, d):
    why = validation.reasons(blur=F.col("p_size") >= 10, highlights=F.col("p_retailprice") <= 1800, shadows=F.col("p_retailprice") >= 905)
    return table(spark, d, "part").select("p_partkey", F.array_join(why, ",").alias("reasons"), validation.verdict(why).alias("verdict"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM labels)
SELECT tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def pr_metrics(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, d, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"))
    return c.select("*", *scoring.metrics(F.col("tp"), F.col("fp"), F.col("fn")))


@query("""WITH c AS (SELECT lang, count(DISTINCT source) AS n_days, count(*) AS n_labelled, count(*) FILTER (quality = 1) / count(*) AS precision, count(*) FILTER (toxic = 0) / count(*) AS recall
FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN NOT (n_days >= 5 AND n_labelled >= 20) THEN 'insufficient_evidence' WHEN precision > 0.8 AND recall > 0.7 THEN 'pass' ELSE 'fail' END AS status FROM c""")
def gate_verdict(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    c = j.groupBy("lang").agg(F.countDistinct("source").alias("n_days"), F.count("*").alias("n_labelled"), ratio(F.count_if(F.col("quality") == 1), F.count("*")).alias("precision"), ratio(F.count_if(F.col("toxic") == 0), F.count("*")).alias("recall"))
    return c.withColumn("status", scoring.gate(F.col("n_days"), F.col("n_labelled"), F.col("precision"), F.col("recall")))


@query("""WITH s AS (SELECT (doc_id * 37 % 101) / 101.0::DOUBLE AS score, quality = 1 AS truth FROM labels), t AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND truth) AS tp, count(*) FILTER (score >= threshold AND NOT truth) AS fp, count(*) FILTER (score < threshold AND truth) AS fn FROM s, t GROUP BY 1),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT *, threshold = (SELECT arg_max(threshold, (f1, -threshold)) FROM m) AS best FROM m""")
def threshold_argmax(spark, d):
    s = table(spark, d, "labels").select(((F.col("doc_id") * 37 % 101) / F.lit(101.0)).alias("score"), (F.col("quality") == 1).alias("truth"))
    return scoring.best_threshold(s, "score", F.col("truth"), [0.3, 0.5, 0.7])


STATS = "SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY 1"


@query(f"SELECT event_type, n, round(median, 9) AS median, round(p90, 9) AS p90, round(p95, 9) AS p95, worst FROM ({STATS})")
def residual_percentiles(spark, d):
    s = scoring.residual_stats(table(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "n", *(F.round(c, 9).alias(c) for c in ("median", "p90", "p95")), "worst")


@query(f"""SELECT event_type, row_number() OVER (ORDER BY median, p95, event_type) AS rank, CASE WHEN median < 15 AND p95 < 60 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM ({STATS})""")
def method_ranking(spark, d):
    s = scoring.residual_stats(table(spark, d, "events"), "event_type", "value")
    return scoring.ranked_methods(s, "event_type", 15.0, 60.0).select("event_type", F.col("rank").cast("long").alias("rank"), "verdict")


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS r, count(*) AS n FROM lineitem")
def radial_corr(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"))
    return scoring.correlation(li, "a", "b").select(F.round("r", 9).alias("r"), "n")


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT label, dim, count(*) AS n, round(stddev_pop(x), 6) AS spread FROM e GROUP BY 1, 2""")
def landmark_std(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).select("label", F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("x"))
    return registration.landmark_spread(e, ["label", "dim"], ["x"]).withColumn("spread", F.round("spread", 6))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query, vec_id AS id, sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: ((q[i] - embedding[i])::DOUBLE) ** 2))) AS d FROM q JOIN embeddings ON query <> vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS k FROM p)
SELECT a.query, a.id AS nearest, round(a.d, 6) AS d1, round(b.d, 6) AS d2, a.d < 0.98 * b.d AS accepted FROM k a JOIN k b USING (query) WHERE a.k = 1 AND b.k = 2""")
def knn_ratio_test(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = scoring.nearest_two(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.98)
    return near.withColumn("d1", F.round("d1", 6)).withColumn("d2", F.round("d2", 6))


@query()
def point_match_counts(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linenumber", (F.col("l_extendedprice") % 500).alias("x"), (F.col("l_quantity") * 10).alias("y"))
    odd = F.col("l_linenumber") % 2 == 1
    return scoring.match_counts(li.filter(odd), li.filter(~odd), "image", 4.0)


@query("SELECT event_type, (props::JSON ->> 'k')::INTEGER AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, d):
    parsed = F.coalesce(F.from_json("props", "map<string,int>"), F.expr("cast(map() as map<string,int>)"))
    return table(spark, d, "events").select("event_type", F.try_element_at(parsed, F.lit("k")).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT least(63, floor(value))::BIGINT AS bin, sum(value)::DOUBLE AS e FROM events WHERE value >= 0 GROUP BY 1),
c AS (SELECT bin, sum(e) OVER (ORDER BY bin) / sum(e) OVER () AS share FROM b) SELECT min(bin) AS detail_bin FROM c WHERE share >= 0.8""")
def spectrum_detail(spark, d):
    b = table(spark, d, "events").filter("value >= 0").groupBy(F.least(F.lit(63), F.floor("value")).cast("long").alias("bin")).agg(F.sum("value").alias("e"))
    return scoring.detail_bin(b, "bin", "e", 0.8)


@query("""WITH c AS (SELECT user_id % 2 AS u, event_type || '-' || (user_id % 40) AS k, count(*) AS n FROM events GROUP BY 1, 2),
a AS (SELECT k, n AS before FROM c WHERE u = 0), b AS (SELECT k, n AS after FROM c WHERE u = 1)
SELECT k, before, after, CASE WHEN after IS NULL THEN 'lost' WHEN before IS NULL THEN 'gained' WHEN before <> after THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b USING (k)""")
def kv_diff(spark, d):
    c = table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("u"), F.concat_ws("-", "event_type", (F.col("user_id") % 40)).alias("k")).agg(F.count("*").alias("n"))
    return capture.key_changes(c.filter("u = 0"), c.filter("u = 1"), "k", "n")


@query("SELECT time_bucket(INTERVAL '60 minutes', ts) AS window_start, event_type, count(*) AS n, count(*) > 4 AS limited FROM events GROUP BY 1, 2")
def rate_window(spark, d):
    return request_rate(table(spark, d, "events"), "ts", "event_type", "60 minutes", 4)


@query("""WITH c AS (SELECT ts::DATE AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT d, event_type, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 9) AS mean FROM c""")
def rolling_mean_7d(spark, d):
    c = table(spark, d, "events").groupBy(day("ts").alias("d"), "event_type").agg(F.count("*").alias("n"))
    return capture.rolling_mean(c, "d", "n", 7, ["event_type"]).withColumn("mean", F.round("mean", 9))


@query("""WITH p AS (SELECT l_suppkey % 10 AS pair, l_partkey AS id, l_returnflag, min(l_quantity) AS x, min(l_discount * 100) AS y FROM lineitem GROUP BY 1, 2, 3),
j AS (SELECT pair, id, a.x AS tx, a.y AS ty, b.x, b.y FROM (SELECT * FROM p WHERE l_returnflag = 'N') a JOIN (SELECT * FROM p WHERE l_returnflag = 'R') b USING (pair, id)),
m AS (SELECT pair, sqrt(((1.01::DOUBLE * tx + 2) / (1 + 0.001::DOUBLE * ty) - x) ** 2 + ((0.99::DOUBLE * ty - 1) / (1 + 0.001::DOUBLE * ty) - y) ** 2) / 2 AS mm FROM j)
SELECT pair, count(*) AS n, round(quantile_cont(mm, 0.5), 7) AS median, round(quantile_cont(mm, 0.95), 7) AS p95 FROM m GROUP BY 1 HAVING count(*) >= 3""")
def registration_residuals(spark, d):
    p = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("pair"), F.col("l_partkey").alias("id"), "l_returnflag")
    p = p.agg(F.min("l_quantity").alias("x"), F.min(F.col("l_discount") * 100).alias("y"))
    r = registration.residuals(p.filter("l_returnflag = 'N'"), p.filter("l_returnflag = 'R'"), "pair", [1.01, 0.0, 2.0, 0.0, 0.99, -1.0, 0.0, 0.001, 1.0], 2.0)
    s = scoring.residual_stats(r, "pair", "mm")
    return s.select("pair", "n", F.round("median", 7).alias("median"), F.round("p95", 7).alias("p95"))
