"""Queries over records, sessions and documents: rules, lookups, lifecycles, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture, decisions, sessions, splits, validation
from ..sources.io import table
from .queries import DAYS, RATIO, _days, _plan, day, query


@query("SELECT event_type, count(*) FILTER (list_sort(json_keys(props::JSON)) = ['k']) AS n_exact, count(*) FILTER (list_sort(json_keys(props::JSON)) = ['k', 'z']) AS n_other FROM events GROUP BY 1")
def exact_keys(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count_if(validation.exact_keys(F.col("props"), ["k"])).alias("n_exact"), F.count_if(validation.exact_keys(F.col("props"), ["z", "k"])).alias("n_other"))


@query("""SELECT source, count(*) FILTER (octet_length(encode(coalesce(text, ''))) <= 2000) AS n_fit, count(*) AS n, sum(length(left(coalesce(text, ''), 300)))::BIGINT AS chars_kept FROM documents GROUP BY 1""")
def body_limit(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(validation.body_fits(text, 2000)).alias("n_fit"), F.count("*").alias("n"), F.sum(F.length(validation.shortened(text))).alias("chars_kept"))


@query("""SELECT page_id, nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#@]+)', 1)), '') AS origin,
coalesce(nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#@]+)', 1)), '') = nullif(lower(regexp_extract((SELECT min(url) FROM pages), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#@]+)', 1)), ''), false) AS same FROM pages""")
def same_origin(spark, d):
    p = table(spark, d, "pages")
    own = F.broadcast(p.agg(F.min("url").alias("own")))  # one row
    return p.crossJoin(own).select("page_id", validation.origin(F.col("url")).alias("origin"), validation.same_origin(F.col("url"), F.col("own")).alias("same"))


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT strftime(o_orderdate::DATE, '%Y-%m-%d'))), ',') AS dates FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 0 AND o_orderdate::DATE <= DATE '1996-12-31' GROUP BY 1""")
def calibration_dates(spark, d):
    text = F.date_format(day("o_orderdate"), "yyyy-MM-dd")
    o = table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0)).select("o_custkey", validation.usable_date(text, F.lit("1996-12-31").cast("date")).alias("d"))
    dates = F.array_join(F.array_sort(F.collect_set(F.date_format("d", "yyyy-MM-dd"))), ",")
    return o.filter("d IS NOT NULL").groupBy("o_custkey").agg(dates.alias("dates"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT p_size * 10 >= 100 THEN 'blur' END, CASE WHEN NOT p_retailprice / 60000::DOUBLE <= 0.02::DOUBLE THEN 'highlights' END,
CASE WHEN NOT p_size / 900::DOUBLE <= 0.05::DOUBLE THEN 'shadows' END, CASE WHEN round_even(1.5::DOUBLE * (p_size - 5), 1) < 6 THEN 'scale' END, CASE WHEN NOT p_partkey % 7 <> 0 THEN 'marker' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""")
def photo_quality(spark, d):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    why = validation.quality_reasons(size * 10, price / 60000, size / 900, size - 5, F.col("p_partkey") % 7 != 0, True)
    return table(spark, d, "part").select("p_partkey", F.array_join(why, ",").alias("reasons"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 50000) AS n_eligible, count(*) AS n FROM orders GROUP BY 1""")
def eligible_rows(spark, d):
    ok = validation.eligible(F.lit("session"), F.lit("frontal"), F.col("o_orderstatus") == "F", F.col("o_totalprice") - 50000)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(ok).alias("n_eligible"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id, array_to_string(list_filter([CASE WHEN NOT event_type IN ('click', 'view', 'purchase') THEN 'kind' END, CASE WHEN NOT coalesce(value > 0, false) THEN 'value' END], lambda x: x IS NOT NULL), ',') AS why FROM events)
SELECT why, count(*) AS n FROM r WHERE why <> '' GROUP BY 1""")
def reject_reasons(spark, d):
    _, bad = validation.rejects(table(spark, d, "events"), kind=validation.one_of(F.col("event_type"), ["click", "view", "purchase"]), value=F.col("value") > 0)
    return bad.groupBy(F.array_join("reasons", ",").alias("why")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT ts::DATE AS d, event_type, min(event_id) AS session_id FROM events GROUP BY 1, 2),
m AS (SELECT ts::DATE AS d, event_type, user_id % 5 AS k, arg_max((props::JSON ->> 'k')::INTEGER, (ts, event_id)) AS v FROM events GROUP BY 1, 2, 3),
t AS (SELECT d, event_type, '{' || string_agg('"' || k || '":"' || coalesce(v::VARCHAR, '') || '"', ',' ORDER BY k) || '}' AS covariates FROM m GROUP BY 1, 2)
SELECT d, event_type, session_id, covariates FROM c JOIN t USING (d, event_type)""")
def session_upsert(spark, d):
    e = table(spark, d, "events").withColumn("d", day("ts"))
    value = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    return sessions.get_or_create(e, ["d", "event_type"], "event_id", (F.col("user_id") % 5).cast("string"), value, "ts", "event_id")


@query("""SELECT c_custkey, coalesce(s.o_orderstatus, 'none') AS o_orderstatus FROM customer LEFT JOIN
(SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey""")
def state_with_default(spark, d):
    state = capture.last_state(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    return sessions.value_or_default(table(spark, d, "customer"), state, "c_custkey", "o_orderstatus", F.lit("none"))


@query("SELECT event_id, event_type, ts FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_events(spark, d):
    return table(spark, d, "events").filter("event_type <> 'view'").select("event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("SELECT p.c_mktsegment, count(o_orderkey) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer) p LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING') o USING (c_mktsegment) GROUP BY 1")
def counts_with_zeros(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(c.filter("c_mktsegment <> 'BUILDING'"), "c_custkey")
    return sessions.counts_over(o, c, "c_mktsegment")


@query(f"""WITH days_ AS ({DAYS}), o AS (SELECT *, greatest(n_main, n_other) AS slots, coalesce(sum(greatest(n_main, n_other)) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM days_),
s AS (SELECT d, n_main, n_other, before, unnest(range(1, slots + 1)) AS slot FROM o), t AS (SELECT sum(slots)::BIGINT AS total FROM o),
p AS (SELECT unnest(range(total + 1, greatest(total, 4000) + 1)) AS number FROM t)
SELECT before + slot AS number, d, slot, slot <= n_main AS has_main, slot <= n_other AS has_other FROM s UNION ALL SELECT number, NULL, NULL, false, false FROM p""")
def padded_slots(spark, d):
    return sessions.padded_slots(_days(spark, d), "d", 4000)


@query("""WITH days_ AS (SELECT ts::DATE AS d, count(*) FILTER (event_type = 'click') AS n_main, count(*) FILTER (event_type = 'view') AS n_other,
count(*) FILTER (event_type IN ('click', 'view') AND value >= 20) AS n_pass, count(*) FILTER (event_type IN ('click', 'view') AND value < 20) AS n_fail FROM events GROUP BY 1),
t AS (SELECT sum(n_main)::BIGINT AS n_main, sum(n_other)::BIGINT AS n_other, sum(n_pass)::BIGINT AS n_pass, sum(n_fail)::BIGINT AS n_fail, sum(least(n_main, n_other))::BIGINT AS complete,
sum(greatest(n_main, n_other))::BIGINT AS n_slots, count(*) AS n_days, count(*) FILTER (n_main <> n_other) AS unpaired_days, sum(abs(n_main - n_other))::BIGINT AS unpaired_shots, min(d) AS first_day, max(d) AS last_day FROM days_)
SELECT *, greatest(0, 3000 - complete) AS remaining, greatest(0, 10 - n_days) AS days_remaining, 2 * greatest(0, 3000 - complete) AS photos_remaining, 3000 AS repeats, 10 AS least_days,
CASE WHEN complete >= 3000 AND n_days >= 10 THEN 'complete' WHEN complete >= 3000 THEN 'spread' ELSE 'in_progress' END AS status FROM t""")
def progress_record(spark, d):
    e = table(spark, d, "events").withColumn("d", day("ts"))
    days = capture.pairs_per_day(e, "d", "event_type", "click", "view")
    shot = F.col("event_type").isin("click", "view")
    judged = e.groupBy("d").agg(F.count_if(shot & (F.col("value") >= 20)).alias("n_pass"), F.count_if(shot & (F.col("value") < 20)).alias("n_fail"))
    return sessions.progress_record(days.join(judged, "d"), "d", 3000, 10)


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS prior_o_orderkey, lag(o_totalprice) OVER w AS prior_o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def prior_session(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return sessions.prior(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"]).select("o_orderkey", "prior_o_orderkey", "prior_o_totalprice")


@query("""WITH s AS (SELECT DISTINCT user_id, date_diff('day', DATE '2020-01-01', ts::DATE) AS n FROM events WHERE event_type = 'purchase'), l AS (SELECT max(n) AS last FROM s),
w AS (SELECT user_id, n, count(*) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent, coalesce(lead(n) OVER (PARTITION BY user_id ORDER BY n), last + 1) AS nxt FROM s, l),
r AS (SELECT *, CASE WHEN nxt - n > 3 THEN n + 1 END AS gone FROM w)
SELECT user_id, min(n) FILTER (recent >= 2) AS born, last(gone ORDER BY n) AS resolved FROM r GROUP BY 1""")
def lifecycle(spark, d):
    n = F.datediff(day("ts"), F.lit("2020-01-01").cast("date")).cast("long")
    s = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", n.alias("n"))
    last = F.broadcast(s.agg(F.max("n").alias("last")))  # one row
    return sessions.lifecycles(s.crossJoin(last), "user_id", "n", F.col("last"))


@query("""WITH c AS (SELECT ts::DATE AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY d) AS p FROM c)
SELECT event_type, round(regr_slope(n, p), 9) AS slope, count(p) AS n FROM b GROUP BY 1""")
def lagged_slope(spark, d):
    c = table(spark, d, "events").groupBy(day("ts").alias("d"), "event_type").agg(F.count("*").alias("value"))
    return sessions.lag_slope(c, "event_type", "d", "value").withColumn("slope", F.round("slope", 9))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'changed' END AS why FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0""")
def wrong_digests(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content"))
    stated = docs.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(text, 256).alias("sha256"))
    return sessions.wrong_digests(docs, stated, "doc_id").select("doc_id", "why")


@query(f"WITH {RATIO} SELECT split, array_to_string(list_sort(list(strftime(d, '%Y-%m-%d'))), ',') AS dates, count(*) AS n_dates FROM plan GROUP BY 1")
def split_manifest(spark, d):
    m = sessions.split_manifest(_plan(spark, d), "d")
    return m.select("split", F.array_join(F.transform("dates", lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("dates"), "n_dates")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def without_calibration(spark, d):
    o = splits.without_calibration(table(spark, d, "orders"), "o_orderpriority", "5-LOW")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT lang, sha256('{"lang":' || to_json(lang) || ',"n":' || count(*) || ',"sources":' || to_json(list_sort(list(DISTINCT source))) || '}') AS digest FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1""")
def canonical_digest(spark, d):
    c = table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))
    return c.select("lang", capture.canonical_digest(lang=F.col("lang"), sources=F.col("sources"), n=F.col("n")).alias("digest"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'unknown' END AS message,
CASE WHEN o_orderkey % 20 * 5 = 50 THEN 'left50' WHEN o_orderkey % 20 * 5 = 60 THEN 'left60' ELSE 'rejected' END AS lock,
CASE WHEN o_totalprice / 10000 >= 10 THEN 'keep' WHEN o_totalprice / 10000 >= 6 THEN 'fair' ELSE 'drop' END AS probe FROM orders""")
def order_states(spark, d):
    message = decisions.status_text(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "unknown")
    return table(spark, d, "orders").select("o_orderkey", message.alias("message"), decisions.lock_choice(F.col("o_orderkey") % 20 * 5).alias("lock"), decisions.probe_state(F.col("o_totalprice") / 10000).alias("probe"))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS images, count(*) FILTER (o_orderstatus = 'F') AS eligible, count(DISTINCT o_orderdate::DATE) FILTER (o_orderstatus = 'F') >= 3 AS ready FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN images = 0 THEN 'add images' WHEN eligible = 0 THEN 'calibrate' WHEN ready THEN 'ready' ELSE 'collect more days' END AS state FROM c""")
def readiness_states(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", day("o_orderdate").alias("d"))
    c = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy("c_custkey")
    c = c.agg(F.count("d").alias("images"), F.count_if(F.col("o_orderstatus") == "F").alias("eligible"), (F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("d"))) >= 3).alias("ready"))
    return c.select("c_custkey", decisions.readiness_state(F.col("images"), F.col("eligible"), F.col("ready")).alias("state"))


@query("SELECT DISTINCT id FROM (SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier)")
def roster(spark, d):
    return capture.roster(table(spark, d, "customer").select(F.col("c_nationkey").alias("id")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("id")))


@query("""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d') AS local_day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
def stamps(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    return e.groupBy(capture.stamp(F.col("ts")).alias("stamp"), capture.local_day(F.col("ts"), 120).alias("local_day")).agg(F.count("*").alias("n"))
