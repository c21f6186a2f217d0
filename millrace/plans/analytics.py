"""Queries for aggregates, merges, lifecycles, planning, logs, locations and scalar functions."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import predicates as P
from millrace.functions import scalars as S
from millrace.operators import geo, logs, merge, runs, windows
from millrace.operators.selection import Order
from millrace.plans.filters import languages
from millrace.plans.registry import Tables, query
from millrace.plans.relations import _RUNS, LOG, response_log, run_rows, snapshots, _AB
from millrace.sources import shared
from millrace.streaming import slo, streams

L = "WITH " + LOG + " "


@query("a01_count_by", "SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def _(t):
    return logs.count_by(t.orders.withColumnRenamed("o_orderstatus", "status"), "status", ["F", "O", "X"])


_SLO = L + """, n AS (SELECT * FROM lg ORDER BY ts DESC, id DESC LIMIT 1000)
SELECT max_by(remaining, (ts, id)) FILTER (resource = 'graphql') AS graphql_remaining, round(count(*) FILTER (incomplete) / count(incomplete), 6) AS incomplete_results_ratio, round(count(*) FILTER (status = 422) / count(*), 6) AS rate_422,
round(count(*) FILTER (status IN (403, 429)) / count(*), 6) AS rate_403_429, round(quantile_cont(latency_ms, 0.95), 4) AS p95_latency_ms,
(SELECT round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) FROM orders) AS shard_coverage, (SELECT round(count(*) FILTER (c_custkey % 3 = 0) / count(*), 6) FROM customer) AS geo_unmatched_rate FROM n"""


def rounded_slo(s):
    ratios = [F.round(c, 6).alias(c) for c in ("incomplete_results_ratio", "rate_422", "rate_403_429")]
    return s.select("graphql_remaining", *ratios, F.round("p95_latency_ms", 4).alias("p95_latency_ms"), *[F.round(c, 6).alias(c) for c in ("shard_coverage", "geo_unmatched_rate")])


@query("a02_slo_snapshot", _SLO)
def _(t):
    return rounded_slo(logs.slo_snapshot(response_log(t), **slo_tables(t)))


@query("a03_nearest_rank_p95", L + ", n AS (SELECT latency_ms AS v FROM lg ORDER BY ts DESC, id DESC LIMIT 50) SELECT list_sort(list(v))[ceil(count(*) * 95 / 100)::INT] AS p95, count(*) AS n FROM n")
def _(t):
    return logs.nearest_rank_p95(response_log(t), "latency_ms", ["ts", "id"])


@query("a04_severity", L + "SELECT id, CASE WHEN latency_ms > 2000 THEN 'fail' WHEN latency_ms > 800 THEN 'warn' ELSE 'ok' END AS severity FROM (SELECT id, latency_ms * 20 AS latency_ms FROM lg)")
def _(t):
    rows = response_log(t).select("id", F.lit("p95_latency_ms").alias("metric"), (F.col("latency_ms") * 20).alias("value"))
    return logs.severity(rows).select("id", "severity")


@query("a05_quality_report", """WITH i AS (SELECT p_name, p_partkey, CASE WHEN p_size > 10 THEN p_type END AS language, CASE WHEN p_size > 40 THEN p_brand END AS license FROM part),
b AS (SELECT count(*) AS n, count(*) FILTER (language IS NULL) / count(*) AS rl, count(*) FILTER (license IS NULL) / count(*) AS rx, (SELECT count(*) FROM (SELECT p_name FROM i GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1)) AS d FROM i)
SELECT 'count_parity' AS "check", CASE WHEN n <> 2000 THEN 'warn' ELSE 'ok' END AS status, (n - 2000)::DOUBLE AS value FROM b UNION ALL SELECT 'duplicate_full_names', CASE WHEN d > 0 THEN 'fail' ELSE 'ok' END, d FROM b
UNION ALL SELECT 'missing_language', CASE WHEN rl > 0.5 THEN 'warn' ELSE 'ok' END, rl FROM b UNION ALL SELECT 'missing_license', CASE WHEN rx > 0.5 THEN 'warn' ELSE 'ok' END, rx FROM b
UNION ALL SELECT 'incomplete', 'warn', 1 UNION ALL SELECT 'bundle', CASE WHEN n <> 2000 THEN 'warn' ELSE 'ok' END, 2000 FROM b UNION ALL SELECT 'field_coverage', 'warn', 1
UNION ALL SELECT 'overall', CASE WHEN d > 0 THEN 'fail' ELSE 'warn' END, NULL FROM b""")
def _(t):
    items = t.part.select("p_name", "p_partkey", F.when(F.col("p_size") > 10, F.col("p_type")).alias("language"), F.when(F.col("p_size") > 40, F.col("p_brand")).alias("license"))
    return runs.quality_report(items, 2000, incomplete=1, bundle_items=2000, empty_fields=["x"], name="p_name", key="p_partkey", sparse={"language": 0.5, "license": 0.5})


@query("a06_completeness", """WITH p AS (SELECT o_custkey AS k, sum(o_orderkey % 100)::BIGINT AS fetched, count(*) AS pages, bool_or(o_orderkey % 97 = 0) AS cut, count(*) FILTER (o_orderkey % 101 = 0) AS errors FROM orders GROUP BY 1),
j AS (SELECT c_custkey AS k, (c_custkey % 800)::BIGINT AS total, coalesce(fetched, 0) AS fetched, coalesce(pages, 0) AS pages, coalesce(cut, false) AS cut, coalesce(errors, 0) AS errors FROM customer LEFT JOIN p ON k = c_custkey)
SELECT k, total, fetched, pages, pages >= 10 AND fetched < total AS page_capped, errors, CASE WHEN fetched < total OR cut OR errors > 0 THEN 'incomplete' ELSE 'done' END AS state FROM j""")
def _(t):
    pages = t.orders.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 100).alias("n"), (F.col("o_orderkey") % 97 == 0).alias("incomplete"), F.when(F.col("o_orderkey") % 101 == 0, "timeout").alias("error"))
    wins = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 800).alias("total"))
    return windows.completeness(wins, pages, "k")


@query("a07_coverage", "WITH i AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT count(*) AS unique_ids, greatest(20000 - count(*), 0)::BIGINT AS shortfall, count(*) < 20000 AS warn, count(*) FILTER (k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) AS unavailable FROM i")
def _(t):
    ids = t.lineitem.select(F.col("l_orderkey").alias("k"))
    return runs.coverage(ids, "k", 20000, t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k")))


@query("a08_run_counts", "SELECT user_id, count(*) AS items, count(*) FILTER (json_extract_string(props, '$.k')::INT > 50) AS passed, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1")
def _(t):
    return runs.run_counts(t.events, "user_id", {"passed": F.get_json_object("props", "$.k").cast("int") > 50, "clicks": F.col("event_type") == "click"})


@query("a09_date_histogram", "SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return windows.date_histogram(t.orders, "o_orderdate").select(F.col("day").cast("string").alias("day"), "n")


@query("a10_points_by_phase", L + "SELECT phase, coalesce(sum(cost), 0)::BIGINT AS points, count(*) AS responses FROM lg GROUP BY 1")
def _(t):
    return logs.points_by_phase(response_log(t))


@query("a11_fold_budget", L + "SELECT sum(cost)::BIGINT AS cost, max(latency_ms) AS used, min(remaining) AS remaining FROM lg WHERE resource = 'graphql'")
def _(t):
    return logs.fold_budget(response_log(t).where("resource = 'graphql'"), used="latency_ms")


@query("a13_storage_estimate", "SELECT count(*) AS items, round(sum(l_quantity) * 0.25 / 1024, 4) AS mb, round(sum(l_quantity) * 0.25 / 1024, 4) > 100 - 20 AS warn FROM lineitem")
def _(t):
    return runs.storage_estimate(t.lineitem, "l_quantity", [], "file_only", free_mb=100.0, reserve_mb=20.0)


@query("a14_location_hits", "SELECT lower(replace(n_name, '_', ' ')) AS normalized, count(*) AS hits, min(n_name) AS sample FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    return geo.location_hits(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


@query("a15_distinct_ids", "SELECT l_partkey, min(l_orderkey) AS position FROM lineitem GROUP BY 1")
def _(t):
    return merge.distinct_ids(t.lineitem, "l_partkey", "l_orderkey")


@query("a16_warnings_ledger", "SELECT * FROM (SELECT 'tombstoned' AS reason, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'unresolved', count(*) FILTER (o_orderstatus = 'P') FROM orders UNION ALL SELECT 'page_cap', count(*) FILTER (o_orderstatus = 'Z') FROM orders) WHERE n > 0")
def _(t):
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return runs.warnings_ledger(t.orders.agg(count("F").alias("tombstoned"), count("P").alias("unresolved"), count("Z").alias("page_cap")))


@query("a17_response_triage", L + """, x AS (SELECT *, (id % 7)::INT AS attempt, CASE WHEN id % 2 = 0 THEN id % 90 END AS after, id % 5 = 0 AS zero FROM lg),
y AS (SELECT resource, CASE WHEN status IN (200, 304) THEN 'free' WHEN status IN (403, 429) AND after > 0 THEN 'retry_after' WHEN status IN (403, 429) AND zero THEN 'wait_reset' WHEN status IN (403, 429, 502) AND attempt >= 5 THEN 'fail_loud'
WHEN status IN (403, 429, 502) THEN 'backoff' ELSE 'shard' END AS action, after, id, attempt FROM x)
SELECT resource, action, count(*) AS n, round(sum(CASE action WHEN 'retry_after' THEN after WHEN 'wait_reset' THEN greatest(0, id % 300 - 100) WHEN 'backoff' THEN least(480, 60 * 2 ** attempt) END), 2)::DOUBLE AS wait_s FROM y GROUP BY 1, 2""")
def _(t):
    rows = response_log(t).select(
        "resource", "status", (F.col("id") % 7).cast("int").alias("attempt"), F.when(F.col("id") % 2 == 0, F.col("id") % 90).alias("retry_after"),
        F.when(F.col("id") % 5 == 0, 0).otherwise(9).alias("remaining"), (F.col("id") % 300).alias("reset"), F.lit(100).alias("now"), F.lit(None).cast("string").alias("error_code"),
        F.lit("Only the first 1000 results").alias("message"), F.lit(None).cast("string").alias("sso"),
    )
    return logs.response_triage(rows).groupBy("resource", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("wait_s"), 2).alias("wait_s"))


@query("a18_run_flags", f"""WITH {_RUNS} SELECT id, 'error' AS kind, 'failed: boom' AS label FROM r WHERE status = 'failed' UNION ALL SELECT id, 'incomplete', 'incomplete: 1 step(s)' FROM r WHERE status = 'partial'
UNION ALL SELECT id, 'truncation', 'truncated: ' || id % 50 || ' of ~25' FROM r WHERE id % 50 < 25""")
def _(t):
    rows = run_rows(t).withColumns({"error": F.when(F.col("status") == "failed", "boom"), "incomplete_shards": F.lit(0), "fetched": F.col("id") % 50, "total_count": F.lit(25)})
    return runs.run_flags(rows)


@query("a19_count_matches", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_quantity >= 10")
def _(t):
    return runs.count_matches(t.lineitem, P.date_filter("l_shipdate", "1996-01-01..1996-12-31") & P.min_stars("l_quantity", 10))


_STREAK = """, h AS (SELECT *, sum(CASE WHEN status NOT IN (403, 429) THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY ts, id) AS ok FROM lg WHERE status IN (403, 429) OR status BETWEEN 200 AND 299 OR status = 304),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(ok) OVER w <> ok OR epoch(ts) - epoch(lag(ts) OVER w) > 86400 THEN 1 ELSE 0 END AS fresh FROM h WHERE status IN (403, 429) WINDOW w AS (PARTITION BY token ORDER BY ts, id)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY token ORDER BY ts, id) AS run, count(*) OVER (PARTITION BY token ORDER BY ts, id) AS total FROM g)
SELECT id, token, total, row_number() OVER (PARTITION BY token, run ORDER BY ts, id) AS streak FROM k"""


@query("w06_hit_streaks", L + _STREAK)
def _(t):
    return logs.hit_streaks(response_log(t), "token", ["ts", "id"], gap=86400).select("id", "token", "total", "streak")


@query("w07_sliding_p95", L + ", w AS (SELECT id, list_sort(list(latency_ms) OVER (PARTITION BY token ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS v FROM lg) SELECT id, v[ceil(len(v) * 95 / 100)::INT] AS p95 FROM w")
def _(t):
    return logs.sliding_p95(response_log(t), "token", "latency_ms", ["ts", "id"]).select("id", "p95")


@query("w09_progress_eta", """WITH r AS (SELECT o_orderkey AS id, (o_orderkey % 90)::BIGINT AS done, 100 AS total, epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate) AS e FROM orders)
SELECT id, floor(done * 100 / total)::BIGINT AS percent, CASE WHEN done >= 2 AND e * (total - done) / done <= 86400 THEN floor(e * (total - done) / done)::BIGINT END AS eta_s FROM r""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("phase_started"), F.lit(None).cast("timestamp").alias("finished"), (F.col("o_orderkey") % 90).alias("done"), F.lit(100).alias("total"))
    return runs.progress_eta(rows, F.lit("2002-01-01").cast("timestamp")).select("id", "percent", "eta_s")


def versions(t: Tables):
    """An existing table (some orders, older values) and incoming rows."""
    a, b = snapshots(t)
    return a, b.withColumn("etag", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")))


_UP = f"WITH {_AB}, j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN a.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus, CASE WHEN b.o_orderkey IS NULL THEN a.o_totalprice ELSE b.o_totalprice END AS o_totalprice, CASE WHEN b.o_orderkey IS NULL THEN 'kept' WHEN a.o_orderkey IS NULL THEN 'inserted' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'updated' ELSE 'unchanged' END AS outcome FROM a FULL JOIN b USING (o_orderkey))"  # noqa: E501


@query("l01_upsert", _UP + " SELECT * FROM j")
def _(t):
    return merge.upsert(*versions(t), "o_orderkey", ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "o_orderstatus", "o_totalprice", "outcome")


@query("a12_change_counts", _UP + " SELECT count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged FROM j")
def _(t):
    return merge.change_counts(merge.upsert(*versions(t), "o_orderkey", ["o_orderstatus", "o_totalprice"]))


@query("l01_name_history", _UP + ", a2 AS (SELECT o_orderkey, o_orderstatus AS old FROM orders WHERE o_orderdate < '2000-01-01') SELECT o_orderkey, o_orderstatus AS full_name FROM j WHERE outcome = 'inserted' UNION ALL SELECT j.o_orderkey, old FROM j JOIN a2 USING (o_orderkey) WHERE outcome = 'updated' AND old IS DISTINCT FROM j.o_orderstatus")
def _(t):
    merged = merge.upsert(*versions(t), "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return merge.name_history(merged, "o_orderkey", "o_orderstatus")


@query("s09_bulk_load", "SELECT o_custkey, CASE WHEN s.o_custkey IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'inserted' WHEN c_acctbal IS DISTINCT FROM v THEN 'updated' ELSE 'unchanged' END AS outcome FROM (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) s LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) ON o_custkey = c_custkey")
def _(t):
    raw = t.orders.select("o_custkey", F.col("o_totalprice").alias("v"), "o_orderkey", "o_orderstatus")
    known = t.customer.where("c_acctbal > 2000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("v"))
    merged, _ = merge.bulk_load(raw, F.col("o_orderstatus") != "P", known, "o_custkey", ["v"], "o_orderkey")
    return merged.where("outcome != 'kept'").select("o_custkey", "outcome")


@query("s09_bulk_load_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS staged, count(*) FILTER (o_orderstatus = 'P') AS skipped FROM orders")
def _(t):
    return merge.bulk_load(t.orders, F.col("o_orderstatus") != "P", t.orders, "o_orderkey", ["o_totalprice"], "o_orderkey")[1]


@query("l02_upsert_owners", """WITH e AS (SELECT c_custkey AS id, 'u' || c_custkey AS login FROM customer WHERE c_acctbal > 0), i AS (SELECT c_custkey AS id, 'U' || (c_custkey // 3 * 2) AS login FROM customer WHERE c_acctbal <= 3000),
w AS (SELECT id, CASE WHEN row_number() OVER (PARTITION BY lower(login) ORDER BY id) > 1 THEN login || '~' || id ELSE login END AS login FROM i)
SELECT e.id, CASE WHEN w.id IS NOT NULL THEN w.login || '~' || e.id ELSE e.login END AS login, w.id IS NOT NULL AS conflict FROM e LEFT JOIN w ON lower(e.login) = lower(w.login) WHERE e.id NOT IN (SELECT id FROM w) UNION ALL SELECT id, login, false FROM w""")
def _(t):
    key = F.col("c_custkey")
    existing = t.customer.where("c_acctbal > 0").select(key.alias("id"), F.concat(F.lit("u"), key.cast("string")).alias("login"), F.lit("User").alias("type"))
    incoming = t.customer.where("c_acctbal <= 3000").select(key.alias("id"), F.concat(F.lit("U"), F.expr("cast(c_custkey div 3 * 2 as string)")).alias("login"), F.lit("User").alias("type"))
    return merge.upsert_owners(existing, incoming).select("id", "login", "conflict")


@query("l03_release_names", """WITH i AS (SELECT lower(c_name) AS f, max_by(c_custkey + 1, c_custkey) AS by, max_by(upper(c_name), c_custkey) AS nm FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT c_custkey, CASE WHEN f IS NOT NULL THEN nm || '~' || c_custkey ELSE c_name END AS c_name, CASE WHEN f IS NOT NULL THEN c_name END AS released FROM customer LEFT JOIN i ON lower(c_name) = f""")
def _(t):
    incoming = t.customer.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1).alias("c_custkey"), F.upper("c_name").alias("c_name"))
    return merge.release_names(t.customer.select("c_custkey", "c_name"), incoming, "c_custkey", "c_name")


@query("l04_apply_refresh", "SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey, CASE WHEN l_returnflag <> l_linestatus THEN l_linestatus END AS renamed_from, l_returnflag <> l_linestatus AS history_added FROM lineitem")
def _(t):
    batch = t.lineitem.select("l_partkey", F.col("l_linestatus").alias("requested_name"), F.col("l_returnflag").alias("full_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return merge.apply_refresh(batch, "l_partkey")[1].select("seq", "l_partkey", "renamed_from", "history_added")


@query("l05_tombstone", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'old' WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 17) THEN 'now' END AS deleted_at, p_size <= 40 AND p_name IN (SELECT p_name FROM part WHERE p_size = 17) AS tombstoned FROM part")
def _(t):
    rows = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 40, "old").alias("deleted_at"))
    gone = t.part.where("p_size = 17").select(F.upper("p_name").alias("p_name"))
    return merge.tombstone(rows, gone, F.lit("now"), name="p_name").select("p_partkey", "deleted_at", "tombstoned")


@query("l06_purge", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < '1997-01-01')")
def _(t):
    rows = t.orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return merge.purge(rows, F.lit("1997-01-01").cast("timestamp"))[0].select("o_orderkey")


@query("l07_changed_only", "SELECT b.o_orderkey FROM orders b LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW') a USING (o_orderkey) WHERE a.o_orderkey IS NULL OR (b.o_orderkey % 5 = 0 AND b.o_orderstatus <> 'P')")
def _(t):
    old = t.orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.col("o_orderstatus").alias("tag"))
    new = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "P").otherwise(F.col("o_orderstatus")).alias("tag"))
    return merge.changed_only(old, new, "o_orderkey", "tag").select("o_orderkey")


_PLAN = """WITH RECURSIVE d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1),
p(lo, hi) AS (SELECT DATE '1990-01-01', DATE '2005-12-31' UNION ALL
  SELECT unnest([lo, lo + ((hi - lo) // 2)::INT + 1]), unnest([lo + ((hi - lo) // 2)::INT, hi]) FROM p WHERE lo < hi AND (SELECT sum(n) FROM d WHERE day BETWEEN lo AND hi) > 300),
c AS (SELECT lo, hi, coalesce((SELECT sum(n) FROM d WHERE day BETWEEN lo AND hi), 0)::BIGINT AS n FROM p)
SELECT lo::DATE::VARCHAR AS lo, hi::DATE::VARCHAR AS hi, n, n > 300 AS oversized FROM c WHERE n > 0 AND (n <= 300 OR lo = hi)"""


@query("l08_plan_windows", _PLAN)
def _(t):
    plan, _ = windows.plan_windows(t.orders, "o_orderdate", max_rows=1000, scan_target=300, floor=dt.date(1990, 1, 1), ceiling=dt.date(2005, 12, 31))
    return plan.select(F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), "n", "oversized")


FORMS = ["Berlin, Germany", "USA", "Lagos", "Atlantis", "Berlin / NYC", "london calling", "🇫🇷 somewhere", "India rocks (Bengaluru)", None, "!!!", "Zürich", "UK", "Ottawa, Canada", "Österreich", "Toronto"]


def locations(t: Tables):
    """Locations of customers and suppliers: their names, with a place by number; every text is another one."""
    both = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey", "c_name", F.col("c_acctbal").alias("bal"))
    both = both.union(t.supplier.select(F.col("s_suppkey") + 1_000_000, "s_nationkey", "s_name", F.lit(0.0)))
    form = F.get(F.array(*[F.lit(f) for f in FORMS]), (F.col("id") % len(FORMS)).cast("int"))
    return both.select("id", F.concat("c_name", F.lit(", "), form).alias("location"), (F.col("c_nationkey") % 10 + F.lit(0.5)).alias("tz"), "bal")


_LOC = """l AS (SELECT c_custkey AS id, c_nationkey, c_name, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey + 1000000, s_nationkey, s_name, 0 FROM supplier),
r AS (SELECT id, bal, c_name || ', ' || ['Berlin, Germany', 'USA', 'Lagos', 'Atlantis', 'Berlin / NYC', 'london calling', '🇫🇷 somewhere', 'India rocks (Bengaluru)', NULL, '!!!', 'Zürich', 'UK', 'Ottawa, Canada', 'Österreich', 'Toronto'][(id % 15 + 1)::INT] AS location, c_nationkey % 10 + 0.5 AS tz,
['DE', 'US', 'NG', NULL, 'DE', 'GB', 'FR', 'IN', NULL, NULL, 'CH', 'GB', 'CA', 'AT', 'CA'][(id % 15 + 1)::INT] AS c, ['name', 'name', 'gazetteer-city', NULL, 'gazetteer-city', 'gazetteer-city', 'exact-iso', 'name', NULL, NULL, 'gazetteer-city', 'name', 'name', 'name', 'gazetteer-city'][(id % 15 + 1)::INT] AS tier FROM l)"""
_NORM = r"trim(regexp_replace(lower(regexp_replace(location, '[#,/()!]+', ' ', 'g')), '\s+', ' ', 'g'))"


@query("l09_resolve_locations", f"WITH {_LOC}, z AS (SELECT *, CASE tz WHEN 3.5 THEN 'IR' WHEN 4.5 THEN 'AF' WHEN 9.5 THEN 'AU' END AS w FROM r) SELECT id, coalesce(c, w) AS country, coalesce(tier, CASE WHEN w IS NOT NULL THEN 'weak' ELSE 'unmatched' END) AS confidence FROM z")
def _(t):
    rows = locations(t)
    found = geo.resolve_locations(rows, geo.country_phrases(t.spark), geo.city_phrases(t.spark), tz="tz")
    a, b = rows.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.location").eqNullSafe(F.col("b.location")) & F.col("a.tz").eqNullSafe(F.col("b.tz")))
    return joined.select("a.id", "b.country", "b.confidence")


def cached(t: Tables):
    """locations, and a cache that knows those of rich customers, wrongly."""
    rows = locations(t)
    known = rows.where("bal > 5000 AND location IS NOT NULL").select(S.normalize_location("location").alias("normalized"), F.lit("XX").alias("country"), F.lit("name").alias("confidence"), F.lit(3).cast("long").alias("hits"))
    return geo.resolve_with_cache(rows, known, geo.country_phrases(t.spark), geo.city_phrases(t.spark))


_CACHED = "CASE WHEN bal > 5000 THEN 'XX' ELSE c END AS country, CASE WHEN bal > 5000 THEN 'name' ELSE coalesce(tier, 'unmatched') END AS confidence"


@query("l10_resolve_with_cache", f"WITH {_LOC} SELECT location, {_CACHED} FROM r WHERE location IS NOT NULL")
def _(t):
    return cached(t)[0]


@query("l10_written_cache", f"WITH {_LOC} SELECT {_NORM} AS normalized, {_CACHED}, CASE WHEN bal > 5000 THEN 4 ELSE 1 END AS hits FROM r WHERE location IS NOT NULL")
def _(t):
    return cached(t)[1]


@query("l17_refresh_owner_country", f"WITH {_LOC} SELECT id, CASE WHEN id % 5 = 0 THEN 'ZZ' WHEN id % 7 = 0 THEN NULL WHEN tz < 5 THEN c END AS country, CASE WHEN id % 5 = 0 THEN 'name' WHEN id % 7 = 0 THEN 'unmatched' WHEN tz < 5 THEN coalesce(tier, 'unmatched') END AS confidence FROM r")
def _(t):
    rows = locations(t)
    done = F.col("id") % 5 == 0
    tier = F.when(done, "name").when(F.col("id") % 7 == 0, "unmatched")
    owners = rows.select("id", F.lit(None).cast("string").alias("location"), F.when(done, "ZZ").alias("country"), tier.alias("confidence"))
    answered = rows.where("tz < 5").select("id", "location")
    out = geo.refresh_owner_country(owners, answered, geo.country_phrases(t.spark), geo.city_phrases(t.spark))
    return out.select("id", "country", "confidence")


_HANDLERS = """WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS ordered FROM customer),
k AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i, count(*) OVER () AS n, (SELECT count(*) FROM a) AS every FROM a WHERE ordered),
b AS (SELECT *, i * 3 <= greatest(every + 600 - every, 0) AS paid, n_regionkey IN (1, 3) AS near FROM k JOIN nation ON c_nationkey = n_nationkey)"""


def _handlers(t):
    """Customers with open orders (a price of 1 each), then those in two regions (a price of 3), with a budget for 200 of these."""
    opened = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.lit(P.KEEP).alias("status")).distinct()

    def ordered(rows):
        return rows.select("c_custkey").join(opened, "c_custkey", "left").select("c_custkey", F.coalesce("status", F.lit(P.DROP)).alias("status"))

    def near(rows):
        regions = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return regions.select("c_custkey", F.when(F.col("n_regionkey").isin(1, 3), P.KEEP).otherwise(P.DROP).alias("status"), F.lit(2).alias("cost"))

    customers = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    steps = [runs.Handler("ordered", ordered), runs.Handler("near", near, price=3)]
    return runs.run_handlers(customers, "c_custkey", steps, [Order("c_acctbal", descending=True), Order("c_custkey")], budget=customers.count() + 600)


@query("x03_handlers", _HANDLERS + " SELECT c_custkey, c_nationkey, c_acctbal FROM b WHERE paid AND near")
def _(t):
    return _handlers(t)[0]


@query("x03_handler_ledger", _HANDLERS + """ SELECT 0 AS step, 'ordered' AS filter, any_value(every) AS checked, any_value(n) AS kept, any_value(every) - any_value(n) AS dropped, 0 AS unknown, any_value(every) AS cost FROM b
UNION ALL SELECT 1, 'near', count(*), count(*) FILTER (paid AND near), count(*) FILTER (paid AND NOT near), count(*) FILTER (NOT paid), 2 * count(*) FILTER (paid) FROM b""")
def _(t):
    return _handlers(t)[1].drop("requeues")


@query("x01_extra_cities", f"WITH {_LOC} SELECT location, CASE id % 15 WHEN 3 THEN 'GR' WHEN 4 THEN 'XX' ELSE c END AS country, CASE WHEN id % 15 = 3 THEN 'gazetteer-city' ELSE coalesce(tier, 'unmatched') END AS confidence FROM r WHERE location IS NOT NULL")
def _(t):
    extra = geo.load_phrases(t.spark, ["GR atlantis", "XX berlin"], False)
    return geo.resolve_locations(locations(t).where("location IS NOT NULL"), geo.country_phrases(t.spark), geo.city_phrases(t.spark), extra=extra)


@F.pandas_udf(T.StringType())
def asked(phrases: pd.Series) -> pd.Series:
    """A stand-in for a geocoder: knows one place, and answers another one with what is no code."""
    return phrases.map(lambda p: "gr" if p == "atlantis" else "nowhere")


@query("x02_geocoder", f"WITH {_LOC} SELECT location, CASE id % 15 WHEN 3 THEN 'GR' ELSE c END AS country, CASE WHEN id % 15 = 3 THEN 'geocoder' ELSE coalesce(tier, 'unmatched') END AS confidence FROM r WHERE location IS NOT NULL")
def _(t):
    return geo.resolve_locations(locations(t).where("location IS NOT NULL"), geo.country_phrases(t.spark), geo.city_phrases(t.spark), geocoder=asked)


@query("l11_build_corpus", "WITH d AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS o_totalprice, max_by(o_orderpriority, o_orderkey) AS p, max(o_orderdate) AS pushed, min(o_orderkey) AS pos FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), k AS (SELECT * FROM d ORDER BY o_totalprice DESC, pushed DESC, pos LIMIT 500) SELECT o_custkey, o_totalprice FROM k WHERE o_totalprice >= 20000 AND p <> '1-URGENT'")
def _(t):
    keep = lambda c: F.when(c, P.KEEP).otherwise(P.DROP)
    filters = {"min_stars": keep(P.min_stars("o_totalprice", 20000)), "team_topic": keep(F.col("o_orderpriority") != "1-URGENT")}
    spec = runs.CorpusSpec(F.col("o_orderstatus") != "F", filters, max_candidates=500, columns={"stars": "o_totalprice", "pushed": "o_orderdate", "id": "o_custkey", "seq": "o_orderkey"})
    return runs.build_corpus(t.orders, spec)[0].select("o_custkey", "o_totalprice")


@query("l12_replay", f"WITH {_RUNS} SELECT l_orderkey AS run_id, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT max_by(id, (created_at, id)) FROM r WHERE status IN ('done', 'partial') AND filter_hash = (SELECT max(filter_hash) FROM r WHERE status = 'done'))")
def _(t):
    rows = run_rows(t)
    value = rows.where("status = 'done'").agg(F.max("filter_hash").alias("h")).first().h
    items = t.lineitem.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_quantity")
    return runs.replay(rows, items, "filter_hash", value)[1]


@query("l13_freeze", f"WITH {_RUNS} SELECT 'spring' AS name, min(id) AS source_run_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = (SELECT min(id) FROM r WHERE status = 'done')) AS repo_count FROM r WHERE status = 'done'")
def _(t):
    rows = run_rows(t)
    run_id = rows.where("status = 'done'").agg(F.min("id").alias("m")).first().m
    empty = t.spark.createDataFrame([], "name string, source_run_id long, repo_count long, frozen_at string, note string")
    return runs.freeze(empty, rows, t.lineitem.withColumnRenamed("l_orderkey", "run_id"), run_id, "spring", F.lit("2024-01-01")).select("name", "source_run_id", "repo_count")


@query("l14_size_share", "WITH e AS (SELECT l_orderkey, l_returnflag AS language, sum(l_quantity) AS bytes FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, language, bytes, round(bytes / sum(bytes) OVER (PARTITION BY l_orderkey), 6) AS share FROM e")
def _(t):
    return runs.size_share(languages(t), "l_orderkey", "languages")


@query("l16_change_log", "SELECT p_partkey, '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}' AS before, '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || (p_size + 1) || '}' AS after FROM part WHERE p_partkey % 3 = 0")
def _(t):
    after = t.part.withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return runs.change_log(t.part, after, "p_partkey", ["p_size", "p_brand"]).select("p_partkey", "before", "after")


@query("t03_quota_windows", L + ", q AS (SELECT *, CASE resource WHEN 'search' THEN 30 WHEN 'code_search' THEN 10 ELSE 5000 END AS quota, CASE WHEN resource IN ('search', 'code_search') THEN 60 ELSE 3600 END AS s FROM lg) SELECT resource, token, (floor(epoch(ts) / s) * s)::BIGINT AS start, count(*) AS used, greatest(any_value(quota) - count(*), 0)::BIGINT AS remaining, count(*) >= any_value(quota) AS exhausted FROM q GROUP BY resource, token, start")
def _(t):
    used = logs.quota_windows(response_log(t), logs.quota_table(t.spark))
    return used.withColumn("start", F.round(S.epoch_s("start")).cast("long")).withColumn("remaining", F.col("remaining").cast("long"))


_FIRST_USE = L.replace("WITH lg", "WITH RECURSIVE lg") + """, q AS (SELECT resource, token, epoch_us(ts) AS t, CASE WHEN resource IN ('search', 'code_search') THEN 60 ELSE 3600 END::BIGINT * 1000 AS s, CASE resource WHEN 'search' THEN 3 WHEN 'code_search' THEN 1 ELSE 500 END AS quota FROM lg),
p AS (SELECT DISTINCT resource, token, t, s FROM q), l AS (SELECT resource, token, t, s, (SELECT min(b.t) FROM p b WHERE b.resource = a.resource AND b.token = a.token AND b.t >= a.t + a.s * 1000000) AS following FROM p a),
c AS (SELECT resource, token, min(t) AS t FROM p GROUP BY 1, 2 UNION ALL SELECT c.resource, c.token, l.following FROM c JOIN l ON l.resource = c.resource AND l.token = c.token AND l.t = c.t WHERE l.following IS NOT NULL)
SELECT resource, token, start::BIGINT AS start, count(*) AS used, greatest(any_value(quota) - count(*), 0)::BIGINT AS remaining, count(*) >= any_value(quota) AS exhausted
FROM (SELECT q.resource, q.token, q.quota, c.t AS start FROM q ASOF JOIN c ON q.resource = c.resource AND q.token = c.token AND q.t >= c.t) GROUP BY 1, 2, 3"""


@query("t03_first_use_windows", _FIRST_USE)
def _(t):
    """Windows a thousand times as long as the quotas', as the log is sparse."""
    quotas = logs.quota_table(t.spark).select("resource", F.floor(F.col("quota") / 10).cast("int").alias("quota"), (F.col("seconds") * 1000).alias("seconds"))
    used = logs.first_use_windows(response_log(t), quotas)
    return used.select("resource", "token", F.unix_micros("start").alias("start"), "used", F.col("remaining").cast("long").alias("remaining"), "exhausted")


_SESSION = ", h AS (SELECT token, ts, id, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 86400 THEN 1 ELSE 0 END AS fresh FROM lg WHERE status IN (403, 429) WINDOW w AS (PARTITION BY token ORDER BY ts, id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY token ORDER BY ts, id) AS g FROM h) SELECT token, count(*) AS hits, epoch(min(ts))::BIGINT AS first, epoch(max(ts))::BIGINT AS last FROM s GROUP BY token, g"  # noqa: E501


@query("t04_throttle_sessions", L + _SESSION.replace("(epoch", "(epoch"))
def _(t):
    s = logs.throttle_sessions(response_log(t), "token", gap="86400 seconds")
    return s.select("token", "hits", F.round(S.epoch_s("first")).cast("long").alias("first"), F.round(S.epoch_s("last")).cast("long").alias("last"))


_PANES = ", w AS (SELECT unnest(range((epoch(ts)::BIGINT // 60 - 9) * 60, (epoch(ts)::BIGINT // 60 + 1) * 60, 60)) AS start, * FROM (SELECT * REPLACE (to_timestamp(floor(epoch(ts))) AS ts) FROM lg))"


@query("t05_live_slo", L + _PANES + """ SELECT start, count(*) AS n, count(*) FILTER (status IN (403, 429)) AS throttled, round(avg(latency_ms), 4) AS mean_latency,
max_by(remaining, (ts, id)) FILTER (resource = 'graphql')::BIGINT AS graphql_remaining, round(count(*) FILTER (incomplete) / nullif(count(incomplete), 0), 6) AS incomplete_results_ratio,
round(count(*) FILTER (status = 422) / count(*), 6) AS rate_422, round(count(*) FILTER (status IN (403, 429)) / count(*), 6) AS rate_403_429, list_sort(list(latency_ms))[ceil(count(latency_ms) * 0.95)::INT] AS p95_latency_ms FROM w GROUP BY 1""")
def _(t):
    log = response_log(t)
    found = logs.live_slo(log.withColumn("ts", F.timestamp_seconds(F.floor(S.epoch_s("ts")))), digits=4)
    ratios = [S.rounded(c, 6).alias(c) for c in ("incomplete_results_ratio", "rate_422", "rate_403_429")]
    return found.select(F.round(S.epoch_s("start")).cast("long").alias("start"), "n", "throttled", "mean_latency", "graphql_remaining", *ratios, "p95_latency_ms")


def slo_tables(t: Tables):
    """States of windows and confidences of owners."""
    states = t.orders.select(F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state"))
    owners = t.customer.select(F.when(F.col("c_custkey") % 3 == 0, "unmatched").otherwise("name").alias("confidence"))
    return {"windows": states, "owners": owners}


@query("t05_last_n", _SLO)
def _(t):
    """The metrics of the newest 1,000 responses, folded over a stream of four batches, old responses among the last."""
    target, log = shared.scratch(t.spark), response_log(t)
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(4):
        log.where(F.pmod(F.xxhash64("id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(f"{target}/in")
    source = streams.read_stream(t.spark, f"{target}/in", log.schema)
    slo.stream_last_n(source, f"{target}/out", f"{target}/log", tables=lambda spark: slo_tables(t)).awaitTermination()
    found = slo.read_last_n(t.spark, f"{target}/out")
    return rounded_slo(found.orderBy(F.desc("v")).limit(1))


_STATES = "['done', 'pending', 'active', 'pending', 'incomplete', 'active', 'pending', 'done', 'active', 'active', 'done', 'active'][(event_id * 7 % 12 + 1)::INT]"


@query("t07_window_states", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_STATES} AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS previous, NULL::VARCHAR AS state, NULL::BOOLEAN AS legal, 'pending'::VARCHAR AS now FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.i, e.event_id, f.now, e.state, (f.now, e.state) IN (('pending', 'active'), ('active', 'done'), ('active', 'incomplete'), ('active', 'pending')),
  CASE WHEN (f.now, e.state) IN (('pending', 'active'), ('active', 'done'), ('active', 'incomplete'), ('active', 'pending')) THEN e.state ELSE f.now END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, previous, state, legal FROM f WHERE i > 0""")
def _(t):
    asked = ("done", "pending", "active", "pending", "incomplete", "active", "pending", "done", "active", "active", "done", "active")
    state = F.get(F.array(*[F.lit(s) for s in asked]), (F.col("event_id") * 7 % 12).cast("int"))
    return windows.window_states(t.events.select("user_id", "event_id", state.alias("state")), "user_id", "event_id").select("event_id", "previous", "state", "legal")


@query("c_text_functions", """SELECT p_partkey, p_name AS last, p_brand AS first, substr(sha256(p_name), 1, 12) AS fp, CASE WHEN p_partkey % 2 = 0 THEN 'AB' END AS iso, ['timeout', 'abuse', NULL, 'rate limit', 'again', 'secondary rate', NULL][(p_partkey % 7 + 1)::INT] IN ('timeout', 'abuse', 'rate limit', 'secondary rate') IS TRUE AS transient, coalesce(['timeout', 'abuse', NULL, 'rate limit', 'again', 'secondary rate', NULL][(p_partkey % 7 + 1)::INT] IN ('abuse', 'rate limit', 'secondary rate'), false) AS limited,
CASE p_partkey % 3 WHEN 0 THEN 'Finished' ELSE p_type END AS label, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'true' END AS cell FROM part""")
def _(t):
    name = F.concat_ws("/", "p_brand", "p_name")
    code = F.when(F.col("p_partkey") % 2 == 0, " ab ").otherwise("abc")
    marks = [F.lit(x) for x in ("timeout", "ABUSE detected", None, "API rate limit", "again", "Secondary rate", None)]
    error = F.concat_ws(" ", "p_type", F.get(F.array(*marks), (F.col("p_partkey") % 7).cast("int")))
    return t.part.select(
        "p_partkey", S.last_segment(name).alias("last"), S.owner_prefix(name).alias("first"), S.fingerprint("p_name").alias("fp"), S.valid_iso(code).alias("iso"),
        F.coalesce(S.is_transient(error), F.lit(False)).alias("transient"), F.coalesce(S.is_rate_limit(error), F.lit(False)).alias("limited"), S.status_label(F.when(F.col("p_partkey") % 3 == 0, "done").otherwise(F.col("p_type"))).alias("label"),
        S.csv_cell(F.when(F.col("p_partkey") % 4 != 0, F.lit(True))).alias("cell"),
    )


@query("c_time_functions", """WITH x AS (SELECT o_orderkey, o_orderdate, o_orderkey % 7 = 0 AS none, [30, 307, 11100, 345600, 3456000][(o_orderkey % 5 + 1)::INT] AS s FROM orders)
SELECT o_orderkey, CASE WHEN NOT none THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '.250000' ELSE '' END || 'Z' END AS iso,
CASE WHEN none THEN '—' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' ELSE s // 2592000 || 'mo ago' END AS ago,
CASE WHEN none THEN '—' WHEN s < 60 THEN s || '.0s' ELSE s // 60 || 'm ' || s % 60 || 's' END AS took,
CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || (s // 60) % 60 || 'm' END AS span FROM x""")
def _(t):
    k = F.col("o_orderkey")
    s = F.get(F.array(*[F.lit(x) for x in (30, 307, 11100, 345600, 3456000)]), (k % 5).cast("int"))
    day = F.col("o_orderdate").cast("timestamp")
    rows = t.orders.select("o_orderkey", s.alias("s"), F.when(k % 7 != 0, day).alias("at"), F.timestamp_seconds(F.unix_timestamp(day) + s).alias("now"))
    exact = F.when(k % 2 == 0, F.timestamp_millis(F.unix_timestamp("at") * 1000 + 250)).otherwise(F.col("at"))
    return rows.select("o_orderkey", S.iso_utc(exact).alias("iso"), S.relative_time("at", F.col("now")).alias("ago"), S.duration_text("at", "now").alias("took"), S.span_text("s").alias("span"))


@query("c_url_functions", r"""SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS query, CASE lower(regexp_extract(url, '^https?://[^/?#]*\.([a-zA-Z]+)(?:[:/?#]|$)', 1)) WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' WHEN 'uk' THEN 'GB' WHEN 'in' THEN 'IN' END AS country,
url AS next, (page_id % 50)::INT AS last_page, 'v' || page_id AS header FROM pages""")
def _(t):
    link = F.concat(F.lit("<"), F.regexp_replace("url", "[<>]", ""), F.lit('>; rel="next", <https://x.y/a?page='), (F.col("page_id") % 50).cast("string"), F.lit('&q=1>; rel="last"'))
    query_text = F.array_join(F.transform(F.map_entries(S.url_params("url")), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    headers = F.create_map(F.lit("X-Test"), F.concat(F.lit("v"), F.col("page_id").cast("string")))
    return t.pages.select(
        "page_id", query_text.alias("query"), S.host_tld_iso("url").alias("country"), S.link_next(link).alias("next"), S.link_last_page(link).alias("last_page"),
        S.header_value(headers, "x-test").alias("header"),
    )


@query("c_location_functions", """SELECT o_orderkey, 'order ' || o_orderkey || ' x' AS norm, 'DE' AS flag, lower(regexp_replace(o_orderpriority, '[^0-9A-Za-z]+', ' ', 'g')) || '|b' AS parts, CASE o_orderkey % 7 WHEN 3 THEN 'IR' WHEN 5 THEN 'NP' END AS tz,
'order ' || o_orderkey || '|order' AS prefixes FROM orders""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    tz = F.when(F.col("o_orderkey") % 7 == 3, 3.45).when(F.col("o_orderkey") % 7 == 5, 5.75).otherwise(float("inf"))
    norm = S.normalize_location(F.concat(F.lit("  Order-"), k, F.lit("!! X")))
    return t.orders.select(
        "o_orderkey", norm.alias("norm"), S.flag_to_iso(F.concat(k, F.lit(" 🇩🇪 🇫🇷"))).alias("flag"), F.array_join(S.split_candidates(F.concat("o_orderpriority", F.lit(" / B ("))), "|").alias("parts"),
        S.tz_iso(tz).alias("tz"), F.array_join(S.prefix_phrases(norm), "|").alias("prefixes"),
    )


@query("c_json_functions", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::BIGINT WHEN 1 THEN event_id::BIGINT WHEN 4 THEN 0 END AS counted, CASE event_id % 5 WHEN 0 THEN event_id::BIGINT WHEN 1 THEN event_id::BIGINT END AS optional, event_id % 5 NOT IN (2, 3) AS valid, sha256('{\"a\":\"' || event_type || '\",\"b\":\"' || user_id || '\"}') AS asked, json_extract_string(props, '$.k') = '5' AS five, json_extract_string(props, '$.k')::BIGINT AS k, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS hash, 'Error: x' AS err, TIMESTAMP '2024-01-02 03:04:05' AS at FROM events")
def _(t):
    flag = F.to_json(F.struct((F.get_json_object("props", "$.k") == "5").alias("f")))
    k, id_ = F.col("event_id") % 5, F.col("event_id").cast("string")
    raw = F.when(k == 0, id_).when(k == 1, F.concat(id_, F.lit(".75"))).when(k == 2, F.concat(id_, F.lit(".5"))).when(k == 3, "true")
    optional = S.coerce_optional_int(raw, k == 2)
    asked_for = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return t.events.select(
        "event_id", S.coerce_count(raw, k == 2).alias("counted"), optional["value"].alias("optional"), optional["valid"].alias("valid"), S.query_hash(asked_for).alias("asked"), S.json_bool(flag, "$.f").alias("five"), S.coerce_count(F.get_json_object("props", "$.k")).alias("k"), S.spec_hash(["user_id", "event_type"]).alias("hash"),
        S.short_error(F.concat(F.lit("Error: x: {"), F.col("event_id").cast("string"), F.lit("}\nmore"))).alias("err"), S.parse_ts(F.lit("2024-01-02T03:04:05Z")).alias("at"),
    )


@query("c14_primary_language", "WITH e AS (SELECT l_orderkey, l_returnflag AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, first(k ORDER BY v DESC, k) AS name, first(v ORDER BY v DESC, k) AS bytes FROM e GROUP BY 1")
def _(t):
    return languages(t).select("l_orderkey", S.primary_language("languages").alias("p")).select("l_orderkey", "p.name", "p.bytes")
