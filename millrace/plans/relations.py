"""Queries for joins, set operations, windows, sorts and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.operators import logs, merge, relational as R, runs, selection, slices, windows
from millrace.operators.selection import Order
from millrace.plans.filters import ORDER
from millrace.plans.registry import Tables, query

_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
FIELDS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def snapshots(t: Tables):
    """Two runs: the second lacks some orders, has others, and changes prices and statuses."""
    a = t.orders.where("o_orderdate < '2000-01-01'").select("o_orderkey", "o_orderpriority", *FIELDS[:2])
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderstatus"))
    b = t.orders.where("o_orderdate >= '1996-01-01'").select("o_orderkey", "o_orderpriority", status.alias("o_orderstatus"), changed.alias("o_totalprice"))
    return a, b


_AB = """a AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < '2000-01-01'),
b AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate >= '1996-01-01')"""


@query("j01_with_owner", "SELECT o_orderkey, o_custkey, c_name AS owner_c_name, c_mktsegment AS owner_c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return R.with_owner(t.orders.select("o_orderkey", "o_custkey"), t.customer, "o_custkey", "c_custkey", ["c_name", "c_mktsegment"])


@query("j02_items_with_repo", "SELECT l_orderkey, l_linenumber, o_orderstatus AS repo_o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def _(t):
    return R.items_with_repo(t.lineitem.select("l_orderkey", "l_linenumber"), t.orders.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey", ["o_orderstatus"])


@query("j03_restrict_to_ids", f"SELECT {_COLS} FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def _(t):
    ids = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.restrict_to_ids(t.orders, ids, "o_orderkey").select(*ORDER)


@query("j04_new_rows", f"SELECT {_COLS} FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return merge.new_rows(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select(*ORDER)


@query("j05_renamed", f"WITH {_AB} SELECT b.o_orderkey, b.o_orderstatus AS current, a.o_orderstatus AS previous FROM b JOIN a USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def _(t):
    a, b = snapshots(t)
    return merge.renamed(b, a, "o_orderkey", "o_orderstatus")


_DIFF = f"""WITH {_AB}, j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.o_orderkey AS ka, b.o_orderkey AS kb,
  a.o_orderstatus AS sa, b.o_orderstatus AS sb, a.o_totalprice AS pa, b.o_totalprice AS pb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey AND a.o_orderpriority = b.o_orderpriority)
SELECT CASE WHEN ka IS NULL THEN 'added' ELSE 'removed' END AS kind, o_orderkey, o_orderpriority, 0 AS ord, NULL AS field, NULL AS old, NULL AS new FROM j WHERE ka IS NULL OR kb IS NULL
UNION ALL SELECT 'changed', o_orderkey, o_orderpriority, 0, 'o_orderstatus', sa, sb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND sa IS DISTINCT FROM sb
UNION ALL SELECT 'changed', o_orderkey, o_orderpriority, 1, 'o_totalprice', round(pa, 2)::VARCHAR, round(pb, 2)::VARCHAR FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND pa IS DISTINCT FROM pb"""


@query("j06_diff_runs", _DIFF)
def _(t):
    a, b = snapshots(t)
    changes = R.diff_runs(a, b, FIELDS[:2], ("o_orderkey", "o_orderpriority"))
    number = lambda c: F.when(F.col("field") == "o_totalprice", F.round(F.col(c).cast("double"), 2).cast("string")).otherwise(F.col(c))
    return changes.select("kind", "o_orderkey", "o_orderpriority", "ord", "field", number("from").alias("old"), number("to").alias("new"))


@query("j06_diff_summary", f"WITH d AS ({_DIFF}) SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(DISTINCT o_orderkey) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'changed') AS fields_changed FROM d")
def _(t):
    a, b = snapshots(t)
    key = ("o_orderkey", "o_orderpriority")
    return R.diff_summary(R.diff_runs(a, b, FIELDS[:2], key), key)


def run_rows(t: Tables):
    """orders as runs: hash is the customer, created at the date."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("filter_hash"), F.col("o_orderdate").alias("created_at"),
                           F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("done").alias("status"))


_RUNS = "r AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS filter_hash, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial' ELSE 'done' END AS status FROM orders)"


@query("j08_corpora_with_runs", f"WITH {_RUNS} SELECT s_suppkey, id AS source_run_id, status AS run_status FROM supplier JOIN r ON id = s_suppkey * 5")
def _(t):
    corpora = t.supplier.select("s_suppkey", (F.col("s_suppkey") * 5).alias("source_run_id"), F.lit("2024-01-01").alias("frozen_at"))
    return runs.corpora_with_runs(corpora, run_rows(t)).select("s_suppkey", "source_run_id", "run_status")


@query("j09_coalesce_detail", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_type END, s_name) AS p_type, coalesce(s_name, split_part(p_brand || '/' || p_name, '/', 1)) AS owner_login FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def _(t):
    items = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("p_type"), F.concat_ws("/", "p_brand", "p_name").alias("full_name"))
    details = t.supplier.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_type"), F.col("s_name").alias("login"))
    return R.coalesce_detail(items, details, "p_partkey", ["p_type"], "full_name", "login").select("p_partkey", "p_type", "owner_login")


@query("j10_filters_with_last_run", f"WITH {_RUNS}, w AS (SELECT *, row_number() OVER (PARTITION BY filter_hash ORDER BY created_at DESC, id DESC) AS n FROM r) SELECT c_name, filter_hash, id, status FROM (SELECT c_name, c_custkey::VARCHAR AS filter_hash FROM customer) LEFT JOIN (SELECT * FROM w WHERE n = 1) USING (filter_hash)")
def _(t):
    filters = t.customer.select("c_name", F.col("c_custkey").cast("string").alias("filter_hash"))
    return R.filters_with_last_run(filters, run_rows(t), "filter_hash", ["created_at", "id"]).select("c_name", "filter_hash", "id", "status")


MONTHS = [(dt.date(y, m, 1), (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1))) for y in range(1994, 2003) for m in range(1, 13)]


@query("j11_assign_windows", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS window_lo FROM orders")
def _(t):
    months = t.spark.createDataFrame(MONTHS, "lo date, hi date")
    return R.assign_windows(t.orders, months, "o_orderdate").select("o_orderkey", F.col("window_lo").cast("string").alias("window_lo"))


_RANGES = "WITH r AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_custkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)), s AS (SELECT k, CASE WHEN i < (n // 7 + 1) * (n % 7) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n // 7 + 1) * (n % 7)) // (n // 7) END AS segment FROM r) SELECT o_orderkey, segment::INT AS segment FROM orders JOIN s ON o_custkey = k WHERE segment <> 3"  # noqa: E501


@query("j11_assign_ranges", _RANGES)
def _(t):
    """Orders in the even segments of customers, but for the middle one."""
    segments = R.even_segments(t.orders, "o_custkey", 7).where("segment <> 3")
    return slices.assign_ranges(t.orders, segments, "o_custkey").select("o_orderkey", "segment")


@query("j11_many_ranges", "SELECT l_orderkey, l_linenumber, c_custkey FROM lineitem JOIN customer ON l_partkey > c_custkey * 3 - 3 AND l_partkey <= c_custkey * 3 - 1")
def _(t):
    """As many ranges as customers, sorted together with the rows."""
    ranges = t.customer.select("c_custkey", (F.col("c_custkey") * 3 - 3).alias("after"), (F.col("c_custkey") * 3 - 1).alias("upto"))
    return slices.assign_ranges(t.lineitem, ranges, "l_partkey", most=0).select("l_orderkey", "l_linenumber", "c_custkey")


@query("j12_purge_cascade", "SELECT l_orderkey % 100 AS g, count(o_orderkey) AS kept_refs, count(*) AS items FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < '1996-01-01')) ON l_orderkey = o_orderkey GROUP BY 1")  # noqa: E501
def _(t):
    deleted = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    _, gone = merge.purge(t.orders.withColumn("deleted_at", deleted), F.lit("1996-01-01").cast("timestamp"))
    items = t.lineitem.select("l_orderkey", (F.col("l_orderkey") % 100).alias("g"))
    nulled, _ = merge.purge_cascade(gone, items, items, "o_orderkey", "l_orderkey")
    return nulled.groupBy("g").agg(F.count("l_orderkey").alias("kept_refs"), F.count(F.lit(1)).alias("items"))


@query("j13_owners_once", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    lookup = lambda owners: owners.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    return R.owners_once(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", lookup).select("o_orderkey", "c_mktsegment")


@query("u01_append_history", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 UNION SELECT c_custkey, upper(c_name) || '!' FROM customer WHERE c_acctbal <= 500")
def _(t):
    history = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    again = t.customer.where("c_acctbal > 5000").select("c_custkey", F.upper("c_name").alias("c_name"))
    more = t.customer.where("c_acctbal <= 500").select("c_custkey", F.concat(F.upper("c_name"), F.lit("!")).alias("c_name"))
    return merge.append_history(history, again, more, more, key="c_custkey", name="c_name")


@query("u02_merge_results", "SELECT o_custkey, min(o_orderkey) AS position, max_by(o_totalprice, o_orderkey) AS o_totalprice, max(o_orderdate)::DATE::VARCHAR AS pushed FROM orders GROUP BY 1")
def _(t):
    cols = ["o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"]
    parts = [t.orders.where(F.col("o_orderstatus") == s).select(*cols) for s in ("F", "O", "P")]
    return merge.merge_results(parts, "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "position", "o_totalprice", F.to_date("o_orderdate").cast("string").alias("pushed"))


@query("u03_id_overlap", f"WITH {_AB}, f AS (SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM a FULL JOIN b USING (o_orderkey)) SELECT count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) * 100.0 / count(*), 4)::DOUBLE AS overlap_pct FROM f")
def _(t):
    return R.id_overlap(*snapshots(t), "o_orderkey")


@query("u04_merge_windows", """WITH c AS (SELECT o_custkey, greatest(o_orderdate::DATE, DATE '1996-01-01') AS lo, least(o_orderdate::DATE + (o_orderkey % 200)::INT, DATE '2000-12-31') AS hi FROM orders),
d AS (SELECT * FROM c WHERE lo <= hi), m AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, min(lo)::VARCHAR AS lo, max(hi)::VARCHAR AS hi FROM i GROUP BY o_custkey, island""")
def _(t):
    day = F.to_date("o_orderdate")
    spans = t.orders.select("o_custkey", day.alias("lo"), F.date_add(day, (F.col("o_orderkey") % 200).cast("int")).alias("hi"))
    merged = windows.merge_windows(spans, F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"), by="o_custkey")
    return merged.select("o_custkey", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


@query("u05_union_root_listing", """WITH p AS (SELECT page_id % 20 AS repo_id, url AS path, page_id % 4 = 0 AS root, page_id % 20 < 5 AS cut FROM pages)
SELECT DISTINCT repo_id, path, cut AND repo_id % 4 <> 0 AS truncated FROM p WHERE NOT root OR (cut AND EXISTS (SELECT 1 FROM p q WHERE NOT q.root AND q.repo_id = p.repo_id))""")
def _(t):
    repo = F.col("page_id") % 20
    rows = t.pages.select(repo.alias("repo_id"), F.col("url").alias("path"), F.lit("blob").alias("type"), (repo < 5).alias("truncated"), (F.col("page_id") % 4 == 0).alias("root"))
    root = rows.where("root").withColumn("truncated", F.col("repo_id") % 2 != 0)
    return R.read_paths(rows.where("NOT root"), root)


@query("w01_latest_per_key", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate)::DATE::VARCHAR AS day FROM orders GROUP BY 1")
def _(t):
    last = R.latest_per_key(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return last.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("w02_dedupe_latest", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS position, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity, max(l_shipdate)::DATE::VARCHAR AS pushed FROM lineitem GROUP BY 1")
def _(t):
    rows = t.lineitem.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_quantity", "l_shipdate")
    return merge.dedupe_latest(rows, "l_partkey", "seq", "l_shipdate").select("l_partkey", "position", "l_quantity", F.to_date("l_shipdate").cast("string").alias("pushed"))


@query("w03_previous_runs", f"WITH {_RUNS}, w AS (SELECT id, filter_hash, row_number() OVER (PARTITION BY filter_hash ORDER BY created_at, id) AS n FROM r) SELECT a.id, b.id AS previous, (a.n - b.n)::INT AS rank FROM w a JOIN w b ON a.filter_hash = b.filter_hash AND b.n BETWEEN a.n - 3 AND a.n - 1")
def _(t):
    return R.previous_runs(run_rows(t), "filter_hash", "created_at", "id")


@query("w04_latest_ready", f"WITH {_RUNS} SELECT filter_hash, max_by(id, (created_at, id)) AS id FROM r WHERE status IN ('done', 'partial') GROUP BY 1")
def _(t):
    return R.latest_ready(run_rows(t), "filter_hash", ["created_at", "id"], "status", ["done", "partial"]).select("filter_hash", "id")


@query("w05_last_n_rows", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(t):
    return R.last_n_rows(t.events, ["ts", "event_id"], 1000).select("event_id", "user_id")


_SEGMENTS = "WITH r AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_custkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)), s AS (SELECT k, CASE WHEN i < (n // 7 + 1) * (n % 7) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n // 7 + 1) * (n % 7)) // (n // 7) END AS segment FROM r), g AS (SELECT segment::INT AS segment, min(k) AS lo, max(k) AS upto, count(*) AS n FROM s GROUP BY 1) SELECT segment, coalesce(lag(upto) OVER (ORDER BY segment), lo - 1) AS after, upto, n FROM g"  # noqa: E501


@query("w08_even_segments", _SEGMENTS)
def _(t):
    return R.even_segments(t.orders, "o_custkey", 7)


@query("o01_rank_candidates", f"SELECT {_COLS}, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS nth FROM orders")
def _(t):
    return R.number_rows(R.rank_candidates(t.orders, "o_totalprice", "o_orderdate", "o_orderkey"), "nth").select(*ORDER, "nth")


@query("o02_sort_result", f"SELECT {_COLS}, row_number() OVER (ORDER BY o_totalprice, o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    found = R.sort_result(t.orders.where("o_orderstatus <> 'F'"), "stars", {"stars": "o_totalprice"}, "o_orderdate", "o_orderkey", descending=False)
    return R.number_rows(found, "nth").select(*ORDER, "nth")


@query("o03_page_after", f"SELECT {_COLS} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 100")
def _(t):
    last = R.page_of(t.orders, "stars", {"stars": "o_totalprice"}, "o_orderkey", 1, 100).orderBy("o_totalprice", F.desc("o_orderkey")).select("o_totalprice", "o_orderkey").first()
    return R.page_after(t.orders, "o_totalprice", "o_orderkey", tuple(last), 100).select(*ORDER)


@query("o03_page_of", f"SELECT {_COLS}, 2 AS page, (SELECT ((count(*) + 99) // 100)::INT FROM orders) AS pages FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 100")
def _(t):
    return R.page_of(t.orders, "stars", {"stars": "o_totalprice"}, "o_orderkey", 2, 100).select(*ORDER, "page", "pages")


@query("o04_slice_page", f"SELECT {_COLS} FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return R.slice_page(t.orders, ["o_orderdate", "o_orderkey"], 3, 50).select(*ORDER)


@query("o05_cap", "SELECT greatest(count(*) - 1000, 0) AS dropped, greatest(least(count(*), 1000) - 400, 0) AS not_detailed, 0 + (SELECT sum(k) FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000))::BIGINT AS keys FROM orders")
def _(t):
    kept, counts = R.cap(t.orders, [Order("o_totalprice", descending=True), Order("o_orderkey")], 1000, 400)
    return counts.crossJoin(kept.agg(F.sum("o_orderkey").alias("keys")))  # one row each


@query("o03_deep_page", """WITH s AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM s WHERE i >= n * 2 // 3 AND i < n * 2 // 3 + 200""")
def _(t):
    """A page from the second third on, found by place; ties of day and price are told apart by the key."""
    keys = [Order("l_shipdate"), Order("l_extendedprice", descending=True), Order("l_orderkey"), Order("l_linenumber")]
    start = t.lineitem.count() * 2 // 3
    return selection.slice_rows(t.lineitem, keys, start, start + 200, most=1000).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("o05_large_cap", """WITH s AS (SELECT *, row_number() OVER (ORDER BY l_quantity DESC, l_extendedprice, l_orderkey, l_linenumber) AS i, count(*) OVER () AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity FROM s WHERE i <= n // 2""")
def _(t):
    keys = [Order("l_quantity", descending=True), Order("l_extendedprice"), Order("l_orderkey"), Order("l_linenumber")]
    return selection.first_rows(t.lineitem, keys, t.lineitem.count() // 2, most=1000).select("l_orderkey", "l_linenumber", "l_quantity")


@query("o06_top_items", f"SELECT {_COLS} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def _(t):
    return R.top_items(t.orders, "o_totalprice", "o_orderkey", 100).select(*ORDER)


@query("o07_recent", f"SELECT {_COLS} FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def _(t):
    return R.recent(t.orders, "o_orderdate", "o_orderkey").select(*ORDER)


@query("top_corpus", """WITH l AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01' AND o_totalprice >= 1000)
SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM l JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC LIMIT 50""")  # noqa: E501
def top_corpus(t):
    """Top 50 live records of a date range with enough stars and an owner of a region."""
    live = t.orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).where(P.active())
    wanted = live.where(P.date_filter("o_orderdate", "1996-01-01..1998-12-31") & P.min_stars("o_totalprice", 1000))
    owners = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = wanted.join(owners, F.col("o_custkey") == F.col("c_custkey"))
    return R.sort_result(rows, "stars", {"stars": "o_totalprice"}, "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")


def response_log(t: Tables):
    """events as a log of responses."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    status = F.when(e % 11 == 0, 403).when(e % 13 == 0, 429).when(e % 17 == 0, 422).when(e % 19 == 0, 502).when(e % 23 == 0, 304).otherwise(200)
    quota = F.get(F.array(*[F.lit(r[0]) for r in logs.QUOTAS]), (e % 4).cast("int"))
    return t.events.select(
        e.alias("id"), "ts", F.col("user_id").cast("string").alias("token"), status.alias("status"), quota.alias("resource"), F.col("value").alias("latency_ms"),
        F.col("event_type").alias("phase"), k.alias("cost"), (e % 5000).cast("int").alias("remaining"), F.when(e % 3 != 0, e % 10 == 0).alias("incomplete"),
    )


LOG = """lg AS (SELECT event_id AS id, ts, user_id::VARCHAR AS token, CASE WHEN event_id % 11 = 0 THEN 403 WHEN event_id % 13 = 0 THEN 429 WHEN event_id % 17 = 0 THEN 422 WHEN event_id % 19 = 0 THEN 502 WHEN event_id % 23 = 0 THEN 304 ELSE 200 END AS status,
['search', 'core', 'code_search', 'graphql'][(event_id % 4 + 1)::INT] AS resource, value AS latency_ms, event_type AS phase, json_extract_string(props, '$.k')::INT AS cost, (event_id % 5000)::INT AS remaining, CASE WHEN event_id % 3 <> 0 THEN event_id % 10 = 0 END AS incomplete FROM events)"""
