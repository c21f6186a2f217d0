"""Queries for filters, scans and projections."""

from __future__ import annotations

import contextlib

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions import scalars as S
from millrace.operators import geo, lint, relational, runs, windows
from millrace.plans.registry import Tables, query
from millrace.sources import cursor, records, shared, snapshots
from millrace.streaming import slo, streams

ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def tombstoned(t: Tables):
    """orders with a tombstone on those of status F."""
    return t.orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))


@query("s04_read_scope", f"SELECT {_COLS} FROM orders WHERE o_custkey = 7 AND o_orderpriority = '1-URGENT'")
def _(t):
    return records.read_scope(t.orders, "o_custkey", user="7", kind_col="o_orderpriority", kind="1-URGENT").select(*ORDER)


_PAGES = "WITH a AS (SELECT o_orderkey AS k, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 500)::BIGINT AS page FROM orders WHERE o_orderkey > 100), p AS (SELECT page, count(*) AS n, max(k) AS max_id FROM a GROUP BY page), q AS (SELECT *, max(max_id) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p) SELECT page, n, max_id, max_id AS next_since FROM q WHERE b IS NULL OR b <= 4000"  # noqa: E501


@query("s05_scan_since", _PAGES)
def _(t):
    return windows.scan_since(t.orders, "o_orderkey", since=100, stop_after=4000, page_size=500)


@query("s05_resumed_scan", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 700 % 2)::BIGINT AS page, o_totalprice FROM orders")
def _(t):
    """The whole table, two pages a call, in two writes: half of the calls, and the rest from the cursor that was stored."""
    path, orders = shared.scratch(t.spark), t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderkey") + 1).alias("id"))  # ids above 0
    half = -(-orders.count() // 2800)
    for calls in (half, None):
        cursor.resume_scan(orders, "id", path, page_size=700, max_pages=2, calls=calls)
    return cursor.scanned(t.spark, path).select("o_orderkey", "page", "o_totalprice")


@query("s06_ordered_items", f"SELECT {_COLS}, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    run = F.when(F.col("o_orderstatus") == "P", 7).otherwise(8)
    items = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("stargazers"), F.col("o_orderkey").alias("repo_id"), run.alias("run_id"))
    path = shared.scratch(t.spark)
    for run_id in (7, 8):
        snapshots.snapshot_run(items.where(F.col("run_id") == run_id).drop("run_id"), run_id, path)
    found = relational.number_rows(records.read_run_items(t.spark, path, 7), "nth")
    shared.remove(t.spark, path)  # number_rows has written what it numbers
    return found.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("stargazers").alias("o_totalprice"), "nth")


@query("s07_csv_columns", "SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, '') AS status, CASE WHEN o_custkey > 500 THEN 'true' ELSE 'false' END AS big FROM orders")  # noqa: E501
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), (F.col("o_custkey") > 500).alias("big"))
    return records.csv_columns(rows, ["o_orderkey", "status", "big"])


@query("s08_bundle_items", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'raw ' || o_orderkey ELSE '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' END AS item FROM orders""")  # noqa: E501
def _(t):
    raw = t.orders.withColumn("raw", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("raw "), F.col("o_orderkey").cast("string"))))
    items = records.bundle_items(raw.withColumn("k", F.col("o_orderkey")), "raw", ["o_orderkey", "o_orderstatus"])
    key = F.coalesce(F.get_json_object("item", "$.o_orderkey"), F.regexp_extract("item", r"^raw (\d+)$", 1)).cast("long")
    return items.select(key.alias("o_orderkey"), "item")


@query("s08_bundle_manifest", """SELECT count(*) AS items, 'spring' AS name, 3 AS run_id, '{"o_orderkey":' || count(o_orderkey) || ',"o_clerk":' || count(*) FILTER (o_orderstatus <> 'F') || '}' AS field_stats, sum(o_orderkey)::BIGINT AS keys FROM orders""")
def _(t):
    path = shared.scratch(t.spark)
    items = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("o_clerk"))
    records.write_bundle(items, {"name": "spring", "run_id": 3}, path, None, ["o_orderkey", "o_clerk"])
    keys = t.spark.read.text(f"{path}/items").agg(F.sum(F.get_json_object("value", "$.o_orderkey").cast("long")).alias("keys"))
    manifest = t.spark.read.schema("items long, name string, run_id int, field_stats string").json(f"{path}/manifest")
    return manifest.crossJoin(keys)  # one row each


@query("s10_snapshot_run", "SELECT l_orderkey, l_linenumber, 1 AS run_id FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, 2 FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    path = shared.scratch(t.spark)
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    for run_id, flag in ((1, "N"), (2, "A"), (1, "R")):  # run 1 is written again, run 2 stays
        snapshots.snapshot_run(items.where(F.col("l_returnflag") == flag).drop("l_returnflag"), run_id, path)
    return snapshots.read_snapshots(t.spark, path)


@query("s10_empty_and_failed_runs", "SELECT l_orderkey, l_linenumber, 3 AS run_id FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber, 4 FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    path = shared.scratch(t.spark)
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    of = lambda flag: items.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    for run_id, flag in ((2, "N"), (3, "A"), (4, "R")):
        snapshots.snapshot_run(of(flag), run_id, path, "first")
    snapshots.snapshot_run(of("none"), 2, path)  # run 2 becomes empty
    stops = F.when(F.col("l_orderkey") % 50 == 33, F.raise_error(F.lit("stopped"))).otherwise(F.col("l_linenumber"))
    with contextlib.suppress(PySparkException):  # run 3 stays as it was
        snapshots.snapshot_run(of("N").withColumn("l_linenumber", stops), 3, path)
    snapshots.snapshot_run(of("N"), 4, path, "first")  # the same attempt again changes nothing
    return snapshots.read_snapshots(t.spark, path)


@query("s11_read_paths", "SELECT DISTINCT page_id % 20 AS repo_id, regexp_replace(url, '[?#].*$', '') AS path, false AS truncated FROM pages WHERE page_id % 3 <> 0")
def _(t):
    kind = F.when(F.col("page_id") % 3 != 0, "blob").otherwise("tree")
    listing = t.pages.select((F.col("page_id") % 20).alias("repo_id"), F.regexp_replace("url", "[?#].*$", "").alias("path"), kind.alias("type"), F.lit(False).alias("truncated"))
    return relational.read_paths(listing)


@query("f01_active", f"SELECT {_COLS} FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    return tombstoned(t).where(P.active()).select(*ORDER)


@query("f02_count_filter", f"SELECT {_COLS} FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_custkey > 100 AND o_custkey <= 900")
def _(t):
    return t.orders.where(P.count_filter("o_totalprice", "1000..50000") & P.count_filter("o_custkey", ">100") & P.count_filter("o_custkey", "*..900")).select(*ORDER)


@query("f03_date_filter", f"SELECT {_COLS} FROM orders WHERE o_orderdate::DATE BETWEEN '1996-02-02' AND '1997-03-31'")
def _(t):
    return t.orders.where(P.date_filter("o_orderdate", ">1996-02-01") & P.date_filter("o_orderdate", "*..1997-03-31")).select(*ORDER)


@query("f04_qualifier_union", f"SELECT {_COLS} FROM orders WHERE (o_orderstatus = 'P' OR o_orderstatus = 'O') AND o_orderpriority = '2-HIGH'")
def _(t):
    status = [P.attribute_filter("o_orderstatus", s) for s in ("P", "O")]
    return t.orders.where(P.same_qualifier_union({"status": status, "priority": [P.attribute_filter("o_orderpriority", "2-HIGH")]})).select(*ORDER)


@query("f05_exclude", "SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status FROM orders) WHERE status IS NULL OR status <> 'P'")
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return rows.where(P.exclude(F.col("status") == "P"))


@query("f06_keyword_filter", "SELECT doc_id, source FROM documents WHERE (lower(text) LIKE '%license%' OR lower(text) LIKE '%the and%') AND NOT lower(text) LIKE '%worthless%'")
def _(t):
    return t.documents.where(P.keyword_filter(["text"], ["License", "the and"], op="OR", without=("worthless",))).select("doc_id", "source")


@query("f07_scope_filter", "SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def _(t):
    return t.customer.where(P.scope_filter("c_mktsegment", ["Building", "MACHINERY"])).select("c_custkey", "c_name")


@query("f08_attribute_topic", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), (SELECT lower(split_part(min(p_name), ' ', 1)) FROM part)) AND p_brand = (SELECT min(p_brand) FROM part)")  # noqa: E501
def _(t):
    first = t.part.agg(F.min("p_name").alias("n"), F.min("p_brand").alias("b")).first()
    topics = t.part.withColumn("topics", F.split("p_name", " "))
    return topics.where(P.topic_filter("topics", first.n.split(" ")[0].upper()) & P.attribute_filter("p_brand", first.b)).select("p_partkey", "p_name")


@query("f09_flag_filter", "SELECT p_partkey FROM part WHERE p_size > 25 AND NOT (p_partkey % 2 = 0)")
def _(t):
    flags = t.part.select("p_partkey", (F.col("p_size") > 25).alias("archived"), (F.col("p_partkey") % 2 == 0).alias("is_template"))
    return flags.where(P.flag_filter({"archived": True, "is_template": False})).select("p_partkey")


@query("f10_fork_policy", "SELECT 'exclude' AS policy, count(*) FILTER (NOT p_size > 40) AS n FROM part UNION ALL SELECT 'include', count(*) FROM part UNION ALL SELECT 'only', count(*) FILTER (p_size > 40) FROM part")
def _(t):
    forks = t.part.withColumn("fork", F.col("p_size") > 40)
    one = lambda p: forks.where(P.fork_policy("fork", p)).agg(F.lit(p).alias("policy"), F.count(F.lit(1)).alias("n"))
    return one("exclude").union(one("include")).union(one("only"))


@query("f11_property_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
def _(t):
    return t.events.withColumn("m", F.from_json("props", "map<string,string>")).where(P.property_filter("m", "k", "5")).select("event_id")


@query("f12_min_stars", "SELECT c_custkey, c_acctbal FROM customer WHERE coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) >= 500")
def _(t):
    return t.customer.where(P.min_stars(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), 500)).select("c_custkey", "c_acctbal")


@query("f13_team_topic", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_type), ' '), (SELECT lower(split_part(max(p_type), ' ', 1)) FROM part))")
def _(t):
    topic = t.part.agg(F.max("p_type").alias("m")).first().m.split(" ")[0]
    return t.part.where(P.topic_filter(F.split("p_type", " "), topic)).select("p_partkey")


_LINES = "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"


@query("f14_commit_range", _LINES + " SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n BETWEEN 2 AND 5 THEN 'keep' ELSE 'drop' END AS status, count(*) AS n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1")  # noqa: E501
def _(t):
    commits = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("commits"))
    joined = t.orders.join(commits, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy(P.range_status("commits", 2, 5).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def languages(t: Tables):
    """Per order a map of return flag to quantity: two aggregates, as a map is wanted."""
    each = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return each.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("languages"))


_LANG = "WITH e AS (SELECT l_orderkey, l_returnflag AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, first(k ORDER BY v DESC, k) AS name, first(v ORDER BY v DESC, k) AS bytes FROM e GROUP BY 1)"  # noqa: E501


@query("f15_language_bytes", _LANG + " SELECT o_orderkey, CASE WHEN bytes IS NULL THEN 'unknown' WHEN bytes >= 40 AND bytes <= 90 THEN 'keep' ELSE 'drop' END AS status FROM orders LEFT JOIN m ON o_orderkey = l_orderkey")  # noqa: E501
def _(t):
    # the return flags are few and known, so one aggregate makes the map
    of = [F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))) for flag in "ANR"]
    each = t.lineitem.groupBy("l_orderkey").agg(F.map_from_arrays(F.array(*map(F.lit, "ANR")), F.array(*of)).alias("all"))
    joined = t.orders.join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    languages = F.map_filter("all", lambda _, n: n.isNotNull())
    return joined.select("o_orderkey", P.language_bytes_status(languages, 40, 90).alias("status"))


@query("f16_has_file", """WITH s AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS hit, bool_or(l_linenumber > 6) AS cut FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN hit THEN 'keep' WHEN hit IS NULL OR cut THEN 'unknown' ELSE 'drop' END AS status FROM orders LEFT JOIN s ON o_orderkey = k""")
def _(t):
    paths = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("path"), (F.col("l_linenumber") > 6).alias("truncated"))
    return P.has_file(t.orders.select("o_orderkey"), paths, "o_orderkey", "R")


@query("f17_match_paths", "SELECT page_id % 20 AS repo_id, bool_or(url LIKE 'http%/1%') AS m0, bool_or(url = (SELECT min(url) FROM pages)) AS m1, bool_or(regexp_full_match(url, '(?s).*[0-4]')) AS m2 FROM pages GROUP BY 1")  # noqa: E501
def _(t):
    low = t.pages.agg(F.min("url").alias("u")).first().u
    paths = t.pages.select((F.col("page_id") % 20).alias("repo_id"), F.col("url").alias("path"))
    return P.match_paths(paths, "repo_id", ["http*/1*", low, "*[0-4]"])


_TIERS = "CASE c_custkey % 6 WHEN 0 THEN 'exact-iso' WHEN 1 THEN 'name' WHEN 2 THEN 'gazetteer-city' WHEN 3 THEN 'geocoder' WHEN 4 THEN 'weak' ELSE 'other' END"


@query("f18_country_filter", f"""WITH o AS (SELECT c_custkey, n_name AS country, {_TIERS} AS tier FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN country = 'NATION_0' THEN 'unknown' WHEN country <> 'NATION_3' THEN 'drop' WHEN tier = 'other' THEN 'unknown' WHEN tier IN ('geocoder', 'weak') THEN 'drop' ELSE 'keep' END AS status FROM o""")
def _(t):
    tiers = F.array(*[F.lit(x) for x in [*S.CONFIDENCE, "other"]])
    owners = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("tier", F.get(tiers, (F.col("c_custkey") % 6).cast("int")))
    country = F.when(F.col("n_name") != "NATION_0", F.col("n_name"))
    return owners.select("c_custkey", P.country_status(country, "tier", "NATION_3").alias("status"))


FUNNEL = "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_totalprice >= 20000 AS a, o_orderpriority = '1-URGENT' AS u, n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey), s AS (SELECT CASE WHEN NOT a THEN 0 WHEN NOT u THEN 1 WHEN n IS NULL OR n < 3 THEN 2 ELSE 3 END AS step, n IS NULL AS unk FROM b), c AS (SELECT i AS step, name AS filter, (SELECT count(*) FROM s WHERE s.step >= i) AS checked, (SELECT count(*) FROM s WHERE s.step > i) AS kept, (SELECT count(*) FROM s WHERE s.step = i AND NOT (i = 2 AND unk)) AS dropped, (SELECT count(*) FROM s WHERE s.step = i AND i = 2 AND unk) AS unknown FROM (VALUES (0, 'min_stars'), (1, 'team_topic'), (2, 'min_commits')) v(i, name)) SELECT * FROM c"  # noqa: E501


@query("f19_run_filters", FUNNEL)
def _(t):
    commits = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("commits"))
    rows = t.orders.join(commits, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    keep = lambda c: F.when(c, P.KEEP).otherwise(P.DROP)
    filters = {"min_commits": P.range_status("commits", 3), "min_stars": keep(P.min_stars("o_totalprice", 20000)), "team_topic": keep(F.col("o_orderpriority") == "1-URGENT")}
    return runs.run_filters(rows, filters)[1]


@query("f20_record_only", "SELECT o_orderkey, 'max_loc' AS recorded, true AS incomplete, '`max_loc` is recorded but unenforceable in this run; results are incomplete' AS warning FROM orders")
def _(t):
    marked, warnings = runs.record_only(t.orders, ["max_loc"])
    joined = marked.select("o_orderkey", F.explode("recorded").alias("recorded"), "incomplete").join(warnings, F.col("recorded") == F.col("filter"))
    return joined.select("o_orderkey", "recorded", "incomplete", "warning")


@query("f21_narrows", "SELECT count(*) AS base, count(*) FILTER (o_totalprice > 1000) AS filtered, count(*) FILTER (o_totalprice > 1000) < count(*) AS narrows FROM orders")
def _(t):
    return runs.narrows(t.orders, F.col("o_totalprice") > 1000)


_Q = "'stars:>' || (o_totalprice::BIGINT) || CASE o_orderkey % 5 WHEN 0 THEN ' updated:>2024 ' WHEN 1 THEN ' org:' || o_custkey || ' props.team:core ' WHEN 2 THEN ' props.team:core ' WHEN 3 THEN ' colour:red fork: ' ELSE ' ' END || repeat('AND ', (o_orderkey % 8)::INT) || o_orderpriority"  # noqa: E501


@query("f22_lint_queries", f"""WITH q AS (SELECT o_orderkey, {_Q} AS q, o_orderkey % 5 AS m, o_orderkey % 8 AS ops, len(o_orderpriority) - len(replace(o_orderpriority, ' ', '')) AS spaces FROM orders)
SELECT o_orderkey, (m IN (1, 4) AND ops <= 5) AS ok, (CASE m WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END + (ops > 5)::INT)::BIGINT AS n_errors,
CASE m WHEN 0 THEN 'use `pushed:` + sort=updated' WHEN 2 THEN 'add a single org: scope' ELSE '' END AS hints, concat_ws('|', CASE m WHEN 3 THEN 'empty_value:fork:' END, CASE WHEN ops > 5 THEN 'operator_limit:' || ops END, CASE m WHEN 2 THEN 'property_scope:props.team:core' END, CASE m WHEN 0 THEN 'unknown_qualifier:updated:>2024' WHEN 3 THEN 'unknown_qualifier:colour:red' END) AS errors, (SELECT len(o.o_orderpriority) FROM orders o WHERE o.o_orderkey = q.o_orderkey) - spaces AS keyword_chars, ops AS operators FROM q""")
def _(t):
    m = F.col("o_orderkey") % 5
    middle = (
        F.when(m == 0, " updated:>2024 ").when(m == 1, F.concat(F.lit(" org:"), F.col("o_custkey").cast("string"), F.lit(" props.team:core ")))
        .when(m == 2, " props.team:core ").when(m == 3, " colour:red fork: ").otherwise(" ")
    )
    q = F.concat(F.lit("stars:>"), F.round("o_totalprice").cast("long").cast("string"), middle, F.expr("repeat('AND ', cast(o_orderkey % 8 as int))"), F.col("o_orderpriority"))
    found = lint.lint_queries(t.orders.select("o_orderkey", q.alias("q")), "o_orderkey", "q")
    return found.withColumns({c: F.array_join(c, "|") for c in ("hints", "errors")})


@query("f23_validate_options", """WITH o AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'min_stars' WHEN 1 THEN 'has_dockerfile' WHEN 2 THEN 'team_topic' WHEN 3 THEN 'min_geo_confidence' ELSE 'min_strs' END AS name, event_id % 5 AS m,
CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN (event_id % 100)::VARCHAR ELSE '"' || event_type || '"' END AS value, event_type FROM events),
v AS (SELECT *, CASE WHEN value IS NULL THEN CASE WHEN m = 3 THEN 'gazetteer-city' END WHEN m = 0 AND value NOT LIKE '"%' THEN value WHEN m = 2 AND value LIKE '"%' AND regexp_full_match(event_type, '[a-z0-9][a-z0-9-]{0,49}') THEN event_type END AS normalized FROM o)
SELECT event_id, name, value, (m <> 4 AND (normalized IS NOT NULL OR value IS NULL)) AS ok, normalized, CASE WHEN m = 4 THEN 'min_stars' END AS suggestion FROM v""")
def _(t):
    m = F.col("event_id") % 5
    name = F.when(m == 0, "min_stars").when(m == 1, "has_dockerfile").when(m == 2, "team_topic").when(m == 3, "min_geo_confidence").otherwise("min_strs")
    value = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 2 == 0, (F.col("event_id") % 100).cast("string")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    return lint.validate_options(t.events.select("event_id", name.alias("name"), value.alias("value")))


@query("f24_history_filter", "SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS h FROM orders WHERE o_orderstatus = 'P' AND sha256(o_orderkey::VARCHAR) LIKE 'a%'")
def _(t):
    hashed = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    return runs.history_filter(hashed, status="P", hash_prefix="a", key="h").select("o_orderkey", "h")


@query("f25_column_lists", "SELECT p_partkey AS id, p_brand || '/' || p_name AS full_name, p_type AS language, p_size AS size_kb FROM part")
def _(t):
    return runs.snapshot_columns(t.part, {"id": "p_partkey", "full_name": F.concat_ws("/", "p_brand", "p_name"), "language": "p_type", "size_kb": "p_size"})


def raw_records(t: Tables):
    """part as raw JSON records; some lack a name, have a wrong id, wrong topics or a wrong count."""
    k = F.col("p_partkey")
    fields = F.struct(
        F.when(k % 7 != 0, k).alias("id"), F.concat(F.lit("n"), k.cast("string")).alias("node_id"), F.when(k % 11 != 0, F.concat_ws("/", "p_brand", "p_name")).alias("full_name"),
        F.split("p_name", " ").alias("topics"), F.when(k % 13 == 0, "many").otherwise(F.col("p_size").cast("string")).alias("stargazers_count"), (k % 2 == 0).alias("private"),
        F.struct((k % 50).alias("id"), F.col("p_brand").alias("login")).alias("owner"), F.lit("2024-01-02T03:04:05Z").alias("pushed_at"),
    )
    return t.part.select(F.to_json(fields).alias("value"))


@query("s01_normalize_records", "SELECT p_partkey AS id, p_brand || '/' || p_name AS full_name, p_name AS name, p_size::BIGINT AS stargazers, CASE WHEN p_partkey % 2 = 0 THEN 'private' ELSE 'public' END AS visibility, len(string_split(p_name, ' '))::INT AS topics, p_brand AS owner_login, 'User' AS owner_type FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0")
def _(t):
    clean, _ = records.normalize_records(raw_records(t))
    return clean.select("id", "full_name", "name", "stargazers", "visibility", F.size("topics").alias("topics"), "owner_login", "owner_type")


@query("s01_rejects", "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'id' WHEN p_partkey % 11 = 0 THEN 'full_name' ELSE 'stargazers_count' END AS reason, count(*) AS n FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 GROUP BY 1")
def _(t):
    _, rejects = records.normalize_records(raw_records(t))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def nodes(t: Tables):
    """orders with their lines as nested nodes: language edges are return flags with quantities."""
    edge = F.struct(F.col("l_quantity").cast("long").alias("size"), F.struct(F.col("l_returnflag").alias("name")).alias("node"))
    edges = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(edge).alias("edges"))
    k = F.col("o_orderkey")
    branch = F.when(k % 3 != 0, F.struct(F.lit("main").alias("name"), F.when(k % 3 == 1, F.struct(F.struct((k % 9).cast("int").alias("totalCount")).alias("history"))).alias("target")))
    return t.orders.join(edges, k == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").alias("key"), F.when(k % 5 != 0, k).alias("databaseId"), k.cast("string").alias("id"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("nameWithOwner"), F.lit(None).cast("string").alias("name"),
        F.struct(F.col("o_orderpriority").alias("login"), F.when(k % 2 == 0, "Organization").alias("__typename"), F.col("o_custkey").alias("databaseId")).alias("owner"),
        F.col("o_totalprice").cast("int").alias("stargazerCount"), F.lit(0).alias("forkCount"), F.lit(False).alias("isArchived"), F.lit(False).alias("isFork"), F.lit("PUBLIC").alias("visibility"),
        F.struct(F.col("o_orderstatus").alias("name")).alias("primaryLanguage"), F.struct(F.lit("MIT").alias("spdxId")).alias("licenseInfo"), F.lit("2024-01-01T00:00:00Z").alias("pushedAt"), F.lit(None).cast("string").alias("createdAt"),
        F.struct("edges").alias("languages"), F.struct(F.array(F.struct(F.struct(F.col("o_orderstatus").alias("name")).alias("topic"))).alias("nodes")).alias("repositoryTopics"), branch.alias("defaultBranchRef"),
    )


@query("s02_flatten_nodes", "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey ELSE -1 END AS id, o_orderkey::VARCHAR AS node_id, o_orderstatus AS name, o_orderpriority AS owner_login, CASE WHEN o_orderkey % 2 = 0 THEN 'Organization' ELSE 'User' END AS owner_type, trunc(o_totalprice)::INT AS stargazers, 'public' AS visibility, o_orderstatus AS language, o_orderstatus AS topic FROM orders")
def _(t):
    flat = records.flatten_nodes(nodes(t))
    return flat.select(F.coalesce("id", F.lit(-1)).alias("id"), "node_id", "name", "owner_login", "owner_type", "stargazers", "visibility", "language", F.get("topics", 0).alias("topic"))


@query("s03_flatten_details", """WITH e AS (SELECT l_orderkey, l_returnflag, sum(trunc(l_quantity))::BIGINT AS q FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS id, l_returnflag AS language, q AS bytes, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey % 9 ELSE -1 END::INT AS commit_count FROM orders JOIN e ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0""")
def _(t):
    rows, _ = records.flatten_details(nodes(t))
    return rows.select("id", F.explode("languages").alias("language", "bytes"), F.coalesce("commit_count", F.lit(-1)).alias("commit_count"))


@query("s03_detail_failures", "SELECT o_custkey AS key, 'graphql node has no databaseId' AS error FROM orders WHERE o_orderkey % 5 = 0")
def _(t):
    return records.flatten_details(nodes(t))[1]


@query("s12_owner_location", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN n_name END AS location FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0")
def _(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    node = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("n_name")).alias("location")))
    return geo.flatten_owner_location(named.select(F.col("c_custkey").alias("id"), node.alias("node")))


@query("l15_retry_failed_only", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'slow' ELSE 'ok' END AS value FROM orders WHERE o_orderkey % 11 <> 0")
def _(t):
    def attempt(rows, n):
        k, bad = F.col("k"), F.lit(n == 0)
        return rows.select("k", F.when(k % 7 == 0, "slow").otherwise("ok").alias("value"), F.when((k % 11 == 0) | (bad & (k % 7 == 0)), "timeout").alias("error"))

    return runs.retry_failed_only(t.orders.select(F.col("o_orderkey").alias("k")), "k", attempt)[0]


_PROGRESS = """WITH e AS (SELECT user_id, event_id, event_type AS phase, (event_id % 100)::INT AS done, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
l AS (SELECT user_id, max_by(phase, event_id) AS phase, max_by(done, event_id) AS done FROM e GROUP BY 1)
SELECT l.user_id, l.phase, l.done, (SELECT max(event_id) FROM e WHERE e.user_id = l.user_id AND e.before IS DISTINCT FROM e.phase) AS phase_start FROM l"""


def progress_events(df):
    return df.select("user_id", "event_id", F.col("event_type").alias("phase"), (F.col("event_id") % 100).cast("int").alias("done"), F.lit(100).alias("total"))


@query("t06_live_progress", _PROGRESS)
def _(t):
    return streams.live_progress(progress_events(t.events), "user_id", "event_id").select("user_id", "phase", "done", "phase_start")


@query("t01_stream_upsert", "SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS o_totalprice, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def _(t):
    target = shared.scratch(t.spark)
    source = t.stream("orders")
    streams.stream_upsert(source, f"{target}/table", f"{target}/log", "o_custkey", ["o_totalprice", "o_orderstatus"], "o_orderkey", "o_orderdate").awaitTermination()
    return streams.latest(t.spark, f"{target}/table").select("o_custkey", "o_totalprice", "o_orderstatus")


@query("t02_stream_dedupe", "SELECT event_id, user_id FROM events")
def _(t):
    target, at = shared.scratch(t.spark), F.col("ts").cast("timestamp")
    source = t.stream("events").select("event_id", "user_id", at.alias("ts"))
    streams.log_sink(streams.stream_dedupe(source.union(source), "event_id", "ts", "10 minutes"), f"{target}/rows", f"{target}/log").awaitTermination()
    return t.spark.read.parquet(f"{target}/rows").select("event_id", "user_id")


@query("t08_log_sink", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    target = shared.scratch(t.spark)
    for _ in range(2):  # a second start delivers nothing new
        streams.log_sink(t.stream("events"), f"{target}/rows", f"{target}/log").awaitTermination()
    return t.spark.read.parquet(f"{target}/rows").select("event_id", "user_id", "event_type", "value")


@query("t09_late_rows", """WITH c AS (SELECT to_timestamp((min(epoch(ts)) + max(epoch(ts))) // 2)::TIMESTAMP AS cut, to_timestamp(floor(max(epoch(ts))))::TIMESTAMP AS last FROM events),
w AS (SELECT unnest(range((epoch(ts)::BIGINT // 60 - 9) * 60, (epoch(ts)::BIGINT // 60 + 1) * 60, 60)) AS start FROM (SELECT to_timestamp(floor(epoch(ts))) AS ts FROM events, c WHERE events.ts >= cut))
SELECT start, count(*) AS n FROM w, c WHERE start + 600 <= epoch(last) - 600 GROUP BY 1""")
def _(t):
    """The later half of the log comes first, in two batches, of which the first has the last row, so the earlier half is too late and leaves no trace."""
    target, at = shared.scratch(t.spark), F.col("ts").cast("timestamp")
    second, seconds = F.unix_timestamp(at), F.unix_micros(at) / 1e6
    log = t.events.select(F.timestamp_seconds(second).alias("ts"), F.lit(200).alias("status"), F.col("value").alias("latency_ms"), at.alias("at"), "user_id")
    # the middle to the microsecond, rounded as SQL's doubles are
    middle = F.rint((F.min(seconds) + F.max(seconds)) / 2 * 1e6).cast("long")
    ends = t.events.agg(middle.alias("cut"), F.max(second).alias("last")).first()
    later = F.unix_micros("at") >= F.lit(ends.cut)
    first = F.coalesce(F.col("user_id") % 2 == 0, F.lit(False)) | (F.unix_timestamp("ts") == F.lit(ends.last))
    for part in (later & first, later & ~first, ~later):
        log.where(part).drop("at", "user_id").coalesce(1).write.mode("append").parquet(f"{target}/in")
    source = streams.read_stream(t.spark, f"{target}/in", log.drop("at", "user_id").schema)
    windows = slo.stream_slo(source).select(F.unix_timestamp("start").alias("start"), "n")
    streams.log_sink(windows, f"{target}/rows", f"{target}/log").awaitTermination()
    return t.spark.read.parquet(f"{target}/rows")


@query("x04_map_batches", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'v' || o_orderkey END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'no answer' END AS error FROM orders")
def _(t):
    return records.map_batches(t.orders, "o_orderkey", lambda keys: {k: f"v{k}" for k in keys if k % 7})
