"""Analytics over the log of service responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import epoch_s, rounded
from millrace.operators.slices import BLOCK, number_in_key, over_last, running
from millrace.sources.shared import materialize

# Fixed values: (direction, warn, fail) of each metric.
THRESHOLDS = {
    "graphql_remaining": ("lt", 100.0, 10.0), "incomplete_results_ratio": ("gt", 0.05, 0.2), "rate_422": ("gt", 0.0, 0.02),
    "rate_403_429": ("gt", 0.0, 0.05), "p95_latency_ms": ("gt", 800.0, 2000.0), "shard_coverage": ("lt", 0.95, 0.8), "geo_unmatched_rate": ("gt", 0.4, 0.6),
}
# Quota and seconds of its window by resource.
QUOTAS = [("search", 30, 60), ("core", 5000, 3600), ("code_search", 10, 60), ("graphql", 5000, 3600)]
MAX_ATTEMPTS = 5


def count_by(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows per value of a fixed domain, 0 where there are none; other values aren't counted."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = df.where(F.col(column).isin(domain)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def slo_snapshot(log: DataFrame, windows: DataFrame | None = None, owners: DataFrame | None = None, n: int = 1000) -> DataFrame:
    """One row of metrics over the newest n responses by (ts, id); a ratio of nothing is null."""
    newest = log.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    all_, known = F.count(F.lit(1)), F.count("incomplete")
    share = lambda c: F.try_divide(F.count_if(c).cast("double"), all_)
    last = F.max_by("remaining", F.when((F.col("resource") == "graphql") & F.col("remaining").isNotNull(), F.struct("ts", "id")))
    out = newest.agg(
        last.alias("graphql_remaining"), F.try_divide(F.count_if("incomplete").cast("double"), known).alias("incomplete_results_ratio"), share(F.col("status") == 422).alias("rate_422"),
        share(F.col("status").isin(403, 429)).alias("rate_403_429"), F.percentile("latency_ms", 0.95).alias("p95_latency_ms"),
    )
    for df, of, name in ((windows, F.col("state") == "done", "shard_coverage"), (owners, F.col("confidence") == "unmatched", "geo_unmatched_rate")):
        if df is not None:
            of = F.col("state").isin("done", "incomplete") if name == "shard_coverage" else of
            out = out.crossJoin(df.agg(F.try_divide(F.count_if(of).cast("double"), F.count(F.lit(1))).alias(name)))  # one row each
    return out


def severity(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """df with `severity`: ok, warn, fail, or na where the value is null."""
    rows = [(k, *v) for k, v in THRESHOLDS.items()]
    limits = df.sparkSession.createDataFrame(rows, f"{metric} string, _dir string, _warn double, _fail double")
    v = F.col(value)
    beyond = lambda limit: F.when(F.col("_dir") == "lt", v < F.col(limit)).otherwise(v > F.col(limit))
    out = F.when(v.isNull(), "na").when(beyond("_fail"), "fail").when(beyond("_warn"), "warn").otherwise("ok")
    return df.join(F.broadcast(limits), metric).withColumn("severity", out).drop("_dir", "_warn", "_fail")


def nearest_rank(sorted_values: Column) -> Column:
    """The ceil(0.95 n)-th smallest of a sorted array; null without values."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.ceil(n * 95 / 100).cast("int") - 1)


def nearest_rank_p95(log: DataFrame, value: str, order: list[str], n: int = 50) -> DataFrame:
    """p95 of the last n samples, by nearest rank."""
    last = log.where(F.col(value).isNotNull()).orderBy(*[F.desc(c) for c in order]).limit(n)
    return last.agg(nearest_rank(F.sort_array(F.collect_list(value))).alias("p95"), F.count(F.lit(1)).alias("n"))


def sliding_p95(log: DataFrame, key: str, value: str, order: list[str], n: int = 50, block: int = BLOCK) -> DataFrame:
    """Each row with the nearest-rank p95 of the n samples of its key up to it.

    A key's rows go in blocks, each with the n - 1 rows before it.
    """
    last = lambda w: nearest_rank(F.sort_array(F.collect_list(value).over(w.rowsBetween(-(n - 1), 0))))
    return over_last(log, key, order, n - 1, {"p95": last}, max(block, n)).drop("_i")


def points_by_phase(log: DataFrame, phase: str = "phase", cost: str = "cost") -> DataFrame:
    return log.groupBy(phase).agg(F.coalesce(F.sum(cost), F.lit(0)).alias("points"), F.count(F.lit(1)).alias("responses"))


def fold_budget(log: DataFrame, cost: str = "cost", used: str = "used", remaining: str = "remaining") -> DataFrame:
    """Sum of cost, greatest use, least rest; nulls don't count."""
    return log.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("cost"), F.max(used).alias("used"), F.min(remaining).alias("remaining"))


def hit_streaks(log: DataFrame, key: str, order: list[str], status: str = "status", ts: str = "ts", gap: int = 600, block: int = BLOCK) -> DataFrame:
    """Throttle hits (403, 429) with `streak` and `total` per key; a longer gap or a success starts the streak anew.

    A hit is fresh if the response before it is a success or is too long ago. The total is a running count of hits, and
    the streak counts on from the total at the last fresh hit; both go in blocks of a key's rows.
    """
    hit = F.col(status).isin(403, 429)
    ended = log.where(hit | F.col(status).between(200, 299) | (F.col(status) == 304)).withColumn("_hit", hit)
    back = lambda c: lambda w: F.lag(c).over(w)
    seen = over_last(ended, key, order, 1, {"_before": back(ts), "_was_hit": back("_hit")}, block)
    fresh = F.col("_hit") & ~F.coalesce(F.col("_was_hit") & (epoch_s(ts) - epoch_s("_before") <= gap), F.lit(False))
    counted = running(seen.withColumn("_fresh", fresh), key, {"total": ("sum", F.col("_hit").cast("long"))}, block)
    counted = running(counted, key, {"_since": ("max", F.when(F.col("_fresh"), F.col("total")))}, block)
    return counted.where("_hit").withColumn("streak", F.col("total") - F.col("_since") + 1).drop("_hit", "_before", "_was_hit", "_fresh", "_since", "_i")


def response_triage(log: DataFrame) -> DataFrame:
    """log (status, attempt, retry_after, remaining, reset, now, error_code, message, sso) with `action` and `wait_s`."""
    s, attempt = F.col("status"), F.coalesce("attempt", F.lit(0))
    worn = attempt >= MAX_ATTEMPTS
    pause = F.least(F.lit(480.0), 60.0 * F.pow(F.lit(2.0), attempt.cast("double")))
    after, reset = F.col("retry_after").cast("double"), F.greatest(F.lit(0.0), F.col("reset").cast("double") - F.col("now").cast("double"))
    limited, server = s.isin(403, 429), s.isin(500, 502, 503, 504)
    spent = (F.col("remaining") == 0) & F.col("reset").isNotNull()
    spam = (s == 422) & F.coalesce(F.col("error_code") == "custom", F.lit(False))
    cut = (s == 422) & F.coalesce(F.lower("message").contains("only the first 1000"), F.lit(False))
    sso = F.coalesce(F.lower("sso").contains("partial-results"), F.lit(False))
    action = (
        F.when(sso | (s == 401), "fail_loud").when(s.between(200, 299) | (s == 304), "free").when(limited & (after > 0), "retry_after")
        .when(limited & spent, "wait_reset").when((limited | spam | server) & worn, "fail_loud").when(limited | spam | server, "backoff")
        .when(cut, "shard").otherwise("fix")
    )
    wait = F.when(F.col("action") == "retry_after", after).when(F.col("action") == "wait_reset", reset).when(F.col("action") == "backoff", pause)
    return log.withColumn("action", action).withColumn("wait_s", wait)


def resource_of(url) -> Column:
    """Quota that a request falls under, by its path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(path.startswith("/search/code"), "code_search").when(path.startswith("/search"), "search").when(path.startswith("/graphql"), "graphql").otherwise("core")


def quota_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUOTAS, "resource string, quota int, seconds int")


def quota_windows(log: DataFrame, quotas: DataFrame, ts: str = "ts") -> DataFrame:
    """Per resource, token and fixed window: used, remaining, exhausted. Windows are aligned to the epoch."""
    timed = log.join(F.broadcast(quotas), "resource")
    start = (F.floor(epoch_s(ts) / F.col("seconds")) * F.col("seconds")).cast("timestamp")
    used = timed.groupBy("resource", "token", start.alias("start"), "quota").agg(F.count(F.lit(1)).alias("used"))
    return used.select("resource", "token", "start", "used", F.greatest(F.col("quota") - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") >= F.col("quota")).alias("exhausted"))


def first_use_windows(log: DataFrame, quotas: DataFrame, ts: str = "ts", block: int = BLOCK) -> DataFrame:
    """Per resource, token and window: used, remaining, exhausted. A window begins with the first use after the last one ended.

    Each time of use is linked to the first one that is a window's length later; the windows are the chain of links from a
    token's first use, found by following 1, 2, 4, ... links at once. Nulls in resource, token or time don't count.
    """
    timed = log.join(F.broadcast(quotas), "resource").where(F.col("token").isNotNull() & F.col(ts).isNotNull())
    key = F.to_json(F.struct("resource", "token"))
    uses = materialize(timed.groupBy(key.alias("_who"), "resource", "token", "quota", "seconds", F.col(ts).cast("timestamp").alias("_t")).agg(F.count(F.lit(1)).alias("n")))
    # backwards in time, the last use seen is the first one at that time or later; at one time uses come before the ends of windows
    point, end = F.lit(0), F.lit(1)
    back = uses.select("_who", (-F.unix_micros("_t")).alias("_at"), point.alias("_kind"), F.unix_micros("_t").alias("_of"))
    ends = uses.select("_who", (-(F.unix_micros("_t") + F.col("seconds").cast("long") * 1_000_000)).alias("_at"), end.alias("_kind"), F.unix_micros("_t").alias("_of"))
    placed = number_in_key(back.union(ends), "_who", ["_at", "_kind", "_of"])
    seen = running(placed, "_who", {"_next": ("max", F.when(F.col("_kind") == 0, -F.col("_of")))}, block).where("_kind = 1")
    links = materialize(seen.select("_who", F.col("_of").alias("_from"), (-F.col("_next")).alias("_to")).where("_to IS NOT NULL"))
    starts = materialize(uses.groupBy("_who").agg(F.min(F.unix_micros("_t")).alias("_from")))
    while True:
        further = starts.join(links.hint("merge"), ["_who", "_from"]).select("_who", F.col("_to").alias("_from"))
        grown = materialize(starts.union(further).distinct())
        if grown.count() == starts.count():
            break
        second = links.select("_who", F.col("_from").alias("_to"), F.col("_to").alias("_then")).hint("merge")
        links, starts = materialize(links.join(second, ["_who", "_to"]).select("_who", "_from", F.col("_then").alias("_to"))), grown
    marked = uses.withColumn("_from", F.unix_micros("_t")).join(starts.withColumn("_start", F.col("_from")).hint("merge"), ["_who", "_from"], "left")
    inside = running(number_in_key(marked, "_who", ["_t"]), "_who", {"_start_of": ("max", F.col("_start"))}, block)
    used = inside.groupBy("resource", "token", "_start_of", "quota").agg(F.sum("n").alias("used"))
    rest = F.greatest(F.col("quota") - F.col("used"), F.lit(0)).alias("remaining")
    return used.select("resource", "token", F.timestamp_micros("_start_of").alias("start"), "used", rest, (F.col("used") >= F.col("quota")).alias("exhausted"))


def throttle_sessions(log: DataFrame, key: str, ts: str = "ts", gap: str = "600 seconds") -> DataFrame:
    """Runs of 403 and 429 whose gaps are at most `gap`."""
    hits = log.where(F.col("status").isin(403, 429))
    return hits.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("hits"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


#: Values that a sketch holds exactly; with more of them, ranks are off by some 0.05 % at most.
SKETCH_K = 4096


def live_slo(log: DataFrame, ts: str = "ts", width: str = "10 minutes", slide: str = "1 minute", digits: int | None = None) -> DataFrame:
    """The metrics of slo_snapshot over the log in sliding windows, with n, throttled and mean_latency; batches and streams.

    Responses are summed up by pane, a tumbling window of one slide, and panes are merged into windows: counts, the
    newest known rest of the graphql quota, and a mergeable sketch of latencies, whose 0.95 quantile is a nearest rank. So
    a response is counted once, not once for each window. Columns that the log lacks (resource, remaining, incomplete)
    count as null.

    A sum of panes differs in its last bits from a sum of latencies one by one. With `digits` mean_latency is rounded to so
    many decimals, and what is rounded is the sum one by one, in the order of id (batches only; see _mean_by_id).
    """
    size = {} if digits is None else {"size": F.sum(F.abs("latency_ms"))}
    of = lambda c: F.col(c) if c in log.columns else F.lit(None)
    rest = of("remaining").cast("long")
    quota = F.when((of("resource").cast("string") == "graphql") & rest.isNotNull(), F.struct(F.col(ts).alias("at"), *([F.col("id")] if "id" in log.columns else []), rest.alias("rest")))
    counts = {"n": F.lit(True), "throttled": F.col("status").isin(403, 429), "n_422": F.col("status") == 422, "n_cut": of("incomplete").cast("boolean"), "n_known": of("incomplete").isNotNull()}
    panes = log.groupBy(F.window(ts, slide).alias("pane")).agg(
        *[F.count_if(c).alias(name) for name, c in counts.items()], F.sum("latency_ms").alias("latency"), F.count("latency_ms").alias("n_latency"),
        *[c.alias(name) for name, c in size.items()], F.max(quota).alias("quota"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_K)).alias("sketch"),
    )
    merged = panes.groupBy(F.window("pane", width, slide).alias("w")).agg(
        *[F.sum(name).alias(name) for name in (*counts, *size, "latency", "n_latency")], F.max("quota").alias("quota"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    found = merged.select(
        F.col("w.start").alias("start"), "n", "throttled", ratio("latency", "n_latency").alias("mean_latency"), F.col("quota.rest").alias("graphql_remaining"),
        ratio("n_cut", "n_known").alias("incomplete_results_ratio"), ratio("n_422", "n").alias("rate_422"), ratio("throttled", "n").alias("rate_403_429"),
        F.when(F.col("n_latency") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95))).alias("p95_latency_ms"), *size,
    )
    return found if digits is None else _mean_by_id(found, log, ts, width, slide, digits)


def _mean_by_id(found: DataFrame, log: DataFrame, ts: str, width: str, slide: str, digits: int) -> DataFrame:
    """found with mean_latency rounded to `digits` decimals, as the sum of the latencies in the order of id gives it.

    Two orders of n additions give means that are at most 2^-51 of `size`, the sum of the absolute values, apart. Where
    twice that changes no decimal, the mean of panes is rounded. Only windows for which it does, whose mean lies half way
    between two roundings, are added up again by id; each in one task, as a running sum that spills to disk.
    """
    found = materialize(found)
    low, high = (rounded(F.col("mean_latency") + F.col("size") * by, digits) for by in (-(2.0**-50), 2.0**-50))
    panes = F.explode(F.expr(f"sequence(start, start + interval {width} - interval {slide}, interval {slide})"))
    order = [c for c in ("id", ts, "latency_ms") if c in log.columns]
    timed = log.where("latency_ms IS NOT NULL").select(*order, F.window(ts, slide)["start"].alias("_pane"))
    rows = timed.join(found.where(low != high).select("start", panes.alias("_pane")), "_pane")
    so_far = Window.partitionBy("start").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("start", F.count(F.lit(1)).over(so_far).alias("_n"), F.sum("latency_ms").over(so_far).alias("_sum"))
    means = sums.groupBy("start").agg((F.max_by("_sum", "_n").cast("double") / F.max("_n")).alias("_mean"))
    return found.join(means, "start", "left").withColumn("mean_latency", rounded(F.coalesce("_mean", "mean_latency"), digits)).drop("size", "_mean")
