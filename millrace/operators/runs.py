"""Runs: filter funnels, ledgers, quality, coverage, progress, snapshots, replay, freezing, whole builds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.predicates import DROP, KEEP, UNKNOWN
from millrace.functions.scalars import epoch_s, iso_utc, span_text
from millrace.operators.merge import dedupe_latest
from millrace.operators.relational import cap, latest_ready, sort_result
from millrace.operators.selection import Order, first_rows
from millrace.sources.shared import materialize

# Cost of each filter; those above PAGE_COST aren't run at depth "page".
FILTER_COSTS = {
    "min_stars": 0, "team_topic": 0, "owner_country": 1, "min_geo_confidence": 1, "has_dockerfile": 2, "funding": 3, "discussions": 3, "sponsors": 3, "coverage": 4, "ci": 4, "loc": 4,
    "min_loc": 4, "max_loc": 4, "min_commits": 2, "max_commits": 2, "min_language_bytes": 2, "max_language_bytes": 2,
}
PAGE_COST = 2
# Filters that are recorded but can't be checked.
RECORD_ONLY = ("min_loc", "max_loc")
# Fixed value: the warning for each of them.
RECORDED = "`{}` is recorded but unenforceable in this run; results are incomplete"
# Share of the size that each way of copying takes, and megabytes left free.
MODE_FACTORS = {"shallow": 1.0, "file_only": 0.25, "windowed": 0.5}


def plan_filters(names: list[str], depth: str = "page", costs: dict[str, int] = FILTER_COSTS) -> list[str]:
    """Requested filters, cheapest first, each once; costly ones only at depth "full"."""
    if depth not in ("page", "full"):
        raise ValueError(f"unknown depth {depth!r}")
    if unknown := [n for n in names if n not in costs]:
        raise ValueError(f"unknown filters {unknown}")
    kept = [n for n in dict.fromkeys(names) if depth == "full" or costs[n] <= PAGE_COST]
    return sorted(kept, key=lambda n: costs[n])


def run_filters(df: DataFrame, filters: dict[str, Column], depth: str = "page", costs: dict[str, int] = FILTER_COSTS) -> tuple[DataFrame, DataFrame]:
    """(survivors, funnel) of status Columns by filter name, in one pass.

    A row leaves at its first filter, cheapest first, that doesn't keep it. The funnel has per filter: step, checked, kept,
    dropped, unknown.
    """
    names = plan_filters(list(filters), depth, costs)
    spark = df.sparkSession
    status = [F.coalesce(filters[n], F.lit(UNKNOWN)) for n in names]
    left = F.lit(None).cast("struct<step:int,how:string>")
    for i, s in reversed(list(enumerate(status))):
        left = F.when(s != KEEP, F.struct(F.lit(i).alias("step"), s.alias("how"))).otherwise(left)
    marked = df.withColumn("_left", left)
    counts = marked.groupBy(F.coalesce("_left.step", F.lit(len(names))).alias("step"), F.col("_left.how").alias("how")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("step").agg(*[F.coalesce(F.sum(F.when(F.col("how") == h, F.col("n"))), F.lit(0)).alias(h) for h in (DROP, UNKNOWN)], F.sum("n").alias("gone"))
    steps = spark.createDataFrame([*enumerate(names), (len(names), None)], "step int, filter string").join(per, "step", "left").fillna(0, [DROP, UNKNOWN, "gone"])
    after = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    funnel = steps.withColumn("checked", F.sum("gone").over(after)).where(F.col("filter").isNotNull())
    funnel = funnel.select("step", "filter", "checked", (F.col("checked") - F.col("gone")).alias("kept"), F.col(DROP).alias("dropped"), F.col(UNKNOWN).alias("unknown"))
    return marked.where(F.col("_left").isNull()).drop("_left"), funnel


@dataclass(frozen=True)
class Handler:
    """A filter that asks for something: check(rows) -> (key, status[, cost]), and what a row costs at most."""

    name: str
    check: Callable[[DataFrame], DataFrame]
    price: int = 1


LEDGER = "step int, filter string, checked long, kept long, dropped long, unknown long, cost long, requeues int"


def run_handlers(df: DataFrame, key: str, handlers: list[Handler], order: list, budget: int | None = None, max_requeues: int = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """(survivors, ledger with a row for each handler, warnings): handlers in the given order, each over what the last one kept.

    A handler gets a table of rows and may join it with anything; its answer is written before the next one starts, so
    nothing is asked twice. A row without an answer is unknown. Where the budget doesn't pay for all rows, the first by
    `order` are asked and the rest is unknown; the cost is the sum of the answer's `cost` column, else price times rows.
    A handler that fails is tried again; after max_requeues more failures all its rows are unknown, with a warning.
    """
    spark, left, rows, ledger, warnings = df.sparkSession, budget, df, [], []
    for step, h in enumerate(handlers):
        n = rows.count()
        asked, n_asked = rows, n
        if left is not None and h.price and left // h.price < n:
            n_asked = left // h.price
            asked = materialize(first_rows(rows, order, n_asked))  # a choice between equal rows is made once
            warnings.append(f"{h.name}: the budget pays for {n_asked} of {n} rows")
        requeues, answers = 0, None
        while answers is None and n_asked:
            try:
                answers = materialize(h.check(asked))
            except Exception as e:  # noqa: BLE001  whatever a handler does is its result
                if requeues == max_requeues:
                    warnings.append(f"{h.name}: no answer for {n_asked} rows after {requeues} more tries: {type(e).__name__}")
                    break
                requeues += 1
        if answers is None:
            ledger.append((step, h.name, n, 0, 0, n, 0, requeues))
            rows = df.limit(0)
            continue
        status = answers.groupBy(F.col(key).alias("_key")).agg(F.min(F.coalesce("status", F.lit(UNKNOWN))).alias("_status"))
        told = materialize(asked.join(status, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("_status", F.coalesce("_status", F.lit(UNKNOWN))))
        counts = {r["_status"]: r["count"] for r in told.groupBy("_status").count().collect()}
        paid = F.sum("cost") if "cost" in answers.columns else F.lit(h.price * n_asked)
        cost = int(answers.agg(F.coalesce(paid, F.lit(0)).alias("c")).first().c)
        left = None if left is None else max(0, left - cost)
        kept, dropped = counts.get(KEEP, 0), counts.get(DROP, 0)
        ledger.append((step, h.name, n, kept, dropped, n - kept - dropped, cost, requeues))
        rows = told.where(F.col("_status") == KEEP).drop("_status")
    return rows, spark.createDataFrame(ledger, LEDGER), warnings


def narrows(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: base and filtered counts, and whether the filter strictly narrows."""
    n = F.count_if(F.coalesce(predicate, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("base"), n.alias("filtered"), (n < F.count(F.lit(1))).alias("narrows"))


def coverage(df: DataFrame, key: str, total: int, joined: DataFrame | None = None) -> DataFrame:
    """One row: distinct ids against an estimated total; `unavailable`: ids that `joined` lacks."""
    ids = F.count_distinct(key)
    if joined is None:
        return df.agg(ids.alias("unique_ids"), F.greatest(F.lit(total) - ids, F.lit(0)).alias("shortfall"), (ids < total).alias("warn"))
    marked = df.select(key).distinct().join(joined.select(key, F.lit(1).alias("_in")).distinct(), key, "left")
    n = F.count(F.lit(1))
    return marked.agg(n.alias("unique_ids"), F.greatest(F.lit(total) - n, F.lit(0)).alias("shortfall"), (n < total).alias("warn"), (n - F.count("_in")).alias("unavailable"))


def run_counts(items: DataFrame, run: str, checks: dict[str, Column]) -> DataFrame:
    """Per run: items, and items for which each check holds."""
    return items.groupBy(run).agg(F.count(F.lit(1)).alias("items"), *[F.count_if(c).alias(n) for n, c in checks.items()])


def quality_report(items: DataFrame, expected: int, status: str = "done", incomplete: int = 0, bundle_items: int | None = None, empty_fields: list[str] | None = None,
                   name: str = "full_name", key: str = "repo_id", sparse: dict[str, float] | None = None) -> DataFrame:
    """Rows (check, status, value): count parity, duplicate names, null ratios, completeness, bundle, empty fields, overall."""
    sparse = sparse or {"language": 0.5, "license_spdx": 0.5, "country_iso": 0.9}
    dup = items.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo != hi").agg(F.count(F.lit(1)).alias("dups"))
    n = F.count(F.lit(1))
    base = items.agg(n.alias("n"), *[F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()).cast("double"), n), F.lit(0.0)).alias(f"r_{c}") for c in sparse]).crossJoin(dup)
    row = lambda check, bad, value, how="warn": F.struct(F.lit(check).alias("check"), F.when(bad, how).otherwise("ok").alias("status"), value.cast("double").alias("value"))
    rows = [row("count_parity", F.col("n") != expected, F.col("n") - expected), row("duplicate_full_names", F.col("dups") > 0, F.col("dups"), "fail")]
    rows += [row(f"missing_{c}", F.col(f"r_{c}") > limit, F.col(f"r_{c}")) for c, limit in sparse.items()]
    rows += [row("incomplete", F.lit(status == "partial" or incomplete > 0), F.lit(incomplete))]
    rows += [row("bundle", F.lit(True) if bundle_items is None else F.col("n") != bundle_items, F.lit(bundle_items))]
    if bundle_items is not None:
        rows += [row("field_coverage", F.lit(bool(empty_fields)), F.lit(len(empty_fields or [])))]
    listed = F.array(*rows)
    has = lambda s: F.exists("l", lambda x: x["status"] == s)
    overall = F.struct(F.lit("overall").alias("check"), F.when(has("fail"), "fail").when(has("warn"), "warn").otherwise("ok").alias("status"), F.lit(None).cast("double").alias("value"))
    return base.select(listed.alias("l")).select(F.explode(F.concat("l", F.array(overall))).alias("x")).select("x.*")


def warnings_ledger(counts: DataFrame) -> DataFrame:
    """(reason, n) of one row of counts, for counts above 0; a run with any row is incomplete."""
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).cast("long").alias("n")) for c in counts.columns])).alias("x")).select("x.*").where("n > 0")


def run_flags(runs: DataFrame, key: str = "id", virtuals: str | None = None) -> DataFrame:
    """(key, kind, label) of each flag of a run."""
    flag = lambda when, kind, label: F.when(when, F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    steps = F.when(F.coalesce("incomplete_shards", F.lit(0)) > 0, F.col("incomplete_shards")).otherwise(1).cast("string")
    flags = [
        flag(F.col("error").isNotNull() & (F.col("error") != ""), "error", F.concat(F.lit("failed: "), "error")),
        flag(F.col("status") == "cancelled", "incomplete", F.lit("stopped")),
        flag((F.col("status") == "partial") | (F.coalesce("incomplete_shards", F.lit(0)) > 0), "incomplete", F.concat(F.lit("incomplete: "), steps, F.lit(" step(s)"))),
        flag(~F.col("status").isin("queued", "running") & (F.col("fetched") < F.col("total_count")), "truncation",
             F.concat(F.lit("truncated: "), F.col("fetched").cast("string"), F.lit(" of ~"), F.col("total_count").cast("string"))),
    ]
    if virtuals:
        flags += [flag(F.get_json_object(virtuals, f"$.{n}").isNotNull(), "record_only", F.lit(n)) for n in RECORD_ONLY]
    return runs.select(key, F.explode(F.array_compact(F.array(*flags))).alias("f")).select(key, "f.*")


def progress_eta(runs: DataFrame, now: Column) -> DataFrame:
    """runs (phase_started, finished, done, total) with percent, elapsed_s, eta_s and eta text."""
    elapsed = F.greatest(epoch_s(F.coalesce("finished", now)) - epoch_s("phase_started"), F.lit(0.0))
    rest = F.col("elapsed_s") * (F.col("total") - F.col("done")) / F.col("done")
    ok = (F.col("total") > 0) & (F.col("done") >= 2) & (F.col("elapsed_s") > 0)
    out = runs.withColumn("elapsed_s", elapsed).withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total"))))
    out = out.withColumn("eta_s", F.when(ok, F.when(F.when(ok, rest) <= 86400, F.when(ok, rest))))
    return out.withColumn("eta", span_text("eta_s")).withColumn("eta_s", F.floor("eta_s"))


def storage_estimate(items: DataFrame, size_kb: str, order: list, mode: str, limit: int | None = None, free_mb: float = 0.0, reserve_mb: float = 0.0) -> DataFrame:
    """One row: megabytes that all or the first `limit` items take, and whether they exceed the free space."""
    chosen = items if limit is None else items.orderBy(*order).limit(limit)
    mb = F.round(F.coalesce(F.sum(size_kb), F.lit(0)) * F.lit(MODE_FACTORS[mode]) / 1024, 4)
    return chosen.agg(F.count(F.lit(1)).alias("items"), mb.alias("mb"), (mb > free_mb - reserve_mb).alias("warn"))


def size_share(df: DataFrame, key: str, languages: str) -> DataFrame:
    """(key, language, bytes, share) of each entry of a language map."""
    total = F.aggregate(F.map_values(languages), F.lit(0).cast("double"), lambda a, x: a + x)
    return df.select(key, total.alias("_t"), F.explode(languages).alias("language", "bytes")).select(key, "language", "bytes", F.round(F.try_divide("bytes", "_t"), 6).alias("share"))


def change_log(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, before, after, hash) of settings that changed, as JSON."""
    a, b = before.select(key, F.to_json(F.struct(*sorted(fields))).alias("before")), after.select(key, F.to_json(F.struct(*sorted(fields))).alias("after"))
    out = a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))
    return out.withColumn("hash", F.sha2(F.concat_ws("\n", "before", "after"), 256))


def retry_failed_only(df: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(results, unresolved) of attempt(rows, number of the try) -> rows with key, value and error; only failed keys are tried again."""
    rows, good = df, None
    for n in range(max_attempts):
        tried = materialize(attempt(rows, n))  # an attempt is made once, whatever is lost later
        won = tried.where(F.col("error").isNull()).drop("error")
        good = won if good is None else good.unionByName(won)
        failed = tried.where(F.col("error").isNotNull())
        rows = df.join(failed.select(key), key, "left_semi")
        if failed.isEmpty():
            break
    return good, failed.select(key, "error")


def history_filter(runs: DataFrame, status: str = "", hash_prefix: str = "", key: str = "filter_hash") -> DataFrame:
    """Runs of a status whose hash starts with a prefix; an empty argument asks for all."""
    if status:
        runs = runs.where(F.col("status") == status)
    return runs.where(F.col(key).startswith(hash_prefix)) if hash_prefix else runs


def count_matches(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: the number of rows that a filter would keep."""
    return df.where(predicate).agg(F.count(F.lit(1)).alias("n"))


def record_only(df: DataFrame, asked: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with the asked filters that can't be checked in `recorded`, and `incomplete`; one warning row for each).

    All rows stay. An unknown name is an error.
    """
    if unknown := [n for n in asked if n not in RECORD_ONLY]:
        raise ValueError(f"not record-only: {unknown}")
    names = [n for n in RECORD_ONLY if n in asked]
    marked = df.withColumn("recorded", F.array(*[F.lit(n) for n in names]).cast("array<string>")).withColumn("incomplete", F.lit(bool(names)))
    return marked, df.sparkSession.createDataFrame([(n, RECORDED.format(n)) for n in names], "filter string, warning string")


def freeze(corpora: DataFrame, runs: DataFrame, items: DataFrame, run_id, name: str, frozen_at: Column, note: str | None = None) -> DataFrame:
    """corpora with a new named corpus of a finished run; a blank or known name or an unfinished run is an error."""
    if not name.strip():
        raise ValueError("a corpus needs a name")
    if not corpora.where(F.col("name") == name).isEmpty():
        raise ValueError(f"corpus {name!r} exists")
    if runs.where((F.col("id") == run_id) & F.col("status").isin("done", "partial")).isEmpty():
        raise ValueError(f"run {run_id} is not finished")
    row = items.where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("repo_count"))
    row = row.select(F.lit(name).alias("name"), F.lit(run_id).cast("long").alias("source_run_id"), "repo_count", frozen_at.alias("frozen_at"), F.lit(note).cast("string").alias("note"))
    return corpora.unionByName(row, allowMissingColumns=True)


def corpora_with_runs(corpora: DataFrame, runs: DataFrame) -> DataFrame:
    side = runs.select(F.col("id").alias("source_run_id"), F.col("status").alias("run_status"), F.col("filter_hash").alias("run_hash"))
    return corpora.join(side, "source_run_id").orderBy(F.desc("frozen_at"), F.desc("source_run_id"))


def replay(runs: DataFrame, items: DataFrame, key: str, value: str, ready: tuple[str, ...] = ("done", "partial")) -> tuple[str, DataFrame | None]:
    """("ok", items of the latest finished run of a hash), or ("not_ready" or "never_run", None)."""
    of = runs.where(F.col(key) == value)
    last = latest_ready(of, key, ["created_at", "id"], "status", list(ready)).select("id").first()
    if last is None:
        return ("never_run" if of.isEmpty() else "not_ready"), None
    return "ok", items.where(F.col("run_id") == last.id)


@dataclass
class CorpusSpec:
    """What a corpus asks for: a predicate on the records, status filters, caps and a sort."""

    predicate: Column
    filters: dict[str, Column]
    sort: str = "stars"
    max_candidates: int = 100_000
    max_detail: int = 50_000
    depth: str = "page"
    columns: dict[str, str] = field(default_factory=dict)  # of stars, pushed, id and seq


def build_corpus(records: DataFrame, spec: CorpusSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, funnel, warnings): collect, dedupe by id, rank, cap, filter, sort."""
    c = spec.columns
    found = dedupe_latest(records.where(spec.predicate), c["id"], c["seq"], c["pushed"])
    order = [Order(F.coalesce(F.col(c["stars"]), F.lit(0)), True), Order(F.coalesce(F.col(c["pushed"]).cast("string"), F.lit("")), True), Order("position")]
    kept, counts = cap(found, order, spec.max_candidates, spec.max_detail)
    survivors, funnel = run_filters(kept, spec.filters, spec.depth)
    unknown = funnel.agg(F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"))
    items = sort_result(survivors, spec.sort, {"stars": c["stars"], "pushed": c["pushed"]}, c["pushed"], c["id"])
    return items, funnel, warnings_ledger(counts.crossJoin(unknown))  # one row each


def snapshot_columns(df: DataFrame, columns: dict[str, Column | str], pushed: str = "pushed_at") -> DataFrame:
    """Frozen form of result rows: the named columns, times as ISO text."""
    out = df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])
    return out.withColumn(pushed, iso_utc(pushed)) if pushed in out.columns else out
