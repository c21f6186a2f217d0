"""Joins, set operations, ranking and paging over records, owners, snapshots and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.selection import SORTED, Order, first_rows, orders, slice_rows
from millrace.operators.slices import BLOCK, over_last
from millrace.sources.shared import materialize


def with_owner(repos: DataFrame, owners: DataFrame, ref: str, key: str, columns: list[str]) -> DataFrame:
    """repos with the named owner columns as owner_*."""
    side = owners.select(F.col(key).alias("_owner"), *[F.col(c).alias(f"owner_{c}") for c in columns])
    return repos.join(side, F.col(ref) == F.col("_owner")).drop("_owner")


def items_with_repo(items: DataFrame, repos: DataFrame, ref: str, key: str, columns: list[str]) -> DataFrame:
    """Snapshot rows with the named columns of their record as repo_*; rows of purged records stay."""
    side = repos.select(F.col(key).alias("_repo"), *[F.col(c).alias(f"repo_{c}") for c in columns])
    return items.join(side, F.col(ref) == F.col("_repo"), "left").drop("_repo")


def restrict_to_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def coalesce_detail(items: DataFrame, details: DataFrame, key: str, fields: list[str], name: str, owner: str | None = None) -> DataFrame:
    """Fields of items, filled from details where null; `owner` falls back to the part of the name before the slash."""
    d = details.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields], *([F.col(owner).alias("_owner")] if owner else []))
    out = items.join(d, key, "left").withColumns({f: F.coalesce(f, f"_{f}") for f in fields})
    if owner:
        out = out.withColumn("owner_login", F.coalesce("_owner", F.substring_index(name, "/", 1))).drop("_owner")
    return out.drop(*[f"_{f}" for f in fields])


def owners_once(repos: DataFrame, ref: str, lookup) -> DataFrame:
    """Facts of owners, looked up once per distinct owner by lookup(DataFrame of owners), back on each record."""
    return repos.join(lookup(repos.select(ref).where(F.col(ref).isNotNull()).distinct()), ref, "left")


def diff_runs(a: DataFrame, b: DataFrame, fields: list[str], key: tuple[str, ...] = ("repo_id", "full_name")) -> DataFrame:
    """Changes from snapshot a to b: rows (kind added, removed or changed, key columns, field, from, to).

    With the default key a renamed record is one removed and one added row; with ("repo_id",) it is a change.
    """
    left, right = a.select(*key, F.struct(*fields).alias("_a")).alias("l"), b.select(*key, F.struct(*fields).alias("_b")).alias("r")
    same = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key])
    joined = left.join(right, same, "full_outer").select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in key], "_a", "_b")
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    changes = F.array(*[
        F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), text("_a", f).alias("from"), text("_b", f).alias("to")))
        for i, f in enumerate(fields)
    ])
    whole = F.array(F.struct(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to")))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    rows = joined.withColumn("kind", kind).withColumn("c", F.explode(F.when(F.col("kind") == "changed", F.array_compact(changes)).otherwise(whole)))
    return rows.select("kind", *key, "c.*")


def diff_summary(changes: DataFrame, key: tuple[str, ...] = ("repo_id", "full_name")) -> DataFrame:
    """One row: rows added, removed and changed, and fields changed."""
    first = changes.groupBy("kind", *key).agg(F.count(F.lit(1)).alias("n"))
    count = lambda k: F.count_if(F.col("kind") == k)
    return first.agg(count("added").alias("added"), count("removed").alias("removed"), count("changed").alias("changed"),
                     F.coalesce(F.sum(F.when(F.col("kind") == "changed", F.col("n"))), F.lit(0)).alias("fields_changed"))


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b, in both, and the percentage of the union that is common."""
    both = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(key, F.lit(0), F.lit(1)))
    flags = both.groupBy(key).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    common = F.count_if((F.col("x") == 1) & (F.col("y") == 1))
    return flags.agg(F.count_if(F.col("y") == 0).alias("only_a"), F.count_if(F.col("x") == 0).alias("only_b"), common.alias("common"),
                     F.round(F.try_divide(common * 100.0, F.count(F.lit(1))), 4).alias("overlap_pct"))


def read_paths(listing: DataFrame, root: DataFrame | None = None, key: str = "repo_id") -> DataFrame:
    """Blob paths with `truncated`; a truncated listing is completed by the root listing, whose flag then counts."""
    blobs = listing.where(F.col("type") == "blob").select(key, "path", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    if root is None:
        return blobs.distinct()
    flags = root.groupBy(key).agg(F.bool_or(F.coalesce("truncated", F.lit(False))).alias("_root"))
    cut = listing.groupBy(key).agg(F.bool_or(F.coalesce("truncated", F.lit(False))).alias("_cut"))
    extra = root.where(F.col("type") == "blob").join(cut.where("_cut"), key, "left_semi").select(key, "path", F.lit(True).alias("truncated"))
    joined = blobs.unionByName(extra).join(flags, key, "left")
    return joined.select(key, "path", F.when(F.col("truncated"), F.coalesce("_root", F.lit(True))).otherwise(False).alias("truncated")).distinct()


def rank_candidates(df: DataFrame, stars: str, pushed: str, seq: str) -> DataFrame:
    """Most stars first (null as 0), then the latest push (null last), then the given order."""
    return df.orderBy(F.coalesce(F.col(stars), F.lit(0)).desc(), F.coalesce(F.col(pushed).cast("string"), F.lit("")).desc(), F.col(seq))


def sort_result(df: DataFrame, sort: str, columns: dict[str, str], pushed: str, key: str, descending: bool = True) -> DataFrame:
    """Sorted by the column of `sort`; ties by push and id in the same direction; an unlisted sort keeps the order."""
    if sort not in columns:
        return df
    order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in (columns[sort], pushed, key)]
    return df.orderBy(*order)


def page_of(df: DataFrame, sort: str, columns: dict[str, str], key: str, page: int, per_page: int, descending: bool = True) -> DataFrame:
    """A page; numbers past the ends are clamped; nulls last, ties by ascending id. Carries `page` and `pages`."""
    pages = max(1, -(-df.count() // per_page))
    page = min(max(1, page), pages)
    return slice_page(df, [Order(columns[sort], descending), Order(key)], page, per_page).withColumns({"page": F.lit(page), "pages": F.lit(pages)})


def slice_page(df: DataFrame, order: list, page: int, per_page: int) -> DataFrame:
    """A page without clamping, by names (ascending, nulls first) or Order keys; one past the end is empty.

    A top-k of the rows up to the page's end for pages near the start; the rows of a deeper page are found by their place
    (see selection). `page_after` goes on from any page at the cost of one.
    """
    stop = page * per_page
    if stop > SORTED:
        return slice_rows(df, order, stop - per_page, stop)
    return df.orderBy(*[k.sorted for k in orders(order)]).offset(stop - per_page).limit(per_page)


def page_after(df: DataFrame, column: str, key: str, last: tuple | None, per_page: int, descending: bool = True) -> DataFrame:
    """The page that follows the row with (column, key) `last`; None: the first. Nulls last, ties by ascending id.

    The rows before are filtered out, so a deep page costs what the first does: per_page rows a task and no more.
    """
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    if last is not None:
        value, at = last
        same_later = F.col(column).eqNullSafe(F.lit(value)) & (F.col(key) > at)
        beyond = F.lit(False) if value is None else F.col(column).isNull() | ((F.col(column) < value) if descending else (F.col(column) > value))
        df = df.where(same_later | beyond)
    return df.orderBy(order, key).limit(per_page)


def cap(df: DataFrame, order: list, max_rows: int, max_detail: int) -> tuple[DataFrame, DataFrame]:
    """(the first max_rows rows, one row with the numbers of dropped rows and of kept rows beyond max_detail).

    A small cap is a top-k. For a larger one the rows, written once, are filtered by the key of the last row that stays.
    """
    if max_rows > SORTED:
        df = materialize(df)
    n = F.count(F.lit(1))
    kept = F.least(n, F.lit(max_rows))
    counts = df.agg((n - kept).alias("dropped"), F.greatest(kept - max_detail, F.lit(0)).cast("long").alias("not_detailed"))
    return (first_rows(df, order, max_rows) if max_rows > SORTED else df.orderBy(*[k.sorted for k in orders(order)]).limit(max_rows)), counts


def top_items(df: DataFrame, stars: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(stars).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(n)


def recent(df: DataFrame, at: str, key: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key by the order columns; an aggregate, so that a key with many rows is combined early."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def latest_ready(df: DataFrame, key: str, order: list[str], status: str, ready: list[str]) -> DataFrame:
    return latest_per_key(df.where(F.col(status).isin(ready)), key, order)


def previous_runs(df: DataFrame, key: str, at: str, id_: str, n: int = 3, block: int = BLOCK) -> DataFrame:
    """(row id, previous row id, rank 1..n) of the rows of one key before each row, newest first.

    A key's rows go in blocks, each with the n rows before it.
    """
    lags = lambda w: F.array(*[F.lag(id_, k).over(w) for k in range(1, n + 1)])
    found = over_last(df.select(key, at, id_), key, [at, id_], n, {"_lags": lags}, max(block, n))
    return found.select(id_, F.posexplode("_lags").alias("rank", "previous")).where("previous IS NOT NULL").select(id_, "previous", (F.col("rank") + 1).alias("rank"))


def last_n_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def filters_with_last_run(filters: DataFrame, runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    last = latest_per_key(runs, key, order)
    return filters.join(last, key, "left")


def assign_windows(df: DataFrame, windows: DataFrame, at: Column | str, max_windows: int = 10_000) -> DataFrame:
    """Each row with the window (lo..hi, inclusive dates, disjoint) that holds its day.

    Windows are expanded to days, so this is an equi-join on the day; a plan of windows is bounded by max_windows and the
    days it spans, far below the rows.
    """
    days = windows.select(F.explode(F.sequence("lo", "hi")).alias("_day"), "lo", "hi").withColumnsRenamed({"lo": "window_lo", "hi": "window_hi"})
    return df.withColumn("_day", F.to_date(at)).join(days, "_day").drop("_day")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """A sorted df with `name`: 1, 2, ... in its order.

    It is written once, each row with its place in its partition; of the counts of the partitions the driver sees one a
    partition.
    """
    placed = materialize(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_at", 33).cast("int"))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["_p"], before))
        before += r.n
    sums = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _before long"))
    return placed.join(sums, "_p").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_at", "_before")


def global_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `name`: 1, 2, ... over all rows in ascending order of key, by one sort; equal keys needn't share a partition."""
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    return number_rows(spread.orderBy(key, "_tie").drop("_tie"), name)


def even_segments(df: DataFrame, key: str, n: int) -> DataFrame:
    """Distinct ids in n contiguous half-open ranges (after, upto], sizes at most one apart, larger ones first."""
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    ranked = global_rank(df.select(key).where(F.col(key).isNotNull()).distinct(), key, "_r")
    total = ranked.agg(F.max("_r").alias("n")).first().n or 0
    n = min(n, total)
    ends = [sum(total // n + (j < total % n) for j in range(k + 1)) for k in range(n)]
    cut = {r["_r"]: r[key] for r in ranked.where(F.col("_r").isin([1, *ends])).select("_r", key).collect()}
    rows = [(k, cut[ends[k - 1]] if k else cut[1] - 1, cut[e], e - (ends[k - 1] if k else 0)) for k, e in enumerate(ends)]
    return spark.createDataFrame(rows, f"segment int, after {kind}, upto {kind}, n long")
