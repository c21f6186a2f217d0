"""Merging records by immutable id: dedupe, upsert, name conflicts, history, tombstones, purge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import parse_ts

INSERTED, UPDATED, UNCHANGED, KEPT = "inserted", "updated", "unchanged", "kept"


def dedupe_latest(df: DataFrame, key: str = "id", seq: str = "seq", pushed: str = "pushed_at") -> DataFrame:
    """One row per id: fields of the last occurrence, latest readable `pushed`, `position` of the first occurrence.

    Rows whose id is null pass through. Pre-aggregates by id, so an id with very many rows doesn't meet in one task.
    """
    others = [c for c in df.columns if c not in (key, seq, pushed)]
    when = F.col(pushed) if dict(df.dtypes)[pushed].startswith(("timestamp", "date")) else parse_ts(pushed)
    # among equal times the earliest occurrence wins; without any readable time the last one does
    best = F.struct(when.isNotNull().alias("ok"), when.alias("t"), F.when(when.isNotNull(), -F.col(seq)).otherwise(F.col(seq)).alias("o"))
    one = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*others, F.lit(1).alias("_one")), seq).alias("_last"), F.max_by(pushed, best).alias(pushed), F.min(seq).alias("position"))
        .select(key, *[F.col(f"_last.{c}").alias(c) for c in others], pushed, "position")
    )
    rest = df.where(F.col(key).isNull()).withColumn("position", F.col(seq)).select(one.columns)
    return one.unionByName(rest)


def distinct_ids(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct ids with the place where each is first seen."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("position"))


def differs(fields: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) for f in fields])


def upsert(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str], version: str | None = None) -> DataFrame:
    """existing merged with incoming (one row per key) by key, with `outcome` and `previous_*` of the fields.

    Incoming rows overwrite `fields`, nulls included; other columns of existing stay. `version` (a tag such as an ETag)
    is overwritten only where incoming has one.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    joined = e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer")
    new, old = F.col(f"e.{key}").isNull(), F.col(f"i.{key}").isNull()
    changed = differs(fields, "e", "i")
    if version:
        changed = changed | (F.col(f"i.{version}").isNotNull() & ~F.col(f"e.{version}").eqNullSafe(F.col(f"i.{version}")))
    outcome = F.when(old, KEPT).when(new, INSERTED).when(changed, UPDATED).otherwise(UNCHANGED)
    take = lambda f: F.when(old, F.col(f"e.{f}")).otherwise(F.col(f"i.{f}"))
    rest = [c for c in existing.columns if c not in (key, version, *fields)]
    columns = [F.coalesce(f"e.{key}", f"i.{key}").alias(key), *[take(f).alias(f) for f in fields], *[F.col(f"e.{c}") for c in rest]]
    if version:
        columns.append(F.coalesce(f"i.{version}", f"e.{version}").alias(version))
    return joined.select(*columns, outcome.alias("outcome"), *[F.col(f"e.{f}").alias(f"previous_{f}") for f in fields])


def change_counts(merged: DataFrame) -> DataFrame:
    """One row: how many rows were inserted, updated and unchanged."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return merged.agg(count(INSERTED), count(UPDATED), count(UNCHANGED))


def new_rows(staged: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return staged.join(existing.select(key), key, "left_anti")


def renamed(staged: DataFrame, existing: DataFrame, key: str, name: str) -> DataFrame:
    """(key, previous name, new name) where the names differ, null included."""
    old = existing.select(F.col(key), F.col(name).alias("previous"))
    return staged.select(key, F.col(name).alias("current")).join(old, key).where(~F.col("previous").eqNullSafe(F.col("current")))


def name_history(merged: DataFrame, key: str, name: str) -> DataFrame:
    """Names to remember: the current one of an insert, the previous one of a renamed row."""
    first = merged.where(F.col("outcome") == INSERTED).select(key, F.col(name).alias("full_name"))
    old = merged.where((F.col("outcome") == UPDATED) & ~F.col(name).eqNullSafe(F.col(f"previous_{name}"))).select(key, F.col(f"previous_{name}").alias("full_name"))
    return first.unionByName(old)


def append_history(history: DataFrame, *more: DataFrame, key: str, name: str) -> DataFrame:
    """history with the rows of `more` that it doesn't hold yet; names are compared whatever their case."""
    fold = lambda df: df.select(key, name, F.lower(name).alias("_fold"))
    added = reduce(DataFrame.unionByName, [fold(m) for m in more]).join(fold(history).select(key, "_fold"), [key, "_fold"], "left_anti")
    one = added.groupBy(key, "_fold").agg(F.min(name).alias(name)).select(key, name)
    return history.select(key, name).unionByName(one)


def bulk_load(raw: DataFrame, valid: Column, existing: DataFrame, key: str, fields: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Merge of all valid rows at once, and (total, staged, skipped); equals row-wise upserts in the order of `seq`."""
    ok = raw.where(F.coalesce(valid, F.lit(False)))
    staged = ok.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("_r")).select(key, "_r.*")
    good = F.count_if(F.coalesce(valid, F.lit(False)))
    counts = raw.agg(F.count(F.lit(1)).alias("total"), good.alias("staged"), (F.count(F.lit(1)) - good).alias("skipped"))
    return upsert(existing, staged, key, fields), counts


def upsert_owners(existing: DataFrame, incoming: DataFrame, key: str = "id", login: str = "login", kind: str = "type") -> DataFrame:
    """Owners merged by id, with unique logins (whatever their case).

    The holder of a login that another id brings in becomes login~holderid. Of several incoming ids with one login the
    least keeps it, the others get ~id. Owners without a login stay without one.
    """
    least = incoming.where(F.col(login).isNotNull()).groupBy(F.lower(login).alias("_name")).agg(F.min(key).alias("_least"))
    wanted = incoming.join(least, F.lower(login) == F.col("_name"), "left")
    wanted = wanted.withColumn(login, F.when(F.col(key) > F.col("_least"), F.concat_ws("~", login, F.col(key).cast("string"))).otherwise(F.col(login))).drop("_name", "_least")
    taken = wanted.select(F.lower(login).alias("_fold"), F.col(key).alias("_by"), F.col(login).alias("_login"))
    kept = existing.join(wanted.select(key), key, "left_anti").withColumn("_fold", F.lower(login)).join(taken, "_fold", "left")
    moved = F.col("_by").isNotNull()
    kept = kept.select(
        key, F.when(moved, F.concat_ws("~", "_login", F.col(key).cast("string"))).otherwise(F.col(login)).alias(login), kind, moved.alias("conflict")
    )
    return kept.unionByName(wanted.select(key, login, kind, F.lit(False).alias("conflict")))


def release_names(existing: DataFrame, incoming: DataFrame, key: str, name: str) -> DataFrame:
    """existing with name~id where another incoming id claims the name; `released` is the name to remember."""
    claim = incoming.groupBy(F.lower(name).alias("_fold")).agg(F.max_by(F.struct(F.col(key).alias("by"), F.col(name).alias("as")), key).alias("_c"))
    joined = existing.withColumn("_fold", F.lower(name)).join(claim, "_fold", "left")
    lost = F.col("_c").isNotNull() & (F.col("_c.by") != F.col(key))
    return joined.select(
        key, F.when(lost, F.concat_ws("~", F.col("_c.as"), F.col(key).cast("string"))).otherwise(F.col(name)).alias(name), F.when(lost, F.col(name)).alias("released")
    )


def apply_refresh(batch: DataFrame, key: str = "id", requested: str = "requested_name", name: str = "full_name", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(last payload per id, outcome per request: id, renamed_from, history_added)."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in (key, requested, seq)]), seq).alias("_r")).select(key, "_r.*")
    moved = ~F.col(name).eqNullSafe(F.col(requested))
    outcomes = batch.select(seq, key, F.when(moved, F.col(requested)).alias("renamed_from"), moved.alias("history_added"))
    return last, outcomes


def tombstone(df: DataFrame, names: DataFrame, at: Column, name: str = "full_name", deleted: str = "deleted_at") -> DataFrame:
    """df with `deleted` set for the given names where it isn't yet, and `tombstoned`: whether this call did it."""
    gone = names.select(F.lower(name).alias("_fold"), F.lit(True).alias("_gone")).distinct()
    joined = df.withColumn("_fold", F.lower(name)).join(gone, "_fold", "left")
    now = F.coalesce("_gone", F.lit(False)) & F.col(deleted).isNull()
    return joined.withColumn("tombstoned", now).withColumn(deleted, F.when(now, at).otherwise(F.col(deleted))).select(*df.columns, "tombstoned")


def purge(df: DataFrame, cutoff: Column, deleted: str = "deleted_at") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows whose tombstone is strictly older than cutoff)."""
    old = F.coalesce(F.col(deleted) < cutoff, F.lit(False))
    return df.where(~old), df.where(old)


def purge_cascade(removed: DataFrame, items: DataFrame, history: DataFrame, key: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots lose the reference to removed ids but keep the row; their history rows go."""
    ids = removed.select(F.col(key).alias("_gone")).distinct()
    nulled = items.join(ids, F.col(ref) == F.col("_gone"), "left").withColumn(ref, F.when(F.col("_gone").isNull(), F.col(ref))).drop("_gone")
    return nulled, history.join(ids, F.col(ref) == F.col("_gone"), "left_anti")


def changed_only(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Incoming rows that are new or carry another version tag; rows of equal tags need no work."""
    known = existing.select(F.col(key), F.col(version).alias("_known"))
    return incoming.join(known, key, "left").where(F.col("_known").isNull() | (F.col("_known") != F.col(version))).drop("_known")


def merge_results(parts: list[DataFrame], key: str, seq: str, pushed: str) -> DataFrame:
    """Results of several runs as one, deduplicated by id."""
    return dedupe_latest(reduce(DataFrame.unionByName, parts), key, seq, pushed)
