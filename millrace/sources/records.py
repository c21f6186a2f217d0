"""Reading records: raw JSON to typed rows with rejects, nested nodes to flat rows, scopes, runs, and writing results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import coerce_count, commit_count_of, csv_cell, last_segment, parse_ts
from millrace.sources.snapshots import read_snapshots

# Names of the raw fields of each kind, and the columns that they become.
COUNTS = {"stargazers_count": "stargazers", "forks_count": "forks_count", "watchers_count": "watchers", "open_issues_count": "open_issues"}
STRINGS = ["description", "homepage", "mirror_url", "default_branch"]
FLAGS = ["fork", "archived", "disabled", "is_template"]
TRISTATE = ["has_wiki", "has_issues", "has_projects", "has_pages", "has_discussions", "has_pull_requests"]
TIMES = ["created_at", "pushed_at", "updated_at"]
CSV_COLUMNS = ["id", "full_name", "stargazers", "pushed_at", "archived", "language", "license_spdx", "country_iso", "geo_confidence"]
LEAN = ["id", "node_id", "full_name", "name", "owner_login", "owner_type", "owner_id", "stargazers", "forks_count", "archived", "fork", "visibility", "language", "license_spdx", "topics", "pushed_at", "created_at"]


def normalize_records(raw: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects with a reason) of one JSON object a row.

    Rejected: no object, no whole-number id, empty or non-text node_id, full_name or owner login, no owner id, topics that
    aren't a list of texts, a count or size that is no number.
    """
    paths = ["id", "node_id", "full_name", "owner.id", "owner.login", "owner.type", "topics", "size", "name", "language", "license.spdx_id", "visibility", "private", "parent.full_name",
             "source.full_name", "custom_properties", *COUNTS, *STRINGS, *FLAGS, *TRISTATE, *TIMES]
    at_name = lambda p: f"_{p.replace('.', '_')}"
    # each path is taken out of the record once; a generator stands between, as filters on what follows would else be pushed
    # below the parse, with a parse for each use of a value
    taken = F.struct(F.schema_of_variant("_v").alias("_kind"), *[F.try_variant_get("_v", f"$.{p}", "variant").alias(at_name(p)) for p in paths])
    whole = raw.select(text, F.try_parse_json(text).alias("_v")).select(text, F.inline(F.array(taken)))
    kinds = F.struct(*[F.coalesce(F.schema_of_variant(at_name(p)), F.lit("VOID")).alias(f"{at_name(p)}_kind") for p in paths])
    at = lambda p, t="string": F.try_variant_get(at_name(p), "$", t)
    kind = lambda p: F.col(f"{at_name(p)}_kind")
    is_text = lambda p: (kind(p) == "STRING") & (at(p) != "")
    is_id = lambda p: kind(p) == "BIGINT"
    counted = [*COUNTS, "size"]
    texts = whole.select("*", F.inline(F.array(kinds))).select("*", F.inline(F.array(F.struct(*[at(p).alias(f"{at_name(p)}_text") for p in counted]))))
    whole_number = lambda p: coerce_count(f"{at_name(p)}_text", kind(p) == "STRING")
    numbers = [F.when(kind(p) == "BOOLEAN", F.lit(None).cast("long")).when(kind(p) == "VOID", F.lit(0).cast("long")).otherwise(whole_number(p)).alias(f"{at_name(p)}_number") for p in counted]
    v = texts.select("*", F.inline(F.array(F.struct(*numbers))))
    number = lambda p: F.col(f"{at_name(p)}_number")
    topics_ok = kind("topics").isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>") & ~((kind("topics") == "ARRAY<VOID>") & (F.size(at("topics", "array<string>")) > 0))
    checks = [
        ("not an object", ~F.coalesce("_kind", F.lit("VOID")).startswith("OBJECT")),
        ("id", ~is_id("id")), ("node_id", ~is_text("node_id")), ("full_name", ~is_text("full_name")),
        ("owner", ~is_id("owner.id") | ~is_text("owner.login")), ("topics", ~topics_ok),
        *[(c, number(c).isNull()) for c in COUNTS],
        ("size", (kind("size") != "VOID") & number("size").isNull()),
    ]
    reason = F.coalesce(*[F.when(bad, name) for name, bad in checks])
    marked = v.withColumn("reason", reason)
    text_of = lambda p: F.when(kind(p) == "STRING", at(p))
    bool_of = lambda p: F.when(kind(p) == "BOOLEAN", at(p, "boolean"))
    filled = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    clean = marked.where("reason IS NULL").select(
        at("id", "long").alias("id"), at("node_id").alias("node_id"), at("full_name").alias("full_name"), at("owner.id", "long").alias("owner_id"),
        filled(at("name"), last_segment(at("full_name"))).alias("name"), *[at(c).alias(c) for c in STRINGS],
        text_of("language").alias("language"), at("license.spdx_id").alias("license_spdx"),
        F.coalesce(at("topics", "array<string>"), F.array().cast("array<string>")).alias("topics"),
        filled(text_of("visibility"), F.when(F.coalesce(bool_of("private"), F.lit(False)), "private").otherwise("public")).alias("visibility"),
        at("parent.full_name").alias("parent_full_name"), at("source.full_name").alias("source_full_name"),
        *[F.coalesce(bool_of(c), F.lit(False)).alias(c) for c in FLAGS],
        F.when(kind("size") != "VOID", number("size")).alias("size_kb"), *[number(c).alias(n) for c, n in COUNTS.items()],
        *[bool_of(c).alias(c) for c in TRISTATE],
        F.coalesce(at("custom_properties", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("custom_properties"),
        *[parse_ts(at(c)).alias(c) for c in TIMES], at("owner.login").alias("owner_login"), filled(at("owner.type"), F.lit("User")).alias("owner_type"),
    )
    return clean, marked.where("reason IS NOT NULL").select(F.col(text).alias("raw"), "reason")


def flatten_nodes(df: DataFrame) -> DataFrame:
    """Nested search nodes to flat lean rows; what is missing is null."""
    kind = F.when(F.col("owner.__typename") == "Organization", "Organization").otherwise("User")
    topics = F.filter(F.transform("repositoryTopics.nodes", lambda n: n["topic"]["name"]), lambda t: t.isNotNull())
    return df.select(
        F.col("databaseId").alias("id"), F.col("id").alias("node_id"), F.col("nameWithOwner").alias("full_name"), F.coalesce("name", last_segment("nameWithOwner")).alias("name"),
        F.col("owner.login").alias("owner_login"), kind.alias("owner_type"), F.col("owner.databaseId").alias("owner_id"), F.col("stargazerCount").alias("stargazers"),
        F.col("forkCount").alias("forks_count"), F.col("isArchived").alias("archived"), F.col("isFork").alias("fork"), F.lower("visibility").alias("visibility"),
        F.col("primaryLanguage.name").alias("language"), F.col("licenseInfo.spdxId").alias("license_spdx"), F.coalesce(topics, F.array().cast("array<string>")).alias("topics"),
        parse_ts("pushedAt").alias("pushed_at"), parse_ts("createdAt").alias("created_at"),
    )


def language_map(edges) -> Column:
    """name -> bytes of language edges, the bytes of repeated names summed."""
    e = F.filter(F.col(edges) if isinstance(edges, str) else edges, lambda x: x["node"]["name"].isNotNull() & x["size"].isNotNull())
    names = F.array_distinct(F.transform(e, lambda x: x["node"]["name"]))
    total = lambda n: F.aggregate(F.filter(e, lambda x: x["node"]["name"] == n), F.lit(0).cast("long"), lambda a, x: a + x["size"].cast("long"))
    return F.map_from_arrays(names, F.transform(names, total))


def flatten_details(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flat rows with languages and commit_count, failures) of detail nodes with the requested `key`."""
    whole = df.where(F.col("databaseId").isNotNull())
    branch = F.col("defaultBranchRef")
    rows = whole.select(
        "key", F.col("databaseId").alias("id"), F.col("nameWithOwner").alias("full_name"), F.col("stargazerCount").alias("stargazers"),
        language_map("languages.edges").alias("languages"), branch["name"].alias("default_branch"), commit_count_of(branch).alias("commit_count"),
    )
    return rows, df.where(F.col("databaseId").isNull()).select("key", F.lit("graphql node has no databaseId").alias("error"))


def read_scope(df: DataFrame, owner_col: str, org: str | None = None, user: str | None = None, kind_col: str | None = None, kind: str = "all") -> DataFrame:
    """Records of exactly one organisation or user, whatever the case, of one type or all."""
    if (org is None) == (user is None):
        raise ValueError("give exactly one of org and user")
    out = df.where(F.lower(F.col(owner_col).cast("string")) == str(org or user).lower())
    return out if kind == "all" or kind_col is None else out.where(F.col(kind_col) == kind)


def read_run_items(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """Frozen items of a run, most stars first, then by id."""
    return read_snapshots(spark, path, [run_id]).orderBy(F.desc_nulls_last("stargazers"), "repo_id")


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as they are written to CSV."""
    return df.select(*[csv_cell(c).alias(c) for c in columns])


def write_corpus_csv(df: DataFrame, path: str, columns: list[str] = CSV_COLUMNS) -> None:
    csv_columns(df, columns).write.csv(path, header=True, nullValue="", emptyValue="")


def bundle_items(items: DataFrame, raw: str | None, columns: list[str]) -> DataFrame:
    """One JSON text per item: the raw record where there is one, else the snapshot."""
    snapshot = F.to_json(F.struct(*columns))
    return items.select((F.coalesce(F.col(raw), snapshot) if raw else snapshot).alias("item"))


def write_bundle(items: DataFrame, manifest: dict, path: str, raw: str | None, columns: list[str]) -> None:
    """A run as a folder: items as JSON lines, and a manifest of one row with the field statistics."""
    bundle_items(items, raw, columns).write.text(f"{path}/items")
    stats = items.agg(F.count(F.lit(1)).alias("items"), F.to_json(F.struct(*[F.count(c).alias(c) for c in columns])).alias("field_stats"))
    reduce(lambda d, kv: d.withColumn(kv[0], F.lit(kv[1])), manifest.items(), stats).coalesce(1).write.json(f"{path}/manifest")


def map_batches(df: DataFrame, key: str, fetch: Callable[[list], dict], size: int = 20, value: str = "string") -> DataFrame:
    """(key, value, error) of each row, by fetch(list of up to `size` keys) -> {key: value or exception}.

    A key that the answer lacks, or whose value is an exception, has an error and no value; an exception raised by fetch is
    the error of its whole batch. The other batches go on.
    """
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, rows = frame[key].tolist(), []
            for i in range(0, len(keys), size):
                batch = keys[i : i + size]
                try:
                    got = fetch(batch)
                except Exception as e:  # noqa: BLE001  it is the batch's result
                    got = dict.fromkeys(batch, e)
                for k in batch:
                    found = got.get(k, KeyError("no answer"))
                    failed = isinstance(found, Exception)
                    rows.append((k, None if failed else found, (found.args and str(found.args[0]) or type(found).__name__) if failed else None))
            yield pd.DataFrame(rows, columns=[key, "value", "error"])

    return df.select(key).mapInPandas(run, f"{key} {kind}, value {value}, error string")
