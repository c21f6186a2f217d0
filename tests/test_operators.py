"""Literal cases of the operators, and equivalences between them."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions import scalars as S
from millrace.operators import geo, lint, logs, merge, relational, runs, selection, windows
from millrace.sources import records, snapshots


def ts(text):
    return dt.datetime.fromisoformat(text)


def raw_repo(**change):
    base = {
        "id": 1, "node_id": "n1", "name": "repo1", "full_name": "octo/repo1", "description": "d", "language": "Python", "license": {"spdx_id": "MIT"}, "topics": ["ai", "agents"],
        "private": False, "visibility": "public", "fork": False, "archived": False, "size": 1234, "stargazers_count": 42, "forks_count": 7, "watchers_count": 11, "open_issues_count": 3,
        "custom_properties": {"team": "core"}, "created_at": "2024-01-02T03:04:05Z", "pushed_at": "2024-06-07T08:09:10Z", "owner": {"id": 100, "login": "octo", "type": "User"},
    }
    return json.dumps({k: v for k, v in {**base, **change}.items() if v != "DROP"})


def test_normalize_records(spark):
    good = [raw_repo(), raw_repo(id=2, topics=None, visibility=None, private=True, stargazers_count=None, size=None, name="", has_wiki=True, owner={"id": 5, "login": "x"}),
            raw_repo(id=3, stargazers_count="17", forks_count=2.9, fork="yes", created_at="never")]
    bad = [raw_repo(id=True), raw_repo(id="7"), raw_repo(node_id=""), raw_repo(full_name="DROP"), raw_repo(owner={"id": 1}), raw_repo(topics=["a", 1]), raw_repo(topics="a"),
           raw_repo(stargazers_count=True), raw_repo(watchers_count="many"), raw_repo(size=[]), "[1]", "{bad"]
    clean, rejects = records.normalize_records(spark.createDataFrame([(x,) for x in good + bad], "value string"))
    rows = {r.id: r for r in clean.collect()}
    assert set(rows) == {1, 2, 3} and rejects.count() == len(bad)
    assert rows[1].topics == ["ai", "agents"] and rows[1].stargazers == 42 and rows[1].custom_properties == {"team": "core"} and rows[1].pushed_at == ts("2024-06-07T08:09:10")
    assert rows[2].visibility == "private" and rows[2].stargazers == 0 and rows[2].size_kb is None and rows[2].name == "repo1" and rows[2].owner_type == "User" and rows[2].has_wiki is True
    assert rows[3].stargazers == 17 and rows[3].forks_count == 2 and rows[3].fork is False and rows[3].created_at is None


def test_flatten_nodes_and_details(spark):
    schema = "key string, databaseId long, id string, nameWithOwner string, name string, owner struct<login:string,__typename:string,databaseId:long>, stargazerCount int, forkCount int, isArchived boolean, isFork boolean, visibility string, primaryLanguage struct<name:string>, licenseInfo struct<spdxId:string>, pushedAt string, createdAt string, languages struct<edges:array<struct<size:long,node:struct<name:string>>>>, repositoryTopics struct<nodes:array<struct<topic:struct<name:string>>>>, defaultBranchRef struct<name:string,target:struct<history:struct<totalCount:int>>>"  # noqa: E501
    base = ["octo/a", None, ("octo", "Organization", 9), 5, 1, False, None, "PUBLIC", ("Rust",), None, "2024-01-01T00:00:00Z", None]
    edges = ([(10, ("Rust",)), (5, ("C",)), (7, ("Rust",))],)
    rows = [("k1", 1, "n", *base, edges, ([(("cli",),)],), ("main", ((12,),))), ("k2", 2, "n", *base, edges, None, None), ("k3", None, "n", *base, None, None, None),
            ("k4", 4, "n", *base, None, None, ("main", None))]
    df = spark.createDataFrame(rows, schema)
    flat = {r.id: r for r in records.flatten_nodes(df).collect()}
    assert flat[1].name == "a" and flat[1].owner_type == "Organization" and flat[1].topics == ["cli"] and flat[2].topics == [] and flat[1].visibility == "public"
    ok, failed = records.flatten_details(df)
    by = {r.key: r for r in ok.collect()}
    assert by["k1"].languages == {"Rust": 17, "C": 5} and (by["k1"].commit_count, by["k2"].commit_count, by["k4"].commit_count) == (12, 0, None)
    assert [(r.key, r.error) for r in failed.collect()] == [("k3", "graphql node has no databaseId")]
    owners = spark.createDataFrame([(1, (" ",)), (2, ("Berlin",)), (3, None), (4, (None,))], "id int, node struct<location:string>")
    assert {r.id: r.location for r in geo.flatten_owner_location(owners).collect()} == {1: None, 2: "Berlin", 4: None}


@pytest.mark.parametrize(("rows", "want"), [
    ([(1, "first", "2024-01-01"), (2, "x", None), (1, "last", "2024-03-01")], {1: ("last", "2024-03-01", 0), 2: ("x", None, 1)}),
    ([(1, "first", "2024-05-05"), (1, "last", "2024-01-01")], {1: ("last", "2024-05-05", 0)}),
    ([(1, "a", None), (1, "b", "2024-02-02")], {1: ("b", "2024-02-02", 0)}),
    ([(1, "a", "2024-02-02"), (1, "b", None)], {1: ("b", "2024-02-02", 0)}),
    ([(3, "a", None), (1, "b", None), (2, "c", None), (1, "d", None), (3, "e", None)], {3: ("e", None, 0), 1: ("d", None, 1), 2: ("c", None, 2)}),
])
def test_dedupe_latest(spark, rows, want):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, id int, full_name string, pushed_at string")
    assert {r.id: (r.full_name, r.pushed_at, r.position) for r in merge.dedupe_latest(df).collect()} == want
    twice = spark.createDataFrame([(0, None, "a", None), (1, None, "a", None)], df.schema)
    assert merge.dedupe_latest(twice).count() == 2


def test_upsert_history_and_bulk(spark):
    schema = "id long, full_name string, stars int, deleted_at string, etag string"
    old = spark.createDataFrame([(1, "o/a", 5, "gone", "e1"), (2, "o/b", 6, None, None), (3, "o/c", 7, None, None)], schema)
    new = spark.createDataFrame([(1, "o/A", 5, None), (2, "o/b", 6, None), (4, "o/d", None, "e4")], "id long, full_name string, stars int, etag string")
    merged = merge.upsert(old, new, "id", ["full_name", "stars"], version="etag")
    by = {r.id: r for r in merged.collect()}
    assert {k: r.outcome for k, r in by.items()} == {1: "updated", 2: "unchanged", 3: "kept", 4: "inserted"}
    assert by[1].deleted_at == "gone" and by[1].etag == "e1" and by[4].etag == "e4"
    assert {(r.id, r.full_name) for r in merge.name_history(merged, "id", "full_name").collect()} == {(1, "o/a"), (4, "o/d")}
    assert merge.change_counts(merged).first().asDict() == {"inserted": 1, "updated": 1, "unchanged": 1}
    raw = new.drop("etag").withColumn("seq", F.col("id"))
    bulk, counts = merge.bulk_load(raw, F.col("stars").isNotNull(), old, "id", ["full_name", "stars"], "seq")
    row = merge.upsert(old, raw.where("stars IS NOT NULL").drop("seq"), "id", ["full_name", "stars"])
    assert sorted(map(str, bulk.collect())) == sorted(map(str, row.collect()))
    assert counts.first().skipped == 1


def test_names_and_tombstones(spark):
    owners = spark.createDataFrame([(1, "Octo", "User"), (2, "b", "User")], "id int, login string, type string")
    new = spark.createDataFrame([(3, "octo", "User"), (5, "x", "User"), (4, "X", "User")], owners.schema)
    assert {(r.id, r.login, r.conflict) for r in merge.upsert_owners(owners, new).collect()} == {(1, "octo~1", True), (2, "b", False), (3, "octo", False), (4, "X", False), (5, "x~5", False)}
    repos = spark.createDataFrame([(1, "o/a", None), (2, "o/b", "old")], "id int, full_name string, deleted_at string")
    claim = spark.createDataFrame([(9, "O/A")], "id int, full_name string")
    assert {(r.id, r.full_name, r.released) for r in merge.release_names(repos, claim, "id", "full_name").collect()} == {(1, "O/A~1", "o/a"), (2, "o/b", None)}
    names = spark.createDataFrame([("O/a",), ("o/B",), ("o/zz",)], "full_name string")
    assert {(r.id, r.deleted_at, r.tombstoned) for r in merge.tombstone(repos, names, F.lit("now")).collect()} == {(1, "now", True), (2, "old", False)}
    batch = spark.createDataFrame([(0, 1, "o/a", "o/b"), (1, 1, "o/b", "o/b")], "seq int, id int, requested_name string, full_name string")
    last, outcomes = merge.apply_refresh(batch)
    assert last.collect() == [(1, "o/b")] and [(r.renamed_from, r.history_added) for r in outcomes.orderBy("seq").collect()] == [("o/a", True), (None, False)]


def test_diff_runs(spark):
    schema = "repo_id int, full_name string, stars int, language string"
    a = spark.createDataFrame([(1, "o/1", 10, "R"), (2, "o/2", 10, None), (None, "o/x", 1, "R")], schema)
    b = spark.createDataFrame([(2, "o/2", 11, "R"), (3, "o/3", 10, "R"), (None, "o/x", 1, "R")], schema)
    got = {(r.kind, r.repo_id, r.field, r["from"], r.to) for r in relational.diff_runs(a, b, ["stars", "language"]).collect()}
    assert got == {("removed", 1, None, None, None), ("added", 3, None, None, None), ("changed", 2, "stars", "10", "11"), ("changed", 2, "language", None, "R")}
    assert relational.diff_runs(a, a, ["stars", "language"]).count() == 0
    moved = b.withColumn("full_name", F.concat("full_name", F.lit("!"))).where("repo_id = 2")
    assert {r.kind for r in relational.diff_runs(b.where("repo_id = 2"), moved, ["stars"]).collect()} == {"added", "removed"}
    assert [r.field for r in relational.diff_runs(b.where("repo_id = 2"), moved, ["full_name", "stars"], ("repo_id",)).collect()] == ["full_name"]


def test_quality_report(spark):
    def report(items, **kw):
        df = spark.createDataFrame(items, "repo_id int, full_name string, language string, license_spdx string, country_iso string")
        return {r.check: r.status for r in runs.quality_report(df, **kw).collect()}

    items = [(1, "a", "R", "MIT", "DE"), (2, "b", "R", "MIT", "DE"), (3, "c", None, None, "DE")]
    assert report(items, expected=3, bundle_items=3)["overall"] == "ok"
    assert report(items, expected=5, bundle_items=3)["count_parity"] == "warn"
    assert report([*items, (4, "a", "R", "MIT", "DE"), (None, "b", "R", "MIT", "DE")], expected=5)["overall"] == "fail"
    assert report(items, expected=3, status="partial", bundle_items=3)["overall"] == "warn"
    assert report([], expected=0, bundle_items=0)["overall"] == "ok"


LOG = "id int, ts timestamp, status int, remaining int, resource string, incomplete boolean, latency_ms double"


def test_slo_snapshot(spark):
    t = ts("2024-01-01T00:00:00")
    rows = [(i, t, s, r, res, inc, lat) for i, (s, r, res, inc, lat) in enumerate([(200, 30, "graphql", False, 100.0), (422, 29, "graphql", None, 200.0), (403, 5, "core", True, 300.0), (429, 28, "graphql", True, 400.0)])]
    log = spark.createDataFrame(rows, LOG)
    s = logs.slo_snapshot(log).first()
    assert (s.graphql_remaining, round(s.incomplete_results_ratio, 4), s.rate_422, s.rate_403_429, round(s.p95_latency_ms, 3)) == (28, 0.6667, 0.25, 0.5, 385.0)
    states = spark.createDataFrame([("done",), ("incomplete",), ("pending",)], "state string")
    owners = spark.createDataFrame([("exact-iso",), ("unmatched",)], "confidence string")
    both = logs.slo_snapshot(log, states, owners).first()
    assert round(both.shard_coverage, 4) == 0.6667 and both.geo_unmatched_rate == 0.5
    assert set(logs.slo_snapshot(log.where("false"), states.where("false"), owners.where("false")).first()) == {None}
    assert logs.nearest_rank_p95(log, "latency_ms", ["ts", "id"]).first().p95 == 400.0


def test_streaks_and_triage(spark):
    t = ts("2024-01-01T00:00:00").timestamp()
    rows = [(0, 403), (600, 403), (1201, 429), (1300, 200), (1400, 403), (1500, 500), (1600, 403)]
    log = spark.createDataFrame([(i, "k", dt.datetime.fromtimestamp(t + s, dt.UTC), st) for i, (s, st) in enumerate(rows)], "id int, token string, ts timestamp, status int")
    assert [(r.id, r.streak, r.total) for r in logs.hit_streaks(log, "token", ["ts", "id"]).orderBy("id").collect()] == [(0, 1, 1), (1, 2, 2), (2, 1, 3), (4, 1, 4), (6, 2, 5)]
    none = dict(attempt=0, retry_after=None, remaining=None, reset=None, now=100.0, error_code=None, message=None, sso=None)
    cases = [
        (dict(status=200), "free", None), (dict(status=304), "free", None), (dict(status=401), "fail_loud", None), (dict(status=200, sso="partial-results; x"), "fail_loud", None),
        (dict(status=403, retry_after=7.0), "retry_after", 7.0), (dict(status=429, remaining=0, reset=160.0), "wait_reset", 60.0), (dict(status=403, attempt=2), "backoff", 240.0),
        (dict(status=403, attempt=5), "fail_loud", None), (dict(status=422, error_code="custom", attempt=4), "backoff", 480.0), (dict(status=422, message="Only the first 1000 results"), "shard", None),
        (dict(status=422), "fix", None), (dict(status=502), "backoff", 60.0), (dict(status=404), "fix", None), (dict(status=403, retry_after=0.0), "backoff", 60.0),
    ]
    names = ["status", *none]
    df = spark.createDataFrame([(i, *[{**none, **c}[n] for n in names]) for i, (c, _, _) in enumerate(cases)],
                               "i int, status int, attempt int, retry_after double, remaining int, reset double, now double, error_code string, message string, sso string")
    assert [(r.action, r.wait_s) for r in logs.response_triage(df).orderBy("i").collect()] == [(a, w) for _, a, w in cases]


@pytest.mark.parametrize(("raw", "country", "tier"), [
    ("🇩🇪 Berlin", "DE", "exact-iso"), ("🇩🇪 Berlin / 🇫🇷 Paris", "DE", "exact-iso"), ("USA", "US", "name"), ("Nederland", "NL", "name"), ("UK", "GB", "name"), ("España", "ES", "name"),
    ("Berlin, Germany", "DE", "name"), ("Lagos", "NG", "gazetteer-city"), ("bErLiN!!!", "DE", "gazetteer-city"), ("Nowhereville, Lagos", "NG", "gazetteer-city"), ("NYC / Berlin", "DE", "gazetteer-city"),
    ("Zürich", "CH", "gazetteer-city"), ("Türkiye", "TR", "name"), ("Atlantis", None, "unmatched"), ("🌍 remote", None, "unmatched"), ("   ", None, "unmatched"), (None, None, "unmatched"),
])
def test_locations(spark, raw, country, tier):
    test_locations.rows = getattr(test_locations, "rows", []) + [(raw, country, tier)]
    if raw is not None:
        return  # all cases are resolved in one job
    df = spark.createDataFrame([(r[0],) for r in test_locations.rows], "location string")
    got = geo.resolve_locations(df, geo.load_phrases(spark, geo.COUNTRIES, True), geo.load_phrases(spark, geo.CITIES, False)).collect()
    assert {tuple(r) for r in got} == set(test_locations.rows)


def test_location_weak_tiers_and_hooks(spark):
    rows = [("Atlantis", "https://atlantis.example.de/about", None), ("Atlantis", "example.co.uk", None), ("Atlantis", None, 5.75), ("Atlantis", "x.example.com", 3.5), ("Atlantis", None, -8.0),
            ("Atlantis", None, float("inf")), ("Atlantis", None, float("nan"))]
    df = spark.createDataFrame(rows, "location string, blog string, tz double")
    tables = geo.load_phrases(spark, geo.COUNTRIES, True), geo.load_phrases(spark, geo.CITIES, False)
    got = [(r.blog, r.tz, r.country, r.confidence) for r in geo.resolve_locations(df, *tables, blog="blog", tz="tz").collect()]
    assert {(b, c) for b, _, c, _ in got if b} == {("https://atlantis.example.de/about", "DE"), ("example.co.uk", "GB"), ("x.example.com", "IR")}
    assert {(t, c, k) for b, t, c, k in got if b is None and t in (5.75, -8.0)} == {(5.75, "NP", "weak"), (-8.0, None, "unmatched")}
    extra = spark.createDataFrame([("berlin", "US")], "phrase string, iso string")
    code = F.pandas_udf(lambda s: s.map(lambda x: "fr" if x == "atlantis" else "nowhere"), "string")
    places = spark.createDataFrame([("Berlin",), ("Atlantis",), ("Mars",)], "location string")
    found = {r.location: (r.country, r.confidence) for r in geo.resolve_locations(places, *tables, extra=extra, geocoder=code).collect()}
    assert found == {"Berlin": ("US", "gazetteer-city"), "Atlantis": ("FR", "geocoder"), "Mars": (None, "unmatched")}


def days(spark, per_day, n):
    start = dt.date(2020, 1, 1)
    return spark.range(per_day * n).select(F.date_add(F.lit(start), (F.col("id") % n).cast("int")).cast("timestamp").alias("at"))


def test_plan_windows(spark):
    cover = [(dt.date(2020, 1, 1), dt.date(2020, 1, 10))]
    plan, capped = windows.plan_windows(days(spark, 500, 10), "at", 1000, windows=cover)
    rows = plan.orderBy("lo").collect()
    assert not capped and sum(r.n for r in rows) == 5000 and all(r.n < 1000 for r in rows)
    assert rows[0].lo == cover[0][0] and rows[-1].hi == cover[0][1] and all(a.hi + dt.timedelta(1) == b.lo for a, b in zip(rows, rows[1:]))
    assert windows.plan_windows(days(spark, 50, 10), "at", 1000, scan_target=300, windows=cover)[0].count() == 2
    five = windows.plan_windows(days(spark, 1500, 5), "at", windows=cover)[0].collect()
    assert len(five) == 5 and all(r.oversized for r in five)
    assert windows.plan_windows(days(spark, 99, 10), "at")[0].collect() == [(None, None, 990, False)]
    assert windows.plan_windows(days(spark, 0, 1), "at")[0].count() == 0
    some, capped = windows.plan_windows(days(spark, 500, 10), "at", 1000, windows=cover, max_windows=3)
    assert capped and some.count() == 3
    with pytest.raises(ValueError):
        P.date_window("2024-02-01..2024-01-01")


def test_segments_and_scan(spark):
    cut = lambda ids, n: [(r.after, r.upto) for r in relational.even_segments(spark.createDataFrame([(i,) for i in ids], "k long"), "k", n).orderBy("segment").collect()]
    assert cut(range(1, 10), 3) == [(0, 3), (3, 6), (6, 9)]
    assert [b - a for a, b in cut(range(1, 11), 3)] == [4, 3, 3]
    assert cut([10, 20, 30], 2) == [(9, 20), (20, 30)] and len(cut([5, 6], 5)) == 2 and cut([], 3) == []
    pages = windows.scan_since(spark.range(1, 26).withColumnRenamed("id", "k"), "k", 5, 14, 4).orderBy("page").collect()
    assert [(r.n, r.max_id) for r in pages] == [(4, 9), (4, 13), (4, 17)]


def test_paths_and_globs(spark):
    paths = spark.createDataFrame([(1, p) for p in ("Dockerfile", "docs/a/b.md", "src/x.py")], "repo_id int, path string")
    r = P.match_paths(paths, "repo_id", ["Dockerfile", "docs/*.md", "*.rs", "src/?.py", "[!a-d]*", "file"]).first()
    assert [r[f"m{i}"] for i in range(6)] == [True, True, False, True, True, False]
    rows = spark.createDataFrame([(1,), (2,), (3,)], "repo_id int")
    listing = spark.createDataFrame([(1, "Dockerfile", True), (2, "x", True)], "repo_id int, path string, truncated boolean")
    assert {x.repo_id: x.status for x in P.has_file(rows, listing, "repo_id", "Dockerfile").collect()} == {1: "keep", 2: "unknown", 3: "unknown"}
    assert {x.repo_id: x.status for x in P.has_file(rows, listing, "repo_id", "Dockerfile", budget=0).collect()} == {1: "unknown", 2: "unknown", 3: "unknown"}


def test_lint(spark):
    cases = {"stars:>1 language:rust": (True, 0), "updated:>2024": (False, 1), "a" * 256: (True, 0), "a" * 257: (False, 1), "AND " * 5 + "x": (True, 0), "AND " * 6 + "x": (False, 1),
             "props.x:y": (False, 1), "props.x:y org:a": (True, 0), "props.x:y org:a org:b": (False, 1), "-org:a props.x:y": (False, 1), "is:fork": (False, 1), "is:public": (True, 0), "stars:": (False, 1),
             "bogus:1": (False, 1), "props:x": (False, 1), '"a:b c" x': (True, 0), "": (True, 0)}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, q string")
    got = {r.i: (r.ok, r.n_errors) for r in lint.lint_queries(df, "i", "q").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    options = [("min_stars", "5", True, "5", None), ("min_stars", "-1", False, None, None), ("min_stars", "true", False, None, None), ("has_dockerfile", "true", True, "true", None), ("team_topic", '"AI-x"', True, "ai-x", None),
               ("owner_country", '"de"', True, "DE", None), ("owner_country", '"zz"', False, None, None), ("min_geo_confidence", None, True, "gazetteer-city", None), ("min_strs", "1", False, None, "min_stars"), ("zzzzzz", "1", False, None, None)]
    rows = lint.validate_options(spark.createDataFrame([o[:2] for o in options], "name string, value string"), countries=["DE"]).collect()
    assert {tuple(r) for r in rows} == set(options)


def test_funnel_sums_to_input(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("id")))
    kept, funnel = runs.run_filters(df, {"min_commits": P.range_status("v", 20), "min_stars": F.when(F.col("id") < 90, "keep").otherwise("drop")})
    rows = funnel.orderBy("step").collect()
    assert [r["filter"] for r in rows] == ["min_stars", "min_commits"] and rows[0].checked == 100 and rows[1].kept == kept.count()
    assert all(r.checked == r.kept + r.dropped + r.unknown for r in rows)
    with pytest.raises(ValueError):
        runs.plan_filters(["nope"])
    assert runs.plan_filters(["min_loc", "min_commits", "min_stars"]) == ["min_stars", "min_commits"]


def test_scalars(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("2024-01-01T23:59:30Z",), ("2024-01-01T22:00:00Z",), ("junk",), (None,)], "t string").withColumn("at", S.parse_ts("t"))
    assert [r.x for r in df.select(S.relative_time("at", now).alias("x")).collect()] == ["just now", "2h ago", "—", "—"]
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(S.normalize_location(F.lit("  🇩🇪 Berlin!!! / NYC  "))) == "🇩🇪 berlin nyc" and get(S.normalize_location(F.lit("!!!"))) == ""
    assert get(S.span_text(F.lit(3720))) == "1h 2m" and get(S.span_text(F.lit(-1))) is None and get(S.span_text(F.lit(59))) == "59s"
    assert get(S.short_error(F.lit("Error: upstream said no"))) == "Error" and get(S.short_error(F.lit("{x"))) == "{x"
    assert get(S.is_rate_limit(F.lit("Secondary RATE limit"))) and get(S.is_transient(F.lit("Timed out"))) and not get(S.is_transient(F.lit("no")))
    assert get(S.url_params(F.lit("https://a/b?page=2&q=x#f"))) == {"page": "2", "q": "x"} and get(S.url_params(F.lit("https://a"))) == {}
    assert get(S.iso_utc(F.lit("2024-01-02 03:04:05.25").cast("timestamp"))) == "2024-01-02T03:04:05.250000Z"
    assert get(S.primary_language(F.create_map(F.lit("b"), F.lit(3), F.lit("a"), F.lit(3)))) == ("a", 3)
    assert get(logs.resource_of(F.lit("https://api.x.com/search/code?q=1"))) == "code_search"


def test_retry_freeze_replay(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    tries = []

    def attempt(rows, n):
        tries.append(rows.count())
        return rows.select("k", F.lit(1).alias("value"), F.when((F.col("k") % 3 == 0) & F.lit(len(tries) < 2) | (F.col("k") == 9), "timeout").alias("error"))

    good, unresolved = runs.retry_failed_only(df, "k", attempt)
    assert good.count() == 9 and [r.k for r in unresolved.collect()] == [9] and tries == [10, 4, 1]
    table = spark.createDataFrame([(1, "h", "done", 1), (2, "h", "failed", 2), (3, "g", "running", 3)], "id long, filter_hash string, status string, created_at int")
    items = spark.createDataFrame([(1, "a"), (1, "b")], "run_id long, full_name string")
    assert runs.replay(table, items, "filter_hash", "h")[1].count() == 2
    assert runs.replay(table, items, "filter_hash", "g")[0] == "not_ready" and runs.replay(table, items, "filter_hash", "zz")[0] == "never_run"
    none = spark.createDataFrame([], "name string, source_run_id long, repo_count long, frozen_at string, note string")
    frozen = runs.freeze(none, table, items, 1, "spring", F.lit("2024"))
    assert frozen.first().repo_count == 2
    for bad in ((1, " "), (3, "x")):
        with pytest.raises(ValueError):
            runs.freeze(none, table, items, bad[0], bad[1], F.lit("2024"))
    with pytest.raises(ValueError):
        runs.freeze(frozen, table, items, 1, "spring", F.lit("2024"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "o/a", None, True), (2, "o/b", 5, False)], "repo_id int, full_name string, stargazers int, archived boolean")
    path = str(tmp_path / "csv")
    records.write_corpus_csv(df, path, df.columns)
    assert {tuple(r) for r in spark.read.csv(path, header=True).collect()} == {("1", "o/a", None, "true"), ("2", "o/b", "5", "false")}
    bundle = str(tmp_path / "bundle")
    records.write_bundle(df, {"run_id": 7, "filter_hash": "h"}, bundle, None, df.columns)
    assert spark.read.json(f"{bundle}/items").count() == 2 and spark.read.json(f"{bundle}/manifest").first()["items"] == 2
    runs_path = str(tmp_path / "runs")
    for run in (1, 2, 1):
        snapshots.snapshot_run(df.where("repo_id = 1") if run == 1 else df, run, runs_path)
    assert records.read_run_items(spark, runs_path, 2).count() == 2 and records.read_run_items(spark, runs_path, 1).count() == 1
    with pytest.raises(ValueError):
        records.read_scope(df, "full_name")


def test_coercions_by_json_type(spark):
    row = lambda v: '{"id": 1, "node_id": "n", "full_name": "a/b", "owner": {"id": 2, "login": "a"}, "stargazers_count": %s}' % v
    values = ["1", "1.5", "null", '"7"', '" 7 "', '"1.5"', "true", '"x"', "-2"]
    raw = spark.createDataFrame([(row(v),) for v in values], "value string")
    clean, rejects = records.normalize_records(raw)
    assert sorted(r.stargazers for r in clean.collect()) == [-2, 0, 1, 1, 7, 7]
    assert [r.reason for r in rejects.collect()] == ["stargazers_count"] * 3
    df = spark.createDataFrame([("1.5", True), ("1.5", False), (None, False), ("true", False)], "v string, t boolean")
    got = [tuple(r.c) for r in df.select(S.coerce_optional_int("v", F.col("t")).alias("c")).collect()]
    assert got == [(None, False), (1, True), (None, True), (None, False)]


def test_query_hash(spark):
    params = {"q": 'stars:>4 "x"', "page": "2", "none": None}
    df = spark.createDataFrame([(params,)], "m map<string,string>")
    want = hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(S.query_hash("m").alias("h")).first().h == want


def test_record_only_history_and_counts(spark):
    df = spark.createDataFrame([(1, "done", "ab"), (2, "failed", "ac"), (3, "done", "b")], "id int, status string, filter_hash string")
    marked, warnings = runs.record_only(df, ["min_loc"])
    assert marked.count() == 3 and all(r.recorded == ["min_loc"] and r.incomplete for r in marked.collect())
    assert [r.filter for r in warnings.collect()] == ["min_loc"] and runs.record_only(df, [])[1].isEmpty()
    with pytest.raises(ValueError):
        runs.record_only(df, ["min_stars"])
    ids = lambda **k: [r.id for r in runs.history_filter(df, **k).collect()]
    assert ids() == [1, 2, 3] and ids(status="done") == [1, 3] and ids(status="done", hash_prefix="a") == [1]
    assert runs.count_matches(df, F.col("status") == "done").first().n == 2


def test_map_batches_keeps_other_batches(spark):
    def fetch(keys):
        if 3 in keys:
            raise ValueError("boom")
        return {k: ValueError("bad") if k == 1 else f"v{k}" for k in keys if k != 0}

    df = spark.createDataFrame([(i,) for i in range(6)], "k int").coalesce(1)
    got = {r.k: (r.value, r.error) for r in records.map_batches(df, "k", fetch, size=2).collect()}
    assert got == {0: (None, "no answer"), 1: (None, "bad"), 2: (None, "boom"), 3: (None, "boom"), 4: ("v4", None), 5: ("v5", None)}


def test_pages_after_a_row(spark):
    rows = [(i, None if i % 4 == 0 else i % 3) for i in range(25)]
    df = spark.createDataFrame(rows, "id int, s int")
    for descending in (True, False):
        want = [r.id for r in relational.slice_page(df, [selection.Order("s", descending), "id"], 1, 25).collect()]
        got, last = [], None
        while page := relational.page_after(df, "s", "id", last, 4, descending).collect():
            got += [r.id for r in page]
            last = (page[-1].s, page[-1].id)
        assert got == want


def test_ranks_of_rows(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(5)
    assert {r.k: r.n for r in relational.global_rank(df, "k", "n").collect()} == {k: k + 1 for k in range(500)}
    assert relational.global_rank(df.where("false"), "k", "n").count() == 0
    assert {r.k: r.n for r in relational.number_rows(df.orderBy(F.desc("k")), "n").collect()} == {k: 500 - k for k in range(500)}


def test_dictionaries_of_the_platform(spark):
    countries = {r.phrase: r.iso for r in geo.country_phrases(spark).collect()}
    cities = {r.phrase: r.iso for r in geo.city_phrases(spark).collect()}
    assert len(set(countries.values())) > 240 and len(cities) > 300
    assert [countries[x] for x in ("canada", "österreich", "brasil", "日本", "de", "uk")] == ["CA", "AT", "BR", "JP", "DE", "GB"]
    assert [cities[x] for x in ("toronto", "berlin", "sao paulo", "munich")] == ["CA", "DE", "BR", "DE"]
