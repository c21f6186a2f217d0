"""Checks over tables of search queries and of filter options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import CONFIDENCE, literal_map

# Qualifiers that a query may use.
QUALIFIERS = [
    "in", "repo", "user", "org", "size", "followers", "forks", "stars", "created", "pushed", "language", "topic", "topics", "license", "is", "mirror",
    "template", "archived", "good-first-issues", "help-wanted-issues", "has", "props", "fork", "deployable", "deployed",
]
# Frequent mistakes and what to write instead.
HINTS = {
    "updated": "use `pushed:` + sort=updated", "push": "use `pushed:`", "is:archive": "use `archived:true`", "is:fork": "use `fork:true`",
    "is:forks": "use `fork:true`", "is:sponsor": "use `is:sponsorable`", "has:funding": "use `has:funding-file`", "is:mirror": "use `mirror:`",
    "is:template": "use `template:`",
}
KEYWORD_LIMIT, OPERATOR_LIMIT = 256, 5
# Filter options and the kind of their values.
OPTIONS = {
    "min_stars": "int", "team_topic": "topic", "has_dockerfile": "bool", "owner_country": "iso2", "min_geo_confidence": "enum", "min_commits": "int",
    "max_commits": "int", "min_language_bytes": "int", "max_language_bytes": "int", "min_loc": "int", "max_loc": "int",
}
DEFAULTS = {"min_geo_confidence": "gazetteer-city"}


def lint_queries(df: DataFrame, key: str, query: str) -> DataFrame:
    """Per query: ok, n_errors, errors (sorted `kind:token`), hints (sorted, distinct), keyword_chars and operators.

    Kinds: unknown_qualifier, empty_value, property_name, property_form, property_scope, keyword_limit, operator_limit.
    Each row is judged by itself, rows with one key too; a null query has no tokens.
    """
    hints, known = literal_map(HINTS), F.array(*[F.lit(q) for q in QUALIFIERS])
    tokens = F.regexp_extract_all(query, F.lit(r'("[^"]*"|\S+)'), 1)

    def shape(token: Column) -> Column:
        quoted = token.startswith('"')
        excluded = token.startswith("-") & ~quoted
        plain = F.when(excluded, F.substring(token, 2, 1 << 30)).otherwise(token)
        return F.struct(token.alias("token"), quoted.alias("quoted"), excluded.alias("excluded"), plain.alias("plain"), (token.isin("AND", "OR", "NOT") & ~quoted).alias("operator"))

    def parts(t: Column) -> Column:
        plain, name = t["plain"], F.lower(F.split_part(t["plain"], F.lit(":"), F.lit(1)))
        keyword = t["quoted"] | (~t["operator"] & ~plain.contains(":"))
        pair = F.concat_ws(":", name, F.lower(F.split_part(plain, F.lit(":"), F.lit(2))))
        hint = F.when(~keyword & ~t["operator"], F.coalesce(F.try_element_at(hints, pair), F.try_element_at(hints, name)))
        value = F.substring(plain, F.length(name) + 2, F.length(plain))
        kept = [t[c].alias(c) for c in ("token", "quoted", "excluded", "plain", "operator")]
        return F.struct(*kept, keyword.alias("keyword"), name.alias("name"), value.alias("value"), hint.alias("hint"))

    def judged(t: Column) -> Column:
        name, plain, empty = t["name"], t["plain"], t["value"] == ""
        is_qualifier, property_ = ~t["keyword"] & ~t["operator"], name.startswith("props.")
        kind = (
            F.when(~is_qualifier, None).when(t["hint"].isNotNull(), "unknown_qualifier").when(name == "props.", "property_name").when(property_ & empty, "empty_value").when(property_, None)
            .when(name == "props", "property_form").when(~F.array_contains(known, name), "unknown_qualifier").when(empty, "empty_value")
        )
        fine = is_qualifier & t["hint"].isNull() & ~empty
        chars = F.when(t["quoted"], F.length(F.trim(t["token"], F.lit('"')))).when(t["keyword"], F.length(plain)).otherwise(0)
        return F.struct(
            F.when(kind.isNotNull(), F.concat_ws(":", kind, plain)).alias("bad"), F.when(fine & property_ & (name != "props."), F.concat_ws(":", F.lit("property_scope"), plain)).alias("scoped"),
            t["hint"].alias("hint"), F.when(fine & (name == "org") & ~t["excluded"], F.lower(t["value"])).alias("org"), chars.cast("long").alias("chars"), t["operator"].alias("operator"),
        )

    read = df.select(key, F.coalesce(F.transform(F.transform(F.transform(tokens, shape), parts), judged), F.array()).alias("t"))
    per = read.select(
        key, F.array_compact("t.bad").alias("bad"), F.array_compact("t.scoped").alias("scoped"), F.array_distinct(F.array_compact("t.hint")).alias("hints"),
        F.size(F.array_distinct(F.array_compact("t.org"))).alias("orgs"), F.aggregate("t.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("keyword_chars"),
        F.size(F.filter("t.operator", lambda x: x)).cast("long").alias("operators"),
    )
    unscoped = (F.size("scoped") > 0) & (F.col("orgs") != 1)
    beyond = lambda kind, c, limit: F.when(F.col(c) > limit, F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))
    limits = F.array_compact(F.array(beyond("keyword_limit", "keyword_chars", KEYWORD_LIMIT), beyond("operator_limit", "operators", OPERATOR_LIMIT)))
    errors = F.array_sort(F.concat("bad", F.when(unscoped, F.col("scoped")).otherwise(F.array().cast("array<string>")), limits))
    n = F.size(errors)
    all_hints = F.when(unscoped, F.array_union("hints", F.array(F.lit("add a single org: scope")))).otherwise(F.col("hints"))
    return per.select(key, (n == 0).alias("ok"), n.cast("long").alias("n_errors"), errors.alias("errors"), F.array_sort(all_hints).alias("hints"), "keyword_chars", "operators")


def validate_options(df: DataFrame, name: str = "name", value: str = "value", countries: list[str] | None = None) -> DataFrame:
    """df of (name, value as JSON text) with ok, normalized and suggestion.

    A null value takes the default. `countries` limits country codes. For an unknown option the nearest known name by edit
    distance is suggested, if it is within half the length of the name.
    """
    spark = df.sparkSession
    rules = F.broadcast(spark.createDataFrame([(k, v, DEFAULTS.get(k)) for k, v in OPTIONS.items()], f"{name} string, kind string, default string"))
    text = F.when(F.col(value).rlike('^".*"$'), F.expr(f"substring({value}, 2, length({value}) - 2)"))
    topic, code = F.lower(F.trim(text)), F.upper(F.trim(text))
    in_list = code.isin(countries) if countries else F.lit(True)
    normal = (
        F.when(F.col(value).isNull() | (F.col(value) == "null"), F.col("default")).when((F.col("kind") == "int") & F.col(value).rlike("^[0-9]+$"), F.col(value))
        .when((F.col("kind") == "bool") & F.col(value).isin("true", "false"), F.col(value))
        .when((F.col("kind") == "topic") & topic.rlike("^[a-z0-9][a-z0-9-]{0,49}$"), topic).when((F.col("kind") == "iso2") & code.rlike("^[A-Z]{2}$") & in_list, code)
        .when((F.col("kind") == "enum") & text.isin(CONFIDENCE), text)
    )
    joined = df.join(rules, name, "left")
    absent = F.col(value).isNull() | (F.col(value) == "null")
    out = joined.withColumn("normalized", normal).withColumn("ok", F.col("kind").isNotNull() & (F.col("normalized").isNotNull() | absent))
    unknown = out.where(F.col("kind").isNull()).select(name).distinct()
    options = F.array(*[F.lit(o) for o in sorted(OPTIONS)])
    near = F.array_min(F.transform(options, lambda o: F.struct(F.levenshtein(F.col(name), o).alias("d"), o.alias("o"))))
    close = unknown.withColumn("_n", near).select(name, F.when(F.col("_n.d") * 2 <= F.length(name), F.col("_n.o")).alias("suggestion"))
    return out.join(close, name, "left").select(*df.columns, "ok", "normalized", "suggestion")
