"""Filters as boolean Columns, and three-valued filters as status Columns (keep, drop, unknown)."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import col, confidence_rank, primary_language

KEEP, DROP, UNKNOWN = "keep", "drop", "unknown"


def active(deleted_at="deleted_at") -> Column:
    """Rows without a tombstone."""
    return col(deleted_at).isNull()


def count_filter(c, spec: str) -> Column:
    """n, =n, >n, >=n, <n, <=n, a..b, a..* or *..b on a count."""
    m = re.fullmatch(r"(>=|<=|>|<|=)?(-?\d+(?:\.\d+)?)|(\*|-?\d+(?:\.\d+)?)\.\.(\*|-?\d+(?:\.\d+)?)", spec.strip())
    if not m:
        raise ValueError(f"not a count range: {spec!r}")
    sign, value, low, high = m.groups()
    if value is not None:
        number = F.lit(float(value) if "." in value else int(value))
        return {None: col(c) == number, "=": col(c) == number, ">": col(c) > number, ">=": col(c) >= number, "<": col(c) < number, "<=": col(c) <= number}[sign]
    bounds = [] if low == "*" else [col(c) >= float(low)]
    bounds += [] if high == "*" else [col(c) <= float(high)]
    return reduce(lambda a, b: a & b, bounds, col(c).isNotNull())


def date_window(spec: str) -> tuple[dt.date | None, dt.date | None]:
    """Inclusive day bounds of a date range; > and < move by one day; low above high is an error."""
    day = lambda s: dt.date.fromisoformat(re.split("[Tt]", s)[0])
    text, one = spec.strip(), dt.timedelta(days=1)
    if not text:
        raise ValueError("a date range needs a value")
    if ".." in text:
        left, right = text.split("..", 1)
        low, high = (None if x in ("", "*") else day(x) for x in (left, right))
    elif text[:2] in (">=", "<="):
        low, high = (day(text[2:]), None) if text[0] == ">" else (None, day(text[2:]))
    elif text[0] in "<>":
        low, high = (day(text[1:]) + one, None) if text[0] == ">" else (None, day(text[1:]) - one)
    else:
        low = high = day(text)
    if low and high and low > high:
        raise ValueError(f"{spec} is an empty range")
    return low, high


def date_filter(c, spec: str) -> Column:
    """Timestamps inside a date range. Written on the timestamp itself, so that it is pushed down to the scan."""
    low, high = date_window(spec)
    bounds = [col(c) >= low.isoformat()] if low else []  # text takes the type of the column, so nothing is cast
    bounds += [col(c) < (high + dt.timedelta(days=1)).isoformat()] if high else []
    return reduce(lambda a, b: a & b, bounds, col(c).isNotNull())


def same_qualifier_union(predicates: dict[str, list[Column]]) -> Column:
    """Predicates of one qualifier are alternatives; those of different qualifiers must all hold."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, of) for of in predicates.values()])


def exclude(predicate: Column) -> Column:
    return ~F.coalesce(predicate, F.lit(False))


def keyword_filter(texts: list, words: list[str], op: str = "AND", without: tuple[str, ...] = ()) -> Column:
    """Words or phrases in any of the text columns, whatever their case; `without` must not occur."""
    held = F.lower(F.concat_ws("\n", *[col(t) for t in texts]))
    each = [held.contains(w.lower()) for w in words]
    found = reduce((lambda a, b: a | b) if op == "OR" else (lambda a, b: a & b), each)
    return reduce(lambda a, w: a & ~held.contains(w.lower()), without, found)


def scope_filter(c, names: list[str]) -> Column:
    return F.lower(col(c)).isin([n.lower() for n in names])


def attribute_filter(c, value: str) -> Column:
    return F.coalesce(col(c) == value, F.lit(False))


def topic_filter(topics, topic: str) -> Column:
    """Membership of a topic, whatever its case."""
    return F.coalesce(F.exists(col(topics), lambda t: F.lower(t) == topic.lower()), F.lit(False))


def flag_filter(flags: dict[str, bool]) -> Column:
    """Boolean columns that must have the given values; null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(col(c), F.lit(False)) == v for c, v in flags.items()])


def fork_policy(fork, policy: str = "exclude") -> Column:
    """exclude (the default), include or only."""
    is_fork = F.coalesce(col(fork), F.lit(False))
    return {"exclude": ~is_fork, "include": F.lit(True), "only": is_fork}[policy]


def property_filter(properties, name: str, value: str) -> Column:
    return F.coalesce(F.try_element_at(col(properties), F.lit(name)) == value, F.lit(False))


def min_stars(stars, n) -> Column:
    return col(stars) >= n if n > 0 else F.coalesce(col(stars), F.lit(0)) >= n  # the plain form is pushed down


def range_status(c, low=None, high=None) -> Column:
    """keep or drop by bounds; unknown where the value is."""
    inside = reduce(lambda a, b: a & b, ([col(c) >= low] if low is not None else []) + ([col(c) <= high] if high is not None else []), F.lit(True))
    return F.when(col(c).isNull(), UNKNOWN).when(inside, KEEP).otherwise(DROP)


def language_bytes_status(languages, low=None, high=None) -> Column:
    """By the bytes of the primary language; no data is unknown."""
    return range_status(primary_language(languages)["bytes"], low, high)


def country_status(country, confidence, wanted: str, worst: str = "gazetteer-city") -> Column:
    """No country or a tier that isn't known: unknown; another country or a worse tier: drop."""
    limit = confidence_rank(F.lit(worst))
    return (
        F.when(col(country).isNull(), UNKNOWN).when(col(country) != wanted, DROP).when(confidence_rank(confidence).isNull(), UNKNOWN)
        .when(confidence_rank(confidence) > limit, DROP).otherwise(KEEP)
    )


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob; * crosses slashes, [!x] negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w/ -])", r"\\\1", c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def match_path(path, pattern: str) -> Column:
    """A literal is equality, a glob a regular expression."""
    return col(path).rlike(glob_regex(pattern)) if re.search(r"[*?\[]", pattern) else col(path) == pattern


def match_paths(paths: DataFrame, key: str, patterns: list[str], path: str = "path") -> DataFrame:
    """Per key one boolean column m0, m1, ... for each pattern, in their order."""
    return paths.groupBy(key).agg(*[F.coalesce(F.bool_or(match_path(path, p)), F.lit(False)).alias(f"m{i}") for i, p in enumerate(patterns)])


def has_file(rows: DataFrame, paths: DataFrame, key: str, wanted: str, expect: bool = True, budget: int | None = None, order: list | None = None) -> DataFrame:
    """rows with `status`: the path is there, is not, or unknown (no listing, a truncated one without it, past the budget)."""
    seen = paths.groupBy(key).agg(F.bool_or(F.col("path") == wanted).alias("_hit"), F.bool_or(F.coalesce("truncated", F.lit(False))).alias("_cut"))
    found = F.when(F.col("_hit"), F.lit(True)).when(F.col("_hit").isNull() | F.col("_cut"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    status = F.when(found.isNull(), UNKNOWN).when(found == expect, KEEP).otherwise(DROP)
    joined = rows.join(seen, key, "left")
    if budget is not None:
        inside = rows.orderBy(*(order or [F.col(key)])).limit(budget).select(key, F.lit(True).alias("_in"))
        joined = joined.join(inside, key, "left")
        status = F.when(F.col("_in").isNull(), UNKNOWN).otherwise(status)
    return joined.withColumn("status", status).select(*rows.columns, "status")
