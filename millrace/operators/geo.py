"""Countries of free-text locations, by dictionaries that are DataFrames of (phrase, iso).

Each distinct text is resolved once: its candidates and their word prefixes are exploded, joined with the dictionaries and
the best hit is taken by (tier, candidate, shorter prefix last). The dictionaries are parameters. country_phrases and
city_phrases make them from what the platform knows: names of all ISO countries, in English and in their own languages,
and the cities that time zones are named after; load_phrases reads further ones from `code phrase|phrase` lines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import flag_to_iso, host_tld_iso, normalize_location, prefix_phrases, split_candidates, tz_iso, valid_iso

# Names and cities that the platform's own tables lack or spell otherwise.
COUNTRIES = [
    "AE united arab emirates|uae", "BR brazil|brasil", "DE germany|deutschland", "ES spain|españa", "FR france", "GB united kingdom|uk|england",
    "IN india", "JP japan", "NG nigeria", "NL netherlands|nederland", "TR turkey|türkiye", "US united states|usa",
]
CITIES = ["CH zürich|zurich", "DE berlin|munich", "FR paris", "GB london", "IN bengaluru|mumbai", "JP tokyo", "NG lagos"]


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """NFC form; Spark has no built-in for it. Used on distinct non-ASCII texts only."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def load_phrases(spark: SparkSession, lines: list[str], codes: bool) -> DataFrame:
    """(phrase, iso) of `code phrase|phrase` lines; with `codes` the code itself is a phrase too. First mention wins."""
    made: dict[str, str] = {}
    for line in lines:
        code, _, rest = line.strip().partition(" ")
        for phrase in ([code.lower()] if codes else []) + [p.strip().lower() for p in rest.split("|") if p.strip()]:
            made.setdefault(phrase, code)
    return spark.createDataFrame(sorted(made.items()), "phrase string, iso string")


_names: list[tuple[str, str]] = []


def _country_names(spark: SparkSession) -> list[tuple[str, str]]:
    """(name, code) of all ISO countries; taken from the platform once a process, as it takes a thousand calls."""
    if not _names:
        locales = spark._jvm.java.util.Locale
        named = lambda code, language: (locales.Builder().setRegion(code).build().getDisplayCountry(language), code)
        codes = list(locales.getISOCountries())
        known = set(codes)
        _names.extend([(c, c) for c in codes] + [named(c, locales.ENGLISH) for c in codes])
        _names.extend(sorted({named(c, x) for x in locales.getAvailableLocales() if (c := x.getCountry()) in known}))
    return _names


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, iso) of a file of `code phrase|phrase` lines, such as demonyms or further cities; of several codes the least."""
    line = F.trim("value")
    parts = spark.read.text(path).where(line.rlike(r"^\S+ ")).select(F.substring_index(line, " ", 1).alias("iso"), F.explode(F.split(F.expr("substr(trim(value), instr(trim(value), ' ') + 1)"), r"\|")).alias("name"))
    return parts.select(normalize_location("name").alias("phrase"), "iso").where("phrase != ''").groupBy("phrase").agg(F.min("iso").alias("iso"))


def country_phrases(spark: SparkSession, more: list[str] = COUNTRIES) -> DataFrame:
    """(phrase, iso) of all ISO countries: codes, names in English and in the languages of the country; `more` goes first."""
    return _phrases(load_phrases(spark, more, codes=True), _country_names(spark))


def city_phrases(spark: SparkSession, more: list[str] = CITIES) -> DataFrame:
    """(phrase, iso) of the cities that time zones of a country are named after; `more` goes first."""
    lines = resources.files("tzdata").joinpath("zoneinfo/zone.tab").read_text(encoding="utf-8").splitlines()
    zones = [line.split("\t") for line in lines if line and line[0] != "#"]
    return _phrases(load_phrases(spark, more, codes=False), [(z[2].rsplit("/", 1)[-1].replace("_", " "), z[0]) for z in zones])


def _phrases(first: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """first, and the names that it lacks, normalised; of several countries with one name the first mentioned."""
    spark = first.sparkSession
    rows = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(names)], "name string, iso string, i int")
    rest = rows.select(normalize_location("name").alias("phrase"), "iso", "i").where("phrase != ''").groupBy("phrase").agg(F.min_by("iso", "i").alias("iso"))
    return first.unionByName(rest.join(F.broadcast(first), "phrase", "left_anti"))


def location_hits(df: DataFrame, location: str = "location") -> DataFrame:
    """(normalized, hits, sample) of non-blank locations; the sample is the least raw text."""
    norm = normalize_location(location)
    return df.where(F.col(location).isNotNull()).groupBy(norm.alias("normalized")).agg(F.count(F.lit(1)).alias("hits"), F.min(location).alias("sample")).where("normalized != ''")


def resolve_locations(
    df: DataFrame, countries: DataFrame, cities: DataFrame, extra: DataFrame | None = None, geocoder: Callable | None = None,
    location: str = "location", blog: str | None = None, tz: str | None = None,
) -> DataFrame:
    """Distinct (location, blog, tz) of df with `country` and `confidence`.

    Tiers in order: flag, exact country name, name prefix (3 letters or more), exact city, city prefix (`extra` cities go
    before `cities`), geocoder (a pandas UDF, used on what is left), domain of blog, offset tz; else unmatched.
    """
    keys = [location, *[c for c in (blog, tz) if c]]
    rows = df.select(*keys).distinct()
    texts = rows.select(location).where(F.col(location).isNotNull()).distinct()
    nfc = F.when(F.col(location).rlike(r"[^\x00-\x7F]"), composed(F.col(location))).otherwise(F.col(location))
    texts = texts.withColumn("_nfc", nfc).withColumn("_flag", flag_to_iso("_nfc")).withColumn("_parts", split_candidates("_nfc"))
    cands = texts.where(F.col("_flag").isNull()).select(location, F.posexplode("_parts").alias("cand", "phrase"))
    # each candidate as a whole and each of its prefixes, looked up once in all dictionaries
    cut = F.transform(prefix_phrases("phrase"), lambda p, i: F.struct(i.alias("cut"), p.alias("key"), F.lit(False).alias("whole")))
    whole = F.array(F.struct(F.lit(0).alias("cut"), F.col("phrase").alias("key"), F.lit(True).alias("whole")))
    keys_of = cands.select(location, "cand", F.explode(F.concat(whole, cut)).alias("k")).select(location, "cand", "k.*")
    entries = countries.select("phrase", "iso", F.lit(0).alias("prio"), F.lit(1).alias("_tier")).union(cities.select("phrase", "iso", F.lit(1), F.lit(3)))
    if extra is not None:
        entries = entries.union(extra.select("phrase", "iso", F.lit(0), F.lit(3)))
    found = keys_of.join(entries, F.col("key") == F.col("phrase")).where("whole OR _tier = 3 OR length(phrase) >= 3")
    hits = found.select(location, (F.col("_tier") + F.when(F.col("whole"), 0).otherwise(1)).alias("tier"), "cand", "cut", "prio", "iso")
    best = hits.groupBy(location).agg(F.min(F.struct("tier", "cand", "cut", "prio", "iso")).alias("_hit"))
    out = rows.join(texts.select(location, "_flag"), location, "left").join(best, location, "left")
    coded = F.lit(None).cast("string")
    if geocoder is not None:
        left = cands.join(best, location, "left_anti")
        asked = left.select("phrase").distinct().withColumn("_iso", valid_iso(geocoder(F.col("phrase"))))
        first = left.join(asked, "phrase").where(F.col("_iso").isNotNull()).groupBy(location).agg(F.min_by("_iso", "cand").alias("_coded"))
        out, coded = out.join(first, location, "left"), F.col("_coded")
    weak = F.coalesce(*([host_tld_iso(blog)] if blog else []), *([tz_iso(tz)] if tz else []), F.lit(None).cast("string"))
    tier = F.when(F.col("_flag").isNotNull(), "exact-iso").when(F.col("_hit.tier") <= 2, "name").when(F.col("_hit").isNotNull(), "gazetteer-city")
    tier = tier.when(coded.isNotNull(), "geocoder").when(weak.isNotNull(), "weak").otherwise("unmatched")
    return out.select(*keys, F.coalesce("_flag", "_hit.iso", coded, weak).alias("country"), tier.alias("confidence"))


def resolve_with_cache(df: DataFrame, cache: DataFrame, countries: DataFrame, cities: DataFrame, location: str = "location") -> tuple[DataFrame, DataFrame]:
    """(location, country, confidence) of each distinct location, and the cache with what was newly resolved.

    cache is (normalized, country, confidence, hits); a hit by the normalised text is not resolved again.
    """
    seen = location_hits(df, location)
    fresh = seen.join(cache, "normalized", "left_anti").select(F.col("sample").alias(location), "normalized", "hits")
    solved = fresh.join(resolve_locations(fresh, countries, cities, location=location), location).select("normalized", "country", "confidence", "hits")
    again = cache.join(seen.select("normalized", F.col("hits").alias("_more")), "normalized", "left")
    grown = again.select("normalized", "country", "confidence", (F.col("hits") + F.coalesce("_more", F.lit(0))).alias("hits")).unionByName(solved)
    keyed = df.select(location).where(F.col(location).isNotNull()).distinct().withColumn("normalized", normalize_location(location))
    return keyed.join(grown, "normalized").select(location, "country", "confidence"), grown


def refresh_owner_country(owners: DataFrame, answered: DataFrame, countries: DataFrame, cities: DataFrame, key: str = "id") -> DataFrame:
    """owners (key, location, country, confidence) with answers (key, location) written back.

    Only owners without a country that aren't `unmatched` yet are pending; an answered null becomes `unmatched`; an owner
    that wasn't answered stays as it is.
    """
    pending = owners.where(F.col("country").isNull() & ~F.col("confidence").eqNullSafe("unmatched")).select(key)
    got = answered.join(pending, key, "left_semi").select(key, F.col("location").alias("_loc"))
    solved = resolve_locations(got.where(F.col("_loc").isNotNull()), countries, cities, location="_loc")
    got = got.join(solved.withColumnsRenamed({"country": "_iso", "confidence": "_tier"}), "_loc", "left").withColumn("_answered", F.lit(True))
    out = owners.join(got, key, "left")
    new = F.col("_answered").isNotNull()
    return out.select(
        key, F.when(new, F.col("_loc")).otherwise(F.col("location")).alias("location"), F.when(new, F.col("_iso")).otherwise(F.col("country")).alias("country"),
        F.when(new, F.coalesce("_tier", F.lit("unmatched"))).otherwise(F.col("confidence")).alias("confidence"),
    )


def flatten_owner_location(df: DataFrame, node: str = "node") -> DataFrame:
    """Owner nodes (id, node struct) that were answered, with their location; blank is null; a missing node gives no row."""
    text = F.col(f"{node}.location")
    return df.where(F.col(node).isNotNull()).select("id", F.when(F.trim(text) != "", text).alias("location"))
