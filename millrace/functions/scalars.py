"""Scalar functions, Column to Column. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country of the country-code domains that are looked at.
CC_TLDS = {
    "ar": "AR", "at": "AT", "au": "AU", "be": "BE", "br": "BR", "ca": "CA", "ch": "CH", "cn": "CN", "cz": "CZ", "de": "DE",
    "dk": "DK", "es": "ES", "fi": "FI", "fr": "FR", "gb": "GB", "gh": "GH", "ie": "IE", "il": "IL", "in": "IN", "it": "IT",
    "jp": "JP", "ke": "KE", "kr": "KR", "mx": "MX", "ng": "NG", "nl": "NL", "no": "NO", "nz": "NZ", "pl": "PL", "pt": "PT",
    "ru": "RU", "se": "SE", "tr": "TR", "ua": "UA", "uk": "GB", "us": "US", "za": "ZA",
}
# UTC offsets, in hours, that belong to one country alone.
TZ_ONLY = {"3.5": "IR", "4.5": "AF", "5.75": "NP", "9.5": "AU"}
# Tiers of confidence in a country, best first.
CONFIDENCE = ["exact-iso", "name", "gazetteer-city", "geocoder", "weak"]
# Words shown for run statuses.
STATUS_LABELS = {
    "queued": "Waiting", "running": "Running", "done": "Finished", "partial": "Finished — incomplete", "failed": "Failed",
    "cancelled": "Stopped",
}
# Texts that mark an error as passing, and as a rate limit.
TRANSIENT = ["timeout", "timed out", "resource limits", "something went wrong", "try again", "temporarily", "rate limit", "secondary rate", "abuse"]
RATE_LIMIT = ["rate limit", "secondary rate", "abuse"]
# An error line is cut before these.
ERROR_CUTS = ["{", "Validation Failed", "upstream"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parse_ts(c) -> Column:
    """ISO-8601 text to timestamp; anything else is null."""
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(col(c)))


def _whole(c: Column, is_text: Column) -> Column:
    """Whole number of a JSON scalar given as text; numbers are cut towards zero, JSON strings must hold digits alone; else null."""
    text = F.trim(c)
    digits = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return F.when(is_text, digits).otherwise(F.coalesce(digits, F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double").try_cast("long"))))


def coerce_count(c, is_text: Column | bool = False) -> Column:
    """Whole number of a JSON scalar given as text: null counts as 0; true, false and other texts are invalid (null).

    is_text: the scalar is a JSON string, so "1.5" is invalid where the number 1.5 counts as 1.
    """
    return F.when(col(c).isNull(), F.lit(0).cast("long")).otherwise(_whole(col(c), F.lit(is_text) if isinstance(is_text, bool) else is_text))


def coerce_optional_int(c, is_text: Column | bool = False) -> Column:
    """(value, valid) of a JSON scalar given as text: null is a valid null; what coerce_count() finds invalid is invalid."""
    value = F.when(col(c).isNotNull(), _whole(col(c), F.lit(is_text) if isinstance(is_text, bool) else is_text))
    return F.struct(value.alias("value"), (col(c).isNull() | value.isNotNull()).alias("valid"))


def last_segment(c) -> Column:
    return F.substring_index(col(c), "/", -1)


def owner_prefix(c) -> Column:
    return F.substring_index(col(c), "/", 1)


def iso_utc(c) -> Column:
    """Timestamp as YYYY-MM-DDTHH:MM:SS[.ffffff]Z."""
    micros = F.date_format(col(c), "SSSSSS")
    return F.concat(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def spec_hash(names: list[str]) -> Column:
    """SHA-256 of the compact JSON object of the named columns, keys sorted; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[col(n) for n in sorted(names)])), 256)


def query_hash(c) -> Column:
    """SHA-256 of a map of parameters as compact JSON, keys sorted; null values stay."""
    entries = F.array_sort(F.map_entries(col(c)))
    text_of = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text_of(e["key"]), F.lit(":"), text_of(e["value"]))), ","), F.lit("}")), 256)


def fingerprint(c) -> Column:
    """First 12 hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(col(c), 256), 1, 12)


def normalize_location(c) -> Column:
    """Lower case; only letters, digits, marks and flags stay; white space is collapsed. Takes composed (NFC) text."""
    kept = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\p{M}\s\x{1F1E6}-\x{1F1FF}]|[\x{FE0E}\x{FE0F}]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


_FLAGS = "".join(chr(0x1F1E6 + i) for i in range(26))
_LETTERS = "".join(chr(0x41 + i) for i in range(26))


def flag_to_iso(c) -> Column:
    """Letters of the first pair of regional indicators, or null."""
    pair = F.regexp_extract(col(c), r"[\x{1F1E6}-\x{1F1FF}]{2}", 0)
    return F.when(pair != "", F.translate(pair, _FLAGS, _LETTERS))


def split_candidates(c) -> Column:
    """Parts of a location between / | , • ( ) and newlines, normalised, without flags and empty parts."""
    parts = F.split(col(c), r"[/|,•()\n\r]+")
    plain = F.transform(parts, lambda p: normalize_location(F.regexp_replace(p, r"[\x{1F1E6}-\x{1F1FF}]", " ")))
    return F.filter(plain, lambda p: p != "")


def prefix_phrases(c, least: int = 1) -> Column:
    """Proper word prefixes of a text, longest first, of `least` characters or more."""
    words = F.split(col(c), " ")
    cuts = F.when(F.size(words) > 1, F.sequence(F.size(words) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(cuts, lambda n: F.array_join(F.slice(words, 1, n), " ")), lambda p: F.length(p) >= least)


def host_tld_iso(c) -> Column:
    """Country of a URL's top-level domain; a URL without a scheme is read as https."""
    text = F.trim(col(c))
    host = F.try_parse_url(F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text)), F.lit("HOST"))
    return F.when(host.contains("."), F.try_element_at(literal_map(CC_TLDS), F.lower(F.substring_index(host, ".", -1))))


def tz_iso(c) -> Column:
    """Country that alone has a UTC offset (hours, rounded half-even to quarters)."""
    offset = col(c).cast("double")
    finite = offset.isNotNull() & ~F.isnan(offset) & (F.abs(offset) < 1e6)
    key = (F.bround(F.when(finite, offset) * 4, 0) / 4).cast("string")
    return F.try_element_at(literal_map(TZ_ONLY), key)


def valid_iso(c) -> Column:
    """Two ASCII letters in upper case, or null."""
    code = F.upper(F.trim(col(c)))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def confidence_rank(c) -> Column:
    """1 for the best tier to 5; null for anything else."""
    place = F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), col(c))
    return F.when(place > 0, place)


def primary_language(c) -> Column:
    """(name, bytes) of the language with most bytes; ties: the least name. Null without languages."""
    ranked = F.transform(F.map_entries(col(c)), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    first = F.array_min(ranked)
    return F.when(F.size(F.map_entries(col(c))) > 0, F.struct(first["k"].alias("name"), (-first["v"]).alias("bytes")))


def commit_count_of(branch) -> Column:
    """Commits behind a default branch struct: no branch means 0, a malformed one null."""
    return F.when(col(branch).isNull(), F.lit(0)).otherwise(col(branch)["target"]["history"]["totalCount"])


def link_next(c) -> Column:
    """URL of rel="next" in a link header, or null."""
    found = F.regexp_extract(col(c), r'<([^>]*)>\s*;[^,]*rel="?next"?', 1)
    return F.when(found != "", found)


def link_last_page(c) -> Column:
    """Page number of rel="last" in a link header, or null."""
    url = F.regexp_extract(col(c), r'<([^>]*)>\s*;[^,]*rel="?last"?', 1)
    return F.try_parse_url(F.when(url != "", url), F.lit("QUERY"), F.lit("page")).try_cast("int")


def url_params(c) -> Column:
    """Query string as a map; empty without one."""
    query = F.regexp_extract(col(c), r"\?([^#]*)", 1)
    return F.when(query != "", F.str_to_map(query, F.lit("&"), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))


def header_value(headers, name: str) -> Column:
    """Value of a header, whatever its case."""
    found = F.map_values(F.map_filter(col(headers), lambda k, v: F.lower(k) == name.lower()))
    return F.get(found, 0)


def epoch_s(c) -> Column:
    """Seconds since the epoch, with fractions, of a timestamp with or without a zone."""
    return col(c).cast("timestamp").cast("double")


def rounded(c, digits: int) -> Column:
    """A double rounded half away from zero by its product with 10^digits, as C does it; Spark's round goes by the shortest text of the double."""
    return F.round(col(c) * 10.0**digits) / 10.0**digits


def _seconds(later: Column, earlier: Column) -> Column:
    return epoch_s(later) - epoch_s(earlier)


def relative_time(c, now: Column) -> Column:
    s = F.greatest(F.floor(_seconds(now, col(c))), F.lit(0))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(col(c).isNull(), "—").when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h"))
        .when(s < 30 * 86400, part(86400, "d")).otherwise(part(30 * 86400, "mo"))
    )


def duration_text(started, finished) -> Column:
    s = F.greatest(_seconds(col(finished), col(started)), F.lit(0.0))
    whole = F.floor(s)
    long = F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))
    return F.when(col(started).isNull() | col(finished).isNull(), "—").when(s < 60, F.format_string("%.1fs", s)).otherwise(long)


def span_text(seconds) -> Column:
    t = F.floor(col(seconds))
    text = lambda big, small, a, b: F.concat(big.cast("string"), F.lit(a), small.cast("string"), F.lit(b))
    return (
        F.when((col(seconds) < 0) | col(seconds).isNull(), None).when(t < 60, F.concat(t.cast("string"), F.lit("s")))
        .when(t < 3600, text(F.floor(t / 60), t % 60, "m ", "s")).otherwise(text(F.floor(t / 3600), F.floor(t / 60) % 60, "h ", "m"))
    )


def csv_cell(c) -> Column:
    """null as '', true and false in lower case, anything else as text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def _any_of(c, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(col(c)).contains(m) for m in marks])


def is_transient(c) -> Column:
    return _any_of(c, TRANSIENT)


def is_rate_limit(c) -> Column:
    return _any_of(c, RATE_LIMIT)


def short_error(c) -> Column:
    """First line of an error, cut before the markers, of 300 characters at most."""
    text = F.split_part(col(c), F.lit("\n"), F.lit(1))
    for mark in ERROR_CUTS:
        at = F.instr(text, mark)
        text = F.when(at > 1, F.rtrim(F.substring_index(text, mark, 1), F.lit(" :"))).otherwise(text)
    return F.substring(text, 1, 300)


def status_label(c) -> Column:
    return F.coalesce(F.try_element_at(literal_map(STATUS_LABELS), col(c)), col(c))


def json_bool(c, path: str) -> Column:
    """True where the JSON value at path is true."""
    return F.coalesce(F.get_json_object(col(c), path) == "true", F.lit(False))
