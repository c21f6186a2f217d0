"""Line dedup by content-defined chunks, in DataFrame functions only.

Lines without a word are set aside. Each other line is hashed; a rolling comparison of a line's hash with those of the
lines around it marks chunk starts: one chunking starts at the least of three neighbours, another at the greatest. So
starts depend on three lines alone and survive shifts, a chunk has two lines at least and three in the mean. A chunk
that occurs before (by doc_id, then place) anywhere in the table and is equal byte for byte is removed.

A repeated passage rarely starts and ends where a chunk does. So each match with another document is extended line by
line, byte for byte, into the chunks before and after it, as far as both documents are equal. Chunks are first compared
as narrow rows of hashes; lines are read again only for the chunks that repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import doc_key, materialize, release

MIN_LINES = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside another lambda Spark would evaluate a column again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _filled(text: Column) -> Column:
    """Array of (pos, line) of the lines with a word."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: x["line"].rlike(r"\S"))


def _chunks(text: Column) -> Column:
    """Array of (h, n, at, back, ahead): hash and number of lines of a chunk, its place among the filled lines, and the lines of the chunks around it."""

    def both(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.xxhash64(x))
        return _let(F.struct(lines.alias("lines"), hashes.alias("h")), lambda d: F.concat(cut(d, lambda a, b: a < b), cut(d, lambda a, b: a > b)))

    def cut(d: Column, better: Callable[[Column, Column], Column]) -> Column:
        # as starts are two lines apart, so are both from the ends of the text
        inner = lambda i: (i >= MIN_LINES) & (i <= F.size(d["h"]) - MIN_LINES) & better(F.get(d["h"], i), F.get(d["h"], i - 1)) & better(F.get(d["h"], i), F.get(d["h"], i + 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(d["h"]) - 1), lambda i: (i == 0) | inner(i))
        return _let(F.struct(starts.alias("starts"), d["lines"].alias("lines")), spread)

    def spread(at: Column) -> Column:
        total = F.size(at["lines"])
        start = lambda k: F.coalesce(F.get(at["starts"], k), total)
        return F.transform(at["starts"], lambda s, k: F.struct(
            F.xxhash64(F.slice(at["lines"], s + 1, start(k + 1) - s)).alias("h"), (start(k + 1) - s).alias("n"), s.alias("at"),
            (s - F.coalesce(F.get(at["starts"], k - 1), F.lit(0))).alias("back"), (start(k + 2) - start(k + 1)).alias("ahead")))

    chunks = lambda lines: F.when(F.size(lines) >= MIN_LINES, _let(lines, both))
    return _let(F.transform(_filled(text), lambda x: x["line"]), chunks)


def _equal_start(a: Column, b: Column) -> Column:
    """How many elements from the first on are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, n), written: runs of filled lines, from the at-th on, that are equal to lines that come before."""
    texts = docs.where(F.col("text").isNotNull())
    place = F.struct("doc_id", "text_key", "at")
    marks = texts.select(*doc_key(), F.explode(_chunks(F.col("text"))).alias("c")).select("doc_id", "text_key", "c.*")
    marks = materialize(marks.select("h", "n", place.alias("place"), "back", "ahead"))
    known = marks.groupBy("h", "n").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first")).where("times > 1").drop("times")
    # written tables: both sides of the joins are then plain exchanges, whose hot partitions Spark splits
    known = materialize(known)
    chunk = F.struct("h", "n", F.col("place.at").alias("at"), "back", "ahead", "first")
    wanted = marks.join(known.hint("merge"), ["h", "n"]).groupBy("place.doc_id", "place.text_key").agg(F.collect_set(chunk).alias("wanted"))
    wanted = materialize(wanted.withColumnsRenamed({"doc_id": "at_id", "text_key": "at_key"}))
    keyed = texts.select(*doc_key(), "text")
    joined = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")))
    part = lambda d, start, n: F.slice(d["lines"], start + 1, n)
    taken = lambda d: F.transform(d["wanted"], lambda c: F.struct(c["h"].alias("h"), c["n"].alias("n"), c["at"].alias("at"), c["first"].alias("first"),
        part(d, c["at"] - c["back"], c["back"]).alias("before"), part(d, c["at"], c["n"]).alias("chunk"), part(d, c["at"] + c["n"], c["ahead"]).alias("after")))
    lines = F.transform(_filled(F.col("text")), lambda x: x["line"])
    found = joined.select("doc_id", "text_key", F.explode(_let(F.struct(lines.alias("lines"), "wanted"), taken)).alias("c")).select("doc_id", "text_key", "c.*")
    found = materialize(found.select("h", "n", place.alias("place"), "first", "before", "chunk", "after"))
    kept = F.first(F.struct("before", "chunk", "after")).alias("kept")
    firsts = materialize(found.where(F.col("place") == F.col("first")).groupBy("h", "n").agg(kept))
    later = found.where(F.col("place") != F.col("first")).join(firsts.hint("merge"), ["h", "n"]).where(F.col("chunk") == F.col("kept.chunk"))
    # a run that grew inside its own document could take lines of its first occurrence
    other = ~(F.col("place.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place.text_key") == F.col("first.text_key")))
    back = F.when(other, _equal_start(F.reverse("before"), F.reverse("kept.before"))).otherwise(0)
    ahead = F.when(other, _equal_start(F.col("after"), F.col("kept.after"))).otherwise(0)
    runs = later.select("place.doc_id", "place.text_key", (F.col("place.at") - back).alias("at"), (F.col("n") + back + ahead).alias("n"))
    out = materialize(runs.distinct())
    release(marks, known, wanted, found, firsts)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` without the lines of repeated runs, and n_lines and n_removed (lines) in the struct `res`.

    Returns the structs `row` (docs, with the new text) and `res`. The first occurrence, by doc_id and place, stays; a
    null doc_id comes first. Lines without a word inside a run go with it. Rows that repeat both doc_id and text are one
    document and are treated alike. A null text stays null with 0 lines; an empty text is one empty line; a text may
    become empty. An empty table gives no rows.
    """
    gone = repeated_lines(docs).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    # a written table, as above
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "gone")).hint("merge")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs["doc_id"].alias("at_id"), F.xxhash64(docs["text"]).alias("at_key"))
    joined = packed.join(gone, F.col("at_id").eqNullSafe(F.col("gone_id")) & (F.col("at_key") == F.col("gone_key")), "left")
    spans = lambda d: F.transform(d["gone"], lambda g: F.sequence(F.get(d["pos"], g["at"]), F.get(d["pos"], g["at"] + g["n"] - 1)))
    positions = F.transform(_filled(F.col("row.text")), lambda x: x["pos"])
    removed = F.array_distinct(F.flatten(_let(F.struct(positions.alias("pos"), "gone"), spans)))
    joined = joined.select("row", F.when(F.col("gone").isNotNull(), removed).alias("removed"))
    lines = F.split("row.text", "\n", -1)
    left = lambda d: F.transform(F.array_except(F.sequence(F.lit(0), F.size(d["lines"]) - 1), d["removed"]), lambda i: F.get(d["lines"], i))
    kept = _let(F.struct(lines.alias("lines"), "removed"), lambda d: F.array_join(left(d), "\n"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    fields = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size("removed")).cast("long")
    return joined.select(F.struct(*fields).alias("row"), F.struct(n_lines.alias("n_lines"), n_removed.alias("n_removed")).alias("res"))
