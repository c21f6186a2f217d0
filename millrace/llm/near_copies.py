"""Links between near copies: MinHash bands over 5-word shingles, then the exact Jaccard similarity of the shingle sets.

Texts with JACCARD share a band with a probability of 0.9998. Groups of up to MAX_PAIRED texts in a band give all their
pairs. In a larger group each text is first held against the middle one, which has most texts in the groups of its other
bands, and texts that turn out linked, however indirectly, need not be compared with each other. What is still apart in
such a group is compared exactly: shingles are put in order, rarest first, and a pair with the similarity has its first
common shingle near the start of both texts (prefix and position filters), so texts are joined on these few shingles.
That is certain to find every pair that is left, whatever the texts have in common besides; only pairs of texts that
aren't linked yet are formed. Only the texts of candidate pairs are read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import annotate, materialize, raw_texts, release, small
from millrace.llm.components import components

SHINGLE = 5
JACCARD = 0.8
BANDS, ROWS = 16, 4
MAX_PAIRED = 64
#: Shingles of so many texts at most count as rare; shared shingles in front of one that are looked at.
RARE, BEFORE = 64, 8
_CHUNK = 1 << 13
_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LONGS = T.ArrayType(T.LongType())


def grams(raw: bytes | None) -> np.ndarray:
    """Hashes of the set of the text's shingles (lower case; fewer words: all of them); none for a text without words."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))) if len(words) >= SHINGLE else {b" ".join(words)}
    return np.array([xxhash.xxh64_intdigest(s) for s in shingles], dtype=np.uint64)


def bands(raw: bytes | None) -> list[int]:
    """One signed key for each band; none for a text without words."""
    hashes = grams(raw)
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        mixed = hashes[i : i + _CHUNK, None] * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_key, grams), written, of the texts in the written table wanted."""
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(small(wanted), "text_key").dropDuplicates(["text_key"])
    made = annotate(texts, ["text"], [("grams", LONGS)], lambda texts: [pa.array([grams(r).view(np.int64) for r in raw_texts(texts)], pa.list_(pa.int64()))], ["text_key"])
    return materialize(made.select("row.text_key", "res.grams"))


def _similar(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(u, v), written: the fingerprints of the pairs of nodes whose shingle sets have that similarity."""
    of = lambda k: sets.select(F.col("text_key").alias(f"{k}_key"), F.col("grams").alias(f"{k}_grams")).hint("merge")
    both = pairs.select("u", "v", F.col("u.text_key").alias("u_key"), F.col("v.text_key").alias("v_key")).join(of("u"), "u_key").join(of("v"), "v_key")
    n, total = F.size(F.array_intersect("u_grams", "v_grams")), F.size("u_grams") + F.size("v_grams")
    return materialize(both.where(n >= F.lit(jaccard) * (total - n)).select(F.col("u.fp").alias("u"), F.col("v.fp").alias("v")))


def _apart(hot: DataFrame, found: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(u, v), written: pairs of nodes of the groups hot (key, node) that found doesn't link and that may be similar."""
    roots = components(found.distinct())
    named = hot.join(roots.withColumnsRenamed({"u": "fp", "v": "root"}).hint("merge"), F.col("node.fp") == F.col("fp"), "left")
    named = materialize(named.select("key", "node", F.coalesce("root", "node.fp").alias("root")))
    # a pair that is apart has a text outside the largest set of linked texts of some group
    counts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("main"), F.count(F.lit(1)).alias("sets"))
    counts = materialize(counts.where("sets > 1").select("key", "main"))
    nodes = named.join(counts.hint("merge"), "key").groupBy("node", "root").agg(F.max(F.col("root") != F.col("main")).alias("lone"))
    nodes = materialize(nodes.select("node", "root", "lone", F.col("node.text_key").alias("text_key")))
    texts = materialize(nodes.join(sets.hint("merge"), "text_key").select("node", "root", "lone", "grams"))
    each = texts.select("node", F.explode("grams").alias("gram"))
    counts_of = each.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    scarce = materialize(counts_of.where(F.col("texts") <= RARE))
    # of each text its shingles that few texts have, those of no other text counted only
    few = each.join(scarce.hint("merge"), "gram").groupBy("node").agg(F.collect_list(F.struct("texts", "gram")).alias("few"))
    few = materialize(few.select(F.col("node").alias("at"), F.array_sort("few").alias("few")))
    own, shared = F.filter("few", lambda x: x["texts"] == 1), F.filter("few", lambda x: x["texts"] > 1)
    plain = lambda a: F.transform(a, lambda x: x["gram"])
    joined = texts.join(few.hint("merge"), F.col("node") == F.col("at"), "left").withColumn("few", F.coalesce("few", F.array().cast("array<struct<texts:long,gram:long>>")))
    # one order for all texts: shingles of no other text, those of few texts, the others
    ordered = joined.select("node", "root", "lone", F.size("grams").alias("size"), F.size(own).alias("alone"), F.concat(plain(shared), F.array_sort(F.array_except("grams", plain(F.col("few"))))).alias("order"))
    least = lambda share: F.ceil(F.col("size") * share - 1e-9)  # noqa: E731  shingles that a pair must have in common, for the size of one text
    as_long, as_short = F.col("size") - least(jaccard), F.col("size") - least(2 * jaccard / (1 + jaccard))
    # with the shared shingles just before: where two texts have one of these in common, they have met on it
    start = F.slice("order", 1, F.greatest(as_long + 1 - F.col("alone"), F.lit(0)).cast("int"))
    before = lambda d: F.transform(d, lambda g, i: F.struct(g.alias("gram"), i.alias("i"), F.slice(d, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE))).alias("before")))
    placed = ordered.select("node", "root", "lone", "size", "alone", as_short.alias("as_short"), F.explode(F.get(F.transform(F.array(start), before), F.lit(0))).alias("s"))
    place = (F.col("alone") + F.col("s.i")).alias("place")
    placed = materialize(placed.select("node", "root", "lone", "size", place, "s.gram", "s.before", "as_short").withColumn("early", F.col("place") <= F.col("as_short")).drop("as_short"))
    short, long = placed.where("early").alias("a"), placed.alias("b")
    left: Column = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    fits = ~F.arrays_overlap("a.before", "b.before") & (F.col("a.size") <= F.col("b.size")) & (F.col("b.size") * jaccard <= F.col("a.size") + 1e-9) & (left + 1e-9 >= (F.col("a.size") + F.col("b.size")) * (jaccard / (1 + jaccard)))
    met = lambda a, b, one: a.join(b, "gram").where((F.col("a.root") != F.col("b.root")) & fits & one).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    # one of the two is outside the largest set: join those with all, never the largest set with itself
    pairs = met(short.where("lone"), long, F.lit(True)).union(met(short.where("NOT lone"), long.where("lone"), F.lit(True)))
    out = materialize(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    release(roots, named, counts, nodes, texts, scarce, few, placed)
    return out


def links(docs: DataFrame, marked: DataFrame, jaccard: float = JACCARD, max_paired: int = MAX_PAIRED) -> DataFrame:
    """Edges (u, v), u > v, that connect the fingerprints of texts with that similarity. marked: text_key, fp, bands of the rows of docs."""
    node = F.struct("fp", "text_key").alias("node")
    keyed = materialize(marked.select(node, F.explode("bands").alias("key")).distinct())
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = materialize(keyed.join(sizes.hint("merge"), "key"))
    few, hot = shared.where(F.col("n") <= max_paired), shared.where(F.col("n") > max_paired)
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    middle = hot.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("centre"))
    middle = materialize(middle)  # a written table: both sides of the join are then plain exchanges, whose hot partitions Spark splits
    a, b = few.select("key", F.col("node").alias("u")), few.select("key", F.col("node").alias("v"))
    star = hot.join(middle.hint("merge"), "key").select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v"))
    pairs = a.join(b, "key").select("u", "v").union(star).where((F.col("u") > F.col("v")) & (F.col("u.fp") != F.col("v.fp")))
    pairs = materialize(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("u.text_key", "v.text_key")).alias("text_key")).union(hot.select("node.text_key"))
    wanted = materialize(wanted.distinct())
    sets = _shingle_sets(docs, wanted)
    found = _similar(pairs, sets, jaccard)
    apart = _apart(hot.select("key", "node"), found, sets, jaccard)
    more = _similar(apart, sets, jaccard)
    out = materialize(found.union(more).distinct())
    release(keyed, sizes, shared, middle, pairs, wanted, sets, found, apart, more)
    return out
