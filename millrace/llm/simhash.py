"""SimHash near-duplicate groups: pigeonhole blocks, Hamming check, connected components.

Documents with equal fingerprints are one node. Nodes are joined on every choice of `blocks - distance` of their
blocks, since two fingerprints that differ in `distance` bits agree on that many blocks. Block groups of up to
MAX_PAIRED nodes give their pairs, which are verified. The nodes of larger groups are linked without pairs: two
fingerprints within 2 bits share a neighbour at distance 1 or less, so each node meets the others at its own value and
its 64 one-bit changes, and links to the least node met there. Either way no link is lost and rows grow in proportion
to nodes.
"""

from __future__ import annotations

from itertools import combinations
from operator import or_
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import near_copies
from millrace.llm._common import annotate, materialize, raw_texts, release, small
from millrace.llm.components import components

SEED = 42
SHINGLE = 3
MAX_PAIRED = 64
_CHUNK = 1 << 15


def fingerprint(raw: bytes | None) -> int:
    """Signed 64-bit SimHash of a text: a bit is 1 if it is set in over half of its shingles' hashes; no words: 0."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    set_in = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Structs `row` (doc_id) and `res` (fp: signed 64-bit fingerprint)."""
    return annotate(docs, ["text"], [("fp", T.LongType())], lambda texts: [pa.array([fingerprint(r) for r in raw_texts(texts)], pa.int64())], ["doc_id"])


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, distance: int = 2, blocks: int = 4, max_paired: int = MAX_PAIRED) -> DataFrame:
    """Edges (u, v), u > v, written, that connect all fingerprints `fp` of nodes within `distance` (2 at most) bits."""
    if not 0 < distance <= 2 or blocks <= distance:
        raise ValueError("distance must be 1 or 2, and blocks more than that")
    width = 64 // blocks
    masks = [((1 << (64 if i == blocks - 1 else width * (i + 1))) - 1) ^ ((1 << (width * i)) - 1) for i in range(blocks)]
    kept = [reduce(or_, chosen) for chosen in combinations(masks, blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("part", "key"))
    # written tables: both sides of the joins are then plain exchanges, whose hot partitions Spark splits
    sizes = materialize(keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = materialize(keyed.join(sizes.hint("merge"), ["part", "key"]))
    few = shared.where(F.col("n") <= max_paired)
    a, b = few.select("part", "key", F.col("fp").alias("u")), few.select("part", "key", F.col("fp").alias("v"))
    paired = a.join(b, ["part", "key"]).where((F.col("u") > F.col("v")) & (_hamming(F.col("u"), F.col("v")) <= distance)).select("u", "v")
    hot = shared.where(F.col("n") > max_paired).select("fp").distinct()
    one_bit = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)]]
    meets = hot.select("fp", F.explode(F.array(*one_bit)).alias("z"))
    least = materialize(meets.groupBy("z").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    met = meets.join(least.hint("merge"), "z").where((F.col("fp") != F.col("v")) & (_hamming(F.col("fp"), F.col("v")) <= 2))
    if distance == 1:
        # the least node met may lie 2 bits away: link along single changed bits between nodes instead
        met = meets.join(hot.select(F.col("fp").alias("v")), F.col("z") == F.col("v")).where("fp > v")
    out = materialize(paired.union(met.select(F.col("fp").alias("u"), "v")).distinct())
    release(sizes, shared, least)
    return out


def near_duplicates(docs: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Per document: doc_id, fp, root (of its component, a fingerprint) and component_id.

    component_id is the smallest doc_id reachable over links of fingerprints at most `distance` bits apart; null doc_ids
    don't count (null only if a component has no other). Null, empty and blank texts have fingerprint zero and are
    linked like any other. Repeated rows and ties share a fingerprint and so a component; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text")).select("row.doc_id", "res.fp"))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = _classes(nodes, distance, blocks).hint("merge")
    return marked.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def _classes(nodes: DataFrame, distance: int, blocks: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id), written, of each node (fp, least); more: edges besides those of links()."""
    edges = links(nodes, distance, blocks)
    stars = components(edges if more is None else edges.union(more).distinct())
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "fp")))
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    out = materialize(rooted.join(least.hint("merge"), "root").select("fp", "root", "component_id"))
    release(edges, stars, rooted, least)
    return out


def drop_near_duplicates(docs: DataFrame, distance: int = 2, blocks: int = 4, jaccard: float | None = None) -> DataFrame:
    """One document of each component: the one with its smallest doc_id. All columns stay; repeated rows leave one.

    Of several texts with that doc_id the one with the smallest hash stays, of rows equal in both the one with the
    smallest hash of its columns; a null doc_id stays only where there is no other. Null, empty and blank texts are alike;
    an empty table gives no rows. With jaccard, texts whose sets of 5-word shingles are that similar are linked too,
    however far their fingerprints are. Groups are found on (doc_id, text hash, fingerprint); texts are read again only
    where copies must be compared, and to give the rows that stay.
    """
    fields = [("fp", T.LongType())] + ([("bands", near_copies.LONGS)] if jaccard is not None else [])

    def make(texts: pa.Array) -> list[pa.Array]:
        raw = raw_texts(texts)
        made = [pa.array([fingerprint(r) for r in raw], pa.int64())]
        return made if jaccard is None else [*made, pa.array([near_copies.bands(r) for r in raw], pa.list_(pa.int64()))]

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    marked = materialize(annotate(keyed, ["text"], fields, make, ["doc_id", "text_key"]).select("row.*", "res.*"))
    more = None if jaccard is None else near_copies.links(docs, marked, jaccard)
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    keys = marked.groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).join(_classes(nodes, distance, blocks, more), "fp")
    keys = materialize(keys.select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key").alias("key"), "n"))
    stays = keys.groupBy("root").agg(F.min("key").alias("stays"))
    other = keys.join(stays, "root").where((F.col("key") != F.col("stays")) | (F.col("n") > 1))
    # what goes, and of what one row stays
    other = materialize(other.select(F.col("key.doc_id").alias("at_id"), F.col("key.text_key").alias("at_key"), (F.col("key") == F.col("stays")).alias("once")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key"))
    known = packed.join(small(other), F.col("key_id").eqNullSafe(F.col("at_id")) & (F.col("key") == F.col("at_key")), "left")
    first = Window.partitionBy("key_id", "key").orderBy(F.xxhash64(F.to_json("row")))
    once = known.where("once").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    release(keys, marked)
    return known.where("once IS NULL").select("row.*").union(once.select("row.*"))
