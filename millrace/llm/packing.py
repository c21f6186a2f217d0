"""Sequence packing by non-negative least squares.

Every document's ids are cut into pieces of the window and one rest. Piece lengths fall into classes of GRAIN tokens. On
the driver, which sees only the histogram of classes, all combinations of up to three classes that fill the window are
enumerated, their repeat counts solved by non-negative least squares against the histogram, and rounded down. On the
executors a piece finds its sequence from its rank inside its class by arithmetic. The pieces left over are packed
greedily by their true lengths in buckets of some BUCKET sequences: the largest that fits comes next, and where none fits
one is cut, at a multiple of CUT tokens.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import public_tokenizers
from millrace.llm._common import annotate, gapless_rank, materialize, release, salts

WINDOW = 2048
GRAIN = 8
#: Sequences of a bucket of left pieces, about; tokens between the places where one may be cut.
BUCKET, CUT = 200, 32
END_ID = 1
#: Parts of texts kept in the cache at most, and the characters of the longest one kept: some 20 MB.
_CACHE, _LONGEST = 100_000, 32
#: Text that the rank file's pattern and the library split alike, with white space only as single blanks or newlines.
_PLAIN = re.compile(r"[\n -~¡-ɏ‐-‧€]*")
_RUNS = re.compile(r"[ \n](?=[ \n])")


class IdEncoder:
    """ids of texts as little-endian 32-bit bytes, equal to those of the library on the whole text.

    A plain text is cut before each blank and around each newline. Pre-tokens never cross these cuts, so the parts'
    ids are those of the whole; they are kept in a bounded cache. A text with other characters, runs of white space
    or a special token's string is encoded whole by the library.
    """

    def __init__(self, json_path: str, rank_path: str):
        self.library = Tokenizer.from_file(json_path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or _RUNS.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known = self.parts
        if len(known) > _CACHE:
            known.clear()
        units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        encode = self.ranks.encode_ordinary
        fresh = {u: np.array(encode(u), dtype="<u4").tobytes() for u in {u for u in units if u not in known}}
        known.update((u, ids) for u, ids in fresh.items() if len(u) <= _LONGEST)
        return b"".join([known[u] if u in known else fresh[u] for u in units])


@lru_cache(maxsize=2)
def encoder(json_path: str, rank_path: str) -> IdEncoder:
    return IdEncoder(json_path, rank_path)


def combinations_filling(units: int) -> np.ndarray:
    """Columns: how often each class 1..units occurs in each combination of up to three classes that sums to units."""
    columns = [(units,)] + [(a, units - a) for a in range(1, units // 2 + 1)]
    columns += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    matrix = np.zeros((units, len(columns)))
    for j, c in enumerate(columns):
        for x in c:
            matrix[x - 1, j] += 1
    return matrix


def nnls(matrix: np.ndarray, target: np.ndarray, max_steps: int = 2000) -> np.ndarray:
    """Non-negative least squares by an active set of columns."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(matrix.T @ target).max(initial=0)))
    for _ in range(max_steps):
        slope = np.where(active, -np.inf, matrix.T @ (target - matrix @ x))
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)  # as many columns as rows at most, so these products stay small
            part = matrix[:, at]
            try:
                best = np.linalg.solve(part.T @ part, part.T @ target)
            except np.linalg.LinAlgError:  # dependent columns
                best = np.linalg.lstsq(part, target, rcond=None)[0]
            if best.min() > 0:
                break
            bad = best <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - best[bad], 1e-300))
            x[at] += step * (best - x[at])
            active[at[(x[at] <= tolerance) & bad]] = False
            x[~active] = 0
            if not active.any():
                return x
        x[:] = 0
        x[at] = best
    return x


def plan_sequences(histogram: dict[int, int], units: int) -> list[tuple[dict[int, int], int]]:
    """(classes and how often each occurs in the sequence, repeats): sequences that fill `units` with pieces of the histogram."""
    left = np.zeros(units, dtype=np.int64)
    for c, n in histogram.items():
        left[c - 1] = n
    plan = []
    full = int(left[-1])  # a full piece is a sequence
    if full:
        plan.append(({units: 1}, full))
        left[-1] = 0
    if left.sum() > 1:
        matrix = combinations_filling(units)
        matrix = matrix[:, (matrix[left == 0] == 0).all(axis=0)]
        if matrix.shape[1]:
            counts = np.floor(nnls(matrix, left.astype(float)) + 1e-9).astype(np.int64)
            for j in np.argsort(-counts, kind="stable"):
                if counts[j] <= 0:
                    break
                used = np.flatnonzero(matrix[:, j])
                each = matrix[used, j].astype(np.int64)
                repeats = int(min(counts[j], (left[used] // each).min()))
                if repeats:
                    left[used] -= repeats * each
                    plan.append(({int(c) + 1: int(m) for c, m in zip(used, each)}, repeats))
    return plan


def pack_rest(lengths: list[int], window: int, cut: int = CUT) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) of pieces of these lengths: the largest that fits, or a part of one."""
    pool = sorted((n, i, 0) for i, n in enumerate(lengths))
    out, sequence, room = [], 0, window
    while pool:
        k = bisect_right(pool, room, key=lambda p: p[0]) - 1
        if k >= 0:
            n, i, start = pool.pop(k)
        else:
            n = room // cut * cut
            if n:
                whole, i, start = pool.pop()
                insort(pool, (whole - n, i, start + n))
        if n:
            out.append((i, start, n, sequence, window - room))
            room -= n
        if k < 0 or not room:
            sequence, room = sequence + 1, window
    return out


def _prefix_crcs(ids: bytes, window: int) -> list[int]:
    """CRC-32 of the first CUT, 2 * CUT, ... ids, then of all; of all alone for a full piece, which is never cut."""
    if len(ids) == 4 * window:
        return [zlib.crc32(ids)]
    crc, out = 0, []
    for at in range(0, len(ids), 4 * CUT):
        crc = zlib.crc32(ids[at : at + 4 * CUT], crc)
        out.append(crc)
    return out


def crc_between(crcs: list[int], start: int, length: int) -> int:
    """CRC-32 of `length` ids from `start`, a multiple of CUT, from the prefix sums: the checksum is linear."""
    end = crcs[-(-(start + length) // CUT) - 1]
    if not start:
        return end
    zeros = bytes(4 * length)
    return end ^ zlib.crc32(zeros, crcs[start // CUT - 1]) ^ zlib.crc32(zeros)


def tokenize_pieces(docs: DataFrame, json_path: str, rank_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, crcs (prefix sums), doc_tokens; a document's last piece ends with END_ID."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crcs", pa.list_(pa.int64()))])

    def make(texts: pa.Array) -> list[pa.Array]:
        known, totals, rows = encoder(json_path, rank_path), [], []
        for text in texts.to_pylist():
            ids = known.encode(text or "") + end
            n = len(ids) // 4
            totals.append(n)
            rows.append([{"start": s, "length": min(window, n - s), "crcs": _prefix_crcs(ids[4 * s : 4 * (s + window)], window)} for s in range(0, n, window)])
        return [pa.array(totals, pa.int64()), pa.array(rows, pa.list_(piece))]

    kind = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])
    made = annotate(docs.select("doc_id", "text"), ["text"], [("doc_tokens", T.LongType()), ("pieces", T.ArrayType(kind))], make, ["doc_id"])
    return made.select("row.doc_id", "res.doc_tokens", F.explode("res.pieces").alias("p")).select("doc_id", "p.*", "doc_tokens")


def _pack_bucket(rows: pd.DataFrame, window: int, base: int, n_buckets: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_tokens", "start", "crc"], kind="stable").reset_index(drop=True)
    made = pack_rest(rows["length"].tolist(), window)
    at = [p[0] for p in made]
    crcs, bucket = rows["crcs"].tolist(), int(rows["bucket"].iloc[0]) if len(rows) else 0
    out = rows.loc[at, ["doc_id", "start", "doc_tokens"]].reset_index(drop=True)
    out["start"] += np.array([p[1] for p in made], dtype=np.int64)
    out["length"] = [p[2] for p in made]
    out["ids_crc32"] = [crc_between(crcs[p[0]], p[1], p[2]) for p in made]
    out["sequence_id"] = [base + bucket + n_buckets * p[3] for p in made]
    out["offset"] = [p[4] for p in made]
    return out[OUT]


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, json_path: str, rank_path: str, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. Long documents are cut at multiples of the window, a piece
    left over by the plan also where a sequence is full; every id is in exactly one piece. Sequence ids may have gaps.
    Repeated rows and null ids are packed like any other row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = tokenize_pieces(docs, json_path, rank_path, window).withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    pieces = materialize(pieces.withColumn("crc", F.element_at("crcs", -1)))
    histogram = {r["class"]: r.n for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, used, base = [], Counter(), 0
    for chosen, repeats in plan_sequences(histogram, -(-window // grain)):
        for c, m in chosen.items():
            rows.append((c, used[c], used[c] + m * repeats, m, base))
            used[c] += m * repeats
        base += repeats
    # at most one row for each class of each combination: some thousands, whatever the input
    places = spark.createDataFrame(rows, "at int, lo long, hi long, each long, base long")
    order = [F.col("doc_id"), F.col("start"), F.col("crc")]
    ranked = gapless_rank(pieces, ["class"], order, order, salts(sum(histogram.values())), "rank")
    found = ranked.join(F.broadcast(places), (F.col("class") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    found = materialize(found.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).drop("at", "lo", "hi", "each", "base"))
    release(pieces)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    placed = found.where(F.col("sequence_id").isNotNull()).withColumnRenamed("crc", "ids_crc32").withColumn("offset", offset).select(OUT)
    rest = found.where(F.col("sequence_id").isNull())
    n_buckets = max(1, (rest.agg(F.sum("length").alias("n")).first().n or 0) // (BUCKET * window))
    bucket = F.pmod(F.xxhash64("class", "rank"), F.lit(n_buckets)).alias("bucket")
    rest = rest.select("doc_id", "start", "length", "crcs", "crc", "doc_tokens", bucket)
    schema = T.StructType([placed.schema[c] for c in OUT])
    return placed.unionByName(rest.groupBy("bucket").applyInPandas(lambda rows: _pack_bucket(rows, window, base, n_buckets), schema))
