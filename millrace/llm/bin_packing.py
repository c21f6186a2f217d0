"""Best-fit packing with large-item matching: whole documents into as few sequences as it can.

A document is one item; only one longer than the window is cut, into pieces of the window and a last shorter one. No
sequence holds more than two items above a third of the window, so these are matched: the longest item goes with the
longest partner that still fits. Shorter items then go, longest first, into the sequence with the least room that takes
them (best fit), and into a new one where there is none.

Items of one length are alike, so both steps work on the histogram of lengths, with runs of sequences that have equal
room: the result is that of placing the items one by one. The driver sees one row a length, `window` at most; a run is
split in two at most once a length and, as its room at least halves whenever it takes items, is touched log2(window)
times, so the plan has some 100,000 rows at most whatever the input. On the executors an item finds its place from its
rank among the items of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from millrace.llm._common import annotate, gapless_rank, materialize, release, salts

WINDOW = 4096
END_ID = 1
#: Words kept in the cache at most, and the characters of the longest one kept: some 60 MB.
_CACHE, _LONGEST = 300_000, 32
#: Text that a cut at white space and at the pattern's borders leaves as the library reads it.
_PLAIN = re.compile(r"[\n -~¡-ɏ‐-‧€]*")
_LETTERS = "".join(c for c in map(chr, range(0x250)) if category(c)[0] == "L")
_NUMBERS = "".join(c for c in map(chr, range(0x250)) if category(c)[0] == "N")
_PARTS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_WORD = re.compile(f"[{_LETTERS}]+")
_SUFFIX = "</w>"


def _byte_characters() -> dict[str, int]:
    """Character that stands for a byte in a byte-level vocabulary -> the byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: A word's bytes as symbols: a to z and those of two-byte letters stand for themselves; as the last one, where the end
#: mark is part of the symbol, they are moved to codes that words don't use otherwise.
_LAST = bytes(b - 0x61 if 0x61 <= b <= 0x7A else b - 0x60 if 0x80 <= b <= 0xBF else 0xFF for b in range(256))
_INNER = frozenset([*range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC2, 0xCA)])


class WordEncoder:
    """ids of texts as little-endian 32-bit bytes, equal to those of the library on the whole text.

    A plain text is cut into the pattern's parts, which merges never cross; their ids are kept in a bounded cache. New
    words of letters are merged by a rank table of the same vocabulary. That is the library's result if no entry can
    arise in two ways: `proved` checks offline that every entry, encoded alone, is itself and that ids follow the order
    of the merges, so whatever stands next to each other with an entry as its sum is that entry's own last merge. All
    else, and all texts if the proof fails, is encoded by the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.proved = self._prove(vocab, merges)
        at, ranks = _byte_characters(), {}
        for entry, rank in vocab.items():
            ends, shown = entry.endswith(_SUFFIX), entry.removesuffix(_SUFFIX)
            raw = bytes(at.get(c, 0) for c in shown)
            if raw and _INNER.issuperset(raw) and not (ends and raw[-1] >= 0xC0):
                ranks[raw[:-1] + raw[-1:].translate(_LAST) if ends else raw] = rank
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def _prove(vocab: dict[str, int], merges: list[tuple[str, str]]) -> bool:
        made = [vocab[a + b] for a, b in merges]
        inner = Tokenizer(models.BPE(vocab=vocab, merges=merges)).model
        last = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=_SUFFIX)).model
        alone = all(len((last if v.endswith(_SUFFIX) else inner).tokenize(v.removesuffix(_SUFFIX))) == 1 for v in vocab)
        return alone and all(x < y for x, y in zip(made, made[1:]))

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not _WORD.fullmatch(part):
            return self._library(part)
        raw = part.encode()
        return array("I", self.merge(raw[:-1] + raw[-1:].translate(_LAST))).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.proved or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._library(text)
        known = self.parts
        if len(known) > _CACHE:
            known.clear()
        parts = _PARTS.findall(text.lower())
        long = {}
        for p in set(parts).difference(known):
            (known if len(p) <= _LONGEST else long)[p] = self._part(p)
        return b"".join([known[p] if p in known else long[p] for p in parts] if long else map(known.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(size, lo, hi, each, bin, offset) of runs of items, and the number of bins.

    The items of `size` with ranks lo up to hi go, `each` to a bin, into bins bin, bin + 1, ..., from `offset` on.
    """
    left = {s: n for s, n in histogram.items() if n}
    used: dict[int, int] = defaultdict(int)
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first bin, bins)
    order: list[int] = []  # the rooms there are, ascending
    plan, n_bins = [], 0

    def put(size: int, n: int, each: int, first: int, offset: int) -> None:
        plan.append((size, used[size], used[size] + n, each, first, offset))
        used[size] += n

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                insort(order, room)
                rooms[room] = []
            rooms[room].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if left[a] == 1:
            large.pop()
        at = bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if not b:
            n = left[a]
            put(a, n, 1, n_bins, 0)
        elif b == a:
            n = left[a] // 2
            put(a, 2 * n, 2, n_bins, 0)
        else:
            n = min(left[a], left[b])
            put(a, n, 1, n_bins, 0)
            put(b, n, 1, n_bins, a)
            left[b] -= n
        left[a] -= 2 * n if b == a else n
        leave(capacity - a - b, n_bins, n)
        n_bins += n
        for s in {a, b}:
            if s and not left[s] and (i := bisect_left(large, s)) < len(large) and large[i] == s:
                large.pop(i)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                opened = -(-n // (capacity // s))
                leave(capacity, n_bins, opened)
                n_bins += opened
                continue
            room = order[at]
            first, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            each = min(room // s, n)
            filled = min(bins, n // each)
            put(s, filled * each, each, first, capacity - room)
            n -= filled * each
            leave(room - each * s, first, filled)
            leave(room, first + filled, bins - filled)
    return plan, n_bins


def tokenize_items(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per item: doc_id, piece, start, length, ids_crc32; a document's last item ends with END_ID."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    item = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def make(texts: pa.Array) -> list[pa.Array]:
        encode, rows = encoder(path).encode, []
        for text in texts.to_pylist():
            ids = encode(text or "") + end
            n = len(ids) // 4
            rows.append([{"piece": k, "start": s, "length": min(window, n - s), "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + window)])} for k, s in enumerate(range(0, n, window))])
        return [pa.array(rows, pa.list_(item))]

    kind = T.StructType([T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    made = annotate(docs.select("doc_id", "text"), ["text"], [("items", T.ArrayType(kind))], make, ["doc_id"])
    return made.select("row.doc_id", F.explode("res.items").alias("i")).select("doc_id", "i.*")


def pack_whole_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Per item: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone; a text of any length is cut as described above. Sequence ids
    run from 0 without gaps. Repeated rows and null ids are packed like any other row; ties in length are placed by
    (doc_id, start, checksum), and items equal in all of these are alike. An empty table gives no rows.
    """
    items = materialize(tokenize_items(docs, path, window))
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `window` rows at most
    plan, _ = plan_bins(histogram, window)
    places = docs.sparkSession.sparkContext.broadcast(np.array(sorted(plan), dtype=np.int64).reshape(-1, 6))
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    ranked = gapless_rank(items, ["length"], order, order, salts(sum(histogram.values())), "rank")

    def make(lengths: pa.Array, ranks: pa.Array) -> list[pa.Array]:
        size, lo, _, each, first, offset = places.value.T
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        at = np.searchsorted(size << 44 | lo, length << 44 | rank, side="right") - 1
        nth = rank - lo[at]
        return [pa.array(first[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * length)]

    found = annotate(ranked, ["length", "rank"], [("sequence_id", T.LongType()), ("offset", T.LongType())], make)
    return found.select(*[f"row.{c}" for c in items.columns], "res.*")
