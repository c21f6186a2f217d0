"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each Spark task numbers the words of its documents shard by shard and sorts all suffixes of a shard by their first words
(prefix doubling, up to the words of a window), whatever the benchmark holds. Every suffix of every benchmark item is then looked up by binary search,
which gives all places where its next `window` words occur verbatim; places that follow each other on one diagonal join
into the longest matches. A benchmark of one block is shipped to the tasks and looked up as the arrays are made. For a
larger one the arrays are written once and read again for each block; the documents themselves are not written or
shuffled before the matches, which are narrow, are joined to them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import annotate, doc_key, drop_rows, materialize, raw_texts, release

#: Bytes kept as word characters: digits, letters in lower case, and all of non-ASCII UTF-8.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Bound of one shipped benchmark block, in characters of item text; a longer item is a block of its own.
BLOCK_CHARS = 8_000_000
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 18

MATCH = T.StructType(
    [T.StructField("item_id", T.StringType()), T.StructField("item_pos", T.LongType()), T.StructField("doc_pos", T.LongType()), T.StructField("n_words", T.LongType())]
)


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at every ASCII character that is no letter or digit."""
    return raw.translate(_FOLD).split() if raw else []


@dataclass
class Probe:
    """The suffixes of one block of benchmark items, ready to be looked up."""

    vocabulary: list[bytes]
    item_ids: list[str]
    item: np.ndarray  # of each test suffix
    item_pos: np.ndarray
    length: np.ndarray  # words that must agree
    words: np.ndarray  # its first words, as places in the vocabulary


def make_probe(items: list[tuple[str, bytes]], window: int) -> Probe:
    """Index a block of items; those without words are left out."""
    vocabulary: dict[bytes, int] = {}
    ids, item, pos, length, rows = [], [], [], [], []
    for item_id, raw in items:
        w = [vocabulary.setdefault(x, len(vocabulary)) for x in words_of(raw)]
        if not w:
            continue
        ids.append(item_id)
        need = min(window, len(w))
        for i in range(len(w) - need + 1):
            item.append(len(ids) - 1)
            pos.append(i)
            length.append(need)
            rows.append(w[i : i + need] + [0] * (window - need))
    return Probe(list(vocabulary), ids, np.array(item, dtype=np.int64), np.array(pos, dtype=np.int64), np.array(length, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(-1, window))


def suffix_array(stream: np.ndarray, depth: int) -> np.ndarray:
    """Places of the stream in the order of the words that start there, by `depth` words at least; nothing is before a word.

    As many words as fit into a key are sorted at first, twice as many with each further sort.
    """
    n = len(stream)
    bits = (int(stream.max(initial=0)) + 1).bit_length()
    width = max(1, min(depth, 63 // bits))
    keys = np.zeros(n, dtype=np.int64)
    for k in range(width):
        keys <<= bits
        keys[: max(0, n - k)] += stream[k:] + 1
    while True:
        order = np.argsort(keys)
        keys = keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        if width >= depth or first.all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(first)
        keys = rank * (n + 1)
        keys[: max(0, n - width)] += rank[width:]
        width *= 2


@dataclass
class Shard:
    """Documents as numbered words, 0 standing between them, with their suffix array."""

    vocabulary: dict[bytes, int]
    starts: np.ndarray  # of each document in the stream
    stream: np.ndarray
    suffixes: np.ndarray

    def bisect(self, words: np.ndarray, length: np.ndarray, low: np.ndarray, beyond: bool) -> np.ndarray:
        """For each row of words the first place of the array, from `low` on, that is not before it (beyond: that is after it)."""
        low, high = low.copy(), np.full(len(words), len(self.suffixes))
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            before = self.compare(words[open_], length[open_], middle)
            down = before <= 0 if beyond else before < 0
            low[open_] = np.where(down, middle + 1, low[open_])
            high[open_] = np.where(down, high[open_], middle)
        return low

    def compare(self, words: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at each place of the array is before the row, agrees with it, or is after it."""
        at, sign, same = self.suffixes[places], np.zeros(len(words), dtype=np.int64), np.arange(len(words))
        for k in range(words.shape[1]):
            same = same[length[same] > k]
            if not len(same):
                break
            where = at[same] + k
            step = np.where(where < len(self.stream), self.stream[np.minimum(where, len(self.stream) - 1)], -1) - words[same, k]
            sign[same] = np.sign(step)
            same = same[step == 0]
        return sign

    def search(self, probe: Probe) -> list[list[tuple[str, int, int, int]]]:
        """For each document its maximal matches (item_id, item_pos, doc_pos, n_words)."""
        out: list[list] = [[] for _ in self.starts]
        known = np.array([self.vocabulary.get(w, -1) for w in probe.vocabulary], dtype=np.int64)
        if not len(known) or not len(self.suffixes):
            return out
        words = known[probe.words]
        absent = (words < 0) & (np.arange(words.shape[1]) < probe.length[:, None])
        tests = np.flatnonzero(~absent.any(axis=1))
        left = self.bisect(words[tests], probe.length[tests], np.zeros(len(tests), dtype=np.int64), beyond=False)
        there = left < len(self.suffixes)
        tests, left = tests[there], left[there]
        agree = self.compare(words[tests], probe.length[tests], left) == 0
        tests, left = tests[agree], left[agree]
        times = self.bisect(words[tests], probe.length[tests], left, beyond=True) - left
        if not len(tests):
            return out
        test = np.repeat(tests, times)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = self.suffixes[np.repeat(left, times) + inside]
        doc = np.searchsorted(self.starts, place, "right") - 1
        made = _longest(doc, probe.item[test], probe.item_pos[test], place - self.starts[doc], probe.length[test])
        for d, i, ip, dp, n in zip(*(x.tolist() for x in made)):
            out[d].append((probe.item_ids[i], ip, dp, n))
        return out


def _longest(doc, item, item_pos, doc_pos, length):
    """Join occurrences that follow each other on one diagonal of a document and an item into maximal matches."""
    diagonal = doc_pos - item_pos
    order = np.lexsort((doc_pos, diagonal, item, doc))
    doc, item, item_pos, doc_pos, length, diagonal = (x[order] for x in (doc, item, item_pos, doc_pos, length, diagonal))
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (doc_pos[1:] != doc_pos[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], item[at], item_pos[at], doc_pos[at], doc_pos[last] + length[last] - doc_pos[at]


def shards(texts: list[bytes | None], depth: int) -> Iterator[tuple[Shard, list[int]]]:
    """Shards of up to SHARD_WORDS words of these texts in order, with the words of each of their texts."""

    def made() -> tuple[Shard, list[int]]:
        stream = np.concatenate([np.append(x, 0) for x in held])
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])[:-1]]).astype(np.int64)
        return Shard(dict(numbers), starts, stream, suffix_array(stream, depth)), [len(x) for x in held]

    held, size = [], 0
    for raw in texts:
        w = words_of(raw)
        if held and size + len(w) > SHARD_WORDS:
            yield made()
            held, size = [], 0
        if not held:
            numbers = defaultdict()
            numbers.default_factory = lambda known=numbers: len(known) + 1
        held.append(np.array([numbers[x] for x in w], dtype=np.int64))
        size += len(w)
    if held:
        yield made()


def _scan(probe: Probe, window: int):
    def make(texts: pa.Array) -> list[pa.Array]:
        counts, matches = [], []
        for shard, n_words in shards(raw_texts(texts), window):
            counts += n_words
            matches += shard.search(probe)
        rows = [[dict(zip(("item_id", "item_pos", "doc_pos", "n_words"), x)) for x in found] for found in matches]
        return [pa.array(counts, pa.int64()), pa.array(rows, _MATCHES)]

    return make


_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("n_words", pa.int64())]))


def _written_shards(docs: DataFrame, window: int) -> DataFrame:
    """One row per shard: its documents (doc_id, text_key, n_words), vocabulary, and stream and suffix array as 32-bit numbers."""
    keyed = docs.select(F.struct(*doc_key()).alias("key"), "text")
    key = keyed.schema["key"].dataType
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(key)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("vocabulary", T.ArrayType(T.BinaryType())),
        T.StructField("stream", T.BinaryType()), T.StructField("suffixes", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for shard, lengths in shards(raw_texts(batch.column(1)), window):
                keys = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), batch.column(0).slice(at, len(lengths)))
                at += len(lengths)
                numbers = [x.astype("<i4").tobytes() for x in (shard.stream, shard.suffixes)]
                columns = [keys, pa.array([lengths], pa.list_(pa.int64())), pa.array([list(shard.vocabulary)], pa.list_(pa.binary())), pa.array(numbers[:1], pa.binary()), pa.array(numbers[1:], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keyed.mapInArrow(run, schema)


def _look_up(arrays: DataFrame, probe: Probe) -> DataFrame:
    """(key, match) of one block in written shards."""
    schema = T.StructType([T.StructField("key", arrays.schema["keys"].dataType.elementType), T.StructField("match", MATCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, lengths, vocabulary, stream, suffixes = (batch.column(k)[i] for k in range(5))
                lengths = lengths.as_py()
                starts = np.concatenate([[0], np.cumsum([n + 1 for n in lengths])[:-1]]).astype(np.int64)
                numbers = [np.frombuffer(x.as_py(), dtype="<i4").astype(np.int64) for x in (stream, suffixes)]
                found = Shard({w: j + 1 for j, w in enumerate(vocabulary.as_py())}, starts, *numbers).search(probe)
                of = [d for d, x in enumerate(found) for _ in x]
                rows = [dict(zip(("item_id", "item_pos", "doc_pos", "n_words"), x)) for matches in found for x in matches]
                yield pa.RecordBatch.from_arrays([keys.values.take(pa.array(of, pa.int64())), pa.array(rows, _MATCHES.value_type)], names=["key", "match"])

    return arrays.mapInArrow(run, schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Longest verbatim matches of benchmark items in documents, at least `window` words long (a shorter item: all of it).

    Returns the struct `row` (docs as they are, or the columns in `keep`) and the struct `res`: n_words, n_hit (words inside matches), items
    (ids of items that match, sorted as strings) and matches (item_id, item_pos, doc_pos, n_words; positions in words).
    Null and empty texts have no words and no matches. Items without words or with a null id are left out; items with
    equal texts all match; repeated rows of docs each get their own result; an empty benchmark matches nothing.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    blocks = _blocks(items)
    probe = lambda k: make_probe([(r.item_id, r.text.encode()) for r in items.join(F.broadcast(blocks[k]), ["item_id"]).collect()] if blocks else [], window)
    if len(blocks) <= 1:
        fields = [("n_words", T.LongType()), ("matches", T.ArrayType(MATCH))]
        found = annotate(docs, ["text"], fields, _scan(probe(0), window), keep)
    else:
        arrays = materialize(_written_shards(docs, window))
        parts = [materialize(_look_up(arrays, probe(k))) for k in range(len(blocks))]
        each = arrays.select(F.explode(F.arrays_zip("keys", "lengths")).alias("d")).select(F.col("d.keys").alias("key"), F.col("d.lengths").alias("n_words")).distinct()
        matches = parts[0]
        for part in parts[1:]:
            matches = matches.union(part)
        matches = matches.distinct().groupBy("key").agg(F.array_sort(F.collect_list("match")).alias("matches")).withColumnRenamed("key", "found")
        each = materialize(each.join(matches, F.col("key").eqNullSafe(F.col("found")), "left").select(F.col("key").alias("found"), "n_words", "matches"))
        release(arrays, *parts)
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.struct(*doc_key()).alias("key"))
        joined = packed.join(each, F.col("key.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.col("key.text_key") == F.col("found.text_key")), "left")
        found = joined.select("row", F.struct("n_words", F.coalesce("matches", F.array().cast(T.ArrayType(MATCH))).alias("matches")).alias("res"))
    spans = F.array_sort(F.transform("res.matches", lambda m: F.struct(m["doc_pos"].alias("start"), (m["doc_pos"] + m["n_words"]).alias("stop"))))
    nothing = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate(spans, nothing, lambda a, x: F.struct(F.greatest(a["stop"], x["stop"]).alias("stop"), (a["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["stop"], x["start"]))).alias("hit")))
    names = F.array_sort(F.array_distinct(F.transform("res.matches", lambda m: m["item_id"])))
    return found.select("row", F.struct("res.n_words", covered["hit"].alias("n_hit"), names.alias("items"), "res.matches").alias("res"))


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Ids of the items of each block: blocks of about BLOCK_CHARS characters. Of the items the driver sees counts alone."""
    sized = items.groupBy("item_id").agg(F.sum(F.length("text").cast("long")).alias("n"))
    total = sized.agg(F.sum("n").alias("n")).first().n
    if total is None:
        return []
    if total <= BLOCK_CHARS:
        return [sized.select("item_id")]
    n_blocks = -(-total * 2 // BLOCK_CHARS)  # half full on average, so that hardly one is over
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    large = F.col("n") * 4 > BLOCK_CHARS
    few = [sized.where(~large & (block == k)).select("item_id") for k in range(n_blocks)]
    return few + [sized.where(F.col("item_id") == r.item_id).select("item_id") for r in sized.where(large).select("item_id").collect()]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents that hold no benchmark window, with their columns. Nulls, ties and repeats: as find_matches()."""
    key = F.xxhash64("text")
    found = find_matches(docs.select("doc_id", "text", key.alias("at_key")), benchmark, window, ["doc_id", "at_key"])
    gone = found.where(F.col("res.n_hit") > 0).select(F.col("row.doc_id").alias("at_id"), "row.at_key").distinct()
    return drop_rows(docs, materialize(gone), key)
