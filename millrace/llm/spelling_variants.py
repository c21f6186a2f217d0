"""Spelling variant grouping by a dictionary of trie-node pairs.

The nodes of the trie of all words and of the trie of all reversed words are numbered. A word of L letters passes the
nodes of its prefixes and of its suffixes, so what stands before and after a place in it is a pair of two integers. Two
words that differ in one replaced letter have the same pair around it (both skip a letter there); a word with one letter
more has, around that letter, the pair that the shorter word has between two letters (one skips, the other splits). So an
equi-join on the pairs gives exactly the words at one edit, each once: a letter that repeats the one before it is not
skipped for an insertion, as skipping the first one of its run gives the same word.

Tries are numbered range by range over sorted words. Where a range begins inside a branch of the range before, the
numbers of its first word's nodes are replaced by those of that branch; the driver sees the first and the last word of
each range. The words at a pair are one without a letter there and at most one for each letter, 90 in all, so a pair's
words are put into one row. No pair of words is written: a word learns from each of its pairs how many near words there
are and which of them is the most frequent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm._common import SLICE, annotate, materialize, raw_texts, release

LEAST_LETTERS, LEAST_TIMES, RATIO = 7, 2, 10
#: One in so many (document, word) loses a letter.
DAMAGED = 31
#: Words that a task counts before it gives the counts away.
_COUNTED = 200_000
_RANGE = 40  # bits of a node's or word's number inside its range
SKIP, SKIP_FIRST, SPLIT = range(3)  # a letter skipped; one that differs from the letter before it; none skipped


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n), written: runs of letters of at least LEAST_LETTERS, one in DAMAGED without a letter, that occur LEAST_TIMES.

    A null text has no words; a null doc_id is an empty one in the checksum that picks the letter.
    """
    runs = re.compile("[a-zA-ZÀ-ÿ]{%d,}" % LEAST_LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        given = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for doc_id, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                    if raw is None:
                        continue
                    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(runs.findall(raw.lower().decode())).items():
                        h = zlib.crc32(word.encode(), before)
                        if h % DAMAGED == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LETTERS:
                                continue
                        counts[word] += n
                    if len(counts) > _COUNTED:
                        yield given()
                        counts.clear()
        yield given()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.where(F.col("n") >= LEAST_TIMES))


def number_nodes(words: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
    """(words with `place` and `nodes`, written; numbers to be replaced): nodes of the trie of the distinct texts in `key`.

    nodes[d] is the node of the first d letters, `place` grows in the order of the texts.
    """
    fields = [T.StructField("place", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType()))]
    schema = T.StructType([*words.schema.fields, *fields])
    arrow = to_arrow_schema(schema)
    at, n_columns = words.columns.index(key), len(words.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path, made, row, base = "", [], 0, 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                if base is None:
                    base = part.column(n_columns)[0].as_py() << _RANGE
                    path, made = [base], base + 1
                flat, offsets = [], [0]
                for text in part.column(at).to_pylist():
                    common, most = 0, min(len(text), len(last))
                    while common < most and text[common] == last[common]:
                        common += 1
                    new = len(text) - common
                    path[common + 1 :] = range(made, made + new)
                    made += new
                    flat += path
                    offsets.append(len(flat))
                    last = text
                places = pa.array(np.arange(base + row, base + row + part.num_rows, dtype=np.int64))
                row += part.num_rows
                nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], places, nodes], schema=arrow)

    ranged = words.repartitionByRange(key).sortWithinPartitions(key).withColumn("_range", F.spark_partition_id().cast("long"))
    numbered = materialize(ranged.mapInArrow(run, schema))
    of = F.shiftright("place", _RANGE).alias("range")
    ends = numbered.groupBy(of).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("nodes", key).alias("path"))
    replaced: dict[int, int] = {}
    before = None
    for r in sorted(ends.collect()):  # a row for each range
        if before:
            for d, (x, y) in enumerate(zip(before["last"] + "\0", r["first"] + "\1")):
                replaced[(r["range"] << _RANGE) + d] = replaced.get(before["path"][d], before["path"][d])
                if x != y:
                    break
        before = r
    return numbered, replaced


def node_pairs(vocabulary: DataFrame, prefixes: dict[int, int], suffixes: dict[int, int]) -> DataFrame:
    """(a, b, kind, place, n): the pairs of nodes of each word, `heads` of its prefixes and `nodes` of its suffixes."""
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "kind" else T.LongType()) for c in ("a", "b", "kind", "place", "n")])
    shared = vocabulary.sparkSession.sparkContext.broadcast((prefixes, suffixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.array(sorted(m), dtype=np.int64), np.array([m[k] for k in sorted(m)], dtype=np.int64)) for m in shared.value]

        def real(nodes: np.ndarray, which: int) -> np.ndarray:
            old, new = known[which]
            if not len(old):
                return nodes
            i = np.minimum(np.searchsorted(old, nodes), len(old) - 1)
            return np.where(old[i] == nodes, new[i], nodes)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                words, places, counts, heads, tails = batch.slice(start, SLICE).columns
                pieces = []
                for word, place, n, head, tail in zip(words.to_pylist(), places.to_pylist(), counts.to_pylist(), heads, tails):
                    size = len(word)
                    head, tail = head.values.to_numpy(), tail.values.to_numpy()[::-1]  # tail[i]: what follows the first i letters
                    letters = np.frombuffer(word.encode("utf-32-le"), dtype="<u4")
                    kind = np.full(2 * size + 1, SPLIT, dtype=np.int32)
                    kind[:size] = SKIP_FIRST
                    kind[1:size][letters[1:] == letters[:-1]] = SKIP
                    pieces.append((np.concatenate([head[:-1], head]), np.concatenate([tail[1:], tail]), kind, np.full(2 * size + 1, place), np.full(2 * size + 1, n)))
                a, b, kind, place, n = (np.concatenate(x) for x in zip(*pieces))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (real(a, 0), real(b, 1), kind, place, n)], names=schema.names)

    return vocabulary.select("word", "at", "n", "heads", "nodes").mapInArrow(run, schema)


def near_words(pairs: DataFrame) -> DataFrame:
    """(place, n_near, best (n, order)): how many words are near, and the most frequent one; order is its place, negative."""
    word = F.struct("n", (-F.col("place")).alias("order"), "kind")
    groups = pairs.groupBy("a", "b").agg(F.sort_array(F.collect_list(word), asc=False).alias("words")).where(F.size("words") > 1)

    def near(x: Column, y: Column) -> Column:
        both_skip = (x["kind"] != SPLIT) & (y["kind"] != SPLIT) & (x["order"] != y["order"])
        return both_skip | ((x["kind"] == SPLIT) & (y["kind"] == SKIP_FIRST)) | ((x["kind"] == SKIP_FIRST) & (y["kind"] == SPLIT))

    # the words stand by falling frequency, so the first near one is the best
    def learn(x: Column) -> Column:
        others = F.filter("words", lambda y: near(x, y))
        return F.struct((-x["order"]).alias("place"), F.size(others).alias("n_near"), F.get(others, F.lit(0)).alias("best"))

    learnt = groups.select(F.explode(F.transform("words", learn)).alias("w")).select("w.*").where("n_near > 0")
    best = F.struct(F.col("best.n").alias("n"), F.col("best.order").alias("order"))
    return learnt.groupBy("place").agg(F.sum("n_near").alias("n_near"), F.max(best).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(place, root): the last word of the chain of forms that starts at each place of links (place, form).

    A form is RATIO times as frequent, so chains have as many steps as the largest count has digits; each round doubles
    the steps taken.
    """
    now = materialize(links.select("place", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("place").alias("at"), F.col("root").alias("next")).hint("merge")
        moved = materialize(now.join(further, F.col("root") == F.col("at"), "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(now)
        now = moved
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def group_spellings(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are those of count_words. Near words are one inserted, deleted or replaced code point apart; a word's form is
    its most frequent near word, of equal ones the least in code-point order, if it occurs RATIO times as often, else
    null; its root is where forms lead. Repeated rows count each; null and empty texts give nothing, an empty table no
    rows; words may be of any length.
    """
    words = count_words(docs)
    forward, prefixes = number_nodes(words, "word")
    tails = forward.select("word", F.col("place").alias("at"), "n", F.col("nodes").alias("heads"), F.reverse("word").alias("reversed"))
    backward, suffixes = number_nodes(tails, "reversed")
    near = materialize(near_words(node_pairs(backward, prefixes, suffixes)))
    release(words, backward)
    vocabulary = materialize(forward.select("place", "word", "n"))
    release(forward)
    # written tables: both sides of the joins are then plain exchanges, whose hot partitions Spark splits
    known = vocabulary.join(near.hint("merge"), "place", "left")
    chosen = F.col("best.n") >= RATIO * F.col("n")
    known = materialize(known.select("place", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, -F.col("best.order")).alias("form"), F.when(chosen, F.col("best.n")).alias("form_n")))
    release(near)
    linked = known.where(F.col("form").isNotNull())
    ends = roots(linked.select("place", "form"))
    name = lambda c: vocabulary.select(F.col("place").alias(f"{c}_at"), F.col("word").alias(f"{c}_word")).hint("merge")
    named = linked.select("place", "form").join(name("form"), F.col("form") == F.col("form_at")).join(ends.hint("merge"), "place")
    named = materialize(named.join(name("root"), F.col("root") == F.col("root_at")).select("place", "form_word", "root_word"))
    out = known.join(named.hint("merge"), "place", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
