"""Substring dedup over sliding sentence spans.

From every sentence on, the run of RUN consecutive sentences, or of as many as hold MIN_WORDS words, is hashed (96
bits). Runs are compared over the whole table, and the sentences of every occurrence but the first are removed.

A sentence ends after an end mark, at a newline, and wherever WIDTH word gaps in succession have no such end: there it
ends after the word whose hash is the least of the WIDTH. Ends so depend on WIDTH words to either side alone, and no
sentence has more than WIDTH words. A passage is cut alike wherever it stands, but for WIDTH words at its start and its
end, and a run has max(RUN * WIDTH, MIN_WORDS + WIDTH - 1) words at most: so every passage of 50 words holds a whole run.

Hashes are made of word hashes for a whole batch at once in numpy. They are written once, narrow, and read twice: to
find the runs that several documents hold, and the documents that hold them. Texts move once, to be rewritten.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import annotate, materialize, release

#: A run has so many sentences and words at least; shorter ones are common by chance.
RUN, MIN_WORDS = 3, 20
#: Word gaps in succession of which one is an end.
WIDTH = 10
#: Words that are worked on at a time; a longer text is worked on alone.
_CHUNK = 1 << 19
#: Letters of scripts without blanks between words count as words.
_WIDE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(r"\s*\S+\s*")
_ANY_WIDE, _WIDE_WORD = re.compile(f"[{_WIDE}]"), re.compile(rf"\s*(?:[{_WIDE}]|[^\s{_WIDE}]+)\s*")
_END = re.compile(r"[.!?…][\"')\]”’»]*\s+$|\n\s*$|[。！？｡][\"')\]”’」』]*\s*$")
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def words_of(text: str | None) -> list[str]:
    """The words with the white space around them; they make up the text (none: a text of white space alone)."""
    if not text:
        return []
    return (_WORD if text.isascii() or not _ANY_WIDE.search(text) else _WIDE_WORD).findall(text)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(0, n - 1), base))])[:n]


@dataclass
class Spans:
    """Sentences and runs of several texts, by their places in all words of these texts."""

    ends: np.ndarray  # after each sentence
    sentences: np.ndarray  # of each text
    text: np.ndarray  # of each run
    first: np.ndarray  # sentence of each run, and the sentence after its last
    last: np.ndarray
    h1: np.ndarray  # 64 and 32 bits of each run's hash
    h2: np.ndarray


def spans(texts: list[list[str]]) -> Spans:
    """The runs of texts, given as words."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    known: dict[str, int] = defaultdict()
    known.default_factory = known.__len__  # numbers words as they come
    at = np.array([known[w] for t in texts for w in t], dtype=np.int64)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.strip().encode("utf-8", "surrogatepass")) for w in known]), dtype="<u8").reshape(-1, 2)
    is_end = np.array([_END.search(w) is not None for w in known], dtype=bool)
    gap = np.where(is_end, np.uint64(0), digests[:, 0] | np.uint64(1))[at]
    of_text = np.cumsum(lengths)
    gap[of_text[lengths > 0] - 1] = 0
    # an end is the least of some WIDTH gaps in succession: the greatest of the least of all those around it
    around = np.concatenate([np.zeros(WIDTH - 1, dtype=np.uint64), gap, np.zeros(WIDTH - 1, dtype=np.uint64)])
    n = len(gap)
    least = around[: n + WIDTH - 1]
    for k in range(1, WIDTH):
        least = np.minimum(least, around[k : k + n + WIDTH - 1])
    greatest = least[:n]
    for k in range(1, WIDTH):
        greatest = np.maximum(greatest, least[k : k + n])
    ends = np.flatnonzero(gap == greatest) + 1
    sentences = np.searchsorted(ends, of_text, "right") - np.searchsorted(ends, of_text - lengths, "right")
    # the first sentence after which a run may end, and where its text ends
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, dtype=np.int64)
    stop = np.repeat(np.cumsum(sentences), sentences)
    number = np.arange(len(ends))
    last = np.maximum(number + RUN, np.searchsorted(ends, starts + MIN_WORDS, "left") + 1)
    text = np.repeat(np.arange(len(texts)), sentences)
    fits = last <= stop
    # the last run of a text also goes to its end
    final = np.flatnonzero(fits & (last < stop) & ~np.append(fits[1:] & (text[1:] == text[:-1]), False)) if len(ends) else number
    first, last = np.concatenate([number[fits], final]), np.concatenate([last[fits], stop[final]])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    a, b = (starts[first], ends[last - 1]) if len(ends) else (first, last)
    hashes = []
    for column, base in enumerate(_BASES):
        summed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(digests[at, column] * _powers(n, base), dtype=np.uint64)])
        hashes.append((summed[b] - summed[a]) * _powers(n, np.uint64(pow(int(base), -1, 1 << 64)))[a])
    return Spans(ends, sentences, text[first], first, last, hashes[0].view(np.int64), (hashes[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _chunks(texts: list[str | None]) -> Iterator[list[list[str]]]:
    chunk, held = [], 0
    for text in texts:
        words = words_of(text)
        if chunk and held + len(words) > _CHUNK:
            yield chunk
            chunk, held = [], 0
        chunk.append(words)
        held += len(words)
    if chunk:
        yield chunk


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_sentences, inside, h1, h2) of each row with a text; inside: a run occurs in it twice."""
    fields = [("n_sentences", T.LongType()), ("inside", T.BooleanType()), ("h1", T.ArrayType(T.LongType())), ("h2", T.ArrayType(T.IntegerType()))]

    def make(texts: pa.Array) -> list[pa.Array]:
        counts, inside, sizes, h1, h2 = [], [], [], [], []
        for chunk in _chunks(texts.to_pylist()):
            s = spans(chunk)
            order = np.lexsort((s.h2, s.h1, s.text))
            same = np.ones(max(0, len(order) - 1), dtype=bool)
            for x in (s.text, s.h1, s.h2):
                same &= x[order][1:] == x[order][:-1]
            twice = np.zeros(len(chunk), dtype=bool)
            twice[s.text[order][1:][same]] = True
            counts.append(s.sentences)
            inside.append(twice)
            sizes.append(np.bincount(s.text, minlength=len(chunk)))
            h1.append(s.h1)
            h2.append(s.h2)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32()) if sizes else pa.array([0], pa.int32())
        join = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        lists = [pa.ListArray.from_arrays(ends, join(x, t)) for x, t in ((h1, pa.int64()), (h2, pa.int32()))]
        return [join(counts, pa.int64()), join(inside, pa.bool_()), *lists]

    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return annotate(keyed, ["text"], fields, make, ["doc_id", "text_key"]).select("row.doc_id", "row.text_key", "res.*")


def _repeated(hashed: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone, firsts), written: the runs (h1, h2) of a document that an earlier one holds, and the doc_ids of the earliest."""
    place = F.struct("doc_id", "text_key").alias("place")
    runs = hashed.select(place, F.explode(F.arrays_zip("h1", "h2")).alias("r")).select("place", "r.*")
    known = runs.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("greatest")).where("first < greatest")
    # a written table: both sides of the join are then plain exchanges, whose hot partitions Spark splits, at every size
    known = materialize(known.select("h1", "h2", "first"))
    later = runs.join(known.hint("merge"), ["h1", "h2"]).where("place <> first")
    firsts = F.array_sort(F.collect_set("first.doc_id")).alias("firsts")
    gone = materialize(later.groupBy("place.doc_id", "place.text_key").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"), firsts))
    release(known)
    return gone


def dedup_sentences(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text (without the removed sentences), n_sentences, n_removed, repeats_of (sorted doc_ids).

    The first occurrence of a run is that of the smallest doc_id (a null doc_id comes first; of several texts with one
    doc_id, that of the smallest hash of the text), in it the first place. Rows are told apart by doc_id and text: rows
    equal in both are one document and are treated alike. repeats_of holds the documents of the first occurrences, the document's own id for a repeat
    inside it, and no nulls. Null texts stay null with 0 sentences; a text of white space alone has none either; a text
    may become empty. An empty table gives no rows.
    """
    hashed = materialize(_hashed(docs))
    gone = _repeated(hashed)
    each = hashed.groupBy("doc_id", "text_key").agg(F.max("n_sentences").alias("n_sentences"), F.max("inside").alias("inside"))
    found = gone.withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    each = each.join(found, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left").drop("gone_id", "gone_key")
    each = materialize(each.withColumnsRenamed({"doc_id": "at_id", "text_key": "at_key"}))
    release(hashed, gone)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    joined = keyed.join(each, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")) & F.col("text").isNotNull(), "left")
    joined = joined.select("doc_id", "text", F.coalesce("n_sentences", F.lit(0).cast("long")).alias("n_sentences"), "inside", "gone", "firsts")

    def make(texts: pa.Array, inside: pa.Array, starts: pa.Array) -> list[pa.Array]:
        kept, starts, inside = texts.to_pylist(), starts.to_pylist(), inside.to_pylist()
        removed, own = [0] * len(kept), [False] * len(kept)
        touched = iter([i for i in range(len(kept)) if starts[i] or inside[i]])
        for chunk in _chunks([kept[i] for i in range(len(kept)) if starts[i] or inside[i]]):
            s = spans(chunk)
            at, ends = np.searchsorted(s.text, np.arange(len(chunk) + 1)).tolist(), np.cumsum(s.sentences)
            base = np.concatenate([[0], np.cumsum([len(w) for w in chunk])]).tolist()
            for k, words in enumerate(chunk):
                i = next(touched)
                of = slice(int(ends[k] - s.sentences[k]), int(ends[k]))
                known = {(r["h1"], r["h2"]) for r in starts[i] or ()}
                gone, own[i] = _covered(s, slice(at[k], at[k + 1]), of, known)
                if gone.any():
                    cut = [0, *(s.ends[of] - base[k]).tolist()]
                    kept[i] = "".join(["".join(words[a:b]) for a, b, g in zip(cut, cut[1:], gone.tolist()) if not g])
                    removed[i] = int(gone.sum())
        return [pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(own, pa.bool_())]

    made = annotate(joined, ["text", "inside", "gone"], [("text", T.StringType()), ("n_removed", T.LongType()), ("own", T.BooleanType())], make, ["doc_id", "n_sentences", "firsts"])
    own = F.when(F.col("res.own"), F.array("row.doc_id")).otherwise(F.array().cast(T.ArrayType(docs.schema["doc_id"].dataType)))
    firsts = F.when(F.col("row.firsts").isNull(), own).otherwise(F.array_union("row.firsts", own))
    return made.select("row.doc_id", "res.text", "row.n_sentences", "res.n_removed", F.array_sort(F.array_compact(firsts)).alias("repeats_of"))


def _covered(s: Spans, runs: slice, sentences: slice, gone: set[tuple[int, int]]) -> tuple[np.ndarray, bool]:
    """Which of a text's sentences stand in one of its runs that is in `gone` or comes again in it; whether one comes again."""
    drop, seen, repeats = np.zeros(sentences.stop - sentences.start, dtype=bool), set(), False
    first, last = s.first[runs] - sentences.start, s.last[runs] - sentences.start
    for h1, h2, i, j in zip(s.h1[runs].tolist(), s.h2[runs].tolist(), first.tolist(), last.tolist()):
        if (h1, h2) in gone:
            drop[i:j] = True
        elif (h1, h2) in seen:
            drop[i:j] = repeats = True
        seen.add((h1, h2))
    return drop, repeats


def sentences(text: str | None) -> list[str]:
    """The text cut into sentences, which make it up (none: a text of white space alone)."""
    words = words_of(text)
    ends = spans([words]).ends.tolist()
    return ["".join(words[i:j]) for i, j in zip([0, *ends], ends)]
