"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of three hashed rows (two hashes of the word, one of its first letters). Filters of widths
1 to 3 slide over the words, each filter's maximum over the text passes a ReLU, and a logistic unit gives the score. The
classifier is fitted on the driver on a bounded sample of labelled texts; every text is scored whole on the executors, and
thresholds by language come from counts over all labelled rows that it was not fitted on.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import annotate, drop_rows, materialize, release

BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIX = 5
#: The sample that the classifier is fitted on: at most so many labelled texts and bytes.
MAX_TRAIN = 6000
MAX_TRAIN_BYTES = 32_000_000
#: Steps of the thresholds.
BINS = 1000
_CHUNK = 1 << 16
_CACHE = 60_000
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters in lower case."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def buckets(words: list[bytes]) -> np.ndarray:
    """Three rows of the hashed tables for each word."""
    whole = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    first = np.array([zlib.crc32(w[:PREFIX], 7) for w in words], dtype=np.int64)
    return np.stack([whole % BUCKETS, whole // BUCKETS, first % BUCKETS], axis=1).astype(np.uint16)


@dataclass
class Classifier:
    tables: np.ndarray  # 3 x BUCKETS x DIM
    kernels: list[np.ndarray]  # of each width: width x DIM x FILTERS
    bias: np.ndarray  # of each filter
    out: np.ndarray
    shift: float
    fitted: list = field(default_factory=list)  # ids

    def projections(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to each filter at each place of its window: len(words) x (sum of widths x FILTERS)."""
        at = buckets(words)
        x = self.tables[0][at[:, 0]] + self.tables[1][at[:, 1]] + self.tables[2][at[:, 2]]
        return x @ np.concatenate([k[o] for k in self.kernels for o in range(len(k))], axis=1)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Maximum of each filter over one stretch of word projections."""
        if len(rows) < max(WIDTHS):
            rows = np.vstack([rows, np.zeros((max(WIDTHS) - len(rows), rows.shape[1]), dtype=rows.dtype)])
        best, column = [], 0
        for width in WIDTHS:
            n, total = len(rows) - width + 1, None
            for o in range(width):
                part = rows[o : o + n, column : column + FILTERS]
                total = part if total is None else total + part
                column += FILTERS
            best.append(total.max(axis=0))
        return np.concatenate(best)

    def score(self, pooled: np.ndarray) -> float:
        z = float(np.maximum(pooled + self.bias, 0) @ self.out + self.shift)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Scorer:
    """Scores whole texts in one process; projections of words are kept in a bounded table."""

    def __init__(self, model: Classifier):
        self.model, self.at = model, {}
        self.rows = np.zeros((0, sum(WIDTHS) * FILTERS), dtype=np.float32)
        self.used = 0

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > _CACHE:
            self.at.clear()
            self.used = 0
        known = self.at
        missing = [w for w in dict.fromkeys(words) if w not in known]
        if missing:
            end = self.used + len(missing)
            if end > len(self.rows):
                grown = np.zeros((max(end, 2 * len(self.rows), 4096), self.rows.shape[1]), dtype=np.float32)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : end] = self.model.projections(missing)
            known.update(zip(missing, range(self.used, end)))
            self.used = end
        return np.array([known[w] for w in words], dtype=np.int64)

    def score(self, text: str | None) -> float:
        words, best = words_of(text), None
        for i in range(0, max(1, len(words)), _CHUNK):
            part = words[i : i + _CHUNK + max(WIDTHS) - 1]  # the next words that a window from here reaches
            if i and len(part) < max(WIDTHS):
                continue  # the stretch before has reached them
            at = self.places(part)  # may replace self.rows
            pooled = self.model.pooled(self.rows[at])
            best = pooled if best is None else np.maximum(best, pooled)
        return self.model.score(best)


def fit(texts: list[str], labels: list[int], epochs: int | None = None, rate: float = 0.08, drop: float = 0.3, seed: int = 3) -> Classifier:
    """Fit by AdaGrad, one text a step; only the words that give a filter its maximum move.

    A share `drop` of a text's words is left out at each step, so that no single word explains a text.
    """
    rng = np.random.default_rng(seed)
    span = sum(WIDTHS)
    tables = rng.normal(0, 0.05, (3, BUCKETS, DIM))
    kernels = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS]
    n_out = FILTERS * len(WIDTHS)
    bias, out = np.zeros(n_out), rng.normal(0, 0.3, n_out)
    share = min(max(float(np.mean(labels)), 0.01), 0.99)
    shift = float(np.log(share / (1 - share)))
    s_tables, s_kernels = np.full((3, BUCKETS, DIM), 1e-3), [np.full(k.shape, 1e-3) for k in kernels]
    s_bias, s_out, s_shift = np.full(n_out, 1e-3), np.full(n_out, 1e-3), 1e-3
    docs = [buckets(w) if (w := words_of(t)) else np.zeros((0, 3), dtype=np.uint16) for t in texts]
    for _ in range(epochs or min(30, max(6, 20_000 // max(1, len(docs))))):
        for d in rng.permutation(len(docs)):
            at = docs[d]
            if len(at):
                at = at[rng.random(len(at)) >= drop] if len(at) > 20 else at
            x = np.zeros((max(len(at), max(WIDTHS)), DIM))
            if len(at):
                x[: len(at)] = tables[0][at[:, 0]] + tables[1][at[:, 1]] + tables[2][at[:, 2]]
            best, pooled = [], np.empty(n_out)
            for i, (w, k) in enumerate(zip(WIDTHS, kernels)):
                n = len(x) - w + 1
                z = sum(x[o : o + n] @ k[o] for o in range(w))
                top = z.argmax(axis=0)
                best.append(top)
                pooled[i * FILTERS : (i + 1) * FILTERS] = z[top, np.arange(FILTERS)]
            hidden = np.maximum(pooled + bias, 0)
            g = 1 / (1 + np.exp(-np.clip(hidden @ out + shift, -30, 30))) - labels[d]
            if abs(g) < 1e-3:
                continue
            g_hidden = g * out * (hidden > 0)
            g_out = g * hidden + 1e-4 * out
            s_out += g_out**2
            out -= rate * g_out / np.sqrt(s_out)
            s_shift += g * g
            shift -= rate * g / np.sqrt(s_shift)
            s_bias += g_hidden**2
            bias -= rate * g_hidden / np.sqrt(s_bias)
            moved, steps = [], []
            for i, (w, k) in enumerate(zip(WIDTHS, kernels)):
                gh = g_hidden[i * FILTERS : (i + 1) * FILTERS]
                if not gh.any():
                    continue
                for o in range(w):
                    rows = best[i] + o
                    moved.append(rows)
                    steps.append(gh[:, None] * k[o].T)
                    gk = (x[rows] * gh[:, None]).T
                    s_kernels[i][o] += gk**2
                    k[o] -= rate * gk / np.sqrt(s_kernels[i][o])
            if moved and len(at):
                rows, step = np.concatenate(moved), np.concatenate(steps)
                inside = rows < len(at)
                rows, step = rows[inside], step[inside]
                for t in range(3):
                    places, inverse = np.unique(at[rows, t], return_inverse=True)
                    total = np.zeros((len(places), DIM))
                    np.add.at(total, inverse, step)
                    s_tables[t][places] += total**2
                    tables[t][places] -= rate * total / np.sqrt(s_tables[t][places])
    return Classifier(tables.astype(np.float32), [k.astype(np.float32) for k in kernels], bias, out, shift)


def held_out(doc_id: Column) -> Column:
    """True for the fold that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row for each labelled document outside the held-out fold; of several labels the toxic one counts."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Classifier | None:
    """Fit on a bounded sample of labelled documents outside the held-out fold. None: no labels there.

    Four fifths of these documents, by a hash of doc_id, may be fitted on; the sample is the first `max_train` of them by
    that hash, and of those the shortest that make up `max_bytes` of text. The model knows which ids it was fitted on.
    Only ids and lengths are looked at to choose; a text above the bound costs no other text its place.
    """
    at = F.xxhash64("doc_id")
    marked = _known(labels).where(F.pmod(at, F.lit(5)) != 4).withColumn("at", at)
    chosen = marked.orderBy("at", "doc_id").limit(max_train)
    text_key, n_bytes = F.xxhash64("text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    sized = docs.select("doc_id", text_key, n_bytes).distinct().join(F.broadcast(chosen), "doc_id").orderBy("at", "doc_id", "text_key").limit(max_train)
    so_far = F.sum("n_bytes").over(Window.orderBy("n_bytes", "at", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sized.withColumn("sum", so_far).where(F.col("sum") <= max_bytes).select("doc_id", "text_key", "toxic", "at")
    keys = docs.sparkSession.createDataFrame(fitting.collect(), fitting.schema)  # max_train rows at most
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key).join(F.broadcast(keys), ["doc_id", "text_key"])
    rows = found.dropDuplicates(["doc_id", "text_key"]).orderBy("at", "doc_id", "text_key").collect()  # max_bytes at most
    if not rows:
        return None
    model = fit([r.text for r in rows], [r.toxic for r in rows])
    model.fitted = sorted({r.doc_id for r in rows})
    return model


def calibrate(scored: DataFrame, labels: DataFrame, model: Classifier | None, least: int = 8) -> dict[str, float]:
    """Per language the threshold of the best F1, from all labelled rows of `scored` (doc_id, lang, score) outside the
    held-out fold that the model was not fitted on. Ties: nearest to 0.5; fewer than `least` toxic ones: that of all languages ("").
    """
    if model is None:
        return {}
    used = scored.sparkSession.createDataFrame([(i,) for i in model.fitted], scored.select("doc_id").schema)
    known = _known(labels).join(F.broadcast(used), "doc_id", "left_anti")  # max_train ids at most
    rows = scored.join(known, "doc_id").select("lang", F.floor(F.col("score") * BINS).cast("int").alias("bin"), "toxic")
    counts = rows.groupBy("lang", "bin").agg(F.sum("toxic").alias("hit"), F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("bin").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).select(F.lit("").alias("lang"), "bin", "hit", "n")
    counts = common.unionByName(counts.where(F.col("lang").isNotNull() & (F.col("lang") != "")))
    above = Window.partitionBy("lang").orderBy(F.desc("bin"))  # BINS rows of a language at most
    whole = Window.partitionBy("lang")
    f1 = 2 * F.sum("hit").over(above) / (F.sum("n").over(above) + F.sum("hit").over(whole))
    rated = counts.select("lang", "bin", f1.alias("f1"), F.sum("hit").over(whole).alias("toxic")).where(F.col("toxic") >= least)
    best = rated.groupBy("lang").agg(F.max_by("bin", F.struct("f1", -F.abs(F.col("bin") - BINS / 2), "bin")).alias("bin"))
    return {r.lang: r.bin / BINS for r in best.collect()}


def score_documents(docs: DataFrame, model: Classifier | None, keep: list[str] | None = None) -> DataFrame:
    """Structs `row` (docs, or the columns in `keep`) and `res` (score, 0 to 1; empty texts get the score of no words). Without a model: 0."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    scorers: dict = {}

    def make(texts: pa.Array) -> list[pa.Array]:
        if shipped.value is None:
            return [pa.array([0.0] * len(texts), pa.float64())]
        scorer = scorers.get("own") or scorers.setdefault("own", Scorer(shipped.value))
        return [pa.array([scorer.score(t) for t in texts.to_pylist()], pa.float64())]

    return annotate(docs, ["text"], [("score", T.DoubleType())], make, keep)


def threshold(thresholds: dict[str, float], lang: Column) -> Column:
    """The threshold of a row's language."""
    common = F.lit(thresholds.get("", 0.5))
    pairs = [F.lit(x) for name, t in sorted(thresholds.items()) for x in (name, t) if name]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lang), common) if pairs else common


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5) and rejected (score >= its language's threshold).

    Null and empty texts are scored as having no words; a null doc_id is never held out; repeated rows are scored each;
    without any label outside the held-out fold all scores are 0; an empty table gives no rows. Without a table of its
    language, or with too few toxic texts in it, a row is held against the threshold of all languages, or 0.5.
    """
    model = train(docs, labels)
    scored = materialize(score_documents(docs.select("doc_id", "text", "lang"), model, ["doc_id", "lang"]).select("row.*", "res.score"))
    limit = threshold(calibrate(scored, labels, model), F.col("lang"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("rejected")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold of their language, with their columns.

    Null, empty and repeated rows are scored as classify() does; without labels nothing is dropped.
    """
    model, key = train(docs, labels), F.xxhash64("text", "lang")
    keyed = docs.select("doc_id", "text", "lang", key.alias("at_key"))
    scored = materialize(score_documents(keyed, model, ["doc_id", "lang", "at_key"]).select("row.*", "res.score"))
    limit = threshold(calibrate(scored, labels, model), F.col("lang"))
    gone = materialize(scored.where(F.col("score") >= limit).select(F.col("doc_id").alias("at_id"), "at_key").distinct())
    release(scored)
    return drop_rows(docs, gone, key)
