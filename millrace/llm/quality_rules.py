"""Quality rules as a bitmask ledger.

Measurements are taken once per document, and every rule is evaluated once into one bit of `failed`. Policies are
versioned sets of rules (a mask); applying one, or finding what each of its rules does alone, is bitwise arithmetic on
the ledger and never reads a text again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import annotate, raw_texts

REPEAT_WINDOW = 5
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters"]


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where `fails`, a SQL condition on the measurements, holds. Its bit never changes."""

    bit: int
    name: str
    fails: str


RULES = [
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "mean_word_short", "word_chars < 2 * n_words"),
    Rule(3, "mean_word_long", "word_chars > 14 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "too_many_words", "n_words > 100000"),
    Rule(7, "stutters", "5 * n_stutters > n_words"),
]
#: Policies by version; a version keeps its rules for good.
POLICIES = {
    1: ["too_few_words", "repeated_words"],
    2: ["too_few_words", "repeated_words", "mean_word_short", "mean_word_long", "symbols", "duplicate_lines", "too_many_words", "stutters"],
}
BASE, CURRENT = 1, 2


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the list, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    code = ids
    for size in range(2, window + 1):  # windows of `size` words get equal codes if and only if they are equal
        code = code[: n - size + 1] * len(known) + ids[size - 1 :]
        code = np.unique(code, return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(raw: bytes | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    if not raw:
        return (0,) * len(MEASURES)
    words = raw.split()  # bytes split exactly at blank, tab, newline, vertical tab, form feed and return
    joined = b"".join(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined.decode("utf-8", "surrogateescape")),
        len(_SYMBOLS.findall(raw)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(eq, words, words[1:])),
    )


def _mask(names: list[str]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the measurements and `failed`, a bit for each rule that the document fails.

    A null text is measured as empty and fails `too_few_words`. Repeated rows get a ledger row each; an empty table gives an
    empty ledger.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        rows = np.array([measure(r) for r in raw_texts(texts)], dtype=np.int64).reshape(-1, len(MEASURES))
        return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(MEASURES))]

    made = annotate(docs.select("doc_id", "text"), ["text"], [(m, T.LongType()) for m in MEASURES], make, ["doc_id"]).select("row.doc_id", "res.*")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES])
    return made.withColumn("failed", bits)


def fails(version: int, failed: str = "failed") -> Column:
    """True where a document fails any rule of a policy version."""
    return F.col(failed).bitwiseAND(F.lit(_mask(POLICIES[version]))) != 0


def ablation(ledger_rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    mask = _mask(POLICIES[version])
    patterns = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[version]]
    counts = patterns.agg(
        *[F.coalesce(F.sum(F.when(F.col("pattern").bitwiseAND(F.lit(1 << r.bit)) != 0, F.col("n"))), F.lit(0)).alias(f"f{r.bit}") for r in rules],
        *[F.coalesce(F.sum(F.when(F.col("pattern") == (1 << r.bit), F.col("n"))), F.lit(0)).alias(f"a{r.bit}") for r in rules],
        F.coalesce(F.sum(F.when(F.col("pattern") == 0, F.col("n"))), F.lit(0)).alias("kept"),
    )
    row = lambda r: F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"a{r.bit}").alias("n_failed_alone"), (F.col("kept") + F.col(f"a{r.bit}")).alias("n_kept_without"))
    return counts.select(F.explode(F.array(*[row(r) for r in rules])).alias("x")).select("x.*")
