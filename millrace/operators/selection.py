"""Rows by their place in an order, without sorting the table or bringing a prefix of it into one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Keys that the driver sees in a round, and rows that one task may sort in the end.
SAMPLE, SORTED = 4_000, 50_000


@dataclass(frozen=True)
class Order:
    """A sort key: a column's name or an expression. Nulls come last, or with nulls_last=False first."""

    value: str | Column
    descending: bool = False
    nulls_last: bool = True

    @property
    def column(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value

    @property
    def sorted(self) -> Column:
        if self.descending:
            return self.column.desc_nulls_last() if self.nulls_last else self.column.desc_nulls_first()
        return self.column.asc_nulls_last() if self.nulls_last else self.column.asc_nulls_first()

    def before(self, value) -> Column:
        """Whether a row comes strictly before `value` by this key alone."""
        c = self.column
        if value is None:
            return c.isNotNull() if self.nulls_last else F.lit(False)
        inside = F.coalesce(c > F.lit(value) if self.descending else c < F.lit(value), F.lit(False))
        return inside if self.nulls_last else inside | c.isNull()


def orders(keys: list) -> list[Order]:
    """Names are ascending keys, nulls first, as in orderBy."""
    return [k if isinstance(k, Order) else Order(k, nulls_last=False) for k in keys]


def before(keys: list[Order], pivot: Row) -> Column:
    """Whether a row comes strictly before the pivot."""
    out = F.lit(False)
    for k, value in reversed(list(zip(keys, pivot))):
        out = k.before(value) | (k.column.eqNullSafe(F.lit(value)) & out)
    return out


def at(keys: list[Order], pivot: Row) -> Column:
    return reduce(lambda a, b: a & b, [k.column.eqNullSafe(F.lit(v)) for k, v in zip(keys, pivot)])


def _key_columns(keys: list[Order]) -> list[Column]:
    return [k.column.alias(f"k{i}") for i, k in enumerate(keys)]


def around(df: DataFrame, keys: list[Order], start: int, stop: int, most: int = SORTED, sample: int = SAMPLE) -> tuple[Column, int, int]:
    """(predicate, rows before, rows): a range of keys that holds the rows with the places start up to stop (from 0).

    Each round takes a sample of the rows (those whose numbers have the least hashes), picks two of them around the wanted places,
    counts exactly what lies before both, and goes on inside; a range shrinks some thirty times a round. It ends with at
    most `most` rows more than were asked for, or with rows of one key.
    """
    inside, first, rows = F.lit(True), 0, df.count()
    names = [F.col(f"k{i}") for i in range(len(keys))]
    while rows > stop - start + most:
        found = df.where(inside).select(*_key_columns(keys), F.monotonically_increasing_id().alias("row"))
        picked = found.orderBy(F.xxhash64("row", F.lit(rows))).limit(sample).select(*names)
        picked = picked.orderBy(*[Order(f"k{i}", k.descending, k.nulls_last).sorted for i, k in enumerate(keys)]).collect()
        margin = 2 * len(picked) ** 0.5
        lo = int((start - first) / rows * len(picked) - margin)
        hi = int((stop - first) / rows * len(picked) + margin) + 1
        low, high = picked[lo] if lo > 0 else None, picked[hi] if hi < len(picked) else None
        if low is None and high is None:
            break
        if low is not None and high is not None and low == high:
            counts = df.where(inside).agg(F.count_if(before(keys, low)).alias("a"), F.count_if(at(keys, low)).alias("b")).first()
            if first + counts.a <= start and stop <= first + counts.a + counts.b:
                return inside & at(keys, low), first + counts.a, counts.b
            break
        is_low = before(keys, low) if low is not None else F.lit(False)
        is_high = before(keys, high) if high is not None else F.lit(True)
        counts = df.where(inside).agg(F.count_if(is_low).alias("a"), F.count_if(is_high).alias("b")).first()
        if first + counts.a > start or first + counts.b < stop or counts.b - counts.a == rows:
            break  # the sample was wrong about these places: what is known so far holds them
        inside, first, rows = inside & ~is_low & is_high, first + counts.a, counts.b - counts.a
    return inside, first, rows


def slice_rows(df: DataFrame, keys: list, start: int, stop: int, most: int = SORTED) -> DataFrame:
    """The rows with the places start up to stop, in order."""
    keys = orders(keys)
    inside, first, _ = around(df, keys, start, stop, most)
    return df.where(inside).orderBy(*[k.sorted for k in keys]).offset(start - first).limit(stop - start)


def first_rows(df: DataFrame, keys: list, n: int, most: int = SORTED) -> DataFrame:
    """The first n rows, in no order: a filter on the key of the n-th row, so that they stay where they are.

    Rows that equal that key are taken as far as they are needed.
    """
    keys = orders(keys)
    if n <= 0:
        return df.limit(0)
    total = df.count()
    if n >= total:
        return df
    last = slice_rows(df.select(*_key_columns(keys)), [Order(f"k{i}", k.descending, k.nulls_last) for i, k in enumerate(keys)], n - 1, n, most).first()
    earlier = before(keys, last)
    counts = df.agg(F.count_if(earlier).alias("a"), F.count_if(at(keys, last)).alias("b")).first()
    if counts.a + counts.b == n:
        return df.where(earlier | at(keys, last))
    return df.where(earlier).unionByName(df.where(at(keys, last)).limit(n - counts.a))
