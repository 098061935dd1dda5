"""Column functions over text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.vectors import TINY, norm


def counted(buckets: Column, dim: int) -> Column:
    """How often each of 0..dim-1 is in an array of bucket numbers; for few buckets."""
    return _bound(buckets, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(all_, lambda b: b == k)).cast("double")))


def dense(entries: Column, dim: int) -> Column:
    """An array of doubles from entries (bucket, weight) of different buckets: zeros fill the gaps."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    def filled(e: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(e, i - 1)["bucket"]).otherwise(-1)
        parts = F.flatten(F.transform(e, lambda x, i: F.concat(zeros(x["bucket"] - before(i) - 1), F.array(x["weight"]))))
        last = F.when(F.size(e) > 0, F.element_at(e, -1)["bucket"]).otherwise(-1)
        return F.concat(parts, zeros(F.lit(dim - 1) - last))

    return _bound(F.array_sort(entries), filled)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: lambdas inside would compute it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngram_buckets(text: Column, features: int = 500, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    """crc32 modulo features of every byte n-gram of the lower-cased text."""
    def of_size(data: Column, size: int) -> Column:
        begins = F.octet_length(data) - (size - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(begins, F.lit(1))), lambda i: (F.crc32(F.substring(data, i, F.lit(size))) % features).cast("int"))
        return F.when(begins > 0, found).otherwise(F.array().cast("array<int>"))

    return _bound(F.encode(F.lower(text), "UTF-8"), lambda data: F.concat(*[of_size(data, n) for n in sizes]))


def code_points(text: Column, dim: int) -> Column:
    """Code point modulo dim of every character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) % dim).cast("int"))


def character_counts(text: Column, dim: int, *, normal: bool = False) -> Column:
    """How many characters have each code point modulo dim, an array of doubles; nulls have no characters. With
    normal the array is divided by its length, TINY at least.

    Whole batches are counted at once: their code points are one numpy array.
    """
    def counts(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), sizes)
        found = np.bincount(row * dim + points % dim, minlength=dim * len(texts)).astype(float)
        if normal:
            rows = found.reshape(-1, dim)
            found = (rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), TINY)).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(found))

    return F.arrow_udf(counts, "array<double>")(text)


def normalised(counts: Column, *, floor: float = TINY, add: float = 0.0) -> Column:
    n = F.greatest(norm(counts), F.lit(floor)) if not add else norm(counts) + F.lit(add)
    return F.transform(counts, lambda x: x / n)


def occurrences(text: Column, key: Column) -> Column:
    """Non-overlapping occurrences of a key in a text."""
    return F.when(F.length(key) > 0, (F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)).otherwise(0.0)


def keyword_score(text: Column, weights: Column) -> Column:
    """Sum over keys of a map: weight * (1 + 0.3 * min(count - 1, 3)) if the text contains the key."""
    def one(k: Column, w: Column) -> Column:
        n = occurrences(text, k)
        return F.when(n >= 1, w * (F.lit(1.0) + F.lit(0.3) * F.least(n - 1, F.lit(3.0)))).otherwise(0.0)

    return F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + one(e["key"], e["value"]))


def joined_fields(record: Column, keys: Sequence[str]) -> Column:
    """The values of some keys of a map, in that order, if any is there, else all values, space-joined."""
    some = F.array_compact(F.array(*[F.element_at(record, k) for k in keys]))
    return F.when(F.size(some) > 0, F.array_join(some, " ")).otherwise(F.array_join(F.map_values(record), " "))


#: What marks an answer as a failure.
FAILURES = ["error", "エラー", "失敗", "exception"]


def answer_quality(text: Column, mode: Column) -> Column:
    """Mean of three checks: a sensible length, no failure word near the start, and what the mode asks for."""
    n = F.length(text)
    sensible = F.when((n > 10) & (n < 5000), 1.0).otherwise(0.0)
    head = F.substring(F.lower(text), 1, 200)
    fine = F.when(head.rlike("|".join(FAILURES)), 0.0).otherwise(1.0)
    deep = F.when(n > 100, 1.0).otherwise(0.3)
    asked = F.when((mode == "theoretical") & (n > 50), 1.0).when(mode == "adaptive", 0.8).when(mode.isin("hyper", "active"), deep).otherwise(0.7)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.5).otherwise((sensible + fine + asked) / 3)
