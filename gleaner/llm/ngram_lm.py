"""Interpolated modified Kneser-Ney language model over words, of order 3, counted in Spark.

A word's probability given the two before is

    P3(w | u v) = max(c(u v w) - D(c(u v w)), 0) / c(u v) + gamma(u v) P2(w | v)
    P2(w | v)   = max(k(v w) - D(k(v w)), 0) / k(v) + gamma(v) P1(w)
    P1(w)       = max(k(w) - D(k(w)), 0) / T + gamma / (V + 1)

c counts words, k the different words that come before, k(v) and T are the sums of k(v w) over w and of k(w).
Each order has three discounts D of modified Kneser-Ney, from its counts of counts; gamma is the mass that they
leave; V is the vocabulary with the end. Two begins stand before a text. After a context that was never seen
the next lower order is used. All known words and one unknown add up to one after every context.

Building takes four shuffles, each of packed arrays, not of a row for each n-gram, and each is removed when its
arrays are written:

1. words: a task counts its words by 64-bit hash and deals sorted runs of (hash, count) by hash range; each
   range is merged into a sorted array. A word's id is its place in all ranges.
2. trigrams: a task turns its texts into ids, counts trigrams, and deals them by their mixed context (u v). A
   range is written as a sorted array of contexts, with sums about each, and its sorted followers.
3. continuations: each range deals the pairs (v w) of its trigrams by their own mixed key, which is a context's
   key too, so that k(v w) is written beside the contexts.
4. what a range of pairs knows about words (what follows or precedes) goes to ranges of ids, where it is added
   up in dense arrays.

Followers of a context meet in one task after each task has counted its own: no more than the vocabulary. Each
range has a partition of its own, and keys are sorted part by part, so that a task holds little beside one range.

The arrays are files in the shared folder; small numbers take a byte, with the few large ones beside. Workers
map them into memory and bisect: a slice of texts is looked up in sorted order. The driver holds the totals of
each range, no n-grams. Ids are 32 bits wide, which bounds the vocabulary at 4 billion words; more is an error.

Cases: a null text is empty; an empty text is its end alone. Without training texts nothing is known, all
probability is on the unknown word, and every text scores 0. Where counts of counts are missing the discounts
are 1/2, 1 and 3/2. Repeated rows count as often as they are there. Null ids hash as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import crc_mod, frugal, frugal_group, mix64, scratch_path, shared_array, shared_write, shuffles_removed, slices, words_of
from gleaner.session import ship

#: The end of a text, as a word: hashes of words are made odd, so that no word is taken for it.
END = np.uint64(0)
MAX_RANGES = 8192
#: Different words, or trigrams, that a task holds before it passes them on.
HELD_WORDS, HELD = 3_000_000, 4_500_000
#: Parts that the keys of a task or of a range are sorted in, one after the other: sorting takes several times the
#: room of what it sorts, and an executor's workers have little beside its JVM.
PARTS = 8
#: Contexts that share a stored place of their first follower.
BLOCK = 32
_LOW = np.uint64(0xFFFFFFFF)


def _hashes(words: pa.Array) -> np.ndarray:
    raw = words.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)) | np.uint64(1)


def unmix64(h: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""

    def unshift(x: np.ndarray, n: int) -> np.ndarray:
        y = x
        for _ in range(64 // n):
            y = x ^ (y >> np.uint64(n))
        return y

    h = unshift(h, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = unshift(h, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(h, 30)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are mostly zero and compress."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def _bounds(ranges: int) -> np.ndarray:
    """Where the hash ranges begin."""
    return np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of ints."""
    turned = lambda h, n: h << np.uint32(n) | h >> np.uint32(32 - n)
    h = turned(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turned(h ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


@lru_cache
def _slots(ranges: int) -> np.ndarray:
    """For each range a number that Spark deals to the partition of the range's own number; modulo ranges it is
    the range. Dealt by their own numbers, several ranges would meet in the memory of one task."""
    slots, open_ = np.arange(ranges), np.arange(ranges)
    while len(open_):
        fits = _spark_hash(slots[open_]) % ranges == open_
        open_ = open_[~fits]
        slots[open_] += ranges
    return slots


def _by_range(df: DataFrame, ranges: int):
    return df.repartition(ranges, "range").groupBy("range")


_PACKED = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _dealt(keys: np.ndarray, counts: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    ranges = len(slots)
    cuts = np.append(np.searchsorted(keys, _bounds(ranges)), len(keys))
    for k in range(ranges):
        if cuts[k] < cuts[k + 1]:
            part = slice(cuts[k], cuts[k + 1])
            yield pa.record_batch([pa.array([slots[k]], pa.int32()), pa.array([_pack(keys[part])], pa.binary()), pa.array([counts[part].astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()], pa.binary())], schema=_PACKED)


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([_unpack(x.as_buffer()) for x in table.column("keys")])
    counts = np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in table.column("counts")])
    return _merged(keys, counts)


def _count_words(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, texts = [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                flat, _ = words_of(part.column("text"))
                coded = flat.dictionary_encode()
                keys.append(_hashes(coded.dictionary))
                counts.append(np.bincount(coded.indices.to_numpy(), minlength=len(keys[-1])).astype(np.int64))
                held, texts = held + len(keys[-1]), texts + part.num_rows
                if held > HELD_WORDS:
                    merged = _merged(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                    if held > HELD_WORDS // 2:
                        yield from _dealt(*merged, slots)
                        keys, counts, held = [], [], 0
        keys.append(np.array([END], np.uint64))
        counts.append(np.array([texts], np.int64))
        if texts:
            yield from _dealt(*_merged(np.concatenate(keys), np.concatenate(counts)), slots)

    return run


def _write_words(folder: str, ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _joined(table)
        k = key[0].as_py() % ranges
        shared_write(folder, f"word-{k}", keys)
        shared_write(folder, f"count-{k}", _small(counts))
        ends = int(counts[0]) if len(keys) and keys[0] == END else 0
        return pa.table({"range": pa.array([k], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())], "ends": [ends]})

    return run


@dataclass
class Words:
    """The vocabulary: sorted hashes in ranges, ids by place."""

    folder: str
    ranges: int
    first: list[int]  #: the id of each range's first word, and the number of words
    tokens: int
    texts: int

    @property
    def size(self) -> int:
        return self.first[-1]

    @property
    def slots(self) -> np.ndarray:
        return _slots(self.ranges)

    @property
    def step(self) -> int:
        """Ids of a range of ids; the begin has one too."""
        return -(-(self.size + 1) // self.ranges)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for part, at, found, k in _searched(self.folder, "word", self.ranges, hashes):
            ids[part[found]] = at[found] + self.first[k]
            counts[part[found]] = shared_array(self.folder, f"count-{k}")[at[found]]
        return ids, counts


def _searched(folder: str, name: str, ranges: int, keys: np.ndarray):
    """For each range that some keys fall in: their places, where they are in the range's array, whether they
    are there, and the range."""
    order = np.argsort(keys)
    ordered = keys[order]
    cuts = np.append(np.searchsorted(ordered, _bounds(ranges)), len(keys))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        stored = shared_array(folder, f"{name}-{k}")
        if stored is None or not len(stored):
            continue
        wanted = ordered[cuts[k] : cuts[k + 1]]
        at = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
        yield order[cuts[k] : cuts[k + 1]], at, stored[at] == wanted, k


def _encoded(texts: pa.Array):
    """Token numbers in the slice's own list of words (0 is the end), the hashes of that list, and where each
    text's tokens begin."""
    flat, starts = words_of(texts)
    coded = flat.dictionary_encode()
    hashes = np.concatenate(([END], _hashes(coded.dictionary)))
    n = len(starts) - 1
    begins = starts + np.arange(n + 1)
    tokens = np.zeros(len(flat) + n, np.int64)
    tokens[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(starts))] = coded.indices.to_numpy().astype(np.int64) + 1
    return tokens, hashes, begins


def _before(tokens: np.ndarray, begins: np.ndarray, begin: int) -> np.ndarray:
    """The token before each token; begin before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins[:-1]] = begin
    return before


def _grouped(contexts: np.ndarray, followers: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted contexts, how many different followers each has, these, sorted, and their counts."""
    order = np.argsort(contexts)
    contexts = contexts[order]
    new = np.concatenate(([True], contexts[1:] != contexts[:-1])) if len(order) else np.zeros(0, bool)
    both = (np.cumsum(new) - 1).astype(np.uint64) << np.uint64(32) | followers[order]
    keys = contexts[new]
    if counts is None:
        both, counts = _counted(both)
    else:
        both, counts = _merged(both, counts[order])
    return keys, np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(keys)), (both & _LOW).astype(np.uint32), counts


_TRIPLES = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("followers", pa.binary()), ("counts", pa.binary())])
_TRIPLE_TYPES = "range int, keys binary, sizes binary, followers binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes, part: slice = slice(None)) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1)[:, part].T).view(np.uint32).ravel()


def _count_triples(words: Words):
    """Trigrams of texts, dealt by context; beyond stands after the end, so that every pair is a context."""
    begin, beyond, slots, bounds = words.size, words.size + 1, words.slots, _bounds(words.ranges)

    def dealt(contexts: list, followers: list) -> Iterator[pa.RecordBatch]:
        for part in np.array_split(np.arange(words.ranges), min(PARTS, words.ranges)):
            last = int(part[-1]) + 1
            inside = [(c >= bounds[part[0]]) & (c < bounds[last]) if last < words.ranges else c >= bounds[part[0]] for c in contexts]
            keys, sizes, after, counts = _grouped(*(np.concatenate([x[i] for x, i in zip(column, inside, strict=True)]) for column in (contexts, followers)))
            cuts = np.append(np.searchsorted(keys, bounds[part]), len(keys))
            inner = np.concatenate(([0], np.cumsum(sizes)))[cuts]
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                own, its = slice(cuts[k], cuts[k + 1]), slice(inner[k], inner[k + 1])
                row = [[slots[part[k]]], [_pack(keys[own])], [_planes(sizes[own])], [_planes(after[its])], [_planes(counts[its])]]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(row, _TRIPLES.types, strict=True)], schema=_TRIPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, followers, n = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, hashes, begins = _encoded(part.column("text"))
                ids = words.look_up(hashes)[0][tokens]
                before = _before(ids, begins, begin)
                ends = begins[1:] - 1
                first = np.concatenate((_before(before, begins, begin), before[ends]))
                second = np.concatenate((before, ids[ends]))
                contexts.append(_pair(first, second))
                followers.append(np.concatenate((ids, np.full(len(ends), beyond))).astype(np.uint32))
                n += len(first)
                if n > HELD:
                    yield from dealt(contexts, followers)
                    contexts, followers, n = [], [], 0
        if n:
            yield from dealt(contexts, followers)

    return run


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))


def _as_small(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers as bytes; where the byte is 255, the number beside, with its row and place."""
    values = np.atleast_2d(values)
    row, at = np.nonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8), row, at, values[row, at]


def _write_small(folder: str, name: str, parts: list[tuple[np.ndarray, ...]]) -> None:
    """Write parts of numbers, which follow each other, as one array of bytes, and the large ones by place."""
    data = np.concatenate([x[0] for x in parts], axis=1)
    begins = np.cumsum([0, *(x[0].shape[1] for x in parts)])[:-1]
    places = np.concatenate([row * data.shape[1] + at + begin for (_, row, at, _), begin in zip(parts, begins, strict=True)])
    order = np.argsort(places)
    shared_write(folder, name, data if len(data) > 1 else data[0])
    shared_write(folder, f"{name}-large", np.stack([places, np.concatenate([x[3] for x in parts])])[:, order].astype(np.int64))


def _read_small(folder: str, name: str, at: np.ndarray, row: int = 0) -> np.ndarray:
    """Numbers at some places of a row; 0 where nothing was written."""
    stored = shared_array(folder, name)
    if stored is None:
        return np.zeros(len(at), np.int64)
    out = (stored if stored.ndim == 1 else stored[row])[at].astype(np.int64)
    full = np.flatnonzero(out == 255)
    if len(full):
        places, values = shared_array(folder, f"{name}-large")
        out[full] = values[np.searchsorted(places, at[full] + row * stored.shape[-1])]
    return out


#: Rows of what is stored about a context: different followers, their sum of counts, those seen once and twice.
SIZE, SUM, ONCE, TWICE = range(4)


def _write_triples(words: Words):
    """Write a range of contexts with their followers; return its counts of counts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k, folder = key[0].as_py() % words.ranges, words.folder
        columns = [[x.as_buffer() for x in table.column(c)] for c in ("keys", "sizes", "followers", "counts")]
        bounds = np.array([((k * PARTS + part) << 64) // (words.ranges * PARTS) for part in range(1, PARTS)], np.uint64)
        rows = []  # of each task: its contexts, and where the parts begin among these and their followers
        for keys, sizes in zip(*columns[:2], strict=True):
            keys = _unpack(keys)
            cuts = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
            rows.append((keys, cuts, np.concatenate(([0], np.cumsum(_numbers(sizes), dtype=np.int64)))[cuts]))
        out, begin, n, totals = [], 0, 0, np.zeros(4, np.int64)
        for part in range(PARTS):
            own = [(slice(cuts[part], cuts[part + 1]), slice(inner[part], inner[part + 1])) for _, cuts, inner in rows]
            picked = lambda column, i: np.concatenate([_numbers(x, its[i]) for x, its in zip(columns[column], own, strict=True)])
            contexts = np.repeat(np.concatenate([keys[its[0]] for (keys, _, _), its in zip(rows, own, strict=True)]), picked(1, 0))
            if not len(contexts):
                continue
            keys, sizes, after, counts = _grouped(contexts, picked(2, 1), picked(3, 1).astype(np.int64))
            first = np.cumsum(sizes) - sizes
            about = np.stack([sizes, *(np.add.reduceat(x, first) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64)))])
            out.append((keys, _as_small(about), first[-n % BLOCK :: BLOCK] + begin, after, _as_small(counts)))
            begin, n = begin + len(after), n + len(keys)
            real = counts[after <= words.size]
            totals += [(real == c).sum() for c in (1, 2, 3, 4)]
        keys, about, first, after, counts = zip(*out, strict=True)
        for name, arrays in (("pair", keys), ("first", first), ("after", after)):
            shared_write(folder, f"{name}-{k}", np.concatenate(arrays))
        _write_small(folder, f"context-{k}", list(about))
        _write_small(folder, f"times-{k}", list(counts))
        return pa.table({"range": pa.array([k], pa.int32())} | {f"k{c}": [int(x)] for c, x in enumerate(totals, 1)})

    return run


def _continued(words: Words):
    """The pairs (v, w) of a range's trigrams and how many different words come before, dealt by their own key."""

    slots = words.slots

    def pairs(k: int, keys: np.ndarray) -> np.ndarray:
        after = shared_array(words.folder, f"after-{k}")
        real = after <= words.size
        second = after[real]
        first = np.repeat((unmix64(keys) & _LOW).astype(np.uint32), _read_small(words.folder, f"context-{k}", np.arange(len(keys)), SIZE))[real]
        mixed = np.empty(len(first), np.uint64)
        for at in range(0, len(first), 1 << 18):
            mixed[at : at + (1 << 18)] = _pair(first[at : at + (1 << 18)], second[at : at + (1 << 18)])
        return mixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                keys = shared_array(words.folder, f"pair-{k}")
                if keys is None:
                    continue
                yield from _dealt(*_counted(pairs(k, keys)), slots)

    return run


_ABOUT = pa.schema([("range", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("k3", pa.int64()), ("k4", pa.int64())])
#: What is known of a word: followers that one, two or more words precede it with, their sum; different words before.
NUMBERS = 5


def _write_continued(words: Words):
    """Write k(v w) beside a range's contexts; return, for ranges of ids, what the range knows of words."""
    slots = words.slots

    def run(key: tuple, table: pa.Table) -> pa.Table:
        mixed, counts = _joined(table)
        k = key[0].as_py() % words.ranges
        known = np.zeros(len(shared_array(words.folder, f"pair-{k}")), np.int64)
        known[np.searchsorted(shared_array(words.folder, f"pair-{k}"), mixed)] = counts
        _write_small(words.folder, f"continued-{k}", [_as_small(known)])
        del known
        pairs = unmix64(mixed)
        first, second = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & _LOW).astype(np.uint32)
        del mixed, pairs
        order = np.argsort(first, kind="stable")
        after, kind = first[order], np.minimum(counts, 3).astype(np.uint8)[order]
        at = np.flatnonzero(np.concatenate(([True], after[1:] != after[:-1])))
        followed = [np.add.reduceat(x, at) for x in (*((kind == c).astype(np.int64) for c in (1, 2, 3)), counts[order])]
        target, before = np.unique(second, return_counts=True)
        ids = np.concatenate((after[at], target)).astype(np.int64)
        del first, second, order, after, kind
        numbers = np.zeros((NUMBERS, len(ids)), np.uint32)
        numbers[:4, : len(at)], numbers[4, len(at) :] = followed, before
        step = words.step
        order = np.argsort(ids // step, kind="stable")
        ids, numbers = ids[order], numbers[:, order]
        cuts = np.searchsorted(ids // step, np.arange(words.ranges + 1))
        totals = [int((counts == c).sum()) for c in (1, 2, 3, 4)]
        rows = []
        for r in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = slice(cuts[r], cuts[r + 1])
            small = (ids[part] - r * step).astype(np.uint32)
            rows.append((slots[r], small.tobytes(), numbers[:, part].tobytes(), *(totals if not rows else (0, 0, 0, 0))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ABOUT.types, strict=True)], schema=_ABOUT)

    return run


def _write_about(words: Words):
    """Add up what all ranges of pairs know about a range of ids."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py() % words.ranges
        sums = np.zeros((NUMBERS, words.step), np.int64)
        for ids, numbers in zip(table.column("ids").to_pylist(), table.column("numbers").to_pylist(), strict=True):
            where = np.frombuffer(ids, np.uint32)
            for row, add in zip(sums, np.frombuffer(numbers, np.uint32).reshape(NUMBERS, -1), strict=True):
                row += np.bincount(where, add, minlength=words.step).astype(np.int64)
        shared_write(words.folder, f"about-{r}", _small(sums))
        before = sums[4]
        out = {"total": [int(before.sum())]} | {f"t{c}": [int((before == c).sum())] for c in (1, 2, 3, 4)} | {"t_more": [int((before >= 3).sum())]}
        return pa.table(out | {f"k{c}": [sum(table.column(f"k{c}").to_pylist())] for c in (1, 2, 3, 4)})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """By count 0, 1, 2 and 3 or more."""
    if not (n1 and n2 and n3 and n4):
        return (0.0, 0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return (0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1)))


_NONE = (0.0, 0.5, 1.0, 1.5)


@dataclass
class Model:
    words: Words
    triple_discount: tuple[float, ...] = _NONE
    pair_discount: tuple[float, ...] = _NONE
    word_discount: tuple[float, ...] = _NONE
    kinds: int = 0  #: different pairs
    left: float = 1.0  #: what the words' discounts leave

    def about(self, ids: np.ndarray) -> np.ndarray:
        """NUMBERS for each id."""
        out = np.zeros((NUMBERS, len(ids)), np.int64)
        order = np.argsort(ids)
        cuts = np.searchsorted(ids[order], np.arange(self.words.ranges + 1) * self.words.step)
        for r in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            stored = shared_array(self.words.folder, f"about-{r}")
            if stored is not None:
                part = order[cuts[r] : cuts[r + 1]]
                out[:, part] = stored[:, ids[part] - r * self.words.step]
        return out

    def _after(self, k: int, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For contexts at some places of a range: how often the wanted words follow, the sum over all words
        that follow, and the share that discounts leave."""
        folder, d = self.words.folder, self.triple_discount
        size, total, once, twice = (_read_small(folder, f"context-{k}", at, row) for row in (SIZE, SUM, ONCE, TWICE))
        left = (d[1] * once + d[2] * twice + d[3] * (size - once - twice)) / total
        start = np.asarray(shared_array(folder, f"first-{k}"))[at // BLOCK]
        for step in range(1, BLOCK):  # sizes of the contexts between the block's first and this one
            more = np.flatnonzero(at % BLOCK >= step)
            start[more] += _read_small(folder, f"context-{k}", at[more] - step, SIZE)
        after = shared_array(folder, f"after-{k}")
        low, high = start, start + size
        end, open_ = high.copy(), np.arange(len(at))
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = after[middle] < wanted[open_]
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < high[open_]]
        there = np.flatnonzero(low < end)
        there = there[after[low[there]] == wanted[there]]
        count = np.zeros(len(at), np.int64)
        count[there] = _read_small(folder, f"times-{k}", low[there])
        return count, total, left

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """For each text: tokens, known tokens, and the two log10 scores."""
        words = self.words
        tokens, hashes, begins = _encoded(texts)
        ids, counts = words.look_up(hashes)
        base = np.log10((counts + 0.1) / (words.tokens + 0.1 * (words.size + 1)))
        known = np.append(ids >= 0, words.texts > 0)  # the last is the begin
        all_ids = np.append(ids, words.size)
        about = np.zeros((NUMBERS, len(all_ids)), np.int64)
        about[:, known] = self.about(all_ids[known])
        single = self._discounted(about[4], self.word_discount) / max(self.kinds, 1) + self.left / (words.size + 1)
        left = np.asarray(self.pair_discount[1:]) @ about[:3] / np.maximum(about[3], 1)
        left[about[3] == 0] = 1.0
        before = _before(tokens, begins, len(ids))
        # where each pair is stored: of a token and the one before, and, last, of two begins
        first, second = np.append(before, len(ids)), np.append(tokens, len(ids))
        both = np.flatnonzero(known[first] & known[second])
        in_range, place, continued = np.full(len(first), -1), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for part, at, found, k in _searched(words.folder, "pair", words.ranges, _pair(all_ids[first[both]], all_ids[second[both]])):
            where = both[part[found]]
            in_range[where], place[where] = k, at[found]
            continued[where] = _read_small(words.folder, f"continued-{k}", at[found])
        p = left[before] * single[tokens] + self._discounted(continued[:-1], self.pair_discount) / np.maximum(about[3][before], 1)
        # a token's context is the pair that ends before it
        context = _before(np.arange(len(tokens)), begins, len(tokens))
        rest = np.flatnonzero(in_range[context] >= 0)
        rest = rest[np.lexsort((place[context[rest]], in_range[context[rest]]))]
        ranges = in_range[context[rest]]
        wanted = np.where(known[tokens], all_ids[tokens], words.size + 2)  # no follower is that
        for k, own in ((int(ranges[x[0]]), rest[x]) for x in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(ranges)) + 1) if len(x)):
            count, total, share = self._after(k, place[context[own]], wanted[own])
            p[own] = share * p[own] + self._discounted(count, self.triple_discount) / total
        sums = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: E731  every text has its end, so no run is empty
        return {"n_tokens": np.diff(begins), "n_known": sums(known[tokens].astype(np.int64)), "base_score": sums(base[tokens]), "score": sums(np.log10(p))}

    @staticmethod
    def _discounted(counts: np.ndarray, by: tuple[float, ...]) -> np.ndarray:
        return np.maximum(counts - np.asarray(by)[np.minimum(counts, 3)], 0.0)


def train(docs: DataFrame) -> Model:
    """Count the texts of docs (text) and write the model to the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    ranges = max(8, min(texts.rdd.getNumPartitions(), MAX_RANGES))
    folder, packed = scratch_path(spark, "ngrams"), "range int, keys binary, counts binary"
    with shuffles_removed(spark):
        counted = _by_range(texts.mapInArrow(frugal(_count_words(_slots(ranges))), packed), ranges)
        rows = {r["range"]: r for r in counted.applyInArrow(frugal_group(_write_words(folder, ranges)), "range int, n long, tokens long, ends long").collect()}  # a row for each range
        first = np.concatenate(([0], np.cumsum([rows[k]["n"] if k in rows else 0 for k in range(ranges)]))).tolist()
        words = Words(folder, ranges, first, sum(r["tokens"] for r in rows.values()), sum(r["ends"] for r in rows.values()))
        if words.size >= (1 << 32) - 2:
            raise ValueError(f"{words.size} different words; ids are 32 bits wide")
        if not words.size:
            return Model(words)
        ks = [f"k{c}" for c in (1, 2, 3, 4)]
        total = lambda df: df.agg(*[F.sum(c).alias(c) for c in df.columns if c != "range"]).first()
        triples = _by_range(texts.mapInArrow(frugal(_count_triples(words)), _TRIPLE_TYPES), ranges)
        t3 = total(triples.applyInArrow(frugal_group(_write_triples(words)), "range int, " + ", ".join(f"{k} long" for k in ks)))
        pairs = spark.range(0, ranges, 1, ranges).mapInArrow(frugal(_continued(words)), packed)
        about = _by_range(pairs, ranges).applyInArrow(frugal_group(_write_continued(words)), "range int, ids binary, numbers binary, " + ", ".join(f"{k} long" for k in ks))
        t = total(_by_range(about, ranges).applyInArrow(frugal_group(_write_about(words)), ", ".join(f"{c} long" for c in ("total", "t1", "t2", "t3", "t4", "t_more", *ks))))
    by_word = discounts(t["t1"], t["t2"], t["t3"], t["t4"])
    left = (by_word[1] * t["t1"] + by_word[2] * t["t2"] + by_word[3] * t["t_more"]) / t["total"]
    return Model(words, discounts(*[t3[k] for k in ks]), discounts(*[t[k] for k in ks]), by_word, t["total"], left)


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """n_tokens, n_known, base_score and score of every text of docs, with the columns to keep."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 500, 2 << 20):  # some 25 arrays of a slice's tokens are held
                if part.num_rows:
                    scores = model.score(part.column("text"))
                    yield pa.record_batch([*[part.column(n) for n in names], *[pa.array(x) for x in scores.values()]], [*names, *scores])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(frugal(run), ", ".join([*fields, "n_tokens long", "n_known long", "base_score double", "score double"]))


def perplexity(score_log10: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score_log10 / n_tokens)


def train_and_score(docs: DataFrame, *, mod: int = 10, held: int = 0) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod some number isn't held, and score all of them."""
    rest = crc_mod(F.col("doc_id"), mod)
    model = train(docs.filter(rest != held).select("text"))
    scored = score(docs, model, F.col("doc_id").alias("doc_id"), (rest == held).alias("held_out"))
    return scored.withColumn("train_tokens", F.lit(model.words.tokens).cast("long"))
