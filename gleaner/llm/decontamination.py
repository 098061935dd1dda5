"""Benchmark decontamination with suffix arrays over the training texts.

The training words are cut into shards of bounded size. Each shard sorts its suffixes by their first WINDOW
words, and every suffix of every benchmark item is searched in that array by bisection; equal suffixes stand
together, so one search finds all places. A match of WINDOW words, or of a whole shorter item, is an
occurrence. Occurrences that follow each other both in the text and in the item lie on one diagonal and are one
longest verbatim match: it can't go on to either side. Its place in the text, in the item and its length are
returned, and documents with matches can be removed.

Shards are slices of the scan, so nothing is shuffled and a lost task is redone alone. The benchmark is sent
to the executors in blocks of at most BLOCK_BYTES of text each, with a scan of the documents for each block;
with more than one block the findings of a document are brought together by its row.

Suffixes whose first two words never follow each other in the benchmark can't match more than one word; they
are left out of the arrays, unless an item is that one word. So are words that the benchmark lacks.

Cases: null and empty texts have no words, and an item without words occurs nowhere. Items that repeat an id
are one item, whose texts are matched each for itself; a null id is written as the empty text. Repeated rows are
rows of their own. No match crosses the end of a text. An empty benchmark leaves all documents clean; empty
documents give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import frugal, slices, split_words
from gleaner.session import ship

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 8 << 20

#: A-Z lowered, bytes that belong to no word turned to spaces.
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, and where each text's begin."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    letters = _PLAIN[np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]]
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(letters))
    return split_words(pc.ascii_trim_whitespace(clean))


def _keys(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The suffixes at some places, cut to width words, as byte strings that sort as the words do.

    words must end with width zeros; a zero also stands after each text.
    """
    return words[at[:, None] + np.arange(width)].astype(">u4").view(f"S{4 * width}").ravel()


class Benchmark:
    """A block of items, ready to be searched for: windows, sorted, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        flat, starts = plain_words(pa.array([text for _, text in items], pa.string()))
        coded = flat.dictionary_encode()
        self.window, self.vocabulary = window, coded.dictionary
        self.names = [name for name, _ in items]
        words = np.zeros(len(flat) + window, np.uint32)
        words[: len(flat)] = coded.indices.to_numpy().astype(np.uint32) + 1
        lengths = np.diff(starts)
        self.item = np.repeat(np.arange(len(items)), lengths)
        place = np.arange(len(flat)) - np.repeat(starts[:-1], lengths)
        size = np.minimum(lengths, window)
        inside = np.repeat(size, lengths)
        begins = np.flatnonzero(place + inside <= np.repeat(lengths, lengths))
        # shorter items keep zeros after their words, so that they sort before all that goes on
        grid = words[begins[:, None] + np.arange(window)] * (np.arange(window) < inside[begins][:, None])
        keys = np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * window}").ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, first, self.of = np.unique(keys[order], return_index=True, return_inverse=True)
        self.size = inside[begins][order][first]
        self.owner, self.offset = self.item[begins][order], place[begins][order]
        self.runs = np.searchsorted(self.of, np.arange(len(self.keys) + 1))
        above = (np.arange(window) >= self.size[:, None]).astype(np.uint32) * np.uint32(0xFFFFFFFF)
        self.above = np.ascontiguousarray((grid[order][first] | above).astype(">u4")).view(f"S{4 * window}").ravel()
        follow = begins[inside[begins] > 1]
        self.pairs = np.unique(words[follow].astype(np.uint64) << np.uint64(32) | words[follow + 1])
        self.single = np.zeros(len(self.vocabulary) + 1, bool)
        self.single[words[begins[inside[begins] == 1]]] = True

    def search(self, texts: pa.Array):
        """(words of each text, places, windows): the window of that number occurs at the place.

        Places count all words of the shard, with one more after each text; starts gives each text's first.
        """
        flat, starts = plain_words(texts)
        lengths = np.diff(starts)
        words = np.zeros(len(flat) + len(lengths) + self.window, np.uint32)
        starts = starts + np.arange(len(starts))
        if len(flat) and len(self.keys):
            codes = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
            words[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = (codes + 1).astype(np.uint32)
        here = np.flatnonzero(words[: -self.window])
        single = self.single[words[here]]
        pair = words[here].astype(np.uint64) << np.uint64(32) | words[here + 1]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            single |= self.pairs[at] == pair
        suffixes = here[single]
        keys = _keys(words, suffixes, self.window)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[order], keys[order]
        low = np.searchsorted(keys, self.keys, "left")
        high = np.searchsorted(keys, self.above, "right")
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return lengths, starts, suffixes[np.repeat(low[found], count) + nth], np.repeat(found, count)


    def matches(self, starts: np.ndarray, places: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Longest matches, sorted: text, item, first word in the text, first word in the item, words."""
        count = self.runs[windows + 1] - self.runs[windows]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window, place = np.repeat(windows, count), np.repeat(places, count)
        which = self.runs[window] + nth
        item, offset = self.owner[which], self.offset[which]
        doc = np.searchsorted(starts, place, "right") - 1
        at = place - starts[doc]
        order = np.lexsort((at, at - offset, item, doc))
        doc, item, at, offset, size = (x[order] for x in (doc, item, at, offset, self.size[window]))
        joined = np.zeros(len(at), bool)
        joined[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (offset[1:] == offset[:-1] + 1)
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        return doc[first], item[first], at[first], offset[first], at[last] - at[first] + size[last]


def _covered(places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the runs that begin at places: begins and ends of what is covered."""
    order = np.argsort(places, kind="stable")
    begin, end = places[order], np.maximum.accumulate((places + sizes)[order])
    new = np.concatenate(([True], begin[1:] > end[:-1])) if len(begin) else np.zeros(0, bool)
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(begin) - 1])) if len(begin) else np.zeros(0, int)
    return begin[new], end[last]


_RUN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_MATCH = pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string())), ("matches", pa.list_(_MATCH))])
_FOUND_TYPES = "row long, doc_id long, n_words long, runs array<struct<start:bigint,stop:bigint>>, items array<string>, matches array<struct<item_id:string,start:bigint,item_start:bigint,words:bigint>>"


def _lists(doc: np.ndarray, n: int, values: list[pa.Array], kind: pa.StructType) -> pa.ListArray:
    """The structs of each of n texts, for structs in order of their texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(values, kind, strict=True)], fields=list(kind)))


def _scan(benchmark):
    """What a block of the benchmark covers of each text, and its longest matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Benchmark = benchmark.value
        for batch in batches:
            for part in slices(batch, "text", 4000, SHARD_BYTES):
                lengths, starts, places, windows = block.search(part.column("text"))
                n = len(lengths)
                begin, end = _covered(places, block.size[windows] if len(windows) else places)
                doc = np.searchsorted(starts, begin, "right") - 1
                runs = _lists(doc, n, [pa.array(begin - starts[doc]), pa.array(end - starts[doc])], _RUN)
                if len(windows):
                    doc, item, at, offset, words = block.matches(starts, places, windows)
                else:
                    doc, item, at, offset, words = (np.zeros(0, np.int64) for _ in range(5))
                names = pa.array(block.names, pa.string()).take(pa.array(item))
                items: list[set] = [set() for _ in range(n)]
                for d, name in zip(doc.tolist(), names.to_pylist(), strict=True):
                    items[d].add(name)
                matches = _lists(doc, n, [names, pa.array(at), pa.array(offset), pa.array(words)], _MATCH)
                yield pa.record_batch([part.column("row"), part.column("doc_id"), pa.array(lengths), runs, pa.array([sorted(x) for x in items], pa.list_(pa.string())), matches], schema=_FOUND)

    return run


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Benchmark]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):  # each block is bounded, and the last is dropped before the next is fetched
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield Benchmark(sorted(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)), window)


def _length(runs: Column) -> Column:
    """Words that runs cover, counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(a["to"], r["start"]))).alias("n"), F.greatest(a["to"], r["stop"]).alias("to"))
    return F.aggregate(F.array_sort(runs), start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_words, n_hit, runs (of covered words, start to stop), items
    (ids, sorted as strings) of the benchmark (item_id, text), and matches (item_id, start, item_start, words): the
    longest verbatim matches with their places, counted in words from 0."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [rows.mapInArrow(frugal(_scan(spark.sparkContext.broadcast(block))), _FOUND_TYPES) for block in _blocks(benchmark, window)]
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part.filter(F.size("runs") > 0))
        gathered = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), gathered("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), gathered("matches"))
    return found.select("doc_id", "n_words", _length(F.col("runs")).alias("n_hit"), "runs", "items", "matches")


def _keep_clean(benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Benchmark = benchmark.value
        for batch in batches:
            for part in slices(batch, "text", 4000, SHARD_BYTES):
                lengths, starts, places, _ = block.search(part.column("text"))
                clean = np.ones(len(lengths), bool)
                clean[np.searchsorted(starts, places, "right") - 1] = False
                yield part.filter(pa.array(clean))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of docs whose text has no match, all columns as they are."""
    spark = docs.sparkSession
    ship(spark)
    for block in _blocks(benchmark, window):
        docs = docs.mapInArrow(frugal(_keep_clean(spark.sparkContext.broadcast(block))), docs.schema)
    return docs
