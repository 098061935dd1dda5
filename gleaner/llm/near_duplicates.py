"""MinHash near-duplicates by chosen-path set similarity join.

A text's set is its different five-word shingles. Texts of equal sets are one class, so copies cost nothing
after the first. Each class has minwise tokens: for each of many hash functions, the least hash of its set.

Independent trees branch the classes: at the root a tree chooses one minwise token, and classes that agree on
it share a node; a node that is too large to compare branches again on further tokens that its own path
chooses. A pair of similarity s agrees on a chosen token with probability s, so as many trees are grown as the
target recall asks for. Small nodes are compared exhaustively, by sketches of one bit for each minwise token,
whose threshold lies so many standard deviations under the expected agreement that a linked pair is missed
about once in a hundred thousand. What passes is confirmed on the full sets.

Only connections count, so a node of any size is first compared to one of its members: confirmed links to it
join the bulk of a group of near copies. Then only members outside the bulk's component are compared, with all
members of the node that are of other components, in tiles of bounded size. A tile confirms its candidates
itself, closest first, with sets that it maps from files in the shared folder, and skips a pair that its links
have connected meanwhile. It returns fewer links than it has members, so no candidate pair is ever shuffled,
and none is dropped.

Cases: texts without words, and null texts, have the empty set and are alone. A text of fewer than five words
is one shingle. Rows that repeat an id are rows of their own; null ids never give a component its name unless
no member has another. Empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded, frugal, mix64, scratch_path, shared_array, shared_write, slices, stash, words_of
from gleaner.llm.components import components
from gleaner.session import ship

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
RECALL = 0.999999
#: Minwise tokens: for sketches, and those of them that paths choose from.
TOKENS, CHOICES = 128, 32
#: Standard deviations between a sketch's expected and least agreement.
SIGMAS = 4.5
#: Pairs that a node may compare without branching again, branches of a larger one, and levels.
NODE_PAIRS, BRANCHES, LEVELS = 1 << 25, 3, 3
#: Trees that are compared first.
FIRST_TREES = 2
#: Members on either side of a tile.
TILE = 2048
#: Partners of a class in one part of the join that confirms them.
STAR = 256
#: Candidate pairs of a tile from which a matrix may count intersections, and the operations it may take for each.
MATRIX_PAIRS, MATRIX_FLOPS_A_PAIR = 20_000, 200_000
#: Shingles in a file of sets.
SET_VALUES = 4_000_000
#: Ids that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20240501)
_FLIP = _RNG.integers(0, 1 << 64, TOKENS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all texts, and where each text's begin."""
    flat, starts = words_of(texts)
    coded = flat.dictionary_encode()
    raw = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    words = hashes[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    lengths = np.diff(starts)
    n = len(lengths)
    doc = np.repeat(np.arange(n), lengths)
    value = np.zeros(len(words), np.uint64)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    left = np.repeat(starts[1:], lengths) - np.arange(len(words))  # words from here to the text's end
    for k in range(SHINGLE):
        value = np.where(left > k, value * _STEP + mix64(padded[k : k + len(words)] + np.uint64(k + 1)), value)
    use = (left >= SHINGLE) | ((left == np.repeat(lengths, lengths)) & (left < SHINGLE))
    # a short text's only shingle carries its length, so that no longer one is taken for it
    value, doc = mix64(value[use] + np.minimum(left[use], SHINGLE).astype(np.uint64)), doc[use]
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(n + 1))


def minwise(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of each non-empty set, as a row for each function."""
    out = np.empty((TOKENS, len(starts) - 1), np.uint64)
    for k in range(TOKENS):
        out[k] = np.minimum.reduceat((sets ^ _FLIP[k]) * _TIMES[k], starts[:-1])
    return mix64(out)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64()), ("tokens", pa.list_(pa.int32()))])
_SKETCH_TYPES = "doc_id long, text_key binary, digest binary, n long, b0 long, b1 long, tokens array<int>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 400, 1 << 20):
            sets, starts = shingle_sets(part.column("text"))
            sizes = np.diff(starts)
            some = np.flatnonzero(sizes)
            digests: list = [None] * len(sizes)
            view = memoryview(np.ascontiguousarray(sets)).cast("B") if len(sets) else b""
            for i in some.tolist():
                digests[i] = xxhash.xxh3_128_digest(view[8 * starts[i] : 8 * starts[i + 1]])
            bits, tokens = np.zeros((2, len(sizes)), np.uint64), np.zeros((len(sizes), CHOICES), np.int32)
            if len(some):
                values = minwise(sets, np.append(starts[:-1][some], len(sets)))
                tokens[some] = (values[:CHOICES] >> np.uint64(32)).astype(np.uint32).view(np.int32).T
                for half in (0, 1):
                    lows = (values[64 * half : 64 * half + 64] & np.uint64(1)) << np.arange(64, dtype=np.uint64)[:, None]
                    bits[half, some] = np.bitwise_or.reduce(lows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * CHOICES, pa.int32()), pa.array(tokens.ravel()))
            yield pa.record_batch([part.column("doc_id"), part.column("text_key"), pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int64)), *[pa.array(b.view(np.int64)) for b in bits], lists], schema=_SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and set of each text; the wanted digest goes with the row, others have the same id by chance."""
    for batch in batches:
        for part in slices(batch, "text", 400, 1 << 20):
            sets, starts = shingle_sets(part.column("text"))
            view = memoryview(np.ascontiguousarray(sets)).cast("B") if len(sets) else b""
            wanted = part.column("digest").to_pylist()
            right = [xxhash.xxh3_128_digest(view[8 * a : 8 * b]) == w for a, b, w in zip(starts[:-1].tolist(), starts[1:].tolist(), wanted, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.record_batch([part.column("cid"), lists], ["cid", "shingles"]).filter(pa.array(right, pa.bool_()))


def _store_sets(folder: str):
    """Write the wanted sets into files of the shared folder; return where each set lies.

    A file belongs to one try of one task, so a second try never changes what the first one's rows point at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, at = [], [], 0
        for batch in batches:
            for part in _sets([batch]):
                lists = part.column("shingles")
                starts, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
                held.append(values[starts[0] : starts[-1]])
                rows.append((part.column("cid").to_numpy(), at + starts[:-1] - starts[0], at + starts[1:] - starts[0]))
                at += int(starts[-1] - starts[0])
                if at > SET_VALUES:
                    yield flush(held, rows)
                    held, rows, at = [], [], 0
        if rows:
            yield flush(held, rows)

    def flush(held: list, rows: list) -> pa.RecordBatch:
        name = f"sets-{uuid.uuid4().hex}"
        shared_write(folder, name, np.concatenate(held))
        cid, start, stop = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.record_batch([pa.array(cid), pa.array([name] * len(cid)), pa.array(start), pa.array(stop)], ["cid", "file", "start", "stop"])

    return run


class _Tile:
    """The members of one tile: those that ask, and those that are stored."""

    def __init__(self, rows: dict[str, np.ndarray], limit: int):
        asks = rows["asks"]
        self.q, self.s = {k: v[asks] for k, v in rows.items()}, {k: v[~asks] for k, v in rows.items()}
        self.limit = limit

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each that asks, the stored of other components whose sketches are close, closest first."""
        q, s = self.q, self.s
        step = max(1, (1 << 20) // max(len(s["cid"]), 1))
        for at in range(0, len(q["cid"]), step):
            apart = np.bitwise_count(q["b0"][at : at + step, None] ^ s["b0"]) + np.bitwise_count(q["b1"][at : at + step, None] ^ s["b1"])
            close = (apart <= self.limit) & (q["comp"][at : at + step, None] != s["comp"])
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                there = np.flatnonzero(close[i])
                yield at + i, there[np.argsort(apart[i, there], kind="stable")]

    def close_ones(self) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for i, there in self.candidates():
            found += [self.q["cid"][i : i + 1], self.s["cid"][there]]
        return np.unique(np.concatenate(found))

    def links(self, folder: str, percent: int) -> list[tuple[int, int]]:
        """Confirmed links, without those between members that others have connected already."""
        q, s = self.q, self.s
        self.percent = percent
        names, label = np.unique(np.concatenate((q["comp"], s["comp"])), return_inverse=True)
        self.own, self.label = label[: len(q["comp"])], label[len(q["comp"]) :]
        self.root = np.arange(len(names))
        self.set_of = lambda side, i: shared_array(folder, side["file"][i])[side["start"][i] : side["stop"][i]].view(np.uint64)
        close = list(self.candidates())
        if sum(len(there) for _, there in close) > MATRIX_PAIRS and (found := self._by_matrix(close)) is not None:
            return found
        return self._by_pairs(close)

    def _join(self, i: int, j: int) -> list[tuple[int, int]]:
        """Connect two members; the link, unless they are connected."""
        a, b = self.root[self.own[i]], self.root[self.label[j]]
        if a == b:
            return []
        self.root[self.root == b] = a
        return [(int(self.q["cid"][i]), int(self.s["cid"][j]))]

    def _by_pairs(self, close: list) -> list[tuple[int, int]]:
        """Compare each that asks with its candidates, closest first, and stop when all are connected."""
        found, s, percent = [], self.s, self.percent
        for i, there in close:
            mine = self.set_of(self.q, i)
            n = s["stop"][there] - s["start"][there]
            there = there[100 * np.minimum(n, len(mine)) >= percent * np.maximum(n, len(mine))]
            size = 4
            while len(there := there[self.root[self.label[there]] != self.root[self.own[i]]]):
                now, there, size = there[:size], there[size:], min(4 * size, 256)
                sets = [self.set_of(s, j) for j in now.tolist()]
                values, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
                at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                shared = np.add.reduceat((mine[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
                for j in now[100 * shared >= percent * (sizes + len(mine) - shared)].tolist():
                    found += self._join(i, j)
        return found

    def _by_matrix(self, close: list) -> list[tuple[int, int]] | None:
        """Intersections of all that have candidates, from an incidence matrix: shingles that few have are
        counted by their pairs, the others by a product of dense blocks. None if that costs more than pairs."""
        s, pairs = self.s, sum(len(there) for _, there in close)
        asks = np.array([i for i, _ in close])
        stored = np.unique(np.concatenate([there for _, there in close]))
        sets = [self.set_of(self.q, i) for i in asks.tolist()] + [self.set_of(s, j) for j in stored.tolist()]
        sizes = np.array([len(x) for x in sets])
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.repeat(np.arange(len(sets)), sizes)
        is_ask = member < len(asks)
        degree_q, degree_s = np.bincount(column[is_ask], minlength=column.max() + 1), np.bincount(column[~is_ask], minlength=column.max() + 1)
        common = np.minimum(degree_q, degree_s) > 0
        often = common & (degree_q * degree_s > 256)
        if 2.0 * len(asks) * len(stored) * often.sum() > MATRIX_FLOPS_A_PAIR * pairs:
            return None
        shared = np.zeros((len(asks), len(stored)), np.float32)
        for some in np.array_split(np.flatnonzero(often), max(1, often.sum() // 2048)):
            place = np.full(len(common), -1)
            place[some] = np.arange(len(some))
            block = np.zeros((len(sets), len(some)), np.float32)
            here = place[column] >= 0
            block[member[here], place[column[here]]] = 1
            shared += block[: len(asks)] @ block[len(asks) :].T
        few = (common & ~often)[column]
        a, b = np.flatnonzero(few & is_ask), np.flatnonzero(few & ~is_ask)
        a, b = a[np.argsort(column[a], kind="stable")], b[np.argsort(column[b], kind="stable")]
        first = np.searchsorted(column[b], column[a])
        count = degree_s[column[a]]
        for at in range(0, len(a), 1 << 18):
            c = count[at : at + (1 << 18)]
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            flat = np.repeat(member[a[at : at + (1 << 18)]], c) * len(stored) + member[b[np.repeat(first[at : at + (1 << 18)], c) + nth]] - len(asks)
            shared += np.bincount(flat, minlength=shared.size).reshape(shared.shape).astype(np.float32)
        shared = shared.astype(np.int64)
        linked = 100 * shared >= self.percent * (sizes[: len(asks), None] + sizes[None, len(asks) :] - shared)
        found = []
        for row, i in zip(linked, asks.tolist(), strict=True):
            for j in stored[row].tolist():
                found += self._join(i, j)
        return found


def _by_tile(answer, schema: pa.Schema):
    """Collect the rows of each tile, which come one after the other, and give what answer makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            rows |= {n: rows[n].view(np.uint64) for n in ("b0", "b1")}
            if held:
                rows = {k: np.concatenate((held[k], v)) for k, v in rows.items()}
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(rows["tile"])) + 1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from made(rows, a, b)
            held = {k: v[cuts[-1] :] for k, v in rows.items()}  # the last tile may go on
        if held:
            yield from made(held, 0, len(held["tile"]))

    def made(rows: dict[str, np.ndarray], a: int, b: int) -> Iterator[pa.RecordBatch]:
        if len(found := answer({k: v[a:b] for k, v in rows.items()})):
            yield pa.record_batch([pa.array(c) for c in zip(*found, strict=True)], schema=schema)

    return frugal(run)


def _most_apart(percent: int) -> int:
    """Bits in which the sketches of a linked pair differ at most."""
    p = (1 - percent / 100) / 2
    return math.ceil(TOKENS * p + SIGMAS * math.sqrt(TOKENS * p * (1 - p)))


def n_trees(percent: int, recall: float) -> int:
    """Trees for the recall: each keeps a linked pair together at the root with probability percent / 100, and
    below it in all but (1 - percent / 100) ** BRANCHES of the cases a level."""
    s = percent / 100
    keeps = s * (1 - (1 - s) ** BRANCHES) ** (LEVELS - 1)
    trees = math.ceil(math.log(1 - recall) / math.log(1 - keeps))
    if trees > CHOICES:
        raise ValueError(f"a recall of {recall} at {percent} % takes {trees} trees; there are tokens for {CHOICES}")
    return trees


def _text_key(text: Column) -> Column:
    """128 bits that tell texts apart where ids don't: null and repeated ids."""
    return F.unhex(F.md5(text.cast("string")))


class Join:
    """One join: its classes, and the steps from nodes to confirmed links."""

    def __init__(self, docs: DataFrame, percent: int, recall: float):
        self.spark, self.percent, self.recall = docs.sparkSession, percent, recall
        ship(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = stash(self.docs.withColumn("text_key", _text_key(F.col("text"))).mapInArrow(frugal(_sketches), _SKETCH_TYPES), "sketches")
        classes = self.rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "b0", "b1", "tokens")])
        self.classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def texts(self, cids: DataFrame) -> DataFrame:
        """cid, digest and text of one document, or more that repeat its id, of some classes."""
        wanted = stash(self.classes.join(cids.select("cid").distinct(), "cid").select("cid", "digest", F.col("rep").alias("wanted")), "wanted")
        return self.docs.join(bounded(wanted, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("wanted"))).select("cid", "digest", "text")

    def sets(self, cids: DataFrame) -> DataFrame:
        """cid and shingles of some classes."""
        return stash(self.texts(cids).mapInArrow(frugal(_sets), "cid long, shingles array<long>").dropDuplicates(["cid"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of classes whose full sets are alike enough.

        An a of many partners is spread: its set goes once to each of its parts, of STAR partners on average.
        """
        pairs = stash(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        wide = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")).filter("parts > 1")
        wide = bounded(stash(wide, "wide"), BROADCAST_ROWS)
        parts = F.coalesce("parts", F.lit(1))
        pairs = pairs.join(wide, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
        sets = self.sets(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))))
        set_a = sets.toDF("a", "set_a").join(wide, "a", "left").select("a", "set_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        both = pairs.join(set_a, ["a", "part"]).join(sets.toDF("b", "set_b"), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        return stash(both.withColumn("shared", shared).filter(100 * F.col("shared") >= self.percent * (F.size("set_a") + F.size("set_b") - F.col("shared"))).select("a", "b"), "links")

    def roots(self) -> DataFrame:
        """node, cid, b0, b1: the members of the trees' first nodes, where there are two or more."""
        trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees(self.percent, self.recall) - 1)))
        rows = self.classes.select("cid", "n", "b0", "b1", "tokens", trees.alias("tree")).select(F.xxhash64("tree", F.element_at("tokens", F.col("tree") + 1)).alias("node"), "tree", "cid", "n", "b0", "b1")
        return self.crowded(rows)

    def crowded(self, rows: DataFrame) -> DataFrame:
        """Members of nodes that have two or more, with their node's first member, the pivot."""
        sizes = rows.groupBy("node").agg(F.count("*").alias("m"), F.min("cid").alias("pivot")).filter("m > 1")
        pivots = self.classes.select(F.col("cid").alias("pivot"), F.col("n").alias("p_n"), F.col("b0").alias("p0"), F.col("b1").alias("p1"))
        return stash(rows.join(sizes.join(pivots, "pivot"), "node"), "nodes")

    def stars(self, nodes: DataFrame) -> DataFrame:
        """Confirmed links between members and their node's first member."""
        apart = F.bit_count(F.col("b0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("p1")))
        sizes = 100 * F.least("n", "p_n") >= self.percent * F.greatest("n", "p_n")
        pairs = nodes.filter((F.col("cid") != F.col("pivot")) & (apart <= _most_apart(self.percent)) & sizes)
        return self.confirmed(pairs.select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct())

    def across(self, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """Confirmed links (a, b) that connect members of a node that labels (vertex, label) puts in different
        components."""
        label = lambda rows, col, name: rows.join(labels.toDF(col, name), col, "left").withColumn(name, F.coalesce(name, col))
        found, level = None, 1
        rows = label(label(nodes.select("node", "cid", "b0", "b1", "pivot"), "cid", "comp"), "pivot", "bulk")
        while True:
            rows = rows.withColumn("asks", F.col("comp") != F.col("bulk"))
            sizes = rows.groupBy("node").agg(F.count("*").alias("m"), F.count_if("asks").alias("out")).filter("out > 0")
            rows = stash(rows.join(sizes, "node"), "mixed-nodes")
            large = F.col("m") * F.col("out") > NODE_PAIRS if level < LEVELS else F.lit(False)
            tiles = self.tiled(rows.filter(~large))
            found = tiles if found is None else found.unionByName(tiles)
            rows = rows.filter(large)
            if level == LEVELS or rows.isEmpty():
                return self.linked(stash(found, "tiles"))
            level += 1
            branch = F.explode(F.sequence(F.lit(1), F.lit(BRANCHES)))
            chosen = F.element_at("tokens", (F.pmod(F.xxhash64("node", "branch"), F.lit(CHOICES)) + 1).cast("int"))
            deeper = rows.select("node", "cid", "b0", "b1", "comp", branch.alias("branch")).join(self.classes.select("cid", "tokens"), "cid")
            deeper = deeper.select(F.xxhash64("node", "branch", chosen).alias("node"), "cid", "b0", "b1", "comp")
            rows = deeper.join(deeper.groupBy("node").agg(F.min(F.struct("cid", "comp")).alias("p")).select("node", F.col("p.comp").alias("bulk")), "node")

    def tiled(self, rows: DataFrame) -> DataFrame:
        """Members outside the bulk, who ask, and all others, who are stored, dealt to tiles of bounded size."""
        n_out, n_all = F.ceil(F.col("out") / TILE), F.ceil(F.col("m") / TILE)
        block = lambda n: F.pmod(F.xxhash64("cid"), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        side = ["cid", "comp", "b0", "b1"]
        stored = rows.select("node", F.lit(False).alias("asks"), *side, every(n_out).alias("i"), block(n_all).alias("j"))
        asking = rows.filter("asks").select("node", F.lit(True).alias("asks"), *side, block(n_out).alias("i"), every(n_all).alias("j"))
        return stored.unionByName(asking).select(F.xxhash64("node", "i", "j").alias("tile"), "asks", *side)

    def linked(self, tiles: DataFrame) -> DataFrame:
        """Links found in tiles: first which members have a close one, then, with their sets, the links."""
        limit, percent = _most_apart(self.percent), self.percent
        dealt = lambda rows: rows.repartition("tile").sortWithinPartitions("tile")
        close = dealt(tiles).mapInArrow(_by_tile(lambda rows: [(c,) for c in _Tile(rows, limit).close_ones().tolist()], pa.schema([("cid", pa.int64())])), "cid long")
        close = stash(close.distinct(), "close")
        if close.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        folder = scratch_path(self.spark, "sets")
        places = self.texts(close).mapInArrow(frugal(_store_sets(folder)), "cid long, file string, start long, stop long")
        places = stash(places.dropDuplicates(["cid"]), "places")
        links = dealt(tiles.join(places, "cid")).mapInArrow(_by_tile(lambda rows: _Tile(rows, limit).links(folder, percent), pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long")
        return stash(links, "links")

    def components(self) -> DataFrame:
        """digest, label of the component and component_id, the component's least document id, of every class.

        Labels are the components' own; a component_id names several where an id has unlike texts."""
        nodes = self.roots()
        links = self.stars(nodes)
        labels = components(links)
        # what the first trees connect, the others needn't compare again
        for some in (F.col("tree") < FIRST_TREES, F.col("tree") >= FIRST_TREES):
            more = self.across(nodes.filter(some), labels)
            if not more.isEmpty():
                labels = components(labels.select(F.col("vertex").alias("a"), F.col("label").alias("b")).unionByName(more))
        joined = self.classes.select("cid", "rep", "digest").join(labels.withColumnRenamed("vertex", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        names = joined.groupBy("label").agg(F.min("rep").alias("name"))
        return joined.join(names, "label").select("digest", "label", F.col("name").alias("component_id"))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    join = Join(docs, percent, recall)
    rows = join.rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(join.components(), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.withColumn("component_id", component)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, *, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """docs with one document of each group: all columns, and only the rows that are kept.

    A group keeps one row of its least id (null only where no member has another) and, where that id has several
    of its texts, of the text of least key. Rows are told apart by id and text, so an id's other texts stay with
    their own groups. Rows without words are alone and stay.
    """
    join = Join(docs, percent, recall)
    found = join.rows.filter("n > 0").select("doc_id", "text_key", "digest").join(join.components().select("digest", "label"), "digest")
    found = stash(found.groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("n")), "near-duplicates")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key")
    same = lambda a, b: a["doc_id"].cast("long").eqNullSafe(b["gleaner_id"]) & b["gleaner_key"].eqNullSafe(_text_key(a["text"]) if "text" in a.columns else a["text_key"])
    named = lambda rows: rows.select(F.col("doc_id").alias("gleaner_id"), F.col("text_key").alias("gleaner_key"))
    keys, first = found.select("doc_id", "text_key"), named(first)
    gone = bounded(named(stash(keys.join(first, same(keys, first), "left_anti"), "gone")), BROADCAST_ROWS // 2)
    rows = docs.join(gone, same(docs, gone), "left_anti")
    repeated = named(stash(found.filter("n > 1").select("doc_id", "text_key"), "repeated"))
    if repeated.isEmpty():
        return rows
    repeated = bounded(repeated, BROADCAST_ROWS // 2)
    once = rows.join(repeated, same(rows, repeated), "left_anti")
    often = rows.join(repeated, same(rows, repeated), "left_semi").withColumn("gleaner_key", _text_key(F.col("text")))
    return once.unionByName(often.dropDuplicates(["doc_id", "gleaner_key"]).drop("gleaner_key"))
